"""Filling containers of fixed capacity with items of varying length.

Method: bounded-space online best-fit. Each task keeps a fixed number of open bins in a bitset keyed by free space; an item
goes to the open bin that it fills best, and where a bin is needed beyond the number, the fullest closes first. The bins that
are still open when the tasks end, at most that number for each task, are packed once more as whole items, in a tree of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.session import cut_lineage

CAPACITY = 512
OPEN_BINS = 64


class OpenBins:
    """Open bins of ``capacity``, at most ``limit`` of them; ``mask`` has bit f set while some open bin has f free."""

    def __init__(self, capacity: int, limit: int) -> None:
        self.capacity, self.limit = capacity, limit
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = self.count = self.next = 0

    def _push(self, bin_no: int, free: int) -> None:
        self.by_free[free].append(bin_no)
        self.mask |= 1 << free
        self.count += 1

    def _pop(self, free: int) -> int:
        bins = self.by_free[free]
        bin_no = bins.pop()
        if not bins:
            self.mask ^= 1 << free
        self.count -= 1
        return bin_no

    def place(self, size: int) -> int:
        """The bin for an item of ``size``, which is at most the capacity."""
        fitting = self.mask >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            bin_no = self._pop(free)
        else:
            free, bin_no = self.capacity, self.next
            self.next += 1
        free -= size
        if free:
            if self.count == self.limit:
                self._pop((self.mask & -self.mask).bit_length() - 1)
            self._push(bin_no, free)
        return bin_no

    def still_open(self) -> dict[int, int]:
        """Free space of each bin that is still open."""
        return {b: free for free, bins in enumerate(self.by_free) for b in bins}


def _pack(capacity: int, limit: int, schema: pa.Schema):  # noqa: ANN202
    """Packs the rows (key..., words) of a partition and adds the bin of each as they come; at the end a row for each bin that is
    still open, with null keys, its words and its free space. Only the open bins are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        bins = OpenBins(capacity, limit)
        for batch in batches:
            own = np.array([bins.place(w) for w in batch.column("words").to_pylist()], np.int64)
            columns = [batch.column(n) for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array((task << 32) + own), pa.nulls(batch.num_rows, pa.int32())], schema=schema)
        still = bins.still_open()
        if still:
            tail = {"words": [capacity - f for f in still.values()], "bin": [(task << 32) + b for b in still], "free": list(still.values())}
            yield pa.RecordBatch.from_arrays([pa.array(tail.get(f.name, [None] * len(still)), f.type) for f in schema], schema=schema)

    return run


def item_pieces(df: DataFrame, key: str, words: Column, capacity: int) -> DataFrame:
    """(key, piece, pieces, words): an item within the capacity is one piece; a larger one full pieces and a remainder."""
    sized = df.select(F.col(key), words.cast("int").alias("__n"))
    cut = sized.select(key, "__n", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("__n") / capacity).cast("int") - 1, F.lit(0)))).alias("piece"))
    return cut.select(
        key, "piece", F.greatest(F.ceil(F.col("__n") / capacity).cast("int"), F.lit(1)).alias("pieces"),
        F.least(F.lit(capacity), F.col("__n") - F.col("piece") * capacity).alias("words"),
    )


def pack_items(items: DataFrame, key: str, words: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, tasks: int | None = None) -> DataFrame:
    """(key, piece, pieces, words, container) for every item of ``items``, one row per distinct key.

    A repeated key is one item of its greatest length; null keys are no items; null or negative lengths count as 0, and such
    an item takes a place in a container too. Only items over the capacity are divided. An empty table gives no rows.
    The rows go to ``tasks`` tasks (default: spark.sql.shuffle.partitions) by hash and are packed there in key order, so
    the result is the same on every run. A task hands items on as it packs them and holds its open bins only.
    """
    spark = items.sparkSession
    one = items.where(F.col(key).isNotNull()).groupBy(F.col(key)).agg(F.max(F.greatest(F.coalesce(F.col(words), F.lit(0)), F.lit(0))).alias("__w"))
    pieces = item_pieces(one, key, F.col("__w"), capacity)
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = pieces.repartition(tasks, key).sortWithinPartitions(F.xxhash64(key), key, "piece")
    kind = dict(pieces.dtypes)[key]
    arrow = pa.string() if kind == "string" else pa.int64()
    first = cut_lineage(
        spread.select(F.col(key).cast("string" if kind == "string" else "bigint"), "piece", "pieces", "words").mapInArrow(
            _pack(capacity, open_bins, pa.schema([(key, arrow), ("piece", pa.int32()), ("pieces", pa.int32()), ("words", pa.int32()), ("bin", pa.int64()), ("free", pa.int32())])),
            f"`{key}` {kind if kind == 'string' else 'bigint'}, piece int, pieces int, words int, bin bigint, free int",
        )
    )
    placed = first.where("free IS NULL").drop("free")
    tails = first.where("free IS NOT NULL").select(F.col("bin").alias("tail"), "words")
    merged = _merged(tails, tasks, capacity, open_bins)
    return placed.join(merged, placed["bin"] == merged["tail"], "left").select(key, "piece", "pieces", "words", F.coalesce("container", "bin").alias("container"))


#: Tasks whose open bins are packed once more by one task of the next round.
FAN_IN = 16


def _merged(tails: DataFrame, tasks: int, capacity: int, open_bins: int) -> DataFrame:
    """(tail, container): the bins (tail, words) that ``tasks`` tasks left open, packed as whole items in a tree of tasks.

    A task has the open bins of at most about FAN_IN tasks, ``open_bins`` each; the numbers of a round's containers begin behind
    those of the round before.
    """
    schema = pa.schema([("tail", pa.int64()), ("words", pa.int32()), ("bin", pa.int64()), ("free", pa.int32())])
    base, merged = tasks, None
    while True:
        tasks = -(-tasks // FAN_IN)
        shifted = (F.col("bin") + F.lit(base << 32)).alias("bin")
        spread = tails.repartition(tasks, "tail").sortWithinPartitions(F.desc("words"), "tail")
        packed = cut_lineage(spread.mapInArrow(_pack(capacity, open_bins, schema), "tail bigint, words int, bin bigint, free int").select("tail", "words", shifted, "free"))
        own = packed.where("free IS NULL").select("tail", F.col("bin").alias("container"))
        if merged is None:
            merged = own
        else:
            again = own.withColumnsRenamed({"tail": "at", "container": "later"})
            merged = merged.join(again, merged["container"] == again["at"], "left").select("tail", F.coalesce("later", "container").alias("container"))
        if tasks == 1:
            return merged
        tails = packed.where("free IS NOT NULL").select(F.col("bin").alias("tail"), "words")
        base += tasks
