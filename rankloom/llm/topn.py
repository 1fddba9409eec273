"""The N best items of every group.

Method: partition lower bounds. The N-th best distinct item that one partition holds of a group is a bound that the group's
final N-th best cannot be below; the best such bound of each group filters the rows, and the survivors are ranked.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.session import cut_lineage

#: Rows that a task gathers before it takes their bounds and forgets them; any number gives valid bounds.
CHUNK_ROWS = 500_000
#: Most bounds that are broadcast, those of the groups with most rows; beyond it, those of the other groups are joined by a shuffle.
MAX_BOUNDS = 200_000


def _bounds(groups: list[str], n: int, chunk_rows: int, schema: pa.Schema):  # noqa: ANN202
    """For each group with at least ``n`` distinct items in a chunk of the partition: score and item of the n-th best."""

    def of(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        best = pa.Table.from_batches(batches).group_by([*groups, "item"]).aggregate([("score", "max")]).combine_chunks()
        best = best.sort_by([*((g, "ascending") for g in groups), ("score_max", "descending"), ("item", "ascending")])
        change = np.zeros(best.num_rows, bool)
        change[:1] = True
        for g in groups:
            code = best[g].combine_chunks().dictionary_encode().indices.to_numpy()
            change[1:] |= code[1:] != code[:-1]
        starts = np.flatnonzero(change)
        sizes = np.diff(np.append(starts, best.num_rows))
        at = starts[sizes >= n] + n - 1
        taken = best.take(pa.array(at))
        return pa.RecordBatch.from_arrays([*(taken[g].combine_chunks() for g in groups), taken["score_max"].combine_chunks(), taken["item"].combine_chunks()], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= chunk_rows:
                yield of(held)
                held, rows = [], 0
        if held:
            yield of(held)

    return run


def group_bounds(rows: DataFrame, groups: Sequence[str], n: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(groups..., bound_score, bound_item): the best of the partitions' bounds, of ``rows`` (groups..., item, score)."""
    names = [f"g{i}" for i in range(len(groups))]
    keyed = rows.select(*[F.col(g).cast("string").alias(k) for g, k in zip(groups, names, strict=True)], "item", "score")
    schema = pa.schema([*((k, pa.string()) for k in names), ("bound_score", pa.float64()), ("bound_item", pa.string())])
    local = keyed.mapInArrow(_bounds(names, n, chunk_rows, schema), ", ".join(f"{k} string" for k in names) + ", bound_score double, bound_item string")
    top = F.max("bound_score").alias("bound_score")
    # The best score, and at that score the smallest item: max_by over a struct of both would need a descending string.
    by_score = local.groupBy(*names, "bound_score").agg(F.min("bound_item").alias("bound_item"), F.count("*").alias("seen"))
    return by_score.groupBy(*names).agg(top, F.max_by("bound_item", "bound_score").alias("bound_item"), F.sum("seen").alias("seen"))


def _hot(bounds: DataFrame, most: int) -> int:
    """The least number of parts (``seen``) from which on at most ``most`` groups have as many; there are few such numbers."""
    total, least = 0, 1
    for r in sorted(bounds.groupBy("seen").count().collect(), reverse=True):
        total += r["count"]
        if total > most:
            return r["seen"] + 1
    return least


def top_n(df: DataFrame, groups: Sequence[str], item: str, score: str, n: int = 10, max_bounds: int = MAX_BOUNDS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(groups..., item, score, rank): the ``n`` distinct items of highest score in each group, fewer if it has fewer.

    Equal scores go to the smaller item as a string in code-point order; an item written several times counts once, with its
    highest score. Rows with a null group key, a null item, or a null or not-a-number score never count; infinite scores do.
    Columns besides those named do not matter. An empty table gives no rows. Groups and items come out as strings.

    Every group that has ``n`` items in some part of a partition has a bound. If there are more than ``max_bounds`` of them,
    those of the groups that fill most parts are broadcast, so that hot groups are cut where they are read, and the others are
    joined in a shuffle by group. Behind the filter a partition has at most ``n`` items of a bounded group, so no group is gathered
    in one task.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    names = [f"g{i}" for i in range(len(groups))]
    sound = F.col(f"`{score}`").isNotNull() & ~F.isnan(F.col(f"`{score}`").cast("double")) & F.col(f"`{item}`").isNotNull()
    for g in groups:
        sound = sound & F.col(f"`{g}`").isNotNull()
    rows = df.where(sound).select(
        *[F.col(f"`{g}`").cast("string").alias(k) for g, k in zip(groups, names, strict=True)],
        F.col(f"`{item}`").cast("string").alias("item"), (F.col(f"`{score}`").cast("double") + F.lit(0.0)).alias("score"),
    )
    bounds = group_bounds(rows, names, n, chunk_rows)
    passes = F.col("bound_score").isNull() | (F.col("score") > F.col("bound_score")) | ((F.col("score") == F.col("bound_score")) & (F.col("item") <= F.col("bound_item")))
    least = _hot(bounds := cut_lineage(bounds), max_bounds)
    hot = bounds.where(F.col("seen") >= least).drop("seen")
    near = rows.join(F.broadcast(hot), names, "left").where(passes).select(*names, "item", "score")
    if least > 1:
        near = near.join(bounds.where(F.col("seen") < least).drop("seen"), names, "left").where(passes).select(*names, "item", "score")
    best = near.groupBy(*names, "item").agg(F.max("score").alias("score"))
    order = Window.partitionBy(*names).orderBy(F.desc("score"), "item")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return ranked.select(*[F.col(k).alias(g) for g, k in zip(groups, names, strict=True)], F.col("item").alias(item), F.col("score").alias(score), "rank")
