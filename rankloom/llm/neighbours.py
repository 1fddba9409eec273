"""The k most similar vectors for every query vector.

Method: inverted multi-index. The two halves of the vectors are quantised separately; a cell of the index is a pair of
centroids. A query goes through the pairs by the sum of its distances to the two centroids, with a heap, until the cells
hold enough rows, and the entries of these cells are reranked by their cosine.

The index is a distributed table of cells. Cells are put together to groups of bounded size, near ones to one group, and a
query's vector is sent once to each group that has cells of it. A cell that holds a third of all rows is cut into many groups,
and the queries of a group into blocks of bounded size.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.session import cut_lineage, shuffle_partitions, small_table

DIM = 128
#: Rows that the centroids are fitted on: those of smallest hash, at most so many.
TRAIN_ROWS = 16_384
#: Rows of a cell in the mean.
CELL_ROWS = 16
#: A query sees at least this many times the square root of the number of rows.
PROBE = 24.0
#: Most rows of a group and most queries of a block.
BLOCK = 16_384
#: Numbers held at once for the best rows of queries.
HELD = 8_000_000


def sound(vector: Column, dim: int = DIM) -> Column:
    """Whether a vector counts: not null, ``dim`` finite numbers, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == dim) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors of a batch, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _kmeans(rows: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's iterations from evenly spaced rows; an empty centroid takes the row that is worst served."""
    k = min(k, len(rows))
    centres = rows[np.linspace(0, len(rows) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        gap = (centres**2).sum(1) - 2 * rows @ centres.T
        own = gap.argmin(1)
        sizes = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        filled = sizes > 0
        centres[filled] = sums[filled] / sizes[filled, None]
        if not filled.all():
            far = np.argsort(-gap.min(1))[: (~filled).sum()]
            centres[~filled] = rows[far]
    return centres


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * rows @ centres.T).argmin(1)


class MultiIndex:
    """Centroids of both halves and the number of rows in each cell."""

    def __init__(self, first: np.ndarray, second: np.ndarray, counts: dict[tuple[int, int], int]) -> None:
        self.first, self.second = first, second
        table = np.zeros((len(first), len(second)), np.int64)
        for (i, j), n in counts.items():
            table[i, j] = n
        self.counts = table.tolist()

    def near(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of both halves of the rows to the centroids."""
        half = rows.shape[1] // 2
        parts = ((self.first, rows[:, :half]), (self.second, rows[:, half:]))
        return tuple((c**2).sum(1) - 2 * x @ c.T + (x**2).sum(1)[:, None] for c, x in parts)

    def probe(self, vector: np.ndarray, wanted: float) -> dict[int, list[int]]:
        """Cells by summed distance until they hold ``wanted`` rows: the second centroids by the first."""
        return self.cells(*(d[0] for d in self.near(vector[None, :])), wanted)

    def cells(self, first: np.ndarray, second: np.ndarray, wanted: float) -> dict[int, list[int]]:
        """``probe``, from the distances to the centroids."""
        a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
        da, db = first[a].tolist(), second[b].tolist()
        a, b, counts, push, pop = a.tolist(), b.tolist(), self.counts, heapq.heappush, heapq.heappop
        heap, held, last_a, last_b = [(da[0] + db[0], 0, 0)], 0, len(a) - 1, len(b) - 1
        out: dict[int, list[int]] = {}
        while heap and held < wanted:
            _, i, j = pop(heap)
            size = counts[a[i]][b[j]]
            if size:
                held += size
                out.setdefault(a[i], []).append(b[j])
            if j < last_b:
                push(heap, (da[i] + db[j + 1], i, j + 1))
            if j == 0 and i < last_a:  # every pair is pushed once: along its row, and rows from their first
                push(heap, (da[i + 1] + db[0], i + 1, 0))
        return out


def unique_vectors(df: DataFrame, key: str, vector: str, dim: int, copies: int | None) -> DataFrame:
    """(id, embedding) of the sound rows, each pair once; of equal vectors the ``copies`` smallest ids (all if None).

    Rows of one vector have one similarity and ties go to the smaller id, so no other copy can be among the best. Copies are
    told by a 64-bit hash of the vector, which alone is shuffled to find them; only where more than ``copies`` ids have one
    hash do any drop out.
    """
    sound_rows = df.where(sound(F.col(vector), dim) & F.col(key).isNotNull()).select(F.col(key).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("embedding"))
    if copies is None:
        return sound_rows.distinct()
    marked = sound_rows.withColumn("mark", F.xxhash64("embedding"))
    order = Window.partitionBy("mark").orderBy("id")
    kept = marked.select("id", "mark").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= copies).drop("n")
    return marked.dropDuplicates(["id", "mark"]).join(kept, ["id", "mark"], "left_semi").select("id", "embedding")


def _assign(first: np.ndarray, second: np.ndarray, dim: int):  # noqa: ANN202
    schema = pa.schema([("id", pa.string()), ("embedding", pa.list_(pa.float32())), ("shard", pa.int32()), ("cell", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = _matrix(batch.column("embedding"), dim)
                i, j = _nearest(rows[:, : dim // 2], first), _nearest(rows[:, dim // 2 :], second)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("embedding").cast(pa.list_(pa.float32())), pa.array(i, pa.int32()), pa.array(j, pa.int32())], schema=schema)

    return run


def _layout(counts: dict[tuple[int, int], int], size: int) -> list[tuple[int, int, int, int]]:
    """(shard, cell, group, parts): cells in their order are put together to groups of about ``size`` rows; a cell of more rows
    has the next ``parts`` groups for itself."""
    out, group, held = [], 0, 0
    for (shard, cell), n in sorted(counts.items()):
        if n > size:
            group += held > 0
            parts = -(-n // size)
            out.append((shard, cell, group, parts))
            group, held = group + parts, 0
            continue
        if held and held + n > size:
            group, held = group + 1, 0
        out.append((shard, cell, group, 1))
        held += n
    return out


def _probes(index: MultiIndex, wanted: float, dim: int, layout: list[tuple[int, int, int, int]]):  # noqa: ANN202
    """Queries to (id, embedding, asked): for each group that has cells of it, the group and its cells (shard and cell as one number)."""
    kind = pa.list_(pa.struct([("group", pa.int32()), ("cells", pa.list_(pa.int32()))]))
    schema = pa.schema([("id", pa.string()), ("embedding", pa.list_(pa.float32())), ("asked", kind)])
    place = {(shard << 16) + cell: (group, parts) for shard, cell, group, parts in layout}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            asked = []
            for first, second in zip(*index.near(_matrix(batch.column("embedding"), dim)), strict=True):
                own: dict[int, list[int]] = {}
                for i, js in index.cells(first, second, wanted).items():
                    for j in js:
                        code = (i << 16) + j
                        group, parts = place[code]
                        for g in range(group, group + parts):
                            own.setdefault(g, []).append(code)
                asked.append([{"group": g, "cells": c} for g, c in own.items()])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("embedding").cast(pa.list_(pa.float32())), pa.array(asked, kind)], schema=schema)

    return run


def _rerank(k: int, dim: int):  # noqa: ANN202
    """The k best ids of a group for each query of a block, of the cells that the query asked for."""
    schema = pa.schema([("query_id", pa.string()), ("doc_id", pa.string()), ("similarity", pa.float64())])

    def run(docs: pa.Table, queries: pa.Table) -> pa.Table:
        if not docs.num_rows or not queries.num_rows:
            return schema.empty_table()
        docs, queries = docs.sort_by([("cell", "ascending"), ("id", "ascending")]).combine_chunks(), queries.combine_chunks()
        rows, asked = _matrix(docs["embedding"].combine_chunks(), dim), _matrix(queries["embedding"].combine_chunks(), dim)
        cell, n = docs["cell"].to_numpy(), docs.num_rows
        lists = queries["cells"].combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        owner, flat = np.repeat(np.arange(len(lists)), sizes), lists.flatten().to_numpy()
        # A row's key has its similarity, rounded so that equal vectors tie exactly whatever the order of the sums, and below it
        # its place by id, so that the greatest key is the best row.
        ids = np.array(docs["id"].to_pylist(), dtype=object)
        order = np.argsort(ids, kind="stable")
        bits = max(1, int(n - 1).bit_length())
        low_bits = np.empty(n, np.int64)
        low_bits[order] = n - 1 - np.arange(n)
        same = np.diff(np.concatenate([[0], np.flatnonzero(ids[order][1:] != ids[order][:-1]) + 1, [n]])).max()
        held = int(min(n, k * same))  # enough for k ids if one has several vectors
        out = []
        step = max(1, HELD // max(held, 1))
        for start in range(0, len(lists), step):
            stop = min(len(lists), start + step)
            taken = (owner >= start) & (owner < stop)
            by_cell = np.argsort(flat[taken], kind="stable")
            cells, who_all = flat[taken][by_cell], owner[taken][by_cell] - start
            best = np.full((stop - start, held), np.iinfo(np.int64).min)
            wanted, first = np.unique(cells, return_index=True)
            bounds = np.append(first, len(cells))
            lows, highs = np.searchsorted(cell, wanted), np.searchsorted(cell, wanted, "right")
            for c in range(len(wanted)):
                low, high = lows[c], highs[c]
                if low == high:
                    continue
                who = who_all[bounds[c] : bounds[c + 1]]
                for at in range(0, len(who), 1024):
                    some = who[at : at + 1024]
                    near = (np.rint((asked[some + start] @ rows[low:high].T) * 1e12).astype(np.int64) << bits) | low_bits[low:high]
                    both = np.concatenate([best[some], near], axis=1)
                    best[some] = np.partition(both, both.shape[1] - held, axis=1)[:, -held:]
            best = -np.sort(-best, axis=1)
            q, at = np.nonzero(best > np.iinfo(np.int64).min)
            key = best[q, at]
            doc, near = order[n - 1 - (key & ((1 << bits) - 1))], (key >> bits) / 1e12
            if same > 1:
                once = np.unique(np.stack([q, np.unique(ids, return_inverse=True)[1][doc]]), axis=1, return_index=True)[1]
                once.sort()
                q, doc, near = q[once], doc[once], near[once]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            q, doc, near = (x[place < k] for x in (q, doc, near))
            out.append(pa.table([queries["id"].take(pa.array(q + start)), docs["id"].take(pa.array(doc)), pa.array(near)], schema=schema))
        return pa.concat_tables(out)

    return run


def _best(local: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, similarity, rank): the best of the groups, in one shuffle by query."""
    best = local.repartition("query_id").groupBy("query_id", "doc_id").agg(F.max("similarity").alias("similarity"))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "doc_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(docs: DataFrame, queries: DataFrame, k: int = 10, key: str = "id", vector: str = "embedding", dim: int = DIM, probe: float = PROBE, train_rows: int = TRAIN_ROWS, block: int = BLOCK) -> DataFrame:
    """(query_id, doc_id, similarity, rank): for each query id the ``k`` ids of highest cosine among the rows it sees.

    Unsound vectors (null, not ``dim`` numbers, all zero, with null, not-a-number or infinite entries) and null ids never
    count; each id counts once; equal similarities (to 12 digits) go to the smaller id as a string. Without sound rows or
    queries there is no result. Every sound row is indexed; the centroids alone are fitted on at most ``train_rows`` rows.
    A query sees at least ``probe`` times the square root of the number of rows, and all rows if there are no more.
    """
    spark = docs.sparkSession
    sound_rows = docs.where(sound(F.col(vector), dim) & F.col(key).isNotNull()).select(F.col(key).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("embedding"))
    sample = sound_rows.orderBy(F.xxhash64("id"), "id").limit(train_rows).select("embedding").toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], "query_id string, doc_id string, similarity double, rank int")
    fit = _matrix(sample["embedding"].combine_chunks(), dim)
    fit = fit[np.sort(np.unique(fit, axis=0, return_index=True)[1])]  # copies don't draw centroids
    # As many cells as rows / CELL_ROWS, within 2^2 and 2^16.
    centroids = max(2, min(256, 1 << round(math.log2(max(4.0, math.sqrt(docs.count() / CELL_ROWS))))))
    first, second = _kmeans(fit[:, : dim // 2], centroids), _kmeans(fit[:, dim // 2 :], centroids)
    # Near first centroids have near numbers, so that their cells are in one group.
    first = first[np.argsort((first - first.mean(0)) @ np.linalg.svd(first - first.mean(0), full_matrices=False)[2][0], kind="stable")]
    indexed = cut_lineage(unique_vectors(docs, key, vector, dim, k).mapInArrow(_assign(first, second, dim), "id string, embedding array<float>, shard int, cell int"))
    # At most 256 x 256 counts.
    counts = {(r["shard"], r["cell"]): r["count"] for r in indexed.groupBy("shard", "cell").count().collect()}
    total, cores = sum(counts.values()), spark.sparkContext.defaultParallelism
    size = max(1, min(block, max(1024, -(-total // cores))))
    layout = _layout(counts, size)
    groups = max(g + parts for _, _, g, parts in layout)
    probes = unique_vectors(queries, key, vector, dim, None).mapInArrow(
        _probes(MultiIndex(first, second, counts), probe * math.sqrt(total), dim, layout), "id string, embedding array<float>, asked array<struct<group:int,cells:array<int>>>"
    )
    blocks = F.lit(1)
    if queries.count() > block:
        # The groups that more than ``block`` queries ask for: a row for each, joined to both sides.
        probes = cut_lineage(probes)
        asked = probes.select(F.explode("asked.group").alias("group")).groupBy("group").count()
        many = asked.where(F.col("count") > block).select("group", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
        blocks = F.coalesce("blocks", F.lit(1))
    cells = small_table(spark, layout, "shard int, cell int, group int, parts int")  # at most 256 x 256 rows
    left = indexed.join(F.broadcast(cells), ["shard", "cell"]).select("id", "embedding", (F.shiftleft("shard", 16) + F.col("cell")).alias("cell"), (F.col("group") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("group"))
    right = probes.select("id", "embedding", F.explode("asked").alias("x")).select("id", "embedding", "x.group", "x.cells")
    if queries.count() > block:
        left, right = left.join(many, "group", "left"), right.join(many, "group", "left")
    left = left.withColumn("q", F.explode(F.sequence(F.lit(0), blocks - 1))).select("id", "embedding", "cell", "group", "q")
    right = right.withColumn("q", F.pmod(F.xxhash64("id"), blocks).cast("int")).select("id", "embedding", "cells", "group", "q")
    # Few groups, each costly: enough partitions that hardly two meet.
    tasks = max(4 * groups, shuffle_partitions(spark)) if groups < 1000 else shuffle_partitions(spark)
    left, right = left.repartition(tasks, "group", "q"), right.repartition(tasks, "group", "q")
    local = left.groupBy("group", "q").cogroup(right.groupBy("group", "q")).applyInArrow(_rerank(k, dim), "query_id string, doc_id string, similarity double")
    return _best(local, k)


def nearest_exact(docs: DataFrame, queries: DataFrame, k: int = 10, key: str = "id", vector: str = "embedding", dim: int = DIM, block: int = BLOCK) -> DataFrame:
    """The same result by brute force, in blocks of rows and queries: the measure of ``nearest``'s recall."""
    rows, asked = unique_vectors(docs, key, vector, dim, k), unique_vectors(queries, key, vector, dim, None)
    d_blocks, q_blocks = max(1, -(-rows.count() // block)), max(1, -(-asked.count() // block))
    left = rows.withColumn("d", F.pmod(F.xxhash64("id"), F.lit(d_blocks)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))).withColumn("cell", F.lit(0))
    right = asked.withColumn("q", F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("int")).withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(d_blocks - 1)))).withColumn("cells", F.array(F.lit(0)))
    local = left.groupBy("d", "q").cogroup(right.groupBy("d", "q")).applyInArrow(_rerank(k, dim), "query_id string, doc_id string, similarity double")
    return _best(local, k)
