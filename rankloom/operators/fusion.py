"""Rank fusion: RRF, RBC, CombMNZ, ISR, BordaFuse, Condorcet, and grids of combinations and strategies.

Fused lists keep all candidates. Scores are rounded to 9 digits before they are ranked, since sums over a shuffle have no
fixed order.
"""

from __future__ import annotations

import functools
import itertools
import operator
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.operators.runs import minmax, rank_run
from rankloom.schema import STRATEGIES, FusionStrategy
from rankloom.session import shuffle_partitions, small_table

DIGITS = 9
#: Added before scores are rounded, so that halves go up whatever the order of the sums was.
HALF = 1e-12


def _square(rank: Column) -> Column:
    """As a double, since the square of a rank beyond 46,340 is no int."""
    return rank.cast("double") * rank


def score_expr(method: str, params: dict[str, float] | None = None) -> Column:
    """Aggregate of one candidate's rows (``rank``, ``norm``) over the runs that have it."""
    params = params or {}
    rank = F.col("rank")
    if method == "rrf":
        score = F.sum(1.0 / (F.lit(float(params.get("k", 60))) + rank))
    elif method == "rbc":
        phi = float(params.get("phi", 0.95))
        score = F.sum((1.0 - phi) * F.pow(F.lit(phi), rank - 1))
    elif method in ("mnz", "combmnz"):
        score = F.count(F.lit(1)) * F.sum("norm")
    elif method == "isr":
        score = F.count(F.lit(1)) * F.sum(1.0 / _square(rank))
    else:
        raise ValueError(f"no aggregate for {method}")
    return F.round(score + HALF, DIGITS)


def fuse(run: DataFrame, method: str, params: dict[str, float] | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank) of the runs in ``run`` (model, query_id, doc_id, score, rank).

    Ties go to the smaller document id. Runs without a query add nothing to it; an empty run gives no rows. The order of the
    runs does not matter.
    """
    if method == "bordafuse":
        scored = borda_scores(run)
    elif method == "condorcet":
        scored = copeland_wins(run)
    else:
        rows = minmax(run) if method in ("mnz", "combmnz") else run
        scored = rows.groupBy("query_id", "doc_id").agg(score_expr(method, params).alias("score"))
    return rank_run(scored, None, ("query_id",))


def fuse_all(run: DataFrame, phi: float = 0.95, k: float = 60) -> DataFrame:
    """(query_id, doc_id, rrf, rbc, isr, mnz): the four additive methods in one shuffle."""
    aggregates = [score_expr("rrf", {"k": k}).alias("rrf"), score_expr("rbc", {"phi": phi}).alias("rbc"), score_expr("isr").alias("isr"), score_expr("mnz").alias("mnz")]
    return minmax(run).groupBy("query_id", "doc_id").agg(*aggregates)


def phi_sweep(run: DataFrame, phis: Sequence[float]) -> DataFrame:
    """(phi, query_id, doc_id, score, rank) of RBC for each phi, in one shuffle of the run."""
    scores = [score_expr("rbc", {"phi": p}).alias(f"s{i}") for i, p in enumerate(phis)]
    wide = run.groupBy("query_id", "doc_id").agg(*scores)
    melted = wide.select("query_id", "doc_id", F.explode(F.array(*[F.struct(F.lit(p).alias("phi"), F.col(f"s{i}").alias("score")) for i, p in enumerate(phis)])).alias("x"))
    return rank_run(melted.select("x.phi", "query_id", "doc_id", "x.score"), None, ("phi", "query_id"))


def borda_scores(run: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): a run gives its documents as many points as candidates stand at or below them, and each
    other candidate the mean of the points that are left.

    With c candidates and runs of n documents, a run that has the document gives c - rank + 1 instead of the mean (c - n + 1) / 2
    that it gives to others. So a document's points are half of (own runs + all runs) x c, and sums over its own rows and over
    its query: c is the number of the query's documents, its runs are those with a first rank, and their lengths add up to its rows.
    """
    length = F.count(F.lit(1)).over(Window.partitionBy("model", "query_id"))
    own = run.withColumn("n", length).groupBy("query_id", "doc_id").agg(
        F.count(F.lit(1)).alias("has"), F.count_if(F.col("rank") == 1).alias("firsts"), F.sum((F.col("n") + 1) / 2.0 - F.col("rank")).alias("above")
    )
    query = Window.partitionBy("query_id")
    c, runs, rows = F.count(F.lit(1)).over(query), F.sum("firsts").over(query), F.sum("has").over(query)
    score = (F.col("has") + runs) * c / 2.0 + F.col("above") + (runs - rows) / 2.0
    return own.select("query_id", "doc_id", F.round(score, DIGITS).alias("score"))


_WINS = pa.schema([("query_id", pa.string()), ("doc_id", pa.string()), ("score", pa.float64())])


#: Queries with a longer list are compared in blocks of about so many documents, and of these so many rows at once.
CONDORCET_BLOCK, CONDORCET_ROWS = 8192, 256


def _wins_of_blocks(rows: pa.Table) -> pa.Table:
    """Wins of each document of two blocks against those of the other block; within the block, if they are the same."""
    models, docs = rows["model"].combine_chunks().dictionary_encode(), rows["doc_id"].combine_chunks().dictionary_encode()
    m, d, at = len(models.dictionary), len(docs.dictionary), docs.indices.to_numpy()
    rank = np.full((m, d), np.iinfo(np.int32).max, np.int32)
    rank[models.indices.to_numpy(), at] = rows["rank"].to_numpy()
    block = np.zeros(d, np.int32)
    block[at] = rows["own"].to_numpy()
    first, second = rows["first"][0].as_py(), rows["second"][0].as_py()
    left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
    wins, others = np.zeros(d), rank[:, right]
    for start in range(0, len(left), CONDORCET_ROWS):
        part = left[start : start + CONDORCET_ROWS]
        votes = np.zeros((len(part), len(right)), np.int16)
        for a, b in zip(rank[:, part], others, strict=True):
            votes += np.less(a[:, None], b[None, :]).view(np.int8)  # > 0 where the row's document is above the column's
            votes -= np.greater(a[:, None], b[None, :]).view(np.int8)
        wins[part] += (votes > 0).sum(1)
        if first != second:
            wins[right] += (votes < 0).sum(0)
    return pa.table([pa.array([rows["query_id"][0].as_py()] * d, pa.string()), docs.dictionary.cast(pa.string()), pa.array(wins)], schema=_WINS)


def copeland_wins(run: DataFrame, block: int = CONDORCET_BLOCK) -> DataFrame:
    """(query_id, doc_id, score): how many candidates a document beats in a majority of the runs' votes.

    An unranked document is below a ranked one; two unranked ones have no vote. The count is a total order for Condorcet's
    relation with ties by document id. A query whose longest list has more than ``block`` documents is compared in pairs of
    blocks, each pair by itself, so that it is spread over tasks; there are fewer such queries than rows / ``block``, and
    these are broadcast.
    """
    run = run.where("query_id IS NOT NULL")  # as the join infers for its other side, so that both read one shuffle
    long = run.groupBy("query_id").agg(F.max("rank").alias("longest")).where(F.col("longest") > block)
    blocks = F.broadcast(long.select("query_id", F.ceil(F.col("longest") / block).cast("int").alias("blocks")))
    placed = run.join(blocks, "query_id", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    paired = placed.select("query_id", "doc_id", "model", "rank", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    keyed = paired.select("query_id", "doc_id", "model", "rank", "own", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"))
    wins = keyed.groupBy("query_id", "first", "second").applyInArrow(_wins_of_blocks, "query_id string, doc_id string, score double")
    # By query, as the ranking needs it; else the sum would be one shuffle more.
    return wins.repartition("query_id").groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))


def combinations(spark: SparkSession, models: Sequence[str], smallest: int, largest: int) -> DataFrame:
    """(combo, size, model) of every choice of the models, larger choices first; few rows, made in the driver."""
    rows = [("+".join(c), len(c), m) for c in choices(models, smallest, largest) for m in c]
    return small_table(spark, rows, "combo string, size int, model string")


#: Queries with a longest list beyond this are scored in blocks of about so many candidates.
GRID_BLOCK = 100_000
GRID = tuple(STRATEGIES[s] for s in ("combmnz", "rbc", "rrf", "isr"))


def _parts(strategy: FusionStrategy, runs: int) -> Column:
    """What each run gives a candidate under a strategy, as an array over the runs: from the arrays ``r`` (ranks, or null) and ``n``."""
    params = strategy.params or {}
    ranks = [F.get("r", F.lit(i)) for i in range(runs)]
    if strategy.method == "rrf":
        return F.array(*[1.0 / (F.lit(float(params.get("k", 60))) + r) for r in ranks])
    if strategy.method == "rbc":
        phi = float(params.get("phi", 0.95))
        return F.array(*[(1.0 - phi) * F.pow(F.lit(phi), r - 1) for r in ranks])
    if strategy.method in ("mnz", "combmnz"):
        return F.col("n")
    if strategy.method == "isr":
        return F.array(*[1.0 / _square(r) for r in ranks])
    raise ValueError(f"{strategy.method} is no sum over runs")


def choices(models: Sequence[str], smallest: int, largest: int) -> list[tuple[str, ...]]:
    """Every choice of the models, larger ones first."""
    return [c for size in range(largest, smallest - 1, -1) for c in itertools.combinations(models, size)]


def _wide(run: DataFrame, models: Sequence[str], strategies: Sequence[FusionStrategy], by: Sequence[str] = ("query_id", "doc_id"), times: int = 1) -> DataFrame:
    """(query_id, doc_id, r, p0, p1, ...): a candidate's ranks in the runs and what each gives it under each strategy, as
    arrays over the runs. The only shuffle of the run's rows, ``by`` these columns, into ``times`` as many partitions as usual."""
    one = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c)))
    own = minmax(run.where(F.col("model").isin(list(models))))
    own = own.repartition(times * shuffle_partitions(run.sparkSession), *by).groupBy("query_id", "doc_id")
    arrays = own.agg(F.array(*[one(m, "rank") for m in models]).alias("r"), F.array(*[one(m, "norm") for m in models]).alias("n"))
    return arrays.select("query_id", "doc_id", "r", *(_parts(s, len(models)).alias(f"p{i}") for i, s in enumerate(strategies)))


def _each_choice(wide: DataFrame, models: Sequence[str], combos: Sequence[tuple[str, ...]], strategies: Sequence[FusionStrategy]) -> DataFrame:
    """(combo, query_id, doc_id, s0, s1, ...): a row for each combination that has the candidate. No shuffle."""
    place = {m: i for i, m in enumerate(models)}
    listed = F.array(*[F.struct(F.lit("+".join(c)).alias("combo"), F.array(*[F.lit(place[m]) for m in c]).alias("at")) for c in combos])
    # Places beyond a combination's size are null; written out, not as lambdas, so that it stays compiled.
    at = [F.get("x.at", F.lit(j)) for j in range(max(map(len, combos)))]
    present = functools.reduce(operator.add, [F.when(F.get("r", i).isNotNull(), 1).otherwise(0) for i in at])
    rows = wide.withColumn("x", F.explode(listed)).withColumn("has", present).where("has > 0")

    def score(n: int, strategy: FusionStrategy) -> Column:
        total = functools.reduce(operator.add, [F.coalesce(F.get(f"p{n}", i), F.lit(0.0)) for i in at])
        return F.round((total * F.col("has") if strategy.method in ("mnz", "combmnz", "isr") else total) + HALF, DIGITS)

    return rows.select("x.combo", "query_id", "doc_id", *(score(n, s).alias(f"s{n}") for n, s in enumerate(strategies)))


def fusion_grid(run: DataFrame, combos: Sequence[tuple[str, ...]], strategies: Sequence[FusionStrategy] = GRID) -> DataFrame:
    """(combo, strategy, params, query_id, doc_id, score, rank) of every combination and additive strategy, in one job.

    The run's rows are shuffled by query, before they are multiplied by the combinations: ranking needs no shuffle of the
    grid, and there are as many more tasks as combinations, so that each sorts no more rows.
    """
    models = sorted({m for c in combos for m in c})
    scored = _each_choice(_wide(run, models, strategies, ("query_id",), len(combos)), models, combos, strategies)
    each = F.array(*[F.struct(F.lit(s.method).alias("strategy"), F.lit(s.label).alias("params"), F.col(f"s{i}").alias("score")) for i, s in enumerate(strategies)])
    melted = scored.select("combo", "query_id", "doc_id", F.explode(each).alias("x")).select("combo", "x.strategy", "x.params", "query_id", "doc_id", "x.score")
    order = Window.partitionBy("combo", "strategy", "params", "query_id").orderBy(F.desc("score"), "doc_id")
    return melted.withColumn("rank", F.row_number().over(order))


def judged_grid(run: DataFrame, qrels: DataFrame, combos: Sequence[tuple[str, ...]], strategies: Sequence[FusionStrategy] = GRID, block: int = GRID_BLOCK) -> DataFrame:
    """The rows of ``fusion_grid`` that are judged relevant, (combo, strategy, params, query_id, doc_id, rank): all that metrics need.

    A judged document's rank is one more than the number of candidates that are above it, which is counted; no list is
    sorted. The candidates of a judged query are scored in one vectorised call, those of a query with more than ``block`` in
    blocks, to each of which its few judged documents are sent; the counts are added up.
    """
    models = sorted({m for c in combos for m in c})
    relevant = qrels.where("relevance > 0").select("query_id", "doc_id").distinct()
    own = run.where(F.col("model").isin(models)).join(relevant.select("query_id"), "query_id", "left_semi")
    long = own.groupBy("query_id").agg(F.max("rank").alias("longest")).where(F.col("longest") > block)
    blocks = F.broadcast(long.select("query_id", F.ceil(F.col("longest") / block).cast("int").alias("blocks")))  # fewer than rows / block
    one = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c)))
    wide = minmax(own).groupBy("query_id", "doc_id").agg(F.array(*[one(m, "rank") for m in models]).alias("r"), F.array(*[one(m, "norm") for m in models]).alias("n"))
    wide = wide.join(relevant.withColumn("judged", F.lit(True)), ["query_id", "doc_id"], "left").join(blocks, "query_id", "left")
    home = F.pmod(F.xxhash64("doc_id"), F.coalesce("blocks", F.lit(1))).cast("int")
    every = F.when(F.col("judged"), F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).otherwise(F.array(F.col("home")))
    placed = wide.withColumn("home", home).select("query_id", "doc_id", "r", "n", F.coalesce("judged", F.lit(False)).alias("judged"), "home", F.explode(every).alias("block"))
    above = placed.repartition(shuffle_partitions(run.sparkSession), "query_id", "block").groupBy("query_id", "block").applyInArrow(_above_judged(models, combos, strategies), "combo int, strategy int, query_id string, doc_id string, above bigint")
    ranks = above.groupBy("combo", "strategy", "query_id", "doc_id").agg((F.sum("above") + 1).cast("int").alias("rank"))
    name = lambda values, c: F.element_at(F.array(*[F.lit(v) for v in values]), F.col(c) + 1)
    return ranks.select(
        name(["+".join(c) for c in combos], "combo").alias("combo"), name([s.method for s in strategies], "strategy").alias("strategy"),
        name([s.label for s in strategies], "strategy").alias("params"), "query_id", "doc_id", "rank",
    )


_ABOVE = pa.schema([("combo", pa.int32()), ("strategy", pa.int32()), ("query_id", pa.string()), ("doc_id", pa.string()), ("above", pa.int64())])


def _given(strategy: FusionStrategy, rank: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """What each run (a column) gives each candidate (a row) under a strategy; ranks and norms are not-a-number where it lacks it."""
    params = strategy.params or {}
    if strategy.method == "rrf":
        return 1.0 / (float(params.get("k", 60)) + rank)
    if strategy.method == "rbc":
        phi = float(params.get("phi", 0.95))
        return (1.0 - phi) * phi ** (rank - 1)
    if strategy.method in ("mnz", "combmnz"):
        return norm
    if strategy.method == "isr":
        return 1.0 / rank**2
    raise ValueError(f"{strategy.method} is no sum over runs")


def _above_judged(models: Sequence[str], combos: Sequence[tuple[str, ...]], strategies: Sequence[FusionStrategy]):  # noqa: ANN202
    """For each combination, strategy and judged document, how many candidates of a block are above it in the fused list."""
    place = {m: i for i, m in enumerate(models)}

    def run(rows: pa.Table) -> pa.Table:
        matrix = lambda c: rows[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows.num_rows, len(models))
        rank, norm = matrix("r"), matrix("n")
        ids = np.array(rows["doc_id"].to_pylist(), dtype=object)
        judged, own = rows["judged"].to_numpy(), rows["home"].to_numpy() == rows["block"][0].as_py()
        asked = np.flatnonzero(judged)
        if not len(asked):
            return _ABOVE.empty_table()
        by_id = np.empty(len(ids), np.int64)
        by_id[np.argsort(ids, kind="stable")] = np.arange(len(ids))
        parts = [np.nan_to_num(_given(s, rank, norm)) for s in strategies]
        has = ~np.isnan(rank)
        out: list[tuple] = []
        for c, combo in enumerate(combos):
            at = [place[m] for m in combo]
            runs = has[:, at].sum(1)
            among = own & (runs > 0)
            for n, strategy in enumerate(strategies):
                total = functools.reduce(operator.add, [parts[n][:, i] for i in at])
                score = _rounded(total * runs if strategy.method in ("mnz", "combmnz", "isr") else total)
                for j in asked[runs[asked] > 0].tolist():
                    better = (score > score[j]) | ((score == score[j]) & (by_id < by_id[j]))
                    out.append((c, n, ids[j], int((better & among).sum())))
        if not out:
            return _ABOVE.empty_table()
        c, n, docs, above = zip(*out, strict=True)
        return pa.table([pa.array(c, pa.int32()), pa.array(n, pa.int32()), pa.array([rows["query_id"][0].as_py()] * len(out), pa.string()), pa.array(docs, pa.string()), pa.array(above, pa.int64())], schema=_ABOVE)

    return run


def _rounded(score: np.ndarray) -> np.ndarray:
    """To DIGITS digits, halves away from zero as Spark's ``round`` has it; scores are not negative."""
    return np.floor((score + HALF) * 10.0**DIGITS + 0.5) / 10.0**DIGITS


def grid_lists(spark: SparkSession, combos: Sequence[tuple[str, ...]], strategies: Sequence[FusionStrategy] = GRID) -> DataFrame:
    """(combo, strategy, params): the lists of a grid; few rows."""
    return small_table(spark, [("+".join(c), s.method, s.label) for c in combos for s in strategies], "combo string, strategy string, params string")
