"""Ranking metrics, their means, comparison of runs, and result tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("ndcg_10", "recall_100", "mrr_10", "map", "p_10", "p_50")
DIGITS = 9
#: Added before means are rounded, so that halves go up whatever the order of the sums was.
HALF = 1e-12


def _ideal(qrels: DataFrame, depth: int = 10) -> DataFrame:
    """(query_id, relevant, ideal): relevant documents, and the gain of the best possible list. A query has few judgements."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "doc_id"))
    gain = F.when(F.col("place") <= depth, F.col("relevance") / F.log2(F.col("place") + 1)).otherwise(0.0)
    return qrels.withColumn("place", place).groupBy("query_id").agg(F.sum(F.when(F.col("relevance") > 0, 1).otherwise(0)).alias("relevant"), F.sum(gain).alias("ideal"))


#: Parts that lists are dealt to, so that lists and judged queries meet in an equi-join.
LIST_PARTS = 16


def _each_list(base: DataFrame, lists: DataFrame, keys: list[str]) -> DataFrame:
    """Every row of ``base`` (judged queries) for every list, which is what comes out of it in the end. Neither side is broadcast
    unless Catalyst knows it to be small."""
    every = base.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(LIST_PARTS - 1))))
    return every.join(lists.withColumn("__part", F.pmod(F.xxhash64(*keys), F.lit(LIST_PARTS)).cast("int")), "__part").drop("__part")


def per_query(run: DataFrame, qrels: DataFrame, keys: Sequence[str] = ("model",), lists: DataFrame | None = None) -> DataFrame:
    """(keys..., query_id and the six metrics) for every query of the judgements and every list of the run.

    A query that a list lacks scores 0 on all metrics; queries without judgements don't count; a query of which no document
    is relevant scores 0. ``lists`` names the lists (keys...); without it they are taken from the run, which is then read twice.
    Precision divides by its depth; MAP goes over the whole list. The judgements are joined to the run before anything else, so
    only hits are shuffled.
    """
    keys = list(keys)
    hits = run.select(*keys, "query_id", "doc_id", "rank").join(qrels.where("relevance > 0"), ["query_id", "doc_id"])
    order = Window.partitionBy(*keys, "query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = hits.withColumn("so_far", F.count("*").over(order))
    at = lambda k: F.sum(F.when(F.col("rank") <= k, 1).otherwise(0))
    sums = counted.groupBy(*keys, "query_id").agg(
        F.sum(F.when(F.col("rank") <= 10, F.col("relevance") / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
        at(100).alias("h100"), F.min(F.when(F.col("rank") <= 10, F.col("rank"))).alias("first"), F.sum(F.col("so_far") / F.col("rank")).alias("ap"),
        at(10).alias("h10"), at(50).alias("h50"),
    )
    lists = run.select(*keys).distinct() if lists is None else lists
    return _each_list(_ideal(qrels), lists, keys).join(sums, [*keys, "query_id"], "left").select(
        *keys, "query_id",
        *(F.round(F.coalesce(x, F.lit(0.0)), DIGITS).alias(n) for x, n in (
            (F.try_divide(F.col("dcg"), F.col("ideal")), "ndcg_10"), (F.try_divide(F.col("h100"), F.col("relevant")), "recall_100"), (1.0 / F.col("first"), "mrr_10"),
            (F.try_divide(F.col("ap"), F.col("relevant")), "map"), (F.col("h10") / 10.0, "p_10"), (F.col("h50") / 50.0, "p_50"),
        )),
    )


def means(scores: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """(keys..., queries, six means) of per-query metrics."""
    return scores.groupBy(*keys).agg(F.count("*").alias("queries"), *(F.round(F.avg(m) + HALF, 6).alias(m) for m in METRICS))


def evaluate(run: DataFrame, qrels: DataFrame, keys: Sequence[str] = ("model",), lists: DataFrame | None = None) -> DataFrame:
    """The six metrics of every list of the run."""
    return means(per_query(run, qrels, keys, lists), keys)


def paired_t(scores: DataFrame, metric: str, keys: str = "model") -> DataFrame:
    """(first, second, n, mean_delta, t, p) of each pair of lists: the paired t statistic of a metric and its two-sided probability;
    both null if all deltas are equal."""
    a = scores.select(F.col(keys).alias("first"), "query_id", F.col(metric).alias("x"))
    b = scores.select(F.col(keys).alias("second"), "query_id", F.col(metric).alias("y"))
    deltas = a.join(b, "query_id").where(F.col("first") < F.col("second")).withColumn("d", F.round(F.col("x") - F.col("y"), DIGITS))
    spread = F.stddev_samp("d")
    tested = deltas.groupBy("first", "second").agg(
        F.count("*").alias("n"), F.round(F.avg("d") + HALF, 6).alias("mean_delta"), F.when(spread > 1e-12, F.avg("d") / (spread / F.sqrt(F.count("*")))).alias("t"),
    )
    return tested.select("first", "second", "n", "mean_delta", F.round("t", 4).alias("t"), F.round(p_value(F.col("t"), F.col("n")) + HALF, 6).alias("p"))


def result_rows(metrics: DataFrame) -> DataFrame:
    """Metrics as table cells: four digits; an empty strategy or parameter list is one space."""
    blank = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(" ")).otherwise(F.col(c))
    return metrics.select("model", blank("strategy").alias("strategy"), blank("params").alias("params"), *(F.format_string("%.4f", F.round(F.col(m) + HALF, 4)).alias(m) for m in METRICS))


def markdown_lines(rows: DataFrame, titles: dict[str, str]) -> DataFrame:
    """(model, strategy, params, line): the rows as lines of a Markdown table whose columns are as wide as their widest cell."""
    widths = rows.agg(*(F.greatest(F.max(F.length(c)), F.lit(len(t))).alias(f"w_{c}") for c, t in titles.items()))
    padded = [F.rpad(F.col(c), F.col(f"w_{c}"), F.lit(" ")) for c in titles]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *padded), F.lit(" |"))
    return rows.crossJoin(F.broadcast(widths)).select("model", "strategy", "params", line.alias("line"))  # one row of widths


TITLES = {"model": "model", "strategy": "strategy", "params": "params", "ndcg_10": "ndcg@10", "recall_100": "recall@100", "mrr_10": "mrr@10", "map": "map", "p_10": "precision@10", "p_50": "precision@50"}


def markdown_table(rows: list[dict[str, str]]) -> str:
    """The whole table of a few result rows, with header, for printing."""
    widths = {c: max([len(t), *(len(r[c]) for r in rows)]) for c, t in TITLES.items()}
    lines = [" | ".join(t.ljust(widths[c]) for c, t in TITLES.items()), " | ".join("-" * widths[c] for c in TITLES)]
    lines += [" | ".join(r[c].ljust(widths[c]) for c in TITLES) for r in rows]
    return "\n".join(f"| {line} |" for line in lines)


def inline(row: dict, strategy: str = "", params: str = "") -> str:
    """One result on one line."""
    tag = row["model"] + (f" ({strategy}{', ' + params if params else ''})" if strategy else "")
    return f"{tag}: " + ", ".join(f"{TITLES[m]} {row[m]:.4f}" for m in METRICS)


def boxed(row: dict, strategy: str = "", params: str = "") -> str:
    """One result as a framed block, a line for each metric."""
    head = inline(row, strategy, params).split(": ndcg")[0]
    lines = [f"{TITLES[m]:<14}{row[m]:>8.4f}" for m in METRICS]
    width = max(map(len, [head, *lines]))
    rule = "+" + "-" * (width + 2) + "+"
    return "\n".join([rule, f"| {head:<{width}} |", rule, *(f"| {line:<{width}} |" for line in lines), rule])


#: How a result is told: as a block, on a line, or not at all.
REPORTS = {"box": boxed, "inline": inline, "quiet": lambda row, strategy="", params="": ""}


def report(metrics: DataFrame, mode: str = "inline", say: Callable[[str], None] = print) -> DataFrame:
    """Says the few rows of ``metrics``, each in the given mode, and gives them back."""
    if mode != "quiet":
        for row in metrics.collect():
            told = row.asDict()
            say(REPORTS[mode](told, told.get("strategy") or "", told.get("params") or ""))
    return metrics


def two_sided(t: float, degrees: int) -> float:
    """Probability of a |t| as great under Student's distribution, by the finite series in the cosine of atan(|t| / root of the
    degrees): each term is the one before times the square of the cosine and (2j - 1) / 2j, or 2j / (2j + 1) where degrees are odd."""
    angle = math.atan(abs(t) / math.sqrt(degrees))
    odd = degrees % 2
    j = np.arange(1, (degrees - 2 - odd) // 2 + 1, dtype=float)
    factors = 2 * j / (2 * j + 1) if odd else (2 * j - 1) / (2 * j)
    total = 1.0 + float(np.cumprod(factors * math.cos(angle) ** 2).sum())
    if not odd:
        inside = math.sin(angle) * total
    else:
        inside = 2 / math.pi * (angle + (math.sin(angle) * math.cos(angle) * total if degrees > 1 else 0.0))
    return max(0.0, 1.0 - inside)


def p_value(t: Column, n: Column) -> Column:
    """``two_sided`` of n - 1 degrees, for the few rows of a comparison; null for null t or fewer than 2 pairs."""

    @F.arrow_udf("double")
    def probability(ts: pa.Array, ns: pa.Array) -> pa.Array:
        return pa.array([None if x is None or k is None or k < 2 else two_sided(x, k - 1) for x, k in zip(ts.to_pylist(), ns.to_pylist(), strict=True)], pa.float64())

    return probability(t, n)
