"""Runs: cleaning, ranking, score normalisation, candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOP_K = 100


def clean_run(df: DataFrame) -> DataFrame:
    """(model, query_id, doc_id, score), each document once with its highest score.

    Rows with a null id or model, or a null, not-a-number or infinite score are dropped; stored ranks are ignored.
    """
    return _sound(df).groupBy("model", "query_id", "doc_id").agg(F.max("score").alias("score"))


def _sound(df: DataFrame) -> DataFrame:
    ids = [F.col(c).cast("string").alias(c) for c in ("model", "query_id", "doc_id")]
    rows = df.select(*ids, F.col("score").cast("double").alias("score")).dropna()
    return rows.where(~F.isnan("score") & (F.abs("score") < float("inf")))


def models_of(df: DataFrame) -> DataFrame:
    """(model): the models of a stored run that have any sound row; few, and found without ranking the run."""
    return _sound(df).select("model").distinct()


def rank_run(df: DataFrame, k: int | None = TOP_K, keys: tuple[str, ...] = ("model", "query_id"), item: str = "doc_id", score: str = "score") -> DataFrame:
    """Adds ``rank``, from 1 by score and then by item, and keeps the first ``k`` of each group (all if None).

    With ``k``, each task cuts its part of a group before the shuffle, so a hot group never meets in one task.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc(score), item)
    ranked = df.withColumn("rank", F.row_number().over(order))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def prepare_run(df: DataFrame, k: int | None = None) -> DataFrame:
    """A stored run, clean and ranked: all its documents, or with ``k`` the first ``k`` for a query."""
    return rank_run(clean_run(df), k)


def minmax(run: DataFrame) -> DataFrame:
    """Adds ``norm``: the score between the least (0) and greatest (1) of its model and query; 0 where they are equal."""
    group = Window.partitionBy("model", "query_id")
    low, high = F.min("score").over(group), F.max("score").over(group)
    return run.withColumn("norm", (F.col("score") - low) / F.greatest(high - low, F.lit(1e-9)))


def run_maps(run: DataFrame) -> DataFrame:
    """(model, query_id, docs): a run's documents by rank as a list of (doc_id, score): the work item of rerankers.
    A row holds all documents of its query."""
    listed = F.sort_array(F.collect_list(F.struct("rank", "doc_id", "score")))
    return run.groupBy("model", "query_id").agg(F.transform(listed, lambda x: F.struct(x["doc_id"].alias("doc_id"), x["score"].alias("score"))).alias("docs"))
