"""Judgements and query texts: building, pruning, reporting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators.corpus import latest_rows


def test_rows(judgements: DataFrame, split: str | None = None, match_score: float | None = None, expanded_search: bool | None = None) -> DataFrame:
    """Judgements of a split, with a match score and an expansion flag, each where it is asked for."""
    for name, value in (("split", split), ("match_score", match_score), ("expanded_search", expanded_search)):
        if value is not None:
            judgements = judgements.where(F.col(name) == F.lit(value))
    return judgements


def split_or_first(rows: DataFrame, split: str, column: str = "split") -> DataFrame:
    """The rows of ``split``; where there are none, those of the first split in alphabetical order. Null splits don't count."""
    chosen = rows.agg(F.coalesce(F.max(F.when(F.col(column) == split, split)), F.min(column)).alias("__split"))  # one row
    return rows.join(F.broadcast(chosen), F.col(column) == F.col("__split"), "left_semi")


def build_qrels(judgements: DataFrame, query: str = "id", doc: str = "docid", relevance: str | None = None) -> DataFrame:
    """(query_id, doc_id, relevance), one row for each pair: relevance 1, or the greatest of a graded column.

    Ids become strings; rows with a null id on either side are dropped; null grades count as 0.
    """
    grade = F.lit(1) if relevance is None else F.coalesce(F.col(relevance).cast("int"), F.lit(0))
    rows = judgements.select(F.col(query).cast("string").alias("query_id"), F.col(doc).cast("string").alias("doc_id"), grade.alias("relevance"))
    return rows.where("query_id IS NOT NULL AND doc_id IS NOT NULL").groupBy("query_id", "doc_id").agg(F.max("relevance").alias("relevance"))


def query_map(rows: DataFrame, query: str, text: str, at: str) -> DataFrame:
    """(query_id, text), one row for each query: the last text by ``at``, of equal times the greatest. Null texts don't count."""
    texts = rows.select(F.col(query).cast("string").alias("query_id"), F.col(text).alias("text"), F.col(at).alias("at")).where("text IS NOT NULL")
    return latest_rows(texts, ["query_id"], [F.desc_nulls_last("at"), F.desc("text")]).drop("at")


def prune_qrels(qrels: DataFrame, kept_docs: DataFrame) -> DataFrame:
    """Judgements whose document was kept; a query without any is gone with its last row."""
    return qrels.join(kept_docs.select("doc_id"), "doc_id", "left_semi").select("query_id", "doc_id", "relevance")


def prune_queries(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Query texts that still have a judgement."""
    return queries.join(qrels.select("query_id"), "query_id", "left_semi")


def prune_report(qrels: DataFrame, pruned: DataFrame) -> DataFrame:
    """One row: queries and pairs before and after."""
    count = lambda df, tag: df.agg(F.countDistinct("query_id").alias(f"queries_{tag}"), F.count("*").alias(f"pairs_{tag}"))
    return count(qrels, "original").crossJoin(count(pruned, "kept"))  # two single rows


def qrels_maps(qrels: DataFrame) -> DataFrame:
    """(query_id, docs): the judgements of a query as a map; a query has few."""
    pairs = F.sort_array(F.collect_list(F.struct("doc_id", "relevance")))
    return qrels.groupBy("query_id").agg(F.map_from_entries(pairs).alias("docs"))
