"""Distributions of lengths and judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def judgements_per_query(judgements: DataFrame, query: str = "id") -> DataFrame:
    """(query_id, judgements): rows of each query; null ids don't count."""
    return judgements.where(F.col(query).isNotNull()).groupBy(F.col(query).cast("string").alias("query_id")).agg(F.count("*").alias("judgements"))


def histogram(df: DataFrame, value: str) -> DataFrame:
    """(value, n, percent): how often each value occurs, and its share of all. Nulls don't count. There are few values."""
    counted = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    return counted.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


def summary(df: DataFrame, value: str, shares: tuple[float, ...] = (0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """One row: n, least, greatest, mean, median, std (of the whole population) and percentiles by linear interpolation.

    Exact percentiles are of a column of few different values: their counts are what is shuffled. Null without rows.
    """
    x = F.col(value).cast("double")
    points = F.percentile(x, F.array(*[F.lit(s) for s in (0.5, *shares)]))
    out = df.agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_pop(x), 6).alias("std"), points.alias("__p"))
    return out.select("n", "least", "greatest", "mean", "std", F.round(F.col("__p")[0], 6).alias("median"), *(F.round(F.col("__p")[i], 6).alias(f"p{round(100 * s)}") for i, s in enumerate(shares, 1)))


def log_histogram(df: DataFrame, value: str, bins: int = 79) -> DataFrame:
    """(bin, n): counts in ``bins`` bins of equal width in the logarithm, from 1 to one above the greatest value, numbered from
    1. Values below 1 fall outside and don't count. An empty table has no bins."""
    rows = df.where(F.col(value) >= 1)
    top = rows.agg(F.max(value).alias("__top"))
    # The greatest value is below the last edge, so no value falls on it.
    place = F.floor(F.log10(value) / F.log10(F.col("__top") + 1) * bins).cast("int") + 1
    return rows.crossJoin(F.broadcast(top)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))  # one row


def random_row(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """One row, the same for the same seed: the one of smallest hash of key and seed."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key)).limit(1)


def show_query(query_id: str, queries: DataFrame, qrels: DataFrame, docs: DataFrame, size: int = 200) -> DataFrame:
    """(query_id, query, doc_id, shown): a query with the beginnings of its relevant documents. The point filter reaches the scans."""
    from rankloom.functions.text import snippet

    one = qrels.where((F.col("query_id") == query_id) & (F.col("relevance") > 0)).select("query_id", "doc_id")
    return one.join(queries.where(F.col("query_id") == query_id).select("query_id", F.col("text").alias("query")), "query_id").join(docs, "doc_id").select("query_id", "query", "doc_id", snippet(F.col("full_text"), size).alias("shown"))
