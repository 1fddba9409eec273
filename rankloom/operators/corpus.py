"""Preparation of the corpus: formatting, counting, filtering, fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.text import full_text, word_count


def normalize_corpus(df: DataFrame) -> DataFrame:
    """``df`` with docid, title and text as strings; a missing title or text column is added as null, docid is needed."""
    if "docid" not in df.columns:
        raise ValueError("the corpus needs a docid column")
    for name in ("title", "text"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    return df.withColumns({n: F.col(n).cast("string") for n in ("docid", "title", "text")})


def format_and_count(df: DataFrame) -> DataFrame:
    """Adds ``full_text`` and ``word_count`` (counted afresh), replacing columns of these names. One codegen stage, no UDF.

    Null titles and texts count as empty; the counts of null, empty and blank texts are 0; repeated rows stay.
    """
    out = normalize_corpus(df).withColumn("full_text", full_text(F.col("title"), F.col("text")))
    return out.withColumn("word_count", word_count(F.col("full_text")))


def filter_by_words(df: DataFrame, max_words: int | None, column: str = "word_count") -> DataFrame:
    """Rows of at most ``max_words`` words; all rows if that is None."""
    return df if max_words is None else df.where(F.col(column) <= max_words)


def kept_report(df: DataFrame, max_words: int, column: str = "word_count") -> DataFrame:
    """One row: how many rows there are, how many the filter keeps, and the percentage (null without rows)."""
    kept = F.count(F.when(F.col(column) <= max_words, 1))
    return df.agg(F.count("*").alias("original"), kept.alias("kept"), F.round(F.try_divide(kept * 100.0, F.count("*")), 4).alias("kept_percent"))


def latest_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in ``order``. Each task keeps one row of a key before the shuffle, so hot keys are cheap.
    Rows with a null key are dropped."""
    sound = df
    for k in keys:
        sound = sound.where(F.col(k).isNotNull())
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return sound.withColumn("__place", place).where(F.col("__place") == 1).drop("__place")


def doc_lookup(df: DataFrame) -> DataFrame:
    """(doc_id, full_text, word_count), one row for each docid: the one loaded last, of these the longest text."""
    counted = format_and_count(df).select(F.col("docid").alias("doc_id"), "full_text", "word_count", "loaded_at")
    order = [F.desc_nulls_last("loaded_at"), F.desc("word_count"), F.desc("full_text")]
    return latest_rows(counted, ["doc_id"], order).drop("loaded_at")


def fingerprint(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row (rows, mark) that changes when keys or values do; nothing about the order of rows."""
    return df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(F.col(key), F.col(value)).cast("decimal(38,0)")).alias("mark"))
