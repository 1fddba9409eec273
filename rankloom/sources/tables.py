"""Readers of the Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Table ``name`` of ``folder``; with ``columns``, only those, so that the scan reads no others."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df
