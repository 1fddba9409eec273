"""Stored tables: runs by model, completeness, checkpoints of resumable jobs, guards against a changed corpus.

A written directory is complete when its success marker is there; the file output committer makes a write all or nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators.corpus import fingerprint


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on any file system that Spark knows."""
    fs, p = _path(spark, path)
    return bool(fs.exists(p))


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    return exists(spark, f"{path}/_SUCCESS")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table or folder, if it is there."""
    fs, p = _path(spark, path)
    fs.delete(p, True)


def partition_path(root: str, **parts: object) -> str:
    """The folder of one configuration: a level ``name=value`` for each part in their order, as Spark reads partition columns.
    A part that is None is written as Hive's name of null."""
    levels = [f"{name}={quote(str(value), safe='') if value is not None else '__HIVE_DEFAULT_PARTITION__'}" for name, value in parts.items()]
    return "/".join([root.rstrip("/"), *levels])


def fusion_name(method: str, aliases: Sequence[str]) -> str:
    """Name of a fused first stage: its method and its runs."""
    return "_".join((method, "+".join(aliases)))


def save_run(run: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Writes runs, each model to its own partition."""
    run.write.mode(mode).partitionBy("model").parquet(path)


def load_runs(spark: SparkSession, path: str, models: Sequence[str] | None = None, aliases: dict[str, str] | None = None) -> DataFrame:
    """Stored runs, only the partitions of ``models`` if given, renamed by ``aliases``."""
    run = spark.read.schema("query_id string, doc_id string, score double, rank int, model string").parquet(path)
    if models is not None:
        run = run.where(F.col("model").isin(list(models)))
    if aliases:
        pairs = F.create_map(*[F.lit(x) for item in aliases.items() for x in item])
        run = run.withColumn("model", F.coalesce(pairs[F.col("model")], F.col("model")))
    return run.select("model", "query_id", "doc_id", "score", "rank")


def materialize(spark: SparkSession, path: str, build: Callable[[], DataFrame], partition_by: Sequence[str] = ()) -> DataFrame:
    """The table at ``path`` if it is complete; else what ``build`` gives, written there first."""
    if not is_complete(spark, path):
        build().write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return spark.read.parquet(path)


def load_or_fail(spark: SparkSession, path: str, build: Callable[[], DataFrame] | None) -> DataFrame:
    """Like ``materialize``, but without ``build`` a missing table is an error."""
    if build is None and not is_complete(spark, path):
        raise RuntimeError(f"{path} is not complete and nothing was given to build it from")
    return materialize(spark, path, build)


def save_checkpoint(results: DataFrame, path: str, shard: str) -> None:
    """Writes one shard's finished queries to a folder of its own, whose success marker tells that it is whole."""
    results.write.mode("overwrite").parquet(partition_path(path, shard=shard))


def load_checkpoint(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Finished queries of all whole shards; empty if there are none yet."""
    fs, p = _path(spark, path)
    shards = sorted(str(x.getPath()) for x in fs.listStatus(p)) if fs.exists(p) else []
    whole = [x for x in shards if is_complete(spark, x)]
    return spark.read.schema(schema).parquet(*whole) if whole else spark.createDataFrame([], schema)


def resume(spark: SparkSession, work: DataFrame, path: str, schema: str, job: Callable[[DataFrame], DataFrame], shards: int = 4, key: str = "query_id") -> DataFrame:
    """Runs ``job`` over the rows of ``work`` shard by shard, and gives all results.

    Each shard is written when it is done, so a job that was killed goes on behind its last whole shard; whole shards are not
    planned again, and what a killed shard left is overwritten.
    """
    for n in range(shards):
        if not is_complete(spark, partition_path(path, shard=n)):
            save_checkpoint(job(work.where(F.pmod(F.xxhash64(key), F.lit(shards)) == n)), path, str(n))
    return load_checkpoint(spark, path, schema)


def guard(spark: SparkSession, df: DataFrame, key: str, value: str, path: str) -> None:
    """Stores the table's fingerprint at the first call; raises at a later one if the table has changed since."""
    now = fingerprint(df, key, value)
    if not is_complete(spark, path):
        now.write.mode("overwrite").parquet(path)
        return
    if now.exceptAll(spark.read.schema(now.schema).parquet(path)).count():
        raise RuntimeError(f"the data has changed since {path} was written")


def status(spark: SparkSession, paths: dict[str, str]) -> dict[str, bool]:
    """Which tables of a pipeline are complete: what is left to be made."""
    return {name: is_complete(spark, path) for name, path in paths.items()}
