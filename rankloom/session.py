"""Session helpers: builder for local work, checkpointing that survives executor loss, shipping the package."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def build_session(name: str = "rankloom", cores: str | int = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the bench use; a cluster passes its own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Make the package importable in the Python workers of every executor, once per application.

    The archive is served by the driver, so executors need no common file system and no matching PYTHONPATH.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    handle, path = tempfile.mkstemp(prefix="rankloom-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, Path(root.name) / file.relative_to(root))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` read back from a reliable checkpoint, so that a lost executor costs no recomputation of what came before.

    The folder is the one in ``spark.checkpoint.dir``. Only where that is unset and the master is local (tests) a
    temporary folder is used, which goes with the process; on a cluster a missing setting is an error, since a machine-local
    folder would not do. With ``spark.cleaner.referenceTracking.cleanCheckpoints``, which ``build_session`` sets, Spark deletes a
    checkpoint when nothing refers to it any more.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="rankloom-checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a DataFrame, handed over as Arrow, without a Python task."""
    fields = [f.rsplit(" ", 1) for f in schema.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}
    columns = [pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)]
    return spark.createDataFrame(pa.table(columns, names=[name for name, _ in fields]))


def shuffle_partitions(spark: SparkSession) -> int:
    """Partitions of a shuffle whose rows are few but costly, and which adaptive coalescing should therefore leave alone."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
