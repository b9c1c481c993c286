"""Durable intermediate tables.

Executors can be lost at any time, so lineage is cut with Parquet tables in the
folder that the session names in ``spark.checkpoint.dir`` (shared by driver and
executors).  Only where that setting is absent, as in unit tests on one machine,
a folder of this process is used.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def root(spark: SparkSession) -> str:
    """The shared folder for this application's intermediate tables."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="loom-"))
        base = _LOCAL[0]
    return f"{base.rstrip('/')}/loom-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below :func:`root`."""
    return f"{root(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes ``df`` once and returns it as read back: later plans start from files."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._loom_path = path
    return back


def release(*tables: DataFrame) -> None:
    """Deletes tables made by :func:`durable` that no later plan reads."""
    for df in tables:
        if path := getattr(df, "_loom_path", None):
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of this application, wherever the file system is."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
