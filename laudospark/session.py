"""A Spark session with the settings the library is written for."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app_name: str = "laudospark", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew handling. Sizes are left to the cluster unless passed in."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # HotSpot never compiles a method above 8000 bytes of code; the rule projections would run interpreted.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables, below the shared folder that ``spark.checkpoint.dir`` names.

    Only a local session, whose driver is its executor, may go without one; it then gets a temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="laudospark-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate tables, on whatever file system it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder, none if it is not there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in system.listStatus(where)) if system.exists(where) else []


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the files of shuffles that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
