"""A table with one row per job that batches update by key.

Rows lie in buckets of the key's hash, one Parquet folder each. A batch reads and rewrites only the buckets its keys fall
into: it is folded, merged with them (status and message are the batch's, a null result, token or type keeps the old one),
and takes their place by dynamic partition overwrite. The merged rows are written aside first. If a run is lost while it
replaces buckets, the next update, or
``finish_update``, does it from the rows aside, so no bucket stays half replaced; until then reading is an error. Running a
batch again changes nothing. There is one writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.state import fold_job_events, merge_state
from ..session import folder_names, remove_folder

BUCKETS = 64
_PENDING = "_pending"


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def _buckets(spark: SparkSession, path: str) -> int | None:
    """How many buckets the table has, None if there is no table."""
    found = [int(n.partition("=")[2]) for n in folder_names(spark, path) if n.startswith("of=")]
    return found[0] if found else None


def _replace(spark: SparkSession, path: str, buckets: int) -> None:
    """Put rows that were written aside in the place of their buckets."""
    aside = f"{path}/{_PENDING}"
    names = folder_names(spark, aside)
    if "_SUCCESS" in names:
        rows = spark.read.parquet(aside)
        writer = rows.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("bucket").parquet(f"{path}/of={buckets}")
    if names:
        remove_folder(spark, aside)


def _rows(spark: SparkSession, path: str, buckets: int, only: list[int] | None = None) -> DataFrame | None:
    folder = f"{path}/of={buckets}"
    there = {int(n.partition("=")[2]) for n in folder_names(spark, folder) if n.startswith("bucket=")}
    wanted = sorted(there if only is None else there & set(only))
    if not wanted:
        return None
    return spark.read.option("basePath", folder).parquet(*[f"{folder}/bucket={b}" for b in wanted])


def update_results(batch: DataFrame, path: str, key: str = "job_id", order: str = "seq", buckets: int = BUCKETS) -> int:
    """Merge a batch of events into the table below ``path``; returns how many buckets were rewritten.

    ``batch`` has the columns of job events and may hold a key more than once. Batches come in ``order``: a row already
    there counts as older than any row of the batch with a larger number. Choose ``buckets`` once, so that one is some
    hundred megabytes; a table with another number is an error.
    """
    spark = batch.sparkSession
    known = _buckets(spark, path)
    if known not in (None, buckets):
        raise ValueError(f"the table has {known} buckets, not {buckets}")
    _replace(spark, path, buckets)
    folded = fold_job_events(batch, key, order).withColumn("bucket", _bucket(key, buckets))
    touched = sorted(r["bucket"] for r in folded.select("bucket").distinct().collect())  # as many as buckets at most
    if not touched:
        return 0
    old = _rows(spark, path, buckets, touched)
    merged = fold_job_events(batch, key, order) if old is None else merge_state(old.drop("bucket"), batch, key, order)
    merged.withColumn("bucket", _bucket(key, buckets)).write.mode("overwrite").parquet(f"{path}/{_PENDING}")
    _replace(spark, path, buckets)
    return len(touched)


def read_results(spark: SparkSession, path: str, keys: DataFrame | None = None, key: str = "job_id") -> DataFrame:
    """The table's rows; with ``keys``, only buckets into which one of them falls are read, and only such rows returned."""
    buckets = _buckets(spark, path)
    if _PENDING in folder_names(spark, path):
        raise ValueError("a batch is being put in place; run update_results again, or finish_update")
    if buckets is None:
        raise ValueError(f"no table below {path}")
    only = None
    if keys is not None:
        wanted = keys.select(key).distinct()
        only = [r["bucket"] for r in wanted.select(_bucket(key, buckets).alias("bucket")).distinct().collect()]
    rows = _rows(spark, path, buckets, only)
    if rows is None:
        rows = _rows(spark, path, buckets).where("false")
    rows = rows.drop("bucket")
    return rows if keys is None else rows.join(wanted, key, "left_semi")


def finish_update(spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
    """Finish a batch whose run was lost while it replaced buckets."""
    _replace(spark, path, _buckets(spark, path) or buckets)
