"""The batch operators on streams.

Each function takes a streaming DataFrame and folders for output and checkpoint, and returns the started
query. The default trigger processes what is there and stops; pass ``processing_time`` to keep running.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..operators.state import enrich_validations, fold_job_events
from ..plans.pipeline import run_pipeline
from ..session import folder_names, remove_folder
from ..sources.writers import result_rows


def _start(writer: DataStreamWriter, checkpoint: str, processing_time: str | None) -> StreamingQuery:
    trigger = {"processingTime": processing_time} if processing_time else {"availableNow": True}
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def stream_reports(
    reports: DataFrame, path: str, checkpoint: str, compat: bool = True, processing_time: str | None = None
) -> StreamingQuery:
    """New reports through the pipeline into a Parquet folder, each exactly once."""
    rows = result_rows(run_pipeline(reports, compat))
    return _start(rows.writeStream.format("parquet").option("path", path), checkpoint, processing_time)


#: Versions after which they are folded into one snapshot.
COMPACT_AFTER = 16


def _entries(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """Numbers of the finished snapshots and versions below a folder."""
    found: dict[str, list[int]] = {"snapshot": [], "version": []}
    for name in folder_names(spark, path):
        kind, _, number = name.partition("=")
        if kind in found and "_SUCCESS" in folder_names(spark, f"{path}/{name}"):
            found[kind].append(int(number))
    return {k: sorted(v) for k, v in found.items()}


def _versions(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The newest snapshot and the versions after it, with their numbers, and how many versions those are."""
    found = _entries(spark, path)
    start = max(found["snapshot"], default=-1)
    later = [v for v in found["version"] if v > start]
    names = ([f"snapshot={start}"] if start >= 0 else []) + [f"version={v}" for v in later]
    parts = [spark.read.parquet(f"{path}/{n}").withColumn("version", F.lit(int(n.partition("=")[2]))) for n in names]
    return reduce(DataFrame.unionByName, parts), len(later)


def _forget(spark: SparkSession, path: str) -> None:
    """Remove what the last snapshot but one covers; readers of the newest one keep what they are reading."""
    found = _entries(spark, path)
    if len(found["snapshot"]) > 1:
        last = found["snapshot"][-2]
        for kind, numbers in found.items():
            for n in numbers:
                if n < last or (kind == "version" and n == last):
                    remove_folder(spark, f"{path}/{kind}={n}")


def _newest(versions: DataFrame, key: str) -> DataFrame:
    columns = [c for c in versions.columns if c not in (key, "version")]
    return versions.groupBy(key).agg(F.max_by(F.struct(*columns), F.col("version")).alias("row")).select(key, "row.*")


def _write_version(path: str, key: str, compact_after: int, make=lambda batch: batch):
    def write(batch: DataFrame, batch_id: int) -> None:
        # A batch that is run again writes the same folder again.
        make(batch).write.mode("overwrite").parquet(f"{path}/version={batch_id}")
        versions, n = _versions(batch.sparkSession, path)
        if n >= compact_after:
            _newest(versions, key).write.mode("overwrite").parquet(f"{path}/snapshot={batch_id}")
            _forget(batch.sparkSession, path)

    return write


def stream_job_state(
    events: DataFrame, path: str, checkpoint: str, processing_time: str | None = None, compact_after: int = COMPACT_AFTER
) -> StreamingQuery:
    """Fold job events into current state. Spark's state store keeps it; a batch writes only changed jobs, and every
    ``compact_after`` batches one snapshot takes the place of the versions before it."""
    write = _write_version(path, "job_id", compact_after)
    return _start(fold_job_events(events).writeStream.outputMode("update").foreachBatch(write), checkpoint, processing_time)


def read_job_state(spark: SparkSession, path: str) -> DataFrame:
    """Newest row per job over the last snapshot and the versions after it."""
    return _newest(_versions(spark, path)[0], "job_id")


def _later(spark: SparkSession, totals: str, batch_id: int, counts: DataFrame) -> DataFrame:
    """Totals of the newest version before the batch, with its counts added."""
    earlier = [v for v in _entries(spark, totals)["version"] if v < batch_id]
    if not earlier:
        return counts
    return spark.read.parquet(f"{totals}/version={earlier[-1]}").unionByName(counts).groupBy("exam_type").agg(F.sum("validations").alias("validations"))


def stream_validations(
    validations: DataFrame,
    jobs: DataFrame | Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    processing_time: str | None = None,
) -> StreamingQuery:
    """New validations with token and exam type of their job, each once, and running counts per exam type.

    ``jobs`` is a table, or a function that gives the jobs' state for a batch, so that each batch is joined to the newest
    one: ``lambda batch: read_job_state(spark, path)``, or ``read_results(spark, path, batch)``, which reads only the
    buckets that the batch needs. Validations without a job, or before its type is known, have NULLs and are not counted.
    A batch writes its own rows to a folder of its own and its counts, added to the totals before it, to another; one
    that is run again writes the same folders again. Nothing is kept in a state store, and nothing that was written
    before is read, but for the totals, a row per exam type.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = jobs(batch) if callable(jobs) else jobs
        rows = f"{path}/rows/batch={batch_id}"
        enrich_validations(batch, state).write.mode("overwrite").parquet(rows)
        known = spark.read.schema(enrich_validations(batch, state).schema).parquet(rows).where("exam_type is not null")
        counts = known.groupBy("exam_type").agg(F.count("*").alias("validations"))
        _later(spark, f"{path}/totals", batch_id, counts).write.mode("overwrite").parquet(f"{path}/totals/version={batch_id}")
        for old in [v for v in _entries(spark, f"{path}/totals")["version"] if v < batch_id - 1]:
            remove_folder(spark, f"{path}/totals/version={old}")

    return _start(validations.writeStream.foreachBatch(write), checkpoint, processing_time)


def read_enriched_validations(spark: SparkSession, path: str) -> DataFrame:
    """All rows that the stream has written."""
    return spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows").drop("batch")


def read_validation_counts(spark: SparkSession, path: str) -> DataFrame:
    """Counts per exam type after the newest batch."""
    last = max(_entries(spark, f"{path}/totals")["version"])
    return spark.read.parquet(f"{path}/totals/version={last}")
