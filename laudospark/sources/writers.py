"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.feedback import redact_seed_feedback, redact_seed_jobs, redact_seed_validations
from ..plans.pipeline import result_document

MAX_RECORDS_PER_FILE = 1_000_000


def result_rows(pipeline_rows: DataFrame) -> DataFrame:
    """Rows as stored: id, state, token, type and the result document as JSON text."""
    return pipeline_rows.select(
        "report_id", "status", "message", "patient_token", "exam_type", result_document(pipeline_rows).alias("result_json")
    )


def write_results(pipeline_rows: DataFrame, path: str, mode: str = "error", compact: bool = True) -> None:
    """Parquet by exam type; a frequent type only gets more files, not one big writer.

    ``compact`` lets adaptive execution gather the rows of a type into well-sized partitions and split those of a
    frequent type; without it there is no shuffle, and each task writes a small file per type.
    """
    rows = result_rows(pipeline_rows)
    if compact:
        rows = rows.hint("rebalance", "exam_type")
    writer = rows.write.mode(mode).option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
    writer.partitionBy("exam_type").parquet(path)


def retrain_metadata(rows: DataFrame) -> DataFrame:
    return rows.select("job_id", "filename", "exam_type", "corrections", "image_file")


def export_retrain_set(rows: DataFrame, path: str, mode: str = "error") -> None:
    """Metadata of the retraining set as JSON lines; the files themselves stay where they are."""
    retrain_metadata(rows).write.mode(mode).option("ignoreNullFields", "false").json(path)


def export_seed(
    jobs: DataFrame, validations: DataFrame, feedback: DataFrame, path: str, strict: bool = False, mode: str = "error"
) -> None:
    """Redacted copies of the three state tables."""
    tables = {
        "jobs": redact_seed_jobs(jobs, strict),
        "validations": redact_seed_validations(validations, strict),
        "lexical_feedback": redact_seed_feedback(feedback, strict),
    }
    export_tables(tables, path, mode)


def export_tables(tables: dict[str, DataFrame], path: str, mode: str = "error") -> None:
    """Plain copies of tables, one folder each."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{path}/{name}")
