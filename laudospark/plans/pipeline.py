"""The whole report pipeline as one lazy, shuffle-free chain of projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.classify import exam_label, exam_type_of
from ..functions.entities import extract_entities
from ..functions.header import exam_date, exam_date_as_date, patient_data, patient_token, split_header
from ..functions.redact import strip_pii
from ..functions.regex import compute_once, per_application
from ..functions.text import strip
from ..operators.gates import is_pdf, is_valid_answer, text_snippet
from ..rules import patterns as R


@per_application
def _exam_date(compat: bool) -> Column:
    return exam_date(F.col("header"), F.col("body"), compat=compat)


@per_application
def _safe_body(compat: bool) -> Column:
    return strip_pii(F.col("body"), R.PII_RULES if compat else R.PII_RULES_FIXED)


@per_application
def _entities(compat: bool) -> Column:
    """Entities of completed rows; an empty struct for the others."""
    exam_type = F.when(F.col("status") == "completed", F.col("exam_type"))
    return extract_entities(F.col("safe_body"), exam_type, F.col("__low"), compat)


def split_and_redact(df: DataFrame, compat: bool = True, with_patient_data: bool = False) -> DataFrame:
    """``report_id, filename, text`` plus date, token, redacted body and the quality gate."""
    header = F.col("header")
    columns = {
        "exam_date": _exam_date(compat),
        "patient_token": patient_token(header, F.col("report_id")),
        "raw_text_length": F.length(F.coalesce("text", F.lit(""))),
        "was_raster_engine_used": F.col("is_raster") if "is_raster" in df.columns else ~is_pdf(F.col("filename")),
    }
    if with_patient_data:
        columns["patient_data"] = patient_data(header)
    if not compat:
        columns["exam_date_d"] = exam_date_as_date(columns["exam_date"])
    dated = split_header(df).withColumns(columns)
    return (
        compute_once(dated, "safe_body", _safe_body(compat))
        .drop("header", "body", "text", "is_raster")
        .withColumn("safe_chars", F.length(strip(F.col("safe_body"))))
        .withColumn("low_confidence", F.col("safe_chars") < R.CONFIDENT_MIN_CHARS)
    )


def classify_reports(df: DataFrame, compat: bool = True) -> DataFrame:
    """Add ``exam_type`` and ``exam_label``; texts that failed the gate are not searched."""
    gate = F.col("low_confidence")
    kind = F.when(gate, F.lit(R.UNDEFINED_EXAM)).otherwise(exam_type_of("__low", compat))
    label = F.when(gate, F.lit(R.UNDEFINED_LABEL)).otherwise(exam_label(F.col("exam_type")))
    return compute_once(df.withColumn("__low", F.lower("safe_body")), "exam_type", kind).withColumn("exam_label", label)


def run_pipeline(df: DataFrame, compat: bool = True, with_patient_data: bool = False) -> DataFrame:
    """One result row per report.

    ``df`` holds ``report_id, filename, text`` (and ``is_raster`` when ``route_text`` made the text). With
    a parsed model answer in a column ``analysis``, an answer marked invalid turns the row to
    ``low_confidence``, as does a text that is too short.
    """
    safe = classify_reports(split_and_redact(df, compat, with_patient_data), compat)
    low = F.col("low_confidence")
    if "analysis" in df.columns:
        rejected = ~low & ~is_valid_answer(F.col("analysis"))
    else:
        rejected = F.lit(False)
    message = (
        F.when(low, F.concat(F.lit("Texto insuficiente: "), F.col("safe_chars"), F.lit(" caracteres.")))
        .when(rejected, F.lit("Texto recusado pela análise."))
        .otherwise(F.lit("Processamento finalizado."))
    )
    judged = safe.withColumns(
        {
            "status": F.when(low | rejected, F.lit("low_confidence")).otherwise(F.lit("completed")),
            "message": message,
            "safe_text_snippet": text_snippet(F.col("safe_body"), low),
            "rejected": rejected,
        }
    )
    return judged.withColumn("entities", _entities(compat)).drop("__low", "safe_chars")


def result_document(df: DataFrame) -> Column:
    """The stored JSON text of a pipeline row; NULL for a row the model rejected.

    Only a completed row has ``exam_date``, only a short one ``low_confidence``. Patient data are part of
    it when the pipeline was asked for them.
    """
    common = [c for c in ("patient_token", "patient_data", "exam_type", "exam_label") if c in df.columns]
    rest = ["was_raster_engine_used", "raw_text_length", "safe_text_snippet", F.col("entities").alias("entities_found")]
    analysis = [F.col("analysis").alias("clinical_interpretation")] if "analysis" in df.columns else []
    completed = F.to_json(F.struct(*common, "exam_date", *rest, *analysis))
    short = F.to_json(F.struct(*common, *rest, "low_confidence"))
    return F.when(F.col("low_confidence"), short).when(~F.col("rejected"), completed)
