"""Statistics, reports and exports over jobs, validations and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..rules import patterns as R

def validation_totals(validations: DataFrame, jobs: DataFrame) -> DataFrame:
    """``exam_type, validations, wrong, pairs``: counts of validations, of wrong results, and of feedback pairs.

    Validations are counted per job before they meet the jobs: both sides then have one row per key.
    """
    wrong = F.col("is_correct").cast("int") == 0
    per_job = validations.groupBy("job_id").agg(
        F.count("*").alias("n"), F.count_if(wrong).alias("w"), F.count_if(wrong & (F.col("corrections") != "")).alias("p")
    )
    snippet = F.get_json_object("result_json", "$.safe_text_snippet")
    kinds = jobs.select("job_id", "exam_type", F.coalesce(~snippet.isin("", "..."), F.lit(False)).alias("has_snippet"))
    return (
        per_job.join(kinds, "job_id", "left")
        .groupBy("exam_type")
        .agg(F.sum("n").alias("validations"), F.sum("w").alias("wrong"), F.sum(F.when(F.col("has_snippet"), F.col("p")).otherwise(0)).alias("pairs"))
    )


def validations_by_exam(validations: DataFrame, jobs: DataFrame) -> DataFrame:
    """Number of validations per known exam type."""
    return validation_totals(validations, jobs).filter(F.col("exam_type").isNotNull()).select("exam_type", "validations")


def lexical_stats(jobs: DataFrame, validations: DataFrame) -> DataFrame:
    """One row of totals plus a map of validations per exam type; only one-row results are combined."""
    done = jobs.agg(F.count_if(F.col("status") == "completed").alias("total_completed_jobs"))
    known = F.when(F.col("exam_type").isNotNull(), F.struct("exam_type", F.col("validations").alias("n")))
    totals = validation_totals(validations, jobs).agg(
        F.coalesce(F.sum("validations"), F.lit(0)).alias("total_validations"),
        F.coalesce(F.sum("wrong"), F.lit(0)).alias("corrections_submitted"),
        F.coalesce(F.sum("pairs"), F.lit(0)).alias("lexical_feedback_entries"),
        F.map_from_entries(F.array_sort(F.collect_list(known))).alias("validations_by_exam"),
    )
    return done.crossJoin(totals)


def corrections_report(validations: DataFrame, jobs: DataFrame) -> DataFrame:
    """Wrong results with their file name, newest first (``id`` breaks ties)."""
    wrong = validations.filter(F.col("is_correct").cast("int") == 0)
    named = wrong.join(jobs.select("job_id", "filename"), "job_id", "left")
    return named.select("id", "exam_type", "corrections", "validated_at", "filename").orderBy(
        F.desc("validated_at"), F.desc("id")
    )


def feedback_report(feedback: DataFrame, chars: int = R.LISTING_CHARS) -> DataFrame:
    """Feedback pairs cut for display, newest first."""
    return feedback.select(
        "id",
        "exam_type",
        F.substring("original_text", 1, chars).alias("original_text"),
        F.substring("corrected_text", 1, chars).alias("corrected_text"),
        "created_at",
    ).orderBy(F.desc("created_at"), F.desc("id"))


def job_listing(jobs: DataFrame) -> DataFrame:
    columns = ["job_id", "filename", "exam_type", "status", "patient_token", "created_at"]
    return jobs.select(*columns).orderBy(F.desc("created_at"), F.desc("job_id"))


def validation_listing(validations: DataFrame) -> DataFrame:
    tag = F.when(F.col("is_correct").cast("int") != 0, F.lit("CORRETO")).otherwise(F.lit("CORRIGIDO"))
    columns = ["id", "job_id", "exam_type", tag.alias("tag"), "corrections", "validated_at"]
    return validations.select(*columns).orderBy(F.desc("validated_at"), F.desc("id"))


def retrain_set(jobs: DataFrame, validations: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One row per validation of a job whose last validation found errors and whose file is kept.

    ``jobs`` holds ``validation_status``; the exam type is the validation's own, if it has one, else the job's. With ``files`` (a listing with ``path``) only rows whose file
    is there remain; ``retrain_missing`` gives the others.
    """
    wanted = jobs.filter(
        (F.col("validation_status") == "validated_with_errors") & F.col("file_path").isNotNull()
    ).select("job_id", "filename", "file_path", "exam_type")
    if files is not None:
        wanted = wanted.join(files.select(F.col("path").alias("file_path")), "file_path", "left_semi")
    own = "exam_type" in validations.columns
    marks = validations.select("id", "job_id", "corrections", *(["exam_type"] if own else []))
    return marks.join(wanted.drop("exam_type") if own else wanted, "job_id").select(
        "id",
        "job_id",
        "filename",
        "exam_type",
        "corrections",
        "file_path",
        F.element_at(F.split("file_path", r"[/\\]"), -1).alias("image_file"),
    )


def retrain_missing(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Jobs wanted for retraining whose file is gone."""
    wanted = jobs.filter(
        (F.col("validation_status") == "validated_with_errors") & F.col("file_path").isNotNull()
    )
    return wanted.join(files.select(F.col("path").alias("file_path")), "file_path", "left_anti").select(
        "job_id", "file_path"
    )


def redact_seed_jobs(jobs: DataFrame, strict: bool = False) -> DataFrame:
    """Jobs without result and file name; ``strict`` also drops path and message."""
    columns = {"result_json": F.lit(None).cast("string"), "filename": F.lit(R.REDACTED)}
    if strict:
        columns |= {c: F.lit(None).cast("string") for c in ("file_path", "message") if c in jobs.columns}
    return jobs.withColumns(columns)


def redact_seed_feedback(feedback: DataFrame, strict: bool = False) -> DataFrame:
    """Feedback whose long original texts are hidden; ``strict`` hides all texts."""
    text = F.col("original_text")
    long = F.lit(True) if strict else F.coalesce(F.length(text) > R.SEED_TEXT_CHARS, F.lit(False))
    out = feedback.withColumn("original_text", F.when(long, F.lit(R.REDACTED)).otherwise(text))
    return out.withColumn("corrected_text", F.lit(R.REDACTED)) if strict else out


def redact_seed_validations(validations: DataFrame, strict: bool = False) -> DataFrame:
    """Validations as they are; ``strict`` drops the free-text corrections."""
    return validations.withColumn("corrections", F.lit(None).cast("string")) if strict else validations


def classification_eval(df: DataFrame, expected: str = "expected", predicted: str = "exam_type") -> DataFrame:
    """Confusion counts of expected against predicted types."""
    return df.groupBy(expected, predicted).agg(F.count("*").alias("reports"))


def classification_accuracy(confusion: DataFrame, expected: str = "expected", predicted: str = "exam_type") -> DataFrame:
    """Reports, hits and accuracy over a confusion table."""
    hits = F.sum(F.when(F.col(expected) == F.col(predicted), F.col("reports")).otherwise(F.lit(0)))
    return confusion.agg(F.sum("reports").alias("reports"), hits.alias("hits")).withColumn(
        "accuracy", F.col("hits") / F.col("reports")
    )


def patients_with_history(reports: DataFrame, min_reports: int = 1) -> DataFrame:
    """Per token: number of reports, exam types, first and last exam date."""
    known_date = F.when(F.col("exam_date") != "", F.col("exam_date"))
    return (
        reports.groupBy("patient_token")
        .agg(
            F.count("*").alias("reports"),
            F.array_sort(F.collect_set("exam_type")).alias("exam_types"),
            F.min(known_date).alias("first_exam"),
            F.max(known_date).alias("last_exam"),
        )
        .filter(F.col("reports") >= min_reports)
    )


#: Logarithm of the number of cells of a sketch: a standard error of 1.6 per cent.
SKETCH_BITS = 12


def token_sketches(reports: DataFrame, by: tuple[str, ...] = ("exam_type", "exam_month")) -> DataFrame:
    """Per group: number of reports and a sketch of its distinct patient tokens, to be stored and merged later."""
    return reports.groupBy(*by).agg(F.count("*").alias("reports"), F.hll_sketch_agg("patient_token", SKETCH_BITS).alias("sketch"))


def merge_sketches(sketches: DataFrame, *by: str) -> DataFrame:
    """Sketches of larger groups, or of all with none named, from those of smaller ones; no report is read again."""
    return sketches.groupBy(*by).agg(F.sum("reports").alias("reports"), F.hll_union_agg("sketch").alias("sketch"))


def sketch_estimate(sketch: Column) -> Column:
    """Estimated number of distinct tokens; within 5 per cent in 998 of 1000 sketches."""
    return F.hll_sketch_estimate(sketch)


def distinct_tokens(reports: DataFrame, by: tuple[str, ...] = ("exam_type", "exam_month")) -> DataFrame:
    """Exact reports and distinct tokens per group, and per every shorter prefix of ``by``, whose other columns are NULL."""
    once = reports.groupBy(*by, "patient_token").agg(F.count("*").alias("n"))
    return once.rollup(*by).agg(F.sum("n").alias("reports"), F.count_distinct("patient_token").alias("tokens"))


# ------------------------------------------------------------------ statistics that are kept, not counted again

STATS = "exam_type string, validations long, wrong long, pairs long, completed long"


def validation_changes(validations: DataFrame, jobs: DataFrame) -> DataFrame:
    """What a batch of new validations adds to the statistics, a row per exam type."""
    return validation_totals(validations, jobs).withColumn("completed", F.lit(0).cast("long"))


def completed_changes(after: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """What a batch of changed jobs adds to the number of completed ones; ``before`` has their rows before the batch."""
    count = lambda jobs: jobs.agg(F.count_if(F.col("status") == "completed").alias("n"))
    parts = count(after) if before is None else count(after).unionByName(count(before).select((-F.col("n")).alias("n")))
    zero = F.lit(0).cast("long")
    return parts.agg(F.sum("n").alias("completed")).select(
        F.lit(None).cast("string").alias("exam_type"), zero.alias("validations"), zero.alias("wrong"), zero.alias("pairs"), "completed"
    )


def merge_stats(changes: DataFrame) -> DataFrame:
    """Changes of several batches as one row per exam type."""
    sums = [F.sum(c).alias(c) for c in ("validations", "wrong", "pairs", "completed")]
    return changes.groupBy("exam_type").agg(*sums)


def stats_row(changes: DataFrame) -> DataFrame:
    """The row of ``lexical_stats`` from merged changes."""
    known = F.when(F.col("exam_type").isNotNull() & (F.col("validations") > 0), F.struct("exam_type", F.col("validations").alias("n")))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return merge_stats(changes).agg(
        total("completed").alias("total_completed_jobs"),
        total("validations").alias("total_validations"),
        total("wrong").alias("corrections_submitted"),
        total("pairs").alias("lexical_feedback_entries"),
        F.map_from_entries(F.array_sort(F.collect_list(known))).alias("validations_by_exam"),
    )
