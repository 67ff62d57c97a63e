"""Job state from events, and validations joined to it.

Event and validation tables carry a monotone ``seq``/``id``: timestamps of one second resolution tie.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..rules import patterns as R
from .joins import shuffle_partitions

KEPT_WHEN_NULL = ("result_json", "patient_token", "exam_type")
#: Columns of a job's first event that later ones do not change.
KEPT_FROM_FIRST = ("filename", "file_path", "created_at")


def insert_or_ignore(new: DataFrame, existing: DataFrame | None = None, key: str = "job_id", order: str = "seq") -> DataFrame:
    """First row per key that is not there yet.

    ``min_by`` over a struct combines within each task before the shuffle; a window would bring all rows
    of a repeated key to one task.
    """
    rest = [c for c in new.columns if c != key]
    first = new.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("row")).select(key, "row.*")
    return first if existing is None else first.join(existing.select(key), key, "left_anti")


def fold_job_events(events: DataFrame, key: str = "job_id", order: str = "seq") -> DataFrame:
    """Current state per job: the last status and message, the last non-null result, token and type.

    An empty result document (``{}``) counts as no result. Where events carry them, file name, path and creation time
    are those of the first event that has them, and ``updated_at`` is the time of the last event (``at``); so the
    result has all columns of a jobs table.
    """
    result = F.when(F.trim("result_json") != "{}", F.col("result_json"))
    source = events.withColumn("result_json", result)

    def last_known(name: str) -> Column:
        return F.max_by(F.col(name), F.when(F.col(name).isNotNull(), F.col(order))).alias(name)

    return source.groupBy(key).agg(
        F.max(order).alias(order),
        F.max_by("status", order).alias("status"),
        F.max_by("message", order).alias("message"),
        *[last_known(c) for c in KEPT_WHEN_NULL],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in KEPT_FROM_FIRST if c in events.columns],
        *[F.max("at").alias("updated_at") for c in ["at"] if c in events.columns],
    )


def merge_state(state: DataFrame, batch: DataFrame, key: str = "job_id", order: str = "seq") -> DataFrame:
    """Fold a batch of events into an earlier state; the state row is one more event."""
    columns = [key, order, "status", "message", *KEPT_WHEN_NULL, *[c for c in KEPT_FROM_FIRST if c in batch.columns]]
    timed = "at" in batch.columns
    earlier = state.select(*columns, *([F.col("updated_at").alias("at")] if timed else []))
    return fold_job_events(earlier.unionByName(batch.select(*columns, *(["at"] if timed else []))), key, order)


def validation_status(jobs: DataFrame, validations: DataFrame) -> DataFrame:
    """Jobs with ``validation_status``: the last validation decides, none means pending."""
    last = validations.groupBy("job_id").agg(F.max_by("is_correct", "id").alias("__ok"))
    ok = F.col("__ok").cast("int")
    status = (
        F.when(ok == 1, F.lit("validated_ok"))
        .when(ok == 0, F.lit("validated_with_errors"))
        .otherwise(F.lit("pending_validation"))
    )
    return jobs.join(last, "job_id", "left").withColumn("validation_status", status).drop("__ok")


def enrich_validations(validations: DataFrame, jobs: DataFrame) -> DataFrame:
    """Validations with the token and exam type of their job; NULL where there is no such job.

    Jobs are unique, so adaptive execution can split the validations of a frequent job.
    """
    return validations.join(jobs.select("job_id", "patient_token", "exam_type"), "job_id", "left")


def in_ranges(rows: DataFrame, at: str, ranges: int, name: str = "__range") -> DataFrame:
    """Add the number of the range of ``at`` that a row is in; ranges hold about as many rows each."""
    inner = [i / ranges for i in range(1, ranges)]
    found = rows.select(F.percentile_approx(F.col(at).cast("double"), inner, 20 * ranges)).first()[0] if inner else None
    splits = sorted(set(found or []))
    if not splits:
        return rows.withColumn(name, F.lit(0.0))
    bucketizer = Bucketizer(splits=[float("-inf"), *splits, float("inf")], inputCol="__at_double", outputCol=name)
    return bucketizer.transform(rows.withColumn("__at_double", F.col(at).cast("double"))).drop("__at_double")


def enrich_validations_as_of(validations: DataFrame, events: DataFrame, at: str = "seq", ranges: int | None = None) -> DataFrame:
    """Validations with the token and exam type their job had when they were made; NULL before the job's first event.

    ``validations`` carry in ``at`` the number of the last event before them. A scan that is split by ranges of event
    numbers, as many as shuffle partitions if not given: within a task each (job, range) keeps its last known values; per
    job these few rows are carried on from range to range; then events and the distinct points asked for go through one
    window per (job, range). So a job that holds a third of all events is spread over all ranges, and validations made at
    one point are one row until the answers are joined back. Without a job or number the answer is NULL.
    """
    known = ("patient_token", "exam_type")
    ranges = ranges or max(2, shuffle_partitions(events))
    points = validations.select("job_id", F.col(at).cast("long").alias("__at")).where("job_id is not null and __at is not null").distinct()
    empty = [F.lit(None).cast(events.schema[c].dataType).alias(c) for c in known]
    told = events.select("job_id", F.col("seq").cast("long").alias("__at"), F.lit(0).alias("__asks"), *known)
    rows = in_ranges(told.unionByName(points.select("job_id", "__at", F.lit(1).alias("__asks"), *empty)), "__at", ranges)
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__at"))).alias(c) for c in known]
    held = rows.groupBy("job_id", "__range").agg(*last)
    before = Window.partitionBy("job_id").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = held.select("job_id", "__range", *[F.last(c, ignorenulls=True).over(before).alias(f"__{c}") for c in known])
    so_far = Window.partitionBy("job_id", "__range").orderBy("__at", "__asks").rowsBetween(Window.unboundedPreceding, 0)
    answers = rows.join(carried, ["job_id", "__range"]).select(
        "job_id", "__at", "__asks", *[F.coalesce(F.last(c, ignorenulls=True).over(so_far), F.col(f"__{c}")).alias(c) for c in known]
    )
    answers = answers.where("__asks = 1").drop("__asks")
    asked = validations.withColumn("__at", F.col(at).cast("long"))
    columns = [F.col(c) for c in validations.columns]
    return asked.join(answers, ["job_id", "__at"], "left").select(*columns, *known)


def lexical_feedback(validations: DataFrame, jobs: DataFrame) -> DataFrame:
    """Text pairs for the lexicon: a correction of a wrong result whose snippet is not empty."""
    wrong = validations.filter((F.col("is_correct").cast("int") == 0) & (F.col("corrections") != ""))
    with_result = jobs.filter(F.col("result_json").isNotNull()).select(
        "job_id", "exam_type", F.get_json_object("result_json", "$.safe_text_snippet").alias("__snippet")
    )
    pairs = wrong.join(with_result.filter(~F.col("__snippet").isin("", "...")), "job_id")
    return pairs.select(
        "id",
        "exam_type",
        F.substring("__snippet", 1, R.FEEDBACK_CHARS).alias("original_text"),
        F.substring("corrections", 1, R.FEEDBACK_CHARS).alias("corrected_text"),
        F.col("job_id").alias("source_job_id"),
        F.col("validated_at").alias("created_at"),
    )


def job_results(jobs: DataFrame, schema: str) -> DataFrame:
    """Jobs with ``result_json`` decoded to a struct ``result``; NULL when there is none."""
    has_text = F.col("result_json") != ""
    return jobs.withColumn("result", F.when(has_text, F.from_json("result_json", schema))).drop("result_json")
