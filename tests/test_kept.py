"""Batches of even size, drift of documents, uploads taken once, sketches, and statistics that are kept."""

import json
import random

import pytest
from pyspark.sql import functions as F

from laudospark.operators import cases, feedback as FB, prompts as PR
from laudospark.sources import readers, stats
from test_state import tables


@pytest.mark.parametrize("limit", [50, 400, 100_000])
def test_batches_are_even_and_never_too_long(spark, limit):
    rnd = random.Random(limit)
    rows = [(i, "p" * rnd.choice([0, 1, 7, 20, rnd.randrange(1, 40), limit // 2 + 1 if i % 50 == 0 else 5])) for i in range(900)]
    rows += [(900, None), (901, "x" * (3 * limit)), (902, "y" * limit)]
    df = spark.createDataFrame(rows, "report_id long, prompt string")
    got = PR.batch_prompts(df.repartition(5), limit)
    assert got.columns == ["report_id", "prompt", "batch"]
    batches = {}
    for r in got.collect():
        batches.setdefault(r.batch, []).append(len(r.prompt or ""))
    assert sum(map(len, batches.values())) == len(rows)
    assert all(sum(b) <= limit or len(b) == 1 for b in batches.values())
    alone = sorted(k for k in batches if k < 0)
    assert alone == list(range(-len(alone), 0)) and all(len(batches[k]) == 1 and 2 * batches[k][0] > limit for k in alone)
    even = [sum(b) for k, b in batches.items() if k >= 0]
    longest = max(x for k, b in batches.items() if k >= 0 for x in b)
    assert sorted(k for k in batches if k >= 0) == list(range(len(even)))  # no number is left out
    full = sorted(sum(batches[k]) for k in range(len(even) - 1))
    assert not full or full[0] >= limit - 2 * longest
    again = {(r.report_id, r.batch) for r in PR.batch_prompts(df.repartition(2), limit).collect()}
    assert again == {(r.report_id, r.batch) for r in got.collect()}
    assert PR.batch_prompts(df.where("false"), limit).count() == 0


def test_drift_report_counts_documents_per_path_and_kind(spark):
    docs = [
        {"a": 1, "b": {"c": [1, "x", {"d": None}], "e": True}},
        {"a": "1", "b": {"c": [2, 3], "e": 2.5}},
        {"a": None, "b": "text"},
        [{"a": 5}, {"a": 6}],
    ]
    answers = [f"```json\n{json.dumps(d)}\n```" for d in docs] + ["no fence", None, "```json\n{broken\n```"]
    got = cases.drift_report(spark.createDataFrame([(a,) for a in answers], "answer string").repartition(3))
    assert {(r.path, r.kind): r.documents for r in got.collect()} == {
        ("$", "object"): 3, ("$", "array"): 1, ("$", "absent"): 2, ("$", "unreadable"): 1,
        ("$.a", "number"): 1, ("$.a", "string"): 1, ("$.a", "null"): 1,
        ("$.b", "object"): 2, ("$.b", "string"): 1, ("$.b.c", "array"): 2, ("$.b.c[]", "number"): 2, ("$.b.c[]", "string"): 1,
        ("$.b.c[]", "object"): 1, ("$.b.c[].d", "null"): 1, ("$.b.e", "boolean"): 1, ("$.b.e", "number"): 1,
        ("$[]", "object"): 1, ("$[].a", "number"): 1,
    }
    assert cases.drift_report(spark.createDataFrame([], "answer string")).collect() == []
    texts = ['{"a": "}}{[", "b": [[1], {"c": "\\\\\\""}]}', "1", "[]", '{"x": {"y": {"z": []}}}']
    depths = spark.createDataFrame([(t,) for t in texts], "j string").select(cases.nesting(F.col("j")).alias("n"))
    assert [r.n for r in depths.collect()] == [3, 0, 1, 4]
    merged = cases.answer_schema(spark.createDataFrame([(a,) for a in answers[:2]], "answer string"))
    assert merged.startswith("OBJECT<a: VARIANT, b: OBJECT<c: ARRAY<VARIANT>")
    assert [tuple(r) for r in cases.drift_report(spark.createDataFrame([("x",)], "answer string")).collect()] == [("$", "absent", 1)]


def test_drift_report_shuffles_counts_only(spark):
    plan = cases.drift_report(spark.createDataFrame([('```json\n{"a": 1}\n```',)], "answer string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_count" in plan


def test_uploads_are_taken_once(spark, tmp_path):
    up, manifest = tmp_path / "up", str(tmp_path / "manifest")
    up.mkdir()
    (up / "a [1].txt").write_text("um")
    (up / "b*{x}.txt").write_text("dois")

    def run(commit=True):
        intake = readers.read_new_reports(spark, str(up), manifest, "text")
        rows = [] if intake.reports is None else sorted(r.text for r in intake.reports.collect())
        if commit:
            intake.commit()
        return rows

    assert run(commit=False) == ["dois", "um"]  # nothing is entered before the rows are stored
    assert run() == ["dois", "um"]
    assert run() == []
    (up / "c.txt").write_text("tres")
    assert run() == ["tres"]
    (up / "a [1].txt").write_text("um, corrigido")
    assert run() == ["um, corrigido"] and run() == []


def test_new_files_are_told_from_metadata(spark, tmp_path):
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "a.txt").write_text("um")
    plan = readers.new_files(readers.read_uploads(spark, str(tmp_path / "up")), None)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_sketches_merge_within_their_bound(spark):
    rows = spark.range(60_000).select(
        F.concat(F.lit("t"), (F.col("id") * 7919 % 21_000).cast("string")).alias("patient_token"),
        F.element_at(F.array(F.lit("a"), F.lit("b")), (F.col("id") % 2 + 1).cast("int")).alias("exam_type"),
        F.concat(F.lit("2024-"), (F.col("id") % 6).cast("string")).alias("exam_month"),
    )
    months = FB.token_sketches(rows)
    exact = {(r.exam_type, r.exam_month): (r.reports, r.tokens) for r in FB.distinct_tokens(rows).collect()}
    levels = [(months, ("exam_type", "exam_month")), (FB.merge_sketches(months, "exam_type"), ("exam_type",)), (FB.merge_sketches(FB.merge_sketches(months, "exam_type")), ())]
    seen = 0
    for sketches, by in levels:
        for r in sketches.withColumn("estimate", FB.sketch_estimate(F.col("sketch"))).collect():
            reports, tokens = exact[tuple(r[c] for c in by) + (None,) * (2 - len(by))]
            assert r.reports == reports and abs(r.estimate - tokens) <= max(1, 0.05 * tokens)
            seen += 1
    assert seen == len(exact) and exact[(None, None)] == (60_000, 21_000)


@pytest.mark.parametrize("compact_after", [1, 3, 32])
def test_kept_statistics_equal_the_recount(spark, tmp_path, compact_after):
    jobs, checks, _ = tables(spark)
    path = str(tmp_path / "stats")
    assert FB.stats_row(stats.read_changes(spark, path)).first().asDict() == FB.lexical_stats(jobs.where("false"), checks.where("false")).first().asDict()
    earlier = jobs.withColumn("status", F.when(F.col("job_id") == "a", "queued").otherwise(F.col("status")))
    stats.save_changes(FB.completed_changes(earlier), path, 0, compact_after)
    changed = F.col("job_id") == "a"
    stats.save_changes(FB.completed_changes(jobs.where(changed), earlier.where(changed)), path, 1, compact_after)
    for number in range(1, 8):
        batch = FB.validation_changes(checks.where(F.col("id") == number), jobs)
        stats.save_changes(batch, path, number + 1, compact_after)
        if number % 2:
            stats.save_changes(batch, path, number + 1, compact_after)  # run again
    row = FB.stats_row(stats.read_changes(spark, path)).first().asDict()
    assert row == FB.lexical_stats(jobs, checks).first().asDict()
    if compact_after < 32:
        assert len(list((tmp_path / "stats").glob("change=*"))) < 9
