import random

from pyspark.sql import functions as F

from laudospark.operators import feedback as FB, state as S
from laudospark.operators.joins import hot_keys, lookup_join, skew_join

EVENT = "job_id int, seq long, status string, message string, result_json string, patient_token string, exam_type string"


def make_events(n=600, jobs=9, seed=3):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        job = 0 if rng.random() < 0.4 else rng.randrange(jobs)  # one job holds 40% of the events
        pick = lambda *values: rng.choice(values)
        rows.append((job, seq, pick("processing", "completed", "failed"), f"m{seq}", pick(None, "{}", f'{{"r":{seq}}}'), pick(None, "pt-1"), pick(None, "bera", "tomografia")))
    rng.shuffle(rows)
    return rows


def folded(rows):
    state = {}
    for job, seq, status, message, result, token, kind in sorted(rows, key=lambda r: r[1]):
        s = state.setdefault(job, dict.fromkeys(["result_json", "patient_token", "exam_type"]))
        s |= {"seq": seq, "status": status, "message": message}
        for name, value in zip(["result_json", "patient_token", "exam_type"], [None if result == "{}" else result, token, kind]):
            s[name] = s[name] if value is None else value
    return state


def as_state(df):
    return {r.job_id: {k: v for k, v in r.asDict().items() if k != "job_id"} for r in df.collect()}


def test_fold_for_any_partitioning(spark):
    rows = make_events()
    for parts in (1, 7):
        df = spark.createDataFrame(rows, EVENT).repartition(parts)
        assert as_state(S.fold_job_events(df)) == folded(rows)


def test_merge_state_equals_one_fold(spark):
    rows = make_events()
    early, late = [r for r in rows if r[1] < 300], [r for r in rows if r[1] >= 300]
    state = S.fold_job_events(spark.createDataFrame(early, EVENT))
    assert as_state(S.merge_state(state, spark.createDataFrame(late, EVENT))) == folded(rows)


def test_insert_or_ignore(spark):
    new = spark.createDataFrame([(1, 5, "b"), (1, 2, "a"), (2, 1, None)], "job_id int, seq int, filename string")
    old = spark.createDataFrame([(2,)], "job_id int")
    assert sorted(map(tuple, S.insert_or_ignore(new).collect())) == [(1, 2, "a"), (2, 1, None)]
    assert [tuple(r) for r in S.insert_or_ignore(new, old).collect()] == [(1, 2, "a")]


def test_skew_join_keeps_every_row(spark):
    rng = random.Random(1)
    facts = [(i, 7 if rng.random() < 0.4 else rng.choice([None, *range(3000)])) for i in range(5000)]
    lookup = [(k, f"v{k}") for k in range(0, 3000, 2)] + [(7, "v7")]
    f = spark.createDataFrame(facts, "id int, k int")
    d = spark.createDataFrame(lookup, "k int, v string")
    table = dict(lookup)
    assert [r.k for r in hot_keys(f, "k", 100).collect()] == [7]
    left = {(r.id, r.k, r.v) for r in skew_join(f, d, "k", "left", salts=8).collect()}
    assert left == {(i, k, table.get(k)) for i, k in facts}
    inner = skew_join(f, d, "k", "inner", salts=8)
    assert inner.columns == ["k", "id", "v"]
    assert {(r.id, r.v) for r in inner.collect()} == {(i, table[k]) for i, k in facts if k in table}
    assert inner.count() == sum(k in table for _, k in facts)
    assert skew_join(f, d, "k", "left_anti", salts=8).count() == sum(k not in table for _, k in facts)
    spread = skew_join(f.filter("k = 7"), d, "k", "inner", salts=8)
    assert spread.count() == sum(k == 7 for _, k in facts)


def test_lookup_join_runs_nothing_and_keeps_every_row(spark):
    df = spark.range(1000).withColumn("exam_type", F.when(F.col("id") % 3 == 0, "bera").otherwise("outro"))
    table = spark.createDataFrame([("bera", i) for i in range(5)], "exam_type string, n int")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "planning")
    joins = {how: lookup_join(df, table, "exam_type", how) for how in ("inner", "left")}
    assert list(tracker.getJobIdsForGroup("planning")) == []
    for how, join in joins.items():
        assert join.count() == 334 * 5 + (666 if how == "left" else 0)


def test_feedback_plans_read_each_table_few_times(spark, tmp_path):
    jobs, checks, _ = tables(spark)
    jobs.write.parquet(str(tmp_path / "jobs"))
    checks.write.parquet(str(tmp_path / "checks"))
    jobs, checks = spark.read.parquet(str(tmp_path / "jobs")), spark.read.parquet(str(tmp_path / "checks"))
    stats = FB.lexical_stats(jobs, checks)._jdf.queryExecution().executedPlan().toString()
    retrain = FB.retrain_set(S.validation_status(jobs, checks), checks)._jdf.queryExecution().executedPlan().toString()
    for plan, most in ((stats, (2, 1)), (retrain, (1, 2))):
        scans = [line for line in plan.splitlines() if "FileScan" in line]
        assert sum("/jobs" in x for x in scans) <= most[0] and sum("/checks" in x for x in scans) <= most[1], plan


def test_validations_as_of(spark):
    events = spark.createDataFrame([("a", 1, "p1", None), ("a", 4, None, "bera"), ("a", 9, "p2", "tc"), ("b", 2, "q", "x")], "job_id string, seq long, patient_token string, exam_type string")
    checks = spark.createDataFrame([(1, "a", 1), (2, "a", 4), (3, "a", 8), (4, "a", 99), (5, "b", 1), (6, "c", 5)], "id int, job_id string, seq long")
    got = {r.id: (r.patient_token, r.exam_type) for r in S.enrich_validations_as_of(checks, events).collect()}
    assert got == {1: ("p1", None), 2: ("p1", "bera"), 3: ("p1", "bera"), 4: ("p2", "tc"), 5: (None, None), 6: (None, None)}


def test_validations_as_of_with_one_job_that_holds_a_third(spark):
    rng = random.Random(6)
    events = make_events(n=900, jobs=20, seed=8)
    checks = [(i, rng.choice([0, 0, rng.randrange(22), None]), rng.choice([rng.randrange(-5, 950), 400, None])) for i in range(700)]
    e = spark.createDataFrame(events, EVENT)
    c = spark.createDataFrame(checks, "id int, job_id int, seq long")
    want = {}
    for i, job, at in checks:
        state = folded([r for r in events if r[0] == job and at is not None and r[1] <= at]).get(job, {})
        want[i] = (state.get("patient_token"), state.get("exam_type"))
    for ranges in (1, 2, 16, None):
        got = S.enrich_validations_as_of(c, e, ranges=ranges)
        assert got.columns == ["id", "job_id", "seq", "patient_token", "exam_type"]
        assert {r.id: (r.patient_token, r.exam_type) for r in got.collect()} == want
    assert got.count() == len(checks)
    # No window gathers the large job: its events lie in many ranges of about even size.
    split = S.in_ranges(e.select("job_id", F.col("seq").alias("__at")), "__at", 16)
    sizes = [r["count"] for r in split.where("job_id = 0").groupBy("__range").count().collect()]
    assert len(sizes) == 16 and max(sizes) < sum(sizes) / 8
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2 and any("__range" in w.split("], [")[1] for w in windows), plan
    assert S.enrich_validations_as_of(c, e.where("false")).where("exam_type is not null").count() == 0
    assert S.enrich_validations_as_of(c.where("false"), e).count() == 0


def test_folded_jobs_are_full_rows(spark):
    schema = EVENT + ", filename string, file_path string, created_at int, at int"
    rows = [("queued", "n.pdf", "/up/n.pdf", 5, 5), ("completed", None, None, None, 9), ("failed", "other", None, 7, 7)]
    events = [(1, i, s, "m", None, None, "bera", f, p, c, at) for i, (s, f, p, c, at) in enumerate(rows)]
    jobs = S.fold_job_events(spark.createDataFrame(events, schema))
    row = jobs.first()
    assert (row.filename, row.file_path, row.created_at, row.updated_at, row.status) == ("n.pdf", "/up/n.pdf", 5, 9, "failed")
    assert FB.job_listing(jobs).count() == 1 and FB.redact_seed_jobs(jobs).first().filename == "[redacted]"
    later = spark.createDataFrame([(1, 7, "completed", "m", "r", "t", None, "late", None, 3, 30)], schema)
    merged = S.merge_state(jobs, later).first()
    assert (merged.filename, merged.created_at, merged.updated_at, merged.result_json) == ("n.pdf", 5, 30, "r")


JOBS = [
    ("a", "pt-a", "bera", "completed", '{"safe_text_snippet":"%s"}' % ("y" * 600), "/up/a_x.pdf"),
    ("b", "pt-b", None, "completed", '{"safe_text_snippet":"..."}', "C:\\up\\b.png"),
    ("c", "pt-c", "tomografia", "failed", None, None),
    ("d", "pt-d", "bera", "completed", '{"safe_text_snippet":"d"}', "/up/d.pdf"),
]
CHECKS = [
    (1, "a", 1, None), (2, "a", 0, "z" * 600), (3, "b", 0, "corrigido"), (4, "c", 0, "corrigido"), (5, "d", 0, ""), (6, "d", 1, "certo"), (7, "zz", 0, "x"),
]


def tables(spark):
    jobs = spark.createDataFrame(JOBS, "job_id string, patient_token string, exam_type string, status string, result_json string, file_path string")
    jobs = jobs.withColumn("filename", F.concat("job_id", F.lit(".pdf"))).withColumn("message", F.lit("m"))
    jobs = jobs.withColumn("created_at", F.current_timestamp())
    checks = spark.createDataFrame(CHECKS, "id int, job_id string, is_correct int, corrections string")
    checks = checks.withColumn("validated_at", F.timestamp_seconds(F.lit(0)))
    return jobs, checks, S.enrich_validations(checks, jobs)


def test_feedback_tables(spark):
    jobs, checks, enriched = tables(spark)
    assert {r.id: (r.patient_token, r.exam_type) for r in enriched.collect()} == {
        1: ("pt-a", "bera"), 2: ("pt-a", "bera"), 3: ("pt-b", None), 4: ("pt-c", "tomografia"), 5: ("pt-d", "bera"), 6: ("pt-d", "bera"), 7: (None, None),
    }
    feedback = S.lexical_feedback(checks, jobs)
    rows = feedback.collect()
    assert [(r.source_job_id, r.exam_type, len(r.original_text), len(r.corrected_text)) for r in rows] == [("a", "bera", 500, 500)]
    status = {r.job_id: r.validation_status for r in S.validation_status(jobs, checks).collect()}
    assert status == {"a": "validated_with_errors", "b": "validated_with_errors", "c": "validated_with_errors", "d": "validated_ok"}
    stats = FB.lexical_stats(jobs, checks).first()
    assert stats.asDict() == {
        "total_completed_jobs": 3, "total_validations": 7, "corrections_submitted": 5, "lexical_feedback_entries": 1,
        "validations_by_exam": {"bera": 4, "tomografia": 1},
    }
    report = FB.corrections_report(enriched, jobs).collect()
    assert [(r.id, r.filename) for r in report] == [(7, None), (5, "d.pdf"), (4, "c.pdf"), (3, "b.pdf"), (2, "a.pdf")]
    assert {r.id: r.tag for r in FB.validation_listing(enriched).collect()}[6] == "CORRETO"


def test_retrain_and_seed(spark):
    jobs, checks, enriched = tables(spark)
    known = S.validation_status(jobs, checks)
    rows = FB.retrain_set(known, enriched).collect()
    assert sorted(map(tuple, FB.retrain_set(known, checks).collect())) == sorted(map(tuple, rows))
    assert sorted((r.id, r.image_file) for r in rows) == [(1, "a_x.pdf"), (2, "a_x.pdf"), (3, "b.png")]
    files = spark.createDataFrame([("/up/a_x.pdf",)], "path string")
    assert sorted(r.id for r in FB.retrain_set(known, enriched, files).collect()) == [1, 2]
    assert [r.job_id for r in FB.retrain_missing(known, files).collect()] == ["b"]
    seed = FB.redact_seed_jobs(jobs).collect()
    assert all(r.result_json is None and r.filename == "[redacted]" and r.message == "m" for r in seed)
    assert all(r.file_path is None and r.message is None for r in FB.redact_seed_jobs(jobs, strict=True).collect())
    hidden = FB.redact_seed_feedback(S.lexical_feedback(checks, jobs)).first()
    assert hidden.original_text == "[redacted]" and len(hidden.corrected_text) == 500


def test_empty_tables_give_zero_stats(spark):
    jobs, checks, enriched = tables(spark)
    stats = FB.lexical_stats(jobs.filter("false"), checks.filter("id < 0")).first()
    assert (stats.total_completed_jobs, stats.total_validations, stats.corrections_submitted, stats.validations_by_exam) == (0, 0, 0, {})


def test_history_and_accuracy(spark):
    df = spark.createDataFrame(
        [("p", "bera", "2024-01-02"), ("p", "audiometria", ""), ("q", "bera", "2023-05-05")], "patient_token string, exam_type string, exam_date string"
    )
    rows = {r.patient_token: r for r in FB.patients_with_history(df, 2).collect()}
    assert list(rows) == ["p"] and rows["p"].exam_types == ["audiometria", "bera"] and rows["p"].first_exam == "2024-01-02"
    confusion = FB.classification_eval(df.withColumn("expected", F.lit("bera")))
    assert FB.classification_accuracy(confusion).first().hits == 2


def test_job_results(spark):
    jobs, _, _ = tables(spark)
    rows = {r.job_id: r.result for r in S.job_results(jobs, "safe_text_snippet string").collect()}
    assert rows["c"] is None and rows["d"].safe_text_snippet == "d"
