import json

import pytest
from pyspark.sql import functions as F

from laudospark.operators import feedback as FB, gates as G, state as S
from laudospark.plans.pipeline import run_pipeline
from laudospark.sources import keyed, readers, writers
from laudospark.streaming import jobs as ST
from test_state import EVENT, as_state, folded, make_events, tables

BODY = "Paciente: Ana Lima\nTomografia dos seios da face\nEspessamento mucoso no seio maxilar, sem outras alterações dignas de nota."


def test_read_reports(spark, tmp_path):
    texts = tmp_path / "texts"
    texts.mkdir()
    (texts / "a.txt").write_text("um\ndois")
    (texts / "b.txt").write_text("tres")
    rows = readers.read_reports(spark, str(texts), "text").collect()
    assert sorted((r.filename, r.text) for r in rows) == [("a.txt", "um\ndois"), ("b.txt", "tres")]
    assert len({r.report_id for r in rows}) == 2
    spark.createDataFrame([(5, "x.pdf", "t")], "k int, filename string, text string").write.json(str(tmp_path / "j"))
    assert readers.read_reports(spark, str(tmp_path / "j"), "json", report_id="k").first().report_id == 5
    given = readers.read_reports(spark, str(tmp_path / "j"), "json", report_id="k", schema="k long, text string")
    assert given.first().report_id == 5 and given.first().filename is None
    spark.createDataFrame([("t",)], "text string").write.parquet(str(tmp_path / "p"))
    assert len(readers.read_reports(spark, str(tmp_path / "p")).first().report_id) == 64
    spark.createDataFrame([("t",)], "body string").write.orc(str(tmp_path / "o"))
    assert readers.read_reports(spark, str(tmp_path / "o"), "orc", text="body").first().text == "t"


def test_ensure_parallelism(spark):
    assert readers.ensure_parallelism(spark.range(8).coalesce(1)).rdd.getNumPartitions() == 4
    wide = spark.range(8).repartition(6)
    assert readers.ensure_parallelism(wide) is wide


def test_uploads_and_json_files(spark, tmp_path):
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "1_x.pdf").write_bytes(b"abc")
    files = readers.read_uploads(spark, str(tmp_path / "up"))
    assert [(r.filename, r.length) for r in files.collect()] == [("1_x.pdf", 3)]
    assert G.purge_list(files).count() == 0
    assert G.purge_list(files, F.current_timestamp() + F.make_dt_interval(F.lit(8))).count() == 1
    case = {"id": "A", "filename": "f", "procod_data": {"nome": "N"}, "clinical_data_anonymized": {"idade": "5", "valores_exame": {"k": "v"}}}
    (tmp_path / "cases.json").write_text(json.dumps([case], indent=1))
    row = readers.read_case_bank(spark, str(tmp_path / "cases.json")).first()
    assert row.id == "A" and row.idade == "5" and row.valores_exame == {"k": "v"} and "nome" not in row.asDict()
    (tmp_path / "out.json").write_text(json.dumps({"a.jpg": "```json\n{}\n```", "b.jpg": "x"}, indent=1))
    assert {r.filename for r in readers.read_vision_outputs(spark, str(tmp_path / "out.json")).collect()} == {"a.jpg", "b.jpg"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a.pdf", BODY), (2, "b.pdf", "curto")], "report_id int, filename string, text string")
    writers.write_results(run_pipeline(df), str(tmp_path / "results"))
    back = {r.report_id: r for r in spark.read.parquet(str(tmp_path / "results")).collect()}
    assert json.loads(back[1].result_json)["entities_found"]["achados"] == ["espessamento_mucoso"]
    assert back[2].exam_type == "indefinido"
    writers.write_results(run_pipeline(df), str(tmp_path / "compact"), compact=True)
    assert spark.read.parquet(str(tmp_path / "compact")).count() == 2
    jobs, checks, enriched = tables(spark)
    rows = FB.retrain_set(S.validation_status(jobs, checks), enriched)
    writers.export_retrain_set(rows, str(tmp_path / "retrain"))
    lines = spark.read.json(str(tmp_path / "retrain"))
    assert set(lines.columns) == {"job_id", "filename", "exam_type", "corrections", "image_file"} and lines.count() == 3
    writers.export_seed(jobs, enriched, S.lexical_feedback(checks, jobs), str(tmp_path / "seed"), strict=True)
    assert readers.read_state(spark, str(tmp_path / "seed" / "jobs")).filter("filename = '[redacted]'").count() == 4
    assert spark.read.parquet(str(tmp_path / "seed" / "validations")).filter("corrections is not null").count() == 0


def test_stream_reports_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(i, f"{i}.pdf", BODY if i % 2 else "curto") for i in range(40)], "report_id int, filename string, text string")
    df.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second start finds nothing new
        ST.stream_reports(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    streamed = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert streamed == sorted(map(tuple, writers.result_rows(run_pipeline(df)).collect()))


def test_stream_job_state_equals_batch(spark, tmp_path):
    rows = make_events()
    spark.createDataFrame(rows, EVENT).repartition(6).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    ST.stream_job_state(stream, str(tmp_path / "out"), str(tmp_path / "ck"), compact_after=2).awaitTermination()
    snapshots = sorted(p.name for p in (tmp_path / "out").glob("snapshot=*"))
    assert snapshots and ST._versions(spark, str(tmp_path / "out"))[1] < len(list((tmp_path / "out").glob("version=*")))
    assert as_state(ST.read_job_state(spark, str(tmp_path / "out"))) == folded(rows)


def test_streams_read_a_folder_of_part_files_or_one_file(spark, tmp_path):
    df = spark.createDataFrame([(i, str(i)) for i in range(20)], "id int, t string")
    df.repartition(3).write.parquet(str(tmp_path / "folder.parquet"))
    df.toPandas().to_parquet(tmp_path / "file.parquet", index=False)
    for name in ("folder", "file"):
        rows = readers.stream_parquet(spark, str(tmp_path / f"{name}.parquet"))
        query = rows.writeStream.format("parquet").option("path", str(tmp_path / f"{name}-out")).option("checkpointLocation", str(tmp_path / f"{name}-ck"))
        query.trigger(availableNow=True).start().awaitTermination()
        assert spark.read.parquet(str(tmp_path / f"{name}-out")).count() == 20


def test_work_folder_must_be_shared():
    from types import SimpleNamespace

    from laudospark.session import work_folder

    def session(folder, master):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=context)

    assert work_folder(session("s3a://b/shared/", "yarn"), "x").startswith("s3a://b/shared/x-")
    assert "laudospark-" in work_folder(session(None, "local[4]"), "x")
    with pytest.raises(ValueError):
        work_folder(session(None, "yarn"), "x")


def folders(path):
    return sorted(p.name for p in path.iterdir() if p.is_dir() and not p.name.startswith(("_", ".")))


@pytest.mark.parametrize("callable_jobs", [False, True])
def test_stream_validations_equals_batch(spark, tmp_path, callable_jobs):
    jobs, checks, enriched = tables(spark)
    checks.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(checks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    given = (lambda batch: jobs.join(batch.select("job_id").distinct(), "job_id", "left_semi")) if callable_jobs else jobs
    for _ in range(2):  # a second start finds nothing new
        ST.stream_validations(stream, given, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert dict(map(tuple, ST.read_validation_counts(spark, str(tmp_path / "out")).collect())) == dict(map(tuple, FB.validations_by_exam(checks, jobs).collect()))
    rows = ST.read_enriched_validations(spark, str(tmp_path / "out"))
    assert sorted(map(str, rows.select(*enriched.columns).collect())) == sorted(map(str, enriched.collect()))
    # A batch writes its own rows only, and old totals go.
    batches = folders(tmp_path / "out" / "rows")
    sizes = [spark.read.parquet(str(tmp_path / "out" / "rows" / b)).count() for b in batches]
    assert sum(sizes) == len(checks.collect()) and max(sizes) < sum(sizes) and len(folders(tmp_path / "out" / "totals")) <= 2


def test_a_validation_batch_that_runs_again_changes_nothing(spark, tmp_path):
    jobs, checks, _ = tables(spark)
    written = {}

    class Writer:  # keeps the function that Spark would call for each batch
        def foreachBatch(self, f):
            written["f"] = f
            return self

        def option(self, *_):
            return self

        def trigger(self, **_):
            return self

        def start(self):
            return None

    class Stream:
        writeStream = Writer()

    ST.stream_validations(Stream(), jobs, str(tmp_path / "out"), str(tmp_path / "ck"))
    parts = [checks.where("id <= 3"), checks.where("id > 3")]
    for i in (0, 1, 1, 1):
        written["f"](parts[i], i)
    assert dict(map(tuple, ST.read_validation_counts(spark, str(tmp_path / "out")).collect())) == dict(map(tuple, FB.validations_by_exam(checks, jobs).collect()))
    assert ST.read_enriched_validations(spark, str(tmp_path / "out")).count() == checks.count()


def test_snapshots_take_the_place_of_what_they_cover(spark, tmp_path):
    rows = make_events()
    spark.createDataFrame(rows, EVENT).repartition(8).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ST.stream_job_state(stream, str(tmp_path / "out"), str(tmp_path / "ck"), compact_after=2).awaitTermination()
    assert len(folders(tmp_path / "out")) < 8
    assert as_state(ST.read_job_state(spark, str(tmp_path / "out"))) == folded(rows)


def test_keyed_table_equals_the_fold(spark, tmp_path):
    rows = sorted(make_events(n=400, jobs=40), key=lambda r: r[1])
    path = str(tmp_path / "keyed")
    df = lambda some: spark.createDataFrame(some, EVENT)
    for batch in (rows[:150], rows[150:300], rows[150:300], rows[300:]):
        keyed.update_results(df(batch), path, buckets=8)
    assert as_state(keyed.read_results(spark, path)) == folded(rows)
    # Null result, token and type of a later batch keep what was there.
    before = folded(rows)[0]
    keyed.update_results(df([(0, 999, "failed", "late", None, None, None)]), path, buckets=8)
    after = as_state(keyed.read_results(spark, path))[0]
    assert after == before | {"seq": 999, "status": "failed", "message": "late"}
    assert keyed.update_results(df([]), path, buckets=8) == 0
    with pytest.raises(ValueError):
        keyed.update_results(df(rows[:1]), path, buckets=9)


def test_keyed_table_touches_only_its_buckets(spark, tmp_path):
    rows = make_events(n=400, jobs=60)
    path = tmp_path / "keyed"
    keyed.update_results(spark.createDataFrame(rows, EVENT), str(path), buckets=16)
    files = lambda: {p for p in (path / "of=16").rglob("*.parquet")}
    before = files()
    one = spark.createDataFrame([(7, 5000, "completed", "m", "r", None, None)], EVENT)
    assert keyed.update_results(one, str(path), buckets=16) == 1
    kept, gone = before & files(), before - files()
    assert kept and {p.parent.name for p in gone} == {p.parent.name for p in files() - before} and len({p.parent.name for p in gone}) == 1
    some = keyed.read_results(spark, str(path), one)
    assert [r.job_id for r in some.collect()] == [7] and len(some.inputFiles()) == 1


def test_keyed_table_finishes_a_lost_batch(spark, tmp_path):
    rows = sorted(make_events(n=200, jobs=30), key=lambda r: r[1])
    path = tmp_path / "keyed"
    df = lambda some: spark.createDataFrame(some, EVENT)
    keyed.update_results(df(rows[:100]), str(path), buckets=4)
    whole = S.merge_state(keyed.read_results(spark, str(path)), df(rows[100:])).withColumn("bucket", keyed._bucket("job_id", 4))
    whole.write.parquet(str(path / "_pending"))  # merged rows are aside, and one bucket is already gone
    lost = sorted((path / "of=4").glob("bucket=*"))[0]
    for p in lost.iterdir():
        p.unlink()
    with pytest.raises(ValueError):
        keyed.read_results(spark, str(path))
    keyed.finish_update(spark, str(path))
    assert as_state(keyed.read_results(spark, str(path))) == folded(rows)
