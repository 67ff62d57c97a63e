"""Named queries over the benchmark tables, one or more per operator.

Every query reads whole tables. Arrays and structs are flattened to text so that two engines can compare
them value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import classify as C, entities as E, header as H, redact as P
from ..functions.regex import compute_once
from ..operators import cases, feedback as FB, gates as G, knowledge as K, prompts as PR, state as S, textjoin as T
from ..rules import patterns as R
from ..sources import keyed, readers, stats, writers
from ..sources.lexicon import builtin_lexicon, read_lexicon
from ..session import work_folder
from ..streaming import jobs as ST
from .pipeline import run_pipeline
from .views import COLUMNS, JOB_EVENTS, REPORTS, VALIDATIONS, load, qualified

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def on_texts(name: str, output: str, make: Callable[[Column, Column], Column]) -> None:
    """Register a query that computes one column from every report's text and lower-cased text."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = load(spark, sf, "reports").withColumn("low", F.lower("text"))
        return df.select("report_id", make(F.col("text"), F.col("low")).alias(output))

    QUERIES[name] = run


def on_headers(name: str, output: str, make: Callable[[Column], Column]) -> None:
    """Register a query that computes one column from every report's header."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return split_reports(spark, sf).select("report_id", make(F.col("header")).alias(output))

    QUERIES[name] = run


def joined(c: Column) -> Column:
    return F.array_join(c, "|")


def text(c: str) -> Column:
    return F.col(c).cast("string").alias(c)


def texts_in(df: DataFrame, document: str, paths: list[str]) -> tuple[DataFrame, list[Column]]:
    """The rows and the values of a stored document as text, each named by the last part of its path; the document is read once for all."""
    groups: dict[str, list[str]] = {}
    for path in paths:
        top, _, field = path.partition(".")
        groups.setdefault(top, []).extend([field] if field else [])
    schema = ", ".join(f"{top} struct<{', '.join(f'{f}: string' for f in fields)}>" if fields else f"{top} string" for top, fields in groups.items())
    return compute_once(df, "__read", F.from_json(document, schema)), [F.col(f"__read.{p}").alias(p.rpartition(".")[2]) for p in paths]


def split_reports(spark: SparkSession, sf: str) -> DataFrame:
    return H.split_header(load(spark, sf, "reports"))


def typed_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Reports with the exam type of their whole text."""
    low = load(spark, sf, "reports").withColumn("low", F.lower("text"))
    return compute_once(low, "exam_type", C.exam_type_of("low"))


def pipeline(spark: SparkSession, sf: str, compat: bool = True) -> DataFrame:
    return run_pipeline(load(spark, sf, "reports"), compat)


def jobs_and_validations(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    jobs, validations = load(spark, sf, "jobs"), load(spark, sf, "validations")
    return jobs, S.enrich_validations(validations, jobs)


def feedback(spark: SparkSession, sf: str) -> DataFrame:
    return S.lexical_feedback(load(spark, sf, "validations"), load(spark, sf, "jobs"))


# ------------------------------------------------------------------ flagship and pipeline


@query
def exams_by_month(spark: SparkSession, sf: str) -> DataFrame:
    """Exam type and date of every report, counted by type and month."""
    return (
        pipeline(spark, sf)
        .groupBy("exam_type", F.substring("exam_date", 1, 7).alias("exam_month"))
        .agg(F.count("*").alias("reports"))
    )


@query
def report_results(spark: SparkSession, sf: str) -> DataFrame:
    rows = pipeline(spark, sf)
    e = F.col("entities")
    return rows.select(
        "report_id",
        "status",
        "exam_date",
        "patient_token",
        "exam_type",
        "exam_label",
        "was_raster_engine_used",
        "raw_text_length",
        "safe_text_snippet",
        "low_confidence",
        joined(e["decibeis_encontrados"]).alias("decibeis"),
        e["lateralidade"].alias("lateralidade"),
        joined(e["achados"]).alias("achados"),
    )


@query
def document_results(spark: SparkSession, sf: str) -> DataFrame:
    """The pipeline over free documents of any length."""
    docs = load(spark, sf, "documents").select(
        F.col("doc_id").alias("report_id"), F.concat("source", F.lit(".pdf")).alias("filename"), "text"
    )
    return run_pipeline(docs).select(F.col("report_id").alias("doc_id"), "exam_type", "status", "raw_text_length")


@query
def report_results_fixed(spark: SparkSession, sf: str) -> DataFrame:
    """The pipeline with the known quirks mended."""
    return pipeline(spark, sf, compat=False).select("report_id", "exam_type", F.year("exam_date_d").alias("exam_year"))


@query
def result_struct(spark: SparkSession, sf: str) -> DataFrame:
    rows = pipeline(spark, sf)
    fields = ["patient_token", "exam_date", "exam_type", "exam_label", "raw_text_length", "safe_text_snippet", "low_confidence", "was_raster_engine_used", "entities_found.lateralidade"]
    stored, values = texts_in(rows.select("report_id", "status", writers.result_document(rows).alias("document")), "document", fields)
    return stored.select("report_id", "status", *values)


@query
def result_struct_full(spark: SparkSession, sf: str) -> DataFrame:
    """Patient data and the model's interpretation inside the stored document."""
    answers = load(spark, sf, "llm_answers").select("report_id", cases.parse_llm_output(F.col("answer")).alias("analysis"))
    rows = run_pipeline(load(spark, sf, "reports").join(answers, "report_id", "left"), with_patient_data=True)
    stored = rows.select("report_id", "status", writers.result_document(rows).alias("document"))
    patient = [f"patient_data.{f}" for f in ("nome", "data_nascimento", "idade", "sexo", "cargo_funcao")]
    told = [f"clinical_interpretation.{f}" for f in ("is_valid_exam", "summary", "succinct_insight", "error")]
    stored, values = texts_in(stored, "document", [*patient, *told])
    return stored.select("report_id", "status", *values)


@query
def write_results(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of the results sink, as read back from it."""
    out = work_folder(spark, "results")
    writers.write_results(pipeline(spark, sf), out)
    rows = readers.read_state(spark, out)
    fields = ["exam_date", "raw_text_length"]
    return rows.select("report_id", "exam_type", "status", "patient_token", *[F.get_json_object("result_json", f"$.{f}").alias(f) for f in fields])


@query
def update_results(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches with repeated keys merged into the keyed table, the second one twice; the table as read back."""
    out = work_folder(spark, "keyed")
    events = load(spark, sf, "job_events")
    middle = events.agg(F.median("seq")).first()[0] or 0
    early, late = events.where(F.col("seq") <= middle), events.where(F.col("seq") > middle)
    for batch in (early, late, late):
        keyed.update_results(batch, out, buckets=16)
    return keyed.read_results(spark, out)


@query
def distinct_tokens(spark: SparkSession, sf: str) -> DataFrame:
    history = FB.patients_with_history(pipeline(spark, sf))
    return history.withColumn("exam_types", joined(F.col("exam_types")))


@query
def distinct_tokens_by_month(spark: SparkSession, sf: str) -> DataFrame:
    """Exact patients per type and month, per type and in all, and whether stored sketches, merged upward, come near."""
    rows = pipeline(spark, sf).select("exam_type", F.substring("exam_date", 1, 7).alias("exam_month"), "patient_token")
    out = work_folder(spark, "sketches")
    FB.token_sketches(rows).write.parquet(out)
    stored = spark.read.parquet(out)
    levels = [stored, FB.merge_sketches(stored, "exam_type").withColumn("exam_month", F.lit(None).cast("string"))]
    levels.append(FB.merge_sketches(stored).select("*", F.lit(None).cast("string").alias("exam_type"), F.lit(None).cast("string").alias("exam_month")))
    names = ["exam_type", "exam_month", "reports", "sketch"]
    merged = levels[0].select(*names).unionByName(levels[1].select(*names)).unionByName(levels[2].select(*names))
    exact = FB.distinct_tokens(rows).alias("e")
    merged = merged.select(*names[:2], F.col("reports").alias("sketched"), FB.sketch_estimate(F.col("sketch")).alias("estimate")).alias("s")
    same = F.col("e.exam_type").eqNullSafe(F.col("s.exam_type")) & F.col("e.exam_month").eqNullSafe(F.col("s.exam_month"))
    near = (F.abs(F.col("estimate") - F.col("tokens")) <= F.greatest(F.lit(1.0), 0.05 * F.col("tokens"))) & (F.col("sketched") == F.col("reports"))
    return exact.join(merged, same, "left").select("e.exam_type", "e.exam_month", "reports", "tokens", F.coalesce(near, F.lit(False)).alias("near"))


# ------------------------------------------------------------------ sources


@query
def scan_reports(spark: SparkSession, sf: str) -> DataFrame:
    out = work_folder(spark, "reports")
    load(spark, sf, "reports").write.parquet(out)
    df = readers.read_reports(spark, out, report_id="report_id")
    return df.select("report_id", "filename", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_hash"))


@query
def scan_reports_json(spark: SparkSession, sf: str) -> DataFrame:
    """The same reports from JSON lines with a given schema: nothing is read to infer one."""
    out = work_folder(spark, "reports")
    load(spark, sf, "reports").write.json(out)
    df = readers.read_reports(spark, out, "json", report_id="report_id", schema="report_id long, filename string, text string")
    return df.select("report_id", "filename", F.sha2("text", 256).alias("text_hash"))


@query
def scan_reports_once(spark: SparkSession, sf: str) -> DataFrame:
    """Reports that come in two uploads, taken in by three runs: the second takes the second upload, the third nothing."""
    out = work_folder(spark, "uploads")
    reports = load(spark, sf, "reports")
    middle = reports.agg(F.median("report_id")).first()[0] or 0
    taken = []
    for run, part in ((1, F.col("report_id") <= middle), (2, F.col("report_id") > middle), (3, None)):
        if part is not None:
            reports.where(part).write.mode("append").parquet(f"{out}/files")
        intake = readers.read_new_reports(spark, f"{out}/files", f"{out}/manifest", report_id="report_id")
        if intake.reports is not None:
            intake.reports.withColumn("run", F.lit(run)).write.parquet(f"{out}/taken/run={run}")
            taken.append(f"{out}/taken/run={run}")
        intake.commit()
    return spark.read.parquet(*taken).select("report_id", "run", "filename", F.sha2("text", 256).alias("text_hash"))


def _state(spark: SparkSession, sf: str, view: str) -> DataFrame:
    """A derived table that is stored first, as state and rule tables are."""
    out = work_folder(spark, view)
    load(spark, sf, view).write.parquet(out)
    return readers.read_state(spark, out)


@query
def scan_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return _state(spark, sf, "jobs").withColumn("created_at", F.col("created_at").cast("string"))


@query
def scan_validations(spark: SparkSession, sf: str) -> DataFrame:
    return _state(spark, sf, "validations").withColumn("validated_at", F.col("validated_at").cast("string"))


def _lexicon_file(spark: SparkSession, kinds: DataFrame) -> str:
    """The built-in lexicon as one JSON document, as users keep theirs; ``kinds`` are the exam types to put in."""
    terms, compounds = builtin_lexicon(spark)
    packed = []
    for rows, name, fields in (
        (terms, "achados_discriminativos", ["termo", "variantes", "peso", "significado"]),
        (compounds, "diagnosticos_compostos", ["condicao", "diagnostico", "justificativa"]),
    ):
        in_order = F.array_sort(F.collect_list(F.struct("ord", F.struct(*fields).alias("x"))))
        packed.append(rows.join(kinds, "exam_type", "left_semi").groupBy("exam_type").agg(F.transform(in_order, lambda r: r["x"]).alias(name)))
    exams = packed[0].join(packed[1], "exam_type", "left").select("exam_type", F.struct("achados_discriminativos", "diagnosticos_compostos").alias("kb"))
    out = work_folder(spark, "kb")
    exams.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("exam_type", "kb")))).alias("value")).coalesce(1).write.text(out)
    return out


def _lexicon_and_counts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Terms and rules read from a lexicon file, for the exam types among the reports, and the number of reports of each."""
    counts = typed_reports(spark, sf).groupBy("exam_type").agg(F.count("*").alias("reports"))
    return *read_lexicon(spark, _lexicon_file(spark, counts)), counts


@query
def scan_kb(spark: SparkSession, sf: str) -> DataFrame:
    """The terms of a lexicon file as flat rows, with the reports of each type."""
    terms, _, counts = _lexicon_and_counts(spark, sf)
    return terms.join(counts, "exam_type").select("exam_type", "ord", "termo", joined(F.col("variantes")).alias("variantes"), "peso", "reports")


@query
def scan_feedback(spark: SparkSession, sf: str) -> DataFrame:
    return feedback(spark, sf).select("id", "exam_type", "original_text", "corrected_text", "source_job_id")


@query
def scan_llm_outputs(spark: SparkSession, sf: str) -> DataFrame:
    out = work_folder(spark, "answers")
    load(spark, sf, "vision_outputs").select("document").write.text(out)
    return readers.read_vision_outputs(spark, out, wholetext=False).select("filename", F.length("answer").alias("n_chars"))


@query
def scan_case_bank(spark: SparkSession, sf: str) -> DataFrame:
    out = work_folder(spark, "cases")
    load(spark, sf, "case_bank").select("document").write.text(out)
    return readers.read_case_bank(spark, out, multiline=False).select(
        "id", "filename", "idade", "parecer_audiologico", F.col("valores_exame")["LRF_OD"].alias("lrf_od")
    )


# ------------------------------------------------------------------ gates


@query
def route_by_extension(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "reports").select("report_id", G.is_pdf(F.col("filename")).alias("is_pdf"))


@query
def native_text_gate(spark: SparkSession, sf: str) -> DataFrame:
    df = load(spark, sf, "reports").withColumnRenamed("text", "native_text")
    return G.route_text(df).select("report_id", "is_raster", F.length("text").alias("n_chars"))


@query
def best_candidate_text(spark: SparkSession, sf: str) -> DataFrame:
    return G.best_candidate(load(spark, sf, "ocr_candidates"))


@query
def concat_pages(spark: SparkSession, sf: str) -> DataFrame:
    return G.concat_pages(load(spark, sf, "report_pages"))


@query
def concat_all_pages(spark: SparkSession, sf: str) -> DataFrame:
    return G.concat_pages(load(spark, sf, "report_pages"), skip_empty=False)


@query
def confidence_gate(spark: SparkSession, sf: str) -> DataFrame:
    return pipeline(spark, sf).groupBy("low_confidence", "status", "message").agg(F.count("*").alias("reports"))


@query
def llm_validity_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Pipeline rows with the model's verdict: an answer marked invalid has no result."""
    answers = load(spark, sf, "llm_answers").select("report_id", cases.parse_llm_output(F.col("answer")).alias("analysis"))
    rows = run_pipeline(load(spark, sf, "reports").join(answers, "report_id", "left"))
    document = writers.result_document(rows)
    return rows.groupBy("status", "rejected", "exam_type").agg(
        F.count("*").alias("reports"), F.count(document).alias("documents")
    )


@query
def text_snippet(spark: SparkSession, sf: str) -> DataFrame:
    df = split_reports(spark, sf)
    return df.select("report_id", G.text_snippet(F.col("body"), G.is_low_confidence(F.col("body"))).alias("snippet"))


@query
def retention_filter(spark: SparkSession, sf: str) -> DataFrame:
    as_of = F.lit("2026-01-15 00:00:00").cast("timestamp")
    return G.purge_list(load(spark, sf, "uploaded_files"), as_of).select("path", text("modified_at"))


@query
def purge_uploads(spark: SparkSession, sf: str) -> DataFrame:
    """Real files, listed: all are due eight days after they were written, none today; rows of the listed files by language."""
    out = work_folder(spark, "uploads")
    load(spark, sf, "documents").write.partitionBy("lang").json(out)
    files = readers.read_uploads(spark, out).where(F.endswith("filename", F.lit(".json")))
    due = G.purge_list(files, F.current_timestamp() + F.make_dt_interval(F.lit(8))).select("path", "length")
    today = G.purge_list(files).select("path", F.lit(1).alias("today"))
    listed = due.join(today, "path", "left").withColumn("lang", F.regexp_extract("path", "lang=([^/]*)/", 1))
    rows = spark.read.schema("doc_id long").json(out).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("n"))
    rows = rows.join(listed, F.regexp_extract(rows["path"], "[^/]+$", 0) == F.regexp_extract(listed["path"], "[^/]+$", 0)).where(F.contains(rows["path"], F.concat(F.lit("lang="), "lang", F.lit("/"))))
    return rows.groupBy("lang").agg(F.sum("n").alias("documents"), F.count("today").alias("due_today"))


@query
def display_truncate(spark: SparkSession, sf: str) -> DataFrame:
    return FB.feedback_report(feedback(spark, sf)).select("id", "original_text", "corrected_text")


# ------------------------------------------------------------------ header


@query
def split_header(spark: SparkSession, sf: str) -> DataFrame:
    return split_reports(spark, sf).select("report_id", "header", "body")


@query
def split_header_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = H.split_header(load(spark, sf, "documents"))
    return docs.select("doc_id", F.length("header").alias("header_chars"), F.length("body").alias("body_chars"))


@query
def exam_date(spark: SparkSession, sf: str) -> DataFrame:
    return split_reports(spark, sf).select("report_id", H.exam_date(F.col("header"), F.col("body")).alias("exam_date"))


@query
def exam_date_fixed(spark: SparkSession, sf: str) -> DataFrame:
    dated = split_reports(spark, sf).select(
        "report_id", H.exam_date(F.col("header"), F.col("body"), compat=False).alias("exam_date")
    )
    return dated.select("report_id", "exam_date", H.exam_date_as_date(F.col("exam_date")).cast("string").alias("exam_day"))


@query
def normalize_date(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "raw_dates").select("report_id", H.normalize_date(F.col("raw")).alias("exam_date"))


@query
def patient_token(spark: SparkSession, sf: str) -> DataFrame:
    return split_reports(spark, sf).select(
        "report_id", H.patient_token(F.col("header"), F.col("report_id")).alias("patient_token")
    )


on_headers("patient_name", "nome", H.patient_name)
on_headers("birth_date", "data_nascimento", H.birth_date)
on_headers("age", "idade", H.age)
on_headers("sex", "sexo", H.sex)
on_headers("occupation", "cargo_funcao", H.occupation)


@query
def patient_data(spark: SparkSession, sf: str) -> DataFrame:
    return split_reports(spark, sf).select("report_id", H.patient_data(F.col("header")).alias("p")).select("report_id", "p.*")


# ------------------------------------------------------------------ redaction

for _rule in R.PII_RULES:
    _name = "pseudonymize_name" if _rule[0] == "name" else f"redact_{_rule[0]}"
    on_texts(_name, "safe_text", lambda c, low, rule=_rule: P.apply_rule(c, rule))
on_texts("strip_pii", "safe_text", lambda c, low: P.strip_pii(c))
on_texts("strip_pii_fixed", "safe_text", lambda c, low: P.strip_pii(c, R.PII_RULES_FIXED))


@query
def pii_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Audit: matches per rule and file kind."""
    keys = [f"n_{rule[0]}" for rule in R.PII_RULES]
    counts = load(spark, sf, "reports").select(G.is_pdf(F.col("filename")).alias("is_pdf"), *P.pii_counts(F.col("text")))
    return counts.groupBy("is_pdf").agg(*[F.sum(k).alias(k) for k in keys])


@query
def pii_counts_documents(spark: SparkSession, sf: str) -> DataFrame:
    keys = [f"n_{rule[0]}" for rule in R.GENERIC_PII_RULES]
    counts = load(spark, sf, "documents").select("source", *P.pii_counts(F.col("text"), R.GENERIC_PII_RULES))
    return counts.groupBy("source").agg(*[F.sum(k).alias(k) for k in keys])


@query
def strip_pii_documents(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select(
        "doc_id", F.sha2(P.strip_pii(F.col("text"), R.GENERIC_PII_RULES), 256).alias("safe_hash")
    )


# ------------------------------------------------------------------ classification


@query
def exam_scores(spark: SparkSession, sf: str) -> DataFrame:
    scored = load(spark, sf, "reports").withColumn("low", F.lower("text")).select(
        "report_id", C.exam_scores(F.col("low")).alias("scores")
    )
    pairs = F.transform("scores", lambda s: F.concat(s["exam_type"], F.lit("="), s["score"]))
    return scored.select("report_id", joined(pairs).alias("scores"))


@query
def classify_exam(spark: SparkSession, sf: str) -> DataFrame:
    return typed_reports(spark, sf).select("report_id", "exam_type")


@query
def classify_exam_fixed(spark: SparkSession, sf: str) -> DataFrame:
    low = load(spark, sf, "reports").withColumn("low", F.lower("text"))
    return low.select("report_id", C.exam_type_of("low", False).alias("exam_type"))


@query
def classify_documents(spark: SparkSession, sf: str) -> DataFrame:
    low = load(spark, sf, "documents").select("lang", F.lower("text").alias("low"))
    return low.groupBy("lang", C.exam_type_of("low").alias("exam_type")).agg(F.count("*").alias("documents"))


@query
def exam_label(spark: SparkSession, sf: str) -> DataFrame:
    """Label per report; job states hold types outside the table."""
    return load(spark, sf, "job_events").select("seq", "exam_type", C.exam_label(F.col("exam_type")).alias("exam_label"))


def _expected() -> Column:
    """The exam type each report was written for."""
    names = ["audiometria", "bera", "tomografia", "tomografia_mastoide", "tomografia_pescoco", "polissonografia",
             "videolaringoscopia", "endoscopia_nasal", R.UNKNOWN_EXAM]
    by_rest = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("report_id") % 9 + 1).cast("int"))
    return F.when(F.col("report_id") % 17 == 0, F.lit(R.UNKNOWN_EXAM)).otherwise(by_rest)


@query
def classification_eval(spark: SparkSession, sf: str) -> DataFrame:
    return FB.classification_eval(typed_reports(spark, sf).select(_expected().alias("expected"), "exam_type"))


@query
def classification_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return FB.classification_accuracy(classification_eval(spark, sf))


# ------------------------------------------------------------------ entities

on_texts("audio_db_values", "decibeis", lambda c, low: joined(E.db_values(c)))
on_texts("audio_loss_type", "tipo_perda", lambda c, low: E.loss_type(low))
on_texts("audio_laterality", "lateralidade", lambda c, low: E.ear_side(low))
on_texts("audio_degree", "grau_perda", lambda c, low: E.loss_degree(low))
on_texts("audio_srt", "srt_db", lambda c, low: E.srt_db(c))
on_texts("audio_iprf", "iprf_pct", lambda c, low: E.iprf_pct(c))
on_texts("audio_suggestions", "sugestoes", lambda c, low: joined(E.audio_suggestions(low)))
on_texts(
    "bera_latencies",
    "latencias",
    lambda c, low: joined(F.transform(F.map_entries(E.bera_latencies(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))),
)
on_texts("bera_threshold", "limiar_db", lambda c, low: E.bera_threshold(c))
on_texts("ct_sinuses", "seios", lambda c, low: joined(E.ct_sinuses(low)))
on_texts("ct_laterality", "lateralidade", lambda c, low: E.ct_side(low))
on_texts("ct_findings", "achados", lambda c, low: joined(E.ct_findings(low)))
on_texts("mastoid_findings", "achados", lambda c, low: joined(E.mastoid_findings(low)))
on_texts("mastoid_laterality", "lateralidade", lambda c, low: E.mastoid_side(low))
on_texts("neck_findings", "achados", lambda c, low: joined(E.neck_findings(low)))
on_texts("neck_levels", "niveis", lambda c, low: joined(E.neck_levels(c)))


@query
def extract_entities(spark: SparkSession, sf: str) -> DataFrame:
    """All entity fields by the exam type of the report's text."""
    e = typed_reports(spark, sf).select(
        "report_id", "exam_type", E.extract_entities(F.col("text"), F.col("exam_type"), F.col("low")).alias("e")
    )
    lists = ["decibeis_encontrados", "sugestoes_complementares", "seios_afetados", "achados", "niveis_cervicais"]
    plain = ["tipo_perda", "lateralidade", "grau_perda", "srt_db", "iprf_pct", "limiar_eletrofisiologico_db"]
    waves = F.transform(F.map_entries("e.latencias_ms"), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return e.select(
        "report_id",
        "exam_type",
        *[joined(F.col(f"e.{f}")).alias(f) for f in lists],
        *[f"e.{f}" for f in plain],
        joined(waves).alias("latencias_ms"),
    )


@query
def entities_json(spark: SparkSession, sf: str) -> DataFrame:
    """Entity documents as stored: absent entities have no key."""
    rows = pipeline(spark, sf).select("report_id", "exam_type", F.to_json("entities").alias("entities"))
    found = F.from_json(F.get_json_object("entities", "$.achados"), "array<string>")
    return rows.select(
        "report_id", "exam_type", F.get_json_object("entities", "$.lateralidade").alias("lateralidade"), joined(found).alias("achados")
    )


# ------------------------------------------------------------------ prompts and model answers


@query
def lexical_block(spark: SparkSession, sf: str) -> DataFrame:
    """Vocabulary block of every exam type that occurs among the reports."""
    blocks = PR.lexical_blocks(*builtin_lexicon(spark))
    counts = typed_reports(spark, sf).groupBy("exam_type").agg(F.count("*").alias("reports"))
    return counts.join(blocks, "exam_type", "left")


@query
def build_prompt(spark: SparkSession, sf: str) -> DataFrame:
    blocks = PR.lexical_blocks(*builtin_lexicon(spark))
    prompts = PR.build_prompts(typed_reports(spark, sf), blocks, text="text")
    return prompts.select("report_id", "exam_type", F.sha2("prompt", 256).alias("prompt_hash"))


@query
def batch_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Stored prompts in batches of even size."""
    out = work_folder(spark, "prompts")
    PR.prompts_to_send(pipeline(spark, sf), PR.lexical_blocks(*builtin_lexicon(spark))).write.parquet(out)
    batches = PR.batch_prompts(spark.read.parquet(out), max_chars=8000)
    return batches.select("report_id", "exam_type", "batch", F.sha2("prompt", 256).alias("prompt_hash"))


@query
def lexical_block_supplement(spark: SparkSession, sf: str) -> DataFrame:
    """Vocabulary blocks with reference conditions, for the exam types among the reports."""
    c = load(spark, sf, "conditions")
    conditions = c.select("exam_type", "ord", "nome", F.split("cid10", r"\|").alias("cid10"), F.split("achados", r"\|").alias("achados_chave"))
    blocks = PR.lexical_blocks(*builtin_lexicon(spark), conditions)
    counts = typed_reports(spark, sf).groupBy("exam_type").agg(F.count("*").alias("reports"))
    return counts.join(blocks, "exam_type", "left")


@query
def parse_llm_output(spark: SparkSession, sf: str) -> DataFrame:
    a = load(spark, sf, "llm_answers").select("report_id", cases.parse_llm_output(F.col("answer")).alias("a"))
    return a.select(
        "report_id",
        "a.is_valid_exam",
        "a.summary",
        joined(F.col("a.findings")).alias("findings"),
        "a.normal_standards",
        joined(F.col("a.diagnostics")).alias("diagnostics"),
        "a.succinct_insight",
        "a.error",
    )


# ------------------------------------------------------------------ lexicon


def _hits(spark: SparkSession, sf: str, weights: tuple[str, ...]) -> DataFrame:
    terms, _ = builtin_lexicon(spark)
    return K.kb_term_hits(typed_reports(spark, sf), terms, weights=weights)


@query
def kb_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Every lexicon term with the number of reports of its exam type."""
    terms, _ = builtin_lexicon(spark)
    counts = typed_reports(spark, sf).groupBy("exam_type").agg(F.count("*").alias("reports"))
    return terms.join(counts, "exam_type", "left").select("exam_type", "ord", "termo", joined(F.col("variantes")).alias("variantes"), "peso", "reports")


@query
def kb_compounds(spark: SparkSession, sf: str) -> DataFrame:
    """The compound rules of a lexicon file as flat rows, with the reports of each type."""
    _, compounds, counts = _lexicon_and_counts(spark, sf)
    return compounds.join(counts, "exam_type").select("exam_type", "ord", "condicao", "diagnostico", "reports")


@query
def kb_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Term hits in the reports by exam type and weight."""
    counts = K.kb_stats(_hits(spark, sf, ("ALTO", "MÉDIO", "BAIXO")))
    return counts.select("exam_type", F.col("ALTO").alias("alto"), F.col("MÉDIO").alias("medio"), F.col("BAIXO").alias("baixo"))


@query
def kb_term_hits(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf, ("ALTO",))


@query
def compound_diagnoses(spark: SparkSession, sf: str) -> DataFrame:
    _, compounds = builtin_lexicon(spark)
    rows = pipeline(spark, sf).select("report_id", "exam_type", "safe_body", F.col("entities.achados").alias("achados"))
    return K.compound_diagnoses(rows, compounds, text="safe_body")


@query
def compound_diagnoses_every_rule(spark: SparkSession, sf: str) -> DataFrame:
    """Reports of which each fulfils one of the eleven rules."""
    _, compounds = builtin_lexicon(spark)
    rows = load(spark, sf, "rule_reports")
    rows = rows.select("report_id", "exam_type", "text", E.extract_entities(F.col("text"), F.col("exam_type"))["achados"].alias("achados"))
    return K.compound_diagnoses(rows, compounds, text="text")


@query
def kb_variant_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of every weight in reports that use other forms than the term itself."""
    terms, _ = builtin_lexicon(spark)
    return K.kb_term_hits(load(spark, sf, "rule_reports"), terms, weights=("ALTO", "MÉDIO", "BAIXO"))


@query
def kb_term_hits_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """The built-in lexicon through the inverted index."""
    terms, _ = builtin_lexicon(spark)
    return K.kb_term_hits_by_index(typed_reports(spark, sf), terms)


@query
def form_hits_large(spark: SparkSession, sf: str) -> DataFrame:
    """A hundred forms drawn from each document, looked for in all documents of their language."""
    docs = load(spark, sf, "documents").select("doc_id", F.col("lang").alias("exam_type"), "text")
    counts = [F.count("*").alias("forms"), F.sum(F.length("form")).alias("form_chars"), F.min("form").alias("first_form"), F.max("form").alias("last_form")]
    counted = lambda hits: hits.groupBy("doc_id", "exam_type").agg(*counts)
    return T.form_hits(docs, _state(spark, sf, "word_forms"), "doc_id", by=("exam_type",), fold=counted)


@query
def classify_by_rule_table(spark: SparkSession, sf: str) -> DataFrame:
    """Every document scored with a rule table of ten forms per document, whatever its language."""
    rules = _state(spark, sf, "rule_forms").select("exam_type", "form")
    return T.classify_by_rules(load(spark, sf, "documents"), rules, "doc_id", default=R.UNKNOWN_EXAM)


@query
def compound_diagnoses_many_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Thousands of rules of two and three tokens over findings that come as rows."""
    found = load(spark, sf, "line_findings").groupBy("report_id", "exam_type").agg(F.collect_set("token").alias("achados"))
    fired = K.compound_diagnoses(found, _state(spark, sf, "line_rules"), aliases={})
    return fired.groupBy("report_id", "exam_type").agg(
        F.count("*").alias("rules"), F.count_if(F.col("diagnostico") == "d3").alias("of_three"), F.min("condicao").alias("first_rule"), F.max("condicao").alias("last_rule")
    )


@query
def enrich_validations_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """Type and token of the job as of each validation; one validation is made after each event."""
    events = load(spark, sf, "job_events")
    made = events.select(F.col("seq").alias("id"), "job_id", "seq")
    return S.enrich_validations_as_of(made, events).select("id", "job_id", "patient_token", "exam_type")


@query
def job_full_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Folded jobs with their creation columns, as the listings and exports take them."""
    events = load(spark, sf, "job_events").withColumns(
        {"filename": F.concat("message", F.lit(".pdf")), "file_path": F.concat(F.lit("/up/"), F.col("seq").cast("string")), "created_at": F.col("at")}
    )
    jobs = S.fold_job_events(events)
    rows = FB.job_listing(jobs).join(jobs.select("job_id", "file_path", "updated_at"), "job_id")
    return rows.withColumns({"created_at": text("created_at"), "updated_at": text("updated_at")})

@query
def kb_patch_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    terms, _ = builtin_lexicon(spark)
    return K.kb_patch_suggestions(feedback(spark, sf), terms)


@query
def severity_by_range(spark: SparkSession, sf: str) -> DataFrame:
    df = load(spark, sf, "reports").select("report_id", K.apnea_index(F.col("text")).alias("iah"))
    return df.select("report_id", "iah", K.severity_by_range(F.col("iah")).alias("gravidade"))


# ------------------------------------------------------------------ drifting JSON


@query
def strip_code_fence(spark: SparkSession, sf: str) -> DataFrame:
    rows = readers.explode_outputs(load(spark, sf, "vision_outputs"), "document")
    return rows.select("filename", cases.strip_code_fence(F.col("answer")).alias("json_text"))


@query
def normalize_case(spark: SparkSession, sf: str) -> DataFrame:
    return cases.normalize_cases(readers.explode_outputs(load(spark, sf, "vision_outputs"), "document"))


@query
def drift_report(spark: SparkSession, sf: str) -> DataFrame:
    """Paths and kinds of values over all recorded answers."""
    return cases.drift_report(readers.explode_outputs(load(spark, sf, "vision_outputs"), "document"))


@query
def get_job_result(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.job_results(load(spark, sf, "jobs"), "safe_text_snippet string")
    return rows.select("job_id", "status", F.col("result.safe_text_snippet").alias("snippet"), F.col("result").isNull().alias("no_result"))


# ------------------------------------------------------------------ job state and feedback


@query
def create_job(spark: SparkSession, sf: str) -> DataFrame:
    events = load(spark, sf, "job_events").select("job_id", "seq", "status", "message")
    return S.insert_or_ignore(events)


@query
def create_job_new(spark: SparkSession, sf: str) -> DataFrame:
    """First rows of jobs that are not in the jobs table."""
    events = load(spark, sf, "job_events").select("job_id", "seq", "status")
    existing = load(spark, sf, "validations").select("job_id").distinct()
    return S.insert_or_ignore(events, existing)


@query
def job_current_state(spark: SparkSession, sf: str) -> DataFrame:
    return S.fold_job_events(load(spark, sf, "job_events"))


@query
def update_validation_status(spark: SparkSession, sf: str) -> DataFrame:
    jobs, validations = load(spark, sf, "jobs"), load(spark, sf, "validations")
    return S.validation_status(jobs, validations).select("job_id", "status", "validation_status")


@query
def save_validation(spark: SparkSession, sf: str) -> DataFrame:
    _, enriched = jobs_and_validations(spark, sf)
    return enriched.select("id", "job_id", "patient_token", "exam_type", "is_correct", "corrections")


@query
def lexical_feedback(spark: SparkSession, sf: str) -> DataFrame:
    return feedback(spark, sf).withColumn("created_at", text("created_at"))


@query
def lexical_stats(spark: SparkSession, sf: str) -> DataFrame:
    row = FB.lexical_stats(load(spark, sf, "jobs"), load(spark, sf, "validations"))
    pairs = F.transform(F.map_entries("validations_by_exam"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return row.withColumn("validations_by_exam", joined(pairs))


@query
def lexical_stats_kept(spark: SparkSession, sf: str) -> DataFrame:
    """The same totals from stored changes: jobs, then validations in three batches, one of them saved twice."""
    out = work_folder(spark, "stats")
    jobs, validations = load(spark, sf, "jobs"), load(spark, sf, "validations")
    cuts = validations.agg(F.percentile_approx("id", [0.3, 0.7])).first()[0] or [0, 0]
    number = F.when(F.col("id") <= cuts[0], 1).when(F.col("id") <= cuts[1], 2).otherwise(3)
    stats.save_changes(FB.completed_changes(jobs), out, 0)
    for batch in (1, 2, 2, 3):
        stats.save_changes(FB.validation_changes(validations.where(number == batch), jobs), out, batch, compact_after=2)
    row = FB.stats_row(stats.read_changes(spark, out))
    pairs = F.transform(F.map_entries("validations_by_exam"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return row.withColumn("validations_by_exam", joined(pairs))


@query
def validations_by_exam(spark: SparkSession, sf: str) -> DataFrame:
    return FB.validations_by_exam(load(spark, sf, "validations"), load(spark, sf, "jobs"))


@query
def corrections_report(spark: SparkSession, sf: str) -> DataFrame:
    jobs, enriched = jobs_and_validations(spark, sf)
    return FB.corrections_report(enriched, jobs).withColumn("validated_at", text("validated_at"))


@query
def feedback_report(spark: SparkSession, sf: str) -> DataFrame:
    return FB.feedback_report(feedback(spark, sf)).withColumn("created_at", text("created_at"))


@query
def job_listing(spark: SparkSession, sf: str) -> DataFrame:
    return FB.job_listing(load(spark, sf, "jobs")).withColumn("created_at", text("created_at"))


@query
def validation_listing(spark: SparkSession, sf: str) -> DataFrame:
    _, enriched = jobs_and_validations(spark, sf)
    return FB.validation_listing(enriched).withColumn("validated_at", text("validated_at"))


def _retrain(spark: SparkSession, sf: str, files: DataFrame | None = None) -> DataFrame:
    jobs, validations = load(spark, sf, "jobs"), load(spark, sf, "validations")
    return FB.retrain_set(S.validation_status(jobs, validations), validations, files)


def _present_files(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "uploaded_files").where("present")


@query
def retrain_set(spark: SparkSession, sf: str) -> DataFrame:
    return _retrain(spark, sf)


@query
def retrain_set_existing(spark: SparkSession, sf: str) -> DataFrame:
    return _retrain(spark, sf, _present_files(spark, sf))


@query
def retrain_missing(spark: SparkSession, sf: str) -> DataFrame:
    jobs = S.validation_status(load(spark, sf, "jobs"), load(spark, sf, "validations"))
    return FB.retrain_missing(jobs, _present_files(spark, sf))


@query
def export_retrain_set(spark: SparkSession, sf: str) -> DataFrame:
    """The metadata rows of the retraining export, as read back from it."""
    out = work_folder(spark, "retrain")
    writers.export_retrain_set(_retrain(spark, sf, _present_files(spark, sf)), out)
    return spark.read.schema("job_id long, filename string, exam_type string, corrections string, image_file string").json(out)


@query
def redact_seed_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return FB.redact_seed_jobs(load(spark, sf, "jobs")).withColumn("created_at", text("created_at"))


@query
def redact_seed_jobs_strict(spark: SparkSession, sf: str) -> DataFrame:
    return FB.redact_seed_jobs(load(spark, sf, "jobs"), strict=True).withColumn("created_at", text("created_at"))


@query
def redact_seed_feedback(spark: SparkSession, sf: str) -> DataFrame:
    return FB.redact_seed_feedback(feedback(spark, sf)).drop("created_at")


def _exported(spark: SparkSession, out: str, name: str, columns: list[str]) -> DataFrame:
    """One exported table as rows of text."""
    values = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns])
    return spark.read.parquet(f"{out}/{name}").select(F.lit(name).alias("table_name"), values.alias("row_text"))


STATE_COLUMNS = {
    "jobs": ["job_id", "patient_token", "filename", "exam_type", "status", "message", "result_json", "file_path"],
    "validations": ["id", "job_id", "patient_token", "exam_type", "is_correct", "corrections"],
    "lexical_feedback": ["id", "exam_type", "original_text", "corrected_text", "source_job_id"],
}


@query
def export_seed(spark: SparkSession, sf: str) -> DataFrame:
    """The three tables of the seed export, as read back from it."""
    jobs, enriched = jobs_and_validations(spark, sf)
    out = work_folder(spark, "seed")
    writers.export_seed(jobs, enriched, feedback(spark, sf), out)
    parts = [_exported(spark, out, name, columns) for name, columns in STATE_COLUMNS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def export_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The three tables of the full export, as read back from it."""
    jobs, enriched = jobs_and_validations(spark, sf)
    out = work_folder(spark, "tables")
    writers.export_tables({"jobs": jobs, "validations": enriched, "lexical_feedback": feedback(spark, sf)}, out)
    parts = [_exported(spark, out, name, columns) for name, columns in STATE_COLUMNS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ------------------------------------------------------------------ streams


def _stream_table(spark: SparkSession, sf: str, table: str) -> DataFrame:
    path = f"{sf}/{table}.parquet"
    return readers.stream_parquet(spark, path).select(*COLUMNS[table])


@query
def stream_reports(spark: SparkSession, sf: str) -> DataFrame:
    out = work_folder(spark, "stream")
    orders = _stream_table(spark, sf, "orders")
    customer = spark.read.parquet(f"{sf}/customer.parquet").select(*COLUMNS["customer"])
    reports = spark.sql(qualified(REPORTS, ["orders", "customer"]), orders=orders, customer=customer)
    ST.stream_reports(reports, f"{out}/results", f"{out}/checkpoint").awaitTermination()
    rows = spark.read.parquet(f"{out}/results")
    return rows.groupBy("exam_type", "status").agg(
        F.count("*").alias("reports"), F.count("result_json").alias("documents")
    )


@query
def stream_job_state(spark: SparkSession, sf: str) -> DataFrame:
    out = work_folder(spark, "stream")
    events = spark.sql(qualified(JOB_EVENTS, ["events"]), events=_stream_table(spark, sf, "events"))
    ST.stream_job_state(events, f"{out}/state", f"{out}/checkpoint").awaitTermination()
    return ST.read_job_state(spark, f"{out}/state")


def _validation_stream(spark: SparkSession, sf: str, jobs) -> str:
    out = work_folder(spark, "stream")
    validations = spark.sql(qualified(VALIDATIONS, ["labels"]), labels=_stream_table(spark, sf, "labels"))
    ST.stream_validations(validations, jobs, f"{out}/validations", f"{out}/checkpoint").awaitTermination()
    return f"{out}/validations"


@query
def stream_validations(spark: SparkSession, sf: str) -> DataFrame:
    return ST.read_validation_counts(spark, _validation_stream(spark, sf, load(spark, sf, "jobs")))


@query
def stream_enriched_validations(spark: SparkSession, sf: str) -> DataFrame:
    """Validations joined batch by batch to the state that the stream of job events has left."""
    state = work_folder(spark, "stream")
    events = spark.sql(qualified(JOB_EVENTS, ["events"]), events=_stream_table(spark, sf, "events"))
    ST.stream_job_state(events, f"{state}/state", f"{state}/checkpoint").awaitTermination()
    out = _validation_stream(spark, sf, lambda batch: ST.read_job_state(spark, f"{state}/state"))
    rows = ST.read_enriched_validations(spark, out)
    return rows.select("id", "job_id", "patient_token", "exam_type", "is_correct", "corrections", text("validated_at"))
