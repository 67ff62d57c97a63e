import pytest
from pyspark.sql import functions as F

from laudospark.functions import classify as C, entities as E
from laudospark.operators import knowledge as K
from laudospark.plans.pipeline import result_document, run_pipeline
from laudospark.operators import gates as G

FULL = """
    Laudo 31 da cabine acústica. Audiometria feita com fones.
    Conclusão: perda auditiva neurossensorial bilateral, de grau moderado a severo, pior acima de 2kHz.
    Média de 45 dB na direita e 65 dB na esquerda. SRT: 50 dB. IPRF: 76%.
    Convém completar com PEATE e timpanometria.
"""


def entities(one, text, exam_type):
    return one(text, lambda c: F.to_json(E.extract_entities(c, F.lit(exam_type))))


def classify(one, text, compat=True):
    return one(text, lambda c: C.classify_exam(F.lower(c), compat=compat))


def test_classify(one):
    text = "Audiometria de controle: SRT de 35 dB, discriminação com IPRF de 80%, hipoacusia condutiva à esquerda."
    assert classify(one, text) == "audiometria"
    assert classify(one, "nada de conhecido") == "generico"
    assert classify(one, "nasofibrolaringoscopia") == "videolaringoscopia"  # a hit for two types: the earlier wins
    assert classify(one, "TC de mastoide") == "tomografia"
    assert classify(one, "4 kHz BERA") == "generico"  # capitals never hit lower-cased text
    assert classify(one, "BERA PEATE", compat=False) == "bera"
    assert one("x", lambda c: C.exam_label(F.lit("bera"))) == "BERA (Potencial Evocado Auditivo)"
    assert one("x", lambda c: C.exam_label(F.lit("outro"))) == "Exame Otorrinolaringológico (Não Identificado)"


def test_scores_sum(one):
    scores = one("tomografia dos seios da face, espessamento mucoso", lambda c: C.exam_scores(F.lower(c)))
    assert {s.exam_type: s.score for s in scores if s.score} == {"tomografia": 3}


def test_audiometry(one):
    row = one(FULL, lambda c: E.extract_entities(c, F.lit("audiometria")))
    assert (row.tipo_perda, row.lateralidade, row.grau_perda, row.srt_db, row.iprf_pct) == (
        "neurossensorial", "bilateral", "moderado a severo", 50, 76,
    )
    assert row.sugestoes_complementares == ["BERA/PEATE", "Immitanciometria/Timpanometria"]
    assert row.decibeis_encontrados == ["45", "65", "50"]
    normal = one("Normoacusia em ambas as orelhas. SRT: 10 dB. IPRF: 96%.", lambda c: E.extract_entities(c, F.lit("audiometria")))
    assert (normal.tipo_perda, normal.lateralidade, normal.srt_db, normal.iprf_pct) == ("normal", "bilateral", 10, 96)


@pytest.mark.parametrize(
    "text, exam_type, expected",
    [
        ("1234 dB DB 5 DB", "audiometria", '{"decibeis_encontrados":["234"]}'),
        ("Onda III: 3.9 ms onda v 5.8ms. Limiar : 30 dB", "bera", '{"latencias_ms":{"III":"3.9","V":"5.8"},"limiar_eletrofisiologico_db":30}'),
        ("nada", "bera", '{"latencias_ms":{}}'),
        ("nível IIa nível VIa, Nível III", "tomografia_pescoco", '{"niveis_cervicais":["IIA","VIA"]}'),
        (
            "Seio frontal e maxilar à direita; célula de Haller; pólipo",
            "tomografia",
            '{"lateralidade":"direito","seios_afetados":["maxilar","frontal"],"achados":["polipo"]}',
        ),
        ("OMC. colesteatoma na orelha esquerda", "tomografia_mastoide", '{"lateralidade":"esquerdo","achados":["colesteatoma"]}'),
        ("laringe", "videolaringoscopia", "{}"),
        ("laringe", None, "{}"),
    ],
)
def test_entities(one, text, exam_type, expected):
    assert entities(one, text, exam_type) == expected


def test_mended_entities(one):
    row = one("OMC e célula de Haller", lambda c: F.struct(E.mastoid_findings(F.lower(c), False).alias("m"), E.ct_findings(F.lower(c), False).alias("c")))
    assert row.m == ["omc"] and row.c == ["celula_haller"]
    assert one("quanto ao limiar", lambda c: E.ear_side(F.lower(c), False)) is None
    assert one("quanto ao limiar", lambda c: E.ear_side(F.lower(c))) == "bilateral"


def test_severity(one):
    assert one("IAH: 29,9 eventos", lambda c: K.severity_by_range(K.apnea_index(c))) == "moderado"
    assert one("índice de apneia e hipopneia de 31/h", lambda c: K.severity_by_range(K.apnea_index(c))) == "grave"
    assert one("sem valor", lambda c: K.severity_by_range(K.apnea_index(c))) is None


def test_pipeline_documents(spark):
    long = "Paciente: Ana Lima\nData: 02/03/2024\nTomografia dos seios da face\nEspessamento mucoso no seio maxilar com nível líquido bilateral, sem outras alterações."
    df = spark.createDataFrame([(1, "a.PDF", long), (2, "b.png", "Laudo curto"), (3, "c.pdf", None)], "report_id int, filename string, text string")
    rows = run_pipeline(df, with_patient_data=True)
    out = {r.report_id: r for r in rows.select("*", result_document(rows).alias("doc")).collect()}
    assert (out[1].status, out[1].exam_type, out[1].exam_date) == ("completed", "tomografia", "2024-03-02")
    assert out[1].entities.achados == ["espessamento_mucoso", "nivel_liquido"]
    assert '"low_confidence"' not in out[1].doc and '"exam_date":"2024-03-02"' in out[1].doc and '"nome":"Ana Lima"' in out[1].doc
    assert out[1].was_raster_engine_used is False and out[1].safe_text_snippet.endswith("...")
    assert (out[2].status, out[2].exam_type) == ("low_confidence", "indefinido")
    assert '"exam_date"' not in out[2].doc and '"low_confidence":true' in out[2].doc and '"entities_found":{}' in out[2].doc
    assert out[3].status == "low_confidence" and out[3].raw_text_length == 0


def test_pipeline_does_not_shuffle_and_computes_each_text_once(spark):
    df = spark.range(3).selectExpr("id AS report_id", "'a.pdf' AS filename", "'x' AS text")
    plan = run_pipeline(df).filter("exam_type = 'bera' AND NOT low_confidence")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert plan.count("onda\\s+[IVX]{1,3}") == 1


def test_gates(spark):
    df = spark.createDataFrame([("a.PDF", "x" * 50), ("a.pdf", " " * 90), ("a.png", "x" * 90), (None, "x" * 90)], "filename string, native_text string")
    assert [(r.is_raster, len(r.text)) for r in G.route_text(df).collect()] == [(False, 50), (True, 0), (True, 0), (True, 0)]
    rows = [(1, "b", 2, "xy "), (1, "a", 1, " zz"), (1, "c", 3, None), (2, "a", 1, None)]
    best = G.best_candidate(spark.createDataFrame(rows, "report_id int, strategy string, ord int, text string"))
    assert sorted(map(tuple, best.collect())) == [(1, "zz", "a"), (2, "", "a")]
    pages = [(1, p, f"p{p}" if p % 3 else "") for p in range(1000)]
    joined = G.concat_pages(spark.createDataFrame(pages, "report_id int, page int, text string").repartition(7)).first()
    assert joined.text == "".join(f"p{p}\n" for p in range(1000) if p % 3)
    kept = G.concat_pages(spark.createDataFrame(pages, "report_id int, page int, text string"), skip_empty=False).first()
    assert kept.text == "".join((f"p{p}" if p % 3 else "") + "\n" for p in range(1000))
