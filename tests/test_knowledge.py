import json

from pyspark.sql import functions as F

from laudospark.operators import cases, knowledge as K, prompts as PR
from laudospark.rules import prompts as P
from laudospark.sources.lexicon import builtin_lexicon, read_lexicon

LEXICON = """{
 "bera": {"achados_discriminativos": [{"termo": "velho", "variantes": [], "peso": "ALTO", "significado": "x"}]},
 "tomografia": {"achados_discriminativos": [
    {"termo": "concha bolhosa", "variantes": ["corneto bolhoso"], "peso": "ALTO", "significado": "m1"},
    {"termo": "Torus", "variantes": ["COM"], "peso": "BAIXO", "significado": "m2"}],
  "diagnosticos_compostos": [{"condicao": "a + b", "diagnostico": "AB", "justificativa": "j"}]},
 "bera": {"achados_discriminativos": [{"termo": "novo", "variantes": ["nova"], "peso": "MÉDIO", "significado": "y"}]}
}"""


FORMS = {"tomografia": 59, "tomografia_mastoide": 38, "tomografia_pescoco": 30, "audiometria": 43, "bera": 15, "videolaringoscopia": 19, "endoscopia_nasal": 20, "polissonografia": 31}


def test_builtin_counts(spark):
    terms, compounds = builtin_lexicon(spark)
    stats = {r.exam_type: (r["ALTO"], r["MÉDIO"], r["BAIXO"]) for r in K.kb_stats(terms).collect()}
    totals = {k: sum(v) for k, v in stats.items()}
    assert totals == {
        "tomografia": 16, "tomografia_mastoide": 9, "tomografia_pescoco": 8, "audiometria": 12, "bera": 5,
        "videolaringoscopia": 6, "endoscopia_nasal": 5, "polissonografia": 11,
    }
    assert sum(v[0] for v in stats.values()) == 46 and compounds.count() == 11
    forms = {r.exam_type: r.n for r in terms.groupBy("exam_type").agg(F.sum(F.size("variantes")).alias("n")).collect()}
    assert forms == FORMS and sum(forms.values()) == 255


def test_forms_that_reports_use(spark):
    terms, _ = builtin_lexicon(spark)
    texts = {
        "tomografia": ["infundibulo", "conteúdo líquido", "crista óssea septal", "vias de drenagem obliteradas"],
        "audiometria": ["carhart notch", "gota acústica"], "polissonografia": ["iah grave"],
    }
    rows = [(f"{k}: {t}", k, f"laudo com {t.upper()} descrito") for k, ts in texts.items() for t in ts]
    hits = K.kb_term_hits(spark.createDataFrame(rows, "report_id string, exam_type string, text string"), terms)
    assert {r.report_id for r in hits.collect()} == {r[0] for r in rows}


def test_every_compound_rule_can_fire(spark):
    _, compounds = builtin_lexicon(spark)
    texts = [
        ("tomografia", "espessamento mucoso e nível líquido"), ("tomografia", "infundíbulo obliterado, desvio do septo"),
        ("tomografia", "curvatura paradoxal do corneto, obliteração do infundíbulo"), ("tomografia", "velamento total com nível hidroaéreo"),
        ("tomografia_mastoide", "colesteatoma e erosão ossicular"), ("tomografia_mastoide", "mastóide velada, erosão do tegmen"),
        ("tomografia_mastoide", "colesteatoma com fístula labiríntica"), ("tomografia_pescoco", "linfonodomegalia com necrose central"),
        ("tomografia_pescoco", "massa na parótida, paralisia facial"), ("audiometria", "entalhe em 4khz após exposição a ruído"),
        ("audiometria", "gap aéreo-ósseo com entalhe de carhart"),
    ]
    df = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(texts)], "report_id int, exam_type string, text string")
    from laudospark.functions.entities import extract_entities

    df = df.withColumn("achados", extract_entities(F.col("text"), F.col("exam_type"))["achados"])
    got = K.compound_diagnoses(df, compounds, text="text")
    assert {r.report_id for r in got.collect()} == set(range(11))
    assert got.select("exam_type", "condicao").distinct().count() == 11
    assert K.compound_diagnoses(df.withColumn("text", F.lit("sem achados")).drop("achados").withColumn("achados", F.lit(None).cast("array<string>")), compounds, text="text").count() == 0


def test_read_lexicon(spark, tmp_path):
    (tmp_path / "kb.json").write_text(LEXICON, encoding="utf-8")
    terms, compounds = read_lexicon(spark, str(tmp_path / "kb.json"))
    assert sorted((r.exam_type, r.ord, r.termo) for r in terms.collect()) == [
        ("bera", 1, "novo"), ("tomografia", 1, "concha bolhosa"), ("tomografia", 2, "Torus"),
    ]
    assert [tuple(r) for r in compounds.collect()] == [("tomografia", 1, "a + b", "AB", "j")]
    none, _ = read_lexicon(spark, str(tmp_path / "missing.json"))
    assert none.count() == 0


def test_hits_and_compounds(spark, tmp_path):
    (tmp_path / "kb.json").write_text(LEXICON, encoding="utf-8")
    terms, compounds = read_lexicon(spark, str(tmp_path / "kb.json"))
    reports = spark.createDataFrame(
        [(1, "tomografia", "CORNETO BOLHOSO e torus", ["b", "a", "c"]), (2, "tomografia", "com", ["a"]), (3, "bera", "Nova", None), (4, None, "torus", [])],
        "report_id int, exam_type string, text string, achados array<string>",
    )
    assert [(r.report_id, r.termo) for r in K.kb_term_hits(reports, terms).collect()] == [(1, "concha bolhosa")]
    every = K.kb_term_hits(reports, terms, weights=("ALTO", "MÉDIO", "BAIXO")).collect()
    assert sorted((r.report_id, r.termo) for r in every) == [(1, "Torus"), (1, "concha bolhosa"), (2, "Torus"), (3, "novo")]
    assert [(r.report_id, r.diagnostico) for r in K.compound_diagnoses(reports, compounds).collect()] == [(1, "AB")]
    aliased = K.compound_diagnoses(reports, compounds, aliases={"b": "a"}).collect()
    assert sorted(r.report_id for r in aliased) == [1, 2]


def test_patch_suggestions(spark, tmp_path):
    (tmp_path / "kb.json").write_text(LEXICON, encoding="utf-8")
    terms, _ = read_lexicon(spark, str(tmp_path / "kb.json"))
    feedback = spark.createDataFrame(
        [("tomografia", "Concha BOLHOSA paradoxal"), ("tomografia", "paradoxal"), ("bera", "bolhosa"), (None, "corneto")], "exam_type string, corrected_text string"
    )
    got = sorted(map(tuple, K.kb_patch_suggestions(feedback, terms).collect()), key=repr)
    assert got == sorted([("bera", "bolhosa"), ("tomografia", "paradoxal"), (None, "corneto")], key=repr)


def test_prompts(spark, tmp_path):
    (tmp_path / "kb.json").write_text(LEXICON, encoding="utf-8")
    terms, compounds = read_lexicon(spark, str(tmp_path / "kb.json"))
    conditions = spark.createDataFrame(
        [("tomografia", 1, "Cond", ["J32", "J33"], ["f1", "f2", "f3", "f4"])], "exam_type string, ord int, nome string, cid10 array<string>, achados_chave array<string>"
    )
    blocks = PR.lexical_blocks(terms, compounds, conditions)
    block = {r.exam_type: r.block for r in blocks.collect()}
    assert list(block) == ["tomografia"]  # no high-weight term, no block
    assert block["tomografia"].split("\n") == [
        P.BLOCK_TITLE, '  - "concha bolhosa" (também: corneto bolhoso): m1', "", P.COMPOUND_TITLE, "  - a + b → AB", "",
        P.CONDITION_TITLE, "  - Cond (J32, J33): f1; f2; f3",
    ]
    rows = spark.createDataFrame([("tomografia", "T"), ("bera", "B"), ("tomografia_mastoide", "M")], "exam_type string, safe_body string")
    prompts = {r.exam_type: r.prompt for r in PR.build_prompts(rows, blocks).collect()}
    assert prompts["tomografia"] == "\n\n".join([P.BASE_PROMPTS["tomografia"], block["tomografia"], P.TEXT_TITLE + '\n"""\nT\n"""'])
    assert prompts["bera"].startswith(P.BASE_PROMPTS["bera"] + "\n\n" + P.TEXT_TITLE)
    assert prompts["tomografia_mastoide"].startswith(P.BASE_PROMPTS["generico"])


def test_model_answers(spark):
    answers = ['{"summary": "s", "findings": ["a"], "diagnostics": []}', "lixo", None, '{"error": "e"}', '{"is_valid_exam": false, "summary": "", "findings": [], "diagnostics": []}', '["x"]', '{"is_valid_exam": false, "summary": "s", "findings": []}']
    df = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, a string")
    rows = {r.i: r.p for r in df.select("i", cases.parse_llm_output(F.col("a")).alias("p")).collect()}
    assert rows[0].asDict() == {
        "is_valid_exam": True, "summary": "s", "findings": ["a"], "normal_standards": None, "diagnostics": [], "succinct_insight": "", "error": None,
    }
    assert [rows[i].error for i in (1, 2, 3)] == ["unreadable answer", "no answer", "e"]
    assert rows[4].is_valid_exam is False and rows[1].findings == []
    assert rows[6].error == "missing field" and rows[6].is_valid_exam is True


def test_drifting_cases(spark):
    docs = [
        {"dados_demograficos": {"nome": "N", "sexo": "F", "idade": "54 anos"}, "parecer_audiologico": {"od": "leve", "oe": "x"}, "valores_exame": {"LRF_OD": "20dB", "LRF_OE": 15}},
        {"dados_demograficos": {"sexo": "Masculino", "idade": 61, "data_exame": "d"}, "parecer_audiologico": "normal", "valores_exame": {"IPRF_OD": None}},
    ]
    rows = [(f"f{i}", f"```json\n{json.dumps(d)}\n```") for i, d in enumerate(docs)] + [("f2", "nada"), ("f3", "```json\n{quebrado\n```")]
    got = {r.filename: r for r in cases.normalize_cases(spark.createDataFrame(rows, "filename string, answer string")).collect()}
    assert (got["f0"].sexo, got["f0"].idade_anos, got["f0"].parecer, got["f0"].parecer_od, got["f0"].lrf_od_db, got["f0"].lrf_oe_db) == ("Feminino", 54, None, "leve", 20, 15)
    assert (got["f1"].sexo, got["f1"].idade_anos, got["f1"].parecer, got["f1"].iprf_od_pct) == ("Masculino", 61, "normal", None)
    assert got["f2"].sexo is None and got["f3"].idade_anos is None and "nome" not in got["f0"].asDict()
