import itertools
import random

import pytest
from pyspark.sql import functions as F

from laudospark.operators import knowledge as K, textjoin as T
from laudospark.sources.lexicon import builtin_lexicon


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def by_force(texts, forms):
    out = set()
    for key, kind, text in texts:
        for k, form in forms:
            if form and text is not None and k == kind and form.lower() in text.lower():
                out.add((key, kind, form.lower()))
    return out


def made(seed=1):
    rnd = random.Random(seed)
    letters = "abcdé"
    words = ["".join(rnd.choice(letters) for _ in range(rnd.choice([1, 2, 3, 4, 6]))) for _ in range(60)]
    breaks = [" ", " ", ", ", ".\n", "-", "  "]

    def text(n):
        return "".join(rnd.choice(words) + rnd.choice(breaks) for _ in range(n))

    texts = [(i, rnd.choice("xy"), text(rnd.choice([0, 1, 5, 40]))) for i in range(60)] + [(100, "x", None), (101, "x", "÷ + ÷"), (102, None, "abc")]
    forms = []
    for _ in range(400):  # cut anywhere out of texts, so that both ends may lie within words
        t = rnd.choice(texts[:60])[2] or "ab"
        at = rnd.randrange(len(t))
        forms.append((rnd.choice("xy"), t[at : at + rnd.choice([1, 2, 3, 5, 9, 17])]))
    forms += [("x", "zzz nowhere"), ("x", "÷ + ÷"), ("y", "+"), ("x", ""), ("x", None), ("x", "ABC"), ("y", "é"), ("x", "nicht-da "), ("x", texts[3][2][:5].upper())]
    return texts, forms


@pytest.mark.parametrize("per_row", [1, 256])
def test_form_hits_equal_brute_force(spark, monkeypatch, per_row):
    monkeypatch.setattr(T, "FORMS_PER_ROW", per_row)
    texts, forms = made()
    t = spark.createDataFrame(texts, "k int, kind string, text string")
    f = spark.createDataFrame(forms, "kind string, form string")
    got = T.form_hits(t, f, "k", by=("kind",)).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {(r.k, r.kind, r.form) for r in got} == by_force(texts, forms)
    loose = T.form_hits(t, f.select("form"), "k").collect()
    assert {(r.k, r.form) for r in loose} == {(k, f) for k, _, f in by_force([(k, 0, t) for k, _, t in texts], [(0, f) for _, f in forms])}


def test_scores_and_classes_by_a_rule_table(spark):
    rules = spark.createDataFrame([("b", "alfa"), ("b", "beta"), ("a", "alfa"), ("a", "gama"), ("a", "GAMA")], "exam_type string, form string")
    texts = spark.createDataFrame([(1, "Alfa e beta"), (2, "alfabeto"), (3, "nada"), (4, None), (5, "gama alfa beta")], "k int, text string")
    assert {(r.k, r.exam_type, r.score) for r in T.rule_scores(texts, rules, "k").collect()} == {
        (1, "a", 1), (1, "b", 2), (2, "a", 1), (2, "b", 1), (5, "a", 2), (5, "b", 2),
    }
    got = {r.k: (r.exam_type, r.score) for r in T.classify_by_rules(texts, rules, "k", default="generico").collect()}
    assert got == {1: ("b", 2), 2: ("a", 1), 3: ("generico", 0), 4: ("generico", 0), 5: ("a", 2)}


def test_lexicon_hits_are_the_same_by_index(spark):
    terms, _ = builtin_lexicon(spark)
    rows = [(i, kind, f"Laudo: {form.upper()}, sem mais.") for i, (kind, form) in enumerate((r.exam_type, f) for r in terms.collect() for f in [*r.variantes, r.termo])]
    reports = spark.createDataFrame(rows, "report_id int, exam_type string, text string")
    weights = ("ALTO", "MÉDIO", "BAIXO")
    plain = {tuple(r) for r in K.kb_term_hits(reports, terms, weights=weights).collect()}
    assert {tuple(r) for r in K.kb_term_hits_by_index(reports, terms, weights=weights).collect()} == plain and len(plain) >= len(rows)


def test_no_text_meets_all_rules_of_its_class(spark):
    """Every join of the plan has a word, a run of characters or the text's own key among its keys."""
    t = spark.createDataFrame([(1, "x", "a b")], "k int, kind string, text string")
    f = spark.createDataFrame([("x", "a b c")], "kind string, form string")
    joins = [line for line in plan_of(T.form_hits(t, f, "k", by=("kind",))).splitlines() if " Join " in line or line.strip().startswith("Join")]
    alone = [j for j in joins if "(kind#" in j and not any(w in j for w in ("(word#", "(run#", "(k#", "(part#"))]
    assert len(joins) >= 6 and len(alone) == 1  # forms without a letter or digit


def test_rules_by_division(spark):
    rnd = random.Random(5)
    tokens = [f"t{i}" for i in range(30)]
    rules = [(rnd.choice("ab"), " + ".join(rnd.sample(tokens, rnd.choice([1, 2, 3, 3]))), f"d{i}") for i in range(300)]
    rules.append(("a", "t1 + t1", "twice"))
    reports = [(i, rnd.choice(["a", "b", "c", None]), rnd.sample(tokens, rnd.randrange(12)) + ["t1"] * (i % 2)) for i in range(80)] + [(99, "a", None)]
    want = {(i, k, c, d) for i, k, found in reports for kind, c, d in rules if k == kind and found is not None and set(c.split(" + ")) <= set(found)}
    r = spark.createDataFrame(reports, "report_id int, exam_type string, achados array<string>")
    c = spark.createDataFrame(rules, "exam_type string, condicao string, diagnostico string")
    df = K.compound_diagnoses(r, c, aliases={})
    got = df.collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want)
    plan = plan_of(df)
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and all("token" in j for j in joins), plan


def joined_rows(df):
    """Rows that each join of a plan made that was run once."""
    query = df._jdf.queryExecution()
    out, todo = [], [query.executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            todo += [node.children().apply(i) for i in range(node.children().size())]
        if "Join" in name:
            out.append(node.metrics().apply("numOutputRows").value())
    return out


def test_reports_meet_only_rules_whose_tokens_they_have(spark):
    """Before, a report met every rule filed under any one of its findings."""
    tokens = [f"t{i:02}" for i in range(20)]
    rules = [("a", " + ".join(c), "d") for n in (1, 2, 3, 4, 5) for c in itertools.combinations(tokens[: 20 if n < 4 else 8], n)]
    reports = [(i, "a", [tokens[(i + j * 7) % 20] for j in range(4)]) for i in range(40)]
    r = spark.createDataFrame(reports, "report_id int, exam_type string, achados array<string>")
    c = spark.createDataFrame(rules, "exam_type string, condicao string, diagnostico string")
    want = {(i, k, cond, d) for i, k, found in reports for _, cond, d in rules if set(cond.split(" + ")) <= set(found)}
    df = K.compound_diagnoses(r, c, aliases={})
    assert {tuple(x) for x in df.collect()} == want
    assert max(joined_rows(df)) <= 1.5 * len(want)


def test_costly_columns_of_texts_are_computed_once(spark):
    """Before, each of the joins computed them anew."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def costly(text):
        seen.add(1)
        return text

    texts = spark.createDataFrame([(i, f"alfa beta gama {i}") for i in range(20)], "k int, text string").withColumn("text", costly("text"))
    forms = spark.createDataFrame([("beta gama",), ("lfa be",), ("-",)], "form string")
    assert T.form_hits(texts, forms, "k").count() == 40
    assert seen.value == 20


def test_forms_meet_a_text_only_where_their_words_are_neighbours(spark, monkeypatch):
    """Before, every text that held a form's rarest word was searched for the form."""
    monkeypatch.setattr(T, "FORMS_PER_ROW", 1)
    words = [3 * c for c in "abcdefghijkl"]
    texts = [(i, " x ".join(words)) for i in range(30)] + [(30, "aaa bbb ccc, ddd")]
    forms = [" ".join(c) for c in itertools.permutations(words, 2)] + ["aa bbb c", "ccc, d"]
    df = T.form_hits(spark.createDataFrame(texts, "k int, text string"), spark.createDataFrame([(x,) for x in forms], "form string"), "k")
    assert {tuple(r) for r in df.collect()} == {(30, x) for x in ("aaa bbb", "bbb ccc", "aa bbb c", "ccc, d")}
    assert max(joined_rows(df)) < 30 * len(words)


def test_forms_longer_than_their_surroundings(spark):
    """What passes around a place is searched in the whole text, with the gaps as they are."""
    texts = [(1, "alfa beta, gama delta epsilon zeta eta"), (2, "alfa beta gama delta epsilon zeta"), (3, "beta, gama delta epsilon - zeta et"), (4, "gama delta epsilon zeta eta alfa beta,")]
    forms = ["beta, gama delta epsilon zeta", "ta, gama delta epsilon zeta e", "lfa beta gama delta epsilon ze", "epsilon - zeta et", "a beta,", ", gama d", "zeta eta alfa beta, "]
    t = spark.createDataFrame(texts, "k int, text string")
    got = {tuple(r) for r in T.form_hits(t, spark.createDataFrame([(x,) for x in forms], "form string"), "k").collect()}
    assert got == {(k, x) for k, text in texts for x in forms if x in text} and len(got) > 6


@pytest.mark.parametrize("by", [("kind",), ()])
def test_slices_of_texts_have_the_same_hits(spark, monkeypatch, by):
    """Before, the places of all texts were shuffled at once; hits are now written slice by slice, those without a key too."""
    monkeypatch.setattr(T, "SLICE", 2000)
    written = []
    plain = T.stored
    monkeypatch.setattr(T, "stored", lambda df, name: written.append(name) or plain(df, name))
    texts, forms = made(2)
    texts.append((None, "x", "abc e zzz nowhere"))
    t = spark.createDataFrame(texts, "k int, kind string, text string")
    f = spark.createDataFrame(forms, "kind string, form string")
    got = T.form_hits(t, f.select(*by, "form"), "k", by=by).collect()
    assert len(got) == len({tuple(r) for r in got}) and written.count("hits") >= 2
    if by:
        assert {(r.k, r.kind, r.form) for r in got} == by_force(texts, forms)
    else:
        assert {(r.k, r.form) for r in got} == {(k, f) for k, _, f in by_force([(k, 0, t) for k, _, t in texts], [(0, f) for _, f in forms])}


def test_forms_of_two_parts_of_words_are_filed_once(spark):
    """Before, such a form was filed under every word that its rarer part may belong to."""
    words = [a + b + "e" for a in "abcdefgh" for b in "klmnopqr"] + ["th" + a + b for a in "abcdefgh" for b in "klmnopqr"]
    texts = spark.createDataFrame([(i, f"{w} {words[-i]}, {w}") for i, w in enumerate(words)], "k int, text string")
    forms = spark.createDataFrame([("e th",), ("e, t",), ("ke tha",)], "form string")
    assert T.form_hits(texts, forms, "k").count() == sum(f in t for _, t in texts.collect() for f in ("e th", "e, t", "ke tha")) > 60
    vocabulary = texts.select(F.explode(F.split("text", ",? ")).alias("word")).groupBy("word").agg(F.count("*").alias("texts"))
    assert T.anchored(forms, vocabulary, []).count() == 3


def test_only_places_under_which_a_form_is_filed_are_shuffled(spark):
    """Before, each word of a text was shuffled up to three times with the words around it."""
    texts = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(3000)))], "k int, __low string")
    filed = T.filed_under(F.lit(">"), F.lit("w7"), F.lit(" "), F.lit("w8$"))
    rows = spark.range(1).select(filed.alias("word"))
    places = T.text_places(texts, "k", [], T.sieve(rows, "word")).collect()
    assert "w6 w7 w8 w9 " in {r["__near"].strip() + " " for r in places} and len(places) < 10
