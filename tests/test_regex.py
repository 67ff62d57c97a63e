"""The byte-search guards and Java flags give the same hits as a plain search with the tables' patterns."""

import random
import re

import pytest
from pyspark.sql import functions as F

from laudospark.functions.regex import found, label_patterns, ladder, literal_runs, one_line
from laudospark.functions.text import BLANKS, strip, unify_lines
from laudospark.rules import patterns as R

LADDERS = [R.LOSS_TYPE, R.EAR_SIDE, R.LOSS_DEGREE, R.CT_SIDE, R.MASTOID_SIDE]
LABELLED = [R.AUDIO_SUGGESTIONS, R.CT_FINDINGS, R.MASTOID_FINDINGS, R.NECK_FINDINGS]
EXAM = [p for ps in R.EXAM_PATTERNS.values() for p in ps]
ALL = EXAM + [p for table in LADDERS + LABELLED for p, _ in table]
WORDS = (
    "audiometria audiograma limiar tonal vocal 4 kHz dB NA SRT IPRF IRF discriminação de fala BERA potencial evocado "
    "auditivo onda III latência absoluta eletrofisiológico PEATE laringe glote pregas prega paralisia nódulo edema Reinke "
    "endoscopia nasal meato médio corneto septo polipose adenóide tomografia de mastóide TC mastoide ossos temporais orelha "
    "célula mastóidea tegmen tympani cadeia ossicular colesteatoma ebúrnea pescoço espaço parafaríngeo linfonodomegalia "
    "cervical glândula parótida cisto branquial ducto tireoglosso seios da face TCFC seio maxilar espessamento mucoso Haller "
    "Onodi polissonografia iah índice apneia hipopneia sono rem dessaturação perda auditiva mista condutiva neurossensorial "
    "bilateral ao direita od à esquerda oe grau profundo severo moderado a leve anacusia normoacusia velamento total nível "
    "líquido hidro-aéreo desvio do concha bolhosa retenção pólipo obliteração dos óstio erosão ossicular do tegmen deiscência "
    "Falópio fístula canal semicircular perfuração timpânica otite média crônica OMC necrose central na tireoide tumor de OD"
).split()


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        words = [rng.choice(WORDS) for _ in range(rng.randint(1, 12))]
        if rng.random() < 0.3:
            start = rng.randrange(len(WORDS) - 4)
            words += WORDS[start : start + 4]
        rows.append((i, rng.choice([" ", "  ", "\n", ", "]).join(words).replace(",", rng.choice([",", "", "."]))))
    df = spark.createDataFrame(rows, "id long, t string").withColumn("low", F.lower("t")).repartition(4).cache()
    return dict(rows), df


def test_found_equals_plain_search(texts):
    plain, df = texts
    got = {r.id: r for r in df.select("id", *[found(F.col("low"), p).alias(f"p{i}") for i, p in enumerate(ALL)]).collect()}
    hits = 0
    for key, text in plain.items():
        for i, p in enumerate(ALL):
            expected = re.search(p, text.lower()) is not None
            hits += expected
            assert got[key][f"p{i}"] == expected, (p, text)
    assert hits > 2000


def test_mended_patterns_ignore_case(texts):
    plain, df = texts
    caps = [p for p in EXAM if re.search("[A-Z]", p)]
    assert len(caps) == 14
    got = df.select("id", *[found(F.col("low"), p, compat=False).alias(f"p{i}") for i, p in enumerate(caps)]).collect()
    for r in got:
        for i, p in enumerate(caps):
            assert r[f"p{i}"] == (re.search(p, plain[r.id], re.I) is not None), (p, plain[r.id])


def test_ladders_and_labels(texts):
    plain, df = texts
    cols = [ladder(F.col("low"), t).alias(f"l{i}") for i, t in enumerate(LADDERS)]
    cols += [label_patterns(F.col("low"), t).alias(f"s{i}") for i, t in enumerate(LABELLED)]
    for r in df.select("id", *cols).collect():
        low = plain[r.id].lower()
        for i, table in enumerate(LADDERS):
            assert r[f"l{i}"] == next((v for p, v in table if re.search(p, low)), None)
        for i, table in enumerate(LABELLED):
            assert (r[f"s{i}"] or []) == [v for p, v in table if re.search(p, low)]


def test_literal_runs():
    assert literal_runs("corneto") == [(["corneto"], True)]
    assert literal_runs(r"prega[s]?\s+vocal") == [(["prega", "vocal"], False)]
    assert literal_runs(r"tomografia\s+(de\s+)?mast[oó]ide") == [(["tomografia", "mast", "ide"], False)]
    assert literal_runs("adenoide|aden[oó]ide") == [(["adenoide"], True), (["aden", "ide"], False)]
    assert literal_runs(r"c[eé]lulas?x") == [(["c", "lula", "x"], False)]
    assert literal_runs(r"a\.b") == [(["a.b"], True)]


def test_one_line():
    assert one_line(r"a\s+b") == r"a[^\S\n]+b"


@pytest.mark.parametrize("text", ["", "  a b \n", BLANKS + "x y" + BLANKS, " z\x1f", "\x85"])
def test_strip(one, text):
    assert one(text, strip) == text.strip()


@pytest.mark.parametrize("text", ["a\r\nb\rc\x0bd e\n", "plain\ntext", "x\x85\x1cy"])
def test_unify_lines(one, text):
    end = "\n" if text.endswith("\n") else ""
    assert one(text, unify_lines) == "\n".join(text.splitlines()) + end
