"""Lexicon operators: term hits, compound diagnoses, patch suggestions, severity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.regex import first_hit, let
from ..rules import lexicon as L, patterns as R
from .joins import lookup_join
from .textjoin import form_hits

FORMS_PER_CHUNK = 500
#: Tokens of a rule by which reports find it; those beyond are tested one by one.
ENTRY_TOKENS = 3


def kb_stats(terms: DataFrame, weights: Sequence[str] = L.WEIGHTS) -> DataFrame:
    """Terms (or hits) per exam type and weight."""
    counts = terms.groupBy("exam_type").pivot("peso", list(weights)).count()
    return counts.select("exam_type", *[F.coalesce(w, F.lit(0)).alias(w) for w in weights])


def kb_term_hits(
    reports: DataFrame, terms: DataFrame, text: str = "text", key: str = "report_id", weights: Sequence[str] = (L.HIGH,)
) -> DataFrame:
    """``(key, exam_type, termo, peso)`` for every term whose name or variant occurs in the report.

    Terms are packed per exam type into arrays of bounded length, so a report meets a few rows instead of
    one copy of its text per term.
    """
    named = F.array_distinct(F.transform(F.array_append(F.col("variantes"), F.col("termo")), F.lower))
    # A text that holds a form also holds every form inside it, so only the innermost ones are searched.
    forms = F.filter(named, lambda f: ~F.exists(named, lambda g: (g != f) & F.contains(f, g)))
    packed = (
        terms.filter(F.col("peso").isin(*weights))
        .select("exam_type", F.floor(F.col("ord") / FORMS_PER_CHUNK).alias("chunk"), "termo", "peso", forms.alias("forms"))
        .groupBy("exam_type", "chunk")
        .agg(F.collect_list(F.struct("termo", "peso", "forms")).alias("__terms"))
        .drop("chunk")
    )
    low = reports.select(key, "exam_type", F.lower(text).alias("__low"))
    hits = F.filter(
        "__terms", lambda t: F.exists(t["forms"], lambda f: F.contains(F.col("__low"), f))
    )
    return (
        lookup_join(low, packed, "exam_type")
        .select(key, "exam_type", F.explode(hits).alias("t"))
        .select(key, "exam_type", "t.termo", "t.peso")
    )


def kb_term_hits_by_index(
    reports: DataFrame, terms: DataFrame, text: str = "text", key: str = "report_id", weights: Sequence[str] = (L.HIGH,)
) -> DataFrame:
    """The rows of ``kb_term_hits`` for a lexicon of any size: forms are found through an inverted index of their words.

    For some dozens of terms the other function is faster, as it shuffles nothing.
    """
    wanted = terms.filter(F.col("peso").isin(*weights))
    named = F.array_distinct(F.transform(F.array_append(F.col("variantes"), F.col("termo")), F.lower))
    forms = wanted.select("exam_type", "termo", "peso", F.explode(named).alias("form"))
    terms_of = lambda hits: hits.select(key, "exam_type", F.explode("__named").alias("n")).select(key, "exam_type", "n.*").distinct()
    return form_hits(reports, forms, key, text, by=("exam_type",), fold=terms_of)


def compound_diagnoses(
    reports: DataFrame,
    compounds: DataFrame,
    findings: str = "achados",
    key: str = "report_id",
    aliases: Mapping[str, str] = L.TOKEN_ALIASES,
    text: str | None = None,
    patterns: Mapping[str, Sequence[tuple[str, str]]] = L.TOKEN_PATTERNS,
) -> DataFrame:
    """``(key, exam_type, condicao, diagnostico)`` for every rule whose tokens are all among the findings.

    A relational division by levels: a rule is filed under its first ``ENTRY_TOKENS`` tokens in order, a report grows its
    findings into such entries one token at a time, and only entries with which some rule begins grow on. So a report
    meets the rules that have all of those tokens, and only rules of more tokens are tested for the rest. With ``text``,
    tokens that no parser reports are found in it by ``patterns`` of the row's exam type.
    """
    required = F.split("condicao", r" \+ ")
    if aliases:
        names = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
        required = F.transform(required, lambda t: F.coalesce(F.try_element_at(names, t), t))
    known = F.coalesce(F.col(findings), F.array().cast("array<string>"))
    if text is not None:
        known = F.array_union(known, found_tokens(F.col(text), F.col("exam_type"), patterns))
    rules = compounds.select("exam_type", "condicao", "diagnostico", F.array_sort(F.array_distinct(required)).alias("__required")).distinct()
    found = reports.select(key, "exam_type", F.array_sort(F.array_distinct(known)).alias("__found"))
    # Outer, or the optimizer tests for empty findings first and computes them twice; no rule has a null token.
    found = found.select("*", F.explode_outer("__found").alias("__first")).select("*", F.array("__first").alias("__tokens")).drop("__first")
    for size in range(1, ENTRY_TOKENS):
        begun = rules.select("exam_type", F.slice("__required", 1, size).alias("__tokens")).distinct()
        found = found.join(begun, ["exam_type", "__tokens"], "left_semi")
        later = F.filter("__found", lambda t: t > F.element_at("__tokens", -1))
        grown = F.transform(later, lambda t: F.array_append("__tokens", t))
        entries = F.when(F.size("__tokens") == size, F.concat(F.array("__tokens"), grown)).otherwise(F.array("__tokens"))
        found = found.select(key, "exam_type", "__found", F.explode(entries).alias("__tokens"))
    filed = rules.select("*", F.slice("__required", 1, ENTRY_TOKENS).alias("__tokens"))
    whole = (F.size("__required") <= ENTRY_TOKENS) | (F.size(F.array_except("__required", "__found")) == 0)
    return (
        found.join(filed, ["exam_type", "__tokens"])
        .filter(whole)
        .select(key, "exam_type", "condicao", "diagnostico")
    )


def found_tokens(text: Column, exam_type: Column, patterns: Mapping[str, Sequence[tuple[str, str]]] = L.TOKEN_PATTERNS) -> Column:
    """Tokens of the exam type whose pattern occurs in the text."""
    low = F.lower(text)
    out = F.array().cast("array<string>")
    for kind, rules in patterns.items():
        hits = F.array_compact(F.array(*[F.when(F.rlike(low, F.lit(p)), F.lit(token)) for token, p in rules]))
        out = F.when(exam_type == kind, hits).otherwise(out)
    return out


def kb_patch_suggestions(
    feedback: DataFrame, terms: DataFrame, watch: Sequence[str] = R.WATCH_WORDS
) -> DataFrame:
    """Watch words that occur in corrections but in no term of that exam type.

    Distinct pairs are made before the lexicon is looked at, so only (types x words) rows are joined.
    """
    low = F.lower("corrected_text")
    words = F.filter(F.array(*[F.lit(w) for w in watch]), lambda w: F.contains(F.col("__low"), w))
    pairs = (
        feedback.select("exam_type", low.alias("__low"))
        .select("exam_type", F.explode(words).alias("word"))
        .distinct()
        .alias("p")
    )
    t = terms.select("exam_type", "termo").alias("t")
    known = (F.col("p.exam_type") == F.col("t.exam_type")) & F.contains(F.col("t.termo"), F.col("p.word"))
    return pairs.join(t, known, "left_anti")


def apnea_index(text: Column) -> Column:
    """Number that follows the apnoea index in a text, NULL if there is none."""
    return F.replace(first_hit(text, [R.AHI]), F.lit(","), F.lit(".")).try_cast("double")


def severity_by_range(value: Column, bands: Sequence[tuple[float, str]] = R.AHI_BANDS) -> Column:
    """Name of the highest band whose lower bound the value reaches."""

    def pick(v: Column) -> Column:
        column = F.lit(None).cast("string")
        for bound, name in reversed(list(bands)):
            column = F.when(v >= bound, F.lit(name)).otherwise(column)
        return column

    return let(value, pick)
