"""Redaction of personal data: a list of rules, each applied to the output of the one before."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from ..rules import patterns as R
from .regex import let, nocase
from .text import strip

Rule = tuple[str, str, str]


def pseudonym(name: Column) -> Column:
    """Short stable stand-in for a name."""
    return F.concat(F.lit("[Paciente_"), F.upper(F.left(F.sha2(name, 256), F.lit(6))), F.lit("]"))


# Private-use characters that fence a match off; a text that holds one itself takes the slower way.
FENCE, INNER = "\ue000", "\ue001"


def _stand_in(label: Column, name: Column) -> Column:
    clean = strip(name)
    shown = F.when(clean != "", pseudonym(clean)).otherwise(F.lit("[NOME PROTEGIDO]"))
    return F.concat(label, F.lit(" "), shown)


def pseudonymize(c: Column, pattern: str) -> Column:
    """Replace every labelled name (group 2) by its pseudonym, keeping the label (group 1).

    Spark's ``regexp_replace`` cannot compute a replacement. So the matches are fenced off, the text is
    cut at the fences, and every other piece is rewritten.
    """
    p = nocase(pattern)

    def rewrite(piece: Column, i: Column) -> Column:
        pair = F.split(piece, INNER)
        return F.when(i % 2 == 1, _stand_in(pair[0], pair[1])).otherwise(piece)

    def by_fence(text: Column) -> Column:
        fenced = F.regexp_replace(text, p, f"{FENCE}$1{INNER}$2{FENCE}")
        return let(
            fenced,
            lambda f: F.when(
                F.contains(f, F.lit(FENCE)), F.array_join(F.transform(F.split(f, FENCE), rewrite), "")
            ).otherwise(f),
        )

    def by_matches(text: Column) -> Column:
        gaps = F.split(text, p, -1)
        labels, names = (F.regexp_extract_all(text, F.lit(p), F.lit(i)) for i in (1, 2))
        tails = F.slice(gaps, 2, F.size(labels))
        pieces = F.zip_with(F.zip_with(labels, names, _stand_in), tails, lambda a, b: F.concat(a, b))
        return F.concat(gaps[0], F.array_join(pieces, ""))

    def either(text: Column) -> Column:
        fences = F.contains(text, F.lit(FENCE)) | F.contains(text, F.lit(INNER))
        return F.when(fences, by_matches(text)).otherwise(by_fence(text))

    return let(c, either)


def apply_rule(c: Column, rule: Rule) -> Column:
    _, pattern, replacement = rule
    if replacement == R.PSEUDONYM:
        return pseudonymize(c, pattern)
    return F.regexp_replace(c, nocase(pattern), replacement)


def strip_pii(c: Column, rules: Sequence[Rule] = R.PII_RULES) -> Column:
    """Apply all rules in order; NULL becomes ``''``."""
    return reduce(apply_rule, rules, F.coalesce(c, F.lit("")))


def pii_counts(c: Column, rules: Sequence[Rule] = R.PII_RULES) -> list[Column]:
    """One count of matches per rule, on the text as given."""
    return [F.regexp_count(c, F.lit(nocase(pattern))).alias(f"n_{key}") for key, pattern, _ in rules]


