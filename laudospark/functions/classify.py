"""Exam classification: count the patterns that occur per exam type, take the best type."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from ..rules import patterns as R
from .regex import found, per_application

Rules = Mapping[str, Sequence[str]]


def exam_score(low: Column, patterns: Sequence[str], compat: bool = True) -> Column:
    """How many of the patterns occur in the lower-cased text."""
    hits = [F.when(found(low, p, compat), F.lit(1)).otherwise(F.lit(0)) for p in patterns]
    return reduce(lambda a, b: a + b, hits)


def exam_scores(low: Column, rules: Rules = R.EXAM_PATTERNS, compat: bool = True) -> Column:
    """Array of ``(exam_type, score)`` in declaration order."""
    return F.array(
        *[
            F.struct(F.lit(name).alias("exam_type"), exam_score(low, pats, compat).alias("score"))
            for name, pats in rules.items()
        ]
    )


def classify_exam(
    low: Column, rules: Rules = R.EXAM_PATTERNS, default: str = R.UNKNOWN_EXAM, compat: bool = True
) -> Column:
    """Type with the highest score; the earlier type wins a tie; ``default`` when nothing occurs."""
    nothing = F.struct(F.lit(0).alias("score"), F.lit(1).alias("rank"), F.lit(default).alias("name"))
    ranked = [
        F.struct(exam_score(low, pats, compat).alias("score"), F.lit(-i).alias("rank"), F.lit(name).alias("name"))
        for i, (name, pats) in enumerate(rules.items())
    ]
    return F.coalesce(F.array_max(F.array(nothing, *ranked))["name"], F.lit(default))


@per_application
def exam_type_of(low: str, compat: bool = True) -> Column:
    """``classify_exam`` with the built-in rules over the named lower-cased column."""
    return classify_exam(F.col(low), compat=compat)


def exam_label(exam_type: Column, labels: Mapping[str, str] = R.EXAM_LABELS) -> Column:
    """Display label of an exam type; the label of the unknown type for any other value."""
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(table, exam_type), F.lit(labels[R.UNKNOWN_EXAM]))
