"""Regular expressions with the semantics of the rule tables.

The tables are written for an engine with Unicode ``\\w \\s \\d \\b``, Unicode case folding and ``$``
that stops only before a final ``\\n``. In Java that is ``(?U)``, ``(?iU)`` and ``(?d)``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import lru_cache, reduce, wraps

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_TOKEN = re.compile(r"\\.|\[(?:\\.|[^\]\\])*\]|\{[^}]*\}|.", re.S)


def exact(pattern: str) -> str:
    """The pattern as a case-sensitive Java regex."""
    return "(?dU)" + pattern


def nocase(pattern: str) -> str:
    """The pattern as a case-insensitive Java regex."""
    return "(?idU)" + pattern


def one_line(pattern: str) -> str:
    """The pattern with blanks that may not cross a line end (for multi-line searches)."""
    return pattern.replace(r"\s", r"[^\S\n]")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def per_application(build: Callable[..., Column]) -> Callable[..., Column]:
    """Keep the Columns a function builds from column names and flags.

    A rule set becomes thousands of expression nodes, made one by one from Python; a session that runs
    the same rules again takes the finished (still unresolved) expression.
    """
    kept = lru_cache(maxsize=32)(lambda application, *args: build(*args))
    return wraps(build)(lambda *args: kept(SparkSession.active().sparkContext.applicationId, *args))


def compute_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column so that it is computed once per row.

    A filter or join on a projected column is pushed below the projection together with a copy of its
    expression, which then runs twice. A generated column is not copied.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def literal_runs(pattern: str) -> list[tuple[list[str], bool]]:
    """For each top-level alternative: strings that every match contains, and whether it is one literal.

    Groups, classes and repeated characters are skipped, so the runs are a safe (not complete) list.
    """
    alternatives = []
    runs, run, depth, literal = [], "", 0, True
    for token in _TOKEN.findall(pattern):
        if token == "|" and depth == 0:
            alternatives.append(([r for r in [*runs, run] if r], literal))
            runs, run, literal = [], "", True
            continue
        escaped = token[0] == "\\" and not token[1].isalnum()
        plain = escaped or (len(token) == 1 and token not in ".^$*+?()|")
        if plain and depth == 0:
            run += token[-1]
            continue
        literal = False
        if token in "?*" or token[0] == "{":
            run = run[:-1]
        runs, run = [*runs, run], ""
        depth += (token == "(") - (token == ")")
    alternatives.append(([r for r in [*runs, run] if r], literal))
    return alternatives


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def found(low: Column, pattern: str, compat: bool = True) -> Column:
    """Does ``pattern`` occur in the already lower-cased text?

    A byte search for a string that every match must contain runs first; the regex (and the UTF-8
    decoding it needs) is paid only by rows that pass it. A pattern that needs a capital letter can
    never hit lower-cased text: with ``compat`` it is a constant false, otherwise it is searched in
    lower case.
    """
    if not compat:
        pattern = re.sub(r"(?<!\\)[A-Z]", lambda m: m.group().lower(), pattern)
    alternatives = literal_runs(pattern)
    if all(any(re.search("[A-Z]", r) for r in runs) for runs, _ in alternatives):
        return F.lit(False)
    if all(literal for _, literal in alternatives):
        return any_of([F.contains(low, F.lit(runs[0])) for runs, _ in alternatives])
    hit = low.rlike(exact(pattern))
    if all(runs for runs, _ in alternatives):
        needles = dict.fromkeys(max(runs, key=len) for runs, _ in alternatives)
        return any_of([F.contains(low, F.lit(n)) for n in needles]) & hit
    return hit


def ladder(low: Column, steps: Sequence[tuple[str, str]], compat: bool = True) -> Column:
    """Value of the first step whose pattern occurs; NULL when none does."""
    column = F.lit(None).cast("string")
    for pattern, value in reversed(steps):
        column = F.when(found(low, pattern, compat), F.lit(value)).otherwise(column)
    return column


def label_patterns(low: Column, rules: Sequence[tuple[str, str]], compat: bool = True) -> Column:
    """Labels of all patterns that occur, in rule order; NULL when none does."""
    labels = F.array_compact(F.array(*[F.when(found(low, p, compat), F.lit(v)) for p, v in rules]))
    return let(labels, lambda a: F.when(F.size(a) > 0, a))


def first_hit(text: Column, patterns: Sequence[str], group: int = 1) -> Column:
    """Group of the first pattern (by priority, not by position) that occurs; ``''`` when none does."""
    column = F.lit("")
    for pattern in reversed(patterns):
        column = _hit_or(F.regexp_extract(text, nocase(pattern), group), column)
    return column


def _hit_or(hit: Column, rest: Column) -> Column:
    return let(hit, lambda v: F.when(v != "", v).otherwise(rest))


def extract_int(text: Column, pattern: str) -> Column:
    """First number caught by group 1 as INT, NULL when the pattern does not occur."""
    return F.regexp_extract(text, nocase(pattern), 1).try_cast("int")
