"""Header/body split, exam date, patient token and demographics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..rules import patterns as R
from .regex import exact, first_hit, let, nocase, one_line
from .text import chomp, strip, unify_lines

HEADER_LINES_WITHOUT_MARKER = 5


def split_header(
    df: DataFrame, text: str = "text", markers: Sequence[str] = R.BODY_MARKERS
) -> DataFrame:
    """Add ``header`` and ``body``: the body starts at the first line that opens with a marker.

    Without such a line the body is the whole text and the header its first five lines. One multi-line
    search takes everything from that line on, so long reports are not exploded into arrays of lines.
    """
    # One character class, not a repeated group: Java recurses per round of a repeated group.
    opening = rf"[\x1f[^\S\n]]*(?:{'|'.join(one_line(m) for m in markers)})"
    raw = F.coalesce(F.col(text), F.lit(""))
    lines, rest = F.col("__lines"), F.col("__rest")
    first_lines = F.substring_index(chomp(lines), "\n", HEADER_LINES_WITHOUT_MARKER)
    return (
        df.withColumn("__lines", unify_lines(raw))
        .withColumn("__rest", F.regexp_extract(lines, rf"(?idUsm)^{opening}.*", 0))
        .withColumns(
            {
                "header": F.when(rest == "", first_lines).otherwise(
                    chomp(F.left(lines, F.length(lines) - F.length(rest)))
                ),
                "body": F.when(rest == "", raw).otherwise(chomp(rest)),
            }
        )
        .drop("__lines", "__rest")
    )


def _two_digits(c: Column) -> Column:
    return F.when(F.length(c) < 2, F.lpad(c, 2, "0")).otherwise(c)


def normalize_date(c: Column) -> Column:
    """Day-first or year-first date to ``YYYY-MM-DD``; anything else comes back unchanged."""
    a, b, y = (F.regexp_extract(c, exact(R.DATE_PARTS), i) for i in (1, 3, 4))
    year = F.when(F.length(y) == 4, y).otherwise(F.concat(F.lit("20"), y))
    return (
        F.when(a == "", c)
        .when(F.length(a) == 4, F.concat_ws("-", a, _two_digits(b), _two_digits(y)))
        .otherwise(F.concat_ws("-", year, _two_digits(b), _two_digits(a)))
    )


def exam_date(
    header: Column, body: Column, patterns: Sequence[str] = R.EXAM_DATE_PATTERNS, compat: bool = True
) -> Column:
    """Exam date as ISO text, ``''`` if none. Without ``compat`` birth dates are taken out first."""
    where = F.concat(header, F.lit("\n"), F.substring(body, 1, R.EXAM_DATE_BODY_CHARS))
    if not compat:
        birth = r"(?:data\s+(?:de\s+)?)?(?:nascimento|nasc\.?|d\.\s*n\.)[:\s]+\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{2,4}"
        where = F.regexp_replace(where, nocase(birth), "")
    return let(first_hit(where, patterns), normalize_date)


def exam_date_as_date(c: Column) -> Column:
    """The exam date as DATE, NULL when it is not a day of the calendar."""
    return F.try_to_date(c, "yyyy-MM-dd")


def patient_token(header: Column, report_id: Column | None = None) -> Column:
    """``pt-`` and 12 hex digits of the header's hash.

    A header too short to identify anybody gets a token of its own: from ``report_id`` when given (a
    task that is run again then yields the same token), else a random one.
    """
    if report_id is None:
        fallback = F.replace(F.uuid(), F.lit("-"), F.lit(""))
    else:
        fallback = F.sha2(F.concat(F.lit("report:"), report_id.cast("string")), 256)
    source = F.when(F.length(header) > 3, F.sha2(header, 256)).otherwise(fallback)
    return F.concat(F.lit("pt-"), F.substring(source, 1, 12))


def patient_name(header: Column, pattern: str = R.NAME_PATTERN) -> Column:
    keep = lambda n: (
        (F.length(n) >= R.NAME_MIN_CHARS) & (F.length(n) < R.NAME_MAX_CHARS) & F.contains(n, F.lit(" "))
    )
    return let(
        strip(F.regexp_extract(header, nocase(pattern), 1)), lambda n: F.when(keep(n), n).otherwise(F.lit(""))
    )


def birth_date(header: Column, pattern: str = R.BIRTH_DATE_PATTERN) -> Column:
    return let(F.regexp_extract(header, nocase(pattern), 1), normalize_date)


def age(header: Column, pattern: str = R.AGE_PATTERN) -> Column:
    return let(
        F.regexp_extract(header, nocase(pattern), 1),
        lambda n: F.when(n != "", F.concat(n, F.lit(" anos"))).otherwise(F.lit("")),
    )


def sex(header: Column, pattern: str = R.SEX_PATTERN) -> Column:
    first = F.lower(F.left(F.regexp_extract(header, nocase(pattern), 1), F.lit(1)))
    return let(
        first,
        lambda s: F.when(s == "m", F.lit("Masculino")).when(s == "f", F.lit("Feminino")).otherwise(F.lit("")),
    )


def occupation(header: Column, pattern: str = R.OCCUPATION_PATTERN) -> Column:
    return strip(F.regexp_extract(header, nocase(pattern), 1))


def patient_data(header: Column) -> Column:
    """Struct of five texts; a missing value is ``''``, never NULL."""
    h = F.coalesce(header, F.lit(""))
    return F.struct(
        patient_name(h).alias("nome"),
        birth_date(h).alias("data_nascimento"),
        age(h).alias("idade"),
        sex(h).alias("sexo"),
        occupation(h).alias("cargo_funcao"),
    )
