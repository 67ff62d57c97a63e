"""Routing, candidate selection, page joining and quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import strip
from ..rules import patterns as R

PAGES_PER_CHUNK = 256


def is_pdf(filename: Column) -> Column:
    return F.coalesce(F.endswith(F.lower(filename), F.lit(".pdf")), F.lit(False))


def route_text(df: DataFrame, native: str = "native_text", filename: str = "filename") -> DataFrame:
    """Add ``text`` and ``is_raster``: native text of a PDF is used when it is long enough."""
    usable = is_pdf(F.col(filename)) & (
        F.length(strip(F.coalesce(F.col(native), F.lit("")))) >= R.NATIVE_TEXT_MIN_CHARS
    )
    return df.withColumns(
        {"text": F.when(usable, F.col(native)).otherwise(F.lit("")), "is_raster": ~usable}
    )


def best_candidate(
    df: DataFrame, key: str = "report_id", text: str = "text", strategy: str = "strategy", rank: str = "ord"
) -> DataFrame:
    """Longest stripped text per report; the earlier strategy wins a tie, a failed one counts as ``''``.

    An aggregate with partial results per task, so a report with very many candidates is not gathered.
    """
    clean = strip(F.coalesce(F.col(text), F.lit("")))
    candidates = df.select(key, F.col(strategy), F.col(rank).alias("__rank"), clean.alias("__text"))
    best = F.max_by(
        F.struct(F.col("__text").alias("text"), F.col(strategy).alias("strategy")),
        F.struct(F.length("__text"), -F.col("__rank")),
    )
    return candidates.groupBy(key).agg(best.alias("best")).select(key, "best.text", "best.strategy")


def concat_pages(
    df: DataFrame, key: str = "report_id", page: str = "page", text: str = "text", skip_empty: bool = True
) -> DataFrame:
    """Page texts in page order, each followed by LF. ``skip_empty`` is the native-text variant.

    Runs of pages are joined first, so a report of very many pages is spread over tasks and the last
    step meets only its chunks.
    """
    pages = df.select(key, F.col(page).alias("__page"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    kept = F.when(F.col("__text") != "", F.concat("__text", F.lit("\n"))).otherwise(
        F.lit("" if skip_empty else "\n")
    )

    def joined(order: str, piece: str) -> Column:
        rows = F.array_sort(F.collect_list(F.struct(order, piece)))
        return F.array_join(F.transform(rows, lambda r: r[piece]), "")

    chunks = (
        pages.withColumn("__text", kept)
        .groupBy(key, F.floor(F.col("__page") / PAGES_PER_CHUNK).alias("__chunk"))
        .agg(joined("__page", "__text").alias("__text"))
    )
    return chunks.groupBy(key).agg(joined("__chunk", "__text").alias("text"))


def is_low_confidence(body: Column) -> Column:
    """Too little text is left for a safe analysis."""
    return F.length(strip(body)) < R.CONFIDENT_MIN_CHARS


def is_valid_answer(analysis: Column) -> Column:
    """The model's own verdict; true when it gave none."""
    return F.coalesce(analysis["is_valid_exam"], F.lit(True))


def text_snippet(body: Column, low_confidence: Column) -> Column:
    cut = F.substring(body, 1, R.SNIPPET_CHARS)
    return F.when(low_confidence, cut).otherwise(F.concat(cut, F.lit("...")))


def purge_list(files: DataFrame, as_of: Column | None = None, days: int = R.RETENTION_DAYS) -> DataFrame:
    """Files last changed more than ``days`` days before ``as_of``. Deleting them is left to the caller."""
    now = F.current_timestamp() if as_of is None else as_of
    return files.filter(F.col("modified_at") < now - F.make_dt_interval(F.lit(days)))
