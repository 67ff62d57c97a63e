"""Prompt tables for batch inference."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..rules import lexicon as L, patterns as R, prompts as P
from .joins import lookup_join


def _lines(df: DataFrame, line: Column, title: str, name: str) -> DataFrame:
    """Title and the lines of each exam type in order."""
    rows = F.array_sort(F.collect_list(F.struct("ord", line.alias("line"))))
    text = F.array_join(F.transform(rows, lambda r: r["line"]), "\n")
    return df.groupBy("exam_type").agg(F.concat(F.lit(title + "\n"), text).alias(name))


def lexical_blocks(terms: DataFrame, compounds: DataFrame, conditions: DataFrame | None = None) -> DataFrame:
    """``(exam_type, block)``: high-weight terms, then compound rules, then reference conditions.

    An exam type without high-weight terms has no block at all.
    """
    term_line = F.concat(
        F.lit('  - "'), "termo", F.lit('" (também: '), F.array_join("variantes", " / "), F.lit("): "), "significado"
    )
    blocks = _lines(terms.filter(F.col("peso") == L.HIGH), term_line, P.BLOCK_TITLE, "terms")
    rule_line = F.concat(F.lit("  - "), "condicao", F.lit(" → "), "diagnostico")
    blocks = blocks.join(_lines(compounds, rule_line, P.COMPOUND_TITLE, "rules"), "exam_type", "left")
    parts = ["terms", "rules"]
    if conditions is not None:
        key_findings = F.array_join(F.slice("achados_chave", 1, P.MAX_KEY_FINDINGS), "; ")
        line = F.concat(F.lit("  - "), "nome", F.lit(" ("), F.array_join("cid10", ", "), F.lit("): "), key_findings)
        blocks = blocks.join(_lines(conditions, line, P.CONDITION_TITLE, "conditions"), "exam_type", "left")
        parts.append("conditions")
    return blocks.select("exam_type", F.concat_ws("\n\n", *parts).alias("block"))


def build_prompts(
    df: DataFrame, blocks: DataFrame, text: str = "safe_body", bases: Mapping[str, str] = P.BASE_PROMPTS
) -> DataFrame:
    """Add ``prompt``: instruction, lexical block (if any) and the fenced report text."""
    table = F.create_map(*[F.lit(x) for pair in bases.items() for x in pair])
    base = F.coalesce(F.try_element_at(table, F.col("exam_type")), F.lit(bases[R.UNKNOWN_EXAM]))
    fenced = F.concat(F.lit(f'{P.TEXT_TITLE}\n"""\n'), F.col(text), F.lit('\n"""'))
    return lookup_join(df, blocks, "exam_type", "left").withColumn(
        "prompt", F.concat_ws("\n\n", base, "block", fenced)
    ).drop("block")


def prompts_to_send(pipeline_rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(report_id, exam_type, prompt)`` of the rows that passed the gate, which comes before the prompt."""
    passed = pipeline_rows.filter(~F.col("low_confidence")).select("report_id", "exam_type", "safe_body")
    return build_prompts(passed, blocks).select("report_id", "exam_type", "prompt")


#: Hexadecimal digits of a key's hash that make a run of rows; each run is numbered by itself.
RUN_DIGITS = 3


def batch_prompts(prompts: DataFrame, max_chars: int, key: str = "report_id", text: str = "prompt") -> DataFrame:
    """Prompts with ``batch``, a number such that the prompts of a batch have ``max_chars`` characters at most together.

    Prompts stand in the order of their key's hash, then of their key, and are cut where the running sum of characters
    passes a multiple of the step: ``max_chars`` less the longest prompt, plus one. So no batch is too long and all but the
    last are about as long as each other. Prompts above half of ``max_chars`` have a batch of their own, numbered -1, -2
    and so on; only these may be longer than ``max_chars``. The running sum is made in two steps: sums per run of hashes,
    of which there are 4096, and a window within each run; no task sees more than a run. Store the prompts first, as they
    are read twice. Keys are unique; a missing text counts as empty.
    """
    run = F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, RUN_DIGITS)
    size = F.coalesce(F.length(text), F.lit(0)).cast("long")
    sized = prompts.withColumns({"__run": run, "__size": size, "__own": 2 * size > max_chars})
    chars, alone = F.when(F.col("__own"), F.lit(0)).otherwise(F.col("__size")), F.col("__own").cast("long")
    sums = sized.groupBy("__run").agg(F.sum(chars).alias("c"), F.sum(alone).alias("a"), F.max(chars).alias("m"))
    before = Window.orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)  # over 4096 rows
    starts = sums.select(
        "__run",
        F.coalesce(F.sum("c").over(before), F.lit(0)).alias("__chars"),
        F.coalesce(F.sum("a").over(before), F.lit(0)).alias("__alone"),
        (F.lit(max_chars) - F.max("m").over(Window.partitionBy(F.lit(0))) + 1).alias("__step"),
    )
    so_far = Window.partitionBy("__run").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.join(F.broadcast(starts), "__run")
    start = F.col("__chars") + F.sum(chars).over(so_far) - F.col("__size")
    number = F.when(F.col("__own"), -F.col("__alone") - F.sum(alone).over(so_far)).otherwise(F.floor(start / F.col("__step")))
    return placed.withColumn("batch", number.cast("long")).select(*prompts.columns, "batch")
