"""The lexicon as two flat tables: terms and compound rules."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..rules import lexicon as L

TERM_SCHEMA = "exam_type string, ord int, termo string, variantes array<string>, peso string, significado string"
COMPOUND_SCHEMA = "exam_type string, ord int, condicao string, diagnostico string, justificativa string"
JSON_SCHEMA = (
    "map<string, struct<"
    "achados_discriminativos: array<struct<termo: string, variantes: array<string>, peso: string, significado: string>>, "
    "diagnosticos_compostos: array<struct<condicao: string, diagnostico: string, justificativa: string>>>>"
)


def term_rows() -> list[tuple]:
    """Rows of the built-in terms."""
    return [
        (exam_type, i, term, list(forms), weight, note)
        for exam_type, rows in L.TERMS.items()
        for i, (term, forms, weight, note) in enumerate(rows, 1)
    ]


def compound_rows() -> list[tuple]:
    """Rows of the built-in compound rules."""
    return [(exam_type, i, *row) for exam_type, rows in L.COMPOUNDS.items() for i, row in enumerate(rows, 1)]


def builtin_lexicon(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return (
        spark.createDataFrame(term_rows(), TERM_SCHEMA),
        spark.createDataFrame(compound_rows(), COMPOUND_SCHEMA),
    )


def read_lexicon(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Terms and compounds of a JSON lexicon; of a key that occurs twice the last one counts.

    A path without files gives two empty tables.
    """
    try:
        lines = spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], TERM_SCHEMA), spark.createDataFrame([], COMPOUND_SCHEMA)
    entries = lines.select(F.posexplode(F.map_entries(F.from_json("value", JSON_SCHEMA))).alias("pos", "e"))
    exams = entries.groupBy(F.col("e.key").alias("exam_type")).agg(F.max_by("e.value", "pos").alias("kb"))
    return kb_terms(exams), kb_compounds(exams)


def kb_terms(exams: DataFrame) -> DataFrame:
    """``(exam_type, ord, termo, variantes, peso, significado)``, one row per term."""
    rows = exams.select("exam_type", F.posexplode("kb.achados_discriminativos").alias("pos", "t"))
    return rows.select("exam_type", (F.col("pos") + 1).alias("ord"), "t.*")


def kb_compounds(exams: DataFrame) -> DataFrame:
    """``(exam_type, ord, condicao, diagnostico, justificativa)``, one row per rule."""
    rows = exams.select("exam_type", F.posexplode("kb.diagnosticos_compostos").alias("pos", "d"))
    return rows.select("exam_type", (F.col("pos") + 1).alias("ord"), "d.*")
