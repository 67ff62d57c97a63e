"""Readers for reports, state tables, the lexicon and recorded model answers."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..session import folder_names


def stream_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A stream over a Parquet folder of part files, or over a table that is one file."""
    schema = spark.read.parquet(path).schema
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.getFileStatus(where).isDirectory():
        return spark.readStream.schema(schema).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())


def ensure_parallelism(df: DataFrame) -> DataFrame:
    """Spread a scan that comes in fewer pieces than there are cores (small files, one row group).

    For use right after a scan, where counting partitions only plans. A table of cluster size has more
    pieces than cores and passes unchanged, so no text is shuffled there.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def read_reports(
    spark: SparkSession,
    path: str | list[str],
    fmt: str = "parquet",
    text: str = "text",
    report_id: str | None = None,
    schema: str | StructType | None = None,
) -> DataFrame:
    """Reports as ``(report_id, filename, text)``. Give ``schema`` for JSON, or all of it is read once more to infer one.

    ``fmt`` is ``parquet``, ``orc``, ``json``, or ``text`` (one report per file). Text files get an id from the hash of
    their path. Without ``report_id`` a row's id is the hash of name and text, so equal uploads share it: name the key
    column where uploads must stay apart.
    """
    if fmt == "text":
        raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
        return raw.select(
            F.sha2("path", 256).alias("report_id"),
            F.element_at(F.split("path", "[/\\\\]"), -1).alias("filename"),
            F.col("value").alias("text"),
        )
    reader = spark.read.format(fmt)
    df = (reader.schema(schema) if schema is not None else reader).load(path)
    name = F.col("filename") if "filename" in df.columns else F.lit(None).cast("string")
    key = F.col(report_id) if report_id else F.sha2(F.concat_ws("\x1f", name, F.col(text)), 256)
    return df.select(key.alias("report_id"), name.alias("filename"), F.col(text).alias("text"))


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """File listing ``(path, filename, modified_at, length)``; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(
        "path",
        F.element_at(F.split("path", "[/\\\\]"), -1).alias("filename"),
        F.col("modificationTime").alias("modified_at"),
        "length",
    )


MANIFEST = "path string, modified_at timestamp, length long"


@dataclass
class Intake:
    """Reports of files that no earlier intake has taken; ``commit`` once they are stored."""

    reports: DataFrame | None
    files: list[tuple]
    spark: SparkSession
    manifest: str

    def commit(self) -> None:
        """Enter the files in the manifest; until then they are new."""
        if self.files:
            self.spark.createDataFrame(self.files, MANIFEST).coalesce(1).write.mode("append").parquet(self.manifest)


def new_files(files: DataFrame, manifest: DataFrame | None) -> DataFrame:
    """Files whose path, time of change and length no entry of the manifest has."""
    listed = files.select("path", "modified_at", "length")
    return listed if manifest is None else listed.join(manifest, ["path", "modified_at", "length"], "left_anti")


def read_new_reports(spark: SparkSession, path: str, manifest: str, fmt: str = "parquet", **options) -> Intake:
    """Each upload once: reports of the files below ``path`` that are not in the manifest or have changed since.

    Listing and comparison need names, times and lengths only; contents are read of new files alone. ``reports`` is None
    when there are none. The paths of new files come to the driver, which holds the listing of a scan in any case. Other
    arguments are those of ``read_reports``.
    """
    known = spark.read.schema(MANIFEST).parquet(manifest) if folder_names(spark, manifest) else None
    fresh = new_files(read_uploads(spark, path), known).orderBy("path").collect()
    names = [re.sub(r"([\\\[\]{}*?])", r"\\\1", r["path"]) for r in fresh]  # a name is no pattern
    reports = read_reports(spark, names, fmt, **options) if names else None
    return Intake(reports, [tuple(r) for r in fresh], spark, manifest)


def read_state(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """A jobs, validations or feedback table (``fmt="jdbc"`` works where a driver jar is supplied)."""
    return spark.read.format(fmt).options(**options).load(path)


CASE_SCHEMA = (
    "id string, filename string, "
    "procod_data struct<nome string, data_nascimento string, convenio string>, "
    "clinical_data_anonymized struct<idade string, sexo string, cargo_funcao string, data_exame string, "
    "parecer_audiologico string, valores_exame map<string, string>>"
)


def read_case_bank(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Case records of a JSON array file (or of JSON lines), flattened; the identifying block is left out."""
    return flatten_cases(spark.read.schema(CASE_SCHEMA).json(path, multiLine=multiline))


def flatten_cases(cases: DataFrame) -> DataFrame:
    return cases.select("id", "filename", "clinical_data_anonymized.*")


def read_vision_outputs(spark: SparkSession, path: str, wholetext: bool = True) -> DataFrame:
    """Documents of the form ``{file: fenced JSON}``, one per file or line, as ``(filename, answer)`` rows."""
    return explode_outputs(spark.read.text(path, wholetext=wholetext), "value")


def explode_outputs(documents: DataFrame, column: str) -> DataFrame:
    entries = F.from_json(F.col(column), "map<string, string>")
    return documents.select("*", F.explode(entries).alias("filename", "answer")).drop(column)
