"""A corpus pipeline of five stages over ``documents``; each is written as Parquet and read again as the next one's input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laudospark.llm import exact_dedup, jaccard_join, mixing, packing, quality
from laudospark.llm.common import crc_mod, shared_folder, table
from laudospark.llm.queries import tokenizer_file


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score says label 1."""
    everything = table(spark, sf_dir, "documents")
    model = quality.fit(everything, table(spark, sf_dir, "labels"), ~(crc_mod(F.col("doc_id"), 4) == 2))
    return quality.score_documents(docs, model, score="quality_score").where("quality_score >= 0.7").drop("quality_score")


def one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return exact_dedup.drop_copies(docs, keep_largest=True)


def one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked texts, the row with the smallest doc_id."""
    return jaccard_join.drop_near_duplicates(docs, n=5, threshold=75)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix visits them, with the words that it takes, in its order."""
    out = mixing.mixed_texts(docs, weights=(5, 2, 1), share=1.5, most=2.0)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    return packing.pack_texts(docs, tokenizer_file("byte_bpe_50k.json"), end_id=0, max_tokens=1024)


STAGES = [("quality", good_quality), ("exact_dedup", one_of_equal), ("near_dedup", one_of_near), ("mixing", mixed), ("packing", packed)]

#: Scores, sketches and token ids are beyond SQL; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents`` to the packed pieces."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return docs
