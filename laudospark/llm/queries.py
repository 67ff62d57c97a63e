"""Queries of the operators, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat_format, exact_dedup, hard_negatives, html_extract, jaccard_join, language_id, minhash, mixing, packing, quality, token_count, whitening
from .common import LOWER, UPPER, crc_mod, table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    model = language_id.train(docs.where(~held_out).select("text", "lang"))
    return language_id.predict(docs.select("doc_id", "text"), model, keep={"held_out": held_out})


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), limit=2048)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep_largest=True)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    paths = chat_format.reply_paths(chat_format.thread_messages(rows.unionByName(probe)))
    out = chat_format.digests(chat_format.format_paths(paths))
    return out.drop("branch").withColumnRenamed("tree", "conv_id")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~(crc_mod(F.col("doc_id"), 4) == 2))
    scored = quality.score_documents(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=0, max_tokens=1024)


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), n=5, threshold=75)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _, pieces = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0)
    return mixing.taken_words(documents, pieces)


def op10_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0, k=5)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model, error = whitening.whiten(table(spark, sf_dir, "embeddings"), components=32)
    explained = [float(e / model.trace) for e in model.values]
    shares = F.array(*[F.lit(e) for e in explained]) if explained else F.array().cast("array<double>")
    long = rows.select(F.col("key").alias("vec_id"), F.col("deviation").cast("long").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return long.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives.hard_negatives(rows, lambda vec_id: vec_id % 50 == 0, positives=5, negatives=3, window=(50, 95))


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.compare_with_next(table(spark, sf_dir, "documents"), n=5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_token_counts,
        op3_exact_dedup,
        op4_html_extraction,
        op5_chat_formatting,
        op6_quality_classifier,
        op7_packing,
        op8_ngram_jaccard_join,
        op9_source_mixing,
        op10_vector_search,
        op11_embedding_whitening,
        op12_hard_negatives,
        op13_document_fingerprints,
    )
}

_ESCAPES = " + ".join(f"(length(x) - length(replace(x, '{c}', ''))) // {len(c)}" for c in ("\\", "### ", "</turn>"))

ORACLES: dict[str, str] = {
    "op3_exact_dedup": f"""
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)""",
    "op5_chat_formatting": f"""
        WITH c AS (
            SELECT conv_id, turn, role, coalesce(text, '') AS x FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok')
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || x || chr(10), '' ORDER BY turn)) AS turns_sha256,
            CAST(sum(CASE WHEN role = 'assistant' THEN length(x) ELSE 0 END) AS BIGINT) AS loss_chars,
            sha256(string_agg(CASE WHEN role = 'assistant' THEN x ELSE '' END, '' ORDER BY turn)) AS loss_sha256,
            CAST(sum(13 + length(role) + length(x) + {_ESCAPES}) AS BIGINT) AS formatted_chars
        FROM c GROUP BY conv_id""",
}
