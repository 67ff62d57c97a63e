"""Language identification: multinomial naive Bayes over hashed character n-grams.

N-grams of one to three code points are taken within words (runs of letters, one blank on either side) of the
lower-cased text and hashed into a fixed number of buckets. Training sums bucket counts per language in Spark; the
driver gets one number per used bucket and language, bounded by ``MODEL_CELLS``, and broadcasts the matrix of log
probabilities. Scoring gathers the matrix rows of a batch's n-grams in numpy and sums them per document.

Defined results: a null text, or one without letters, is ``und`` with score 0, and so is every text if nothing could be
learned. Equal scores go to the language that sorts first. Rows without a language are scored but teach nothing;
repeated rows count as often as they occur; columns other than the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, ship

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
#: Most cells of the broadcast matrix; with more languages, buckets are halved until it holds.
MODEL_CELLS = 1 << 23
#: Code points that are turned into n-grams at once.
SPAN = 1 << 19
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Whether each code point is a letter; made once per worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def cut(text: str, span: int = SPAN) -> Iterator[str]:
    """The text in parts of at most ``span``, cut between words; a longer word is cut within."""
    start = 0
    while len(text) - start > span:
        end = start + span
        while end > start + span // 2 and text[end - 1].isalpha():
            end -= 1
        if text[end - 1].isalpha():
            end = start + span
        yield text[start:end]
        start = end
    yield text[start:]


def ngram_buckets(texts: list[str], buckets: int, orders: tuple[int, ...] = ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, position of the text) of every n-gram, grouped by nothing in particular."""
    lowered = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(lowered), dtype=np.int32), [len(t) for t in lowered])
    letter = letter_table()[codes]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1] | (owner[1:] != owner[:-1])
    keep[:-1] |= letter[1:]
    codes, owner, letter = codes[keep], owner[keep], letter[keep]
    codes = np.where(letter, codes, np.uint32(32))
    found, owners = [], []
    for n in orders:
        if len(codes) < n:
            continue
        size = len(codes) - n + 1
        ok = owner[:size] == owner[n - 1 :]
        inner = range(1, n - 1) if n > 1 else range(1)
        for k in inner:
            ok &= letter[k : k + size]
        if n > 1:
            ok &= letter[:size] | letter[n - 1 :]
        at = np.flatnonzero(ok)
        h = np.full(len(at), n * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h = (h ^ codes[at + k]) * _MULTIPLIERS[k]
            h ^= h >> np.uint32(15)
        found.append((h % np.uint32(buckets)).astype(np.int64))
        owners.append(owner[at])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    return np.concatenate(found), np.concatenate(owners)


def train(rows: DataFrame, text: str = "text", lang: str = "lang", buckets: int = BUCKETS) -> tuple[list[str], np.ndarray]:
    """(languages, matrix of log probabilities with a last row of log priors) from all rows with text and language."""
    ship(rows.sparkSession)
    rows = rows.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    priors = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(priors)
    if not langs:
        return [], np.zeros((1, 0), np.float32)
    while buckets > 256 and (buckets + 1) * len(langs) > MODEL_CELLS:
        buckets //= 2
    place = {x: i for i, x in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(place) * buckets, np.int64)
        for batch in batches:
            texts, labels = batch.column(0).to_pylist(), [place[x] for x in batch.column(1).to_pylist()]
            parts = [(part, k) for t, k in zip(texts, labels) for part in cut(t)]
            strings = [p for p, _ in parts]
            for run in pieces(strings, SPAN):
                b, owner = ngram_buckets([strings[i] for i in run], buckets)
                of = np.array([parts[i][1] for i in run], np.int64)
                total += np.bincount(of[owner] * buckets + b, minlength=len(total))
        used = np.flatnonzero(total)
        for at in range(0, len(used), 1 << 16):
            cells = used[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], names=["cell", "n"])

    counts = np.zeros(len(langs) * buckets, np.float64)
    sums = rows.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts[sums["cell"].to_numpy()] = sums["n"].to_numpy()
    counts = counts.reshape(len(langs), buckets) + 1.0
    log_p = np.log(counts) - np.log(counts.sum(axis=1, keepdims=True))
    prior = np.log(np.array([priors[x] for x in langs], np.float64) / sum(priors.values()))
    return langs, np.vstack([log_p.T, prior[None]]).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], key: str = "doc_id", text: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """Key, kept columns, ``lang_pred`` and ``score``, the posterior probability, for every row."""
    spark = docs.sparkSession
    ship(spark)
    keep = keep or {}
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col(key).alias("key"), *[c.alias(f"kept_{k}") for k, c in keep.items()], F.col(text).alias("text"))
    kept = rows.drop("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, matrix = shared.value
        buckets = len(matrix) - 1
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            parts = [(part, i) for i, t in enumerate(texts) for part in cut(t)]
            strings = [p for p, _ in parts]
            logs = np.zeros((len(texts), max(1, len(langs))), np.float64)
            seen = np.zeros(len(texts), np.int64)
            for run in pieces(strings, SPAN):
                b, owner = ngram_buckets([strings[i] for i in run], buckets) if langs else (np.zeros(0, np.int64), np.zeros(0, np.int32))
                docs_of = np.array([parts[i][1] for i in run], np.int64)
                seen += np.bincount(docs_of[owner], minlength=len(texts))
                for k in range(len(langs)):
                    logs[:, k] += np.bincount(docs_of[owner], weights=matrix[b, k], minlength=len(texts))
            pred, best = ["und"] * len(texts), np.zeros(len(texts))
            if langs:
                logs += matrix[-1]
                top = logs.argmax(axis=1)
                p = 1.0 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                pred = [langs[k] if n else "und" for k, n in zip(top, seen)]
                best = np.where(seen > 0, p, 0.0)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(pred, pa.string()), pa.array(best)], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    out = rows.mapInArrow(score, f"{schema}, lang_pred string, score double")
    return out.select(F.col("key").alias(key), *[F.col(f"kept_{k}").alias(k) for k in keep], "lang_pred", "score")
