"""Quality scores by nearest-neighbour voting in a latent-semantic space.

A document's features are log counts of hashed words and of hashed word shapes (case, digits and symbols, with a mark
where a word repeats the one before it), weighted by inverse document frequency and set to length one per kind. At most
``SAMPLE`` labelled documents, those whose identifiers hash lowest, give the frequencies, a truncated singular value
decomposition of ``DIMENSIONS`` dimensions, and the labelled vectors; all three have a fixed largest size and are
broadcast. Every document is compared with every labelled vector in blocks, exactly, and its ``NEIGHBOURS`` nearest
vote with their similarity as weight.

Defined results: texts without a word (null, empty) have no direction and get the share of good labels in the sample,
as does every text if there are no labels (then 0.5). Several labels of one document count as their mean. Rows are
scored one by one, repeated ones too; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, ship

SAMPLE = 6000
DIMENSIONS = 64
NEIGHBOURS = 15
WORDS, SHAPES = 3072, 1024
#: How strongly similarity weighs a vote, and how many mean votes are mixed in.
SHARPNESS, MEAN_VOTES = 4.0, 0.05
SPAN = 1 << 21
MOST_KEPT = 300_000
#: Longer words are read whole like others, but not kept.
LONG_WORD = 200
_runs = re.compile(r"(.)\1+")


class Cells(dict):
    """Word to its two feature cells: 0 up to WORDS for the word, the rest for its shape."""

    def __missing__(self, word: str) -> int:
        if len(self) > MOST_KEPT:
            self.clear()
        shape = "".join("x" if c.islower() else "X" if c.isupper() else "9" if c.isdigit() else c for c in word)
        shape = _runs.sub(r"\1\1", shape)
        w = zlib.crc32(word.lower().encode("utf-8", "replace")) % WORDS
        s = WORDS + zlib.crc32(shape.encode("utf-8", "replace")) % (SHAPES - 1)
        known = w << 16 | s
        if len(word) <= LONG_WORD:
            self[word] = known
        return known


_cells = Cells()


def cells() -> Cells:
    return _cells


def counts(texts: list[str]) -> np.ndarray:
    """One row of feature counts per text; the last cell counts words that repeat the word before."""
    out = np.zeros((len(texts), WORDS + SHAPES), np.float32)
    known = cells()
    for i, text in enumerate(texts):
        words = text.split()
        if words:
            both = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            out[i] = np.bincount(both >> 16, minlength=WORDS + SHAPES)
            out[i] += np.bincount(both & 0xFFFF, minlength=WORDS + SHAPES)
            out[i, -1] = np.count_nonzero(both[1:] == both[:-1])
    return out


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    mean: float


def weighted(raw: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(raw) * idf
    for part in (x[:, :WORDS], x[:, WORDS:]):
        norm = np.linalg.norm(part, axis=1, keepdims=True)
        np.divide(part, norm, out=part, where=norm > 0)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def decompose(x: np.ndarray, dimensions: int, seed: int = 7) -> np.ndarray:
    """Leading right singular vectors by subspace iteration from a fixed start."""
    rng = np.random.default_rng(seed)
    width = min(dimensions + 16, *x.shape)
    q = np.linalg.qr(x @ rng.standard_normal((x.shape[1], width), np.float32))[0]
    for _ in range(4):
        q = np.linalg.qr(x @ np.linalg.qr(x.T @ q)[0])[0]
    return np.linalg.svd(q.T @ x, full_matrices=False)[2][: min(dimensions, width)].T.astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, use: Column | None = None, label: str = "quality", key: str = "doc_id", text: str = "text", sample: int = SAMPLE, dimensions: int = DIMENSIONS) -> Model:
    """Learn from at most ``sample`` labelled rows; ``use`` says of the key which labels may be used."""
    ship(docs.sparkSession)
    rows = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    rows = rows.where(use) if use is not None else rows
    rows = rows.groupBy(F.col(key).alias("key")).agg(F.avg(label).alias("label"))
    chosen = rows.orderBy(F.xxhash64("key"), "key").limit(sample)
    texts = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "key")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strings = batch.column("text").to_pylist()
            for run in pieces(strings, SPAN):
                for block in (run[i : i + 256] for i in range(0, len(run), 256)):
                    raw = counts([strings[i] for i in block])
                    at = [np.flatnonzero(r) for r in raw]
                    take = pa.array(block)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("key").take(take), batch.column("label").take(take), pa.array([a.astype(np.int32) for a in at], pa.list_(pa.int32())), pa.array([r[a] for r, a in zip(raw, at)], pa.list_(pa.float32()))],
                        names=["key", "label", "at", "n"],
                    )

    kind = texts.schema["key"].dataType.simpleString()
    found = texts.mapInArrow(features, f"key {kind}, label double, at array<int>, n array<float>").orderBy("key", F.xxhash64("at", "n")).limit(sample).toArrow()
    raw = np.zeros((found.num_rows, WORDS + SHAPES), np.float32)
    for i, (at, n) in enumerate(zip(found["at"], found["n"])):
        raw[i, at.values.to_numpy()] = n.values.to_numpy()
    y = found["label"].to_numpy().astype(np.float32)
    idf = np.log((1 + len(raw)) / (1 + (raw > 0).sum(axis=0))).astype(np.float32)
    if not len(raw):
        return Model(idf, np.zeros((WORDS + SHAPES, 1), np.float32), np.zeros((0, 1), np.float32), y, 0.5)
    x = weighted(raw, idf)
    basis = decompose(x, dimensions)
    return Model(idf, basis, unit(x @ basis), y, float(y.mean()))


def vote(model: Model, x: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Scores of unit vectors; rows without direction get the mean label."""
    if not len(model.labels):
        return np.full(len(x), model.mean)
    near = x @ model.vectors.T
    k = min(neighbours, near.shape[1])
    at = np.argpartition(-near, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(near, at, 1), 0.0).astype(np.float64) ** SHARPNESS
    score = (weight * model.labels[at]).sum(axis=1) + MEAN_VOTES * model.mean
    return np.clip(np.where(x.any(axis=1), score / (weight.sum(axis=1) + MEAN_VOTES), model.mean), 0.0, 1.0)


def score_documents(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score; a column of that name is replaced."""
    spark = docs.sparkSession
    docs = docs.drop(score)
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            strings = [t or "" for t in batch.column(text).to_pylist()]
            out = np.zeros(len(strings))
            for run in pieces(strings, SPAN):
                for block in (run[i : i + 256] for i in range(0, len(run), 256)):
                    raw = counts([strings[i] for i in block])
                    out[block] = vote(m, np.where(raw.any(axis=1, keepdims=True), unit(weighted(raw, m.idf) @ m.basis), 0.0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, score])

    return docs.mapInArrow(scored, T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())]))
