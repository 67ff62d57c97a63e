"""Document fingerprints by MinHash.

A document's shingles are its distinct runs of ``n`` words (A-Z read as a-z), hashed to whole numbers below the prime
``2**31 - 1``. Each of ``PERMUTATIONS`` random maps ``x -> a * x + b`` modulo the prime is a permutation of these numbers,
and a fingerprint holds the least image of the document's shingles under each. The share of places in which two
fingerprints agree estimates the Jaccard similarity of the shingle sets; its standard error is at most 0.045. Images are
computed in numpy for many documents at once, in blocks of bounded size.

``fingerprints`` is a narrow step. ``compare_with_next`` also needs the document that follows in order of identifier: rows
are dealt once by ranges of identifiers, whose bounds come from percentiles, and the first row of each range is sent to
the range before it as well, so that every task finds the successor of its last row without a global sort. Texts are
shuffled once and stream through their tasks.

``near_documents`` cuts fingerprints into ``BANDS`` bands and joins equal bands in Spark. Equal sets are one class. In
each bucket of a band, every class is paired with the smallest one; pairs are verified by the exact Jaccard similarity of
their shingle sets, and the links give components. Only classes that share a bucket and are still in different components
are then paired and verified too. So a group of thousands of near copies costs a pair for each copy and bucket, and no
pair that shares a band is missed. Classes of 0.75 similarity share no band with a probability of 5 in a million.

Defined results: null is the empty text. Texts without words have the empty fingerprint, alike (1.0) to itself and unlike
(0.0) any other; they are linked with nothing. With fewer words than ``n`` the whole sequence is the one shingle. Equal
texts have equal fingerprints. Identifiers are whole numbers; rows without one come first; rows that share one follow one
another by text. The last row's successor is the first; a single row is its own. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, ship, written
from .jaccard_join import class_of, components, ngram_set

N = 5
PERMUTATIONS = 128
PRIME = (1 << 31) - 1
#: In the places of a fingerprint without shingles; no image is as large.
NOTHING = np.uint32((1 << 32) - 1)
#: Shingles whose images are computed at once, and characters of text whose shingles are held.
COLUMNS, CHARACTERS = 1024, 1 << 21
#: Ranges of identifiers for each shuffle partition: many, as they meet in partitions by hash.
RANGES = 8
#: Rows of four places each; two sets of similarity 0.75 share one but for 5 in a million.
BANDS = 32
THRESHOLD = 75  # per cent

_rng = np.random.default_rng(31)
_A = _rng.integers(1, PRIME, PERMUTATIONS, np.uint64)[:, None]
_B = _rng.integers(0, PRIME, PERMUTATIONS, np.uint64)[:, None]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of least images for each set of 64-bit hashes."""
    out = np.full((len(sets), PERMUTATIONS), NOTHING, np.uint32)
    sizes = np.array([len(s) for s in sets], np.int64)
    of = np.repeat(np.arange(len(sets)), sizes)
    if not len(of):
        return out
    x = np.concatenate(sets) % np.uint64(PRIME)
    p, half = np.uint64(PRIME), np.uint64(31)
    for at in range(0, len(x), COLUMNS):
        image = _A * x[None, at : at + COLUMNS] + _B
        for _ in range(2):  # 2**31 is 1 modulo the prime
            image = (image & p) + (image >> half)
        here = of[at : at + COLUMNS]
        starts = np.flatnonzero(np.concatenate(([True], here[1:] != here[:-1])))
        least = np.minimum.reduceat(image, starts, axis=1).astype(np.uint32).T
        out[here[starts]] = np.minimum(out[here[starts]], least)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal places, row by row."""
    return (a == b).mean(axis=1)


def printed(rows: np.ndarray) -> list[str]:
    """Fingerprints as lowercase hexadecimal digits, eight for each place."""
    return [r.tobytes().hex() for r in rows.astype(">u4")]


def parsed(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u4").astype(np.uint32)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N) -> DataFrame:
    """``key``, ``fingerprint`` of every row."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for at in pieces(texts, CHARACTERS):
                made = signatures([ngram_set(texts[i], n) for i in at])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(printed(made))], names=[key, "fingerprint"])

    return rows.mapInArrow(make, f"`{key}` long, fingerprint string")


def in_ranges(docs: DataFrame) -> DataFrame:
    """``range``, ``ahead``, ``id``, ``text``, sorted so within tasks: after the rows of a range comes, ``ahead``, the first
    row of the next one (and those that share its identifier). ``docs`` holds ``id`` and ``text``."""
    spark = docs.sparkSession
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = [i / ranges for i in range(1, ranges)]
    splits = np.unique(np.array(docs.select(F.percentile_approx("id", at, 10 * ranges)).first()[0] or [], np.int64))

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        out = np.full(len(ids), -1, np.int32)
        out[known] = np.searchsorted(splits, ids[known].astype(np.int64), side="right")
        return pd.Series(out)

    dealt = docs.withColumn("range", range_of("id"))
    firsts = sorted(tuple(r) for r in dealt.groupBy("range").agg(F.min("id").alias("id")).collect())
    before = [(firsts[i - 1][0], id_) for i, (_, id_) in enumerate(firsts)]
    before = F.broadcast(spark.createDataFrame(before, "before int, first long"))  # as many rows as ranges at most
    dealt = dealt.join(before, F.col("id").eqNullSafe(F.col("first")), "left")
    own = F.struct(F.col("range").alias("range"), F.lit(0).alias("ahead"))
    other = F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("range"), F.lit(1).alias("ahead")))
    dealt = dealt.select(F.explode(F.array_compact(F.array(own, other))).alias("to"), "id", "text").select("to.*", "id", "text")
    return dealt.repartition("range").sortWithinPartitions("range", "ahead", "id", "text")


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as much of the beginning of the following one, or by all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N) -> DataFrame:
    """Every row's fingerprint, its edited text's, and how alike it is to that and to the next row's."""
    ship(docs.sparkSession)
    rows = in_ranges(docs.select(F.col(key).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text")))
    columns = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def successors(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """``(range, ahead, id, text)`` of each row and of the one after it, the first row ahead standing for all."""
        last = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if last is None or last[0] != row[0] or not last[1]:
                    if last is not None and last[0] == row[0]:
                        yield last, row
                    last = row

    def compared(held: list[tuple]) -> pa.RecordBatch:
        changed = [edited(a[3], b[3]) for a, b in held]
        # A row's successor is the next row itself, unless a range ends between them.
        heads = [i for i, (_, b) in enumerate(held) if i + 1 == len(held) or held[i + 1][0] is not b]
        made = signatures([ngram_set(t, n) for t in [a[3] for a, _ in held] + changed + [held[i][1][3] for i in heads]])
        mine, others, tails = made[: len(held)], made[len(held) : 2 * len(held)], made[2 * len(held) :]
        following = np.concatenate([mine[1:], mine[:1]])
        following[heads] = tails
        return pa.RecordBatch.from_arrays(
            [
                pa.array([a[2] for a, _ in held], pa.int64()),
                pa.array([len(a[3]) for a, _ in held], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                pa.array(printed(mine)),
                pa.array(printed(others)),
                pa.array(likeness(mine, others)),
                pa.array(likeness(mine, following)),
            ],
            names=[key, *columns],
        )

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for pair in successors(batches):
            held.append(pair)
            size += len(pair[0][3])
            if size > CHARACTERS or len(held) >= 4096:
                yield compared(held)
                held, size = [], 0
        if held:
            yield compared(held)

    return rows.mapInArrow(make, f"`{key}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def verified(pairs: DataFrame, texts: DataFrame, n: int, threshold: int) -> DataFrame:
    """The pairs ``a``, ``b`` of classes whose sets are similar enough. ``texts``: ``cls`` and one text of each."""
    whole = pairs.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("ta")), "a")
    whole = whole.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (ta, tb) in enumerate(zip(batch.column(2), batch.column(3))):
                a, b = ngram_set(ta.as_py(), n), ngram_set(tb.as_py(), n)
                both = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * both >= threshold * (len(a) + len(b) - both):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return written(whole.mapInArrow(check, "a long, b long"), "minhash-links")


def near_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, threshold: int = THRESHOLD) -> DataFrame:
    """``key``, ``class_id`` (the smallest identifier with an equal set) and ``component_id`` (the smallest reachable over
    verified links) of every row."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = np.arange(BANDS, dtype=np.uint64)[None, :]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at in pieces(texts, CHARACTERS):
                sets = [ngram_set(texts[i], n) for i in at]
                places = signatures(sets).astype(np.uint64).reshape(len(at), BANDS, -1)
                keys = numbers + np.zeros((len(at), 1), np.uint64)
                for k in range(places.shape[2]):
                    keys = (keys ^ places[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
                    keys ^= keys >> np.uint64(29)
                cls = [class_of(s) if len(s) else None for s in sets]
                bands = pa.array([k if len(s) else None for k, s in zip(keys.view(np.int64), sets)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(cls, pa.int64()), bands], names=["id", "cls", "bands"])

    prints = written(rows.mapInArrow(make, "id long, cls long, bands array<long>"), "minhash-bands")
    classes = prints.where("cls is not null").groupBy("cls").agg(F.min("id").alias("class_id"), F.first("bands").alias("bands"))
    bands = written(classes.select("cls", "class_id", F.explode("bands").alias("band")), "minhash-buckets")
    met = bands.groupBy("band").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a <> b").select("band", "a")
    pairs = written(bands.join(met, "band").where("cls <> a").select("a", F.col("cls").alias("b")).distinct(), "minhash-pairs")

    def texts_of(pairs: DataFrame) -> DataFrame:
        """One text of each class that is in a pair."""
        wanted = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
        ids = bands.select("cls", "class_id").distinct().join(wanted, "cls", "left_semi")
        named = prints.select("id", "cls").join(ids, "cls").where(F.col("id").eqNullSafe(F.col("class_id"))).select("cls", "id").distinct()
        found = rows.join(named, rows["id"].eqNullSafe(named["id"]), "inner").select("cls", "text")

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:  # rows that share an identifier may be of several classes
                keep = [i for i, (c, t) in enumerate(zip(batch.column(0), batch.column(1))) if class_of(ngram_set(t.as_py(), n)) == c.as_py()]
                yield batch.take(pa.array(keep, pa.int64()))

        return found.mapInArrow(own, "cls long, text string").groupBy("cls").agg(F.min("text").alias("text"))

    links = verified(pairs, texts_of(pairs), n, threshold)
    labels = components(links).withColumnRenamed("v", "cls")
    placed = bands.select("cls", "band").join(labels, "cls", "left").select("cls", "band", F.coalesce("label", "cls").alias("label"))
    placed = written(placed, "minhash-placed")
    apart = placed.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("band")
    apart = placed.join(apart, "band", "left_semi")
    one, other = (apart.select("band", F.col("cls").alias(c), F.col("label").alias(f"l{c}")) for c in "ab")
    rest = one.join(other, "band").where("la < lb").select("a", "b").distinct()
    rest = rest.join(pairs, ["a", "b"], "left_anti").join(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
    rest = written(rest, "minhash-rest")
    links = links.unionByName(verified(rest, texts_of(rest), n, threshold))
    labels = components(links).withColumnRenamed("v", "cls")
    names = bands.select("cls", "class_id").distinct().join(labels, "cls", "left").select("cls", "class_id", F.coalesce("label", "cls").alias("label"))
    least = names.groupBy("label").agg(F.min("class_id").alias("component_id"))
    named = names.join(least, "label").select("cls", "class_id", "component_id")
    return prints.select(F.col("id").alias(key), "cls").join(named, "cls", "left").select(
        key, F.coalesce("class_id", key).alias("class_id"), F.coalesce("component_id", key).alias("component_id")
    )
