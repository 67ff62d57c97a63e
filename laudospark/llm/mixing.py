"""Mixing sources to target weights by a low-discrepancy schedule.

Within each source the documents are shuffled by a hash and laid end to end; the stream is cut into blocks of
``block_words`` words (the last one of an epoch may be shorter). A source's target, in words, becomes a number of block
visits. Slot i of the schedule takes the point frac((i + 1/2) * golden ratio), which falls into one source's share of the
cumulative visits; slots are ranked per source, and the slot of rank r visits block r of the source's repeated stream.
Golden-ratio points are evenly spread at every prefix, so any stretch of the schedule is mixed nearly to weight. A few
ranks that the points miss follow at the end, superfluous ones fall away, and the last visit of a source is shortened,
so a source's words add up to its target rounded to whole words.

Nothing orders a source in one task: offsets and ranks are prefix sums over bounded buckets, then over bucket totals.
One row per source meets on the driver (``MAX_SOURCES`` at most, more is an error): targets depend on all of them.

Defined results: a null text has size 0, a null source is a source of its own and comes last. Documents of size 0 are
listed and never taken; a source without words has target 0. Repeated rows are documents of their own. The same table
gives the same schedule whatever its order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, ship, written

BLOCK_WORDS = 1024
MAX_SOURCES = 100_000
#: Buckets of a source's shuffle order; offsets are summed within buckets, then over their totals.
BUCKETS = 4096
#: Slots that are ranked together.
CHUNK = 1 << 14
GOLDEN = (math.sqrt(5) - 1) / 2


def word_count(text: Column) -> Column:
    """Number of words in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its source's size; the excess is shared anew."""
    caps = [most * s for s in sizes]
    out = [0.0] * len(sizes)
    free = [i for i, c in enumerate(caps) if c > 0]
    left = total
    while free:
        weight = sum(weights[i] for i in free)
        above = [i for i in free if left * weights[i] / weight > caps[i]]
        if not above:
            for i in free:
                out[i] = left * weights[i] / weight
            break
        for i in above:
            out[i] = caps[i]
        left -= sum(caps[i] for i in above)
        free = [i for i in free if i not in set(above)]
    return out


def visits(size: int, words: int, block: int) -> int:
    """Block visits that a source needs for so many words."""
    if not size or not words:
        return 0
    return words // size * -(-size // block) + -(-(words % size) // block)


def golden_slots(counts: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Source of each slot: its point's place in the cumulative visits."""
    ends = np.cumsum(counts) / counts.sum()
    points = np.mod((np.arange(start, stop) + 0.5) * GOLDEN, 1.0)
    return np.minimum(np.searchsorted(ends, points, side="right"), len(counts) - 1)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block_words: int = BLOCK_WORDS, seed: int = 17) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, schedule, pieces).

    documents: key, source, ``size``, ``source_size``, ``target``, ``offset`` (words before it in its source's order);
    schedule: ``slot``, ``source_no``, ``rank``, ``epoch``, ``block``, ``words``;
    pieces: ``slot``, key, ``source_no``, ``offset``, ``epoch``, ``start``, ``length``: words of documents in the order of
    the mix.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"))
    order = F.xxhash64(F.lit(seed), "key", "size")
    rows = written(rows.withColumn("place", order).withColumn("bucket", F.shiftrightunsigned("place", 52).cast("int")), "mix-sizes")

    found = rows.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    names = sorted((r for r in found), key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in names]
    target = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], share * sum(sizes), most)
    words = [min(math.floor(t + 0.5), int(most * s)) for t, s in zip(target, sizes)]
    counts = np.array([visits(s, w, block_words) for s, w in zip(sizes, words)], np.int64)
    sources = spark.createDataFrame(
        [(i, r["source"], s, float(t), w, int(c)) for i, (r, s, t, w, c) in enumerate(zip(names, sizes, target, words, counts))],
        "source_no int, name string, source_size long, target double, words long, visits long",
    )

    # Offsets: first within a bucket of a source's order, then over the totals of its buckets.
    totals = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(F.col("source").alias("s"), F.col("bucket").alias("b"), before.alias("before"))
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("place", "key", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    laid = rows.withColumn("inside", inside).join(totals, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    laid = laid.select("key", "source", "size", (F.col("inside") + F.col("before")).alias("offset"))
    laid = written(laid.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("name"))).drop("name", "visits"), "mix-laid")

    # The schedule: slots of the points, ranked per source chunk by chunk.
    total = int(counts.sum())

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks = batch.column(0).to_pylist()
            for c in chunks:
                of = golden_slots(counts, c * CHUNK, min(total, (c + 1) * CHUNK))
                n = np.zeros(len(of), np.int64)
                for s in np.unique(of):
                    at = np.flatnonzero(of == s)
                    n[at] = np.arange(len(at))
                slot = np.arange(c * CHUNK, c * CHUNK + len(of))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(of), c)), pa.array(slot), pa.array(of.astype(np.int32)), pa.array(n)], names=["chunk", "slot", "source_no", "inside"])

    chunks = -(-total // CHUNK)
    slots = spark.range(chunks).mapInArrow(assign, "chunk long, slot long, source_no int, inside long")
    per = slots.groupBy("chunk", "source_no").agg(F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = slots.join(per.select("chunk", "source_no", ahead.alias("ahead")), ["chunk", "source_no"]).select("slot", "source_no", (F.col("inside") + F.col("ahead")).alias("rank"))
    reached = per.groupBy("source_no").agg(F.sum("n").alias("reached"))
    missed = (
        F.broadcast(sources.select("source_no", "visits"))
        .join(reached, "source_no", "left")
        .where(F.col("visits") > F.coalesce("reached", F.lit(0)))
        .select("source_no", F.explode(F.sequence(F.coalesce("reached", F.lit(0)), F.col("visits") - 1)).alias("rank"))
        .select((F.lit(total) + F.col("rank") * len(counts) + F.col("source_no")).alias("slot"), "source_no", "rank")
    )
    blocks = F.ceil(F.col("source_size") / F.lit(block_words))
    schedule = (
        ranked.unionByName(missed)
        .join(F.broadcast(sources), "source_no")
        .where("rank < visits")
        .withColumn("epoch", F.floor(F.col("rank") / blocks))
        .withColumn("block", F.col("rank") - F.col("epoch") * blocks)
        .withColumn("words", F.least(F.lit(block_words), F.col("source_size") - F.col("block") * block_words, F.col("words") - F.col("epoch") * F.col("source_size") - F.col("block") * block_words))
        .select("slot", "source_no", "rank", "epoch", "block", F.col("words").cast("long").alias("words"))
    )

    # Documents meet the slots through the blocks that they lie in.
    lying = laid.where("size > 0").select("key", "source_no", "offset", "size", F.explode(F.sequence(F.floor(F.col("offset") / block_words), F.floor((F.col("offset") + F.col("size") - 1) / block_words))).alias("block"))
    first = F.greatest(F.col("offset"), F.col("block") * block_words)
    last = F.least(F.col("offset") + F.col("size"), F.col("block") * block_words + F.col("words"))
    pieces = (
        schedule.join(lying, ["source_no", "block"])
        .where(last > first)
        .select("slot", F.col("key").alias(key), "source_no", "offset", "epoch", (first - F.col("offset")).alias("start"), (last - first).alias("length"))
    )
    return laid.withColumnRenamed("key", key), schedule, pieces


def taken_words(documents: DataFrame, pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents with ``taken``: the words that the mix takes from each, repeats counted."""
    sums = pieces.groupBy("source_no", "offset").agg(F.sum("length").alias("taken"))
    joined = documents.where("size > 0").join(sums, ["source_no", "offset"], "left")
    columns = [F.col(key), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "source"]
    empty = documents.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return joined.select(*columns).unionByName(empty.select(*columns))


def first_words(text: Column, count: Column) -> Column:
    """The text up to the end of its word number ``count``."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), count), "")


def mixed_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: a row of ``docs`` for every epoch that visits a document, in the order of their first slots.

    Where an epoch takes a document to its end the text is unchanged; where the last visit stops earlier it has just the
    words taken, which are the first ones, as an epoch visits its blocks from the first on. Other columns are unchanged.
    """
    documents, _, pieces = mix(docs, key, text, source, **options)
    takes = pieces.groupBy("source_no", "offset", "epoch").agg(F.sum("length").alias("taken"), F.min("slot").alias("slot"))
    takes = takes.groupBy("source_no", "offset").agg(F.collect_list(F.struct("slot", "taken")).alias("__takes"))
    # Rows of the same identifier, source and size are told apart by number: all of them are laid out, taken or not.
    # One type on both sides, down to what may be null: the join would cast, and shuffle again, what is numbered by it.
    alike = "struct<key:bigint,source:string,size:bigint>"
    same = F.struct(F.col(key).cast("long").alias("key"), F.col("source").alias("source"), F.col("size").alias("size")).cast(alike)
    laid = documents.where("size > 0").join(takes, ["source_no", "offset"], "left")
    places = laid.groupBy(same.alias("__same")).agg(F.array_sort(F.collect_list(F.struct("offset", "__takes"))).alias("__places"))
    size = word_count(F.col(text))
    rows = docs.withColumn("__same", F.struct(F.col(key).cast("long").alias("key"), F.col(source).cast("string").alias("source"), size.alias("size")).cast(alike))
    number = F.row_number().over(Window.partitionBy("__same").orderBy(F.xxhash64(F.col(text)), F.col(text)))
    # Numbered first: the join then finds the texts where the numbering put them, so that they are shuffled once for both.
    found = rows.where("__same.size > 0").withColumn("__nth", number).join(places, "__same")
    found = found.select(*docs.columns, F.col("__same.size").alias("__size"), F.explode(F.element_at("__places", F.col("__nth"))["__takes"]).alias("__take"))
    whole = F.col("__take.taken") == F.col("__size")
    cut = F.when(whole, F.col(text)).otherwise(first_words(F.col(text), F.col("__take.taken").cast("int")))
    return found.orderBy("__take.slot").withColumn(text, cut).select(*docs.columns)


def keep_taken(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """Rows of ``docs`` from which the mix takes at least one word, unchanged and once each."""
    documents, _, pieces = mix(docs, key, text, source, **options)
    taken = taken_words(documents, pieces, key).where("taken > 0").select(F.col(key).alias("__key"), F.col("size").alias("__size"), F.col("source").alias("__source")).distinct()
    same = F.col(key).eqNullSafe(F.col("__key")) & (word_count(F.col(text)) == F.col("__size")) & F.col(source).eqNullSafe(F.col("__source"))
    return docs.join(taken, same, "left_semi")
