"""Near duplicates: an exact Jaccard self-join of word n-gram sets by vertical partitioning.

N-grams have a global order: first those that few documents hold, then the frequent ones, by hash within either. (What
is frequent is counted; a bitmap of fixed size carries it, whose rare false marks only change the order.) The order is
cut into fragments, and so is every set. Two sets that are similar enough share an n-gram among the first
``n - ceil(t * n) + 1`` of either, so candidates are the sets that meet in such a prefix; for each candidate pair the
fragments' overlaps are counted separately and summed, which gives the exact size of the intersection.

Equal sets are one class. Of the classes that meet under an n-gram, all name one as their hub, the one most of whose
n-grams are shared; each class is compared with the hub that most of its n-grams name, and takes its label if they are
similar. Classes with the same hub, similar or not, are a region, and only classes with different labels are compared
further: within a region those outside of its largest label with all of it, block by block; across regions those that
meet early enough in both prefixes: what two sets have in common lies from their first common n-gram on, so its places
in both bound the overlap, and so do the bits of a signature in which two sets differ. So most of a group of thousands of near copies costs one comparison each, and
no link between labels is missed. Components come from all links in the end.

N-grams and classes are 64-bit hashes of the words and of the whole set.

Defined results: null and empty texts, and those without words, have an empty set and are linked with nothing; with
fewer words than ``n`` the whole sequence is the one n-gram. Repeated rows are one class. A row without identifier
takes its component's smallest one. Other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import remove_folder
from .common import checkpointed, ship, written

N = 5
THRESHOLD = 75  # per cent
#: Fragments of the rare n-grams, equal ranges of hashes; the frequent ones are one more.
FRAGMENTS = 8
#: Fragments whose overlaps are counted first; pairs that they rule out are not looked at further.
EARLY = 2
#: Documents from which an n-gram is frequent.
FREQUENT = 48
#: N-grams are counted in prefixes longer by this factor, as frequent ones leave their place to later ones.
MARGIN = 1.3
#: Bits of the bitmap of frequent n-grams, and least and most bits of the filter of wanted classes.
FREQUENT_BITS = 24
BLOOM_BITS = (16, 27)
#: Common n-grams of two prefixes, in the global order, that are looked for when classes meet across regions.
FIRST = 2
#: Columns of the bits by which the least difference of two sets is told.
ODD = ("odd_0", "odd_1")
#: N-grams that one bucket of the counting and meeting steps holds on average, and that a task sends at once.
BUCKET_GRAMS = 1_000_000
SEND_GRAMS = 400_000
#: Bytes of a text that are hashed at once.
SPAN = 1 << 20
#: Classes of a region that is compared pair by pair, and on either side of a block of a larger one.
PAIRWISE, BLOCK = 16, 192

_rng = np.random.default_rng(20)
_BYTE = _rng.integers(1, 1 << 63, 256, np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z are read as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_ODD = [int(x) | 1 for x in _rng.integers(1, 1 << 63, 8, np.uint64)]
_powers: list[np.ndarray] = []


def powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < length:
        size = max(length, 1 << 15)
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
        del _powers[:-2]
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def word_hashes(data: bytes) -> np.ndarray:
    """A hash of each word: its bytes' values as digits of a number modulo 2**64, then mixed."""
    b = np.frombuffer(data, np.uint8)
    edge = np.diff(np.concatenate(([True], _SPACE[b], [True])).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = powers(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * up[: len(b)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def parts(data: bytes) -> Iterator[bytes]:
    """The text in parts of about ``SPAN`` bytes, cut before white space."""
    start = 0
    while len(data) - start > SPAN:
        end = start + SPAN
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        yield data[start:end]
        start = end
    yield data[start:]


def ngram_set(text: str | None, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams."""
    data = (text or "").encode("utf-8", "replace")
    h = word_hashes(data) if len(data) <= SPAN else np.concatenate([word_hashes(p) for p in parts(data)])
    if not len(h):
        return h
    size = min(n, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out += h[k : len(h) - size + 1 + k] * np.uint64(_ODD[k % len(_ODD)] + 2 * (k // len(_ODD)))
    out = mixed(out)
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def class_of(grams: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix_length(n: int, threshold: int = THRESHOLD) -> int:
    return n - -(-threshold * n // 100) + 1


def marked(bitmap: np.ndarray, grams: np.ndarray) -> np.ndarray:
    at = grams & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def odd_bits(grams: np.ndarray) -> tuple[int, int]:
    """Of 128 ranges of a hash, which ones hold an odd number of the n-grams, as two numbers.

    Each n-gram that only one of two sets has changes one bit, so two sets differ by as many n-grams as bits at least.
    """
    odd = np.bincount((grams >> np.uint64(24) & np.uint64(127)).astype(np.int64), minlength=128) & 1
    return tuple(np.packbits(odd.astype(np.uint8)).view(np.int64).tolist())


def bitmap_of(positions: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of so many bits in which the numbers of the one column ``at`` are set, combined within tasks first."""
    at = F.col("at") + 1  # the functions count from 1
    chunks = positions.groupBy(F.bitmap_bucket_number(at).alias("chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("cells")).toArrow()
    out = np.zeros(bits // 8, np.uint8)
    for chunk, cells in zip(chunks["chunk"].to_pylist(), chunks["cells"].to_pylist()):
        part = out[(chunk - 1) * len(cells) :][: len(cells)]
        part[:] = np.frombuffer(cells, np.uint8)[: len(part)]
    return out


def release(spark) -> None:
    """Let Spark's cleaner remove the files of shuffles that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(table: DataFrame) -> None:
    """Delete a table of ``written`` that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        remove_folder(table.sparkSession, folder)


def components(edges: DataFrame) -> DataFrame:
    """``v``, ``label``: the smallest vertex of each one's component, by passing on minima and jumping along labels."""
    both = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), F.col("label").alias("other")), "b").groupBy(F.col("a").alias("v")).agg(F.min("other").alias("other"))
        step = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "other").alias("label"))
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("further"))
        step = checkpointed(step.join(jump, "label").select("v", "old", F.least("label", "further").alias("label")))
        labels = step.select("v", "label")
        if step.where("old <> label").isEmpty():
            return labels


def bucketed(texts: DataFrame, grams_of: Callable, buckets: int) -> DataFrame:
    """``bucket`` and binary columns ``s``, ``cls``, ``n``: what ``grams_of`` gives of each text, dealt by ranges of hashes.

    A task sends arrays, one row per bucket and ``SEND_GRAMS`` n-grams, not a row per n-gram.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            s = np.concatenate([h[0] for h in held])
            lengths = [len(h[0]) for h in held]
            cls = np.repeat(np.array([h[1] for h in held], np.int64), lengths)
            n = np.repeat(np.array([h[2] for h in held], np.int32), lengths)
            to = (s >> np.uint64(40)).astype(np.int64) * buckets >> 24
            order = np.argsort(to, kind="stable")
            s, cls, n = s[order], cls[order], n[order]
            ends = np.searchsorted(to[order], np.arange(buckets + 1))
            full = np.flatnonzero(ends[1:] > ends[:-1])
            cut = lambda a: pa.array([a[ends[b] : ends[b + 1]].tobytes() for b in full], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), cut(s), cut(cls), cut(n)], names=["bucket", "s", "cls", "n"])

        seen: set[int] = set()
        for batch in batches:
            for t in batch.column(0):
                found = grams_of(t.as_py(), seen)
                if found is not None and len(found[0]):
                    held.append(found)
                    size += len(found[0])
                    if size >= SEND_GRAMS:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    return texts.mapInArrow(send, "bucket int, s binary, cls binary, n binary")


def arrays(table: pa.Table, *columns: tuple[str, str]) -> list[np.ndarray]:
    return [np.concatenate([np.frombuffer(x, kind) for x in table[c].to_pylist()]) for c, kind in columns]


def frequent_bitmap(texts: DataFrame, n: int, threshold: int, buckets: int) -> np.ndarray:
    """Marks of the n-grams that ``FREQUENT`` documents or more hold, among those that can come into a prefix."""

    def grams_of(t: str, seen: set) -> tuple:
        grams = ngram_set(t, n)
        return grams[: int(MARGIN * prefix_length(len(grams), threshold)) + 1], 0, 0

    def frequent(table: pa.Table) -> pa.Table:
        (s,) = arrays(table, ("s", "u8"))
        values, times = np.unique(s, return_counts=True)
        return pa.table({"s": pa.array(values[times >= FREQUENT].view(np.int64))})

    found = bucketed(texts, grams_of, buckets).groupBy("bucket").applyInArrow(frequent, "s long")
    return bitmap_of(found.select(F.col("s").bitwiseAND((1 << FREQUENT_BITS) - 1).alias("at")), 1 << FREQUENT_BITS)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, threshold: int = THRESHOLD) -> DataFrame:
    """Key, ``n_shingles``, ``component_id`` of every row."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(text).alias("text"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = int(np.clip(words // 6 // 3 // BUCKET_GRAMS, 2 * partitions, 1 << 20))

    bitmap = spark.sparkContext.broadcast(frequent_bitmap(texts, n, threshold, buckets))
    release(spark)

    def prefix(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rare and the frequent n-grams of a set's prefix."""
        frequent = marked(bitmap.value, grams)
        rare, rest = grams[~frequent], grams[frequent]
        size = prefix_length(len(grams), threshold)
        return rare[:size], rest[: max(0, size - len(rare))]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            sizes, names, hot, last, odd = [], [], [], [], []
            for t in batch.column("text"):
                grams = ngram_set(t.as_py(), n)
                name = class_of(grams) if len(grams) else None
                sizes.append(len(grams))
                names.append(name)
                new = name is not None and name not in seen
                own, rest = prefix(grams) if new else ((), ())
                odd.append(odd_bits(grams) if new else (None, None))
                hot.append(rest.view(np.int64) if len(rest) else None)
                last.append((int(rest[-1]) >> 2) + (1 << 62) if len(rest) else int(own[-1]) >> 2 if len(own) else None)
                seen.add(name)
            columns = [batch.column("key"), pa.array(sizes, pa.int32()), pa.array(names, pa.int64()), pa.array(hot, pa.list_(pa.int64())), pa.array(last, pa.int64())]
            columns += [pa.array([x[i] for x in odd], pa.int64()) for i in range(2)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "n", "cls", "hot", "last", *ODD])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    rows = written(rows.mapInArrow(sets, "key long, n int, cls long, hot array<long>, last long, " + ", ".join(f"{c} long" for c in ODD)), "ngram-sets")

    def rare_of(t: str, seen: set) -> tuple | None:
        grams = ngram_set(t, n)
        if not len(grams) or (name := class_of(grams)) in seen:
            return None
        seen.add(name)
        return prefix(grams)[0], name, len(grams)

    rare = bucketed(texts, rare_of, buckets).groupBy("bucket").applyInArrow(meet, "s long, cls long, n int")
    met = rare.withColumn("frequent", F.lit(False)).unionByName(meet_frequent(rows).withColumn("frequent", F.lit(True)))
    met = written(met, "ngram-meetings")
    release(spark)
    # The place in the order where each prefix ends says what of two sets has been compared when their meetings are known.
    ends = rows.where("last is not null").groupBy("cls", "n").agg(*[F.max(c).alias(c) for c in ("last", *ODD)])
    shared = met.groupBy("cls", "n").agg(F.count("*").cast("int").alias("met")).join(ends, ["cls", "n"])
    shared = shared.withColumn("likely", 2 * F.col("met") >= least_shared("n", "n", threshold))
    segments = fragments(texts, shared.where("likely").select("cls"), bitmap, n)
    # Place among the n-grams that the class shares with any other, in the global order: hashes are unsigned there.
    rank = F.row_number().over(Window.partitionBy("cls", "n").orderBy("frequent", F.col("s") < 0, "s"))
    meetings = met
    met = met.join(shared, ["cls", "n"]).select("s", "cls", "n", "likely", "met", rank.alias("rank"), "last", (F.col("met") / F.col("n")).alias("share"), *ODD)
    met = written(met, "ngram-shares")
    discard(meetings)
    release(spark)

    likely = met.where("likely")
    hub = F.max(F.struct("share", "cls", "n", "met", "last")).alias("hub")
    hubs = likely.groupBy("s").agg(hub).select("s", F.col("hub.cls").alias("hub"), *[F.col(f"hub.{c}").alias(f"hub_{c}") for c in ("n", "met", "last")])
    named = likely.join(hubs, "s").where("cls <> hub").where(possible(("n", "last"), ("hub_n", "hub_last"), F.least("met", "hub_met"), threshold))
    # Too few n-grams in common make no likely link; what is left out here is looked at in the end.
    named = named.groupBy("cls", "n", "hub", "hub_n").agg(F.count("*").alias("votes")).where(2 * F.col("votes") >= least_shared("n", "hub_n", threshold))
    best = named.groupBy("cls", "n").agg(F.max(F.struct("votes", "hub", "hub_n")).alias("x"))
    star = written(best.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("x.hub").alias("b"), F.col("x.hub_n").alias("nb")), "ngram-star")
    release(spark)
    edges = written(linked(star, segments, threshold), "ngram-edges")
    release(spark)
    regions = written(named_by(star, edges), "ngram-regions")
    edges = edges.unionByName(within(regions, segments, threshold))
    discard(segments)
    release(spark)

    # What meets across regions. A pair is counted under the n-grams that may be among its first ``FIRST`` common ones.
    placed = place(met, regions.select("v", F.col("region").alias("label")))
    discard(met)
    release(spark)
    counted = placed.groupBy("s", "label").agg(F.count("*").alias("m"))
    main = counted.groupBy("s").agg(F.max(F.struct("m", "label")).alias("x"), F.count("*").alias("labels")).where("labels > 1").select("s", F.col("x.label").alias("main"))
    names = lambda x: [F.col(c).alias(f"{d}{x}") for c, d in (("cls", ""), ("n", "n"), ("met", "met_"), ("rank", "rank_"), ("last", "last_"), ("label", "l"), *[(c, f"{c}_") for c in ODD])]
    left, right = placed.join(main, "s").where("label <> main").select("s", "main", *names("a")), placed.select("s", *names("b"))
    across = left.join(right, "s").where("la <> lb and (lb = main or a < b)")
    ends = (("na", "last_a"), ("nb", "last_b"))
    # What may be common after this n-gram, of the prefixes and of the sets.
    later, rest = [F.least(*[F.col(f"{most}{x}") - F.col(f"rank_{x}") for x in "ab"]) for most in ("met_", "n")]
    across = across.where(possible(*ends, F.least("met_a", "met_b", later + FIRST), threshold)).where(reached(rest + FIRST, "na", "nb", threshold))
    differ = sum(F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in ODD)
    across = across.where(reached(F.floor((F.col("na") + F.col("nb") - differ) / 2), "na", "nb", threshold))
    first, sides = F.col("a") < F.col("b"), ["a", "na", "last_a", "b", "nb", "last_b"]
    across = across.select(*[F.when(first, F.col(x)).otherwise(F.col(y)).alias(x) for x, y in zip(sides, [*sides[3:], *sides[:3]])], later.alias("later"), rest.alias("rest"))
    across = across.groupBy(*sides).agg(F.count("*").alias("shared"), F.min("later").alias("later"), F.min("rest").alias("rest"))
    # The n-grams that are left out come after all that are counted, so the last one counted bounds them.
    across = across.where(F.col("shared") >= F.least(F.lit(FIRST), least_shared("na", "nb", threshold)))
    across = across.where(F.col("shared") + F.col("later") >= least_shared("na", "nb", threshold))
    across = across.where(possible(*ends, F.col("shared") + F.col("later"), threshold)).where(reached(F.col("shared") + F.col("rest"), "na", "nb", threshold))
    across = written(across.select("a", "na", "b", "nb"), "ngram-across")
    release(spark)
    if not across.isEmpty():
        again = fragments(texts, across.select(F.explode(F.array("a", "b")).alias("cls")), bitmap, n)
        edges = edges.unionByName(linked(across, again, threshold))
    labels = components(edges)

    own = rows.where("cls is not null").groupBy("cls").agg(F.min("key").alias("least"))
    joined = own.join(labels.withColumnRenamed("v", "cls"), "cls", "left").select("cls", "least", F.coalesce("label", "cls").alias("label"))
    joined = checkpointed(joined)
    least = joined.groupBy("label").agg(F.min("least").alias("component_id"))
    final = joined.select("cls", "label").join(least, "label").select("cls", "component_id")
    return rows.select("key", "n", "cls").join(final, "cls", "left").select(F.col("key").alias(key), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id"))


def named_by(star: DataFrame, edges: DataFrame) -> DataFrame:
    """``v``, ``n``, ``region``, ``label`` of the classes of the star: the hub's hub, the hub, or the class itself; for the
    label only as far as they are linked."""
    own = star.join(edges.withColumn("is_linked", F.lit(True)), ["a", "b"], "left")
    own = own.select(F.col("a").alias("v"), F.col("na").alias("n"), F.col("b").alias("hub"), F.coalesce("is_linked", F.lit(False)).alias("is_linked"))
    hubs = star.groupBy(F.col("b").alias("v")).agg(F.first("nb").alias("n")).join(own, "v", "left_anti").select("v", "n", F.col("v").alias("region"), F.col("v").alias("label"))
    further = own.select(F.col("v").alias("hub"), F.col("hub").alias("next"), F.when(F.col("is_linked"), F.col("hub")).alias("next_linked"))
    label = F.when(F.col("is_linked"), F.coalesce("next_linked", "hub")).otherwise(F.col("v"))
    return own.join(further, "hub", "left").select("v", "n", F.coalesce("next", "hub").alias("region"), label.alias("label")).unionByName(hubs)


def place(met: DataFrame, labels: DataFrame) -> DataFrame:
    """Meetings with the component that each class is in so far."""
    placed = met.join(labels.withColumnRenamed("v", "cls"), "cls", "left")
    return written(placed.select("s", "cls", "n", "met", "rank", "last", *ODD, F.coalesce("label", "cls").alias("label")), "ngram-placed")


def least_shared(a: str, b: str, threshold: int) -> Column:
    """N-grams that the prefixes of two similar sets share at least.

    The prefix that ends first in the global order holds whatever both share up to there, and so does the other one; the
    rest of the intersection lies in the rest of that set.
    """
    overlap = F.ceil(F.lit(threshold) * (F.col(a) + F.col(b)) / (100 + threshold))
    rest = F.greatest(*[F.ceil(F.lit(threshold) * F.col(x) / 100) - 1 for x in (a, b)])
    return F.greatest(F.lit(1), overlap - rest)


def reached(overlap: Column, a: str, b: str, threshold: int) -> Column:
    """Whether an overlap, or a bound of it, is enough for the similarity of sets of these sizes."""
    return 100 * overlap >= threshold * (F.col(a) + F.col(b) - overlap)


def alike(a: str, b: str, threshold: int):
    """Sizes that allow the similarity."""
    return 100 * F.least(a, b) >= threshold * F.greatest(a, b)


def possible(a: tuple[str, str], b: tuple[str, str], shared: Column, threshold: int) -> Column:
    """Whether two sets may be similar that meet under ``shared`` n-grams of their prefixes, or fewer.

    Each side has its size and the end of its prefix in the order. The set whose prefix ends first shares no other n-gram
    of its prefix with the other one: what the other one has of them lies in its own prefix, where they would have met.
    """
    (na, end_a), (nb, end_b) = (tuple(map(F.col, x)) for x in (a, b))
    beyond = lambda n: F.floor((threshold * n + 99) / 100) - 1
    most = F.least(F.when(end_a < end_b, beyond(na) + shared).otherwise(na), F.when(end_b < end_a, beyond(nb) + shared).otherwise(nb))
    return 100 * F.least(most, na, nb) >= threshold * (na + nb - F.least(most, na, nb))


def meet(table: pa.Table) -> pa.Table:
    """``s``, ``cls``, ``n`` of the n-grams of a bucket under which at least two classes meet."""
    s, cls, n = arrays(table, ("s", "u8"), ("cls", "i8"), ("n", "i4"))
    order = np.lexsort((cls, s))
    s, cls, n = s[order], cls[order], n[order]
    once = np.concatenate(([True], (s[1:] != s[:-1]) | (cls[1:] != cls[:-1])))
    s, cls, n = s[once], cls[once], n[once]
    starts = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    sizes = np.diff(np.append(starts, len(s)))
    shared = np.repeat(sizes > 1, sizes)
    return pa.table([pa.array(s[shared].view(np.int64)), pa.array(cls[shared]), pa.array(n[shared])], names=["s", "cls", "n"])


def meet_frequent(rows: DataFrame) -> DataFrame:
    """The same for frequent n-grams, which may have very many classes each: combined before they are shuffled, and
    joined in a way that adaptive execution can split."""
    postings = rows.where("hot is not null").select(F.explode("hot").alias("s"), "cls", "n")
    found = postings.groupBy("s").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low <> high").select("s")
    return postings.join(found, "s").distinct()


def fragments(texts: DataFrame, classes: DataFrame, bitmap, n: int) -> DataFrame:
    """``cls``, ``fragment``, ``grams`` of the classes, and how many n-grams are in the ``early`` fragments; the first
    fragment is there even if it is empty. A Bloom filter of bounded size keeps most others from the shuffle."""
    spark = texts.sparkSession
    wanted = written(classes.distinct(), "ngram-wanted")
    low, high = BLOOM_BITS
    bits = int(np.clip(int(16 * max(1, wanted.count())).bit_length(), low, high))

    places = F.array(F.col("cls").bitwiseAND((1 << bits) - 1), F.shiftrightunsigned("cls", 64 - bits))
    bloom = spark.sparkContext.broadcast(bitmap_of(wanted.select(F.explode(places).alias("at")), 1 << bits))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        has = lambda at: bloom.value[at >> 3] >> (at & 7) & 1
        for batch in batches:
            names, places, grams_of, early = [], [], [], []
            for t in batch.column(0):
                grams = ngram_set(t.as_py(), n)
                if not len(grams):
                    continue
                name = class_of(grams)
                u = name % (1 << 64)
                if name in seen or not (has(u & (1 << bits) - 1) and has(u >> (64 - bits))):
                    continue
                seen.add(name)
                part = np.where(marked(bitmap.value, grams), FRAGMENTS, (grams >> np.uint64(60)).astype(np.int64) * FRAGMENTS // 16)
                order = np.argsort(part, kind="stable")
                ends = np.searchsorted(part[order], np.arange(FRAGMENTS + 2))
                for f in range(FRAGMENTS + 1):
                    if ends[f] < ends[f + 1] or not f:
                        early.append(int(ends[EARLY]))
                        names.append(name)
                        places.append(f)
                        grams_of.append(grams[order[ends[f] : ends[f + 1]]].view(np.int64))
            columns = [pa.array(names, pa.int64()), pa.array(places, pa.int32()), pa.array(grams_of, pa.list_(pa.int64())), pa.array(early, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["cls", "fragment", "grams", "early"])

    found = texts.mapInArrow(cut, "cls long, fragment int, grams array<long>, early int")
    return written(found.join(wanted, "cls", "left_semi").dropDuplicates(["cls", "fragment"]), "ngram-fragments")


def linked(pairs: DataFrame, segments: DataFrame, threshold: int) -> DataFrame:
    """Pairs whose overlaps, counted per fragment and summed, reach the similarity.

    The first fragments are counted for all pairs, the others only for those that these leave possible.
    """

    names = ["a", "na", "b", "nb"]

    def counted(pairs: DataFrame, segments: DataFrame) -> DataFrame:
        a, b = (segments.select(F.col("cls").alias(x), "fragment", F.col("grams").alias(f"g{x}"), F.col("early").alias(f"i{x}")) for x in "ab")
        partial = pairs.select(*names).join(a, "a").join(b, ["b", "fragment"]).select(*names, "ia", "ib", F.size(F.array_intersect("ga", "gb")).alias("both"))
        return partial.groupBy(*names).agg(F.sum("both").alias("both"), F.first("ia").alias("ia"), F.first("ib").alias("ib"))

    first = counted(pairs, segments.where(F.col("fragment") < EARLY)).withColumnRenamed("both", "first")
    most = F.col("first") + F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))
    left = first.where(100 * most >= threshold * (F.col("na") + F.col("nb") - most)).select(*names, "first")
    left = written(left, "ngram-possible")
    release(pairs.sparkSession)
    total = left.join(counted(left, segments.where(F.col("fragment") >= EARLY)), names, "left")
    both = F.col("first") + F.coalesce("both", F.lit(0))
    return total.where(100 * both >= threshold * (F.col("na") + F.col("nb") - both)).select("a", "b")


def compared(left: pd.DataFrame, right: pd.DataFrame, threshold: int) -> pd.DataFrame:
    """Links of a block: of each class on the left, one to every other component on the right."""
    a, b = (list(f.groupby("cls")["label"].first().items()) for f in (left, right))
    both = np.zeros((len(a), len(b)), np.int64)
    sizes = [np.zeros(len(x), np.int64) for x in (a, b)]
    at = [{cls: i for i, (cls, _) in enumerate(x)} for x in (a, b)]
    for _, of in right.groupby("fragment"):
        grams = np.unique(np.concatenate(of["grams"].tolist()))
        rows = of["cls"].map(at[1]).to_numpy()
        lengths = of["grams"].map(len).to_numpy()
        sizes[1][rows] += lengths
        places = np.searchsorted(grams, np.concatenate(of["grams"].tolist()))
        starts = np.cumsum(lengths) - lengths
        mine = left[left["fragment"] == of["fragment"].iloc[0]]
        for cls, x in zip(mine["cls"], mine["grams"]):
            marks = np.zeros(len(grams), np.int64)
            found = np.searchsorted(grams, x)
            inside = found < len(grams)
            marks[found[inside][grams[found[inside]] == x[inside]]] = 1
            both[at[0][cls], rows] += np.add.reduceat(marks[places], starts)
    np.add.at(sizes[0], left["cls"].map(at[0]).to_numpy(), left["grams"].map(len).to_numpy())
    total = sizes[0][:, None] + sizes[1][None, :] - both
    labels = [np.array([x for _, x in y]) for y in (a, b)]
    i, k = np.nonzero((100 * both >= threshold * total) & (labels[0][:, None] != labels[1][None, :]))
    links = pd.DataFrame({"a": np.array([x for x, _ in a], np.int64)[i], "b": np.array([x for x, _ in b], np.int64)[k], "label": labels[1][k]})
    return links.groupby(["a", "label"], as_index=False)["b"].min()[["a", "b"]]


def within(regions: DataFrame, segments: DataFrame, threshold: int) -> DataFrame:
    """Links inside regions between different labels: classes outside a region's largest label against all of it.

    Small regions are compared pair by pair. Of larger ones both sides are dealt into blocks of about ``BLOCK`` classes; a
    class goes to as many blocks as the other side has.
    """
    members = regions.select(F.col("v").alias("cls"), "n", "region", "label")
    counted = members.groupBy("region", "label").agg(F.count("*").alias("m"))
    counted = counted.groupBy("region").agg(F.max(F.struct("m", "label")).alias("x"), F.sum("m").alias("all")).where(F.col("all") > F.col("x.m"))
    blocks = counted.select("region", "all", F.col("x.label").alias("main"), F.ceil((F.col("all") - F.col("x.m")) / BLOCK).alias("rows"), F.ceil(F.col("all") / BLOCK).alias("columns"))
    members = written(members.join(blocks, "region"), "ngram-members")

    few = members.where(F.col("all") <= PAIRWISE)
    one = few.where("label <> main").select("region", "main", F.col("cls").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"))
    other = few.select("region", F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"))
    pairs = one.join(other, "region").where("la <> lb and (lb = main or a < b)").where(alike("na", "nb", threshold)).select("a", "na", "b", "nb")

    many = members.where(F.col("all") > PAIRWISE).join(segments.where(F.size("grams") > 0).drop("early"), "cls")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    key, kept = ["region", "row", "column"], ["cls", "label", "fragment", "grams"]
    left = many.where("label <> main").select("region", F.pmod(F.xxhash64("cls"), "rows").alias("row"), every("columns").alias("column"), *kept)
    right = many.select("region", every("rows").alias("row"), F.pmod(F.xxhash64("cls", F.lit(1)), "columns").alias("column"), *kept)
    left = left.select(*[F.col(c).alias(c) for c in left.columns])  # columns of its own beside the other side's

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        return compared(a, b, threshold)

    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(compare, "a long, b long")
    return written(found.unionByName(linked(pairs, segments, threshold)), "ngram-within")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The row of each component whose identifier is smallest, unchanged; rows that share it stay together."""
    stays = near_duplicates(docs, key, text, **options).where(F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias("__key")).distinct()
    return docs.join(stays, F.col(key).eqNullSafe(F.col("__key")), "left_semi")
