"""Hard negatives: rows of another label whose score lies in a window below a positive's, exactly.

Coordinates become whole, ``floor(scale * entry)``; a score is the inner product of two rows' coordinates. Candidates are
laid out once, by label and then along a Hilbert curve through the dimensions that vary most, and written to Parquet as
blocks of ``BLOCK_BYTES`` with the least and largest coordinate of every dimension beside them: the zone map. Interval
arithmetic over a zone map bounds all scores of an anchor with the block's rows. Anchors are packed in groups along the
same curve. Three steps follow:

* In its own block an anchor finds neighbours of its label for nothing; the worst of them is what others have to reach.
* Positives: of the blocks of its label, those whose upper bound reaches that score are read.
* Negatives: of the blocks of other labels, those whose bounds meet one of the anchor's windows are read.

Only zone maps and anchors meet to choose blocks, in cells of bounded size; the chosen blocks' rows are then joined to the
group. A task goes through them by falling bound and passes over those that can no longer improve any list. So the result
is that of comparing every anchor with every row, whatever the bounds are worth: on vectors spread evenly over many
dimensions they exclude little, on clustered ones most.

Defined results: rows whose identifier, label or vector is null, whose vector holds null or non-finite entries or has
another length than the most frequent one (the larger, of equally frequent ones) take no part. Rows equal in identifier,
label and vector are one. Rows that share an identifier only are candidates each; as anchors each has its own results. No
row is a candidate of an anchor with its identifier. Higher scores come first, ties by smaller identifier. An anchor with
fewer candidates has fewer; a positive whose window is empty (always, if its score is negative) has no rows. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, written
from .vectors import EXACT, commonest_length, finite, matrix, summed, whole

SCALE = 256.0
#: Bytes of coordinates in a block, zone maps and groups of anchors in a cell of the plan, anchors in a group.
BLOCK_BYTES = 1 << 16
SLICE, COLUMN, GROUP = 64, 8, 256
#: Dimensions that the curve goes through, at most, and bits of its positions.
CURVE_DIMENSIONS, CURVE_BITS = 16, 62

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
BLOCKS = "block long, label long, n int, ids binary, v binary, asks binary, low binary, high binary"
GROUPS = "group long, ids binary, labels binary, home binary, v binary, near binary, near_ids binary"
FOUND = "group long, at int, w int, score long, id long"


def hilbert_positions(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of rows of cell numbers with ``bits`` bits each."""
    x = np.ascontiguousarray(cells.T, dtype=np.int64)
    n = len(x)
    for b in range(bits - 1, 0, -1):  # undo the curve's turns, from the coarsest level
        q, p = 1 << b, (1 << b) - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, swap)
            x[i] ^= swap
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] & (1 << b)) != 0, (1 << b) - 1, 0)
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each row of ``a`` with any row inside each box."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


class Best:
    """The ``k`` best scores, ties by smaller identifier, inside windows ``low`` to ``high`` (anchors x windows)."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int) -> None:
        self.low, self.high, self.k = low, high, k
        self.score = np.full((*low.shape, k), -np.inf)
        self.id = np.full((*low.shape, k), np.iinfo(np.int64).max)

    def reach(self) -> np.ndarray:
        """The least score that may still enter each list."""
        return np.maximum(self.low, self.score[:, :, -1])

    def useful(self, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Anchors for which a block with these bounds (one pair per anchor) may hold an entry."""
        return ((most[:, None] >= self.reach()) & (least[:, None] <= self.high)).any(axis=1)

    def offer(self, who: np.ndarray, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """Scores (``who`` x rows) of rows ``ids``, of which ``allowed`` ones count."""
        for w in range(self.low.shape[1]):
            last, last_id = self.score[who, w, -1][:, None], self.id[who, w, -1][:, None]
            enters = (scores > last) | ((scores == last) & (ids[None, :] < last_id))
            a, r = np.nonzero(allowed & enters & (scores >= self.low[who, w][:, None]) & (scores <= self.high[who, w][:, None]))
            if not len(a):
                continue
            touched = np.unique(a)
            held = who[touched]
            a = np.concatenate([np.repeat(touched, self.k), a])
            s = np.concatenate([self.score[held, w].ravel(), scores[a[len(touched) * self.k :], r]])
            i = np.concatenate([self.id[held, w].ravel(), ids[r]])
            order = np.lexsort((i, -s, a))
            a, s, i = a[order], s[order], i[order]
            first = np.searchsorted(a, touched)
            at = first[:, None] + np.arange(self.k)[None, :]
            self.score[held, w], self.id[held, w] = s[at], i[at]

    def rows(self, group: int) -> pd.DataFrame:
        a, w, rank = np.nonzero(self.score > -np.inf)
        return pd.DataFrame({"group": np.full(len(a), group), "at": a.astype(np.int32), "w": w.astype(np.int32), "score": self.score[a, w, rank].astype(np.int64), "id": self.id[a, w, rank]})


def nothing(schema: str) -> pd.DataFrame:
    kinds = {"long": "int64", "int": "int32", "binary": "object", "double": "float64"}
    return pd.DataFrame({f.split()[0]: pd.Series(dtype=kinds[f.split()[1]]) for f in schema.split(", ")})


class Layout:
    """What the fit over all rows gives: length and storage type of the coordinates, and the curve's grid."""

    def __init__(self, rows: DataFrame, scale: float) -> None:
        self.scale = scale
        self.d = d = commonest_length(rows, "v")
        self.n = 0
        if not d:
            return

        rows = rows.where(F.size("v") == d)
        largest = rows.select(F.max(F.greatest(F.abs(F.array_max("v").cast("double")), F.abs(F.array_min("v").cast("double"))))).first()[0] or 0.0
        largest = int(np.ceil(largest * scale)) + 1
        if largest * largest * d >= EXACT:
            raise OverflowError("coordinates are too large for exact inner products")

        def moments(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            out = np.zeros(2 * d + 1)
            for batch in batches:
                x = whole(matrix(batch.column(0), d), scale).astype(np.float64)
                out[:d] += x.sum(axis=0)
                out[d : 2 * d] += (x * x).sum(axis=0)
                out[2 * d] += len(x)
            return out

        found = summed(rows.select("v"), moments, "double", 2 * d + 1)
        self.n = int(found[2 * d])
        self.kind = "i2" if largest < 1 << 15 else "i4" if largest < 1 << 31 else "i8"
        self.block_rows = max(16, BLOCK_BYTES // (d * np.dtype(self.kind).itemsize))
        mean = found[:d] / self.n
        spread = np.sqrt(np.maximum(found[d : 2 * d] / self.n - mean * mean, 0))
        self.along = np.sort(np.argsort(-spread, kind="stable")[:CURVE_DIMENSIONS])
        self.bits = min(16, CURVE_BITS // len(self.along))
        self.start, self.width = (mean - 2 * spread)[self.along], np.maximum(4 * spread, 1e-9)[self.along]

    def position(self, x: np.ndarray) -> np.ndarray:
        """Of whole coordinates, along the curve."""
        cells = np.floor((x[:, self.along] - self.start) / self.width * (1 << self.bits))
        return hilbert_positions(np.clip(cells, 0, (1 << self.bits) - 1).astype(np.int64), self.bits)

    def unpacked(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, self.kind).reshape(-1, self.d).astype(np.float64)


def as_blocks(rows: DataFrame, layout: Layout) -> DataFrame:
    """The candidates as Parquet, a row per block, with zone maps."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole(matrix(batch.column(3), layout.d), layout.scale)
            v = pa.array([r.tobytes() for r in x.astype(layout.kind)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(layout.position(x)), v], names=["id", "label", "asks", "position", "v"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            x = np.frombuffer(b"".join(r[3] for r in held), layout.kind).reshape(-1, layout.d)
            values = [base + made, held[0][0], len(held), np.array([r[1] for r in held], np.int64).tobytes(), x.tobytes()]
            values += [np.array([r[2] for r in held], bool).tobytes(), x.min(axis=0).tobytes(), x.max(axis=0).tobytes()]
            names = [f.split()[0] for f in BLOCKS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([value], pa.int32() if name == "n" else None) for name, value in zip(names, values)], names=names)

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held and row == held[-1]:
                    continue  # equal rows are neighbours here
                if held and (row[0] != held[0][0] or len(held) >= layout.block_rows):
                    last = held[-1]
                    yield block()
                    made, held = made + 1, []
                    if row == last:
                        continue
                held.append(row)
        if held:
            yield block()

    placed_rows = rows.select("id", "label", "asks", "v").mapInArrow(placed, "id long, label long, asks boolean, position long, v binary")
    order = ["label", "position", "id"]
    dealt = placed_rows.repartitionByRange(*order).sortWithinPartitions(*order, "v").select("label", "id", "asks", "v")
    return written(dealt.mapInArrow(packed, BLOCKS), "negatives-blocks")


def as_groups(blocks: DataFrame, layout: Layout, k: int) -> DataFrame:
    """Anchors in groups along the curve, each with its best neighbours of its label in its own block."""

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                asks = np.flatnonzero(np.frombuffer(row["asks"], bool))
                if not len(asks):
                    continue
                x, ids = layout.unpacked(row["v"]), np.frombuffer(row["ids"], np.int64)
                best = Best(np.full((len(asks), 1), -np.inf), np.full((len(asks), 1), np.inf), k)
                best.offer(np.arange(len(asks)), x[asks] @ x.T, ids, ids[asks][:, None] != ids[None, :])
                yield pa.RecordBatch.from_pydict({
                    "block": [row["block"]] * len(asks), "id": ids[asks], "label": [row["label"]] * len(asks),
                    "v": [r.tobytes() for r in x[asks].astype(layout.kind)],
                    "near": [r.tobytes() for r in best.score[:, 0]], "near_ids": [r.tobytes() for r in best.id[:, 0]],
                })

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        names = [f.split()[0] for f in GROUPS.split(", ")]
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                rows = batch.slice(at, GROUP)
                numbers = [np.array(rows.column(i).to_pylist(), np.int64).tobytes() for i in (1, 2, 0)]
                joined = [b"".join(rows.column(i).to_pylist()) for i in (3, 4, 5)]
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in [base + made, *numbers, *joined]], names=names)
                made += 1

    anchors = blocks.select("block", "label", "ids", "v", "asks").mapInArrow(asking, "block long, id long, label long, v binary, near binary, near_ids binary")
    anchors = anchors.repartitionByRange("block", "id").sortWithinPartitions("block", "id", "v")
    return written(anchors.mapInArrow(grouped, GROUPS), "negatives-groups")


class Anchors:
    """A group's rows as arrays, with the lists that a step is to fill."""

    def __init__(self, row: dict, layout: Layout, k: int) -> None:
        self.ids, self.labels, self.home = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels", "home"))
        self.v = layout.unpacked(row["v"])
        n = len(self.ids)
        if "windows" in row:
            low, high = np.frombuffer(row["windows"]).reshape(2, n, -1)
            self.best, self.same = Best(low, high, k), False
        else:
            self.best, self.same = Best(np.full((n, 1), -np.inf), np.full((n, 1), np.inf), k), True
            self.best.score[:, 0], self.best.id[:, 0] = np.frombuffer(row["near"]).reshape(n, k), np.frombuffer(row["near_ids"], np.int64).reshape(n, k)

    def labelled(self, labels: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Anchors x blocks: whether the block holds candidates that the anchor has not met."""
        same = self.labels[:, None] == labels[None, :]
        return same & (self.home[:, None] != blocks[None, :]) if self.same else ~same

    def wanted(self, zones: pd.DataFrame, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
        """Anchors x zones that have to be read as far as known, and the upper bounds."""
        low, high = (layout.unpacked(b"".join(zones[c])) for c in ("low", "high"))
        least, most = bounds(self.v, low, high)
        open_ = self.labelled(zones["label"].to_numpy(), zones["block"].to_numpy())
        reach = ((most[:, :, None] >= self.best.reach()[:, None, :]) & (least[:, :, None] <= self.best.high[:, None, :])).any(axis=2)
        return open_ & reach, most


def search(groups: DataFrame, blocks: DataFrame, layout: Layout, k: int) -> DataFrame:
    """``FOUND``: the best ``k`` entries of each list, from every slice of the blocks that had to be read."""
    zones = blocks.select("block", "label", "low", "high")
    slices = max(1, -(-zones.count() // SLICE))
    columns = max(1, -(-groups.count() // COLUMN))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sliced = F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int").alias("slice")
    dealt = F.pmod(F.xxhash64("group"), F.lit(columns)).cast("int").alias("column")
    left = groups.select("*", dealt).select("*", every(slices).alias("slice"))
    right = zones.select("*", sliced).select("*", every(columns).alias("column"))

    def choose(some: pd.DataFrame, boxes: pd.DataFrame) -> pd.DataFrame:
        out = [nothing("group long, block long, slice int, bound double")]
        for row in some.to_dict("records") if len(boxes) else []:
            needed, most = Anchors(row, layout, k).wanted(boxes, layout)
            some_need = needed.any(axis=0)
            bound = np.where(needed, most, -np.inf).max(axis=0)[some_need]
            out.append(pd.DataFrame({"group": row["group"], "block": boxes["block"].to_numpy()[some_need], "slice": row["slice"], "bound": bound}))
        return pd.concat(out)

    reads = left.groupBy("column", "slice").cogroup(right.groupBy("column", "slice")).applyInPandas(choose, "group long, block long, slice int, bound double")
    reads = written(reads, "negatives-reads").join(blocks.select("block", "label", "ids", "v", "low", "high"), "block")

    def read(some: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
        if not len(some) or not len(chosen):
            return nothing(FOUND)
        group = Anchors(some.to_dict("records")[0], layout, k)
        for row in chosen.sort_values(["bound", "block"], ascending=[False, True]).to_dict("records"):
            least, most = bounds(group.v, layout.unpacked(row["low"]), layout.unpacked(row["high"]))
            open_ = group.labelled(np.array([row["label"]]), np.array([row["block"]]))[:, 0]
            who = np.flatnonzero(open_ & group.best.useful(least[:, 0], most[:, 0]))
            if len(who):
                ids = np.frombuffer(row["ids"], np.int64)
                group.best.offer(who, group.v[who] @ layout.unpacked(row["v"]).T, ids, group.ids[who][:, None] != ids[None, :])
        return group.best.rows(some["group"].iloc[0])

    asked = groups.select("*", every(slices).alias("slice"))
    return asked.groupBy("group", "slice").cogroup(reads.groupBy("group", "slice")).applyInPandas(read, FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each list over all slices, with ``rank``. A neighbour in several slices' lists counts once."""
    once = found.distinct()
    order = Window.partitionBy("group", "at", "w").orderBy(F.desc("score"), "id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame,
    is_anchor: Callable[[Column], Column],
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    positives: int = 5,
    negatives: int = 3,
    window: tuple[int, int] = (50, 95),
    scale: float = SCALE,
) -> DataFrame:
    """``RESULT``: per anchor and positive the first ``negatives`` rows of another label whose score is between the
    window's per cents of the positive's."""
    spark = rows.sparkSession
    ship(spark)
    taken = rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v"))
    taken = taken.where("id is not null and label is not null").where(finite(F.col("v"))).where("size(v) > 0")
    layout = Layout(taken, scale)
    if not layout.d:
        return spark.createDataFrame([], RESULT)
    taken = taken.where(F.size("v") == layout.d).withColumn("asks", F.coalesce(is_anchor(F.col("id")), F.lit(False)))
    blocks = as_blocks(taken, layout)
    groups = as_groups(blocks, layout, positives)

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pandas(Anchors(row, layout, positives).best.rows(row["group"]), preserve_index=False)

    near = groups.mapInArrow(at_home, FOUND).unionByName(search(groups, blocks, layout, positives))
    near = written(ranked(near, positives).select("group", "at", "rank", "score", "id"), "negatives-positives")
    low, high = window

    def with_windows(some: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        n = len(some["ids"].iloc[0]) // 8 if len(some) else 0
        edges = np.full((2, n, positives), np.inf)
        edges[1] = -np.inf  # a window without a positive holds nothing
        at, w, score = near["at"].to_numpy(), near["rank"].to_numpy() - 1, near["score"].to_numpy()
        edges[0, at, w], edges[1, at, w] = -(-low * score // 100), high * score // 100
        return some.assign(windows=[edges.tobytes()] * len(some))

    asked = groups.groupBy("group").cogroup(near.groupBy("group")).applyInPandas(with_windows, GROUPS + ", windows binary")
    asked = written(asked, "negatives-windows")
    hard = ranked(search(asked, blocks, layout, negatives), negatives)

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.frombuffer(ids, np.int64)
                yield pa.RecordBatch.from_pydict({"group": np.full(len(ids), group), "at": np.arange(len(ids), dtype=np.int32), "anchor_id": ids})

    anchors = groups.select("group", "ids").mapInArrow(names, "group long, at int, anchor_id long")
    of = near.select("group", "at", (F.col("rank") - 1).alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = hard.join(of.join(anchors, ["group", "at"]), ["group", "at", "w"])
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
