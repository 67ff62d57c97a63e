"""Approximate nearest neighbours by learned partitions.

At most ``SAMPLE`` valid vectors, those that hash lowest, are taken; all but every ``HELD_OUT``-th of them are joined to
their nearest neighbours among each other; the graph is cut into balanced partitions by capacity-bound label moves; a small network (one hidden layer) learns to tell
a vector's partition. It files every row of the table under its most probable partition and routes a query to the
``probes`` most probable ones, where all rows are compared exactly. The number of probes is the smallest that
finds ``RECALL`` of the true neighbours of the rows held out, less ``SURE`` standard errors of that share; where they are
too few to say, all partitions are probed.

Partitions are about the square root of the rows up to ``ROOT_PARTITIONS``, or as many as keep ``rows_per_partition`` rows each if those are more,
``MAX_PARTITIONS`` at most; a table too small for two partitions of ``LEAST_SAMPLE`` sample rows has one. Sizes of sample, graph and
network are fixed by parameters, and only the network is broadcast. Rows and queries of a partition are dealt into
blocks of bounded size, so a hot partition (a vector repeated a million times) is many tasks; each block passes on its
best ``k`` per query.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do vectors whose
length is not the most frequent one. Nearness is the cosine in double precision; ties go to the smaller identifier. Rows
with the query's own identifier are no candidates. Fewer than ``k`` candidates give as many rows. An identifier that
occurs again is one candidate, as near as its nearest vector, and one query, with the vector that sorts first.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship

SAMPLE = 8192
#: Every so many sample rows one is kept from the network, to calibrate the probes.
HELD_OUT = 4
#: Standard errors by which the recall of the rows held out has to be above the one asked for.
SURE = 2.0
#: Sample rows that a partition has on average, at least.
LEAST_SAMPLE = 8
GRAPH_NEIGHBOURS = 10
HIDDEN = 96
RECALL = 0.97
ROWS_PER_PARTITION = 2000
#: A query goes to each partition probed, so the square root of the rows makes no more partitions than this.
ROOT_PARTITIONS = 64
MAX_PARTITIONS = 256
BLOCK_ROWS = 20_000
BLOCK_QUERIES = 5_000
#: Pairs whose vectors are multiplied out together.
PAIRS = 1 << 16


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each unit vector, in blocks."""
    out = np.empty((len(x), k), np.int64)
    for i in range(0, len(x), 1024):
        near = x[i : i + 1024] @ x.T
        near[np.arange(len(near)), np.arange(i, i + len(near))] = -2
        out[i : i + 1024] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def balanced_partition(x: np.ndarray, links: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.15, seed: int = 3) -> np.ndarray:
    """Labels with at most ``slack`` times the even share each; rows move to where most of their neighbours are."""
    rng = np.random.default_rng(seed)
    room = int(np.ceil(slack * len(x) / parts))
    centres = x[rng.choice(len(x), parts, replace=False)]
    label = np.full(len(x), -1)
    for step in range(rounds):
        votes = np.zeros((len(x), parts), np.float32)
        if step:
            for column in links.T:
                np.add.at(votes, (np.arange(len(x)), label[column]), 1.0)
            np.add.at(votes, (links.ravel(), np.repeat(label, links.shape[1])), 1.0)
        # Nearness to the centre breaks ties of votes and starts the first round.
        votes += x @ centres.T
        best = np.sort(votes, axis=1)
        sure = np.argsort(-(best[:, -1] - best[:, -2]) if parts > 1 else np.zeros(len(x)), kind="stable")
        filled = np.zeros(parts, np.int64)
        choices = np.argsort(-votes, axis=1, kind="stable")
        new = np.empty(len(x), np.int64)
        for i in sure:
            for p in choices[i]:
                if filled[p] < room:
                    new[i] = p
                    filled[p] += 1
                    break
        if (new == label).all():
            break
        label = new
        sums = np.zeros((parts, x.shape[1]), np.float32)
        np.add.at(sums, label, x)
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return label


@dataclass
class Router:
    """A network with one hidden layer that gives the log odds of each partition."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def route(self, x: np.ndarray, probes: int) -> np.ndarray:
        odds = self.odds(x)
        probes = min(probes, odds.shape[1])
        at = np.argpartition(-odds, probes - 1, axis=1)[:, :probes]
        return np.take_along_axis(at, np.argsort(-np.take_along_axis(odds, at, 1), axis=1, kind="stable"), 1)


def learn(x: np.ndarray, label: np.ndarray, parts: int, hidden: int = HIDDEN, epochs: int = 30, seed: int = 5) -> Router:
    """Cross-entropy by Adam over shuffled batches, from a fixed start."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    p = [rng.standard_normal((d, hidden)).astype(np.float32) * (2 / d) ** 0.5, np.zeros(hidden, np.float32), rng.standard_normal((hidden, parts)).astype(np.float32) * (2 / hidden) ** 0.5, np.zeros(parts, np.float32)]
    # Vectors have length one; larger inputs let the layer work in its useful range.
    scale = np.float32(d**0.5)
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for epoch in range(epochs):
        rate = 3e-3 * (1 - epoch / epochs)
        order = rng.permutation(len(x))
        for i in range(0, len(x), 256):
            at = order[i : i + 256]
            a = x[at] * scale
            h = np.maximum(a @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            z[np.arange(len(at)), label[at]] -= 1
            z /= len(at)
            back = (z @ p[2].T) * (h > 0)
            t += 1
            for k, g in enumerate((a.T @ back, back.sum(0), h.T @ z, z.sum(0))):
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return Router(p[0] * scale, p[1], p[2], p[3])


def calibrate(router: Router, held: np.ndarray, x: np.ndarray, k: int, recall: float) -> int:
    """The fewest probes with which rows that the router has not seen find the share of their true neighbours.

    All rows are filed as the router files them. The share has to hold by ``SURE`` standard errors over the rows.
    """
    parts = router.w2.shape[1]
    filed = router.route(x, 1)[:, 0]
    odds = router.odds(held)
    rank = np.empty_like(odds, dtype=np.int64)
    np.put_along_axis(rank, np.argsort(-odds, axis=1, kind="stable"), np.arange(parts)[None, :], 1)
    near = np.argpartition(-(held @ x.T), k - 1, axis=1)[:, :k]
    needed = np.take_along_axis(rank, filed[near], 1)
    for probes in range(1, parts):
        found = (needed < probes).mean(axis=1)
        if found.mean() - SURE * max(found.std(), 1 / len(found)) / len(found) ** 0.5 >= recall:
            return probes
    return parts


def fit(x: np.ndarray, rows: int, k: int, rows_per_partition: int = ROWS_PER_PARTITION, recall: float = RECALL) -> Router:
    x = unit(x.astype(np.float32)) if len(x) else x
    out = np.arange(len(x)) % HELD_OUT == HELD_OUT - 1
    held, x = x[out], x[~out]
    parts = int(np.clip(max(rows // rows_per_partition, min(ROOT_PARTITIONS, math.isqrt(rows))), 1, min(MAX_PARTITIONS, max(1, len(x) // LEAST_SAMPLE))))
    if parts == 1:
        d = x.shape[1] if x.ndim == 2 else 1
        return Router(np.zeros((d, 1), np.float32), np.zeros(1, np.float32), np.zeros((1, 1), np.float32), np.zeros(1, np.float32))
    links = graph(x, min(GRAPH_NEIGHBOURS, len(x) - 1))
    router = learn(x, balanced_partition(x, links, parts), parts)
    router.probes = calibrate(router, held, x, min(k, len(x)), recall)
    return router


def valid_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``id`` and ``v`` (doubles) of the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    rows = rows.select(F.col(key).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1)
    return rows.join(F.broadcast(common.select("d")), F.size("v") == F.col("d"), "left_semi")


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def scored(near: np.ndarray, a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Query, row and exact cosine of the pairs marked, about ``PAIRS`` at a time."""
    q, r = np.nonzero(near)
    for at in range(0, max(len(q), 1), PAIRS):
        i, j = q[at : at + PAIRS], r[at : at + PAIRS]
        yield i, j, (a[i] * b[j]).sum(axis=1) / (na[i] * nb[j])


def best(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest rows of each query, by a product in double precision and then one exact sum per pair kept."""
    if not len(queries) or not len(rows):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
    rows = rows.sort_values("id", kind="stable")
    b, ids = matrix(rows["v"]), rows["id"].to_numpy()
    # Equal vectors have equal scores: of each, only the k + 1 smallest identifiers (one may be the query's own) can come first.
    same = pd.DataFrame({"v": pd.factorize(np.array([x.tobytes() for x in b + 0.0], object))[0], "id": ids})
    able = ~same.duplicated().to_numpy()
    able[able] = (same[able].groupby("v").cumcount() <= k).to_numpy()
    b, ids = b[able], ids[able]
    nb = np.sqrt((b * b).sum(axis=1))
    wide = k + len(ids) - len(np.unique(ids))
    out = []
    for at in range(0, len(queries), 256):
        part = queries.iloc[at : at + 256]
        a, own = matrix(part["v"]), part["id"].to_numpy()
        na = np.sqrt((a * a).sum(axis=1))
        near = (a / na[:, None]) @ (b / nb[:, None]).T
        near[own[:, None] == ids[None, :]] = -np.inf
        bound = np.partition(near, -wide, axis=1)[:, -wide] if near.shape[1] > wide else np.full(len(near), -1e300)
        near = near >= bound[:, None] - 1e-9
        q, r, score = (np.concatenate(x) for x in zip(*scored(near, a, na, b, nb)))
        order = np.lexsort((ids[r], -score, q))
        q, r, score = q[order], r[order], score[order]
        if wide > k:
            once = ~pd.DataFrame({"q": q, "id": ids[r]}).duplicated().to_numpy()
            q, r, score = q[once], r[once], score[once]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        keep = rank < k
        out.append(pd.DataFrame({"query_id": own[q[keep]], "vec_id": ids[r[keep]], "score": score[keep]}))
    return pd.concat(out)


def search(rows: DataFrame, is_query: Callable[[Column], Column], k: int = 5, key: str = "vec_id", vector: str = "embedding", rows_per_partition: int = ROWS_PER_PARTITION, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k nearest rows found for every row whose identifier ``is_query``."""
    spark = rows.sparkSession
    ship(spark)
    valid = valid_vectors(rows, key, vector)
    total = valid.count()
    chosen = valid.orderBy(F.xxhash64("id", "v"), "id").limit(sample).select("v").toArrow()
    x = np.array(chosen["v"].to_pylist(), np.float64) if chosen.num_rows else np.zeros((0, 1))
    router = fit(x, total, k, rows_per_partition, recall)
    shared = spark.sparkContext.broadcast(router)

    def route(probes: int):
        def routed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    at = shared.value.route(unit(matrix(f["v"])).astype(np.float32), probes)
                    yield pd.DataFrame({"part": at.ravel().astype(np.int32), "id": np.repeat(f["id"].to_numpy(), at.shape[1]), "v": [x for x in f["v"] for _ in range(at.shape[1])]})

        return routed

    queries = valid.where(is_query(F.col("id"))).groupBy("id").agg(F.min("v").alias("v"))
    filed = valid.mapInPandas(route(1), "part int, id long, v array<double>")
    asked = queries.mapInPandas(route(router.probes), "part int, id long, v array<double>")
    # At most MAX_PARTITIONS rows each: how many blocks each partition has.
    n_rows = {r["part"]: r["n"] for r in filed.groupBy("part").agg(F.count("*").alias("n")).collect()}
    n_asked = {r["part"]: r["n"] for r in asked.groupBy("part").agg(F.count("*").alias("n")).collect()}
    blocks = spark.createDataFrame(
        [(p, -(-n_rows[p] // BLOCK_ROWS), -(-n_asked.get(p, 0) // BLOCK_QUERIES)) for p in n_rows], "part int, row_blocks int, query_blocks int"
    )
    filed = filed.join(F.broadcast(blocks), "part").where("query_blocks > 0").withColumn("row_block", F.pmod(F.xxhash64("id", "v"), "row_blocks"))
    filed = filed.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)))
    asked = asked.join(F.broadcast(blocks), "part").withColumn("query_block", F.pmod(F.xxhash64("id"), "query_blocks").cast("int"))
    asked = asked.withColumn("row_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("row_blocks").cast("long") - 1)))
    at = ["part", "row_block", "query_block"]
    found = (
        asked.select(*at, "id", "v").groupBy(*at)
        .cogroup(filed.select(*at, "id", "v").groupBy(*at))
        .applyInPandas(lambda q, r: best(q, r, k), "query_id long, vec_id long, score double")
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
