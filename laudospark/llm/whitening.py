"""Whitening of vectors by their leading principal components.

Entries become whole coordinates ``floor(scale * entry) + shift``. One pass counts the vectors and sums every dimension;
a second one takes the products of coordinates that were centred first, on the mean rounded to a whole number. Both are
sums of integers, so the result is the same for any partitioning, and the covariance that follows (the rounding's share
taken out in exact arithmetic) is right to the last place of a double. Only these sums, ``d * d`` numbers, come to the
driver.

There, Householder reflections make the covariance tridiagonal; Sturm counts bracket the leading eigenvalues, all of them
by bisection at once; inverse iteration on the tridiagonal matrix gives their vectors, which are made orthogonal to
earlier ones of the same cluster after every step; the reflections take them back. The components, divided by the roots
of their eigenvalues, are broadcast, and every row is projected where it lies.

Defined results: rows whose vector is null or holds null or non-finite entries are dropped, as are those whose length is
not the most frequent one (the larger, of equally frequent ones). Rows that repeat count and come out as often as they
occur; a null identifier is kept. Components are numbered by falling eigenvalue; there are at most as many as dimensions,
and none for eigenvalues that rounding cannot tell from zero (one vector, or equal ones, have no component). Of the two
signs of a component the one whose largest entry is positive is taken. An empty table gives an empty result. Columns other
than identifier and vector are ignored. A vector without entries has deviation 0 and no component.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .vectors import EXACT, commonest_length, finite, lists, matrix, summed, whole

SCALE, SHIFT = 64.0, 1_000_000
#: The covariance and its reflections are held by the driver: 4096 dimensions are 128 MB a matrix.
MAX_DIMENSIONS = 4096
#: Eigenvalues nearer to each other than this share of the largest one are a cluster.
CLUSTER = 1e-3
#: Steps of inverse iteration; each multiplies the wanted component by far more than any other one.
STEPS = 5


# ------------------------------------------------------------------ eigenvalues and eigenvectors


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, lower diagonal and the Householder vectors (unit, one per column) that bring a symmetric matrix there."""
    a = np.array(a, np.float64)
    d = len(a)
    mirrors = []
    for k in range(d - 2):
        x = a[k + 1 :, k]
        v = x.copy()
        v[0] += np.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(v)
        if size > 0:
            v /= size
            rest = a[k + 1 :, k + 1 :]
            p = 2 * (rest @ v)
            w = p - (v @ p) * v
            rest -= np.outer(v, w) + np.outer(w, v)
            a[k + 1 :, k] -= 2 * v * (v @ x)
        mirrors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def sturm_count(diagonal: np.ndarray, square: np.ndarray, x: np.ndarray, least: float) -> np.ndarray:
    """How many eigenvalues lie below each ``x``: the negative pivots of the shifted matrix."""
    count = np.zeros(len(x), np.int64)
    q = np.ones_like(x)
    for k, a in enumerate(diagonal):
        q = a - x - (square[k - 1] / q if k else 0.0)
        q = np.where(np.abs(q) < least, -least, q)
        count += q < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, each by bisection until no double lies between its bounds."""
    d = len(diagonal)
    reach = np.abs(np.append(off, 0.0)) + np.abs(np.insert(off, 0, 0.0))
    low, high = (diagonal - reach).min(), (diagonal + reach).max()
    scale = max(abs(low), abs(high))
    if scale == 0:
        return np.zeros(k)
    least = np.finfo(float).tiny / np.finfo(float).eps * max(1.0, scale)
    low, high = np.full(k, low - 1e-12 * scale), np.full(k, high + 1e-12 * scale)
    rank = d - np.arange(k)  # of the wanted one, counted from the smallest
    square = off * off
    while True:
        middle = low + (high - low) / 2
        open_ = (middle > low) & (middle < high) & (high - low > np.finfo(float).eps * scale / 8)
        if not open_.any():
            return middle
        below = sturm_count(diagonal, square, middle, least) >= rank
        high, low = np.where(below & open_, middle, high), np.where(~below & open_, middle, low)


def factored(diagonal: np.ndarray, off: np.ndarray, x: float, least: float) -> tuple[np.ndarray, ...]:
    """Elimination with row exchanges of the tridiagonal matrix less ``x``: multipliers, exchanges, three upper diagonals."""
    d = len(diagonal)
    main, first, second = diagonal - x, np.append(off, 0.0), np.zeros(d)
    factor, swapped = np.zeros(d), np.zeros(d, bool)
    for k in range(d - 1):
        below, its_next, its_third = off[k], main[k + 1], first[k + 1]
        if abs(below) > abs(main[k]):
            swapped[k] = True
            factor[k] = main[k] / below
            main[k + 1], first[k + 1] = first[k] - factor[k] * its_next, -factor[k] * its_third
            main[k], first[k], second[k] = below, its_next, its_third
        else:
            main[k] = main[k] if abs(main[k]) > least else least
            factor[k] = below / main[k]
            main[k + 1] = its_next - factor[k] * first[k]
    main[d - 1] = main[d - 1] if abs(main[d - 1]) > least else least
    return factor, swapped, main, first, second


def solved(parts: tuple[np.ndarray, ...], b: np.ndarray) -> np.ndarray:
    factor, swapped, main, first, second = parts
    b = b.copy()
    d = len(b)
    for k in range(d - 1):
        if swapped[k]:
            b[k], b[k + 1] = b[k + 1], b[k]
        b[k + 1] -= factor[k] * b[k]
    out = np.zeros(d + 2)
    for k in range(d - 1, -1, -1):
        out[k] = (b[k] - first[k] * out[k + 1] - second[k] * out[k + 2]) / main[k]
    return out[:d]


def inverse_iteration(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A unit eigenvector per falling eigenvalue, as columns; orthogonal within clusters."""
    d = len(diagonal)
    rng = np.random.default_rng(11)
    norm = np.abs(diagonal).max() + (2 * np.abs(off).max() if len(off) else 0.0)
    least = np.finfo(float).eps * norm
    out = np.zeros((d, len(values)))
    start, used = 0, np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            start = j
        # Equal eigenvalues are set apart a little, or all would be solved with one matrix.
        used = min(value, used - 10 * least) if j > start else value
        parts = factored(diagonal, off, used, least)
        y = rng.standard_normal(d)
        y /= np.linalg.norm(y)
        for _ in range(STEPS):
            y = solved(parts, y)
            y /= np.abs(y).max()
            for _ in range(2):  # the second time takes out what rounding left in
                y -= out[:, start:j] @ (out[:, start:j].T @ y)
            size = np.linalg.norm(y)
            if size < 1e-8:  # lay within the earlier ones
                y = rng.standard_normal(d)
                y -= out[:, start:j] @ (out[:, start:j].T @ y)
                size = np.linalg.norm(y)
            y /= size
        out[:, j] = y
    return out


def leading_components(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``k`` largest eigenvalues of a covariance, falling, and their unit eigenvectors as columns."""
    d = len(a)
    k = min(k, d)
    if k == 0 or not np.any(a):
        return np.zeros(0), np.zeros((d, 0))
    diagonal, off, mirrors = tridiagonal(a)
    values = leading_eigenvalues(diagonal, off, k)
    values = values[values > 8 * d * np.finfo(float).eps * values[0]]
    vectors = inverse_iteration(diagonal, off, values)
    for at in range(len(mirrors) - 1, -1, -1):
        v, rest = mirrors[at], vectors[at + 1 :]
        rest -= 2 * np.outer(v, v @ rest)
    largest = np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None, :], 0)
    return values, vectors * np.where(largest < 0, -1.0, 1.0)


# ------------------------------------------------------------------ sums over the rows


def products(x: np.ndarray) -> np.ndarray:
    """Sums of products of whole coordinates, exact: by slices in which a double loses nothing."""
    most = int(np.abs(x).max()) if x.size else 0
    if most * most >= EXACT:
        raise OverflowError("coordinates lie too far from their mean for exact products")
    step = max(1, (EXACT - 1) // max(1, most * most))
    out = np.zeros((x.shape[1], x.shape[1]), np.int64)
    for at in range(0, len(x), step):
        part = x[at : at + step].astype(np.float64)
        out += (part.T @ part).astype(np.int64)
    return out


@dataclass
class Whitening:
    """What the fit found: ``n`` vectors, sums ``S``, the rounded means, the covariance's trace, and the components."""

    scale: float
    shift: int
    n: int
    sums: np.ndarray
    means: np.ndarray
    trace: float
    values: np.ndarray
    vectors: np.ndarray

    @property
    def dimensions(self) -> int:
        return len(self.means)

    def centred(self, v: np.ndarray) -> np.ndarray:
        """Coordinates less the rounded means, as integers."""
        return whole(v, self.scale, self.shift) - self.means

    def rest(self) -> np.ndarray:
        """``S - n * mean``: what the rounding of the means left."""
        return self.sums - self.n * self.means

    def projected(self, v: np.ndarray) -> np.ndarray:
        x = self.centred(v).astype(np.float64) - (self.rest() / self.n)[None, :]
        return x @ (self.vectors / np.sqrt(self.values)[None, :])

    def deviation(self, v: np.ndarray) -> pa.Array:
        """Sum over the dimensions of ``(n * x - S)^2``, exact, as decimals."""
        x, r, n = self.centred(v), self.rest(), self.n
        reach = float(n) * float(np.abs(x).max(initial=0)) + float(np.abs(r).max(initial=0))
        if reach * reach * max(1, self.dimensions) < 2.0**62:
            y = n * x - r[None, :]
            return pa.array((y * y).sum(axis=1)).cast(pa.decimal128(38, 0))
        square, mixed, fixed = (x * x).sum(axis=1), x.astype(object) @ r.astype(object), sum(int(i) ** 2 for i in r)
        return pa.array([Decimal(n * n * int(s) - 2 * n * int(m) + fixed) for s, m in zip(square, mixed)], pa.decimal128(38, 0))


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``key`` and ``v`` of the rows that count."""
    rows = rows.select(F.col(key).alias("key"), F.col(vector).alias("v")).where(finite(F.col("v")))
    return rows.where(F.size("v") == commonest_length(rows, "v"))


def fit(rows: DataFrame, vector: str = "v", components: int = 32, scale: float = SCALE, shift: int = SHIFT) -> Whitening:
    """Sums, covariance and components of vectors that are finite and of one length."""
    ship(rows.sparkSession)
    rows = rows.select(vector)
    d = commonest_length(rows, vector)
    if d > MAX_DIMENSIONS:
        raise ValueError(f"vectors of {d} entries; the driver holds covariances of up to {MAX_DIMENSIONS}")

    def sums(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(d + 1, np.int64)
        for batch in batches:
            out[:d] += whole(matrix(batch.column(0), d), scale, shift).sum(axis=0)
            out[d] += batch.num_rows
        return out

    found = summed(rows, sums, "long", d + 1)
    n, total = int(found[d]), found[:d]
    means = (2 * total + n) // (2 * n) if n else total
    model = Whitening(scale, shift, n, total, means, 0.0, np.zeros(0), np.zeros((d, 0)))
    if not n or not d:
        return model

    def centred_products(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((d, d), np.int64)
        for batch in batches:
            out += products(model.centred(matrix(batch.column(0), d)))
        return out.ravel()

    moments = summed(rows, centred_products, "long", d * d).reshape(d, d).astype(object)
    rest = model.rest().astype(object)
    covariance = ((n * moments - np.outer(rest, rest)) / (n * n)).astype(np.float64)
    model.trace = float(np.trace(covariance))
    model.values, model.vectors = leading_components(covariance, components)
    return model


def project(rows: DataFrame, model: Whitening, key: str = "key", vector: str = "v") -> DataFrame:
    """``key``, ``deviation`` (exact, decimal) and ``whitened`` (one double per component) of every row."""
    spark = rows.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = rows.select(F.col(key).alias("key"), F.col(vector).alias("v"))
    names = ["key", "deviation", "whitened"]

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            v = matrix(batch.column(1), m.dimensions)
            yield pa.RecordBatch.from_arrays([batch.column(0), m.deviation(v), lists(m.projected(v))], names=names)

    return rows.mapInArrow(one, f"key {rows.schema['key'].dataType.simpleString()}, deviation decimal(38,0), whitened array<double>")


def identity_error(rows: DataFrame, model: Whitening, vector: str = "v") -> float:
    """Largest entry, in absolute value, of the whitened rows' covariance less the identity: one more pass."""
    k, d = len(model.values), model.dimensions
    if not k:
        return 0.0
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def moments(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((k + 1, k))
        for batch in batches:
            w = shared.value.projected(matrix(batch.column(0), d))
            out[:k] += w.T @ w
            out[k] += w.sum(axis=0)
        return out.ravel()

    # Projections are of centred coordinates; the mean that rounding left is taken out as well.
    found = summed(rows.select(vector), moments, "double", (k + 1) * k).reshape(k + 1, k) / model.n
    return float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max())


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 32, scale: float = SCALE, shift: int = SHIFT) -> tuple[DataFrame, Whitening, float]:
    """The projected rows that count, the fit, and how far the whitened covariance is from the identity."""
    counted = usable(rows, key, vector)
    model = fit(counted, "v", components, scale, shift)
    return project(counted, model), model, identity_error(counted, model)
