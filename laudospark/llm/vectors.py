"""What the operators on vectors share: which vectors count, whole coordinates, and arrays in and out of Arrow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Below this, every whole number is a double.
EXACT = 1 << 53


def finite(vector: Column) -> Column:
    """True for vectors that are there and hold neither null nor NaN nor infinite entries."""
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def commonest_length(rows: DataFrame, vector: str) -> int:
    """The most frequent number of entries, the larger of equally frequent ones; 0 for an empty table."""
    counts = rows.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n"))
    first = counts.orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return first[0]["d"] if first else 0


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A list column, all of whose lists have ``d`` entries, as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), d)


def lists(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as a list column."""
    n, d = rows.shape
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * d)
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(rows).ravel()))


def whole(values: np.ndarray, scale: float, shift: int = 0) -> np.ndarray:
    """``floor(scale * value) + shift`` as 64-bit integers; an error where a double no longer holds every whole number."""
    out = np.floor(values * scale)
    if out.size and np.abs(out).max() >= EXACT:
        raise OverflowError(f"entries beyond {EXACT / scale:g} have no exact whole coordinates")
    return out.astype(np.int64) + shift


def summed(rows: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], np.ndarray], kind: str, cells: int) -> np.ndarray:
    """Sum over the tasks of one array of ``cells`` numbers that each task makes."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = make(batches)
        at = np.flatnonzero(values)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(values[at])], names=["cell", "value"])

    total = rows.mapInArrow(local, f"cell long, value {kind}").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(cells, np.int64 if kind == "long" else np.float64)
    out[total["cell"].to_numpy()] = total["value"].to_numpy()
    return out
