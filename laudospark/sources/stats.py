"""Statistics as stored changes: a folder per batch, merged when they are read and now and then for good."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.feedback import STATS, merge_stats
from ..session import folder_names, remove_folder

COMPACT_AFTER = 32


def _numbers(spark: SparkSession, path: str, kind: str) -> list[int]:
    return sorted(int(n.partition("=")[2]) for n in folder_names(spark, path) if n.startswith(kind + "=") and "_SUCCESS" in folder_names(spark, f"{path}/{n}"))


def _live(spark: SparkSession, path: str) -> list[str]:
    """The newest sum and the changes after it."""
    sums = _numbers(spark, path, "sum")
    start = sums[-1] if sums else -1
    return [f"sum={start}"] * bool(sums) + [f"change={n}" for n in _numbers(spark, path, "change") if n > start]


def save_changes(changes: DataFrame, path: str, batch_id: int, compact_after: int = COMPACT_AFTER) -> None:
    """Store what a batch adds. A batch that is saved again takes its own place, so it counts once; batches come in order.

    After ``compact_after`` changes they are summed up, a row per exam type; what an earlier sum covers is removed.
    """
    spark = changes.sparkSession
    sums = _numbers(spark, path, "sum")
    if sums and batch_id <= sums[-1]:
        return  # in the sum already
    merge_stats(changes).coalesce(1).write.mode("overwrite").parquet(f"{path}/change={batch_id}")
    if len(_live(spark, path)) > compact_after:
        merge_stats(read_changes(spark, path)).coalesce(1).write.mode("overwrite").parquet(f"{path}/sum={batch_id}")
        for kind, numbers in (("change", _numbers(spark, path, "change")), ("sum", sums)):
            for n in numbers:
                if sums and (n < sums[-1] or (kind == "change" and n == sums[-1])):
                    remove_folder(spark, f"{path}/{kind}={n}")


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """All changes that count, for ``stats_row`` or ``merge_stats``."""
    names = _live(spark, path)
    if not names:
        return spark.createDataFrame([], STATS)
    return spark.read.schema(STATS).parquet(*[f"{path}/{n}" for n in names])
