"""Joins that stay whole and balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(df: DataFrame, key: str, max_keys: int) -> DataFrame:
    """Keys that hold more than ``1 / max_keys`` of the rows: by counting, fewer than ``max_keys``.

    One pass over the key column with partial counts per task; nothing is collected.
    """
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n").alias("__total"))
    return (
        counts.crossJoin(F.broadcast(total))
        .filter(F.col("__n") * max_keys > F.col("__total"))
        .select(key, F.lit(True).alias("__hot"))
    )


def skew_join(facts: DataFrame, lookup: DataFrame, key: str, how: str = "inner", salts: int | None = None) -> DataFrame:
    """Equi-join of a large, possibly skewed table with a table that is unique on ``key``.

    For joins whose result must not depend on adaptive execution. A key is hot if it would fill more than one shuffle
    partition's even share; its rows are spread over ``salts`` sub-keys (as many as shuffle partitions, if not given) by
    a hash of the whole row, and the lookup rows of hot keys, fewer than shuffle partitions, are repeated once per salt. Rows without a key match
    nothing and are spread too. All other keys join as usual, so neither table is blown up and no group
    lands in one task. ``how`` is ``inner``, ``left``, ``left_semi`` or ``left_anti``.
    """
    salts = salts or shuffle_partitions(facts)
    hot = F.broadcast(hot_keys(facts, key, max(2, shuffle_partitions(facts))))  # fewer rows than shuffle partitions
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in facts.columns]), F.lit(salts)).cast("int")
    salted_facts = facts.join(hot, key, "left").withColumn(
        "__salt", F.when(F.col("__hot") | F.col(key).isNull(), spread).otherwise(F.lit(0))
    )
    all_salts = F.sequence(F.lit(0), F.lit(salts - 1))
    salted_lookup = lookup.join(hot, key, "left").withColumn(
        "__salt", F.explode(F.when(F.col("__hot"), all_salts).otherwise(F.array(F.lit(0))))
    )
    return (
        salted_facts.drop("__hot")
        .join(salted_lookup.drop("__hot"), [key, "__salt"], how)
        .drop("__salt")
    )


def lookup_join(df: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join with a rule table on a key of few values (an exam type may hold a third of all rows).

    A plain equi-join: the optimizer broadcasts a rule table whose size in bytes is below its limit, so ``df`` is not
    moved; beyond it adaptive execution splits the partitions of frequent keys. Nothing runs while the plan is made.
    """
    return df.join(table, key, how)
