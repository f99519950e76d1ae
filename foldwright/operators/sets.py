"""Key-set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_keys(df: DataFrame, owner: str, key: str) -> DataFrame:
    """Keys every owner holds (SET1)."""
    owners = df.agg(F.count_distinct(owner)).first()[0]
    return (
        df.groupBy(key).agg(F.count_distinct(owner).alias("_k")).filter(F.col("_k") == F.lit(owners)).select(key)
    )


def union_and_missed(discovered: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Items of either side with two flags; an item is missed when true and found by nobody (SET2)."""
    found = discovered.select(key).distinct().withColumn("found", F.lit(True))
    true = truth.select(key).distinct().withColumn("is_true", F.lit(True))
    merged = found.join(true, key, "full_outer")
    return merged.select(
        key,
        F.coalesce("found", F.lit(False)).alias("found"),
        F.coalesce("is_true", F.lit(False)).alias("is_true"),
        (F.col("is_true").isNotNull() & F.col("found").isNull()).alias("missed"),
    )


def key_set_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by one side only, naming the side; empty means equal sets (SET3, JOI10)."""
    keys = list(keys)
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("missing_right")).unionByName(
        b.join(a, keys, "left_anti").withColumn("side", F.lit("missing_left"))
    )
