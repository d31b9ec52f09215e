"""Samples, sorts, limits and set operations; all reproducible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def seeded(seed: str, key: str) -> Column:
    """A fixed pseudo-random order."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)


def stratified_sample(df: DataFrame, group: list[str], n: int, seed: str, key: str) -> DataFrame:
    """The first n rows of each group in seeded order."""
    w = W.partitionBy(*group).orderBy(seeded(seed, key), key)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def round_robin(df: DataFrame, group: str, groups: list, cap: int, seed: str, key: str, rotate: bool = False) -> DataFrame:
    """Rows taken from the groups in turn until cap; with rotate each round starts one group later. Adds turn, from 1."""
    position = F.array_position(F.array(*map(F.lit, groups)), F.col(group)) - 1
    ranked = df.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(seeded(seed, key), key)) - 1).withColumn("_g", position).where("_g >= 0 and _r < " + str(cap))
    place = F.pmod(F.col("_g") - F.col("_r"), F.lit(len(groups))) if rotate else F.col("_g")
    first = ranked.withColumn("_o", place).orderBy("_r", "_o").limit(cap)
    return first.withColumn("turn", F.row_number().over(W.orderBy("_r", "_o"))).drop("_r", "_g", "_o")  # at most cap rows


def limit(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_k(df: DataFrame, by: Column, key: str, k: int) -> DataFrame:
    return df.orderBy(by.desc(), key).limit(k)


def multi_sort(df: DataFrame, *keys: Column | str) -> DataFrame:
    """Sorted rows; the last key must be unique."""
    return df.orderBy(*keys)


def first_distinct(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def union_edges(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def partition_allowed(df: DataFrame, ids: str, allowed: str) -> DataFrame:
    """Adds kept and dropped: the ids of an array that are allowed, and those that are not."""
    return df.withColumn("kept", F.array_intersect(ids, allowed)).withColumn("dropped", F.array_except(ids, allowed))


def distinct_values(df: DataFrame, column: Column) -> DataFrame:
    """Sorted distinct values that are not empty."""
    return df.select(F.nullif(F.trim(column), F.lit("")).alias("value")).where("value is not null").distinct().orderBy("value")


def shuffled(df: DataFrame, seed: str, key: str) -> DataFrame:
    """Adds draw: rows in a reproducible random order sort by it; no two rows of different keys share it."""
    return df.withColumn("draw", seeded(seed, key))
