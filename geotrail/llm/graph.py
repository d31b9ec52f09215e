"""Connected components of large edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label): for every node of the edges (a, b) the smallest node that it reaches.

    Each round a node takes the smallest node around it and then that one's choice; edges then lead between what was taken,
    and those within one are dropped, so each round has fewer nodes and edges than the one before. The rounds grow with the
    logarithm of a component's width. Every round is a written table; only whether edges are left reaches the driver.
    """
    left, taken = materialize(_lower_first(edges)), []
    while not taken or left.limit(1).collect():
        ends = left.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(left.select(F.col("b").alias("node"), F.col("a").alias("near")))
        low = materialize(ends.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("label")))
        to = materialize(low.join(_renamed(low, "label", "next"), "label").select("node", F.col("next").alias("label")))
        taken.append(to)
        moved = left.join(_renamed(to, "a", "la"), "a").join(_renamed(to, "b", "lb"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
        # what was taken may have taken another one
        higher = to.select("label").distinct().join(_renamed(to, "label", "next"), "label").select(F.col("label").alias("a"), F.col("next").alias("b"))
        left = materialize(_lower_first(moved.unionByName(higher).where("a <> b")))
    labels = taken[-1]
    for to in taken[-2::-1]:
        labels = materialize(to.join(_renamed(labels, "label", "next"), "label", "left").select("node", F.coalesce("next", "label").alias("label")))
    return labels


def joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges (a, b) with those from each node to its label."""
    return labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(edges)


def _lower_first(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _renamed(labels: DataFrame, node: str, label: str) -> DataFrame:
    return labels.select(F.col("node").alias(node), F.col("label").alias(label))
