"""Connected components by alternating large-star and small-star steps, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.spool import durable


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b of any sortable type); the component is its
    smallest node.

    Each step points nodes to smaller neighbours, with at most as many edges as before, and the number of steps
    follows the logarithm of the longest path; steps are cut by checkpoints, and nothing but a count and a checksum
    reaches the driver. Self edges give single components.
    """
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    now = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        now = durable(small)
        mark, before = _mark(now), mark
        if mark == before:
            break
    found = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
