"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwalk.llm.common import cut


def _to_least(edges: DataFrame) -> DataFrame:
    """(a, b, least): every edge with the least node beside ``a``, ``a`` itself included."""
    least = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return edges.join(least, "a")


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every node of ``edges`` (a, b); the root is the component's least node.

    Edges shrink to stars around the least nodes in a number of rounds that grows with the logarithm of a component's
    width. Each round is aggregates and joins over edges, cut by a checkpoint; only two numbers per round reach the driver.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _to_least(both).where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        near = _to_least(large)
        small = near.select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("least").alias("b")),
                                              F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("e")) \
            .select("e.a", "e.b").where("a <> b").distinct()
        edges = cut(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    members = edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return members.unionByName(members.select(F.col("root").alias("id"), "root").distinct())
