"""Single-link clusters: points joined by gaps up to a radius."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockwalk.operators import cells, kernels
from blockwalk.operators.lineage import cut, spread
from blockwalk.operators.nearest import split_groups

GROUP_ROWS = 200_000


def single_link(points: DataFrame, keys: Sequence[str], radius: float, limit: int = GROUP_ROWS) -> DataFrame:
    """(keys, id, y, x, component): component is the least id joined to a point.

    ``points`` has columns id (long), y and x in any planar unit.
    """
    rows = points.select(*keys, "id", "y", "x")
    small, large = split_groups(rows, keys, limit)
    schema = T.StructType([*rows.schema.fields, T.StructField("component", rows.schema["id"].dataType)])

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        labels = kernels.single_link(pdf["y"].to_numpy(), pdf["x"].to_numpy(), radius)
        return pdf.assign(component=pdf["id"].to_numpy()[labels])

    out = spread(small, *keys).groupBy(*keys).applyInPandas(link, schema)
    return out if large is None else out.unionByName(_link_by_cells(large, keys, radius))


def clusters(points: DataFrame, keys: Sequence[str], radius: float, min_size: int = 4, limit: int = GROUP_ROWS) -> DataFrame:
    """Clusters of at least ``min_size``; members of smaller groups become singletons of their own."""
    linked = single_link(points, keys, radius, limit)
    sizes = linked.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("size"))
    small = F.col("size") < min_size
    return linked.join(sizes, [*keys, "component"]) \
        .withColumns({"cluster": F.when(small, F.col("id")).otherwise(F.col("component")),
                      "size": F.when(small, 1).otherwise(F.col("size"))}).drop("component")


def _link_by_cells(points: DataFrame, keys: Sequence[str], radius: float) -> DataFrame:
    """Components of groups too large for a task.

    Points of one cell (diagonal within the radius) are linked by definition, so
    the graph has one node per occupied cell.  Whether two cells are linked is
    decided on their tight boxes, splitting undecided pairs into quarters until
    every pair is certain; point pairs are never listed.
    """
    side = 0.999 * radius / math.sqrt(2)
    rows = points.withColumns({"_cy": cells.cell(F.col("y"), side), "_cx": cells.cell(F.col("x"), side)})
    node_keys = [*keys, "_cy", "_cx"]
    nodes = cut(rows.groupBy(*node_keys).agg(F.min("id").alias("node")))
    edges = _cell_edges(rows.join(nodes, node_keys).select(*keys, "node", "_cy", "_cx", "y", "x").distinct(), keys, radius, side)
    labels = connected(nodes.select("node"), edges)
    return rows.join(nodes, node_keys).join(labels, "node").select(*keys, "id", "y", "x", F.col("label").alias("component"))


def _boxes(points: DataFrame, by: Sequence[str]) -> DataFrame:
    return points.groupBy(*by).agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))


def _cell_edges(points: DataFrame, keys: Sequence[str], radius: float, side: float) -> DataFrame:
    """Linked node pairs (a < b)."""
    top = _boxes(points, [*keys, "node", "_cy", "_cx"])
    offsets = F.explode(F.sequence(F.lit(-2), F.lit(2)))
    other = top.withColumn("_dy", offsets).withColumn("_dx", offsets) \
        .withColumns({"_cy": F.col("_cy") + F.col("_dy"), "_cx": F.col("_cx") + F.col("_dx")})
    right = other.select(*keys, "_cy", "_cx", F.col("node").alias("b"), *[F.col(c).alias(f"b_{c}") for c in ("y0", "y1", "x0", "x1")])
    pairs = top.select(*keys, "_cy", "_cx", F.col("node").alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("y0", "y1", "x0", "x1")]) \
        .join(right, [*keys, "_cy", "_cx"]).filter(F.col("a") < F.col("b")).drop("_cy", "_cx")
    gap = lambda lo, hi, lo2, hi2: F.greatest(F.lit(0.0), lo2 - hi, lo - hi2)
    span = lambda lo, hi, lo2, hi2: F.greatest(hi2 - lo, hi - lo2)

    def squared(f):
        dy = f(F.col("a_y0"), F.col("a_y1"), F.col("b_y0"), F.col("b_y1"))
        dx = f(F.col("a_x0"), F.col("a_x1"), F.col("b_x0"), F.col("b_x1"))
        return dy * dy + dx * dx

    found, size = None, side
    limit = radius * radius
    while True:
        judged = cut(pairs.filter(squared(gap) <= limit).withColumn("_sure", squared(span) <= limit))
        sure = judged.filter("_sure").select("a", "b").distinct()
        found = sure if found is None else found.unionByName(sure)
        open_ = judged.filter(~F.col("_sure")).join(sure, ["a", "b"], "left_anti")
        if open_.isEmpty():
            return cut(found.distinct())
        size /= 2
        sub = _boxes(points.withColumns({"_qy": cells.cell(F.col("y"), size), "_qx": cells.cell(F.col("x"), size)}),
                     [*keys, "node", "_qy", "_qx"]).drop("_qy", "_qx")
        within = lambda p: ((F.col("y0") >= F.col(f"{p}_y0")) & (F.col("y1") <= F.col(f"{p}_y1"))
                            & (F.col("x0") >= F.col(f"{p}_x0")) & (F.col("x1") <= F.col(f"{p}_x1")))
        for p in ("a", "b"):
            fresh = sub.withColumnRenamed("node", p)
            drop = [f"{p}_{c}" for c in ("y0", "y1", "x0", "x1")]
            open_ = open_.join(fresh, [*keys, p]).filter(within(p)).drop(*drop) \
                .withColumnsRenamed({c: f"{p}_{c}" for c in ("y0", "y1", "x0", "x1")})
        pairs = open_.drop("_sure").distinct()


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): label is the least node reachable; label passing with pointer jumping."""
    links = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    state = cut(nodes.select("node", F.col("node").alias("label")))
    while True:
        heard = links.join(state.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")) \
            .agg(F.min("label").alias("_heard"))
        lower = state.join(heard, "node", "left").select(
            "node", F.least("label", F.coalesce("_heard", "label")).alias("_l"), F.col("label").alias("_old"))
        jump = state.select(F.col("node").alias("_l"), F.col("label").alias("_jump"))
        nxt = cut(lower.join(jump, "_l").select("node", F.least("_l", "_jump").alias("label"), "_old"))
        changed = not nxt.filter(F.col("label") != F.col("_old")).isEmpty()
        state = nxt.drop("_old")
        if not changed:
            return state
