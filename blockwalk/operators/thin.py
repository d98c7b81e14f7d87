"""Greedy thinning: keep a row unless a kept row of higher priority is closer than a radius."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockwalk.functions import geo
from blockwalk.operators import cells, kernels
from blockwalk.operators.lineage import cut, spread
from blockwalk.operators.nearest import split_groups

GROUP_ROWS = 200_000
#: Side of a tile in cells (a cell's diagonal is one radius), and the open rows of a tile and its surroundings that one task settles.
TILE = 64
TILE_ROWS = 100_000


def _py_metric(metric: str):
    if metric == "degrees":
        return lambda a, b, c, d: math.hypot(a - c, b - d)

    def haversine(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 \
            + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * geo.EARTH_RADIUS_M * math.asin(math.sqrt(min(1.0, h)))

    return haversine


def _square(y: np.ndarray, radius: float, metric: str) -> float:
    """Side in degrees of squares that cover the radius on both axes."""
    if metric == "degrees":
        return radius
    top = min(float(np.abs(y).max()) + radius / cells.METRES, cells.POLE)
    return radius / cells.METRES / math.cos(math.radians(top))


def greedy_thin(df: DataFrame, keys: Sequence[str], priority: Sequence[Column], radius: float, metric: str = "degrees",
                fixed: Column | None = None, limit: int = GROUP_ROWS, rounds: list[int] | None = None) -> DataFrame:
    """Rows a sequential pass in priority order would keep, per key.

    ``priority`` ascends and must be total (end it with an id).  ``metric`` is
    ``degrees`` or ``metres`` (great circle).  ``fixed`` rows are always kept and
    come first.  Groups that fit a task are walked there; larger groups run in
    rounds over the whole cluster with the same result, and ``rounds`` receives the
    number of rows open at the start of each.
    """
    order = {f"_o{i}": c for i, c in enumerate(priority)}
    hold = F.lit(False) if fixed is None else fixed
    rows = df.withColumns({"_fix": hold, **order})
    by, ascending = ["_fix", *order], [False, *[True] * len(order)]
    small, large = split_groups(rows, keys, limit)
    distance = _py_metric(metric)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(by, ascending=ascending, kind="stable")
        y, x = pdf["lat"].to_numpy(), pdf["lng"].to_numpy()
        return pdf[kernels.greedy_keep(y, x, radius, distance, pdf["_fix"].to_numpy(), _square(y, radius, metric))]

    kept = spread(small, *keys).groupBy(*keys).applyInPandas(walk, rows.schema)
    if large is not None:
        kept = kept.unionByName(_thin_in_rounds(large, keys, list(order), radius, metric, by, ascending, rounds))
    return kept.drop(*by)


def _thin_in_rounds(rows: DataFrame, keys: Sequence[str], order: Sequence[str], radius: float, metric: str, by: Sequence[str], ascending: Sequence[bool],
                    rounds: list[int] | None = None) -> DataFrame:
    """The same keep set, decided for all groups at once.

    The area is cut into tiles of ``TILE`` cells. A round settles whatever can be settled inside a tile, in one pass in priority order over its open
    rows and those around it; only rows that hang on a neighbour tile's stay open, so the rounds follow the tiles' borders that a chain of
    priorities crosses, not its rows. Kept rows then strike out open rows near them.

    A tile with more than ``TILE_ROWS`` open rows is settled by its cells instead: two rows of one small cell always conflict, so only the best open
    row per cell can be kept, and is where it outranks the best of every cell in reach. Copies of a position are reduced to their
    best row first: the others can never be kept.
    """
    dy = radius if metric == "degrees" else radius / cells.METRES
    across = (lambda lat: F.lit(radius)) if metric == "degrees" else (lambda lat: cells.reach_lng(radius, lat))
    side = 0.999 * radius / math.sqrt(2) if metric == "degrees" else 0.99 * radius / math.sqrt(2) / geo.METRES_PER_DEGREE
    rank = F.struct((~F.col("_fix")).alias("_nf"), *order)
    near = lambda a, b, c, d: (geo.degree_distance if metric == "degrees" else geo.haversine_m)(a, b, c, d) < radius
    fixed = rows.filter("_fix")
    loose = rows.filter(~F.col("_fix"))
    best = loose.groupBy(*keys, "lat", "lng").agg(F.min_by(F.struct(*[c for c in rows.columns if c not in (*keys, "lat", "lng")]),
                                                           F.struct(*order)).alias("_r"))
    open_ = best.select(*keys, "lat", "lng", "_r.*").select(*rows.columns)
    at = {"_cy": cells.cell(F.col("lat"), side), "_cx": cells.cell(F.col("lng"), side)}
    cell_keys = [*keys, "_cy", "_cx"]

    def strike(open_rows: DataFrame, kept: DataFrame) -> DataFrame:
        reach = cells.probe(kept.select(*keys, F.col("lat").alias("_la"), F.col("lng").alias("_ln")),
                            F.col("_la"), F.col("_ln"), dy, across("_la"), side, side)
        hit = open_rows.withColumns(at).join(reach, cell_keys).filter(near("lat", "lng", "_la", "_ln")) \
            .select(*keys, "lat", "lng").distinct()
        return open_rows.join(hit, [*keys, "lat", "lng"], "left_anti")

    def leaders(open_rows: DataFrame) -> DataFrame:
        tops = open_rows.withColumns({**at, "_rank": rank}).groupBy(*cell_keys).agg(F.min("_rank").alias("_rank"))
        rivals = cells.probe(tops.withColumns({"_y": (F.col("_cy") + 0.5) * side, "_x": (F.col("_cx") + 0.5) * side})
                             .select(*keys, "_y", "_x", F.col("_rank").alias("_other")),
                             F.col("_y"), F.col("_x"), dy + side, across(F.abs("_y") + side) + side, side, side).drop("_y", "_x")
        lead = tops.join(rivals, cell_keys).groupBy(*cell_keys).agg(
            F.first("_rank").alias("_rank"), F.min("_other").alias("_least")).filter(F.col("_rank") <= F.col("_least"))
        return open_rows.withColumns({**at, "_rank": rank}).join(lead.select(*cell_keys, "_rank"), [*cell_keys, "_rank"], "left_semi") \
            .select(*rows.columns)

    wide, distance = TILE * side, _py_metric(metric)
    tile = {"_ty": cells.cell(F.col("lat"), wide), "_tx": cells.cell(F.col("lng"), wide)}
    settled = T.StructType([*rows.schema.fields, T.StructField("_state", T.ByteType())])

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(by), ascending=list(ascending), kind="stable")
        y, x = pdf["lat"].to_numpy(), pdf["lng"].to_numpy()
        own = ((pdf["_ty"] == pdf["_cy"]) & (pdf["_tx"] == pdf["_cx"])).to_numpy()
        state = kernels.settle_tile(y, x, own, radius, distance, _square(y, radius, metric))
        return pdf[own].assign(_state=state[own])[settled.names]

    kept_all, open_ = fixed, cut(strike(open_, fixed))
    while (n := open_.count()):
        if rounds is not None:
            rounds.append(n)
        seen = cells.probe(open_.withColumns(tile), F.col("lat"), F.col("lng"), dy, across("lat"), wide, wide)
        sizes = cut(seen.groupBy(*cell_keys).agg(F.count(F.lit(1)).alias("_rows")))
        fits = sizes.filter(F.col("_rows") <= TILE_ROWS).drop("_rows")
        done = cut(seen.join(fits, cell_keys, "left_semi").groupBy(*cell_keys).applyInPandas(settle, settled))
        winners, rest = done.filter("_state = 1").drop("_state"), done.filter("_state = 2").drop("_state")
        crowded = sizes.filter(F.col("_rows") > TILE_ROWS).select(*keys, F.col("_cy").alias("_ty"), F.col("_cx").alias("_tx"))
        if not crowded.isEmpty():
            dense = open_.withColumns(tile).join(crowded, [*keys, "_ty", "_tx"], "left_semi").select(*rows.columns)
            first = leaders(open_).join(dense.select(*keys, "lat", "lng"), [*keys, "lat", "lng"], "left_semi")
            winners, rest = cut(winners.unionByName(first)), rest.unionByName(dense)
        kept_all = kept_all.unionByName(winners)
        open_ = cut(strike(rest, winners))
    return kept_all
