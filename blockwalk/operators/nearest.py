"""Nearest-neighbour distances without all-pairs work.

Small groups are measured inside one task each.  A group too large for a task
searches in growing cells: a point that finds a neighbour within the current
reach is done, so that the points still searching are far apart from everything
(few per cell) and each level meets a number of rows linear in the input.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockwalk.functions import geo
from blockwalk.operators import cells, kernels
from blockwalk.operators.lineage import cut, spread
from blockwalk.operators.ordered import Ordered, hot_keys, nth_values

#: Rows of one group that one task measures in memory.
GROUP_ROWS = 20_000


def split_groups(df: DataFrame, keys: Sequence[str], limit: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of groups that fit a task, rows of larger groups or None)."""
    hot = hot_keys(df, keys, limit).drop("_n")
    if hot.isEmpty():
        return df, None
    return df.join(hot, list(keys), "left_anti"), df.join(hot, list(keys), "left_semi")


def nearest_gaps(points: DataFrame, keys: Sequence[str], limit: int = GROUP_ROWS) -> DataFrame:
    """(keys, id, gap): metres to the nearest other point of the group; null when alone."""
    rows = points.select(*keys, "id", "lat", "lng")
    small, large = split_groups(rows, keys, limit)
    schema = T.StructType([small.schema[k] for k in (*keys, "id")] + [T.StructField("gap", T.DoubleType())])

    def measure(pdf: pd.DataFrame) -> pd.DataFrame:
        gap = kernels.nearest_gaps(pdf["lat"].to_numpy(), pdf["lng"].to_numpy())
        return pdf[[*keys, "id"]].assign(gap=np.where(np.isinf(gap), np.nan, gap))

    out = spread(small, *keys).groupBy(*keys).applyInPandas(measure, schema) \
        .withColumn("gap", F.nanvl("gap", F.lit(None).cast("double")))
    return out if large is None else out.unionByName(_gaps_by_cells(large, keys))


def _gaps_by_cells(points: DataFrame, keys: Sequence[str], start: float = 1.0, growth: int = 4) -> DataFrame:
    """Copies of one position have gap 0; other positions search in cells of growing size."""
    places = points.groupBy(*keys, "lat", "lng").agg(F.count(F.lit(1)).alias("_n"))
    places = cut(places)
    found = [places.filter("_n > 1").select(*keys, "lat", "lng", F.lit(0.0).alias("gap"))]
    open_, reach = places.filter("_n = 1").drop("_n"), start
    while reach < 4e7:
        dy, dx = cells.degrees_for(reach)
        targets = places.select(*keys, F.col("lat").alias("_la"), F.col("lng").alias("_ln"),
                                cells.cell(F.col("lat"), 2 * dy).alias("_cy"), cells.cell(F.col("lng"), 2 * dx).alias("_cx"))
        met = cells.probe(open_, F.col("lat"), F.col("lng"), dy, cells.reach_lng(reach, "lat"), 2 * dy, 2 * dx).join(targets, [*keys, "_cy", "_cx"]) \
            .filter((F.col("lat") != F.col("_la")) | (F.col("lng") != F.col("_ln"))) \
            .withColumn("gap", geo.equirect_m("lat", "lng", "_la", "_ln")).filter(F.col("gap") <= reach)
        near = cut(met.groupBy(*keys, "lat", "lng").agg(F.min("gap").alias("gap")))
        found.append(near)
        open_ = cut(open_.join(near, [*keys, "lat", "lng"], "left_anti"))
        if open_.isEmpty():
            break
        reach *= growth
    gaps = found[0]
    for f in found[1:]:
        gaps = gaps.unionByName(f)
    return points.join(gaps, [*keys, "lat", "lng"], "left").select(*keys, "id", "gap")


def median_gap(gaps: DataFrame, keys: Sequence[str], split: bool = False) -> DataFrame:
    """Upper median of the gaps per group; 10 for groups of one and for a median of 0."""
    rows = gaps.withColumn("_g", F.coalesce("gap", F.lit(float("inf"))))
    ordered = Ordered.of(rows, keys, [F.col("_g"), F.col("id")]) if split else \
        Ordered(rows, tuple(keys), (F.col("_g"), F.col("id")))
    mid = nth_values(ordered, "_g", F.floor(F.col("n") / 2) + 1, "_m")
    usable = (F.col("_m") != 0) & (F.col("_m") != float("inf"))
    return mid.select(*keys, F.when(usable, F.col("_m")).otherwise(10.0).alias("median_gap"))


def regularity(gaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spread of the gaps per group: rows have a coefficient of variation under 0.35."""
    stats = gaps.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("gap").alias("mean_gap"),
                                    F.stddev_pop("gap").alias("_sd"))
    cv = F.col("_sd") / F.col("mean_gap")
    return stats.withColumn("looks_like_rows", (F.col("n") < 4) | (F.col("mean_gap") == 0) | F.coalesce(cv < 0.35, F.lit(False))) \
        .drop("_sd")


def nearest_target(points: DataFrame, targets: DataFrame, keys: Sequence[str], carry: Sequence[str], rank: Sequence[Column],
                   distance: Column, start_degrees: float) -> DataFrame:
    """Nearest target at any distance, searched in cells of growing size.

    ``targets`` has columns tlat, tlng and the carried ones; ``distance`` is a
    degree-based column over lat, lng, tlat, tlng.
    """
    open_ = cut(cells.distinct_points(points, keys))
    places, found, reach = targets.select(*keys, "tlat", "tlng", *carry), None, start_degrees
    while True:
        size = 2 * reach
        at = places.withColumns({"_cy": cells.cell(F.col("tlat"), size), "_cx": cells.cell(F.col("tlng"), size)})
        met = cells.probe(open_, F.col("lat"), F.col("lng"), reach, reach, size, size).join(at, [*keys, "_cy", "_cx"]) \
            .withColumn("_d", distance).filter(F.col("_d") <= reach)
        best = F.min_by(F.struct(*carry), F.struct(F.col("_d"), *rank)).alias("_b")
        near = cut(met.groupBy(*keys, "lat", "lng").agg(best).select(*keys, "lat", "lng", "_b.*"))
        found = near if found is None else found.unionByName(near)
        open_ = cut(open_.join(near, [*keys, "lat", "lng"], "left_anti"))
        if reach > 400 or open_.isEmpty():
            break
        reach *= 4
    return points.join(found, [*keys, "lat", "lng"], "left")


def local_cell_size(points: DataFrame, keys: Sequence[str], k: int = 5, limit: int = GROUP_ROWS) -> DataFrame:
    """clamp(14, 28, 0.9 x mean of the k nearest distances) in metres for each point.

    Small groups are measured inside one task each; points of larger ones meet by cells.
    """
    rows = points.select(*keys, "id", "lat", "lng")
    small, large = split_groups(rows, keys, limit)
    schema = T.StructType([small.schema[c] for c in (*keys, "id")] + [T.StructField("cell_size", T.DoubleType())])

    def measure(pdf: pd.DataFrame) -> pd.DataFrame:
        mean = kernels.nearest_mean(pdf["lat"].to_numpy(), pdf["lng"].to_numpy(), k)
        return pdf[[*keys, "id"]].assign(cell_size=np.clip(mean * 0.9, 14.0, 28.0))

    out = spread(small, *keys).groupBy(*keys).applyInPandas(measure, schema)
    return out if large is None else out.unionByName(_cell_size_by_cells(large, keys, k))


def _cell_size_by_cells(points: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """The sizes in groups too large for a task.

    Only points whose k nearest lie within 156 m can leave the upper clamp, which
    bounds the search; a point sharing an 11 m cell with k others is at the lower
    clamp by counting alone.
    """
    from pyspark.sql import Window

    low, high = 14.0 / 0.9, 28.0 / 0.9
    reach = k * high
    side = low / 1.5 / geo.METRES_PER_DEGREE
    rows = points.select(*keys, "id", "lat", "lng").withColumns(
        {"_sy": cells.cell(F.col("lat"), side), "_sx": cells.cell(F.col("lng"), side)})
    crowd = rows.groupBy(*keys, "_sy", "_sx").agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.join(crowd, [*keys, "_sy", "_sx"]).drop("_sy", "_sx")
    dense = rows.filter(F.col("_n") > k).select(*keys, "id", F.lit(14.0).alias("cell_size"))
    dy, dx = cells.degrees_for(reach)
    targets = rows.select(*keys, F.col("id").alias("_id"), F.col("lat").alias("_la"), F.col("lng").alias("_ln"),
                          cells.cell(F.col("lat"), 2 * dy).alias("_cy"), cells.cell(F.col("lng"), 2 * dx).alias("_cx"))
    sparse = rows.filter(F.col("_n") <= k)
    met = cells.probe(sparse, F.col("lat"), F.col("lng"), dy, cells.reach_lng(reach, "lat"), 2 * dy, 2 * dx).join(targets, [*keys, "_cy", "_cx"]) \
        .filter(F.col("id") != F.col("_id")).withColumn("_d", geo.equirect_m("lat", "lng", "_la", "_ln")) \
        .filter(F.col("_d") <= reach)
    nearest = met.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "id").orderBy("_d"))) \
        .filter(F.col("_r") <= k).groupBy(*keys, "id").agg(F.sum("_d").alias("_s"), F.count(F.lit(1)).alias("_k"))
    sizes = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"))
    known = sparse.join(nearest, [*keys, "id"], "left").join(sizes, list(keys))
    want = F.least(F.lit(k), F.col("_all") - 1)
    mean = F.coalesce("_s", F.lit(0.0)) / F.greatest(want, F.lit(1))
    size = F.when(F.coalesce("_k", F.lit(0)) < want, 28.0).otherwise(F.greatest(F.lit(14.0), F.least(F.lit(28.0), mean * 0.9)))
    return dense.unionByName(known.select(*keys, "id", size.alias("cell_size")))
