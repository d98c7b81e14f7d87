"""Grid cells: turn distance predicates into equi-joins.

A raw distance predicate plans as a nested-loop join.  Here the searched side is
keyed by its cell and the probing side is repeated for the (at most four) cells
its search square touches, so the join is a hash or sort-merge join on
(key, cell) and the exact predicate filters the few rows that meet.

Copies at one coordinate are collapsed before any two rows meet, so that a pile
of copies costs one probe.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockwalk.functions import geo


def cell(value: Column, size) -> Column:
    return F.floor(value / size).cast("long")


def probe(df: DataFrame, y: Column, x: Column, reach_y, reach_x, size_y, size_x) -> DataFrame:
    """Repeat each row for every cell its search box overlaps (columns _cy, _cx)."""
    ys = F.sequence(cell(y - reach_y, size_y), cell(y + reach_y, size_y))
    xs = F.sequence(cell(x - reach_x, size_x), cell(x + reach_x, size_x))
    return df.withColumn("_cy", F.explode(ys)).withColumn("_cx", F.explode(xs))


METRES = 111000.0  # per degree, a little less than the least there is
POLE = 89.0  # reaches grow with latitude up to here


def degrees_for(metres: float) -> tuple[float, float]:
    """Sides in degrees from which cells for ``metres`` are sized: the longitude side is that of 60 degrees."""
    lat = metres / METRES
    return lat, 2 * lat


def reach_lng(metres: float, *lats) -> Column:
    """Degrees of longitude that cover ``metres`` at every one of the row's latitudes."""
    each = [F.abs(F.col(c) if isinstance(c, str) else c) for c in lats]
    highest = F.greatest(*each) if len(each) > 1 else each[0]
    return F.lit(metres / METRES) / F.cos(F.radians(F.least(highest + metres / METRES, F.lit(POLE))))


def around(df: DataFrame, lng: str, margin: Column) -> DataFrame:
    """Rows within ``margin`` of the 180th meridian stand on its other side as well."""
    x = F.col(lng)
    return df.withColumn(lng, F.explode(F.array_compact(F.array(
        x, F.when(x > 180 - margin, x - 360), F.when(x < -180 + margin, x + 360)))))


def distinct_points(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys, "lat", "lng").distinct()


def near_flags(points: DataFrame, others: DataFrame, keys: Sequence[str], metres: float) -> DataFrame:
    """Distinct positions of ``points`` that lie within ``metres`` of some row of ``others``."""
    dy, dx = degrees_for(metres)
    cy, cx = 2 * dy, 2 * dx
    targets = around(distinct_points(others, keys), "lng", 2 * reach_lng(metres, "lat")).withColumns(
        {"_cy": cell(F.col("lat"), cy), "_cx": cell(F.col("lng"), cx)}) \
        .withColumnsRenamed({"lat": "_olat", "lng": "_olng"})
    asked = probe(distinct_points(points, keys), F.col("lat"), F.col("lng"), dy, reach_lng(metres, "lat"), cy, cx)
    close = geo.haversine_m("lat", "lng", "_olat", "_olng") < metres
    return asked.join(targets, [*keys, "_cy", "_cx"]).filter(close).select(*keys, "lat", "lng").distinct()


def drop_near(new: DataFrame, existing: DataFrame, keys: Sequence[str], metres: float) -> DataFrame:
    """Rows of ``new`` with no existing row closer than ``metres``; new rows do not compete."""
    return new.join(near_flags(new, existing, keys, metres), [*keys, "lat", "lng"], "left_anti")


# ------------------------------------------------------------ roads

def road_segments(roads: DataFrame, *keep: str) -> DataFrame:
    """One row per consecutive vertex pair, numbered along the road."""
    seg = F.posexplode(geo.line_segments(F.col("coords"))).alias("seg", "_s")
    return roads.select(*keep, seg).select(
        *keep, "seg", F.col("_s.yj").alias("alat"), F.col("_s.xj").alias("alng"),
        F.col("_s.yi").alias("blat"), F.col("_s.xi").alias("blng"))


def nearest_segment(points: DataFrame, segments: DataFrame, keys: Sequence[str], id_col: str, metres: float,
                    carry: Sequence[str], rank: Sequence[str]) -> DataFrame:
    """Nearest road segment within ``metres`` of each point; unmatched points are absent.

    Segments are keyed by every cell their padded box overlaps - long segments
    are listed per cell, not per pair - and each point meets only its own cell.
    ``carry`` columns of the winner are returned with ``dist`` in metres.
    """
    dy, dx = degrees_for(metres)
    size_y, size_x = max(4 * dy, 0.001), max(4 * dx, 0.001)
    ys = F.sequence(cell(F.least("alat", "blat") - dy, size_y), cell(F.greatest("alat", "blat") + dy, size_y))
    pad = reach_lng(metres, "alat", "blat")
    xs = F.sequence(cell(F.least("alng", "blng") - pad, size_x), cell(F.greatest("alng", "blng") + pad, size_x))
    keyed = segments.withColumn("_cy", F.explode(ys)).withColumn("_cx", F.explode(xs))
    at = points.select(*keys, id_col, "lat", "lng",
                       cell(F.col("lat"), size_y).alias("_cy"), cell(F.col("lng"), size_x).alias("_cx"))
    # neither side's size is known: roads grow by cells, and points may come from a grid; taken for small, one would be gathered on the driver
    met = at.join(keyed.hint("merge"), [*keys, "_cy", "_cx"]) \
        .withColumn("dist", geo.point_segment_m("lat", "lng", "alat", "alng", "blat", "blng")) \
        .filter(F.col("dist") <= metres)
    best = F.min_by(F.struct("dist", *carry), F.struct("dist", *rank)).alias("_best")
    return met.groupBy(*keys, id_col).agg(best).select(*keys, id_col, "_best.*")
