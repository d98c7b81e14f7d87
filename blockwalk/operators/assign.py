"""Assigning points to blocks and roads by grid-cell joins."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockwalk.functions import domain, geo
from blockwalk.operators import cells, nearest
from blockwalk.operators.lineage import cut
from blockwalk.ship import ship

CELL_DEGREES = 0.001
SNAP_METRES = 10.0
SEGMENT_SNAP_METRES = 8.0
VERTEX_REACH = 0.0002
#: Side in degrees of the cells that points and road sides meet in.
SIDE_CELL = 0.0001
ENDS = ("alat", "alng", "blat", "blng")
#: A cell with more sides than this is parted for live points, by at most so many rows and columns, up to this latitude.
PART_SIDES = 4
MOST_PARTS = 24
PART_LATITUDE = 80.0
#: Sides times parts measured at once.
PART_PAIRS = 500_000


def block_ring() -> Column:
    """Ring of a block: its points when there are at least 3, else its box corners."""
    return F.when(F.size("points") >= 3, F.col("points")).otherwise(geo.bbox_ring("south", "west", "north", "east"))


def block_centre() -> Column:
    middle = F.struct(((F.col("north") + F.col("south")) / 2).alias("lat"), ((F.col("east") + F.col("west")) / 2).alias("lng"))
    return F.when(F.size("points") >= 3, geo.vertex_mean(F.col("points"))).otherwise(middle)


def _keyed_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks listed under every cell their ring or box overlaps, with what the point test needs."""
    box = geo.ring_bbox(block_ring())
    span = lambda lo, hi: F.explode(F.sequence(cells.cell(lo, CELL_DEGREES), cells.cell(hi, CELL_DEGREES)))
    return blocks.withColumns({"_box": box, "_ring": F.size("points") >= 3, "_edges": geo.ring_edges(block_ring()),
                               "_c": block_centre()}) \
        .withColumn("_cy", span(F.col("_box.south"), F.col("_box.north"))) \
        .withColumn("_cx", span(F.col("_box.west"), F.col("_box.east"))) \
        .select("hlb_id", "_cy", "_cx", "block_id", F.col("pos").alias("_bpos"), "_ring", "_edges",
                geo.nwse_score(F.col("_c.lat"), F.col("_c.lng")).alias("_score"),
                F.struct("south", "west", "north", "east").alias("_b"))


def assign_blocks(symbols: DataFrame, blocks: DataFrame, order: str = "census", corners_as_ring: bool = False) -> DataFrame:
    """(hlb_id, id, lat, lng, pos, block_id, block_score, block_pos) with a null block for rows outside all blocks.

    The first matching block wins: in north-west to south-east order for
    ``census``, in stored order for ``stored``.  A block without a ring is tested
    as an inclusive box, or (``corners_as_ring``) by its corners as a ring.
    """
    at = symbols.select("hlb_id", "id", "lat", "lng", "pos", cells.cell(F.col("lat"), CELL_DEGREES).alias("_cy"),
                        cells.cell(F.col("lng"), CELL_DEGREES).alias("_cx"))
    inside = geo.point_in_edges("lat", "lng", F.col("_edges"))
    if not corners_as_ring:
        inside = F.when(F.col("_ring"), inside).otherwise(
            geo.in_bbox("lat", "lng", F.col("_b.south"), F.col("_b.west"), F.col("_b.north"), F.col("_b.east")))
    rank = F.struct("_score", "_bpos") if order == "census" else F.struct("_bpos", "_score")
    # blocks grow by cells, which no estimate knows: taken for small, they would be gathered on the driver
    met = at.join(_keyed_blocks(blocks).hint("merge"), ["hlb_id", "_cy", "_cx"], "left") \
        .withColumn("_in", F.coalesce(inside, F.lit(False)))
    chosen = F.min_by(F.struct("block_id", "_score", "_bpos"), F.when(F.col("_in"), rank)).alias("_b")
    return met.groupBy("hlb_id", "id").agg(
        F.first("lat").alias("lat"), F.first("lng").alias("lng"), F.first("pos").alias("pos"), chosen,
        F.max("_in").alias("_any")) \
        .select("hlb_id", "id", "lat", "lng", "pos", F.when(F.col("_any"), F.col("_b.block_id")).alias("block_id"),
                F.when(F.col("_any"), F.col("_b._score")).alias("block_score"),
                F.when(F.col("_any"), F.col("_b._bpos")).alias("block_pos"))


def block_counts(symbols: DataFrame, blocks: DataFrame, capacity: int = domain.BLOCK_CAPACITY) -> DataFrame:
    """Numberable symbols per block, empty blocks as 0, with a flag for over-full ones."""
    placed = assign_blocks(symbols.filter(domain.is_numberable(F.col("symbol_type"))), blocks, "stored", True)
    counts = placed.filter("block_id IS NOT NULL").groupBy("hlb_id", "block_id").agg(F.count(F.lit(1)).alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    return blocks.select("hlb_id", "block_id").join(counts, ["hlb_id", "block_id"], "left") \
        .select("hlb_id", "block_id", n.alias("houses"), (n > capacity).alias("over_full"))


def block_orientation(symbols: DataFrame, blocks: DataFrame) -> DataFrame:
    """Angle of the longest edge of the block around each symbol, null outside all blocks."""
    placed = assign_blocks(symbols, blocks, "stored", True)
    angle = blocks.select("hlb_id", "block_id", geo.longest_edge_angle_degrees(block_ring()).alias("angle"))
    return placed.join(angle, ["hlb_id", "block_id"], "left").select("hlb_id", "id", "block_id", "angle")


# --------------------------------------------------------------------- roads

def snap_segments(segments: DataFrame, roads: DataFrame, metres: float = SEGMENT_SNAP_METRES) -> DataFrame:
    """Road of each survey segment by the centre of its box; segments far from all roads are new roads.

    ``segments``: hlb_id, segment_id, points.  Segments under two points are left alone.
    """
    lats, lngs = F.transform("points", lambda p: p["lat"]), F.transform("points", lambda p: p["lng"])
    centre = segments.filter(F.size("points") >= 2).select(
        "hlb_id", "segment_id", ((F.array_min(lats) + F.array_max(lats)) / 2).alias("lat"),
        ((F.array_min(lngs) + F.array_max(lngs)) / 2).alias("lng"))
    lines = cells.road_segments(roads, "hlb_id", "osm_id", "pos")
    near = cells.nearest_segment(centre, lines, ["hlb_id"], "segment_id", metres, ["osm_id"], ["pos"]) \
        .filter(F.col("dist") < metres).select("hlb_id", "segment_id", F.col("osm_id").alias("snapped_to_osm"))
    return segments.join(near, ["hlb_id", "segment_id"], "left").withColumn(
        "is_new_road", F.when((F.size("points") >= 2) & F.col("snapped_to_osm").isNull(), True))


def road_sides(roads: DataFrame, metres: float = SNAP_METRES) -> DataFrame:
    """(_cy, _cx, road_id, pos, seg, alat, alng, blat, blng, verts): the road sides within ``metres`` of each cell.

    A side is listed under the cells along it, not under all of its box. ``verts`` are the vertices of the side's road
    that let a point of the cell consider it.
    """
    usable = roads.filter(F.size("coords") >= 2)
    vertex = usable.select("road_id", F.explode("coords").alias("_v")) \
        .select("road_id", F.col("_v.lat").alias("lat"), F.col("_v.lng").alias("lng")).distinct()
    vertices = cells.probe(vertex, F.col("lat"), F.col("lng"), VERTEX_REACH, VERTEX_REACH, SIDE_CELL, SIDE_CELL) \
        .groupBy("road_id", "_cy", "_cx").agg(F.collect_list(F.struct("lat", "lng")).alias("verts"))
    dy, dx = metres / cells.METRES, cells.reach_lng(metres, "alat", "blat")
    rise = F.nullif(F.col("blat") - F.col("alat"), F.lit(0.0))
    # where the side enters and leaves the cell's row of the grid
    at = lambda y, flat: F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (y - F.col("alat")) / rise)), F.lit(flat))
    lng = lambda t: F.col("alng") + t * (F.col("blng") - F.col("alng"))
    low, high = lng(at(F.col("_cy") * SIDE_CELL - 1.01 * dy, 0.0)), lng(at((F.col("_cy") + 1) * SIDE_CELL + 1.01 * dy, 1.0))
    span = lambda lo, hi: F.explode(F.sequence(cells.cell(lo, SIDE_CELL), cells.cell(hi, SIDE_CELL)))
    return cells.road_segments(usable, "road_id", "pos") \
        .withColumn("_cy", span(F.least("alat", "blat") - dy, F.greatest("alat", "blat") + dy)) \
        .withColumn("_cx", span(F.least(low, high) - dx, F.greatest(low, high) + dx)).join(vertices.hint("merge"), ["road_id", "_cy", "_cx"])


def _near(lat: Column, lng: Column) -> Column:
    return (F.abs(lat - F.col("lat")) < VERTEX_REACH) & (F.abs(lng - F.col("lng")) < VERTEX_REACH)


def _considered(verts: Column, alat: Column, alng: Column, blat: Column, blng: Column) -> Column:
    """A vertex of the side's road lies near the point; mostly one of the side's own ends does."""
    return _near(alat, alng) | _near(blat, blng) | F.exists(verts, lambda v: _near(v["lat"], v["lng"]))


def _foot(alat: Column, alng: Column, blat: Column, blng: Column) -> dict[str, Column]:
    """The nearest point of a side."""
    k = F.cos(F.radians("lat"))
    frac = geo.segment_fraction(F.col("lng") * k, F.col("lat"), alng * k, alat, blng * k, blat)
    return {"snap_lat": alat + frac * (blat - alat), "snap_lng": alng + frac * (blng - alng)}


def snap_points(points: DataFrame, roads: DataFrame, key: str, id_col: str, metres: float = SNAP_METRES) -> DataFrame:
    """(key, id, road_id, road_dist, snap_lat, snap_lng) of points on a mapped road.

    A road is considered when one of its vertices lies within 0.0002 degrees of
    the point on both axes; then the nearest point of the whole line decides.
    ``roads``: road_id, pos, coords - the same roads serve all keys.
    """
    # a row of the roads becomes some tens by cells, which no estimate knows: taken for small, they would be gathered on the driver
    sides = road_sides(roads, metres).hint("merge")
    # fixes repeat positions; each distinct position is matched once
    places = points.select("lat", "lng").distinct()

    def meet(at: DataFrame, within: Column) -> DataFrame:
        # comparisons first, and what depends on the place alone (cosine, margins) is worked out before it meets the sides of its cell:
        # a condition on pairs does not share its parts
        at = at.withColumns({"_cy": cells.cell(F.col("lat"), SIDE_CELL), "_cx": cells.cell(F.col("lng"), SIDE_CELL),
                             "_k": F.cos(F.radians("lat")) * geo.METRES_PER_DEGREE})
        at = at.withColumns({"_dy": within * (1.001 / geo.METRES_PER_DEGREE) + 1e-12, "_dx": within * 1.001 / F.col("_k") + 1e-12})
        lat, lng, dy, dx = map(F.col, ("lat", "lng", "_dy", "_dx"))
        box = (lat >= F.least("alat", "blat") - dy) & (lat <= F.greatest("alat", "blat") + dy) \
            & (lng >= F.least("alng", "blng") - dx) & (lng <= F.greatest("alng", "blng") + dx)
        return at.join(sides, ["_cy", "_cx"]).filter(box) \
            .withColumn("road_dist", geo.point_segment_m("lat", "lng", "alat", "alng", "blat", "blng", F.col("_k"))) \
            .filter(F.col("road_dist") <= within).filter(_considered(*map(F.col, ("verts", *ENDS))))

    # Pairs of a place and a side never travel: the least distance is a plain number, combined where the pairs are made,
    # and only sides at that distance meet their place again, to be told apart by position and number. Places, not cells, are
    # grouped, so that a crowded cell may be split over tasks.
    least = meet(places, F.lit(metres)).groupBy("lat", "lng").agg(F.min("road_dist").alias("_least"))
    best = meet(least, F.col("_least") * (1 + 1e-12)).groupBy("lat", "lng").agg(F.min_by(
        F.struct("road_id", "road_dist", "alat", "alng", "blat", "blng"), F.struct("road_dist", "pos", "seg")).alias("_b")).select("lat", "lng", "_b.*")
    on = best.withColumns(_foot(*map(F.col, ENDS)))
    return points.select(key, id_col, "lat", "lng").join(on, ["lat", "lng"]) \
        .select(key, id_col, "road_id", "road_dist", "snap_lat", "snap_lng")


def side_parts(cy: int, cx: int, ends: tuple, metres: float) -> list[list[int]]:
    """The sides of a cell that may be the nearest somewhere in each part of it, parts by rows from the south-west.

    A side goes only where another one, which every point of the part considers, is nearer to all of the part, or where the part is out of reach.
    """
    alat, alng, blat, blng = ends
    n = 1 if len(alat) <= PART_SIDES or abs(cy) * SIDE_CELL > PART_LATITUDE else min(MOST_PARTS, math.ceil(2 * math.sqrt(len(alat))))
    if n == 1:
        return [list(range(len(alat)))]
    half = SIDE_CELL / n / 2
    middle = half * (2 * np.arange(n) + 1)
    ys, xs = np.repeat(cy * SIDE_CELL + middle, n)[:, None], np.tile(cx * SIDE_CELL + middle, n)[:, None]
    reach, out = VERTEX_REACH - half - 1e-9, []
    at_once = max(1, PART_PAIRS // len(alat))
    for first in range(0, n * n, at_once):
        y, x = ys[first:first + at_once], xs[first:first + at_once]
        k = np.cos(np.radians(y)) * geo.METRES_PER_DEGREE
        ay, ax, by, bx = (alat - y) * geo.METRES_PER_DEGREE, (alng - x) * k, (blat - y) * geo.METRES_PER_DEGREE, (blng - x) * k
        length = (by - ay) ** 2 + (bx - ax) ** 2
        t = np.clip(-(ay * (by - ay) + ax * (bx - ax)) / np.where(length > 0, length, 1.0), 0.0, 1.0)
        far = np.hypot(ay + t * (by - ay), ax + t * (bx - ax))
        sure = ((np.abs(alat - y) < reach) & (np.abs(alng - x) < reach)) | ((np.abs(blat - y) < reach) & (np.abs(blng - x) < reach))
        # a corner of the part lies so far from its middle; the metre of a degree of longitude changes by less than a millimetre over a reach
        corner = np.hypot(half * geo.METRES_PER_DEGREE, half * k[:, 0]) + 0.002
        least = np.where(sure, far, np.inf).min(axis=1)
        out += [np.flatnonzero(row).tolist() for row in far <= np.minimum(least + 2 * corner, metres + corner)[:, None]]
    return out


def road_cells(roads: DataFrame, metres: float = SNAP_METRES) -> DataFrame:
    """(_cy, _cx, lines, _parts, _n): one row per cell of some eleven metres with the :func:`road_sides` of it; a stream joins it by equality.

    ``_parts`` lists the sides that matter in each of the cell's _n by _n parts, so that a point's cost does not grow with the roads of its cell.
    """
    ship(roads.sparkSession)
    # the side's own ends are at hand anyway
    others = F.filter("verts", lambda v: ~(((v["lat"] == F.col("alat")) & (v["lng"] == F.col("alng"))) | ((v["lat"] == F.col("blat")) & (v["lng"] == F.col("blng")))))
    line = F.struct("pos", "seg", "road_id", "alat", "alng", "blat", "blng", others.alias("verts"))

    def parts(cy: pd.Series, cx: pd.Series, *ends: pd.Series) -> pd.Series:
        return pd.Series([side_parts(y, x, e, metres) for y, x, *e in zip(cy, cx, *ends, strict=True)])

    parted = F.pandas_udf(parts, "array<array<int>>")("_cy", "_cx", *[F.col(f"lines.{c}") for c in ENDS])
    return cut(road_sides(roads, metres).groupBy("_cy", "_cx").agg(F.collect_list(line).alias("lines")).withColumn("_parts", parted)
               .withColumn("_n", F.sqrt(F.size("_parts")).cast("int")))


def on_roads(points: DataFrame, by_cell: DataFrame, metres: float = SNAP_METRES) -> DataFrame:
    """Adds road_id, snap_lat and snap_lng (null off the roads) from :func:`road_cells`, by the rule of :func:`snap_points`;
    no aggregation, so a stream may use it."""
    lat, lng, n = F.col("lat"), F.col("lng"), F.col("_n")
    met = points.withColumns({"_cy": cells.cell(lat, SIDE_CELL), "_cx": cells.cell(lng, SIDE_CELL)}).join(by_cell, ["_cy", "_cx"], "left") \
        .withColumns({"_dx": cells.reach_lng(metres, "lat"), "_k": F.cos(F.radians("lat")) * geo.METRES_PER_DEGREE})
    dy = metres / cells.METRES
    at = lambda v, c: F.greatest(F.lit(0), F.least(n - 1, F.floor((v / SIDE_CELL - F.col(c)) * n).cast("int")))
    sides = F.transform(F.get("_parts", at(lat, "_cy") * n + at(lng, "_cx")), lambda i: F.get("lines", i))
    # comparisons first: few sides are left to measure
    box = lambda s: ((lat >= F.least(s["alat"], s["blat"]) - dy) & (lat <= F.greatest(s["alat"], s["blat"]) + dy)
                     & (lng >= F.least(s["alng"], s["blng"]) - F.col("_dx")) & (lng <= F.greatest(s["alng"], s["blng"]) + F.col("_dx")))
    held = F.filter(sides, lambda s: box(s) & _considered(s["verts"], *(s[c] for c in ENDS)))
    flat = lambda s, end: (((s[f"{end}lng"] - lng) * F.col("_k")).alias(f"{end}x"), ((s[f"{end}lat"] - lat) * geo.METRES_PER_DEGREE).alias(f"{end}y"))
    far = lambda s: geo.let(F.struct(*flat(s, "a"), *flat(s, "b")), lambda e: geo.point_segment(F.lit(0.0), F.lit(0.0), *(e[c] for c in ("ax", "ay", "bx", "by"))))
    best = F.array_min(F.transform(held, lambda s: F.struct(far(s).alias("dist"), s["pos"].alias("pos"), s["seg"].alias("seg"), s.alias("side"))))
    met = met.withColumn("_best", geo.let(best, lambda m: F.when(m["dist"] <= metres, m["side"])))
    b = lambda c: F.col(f"_best.{c}")
    return met.withColumns({"road_id": b("road_id"), **_foot(*map(b, ENDS))}) \
        .drop("_cy", "_cx", "_dx", "_k", "lines", "_parts", "_n", "_best")


def nearest_road_bearing(symbols: DataFrame, roads: DataFrame, metric: str = "degrees", right_angles: bool = False) -> DataFrame:
    """Angle of the road segment whose midpoint is nearest to each symbol; 0 without roads.

    ``degrees`` measures raw degrees, ``metres`` a flat distance; ``right_angles``
    rounds to the nearest quarter turn.
    """
    lines = cells.road_segments(roads, "hlb_id", "pos").select(
        "hlb_id", "pos", "seg", ((F.col("alat") + F.col("blat")) / 2).alias("tlat"),
        ((F.col("alng") + F.col("blng")) / 2).alias("tlng"),
        F.atan2(F.col("blat") - F.col("alat"), F.col("blng") - F.col("alng")).alias("angle"))
    distance = geo.degree_distance("lat", "lng", "tlat", "tlng") if metric == "degrees" \
        else geo.equirect_m("lat", "lng", "tlat", "tlng") / geo.METRES_PER_DEGREE
    found = nearest.nearest_target(symbols, lines, ["hlb_id"], ["angle", "pos", "seg"], [F.col("pos"), F.col("seg")],
                                   distance, 0.004)
    angle = F.coalesce("angle", F.lit(0.0))
    if right_angles:
        import math

        angle = F.floor(angle / (math.pi / 2) + 0.5) * (math.pi / 2)
    return found.select("hlb_id", "id", angle.alias("angle"))
