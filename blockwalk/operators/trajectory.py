"""Survey tracks: smoothing, stationarity, thinning, snapping, segments, return detection, summary.

Two steps depend on their own earlier result and run as folds (see
:mod:`blockwalk.operators.folds`): the filter, and the choice of kept points.
Everything between and after them is window and join work.

``count_on`` names a cheaper table with at least the same rows per session (the
raw fixes); the check for oversized sessions then does not run the steps before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockwalk.functions import domain, geo
from blockwalk.operators import assign, cells, folds, kernels
from blockwalk.operators.lineage import cut, spread
from blockwalk.operators.nearest import split_groups
from blockwalk.operators.ordered import TASK_ROWS, Ordered, any_hot

# Thresholds of the recorder.
STILL_METRES = 1.0
MAX_ACCURACY = 50.0
THIN_METRES = 0.8
RETURN_METRES = 5.0
RETURN_DEGREES = 150.0
RETURN_AFTER = 30
LINE_ROWS = 200_000
KEY = ["session_id"]
ORDER = ("ts", "point_id")


def _order() -> list[Column]:
    return [F.col(c) for c in ORDER]


def smooth(fixes: DataFrame, limit: int = TASK_ROWS) -> DataFrame:
    """Filtered positions (lat, lng replaced), one-dimensional Kalman filter per axis."""
    return folds.kalman(fixes, KEY, list(ORDER), limit)


def with_motion(smoothed: DataFrame, limit: int = TASK_ROWS, count_on: DataFrame | None = None) -> DataFrame:
    """Movement class, five-fix stillness, and the smoothed bearing at every fix.

    Frames run over all fixes of the session, recorded or not; the bearing goes
    from the first to the last of five fixes and is 0 for the first fix.
    """
    def last5(c):
        return lambda w: F.collect_list(c).over(w.rowsBetween(-4, 0))

    rows = Ordered.of(smoothed, KEY, _order(), limit, count_on).frame(
        before=4, _ys=last5("lat"), _xs=last5("lng")).rows()
    return motion_columns(rows)


def motion_columns(rows: DataFrame) -> DataFrame:
    """What follows from the last five smoothed positions (``_ys``, ``_xs``), the speed and the accuracy of a fix."""
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v) / 5
    rows = rows.withColumns({"_cy": mean(F.col("_ys")), "_cx": mean(F.col("_xs"))})
    far = F.exists(F.arrays_zip("_ys", "_xs"), lambda p: geo.haversine_m(
        p["_ys"], p["_xs"], F.col("_cy"), F.col("_cx"), geo.TURF_RADIUS_M) >= STILL_METRES)
    y0, x0 = F.element_at("_ys", 1), F.element_at("_xs", 1)
    return rows.withColumns({
        "movement": domain.movement_class(F.col("speed"), F.col("accuracy")),
        "gps_quality": domain.accuracy_label(F.col("accuracy")),
        "stationary": (F.size("_ys") == 5) & ~far,
        "bearing": F.when(F.size("_ys") < 2, 0.0).otherwise(geo.signed_bearing(y0, x0, "lat", "lng"))}) \
        .drop("_ys", "_xs", "_cy", "_cx")


def recordable() -> Column:
    """A fix may enter the path: moving, accurate enough, on foot (and recording, where that is known)."""
    return ~F.col("stationary") & (F.col("accuracy") <= MAX_ACCURACY) & F.col("movement").isin("walking", "fast_walk")


def kept_path(motion: DataFrame, roads: DataFrame | None = None, limit: int = TASK_ROWS,
              count_on: DataFrame | None = None) -> DataFrame:
    """Fixes that enter the path: at least 0.8 m from the last kept point, snapped to a mapped road if on one.

    The distance is measured from the smoothed fix to the last kept point as
    stored, that is after snapping.  Adds on_road, road_id, out_lat, out_lng.
    """
    rows = motion.filter(recordable())
    if roads is None:
        snapped = rows.withColumns({"road_id": F.lit(None).cast("long"), "out_lat": F.col("lat"), "out_lng": F.col("lng")})
    else:
        rows = cut(rows)  # matched to roads and joined back
        near = assign.snap_points(rows, roads, "session_id", "point_id").drop("road_dist")
        snapped = rows.join(near, ["session_id", "point_id"], "left").withColumns({
            "out_lat": F.coalesce("snap_lat", "lat"), "out_lng": F.coalesce("snap_lng", "lng")}).drop("snap_lat", "snap_lng")
    kept = folds.thin_path(snapped, KEY, list(ORDER), THIN_METRES, limit, count_on)
    return kept.withColumn("on_road", F.col("road_id").isNotNull())


def segments(path: DataFrame, limit: int = TASK_ROWS, keep_duplicates: bool = False,
             count_on: DataFrame | None = None) -> DataFrame:
    """Points of the drawn segments: (session_id, segment, point_id, ts, out_lat, out_lng, road_type).

    A segment ends at a pause, a road-type change, or on entering a mapped road.
    After a pause or type change the next one starts from the previous point;
    after leaving a road it starts at the current point (stored twice with
    ``keep_duplicates``).  Segments under two points are dropped.  Optional input
    columns: ``road_type`` and ``paused`` (a pause lies before this fix).
    """
    cols = path.columns
    path = path if "road_type" in cols else path.withColumn("road_type", F.lit("residential"))
    path = path if "paused" in cols else path.withColumn("paused", F.lit(False))
    lagged = Ordered.of(path, KEY, _order(), limit, count_on).lag(
        _road="on_road", _type="road_type", _lat="out_lat", _lng="out_lng", _ts="ts", _id="point_id")
    was_on = F.coalesce("_road", F.lit(False))
    free = ~F.col("on_road")
    typed = F.coalesce(F.col("road_type") != F.col("_type"), F.lit(False))
    left = free & was_on
    rows = lagged.df.withColumns({
        "_seeded": free & ~was_on & (typed | F.col("paused")) & F.col("_id").isNotNull(), "_left": left,
        "_break": F.when(free & (typed | F.col("paused") | was_on), 1).otherwise(0)})
    numbered = Ordered(rows, lagged.keys, lagged.order, lagged.split, lagged.chunk_rows).running(segment="_break").rows()
    here = F.struct(F.lit(1).alias("part"), F.col("point_id").alias("point_id"), F.col("ts").alias("ts"),
                    F.col("out_lat").alias("out_lat"), F.col("out_lng").alias("out_lng"))
    seed = F.when(F.col("_seeded"), F.struct(F.lit(0).alias("part"), F.col("_id").alias("point_id"), F.col("_ts").alias("ts"),
                                             F.col("_lat").alias("out_lat"), F.col("_lng").alias("out_lng")))
    twice = F.when(F.col("_left") & F.lit(keep_duplicates), here.withField("part", F.lit(0)))
    points = numbered.filter(free).select("session_id", F.col("segment").cast("long").alias("segment"), "road_type",
                                          F.explode(F.array_compact(F.array(seed, twice, here))).alias("_p")) \
        .select("session_id", "segment", "road_type", "_p.*")
    points = cut(points)  # counted and filtered
    size = points.groupBy("session_id", "segment").agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 2").drop("_n")
    return points.join(size, ["session_id", "segment"], "left_semi")


def segment_lines(points: DataFrame) -> DataFrame:
    """One row per segment with its points in order, at most the rows of one recording between breaks."""
    item = F.struct("ts", "point_id", "part", "out_lat", "out_lng")
    return points.groupBy("session_id", "segment", "road_type").agg(F.array_sort(F.collect_list(item)).alias("_p")) \
        .select("session_id", "segment", "road_type", F.transform("_p", lambda p: geo.point(p["out_lat"], p["out_lng"])).alias("points"))


def path_length(path: DataFrame, lat: str = "out_lat", lng: str = "out_lng", limit: int = TASK_ROWS,
                count_on: DataFrame | None = None) -> DataFrame:
    """Metres along the path and its point count per session."""
    rows = Ordered.of(path, KEY, _order(), limit, count_on).lag(_lat=lat, _lng=lng).rows()
    hop = F.when(F.col("_lat").isNotNull(), geo.haversine_m("_lat", "_lng", lat, lng)).otherwise(0.0)  # the first point has no way behind it
    return rows.groupBy("session_id").agg(F.sum(hop).alias("distance_m"), F.count(F.lit(1)).alias("points"))


def return_path(path: DataFrame, points: DataFrame, limit: int = TASK_ROWS, count_on: DataFrame | None = None) -> DataFrame:
    """First moment each session walks back along itself: (session_id, point_id, ts).

    A path point after the thirtieth returns when an earlier, finished segment has
    a point closer than 5 m from which the segment ran more than 150 degrees off
    the present bearing.
    """
    dy, dx = cells.degrees_for(RETURN_METRES)
    finish = points.groupBy("session_id", "segment").agg(F.max("ts").alias("_end"))
    in_order = [F.col("ts"), F.col("point_id"), F.col("part")]
    legs = Ordered.of(points, ["session_id", "segment"], in_order, limit).lead(_nlat="out_lat", _nlng="out_lng").rows() \
        .filter("_nlat IS NOT NULL").withColumn("_way", geo.signed_bearing("out_lat", "out_lng", "_nlat", "_nlng")) \
        .join(finish, ["session_id", "segment"])
    # one lane walked many times: per spot and direction only the segment that ended first matters
    legs = legs.groupBy("session_id", F.col("out_lat").alias("_slat"), F.col("out_lng").alias("_slng"), "_way") \
        .agg(F.min("_end").alias("_end")) \
        .withColumns({"_cy": cells.cell(F.col("_slat"), 2 * dy), "_cx": cells.cell(F.col("_slng"), 2 * dx)})
    late = Ordered.of(path, KEY, _order(), limit, count_on).row_number("_n").rows().filter(F.col("_n") > RETURN_AFTER)
    asked = cells.probe(late.select("session_id", "point_id", "ts", "out_lat", "out_lng", "bearing"),
                        F.col("out_lat"), F.col("out_lng"), dy, cells.reach_lng(RETURN_METRES, "out_lat"), 2 * dy, 2 * dx)
    met = asked.join(legs, ["session_id", "_cy", "_cx"]) \
        .filter((F.col("_end") < F.col("ts"))
                & (geo.haversine_m("out_lat", "out_lng", "_slat", "_slng") < RETURN_METRES)
                & (geo.bearing_gap("bearing", "_way") > RETURN_DEGREES))
    return met.groupBy("session_id").agg(F.min(F.struct("ts", "point_id")).alias("_f")) \
        .select("session_id", F.col("_f.point_id").alias("point_id"), F.col("_f.ts").alias("ts"))


def session_summary(sessions: DataFrame, path: DataFrame, points: DataFrame, symbols: DataFrame,
                    count_on: DataFrame | None = None) -> DataFrame:
    """Distance, duration, houses (pucca and kutcha only), segments and kept points per session."""
    span = path.groupBy("session_id").agg(F.min("ts").alias("_t0"), F.max("ts").alias("_t1"))
    drawn = points.groupBy("session_id").agg(F.count_distinct("segment").alias("road_count"))
    houses = symbols.filter(F.col("symbol_type").isin(domain.COUNTED_HOUSES)).groupBy("session_id").agg(F.count(F.lit(1)).alias("house_count"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return sessions.select("session_id").join(path_length(path, count_on=count_on), "session_id", "left").join(span, "session_id", "left") \
        .join(drawn, "session_id", "left").join(houses, "session_id", "left").select(
            "session_id", F.coalesce("distance_m", F.lit(0.0)).alias("distance_m"),
            F.coalesce(F.unix_seconds("_t1") - F.unix_seconds("_t0"), F.lit(0)).alias("duration_s"),
            zero("house_count"), zero("road_count"), F.coalesce("points", F.lit(0)).alias("gps_point_count"))


#: Lists of drawn features in a stored session; absent ones are empty in its document.
DRAWN = ("blocks", "farmlandBlocks", "forests", "waterBodies", "landuseAreas", "landmarks")
# Fixed value: where a map opens that has no boundary.
MAP_CENTER = (26.4499, 80.3319)

_POLYGON = "struct<geometry: struct<coordinates: array<array<array<double>>>>>"


def session_document(sessions: DataFrame, symbols: DataFrame, lines: DataFrame, default_highway: str = "residential") -> DataFrame:
    """One JSON map document per session: symbols, segments of two points or more, drawn features and boundary.

    ``sessions``: session_id and, where stored, hlb_number, polygon_geojson, drawn_features (JSON texts) and payment_status. Broken texts count as absent.
    A document is the unit the product stores; it is as large as one survey.
    """
    stored = {c: F.lit(None).cast("string") for c in ("hlb_number", "polygon_geojson", "drawn_features", "payment_status") if c not in sessions.columns}
    sessions = sessions.withColumns(stored)
    marks = symbols.groupBy("session_id").agg(F.array_sort(F.collect_list(
        F.struct("id", "symbol_type", "lat", "lng", "number"))).alias("symbols"))
    drawn = lines.filter(F.size("points") >= 2).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("segment").alias("id"), F.coalesce("road_type", F.lit(default_highway)).alias("highway"),
        F.col("points").alias("coords"), F.lit(True).alias("confirmed"), F.lit("user").alias("source")))).alias("roads"))
    ring = F.get(F.from_json("polygon_geojson", _POLYGON)["geometry"]["coordinates"], F.lit(0))
    features = F.try_parse_json("drawn_features")
    listed = lambda name: F.coalesce(F.try_variant_get(features, f"$.{name}", "variant"), F.parse_json(F.lit("[]"))).alias(name)
    rows = sessions.withColumn("_ring", F.coalesce(ring, F.array().cast("array<array<double>>"))).join(marks, "session_id", "left").join(drawn, "session_id", "left")
    at = lambda p: F.struct(p[1].alias("lat"), p[0].alias("lng"))
    first = F.when(F.size("_ring") > 0, at(F.get("_ring", F.lit(0)))).otherwise(F.struct(F.lit(MAP_CENTER[0]).alias("lat"), F.lit(MAP_CENTER[1]).alias("lng")))
    none = lambda df, c: F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType)).alias(c)
    return rows.select("session_id", F.to_json(F.struct(
        F.coalesce("hlb_number", F.lit("LIVE")).alias("hlbNumber"), first.alias("center"), none(marks, "symbols"), none(drawn, "roads"), *map(listed, DRAWN),
        F.transform("_ring", at).alias("boundaryPins"), F.lit(True).alias("boundaryClosed"), F.lit(True).alias("numberingComplete"),
        F.col("session_id").alias("projectId"), F.lit(True).alias("isLive"), F.coalesce("payment_status", F.lit("unpaid")).alias("paymentStatus"))).alias("document"))


def place_symbols(placements: DataFrame, motion: DataFrame, path: DataFrame) -> DataFrame:
    """Symbol positions from where the surveyor stood: centre, 3 m left or right, or 7 m along the compass.

    ``placements``: session_id, placement_id, ts, direction, heading.  The position
    is the last path point before the placement, the bearing the one at the last fix;
    a placement before the first path point has no position and is dropped.
    """
    def last_before(rows: DataFrame, *columns: str) -> DataFrame:
        # as-of join: both tables in one order per session, last values carried forward
        marks = placements.select("session_id", "ts", F.lit(1).alias("_kind"), "placement_id", *[
            F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in columns])
        both = rows.select("session_id", "ts", F.lit(0).alias("_kind"), F.lit(None).cast(marks.schema["placement_id"].dataType)
                           .alias("placement_id"), *columns).unionByName(marks)
        return folds.carry_forward(both, KEY, ["ts", "_kind", "placement_id"], list(columns)) \
            .filter("_kind = 1").select("session_id", "placement_id", *columns)

    at = last_before(path, "out_lat", "out_lng")
    facing = last_before(motion, "bearing")
    rows = placements.join(at.filter("out_lat IS NOT NULL"), ["session_id", "placement_id"]) \
        .join(facing, ["session_id", "placement_id"])
    side = F.when(F.col("direction") == "left", F.col("bearing") - 90.0).otherwise(F.col("bearing") + 90.0)
    compass = (F.col("direction") == "compass") & F.col("heading").isNotNull()
    way = F.when(compass, F.col("heading")).otherwise(F.pmod(side, F.lit(360.0)))
    lat, lng = geo.destination("out_lat", "out_lng", F.when(compass, 7.0).otherwise(3.0), way)
    stay = F.col("direction") == "center"
    return rows.select(*placements.columns, F.when(stay, F.col("out_lat")).otherwise(lat).alias("lat"),
                       F.when(stay, F.col("out_lng")).otherwise(lng).alias("lng"))


# ------------------------------------------------------------------ drawing

def chaikin(lines: DataFrame, keys: list[str], iterations: int = 3, straight: float = 12.0, limit: int = TASK_ROWS) -> DataFrame:
    """Corner cutting of vertex rows (keys, i, lat, lng); turns under ``straight`` degrees keep their vertex.

    Ends stay where they are; lines under three vertices are left alone.
    """
    rows = lines.select(*keys, F.col("i").cast("long").alias("i"), "lat", "lng")
    # a pass at most triples a line, so one look at the input settles whether any line must be split
    split = any_hot(rows, keys, max(1, limit // 3 ** iterations))
    for _ in range(iterations):
        o = Ordered.of(rows, keys, [F.col("i")], limit) if split else Ordered(rows, tuple(keys), (F.col("i"),))
        o = o.frame(
            before=2, after=2, _pl=lambda w: F.lag("lat").over(w), _pg=lambda w: F.lag("lng").over(w),
            _nl=lambda w: F.lead("lat").over(w), _ng=lambda w: F.lead("lng").over(w),
            _p2=lambda w: F.lag("lat", 2).over(w), _n2=lambda w: F.lead("lat", 2).over(w))
        first, last = F.col("_pl").isNull(), F.col("_nl").isNull()
        short = (first & F.col("_n2").isNull()) | (last & F.col("_p2").isNull())  # a line of one or two vertices
        turn = F.abs(geo.turn_angle(geo.bearing_deg("_pl", "_pg", "lat", "lng"), geo.bearing_deg("lat", "lng", "_nl", "_ng")))
        mix = lambda k, a: F.struct(F.lit(k).alias("k"), (a * F.col("lat") + (1 - a) * F.col("_nl")).alias("lat"),
                                    (a * F.col("lng") + (1 - a) * F.col("_ng")).alias("lng"))
        own = F.struct(F.lit(0).alias("k"), F.col("lat").alias("lat"), F.col("lng").alias("lng"))
        corner = F.array(mix(1, 0.75), mix(2, 0.25))
        out = F.when(short | last, F.array(own)).when(first, F.concat(F.array(own), corner)) \
            .when(turn < straight, F.array(own)).otherwise(corner)
        rows = o.rows().select(*keys, "i", F.explode(out).alias("_v")) \
            .select(*keys, (F.col("i") * 3 + F.col("_v.k")).alias("i"), F.col("_v.lat").alias("lat"), F.col("_v.lng").alias("lng"))
    return rows


def simplify(lines: DataFrame, keys: list[str], tolerance: float = 2.5 * 9e-6, limit: int = LINE_ROWS) -> DataFrame:
    """Douglas-Peucker on vertex rows (keys, i, lat, lng): vertices that deviate more than ``tolerance`` degrees stay.

    Lines that fit a task are walked there; longer ones are refined in rounds.
    """
    rows = lines.select(*keys, F.col("i").cast("long").alias("i"), "lat", "lng")
    small, large = split_groups(rows, keys, limit)

    # lines are mostly short, so a task walks all that a batch of sorted rows holds; its last line may go on in the next batch
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            lines = pdf.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
            done = int(np.flatnonzero(lines == lines[-1])[0]) if len(pdf) else 0
            held = pdf[done:]
            yield kept_of(pdf[:done], lines[:done])
        if held is not None:
            yield kept_of(held, np.zeros(len(held)))

    def kept_of(pdf: pd.DataFrame, lines: np.ndarray) -> pd.DataFrame:
        return pdf[kernels.deviating_lines(pdf["lat"].to_numpy(), pdf["lng"].to_numpy(), lines, tolerance)] if len(pdf) else pdf

    kept = spread(small, *keys).sortWithinPartitions(*keys, "i").mapInPandas(walk, rows.schema)
    return kept if large is None else kept.unionByName(_simplify_in_rounds(large, keys, tolerance))


def _simplify_in_rounds(rows: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Every open interval of every line is split at its farthest vertex in the same round, so the
    number of rounds is the depth of the deepest line."""
    ends = rows.groupBy(*keys).agg(F.min("i").alias("lo"), F.max("i").alias("hi"))
    kept = cut(ends.select(*keys, F.explode(F.array("lo", "hi")).alias("i")).distinct())
    # each inner vertex carries the ends of the open interval it lies in
    at = lambda c, tag: rows.select(*keys, F.col("i").alias(c), F.col("lat").alias(f"{tag}y"), F.col("lng").alias(f"{tag}x"))
    inner = cut(rows.join(ends, keys).filter((F.col("i") > F.col("lo")) & (F.col("i") < F.col("hi")))
                .join(at("lo", "a"), [*keys, "lo"]).join(at("hi", "b"), [*keys, "hi"]))
    while not inner.isEmpty():
        d = geo.point_segment("lng", "lat", "ax", "ay", "bx", "by")
        far = inner.withColumn("_d", d * d).groupBy(*keys, "lo", "hi").agg(
            F.max_by(F.struct(F.col("i").alias("mid"), F.col("lat").alias("my"), F.col("lng").alias("mx")),
                     F.struct(F.col("_d"), (-F.col("i")).alias("r"))).alias("_m"), F.max("_d").alias("_d")) \
            .filter(F.col("_d") > tolerance * tolerance).select(*keys, "lo", "hi", "_m.*")
        far = cut(far)
        kept = kept.unionByName(far.select(*keys, F.col("mid").alias("i")))
        left = F.col("i") < F.col("mid")
        pick = lambda c, a, b: F.when(left, F.col(a)).otherwise(F.col(b)).alias(c)
        inner = cut(inner.join(far, [*keys, "lo", "hi"]).filter(F.col("i") != F.col("mid")).select(
            *keys, "i", "lat", "lng", pick("lo", "lo", "mid"), pick("hi", "mid", "hi"), pick("ay", "ay", "my"),
            pick("ax", "ax", "mx"), pick("by", "my", "by"), pick("bx", "mx", "bx")))
    return rows.join(kept.distinct(), [*keys, "i"], "left_semi")


def beautify(lines: DataFrame, keys: list[str], tolerance_m: float = 2.5) -> DataFrame:
    """Simplify, then smooth; ends keep their place."""
    return chaikin(cut(simplify(lines, keys, tolerance_m * 0.000009)), keys, 3, 12.0)
