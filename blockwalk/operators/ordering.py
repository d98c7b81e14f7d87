"""Census house order: blocks north-west to south-east, inside a block by clusters, rows or a loop.

An order is a set of sortable columns computed by joins and per-group
aggregates; one running sum per survey area at the end turns it into numbers.
No step needs a whole area in one place: see :class:`Ordered` for areas too
large for a task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockwalk.functions import domain, geo
from blockwalk.operators import assign, components, kernels, nearest
from blockwalk.operators.lineage import cut, spread
from blockwalk.operators.ordered import Ordered, any_hot, nth_values

SYSTEMS = ("serpentine", "census_u_loop", "boundary_serpentine")
ROW_DEGREES = 0.00009
#: Houses of one block ordered inside a task; a block is meant to hold 180.
GROUP_ROWS = 5_000
GROUP = ["hlb_id", "block_id", "cluster"]


# -------------------------------------------------------------- simple order

def simple_numbering(symbols: DataFrame) -> DataFrame:
    """House types numbered by 10 m rows north to south, each row west to east.

    Locked houses keep their number but use one up; other symbols are untouched.
    """
    house = domain.is_house(F.col("symbol_type"))
    north = symbols.filter(house).groupBy("hlb_id").agg(F.max("lat").alias("_north"))
    rows = symbols.filter(house).join(north, "hlb_id") \
        .withColumn("_row", F.floor((F.col("_north") - F.col("lat")) / ROW_DEGREES))
    numbered = Ordered.of(rows, ["hlb_id"], [F.col("_row"), F.col("lng"), F.col("pos"), F.col("id")], count_on=symbols) \
        .row_number("_n").rows()
    kept = F.when(F.col("number_locked"), F.col("number")).otherwise(F.col("_n"))
    return numbered.withColumn("number", kept).drop("_row", "_n", "_north") \
        .unionByName(symbols.filter(~house).withColumn("number", F.col("number").cast("long")))


# ------------------------------------------------------------- block labels

def label_blocks(blocks: DataFrame) -> DataFrame:
    """Letters A..Z, AA.. north to south, then west to east."""
    c = geo.vertex_mean(assign.block_ring())
    rows = blocks.withColumns({"_clat": c["lat"], "_clng": c["lng"]})
    ranked = Ordered.of(rows, ["hlb_id"], [F.desc("_clat"), F.col("_clng"), F.col("pos")]).row_number("_n").rows()
    return ranked.withColumn("label", domain.excel_label(F.col("_n") - 1)).drop("_clat", "_clng", "_n")


# ---------------------------------------------------------------- house order

def order_houses(symbols: DataFrame, blocks: DataFrame | None = None, system: str = "serpentine",
                 boundaries: DataFrame | None = None) -> DataFrame:
    """Numberable symbols with their place in the numbering path (``place``, from 1 per area).

    Without blocks, or for the boundary-wide system, each area is one block: its
    boundary ring where given, else the box of its houses.  Houses outside all
    blocks come last, north-west first.
    """
    if system not in SYSTEMS:
        raise ValueError(f"unknown numbering system {system!r}")
    houses = symbols.filter(domain.is_numberable(F.col("symbol_type")))
    # A whole area bounds each of its blocks and clusters, so one count covers every step below.
    largest = houses.groupBy("hlb_id").count().agg(F.max("count")).first()[0] or 0
    split = largest > GROUP_ROWS * 40
    if blocks is None or system == "boundary_serpentine":
        frames, placed = _area_frames(houses, boundaries if system == "boundary_serpentine" else None)
    else:
        frames = _frames(blocks)
        placed = assign.assign_blocks(houses, blocks)
    placed = cut(placed)  # read for frames, rows, orphans
    inside = placed.filter("block_id IS NOT NULL")
    no_first = F.when(F.lit(False), F.struct("pos", "id"))
    if system == "census_u_loop":
        within = _u_loop(inside.withColumn("cluster", F.lit(0).cast("long")), frames, split)
        within = within.withColumns({"_cscore": F.lit(0.0), "cluster": F.lit(0).cast("long"), "_cfirst": no_first})
    else:
        within = _cluster_order(inside, frames, split, largest)
    path = ["_a", "_b", "_c"]
    ranked = within.select("hlb_id", "id", "pos", "lat", "lng", "block_id", "cluster", F.lit(0).alias("_orphan"),
                           "block_score", "block_pos", "_cscore", "_cfirst", *path)
    nothing = {c: F.lit(0.0) for c in ("_cscore", "_a", "_b", "_c")}
    orphans = placed.filter("block_id IS NULL").select(
        "hlb_id", "id", "pos", "lat", "lng", "block_id", F.lit(None).cast("long").alias("cluster"), F.lit(1).alias("_orphan"),
        geo.nwse_score("lat", "lng").alias("block_score"), F.lit(0).cast(ranked.schema["block_pos"].dataType).alias("block_pos"),
        *[v.alias(c) for c, v in nothing.items()], no_first.alias("_cfirst"))
    order = [F.col(c) for c in ("_orphan", "block_score", "block_pos", "_cscore", "_cfirst", "cluster", *path, "pos", "id")]
    rows = ranked.unionByName(orphans)
    final = Ordered.of(rows, ["hlb_id"], order) if split else Ordered(rows, ("hlb_id",), tuple(order))
    return final.row_number("place").rows().select("hlb_id", "id", "pos", "lat", "lng", "block_id", "cluster", "place")


def running_numbers(symbols: DataFrame, order: DataFrame, system: str = "serpentine", compat_coincident: bool = False) -> DataFrame:
    """Symbols with their census number: units count on the serpentine, houses on the loop.

    Symbols that are not numbered keep what they have.  ``compat_coincident`` gives
    houses at one position (7 decimals) a single number, as matching by coordinate does.
    """
    step = F.lit(1) if system == "census_u_loop" else domain.unit_count(F.col("symbol_type"), F.col("unit_count"))
    rows = order.select("hlb_id", "id", "place", "lat", "lng") \
        .join(symbols.select("hlb_id", "id", step.cast("long").alias("_step")), ["hlb_id", "id"])
    if compat_coincident:
        spot = ["hlb_id", F.round("lat", 7).alias("_y"), F.round("lng", 7).alias("_x")]
        first = rows.groupBy(*spot).agg(F.min_by("id", "id").alias("id"), F.min("place").alias("_at"))
        rows = first.select("hlb_id", "id", F.col("_at").alias("place")).join(rows.drop("place"), ["hlb_id", "id"])
    before = Ordered.of(rows, ["hlb_id"], [F.col("place")], count_on=symbols).running(exclusive=True, _before="_step").rows()
    numbers = before.select("hlb_id", "id", (F.col("_before") + 1).cast("long").alias("_number"))
    fresh = F.when(domain.is_numberable(F.col("symbol_type")), F.col("_number")).otherwise(F.col("number"))
    return symbols.join(numbers, ["hlb_id", "id"], "left").withColumn("number", fresh).drop("_number")


def _frames(blocks: DataFrame) -> DataFrame:
    """Local frame of each block: centre and angle of the longest edge."""
    c = assign.block_centre()
    return blocks.select("hlb_id", "block_id", c["lat"].alias("clat"), c["lng"].alias("clng"),
                         geo.longest_edge_angle(assign.block_ring()).alias("theta"))


def _area_frames(houses: DataFrame, boundaries: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    box = houses.groupBy("hlb_id").agg(F.min("lat").alias("south"), F.max("lat").alias("north"),
                                       F.min("lng").alias("west"), F.max("lng").alias("east"))
    if boundaries is not None:
        box = box.join(boundaries.select("hlb_id", F.col("ring").alias("points")), "hlb_id", "left")
    else:
        box = box.withColumn("points", F.lit(None).cast("array<struct<lat:double,lng:double>>"))
    whole = box.withColumns({"block_id": F.lit(0).cast("long"), "pos": F.lit(0).cast("long")})
    placed = houses.select("hlb_id", "id", "lat", "lng", "pos", F.lit(0).cast("long").alias("block_id"),
                           F.lit(0.0).alias("block_score"), F.lit(0).cast("long").alias("block_pos"))
    return _frames(whole), placed


def _local(rows: DataFrame, frames: DataFrame) -> DataFrame:
    u, v = geo.to_frame("lat", "lng", "clat", "clng", "theta")
    return rows.join(frames, ["hlb_id", "block_id"]).withColumns({"u": u, "v": v})


def _score_at(u: Column, v: Column) -> Column:
    return geo.nwse_score(*geo.from_frame(u, v, "clat", "clng", "theta"))


# ------------------------------------------------------------------- u-loop

def _u_loop(rows: DataFrame, frames: DataFrame, split: bool) -> DataFrame:
    """Out along one side of the block and back along the other, from its north-west corner."""
    keys = ["hlb_id", "block_id"]
    local = _local(rows, frames)
    ordered = Ordered.of(local, keys, [F.col("v"), F.col("id")]) if split else \
        Ordered(local, tuple(keys), (F.col("v"), F.col("id")))
    middle = nth_values(ordered, "v", F.floor(F.col("n") / 2) + 1, "_mid")
    span = local.groupBy(*keys).agg(
        F.min("u").alias("u0"), F.max("u").alias("u1"), F.min("v").alias("v0"), F.max("v").alias("v1"),
        *[F.first(c).alias(c) for c in ("clat", "clng", "theta")])
    corners = F.array(*[F.struct(_score_at(F.col(u), F.col(v)).alias("score"), F.lit(i).alias("corner"))
                        for i, (u, v) in enumerate((("u0", "v0"), ("u1", "v0"), ("u1", "v1"), ("u0", "v1")))])
    start = span.select(*keys, F.array_min(corners)["corner"].alias("corner")).join(middle, keys)
    near_side = F.when(F.col("corner") < 2, F.col("v") < F.col("_mid")).otherwise(F.col("v") >= F.col("_mid"))
    out_ascending = F.col("corner").isin(0, 3)
    ascending = near_side == out_ascending
    return local.join(start, keys).withColumns({
        "_a": F.when(near_side, 0.0).otherwise(1.0), "_b": F.when(ascending, F.col("u")).otherwise(-F.col("u")),
        "_c": F.lit(0.0)})


# --------------------------------------------------------------- serpentine

def _serpentine(rows: DataFrame, frames: DataFrame, split: bool) -> DataFrame:
    """Rows across the longest edge, walked in alternating directions from the north-west.

    Adds the sort columns _a (row, signed by direction) and _b (place in the row).
    """
    local = _local(rows, frames)
    by_v = (F.col("v"), F.col("id"))
    ordered = Ordered.of(local, GROUP, by_v) if split else Ordered(local, tuple(GROUP), by_v)
    gaps = ordered.lag(_prev="v").rows().withColumn("_gap", F.col("v") - F.col("_prev")).filter(F.col("_gap") > 0.1)
    # the middle gap in order along v, not the median gap
    gap_rows = Ordered.of(gaps, GROUP, by_v) if split else Ordered(gaps, tuple(GROUP), by_v)
    middle = nth_values(gap_rows, "_gap", F.floor(F.col("n") / 2) + 1, "_mid")
    span = local.groupBy(*GROUP).agg(F.min("v").alias("v0"), F.max("v").alias("v1"),
                                     *[F.first(c).alias(c) for c in ("clat", "clng", "theta")])
    height = F.coalesce(F.greatest(F.lit(2.0), F.col("_mid") * 1.5), F.lit(3.0))
    grid = span.join(middle, GROUP, "left").select(
        *GROUP, "v0", height.alias("row_height"),
        (_score_at(F.lit(0.0), F.col("v0")) <= _score_at(F.lit(0.0), F.col("v1"))).alias("up"))
    rows_at = local.join(grid, GROUP).withColumn("_row", domain.js_round((F.col("v") - F.col("v0")) / F.col("row_height"))) \
        .withColumn("_a", F.when(F.col("up"), F.col("_row")).otherwise(-F.col("_row")).cast("double"))
    # one line per occupied row: its rank gives the direction, the first row gives the start
    lines = rows_at.groupBy(*GROUP, "_a").agg(F.min("u").alias("_u0"), F.max("u").alias("_u1"), F.avg("v").alias("_va"),
                                              *[F.first(c).alias(c) for c in ("clat", "clng", "theta")])
    east_first = _score_at(F.col("_u0"), F.col("_va")) <= _score_at(F.col("_u1"), F.col("_va"))
    first = lines.groupBy(*GROUP).agg(F.min_by(east_first, F.col("_a")).alias("_asc"))
    w = Window.partitionBy(*GROUP).orderBy("_a")
    turns = lines.select(*GROUP, "_a", F.row_number().over(w).alias("_line")).join(first, GROUP) \
        .select(*GROUP, "_a", ((F.col("_line") % 2 == 1) == F.col("_asc")).alias("_forward"))
    return rows_at.join(turns, [*GROUP, "_a"]).withColumns({
        "_b": F.when(F.col("_forward"), F.col("u")).otherwise(-F.col("u")), "_c": F.lit(0.0)})


def serpentine_in_block(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Plain serpentine of every block, without clusters: (hlb_id, block_id, id, place)."""
    placed = cut(assign.assign_blocks(rows, blocks).filter("block_id IS NOT NULL").withColumn("cluster", F.lit(0).cast("long")))
    split = any_hot(rows, ["hlb_id"], GROUP_ROWS * 40)
    walked = _serpentine(placed, _frames(blocks), split)
    order = [F.col(c) for c in ("_a", "_b", "pos", "id")]
    keys = ["hlb_id", "block_id"]
    ordered = Ordered.of(walked, keys, order) if split else Ordered(walked, tuple(keys), tuple(order))
    return ordered.row_number("place").rows().select(*keys, "id", "place")


# ------------------------------------------------------------ cluster order

CLUSTERED = "cluster long, size long, regular boolean, step long"


def cluster_blocks(inside: DataFrame, limit: int = GROUP_ROWS, largest: int | None = None) -> DataFrame:
    """Cluster of every house of a block, whether it looks like rows, and the walk through it if not.

    The link radius is 1.4 times the block's median nearest gap; clusters under
    three houses fall apart into single houses.  A block of at most three houses
    keeps its input order.  Blocks that fit a task are worked out there; larger
    ones use the cell-based distance and cluster jobs, and only the walk through
    one irregular cluster remains a single task.  ``largest`` is a known bound on a
    block's houses.
    """
    rows = inside.select("hlb_id", "block_id", "id", "pos", "lat", "lng", "block_score", "block_pos")
    keys = ["hlb_id", "block_id"]
    known = largest is not None and largest <= limit
    small, large = (rows, None) if known else nearest.split_groups(rows, keys, limit)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", " + CLUSTERED
    out = spread(small, *keys).groupBy(*keys).applyInPandas(_cluster_block, schema)
    return out if large is None else out.unionByName(_cluster_large(large, keys, schema))


def _walk(lat: np.ndarray, lng: np.ndarray) -> np.ndarray:
    """Step of each house on the walk from the most north-western one (the last of equals)."""
    score = -lat + lng
    start = int(np.nonzero(score == score.min())[0][-1])
    path = kernels.walk_order(lat, lng, start)
    step = np.empty(len(lat), dtype=np.int64)
    step[path] = np.arange(len(lat))
    return step


def _cluster_block(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["pos", "id"], kind="stable").reset_index(drop=True)
    n, lat, lng = len(pdf), pdf["lat"].to_numpy(), pdf["lng"].to_numpy()
    if n <= 3:
        return pdf.assign(cluster=0, size=n, regular=False, step=np.arange(n))
    median = np.sort(kernels.nearest_gaps(lat, lng))[n // 2] or 10.0
    label = kernels.single_link(lat * 111320.0, lng * 111320.0, median * 1.4)
    count = np.bincount(label, minlength=n)
    label = np.where(count[label] < 3, np.arange(n), label)
    size, regular, step = np.bincount(label, minlength=n)[label], np.ones(n, bool), np.zeros(n, np.int64)
    for c in np.unique(label[size >= 4]):
        members = np.nonzero(label == c)[0]
        gaps = kernels.nearest_gaps(lat[members], lng[members])
        mean = gaps.mean()
        if mean != 0 and gaps.std() / mean >= 0.35:
            regular[members] = False
            step[members] = _walk(lat[members], lng[members])
    return pdf.assign(cluster=label, size=size, regular=regular, step=step)


def _cluster_large(rows: DataFrame, keys: Sequence[str], schema: str) -> DataFrame:
    rows = cut(rows)
    median = nearest.median_gap(nearest.nearest_gaps(rows, keys), keys, split=True)
    scaled = rows.join(median, list(keys)).withColumns({
        # unit radius per block, so that one radius serves all blocks
        "y": F.col("lat") * geo.METRES_PER_DEGREE / (F.col("median_gap") * 1.4),
        "x": F.col("lng") * geo.METRES_PER_DEGREE / (F.col("median_gap") * 1.4)})
    linked = cut(components.clusters(scaled.select(*keys, "id", "y", "x"), keys, 1.0, 3).select(*keys, "id", "cluster", "size"))
    rows = rows.join(linked, [*keys, "id"])
    shape = nearest.regularity(nearest.nearest_gaps(rows, GROUP), GROUP).select(*GROUP, F.col("looks_like_rows").alias("regular"))
    known = rows.join(shape, GROUP).withColumn("step", F.lit(0).cast("long"))
    names = [f.split("` ")[0].strip("` ") if f.startswith("`") else f.split()[0] for f in schema.split(", ")]

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pos", "id"], kind="stable")
        return pdf.assign(step=_walk(pdf["lat"].to_numpy(), pdf["lng"].to_numpy()))

    known = known.select(*names)
    walked = known.filter(~F.col("regular")).groupBy(*GROUP).applyInPandas(walk, schema)
    return known.filter("regular").unionByName(walked)


def _cluster_order(inside: DataFrame, frames: DataFrame, split: bool, largest: int) -> DataFrame:
    """Clusters north-west first; rows inside regular ones, a short walk inside the others."""
    clustered = cut(cluster_blocks(inside, largest=largest))  # read several times below
    # equal scores (to a tenth of a millimetre, so that the order of a sum decides nothing) go by the cluster's first house in input order
    centre = clustered.groupBy(*GROUP).agg(F.round(geo.nwse_score(F.avg("lat"), F.avg("lng")), 9).alias("_cscore"),
                                           F.min(F.struct("pos", "id")).alias("_cfirst"))
    rows = clustered.join(centre, GROUP)
    keep = ["hlb_id", "id", "pos", "lat", "lng", "block_id", "cluster", "block_score", "block_pos", "_cscore", "_cfirst", "_a", "_b", "_c"]
    in_rows = _serpentine(rows.filter("regular"), frames, split).select(*keep)
    walked = rows.filter(~F.col("regular")).withColumns({"_a": F.col("step").cast("double"), "_b": F.lit(0.0), "_c": F.lit(0.0)})
    return in_rows.unionByName(walked.select(*keep))


# --------------------------------------------------------- along the path

def path_hops(order: DataFrame) -> DataFrame:
    """Each step of the path: end points, length, bearing and middle."""
    rows = Ordered.of(order, ["hlb_id"], [F.col("place")]).lead(lat2="lat", lng2="lng", block2="block_id").rows()
    return rows.filter("lat2 IS NOT NULL").withColumns({
        "hop_m": geo.haversine_m("lat", "lng", "lat2", "lng2"), "bearing": geo.bearing_deg("lat", "lng", "lat2", "lng2"),
        "mid_lat": (F.col("lat") + F.col("lat2")) / 2, "mid_lng": (F.col("lng") + F.col("lng2")) / 2})


def path_ends(order: DataFrame) -> DataFrame:
    """START and END badges of every path."""
    return order.groupBy("hlb_id").agg(F.min_by("id", "place").alias("start_id"), F.max_by("id", "place").alias("end_id"))


def arrow_thinning(houses: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Houses per hectare, and whether arrows are thinned (over 60 per hectare or over 60 houses)."""
    n = houses.filter(domain.is_numberable(F.col("symbol_type"))).groupBy("hlb_id").agg(F.count(F.lit(1)).alias("houses"))
    area = boundaries.select("hlb_id", geo.ring_area_m2(F.col("ring")).alias("_area"))
    per = F.when(F.col("_area") > 0, F.col("houses") / (F.col("_area") / 10000)).otherwise(0.0)
    return n.join(area, "hlb_id", "left").select("hlb_id", "houses", F.coalesce(per, F.lit(0.0)).alias("per_hectare"),
                                                (F.coalesce(per > 60, F.lit(False)) | (F.col("houses") > 60)).alias("thin_arrows"))


def path_annotations(order: DataFrame, median: DataFrame, thinning: DataFrame) -> DataFrame:
    """Per step: block jump, turn, cluster start, and whether its arrow is drawn.

    ``median``: hlb_id, median_gap.  A jump changes block or is longer than 2.2
    median gaps; a turn changes heading by more than 0.66 rad since the last step
    of the same run; headings start afresh after a jump.
    """
    hops = path_hops(order).join(median, "hlb_id").join(thinning.select("hlb_id", "thin_arrows"), "hlb_id")
    same = F.col("block_id").eqNullSafe(F.col("block2"))
    k = F.cos(F.radians("lat"))
    hops = hops.withColumns({
        "is_jump": ~same | (F.col("hop_m") > F.col("median_gap") * 2.2),
        "_heading": F.atan2(-(F.col("lat2") - F.col("lat")), (F.col("lng2") - F.col("lng")) * k)})
    rows = Ordered.of(hops, ["hlb_id"], [F.col("place")], count_on=order).lag(_jump="is_jump", _before="_heading").rows()
    d = F.abs(F.col("_heading") - F.col("_before"))
    d = F.when(d > np.pi, 2 * np.pi - d).otherwise(d)
    run = ~F.col("is_jump") & ~F.coalesce("_jump", F.lit(True))
    return rows.withColumns({"is_turn": F.coalesce(run & (d > 0.66), F.lit(False)),
                             "cluster_start": F.coalesce("_jump", F.lit(True))}) \
        .withColumn("draw", ~F.col("thin_arrows") | F.col("is_jump") | F.col("is_turn") | F.col("cluster_start")) \
        .select("hlb_id", "id", "place", "is_jump", "is_turn", "cluster_start", "draw")


def next_unnumbered(order: DataFrame, symbols: DataFrame) -> DataFrame:
    """First unnumbered house on the path of every area."""
    open_ = symbols.filter(domain.is_house(F.col("symbol_type")) & F.col("number").isNull()).select("hlb_id", "id")
    return order.join(open_, ["hlb_id", "id"], "left_semi").groupBy("hlb_id").agg(F.min_by("id", "place").alias("next_id"))


def next_free_number(symbols: DataFrame, last: DataFrame) -> DataFrame:
    """Smallest unused number from ``last`` (hlb_id, start) on.

    The used numbers from the start form runs; the answer follows the first run,
    or is the start itself when that is free.
    """
    used = symbols.filter("number IS NOT NULL").select("hlb_id", F.col("number").cast("long").alias("n")).distinct() \
        .join(last, "hlb_id").filter(F.col("n") >= F.col("start"))
    # value - rank is constant inside a run; the first run starts at `start` with rank 1
    ranked = Ordered.of(used, ["hlb_id"], [F.col("n")], count_on=symbols).row_number("_r").rows()
    first = ranked.filter(F.col("n") - F.col("start") + 1 == F.col("_r")).groupBy("hlb_id").agg(F.max("n").alias("_last"))
    return last.join(first, "hlb_id", "left").select("hlb_id", F.coalesce(F.col("_last") + 1, F.col("start")).alias("next_number"))


def dense_insets(symbols: DataFrame, boundaries: DataFrame, least: int = 12, share: float = 0.03) -> DataFrame:
    """Clusters of at least ``least`` houses linked within 3 % of the area's span, with their boxes."""
    houses = symbols.filter(domain.is_numberable(F.col("symbol_type")))
    box = boundaries.select("hlb_id", geo.ring_bbox(F.col("ring")).alias("_b"))
    span = F.greatest(F.col("_b.north") - F.col("_b.south"), F.col("_b.east") - F.col("_b.west"))
    # distances in units of the area's own radius, so that one radius serves all areas
    points = houses.join(box, "hlb_id").withColumn("_u", span * share) \
        .select("hlb_id", "id", (F.col("lat") / F.col("_u")).alias("y"), (F.col("lng") / F.col("_u")).alias("x"))
    found = components.clusters(points, ["hlb_id"], 1.0, least).filter(F.col("size") >= least)
    return found.join(houses.select("hlb_id", "id", "lat", "lng"), ["hlb_id", "id"]).groupBy("hlb_id", "cluster").agg(
        F.count(F.lit(1)).alias("members"), F.min("lat").alias("south"), F.max("lat").alias("north"),
        F.min("lng").alias("west"), F.max("lng").alias("east"))
