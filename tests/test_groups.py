"""Grouped and iterative operators: golden cases, and large-group paths against sequential references."""

import math
import random

import pytest
from conftest import ring
from pyspark.sql import functions as F

from blockwalk.functions import geo
from blockwalk.operators import components, conflate, folds, layout, nearest, ordering, register, thin
from blockwalk.operators.ordered import Ordered

RING = "array<struct<lat:double,lng:double>>"


def scatter(n, seed, groups=2, spread=0.002, copies=0.3):
    rnd = random.Random(seed)
    rows, seen = [], []
    for i in range(n):
        if seen and rnd.random() < copies:
            y, x = rnd.choice(seen)
        else:
            y, x = 26 + rnd.random() * spread, 80 + rnd.random() * spread
            seen.append((y, x))
        rows.append((i % groups, i, y, x, rnd.random(), rnd.choice(["osm", "google", "microsoft"])))
    return rows


SCHEMA = "hlb_id long, id long, lat double, lng double, confidence double, source string"


@pytest.mark.parametrize("limit", [3, 100_000])
def test_ordered_matches_plain_windows(spark, limit):
    df = spark.createDataFrame([(i % 3, (i * 37) % 101, i) for i in range(400)], "k int, o int, id int")
    o = Ordered.of(df, ["k"], [F.col("o"), F.col("id")], limit).row_number("n")
    o = o.frame(before=2, after=1, before2=lambda w: F.lag("id", 2).over(w), next=lambda w: F.lead("id").over(w)) if limit > 3 else \
        o.frame(before=2, after=1, before2=lambda w: F.lag("id", 2).over(w), next=lambda w: F.lead("id").over(w))
    got = {(r["k"], r["n"]): r for r in o.running(total="id").running(exclusive=True, prior="id").rows().collect()}
    for k in range(3):
        rows = sorted((r for r in df.collect() if r["k"] == k), key=lambda r: (r["o"], r["id"]))
        total = 0
        for n, r in enumerate(rows, 1):
            g = got[(k, n)]
            assert g["id"] == r["id"] and g["prior"] == total
            total += r["id"]
            assert g["total"] == total
            assert g["before2"] == (rows[n - 3]["id"] if n > 2 else None)
            assert g["next"] == (rows[n]["id"] if n < len(rows) else None)
    assert len(got) == 400


@pytest.mark.parametrize("limit", [10, 100_000])
@pytest.mark.parametrize("metric,radius", [("degrees", 0.0002), ("metres", 25.0)])
def test_greedy_thin(spark, limit, metric, radius):
    rows = scatter(220, 5)
    near = (lambda a, b: math.hypot(a[2] - b[2], a[3] - b[3]) < radius) if metric == "degrees" else \
        (lambda a, b: folds.metres(a[2], a[3], b[2], b[3]) < radius)
    want = set()
    for g in (0, 1):
        kept = []
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[4], r[1])):
            if not any(near(r, k) for k in kept):
                kept.append(r)
        want |= {(g, r[1]) for r in kept}
    df = spark.createDataFrame(rows, SCHEMA)
    got = thin.greedy_thin(df, ["hlb_id"], [-F.col("confidence"), F.col("id")], radius, metric, limit=limit)
    assert {(r["hlb_id"], r["id"]) for r in got.collect()} == want


@pytest.mark.parametrize("limit", [10, 100_000])
def test_thin_with_fixed_rows(spark, limit):
    rows = scatter(120, 8)
    kept = {0: [], 1: []}
    for r in sorted(rows, key=lambda r: (not r[1] % 5 == 0, r[1])):
        fixed = r[1] % 5 == 0
        if fixed or not any(folds.metres(r[2], r[3], k[2], k[3]) < 25 for k in kept[r[0]]):
            kept[r[0]].append(r)
    got = thin.greedy_thin(spark.createDataFrame(rows, SCHEMA), ["hlb_id"], [F.col("id")], 25.0, "metres",
                           fixed=F.col("id") % 5 == 0, limit=limit)
    assert {r["id"] for r in got.collect()} == {r[1] for g in kept.values() for r in g}


@pytest.mark.parametrize(("tile_rows", "line"), [(100_000, 600), (12, 10)])
def test_thinning_rounds_follow_tiles(spark, monkeypatch, tile_rows, line):
    """A line of rows in order of priority is one long chain; its rounds are those of the tiles that it crosses."""
    monkeypatch.setattr(thin, "TILE_ROWS", tile_rows)
    rows = [(0, i, 26.0 + i * 6e-5, 80.0, 1.0, "a") for i in range(line)] + [(0, 1000 + i, 26.01, 80.0 + i * 1e-7, 1.0, "a") for i in range(20)]
    want, last = set(), []
    for r in rows:
        if not any(math.hypot(r[2] - k[2], r[3] - k[3]) < 1.35e-4 for k in last):
            last.append(r)
            want.add(r[1])
    seen = []
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["id"] for r in thin.greedy_thin(df, ["hlb_id"], [F.col("id")], 1.35e-4, limit=10, rounds=seen).collect()}
    assert got == want
    tiles = 600 * 6e-5 / (thin.TILE * 0.999 * 1.35e-4 / 2 ** 0.5)
    if tile_rows == 100_000:
        assert len(seen) <= tiles + 2 < len(want) / 20


def _labels(points, radius):
    parent = list(range(len(points)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(points)):
        for j in range(i):
            if (points[i][0] - points[j][0]) ** 2 + (points[i][1] - points[j][1]) ** 2 <= radius * radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(points))]


@pytest.mark.parametrize("limit", [10, 100_000])
def test_single_link(spark, limit):
    rnd = random.Random(11)
    pts = [(rnd.random() * 40, rnd.random() * 40) for _ in range(160)]
    pts += pts[:40]  # copies
    df = spark.createDataFrame([(1, i, y, x) for i, (y, x) in enumerate(pts)], "hlb_id int, id long, y double, x double")
    got = {r["id"]: r["component"] for r in components.single_link(df, ["hlb_id"], 2.5, limit).collect()}
    assert [got[i] for i in range(len(pts))] == _labels(pts, 2.5)


def test_cluster_golden(spark):
    near = [(0.0, 0.0), (0.5, 0.0), (1.0, 0.5), (0.2, 0.8), (0.9, 0.9), (100.0, 100.0)]
    df = spark.createDataFrame([(1, i, y, x) for i, (y, x) in enumerate(near)], "k int, id long, y double, x double")
    sizes = sorted(r["size"] for r in components.clusters(df, ["k"], 2.0, 5).groupBy("cluster").agg(F.first("size").alias("size")).collect())
    assert sizes == [1, 5]
    two = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 0.0, 1.0)], "k int, id long, y double, x double")
    assert components.clusters(two, ["k"], 2.0, 5).select("cluster").distinct().count() == 2


@pytest.mark.parametrize("limit", [10, 100_000])
def test_nearest_gaps(spark, limit):
    rows = scatter(150, 3)
    df = spark.createDataFrame(rows + [(9, 999, 26.0, 80.0, 0.0, "osm")], SCHEMA)
    got = {r["id"]: r["gap"] for r in nearest.nearest_gaps(df, ["hlb_id"], limit).collect()}
    for r in rows:
        k = 111320.0
        want = min(math.hypot((q[3] - r[3]) * k * math.cos(math.radians((q[2] + r[2]) / 2)), (q[2] - r[2]) * k)
                   for q in rows if q[0] == r[0] and q[1] != r[1])
        assert got[r[1]] == pytest.approx(want, abs=1e-9)
    assert got[999] is None
    med = {r["hlb_id"]: r["median_gap"] for r in nearest.median_gap(nearest.nearest_gaps(df, ["hlb_id"]), ["hlb_id"]).collect()}
    assert med[9] == 10.0


def _conflate(rows):
    pref = {"osm": 0, "google": 1, "microsoft": 2}
    clusters = []
    for r in sorted(rows, key=lambda r: (pref[r[5]], r[1])):
        for c in clusters:
            if r[5] not in c[1] and abs(c[0][2] - r[2]) < 3.6e-5 and abs(c[0][3] - r[3]) < 3.6e-5:
                c[1].add(r[5])
                break
        else:
            clusters.append((r, {r[5]}))
    return {c[0][1] for c in clusters}


@pytest.mark.parametrize("limit", [8, 100_000])
def test_conflate_equals_sequential(spark, limit):
    rows = scatter(260, 21, spread=0.0006, copies=0.5)
    rows += [(5, 1000 + i, 26.5, 80.5, 0.0, s) for i, s in enumerate(["osm"] * 3 + ["google"] * 9 + ["microsoft"] * 12)]
    want = set()
    for g in {r[0] for r in rows}:
        want |= _conflate([r for r in rows if r[0] == g])
    got = conflate.conflate(spark.createDataFrame(rows, SCHEMA), limit=limit)
    assert {r["id"] for r in got.collect()} == want


@pytest.mark.parametrize("sources,want", [
    ([("osm", 0.0), ("google", 0.01)], ["google", "osm"]), ([("osm", 0.0), ("google", 1e-5)], ["osm"]),
    ([("osm", 0.0), ("osm", 1e-5)], ["osm", "osm"]), ([("microsoft", 0.0), ("google", 1e-5), ("osm", 5e-6)], ["osm"]),
    ([("microsoft", 0.0), ("microsoft", 1e-5), ("microsoft", 2e-5), ("osm", 1e-5)], ["microsoft", "microsoft", "osm"])])
def test_conflate_golden(spark, sources, want):
    rows = [(1, i, 26.0 + d, 80.0, 0.0, s) for i, (s, d) in enumerate(sources)]
    assert sorted(r["source"] for r in conflate.conflate(spark.createDataFrame(rows, SCHEMA)).collect()) == want


# ------------------------------------------------------------------ folds

def fixes(n, sessions=2, seed=1):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        s = i % sessions
        out.append((s, i, i, 26 + i * 1e-5 + rnd.random() * 1e-5, 80 + rnd.random() * 2e-5, rnd.choice([0.0, 5.0, 12.0, 40.0, None]), rnd.random() * 5))
    return out


FIX = "session_id long, point_id long, ts long, lat double, lng double, accuracy double, speed double"


@pytest.mark.parametrize("limit", [7, 100_000])
def test_kalman_equals_sequential(spark, limit):
    rows = fixes(120)
    got = {r["point_id"]: (r["lat"], r["lng"]) for r in folds.kalman(spark.createDataFrame(rows, FIX), ["session_id"], ["ts", "point_id"], limit).collect()}
    for s in (0, 1):
        p, xs = 1.0, [0.0, 0.0]
        for r in (r for r in rows if r[0] == s):
            p += 0.0005
            noise = r[5] ** 2 / 10 if r[5] else 0.0005
            g = p / (p + noise)
            xs = [m if x == 0 else x + g * (m - x) for x, m in zip(xs, r[3:5])]
            p *= 1 - g
            assert got[r[1]] == pytest.approx(tuple(xs), abs=1e-11)


@pytest.mark.parametrize("limit", [7, 100_000])
def test_thin_path_equals_sequential(spark, limit):
    rows = fixes(200, seed=4)
    df = spark.createDataFrame(rows, FIX).withColumns({"out_lat": F.col("lat") + 1e-6, "out_lng": F.col("lng")})
    want = set()
    for s in (0, 1):
        last = None
        for r in (r for r in rows if r[0] == s):
            if last is None or not folds.metres(*last, r[3], r[4]) < 3.0:
                want.add(r[1])
                last = (r[3] + 1e-6, r[4])
    got = folds.thin_path(df, ["session_id"], ["ts", "point_id"], 3.0, limit)
    assert {r["point_id"] for r in got.collect()} == want


@pytest.mark.parametrize("limit", [4, 100_000])
def test_carry_forward(spark, limit):
    df = spark.createDataFrame([(1, i, i if i % 5 == 2 else None) for i in range(23)], "k int, i int, v int")
    got = {r["i"]: r["v"] for r in folds.carry_forward(df, ["k"], ["i"], ["v"], limit).collect()}
    last = None
    for i in range(23):
        last = i if i % 5 == 2 else last
        assert got[i] == last


# ---------------------------------------------------------------- ordering

def symbols(spark, rows):
    base = [(1, i, i, kind, lat, lng, num, units) for i, (kind, lat, lng, num, units) in enumerate(rows)]
    df = spark.createDataFrame(base, "hlb_id long, id long, pos long, symbol_type string, lat double, lng double, number int, unit_count int")
    return df.withColumns({"number_locked": F.lit(False), "is_residential": F.lit(None).cast("boolean"), "sub_number": F.lit(None).cast("string")})


def blocks(spark, boxes):
    return spark.createDataFrame([(1, i, i, s, w, n, e, None) for i, (s, w, n, e) in enumerate(boxes)],
                                 f"hlb_id long, block_id long, pos long, south double, west double, north double, east double, points {RING}")


def test_block_order_nw_first(spark):
    s = symbols(spark, [("pucca_house", 26.0005, 80.0095, None, None), ("pucca_house", 26.0095, 80.0005, None, None)])
    b = blocks(spark, [(26.0, 80.005, 26.005, 80.01), (26.005, 80.0, 26.01, 80.005)])
    assert [r["id"] for r in ordering.order_houses(s, b).orderBy("place").collect()] == [1, 0]


def test_u_loop_corners(spark):
    corners = [(26.4501, 80.3311), (26.4501, 80.3315), (26.4499, 80.3315), (26.4499, 80.3311)]
    s = symbols(spark, [("pucca_house", y, x, None, None) for y, x in corners])
    b = blocks(spark, [(26.4498, 80.331, 26.4502, 80.3316)])
    assert [r["id"] for r in ordering.order_houses(s, b, "census_u_loop").orderBy("place").collect()] == [0, 1, 2, 3]


def test_register_golden(spark):
    s = symbols(spark, [("pucca_house", 26.0, 80.0, 1, None), ("apartment", 26.0, 80.0, 2, 3), ("kutcha_house", 26.0, 80.0, 5, None)])
    for loop, want in ((True, ["1", "2(1)", "2(2)", "2(3)", "5"]), (False, ["1", "2", "3", "4", "5"])):
        rows = register.register_rows(s, loop).orderBy("col_1_line_no").collect()
        assert [r["col_3_house_no"] for r in rows] == want
        assert [r["col_1_line_no"] for r in rows] == [1, 2, 3, 4, 5]


def test_numbers_leave_unit_gaps(spark):
    s = symbols(spark, [("apartment", 26.0 + i * 1e-4, 80.0, None, 3) if i % 2 else ("pucca_house", 26.0 + i * 1e-4, 80.0, None, None) for i in range(9)]
                + [("well", 26.0, 80.0, 77, None)])
    order = ordering.order_houses(s)
    rows = ordering.running_numbers(s, order).join(order.select("id", "place"), "id", "left").orderBy("place").collect()
    nums = [(r["number"], 3 if r["symbol_type"] == "apartment" else 1) for r in rows if r["place"] is not None]
    want, n = [], 1
    for _, u in nums:
        want.append(n)
        n += u
    assert [a for a, _ in nums] == want
    assert [r["number"] for r in rows if r["symbol_type"] == "well"] == [77]


def test_coincident_houses(spark):
    s = symbols(spark, [("pucca_house", 26.0, 80.0, None, None), ("pucca_house", 26.0, 80.0, None, None), ("pucca_house", 26.001, 80.001, None, None)])
    order = ordering.order_houses(s)
    assert sorted(r["number"] for r in ordering.running_numbers(s, order).collect()) == [1, 2, 3]
    compat = ordering.running_numbers(s, order, compat_coincident=True).collect()
    assert sorted((r["number"] is None, r["number"]) for r in compat)[-1] == (True, None) and len([r for r in compat if r["number"]]) == 2


def blobs(seed=2):
    rnd = random.Random(seed)
    pts = []
    for cy, cx in ((26.0002, 80.0002), (26.0012, 80.0014)):
        pts += [(cy + rnd.random() * 2.5e-4, cx + rnd.random() * 2.5e-4) for _ in range(8)]
    return pts


def test_cluster_walk_has_no_crossings(spark):
    s = symbols(spark, [("pucca_house", y, x, None, None) for y, x in blobs()])
    rows = ordering.order_houses(s, blocks(spark, [(26.0, 80.0, 26.002, 80.002)])).orderBy("place").collect()
    assert len(rows) == 16
    for c in {r["cluster"] for r in rows}:
        p = [(r["lat"], r["lng"]) for r in rows if r["cluster"] == c]
        hops = list(zip(p, p[1:]))

        def side(a, b, q):
            return (b[1] - a[1]) * (q[0] - a[0]) - (b[0] - a[0]) * (q[1] - a[1])

        for i, (a, b) in enumerate(hops):
            for q, r in hops[i + 2:]:
                assert not (side(a, b, q) * side(a, b, r) < 0 and side(q, r, a) * side(q, r, b) < 0)


def test_large_blocks_cluster_alike(spark):
    rnd = random.Random(6)
    pts = [(26 + rnd.random() * 0.003, 80 + rnd.random() * 0.003) for _ in range(90)]
    df = spark.createDataFrame([(1, 0, i, i, y, x, 0.0, 0) for i, (y, x) in enumerate(pts)],
                               "hlb_id long, block_id long, id long, pos long, lat double, lng double, block_score double, block_pos long")
    small = {r["id"]: (r["cluster"], r["size"], r["step"]) for r in ordering.cluster_blocks(df).collect()}
    large = {r["id"]: (r["cluster"], r["size"], r["step"]) for r in ordering.cluster_blocks(df, limit=20).collect()}
    assert small == large


def test_orders_split_alike(spark, monkeypatch):
    rnd = random.Random(9)
    pts = [(26 + rnd.random() * 0.004, 80 + rnd.random() * 0.004) for _ in range(70)]
    s = symbols(spark, [("pucca_house", y, x, None, None) for y, x in pts])
    b = blocks(spark, [(26.0, 80.0, 26.002, 80.002), (26.002, 80.0, 26.004, 80.002), (26.0, 80.002, 26.003, 80.004)])
    want = {system: [r["id"] for r in ordering.order_houses(s, b, system).orderBy("place").collect()] for system in ("serpentine", "census_u_loop")}
    monkeypatch.setattr(ordering, "GROUP_ROWS", 1)
    import blockwalk.operators.ordered as ordered

    monkeypatch.setattr(ordered, "TASK_ROWS", 9)
    real = ordered.Ordered.of
    monkeypatch.setattr(ordered.Ordered, "of", staticmethod(lambda df, keys, order, limit=9, count_on=None: real(df, keys, order, limit)))
    for system, ids in want.items():
        assert [r["id"] for r in ordering.order_houses(s, b, system).orderBy("place").collect()] == ids


# ------------------------------------------------------------------ layout

def area(spark, points):
    return spark.createDataFrame([(1, points)], f"hlb_id long, ring {RING}")


def road_rows(spark, lines):
    return spark.createDataFrame([(1, i, i, f"r{i}", ring(*pts)) for i, pts in enumerate(lines)],
                                 f"hlb_id long, road_id long, pos long, name string, coords {RING}")


def test_cross_roads_make_four_blocks(spark):
    square = ring((26.0, 80.0), (26.0, 80.01), (26.01, 80.01), (26.01, 80.0))
    cross = [[(26.005, 79.99), (26.005, 80.02)], [(25.99, 80.005), (26.02, 80.005)]]
    got = layout.detect_blocks(area(spark, square), road_rows(spark, cross), 8.0).collect()
    assert len(got) == 4 and sorted(r["label"] for r in got) == ["A", "B", "C", "D"]
    assert all(26 < r["clat"] < 26.01 and 80 < r["clng"] < 80.01 for r in got)
    top = min(got, key=lambda r: r["label"])
    assert top["clat"] > 26.005 and top["clng"] < 80.005
    assert layout.detect_blocks(area(spark, square), road_rows(spark, cross).limit(0), 8.0).count() == 0
    assert all(r["area_m2"] >= 5000 for r in layout.detect_blocks(area(spark, square), road_rows(spark, cross), 8.0, min_area=5000).collect())


def test_split_and_merge_blocks(spark):
    square = ring((26.0, 80.0), (26.0, 80.002), (26.002, 80.002), (26.002, 80.0))
    far = road_rows(spark, [[(27.0, 80.0), (27.0, 80.1)]])
    cells_ = layout.label_cells(layout.block_cells(area(spark, square), far, 4.0), 4.0)
    before = cells_.count()
    block = cells_.first()["block_id"]
    cuts = spark.createDataFrame([(1, block, ring((26.0005, 80.001), (26.0015, 80.001)))], f"hlb_id long, block_id long, line {RING}")
    parts = layout.split_block(cells_, cuts, 4.0)
    sizes = sorted(r["count"] for r in parts.groupBy("block_id").count().collect())
    assert len(sizes) == 2 and sum(sizes) > 0.95 * before and sizes[0] > 0.9 * sizes[1]
    ids = sorted(r["block_id"] for r in parts.select("block_id").distinct().collect())
    pair = spark.createDataFrame([(1, ids[0], ids[1])], "hlb_id long, a long, b long")
    assert layout.merge_blocks(parts, pair).select("block_id").distinct().count() == 2  # the cut keeps them apart
    halves = cells_.withColumn("block_id", F.when(F.col("cx") > 20, ids[1]).otherwise(ids[0]))
    assert layout.merge_blocks(halves, pair).select("block_id").distinct().count() == 1


@pytest.mark.parametrize("mode", ["grid", "rows", "serpentine"])
def test_placement_counts(spark, mode):
    square = ring((26.0, 80.0), (26.0, 80.001), (26.001, 80.001), (26.001, 80.0))
    jobs = spark.createDataFrame([(1, 1, square, 16)], f"hlb_id long, block_id long, ring {RING}, count long")
    got = layout.choose_slots(layout.lattice(jobs), mode).collect()
    assert len(got) == 16 and sorted(r["slot"] for r in got) == list(range(1, 17))
    assert all(26 < r["lat"] < 26.001 and 80 < r["lng"] < 80.001 for r in got)


def test_placement_shapes(spark):
    square = ring((26.0, 80.0), (26.0, 80.001), (26.001, 80.001), (26.001, 80.0))
    ell = ring((26.0, 80.0), (26.0, 80.001), (26.0004, 80.001), (26.0004, 80.0004), (26.001, 80.0004), (26.001, 80.0))
    jobs = spark.createDataFrame([(1, 1, square, 10), (1, 2, ell, 8), (1, 3, square, 1)], f"hlb_id long, block_id long, ring {RING}, count long")
    half = ring((26.0, 80.0005), (26.0, 80.001), (26.001, 80.001), (26.001, 80.0005))
    keep = spark.createDataFrame([(1, 1, half)], f"hlb_id long, block_id long, ring {RING}")
    got = layout.choose_slots(layout.lattice(jobs, keep)).collect()
    first = [r for r in got if r["block_id"] == 1]
    assert len(first) == 10 and all(r["lng"] < 80.0005 for r in first)
    legs = [r for r in got if r["block_id"] == 2]
    assert len(legs) == 8 and any(r["lng"] > 80.0005 for r in legs) and any(r["lat"] > 26.0005 for r in legs)
    assert len([r for r in got if r["block_id"] == 3]) == 1


def test_groups_fill_slots(spark):
    slots = spark.createDataFrame([(1, 1, i, 26.0, 80.0) for i in range(1, 7)], "hlb_id long, block_id long, slot long, lat double, lng double")
    groups = spark.createDataFrame([(1, 1, 0, "pucca_house", 2, None, False), (1, 1, 1, "apartment", 2, 4, False)],
                                   "hlb_id long, block_id long, position int, symbol_type string, count long, unit_count int, non_residential boolean")
    rows = layout.place_groups(slots, groups).orderBy("slot").collect()
    assert [r["symbol_type"] for r in rows] == ["pucca_house"] * 2 + ["apartment"] * 4
    assert [r["unit_count"] for r in rows] == [None, None, 4, 4, 4, 4] and all(r["is_residential"] for r in rows)


def test_square_offsets(spark):
    g = spark.createDataFrame([(1, 9, 0.0, 0.0, 10.0), (2, 4, 0.0, 0.0, 10.0), (3, 0, 0.0, 0.0, 10.0), (4, 1, 5.0, 7.0, 10.0)],
                              "key int, count long, cx double, cy double, cell double")
    rows = layout.square_offsets(g).orderBy("key", "i").collect()
    nine = [(r["x"], r["y"]) for r in rows if r["key"] == 1]
    assert min(nine) == (-10.0, -10.0) and max(nine) == (10.0, 10.0) and nine[1] == (0.0, -10.0)
    assert len([r for r in rows if r["key"] == 2]) == 4 and not [r for r in rows if r["key"] == 3]
    assert [(r["x"], r["y"]) for r in rows if r["key"] == 4] == [(5.0, 7.0)]


def test_layout_queries_do_the_whole_job(spark, sf, monkeypatch):
    """Every kept symbol of the binding keeps its place clear, and blocks have the operator's own cells."""
    from blockwalk.plans import bindings, layouts
    kept = {r[0] for r in bindings.symbols(spark, sf).select("symbol_type").distinct().collect()}
    seen = []
    keep = layout.preserved_symbols
    monkeypatch.setattr(layout, "preserved_symbols", lambda symbols, blocks: seen.append(symbols) or keep(symbols, blocks))
    layouts.lattice(spark, sf)
    layouts.place_groups(spark, sf)
    assert len(seen) == 2 and all({r[0] for r in s.select("symbol_type").distinct().collect()} == kept for s in seen)
    cells = []
    monkeypatch.setattr(layout, "block_cells", lambda boundaries, roads, cell_m, half, f=layout.block_cells: cells.append(cell_m) or f(boundaries, roads, cell_m, half))
    layouts.block_detect(spark, sf)
    assert cells == [2.0]
