"""What a live point or session costs where roads lie dense and sessions are many."""

import random
import sys

import numpy as np

from blockwalk.operators import assign
from blockwalk.streaming import live


def strung(spark, n):
    """``n`` roads of three vertices strung along one lane, a third of a metre apart, some of them twice."""
    at = lambda k, y, x: {"lat": 26.001 + k * 3e-6 + y, "lng": 80.0012 + x}
    rows = [(k, k, [at(k // 2 if k % 10 == 1 else k, -1e-4, 0.0), at(k, 0.0, (k % 3) * 1e-5), at(k, 1e-4, 2e-4)]) for k in range(n)]
    return spark.createDataFrame(rows, "road_id long, pos long, coords array<struct<lat:double,lng:double>>")


def test_a_live_point_meets_few_of_the_sides_of_its_cell(spark):
    """Parts of a dense cell list few sides, and the road found is that of the batch form, ties and copies included."""
    pick, roads = random.Random(4), strung(spark, 120)
    by_cell = assign.road_cells(roads).cache()
    dense = by_cell.orderBy("_n", ascending=False).selectExpr("size(lines)", "aggregate(_parts, 0, (n, p) -> n + size(p)) / size(_parts)").first()
    assert dense[0] > 100 and dense[1] < dense[0] / 5
    spots = [(26.001 + pick.uniform(-3e-4, 7e-4), 80.0012 + pick.uniform(-3e-4, 4e-4)) for _ in range(1500)]
    spots += [(26.001 + k * 3e-6, 80.0012 + (k % 3) * 1e-5) for k in range(120)] + [(26.0 + k * 1e-4, 80.001 + j * 1e-4) for k in range(20) for j in range(6)]
    points = spark.createDataFrame([(1, i, *p) for i, p in enumerate(spots)], "session_id long, point_id long, lat double, lng double")
    want = {r["point_id"]: (r["road_id"], r["snap_lat"], r["snap_lng"]) for r in assign.snap_points(points, roads, "session_id", "point_id").collect()}
    got = {r["point_id"]: (r["road_id"], r["snap_lat"], r["snap_lng"]) for r in assign.on_roads(points, by_cell).collect()}
    assert len(got) == len(spots) and 500 < len(want) < len(spots)
    assert got == {i: want.get(i, (None, None, None)) for i in range(len(spots))}


def test_far_north_cells_are_not_parted():
    ends = tuple(np.full(50, v) for v in (85.00001, 80.00001, 85.00009, 80.00009))
    assert assign.side_parts(850000, 800000, ends, 10.0) == [list(range(50))]


def test_a_session_costs_few_calls_beside_its_rows():
    """Python calls of a short session's step and of its end (three times as many as typed frames)."""
    n, rng = 30, np.random.default_rng(1)
    us = (1_704_067_200 + np.arange(n) * 60) * 1_000_000
    fixes = [list(range(n)), ["residential"] * n, [False] * n, us.tolist(), (26 + rng.random(n) * 1e-3).tolist(), (80 + rng.random(n) * 1e-3).tolist(), [5.0] * n, [1.0] * n]
    calls = [0]

    def count(frame, event, arg):
        calls[0] += event in ("call", "c_call")

    def step():
        now, moved = live._filtered(None, 7, 1_800_000, *fixes)
        live._frame(moved, live.MOTION)
        session, found = live.Session(), []
        for i in range(n):
            found.extend(session.take(live.Fix(i, "residential", us[i], 0, 1, 0, 0, fixes[4][i], fixes[5][i], 10.0, None, None)))
        live._rows(found, (7, int(us[0])))
        return live._rows(list(session.close()), (7, int(us[0])))

    step()
    sys.setprofile(count)
    try:
        end = step()
    finally:
        sys.setprofile(None)
    assert end["kind"].tolist()[-1] == "finish" and end["gps_point_count"].tolist()[-1] == n
    assert calls[0] < 5000


def test_large_road_numbers_stay_whole(spark, tmp_path):
    """A road's number beside points off the roads; as a double it would lose its last digits."""
    from pyspark.sql import functions as F

    from blockwalk.streaming import sinks

    number = 2**53 + 1
    road = spark.createDataFrame([(number, 0, [{"lat": 26.0, "lng": 80.0}, {"lat": 26.0001, "lng": 80.0}])], "road_id long, pos long, coords array<struct<lat:double,lng:double>>")
    rows = [(1, i, 1_700_000_000 + i * 10, 1_700_000_000, 26.00002 + i * 1e-5 if i < 8 else 26.01, 80.0) for i in range(12)] + [(2, 99, 1_700_900_000, 1_700_900_000, 26.0, 80.0)]
    df = spark.createDataFrame(rows, "session_id long, point_id long, ts long, started_at long, lat double, lng double") \
        .withColumns({"ts": F.timestamp_seconds("ts"), "started_at": F.timestamp_seconds("started_at")})
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    found = sinks.drain(live.matched(stream, live.road_cells(road)), f"{tmp_path}/out").filter("session_id = 1 AND road_id IS NOT NULL")
    assert {r["road_id"] for r in found.collect()} == {number}


def test_a_crowded_cell_is_parted_piece_by_piece(monkeypatch):
    rng = np.random.default_rng(2)
    ends = tuple(base + rng.random(90) * 1e-4 for base in (26.0, 80.0, 26.0, 80.0))
    whole = assign.side_parts(260000, 800000, ends, 10.0)
    monkeypatch.setattr(assign, "PART_PAIRS", 200)
    assert assign.side_parts(260000, 800000, ends, 10.0) == whole and len(whole) == 19 * 19
