"""Live sessions against their batch twin, however the input is cut; timers, windows of matches, replays."""

import os
import random

import pytest
from pyspark.sql import functions as F

from blockwalk.operators import trajectory
from blockwalk.operators.lineage import cut
from blockwalk.streaming import live, sinks

FIX = "session_id long, point_id long, ts long, lat double, lng double, accuracy double, speed double, road_type string, paused boolean"
IDLE = "30 minutes"
START = 1_700_000_000


def fixes(spark):
    """Three walkers up and down a lane that a mapped road crosses; one falls silent for an hour, and one fix far ahead moves the clock on."""
    pick, rows = random.Random(3), []
    for session in (1, 2, 3):
        at = START + session
        for i in range(260):
            at += 6
            if session == 2 and i == 150:
                at += 3600
            up = i if i < 130 else 260 - i
            rows.append((session, session * 1000 + i, at, 26.001 + up * 2.2e-5 + pick.random() * 3e-6, 80.001 + session * 3e-4 + pick.random() * 3e-6, pick.choice([4.0, 6.0, 9.0, 60.0]),
                         pick.choice([1.0, 1.5, 3.0, 5.0]), "track" if session == 3 and i % 90 > 60 else "residential", i % 47 == 20))
    rows.append((99, 99_000, START + 50_000, 26.0, 80.0, 5.0, 1.0, "residential", False))
    return spark.createDataFrame(rows, FIX).withColumn("ts", F.timestamp_seconds("ts"))


def roads(spark):
    lane = [{"lat": 26.0015, "lng": 80.0005 + k * 1e-4} for k in range(20)]
    other = [{"lat": 26.003, "lng": 80.0}, {"lat": 26.003, "lng": 80.0001}]
    return spark.createDataFrame([(7, 0, lane), (8, 1, other)], "road_id long, pos long, coords array<struct<lat:double,lng:double>>")


def pieces(df, folder, n, by="ts"):
    rows = df.orderBy(by, "point_id").collect()
    step = -(-len(rows) // n)
    for k in range(n):
        df.sparkSession.createDataFrame(rows[k * step:(k + 1) * step], df.schema).coalesce(1).write.mode("append").parquet(folder)
        for name in os.listdir(folder):  # files are read in the order of their times
            if name.endswith(".parquet") and not name.startswith("done"):
                path = os.path.join(folder, f"done-{k:03d}.parquet")
                os.rename(os.path.join(folder, name), path)
                os.utime(path, (START + k * 10, START + k * 10))
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def twin(spark, df, by_road):
    """(path points, return points, summaries) of the batch operators, sessions parted by their silences beforehand."""
    gaps = df.selectExpr("*", "lag(ts) OVER (PARTITION BY session_id ORDER BY ts, point_id) AS before") \
        .selectExpr("*", "before IS NULL OR unix_micros(ts) - unix_micros(before) > 1800 * 1000000 AS begins") \
        .selectExpr("*", "sum(int(begins)) OVER (PARTITION BY session_id ORDER BY ts, point_id) AS epoch") \
        .selectExpr("*", "sum(int(paused)) OVER (PARTITION BY session_id, epoch ORDER BY ts, point_id) AS pauses")
    own = cut(gaps.withColumn("session_id", F.col("session_id") * 100 + F.col("epoch")).drop("before", "begins", "epoch", "paused"))
    path = trajectory.kept_path(trajectory.with_motion(trajectory.smooth(own)), by_road)
    # a pause counts for the next path point
    path = cut(path.selectExpr("*", "pauses <> coalesce(lag(pauses) OVER (PARTITION BY session_id ORDER BY ts, point_id), 0) AS paused"))
    drawn = cut(trajectory.segments(path))
    back = {r["session_id"]: r["point_id"] for r in trajectory.return_path(path, drawn).collect()}
    none = spark.createDataFrame([], "session_id long, symbol_type string")
    totals = {r["session_id"]: r for r in trajectory.session_summary(own.select("session_id").distinct(), path, drawn, none).collect()}
    return path.collect(), drawn.filter("part = 1").collect(), back, totals


@pytest.fixture(scope="module")
def expected(spark):
    df = fixes(spark)
    return df, roads(spark), twin(spark, df, roads(spark))


def run(spark, df, by_road, folder, n):
    moving = sinks.relay(live.motion(pieces(df, f"{folder}/in", n)), f"{folder}/motion")
    return sinks.drain(live.survey(moving, live.road_cells(by_road), idle=IDLE), f"{folder}/survey")


@pytest.mark.parametrize("n", [1, 8])
def test_sessions_equal_their_batch_twin(spark, tmp_path, expected, n):
    df, by_road, (path, drawn, back, totals) = expected
    rows = run(spark, df, by_road, str(tmp_path), n).collect()
    starts = {}
    for session, started in sorted({(r["session_id"], r["started_at"]) for r in rows}):
        starts[(session, started)] = session * 100 + 1 + sum(1 for s, _ in starts if s == session)
    key = lambda r: starts[(r["session_id"], r["started_at"])]
    points = [r for r in rows if r["kind"] == "point"]
    assert {(key(r), r["point_id"], r["on_road"], r["road_id"]) for r in points} == {(r["session_id"], r["point_id"], r["on_road"], r["road_id"]) for r in path}
    where = {r["point_id"]: (r["out_lat"], r["out_lng"]) for r in path}
    assert all(abs(r["out_lat"] - where[r["point_id"]][0]) < 1e-11 and abs(r["out_lng"] - where[r["point_id"]][1]) < 1e-11 for r in points)
    index = {}
    for r in points:
        index.setdefault(key(r), []).append(r["path_index"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in index.values())
    # segments of two points or more, by the stream's numbers
    finished = {(key(r), r["segment"]): r["points"] for r in rows if r["kind"] == "segment"}
    got = {(key(r), r["point_id"]): r["segment"] for r in points if (key(r), r["segment"]) in finished}
    assert got == {(r["session_id"], r["point_id"]): r["segment"] for r in drawn}
    assert {key(r): r["point_id"] for r in points if r["returned"]} == back and {101, 301} <= set(back)
    # every session but the one that moved the clock has ended, once
    ends = [r for r in rows if r["kind"] == "finish"]
    assert sorted(map(key, ends)) == [101, 201, 202, 301]
    for r in ends:
        want = totals[key(r)]
        assert (r["duration_s"], r["road_count"], r["gps_point_count"]) == (want["duration_s"], want["road_count"], want["gps_point_count"])
        assert abs(r["distance_m"] - want["distance_m"]) < 1e-6


def test_a_replayed_batch_changes_nothing(spark, tmp_path, expected):
    df, by_road, _ = expected
    stream = pieces(df, f"{tmp_path}/in", 4)
    cells = live.road_cells(by_road)

    def once():
        moving = sinks.relay(live.motion(stream), f"{tmp_path}/motion")
        return sinks.drain(live.survey(moving, cells, idle=IDLE), f"{tmp_path}/survey").drop("batch").collect()

    before = once()
    for step in ("motion/checkpoint", "survey/checkpoint"):  # the last batch was not marked as done
        commits = sorted((int(c) for c in os.listdir(f"{tmp_path}/{step}/commits") if c.isdigit()))
        for name in (str(commits[-1]), f".{commits[-1]}.crc"):
            os.remove(f"{tmp_path}/{step}/commits/{name}")
    after = once()
    assert sorted(map(str, after)) == sorted(map(str, before))
    assert sum(r["kind"] == "finish" for r in after) == 4


def test_houses_are_numbered_at_the_end(spark, tmp_path, expected):
    df, by_road, _ = expected
    folder = str(tmp_path)
    marks = spark.createDataFrame([(1, 5, 0, "pucca_house", 26.002, 80.001), (1, 6, 1, "kutcha_house", 26.0021, 80.001), (1, 7, 2, "temple", 26.0, 80.0), (99, 8, 0, "pucca_house", 26.0, 80.0)],
                                  "session_id long, id long, pos long, symbol_type string, lat double, lng double") \
        .withColumns({"number": F.lit(None).cast("long"), "number_locked": F.lit(False)})
    moving = sinks.relay(live.motion(pieces(df, f"{folder}/in", 2)), f"{folder}/motion")

    def each(batch, batch_id):
        live.finished(batch, marks).write.mode("overwrite").parquet(f"{folder}/ends/batch={batch_id}")

    sinks.start(live.survey(moving, live.road_cells(by_road), idle=IDLE), f"{folder}/survey", each).awaitTermination()
    rows = spark.read.option("basePath", f"{folder}/ends").parquet(f"{folder}/ends/batch=*").collect()
    assert sorted((r["session_id"], r["house_count"]) for r in rows) == [(1, 2), (2, 0), (2, 0), (3, 0)]
    assert [(n["number"], n["id"]) for r in rows if r["session_id"] == 1 for n in r["numbers"]] == [(1, 6), (2, 5)]


def windows(points):
    """Windows of matches by definition: (point_id, window, confidence, accepted)."""
    out, held, number, since, carried = [], [], 1, None, False
    for p in points:
        since = p[1] if since is None else since
        held.append(p)
        if len(held) >= 5 and p[1] - since >= 30:
            share = sum(q[2] for q in held) / len(held)
            out += [(q[0], number, share, share >= 0.6 and q[2] and k > 0) for k, q in enumerate(held) if k or not carried]
            held, since, number, carried = [p], p[1], number + 1, True
    return out + [(q[0], number, None, False) for k, q in enumerate(held) if k or not carried]


@pytest.mark.parametrize("n", [1, 8])
def test_windows_of_matches(spark, tmp_path, n):
    """Rows in are rows out; a window is taken from a share of 0.6 on a road, and left raw below; windows do not depend on the cut."""
    pick, rows = random.Random(8), []
    for session in (1, 2):
        at = START
        for i in range(120):
            at += pick.choice([3, 6, 11])
            off = pick.random() < (0.15 if i // 20 % 2 else 0.55)
            rows.append((session, session * 1000 + i, at, START, 26.0015 + (4e-4 if off else 2e-5), 80.0006 + i * 1e-6))
    rows.append((9, 9000, START + 50_000, START + 50_000, 26.0, 80.0))
    df = spark.createDataFrame(rows, "session_id long, point_id long, ts long, started_at long, lat double, lng double") \
        .withColumns({"ts": F.timestamp_seconds("ts"), "started_at": F.timestamp_seconds("started_at")})
    got = sinks.drain(live.matched(pieces(df, f"{tmp_path}/in", n), live.road_cells(roads(spark))), f"{tmp_path}/out").collect()
    want = {}
    for session in (1, 2):
        want |= {w[0]: w[1:] for w in windows([(r[1], r[2], r[4] < 26.0017) for r in rows if r[0] == session])}
    assert len(got) == len(want) == 240
    assert {r["point_id"]: (r["window_no"], r["confidence"], r["road_id"] == 7) for r in got} == want
    shares = {w[1] for w in want.values() if w[1] is not None}
    assert min(shares) < 0.6 <= max(shares)
    place = {r[1]: r[4] for r in rows}
    assert all((abs(r["out_lat"] - 26.0015) < 1e-9) if r["road_id"] else r["out_lat"] == place[r["point_id"]] for r in got)


def test_a_short_session_costs_little_beside_its_fixes():
    """The recorder's step by itself: same path as the folds over frames, in few calls (a step of pandas is some hundred)."""
    import sys

    import numpy as np
    import pandas as pd

    from blockwalk.operators import folds, trajectory
    from blockwalk.streaming import recorder

    rng = np.random.default_rng(3)
    n = 60
    fixes = pd.DataFrame({
        "session_id": 1, "point_id": rng.permutation(n), "ts": pd.to_datetime(1704067200 + rng.integers(0, 40, n) * 60, unit="s"),
        "lat": 26.0 + rng.random(n) * 1e-4, "lng": 80.0 + rng.random(n) * 1e-4, "accuracy": rng.choice([0.0, 5.0, 25.0, 55.0, np.nan], n),
        "speed": rng.choice([0.5, 3.0, 9.0, np.nan], n)})
    calls = [0]

    def count(frame, event, arg):
        calls[0] += event in ("call", "c_call")

    recorder.advance(recorder.START, fixes)
    sys.setprofile(count)
    try:
        state, path = recorder.advance(recorder.START, fixes)
    finally:
        sys.setprofile(None)
    assert calls[0] < 4000
    rows = fixes.sort_values(["ts", "point_id"])
    last, smooth = folds.kalman_step(folds.KALMAN_START, rows)
    ys, xs = smooth["lat"].tolist(), smooth["lng"].tolist()
    still = np.array([recorder._still(ys[max(0, i - 4):i + 1], xs[max(0, i - 4):i + 1]) for i in range(n)])
    speed = smooth["speed"].fillna(0.0)
    rows = smooth[~still & (smooth["accuracy"] <= trajectory.MAX_ACCURACY) & (speed <= 4.2) & ((speed > 2.0) | ~(smooth["accuracy"] > 20))]
    kept = folds.thin_step(trajectory.THIN_METRES)((float("nan"), float("nan")), rows.assign(out_lat=rows["lat"], out_lng=rows["lng"]))[1]
    assert len(kept) > 5 and path["point_id"].tolist() == kept["point_id"].tolist() and path["lat"].tolist() == kept["lat"].tolist()
    assert path["path_index"].tolist() == list(range(1, len(kept) + 1)) and state[:3] == last and state[5] == len(kept)
    assert path.columns.tolist() == recorder.OUTPUT.names
    cut_state, first = recorder.advance(recorder.START, fixes.sort_values(["ts", "point_id"])[:23])
    again, second = recorder.advance(cut_state, fixes.sort_values(["ts", "point_id"])[23:])
    assert again == state and first["point_id"].tolist() + second["point_id"].tolist() == kept["point_id"].tolist()
