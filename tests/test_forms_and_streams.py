"""Forms, accounts, traps and stream/batch agreement."""

import random

import pytest
from pyspark.sql import functions as F

from blockwalk.functions import domain, schedule
from blockwalk.operators import accounts, dashboard, features, trajectory
from blockwalk.streaming import changes, events, recorder, sinks


def test_migration_order(spark):
    df = spark.createDataFrame([(1, False, True, None), (2, None, True, None), (3, True, False, None), (4, None, None, 3)],
                               "id int, asset_bicycle boolean, asset_scooter_motorcycle boolean, col_31_vehicle_2w int")
    got = {r["id"]: r["col_31_vehicle_2w"] for r in schedule.migrate(df).collect()}
    assert got == {1: 4, 2: 2, 3: 1, 4: 3}  # a "no bicycle" answer settles the column before the scooter is read


def test_completeness_rules(spark):
    df = spark.createDataFrame([(1, 5, 5, 5, 3, None), (2, 5, 0, 5, 3, None), (3, 5, 5, 5, 1, "Asha")],
                               "id int, col_4_floor int, col_5_wall int, col_6_roof int, col_7_use int, col_11_head_name string")
    got = {r["id"]: r for r in schedule.completeness(df).collect()}
    assert got[1]["schedule1_complete"] and not got[2]["schedule1_complete"]  # code 0 counts as missing
    assert got[2]["filled_fields"] == 4 and got[1]["visible_fields"] == 7
    assert got[1]["form_fill_percentage"] == 57  # 57.14
    assert got[1]["schedule_a_complete"] and not got[3]["schedule_a_complete"] and not got[3]["can_save"]


def test_half_rounds_up(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (0.5,), (-0.5,)], "x double")
    assert [r[0] for r in df.select(domain.js_round(F.col("x"))).collect()] == [3, -2, 1, 0]


def test_hidden_answers_are_cleared(spark):
    df = spark.createDataFrame([(3, 1, 2, ""), (1, 1, 2, "A")], "col_7_use int, col_10_persons int, col_20_latrine int, col_11_head_name string")
    rows = schedule.clean(df).collect()
    assert rows[0]["col_10_persons"] is None and rows[0]["col_11_head_name"] is None
    assert rows[1]["col_10_persons"] == 1 and rows[1]["col_11_head_name"] == "A"


def test_glossary(spark):
    rows = schedule.glossary(spark).collect()
    assert len(rows) == len(schedule.options()) and len({r["column_number"] for r in rows}) == len({col for col, _, _ in schedule.OPTIONS}) + 1
    assert [r["code"] for r in rows if r["column_number"] == "Col 5"] == [1]


def test_backfill_twice_adds_once(spark):
    ts = "2024-01-01 00:00:00"
    p = spark.createDataFrame([(1, "paid", "a", ts), (2, "unpaid", "b", ts)], "id long, payment_status string, payment_id string, updated_at string")
    live = spark.createDataFrame([(7, "paid", "c", ts)], "session_id long, payment_status string, payment_id string, created_at string")
    don = spark.createDataFrame([(9, 12.34, True, None, "d", ts), (10, 0.0, True, None, "e", ts)],
                                "id long, amount double, is_paid boolean, payment_status string, payment_id string, created_at string")
    none = spark.createDataFrame([], "source_type string, source_id long, amount_paise long")
    first = accounts.ledger_backfill(none, p, live, don)
    assert sorted((r["source_type"], r["amount_paise"]) for r in first.collect()) == [("donation", 1234), ("live_session", 2500), ("map", 2500)]
    assert accounts.ledger_backfill(first, p, live, don).count() == 0


def test_quota_edges(spark):
    made = [(u, f"2024-01-15 0{i}:00:00") for u, n in ((1, 5), (2, 6), (3, 7)) for i in range(n)] + [(1, "2024-01-16 00:00:00")]
    df = spark.createDataFrame(made, "user_id long, created_at string").withColumn("created_at", F.to_timestamp("created_at"))
    got = {r["user_id"]: (r["used"], r["remaining"], r["blocked"]) for r in accounts.quota_usage(df, df.limit(0), "2024-01-15").collect()}
    assert got == {1: (5, 1, False), 2: (6, 0, True), 3: (7, 0, True)}


def test_geo_orders_by_number(spark):
    rows = [(i, "T9" if i < 9 else "T10", "V") for i in range(19)]
    df = spark.createDataFrame(rows, "id long, tehsil string, town_village string")
    assert [r["user_count"] for r in dashboard.geo_distribution(df).collect()] == [10, 9]


def test_open_retention_windows_count(spark):
    # signed up 25 h before: eligible for day one although its window is still open
    t = "id long, created_at string, updated_at string"
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00", "2024-01-01 00:00:00"), (2, "2024-01-01 00:00:00", "2024-01-01 21:00:00")], t)
    df = df.withColumns({c: F.to_timestamp(c) for c in ("created_at", "updated_at")})
    none = spark.createDataFrame([], "user_id long, created_at timestamp, updated_at timestamp")
    r = dashboard.cohort_retention(df, none.select("user_id", "updated_at"), none.select("user_id", "created_at"), "2024-01-02 01:00:00").first()
    assert r["d1_pct"] == 50.0 and r["d7_pct"] == 0.0


def test_movement_cuts(spark):
    df = spark.createDataFrame([(8.31, 1.0), (8.3, 1.0), (4.2, 1.0), (2.0, 21.0), (2.0, 20.0), (None, 5.0)], "s double, a double")
    assert [r[0] for r in df.select(domain.movement_class(F.col("s"), F.col("a"))).collect()] == \
        ["vehicle", "bicycle", "fast_walk", "poor_gps", "walking", "walking"]


def test_stationary_needs_five(spark):
    rows = [(1, i, i, 26.0, 80.0, 5.0, 1.0) for i in range(6)]
    df = spark.createDataFrame(rows, "session_id long, point_id long, ts long, lat double, lng double, accuracy double, speed double")
    got = [r["stationary"] for r in trajectory.with_motion(df).orderBy("ts").collect()]
    assert got == [False] * 4 + [True] * 2


def test_leaving_a_road_repeats_its_point(spark):
    rows = [(1, i, i, 26 + i * 1e-4, 80.0, road) for i, road in enumerate([False, False, True, False, False])]
    df = spark.createDataFrame(rows, "session_id long, point_id long, ts long, out_lat double, out_lng double, on_road boolean")
    plain = trajectory.segments(df).groupBy("segment").count().orderBy("segment").collect()
    compat = trajectory.segments(df, keep_duplicates=True).groupBy("segment").count().orderBy("segment").collect()
    assert [r["count"] for r in plain] == [2, 2] and [r["count"] for r in compat] == [2, 3]


def test_pause_and_type_change_continue_from_last_point(spark):
    rows = [(1, i, i, 26 + i * 1e-4, 80.0, False, i == 2, "track" if i >= 4 else "path") for i in range(6)]
    df = spark.createDataFrame(rows, "session_id long, point_id long, ts long, out_lat double, out_lng double, on_road boolean, paused boolean, road_type string")
    got = trajectory.segments(df).orderBy("segment", "ts", "part").collect()
    assert [(r["segment"], r["point_id"]) for r in got] == [(0, 0), (0, 1), (1, 1), (1, 2), (1, 3), (2, 3), (2, 4), (2, 5)]


def test_named_farmland_is_a_landmark(spark):
    el = [("way", 1, {"landuse": "farmland", "name": "Ram"}), ("way", 2, {"landuse": "farmland"}), ("node", 3, {"amenity": "water_well"})]
    g = [{"lat": 26.0, "lon": 80.0}, {"lat": 26.0, "lon": 80.1}, {"lat": 26.1, "lon": 80.1}]
    rows = [(0, i, i, t, None if t == "way" else 26.05, None if t == "way" else 80.05, tags, g if t == "way" else None) for i, (t, _, tags) in enumerate(el)]
    df = spark.createDataFrame(rows, "hlb_id long, pos long, id long, type string, lat double, lon double, tags map<string,string>, geometry array<struct<lat:double,lon:double>>")
    none = spark.createDataFrame([], "hlb_id long, ring array<struct<lat:double,lng:double>>")
    got = {(r["id"], r["kind"], r["feature_type"]) for r in features.classify_elements(df, none).collect()}
    assert got == {(0, "landmark", "point_of_interest"), (1, "farmland", "farmland"), (2, "symbol", "well")}
    assert {r["id"] for r in features.classify_elements(df, none, compat_skip_nodes=True).collect()} == {0, 1}


# ------------------------------------------------------------------ streams

FIX = "session_id long, point_id long, ts timestamp, lat double, lng double, accuracy double, speed double"


@pytest.mark.parametrize("pieces", [1, 4])
def test_recorder_stream_equals_batch(spark, tmp_path, pieces):
    rnd = random.Random(pieces)
    rows = [(i % 3, i, 1_700_000_000 + i * 5, 26 + i * 4e-6 + rnd.random() * 1e-5, 80 + rnd.random() * 1e-5, rnd.choice([4.0, 9.0, 30.0, 60.0]), rnd.random() * 5)
            for i in range(240)]
    df = spark.createDataFrame(rows, FIX.replace("ts timestamp", "ts long")).withColumn("ts", F.timestamp_seconds("ts"))
    step = 240 // pieces
    for k in range(pieces):
        df.filter((F.col("point_id") >= k * step) & (F.col("point_id") < (k + 1) * step)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sinks.drain(recorder.record(stream), str(tmp_path / "out")).collect()
    want = trajectory.kept_path(trajectory.with_motion(trajectory.smooth(df))).collect()
    assert {(r["session_id"], r["point_id"]) for r in got} == {(r["session_id"], r["point_id"]) for r in want} and got
    index = {}
    for r in sorted(got, key=lambda r: r["path_index"]):
        index.setdefault(r["session_id"], []).append(r["path_index"])
    assert all(v == list(range(1, len(v) + 1)) for v in index.values())


def test_event_rows(spark):
    df = spark.createDataFrame([(" ", "login", "/a", "u1", None, " 1.2.3.4 , 5.6.7.8"), ("f", "", "/a", "u1", None, None), ("f", None, "/a", "", None, None)],
                               "fingerprintId string, eventType string, pagePath string, userId string, metadata string, forwarded string").withColumn("ts", F.current_timestamp())
    rows = events.user_event_rows(df).collect()
    assert len(rows) == 1 and rows[0]["fingerprint_id"] is None and rows[0]["ip_address"] == "1.2.3.4"


def test_settling_twice_changes_nothing(spark):
    calls = spark.createDataFrame([("don_1", changes.SUCCESS, 1), ("don_2", changes.FAILED, 1), ("lrg_5", changes.SUCCESS, 2), ("live_6", changes.SUCCESS, 1), ("p7", changes.SUCCESS, 1)],
                                  "order_id string, type string, ts long")
    don = spark.createDataFrame([(1, "don_1", "created", None), (2, "don_2", "created", None)], "id long, payment_id string, payment_status string, is_paid boolean")
    live = spark.createDataFrame([(5, "lrg_5", "paid", 1), (6, "live_6", "created", 0)], "session_id long, payment_id string, payment_status string, regen_allowance int")
    maps = spark.createDataFrame([(7, "p7", "created", 2)], "id long, payment_id string, payment_status string, regen_allowance int")
    once = changes.settle(calls, don, live, maps)
    twice = changes.settle(calls, once["donations"], once["live_exports"], once["projects"])
    for name in once:
        assert {tuple(r) for r in once[name].collect()} == {tuple(r) for r in twice[name].collect()}
    assert {(r["id"], r["payment_status"], r["is_paid"]) for r in once["donations"].collect()} == {(1, "paid", True), (2, "failed", None)}
    assert {(r["session_id"], r["payment_id"], r["regen_allowance"]) for r in once["live_exports"].collect()} == {(5, "processed_lrg_5", 7), (6, "live_6", 6)}
    assert once["projects"].first()["regen_allowance"] == 7


def test_registry_is_complete(spark, sf):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 30
