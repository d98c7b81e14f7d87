"""Queries on keys and sizes that only the larger tables hold."""

import math

import duckdb
import numpy as np
from pyspark.sql import functions as F

from blockwalk.functions import geo
from blockwalk.operators import kernels, layout, nearest, trajectory
from blockwalk.plans import bindings, registry


def _rows(rows):
    return sorted(tuple(r) for r in rows)


def test_footprints_of_high_keys_equal_their_sql(spark, sf, tmp_path):
    """Keys over 320 000 put squares beyond 90 degrees, where the SQL's area is negative."""
    shift = lambda name, key, by: spark.read.parquet(f"{sf}/{name}.parquet").limit(150).withColumn(
        key, by).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    shift("customer", "c_custkey", F.col("c_custkey") % 1000 + 320_000)
    shift("orders", "o_orderkey", F.monotonically_increasing_id() * 1000 + 3_195_000)
    got = registry.queries()["footprint_scan"](spark, str(tmp_path)).select("hlb_id", "id", "lat", "lng", "area_sqm", "source")
    con = duckdb.connect()
    for name in ("customer", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(f"SELECT hlb_id, id, lat, lng, area_sqm, source FROM ({registry.oracle_sql()['footprint_scan']})").fetchall()
    assert want and min(r[4] for r in want) < 0
    assert _rows(got.collect()) == _rows(want)


def test_blocks_travel_as_runs_of_cells(spark, monkeypatch):
    """A fine grid gives rows by runs, not by cells; areas with many runs are linked across tasks alike."""
    ring = lambda *points: [{"lat": y, "lng": x} for y, x in points]
    shape = "array<struct<lat:double,lng:double>>"
    area = spark.createDataFrame([(1, ring((26.0, 80.0), (26.0, 80.004), (26.004, 80.004), (26.002, 80.002), (26.004, 80.0)))],
                                 f"hlb_id long, ring {shape}")
    roads = spark.createDataFrame([(1, 0, ring((26.001, 79.99), (26.0012, 80.01))), (1, 1, ring((25.99, 80.001), (26.01, 80.0013)))],
                                  f"hlb_id long, pos long, coords {shape}")
    runs = layout.block_cells(area, roads, 2.0).cache()
    cells = {(r.cy, x): (r.lat, r.west + (x + 0.5) * r.dx) for r in runs.collect() for x in range(r.cx, r["last"] + 1)}
    assert runs.count() < len(cells) / 20
    at = spark.createDataFrame([(y, x, lat, lng) for (y, x), (lat, lng) in cells.items()], "cy long, cx long, lat double, lng double")
    sides = roads.crossJoin(at).select("cy", "cx", geo.min_edge_m("lat", "lng", geo.line_segments(F.col("coords"))).alias("m"))
    assert sides.agg(F.min("m")).first()[0] >= layout.ROAD_HALF_WIDTH
    want = {}
    for cell in sorted(cells):
        if cell not in want:
            want[cell], queue = cell, [cell]
            while queue:
                y, x = queue.pop()
                for near in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                    if near in cells and near not in want:
                        want[near] = cell
                        queue.append(near)
    blocks = {c: y * 10_000_000 + x for c, (y, x) in want.items()}
    for limit in (10, 100_000):
        labelled = layout.label_runs(runs, 2.0, 0.0, limit).collect()
        assert {(r.cy, x): r.block_id for r in labelled for x in range(r.cx, r["last"] + 1)} == blocks


def test_cell_sizes_of_small_groups_are_measured_in_tasks(spark, sf):
    """No pairs travel: one exchange of the group's own rows; groups over the limit give the same sizes by cells."""
    rows = bindings.symbols(spark, sf)
    inside = nearest.local_cell_size(rows, ["hlb_id"])
    assert "Join" not in inside._jdf.queryExecution().executedPlan().toString()
    by_cells = nearest.local_cell_size(rows, ["hlb_id"], limit=10)
    size = lambda df: {r["id"]: round(r["cell_size"], 6) for r in df.collect()}
    assert size(inside) == size(by_cells)


def test_short_lines_are_walked_together(spark):
    """Many lines make few Python calls, and a line that goes on in the next batch keeps the same vertices."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rng = np.random.default_rng(3)
    lines = [(k, i, float(np.round(rng.random(), 1)), float(np.round(rng.random(), 1))) for k in range(60) for i in range(int(rng.integers(1, 25)))]
    out = trajectory.simplify(spark.createDataFrame(lines, "k long, i long, lat double, lng double"), ["k"], 0.2)
    got = {(r["k"], r["i"]) for r in out.collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = set()
    for k in range(60):
        at = np.array([r[1:] for r in lines if r[0] == k])
        want |= {(k, int(i)) for i in at[kernels.deviating(at[:, 1], at[:, 2], 0.2), 0]}
    assert got == want
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()


def test_slots_are_picked_by_striking_out():
    """The first houses that keep their distance, ties at exactly the distance included, as the walk over all candidates keeps them."""
    rng = np.random.default_rng(0)
    flat = lambda a, b, p, q: math.hypot(a - p, b - q)
    for step, gap in ((3.0, 5.0), (5.0, 5.0), (1.2, 6.0), (14.4, 43.2), (2.5, 17.3)):
        row, col = np.divmod(np.arange(600), 25)
        turn = rng.random()
        v, u = step * (row * np.cos(turn) - col * np.sin(turn)), step * (row * np.sin(turn) + col * np.cos(turn))
        for y, x in ((v, u), (row * step, col * step)):
            want = np.flatnonzero(kernels.greedy_keep(y, x, gap, flat))[:20]
            assert kernels.first_apart(y, x, gap, 20).tolist() == want.tolist()
