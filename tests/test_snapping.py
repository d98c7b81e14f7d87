"""Points against many roads at one place: brute force, the stream's form beside the batch form, and what travels."""

import math
import random

from pyspark.sql import functions as F

from blockwalk.operators import assign

M = 111320.0


def brute(points, roads):
    """Nearest line among the roads with a vertex close on both axes."""
    out = {}
    for i, lat, lng in points:
        k, best = math.cos(math.radians(lat)) * M, None
        for road, pos, line in roads:
            if not any(abs(y - lat) < 0.0002 and abs(x - lng) < 0.0002 for y, x in line):
                continue
            for (ay, ax), (by, bx) in zip(line[:-1], line[1:]):
                ay, ax, by, bx = (ay - lat) * M, (ax - lng) * k, (by - lat) * M, (bx - lng) * k
                n = (by - ay) ** 2 + (bx - ax) ** 2
                t = max(0.0, min(1.0, -(ax * (bx - ax) + ay * (by - ay)) / n)) if n else 0.0
                d = math.hypot(ax + t * (bx - ax), ay + t * (by - ay))
                if d <= 10 and (best is None or d < best[0]):
                    best = (d, road)
        if best:
            out[i] = best
    return out


def frames(spark, points, roads):
    p = spark.createDataFrame([(1, *r) for r in points], "session_id long, point_id long, lat double, lng double")
    r = spark.createDataFrame([(a, b, [{"lat": y, "lng": x} for y, x in c]) for a, b, c in roads],
                              "road_id long, pos long, coords array<struct<lat:double,lng:double>>")
    return p, r


def shuffled(spark):
    gateway, store = spark.sparkContext._gateway, spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_nearest_road_by_brute_force(spark):
    pick = random.Random(5)
    roads = [(n, n, [(26.0 + pick.random() * 2e-3, 80.0 + pick.random() * 2e-3) for _ in range(3)]) for n in range(40)]
    # a long road back to its start: its far sides count only where a vertex is close
    roads.append((90, 90, [(26.0, 80.0), (26.01, 80.013), (26.0101, 80.0), (26.0002, 80.0001)]))
    roads += [(91, 91, [(26.001, 80.0), (26.001, 80.002)]), (92, 92, [(26.0, 80.001), (26.002, 80.001)]), (93, 93, [(26.0, 80.0)])]
    ends = [v for r in roads for v in r[2]]
    points = [(i, y + pick.uniform(-2e-4, 2e-4), x + pick.uniform(-2e-4, 2e-4)) for i, (y, x) in enumerate(pick.choices(ends, k=600))]
    want = brute(points, roads)
    p, r = frames(spark, points, roads)
    got = {x["point_id"]: x for x in assign.snap_points(p, r, "session_id", "point_id").collect()}
    assert {i: x["road_id"] for i, x in got.items()} == {i: w[1] for i, w in want.items()} and len(want) > 200
    assert all(abs(got[i]["road_dist"] - want[i][0]) < 1e-4 for i in want)
    live = {x["point_id"]: x for x in assign.on_roads(p, assign.road_cells(r)).collect()}
    assert len(live) == len(points)
    for i, x in live.items():
        w = got.get(i)
        assert (x["road_id"], x["snap_lat"], x["snap_lng"]) == ((w["road_id"], w["snap_lat"], w["snap_lng"]) if w else (None, None, None))


def test_pairs_of_points_and_roads_do_not_travel(spark):
    roads = [(n, n, [(26.0 + n * 1e-7, 80.0), (26.0001 + n * 1e-7, 80.00005)]) for n in range(60)]
    pick = random.Random(6)
    points = [(i, 26.00005 + pick.random() * 5e-5, 80.0 + pick.random() * 8e-5) for i in range(3000)]
    p, r = frames(spark, points, roads)
    before = shuffled(spark)
    assert assign.snap_points(p, r, "session_id", "point_id").agg(F.count("road_id")).first()[0] == 3000
    assert shuffled(spark) - before < 60_000


def test_a_stateful_batch_is_read_once(spark):
    """What a micro-batch costs to make is paid once, however often its points are read."""
    from blockwalk.streaming import recorder

    made = spark.sparkContext.accumulator(0)

    def walk(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    roads = [(n, n, [(26.0 + n * 1e-5, 80.0), (26.0001 + n * 1e-5, 80.00005)]) for n in range(5)]
    p, r = frames(spark, [(i, 26.0 + i * 1e-6, 80.00002) for i in range(200)], roads)
    found = recorder.snap_batch(p.mapInPandas(walk, p.schema), r).collect()
    assert len(found) == 200 and sum(x["road_id"] is not None for x in found) > 50
    assert made.value == 200
