"""Both sides of every size switch give the same rows; nothing is lost at the edges."""
import random

from pyspark.sql import functions as F

from blockwalk.functions import domain, schedule
from blockwalk.operators import accounts, conflate, layout, ordering


def test_labels_never_repeat(spark):
    df = spark.createDataFrame([(i,) for i in (0, 25, 26, 701, 702, 18277, 18278, 475253, 475254)], "i long")
    got = [r[0] for r in df.select(domain.excel_label(F.col("i"))).collect()]
    assert got == ["A", "Z", "AA", "ZZ", "AAA", "ZZZ", "AAAA", "ZZZZ", "AAAAA"]


def test_conflation_of_unknown_providers_at_any_size(spark):
    rnd = random.Random(4)
    rows = [(0, i, rnd.choice(["osm", "google", "microsoft", "x", "y", None, None]), 26.0 + (i % 3) * 0.01, 80.0) for i in range(300)]
    df = spark.createDataFrame(rows, "hlb_id long, id long, source string, lat double, lng double")
    small = {r["id"] for r in conflate.conflate(df).collect()}
    large = {r["id"] for r in conflate.conflate(df, limit=10).collect()}
    assert small == large and small


def test_house_order_at_any_size(spark, monkeypatch):
    rnd = random.Random(5)
    at = [(26.0 + i * 0.002, 80.0 + i * 0.002) for i in range(12)]  # single houses on a diagonal: all scores tie
    at += [(26.0 + rnd.random() * 0.02, 80.0 + rnd.random() * 0.02) for _ in range(20)]
    rows = [(0, 1000 - i, i, "pucca_house", y, x) for i, (y, x) in enumerate(at)]  # ids against input order
    df = spark.createDataFrame(rows, "hlb_id long, id long, pos long, symbol_type string, lat double, lng double")
    small = {r["id"]: r["place"] for r in ordering.order_houses(df).collect()}
    monkeypatch.setattr(ordering, "GROUP_ROWS", 3)
    clustered = ordering.cluster_blocks
    monkeypatch.setattr(ordering, "cluster_blocks", lambda rows, largest=None: clustered(rows, limit=3))
    assert {r["id"]: r["place"] for r in ordering.order_houses(df).collect()} == small


def test_merged_blocks_chain_and_keep_cells(spark):
    cells_ = [(1, b, 0, b) for b in range(5)] + [(1, 9, 5, 5)]
    df = spark.createDataFrame(cells_, "hlb_id long, block_id long, cy long, cx long")
    pairs = spark.createDataFrame([(1, 1, 0), (1, 1, 2), (1, 2, 3), (1, 4, 9)], "hlb_id long, a long, b long")
    got = {(r["cy"], r["cx"]): r["block_id"] for r in layout.merge_blocks(df, pairs).collect()}
    assert got == {(0, 0): 0, (0, 1): 0, (0, 2): 0, (0, 3): 0, (0, 4): 4, (5, 5): 9}
    assert layout.merge_blocks(df, pairs).count() == len(cells_)


def test_admins_see_everything(spark):
    projects = spark.createDataFrame([(1, 7), (2, 8), (3, 9)], "id long, user_id long")
    given = spark.createDataFrame([(3, 7), (99, 7)], "project_id long, user_id long")
    profiles = spark.createDataFrame([(7, False), (8, True), (9, None)], "id long, is_admin boolean")
    viewers = profiles.select(F.col("id").alias("user_id"))
    got = {(r["viewer_id"], r["project_id"], r["all_projects"]) for r in accounts.visible_projects(projects, given, profiles, viewers).collect()}
    assert got == {(7, 1, False), (7, 3, False), (8, None, True), (9, 3, False)}


def test_option_table():
    rows = schedule.options()
    assert len(rows) == len({(c, v) for c, _, v, _, _ in rows}) and all(label for *_, label, _ in rows)
    assert [r[2] for r in rows if r[0] == 7] == [1, 2, 3, 4, 5, 6, 7, 8, 9, 0] and [r[4] for r in rows if r[0] == 29] == [0, 1]


def _ring_of(lat, lng, n, metres):
    import math
    return [(0, i, lat + metres / 111320 * math.sin(i), ((lng + metres / 111320 / math.cos(math.radians(lat)) * math.cos(i) + 540) % 360) - 180) for i in range(n)]


def test_near_at_high_latitude_and_the_date_line(spark):
    from blockwalk.operators import cells
    for lat, lng in ((80.0, 12.0), (-84.0, 30.0), (10.0, 179.99999), (75.0, -179.99998)):
        new = spark.createDataFrame(_ring_of(lat, lng, 40, 4.5), "hlb_id long, id long, lat double, lng double")
        old = spark.createDataFrame([(0, lat, lng)], "hlb_id long, lat double, lng double")
        assert cells.drop_near(new, old, ["hlb_id"], 5.0).count() == 0, (lat, lng)
        assert cells.drop_near(new, old, ["hlb_id"], 4.0).count() == 40, (lat, lng)


def test_thinning_at_high_latitude_at_any_size(spark):
    from blockwalk.operators import thin
    rnd = random.Random(7)
    rows = [(0, i, 80.0 + rnd.random() * 4e-4, 10.0 + rnd.random() * 2e-3) for i in range(250)]
    df = spark.createDataFrame(rows, "hlb_id long, id long, lat double, lng double")
    small = {r["id"] for r in thin.greedy_thin(df, ["hlb_id"], [F.col("id")], 8.0, "metres").collect()}
    large = {r["id"] for r in thin.greedy_thin(df, ["hlb_id"], [F.col("id")], 8.0, "metres", limit=10).collect()}
    assert small == large and 5 < len(small) < 250
