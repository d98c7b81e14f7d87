"""Golden geometry cases and sources."""

import math

import pytest
from conftest import ring
from pyspark.sql import functions as F

from blockwalk.functions import domain, geo
from blockwalk.operators import trajectory
from blockwalk.sources import footprints, osm, tables, texts

RING = "array<struct<lat:double,lng:double>>"
SQUARE = ring((26.0, 80.0), (26.0, 80.001), (26.001, 80.001), (26.001, 80.0))
BOW = ring((26.0, 80.0), (26.001, 80.001), (26.001, 80.0), (26.0, 80.001))


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.from_json(F.lit(_json(v)), RING).alias(k)
                                  for k, v in values.items()]).select(column.alias("v")).first()
    return row["v"]


def _json(v):
    import json

    return json.dumps(v)


def test_point_in_polygon(spark):
    df = spark.createDataFrame([(26.0005, 80.0005), (26.002, 80.002), (26.0005, 80.0011)], "lat double, lng double")
    df = df.withColumn("r", F.from_json(F.lit(_json(SQUARE)), RING))
    got = [r[0] for r in df.select(geo.point_in_ring("lat", "lng", F.col("r"))).collect()]
    assert got == [True, False, False]


def test_area(spark):
    a = one(spark, geo.ring_area_m2(F.col("r")), r=SQUARE)
    assert 9000 < a < 13000
    assert one(spark, geo.ring_area_m2(F.col("r")), r=SQUARE[::-1]) == pytest.approx(a)
    assert one(spark, geo.ring_area_m2(F.col("r")), r=SQUARE[:2]) == 0


def test_self_intersection(spark):
    assert one(spark, geo.self_intersects(F.col("r")), r=SQUARE) is False
    assert one(spark, geo.self_intersects(F.col("r")), r=SQUARE[:3]) is False
    assert one(spark, geo.self_intersects(F.col("r")), r=BOW) is True


def test_closing_edge_is_not_tested(spark):
    # a line that only meets the last-to-first edge of the ring
    line = ring((26.0005, 79.9995), (26.0005, 79.99999))
    through = ring((26.0005, 79.9995), (26.0005, 80.00001), (26.0005, 79.9995))
    v = geo.line_touches_ring(F.col("l"), geo.ring_edges(F.col("r")))
    assert one(spark, v, l=line, r=SQUARE) is False
    assert one(spark, v, l=through, r=SQUARE) is True  # a vertex lies inside


def test_point_segment(spark):
    df = spark.createDataFrame([(5.0, 0.0), (5.0, 4.0), (5.0, -3.0), (-3.0, 4.0), (13.0, 4.0)], "x double, y double")
    got = [r[0] for r in df.select(geo.point_segment("x", "y", 0.0, 0.0, 10.0, 0.0)).collect()]
    assert got == pytest.approx([0, 4, 3, 5, 5])


def test_tiles_round_trip(spark):
    key = one(spark, geo.quadkey("lat", "lng", 9), lat=26.45, lng=80.33)
    x = int("".join("1" if c in "13" else "0" for c in key), 2)
    y = int("".join("1" if c in "23" else "0" for c in key), 2)
    n = 2 ** 9
    assert x == int((80.33 + 180) / 360 * n)
    assert y == int((1 - math.log(math.tan(math.radians(26.45)) + 1 / math.cos(math.radians(26.45))) / math.pi) / 2 * n)


def test_sql_functions(spark):
    geo.register_sql_functions(spark)
    v = spark.sql("SELECT haversine_m(26D, 80D, 26D, 80.001D) AS m, tile_x(80D, 9) AS x").first()
    assert v["m"] == pytest.approx(99.94, abs=0.1) and v["x"] == int(260 / 360 * 512)


def test_simplify_keeps_ends(spark):
    rows = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 0.1, 10.0), (1, 2, 0.0, 20.0)], "k int, i int, lat double, lng double")
    assert sorted(r["i"] for r in trajectory.simplify(rows, ["k"], 0.5).collect()) == [0, 2]
    assert sorted(r["i"] for r in trajectory.simplify(rows, ["k"], 0.05).collect()) == [0, 1, 2]


@pytest.mark.parametrize("limit", [3, 100_000])
def test_simplify_equals_recursive(spark, limit):
    import random

    rnd = random.Random(3)
    lines = {k: [(rnd.uniform(0, 1), i + rnd.uniform(-.2, .2)) for i in range(12)] for k in range(3)}
    rows = spark.createDataFrame([(k, i, y, x) for k, pts in lines.items() for i, (y, x) in enumerate(pts)],
                                 "k int, i int, lat double, lng double")

    def seg2(p, a, b):
        dx, dy = b[1] - a[1], b[0] - a[0]
        t = max(0, min(1, ((p[1] - a[1]) * dx + (p[0] - a[0]) * dy) / (dx * dx + dy * dy)))
        return (p[1] - a[1] - t * dx) ** 2 + (p[0] - a[0] - t * dy) ** 2

    def rec(pts, lo, hi, tol, out):
        best, at = tol * tol, None
        for i in range(lo + 1, hi):
            d = seg2(pts[i], pts[lo], pts[hi])
            if d > best:
                best, at = d, i
        if at is not None:
            rec(pts, lo, at, tol, out)
            out.add(at)
            rec(pts, at, hi, tol, out)

    want = set()
    for k, pts in lines.items():
        out = {0, len(pts) - 1}
        rec(pts, 0, len(pts) - 1, 0.3, out)
        want |= {(k, i) for i in out}
    got = {(r["k"], r["i"]) for r in trajectory.simplify(rows, ["k"], 0.3, limit).collect()}
    assert got == want


def test_pixels(spark):
    df = spark.createDataFrame([(300, 400, 600, 800, 80.0, 81.0, 26.0, 27.0)],
                               "col int, row int, width int, height int, lon_at_x0 double, lon_at_x1 double, lat_at_y0 double, lat_at_y1 double")
    r = texts.pixels_to_lnglat(df).first()
    assert (r["lng"], r["lat"]) == pytest.approx((80.5, 26.5))


def test_geopdf_header(spark, tmp_path):
    head = b"%PDF junk \xff\xfe /BBox [0 0 600 800] /GPTS [26.0 80.0 26.1 80.0 26.1 80.1 26.0 80.1] /LPTS [0 0 0 1 1 1 1 0] \x00"
    (tmp_path / "a.pdf").write_bytes(head)
    (tmp_path / "b.pdf").write_bytes(b"%PDF nothing here")
    rows = texts.georeference(texts.read_pdf_headers(spark, str(tmp_path))).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["lon_at_x0"], r["lon_at_x1"], r["lat_at_y0"], r["lat_at_y1"]) == pytest.approx((80.0, 80.1, 26.0, 26.1))


def test_range_labels(spark):
    df = spark.createDataFrame([(12, 1), (10, 3), (100, 8), (None, 1)], "n int, u int")
    got = [r[0] for r in df.select(domain.house_label(F.col("n"), F.col("u"), F.lit(None), False)).collect()]
    assert got == ["12", "10-12", "100-107", ""]


def test_excel_labels(spark):
    df = spark.createDataFrame([(0,), (25,), (26,), (701,), (702,), (728,)], "i long")
    assert [r[0] for r in df.select(domain.excel_label(F.col("i"))).collect()] == ["A", "Z", "AA", "ZZ", "AAA", "ABA"]


def test_shape_and_residential(spark):
    t = "t string, w int, r int, res boolean, old int, new int"
    df = spark.createDataFrame([
        ("kutcha_house", None, None, None, None, None), ("pucca_house", 1, 1, None, None, None), ("apartment", 1, 1, None, None, None),
        ("temple", 1, 1, None, None, None), ("temple", 1, None, None, None, None), ("temple", 6, 1, None, None, None),
        ("pucca_house", None, None, False, 1, 1), ("pucca_house", None, None, True, 3, 3), ("pucca_house", None, None, None, 3, 1),
        ("non_residential", None, None, None, None, 2), ("non_residential", None, None, None, None, None)], t)
    c = F.col
    got = df.select(domain.building_shape(c("t"), c("w"), c("r")).alias("s"),
                    domain.is_non_residential(c("res"), c("old"), c("new"), c("t")).alias("n")).collect()
    assert [r["s"] for r in got][:6] == ["triangle", "square", "square", "triangle", "square", "square"]
    assert [r["n"] for r in got][6:] == [True, False, True, False, True]


def test_names(spark):
    df = spark.createDataFrame([({"name": "A", "name:hi": "B"},), ({"name:zz": "Z", "name:te": "T"},), ({"name:zz": "Z", "name:aa": "Y"},),
                                ({"x": "1"},), ({"name": ""},)], "tags map<string,string>")
    assert [r[0] for r in df.select(domain.element_name(F.col("tags"))).collect()] == ["A", "T", "Y", None, None]


def test_csv_round_trip(spark, tmp_path):
    import datetime as dt

    df = spark.createDataFrame([(1, 'a,"b"\nc', None), (2, "plain", "x")], "id int, t string, n string")
    lines = [r[0] for r in tables.csv_lines(df).collect()]
    assert lines == ["id,t,n", '1,"a,""b""\nc",', "2,plain,x"]
    path = tables.write_csv(df, str(tmp_path), "users", dt.date(2024, 1, 2))
    assert path.endswith("users-2024-01-02.csv")
    back = spark.read.options(header=True, multiLine=True, escape='"').csv(path).orderBy("id").collect()
    assert back[0]["t"] == 'a,"b"\nc' and back[0]["n"] is None
    assert tables.write_csv(df.limit(0), str(tmp_path), "none", dt.date(2024, 1, 2)) is None


def test_dump_files(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"elements":[{"type":"node","id":1,"lat":26.0,"lon":80.0,"tags":{"name":"A"}}]}')
    (tmp_path / "html.json").write_text("  <html>busy</html>")
    (tmp_path / "err.json").write_text("Error: runtime error")
    (tmp_path / "bad.json").write_text("{oops")
    checked = osm.check_dumps(osm.read_dumps(spark, str(tmp_path)))
    assert osm.elements(checked).count() == 1
    assert checked.filter("error IS NOT NULL").count() == 3


def test_footprint_tiles(spark, tmp_path):
    import gzip

    good = '{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[80.0001,26.0001],[80.0002,26.0001],[80.0002,26.0002],[80.0001,26.0001]]]}}'
    with gzip.open(tmp_path / "t.csv.gz", "wt") as f:
        f.write("\n".join([good, "", "{bad", good.replace("80.000", "81.000")]))  # last line has no newline
    areas = spark.createDataFrame([(7, SQUARE)], f"hlb_id long, ring {RING}")
    got = footprints.clip(footprints.parse_lines(footprints.read_lines(spark, str(tmp_path))), areas, "microsoft").collect()
    assert len(got) == 1 and got[0]["hlb_id"] == 7 and got[0]["source"] == "microsoft" and got[0]["area_sqm"] > 0


def test_tile_index(spark):
    lines = spark.createDataFrame([("India,123,u1,36.5MB",), ("India,124,u2,512KB",), ("India,125,u3,2097152B",), ("short,1",), ("India,126,u4,odd",)], "value string")
    got = {r["quadkey"]: r["size_mb"] for r in footprints.tile_index(lines).collect()}
    assert got == {"123": 36.5, "124": 0.5, "125": 2.0, "126": 0.0}


def test_full_cover_finds_inner_tiles(spark):
    box = spark.createDataFrame([(1, 10.0, 70.0, 14.0, 76.0)], "hlb_id long, south double, west double, north double, east double")
    corners = footprints.tiles_for(box, full_cover=False).count()
    assert corners == 4 and footprints.tiles_for(box).count() > 4


def test_session_store(spark, tmp_path):
    pts = spark.createDataFrame([(s, i, float(i)) for s in range(5) for i in range(10)], "session_id long, point_id long, v double")
    tables.write_sessions(pts, str(tmp_path / "s"), 7)
    tables.write_sessions(pts.withColumn("point_id", pts.point_id + 100), str(tmp_path / "s"))
    assert tables.read_session(spark, str(tmp_path / "s"), 3).count() == 20
    merged = tables.merge_latest(spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id int, state string, n int"),
                                 spark.createDataFrame([(2, "c", None), (3, "d", 9)], "id int, state string, n int"), ["id"])
    assert {tuple(r) for r in merged.collect()} == {(1, "a", 5), (2, "c", 6), (3, "d", 9)}
    assert tables.without_keys(pts, spark.createDataFrame([(3,)], "session_id long"), ["session_id"]).count() == 40
