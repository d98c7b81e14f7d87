"""Registered queries over survey tracks, with their SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockwalk.functions import geo
from blockwalk.operators import assign, trajectory
from blockwalk.operators.lineage import cut
from blockwalk.plans import bindings as b
from blockwalk.plans import sqltext as t
from blockwalk.plans.bindings import with_tables
from blockwalk.plans.spatial import _SROADS, _frac, survey_roads

_COORDS = ["lat", "lng"]


def _r(c, n):
    return F.round(c, n).alias(c)


def kalman(s, d):
    return trajectory.smooth(b.gps_points(s, d)).select("session_id", "point_id", _r("lat", 9), _r("lng", 9))


def stationarity(s, d):
    raw = b.gps_points(s, d)
    return trajectory.with_motion(trajectory.smooth(raw), count_on=raw).select("session_id", "point_id", "movement", "gps_quality", "stationary",
                                                             _r("bearing", 5))


def _raw_path(s, d):
    return b.gps_points(s, d).withColumns({"out_lat": F.col("lat"), "out_lng": F.col("lng")})


def path_thin(s, d):
    from blockwalk.operators import folds

    return folds.thin_path(_raw_path(s, d), ["session_id"], ["ts", "point_id"], trajectory.THIN_METRES).select("session_id", "point_id")


def path_length(s, d):
    return trajectory.path_length(_raw_path(s, d)).select("session_id", _r("distance_m", 4), "points")


def recorded_path(s, d):
    """The whole recorder: filter, stillness, quality, snapping, thinning."""
    raw = b.gps_points(s, d)
    motion = trajectory.with_motion(trajectory.smooth(raw), count_on=raw)
    return trajectory.kept_path(motion, survey_roads(s, d), count_on=raw).select(
        "session_id", "point_id", "on_road", "road_id", _r("out_lat", 7), _r("out_lng", 7))


def _broken_path(s, d):
    """Every fix on the path, snapped where it meets a road, with type changes and pauses by key."""
    near = cut(assign.snap_points(b.gps_points(s, d), survey_roads(s, d), "session_id", "point_id").select("session_id", "point_id", "road_id"))  # the path is read up to three times
    k = F.col("point_id")
    return _raw_path(s, d).join(near, ["session_id", "point_id"], "left").withColumns({
        "on_road": F.col("road_id").isNotNull() & (k % 4 == 0), "paused": k % 37 == 0,
        "road_type": F.when(F.floor(k / 900) % 2 == 0, "residential").otherwise("track")})


def segments(s, d):
    return trajectory.segments(_broken_path(s, d), count_on=b.gps_points(s, d)).select("session_id", "segment", "road_type", "part", "point_id")


def _shuttle(s, d):
    """Sessions walking a short lane to and fro, a day each way."""
    phase = (F.unix_seconds("ts") - 1704067200) % 172800 / F.lit(86400.0)
    x = F.when(phase < 1, phase).otherwise(2 - phase)
    raw = b.gps_points(s, d)
    fixes = raw.withColumns({"lat": F.lit(26.001) + x * 0.0008, "lng": F.lit(80.001) + x * 0.00001})
    return trajectory.with_motion(fixes, count_on=raw).withColumns({
        "out_lat": F.col("lat"), "out_lng": F.col("lng"), "on_road": F.lit(False), "paused": F.col("point_id") % 7 == 0})


def return_path(s, d):
    path, raw = _shuttle(s, d), b.gps_points(s, d)
    return trajectory.return_path(path, trajectory.segments(path, count_on=raw), count_on=raw).select("session_id", "point_id")


def _marks(s, d):
    e = F.col("event_id")
    return b.table(s, d, "events").select(
        F.col("user_id").alias("session_id"), e.alias("id"),
        F.when(e % 3 == 0, "pucca_house").when(e % 3 == 1, "kutcha_house").otherwise("apartment").alias("symbol_type"),
        b._lat(e % 1000).alias("lat"), b._lng(e % 1000).alias("lng"), (e % 9).cast("int").alias("number"))


def session_summary(s, d):
    path, raw = _broken_path(s, d), b.gps_points(s, d)
    sessions = raw.select("session_id").distinct()
    return trajectory.session_summary(sessions, path, trajectory.segments(path, count_on=raw), _marks(s, d), raw).withColumn("distance_m", _r("distance_m", 4))


def session_document(s, d):
    """Every session's map document, its parts read back from the text."""
    path, raw = _broken_path(s, d), b.gps_points(s, d)
    i = F.col("session_id").cast("string")
    square = F.format_string('{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[80.5,%s.0],[81.5,26.5],[80.5,%s.0]]]}}', i, i)
    sessions = raw.select("session_id").distinct().select(
        "session_id", F.when(F.col("session_id") % 4 != 0, F.concat(F.lit("HLB "), i)).alias("hlb_number"),
        F.when(F.col("session_id") % 5 != 0, square).when(F.col("session_id") % 2 == 0, "{broken").alias("polygon_geojson"),
        F.when(F.col("session_id") % 3 != 0, F.format_string('{"blocks":[{"id":%s,"label":"A"}],"forests":[%s,null],"landmarks":"none"}', i, i)).alias("drawn_features"),
        F.when(F.col("session_id") % 7 == 0, "paid").alias("payment_status"))
    docs = trajectory.session_document(sessions, _marks(s, d), trajectory.segment_lines(trajectory.segments(path, count_on=raw)))
    schema = ("hlbNumber string, center struct<lat: double, lng: double>, symbols array<struct<id: bigint, symbol_type: string, lat: double, lng: double, number: int>>,"
              " roads array<struct<id: bigint, highway: string, coords: array<struct<lat: double, lng: double>>, confirmed: boolean, source: string>>,"
              " boundaryPins array<struct<lat: double, lng: double>>, projectId bigint, isLive boolean, paymentStatus string")
    read = docs.select("session_id", "document", F.from_json("document", schema).alias("v"))
    listed = lambda a, f: F.array_join(F.transform(a, f), ",")
    part = lambda name: F.get_json_object("document", f"$.{name}").alias(name)
    return read.select(
        "session_id", "v.hlbNumber", F.col("v.center.lat").alias("center_lat"), F.col("v.center.lng").alias("center_lng"),
        listed("v.symbols", lambda x: F.concat_ws(":", x["id"], x["symbol_type"], x["number"])).alias("symbols"),
        F.round(F.aggregate("v.symbols", F.lit(0.0), lambda t, x: t + x["lat"] * 3 + x["lng"]), 6).alias("symbol_places"),
        listed("v.roads", lambda r: F.concat_ws(":", r["id"], r["highway"], F.size(r["coords"]), r["confirmed"], r["source"])).alias("roads"),
        F.round(F.aggregate("v.roads", F.lit(0.0), lambda t, r: t + F.aggregate(r["coords"], F.lit(0.0), lambda u, p: u + p["lat"] * 3 + p["lng"])), 5).alias("road_places"),
        *map(part, trajectory.DRAWN), listed("v.boundaryPins", lambda p: F.concat_ws("/", p["lat"].cast("int"), (p["lng"] * 10).cast("int"))).alias("boundary"),
        "v.projectId", "v.isLive", "v.paymentStatus")


def symbol_placement(s, d):
    k = F.col("event_id")
    wanted = b.table(s, d, "events").select(
        F.col("user_id").alias("session_id"), k.alias("placement_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(k % 4 == 0, "left").when(k % 4 == 1, "right").when(k % 4 == 2, "center").otherwise("compass").alias("direction"),
        (k % 360).cast("double").alias("heading"))
    walked = trajectory.with_motion(b.gps_points(s, d))
    path = walked.withColumns({"out_lat": F.col("lat"), "out_lng": F.col("lng")})
    return trajectory.place_symbols(wanted, walked, path).select("session_id", "placement_id", "direction", _r("lat", 9), _r("lng", 9))


def _lines(s, d):
    """One polyline per group of ten orders, a rounded zigzag."""
    k = F.col("o_orderkey")
    j = k % 10
    return b.table(s, d, "orders").select(
        F.floor(k / 10).cast("long").alias("line_id"), j.alias("i"),
        (F.lit(26.0) + j * 1e-4 + ((k * 7919) % 13) * 3e-6).alias("lat"),
        (F.lit(80.0) + F.when(j < 5, j).otherwise(10 - j) * 1e-4 + ((k * 31) % 11) * 3e-6).alias("lng"))


def chaikin(s, d):
    return trajectory.chaikin(_lines(s, d), ["line_id"]).select("line_id", "i", _r("lat", 12), _r("lng", 12))


def simplify(s, d):
    return trajectory.simplify(_lines(s, d), ["line_id"], 1.5e-5).select("line_id", "i")


def beautify(s, d):
    return trajectory.beautify(_lines(s, d), ["line_id"]).select("line_id", "i", _r("lat", 12), _r("lng", 12))


QUERIES = {f.__name__: f for f in (kalman, stationarity, path_thin, path_length, recorded_path, segments, return_path,
                                   session_summary, session_document, symbol_placement, chaikin, simplify, beautify)}

_KALMAN = """smoothed AS (SELECT session_id, unnest(list_reduce(
   list({'id': point_id, 'p': 0.0::DOUBLE, 'lat': lat, 'lng': lng, 'a': accuracy} ORDER BY ts, point_id),
   lambda acc, r: list_append(acc, (SELECT {'id': r.id, 'p': (1 - g) * q, 'lat': CASE WHEN len(acc) = 0 THEN r.lat ELSE acc[-1].lat + g * (r.lat - acc[-1].lat) END,
      'lng': CASE WHEN len(acc) = 0 THEN r.lng ELSE acc[-1].lng + g * (r.lng - acc[-1].lng) END, 'a': r.a})),
   CAST([] AS STRUCT(id BIGINT, p DOUBLE, lat DOUBLE, lng DOUBLE, a DOUBLE)[]))) AS k FROM gps_points GROUP BY 1)"""
_Q = "(coalesce(acc[-1].p, 1.0) + 0.0005::DOUBLE)"
_NOISE = "(CASE WHEN coalesce(r.a, 0) = 0 THEN 0.0005::DOUBLE ELSE r.a * r.a / 10 END)"
_G = f"({_Q} / ({_Q} + {_NOISE}))"
_KALMAN = f"""smoothed AS (SELECT session_id, unnest(list_reduce(
   list({{'id': point_id, 'p': 0.0::DOUBLE, 'lat': lat, 'lng': lng, 'a': accuracy}} ORDER BY ts, point_id),
   lambda acc, r: list_append(acc, {{'id': r.id, 'p': (1 - {_G}) * {_Q},
      'lat': CASE WHEN len(acc) = 0 THEN r.lat ELSE acc[-1].lat + {_G} * (r.lat - acc[-1].lat) END,
      'lng': CASE WHEN len(acc) = 0 THEN r.lng ELSE acc[-1].lng + {_G} * (r.lng - acc[-1].lng) END, 'a': r.a}}),
   CAST([] AS STRUCT(id BIGINT, p DOUBLE, lat DOUBLE, lng DOUBLE, a DOUBLE)[]))) AS k FROM gps_points GROUP BY 1)"""


def _motion(src: str, out: str) -> str:
    far = t.hav('p.lat', 'p.lng', 'cy', 'cx', 6371008.8)
    return f"""{out} AS (SELECT *, CASE WHEN speed > 8.3 THEN 'vehicle' WHEN speed > 4.2 THEN 'bicycle' WHEN speed > 2 THEN 'fast_walk'
         WHEN accuracy > 20 THEN 'poor_gps' ELSE 'walking' END AS movement,
         CASE WHEN accuracy > 50 THEN 'poor' WHEN accuracy > 30 THEN 'reduced' ELSE 'good' END AS gps_quality,
         len(b5) = 5 AND list_max(list_transform(b5, lambda p: {far})) < 1.0 AS stationary,
         CASE WHEN len(b5) < 2 THEN 0.0 ELSE {t.bearing('b5[1].lat', 'b5[1].lng', 'lat', 'lng')} END AS bearing
       FROM (SELECT *, list_sum(list_transform(b5, lambda p: p.lat)) / 5 AS cy, list_sum(list_transform(b5, lambda p: p.lng)) / 5 AS cx
             FROM (SELECT *, list({{'lat': lat, 'lng': lng}}) OVER (PARTITION BY session_id ORDER BY ts, point_id
                          ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS b5 FROM {src})))"""


_SNAP = f"""{_SROADS}, near AS (SELECT DISTINCT p.point_id, p.lat, p.lng, v.road_id FROM {{src}} p JOIN sv v
    ON abs(v.lat - p.lat) < 0.0002 AND abs(v.lng - p.lng) < 0.0002),
  snap AS (SELECT *, ay + f * (by_ - ay) AS sy, ax + f * (bx - ax) AS sx FROM (
    SELECT *, {_frac('lat', 'lng', 'ay', 'ax', 'by_', 'bx')} AS f FROM (
      SELECT n.*, g.ay, g.ax, g.by_, g.bx, g.i, {t.seg_dist_m('n.lat', 'n.lng', 'g.ay', 'g.ax', 'g.by_', 'g.bx')} AS dist
      FROM near n JOIN sg g USING (road_id)) QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY dist, road_id, i) = 1) WHERE dist <= 10)"""


def _thinned(src, gap):
    return f"""SELECT session_id, unnest(list_reduce(list({{'id': point_id, 'lat': lat, 'lng': lng, 'oy': oy, 'ox': ox}} ORDER BY ts, point_id),
      lambda acc, r: CASE WHEN len(acc) = 0 OR {t.hav('acc[-1].oy', 'acc[-1].ox', 'r.lat', 'r.lng')} >= {gap} THEN list_append(acc, r) ELSE acc END,
      CAST([] AS STRUCT(id BIGINT, lat DOUBLE, lng DOUBLE, oy DOUBLE, ox DOUBLE)[]))) AS k FROM {src} GROUP BY 1"""


def _segments(src):
    """Segment rows (part 0 is a seed) of a path with on_road, paused and road_type."""
    return f"""lg AS (SELECT *, lag(on_road) OVER w AS pr, lag(road_type) OVER w AS pt, lag(point_id) OVER w AS pid, lag(ts) OVER w AS pts,
        lag(lat) OVER w AS plat, lag(lng) OVER w AS plng FROM {src} WINDOW w AS (PARTITION BY session_id ORDER BY ts, point_id)),
    bk AS (SELECT *, CASE WHEN NOT on_road AND (coalesce(pr, false) OR paused OR coalesce(pt <> road_type, false)) THEN 1 ELSE 0 END AS brk FROM lg),
    sgm AS (SELECT *, sum(brk) OVER (PARTITION BY session_id ORDER BY ts, point_id ROWS UNBOUNDED PRECEDING) AS segment FROM bk),
    pts AS (SELECT session_id, segment, road_type, 1 AS part, point_id, ts, lat, lng FROM sgm WHERE NOT on_road
      UNION ALL SELECT session_id, segment, road_type, 0, pid, pts, plat, plng FROM sgm WHERE NOT on_road AND NOT coalesce(pr, false)
        AND pid IS NOT NULL AND (paused OR coalesce(pt <> road_type, false))),
    segs AS (SELECT * FROM pts QUALIFY count(*) OVER (PARTITION BY session_id, segment) >= 2)"""


_BROKEN = _SNAP.format(src="gps_points") + """,
  path AS (SELECT p.*, n.road_id IS NOT NULL AND p.point_id % 4 = 0 AS on_road, p.point_id % 37 = 0 AS paused,
           CASE WHEN (p.point_id // 900) % 2 = 0 THEN 'residential' ELSE 'track' END AS road_type
           FROM gps_points p LEFT JOIN snap n ON n.point_id = p.point_id), """ + _segments("path")
_LEN = f"""len AS (SELECT session_id, sum(CASE WHEN pla IS NULL THEN 0 ELSE {t.hav('pla', 'pln', 'lat', 'lng')} END) AS m, count(*) AS n, min(ts) AS t0, max(ts) AS t1
   FROM (SELECT *, lag(lat) OVER w AS pla, lag(lng) OVER w AS pln FROM gps_points
         WINDOW w AS (PARTITION BY session_id ORDER BY ts, point_id)) GROUP BY 1)"""
_MARKS = """marks AS (SELECT user_id AS session_id, count(*) AS n, count(*) FILTER (WHERE event_id % 3 IN (0, 1)) AS houses
   FROM events GROUP BY 1)"""


_VERTICES = """SELECT o_orderkey // 10 AS line_id, o_orderkey % 10 AS i,
            26.0 + (o_orderkey % 10) * 1e-4 + ((o_orderkey * 7919) % 13) * 3e-6 AS lat,
            80.0 + (CASE WHEN o_orderkey % 10 < 5 THEN o_orderkey % 10 ELSE 10 - o_orderkey % 10 END) * 1e-4 + ((o_orderkey * 31) % 11) * 3e-6 AS lng FROM orders"""


def _deviating(tolerance):
    """Kept vertices of ln as (line_id, i): intervals split at their farthest vertex, the first of equals."""
    return f"""iv(line_id, lo, hi) AS (SELECT line_id, min(i), max(i) FROM ln GROUP BY 1
        UNION ALL SELECT line_id, unnest([lo, mid]), unnest([mid, hi]) FROM (
          SELECT line_id, lo, hi, arg_min(i, -d * 1e18::DOUBLE + i * 1e-9::DOUBLE) AS mid, max(d) AS far FROM (
            SELECT *, pow(px - t * dx, 2) + pow(py - t * dy, 2) AS d FROM (
              SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, (px * dx + py * dy) / (dx * dx + dy * dy))) ELSE 0 END AS t FROM (
                SELECT v.line_id, v.lo, v.hi, p.i, p.lng - a.lng AS px, p.lat - a.lat AS py, z.lng - a.lng AS dx, z.lat - a.lat AS dy
                FROM iv v JOIN ln a ON a.line_id = v.line_id AND a.i = v.lo JOIN ln z ON z.line_id = v.line_id AND z.i = v.hi
                JOIN ln p ON p.line_id = v.line_id AND p.i > v.lo AND p.i < v.hi))) GROUP BY 1, 2, 3) WHERE far > pow({tolerance}::DOUBLE, 2)),
      stays AS (SELECT line_id, lo AS i FROM iv UNION SELECT line_id, hi FROM iv)"""


def _cut_corners(n):
    """One pass of corner cutting from p<n-1> to p<n>."""
    return f"""w{n} AS (SELECT *, lag(lat) OVER p AS pl, lag(lng) OVER p AS pg, lead(lat) OVER p AS nl, lead(lng) OVER p AS ng,
          count(*) OVER (PARTITION BY line_id) AS vertices FROM p{n - 1} WINDOW p AS (PARTITION BY line_id ORDER BY i)),
        a{n} AS (SELECT *, abs(({t.bearing('lat', 'lng', 'nl', 'ng')} - {t.bearing('pl', 'pg', 'lat', 'lng')} + 1080 + 180) % 360 - 180) AS turn FROM w{n}),
        p{n} AS (SELECT line_id, i * 3 AS i, lat, lng FROM a{n} WHERE pl IS NULL OR nl IS NULL OR turn < 12 OR vertices < 3
          UNION ALL SELECT line_id, i * 3 + k, f * lat + (1 - f) * nl, f * lng + (1 - f) * ng
          FROM a{n}, (VALUES (1, 0.75), (2, 0.25)) q(k, f) WHERE nl IS NOT NULL AND (pl IS NULL OR turn >= 12) AND vertices >= 3)"""


CHECKS = {
    "kalman": with_tables("gps_points", query=f"""
        , {_KALMAN} SELECT session_id, k.id AS point_id, round(k.lat, 9) AS lat, round(k.lng, 9) AS lng FROM smoothed"""),
    "stationarity": with_tables("gps_points", query=f"""
        , {_KALMAN}, sm AS (SELECT g.session_id, g.point_id, g.ts, s.k.lat AS lat, s.k.lng AS lng, g.accuracy, g.speed
            FROM gps_points g JOIN smoothed s ON s.k.id = g.point_id),
        {_motion('sm', 'm')} SELECT session_id, point_id, movement, gps_quality, stationary, round(bearing, 5) AS bearing FROM m"""),
    "path_thin": with_tables("gps_points", query=f"""
        , src AS (SELECT *, lat AS oy, lng AS ox FROM gps_points), kept AS ({_thinned('src', 0.8)})
        SELECT session_id, k.id AS point_id FROM kept"""),
    "path_length": with_tables("gps_points", query=f", {_LEN} SELECT session_id, round(m, 4) AS distance_m, n AS points FROM len"),
    "recorded_path": with_tables("gps_points", query=f"""
        , {_KALMAN}, sm AS (SELECT g.session_id, g.point_id, g.ts, s.k.lat AS lat, s.k.lng AS lng, g.accuracy, g.speed
            FROM gps_points g JOIN smoothed s ON s.k.id = g.point_id),
        {_motion('sm', 'mo')}, rec AS (SELECT * FROM mo WHERE NOT stationary AND accuracy <= 50 AND movement IN ('walking', 'fast_walk')),
        {_SNAP.format(src='rec')},
        src AS (SELECT r.*, n.road_id, coalesce(n.sy, r.lat) AS oy, coalesce(n.sx, r.lng) AS ox FROM rec r LEFT JOIN snap n ON n.point_id = r.point_id),
        kept AS ({_thinned('src', 0.8)})
        SELECT k2.session_id, k2.k.id AS point_id, road_id IS NOT NULL AS on_road, road_id, round(src.oy, 7) AS out_lat, round(src.ox, 7) AS out_lng
        FROM kept k2 JOIN src ON src.point_id = k2.k.id"""),
    "segments": with_tables("gps_points", query=f"""
        , {_BROKEN} SELECT session_id, CAST(segment AS BIGINT) AS segment, road_type, CAST(part AS INT) AS part, point_id FROM segs"""),
    "return_path": with_tables("gps_points", query=f"""
        , sh AS (SELECT session_id, point_id, ts, accuracy, speed, 26.001 + x * 0.0008::DOUBLE AS lat, 80.001 + x * 0.00001::DOUBLE AS lng
          FROM (SELECT *, CASE WHEN ph < 1 THEN ph ELSE 2 - ph END AS x FROM (
            SELECT *, CAST((floor(epoch(ts)) - 1704067200) AS BIGINT) % 172800 / 86400.0::DOUBLE AS ph FROM gps_points))),
        {_motion('sh', 'm')},
        path AS (SELECT *, false AS on_road, point_id % 7 = 0 AS paused, 'residential' AS road_type FROM m), {_segments('path')},
        lgs AS (SELECT *, max(ts) OVER (PARTITION BY session_id, segment) AS fin,
                  lead(lat) OVER w AS nla, lead(lng) OVER w AS nln FROM segs WINDOW w AS (PARTITION BY session_id, segment ORDER BY ts, point_id, part)),
        wy AS (SELECT session_id, lat, lng, fin, {t.bearing('lat', 'lng', 'nla', 'nln')} AS way FROM lgs WHERE nla IS NOT NULL),
        late AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, point_id) AS n FROM path) WHERE n > 30)
        SELECT l.session_id, arg_min(l.point_id, epoch_us(l.ts)) AS point_id FROM late l JOIN wy ON wy.session_id = l.session_id AND wy.fin < l.ts
          AND {t.hav('l.lat', 'l.lng', 'wy.lat', 'wy.lng')} < 5
          AND (CASE WHEN abs(l.bearing - way) > 180 THEN 360 - abs(l.bearing - way) ELSE abs(l.bearing - way) END) > 150 GROUP BY 1"""),
    "session_summary": with_tables("gps_points", query=f"""
        , {_BROKEN}, {_LEN}, {_MARKS}, sc AS (SELECT session_id, count(DISTINCT segment) AS n FROM segs GROUP BY 1)
        SELECT l.session_id, round(m, 4) AS distance_m, CAST(floor(epoch(t1)) - floor(epoch(t0)) AS BIGINT) AS duration_s,
               coalesce(houses, 0) AS house_count, coalesce(sc.n, 0) AS road_count, l.n AS gps_point_count
        FROM len l LEFT JOIN marks USING (session_id) LEFT JOIN sc USING (session_id)"""),
    "session_document": with_tables("gps_points", query=f"""
        , {_BROKEN},
        ln AS (SELECT session_id, segment, any_value(road_type) AS road_type, count(*) AS n, sum(lat * 3 + lng) AS spot FROM segs GROUP BY 1, 2),
        rd AS (SELECT session_id, string_agg(segment || ':' || road_type || ':' || n || ':true:user', ',' ORDER BY segment) AS roads, sum(spot) AS spot FROM ln GROUP BY 1),
        mk AS (SELECT user_id AS session_id, sum(({b.LAT.format(k='event_id % 1000')}) * 3 + {b.LNG.format(k='event_id % 1000')}) AS spot,
            string_agg(event_id || ':' || ['pucca_house', 'kutcha_house', 'apartment'][event_id % 3 + 1] || ':' || event_id % 9, ',' ORDER BY event_id) AS symbols FROM events GROUP BY 1)
        SELECT session_id, CASE WHEN session_id % 4 <> 0 THEN 'HLB ' || session_id ELSE 'LIVE' END AS hlbNumber,
               CASE WHEN session_id % 5 <> 0 THEN session_id ELSE 26.4499 END AS center_lat, CASE WHEN session_id % 5 <> 0 THEN 80.5::DOUBLE ELSE 80.3319 END AS center_lng,
               coalesce(symbols, '') AS symbols, round(coalesce(mk.spot, 0), 6) AS symbol_places, coalesce(roads, '') AS roads, round(coalesce(rd.spot, 0), 5) AS road_places,
               CASE WHEN session_id % 3 <> 0 THEN '[{{"id":' || session_id || ',"label":"A"}}]' ELSE '[]' END AS blocks, '[]' AS "farmlandBlocks",
               CASE WHEN session_id % 3 <> 0 THEN '[' || session_id || ',null]' ELSE '[]' END AS forests, '[]' AS "waterBodies", '[]' AS "landuseAreas",
               CASE WHEN session_id % 3 <> 0 THEN 'none' ELSE '[]' END AS landmarks,
               CASE WHEN session_id % 5 <> 0 THEN session_id || '/805,26/815,' || session_id || '/805' ELSE '' END AS boundary,
               session_id AS projectId, true AS isLive, CASE WHEN session_id % 7 = 0 THEN 'paid' ELSE 'unpaid' END AS paymentStatus
        FROM (SELECT DISTINCT session_id FROM gps_points) LEFT JOIN mk USING (session_id) LEFT JOIN rd USING (session_id)"""),
    "symbol_placement": with_tables("gps_points", query=f"""
        , {_motion('gps_points', 'm')},
        w AS (SELECT user_id AS session_id, event_id AS k, ts FROM events),
        j AS (SELECT w.*, m.lat, m.lng, m.bearing FROM w ASOF JOIN m ON m.session_id = w.session_id AND m.ts <= w.ts),
        d AS (SELECT *, CASE k % 4 WHEN 2 THEN 0.0 WHEN 3 THEN 7.0 ELSE 3.0 END / 6371008.8::DOUBLE AS dd,
                radians(CASE k % 4 WHEN 0 THEN bearing - 90 WHEN 1 THEN bearing + 90 WHEN 3 THEN k % 360 ELSE 0 END) AS th FROM j)
        SELECT session_id, k AS placement_id, ['left', 'right', 'center', 'compass'][k % 4 + 1] AS direction, round(degrees(p2), 9) AS lat,
               round(lng + degrees(atan2(sin(th) * sin(dd) * cos(radians(lat)), cos(dd) - sin(radians(lat)) * sin(p2))), 9) AS lng
        FROM (SELECT *, asin(sin(radians(lat)) * cos(dd) + cos(radians(lat)) * sin(dd) * cos(th)) AS p2 FROM d)"""),
    "chaikin": f"""
        WITH p0 AS ({_VERTICES}),
        {', '.join(_cut_corners(n) for n in (1, 2, 3))}
        SELECT line_id, i, round(lat, 12) AS lat, round(lng, 12) AS lng FROM p3""",
    "simplify": f"WITH RECURSIVE ln AS ({_VERTICES}), {_deviating(1.5e-5)} SELECT line_id, i FROM stays",
    "beautify": f"""
        WITH RECURSIVE ln AS ({_VERTICES}), {_deviating(2.5 * 9e-6)}, p0 AS (SELECT ln.* FROM ln JOIN stays USING (line_id, i)),
        {', '.join(_cut_corners(n) for n in (1, 2, 3))}
        SELECT line_id, i, round(lat, 12) AS lat, round(lng, 12) AS lng FROM p3""",
}
