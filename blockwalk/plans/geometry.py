"""Registered geometry queries with their SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockwalk.functions import geo
from blockwalk.plans import bindings as b
from blockwalk.plans import sqltext as t
from blockwalk.plans.bindings import with_tables
from blockwalk.sources import footprints, osm


def _r(c, places=6):
    return F.round(c, places)


def boxes(symbols):
    """Bounding box of every area's symbols."""
    return symbols.groupBy("hlb_id").agg(F.min("lat").alias("south"), F.min("lng").alias("west"),
                                         F.max("lat").alias("north"), F.max("lng").alias("east"))


def bbox(s, d):
    box = boxes(b.symbols(s, d))
    return box.select("hlb_id", "south", "west", "north", "east",
                      geo.best_orientation("south", "west", "north", "east").alias("orientation"),
                      geo.capture_zoom(F.col("north") - F.col("south"), F.col("east") - F.col("west")).alias("zoom"),
                      geo.search_radius_m("south", "west", "north", "east").alias("radius"))


def point_in_polygon(s, d):
    edged = b.boundaries(s, d).select("hlb_id", geo.ring_edges(F.col("ring")).alias("edges"), "ring")
    return b.symbols(s, d).join(edged, "hlb_id").select(
        "hlb_id", "id", geo.point_in_edges("lat", "lng", F.col("edges")).alias("inside"),
        geo.near_ring("lat", "lng", F.col("ring")).alias("near"))


def block_rings(s, d):
    ring = F.when(F.size("points") >= 3, F.col("points")).otherwise(geo.bbox_ring("south", "west", "north", "east"))
    return b.blocks(s, d).select("hlb_id", "block_id", ring.alias("ring"))


def polygon_area(s, d):
    ring = F.col("ring")
    return block_rings(s, d).select(
        "hlb_id", "block_id", _r(geo.ring_area_m2(ring), 3).alias("area_m2"),
        _r(geo.vertex_mean(ring)["lat"]).alias("mean_lat"), _r(geo.vertex_mean(ring)["lng"]).alias("mean_lng"),
        _r(geo.longest_edge_angle(ring)).alias("angle"), _r(geo.longest_edge_bearing(ring)).alias("bearing"),
        geo.self_intersects(ring).alias("crosses_itself"))


def line_polygon(s, d):
    edged = b.boundaries(s, d).select("hlb_id", geo.ring_edges(F.col("ring")).alias("edges"))
    line = F.transform("geometry", lambda p: geo.point(p["lat"], p["lon"]))
    return b.osm_elements(s, d).filter("type = 'way'").withColumn("line", line).join(edged, "hlb_id") \
        .select("hlb_id", "id", geo.line_touches_ring(F.col("line"), F.col("edges")).alias("touches"))


def bearings(s, d):
    lat0, lng0 = F.lit(26.004), F.lit(80.004)
    there = geo.destination(lat0, lng0, F.lit(7.0), geo.bearing_deg(lat0, lng0, "lat", "lng"))
    return b.symbols(s, d).select(
        "id", _r(geo.haversine_m(lat0, lng0, "lat", "lng")).alias("great_circle"),
        _r(geo.equirect_m(lat0, lng0, "lat", "lng")).alias("flat"),
        _r(geo.bearing_deg(lat0, lng0, "lat", "lng")).alias("bearing"),
        _r(geo.readable_bearing(geo.bearing_deg(lat0, lng0, "lat", "lng"))).alias("label_bearing"),
        _r(geo.bearing_gap(geo.signed_bearing(lat0, lng0, "lat", "lng"), F.lit(-170.0))).alias("gap"),
        _r(there[0], 8).alias("step_lat"), _r(there[1], 8).alias("step_lng"))


def tiles(s, d):
    x, y = geo.tile_x("lng", 17), geo.tile_y("lat", 17)
    return b.symbols(s, d).select("id", x.cast("long").alias("x"), y.cast("long").alias("y"),
                                  geo.quadkey("lat", "lng", 12).alias("quadkey"),
                                  _r(geo.tile_lng(x, 17)).alias("west"), _r(geo.tile_lat(y, 17)).alias("north"))


def _wide_boxes(s, d):
    """A box of up to two degrees somewhere on the globe per order."""
    k = F.col("o_orderkey")
    south = (k * 31 % 1200) / F.lit(10.0) - 60.0
    west = (k * 77 % 3500) / F.lit(10.0) - 175.0
    return b.table(s, d, "orders").select(k.alias("hlb_id"), south.alias("south"), west.alias("west"),
                                          (south + (k % 20) / F.lit(10.0)).alias("north"),
                                          (west + (k % 17) / F.lit(10.0)).alias("east"))


def _index_lines(s, d):
    k = F.col("c_custkey")
    qk = geo.quadkey((k % 120) - 60.0, (k * 7 % 350) - 175.0, 9)
    size = F.when(k % 3 == 0, F.concat((k % 60).cast("string"), F.lit(".5MB"))) \
        .when(k % 3 == 1, F.concat((k % 900).cast("string"), F.lit("KB"))).otherwise(F.concat(k.cast("string"), F.lit("B")))
    url = F.concat(F.lit("tiles/"), qk, F.lit(".gz"))
    lines = b.table(s, d, "customer").select(k, F.concat_ws(",", F.lit("India"), qk, url, size).alias("value"))
    return osm.first_of_each(lines.withColumn("quadkey", qk), ["quadkey"], "c_custkey").select("value")


def tile_prune(s, d):
    wanted = footprints.tiles_for(_wide_boxes(s, d))
    return footprints.tile_counts(footprints.prune_tiles(wanted, footprints.tile_index(_index_lines(s, d))))


def quadkeys(s, d):
    full = footprints.tiles_for(_wide_boxes(s, d)).groupBy("hlb_id").agg(F.count(F.lit(1)).alias("tiles"),
                                                                       F.min("quadkey").alias("first_tile"))
    return full


def off_site(s, d):
    """Fixes farther than 200 m from the centre of mass of area 0."""
    centre = geo.area_centroid(F.col("ring"))
    at = b.boundaries(s, d).where("hlb_id = 0").select(centre["lat"].alias("lat"), centre["lng"].alias("lng")).first()  # one row
    far = geo.haversine_m("lat", "lng", F.lit(at["lat"]), F.lit(at["lng"]), geo.TURF_RADIUS_M)
    return b.gps_points(s, d).select(
        "session_id", "point_id", _r(far, 3).alias("metres"), (far > 200).alias("off_site"))


def sql_functions(s, d):
    """The registered SQL functions, called from SQL."""
    geo.register_sql_functions(s)
    b.symbols(s, d).createOrReplaceTempView("blockwalk_symbols")
    return s.sql("SELECT id, round(haversine_m(lat, lng, 26.0D, 80.0D), 6) AS m, round(equirect_m(lat, lng, 26.0D, 80.0D), 6) AS f,"
                 " round(bearing_deg(26.0D, 80.0D, lat, lng), 6) AS brg, tile_x(lng, 18) AS x, tile_y(lat, 18) AS y, quadkey(lat, lng, 12) AS qk,"
                 " round(ring_area_m2(array(named_struct('lat', lat, 'lng', lng), named_struct('lat', lat + 0.001D, 'lng', lng),"
                 " named_struct('lat', lat + 0.001D, 'lng', lng + 0.002D), named_struct('lat', lat, 'lng', lng + 0.001D * (1 + id % 3)))), 2) AS area"
                 " FROM blockwalk_symbols")


QUERIES = {f.__name__: f for f in (bbox, point_in_polygon, polygon_area, line_polygon, bearings, tiles, tile_prune,
                                   quadkeys, off_site, sql_functions)}

_Y = "CAST(floor((1 - ln(tan(radians({lat})) + 1 / cos(radians({lat}))) / pi()) / 2 * {n}) AS BIGINT)"
_X = "CAST(floor(({lng} + 180) / 360 * {n}) AS BIGINT)"
_QK = "list_aggregate([CAST(((({x}) >> i) & 1) + 2 * ((({y}) >> i) & 1) AS VARCHAR) FOR i IN range({z} - 1, -1, -1)], 'string_agg', '')"


def _qk(x, y, z):
    return _QK.format(x=x, y=y, z=z)


_WIDE = """wide AS (SELECT o_orderkey AS hlb_id, s AS south, w AS west, s + (o_orderkey % 20) / 10.0::DOUBLE AS north,
    w + (o_orderkey % 17) / 10.0::DOUBLE AS east FROM (SELECT *, (o_orderkey * 31 % 1200) / 10.0::DOUBLE - 60.0 AS s,
    (o_orderkey * 77 % 3500) / 10.0::DOUBLE - 175.0 AS w FROM orders)),
  corners AS (SELECT *, """ + ", ".join(
    f"{(_X if c in ('west', 'east') else _Y).format(lat=c, lng=c, n=512)} AS {n}"
    for c, n in (("west", "x0"), ("east", "x1"), ("north", "y0"), ("south", "y1"))) + " FROM wide)"
_BND = "SELECT hlb_id, i, lat, lng FROM boundary_points"
_BOXES = "(SELECT hlb_id, min(lat) AS south, min(lng) AS west, max(lat) AS north, max(lng) AS east FROM symbols GROUP BY 1)"

CHECKS = {
    "bbox": with_tables("symbols", query=f"""
        SELECT *, CASE WHEN (east - west) * 111320 * cos(radians((north + south) / 2)) >= 1.4 * (north - south) * 111320
               THEN 'landscape' ELSE 'portrait' END AS orientation,
               CASE WHEN north - south > 0.008 OR east - west > 0.012 THEN 16
                    WHEN north - south > 0.003 OR east - west > 0.005 THEN 17 ELSE 18 END AS zoom,
               least(50000.0::DOUBLE, ceil({t.hav('south', 'west', 'north', 'east')} / 2)) AS radius FROM {_BOXES}"""),
    "point_in_polygon": with_tables("symbols", "boundary_points", query=f"""
        , edges AS ({t.edges('boundary_points', 'hlb_id')})
        SELECT hlb_id, id, c % 2 = 1 AS inside, c % 2 = 1 OR close AS near FROM (
          SELECT s.hlb_id, s.id, count(*) FILTER (WHERE {t.crosses('s.lat', 's.lng')}) AS c,
                 bool_or(sqrt(pow(s.lat - e.yi, 2) + pow(s.lng - e.xi, 2)) < 0.0012) AS close
          FROM symbols s JOIN edges e ON e.hlb_id = s.hlb_id GROUP BY 1, 2)"""),
    "polygon_area": with_tables("blocks", "block_rings", query=f"""
        , e AS ({t.edges('block_rings', 'hlb_id, block_id')}),
        m AS (SELECT hlb_id, block_id, avg(lat) AS la, avg(lng) AS ln FROM block_rings GROUP BY 1, 2),
        l AS (SELECT hlb_id, block_id, CASE WHEN i = 0 THEN 3 ELSE i - 1 END AS edge, yj AS ay, xj AS ax, yi AS by_, xi AS bx FROM e),
        -- which edge is longest is known from the shape; ties are resolved on lengths rounded to a micrometre
        g AS (SELECT *, round(sqrt(pow((by_ - ay) * 111320, 2) + pow((bx - ax) * 111320 * cos(radians(ay)), 2)), 6) AS flat_len,
                     round({t.hav('ay', 'ax', 'by_', 'bx')}, 6) AS len FROM l)
        SELECT m.hlb_id, m.block_id, round(a.twice * 111320.0::DOUBLE * 111320 * cos(radians(la)) / 2, 3) AS area_m2,
               round(la, 6) AS mean_lat, round(ln, 6) AS mean_lng, round(p.ang, 6) AS angle, round(q.brg, 6) AS bearing,
               false AS crosses_itself
        FROM m JOIN (SELECT hlb_id, block_id, abs(sum((xj - 80) * (yi - 26) - (xi - 80) * (yj - 26))) AS twice FROM e GROUP BY 1, 2) a USING (hlb_id, block_id)
        JOIN (SELECT hlb_id, block_id, arg_max(atan2((by_ - ay) * 111320, (bx - ax) * 111320 * cos(radians(ay))),
                                             flat_len * 100 - edge * 1e-7) AS ang FROM g GROUP BY 1, 2) p USING (hlb_id, block_id)
        JOIN (SELECT hlb_id, block_id, arg_max(({t.bearing('ay', 'ax', 'by_', 'bx')} + 360) % 360, len * 100 - edge * 1e-7) AS brg
              FROM g GROUP BY 1, 2) q USING (hlb_id, block_id)"""),
    "line_polygon": with_tables("osm_elements", "boundary_points", query=f"""
        , edges AS ({t.edges('boundary_points', 'hlb_id')}),
        v AS (SELECT hlb_id, id, i, lat + (CASE WHEN i IN (2, 3) THEN d ELSE 0 END) AS lat,
                     lng + (CASE WHEN i IN (1, 2) THEN d ELSE 0 END) AS lng
              FROM osm_elements, (SELECT unnest([0, 1, 2, 3]) AS i) WHERE type = 'way'),
        inside AS (SELECT DISTINCT hlb_id, id FROM (SELECT v.hlb_id, v.id, v.i,
                     count(*) FILTER (WHERE {t.crosses('v.lat', 'v.lng')}) AS c
                   FROM v JOIN edges e ON e.hlb_id = v.hlb_id GROUP BY 1, 2, 3) WHERE c % 2 = 1),
        segs AS (SELECT a.hlb_id, a.id, a.lat AS ay, a.lng AS ax, z.lat AS by_, z.lng AS bx
                 FROM v a JOIN v z ON a.id = z.id AND z.i = a.i + 1),
        cross_ AS (SELECT DISTINCT g.hlb_id, g.id FROM segs g JOIN edges e ON e.hlb_id = g.hlb_id AND e.i > 0
                   AND {t.seg_cross('g.ay', 'g.ax', 'g.by_', 'g.bx', 'e.yj', 'e.xj', 'e.yi', 'e.xi')})
        SELECT o.hlb_id, o.id, n.id IS NOT NULL OR c.id IS NOT NULL AS touches FROM osm_elements o
        LEFT JOIN inside n ON n.id = o.id LEFT JOIN cross_ c ON c.id = o.id WHERE o.type = 'way'"""),
    "bearings": with_tables("symbols", query=f"""
        SELECT id, round({t.hav('26.004::DOUBLE', '80.004::DOUBLE', 'lat', 'lng')}, 6) AS great_circle,
               round({t.flat('26.004::DOUBLE', '80.004::DOUBLE', 'lat', 'lng')}, 6) AS flat,
               round(brg, 6) AS bearing, round(CASE WHEN brg > 90 AND brg <= 270 THEN (brg + 180) % 360 ELSE brg END, 6) AS label_bearing,
               round(CASE WHEN abs(sb + 170) > 180 THEN 360 - abs(sb + 170) ELSE abs(sb + 170) END, 6) AS gap,
               round(degrees(p2), 8) AS step_lat,
               round(80.004 + degrees(atan2(sin(radians(brg)) * sin(dd) * cos(p1), cos(dd) - sin(p1) * sin(p2))), 8) AS step_lng
        FROM (SELECT *, asin(sin(p1) * cos(dd) + cos(p1) * sin(dd) * cos(radians(brg))) AS p2
          FROM (SELECT *, (sb + 360) % 360 AS brg, radians(26.004::DOUBLE) AS p1, 7.0::DOUBLE / 6371008.8 AS dd
            FROM (SELECT *, {t.bearing('26.004::DOUBLE', '80.004::DOUBLE', 'lat', 'lng')} AS sb FROM symbols)))"""),
    "tiles": with_tables("symbols", query=f"""
        SELECT id, x, y, {_qk('x12', 'y12', 12)} AS quadkey, round(x / 131072.0::DOUBLE * 360 - 180, 6) AS west,
               round(degrees(atan((exp(n) - exp(-n)) / 2)), 6) AS north
        FROM (SELECT *, pi() - 2 * pi() * y / 131072.0::DOUBLE AS n FROM (SELECT id,
          {_X.format(lng='lng', n=131072)} AS x, {_Y.format(lat='lat', n=131072)} AS y,
          {_X.format(lng='lng', n=4096)} AS x12, {_Y.format(lat='lat', n=4096)} AS y12 FROM symbols))"""),
    "tile_prune": f"""
        WITH {_WIDE},
        need AS (SELECT DISTINCT hlb_id, {_qk('x', 'y', 9)} AS quadkey FROM (
          SELECT hlb_id, x, unnest(generate_series(y0, y1)) AS y FROM (
            SELECT hlb_id, y0, y1, unnest(generate_series(x0, x1)) AS x FROM corners))),
        idx AS (SELECT {_qk('x', 'y', 9)} AS quadkey, arg_min(mb, k) AS mb FROM (
          SELECT c_custkey AS k, {_X.format(lng='((c_custkey * 7 % 350) - 175.0::DOUBLE)', n=512)} AS x,
                 {_Y.format(lat='((c_custkey % 120) - 60.0::DOUBLE)', n=512)} AS y,
                 CASE c_custkey % 3 WHEN 0 THEN c_custkey % 60 + 0.5 WHEN 1 THEN (c_custkey % 900) / 1024.0
                      ELSE c_custkey / 1048576.0 END AS mb FROM customer) GROUP BY 1)
        SELECT hlb_id, count(*) FILTER (WHERE mb IS NOT NULL) AS tiles, count(*) FILTER (WHERE mb IS NULL) AS errors,
               0::BIGINT AS skipped FROM need LEFT JOIN idx USING (quadkey) GROUP BY 1""",
    "quadkeys": f"""
        WITH {_WIDE},
        q AS (SELECT hlb_id, {_qk('x', 'y', 9)} AS qk FROM (SELECT hlb_id, x, unnest(generate_series(y0, y1)) AS y FROM (
              SELECT *, unnest(generate_series(x0, x1)) AS x FROM corners)))
        SELECT hlb_id, count(*) AS tiles, min(qk) AS first_tile FROM q GROUP BY 1""",
    "off_site": with_tables("gps_points", "boundary_points", query=f"""
        , e AS ({t.edges('boundary_points', 'hlb_id')}),
        c AS (SELECT 26.0005 + sum((yi + yj - 2 * 26.0005) * w) / (3 * sum(w)) AS clat,
                     80.0005 + sum((xi + xj - 2 * 80.0005) * w) / (3 * sum(w)) AS clng
              FROM (SELECT *, (xj - 80.0005) * (yi - 26.0005) - (xi - 80.0005) * (yj - 26.0005) AS w FROM e WHERE hlb_id = 0))
        SELECT session_id, point_id, round(m, 3) AS metres, m > 200 AS off_site FROM (
          SELECT session_id, point_id, {t.hav('lat', 'lng', 'clat', 'clng', 6371008.8)} AS m FROM gps_points, c)"""),
    "sql_functions": with_tables("symbols", query=f"""
        SELECT id, round({t.hav('lat', 'lng', '26.0::DOUBLE', '80.0::DOUBLE')}, 6) AS m,
               round({t.flat('lat', 'lng', '26.0::DOUBLE', '80.0::DOUBLE')}, 6) AS f,
               round(({t.bearing('26.0::DOUBLE', '80.0::DOUBLE', 'lat', 'lng')} + 360) % 360, 6) AS brg,
               {_X.format(lng='lng', n=262144)} AS x, {_Y.format(lat='lat', n=262144)} AS y,
               {_QK.format(x=_X.format(lng='lng', n=4096), y=_Y.format(lat='lat', n=4096), z=12)} AS qk,
               round((0.002 + 0.001 * (1 + id % 3)) / 2 * 0.001::DOUBLE * pow(111320.0::DOUBLE, 2) * cos(radians(lat + 0.0005::DOUBLE)), 2) AS area FROM symbols"""),
}
