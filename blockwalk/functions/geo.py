"""Geodesy and planar geometry as Spark column expressions.

Points are a pair of double columns (lat, lng).  Rings and lines are
``ARRAY<STRUCT<lat DOUBLE, lng DOUBLE>>``; rings are open (the first vertex is
not repeated).  Everything here stays in the JVM: plain arithmetic where a
fixed number of operands is involved and higher-order functions over arrays.

Polygon predicates take the *edge array* of a ring (see :func:`ring_edges`), so
that it is computed once per polygon and not once per joined row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The metre models used by the survey maps.
EARTH_RADIUS_M = 6371000.0
TURF_RADIUS_M = 6371008.8
METRES_PER_DEGREE = 111320.0
GRID_METRES_PER_DEGREE = 111111.0


def _c(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(float(value))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it in ``body``.

    The optimizer copies a projected expression into every place that reads it,
    and a lambda evaluates its copy per array element; a lambda variable does not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


# ---------------------------------------------------------------- distances

def haversine_m(lat1, lng1, lat2, lng2, radius: float = EARTH_RADIUS_M) -> Column:
    """Great-circle distance in metres."""
    lat1, lng1, lat2, lng2 = map(_c, (lat1, lng1, lat2, lng2))
    s_lat = F.sin(F.radians(lat2 - lat1) / 2)
    s_lng = F.sin(F.radians(lng2 - lng1) / 2)
    h = s_lat * s_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s_lng * s_lng
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def equirect_m(lat1, lng1, lat2, lng2) -> Column:
    """Flat distance in metres, longitude scaled at the mean latitude of the pair."""
    lat1, lng1, lat2, lng2 = map(_c, (lat1, lng1, lat2, lng2))
    dx = (lng2 - lng1) * METRES_PER_DEGREE * F.cos(F.radians((lat1 + lat2) / 2))
    dy = (lat2 - lat1) * METRES_PER_DEGREE
    return F.sqrt(dx * dx + dy * dy)


def degree_distance(lat1, lng1, lat2, lng2) -> Column:
    lat1, lng1, lat2, lng2 = map(_c, (lat1, lng1, lat2, lng2))
    return F.sqrt((lat1 - lat2) * (lat1 - lat2) + (lng1 - lng2) * (lng1 - lng2))


# ----------------------------------------------------------------- bearings

def signed_bearing(lat1, lng1, lat2, lng2) -> Column:
    """Initial bearing in degrees, -180..180."""
    lat1, lng1, lat2, lng2 = map(_c, (lat1, lng1, lat2, lng2))
    d = F.radians(lng2 - lng1)
    p1, p2 = F.radians(lat1), F.radians(lat2)
    y = F.sin(d) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d)
    return F.degrees(F.atan2(y, x))


def bearing_deg(lat1, lng1, lat2, lng2) -> Column:
    """Initial bearing in degrees, 0..360."""
    return (signed_bearing(lat1, lng1, lat2, lng2) + 360.0) % F.lit(360.0)


def readable_bearing(bearing) -> Column:
    """Turn a bearing that would print a label upside down."""
    b = _c(bearing)
    return F.when((b > 90) & (b <= 270), (b + 180.0) % F.lit(360.0)).otherwise(b)


def turn_angle(before, after) -> Column:
    """Signed turn between two 0..360 bearings, in -180..180."""
    return F.pmod(_c(after) - _c(before) + 540.0, F.lit(360.0)) - 180.0


def bearing_gap(a, b) -> Column:
    """Unsigned gap between two bearings; gaps above 180 fold back once."""
    d = F.abs(_c(a) - _c(b))
    return F.when(d > 180, 360.0 - d).otherwise(d)


def destination(lat, lng, metres, bearing) -> tuple[Column, Column]:
    """Point reached from (lat, lng) after ``metres`` along ``bearing``."""
    lat, lng, metres, bearing = map(_c, (lat, lng, metres, bearing))
    p, t, d = F.radians(lat), F.radians(bearing), metres / TURF_RADIUS_M
    p2 = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(t))
    l2 = F.radians(lng) + F.atan2(F.sin(t) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(p2))
    return F.degrees(p2), F.degrees(l2)


# -------------------------------------------------------------------- rings

def point(lat, lng) -> Column:
    return F.struct(_c(lat).alias("lat"), _c(lng).alias("lng"))


def open_ring(ring: Column) -> Column:
    """Drop the closing vertex of a ring that repeats its first point."""
    n = F.size(ring)
    return F.when((n > 1) & (F.element_at(ring, 1) == F.element_at(ring, -1)),
                  F.slice(ring, F.lit(1), n - 1)).otherwise(ring)


def ring_edges(ring: Column) -> Column:
    """Edges of a ring as structs (yi, xi, yj, xj): each vertex with the one before it."""
    before = F.concat(F.slice(ring, F.size(ring), F.lit(1)), F.slice(ring, F.lit(1), F.size(ring) - 1))
    edge = lambda a, b: F.struct(a["lat"].alias("yi"), a["lng"].alias("xi"),
                                 b["lat"].alias("yj"), b["lng"].alias("xj"))
    return F.when(F.size(ring) > 0, F.zip_with(ring, before, edge))


def inside_edges(p: Column, edges: Column) -> Column:
    """Even-odd ray test with the half-open edge rule, for a point struct bound by :func:`let`."""
    def crosses(e):
        spans = (e["yi"] > p["lat"]) != (e["yj"] > p["lat"])
        at = (e["xj"] - e["xi"]) * (p["lat"] - e["yi"]) / (e["yj"] - e["yi"]) + e["xi"]
        return F.coalesce(spans & (p["lng"] < at), F.lit(False))

    return F.size(F.filter(edges, crosses)) % 2 == 1


def point_in_edges(lat, lng, edges: Column) -> Column:
    return let(point(lat, lng), lambda p: inside_edges(p, edges))


def point_in_ring(lat, lng, ring: Column) -> Column:
    return point_in_edges(lat, lng, ring_edges(ring))


def in_bbox(lat, lng, south, west, north, east) -> Column:
    lat, lng = _c(lat), _c(lng)
    return lat.between(_c(south), _c(north)) & lng.between(_c(west), _c(east))


def segments_cross(ay, ax, by, bx, cy, cx, dy, dx) -> Column:
    """Do segments a-b and c-d touch?  Parallel lines (|det| < 1e-12) never do."""
    det = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
    t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / det
    u = -((bx - ax) * (cy - ay) - (by - ay) * (cx - ax)) / det
    return F.when(F.abs(det) < 1e-12, F.lit(False)).otherwise(t.between(0.0, 1.0) & u.between(0.0, 1.0))


def line_segments(line: Column) -> Column:
    """Consecutive vertex pairs of a line as structs (yi, xi, yj, xj); j is the earlier vertex."""
    n = F.size(line)
    edge = lambda a, b: F.struct(b["lat"].alias("yi"), b["lng"].alias("xi"),
                                 a["lat"].alias("yj"), a["lng"].alias("xj"))
    return F.when(n > 1, F.zip_with(F.slice(line, F.lit(1), n - 1), F.slice(line, F.lit(2), n - 1), edge)) \
            .otherwise(F.array().cast("array<struct<yi:double,xi:double,yj:double,xj:double>>"))


def line_touches_ring(line: Column, edges: Column) -> Column:
    """A vertex lies inside, or a segment crosses an edge.  The closing edge is not tested."""
    def test(w):
        open_edges = F.slice(w["e"], F.lit(2), F.greatest(F.size(w["e"]) - 1, F.lit(0)))
        inside = F.exists(w["l"], lambda p: inside_edges(p, w["e"]))
        return inside | let(open_edges, lambda o: _any_cross(line_segments(w["l"]), o))

    return let(F.struct(line.alias("l"), edges.alias("e")), test)


def _any_cross(segments: Column, edges: Column) -> Column:
    return F.exists(segments, lambda s: F.exists(edges, lambda e: segments_cross(
        s["yj"], s["xj"], s["yi"], s["xi"], e["yj"], e["xj"], e["yi"], e["xi"])))


def self_intersects(ring: Column) -> Column:
    """Any two non-adjacent edges of the ring touch; fewer than 4 vertices never do."""
    n = F.size(ring)
    starts = F.transform(ring, lambda p, i: F.struct(
        i.alias("i"), p["lat"].alias("ay"), p["lng"].alias("ax"),
        F.get(ring, (i + 1) % n)["lat"].alias("by"), F.get(ring, (i + 1) % n)["lng"].alias("bx")))
    hit = let(starts, lambda edges: F.exists(edges, lambda a: F.exists(edges, lambda b: (
        (b["i"] >= a["i"] + 2) & ~((a["i"] == 0) & (b["i"] == F.size(edges) - 1))
        & segments_cross(a["ay"], a["ax"], a["by"], a["bx"], b["ay"], b["ax"], b["by"], b["bx"])))))
    return F.when(n < 4, F.lit(False)).otherwise(hit)


def near_ring(lat, lng, ring: Column, degrees: float = 0.0012) -> Column:
    """Inside the ring, or within ``degrees`` of one of its vertices."""
    return let(point(lat, lng), lambda q: inside_edges(q, ring_edges(ring)) | F.exists(
        ring, lambda p: degree_distance(q["lat"], q["lng"], p["lat"], p["lng"]) < degrees))


def _total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + x)


def vertex_mean(ring: Column) -> Column:
    n = F.size(ring)
    return F.struct((_total(F.transform(ring, lambda p: p["lat"])) / n).alias("lat"),
                    (_total(F.transform(ring, lambda p: p["lng"])) / n).alias("lng"))


def ring_area_m2(ring: Column) -> Column:
    """Shoelace area with longitude scaled at the mean latitude; under 3 vertices is 0.

    Taken about the first vertex: products of raw degrees would lose a small
    ring's area to cancellation.
    """
    def area(r):
        k = F.cos(F.radians(vertex_mean(r)["lat"])) * (METRES_PER_DEGREE * METRES_PER_DEGREE)
        y0, x0 = F.get(r, F.lit(0))["lat"], F.get(r, F.lit(0))["lng"]
        twice = F.transform(ring_edges(r), lambda e: (e["xj"] - x0) * (e["yi"] - y0) - (e["xi"] - x0) * (e["yj"] - y0))
        return F.abs(_total(twice)) * k / 2

    return F.when(F.size(ring) < 3, F.lit(0.0)).otherwise(let(ring, area))


def area_centroid(ring: Column) -> Column:
    """Area-weighted centre of a ring, computed about its first vertex."""
    y0, x0 = F.element_at(ring, 1)["lat"], F.element_at(ring, 1)["lng"]
    cross = lambda e: (e["xj"] - x0) * (e["yi"] - y0) - (e["xi"] - x0) * (e["yj"] - y0)
    edges = ring_edges(ring)
    a = _total(F.transform(edges, cross))
    cy = _total(F.transform(edges, lambda e: (e["yi"] + e["yj"] - 2 * y0) * cross(e)))
    cx = _total(F.transform(edges, lambda e: (e["xi"] + e["xj"] - 2 * x0) * cross(e)))
    return F.when(a != 0, F.struct((y0 + cy / (3 * a)).alias("lat"), (x0 + cx / (3 * a)).alias("lng"))) \
            .otherwise(vertex_mean(ring))


def ring_bbox(ring: Column) -> Column:
    lats, lngs = F.transform(ring, lambda p: p["lat"]), F.transform(ring, lambda p: p["lng"])
    return F.struct(F.array_min(lats).alias("south"), F.array_min(lngs).alias("west"),
                    F.array_max(lats).alias("north"), F.array_max(lngs).alias("east"))


def bbox_ring(south, west, north, east) -> Column:
    """The four corners of a box: NW, NE, SE, SW."""
    return F.array(point(north, west), point(north, east), point(south, east), point(south, west))


def _longest_edge(ring: Column, length, value) -> Column:
    def scored(r):
        n = F.size(r)
        return F.array_max(F.transform(r, lambda p, i: F.struct(
            length(p, F.get(r, (i + 1) % n)).alias("len"), (-i).alias("rank"),
            value(p, F.get(r, (i + 1) % n)).alias("value"))))["value"]

    return let(ring, scored)


def longest_edge_angle(ring: Column) -> Column:
    """Math angle (radians from east) of the longest edge; the first of equals wins."""
    dy = lambda a, b: (b["lat"] - a["lat"]) * METRES_PER_DEGREE
    dx = lambda a, b: (b["lng"] - a["lng"]) * METRES_PER_DEGREE * F.cos(F.radians(a["lat"]))
    return _longest_edge(ring, lambda a, b: F.hypot(dx(a, b), dy(a, b)), lambda a, b: F.atan2(dy(a, b), dx(a, b)))


def longest_edge_bearing(ring: Column) -> Column:
    """Compass bearing of the longest edge, by great-circle length."""
    return _longest_edge(ring, lambda a, b: haversine_m(a["lat"], a["lng"], b["lat"], b["lng"]),
                         lambda a, b: bearing_deg(a["lat"], a["lng"], b["lat"], b["lng"]))


def longest_edge_angle_degrees(ring: Column) -> Column:
    """Angle of the longest edge measured in raw degrees (block orientation)."""
    dy = lambda a, b: b["lat"] - a["lat"]
    dx = lambda a, b: b["lng"] - a["lng"]
    return _longest_edge(ring, lambda a, b: dx(a, b) * dx(a, b) + dy(a, b) * dy(a, b),
                         lambda a, b: F.atan2(dy(a, b), dx(a, b)))


# ------------------------------------------------- point to segment / frames

def point_segment(px, py, ax, ay, bx, by) -> Column:
    """Planar distance of p to segment a-b."""
    px, py, ax, ay, bx, by = map(_c, (px, py, ax, ay, bx, by))
    t = segment_fraction(px, py, ax, ay, bx, by)
    return F.hypot(px - (ax + t * (bx - ax)), py - (ay + t * (by - ay)))


def segment_fraction(px, py, ax, ay, bx, by) -> Column:
    """Where the foot of p lies on a-b, clamped to 0..1 (0 for a zero-length segment)."""
    px, py, ax, ay, bx, by = map(_c, (px, py, ax, ay, bx, by))
    len2 = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    t = ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / F.nullif(len2, F.lit(0.0))
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)), F.lit(0.0))


def point_segment_m(lat, lng, alat, alng, blat, blng, k: Column | None = None) -> Column:
    """Distance in metres to a lat/lng segment, in a flat frame centred on the point; ``k``: metres per degree of longitude there, if known."""
    lat, lng, alat, alng, blat, blng = map(_c, (lat, lng, alat, alng, blat, blng))
    k = F.cos(F.radians(lat)) * METRES_PER_DEGREE if k is None else k
    z = F.lit(0.0)
    return point_segment(z, z, (alng - lng) * k, (alat - lat) * METRES_PER_DEGREE,
                         (blng - lng) * k, (blat - lat) * METRES_PER_DEGREE)


def edge_distance_m(p: Column, edges: Column) -> Column:
    """Distance in metres to the nearest edge, for a point struct bound by :func:`let`."""
    return F.array_min(F.transform(edges, lambda e: let(
        F.struct(((e["xi"] - p["lng"]) * p["k"]).alias("ax"), ((e["yi"] - p["lat"]) * METRES_PER_DEGREE).alias("ay"),
                 ((e["xj"] - p["lng"]) * p["k"]).alias("bx"), ((e["yj"] - p["lat"]) * METRES_PER_DEGREE).alias("by")),
        lambda s: point_segment(F.lit(0.0), F.lit(0.0), s["ax"], s["ay"], s["bx"], s["by"]))))


def scaled_point(lat, lng) -> Column:
    """A point with the metres per degree of longitude at its latitude (k)."""
    lat, lng = _c(lat), _c(lng)
    return F.struct(lat.alias("lat"), lng.alias("lng"), (F.cos(F.radians(lat)) * METRES_PER_DEGREE).alias("k"))


def min_edge_m(lat, lng, edges: Column) -> Column:
    """Distance in metres to the nearest of the given edges."""
    return let(scaled_point(lat, lng), lambda p: edge_distance_m(p, edges))


def to_frame(lat, lng, clat, clng, angle) -> tuple[Column, Column]:
    """(u, v) metres about a centre: u along the math angle, v to its left."""
    lat, lng, clat, clng, angle = map(_c, (lat, lng, clat, clng, angle))
    de = (lng - clng) * METRES_PER_DEGREE * F.cos(F.radians(clat))
    dn = (lat - clat) * METRES_PER_DEGREE
    return de * F.cos(angle) + dn * F.sin(angle), -de * F.sin(angle) + dn * F.cos(angle)


def from_frame(u, v, clat, clng, angle) -> tuple[Column, Column]:
    u, v, clat, clng, angle = map(_c, (u, v, clat, clng, angle))
    de = u * F.cos(angle) - v * F.sin(angle)
    dn = u * F.sin(angle) + v * F.cos(angle)
    return clat + dn / METRES_PER_DEGREE, clng + de / (METRES_PER_DEGREE * F.cos(F.radians(clat)))


def nwse_score(lat, lng) -> Column:
    """Diagonal rank: the lower, the further north-west."""
    return -_c(lat) + _c(lng)


def best_orientation(south, west, north, east) -> Column:
    south, west, north, east = map(_c, (south, west, north, east))
    w = (east - west) * METRES_PER_DEGREE * F.cos(F.radians((north + south) / 2))
    h = (north - south) * METRES_PER_DEGREE
    return F.when(w >= 1.4 * h, F.lit("landscape")).otherwise(F.lit("portrait"))


def search_radius_m(south, west, north, east) -> Column:
    return F.least(F.lit(50000.0), F.ceil(haversine_m(south, west, north, east) / 2).cast("double"))


# -------------------------------------------------------------------- tiles

def tile_x(lng, zoom) -> Column:
    return F.floor((_c(lng) + 180.0) / 360.0 * F.pow(F.lit(2.0), _zoom(zoom)))


def tile_y(lat, zoom) -> Column:
    r = F.radians(_c(lat))
    return F.floor((1.0 - F.ln(F.tan(r) + 1.0 / F.cos(r)) / math.pi) / 2.0 * F.pow(F.lit(2.0), _zoom(zoom)))


def tile_lng(x, zoom) -> Column:
    return _c(x) / F.pow(F.lit(2.0), _zoom(zoom)) * 360.0 - 180.0


def tile_lat(y, zoom) -> Column:
    n = F.lit(math.pi) * (1.0 - 2.0 * _c(y) / F.pow(F.lit(2.0), _zoom(zoom)))
    return F.degrees(F.atan(F.sinh(n)))


def _zoom(zoom) -> Column:
    return zoom if isinstance(zoom, Column) else F.lit(float(zoom))


def tile_quadkey(x: Column, y: Column, zoom: int) -> Column:
    """Interleave the bits of a tile address, most significant first."""
    digits = [(F.shiftright(x.cast("long"), i).bitwiseAND(F.lit(1))
               + 2 * F.shiftright(y.cast("long"), i).bitwiseAND(F.lit(1))).cast("string")
              for i in range(zoom - 1, -1, -1)]
    return F.concat(*digits)


def quadkey(lat, lng, zoom: int) -> Column:
    return tile_quadkey(tile_x(lng, zoom), tile_y(lat, zoom), zoom)


def capture_zoom(lat_span, lng_span, close_up: bool = False) -> Column:
    """Imagery zoom by extent: 16 wide, 17, 18 narrow; close-up captures go one deeper."""
    dy, dx = _c(lat_span), _c(lng_span)
    mid_lat, mid_lng, up = (0.004, 0.006, 1) if close_up else (0.003, 0.005, 0)
    return F.when((dy > 0.008) | (dx > 0.012), F.lit(16 + up)) \
            .when((dy > mid_lat) | (dx > mid_lng), F.lit(17 + up)).otherwise(F.lit(18 + up))


# ---------------------------------------------------------- affine and lines

def pixel_to_lnglat(px, py, width, height, lon0, lon1, lat0, lat1) -> tuple[Column, Column]:
    """Affine page pixel to (lng, lat); pixel rows grow southwards."""
    px, py, width, height, lon0, lon1, lat0, lat1 = map(_c, (px, py, width, height, lon0, lon1, lat0, lat1))
    return lon0 + px / width * (lon1 - lon0), lat0 + (height - py) / height * (lat1 - lat0)


def thin_outline(line: Column, parts: int = 20) -> Column:
    """Keep the first, the last and every max(1, n div parts)-th vertex."""
    def pick(points: Column) -> Column:
        n = F.size(points)
        step = F.greatest(F.lit(1), F.floor(n / F.lit(parts)).cast("int"))
        return F.filter(points, lambda p, i: (i == 0) | (i == n - 1) | (i % step == 0))

    return let(line, pick)


def sample_line(line: Column, most: int = 60) -> Column:
    """Every ceil(n / most)-th vertex, with the last one."""
    def pick(points: Column) -> Column:
        n = F.size(points)
        step = F.greatest(F.lit(1), F.ceil(n / F.lit(float(most))).cast("int"))
        return F.filter(points, lambda p, i: (i % step == 0) | (i == n - 1))

    return let(line, pick)


# ---------------------------------------------------------------- SQL surface

_SQL_FUNCTIONS = {
    "haversine_m(a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE)":
        "DOUBLE RETURN 12742000D * asin(sqrt(least(1D, pow(sin(radians(c - a) / 2), 2)"
        " + cos(radians(a)) * cos(radians(c)) * pow(sin(radians(d - b) / 2), 2))))",
    "equirect_m(a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE)":
        "DOUBLE RETURN 111320D * sqrt(pow(c - a, 2) + pow((d - b) * cos(radians((a + c) / 2)), 2))",
    "bearing_deg(a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE)":
        "DOUBLE RETURN pmod(degrees(atan2(sin(radians(d - b)) * cos(radians(c)),"
        " cos(radians(a)) * sin(radians(c)) - sin(radians(a)) * cos(radians(c)) * cos(radians(d - b)))), 360D)",
    "tile_x(lng DOUBLE, z INT)": "BIGINT RETURN CAST(floor((lng + 180) / 360 * pow(2, z)) AS BIGINT)",
    "tile_y(lat DOUBLE, z INT)":
        "BIGINT RETURN CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * pow(2, z)) AS BIGINT)",
    "quadkey(lat DOUBLE, lng DOUBLE, z INT)":
        "STRING RETURN array_join(zip_with(regexp_extract_all(lpad(bin(tile_y(lat, z)), z, '0'), '[01]', 0), regexp_extract_all(lpad(bin(tile_x(lng, z)), z, '0'), '[01]', 0),"
        " (a, b) -> CAST(2 * CAST(a AS INT) + CAST(b AS INT) AS STRING)), '')",
    "ring_area_m2(ring ARRAY<STRUCT<lat: DOUBLE, lng: DOUBLE>>)":
        "DOUBLE RETURN CASE WHEN size(ring) < 3 THEN 0D ELSE abs(aggregate(zip_with(ring, concat(slice(ring, 2, greatest(size(ring) - 1, 0)), slice(ring, 1, 1)),"
        " (p, q) -> (p.lng - ring[0].lng) * (q.lat - ring[0].lat) - (q.lng - ring[0].lng) * (p.lat - ring[0].lat)), 0D, (t, v) -> t + v)) / 2"
        " * 111320D * 111320D * cos(radians(aggregate(ring, 0D, (t, p) -> t + p.lat) / size(ring))) END",
}


def register_sql_functions(spark) -> list[str]:
    """Expose the geodesy helpers to ``spark.sql`` as temporary functions."""
    names = []
    for signature, body in _SQL_FUNCTIONS.items():
        returns, expression = body.split(" RETURN ", 1)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {returns} RETURN {expression}")
        names.append(signature.split("(")[0])
    return names


# -------------------------------------------------------------- footprints

# Fixed value: the sphere the footprint areas are measured on.
AREA_RADIUS_M = 6378137.0


def spherical_area_m2(ring: Column) -> Column:
    """Area of an open ring on the sphere, as footprint feeds report it."""
    n = F.size(ring)
    terms = F.transform(ring, lambda p, i: F.radians(
        F.get(ring, (i + 1) % n)["lng"] - F.get(ring, (i + n - 1) % n)["lng"]) * F.sin(F.radians(p["lat"])))
    return F.when(n < 3, F.lit(0.0)).otherwise(F.abs(_total(terms)) * (AREA_RADIUS_M * AREA_RADIUS_M / 2))


def rings_intersect(ring: Column, other: Column, other_edges: Column) -> Column:
    """Two polygons share a point: a vertex of either lies in the other, or edges cross."""
    return let(F.struct(ring_edges(ring).alias("e"), other_edges.alias("o")), lambda w:
               F.exists(ring, lambda p: inside_edges(p, w["o"])) | F.exists(other, lambda p: inside_edges(p, w["e"]))
               | _any_cross(w["e"], w["o"]))
