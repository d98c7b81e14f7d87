"""Registered queries on blocks, roads, clusters and house order, with their SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockwalk.functions import domain, geo
from blockwalk.operators import assign, cells, components, conflate, nearest, ordering, thin
from blockwalk.plans import bindings as b
from blockwalk.plans import sqltext as t
from blockwalk.plans.bindings import with_tables


def _houses(s, d):
    return b.symbols(s, d).filter(domain.is_numberable(F.col("symbol_type")))


def block_assign(s, d):
    return assign.assign_blocks(b.symbols(s, d), b.blocks(s, d)).select("hlb_id", "id", "block_id")


def block_counts(s, d):
    return assign.block_counts(b.symbols(s, d), b.blocks(s, d))


def block_orientation(s, d):
    return assign.block_orientation(b.symbols(s, d), b.blocks(s, d)).select("hlb_id", "id", "block_id",
                                                                          F.round("angle", 6).alias("angle"))


def road_snap(s, d):
    """Two-point survey segments, one per order, against the area's roads."""
    p = b.symbols(s, d)
    line = F.array(geo.point("lat", "lng"), geo.point(F.col("lat") + 1e-5, F.col("lng") + 3e-5))
    segments = p.select("hlb_id", F.col("id").alias("segment_id"), line.alias("points"))
    return assign.snap_segments(segments, b.roads(s, d)).select("segment_id", "snapped_to_osm", "is_new_road")


def survey_roads(s, d):
    """Short three-vertex roads strung along the survey tracks, one per supplier."""
    k = F.col("s_suppkey")
    lat = F.lit(26.001) + (k % 100) * F.lit(0.00026) + F.floor(k / 100) * F.lit(3e-6)
    lng = F.lit(80.001) + (k % 100) * F.lit(0.00013)
    return b.table(s, d, "supplier").select(
        k.alias("road_id"), k.alias("pos"),
        F.array(geo.point(lat - 1e-4, lng), geo.point(lat, lng + (k % 3) * 1e-5), geo.point(lat + 1e-4, lng + 2e-4)).alias("coords"))


def point_snap(s, d):
    return assign.snap_points(b.gps_points(s, d), survey_roads(s, d), "session_id", "point_id").select(
        "session_id", "point_id", "road_id", F.round("road_dist", 5).alias("road_dist"),
        F.round("snap_lat", 8).alias("snap_lat"), F.round("snap_lng", 8).alias("snap_lng"))


def nearest_bearing(s, d):
    return assign.nearest_road_bearing(b.symbols(s, d), b.roads(s, d)).select("hlb_id", "id", F.round("angle", 7).alias("angle"))


def append_dedupe(s, d):
    """Provider footprints farther than 5 m from every mapped building of the area."""
    rows = b.buildings(s, d)
    return cells.drop_near(rows.filter("source <> 'osm'"), rows.filter("source = 'osm'"), ["hlb_id"], 5.0) \
        .select("hlb_id", "source", "id")


def conflation(s, d):
    return conflate.conflate(b.buildings(s, d)).select("hlb_id", "source", "id")


def greedy_thin(s, d):
    rank = [-F.coalesce("confidence", F.lit(0.0)), F.col("source"), F.col("id")]
    return thin.greedy_thin(b.buildings(s, d), ["hlb_id"], rank, 0.000135).select("hlb_id", "source", "id")


def place_dedupe(s, d):
    """Listed places (suppliers, by area) added 25 m clear of mapped symbols and of each other."""
    k = F.col("s_suppkey")
    mapped = b.symbols(s, d).select("hlb_id", "id", "lat", "lng", F.lit(True).alias("mapped"))
    listed = b.table(s, d, "supplier").select((k % 15).alias("hlb_id"), k.alias("id"), b._lat(k * 13 % 1000).alias("lat"),
                                              (b._lng(k * 7 % 1000) + 0.0004).alias("lng"), F.lit(False).alias("mapped"))
    return thin.greedy_thin(mapped.unionByName(listed), ["hlb_id"], [F.col("id")], 25.0, "metres", fixed=F.col("mapped")) \
        .filter(~F.col("mapped")).select("hlb_id", "id")


def _planar(s, d):
    return _houses(s, d).select("hlb_id", "id", (F.col("lat") * 111320.0).alias("y"), (F.col("lng") * 111320.0).alias("x"))


def clusters(s, d):
    return components.clusters(_planar(s, d), ["hlb_id"], 16.0, 3).select("hlb_id", "id", "cluster", "size")


def dense_insets(s, d):
    return ordering.dense_insets(b.symbols(s, d), b.boundaries(s, d))


def median_nn(s, d):
    gaps = nearest.nearest_gaps(_houses(s, d), ["hlb_id"])
    return nearest.median_gap(gaps, ["hlb_id"]).select("hlb_id", F.round("median_gap", 6).alias("median_gap"))


def regularity(s, d):
    gaps = nearest.nearest_gaps(_houses(s, d), ["hlb_id"])
    return nearest.regularity(gaps, ["hlb_id"]).select("hlb_id", "n", F.round("mean_gap", 6).alias("mean_gap"), "looks_like_rows")


def local_cell_size(s, d):
    return nearest.local_cell_size(_houses(s, d), ["hlb_id"]).select("hlb_id", "id", F.round("cell_size", 6).alias("cell_size"))


def simple_numbering(s, d):
    return ordering.simple_numbering(b.symbols(s, d)).select("hlb_id", "id", "number")


def block_labels(s, d):
    return ordering.label_blocks(b.blocks(s, d)).select("hlb_id", "block_id", "label")


def serpentine(s, d):
    return ordering.serpentine_in_block(_houses(s, d), b.blocks(s, d))


def u_loop(s, d):
    return ordering.order_houses(b.symbols(s, d), b.blocks(s, d), "census_u_loop").select("hlb_id", "id", "block_id", "place")


def cluster_order(s, d):
    return ordering.order_houses(b.symbols(s, d), b.blocks(s, d)).select("hlb_id", "id", "block_id", "place")


def boundary_order(s, d):
    return ordering.order_houses(b.symbols(s, d), system="boundary_serpentine", boundaries=b.boundaries(s, d)) \
        .select("hlb_id", "id", "place")


def running_numbers(s, d):
    order = ordering.order_houses(b.symbols(s, d), b.blocks(s, d), "census_u_loop")
    return ordering.running_numbers(b.symbols(s, d), order).select("hlb_id", "id", "number")


def path_annotations(s, d):
    symbols = b.symbols(s, d)
    order = ordering.order_houses(symbols, b.blocks(s, d), "census_u_loop")
    median = nearest.median_gap(nearest.nearest_gaps(_houses(s, d), ["hlb_id"]), ["hlb_id"])
    return ordering.path_annotations(order, median, ordering.arrow_thinning(symbols, b.boundaries(s, d)))


def path_hops(s, d):
    hops = ordering.path_hops(ordering.order_houses(b.symbols(s, d), b.blocks(s, d), "census_u_loop"))
    return hops.select("hlb_id", "place", F.round("hop_m", 5).alias("hop_m"), F.round("bearing", 5).alias("bearing"),
                       F.round("mid_lat", 8).alias("mid_lat"), F.round("mid_lng", 8).alias("mid_lng"))


def path_ends(s, d):
    return ordering.path_ends(ordering.order_houses(b.symbols(s, d), b.blocks(s, d), "census_u_loop"))


def next_numbers(s, d):
    """Next unnumbered house on the loop, and the next free number from 120 on, per area."""
    symbols = b.symbols(s, d)
    order = ordering.order_houses(symbols, b.blocks(s, d), "census_u_loop")
    start = symbols.select("hlb_id").distinct().withColumn("start", F.lit(117).cast("long"))
    return ordering.next_unnumbered(order, symbols).join(ordering.next_free_number(symbols, start), "hlb_id")


QUERIES = {f.__name__: f for f in (
    block_assign, block_counts, block_orientation, road_snap, point_snap, nearest_bearing, append_dedupe, greedy_thin,
    place_dedupe, clusters, dense_insets, median_nn, regularity, local_cell_size, simple_numbering, block_labels, serpentine,
    u_loop, cluster_order, boundary_order, running_numbers, path_annotations, path_hops, path_ends, next_numbers)}
QUERIES["conflate"] = conflation

# ---------------------------------------------------------------- checks

_HOUSE = "symbol_type <> 'well'"
_RING_EDGES = f"bedges AS ({t.edges('block_rings', 'hlb_id, block_id')})"
_CENTRE = """centres AS (SELECT b.hlb_id, b.block_id, b.pos, south, west, north, east,
    CASE WHEN b.block_id % 2 = 0 THEN r.la ELSE (north + south) / 2 END AS clat,
    CASE WHEN b.block_id % 2 = 0 THEN r.ln ELSE (east + west) / 2 END AS clng FROM blocks b
  JOIN (SELECT hlb_id, block_id, sum(lat ORDER BY i) / 4 AS la, sum(lng ORDER BY i) / 4 AS ln FROM block_rings GROUP BY 1, 2) r
    USING (hlb_id, block_id))"""
_IN_RING = f"(SELECT count(*) % 2 = 1 FROM bedges e WHERE e.hlb_id = s.hlb_id AND e.block_id = c.block_id AND {t.crosses('s.lat', 's.lng')})"
_PLACED = f"""{_RING_EDGES}, {_CENTRE},
  hits AS (SELECT s.hlb_id, s.id, c.block_id, -c.clat + c.clng AS score, c.pos AS bpos,
                  row_number() OVER (PARTITION BY s.hlb_id, s.id ORDER BY -c.clat + c.clng, c.pos) AS rn
           FROM symbols s JOIN centres c ON c.hlb_id = s.hlb_id
           WHERE CASE WHEN c.block_id % 2 = 0 THEN {_IN_RING}
                      ELSE s.lat BETWEEN c.south AND c.north AND s.lng BETWEEN c.west AND c.east END),
  placed AS (SELECT s.*, h.block_id, h.score, h.bpos FROM symbols s LEFT JOIN hits h ON h.id = s.id AND h.rn = 1)"""
# longest edge of each block: known from the shape, the first of equals (lengths to a micrometre)
_THETA = """thetas AS (SELECT hlb_id, block_id, arg_max(ang, len * 100 - edge * 1e-7) AS theta FROM (
    SELECT hlb_id, block_id, CASE WHEN i = 0 THEN 3 ELSE i - 1 END AS edge,
           atan2((yi - yj) * 111320, (xi - xj) * 111320 * cos(radians(yj))) AS ang,
           round(sqrt(pow((yi - yj) * 111320, 2) + pow((xi - xj) * 111320 * cos(radians(yj)), 2)), 6) AS len
    FROM bedges) GROUP BY 1, 2)"""
_LOCAL = f"""{_PLACED}, {_THETA},
  loc AS (SELECT p.*, c.clat, c.clng, theta, de * cos(theta) + dn * sin(theta) AS u, -de * sin(theta) + dn * cos(theta) AS v FROM (
      SELECT p.*, (p.lng - c.clng) * 111320.0::DOUBLE * cos(radians(c.clat)) AS de, (p.lat - c.clat) * 111320.0::DOUBLE AS dn
      FROM placed p JOIN centres c USING (hlb_id, block_id) WHERE {_HOUSE}) p
    JOIN centres c USING (hlb_id, block_id) JOIN thetas USING (hlb_id, block_id))"""


def _score(u, v):
    lat = f"(clat + ({u} * sin(theta) + {v} * cos(theta)) / 111320.0::DOUBLE)"
    lng = f"(clng + ({u} * cos(theta) - {v} * sin(theta)) / (111320.0::DOUBLE * cos(radians(clat))))"
    return f"(-{lat} + {lng})"


_LOOP = f"""{_LOCAL},
  st AS (SELECT hlb_id, block_id, min(u) AS u0, max(u) AS u1, min(v) AS v0, max(v) AS v1, any_value(clat) AS clat,
                any_value(clng) AS clng, any_value(theta) AS theta, list(v ORDER BY v)[count(*) // 2 + 1] AS mid FROM loc GROUP BY 1, 2),
  cr AS (SELECT hlb_id, block_id, mid, list_position(sc, list_min(sc)) - 1 AS corner FROM (
           SELECT *, [{_score('u0', 'v0')}, {_score('u1', 'v0')}, {_score('u1', 'v1')}, {_score('u0', 'v1')}] AS sc FROM st)),
  walk AS (SELECT l.*, CASE WHEN corner < 2 THEN v < mid ELSE v >= mid END AS near, corner FROM loc l JOIN cr USING (hlb_id, block_id)),
  loop AS (SELECT hlb_id, id, block_id, lat, lng, row_number() OVER (PARTITION BY hlb_id ORDER BY orphan, score, bpos, side, dir, pos, id) AS place FROM (
    SELECT hlb_id, id, block_id, lat, lng, 0 AS orphan, score, bpos, CASE WHEN near THEN 0 ELSE 1 END AS side,
           CASE WHEN near = (corner IN (0, 3)) THEN u ELSE -u END AS dir, pos FROM walk
    UNION ALL SELECT hlb_id, id, NULL, lat, lng, 1, -lat + lng, 0, 0, 0, pos FROM placed WHERE block_id IS NULL AND {_HOUSE}))"""
_SERP = f"""{_LOCAL},
  gp AS (SELECT hlb_id, block_id, v, v - lag(v) OVER (PARTITION BY hlb_id, block_id ORDER BY v, id) AS g, id FROM loc),
  mg AS (SELECT hlb_id, block_id, list(g ORDER BY v, id)[count(*) // 2 + 1] AS mid FROM gp WHERE g > 0.1 GROUP BY 1, 2),
  st AS (SELECT hlb_id, block_id, min(v) AS v0, max(v) AS v1, any_value(clat) AS clat, any_value(clng) AS clng,
                any_value(theta) AS theta FROM loc GROUP BY 1, 2),
  gr AS (SELECT hlb_id, block_id, v0, coalesce(greatest(2.0::DOUBLE, mid * 1.5), 3.0) AS rh,
                {_score('0', 'v0')} <= {_score('0', 'v1')} AS up FROM st LEFT JOIN mg USING (hlb_id, block_id)),
  rw AS (SELECT l.*, CASE WHEN up THEN 1 ELSE -1 END * floor((v - v0) / rh + 0.5) AS r FROM loc l JOIN gr USING (hlb_id, block_id)),
  ln AS (SELECT hlb_id, block_id, r, min(u) AS u0, max(u) AS u1, avg(v) AS va, any_value(clat) AS clat, any_value(clng) AS clng,
                any_value(theta) AS theta, row_number() OVER (PARTITION BY hlb_id, block_id ORDER BY r) AS k FROM rw GROUP BY 1, 2, 3),
  fs AS (SELECT hlb_id, block_id, {_score('u0', 'va')} <= {_score('u1', 'va')} AS asc_ FROM ln WHERE k = 1)"""


def _serp_rows(src: str, keys: str) -> str:
    """Rows and turns of the serpentine inside the groups ``keys`` of ``src``."""
    return f"""gp AS (SELECT *, v - lag(v) OVER (PARTITION BY {keys} ORDER BY v, id) AS g FROM {src}),
  mg AS (SELECT {keys}, list(g ORDER BY v, id)[count(*) // 2 + 1] AS mid FROM gp WHERE g > 0.1 GROUP BY ALL),
  st AS (SELECT {keys}, min(v) AS v0, max(v) AS v1, any_value(clat) AS clat, any_value(clng) AS clng, any_value(theta) AS theta FROM {src} GROUP BY ALL),
  gr AS (SELECT {keys}, v0, coalesce(greatest(2.0::DOUBLE, mid * 1.5), 3.0) AS rh, {_score('0', 'v0')} <= {_score('0', 'v1')} AS up FROM st LEFT JOIN mg USING ({keys})),
  rw AS (SELECT l.*, CASE WHEN up THEN 1 ELSE -1 END * floor((v - v0) / rh + 0.5) AS r FROM {src} l JOIN gr USING ({keys})),
  ln AS (SELECT {keys}, r, min(u) AS u0, max(u) AS u1, avg(v) AS va, any_value(clat) AS clat, any_value(clng) AS clng, any_value(theta) AS theta,
                row_number() OVER (PARTITION BY {keys} ORDER BY r) AS k FROM rw GROUP BY {keys}, r),
  fs AS (SELECT {keys}, {_score('u0', 'va')} <= {_score('u1', 'va')} AS asc_ FROM ln WHERE k = 1)"""


def _step(a: str, b: str) -> str:
    """Metres between two points of a path, by their places in it."""
    return t.flat(f"la[path[{a}]]", f"ln[path[{a}]]", f"la[path[{b}]]", f"ln[path[{b}]]")


# The default house order by its definition: clusters by links, rows or a walk, the walk improved forty times at most.
_BY = "hlb_id, block_id, cl"
_WALKED = f"""{_LOCAL},
  h AS (SELECT *, row_number() OVER (PARTITION BY hlb_id, block_id ORDER BY pos, id) AS o, count(*) OVER (PARTITION BY hlb_id, block_id) AS n
        FROM placed WHERE block_id IS NOT NULL AND {_HOUSE}),
  ng AS (SELECT a.hlb_id, a.block_id, a.id, min({t.flat('a.lat', 'a.lng', 'c.lat', 'c.lng')}) AS gap
         FROM h a JOIN h c ON a.hlb_id = c.hlb_id AND a.block_id = c.block_id AND a.id <> c.id GROUP BY 1, 2, 3),
  md AS (SELECT hlb_id, block_id, list(gap ORDER BY gap)[count(*) // 2 + 1] AS med FROM ng GROUP BY 1, 2),
  link AS (SELECT a.id AS a, c.id AS c FROM h a JOIN h c ON a.hlb_id = c.hlb_id AND a.block_id = c.block_id AND a.id <> c.id
           JOIN md ON md.hlb_id = a.hlb_id AND md.block_id = a.block_id
           WHERE pow(a.lat * 111320.0::DOUBLE - c.lat * 111320.0::DOUBLE, 2) + pow(a.lng * 111320.0::DOUBLE - c.lng * 111320.0::DOUBLE, 2) <= pow(coalesce(nullif(med, 0), 10) * 1.4::DOUBLE, 2)),
  reach(a, c) AS (SELECT id, id FROM h UNION SELECT r.a, l.c FROM reach r JOIN link l ON l.a = r.c),
  comp AS (SELECT a AS id, min(o) AS first, count(*) AS members FROM reach JOIN h ON h.id = reach.c GROUP BY 1),
  cl AS (SELECT h.*, CASE WHEN n <= 3 THEN 0 WHEN members < 3 THEN o ELSE first END AS cl, CASE WHEN n <= 3 THEN n WHEN members < 3 THEN 1 ELSE members END AS size
         FROM h JOIN comp USING (id)),
  cg AS (SELECT a.id, min({t.flat('a.lat', 'a.lng', 'c.lat', 'c.lng')}) AS gap FROM cl a JOIN cl c
         ON a.hlb_id = c.hlb_id AND a.block_id = c.block_id AND a.cl = c.cl AND a.id <> c.id GROUP BY 1),
  ir AS (SELECT {_BY}, min(n) <= 3 OR min(size) >= 4 AND coalesce(stddev_pop(gap) / nullif(avg(gap), 0) >= 0.35, false) AS loose,
                round(-avg(lat) + avg(lng), 9) AS cscore, min({{'pos': pos, 'id': id}}) AS cfirst FROM cl LEFT JOIN cg USING (id) GROUP BY ALL),
  pt AS (SELECT cl.*, dense_rank() OVER (ORDER BY {_BY}) AS g, row_number() OVER (PARTITION BY {_BY} ORDER BY pos, id) AS k FROM cl JOIN ir USING ({_BY}) WHERE loose AND n > 3),
  nnw(g, here, seen) AS (
    SELECT g, k, [k] FROM (SELECT g, k FROM pt QUALIFY row_number() OVER (PARTITION BY g ORDER BY -lat + lng, k DESC) = 1)
    UNION ALL SELECT g, nx, list_append(seen, nx) FROM (
      SELECT w.g, any_value(w.seen) AS seen, arg_min(p.k, {{'d': {t.flat('q.lat', 'q.lng', 'p.lat', 'p.lng')}, 'k': p.k}}) AS nx
      FROM nnw w JOIN pt q ON q.g = w.g AND q.k = w.here JOIN pt p ON p.g = w.g AND NOT list_contains(w.seen, p.k) GROUP BY w.g)),
  lists AS (SELECT g, list(lat ORDER BY k) AS la, list(lng ORDER BY k) AS ln, count(*) AS m FROM pt GROUP BY 1),
  num AS (SELECT unnest(generate_series(1, (SELECT coalesce(max(m), 1) FROM lists))) AS v),
  opt(g, pass, path) AS (
    SELECT g, 0, seen FROM nnw JOIN lists USING (g) WHERE len(seen) = m
    UNION ALL SELECT g, pass + 1, list_concat(list_concat(path[1:i], list_reverse(path[i + 1:j])), path[j + 1:]) FROM (
      SELECT g, pass, path, f // 100000 AS i, f % 100000 AS j FROM (
        SELECT o.g, any_value(pass) AS pass, any_value(path) AS path, min(a.v * 100000 + c.v) AS f
        FROM opt o JOIN lists USING (g) JOIN num a ON a.v <= m - 2 JOIN num c ON c.v >= a.v + 2 AND c.v <= m - 1
        WHERE pass < 40 AND {_step('a.v', 'c.v')} + {_step('a.v + 1', 'c.v + 1')} + 0.01::DOUBLE < {_step('a.v', 'a.v + 1')} + {_step('c.v', 'c.v + 1')} GROUP BY o.g))),
  wk AS (SELECT g, unnest(path) AS k, generate_subscripts(path, 1) AS step FROM (SELECT g, arg_max(path, pass) AS path FROM opt GROUP BY 1)),
  cloc AS (SELECT loc.*, c.cl FROM loc JOIN (SELECT id, cl, loose FROM cl JOIN ir USING ({_BY})) c ON c.id = loc.id WHERE NOT loose),
  {_serp_rows('cloc', _BY)},
  placed_in AS (SELECT id, r AS a, CASE WHEN (k % 2 = 1) = asc_ THEN rw.u ELSE -rw.u END AS b FROM rw JOIN ln USING ({_BY}, r) JOIN fs USING ({_BY})
    UNION ALL SELECT pt.id, step, 0 FROM pt JOIN wk ON wk.g = pt.g AND wk.k = pt.k UNION ALL SELECT id, o, 0 FROM h WHERE n <= 3),
  ordered AS (SELECT hlb_id, id, block_id, row_number() OVER (PARTITION BY hlb_id ORDER BY orphan, score, bpos, cscore, cfirst, a, b, pos, id) AS place FROM (
    SELECT cl.hlb_id, cl.id, cl.block_id, 0 AS orphan, score, bpos, cscore, cfirst, a, b, pos FROM cl JOIN ir USING ({_BY}) JOIN placed_in i ON i.id = cl.id
    UNION ALL SELECT hlb_id, id, NULL, 1, -lat + lng, 0, 0, NULL, 0, 0, pos FROM placed WHERE block_id IS NULL AND {_HOUSE}))"""
_NN = f"""nn AS (SELECT a.hlb_id, a.id, min({t.flat('a.lat', 'a.lng', 'c.lat', 'c.lng')}) AS gap
  FROM symbols a JOIN symbols c ON a.hlb_id = c.hlb_id AND a.id <> c.id AND c.{_HOUSE} WHERE a.{_HOUSE} GROUP BY 1, 2)"""
_ROAD_SEGS = """rs AS (SELECT p.hlb_id, p.road_id, p.pos, p.i, p.lat AS ay, p.lng AS ax, q.lat AS by_, q.lng AS bx
  FROM road_points p JOIN road_points q ON p.road_id = q.road_id AND q.i = p.i + 1)"""
_BND_AREA = f"""bnd AS (SELECT hlb_id, abs(sum((xj - 80) * (yi - 26) - (xi - 80) * (yj - 26))) * pow(111320.0::DOUBLE, 2) / 2
      * cos(radians(avg(yi))) AS area FROM ({t.edges('boundary_points', 'hlb_id')}) GROUP BY 1)"""
_HOPS = f"""hops AS (SELECT hlb_id, id, place, lat, lng, block_id, lead(lat) OVER w AS lat2, lead(lng) OVER w AS lng2,
   lead(block_id) OVER w AS b2 FROM loop WINDOW w AS (PARTITION BY hlb_id ORDER BY place))"""
_SROADS = """sv AS (SELECT s_suppkey AS road_id, i, CASE i WHEN 0 THEN la - 1e-4 WHEN 1 THEN la ELSE la + 1e-4 END AS lat,
     CASE i WHEN 0 THEN ln WHEN 1 THEN ln + (s_suppkey % 3) * 1e-5 ELSE ln + 2e-4 END AS lng
   FROM (SELECT s_suppkey, 26.001 + (s_suppkey % 100) * 0.00026::DOUBLE + (s_suppkey // 100) * 3e-6 AS la,
                80.001 + (s_suppkey % 100) * 0.00013::DOUBLE AS ln FROM supplier), (SELECT unnest([0, 1, 2]) AS i)),
  sg AS (SELECT p.road_id, p.i, p.lat AS ay, p.lng AS ax, q.lat AS by_, q.lng AS bx FROM sv p JOIN sv q ON p.road_id = q.road_id AND q.i = p.i + 1)"""


def _frac(lat, lng, ay, ax, by, bx):
    k = f"cos(radians({lat}))"
    return (f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, (({lng} - {ax}) * {k} * ({bx} - {ax}) * {k} + ({lat} - {ay}) * ({by} - {ay}))"
            f" / (pow(({bx} - {ax}) * {k}, 2) + pow({by} - {ay}, 2))))")


# sequential passes as list folds: the accumulator holds what was kept so far
_THIN = """SELECT hlb_id, list_reduce(list({st} ORDER BY {order}), lambda acc, r: CASE WHEN len(list_filter(acc, lambda k: {near})) = 0
   THEN list_append(acc, r) ELSE acc END, {init}) AS kept FROM {src} GROUP BY 1"""

CHECKS = {
    "block_assign": with_tables("symbols", "blocks", "block_rings", query=f", {_PLACED} SELECT hlb_id, id, block_id FROM placed"),
    "block_counts": with_tables("symbols", "blocks", "block_rings", query=f"""
        , {_RING_EDGES}, h AS (SELECT s.hlb_id, s.id, min(c.block_id) AS block_id FROM symbols s JOIN blocks c ON c.hlb_id = s.hlb_id
          WHERE {_HOUSE} AND {_IN_RING} GROUP BY 1, 2)
        SELECT b.hlb_id, b.block_id, count(h.id) AS houses, count(h.id) > 180 AS over_full FROM blocks b
        LEFT JOIN h ON h.hlb_id = b.hlb_id AND h.block_id = b.block_id GROUP BY 1, 2"""),
    "block_orientation": with_tables("symbols", "blocks", "block_rings", query=f"""
        , {_RING_EDGES}, h AS (SELECT s.hlb_id, s.id, min(c.block_id) AS block_id FROM symbols s JOIN blocks c ON c.hlb_id = s.hlb_id
          WHERE {_IN_RING} GROUP BY 1, 2),
        -- squared lengths are compared as doubles in ring order, the first largest wins
        e2 AS (SELECT e.hlb_id, e.block_id, p.i, pow(xi - xj, 2) AS x2, (e.xi - e.xj) * (e.xi - e.xj) + (e.yi - e.yj) * (e.yi - e.yj) AS len,
                      atan2(yi - yj, xi - xj) AS ang FROM bedges e JOIN (SELECT unnest([0, 1, 2, 3]) AS i) p ON p.i = (e.i + 3) % 4),
        a AS (SELECT hlb_id, block_id, ang FROM e2 QUALIFY row_number() OVER (PARTITION BY hlb_id, block_id ORDER BY len DESC, i) = 1)
        SELECT s.hlb_id, s.id, h.block_id, round(ang, 6) AS angle FROM symbols s LEFT JOIN h ON h.id = s.id
        LEFT JOIN a ON a.hlb_id = h.hlb_id AND a.block_id = h.block_id"""),
    "road_snap": with_tables("symbols", "road_points", query=f"""
        , {_ROAD_SEGS}, d AS (SELECT id, arg_min(road_id, m) AS road, min(m) AS m FROM (
            SELECT s.id, r.road_id, {t.seg_dist_m('s.lat + 5e-6', 's.lng + 1.5e-5', 'r.ay', 'r.ax', 'r.by_', 'r.bx')} AS m
            FROM symbols s JOIN rs r ON r.hlb_id = s.hlb_id) GROUP BY 1)
        SELECT id AS segment_id, CASE WHEN m < 8 THEN road END AS snapped_to_osm, CASE WHEN m >= 8 THEN true END AS is_new_road FROM d"""),
    "point_snap": with_tables("gps_points", query=f"""
        , {_SROADS}, near AS (SELECT DISTINCT p.session_id, p.point_id, p.lat, p.lng, v.road_id FROM gps_points p JOIN sv v
            ON abs(v.lat - p.lat) < 0.0002 AND abs(v.lng - p.lng) < 0.0002),
        m AS (SELECT n.*, g.ay, g.ax, g.by_, g.bx, g.i, {t.seg_dist_m('n.lat', 'n.lng', 'g.ay', 'g.ax', 'g.by_', 'g.bx')} AS dist
              FROM near n JOIN sg g USING (road_id)),
        best AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY dist, road_id, i) = 1)
        SELECT session_id, point_id, road_id, round(dist, 5) AS road_dist, round(ay + f * (by_ - ay), 8) AS snap_lat,
               round(ax + f * (bx - ax), 8) AS snap_lng
        FROM (SELECT *, {_frac('lat', 'lng', 'ay', 'ax', 'by_', 'bx')} AS f FROM best WHERE dist <= 10)"""),
    "nearest_bearing": with_tables("symbols", "road_points", query=f"""
        , {_ROAD_SEGS} SELECT hlb_id, id, round(ang, 7) AS angle FROM (
          SELECT s.hlb_id, s.id, atan2(by_ - ay, bx - ax) AS ang, row_number() OVER (PARTITION BY s.id ORDER BY
            sqrt(pow(s.lat - (ay + by_) / 2, 2) + pow(s.lng - (ax + bx) / 2, 2)), r.pos, r.i) AS rn
          FROM symbols s JOIN rs r ON r.hlb_id = s.hlb_id) WHERE rn = 1"""),
    "append_dedupe": with_tables("buildings", query=f"""
        SELECT hlb_id, source, id FROM buildings n WHERE source <> 'osm' AND NOT EXISTS (SELECT 1 FROM buildings o
          WHERE o.source = 'osm' AND o.hlb_id = n.hlb_id AND {t.hav('n.lat', 'n.lng', 'o.lat', 'o.lng')} < 5)"""),
    # providers only meet inside chains of near rows, so the sequential pass is folded per chain
    "conflate": "WITH RECURSIVE buildings AS (" + b.SQL["buildings"] + """),
        bb AS (SELECT hlb_id, id, lat, lng, CASE source WHEN 'osm' THEN 0 WHEN 'google' THEN 1 ELSE 2 END AS o,
                     row_number() OVER (ORDER BY source, id) AS n FROM buildings),
        link AS (SELECT a.n AS a, c.n AS c FROM bb a JOIN bb c ON a.hlb_id = c.hlb_id AND a.n <> c.n
                 AND abs(a.lat - c.lat) < 3.6e-5 AND abs(a.lng - c.lng) < 3.6e-5),
        reach(a, c) AS (SELECT n, n FROM bb UNION SELECT x.a, l.c FROM reach x JOIN link l ON l.a = x.c),
        comp AS (SELECT a AS n, min(c) AS comp FROM reach GROUP BY 1),
        folded AS (SELECT hlb_id, list_reduce(list({'o': o, 'id': id, 'lat': lat, 'lng': lng, 'have': [o]} ORDER BY o, id),
            lambda acc, r: CASE WHEN coalesce(list_position(list_transform(acc, lambda c: NOT list_contains(c.have, r.o)
                                AND abs(c.lat - r.lat) < 3.6e-5 AND abs(c.lng - r.lng) < 3.6e-5), true), 0) = 0
              THEN list_append(acc, r)
              ELSE list_transform(acc, lambda c, i: CASE WHEN i = list_position(list_transform(acc, lambda c2: NOT list_contains(c2.have, r.o)
                                AND abs(c2.lat - r.lat) < 3.6e-5 AND abs(c2.lng - r.lng) < 3.6e-5), true)
                THEN {'o': c.o, 'id': c.id, 'lat': c.lat, 'lng': c.lng, 'have': list_append(c.have, r.o)} ELSE c END) END,
            CAST([] AS STRUCT(o INT, id BIGINT, lat DOUBLE, lng DOUBLE, have INT[])[])) AS kept
          FROM bb JOIN comp USING (n) GROUP BY hlb_id, comp)
        SELECT hlb_id, ['osm', 'google', 'microsoft'][k.o + 1] AS source, k.id AS id FROM (SELECT hlb_id, unnest(kept) AS k FROM folded)""",
    "greedy_thin": with_tables("buildings", query=", folded AS (" + _THIN.format(
        st="{'s': source, 'id': id, 'lat': lat, 'lng': lng}", order="coalesce(confidence, 0) DESC, source, id",
        near="sqrt(pow(k.lat - r.lat, 2) + pow(k.lng - r.lng, 2)) < 0.000135",
        init="CAST([] AS STRUCT(s VARCHAR, id BIGINT, lat DOUBLE, lng DOUBLE)[])", src="buildings") + """)
        SELECT hlb_id, k.s AS source, k.id AS id FROM (SELECT hlb_id, unnest(kept) AS k FROM folded)"""),
    "place_dedupe": with_tables("symbols", query=f"""
        , listed AS (SELECT s_suppkey % 15 AS hlb_id, s_suppkey AS id, {b.LAT.format(k='s_suppkey * 13 % 1000')} AS lat,
                            {b.LNG.format(k='s_suppkey * 7 % 1000')} + 0.0004 AS lng FROM supplier),
        clear AS (SELECT * FROM listed n WHERE NOT EXISTS (SELECT 1 FROM symbols o WHERE o.hlb_id = n.hlb_id
                  AND {t.hav('n.lat', 'n.lng', 'o.lat', 'o.lng')} < 25)),
        folded AS (""" + _THIN.format(
        st="{'id': id, 'lat': lat, 'lng': lng}", order="id", near=t.hav('k.lat', 'k.lng', 'r.lat', 'r.lng') + " < 25",
        init="CAST([] AS STRUCT(id BIGINT, lat DOUBLE, lng DOUBLE)[])", src="clear") + """)
        SELECT hlb_id, k.id AS id FROM (SELECT hlb_id, unnest(kept) AS k FROM folded)"""),
    "clusters": "WITH RECURSIVE symbols AS (" + b.SQL["symbols"] + f"""),
        pt AS (SELECT hlb_id, id, lat * 111320.0::DOUBLE AS y, lng * 111320.0::DOUBLE AS x FROM symbols WHERE {_HOUSE}),
        link AS (SELECT a.id AS a, c.id AS c FROM pt a JOIN pt c ON a.hlb_id = c.hlb_id AND a.id <> c.id
                 AND pow(a.y - c.y, 2) + pow(a.x - c.x, 2) <= 256),
        reach(a, c) AS (SELECT id, id FROM pt UNION SELECT r.a, l.c FROM reach r JOIN link l ON l.a = r.c),
        comp AS (SELECT a AS id, min(c) AS comp, count(*) AS n FROM reach GROUP BY 1)
        SELECT hlb_id, id, CASE WHEN n < 3 THEN id ELSE comp END AS cluster, CASE WHEN n < 3 THEN 1 ELSE n END AS size
        FROM pt JOIN comp USING (id)""",
    "dense_insets": "WITH RECURSIVE symbols AS (" + b.SQL["symbols"] + "), boundary_points AS (" + b.SQL["boundary_points"] + f"""),
        u AS (SELECT hlb_id, greatest(max(lat) - min(lat), max(lng) - min(lng)) * 0.03::DOUBLE AS u FROM boundary_points GROUP BY 1),
        pt AS (SELECT hlb_id, id, lat, lng, lat / u AS y, lng / u AS x FROM symbols JOIN u USING (hlb_id) WHERE {_HOUSE}),
        link AS (SELECT a.id AS a, c.id AS c FROM pt a JOIN pt c ON a.hlb_id = c.hlb_id AND a.id <> c.id
                 AND pow(a.y - c.y, 2) + pow(a.x - c.x, 2) <= 1),
        reach(a, c) AS (SELECT id, id FROM pt UNION SELECT r.a, l.c FROM reach r JOIN link l ON l.a = r.c),
        comp AS (SELECT a AS id, min(c) AS cluster FROM reach GROUP BY 1)
        SELECT hlb_id, cluster, count(*) AS members, min(lat) AS south, max(lat) AS north, min(lng) AS west, max(lng) AS east
        FROM pt JOIN comp USING (id) GROUP BY 1, 2 HAVING count(*) >= 12""",
    "median_nn": with_tables("symbols", query=f"""
        , {_NN} SELECT hlb_id, round(list(gap ORDER BY gap)[count(*) // 2 + 1], 6) AS median_gap FROM nn GROUP BY 1"""),
    "regularity": with_tables("symbols", query=f"""
        , {_NN} SELECT hlb_id, count(*) AS n, round(avg(gap), 6) AS mean_gap, stddev_pop(gap) / avg(gap) < 0.35 AS looks_like_rows
        FROM nn GROUP BY 1"""),
    "local_cell_size": with_tables("symbols", query=f"""
        , d AS (SELECT a.hlb_id, a.id, {t.flat('a.lat', 'a.lng', 'c.lat', 'c.lng')} AS m FROM symbols a
                JOIN symbols c ON a.hlb_id = c.hlb_id AND a.id <> c.id AND c.{_HOUSE} WHERE a.{_HOUSE}),
        k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY m) AS rn FROM d)
        SELECT hlb_id, id, round(greatest(14.0::DOUBLE, least(28.0::DOUBLE, avg(m) * 0.9)), 6) AS cell_size FROM k WHERE rn <= 5 GROUP BY 1, 2"""),
    "simple_numbering": with_tables("symbols", query="""
        , n AS (SELECT hlb_id, max(lat) AS north FROM symbols WHERE symbol_type IN ('pucca_house', 'kutcha_house', 'apartment', 'non_residential') GROUP BY 1),
        r AS (SELECT s.id, row_number() OVER (PARTITION BY s.hlb_id ORDER BY floor((north - lat) / 0.00009::DOUBLE), lng, pos) AS k
              FROM symbols s JOIN n USING (hlb_id) WHERE symbol_type IN ('pucca_house', 'kutcha_house', 'apartment', 'non_residential'))
        SELECT hlb_id, s.id, CASE WHEN k IS NULL OR number_locked THEN number ELSE k END AS number FROM symbols s LEFT JOIN r ON r.id = s.id"""),
    "block_labels": with_tables("blocks", "block_rings", query="""
        , c AS (SELECT hlb_id, block_id, sum(lat ORDER BY i) / 4 AS la, sum(lng ORDER BY i) / 4 AS ln FROM block_rings GROUP BY 1, 2)
        SELECT hlb_id, block_id, chr(CAST(64 + row_number() OVER (PARTITION BY hlb_id ORDER BY la DESC, ln, block_id) AS INT)) AS label FROM c"""),
    "serpentine": with_tables("symbols", "blocks", "block_rings", query=f"""
        , {_SERP} SELECT hlb_id, block_id, id, row_number() OVER (PARTITION BY hlb_id, block_id ORDER BY r,
            CASE WHEN (k % 2 = 1) = asc_ THEN rw.u ELSE -rw.u END, pos, id) AS place
        FROM rw JOIN ln USING (hlb_id, block_id, r) JOIN fs USING (hlb_id, block_id)"""),
    "cluster_order": with_tables("symbols", "blocks", "block_rings", query=f", {_WALKED} SELECT hlb_id, id, block_id, place FROM ordered").replace("WITH", "WITH RECURSIVE", 1),
    "u_loop": with_tables("symbols", "blocks", "block_rings", query=f", {_LOOP} SELECT hlb_id, id, block_id, place FROM loop"),
    "running_numbers": with_tables("symbols", "blocks", "block_rings", query=f"""
        , {_LOOP}, n AS (SELECT l.id, 1 + coalesce(sum(CASE WHEN symbol_type = 'apartment' AND unit_count > 1 THEN unit_count ELSE 1 END)
            OVER (PARTITION BY l.hlb_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k
          FROM loop l JOIN symbols s ON s.id = l.id)
        SELECT hlb_id, s.id, CAST(CASE WHEN {_HOUSE} THEN k ELSE number END AS BIGINT) AS number FROM symbols s LEFT JOIN n ON n.id = s.id"""),
    "path_hops": with_tables("symbols", "blocks", "block_rings", query=f"""
        , {_LOOP}, {_HOPS} SELECT hlb_id, place, round({t.hav('lat', 'lng', 'lat2', 'lng2')}, 5) AS hop_m,
          round(({t.bearing('lat', 'lng', 'lat2', 'lng2')} + 360) % 360, 5) AS bearing, round((lat + lat2) / 2, 8) AS mid_lat,
          round((lng + lng2) / 2, 8) AS mid_lng FROM hops WHERE lat2 IS NOT NULL"""),
    "path_ends": with_tables("symbols", "blocks", "block_rings", query=f"""
        , {_LOOP} SELECT hlb_id, arg_min(id, place) AS start_id, arg_max(id, place) AS end_id FROM loop GROUP BY 1"""),
    "path_annotations": with_tables("symbols", "blocks", "block_rings", "boundary_points", query=f"""
        , {_LOOP}, {_HOPS}, {_NN}, {_BND_AREA}, med AS (SELECT hlb_id, list(gap ORDER BY gap)[count(*) // 2 + 1] AS med FROM nn GROUP BY 1),
        cnt AS (SELECT hlb_id, count(*) AS n FROM symbols WHERE {_HOUSE} GROUP BY 1),
        j AS (SELECT h.*, block_id IS DISTINCT FROM b2 OR {t.hav('lat', 'lng', 'lat2', 'lng2')} > med * 2.2 AS jump,
                     atan2(-(lat2 - lat), (lng2 - lng) * cos(radians(lat))) AS ang, n > 60 OR n / (area / 10000) > 60 AS thin
              FROM hops h JOIN med USING (hlb_id) JOIN cnt USING (hlb_id) JOIN bnd USING (hlb_id) WHERE lat2 IS NOT NULL),
        p AS (SELECT *, lag(jump) OVER w AS pj, abs(ang - lag(ang) OVER w) AS da FROM j WINDOW w AS (PARTITION BY hlb_id ORDER BY place)),
        f AS (SELECT *, NOT jump AND NOT coalesce(pj, true) AND (CASE WHEN da > pi() THEN 2 * pi() - da ELSE da END) > 0.66 AS turn,
                     coalesce(pj, true) AS cs FROM p)
        SELECT hlb_id, id, place, jump AS is_jump, coalesce(turn, false) AS is_turn, cs AS cluster_start,
               NOT thin OR jump OR coalesce(turn, false) OR cs AS draw FROM f"""),
    "next_numbers": with_tables("symbols", "blocks", "block_rings", query=f"""
        , {_LOOP} SELECT n.hlb_id, next_id, next_number FROM (SELECT l.hlb_id, arg_min(l.id, place) AS next_id FROM loop l
            JOIN symbols s ON s.id = l.id WHERE s.number IS NULL AND symbol_type IN ('pucca_house', 'kutcha_house', 'apartment', 'non_residential') GROUP BY 1) n
        JOIN (SELECT hlb_id, min(v) AS next_number FROM (SELECT DISTINCT hlb_id, v FROM symbols, (SELECT unnest(generate_series(117, 2000)) AS v)) c
              WHERE NOT EXISTS (SELECT 1 FROM symbols s WHERE s.hlb_id = c.hlb_id AND s.number = c.v) GROUP BY 1) f USING (hlb_id)"""),
}
