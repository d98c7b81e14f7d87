"""Registered layout queries with their SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockwalk.functions import domain, geo
from blockwalk.operators import assign, features, layout
from blockwalk.plans import bindings as b
from blockwalk.plans import sqltext as t
from blockwalk.plans.bindings import with_tables
from blockwalk.plans.features import _BOUNDARY_AREA, _EMIT, _FARM_AREA, _TOUCH
from blockwalk.sources import osm, texts


def grid_chunks(s, d):
    r = lambda c: F.round(c, 8).alias(c)
    return layout.grid_chunks(b.boundaries(s, d), 97.0).select("hlb_id", "label", r("south"), r("west"), r("north"), r("east"))


def quadrant_blocks(s, d):
    return layout.quadrant_blocks(b.boundaries(s, d))


def square_offsets(s, d):
    k = F.col("c_custkey")
    groups = b.table(s, d, "customer").select(k.alias("key"), (k % 12).alias("count"), F.lit(100.0).alias("cx"),
                                              (k % 50).cast("double").alias("cy"), F.lit(10.0).alias("cell"))
    return layout.square_offsets(groups)


def estimated_houses(s, d):
    k = F.col("c_custkey")
    n = lambda v: v.cast("double")
    boxes = b.table(s, d, "customer").select(
        k.alias("key"), n(k % 100).alias("x1"), n(k % 80).alias("y1"), n(k % 100 + 40 + k % 31).alias("x2"), n(k % 80 + 30).alias("y2"),
        n(k % 90).alias("degrees"), (k % 14).alias("count"), F.lit(500.0).alias("width"), F.lit(500.0).alias("height"),
        F.lit(26.01).alias("north"), F.lit(26.0).alias("south"), F.lit(80.01).alias("east"), F.lit(80.0).alias("west"))
    return layout.estimated_houses(boxes).select("key", "i", F.round("lat", 9).alias("lat"), F.round("lng", 9).alias("lng"))


def grid_snap(s, d):
    return layout.snap_to_grid(b.symbols(s, d), 26.0).select("hlb_id", "id", "row", "col", "collision", "leader")


def grid_size(s, d):
    return layout.grid_size(b.symbols(s, d), b.boundaries(s, d)).select("hlb_id", "symbols", F.col("grid_m").cast("long").alias("grid_m"))


def block_detect(s, d):
    return layout.detect_blocks(b.boundaries(s, d), b.roads(s, d)).select(
        "hlb_id", "label", "area_m2", F.round("clat", 6).alias("clat"), F.round("clng", 6).alias("clng"))


def _block_jobs(s, d):
    return b.blocks(s, d).withColumn("count", F.lit(20) + F.col("block_id") * 15)


def lattice(s, d):
    blocks = _block_jobs(s, d)
    kept = layout.preserved_symbols(b.symbols(s, d), blocks).withColumn("ring", F.col("exclusion"))
    return layout.lattice(blocks.withColumn("ring", assign.block_ring()), kept, b.roads(s, d)).groupBy("hlb_id", "block_id").agg(
        F.count(F.lit(1)).alias("candidates"), F.round(F.min("edge_m"), 2).alias("least_edge_m"), F.round(F.first("step"), 6).alias("step"))


def place_groups(s, d):
    group = lambda i, kind, n, units: F.struct(F.lit(i).alias("position"), F.lit(kind).alias("symbol_type"), n.alias("count"),
                                               F.lit(units).cast("int").alias("unit_count"), F.lit(False).alias("non_residential"))
    groups = _block_jobs(s, d).select("hlb_id", "block_id", F.explode(F.array(
        group(0, "pucca_house", F.lit(12).cast("long"), None), group(1, "apartment", F.lit(5).cast("long"), 4),
        group(2, "non_residential", F.col("count") - 20, None))).alias("_g")).select("hlb_id", "block_id", "_g.*")
    return layout.populate(_block_jobs(s, d), groups, b.symbols(s, d), b.roads(s, d), "serpentine").select("hlb_id", "block_id", "slot", "symbol_type", "unit_count", "is_residential")


def _pixels(s, d):
    k = F.col("l_orderkey")
    return b.table(s, d, "lineitem").select(
        F.floor(k / 1000).cast("long").alias("hlb_id"), F.floor(k % 1000 / 32).cast("long").alias("cy"), (k % 32).alias("cx"),
        F.col("l_shipdate").cast("date").alias("day"),
        ((F.floor(k % 1000 / 128) + F.floor(k % 32 / 8) + F.when(F.col("l_suppkey") % 3 == 0, F.col("l_linenumber")).otherwise(0)) % 6).alias("label"))


def landcover_patches(s, d):
    found = layout.landcover_patches(_pixels(s, d), "1996-01-01", "2001-01-01")
    return found.groupBy("hlb_id", "landuse_type", "patch").agg(F.count(F.lit(1)).alias("pixels"))


def landcover_mode(s, d):
    found = layout.landcover_patches(_pixels(s, d), "1996-01-01", "2001-01-01")
    return found.select("hlb_id", "cy", "cx", "landuse_type")


def landcover_merge(s, d):
    """Land-use polygons of thinly farmed areas, extended by land-cover squares about every customer."""
    found = features.classify_elements(b.osm_elements(s, d), b.boundaries(s, d))
    k = F.col("c_custkey")
    y, x = b._lat(k % 1000), b._lng(k % 1000)
    cover = b.table(s, d, "customer").select(
        F.floor(k / 1000).cast("long").alias("hlb_id"), F.when(k % 2 == 0, "water").otherwise("forest").alias("landuse_type"),
        F.array(geo.point(y, x), geo.point(y, x + 1e-4), geo.point(y + 1e-4, x)).alias("points"))
    farms = features.farmland_letters(found, b.osm_elements(s, d))
    return features.add_landcover(found.filter("kind = 'landuse'"), farms, cover, b.boundaries(s, d)) \
        .groupBy("hlb_id", "feature_type").agg(F.count(F.lit(1)).alias("polygons"))


def road_names(s, d):
    k = F.col("l_orderkey")
    traces = b.table(s, d, "lineitem").select(
        F.col("l_suppkey").alias("road"), (k * 10 + F.col("l_linenumber")).alias("pos"),
        F.when(k % 4 == 0, "Route").when(k % 4 == 1, "  ").otherwise(F.concat(F.lit("Street "), (k % 7).cast("string"))).alias("name"))
    return features.road_name(traces, ["road"])


def element_dedupe(s, d):
    """Repeated elements by (type, id), and label boxes by 10-pixel cell."""
    k = F.col("l_orderkey")
    rows = b.table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    elements = rows.select((k % 500).alias("id"), F.when(k % 2 == 0, "way").otherwise("node").alias("type"),
                           (k * 10 + F.col("l_linenumber")).alias("pos"), F.col("p").alias("payload"))
    return osm.first_of_each(elements, ["type", "id"])


def box_dedupe(s, d):
    k = F.col("p_partkey")
    boxes = b.table(s, d, "part").select((k % 40).alias("page"), (k * 37 % 300).alias("x"), (k * 11 % 200).alias("y"), k.alias("threshold"))
    return osm.distinct_boxes(boxes, ["page"])


def best_label(s, d):
    k = F.col("l_orderkey")
    spans = b.table(s, d, "lineitem").groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")) \
        .select(F.col("l_suppkey").alias("page"), (k * 10 + F.col("l_linenumber")).alias("pos"),
                F.concat(F.lit("HLB "), (k % 300).cast("string"), F.when(k % 5 == 0, " block").otherwise("")).alias("text"),
                (k % 600).alias("col"), (k % 800).alias("row"))
    return texts.best_label(spans, "page", F.lit("12"))


def label_codes(s, d):
    """Block codes read from labels: letter O as zero, leading zeros ignored, pictographs stripped."""
    k = F.col("o_orderkey")
    raw = F.concat(F.when(k % 3 == 0, "O0").when(k % 3 == 1, "0").otherwise("🏠  "), (k % 97).cast("string"))
    return b.table(s, d, "orders").select(
        k.alias("id"), domain.strip_label(raw).alias("label"), domain.same_code(raw, F.lit("0012")).alias("same"),
        domain.contains_code(raw, F.lit("0012")).alias("contains"))


def contact_fields(s, d):
    """Client address, phone and order route as the event and payment intake derive them."""
    k = F.col("o_orderkey")
    ip = F.concat(F.when(k % 4 == 0, "10.").when(k % 4 == 1, "203.").when(k % 4 == 2, "127.").otherwise("192.168."), (k % 200).cast("string"), F.lit(".1.2"))
    head = F.concat(F.lit(" "), ip, F.lit(" , 8.8.8.8"))
    phone = F.concat(F.lit("+91 "), F.when(k % 3 == 0, "98-").otherwise("7"), (k * 7919 % 100000000).cast("string"))
    order_id = F.concat(F.when(k % 5 == 0, "don_").when(k % 5 == 1, "live_").when(k % 5 == 2, "lrg_").otherwise("ord_"), k.cast("string"))
    out = b.table(s, d, "orders").select(k.alias("id"), domain.client_ip(head).alias("ip"), domain.phone_last10(phone, "9999999999").alias("phone"),
                                         domain.order_route(order_id).alias("route"))
    return out.withColumn("private", domain.is_private_ip(F.col("ip")))


QUERIES = {f.__name__: f for f in (
    grid_chunks, quadrant_blocks, square_offsets, estimated_houses, grid_snap, grid_size, block_detect, lattice, place_groups,
    landcover_patches, landcover_mode, landcover_merge, road_names, element_dedupe, box_dedupe, best_label, label_codes, contact_fields)}

_PIX = """px AS (SELECT l_orderkey // 1000 AS hlb_id, (l_orderkey % 1000) // 32 AS cy, l_orderkey % 32 AS cx,
    ((l_orderkey % 1000) // 128 + (l_orderkey % 32) // 8 + CASE WHEN l_suppkey % 3 = 0 THEN l_linenumber ELSE 0 END) % 6 AS label
  FROM lineitem WHERE CAST(l_shipdate AS DATE) >= DATE '1996-01-01' AND CAST(l_shipdate AS DATE) < DATE '2001-01-01'),
  md AS (SELECT hlb_id, cy, cx, label FROM (SELECT hlb_id, cy, cx, label, count(*) AS n FROM px GROUP BY 1, 2, 3, 4)
         QUALIFY row_number() OVER (PARTITION BY hlb_id, cy, cx ORDER BY n DESC, label) = 1),
  kp AS (SELECT hlb_id, cy, cx, CASE label WHEN 0 THEN 'water' WHEN 1 THEN 'forest' ELSE 'farmland' END AS landuse_type,
                cy * 10000000 + cx AS id FROM md WHERE label IN (0, 1, 4))"""
_BOX = "bb AS (SELECT hlb_id, min(lat) AS s, max(lat) AS n, min(lng) AS w, max(lng) AS e FROM boundary_points GROUP BY 1)"
CHECKS = {
    "landcover_merge": with_tables("osm_elements", "boundary_points", query=f"""
        , {_TOUCH}, {_EMIT},
        f AS (SELECT hlb_id, sum({_FARM_AREA}) AS farm FROM touching WHERE br = 6 AND nv = 4 GROUP BY 1),
        thin AS (SELECT a.hlb_id FROM {_BOUNDARY_AREA} a LEFT JOIN f USING (hlb_id) WHERE floor(coalesce(farm, 0) + 0.5) < area * 0.4),
        cover AS (SELECT c_custkey AS id, c_custkey // 1000 AS hlb_id, CASE WHEN c_custkey % 2 = 0 THEN 'water' ELSE 'forest' END AS feature_type,
                         {b.LAT.format(k='c_custkey % 1000')} AS lat, {b.LNG.format(k='c_custkey % 1000')} AS lng FROM customer),
        inside AS (SELECT c.id, any_value(c.hlb_id) AS hlb_id, any_value(feature_type) AS feature_type FROM cover c JOIN thin USING (hlb_id) JOIN edges e USING (hlb_id)
                   GROUP BY 1 HAVING count(*) FILTER (WHERE {t.crosses('c.lat', 'c.lng')}) % 2 = 1)
        SELECT hlb_id, feature_type, count(*) AS polygons FROM (
          SELECT hlb_id, feature_type FROM emitted WHERE kind = 'landuse' UNION ALL SELECT hlb_id, feature_type FROM inside) GROUP BY 1, 2"""),
    "grid_chunks": with_tables("boundary_points", query=f"""
        , {_BOX}, st AS (SELECT *, 97.0::DOUBLE / 111111 AS dy, 97.0::DOUBLE / (111111 * cos(radians((s + n) / 2))) AS dx FROM bb),
        r AS (SELECT *, unnest(range(0, CAST(ceil((n - s) / dy) AS BIGINT))) AS r FROM st),
        c AS (SELECT *, unnest(range(0, CAST(ceil((e - w) / dx) AS BIGINT))) AS c FROM r)
        SELECT hlb_id, chr(CAST(65 + r % 26 AS INT)) || (c + 1) AS label, round(s + r * dy, 8) AS south, round(w + c * dx, 8) AS west,
               round(s + r * dy + dy, 8) AS north, round(w + c * dx + dx, 8) AS east FROM c"""),
    "quadrant_blocks": with_tables("boundary_points", query=f"""
        , {_BOX} SELECT hlb_id, label, CASE WHEN label[1] = 'N' THEN (s + n) / 2 ELSE s END AS south, CASE WHEN label[1] = 'N' THEN n ELSE (s + n) / 2 END AS north,
          CASE WHEN label[2] = 'W' THEN w ELSE (e + w) / 2 END AS west, CASE WHEN label[2] = 'W' THEN (e + w) / 2 ELSE e END AS east
        FROM bb, (SELECT unnest(['NW', 'NE', 'SW', 'SE']) AS label)"""),
    "square_offsets": """
        WITH g AS (SELECT c_custkey AS key, c_custkey % 12 AS n, CAST(ceil(sqrt(c_custkey % 12)) AS BIGINT) AS cols FROM customer WHERE c_custkey % 12 > 0),
        i AS (SELECT *, CAST(ceil(n / cols) AS BIGINT) AS rows_, unnest(range(0, n)) AS i FROM g)
        SELECT key, i, 100.0 - (cols - 1) * 5.0 + (i % cols) * 10.0::DOUBLE AS x, key % 50 - (rows_ - 1) * 5.0 + (i // cols) * 10.0::DOUBLE AS y FROM i""",
    "estimated_houses": """
        WITH q AS (SELECT c_custkey AS key, greatest(1, c_custkey % 14) AS n, 40.0::DOUBLE + c_custkey % 31 AS w, 30.0::DOUBLE AS h, c_custkey % 100 AS x1,
                          c_custkey % 80 AS y1, radians((c_custkey % 90)::DOUBLE) AS th FROM customer),
        c AS (SELECT *, greatest(1, CAST(floor(sqrt(n * w / h) + 0.5) AS BIGINT)) AS cols FROM q),
        r AS (SELECT *, greatest(1, CAST(floor(n / cols + 0.5) AS BIGINT)) AS rows_ FROM c),
        g AS (SELECT *, unnest(range(0, least(n, cols * rows_))) AS i FROM r),
        o AS (SELECT *, (i % cols + 0.5) * w / cols - w / 2 AS ox, (i // cols + 0.5) * h / rows_ - h / 2 AS oy FROM g)
        SELECT key, i, round(26.01 - (y1 + 15 + ox * sin(th) + oy * cos(th)) / 500 * 0.01, 9) AS lat,
               round(80.0 + (x1 + w / 2 + ox * cos(th) - oy * sin(th)) / 500 * 0.01, 9) AS lng FROM o""",
    "grid_snap": with_tables("symbols", query=f"""
        , bs AS (SELECT hlb_id, min(lat) AS y0, min(lng) AS x0, avg(lat) AS ym FROM symbols GROUP BY 1),
        g AS (SELECT s.*, y0, x0, 26.0::DOUBLE / 111320 AS dy, 26.0::DOUBLE / 111320 / cos(radians(ym)) AS dx FROM symbols s JOIN bs USING (hlb_id)),
        c AS (SELECT *, CAST(floor((lat - y0) / dy + 0.5) AS BIGINT) AS row, CAST(floor((lng - x0) / dx + 0.5) AS BIGINT) AS col FROM g)
        SELECT hlb_id, id, row, col, row_number() OVER (PARTITION BY hlb_id, row, col ORDER BY symbol_type = 'well', pos) > 1 AS collision,
               {t.flat('lat', 'lng', 'y0 + row * dy', 'x0 + col * dx')} > 18 AS leader FROM c"""),
    "grid_size": with_tables("symbols", "boundary_points", query=f"""
        , a AS (SELECT hlb_id, abs(sum((xj - 80) * (yi - 26) - (xi - 80) * (yj - 26))) * pow(111320.0::DOUBLE, 2) / 2 * cos(radians(avg(yi))) / 10000 AS ha
                FROM ({t.edges('boundary_points', 'hlb_id')}) GROUP BY 1)
        SELECT hlb_id, count(*) AS symbols, CASE WHEN count(*) / any_value(ha) > 80 THEN 22 WHEN count(*) / any_value(ha) > 40 THEN 26
               WHEN count(*) / any_value(ha) > 15 THEN 28 ELSE 24 END::BIGINT AS grid_m FROM symbols JOIN a USING (hlb_id) GROUP BY 1"""),
    "landcover_mode": f"WITH {_PIX} SELECT hlb_id, cy, cx, landuse_type FROM kp",
    "landcover_patches": f"""
        WITH RECURSIVE {_PIX},
        reach(hlb_id, landuse_type, a, id) AS (SELECT hlb_id, landuse_type, id, id FROM kp
          UNION SELECT r.hlb_id, r.landuse_type, r.a, k.id FROM reach r JOIN kp k ON k.hlb_id = r.hlb_id AND k.landuse_type = r.landuse_type
            AND (k.id IN (r.id - 10000000, r.id + 10000000, r.id - 1, r.id + 1))),
        c AS (SELECT hlb_id, landuse_type, a, min(id) AS patch FROM reach GROUP BY 1, 2, 3)
        SELECT hlb_id, landuse_type, patch, count(*) AS pixels FROM c GROUP BY 1, 2, 3""",
    "road_names": """
        WITH tr AS (SELECT l_suppkey AS road, l_orderkey * 10 + l_linenumber AS pos, 'Street ' || l_orderkey % 7 AS name FROM lineitem WHERE l_orderkey % 4 > 1)
        SELECT road, name AS road_name FROM (SELECT road, name, count(*) AS n, min(pos) AS f FROM tr GROUP BY 1, 2)
        QUALIFY row_number() OVER (PARTITION BY road ORDER BY n DESC, f) = 1""",
    "element_dedupe": """
        SELECT l_orderkey % 500 AS id, CASE WHEN l_orderkey % 2 = 0 THEN 'way' ELSE 'node' END AS type, l_orderkey * 10 + l_linenumber AS pos, p AS payload
        FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2)
        QUALIFY row_number() OVER (PARTITION BY l_orderkey % 500, l_orderkey % 2 ORDER BY l_orderkey * 10 + l_linenumber) = 1""",
    "box_dedupe": """
        SELECT p_partkey % 40 AS page, p_partkey * 37 % 300 AS x, p_partkey * 11 % 200 AS y, p_partkey AS threshold FROM part
        QUALIFY row_number() OVER (PARTITION BY p_partkey % 40, (p_partkey * 37 % 300) // 10, (p_partkey * 11 % 200) // 10 ORDER BY p_partkey) = 1""",
    "best_label": """
        SELECT page, text, col, row FROM (SELECT DISTINCT l_suppkey AS page, l_orderkey * 10 + l_linenumber AS pos, l_orderkey % 600 AS col, l_orderkey % 800 AS row,
          'HLB ' || l_orderkey % 300 || CASE WHEN l_orderkey % 5 = 0 THEN ' block' ELSE '' END AS text FROM lineitem) WHERE contains(text, '12')
        QUALIFY row_number() OVER (PARTITION BY page ORDER BY length(text), pos) = 1""",
    "label_codes": """
        SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'O0' WHEN 1 THEN '0' ELSE '' END || n AS label,
               CASE o_orderkey % 3 WHEN 0 THEN '00' || n = '0012' WHEN 1 THEN '0' || n = '0012' ELSE false END AS same,
               contains(CASE o_orderkey % 3 WHEN 0 THEN 'O0' || n WHEN 1 THEN ltrim('0' || n, '0') ELSE '🏠  ' || n END, '12') AS contains
        FROM (SELECT o_orderkey, CAST(o_orderkey % 97 AS VARCHAR) AS n FROM orders)""",
    "contact_fields": """
        SELECT id, ip, CASE WHEN length(digits) >= 10 THEN right(digits, 10) ELSE '9999999999' END AS phone,
               CASE id % 5 WHEN 0 THEN 'donation' WHEN 1 THEN 'live_session' WHEN 2 THEN 'live_regen' ELSE 'map' END AS route, id % 4 <> 1 AS private
        FROM (SELECT o_orderkey AS id, ['10.', '203.', '127.', '192.168.'][o_orderkey % 4 + 1] || o_orderkey % 200 || '.1.2' AS ip,
                     '91' || CASE WHEN o_orderkey % 3 = 0 THEN '98' ELSE '7' END || (o_orderkey * 7919 % 100000000) AS digits FROM orders)""",
}
