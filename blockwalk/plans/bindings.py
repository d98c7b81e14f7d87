"""The given parquet tables seen as the survey relations, for Spark and for the SQL check.

Positions are integer arithmetic on keys, so that both engines compute the same
doubles.  One function per relation returns a DataFrame; ``SQL`` holds the same
relation as a common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwalk.functions import geo

EVENT_AS_OF = "2024-01-31 00:00:00"
ORDER_AS_OF = "2001-08-02 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lat(k):
    return F.lit(26.0) + ((k * 7919) % 1000) / F.lit(100000.0)


def _lng(k):
    return F.lit(80.0) + ((k * k * 37 + k * 11) % 997) / F.lit(100000.0)


LAT = "26.0 + ((({k}) * 7919) % 1000) / 100000.0"
LNG = "80.0 + ((({k}) * ({k}) * 37 + ({k}) * 11) % 997) / 100000.0"


# ------------------------------------------------------------- accounts

def user_events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("created_at"),
        "user_id", "event_type", F.col("props").alias("metadata"), "value")


def user_profiles(spark, sf_dir):
    """First sight of a user is the sign-up; place names come from the customer of that key."""
    seen = user_events(spark, sf_dir).groupBy(F.col("user_id").alias("id")).agg(
        F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"))
    place = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left") \
        .select(F.col("c_custkey").alias("id"), F.col("c_name").alias("full_name"),
                F.col("n_name").alias("tehsil"), F.col("c_mktsegment").alias("town_village"),
                F.concat(F.lit("98"), F.lpad((F.col("c_custkey") * 7919 % 100000000).cast("string"), 8, "0"))
                .alias("mobile"))
    return seen.join(place, "id", "left") \
        .withColumn("onboarding_completed", F.col("id") % 3 != 0) \
        .withColumn("is_admin", F.col("id") % 50 == 0)


def projects(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"),
        F.concat(F.lit("HLB "), F.col("o_orderkey").cast("string")).alias("name"),
        F.when(F.col("o_orderstatus") == "F", "paid").otherwise("unpaid").alias("payment_status"),
        F.concat(F.lit("pay_"), F.col("o_orderkey").cast("string")).alias("payment_id"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.col("o_orderdate").cast("timestamp").alias("updated_at"))


def payment_events(spark, sf_dir):
    kind = F.col("event_id") % 4
    return table(spark, sf_dir, "events").filter(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("id"),
        F.when(kind == 0, "map").when(kind == 1, "live_session").when(kind == 2, "donation").otherwise("upi")
        .alias("source_type"),
        F.col("user_id").alias("source_id"), F.round(F.col("value") * 100).cast("long").alias("amount_paise"),
        F.when(F.col("event_id") % 5 == 0, "upi").when(F.col("event_id") % 5 == 1, "card").otherwise("cashfree")
        .alias("payment_method"),
        F.col("ts").cast("timestamp").alias("created_at"))


def live_exports(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("user_id"),
        F.when(F.col("o_orderstatus") == "F", "paid").otherwise("unpaid").alias("payment_status"),
        F.concat(F.lit("pay_"), F.col("o_orderkey").cast("string")).alias("payment_id"),
        (F.col("o_orderkey") % 5).alias("regen_used"), F.col("o_orderdate").cast("timestamp").alias("created_at"))


def donations(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"),
        F.col("o_totalprice").alias("amount"),
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderstatus") == "F").alias("is_paid"),
        F.when(F.col("o_orderkey") % 13 == 0, "paid").otherwise("created").alias("payment_status"),
        F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit("Donor "), F.col("o_custkey").cast("string")))
        .alias("name"),
        F.when(F.col("o_orderkey") % 4 == 0, F.lit(" ")).otherwise(F.col("o_orderpriority")).alias("note"),
        F.concat(F.lit("pay_"), F.col("o_orderkey").cast("string")).alias("payment_id"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"))


def project_assignments(spark, sf_dir):
    """Every project is also assigned to the customer 17 keys below its owner."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("project_id"), F.abs(F.col("o_custkey") - 17).alias("user_id"))


def image_generations(spark, sf_dir, kind="all"):
    """Every event is one picture: clicks are of one kind, all others of the other."""
    click = F.col("event_type") == "click"
    keep = {"all": F.lit(True), "click": click, "other": ~click}[kind]
    return table(spark, sf_dir, "events").filter(keep).select(
        F.col("event_id").alias("id"), F.col("user_id").alias("project_id"), "user_id",
        F.col("ts").cast("timestamp").alias("created_at"))


# ------------------------------------------------------------- map objects

def symbols(spark, sf_dir):
    key = F.col("o_orderkey")
    k = key % 1000
    kind = key % 8
    return table(spark, sf_dir, "orders").select(
        F.floor(key / 1000).cast("long").alias("hlb_id"), key.alias("id"), key.alias("pos"),
        F.when(kind.isin(0, 6), "pucca_house").when(kind == 1, "kutcha_house").when(kind == 2, "apartment")
        .when(kind == 3, "non_residential").when(kind == 4, "temple").when(kind == 5, "well").otherwise("school")
        .alias("symbol_type"),
        _lat(k).alias("lat"), _lng(k).alias("lng"),
        F.when(key % 5 != 0, k + 1).alias("number"),
        F.when(kind == 2, F.lit(1) + F.floor(key / 8) % 4).alias("unit_count"),
        (key % 9 == 0).alias("number_locked"),
        F.when(key % 7 == 0, True).when(key % 7 == 1, False).alias("is_residential"),
        F.when(key % 11 == 0, "A").alias("sub_number"))


def schedule_answers(spark, sf_dir):
    """Partly legacy, partly current form answers per house."""
    k = F.col("o_orderkey")
    some = lambda every, value: F.when(k % every != 0, value)
    return table(spark, sf_dir, "orders").select(
        F.floor(k / 1000).cast("long").alias("hlb_id"), k.alias("id"),
        some(4, k % 8).cast("int").alias("col_4_floor"),
        F.when(k % 3 == 0, k % 10).cast("int").alias("col_5_wall"),
        F.when(k % 3 != 0, k % 10).cast("int").alias("col_6_wall_material"),
        some(5, k % 9).cast("int").alias("col_6_roof"),
        F.when(k % 2 == 0, k % 5).cast("int").alias("col_7_use"),
        some(6, k % 4).cast("int").alias("col_4_use_type"),
        F.when(k % 3 == 1, k % 6 + 1).cast("int").alias("col_9_family_count"),
        F.when(k % 17 == 0, 999).cast("int").alias("col_9_household_no"),
        F.when(k % 5 == 1, F.concat(F.lit("Head "), k.cast("string"))).alias("col_10_head_name"),
        F.when(k % 5 == 2, F.concat(F.lit("Kin "), k.cast("string"))).alias("head_of_household"),
        F.when(k % 5 == 3, F.lit("")).alias("col_11_head_name"),
        F.when(k % 4 == 1, k % 7).cast("int").alias("col_18_water_source"),
        F.when(k % 4 == 2, k % 2 == 0).alias("col_19_electricity"),
        F.when(k % 6 == 1, k % 2 == 1).alias("asset_bicycle"),
        F.when(k % 6 <= 2, k % 4 == 0).alias("asset_scooter_motorcycle"),
        F.when(k % 3 == 2, k % 4 + 1).cast("int").alias("col_20_latrine"),
        F.when(k % 2 == 1, k % 7 + 1).cast("int").alias("col_24_kitchen"))


def blocks(spark, sf_dir):
    """Four quadrant blocks per survey area; even ones carry a slanted ring that overlaps its neighbour."""
    areas = symbols(spark, sf_dir).select("hlb_id").distinct()
    b = F.col("block_id")
    out = areas.withColumn("block_id", F.explode(F.array(*[F.lit(i).cast("long") for i in range(4)])))
    out = out.withColumns({
        "south": F.lit(26.0) + F.floor(b / 2) * 0.005, "west": F.lit(80.0) + (b % 2) * 0.005})
    out = out.withColumns({"north": F.col("south") + 0.005, "east": F.col("west") + 0.005})
    ring = F.array(geo.point("north", "west"), geo.point(F.col("north"), F.col("east") + 0.0004),
                   geo.point(F.col("south") - 0.0003, F.col("east")), geo.point("south", "west"))
    return out.withColumn("points", F.when(b % 2 == 0, ring)).withColumn("pos", b)


def boundaries(spark, sf_dir):
    ring = F.array(*[geo.point(F.lit(y), F.lit(x)) for y, x in
                     ((26.0005, 80.0005), (26.0095, 80.001), (26.0085, 80.0095), (26.004, 80.008), (26.001, 80.009))])
    return symbols(spark, sf_dir).select("hlb_id").distinct().withColumn("ring", ring)


def roads(spark, sf_dir):
    """Five east-west roads per survey area, three vertices each."""
    areas = symbols(spark, sf_dir).select("hlb_id").distinct()
    j = F.col("j")
    y = F.lit(26.0) + (j + 1) * 0.0016
    classes = F.array(*[F.lit(c) for c in ("primary", "residential", "track", "footway", "steps")])
    return areas.withColumn("j", F.explode(F.array(*[F.lit(i).cast("long") for i in range(5)]))).select(
        "hlb_id", (F.col("hlb_id") * 10 + j).alias("road_id"), j.alias("pos"),
        F.element_at(classes, (j + 1).cast("int")).alias("highway"),
        F.concat(F.lit("Road "), j.cast("string")).alias("name"),
        (F.col("hlb_id") * 10 + j).alias("osm_id"),
        F.array(geo.point(y, F.lit(80.0)), geo.point(y + 0.0002, F.lit(80.005)), geo.point(y, F.lit(80.01)))
        .alias("coords"))


def buildings(spark, sf_dir):
    """Footprint centres of three providers, shifted so that many coincide."""
    def source(name, key, label, conf):
        k = F.col(key) % 1000
        return table(spark, sf_dir, name).select(
            F.floor(F.col(key) / 1000).cast("long").alias("hlb_id"), F.col(key).alias("id"),
            F.lit(label).alias("source"), (_lat(k) + (F.col(key) % 5) * 1e-5).alias("lat"),
            (_lng(k) + (F.col(key) % 3) * 1e-5).alias("lng"), conf.alias("confidence"),
            (F.col(key) % 40).cast("double").alias("area_sqm"))

    return source("customer", "c_custkey", "osm", F.lit(None).cast("double")) \
        .unionByName(source("part", "p_partkey", "google", F.col("p_size") / 50.0)) \
        .unionByName(source("orders", "o_orderkey", "microsoft", F.lit(None).cast("double")))


def gps_points(spark, sf_dir):
    """One session per user: a slow drift with jitter; every third user stands still."""
    e = F.col("event_id")
    t = F.unix_seconds(F.col("ts").cast("timestamp")) - F.lit(1704067200)
    drift = F.when(F.col("user_id") % 3 == 0, F.lit(0.0)).otherwise(t * 1e-8)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), e.alias("point_id"), F.col("ts").cast("timestamp").alias("ts"),
        (F.lit(26.001) + drift + ((e * 31) % 7 - 3) * 2e-6 * (F.col("user_id") % 3)).alias("lat"),
        (F.lit(80.001) + drift * 0.5 + ((e * 17) % 11 - 5) * 2e-6 * (F.col("user_id") % 3)).alias("lng"),
        (e % 60).cast("double").alias("accuracy"), (F.col("value") / 60.0).alias("speed"),
        F.lit(None).cast("double").alias("heading"))


def osm_elements(spark, sf_dir):
    """Ways and nodes whose tags exercise every classification branch."""
    k = F.col("p_partkey")
    at, on = k % 1000, k % 20
    m = lambda *kv: F.create_map(*[x if not isinstance(x, str) else F.lit(x) for x in kv])
    name = F.concat(F.lit("Site "), F.col("p_name"))
    tags = (F.when(on == 0, m("building", "yes", "building:levels", F.col("p_size").cast("string")))
            .when(on == 1, m("building", "hut")).when(on == 2, m("building", "school", "name", name))
            .when(on == 3, m("building", "retail", "shop", "yes"))
            .when(on == 4, m("amenity", "place_of_worship", "religion", "muslim", "name:hi", name))
            .when(on == 5, m("amenity", "clinic", "name", name)).when(on == 6, m("landuse", "farmland"))
            .when(on == 7, m("landuse", "farmland", "name", name)).when(on == 8, m("landuse", "forest"))
            .when(on == 9, m("natural", "water")).when(on == 10, m("natural", "water", "name", name))
            .when(on == 11, m("waterway", "canal")).when(on == 12, m("waterway", "ditch", "name", name))
            .when(on == 13, m("amenity", "water_well")).when(on == 14, m("leisure", "park"))
            .when(on == 15, m("tourism", "museum")).when(on == 16, m("shop", "bakery", "name:zz", name))
            .when(on == 17, m("highway", "track", "name", name)).when(on == 18, m("natural", "scrub"))
            .otherwise(m("landuse", "reservoir", "p_type", F.col("p_type"))))
    lat, lng = _lat(at), _lng(at)
    corner = lambda dy, dx: F.struct((lat + dy).alias("lat"), (lng + dx).alias("lon"))
    d = 1e-4 + (k % 3) * 1e-5
    way = F.array(corner(0.0, 0.0), corner(0.0, d), corner(d, d), corner(d, 0.0))
    return table(spark, sf_dir, "part").select(
        F.floor(k / 1000).cast("long").alias("hlb_id"), k.alias("pos"), k.alias("id"),
        F.when(k % 3 == 0, "node").otherwise("way").alias("type"),
        F.when(k % 3 == 0, lat).alias("lat"), F.when(k % 3 == 0, lng).alias("lon"), tags.alias("tags"),
        F.when(k % 3 != 0, way).alias("geometry"))


def sms_texts(spark, sf_dir):
    """Prose with a survey message at its end, in one of five forms."""
    k = F.col("doc_id")
    lat = F.concat(F.lit("26."), F.lpad((k % 1000).cast("string"), 4, "0"))
    lng = F.concat(F.lit("80."), F.lpad((k * 7 % 1000).cast("string"), 4, "0"))
    code = F.concat(F.lit(" HLB "), F.lpad((k % 10000).cast("string"), 4, "0"))
    tail = (F.when(k % 5 == 0, F.concat(code, F.lit(" https://maps.example.org/?q="), lat, F.lit(","), lng))
            .when(k % 5 == 1, F.concat(code, F.lit(" https://maps.example.org/@"), lat, F.lit(","), lng))
            .when(k % 5 == 2, F.concat(F.lit(" at "), lat, F.lit(", "), lng))
            .when(k % 5 == 3, code).otherwise(F.lit("")))
    return table(spark, sf_dir, "documents").select(k.alias("id"), F.concat("text", tail).alias("text"))


# ----------------------------------------------------- the same, as SQL

SQL = {
    "user_events": "SELECT event_id AS id, ts AS created_at, user_id, event_type, props AS metadata, value FROM events",
    "user_profiles": """
        SELECT s.id, s.created_at, s.updated_at, p.full_name, p.tehsil, p.town_village, p.mobile,
               s.id % 3 <> 0 AS onboarding_completed, s.id % 50 = 0 AS is_admin
        FROM (SELECT user_id AS id, min(ts) AS created_at, max(ts) AS updated_at FROM events GROUP BY 1) s
        LEFT JOIN (SELECT c_custkey AS id, c_name AS full_name, n_name AS tehsil, c_mktsegment AS town_village,
                          '98' || lpad(CAST(c_custkey * 7919 % 100000000 AS VARCHAR), 8, '0') AS mobile
                   FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey) p ON s.id = p.id""",
    "projects": """
        SELECT o_orderkey AS id, o_custkey AS user_id, 'HLB ' || o_orderkey AS name,
               CASE WHEN o_orderstatus = 'F' THEN 'paid' ELSE 'unpaid' END AS payment_status,
               'pay_' || o_orderkey AS payment_id, o_orderdate AS created_at, o_orderdate AS updated_at FROM orders""",
    "payment_events": """
        SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'map' WHEN 1 THEN 'live_session'
               WHEN 2 THEN 'donation' ELSE 'upi' END AS source_type, user_id AS source_id,
               CAST(round(value * 100) AS BIGINT) AS amount_paise,
               CASE event_id % 5 WHEN 0 THEN 'upi' WHEN 1 THEN 'card' ELSE 'cashfree' END AS payment_method,
               ts AS created_at FROM events WHERE event_type = 'purchase'""",
    "live_exports": """
        SELECT o_orderkey AS session_id, o_custkey AS user_id,
               CASE WHEN o_orderstatus = 'F' THEN 'paid' ELSE 'unpaid' END AS payment_status,
               'pay_' || o_orderkey AS payment_id, o_orderkey % 5 AS regen_used, o_orderdate AS created_at
        FROM orders""",
    "donations": """
        SELECT o_orderkey AS id, o_custkey AS user_id, o_totalprice AS amount,
               CASE WHEN o_orderkey % 11 <> 0 THEN o_orderstatus = 'F' END AS is_paid,
               CASE WHEN o_orderkey % 13 = 0 THEN 'paid' ELSE 'created' END AS payment_status,
               CASE WHEN o_orderkey % 7 <> 0 THEN 'Donor ' || o_custkey END AS name,
               CASE WHEN o_orderkey % 4 = 0 THEN ' ' ELSE o_orderpriority END AS note,
               'pay_' || o_orderkey AS payment_id, o_orderdate AS created_at FROM orders""",
    "project_assignments": """
        SELECT o_orderkey AS project_id, abs(o_custkey - 17) AS user_id FROM orders""",
    "symbols": f"""
        SELECT o_orderkey // 1000 AS hlb_id, o_orderkey AS id, o_orderkey AS pos,
               CASE o_orderkey % 8 WHEN 0 THEN 'pucca_house' WHEN 6 THEN 'pucca_house' WHEN 1 THEN 'kutcha_house'
                    WHEN 2 THEN 'apartment' WHEN 3 THEN 'non_residential' WHEN 4 THEN 'temple' WHEN 5 THEN 'well'
                    ELSE 'school' END AS symbol_type,
               {LAT.format(k='o_orderkey % 1000')} AS lat, {LNG.format(k='o_orderkey % 1000')} AS lng,
               CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 1000 + 1 END AS number,
               CASE WHEN o_orderkey % 8 = 2 THEN 1 + (o_orderkey // 8) % 4 END AS unit_count,
               o_orderkey % 9 = 0 AS number_locked,
               CASE o_orderkey % 7 WHEN 0 THEN true WHEN 1 THEN false END AS is_residential,
               CASE WHEN o_orderkey % 11 = 0 THEN 'A' END AS sub_number FROM orders""",
    "schedule_answers": """
        SELECT k // 1000 AS hlb_id, k AS id, CASE WHEN k % 4 <> 0 THEN k % 8 END AS col_4_floor,
               CASE WHEN k % 3 = 0 THEN k % 10 END AS col_5_wall,
               CASE WHEN k % 3 <> 0 THEN k % 10 END AS col_6_wall_material,
               CASE WHEN k % 5 <> 0 THEN k % 9 END AS col_6_roof, CASE WHEN k % 2 = 0 THEN k % 5 END AS col_7_use,
               CASE WHEN k % 6 <> 0 THEN k % 4 END AS col_4_use_type,
               CASE WHEN k % 3 = 1 THEN k % 6 + 1 END AS col_9_family_count,
               CASE WHEN k % 17 = 0 THEN 999 END AS col_9_household_no,
               CASE WHEN k % 5 = 1 THEN 'Head ' || k END AS col_10_head_name,
               CASE WHEN k % 5 = 2 THEN 'Kin ' || k END AS head_of_household,
               CASE WHEN k % 5 = 3 THEN '' END AS col_11_head_name,
               CASE WHEN k % 4 = 1 THEN k % 7 END AS col_18_water_source,
               CASE WHEN k % 4 = 2 THEN k % 2 = 0 END AS col_19_electricity,
               CASE WHEN k % 6 = 1 THEN k % 2 = 1 END AS asset_bicycle,
               CASE WHEN k % 6 <= 2 THEN k % 4 = 0 END AS asset_scooter_motorcycle,
               CASE WHEN k % 3 = 2 THEN k % 4 + 1 END AS col_20_latrine,
               CASE WHEN k % 2 = 1 THEN k % 7 + 1 END AS col_24_kitchen
        FROM (SELECT o_orderkey AS k FROM orders)""",
    "blocks": """
        SELECT hlb_id, block_id, south, west, south + 0.005 AS north, west + 0.005 AS east, block_id AS pos FROM (
          SELECT hlb_id, block_id, CAST(26.0 AS DOUBLE) + (block_id // 2) * CAST(0.005 AS DOUBLE) AS south,
                 CAST(80.0 AS DOUBLE) + (block_id % 2) * CAST(0.005 AS DOUBLE) AS west
          FROM (SELECT DISTINCT o_orderkey // 1000 AS hlb_id FROM orders),
               (SELECT unnest([0::BIGINT, 1, 2, 3]) AS block_id))""",
    # one row per block vertex, in order; blocks without a ring give their box corners
    "block_rings": """
        SELECT hlb_id, block_id, pos, i, CASE i WHEN 0 THEN north WHEN 1 THEN north
                 WHEN 2 THEN (CASE WHEN block_id % 2 = 0 THEN south - 0.0003 ELSE south END) ELSE south END AS lat,
               CASE i WHEN 0 THEN west WHEN 1 THEN (CASE WHEN block_id % 2 = 0 THEN east + 0.0004 ELSE east END)
                 WHEN 2 THEN east ELSE west END AS lng
        FROM blocks, (SELECT unnest([0, 1, 2, 3]) AS i)""",
    "boundary_points": """
        SELECT hlb_id, i, lat, lng FROM (SELECT DISTINCT o_orderkey // 1000 AS hlb_id FROM orders),
          (VALUES (0, 26.0005::DOUBLE, 80.0005::DOUBLE), (1, 26.0095, 80.001), (2, 26.0085, 80.0095),
                  (3, 26.004, 80.008), (4, 26.001, 80.009)) t(i, lat, lng)""",
    "road_points": """
        SELECT hlb_id, hlb_id * 10 + j AS road_id, j AS pos, i,
               CAST(26.0 AS DOUBLE) + (j + 1) * CAST(0.0016 AS DOUBLE) + (CASE WHEN i = 1 THEN 0.0002 ELSE 0 END)::DOUBLE AS lat,
               CAST(80.0 AS DOUBLE) + (CASE i WHEN 0 THEN 0 WHEN 1 THEN 0.005 ELSE 0.01 END)::DOUBLE AS lng,
               ['primary', 'residential', 'track', 'footway', 'steps'][j + 1] AS highway
        FROM (SELECT DISTINCT o_orderkey // 1000 AS hlb_id FROM orders),
             (SELECT unnest([0::BIGINT, 1, 2, 3, 4]) AS j), (SELECT unnest([0, 1, 2]) AS i)""",
    "buildings": f"""
        SELECT k // 1000 AS hlb_id, k AS id, source, lat0 + (k % 5) * 1e-5 AS lat, lng0 + (k % 3) * 1e-5 AS lng,
               confidence, CAST(k % 40 AS DOUBLE) AS area_sqm
        FROM (SELECT *, {LAT.format(k='k % 1000')} AS lat0, {LNG.format(k='k % 1000')} AS lng0 FROM (
          SELECT c_custkey AS k, 'osm' AS source, CAST(NULL AS DOUBLE) AS confidence FROM customer
          UNION ALL SELECT p_partkey, 'google', p_size / 50.0 FROM part
          UNION ALL SELECT o_orderkey, 'microsoft', NULL FROM orders))""",
    "gps_points": """
        SELECT session_id, point_id, ts, 26.001 + drift + ((point_id * 31) % 7 - 3) * 2e-6 * (session_id % 3) AS lat,
               80.001 + drift * 0.5 + ((point_id * 17) % 11 - 5) * 2e-6 * (session_id % 3) AS lng,
               CAST(point_id % 60 AS DOUBLE) AS accuracy, speed FROM (
          SELECT user_id AS session_id, event_id AS point_id, ts, value / 60.0 AS speed,
                 CASE WHEN user_id % 3 = 0 THEN 0.0::DOUBLE
                      ELSE CAST(floor(epoch(ts)) - 1704067200 AS BIGINT) * 1e-8 END AS drift FROM events)""",
    "osm_elements": f"""
        SELECT k // 1000 AS hlb_id, k AS id, k AS pos, CASE WHEN k % 3 = 0 THEN 'node' ELSE 'way' END AS type,
               lat, lng, 1e-4 + (k % 3) * 1e-5 AS d, br, p_size,
               CASE br WHEN 0 THEN 'yes' WHEN 1 THEN 'hut' WHEN 2 THEN 'school' WHEN 3 THEN 'retail' END AS building,
               CASE br WHEN 4 THEN 'place_of_worship' WHEN 5 THEN 'clinic' WHEN 13 THEN 'water_well' END AS amenity,
               CASE WHEN br IN (6, 7) THEN 'farmland' WHEN br = 8 THEN 'forest' WHEN br = 19 THEN 'reservoir' END AS landuse,
               CASE WHEN br IN (9, 10) THEN 'water' WHEN br = 18 THEN 'scrub' END AS nat,
               CASE br WHEN 11 THEN 'canal' WHEN 12 THEN 'ditch' END AS waterway,
               CASE br WHEN 3 THEN 'yes' WHEN 16 THEN 'bakery' END AS shop,
               CASE br WHEN 14 THEN 'park' END AS leisure, CASE br WHEN 15 THEN 'museum' END AS tourism,
               CASE br WHEN 17 THEN 'track' END AS highway,
               CASE WHEN br IN (2, 4, 5, 7, 10, 12, 16, 17) THEN 'Site ' || p_name END AS name
        FROM (SELECT p_partkey AS k, p_partkey % 20 AS br, p_size, p_name,
                     {LAT.format(k='p_partkey % 1000')} AS lat, {LNG.format(k='p_partkey % 1000')} AS lng FROM part)""",
    "sms_texts": """
        SELECT doc_id AS id, text || CASE doc_id % 5
            WHEN 0 THEN code || ' https://maps.example.org/?q=' || lat || ',' || lng
            WHEN 1 THEN code || ' https://maps.example.org/@' || lat || ',' || lng
            WHEN 2 THEN ' at ' || lat || ', ' || lng WHEN 3 THEN code ELSE '' END AS text
        FROM (SELECT *, '26.' || lpad(CAST(doc_id % 1000 AS VARCHAR), 4, '0') AS lat,
                     '80.' || lpad(CAST(doc_id * 7 % 1000 AS VARCHAR), 4, '0') AS lng,
                     ' HLB ' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') AS code FROM documents)""",
}
for _kind, _keep in {"all": "true", "click": "event_type = 'click'", "other": "event_type <> 'click'"}.items():
    SQL[f"image_generations_{_kind}"] = f"""
        SELECT event_id AS id, user_id AS project_id, user_id, ts AS created_at FROM events
        WHERE {_keep}"""


def with_tables(*names: str, query: str) -> str:
    """A SQL check over the named relations."""
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names) + "\n" + query
