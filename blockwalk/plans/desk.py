"""Registered queries of single desks: detail views, searches, imports, corrections and stores, with their SQL checks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from blockwalk.functions import domain, geo
from blockwalk.operators import accounts, conflate, register
from blockwalk.operators.lineage import checkpoint_dir
from blockwalk.plans import bindings as b
from blockwalk.plans.bindings import with_tables
from blockwalk.sources import osm, tables


def user_detail(s, d):
    """The parts of one user's detail view as one list, in the order shown."""
    parts = accounts.user_detail(b.user_profiles(s, d), b.projects(s, d), b.live_exports(s, d), 7)
    row = lambda kind, key: (F.lit(kind).alias("kind"), F.col(key).cast("bigint").alias("id"))
    return parts["profile"].select(*row("profile", "id")).unionByName(parts["projects"].select(*row("project", "id"))) \
        .unionByName(parts["sessions"].select(*row("session", "session_id")))


def session_payment(s, d):
    sessions = b.gps_points(s, d).groupBy("session_id").agg(F.count(F.lit(1)).alias("fixes"))
    return accounts.session_payment(sessions, b.live_exports(s, d))


def active_announcements(s, d):
    k = F.col("o_orderkey")
    rows = b.table(s, d, "orders").select(k.alias("id"), (k % 3 != 0).alias("is_active"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    return accounts.active_announcements(rows).select("id")


def _feedback(s, d):
    k = F.col("o_orderkey")
    return b.table(s, d, "orders").select(
        k.alias("id"), F.col("o_custkey").alias("user_id"), F.when(k % 3 != 0, F.concat(F.lit("Road "), (k % 90).cast("string"))).alias("suggestions"),
        F.when(k % 2 == 0, F.lit("Yes")).otherwise("No").alias("useful"))


def feedback_search(s, d):
    return accounts.search_feedback(_feedback(s, d), b.user_profiles(s, d), "ROAD 17").select("id", "user_id", "owner_name")


def project_page_total(s, d):
    return accounts.page_with_total(b.projects(s, d), [F.desc("created_at"), F.col("id")], 3, 25).select("id", "total")


def road_render(s, d):
    return b.roads(s, d).select("hlb_id", "road_id", domain.render_class(F.col("highway")).alias("render"),
                                domain.classify_road(F.col("highway"))["label"].alias("label"))


def place_symbols(s, d):
    k = F.col("p_partkey")
    kinds = ["school", "hospital", "hindu_temple", "mosque", "church", "post_office", "police", "park"]
    types = F.array_compact(F.array(*[F.when(k % (i + 2) == 0, t) for i, t in enumerate(kinds)]))
    return b.table(s, d, "part").select(k.alias("id"), domain.place_symbol(types).alias("symbol_type"))


def address_parts(s, d):
    k = F.col("c_custkey")
    address = F.map_from_entries(F.array_compact(F.array(
        F.when(k % 2 == 0, F.struct(F.lit("county"), F.concat(F.lit("County "), k.cast("string")))),
        F.when(k % 3 == 0, F.struct(F.lit("town"), F.lit("Town"))), F.when(k % 5 != 0, F.struct(F.lit("state"), F.lit("State"))))))
    return b.table(s, d, "customer").select(k.alias("id"), domain.district_of(address).alias("district"), domain.state_of(address).alias("state"))


def road_dedupe(s, d):
    """Roads mapped twice: by source id, and by the first vertex's latitude as older maps did."""
    twice = b.roads(s, d).unionByName(b.roads(s, d).withColumns({"pos": F.col("pos") + 5, "name": F.lit("again")}))
    strict = osm.distinct_roads(twice).select("hlb_id", "road_id", "name", F.lit(True).alias("strict"))
    return strict.unionByName(osm.distinct_roads(twice, strict=False).select("hlb_id", "road_id", "name", F.lit(False).alias("strict")))


def line_samples(s, d):
    k = F.col("o_orderkey")
    line = F.transform(F.sequence(F.lit(0), (k % 200).cast("int")), lambda i: geo.point(F.lit(26.0) + i * 1e-5, F.lit(80.0)))
    return b.table(s, d, "orders").select(k.alias("id"), F.size(geo.sample_line(line)).cast("bigint").alias("vertices"))


def merged_sources(s, d):
    one = lambda name: b.buildings(s, d).filter(F.col("source") == name)
    merged = conflate.merge_sources(one("google"), one("osm").drop("confidence"), one("microsoft"), one("none"))
    return merged.groupBy("hlb_id", "source").agg(F.count(F.lit(1)).alias("buildings"), F.count("confidence").alias("rated"))


def number_corrections(s, d):
    """Numbers after clearing all and undoing the last, and sub-numbers after taking some away."""
    rows = b.symbols(s, d)
    history = rows.select("hlb_id", "id", (F.col("id") * 7919 % 100003).alias("step"))
    undone = register.undo_last(rows, history).select("hlb_id", "id", F.col("number").cast("bigint").alias("number"))
    none = register.clear_numbers(rows).select("hlb_id", "id", F.col("number").cast("bigint").alias("cleared"))
    fewer = register.clear_sub_number(rows, rows.filter("number % 3 = 0")).select("hlb_id", "id", "sub_number")
    return undone.join(none, ["hlb_id", "id"]).join(fewer, ["hlb_id", "id"])


def cascade_delete(s, d):
    return tables.without_keys(b.gps_points(s, d), b.live_exports(s, d).filter("regen_used = 0"), ["session_id"]).select("session_id", "point_id")


def _layers(s, d):
    new = b.table(s, d, "part").select((F.col("p_partkey") % 7).alias("hlb_id"), F.col("p_partkey").alias("id"), F.lit("new").alias("origin"))
    old = b.symbols(s, d).select("hlb_id", "id", F.lit("old").alias("origin"))
    return old, new


def layer_import(s, d):
    """Rows per area after an import that appends and one that replaces."""
    out = []
    for replace in (False, True):
        out.append(tables.layers(*_layers(s, d), ["hlb_id"], replace).groupBy("hlb_id", "origin").agg(F.count(F.lit(1)).alias("n"))
                   .withColumn("replaced", F.lit(replace)))
    return out[0].unionByName(out[1])


def stored_sessions(s, d):
    """One session, read back from the store that two appends of different size have filled."""
    path = f"{checkpoint_dir(s).rstrip('/')}/sessions-{uuid.uuid4().hex}"
    points = b.gps_points(s, d)
    tables.write_sessions(points.filter("point_id % 2 = 0"), path, bucket_rows=500)
    tables.write_sessions(points.filter("point_id % 2 = 1"), path)
    return tables.read_session(s, path, 5).select("session_id", "point_id")


QUERIES = {f.__name__: f for f in (
    user_detail, session_payment, active_announcements, feedback_search, project_page_total, road_render, place_symbols, address_parts, road_dedupe,
    line_samples, merged_sources, number_corrections, cascade_delete, layer_import, stored_sessions)}

_ROAD_LABEL = """CASE highway WHEN 'primary' THEN 'Main Road' WHEN 'residential' THEN 'Lane' WHEN 'track' THEN 'Kachcha Raasta'
    WHEN 'footway' THEN 'Footpath' ELSE 'Steps' END"""
CHECKS = {
    "user_detail": with_tables("user_profiles", "projects", "live_exports", query="""
        SELECT 'profile' AS kind, id FROM user_profiles WHERE id = 7 UNION ALL SELECT 'project', id FROM projects WHERE user_id = 7
        UNION ALL SELECT 'session', session_id FROM live_exports WHERE user_id = 7"""),
    "session_payment": with_tables("gps_points", "live_exports", query="""
        SELECT g.session_id, fixes, payment_status FROM (SELECT session_id, count(*) AS fixes FROM gps_points GROUP BY 1) g
        LEFT JOIN live_exports l ON l.session_id = g.session_id"""),
    "active_announcements": "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 <> 0",
    "feedback_search": with_tables("user_profiles", query="""
        SELECT o_orderkey AS id, o_custkey AS user_id, full_name AS owner_name FROM orders LEFT JOIN user_profiles u ON u.id = o_custkey
        WHERE o_orderkey % 3 <> 0 AND contains('road ' || o_orderkey % 90, 'road 17') OR contains(lower(full_name), 'road 17')"""),
    "project_page_total": with_tables("projects", query="""
        SELECT id, (SELECT count(*) FROM projects) AS total FROM projects ORDER BY created_at DESC, id LIMIT 25 OFFSET 50"""),
    "road_render": with_tables("road_points", query=f"""
        SELECT DISTINCT hlb_id, road_id, CASE highway WHEN 'primary' THEN 'pk' WHEN 'residential' THEN 'rs' ELSE 'kt' END AS render,
               {_ROAD_LABEL} AS label FROM road_points"""),
    "place_symbols": """
        SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'school' WHEN p_partkey % 3 = 0 THEN 'hospital' WHEN p_partkey % 4 = 0 THEN 'temple'
          WHEN p_partkey % 5 = 0 THEN 'mosque' WHEN p_partkey % 6 = 0 THEN 'church' WHEN p_partkey % 7 = 0 THEN 'post_office'
          WHEN p_partkey % 8 = 0 THEN 'police_station' ELSE 'point_of_interest' END AS symbol_type FROM part""",
    "address_parts": """
        SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'County ' || c_custkey WHEN c_custkey % 3 = 0 THEN 'Town' ELSE '' END AS district,
               CASE WHEN c_custkey % 5 <> 0 THEN 'State' ELSE '' END AS state FROM customer""",
    "road_dedupe": with_tables("road_points", query="""
        , r AS (SELECT DISTINCT hlb_id, road_id, 'Road ' || pos AS name FROM road_points)
        SELECT *, true AS strict FROM r UNION ALL SELECT *, false FROM r"""),
    "line_samples": """
        SELECT id, count(*) AS vertices FROM (SELECT o_orderkey AS id, o_orderkey % 200 + 1 AS n, unnest(generate_series(0, o_orderkey % 200)) AS i FROM orders)
        WHERE i % CAST(ceil(n / 60.0) AS BIGINT) = 0 OR i = n - 1 GROUP BY 1""",
    "merged_sources": with_tables("buildings", query="""
        SELECT hlb_id, source, count(*) AS buildings, count(confidence) AS rated FROM buildings GROUP BY 1, 2"""),
    "number_corrections": with_tables("symbols", query="""
        , h AS (SELECT hlb_id, arg_max(id, id * 7919 % 100003) AS last FROM symbols GROUP BY 1)
        SELECT hlb_id, id, CASE WHEN id <> last THEN number END AS number, NULL::BIGINT AS cleared,
               CASE WHEN number IS NULL OR number % 3 <> 0 THEN sub_number END AS sub_number FROM symbols JOIN h USING (hlb_id)"""),
    "cascade_delete": with_tables("gps_points", query="""
        SELECT session_id, point_id FROM gps_points WHERE session_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0)"""),
    "layer_import": with_tables("symbols", query="""
        , n AS (SELECT p_partkey % 7 AS hlb_id, count(*) AS n FROM part GROUP BY 1), o AS (SELECT hlb_id, count(*) AS n FROM symbols GROUP BY 1)
        SELECT hlb_id, 'old' AS origin, n, false AS replaced FROM o UNION ALL SELECT hlb_id, 'new', n, false FROM n
        UNION ALL SELECT hlb_id, 'old', n, true FROM o WHERE hlb_id NOT IN (SELECT hlb_id FROM n) UNION ALL SELECT hlb_id, 'new', n, true FROM n"""),
    "stored_sessions": with_tables("gps_points", query="SELECT session_id, point_id FROM gps_points WHERE session_id = 5"),
}
