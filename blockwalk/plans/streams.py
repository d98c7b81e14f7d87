"""Registered streaming queries: the given tables are drained as streams, results compared with batch SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from blockwalk.operators.lineage import checkpoint_dir
from blockwalk.plans import bindings as b
from blockwalk.plans import sqltext as t
from blockwalk.plans.analytics import CHECKS as ANALYTICS
from blockwalk.plans.bindings import with_tables
from blockwalk.plans.spatial import _SROADS, _frac, survey_roads
from blockwalk.plans.tracks import _KALMAN, _SNAP, _marks, _motion, _segments, _thinned
from blockwalk.sources.changelog import KeyedLog
from blockwalk.streaming import changes, events, live, recorder, sinks


def _folder(spark) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/streams/{uuid.uuid4()}"


def _stream(spark, sf_dir, name):
    schema = b.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}*.parquet")


def _fixes(s, d):
    """The track binding over the event stream."""
    e = F.col("event_id")
    t = F.unix_seconds(F.col("ts").cast("timestamp")) - F.lit(1704067200)
    drift = F.when(F.col("user_id") % 3 == 0, F.lit(0.0)).otherwise(t * 1e-8)
    return _stream(s, d, "events").select(
        F.col("user_id").alias("session_id"), e.alias("point_id"), F.col("ts").cast("timestamp").alias("ts"),
        (F.lit(26.001) + drift + ((e * 31) % 7 - 3) * 2e-6 * (F.col("user_id") % 3)).alias("lat"),
        (F.lit(80.001) + drift * 0.5 + ((e * 17) % 11 - 5) * 2e-6 * (F.col("user_id") % 3)).alias("lng"),
        (e % 60).cast("double").alias("accuracy"), (F.col("value") / 60.0).alias("speed"))


def stream_events(s, d):
    k = F.col("event_id")
    posted = _stream(s, d, "events").select(
        F.when(k % 4 == 0, " ").otherwise(k.cast("string")).alias("fingerprintId"),
        F.when(k % 10 == 9, "").otherwise(F.col("event_type")).alias("eventType"), F.lit("/map").alias("pagePath"),
        F.when(k % 3 != 0, F.col("user_id").cast("string")).alias("userId"), F.col("props").alias("metadata"),
        F.concat(F.lit("203.0."), (k % 250).cast("string"), F.lit(".7, 10.0.0.1")).alias("forwarded"),
        F.col("ts").cast("timestamp").alias("ts"))
    return sinks.drain(events.user_event_rows(posted), _folder(s)).drop("batch", "created_at")


def stream_timeline(s, d):
    rows = _stream(s, d, "events").select(F.col("ts").cast("timestamp").alias("created_at"), "event_type")
    return sinks.latest(sinks.drain(events.daily_counts(rows), _folder(s), "update"), ["day", "event_type"])


def stream_recorder(s, d):
    return sinks.drain(recorder.record(_fixes(s, d)), _folder(s)).select("session_id", "point_id", "path_index")


def stream_snap(s, d):
    """Recorded points matched to roads in the same micro-batch."""
    folder, roads = _folder(s), survey_roads(s, d)

    def each(batch, batch_id):
        recorder.snap_batch(batch, roads).write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")

    sinks.start(recorder.record(_fixes(s, d)), f"{folder}/checkpoint", each).awaitTermination()
    rows = s.read.option("basePath", f"{folder}/rows").parquet(f"{folder}/rows/batch=*")
    return rows.select("session_id", "point_id", "road_id", F.round("out_lat", 7).alias("out_lat"), F.round("out_lng", 7).alias("out_lng"))


def stream_daily(s, d):
    """Sign-ups, projects and paise per local day; every event saves its user's profile again."""
    folder, e = _folder(s), _stream(s, d, "events")
    saves = e.select(F.col("user_id").alias("id")).join(b.user_profiles(s, d).select("id", "created_at"), "id")
    signups = sinks.relay(events.first_seen(saves), f"{folder}/signups")
    projects = _stream(s, d, "orders").select(F.col("o_orderdate").cast("timestamp").alias("created_at"))
    payments = e.filter("event_type = 'purchase'").select(F.col("ts").cast("timestamp").alias("created_at"), F.round(F.col("value") * 100).cast("long").alias("amount_paise"))
    slots = sinks.drain(events.live_timeline(signups, projects, payments), folder, "update")
    return events.timeline_days(sinks.latest(slots, ["slot"]))


LIVE_IDLE = "2 days"


def _walks(s, d):
    """Survey sessions over the event stream: every user walks a lane up and down, five days each way; a fix far ahead ends all sessions."""
    k = F.col("event_id")
    phase = (F.unix_seconds(F.col("ts").cast("timestamp")) - 1704067200) % 864000 / F.lit(432000.0)
    x = F.when(phase < 1, phase).otherwise(2 - phase)
    lane = F.struct(F.col("user_id").alias("session_id"), k.alias("point_id"), F.col("ts").cast("timestamp").alias("ts"), (F.lit(26.001) + x * 0.0008).alias("lat"),
                    (F.lit(80.0012) + x * 0.00001).alias("lng"), F.when(k % 11 == 0, 55.0).otherwise(0.0).alias("accuracy"), (F.col("value") / 60.0).alias("speed"),
                    F.when(F.floor(k / 900) % 2 == 0, "residential").otherwise("track").alias("road_type"), (k % 37 == 0).alias("paused"))
    ahead = F.when(k == 0, lane.withField("session_id", F.lit(-1).cast("long")).withField("ts", F.lit("2024-04-01").cast("timestamp"))
                   .withField("accuracy", F.lit(5.0)).withField("speed", F.lit(1.0)))
    return _stream(s, d, "events").select(F.explode(F.array_compact(F.array(lane, ahead))).alias("f")).select("f.*")


def _surveyed(s, d, folder, roads):
    moving = sinks.relay(live.motion(_walks(s, d), idle=LIVE_IDLE), f"{folder}/motion")
    return live.survey(moving, live.road_cells(roads), idle=LIVE_IDLE)


def stream_live(s, d):
    """Path points of live sessions with road, segment and the moment of walking back."""
    folder = _folder(s)
    rows = sinks.drain(_surveyed(s, d, folder, survey_roads(s, d)), folder).filter("kind = 'point' AND session_id >= 0")
    return rows.select("session_id", F.unix_micros("started_at").alias("started_us"), "point_id", "path_index", "on_road", "road_id", "segment", "returned",
                       F.round("out_lat", 7).alias("out_lat"), F.round("out_lng", 7).alias("out_lng"))


def stream_finish(s, d):
    """Summaries and house numbers, written once when a timer ends the session."""
    folder = _folder(s)
    marks = _marks(s, d).withColumns({"pos": F.col("id"), "number_locked": F.lit(False), "number": F.lit(None).cast("long")})

    def each(batch, batch_id):
        live.finished(batch, marks).write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")

    sinks.start(_surveyed(s, d, folder, survey_roads(s, d)), f"{folder}/checkpoint", each).awaitTermination()
    rows = s.read.option("basePath", f"{folder}/rows").parquet(f"{folder}/rows/batch=*")
    numbers = F.array_join(F.transform("numbers", lambda n: F.concat_ws(":", n["number"], n["id"])), ",")
    return rows.select("session_id", F.unix_micros("started_at").alias("started_us"), F.unix_micros("ended_at").alias("ended_us"), F.round("distance_m", 4).alias("distance_m"),
                       "duration_s", "house_count", "road_count", "gps_point_count", "returned", numbers.alias("numbers"))


def stream_match(s, d):
    """Path points by their windows of matches; the path itself is recorded without roads."""
    folder = _folder(s)
    points = sinks.relay(_surveyed(s, d, folder, survey_roads(s, d).limit(0)).filter("kind = 'point'"), f"{folder}/points")
    rows = sinks.drain(live.matched(points, live.road_cells(survey_roads(s, d)), idle=LIVE_IDLE), folder).filter("session_id >= 0")
    return rows.select("session_id", F.unix_micros("started_at").alias("started_us"), "point_id", "window_no", F.round("confidence", 6).alias("confidence"), "road_id",
                       F.round("out_lat", 7).alias("out_lat"), F.round("out_lng", 7).alias("out_lng"))


def _order_id(k):
    return F.concat(F.when(k % 4 == 0, "don_").when(k % 4 == 1, "ord_").when(k % 4 == 2, "live_").otherwise("lrg_"), k.cast("string"))


def _callbacks(s, d):
    k = F.col("o_orderkey")
    kind = F.when(k % 3 == 0, changes.SUCCESS).when(k % 3 == 1, changes.FAILED).otherwise(changes.DROPPED[0])
    rows = _stream(s, d, "orders").select(_order_id(k).alias("order_id"), kind.alias("type"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    return rows.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_copy")  # every callback arrives twice


def stream_payments(s, d):
    """Donations, live sessions and maps settled from doubled callbacks, all three tables whole."""
    folder, k = _folder(s), F.col("id")
    order = _order_id(k)
    rows = b.projects(s, d).select("id", order.alias("payment_id"), order.alias("order_id"), F.lit("created").alias("payment_status"),
                                   F.lit(5).alias("regen_allowance"))
    start = {"donations": rows.filter(k % 4 == 0).drop("regen_allowance").withColumn("is_paid", F.lit(None).cast("boolean")),
             "live_exports": rows.filter(k % 4 >= 2).withColumn("regen_allowance", F.lit(1)).withColumnRenamed("id", "session_id"),
             "projects": rows.filter(k % 4 == 1)}
    tables = {n: KeyedLog(s, f"{folder}/{n}", ["order_id"]).create(df) for n, df in start.items()}
    changes.settle_stream(_callbacks(s, d), tables, f"{folder}/checkpoint").awaitTermination()
    tables["projects"].compact(0)  # the drained input is one batch; a compacted table reads the same
    out = None
    for name, t in tables.items():
        part = t.read().withColumnRenamed("session_id", "id")
        part = part if "is_paid" in part.columns else part.withColumn("is_paid", F.lit(None).cast("boolean"))
        part = part if "regen_allowance" in part.columns else part.withColumn("regen_allowance", F.lit(None).cast("int"))
        part = part.select(F.lit(name).alias("relation"), "id", "payment_id", "payment_status", "is_paid", "regen_allowance")
        out = part if out is None else out.unionByName(part)
    return out


def stream_announcements(s, d):
    v = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)).cast("array<bigint>"))
    k = F.col("o_orderkey")
    rows = _stream(s, d, "orders").select(
        k.alias("id"), F.when(k % 7 != 0, F.concat(F.lit("Donor "), F.col("o_custkey").cast("string"))).alias("name"),
        F.col("o_totalprice").cast("double").alias("amount"), F.when(k % 4 == 0, " ").otherwise(F.col("o_orderpriority")).alias("note"), F.when(k % 11 != 0, F.col("o_orderstatus") == "F").alias("_paid"), v.alias("version"))
    paid = F.when(F.col("version") == 0, F.when(F.col("id") % 3 == 0, False)).when(F.col("version") == 1, F.col("_paid")) \
        .otherwise(F.col("_paid") | (F.col("id") % 5 == 0))
    folder = _folder(s)
    log = KeyedLog(s, f"{folder}/paid", ["id"]).create(b.table(s, d, "orders").select(k.alias("id"), F.lit(None).cast("boolean").alias("is_paid")))
    changes.announce_stream(rows.withColumn("is_paid", paid).drop("_paid"), log, f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    return s.read.option("basePath", f"{folder}/rows").parquet(f"{folder}/rows/batch=*").drop("batch")


def stream_documents(s, d):
    """Last save per project; each order saves the document of its customer."""
    folder = _folder(s)
    saves = _stream(s, d, "orders").select(
        F.col("o_custkey").alias("id"), F.concat(F.lit("doc "), F.col("o_orderkey").cast("string")).alias("data"),
        F.struct(F.col("o_orderdate").cast("timestamp").alias("t"), F.col("o_orderkey").alias("k")).alias("updated_at"))
    stored = b.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("empty").alias("data"),
                                              F.lit(None).cast("struct<t:timestamp,k:bigint>").alias("updated_at"))
    table = KeyedLog(s, f"{folder}/projects", ["id"]).create(stored)
    changes.save_documents(saves, table, f"{folder}/checkpoint", interval=None).awaitTermination()
    return table.read().select("id", "data")


QUERIES = {f.__name__: f for f in (stream_events, stream_timeline, stream_daily, stream_recorder, stream_snap, stream_live, stream_finish, stream_match,
                                   stream_payments, stream_announcements, stream_documents)}

_REC = f"""{_KALMAN}, sm AS (SELECT g.session_id, g.point_id, g.ts, s.k.lat AS lat, s.k.lng AS lng, g.accuracy, g.speed
    FROM gps_points g JOIN smoothed s ON s.k.id = g.point_id), {_motion('sm', 'mo')},
  src AS (SELECT *, lat AS oy, lng AS ox FROM mo WHERE NOT stationary AND accuracy <= 50 AND movement IN ('walking', 'fast_walk')),
  kept AS ({_thinned('src', 0.8)})"""
#: Sessions of the walks by their silences: id is user * 1000 + its number, gps_points as everywhere else.
_SPLIT = """WITH raw AS (SELECT user_id, event_id AS point_id, ts, value / 60.0 AS speed, 26.001 + x * 0.0008::DOUBLE AS lat, 80.0012 + x * 0.00001::DOUBLE AS lng,
    CASE WHEN event_id % 11 = 0 THEN 55.0::DOUBLE ELSE 0 END AS accuracy FROM (SELECT *, CASE WHEN ph < 1 THEN ph ELSE 2 - ph END AS x FROM (
      SELECT *, CAST((floor(epoch(ts)) - 1704067200) AS BIGINT) % 864000 / 432000.0::DOUBLE AS ph FROM events))),
  lagged AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, point_id) AS prev FROM raw),
  cuts AS (SELECT *, sum(CASE WHEN prev IS NULL OR epoch_us(ts) - epoch_us(prev) > 172800 * 1000000::BIGINT THEN 1 ELSE 0 END)
                     OVER (PARTITION BY user_id ORDER BY ts, point_id ROWS UNBOUNDED PRECEDING) AS epoch FROM lagged),
  gps_points AS (SELECT CAST(user_id * 1000 + epoch AS BIGINT) AS session_id, point_id, ts, lat, lng, accuracy, speed FROM cuts),
  begun AS (SELECT session_id, session_id // 1000 AS user_id, epoch_us(min(ts)) AS started_us, epoch_us(max(ts)) AS ended_us FROM gps_points GROUP BY 1)"""
_PATH = f"""{_KALMAN}, sm AS (SELECT g.session_id, g.point_id, g.ts, s.k.lat AS lat, s.k.lng AS lng, g.accuracy, g.speed,
      sum(CASE WHEN g.point_id % 37 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY g.session_id ORDER BY g.ts, g.point_id ROWS UNBOUNDED PRECEDING) AS pauses
    FROM gps_points g JOIN smoothed s ON s.k.id = g.point_id), {_motion('sm', 'mo')},
  rec AS (SELECT * FROM mo WHERE NOT stationary AND accuracy <= 50 AND movement IN ('walking', 'fast_walk'))"""
_LIVE = f"""{_SPLIT}, {_PATH}, {_SNAP.format(src='rec')},
  src AS (SELECT r.*, n.road_id, coalesce(n.sy, r.lat) AS oy, coalesce(n.sx, r.lng) AS ox FROM rec r LEFT JOIN snap n ON n.point_id = r.point_id),
  kept AS ({_thinned('src', 0.8)}),
  path AS (SELECT src.session_id, src.point_id, ts, oy AS lat, ox AS lng, bearing, road_id, road_id IS NOT NULL AS on_road,
      CASE WHEN (src.point_id // 900) % 2 = 0 THEN 'residential' ELSE 'track' END AS road_type,
      pauses <> coalesce(lag(pauses) OVER (PARTITION BY src.session_id ORDER BY ts, src.point_id), 0) AS paused,
      row_number() OVER (PARTITION BY src.session_id ORDER BY ts, src.point_id) AS path_index FROM kept k2 JOIN src ON src.point_id = k2.k.id),
  {_segments('path')},
  lgs AS (SELECT *, max(ts) OVER (PARTITION BY session_id, segment) AS fin, lead(lat) OVER w AS nla, lead(lng) OVER w AS nln
      FROM segs WINDOW w AS (PARTITION BY session_id, segment ORDER BY ts, point_id, part)),
  wy AS (SELECT session_id, lat, lng, fin, {t.bearing('lat', 'lng', 'nla', 'nln')} AS way FROM lgs WHERE nla IS NOT NULL),
  backs AS (SELECT l.session_id, min(path_index) AS path_index FROM path l JOIN wy ON wy.session_id = l.session_id AND wy.fin < l.ts AND l.path_index > 30
      AND {t.hav('l.lat', 'l.lng', 'wy.lat', 'wy.lng')} < 5
      AND (CASE WHEN abs(l.bearing - way) > 180 THEN 360 - abs(l.bearing - way) ELSE abs(l.bearing - way) END) > 150 GROUP BY 1)"""
CHECKS = {
    "stream_live": f"""{_LIVE}
        SELECT user_id AS session_id, started_us, p.point_id, p.path_index, p.on_road, p.road_id,
               CASE WHEN NOT p.on_road THEN CAST(segment AS BIGINT) END AS segment, coalesce(p.path_index = b.path_index, false) AS returned,
               round(p.lat, 7) AS out_lat, round(p.lng, 7) AS out_lng
        FROM path p JOIN sgm USING (point_id) JOIN begun g ON g.session_id = p.session_id LEFT JOIN backs b ON b.session_id = p.session_id""",
    "stream_finish": f"""{_LIVE},
        hops AS (SELECT *, lag(lat) OVER w AS pla, lag(lng) OVER w AS pln FROM path WINDOW w AS (PARTITION BY session_id ORDER BY path_index)),
        len AS (SELECT session_id, sum(CASE WHEN pla IS NULL THEN 0 ELSE {t.hav('pla', 'pln', 'lat', 'lng')} END) AS m, count(*) AS n,
                       CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS secs FROM hops GROUP BY 1),
        sc AS (SELECT session_id, count(DISTINCT segment) AS n FROM segs GROUP BY 1),
        houses AS (SELECT user_id, event_id AS id, event_id % 3 < 2 AS counted, {b.LAT.format(k='event_id % 1000')} AS lat, {b.LNG.format(k='event_id % 1000')} AS lng FROM events),
        rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY floor((north - lat) / 0.00009::DOUBLE), lng, id) AS number
               FROM (SELECT *, max(lat) OVER (PARTITION BY user_id) AS north FROM houses)),
        nums AS (SELECT user_id, count(*) FILTER (WHERE counted) AS house_count, string_agg(number || ':' || id, ',' ORDER BY number, id) AS numbers FROM rk GROUP BY 1)
        SELECT g.user_id AS session_id, started_us, ended_us, round(coalesce(m, 0), 4) AS distance_m, coalesce(secs, 0) AS duration_s, coalesce(house_count, 0) AS house_count,
               coalesce(sc.n, 0) AS road_count, coalesce(len.n, 0) AS gps_point_count, backs.session_id IS NOT NULL AS returned, numbers
        FROM begun g LEFT JOIN len USING (session_id) LEFT JOIN sc USING (session_id) LEFT JOIN backs USING (session_id) LEFT JOIN nums ON nums.user_id = g.user_id""",
    "stream_match": f"""{_SPLIT}, {_PATH},
        src AS (SELECT *, lat AS oy, lng AS ox FROM rec), kept AS ({_thinned('src', 0.8)}),
        pts AS (SELECT src.session_id, src.point_id, ts, lat, lng, row_number() OVER (PARTITION BY src.session_id ORDER BY ts, src.point_id) AS i,
                       count(*) OVER (PARTITION BY src.session_id) AS n FROM kept k2 JOIN src ON src.point_id = k2.k.id),
        {_SNAP.format(src='pts')},
        j AS (SELECT p.*, s.road_id, sy, sx, CASE WHEN p.i = 1 THEN 1 ELSE (p.i - 2) // 4 + 1 END AS w FROM pts p LEFT JOIN snap s ON s.point_id = p.point_id),
        sized AS (SELECT session_id, w, avg(CASE WHEN road_id IS NULL THEN 0.0::DOUBLE ELSE 1 END) AS share FROM (
            SELECT session_id, w, road_id FROM j UNION ALL SELECT session_id, w + 1, road_id FROM j WHERE i > 1 AND (i - 1) % 4 = 0) GROUP BY 1, 2 HAVING count(*) = 5)
        SELECT user_id AS session_id, started_us, point_id, CAST(w AS BIGINT) AS window_no, round(share, 6) AS confidence,
               CASE WHEN ok THEN road_id END AS road_id, round(CASE WHEN ok THEN sy ELSE lat END, 7) AS out_lat, round(CASE WHEN ok THEN sx ELSE lng END, 7) AS out_lng
        FROM (SELECT j.*, share, coalesce(share >= 0.6 AND i > 1 AND road_id IS NOT NULL, false) AS ok FROM j LEFT JOIN sized z ON z.session_id = j.session_id AND z.w = j.w)
        JOIN begun USING (session_id)""",
    "stream_daily": with_tables("user_profiles", "projects", "payment_events", query="""
        SELECT day, CAST(sum(u) AS BIGINT) AS new_users, CAST(sum(p) AS BIGINT) AS new_projects, CAST(sum(r) AS BIGINT) AS revenue_paise FROM (
          SELECT created_at, 1 AS u, 0 AS p, 0 AS r FROM user_profiles UNION ALL SELECT created_at, 0, 1, 0 FROM projects
          UNION ALL SELECT created_at, 0, 0, amount_paise FROM payment_events),
          LATERAL (SELECT strftime(created_at + INTERVAL 330 MINUTE, '%Y-%m-%d') AS day) GROUP BY 1"""),
    "stream_events": """
        SELECT CASE WHEN event_id % 3 <> 0 THEN CAST(user_id AS VARCHAR) END AS user_id,
               CASE WHEN event_id % 4 <> 0 THEN CAST(event_id AS VARCHAR) END AS fingerprint_id, event_type,
               '203.0.' || event_id % 250 || '.7' AS ip_address, '/map' AS page_path, props AS metadata FROM events WHERE event_id % 10 <> 9""",
    "stream_timeline": """
        SELECT strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d') AS day, event_type, count(*) AS events FROM events GROUP BY 1, 2""",
    "stream_recorder": with_tables("gps_points", query=f"""
        , {_REC} SELECT k2.session_id, k2.k.id AS point_id, row_number() OVER (PARTITION BY k2.session_id ORDER BY ts, point_id) AS path_index
        FROM kept k2 JOIN src ON src.point_id = k2.k.id"""),
    "stream_snap": with_tables("gps_points", query=f"""
        , {_REC}, pts AS (SELECT src.session_id, src.point_id, src.lat, src.lng FROM kept k2 JOIN src ON src.point_id = k2.k.id),
        {_SROADS}, near AS (SELECT DISTINCT p.point_id, p.lat, p.lng, v.road_id FROM pts p JOIN sv v
            ON abs(v.lat - p.lat) < 0.0002 AND abs(v.lng - p.lng) < 0.0002),
        m AS (SELECT n.*, g.ay, g.ax, g.by_, g.bx, g.i, {t.seg_dist_m('n.lat', 'n.lng', 'g.ay', 'g.ax', 'g.by_', 'g.bx')} AS dist
              FROM near n JOIN sg g USING (road_id)),
        best AS (SELECT *, {_frac('lat', 'lng', 'ay', 'ax', 'by_', 'bx')} AS f FROM m WHERE dist <= 10
                 QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY dist, road_id, i) = 1)
        SELECT session_id, p.point_id, road_id, round(coalesce(ay + f * (by_ - ay), p.lat), 7) AS out_lat,
               round(coalesce(ax + f * (bx - ax), p.lng), 7) AS out_lng FROM pts p LEFT JOIN best b ON b.point_id = p.point_id"""),
    "stream_payments": """
        SELECT CASE k % 4 WHEN 0 THEN 'donations' WHEN 1 THEN 'projects' ELSE 'live_exports' END AS relation, k AS id,
               CASE WHEN k % 4 = 3 AND ok THEN 'processed_' ELSE '' END || CASE k % 4 WHEN 0 THEN 'don_' WHEN 1 THEN 'ord_' WHEN 2 THEN 'live_' ELSE 'lrg_' END || k AS payment_id,
               CASE WHEN k % 4 = 0 THEN CASE k % 3 WHEN 0 THEN 'paid' WHEN 1 THEN 'failed' ELSE 'abandoned' END
                    WHEN k % 4 < 3 AND ok THEN 'paid' ELSE 'created' END AS payment_status,
               CASE WHEN k % 4 = 0 AND ok THEN true END AS is_paid,
               CASE k % 4 WHEN 1 THEN CASE WHEN ok THEN 10 ELSE 5 END WHEN 2 THEN CASE WHEN ok THEN 6 ELSE 1 END WHEN 3 THEN CASE WHEN ok THEN 7 ELSE 1 END END AS regen_allowance
        FROM (SELECT o_orderkey AS k, o_orderkey % 3 = 0 AS ok FROM orders)""",
    "stream_announcements": ANALYTICS["donation_transitions"].split("SELECT id, version, donor")[0]
        + "SELECT id, version, name, amount::DOUBLE AS amount, note FROM v WHERE is_paid AND old IS DISTINCT FROM true",
    "stream_documents": """
        SELECT c_custkey AS id, coalesce(d, 'empty') AS data FROM customer LEFT JOIN (
          SELECT o_custkey, 'doc ' || arg_max(o_orderkey, epoch_us(o_orderdate)::HUGEINT * 1000000000 + o_orderkey) AS d FROM orders GROUP BY 1) ON o_custkey = c_custkey""",
}
