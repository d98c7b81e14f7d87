"""Registered queries over accounts, payments and activity, with their SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockwalk.operators import accounts, dashboard
from blockwalk.plans import bindings as b
from blockwalk.plans.bindings import EVENT_AS_OF, ORDER_AS_OF, with_tables
from blockwalk.sources import tables

QUERIES = {
    "timeline": lambda s, d: dashboard.timeline(
        b.user_profiles(s, d), b.projects(s, d), b.payment_events(s, d), EVENT_AS_OF),
    "kpis": lambda s, d: dashboard.kpis(
        b.user_profiles(s, d), b.projects(s, d), b.live_exports(s, d), b.donations(s, d), b.payment_events(s, d),
        b.user_events(s, d), EVENT_AS_OF),
    "funnel": lambda s, d: dashboard.funnel(
        b.user_profiles(s, d), b.projects(s, d), b.live_exports(s, d), b.donations(s, d)),
    "revenue_breakdown": lambda s, d: dashboard.revenue_breakdown(b.payment_events(s, d)),
    "cohort_retention": lambda s, d: dashboard.cohort_retention(
        b.user_profiles(s, d), b.projects(s, d), b.user_events(s, d), EVENT_AS_OF),
    "geo_top50": lambda s, d: dashboard.geo_distribution(b.user_profiles(s, d)),
    "live_funnel": lambda s, d: dashboard.live_funnel(b.live_exports(s, d)),
    "weekly_active": lambda s, d: dashboard.weekly_active(
        b.projects(s, d), b.user_profiles(s, d), b.user_events(s, d), EVENT_AS_OF),
    "paid_users": lambda s, d: dashboard.paid_users(b.projects(s, d), b.live_exports(s, d), b.donations(s, d)),
    "month_groups": lambda s, d: dashboard.month_groups(b.projects(s, d)),
    "user_counts": lambda s, d: accounts.user_counts(
        b.user_profiles(s, d).select("id", "full_name"), b.projects(s, d), b.live_exports(s, d)),
    "owner_lookup": lambda s, d: accounts.with_owner(
        b.projects(s, d).select("id", "user_id", "name"), b.user_profiles(s, d)),
    "user_search": lambda s, d: accounts.search_users(b.user_profiles(s, d), "nation_1").select("id", "full_name", "tehsil"),
    "project_search": lambda s, d: accounts.search_projects(
        b.projects(s, d), b.user_profiles(s, d), "00012", "paid").select("id", "user_id", "name", "payment_status"),
    "donation_search": lambda s, d: accounts.search_donations(
        b.donations(s, d), b.user_profiles(s, d), "or 12", "paid").select("id", "user_id", "name", "owner_name"),
    "session_search": lambda s, d: accounts.search_sessions(
        b.live_exports(s, d), b.user_profiles(s, d), "99", "paid").select("session_id", "user_id", "owner_name"),
    "project_page": lambda s, d: accounts.with_owner(accounts.page(
        b.projects(s, d).select("id", "user_id", "updated_at"), [F.desc("updated_at"), F.col("id")], 3, 20),
        b.user_profiles(s, d)).select("id", "user_id", "owner_name"),
    "visible_projects": lambda s, d: accounts.visible_projects(
        b.projects(s, d), b.project_assignments(s, d), b.user_profiles(s, d),
        b.user_profiles(s, d).select(F.col("id").alias("user_id"))),
    "own_and_assigned": lambda s, d: accounts.own_and_assigned(b.projects(s, d), b.project_assignments(s, d)),
    "ledger_backfill": lambda s, d: accounts.ledger_backfill(
        b.payment_events(s, d), b.projects(s, d), b.live_exports(s, d), b.donations(s, d)).drop("created_at"),
    "ledger_quarantine": lambda s, d: accounts.split_ledger(b.payment_events(s, d))[1].drop("created_at"),
    "donation_totals": lambda s, d: accounts.donation_totals(b.donations(s, d)),
    "support_totals": lambda s, d: accounts.support_totals(b.donations(s, d)),
    "donation_transitions": lambda s, d: accounts.paid_transitions(_donation_versions(s, d)),
    "quota_usage": lambda s, d: accounts.quota_usage(
        b.image_generations(s, d, "other"), b.image_generations(s, d, "click"), "2024-01-15"),
    "latest_selected": lambda s, d: accounts.select_newest(b.image_generations(s, d)).drop("created_at"),
    "recent_boundaries": lambda s, d: accounts.recent_boundaries(_saved(s, d)).drop("created_at"),
    "project_status": lambda s, d: accounts.project_status(accounts.dashboard_lists(
        tables.parse_documents(_documents(s, d)))).select("id", "list", "total", "numbered", "status"),
    "document_search": lambda s, d: accounts.search_documents(
        tables.parse_documents(_documents(s, d)), "gaya").select("id", "name"),
    "document_symbols": lambda s, d: tables.explode_symbols(tables.parse_documents(_documents(s, d)))
        .select("project_id", "id", "symbol_type", "number"),
    "session_states": lambda s, d: accounts.session_state_counts(_sessions(s, d), ORDER_AS_OF),
    "event_types": lambda s, d: accounts.event_types(b.user_events(s, d)),
    "dashboard_payload": lambda s, d: dashboard.admin_payload(
        b.user_profiles(s, d), b.projects(s, d), b.live_exports(s, d), b.donations(s, d), b.payment_events(s, d), b.user_events(s, d), EVENT_AS_OF),
    "csv_export": lambda s, d: tables.csv_lines(
        b.donations(s, d).select("id", F.concat(F.lit('He said "'), F.col("note"), F.lit('", ok')).alias("remark"),
                                 "name")),
}


def _donation_versions(s, d):
    """Three versions per donation: created, settled as recorded, and a late confirmation of every fifth."""
    v = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)).cast("array<bigint>"))
    rows = b.donations(s, d).select("id", "name", "amount", "note", "is_paid", v.alias("version"))
    paid = F.when(F.col("version") == 0, F.when(F.col("id") % 3 == 0, False)) \
        .when(F.col("version") == 1, F.col("is_paid")).otherwise(F.col("is_paid") | (F.col("id") % 5 == 0))
    return rows.withColumn("is_paid", paid)


def _saved(s, d):
    return b.table(s, d, "orders").select(
        F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 40).alias("hlb_number"),
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("created_at"))


def _sessions(s, d):
    return b.live_exports(s, d).withColumn(
        "state", F.when(F.col("regen_used") == 1, "paused").when(F.col("regen_used") == 2, "completed").otherwise("recording"))


def _documents(s, d):
    """One JSON document per order with a handful of symbols; every 50th is broken."""
    k = F.col("o_orderkey")
    types = F.array(*[F.lit(t) for t in ("pucca_house", "kutcha_house", "apartment", "well", "non_residential")])
    symbol = lambda i: F.struct(
        (k * 10 + i).cast("string").alias("id"), F.get(types, (i % 5).cast("int")).alias("symbol_type"),
        F.lit(26.0).alias("lat"), F.lit(80.0).alias("lng"),
        F.when((k % 4 == 0) | (i % 2 == 0), i + 1).cast("int").alias("number"))
    doc = F.to_json(F.struct(
        F.transform(F.slice(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long")), F.lit(1), (k % 6).cast("int")), symbol)
        .alias("symbols"),
        F.when(k % 3 == 0, "canvas").alias("mode"), F.when(k % 9 == 0, True).alias("deletedUI"),
        F.concat(F.lit("H"), k.cast("string")).alias("hlbNumber"),
        F.when(k % 5 == 0, "Gaya").otherwise("Patna").alias("district"), F.lit("Bihar").alias("state")))
    return b.table(s, d, "orders").select(k.alias("id"), F.concat(F.lit("HLB "), k.cast("string")).alias("name"),
                                          F.when(k % 50 == 7, "{broken").otherwise(doc).alias("data"))


_PAYERS = """
  SELECT user_id AS uid FROM projects WHERE payment_status = 'paid'
  UNION ALL SELECT user_id FROM live_exports WHERE payment_status = 'paid'
  UNION ALL SELECT user_id FROM donations WHERE is_paid = true OR payment_status = 'paid'"""
_ACTIVE = f"""
  SELECT user_id AS uid FROM projects WHERE updated_at >= TIMESTAMP '{EVENT_AS_OF}' - INTERVAL 7 DAY
  UNION ALL SELECT id FROM user_profiles WHERE updated_at >= TIMESTAMP '{EVENT_AS_OF}' - INTERVAL 7 DAY
  UNION ALL SELECT user_id FROM user_events WHERE created_at >= TIMESTAMP '{EVENT_AS_OF}' - INTERVAL 7 DAY"""
_LOCAL = "CAST(created_at + INTERVAL 330 MINUTE AS DATE)"
_RECENT = f"created_at >= TIMESTAMP '{EVENT_AS_OF}' - INTERVAL 30 DAY"


def _share(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN round(CAST({part} AS DOUBLE) * 100 / {whole}, 1) ELSE 0.0::DOUBLE END"


def _kept(name, lo, hi, age):
    old = f"signup <= TIMESTAMP '{EVENT_AS_OF}' - INTERVAL {age} DAY"
    return _share(f"count(*) FILTER (WHERE ret_{name} AND {old})", f"count(*) FILTER (WHERE {old})") + f" AS {name}_pct"


_FUNNEL = f"""SELECT (SELECT count(*) FROM user_profiles) AS signups,
   (SELECT count(*) FROM user_profiles WHERE onboarding_completed) AS onboarding_done,
   (SELECT count(DISTINCT user_id) FROM projects) AS first_map,
   (SELECT count(DISTINCT uid) FROM ({_PAYERS})) AS paid_or_donated"""
_LIVE = """SELECT count(*) AS started, count(*) FILTER (WHERE regen_used > 0) AS regen_used,
   count(*) FILTER (WHERE payment_status = 'paid') AS paid FROM live_exports"""
_DOC_SYMBOLS = """SELECT o_orderkey AS project_id, CAST(o_orderkey * 10 + i AS VARCHAR) AS id,
   ['pucca_house', 'kutcha_house', 'apartment', 'well', 'non_residential'][i % 5 + 1] AS symbol_type,
   CASE WHEN o_orderkey % 4 = 0 OR i % 2 = 0 THEN i + 1 END AS number
   FROM orders, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS i) WHERE i < o_orderkey % 6 AND o_orderkey % 50 <> 7"""

CHECKS = {
    "timeline": with_tables("user_profiles", "projects", "payment_events", query=f"""
        SELECT strftime(d, '%Y-%m-%d') AS day, coalesce(u.n, 0) AS new_users, coalesce(p.n, 0) AS new_projects,
               CAST(coalesce(r.n, 0) AS BIGINT) AS revenue_paise
        FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-31' - INTERVAL 29 DAY, DATE '2024-01-31',
                                                 INTERVAL 1 DAY)) AS DATE) AS d)
        LEFT JOIN (SELECT {_LOCAL} AS k, count(*) AS n FROM user_profiles WHERE {_RECENT} GROUP BY 1) u ON u.k = d
        LEFT JOIN (SELECT {_LOCAL} AS k, count(*) AS n FROM projects WHERE {_RECENT} GROUP BY 1) p ON p.k = d
        LEFT JOIN (SELECT {_LOCAL} AS k, sum(amount_paise) AS n FROM payment_events WHERE {_RECENT} GROUP BY 1) r
          ON r.k = d"""),
    "kpis": with_tables("user_profiles", "projects", "live_exports", "donations", "payment_events", "user_events",
                        query=f"""
        SELECT n AS total_users, {_share('payers', 'n')} AS paid_conversion_pct,
               CAST(rev AS BIGINT) AS total_revenue_paise, act AS active_this_week
        FROM (SELECT (SELECT count(*) FROM user_profiles) AS n,
                     (SELECT count(DISTINCT uid) FROM ({_PAYERS})) AS payers,
                     (SELECT coalesce(sum(amount_paise), 0) FROM payment_events) AS rev,
                     (SELECT count(DISTINCT uid) FROM ({_ACTIVE})) AS act)"""),
    "funnel": with_tables("user_profiles", "projects", "live_exports", "donations", query=_FUNNEL),
    "revenue_breakdown": with_tables("payment_events", query="SELECT " + ", ".join(
        f"CAST(coalesce(sum(amount_paise) FILTER (WHERE source_type = '{t}'), 0) AS BIGINT) AS {n}_paise, "
        + _share(f"coalesce(sum(amount_paise) FILTER (WHERE source_type = '{t}'), 0)", "sum(amount_paise)")
        + f" AS {n}_share" for n, t in (("maps", "map"), ("sessions", "live_session"), ("donations", "donation"),
                                        ("upi", "upi"))) + " FROM payment_events"),
    "cohort_retention": with_tables("user_profiles", "projects", "user_events", query="""
        , activity AS (SELECT user_id AS id, created_at AS ts FROM user_events
                       UNION ALL SELECT user_id, updated_at FROM projects
                       UNION ALL SELECT id, updated_at FROM user_profiles),
        cohort AS (SELECT u.id, u.created_at AS signup, """ + ", ".join(
            f"bool_or(a.ts >= u.created_at + INTERVAL {lo} HOUR AND a.ts < u.created_at + INTERVAL {hi} HOUR) AS ret_{n}"
            for n, (lo, hi, _) in dashboard.RETENTION.items()) + """
          FROM user_profiles u LEFT JOIN activity a ON a.id = u.id GROUP BY 1, 2)
        SELECT """ + ", ".join(_kept(n, *w) for n, w in dashboard.RETENTION.items()) + " FROM cohort"),
    "geo_top50": with_tables("user_profiles", query="""
        SELECT coalesce(tehsil, 'Unknown') AS tehsil, coalesce(town_village, 'Unknown') AS town_village,
               count(*) AS user_count, round(count(*)::DOUBLE * 100 / (SELECT count(*) FROM user_profiles), 1) AS pct
        FROM user_profiles GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 50"""),
    "live_funnel": with_tables("live_exports", query=_LIVE),
    "weekly_active": with_tables("projects", "user_profiles", "user_events",
                                 query=f"SELECT count(DISTINCT uid) AS active_this_week FROM ({_ACTIVE})"),
    "paid_users": with_tables("projects", "live_exports", "donations",
                              query=f"SELECT count(DISTINCT uid) AS paid_or_donated FROM ({_PAYERS})"),
    "month_groups": with_tables("projects", query="""
        SELECT strftime(updated_at, '%B %Y') AS month, count(*) AS projects FROM projects GROUP BY 1"""),
    "user_counts": with_tables("user_profiles", "projects", "live_exports", query="""
        SELECT id, full_name, (SELECT count(*) FROM projects p WHERE p.user_id = u.id) AS project_count,
               (SELECT count(*) FROM live_exports l WHERE l.user_id = u.id) AS live_session_count
        FROM user_profiles u"""),
    "owner_lookup": with_tables("user_profiles", "projects", query="""
        SELECT p.id, p.user_id, p.name, u.full_name AS owner_name, u.mobile AS owner_mobile
        FROM projects p LEFT JOIN user_profiles u ON u.id = p.user_id"""),
    "user_search": with_tables("user_profiles", query="""
        SELECT id, full_name, tehsil FROM user_profiles WHERE full_name ILIKE '%nation_1%' OR mobile ILIKE '%nation_1%'
           OR tehsil ILIKE '%nation_1%' OR town_village ILIKE '%nation_1%'"""),
    "project_search": with_tables("user_profiles", "projects", query="""
        SELECT id, user_id, name, payment_status FROM projects WHERE payment_status = 'paid' AND (name ILIKE '%00012%'
          OR user_id IN (SELECT id FROM user_profiles WHERE full_name ILIKE '%00012%' OR mobile ILIKE '%00012%'))"""),
    "donation_search": with_tables("user_profiles", "donations", query="""
        SELECT d.id, d.user_id, d.name, u.full_name AS owner_name FROM donations d
        LEFT JOIN user_profiles u ON u.id = d.user_id WHERE coalesce(d.is_paid, false)
          AND (contains(lower(coalesce(d.name, '')), 'or 12') OR contains(lower(coalesce(d.note, '')), 'or 12')
               OR contains(lower(coalesce(u.full_name, '')), 'or 12'))"""),
    "session_search": with_tables("user_profiles", "live_exports", query="""
        SELECT l.session_id, l.user_id, u.full_name AS owner_name FROM live_exports l
        LEFT JOIN user_profiles u ON u.id = l.user_id WHERE l.payment_status = 'paid'
          AND (contains(lower(coalesce(u.full_name, '')), '99') OR contains(coalesce(u.mobile, ''), '99')
               OR contains(CAST(l.session_id AS VARCHAR), '99'))"""),
    "project_page": with_tables("user_profiles", "projects", query="""
        SELECT p.id, p.user_id, u.full_name AS owner_name
        FROM (SELECT * FROM projects ORDER BY updated_at DESC, id LIMIT 20 OFFSET 40) p
        LEFT JOIN user_profiles u ON u.id = p.user_id"""),
    "visible_projects": with_tables("user_profiles", "projects", "project_assignments", query="""
        SELECT u.id AS viewer_id, p.id AS project_id, false AS all_projects FROM user_profiles u JOIN projects p ON p.user_id = u.id
         WHERE NOT u.is_admin
        UNION SELECT a.user_id, a.project_id, false FROM project_assignments a JOIN user_profiles u ON u.id = a.user_id
         WHERE NOT u.is_admin
        UNION ALL SELECT id, NULL, true FROM user_profiles WHERE is_admin"""),
    "own_and_assigned": with_tables("projects", "project_assignments", query="""
        SELECT user_id AS viewer_id, id AS project_id, false AS assigned FROM projects
        UNION ALL SELECT user_id, project_id, true FROM project_assignments"""),
    "ledger_backfill": with_tables("payment_events", "projects", "live_exports", "donations", query="""
        , wanted AS (
          SELECT 'map' AS source_type, id AS source_id, 2500::BIGINT AS amount_paise, payment_id FROM projects
           WHERE payment_status = 'paid'
          UNION ALL SELECT 'live_session', session_id, 2500, payment_id FROM live_exports WHERE payment_status = 'paid'
          UNION ALL SELECT 'donation', id, CAST(round(amount * 100) AS BIGINT), payment_id FROM donations
           WHERE (is_paid = true OR payment_status = 'paid') AND amount > 0)
        SELECT *, 'cashfree' AS payment_method, 'backfill-seed' AS note FROM wanted w WHERE NOT EXISTS (
          SELECT 1 FROM payment_events e WHERE e.source_type = w.source_type AND e.source_id = w.source_id)"""),
    "ledger_quarantine": with_tables("payment_events", query="""
        SELECT id, source_type, source_id, amount_paise, payment_method FROM payment_events
        WHERE NOT (payment_method IN ('cashfree', 'upi', 'other') AND amount_paise > 0)"""),
    "donation_totals": with_tables("donations", query="""
        SELECT round(sum(amount), 2) AS total, round(sum(amount) FILTER (WHERE is_paid), 2) AS paid_total,
               count(*) FILTER (WHERE is_paid) AS paid, count(*) FILTER (WHERE is_paid IS DISTINCT FROM true) AS pending
        FROM donations"""),
    "support_totals": with_tables("donations", query="""
        SELECT count(*) AS supporters, round(sum(amount), 2) AS amount FROM donations WHERE is_paid
        HAVING count(*) >= 15"""),
    "donation_transitions": with_tables("donations", query="""
        , versions AS (SELECT id, name, amount, note, version, CASE version
              WHEN 0 THEN (CASE WHEN id % 3 = 0 THEN false END) WHEN 1 THEN is_paid
              ELSE is_paid OR id % 5 = 0 END AS is_paid
            FROM donations, (SELECT unnest([0::BIGINT, 1, 2]) AS version)),
        v AS (SELECT *, lag(is_paid) OVER (PARTITION BY id ORDER BY version) AS old,
                     coalesce(nullif(trim(name), ''), 'anonymous') AS donor FROM versions)
        SELECT id, version, donor, amount, coalesce(nullif(trim(note), ''), 'donation') AS note
        FROM v WHERE is_paid AND old IS DISTINCT FROM true"""),
    "quota_usage": with_tables("image_generations_other", "image_generations_click", query="""
        SELECT user_id, count(*) AS used, greatest(0, 6 - count(*)) AS remaining, count(*) >= 6 AS blocked
        FROM (SELECT * FROM image_generations_other UNION ALL SELECT * FROM image_generations_click)
        WHERE created_at >= TIMESTAMP '2024-01-15' AND created_at < TIMESTAMP '2024-01-16' GROUP BY 1"""),
    "latest_selected": with_tables("image_generations_all", query="""
        SELECT id, project_id, user_id,
               row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id DESC) = 1 AS selected
        FROM image_generations_all"""),
    "recent_boundaries": """
        SELECT user_id, hlb_number, id, rank FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rank FROM (
            SELECT o_custkey AS user_id, o_orderkey % 40 AS hlb_number, o_orderkey AS id, o_orderdate AS created_at
            FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderkey % 40
                                                   ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)) WHERE rank <= 10""",
    "project_status": f"""
        WITH s AS ({_DOC_SYMBOLS})
        SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 50 <> 7 THEN 'canvas' ELSE 'desk' END AS list,
               total, numbered, CASE WHEN total = 0 THEN 'draft' WHEN numbered = total THEN 'completed'
                                     ELSE 'in_progress' END AS status
        FROM (SELECT o_orderkey, count(*) FILTER (WHERE symbol_type <> 'well') AS total,
                     count(*) FILTER (WHERE symbol_type <> 'well' AND number IS NOT NULL) AS numbered
              FROM orders LEFT JOIN s ON project_id = o_orderkey GROUP BY 1)
        WHERE o_orderkey % 9 <> 0 OR o_orderkey % 50 = 7""",
    "document_search": """
        SELECT o_orderkey AS id, 'HLB ' || o_orderkey AS name FROM orders
        WHERE o_orderkey % 5 = 0 AND o_orderkey % 50 <> 7""",
    "document_symbols": _DOC_SYMBOLS + """
        UNION ALL SELECT o_orderkey, NULL, NULL, NULL FROM orders WHERE o_orderkey % 50 = 7 OR o_orderkey % 6 = 0""",
    "session_states": with_tables("live_exports", query=f"""
        SELECT count(*) FILTER (WHERE created_at > TIMESTAMP '{ORDER_AS_OF}' - INTERVAL 7 DAY) AS new_this_week,
               count(*) FILTER (WHERE regen_used = 1) AS paused, count(*) FILTER (WHERE regen_used = 2) AS completed
        FROM live_exports"""),
    "event_types": "SELECT DISTINCT event_type FROM events",
    "csv_export": with_tables("donations", query="""
        SELECT 'id,remark,name' AS line UNION ALL
        SELECT id || ',"He said ""' || note || '"", ok",' || coalesce(name, '') FROM donations"""),
}


def _object(name: str, columns: str = "*") -> str:
    return f"""'"{name}":' || (SELECT to_json(x) FROM (SELECT {columns} FROM ({CHECKS[name if name in CHECKS else name + '_top50']})) x)"""


def _list(name: str, order: str) -> str:
    return f"""'"{name}":[' || (SELECT string_agg(CAST(to_json(x) AS VARCHAR), ',' ORDER BY {order}) FROM ({CHECKS[name if name in CHECKS else name + '_top50']}) x) || ']'"""


CHECKS["dashboard_payload"] = "SELECT '{' || " + " || ',' || ".join((
    _object("kpis"), _list("timeline", "day"), _object("funnel"), _object("revenue_breakdown", "maps_paise, sessions_paise, donations_paise, upi_paise"),
    _object("cohort_retention"), _list("geo", "user_count DESC, tehsil, town_village"), _object("live_funnel"))) + " || '}' AS payload"
