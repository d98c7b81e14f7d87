"""Lookups, searches, pages, visibility, ledger and quotas over the account relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockwalk.operators.ordered import Ordered

# Ledger vocabulary and quotas.
SOURCE_TYPES = ["map", "live_session", "donation", "upi"]
PAYMENT_METHODS = ["cashfree", "upi", "other"]
BACKFILL_PAISE = 2500
DAILY_IMAGE_LIMIT = 6
SUPPORT_MIN_ROWS = 15


# ------------------------------------------------------------------- lookups

def with_owner(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """Owner name and mobile of each row; rows without an owner keep nulls."""
    owner = profiles.select(F.col("id").alias("user_id"), F.col("full_name").alias("owner_name"),
                            F.col("mobile").alias("owner_mobile"))
    return rows.join(owner, "user_id", "left")


def user_counts(profiles: DataFrame, projects: DataFrame, sessions: DataFrame) -> DataFrame:
    """Project and session counts per user, 0 where there are none."""
    count = lambda df, name: df.groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias(name))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return profiles.join(count(projects, "project_count"), "id", "left") \
        .join(count(sessions, "live_session_count"), "id", "left") \
        .select(*profiles.columns, zero("project_count"), zero("live_session_count"))


def user_detail(profiles, projects, sessions, user_id) -> dict[str, DataFrame]:
    """A profile with its projects (last changed first) and sessions (newest first)."""
    return {"profile": profiles.filter(F.col("id") == user_id),
            "projects": projects.filter(F.col("user_id") == user_id).orderBy(F.desc("updated_at"), "id"),
            "sessions": sessions.filter(F.col("user_id") == user_id).orderBy(F.desc("created_at"), "session_id")}


def session_payment(sessions: DataFrame, live_exports: DataFrame) -> DataFrame:
    """Local sessions with the payment status of their export."""
    return sessions.join(live_exports.select("session_id", "payment_status"), "session_id", "left")


# ------------------------------------------------------------------ searches

def matches(query: str, *columns: str) -> Column:
    """Case-insensitive substring match on any column; % and _ keep their LIKE meaning."""
    test = F.lit(False)
    for c in columns:
        test = test | F.coalesce(F.col(c).ilike(f"%{query.strip()}%"), F.lit(False))
    return test


def contains_text(query: str, *columns: Column) -> Column:
    """Lower-cased literal substring match on any column."""
    test = F.lit(False)
    for c in columns:
        test = test | F.lower(F.coalesce(c.cast("string"), F.lit(""))).contains(query.lower())
    return test


def search_users(profiles: DataFrame, query: str, picker: bool = False) -> DataFrame:
    columns = ["full_name", "mobile", "tehsil"] + ([] if picker else ["town_village"])
    return profiles.filter(matches(query, *columns)) if query.strip() else profiles


def search_projects(projects: DataFrame, profiles: DataFrame, query: str = "", status: str = "all") -> DataFrame:
    """Projects whose name matches or whose owner does, with an optional payment filter."""
    out = projects if status == "all" else projects.filter(F.col("payment_status") == status)
    if not query.strip():
        return out
    owners = profiles.filter(matches(query, "full_name", "mobile")).select(F.col("id").alias("user_id")).distinct()
    return out.join(owners.withColumn("_owner", F.lit(True)), "user_id", "left") \
        .filter(matches(query, "name") | F.col("_owner").isNotNull()).drop("_owner")


def search_donations(donations: DataFrame, profiles: DataFrame, query: str, tab: str = "all") -> DataFrame:
    rows = with_owner(donations, profiles)
    paid = F.coalesce(F.col("is_paid"), F.lit(False))
    if tab != "all":
        rows = rows.filter(paid if tab == "paid" else ~paid)
    return rows.filter(contains_text(query, F.col("name"), F.col("note"), F.col("owner_name"), F.col("owner_mobile"),
                                     F.col("amount").cast("decimal(18,2)")))


def search_sessions(sessions: DataFrame, profiles: DataFrame, query: str, tab: str = "all") -> DataFrame:
    """Session ids are compared as they are with the lower-cased query."""
    rows = with_owner(sessions, profiles)
    if tab != "all":
        rows = rows.filter(F.col("payment_status") == tab)
    return rows.filter(contains_text(query, F.col("owner_name"), F.col("owner_mobile"))
                       | F.col("session_id").cast("string").contains(query.lower()))


def search_feedback(feedback: DataFrame, profiles: DataFrame, query: str) -> DataFrame:
    """Feedback whose text, answer or owner holds the query."""
    return with_owner(feedback, profiles).filter(contains_text(
        query, F.col("suggestions"), F.col("useful"), F.col("owner_name"), F.col("owner_mobile")))


def page_with_total(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page with the exact number of all rows beside each (``total``): a top-k plan and one count."""
    total = df.agg(F.count(F.lit(1)).alias("total")).first()["total"]
    return page(df, order, number, size).withColumn("total", F.lit(total).cast("bigint"))


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page; a top-k plan, never a full sort."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def event_types(events: DataFrame) -> DataFrame:
    return events.select("event_type").distinct().orderBy("event_type")


# ---------------------------------------------------------------- visibility

def visible_projects(projects: DataFrame, assignments: DataFrame, profiles: DataFrame,
                     viewers: DataFrame) -> DataFrame:
    """(viewer, project, all_projects): what each viewer may read.

    ``viewers`` is a list of ids.  Own and assigned rows are equi-joins.  An admin of ``profiles`` may read every
    project: that is one row with ``all_projects`` set and no project, never a product of admins and projects;
    :func:`visible_to` lists the rows of one viewer.
    """
    admins = viewers.join(profiles.filter("is_admin").select(F.col("id").alias("user_id")), "user_id", "left_semi")
    viewers = viewers.join(admins, "user_id", "left_anti")
    mine = viewers.select(F.col("user_id")).join(projects, "user_id") \
        .select(F.col("user_id").alias("viewer_id"), F.col("id").alias("project_id"))
    given = viewers.join(assignments, "user_id") \
        .join(projects.select(F.col("id").alias("project_id")), "project_id", "left_semi") \
        .select(F.col("user_id").alias("viewer_id"), "project_id")
    everything = admins.select(F.col("user_id").alias("viewer_id"), F.lit(None).cast("bigint").alias("project_id"),
                               F.lit(True).alias("all_projects")).distinct()
    return mine.unionByName(given).distinct().withColumn("all_projects", F.lit(False)).unionByName(everything)


def visible_to(projects: DataFrame, assignments: DataFrame, user_id, is_admin: bool = False) -> DataFrame:
    """Rows one user may read."""
    if is_admin:
        return projects
    given = assignments.filter(F.col("user_id") == user_id).select(F.col("project_id").alias("id")).distinct() \
        .withColumn("_given", F.lit(True))
    return projects.join(given, "id", "left") \
        .filter((F.col("user_id") == user_id) | F.col("_given").isNotNull()).drop("_given")


def own_and_assigned(projects: DataFrame, assignments: DataFrame) -> DataFrame:
    """Both dashboard lists with a flag; an owned and assigned project is in both."""
    own = projects.select(F.col("user_id").alias("viewer_id"), F.col("id").alias("project_id"),
                          F.lit(False).alias("assigned"))
    given = assignments.join(projects.select(F.col("id").alias("project_id")), "project_id", "left_semi") \
        .select(F.col("user_id").alias("viewer_id"), "project_id", F.lit(True).alias("assigned"))
    return own.unionByName(given)


def active_announcements(announcements: DataFrame, latest: int | None = None) -> DataFrame:
    rows = announcements.filter("is_active").orderBy(F.desc("created_at"), "id")
    return rows.limit(latest) if latest else rows


# -------------------------------------------------------------------- ledger

def split_ledger(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that satisfy the ledger rules, and the rest."""
    ok = F.coalesce(F.col("source_type").isin(SOURCE_TYPES) & F.col("payment_method").isin(PAYMENT_METHODS)
                    & (F.col("amount_paise") > 0), F.lit(False))
    return rows.filter(ok), rows.filter(~ok)


def ledger_backfill(payments, projects, live_exports, donations) -> DataFrame:
    """Ledger rows for paid maps, sessions and donations that have none yet; a second run adds nothing."""
    paid = F.col("payment_status") == "paid"
    seed = lambda df, kind, key, amount, when: df.select(
        F.lit(kind).alias("source_type"), F.col(key).alias("source_id"), amount.cast("long").alias("amount_paise"),
        "payment_id", F.lit("cashfree").alias("payment_method"), F.lit("backfill-seed").alias("note"),
        F.col(when).alias("created_at"))
    wanted = seed(projects.filter(paid), "map", "id", F.lit(BACKFILL_PAISE), "updated_at") \
        .unionByName(seed(live_exports.filter(paid), "live_session", "session_id", F.lit(BACKFILL_PAISE), "created_at")) \
        .unionByName(seed(donations.filter((F.coalesce(F.col("is_paid"), F.lit(False)) | paid) & (F.col("amount") > 0)),
                          "donation", "id", F.round(F.col("amount") * 100), "created_at"))
    have = payments.select("source_type", "source_id").distinct()
    return wanted.join(have, ["source_type", "source_id"], "left_anti")


def donation_totals(donations: DataFrame) -> DataFrame:
    paid = F.coalesce(F.col("is_paid"), F.lit(False))
    total = lambda c: F.round(F.coalesce(F.sum(c), F.lit(0.0)), 2)
    return donations.agg(total(F.col("amount")).alias("total"), total(F.when(paid, F.col("amount"))).alias("paid_total"),
                         F.count_if(paid).alias("paid"), F.count_if(~paid).alias("pending"))


def support_totals(donations: DataFrame, min_rows: int = SUPPORT_MIN_ROWS) -> DataFrame:
    """Paid count and sum; no row while fewer than ``min_rows`` people have given."""
    return donations.filter("is_paid").agg(F.count(F.lit(1)).alias("supporters"),
                                           F.round(F.sum("amount"), 2).alias("amount")) \
        .filter(F.col("supporters") >= min_rows)


def paid_transitions(versions: DataFrame) -> DataFrame:
    """Versions at which a donation becomes paid, with the donor, amount and note of the announcement; wording is left to a template.

    ``versions`` holds (id, version, is_paid, name, amount, note); the first paid
    version counts, as does every change from unpaid or unknown to paid.
    """
    rows = Ordered.of(versions, ["id"], [F.col("version")]).lag(_before="is_paid").rows()
    blank = lambda c, default: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit(default))
    donor = blank("name", "anonymous")
    return rows.filter(F.col("is_paid") & ~F.coalesce(F.col("_before"), F.lit(False))).select(
        "id", "version", donor.alias("donor"), "amount", blank("note", "donation").alias("note"))


# -------------------------------------------------------- quotas and latest

def quota_usage(images: DataFrame, live_images: DataFrame, day: str, limit: int = DAILY_IMAGE_LIMIT) -> DataFrame:
    """Images made on a UTC day per user over both tables, and what remains of the limit."""
    both = images.select("user_id", "created_at").unionByName(live_images.select("user_id", "created_at"))
    start = F.lit(day).cast("timestamp")
    return both.filter((F.col("created_at") >= start) & (F.col("created_at") < start + F.expr("INTERVAL '1' DAY"))) \
        .groupBy("user_id").agg(F.count(F.lit(1)).alias("used")) \
        .select("user_id", "used", F.greatest(F.lit(0), F.lit(limit) - F.col("used")).cast("long").alias("remaining"),
                (F.col("used") >= limit).alias("blocked"))


def select_newest(images: DataFrame, key: str = "project_id") -> DataFrame:
    """Flag the newest image of each project as selected.

    The winners come from a map-side combined maximum and are matched by
    (project, image), so a project with very many images is not one join key.
    """
    newest = images.groupBy(key).agg(F.max(F.struct("created_at", "id")).alias("_m")) \
        .select(key, F.col("_m.id").alias("id"), F.lit(True).alias("_top"))
    return images.join(newest, [key, "id"], "left") \
        .withColumn("selected", F.coalesce("_top", F.lit(False))).drop("_top")


def latest_per(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows per key; the group limit runs before the shuffle as well."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n) \
        .withColumn("rank", F.col("rank").cast("long"))


def recent_boundaries(saved: DataFrame, n: int = 10) -> DataFrame:
    """Per user the newest boundary of each block, the ``n`` most recent blocks."""
    newest = saved.groupBy("user_id", "hlb_number").agg(
        F.max(F.struct("created_at", "id")).alias("_m")).select("user_id", "hlb_number", "_m.*")
    return latest_per(newest, "user_id", [F.desc("created_at"), F.desc("id")], n)


# ------------------------------------------------------------ project state

def project_status(documents: DataFrame) -> DataFrame:
    """Buildings, numbered buildings and state per project document.

    ``documents`` carries the parsed ``data`` struct; a missing or broken document
    has no symbols and is a draft.  Counting happens inside each document's array.
    """
    syms = F.coalesce(F.col("data.symbols"), F.array())
    house = lambda s: s["symbol_type"].isin("pucca_house", "kutcha_house", "apartment", "non_residential")
    total = F.size(F.filter(syms, house)).cast("long")
    numbered = F.size(F.filter(syms, lambda s: house(s) & s["number"].isNotNull())).cast("long")
    out = documents.withColumns({"total": total, "numbered": numbered})
    return out.withColumn("status", F.when(F.col("total") == 0, "draft")
                          .when(F.col("numbered") == F.col("total"), "completed").otherwise("in_progress"))


def search_documents(documents: DataFrame, query: str) -> DataFrame:
    return documents.filter(contains_text(query, F.col("name"), F.col("data.hlbNumber"), F.col("data.district"),
                                          F.col("data.state")))


def dashboard_lists(documents: DataFrame) -> DataFrame:
    """Live documents with the list (desk or canvas) they belong to."""
    return documents.filter(~F.coalesce(F.col("data.deletedUI"), F.lit(False))) \
        .withColumn("list", F.when(F.col("data.mode") == "canvas", "canvas").otherwise("desk"))


def session_state_counts(sessions: DataFrame, as_of: str) -> DataFrame:
    week = F.lit(as_of).cast("timestamp") - F.expr("INTERVAL '7' DAY")
    return sessions.agg(F.count_if(F.col("created_at") > week).alias("new_this_week"),
                        F.count_if(F.col("state") == "paused").alias("paused"),
                        F.count_if(F.col("state") == "completed").alias("completed"))
