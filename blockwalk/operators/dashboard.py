"""Product statistics: KPIs, daily timeline, funnel, revenue, retention, geography.

Every function takes the relations it reads and an explicit ``as_of`` instead of
the wall clock, and returns one lazy DataFrame.  Activity is reduced per user
(or per user and hour) on the map side before anything is shuffled by user.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ts(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp")


def _minus_days(as_of: str, days: int) -> Column:
    return _ts(as_of) - F.expr(f"INTERVAL '{int(days)}' DAY")


def _pct(part: Column, whole: Column) -> Column:
    """Percentage to one decimal, half away from zero, 0 for an empty base."""
    exact = F.round(part.cast("decimal(20,0)") * 100 / whole.cast("decimal(20,0)"), 1).cast("double")
    return F.when(whole > 0, exact).otherwise(F.lit(0.0))


def _ids(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).cast("string").alias("uid")).filter("uid IS NOT NULL")


def _one_row(*parts: DataFrame) -> DataFrame:
    """Side by side columns of one-row results: stacked, then folded into one row."""
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in stacked.columns])


# ------------------------------------------------------------ user counting

def active_users(projects, profiles, events, as_of: str, days: int = 7) -> DataFrame:
    """Ids seen in any of the three activity sources in the last ``days``."""
    since = _minus_days(as_of, days)
    return _ids(projects.filter(F.col("updated_at") >= since), "user_id") \
        .unionByName(_ids(profiles.filter(F.col("updated_at") >= since), "id")) \
        .unionByName(_ids(events.filter(F.col("created_at") >= since), "user_id"))


def weekly_active(projects, profiles, events, as_of: str, approximate: bool = False) -> DataFrame:
    ids = active_users(projects, profiles, events, as_of)
    count = F.approx_count_distinct("uid", 0.01) if approximate else F.count_distinct("uid")
    return ids.agg(count.alias("active_this_week"))


def payer_ids(projects, live_exports, donations) -> DataFrame:
    paid = F.col("payment_status") == "paid"
    return _ids(projects.filter(paid), "user_id") \
        .unionByName(_ids(live_exports.filter(paid), "user_id")) \
        .unionByName(_ids(donations.filter(F.coalesce(F.col("is_paid"), F.lit(False)) | paid), "user_id"))


def paid_users(projects, live_exports, donations) -> DataFrame:
    return payer_ids(projects, live_exports, donations).agg(F.count_distinct("uid").alias("paid_or_donated"))


def kpis(profiles, projects, live_exports, donations, payments, events, as_of: str) -> DataFrame:
    """One row: users, conversion, revenue in paise, users active this week."""
    users = profiles.agg(F.count(F.lit(1)).alias("total_users"))
    revenue = payments.agg(F.coalesce(F.sum("amount_paise"), F.lit(0)).cast("long").alias("total_revenue_paise"))
    row = _one_row(users, paid_users(projects, live_exports, donations), revenue,
                   weekly_active(projects, profiles, events, as_of))
    return row.select("total_users", _pct(F.col("paid_or_donated"), F.col("total_users")).alias("paid_conversion_pct"),
                      "total_revenue_paise", "active_this_week")


def funnel(profiles, projects, live_exports, donations) -> DataFrame:
    """Sign-up, onboarding, first map, payment."""
    people = profiles.agg(F.count(F.lit(1)).alias("signups"),
                          F.count_if(F.col("onboarding_completed")).alias("onboarding_done"))
    makers = projects.agg(F.count_distinct("user_id").alias("first_map"))
    return _one_row(people, makers, paid_users(projects, live_exports, donations))


# ----------------------------------------------------------------- calendar

def timeline(profiles, projects, payments, as_of: str, days: int = 30, tz: str = "Asia/Kolkata") -> DataFrame:
    """Daily sign-ups, projects and revenue in a named zone; days without rows give 0."""
    since = _minus_days(as_of, days)
    local = lambda c: F.to_date(F.from_utc_timestamp(c, tz))

    def daily(df: DataFrame, **measures: Column) -> DataFrame:
        return df.filter(F.col("created_at") >= since).groupBy(local(F.col("created_at")).alias("d")) \
            .agg(*[c.alias(n) for n, c in measures.items()])

    today = local(_ts(as_of))
    spine = profiles.sparkSession.range(1).select(
        F.explode(F.sequence(F.date_sub(today, days - 1), today)).alias("d"))
    one = F.count(F.lit(1))
    out = spine.join(daily(profiles, new_users=one), "d", "left") \
        .join(daily(projects, new_projects=one), "d", "left") \
        .join(daily(payments, revenue_paise=F.sum("amount_paise")), "d", "left")
    return out.select(F.date_format("d", "yyyy-MM-dd").alias("day"), *[
        F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("new_users", "new_projects", "revenue_paise")]) \
        .orderBy("day")


def month_groups(projects) -> DataFrame:
    """Projects per calendar month of their last change, newest month first."""
    moment = F.coalesce("updated_at", "created_at")
    return projects.groupBy(F.date_format(moment, "MMMM yyyy").alias("month")).agg(
        F.count(F.lit(1)).alias("projects"), F.max(moment).alias("_newest")) \
        .orderBy(F.desc("_newest")).select("month", "projects")


# ------------------------------------------------------------------ revenue

def revenue_breakdown(payments) -> DataFrame:
    """Paise by source with each source's share of the total in percent."""
    total = F.sum("amount_paise")
    part = lambda kind: F.coalesce(F.sum(F.when(F.col("source_type") == kind, F.col("amount_paise"))), F.lit(0))
    cols = {"maps": "map", "sessions": "live_session", "donations": "donation", "upi": "upi"}
    return payments.agg(
        *[part(kind).cast("long").alias(f"{name}_paise") for name, kind in cols.items()],
        *[_pct(part(kind), F.coalesce(total, F.lit(0))).alias(f"{name}_share") for name, kind in cols.items()])


def live_funnel(live_exports) -> DataFrame:
    return live_exports.agg(F.count(F.lit(1)).alias("started"), F.count_if(F.col("regen_used") > 0).alias("regen_used"),
                            F.count_if(F.col("payment_status") == "paid").alias("paid"))


# ---------------------------------------------------------------- retention

# Return windows in hours after sign-up, and the age that makes a user eligible.
RETENTION = {"d1": (20, 48, 1), "d7": (144, 192, 7), "d30": (672, 768, 30)}


def cohort_retention(profiles, projects, events, as_of: str) -> DataFrame:
    """Share of eligible users seen again one, seven and thirty days after sign-up.

    Activity shrinks to one (first, last) pair per user and hour before the join.
    That is exact: an hour is shorter than any window, so a window holds a moment
    of that hour exactly when last >= start and first < end.
    """
    acts = events.select(F.col("user_id").alias("id"), F.col("created_at").alias("ts")) \
        .unionByName(projects.select(F.col("user_id").alias("id"), F.col("updated_at").alias("ts"))) \
        .unionByName(profiles.select("id", F.col("updated_at").alias("ts"))).filter("id IS NOT NULL")
    hourly = acts.groupBy("id", F.date_trunc("hour", "ts").alias("h")) \
        .agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    hours = lambda n: F.expr(f"INTERVAL '{n}' HOUR")
    flags = {name: F.bool_or((F.col("last") >= F.col("signup") + hours(a)) & (F.col("first") < F.col("signup") + hours(b)))
             for name, (a, b, _) in RETENTION.items()}
    cohort = profiles.select("id", F.col("created_at").alias("signup")).join(hourly, "id", "left") \
        .groupBy("id", "signup").agg(*[c.alias(f"ret_{n}") for n, c in flags.items()])
    out = []
    for name, (_, _, age) in RETENTION.items():
        old = F.col("signup") <= _minus_days(as_of, age)
        out.append(_pct(F.count_if(old & F.col(f"ret_{name}")), F.count_if(old)).alias(f"{name}_pct"))
    return cohort.agg(*out)


# ---------------------------------------------------------------- geography

def geo_distribution(profiles, top: int = 50) -> DataFrame:
    """Users by tehsil and village with their share; the ``top`` largest, names breaking ties."""
    unknown = lambda c: F.coalesce(F.col(c), F.lit("Unknown")).alias(c)
    counts = profiles.groupBy(unknown("tehsil"), unknown("town_village")).agg(F.count(F.lit(1)).alias("user_count"))
    order = [F.desc("user_count"), F.col("tehsil"), F.col("town_village")]
    total = profiles.agg(F.count(F.lit(1)).alias("_n"))
    # the total joins the top rows, which are few, as one more row of the same window
    few = counts.orderBy(*order).limit(top).unionByName(total, allowMissingColumns=True) \
        .withColumn("_n", F.max("_n").over(Window.partitionBy(F.lit(0))))
    return few.filter("user_count IS NOT NULL").select(
        "tehsil", "town_village", "user_count", _pct(F.col("user_count"), F.col("_n")).alias("pct")).orderBy(*order)


# ------------------------------------------------------------------ payload

def payload(lists: dict[str, list[Column]] | None = None, **parts: DataFrame) -> DataFrame:
    """One JSON document from named results: an object per one-row result, and a list of rows, in the order given, per result in ``lists``.

    The parts are reports of fixed size (one row, one month of days, fifty places).
    """
    lists = lists or {}

    def folded(name: str, df: DataFrame) -> DataFrame:
        row = F.struct(*df.columns)
        if name not in lists:
            return df.agg(F.first(row).alias(name))
        ordered = F.array_sort(F.collect_list(F.struct(*[c.alias(f"_{i}") for i, c in enumerate(lists[name])], row.alias("row"))))
        return df.agg(F.transform(ordered, lambda x: x["row"]).alias(name))

    return _one_row(*[folded(name, df) for name, df in parts.items()]).select(F.to_json(F.struct(*parts)).alias("payload"))


def admin_payload(profiles, projects, live_exports, donations, payments, events, as_of: str, days: int = 30, tz: str = "Asia/Kolkata") -> DataFrame:
    """All seven parts of the statistics page as one document."""
    revenue = [c for c in revenue_breakdown(payments).columns if c.endswith("_paise")]
    return payload(
        {"timeline": [F.col("day")], "geo": [-F.col("user_count"), F.col("tehsil"), F.col("town_village")]},
        kpis=kpis(profiles, projects, live_exports, donations, payments, events, as_of), timeline=timeline(profiles, projects, payments, as_of, days, tz),
        funnel=funnel(profiles, projects, live_exports, donations), revenue_breakdown=revenue_breakdown(payments).select(*revenue),
        cohort_retention=cohort_retention(profiles, projects, events, as_of), geo=geo_distribution(profiles), live_funnel=live_funnel(live_exports))
