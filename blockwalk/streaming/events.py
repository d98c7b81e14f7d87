"""Event intake and the live daily timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockwalk.functions import domain

#: One posted event: body fields and the forwarding header.
POSTED = T.StructType([
    T.StructField("fingerprintId", T.StringType()), T.StructField("eventType", T.StringType()),
    T.StructField("pagePath", T.StringType()), T.StructField("userId", T.StringType()),
    T.StructField("metadata", T.StringType()), T.StructField("forwarded", T.StringType()),
    T.StructField("ts", T.TimestampType())])


def posted_events(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Stream of posted events from a folder of JSON lines."""
    return spark.readStream.schema(POSTED).option("maxFilesPerTrigger", files_per_batch).json(path)


def user_event_rows(posted: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """Rows to append to the event table: a type is required, blanks become null.

    ``places`` (ip_address, country, region, city, lat, lng) adds where public
    addresses are; private ones never match.
    """
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    rows = posted.filter(blank("eventType").isNotNull()).select(
        blank("userId").alias("user_id"), blank("fingerprintId").alias("fingerprint_id"), F.col("eventType").alias("event_type"),
        domain.client_ip(F.col("forwarded")).alias("ip_address"), blank("pagePath").alias("page_path"), "metadata",
        F.col("ts").alias("created_at"))
    if places is None:
        return rows
    known = places.filter(~domain.is_private_ip(F.col("ip_address")))
    return rows.join(known, "ip_address", "left")


def daily_counts(events: DataFrame, late: str = "1 hour", offset: str = "18 hours 30 minutes") -> DataFrame:
    """Events per local day and type, kept up to date; ``offset`` is where the local day starts in UTC."""
    day = F.window("created_at", "1 day", startTime=offset)
    return events.withWatermark("created_at", late).groupBy(day.alias("_w"), "event_type") \
        .agg(F.count(F.lit(1)).alias("events")) \
        .select(F.date_format(F.col("_w.end") - F.expr("INTERVAL '1' SECOND"), "yyyy-MM-dd").alias("day"), "event_type", "events")


# ------------------------------------------------------------------ live timeline

SLOT = "15 minutes"


def first_seen(profiles: DataFrame) -> DataFrame:
    """Each user's sign-up once, however often the profile is saved; the state is one id per user."""
    return profiles.select("id", "created_at").dropDuplicates(["id"])


def live_timeline(signups: DataFrame, projects: DataFrame, payments: DataFrame, late: str = "1 hour") -> DataFrame:
    """Sign-ups, projects and paise per quarter of an hour, kept up to date from three streams.

    Each stream has its own watermark, and the least of them decides when a slot is closed and its state goes, so a slow stream loses
    nothing. Every zone's day begins at a slot's edge; ``timeline_days`` adds the slots up.
    """
    def part(rows: DataFrame, users=0, projects=0, paise=0) -> DataFrame:
        value = lambda v: (v if not isinstance(v, int) else F.lit(v)).cast("long")
        return rows.withWatermark("created_at", late).select(
            "created_at", value(users).alias("new_users"), value(projects).alias("new_projects"), value(paise).alias("revenue_paise"))

    every = part(signups, users=1).unionByName(part(projects, projects=1)).unionByName(part(payments, paise=F.coalesce(F.col("amount_paise"), F.lit(0))))
    slots = every.groupBy(F.window("created_at", SLOT).alias("_w")).agg(*[F.sum(c).alias(c) for c in ("new_users", "new_projects", "revenue_paise")])
    return slots.select(F.col("_w.start").alias("slot"), "new_users", "new_projects", "revenue_paise")


def timeline_days(slots: DataFrame, tz: str = "Asia/Kolkata") -> DataFrame:
    """Slots by the days of a named zone; days without rows are absent."""
    day = F.date_format(F.from_utc_timestamp("slot", tz), "yyyy-MM-dd")
    return slots.groupBy(day.alias("day")).agg(*[F.sum(c).alias(c) for c in ("new_users", "new_projects", "revenue_paise")])
