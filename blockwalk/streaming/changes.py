"""Change streams: payment callbacks, donation announcements, document saves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockwalk.functions import domain
from blockwalk.operators.accounts import paid_transitions
from blockwalk.operators.lineage import cut
from blockwalk.sources.changelog import KeyedLog, changed_rows
from blockwalk.sources.tables import merge_latest
from blockwalk.streaming.sinks import newest_rows, start

#: The own key of each settled table.
IDS = {"donations": "id", "live_exports": "session_id", "projects": "id"}

# What a callback type means, and the images granted by a payment.
SUCCESS = "PAYMENT_SUCCESS_WEBHOOK"
FAILED = "PAYMENT_FAILED_WEBHOOK"
DROPPED = ["ORDER_EXPIRED_WEBHOOK", "PAYMENT_USER_DROPPED_WEBHOOK"]
LIVE_IMAGES = 6
MAP_IMAGES = 5


def distinct_callbacks(callbacks: DataFrame, late: str = "1 day") -> DataFrame:
    """At-least-once delivery made once: one callback per order and type within the watermark."""
    return callbacks.withWatermark("ts", late).dropDuplicatesWithinWatermark(["order_id", "type"])


def settle(callbacks: DataFrame, donations: DataFrame, live_exports: DataFrame, projects: DataFrame) -> dict[str, DataFrame]:
    """Apply a set of callbacks; applying it again changes nothing.

    Success pays a donation, a live session (and sets its images to 6), or a map
    (5 more images, once); a live top-up adds 6 images and marks the order
    processed.  Failed and dropped callbacks only touch donations.
    """
    kinds = F.when(F.col("type") == SUCCESS, "paid").when(F.col("type") == FAILED, "failed") \
        .when(F.col("type").isin(DROPPED), "abandoned")
    # map-side combined per order: the last word, and whether it ever succeeded
    last = callbacks.withColumn("_k", kinds).filter("_k IS NOT NULL").groupBy(F.col("order_id").alias("payment_id")).agg(
        F.max_by("_k", F.col("ts")).alias("_last"), F.bool_or(F.col("_k") == "paid").alias("_ok"),
        F.first(domain.order_route(F.col("order_id"))).alias("_route"))
    of = lambda route: last.filter(F.col("_route") == route).drop("_route")
    don = donations.join(of("donation"), "payment_id", "left").withColumns({
        "is_paid": F.when(F.coalesce("_ok", F.lit(False)), True).otherwise(F.col("is_paid")),
        "payment_status": F.coalesce("_last", "payment_status")}).select(*donations.columns)
    paid_now = F.coalesce("_ok", F.lit(False)) & (F.col("payment_status") != "paid")
    live = live_exports.join(of("live_session"), "payment_id", "left") \
        .withColumns({"regen_allowance": F.when(paid_now, LIVE_IMAGES).otherwise(F.col("regen_allowance")),
                      "payment_status": F.when(paid_now, "paid").otherwise(F.col("payment_status"))}).select(*live_exports.columns)
    top_up = F.coalesce("_ok", F.lit(False))  # a processed order no longer carries the plain order id
    live = live.join(of("live_regen"), "payment_id", "left").withColumns({
        "regen_allowance": F.col("regen_allowance") + F.when(top_up, LIVE_IMAGES).otherwise(0),
        "payment_id": F.when(top_up, F.concat(F.lit("processed_"), F.col("payment_id"))).otherwise(F.col("payment_id"))}) \
        .select(*live_exports.columns)
    maps = projects.join(of("map"), "payment_id", "left").withColumns({
        "regen_allowance": F.col("regen_allowance") + F.when(paid_now, MAP_IMAGES).otherwise(0),
        "payment_status": F.when(paid_now, "paid").otherwise(F.col("payment_status"))}).select(*projects.columns)
    return {"donations": don, "live_exports": live, "projects": maps}


def settle_stream(callbacks: DataFrame, tables: dict[str, KeyedLog], checkpoint: str, interval: str | None = None):
    """Keep the three tables settled from a callback stream.

    Each table is keyed by ``order_id``, the payment id that the order was made with. A batch reads the rows of its orders and logs those
    that it changes.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        batch = cut(batch)
        now = {name: cut(t.lookup(batch, batch_id)) for name, t in tables.items()}
        out = settle(batch, **{name: rows.drop("order_id") for name, rows in now.items()})
        for name, rows in out.items():
            key = now[name].select("order_id", F.col(IDS[name]))
            tables[name].append(changed_rows(now[name], rows.join(key, IDS[name]).select(*now[name].columns)), batch_id)

    return start(distinct_callbacks(callbacks), checkpoint, each, interval=interval)


def announce(versions: DataFrame, before: DataFrame) -> DataFrame:
    """(id, version, name, amount, note) of the versions that make a donation paid, by its last state in ``before`` (id, is_paid)."""
    last = before.select("id", F.lit(-1).cast("long").alias("version"), "is_paid")
    rows = versions.select("id", "version", "is_paid", "name", "amount", "note").unionByName(last, allowMissingColumns=True)
    paid = F.coalesce("is_paid", F.lit(False))
    was = F.coalesce(F.lag(paid).over(Window.partitionBy("id").orderBy("version")), F.lit(False))
    return rows.withColumn("_new", paid & ~was).filter("_new AND version >= 0").select("id", "version", "name", "amount", "note")


def announce_stream(versions: DataFrame, paid: KeyedLog, folder: str, checkpoint: str, interval: str | None = None):
    """Write the announcements of each micro-batch to ``folder``, one per change to paid.

    What a donation was before is read from ``paid`` (id, is_paid), a keyed log: the stream holds no state of its own, a donation that was
    paid in the stored table is not announced again however long ago that was, and a replayed batch sees what it saw.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        batch = cut(batch)
        before = cut(paid.lookup(batch, batch_id))
        announce(batch, before).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
        paid.append(changed_rows(before, newest_rows(batch, "id", ["version"]).select("id", "is_paid")), batch_id)

    return start(versions, checkpoint, each, interval=interval)


def save_documents(saves: DataFrame, table: KeyedLog, checkpoint: str, interval: str | None = "2 seconds"):
    """Store the last save of every project per micro-batch (``id``, ``data``, ``updated_at``); a null keeps what was stored."""
    def each(batch: DataFrame, batch_id: int) -> None:
        last = cut(newest_rows(batch, "id", ["updated_at"]))
        now = cut(table.lookup(last, batch_id))
        table.append(changed_rows(now, merge_latest(now, last, ["id"])), batch_id)

    return start(saves, checkpoint, each, interval=interval)


__all__ = ["announce", "announce_stream", "distinct_callbacks", "paid_transitions", "save_documents", "settle", "settle_stream"]
