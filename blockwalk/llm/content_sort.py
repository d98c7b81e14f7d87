"""Exact dedup by content sort.

Normalised texts are range-partitioned by sampled splitters, sorted externally inside
each partition, and neighbours are compared in full: rows whose whole text equals the row
before belong to one group, and the smallest id stays.

* Splitters are the first 64 characters, a 64-bit hash and a salt, so what the sampler sends
  to the driver is bounded however long the texts are. Order and equality use the whole text.
* A text that makes up more than 1/1000 of all rows is hot; there are fewer than 1000 of those,
  so they may be broadcast. Their rows are salted over ``SALTS`` ranges by id. Each range finds its
  own head, and the heads of one text (at most ``SALTS``) are compared in full and merged.

Cases: a null text counts as empty; an empty table gives no rows; repeated rows (same id and text)
form a group of which one row is kept; null ids sort last and are kept only where a group has no other id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockwalk.llm.common import cut, free_name, squeezed, texts

HOT_SHARE = 1000
SALTS = 64


def exact_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``."""
    rows = texts(docs).select("doc_id", squeezed(F.col("text")).alias("body"))
    rows = rows.withColumn("h", F.xxhash64("body"))
    total = docs.count()
    hot = (rows.groupBy("h").agg(F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("n") * HOT_SHARE > total))
           .select("h", F.lit(True).alias("hot")))
    salted = rows.join(F.broadcast(hot), "h", "left").select(
        "doc_id", "body", "h", F.substring("body", 1, 64).alias("head"), F.coalesce("hot", F.lit(False)).alias("hot"),
        F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(F.lit(0)).alias("salt"))
    keys = ["head", "h", "salt", "body"]
    ordered = (salted.repartitionByRange("head", "h", "salt")
               .sortWithinPartitions(*keys, F.col("doc_id").asc_nulls_last()))
    run = Window.partitionBy(*keys)
    place = F.row_number().over(run.orderBy(F.col("doc_id").asc_nulls_last()))
    local = ordered.select(
        "doc_id", "hot", F.min("doc_id").over(run).alias("first_id"), F.count("*").over(run).alias("n"),
        place.alias("place"), F.sha2("body", 256).alias("text_sha256"),
        F.when(F.col("hot") & (place == 1), F.col("body")).alias("hot_body"))
    local = cut(local)
    merged = (local.where(F.col("hot_body").isNotNull()).groupBy("hot_body")
              .agg(F.min("first_id").alias("all_first"), F.sum("n").alias("all_n"), F.first("text_sha256").alias("text_sha256"))
              .drop("hot_body"))
    keep = F.coalesce("all_first", "first_id")
    return local.join(F.broadcast(merged), "text_sha256", "left").select(
        "doc_id", keep.alias("keep_id"), F.coalesce("all_n", "n").alias("group_size"),
        ((F.col("place") == 1) & F.col("doc_id").eqNullSafe(keep)).alias("kept"), "text_sha256")


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with its own columns.

    Rows are told apart by id and text together, so an id, or no id, may stand on several texts. Two rows with one id
    and one text are the same row: one of them stays.
    """
    key = free_name(docs, "text_sha256")
    rows = docs.withColumn(key, F.sha2(squeezed(F.coalesce(F.col("text"), F.lit(""))), 256))
    gone = exact_groups(docs).where(~F.col("kept")).select(F.col("doc_id").alias("id"), "keep_id", "text_sha256")
    same = F.col("l.doc_id").eqNullSafe(F.col("r.id")) & (F.col(f"l.{key}") == F.col("r.text_sha256"))
    again = gone.where(F.col("id").eqNullSafe(F.col("keep_id"))).select("id", "text_sha256").distinct()
    once = rows.alias("l").join(gone.where(~F.col("id").eqNullSafe(F.col("keep_id"))).alias("r"), same, "left_anti")
    twice = once.alias("l").join(again.alias("r"), same, "left_semi").dropDuplicates(["doc_id", key])
    return once.alias("l").join(again.alias("r"), same, "left_anti").unionByName(twice).drop(key)
