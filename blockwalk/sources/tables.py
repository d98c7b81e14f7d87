"""Relational and document tables: typed reads, JSON documents, keyed stores, CSV."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockwalk.functions import geo

_point = T.ArrayType(T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lng", T.DoubleType())]))

#: The parts of a project document that the jobs read; unknown members are ignored.
DOCUMENT = T.StructType([
    T.StructField("symbols", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()), T.StructField("symbol_type", T.StringType()),
        T.StructField("lat", T.DoubleType()), T.StructField("lng", T.DoubleType()),
        T.StructField("number", T.IntegerType()), T.StructField("unit_count", T.IntegerType()),
        T.StructField("label", T.StringType()), T.StructField("is_residential", T.BooleanType())]))),
    T.StructField("roads", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()), T.StructField("highway", T.StringType()),
        T.StructField("name", T.StringType()), T.StructField("coords", _point)]))),
    T.StructField("blocks", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()), T.StructField("label", T.StringType()),
        T.StructField("south", T.DoubleType()), T.StructField("north", T.DoubleType()),
        T.StructField("west", T.DoubleType()), T.StructField("east", T.DoubleType()),
        T.StructField("points", _point)]))),
    T.StructField("boundaryPins", _point), T.StructField("mode", T.StringType()),
    T.StructField("deletedUI", T.BooleanType()), T.StructField("hlbNumber", T.StringType()),
    T.StructField("district", T.StringType()), T.StructField("state", T.StringType()),
    T.StructField("numberingSystem", T.StringType())])


def read_table(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Parquet scan; the projection reaches the file reader."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_jdbc(spark: SparkSession, url: str, relation: str, key: str, bounds: tuple[int, int], parts: int) -> DataFrame:
    """The same relation from a database, read in parallel ranges of a numeric key."""
    return spark.read.format("jdbc").options(
        url=url, dbtable=relation, partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1],
        numPartitions=parts).load()


def parse_documents(documents: DataFrame) -> DataFrame:
    """Parse the ``data`` JSON; a broken document keeps its row with a null ``data``."""
    schema = T.StructType([*DOCUMENT.fields, T.StructField("_broken", T.StringType())])
    parsed = F.from_json("data", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    # bound once: copies of the parse would otherwise follow every field that is read
    return documents.withColumn("data", geo.let(parsed, lambda d: F.when(d["_broken"].isNull(), d.dropFields("_broken"))))


def explode_symbols(documents: DataFrame) -> DataFrame:
    """One row per symbol of each document; a document without symbols keeps one empty row."""
    return documents.select(F.col("id").alias("project_id"), F.posexplode_outer("data.symbols").alias("pos", "_s")) \
        .select("project_id", "pos", "_s.*")


def explode_part(documents: DataFrame, part: str) -> DataFrame:
    return documents.select(F.col("id").alias("project_id"), F.posexplode(f"data.{part}").alias("pos", "_s")) \
        .select("project_id", "pos", "_s.*")


# ------------------------------------------------------------------- stores

def merge_latest(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert by key: a changed value wins, a null in the change keeps the old value."""
    values = [c for c in current.columns if c not in keys]
    fresh = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in values if c in changes.columns])
    joined = current.join(fresh, keys, "full_outer")
    return joined.select(*keys, *[
        (F.coalesce(f"_new_{c}", c) if c in changes.columns else F.col(c)).alias(c) for c in values])


def without_keys(df: DataFrame, deleted: DataFrame, keys: list[str]) -> DataFrame:
    """Cascade delete: drop every row whose key was deleted."""
    return df.join(deleted.select(*keys).distinct(), keys, "left_anti")


def layers(current: DataFrame, new: DataFrame, keys: list[str], replace: bool) -> DataFrame:
    """Map layers after an import: appended to what is there, or in place of it for every key that the import covers."""
    kept = without_keys(current, new, keys) if replace else current
    return kept.unionByName(new)


BUCKET_ROWS = 4_000_000


def write_sessions(points: DataFrame, path: str, bucket_rows: int = BUCKET_ROWS) -> None:
    """Store fixes in hash buckets of the session, about ``bucket_rows`` fixes each, in session order inside a file.

    The number of buckets follows the data of each append and is part of the folder's name, so appends of different sizes lie
    side by side.
    """
    buckets = max(1, -(-points.count() // bucket_rows))
    points.withColumns({"buckets": F.lit(buckets), "bucket": F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int")}) \
        .repartition("bucket", F.pmod(F.xxhash64("point_id"), F.lit(8))).sortWithinPartitions("bucket", "session_id", "point_id") \
        .write.mode("append").partitionBy("buckets", "bucket").parquet(path)


def read_session(spark: SparkSession, path: str, session_id) -> DataFrame:
    """One session's fixes: folders are pruned by bucket, row groups by the session's place in the sort order."""
    stored = spark.read.parquet(path)
    own = F.pmod(F.xxhash64(F.lit(session_id).cast(stored.schema["session_id"].dataType)), F.col("buckets"))
    return stored.filter((F.col("bucket") == own) & (F.col("session_id") == session_id)).drop("buckets", "bucket")


# --------------------------------------------------------------------- CSV

def csv_field(c: Column) -> Column:
    """Quote only values holding a comma, a quote or a line break; null is empty."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(s.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def csv_lines(df: DataFrame) -> DataFrame:
    """Header and data lines (column ``line``); no line at all for an empty input."""
    body = df.select(F.concat_ws(",", *[csv_field(F.col(c)) for c in df.columns]).alias("line"))
    head = df.limit(1).select(F.lit(",".join(df.columns)).alias("line"))
    return head.unionByName(body)


def write_csv(df: DataFrame, folder: str, name: str, day: dt.date) -> str | None:
    """Write ``<name>-<day>.csv`` as part files, each with the header; nothing for an empty input."""
    if df.isEmpty():
        return None
    path = f"{folder}/{name}-{day.isoformat()}.csv"
    df.write.mode("overwrite").options(header=True, quote='"', escape='"', emptyValue="", nullValue="").csv(path)
    return path
