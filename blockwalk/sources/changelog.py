"""Keyed tables that grow by changes: what a batch writes and reads is bounded by the batch and the buckets of its keys.

A table has a base and a log, both laid out by a hash of the key. A batch appends its changed rows to a folder of its own, so writing it
again replaces it; the row of a key is its newest version over base and log. ``lookup`` reads the buckets of the keys asked for, ``compact``
rewrites only buckets that have changed, and later reads skip the batches it has taken in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockwalk.operators.lineage import cut
from blockwalk.sources.tables import BUCKET_ROWS

BASE = -1


class KeyedLog:
    """Rows of one schema by ``keys``. Batches are numbered from 0 by the caller, as a stream's micro-batches are."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path, keys

    def create(self, df: DataFrame, bucket_rows: int = BUCKET_ROWS) -> KeyedLog:
        """Lay the first rows out in buckets of about ``bucket_rows``; the number of buckets stays."""
        buckets = max(1, -(-df.count() // bucket_rows))
        rows = df.withColumns({"_batch": F.lit(BASE).cast("long"), "bucket": self._bucket(buckets)})
        rows.repartition(buckets, "bucket").write.partitionBy("bucket").parquet(f"{self.path}/base")
        df.limit(0).write.parquet(f"{self.path}/schema")
        rows.limit(0).withColumn("batch", F.lit(0).cast("long")).write.partitionBy("batch", "bucket").parquet(f"{self.path}/log")
        self.spark.createDataFrame([(buckets, BASE)], "buckets int, upto long").write.parquet(f"{self.path}/state")
        return self

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int")

    def _state(self) -> tuple[int, int]:
        """The number of buckets, and the last batch that the base holds: one row per compaction."""
        r = self.spark.read.parquet(f"{self.path}/state").agg(F.max("buckets").alias("n"), F.max("upto").alias("upto")).first()
        return r["n"], r["upto"]

    def _stored(self, part: str, *folders: T.StructField) -> DataFrame:
        fields = self.spark.read.parquet(f"{self.path}/schema").schema.fields
        return self.spark.read.schema(T.StructType([*fields, T.StructField("_batch", T.LongType()), *folders])).parquet(f"{self.path}/{part}")

    def _log(self) -> DataFrame:
        return self._stored("log", T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType()))

    def _versions(self, below: int | None, buckets: list[int] | None) -> DataFrame:
        _, upto = self._state()
        log = self._log().filter(F.col("batch") > upto)
        if below is not None:
            log = log.filter(F.col("batch") < below)
        rows = self._stored("base", T.StructField("bucket", T.IntegerType())).unionByName(log.drop("batch"))
        return rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*self.keys, "bucket")]
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r")).select(*self.keys, "_r.*")

    def read(self, below: int | None = None) -> DataFrame:
        """The newest version of every key, as of before the batch ``below`` if one is named."""
        return self._newest(self._versions(below, None)).drop("_batch")

    def lookup(self, asked: DataFrame, below: int | None = None) -> DataFrame:
        """The newest versions of the keys in ``asked``: only their buckets are read."""
        n, _ = self._state()
        own = cut(asked.select(*self.keys).distinct())
        buckets = [r["b"] for r in own.select(self._bucket(n).alias("b")).distinct().collect()]  # at most the number of buckets
        rows = self._versions(below, buckets).join(own, self.keys, "left_semi")
        return self._newest(rows).drop("_batch")

    def append(self, changed: DataFrame, batch: int) -> None:
        """Store a batch's changed rows; the same batch again takes the place of what it wrote before."""
        n, _ = self._state()
        changed.withColumns({"_batch": F.lit(batch).cast("long"), "bucket": self._bucket(n)}) \
            .write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/log/batch={batch}")

    def compact(self, upto: int) -> list[int]:
        """Take the batches up to this one into the base; only buckets with changes are rewritten. Returns them.

        A reader sees each bucket before or after; the state row that lets reads skip the batches is written last.
        """
        n, before = self._state()
        changed = self._log().filter((F.col("batch") > before) & (F.col("batch") <= upto))
        buckets = sorted(r["bucket"] for r in changed.select("bucket").distinct().collect())
        if buckets:
            rows = cut(self._newest(self._versions(upto + 1, buckets)).withColumn("bucket", self._bucket(n)))
            rows.repartition(len(buckets), "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
                .partitionBy("bucket").parquet(f"{self.path}/base")
            self.spark.createDataFrame([(n, upto)], "buckets int, upto long").write.mode("append").parquet(f"{self.path}/state")
        return buckets


def changed_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of ``after`` that differ from those of ``before``, nulls being equal to nulls."""
    return after.exceptAll(before.select(*after.columns))
