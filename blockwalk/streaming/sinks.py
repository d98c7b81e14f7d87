"""Micro-batch sinks that give the same table when a batch is replayed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def start(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append",
          interval: str | None = None) -> StreamingQuery:
    """Run ``each`` per micro-batch; without an interval the available input is drained once."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each)
    return writer.trigger(processingTime=interval).start() if interval else writer.trigger(availableNow=True).start()


def batch_folder(path: str) -> Callable[[DataFrame, int], None]:
    """Write each micro-batch to its own folder; a replay overwrites it."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def drain(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Process the available input into ``folder`` and return the stored rows (column ``batch`` added)."""
    start(stream, f"{folder}/checkpoint", batch_folder(f"{folder}/rows"), mode).awaitTermination()
    return stream.sparkSession.read.option("basePath", f"{folder}/rows").parquet(f"{folder}/rows/batch=*")


def relay(stream: DataFrame, folder: str, interval: str | None = None) -> DataFrame:
    """Store an appending stream with Spark's exactly-once file sink and read it on as a stream, for a step with a state of its own.

    Without an interval the available input is stored before the next step begins; with one both queries run side by side.
    """
    spark = stream.sparkSession
    writer = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint")
    if interval:
        writer.trigger(processingTime=interval).start()
    else:
        writer.trigger(availableNow=True).start().awaitTermination()
    return spark.readStream.schema(stream.schema).parquet(f"{folder}/rows")


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Last stored version of every key of an updating result."""
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")


def newest_rows(batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Last row per key of a micro-batch (last write wins), by a map-side combined maximum."""
    rest = [c for c in batch.columns if c != key]
    return batch.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")
