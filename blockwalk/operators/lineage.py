"""Cutting lineage between rounds, and spreading compute-heavy groups over the cluster."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame

from blockwalk.ship import ship


def checkpoint_dir(spark) -> str:
    """The cluster's shared checkpoint folder; a private one only in local mode, where none is named."""
    context = spark.sparkContext
    named = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.mkdtemp(prefix="spark-"), "checkpoints")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later jobs read the stored rows, on any executor."""
    ship(df.sparkSession)
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by keys into the session's shuffle partitions.

    Adaptive execution merges partitions by their bytes; rows that are few but
    expensive (grid generation, per-group walks) would all land in one task.
    A stated partition count is left alone.
    """
    ship(df.sparkSession)
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
