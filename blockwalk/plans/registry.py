"""All registered queries, collected from the plan modules."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ["analytics", "geometry", "features", "spatial", "tracks", "layouts", "desk", "streams"]


def _modules():
    return [importlib.import_module(f"blockwalk.plans.{m}") for m in MODULES]


def prepared(run: Callable) -> Callable[[SparkSession, str], DataFrame]:
    """Pin the session time zone, which every timestamp in the given tables assumes."""
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return run(spark, sf_dir)

    call.__name__ = getattr(run, "__name__", "query")
    return call


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: prepared(run) for m in _modules() for name, run in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in _modules() for name, text in m.CHECKS.items()}
