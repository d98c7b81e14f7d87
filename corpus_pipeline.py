"""Corpus pipeline: quality rules, exact dedup, near dedup, secret masking, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared folder and
reads it back for the next stage. All but the last return the columns of ``documents``.

* ``quality``: documents that fail the base rules or sit on a failed host go.
* ``exact``: of equal texts (white space normalised) the smallest id stays.
* ``near``: of each group linked by a 5-word-shingle Jaccard of 0.8 or more, the smallest id stays.
* ``secrets``: secrets are masked in place; no document goes.
* ``packing``: the token pieces and their places in sequences of at most 2048 tokens.

Rows are told apart by id and text: a missing id, or one that stands on several texts, takes no other row with it.

Cases: null texts fail the quality rules; empty tables pass through as empty; repeated rows collapse in ``exact``; extra columns are kept
until packing.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from blockwalk.llm import best_fit, content_sort, host_rules, jaccard_pruning, secret_ledger
from blockwalk.operators.lineage import checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return host_rules.kept_rows(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return content_sort.kept_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_pruning.kept_rows(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_ledger.redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("secrets", secrets), ("packing", packing)]

#: The packing stage has no SQL form; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
