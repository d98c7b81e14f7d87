"""What the operators share: clean input columns, folds by hash, bounded settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwalk.operators.lineage import cut
from blockwalk.ship import ship

#: The white space that separates words, as a character class for Java, RE2 and Python patterns alike.
SPACE = r"\x20\x09-\x0D"

#: A run of white space that is not already one plain space.
_UNEVEN = r" [\x20\x09-\x0D]+|[\x09-\x0D][\x20\x09-\x0D]*"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``text`` (null becomes empty) and the named columns; whatever else the table holds is left out."""
    ship(docs.sparkSession)
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def squeezed(text: Column) -> Column:
    """Each run of white space becomes one space. Only runs that need it are matched, so most text is copied once."""
    return F.regexp_replace(text, _UNEVEN, " ")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's digits modulo ``parts``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def in_fold(doc_id: Column, parts: int, which: int) -> Column:
    return F.coalesce(fold(doc_id, parts) == which, F.lit(False))


def free_name(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have yet."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


__all__ = ["SPACE", "cut", "fold", "free_name", "in_fold", "partitions", "squeezed", "table", "texts"]
