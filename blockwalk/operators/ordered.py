"""Ordered analytics per key that survive a key holding a large share of the rows.

A plain window sorts a whole key in one task.  :class:`Ordered` first counts
rows per key (map-side combined, key columns only).  While every key fits into
one task it uses plain windows: one exchange on the key.  When some keys do not
fit, their rows - and only theirs - are range-partitioned on (key, order), numbered
from per-partition counts, and cut into chunks of bounded size; windows then run
per (key, chunk), with a few rows of overlap where a frame needs its neighbours,
and running sums add the totals of the chunks before.  Results are identical.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from blockwalk.operators.lineage import cut

#: Rows of one key that a single task may hold.
TASK_ROWS = 1_000_000


def hot_keys(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """Keys with more than ``limit`` rows; at most ``rows / limit`` of them exist."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)


def any_hot(df: DataFrame, keys: Sequence[str], limit: int) -> bool:
    return not hot_keys(df, keys, limit).isEmpty()


@dataclass(frozen=True)
class Ordered:
    """Rows with an order per key.  ``order`` must be total (end it with an id)."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[Column, ...]
    split: bool = False
    chunk_rows: int = TASK_ROWS

    @staticmethod
    def of(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int = TASK_ROWS,
           count_on: DataFrame | None = None) -> "Ordered":
        """``count_on`` may name a cheaper table holding at least the same rows per key."""
        keys, order = tuple(keys), tuple(order)
        if count_on is not None and not any_hot(count_on, keys, limit):
            return Ordered(df, keys, order)
        hot = hot_keys(df, keys, limit)
        total = hot.agg(F.sum("_n")).first()[0]
        if total is None:
            return Ordered(df, keys, order)
        return Ordered(_number_hot(df, hot.drop("_n"), keys, order, limit, total), keys, order, True, limit)

    # -- windows ---------------------------------------------------------

    def _window(self) -> WindowSpec:
        parts = [*self.keys, "_chunk"] if self.split else list(self.keys)
        return Window.partitionBy(*parts).orderBy(*self.order)

    def frame(self, before: int = 0, after: int = 0, **columns: Callable[[WindowSpec], Column]) -> "Ordered":
        """Add columns computed over windows reaching ``before``/``after`` rows away."""
        if not self.split:
            w = self._window()
            return replace(self, df=self.df.withColumns({n: f(w) for n, f in columns.items()}))
        at = (F.col("_rn") - 1) % self.chunk_rows
        copies = F.array_compact(F.array(
            F.struct(F.col("_chunk").alias("c"), F.lit(True).alias("own")),
            F.when(at >= self.chunk_rows - before, F.struct((F.col("_chunk") + 1).alias("c"), F.lit(False).alias("own"))),
            F.when((at < after) & (F.col("_chunk") > 0),
                   F.struct((F.col("_chunk") - 1).alias("c"), F.lit(False).alias("own"))))) \
            if before or after else None
        if copies is None:
            w = self._window()
            return replace(self, df=self.df.withColumns({n: f(w) for n, f in columns.items()}))
        wide = self.df.withColumn("_copy", F.explode(copies)) \
            .withColumns({"_chunk": F.col("_copy.c"), "_own": F.col("_copy.own")}).drop("_copy")
        w = self._window()
        out = wide.withColumns({n: f(w) for n, f in columns.items()}).filter("_own").drop("_own")
        return replace(self, df=out)

    def lag(self, **columns: str) -> "Ordered":
        return self.frame(before=1, **{n: (lambda w, c=c: F.lag(c).over(w)) for n, c in columns.items()})

    def lead(self, **columns: str) -> "Ordered":
        return self.frame(after=1, **{n: (lambda w, c=c: F.lead(c).over(w)) for n, c in columns.items()})

    # -- numbering and running totals --------------------------------------

    def row_number(self, name: str) -> "Ordered":
        if not self.split:
            return replace(self, df=self.df.withColumn(name, F.row_number().over(self._window()).cast("long")))
        return replace(self, df=self.df.withColumn(name, F.col("_rn")))

    def running(self, exclusive: bool = False, **columns: str) -> "Ordered":
        """Running sums from the first row of the key, with or without the current row."""
        w = self._window().rowsBetween(Window.unboundedPreceding, -1 if exclusive else Window.currentRow)
        here = {n: F.coalesce(F.sum(c).over(w), F.lit(0)) for n, c in columns.items()}
        if not self.split:
            return replace(self, df=self.df.withColumns(here))
        sums = self.df.groupBy(*self.keys, "_chunk").agg(
            *[F.coalesce(F.sum(c), F.lit(0)).alias(f"_t_{n}") for n, c in columns.items()])
        prior = Window.partitionBy(*self.keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        base = sums.select(*self.keys, "_chunk", *[
            F.coalesce(F.sum(f"_t_{n}").over(prior), F.lit(0)).alias(f"_b_{n}") for n in columns])
        out = self.df.withColumns(here).join(base, [*self.keys, "_chunk"])
        out = out.withColumns({n: F.col(n) + F.col(f"_b_{n}") for n in columns}).drop(*[f"_b_{n}" for n in columns])
        return replace(self, df=out)

    def rows(self) -> DataFrame:
        return self.df.drop("_rn", "_chunk")


def _number_hot(df: DataFrame, hot: DataFrame, keys, order, limit: int, total: int) -> DataFrame:
    """Add ``_rn`` and ``_chunk``; rows of keys that fit get chunk 0."""
    marked = df.join(hot.withColumn("_hot", F.lit(True)), list(keys), "left")
    small = marked.filter(F.col("_hot").isNull()).drop("_hot") \
        .withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    parts = int(min(100_000, 2 + 2 * total // limit))
    ranged = marked.filter("_hot").drop("_hot").repartitionByRange(parts, *keys, *order) \
        .withColumn("_pid", F.spark_partition_id())
    # The partition id must not change between its two uses, so the rows are stored.
    ranged = cut(ranged)
    prior = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy(*keys, "_pid").agg(F.count(F.lit(1)).alias("_n")) \
        .withColumn("_base", F.coalesce(F.sum("_n").over(prior), F.lit(0))).drop("_n")
    local = Window.partitionBy(*keys, "_pid").orderBy(*order)
    large = ranged.join(base, [*keys, "_pid"]) \
        .withColumn("_rn", F.row_number().over(local) + F.col("_base")).drop("_pid", "_base")
    return small.unionByName(large) \
        .withColumn("_chunk", F.when(F.col("_rn") <= limit, F.lit(0).cast("long"))
                    .otherwise(F.floor((F.col("_rn") - 1) / F.lit(limit)).cast("long")))


def nth_values(rows: Ordered, value: str, position: Column, name: str) -> DataFrame:
    """One row per key: the value at a 1-based position computed from the key's row count ``n``."""
    numbered = rows.row_number("_at").df
    sizes = numbered.groupBy(*rows.keys).agg(F.count(F.lit(1)).alias("n")) \
        .withColumn("_pos", position.cast("long")).drop("n")
    return numbered.join(sizes, list(rows.keys)).filter(F.col("_at") == F.col("_pos")) \
        .select(*rows.keys, F.col(value).alias(name))
