"""Folds along an order per key: steps that need their own previous result.

A key that fits a task is folded there in one pass.  A larger key is cut into
ordered chunks; all chunks are folded at once from a guessed state, then chunks
whose true entry state differs are folded again, until no entry state changes.
The recorder's folds forget their start, so a few rounds suffice, and the result
is that of one sequential pass.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockwalk.functions.geo import EARTH_RADIUS_M
from blockwalk.operators.lineage import cut, spread
from blockwalk.operators.ordered import TASK_ROWS, Ordered

Step = Callable[[tuple, pd.DataFrame], tuple[tuple, pd.DataFrame]]

# Process noise, start variance and fallback measurement noise of the filter.
PROCESS_NOISE = 0.0005
START_VARIANCE = 1.0
FALLBACK_NOISE = 0.0005


def kalman_walk(state: tuple, lats: list, lngs: list, accuracies: list) -> tuple[tuple, list, list]:
    """Filter positions in order.  State: (variance, lat, lng); both axes share the variance."""
    p, y, x = state
    ys, xs = [], []
    for lat, lng, acc in zip(lats, lngs, accuracies, strict=True):
        p += PROCESS_NOISE
        r = acc * acc / 10 if acc == acc and acc else FALLBACK_NOISE
        gain = p / (p + r)
        y = lat if y == 0 else y + gain * (lat - y)
        x = lng if x == 0 else x + gain * (lng - x)
        p *= 1 - gain
        ys.append(y)
        xs.append(x)
    return (p, y, x), ys, xs


def kalman_step(state: tuple, pdf: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
    """Filter fixes in order, see :func:`kalman_walk`."""
    state, ys, xs = kalman_walk(state, *(pdf[c].to_numpy(float).tolist() for c in ("lat", "lng", "accuracy")))
    return state, pdf.assign(lat=ys, lng=xs)


KALMAN_START = (START_VARIANCE, 0.0, 0.0)


def metres(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 \
        + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(math.sqrt(min(1.0, h)))


def thin_walk(state: tuple, gap: float, lats: list, lngs: list, out_lats: list, out_lngs: list) -> tuple[tuple, list]:
    """Which positions lie at least ``gap`` metres from the last kept output position.  State: (lat, lng), NaN before any."""
    y, x = state
    keep = []
    for lat, lng, oy, ox in zip(lats, lngs, out_lats, out_lngs, strict=True):
        ok = y != y or not metres(y, x, lat, lng) < gap
        keep.append(ok)
        if ok:
            y, x = oy, ox
    return (y, x), keep


def thin_step(gap: float) -> Step:
    """Keep rows by :func:`thin_walk`."""
    def step(state, pdf):
        state, keep = thin_walk(state, gap, *(pdf[c].to_numpy(float).tolist() for c in ("lat", "lng", "out_lat", "out_lng")))
        return state, pdf[np.array(keep, dtype=bool)]

    return step


def kalman(fixes: DataFrame, keys: list[str], order: list[str], limit: int = TASK_ROWS) -> DataFrame:
    return fold(fixes, keys, order, kalman_step, KALMAN_START, limit, 1e-13)


def thin_path(points: DataFrame, keys: list[str], order: list[str], gap: float, limit: int = TASK_ROWS,
              count_on: DataFrame | None = None) -> DataFrame:
    return fold(points, keys, order, thin_step(gap), (float("nan"), float("nan")), limit, 0.0, count_on)


def fold(df: DataFrame, keys: list[str], order: list[str], step: Step, start: tuple, limit: int, tolerance: float,
         count_on: DataFrame | None = None) -> DataFrame:
    """Apply ``step`` along the order of each key; the output keeps the input columns."""
    ordered = Ordered.of(df, keys, [F.col(c) for c in order], limit, count_on)
    schema = df.schema
    if not ordered.split:
        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            return step(start, pdf.sort_values(order, kind="stable"))[1]

        return spread(df, *keys).groupBy(*keys).applyInPandas(whole, schema)

    rows = cut(ordered.df)
    chunk = [*keys, "_chunk"]
    names = [f"_s{i}" for i in range(len(start))]
    key_fields = [rows.schema[k] for k in chunk]
    state_schema = T.StructType(key_fields + [T.StructField(n, T.DoubleType()) for n in names])

    def leave(pdf: pd.DataFrame) -> pd.DataFrame:
        entry = tuple(float("nan") if v is None else float(v) for v in pdf[names].iloc[0])
        out, _ = step(entry, pdf.sort_values(order, kind="stable"))
        return pd.DataFrame([[*pdf[chunk].iloc[0], *out]], columns=[*chunk, *names])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        entry = tuple(float("nan") if v is None else float(v) for v in pdf[names].iloc[0])
        return step(entry, pdf.sort_values(order, kind="stable"))[1][schema.names]

    entries = cut(rows.select(*chunk).distinct().select(*chunk, *[F.lit(float(v)).alias(n) for n, v in zip(names, start)]))
    todo, exits = entries, None
    while True:
        done = rows.join(todo, chunk).groupBy(*chunk).applyInPandas(leave, state_schema)
        exits = cut(done if exits is None else exits.join(todo, chunk, "left_anti").unionByName(done))
        prior = Window.partitionBy(*keys).orderBy("_chunk")
        fresh = exits.select(*chunk, *[F.lag(n).over(prior).alias(n) for n in names]).filter(F.col("_chunk") > 0)
        was = entries.withColumnsRenamed({n: f"{n}_was" for n in names})
        moved = F.lit(False)
        for n in names:
            same = F.col(n).eqNullSafe(F.col(f"{n}_was")) | (F.abs(F.col(n) - F.col(f"{n}_was")) <= tolerance)
            moved = moved | ~F.coalesce(same, F.lit(False))
        todo = cut(fresh.join(was, chunk).filter(moved).select(*chunk, *names))
        if todo.isEmpty():
            break
        entries = cut(entries.join(todo, chunk, "left_anti").unionByName(todo))
    return rows.join(entries, chunk).groupBy(*chunk).applyInPandas(run, schema)


def carry_forward(df: DataFrame, keys: list[str], order: list[str], columns: list[str], limit: int = TASK_ROWS) -> DataFrame:
    """Fill nulls of ``columns`` with the last value before them in the order of the key."""
    ordered = Ordered.of(df, keys, [F.col(c) for c in order], limit)
    w = ordered._window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = {c: F.last(c, ignorenulls=True).over(w) for c in columns}
    if not ordered.split:
        return df.withColumns(here)
    rows = ordered.df
    tails = rows.groupBy(*keys, "_chunk").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_rn"))).alias(f"_p_{c}") for c in columns])
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    tails = tails.select(*keys, "_chunk", *[F.last(f"_p_{c}", ignorenulls=True).over(before).alias(f"_q_{c}") for c in columns])
    out = rows.withColumns(here).join(tails, [*keys, "_chunk"])
    return out.withColumns({c: F.coalesce(c, f"_q_{c}") for c in columns}).select(*df.columns)
