"""Live survey sessions: one state per session, fed by fixes as they arrive."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from blockwalk.functions.geo import TURF_RADIUS_M
from blockwalk.operators import assign, folds, trajectory
from blockwalk.operators.lineage import cut
from blockwalk.ship import ship

OUTPUT = T.StructType([
    T.StructField("session_id", T.LongType()), T.StructField("point_id", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("lat", T.DoubleType()), T.StructField("lng", T.DoubleType()), T.StructField("accuracy", T.DoubleType()),
    T.StructField("speed", T.DoubleType()), T.StructField("path_index", T.LongType())])
#: Filter variance and position, last kept position, kept count, the last four smoothed fixes.
STATE = T.StructType([
    *[T.StructField(n, T.DoubleType()) for n in ("variance", "lat", "lng", "kept_lat", "kept_lng")],
    T.StructField("kept", T.LongType()), T.StructField("ys", T.ArrayType(T.DoubleType())), T.StructField("xs", T.ArrayType(T.DoubleType()))])
START = (*folds.KALMAN_START, float("nan"), float("nan"), 0, [], [])


def _still(ys: list, xs: list) -> bool:
    """Five smoothed fixes all within a metre of their mean."""
    if len(ys) < 5:
        return False
    cy, cx = sum(ys) / 5, sum(xs) / 5
    k = math.cos(math.radians(cy))

    def far(y, x):
        h = math.sin(math.radians(cy - y) / 2) ** 2 \
            + math.cos(math.radians(y)) * k * math.sin(math.radians(cx - x) / 2) ** 2
        return 2 * TURF_RADIUS_M * math.asin(math.sqrt(min(1.0, h)))

    return all(far(y, x) < trajectory.STILL_METRES for y, x in zip(ys, xs, strict=True))


def advance(state: tuple, fixes: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
    """Take fixes in the order of (ts, point_id); returns the new state and the fixes that entered the path.

    Built from the batch folds, so that stream and batch keep the same points. Lists are walked and only the path becomes a
    frame: sessions are short, and a step of pandas takes longer than their fixes.
    """
    p, y, x, ky, kx, kept, ys, xs = state
    order = np.lexsort((fixes["point_id"].to_numpy(), fixes["ts"].to_numpy()))
    raw_lats, raw_lngs, speeds, accuracies = (fixes[c].to_numpy(float)[order].tolist() for c in ("lat", "lng", "speed", "accuracy"))
    (p, y, x), lats, lngs = folds.kalman_walk((p, y, x), raw_lats, raw_lngs, accuracies)
    all_y, all_x, back = [*ys, *lats], [*xs, *lngs], len(ys)

    def recordable(i: int) -> bool:
        speed, acc = speeds[i], accuracies[i]
        speed = speed if speed == speed else 0.0
        on_foot = speed <= 4.2 and (speed > 2.0 or not acc > 20)
        at = slice(max(0, i + back - 4), i + back + 1)
        return acc <= trajectory.MAX_ACCURACY and on_foot and not _still(all_y[at], all_x[at])

    rows = [i for i in range(len(lats)) if recordable(i)]
    own = [lats[i] for i in rows], [lngs[i] for i in rows]
    (ky, kx), keep = folds.thin_walk((ky, kx), trajectory.THIN_METRES, *own, *own)
    rows = [i for i, k in zip(rows, keep, strict=True) if k]
    taken = {"lat": np.array([lats[i] for i in rows], float), "lng": np.array([lngs[i] for i in rows], float),
             "path_index": np.arange(kept + 1, kept + 1 + len(rows))}
    at = order[np.array(rows, dtype=np.int64)]
    path = pd.DataFrame({c: taken[c] if c in taken else fixes[c].to_numpy()[at] for c in OUTPUT.names})
    return (p, y, x, ky, kx, kept + len(rows), all_y[-4:], all_x[-4:]), path


def record(fixes: DataFrame, late: str = "10 minutes", idle: str = "30 minutes") -> DataFrame:
    """Path points of all live sessions.  A session silent for ``idle`` event time gives up its state."""
    ship(fixes.sparkSession)
    idle_ms = int(float(idle.split()[0]) * {"minutes": 60_000, "hours": 3_600_000, "days": 86_400_000}[idle.split()[1]])

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = tuple(state.get) if state.exists else START
        now = (*now[:6], list(now[6]), list(now[7]))
        parts = list(batches)
        pdf = parts[0] if len(parts) == 1 else pd.concat(parts)
        now, path = advance(now, pdf)
        state.update(now)
        newest = int(pdf["ts"].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + idle_ms)
        yield path

    return fixes.withWatermark("ts", late).groupBy("session_id").applyInPandasWithState(
        update, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def snap_batch(points: DataFrame, roads: DataFrame) -> DataFrame:
    """Match one micro-batch of path points to mapped roads; a point that matches none stays as it is.

    Every point is matched by itself, so neither the number of points a session has in a batch nor how the input is
    cut into batches changes a row, and none is lost. The points are stored first: they are read several times below, and
    each reading of a stateful batch would walk all its sessions again.
    """
    points = cut(points)
    near = assign.snap_points(points, roads, "session_id", "point_id")
    return points.join(near, ["session_id", "point_id"], "left").withColumns({
        "out_lat": F.coalesce("snap_lat", "lat"), "out_lng": F.coalesce("snap_lng", "lng")}).drop("snap_lat", "snap_lng")
