"""A live survey session from its first fix to its summary, as streams.

Two stateful steps, each a query of its own with a stored table between them:

* ``motion``: the filter, the last five positions and the pauses. A silence of ``idle`` ends a session; the next fix of the same id begins
  another one. A session is known by its id and its first fix (``started_at``), so no state outlives it and no number repeats.
* ``survey``: path, mapped roads, segments, return and summary. Road sides come from a static table with one row per grid cell, so a
  fix meets the roads of its own cell and nothing is kept per road. A timer in event time closes the session: its last segment and its
  summary leave the state once, and the state goes.

``matched`` is a third step over path points: it holds points back until a window of at least five is full and ``MATCH_SECONDS`` have passed, the last
point of a window beginning the next, and takes a window's road positions only if enough of its points lie on a road.

Rows of a session are taken in the order of (ts, point_id) within a batch and batches in their order, so the result does not depend on how
the input is cut as long as a session's fixes are not reordered across batches. Rows later than the watermark are dropped by Spark.
"""

from __future__ import annotations

import math
from collections import namedtuple
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from blockwalk.operators import assign, cells, folds, trajectory
from blockwalk.operators.lineage import cut
from blockwalk.ship import ship

IDLE = "30 minutes"
LATE = "10 minutes"
#: A window of points to match: at least so many, not before so many seconds, accepted from this share on a road.
MATCH_POINTS = 5
MATCH_SECONDS = 30
MATCH_CONFIDENCE = 0.6

_MS = {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}


def _ms(duration: str) -> int:
    amount, unit = duration.split()
    return int(float(amount) * _MS[unit.rstrip("s")])


def _timer(state: GroupState, us: int, silence: int) -> None:
    """Fire when the watermark has passed the moment ``us`` (microseconds) by more than the silence (milliseconds)."""
    state.setTimeoutTimestamp(max(us // 1000, state.getCurrentWatermarkMs()) + silence + 1)


class Columns(NamedTuple):
    """What a step reads of a row. Every column costs each session a fixed time on its way to Python, so numbers travel as two lists."""

    alone: tuple[str, ...]
    whole: tuple[str, ...]
    real: tuple[str, ...]

    @property
    def names(self) -> tuple[str, ...]:
        return (*self.alone, *self.whole, *self.real)

    def packed(self, rows: DataFrame, *keys: str) -> DataFrame:
        whole, real = ([F.col(c).cast(t) for c in of] for of, t in ((self.whole, "long"), (self.real, "double")))
        return rows.select(*keys, "ts", *self.alone, F.array(*whole).alias("_whole"), F.array(*real).alias("_real"))

    def ordered(self, batches: Iterator[pd.DataFrame]) -> list[list]:
        """One session's rows of a batch by (us, point_id), a list per column; sessions are short, and a step of pandas takes longer than their fixes."""
        parts = list(batches)
        rows = parts[0] if len(parts) == 1 else pd.concat(parts)
        whole, real = np.stack(rows["_whole"].to_numpy()), np.stack(rows["_real"].to_numpy())
        at = np.lexsort((rows["point_id"].to_numpy(), whole[:, self.whole.index("us")]))
        return [*[rows[c].to_numpy()[at].tolist() for c in self.alone], *whole[at].T.tolist(), *real[at].T.tolist()]


def _frame(rows: list[tuple], schema: T.StructType) -> pd.DataFrame:
    """Rows as one block of objects; typed columns of so few rows cost more to make and to put together than the rows."""
    values = np.empty((len(rows), len(schema)), object)
    for i, row in enumerate(rows):
        for j, value in enumerate(row):
            values[i, j] = value
    return pd.DataFrame(values, columns=schema.names, copy=False)


# ------------------------------------------------------------------ step one

MOTION = T.StructType([
    T.StructField("session_id", T.LongType()), T.StructField("started_us", T.LongType()), T.StructField("point_id", T.LongType()),
    T.StructField("us", T.LongType()), T.StructField("lat", T.DoubleType()), T.StructField("lng", T.DoubleType()),
    T.StructField("accuracy", T.DoubleType()), T.StructField("speed", T.DoubleType()), T.StructField("road_type", T.StringType()),
    T.StructField("paused", T.BooleanType()), T.StructField("_ys", T.ArrayType(T.DoubleType())), T.StructField("_xs", T.ArrayType(T.DoubleType()))])
_MOTION_STATE = T.StructType([
    T.StructField("started", T.LongType()), T.StructField("last", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in ("variance", "lat", "lng")],
    T.StructField("ys", T.ArrayType(T.DoubleType())), T.StructField("xs", T.ArrayType(T.DoubleType()))])


#: What the first step reads of a fix.
_FIX = Columns(("point_id", "road_type", "paused"), ("us",), ("lat", "lng", "accuracy", "speed"))


def _filtered(now: tuple | None, session_id: int, silence: int, ids: list, types: list, pauses: list, us: list, lats: list, lngs: list, accuracies: list,
              speeds: list) -> tuple[tuple, list[tuple]]:
    """The state after one session's fixes and their ``MOTION`` rows, with the last five smoothed positions at each."""
    out, starts = [], [i for i, t in enumerate(us) if (i or now) and t - (us[i - 1] if i else now[1]) > 1000 * silence or not (i or now)]
    bounds = sorted({0, *starts, len(us)})
    for at, end in zip(bounds[:-1], bounds[1:], strict=True):
        started, _, *filter_state, ys, xs = (us[at], None, *folds.KALMAN_START, [], []) if at in starts else now
        filter_state, own_y, own_x = folds.kalman_walk(tuple(filter_state), lats[at:end], lngs[at:end], accuracies[at:end])
        all_y, all_x, back = [*ys, *own_y], [*xs, *own_x], len(ys)
        for k, i in enumerate(range(at, end)):
            last5 = slice(max(0, k + back - 4), k + back + 1)
            out.append((session_id, started, ids[i], us[i], own_y[k], own_x[k], accuracies[i], speeds[i], types[i], pauses[i], all_y[last5], all_x[last5]))
        now = (started, us[end - 1], *filter_state, all_y[-4:], all_x[-4:])
    return now, out


def motion(fixes: DataFrame, late: str = LATE, idle: str = IDLE) -> DataFrame:
    """Every fix with its session's start, smoothed place, movement, stillness and bearing (see ``trajectory.with_motion``).

    ``fixes``: session_id, point_id, ts, lat, lng, accuracy, speed; optional road_type (residential) and paused (false).
    """
    ship(fixes.sparkSession)
    silence = _ms(idle)
    known = {"road_type": F.lit("residential"), "paused": F.lit(False)}
    fixes = fixes.withColumns({c: v for c, v in known.items() if c not in fixes.columns}).withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now, out = _filtered(tuple(state.get) if state.exists else None, key[0], silence, *_FIX.ordered(batches))
        yield _frame(out, MOTION)
        state.update(now)
        _timer(state, now[1], silence)

    rows = _FIX.packed(fixes, "session_id").groupBy("session_id").applyInPandasWithState(
        update, MOTION, _MOTION_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    rows = rows.withColumns({"ts": F.timestamp_micros("us"), "started_at": F.timestamp_micros("started_us")})
    return trajectory.motion_columns(rows.select("session_id", "point_id", "ts", "lat", "lng", "accuracy", "speed", "road_type", "paused", "_ys", "_xs", "started_at"))


# ------------------------------------------------------------------ roads by cell

#: The static table that a stream of points meets by cell, and the meeting (see ``assign``).
road_cells, on_roads = assign.road_cells, assign.on_roads


# ------------------------------------------------------------------ step two

SURVEY = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("session_id", T.LongType()), T.StructField("started_us", T.LongType()),
    T.StructField("point_id", T.LongType()), T.StructField("us", T.LongType()), T.StructField("path_index", T.LongType()),
    T.StructField("lat", T.DoubleType()), T.StructField("lng", T.DoubleType()), T.StructField("out_lat", T.DoubleType()),
    T.StructField("out_lng", T.DoubleType()), T.StructField("on_road", T.BooleanType()), T.StructField("road_id", T.LongType()),
    T.StructField("segment", T.LongType()), T.StructField("returned", T.BooleanType()), T.StructField("points", T.LongType()),
    T.StructField("distance_m", T.DoubleType()), T.StructField("duration_s", T.LongType()), T.StructField("road_count", T.LongType()),
    T.StructField("gps_point_count", T.LongType())])
#: What is known of a session: the last path point; running totals; the open segment; the sides of finished segments, until the return.
_SURVEY_STATE = T.StructType([
    *[T.StructField(n, T.DoubleType()) for n in ("out_lat", "out_lng", "distance")],
    *[T.StructField(n, T.LongType()) for n in ("kept", "segment", "drawn", "first", "last", "seen", "open_end")],
    T.StructField("road_type", T.StringType()), *[T.StructField(n, T.BooleanType()) for n in ("on_road", "pause", "returned")],
    *[T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("open_lat", "open_lng", "leg_lat", "leg_lng", "leg_way")],
    T.StructField("leg_end", T.ArrayType(T.LongType()))])


def _way(y1: float, x1: float, y2: float, x2: float) -> float:
    """Signed initial bearing in degrees."""
    p1, p2, d = math.radians(y1), math.radians(y2), math.radians(x2 - x1)
    return math.degrees(math.atan2(math.sin(d) * math.cos(p2), math.cos(p1) * math.sin(p2) - math.sin(p1) * math.cos(p2) * math.cos(d)))


#: What the second step reads of a fix; off the roads the place of its road is its own.
_MOVED = Columns(("point_id", "road_type"), ("us", "paused", "recordable", "on", "road_id"), ("lat", "lng", "bearing", "snap_lat", "snap_lng"))
Fix = namedtuple("Fix", _MOVED.names)


class Session:
    """The state of one session; ``take`` adds a fix and gives the rows that follow from it, ``close`` the rows of its end."""

    CELL = trajectory.RETURN_METRES / cells.METRES

    def __init__(self, state: tuple | None = None):
        if state is None:
            state = (float("nan"), float("nan"), 0.0, 0, 0, 0, 0, 0, 0, 0, None, False, False, False, [], [], [], [], [], [])
        (self.y, self.x, self.distance, self.kept, self.segment, self.drawn, self.first, self.last, self.seen, self.open_end, self.road_type, self.on_road,
         self.pause, self.returned) = state[:14]
        self.open_lat, self.open_lng, self.leg_lat, self.leg_lng, self.leg_way, self.leg_end = map(list, state[14:])
        self.grid: dict[tuple[int, int], list[int]] | None = None

    def state(self) -> tuple:
        return (self.y, self.x, self.distance, self.kept, self.segment, self.drawn, self.first, self.last, self.seen, self.open_end, self.road_type, self.on_road,
                self.pause, self.returned, self.open_lat, self.open_lng, self.leg_lat, self.leg_lng, self.leg_way, self.leg_end)

    def _cell(self, y: float, x: float) -> tuple[int, int]:
        return math.floor(y / self.CELL), math.floor(x / self.CELL)

    def _finish_segment(self) -> Iterator[dict]:
        lat, lng = self.open_lat, self.open_lng
        if len(lat) >= 2:
            self.drawn += 1
            yield {"kind": "segment", "segment": self.segment, "points": len(lat), "us": self.open_end}
            if not self.returned:
                for i in range(len(lat) - 1):
                    if self.grid is not None:
                        self.grid.setdefault(self._cell(lat[i], lng[i]), []).append(len(self.leg_lat))
                    self.leg_lat.append(lat[i])
                    self.leg_lng.append(lng[i])
                    self.leg_way.append(_way(lat[i], lng[i], lat[i + 1], lng[i + 1]))
                    self.leg_end.append(self.open_end)
        self.open_lat, self.open_lng = [], []

    def _walks_back(self, y: float, x: float, bearing: float, us: int) -> bool:
        """A vertex of an earlier, finished segment lies near and was left the other way. Vertices are found by cell."""
        if self.grid is None:
            self.grid = {}
            for i, at in enumerate(zip(self.leg_lat, self.leg_lng, strict=True)):
                self.grid.setdefault(self._cell(*at), []).append(i)
        cy, cx = self._cell(y, x)
        reach = math.ceil(1 / max(0.02, math.cos(math.radians(min(89.0, abs(y) + 0.001)))))
        for dy in (-1, 0, 1):
            for dx in range(-reach, reach + 1):
                for i in self.grid.get((cy + dy, cx + dx), ()):
                    gap = abs(bearing - self.leg_way[i])
                    if self.leg_end[i] < us and (360 - gap if gap > 180 else gap) > trajectory.RETURN_DEGREES \
                            and folds.metres(y, x, self.leg_lat[i], self.leg_lng[i]) < trajectory.RETURN_METRES:
                        return True
        return False

    def take(self, fix) -> Iterator[dict]:
        us = fix.us
        self.seen = max(self.seen, us)
        self.pause = self.pause or bool(fix.paused)
        if not fix.recordable or self.kept and folds.metres(self.y, self.x, fix.lat, fix.lng) < trajectory.THIN_METRES:
            return
        on = bool(fix.on)
        y, x = (fix.snap_lat, fix.snap_lng) if on else (fix.lat, fix.lng)
        typed = self.kept > 0 and fix.road_type != self.road_type
        if on:
            yield from self._finish_segment()
        else:
            if typed or self.pause or self.on_road:
                yield from self._finish_segment()
                self.segment += 1
                if self.kept and not self.on_road:  # goes on from the point before
                    self.open_lat, self.open_lng = [self.y], [self.x]
            self.open_lat.append(y)
            self.open_lng.append(x)
            self.open_end = us
        if self.kept:
            self.distance += folds.metres(self.y, self.x, y, x)
        else:
            self.first = us
        self.y, self.x, self.last, self.on_road, self.road_type, self.pause = y, x, us, on, fix.road_type, False
        self.kept += 1
        turned = not self.returned and self.kept > trajectory.RETURN_AFTER and self._walks_back(y, x, fix.bearing, us)
        if turned:  # known once and for all: its sides are not needed any more
            self.returned, self.grid = True, {}
            self.leg_lat, self.leg_lng, self.leg_way, self.leg_end = [], [], [], []
        yield {"kind": "point", "point_id": fix.point_id, "us": us, "path_index": self.kept, "lat": fix.lat, "lng": fix.lng, "out_lat": y, "out_lng": x,
               "on_road": on, "road_id": fix.road_id if on else None, "segment": None if on else self.segment, "returned": turned}

    def close(self) -> Iterator[dict]:
        yield from self._finish_segment()
        yield {"kind": "finish", "us": self.seen, "returned": self.returned, "distance_m": self.distance, "duration_s": self.last // 1_000_000 - self.first // 1_000_000,
               "road_count": self.drawn, "gps_point_count": self.kept}


def _rows(found: list[dict], key: tuple) -> pd.DataFrame:
    return _frame([(row["kind"], *key, *[row.get(c) for c in SURVEY.names[3:]]) for row in found], SURVEY)


def survey(moving: DataFrame, by_cell: DataFrame, late: str = LATE, idle: str = IDLE) -> DataFrame:
    """Rows of ``SURVEY`` by kind: path points, finished segments, and one ``finish`` row with the summary when a session has been silent.

    ``moving``: a stream of ``motion`` rows; ``by_cell``: ``road_cells`` of the mapped roads.
    """
    ship(moving.sparkSession)
    silence = _ms(idle)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        session, found = Session(tuple(state.get) if state.exists else None), []
        if state.hasTimedOut:
            found.extend(session.close())
            state.remove()
        else:
            for fix in map(Fix._make, zip(*_MOVED.ordered(batches), strict=True)):
                found.extend(session.take(fix))
            state.update(session.state())
            _timer(state, session.seen, silence)
        if found:
            yield _rows(found, key)

    rows = _on(on_roads(moving.withWatermark("ts", late).withColumns({"recordable": trajectory.recordable(), "us": F.unix_micros("ts")}), by_cell))
    rows = rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("paused", "recordable")})
    found = _MOVED.packed(rows, "session_id", "started_us").groupBy("session_id", "started_us").applyInPandasWithState(
        update, SURVEY, _SURVEY_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return _timed(found, SURVEY)


def _on(rows: DataFrame) -> DataFrame:
    """Whether a row lies on a road as a column of its own: numbers beside nulls would reach Python as doubles."""
    return rows.withColumns({"started_us": F.unix_micros("started_at"), "on": F.col("road_id").isNotNull(), "road_id": F.coalesce("road_id", F.lit(0))})


def _timed(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Moments for microseconds, ``ts`` as the last column."""
    started = F.timestamp_micros("started_us").alias("started_at")
    return rows.select(*[started if c == "started_us" else c for c in schema.names if c != "us"], F.timestamp_micros("us").alias("ts"))


# ------------------------------------------------------------------ buffered matching

MATCHED = T.StructType([
    T.StructField("session_id", T.LongType()), T.StructField("started_us", T.LongType()), T.StructField("point_id", T.LongType()),
    T.StructField("us", T.LongType()), T.StructField("window_no", T.LongType()), T.StructField("confidence", T.DoubleType()),
    T.StructField("road_id", T.LongType()), T.StructField("out_lat", T.DoubleType()), T.StructField("out_lng", T.DoubleType())])
_HELD = {"point_id": T.LongType(), "us": T.LongType(), "lat": T.DoubleType(), "lng": T.DoubleType(), "road_id": T.LongType(), "snap_lat": T.DoubleType(), "snap_lng": T.DoubleType()}
#: What the third step reads of a point.
_PLACED = Columns(("point_id",), ("us", "on", "road_id"), ("lat", "lng", "snap_lat", "snap_lng"))
_MATCH_STATE = T.StructType([T.StructField("window_no", T.LongType()), T.StructField("since", T.LongType()), T.StructField("carried", T.BooleanType()),
                             *[T.StructField(n, T.ArrayType(t)) for n, t in _HELD.items()]])


class Windows:
    """Points held back for matching. The first of a later window is the last of the one before: it counts, and is not given again."""

    def __init__(self, state: tuple | None = None):
        number, since, carried, *held = state or (1, None, False, *[[] for _ in _HELD])
        self.number, self.since, self.carried = number, since, carried
        self.held = [tuple(p) for p in zip(*held, strict=True)]

    def state(self) -> tuple:
        return (self.number, self.since, self.carried, *[list(c) for c in zip(*self.held, strict=True)]) if self.held else (
            self.number, self.since, self.carried, *[[] for _ in _HELD])

    def take(self, point: tuple) -> Iterator[tuple]:
        """A window closes with the point that makes it long enough in both points and seconds."""
        self.since = point[1] if self.since is None else self.since
        self.held.append(point)
        if len(self.held) >= MATCH_POINTS and point[1] - self.since >= MATCH_SECONDS * 1_000_000:
            confidence = sum(p[4] is not None for p in self.held) / len(self.held)
            yield from self._give(confidence)
            self.held, self.since, self.carried, self.number = [point], point[1], True, self.number + 1

    def close(self) -> Iterator[tuple]:
        yield from self._give(None)
        self.held = []

    def _give(self, confidence: float | None) -> Iterator[tuple]:
        taken = confidence is not None and confidence >= MATCH_CONFIDENCE
        for k, (point_id, us, lat, lng, road_id, snap_lat, snap_lng) in enumerate(self.held):
            if k or not self.carried:
                on = taken and road_id is not None and (k > 0)  # the first point of all stays where it is, for the line to go on from it
                yield (point_id, us, self.number, confidence, road_id if on else None, snap_lat if on else lat, snap_lng if on else lng)


def matched(points: DataFrame, by_cell: DataFrame, late: str = LATE, idle: str = IDLE) -> DataFrame:
    """Path points with the position their window of matches gives them, a row per point (``MATCHED``); raw where the match is not trusted.

    ``points``: a stream with session_id, started_at, point_id, ts, lat, lng. What is left when a session falls silent is given raw.
    """
    ship(points.sparkSession)
    silence = _ms(idle)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        windows, found = Windows(tuple(state.get) if state.exists else None), []
        if state.hasTimedOut:
            found.extend(windows.close())
            state.remove()
        else:
            for point_id, us, on, road_id, lat, lng, *snap in zip(*_PLACED.ordered(batches), strict=True):
                found.extend(windows.take((point_id, us, lat, lng, *((road_id, *snap) if on else (None, None, None)))))
            state.update(windows.state())
            _timer(state, us, silence)
        if found:
            yield _frame([(*key, *row) for row in found], MATCHED)

    rows = on_roads(points.withWatermark("ts", late).select("session_id", "started_at", "point_id", "ts", "lat", "lng", F.unix_micros("ts").alias("us")), by_cell)
    found = _PLACED.packed(_on(rows), "session_id", "started_us").groupBy("session_id", "started_us").applyInPandasWithState(
        update, MATCHED, _MATCH_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return _timed(found, MATCHED)


# ------------------------------------------------------------------ the end of a session

def finished(batch: DataFrame, symbols: DataFrame) -> DataFrame:
    """The ``finish`` rows of a batch with the session's houses: how many, and their numbers by the simple order (E1).

    ``symbols`` has the register's columns with ``session_id``; only those of sessions that end in this batch are read further.
    """
    from blockwalk.functions import domain
    from blockwalk.operators import ordering

    ends = cut(batch.filter("kind = 'finish'"))
    own = symbols.join(ends.select("session_id").distinct(), "session_id", "left_semi").withColumn("hlb_id", F.col("session_id"))
    house = domain.is_house(F.col("symbol_type"))
    numbers = ordering.simple_numbering(own).filter(house).groupBy("session_id").agg(
        F.count_if(F.col("symbol_type").isin(domain.COUNTED_HOUSES)).alias("house_count"),
        F.array_sort(F.collect_list(F.struct("number", "id"))).alias("numbers"))
    return ends.join(numbers, "session_id", "left").select(
        "session_id", "started_at", F.col("ts").alias("ended_at"), "distance_m", "duration_s", F.coalesce("house_count", F.lit(0)).alias("house_count"),
        "road_count", "gps_point_count", "returned", "numbers")
