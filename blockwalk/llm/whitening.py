"""Embedding whitening by spectrum slicing.

Vectors become whole numbers. The fit list - each distinct vector once - gives exact sums, then the covariance, centred before
multiplying, as partial matrices per task that are summed per row of the matrix. Its size is the square of the dimension, whatever
the number of vectors; that matrix alone reaches the driver. There LDLᵀ factors of the shifted covariance count the eigenvalues above
a shift; bisection on the counts isolates each leading eigenvalue, Rayleigh quotient iteration converges on it, and two more counts
just beside it certify its number. Eigenvalues that no double tells apart share an interval; inverse iteration on a block spans them.

Cases: vectors that are null, empty or hold a null or non-finite entry go, and so do those of another length than the most frequent one
(the longer at a tie); repeated rows all come back and count once in the fit; null ids stay; an empty table gives no rows; ``whitened`` is
null for an eigenvalue that is zero to rounding, ``explained`` for a covariance of zero, ``deviation`` where it does not fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwalk.llm.common import cut, partitions
from blockwalk.ship import ship

COMPONENTS = 4
SCALE = 256
#: Fixed value: the bound on growth in Bunch-Kaufman pivoting.
GROWTH = (1 + 17 ** 0.5) / 8
#: Rows of vectors turned at a time, and the half of an entry's bits that is summed apart.
ROWS = 4096
_HALF = 32

ROW = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


# --- the spectrum of a small symmetric matrix -------------------------------------------------------------------------------------

def above(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues exceed the shift: the positive part of D in LDLᵀ of the shifted matrix (Sylvester's law of inertia).

    Rows and columns are exchanged as Bunch and Kaufman do, with blocks of one or two in D, so the factors stay stable at any shift;
    a block of two has one positive eigenvalue.
    """
    rest, count = a - shift * np.eye(len(a)), 0
    while len(rest):
        low = np.abs(rest[1:, 0])
        far = 1 + int(low.argmax()) if len(low) else 0
        size, first = low.max(initial=0.0), abs(rest[0, 0])
        if max(size, first) == 0:  # an eigenvalue at the shift
            rest = rest[1:, 1:]
            continue
        two = False
        if first < GROWTH * size:
            line = np.abs(rest[far])
            line[far] = 0.0
            if first * line.max() < GROWTH * size * size:
                two = abs(rest[far, far]) < GROWTH * line.max()
                order = np.arange(len(rest))
                order[[int(two), far]] = order[[far, int(two)]]
                rest = rest[np.ix_(order, order)]
        k = 1 + two
        below = rest[k:, :k]
        count += 1 if two else int(rest[0, 0] > 0)
        if two:
            step = below @ np.linalg.solve(rest[:2, :2] / size, below.T / size)
        else:
            step = np.outer(below[:, 0] / rest[0, 0], below[:, 0])
        rest = rest[k:, k:] - step
    return count


def _interval(a: np.ndarray, number: int, low: float, high: float, width: float) -> tuple[float, float, int, int]:
    """Bisect until the eigenvalue of that number is alone between low and high or they are a width apart: low, high, counts above each."""
    over_low, over_high = above(a, low), above(a, high)
    while over_low - over_high > 1 and high - low > width:
        mid = (low + high) / 2
        count = above(a, mid)
        if count >= number:
            low, over_low = mid, count
        else:
            high, over_high = mid, count
    return low, high, over_low, over_high


def _start(n: int, number: int) -> np.ndarray:
    """A fixed vector without pattern in common with an eigenvector."""
    return np.cos(np.arange(1, n + 1, dtype=np.float64) ** 2 * (0.7 + number))


def _solve(a: np.ndarray, shift: float, b: np.ndarray) -> np.ndarray:
    size = max(np.abs(a).max(initial=0.0), 1e-300)
    for k in range(8):
        try:
            x = np.linalg.solve(a - (shift + k * 2e-16 * size) * np.eye(len(a)), b)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(x).all():
            return x
    raise ArithmeticError("the shifted matrix cannot be solved")


def _iterate(a: np.ndarray, low: float, high: float, number: int, known: list[np.ndarray]) -> tuple[float, np.ndarray] | None:
    """Inverse iteration at the middle of the interval, then Rayleigh quotients; nothing if they leave the interval."""
    apart = lambda v: v - sum((u * (u @ v) for u in known), np.zeros(len(v)))
    unit = lambda v: v / np.linalg.norm(v)
    x = unit(apart(_start(len(a), number)))
    for _ in range(3):
        x = unit(apart(_solve(a, (low + high) / 2, x)))
    value, best = x @ a @ x, np.inf
    for _ in range(30):
        residual = np.linalg.norm(a @ x - value * x)
        if residual >= best / 2:
            break
        best = residual
        x = unit(apart(_solve(a, value, x)))
        value = x @ a @ x
    return (value, x) if low <= value <= high else None


def leading(a: np.ndarray, count: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues, falling, and their unit vectors in columns."""
    n = len(a)
    count = min(count, n)
    reach = np.abs(a).sum(1).max(initial=0.0)  # every eigenvalue lies within
    if reach == 0:
        return np.zeros(count), np.eye(n)[:, :count]
    slack, width = 2e-15 * reach * n ** 0.5, 1e-14 * reach * n ** 0.5
    values: list[float] = []
    vectors: list[np.ndarray] = []
    while len(values) < count:
        number = len(values) + 1
        low, high, over_low, over_high = _interval(a, number, -1.01 * reach, 1.01 * reach, width)
        found = None
        while over_low - over_high == 1 and found is None and high - low > width:
            found = _iterate(a, low, high, number, vectors)
            certified = found and above(a, found[0] - slack) >= number > above(a, found[0] + slack)
            if not certified:
                found, mid = None, (low + high) / 2
                low, high = (mid, high) if above(a, mid) >= number else (low, mid)
        if found is not None:
            values.append(found[0])
            vectors.append(found[1])
            continue
        # as good as equal: a block spans all of them that are not known yet, and as many as are asked for are taken
        size = min(over_low - len(values), count - len(values)) if over_low - over_high > 1 else 1
        block = np.stack([_start(n, number + k) for k in range(size)], axis=1)
        for _ in range(4):
            for u in vectors:
                block -= np.outer(u, u @ block)
            block = np.linalg.qr(_solve(a, (low + high) / 2, np.linalg.qr(block)[0]))[0]
        for u in vectors:
            block -= np.outer(u, u @ block)
        block = np.linalg.qr(block)[0]
        inner, turn = np.linalg.eigh(block.T @ a @ block)
        order = np.argsort(-inner, kind="stable")
        values += list(inner[order])
        vectors += list((block @ turn[:, order]).T)
    return np.array(values), np.stack(vectors, axis=1)


# --- the job ------------------------------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Fit:
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def usable(self) -> np.ndarray:
        """Eigenvalues that rounding of the covariance does not hide."""
        return self.values > 1e-13 * max(self.trace, 0.0)


def whole(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): the rows whose vectors can be used, entries as whole numbers."""
    entry = lambda c: F.floor(SCALE * c.cast("double")).cast("long")
    sound = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf"))
    rows = vectors.select("vec_id", F.col("embedding").alias("v")).where("v IS NOT NULL AND size(v) > 0").where(F.forall("v", sound))
    rows = rows.select("vec_id", F.transform("v", entry).alias("x"))
    lengths = rows.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return rows.where(F.size("x") == (lengths["length"] if lengths else 0))


def _matrices(batches: Iterator[pd.DataFrame], name: str = "x") -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield np.stack(batch[name].iloc[at:at + ROWS].to_numpy())


def _moments(fit: DataFrame, length: int) -> tuple[int, list[int]]:
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, high, low = 0, np.zeros(length, dtype=np.int64), np.zeros(length, dtype=np.int64)
        for x in _matrices(batches):
            n += len(x)
            high += (x >> _HALF).sum(0)
            low += (x & ((1 << _HALF) - 1)).sum(0)
        if n:
            yield pd.DataFrame({"at": np.arange(length), "n": n, "high": high, "low": low})

    parts = fit.mapInPandas(add, "at int, n long, high long, low long").groupBy("at") \
        .agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(28,0)")).alias(c) for c in ("high", "low")]).orderBy("at").collect()
    return (parts[0]["n"], [(int(r["high"]) << _HALF) + int(r["low"]) for r in parts]) if parts else (0, [])


def _covariance(fit: DataFrame, n: int, mean: np.ndarray) -> np.ndarray:
    length = len(mean)

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, seen = np.zeros((length, length)), False
        for x in _matrices(batches):
            centred, seen = x - mean, True
            total += centred.T @ centred
        if seen:
            yield pd.DataFrame({"at": np.arange(length), "line": list(total)})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, line in zip(batch["at"], batch["line"], strict=True):
                total[at] = total[at] + line if at in total else np.array(line)
        if total:
            yield pd.DataFrame({"at": list(total), "line": list(total.values())})

    schema = "at int, line array<double>"
    rows = fit.mapInPandas(multiply, schema).repartition(partitions(fit.sparkSession), "at").mapInPandas(add, schema).orderBy("at").collect()
    found = np.array([r["line"] for r in rows]) / n
    return (found + found.T) / 2


def _whitened(x: np.ndarray, fit: Fit) -> np.ndarray:
    usable = fit.usable
    root = np.sqrt(np.where(usable, fit.values, 1.0))
    return np.where(usable, ((x - fit.mean) @ fit.vectors) / root, np.nan)


def _identity_error(rows: DataFrame, fit: Fit) -> float:
    """Measured on the whitened fit list: the largest entry of its covariance beside those of the identity."""
    k = len(fit.values)
    names = [f"w{i}" for i in range(k)]

    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in _matrices(batches):
            yield pd.DataFrame(_whitened(x, fit), columns=names)

    white = rows.mapInPandas(turn, ", ".join(f"{c} double" for c in names))
    used = [i for i in range(k) if fit.usable[i]]
    pairs = [(i, j) for i in used for j in used if i <= j]
    if not pairs:
        return 0.0
    found = white.agg(*[F.covar_pop(names[i], names[j]) for i, j in pairs]).first()
    return max(abs(found[p] - (i == j)) for p, (i, j) in enumerate(pairs))


def fitted(rows: DataFrame, components: int = COMPONENTS) -> tuple[Fit, float] | None:
    """The fit over the distinct vectors of ``rows`` (vec_id, x) and its identity error; nothing without rows."""
    ship(rows.sparkSession)
    fit = cut(rows.select("x").distinct())
    one = fit.first()
    if one is None:
        return None
    n, sums = _moments(fit, len(one["x"]))
    covariance = _covariance(fit, n, np.array([s / n for s in sums]))
    values, vectors = leading(covariance, components)
    found = Fit(n, sums, values, vectors, float(np.trace(covariance)))
    return found, _identity_error(fit, found)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    most = max((abs(int(v)) for v in (x.min(), x.max())), default=0) * n + max(abs(s) for s in sums)
    if most * most * x.shape[1] < 1 << 62:
        return ((n * x - np.array(sums, dtype=np.int64)) ** 2).sum(1).tolist()
    found = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in found]


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row per usable vector and component: see ``ROW``."""
    rows = whole(vectors)
    found = fitted(rows, components)
    if found is None:
        return vectors.sparkSession.createDataFrame([], ROW)
    fit, error = found
    explained = fit.values / fit.trace if fit.trace > 0 else np.full(len(fit.values), np.nan)

    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(fit.values)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.iloc[at:at + ROWS]
                x = np.stack(part["x"].to_numpy())
                deviation = pd.array(np.repeat(np.array(_deviations(x, fit.n, fit.sums), dtype=object), k), dtype="Int64")
                yield pd.DataFrame({"vec_id": part["vec_id"].astype("Int64").repeat(k).array, "component": np.tile(np.arange(1, k + 1), len(part)), "n": fit.n,
                                    "deviation": deviation, "whitened": _whitened(x, fit).ravel(), "explained": np.tile(explained, len(part)), "identity_error": error})

    nulls = [F.when(~F.isnan(c), F.col(c)).alias(c) if c in ("whitened", "explained") else F.col(c) for c in
             ("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")]
    return rows.mapInPandas(turn, ROW).select(*nulls)
