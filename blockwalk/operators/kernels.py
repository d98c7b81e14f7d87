"""Small per-group helpers run inside tasks; Spark partitions and shuffles the groups.

Each takes numpy arrays of one bounded group.  They exist where a decision
depends on decisions already taken for earlier rows of the same group.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np


def _cells(y, x, size):
    return np.floor(y / size).astype(np.int64), np.floor(x / size).astype(np.int64)


def greedy_keep(y, x, radius, metric, fixed=None, reach=None):
    """Visit rows in order; keep one unless a kept row is closer than ``radius``.

    ``metric(y1, x1, y2, x2)`` gives the distance; rows within the radius differ by
    at most ``reach`` on both axes.  Rows flagged ``fixed`` are always kept.
    """
    cy, cx = _cells(y, x, radius if reach is None else reach)
    kept, grid = np.zeros(len(y), bool), defaultdict(list)
    for i in range(len(y)):
        near = False
        if fixed is None or not fixed[i]:
            near = any(metric(y[i], x[i], y[j], x[j]) < radius
                       for a in (-1, 0, 1) for b in (-1, 0, 1) for j in grid.get((cy[i] + a, cx[i] + b), ()))
        if not near:
            kept[i] = True
            grid[(cy[i], cx[i])].append(i)
    return kept


def first_apart(v, u, gap, count):
    """Positions of the first ``count`` planar points, in order, that keep ``gap`` from those before them.

    Each point taken strikes out later ones; no more is looked at than ``count`` needs.
    """
    left, taken = np.arange(len(v)), []
    while len(left) and len(taken) < count:
        i, left = left[0], left[1:]
        taken.append(i)
        dv, du = v[left] - v[i], u[left] - u[i]
        d = np.hypot(dv, du)
        near = d < gap
        for j in np.flatnonzero(np.abs(d - gap) <= 1e-9 * gap):  # rounding of the two square roots may differ here
            near[j] = math.hypot(dv[j], du[j]) < gap
        left = left[~near]
    return np.array(taken, dtype=np.int64)


def settle_tile(y, x, own, radius, metric, reach):
    """Rows of a tile and of its surroundings in order: 1 kept, 0 struck out, 2 open until more is known about the surroundings.

    What becomes of a row that is not ``own`` is decided elsewhere, so it leaves open whatever it might strike out, and so on down the order.
    """
    cy, cx = _cells(y, x, reach)
    state, kept, unknown = np.full(len(y), 2, np.int8), defaultdict(list), defaultdict(list)
    around = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    for i in range(len(y)):
        at = (cy[i], cx[i])
        meets = lambda grid: any(metric(y[i], x[i], y[j], x[j]) < radius for a, b in around for j in grid.get((at[0] + a, at[1] + b), ()))  # noqa: B023, E731
        if not own[i]:
            unknown[at].append(i)
        elif meets(kept):
            state[i] = 0
        elif meets(unknown):
            unknown[at].append(i)
        else:
            state[i] = 1
            kept[at].append(i)
    return state


#: Up to so many points a table of all distances costs less than looking up cells, and comparing along one axis less than walking cells.
TABLE_POINTS, AXIS_POINTS = 128, 2_000


def single_link(y, x, radius):
    """Component labels (lowest member index) of points linked at distance <= radius."""
    n = len(y)
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    limit = radius * radius
    if n <= AXIS_POINTS:
        order = np.argsort(y, kind="stable")
        sy, sx = y[order], x[order]
        for step in range(1, n):
            dy = sy[step:] - sy[:-step]
            if not (dy <= radius * (1 + 1e-9)).any():
                break
            dx = sx[step:] - sx[:-step]
            linked = np.flatnonzero(dx * dx + dy * dy <= limit)
            for a, b in zip(order[linked].tolist(), order[linked + step].tolist(), strict=True):
                ra, rb = find(a), find(b)
                if ra != rb:
                    parent[max(ra, rb)] = min(ra, rb)
        return np.array([find(i) for i in range(n)], dtype=np.int64)
    grid = defaultdict(list)
    cy, cx = _cells(y, x, radius if radius > 0 else 1.0)
    for i in range(n):
        for a in (-1, 0, 1):
            for b in (-1, 0, 1):
                for j in grid.get((cy[i] + a, cx[i] + b), ()):
                    dy, dx = y[i] - y[j], x[i] - x[j]
                    if dx * dx + dy * dy <= limit:
                        ri, rj = find(i), find(j)
                        if ri != rj:
                            parent[max(ri, rj)] = min(ri, rj)
        grid[(cy[i], cx[i])].append(i)
    return np.array([find(i) for i in range(n)], dtype=np.int64)


def free_runs(lat, west, dx, k, last, spans, sides, metres, half_width):
    """First and last column of each run of cells of a row inside a ring and clear of road strips.

    ``spans`` holds the ring's edges over this latitude (yi, xi, yj, xj), ``sides`` the road sides
    near it (alat, alng, blat, blng), one after the other; ``k`` is metres per degree of longitude.
    """
    lng = west + (np.arange(last + 1) + 0.5) * dx
    inside = np.zeros(last + 1, bool)
    for yi, xi, yj, xj in np.reshape(spans, (-1, 4)):
        inside ^= lng < (xj - xi) * (lat - yi) / (yj - yi) + xi
    pad = half_width / k + dx
    for alat, alng, blat, blng in np.reshape([] if sides is None else sides, (-1, 4)):
        lo, hi = np.searchsorted(lng, (min(alng, blng) - pad, max(alng, blng) + pad))
        ax, bx = (alng - lng[lo:hi]) * k, (blng - lng[lo:hi]) * k
        ay, by = (alat - lat) * metres, (blat - lat) * metres
        len2 = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
        t = np.clip((-ax * (bx - ax) - ay * (by - ay)) / np.where(len2 == 0, 1.0, len2), 0.0, 1.0)
        inside[lo:hi] &= np.hypot(ax + t * (bx - ax), ay + t * (by - ay)) >= half_width
    turns = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0])))).reshape(-1, 2)
    turns[:, 1] -= 1
    return turns.tolist()


def link_runs(cy, first, last):
    """Component labels (lowest member index) of runs of cells that share a side; runs come by row, then column."""
    parent = list(range(len(cy)))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    cy, first, last = cy.tolist(), first.tolist(), last.tolist()
    j = 0
    for i in range(len(cy)):
        while cy[j] < cy[i] - 1 or (cy[j] == cy[i] - 1 and last[j] < first[i]):
            j += 1
        n = j
        while cy[n] == cy[i] - 1 and first[n] <= last[i]:
            a, b = find(i), find(n)
            if a != b:
                parent[max(a, b)] = min(a, b)
            n += 1
    return np.array([find(i) for i in range(len(cy))], dtype=np.int64)


def flat_m(lat1, lng1, lat2, lng2):
    k = 111320.0
    dx = (lng2 - lng1) * (k * np.cos((lat1 + lat2) / 2 * math.pi / 180))
    return np.hypot(dx, (lat2 - lat1) * k)


def distances(lat, lng):
    """The table of all distances; a point is infinitely far from itself."""
    d = flat_m(lat[:, None], lng[:, None], lat, lng)
    np.fill_diagonal(d, np.inf)
    return d


def nearest_gaps(lat, lng):
    """Distance of every point to its nearest other point (inf when alone)."""
    n = len(lat)
    out = np.full(n, np.inf)
    if n < 2:
        return out
    if n <= TABLE_POINTS:
        return distances(lat, lng).min(axis=1)
    order = np.argsort(lat, kind="stable")
    la, ln = lat[order], lng[order]
    best = np.full(n, np.inf)
    step = 1
    # Compare with the neighbours step places away in latitude order until even the
    # latitude gap alone exceeds every point's best distance.
    while step < n:
        gap = (la[step:] - la[:-step]) * 111320.0
        open_pairs = gap < np.maximum(best[step:], best[:-step])
        if not open_pairs.any():
            break
        idx = np.nonzero(open_pairs)[0]
        d = flat_m(la[idx], ln[idx], la[idx + step], ln[idx + step])
        np.minimum.at(best, idx, d)
        np.minimum.at(best, idx + step, d)
        step += 1
    out[order] = best
    return out


def nearest_mean(lat, lng, k, block=256):
    """Mean distance of every point to its ``k`` nearest others, or to all where they are fewer (0 when alone)."""
    n, k = len(lat), min(k, len(lat) - 1)
    out = np.zeros(n)
    if k < 1:
        return out
    order = np.argsort(lat, kind="stable")
    la, ln = lat[order], lng[order]
    for start in range(0, n, block):
        end = min(start + block, n)
        lo, hi = max(0, start - 4 * k), min(n, end + 4 * k)
        while True:
            d = flat_m(la[start:end, None], ln[start:end, None], la[None, lo:hi], ln[None, lo:hi])
            d[np.arange(end - start), np.arange(start - lo, end - lo)] = np.inf
            near = np.sort(np.partition(d, k - 1, axis=1)[:, :k], axis=1)
            # rows further off in latitude alone than the k-th neighbour cannot be nearer
            reach = near[:, -1] / 111320.0
            low = int(np.searchsorted(la, (la[start:end] - reach).min(), "left"))
            high = int(np.searchsorted(la, (la[start:end] + reach).max(), "right"))
            if low >= lo and high <= hi:
                break
            lo, hi = min(lo, max(low, lo - (hi - lo))), max(hi, min(high, hi + (hi - lo)))
        out[order[start:end]] = near.sum(axis=1) / k
    return out


class Grid:
    """Points by cells of about ``side`` metres; two points whose cells are k apart are at least (k - 1) sides apart.

    ``take`` removes a point. Coarser grids over the same points tell where any are left.
    """

    def __init__(self, lat, lng, side, levels=1):
        k = 111320.0
        narrow = math.cos(math.radians(min(89.0, float(np.abs(lat).max()))))
        self.side = side
        self.cy = np.floor((lat - lat.min()) * k / side).astype(np.int64)
        self.cx = np.floor((lng - lng.min()) * k * narrow / side).astype(np.int64)
        self.levels = [defaultdict(set) if not n else defaultdict(int) for n in range(levels)]
        for i, (y, x) in enumerate(zip(self.cy.tolist(), self.cx.tolist())):
            self.levels[0][(y, x)].add(i)
            for n in range(1, levels):
                self.levels[n][(y >> n, x >> n)] += 1

    def take(self, i):
        y, x = int(self.cy[i]), int(self.cx[i])
        self.levels[0][(y, x)].discard(i)
        for n in range(1, len(self.levels)):
            self.levels[n][(y >> n, x >> n)] -= 1

    def within(self, y, x, reach):
        """Points whose cells are at most ``reach`` cells away. Wide reaches go through the coarse cells that still hold points."""
        n = 0
        while n + 1 < len(self.levels) and (reach >> n) > 4:
            n += 1
        fine, found = self.levels[0], []
        for by in range((y - reach) >> n, ((y + reach) >> n) + 1):
            for bx in range((x - reach) >> n, ((x + reach) >> n) + 1):
                if n and not self.levels[n].get((by, bx)):
                    continue
                for cy in range(max(by << n, y - reach), min((by + 1) << n, y + reach + 1)):
                    for cx in range(max(bx << n, x - reach), min((bx + 1) << n, x + reach + 1)):
                        found.extend(fine.get((cy, cx), ()))
        return found


def _cell_side(lat, lng):
    """Metres: a few points per cell if they lie evenly, and no finer than a metre."""
    high = (lat.max() - lat.min()) * 111320.0
    wide = (lng.max() - lng.min()) * 111320.0 * math.cos(math.radians(float(lat.mean())))
    return max(1.0, math.sqrt(2 * max(high, 1.0) * max(wide, 1.0) / len(lat)))


def nearest_walk(lat, lng, start):
    """Always on to the nearest point that is left, the first in order among equals.

    The points that are left are found by growing squares of cells, so a step costs what lies about it.
    """
    n = len(lat)
    levels = max(1, int(math.log2(n)) // 2)
    grid = Grid(lat, lng, _cell_side(lat, lng), levels)
    widest = int(max(grid.cy.max(), grid.cx.max())) + 1
    path, at = [start], start
    grid.take(start)
    for _ in range(n - 1):
        y, x, reach = int(grid.cy[at]), int(grid.cx[at]), 1
        best = None
        while True:
            cand = np.array(sorted(grid.within(y, x, reach)), dtype=np.int64)
            if len(cand):
                d = flat_m(lat[at], lng[at], lat[cand], lng[cand])
                best = int(np.argmin(d))
                # a point in a cell further out is at least ``reach`` sides away; the margin covers the scale of longitudes
                if d[best] < reach * grid.side * 0.999 or reach > widest:
                    break
                reach = max(reach + 1, min(widest + 1, int(d[best] / (grid.side * 0.999)) + 1))
            else:
                reach *= 2
        at = int(cand[best])
        grid.take(at)
        path.append(at)
    return np.array(path)


def walk_order(lat, lng, start, passes=40):
    """Nearest-neighbour walk from ``start``, then open-path 2-opt; returns row indices."""
    if 1 < len(lat) <= TABLE_POINTS:
        return _short_walk(distances(lat, lng), start, passes)
    return two_opt(lat, lng, nearest_walk(lat, lng, start), passes)


def _short_walk(d, start, passes):
    """:func:`nearest_walk` and :func:`two_opt` of a few points by the table of their distances."""
    n, path, left = len(d), [start], d.copy()
    left[:, start] = np.inf
    for _ in range(n - 1):
        at = int(left[path[-1]].argmin())
        left[:, at] = np.inf
        path.append(at)
    path = np.array(path)
    if n <= 3:
        return path
    later = np.triu(np.ones((n - 1, n - 1), bool), 2)
    for _ in range(passes):
        along = d[path[:, None], path]
        hop = along.diagonal(1)
        better = ((along[:-1, :-1] + along[1:, 1:]) + 0.01 < hop[:, None] + hop) & later
        first = int(better.argmax())  # the first in the order of (i, j)
        i, j = divmod(first, n - 1)
        if not better[i, j]:
            break
        path[i + 1:j + 1] = path[i + 1:j + 1][::-1]
    return path


def _about(y, x, lat, lng, radius, side, widest=6):
    """Pairs (k, i): centre k of (y, x) and points i that lie within its radius, and some that lie a little further.

    Centres are served by rings of cells; the few whose radius spans more than ``widest`` cells are held against all points.
    """
    k = 111320.0
    narrow = math.cos(math.radians(min(89.0, float(np.abs(lat).max()))))
    rows = lambda v: np.floor((v - lat.min()) * k / side).astype(np.int64)
    columns = lambda v: np.floor((v - lng.min()) * k * narrow / side).astype(np.int64)
    span = int(columns(lng.max())) + 2 * widest + 3
    cell = rows(lat) * span + columns(lng) + widest
    order = np.argsort(cell, kind="stable")
    cells = cell[order]
    ring = np.ceil(radius * 1.001 / side).astype(np.int64)
    centres, points = [], []
    for k_ in np.nonzero(ring > widest)[0]:
        near = np.nonzero(flat_m(y[k_], x[k_], lat, lng) <= radius[k_] * 1.001)[0]
        centres.append(np.full(len(near), k_))
        points.append(near)
    for r in range(1, widest + 1):
        own = np.nonzero(np.maximum(ring, 1) == r)[0]
        if not len(own):
            continue
        cy, cx = rows(y[own]), columns(x[own]) + widest
        for dy in range(-r, r + 1):
            low = np.searchsorted(cells, (cy + dy) * span + cx - r)
            high = np.searchsorted(cells, (cy + dy) * span + cx + r, side="right")
            size = high - low
            at = np.repeat(low - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            centres.append(np.repeat(own, size))
            points.append(order[at])
    return np.concatenate(centres) if centres else np.zeros(0, np.int64), np.concatenate(points) if points else np.zeros(0, np.int64)


def two_opt(lat, lng, path, passes=40):
    """Reverse the first stretch whose reversal saves over 1 cm; at most ``passes`` times.

    Two steps i and j can only gain if the path's point i lies nearer to point j than to point i + 1, or point j + 1 nearer to point i + 1 than to
    point j; such pairs are found by cells, so a pass costs what lies about the steps.
    """
    n = len(path)
    if n <= 3:
        return path
    path, side = np.array(path), _cell_side(lat, lng)
    for _ in range(passes):
        la, ln = lat[path], lng[path]
        hop = flat_m(la[:-1], ln[:-1], la[1:], ln[1:])
        i1, j1 = _about(la[:-1], ln[:-1], la, ln, hop, side)  # from a step's first point to other steps' first points
        j2, i2 = _about(la[1:], ln[1:], la, ln, hop, side)  # from a step's second point to other steps' second points
        i, j = np.r_[i1, i2 - 1], np.r_[j1, j2]
        ok = (i >= 0) & (j >= i + 2) & (j < n - 1)
        i, j = i[ok], j[ok]
        before = hop[i] + hop[j]
        after = flat_m(la[i], ln[i], la[j], ln[j]) + flat_m(la[i + 1], ln[i + 1], la[j + 1], ln[j + 1])
        better = np.nonzero(after + 0.01 < before)[0]
        if not len(better):
            break
        first = better[np.lexsort((j[better], i[better]))[0]]
        path[i[first] + 1:j[first] + 1] = path[i[first] + 1:j[first] + 1][::-1]
    return path


def attach_sources(lat, lng, source, near=3.6e-5):
    """Rows in priority order: attach to the first cluster lacking the row's source.

    Returns True for rows that open a cluster (the representatives).
    """
    cy, cx = _cells(lat, lng, near)
    grid, lead = defaultdict(list), np.zeros(len(lat), bool)
    have = {}
    for i in range(len(lat)):
        best = None
        for a in (-1, 0, 1):
            for b in (-1, 0, 1):
                for j in grid.get((cy[i] + a, cx[i] + b), ()):
                    if (best is None or j < best) and source[i] not in have[j] \
                            and abs(lat[j] - lat[i]) < near and abs(lng[j] - lng[i]) < near:
                        best = j
        if best is None:
            lead[i] = True
            have[i] = {source[i]}
            grid[(cy[i], cx[i])].append(i)
        else:
            have[best].add(source[i])
    return lead


def deviating_lines(y, x, lines, tolerance):
    """:func:`deviating` for many lines at once: ``lines`` holds each vertex's line, equal ones together.

    Every round splits every open interval of every line, so rounds are as many as the deepest line has levels.
    """
    n = len(y)
    ends = np.ones(n + 1, bool)
    ends[1:-1] = lines[1:] != lines[:-1]
    keep = ends[:-1] | ends[1:]
    starts = np.flatnonzero(ends)
    lo, hi = starts[:-1], starts[1:] - 1
    while True:
        wide = hi - lo >= 2
        lo, hi = lo[wide], hi[wide]
        if not len(lo):
            return keep
        size = hi - lo - 1
        first = np.concatenate(([0], np.cumsum(size)[:-1]))
        of = np.repeat(np.arange(len(lo)), size)
        at = np.arange(len(of)) - first[of] + lo[of] + 1
        dx, dy = (x[hi] - x[lo])[of], (y[hi] - y[lo])[of]
        px, py = x[at] - x[lo][of], y[at] - y[lo][of]
        length = dx * dx + dy * dy
        t = np.where(length > 0, np.clip((px * dx + py * dy) / np.where(length > 0, length, 1.0), 0.0, 1.0), 0.0)
        d = (px - t * dx) ** 2 + (py - t * dy) ** 2
        most = np.maximum.reduceat(d, first)
        top = np.flatnonzero(d == most[of])
        mid = at[top[np.unique(of[top], return_index=True)[1]]]
        far = most > tolerance * tolerance
        lo, hi, mid = lo[far], hi[far], mid[far]
        keep[mid] = True
        lo, hi = np.concatenate((lo, mid)), np.concatenate((mid, hi))


def deviating(y, x, tolerance):
    """Which vertices of one line stay: each interval keeps its farthest vertex while that exceeds ``tolerance``."""
    keep = np.zeros(len(y), bool)
    keep[[0, -1]] = True
    open_ = [(0, len(y) - 1)]
    while open_:
        lo, hi = open_.pop()
        if hi - lo < 2:
            continue
        dx, dy = x[hi] - x[lo], y[hi] - y[lo]
        px, py = x[lo + 1:hi] - x[lo], y[lo + 1:hi] - y[lo]
        length = dx * dx + dy * dy
        t = np.clip((px * dx + py * dy) / length, 0.0, 1.0) if length else np.zeros(len(px))
        d = (px - t * dx) ** 2 + (py - t * dy) ** 2
        k = int(np.argmax(d))
        if d[k] > tolerance * tolerance:
            mid = lo + 1 + k
            keep[mid] = True
            open_ += [(lo, mid), (mid, hi)]
    return keep
