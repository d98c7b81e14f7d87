"""The walk through irregular clusters against its definition, and its cost on large ones."""

import time

import numpy as np
import pytest

from blockwalk.operators import kernels


def plain_walk(lat, lng, start, passes=40):
    left, path, at = np.ones(len(lat), bool), [start], start
    left[start] = False
    for _ in range(len(lat) - 1):
        cand = np.nonzero(left)[0]
        at = int(cand[np.argmin(kernels.flat_m(lat[at], lng[at], lat[cand], lng[cand]))])
        left[at] = False
        path.append(at)
    n = len(path)
    if n <= 3:
        return path
    metres = lambda a, b: float(kernels.flat_m(lat[a], lng[a], lat[b], lng[b]))
    for _ in range(passes):
        found = None
        hop = [metres(a, b) for a, b in zip(path[:-1], path[1:], strict=True)]
        for i in range(n - 2):
            for j in range(i + 2, n - 1):
                if metres(path[i], path[j]) + metres(path[i + 1], path[j + 1]) + 0.01 < hop[i] + hop[j]:
                    found = i, j
                    break
            if found:
                break
        if not found:
            break
        i, j = found
        path[i + 1:j + 1] = path[i + 1:j + 1][::-1]
    return path


def shapes(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.choice([1, 2, 3, 4, 7, 30, 90]))
    kind = seed % 6
    if kind == 0:
        y, x = rng.random(n), rng.random(n)
    elif kind == 1:  # blobs far apart
        y, x = rng.random(n) * 0.05 + rng.integers(0, 3, n), rng.random(n) * 0.05 + rng.integers(0, 3, n)
    elif kind == 2:  # a lattice: every distance occurs many times
        y, x = rng.integers(0, 6, n) * 0.1, rng.integers(0, 6, n) * 0.1
    elif kind == 3:  # a line
        y, x = np.zeros(n), rng.random(n)
    elif kind == 4:  # one spot
        y, x = np.zeros(n), np.zeros(n)
    else:  # a pile and stragglers
        y, x = np.where(rng.random(n) < 0.7, 0.5, rng.random(n)), np.where(rng.random(n) < 0.7, 0.5, rng.random(n))
    return 26 + y * 0.004, 80 + x * 0.004


@pytest.mark.parametrize("seed", range(48))
def test_walk_equals_its_definition(seed):
    lat, lng = shapes(seed)
    start = seed % len(lat)
    assert kernels.walk_order(lat, lng, start).tolist() == plain_walk(lat, lng, start)


@pytest.mark.parametrize("n", [200, 500])
def test_larger_clusters(n):
    rng = np.random.default_rng(n)
    lat, lng = 26 + rng.random(n) * 0.003, 80 + rng.random(n) * 0.003
    got, passes = kernels.nearest_walk(lat, lng, 0).tolist(), 3
    assert got == plain_walk(lat, lng, 0, 0) and kernels.walk_order(lat, lng, 0, passes).tolist() == plain_walk(lat, lng, 0, passes)


def test_cost_grows_with_the_houses():
    took = []
    for n in (4_000, 16_000):
        rng = np.random.default_rng(n)
        lat, lng = 26 + rng.random(n) * n ** 0.5 * 1e-4, 80 + rng.random(n) * n ** 0.5 * 1e-4
        began = time.process_time()
        path = kernels.walk_order(lat, lng, 0)
        took.append(time.process_time() - began)
        assert sorted(path.tolist()) == list(range(n))
    assert took[1] < 10 * took[0] and took[1] < 60


@pytest.mark.parametrize("seed", range(24))
def test_short_forms_equal_the_forms_by_cells(seed, monkeypatch):
    lat, lng = shapes(seed)
    y, x, start = lat * 111320.0, lng * 111320.0, seed % len(lat)
    results = lambda: [f.tolist() for f in (kernels.walk_order(lat, lng, start), kernels.nearest_gaps(lat, lng),
                                            *(kernels.single_link(y, x, r) for r in (0.0, 15.0, 60.0)))]
    short = results()
    monkeypatch.setattr(kernels, "TABLE_POINTS", 0)
    monkeypatch.setattr(kernels, "AXIS_POINTS", 0)
    assert results() == short


def test_blocks_of_small_clusters_cost_little():
    """Python calls for one block of 180 houses, its irregular clusters walked (15 000 by cells)."""
    import sys

    import pandas as pd

    from blockwalk.operators import ordering

    key = np.arange(180)
    rows = pd.DataFrame({"id": key, "pos": key, "lat": 26 + (key * 7919 % 1000) / 2e5, "lng": 80 + ((key * key * 37 + key * 11) % 997) / 2e5})
    calls = [0]

    def count(frame, event, arg):
        calls[0] += event in ("call", "c_call")

    walked = ordering._cluster_block(rows)
    assert (~walked["regular"]).sum() > 20
    sys.setprofile(count)
    try:
        ordering._cluster_block(rows)
    finally:
        sys.setprofile(None)
    assert calls[0] < 4500
