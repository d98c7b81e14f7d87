import numpy as np
import pytest
from pyspark.sql import functions as F

from blockwalk.llm import projection_passes, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"
ODD = [(900, None, 1), (901, [0.0] * 4, 1), (902, [1.0, None, 0.0, 0.0], 1), (903, [float("nan"), 1.0, 0.0, 0.0], 1), (904, [float("inf"), 1.0, 0.0, 0.0], 1),
       (905, [], 1), (906, [1.0, 0.0, 0.0, 0.0], None), (907, [1.0, 0.0], 1), (None, [0.5, 0.5, 0.5, 0.5], 2), (908, [0.5, 0.5, 0.5, 0.5], 2), (908, [0.5, 0.5, 0.5, 0.5], 2),
       (None, [0.1, 0.9, -0.3, 0.2], 2), (None, None, None)]


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], label) for i, v, label in rows], SCHEMA)


def brute_links(rows, threshold=0.93):
    """Per row: links and component, by all pairs of a label."""
    good = [k for k, (_, v, label) in enumerate(rows) if label is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    unit = {k: np.array(rows[k][1], dtype=np.float32).astype(float) for k in good}
    unit = {k: v / np.linalg.norm(v) for k, v in unit.items()}
    linked = {k: [j for j in good if j != k and rows[j][2] == rows[k][2] and len(unit[j]) == len(unit[k]) and unit[j] @ unit[k] >= threshold] for k in good}
    out = []
    for k, row in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in linked.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((row[0], len(linked.get(k, ())), least, row[0] == least))
    return sorted(out, key=str)


def clusters(rng, sizes, length, spread):
    """Rows around random centres; ``spread`` as a share of the centre's length."""
    rows = []
    for label, size in enumerate(sizes):
        centre = rng.normal(size=length)
        noise = rng.normal(size=(size, length)) * spread * np.linalg.norm(centre) / length ** 0.5
        rows += [(v, label % 3) for v in centre + noise]
    order = rng.permutation(len(rows))
    return [(int(k) * 7 % 100_003, list(np.float32(rows[k][0])), rows[k][1]) for k in order]


@pytest.mark.parametrize(("window", "block", "spread"), [(128, 512, 0.2), (8, 16, 0.2), (8, 16, 0.27), (8, 16, 0.08)])
def test_links_and_components(spark, window, block, spread):
    """Windows, partition edges, blocks and cores lose no link: clusters near, at and far inside the threshold, one with a third of the rows."""
    rng = np.random.default_rng(5)
    rows = clusters(rng, [150, 40, 30, 1, 1, 2, 60] + [1] * 150, 24, spread)
    rows += [(5_000_000 + k, rows[3][1], rows[3][2]) for k in range(80)]  # exact copies
    got = [tuple(r) for r in projection_passes.near_duplicates(vectors(spark, rows), window=window, block=block).collect()]
    assert sorted(got, key=str) == brute_links(rows)


def test_at_the_threshold(spark):
    c = [1.0, 0.0, 0.0], [0.93, (1 - 0.93 ** 2) ** 0.5, 0.0], [0.9299, (1 - 0.9299 ** 2) ** 0.5, 0.0]
    rows = spark.createDataFrame([(i, list(map(float, v)), 0) for i, v in enumerate(c)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in projection_passes.near_duplicates(rows).collect()}
    assert got[2] == 1 and got[0] in (0, 1) and got[0] + 1 == got[1]
    huge = spark.createDataFrame([(1, [1e300, 1e300], 0), (2, [1e-300, 1.1e-300], 0), (3, [-1e300, 1e300], 0)], "vec_id long, embedding array<double>, label int")
    assert sorted(tuple(r) for r in projection_passes.near_duplicates(huge).collect()) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_link_cases(spark):
    df = vectors(spark, ODD).withColumns({c: F.lit("clash") for c in ("id", "v", "copies", "root", "set_of", "key", "component_id", "own", "i", "mean")})
    got = sorted((tuple(r) for r in projection_passes.near_duplicates(df).collect()), key=str)
    want = [(i, n, least, kept or i is None and least is None) for i, n, least, kept in brute_links(ODD)]
    assert got == sorted(want, key=str)
    none = projection_passes.near_duplicates(vectors(spark, []))
    assert none.count() == 0 and none.columns == ["vec_id", "n_links", "component_id", "kept"]


def brute_white(rows):
    good = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v, _ in rows]
    fit = sorted({tuple(x) for _, x in good})
    n, length = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(length)]
    centred = np.array(fit) - np.array([s / n for s in sums])
    cov = centred.T @ centred / n
    values, turn = np.linalg.eigh(cov)
    k = min(4, length)
    values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
    out = {}
    for i, x in good:
        white = (np.array(x) - np.array([s / n for s in sums])) @ turn / np.sqrt(values)
        out.setdefault(i, []).append((n, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), np.abs(white), values / np.trace(cov)))
    return out


@pytest.mark.parametrize("length", [1, 3, 4, 40])
def test_whitening(spark, length):
    rng = np.random.default_rng(length)
    rows = [(i, list(np.float32(v)), i % 3) for i, v in enumerate(rng.normal(size=(150, length)) * np.linspace(1, 3, length))]
    rows += [(700, rows[0][1], 1), (700, rows[0][1], 1), (701, rows[1][1], None)]
    want = brute_white(rows)
    got = whitening.whitened(vectors(spark, rows).repartition(4)).toPandas()
    assert len(got) == len(rows) * min(4, length) and got["identity_error"].max() < 1e-9
    for (i, component), part in got.groupby(["vec_id", "component"]):
        for r in part.itertuples():
            n, deviation, white, explained = want[i][0]
            assert (r.n, r.deviation) == (n, deviation)
            assert abs(abs(r.whitened) - white[component - 1]) < 1e-8 and abs(r.explained - explained[component - 1]) < 1e-10
    signs = got[got["component"] == 1].sort_values("vec_id")["whitened"].to_numpy()
    assert (signs > 0).any() and (signs < 0).any()


def test_whitening_cases(spark):
    df = vectors(spark, ODD).withColumns({c: F.lit("clash") for c in ("x", "n", "component", "at", "line", "length", "v", "w0")})
    got = whitening.whitened(df).toPandas()
    assert sorted(got["vec_id"].dropna().unique()) == [901, 906, 908] and len(got) == 6 * 4 and got["n"].max() == 4
    assert whitening.whitened(vectors(spark, [])).count() == 0
    same = whitening.whitened(vectors(spark, [(1, [0.5, 0.25], 0), (2, [0.5, 0.25], 0)])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same] == [(1, 0, None, None, 0.0)] * 4
    far = spark.createDataFrame([(1, [2.0 ** 40]), (2, [-2.0 ** 40]), (3, [0.0])], "vec_id long, embedding array<double>")
    assert [r["deviation"] for r in whitening.whitened(far).orderBy("vec_id").collect()] == [None, None, 0]


@pytest.mark.parametrize("values", [[5, 5, 5, 5, 5] + [1] * 15, [9, 5, 5, 1] + [0] * 16, [3] + [0] * 19, [7, 7 * (1 - 1e-9), 7 * (1 - 2e-9), 2] + [1] * 16, [2] * 20, [1e-20] * 3 + [0] * 17])
def test_slices_with_equal_eigenvalues(values):
    rng = np.random.default_rng(3)
    turn = np.linalg.qr(rng.normal(size=(20, 20)))[0]
    a = (turn * np.array(values, dtype=float)) @ turn.T
    a = (a + a.T) / 2
    found, vectors_ = whitening.leading(a)
    scale = max(values)
    assert np.abs(found - np.linalg.eigvalsh(a)[::-1][:4]).max() < 1e-13 * scale
    assert np.abs(vectors_.T @ vectors_ - np.eye(4)).max() < 1e-12 and np.abs(a @ vectors_ - vectors_ * found).max() < 1e-12 * scale


def test_inertia_counts():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 17, 40):
        a = rng.normal(size=(n, n))
        a = a + a.T
        values = np.linalg.eigvalsh(a)
        for shift in [*(values[:-1] + values[1:]) / 2, values[0] - 1, values[-1] + 1, 0.0, *(values + 1e-9)]:
            assert whitening.above(a, shift) == (values > shift).sum()
    assert [whitening.above(np.diag([3.0, 2, 1, 1, 0]), s) for s in (-1, 0, 1, 2, 3)] == [5, 4, 2, 1, 0]
    assert whitening.above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1
