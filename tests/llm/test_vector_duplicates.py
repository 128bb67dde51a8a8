import numpy as np
import pytest

from arborframe.llm import vector_duplicates as v


def brute(rows, t=v.THRESHOLD):
    """(id, links, component, kept) by comparing all pairs."""
    def good(x):
        return x is not None and len(x) > 0 and all(c is not None and np.isfinite(c) for c in x) and any(x)

    n, near = len(rows), []
    for i in range(n):
        for j in range(n):
            (_, a, la), (_, b, lb) = rows[i], rows[j]
            if i != j and good(a) and good(b) and la is not None and la == lb and len(a) == len(b):
                p, q = np.array(a, float), np.array(b, float)
                p, q = p / np.abs(p).max(), q / np.abs(q).max()
                if p @ q / np.sqrt((p @ p) * (q @ q)) >= t:
                    near.append((i, j))
    root = list(range(n))
    for _ in range(n):
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
    least = {}
    for i in range(n):
        ids = [rows[k][0] for k in range(n) if root[k] == root[i] and rows[k][0] is not None]
        least[i] = min(ids) if ids else None
    return sorted(((rows[i][0], sum(a == i for a, _ in near), least[i], rows[i][0] == least[i]) for i in range(n)), key=str)


def got(df, **options):
    return sorted((tuple(r) for r in v.near_vectors(df, **options).select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


SCHEMA = "vec_id long, embedding array<float>, label int"


def clusters(seed, sizes, spread, dim=16, labels=3):
    r, out = np.random.default_rng(seed), []
    for size in sizes:
        centre, label = r.standard_normal(dim), int(r.integers(labels))
        out += [((centre + spread * r.standard_normal(dim)).astype(np.float32).tolist(), label) for _ in range(size)]
    return [(int(k), *out[i]) for i, k in enumerate(r.permutation(len(out)))]


@pytest.mark.parametrize("spread", [0.05, 0.2, 0.32])
def test_by_all_pairs(spark, spread):
    # the wider the clusters, the more pairs are near the threshold, and the more the bounds of large components leave open
    rows = clusters(int(spread * 100), [1] * 40 + [2] * 10 + [5] * 4 + [60, 90], spread)
    assert got(spark.createDataFrame(rows, SCHEMA), tile=16) == brute(rows)


def test_ranges_and_borders(spark, monkeypatch):
    monkeypatch.setattr(v, "RANGE_ROWS", 40)
    monkeypatch.setattr(v, "BORDER_ROWS", 200)
    monkeypatch.setattr(v, "ROWS_AT_ONCE", 1)
    rows = clusters(5, [1] * 100 + [3] * 20 + [40], 0.08, labels=1)
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(5), window=4, tile=8) == brute(rows)


def test_edges(spark):
    a = [1.0, 2.0, 3.0]
    rows = [
        (1, a, 1), (1, a, 1), (2, [2.0, 4.0, 6.0], 1), (3, a, 2), (4, a, None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0, 0.0], 1), (8, [1.0, None, 3.0], 1), (9, [float("nan"), 2.0, 3.0], 1),
        (10, [float("inf"), 1.0, 1.0], 1), (None, a, 1), (11, [1.0, 2.0], 1), (12, [-1.0, -2.0, -3.0], 1), (None, [5.0, -1.0, 0.0], 3), (13, [0.0, -0.0, 1.0], 4), (14, [-0.0, 0.0, 1.0], 4), (None, None, None),
        (15, [1e200, 2e200, 3e200], 1), (16, [1e-200, 2e-200, 3e-200], 1),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as n_links", "2 as node", "'x' as `a.b`", "3 as root")
    assert got(df) == brute(rows)
    assert got(df.limit(0)) == []
    named = v.near_vectors(df.drop("n_links").withColumnRenamed("vec_id", "n_links"), key="n_links")
    assert named.columns == ["n_links", "n_links_", "component_id", "kept"] and named.count() == len(rows)


def test_chains():
    r = np.random.default_rng(1)
    i, j = r.integers(0, 200, (2, 150))
    least = v.chains(200, i, j)
    want = np.arange(200)
    for _ in range(200):
        for a, b in zip(i, j, strict=True):
            want[a] = want[b] = min(want[a], want[b])
    assert (least == want).all()


def test_passes_see_pairs_at_the_threshold():
    """Of 300 pairs at just the threshold among 3000 vectors, as many are found as the number of passes promises."""
    r = np.random.default_rng(3)
    x = r.standard_normal((3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(0, 600, 2):
        d = x[k + 1] - (x[k + 1] @ x[k]) * x[k]
        x[k + 1] = v.THRESHOLD * x[k] + np.sqrt(1 - v.THRESHOLD**2) * d / np.linalg.norm(d)
    seen = np.zeros(300, bool)
    for t in range(v.passes_for(3000, v.THRESHOLD, v.WINDOW, v.MISS)):
        bits = (x @ np.random.default_rng([11, t]).standard_normal((32, v.BITS)) > 0) @ (1 << np.arange(v.BITS - 1, -1, -1))
        place = np.argsort(np.argsort(bits))
        seen |= np.abs(place[0:600:2] - place[1:600:2]) <= v.WINDOW
    assert seen.mean() >= 0.999
