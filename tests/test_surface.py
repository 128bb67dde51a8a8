import numpy as np
import pytest

from arborframe.operators import surface as s

V = "mesh_id long, vid long, x double, y double, z double"
FACE = "mesh_id long, fid long, a long, b long, c long"


def mesh(seed, n=60, m=80, long=True):
    """Scattered triangles; a third of them long and thin, one across everything."""
    r = np.random.default_rng(seed)
    x = r.uniform(-50, 50, (n, 3))
    tri = []
    for _ in range(m):
        a = int(r.integers(n))
        near = np.argsort(((x - x[a]) ** 2).sum(1))[1:6]
        b, c = r.choice(near, 2, replace=False)
        tri.append((a, int(b), int(c)))
    if long:
        x = np.concatenate([x, r.uniform(-400, 400, (10, 3))])
        tri += [(int(r.integers(n)), int(r.integers(n)), n + k) for k in range(10)] + [(n, n + 1, n + 2)]
    return x, np.array(tri)


def tables(spark, meshes):
    v = [(k, i, *map(float, p)) for k, (x, _) in meshes.items() for i, p in enumerate(x)]
    f = [(k, i, *map(int, t)) for k, (_, tri) in meshes.items() for i, t in enumerate(tri)]
    return spark.createDataFrame(v, V).repartition(3), spark.createDataFrame(f, FACE).repartition(3)


def distance2(p, a, b, c):
    """Of a point from a triangle, by minimising over barycentric coordinates on every face of the simplex."""
    best = min(((p - q) ** 2).sum() for q in (a, b, c))
    for u, v in ((a, b), (b, c), (a, c)):
        d = v - u
        if d @ d > 0 and 0 < (t := (p - u) @ d / (d @ d)) < 1:
            best = min(best, ((p - u - t * d) ** 2).sum())
    m = np.column_stack([b - a, c - a])
    w, *_ = np.linalg.lstsq(m, p - a, rcond=None)
    if w.min() > 0 and w.sum() < 1:
        best = min(best, ((p - a - m @ w) ** 2).sum())
    return best


def test_closest_by_search():
    r = np.random.default_rng(0)
    p, a, b, c = r.uniform(-1, 1, (4, 400, 3))
    b[:40], c[40:80], c[80:120] = a[:40], a[40:80], (a[80:120] + b[80:120]) / 2  # no area
    c[120:160] = a[120:160] + 1e-4 * (c[120:160] - a[120:160])  # thin
    got = ((s.closest(p, a, b, c) - p) ** 2).sum(1)
    assert np.allclose(got, [distance2(*x) for x in zip(p, a, b, c, strict=True)], rtol=1e-6, atol=1e-12)


def test_cover_leaves_no_point_out():
    r = np.random.default_rng(1)
    tri = r.uniform(0, 30, (50, 3, 3))
    tri[:10, 2] = tri[:10, 0] + 0.01
    row, level, cell = s.cover(tri, np.full(50, 1.0))
    have = set(zip(row.tolist(), *cell.T.tolist(), strict=True))
    assert np.bincount(row).max() < 4 * s.PIECES
    for _ in range(200):
        w = r.dirichlet([1, 1, 1], 50)
        q = (w[:, :, None] * tri).sum(1)
        lv = np.array([level[row == i][0] for i in range(50)])
        assert {(i, *c) for i, c in enumerate(np.floor(q / 2.0 ** lv[:, None]).astype(int).tolist())} <= have


@pytest.mark.parametrize("long", [False, True])
def test_nearest_by_all_triangles(spark, long):
    meshes = {k: mesh(k, long=long) for k in (0, 4)}
    v, f = tables(spark, meshes)
    r = np.random.default_rng(9)
    pts = [(k, i, *map(float, p)) for k in (0, 4, 8) for i, p in enumerate(np.concatenate([r.uniform(-60, 60, (40, 3)), r.uniform(-3000, 3000, (10, 3)), meshes[0][0][:5]]))]
    points = spark.createDataFrame(pts, "mesh_id long, pid long, px double, py double, pz double")
    want = {}
    for k, i, *p in pts:
        if k in meshes:
            x, tri = meshes[k]
            want[k, i] = min(distance2(np.array(p), *x[t]) for t in tri)
    got = s.nearest(points, v, f).collect()
    assert {(g["mesh_id"], g["pid"]) for g in got} == set(want) and len(got) == len(want)
    for g in got:
        x, tri = meshes[g["mesh_id"]]
        t, p = tri[g["fid"]], np.array([q[2:] for q in pts if q[:2] == (g["mesh_id"], g["pid"])][0])
        assert np.isclose(g["d2"], want[g["mesh_id"], g["pid"]], rtol=1e-7, atol=1e-7) and g["a"] == t[0]
        assert np.isclose(((p - [g["qx"], g["qy"], g["qz"]]) ** 2).sum(), g["d2"], atol=1e-7) and np.isclose(distance2(np.array([g["qx"], g["qy"], g["qz"]]), *x[t]), 0, atol=1e-7)
    near = {(g["mesh_id"], g["pid"]) for g in s.nearest(points, v, f, max_distance=20.0).collect()}
    assert near == {k for k, d in want.items() if d <= 400.0}
    assert s.nearest(points, v, f.limit(0)).count() == 0


def test_along_by_fine_steps():
    r = np.random.default_rng(2)
    o, d = r.uniform(-3, 3, (30, 3)), r.standard_normal((30, 3))
    d[:5, 0] = 0
    row, cell = s.along(o, d, np.zeros(30), np.full(30, 4.0))
    have = set(zip(row.tolist(), *cell.T.tolist(), strict=True))
    t = np.linspace(0, 4, 5001)
    for i in range(30):
        steps = np.floor(o[i] + t[:, None] * d[i]).astype(int)
        assert {(i, *c) for c in steps.tolist()} <= have
        mine = cell[row == i]
        assert (np.abs(np.diff(mine, axis=0)).sum(1) >= 1).all() and (mine[0] == steps[0]).all()


@pytest.mark.parametrize("long", [False, True])
def test_rays_by_all_triangles(spark, long, monkeypatch):
    monkeypatch.setattr(s, "FIRST_CELLS", 1)
    meshes = {k: mesh(k + 20, long=long) for k in (0, 4)}
    v, f = tables(spark, meshes)
    r = np.random.default_rng(3)
    rays, want = [], {}
    for k, (x, tri) in meshes.items():
        for vid in range(len(x)):
            dirs = [*r.standard_normal((3, 3)), [1.0, 0, 0], [0, 0, -1.0], x[tri[int(r.integers(len(tri)))]].mean(0) - x[vid]]
            for i, d in enumerate(dirs):
                rays.append((k, vid, i, *map(float, d), 0.5))
                t = tri[~(tri == vid).any(1)]
                m = len(t)
                found = s.hit(np.tile(x[vid], (m, 1)), np.tile(np.array(d, float), (m, 1)), x[t[:, 0]], x[t[:, 1]], x[t[:, 2]])
                want[k, vid, i] = None if np.isnan(found).all() else float(np.nanmin(found))
    taken = []
    rays += [(0, 0, 99, 0.0, 0.0, 0.0, 0.5), (7, 0, 0, 1.0, 0.0, 0.0, 0.5)]
    v = v.union(spark.createDataFrame([(7, 0, 0.0, 0.0, 0.0)], V))
    got = s.first_hits(v, f, spark.createDataFrame(rays, "mesh_id long, vid long, i long, x double, y double, z double, angle double").repartition(4), taken).collect()
    want |= {(0, 0, 99): None, (7, 0, 0): None}
    assert {(g["mesh_id"], g["vid"], g["i"]): g["dist"] for g in got} == want and len(got) == len(want) and taken[0] > 1
    assert sum(d is not None for d in want.values()) > 50


def test_rays_take_their_numbers_along():
    """A round is one shuffle of rays to cells; cells of many triangles are met in parts, and triangles carried from batch to batch."""
    import pyarrow as pa

    r = np.random.default_rng(7)
    cells, names = [], ["kind", "mesh_id", "level", "cx", "cy", "cz", "vid", "i", *"xyz", "px", "py", "pz", *"abc", *s._PLACES]
    for c in range(6):
        tri = [(0, 1, 0, c, 0, 0, *[None] * 8, *(int(v) for v in r.integers(2**60, 2**60 + 5, 3)), *map(float, r.uniform(-1, 1, 9))) for _ in range((0, 1, 40, 3, 0, 7)[c])]
        rays = [(1, 1, 0, c, 0, 0, 2**60 + int(r.integers(5)), k, *map(float, r.uniform(-1, 1, 6)), *[None] * 12) for k in range((3, 0, 50, 4, 5, 9)[c])]
        cells += tri + rays
    want = {}
    for q in cells:
        if q[0] == 1:
            t = [u for u in cells if u[0] == 0 and u[3] == q[3] and q[6] not in u[14:17]]
            found = [s.hit(*(np.array([v], float) for v in (q[11:14], q[8:11], u[17:20], u[20:23], u[23:26])))[0] for u in t]
            if np.isfinite(found).any():
                want[q[3], q[6], q[7]] = float(np.nanmin(found))
    kinds = ["int", "long", "int", "long", "long", "long", "long", "long", *["double"] * 6, *["long"] * 3, *["double"] * 9]
    schema = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[k]) for n, k in zip(names, kinds, strict=True)])
    old, s.MET = s.MET, 17
    try:
        for size in (1, 7, 1000):
            batches = [pa.RecordBatch.from_pylist([dict(zip(names, q, strict=True)) for q in cells[i : i + size]], schema) for i in range(0, len(cells), size)]
            got = [g for b in s._meet(iter(batches)) for g in b.to_pylist()]
            assert sorted((g["vid"], g["i"], g["dist"]) for g in got) == sorted((v, i, d) for (_, v, i), d in want.items())
    finally:
        s.MET = old
    assert len(want) > 10
