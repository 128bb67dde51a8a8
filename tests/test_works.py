import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborframe.operators import annotations as an
from arborframe.operators import graph as gr
from arborframe.operators import kernels as ke
from arborframe.operators import resampling as rs
from arborframe.operators import spatial as sp
from arborframe.operators import topology as tp
from arborframe.operators import tree as t
from arborframe.operators import views as vi
from arborframe.sources import files, works


def random_tree(seed, n=60, skel=0):
    """Rows (skel, sid, parent, w, x, y, z), edge lengths by place."""
    r = random.Random(seed)
    place = [tuple(r.uniform(-9, 9) for _ in range(3)) for _ in range(n)]
    parent = [None] + [max(0, i - (1 if r.random() < 0.8 else r.randint(1, i))) for i in range(1, n)]
    return [(skel, i, p, 0.0 if p is None else float(np.linalg.norm(np.subtract(place[i], place[p]))), *place[i]) for i, p in enumerate(parent)]


SCHEMA = "skel_id long, sid long, parent long, w double, x double, y double, z double"


def resampled(rows, spacing, tip_ratio, avoid_root):
    """One tree, path by path, in plain numpy."""
    parent, w = {s: p for _, s, p, *_ in rows}, {r[1]: r[3] for r in rows}
    xyz = {r[1]: np.array(r[4:]) for r in rows}
    up = lambda v: [v] if parent[v] is None else [v, *up(parent[v])]
    dist = {v: sum(w[a] for a in up(v) if parent[a] is not None) for v in parent}
    tips = sorted(set(parent) - {p for p in parent.values() if p is not None}, key=lambda v: (dist[v], v), reverse=True)
    seen, cover = set(), []
    for tip in tips:
        cover.append([v for v in up(tip) if v not in seen])
        seen.update(cover[-1])
    cover.sort(key=lambda p: (sum(w[v] for v in p), p[0]), reverse=True)
    points, where = [], {}
    ordered = []
    for path in cover:
        top = parent[path[-1]]
        on = path if top is None or parent[top] is None else [*path, top]
        d = np.array([dist[v] for v in on])
        at = np.arange(0, 10_000) * spacing + d.min()
        at = at[(at < d.max()) | (np.arange(len(at)) == 0)]
        if top is None and avoid_root and len(d) > 1:
            at = at[(at > abs(d[-1] - d[-2]) * max(tip_ratio, 0.5)) | (at == 0)]
        new = np.column_stack([np.interp(at, d[::-1], [xyz[v][k] for v in on[::-1]]) for k in range(3)])
        middle = (d[::-1][1:] + d[::-1][:-1]) / 2
        base = [on[::-1][int(np.searchsorted(middle, a, side="right"))] for a in at]
        if np.linalg.norm(new[-1] - xyz[path[0]]) / spacing > tip_ratio and d.max() > at[-1]:
            at, new, base = np.append(at, d.max()), np.vstack([new, xyz[path[0]]]), [*base, path[0]]
        ordered.append((path, top, at, new, base))
    first = 0
    for path, _, at, _, _ in ordered:
        for v in path:
            where[v] = first + int(np.argmin(np.abs(at - dist[v])))
        first += len(at)
    for _, top, at, new, base in ordered:
        for i in range(len(at)):
            points.append((len(points), len(points) - 1 if i else where.get(top), at[i], *new[i], base[i]))
    return points


@pytest.mark.parametrize("spacing,tip_ratio,avoid_root", [(2.5, 0.5, True), (7.0, 0.25, True), (40.0, 0.5, True), (3.0, 0.5, False)])
def test_resampling_by_brute_force(spark, spacing, tip_ratio, avoid_root):
    trees = {k: random_tree(k, 60, k) for k in range(3)} | {3: [(3, 0, None, 0.0, 1.0, 2.0, 3.0)]}
    skel = spark.createDataFrame([r for rows in trees.values() for r in rows], SCHEMA)
    got = rs.resample(skel, t.Lifts(skel), spacing, tip_ratio, avoid_root).toPandas()
    for k, rows in trees.items():
        mine = got[got["skel_id"] == k].sort_values("sid")
        want = resampled(rows, spacing, tip_ratio, avoid_root)
        assert list(mine["sid"]) == [p[0] for p in want]
        assert [None if np.isnan(p) else int(p) for p in mine["parent"].astype(float)] == [p[1] for p in want]
        assert np.allclose(mine[["dist", "x", "y", "z"]].to_numpy(float), [p[2:6] for p in want]) and list(mine["base"]) == [p[6] for p in want]


@pytest.fixture(scope="module")
def work(spark):
    tree = spark.createDataFrame(random_tree(5), SCHEMA)
    m = spark.createDataFrame([(0, v, None if v % 11 == 0 else v // 3) for v in range(180)], "mesh_id long, vid long, sid long")
    vertex = m.select("mesh_id", "vid", *[(F.col("vid") * k % 17).cast("double").alias(n) for n, k in (("x", 3), ("y", 5), ("z", 7))])
    face = spark.createDataFrame([(0, i, i, i + 1, i + 2) for i in range(178)], "mesh_id long, fid long, a long, b long, c long")
    rows = spark.createDataFrame([(0, "s", i, float(i % 17), 2.0, 3.0, f"n{i}") for i in range(40)], "mesh_id long, anno string, row_id long, px double, py double, pz double, note string")
    anno = an.Annotations(vertex).add("post synapses / 1", rows, max_distance=4.0).add("free", rows, anchored=False)
    return an.Meshwork(vertex, tree, m, anno, face=face)


def table(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("masked", [False, True])
def test_a_saved_work_is_the_same_when_loaded(spark, work, tmp_path, masked):
    mask = work.vertex.filter("vid between 30 and 140").select("mesh_id", "vid")
    old = work.masked(mask) if masked else work
    works.save_work(old, f"{tmp_path}/w")
    new = works.load_work(spark, f"{tmp_path}/w")
    assert new.anno.names() == old.anno.names()
    for a, b in ((old.skeleton(), new.skeleton()), (old.mesh_vertices(), new.mesh_vertices()), (old.mapping(), new.mapping()), (old.face, new.face), *((old.anno[n], new.anno[n]) for n in old.anno.names())):
        assert table(a) == table(b)
    assert table(old.vertex) == table(new.masked(None).vertex), "the mask hides, and loses nothing"
    with pytest.raises(Exception, match="exist"):
        works.save_work(old, f"{tmp_path}/w")
    works.save_work(work, f"{tmp_path}/w", overwrite=True)
    assert works.load_work(spark, f"{tmp_path}/w").mask is None


def test_swc_of_a_work(work):
    ends = work.map.filter("sid = 3").select("mesh_id", "vid")
    radius = work.vertex.select("mesh_id", "vid", F.col("vid").cast("double").alias("value"))
    rows = works.work_swc_rows(work, {"axon": "post synapses / 1", "soma": ends}, radius, "max", 1.0).toPandas()
    axon = {r["sid"] for r in work.anno["post synapses / 1"].join(work.map, ["mesh_id", "vid"]).collect()} - {None}
    place = {(r["x"], r["y"], r["z"]): r["sid"] for r in work.tree.collect()}
    assert len(rows) == 60 and (rows["parent"] < rows["id"]).all() and (rows["parent"] == -1).sum() == 1
    for r in rows.itertuples():
        sid = place[r.x, r.y, r.z]
        assert r.label == (2 if sid in axon else 1 if sid == 3 else 3)
        assert r.radius == max(v for v in range(3 * sid, 3 * sid + 3) if v % 11)
    with pytest.raises(ValueError):
        works.work_swc_rows(work, {"tail": ends})


def test_topology_under_a_mask(work):
    part = work.masked(work.vertex.filter("vid >= 90").select("mesh_id", "vid"))
    parent = {r["sid"]: r["parent"] for r in part.skeleton().collect()}
    up = {r["vid"]: r["to"] for r in tp.parent_index(part, work.vertex, padded=True).collect()}
    assert set(up) == {v for v in range(90, 180) if v % 11}, "hidden and unmapped vertices get no answer"
    for v, to in up.items():
        p = parent[v // 3]
        assert to == (-1 if p is None else min(x for x in range(3 * p, 3 * p + 3) if x % 11 and x >= 90))
    near = {(r["of"], r["vid"]) for r in tp.within_distance(part, work.vertex, 12.0, collapse=False).collect()}
    assert {b for _, b in near} == {r["vid"] for r in tp.within_distance(part, work.vertex, 12.0).collect()} and all((b, a) in near for a, b in near)


def test_distance_along_the_mesh(spark, work):
    edges = gr.weighted_graph(gr.graph_edges(work.face), directed=False).withColumn("w", F.lit(1.0))
    pairs = spark.createDataFrame([(0, 0, 10), (0, 7, 7), (0, 5, 179)], "mesh_id long, a long, b long")
    got = {(r["a"], r["b"]): r["dist"] for r in tp.distance_between(work, pairs, gr.weighted_graph(edges.select("mesh_id", "src", "dst")).withColumn("w", F.lit(1.0))).collect()}
    assert got == {(0, 10): 5.0, (7, 7): 0.0, (5, 179): 87.0}


def test_far_points_of_a_tree_are_its_longest_way(spark):
    rows = random_tree(8, 40)
    e = spark.createDataFrame([x for _, s, p, w, *_ in rows if p is not None for x in ((0, s, p, w), (0, p, s, w))], "mesh_id long, src long, dst long, w double")
    far = gr.far_points(e, spark.createDataFrame([(0, 7)], "mesh_id long, vid long")).first()
    d = np.full((40, 40), np.inf)
    np.fill_diagonal(d, 0)
    for _, s, p, w, *_ in rows:
        if p is not None:
            d[s, p] = d[p, s] = w
    for k in range(40):
        d = np.minimum(d, d[:, [k]] + d[[k]])
    assert far["dist"] == pytest.approx(d.max()) and d[far["a"], far["b"]] == pytest.approx(d.max())


def test_views(spark):
    r = random.Random(4)
    place = {i: np.array([r.gauss(0, 5), r.gauss(0, 2), r.gauss(0, 1)]) for i in range(50)}
    v = spark.createDataFrame([(0, i, *map(float, p)) for i, p in place.items()], "mesh_id long, vid long, x double, y double, z double")
    views = sp.local_views(v, sp.as_points(v), 9)
    near = {i: sorted(sorted(place, key=lambda j: np.sum((place[i] - place[j]) ** 2))[:9]) for i in place}
    got = views.toPandas()
    assert {i: list(g.sort_values("pos")["vid"]) for i, g in got.groupby("pid")} == near
    for _, g in sp.aligned_views(views, v).toPandas().groupby("pid"):
        x, old = g[["x", "y", "z"]].to_numpy(), np.array([place[i] for i in g["vid"]])
        cov = np.cov(x.T)
        assert np.allclose(cov, np.diag(np.diag(cov)), atol=1e-8) and (np.diff(np.diag(cov)) <= 1e-9).all() and np.allclose(x.mean(0), 0)
        gaps = lambda a: np.linalg.norm(a[:, None] - a[None], axis=2)
        assert np.allclose(gaps(x), gaps(old)), "turned, not stretched"
    centres = [row["pid"] for row in vi.greedy_cover(views.select("mesh_id", "pid", "vid")).select("pid").distinct().collect()]
    assert set().union(*(near[c] for c in centres)) == set(place), "the chosen views hold every vertex"


def test_resampled_swc(spark):
    rows = [(k, i, None if i == 0 else (0 if i == 21 else i - 1), 0.0 if i == 0 else 10.0, float(10 * (i if i <= 20 else i - 20)), 0.0 if i <= 20 else 5.0, 0.0, None if i == 7 else 100.0 + i) for k in (0, 1) for i in range(31)]
    skel = spark.createDataFrame(rows, SCHEMA + ", radius double")
    paths = t.Lifts(skel.select("skel_id", "sid", "parent", "w"))
    labels = skel.select("skel_id", "sid", F.when(F.col("sid") > 20, 2).otherwise(3).alias("label"))
    got = files.resampled_swc_rows(skel, paths, 25.0, labels).collect()
    points = {(r["skel_id"], r["sid"]): r for r in rs.resample(skel, paths, 25.0).collect()}
    assert {(r["skel_id"], r["id"]) for r in got} == set(points) and len(got) == len(points)
    for r in got:
        p = points[r["skel_id"], r["id"]]
        assert r["parent"] == (-1 if p["parent"] is None else p["parent"]) < r["id"] and r["x"] == p["x"] / 1000
        assert r["label"] == (2 if p["base"] > 20 else 3) and r["radius"] == (1.0 if p["base"] == 7 else (100.0 + p["base"]) / 1000)
    # plain rows: numbers are dense, parents come first
    plain = files.swc_rows(skel, paths, labels).filter("skel_id = 1").orderBy("id").collect()
    assert [r["id"] for r in plain] == list(range(31)) and all(r["parent"] < r["id"] for r in plain)


def test_collapsed_tree_keeps_columns(spark):
    rows = [(0, 0, None, 0.0, "r"), (0, 1, 0, 0.0, "a"), (0, 2, 1, 3.0, "b"), (0, 3, 2, 0.0, "c"), (0, 4, 3, 0.0, "d"), (0, 5, 4, 2.0, "e"), (1, 0, None, 0.0, "f")]
    tree = spark.createDataFrame(rows, "skel_id long, sid long, parent long, w double, name string")
    assert sorted((tuple(r) for r in t.collapsed(tree).collect()), key=str) == [(0, 0, None, 0.0, "r"), (0, 2, 0, 3.0, "b"), (0, 5, 2, 2.0, "e"), (1, 0, None, 0.0, "f")]
