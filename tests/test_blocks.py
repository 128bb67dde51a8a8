import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborframe.functions import geometry as g
from arborframe.operators import blocks as b
from arborframe.operators import graph as gr
from arborframe.operators import paths as pa


def ways(n, edges, sources, limit=np.inf):
    """Distances from a set of sources and the smallest predecessor on a shortest way, by plain Dijkstra."""
    dist = {s: 0.0 for s in sources}
    heap, pred = [(0.0, s) for s in sources], {s: None for s in sources}
    out = {}
    for u, v, w in edges:
        out.setdefault(u, []).append((v, w))
    while heap:
        d, u = heapq.heappop(heap)
        if d > dist[u]:
            continue
        for v, w in out.get(u, []):
            if d + w <= limit and d + w < dist.get(v, np.inf):
                dist[v] = d + w
                heapq.heappush(heap, (d + w, v))
    for u, v, w in edges:
        if u in dist and v in dist and v not in sources and dist[u] + w == dist[v]:
            pred[v] = min(u, pred.get(v, n))
    return {(v, d, pred[v]) for v, d in dist.items()}


def graph(seed, n=120, m=320):
    r = np.random.default_rng(seed)
    a, c, w = r.integers(0, n, m), r.integers(0, n, m), r.integers(1, 9, m)
    return n, sorted({(int(x), int(y)): float(z) for x, y, z in zip(a, c, w, strict=True) if x != y}.items())


@pytest.mark.parametrize(("size", "limit"), [(1000, None), (7, None), (7, 9.0), (1, 6.0)])
def test_ways(spark, size, limit):
    rows, want = [], set()
    for mesh in (0, 3):
        n, e = graph(mesh)
        flat = [(u, v, w) for (u, v), w in e]
        rows += [(mesh, *x) for x in flat]
        for source, at in ((0, [5]), (1, [7, 60, 61]), (2, [999])):
            want |= {(mesh, source, *x) for x in ways(n, flat, at, np.inf if limit is None else limit)}
    df = spark.createDataFrame(rows, "mesh_id long, src long, dst long, w double")
    sources = spark.createDataFrame([(m, s, v) for m in (0, 3) for s, v in ((0, 5), (1, 7), (1, 60), (1, 61), (2, 999), (0, 5))], "mesh_id long, source long, vid long")
    vids = df.select("mesh_id", F.col("src").alias("vid")).union(df.select("mesh_id", "dst")).distinct()
    taken = []
    got = b.shortest_paths(df, sources, limit, vids.select("mesh_id", "vid", b.id_block("vid", size).alias("block")), taken=taken)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert taken[0] == 1 if size == 1000 else taken[0] > 1


def test_rounds_follow_blocks_not_hops(spark):
    n = 600
    line = spark.range(n - 1).select(F.lit(0).cast("long").alias("mesh_id"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("w"))
    vertex = spark.range(n).select(F.lit(0).cast("long").alias("mesh_id"), F.col("id").alias("vid"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    blocks = b.spatial_blocks(vertex, 160).cache()
    assert blocks.count() == n and blocks.groupBy("block").count().agg(F.max("count"), F.count("*")).first()[:] == (150, 4)
    taken = []
    got = b.shortest_paths(line, spark.createDataFrame([(0, 0, 0)], "mesh_id long, source long, vid long"), blocks=blocks, taken=taken)
    assert got.agg(F.sum("dist")).first()[0] == n * (n - 1) / 2 and taken == [4]


def test_blocks_of_one_place(spark):
    vertex = spark.range(50).select(F.lit(1).cast("long").alias("mesh_id"), F.col("id").alias("vid"), *[F.lit(2.0).alias(k) for k in "xyz"])
    got = b.spatial_blocks(vertex, 10).groupBy("block").count().collect()
    assert sorted(r["count"] for r in got) == [10] * 5


def test_geodesic_from_points(spark):
    vertex = spark.createDataFrame([(0, i, float(i), 0.0, 0.0) for i in range(10)], "mesh_id long, vid long, x double, y double, z double")
    edges = spark.createDataFrame([(0, i, i + 1, 1.0) for i in range(9)], "mesh_id long, src long, dst long, w double")
    points = spark.createDataFrame([(0, 0, 2.1, 1.0, 0.0), (0, 1, 7.0, 5.0, 0.0)], "mesh_id long, pid long, px double, py double, pz double")
    ids = lambda df: sorted(r["vid"] for r in df.collect())
    assert ids(gr.geodesic_near_points(vertex, edges, points, 1.0)) == [2, 3, 7, 8]
    assert ids(gr.geodesic_near_points(vertex, edges, points, 1.0, max_valid_mapping=2.0)) == [2, 3]
    assert ids(gr.geodesic_near_points(vertex, edges, points, 1.0, max_valid_mapping=5.0)) == [2, 3]  # nearer, not as near
    both = gr.weighted_graph(edges.withColumnRenamed("w", "v"), F.col("v"), directed=False)
    assert ids(gr.two_point_ellipse_of_points(vertex, both, points, 2.5)) == [1, 2, 3, 4, 5, 6, 7, 8]


def test_path_distances_on_the_mesh(spark):
    """By all-pairs distances, with radii that differ and a path that nothing reaches."""
    n, e = graph(8, 60, 130)
    e = {(u, v): w for (u, v), w in e} | {(v, u): w for (u, v), w in e}
    far = np.full((n, n), np.inf)
    np.fill_diagonal(far, 0)
    for (u, v), w in e.items():
        far[u, v] = w
    for k in range(n):
        far = np.minimum(far, far[:, k : k + 1] + far[k])
    r = np.random.default_rng(5)
    tips = {1: (list(r.permutation(n)[:7]), list(r.permutation(n)[:4])), 2: ([3, 9, 3 + n], [50]), 7: ([4], [2 * n])}
    rows = [(0, t, side, i, int(v)) for t, both in tips.items() for side, path in zip(("tree", "mesh"), both, strict=True) for i, v in enumerate(path)]
    pairs = spark.createDataFrame(rows, "mesh_id long, tip long, side string, pos int, vid long")
    radius = {v: float(40 + 7 * v) for v in range(n) if v % 5}
    got = pa.path_distances_on_mesh(pairs, spark.createDataFrame([(0, u, v, w) for (u, v), w in e.items()], "mesh_id long, src long, dst long, w double"), spark.createDataFrame([(0, v, x) for v, x in radius.items()], "mesh_id long, vid long, radius double"), limit=9.0)
    want = {}
    for t, (tree, mesh) in tips.items():
        for i, v in enumerate(tree):
            d = min((far[m, v] if m < n and v < n else (0.0 if m == v else np.inf)) for m in mesh)
            want[t, i] = (d if d <= 9.0 else np.inf) / max(50.0, radius.get(int(v), 50.0))
    assert {(x["tip"], x["pos"]): x["v"] for x in got.collect()} == want and np.isinf(want[7, 0]) and len(set(want.values())) > 4
    # scores in one window: of a bin's odds, and beyond the last edge as in the last bin
    score = g.histogram_score(got, ["mesh_id", "tip"], [1.0] + [0.0] * 13 + [-5.0], 1.0).collect()
    assert {x["tip"]: x["score"] for x in score} == {t: float(np.mean([1.0 if want[t, i] < 1 else -5.0 if want[t, i] >= 14 else 0.0 for i in range(len(tree))])) for t, (tree, _) in tips.items()}


@pytest.fixture
def line(spark, monkeypatch):
    """A line of 40 vertices whose ids are all in blocks of their own, and the rounds that shortest_paths takes on it."""
    rounds: list[int] = []
    plain = b.shortest_paths
    monkeypatch.setattr(gr, "shortest_paths", lambda *args, **options: plain(*args, **options, taken=rounds))
    place = np.random.default_rng(5).permutation(40)
    vid = [int(k) * b.BLOCK for k in place]
    vertex = spark.createDataFrame([(0, v, 100 * i, 0, 0) for i, v in enumerate(vid)], "mesh_id long, vid long, x long, y long, z long")
    e = [(0, u, v, 1.0) for u, v in zip(vid[:-1], vid[1:], strict=True)]
    edges = spark.createDataFrame(e + [(m, v, u, w) for m, u, v, w in e], "mesh_id long, src long, dst long, w double")
    return vid, vertex, edges, rounds


def test_two_points_of_any_ids(spark, line):
    vid, vertex, edges, rounds = line
    foci = spark.createDataFrame([(0, 0, 1000, 10, 0), (0, 1, 1900, -10, 0)], "mesh_id long, pid long, px long, py long, pz long")
    got = gr.two_point_ellipse_of_points(vertex, edges, foci, 2.0)
    assert sorted(r["vid"] for r in got.collect()) == sorted(vid[10:20])
    assert gr.geodesic_near_points(vertex, edges, foci, 3).count() == 7 + 7
    assert max(rounds) == 1


def test_far_points_of_any_ids(line):
    vid, vertex, edges, rounds = line
    got = gr.far_points(edges, vertex.filter(f"vid = {vid[12]}").select("mesh_id", "vid"), b.spatial_blocks(vertex)).collect()
    assert [({r["a"], r["b"]}, r["dist"]) for r in got] == [({vid[0], vid[-1]}, 39.0)]
    assert max(rounds) == 1


def bounce(n, edges, at):
    """From the farthest vertex to the farthest, the least id of equally far ones, until it gets no farther."""
    best = None
    while True:
        far = min(ways(n, edges, [at]), key=lambda r: (-r[1], r[0]))
        if best is not None and far[1] <= best[2]:
            return best
        best, at = (at, far[0], far[1]), far[0]


def test_far_points_go_by_themselves(spark, monkeypatch):
    """Starts of one mesh and of others: some get farther when others no longer do, one is alone, one can't go back."""
    calls = []
    plain = b.shortest_paths
    monkeypatch.setattr(gr, "shortest_paths", lambda *args, **options: calls.append(0) or (plain(*args, **options) if len(calls) < 9 else pytest.fail("goes on and on")))
    wheel = [(i, (i + 1) % 30, 1.0 + i % 4) for i in range(30)] + [(5, 31, 3.5), (31, 32, 3.5), (17, 33, 4.5)]
    line = [(40, 41, 5.0), (41, 42, 1.0), (42, 43, 1.0)]
    both = [(0, *e) for u, v, w in wheel + line for e in ((u, v, w), (v, u, w))] + [(0, 50, 51, 9.0)]
    edges = both + [(3, u + 7, v + 7, w) for m, u, v, w in both]
    starts = [(0, 2), (0, 8), (0, 41), (0, 50), (0, 60), (3, 19), (3, 48), (3, 57)]
    got = gr.far_points(spark.createDataFrame(edges, "mesh_id long, src long, dst long, w double"), spark.createDataFrame(starts, "mesh_id long, vid long"))
    want = [(m, *bounce(100, [e[1:] for e in edges if e[0] == m], v)) for m, v in starts]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert {w[1:] for w in want} >= {(50, 51, 9.0), (60, 60, 0.0)} and len(calls) > 2


def test_a_far_point_is_kept(spark):
    """Where another mesh goes on, a way that leads back no farther doesn't replace the longer one."""
    rows = [(0, 0, 1, 5.0)] + [(1, u, v, 1.0) for i in range(9) for u, v in ((i, i + 1), (i + 1, i))]
    got = gr.far_points(spark.createDataFrame(rows, "mesh_id long, src long, dst long, w double"), spark.createDataFrame([(0, 0), (1, 4)], "mesh_id long, vid long"))
    assert sorted(tuple(r) for r in got.collect()) == [(0, 0, 1, 5.0), (1, 9, 0, 9.0)]


def test_far_points_of_all_components(spark, sf):
    """The query: a row for each component of each mesh, from its least vertex."""
    from arborframe.plans import QUERIES
    from arborframe.plans import fixtures as fx

    place = {(r["mesh_id"], r["vid"]) for r in fx.points(spark, sf).select("mesh_id", "vid").collect()}
    weight = {}
    for r in fx.edges(spark, sf).filter("src <> dst").collect():
        for u, v in ((r["src"], r["dst"]), (r["dst"], r["src"])):
            weight[r["mesh_id"], u, v] = weight.get((r["mesh_id"], u, v), 0.0) + r["w"]
    mesh = {}
    for (m, u, v), w in weight.items():
        mesh.setdefault(m, []).append((u, v, w))
    want, seen = [], set()
    for m, v in sorted(place):
        if (m, v) not in seen:
            seen |= {(m, r[0]) for r in ways(500, mesh.get(m, []), [v])}
            want.append((m, *bounce(500, mesh.get(m, []), v)))
    assert seen == place and len(want) > 10
    assert sorted(tuple(r) for r in QUERIES["graph_far_points"](spark, sf).collect()) == sorted(want)


def test_path_quality_of_any_ids(spark, line):
    vid, vertex, edges, rounds = line
    pairs = spark.createDataFrame([(0, vid[0], side, i, vid[at]) for side, up in (("tree", 0), ("mesh", 3)) for i, at in enumerate(range(up, up + 9))], "mesh_id long, tip long, side string, pos int, vid long")
    radius = vertex.selectExpr("mesh_id", "vid", "1.0D as radius")
    got = pa.path_quality(pairs, vertex, radius, [1.0, -1.0, -2.0, -4.0], 0.5, 4, 2, edges=edges, least=1.0, blocks=b.spatial_blocks(vertex)).collect()
    want = pa.path_quality(pairs, vertex, radius, [1.0, -1.0, -2.0, -4.0], 0.5, 4, 2, edges=edges, least=1.0).collect()
    assert got == want and len(got) == 1
    assert rounds[0] == 1 < rounds[1]


def test_close_components_in_tiles(spark, monkeypatch):
    """Pairs by brute force, with tiles smaller than some components and components of one place; a task holds two tiles, not a cell of the whole mesh."""
    from arborframe.operators import spatial as sp

    monkeypatch.setattr(sp, "TILE", 8)
    monkeypatch.setattr(sp, "TILE_CELLS", 40)
    r = random.Random(3)
    rows = []
    for mesh in (0, 7):
        for label, n in enumerate((3, 4, 5, 6, 30, 4, 5, 21)):
            at = [r.randint(-300, 300) for _ in range(3)] if label != 5 else [5000, 0, 0]
            rows += [(mesh, len(rows) + k, *(a + (r.randint(-40, 40) if label else 0) for a in at), 10 * label) for k in range(n)]
    want = {}
    for p in rows:
        for q in rows:
            if p[0] == q[0] and p[5] < q[5] and p[5] > 0:
                d2 = sum((a - b) ** 2 for a, b in zip(p[2:5], q[2:5], strict=True))
                if d2 <= 500**2:
                    want.setdefault((p[0], p[5], q[5]), []).append((max(1, math.ceil(math.sqrt(d2) / 25)), p[1], q[1], d2))
    want = {(m, a, b, la, lb, d2) for (m, la, lb), found in want.items() for ring, a, b, d2 in found if ring == min(found)[0]}
    v = spark.createDataFrame(rows, "mesh_id long, vid long, x long, y long, z long, label long").repartition(3)
    got = sp.close_components(v, 3, 500, 25)
    assert got.schema["d2"].dataType.simpleString() == "bigint"
    got = [tuple(g) for g in got.select("mesh_id", "a", "b", "la", "lb", "d2").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 30
    real = sp._closest

    def counted(*a):
        run = real(*a)
        return lambda rows: (_ for _ in ()).throw(AssertionError) if len(rows) > 2 * sp.TILE else run(rows)

    monkeypatch.setattr(sp, "_closest", counted)
    assert sp.close_components(v, 3, 500, 25).count() == len(want)
