import itertools
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborframe.operators import blocks as bl
from arborframe.operators import cuts as cu
from arborframe.operators import graph as gr


def smallest_sink_side(n, caps, sources, sinks):
    """All cuts of a small graph tried: the weight of the least, and what lies on the sinks' side of all least ones."""
    free = [v for v in range(n) if v not in sources and v not in sinks]
    best, common = np.inf, None
    for k in itertools.product((False, True), repeat=len(free)):
        far = set(sinks) | {v for v, x in zip(free, k, strict=True) if x}
        weight = sum(c for (u, v), c in caps.items() if u not in far and v in far)
        if weight < best:
            best, common = weight, far
        elif weight == best:
            common = common & far
    return best, common


def most_flow(n, caps, sources, sinks):
    """Shortest augmenting ways, one at a time."""
    left = {}
    for (u, v), c in caps.items():
        left[u, v] = left.get((u, v), 0) + c
        left.setdefault((v, u), 0)
    to = {}
    for u, v in left:
        to.setdefault(u, []).append(v)
    total = 0
    while True:
        up, todo, end = {s: None for s in sources}, deque(sources), None
        while todo and end is None:
            u = todo.popleft()
            for v in to.get(u, ()):
                if left[u, v] > 0 and v not in up:
                    up[v] = u
                    todo.append(v)
                    if v in sinks:
                        end = v
                        break
        if end is None:
            reach, todo = set(sinks), deque(sinks)
            while todo:
                v = todo.popleft()
                for u in to.get(v, ()):
                    if left[u, v] > 0 and u not in reach:
                        reach.add(u)
                        todo.append(u)
            return total, reach
        way = [end]
        while up[way[-1]] is not None:
            way.append(up[way[-1]])
        steps = [(b, a) for a, b in itertools.pairwise(way)]
        f = min(left[s] for s in steps)
        for u, v in steps:
            left[u, v] -= f
            left[v, u] += f
        total += f


def random_caps(r, n, m):
    return {(int(a), int(b)): float(w) for a, b, w in zip(r.integers(0, n, m), r.integers(0, n, m), r.integers(1, 6, m), strict=True) if a != b}


@pytest.mark.parametrize("seed", range(6))
def test_block_by_block_in_memory(seed):
    """The discharge alone, blocks in turn with exact mail, against all cuts."""
    r = np.random.default_rng(seed)
    n = 9
    caps = random_caps(r, n, 26)
    best, side = smallest_sink_side(n, caps, {0}, {n - 1})
    flow, reach = most_flow(n, caps, {0}, {n - 1})
    assert flow == best and reach == side
    arcs = [(u, v, True, caps.get((u, v), 0.0)) for u, v in {*caps, *((v, u) for u, v in caps)}]
    excess = {v: 0.0 for v in range(n)}
    excess[0] = 1 + sum(c for (u, _), c in caps.items() if u == 0)
    left, labels = cu.discharge(arcs, excess, {n - 1}, {})
    assert excess[n - 1] == best and set(labels) | {n - 1} == side and min(left.values()) >= 0


@pytest.mark.parametrize("size", [1000, 4])
def test_minimum_cuts(spark, size):
    rows, ends, want = [], [], set()
    for mesh, n in ((0, 24), (5, 12)):
        caps = random_caps(np.random.default_rng(mesh + size), n, n * 4)
        rows += [(mesh, u, v, w) for (u, v), w in caps.items()] + [(mesh, 3, 3, 1.0)]
        s, t = {0, 1}, {n - 1, n - 2}
        ends += [(mesh, v, True) for v in s] + [(mesh, v, False) for v in t] + [(mesh, 5, True), (mesh, 5, False)]
        want |= {(mesh, v) for v in most_flow(n, caps, s, t)[1]}
    e = spark.createDataFrame(rows, "mesh_id long, src long, dst long, w double")
    end = spark.createDataFrame(ends, "mesh_id long, vid long, is_source boolean")
    ids = e.select("mesh_id", F.col("src").alias("vid")).union(e.select("mesh_id", "dst")).distinct().withColumn("block", F.floor(F.col("vid") / size))
    taken = []
    got = cu.sink_side(e, end, ids, between=2, taken=taken)
    assert {tuple(x) for x in got.collect()} == want and 0 < taken[0] < 60
    assert cu.sink_side(e, end.filter("is_source"), ids).count() == 0 and cu.sink_side(e.limit(0), end.limit(0)).count() == 0


def test_cut_of_a_mesh_from_points(spark):
    w, h = 14, 4  # a sheet with a neck one face wide between columns 6 and 8
    xy = [(x, y) for x in range(w) for y in range(h)]
    vid = {p: i for i, p in enumerate(xy)}
    v = spark.createDataFrame([(2, i, float(x), float(y), 0.0) for (x, y), i in vid.items()], "mesh_id long, vid long, x double, y double, z double")
    tri = [t for x in range(w - 1) for y in range(h - 1) if not (x in (6, 7) and y > 0) for t in (((x, y), (x + 1, y), (x, y + 1)), ((x + 1, y), (x + 1, y + 1), (x, y + 1)))]
    f = spark.createDataFrame([(2, i, *[vid[p] for p in t]) for i, t in enumerate(tri)], "mesh_id long, fid long, a long, b long, c long")
    e = gr.weighted_graph(gr.graph_edges(f))
    at = [(0, 0.2, 1.1, 0.3, True), (1, 1.0, 3.2, 0.0, True), (2, 12.9, 0.9, 0.1, False)]
    points = spark.createDataFrame([(2, *p) for p in at], "mesh_id long, pid long, px double, py double, pz double, is_source boolean")
    kept, links, side = cu.multicut_of_points(v, f, e, points, 100.0)
    got = {r["vid"]: r["is_source"] for r in side.collect()}
    assert got[vid[0, 1]] and got[vid[1, 3]] and not got[vid[13, 1]] and set(got) == {vid[p] for t in tri for p in t}
    label = {r["vid"]: r["label"] for r in gr.connected_components(v, gr.graph_edges(kept, links)).collect()}
    assert label[vid[0, 1]] == label[vid[1, 3]] != label[vid[13, 1]]
    assert {(a, b) for a in got for b in got if a != b and label[a] == label[b] and got[a] != got[b]} == set()
    assert len(tri) - kept.count() < 6
    # a window that does not reach the whole: vertices beyond it are on no side, their faces stay
    near = {r["vid"] for r in cu.sides(e, spark.createDataFrame([(2, vid[0, 0], True), (2, vid[2, 0], False)], "mesh_id long, vid long, is_source boolean"), 2.0).collect()}
    assert vid[0, 0] in near and vid[13, 0] not in near and (len(near) < len(got))


def test_many_points_of_a_vertex(spark, monkeypatch):
    given, plans = [], []
    monkeypatch.setattr(cu, "multicut", lambda face, edges, ends, *rest: given.append(ends))
    monkeypatch.setattr(cu, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    v = spark.createDataFrame([(0, i, 100 * i, 0, 0) for i in range(4)], "mesh_id long, vid long, x long, y long, z long")
    points = spark.range(600).selectExpr("0L as mesh_id", "id as pid", "(id % 4) * 100 + 3 as px", "0L as py", "0L as pz", "id % 4 < 2 as is_source")
    cu.multicut_of_points(v, None, None, points, 1e9)
    assert sorted(map(tuple, given[0].collect())) == [(0, 0, True), (0, 1, True), (0, 2, False), (0, 3, False)]
    assert "BroadcastHashJoin" not in plans[0]


def test_sides_of_any_ids(spark, monkeypatch):
    rounds = []
    plain = bl.shortest_paths
    for m in (cu, gr):
        monkeypatch.setattr(m, "shortest_paths", lambda *args, **options: plain(*args, **options, taken=rounds))
    vid = [int(k) * bl.BLOCK for k in np.random.default_rng(5).permutation(12)]
    vertex = spark.createDataFrame([(0, v, 100 * i, 0, 0) for i, v in enumerate(vid)], "mesh_id long, vid long, x long, y long, z long")
    edges = spark.createDataFrame([(0, u, v, 1.0 if i == 7 else 5.0) for i, (u, v) in enumerate(zip(vid[:-1], vid[1:], strict=True))], "mesh_id long, src long, dst long, w double")
    ends = spark.createDataFrame([(0, vid[0], True), (0, vid[-1], False)], "mesh_id long, vid long, is_source boolean")
    got = cu.sides(edges, ends, 1e9, bl.spatial_blocks(vertex)).collect()
    assert {r["vid"] for r in got if r["is_source"]} == set(vid[:8]) and len(got) == 12
    assert rounds and max(rounds) == 1
