import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborframe.functions import geometry as g
from arborframe.operators import annotations as an
from arborframe.operators import cuts as cu
from arborframe.operators import graph as gr
from arborframe.operators import kernels as ke
from arborframe.operators import masks as ma
from arborframe.operators import spatial as sp
from arborframe.operators import surface as su
from arborframe.operators.tables import EmptyMaskError
from arborframe.sources import files

V = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 0), (0, 0, 1)]
FACES = [(0, 1, 2), (2, 3, 1), (3, 4, 2)]


@pytest.fixture(scope="module")
def basic(spark):
    v = spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(V)], "mesh_id long, vid long, x double, y double, z double")
    f = spark.createDataFrame([(1, i, *p) for i, p in enumerate(FACES)], "mesh_id long, fid long, a long, b long, c long")
    return v, f


def cloud(spark, n, seed, meshes=2):
    r = random.Random(seed)
    rows = [(m, i, *[r.randint(-50, 50) for _ in range(3)]) for m in range(meshes) for i in range(n)]
    return spark.createDataFrame(rows, "mesh_id long, vid long, x long, y long, z long"), {(m, i): np.array(p) for m, i, *p in rows}


def test_masks(spark, basic):
    v, f = basic
    link = spark.createDataFrame([(1, 0, 4), (1, 0, 1)], "mesh_id long, a long, b long")
    kept = v.filter("vid < 4").select("mesh_id", "vid")
    x, y, z = ma.apply_mask(v, f, link, kept)
    assert x.count() == 4 and sorted(r["fid"] for r in y.collect()) == [0, 1] and z.count() == 1
    with pytest.raises(EmptyMaskError):
        ma.apply_mask(v, f, link, kept.limit(0))
    used, faces = ma.reduce_vertices(v, f.filter("fid = 2"))
    assert {r["vid"]: r["dense"] for r in used.collect()} == {2: 0, 3: 1, 4: 2} and tuple(faces.first())[2:] == (1, 2, 0)
    back = ma.to_base(kept, spark.createDataFrame([(1, 2), (1, -1)], "mesh_id long, i int")).collect()
    assert {(r["i"], r["vid"]) for r in back} == {(2, 2), (-1, -1)}
    assert {r["to"] for r in ma.remap_ids(kept, spark.createDataFrame([(1, 3, 0)], "mesh_id long, vid long, to long")).collect()} == {0, 1, 2}


def test_repeated_half_edges_add_up(basic):
    v, f = basic
    e = gr.length(v, gr.graph_edges(f))
    w = {(r["src"], r["dst"]): r["w"] for r in gr.weighted_graph(e.withColumnRenamed("w", "l"), F.col("l")).collect()}
    assert w[1, 2] == pytest.approx(2 * 2**0.5) and w[0, 1] == 1 and (1, 0) not in w


def test_components_and_shortest_paths_by_brute_force(spark):
    r = random.Random(2)
    edges = [(m, r.randrange(40), r.randrange(40), r.randint(1, 9)) for m in (0, 1) for _ in range(45)]
    e = spark.createDataFrame(edges, "mesh_id long, src long, dst long, w long")
    v = spark.createDataFrame([(m, i) for m in (0, 1) for i in range(40)], "mesh_id long, vid long")
    label = {(m, i): i for m in (0, 1) for i in range(40)}
    for _ in range(40):
        for m, a, b, _w in edges:
            label[m, a] = label[m, b] = min(label[m, a], label[m, b])
    got = gr.connected_components(v, e)
    assert {(x["mesh_id"], x["vid"]): x["label"] for x in got.collect()} == label
    dist = {(m, 0): 0 for m in (0, 1)}
    for _ in range(40):
        for m, a, b, w in edges:
            if (m, a) in dist and dist[m, a] + w < dist.get((m, b), 1e9):
                dist[m, b] = dist[m, a] + w
    src = spark.createDataFrame([(0, 0, 0), (1, 0, 0)], "mesh_id long, source long, vid long")
    found = gr.shortest_paths(e, src)
    assert {(x["mesh_id"], x["vid"]): x["dist"] for x in found.collect()} == dist
    near = gr.shortest_paths(e, src, 10)
    assert {(x["mesh_id"], x["vid"]): x["dist"] for x in near.collect()} == {k: d for k, d in dist.items() if d <= 10}
    far = max(dist, key=lambda k: dist[k])
    path = gr.path_of(found, spark.createDataFrame([(far[0], 0, far[1])], "mesh_id long, source long, vid long")).orderBy("pos").collect()
    assert path[0]["vid"] == far[1] and path[-1]["vid"] == 0
    ids = np.arange(40)
    d, _ = ke.dijkstra([[(b, w) for m, a2, b, w in edges if m == 0 and a2 == a] for a in ids], [0])
    assert all(d[i] == dist.get((0, i), np.inf) for i in ids)


def test_spatial_joins_by_brute_force(spark):
    df, at = cloud(spark, 60, 4)
    near = {}
    for (m, i), p in at.items():
        near[m, i] = sorted((int(((p - q) ** 2).sum()), j) for (n, j), q in at.items() if n == m and j != i)
    got = sp.k_nearest(sp.as_points(df), df, 3, start=5.0, not_self=True).collect()
    assert {(r["mesh_id"], r["pid"], r["rank"]): (r["d2"], r["vid"]) for r in got} == {(m, i, k + 1): near[m, i][k] for m, i in at for k in range(3)}
    pairs = sp.radius_join(sp.as_points(df), df, 20).count()
    assert pairs == sum(((p - q) ** 2).sum() <= 400 for (m, _), p in at.items() for (n, _), q in at.items() if m == n)
    far = spark.createDataFrame([(0, 1, 10_000, 0, 0)], "mesh_id long, pid long, px long, py long, pz long")
    assert sp.k_nearest(far, df, 1).first()["vid"] == min((int(((p - [10_000, 0, 0]) ** 2).sum()), i) for (m, i), p in at.items() if m == 0)[1]
    assert sp.k_nearest(far, df, 1, max_distance=50).count() == 0 and sp.k_nearest(sp.as_points(df), df.filter("vid < 2"), 5).count() == 240


def test_annotations(spark, basic):
    v, _ = basic
    rows = spark.createDataFrame([(1, "a", 0, 0.3, 0.4, 0.1), (1, "a", 1, 9.0, 9.0, 9.0)], "mesh_id long, anno string, row_id long, px double, py double, pz double")
    a = an.Annotations(v).add("a", rows, max_distance=2.0)
    assert [(r["row_id"], r["vid"]) for r in a["a"].collect()] == [(0, 0)] and len(a) == 1
    with pytest.raises(ValueError, match="there is"):
        a.add("a", rows)
    assert a.masked(v.filter("vid = 3").select("mesh_id", "vid"))["a"].count() == 0
    m = spark.createDataFrame([(1, 0, 7), (1, 1, 7), (1, 2, 8), (1, 3, None), (1, 4, 8)], "mesh_id long, vid long, sid long")
    prop = v.select("mesh_id", "vid", F.col("x").alias("value"))
    assert {r["sid"]: r["value"] for r in an.mesh_property_to_skeleton(prop, m, "max").collect()} == {7: 1.0, 8: 0.0}
    assert {r["sid"]: r["value"] for r in an.mesh_property_to_skeleton(prop, m, lambda x: x.sum()).collect()} == {7: 1.0, 8: 0.0}
    with pytest.raises(ValueError, match="aggregate"):
        an.mesh_property_to_skeleton(prop, m, "mode")
    assert an.free_column(["x", "x_0"], "x") == "x_1"


def test_files(spark, basic, tmp_path):
    v, f = basic
    files.write_tables({"mesh_vertex": v, "mesh_face": f}, str(tmp_path / "m"))
    got = files.read_tables(spark, str(tmp_path / "m"))
    assert set(got) == {"mesh_vertex", "mesh_face"} and got["mesh_vertex"].count() == 5
    with pytest.raises(Exception, match="exist"):
        files.write_tables({"mesh_vertex": v}, str(tmp_path / "m"))
    (tmp_path / "x.obj").write_text("# mesh\n" + "".join(f"v {a} {b} {c}\n" for a, b, c in V) + "".join(f"f {a + 1}/1 {b + 1} {c + 1}\n" for a, b, c in FACES))
    ov, of = files.read_mesh(spark, str(tmp_path / "x.obj"))
    assert [tuple(r)[2:] for r in of.orderBy("fid").collect()] == FACES and ov.count() == 5
    with pytest.raises(ValueError, match="unknown"):
        files.read_mesh(spark, "a.ply")
    (tmp_path / "log.json").write_text('{"merge_edge_coords": [[[1, 2, 3], [4, 5, 6]], [[7, 8, 9], [1, 1, 1]]]}')
    assert tuple(files.merge_log(spark, str(tmp_path / "log.json")).orderBy("merge").first()) == (0, 1, 2, 3, 4, 5, 6)


def grid_mesh(spark, n, gap=None):
    """A strip of n squares; at gap the squares are missing."""
    v = spark.createDataFrame([(0, 2 * i + j, float(i), float(j), 0.0) for i in range(n) for j in (0, 1)], "mesh_id long, vid long, x double, y double, z double")
    f = [(0, 2 * i + k, *((2 * i, 2 * i + 2, 2 * i + 1) if k == 0 else (2 * i + 1, 2 * i + 2, 2 * i + 3))) for i in range(n - 1) if i != gap for k in (0, 1)]
    f = spark.createDataFrame(f, "mesh_id long, fid long, a long, b long, c long")
    return v, f, gr.length(v, gr.graph_edges(f))


def test_skeleton_of_a_strip(spark):
    v, _, e = grid_mesh(spark, 150)
    skel, m = ke.skeletonize(v, e, 3.0)
    s = skel.toPandas()
    assert s["parent"].isna().sum() == 1 and 140 <= len(s) <= 170 and m.filter("sid is null").count() == 0
    assert s["x"].max() - s["x"].min() >= 145
    assert ke.skeletonize(v.filter("vid < 50"), e.filter("src < 50 and dst < 50"), 3.0)[0].count() == 0  # not above the threshold
    soma = spark.createDataFrame([(0, 0.0, 0.0, 0.0)], "mesh_id long, px double, py double, pz double")
    s2, m2 = ke.skeletonize(v, e, 3.0, soma=soma, soma_radius=4.0)
    assert s2.filter("parent is null").first()["sid"] == 0 and m2.filter("vid < 8 and sid <> 0").count() == 0


def test_cut_links_and_rays(spark):
    v, f, e = grid_mesh(spark, 12)
    ends = spark.createDataFrame([(0, 0, True), (0, 23, False)], "mesh_id long, vid long, is_source boolean")
    kept, _, _ = cu.multicut(f, gr.weighted_graph(e.withColumnRenamed("w", "l"), F.col("l")), ends, 100.0)
    labels = gr.connected_components(v, gr.graph_edges(kept)).toPandas().set_index("vid")["label"]
    assert labels[0] != labels[23]
    v, f, e = grid_mesh(spark, 12, gap=5)
    merges = spark.createDataFrame([(0, 4, 8, 15)], "mesh_id long, merge long, a long, b long")
    links = ke.link_merges(v, e, merges).collect()
    assert len(links) == 1 and links[0]["merge"] == 4 and {links[0]["a"] // 2, links[0]["b"] // 2} == {5, 6}
    cube = [(x, y, z) for x in (-1, 1) for y in (-1, 1) for z in (-1, 1)]
    quads = [(0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3)]
    tri = [t for a, b, c, d in quads for t in ((a, b, c), (a, c, d))]
    v = spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(cube)], "mesh_id long, vid long, x double, y double, z double")
    f = spark.createDataFrame([(0, i, *t) for i, t in enumerate(tri)], "mesh_id long, fid long, a long, b long, c long")
    n = {r["vid"]: np.array([r["nx"], r["ny"], r["nz"]]) for r in ke.vertex_normals(v, f).collect()}
    assert all(abs(np.linalg.norm(x) - 1) < 1e-9 and x @ np.array(cube[i]) > 0 for i, x in n.items())
    s = 3**-0.5
    rays = spark.createDataFrame([(0, 0, 0, s, s, s, 0.0), (0, 0, 1, -s, -s, -s, 0.1)], "mesh_id long, vid long, i long, x double, y double, z double, angle double")
    hits = {r["i"]: r["dist"] for r in su.first_hits(v, f, rays).collect()}
    assert hits[0] == pytest.approx(2 * 3**0.5, abs=1e-6) and hits[1] is None


def test_geometry(spark):
    cone = g.cone_directions(spark, 50, 0.5).toPandas()
    assert np.allclose((cone[["x", "y", "z"]] ** 2).sum(1), 1) and cone["angle"].max() < 0.5
    n = spark.createDataFrame([(0, 0, 0.6, 0.0, 0.8)], "mesh_id long, vid long, nx double, ny double, nz double")
    o = g.oriented_cones(n, g.cone_directions(spark, 50, 0.5)).toPandas()
    assert np.allclose(np.arccos(np.clip(o[["x", "y", "z"]].to_numpy() @ [0.6, 0, 0.8], -1, 1)), o["angle"], atol=1e-6)
    p = spark.createDataFrame([(0, 1, 0.0), (0, 2, 10.0), (0, 3, 14.0)], "line int, pid long, x double")
    v = spark.createDataFrame([(0, x) for x in (-9.0, 4.9, 5.0, 11.9, 12.0, 99.0)], "line int, v double")
    assert [r["pid"] for r in g.assign_windows(p, v, ["line"]).orderBy("v").collect()] == [1, 1, 2, 2, 3, 3]
    assert g.checked_colours([(0.5, 0, 1), (10, 20, 255)]) == [(127, 0, 255), (10, 20, 255)]
    with pytest.raises(ValueError, match="range"):
        g.checked_colours([(2.5, 0, 0)])
    rows = spark.createDataFrame([(0, i, float(i % 7)) for i in range(1000)], "path int, pos int, v double")
    odds = [0.5 * i - 2 for i in range(15)]
    want = min(sum(odds[(i % 7)] for i in range(s, s + 400)) / (400 * 0.1) for s in range(0, 601, 50))
    assert g.sliding_score(rows, ["path"], odds, 0.1).first()["score"] == pytest.approx(want)


@pytest.mark.parametrize("n", [1, 399, 400, 401, 449, 450, 1010])
def test_sliding_score_reaches_the_end(spark, n):
    odds = [0.5 * i - 2 for i in range(15)]
    at = lambda i: 0 if i >= n - 10 else 9
    rows = spark.createDataFrame([(1, i, float(at(i))) for i in range(n)], "path long, pos long, v double")
    starts = [0]
    while starts[-1] + 400 < n:
        starts.append(starts[-1] + 50)
    windows = [[odds[at(i)] for i in range(s, min(s + 400, n))] for s in starts]
    assert g.sliding_score(rows, ["path"], odds, 0.1).first()["score"] == pytest.approx(min(sum(w) / (len(w) * 0.1) for w in windows))


def test_fill_radius_of_long_runs(spark):
    from arborframe.operators import paths as pa

    n = 241
    tree = spark.createDataFrame([(1, i, i - 1 if i else None, {0: 1.0, n - 1: 9.0}.get(i)) for i in range(n)], "skel_id long, sid long, parent long, radius double")
    now = [1.0] + [None] * (n - 2) + [9.0]
    while None in now:
        near = [[now[j] for j in (i - 1, i + 1) if 0 <= j < n and now[j] is not None] for i in range(n)]
        now = [x if x is not None else sum(m) / len(m) if m else None for x, m in zip(now, near, strict=True)]
    assert [r["radius"] for r in pa.fill_radius(tree).orderBy("sid").collect()] == pytest.approx(now)


def test_path_of_by_brute_force(spark):
    r = random.Random(2)
    w = {}
    for i in range(1, 30):
        for j in {r.randrange(i), r.randrange(i)}:
            w[i, j] = w[j, i] = r.randint(1, 9)
    edges = spark.createDataFrame([(m, a, b, float(x)) for m in (0, 1) for (a, b), x in w.items()], "mesh_id long, src long, dst long, w double")
    found = gr.shortest_paths(edges, spark.createDataFrame([(0, 7, 0), (1, 8, 5)], "mesh_id long, source long, vid long")).cache()
    dist = {(x["mesh_id"], x["vid"]): x["dist"] for x in found.collect()}
    ways = {}
    for x in gr.path_of(found, found.select("mesh_id", "source", "vid")).collect():
        ways.setdefault((x["mesh_id"], x["target"]), {})[x["pos"]] = x["vid"]
    assert len(ways) == 60
    for (m, target), at in ways.items():
        way = [at[i] for i in range(len(at))]
        assert way[0] == target and way[-1] == (0, 5)[m] and sum(w[e] for e in zip(way[:-1], way[1:], strict=True)) == dist[m, target]


def test_stream(spark, basic, tmp_path):
    from arborframe.streaming.anchors import anchor_stream

    v, _ = basic
    rows = spark.createDataFrame([(1, "a", i, 0.1 * i, 0.0, 0.0) for i in range(8)], "mesh_id long, anno string, row_id long, px double, py double, pz double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    anchor_stream(stream, v, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert {r["row_id"]: r["vid"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {i: int(0.1 * i > 0.5) for i in range(8)}


def test_paths_between_points_meshes_and_trees(spark):
    from arborframe.operators import paths as pa
    from arborframe.operators import tree as t

    v, f, e = grid_mesh(spark, 150)
    both = gr.weighted_graph(e.withColumnRenamed("w", "l"), F.col("l"), directed=False)
    skel, m = ke.skeletonize(v, e, 3.0)
    skel, m = skel.cache(), m.cache()
    p = spark.createDataFrame([(0, 1, 70.2, 0.4, 0.3)], "mesh_id long, pid long, px double, py double, pz double")
    way = pa.point_to_skeleton(p, v, f, both, skel.select(F.col("skel_id").alias("mesh_id"), F.col("sid").alias("vid"))).collect()
    assert 1 <= len(way) <= 3 and max(r["pos"] for r in way) == len(way) - 1
    tree = skel.select("skel_id", "sid", "parent", F.round(F.col("w") * 1000).cast("long").alias("w"))
    pairs = pa.path_pairs(tree, t.Lifts(tree), both, m).cache()
    assert {r["side"] for r in pairs.select("side").distinct().collect()} == {"tree", "mesh"}
    radius = v.select("mesh_id", "vid", F.lit(60.0).alias("radius"))
    score = pa.path_quality(pairs, v, radius, [1.0] + [-1.0] * 14, 0.5).collect()
    assert score and all(r["score"] == pytest.approx(2.0) for r in score)
    v2, f2, e2 = grid_mesh(spark, 12, gap=5)
    labels = gr.connected_components(v2, gr.graph_edges(f2))
    merges = spark.createDataFrame([(0, 1, 4.0, 0.5, 0.0, 7.0, 0.5, 0.0), (0, 2, 3.0, 0.5, 0.0, 4.9, 0.5, 0.0), (0, 3, 1.0, 0.5, 0.0, 0.0, 0.5, 0.0)], "mesh_id long, merge long, ax double, ay double, az double, bx double, by double, bz double")
    got = {r["merge"]: (r["a"] // 2 <= 5, r["b"] // 2 > 5) for r in pa.map_merges(merges, v2, f2, labels, 2.5).collect()}
    assert got == {1: (True, True), 2: (True, True)}
    tree3 = spark.createDataFrame([(0, 0, None, 2.0), (0, 1, 0, None), (0, 2, 1, None), (0, 3, 2, 6.0), (1, 0, None, None)], "skel_id long, sid long, parent long, radius double")
    assert [r["radius"] for r in pa.fill_radius(tree3).orderBy("skel_id", "sid").collect()] == [2.0, 2.0, 6.0, 6.0, None]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_spread_sides_are_not_broadcast(spark):
    vertex = spark.createDataFrame([(0, i, i % 7, i % 5, i % 3) for i in range(50)], "mesh_id long, vid long, x long, y long, z long")
    points = spark.createDataFrame([(0, i, i % 5, i % 7, i % 3) for i in range(60)], "mesh_id long, pid long, px long, py long, pz long")
    far = lambda p, v: sum((p[f"p{k}"] - v[k]) ** 2 for k in "xyz")
    want = sorted((p["pid"], v["vid"], far(p, v)) for p in points.collect() for v in vertex.collect() if far(p, v) <= 4)
    for spread_vertex in (False, True):
        got = sp.radius_join(points, vertex, 2, spread_vertex=spread_vertex)
        assert "Broadcast" not in plan_of(got)
        assert sorted((r["pid"], r["vid"], r["d2"]) for r in got.collect()) == want


def test_nearest_of_crowded_vertices_and_of_points_of_one_place(spark):
    # a crowd of 1,000 and one vertex far away: the box alone would make one cell of the crowd
    at = [(0, i, i % 10 * 10, i // 10 % 10 * 10, i // 100 * 10) for i in range(1000)] + [(0, 1000, 10**4, 10**4, 10**4)]
    vertex = spark.createDataFrame(at, "mesh_id long, vid long, x long, y long, z long").cache()
    assert sp._uncrowded(vertex, 10.0**3, 4) < 30 and sp._uncrowded(vertex, 10.0**6, 4) < 30
    ask = [(0, i, i % 4 * 31, i % 3 * 29, 50) for i in range(120)] + [(0, 120, 500, 0, 0), (1, 121, 0, 0, 0)]
    points = spark.createDataFrame(ask, "mesh_id long, pid long, px long, py long, pz long")
    got = sorted((r["pid"], r["rank"], r["vid"], r["d2"]) for r in sp.k_nearest(points, vertex, 2).collect())
    want = []
    for m, p, *x in ask:
        near = sorted((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), v) for _, v, *y in at if m == 0)[:2]
        want += [(p, i + 1, v, d) for i, (d, v) in enumerate(near)]
    assert got == sorted(want)


def test_near_points_from_either_side_are_not_broadcast(spark):
    vertex = spark.createDataFrame([(0, i, i * 3, 0, 0) for i in range(30)], "mesh_id long, vid long, x long, y long, z long")
    some = [(0, 0, 10, 0, 0), (0, 1, 10, 0, 0), (0, 2, 51, 4, 0), (1, 3, 0, 0, 0)]
    for many in (some, some + [(0, i, 51, 4 + i, 0) for i in range(5, 60)]):
        points = spark.createDataFrame(many, "mesh_id long, pid long, px long, py long, pz long")
        got = sp.near_points(vertex, points, 5)
        assert "Broadcast" not in plan_of(got)
        assert sorted(r["vid"] for r in got.collect()) == [2, 3, 4, 17]


def test_points_share_their_search(spark, monkeypatch):
    from arborframe.operators import paths as pa

    # a strip of 60 vertices with weights of many ties; the tree is at its ends
    n = 60
    v = spark.createDataFrame([(0, i, i // 2 * 10, i % 2 * 10, 0) for i in range(n)], "mesh_id long, vid long, x long, y long, z long").cache()
    f = spark.createDataFrame([(0, i, i, i + 1, i + 2) for i in range(n - 2)], "mesh_id long, fid long, a long, b long, c long").cache()
    links = [(0, a, b, 1 + (a + b) % 2) for i in range(n - 2) for a, b in ((i, i + 1), (i, i + 2), (i + 1, i), (i + 2, i))]
    e = spark.createDataFrame(sorted(set(links)), "mesh_id long, src long, dst long, w long").cache()
    skel = spark.createDataFrame([(0, 0), (0, 1), (0, n - 1)], "mesh_id long, vid long")
    points = spark.createDataFrame([(0, i, i % 30 * 10, 3, 4) for i in range(90)], "mesh_id long, pid long, px long, py long, pz long")
    # from each point alone over the whole mesh, as it was
    start = pa.nearest_face_vertex(points, v, f).select("mesh_id", F.col("pid").alias("source"), "vid").cache()
    every = gr.shortest_paths(e, start).cache()
    ends = every.join(skel, ["mesh_id", "vid"]).groupBy("mesh_id", "source").agg(F.min(F.struct("dist", "vid")).alias("m")).select("mesh_id", "source", "m.vid")
    want = sorted(map(tuple, gr.path_of(every, ends).select("source", "target", "pos", "vid").collect()))
    asked, made, near, short = [], [], pa.su._nearest, gr.shortest_paths
    monkeypatch.setattr(pa.su, "_nearest", lambda p, *a: (asked.append(p.count()), near(p, *a))[1])
    monkeypatch.setattr(gr, "shortest_paths", lambda *a, **b: (made.append(short(*a, **b).cache()), made[-1])[1])
    got = sorted(map(tuple, pa.point_to_skeleton(points, v, f, e, skel).select("source", "target", "pos", "vid").collect()))
    assert got == want and {r[0] for r in got} == set(range(90))
    assert asked == [30] and sum(x.count() for x in made) < every.count() / 3
