import random

import pytest

from arborframe.operators import neuron as ne
from arborframe.operators import tree as t
from arborframe.sources import files

XYZ = [(1, 0, 5), (1, 1, 5), (1, 2, 5), (0, 2, 5), (0, 2, 4), (2, 2, 5), (2, 2, 6)]
EDGES = [(1, 0), (2, 1), (3, 2), (4, 3), (5, 2), (6, 5)]


@pytest.fixture(scope="module")
def simple(spark):
    return files.skeleton_from_dict(spark, 1, {"vertices": XYZ, "edges": EDGES, "root": 0})


def random_tree(spark, n, seed, forest=1):
    r = random.Random(seed)
    rows = [(s, i, r.randrange(max(0, i - 4), i) if i else None, r.randint(1, 9)) for s in range(forest) for i in range(n)]
    return spark.createDataFrame(rows, "skel_id long, sid long, parent long, w long"), {(s, i): (p, w) for s, i, p, w in rows}


def way(up, s, v):
    out, d = [(v, 0)], 0
    while up[s, out[-1][0]][0] is not None:
        p, w = up[s, out[-1][0]]
        d += w
        out.append((p, d))
    return out


def test_simple_tree(spark, simple):
    paths = t.Lifts(simple)
    seg = {r["sid"]: r["seg"] for r in t.segments(simple, paths).collect()}
    assert [seg[i] for i in range(7)] == [0, 0, 0, 1, 1, 2, 2]
    up = {r["anc"]: r["dist"] for r in t.closure(paths).filter("sid = 6").collect()}
    assert up == {6: 0, 5: 1, 2: 2, 1: 3, 0: 4}
    pairs = spark.createDataFrame([(1, 6, i) for i in range(7)], "skel_id long, a long, b long")
    assert {r["b"]: r["dist"] for r in t.distance_between(paths, pairs).collect()} == dict(enumerate([4, 3, 2, 3, 4, 1, 0]))
    assert {r["sid"] for r in t.end_points(simple).collect()} == {4, 6} and [r["sid"] for r in t.branch_points(simple).collect()] == [2]
    cover = t.cover_paths(simple, paths).collect()
    assert len(cover) == 7 and len({r["path"] for r in cover}) == 2
    with pytest.raises(ValueError, match="root"):
        t.reroot(simple, paths, spark.createDataFrame([(1, 8)], "skel_id long, sid long"))
    with pytest.raises(ValueError, match="root"):
        files.skeleton_from_dict(spark, 1, {"vertices": XYZ, "edges": EDGES, "root": 8})


def test_swc_round_trip(spark, simple, tmp_path):
    skel = simple.withColumn("radius", simple["x"] + 1.0)
    rows = files.swc_rows(skel, t.Lifts(simple), xyz_scaling=1.0).orderBy("id").collect()
    assert rows[3]["parent"] == 2 and rows[0]["parent"] == -1 and all(r["parent"] < r["id"] for r in rows)
    files.write_swc(files.swc_rows(skel, t.Lifts(simple), xyz_scaling=1.0), str(tmp_path / "swc"), header="made here")
    back = files.read_swc(spark, str(tmp_path / "swc")).orderBy("id").collect()
    assert [(r["id"], r["label"], r["x"], r["parent"]) for r in back] == [(r["id"], r["label"], r["x"], r["parent"]) for r in rows]
    with pytest.raises(Exception, match="exist"):
        files.write_swc(files.swc_rows(skel, t.Lifts(simple)), str(tmp_path / "swc"))


def test_random_forest_by_brute_force(spark):
    tree, up = random_tree(spark, 60, 3, forest=2)
    paths = t.Lifts(tree)
    got = {(r["skel_id"], r["sid"], r["anc"]): (r["hops"], r["dist"]) for r in t.closure(paths).collect()}
    assert got == {(s, v, a): (k, d) for s, v in up for k, (a, d) in enumerate(way(up, s, v))}
    kids = {}
    for (s, v), (p, _) in up.items():
        kids.setdefault((s, p), []).append(v)
    strahler = {}
    for s, v in sorted(up, key=lambda x: -x[1]):
        below = sorted((strahler[s, c] for c in kids.get((s, v), [])), reverse=True)
        strahler[s, v] = 1 if not below else below[0] + (len(below) > 1 and below[0] == below[1])
    assert {(r["skel_id"], r["sid"]): r["strahler"] for r in t.strahler_order(tree, paths).collect()} == strahler
    cover = t.cover_paths(tree, paths).collect()
    assert sorted((r["skel_id"], r["sid"]) for r in cover) == sorted(up)
    assert len({(r["skel_id"], r["path"]) for r in cover}) == sum((s, v) not in kids for s, v in up)
    order = {(r["skel_id"], r["sid"]): r["branch_order"] for r in t.branch_order(tree, paths).collect()}
    assert all(order[s, v] == (0 if v == 0 else sum(len(kids.get((s, a), [])) > 1 for a, _ in way(up, s, v))) for s, v in up)


def test_reroot_keeps_lengths(spark):
    tree, up = random_tree(spark, 40, 5)
    again = t.reroot(tree, t.Lifts(tree), spark.createDataFrame([(0, 33)], "skel_id long, sid long"))
    rows = {r["sid"]: (r["parent"], r["w"]) for r in again.collect()}
    assert rows[33][0] is None and sum(w for p, w in rows.values() if p is not None) == sum(w for p, w in up.values() if p is not None)
    ends = lambda m: {frozenset((v, p)) for v, (p, _) in m.items() if p is not None}
    assert ends(rows) == ends({v: x for (_, v), x in up.items()})


def test_betweenness_counts_pairs_across_an_edge(spark):
    tree, up = random_tree(spark, 30, 7)
    r = random.Random(1)
    anno = [(0, r.randrange(30), r.random() < 0.5) for _ in range(40)]
    df = spark.createDataFrame(anno, "skel_id long, sid long, is_pre boolean")
    got = {x["sid"]: x["betweenness"] for x in ne.betweenness(t.Lifts(tree), df).collect()}
    for v in range(30):
        below = {u for u in range(30) if v in [a for a, _ in way(up, 0, u)]}
        assert got[v] == sum((a in below) != (b in below) for _, a, x in anno for _, b, y in anno if x and not y)
    flagged, cuts = ne.split_axon(tree, t.Lifts(tree), df, at_segment_base=False)
    assert 0 <= cuts.first()["quality"] <= 1 and ne.split_quality(df, flagged).first()["quality"] == pytest.approx(cuts.first()["quality"])
    assert ne.split_axon(tree, t.Lifts(tree), df.filter("is_pre"))[0].filter("is_axon").count() == 0


def test_density_by_brute_force(spark):
    tree, up = random_tree(spark, 30, 9)
    anno = spark.createDataFrame([(0, v, True) for v in (1, 5, 5, 9, 20)], "skel_id long, sid long, is_pre boolean")
    got = {r["sid"]: r["density"] for r in ne.linear_density(tree, t.Lifts(tree), anno, 12).collect()}
    dist = lambda a, b: min(d + e for x, d in way(up, 0, a) for y, e in way(up, 0, b) if x == y)
    cable = {v: (sum(w for (_, u), (p, w) in up.items() if p is not None and v in (u, p))) / 2 for v in range(30)}
    for v in range(30):
        near = [u for u in range(30) if dist(v, u) <= 12]
        assert got[v] == pytest.approx(len({1, 5, 9, 20} & set(near)) / sum(cable[u] for u in near))


@pytest.fixture(scope="module")
def grown(spark):
    """A forest of two random trees, its ways by hand, and pairs of its vertices."""
    tree, up = random_tree(spark, 60, 5, forest=2)
    r = random.Random(6)
    pairs = [(r.randrange(2), r.randrange(60), r.randrange(60)) for _ in range(80)]
    return tree.cache(), up, spark.createDataFrame(pairs, "skel_id long, a long, b long").cache()


def test_ways_in_arrays_and_in_rounds(grown, monkeypatch):
    tree, up, pairs = grown
    found = []
    for rounds in (7, 1):
        monkeypatch.setattr(t, "WAY_ROUNDS", rounds)
        paths = t.Lifts(tree)
        assert (paths.ways is None) == (rounds == 1)
        found.append([sorted(map(tuple, f(paths, x).collect())) for f, x in ((t.lowest_common, pairs), (t.path_between, pairs), (t.path_to_root, tree))])
    assert found[0] == found[1] and len(found[0][0]) == pairs.distinct().count()
    assert found[0][2] == sorted((s, v, i, a) for s, v in up for i, (a, _) in enumerate(way(up, s, v)))


def test_sums_over_ways_and_branches(grown):
    from pyspark.sql import functions as F

    tree, _, pairs = grown
    paths = t.Lifts(tree)
    values = tree.filter("sid % 7 <> 3").select("skel_id", "sid", (F.col("sid") % 3).alias("n"), (F.col("sid") * 5).alias("v"))
    on = t.path_between(paths, pairs).join(values, ["skel_id", "sid"], "left").groupBy("skel_id", "a", "b").agg(F.sum(F.coalesce("n", F.lit(0))), F.sum((F.col("pos") + 1) * F.coalesce("v", F.lit(0))))
    assert sorted(map(tuple, t.sums_between(paths, pairs, values).collect())) == sorted(map(tuple, on.collect()))
    of = tree.select("skel_id", "sid")
    on = t.same_branch(tree, paths, of).join(values, ["skel_id", "sid"]).groupBy("skel_id", "of").agg(F.sum("n"), F.sum("v"))
    assert sorted(map(tuple, t.branch_sums(tree, paths, of, values).collect())) == sorted(map(tuple, on.collect()))


def test_near_pairs_come_once(grown):
    tree, up, _ = grown
    paths, d = t.Lifts(tree), {(s, v): dict(way(up, s, v)) for s, v in up}
    far = lambda s, i, j: min(d[s, i][a] + d[s, j][a] for a in d[s, i].keys() & d[s, j].keys())
    want = sorted((s, i, j, far(s, i, j)) for s in range(2) for i in range(60) for j in range(60) if far(s, i, j) < 9)
    assert sorted(map(tuple, t.near_pairs(paths, lambda x: x < 9).collect())) == want


def test_one_tree_is_not_one_task(spark, grown):
    tree, _, _ = grown
    anno = tree.select("skel_id", "sid", (tree["sid"] % 2 == 0).alias("is_pre"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = ne.betweenness(t.Lifts(tree), anno)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(skel_id" not in "".join(x for x in plan.splitlines() if "sid#" not in x.split("hashpartitioning")[-1]) and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("some", [False, True])
def test_cover_paths_go_over_runs(spark, monkeypatch, some):
    """By brute force, with all tips and with given starts, on long runs; what is added up has a row a run and not a row a vertex."""
    r = random.Random(5 + some)
    n, rows, up = 240, [], {}
    for s in (0, 3):
        for i in range(n):
            p = None if i == 0 else (-50 if i == 36 else (i - 1 if i % 12 else r.randrange(i)))  # 36 hangs on a vertex that isn't there
            rows.append((s, i, p, r.randint(0, 3)))
            up[s, i] = (p, rows[-1][3])
    tree = spark.createDataFrame(rows, "skel_id long, sid long, parent long, w long").repartition(3)
    kids = {(s, p) for (s, _), (p, _) in up.items()}
    start = [(s, i) for s, i in up if (r.random() < 0.1 if some else (s, i) not in kids)]

    def to_top(s, v):
        out, d = [], 0
        while v is not None and (s, v) in up:
            out.append(v)
            p, w = up[s, v]
            d, v = d + (w if p is not None else 0), p
        return out, d

    best = {}
    for s, tip in start:
        seen, d = to_top(s, tip)
        for v in seen:
            best[s, v] = max(best.get((s, v), (-1, -1)), (d, tip))
    length, place = {}, {}
    for (s, v), (_, tip) in best.items():
        length[s, tip] = length.get((s, tip), 0) + up[s, v][1]
        place[s, v] = to_top(s, tip)[0].index(v)
    order = {s: sorted(((k, tip) for (q, tip), k in length.items() if q == s), reverse=True) for s in (0, 3)}
    want = {(s, v, tip, order[s].index((length[s, tip], tip)), place[s, v]) for (s, v), (_, tip) in best.items()}
    sizes, real = [], t.below
    monkeypatch.setattr(t, "below", lambda paths, *a: sizes.append(paths.tree.count()) or real(paths, *a))
    given = spark.createDataFrame(start + start[:3], "skel_id long, sid long") if some else None
    got = [tuple(g) for g in t.cover_paths(tree, t.Lifts(tree), given).select("skel_id", "sid", "tip", "path", "pos").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert sizes and max(sizes) < (n if some else n / 2)
