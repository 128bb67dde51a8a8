import random

import pytest

from arborframe.operators import views as vi


def one_by_one(views, order):
    seen, out = set(), []
    for p in order:
        if p not in seen:
            out.append(p)
            seen |= views[p]
    return out


@pytest.mark.parametrize("n", [12, 80])
def test_cover_is_what_one_by_one_gives(spark, n):
    r, rows, want = random.Random(n), [], {}
    for mesh in (0, 2):
        views = {p: {p} | {r.randrange(n) for _ in range(r.randint(0, 6))} for p in range(n) if r.random() < 0.9}
        rows += [(mesh, p, v) for p, held in views.items() for v in held if v != p or r.random() < 0.8 or len(held) == 1]
        want[mesh] = [(i, p) for i, p in enumerate(one_by_one(views, sorted(views)))]
    taken = []
    near = spark.createDataFrame(rows, "mesh_id long, pid long, vid long")
    got = vi.greedy_cover(near, taken=taken).collect()
    for mesh in (0, 2):
        assert sorted((x["step"], x["pid"]) for x in got if x["mesh_id"] == mesh) == want[mesh]
    assert taken[0] < n / 2
    drawn = [x["pid"] for x in vi.greedy_cover(near.filter("mesh_id = 0"), "random", 5).orderBy("step").collect()]
    again = [x["pid"] for x in vi.greedy_cover(near.filter("mesh_id = 0"), "random", 5).orderBy("step").collect()]
    held = {p: {x[2] for x in rows if x[:2] == (0, p)} | {p} for p in {x[1] for x in rows if x[0] == 0}}
    assert drawn == again != sorted(drawn) and set(held) <= set().union(*(held[p] for p in drawn))
    assert all(p not in set().union(*(held[q] for q in drawn[:i]), set()) for i, p in enumerate(drawn))
    assert vi.greedy_cover(near.limit(0)).count() == 0
    with pytest.raises(ValueError):
        vi.greedy_cover(near, "backwards")


def test_samples(spark):
    """Of points on a line, seen from 2,000 centres at one place: sizes are exact, near ones come more often, and as often as drawing by weight gives."""
    v = spark.createDataFrame([(0, i, float(i), 0.0, 0.0) for i in range(30)], "mesh_id long, vid long, x double, y double, z double")
    centres = spark.range(2000).selectExpr("0L as mesh_id", "id as pid", "0.0D as px", "0.0D as py", "0.0D as pz")
    got = vi.sampled_views(v, centres, 4, 10, fisheye=True, seed=1).toPandas()
    assert (got.groupby("pid").size() == 4).all() and got["vid"].max() == 9 and (got.groupby("pid")["vid"].nunique() == 4).all()
    assert all(list(g) == sorted(g) for _, g in got.sort_values(["pid", "pos"]).groupby("pid")["vid"])
    often = got.groupby("vid").size() / 2000
    r, want = random.Random(3), dict.fromkeys(range(10), 0)
    for _ in range(20_000):  # 0 is at the centre; three more by weight, one after another
        left = list(range(1, 10))
        want[0] += 1
        for _ in range(3):
            p = r.choices(left, [1 / i for i in left])[0]
            left.remove(p)
            want[p] += 1
    assert all(abs(often.get(i, 0) - want[i] / 20_000) < 0.05 for i in range(10)) and often[1] > 2 * often[9]
    even = vi.sampled_views(v, centres, 4, 10, seed=1).toPandas().groupby("vid").size() / 2000
    assert ((even - 0.4).abs() < 0.05).all()
    assert vi.sampled_views(v, centres, 4, 10, fisheye=True, seed=1).exceptAll(spark.createDataFrame(got)).count() == 0
    assert vi.sampled_views(v, centres.limit(3), 4, 10, max_distance=2.0).count() == 9
    with pytest.raises(ValueError):
        vi.sampled_views(v, centres, 4, 3)
