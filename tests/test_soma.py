import numpy as np
import pytest

from arborframe.operators import soma as so


def test_fit_recovers_curves():
    r = np.random.default_rng(1)
    want = np.column_stack([r.uniform(3, 12, 40), r.uniform(0.6, 4, 40), r.uniform(3, 9, 40), r.uniform(0.1, 1, 40)])
    profiles = []
    for p in want:
        x = np.sort(r.uniform(0, 20, int(r.integers(30, 120))))
        profiles.append((x, so.curve(x, *p)))
    assert np.allclose(so.fit(profiles), want, rtol=1e-4, atol=1e-5)


def test_fit_is_a_minimum_within_bounds():
    """No point of a fine net around the fit, nor of random starts near it, is better; also where a bound holds."""
    r = np.random.default_rng(2)
    profiles = []
    for k in (0.2, 1.0, 8.0):  # the first and last curve lie outside the bounds of k
        for _ in range(4):
            x = np.sort(r.uniform(0, 20, 60))
            profiles.append((x, np.maximum(0, so.curve(x, 8, k, 7, 0.3) + r.normal(0, 0.15, 60))))
    found = so.fit(profiles)
    assert (found >= so.LOW).all() and (found <= so.HIGH).all()
    for (x, y), p in zip(profiles, found, strict=True):
        cost = lambda q: (((so.curve(x, *q) - y) * so.weights(x, y)) ** 2).sum()  # noqa: B023, E731
        best = cost(p)
        for scale in (1e-3, 1e-2, 1e-1):
            for _ in range(300):
                q = np.clip(p + scale * r.standard_normal(4) * np.maximum(p, 0.1), so.LOW, so.HIGH)
                assert cost(q) >= best * (1 - 1e-7)


def test_smoothed_by_loops():
    y = np.random.default_rng(3).uniform(0, 5, 50)
    want, top = [], -np.inf
    for i in range(50):
        near = sorted([y[j] if 0 <= j < 50 else 0.0 for j in range(i - 10, i + 11)])
        top = max(top, near[10])
        want.append(top)
    assert np.allclose(so.smoothed(y), want)


def test_onset():
    p = np.array([[8.0, 1.5, 6.0, 0.4], [8.0, 1.5, 60.0, 0.4], [0.3, 1.0, 5.0, 0.4], [8.0, 0.5, 6.0, 0.4]])
    at = so.onset(p, np.full(4, 20.0), 0.2, 0.1, 1.0, False)
    assert np.isclose(so.curve(at[0], *p[0]) - 0.4, 0.2 * (8.0 - 0.4)) and np.isnan(at[1:3]).all()
    lower = so.onset(p, np.full(4, 30.0), 0.2, 0.1, 1.0, True)
    assert np.isclose(lower[0], at[0]) and np.isclose(so.curve(lower[3], *p[3]) - 0.4, 0.1 * (8.0 - 0.4))


def planted(skel, branches, onset, step=250.0, start=3, seed=0, stub=True):
    """A star around the point (0, 0, 0): thick within `onset`, thin beyond; the root somewhere inside; and the vertices that are thick."""
    r = np.random.default_rng(seed)
    rows, inside = [[skel, 0, None, 0.0, 0.0, 0.0, 0.0, 9000.0]], {0}
    sid = 0
    for _ in range(branches):
        d = r.standard_normal(3)
        d, up = d / np.linalg.norm(d), 0
        for i in range(1, 121):
            sid += 1
            at = i * step
            radius = 8500.0 / (1 + np.exp(2.0 * (at - onset) / 1000)) + 300
            rows.append([skel, sid, up, step, *map(float, at * d), None if i % 17 == 5 else float(radius)])
            if at <= onset:
                inside.add(sid)
            up = sid
    if stub:  # a short twig inside the soma
        for i in range(1, 6):
            sid += 1
            rows.append([skel, sid, 0 if i == 1 else sid - 1, step, 0.0, 0.0, float(i * step), 8000.0])
            inside.add(sid)
    parent = {x[1]: x[2] for x in rows}
    w = {x[1]: x[3] for x in rows}
    at, before, length = start, None, 0.0  # turn the way from `start` to vertex 0 round
    while at is not None:
        nxt, w_next = parent[at], w[at]
        parent[at], w[at] = before, length
        at, before, length = nxt, at, w_next
    return [(x[0], x[1], parent[x[1]], w[x[1]], *x[4:]) for x in rows], inside


SKEL = "skel_id long, sid long, parent long, w double, x double, y double, z double, radius double"


@pytest.mark.parametrize("onset", [4000.0, 6500.0])
def test_planted_soma(spark, onset):
    rows, want = [], {}
    for k in range(3):
        made, inside = planted(k, 4 + k, onset, seed=k, start=3 + 2 * k)
        rows += made
        want[k] = inside
    rows += [(9, i, i - 1 if i else None, 1000.0, 90_000.0 + 1000 * i, 0.0, 0.0, 500.0) for i in range(30)]  # far from its point
    skel = spark.createDataFrame(rows, SKEL).repartition(4)
    point = spark.createDataFrame([(k, 50.0, -80.0, 20.0) for k in (0, 1, 2, 9)], "skel_id long, px double, py double, pz double")
    soma, radius = so.soma_from_branches(skel, point)
    got = {}
    for r in soma.collect():
        got.setdefault(r["skel_id"], set()).add(r["sid"])
    assert set(got) == {0, 1, 2}
    # a curve at a fifth of its height lies this far beyond its middle
    beyond = np.log(8800 / (0.2 * (8500 - 300)) - 1) / 2 * 1000
    place = {(x[0], x[1]): np.linalg.norm(x[4:7]) for x in rows}
    for k, found in got.items():
        assert want[k] <= found
        for x in rows:
            if x[0] == k:
                assert (x[1] in found) == (place[k, x[1]] <= onset + beyond) or abs(place[k, x[1]] - onset - beyond) <= 250.0 + 1e-6
    assert {r["skel_id"] for r in radius.collect()} == {0, 1, 2} and all(5000 < r["radius"] < 8900 for r in radius.collect())


def test_votes_by_hand(spark, monkeypatch):
    """Onsets that are told: of three branches through one stem, two call it soma; the third has a tip of its own in the region."""
    rows = [(0, 0, None, 0.0, 0.0)] + [(0, i, i - 1, 1000.0, 1000.0 * i) for i in range(1, 6)]
    rows += [(0, 10 + i, 5 if i == 0 else 9 + i, 1000.0, 6000.0 + 1000 * i) for i in range(20)]
    rows += [(0, 40 + i, 5 if i == 0 else 39 + i, 1000.0, 6000.0 + 1000 * i) for i in range(20)]
    rows += [(0, 70 + i, 2 if i == 0 else 69 + i, 1000.0, 3000.0 + 1000 * i) for i in range(20)]
    skel = spark.createDataFrame([(a, b, c, d, x, float(b // 10), 0.0, 9000.0 if b < 6 else 500.0) for a, b, c, d, x in rows], SKEL)
    point = spark.createDataFrame([(0, 0.0, 0.0, 0.0)], "skel_id long, px double, py double, pz double")

    def told(first):
        def f(ways, *_):
            return spark.createDataFrame([(0, t, p, True) for t, p in first.items()], "skel_id long, tip long, pos int, fitted boolean")

        return f

    def soma(first):
        monkeypatch.setattr(so, "branch_onsets", told(first))
        return {r["sid"] for r in so.soma_from_branches(skel, point, search_radius=15_500.0)[0].collect()}

    # tips are the first vertices beyond the region: 10 .. 19 and 40 .. 49 are in it, 70 .. 82 are
    tips = {20: 11, 50: 11, 83: 14}  # pos of vertex 5, 5 and 2 on their ways
    assert soma(tips) == {0, 1, 2, 3, 4, 5}
    assert soma(tips | {20: 13, 50: 13}) == {0, 1, 2, 3}
    assert soma(tips | {20: 13}) == {0, 1, 2, 3}  # one of two is no majority of the stem
    assert soma({20: 8, 50: 11, 83: 14}) == {0, 1, 2, 3, 4, 5, 11, 12, 10} - {11, 12} | {12, 11}  # 10 .. 12 have one branch, which says yes


def test_only_a_part_goes_in_rounds(spark, monkeypatch):
    """Branches that begin beyond the region are no part of ways and votes, and don't change the soma."""
    rows = [(0, 0, None, 0.0, 0.0)] + [(0, i, i - 1, 1000.0, 1000.0 * i) for i in range(1, 6)]
    rows += [(0, 10 + i, 5 if i == 0 else 9 + i, 1000.0, 6000.0 + 1000 * i) for i in range(20)]
    rows += [(0, 40 + i, 5 if i == 0 else 39 + i, 1000.0, 6000.0 + 1000 * i) for i in range(20)]
    rows += [(0, 1000 * b + i, 29 if i == 0 else 1000 * b + i - 1, 1000.0, 26_000.0 + 1000 * i) for b in (1, 2) for i in range(60)]
    skel = spark.createDataFrame([(a, b, c, d, x, float(b // 10), 0.0, 9000.0 if b < 6 else 500.0) for a, b, c, d, x in rows], SKEL)
    point = spark.createDataFrame([(0, 0.0, 0.0, 0.0)], "skel_id long, px double, py double, pz double")
    monkeypatch.setattr(so, "branch_onsets", lambda *_: spark.createDataFrame([(0, t, 11, True) for t in (20, 50)], "skel_id long, tip long, pos int, fitted boolean"))
    sizes, real = [], so.t.path_to_root
    monkeypatch.setattr(so.t, "path_to_root", lambda paths, start: sizes.append(paths.tree.count()) or real(paths, start))
    assert {r["sid"] for r in so.soma_from_branches(skel, point, search_radius=15_500.0)[0].collect()} == {0, 1, 2, 3, 4, 5}
    assert sizes == [46]
