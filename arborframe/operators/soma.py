"""A soma found where the branches that leave it begin.

Radii along a branch fall, on the way out of a soma, from the soma's to the
branch's. The onset of each branch is found by a logistic curve fitted to its profile,
and branches vote on what is soma. Profiles are independent of each other and fitted many at
a time in numpy; everything else is joins and sums over subtrees, so that
neither a tree nor all of its branches are in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tree as t
from .tables import cut

WINDOW, LEAST_POINTS = 21, 4
#: Fixed values of the curve h / (1 + exp(k (x - m))) + a: start and lower and upper bounds of h, k, m, a.
START, LOW, HIGH = (10.0, 1.0, 10.0, 1.0), (0.0, 0.5, 0.0, 0.0), (np.inf, 5.0, np.inf, np.inf)


def curve(x: np.ndarray, h, k, m, a) -> np.ndarray:
    return h / (1 + np.exp(np.clip(k * (x - m), -700, 700))) + a


def smoothed(y: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Running median (zeros beyond the ends), then the largest value so far: radii that don't fall towards the soma."""
    half = window // 2
    padded = np.concatenate([np.zeros(half), y, np.zeros(half)])
    return np.maximum.accumulate(np.median(np.lib.stride_tricks.sliding_window_view(padded, window), axis=1))


def weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Less weight for thick parts, and for what lies near the tip."""
    return 1 / (np.maximum(y, 2) * curve(x.max() - x, 2, 1, 5, 1))


def fit(profiles: list[tuple[np.ndarray, np.ndarray]], rounds: int = 300) -> np.ndarray:
    """Parameters (h, k, m, a) of each profile (x, y) by damped Gauss-Newton steps within the bounds, all profiles at once."""
    n, longest = len(profiles), max((len(x) for x, _ in profiles), default=0)
    x, y, w = (np.zeros((n, longest)) for _ in range(3))
    for i, (px, py) in enumerate(profiles):
        x[i, : len(px)], y[i, : len(px)] = px, py
        w[i, : len(px)] = weights(px, py)
    low, high = np.array(LOW), np.array(HIGH)
    p, damp, open_ = np.tile(START, (n, 1)), np.full(n, 1e-2), np.ones(n, bool)

    def residual(q: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (curve(x[at], *(c[:, None] for c in q.T)) - y[at]) * w[at]

    cost = (residual(p, np.arange(n)) ** 2).sum(1)
    for _ in range(rounds):
        at = np.flatnonzero(open_)
        if not len(at):
            break
        h, k, m, _ = (c[:, None] for c in p[at].T)
        s = 1 / (1 + np.exp(np.clip(k * (x[at] - m), -700, 700)))
        slope = h * s * (1 - s)
        j = np.stack([s, -slope * (x[at] - m), slope * k, np.ones_like(s)], 2) * w[at][:, :, None]
        r = residual(p[at], at)
        g = (j * r[:, :, None]).sum(1)
        # a parameter at its bound that would leave it stays
        held = ((p[at] <= low) & (g > 0)) | ((p[at] >= high) & (g < 0))
        j[np.broadcast_to(held[:, None, :], j.shape)] = 0
        a = np.einsum("nij,nik->njk", j, j)
        diagonal = np.einsum("nii->ni", a)
        a = a + np.eye(4) * (damp[at][:, None] * np.maximum(diagonal, 1e-12) + held)[:, :, None]
        step = np.linalg.solve(a, -np.where(held, 0, g)[:, :, None])[:, :, 0]
        q = np.clip(p[at] + step, low, high)
        new = (residual(q, at) ** 2).sum(1)
        better = new < cost[at]
        settled = better & (cost[at] - new <= 1e-12 * cost[at])
        p[at[better]], damp[at] = q[better], np.where(better, damp[at] / 3, damp[at] * 4)
        cost[at] = np.where(better, new, cost[at])
        open_[at] = ~settled & (damp[at] < 1e12) & (cost[at] > 1e-24)
    return p


def onset(p: np.ndarray, farthest: np.ndarray, cutoff: float, least: float, span: float, dynamic: bool) -> np.ndarray:
    """Where each curve has fallen to the share cutoff of its height; NaN where that isn't between 0 and the profile's end.

    dynamic: flat curves (small k) are cut lower, down to `least`.
    """
    h, k, m, a = p.T
    share = np.minimum(cutoff, least + (cutoff - least) * np.maximum(0, (k - LOW[1]) / span)) if dynamic else np.full(len(p), cutoff)
    with np.errstate(all="ignore"):
        at = m + np.log(h / (share * (h - a)) - 1) / k
        return np.where((h > a) & (at >= 0) & (at <= farthest), at, np.nan)


def branch_onsets(ways: DataFrame, fallback_radius: float, cutoff: float = 0.2, least: float = 0.1, span: float = 1.0, dynamic: bool = False) -> DataFrame:
    """ways (skel_id, tip, pos, dist, radius, away), pos up from the tip, dist to the root, away from the soma's point -> (skel_id, tip, pos, fitted): the first soma vertex of each.

    Profiles that are too short or whose curve has no onset take the vertex whose distance from the point is nearest to fallback_radius.
    """
    lists = ways.groupBy("skel_id", "tip").agg(F.sort_array(F.collect_list(F.struct("pos", "dist", "radius", "away"))).alias("way"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            usable, profiles, out = [], [], []
            for i, way in enumerate(b["way"]):
                pos, dist, radius, away = (np.array([np.nan if r[c] is None else r[c] for r in way], float) for c in ("pos", "dist", "radius", "away"))
                good = np.flatnonzero(np.isfinite(radius))
                out.append((int(pos[np.abs(away - fallback_radius).argmin()]), False))
                if len(good) >= LEAST_POINTS:
                    usable.append((i, pos[good], dist[good] / 1000))
                    profiles.append((dist[good] / 1000, smoothed(radius[good] / 1000)))
            if usable:
                at = onset(fit(profiles), np.array([x.max() for _, _, x in usable]), cutoff, least, span, dynamic)
                for (i, pos, x), o in zip(usable, at, strict=True):
                    if np.isfinite(o):
                        out[i] = (int(pos[np.abs(x - o).argmin()]), True)
            yield pd.DataFrame({"skel_id": b["skel_id"], "tip": b["tip"], "pos": [o[0] for o in out], "fitted": [o[1] for o in out]})

    return lists.mapInPandas(run, "skel_id long, tip long, pos int, fitted boolean")


def _away(df: DataFrame, soma: DataFrame) -> DataFrame:
    return df.join(soma, "skel_id").withColumn("away", F.sqrt(sum((F.pow(F.col(k).cast("double") - F.col(f"p{k}"), F.lit(2.0)) for k in "xyz"), F.lit(0.0)))).drop("px", "py", "pz")


def _within(tree: DataFrame, out: DataFrame) -> DataFrame:
    """(skel_id, sid): vertices without any of `out` (skel_id, sid) at or above them."""
    reached = t.climb(tree, out).select("skel_id", "sid", "to")
    return reached.join(out.select("skel_id", F.col("sid").alias("to")).distinct(), ["skel_id", "to"], "left_anti").select("skel_id", "sid")


def _all_in(tree: DataFrame, kept: DataFrame) -> DataFrame:
    """(skel_id, sid): those of `kept` (skel_id, sid) whose whole way to the root is in kept; only these are climbed."""
    some = cut(tree.join(kept.select("skel_id", "sid").hint("merge"), ["skel_id", "sid"], "left_semi"))
    roots = some.filter("parent is null").select("skel_id", F.col("sid").alias("to"))
    return t.climb(some, roots.withColumnRenamed("to", "sid")).join(roots, ["skel_id", "to"], "left_semi").select("skel_id", "sid")


def soma_from_branches(
    skel: DataFrame, soma: DataFrame, search_radius: float = 20_000.0, fallback_radius: float = 15_000.0,
    cutoff: float = 0.2, min_cutoff: float = 0.1, dynamic_range: float = 1.0, dynamic: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """skel (skel_id, sid, parent, w, x, y, z, radius), soma (skel_id, px, py, pz): (skel_id, sid) of the soma's vertices, and (skel_id, radius).

    Vertices nearer than search_radius whose way to the root stays that near make the region; the branches
    that leave it are fitted, seen from the region's vertex whose radius is nearest to the 98th percentile. A vertex
    is soma if more than half of the branches that pass it say so; a tip within the region says so for its whole
    way, and for certain within fallback_radius. The tree is cut below the first soma vertex of each branch,
    and what stays with the root is the soma; its radius is the median of the region's in it.
    Trees whose root is not in the region have no soma. Radii may be missing.
    Ways, votes and the new root concern only the segments that begin within the region, and vertices all of
    whose way is near: a part of the tree with all above it, which is cut out before anything goes in rounds.
    """
    skel = cut(skel)
    tree = skel.select("skel_id", "sid", "parent", "w")
    paths = t.Lifts(tree)
    placed = cut(_away(skel.select("skel_id", "sid", "radius", *"xyz"), soma).select("skel_id", "sid", "radius", "away"))
    close = placed.filter(F.col("away") < search_radius)
    good_heads = _all_in(tree, close).withColumnRenamed("sid", "head")
    begun = cut(t.segment_heads(tree, paths).join(good_heads, ["skel_id", "head"], "left_semi").select("skel_id", "sid"))
    region = cut(begun.join(close, ["skel_id", "sid"]).select("skel_id", "sid", "radius", "away"))

    inside = region.select("skel_id", F.col("sid").alias("parent"))
    tips = cut(tree.join(inside, ["skel_id", "parent"], "left_semi").select("skel_id", "sid").join(region, ["skel_id", "sid"], "left_anti"))
    typical = region.groupBy("skel_id").agg(F.percentile("radius", F.lit(0.98)).alias("typical"))
    roots = cut(region.join(typical, "skel_id").groupBy("skel_id").agg(F.min(F.struct(F.coalesce(F.abs(F.col("radius") - F.col("typical")), F.lit(float("inf"))).alias("d"), "sid")).alias("m")).select("skel_id", "m.sid"))
    rooted = roots.select("skel_id")
    core = cut(tree.join(begun.unionAll(tips).hint("merge"), ["skel_id", "sid"], "left_semi"))  # with all that is above
    turned_core = cut(t.reroot(core, t.Lifts(core), roots).join(rooted, "skel_id", "left_semi"))
    outer = tree.join(core.select("skel_id", "sid").hint("merge"), ["skel_id", "sid"], "left_anti").join(rooted, "skel_id", "left_semi")
    turned = cut(turned_core.unionByName(outer))
    near_ways = cut(_all_in(turned, close))
    part = cut(turned_core.unionByName(outer.join(near_ways.hint("merge"), ["skel_id", "sid"], "left_semi")))
    lifts = t.Lifts(part)

    ways = cut(t.path_to_root(lifts, tips).select("skel_id", F.col("sid").alias("tip"), "pos", F.col("anc").alias("sid")))
    dist = t.to_root(lifts).select("skel_id", "sid", "dist")
    seen = ways.filter("pos > 0").join(dist, ["skel_id", "sid"]).join(region, ["skel_id", "sid"])
    first = cut(branch_onsets(seen.select("skel_id", "tip", "pos", "dist", "radius", "away"), fallback_radius, cutoff, min_cutoff, dynamic_range, dynamic))

    # a vote for every vertex above its place: sums over subtrees in place of all ways
    def votes(places: DataFrame, all_: int, yes: int, sure: bool) -> DataFrame:
        return places.select("skel_id", "sid", F.lit(all_).alias("n"), F.lit(yes).alias("yes"), F.lit(int(sure)).alias("sure"))

    begins = ways.filter("pos = 1").select("skel_id", "sid")
    says = ways.join(first.select("skel_id", "tip", "pos"), ["skel_id", "tip", "pos"]).select("skel_id", "sid")
    ends = near_ways.join(turned.select("skel_id", F.col("parent").alias("sid")).hint("merge"), ["skel_id", "sid"], "left_anti")
    cast = cut(votes(begins, 1, 0, False).unionAll(votes(says, 0, 1, False)).unionAll(votes(ends, 1, 1, True)).groupBy("skel_id", "sid").agg(*[F.sum(c).alias(c) for c in ("n", "yes", "sure")]))
    total: Column = F.col("sure").cast("boolean") & (F.col("away") < fallback_radius) | (2 * F.col("yes") > F.col("n"))
    is_soma = cut(t.below(lifts, cast, F.sum).join(placed, ["skel_id", "sid"]).filter(total).select("skel_id", "sid"))

    reached = ways.join(is_soma, ["skel_id", "sid"], "left_semi").groupBy("skel_id", "tip").agg(F.min("pos").alias("pos")).filter("pos > 0")
    last = cut(ways.join(reached.select("skel_id", "tip", (F.col("pos") - 1).alias("pos")), ["skel_id", "tip", "pos"]).select("skel_id", "sid").distinct())
    # the soma is what stays with the root when the edges above the last vertices before it are cut
    soma_vertices = cut(_within(turned, last))
    radius = soma_vertices.join(region, ["skel_id", "sid"]).groupBy("skel_id").agg(F.median("radius").alias("radius"))
    return soma_vertices, radius
