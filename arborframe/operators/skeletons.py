"""Skeletons of meshes of any size: trees of shortest ways to a root that come within a distance of every vertex.

By turns, the farthest vertex that no way has come near yet is a target, and its way to the root joins the
skeleton. A target's turn depends only on targets farther out whose ways come near it, so all vertices that
have none such are taken at once, in all components of all meshes; their ways then cover what comes after them
in the order. The result is that of one turn after the other, and rounds follow how ways crowd and not how
many there are. What ways reach is found block by block, as in `blocks.py`; no task holds a mesh.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph as gr
from . import paths as pt
from . import tree as t
from .blocks import BLOCK, shortest_paths, spatial_blocks
from .tables import cut

_KEPT = 6
_COLUMNS = {
    "mesh_id": "long",
    "block": "long",
    "kind": "int",  # 0 the block's graph, 1 what is known in it, 2 news
    "edge": "array<struct<src: bigint, dst: bigint, w: double, to: bigint>>",
    "up": "array<struct<vid: bigint, pred: bigint, to: bigint>>",
    "item": "array<struct<vid: bigint, d: double, far: double, seed: bigint>>",
}
_ROW = ", ".join(f"{k} {v}" for k, v in _COLUMNS.items())
_ON = -1.0  # as distance: the way itself passes here


class Skeletons(NamedTuple):
    tree: DataFrame  # (skel_id, sid, parent, w, x, y, z[, radius])
    mapping: DataFrame  # (mesh_id, vid, sid)


# --- who comes near: labels along ways to the root, and from there along the mesh ---


def add(found: list[tuple], d: float, key: tuple) -> bool:
    """Put (d, key) into a front of none nearer and earlier than another; False if one there is at least as near and as early."""
    if any(e <= d and k <= key for e, k in found):
        return False
    found[:] = [(e, k) for e, k in found if not (d <= e and key <= k)] + [(d, key)]
    return True


def spread(adj: dict, up: dict, best: dict, front: dict, news: list[tuple], limit: float) -> tuple[dict, dict]:
    """Bring best (vid: earliest key whose way passes) and front (vid: [(distance from a way, key)]) up to date with news (vid, d, key).

    Returns what leaves, by block: {block: {vid: key}} of ways and {block: {vid: front}} of what they reach.
    """
    ways: dict = defaultdict(dict)
    reach: dict = defaultdict(dict)
    heap: list[tuple] = []

    def near(v: int, d: float, key: tuple) -> None:
        if add(front.setdefault(v, []), d, key):
            heapq.heappush(heap, (key, d, v))

    def passes(v: int, key: tuple) -> None:
        while v not in best or key < best[v]:
            best[v] = key
            near(v, 0.0, key)
            if v not in up:
                return
            v, to = up[v]
            if to is not None:
                if v not in ways[to] or key < ways[to][v]:
                    ways[to][v] = key
                return

    for v, d, key in sorted(news, key=lambda r: (r[2], r[1])):
        if d == _ON:
            passes(v, key)
        else:
            near(v, d, key)
    while heap:
        key, d, v = heapq.heappop(heap)
        if (d, key) not in front[v]:
            continue
        for u, w, to in adj.get(v, ()):
            if d + w > limit:
                continue
            if to is None:
                near(u, d + w, key)
            else:
                add(reach[to].setdefault(u, []), d + w, key)
    return ways, reach


def _items(ways: dict, fronts: dict) -> list[dict]:
    rows = [(v, _ON, key) for v, key in ways.items()] + [(v, d, key) for v, found in fronts.items() for d, key in found]
    return [{"vid": v, "d": d, "far": -far, "seed": seed} for v, d, (far, seed) in rows]


def _round(limit: float):
    """A sorted stream: a block's graph, what is known in it, its news. Gives what is known then (kind 1) and news for others (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, adj, up, best, front, news = None, {}, {}, {}, {}, []

        def done() -> list[dict]:
            if at is None:
                return []
            ways, reach = spread(adj, up, best, front, news, limit)
            row = lambda block, kind, item: {"mesh_id": at[0], "block": block, "kind": kind, "edge": None, "up": None, "item": item}
            return [row(at[1], 1, _items(best, front))] + [row(to, 2, _items(ways.get(to, {}), reach.get(to, {}))) for to in ways.keys() | reach.keys()]

        schema = None
        for batch in batches:
            schema = batch.schema
            out = []
            for i, here in enumerate(zip(*[batch.column(c).to_pylist() for c in ("mesh_id", "block", "kind")], strict=True)):
                if here[:2] != at:
                    out += done()
                    at, adj, up, best, front, news = here[:2], defaultdict(list), {}, {}, {}, []
                if here[2] == 0:
                    edge, step = batch.column("edge").slice(i, 1).flatten(), batch.column("up").slice(i, 1).flatten()
                    for a, b, w, to in zip(*[edge.field(c).to_pylist() for c in ("src", "dst", "w", "to")], strict=True):
                        adj[a].append((b, w, None if to == at[1] else to))
                    for v, p, to in zip(*[step.field(c).to_pylist() for c in ("vid", "pred", "to")], strict=True):
                        up[v] = (p, None if to == at[1] else to)
                    continue
                item = batch.column("item").slice(i, 1).flatten()
                for v, d, far, seed in zip(*[item.field(c).to_pylist() for c in ("vid", "d", "far", "seed")], strict=True):
                    if here[2] == 2:
                        news.append((v, d, (-far, seed)))
                    elif d == _ON:
                        best[v] = (-far, seed)
                    else:
                        front.setdefault(v, []).append((d, (-far, seed)))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        out = done()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _reached(graph: DataFrame, seeds: DataFrame, limit: float, rounds: int = 10_000) -> DataFrame:
    """(mesh_id, vid, passes, far, seed): for each vertex the first seed, by far and then the smaller id, whose way comes within limit, and (passes) the first whose way it is on.

    seeds (mesh_id, block, vid, far).
    """
    key = ["mesh_id", "block"]
    none = lambda c: F.lit(None).cast(_COLUMNS[c]).alias(c)
    first = F.struct("vid", F.lit(_ON).alias("d"), "far", F.col("vid").alias("seed"))
    news = seeds.groupBy(*key).agg(F.collect_list(first).alias("item")).select(*key, F.lit(2).alias("kind"), none("edge"), none("up"), "item")
    history: list[DataFrame] = []

    def latest() -> DataFrame:
        if len(history) == 1:
            return history[0].drop("turn")
        all_ = history[0]
        for h in history[1:]:
            all_ = all_.unionByName(h)
        return all_.groupBy(*key).agg(F.max_by(F.struct("kind", "edge", "up", "item"), "turn").alias("s")).select(*key, "s.*")

    for turn in range(rounds):
        if turn:
            history.append(out.filter("kind = 1").withColumn("turn", F.lit(turn)))
            news = out.filter("kind = 2")
            if news.isEmpty():
                found = latest().select("mesh_id", F.inline("item"))
                one = F.min_by(F.struct("far", "seed"), F.struct(-F.col("far"), F.col("seed"))).alias("m")
                return found.groupBy("mesh_id", "vid", (F.col("d") == _ON).alias("passes")).agg(one).select("mesh_id", "vid", "passes", "m.far", "m.seed")
            if len(history) > _KEPT:
                history = [cut(latest().withColumn("turn", F.lit(turn)))]
        active = news.select(*key).distinct()
        work = graph.join(active, key, "left_semi").unionByName(news)
        if history:
            work = work.unionByName(latest().join(active, key, "left_semi"))
        out = cut(work.select(*_COLUMNS).repartition(*key).sortWithinPartitions(*key, "kind").mapInArrow(_round(limit), _ROW))
    raise RuntimeError("ways did not settle")


# --- skeletons ---


def far_roots(edges: DataFrame, members: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """(mesh_id, label, vid): an end of a long way in each component of members (mesh_id, vid, label), by going to the farthest vertex until it gets no farther; all components at once."""
    now = members.groupBy("mesh_id", "label").agg(F.min("vid").alias("vid")).withColumn("best", F.lit(-1.0))
    ends = None
    while True:
        now = cut(now)
        found = shortest_paths(edges, now.select("mesh_id", F.col("label").alias("source"), "vid"), blocks=blocks)
        far = found.groupBy("mesh_id", F.col("source").alias("label")).agg(F.max_by(F.struct("vid", "dist"), F.struct("dist", -F.col("vid"))).alias("m"))
        step = cut(now.join(far, ["mesh_id", "label"]))
        stop = step.filter("m.dist <= best").select("mesh_id", "label", "vid")
        ends = stop if ends is None else ends.unionAll(stop)
        now = step.filter("m.dist > best").select("mesh_id", "label", F.col("m.vid").alias("vid"), F.col("m.dist").alias("best"))
        if now.isEmpty():
            return ends


def _somas(vertex: DataFrame, edges: DataFrame, soma: DataFrame, soma_radius: float) -> DataFrame:
    """(mesh_id, vid, root): vertices within soma_radius of a mesh' soma that hang together through such with the one nearest to it, in each component that comes so near."""
    at = soma.select(F.col("mesh_id").cast("long").alias("mesh_id"), *[F.col(f"p{k}").cast("double").alias(f"__p{k}") for k in "xyz"])
    d2 = sum(((F.col(k).cast("double") - F.col(f"__p{k}")) ** 2 for k in "xyz"), F.lit(0.0))
    ball = cut(vertex.join(F.broadcast(at) if at.count() <= 100_000 else at, "mesh_id").withColumn("d2", d2).filter(F.col("d2") <= F.lit(float(soma_radius) ** 2)).select("mesh_id", "vid", "label", "d2"))
    end = lambda c: ball.select("mesh_id", F.col("vid").alias(c))
    inner = edges.join(end("src"), ["mesh_id", "src"], "left_semi").join(end("dst"), ["mesh_id", "dst"], "left_semi")
    part = gr.connected_components(ball, inner).select("mesh_id", "vid", F.col("label").alias("part"))
    ball = cut(ball.join(part, ["mesh_id", "vid"]))
    root = ball.groupBy("mesh_id", "label").agg(F.min_by(F.struct(F.col("vid").alias("root"), "part"), F.struct("d2", "vid")).alias("m")).select("mesh_id", "label", "m.*")
    return ball.join(root, ["mesh_id", "label", "part"]).select("mesh_id", "vid", "root", "label")


def targets(graph: DataFrame, todo: DataFrame, invalidation: float, taken: list | None = None) -> tuple[DataFrame, DataFrame]:
    """(targets, on): of todo (mesh_id, block, vid, far) the vertices whose ways make the skeleton, and (mesh_id, vid) on these ways.

    A vertex is a target if, of all farther targets, no way comes within invalidation of it. taken gets the number of rounds.
    """
    picked, on, turn = todo.limit(0), None, 0
    todo = cut(todo)
    while not todo.isEmpty():
        turn += 1
        first = _reached(graph, todo, invalidation).filter("not passes").select("mesh_id", "vid", "seed")
        now = cut(todo.join(first, ["mesh_id", "vid"]).filter("seed = vid").select(*todo.columns))
        cover = cut(_reached(graph, now, invalidation))
        way = cover.filter("passes").select("mesh_id", "vid")
        before = cover.filter("not passes").select("mesh_id", "vid", F.col("far").alias("__far"), "seed")
        late = (F.col("__far") > F.col("far")) | ((F.col("__far") == F.col("far")) & (F.col("seed") <= F.col("vid")))
        todo = cut(todo.join(before, ["mesh_id", "vid"], "left").filter(F.col("seed").isNull() | ~late).select(*todo.columns))
        picked, on = picked.unionByName(now), way if on is None else on.unionAll(way)
        if turn % _KEPT == 0:
            picked, on = cut(picked), cut(on.distinct())
    if taken is not None:
        taken.append(turn)
    return picked, todo.select("mesh_id", "vid") if on is None else on.distinct()


def skeletonize(
    vertex: DataFrame,
    edges: DataFrame,
    invalidation: float,
    min_component: int = 100,
    soma: DataFrame | None = None,
    soma_radius: float = 0.0,
    smooth: int = 0,
    radius: DataFrame | None = None,
    block: int = BLOCK,
    taken: list | None = None,
) -> Skeletons:
    """Trees of meshes and the tree vertex of each mesh vertex; sid is the mesh vertex' id.

    vertex (mesh_id, vid, x, y, z), edges (mesh_id, src, dst, w), taken both ways; of repeats the shortest counts.
    Components of min_component vertices or fewer are left out: their vertices map to NULL, as do
    those of meshes without edges. soma (mesh_id, px, py, pz), one row a mesh: where a component comes within soma_radius of it,
    its root is the vertex nearest to it, what hangs together with that within the radius collapses to the root, and
    the root stands at the soma; other components start from a far end. Of two targets equally far the smaller id comes
    first; a mesh vertex equally near to two tree vertices goes the way of the smaller predecessor.

    smooth: iterations that move tree vertices towards the mean of those within two edges, before the soma
    collapses; w follows the places. radius (mesh_id, vid, radius): adds the column, missing ones filled from neighbours, soma_radius at a
    collapsed root. taken, if given, gets the number of rounds.
    """
    place = vertex.select(F.col("mesh_id").cast("long").alias("mesh_id"), F.col("vid").cast("long").alias("vid"), *[F.col(k).cast("double").alias(k) for k in "xyz"])
    e = edges.filter("src <> dst").select(F.col("mesh_id").cast("long").alias("mesh_id"), F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("w").cast("double").alias("w"))
    e = e.unionAll(e.select("mesh_id", "dst", "src", "w")).groupBy("mesh_id", "src", "dst").agg(F.min("w").alias("w"))
    label = cut(gr.connected_components(place, e))
    large = label.groupBy("mesh_id", "label").agg(F.count("*").alias("n")).filter(F.col("n") > min_component).drop("n")
    members = cut(place.join(label.join(large, ["mesh_id", "label"], "left_semi"), ["mesh_id", "vid"]))
    e = cut(e.join(members.select("mesh_id", F.col("vid").alias("src")), ["mesh_id", "src"], "left_semi"))
    blocks = cut(spatial_blocks(members, block))

    # roots
    inner = None if soma is None else cut(_somas(members, e, soma, soma_radius))
    rest = members if inner is None else members.join(inner.select("mesh_id", "label").distinct(), ["mesh_id", "label"], "left_anti")
    roots = far_roots(e, rest.select("mesh_id", "vid", "label"), blocks).select("mesh_id", "vid")
    if inner is not None:
        roots = roots.unionAll(inner.select("mesh_id", F.col("root").alias("vid")).distinct())
    roots = cut(roots)

    # shortest ways to them, and the graph in blocks
    zero = F.lit(0).cast("long").alias("source")
    ways = cut(shortest_paths(e, roots.select("mesh_id", zero, "vid"), blocks=blocks).select("mesh_id", "vid", "dist", "pred").join(blocks, ["mesh_id", "vid"]))
    of = lambda vid, name: blocks.select("mesh_id", F.col("vid").alias(vid), F.col("block").alias(name))
    around = e.join(of("src", "block"), ["mesh_id", "src"]).join(of("dst", "to"), ["mesh_id", "dst"])
    around = around.groupBy("mesh_id", "block").agg(F.collect_list(F.struct("src", "dst", "w", "to")).alias("edge"))
    upward = ways.filter("pred is not null").join(of("pred", "to"), ["mesh_id", "pred"]).groupBy("mesh_id", "block").agg(F.collect_list(F.struct("vid", "pred", "to")).alias("up"))
    nothing = F.lit(None).cast(_COLUMNS["item"]).alias("item")
    empty = F.array().cast(_COLUMNS["up"])
    graph = cut(around.join(upward, ["mesh_id", "block"], "left").select("mesh_id", "block", F.lit(0).alias("kind"), "edge", F.coalesce("up", empty).alias("up"), nothing))

    # targets, and the ways from them
    todo = ways.filter("pred is not null")
    if inner is not None:
        todo = todo.join(inner, ["mesh_id", "vid"], "left_anti")
    _, on = targets(graph, todo.select("mesh_id", "block", "vid", F.col("dist").alias("far")), float(invalidation), taken)
    on = cut(on.unionAll(roots).distinct())
    skel = ways.join(on, ["mesh_id", "vid"], "left_semi").select("mesh_id", "vid", "pred").join(place, ["mesh_id", "vid"])

    # the nearest tree vertex of each mesh vertex
    near = shortest_paths(e, on.select("mesh_id", zero, "vid"), float(invalidation), blocks)
    forest = cut(near.select(F.col("mesh_id").alias("skel_id"), F.col("vid").alias("sid"), F.col("pred").alias("parent"), F.lit(0).alias("w")))
    owner = t.climb(forest, forest.filter("parent is null")).select(F.col("skel_id").alias("mesh_id"), F.col("sid").alias("vid"), F.col("to").alias("sid"))

    if smooth:
        line = skel.filter("pred is not null").select("mesh_id", F.col("vid").alias("src"), F.col("pred").alias("dst"))
        skel = skel.drop("x", "y", "z").join(gr.smooth(skel.select("mesh_id", "vid", "x", "y", "z"), line, iterations=smooth), ["mesh_id", "vid"])
    if inner is not None:
        to = inner.select("mesh_id", "vid", "root")
        skel = skel.join(to.filter("vid <> root"), ["mesh_id", "vid"], "left_anti").join(to.select("mesh_id", F.col("vid").alias("pred"), "root"), ["mesh_id", "pred"], "left")
        centre = soma.select(F.col("mesh_id").cast("long").alias("mesh_id"), *[F.col(f"p{k}").cast("double").alias(f"__{k}") for k in "xyz"]).join(to.select("mesh_id", F.col("root").alias("vid")).distinct(), "mesh_id")
        skel = skel.withColumn("pred", F.coalesce("root", "pred")).drop("root").join(centre, ["mesh_id", "vid"], "left")
        skel = skel.select("mesh_id", "vid", "pred", *[F.coalesce(f"__{k}", k).alias(k) for k in "xyz"])
        known = owner.join(to.select("mesh_id", F.col("vid").alias("sid"), "root"), ["mesh_id", "sid"], "left").select("mesh_id", "vid", F.coalesce("root", "sid").alias("sid"))
        owner = known.join(to.select("mesh_id", "vid"), ["mesh_id", "vid"], "left_anti").unionByName(to.select("mesh_id", "vid", F.col("root").alias("sid")))
    skel = cut(skel)
    upper = skel.select("mesh_id", F.col("vid").alias("pred"), *[F.col(k).alias(f"__{k}") for k in "xyz"])
    apart = F.sqrt(sum(((F.col(k) - F.col(f"__{k}")) ** 2 for k in "xyz"), F.lit(0.0)))
    made = skel.join(upper, ["mesh_id", "pred"], "left").select(F.col("mesh_id").alias("skel_id"), F.col("vid").alias("sid"), F.col("pred").alias("parent"), F.coalesce(apart, F.lit(0.0)).alias("w"), "x", "y", "z")
    if radius is not None:
        own = radius.select(F.col("mesh_id").cast("long").alias("skel_id"), F.col("vid").cast("long").alias("sid"), F.col("radius").cast("double").alias("radius"))
        made = cut(made.join(own, ["skel_id", "sid"], "left"))
        if inner is not None:
            root = inner.select(F.col("mesh_id").alias("skel_id"), F.col("root").alias("sid"), F.lit(float(soma_radius)).alias("__r")).distinct()
            made = made.join(root, ["skel_id", "sid"], "left").withColumn("radius", F.coalesce("__r", "radius")).drop("__r")
        made = made.drop("radius").join(pt.fill_radius(made.select("skel_id", "sid", "parent", "radius")), ["skel_id", "sid"])
    return Skeletons(made, place.select("mesh_id", "vid").join(owner, ["mesh_id", "vid"], "left"))
