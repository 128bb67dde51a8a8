"""Shortest ways over graphs cut into blocks of bounded size.

A graph is one row a block: its edges as an array, bounded by the block's
vertices. A round settles, inside each block that got news, all distances from
what is known there (Dijkstra, in one task's memory), and sends what leaves the
block to the blocks next to it. So there are as many rounds as shortest ways
change blocks, and not as many as they have edges; blocks and sources run side
by side, and a mesh of any size is no single task.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut

BLOCK = 20_000
DEPTH = 20  # halvings of a mesh' box
_KEPT = 6
_EDGE = "array<struct<src: bigint, dst: bigint, w: double, to: bigint>>"
_COLUMNS = {"mesh_id": "long", "block": "long", "source": "long", "kind": "int", "edge": _EDGE, "vid": "array<long>", "dist": "array<double>", "pred": "array<long>"}
_ROW = ", ".join(f"{k} {v}" for k, v in _COLUMNS.items())


def id_block(vid: str, size: int = BLOCK):
    """The block of an id where nothing is known but ids: runs of `size`."""
    return F.floor(F.col(vid) / F.lit(size)).cast("long")


def spatial_blocks(vertex: DataFrame, size: int = BLOCK) -> DataFrame:
    """(mesh_id, vid, block): cubes of space with `size` vertices at most, each halved while it holds more; vertices of one place are dealt by id."""
    span = vertex.groupBy("mesh_id").agg(*[F.min(k).cast("double").alias(f"m{k}") for k in "xyz"], F.greatest(*[F.max(k) - F.min(k) for k in "xyz"]).cast("double").alias("side"))
    cell = lambda k: F.least(F.floor((F.col(k) - F.col(f"m{k}")) / F.when(F.col("side") > 0, F.col("side")).otherwise(1.0) * (1 << DEPTH)), F.lit((1 << DEPTH) - 1)).cast("int")
    todo = vertex.join(span, "mesh_id").select("mesh_id", "vid", *[cell(k).alias(f"c{k}") for k in "xyz"])
    done = None
    for level in range(DEPTH + 1):
        cube = [F.shiftright(f"c{k}", DEPTH - level).alias(f"q{k}") for k in "xyz"]
        dealt = todo.select("*", *cube)
        many = dealt.groupBy("mesh_id", "qx", "qy", "qz").agg(F.count("*").alias("n"))
        known = cut(dealt.join(many, ["mesh_id", "qx", "qy", "qz"]))
        last = level == DEPTH
        part = F.pmod(F.col("vid"), F.ceil(F.col("n") / size)) if last else F.lit(0).cast("long")
        fits = (known if last else known.filter(F.col("n") <= size)).select("mesh_id", "vid", F.xxhash64(F.lit(level), "qx", "qy", "qz", part).alias("block"))
        done = fits if done is None else done.unionAll(fits)
        todo = known.filter(F.col("n") > size).select("mesh_id", "vid", "cx", "cy", "cz")
        if last or todo.isEmpty():
            return done
    return done


def settle(adj: dict, dist: dict, pred: dict, news: list[tuple], limit: float | None) -> dict:
    """Bring dist and pred up to date with news (vid, dist, pred) and return what leaves: {block: {vid: (dist, pred)}}. Ties of predecessors go to the smaller."""
    heap: list[tuple[float, int]] = []

    def nearer(v: int, d: float, p: int | None, longer: bool) -> None:
        have = dist.get(v)
        if have is None or d < have:
            dist[v], pred[v] = d, p
            heapq.heappush(heap, (d, v))
        elif longer and d == have and p is not None and pred[v] is not None and p < pred[v]:
            pred[v] = p

    for v, d, p in news:
        nearer(v, d, p, True)
    leaving: dict = defaultdict(dict)
    while heap:
        d, v = heapq.heappop(heap)
        if d > dist[v]:
            continue
        for u, w, to in adj.get(v, ()):
            if limit is not None and d + w > limit:
                continue
            if to is None:
                nearer(u, d + w, v, w > 0)  # an edge of no length makes no better predecessor: two of them could be a circle
            elif u not in leaving[to] or (d + w, v) < leaving[to][u]:
                leaving[to][u] = (d + w, v)
    return leaving


def _round(limit: float | None):
    """A sorted stream: a block's edges, then for each source its state and news. Gives new states (kind 1) and news (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, adj, who, dist, pred, news = None, {}, None, {}, {}, []

        def done() -> list[dict]:
            if who is None:
                return []
            mesh, block = at
            leaving = settle(adj, dist, pred, news, limit)
            rows = [{"mesh_id": mesh, "block": block, "source": who, "kind": 1, "edge": None, "vid": list(dist), "dist": list(dist.values()), "pred": list(pred.values())}]
            for to, found in leaving.items():
                rows.append({"mesh_id": mesh, "block": to, "source": who, "kind": 2, "edge": None, "vid": list(found), "dist": [d for d, _ in found.values()], "pred": [p for _, p in found.values()]})
            return rows

        schema = None
        for batch in batches:
            schema = batch.schema
            out = []
            keys = list(zip(*[batch.column(c).to_pylist() for c in ("mesh_id", "block", "source", "kind")], strict=True))
            for i, (mesh, block, source, kind) in enumerate(keys):
                if (mesh, block) != at or source != who:
                    out += done()
                    who, dist, pred, news = source, {}, {}, []
                if (mesh, block) != at:
                    at, adj = (mesh, block), {}
                if kind == 0:
                    edge = batch.column("edge").slice(i, 1).flatten()
                    adj = defaultdict(list)
                    for a, b, w, to in zip(*[edge.field(c).to_pylist() for c in ("src", "dst", "w", "to")], strict=True):
                        adj[a].append((b, w, None if to == block else to))
                    who = None
                else:
                    rows = zip(*[batch.column(c).slice(i, 1).flatten().to_pylist() for c in ("vid", "dist", "pred")], strict=True)
                    if kind == 1:
                        for v, d, p in rows:
                            dist[v], pred[v] = d, p
                    else:
                        news += rows
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        out = done()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def shortest_paths(edges: DataFrame, sources: DataFrame, limit: float | None = None, blocks: DataFrame | None = None, rounds: int = 10_000, taken: list | None = None) -> DataFrame:
    """(mesh_id, source, vid, dist, pred): shortest ways from each source (mesh_id, source, vid), up to limit (inclusive).

    Several vertices with one `source` are one many-vertex source. Ties of
    predecessors go to the smaller one. blocks (mesh_id, vid, block) tells which vertices are settled
    together, as spatial_blocks does; without it runs of ids are. taken, if given, gets the number of rounds.
    """
    e = edges.select("mesh_id", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("w").cast("double").alias("w"))
    begin = sources.select("mesh_id", F.col("source").cast("long").alias("source"), F.col("vid").cast("long").alias("vid")).distinct()
    if blocks is None:
        e, begin = e.withColumn("block", id_block("src")).withColumn("to", id_block("dst")), begin.withColumn("block", id_block("vid"))
    else:
        of = lambda vid, name: blocks.select("mesh_id", F.col("vid").alias(vid), F.col("block").alias(name))
        e = e.join(of("src", "block"), ["mesh_id", "src"]).join(of("dst", "to"), ["mesh_id", "dst"])
        begin = begin.join(of("vid", "block"), ["mesh_id", "vid"], "left").withColumn("block", F.coalesce("block", F.lit(0).cast("long")))
    none = lambda kind: F.lit(None).cast(kind)
    graph = cut(e.groupBy("mesh_id", "block").agg(F.collect_list(F.struct("src", "dst", "w", "to")).alias("edge")))
    graph = graph.select(F.col("mesh_id").cast("long").alias("mesh_id"), "block", none("long").alias("source"), F.lit(0).alias("kind"), "edge", *[none(_COLUMNS[c]).alias(c) for c in ("vid", "dist", "pred")])
    first = begin.groupBy("mesh_id", "block", "source").agg(F.sort_array(F.collect_list("vid")).alias("vid"))
    news = first.select(F.col("mesh_id").cast("long").alias("mesh_id"), "block", "source", F.lit(2).alias("kind"), none(_EDGE).alias("edge"), "vid", F.transform("vid", lambda _: F.lit(0.0)).alias("dist"), F.transform("vid", lambda _: none("long")).alias("pred"))
    key = ["mesh_id", "block", "source"]
    history: list[DataFrame] = []

    def latest() -> DataFrame:
        if len(history) == 1:
            return history[0].drop("turn")
        all_ = history[0]
        for h in history[1:]:
            all_ = all_.unionByName(h)
        return all_.groupBy(*key).agg(F.max_by(F.struct("kind", "edge", "vid", "dist", "pred"), "turn").alias("s")).select(*key, "s.*")

    for turn in range(rounds):
        if turn:
            history.append(out.filter("kind = 1").withColumn("turn", F.lit(turn)))
            news = out.filter("kind = 2")
            if news.isEmpty():
                if taken is not None:
                    taken.append(turn)
                found = latest().select("mesh_id", "source", F.explode(F.arrays_zip("vid", "dist", "pred")).alias("r"))
                return found.select("mesh_id", "source", "r.vid", "r.dist", "r.pred")
            if len(history) > _KEPT:
                history = [cut(latest().withColumn("turn", F.lit(turn)))]
        work = graph.join(news.select("mesh_id", "block").distinct(), ["mesh_id", "block"], "left_semi").unionByName(news)
        if history:
            work = work.unionByName(latest().join(news.select(*key).distinct(), key, "left_semi"))
        ordered = work.repartition("mesh_id", "block").sortWithinPartitions("mesh_id", "block", F.col("source").asc_nulls_first(), "kind")
        out = cut(ordered.select(*_COLUMNS).mapInArrow(_round(limit), _ROW))
    raise RuntimeError("paths did not settle")
