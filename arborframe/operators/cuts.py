"""Minimum cuts of graphs cut into blocks of bounded size.

Flow is pushed block by block. A block that has excess sends as much of it as it can, along
paths inside the block, first to its sinks and then to the vertices just outside it, those
first from which a sink is fewer borders away; what leaves goes to the blocks next to it as mail. Blocks that
touch never work in the same round, so that no two of them push along one edge at once.
Labels, the number of borders between a vertex and a sink, only rise; now and then all are
set anew by shortest ways over what capacity is left. When no excess is left that could reach a sink,
those same ways tell the sinks' side. No task holds more than a block.

Method: A. Shekhovtsov and V. Hlavac, A distributed mincut/maxflow algorithm
combining path augmentation and push-relabel, IJCV 2013.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import id_block, shortest_paths, spatial_blocks
from .graph import geodesic_within, points_to_vertices
from .tables import cut

_KEPT = 6
NEVER = 1 << 40  # the label of what reaches no sink
_STATE = {
    "mesh_id": "long", "block": "long", "turn": "int", "arc": "array<struct<src: bigint, dst: bigint, to: bigint, cap: double>>",
    "node": "array<struct<vid: bigint, excess: double, sink: boolean>>", "outer": "array<struct<vid: bigint, label: bigint>>",
}
_MAIL = {"a": "long", "b": "long", "delta": "double", "label": "long"}
_MAILS = "array<struct<a: bigint, b: bigint, delta: double, label: bigint>>"
_ROW = ", ".join(f"{k} {v}" for k, v in {**_STATE, **_MAIL}.items())


def discharge(arcs: list[tuple], excess: dict, sinks: set, outer: dict) -> tuple[dict, dict]:
    """Send a block's excess out of it, changing excess. arcs (src, dst, inside, cap); outer: labels of vertices outside.

    Returns the capacities left {(src, dst): cap} and the labels {vid: label} of the block's vertices.
    """
    left = {(u, v): c for u, v, _, c in arcs}
    inside: dict[int, list[int]] = {}
    doors: dict[int, list[tuple[int, int]]] = {}  # level -> arcs that leave the block
    for u, v, within, _ in arcs:
        if within:
            inside.setdefault(u, []).append(v)
        elif outer.get(v, NEVER) < NEVER:
            doors.setdefault(outer[v] + 1, []).append((u, v))
    levels = sorted({0, *doors})

    def hops(open_doors: list[tuple[int, int]], start: set, known: dict | None = None) -> dict:
        """Edges from each vertex to a sink in start or a door; vertices in known are not entered."""
        far = dict.fromkeys(start, 0)
        for u, v in open_doors:
            if left[u, v] > 0 and u not in far and not (known and u in known):
                far[u] = 1
        todo = deque(sorted(far, key=far.get))
        while todo:
            v = todo.popleft()
            for u in inside.get(v, ()):
                if u not in far and not (known and u in known) and left.get((u, v), 0) > 0:
                    far[u] = far[v] + 1
                    todo.append(u)
        return far

    def push(start: int, far: dict, turn: dict, ways: dict) -> None:
        path, u = [start], start
        while excess.get(start, 0) > 0:
            goal = None
            if u in sinks:
                goal = u
            else:
                options = ways.setdefault(u, [*exits.get(u, ()), *inside.get(u, ())])
                k = turn.get(u, 0)
                while k < len(options):
                    v = options[k]
                    if left[u, v] > 0 and (far[u] == 1 if k < len(exits.get(u, ())) else far.get(v, -1) == far[u] - 1):
                        break
                    k += 1
                turn[u] = k
                if k == len(options):
                    if len(path) == 1:
                        return
                    path.pop()
                    u = path[-1]
                    turn[u] += 1
                    continue
                path.append(options[k])
                if k < len(exits.get(u, ())):
                    goal = options[k]
                else:
                    u = options[k]
            if goal is not None:
                steps = list(zip(path[:-1], path[1:], strict=True))
                flow = min([excess[start], *(left[s] for s in steps)])
                excess[start] -= flow
                for a, b in steps:
                    left[a, b] -= flow
                    if (b, a) in left:
                        left[b, a] += flow
                if goal in sinks:
                    excess[goal] = excess.get(goal, 0.0) + flow
                path, u = [start], start

    for i, level in enumerate(levels):
        open_doors = [d for k in levels[: i + 1] for d in doors.get(k, ())]
        exits: dict[int, list[int]] = {}
        for u, v in open_doors:
            exits.setdefault(u, []).append(v)
        while True:
            far = hops(open_doors, sinks)
            full = [v for v, x in excess.items() if x > 0 and v not in sinks and v in far]
            if not full:
                break
            turn: dict[int, int] = {}
            ways: dict[int, list[int]] = {}
            for v in sorted(full):
                push(v, far, turn, ways)
    labels: dict[int, int] = {}
    for level in levels:
        labels.update(dict.fromkeys(hops(doors.get(level, []), sinks if level == 0 else set(), labels), level))
    return left, labels


def _discharged(turn: int):
    """A block's state and mail -> its new state, and mail to other blocks (rows with a)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("mesh_id", pa.int64()), ("block", pa.int64()), ("turn", pa.int32()), ("arc", pa.list_(pa.struct([("src", pa.int64()), ("dst", pa.int64()), ("to", pa.int64()), ("cap", pa.float64())]))),
            ("node", pa.list_(pa.struct([("vid", pa.int64()), ("excess", pa.float64()), ("sink", pa.bool_())]))), ("outer", pa.list_(pa.struct([("vid", pa.int64()), ("label", pa.int64())]))),
            ("a", pa.int64()), ("b", pa.int64()), ("delta", pa.float64()), ("label", pa.int64()),
        ])
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                block = row["block"]
                cap = {(x["src"], x["dst"]): x["cap"] for x in row["arc"]}
                excess = {x["vid"]: x["excess"] for x in row["node"]}
                outer = {x["vid"]: x["label"] for x in row["outer"]}
                for m in row["mail"] or ():
                    cap[m["a"], m["b"]] += m["delta"]
                    excess[m["a"]] += m["delta"]
                    outer[m["b"]] = max(outer[m["b"]], m["label"])
                sinks = {x["vid"] for x in row["node"] if x["sink"]}
                arcs = [(x["src"], x["dst"], x["to"] == block, cap[x["src"], x["dst"]]) for x in row["arc"]]
                left, labels = discharge(arcs, excess, sinks, outer)
                state = {
                    "mesh_id": row["mesh_id"], "block": block, "turn": turn, "arc": [{**x, "cap": left[x["src"], x["dst"]]} for x in row["arc"]],
                    "node": [{**x, "excess": excess[x["vid"]]} for x in row["node"]], "outer": [{"vid": v, "label": d} for v, d in outer.items()],
                }
                sent = [
                    {"mesh_id": row["mesh_id"], "block": x["to"], "turn": turn, "a": x["dst"], "b": x["src"], "delta": cap[x["src"], x["dst"]] - left[x["src"], x["dst"]], "label": labels.get(x["src"], NEVER)}
                    for x in row["arc"] if x["to"] != block
                ]
                yield pa.RecordBatch.from_pylist([state, *sent], schema)

    return run


def sink_side(edges: DataFrame, ends: DataFrame, blocks: DataFrame | None = None, between: int = 6, rounds: int = 10_000, taken: list | None = None) -> DataFrame:
    """(mesh_id, vid): the smaller one, if there are several, of the sinks' sides of a minimum cut between ends (mesh_id, vid, is_source).

    edges (mesh_id, src, dst, w): capacities of directed edges; repeats add up, loops and what is not above 0 count for nothing.
    A vertex that is both source and sink is neither; a mesh without sinks has no rows. blocks (mesh_id, vid, block) as
    spatial_blocks makes them, else runs of ids. Labels are set anew after `between` rounds, then after twice as many,
    and so on. taken, if given, gets the number of rounds.
    """
    e = edges.filter("src <> dst and w > 0").select(*[F.col(c).cast("long").alias(c) for c in ("mesh_id", "src", "dst")], F.col("w").cast("double").alias("cap"))
    e = e.unionAll(e.select("mesh_id", F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0.0))).groupBy("mesh_id", "src", "dst").agg(F.sum("cap").alias("cap"))
    end = ends.groupBy(F.col("mesh_id").cast("long").alias("mesh_id"), F.col("vid").cast("long").alias("vid")).agg(F.min("is_source").alias("source"), F.max("is_source").alias("any")).filter("source = any").drop("any")
    if blocks is None:
        e = e.withColumns({"block": id_block("src"), "to": id_block("dst")})
        end = end.withColumn("block", id_block("vid"))
        of = None
    else:
        of = cut(blocks.select(*[F.col(c).cast("long").alias(c) for c in ("mesh_id", "vid", "block")]))
        at = lambda vid, name: of.select("mesh_id", F.col("vid").alias(vid), F.col("block").alias(name))
        e = e.join(at("src", "block"), ["mesh_id", "src"]).join(at("dst", "to"), ["mesh_id", "dst"])
        end = end.join(of, ["mesh_id", "vid"])
    arcs = cut(e.select("mesh_id", "block", "src", "dst", "to", "cap"))
    end = cut(end)
    sinks = end.filter("not source").select("mesh_id", "vid", "block")
    touching = cut(arcs.filter("block <> to").select("mesh_id", "block", F.col("to").alias("other")).distinct())
    # a source has one more than can leave it, so that it is never empty
    given = arcs.join(end.filter("source").select("mesh_id", F.col("vid").alias("src")), ["mesh_id", "src"]).groupBy("mesh_id", "block", F.col("src").alias("vid")).agg((F.sum("cap") + 1).alias("excess"))
    nodes = arcs.select("mesh_id", "block", F.col("src").alias("vid")).distinct().join(given, ["mesh_id", "block", "vid"], "left").join(sinks.withColumn("sink", F.lit(True)), ["mesh_id", "block", "vid"], "left")
    nodes = cut(nodes.select("mesh_id", "block", "vid", F.coalesce("excess", F.lit(0.0)).alias("excess"), F.coalesce("sink", F.lit(False)).alias("sink")))
    turn, key = 0, ["mesh_id", "block"]
    while turn < rounds:
        # labels anew: borders on the way to a sink, over arcs with capacity left, backwards
        open_ = arcs.filter("cap > 0").select("mesh_id", F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("block") != F.col("to")).cast("double").alias("w"))
        found = shortest_paths(open_, sinks.select("mesh_id", F.lit(0).cast("long").alias("source"), "vid"), blocks=of)
        labels = cut(found.select("mesh_id", "vid", F.col("dist").cast("long").alias("label")))
        full = cut(nodes.filter("excess > 0 and not sink").join(labels, ["mesh_id", "vid"], "left_semi").select(*key).distinct())
        if full.isEmpty():
            if taken is not None:
                taken.append(turn)
            return labels.select("mesh_id", "vid")
        outer = arcs.filter("block <> to").select(*key, F.col("dst").alias("vid")).distinct().join(labels, ["mesh_id", "vid"], "left").select(*key, F.struct("vid", F.coalesce("label", F.lit(NEVER)).alias("label")).alias("o"))
        state = arcs.groupBy(*key).agg(F.collect_list(F.struct("src", "dst", "to", "cap")).alias("arc"))
        state = state.join(nodes.groupBy(*key).agg(F.collect_list(F.struct("vid", "excess", "sink")).alias("node")), key)
        state = state.join(outer.groupBy(*key).agg(F.collect_list("o").alias("outer")), key, "left")
        state = cut(state.select(*key, F.lit(turn).alias("turn"), "arc", "node", F.coalesce("outer", F.array().cast(_STATE["outer"])).alias("outer")))
        made, sent = [state], []
        for _ in range(between):
            turn += 1
            chance = lambda c: F.xxhash64("mesh_id", c, F.lit(turn))  # noqa: B023, E731
            near = touching.join(full, key).join(full.withColumnRenamed("block", "other"), ["mesh_id", "other"]).filter(F.struct(chance("other"), "other") < F.struct(chance("block"), "block"))
            chosen = full.join(near, key, "left_anti")
            work = _latest([x.join(chosen, key, "left_semi") for x in made])
            work = work.join(_pending(work, _all([x.join(chosen, key, "left_semi") for x in sent])), key, "left") if sent else work.withColumn("mail", F.lit(None).cast(_MAILS))
            out = cut(work.mapInArrow(_discharged(turn), _ROW))
            made.append(out.filter("a is null").select(*_STATE))
            sent.append(out.filter("a is not null").select(*key, "turn", *_MAIL))
            last = _all([x.select(*key, "turn") for x in made]).groupBy(*key).agg(F.max("turn").alias("last"))
            waiting = _all(sent).filter("delta > 0").join(last, key).filter("turn > last").select(*key, F.col("a").alias("vid"))
            waiting = waiting.join(sinks, [*key, "vid"], "left_anti").select(*key)
            full = cut(waiting.unionByName(full.join(made[-1], key, "left_anti")).distinct())
            if full.isEmpty():
                break
            if len(made) > _KEPT:
                whole = cut(_latest(made))
                sent = [cut(_all(sent).join(whole.select(*key, F.col("turn").alias("last")), key).filter("turn > last").drop("last"))]
                made = [whole]
        state = cut(_latest(made))
        mail = _all(sent)
        between *= 2
        pending = _pending(state, mail)
        more = cut(pending.select(*key, F.inline("mail")))
        arcs = state.select(*key, F.inline("arc")).join(more.select(*key, F.col("a").alias("src"), F.col("b").alias("dst"), "delta"), [*key, "src", "dst"], "left")
        arcs = cut(arcs.select(*key, "src", "dst", "to", (F.col("cap") + F.coalesce("delta", F.lit(0.0))).alias("cap")))
        nodes = state.select(*key, F.inline("node")).join(more.groupBy(*key, F.col("a").alias("vid")).agg(F.sum("delta").alias("delta")), [*key, "vid"], "left")
        nodes = cut(nodes.select(*key, "vid", (F.col("excess") + F.coalesce("delta", F.lit(0.0))).alias("excess"), "sink"))
    raise RuntimeError("the flow did not settle")


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _latest(states: list[DataFrame]) -> DataFrame:
    """Each block's last state."""
    if len(states) == 1:
        return states[0]
    rest = [c for c in _STATE if c not in ("mesh_id", "block")]
    return _all(states).groupBy("mesh_id", "block").agg(F.max_by(F.struct(*rest), "turn").alias("s")).select("mesh_id", "block", "s.*")


def _pending(state: DataFrame, mail: DataFrame) -> DataFrame:
    """(mesh_id, block, mail): what came to each block since it worked; one entry an arc."""
    new = mail.join(state.select("mesh_id", "block", F.col("turn").alias("last")), ["mesh_id", "block"]).filter("turn > last")
    one = new.groupBy("mesh_id", "block", "a", "b").agg(F.sum("delta").alias("delta"), F.max("label").alias("label"))
    return one.groupBy("mesh_id", "block").agg(F.collect_list(F.struct("a", "b", "delta", "label")).alias("mail"))


def sides(edges: DataFrame, ends: DataFrame, window: float, blocks: DataFrame | None = None, taken: list | None = None) -> DataFrame:
    """(mesh_id, vid, is_source) of the vertices within `window` of the ends (mesh_id, vid, is_source) along edges both ways, cut apart.

    Meshes without a source or without a sink have no rows.
    """
    both = ends.groupBy("mesh_id").agg(F.min("is_source").alias("lo"), F.max("is_source").alias("hi")).filter("lo <> hi")
    end = cut(ends.join(both, "mesh_id", "left_semi").select("mesh_id", "vid", "is_source"))
    twice = edges.select("mesh_id", "src", "dst", "w").unionAll(edges.select("mesh_id", "dst", "src", "w"))
    near = cut(geodesic_within(twice, end.select("mesh_id", "vid").distinct(), window, blocks))
    local = twice.join(near.withColumnRenamed("vid", "src"), ["mesh_id", "src"], "left_semi").join(near.withColumnRenamed("vid", "dst"), ["mesh_id", "dst"], "left_semi")
    of = None if blocks is None else blocks.join(near, ["mesh_id", "vid"], "left_semi")
    far = sink_side(local, end, of, taken=taken).withColumn("is_source", F.lit(False))
    return near.join(far, ["mesh_id", "vid"], "left").select("mesh_id", "vid", F.coalesce("is_source", F.lit(True)).alias("is_source"))


def split_faces(face: DataFrame, edges: DataFrame, side: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Faces that stay (all corners on one side, or one on none), and links (mesh_id, a, b) for edges inside a side that no staying face has."""
    corners = face
    for c in "abc":
        corners = corners.join(side.select("mesh_id", F.col("vid").alias(c), F.col("is_source").alias(f"__{c}")), ["mesh_id", c], "left")
    stays = F.col("__a").isNull() | F.col("__b").isNull() | F.col("__c").isNull() | ((F.col("__a") == F.col("__b")) & (F.col("__b") == F.col("__c")))
    kept = corners.filter(stays).select(*face.columns)
    pairs = F.array(*[F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")) for p, q in ("ab", "bc", "ca")])
    have = kept.select("mesh_id", F.inline(pairs)).distinct()
    of = lambda c: side.select("mesh_id", F.col("vid").alias(c), F.col("is_source").alias(f"__{c}"))
    inside = edges.filter("src <> dst").select("mesh_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    inside = inside.join(of("a"), ["mesh_id", "a"]).join(of("b"), ["mesh_id", "b"]).filter("__a = __b").select("mesh_id", "a", "b")
    return kept, inside.join(have, ["mesh_id", "a", "b"], "left_anti")


def multicut(face: DataFrame, edges: DataFrame, ends: DataFrame, window: float, blocks: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cut meshes between source and sink vertices (mesh_id, vid, is_source) within `window` of them along edges.

    edges (mesh_id, src, dst, w); both directions of an edge hold its w, and repeats add up. Returns the faces that stay,
    links as split_faces makes them, and the sides (mesh_id, vid, is_source).
    """
    side = cut(sides(edges, ends, window, blocks))
    return *split_faces(face, edges, side), side


def multicut_of_points(vertex: DataFrame, face: DataFrame, edges: DataFrame, points: DataFrame, window: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """multicut between the vertices nearest to points (mesh_id, pid, px, py, pz, is_source), with blocks in space."""
    of = points.select("mesh_id", F.struct("pid", "is_source").alias("pid"), "px", "py", "pz")  # so that points don't meet themselves again
    at = points_to_vertices(of, vertex).select("mesh_id", "vid", "pid.is_source").distinct()
    return multicut(face, edges, cut(at), window, cut(spatial_blocks(vertex)))
