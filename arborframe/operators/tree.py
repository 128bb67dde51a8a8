"""Rooted trees: (skel_id, sid, parent, w); w is the length of the edge to the parent, parent of a root is NULL.

Nothing writes a vertex with all its ancestors unless that is the result. `climb`
carries one row a vertex to its root, segment head or other stop by pointer
jumping; `Lifts` holds each vertex' ancestors 1, 2, 4, ... above it, from which
`below` aggregates subtrees and `lowest_common` searches, in log2(depth) rounds.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import FEW, cut

MAX_ROUNDS = 60  # of doubling: no tree is deeper, only a cycle of parents
WAY_ROUNDS = 7  # of doubling, after which a way to the root of up to 128 vertices is one array; longer ones are taken from `levels`


def _length(tree: DataFrame) -> str:
    """Whole edge lengths add up as long, others as double."""
    return "double" if tree.schema["w"].dataType.simpleString() in ("double", "float") else "long"


class Lifts:
    """A tree, and as `levels` the tables (skel_id, sid, up, dist) of the ancestor 2^k above each vertex that has one; made when first used."""

    def __init__(self, tree: DataFrame):
        self.length = _length(tree)
        self.tree = tree.select("skel_id", "sid", "parent", F.col("w").cast(self.length).alias("w"))

    @cached_property
    def levels(self) -> list[DataFrame]:
        found = [cut(self.tree.filter("parent is not null").select("skel_id", "sid", F.col("parent").alias("up"), F.col("w").alias("dist")))]
        while len(found) < MAX_ROUNDS:
            on = found[-1].select("skel_id", F.col("sid").alias("up"), F.col("up").alias("up2"), F.col("dist").alias("dist2"))
            more = cut(found[-1].join(on, ["skel_id", "up"]).select("skel_id", "sid", F.col("up2").alias("up"), (F.col("dist") + F.col("dist2")).alias("dist")))
            if more.isEmpty():
                return found
            found.append(more)
        raise ValueError("parents form a cycle")

    @cached_property
    def ways(self) -> DataFrame | None:
        """(skel_id, sid, way, dist): each vertex' way to its root, itself first, as one array; None if a way is longer than 2^WAY_ROUNDS."""
        now = cut(self.tree.select("skel_id", "sid", F.col("parent").alias("to"), F.array("sid").alias("way"), F.when(F.col("parent").isNull(), 0).otherwise(F.col("w")).alias("dist")))
        for _ in range(WAY_ROUNDS):
            going = now.filter("to is not null")
            on = now.select("skel_id", F.col("sid").alias("to"), F.col("to").alias("to2"), F.col("way").alias("way2"), F.col("dist").alias("dist2"))
            # a parent that is no vertex of the tree is where the way ends
            farther = going.join(on.hint("merge"), ["skel_id", "to"], "left").select("skel_id", "sid", F.col("to2").alias("to"), F.concat("way", F.coalesce("way2", F.array("to"))).alias("way"), (F.col("dist") + F.coalesce("dist2", F.lit(0))).alias("dist"))
            now = cut(now.filter("to is null").unionAll(farther))
            if now.filter("to is not null").isEmpty():
                return now.drop("to")
        return None

    @cached_property
    def from_root(self) -> DataFrame:
        return cut(climb(self.tree, self.tree.filter("parent is null")).withColumnRenamed("to", "root"))


def climb(tree: DataFrame, stops: DataFrame) -> DataFrame:
    """(skel_id, sid, to, hops, dist): the nearest of stops (skel_id, sid) at or above each vertex; roots are stops.

    Only vertices that haven't arrived are joined, and on vertices that aren't stops, so that a root is no hot key.
    """
    length = _length(tree)
    roots = tree.filter("parent is null").select("skel_id", "sid")
    ends = cut(stops.select("skel_id", "sid").unionAll(roots).distinct())
    here = tree.join(ends, ["skel_id", "sid"], "left_anti").select("skel_id", "sid", F.col("parent").alias("to"), F.lit(1).alias("hops"), F.col("w").cast(length).alias("dist"))
    arrives = ends.select("skel_id", F.col("sid").alias("to"), F.lit(True).alias("done"))
    own = tree.select("skel_id", "sid").join(ends, ["skel_id", "sid"], "left_semi").select("skel_id", "sid", F.col("sid").alias("to"), F.lit(0).alias("hops"), F.lit(0).cast(length).alias("dist"), F.lit(True).alias("done"))
    now = cut(here.join(arrives, ["skel_id", "to"], "left").select("skel_id", "sid", "to", "hops", "dist", F.coalesce("done", F.lit(False)).alias("done")).unionAll(own))
    for _ in range(MAX_ROUNDS):
        going = now.filter(~F.col("done"))
        if going.isEmpty():
            return now.drop("done")
        on = now.select("skel_id", F.col("sid").alias("to"), F.col("to").alias("to2"), F.col("hops").alias("hops2"), F.col("dist").alias("dist2"), F.col("done").alias("done2"))
        # a parent that is no vertex of the tree is where the way ends
        farther = going.join(on, ["skel_id", "to"], "left").select(
            "skel_id", "sid", F.coalesce("to2", "to").alias("to"), (F.col("hops") + F.coalesce("hops2", F.lit(0))).alias("hops"), (F.col("dist") + F.coalesce("dist2", F.lit(0))).alias("dist"), F.coalesce("done2", F.lit(True)).alias("done")
        )
        now = cut(now.filter("done").unionAll(farther))
    raise ValueError("parents form a cycle")


def _ways(paths: Lifts, start: DataFrame, keep: Column | None = None) -> DataFrame:
    """start (skel_id, anc, ...) with hops and dist, a row for anc and each vertex above it; as far as `keep` holds, which must not return."""
    found = cut(start.withColumns({"hops": F.lit(0), "dist": F.lit(0).cast(paths.length)}))
    others = [c for c in start.columns if c != "anc"]
    for k, level in enumerate(paths.levels):
        step = level.select("skel_id", F.col("sid").alias("anc"), "up", F.col("dist").alias("d"))
        more = found.join(step, ["skel_id", "anc"]).select(*others, F.col("up").alias("anc"), (F.col("hops") + (1 << k)).alias("hops"), (F.col("dist") + F.col("d")).alias("dist"))
        more = cut(more if keep is None else more.filter(keep))
        if more.isEmpty():
            break
        found = found.unionByName(more)
    return found


def closure(tree: DataFrame | Lifts, keep: Column | None = None) -> DataFrame:
    """(skel_id, sid, anc, hops, dist): every vertex with its ancestors, itself included; as far as `keep` holds."""
    paths = tree if isinstance(tree, Lifts) else Lifts(tree)
    return _ways(paths, paths.tree.select("skel_id", "sid", F.col("sid").alias("anc")), keep).select("skel_id", "sid", "anc", "hops", "dist")


def below(paths: Lifts, values: DataFrame, how: Callable[[str], Column]) -> DataFrame:
    """values (skel_id, sid, ...) aggregated by `how` (F.sum, F.max, F.min) over each vertex and all below it; vertices without any are missing.

    After k rounds a vertex has what is less than 2^k below it, each value once.
    """
    names = [c for c in values.columns if c not in ("skel_id", "sid")]
    now = values.groupBy("skel_id", "sid").agg(*[how(c).alias(c) for c in names])
    for level in paths.levels:
        up = now.join(level.select("skel_id", "sid", "up"), ["skel_id", "sid"]).select("skel_id", F.col("up").alias("sid"), *names)
        now = cut(now.unionByName(up).groupBy("skel_id", "sid").agg(*[how(c).alias(c) for c in names]))
    return now


def to_root(paths: Lifts) -> DataFrame:
    """(skel_id, sid, root, hops, dist) of every vertex."""
    return paths.from_root


def children(tree: DataFrame) -> DataFrame:
    """(skel_id, sid, n, kids) of vertices that have children."""
    return tree.filter("parent is not null").groupBy("skel_id", F.col("parent").alias("sid")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("sid")).alias("kids"))


def child_counts(tree: DataFrame) -> DataFrame:
    return tree.select("skel_id", "sid").join(children(tree).select("skel_id", "sid", "n"), ["skel_id", "sid"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def branch_points(tree: DataFrame) -> DataFrame:
    return children(tree).filter("n > 1").select("skel_id", "sid")


def end_points(tree: DataFrame) -> DataFrame:
    return tree.select("skel_id", "sid").join(tree.select("skel_id", F.col("parent").alias("sid")), ["skel_id", "sid"], "left_anti")


def topo_points(tree: DataFrame) -> DataFrame:
    """End, branch and root points; a point of two kinds comes twice."""
    roots = tree.filter("parent is null").select("skel_id", "sid")
    return end_points(tree).withColumn("kind", F.lit("end")).unionAll(branch_points(tree).withColumn("kind", F.lit("branch"))).unionAll(roots.withColumn("kind", F.lit("root")))


def degrees(tree: DataFrame) -> DataFrame:
    """Undirected degree; 1: end point, above 2: branch point."""
    return child_counts(tree).join(tree.select("skel_id", "sid", "parent"), ["skel_id", "sid"]).select("skel_id", "sid", (F.col("n") + F.col("parent").isNotNull().cast("int")).alias("degree"))


def path_to_root(paths: Lifts, start: DataFrame) -> DataFrame:
    """(skel_id, sid, pos, anc): the way from each start (skel_id, sid) to its root."""
    if paths.ways is not None:
        return start.select("skel_id", "sid").join(paths.ways.hint("merge"), ["skel_id", "sid"]).select("skel_id", "sid", F.posexplode("way").alias("pos", "anc"))
    known = start.select("skel_id", "sid").join(paths.tree, ["skel_id", "sid"], "left_semi")
    return _ways(paths, known.withColumn("anc", F.col("sid"))).select("skel_id", "sid", F.col("hops").alias("pos"), "anc")


def downstream(paths: Lifts, of: DataFrame, inclusive: bool = True) -> DataFrame:
    """(skel_id, of, sid): all vertices below each of `of` (skel_id, sid)."""
    known = of.select("skel_id", "sid").join(paths.tree, ["skel_id", "sid"], "left_semi")
    found = cut(known.select("skel_id", F.col("sid").alias("of"), "sid"))
    for level in paths.levels:
        down = level.select("skel_id", F.col("up"), F.col("sid").alias("to"))
        more = cut(found.withColumnRenamed("sid", "up").join(down, ["skel_id", "up"]).select("skel_id", "of", F.col("to").alias("sid")))
        if more.isEmpty():
            break
        found = found.unionByName(more)
    return found if inclusive else found.filter("of <> sid")


def _met(paths: Lifts, pairs: DataFrame) -> DataFrame:
    """pairs (skel_id, a, b) of one tree with their ways and distances to the root, lca and the hops to it: what two ways have in common begins with the lowest."""
    end = lambda v: paths.ways.select("skel_id", F.col("sid").alias(v), F.col("way").alias(f"way_{v}"), F.col("dist").alias(f"dist_{v}")).hint("merge")
    at = pairs.select("skel_id", "a", "b").distinct().join(end("a"), ["skel_id", "a"]).join(end("b"), ["skel_id", "b"])
    at = at.withColumn("both", F.array_intersect("way_a", "way_b")).filter(F.size("both") > 0)
    return at.withColumns({"lca": F.col("both")[0]} | {f"hops_{v}": F.size(f"way_{v}") - F.size("both") for v in "ab"}).drop("both")


def lowest_common(paths: Lifts, pairs: DataFrame) -> DataFrame:
    """pairs (skel_id, a, b) with lca, and hops and distances of a and b to it; none for pairs of different trees.

    Where ways to the root are too long for arrays, the deeper of the two is lifted to the other's depth, then both are while they differ: one row a pair throughout.
    """
    if paths.ways is not None:
        up = paths.ways.select("skel_id", F.col("sid").alias("lca"), F.col("dist").alias("d")).hint("merge")
        at = _met(paths, pairs).drop("way_a", "way_b").join(up, ["skel_id", "lca"])
        return at.select("skel_id", "a", "b", "lca", "hops_a", "hops_b", *[(F.col(f"dist_{v}") - F.col("d")).alias(f"dist_{v}") for v in "ab"])
    far = lambda v: paths.from_root.select("skel_id", F.col("sid").alias(v), F.col("root").alias(f"root_{v}"), F.col("hops").alias(f"hops_{v}"), F.col("dist").alias(f"dist_{v}"))
    at = pairs.select("skel_id", "a", "b").distinct().join(far("a"), ["skel_id", "a"]).join(far("b"), ["skel_id", "b"]).filter("root_a = root_b").drop("root_a", "root_b")
    a_deeper = F.col("hops_a") >= F.col("hops_b")
    at = at.withColumns({"lo": F.when(a_deeper, F.col("a")).otherwise(F.col("b")), "hi": F.when(a_deeper, F.col("b")).otherwise(F.col("a")), "gap": F.abs(F.col("hops_a") - F.col("hops_b"))})
    lift = lambda level, v: level.select("skel_id", F.col("sid").alias(v), F.col("up").alias(f"{v}_up"))
    for k, level in enumerate(paths.levels):
        moved = F.when(F.col("gap").bitwiseAND(1 << k) > 0, F.col("lo_up")).otherwise(F.col("lo"))
        at = at.join(lift(level, "lo"), ["skel_id", "lo"], "left").withColumn("lo", moved).drop("lo_up")
    at = cut(at.drop("gap"))
    # hi and lo are equally deep now, so that both or neither have an ancestor of a level
    for level in reversed(paths.levels):
        apart = F.col("lo_up") != F.col("hi_up")
        both = at.join(lift(level, "lo"), ["skel_id", "lo"], "left").join(lift(level, "hi"), ["skel_id", "hi"], "left")
        at = both.withColumns({v: F.when(apart, F.col(f"{v}_up")).otherwise(F.col(v)) for v in ("lo", "hi")}).drop("lo_up", "hi_up")
    at = at.join(lift(paths.levels[0], "lo"), ["skel_id", "lo"], "left").withColumn("lca", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("lo_up")))
    up = paths.from_root.select("skel_id", F.col("sid").alias("lca"), F.col("hops").alias("h"), F.col("dist").alias("d"))
    own = [(F.col(f"{x}_{v}") - F.col(x[0])).alias(f"{x}_{v}") for x in ("hops", "dist") for v in "ab"]
    return at.join(up, ["skel_id", "lca"]).select("skel_id", "a", "b", "lca", *own)


def distance_between(paths: Lifts, pairs: DataFrame) -> DataFrame:
    """Tree distance of each pair; pairs of different trees have none."""
    return lowest_common(paths, pairs).select("skel_id", "a", "b", (F.col("dist_a") + F.col("dist_b")).alias("dist"))


def path_between(paths: Lifts, pairs: DataFrame) -> DataFrame:
    """(skel_id, a, b, pos, sid): up from a to the common ancestor, then down to b."""
    if paths.ways is not None:
        known = paths.tree.select("skel_id", F.col("sid").alias("lca")).hint("merge")
        up, down = F.expr("slice(way_a, 1, hops_a + 1)"), F.expr("reverse(slice(way_b, 1, hops_b))")
        return _met(paths, pairs).join(known, ["skel_id", "lca"], "left_semi").select("skel_id", "a", "b", F.posexplode(F.concat(up, down)).alias("pos", "sid"))
    lca = cut(lowest_common(paths, pairs))
    up = _ways(paths, lca.select("skel_id", "a", "b", F.col("hops_a").alias("most"), F.col("a").alias("anc")), F.col("hops") <= F.col("most"))
    down = _ways(paths, lca.filter("hops_b > 0").select("skel_id", "a", "b", F.col("hops_b").alias("most"), (F.col("hops_a") + F.col("hops_b")).alias("last"), F.col("b").alias("anc")), F.col("hops") < F.col("most"))
    return up.select("skel_id", "a", "b", F.col("hops").alias("pos"), F.col("anc").alias("sid")).unionByName(down.select("skel_id", "a", "b", (F.col("last") - F.col("hops")).alias("pos"), F.col("anc").alias("sid")))


def sums_to_root(paths: Lifts, values: DataFrame) -> DataFrame:
    """values (skel_id, sid, n, v) of some vertices as (skel_id, sid, n, v, ns, vs, iv) of all: their sums over the way to the root, and that of v times the hops to it."""
    own = paths.tree.select("skel_id", "sid", "parent").join(values.select("skel_id", "sid", "n", "v").hint("merge"), ["skel_id", "sid"], "left")
    own = cut(own.select("skel_id", "sid", F.col("parent").alias("to"), *[F.coalesce(c, F.lit(0)).alias(c) for c in "nv"]))
    now = own.select("skel_id", "sid", "to", F.lit(1).cast("long").alias("hops"), F.col("n").alias("ns"), F.col("v").alias("vs"), (F.col("v") * 0).alias("iv"))
    for _ in range(MAX_ROUNDS):
        going = now.filter("to is not null")
        if going.isEmpty():
            return own.drop("to").join(now.drop("to", "hops").hint("merge"), ["skel_id", "sid"])
        on = now.select("skel_id", F.col("sid").alias("to"), F.col("to").alias("to2"), *[F.col(c).alias(f"{c}2") for c in ("hops", "ns", "vs", "iv")])
        more = {c: F.col(c) + F.coalesce(f"{c}2", F.lit(0)) for c in ("hops", "ns", "vs")} | {"iv": F.col("iv") + F.coalesce(F.col("iv2") + F.col("hops") * F.col("vs2"), F.lit(0))}
        farther = going.join(on.hint("merge"), ["skel_id", "to"], "left").select("skel_id", "sid", F.col("to2").alias("to"), *[e.alias(c) for c, e in more.items()])
        now = cut(now.filter("to is null").unionAll(farther))
    raise ValueError("parents form a cycle")


def sums_between(paths: Lifts, pairs: DataFrame, values: DataFrame) -> DataFrame:
    """(skel_id, a, b, n, total): values (skel_id, sid, n, v) over path_between of each pair, n summed and v times pos + 1; no way is written out."""
    sums = cut(sums_to_root(paths, values))
    at = lowest_common(paths, pairs).select("skel_id", "a", "b", "lca", "hops_a", "hops_b")
    for v in ("a", "b", "lca"):
        at = at.join(sums.select("skel_id", F.col("sid").alias(v), *[F.col(c).alias(f"{c}_{v}") for c in ("n", "v", "ns", "vs", "iv")]).hint("merge"), ["skel_id", v])
    # below the common ancestor: sums to the root less those from there
    vs = {v: F.col(f"vs_{v}") - F.col("vs_lca") for v in "ab"}
    iv = {v: F.col(f"iv_{v}") - F.col("iv_lca") - F.col(f"hops_{v}") * F.col("vs_lca") for v in "ab"}
    total = iv["a"] + vs["a"] + (F.col("hops_a") + 1) * F.col("v_lca") + (F.col("hops_a") + F.col("hops_b") + 1) * vs["b"] - iv["b"]
    return at.select("skel_id", "a", "b", (F.col("ns_a") + F.col("ns_b") - 2 * F.col("ns_lca") + F.col("n_lca")).alias("n"), total.alias("total"))


def path_length(tree: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Length of the edges with both ends in each group (skel_id, grp, sid) of vertices; of whole trees without groups."""
    if groups is None:
        return tree.groupBy("skel_id").agg(F.sum(F.when(F.col("parent").isNotNull(), F.col("w"))).alias("length"))
    g = groups.select("skel_id", "grp", "sid").distinct()
    edges = g.join(tree, ["skel_id", "sid"]).join(g.select("skel_id", "grp", F.col("sid").alias("parent"), F.lit(True).alias("__in")), ["skel_id", "grp", "parent"], "left")
    return edges.groupBy("skel_id", "grp").agg(F.coalesce(F.sum(F.when(F.col("__in"), F.col("w"))), F.lit(0)).alias("length"))


def segment_heads(tree: DataFrame, paths: Lifts) -> DataFrame:
    """(skel_id, sid, head): the nearest ancestor-or-self whose parent is a branch point, or is missing."""
    forks = branch_points(tree).select("skel_id", F.col("sid").alias("parent"))
    heads = tree.join(forks, ["skel_id", "parent"], "left_semi").select("skel_id", "sid")
    return climb(paths.tree, heads).select("skel_id", "sid", F.col("to").alias("head"))


def segments(tree: DataFrame, paths: Lifts) -> DataFrame:
    """(skel_id, sid, seg, pos): segments numbered by their least vertex, vertices from tip to base."""
    heads = segment_heads(tree, paths).join(to_root(paths).select("skel_id", "sid", "hops"), ["skel_id", "sid"])
    first = heads.groupBy("skel_id", "head").agg(F.min("sid").alias("least"))
    numbered = first.withColumn("seg", F.row_number().over(Window.partitionBy("skel_id").orderBy("least")) - 1)
    pos = F.row_number().over(Window.partitionBy("skel_id", "head").orderBy(F.desc("hops"))) - 1
    return heads.join(numbered.select("skel_id", "head", "seg"), ["skel_id", "head"]).select("skel_id", "sid", "seg", pos.alias("pos"))


def segments_plus(tree: DataFrame, paths: Lifts) -> DataFrame:
    """segments with the parent of each base as a further last vertex."""
    seg = segments(tree, paths)
    base = seg.join(tree, ["skel_id", "sid"]).groupBy("skel_id", "seg").agg(F.max("pos").alias("pos"), F.max_by("parent", "pos").alias("sid")).filter("sid is not null")
    return seg.unionByName(base.select("skel_id", "sid", "seg", (F.col("pos") + 1).alias("pos")))


def _runs(tree: DataFrame, paths: Lifts, ends: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The tree with each run without a branch as one vertex: members (skel_id, sid, to, hops, dist), to the run's top, and runs (skel_id, sid, parent, w, step, bottom, more, far, length).

    sid is a run's top vertex, bottom its last one, more hops and far below it; parent the run above, w and step the way to its top;
    length sums w over the run. A run also ends at each of `ends` (skel_id, sid). What a round costs on runs falls with their mean length.
    """
    forks = branch_points(tree)
    below_ = (forks if ends is None else forks.unionAll(ends.select("skel_id", "sid")).distinct()).select("skel_id", F.col("sid").alias("parent"))
    members = climb(paths.tree, tree.join(below_, ["skel_id", "parent"], "left_semi").select("skel_id", "sid"))
    runs = members.groupBy("skel_id", F.col("to").alias("sid")).agg(F.max_by("sid", "hops").alias("bottom"), F.max("hops").alias("more"), F.max("dist").alias("far"))
    above = members.select("skel_id", F.col("sid").alias("above"), F.col("to").alias("parent"), F.col("hops").alias("h"), F.col("dist").alias("d"))
    top = paths.tree.select("skel_id", "sid", F.col("parent").alias("above"), F.col("w").alias("own"))
    runs = runs.join(top.hint("merge"), ["skel_id", "sid"], "left").join(above.hint("merge"), ["skel_id", "above"], "left")
    on = F.col("parent").isNotNull()
    w, step = F.when(on, F.col("own") + F.col("d")).otherwise(F.lit(0).cast(paths.length)), F.when(on, F.col("h") + 1).otherwise(0).cast("long")
    return members, cut(runs.select("skel_id", "sid", "parent", w.alias("w"), step.alias("step"), "bottom", "more", "far", (F.col("far") + F.coalesce("own", F.lit(0))).alias("length")))


def _numbered(rows: DataFrame, by: str, *order: Column) -> DataFrame:
    """rows with `number`, from 0 in their order, in ranges that each get the count of those before."""
    dealt = cut(rows.repartitionByRange(by, *order).withColumn("__b", F.spark_partition_id()))
    held = dealt.groupBy(by, "__b").agg(F.count("*").alias("__n"))
    before = held.select(by, "__b", (F.sum("__n").over(Window.partitionBy(by).orderBy("__b")) - F.col("__n")).alias("__before"))
    own = F.row_number().over(Window.partitionBy(by, "__b").orderBy(*order)) - 1
    return dealt.withColumn("number", own).join(F.broadcast(before) if before.count() <= FEW else before.hint("merge"), [by, "__b"]).withColumn("number", (F.col("number") + F.col("__before")).cast("int")).drop("__b", "__before")


def cover_paths(tree: DataFrame, paths: Lifts, start: DataFrame | None = None) -> DataFrame:
    """(skel_id, sid, tip, path, pos): longest-first paths from tips, or from `start` (skel_id, sid); a vertex belongs to the farthest of them below it (ties: the larger id), or to none.

    All vertices of a run without a branch belong to one path, so that rounds go over runs.
    """
    members, runs = _runs(tree, paths, start)
    short = Lifts(runs)
    at = sums_to_root(short, runs.select("skel_id", "sid", F.col("step").alias("n"), F.col("w").alias("v"))).select("skel_id", "sid", F.col("ns").alias("top"), F.col("vs").alias("d"))
    at = cut(at.join(runs.drop("w", "step").hint("merge"), ["skel_id", "sid"]))
    if start is None:
        begin = at.join(runs.select("skel_id", F.col("parent").alias("sid")), ["skel_id", "sid"], "left_anti")
    else:
        begin = at.join(start.select("skel_id", F.col("sid").alias("bottom")).distinct(), ["skel_id", "bottom"], "left_semi")
    tips = begin.select("skel_id", "sid", F.struct((F.col("d") + F.col("far")).alias("dist"), F.col("bottom").alias("tip"), (F.col("top") + F.col("more")).alias("hops")).alias("m"))
    own = cut(below(short, tips, F.max).select("skel_id", "sid", F.col("m.tip").alias("tip"), F.col("m.hops").alias("last")).join(at.select("skel_id", "sid", "top", "length").hint("merge"), ["skel_id", "sid"]))
    # a path's length runs to the parent of its last vertex
    ends = own.groupBy("skel_id", "tip").agg(F.sum("length").alias("length"))
    named = _numbered(ends, "skel_id", F.desc("length"), F.desc("tip")).select("skel_id", "tip", F.col("number").alias("path"))
    of = own.join(named.hint("merge"), ["skel_id", "tip"]).select("skel_id", F.col("sid").alias("to"), "tip", "path", (F.col("last") - F.col("top")).alias("left"))
    return members.join(of.hint("merge"), ["skel_id", "to"]).select("skel_id", "sid", "tip", "path", (F.col("left") - F.col("hops")).cast("int").alias("pos"))


def cover_paths_plus(tree: DataFrame, paths: Lifts, start: DataFrame | None = None) -> DataFrame:
    """cover_paths with the parent of each base as a further last vertex."""
    cover = cut(cover_paths(tree, paths, start))
    last = cover.groupBy("skel_id", "tip", "path").agg(F.max(F.struct("pos", "sid")).alias("m")).select("skel_id", "tip", "path", F.col("m.pos").alias("pos"), F.col("m.sid").alias("sid"))
    base = last.join(tree.filter("parent is not null").select("skel_id", "sid", "parent"), ["skel_id", "sid"])
    return cover.unionByName(base.select("skel_id", F.col("parent").alias("sid"), "tip", "path", (F.col("pos") + 1).alias("pos")))


def cut_edges(tree: DataFrame, at: DataFrame) -> DataFrame:
    """The tree without the parent edges of `at` (skel_id, sid)."""
    marked = tree.join(at.select("skel_id", "sid", F.lit(True).alias("__cut")).distinct(), ["skel_id", "sid"], "left")
    return marked.select("skel_id", "sid", F.when(F.col("__cut").isNull(), F.col("parent")).alias("parent"), "w")


def reroot(tree: DataFrame, paths: Lifts, roots: DataFrame) -> DataFrame:
    """The tree rooted at `roots` (skel_id, sid): edges on the way to the old root turn round. An unknown root is an error."""
    missing = roots.join(tree, ["skel_id", "sid"], "left_anti")
    if not missing.isEmpty():
        raise ValueError("root is not a vertex")
    way = _ways(paths, roots.select("skel_id", "sid", F.col("sid").alias("anc"))).select("skel_id", F.col("anc").alias("sid"), F.col("hops").alias("pos"))
    before = way.select("skel_id", F.col("sid").alias("__up"), (F.col("pos") + 1).alias("pos")).join(tree.select("skel_id", F.col("sid").alias("__up"), F.col("w").alias("__w")), ["skel_id", "__up"])
    turned = way.join(before, ["skel_id", "pos"], "left").select("skel_id", "sid", F.lit(True).alias("__on"), "__up", "__w")
    out = tree.join(turned, ["skel_id", "sid"], "left")
    return out.select("skel_id", "sid", F.when(F.col("__on"), F.col("__up")).otherwise(F.col("parent")).alias("parent"), F.when(F.col("__on"), F.coalesce("__w", F.lit(0))).otherwise(F.col("w")).alias("w"))


def far_point(tree: DataFrame, paths: Lifts) -> DataFrame:
    """(skel_id, sid, dist): the vertex farthest from the root (ties: the smaller id), the default new root's other end."""
    return to_root(paths).groupBy("skel_id").agg(F.max_by(F.struct("sid", "dist"), F.struct("dist", -F.col("sid"))).alias("m")).select("skel_id", "m.sid", "m.dist")


def default_root(tree: DataFrame, paths: Lifts) -> DataFrame:
    """The tree rooted at an end of its longest way: what is farthest from any vertex is one."""
    return reroot(tree, paths, far_point(tree, paths).select("skel_id", "sid"))


def near_pairs(paths: Lifts, keep: Callable[[Column], Column], of: DataFrame | None = None) -> DataFrame:
    """(skel_id, i, j, d): vertices whose distance d along the tree `keep` holds for, which must not return; i of `of` (skel_id, sid), or of all.

    A pair is found at its lowest common ancestor only, where its ways come by different children (via) or one begins, so that none comes twice.
    """
    step = paths.tree.filter("parent is not null").select("skel_id", F.col("sid").alias("anc"), "parent", "w")
    near = closure(paths, keep(F.col("dist"))).join(step.hint("merge"), ["skel_id", "anc"])
    near = near.select("skel_id", "sid", F.col("parent").alias("anc"), F.col("anc").alias("via"), (F.col("dist") + F.col("w")).alias("dist")).filter(keep(F.col("dist")))
    near = cut(near.unionAll(paths.tree.select("skel_id", "sid", F.col("sid").alias("anc"), F.lit(None).cast(near.schema["via"].dataType), F.lit(0).cast(paths.length))))
    some = near if of is None else near.join(of.select("skel_id", "sid").hint("merge"), ["skel_id", "sid"], "left_semi")
    a = some.select("skel_id", "anc", F.col("sid").alias("i"), F.col("via").alias("via1"), F.col("dist").alias("d1"))
    b = near.select("skel_id", "anc", F.col("sid").alias("j"), F.col("via").alias("via2"), F.col("dist").alias("d2")).hint("merge")
    apart = F.col("via1").isNull() | F.col("via2").isNull() | (F.col("via1") != F.col("via2"))
    return a.join(b, ["skel_id", "anc"]).withColumn("d", F.col("d1") + F.col("d2")).filter(keep(F.col("d")) & apart).select("skel_id", "i", "j", "d")


def within_distance(paths: Lifts, of: DataFrame, limit: float) -> DataFrame:
    """(skel_id, of, sid): vertices nearer than limit along the tree."""
    return near_pairs(paths, lambda d: d < limit, of).select("skel_id", F.col("i").alias("of"), F.col("j").alias("sid"))


def jump_proximal(tree: DataFrame, paths: Lifts, of: DataFrame, hops: int = 1) -> DataFrame:
    """(skel_id, sid, to): the hops-th topological point on the way to the root, the start included; the last if there are fewer."""
    near = cut(climb(paths.tree, topo_points(tree)).select("skel_id", "sid", "to"))
    at = of.select("skel_id", "sid").join(near, ["skel_id", "sid"])
    after = tree.select("skel_id", F.col("sid").alias("to"), "parent").join(near.select("skel_id", F.col("sid").alias("parent"), F.col("to").alias("next")), ["skel_id", "parent"])
    for _ in range(hops - 1):
        at = at.join(after.select("skel_id", "to", "next"), ["skel_id", "to"], "left").select("skel_id", "sid", F.coalesce("next", "to").alias("to"))
    return at


def jump_distal(tree: DataFrame, paths: Lifts, of: DataFrame) -> DataFrame:
    """(skel_id, sid, to): the nearest topological point below, or the vertex itself if it is one."""
    topo = topo_points(tree).select("skel_id", "sid").distinct().join(to_root(paths), ["skel_id", "sid"])
    nearest = below(paths, topo.select("skel_id", "sid", F.struct("dist", "sid").alias("m")), F.min)
    return nearest.join(of, ["skel_id", "sid"], "left_semi").select("skel_id", "sid", F.col("m.sid").alias("to"))


def same_segment(tree: DataFrame, paths: Lifts, of: DataFrame) -> DataFrame:
    """(skel_id, of, sid): all vertices of the segment of each."""
    head = segment_heads(tree, paths)
    return head.join(of, ["skel_id", "sid"]).select("skel_id", F.col("sid").alias("of"), "head").join(head, ["skel_id", "head"]).select("skel_id", "of", "sid")


def same_branch(tree: DataFrame, paths: Lifts, of: DataFrame) -> DataFrame:
    """(skel_id, of, sid): all vertices below the child, towards the vertex, of the branch point proximal to it; vertices without one have none."""
    rooted = tree.filter("parent is not null").select("skel_id", F.col("sid").alias("head"))
    tops = cut(segment_heads(tree, paths).join(of.select("skel_id", "sid"), ["skel_id", "sid"]).join(rooted, ["skel_id", "head"], "left_semi"))
    parts = downstream(paths, tops.select("skel_id", F.col("head").alias("sid")).distinct())
    return tops.select("skel_id", F.col("sid").alias("of"), "head").join(parts.withColumnRenamed("of", "head"), ["skel_id", "head"]).select("skel_id", "of", "sid")


def branch_sums(tree: DataFrame, paths: Lifts, of: DataFrame, values: DataFrame) -> DataFrame:
    """(skel_id, of, ...): values (skel_id, sid, ...) summed over same_branch of each, which isn't written out."""
    rooted = tree.filter("parent is not null").select("skel_id", F.col("sid").alias("head"))
    tops = segment_heads(tree, paths).join(of.select("skel_id", "sid"), ["skel_id", "sid"]).join(rooted, ["skel_id", "head"], "left_semi")
    sums = below(paths, values, F.sum).withColumnRenamed("sid", "head")
    return tops.select("skel_id", F.col("sid").alias("of"), "head").join(sums, ["skel_id", "head"]).drop("head")


def branch_order(tree: DataFrame, paths: Lifts) -> DataFrame:
    """Branch points on the way to the root, itself and the root included; 0 at the root."""
    forks = branch_points(tree).withColumn("fork", F.lit(1))
    marked = cut(paths.tree.join(forks, ["skel_id", "sid"], "left").select("skel_id", "sid", "parent", F.coalesce("fork", F.lit(0)).cast("long").alias("w")))
    n = climb(marked, marked.filter("parent is null")).join(marked.select("skel_id", F.col("sid").alias("to"), "w"), ["skel_id", "to"])
    return n.select("skel_id", "sid", F.when(F.col("hops") == 0, 0).otherwise(F.col("dist") + F.col("w")).alias("branch_order"))


def strahler_order(tree: DataFrame, paths: Lifts) -> DataFrame:
    """Strahler order: k + 1 and more for vertices with two children of order k or more at or below them. One round per order."""
    order = tree.select("skel_id", "sid", F.lit(1).alias("strahler"))
    level, k = tree.select("skel_id", "sid", "parent"), 1
    while True:
        forks = level.filter("parent is not null").groupBy("skel_id", F.col("parent").alias("sid")).count().filter("count > 1").select("skel_id", "sid")
        up = cut(below(paths, forks.withColumn("at", F.lit(1)), F.max).select("skel_id", "sid"))
        if up.isEmpty():
            return order.groupBy("skel_id", "sid").agg(F.max("strahler").alias("strahler"))
        k += 1
        order = order.unionAll(up.select("skel_id", "sid", F.lit(k)))
        level = tree.select("skel_id", "sid", "parent").join(up, ["skel_id", "sid"], "left_semi")


def collapse_zero_edges(tree: DataFrame, paths: Lifts) -> DataFrame:
    """(skel_id, sid, to): the nearest ancestor-or-self with an edge longer than zero (or the root), which takes the vertex in."""
    return climb(paths.tree, tree.filter("parent is null or w > 0")).select("skel_id", "sid", "to")


def collapsed(tree: DataFrame, to: DataFrame | None = None) -> DataFrame:
    """The tree without the vertices that collapse_zero_edges (or `to`) puts on others; parents and all further columns are those of the vertices that stay."""
    where = cut(collapse_zero_edges(tree, Lifts(tree)) if to is None else to)
    stays = tree.join(where.filter("sid = to").select("skel_id", "sid"), ["skel_id", "sid"], "left_semi")
    above = where.select("skel_id", F.col("sid").alias("parent"), F.col("to").alias("__to"))
    out = stays.join(above, ["skel_id", "parent"], "left")
    return out.select(*[F.col("__to").alias("parent") if c == "parent" else F.col(c) for c in tree.columns])
