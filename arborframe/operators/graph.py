"""Graphs of meshes: directed edges (mesh_id, src, dst, w)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spatial as sp
from . import tree as t
from .blocks import shortest_paths, spatial_blocks
from .tables import cut


def graph_edges(face: DataFrame, link: DataFrame | None = None) -> DataFrame:
    """(mesh_id, src, dst): three directed half-edges a face, link edges both ways; repeats stay."""
    ring = F.array(*[F.struct(F.col(p).alias("src"), F.col(q).alias("dst")) for p, q in ("ab", "bc", "ca")])
    edges = face.select("mesh_id", F.inline(ring))
    if link is not None:
        edges = edges.unionAll(link.select("mesh_id", "a", "b")).unionAll(link.select("mesh_id", "b", "a"))
    return edges


def length(vertex: DataFrame, edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """edges with the Euclidean length w of each."""
    end = lambda c, p: vertex.select("mesh_id", F.col("vid").alias(c), *[F.col(k).cast("double").alias(f"__{p}{k}") for k in "xyz"])
    both = edges.join(end(a, "p"), ["mesh_id", a]).join(end(b, "q"), ["mesh_id", b])
    return both.select(*edges.columns, F.sqrt(sum(((F.col(f"__p{k}") - F.col(f"__q{k}")) ** 2 for k in "xyz"), F.lit(0.0))).alias("w"))


def weighted_graph(edges: DataFrame, weight: Column | None = None, directed: bool = True) -> DataFrame:
    """No loops; repeats of a directed edge add up their weights; undirected: both ways."""
    e = edges.filter("src <> dst").withColumn("w", F.lit(1) if weight is None else weight)
    if not directed:
        e = e.select("mesh_id", "src", "dst", "w").unionAll(e.select("mesh_id", "dst", "src", "w"))
    return e.groupBy("mesh_id", "src", "dst").agg(F.sum("w").alias("w"))


def connected_components(vertex: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(mesh_id, vid, label): weak components, label is the least vertex. Large-star and small-star rounds."""
    now = cut(edges.filter("src <> dst").select("mesh_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    state = None
    for _ in range(rounds):
        both = now.select("mesh_id", F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select("mesh_id", "b", "a"))
        least = both.groupBy("mesh_id", "u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, ["mesh_id", "u"]).filter("v > u").select("mesh_id", F.col("v").alias("b"), F.col("m").alias("a")).distinct()
        small = large.join(large.groupBy("mesh_id", "b").agg(F.min("a").alias("m")), ["mesh_id", "b"])
        now = cut(small.select("mesh_id", F.col("m").alias("a"), "b").unionAll(small.select("mesh_id", F.col("m").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
        found = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("mesh_id", "a", "b").cast("decimal(38,0)"))).first())
        if found == state:
            return vertex.select("mesh_id", "vid").join(now.select("mesh_id", F.col("b").alias("vid"), "a"), ["mesh_id", "vid"], "left").select("mesh_id", "vid", F.coalesce("a", "vid").alias("label"))
        state = found
    raise RuntimeError("components did not settle")


def path_of(found: DataFrame, targets: DataFrame) -> DataFrame:
    """(mesh_id, source, target, pos, vid): vertices of the shortest way to each target (mesh_id, source, vid), from target to source.

    The predecessors of one source are a tree, whose ways to the root double in length each round.
    """
    one = F.struct("mesh_id", "source").alias("skel_id")
    forest = found.select(one, F.col("vid").alias("sid"), F.col("pred").alias("parent"), F.lit(0).alias("w"))
    ways = t.path_to_root(t.Lifts(cut(forest)), targets.select(one, F.col("vid").alias("sid")))
    return ways.select("skel_id.mesh_id", "skel_id.source", F.col("sid").alias("target"), "pos", F.col("anc").alias("vid"))


def paths_to_edges(paths: DataFrame) -> DataFrame:
    """(mesh_id, path, pos, vid) -> (mesh_id, path, src, dst) of neighbours on the path."""
    from pyspark.sql.window import Window

    nxt = F.lead("vid").over(Window.partitionBy("mesh_id", "path").orderBy("pos"))
    return paths.select("mesh_id", "path", F.col("vid").alias("src"), nxt.alias("dst")).filter("dst is not null")


def shared_edges(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a (mesh_id, src, dst, ...) whose pair of ends, either way round, is in b."""
    ends = lambda: (F.least("src", "dst").alias("__lo"), F.greatest("src", "dst").alias("__hi"))
    return a.select("*", *ends()).join(b.select("mesh_id", *ends()).distinct(), ["mesh_id", "__lo", "__hi"], "left_semi").select(*a.columns)


def component_starts(vertex: DataFrame, edges: DataFrame) -> DataFrame:
    """(mesh_id, vid): the least vertex of each component, lone vertices too."""
    return connected_components(vertex, edges).filter("vid = label").select("mesh_id", "vid")


def far_points(edges: DataFrame, start: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """(mesh_id, a, b, dist): ends of a long way, one for each start (mesh_id, vid), by going to the farthest vertex until it gets no farther.

    A mesh may have any number of starts, each of which goes and stops by itself: with component_starts every
    component has its row. blocks as in shortest_paths.
    """
    best, turn = None, 0
    at = start.select("mesh_id", F.col("vid").alias("source"), "vid").distinct()
    while True:
        found = shortest_paths(edges, at, blocks=blocks).groupBy("mesh_id", "source")
        far = found.agg(F.max(F.when(F.col("pred").isNull(), F.col("vid"))).alias("a"), F.max_by("vid", F.struct("dist", -F.col("vid"))).alias("b"), F.max("dist").alias("dist")).withColumn("turn", F.lit(turn))
        if best is not None:  # of equal ways the earlier
            both = best.unionByName(far).groupBy("mesh_id", "source")
            far = both.agg(F.max_by(F.struct("a", "b", "dist", "turn"), F.struct("dist", -F.col("turn"))).alias("m")).select("mesh_id", "source", "m.*")
        best = cut(far)
        more = best.filter((F.col("turn") == turn) & (F.col("dist") > 0))
        if more.isEmpty():
            return best.select("mesh_id", "a", "b", "dist")
        at, turn = more.select("mesh_id", "source", F.col("b").alias("vid")), turn + 1


def geodesic_within(edges: DataFrame, seeds: DataFrame, limit: float, blocks: DataFrame | None = None) -> DataFrame:
    """Vertices within limit (inclusive) of any seed (mesh_id, vid) along directed edges."""
    return shortest_paths(edges, seeds.select("mesh_id", F.lit(0).cast("long").alias("source"), "vid"), limit, blocks).select("mesh_id", "vid")


def points_to_vertices(points: DataFrame, vertex: DataFrame, max_valid_mapping: float | None = None) -> DataFrame:
    """(mesh_id, pid, vid): the vertex nearest to each point (mesh_id, pid, px, py, pz); points that have none nearer than max_valid_mapping are left out."""
    near = sp.k_nearest(points, vertex, 1, max_distance=max_valid_mapping)
    return (near if max_valid_mapping is None else near.filter(F.col("d2") < F.lit(float(max_valid_mapping) ** 2))).select("mesh_id", "pid", "vid")


def geodesic_near_points(vertex: DataFrame, edges: DataFrame, points: DataFrame, limit: float, max_valid_mapping: float | None = None) -> DataFrame:
    """Vertices within limit along directed edges of the vertex nearest to any point."""
    return geodesic_within(edges, points_to_vertices(points, vertex, max_valid_mapping).select("mesh_id", "vid").distinct(), limit, cut(spatial_blocks(vertex)))


def two_point_ellipse(edges: DataFrame, foci: DataFrame, pad: float, power: float = 1.0, blocks: DataFrame | None = None) -> DataFrame:
    """foci (mesh_id, f0, f1): vertices with d0^p + d1^p < (d(f0, f1) + pad)^p; meshes whose foci aren't connected have none. blocks as in shortest_paths."""
    src = foci.select("mesh_id", F.inline(F.array(F.struct(F.lit(0).cast("long").alias("source"), F.col("f0").alias("vid")), F.struct(F.lit(1).cast("long").alias("source"), F.col("f1").alias("vid")))))
    found = shortest_paths(edges, src, blocks=blocks)
    a, b = found.filter("source = 0").select("mesh_id", "vid", F.col("dist").alias("d0")), found.filter("source = 1").select("mesh_id", "vid", F.col("dist").alias("d1"))
    between = a.join(foci.select("mesh_id", F.col("f1").alias("vid")), ["mesh_id", "vid"]).select("mesh_id", F.col("d0").alias("apart"))
    both = a.join(b, ["mesh_id", "vid"]).join(between, "mesh_id")
    return both.filter(F.pow("d0", F.lit(power)) + F.pow("d1", F.lit(power)) < F.pow(F.col("apart") + pad, F.lit(power))).select("mesh_id", "vid")


def two_point_ellipse_of_points(vertex: DataFrame, edges: DataFrame, points: DataFrame, pad: float, power: float = 1.0) -> DataFrame:
    """two_point_ellipse with foci at the vertices nearest to the points of pid 0 and 1 of each mesh; meshes that lack one have none."""
    at = points_to_vertices(points.filter("pid in (0, 1)"), vertex)
    foci = at.groupBy("mesh_id").agg(F.max(F.when(F.col("pid") == 0, F.col("vid"))).alias("f0"), F.max(F.when(F.col("pid") == 1, F.col("vid"))).alias("f1"))
    return two_point_ellipse(edges, foci.filter("f0 is not null and f1 is not null"), pad, power, cut(spatial_blocks(vertex)))


def smooth(vertex: DataFrame, edges: DataFrame, rate: float = 0.1, iterations: int = 100, neighborhood: int = 2) -> DataFrame:
    """Each iteration moves vertices by rate towards the mean of those within `neighborhood` edges; lone vertices stay."""
    hop = edges.select("mesh_id", "src", "dst").unionAll(edges.select("mesh_id", "dst", "src")).filter("src <> dst").distinct()
    near = hop
    for _ in range(neighborhood - 1):
        far = near.join(hop.select("mesh_id", F.col("src").alias("dst"), F.col("dst").alias("to")), ["mesh_id", "dst"]).select("mesh_id", "src", F.col("to").alias("dst"))
        near = near.unionAll(far).filter("src <> dst").distinct()
    near = cut(near)
    now = vertex.select("mesh_id", "vid", *[F.col(k).cast("double").alias(k) for k in "xyz"])
    for i in range(iterations):
        mean = near.join(now.withColumnRenamed("vid", "dst"), ["mesh_id", "dst"]).groupBy("mesh_id", F.col("src").alias("vid")).agg(*[F.avg(k).alias(f"m{k}") for k in "xyz"])
        now = now.join(mean, ["mesh_id", "vid"], "left").select("mesh_id", "vid", *[F.coalesce(rate * F.col(f"m{k}") + (1 - rate) * F.col(k), k).alias(k) for k in "xyz"])
        if i % 5 == 4:
            now = cut(now)
    return now


def edge_averaged(edges: DataFrame) -> DataFrame:
    """(mesh_id, vid, value): mean of w over the edges at each vertex."""
    both = edges.select("mesh_id", F.col("src").alias("vid"), "w").unionAll(edges.select("mesh_id", F.col("dst").alias("vid"), "w"))
    return both.groupBy("mesh_id", "vid").agg(F.avg("w").alias("value"))


def rescale(df: DataFrame, old: tuple = (1, 1, 1), new: tuple = (1, 1, 1)) -> DataFrame:
    """Coordinates divided by the old voxel scaling and multiplied by the new."""
    return df.withColumns({k: F.col(k) / o * n for k, o, n in zip("xyz", old, new, strict=True)})
