"""Ways between points, meshes and their trees, and how well a tree follows its mesh."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import graph as gr
from . import spatial as sp
from . import surface as su
from . import tree as t
from .blocks import spatial_blocks
from .tables import cut


def face_centres(vertex: DataFrame, face: DataFrame) -> DataFrame:
    """(mesh_id, fid, a, x, y, z): the mean of the corners, and the first corner."""
    corners = face.select("mesh_id", "fid", "a", F.explode(F.array("a", "b", "c")).alias("vid")).join(vertex, ["mesh_id", "vid"])
    return corners.groupBy("mesh_id", "fid", "a").agg(*[F.avg(k).alias(k) for k in "xyz"])


def nearest_face_vertex(points: DataFrame, vertex: DataFrame, face: DataFrame, max_distance: float | None = None) -> DataFrame:
    """(mesh_id, pid, vid, d2): first corner of the triangle whose surface is nearest to each point (mesh_id, pid, px, py, pz)."""
    return su.nearest(points, vertex, face, max_distance).select("mesh_id", "pid", F.col("a").alias("vid"), "d2")


def point_to_skeleton(points: DataFrame, vertex: DataFrame, face: DataFrame, edges: DataFrame, skeleton_vertices: DataFrame, limit: float | None = None) -> DataFrame:
    """(mesh_id, source, target, pos, vid): the shortest way along the mesh from each point to a vertex of the tree, from there to the point. None without one in reach."""
    at = cut(nearest_face_vertex(points, vertex, face).select("mesh_id", "pid", F.col("vid").alias("source")))
    blocks = cut(spatial_blocks(vertex))
    tree = cut(skeleton_vertices.select("mesh_id", "vid").distinct())
    # how far the tree is from all vertices at once; of their ways only edges that come nearer by their whole length are left
    back = edges.select("mesh_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    left = cut(gr.shortest_paths(back, tree.select("mesh_id", F.lit(0).cast("long").alias("source"), "vid"), limit, blocks).select("mesh_id", "vid", "dist"))
    end = lambda c: left.select("mesh_id", F.col("vid").alias(c), F.col("dist").alias(f"__{c}"))
    nearer = edges.join(end("src"), ["mesh_id", "src"]).join(end("dst"), ["mesh_id", "dst"]).filter(F.col("__src") == F.col("w").cast("double") + F.col("__dst"))
    start = at.select("mesh_id", "source").distinct().withColumn("vid", F.col("source")).join(left, ["mesh_id", "vid"], "left_semi")
    found = cut(gr.shortest_paths(nearer.select("mesh_id", "src", "dst", "w"), start.select("mesh_id", "source", "vid"), blocks=blocks))
    ends = found.join(tree, ["mesh_id", "vid"], "left_semi")
    nearest = ends.groupBy("mesh_id", "source").agg(F.min(F.struct("dist", "vid")).alias("m")).select("mesh_id", "source", "m.vid")
    ways = gr.path_of(found, nearest)
    return at.join(ways.hint("merge"), ["mesh_id", "source"]).select("mesh_id", F.col("pid").alias("source"), "target", "pos", "vid")


def map_merges(merges: DataFrame, vertex: DataFrame, face: DataFrame, labels: DataFrame, close: float) -> DataFrame:
    """merges (mesh_id, merge, ax..az, bx..bz) -> (mesh_id, merge, a, b): vertices of two components.

    Where both ends fall on one component, the second goes to the nearest triangle of another one
    within `close`; a merge that stays within a component is left out.
    """
    end = lambda e: merges.select("mesh_id", F.col("merge").alias("pid"), *[F.col(f"{e}{k}").alias(f"p{k}") for k in "xyz"])
    a, b = (nearest_face_vertex(end(e), vertex, face).select("mesh_id", F.col("pid").alias("merge"), F.col("vid").alias(e)) for e in "ab")
    lab = lambda e: labels.select("mesh_id", F.col("vid").alias(e), F.col("label").alias(f"l{e}"))
    both = cut(a.join(b, ["mesh_id", "merge"]).join(lab("a"), ["mesh_id", "a"]).join(lab("b"), ["mesh_id", "b"]))
    apart = both.filter("la <> lb").select("mesh_id", "merge", "a", "b")
    same = both.filter("la = lb").select("mesh_id", "merge", "a", "la")
    centres = face_centres(vertex, face).join(labels.select("mesh_id", F.col("vid").alias("a"), "label"), ["mesh_id", "a"])
    near = sp.radius_join(end("b"), centres.select("mesh_id", F.col("fid").alias("vid"), *"xyz"), close)
    near = near.select("mesh_id", F.col("pid").alias("merge"), F.col("vid").alias("fid"), "d2").join(centres.select("mesh_id", "fid", F.col("a").alias("b"), "label"), ["mesh_id", "fid"])
    moved = same.join(near, ["mesh_id", "merge"]).filter("label <> la").groupBy("mesh_id", "merge", "a").agg(F.min(F.struct("d2", "b")).alias("m"))
    return apart.unionByName(moved.select("mesh_id", "merge", "a", F.col("m.b").alias("b")))


def fill_radius(tree: DataFrame) -> DataFrame:
    """tree (skel_id, sid, parent, radius): missing radii become the mean of their neighbours', round by round until none can be filled; what is left the least radius."""
    now = tree.select("skel_id", "sid", "radius")
    links = tree.filter("parent is not null").select("skel_id", F.col("sid").alias("u"), F.col("parent").alias("v"))
    links = cut(links.unionAll(links.select("skel_id", "v", "u")))
    missing = now.filter("radius is null").count()
    while missing:
        mean = links.join(now.filter("radius is not null").withColumnRenamed("sid", "v"), ["skel_id", "v"]).groupBy("skel_id", F.col("u").alias("sid")).agg(F.avg("radius").alias("mean"))
        after = cut(now.join(mean, ["skel_id", "sid"], "left").select("skel_id", "sid", F.coalesce("radius", "mean").alias("radius")))
        before, missing = missing, after.filter("radius is null").count()
        now = after
        if missing == before:
            break
    least = now.groupBy("skel_id").agg(F.min("radius").alias("least"))
    return now.join(least, "skel_id").select("skel_id", "sid", F.coalesce("radius", "least").alias("radius"))


def path_pairs(tree: DataFrame, paths: t.Lifts, edges: DataFrame, mesh_to_skel: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """(mesh_id, tip, side, pos, vid): for each tip its way to the root along the tree (side 'tree', root left out) and along the mesh to the root's region ('mesh').

    Tree vertices stand at the mesh vertex of their own id. blocks as in shortest_paths.
    """
    tips = t.end_points(tree)
    roots = tree.filter("parent is null").select(F.col("skel_id").alias("mesh_id"), "sid")
    up = t.path_to_root(paths, tips).join(tree.filter("parent is not null").select("skel_id", F.col("sid").alias("anc")), ["skel_id", "anc"], "left_semi")
    along = up.select(F.col("skel_id").alias("mesh_id"), F.col("sid").alias("tip"), F.lit("tree").alias("side"), "pos", F.col("anc").alias("vid"))
    region = mesh_to_skel.join(roots, ["mesh_id", "sid"]).select("mesh_id", F.lit(0).cast("long").alias("source"), "vid")
    found = cut(gr.shortest_paths(edges, region, blocks=blocks))
    ways = gr.path_of(found, tips.select(F.col("skel_id").alias("mesh_id"), F.lit(0).cast("long").alias("source"), F.col("sid").alias("vid")))
    return along.unionByName(ways.select("mesh_id", F.col("target").alias("tip"), F.lit("mesh").alias("side"), "pos", "vid"))


def path_distances(pairs: DataFrame, vertex: DataFrame, radius: DataFrame, least: float = 50.0) -> DataFrame:
    """(mesh_id, tip, pos, v): distance of each tree path vertex to the nearest vertex of the mesh path, over its radius (least at least)."""
    at = pairs.join(vertex, ["mesh_id", "vid"])
    key = F.struct("mesh_id", "tip")
    a = at.filter("side = 'tree'").select(key.alias("mesh_id"), F.struct("pos", "vid").alias("pid"), *[F.col(k).alias(f"p{k}") for k in "xyz"])
    b = at.filter("side = 'mesh'").select(key.alias("mesh_id"), "vid", *"xyz").distinct()
    near = sp.k_nearest(a, b, 1).select("mesh_id.mesh_id", "mesh_id.tip", "pid.pos", F.col("pid.vid").alias("vid"), F.sqrt("d2").alias("d"))
    return near.join(radius, ["mesh_id", "vid"], "left").select("mesh_id", "tip", "pos", (F.col("d") / F.greatest(F.coalesce("radius", F.lit(least)), F.lit(least))).alias("v"))


def path_distances_on_mesh(pairs: DataFrame, edges: DataFrame, radius: DataFrame, least: float = 50.0, limit: float | None = 10_000.0, blocks: DataFrame | None = None) -> DataFrame:
    """path_distances along the mesh: (mesh_id, tip, pos, v) with the way along edges from each tree path vertex to the nearest vertex of the mesh path.

    All mesh paths spread at once, each from all its vertices under its own label, over graph blocks and up to
    limit (inclusive); for vertices that none reaches within it v is infinite.
    """
    start = pairs.filter("side = 'mesh'").select("mesh_id", F.col("tip").alias("source"), "vid")
    found = gr.shortest_paths(edges, start, limit, blocks).select("mesh_id", F.col("source").alias("tip"), "vid", "dist")
    near = pairs.filter("side = 'tree'").select("mesh_id", "tip", "pos", "vid").join(found, ["mesh_id", "tip", "vid"], "left")
    return near.join(radius, ["mesh_id", "vid"], "left").select("mesh_id", "tip", "pos", (F.coalesce("dist", F.lit(float("inf"))) / F.greatest(F.coalesce("radius", F.lit(least)), F.lit(least))).alias("v"))


def path_quality(pairs: DataFrame, vertex: DataFrame, radius: DataFrame, log_odds: list[float], p0: float, window: int = 400, step: int = 50, edges: DataFrame | None = None, least: float = 50.0, blocks: DataFrame | None = None) -> DataFrame:
    """(mesh_id, tip, score): the least score of a window of each tip's path; distances are along the mesh where its edges are given (in blocks as shortest_paths takes them), else through space."""
    far = path_distances(pairs, vertex, radius, least) if edges is None else path_distances_on_mesh(pairs, edges, radius, least, blocks=blocks)
    return g.sliding_score(far, ["mesh_id", "tip"], log_odds, p0, window, step)
