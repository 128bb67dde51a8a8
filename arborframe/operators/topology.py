"""Questions about a work's tree that are asked and answered in mesh vertices.

Asked are (mesh_id, vid); those without a tree vertex get no answer. A tree vertex that is
an answer stands for its least mesh vertex where one is wanted, else for all of them.
The mask of the work holds for questions and answers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph as gr
from . import tree as t
from .annotations import Meshwork
from .tables import cut, or_minus_one


def _asked(work: Meshwork, mesh_ids: DataFrame, vid: str = "vid", sid: str = "sid") -> DataFrame:
    """mesh_ids with the tree vertex of each."""
    on = work.mapping().filter("sid is not null").select("mesh_id", F.col("vid").alias(vid), F.col("sid").alias(sid))
    return mesh_ids.join(on, ["mesh_id", vid])


def _starts(asked: DataFrame) -> DataFrame:
    return asked.select(F.col("mesh_id").alias("skel_id"), "sid").distinct()


def _point(work: Meshwork) -> DataFrame:
    """(mesh_id, to_sid, to): the least mesh vertex of each tree vertex."""
    return work.mapping().filter("sid is not null").groupBy("mesh_id", F.col("sid").alias("to_sid")).agg(F.min("vid").alias("to"))


def _region(work: Meshwork) -> DataFrame:
    """(mesh_id, to_sid, vid): all of them."""
    return work.mapping().filter("sid is not null").select("mesh_id", F.col("sid").alias("to_sid"), "vid")


def parent_index(work: Meshwork, mesh_ids: DataFrame, padded: bool = False) -> DataFrame:
    """(mesh_id, vid, to): the parent of each; where there is none, no row, or -1 if padded."""
    up = work.skeleton().select(F.col("skel_id").alias("mesh_id"), "sid", F.col("parent").alias("to_sid"))
    found = _asked(work, mesh_ids).join(up, ["mesh_id", "sid"]).join(_point(work), ["mesh_id", "to_sid"], "left" if padded else "inner")
    return found.select("mesh_id", "vid", or_minus_one("to").alias("to"))


def child_index(work: Meshwork, mesh_ids: DataFrame) -> DataFrame:
    """(mesh_id, vid, to): a row for each child."""
    down = work.skeleton().filter("parent is not null").select(F.col("skel_id").alias("mesh_id"), F.col("parent").alias("sid"), F.col("sid").alias("to_sid"))
    return _asked(work, mesh_ids).join(down, ["mesh_id", "sid"]).join(_point(work), ["mesh_id", "to_sid"]).select("mesh_id", "vid", "to")


def _jumped(work: Meshwork, asked: DataFrame, jumps: DataFrame) -> DataFrame:
    on = jumps.select(F.col("skel_id").alias("mesh_id"), "sid", F.col("to").alias("to_sid"))
    return asked.join(on, ["mesh_id", "sid"]).join(_point(work), ["mesh_id", "to_sid"])


def jump_proximal(work: Meshwork, mesh_ids: DataFrame, hops: int = 1) -> DataFrame:
    """(mesh_id, vid, to): the hops-th topological point towards the root, the start included."""
    asked = _asked(work, mesh_ids)
    return _jumped(work, asked, t.jump_proximal(work.lifts.tree, work.lifts, _starts(asked), hops)).select("mesh_id", "vid", "to")


def jump_distal(work: Meshwork, mesh_ids: DataFrame) -> DataFrame:
    """(mesh_id, vid, to): the nearest topological point away from the root; a vertex on an end or branch point stays."""
    asked = _asked(work, mesh_ids)
    jumps = t.jump_distal(work.lifts.tree, work.lifts, _starts(asked))
    stays = t.end_points(work.lifts.tree).unionAll(t.branch_points(work.lifts.tree)).select(F.col("skel_id").alias("mesh_id"), "sid", F.lit(True).alias("__stays"))
    return _jumped(work, asked, jumps).join(stays, ["mesh_id", "sid"], "left").select("mesh_id", "vid", F.when(F.col("__stays"), F.col("vid")).otherwise(F.col("to")).alias("to"))


def _regions_of(work: Meshwork, asked: DataFrame, found: DataFrame) -> DataFrame:
    """found (skel_id, of, sid) as (mesh_id, of, vid)."""
    on = found.select(F.col("skel_id").alias("mesh_id"), F.col("of").alias("sid"), F.col("sid").alias("to_sid"))
    return asked.withColumnRenamed("vid", "of").join(on, ["mesh_id", "sid"]).join(_region(work), ["mesh_id", "to_sid"]).select("mesh_id", "of", "vid")


def same_segment(work: Meshwork, mesh_ids: DataFrame) -> DataFrame:
    """(mesh_id, of, vid): all mesh vertices of the segment of each."""
    asked = _asked(work, mesh_ids)
    return _regions_of(work, asked, t.same_segment(work.lifts.tree, work.lifts, _starts(asked)))


def segments(work: Meshwork) -> DataFrame:
    """(mesh_id, seg, pos, vid): segments from tip to base."""
    seg = t.segments(work.lifts.tree, work.lifts).select(F.col("skel_id").alias("mesh_id"), F.col("sid").alias("to_sid"), "seg", "pos")
    return seg.join(_region(work), ["mesh_id", "to_sid"]).select("mesh_id", "seg", "pos", "vid")


def same_branch(work: Meshwork, mesh_ids: DataFrame) -> DataFrame:
    """(mesh_id, of, vid): all mesh vertices below the branch point proximal to each, on its side; those without one have none."""
    asked = _asked(work, mesh_ids)
    return _regions_of(work, asked, t.same_branch(work.lifts.tree, work.lifts, _starts(asked)))


def _values(work: Meshwork) -> DataFrame:
    """(skel_id, sid, n, v): the mesh vertices of each tree vertex, counted, and the sum of their ids."""
    return work.mapping().filter("sid is not null").groupBy(F.col("mesh_id").alias("skel_id"), "sid").agg(F.count("*").alias("n"), F.sum("vid").alias("v"))


def branch_sums(work: Meshwork, mesh_ids: DataFrame) -> DataFrame:
    """(mesh_id, of, n, total): same_branch of each, counted, and the sum of its ids."""
    asked = _asked(work, mesh_ids)
    found = t.branch_sums(work.lifts.tree, work.lifts, _starts(asked), _values(work)).select(F.col("skel_id").alias("mesh_id"), F.col("of").alias("sid"), "n", F.col("v").alias("total"))
    return asked.withColumnRenamed("vid", "of").join(found, ["mesh_id", "sid"]).select("mesh_id", "of", "n", "total")


def within_distance(work: Meshwork, mesh_ids: DataFrame, limit: float, collapse: bool = True) -> DataFrame:
    """Mesh vertices nearer than limit along the tree: (mesh_id, vid) near any, or (mesh_id, of, vid) without collapse."""
    asked = _asked(work, mesh_ids)
    near = t.within_distance(work.lifts, _starts(asked), limit)
    if not collapse:
        return _regions_of(work, asked, near)
    on = near.select(F.col("skel_id").alias("mesh_id"), F.col("sid").alias("to_sid")).distinct()
    return on.join(_region(work), ["mesh_id", "to_sid"]).select("mesh_id", "vid")


def _asked_pairs(work: Meshwork, pairs: DataFrame) -> DataFrame:
    """pairs (mesh_id, a, b) with sa and sb."""
    return _asked(work, _asked(work, pairs.select("mesh_id", "a", "b").distinct(), "a", "sa"), "b", "sb")


def _tree_pairs(asked: DataFrame) -> DataFrame:
    return asked.select(F.col("mesh_id").alias("skel_id"), F.col("sa").alias("a"), F.col("sb").alias("b")).distinct()


def distance_between(work: Meshwork, pairs: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """pairs (mesh_id, a, b) with their distance along the tree, or along the mesh if its edges (mesh_id, src, dst, w; both ways) are given; none for pairs that aren't connected."""
    if edges is not None:
        found = gr.shortest_paths(edges, pairs.select("mesh_id", F.col("a").alias("source"), F.col("a").alias("vid")).distinct())
        return pairs.join(found.select("mesh_id", F.col("source").alias("a"), F.col("vid").alias("b"), "dist"), ["mesh_id", "a", "b"]).select("mesh_id", "a", "b", "dist")
    asked = _asked_pairs(work, pairs)
    on = t.distance_between(work.lifts, _tree_pairs(asked)).select(F.col("skel_id").alias("mesh_id"), F.col("a").alias("sa"), F.col("b").alias("sb"), "dist")
    return asked.join(on, ["mesh_id", "sa", "sb"]).select("mesh_id", "a", "b", "dist")


def path_between(work: Meshwork, pairs: DataFrame) -> DataFrame:
    """(mesh_id, a, b, pos, vid): mesh vertices on the way along the tree, in the order of pos, then vid."""
    asked = cut(_asked_pairs(work, pairs))
    on = t.path_between(work.lifts, _tree_pairs(asked)).select(F.col("skel_id").alias("mesh_id"), F.col("a").alias("sa"), F.col("b").alias("sb"), "pos", F.col("sid").alias("to_sid"))
    return asked.join(on, ["mesh_id", "sa", "sb"]).join(_region(work), ["mesh_id", "to_sid"]).select("mesh_id", "a", "b", "pos", "vid")


def path_sums(work: Meshwork, pairs: DataFrame) -> DataFrame:
    """(mesh_id, a, b, n, total): the mesh vertices of path_between of each, counted, and the sum of (pos + 1) * vid."""
    asked = cut(_asked_pairs(work, pairs))
    on = t.sums_between(work.lifts, _tree_pairs(asked), _values(work)).select(F.col("skel_id").alias("mesh_id"), F.col("a").alias("sa"), F.col("b").alias("sb"), "n", "total")
    return asked.join(on, ["mesh_id", "sa", "sb"]).select("mesh_id", "a", "b", "n", "total")


def path_length(work: Meshwork, groups: DataFrame | None = None) -> DataFrame:
    """Length of the tree's edges with both ends in each group (mesh_id, grp, vid) of mesh vertices: (mesh_id, grp, length); of the whole tree without groups."""
    if groups is None:
        return t.path_length(work.skeleton()).withColumnRenamed("skel_id", "mesh_id")
    on = _asked(work, groups).select(F.col("mesh_id").alias("skel_id"), "grp", "sid")
    return t.path_length(work.skeleton(), on).withColumnRenamed("skel_id", "mesh_id")
