"""Masks and filters on meshes.

vertex (mesh_id, vid, x, y, z), face (mesh_id, fid, a, b, c), link (mesh_id, a, b).
A mask is a table (mesh_id, vid) of the vertices that stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import EmptyMaskError, dense_index


def filter_shapes(shapes: DataFrame, kept: DataFrame, corners: list[str]) -> DataFrame:
    """Rows all of whose corners are kept."""
    out = shapes
    for c in corners:
        out = out.join(kept.select("mesh_id", F.col("vid").alias(c)), ["mesh_id", c], "left_semi")
    return out.select(*shapes.columns)


def nan_filter_shapes(shapes: DataFrame, kept: DataFrame, corners: list[str]) -> DataFrame:
    """As filter_shapes; a missing corner passes."""
    out = shapes
    for c in corners:
        k = kept.select(F.col("mesh_id").alias("__m"), F.col("vid").alias("__v"))
        out = out.join(k, (F.col("mesh_id") == F.col("__m")) & (F.col(c) == F.col("__v")), "left").filter(F.col("__v").isNotNull() | F.col(c).isNull()).select(*shapes.columns)
    return out


def reindex_shapes(shapes: DataFrame, kept: DataFrame, corners: list[str]) -> DataFrame:
    """filter_shapes with corners as positions among the kept vertices."""
    dense = dense_index(kept.select("mesh_id", "vid").distinct(), "mesh_id", "vid")
    out = shapes
    for c in corners:
        out = out.join(dense.select("mesh_id", F.col("vid").alias(c), F.col("dense").alias(f"__{c}")), ["mesh_id", c]).drop(c).withColumnRenamed(f"__{c}", c)
    return out.select(*shapes.columns)


def apply_mask(vertex: DataFrame, face: DataFrame, link: DataFrame, mask: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mesh of the kept vertices: faces with three kept corners, links with two kept ends. Keeping none is an error."""
    kept = mask.select("mesh_id", "vid").distinct()
    out = vertex.join(kept, ["mesh_id", "vid"], "left_semi").select(*vertex.columns)
    if out.isEmpty():
        raise EmptyMaskError("the mask keeps no vertex")
    return out, filter_shapes(face, kept, ["a", "b", "c"]), filter_shapes(link, kept, ["a", "b"])


def node_mask(vertex: DataFrame, mask: DataFrame) -> DataFrame:
    """(mesh_id, vid, in_mask) of all vertices."""
    m = mask.select("mesh_id", "vid", F.lit(True).alias("__in")).distinct()
    return vertex.select("mesh_id", "vid").join(m, ["mesh_id", "vid"], "left").select("mesh_id", "vid", F.coalesce("__in", F.lit(False)).alias("in_mask"))


def to_base(mask: DataFrame, positions: DataFrame) -> DataFrame:
    """positions (mesh_id, i) in the masked mesh -> (mesh_id, i, vid); -1 stays -1."""
    dense = dense_index(mask.select("mesh_id", "vid").distinct(), "mesh_id", "vid", "i")
    return positions.join(dense, ["mesh_id", "i"], "left").select("mesh_id", "i", F.coalesce("vid", F.lit(-1)).alias("vid"))


def from_base(mask: DataFrame, ids: DataFrame, padded: bool = False) -> DataFrame:
    """ids (mesh_id, vid) -> position in the masked mesh; others are dropped, or -1 if padded."""
    dense = dense_index(mask.select("mesh_id", "vid").distinct(), "mesh_id", "vid", "i")
    return ids.join(dense, ["mesh_id", "vid"], "left" if padded else "inner").select("mesh_id", "vid", F.coalesce("i", F.lit(-1)).alias("i"))


def reduce_vertices(vertex: DataFrame, face: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The vertices that faces use, numbered anew, and the faces in these numbers."""
    used = face.select("mesh_id", F.explode(F.array("a", "b", "c")).alias("vid")).distinct()
    dense = dense_index(vertex.join(used, ["mesh_id", "vid"], "left_semi"), "mesh_id", "vid")
    return dense, reindex_shapes(face, used, ["a", "b", "c"])


def remap_ids(ids: DataFrame, merges: DataFrame) -> DataFrame:
    """ids (mesh_id, vid) with merges (mesh_id, vid, to) applied and numbered densely: (mesh_id, vid, to)."""
    to = ids.join(merges.withColumnRenamed("to", "__to"), ["mesh_id", "vid"], "left").withColumn("__t", F.coalesce("__to", "vid"))
    return to.select("mesh_id", "vid", (F.dense_rank().over(Window.partitionBy("mesh_id").orderBy("__t")) - 1).alias("to"))


def close_to_line(vertex: DataFrame, p: tuple, q: tuple, limit: float, axis: int = 1, buffer: float = 0.0, sphere_ends: bool = False) -> DataFrame:
    """Vertices nearer than limit to the line p-q in the plane across `axis` at their own height, between the ends (and the buffer); with sphere_ends those near an end too."""
    names = ["x", "y", "z"]
    if p[axis] == q[axis]:
        raise ValueError("the ends of the line have the same height")
    at = (F.col(names[axis]) - F.lit(float(p[axis]))) / F.lit(float(q[axis] - p[axis]))
    across = [k for k in range(3) if k != axis]
    d2 = sum(((F.col(names[k]) - (F.lit(float(p[k])) + at * F.lit(float(q[k] - p[k])))) ** 2 for k in across), F.lit(0.0))
    low, high = min(p[axis], q[axis]) - buffer, max(p[axis], q[axis]) + buffer
    keep: Column = (F.sqrt(d2) < limit) & (F.col(names[axis]) > low) & (F.col(names[axis]) < high)
    if sphere_ends:
        for e in (p, q):
            keep = keep | (F.sqrt(sum(((F.col(n) - F.lit(float(v))) ** 2 for n, v in zip(names, e, strict=True)), F.lit(0.0))) < limit)
    return vertex.filter(keep)


def components_by_size(labels: DataFrame, min_size: int = 0, max_size: float = float("inf")) -> DataFrame:
    """labels (mesh_id, vid, label) -> vertices of components with min_size < size <= max_size."""
    sizes = labels.groupBy("mesh_id", "label").count().filter((F.col("count") > min_size) & (F.col("count") <= max_size))
    return labels.join(sizes, ["mesh_id", "label"], "left_semi").select("mesh_id", "vid")


def largest_component(labels: DataFrame) -> DataFrame:
    """Vertices of each mesh's largest component (ties: the least label)."""
    top = labels.groupBy("mesh_id", "label").count().groupBy("mesh_id").agg(F.max_by("label", F.struct("count", -F.col("label"))).alias("label"))
    return labels.join(top, ["mesh_id", "label"], "left_semi").select("mesh_id", "vid")


def component_of(labels: DataFrame, of: DataFrame) -> DataFrame:
    """Vertices in the component of any of `of` (mesh_id, vid)."""
    wanted = labels.join(of, ["mesh_id", "vid"], "left_semi").select("mesh_id", "label").distinct()
    return labels.join(wanted, ["mesh_id", "label"], "left_semi").select("mesh_id", "vid")
