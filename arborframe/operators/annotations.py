"""Annotations anchored to meshes, and translation between mesh vertices and tree vertices.

annotation (mesh_id, anno, row_id, px, py, pz, ...); mesh_to_skel (mesh_id, vid, sid), sid may be NULL.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spatial
from . import tree as t
from .tables import cut, or_minus_one

AGGREGATES = ("mean", "median", "max", "min")


def free_column(columns: list[str], name: str) -> str:
    """name, or name_0, name_1, ... if it is taken."""
    if name not in columns:
        return name
    return next(f"{name}_{i}" for i in range(len(columns) + 1) if f"{name}_{i}" not in columns)


def scale_points(anno: DataFrame, resolution: tuple = (4, 4, 40)) -> DataFrame:
    """Voxel positions times the resolution."""
    return anno.withColumns({f"p{k}": F.col(f"p{k}") * r for k, r in zip("xyz", resolution, strict=True)})


def anchor(anno: DataFrame, vertex: DataFrame, max_distance: float | None = None) -> DataFrame:
    """Each annotation with its nearest vertex vid, d2, and valid: nearer than max_distance (strictly)."""
    points = anno.select("mesh_id", F.struct("anno", "row_id").alias("pid"), "px", "py", "pz")
    near = spatial.k_nearest(points, vertex, 1, max_distance=max_distance).select("mesh_id", F.col("pid.anno").alias("anno"), F.col("pid.row_id").alias("row_id"), "vid", "d2")
    out = anno.join(near, ["mesh_id", "anno", "row_id"], "left")
    ok = F.col("vid").isNotNull() if max_distance is None else F.col("d2") < float(max_distance) ** 2
    return out.withColumn("valid", F.coalesce(ok, F.lit(False)))


def anchor_by_index(anno: DataFrame, vertex: DataFrame, index: str) -> DataFrame:
    """Annotations whose vertex is given by a column."""
    known = vertex.select("mesh_id", F.col("vid").alias("__v"))
    out = anno.join(known, (anno["mesh_id"] == known["mesh_id"]) & (anno[index] == known["__v"]), "left").drop(known["mesh_id"])
    return out.withColumns({"vid": F.col("__v"), "valid": F.col("__v").isNotNull()}).drop("__v")


def location_indices(points: DataFrame, vertex: DataFrame, max_distance: float, mesh_to_skel: DataFrame | None = None) -> DataFrame:
    """(mesh_id, pid, vid[, sid]): nearest vertex, -1 if farther than max_distance."""
    near = spatial.k_nearest(points, vertex, 1).select("mesh_id", "pid", F.when(F.col("d2") <= float(max_distance) ** 2, F.col("vid")).alias("vid"))
    out = points.select("mesh_id", "pid").join(near, ["mesh_id", "pid"], "left")
    if mesh_to_skel is not None:
        out = out.join(mesh_to_skel, ["mesh_id", "vid"], "left").select("mesh_id", "pid", or_minus_one("vid").alias("vid"), or_minus_one("sid").alias("sid"))
        return out
    return out.select("mesh_id", "pid", or_minus_one("vid").alias("vid"))


def visible(anchored: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """Rows that are valid and whose vertex the mask keeps."""
    out = anchored.filter("valid")
    return out if mask is None else out.join(mask.select("mesh_id", "vid").distinct(), ["mesh_id", "vid"], "left_semi")


def query(anchored: DataFrame, mask: DataFrame) -> DataFrame:
    """Rows on kept vertices; rows that were never anchored all pass."""
    kept = mask.select("mesh_id", "vid", F.lit(True).alias("__in")).distinct()
    return anchored.join(kept, ["mesh_id", "vid"], "left").filter("__in or (vid is null and valid is null)").drop("__in")


def to_skeleton(mesh_ids: DataFrame, mesh_to_skel: DataFrame, padded: bool = False) -> DataFrame:
    """Distinct tree vertices of mesh vertices; padded: one for each, -1 where there is none."""
    if padded:
        return mesh_ids.join(mesh_to_skel, ["mesh_id", "vid"], "left").select("mesh_id", "vid", or_minus_one("sid").alias("sid"))
    return mesh_ids.join(mesh_to_skel, ["mesh_id", "vid"]).filter("sid is not null").select("mesh_id", "sid").distinct()


def to_mesh(skel_ids: DataFrame, mesh_to_skel: DataFrame) -> DataFrame:
    """All mesh vertices of each tree vertex."""
    return skel_ids.join(mesh_to_skel, ["mesh_id", "sid"]).select("mesh_id", "sid", "vid")


def mesh_regions(skel_ids: DataFrame, mesh_to_skel: DataFrame) -> DataFrame:
    return to_mesh(skel_ids, mesh_to_skel).groupBy("mesh_id", "sid").agg(F.sort_array(F.collect_list("vid")).alias("vids"))


def region_points(skel_ids: DataFrame, mesh_to_skel: DataFrame) -> DataFrame:
    """The least mesh vertex of each tree vertex; -1 if it has none."""
    first = mesh_to_skel.groupBy("mesh_id", "sid").agg(F.min("vid").alias("vid"))
    return skel_ids.join(first, ["mesh_id", "sid"], "left").select("mesh_id", "sid", or_minus_one("vid").alias("vid"))


def all_equivalent(mesh_ids: DataFrame, mesh_to_skel: DataFrame) -> DataFrame:
    """All mesh vertices that share a tree vertex with any of the given."""
    return to_mesh(to_skeleton(mesh_ids, mesh_to_skel), mesh_to_skel).select("mesh_id", "vid").distinct()


def skeleton_property_to_mesh(prop: DataFrame, mesh_to_skel: DataFrame, default: float = -1.0) -> DataFrame:
    """(mesh_id, sid, value) on all mesh vertices."""
    return mesh_to_skel.join(prop, ["mesh_id", "sid"], "left").select("mesh_id", "vid", F.coalesce("value", F.lit(default)).alias("value"))


def mesh_property_to_skeleton(prop: DataFrame, mesh_to_skel: DataFrame, how: str | Callable = "mean") -> DataFrame:
    """(mesh_id, vid, value) gathered on tree vertices by mean, median, max, min or a function of an array."""
    rows = prop.join(mesh_to_skel.filter("sid is not null"), ["mesh_id", "vid"]).groupBy("mesh_id", "sid")
    if callable(how):
        f = F.pandas_udf(lambda v: float(how(v.to_numpy())), "double", F.PandasUDFType.GROUPED_AGG)
        return rows.agg(f("value").alias("value"))
    if how not in AGGREGATES:
        raise ValueError(f"no such aggregate: {how}")
    return rows.agg({"mean": F.avg, "median": F.median, "max": F.max, "min": F.min}[how]("value").alias("value"))


def annotation_segments(anchored: DataFrame, mesh_to_skel: DataFrame, segments: DataFrame) -> DataFrame:
    """(mesh_id, anno, row_id, seg) of anchored rows; segments (mesh_id, sid, seg)."""
    return anchored.filter("valid").join(mesh_to_skel, ["mesh_id", "vid"]).join(segments.select("mesh_id", "sid", "seg"), ["mesh_id", "sid"]).select("mesh_id", "anno", "row_id", "seg")


def skeleton_to_annotations(anchored: DataFrame, mesh_to_skel: DataFrame) -> DataFrame:
    """(mesh_id, sid, row_ids): annotations of each tree vertex."""
    return anchored.filter("valid").join(mesh_to_skel.filter("sid is not null"), ["mesh_id", "vid"]).groupBy("mesh_id", "sid").agg(F.sort_array(F.collect_list("row_id")).alias("row_ids"))


class Annotations:
    """Named annotation tables of a set of meshes; each change gives a new value, so that a mask is undone by keeping the old one."""

    def __init__(self, vertex: DataFrame, tables: dict[str, DataFrame] | None = None, mask: DataFrame | None = None):
        self.vertex, self.tables, self.mask = vertex, dict(tables or {}), mask

    def add(self, name: str, rows: DataFrame, max_distance: float | None = None, index: str | None = None, anchored: bool = True, overwrite: bool = False, resolution: tuple = (1, 1, 1)) -> Annotations:
        if name in self.tables and not overwrite:
            raise ValueError(f"there is an annotation {name}")
        if index is not None:
            rows = anchor_by_index(rows, self.vertex, index)
        elif anchored:
            rows = anchor(scale_points(rows, resolution), self.vertex, max_distance)
        return Annotations(self.vertex, self.tables | {name: rows}, self.mask)

    def remove(self, name: str) -> Annotations:
        return Annotations(self.vertex, {k: v for k, v in self.tables.items() if k != name}, self.mask)

    def masked(self, mask: DataFrame | None) -> Annotations:
        return Annotations(self.vertex, self.tables, mask)

    def moved(self, vertex: DataFrame, max_distance: float | None = None) -> Annotations:
        """Anchored anew to another mesh."""
        again = {k: anchor(v.drop("vid", "d2", "valid"), vertex, max_distance) if "px" in v.columns else v for k, v in self.tables.items()}
        return Annotations(vertex, again, None)

    def __getitem__(self, name: str) -> DataFrame:
        return visible(self.tables[name], self.mask) if "valid" in self.tables[name].columns else self.tables[name]

    def __len__(self) -> int:
        return len(self.tables)

    def names(self) -> list[str]:
        return list(self.tables)


class Meshwork:
    """A mesh, its tree and annotations, joined by mesh_to_skel (mesh_id = skel_id)."""

    def __init__(self, vertex: DataFrame, tree: DataFrame, mesh_to_skel: DataFrame, anno: Annotations | None = None, mask: DataFrame | None = None, face: DataFrame | None = None):
        self.vertex, self.tree, self.map, self.mask, self.face = vertex, tree, mesh_to_skel, mask, face
        self.anno = anno or Annotations(vertex)

    def masked(self, mask: DataFrame | None) -> Meshwork:
        """Restrict mesh, tree and annotations to the mask; None undoes it."""
        return Meshwork(self.vertex, self.tree, self.map, self.anno.masked(mask), mask, self.face)

    def mesh_vertices(self) -> DataFrame:
        return self.vertex if self.mask is None else self.vertex.join(self.mask, ["mesh_id", "vid"], "left_semi")

    def skeleton(self) -> DataFrame:
        """The tree's vertices that the mask leaves; parents outside it are NULL."""
        if self.mask is None:
            return self.tree
        kept = to_skeleton(self.mask, self.map).withColumnRenamed("mesh_id", "skel_id")
        inside = self.tree.join(kept, ["skel_id", "sid"], "left_semi")
        up = kept.select("skel_id", F.col("sid").alias("parent"), F.lit(True).alias("__in"))
        return inside.join(up, ["skel_id", "parent"], "left").select("skel_id", "sid", F.when(F.col("__in"), F.col("parent")).alias("parent"), "w")

    def mapping(self) -> DataFrame:
        """mesh_to_skel of the mesh vertices that the mask leaves."""
        return self.map if self.mask is None else self.map.join(self.mask.select("mesh_id", "vid"), ["mesh_id", "vid"], "left_semi")

    @cached_property
    def lifts(self) -> t.Lifts:
        """Of the tree that the mask leaves."""
        return t.Lifts(cut(self.skeleton()))

    def _on_mesh(self, skel: DataFrame) -> DataFrame:
        return to_mesh(skel.withColumnRenamed("skel_id", "mesh_id"), self.map).select("mesh_id", "vid")

    def downstream_of(self, mesh_ids: DataFrame) -> DataFrame:
        """Mesh vertices at and below the tree vertices of the given ones."""
        start = to_skeleton(mesh_ids, self.map).withColumnRenamed("mesh_id", "skel_id")
        return self._on_mesh(t.downstream(t.Lifts(self.tree), start).select("skel_id", "sid").distinct())

    def distance_to_root(self) -> DataFrame:
        """(mesh_id, vid, dist) of all mesh vertices; NaN without a tree vertex."""
        d = t.to_root(t.Lifts(self.tree)).select(F.col("skel_id").alias("mesh_id"), "sid", F.col("dist").cast("double").alias("dist"))
        return self.map.join(d, ["mesh_id", "sid"], "left").select("mesh_id", "vid", F.coalesce("dist", F.lit(float("nan"))).alias("dist"))

    def branch_points(self) -> DataFrame:
        return region_points(t.branch_points(self.tree).withColumnRenamed("skel_id", "mesh_id"), self.map)

    def end_points(self) -> DataFrame:
        return region_points(t.end_points(self.tree).withColumnRenamed("skel_id", "mesh_id"), self.map)

    def root(self) -> DataFrame:
        return region_points(self.tree.filter("parent is null").select(F.col("skel_id").alias("mesh_id"), "sid"), self.map)
