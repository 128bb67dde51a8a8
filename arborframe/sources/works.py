"""A whole work (mesh, tree, annotations, mask) saved as Parquet tables and loaded again, and as SWC rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.annotations import Annotations, Meshwork, mesh_property_to_skeleton, to_skeleton
from . import files

PARTS = {"mesh_vertex": "vertex", "mesh_face": "face", "mesh_mask": "mask", "skel_vertex": "tree", "mesh_to_skel": "map"}


def save_work(work: Meshwork, folder: str, overwrite: bool = False) -> None:
    """A table each of mesh, tree, map and mask, and of every annotation, whole, whatever the mask hides.

    Rows are sorted by object within ranges of it, so that a reader of a few objects skips the rest. What is
    there already is an error unless overwrite, which must not be the folder that the work is read from.
    """
    spark = work.vertex.sparkSession
    tables = {name: getattr(work, part) for name, part in PARTS.items() if getattr(work, part) is not None}
    names = work.anno.names()
    tables |= {f"annotation_{i}": work.anno.tables[n] for i, n in enumerate(names)}
    tables["annotation_names"] = spark.createDataFrame(list(enumerate(names)), "i int, name string").coalesce(1)
    if overwrite and work.mask is None:
        tables["mesh_mask"] = work.vertex.select("mesh_id", "vid").limit(0)  # takes the place of an older one
    for name, df in tables.items():
        by = next((k for k in ("mesh_id", "skel_id") if k in df.columns), None)
        rows = df if by is None else df.repartitionByRange(by, next(k for k in ("vid", "sid", "fid", "row_id", by) if k in df.columns)).sortWithinPartitions(by)
        rows.write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{folder}/{name}")


def load_work(spark: SparkSession, folder: str) -> Meshwork:
    """A saved work with its mask; annotations are as they were anchored."""
    got = files.read_tables(spark, folder, tuple(PARTS) + ("annotation_names",))
    names = [r["name"] for r in got["annotation_names"].orderBy("i").collect()]  # as many as annotations were named
    tables = {n: spark.read.parquet(f"{folder}/annotation_{i}") for i, n in enumerate(names)}
    mask = got.get("mesh_mask")
    if mask is not None and mask.isEmpty():
        mask = None
    work = Meshwork(got["mesh_vertex"], got["skel_vertex"], got["mesh_to_skel"], Annotations(got["mesh_vertex"], tables), face=got.get("mesh_face"))
    return work if mask is None else work.masked(mask)


def work_swc_rows(work: Meshwork, labels: dict[str, str | DataFrame], radius: DataFrame | None = None, radius_agg: str = "median", xyz_scaling: float = 1000.0, dendrite_default: bool = True, resample_spacing: float | None = None) -> DataFrame:
    """The work's tree as SWC rows; with resample_spacing as rows of points at that distance.

    labels names axon, soma, apical or dendrite by an annotation or by mesh vertices (mesh_id, vid); a tree vertex has
    a label if any of its mesh vertices has it. radius (mesh_id, vid, value) is gathered on tree vertices by radius_agg.
    """
    if not set(labels) <= {"axon", "soma", "apical", "dendrite"}:
        raise ValueError("labels are axon, soma, apical and dendrite")
    tree, mapping = work.lifts.tree, work.mapping()
    skel = work.skeleton()
    marked = tree.select("skel_id", "sid")
    for kind, of in labels.items():
        ids = work.anno[of] if isinstance(of, str) else of
        on = to_skeleton(ids.select("mesh_id", "vid"), mapping).select(F.col("mesh_id").alias("skel_id"), "sid", F.lit(True).alias(kind))
        marked = marked.join(on, ["skel_id", "sid"], "left")
    has = lambda k: F.coalesce(F.col(k), F.lit(False)) if k in labels else F.lit(False)
    kinds = files.swc_labels(marked, has("axon"), has("soma"), has("apical"), has("dendrite"), dendrite_default).select("skel_id", "sid", "label")
    if not {"x", "y", "z"} <= set(skel.columns):
        place = work.tree.select("skel_id", "sid", "x", "y", "z")
        skel = skel.join(place, ["skel_id", "sid"])
    if radius is not None:
        on = mesh_property_to_skeleton(radius, mapping, radius_agg).select(F.col("mesh_id").alias("skel_id"), "sid", F.col("value").alias("radius"))
        skel = skel.join(on, ["skel_id", "sid"], "left")
    if resample_spacing is not None:
        return files.resampled_swc_rows(skel, work.lifts, resample_spacing, kinds, xyz_scaling)
    return files.swc_rows(skel, work.lifts, kinds, xyz_scaling)
