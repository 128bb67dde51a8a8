"""Meshes and trees as files: Parquet tables by object, Wavefront text, SWC text, JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators import tree as t
from ..operators.graph import rescale
from ..operators.resampling import resample
from ..operators.tables import cut

TABLES = ("mesh_vertex", "mesh_face", "mesh_link_edge", "mesh_mask", "skel_vertex", "skel_meta", "mesh_to_skel", "annotation")


def write_tables(tables: dict[str, DataFrame], folder: str, overwrite: bool = False, by: str = "mesh_id") -> None:
    """One Parquet folder a table, partitioned by object; existing ones are an error unless overwrite."""
    for name, df in tables.items():
        if name not in TABLES:
            raise ValueError(f"no such table: {name}")
        w = df.write.mode("overwrite" if overwrite else "errorifexists")
        (w.partitionBy(by) if by in df.columns and len(df.columns) > 1 else w).parquet(f"{folder}/{name}")


def read_tables(spark: SparkSession, folder: str, names: tuple = TABLES) -> dict[str, DataFrame]:
    """The tables that are there."""
    jvm = spark.sparkContext._jvm
    path = lambda n: jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}")
    there = lambda n: path(n).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path(n))
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names if there(n)}


def read_mesh(spark: SparkSession, path: str, **options) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces by the file's ending."""
    if PurePosixPath(path).suffix == ".obj":
        return read_obj(spark, path)
    if PurePosixPath(path).suffix in ("", ".parquet"):
        got = read_tables(spark, path, ("mesh_vertex", "mesh_face"))
        return got["mesh_vertex"], got["mesh_face"]
    raise ValueError("unknown file type")


def read_obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Wavefront files, one mesh each, numbered by name: lines `v x y z` and `f a b c` (from 1; a/b/c parts are cut)."""
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), "value")
    lines = files.select("name", F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    parts = lines.select("name", "line", F.split(F.trim("text"), r"\s+").alias("p"))
    from pyspark.sql.window import Window

    order = Window.partitionBy("name").orderBy("line")
    v = parts.filter("p[0] = 'v'").select(F.col("name").alias("mesh_id"), (F.row_number().over(order) - 1).cast("long").alias("vid"), *[F.col("p")[i + 1].cast("double").alias(k) for i, k in enumerate("xyz")])
    f = parts.filter("p[0] = 'f'").select(F.col("name").alias("mesh_id"), (F.row_number().over(order) - 1).cast("long").alias("fid"), *[(F.split(F.col("p")[i + 1], "/")[0].cast("long") - 1).alias(k) for i, k in enumerate("abc")])
    return v, f


def write_obj(vertex: DataFrame, face: DataFrame, folder: str, scaling: tuple = (1, 1, 1), overwrite: bool = False) -> None:
    """One Wavefront file a mesh, in unscaled units; the lines of a mesh meet in one task, as they do in its file."""
    v = rescale(vertex, old=scaling).select("mesh_id", F.lit(0).alias("part"), F.col("vid").alias("pos"), F.concat_ws(" ", F.lit("v"), "x", "y", "z").alias("value"))
    f = face.select("mesh_id", F.lit(1).alias("part"), F.col("fid").alias("pos"), F.concat_ws(" ", F.lit("f"), F.col("a") + 1, F.col("b") + 1, F.col("c") + 1).alias("value"))
    rows = v.unionAll(f).repartition("mesh_id").sortWithinPartitions("mesh_id", "part", "pos").select("mesh_id", "value")
    rows.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("mesh_id").text(folder)


def swc_labels(sids: DataFrame, axon: Column, soma: Column, apical: Column, dendrite: Column, dendrite_default: bool = True) -> DataFrame:
    """label: axon 2, soma 1, apical 4, dendrite 3, in this order of precedence; else 3, or 0."""
    return sids.withColumn("label", F.when(axon, 2).when(soma, 1).when(apical, 4).when(dendrite, 3).otherwise(3 if dendrite_default else 0))


def swc_rows(skel: DataFrame, paths: t.Lifts, labels: DataFrame | None = None, xyz_scaling: float = 1000.0) -> DataFrame:
    """skel (skel_id, sid, parent, w, x, y, z[, radius]) as SWC rows (skel_id, id, label, x, y, z, radius, parent), parents before children.

    Vertices are in the order of cover paths, each from its base to its tip, and numbered from 0; the root's parent is -1.
    """
    cover = cut(t.cover_paths(skel.select("skel_id", "sid", "parent", "w"), paths))
    # only a tree's paths are numbered together; a vertex' number follows from its place on its path
    sizes = cover.groupBy("skel_id", "path").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("skel_id").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    number = cover.join(sizes.withColumn("before", before), ["skel_id", "path"]).select("skel_id", "sid", (F.col("before") + F.col("n") - 1 - F.col("pos")).alias("id"))
    radius = F.coalesce("radius", F.lit(xyz_scaling)) if "radius" in skel.columns else F.lit(xyz_scaling)
    out = skel.join(number, ["skel_id", "sid"]).join(number.select("skel_id", F.col("sid").alias("parent"), F.col("id").alias("__p")), ["skel_id", "parent"], "left")
    if labels is not None:
        out = out.join(labels.select("skel_id", "sid", "label"), ["skel_id", "sid"], "left")
    label = F.coalesce("label", F.lit(0)) if labels is not None else F.lit(0)
    return out.select("skel_id", F.col("id").cast("long").alias("id"), label.alias("label"), *[(F.col(k) / xyz_scaling).alias(k) for k in "xyz"], (radius / xyz_scaling).alias("radius"), F.coalesce("__p", F.lit(-1)).cast("long").alias("parent"))


def resampled_swc_rows(skel: DataFrame, paths: t.Lifts, spacing: float, labels: DataFrame | None = None, xyz_scaling: float = 1000.0, tip_ratio: float = 0.5) -> DataFrame:
    """swc_rows of points every `spacing` along the tree, as resample makes them; labels and radii are those of the old vertex nearest along the path.

    Points are numbered path by path, which puts parents first: they are their own ids.
    """
    points = resample(skel, paths, spacing, tip_ratio)
    old = skel.select("skel_id", F.col("sid").alias("base"), *(["radius"] if "radius" in skel.columns else []))
    out = points.join(old, ["skel_id", "base"])
    if labels is not None:
        out = out.join(labels.select("skel_id", F.col("sid").alias("base"), "label"), ["skel_id", "base"], "left")
    label = F.coalesce("label", F.lit(0)) if labels is not None else F.lit(0)
    radius = F.coalesce("radius", F.lit(xyz_scaling)) if "radius" in skel.columns else F.lit(xyz_scaling)
    return out.select("skel_id", F.col("sid").alias("id"), label.alias("label"), *[(F.col(k) / xyz_scaling).alias(k) for k in "xyz"], (radius / xyz_scaling).alias("radius"), F.coalesce("parent", F.lit(-1)).cast("long").alias("parent"))


def write_swc(rows: DataFrame, folder: str, header: str = "", overwrite: bool = False) -> None:
    """One SWC text a tree."""
    line = F.format_string("%d %d %.3f %.3f %.3f %.3f %d", "id", "label", "x", "y", "z", "radius", "parent")
    body = rows.select("skel_id", "id", line.alias("value"))
    if header:
        top = rows.select("skel_id").distinct().select("skel_id", F.lit(-1).cast("long").alias("id"), F.lit("\n".join(f"# {x}" for x in header.split("\n"))).alias("value"))
        body = top.unionAll(body)
    body.repartition("skel_id").sortWithinPartitions("skel_id", "id").select("skel_id", "value").write.mode("overwrite" if overwrite else "errorifexists").partitionBy("skel_id").text(folder)


def read_swc(spark: SparkSession, path: str) -> DataFrame:
    """SWC texts: (skel_id: the folder or file, id, label, x, y, z, radius, parent)."""
    lines = spark.read.text(path).select("*", F.input_file_name().alias("__file")).filter("value rlike '^\\\\s*[0-9]'")
    p = F.split(F.trim("value"), r"\s+")
    skel = F.col("skel_id") if "skel_id" in lines.columns else F.element_at(F.split("__file", "/"), -1)
    return lines.select(skel.alias("skel_id"), p[0].cast("long").alias("id"), p[1].cast("int").alias("label"), *[p[i + 2].cast("double").alias(k) for i, k in enumerate("xyz")], p[5].cast("double").alias("radius"), p[6].cast("long").alias("parent"))


def skeleton_from_dict(spark: SparkSession, skel_id: int, sk: dict) -> DataFrame:
    """{"vertices", "edges" (child, parent), "root", "radius"} as a skeleton table with edge lengths."""
    v = sk["vertices"]
    if not 0 <= sk["root"] < len(v):
        raise ValueError("root is not a vertex")
    parent = {int(a): int(b) for a, b in sk["edges"]}
    rows = [(skel_id, i, parent.get(i), *map(float, xyz), float(r) if r is not None else None) for i, (xyz, r) in enumerate(zip(v, sk.get("radius") or [None] * len(v), strict=True))]
    df = spark.createDataFrame(rows, "skel_id long, sid long, parent long, x double, y double, z double, radius double")
    up = df.select("skel_id", F.col("sid").alias("parent"), *[F.col(k).alias(f"__{k}") for k in "xyz"])
    w = F.sqrt(sum(((F.col(k) - F.col(f"__{k}")) ** 2 for k in "xyz"), F.lit(0.0)))
    return df.join(up, ["skel_id", "parent"], "left").select("skel_id", "sid", "parent", F.coalesce(w, F.lit(0.0)).alias("w"), "x", "y", "z", "radius")


def merge_log(spark: SparkSession, path: str) -> DataFrame:
    """A JSON log {"merge_edge_coords": [[[x, y, z], [x, y, z]], ...]} as (merge, ax, ay, az, bx, by, bz)."""
    schema = T.StructType([T.StructField("merge_edge_coords", T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))))])
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("merge_edge_coords").alias("merge", "p"))
    return rows.select("merge", *[F.col("p")[e][i].alias(f"{n}{k}") for e, n in enumerate("ab") for i, k in enumerate("xyz")])


def read_binary(spark: SparkSession, path: str, parse, schema: str) -> DataFrame:
    """Files of another format, each handed whole to parse(name, bytes) -> DataFrame of pandas."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                yield parse(name, content)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def metadata_row(spark: SparkSession, skel_id: int, meta: dict, known: tuple = ("soma_pt_x", "soma_pt_y", "soma_pt_z", "soma_radius", "collapse_soma", "invalidation_d", "smooth_vertices", "timestamp")) -> DataFrame:
    """(skel_id, meta map, more JSON): known settings by name, unknown ones ignored but collapse parameters kept as JSON."""
    return spark.createDataFrame([(skel_id, {k: str(v) for k, v in meta.items() if k in known}, json.dumps(meta.get("collapse_params", {})))], "skel_id long, meta map<string,string>, collapse_params string")
