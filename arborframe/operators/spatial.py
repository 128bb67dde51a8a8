"""Spatial joins: nearest, k nearest and radius, within each mesh.

Points are dealt into cells of a grid; a radius join is an equi-join of one
side's cells with the other's 27 neighbours; nearest joins spread the side that
has fewer rows. They try a radius that fits how crowded the vertices are and
double it for the points that have too few neighbours, so that each round only
joins what is left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .blocks import spatial_blocks
from .tables import cut

XYZ = ("x", "y", "z")
PXYZ = ("px", "py", "pz")
MESHES = 100_000  # so many rows of two numbers, counted, are broadcast
HALVINGS = 8
TILE, TILE_CELLS = 2048, 1 << 20  # vertices of a tile, and distances of two tiles held at once


def squared(a: str = "", b: str = "p") -> Column:
    return sum(((F.col(f"{a}{k}") - F.col(f"{b}{k}")) * (F.col(f"{a}{k}") - F.col(f"{b}{k}")) for k in XYZ), F.lit(0))


def _cells(df: DataFrame, size: float, names: tuple, around: bool) -> DataFrame:
    cell = [F.floor(F.col(n) / F.lit(float(size))) for n in names]
    if not around:
        return df.withColumns(dict(zip(("cx", "cy", "cz"), cell, strict=True)))
    for c, v in zip(("cx", "cy", "cz"), cell, strict=True):
        df = df.withColumn(c, F.explode(F.array(v - 1, v, v + 1)))
    return df


def _pairs(points: DataFrame, vertex: DataFrame, radius: float, spread_vertex: bool) -> DataFrame:
    """All pairs of the same or touching cells, with d2. One side goes to 27 cells, which no estimate of its size knows: it is never broadcast."""
    a = _cells(points, radius, PXYZ, not spread_vertex)
    b = _cells(vertex.select("mesh_id", "vid", *XYZ), radius, XYZ, spread_vertex)
    return a.join(b.hint("merge"), ["mesh_id", "cx", "cy", "cz"]).withColumn("d2", squared())


def radius_join(points: DataFrame, vertex: DataFrame, radius: float, inclusive: bool = True, spread_vertex: bool = False) -> DataFrame:
    """points (mesh_id, pid, px, py, pz) x vertex (mesh_id, vid, x, y, z) nearer than radius: (mesh_id, pid, vid, d2). spread_vertex: for fewer vertices than points."""
    r2 = F.lit(float(radius) ** 2)
    pairs = _pairs(points, vertex, radius, spread_vertex)
    return pairs.filter(F.col("d2") <= r2 if inclusive else F.col("d2") < r2).select("mesh_id", "pid", "vid", "d2")


def _uncrowded(vertex: DataFrame, size: float, few: int) -> float:
    """size halved until a vertex shares its cell with few others in the mean, so that crowded parts of a wide mesh don't meet as a whole."""
    mean: dict[float, float] = {}
    for _ in range(3):
        level = F.explode(F.array(*[F.struct(F.lit(s).alias("size"), *[F.floor(F.col(c) / F.lit(s)).alias(f"c{c}") for c in XYZ]) for s in (size / 2**i for i in range(HALVINGS))]))
        held = vertex.select("mesh_id", level.alias("at")).groupBy("mesh_id", "at").agg(F.count("*").alias("n"))
        mean |= {r[0]: r[1] for r in held.groupBy("at.size").agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).collect()}
        if min(mean.values(), default=0) <= few:
            break
        size /= 2**HALVINGS
    enough = max(few, 1.1 * min(mean.values(), default=0))  # vertices of one place are never apart
    return max((s for s, m in mean.items() if m <= enough), default=size)


def k_nearest(points: DataFrame, vertex: DataFrame, k: int = 1, start: float | None = None, not_self: bool = False, max_distance: float | None = None) -> DataFrame:
    """(mesh_id, pid, rank, vid, d2): the k nearest vertices (ties: the smaller id). not_self: a point isn't its own neighbour; else points of one place are looked up once."""
    span = vertex.groupBy("mesh_id").agg(F.count("*").alias("n"), *[(F.max(c) - F.min(c)).alias(f"s{c}") for c in XYZ])
    row = span.agg(F.avg((F.greatest("sx", "sy", "sz") + 1) * F.pow(F.lit(float(k + 1)) / F.col("n"), F.lit(1 / 3))), F.count("*"), F.sum("n")).first()
    if start is None:
        start = _uncrowded(vertex, float(row[0] or 1.0), 2 * (k + 1))
    far = points.agg(F.max(F.greatest(*[F.abs(c) for c in PXYZ]))).first()[0] or 0
    top = 4 * (float(far) + float(vertex.agg(F.max(F.greatest(*[F.abs(c) for c in XYZ]))).first()[0] or 0) + start)
    have = span.select("mesh_id", F.least(F.lit(k), F.col("n") - int(not_self)).alias("want"))
    key = ["mesh_id", "pid"] if not_self else ["mesh_id", *PXYZ]
    asked = points.select("mesh_id", "pid", *PXYZ) if not_self else points.select(*key).distinct()
    todo = cut(asked.join(F.broadcast(have) if row[1] <= MESHES else have.hint("merge"), "mesh_id").filter("want > 0"))
    each = Window.partitionBy(*key)
    done, radius = None, start
    while True:
        reach = radius if max_distance is None else min(radius, max_distance)
        near = _pairs(todo, vertex, reach, todo.count() > (row[2] or 0)).filter(F.col("d2") <= F.lit(float(reach) ** 2))
        if not_self:
            near = near.filter("pid <> vid")
        near = near.select(*key, "want", "vid", "d2").withColumn("rank", F.row_number().over(each.orderBy("d2", "vid"))).filter(F.col("rank") <= k)
        near = cut(near.withColumn("got", F.count("*").over(each)))
        last = radius >= top or (max_distance is not None and radius >= max_distance)
        full = near if last else near.filter("got >= want")
        full = full.select(*key, "rank", "vid", "d2")
        done = full if done is None else done.unionAll(full)
        if not last:
            todo = cut(todo.join(full.filter("rank = 1").select(*key).hint("merge"), key, "left_anti"))
        if last or todo.isEmpty():
            return done if not_self else points.select("mesh_id", "pid", *PXYZ).join(done.hint("merge"), key).select("mesh_id", "pid", "rank", "vid", "d2")
        radius *= 2


def as_points(df: DataFrame, key: str = "vid") -> DataFrame:
    return df.select("mesh_id", F.col(key).alias("pid"), *[F.col(c).alias(f"p{c}") for c in XYZ])


def near_points(vertex: DataFrame, points: DataFrame, d_max: float) -> DataFrame:
    """Vertices nearer than d_max (strictly) to any point (mesh_id, pid, px, py, pz)."""
    places = cut(points.select("mesh_id", *PXYZ).distinct())
    spread_vertex = places.count() > vertex.count()
    a = _cells(vertex.select("mesh_id", "vid", *XYZ), d_max, XYZ, spread_vertex).alias("a")
    b = _cells(places, d_max, PXYZ, not spread_vertex).hint("merge").alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("mesh_id", "cx", "cy", "cz")]
    return a.join(b, [*same, squared() < F.lit(float(d_max) ** 2)], "left_semi").select("mesh_id", "vid").distinct()


def mutual_nearest(a: DataFrame, b: DataFrame, max_distance: float | None = None) -> DataFrame:
    """(mesh_id, a, b, d2): pairs that are each other's nearest in two sets of vertices."""
    there = k_nearest(as_points(a), b, 1, max_distance=max_distance).select("mesh_id", F.col("pid").alias("a"), F.col("vid").alias("b"), "d2")
    back = k_nearest(as_points(b), a, 1, max_distance=max_distance).select("mesh_id", F.col("pid").alias("b"), F.col("vid").alias("a"))
    return there.join(back, ["mesh_id", "a", "b"], "left_semi")


def _closest(step: float, max_distance: float):
    """Of two tiles (side 0 and 1; of one alone: with itself), for each pair of their components the vertex pairs of the first ring that has any; sure: both are whole in their tiles."""

    def run(rows: pa.Table) -> pa.Table:
        side, label = (rows.column(c).to_numpy() for c in ("side", "label"))
        place = [rows.column(k).to_numpy() for k in XYZ]
        full = rows.column("n").to_numpy()
        at = [np.flatnonzero(side == k) for k in (0, 1)]
        at = [i[np.argsort(label[i], kind="stable")] for i in at]
        alone = rows.column("pa")[0] == rows.column("pb")[0]
        one, two = at[0], at[0] if alone else at[1]
        parts = []
        for i in (one, two):
            name, first = np.unique(label[i], return_index=True)
            many = np.diff(np.append(first, len(i)))
            parts.append((name, first, many, full[i[first]] == many))
        (na, fa, ma, wa), (nb, fb, mb, wb) = parts
        found: list[tuple] = []
        begin = 0
        while begin < len(na):
            end = begin + max(1, int(np.searchsorted(np.cumsum(ma[begin:]) * len(two), TILE_CELLS, "right")))
            i = one[fa[begin] : fa[end - 1] + ma[end - 1]]
            d2 = sum((v[i][:, None] - v[two][None, :]) * (v[i][:, None] - v[two][None, :]) for v in place)
            ring = np.maximum(1.0, np.ceil(np.sqrt(d2) / step))
            ring[~(d2 <= float(max_distance) ** 2)] = np.inf
            least = np.minimum.reduceat(np.minimum.reduceat(ring, fb, axis=1), fa[begin:end] - fa[begin], axis=0)
            least[na[begin:end, None] >= nb if alone else na[begin:end, None] == nb] = np.inf
            r, c = np.nonzero((ring == np.repeat(np.repeat(least, ma[begin:end], 0), mb, 1)) & np.isfinite(ring))
            sure = wa[np.searchsorted(na, label[i[r]])] & wb[np.searchsorted(nb, label[two[c]])]
            found.append((i[r], two[c], d2[r, c], ring[r, c].astype(np.int64), sure))
            begin = end
        i, j, d2, ring, sure = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in range(5))
        turn = label[i] > label[j]
        i, j = pa.array(np.where(turn, j, i)), pa.array(np.where(turn, i, j))
        of = lambda c, k: rows.column(c).combine_chunks().take(k)
        return pa.table({"mesh_id": of("mesh_id", i), "a": of("vid", i), "b": of("vid", j), "la": of("label", i), "lb": of("label", j), "d2": pa.array(d2), "ring": pa.array(ring), "sure": pa.array(sure, pa.bool_())})

    return run


def close_components(labelled: DataFrame, size_threshold: int, max_distance: float, step: float) -> DataFrame:
    """labelled (mesh_id, vid, x, y, z, label): links between components of more than size_threshold vertices.

    For each pair of components all vertex pairs within the first multiple of step that has any. Tiles of bounded
    size, which hold whole components where these fit, meet in pairs; only components in several tiles are compared once more.
    """
    whole = all(labelled.schema[k].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") for k in XYZ)
    number = "bigint" if whole else "double"
    there = F.lit(True)
    for k in XYZ:
        there = there & F.col(k).isNotNull() & ~F.isnan(F.col(k).cast("double"))
    size = labelled.groupBy("mesh_id", "label").agg(F.count("*").alias("n")).filter(F.col("n") > size_threshold)
    big = cut(labelled.filter(there).select("mesh_id", "vid", "label", *[F.col(k).cast(number).alias(k) for k in XYZ]).join(size, ["mesh_id", "label"]))
    # a component that fits a tile is dealt as a whole, by its least vertex' place
    seat = big.filter(F.col("n") <= TILE).groupBy("mesh_id", "label").agg(F.min(F.struct("vid", *XYZ)).alias("m"))
    seated = big.select("mesh_id", "vid", "label", *XYZ).join(seat, ["mesh_id", "label"], "left")
    tile = spatial_blocks(seated.select("mesh_id", "vid", *[F.coalesce(f"m.{k}", k).alias(k) for k in XYZ]), TILE)
    big = cut(big.join(tile, ["mesh_id", "vid"]))
    boxes = big.groupBy("mesh_id", "block").agg(*[F.min(k).alias(f"l{k}") for k in XYZ], *[F.max(k).alias(f"h{k}") for k in XYZ])
    held = cut(_cells(big, max_distance, XYZ, False).select("mesh_id", "block", "cx", "cy", "cz").distinct().join(boxes, ["mesh_id", "block"]))
    side = lambda v: held.select("mesh_id", F.col("block").alias(f"p{v}"), "cx", "cy", "cz", *[F.col(f"{e}{k}").alias(f"{v}{e}{k}") for e in "lh" for k in XYZ])
    around = side("b")
    for c in ("cx", "cy", "cz"):
        around = around.withColumn(c, F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)))
    gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"bl{k}") - F.col(f"ah{k}"), F.col(f"al{k}") - F.col(f"bh{k}")), F.lit(2.0)) for k in XYZ), F.lit(0.0))
    near = side("a").join(around.hint("merge"), ["mesh_id", "cx", "cy", "cz"]).filter((F.col("pa") <= F.col("pb")) & (gap <= float(max_distance) ** 2 * (1 + 1e-9)))
    near = cut(near.select("mesh_id", "pa", "pb").distinct())
    asked = near.select("mesh_id", "pa", "pb", F.col("pa").alias("block"), F.lit(0).alias("side")).unionAll(near.filter("pa <> pb").select("mesh_id", "pa", "pb", F.col("pb").alias("block"), F.lit(1).alias("side")))
    met = big.join(asked.hint("merge"), ["mesh_id", "block"]).select("mesh_id", "pa", "pb", "side", "vid", "label", *XYZ, "n")
    kind = {c: labelled.schema[c].dataType.simpleString() for c in ("mesh_id", "vid", "label")}
    out = f"mesh_id {kind['mesh_id']}, a {kind['vid']}, b {kind['vid']}, la {kind['label']}, lb {kind['label']}, d2 {number}, ring bigint, sure boolean"
    pairs = met.groupBy("mesh_id", "pa", "pb").applyInArrow(_closest(step, max_distance), out)
    names = ["mesh_id", "a", "b", "la", "lb", "d2"]
    if big.groupBy("mesh_id", "label", "n").agg(F.countDistinct("block").alias("tiles"), F.count("*").alias("m")).filter("tiles > 1 or m < n").isEmpty():
        return pairs.select(names)
    pairs = cut(pairs)
    parted = pairs.filter("not sure")
    first = parted.groupBy("mesh_id", "la", "lb").agg(F.min("ring").alias("ring"))
    return pairs.filter("sure").select(names).unionAll(parted.join(first.hint("merge"), ["mesh_id", "la", "lb", "ring"]).select(names))


def local_views(vertex: DataFrame, centres: DataFrame, n_points: int, max_distance: float | None = None) -> DataFrame:
    """(mesh_id, pid, pos, vid): the n nearest vertices of each centre, in the order of their ids."""
    near = k_nearest(centres, vertex, n_points, max_distance=max_distance)
    return near.select("mesh_id", "pid", (F.row_number().over(Window.partitionBy("mesh_id", "pid").orderBy("vid")) - 1).alias("pos"), "vid", "d2")


def local_faces(views: DataFrame, face: DataFrame) -> DataFrame:
    """(mesh_id, pid, fid): faces with all corners in a view."""
    corners = face.select("mesh_id", "fid", F.explode(F.array("a", "b", "c")).alias("vid"))
    return corners.join(views.select("mesh_id", "pid", "vid"), ["mesh_id", "vid"]).groupBy("mesh_id", "pid", "fid").count().filter("count = 3").select("mesh_id", "pid", "fid")


def aligned_views(views: DataFrame, vertex: DataFrame) -> DataFrame:
    """Views in the axes of their principal components (signs: the largest entry of each axis is positive)."""
    import pandas as pd

    def align(group: pd.DataFrame) -> pd.DataFrame:
        x = group[list(XYZ)].to_numpy(float)
        x = x - x.mean(0)
        _, _, axes = np.linalg.svd(x, full_matrices=False)
        axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
        y = np.zeros((len(x), 3))
        y[:, : len(axes)] = x @ axes.T
        return group.assign(x=y[:, 0], y=y[:, 1], z=y[:, 2])

    rows = views.select("mesh_id", "pid", "pos", "vid").join(vertex.select("mesh_id", "vid", *[F.col(c).cast("double").alias(c) for c in XYZ]), ["mesh_id", "vid"])
    return rows.groupBy("mesh_id", "pid").applyInPandas(align, rows.schema)


def snap_to_grid(vertex: DataFrame, eps: float) -> DataFrame:
    """(mesh_id, vid, to): vertices of one cell become its least one."""
    cell = [F.floor(F.col(c) / eps) for c in XYZ]
    return vertex.select("mesh_id", "vid", F.min("vid").over(Window.partitionBy("mesh_id", *cell)).alias("to"))
