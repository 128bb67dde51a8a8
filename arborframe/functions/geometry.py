"""Sampling directions, rotations, angle-weighted distances, windows on a line, and scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.tables import cut

GOLDEN = math.pi * (3 - math.sqrt(5))


def vogel_disk(spark: SparkSession, n: int) -> DataFrame:
    """n points (i, x, y) spread evenly on the unit disk by the golden angle."""
    i = F.col("id")
    r, a = F.sqrt((i + 0.5) / n), i * GOLDEN
    return spark.range(n).select(i.alias("i"), (r * F.cos(a)).alias("x"), (r * F.sin(a)).alias("y"))


def cone_directions(spark: SparkSession, n: int, half_angle: float) -> DataFrame:
    """n unit vectors (i, x, y, z, angle) in a cone about the z axis."""
    t = math.tan(half_angle)
    d = vogel_disk(spark, n).withColumns({"x": F.col("x") * t, "y": F.col("y") * t})
    norm = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + 1)
    return d.select("i", (F.col("x") / norm).alias("x"), (F.col("y") / norm).alias("y"), (1 / norm).alias("z"), F.acos(1 / norm).alias("angle"))


def rotate(x: Column, y: Column, z: Column, axis: str, angle: Column | float) -> tuple[Column, Column, Column]:
    """A vector turned about an axis (right hand)."""
    a = F.lit(angle) if isinstance(angle, (int, float)) else angle
    c, s = F.cos(a), F.sin(a)
    if axis == "x":
        return x, c * y - s * z, s * y + c * z
    if axis == "y":
        return c * x + s * z, y, c * z - s * x
    return c * x - s * y, s * x + c * y, z


def oriented_cones(normals: DataFrame, cone: DataFrame) -> DataFrame:
    """normals (mesh_id, vid, nx, ny, nz; unit) x cone -> (mesh_id, vid, i, x, y, z, angle), cones about the normals.

    The cone's vectors are turned from the z axis to the normal. The cone is a few rows.
    """
    k = normals.crossJoin(F.broadcast(cone))
    theta, phi = F.acos(F.least(F.greatest("nz", F.lit(-1.0)), F.lit(1.0))), F.atan2("ny", "nx")
    x, y, z = rotate(*rotate(F.col("x"), F.col("y"), F.col("z"), "y", theta), "z", phi)
    return k.select("mesh_id", "vid", "i", x.alias("x"), y.alias("y"), z.alias("z"), "angle")


def angle_weighted_distance(hits: DataFrame) -> DataFrame:
    """hits (mesh_id, vid, dist, weight) -> mean distance, weighted, of those from median - std to max(median + std, pi/2); NULL if none."""
    key = ["mesh_id", "vid"]
    spread = hits.groupBy(*key).agg(F.median("angle").alias("m"), F.stddev_pop("angle").alias("s"))
    near = hits.join(spread, key).filter((F.col("angle") >= F.col("m") - F.col("s")) & (F.col("angle") <= F.greatest(F.col("m") + F.col("s"), F.lit(math.pi / 2))))
    w = 1 / F.greatest(F.abs("angle"), F.lit(1e-9))
    mean = near.groupBy(*key).agg((F.sum(F.col("dist") * w) / F.sum(w)).alias("thickness"))
    return spread.select(*key).join(mean, key, "left")


def _in_ranges(rows: DataFrame, by: list[str], *order: str) -> DataFrame:
    """rows with `__b`, a range of (by, order), so that a long line is many groups; equal rows share one."""
    return cut(rows.repartitionByRange(*by, *order).withColumn("__b", F.spark_partition_id()))


def line_windows(points: DataFrame, by: list[str], at: str = "x") -> DataFrame:
    """Each point's part of a line: from half way to the point before to half way to the next; open at the ends.

    A line is sorted in ranges, of which only the first and last points are compared with each other.
    """
    rows = _in_ranges(points, by, at)
    line, o = Window.partitionBy(*by).orderBy("__b"), Window.partitionBy(*by, "__b").orderBy(at)
    ends = rows.groupBy(*by, "__b").agg(F.min(at).alias("__first"), F.max(at).alias("__last"))
    ends = ends.select(*by, "__b", F.lag("__last").over(line).alias("__before"), F.lead("__first").over(line).alias("__after"))
    low, high = (F.coalesce(F.lag(at).over(o), "__before") + F.col(at)) / 2, (F.coalesce(F.lead(at).over(o), "__after") + F.col(at)) / 2
    found = rows.join(ends, [*by, "__b"]).withColumns({"low": F.coalesce(low, F.lit(float("-inf"))), "high": F.coalesce(high, F.lit(float("inf")))})
    return found.select(*points.columns, "low", "high")


def assign_windows(points: DataFrame, values: DataFrame, by: list[str], at: str = "x", value: str = "v", name: str = "pid") -> DataFrame:
    """values (by, v) with the point whose window [low, high) holds each: last window that starts at or before, a running maximum in ranges that each get the last window of those before."""
    marks = line_windows(points, by, at).select(*by, F.col("low").alias("__at"), F.lit(0).alias("__kind"), F.col(name).alias("__p"), F.lit(None).cast("double").alias(value))
    asks = values.select(*by, F.col(value).cast("double").alias("__at"), F.lit(1).alias("__kind"), F.lit(None).alias("__p"), F.col(value).cast("double").alias(value))
    rows = _in_ranges(marks.unionByName(asks), by, "__at", "__kind")
    line, o = Window.partitionBy(*by).orderBy("__b"), Window.partitionBy(*by, "__b").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.groupBy(*by, "__b").agg(F.max_by("__p", F.when(F.col("__kind") == 0, F.col("__at"))).alias("__last"))
    ends = ends.select(*by, "__b", F.last("__last", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    found = rows.withColumn("__own", F.last("__p", ignorenulls=True).over(o)).join(ends, [*by, "__b"])
    return found.filter("__kind = 1").select(*by, value, F.coalesce("__own", "__before").alias(name))


def histogram_score(data: DataFrame, by: list[str], log_odds: list[float], p0: float, value: str = "v") -> DataFrame:
    """Sum of the log odds of each value's bin [0, 1), ..., [14, inf], over n p0."""
    odds = F.array(*[F.lit(float(x)) for x in log_odds])
    bin_ = F.least(F.floor(value), F.lit(len(log_odds) - 1)).cast("int")
    inside = F.when(F.col(value) >= 0, F.element_at(odds, bin_ + 1)).otherwise(0.0)
    return data.groupBy(*by).agg((F.sum(inside) / (F.count("*") * p0)).alias("score"))


def sliding_score(data: DataFrame, by: list[str], log_odds: list[float], p0: float, window: int = 400, step: int = 50, value: str = "v", pos: str = "pos") -> DataFrame:
    """Least histogram_score of the windows of a path, of which the last reaches its end and may be shorter; a path shorter than a window is one."""
    n = data.groupBy(*by).agg(F.count("*").alias("__n"))
    d = data.join(n, by)
    last = F.greatest(F.lit(0), F.ceil((F.col("__n") - window) / step)).cast("int")
    first = F.greatest(F.lit(0), F.ceil((F.col(pos) - window + 1) / step)).cast("int")
    to = F.least(last, F.floor(F.col(pos) / step).cast("int"))
    d = d.withColumn("__w", F.explode(F.when(F.col("__n") < window, F.array(F.lit(0))).when(to >= first, F.sequence(first, to)).otherwise(F.array().cast("array<int>"))))
    return histogram_score(d, [*by, "__w"], log_odds, p0, value).groupBy(*by).agg(F.min("score").alias("score"))


def values_to_colours(value: Column, table: list[tuple[float, float, float]], low: float, high: float) -> Column:
    """A value's colour (three bytes, cut off) by linear interpolation in a table of colours in 0..1."""
    n = len(table) - 1
    at = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - low) / (high - low))) * n
    i = F.least(F.floor(at), F.lit(max(n - 1, 0))).cast("int")
    channel = lambda k: F.array(*[F.lit(float(c[k])) for c in table])
    mixed = lambda k: F.element_at(channel(k), i + 1) * (1 - (at - i)) + F.element_at(channel(k), F.least(i + 2, F.lit(n + 1))) * (at - i)
    return F.array(*[F.floor(mixed(k) * 255).cast("int") for k in range(3)])


def checked_colours(colours: list) -> list[tuple[int, int, int]]:
    """Colours in 0..1 or as bytes, as bytes; anything else is an error."""
    out = []
    for c in colours:
        if len(c) != 3:
            raise ValueError("a colour has three parts")
        whole = all(isinstance(v, int) for v in c) and max(c) > 1
        if min(c) < 0 or max(c) > (255 if whole else 1):
            raise ValueError("a colour's part is out of range")
        out.append(tuple(c) if whole else tuple(int(v * 255) for v in c))
    return out


def link_segments(points: DataFrame, links: DataFrame) -> DataFrame:
    """links (mesh_id, a, b) as line segments (x0, y0, z0, x1, y1, z1)."""
    end = lambda c, k: points.select("mesh_id", F.col("vid").alias(c), *[F.col(x).alias(f"{x}{k}") for x in "xyz"])
    return links.join(end("a", 0), ["mesh_id", "a"]).join(end("b", 1), ["mesh_id", "b"])
