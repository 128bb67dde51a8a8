"""Local views of meshes: samples of the vertices near a centre, and few views that hold every vertex."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .spatial import k_nearest
from .tables import cut


def _uniform(seed: int, *of: str) -> Column:
    """A number between 0 and 1 that seed and the columns decide."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in of])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 48))


def sampled_views(vertex: DataFrame, centres: DataFrame, n_points: int, sample_n_points: int, fisheye: bool = False, max_distance: float | None = None, seed: int = 0) -> DataFrame:
    """(mesh_id, pid, pos, vid, d2): n_points of the sample_n_points vertices nearest to each centre, in the order of their ids.

    Drawn without replacement, each alike or, with fisheye, by 1 / distance: the n smallest of exponential
    keys -ln(u) / weight are such a sample. A vertex at the centre itself is always in a fisheye view. Centres with
    fewer vertices in reach have them all. A seed always draws the same.
    """
    if sample_n_points < n_points:
        raise ValueError("fewer vertices to sample from than points")
    near = k_nearest(centres, vertex, sample_n_points, max_distance=max_distance)
    key = -F.log(_uniform(seed, "mesh_id", "pid", "vid")) * (F.sqrt("d2") if fisheye else F.lit(1.0))
    drawn = near.withColumn("turn", F.row_number().over(Window.partitionBy("mesh_id", "pid").orderBy(key, "vid"))).filter(F.col("turn") <= n_points)
    return drawn.select("mesh_id", "pid", (F.row_number().over(Window.partitionBy("mesh_id", "pid").orderBy("vid")) - 1).alias("pos"), "vid", "d2")


def greedy_cover(near: DataFrame, order: str = "sequential", seed: int = 0, taken: list | None = None) -> DataFrame:
    """near (mesh_id, pid, vid), views of vertices: (mesh_id, step, pid), views taken one after another, each of the first vertex that no view before it holds.

    The order is that of the ids or, 'random', one drawn by the seed. What going through
    the vertices one by one gives is found in rounds: a vertex is taken once all that come before it and hold it in their views
    are known not to be, and is out once one of them is taken. A random order takes about log(n) rounds.
    taken, if given, gets their number.
    """
    if order not in ("sequential", "random"):
        raise ValueError("order is sequential or random")
    first = F.lit(0.0) if order == "sequential" else _uniform(seed, "mesh_id", "pid")
    turn = near.select("mesh_id", "pid").distinct().select("mesh_id", "pid", F.struct(first.alias("u"), "pid").alias("turn"))
    turn = cut(turn)
    by = turn.withColumnRenamed("turn", "by")
    held = near.filter("pid <> vid").select("mesh_id", "pid", "vid").distinct().join(by, ["mesh_id", "pid"]).select("mesh_id", F.col("pid").alias("by"), F.col("by").alias("before"), F.col("vid").alias("pid"))
    links = cut(held.join(turn, ["mesh_id", "pid"]).filter("before < turn").select("mesh_id", "by", "pid"))
    open_, chosen, rounds = turn.select("mesh_id", "pid"), None, 0
    while not open_.isEmpty():
        rounds += 1
        now = cut(open_.join(links.select("mesh_id", "pid").distinct(), ["mesh_id", "pid"], "left_anti"))
        chosen = now if chosen is None else chosen.unionAll(now)
        out = links.join(now.withColumnRenamed("pid", "by"), ["mesh_id", "by"], "left_semi").select("mesh_id", "pid").distinct()
        gone = cut(out.unionAll(now))
        open_ = cut(open_.join(gone, ["mesh_id", "pid"], "left_anti"))
        # only what is still open holds back others
        links = cut(links.join(gone, ["mesh_id", "pid"], "left_anti").join(gone.withColumnRenamed("pid", "by"), ["mesh_id", "by"], "left_anti"))
    if taken is not None:
        taken.append(rounds)
    if chosen is None:
        return turn.select("mesh_id", F.lit(0).cast("long").alias("step"), "pid")
    step = F.row_number().over(Window.partitionBy("mesh_id").orderBy("turn")) - 1  # of the views that were taken, not of all vertices
    return chosen.join(turn, ["mesh_id", "pid"]).select("mesh_id", step.cast("long").alias("step"), "pid")
