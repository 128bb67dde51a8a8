"""Trees with points at even distances along their cover paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import tree as t
from .tables import cut

XYZ = ("x", "y", "z")


def _at(rows: DataFrame, key: str, prefix: str) -> DataFrame:
    """Distance to the root and place of vertices under other names, for a join on `key`."""
    return rows.select("skel_id", F.col("sid").alias(key), F.col("dist").alias(f"{prefix}dist"), *[F.col(k).alias(f"{prefix}{k}") for k in XYZ])


def resample(skel: DataFrame, paths: t.Lifts, spacing: float, tip_ratio: float = 0.5, avoid_root: bool = True) -> DataFrame:
    """skel (skel_id, sid, parent, w, x, y, z) -> (skel_id, sid, parent, dist, x, y, z, base): points every `spacing` of distance to the root, base the old vertex nearest along the path.

    A cover path is sampled from its base's parent on, unless that is the root, where it starts at its base.
    Its tip is kept if it lies more than tip_ratio spacings beyond the last point. The first point's parent
    is the parent path's point nearest to the branch point along that path. With avoid_root the root's own
    path has no points nearer to the root than max(tip_ratio, 1/2) of the root's first edge. A path of a single
    vertex keeps it. Points are made edge by edge, so that a tree isn't one task; only its paths are numbered together.
    """
    vertex = cut(t.to_root(paths).select("skel_id", "sid", F.col("dist").cast("double").alias("dist")).join(skel.select("skel_id", "sid", "parent", *[F.col(k).cast("double").alias(k) for k in XYZ]), ["skel_id", "sid"]))
    cover = cut(t.cover_paths(skel.select("skel_id", "sid", "parent", "w"), paths).select("skel_id", "sid", "tip", "path", "pos"))
    rows = cover.join(vertex, ["skel_id", "sid"])

    # one row a path: its base, the base's parent, and from where on it is sampled
    ends = rows.groupBy("skel_id", "path", "tip").agg(F.max(F.struct("pos", "sid", "dist", "parent")).alias("base"), F.max("dist").alias("far"))
    up = vertex.select("skel_id", F.col("sid").alias("on"), F.col("parent").isNull().alias("on_root"), F.col("dist").alias("on_dist"))
    ends = ends.select("skel_id", "path", "tip", "far", F.col("base.sid").alias("base_sid"), F.col("base.dist").alias("base_dist"), F.col("base.parent").alias("on")).join(up, ["skel_id", "on"], "left")
    deeper = F.col("on").isNotNull() & ~F.coalesce("on_root", F.lit(True))
    ends = ends.withColumns({"deeper": deeper, "from": F.when(deeper, F.col("on_dist")).otherwise(F.col("base_dist"))})
    # where the root's own path starts anew
    first = rows.join(ends.filter("on is null").select("skel_id", "path", F.lit(True).alias("own")), ["skel_id", "path"]).join(vertex.filter("parent is null").select("skel_id", F.col("sid").alias("parent")), ["skel_id", "parent"], "left_semi")
    first = first.groupBy("skel_id", "path").agg(F.min("dist").alias("first_edge"))
    skip = F.floor(F.col("first_edge") * max(tip_ratio, 0.5) / spacing) if avoid_root else F.lit(0)
    ends = cut(ends.join(first, ["skel_id", "path"], "left").withColumn("skip", F.coalesce(skip, F.lit(0)).cast("long")))

    # points k = 0 at the start, then those of each edge, whose numbers follow from its ends' distances
    edges = rows.withColumnRenamed("dist", "d1").join(_at(vertex, "parent", "p_"), ["skel_id", "parent"]).join(ends.select("skel_id", "path", "from", "far", "deeper", "base_sid", "skip"), ["skel_id", "path"])
    edges = edges.filter("deeper or sid <> base_sid")
    low, high = F.floor((F.col("p_dist") - F.col("from")) / spacing) + 1, F.floor((F.col("d1") - F.col("from")) / spacing)
    low = F.greatest(low, F.col("skip") + 1)
    inside = edges.filter(high >= low).withColumn("k", F.explode(F.sequence(low, high))).withColumn("dist", F.col("from") + F.col("k") * spacing).filter("dist < far")
    share = (F.col("dist") - F.col("p_dist")) / (F.col("d1") - F.col("p_dist"))
    inside = inside.select("skel_id", "path", "k", "dist", *[(F.col(f"p_{k}") + share * (F.col(k) - F.col(f"p_{k}"))).alias(k) for k in XYZ], F.when(F.col("dist") >= (F.col("p_dist") + F.col("d1")) / 2, F.col("sid")).otherwise(F.col("parent")).alias("base"))
    begin = ends.select("skel_id", "path", F.when(F.col("deeper"), F.col("on")).otherwise(F.col("base_sid")).alias("sid")).join(vertex, ["skel_id", "sid"])
    made = cut(begin.select("skel_id", "path", F.lit(0).cast("long").alias("k"), "dist", *XYZ, F.col("sid").alias("base")).unionByName(inside))

    last = made.groupBy("skel_id", "path").agg(F.max(F.struct("k", "dist", *XYZ)).alias("l"))
    tips = ends.join(last, ["skel_id", "path"]).join(_at(vertex, "tip", "t_"), ["skel_id", "tip"])
    away = F.sqrt(sum(((F.col(f"l.{k}") - F.col(f"t_{k}")) ** 2 for k in XYZ), F.lit(0.0)))
    tips = tips.withColumns({"most": F.col("l.k"), "last": F.col("l.dist"), "more": (away / spacing > tip_ratio) & (F.col("t_dist") > F.col("l.dist"))})
    # a point's place on its path: those that were left out at the root count no place
    place = lambda k: F.when(F.col(k) > F.col("skip"), F.col(k) - F.col("skip")).otherwise(F.lit(0).cast("long"))
    tips = tips.withColumn("places", place("most") + F.col("more").cast("long") + 1)
    offset = F.coalesce(F.sum("places").over(Window.partitionBy("skel_id").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tips = cut(tips.withColumn("offset", offset).select("skel_id", "path", "on", "from", "far", "skip", "most", "last", "more", "places", "offset", "tip", *[F.col(f"t_{k}").alias(k) for k in XYZ]))

    # the parent of a path's first point: the parent path's point nearest to the branch point along it
    home = cover.select("skel_id", F.col("sid").alias("on"), F.col("path").alias("on_path")).join(vertex.select("skel_id", F.col("sid").alias("on"), F.col("dist").alias("at")), ["skel_id", "on"])
    theirs = tips.select("skel_id", F.col("path").alias("on_path"), *[F.col(c).alias(f"o_{c}") for c in ("from", "far", "skip", "most", "last", "more", "places", "offset")])
    roots = tips.filter("on is not null").select("skel_id", "path", "on").join(home, ["skel_id", "on"]).join(theirs, ["skel_id", "on_path"])
    k = F.least(F.col("o_most"), F.greatest(F.lit(0), F.ceil((F.col("at") - F.col("o_from")) / spacing - 0.5)))
    gap = (F.col("o_skip") + 1) * spacing
    k = F.when((k > 0) & (k <= F.col("o_skip")), F.when((F.col("o_most") > 0) & (gap - F.col("at") < F.col("at")), F.col("o_skip") + 1).otherwise(0)).otherwise(k)
    k = F.when(k > F.col("o_skip"), k - F.col("o_skip")).otherwise(0)
    to_tip = F.col("o_more") & (F.col("o_far") - F.col("at") < F.col("at") - F.col("o_last"))
    roots = roots.select("skel_id", "path", (F.col("o_offset") + F.when(to_tip, F.col("o_places") - 1).otherwise(k)).cast("long").alias("root"))

    points = made.join(tips.select("skel_id", "path", "offset", "skip"), ["skel_id", "path"]).select("skel_id", "path", place("k").alias("i"), "offset", "dist", *XYZ, "base")
    points = points.unionByName(tips.filter("more").select("skel_id", "path", (F.col("places") - 1).alias("i"), "offset", F.col("far").alias("dist"), *XYZ, F.col("tip").alias("base")))
    sid = F.col("offset") + F.col("i")
    return points.join(roots, ["skel_id", "path"], "left").select("skel_id", sid.cast("long").alias("sid"), F.when(F.col("i") > 0, sid - 1).otherwise(F.col("root")).cast("long").alias("parent"), "dist", *XYZ, "base")
