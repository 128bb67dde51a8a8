"""Analyses of a tree with annotations (skel_id, sid, is_pre): input and output points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tree as t
from .tables import cut, few


def points_below(paths: t.Lifts, anno: DataFrame) -> DataFrame:
    """(skel_id, sid, dp, dq): input and output points at and below each vertex."""
    per = anno.groupBy("skel_id", "sid").agg(F.count_if("is_pre").alias("p"), F.count_if(~F.col("is_pre")).alias("q"))
    inside = per.join(paths.tree.select("skel_id", "sid"), ["skel_id", "sid"], "left_semi").withColumnsRenamed({"p": "dp", "q": "dq"})
    found = paths.tree.select("skel_id", "sid").join(t.below(paths, inside, F.sum), ["skel_id", "sid"], "left")
    return found.select("skel_id", "sid", *[F.coalesce(k, F.lit(0)).alias(k) for k in ("dp", "dq")])


def betweenness(paths: t.Lifts, anno: DataFrame) -> DataFrame:
    """Paths between an input and an output point that use the vertex' edge to its parent: dp (Q - dq) + (P - dp) dq."""
    below = points_below(paths, anno)
    totals = anno.groupBy("skel_id").agg(F.count_if("is_pre").alias("P"), F.count_if(~F.col("is_pre")).alias("Q"))
    return below.join(few(totals), "skel_id").withColumn("betweenness", F.col("dp") * (F.col("Q") - F.col("dq")) + (F.col("P") - F.col("dp")) * F.col("dq"))


def entropy(p: Column, q: Column) -> Column:
    """Bits of a division of p + q points into p and q; 0 for an empty side."""
    n = p + q
    term = lambda x: F.when((x > 0) & (n > 0), -(x / n) * F.log2(x / n)).otherwise(0.0)
    return term(p) + term(q)


def split_entropy(p1: Column, q1: Column, p2: Column, q2: Column) -> Column:
    """Entropy of two parts, weighted by their points."""
    n1, n2 = p1 + q1, p2 + q2
    return F.when(n1 + n2 > 0, (n1 * entropy(p1, q1) + n2 * entropy(p2, q2)) / (n1 + n2)).otherwise(0.0)


def segregation(paths: t.Lifts, anno: DataFrame) -> DataFrame:
    """Per vertex: 1 - H(cut above it) / H(uncut); 0 where nothing is divided."""
    b = betweenness(paths, anno)
    rest_p, rest_q = F.col("P") - F.col("dp"), F.col("Q") - F.col("dq")
    whole = entropy(F.col("P"), F.col("Q"))
    some = (F.col("dp") + F.col("dq") > 0) & (rest_p + rest_q > 0) & (whole > 0)
    return b.withColumn("segregation", F.when(some, 1 - split_entropy(F.col("dp"), F.col("dq"), rest_p, rest_q) / whole).otherwise(0.0))


def split_point(tree: DataFrame, paths: t.Lifts, anno: DataFrame, at_segment_base: bool = True) -> DataFrame:
    """(skel_id, sid): the base of the segment of greatest betweenness, or that vertex itself; ties nearest the root, then the smaller id."""
    b = betweenness(paths, anno).join(t.to_root(paths).select("skel_id", "sid", "dist"), ["skel_id", "sid"])
    top = b.groupBy("skel_id").agg(F.max_by("sid", F.struct("betweenness", -F.col("dist"), -F.col("sid"))).alias("sid"))
    if at_segment_base:
        top = t.segment_heads(tree, paths).join(top, ["skel_id", "sid"]).select("skel_id", F.col("head").alias("sid"))
    return top


def split_axon(tree: DataFrame, paths: t.Lifts, anno: DataFrame, times: int = 1, at_segment_base: bool = True) -> tuple[DataFrame, DataFrame]:
    """Vertices (skel_id, sid, is_axon) and (skel_id, cut, quality): the side with the larger share of input points is the axon, the lower on ties.

    times: go on with what isn't axon yet. Without input or output points nothing is axon and the quality is 0.
    """
    axon, cuts, paths_left, anno_left = None, None, paths, anno
    for _ in range(times):
        has = anno_left.groupBy("skel_id").agg(F.count_if("is_pre").alias("p"), F.count_if(~F.col("is_pre")).alias("q")).filter("p > 0 and q > 0").select("skel_id")
        top = split_point(tree, paths_left, anno_left, at_segment_base).join(has, "skel_id", "left_semi")
        s = segregation(paths_left, anno_left).join(top, ["skel_id", "sid"])
        share = lambda p, q: p / (p + q + 1)
        lower = share(F.col("dp"), F.col("dq")) >= share(F.col("P") - F.col("dp"), F.col("Q") - F.col("dq"))
        chosen = cut(s.select("skel_id", F.col("sid").alias("cut"), lower.alias("lower"), F.col("segregation").alias("quality")))
        lower_part = t.downstream(paths_left, chosen.select("skel_id", F.col("cut").alias("sid"))).select("skel_id", "sid", F.lit(True).alias("below"))
        side = paths_left.tree.join(few(chosen.select("skel_id", "lower")), "skel_id").join(lower_part, ["skel_id", "sid"], "left")
        new = cut(side.filter(F.coalesce("below", F.lit(False)) == F.col("lower")).select("skel_id", "sid"))
        axon = new if axon is None else axon.unionAll(new)
        cuts = chosen if cuts is None else cuts.unionAll(chosen)
        rest = paths_left.tree.join(new, ["skel_id", "sid"], "left_anti")
        loose = rest.join(new.withColumnRenamed("sid", "parent"), ["skel_id", "parent"], "left_semi").select("skel_id", "sid")
        paths_left = t.Lifts(cut(t.cut_edges(rest, loose)))
        anno_left = anno_left.join(new, ["skel_id", "sid"], "left_anti")
    flagged = tree.select("skel_id", "sid").join(axon.distinct().withColumn("is_axon", F.lit(True)), ["skel_id", "sid"], "left").withColumn("is_axon", F.coalesce("is_axon", F.lit(False)))
    return flagged, cuts.select("skel_id", "cut", "quality")


def split_quality(anno: DataFrame, flagged: DataFrame) -> DataFrame:
    """1 - H(split) / H(unsplit) per tree; 0 if a side is empty."""
    x = anno.join(flagged, ["skel_id", "sid"]).groupBy("skel_id").agg(
        *[F.count_if((F.col("is_axon") == a) & (F.col("is_pre") == b)).alias(n) for a, b, n in ((True, True, "pa"), (True, False, "qa"), (False, True, "pd"), (False, False, "qd"))]
    )
    whole = entropy(F.col("pa") + F.col("pd"), F.col("qa") + F.col("qd"))
    some = (F.col("pa") + F.col("qa") > 0) & (F.col("pd") + F.col("qd") > 0) & (whole > 0)
    return x.select("skel_id", F.when(some, 1 - split_entropy(F.col("pa"), F.col("qa"), F.col("pd"), F.col("qd")) / whole).otherwise(0.0).alias("quality"))


def window_pairs(paths: t.Lifts, width: float) -> DataFrame:
    """(skel_id, i, j): pairs of vertices within width along the tree (inclusive, themselves too)."""
    return t.near_pairs(paths, lambda d: d <= width).select("skel_id", "i", "j")


def vertex_cable(tree: DataFrame) -> DataFrame:
    """Half of the edges at each vertex."""
    edges = tree.filter("parent is not null")
    both = edges.select("skel_id", "sid", "w").unionAll(edges.select("skel_id", F.col("parent").alias("sid"), "w"))
    return both.groupBy("skel_id", "sid").agg((F.sum("w") / 2).alias("cable"))


def linear_density(tree: DataFrame, paths: t.Lifts, anno: DataFrame, width: float, normalize: bool = True, exclude_root: bool = False) -> DataFrame:
    """Vertices with points within width along the tree, over the cable there (each vertex counts once, however many points it has)."""
    if exclude_root:
        roots = tree.filter("parent is null").select("skel_id", F.col("sid").alias("parent"))
        paths = t.Lifts(t.cut_edges(tree, tree.join(roots, ["skel_id", "parent"]).select("skel_id", "sid")))
    pairs = window_pairs(paths, width)
    has = anno.select("skel_id", F.col("sid").alias("j"), F.lit(1).alias("has")).distinct()
    n = pairs.join(has, ["skel_id", "j"], "left")
    if not normalize:
        return n.groupBy("skel_id", F.col("i").alias("sid")).agg(F.count("has").alias("density"))
    cable = vertex_cable(tree).withColumnRenamed("sid", "j")
    n = n.join(cable, ["skel_id", "j"], "left").groupBy("skel_id", F.col("i").alias("sid")).agg(F.count("has").alias("n"), F.sum("cable").alias("cable"))
    return n.select("skel_id", "sid", (F.col("n") / F.when(F.col("cable") > 0, F.col("cable"))).alias("density"))


def gaussian_density(tree: DataFrame, paths: t.Lifts, anno: DataFrame, width: float, reach: float = 3.0) -> DataFrame:
    """Points weighted exp(-d^2 / 2 width^2) within reach * width, over the cable weighted alike."""
    pairs = t.near_pairs(paths, lambda d: d <= width * reach)
    has = anno.select("skel_id", F.col("sid").alias("j"), F.lit(1.0).alias("has")).distinct()
    k = F.exp(-F.col("d") * F.col("d") / (2.0 * width * width))
    x = pairs.join(has, ["skel_id", "j"], "left").join(vertex_cable(tree).withColumnRenamed("sid", "j"), ["skel_id", "j"], "left")
    x = x.groupBy("skel_id", F.col("i").alias("sid")).agg(F.sum(k * F.coalesce("has", F.lit(0.0))).alias("n"), F.sum(k * F.col("cable")).alias("cable"))
    return x.select("skel_id", "sid", (F.col("n") / F.when(F.col("cable") > 0, F.col("cable"))).alias("density"))
