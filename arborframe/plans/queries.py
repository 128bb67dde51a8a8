"""One query an operator, over fixtures.py's objects, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import annotations as an
from ..operators import cuts as cu
from ..operators import graph as gr
from ..operators import kernels as ke
from ..operators import masks as ma
from ..operators import neuron as ne
from ..operators import paths as pa
from ..operators import resampling as rs
from ..operators import spatial as sp
from ..operators import surface as su
from ..operators import tree as t
from ..operators import views as vi
from ..operators.blocks import spatial_blocks
from ..operators.tables import cut
from ..sources import files
from . import fixtures as fx
from .registry import query

def _lifts(spark, d):
    tree = cut(fx.tree(spark, d))
    return tree, t.Lifts(tree)


# --- trees ---


@query("SELECT skel_id, sid, hops, dist FROM toroot", fx.CLOSURE)
def tree_distance_to_root(spark, d):
    return t.to_root(_lifts(spark, d)[1]).select("skel_id", "sid", "hops", "dist")


@query("SELECT skel_id, anc AS sid, count(*) AS n, CAST(sum(dist) AS BIGINT) AS total FROM closure GROUP BY skel_id, anc", fx.CLOSURE)
def tree_downstream_counts(spark, d):
    paths = _lifts(spark, d)[1]
    far = t.to_root(paths).select("skel_id", "sid", F.col("dist").alias("own"))
    sums = t.below(paths, far.withColumn("n", F.lit(1).cast("long")).withColumn("total", F.col("own")).drop("own"), F.sum)
    return sums.join(far, ["skel_id", "sid"]).select("skel_id", "sid", "n", (F.col("total") - F.col("n") * F.col("own")).alias("total"))


@query("SELECT t.skel_id, t.sid, coalesce(t.parent, -1) AS parent, coalesce(k.n, 0) AS n_children FROM tree t LEFT JOIN kids k USING (skel_id, sid)", fx.CLOSURE)
def tree_parent_and_children(spark, d):
    tree = fx.tree(spark, d)
    return tree.join(t.child_counts(tree), ["skel_id", "sid"]).select("skel_id", "sid", F.coalesce("parent", F.lit(-1)).alias("parent"), F.col("n").alias("n_children"))


@query("SELECT skel_id, parent AS sid, array_to_string(list(sid ORDER BY sid), ',') AS kids FROM tree WHERE parent IS NOT NULL GROUP BY skel_id, parent", fx.TREE)
def tree_child_lists(spark, d):
    return t.children(fx.tree(spark, d)).select("skel_id", "sid", F.concat_ws(",", F.transform("kids", lambda x: x.cast("string"))).alias("kids"))


@query("SELECT skel_id, sid, 'end' AS kind FROM tips UNION ALL SELECT skel_id, sid, 'branch' FROM forks UNION ALL SELECT skel_id, sid, 'root' FROM tree WHERE parent IS NULL", fx.CLOSURE)
def tree_topo_points(spark, d):
    return t.topo_points(fx.tree(spark, d))


@query("SELECT degree, count(*) AS n FROM (SELECT coalesce(n, 0) + CASE WHEN parent IS NULL THEN 0 ELSE 1 END AS degree FROM tree LEFT JOIN kids USING (skel_id, sid)) GROUP BY degree", fx.CLOSURE)
def tree_undirected_degrees(spark, d):
    return t.degrees(fx.tree(spark, d)).groupBy("degree").agg(F.count("*").alias("n"))


@query("SELECT skel_id, sid, hops AS pos, anc FROM closure", fx.CLOSURE)
def tree_path_to_root(spark, d):
    tree, paths = _lifts(spark, d)
    return t.path_to_root(paths, tree.select("skel_id", "sid"))


_PAIRS = """,
pairs AS (SELECT skel_id, sid AS a, (sid * 37 + 11) % (SELECT count(*) FROM tree) AS b FROM tree),
lca0 AS (SELECT p.skel_id, p.a, p.b, x.anc AS lca, x.hops AS hops_a, y.hops AS hops_b, x.dist AS dist_a, y.dist AS dist_b, row_number() OVER (PARTITION BY p.skel_id, p.a, p.b ORDER BY x.hops) AS r
  FROM pairs p JOIN closure x ON x.skel_id = p.skel_id AND x.sid = p.a JOIN closure y ON y.skel_id = p.skel_id AND y.sid = p.b AND y.anc = x.anc),
lca AS (SELECT * FROM lca0 WHERE r = 1)"""


def _pairs(tree):
    n = tree.agg(F.count("*").alias("n"))
    return tree.crossJoin(n).select("skel_id", F.col("sid").alias("a"), ((F.col("sid") * 37 + 11) % F.col("n")).alias("b"))


@query("SELECT skel_id, a, b, lca, hops_a, hops_b, dist_a, dist_b FROM lca", fx.CLOSURE + _PAIRS)
def tree_lowest_common_ancestor(spark, d):
    tree, paths = _lifts(spark, d)
    return t.lowest_common(paths, _pairs(tree))


@query("SELECT skel_id, a, b, dist_a + dist_b AS dist FROM lca", fx.CLOSURE + _PAIRS)
def tree_distance_between(spark, d):
    tree, paths = _lifts(spark, d)
    return t.distance_between(paths, _pairs(tree))


@query(
    """SELECT l.skel_id, l.a, l.b, c.hops AS pos, c.anc AS sid FROM lca l JOIN closure c ON c.skel_id = l.skel_id AND c.sid = l.a WHERE c.hops <= l.hops_a
UNION ALL SELECT l.skel_id, l.a, l.b, l.hops_a + l.hops_b - c.hops, c.anc FROM lca l JOIN closure c ON c.skel_id = l.skel_id AND c.sid = l.b WHERE c.hops < l.hops_b""",
    fx.CLOSURE + _PAIRS,
)
def tree_path_between(spark, d):
    tree, paths = _lifts(spark, d)
    return t.path_between(paths, _pairs(tree))


@query("SELECT skel_id, CAST(sum(CASE WHEN parent IS NOT NULL THEN w END) AS BIGINT) AS length FROM tree GROUP BY skel_id", fx.TREE)
def tree_total_length(spark, d):
    return t.path_length(fx.tree(spark, d))


@query(
    """SELECT g.skel_id, g.grp, CAST(coalesce(sum(CASE WHEN h.sid IS NOT NULL THEN g.w END), 0) AS BIGINT) AS length
FROM (SELECT *, sid % 5 // 2 AS grp FROM tree) g LEFT JOIN (SELECT skel_id, sid, sid % 5 // 2 AS grp FROM tree) h ON h.skel_id = g.skel_id AND h.grp = g.grp AND h.sid = g.parent GROUP BY g.skel_id, g.grp""",
    fx.TREE,
)
def tree_path_length(spark, d):
    tree = fx.tree(spark, d)
    return t.path_length(tree, tree.select("skel_id", F.floor(F.col("sid") % 5 / 2).alias("grp"), "sid"))


_HEADS = """,
heads AS (SELECT t.skel_id, t.sid FROM tree t LEFT JOIN forks f ON f.skel_id = t.skel_id AND f.sid = t.parent WHERE f.sid IS NOT NULL OR t.parent IS NULL),
seg0 AS (SELECT c.skel_id, c.sid, arg_min(c.anc, c.hops) AS head FROM closure c JOIN heads h ON h.skel_id = c.skel_id AND h.sid = c.anc GROUP BY c.skel_id, c.sid),
segn AS (SELECT skel_id, head, row_number() OVER (PARTITION BY skel_id ORDER BY min(sid)) - 1 AS seg FROM seg0 GROUP BY skel_id, head),
seg AS MATERIALIZED (SELECT s.skel_id, s.sid, n.seg, s.head, row_number() OVER (PARTITION BY s.skel_id, s.head ORDER BY r.hops DESC) - 1 AS pos FROM seg0 s JOIN segn n USING (skel_id, head) JOIN toroot r USING (skel_id, sid))"""


@query("SELECT skel_id, sid, CAST(seg AS INT) AS seg, CAST(pos AS INT) AS pos FROM seg", fx.CLOSURE + _HEADS)
def tree_segments(spark, d):
    return t.segments(*_lifts(spark, d))


@query("SELECT s.skel_id, s.sid, s.seg, s.pos FROM seg s UNION ALL SELECT b.skel_id, t.parent, b.seg, b.pos + 1 FROM (SELECT skel_id, seg, max(pos) AS pos, arg_max(sid, pos) AS sid FROM seg GROUP BY skel_id, seg) b JOIN tree t USING (skel_id, sid) WHERE t.parent IS NOT NULL", fx.CLOSURE + _HEADS)
def tree_segments_plus(spark, d):
    return t.segments_plus(*_lifts(spark, d))


_COVER = """,
own AS (SELECT c.skel_id, c.anc AS sid, arg_max(c.sid, r.dist * 1000000000 + c.sid) AS tip FROM closure c JOIN tips USING (skel_id, sid) JOIN toroot r USING (skel_id, sid) GROUP BY c.skel_id, c.anc),
covn AS (SELECT o.skel_id, o.tip, row_number() OVER (PARTITION BY o.skel_id ORDER BY sum(t.w) DESC, o.tip DESC) - 1 AS path FROM own o JOIN tree t USING (skel_id, sid) GROUP BY o.skel_id, o.tip),
cover AS MATERIALIZED (SELECT o.skel_id, o.sid, o.tip, n.path, row_number() OVER (PARTITION BY o.skel_id, o.tip ORDER BY r.hops DESC) - 1 AS pos FROM own o JOIN covn n USING (skel_id, tip) JOIN toroot r USING (skel_id, sid))"""


@query("SELECT skel_id, sid, tip, path, pos FROM cover", fx.CLOSURE + _COVER)
def tree_cover_paths(spark, d):
    return t.cover_paths(*_lifts(spark, d))


@query("SELECT skel_id, sid, CASE WHEN sid % 64 = 0 THEN NULL ELSE parent END AS parent, w FROM tree", fx.TREE)
def tree_cut_graph(spark, d):
    tree = fx.tree(spark, d)
    return t.cut_edges(tree, tree.filter("sid % 64 = 0").select("skel_id", "sid"))


@query(
    """, way AS (SELECT anc AS sid, hops FROM closure WHERE sid = 777)
SELECT t.skel_id, t.sid, CASE WHEN y.sid IS NOT NULL THEN b.sid ELSE t.parent END AS parent, CASE WHEN y.sid IS NOT NULL THEN coalesce(bt.w, 0) ELSE t.w END AS w
FROM tree t LEFT JOIN way y ON y.sid = t.sid LEFT JOIN way b ON b.hops = y.hops - 1 LEFT JOIN tree bt ON bt.sid = b.sid""",
    fx.CLOSURE,
)
def tree_reroot(spark, d):
    tree, paths = _lifts(spark, d)
    return t.reroot(tree, paths, tree.filter("sid = 777").select("skel_id", "sid"))


@query("SELECT skel_id, arg_max(sid, dist * 1000000000 - sid) AS sid, max(dist) AS dist FROM toroot GROUP BY skel_id", fx.CLOSURE)
def tree_far_point(spark, d):
    return t.far_point(*_lifts(spark, d))


@query(
    """SELECT DISTINCT x.skel_id, x.sid AS "of", y.sid FROM (SELECT * FROM closure WHERE dist < 150) x JOIN (SELECT * FROM closure WHERE dist < 150) y ON y.skel_id = x.skel_id AND y.anc = x.anc AND x.dist + y.dist < 150""",
    fx.CLOSURE,
)
def tree_within_distance(spark, d):
    tree, paths = _lifts(spark, d)
    return t.within_distance(paths, tree.select("skel_id", "sid"), 150)


_TOPO = """,
topo AS (SELECT skel_id, sid FROM tips UNION SELECT skel_id, sid FROM forks UNION SELECT skel_id, sid FROM tree WHERE parent IS NULL)"""


@query(
    """SELECT skel_id, sid, anc AS "to" FROM (SELECT c.skel_id, c.sid, c.anc, row_number() OVER (PARTITION BY c.skel_id, c.sid ORDER BY c.hops) AS r, count(*) OVER (PARTITION BY c.skel_id, c.sid) AS n
FROM closure c JOIN topo p ON p.skel_id = c.skel_id AND p.sid = c.anc) WHERE r = least(2, n)""",
    fx.CLOSURE + _TOPO,
)
def tree_jump_proximal(spark, d):
    tree, paths = _lifts(spark, d)
    return t.jump_proximal(tree, paths, tree.select("skel_id", "sid"), 2)


@query("""SELECT c.skel_id, c.anc AS sid, arg_min(c.sid, c.dist * 1000000000 + c.sid) AS "to" FROM closure c JOIN topo p USING (skel_id, sid) GROUP BY c.skel_id, c.anc""", fx.CLOSURE + _TOPO)
def tree_jump_distal(spark, d):
    tree, paths = _lifts(spark, d)
    return t.jump_distal(tree, paths, tree.select("skel_id", "sid"))


@query("""SELECT a.skel_id, a.sid AS "of", b.sid FROM seg0 a JOIN seg0 b ON b.skel_id = a.skel_id AND b.head = a.head""", fx.CLOSURE + _HEADS)
def tree_same_segment(spark, d):
    tree, paths = _lifts(spark, d)
    return t.same_segment(tree, paths, tree.select("skel_id", "sid"))


@query(
    """, h AS (SELECT c.skel_id, c.sid, min(c.hops) AS h FROM closure c JOIN forks f ON f.skel_id = c.skel_id AND f.sid = c.anc WHERE c.hops > 0 GROUP BY c.skel_id, c.sid)
SELECT c.skel_id, c.sid AS "of", count(*) AS n, CAST(sum(b.sid) AS BIGINT) AS total FROM h JOIN closure c ON c.skel_id = h.skel_id AND c.sid = h.sid AND c.hops = h.h - 1 JOIN closure b ON b.skel_id = c.skel_id AND b.anc = c.anc GROUP BY c.skel_id, c.sid""",
    fx.CLOSURE,
)
def tree_same_branch(spark, d):
    tree, paths = _lifts(spark, d)
    one = tree.select("skel_id", "sid", F.lit(1).cast("long").alias("n"), F.col("sid").alias("total"))
    return t.branch_sums(tree, paths, tree.select("skel_id", "sid"), one)


@query("SELECT c.skel_id, c.sid, CASE WHEN max(c.hops) = 0 THEN 0 ELSE count(f.sid) END AS branch_order FROM closure c LEFT JOIN forks f ON f.skel_id = c.skel_id AND f.sid = c.anc GROUP BY c.skel_id, c.sid", fx.CLOSURE)
def tree_branch_order(spark, d):
    return t.branch_order(*_lifts(spark, d))


_S = "".join(
    f""",
s{k} AS MATERIALIZED (SELECT DISTINCT c.skel_id, c.anc AS sid FROM closure c JOIN (SELECT skel_id, parent AS sid FROM tree JOIN {f"s{k - 1}" if k > 2 else "tree2"} USING (skel_id, sid) WHERE parent IS NOT NULL GROUP BY skel_id, parent HAVING count(*) > 1) f USING (skel_id, sid))"""
    for k in range(2, 13)
)
_ORDER = " UNION ALL ".join(f"SELECT skel_id, sid, {k} AS k FROM s{k}" for k in range(2, 13))


@query(f"SELECT skel_id, sid, CAST(max(k) AS INT) AS strahler FROM (SELECT skel_id, sid, 1 AS k FROM tree UNION ALL {_ORDER}) GROUP BY skel_id, sid", fx.CLOSURE + ", tree2 AS (SELECT skel_id, sid FROM tree)" + _S)
def tree_strahler_order(spark, d):
    return t.strahler_order(*_lifts(spark, d))


@query(
    "SELECT c.skel_id, c.sid, arg_min(c.anc, c.hops) AS \"to\" FROM closure c JOIN tree t ON t.skel_id = c.skel_id AND t.sid = c.anc WHERE t.parent IS NULL OR t.sid % 3 > 0 GROUP BY c.skel_id, c.sid",
    fx.CLOSURE,
)
def tree_collapse_zero_edges(spark, d):
    tree, paths = _lifts(spark, d)
    return t.collapse_zero_edges(tree.withColumn("w", F.when(F.col("sid") % 3 == 0, 0).otherwise(F.col("w"))), paths)


@query(
    """, up_to AS (SELECT c.skel_id, c.sid, arg_min(c.anc, c.hops) AS k FROM closure c JOIN tree t ON t.skel_id = c.skel_id AND t.sid = c.anc WHERE t.parent IS NULL OR t.sid % 3 > 0 GROUP BY c.skel_id, c.sid)
SELECT t.skel_id, t.sid, p.k AS parent, CASE WHEN t.sid % 3 = 0 THEN 0 ELSE t.w END AS w FROM tree t JOIN up_to s ON s.skel_id = t.skel_id AND s.sid = t.sid AND s.k = t.sid LEFT JOIN up_to p ON p.skel_id = t.skel_id AND p.sid = t.parent""",
    fx.CLOSURE,
)
def tree_collapsed(spark, d):
    tree = fx.tree(spark, d)
    flat = tree.withColumn("w", F.when(F.col("sid") % 3 == 0, 0).otherwise(F.col("w")))
    return t.collapsed(flat)


# --- neurons ---

_BELOW = """,
per AS (SELECT skel_id, sid, count(*) FILTER (is_pre) AS p, count(*) FILTER (NOT is_pre) AS q FROM anno GROUP BY skel_id, sid),
below AS (SELECT c.skel_id, c.anc AS sid, CAST(coalesce(sum(p), 0) AS BIGINT) AS dp, CAST(coalesce(sum(q), 0) AS BIGINT) AS dq FROM closure c LEFT JOIN per USING (skel_id, sid) GROUP BY c.skel_id, c.anc),
bet AS MATERIALIZED (SELECT skel_id, sid, dp, dq, P, Q, dp * (Q - dq) + (P - dp) * dq AS betweenness FROM below JOIN (SELECT skel_id, count(*) FILTER (is_pre) AS P, count(*) FILTER (NOT is_pre) AS Q FROM anno GROUP BY skel_id) USING (skel_id))"""


@query("SELECT skel_id, sid, dp, dq, betweenness FROM bet", fx.CLOSURE + _BELOW)
def neuron_betweenness(spark, d):
    return ne.betweenness(_lifts(spark, d)[1], fx.annotations(spark, d)).select("skel_id", "sid", "dp", "dq", "betweenness")


@query("SELECT b.skel_id, arg_max(b.sid, {'a': betweenness, 'b': -dist, 'c': -b.sid}) AS sid FROM bet b JOIN toroot r ON r.skel_id = b.skel_id AND r.sid = b.sid GROUP BY b.skel_id", fx.CLOSURE + _BELOW)
def neuron_split_point(spark, d):
    tree, paths = _lifts(spark, d)
    return ne.split_point(tree, paths, fx.annotations(spark, d), at_segment_base=False)


_H = "(CASE WHEN {a} > 0 THEN -({a} / CAST({a} + {b} AS DOUBLE)) * log2({a} / CAST({a} + {b} AS DOUBLE)) ELSE 0 END + CASE WHEN {b} > 0 THEN -({b} / CAST({a} + {b} AS DOUBLE)) * log2({b} / CAST({a} + {b} AS DOUBLE)) ELSE 0 END)"
_SEG = f"""SELECT skel_id, sid, round(CASE WHEN dp + dq > 0 AND (P - dp) + (Q - dq) > 0 AND {_H.format(a='P', b='Q')} > 0
  THEN 1 - ((dp + dq) * {_H.format(a='dp', b='dq')} + (P - dp + Q - dq) * {_H.format(a='(P - dp)', b='(Q - dq)')}) / (P + Q) / {_H.format(a='P', b='Q')} ELSE 0 END, 6) + 0 AS segregation FROM bet"""


@query(_SEG, fx.CLOSURE + _BELOW)
def neuron_segregation(spark, d):
    return ne.segregation(_lifts(spark, d)[1], fx.annotations(spark, d)).select("skel_id", "sid", (F.round("segregation", 6) + 0).alias("segregation"))


@query()
def neuron_axon_split(spark, d):
    tree, paths = _lifts(spark, d)
    return ne.split_axon(tree, paths, fx.annotations(spark, d), times=2)[0]


_AXON = """,
most AS (SELECT b.skel_id, arg_max(b.sid, {'a': betweenness, 'b': -dist, 'c': -b.sid}) AS sid FROM bet b JOIN toroot r ON r.skel_id = b.skel_id AND r.sid = b.sid GROUP BY b.skel_id),
split_at AS (SELECT b.*, dp / CAST(dp + dq + 1 AS DOUBLE) >= (P - dp) / CAST(P - dp + Q - dq + 1 AS DOUBLE) AS lower_ FROM most m JOIN seg0 s USING (skel_id, sid) JOIN bet b ON b.skel_id = s.skel_id AND b.sid = s.head),
flag AS MATERIALIZED (SELECT t.skel_id, t.sid, (c.anc IS NOT NULL) = s.lower_ AS is_axon FROM tree t JOIN split_at s ON s.skel_id = t.skel_id LEFT JOIN closure c ON c.skel_id = t.skel_id AND c.sid = t.sid AND c.anc = s.sid)"""


@query("SELECT skel_id, sid, is_axon FROM flag", fx.CLOSURE + _BELOW + _HEADS + _AXON)
def neuron_axon_split_once(spark, d):
    tree, paths = _lifts(spark, d)
    return ne.split_axon(tree, paths, fx.annotations(spark, d))[0]


_SIDES = """(SELECT a.skel_id, count(*) FILTER (f.is_axon AND a.is_pre) AS pa, count(*) FILTER (f.is_axon AND NOT a.is_pre) AS qa, count(*) FILTER (NOT f.is_axon AND a.is_pre) AS pd, count(*) FILTER (NOT f.is_axon AND NOT a.is_pre) AS qd
FROM anno a JOIN flag f USING (skel_id, sid) GROUP BY a.skel_id)"""


@query(
    f"SELECT skel_id, round(1 - ((pa + qa) * {_H.format(a='pa', b='qa')} + (pd + qd) * {_H.format(a='pd', b='qd')}) / (pa + qa + pd + qd) / {_H.format(a='(pa + pd)', b='(qa + qd)')}, 6) + 0 AS quality FROM {_SIDES}",
    fx.CLOSURE + _BELOW + _HEADS + _AXON,
)
def neuron_axon_quality(spark, d):
    tree, paths = _lifts(spark, d)
    anno = fx.annotations(spark, d)
    return ne.split_quality(anno, cut(ne.split_axon(tree, paths, anno)[0])).withColumn("quality", F.round("quality", 6) + 0)


_WINDOW = """,
win AS MATERIALIZED (SELECT DISTINCT x.skel_id, x.sid AS i, y.sid AS j FROM closure x JOIN closure y ON y.skel_id = x.skel_id AND y.anc = x.anc AND x.dist + y.dist <= 60 WHERE x.dist <= 60 AND y.dist <= 60)"""


@query("SELECT skel_id, i, count(*) AS n, CAST(sum(j) AS BIGINT) AS total FROM win GROUP BY skel_id, i", fx.CLOSURE + _WINDOW)
def neuron_window_pairs(spark, d):
    return ne.window_pairs(_lifts(spark, d)[1], 60).groupBy("skel_id", "i").agg(F.count("*").alias("n"), F.sum("j").alias("total"))


@query(
    """, cable AS (SELECT skel_id, sid, sum(w) / 2.0 AS cable FROM (SELECT skel_id, sid, w FROM tree WHERE parent IS NOT NULL UNION ALL SELECT skel_id, parent, w FROM tree WHERE parent IS NOT NULL) GROUP BY skel_id, sid),
has AS (SELECT DISTINCT skel_id, sid FROM anno WHERE is_pre)
SELECT w.skel_id, w.i AS sid, round(count(h.sid) / CAST(sum(c.cable) AS DOUBLE), 9) AS density FROM win w LEFT JOIN has h ON h.skel_id = w.skel_id AND h.sid = w.j LEFT JOIN cable c ON c.skel_id = w.skel_id AND c.sid = w.j GROUP BY w.skel_id, w.i""",
    fx.CLOSURE + _WINDOW,
)
def neuron_linear_density(spark, d):
    tree, paths = _lifts(spark, d)
    return ne.linear_density(tree, paths, fx.annotations(spark, d).filter("is_pre"), 60).withColumn("density", F.round("density", 9))


# --- meshes: masks, graphs, space ---


@query("SELECT f.mesh_id, f.fid, f.a, f.b, f.c FROM faces f WHERE f.a % 7 > 0 AND f.b % 7 > 0 AND f.c % 7 > 0", fx.NEAR)
def mask_apply(spark, d):
    p, f = fx.points(spark, d), fx.faces(spark, d)
    return ma.apply_mask(p, f, fx.edges(spark, d).select("mesh_id", F.col("src").alias("a"), F.col("dst").alias("b")), p.filter("vid % 7 > 0").select("mesh_id", "vid"))[1]


@query("""SELECT f.mesh_id, f.fid, a.i AS a, b.i AS b, c.i AS c FROM faces f JOIN k a ON a.mesh_id = f.mesh_id AND a.vid = f.a JOIN k b ON b.mesh_id = f.mesh_id AND b.vid = f.b JOIN k c ON c.mesh_id = f.mesh_id AND c.vid = f.c""", fx.NEAR + ", k AS (SELECT mesh_id, vid, CAST(row_number() OVER (PARTITION BY mesh_id ORDER BY vid) - 1 AS INT) AS i FROM points WHERE vid % 7 > 0)")
def mask_reindex_faces(spark, d):
    return ma.reindex_shapes(fx.faces(spark, d), fx.points(spark, d).filter("vid % 7 > 0"), ["a", "b", "c"])


@query("SELECT p.mesh_id, p.vid, CAST(coalesce(k.i, -1) AS INT) AS i FROM points p LEFT JOIN k USING (mesh_id, vid)", fx.POINTS + ", k AS (SELECT mesh_id, vid, row_number() OVER (PARTITION BY mesh_id ORDER BY vid) - 1 AS i FROM points WHERE vid % 7 > 0)")
def mask_from_base_padded(spark, d):
    p = fx.points(spark, d)
    return ma.from_base(p.filter("vid % 7 > 0"), p.select("mesh_id", "vid"), padded=True)


@query("SELECT mesh_id, vid, x, y, z FROM points WHERE sqrt(pow(x - (-1000 + (y + 2000) / 4000.0 * 2000), 2) + pow(z - (500 + (y + 2000) / 4000.0 * -1000), 2)) < 1500 AND y > -2000 AND y < 2000", fx.POINTS)
def filter_close_to_line(spark, d):
    return ma.close_to_line(fx.points(spark, d), (-1000, -2000, 500), (1000, 2000, -500), 1500.0)


@query("SELECT DISTINCT p.mesh_id, p.vid FROM points p JOIN ep e ON e.mesh_id = p.mesh_id WHERE (p.x-e.px)*(p.x-e.px)+(p.y-e.py)*(p.y-e.py)+(p.z-e.pz)*(p.z-e.pz) < 360000", fx.POINTS + "," + fx.EVENT_POINTS)
def filter_near_points(spark, d):
    return sp.near_points(fx.points(spark, d), fx.event_points(spark, d), 600)


@query("SELECT mesh_id, src, dst, count(*) AS n FROM (SELECT mesh_id, a AS src, b AS dst FROM faces UNION ALL SELECT mesh_id, b, c FROM faces UNION ALL SELECT mesh_id, c, a FROM faces) GROUP BY mesh_id, src, dst", fx.NEAR)
def graph_half_edges(spark, d):
    return gr.weighted_graph(gr.graph_edges(fx.faces(spark, d))).withColumnRenamed("w", "n")


@query("SELECT mesh_id, src, dst, CAST(sum(w) AS BIGINT) AS w FROM (SELECT mesh_id, src, dst, w FROM edges UNION ALL SELECT mesh_id, dst, src, w FROM edges) GROUP BY mesh_id, src, dst", fx.NEAR)
def graph_undirected(spark, d):
    e = fx.edges(spark, d)
    return gr.weighted_graph(e.select("mesh_id", "src", "dst", F.col("w").alias("__w")), F.col("__w"), directed=False).select("mesh_id", "src", "dst", "w")


_CC = """,
both_ AS (SELECT mesh_id, src, dst FROM edges UNION SELECT mesh_id, dst, src FROM edges),
reach AS (SELECT mesh_id, vid, vid AS label FROM points UNION SELECT r.mesh_id, b.dst, r.label FROM reach r JOIN both_ b ON b.mesh_id = r.mesh_id AND b.src = r.vid),
cc AS MATERIALIZED (SELECT mesh_id, vid, min(label) AS label FROM reach GROUP BY mesh_id, vid)"""


@query("SELECT mesh_id, vid, label FROM cc", fx.NEAR + _CC)
def graph_components(spark, d):
    return gr.connected_components(fx.points(spark, d), fx.edges(spark, d))


# edges to the nearest only make components of many sizes
_SMALL_CC = _CC.replace("FROM edges", "FROM (SELECT mesh_id, pid AS src, vid AS dst FROM near WHERE rank = 1)")


def _small_components(spark, d):
    first = fx.neighbours(spark, d).filter("rank = 1").select("mesh_id", F.col("pid").alias("src"), F.col("vid").alias("dst"))
    return cut(gr.connected_components(fx.points(spark, d), first))


@query("SELECT c.mesh_id, c.vid FROM cc c JOIN (SELECT mesh_id, label FROM cc GROUP BY mesh_id, label HAVING count(*) > 3 AND count(*) <= 9) USING (mesh_id, label)", fx.NEAR + _SMALL_CC)
def filter_components_by_size(spark, d):
    return ma.components_by_size(_small_components(spark, d), 3, 9)


@query("SELECT c.mesh_id, c.vid FROM cc c JOIN (SELECT mesh_id, arg_max(label, n * 1000000 - label) AS label FROM (SELECT mesh_id, label, count(*) AS n FROM cc GROUP BY mesh_id, label) GROUP BY mesh_id) USING (mesh_id, label)", fx.NEAR + _CC)
def filter_largest_component(spark, d):
    return ma.largest_component(gr.connected_components(fx.points(spark, d), fx.edges(spark, d)))


_SSSP = """,
seeds AS (SELECT mesh_id, min(vid) AS vid FROM points GROUP BY mesh_id),
ways AS (SELECT mesh_id, vid, CAST(0 AS BIGINT) AS dist FROM seeds UNION SELECT w.mesh_id, e.dst, w.dist + e.w FROM ways w JOIN edges e ON e.mesh_id = w.mesh_id AND e.src = w.vid WHERE w.dist + e.w <= 4000)"""


@query("SELECT mesh_id, vid, CAST(min(dist) AS DOUBLE) AS dist FROM ways GROUP BY mesh_id, vid", fx.NEAR + _SSSP)
def graph_shortest_paths(spark, d):
    p = fx.points(spark, d)
    seeds = p.groupBy("mesh_id").agg(F.min("vid").alias("vid")).select("mesh_id", F.lit(0).cast("long").alias("source"), "vid")
    return gr.shortest_paths(cut(fx.edges(spark, d)), seeds, 4000, cut(spatial_blocks(p))).select("mesh_id", "vid", "dist")


@query("SELECT DISTINCT mesh_id, vid FROM ways", fx.NEAR + _SSSP)
def filter_geodesic(spark, d):
    p = fx.points(spark, d)
    return gr.geodesic_within(cut(fx.edges(spark, d)), p.groupBy("mesh_id").agg(F.min("vid").alias("vid")), 4000, cut(spatial_blocks(p)))


@query("SELECT e.mesh_id, e.pid, arg_min(p.vid, ((p.x-e.px)*(p.x-e.px)+(p.y-e.py)*(p.y-e.py)+(p.z-e.pz)*(p.z-e.pz)) * 100000 + p.vid) AS vid, min((p.x-e.px)*(p.x-e.px)+(p.y-e.py)*(p.y-e.py)+(p.z-e.pz)*(p.z-e.pz)) AS d2 FROM ep e JOIN points p USING (mesh_id) GROUP BY e.mesh_id, e.pid", fx.POINTS + "," + fx.EVENT_POINTS)
def spatial_nearest(spark, d):
    return sp.k_nearest(fx.event_points(spark, d), fx.points(spark, d), 1).select("mesh_id", "pid", "vid", "d2")


@query("SELECT mesh_id, pid, CAST(rank AS INT) AS rank, vid, d2 FROM near", fx.NEAR)
def spatial_two_nearest(spark, d):
    return fx.neighbours(spark, d)


@query("SELECT a.mesh_id, a.vid AS pid, b.vid, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) AS d2 FROM points a JOIN points b USING (mesh_id) WHERE (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= 490000", fx.POINTS)
def spatial_radius_join(spark, d):
    p = fx.points(spark, d)
    return sp.radius_join(sp.as_points(p), p, 700)


_MUTUAL = """,
pairs AS (SELECT a.mesh_id, a.vid AS a, b.vid AS b, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) AS d2 FROM points a JOIN points b USING (mesh_id) WHERE a.vid % 2 = 0 AND b.vid % 2 = 1),
ra AS (SELECT *, row_number() OVER (PARTITION BY mesh_id, a ORDER BY d2, b) AS i, row_number() OVER (PARTITION BY mesh_id, b ORDER BY d2, a) AS j FROM pairs)"""


@query("SELECT mesh_id, a, b, d2 FROM ra WHERE i = 1 AND j = 1", fx.POINTS + _MUTUAL)
def spatial_mutual_nearest(spark, d):
    p = fx.points(spark, d)
    return sp.mutual_nearest(p.filter("vid % 2 = 0"), p.filter("vid % 2 = 1"))


@query(
    """, lab AS (SELECT p.*, cc.label FROM points p JOIN cc USING (mesh_id, vid)), big AS (SELECT lab.* FROM lab JOIN (SELECT mesh_id, label FROM cc GROUP BY mesh_id, label HAVING count(*) > 3) USING (mesh_id, label)),
pr AS (SELECT a.mesh_id, a.vid AS a, b.vid AS b, a.label AS la, b.label AS lb, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) AS d2 FROM big a JOIN big b ON a.mesh_id = b.mesh_id AND a.label < b.label),
rg AS (SELECT *, greatest(1, ceil(sqrt(d2) / 100.0)) AS ring FROM pr WHERE d2 <= 16000000)
SELECT mesh_id, a, b, la, lb, d2 FROM rg QUALIFY ring = min(ring) OVER (PARTITION BY mesh_id, la, lb)""",
    fx.NEAR + _SMALL_CC,
)
def repair_close_components(spark, d):
    p = fx.points(spark, d)
    return sp.close_components(p.join(_small_components(spark, d), ["mesh_id", "vid"]), 3, 4000, 100)


@query("SELECT v.mesh_id, v.pid, f.fid FROM (SELECT mesh_id, fid, unnest([a, b, c]) AS vid FROM faces) f JOIN v USING (mesh_id, vid) GROUP BY v.mesh_id, v.pid, f.fid HAVING count(*) = 3", fx.NEAR + """,
v AS (SELECT * FROM (SELECT a.mesh_id, a.vid AS pid, b.vid, row_number() OVER (PARTITION BY a.mesh_id, a.vid ORDER BY (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z), b.vid) AS r FROM points a JOIN points b USING (mesh_id)) WHERE r <= 12)""")
def spatial_local_faces(spark, d):
    p = fx.points(spark, d)
    return sp.local_faces(sp.local_views(p, sp.as_points(p), 12), fx.faces(spark, d))


@query("SELECT mesh_id, vid, min(vid) OVER (PARTITION BY mesh_id, floor(x / 500.0), floor(y / 500.0), floor(z / 500.0)) AS \"to\" FROM points", fx.POINTS)
def repair_snap_to_grid(spark, d):
    return sp.snap_to_grid(fx.points(spark, d), 500.0)


# --- annotations and index translation ---


@query("SELECT DISTINCT mesh_id, sid FROM m2s WHERE sid IS NOT NULL", fx.MAP)
def index_to_skeleton(spark, d):
    m = fx.mesh_to_skel(spark, d)
    return an.to_skeleton(m.select("mesh_id", "vid"), m)


@query("SELECT mesh_id, vid, coalesce(sid, -1) AS sid FROM m2s", fx.MAP)
def index_to_skeleton_padded(spark, d):
    m = fx.mesh_to_skel(spark, d)
    return an.to_skeleton(m.select("mesh_id", "vid"), m, padded=True)


@query("SELECT DISTINCT b.mesh_id, b.vid FROM m2s a JOIN m2s b ON b.mesh_id = a.mesh_id AND b.sid = a.sid", fx.MAP)
def index_all_equivalent(spark, d):
    m = fx.mesh_to_skel(spark, d)
    return an.all_equivalent(m.select("mesh_id", "vid"), m)


@query("SELECT m.mesh_id, m.vid, coalesce(CAST(t.w AS DOUBLE), -1.0) AS value FROM m2s m LEFT JOIN tree t ON t.sid = m.sid", fx.TREE + "," + fx.MAP)
def property_to_mesh(spark, d):
    return an.skeleton_property_to_mesh(fx.tree(spark, d).select(F.col("skel_id").alias("mesh_id"), "sid", F.col("w").cast("double").alias("value")), fx.mesh_to_skel(spark, d))


@query("SELECT mesh_id, sid, median(CAST(vid % 101 AS DOUBLE)) AS value FROM m2s WHERE sid IS NOT NULL GROUP BY mesh_id, sid", fx.MAP)
def property_to_skeleton(spark, d):
    m = fx.mesh_to_skel(spark, d)
    return an.mesh_property_to_skeleton(m.select("mesh_id", "vid", (F.col("vid") % 101).cast("double").alias("value")), m, "median")


@query(
    """, hit AS (SELECT e.mesh_id, e.pid, arg_min(p.vid, d2 * 100000 + p.vid) AS vid, min(d2) AS d2 FROM (SELECT e.*, p.vid, (p.x-e.px)*(p.x-e.px)+(p.y-e.py)*(p.y-e.py)+(p.z-e.pz)*(p.z-e.pz) AS d2 FROM ep e JOIN points p USING (mesh_id)) e JOIN points p USING (mesh_id, vid) GROUP BY e.mesh_id, e.pid)
SELECT e.mesh_id, e.pid AS row_id, h.vid, h.d2, coalesce(h.d2 < 1440000, false) AS valid FROM ep e LEFT JOIN hit h ON h.mesh_id = e.mesh_id AND h.pid = e.pid AND h.d2 <= 1440000""",
    fx.POINTS + "," + fx.EVENT_POINTS,
)
def annotation_anchor(spark, d):
    rows = fx.event_points(spark, d).select("mesh_id", F.lit("events").alias("anno"), F.col("pid").alias("row_id"), "px", "py", "pz")
    return an.anchor(rows, fx.points(spark, d), 1200).select("mesh_id", "row_id", "vid", "d2", "valid")


@query("SELECT e.mesh_id, e.pid, coalesce(h.vid, -1) AS vid FROM ep e LEFT JOIN (SELECT mesh_id, pid, arg_min(vid, d2 * 100000 + vid) AS vid, min(d2) AS d2 FROM (SELECT e.mesh_id, e.pid, p.vid, (p.x-e.px)*(p.x-e.px)+(p.y-e.py)*(p.y-e.py)+(p.z-e.pz)*(p.z-e.pz) AS d2 FROM ep e JOIN points p USING (mesh_id)) GROUP BY mesh_id, pid) h ON h.mesh_id = e.mesh_id AND h.pid = e.pid AND h.d2 <= 1440000", fx.POINTS + "," + fx.EVENT_POINTS)
def annotation_location(spark, d):
    return an.location_indices(fx.event_points(spark, d), fx.points(spark, d), 1200)


@query("SELECT c.mesh_id, b.vid FROM (SELECT DISTINCT m.mesh_id, c.sid FROM m2s m JOIN closure c ON c.anc = m.sid WHERE m.vid = 31) c JOIN m2s b USING (mesh_id, sid)", fx.CLOSURE + "," + fx.MAP)
def work_downstream_of(spark, d):
    m = fx.mesh_to_skel(spark, d)
    return an.Meshwork(m.select("mesh_id", "vid"), fx.tree(spark, d), m).downstream_of(m.filter("vid = 31").select("mesh_id", "vid"))


@query("SELECT k.skel_id, k.sid, CASE WHEN u.sid IS NOT NULL THEN k.parent END AS parent, k.w FROM (SELECT t.* FROM tree t WHERE sid IN (SELECT sid FROM m2s WHERE vid % 5 = 1 AND sid IS NOT NULL)) k LEFT JOIN (SELECT DISTINCT sid FROM m2s WHERE vid % 5 = 1 AND sid IS NOT NULL) u ON u.sid = k.parent", fx.TREE + "," + fx.MAP)
def work_masked_skeleton(spark, d):
    m = fx.mesh_to_skel(spark, d)
    return an.Meshwork(m.select("mesh_id", "vid"), fx.tree(spark, d), m).masked(m.filter("vid % 5 = 1").select("mesh_id", "vid")).skeleton()


# --- scores, windows, colours, files, kernels ---


@query("SELECT l_returnflag, round(sum(CASE WHEN v >= 0 THEN least(floor(v), 14) * 0.5 - 2 ELSE 0 END) / (count(*) * 0.1), 6) AS score FROM (SELECT l_returnflag, l_quantity / 2 AS v FROM lineitem) GROUP BY l_returnflag")
def score_histogram(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_returnflag", (F.col("l_quantity") / 2).alias("v"))
    return g.histogram_score(rows, ["l_returnflag"], [0.5 * i - 2 for i in range(15)], 0.1).withColumn("score", F.round("score", 6))


@query("SELECT e.event_id, arg_max(u.o_custkey, {'a': u.low, 'b': u.o_custkey}) AS pid FROM events e JOIN (SELECT o_custkey, coalesce((lag(x) OVER o + x) / 2.0, -1e18) AS low FROM (SELECT o_custkey, CAST(min(o_orderkey) AS DOUBLE) AS x FROM orders GROUP BY o_custkey) WINDOW o AS (ORDER BY x)) u ON u.low <= e.event_id GROUP BY e.event_id")
def line_window_assignment(spark, d):
    pts = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_custkey").alias("pid")).agg(F.min("o_orderkey").cast("double").alias("x")).withColumn("line", F.lit(0))
    ev = spark.read.parquet(f"{d}/events.parquet").select(F.lit(0).alias("line"), F.col("event_id").alias("v"))
    return g.assign_windows(pts, ev, ["line"]).select(F.col("v").cast("long").alias("event_id"), "pid")


@query("SELECT o_orderkey, CAST(floor(a * 255) AS INT) AS red, CAST(floor((1 - a) * 255) AS INT) AS blue FROM (SELECT o_orderkey, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (o_orderkey % 1000 - 100) / 700.0::DOUBLE)) AS a FROM orders)")
def colour_values(spark, d):
    c = g.values_to_colours((F.col("o_orderkey") % 1000).cast("double"), [(0.0, 0.0, 1.0), (1.0, 0.0, 0.0)], 100.0, 800.0)
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", c.alias("c")).select("o_orderkey", F.col("c")[0].alias("red"), F.col("c")[2].alias("blue"))


@query(
    """, num AS (SELECT skel_id, sid, row_number() OVER (PARTITION BY skel_id ORDER BY path, pos DESC) - 1 AS id FROM cover)
SELECT t.skel_id, n.id, CASE WHEN t.sid % 5 = 0 THEN 2 ELSE 3 END AS label, CAST(t.sid AS DOUBLE) / 1000 AS x, CAST(t.w AS DOUBLE) / 1000 AS y, 0.0::DOUBLE AS z, 1.0::DOUBLE AS radius, coalesce(u.id, -1) AS parent
FROM tree t JOIN num n USING (skel_id, sid) LEFT JOIN num u ON u.skel_id = t.skel_id AND u.sid = t.parent""",
    fx.CLOSURE + _COVER,
)
def swc_export(spark, d):
    tree, paths = _lifts(spark, d)
    skel = tree.withColumns({"x": F.col("sid").cast("double"), "y": F.col("w").cast("double"), "z": F.lit(0.0)})
    no = F.lit(False)
    return files.swc_rows(skel, paths, files.swc_labels(tree.select("skel_id", "sid"), F.col("sid") % 5 == 0, no, no, no))


def _undirected(spark, d):
    return cut(fx.edges(spark, d))


@query()
def skeletonize(spark, d):
    return ke.skeletonize(fx.points(spark, d), _undirected(spark, d), 1500.0, min_component=3)[0]


@query()
def skeleton_map(spark, d):
    return ke.skeletonize(fx.points(spark, d), _undirected(spark, d), 1500.0, min_component=3)[1]


@query()
def resample(spark, d):
    tree, paths = _lifts(spark, d)
    return rs.resample(tree.withColumns({"x": F.col("sid").cast("double"), "y": F.col("w").cast("double"), "z": F.lit(0.0)}), paths, 100.0)


@query()
def ray_thickness(spark, d):
    p, f = fx.points(spark, d), cut(fx.faces(spark, d))
    normals = ke.vertex_normals(p, f).filter("nx is not null")
    inward = normals.select("mesh_id", "vid", *[(-F.col(k)).alias(k) for k in ("nx", "ny", "nz")])
    return g.angle_weighted_distance(su.first_hits(p, f, g.oriented_cones(inward, g.cone_directions(spark, 16, 1.0))).filter("dist is not null"))


@query()
def multicut(spark, d):
    p = fx.points(spark, d)
    ends = p.groupBy("mesh_id").agg(F.min("vid").alias("a"), F.max("vid").alias("b")).select("mesh_id", F.inline(F.array(F.struct(F.col("a").alias("vid"), F.lit(True).alias("is_source")), F.struct(F.col("b").alias("vid"), F.lit(False).alias("is_source")))))
    return cu.multicut(cut(fx.faces(spark, d)), cut(_undirected(spark, d)), ends, 1e9, cut(spatial_blocks(p)))[0]


@query()
def multicut_sides(spark, d):
    """Events to the left against events to the right: the sides of the cut, from points."""
    points = fx.event_points(spark, d).withColumn("is_source", F.col("px") < 0)
    return cu.multicut_of_points(cut(fx.points(spark, d)), cut(fx.faces(spark, d)), cut(_undirected(spark, d)), points, 1e9)[2]


@query()
def repair_links(spark, d):
    p = fx.points(spark, d)
    ends = p.groupBy("mesh_id").agg(F.min("vid").alias("a"), F.max("vid").alias("b")).withColumn("merge", F.lit(0).cast("long"))
    return ke.link_merges(p, _undirected(spark, d), ends)


@query()
def graph_far_points(spark, d):
    e = _undirected(spark, d)
    e = cut(gr.weighted_graph(e.select("mesh_id", "src", "dst", F.col("w").alias("__w")), F.col("__w"), directed=False))
    p = fx.points(spark, d)
    return gr.far_points(e, cut(gr.component_starts(p, e)), cut(spatial_blocks(p)))


@query()
def spatial_greedy_views(spark, d):
    p = fx.points(spark, d)
    return vi.greedy_cover(cut(sp.local_views(p, sp.as_points(p), 12).select("mesh_id", "pid", "vid")))


@query()
def spatial_aligned_views(spark, d):
    p = fx.points(spark, d)
    return sp.aligned_views(sp.local_views(p, sp.as_points(p), 12), p)


@query()
def skeleton_point_paths(spark, d):
    p, e = fx.points(spark, d), _undirected(spark, d)
    skel = cut(ke.skeletonize(p, e, 1500.0, min_component=3)[0]).select(F.col("skel_id").alias("mesh_id"), F.col("sid").alias("vid"))
    both = gr.weighted_graph(e.select("mesh_id", "src", "dst", F.col("w").alias("__w")), F.col("__w"), directed=False)
    return pa.point_to_skeleton(fx.event_points(spark, d), p, fx.faces(spark, d), cut(both), skel)


@query(
    """, nb AS (SELECT t.sid, u.w FROM tree t JOIN tree u ON u.sid = t.parent UNION ALL SELECT t.sid, u.w FROM tree t JOIN tree u ON u.parent = t.sid), mean AS (SELECT sid, avg(w) AS m FROM nb GROUP BY sid)
SELECT t.skel_id, t.sid, CASE WHEN t.sid % 4 = 1 THEN m.m ELSE CAST(t.w AS DOUBLE) END AS radius FROM tree t LEFT JOIN mean m USING (sid)""",
    fx.TREE,
)
def skeleton_fill_radius(spark, d):
    tree = fx.tree(spark, d)  # the neighbours of every fourth vertex are known, so that one round fills all
    return pa.fill_radius(tree.select("skel_id", "sid", "parent", F.when(F.col("sid") % 4 != 1, F.col("w").cast("double")).alias("radius")))
