"""Queries on surfaces, and on graphs from points in space."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as gr
from ..operators import kernels as ke
from ..operators import paths as pa
from ..operators import skeletons as sk
from ..operators import spatial as sp
from ..operators import surface as su
from ..operators import tree as t
from ..operators import views as vi
from ..operators.blocks import spatial_blocks
from ..operators.tables import cut
from . import fixtures as fx
from .registry import query

# --- SQL of vectors: triples of expressions ---


def _at(t: str, n: str) -> tuple[str, ...]:
    return tuple(f"CAST({t}.{n}{k} AS DOUBLE)" for k in "xyz")


def _less(u, v):
    return tuple(f"({p} - {q})" for p, q in zip(u, v, strict=True))


def _dot(u, v) -> str:
    return "(" + " + ".join(f"{p} * {q}" for p, q in zip(u, v, strict=True)) + ")"


def _cross(u, v):
    return tuple(f"({u[i]} * {v[j]} - {u[j]} * {v[i]})" for i, j in ((1, 2), (2, 0), (0, 1)))


def _named(**vectors) -> str:
    return ", ".join(f"{e} AS {n}_{k}" for n, v in vectors.items() for e, k in zip(v, "xyz", strict=True))


_TRI = """,
tri AS MATERIALIZED (SELECT f.mesh_id, f.fid, f.a, f.b, f.c, p.x AS a_x, p.y AS a_y, p.z AS a_z, q.x AS b_x, q.y AS b_y, q.z AS b_z, r.x AS c_x, r.y AS c_y, r.z AS c_z
  FROM faces f JOIN points p ON p.mesh_id = f.mesh_id AND p.vid = f.a JOIN points q ON q.mesh_id = f.mesh_id AND q.vid = f.b JOIN points r ON r.mesh_id = f.mesh_id AND r.vid = f.c)"""
_V = {n: tuple(f"{n}_{k}" for k in "xyz") for n in ("p", "a", "b", "c", "n", "e", "f", "s", "h", "q", "r")}


def _side(u: str, v: str) -> str:
    d, w = _less(_V[v], _V[u]), _less(_V["p"], _V[u])
    t = f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {_dot(w, d)} / nullif({_dot(d, d)}, 0)))"
    gap = tuple(f"({x} - coalesce({t}, 0.0::DOUBLE) * {y})" for x, y in zip(w, d, strict=True))
    return _dot(gap, gap)


_INSIDE = " AND ".join(f"{_dot(_cross(_less(_V[v], _V[u]), _less(_V['p'], _V[u])), _V['n'])} >= 0" for u, v in ("ab", "bc", "ca"))
_SURFACE = f""",
both_ AS (SELECT e.mesh_id, e.pid, t.fid, {_named(p=_at('e', 'p'), a=_at('t', 'a_'), b=_at('t', 'b_'), c=_at('t', 'c_'))} FROM ep e JOIN tri t USING (mesh_id)),
wn AS (SELECT *, {_named(n=_cross(_less(_V['b'], _V['a']), _less(_V['c'], _V['a'])))} FROM both_),
far AS (SELECT mesh_id, pid, CASE WHEN {_dot(_V['n'], _V['n'])} > 0 AND {_INSIDE} THEN power({_dot(_less(_V['p'], _V['a']), _V['n'])}, 2) / {_dot(_V['n'], _V['n'])} ELSE least({_side('a', 'b')}, {_side('b', 'c')}, {_side('c', 'a')}) END AS d2 FROM wn)"""


@query("SELECT mesh_id, pid, round(sqrt(min(d2)), 3) + 0 AS distance FROM far GROUP BY mesh_id, pid", fx.NEAR + "," + fx.EVENT_POINTS + _TRI + _SURFACE)
def surface_nearest(spark, d):
    got = su.nearest(fx.event_points(spark, d), fx.points(spark, d), cut(fx.faces(spark, d)))
    return got.select("mesh_id", "pid", (F.round(F.sqrt("d2"), 3) + 0).alias("distance"))


_DIRECTIONS = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if (x, y, z) != (0, 0, 0)]
_RAYS = f""",
dirs AS (SELECT * FROM (VALUES {", ".join(f"({i}, {x}, {y}, {z})" for i, (x, y, z) in enumerate(_DIRECTIONS))}) AS t(i, dx, dy, dz)),
r0 AS (SELECT p.mesh_id, p.vid, dirs.i, {_named(p=_at('p', ''), r=_at('dirs', 'd'), a=_at('t', 'a_'), b=_at('t', 'b_'), c=_at('t', 'c_'))} FROM points p CROSS JOIN dirs JOIN tri t ON t.mesh_id = p.mesh_id AND p.vid NOT IN (t.a, t.b, t.c)),
r1 AS (SELECT mesh_id, vid, i, {_named(r=_V['r'], e=_less(_V['b'], _V['a']), f=_less(_V['c'], _V['a']), s=_less(_V['p'], _V['a']))} FROM r0),
r2 AS (SELECT *, {_named(h=_cross(_V['r'], _V['f']), q=_cross(_V['s'], _V['e']))} FROM r1),
r3 AS (SELECT mesh_id, vid, i, {_dot(_V['s'], _V['h'])} / det AS u, {_dot(_V['r'], _V['q'])} / det AS v, {_dot(_V['f'], _V['q'])} / det AS t FROM (SELECT *, {_dot(_V['e'], _V['h'])} AS det FROM r2) WHERE abs(det) > 1e-9),
hits AS (SELECT mesh_id, vid, i, min(t) AS dist FROM r3 WHERE u >= -1e-9 AND v >= -1e-9 AND u + v <= 1 + 1e-9 AND t > 1e-6 GROUP BY mesh_id, vid, i)"""


@query("SELECT p.mesh_id, p.vid, CAST(dirs.i AS BIGINT) AS i, round(h.dist, 3) + 0 AS dist FROM points p CROSS JOIN dirs LEFT JOIN hits h ON h.mesh_id = p.mesh_id AND h.vid = p.vid AND h.i = dirs.i", fx.NEAR + _TRI + _RAYS)
def ray_first_hits(spark, d):
    p = fx.points(spark, d)
    rays = p.select("mesh_id", "vid", F.posexplode(F.array(*[F.array(*[F.lit(float(c)) for c in v]) for v in _DIRECTIONS])).alias("i", "v"))
    rays = rays.select("mesh_id", "vid", "i", *[F.col("v")[k].alias(c) for k, c in enumerate("xyz")], F.lit(0.0).alias("angle"))
    return su.first_hits(p, cut(fx.faces(spark, d)), rays).select("mesh_id", "vid", "i", (F.round("dist", 3) + 0).alias("dist"))


_FROM_POINTS = """,
mapped AS (SELECT DISTINCT mesh_id, vid FROM (SELECT e.mesh_id, e.pid, p.vid, (p.x-e.px)*(p.x-e.px)+(p.y-e.py)*(p.y-e.py)+(p.z-e.pz)*(p.z-e.pz) AS d2 FROM ep e JOIN points p USING (mesh_id)
  QUALIFY row_number() OVER (PARTITION BY e.mesh_id, e.pid ORDER BY d2, p.vid) = 1) WHERE d2 < 90000),
ways AS (SELECT mesh_id, vid, CAST(0 AS BIGINT) AS dist FROM mapped UNION SELECT w.mesh_id, e.dst, w.dist + e.w FROM ways w JOIN edges e ON e.mesh_id = w.mesh_id AND e.src = w.vid WHERE w.dist + e.w <= 2500)"""


@query("SELECT DISTINCT mesh_id, vid FROM ways", fx.NEAR + "," + fx.EVENT_POINTS + _FROM_POINTS)
def filter_geodesic_points(spark, d):
    return gr.geodesic_near_points(fx.points(spark, d), cut(fx.edges(spark, d)), fx.event_points(spark, d), 2500, max_valid_mapping=300)


_POINT_FOCI = """,
foci0 AS (SELECT mesh_id, min(pid) AS p0, max(pid) AS p1 FROM ep GROUP BY mesh_id),
foci AS (SELECT f.mesh_id, k.i, arg_min(p.vid, {'a': (p.x-e.px)*(p.x-e.px)+(p.y-e.py)*(p.y-e.py)+(p.z-e.pz)*(p.z-e.pz), 'b': p.vid}) AS vid FROM foci0 f CROSS JOIN (SELECT unnest([0, 1]) AS i) k JOIN ep e ON e.mesh_id = f.mesh_id AND e.pid = CASE WHEN k.i = 0 THEN p0 ELSE p1 END JOIN points p ON p.mesh_id = f.mesh_id GROUP BY f.mesh_id, k.i),
hop AS (SELECT mesh_id, src, dst FROM edges UNION SELECT mesh_id, dst, src FROM edges),
go AS (SELECT mesh_id, i AS source, vid, 0 AS dist FROM foci UNION SELECT g.mesh_id, g.source, b.dst, g.dist + 1 FROM go g JOIN hop b ON b.mesh_id = g.mesh_id AND b.src = g.vid WHERE g.dist < 60),
dd AS MATERIALIZED (SELECT mesh_id, source, vid, min(dist) AS dist FROM go GROUP BY mesh_id, source, vid)"""


@query(
    "SELECT a.mesh_id, a.vid FROM dd a JOIN dd b ON b.mesh_id = a.mesh_id AND b.vid = a.vid AND b.source = 1 JOIN foci f ON f.mesh_id = a.mesh_id AND f.i = 1 JOIN dd c ON c.mesh_id = a.mesh_id AND c.source = 0 AND c.vid = f.vid WHERE a.source = 0 AND a.dist * a.dist + b.dist * b.dist < (c.dist + 2) * (c.dist + 2)",
    fx.NEAR + "," + fx.EVENT_POINTS + _POINT_FOCI,
)
def filter_two_point_power(spark, d):
    e = fx.event_points(spark, d)
    ends = e.groupBy("mesh_id").agg(F.min("pid").alias("p0"), F.max("pid").alias("p1"))
    foci = e.join(ends, "mesh_id").filter("pid in (p0, p1)").withColumn("pid", F.when(F.col("pid") == F.col("p0"), 0).otherwise(1)).drop("p0", "p1")
    hops = gr.weighted_graph(fx.edges(spark, d).select("mesh_id", "src", "dst"), directed=False).withColumn("w", F.lit(1))
    return gr.two_point_ellipse_of_points(fx.points(spark, d), cut(hops), foci, 2.0, power=2.0)


_SAMPLED = """,
nr AS (SELECT a.mesh_id, a.vid AS pid, b.vid, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) AS d2 FROM points a JOIN points b USING (mesh_id)
  QUALIFY row_number() OVER (PARTITION BY a.mesh_id, a.vid ORDER BY (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z), b.vid) <= 20),
keyed AS (SELECT *, -ln((CAST('0x' || substr(md5('3|' || mesh_id || '|' || pid || '|' || vid), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE) * sqrt(d2) AS k FROM nr)"""


@query("SELECT mesh_id, pid, CAST(row_number() OVER (PARTITION BY mesh_id, pid ORDER BY vid) - 1 AS INT) AS pos, vid, d2 FROM (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY mesh_id, pid ORDER BY k, vid) <= 8)", fx.POINTS + _SAMPLED)
def spatial_sampled_views(spark, d):
    p = fx.points(spark, d)
    return vi.sampled_views(p, sp.as_points(p), 8, 20, fisheye=True, seed=3)


@query()
def skeleton_path_quality(spark, d):
    p, e = fx.points(spark, d), cut(fx.edges(spark, d))
    blocks = cut(spatial_blocks(p))
    skel, mapping = ke.skeletonize(p, e, 1500.0, min_component=3)
    tree = cut(skel.select("skel_id", "sid", "parent", F.round("w").cast("long").alias("w")))
    both = cut(gr.weighted_graph(e.select("mesh_id", "src", "dst", F.col("w").alias("__w")), F.col("__w"), directed=False))
    pairs = cut(pa.path_pairs(tree, t.Lifts(tree), both, cut(mapping), blocks))
    radius = p.select("mesh_id", "vid", (100.0 * (1 + F.col("vid") % 7)).alias("radius"))
    odds = [2.0 - 0.5 * i for i in range(15)]
    return pa.path_quality(pairs, p, radius, odds, 0.1, 40, 5, edges=both, blocks=blocks).withColumn("score", F.round("score", 6) + 0)


def _skeletons(spark, d):
    """With a soma at each mesh' first event point, smoothed, radii known for two of three vertices."""
    p = cut(fx.points(spark, d))
    soma = fx.event_points(spark, d).filter("pid < 10").select("mesh_id", *[F.col(c).cast("double").alias(c) for c in ("px", "py", "pz")])
    radius = p.filter("vid % 3 > 0").select("mesh_id", "vid", (100.0 * (1 + F.col("vid") % 7)).alias("radius"))
    return sk.skeletonize(p, cut(fx.edges(spark, d)), 1500.0, min_component=3, soma=soma, soma_radius=1500.0, smooth=2, radius=radius)


@query()
def skeleton_blocks(spark, d):
    return _skeletons(spark, d).tree.select("skel_id", "sid", "parent", *[(F.round(c, 3) + 0).alias(c) for c in ("w", "x", "y", "z", "radius")])


@query()
def skeleton_blocks_map(spark, d):
    return _skeletons(spark, d).mapping
