"""Meshes, graphs, trees and annotations made from the data set's tables by rule, in whole numbers so that sums are exact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import spatial


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mesh_id, vid, x, y, z): the first three components of the embeddings, times 10,000; a mesh a label."""
    e = _table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").cast("long").alias("mesh_id"), F.col("vec_id").alias("vid"), *[F.round(10000 * F.col("embedding")[i].cast("double")).cast("long").alias(k) for i, k in enumerate("xyz")])


def neighbours(spark: SparkSession, sf_dir: str, k: int = 2) -> DataFrame:
    """(mesh_id, pid, rank, vid, d2) of each point's k nearest others."""
    p = points(spark, sf_dir)
    return spatial.k_nearest(spatial.as_points(p), p, k, not_self=True)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mesh_id, src, dst, w): to the two nearest others, w the rounded distance."""
    return neighbours(spark, sf_dir).select("mesh_id", F.col("pid").alias("src"), F.col("vid").alias("dst"), F.round(F.sqrt("d2")).cast("long").alias("w"))


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mesh_id, fid, a, b, c): each point with its two nearest others."""
    n = neighbours(spark, sf_dir)
    return n.groupBy("mesh_id", F.col("pid").alias("fid")).agg(F.max(F.when(F.col("rank") == 1, F.col("vid"))).alias("b"), F.max(F.when(F.col("rank") == 2, F.col("vid"))).alias("c")).select("mesh_id", "fid", F.col("fid").alias("a"), "b", "c")


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(skel_id, sid, parent, w) of the orders: every eighth hangs on its sixteenth, the others on the one before."""
    k = F.col("o_orderkey")
    parent = F.when(k == 0, None).when(k % 8 == 0, F.floor(k / 16)).otherwise(k - 1)
    return _table(spark, sf_dir, "orders").select(F.lit(0).cast("long").alias("skel_id"), k.alias("sid"), parent.cast("long").alias("parent"), (1 + k % 97).alias("w"))


def forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(skel_id, sid, parent, w, x, y, z, radius): 25 deep trees of the orders; branches of 40 vertices, each hanging from a third of its place, thick at their base."""
    k = F.col("o_orderkey")
    i, tree = F.floor(k / 25), k % 25
    up = F.when(i == 0, None).when(i % 40 == 0, F.floor(i / 3)).otherwise(i - 1) * 25 + tree
    turn = lambda n: (F.floor(F.floor(i / 40) / n) % 3 - 1) * (i % 40) * 200
    radius = 300 + 8000 / (1 + F.exp(((i % 40) * 200 - 4000) / 700.0))
    place = [turn(n).cast("double").alias(c) for n, c in ((1, "x"), (3, "y"), (9, "z"))]
    return _table(spark, sf_dir, "orders").select(tree.alias("skel_id"), k.alias("sid"), up.cast("long").alias("parent"), (200 + i % 97).alias("w"), *place, F.when(k % 17 != 5, radius).alias("radius"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(skel_id, sid, is_pre) of the line items."""
    return _table(spark, sf_dir, "lineitem").select(F.lit(0).cast("long").alias("skel_id"), F.col("l_orderkey").alias("sid"), (F.col("l_returnflag") == "R").alias("is_pre"))


def mesh_to_skel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mesh_id, vid, sid): three mesh vertices a tree vertex; every eleventh is unmapped."""
    v = _table(spark, sf_dir, "orders").select(F.explode(F.array(*[F.col("o_orderkey") * 3 + i for i in range(3)])).alias("vid"))
    return v.select(F.lit(0).cast("long").alias("mesh_id"), "vid", F.when(F.col("vid") % 11 != 0, F.floor(F.col("vid") / 3).cast("long")).alias("sid"))


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mesh_id, pid, px, py, pz): a point an event, near the points' range; ten meshes."""
    e = _table(spark, sf_dir, "events")
    i = F.col("event_id")
    return e.select((i % 10).alias("mesh_id"), i.alias("pid"), (i * 7919 % 4001 - 2000).alias("px"), (i * 104729 % 4001 - 2000).alias("py"), (i * 1299709 % 4001 - 2000).alias("pz"))


POINTS = """points AS MATERIALIZED (SELECT CAST(label AS BIGINT) AS mesh_id, vec_id AS vid, CAST(round(10000 * CAST(embedding[1] AS DOUBLE)) AS BIGINT) AS x,
  CAST(round(10000 * CAST(embedding[2] AS DOUBLE)) AS BIGINT) AS y, CAST(round(10000 * CAST(embedding[3] AS DOUBLE)) AS BIGINT) AS z FROM embeddings)"""
NEAR = POINTS + """,
near AS MATERIALIZED (SELECT * FROM (SELECT a.mesh_id, a.vid AS pid, b.vid, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) AS d2,
  row_number() OVER (PARTITION BY a.mesh_id, a.vid ORDER BY (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z), b.vid) AS rank
  FROM points a JOIN points b ON a.mesh_id = b.mesh_id AND a.vid <> b.vid) WHERE rank <= 2),
edges AS MATERIALIZED (SELECT mesh_id, pid AS src, vid AS dst, CAST(round(sqrt(d2)) AS BIGINT) AS w FROM near),
faces AS MATERIALIZED (SELECT mesh_id, pid AS fid, pid AS a, max(vid) FILTER (rank = 1) AS b, max(vid) FILTER (rank = 2) AS c FROM near GROUP BY mesh_id, pid)"""
TREE = """tree AS MATERIALIZED (SELECT CAST(0 AS BIGINT) AS skel_id, o_orderkey AS sid, CASE WHEN o_orderkey = 0 THEN NULL WHEN o_orderkey % 8 = 0 THEN o_orderkey // 16 ELSE o_orderkey - 1 END AS parent,
  1 + o_orderkey % 97 AS w FROM orders),
anno AS (SELECT CAST(0 AS BIGINT) AS skel_id, l_orderkey AS sid, l_returnflag = 'R' AS is_pre FROM lineitem)"""
FOREST = """forest AS MATERIALIZED (SELECT o_orderkey % 25 AS skel_id, o_orderkey AS sid, CASE WHEN i = 0 THEN NULL WHEN i % 40 = 0 THEN i // 3 ELSE i - 1 END * 25 + o_orderkey % 25 AS parent, 200 + i % 97 AS w FROM (SELECT o_orderkey, o_orderkey // 25 AS i FROM orders)),
fdown AS (SELECT skel_id, sid, 0 AS hops, CAST(0 AS BIGINT) AS dist FROM forest WHERE parent IS NULL UNION ALL SELECT f.skel_id, f.sid, d.hops + 1, d.dist + f.w FROM fdown d JOIN forest f ON f.skel_id = d.skel_id AND f.parent = d.sid)"""
CLOSURE = TREE + """,
up AS (SELECT skel_id, sid, sid AS anc, 0 AS hops, CAST(0 AS BIGINT) AS dist, parent, w FROM tree
  UNION ALL SELECT u.skel_id, u.sid, t.sid, u.hops + 1, u.dist + u.w, t.parent, t.w FROM up u JOIN tree t ON u.skel_id = t.skel_id AND u.parent = t.sid),
closure AS MATERIALIZED (SELECT skel_id, sid, anc, hops, dist FROM up),
kids AS (SELECT skel_id, parent AS sid, count(*) AS n FROM tree WHERE parent IS NOT NULL GROUP BY skel_id, parent),
forks AS (SELECT skel_id, sid FROM kids WHERE n > 1),
tips AS (SELECT skel_id, sid FROM tree WHERE sid NOT IN (SELECT parent FROM tree WHERE parent IS NOT NULL)),
toroot AS (SELECT skel_id, sid, max(hops) AS hops, max(dist) AS dist FROM closure GROUP BY skel_id, sid)"""
MAP = """m2s AS MATERIALIZED (SELECT CAST(0 AS BIGINT) AS mesh_id, o_orderkey * 3 + i AS vid, CASE WHEN (o_orderkey * 3 + i) % 11 <> 0 THEN o_orderkey END AS sid FROM orders, unnest([0, 1, 2]) AS t(i))"""
EVENT_POINTS = """ep AS MATERIALIZED (SELECT event_id % 10 AS mesh_id, event_id AS pid, event_id * 7919 % 4001 - 2000 AS px, event_id * 104729 % 4001 - 2000 AS py, event_id * 1299709 % 4001 - 2000 AS pz FROM events)"""
