"""Exact top-k inner-product search by ball-tree branch and bound per shard.

Vectors are dealt into shards by a hash of their id; each shard gets a ball
tree. A query descends it from the root, keeping the nodes whose upper bound
q.c + |q| r reaches its current k-th score, and visits the leaves in the order
of their bounds, so that the k-th score rises early. The first k-th score
comes from a probe: a bounded block of PROBE vectors (the smallest hashes of
the ids), scored against all queries before; every shard starts from it.
Queries are dealt into blocks; each task joins one block with one shard. A
shard returns at most k rows per query, ranked by a last window per query.

Defined cases: null vectors and vectors with null or non-finite components
take no part; an inner product needs vectors of equal length, others are no
candidates; ties go to the smaller id; rows that repeat an id are candidates
each (no row of the query's own id is one); a score beyond the range of a long
is held at its end; no candidates: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEAF = 128
PROBE = 2048
SHARD_ROWS = 16_384
BLOCK_ROWS = 8_192


class Ball:
    __slots__ = ("centre", "children", "radius", "rows")

    def __init__(self, centre, radius, rows, children):
        self.centre, self.radius, self.rows, self.children = centre, radius, rows, children


def build(x: np.ndarray, rows: np.ndarray) -> Ball:
    """Split at the median along the line between two far points."""
    own = x[rows]
    centre = own.mean(0)
    away = ((own - centre) ** 2).sum(1)
    radius = float(np.sqrt(away.max()))
    if len(rows) <= LEAF or radius == 0:
        return Ball(centre, radius, rows, ())
    a = own[away.argmax()]
    b = own[((own - a) ** 2).sum(1).argmax()]
    order = np.argsort((own - centre) @ (b - a), kind="stable")
    half = len(rows) // 2
    return Ball(centre, radius, None, (build(x, rows[order[:half]]), build(x, rows[order[half:]])))


def _exact(x: np.ndarray) -> np.ndarray:
    """As a type in which inner products are exact: doubles, 64-bit or Python integers."""
    top = float(np.abs(x).max(initial=0))
    if top * top * x.shape[1] < 2**52:
        return x.astype(np.float64)
    return x.astype(np.int64) if top * top * x.shape[1] < 2**62 else x.astype(object)


def merge(best: np.ndarray, ids: np.ndarray, scores: np.ndarray, new: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of kept (best, ids) and new ones, by score down, then id up. Empty places have id -1."""
    s, i = np.concatenate([best, scores], 1), np.concatenate([ids, new], 1)
    order = np.lexsort((i, -s, i < 0), axis=1)[:, :k]
    return np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def search(x: np.ndarray, ids: np.ndarray, q: np.ndarray, qids: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each query's k best rows of x (scores, positions; -1: none). floor: a score that its final k-th reaches in any case."""
    n = len(q)
    best, place = np.zeros((n, k), x.dtype), np.full((n, k), -1)
    kth = floor.astype(np.float64).copy()
    xf, qf = x.astype(np.float64), q.astype(np.float64)
    order = np.argsort(ids, kind="stable")  # positions in id order, so that a smaller position breaks ties
    xf, x, ids = xf[order], x[order], ids[order]
    norm = np.sqrt((qf**2).sum(1))
    slack = 1e-6 * (1 + norm)
    leaves: list[Ball] = []
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    level = [(build(xf, np.arange(len(xf))), np.arange(n))] if len(xf) else []
    while level:
        below = []
        for node, who in level:
            bound = qf[who] @ node.centre + norm[who] * node.radius
            bound += slack[who] * (1 + np.abs(bound))
            live = bound >= kth[who]
            who, bound = who[live], bound[live]
            if not len(who):
                continue
            if node.children:
                below += [(c, who) for c in node.children]
            else:
                pairs.append((who, bound))
                leaves.append(node)
        level = below
    if not pairs:
        return best, place
    who, bound = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    leaf = np.repeat(np.arange(len(leaves)), [len(p[0]) for p in pairs])
    turn = np.lexsort((leaf, -bound, who))
    who, bound, leaf = who[turn], bound[turn], leaf[turn]
    turn = np.arange(len(who)) - np.searchsorted(who, who)  # a query's first, second, ... leaf
    for r in range(int(turn.max()) + 1):
        now = np.flatnonzero((turn == r) & (bound >= kth[who]))
        now = now[np.argsort(leaf[now], kind="stable")]
        for part in np.split(now, np.flatnonzero(np.diff(leaf[now])) + 1) if len(now) else []:
            w, rows = who[part], leaves[leaf[part[0]]].rows
            scores = q[w] @ x[rows].T
            new = np.broadcast_to(rows, scores.shape).copy()
            new[(ids[rows][None, :] == qids[w][:, None]) | (scores < kth[w][:, None])] = -1
            best[w], place[w] = merge(best[w], place[w], scores, new, k)
            full = place[w, -1] >= 0
            kth[w[full]] = np.maximum(kth[w[full]], best[w[full], -1].astype(np.float64))
    place = np.where(place >= 0, order[place], -1)
    return best, place


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()) if len(column) else np.empty((0, 1), np.int64)


def quantised(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(id, v array<long>, dim) of the vectors that take part."""
    whole = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.filter(F.col(key).isNotNull() & whole).select(
        F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v"), F.size(vector).alias("dim")
    )


def top_k(df: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), the candidate's id as `key`, score."""
    all_ = quantised(df, key, vector, scale)
    queries = all_.filter(F.col("id") % every == 0)
    n, m = all_.agg(F.count("*"), F.count_if(F.col("id") % every == 0)).first()
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-m // BLOCK_ROWS))
    probe = [tuple(r) for r in all_.orderBy(F.xxhash64("id", "v")).limit(PROBE).select("id", "v").collect()]
    held = df.sparkSession.sparkContext.broadcast(probe)

    def floors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = {}
        for i, v in held.value:
            by.setdefault(len(v), []).append((i, v))
        for b in batches:
            out = np.full(len(b), -np.inf)
            for dim, at in b.groupby("dim").indices.items():
                if dim in by and dim:
                    ids = np.array([i for i, _ in by[dim]])
                    both = _exact(np.concatenate([_matrix(b["v"].iloc[at]), np.array([v for _, v in by[dim]], np.int64)]))
                    s = (both[: len(at)] @ both[len(at) :].T).astype(np.float64)
                    s[b["id"].to_numpy()[at][:, None] == ids[None, :]] = -np.inf
                    if s.shape[1] >= k:
                        out[at] = np.sort(s, axis=1)[:, -k]
            yield b.assign(floor=out)

    asked = queries.mapInPandas(floors, "id long, v array<bigint>, dim int, floor double")
    number = F.row_number
    asked = asked.withColumns({"block": F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int"), "shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))})
    there = all_.withColumns({"shard": F.pmod(F.xxhash64("id", F.lit(2)), F.lit(shards)).cast("int"), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})

    def joined(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "cand": [], "score": []}).astype("int64")
        if not int(q["dim"].iloc[0]):
            both = np.zeros((len(q) + len(c), 1))
        else:
            both = _exact(np.concatenate([_matrix(q["v"]), _matrix(c["v"])]))
        ids, qids = c["id"].to_numpy(), q["id"].to_numpy()
        score, place = search(both[len(q) :], ids, both[: len(q)], qids, q["floor"].to_numpy(), k)
        w, j = np.nonzero(place >= 0)
        return pd.DataFrame({"query_id": qids[w], "cand": ids[place[w, j]], "score": np.clip(score[w, j], -(2**63), 2**63 - 1).astype(np.int64) if score.dtype == object else score[w, j].astype(np.int64)})

    on = ("block", "shard", "dim")
    found = asked.groupBy(*on).cogroup(there.groupBy(*on)).applyInPandas(joined, "query_id long, cand long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "cand")
    return found.withColumn("rank", number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("cand").alias(key), "score")


def op5_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
