"""Near-duplicate vectors by sorted projection passes, and exact numbers of links.

Vectors of equal label and length are linked if their cosine reaches the
threshold. Equal vectors are one node from the start.

1. Passes. A pass hashes every vector by the signs of BITS random projections,
   sorts by label, length and the hashes in a row as one number, and compares each
   node with the WINDOW nodes after it, in double precision. Rows are sorted in
   ranges; the first and last rows of each range, a small table, are sorted and
   compared once more, so that ranges hide nothing. A pass hands on one link a
   node at most: to the least node of its chain of links nearby.
2. Number of passes. Two vectors at the threshold agree in a bit with
   probability q = 1 - acos(threshold) / pi. A bucket of a group of n nodes is as
   small as a window after b = log2(n / WINDOW) bits (SLACK more for uneven
   ones), so a pass sees them with probability q^b, and as many passes run as
   keep the probability that all miss them at MISS or less: it grows with
   n^0.19. Nearer pairs are missed far less often. Nothing depends on the
   table's size otherwise.
3. Union. Links of all passes make components by large-star/small-star rounds.
4. Links are counted among all members of a component, whatever the windows saw. A
   component of up to TILE nodes is one product of matrices. A larger one is
   laid around its mean direction: two members whose angles to it add up to the
   threshold's angle at most are linked for certain, two whose angles differ by
   more are not, and numbers of the first come from a histogram of the angles (in
   BINS steps, rounded to the safe side). What is left, which for copies of one
   vector is nothing, is compared in tiles of two blocks of about TILE nodes,
   cut along the angle, of which those that the bounds decide are not made. So
   the cost of a group of near copies is its size; only a loose component of n
   nodes takes up to n / TILE copies of a row.

Defined cases: a vector that is null, empty, zero or holds null or non-finite
entries links with nothing, and so does one whose label is null; a vector of
other length isn't compared; entries may be of any size. Every row counts as a
vector of its own, also when its id repeats; ties don't arise. A null id is
never a component's id while there is another one; kept is true for a row whose
id is its component's (null included). An empty table gives an empty result.
Further columns of df are not read; a result named like the key gets a trailing
underscore.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, quoted
from .near_duplicates import components
from .vectors import edges, packed, ragged, unit, whole_groups

THRESHOLD = 0.93
WINDOW, BITS, SLACK, MISS = 32, 63, 2, 1e-4
PASSES_AT_ONCE, ROWS_AT_ONCE, RANGE_ROWS, BORDER_ROWS = 4, 4_000_000, 200_000, 50_000
TILE, BINS = 512, 4096
ORDER = ["turn", "label", "size", "bits", "node"]


def passes_for(n: int, threshold: float, window: int, miss: float) -> int:
    """How many passes see a pair at the threshold, in a group of n, but for a probability of miss."""
    if n <= window + 1:
        return 1
    seen = (1 - math.acos(threshold) / math.pi) ** (math.log2(n / window) + SLACK)
    return max(1, math.ceil(math.log(miss) / math.log1p(-seen)))


def nodes_of(df: DataFrame, key: str, vector: str, label: str) -> tuple[DataFrame, DataFrame, str]:
    """(key, node) of all rows, node null where the row links with nothing; (node, label, vec, size, rows, least) of the distinct vectors; the entries' type."""
    single = df.schema[vector].dataType.simpleString() == "array<float>"
    kind = "<f4" if single else "<f8"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, first, size, ok = ragged(b.column("vec"))
            values = values.astype(kind) + 0.0  # -0.0 is 0.0
            ok &= b.column("label").is_valid().to_numpy(zero_copy_only=False) & (size > 0)
            other = np.concatenate([[0], np.cumsum(values != 0)])
            ok &= other[first + size] > other[first]
            raw, node = [None] * len(ok), [None] * len(ok)
            labels = b.column("label")
            for i in np.flatnonzero(ok):
                raw[i] = values[first[i] : first[i] + size[i]].tobytes()
                node[i] = hashlib.md5(labels[i].as_py().encode() + b"\0" + raw[i]).digest()
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(node, pa.binary()), b.column("label"), pa.array(raw, pa.binary())], names=["key", "node", "label", "vec"])

    rows = df.select(quoted([key])[0].alias("key"), quoted([label])[0].cast("string").alias("label"), quoted([vector])[0].cast("array<float>" if single else "array<double>").alias("vec"))
    signed = cut(rows.mapInArrow(pack, f"key {rows.schema['key'].dataType.simpleString()}, node binary, label string, vec binary"))
    same = signed.filter("node is not null").groupBy("node")
    nodes = cut(same.agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.count("*").alias("rows"), F.min("key").alias("least")).withColumn("size", F.octet_length("vec")))
    return signed.select("key", "node"), nodes, kind


def chains(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least of the numbers 0..n-1 that each is linked to through links (i, j)."""
    least = np.arange(n)
    while len(i):
        np.minimum.at(least, np.maximum(least[i], least[j]), np.minimum(least[i], least[j]))
        while (least[least] != least).any():
            least = least[least]
        open_ = least[i] != least[j]
        i, j = i[open_], j[open_]
    return least


def _windows(kind: str, window: int, threshold: float):
    """Compare a sorted stream's rows with those in reach; gives links (node, other) and the rows at the stream's ends (other is null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("turn", pa.int32()), ("label", pa.string()), ("size", pa.int32()), ("bits", pa.int64()), ("node", pa.binary()), ("vec", pa.binary()), ("other", pa.binary())])
        head, tail, seen = [], None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = pa.RecordBatch.from_arrays([batch.column(c).cast(schema.field(c).type) for c in schema.names[:-1]], names=schema.names[:-1])
            if seen < window:
                head.append(batch.slice(0, window - seen))
            seen += batch.num_rows
            table = pa.Table.from_batches([*(tail.to_batches() if tail is not None else []), batch]).combine_chunks()
            at = edges(table, ["turn", "label", "size"])
            node = table.column("node").combine_chunks()
            for a, b in zip(at[:-1], at[1:], strict=True):
                u = unit(packed(table.column("vec").slice(a, b - a).combine_chunks(), kind))
                i, j = [], []
                for d in range(1, min(window, b - a - 1) + 1):
                    hit = np.flatnonzero(np.einsum("ij,ij->i", u[:-d], u[d:]) >= threshold)
                    i.append(hit)
                    j.append(hit + d)
                if i and sum(map(len, i)):
                    least = chains(b - a, np.concatenate(i), np.concatenate(j))
                    moved = np.flatnonzero(least != np.arange(b - a))
                    empty = {f.name: pa.nulls(len(moved), f.type) for f in schema}
                    yield pa.RecordBatch.from_pydict(empty | {"node": node.take(pa.array(moved + a)), "other": node.take(pa.array(least[moved] + a))}, schema)
            tail = table.slice(max(0, table.num_rows - window))
        if seen:
            ends = [*head, *tail.slice(max(0, tail.num_rows - max(0, seen - window))).to_batches()]
            for b in ends:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(b.num_rows, pa.binary())], schema=schema)

    return run


WINDOWED = "turn int, label string, size int, bits long, node binary, vec binary, other binary"


def pass_links(nodes: DataFrame, turns: range, kind: str, window: int, threshold: float, seed: int, count: int) -> list[DataFrame]:
    """Links (a, b) that the passes of these turns find; count: rows of nodes."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            size = b.column("size").to_numpy()
            vec = b.column("vec")
            units = {s: (rows := np.flatnonzero(size == s), unit(packed(vec.take(pa.array(rows)), kind))) for s in np.unique(size)}
            for t in turns:
                bits = np.zeros(b.num_rows, np.int64)
                for s, (rows, u) in units.items():
                    if (t, s) not in planes:
                        planes[t, s] = np.random.default_rng([seed, t, int(s)]).standard_normal((u.shape[1], BITS))
                    bits[rows] = (u @ planes[t, s] > 0) @ (1 << np.arange(BITS - 1, -1, -1))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, t), pa.int32()), b.column("label"), b.column("size"), pa.array(bits), b.column("node"), vec], names=["turn", "label", "size", "bits", "node", "vec"])

    rows, n, found = nodes.select("label", "size", "node", "vec").mapInArrow(keyed, WINDOWED.removesuffix(", other binary")), count * len(turns), []
    ranges = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE_ROWS))
    while True:
        # once few rows are left, one range holds them all and hides no pair
        ordered = rows.repartitionByRange(ranges, *ORDER) if ranges > 1 else rows.repartition(1)
        out = cut(ordered.sortWithinPartitions(*ORDER).mapInArrow(_windows(kind, window, threshold), WINDOWED))
        found.append(out.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
        if ranges == 1:
            return found
        rows, n = out.filter("other is null").drop("other"), 2 * window * ranges
        ranges = 1 if n <= BORDER_ROWS else max(2, -(-n // RANGE_ROWS))


def _whole(kind: str, threshold: float):
    """Links of each node of components that fit in one product."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(batches, ["root"]):
            rows = table.column("rows").to_numpy()
            out = np.zeros(len(rows), np.int64)
            vec = table.column("vec").combine_chunks()
            for a, b in zip(at[:-1], at[1:], strict=True):
                u = unit(packed(vec.slice(a, b - a), kind))
                near = u @ u.T >= threshold
                np.fill_diagonal(near, True)
                out[a:b] = near @ rows[a:b] - 1
            yield pa.RecordBatch.from_arrays([table.column("node").combine_chunks(), pa.array(out)], names=["node", "n"])

    return run


def _layout(threshold_bins: int, tile: int):
    """From a component's histogram (bin, weight, nodes): what is certain in each bin, its blocks, and the blocks they have to meet."""
    top = threshold_bins - 2

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        bins, nodes = pdf["bin"].to_numpy(), pdf["nodes"].to_numpy()
        sums = np.concatenate([[0], np.cumsum(pdf["weight"].to_numpy())])
        first, many, low, high, room = np.zeros(len(bins), np.int64), np.ones(len(bins), np.int64), [], [], 0
        for i, (b, c) in enumerate(zip(bins, nodes, strict=True)):
            if c > room:
                k = max(1, -(-int(c) // tile))
                first[i], many[i], room = len(low), k, tile - int(c) if k == 1 else 0
                low += [b] * k
                high += [b] * k
            else:
                first[i], room = len(low) - 1, room - int(c)
                high[-1] = b
        low, high = np.array(low), np.array(high)
        mine_low, mine_high = low[first], high[first]
        begin = np.maximum(np.searchsorted(high, top - mine_high, "right"), np.searchsorted(high, mine_low - top - 3, "left"))
        end = np.searchsorted(low, mine_high + top + 3, "right") - 1
        return pd.DataFrame({"root": pdf["root"], "bin": bins, "certain": sums[np.searchsorted(bins, top - bins, "right")], "first": first, "many": many, "begin": begin, "end": end})

    return run


def _large(members: DataFrame, kind: str, threshold: float, tile: int) -> DataFrame:
    """(node, n) of the members (root, node, vec, rows) of large components."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            order = np.argsort(np.array(b.column("root").to_pylist(), object), kind="stable")
            b = b.take(pa.array(order))
            at = edges(b, ["root"])
            parts = [unit(packed(b.column("vec").slice(i, j - i), kind)).sum(0) for i, j in zip(at[:-1], at[1:], strict=True) if j > i]
            yield pa.RecordBatch.from_arrays([b.column("root").take(pa.array(at[:-1][: len(parts)])), pa.array([p.tolist() for p in parts], pa.list_(pa.float64()))], names=["root", "part"])

    part = members.select("root", "vec").mapInArrow(sums, "root binary, part array<double>").select("root", F.posexplode("part").alias("place", "x")).groupBy("root", "place").agg(F.sum("x").alias("x"))
    centres = part.groupBy("root").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]).alias("centre"))
    step = (math.acos(threshold) - 1e-6) / BINS

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.array([len(x) for x in b.column("vec").to_pylist()])
            out = np.zeros(len(size), np.int32)
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                u, c = unit(packed(b.column("vec").take(pa.array(at)), kind)), unit(np.array(b.column("centre").take(pa.array(at)).to_pylist(), float))
                # the chord gives small angles without loss
                out[at] = np.floor(2 * np.arcsin(np.clip(np.sqrt(((u - c) ** 2).sum(1)) / 2, 0, 1)) / step).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("root"), b.column("node"), b.column("vec"), b.column("rows"), pa.array(out)], names=["root", "node", "vec", "rows", "bin"])

    laid = cut(members.join(centres, "root").select("root", "node", "vec", "rows", "centre").mapInArrow(angles, "root binary, node binary, vec binary, rows long, bin int"))
    hist = laid.groupBy("root", "bin").agg(F.sum("rows").alias("weight"), F.count("*").alias("nodes"))
    plan = hist.groupBy("root").applyInPandas(_layout(BINS, tile), "root binary, bin int, certain long, first long, many long, begin long, end long")
    placed = cut(laid.join(plan, ["root", "bin"]).withColumn("block", F.col("first") + F.pmod(F.xxhash64("node"), F.col("many"))))
    itself = F.when(2 * F.col("bin") <= BINS - 2, -1).otherwise(F.col("rows") - 1)  # in the first case the certain ones hold it, with its copies
    sure = placed.select("node", (F.col("certain") + itself).alias("n"))
    meets = placed.filter("begin <= end").select("root", "node", "vec", "rows", "bin", "block", F.explode(F.sequence("begin", "end")).alias("with"))
    tiles = meets.select("root", F.least("block", "with").alias("p"), F.greatest("block", "with").alias("q"), "block", "node", "vec", "rows", "bin")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(batches, ["root", "p", "q"]):
            rows, bins, block = (table.column(c).to_numpy() for c in ("rows", "bin", "block"))
            p, q = table.column("p").to_numpy(), table.column("q").to_numpy()
            vec, out = table.column("vec").combine_chunks(), np.zeros(len(rows), np.int64)
            for a, b in zip(at[:-1], at[1:], strict=True):
                u, left, right = unit(packed(vec.slice(a, b - a), kind)), np.flatnonzero(block[a:b] == p[a]), np.flatnonzero(block[a:b] == q[a])
                near = (u[left] @ u[right].T >= threshold) & (bins[a:b][left][:, None] + bins[a:b][right][None, :] > BINS - 2)
                if p[a] == q[a]:
                    np.fill_diagonal(near, False)
                    out[a + left] += near @ rows[a + right]
                else:
                    out[a + left] += near @ rows[a + right]
                    out[a + right] += near.T @ rows[a + left]
            hit = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([table.column("node").combine_chunks().take(pa.array(hit)), pa.array(out[hit])], names=["node", "n"])

    more = tiles.repartition("root", "p", "q").sortWithinPartitions("root", "p", "q").mapInArrow(compare, "node binary, n long")
    return sure.unionAll(more).groupBy("node").agg(F.sum("n").alias("n"))


def near_vectors(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, window: int = WINDOW, miss: float = MISS, tile: int = TILE, seed: int = 11
) -> DataFrame:
    """One row per row of df: key, n_links (other vectors linked with it), component_id, kept."""
    signed, nodes, kind = nodes_of(df, key, vector, label)
    count, most = nodes.groupBy("label", "size").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    turns, links = passes_for(most, threshold, window, miss), []
    together = max(PASSES_AT_ONCE, ROWS_AT_ONCE // max(1, count))
    for t in range(0, turns, together):
        links += pass_links(nodes, range(t, min(turns, t + together)), kind, window, threshold, seed, count)
    all_ = links[0]
    for x in links[1:]:
        all_ = all_.unionAll(x)
    roots = components(all_)
    placed = roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
    sizes = placed.groupBy("root").agg(F.count("*").alias("nodes"))
    members = cut(nodes.select("node", "vec", "rows", "least").join(placed, "node").join(sizes, "root"))
    counted = members.filter(F.col("nodes") <= tile).select("root", "node", "vec", "rows").repartition("root").sortWithinPartitions("root").mapInArrow(_whole(kind, threshold), "node binary, n long")
    large = members.filter(F.col("nodes") > tile).select("root", "node", "vec", "rows")
    if not large.isEmpty():
        counted = counted.unionAll(_large(large, kind, threshold, tile))
    least = members.groupBy("root").agg(F.min("least").alias("id"))
    told = members.select("node", "root").join(least, "root").join(counted, "node").select("node", "id", "n")
    copies = nodes.filter("rows > 1").join(members.select("node"), "node", "left_anti").select("node", F.col("least").alias("id"), (F.col("rows") - 1).alias("n"))
    known = cut(told.unionAll(copies))
    found = signed.join(known, "node", "left")
    names = [free_name([key], n) for n in ("n_links", "component_id", "kept")]
    id_ = F.when(F.col("n").isNull(), F.col("key")).otherwise(F.col("id"))
    return found.select(F.col("key").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias(names[0]), id_.alias(names[1]), F.col("key").eqNullSafe(id_).alias(names[2]))


def op11_vector_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP11_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, e.b FROM r JOIN e ON r.other = e.a),
c AS (SELECT vec_id, min(other) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT c.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON n.a = c.vec_id
"""
