"""Near duplicates by DartMinHash signatures, banded joining and an exact check.

Elements are a text's distinct shingles of five words (of all its words, where
it has fewer), each of weight 1 however often it occurs, as in the exact check
below. Every element owns the
same Poisson process of darts in the plane of weight and rank for all texts:
the plane is cut into dyadic regions, a hash of (element, region) draws the
number of darts and their places. A text collects the darts under its weights
with rank below t / (its total weight), about t in all whatever its length;
a dart's hash gives its coordinate and the earliest dart of each coordinate is
the signature. Texts with an empty coordinate are thrown at with 2 t. Two
signatures agree in a coordinate with the Jaccard similarity of the sets.

Signatures are cut into BANDS bands of ROWS coordinates: at similarity 0.8 a
pair misses all bands with probability 4e-7. Equal texts are one node from the
start. Within a bucket (texts that agree in a band) members are compared with
the bucket's most ordinary member, on their exact sets of shingles; links join texts
of Jaccard similarity 0.8 or more. Then components: the members of buckets that
still hold several components are joined on the rarest elements of their sets
(a prefix filter, which loses no pair of that similarity), across components
only. So a bucket of copies costs its size, not its square, and no link within
a bucket that could join two classes is left out. No rows of a group meet in one task: it
is all joins and partial aggregates, and class numbers come from large-star /
small-star rounds on the links.

Defined cases: a null text is in a class of its own; equal texts are one class
even if they have no words; other texts without words have no near copy;
repeated rows are copies of each other; the class id is the least doc_id of
the class (null where all are null); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators.tables import cut as cut_round
from .common import any_names, bitmap, cut, free_name, maybe_in, slices
from .textscan import ALNUM, first_of_doc, grams, mix, scan

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 28, 4
K = BANDS * ROWS
DARTS = 8 * K
SKETCH, SKETCH_ROWS = 1 << 20, 256
_FIRST_RANK = 0.5
_TOP = 2.0**-64


def shingles(texts: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, int]:
    """Shingle hashes and the row of each."""
    words = scan(texts, ALNUM)
    hashes, first = grams(words, n)
    doc = words.doc[first]
    at = first_of_doc(words)
    short = np.flatnonzero((np.diff(at) > 0) & (np.diff(at) < n))
    if len(short):
        own = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            have = at[short] + k < at[short + 1]
            own[have] = mix(own[have] + words.hashes[at[short[have]] + k], 77)
        hashes, doc = np.concatenate([hashes, own]), np.concatenate([doc, short])
    return hashes, doc, words.n_docs


def elements(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Distinct shingles (hashes of 48 bits) of each row in the order of rows, their rows and weights."""
    hashes, doc, n = shingles(texts)
    hashes = hashes >> np.uint64(16)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return hashes[at], doc[at], np.ones(len(at)), n


def _poisson(u: np.ndarray, mean: float) -> np.ndarray:
    """Numbers of darts by inversion of the uniform u."""
    top = int(mean + 12 * mean**0.5 + 25)
    k = np.arange(top)
    log = k * np.log(mean) - mean - np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, top)))])
    return np.searchsorted(np.cumsum(np.exp(log)), u)


def darts(element: np.ndarray, doc: np.ndarray, weight: np.ndarray, max_rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, ranks and hashes of all darts under the elements' weights with rank below their row's max_rank."""
    rows, ranks, ids = [], [], []
    if not len(element):
        return np.empty(0, np.int64), np.empty(0), np.empty(0, np.uint64)
    limit = max_rank[doc]
    for a in range(int(np.log2(weight.max() + 1)) + 2):
        low_w, wide = 2.0**a - 1, 2.0**a
        heavy = np.flatnonzero(weight > low_w)
        if not len(heavy):
            break
        low_r, b = 0.0, 0
        while True:
            high_r = _FIRST_RANK * 2.0**b
            own = heavy[limit[heavy] > low_r]
            if not len(own):
                break
            seed = mix(element[own], 1000 + 64 * a + b)
            n = _poisson(seed * _TOP, wide * (high_r - low_r))
            at = np.repeat(own, n)
            j = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            h = mix(np.repeat(seed, n) + j.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 1)
            rank = low_r + (high_r - low_r) * ((h >> np.uint64(32)) * 2.0**-32)
            w = low_w + wide * ((h & np.uint64(0xFFFFFFFF)) * 2.0**-32)
            under = np.flatnonzero((w < weight[at]) & (rank < limit[at]))
            rows.append(doc[at[under]])
            ranks.append(rank[under])
            ids.append(h[under])
            low_r, b = high_r, b + 1
    return np.concatenate(rows), np.concatenate(ranks), np.concatenate(ids)


def signatures(element: np.ndarray, doc: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n x K signatures of the rows' elements, and which rows have one (a text without words has none)."""
    total = np.bincount(doc, weights=weight, minlength=n)
    out = np.zeros((n, K), np.uint64)
    todo = total > 0
    t = float(DARTS)
    while todo.any():
        use = todo[doc]
        max_rank = np.where(todo, t / np.maximum(total, 1e-9), 0)
        row, rank, h = darts(element[use], doc[use], weight[use], max_rank)
        cell = row * K + (mix(h, 2) % np.uint64(K)).astype(np.int64)
        packed = rank.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | np.arange(len(h), dtype=np.uint64)
        best = np.full(n * K, np.iinfo(np.uint64).max)
        np.minimum.at(best, cell, packed)
        best = best.reshape(n, K)
        full = todo & (best != np.iinfo(np.uint64).max).all(1)
        out[full] = h[(best[full] & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        todo &= ~full
        t *= 2
    return out, total > 0


def band_keys(signature: np.ndarray) -> np.ndarray:
    """n x BANDS hashes of the bands."""
    part = signature.reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), part.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key + part[:, :, r], 5)
    return key


def node(text: Column) -> Column:
    """A text's identity: 16 bytes; null for a null text."""
    return F.unhex(F.md5(text.cast("binary")))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of all nodes of the links (a, b); root is the least node of the component. Large-star, small-star."""
    edges = cut_round(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    for _ in range(rounds):
        ends = edges.select(F.col("b").alias("n"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionAll(edges.select(F.col("a").alias("n"), F.lit(0), F.lit(1)))
        if ends.groupBy("n").agg(F.sum("below").alias("below"), F.max("above").alias("above")).filter("below > 1 or below + above > 1").isEmpty():
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))  # all are stars
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("b"), F.col("m").alias("a"))
        small = large.join(large.groupBy("b").agg(F.min("a").alias("m")), "b")
        edges = cut_round(small.select(F.col("m").alias("a"), "b").unionAll(small.select(F.col("m").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    raise RuntimeError("components did not settle")


def pack_set(x: np.ndarray) -> bytes:
    """Ascending elements of 48 bits: their number and the bytes of their differences, plane by plane, compressed."""
    delta = np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)[:, :6]
    return len(x).to_bytes(4, "little") + pa.compress(np.ascontiguousarray(delta.T).tobytes(), codec="zstd", asbytes=True)


def unpack_set(blob) -> np.ndarray:
    blob = memoryview(blob.as_buffer() if isinstance(blob, pa.Scalar) else blob)
    n = int.from_bytes(blob[:4], "little")
    planes = np.frombuffer(pa.decompress(pa.py_buffer(blob[4:]), decompressed_size=6 * n, codec="zstd"), np.uint8)
    delta = np.zeros((n, 8), np.uint8)
    delta[:, :6] = planes.reshape(6, n).T
    return np.cumsum(delta.view(np.uint64).ravel(), dtype=np.uint64)


def _similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of at least threshold."""
    second = pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    both = second.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a").select("a", "b", "set_a", "set_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, None
        for batch in batches:
            keep = []
            for a, set_a, set_b in zip(batch.column("a").to_pylist(), batch.column("set_a"), batch.column("set_b"), strict=True):
                if a != last:  # rows come in the order of a
                    last, x = a, unpack_set(set_a)
                y = unpack_set(set_b)
                if min(len(x), len(y)) < threshold * max(len(x), len(y)):
                    keep.append(False)
                    continue
                common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(common >= threshold * (len(x) + len(y) - common) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(check, "a binary, b binary")


def _occurrences(sets: DataFrame) -> np.ndarray:
    """How often elements occur in the sets, in a table of SKETCH hashed counters (its size doesn't depend on the input)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for x in batch.column("set"):
                np.add.at(total, _counter(unpack_set(x)), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["at", "n"])

    rows = sets.select("set").mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n"))
    rows = rows.groupBy((F.col("at") % SKETCH_ROWS).alias("part")).agg(F.collect_list("at").alias("at"), F.collect_list("n").alias("n"))
    out = np.zeros(SKETCH, np.int32)
    for r in rows.toLocalIterator():
        out[np.array(r["at"])] = np.minimum(np.array(r["n"]), 2**31 - 1)
    return out


def _counter(elements_: np.ndarray) -> np.ndarray:
    return (elements_ % np.uint64(SKETCH)).astype(np.int64)


def _prefix_pairs(sets: DataFrame, counts, threshold: float) -> DataFrame:
    """Pairs (a, b) of (node, set, root) with different roots that may reach the threshold: all that do are among them.

    Two sets of that similarity share one of their first |s| - ceil(threshold |s|) + 1
    elements in any order of all elements. The order is by occurrences, so that
    what many texts share, such as passages, comes last and pairs nobody by
    itself. Elements before the first shared one are in one set only, which
    bounds what the sets can have in common.
    """

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, rest = [], []
            for x in batch.column("set"):
                x = unpack_set(x)
                n = len(x) - int(np.ceil(threshold * len(x) - 1e-9)) + 1
                first.append(x[np.lexsort((x, counts.value[_counter(x)]))[:n]].view(np.int64))
                rest.append(len(x) - np.arange(n))
            at = pa.array(np.repeat(np.arange(len(first)), [len(f) for f in first]))
            size = pa.array([r[0] for r in rest], pa.int64())
            flat = [pa.array(np.concatenate(x) if x else np.empty(0, np.int64)) for x in (first, rest)]
            yield pa.RecordBatch.from_arrays([*flat, size.take(at), batch.column("node").take(at), batch.column("root").take(at)], names=["element", "rest", "size", "node", "root"])

    first = cut(sets.select("node", "root", "set").mapInArrow(prefix, "element long, rest long, size long, node binary, root binary"))
    groups = first.groupBy("element").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most").drop("most")
    found = first.join(groups, "element")
    apart = found.filter("root <> least").select("element", F.col("node").alias("a"), F.col("root").alias("root_a"), F.col("size").alias("size_a"), F.col("rest").alias("rest_a"))
    others = found.select("element", F.col("node").alias("b"), F.col("root").alias("root_b"), F.col("size").alias("size_b"), F.col("rest").alias("rest_b"))
    common = (F.col("size_a") + F.col("size_b")) * F.lit(threshold / (1 + threshold)) - 1e-6
    near = F.least("rest_a", "rest_b") >= common
    return apart.join(others, "element").filter((F.col("root_a") != F.col("root_b")) & near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def find_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(key, node of its text) of each row of docs, and (node, root) of the nodes that are linked to others; a null text has no node. Both cheap to read again."""
    source = docs.select(F.col(key).alias("__key"), node(F.col(text)).alias("node"), F.col(text).alias("__text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__text", 1 << 20):
                element, doc, weight, n = elements(batch.column("__text"))
                signature, has = signatures(element, doc, weight, n)
                keys, at = band_keys(signature), np.searchsorted(doc, np.arange(n + 1))
                bands = [k.tobytes() if h else None for k, h in zip(keys, has, strict=True)]
                sets = [pack_set(element[at[i] : at[i + 1]]) if h else None for i, h in enumerate(has)]
                yield pa.RecordBatch.from_arrays([batch.column("__key"), batch.column("node"), pa.array(bands, pa.binary()), pa.array(sets, pa.binary())], names=["key", "node", "bands", "set"])

    kind = docs.schema[key].dataType.simpleString()
    signed = cut(source.mapInArrow(sign, f"key {kind}, node binary, bands binary, set binary"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64)
            at = pa.array(np.repeat(np.arange(batch.num_rows), BANDS))
            yield pa.RecordBatch.from_arrays([pa.array(bands), batch.column("node").take(at)], names=["bucket", "node"])

    nodes = signed.filter("bands is not null").groupBy("node").agg(F.first("bands").alias("bands")).select("bands", "node")
    buckets = nodes.mapInArrow(unpack, "bucket long, node binary")
    several = buckets.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = cut(buckets.join(several, "bucket"))
    # a bucket's head is its member with the most neighbours over all its buckets: what the others were made from, if they are copies
    central = members.groupBy("node").agg(F.sum("n").alias("near"))
    heads = members.join(central, "node").groupBy("bucket").agg(F.max(F.struct("near", "node")).alias("head")).select("bucket", F.col("head.node").alias("a"))
    pairs = cut(members.select("bucket", F.col("node").alias("b")).join(heads, "bucket").filter("a <> b").select("a", "b").distinct())
    wanted = maybe_in(signed.filter("set is not null").select("node", "set"), F.col("node"), bitmap(members, F.col("node")), "hit").filter("hit")
    sets = cut(wanted.groupBy("node").agg(F.first("set").alias("set")))
    links = cut(_similar(pairs, sets, threshold))
    roots = components(links)
    placed = members.select("bucket", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("bucket")
    open_ = cut(placed.join(mixed, "bucket", "left_semi").select("node", "root").distinct())
    if not open_.isEmpty():
        apart = cut(sets.join(open_, "node"))
        counts = docs.sparkSession.sparkContext.broadcast(_occurrences(apart))
        extra = cut(_similar(_prefix_pairs(apart, counts, threshold), sets, threshold))
        counts.destroy()
        if not extra.isEmpty():  # links between roots, and the roots' roots
            up = open_.select("node", "root")
            between = extra.join(up.toDF("a", "x"), "a").join(up.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
            above = components(between).toDF("root", "top")
            known = roots.unionAll(roots.select(F.col("root").alias("node"), "root")).unionAll(open_).distinct()
            roots = cut(known.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
    return signed.select("key", "node"), roots


def _named(found: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, least key, rows, root) of all nodes; (root, least of (key is null, key, node), rows) of all classes."""
    least = F.min(F.struct(F.col("key").isNull().alias("no_key"), "key", "node"))
    per = found.filter("node is not null").groupBy("node").agg(least.alias("k"), F.count("*").alias("n")).join(roots, "node", "left")
    per = cut(per.withColumn("root", F.coalesce("root", "node")))
    return per, cut(per.groupBy("root").agg(F.min("k").alias("k"), F.sum("n").alias("n")))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: key, class_id (the least key of its class), class_size."""
    found, roots = find_classes(docs, key, text, threshold)
    class_id, size = free_name([key], "class_id"), free_name([key], "class_size")
    per, classes = _named(found, roots)
    named = cut(per.select("node", "root").join(classes, "root").select("node", F.col("k.key").alias("least"), F.col("n")))
    joined = found.join(named, "node", "left")
    return joined.select(F.col("key").alias(key), F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("least")).alias(class_id), F.coalesce("n", F.lit(1)).cast("long").alias(size))


@any_names("key", "text")
def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each class, that of the least key (null last) and node; rows without a text stay.

    Most rows are not dropped: a bitmap of those that are lets the others pass
    without a shuffle, and the exact join decides about the rest.
    """
    found, roots = find_classes(docs, key, text, threshold)
    per, classes = _named(found, roots)
    kept = classes.select(F.col("k.key").alias("key"), F.col("k.node").alias("node"))
    counted = found.filter("node is not null").groupBy("key", "node").agg(F.count("*").alias("n")).alias("f")
    same = F.col("f.key").eqNullSafe(F.col("k.key")) & (F.col("f.node") == F.col("k.node"))
    told = counted.join(kept.withColumn("kept", F.lit(True)).alias("k"), same, "left").select("f.key", "f.node", "n", "kept")
    told = cut(told.filter("kept is null or n > 1"))  # rows to drop, and rows that repeat with their key
    own, hit = free_name(docs.columns, "__own"), free_name([*docs.columns, "__own"], "__hit")
    marked = maybe_in(docs.withColumn(own, node(F.col(text))), F.col(own), bitmap(told, F.col("node")), hit)
    sure = marked.filter(~F.col(hit) | F.col(own).isNull()).select(*docs.columns)
    rest = marked.filter(F.col(hit) & F.col(own).isNotNull()).alias("d")
    one, keep = free_name(docs.columns, "__n"), free_name(docs.columns, "__kept")
    judged = rest.join(told.select("key", "node", "n", F.coalesce("kept", F.lit(False)).alias(keep)).alias("t"), F.col(f"d.{own}").eqNullSafe(F.col("t.node")) & F.col(f"d.{key}").eqNullSafe(F.col("t.key")), "left")
    judged = judged.select(*[F.col(f"d.{c}").alias(c) for c in docs.columns], F.col("t.n").alias(one), F.col(f"t.{keep}").alias(keep), F.col(f"d.{own}").alias(own))
    single = judged.filter(F.col(keep).isNull()).select(*docs.columns)
    out = sure.unionByName(single)
    if told.filter("kept and n > 1").isEmpty():
        return out
    repeated = judged.filter(F.col(keep))
    order = Window.partitionBy(key, own).orderBy(*[F.col(c) for c in sorted(docs.columns) if not isinstance(docs.schema[c].dataType, (T.MapType, T.VariantType))])
    return out.unionByName(repeated.withColumn(one, F.row_number().over(order)).filter(F.col(one) == 1).select(*docs.columns))


def op4_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
