"""Benchmark decontamination with training suffix arrays.

The training texts are dealt into shards (a few MB of text of one partition,
so a lost executor only costs its own shards). Each shard's words, with a
separator after every document, get a suffix array by prefix doubling; every
suffix of every benchmark item is binary-searched in it. The two neighbours of
the insertion point give the suffix's longest verbatim match and its location;
the interval that starts with the suffix's first `window` words gives all
occurrences, whose words are hit. There is no shuffle: the benchmark is sent
to every task in blocks of at most BLOCK_WORDS words (or one item), one block at
a time: where there are several, the documents pass once for each, and what one
pass found is written to the shared folder before the next block is read. So
neither the driver nor a task ever holds more than a block.

Words are maximal runs of ASCII digits, letters (A-Z lowered) and non-ASCII
characters. They are compared as 64-bit hashes.

Defined cases: a null or empty text has no words and is clean; an item without
words matches nothing; a null item_id can't be reported and takes no part;
equal items are all reported; documents that repeat are judged each on their
own; very long texts are read whole; no documents give no rows; an empty
benchmark leaves all documents clean; columns of any name are kept, and a
result that would clash with one of them gets a trailing underscore.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import any_names, cut, free_name, slices
from .textscan import ALNUM, first_of_doc, scan

WINDOW = 10
BLOCK_WORDS = 2_000_000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


class Items(NamedTuple):
    """Benchmark words, item after item; word i belongs to item[i], which has words first[item]:first[item + 1]."""

    ids: list[str]
    words: np.ndarray
    item: np.ndarray
    first: np.ndarray


class Shard(NamedTuple):
    """Words of a shard with a separator (0) after each document, and their suffix array."""

    words: np.ndarray
    suffixes: np.ndarray


def items_of(ids: list[str], texts: pa.Array) -> Items:
    found = scan(texts, ALNUM)
    return Items(ids, found.hashes | np.uint64(1), found.doc, first_of_doc(found))


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their first depth words (ties in any order): ranks of 1, 2, 4, ... words."""
    n = len(words)
    order = np.argsort(words)
    done = 1
    rank = np.empty(n, np.int64)
    sorted_ = words[order]
    rank[order] = np.cumsum(np.concatenate([[0], sorted_[1:] != sorted_[:-1]]))
    while done < depth and n and rank[order[-1]] < n - 1:
        key = rank * np.int64(n + 1)
        key[: max(n - done, 0)] += rank[done:] + 1
        order = np.argsort(key)
        sorted_ = key[order]
        rank[order] = np.cumsum(np.concatenate([[0], sorted_[1:] != sorted_[:-1]]))
        done *= 2
    return order


def make_shard(hashes: np.ndarray, doc: np.ndarray, n_docs: int, depth: int) -> tuple[Shard, np.ndarray]:
    """The shard, and the word's index of each of its positions (-1: separator)."""
    counts = np.bincount(doc, minlength=n_docs)
    place = np.arange(len(hashes)) + doc
    words = np.zeros(len(hashes) + n_docs, np.uint64)
    words[place] = hashes | np.uint64(1)
    index = np.full(len(words), -1, np.int64)
    index[place] = np.arange(len(hashes))
    assert len(words) == int(counts.sum()) + n_docs
    return Shard(words, suffix_array(words, depth)), index


def compare(shard: Shard, at: np.ndarray, items: Items, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length of the common prefix (up to length words) of each shard suffix and item suffix; whether the shard's is smaller."""
    common = np.zeros(len(at), np.int64)
    smaller = np.zeros(len(at), bool)
    todo = np.arange(len(at))
    n = len(shard.words)
    d = 0
    while len(todo):
        todo = todo[length[todo] > d]
        p = at[todo] + d
        over = p >= n
        a = shard.words[np.minimum(p, n - 1)]
        b = items.words[start[todo] + d]
        same = ~over & (a == b)
        smaller[todo] = ~same & (over | (a < b))
        todo = todo[same]
        common[todo] += 1
        d += 1
    return common, smaller


def bisect(shard: Shard, items: Items, start: np.ndarray, length: np.ndarray, upper: bool) -> np.ndarray:
    """For each item suffix the first place of the suffix array whose suffix isn't below it (upper: whose prefix is above it)."""
    lo, hi = np.zeros(len(start), np.int64), np.full(len(start), len(shard.suffixes), np.int64)
    todo = np.flatnonzero(lo < hi)
    while len(todo):
        mid = (lo[todo] + hi[todo]) // 2
        common, smaller = compare(shard, shard.suffixes[mid], items, start[todo], length[todo])
        right = smaller | (upper & (common == length[todo]))
        lo[todo] = np.where(right, mid + 1, lo[todo])
        hi[todo] = np.where(right, hi[todo], mid)
        todo = todo[lo[todo] < hi[todo]]
    return lo


def longest_matches(shard: Shard, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """Per item suffix: words of its longest verbatim match in the shard and the position of one (suffix array sorted to that depth)."""
    start = np.arange(len(items.words))
    length = items.first[items.item + 1] - start
    best, where = np.zeros(len(start), np.int64), np.full(len(start), -1, np.int64)
    if not len(shard.words) or not len(start):
        return best, where
    place = bisect(shard, items, start, length, False)
    for side in (place - 1, place):
        ok = np.flatnonzero((side >= 0) & (side < len(shard.suffixes)))
        common, _ = compare(shard, shard.suffixes[side[ok]], items, start[ok], length[ok])
        better = common > best[ok]
        best[ok[better]] = common[better]
        where[ok[better]] = shard.suffixes[side[ok[better]]]
    return best, where


def occurrences(shard: Shard, items: Items, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, lengths and items of all windows of the items in the shard."""
    none = np.empty(0, np.int64)
    start = np.arange(len(items.words))
    size = (items.first[1:] - items.first[:-1])[items.item]
    length = np.minimum(size, window)
    keep = start + length <= items.first[items.item + 1]
    start, length, item = start[keep], length[keep], items.item[keep]
    if not len(shard.words) or not len(start):
        return none, none, none
    lo = bisect(shard, items, start, length, False)
    ok = lo < len(shard.suffixes)
    ok[ok] = compare(shard, shard.suffixes[lo[ok]], items, start[ok], length[ok])[0] == length[ok]
    start, length, item, lo = start[ok], length[ok], item[ok], lo[ok]
    count = bisect(shard, items, start, length, True) - lo
    base = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]) if len(count) else none, count)
    return shard.suffixes[base + np.arange(int(count.sum()))], np.repeat(length, count), np.repeat(item, count)


def _judge(texts: pa.Array, items: Items, window: int) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
    """First word of each row, whether each word is hit, and the ids of the items that each row's words are hit by."""
    words = scan(texts, ALNUM)
    n, first = words.n_docs, first_of_doc(words)
    shard, index = make_shard(words.hashes, words.doc, n, window)
    edge = np.zeros(len(words.hashes) + 1, np.int64)
    found: list[set[str]] = [set() for _ in range(n)]
    at, length, item = occurrences(shard, items, window)
    at = index[at]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length, -1)
    many = max(len(items.ids), 1)
    for pair in np.unique(words.doc[at] * many + item).tolist() if len(at) else ():
        found[pair // many].add(items.ids[pair % many])
    return first, np.cumsum(edge[:-1]) > 0, found


def blocks_of(benchmark: DataFrame, item_id: str, text: str) -> Iterator[Items]:
    """The benchmark in blocks of at most BLOCK_WORDS words (or one item), read on the driver one row group at a time."""
    ids, texts, size = [], [], 0
    rows = benchmark.filter(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).cast("string"), text).toLocalIterator(prefetchPartitions=False)
    for i, t in rows:
        n = t.count(" ") + t.count("\n") + 1 + len(t) // 8
        if texts and size + n > BLOCK_WORDS:
            yield items_of(ids, pa.array(texts, pa.string()))
            ids, texts, size = [], [], 0
        ids.append(i)
        texts.append(t)
        size += n
    yield items_of(ids, pa.array(texts, pa.string()))


@any_names("text")
def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """All rows and columns of docs, with n_words, n_hit, n_items, items_sha256 and contaminated.

    The benchmark's blocks are searched one after another, each in a pass of its own.
    """
    spark = docs.sparkSession
    names = [free_name(docs.columns, n) for n in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in zip(names, (T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.BooleanType()), strict=True))])
    kept = list(docs.columns)
    mask, ids = free_name(docs.columns, "__mask"), free_name(docs.columns, "__items")
    between = T.StructType([*docs.schema.fields, T.StructField(mask, T.BinaryType()), T.StructField(ids, T.ArrayType(T.StringType()))])

    def search(df: DataFrame, block, last: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items(*block.value)
            for whole in batches:
                for batch in slices(whole, text):
                    first, hit, found = _judge(batch.column(text), items, window)
                    if mask in batch.schema.names:  # what the blocks before this one hit
                        for i, (b, k) in enumerate(zip(batch.column(mask).to_pylist(), batch.column(ids).to_pylist(), strict=True)):
                            own = slice(int(first[i]), int(first[i + 1]))
                            hit[own] |= np.unpackbits(np.frombuffer(b, np.uint8))[: own.stop - own.start].astype(bool)
                            found[i] |= set(k)
                    own = [batch.column(c) for c in kept]
                    if last:
                        n_words, n_hit = np.diff(first), np.diff(np.concatenate([[0], np.cumsum(hit)])[first])
                        listed = [sorted(x) for x in found]
                        sha = [hashlib.sha256(",".join(x).encode()).hexdigest() if x else EMPTY_SHA for x in listed]
                        made = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in listed], pa.int64()), pa.array(sha, pa.string()), pa.array(n_hit > 0, pa.bool_())]
                        yield pa.RecordBatch.from_arrays([*own, *made], names=schema.names)
                    else:
                        masks = [np.packbits(hit[a:b]).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                        yield pa.RecordBatch.from_arrays([*own, pa.array(masks, pa.binary()), pa.array([sorted(x) for x in found], pa.list_(pa.string()))], names=between.names)

        return df.mapInArrow(run, schema if last else between)

    df, blocks = docs, blocks_of(benchmark, item_id, item_text)
    block = next(blocks)
    for following in blocks:
        shared = spark.sparkContext.broadcast(tuple(block))
        df = cut(search(df, shared, False))
        shared.destroy()
        block = following
    return search(df, spark.sparkContext.broadcast(tuple(block)), True)


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", at_least: int = WINDOW) -> DataFrame:
    """Longest verbatim match of every benchmark suffix per shard, with its location: item, start word, words, document, word.

    Matches of fewer than at_least words are left out.
    """
    blocks = [docs.sparkSession.sparkContext.broadcast(tuple(b)) for b in blocks_of(benchmark, item_id, item_text)]
    schema = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("item_word", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("doc_id", docs.schema[key].dataType), T.StructField("doc_word", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                words = scan(batch.column(text), ALNUM)
                first = first_of_doc(words)
                for b in blocks:
                    items = Items(*b.value)
                    deepest = int((items.first[1:] - items.first[:-1]).max(initial=1))
                    shard, index = make_shard(words.hashes, words.doc, words.n_docs, deepest)
                    best, where = longest_matches(shard, items)
                    s = np.flatnonzero(best >= at_least)
                    w = index[where[s]]
                    doc = words.doc[w]
                    columns = [pa.array([items.ids[k] for k in items.item[s]], pa.string()), pa.array(s - items.first[items.item[s]], pa.int64()), pa.array(best[s], pa.int64()), batch.column(key).take(pa.array(doc)), pa.array(w - first[doc], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, benchmark).drop("text")


OP10_SQL = r"""
WITH dw AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w,
         generate_subscripts(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), 1) AS i
  FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[s : s + least(len(ws), 10) - 1], ' ') AS g
  FROM bw, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS t(s) WHERE len(ws) > 0),
ns AS (SELECT DISTINCT n FROM win),
dg AS (
  SELECT doc_id, i, list(w) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS next FROM dw),
hits AS (SELECT DISTINCT dg.doc_id, dg.i, win.n, win.item_id FROM dg JOIN ns ON len(next) >= ns.n JOIN win ON win.n = ns.n AND win.g = array_to_string(next[1 : ns.n], ' ')),
hw AS (SELECT DISTINCT doc_id, i + k AS i FROM hits, unnest(generate_series(0, 9)) AS t(k) WHERE k < n),
nh AS (SELECT doc_id, count(*) AS n_hit FROM hw GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id),
nw AS (SELECT doc_id, count(*) AS n_words FROM dw GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM documents d LEFT JOIN nw USING (doc_id) LEFT JOIN nh USING (doc_id) LEFT JOIN it USING (doc_id)
"""
