"""Language-model scoring with Katz backoff.

A trigram model over white-space words and one end token. Counts of all
training texts are discounted by Good-Turing (Katz' form for counts up to 5;
(r - 1/2) / r where the counts of counts are too thin for it); n-grams seen once
are kept. A history's backoff weight is what its seen successors leave, divided
by the next order's mass of the words not seen after it, so that every
conditional distribution over the known words and one class of unknown words
sums to 1. A token's probability is looked up recursively: the trigram's if its
table has it, else the weight of its two words of history times the
probability by one word of history, which is looked up in the same way.

How it is spread. Texts are read in slices; a slice deals its distinct words
with their training counts into partitions by word, which number the words and
answer with numbers and total counts. A slice then deals its distinct trigrams,
with the documents that hold them, into partitions by their middle word: there a
trigram's history, the bigram that it backs off to and that one's history are
all at hand, and the last word's count comes along. A partition's table is added
up from its slices and gives each of these a sum for each of its documents.
Middle words with more than 1/P of all tokens are dealt by (first, middle) and
pairs of such a weight by the whole trigram; bigrams of the former are added up
by a second exchange, sums of the latter by Spark. Each of the two shuffles is
written once and read by several jobs (so they are RDDs: data frames would
shuffle again for each). The number of partitions P follows the size of the
texts. Only counts of counts and the at most P frequent words and pairs come to
the driver.

Defined cases: null texts are empty; an empty text is its end token; very long
texts are one row of a slice of their own; repeated rows count each; without
training rows every word is unknown, with probability 1; a null key is a
training row; an empty table gives an empty result; other columns of the table,
whatever their names, take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, slices
from .packing import by_part, deal, find, kinds, pack, pack_sorted, part_of, small, unpack, unpack_sorted
from .textscan import NON_SPACE, first_of_doc, mix, scan

END = np.uint64(0x7E11D0C3B4A59603)
BEGIN = np.uint64(0)  # as a word's number; those of words start with 1
SLICE_BYTES = 4 << 20
PARTITION_BYTES = 8 << 20
K = 5


# --- the model ---


def discounts(n: np.ndarray) -> np.ndarray:
    """d[r] for r = 0..K+1 (1 above K) from counts of counts n[r], r up to K + 1."""
    d = np.ones(K + 2)
    a = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        ok = n[r] > 0 and n[r + 1] > 0 and a < 1
        d[r] = ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) if ok else 0.0
        if not 0 < d[r] <= 1:
            d[r] = (r - 0.5) / r
    return d


class Unigrams:
    """N, V, discounts and the mass of unknown words."""

    def __init__(self, n: int, v: int, hist: np.ndarray):
        self.n, self.v, self.d = n, v, discounts(hist)
        held = n - sum((1 - self.d[r]) * r * hist[r] for r in range(1, K + 1))
        self.total = n if held < n else n + 1
        self.unknown = 1 - held / self.total if n else 1.0

    def p(self, c: np.ndarray) -> np.ndarray:
        """Probability of a word with count c (0: unknown)."""
        if not self.n:
            return np.ones(len(c))
        return np.where(c > 0, self.d[np.minimum(c, K + 1)] * c / self.total, self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.n + 0.1 * (self.v + 1)))


def kept(d: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Discounted counts."""
    return d[np.minimum(c, K + 1)] * c


def backoff(total: np.ndarray, left: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Histories' denominators and weights, from their counts and the sums over their successors of discounted counts and of next-order probabilities."""
    total = total.astype(np.float64)
    total += (total > 0) & (total - left <= 1e-9 * total)  # nothing would be left for other words
    seen = total > 0
    weight = np.ones(len(total))
    weight[seen] = (1 - left[seen] / total[seen]) / np.maximum(1 - lower[seen], 1e-12)
    return total, weight


def counts_of_counts(c: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(c, K + 2), minlength=K + 3)[: K + 2].astype(np.int64)


# --- slices ---


def restart(steps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Running sums that start anew at the places first."""
    total = np.cumsum(steps, dtype=np.uint64)
    before = np.concatenate([np.zeros(1, np.uint64), total])[first]
    return total - np.repeat(before, np.diff(np.append(first, len(steps))))


def changes(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = False
        for c in columns:
            out[1:] |= c[1:] != c[:-1]
    return out


def pack_trigrams(v, u, w, *more: np.ndarray) -> bytes:
    """Rows in the order of (v, u, w)."""
    new_v, new_u = changes(v), changes(v, u)
    first = np.flatnonzero(new_v)
    step = lambda x, new: small(np.where(new, x, np.diff(x, prepend=np.uint64(0))))
    return pack(pack_sorted(v[first]), small(np.diff(np.append(first, len(v)))), step(u, new_v), step(w, new_u), *map(small, more))


def unpack_trigrams(blob: bytes) -> list[np.ndarray]:
    heads, runs, u, w, *more = unpack(blob)
    runs = runs.astype(np.int64)
    v = np.repeat(unpack_sorted(heads), runs)
    u = restart(u, np.cumsum(runs) - runs)
    return [v, u, restart(w, np.flatnonzero(changes(v, u))), *more]


def read_slice(texts: pa.Array, train: np.ndarray, parts: int) -> tuple[list[tuple[int, bytes]], bytes]:
    """By partition the slice's words with their training counts; and its rows' words, as places in the order by partition, with that of the end."""
    found = scan(texts, NON_SPACE)
    n = np.diff(first_of_doc(found))
    keys, word = np.unique(np.append(found.hashes, END), return_inverse=True)
    end, word = word[-1], word[:-1]
    count = np.bincount(word, weights=train[found.doc], minlength=len(keys)).astype(np.int64)
    count[end] += int(train.sum())
    order, edge = by_part(keys, parts)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    made = []
    for p in np.flatnonzero(np.diff(edge)):
        own = order[edge[p] : edge[p + 1]]
        made.append((int(p), pack(pack_sorted(keys[own]), small(count[own]))))
    return made, pack(small(n), small(place[word]), np.array([place[end]]), train.astype(np.uint8))


class Numbered:
    """A slice with its words' numbers and counts: histories u, v and word w of every token, ends included."""

    def __init__(self, blob: bytes, named: list[tuple[int, bytes]], parts: int):
        number, count = [], []
        for p, x in sorted(named):
            rank, c = unpack(x)
            number.append(rank.astype(np.uint64) * np.uint64(parts) + np.uint64(p + 1))
            count.append(c.astype(np.int64))
        number, count = np.concatenate(number), np.concatenate(count)
        n, place, end, train = unpack(blob)
        self.n, self.train = n.astype(np.int64) + 1, train.astype(bool)
        first = np.cumsum(self.n) - self.n
        at = np.full(int(self.n.sum()), int(end[0]))
        inner = np.ones(len(at), bool)
        inner[first + self.n - 1] = False
        at[inner] = place
        self.row = np.repeat(np.arange(len(n)), self.n)
        self.w, self.count = number[at], count[at]
        self.v = np.concatenate([[BEGIN], self.w[:-1]])
        self.v[first] = BEGIN
        self.u = np.concatenate([[BEGIN], self.v[:-1]])
        self.u[first] = BEGIN

    def trigrams(self, parts: int, hot: np.ndarray, pairs: dict[tuple[int, int], int]) -> Iterator[tuple[int, bytes]]:
        """By partition the distinct trigrams with training counts, counts of their last words, and their rows."""
        order = np.lexsort((self.row, self.w, self.u, self.v))
        v, u, w, row = self.v[order], self.u[order], self.w[order], self.row[order]
        entry = changes(v, u, w)
        pair = np.flatnonzero(changes(v, u, w, row))
        times = np.diff(np.append(pair, len(order)))
        which = (np.cumsum(entry) - 1)[pair]
        first = np.flatnonzero(entry)
        counted = np.bincount(which, weights=times * self.train[row[pair]], minlength=len(first)).astype(np.int64)
        rows = np.bincount(which, minlength=len(first))
        v, u, w, last = v[first], u[first], w[first], self.count[order][first]
        part = part_of(v, parts)
        frequent = np.flatnonzero(find(hot, v)[1])
        part[frequent] = part_of(mix(u[frequent] + mix(v[frequent], 31), 32), parts)
        if pairs:
            both = frequent[find(hot, u[frequent])[1]]
            both = both[[(a, b) in pairs for a, b in zip(u[both].tolist(), v[both].tolist(), strict=True)]] if len(both) else both
            part[both] = part_of(mix(w[both] + mix(u[both] + mix(v[both], 31), 33), 34), parts)
        turn = np.argsort(part, kind="stable")
        edge = np.searchsorted(part[turn], np.arange(parts + 1))
        start = np.cumsum(rows) - rows
        for p in np.flatnonzero(np.diff(edge)):
            own = turn[edge[p] : edge[p + 1]]
            k = rows[own]
            at = np.repeat(start[own] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
            yield int(p), pack_trigrams(v[own], u[own], w[own], counted[own], last[own], k, row[pair][at], times[at])


class Table:
    """The trigrams of one partition, all slices together, and the bigrams that they back off to."""

    def __init__(self, blocks: list[tuple[int, bytes]], hot: np.ndarray):
        got = [(k, unpack_trigrams(b)) for k, b in sorted(blocks)]
        self.slices = [(k, len(x[0]), *x[5:]) for k, x in got]
        cat = lambda i, t: np.concatenate([x[i] for _, x in got]).astype(t) if got else np.empty(0, t)
        v, u, w, n, last = cat(0, np.uint64), cat(1, np.uint64), cat(2, np.uint64), cat(3, np.int64), cat(4, np.int64)
        del got
        order = np.lexsort((w, u, v))
        v, u, w = v[order], u[order], w[order]
        new = changes(v, u, w)
        self.inverse = np.empty(len(order), np.int64)
        self.inverse[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        self.count = np.bincount(self.inverse, weights=n, minlength=len(first)).astype(np.int64)
        v, u, w, last = v[first], u[first], w[first], last[order][first]
        new = changes(v, u)
        self.pair, at = np.cumsum(new) - 1, np.flatnonzero(new)
        self.pair_u, self.pair_v = u[at], v[at]
        self.pair_n = np.bincount(self.pair, weights=self.count, minlength=len(at)).astype(np.int64)
        order = np.lexsort((w, v))
        new = changes(v[order], w[order])
        self.bigram = np.empty(len(order), np.int64)
        self.bigram[order] = np.cumsum(new) - 1
        at = order[np.flatnonzero(new)]
        self.bi_v, self.bi_w, self.bi_last = v[at], w[at], last[at]
        self.bi_n = np.bincount(self.bigram, weights=self.count, minlength=len(at)).astype(np.int64)
        self.asked = np.flatnonzero(find(hot, self.bi_v)[1])  # their counts are spread over partitions
        self.hot = hot

    def owners(self, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """Order of the asked bigrams by the partition that adds them up, and each one's edge in it."""
        own = part_of(mix(self.bi_v[self.asked] + mix(self.bi_w[self.asked], 21), 22), parts)
        order = np.argsort(own, kind="stable")
        return self.asked[order], np.searchsorted(own[order], np.arange(parts + 1))

    def asks(self, parts: int) -> Iterator[tuple[int, bytes]]:
        order, edge = self.owners(parts)
        for p in np.flatnonzero(np.diff(edge)):
            at = order[edge[p] : edge[p + 1]]
            v = self.bi_v[at]
            yield int(p), pack(pack_sorted(v), small(restart_steps(self.bi_w[at], v)), small(self.bi_n[at]), small(self.bi_last[at]))

    def second_order(self, answers: list[tuple[int, bytes]], parts: int, uni: Unigrams, d: np.ndarray, sums: dict[int, tuple[int, float, float]]) -> None:
        """p2: the probability of each bigram by one word of history."""
        order, edge = self.owners(parts)
        for p, blob in answers:
            self.bi_n[order[edge[p] : edge[p + 1]]] = unpack(blob)[0]
        heads, head = np.unique(self.bi_v, return_inverse=True)
        one = uni.p(self.bi_last)
        seen, held = self.bi_n > 0, kept(d, self.bi_n)
        add = lambda x: np.bincount(head, weights=x, minlength=len(heads)).astype(np.float64)
        total, left, lower = add(self.bi_n), add(held), add(one * seen)
        for i in np.flatnonzero(find(self.hot, heads)[1]):
            total[i], left[i], lower[i] = sums[int(heads[i])]
        total, weight = backoff(total, left, lower)
        self.p2 = np.where(seen, held / np.maximum(total[head], 1), weight[head] * one)

    def third_order(self, d: np.ndarray) -> None:
        """Sums of each pair's seen trigrams."""
        self.held = kept(d, self.count)
        add = lambda x: np.bincount(self.pair, weights=x, minlength=len(self.pair_n)).astype(np.float64)
        self.left, self.lower = add(self.held), add(self.p2[self.bigram] * (self.count > 0))

    def pairs_at(self, pairs: dict[tuple[int, int], int]) -> list[tuple[int, tuple[int, int]]]:
        """Places of frequent pairs."""
        if not pairs:
            return []
        some = np.flatnonzero(find(self.hot, self.pair_v)[1] & find(self.hot, self.pair_u)[1])
        return [(i, k) for i in some.tolist() if (k := (int(self.pair_u[i]), int(self.pair_v[i]))) in pairs]

    def score(self, pairs: dict[tuple[int, int], tuple[int, float, float]]) -> Iterator[tuple[int, bytes]]:
        """Per slice: rows and the log10 probability of their tokens here."""
        total = self.pair_n.astype(np.float64)
        for i, k in self.pairs_at(pairs):
            total[i], self.left[i], self.lower[i] = pairs[k]
        total, weight = backoff(total, self.left, self.lower)
        log = np.log10(np.where(self.count > 0, self.held / np.maximum(total[self.pair], 1), weight[self.pair] * self.p2[self.bigram]))
        start = 0
        for k, n, rows, who, times in self.slices:
            each = np.repeat(log[self.inverse[start : start + n]], rows.astype(np.int64))
            start += n
            docs, local = np.unique(who, return_inverse=True)
            yield k, pack(small(docs), np.bincount(local, weights=each * times, minlength=len(docs)))


def restart_steps(w: np.ndarray, v: np.ndarray) -> np.ndarray:
    """What restart makes w of, at the changes of v."""
    return np.where(changes(v), w, np.diff(w, prepend=np.uint64(0)))


# --- the jobs ---


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 10) -> DataFrame:
    """Per row: key, held_out, n_tokens, n_known, train_tokens, base_score, score; rows with crc32(key) mod folds = 0 are held out."""
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == 0, F.lit(False))
    source = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"), held.alias("__held"))
    parts = max(8, -(-(source.agg(F.sum(F.octet_length("__text"))).first()[0] or 0) // PARTITION_BYTES))
    kind = docs.schema[key].dataType

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in slices(whole, "__text", SLICE_BYTES):
                made, rows = read_slice(batch.column("__text"), ~batch.column("__held").to_numpy(zero_copy_only=False).astype(bool), parts)
                made = [(k % parts, "text", rows), *((p, "words", b) for p, b in made)]
                keys = pa.array([batch.column("__key").to_pylist(), *[None] * (len(made) - 1)], pa.list_(batch.schema.field("__key").type))
                columns = [pa.array([m[0] for m in made], pa.int32()), pa.array([m[1] for m in made]), pa.array([k] * len(made), pa.int64()), pa.array([m[2] for m in made], pa.binary()), keys]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "kind", "slice", "blob", "keys"])
                k += 1

    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("slice", T.LongType()), T.StructField("blob", T.BinaryType()), T.StructField("keys", T.ArrayType(kind))])
    texts = deal(source.mapInArrow(read, schema).rdd.map(lambda r: (r[0], (r[1], r[2], bytes(r[3]), r[4]))), parts)

    def only(rows: Iterator, *which: str) -> Iterator:
        return (r for r in rows if r[1][0] in which)

    def number(p: int, rows: dict) -> Iterator[tuple]:
        each = [(k, unpack_sorted(keys), n.astype(np.int64)) for _, k, blob, _ in rows.get("words", []) for keys, n in [unpack(blob)]]
        keys, inverse = np.unique(np.concatenate([x[1] for x in each]), return_inverse=True)
        count = np.bincount(inverse, weights=np.concatenate([x[2] for x in each])).astype(np.int64)
        order = np.lexsort((keys, -count))  # frequent words have small numbers
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.arange(len(keys))
        top = np.flatnonzero(count * parts > count.sum())  # all of the whole corpus' are among them
        yield None, p, None, int((count > 0).sum()), int(count.sum()), counts_of_counts(count).tolist(), list(zip((rank[top] * parts + p + 1).tolist(), count[top].tolist(), strict=True))
        start = 0
        for k, own, _ in each:
            at = inverse[start : start + len(own)]
            start += len(own)
            yield k, p, bytearray(pack(small(rank[at]), small(count[at]))), None, None, None, None

    top = "array<struct<word: bigint, n: bigint>>"
    named = cut(spark.createDataFrame(texts.mapPartitions(lambda rows: kinds(only(rows, "words"), number)), f"slice long, part int, blob binary, types long, tokens long, hist array<long>, top {top}"))
    stats = named.agg(F.sum("types"), F.sum("tokens"), *[F.sum(F.element_at("hist", r + 1)) for r in range(K + 2)]).first()
    n_types, n_tokens = stats[0] or 0, stats[1] or 0
    uni = Unigrams(n_tokens, n_types, np.array([x or 0 for x in stats[2:]], np.int64))
    frequent = dict(named.select(F.explode("top").alias("t")).select("t.*").filter(F.col("n") * parts > n_tokens).collect())
    n_begins = source.filter("not __held").count()
    if n_begins * parts > n_tokens:
        frequent[int(BEGIN)] = n_begins
    hot = np.array(sorted(frequent), np.uint64)
    slices_ = texts.union(deal(named.filter("slice is not null").select("slice", "part", "blob").rdd.map(lambda r: (r[0] % parts, ("named", r[0], r[1], bytes(r[2])))), parts))

    def numbered(rows: dict) -> Iterator[tuple[int, Numbered, list]]:
        by: dict[int, list] = {}
        for x in rows.get("named", []):
            by.setdefault(x[1], []).append((x[2], x[3]))
        for _, k, blob, keys in rows.get("text", []):
            yield k, Numbered(blob, by.pop(k), parts), keys

    def hot_pairs(p: int, rows: dict) -> Iterator[tuple]:
        for _, x, _ in numbered(rows):
            both = np.flatnonzero(find(hot, x.u)[1] & find(hot, x.v)[1] & x.train[x.row])
            pair, n = np.unique(np.stack([x.u[both], x.v[both]], 1), axis=0, return_counts=True)
            yield from (((a, b), m) for (a, b), m in zip(pair.tolist(), n.tolist(), strict=True))

    pairs: dict[tuple[int, int], int] = {}
    if len(hot):
        of_hot = slices_.mapPartitions(lambda rows: kinds(only(rows, "text", "named"), hot_pairs)).reduceByKey(lambda a, b: a + b)
        pairs = dict(of_hot.filter(lambda x: x[1] * parts > n_tokens).collect())

    def deal_trigrams(p: int, rows: dict) -> Iterator[tuple]:
        for k, x, keys in numbered(rows):
            add = lambda y: np.bincount(x.row, weights=y, minlength=len(x.n))  # noqa: B023, E731
            yield k % parts, ("docs", k, pack(x.n, x.train, add(uni.base(x.count)) if n_tokens else np.zeros(len(x.n)), add(x.count > 0)), keys)
            for q, blob in x.trigrams(parts, hot, pairs):
                yield q, ("trigrams", k, blob)

    trigrams = deal(slices_.mapPartitions(lambda rows: kinds(only(rows, "text", "named"), deal_trigrams)), parts)

    def table(rows: dict) -> Table:
        return Table([(x[1], x[2]) for x in rows.get("trigrams", [])], hot)

    def asks(p: int, rows: dict) -> Iterator[tuple]:
        x = table(rows)
        complete = np.ones(len(x.bi_n), bool)
        complete[x.asked] = False
        yield None, p, None, counts_of_counts(x.count).tolist(), counts_of_counts(x.bi_n[complete]).tolist()
        for q, blob in x.asks(parts):
            yield q, p, bytearray(blob), None, None

    asked = cut(spark.createDataFrame(trigrams.mapPartitions(lambda rows: kinds(only(rows, "trigrams"), asks)), "owner int, part int, blob binary, hist3 array<long>, hist2 array<long>"))

    def add_up(group: pa.Table) -> pa.Table:
        """Totals of bigrams of frequent words, for each of those that ask; and what these words' sums need."""
        each = []
        for blob in group.column("blob").to_pylist():
            v, w, n, last = unpack(blob)
            v = unpack_sorted(v)
            each.append((v, restart(w, np.flatnonzero(changes(v))), n.astype(np.int64), last.astype(np.int64)))
        v, w, n, last = (np.concatenate([x[i] for x in each]) for i in range(4))
        order = np.lexsort((w, v))
        new = changes(v[order], w[order])
        inverse = np.empty(len(order), np.int64)
        inverse[order] = np.cumsum(new) - 1
        total = np.bincount(inverse, weights=n).astype(np.int64)
        made, start = [], 0
        for x in each:
            made.append(pack(small(total[inverse[start : start + len(x[0])]])))
            start += len(x[0])
        at = order[np.flatnonzero(new)]
        own = pack(pack_sorted(v[at]), small(total), small(last[at]))
        to = [*group.column("part").to_pylist(), None]
        return pa.table({"to": pa.array(to, pa.int32()), "owner": pa.array([group.column("owner")[0].as_py()] * len(to), pa.int32()), "blob": pa.array([*made, own], pa.binary()), "hist2": pa.array([*[None] * len(made), counts_of_counts(total).tolist()], pa.list_(pa.int64()))})

    totals = cut(asked.filter("owner is not null").select("owner", "part", "blob").groupBy("owner").applyInArrow(add_up, "to int, owner int, blob binary, hist2 array<long>"))
    summed = lambda df, c: np.array([x or 0 for x in df.agg(*[F.sum(F.element_at(c, r + 1)) for r in range(K + 2)]).first()], np.int64)
    d3, d2 = discounts(summed(asked, "hist3")), discounts(summed(asked, "hist2") + summed(totals, "hist2"))

    def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                v, n, last = unpack(blob)
                heads, head = np.unique(unpack_sorted(v), return_inverse=True)
                n = n.astype(np.int64)
                columns = [np.bincount(head, weights=x, minlength=len(heads)).astype(np.float64) for x in (kept(d2, n), uni.p(last.astype(np.int64)) * (n > 0))]
                yield pa.RecordBatch.from_arrays([pa.array(heads.view(np.int64)), *map(pa.array, columns)], names=["word", "held", "lower"])

    by_word = totals.filter("to is null").select("blob").mapInArrow(sums_of, "word long, held double, lower double").groupBy("word").agg(F.sum("held"), F.sum("lower"))
    sums = {r[0]: (frequent[r[0]], r[1], r[2]) for r in (by_word.collect() if len(hot) else [])}
    tables = trigrams.union(deal(totals.filter("to is not null").select("to", "owner", "blob").rdd.map(lambda r: (r[0], ("total", r[1], bytes(r[2])))), parts)) if len(hot) else trigrams

    def ready(rows: dict) -> Table:
        x = table(rows)
        x.second_order([(a[1], a[2]) for a in rows.get("total", [])], parts, uni, d2, sums)
        x.third_order(d3)
        return x

    def pair_sums(p: int, rows: dict) -> Iterator[tuple]:
        x = ready(rows)
        yield from ((k, (float(x.left[i]), float(x.lower[i]))) for i, k in x.pairs_at(pairs))

    whole: dict[tuple[int, int], tuple[int, float, float]] = {}
    if pairs:
        found = tables.mapPartitions(lambda rows: kinds(only(rows, "trigrams", "total"), pair_sums)).reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1])).collect()
        whole = {k: (pairs[k], a, b) for k, (a, b) in found}

    def scored(p: int, rows: dict) -> Iterator[tuple]:
        for k, blob in ready(rows).score(whole):
            yield k % parts, ("score", k, blob)

    scores = deal(tables.mapPartitions(lambda rows: kinds(only(rows, "trigrams", "total"), scored)), parts)

    def finish(p: int, rows: dict) -> Iterator[tuple]:
        by: dict[int, list] = {}
        for x in rows.get("score", []):
            by.setdefault(x[1], []).append(x[2])
        for _, k, blob, keys in rows.get("docs", []):
            n, train, base, known = unpack(blob)
            score = np.zeros(len(n))
            for b in sorted(by.pop(k, [])):
                who, value = unpack(b)
                score[who] += value
            yield from zip(keys, (~train).tolist(), n.tolist(), np.rint(known).astype(np.int64).tolist(), [n_tokens] * len(n), base.tolist(), score.tolist(), strict=True)

    names = (key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    types = (kind, T.BooleanType(), T.LongType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType())
    out = T.StructType([T.StructField(a, b) for a, b in zip(names, types, strict=True)])
    return spark.createDataFrame(trigrams.union(scores).mapPartitions(lambda rows: kinds(only(rows, "docs", "score"), finish)), out)


def op6_katz(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
