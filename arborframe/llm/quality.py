"""Quality classifier: random-indexing word vectors pooled per document, then a small network.

Word vectors. A token is a run of letters, of digits or of other signs, in its
case. Its sparse index vector has NONZERO entries of +1 or -1 among DIM, drawn
by the token's own 64-bit hash. Over the whole corpus each token adds up the
index vectors of the tokens beside its occurrences: its context vector. A word
vector is the unit context vector, the unit index vector and their cosine (how
much the word stands beside itself). No vocabulary is folded or cut off.

Documents. A document's vector is the mean of its tokens' vectors. Network: one
hidden tanh layer and a sigmoid output, trained in numpy (Adam, weighted
classes) on at most MAX_TRAIN labelled rows, those with the smallest hashes of
their id; a fifth of them is held back to fit the temperature that calibrates
the probabilities.

How it is spread. Tasks read the texts in slices, count a slice's contexts and
deal them by word into partitions (about PART_BYTES of text each), which add
them up: the table of context vectors, partitioned by word. The hidden layer is
linear before its tanh, so it is applied to the words before pooling: a
partition answers a slice with HIDDEN numbers for each of its words, and the
slice's documents add these up. The labelled rows' vectors, which train the
network, are asked for beforehand in the same way. Only these (at most
MAX_TRAIN) come to the driver. What the slices deal is one shuffle, written
once and read by three jobs (so it is an RDD).

Defined cases: null and empty texts have the zero vector and the score that
the network gives it; very long texts are read whole; labels that are null, not
0 or 1, or without a document are ignored; an id labelled both ways counts as
both; with one class or none in the labels all documents score that class' rate
(or 0.5); repeated documents score alike; an empty table gives an empty result;
further columns are kept, and a result that would clash with one of them gets a
trailing underscore.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import any_names, bitmap, cut, free_name, maybe_in, slices
from .packing import by_part, deal, kinds, pack, pack_rows, small, unpack, unpack_rows, unpack_sorted
from .textscan import first_of_doc, mix, runs

DIM = 48
NONZERO = 2
HIDDEN = 4
MAX_TRAIN = 3_000
THRESHOLD = 0.3
SLICE_BYTES = 7 << 20
PART_BYTES = 16 << 20
WIDTH = 2 * DIM + 1
WORDS = 8_192  # so many words' vectors are worked on at once
TOKENS = 1 << 17  # and so many tokens' neighbours
SCAN_BYTES = 1 << 20


def held_out(key: Column, folds: int) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == 0, F.lit(False))


def index_vectors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs (words x NONZERO) of the index vectors of hashed words."""
    x = np.stack([mix(words, 100 + k) for k in range(NONZERO)], 1)
    return (x % np.uint64(DIM)).astype(np.int64), np.where(x >> np.uint64(63), 1, -1).astype(np.int32)


def contexts(word: np.ndarray, doc: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Context vectors (keys x DIM) of a slice; word: places in keys of its tokens."""
    place, sign = index_vectors(keys)
    total = np.zeros(len(keys) * DIM, np.int32)
    for i in range(0, len(word) - 1, TOKENS):
        near = i + np.flatnonzero(doc[i + 1 : i + TOKENS + 1] == doc[i : i + TOKENS][: len(doc) - 1 - i])
        left, right = word[near].astype(np.int64), word[near + 1].astype(np.int64)
        for own, other in ((left, right), (right, left)):
            for k in range(NONZERO):
                np.add.at(total, own * DIM + place[other, k], sign[other, k])
    return total.reshape(len(keys), DIM)


def word_vectors(context: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """words x WIDTH: unit context vector, unit index vector, their cosine."""
    place, sign = index_vectors(keys)
    own = np.zeros((len(keys), DIM), np.float32)
    for k in range(NONZERO):
        np.add.at(own, (np.arange(len(keys)), place[:, k]), sign[:, k])
    unit = lambda x: x / np.maximum(np.sqrt((x**2).sum(1, keepdims=True)), 1e-9)
    context, own = unit(context.astype(np.float32)), unit(own)
    return np.concatenate([context, own, (context * own).sum(1, keepdims=True)], 1)


def projected(keys: np.ndarray, context: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Vectors of all words times `by`; WORDS at a time, since together they take several times the contexts."""
    value = np.empty((len(keys), by.shape[1]), np.float16)
    for i in range(0, len(keys), WORDS):
        value[i : i + WORDS] = word_vectors(context[i : i + WORDS], keys[i : i + WORDS]) @ by
    return value


def scanned(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and rows of all tokens, and how many each row has; about SCAN_BYTES of whole texts at a time, since a scan takes many times its texts."""
    size = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    edge = np.unique([0, *np.searchsorted(size, np.arange(SCAN_BYTES, size[-1] if len(size) else 0, SCAN_BYTES)), len(texts)])
    hashes, doc, many = [np.empty(0, np.uint64)], [np.empty(0, np.int32)], [np.empty(0, np.int64)]
    for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        found = runs(texts.slice(i, j - i))
        hashes.append(found.hashes)
        doc.append((found.doc + i).astype(np.int32))
        many.append(np.diff(first_of_doc(found)))
    return np.concatenate(hashes), np.concatenate(doc), np.concatenate(many)


class Slice:
    """The distinct words of a slice and the words of each of its rows with their numbers."""

    def __init__(self, texts: pa.Array, parts: int):
        hashes, self.doc, self.n = scanned(texts)
        self.keys, word = np.unique(hashes, return_inverse=True)
        del hashes
        self.order, self.edge = by_part(self.keys, parts)
        self.word = word.astype(np.int32)
        del word
        turned = np.empty(len(self.order), np.int64)
        turned[self.order] = np.arange(len(self.order))
        pair = turned[self.word]
        pair += self.doc * np.int64(max(len(self.keys), 1))
        pair, self.times = np.unique(pair, return_counts=True)
        self.who, self.what = pair // max(len(self.keys), 1), pair % max(len(self.keys), 1)

    def rows(self, *more: np.ndarray) -> bytes:
        """Tokens of each row, its distinct words (as places in the order by partition, as differences) and their counts; and more of the rows."""
        new = np.concatenate([[True], self.who[1:] != self.who[:-1]]) if len(self.who) else np.empty(0, bool)
        step = np.where(new, self.what, np.diff(self.what, prepend=0))
        return pack(small(self.n), small(np.bincount(self.who, minlength=len(self.n))), small(step), small(self.times), *more)


def pooled(blob: bytes, values: np.ndarray) -> np.ndarray:
    """Mean over each row's tokens of its words' values."""
    n, many, step, times, *_ = unpack(blob)
    many = many.astype(np.int64)
    who = np.repeat(np.arange(len(n)), many)
    total = np.cumsum(step.astype(np.int64))
    before = np.concatenate([[0], total])[np.cumsum(many) - many]
    what = total - np.repeat(before, many)
    out = np.zeros((len(n), values.shape[1]))
    for j in range(values.shape[1]):
        out[:, j] = np.bincount(who, weights=values[what, j].astype(np.float64) * times, minlength=len(n))
    return out / np.maximum(n, 1)[:, None]


class Network:
    """inputs -> tanh layer -> sigmoid, with standardised inputs and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 3, epochs: int = 60):
        rng = np.random.default_rng(seed)
        self.constant = None if 0 < y.sum() < len(y) else (float(y.mean()) if len(y) else 0.5)
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-4) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        if self.constant is not None:
            return
        z = (x - self.mean) / self.scale
        back = rng.random(len(z)) < 0.2
        if min(y[~back].sum(), (~y.astype(bool))[~back].sum()) < 1 or not back.any():
            back[:] = False
        fit = np.flatnonzero(~back)
        d = z.shape[1]
        w = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
        step, size = 0, 64
        weight = np.where(y == 1, 0.5 / y[fit].mean(), 0.5 / (1 - y[fit].mean())) ** 0.5
        for _ in range(max(epochs, 3000 * size // max(len(fit), 1)) if len(fit) < 3000 else max(6, epochs * 3000 // len(fit))):
            order = rng.permutation(fit)
            for i in range(0, len(order), size):
                k = order[i : i + size]
                h = np.tanh(z[k] @ w[0] + w[1])
                e = (1 / (1 + np.exp(-(h @ w[2] + w[3]))) - y[k]) * weight[k] / len(k)
                back_h = e[:, None] * w[2] * (1 - h**2)
                step += 1
                for j, g in enumerate((z[k].T @ back_h + 1e-3 * w[0], back_h.sum(0), h.T @ e + 1e-3 * w[2], np.array([e.sum()]))):
                    m[j] = 0.9 * m[j] + 0.1 * g
                    v[j] = 0.999 * v[j] + 0.001 * g * g
                    w[j] -= 0.003 * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
        self.w = w
        self.temperature = 1.0
        check = np.flatnonzero(back) if back.any() else fit
        logit, truth = self._logit(x[check]), y[check]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        loss = [np.logaddexp(0, np.where(truth == 1, -logit, logit) / t).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def first_layer(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights (inputs x hidden) and offsets of the hidden layer for inputs that are not standardised."""
        w = self.w[0] / self.scale[:, None]
        return w, self.w[1] - self.mean @ w

    def score_hidden(self, h: np.ndarray) -> np.ndarray:
        """From the hidden layer's inputs."""
        logit = np.tanh(h) @ self.w[2] + self.w[3]
        return 1 / (1 + np.exp(-np.clip(logit / self.temperature, -30, 30)))

    def _logit(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.tanh(z @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self._logit(x) / self.temperature, -30, 30)))


def _slices_of(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    k = TaskContext.get().partitionId() << 32
    for whole in batches:
        for batch in slices(whole, text, SLICE_BYTES):
            yield k, batch
            k += 1


def _row(*columns) -> pa.RecordBatch:
    """Rows of part, kind, slice, blob, and the lists of the slice's rows."""
    return pa.RecordBatch.from_arrays(list(columns), names=["part", "kind", "slice", "blob", "keys", "digests"])


def score_texts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, max_train: int = MAX_TRAIN) -> DataFrame:
    """(key, digest: 16 bytes of the text or null, score) of every row of docs.

    Labels are learned from rows outside fold 0 of crc32(key) mod folds, at most max_train of them.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(key), folds)).select(F.col(key).alias("__k"), F.col(label).cast("int").alias("__y"))
    known = known.distinct().orderBy(F.xxhash64("__k"), "__k", "__y").limit(max_train).groupBy("__k").agg(F.sum(F.col("__y") + 1).alias("__code"))  # 1: labelled 0, 2: labelled 1, 3: both
    source = docs.select(F.col(key).alias("__key"), F.unhex(F.md5(F.col(text).cast("binary"))).alias("__digest"), F.col(text).alias("__text"))
    parts = max(4, -(-(source.agg(F.sum(F.octet_length("__text"))).first()[0] or 0) // PART_BYTES))
    source = source.join(F.broadcast(known), F.col("__key") == F.col("__k"), "left").withColumn("__h", F.xxhash64("__key")).drop("__k")

    def told(k: int, batch: pa.RecordBatch) -> list[tuple[int, str, bytes]]:
        """What a slice deals; its arrays are gone when this returns."""
        s = Slice(batch.column("__text"), parts)
        made = [(k % parts, "rows", s.rows())]
        total = contexts(s.word, s.doc, s.keys)
        for p in np.flatnonzero(np.diff(s.edge)):
            own = s.order[s.edge[p] : s.edge[p + 1]]
            made.append((int(p), "words", pack_rows(s.keys[own], total[own])))
        labelled = batch.filter(batch.column("__code").is_valid())
        if labelled.num_rows:
            t = Slice(labelled.column("__text"), parts)
            made.append((k % parts, "sample", t.rows(labelled.column("__h").to_numpy(zero_copy_only=False), labelled.column("__code").to_numpy(zero_copy_only=False))))
            for p in np.flatnonzero(np.diff(t.edge)):
                asked = t.keys[t.order[t.edge[p] : t.edge[p + 1]]]
                made.append((int(p), "ask", pack(small(np.diff(np.searchsorted(s.keys[s.order[s.edge[p] : s.edge[p + 1]]], asked), prepend=0)))))
        return made

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, batch in _slices_of(batches, "__text"):
            made = told(k, batch)
            some = [None] * (len(made) - 1)
            yield _row(
                pa.array([m[0] for m in made], pa.int32()), pa.array([m[1] for m in made]), pa.array([k] * len(made), pa.int64()), pa.array([m[2] for m in made], pa.binary()),
                pa.array([batch.column("__key").to_pylist(), *some], pa.list_(batch.schema.field("__key").type)), pa.array([batch.column("__digest").to_pylist(), *some], pa.list_(pa.binary())),
            )

    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("slice", T.LongType()), T.StructField("blob", T.BinaryType()), T.StructField("keys", T.ArrayType(kind)), T.StructField("digests", T.ArrayType(T.BinaryType()))])
    dealt = deal(source.mapInArrow(read, schema).rdd.map(lambda r: (r[0], (r[1], r[2], bytes(r[3]), r[4], r[5]))), parts)

    def only(rows: Iterator, *which: str) -> Iterator:
        return (r for r in rows if r[1][0] in which)

    def given(p: int, rows: dict) -> Iterator[tuple]:
        """Context vectors of the words that labelled rows of the slices have."""
        keys, total, places = merged(rows)
        for x in rows.get("ask", []):
            at = places[x[1]][np.cumsum(unpack(x[2])[0], dtype=np.int64)]
            yield x[1] % parts, ("given", x[1], p, pack_rows(keys[at], total[at]))

    def sampled(p: int, rows: dict) -> Iterator[tuple]:
        by: dict[int, list] = {}
        for x in rows.get("given", []):
            by.setdefault(x[1], []).append((x[2], x[3]))
        for x in rows.get("sample", []):
            values = [word_vectors(total, keys) for keys, total in (unpack_rows(b, DIM) for _, b in sorted(by.pop(x[1], [])))]
            vectors = pooled(x[2], np.concatenate(values) if values else np.zeros((1, WIDTH))).astype(np.float32)
            for h, code, v in zip(*(c.tolist() for c in unpack(x[2])[4:]), vectors, strict=True):
                yield from ((h, y, v.tobytes()) for y in (0, 1) if code >> y & 1)

    asked = dealt.mapPartitions(lambda rows: kinds(only(rows, "words", "ask"), given))
    sample = dealt.union(deal(asked, parts)).mapPartitions(lambda rows: kinds(only(rows, "sample", "given"), sampled)).takeOrdered(max_train)
    network = Network(np.frombuffer(b"".join(v for _, _, v in sample), np.float32).reshape(-1, WIDTH).astype(np.float64), np.array([y for _, y, _ in sample], np.float64))
    if network.constant is not None:
        return docs.select(F.col(key), F.unhex(F.md5(F.col(text).cast("binary"))).alias("digest"), F.lit(network.constant).alias("score"))
    first, offset = network.first_layer()

    def answer(p: int, rows: dict) -> Iterator[tuple]:
        keys, total, places = merged(rows)
        value = projected(keys, total, first.astype(np.float32))
        for k, at in places.items():
            yield k % parts, ("answer", k, p, pack(value[at]))

    def pool(p: int, rows: dict) -> Iterator[tuple]:
        by: dict[int, list] = {}
        for x in rows.get("answer", []):
            by.setdefault(x[1], []).append((x[2], x[3]))
        for _, k, blob, keys, digests in rows.get("rows", []):
            values = [unpack(b)[0] for _, b in sorted(by.pop(k, []))]
            h = pooled(blob, np.concatenate(values) if values else np.zeros((1, HIDDEN), np.float16)) + offset
            yield from zip(keys, digests, network.score_hidden(h).tolist(), strict=True)

    out = T.StructType([T.StructField(key, kind), T.StructField("digest", T.BinaryType()), T.StructField("score", T.DoubleType())])
    answers = dealt.mapPartitions(lambda rows: kinds(only(rows, "words"), answer))
    return spark.createDataFrame(dealt.union(deal(answers, parts)).mapPartitions(lambda rows: kinds(only(rows, "rows", "answer"), pool)), out)


def merged(rows: dict) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """A partition's words and context vectors, and the places in them of each slice's words."""
    each = {x[1]: unpack(x[2])[0] for x in rows.get("words", [])}
    each = {k: unpack_sorted(x) for k, x in each.items()}
    keys = np.unique(np.concatenate(list(each.values()))) if each else np.empty(0, np.uint64)
    total, places = np.zeros((len(keys), DIM), np.int64), {}
    for x in rows.pop("words", []):
        places[x[1]] = np.searchsorted(keys, each[x[1]])
        total[places[x[1]]] += unpack_rows(x[2], DIM)[1]
    return keys, total, places


def _digest(text: Column) -> Column:
    return F.coalesce(F.unhex(F.md5(text.cast("binary"))), F.lit(b""))


@any_names("text")
def score_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, threshold: float = THRESHOLD, max_train: int = MAX_TRAIN) -> DataFrame:
    """All rows and columns of docs with held_out, score and predicted: the scores are joined to the rows by their texts."""
    scores = score_texts(docs, labels, key, text, label, folds, max_train)
    held, score, predicted, own, other = (free_name(docs.columns, n) for n in ("held_out", "score", "predicted", "__digest", "__other"))
    scores = cut(scores.groupBy(F.coalesce("digest", F.lit(b"")).alias(other)).agg(F.first("score").alias(score)))
    done = docs.withColumn(own, _digest(F.col(text))).join(scores, F.col(own) == F.col(other)).drop(own, other)
    return done.withColumns({held: held_out(F.col(key), folds), predicted: (F.col(score) >= threshold).cast("int")})


@any_names("text")
def keep_accepted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, threshold: float = THRESHOLD, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of docs with a score of at least threshold. A bitmap of rejected texts lets most of the others pass without a shuffle."""
    scores = score_texts(docs, labels, key, text, label, folds, max_train)
    own, hit = free_name(docs.columns, "__digest"), free_name(docs.columns, "__hit")
    rejected = cut(scores.filter(F.col("score") < threshold).select(F.coalesce("digest", F.lit(b"")).alias(own)).distinct())
    marked = maybe_in(docs.withColumn(own, _digest(F.col(text))), F.col(own), bitmap(rejected, F.col(own)), hit)
    return marked.filter(~F.col(hit)).unionByName(marked.filter(F.col(hit)).join(rejected, own, "left_anti")).select(*docs.columns)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return score_texts(docs, labels).select("doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
