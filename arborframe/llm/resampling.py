"""Importance resampling to a target distribution, over bucket-partitioned inverted postings.

1. A document's features are its runs of 1 to `n` words; a feature's bucket is
   the crc32 of its bytes modulo `buckets`. Each task turns slices of texts
   into postings (bucket, document, count), one for each bucket of a document, packed by
   range of buckets: rows (slice, part, postings), PARTS of them a slice.
2. Postings are shuffled by (part, salt); the number of salts grows with the
   number of slices, so that a range whose buckets everybody has is as many tasks
   as its size needs. Both corpora's counts meet by bucket, summed in each task first (a
   table of `buckets` rows at most, whatever the input), and give each bucket's gain
   floor(1000 ln((t + 1) (S + buckets) / ((s + 1) (T + buckets)))); a range's gains
   meet its postings in the join on (part, salt).
3. There each slice's postings become contributions, count times gain summed by
   document, which are shuffled by slice and added up: the weight of a
   document is the floored mean over its features.
4. Gumbel noise from a hash of seed and key is added; the highest scores are a
   weighted sample without replacement. Scores are whole numbers of a narrow range, so a
   histogram gives the cut and the rows above each score; a row number inside each
   score gives the rank. No task orders the whole table.

Defined cases: a null or wordless text has no features, weight 0, and isn't
drawn; a null key gives a null score and is not drawn, nor counted among those
drawn from, though its words count; every row is a document, so repeated rows
count and may be drawn each, and ties of score and key are ordered by their
further results; very long texts are a slice of their own, in whole. An empty target gives gains from
its zero counts; an empty table gives an empty result. Further columns are not
read; a result named like the key gets a trailing underscore.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, free_name, quoted, slices
from .packing import pack, small, unpack, unzigzag, zigzag
from .textscan import ALNUM, Words, scan
from .vectors import edges, whole_groups

BUCKETS, SHARE, LEAST_WORDS, SEED = 10_000, 0.1, 20, 2024
#: Ranges of buckets; slices of texts in bytes; slices whose postings make one task.
PARTS, SLICE, SLICES_A_TASK = 16, 4 << 20, 64
_LONG = 64


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)  # the polynomial of crc32, reflected
    return t


_CRC = _table()


def crc_on(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of what state is the crc32 of, followed by data[start:end]; byte by byte for all spans at once."""
    size = ends - starts
    out = ~state.astype(np.uint32)
    order = np.argsort(-np.minimum(size, _LONG + 1), kind="stable")
    long = order[: np.searchsorted(-size[order], -_LONG, "left")]
    rest = order[len(long) :]
    crc, at, left = out[rest], starts[rest], size[rest]
    for k in range(int(left.max(initial=0))):
        n = int(np.searchsorted(-left, -k, "left"))  # spans of more than k bytes
        crc[:n] = _CRC[(crc[:n] ^ data[at[:n] + k]) & np.uint32(0xFF)] ^ (crc[:n] >> np.uint32(8))
    out[rest] = crc
    for i in long:
        out[i] = ~np.uint32(zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(~out[i])))
    return ~out


def features(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """crc32 and row of all runs of 1 to n words joined by one space."""
    crc, doc = crc_on(np.zeros(len(words.starts), np.uint32), words.data, words.starts, words.ends), words.doc
    found, rows, space = [crc], [doc], np.frombuffer(b" ", np.uint8)
    for k in range(1, n):
        more = np.flatnonzero(words.doc[: max(0, len(words.doc) - k)] == words.doc[k:]) if len(words.doc) > k else np.empty(0, np.int64)
        # crc holds the runs of k words by their first word
        runs = crc[np.searchsorted(first, more)] if k > 1 else crc[more]
        first = more
        runs = crc_on(runs, space, np.zeros(len(more), np.int64), np.ones(len(more), np.int64))
        crc = crc_on(runs, words.data, words.starts[more + k], words.ends[more + k])
        found.append(crc)
        rows.append(words.doc[more])
    return np.concatenate(found), np.concatenate(rows)


def postings(df: DataFrame, key: str, text: str, n: int, buckets: int) -> DataFrame:
    """(slice, part, blob, keys, features, words): a slice's postings in a range of buckets (part 0 and up), or its documents (part -1)."""
    width = -(-buckets // PARTS)
    rows = df.select(quoted([key])[0].alias("key"), quoted([text])[0].cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                words = scan(batch.column("text"), ALNUM, hashed=False)
                crc, doc = features(words, n)
                many, long = (np.bincount(x, minlength=batch.num_rows) for x in (doc, words.doc))
                where, count = np.unique((crc % np.uint32(buckets)).astype(np.int64) * batch.num_rows + doc, return_counts=True)
                bucket, doc = np.divmod(where, batch.num_rows)
                at = np.searchsorted(bucket, np.arange(PARTS + 1) * width)
                blobs, parts = [None], [-1]
                for p in range(PARTS):
                    a, b = at[p], at[p + 1]
                    if b > a:
                        # a part's postings by bucket, then document: numbers in each bucket, steps between documents
                        step = np.where(np.diff(bucket[a:b], prepend=-1) != 0, doc[a:b], np.diff(doc[a:b], prepend=0))
                        blobs.append(pack(small(np.bincount(bucket[a:b] - p * width, minlength=width)), small(step), small(count[a:b])))
                        parts.append(p)
                none = [None] * (len(parts) - 1)
                key_type, ids = batch.column("key").type, batch.column("key")
                keys = pa.ListArray.from_arrays(pa.array([0, len(ids), *[len(ids)] * len(none)], pa.int32()), ids)
                schema = pa.schema([("slice", pa.int64()), ("part", pa.int32()), ("blob", pa.binary()), ("keys", pa.list_(key_type)), ("features", pa.list_(pa.int64())), ("words", pa.list_(pa.int64()))])
                columns = [pa.array([(task << 32) + k] * len(parts), pa.int64()), pa.array(parts, pa.int32()), pa.array(blobs, pa.binary()), keys, pa.array([many.tolist(), *none], pa.list_(pa.int64())), pa.array([long.tolist(), *none], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
                k += 1

    return cut(rows.mapInArrow(run, f"slice long, part int, blob binary, keys array<{kind}>, features array<long>, words array<long>"))


def _opened(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket in its range, document in its slice and count of each posting."""
    many, step, count = unpack(blob)
    many = many.astype(np.int64)
    first = (np.cumsum(many) - many)[many > 0]
    doc = np.cumsum(step, dtype=np.int64)
    doc -= np.repeat(doc[first] - step[first].astype(np.int64), many[many > 0])
    return np.repeat(np.arange(len(many)), many), doc, count.astype(np.int64)


def bucket_counts(posted: DataFrame, buckets: int, name: str) -> DataFrame:
    """(bucket, name): features in each bucket that occurs."""
    width = -(-buckets // PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PARTS * width, np.int64)
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                bucket, _, count = _opened(blob)
                np.add.at(total, part * width + bucket, count)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])

    return posted.filter("part >= 0").select("part", "blob").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias(name))


def gains(raw: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(part, gains): the gains of each range's buckets, in order. raw, target: postings."""
    width = -(-buckets // PARTS)
    both = cut(bucket_counts(raw, buckets, "s").join(bucket_counts(target, buckets, "t"), "bucket", "full").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")))
    all_s, all_t = both.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()

    def gain(s: int, t: int) -> int:
        return math.floor(1000 * math.log(float(t + 1) * float(all_s + buckets) / (float(s + 1) * float(all_t + buckets))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("bucket"), pa.array([gain(s, t) for s, t in zip(b.column("s").to_pylist(), b.column("t").to_pylist(), strict=True)], pa.int64())], names=["bucket", "gain"])

    told = both.mapInArrow(run, "bucket int, gain long")
    ranges = told.withColumn("part", F.floor(F.col("bucket") / width).cast("int")).groupBy("part")
    return ranges.agg(F.collect_list(F.struct((F.col("bucket") % width).alias("at"), "gain")).alias("gains"))


def contributions(posted: DataFrame, gained: DataFrame, buckets: int) -> DataFrame:
    """(slice, blob): what a range of buckets adds to each of a slice's documents."""
    width = -(-buckets // PARTS)
    salts = max(1, -(-posted.filter("part = -1").count() // SLICES_A_TASK))
    # both sides are dealt by the range of buckets and the salt, so that no range is one task
    dealt = posted.filter("part >= 0").select("slice", "part", "blob", F.pmod(F.xxhash64("slice"), F.lit(salts)).alias("salt")).repartition(PARTS * salts, "part", "salt")
    table = gained.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for blob, told in zip(b.column("blob").to_pylist(), b.column("gains"), strict=True):
                gain = np.zeros(width, np.int64)
                told = told.values
                gain[told.field("at").to_numpy(zero_copy_only=False)] = told.field("gain").to_numpy(zero_copy_only=False)
                bucket, doc, count = _opened(blob)
                sums = np.zeros(int(doc.max()) + 1, np.int64)
                np.add.at(sums, doc, count * gain[bucket])
                out.append(pack(zigzag(sums)))
            yield pa.RecordBatch.from_arrays([b.column("slice"), pa.array(out, pa.binary())], names=["slice", "blob"])

    return dealt.join(table, ["part", "salt"]).select("slice", "blob", "gains").mapInArrow(run, "slice long, blob binary")


def weights(df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_key: str = "item_id", target_text: str = "text", n: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(key, n_features, n_words, weight), a row for each row of df."""
    posted = postings(df, key, text, n, buckets)
    parts = contributions(posted, gains(posted, postings(target, target_key, target_text, n, buckets), buckets), buckets)
    kind = posted.schema["keys"].dataType.elementType.simpleString()
    docs = posted.filter("part = -1").select("slice", F.lit(0).alias("order"), F.lit(None).cast("binary").alias("blob"), "keys", "features", "words")
    rows = docs.unionByName(parts.withColumn("order", F.lit(1)), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(batches, ["slice"]):
            for a in at[:-1]:
                b = at[np.searchsorted(at, a) + 1]
                many, long = (table.column(c)[a].values.to_numpy() for c in ("features", "words"))
                sums = np.zeros(len(many), np.int64)
                for blob in table.column("blob").slice(a + 1, b - a - 1).to_pylist():
                    x = unzigzag(unpack(blob)[0])
                    sums[: len(x)] += x
                yield pa.RecordBatch.from_arrays([table.column("keys")[a].values, pa.array(many), pa.array(long), pa.array(np.where(many > 0, sums // np.maximum(many, 1), 0))], names=["key", "n_features", "n_words", "weight"])

    return rows.repartition("slice").sortWithinPartitions("slice", "order").mapInArrow(run, f"key {kind}, n_features long, n_words long, weight long")


def ranked(scored: DataFrame, share: float, least_words: int) -> DataFrame:
    """scored (key, n_features, n_words, weight, score) with rank: 1, 2, 3, ... of the highest share, by score, then key; else null."""
    may = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    per = scored.filter(may).groupBy("score").agg(F.count("*").alias("rows"))
    # scores are whole numbers within some 10^5 of each other, which bounds this table whatever the input
    above = cut(per.withColumn("above", F.sum("rows").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1))).select("score", "rows", F.coalesce("above", F.lit(0)).alias("above")))
    drawn = math.floor(share * above.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0] + 1e-9)
    place = Window.partitionBy("score").orderBy("key", "n_features", "weight")
    marked = scored.join(F.broadcast(above.filter(F.col("above") < drawn).select("score", "above")), "score", "left")
    high = F.coalesce(may, F.lit(False)) & F.col("above").isNotNull()
    rank = F.col("above") + F.row_number().over(place)
    top = marked.filter(high).withColumn("rank", F.when(rank <= drawn, rank).cast("long"))
    return top.unionByName(marked.filter(~high).withColumn("rank", F.lit(None).cast("long"))).drop("above")


def resample(
    df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_key: str = "item_id", target_text: str = "text",
    n: int = 1, buckets: int = BUCKETS, share: float = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED,
) -> DataFrame:
    """One row per row of df: key, n_features, weight, score, rank (null: not drawn)."""
    told = weights(df, target, key, text, target_key, target_text, n, buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = cut(told.withColumn("score", (F.col("weight") + noise).cast("long")))
    out = ranked(scored, share, least_words)
    return out.select(F.col("key").alias(key), *[F.col(c).alias(free_name([key], c)) for c in ("n_features", "weight", "score", "rank")])


def op13_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP13_SQL = r"""
WITH crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS c FROM range(256) AS r(i))),
raw AS (SELECT 0 AS corpus, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
words AS (SELECT corpus, id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM raw),
n AS (SELECT corpus, id, w, count(*) AS n FROM words GROUP BY ALL),
hexed AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM n)),
b AS (
  SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(length(h) // 2), lambda k: CAST('0x' || h[2 * k + 1 : 2 * k + 2] AS BIGINT))),
         lambda a, x: xor(a // 256, t[xor(a % 256, x) + 1])), 4294967295) % 10000 AS bucket FROM hexed, crc),
p AS (SELECT corpus, id, bucket, CAST(sum(n) AS BIGINT) AS n FROM n JOIN b USING (w) GROUP BY ALL),
c AS (SELECT bucket, CAST(coalesce(sum(n) FILTER (corpus = 0), 0) AS BIGINT) AS s, CAST(coalesce(sum(n) FILTER (corpus = 1), 0) AS BIGINT) AS t FROM p GROUP BY bucket),
a AS (SELECT CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t FROM c),
g AS (SELECT bucket, CAST(floor(1000 * ln(CAST(c.t + 1 AS DOUBLE) * (a.s + 10000) / (CAST(c.s + 1 AS DOUBLE) * (a.t + 10000)))) AS BIGINT) AS gain FROM c, a),
w AS (SELECT id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * gain) AS BIGINT) AS gained FROM p JOIN g USING (bucket) WHERE corpus = 0 GROUP BY id),
d AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN gained // n - CASE WHEN gained % n < 0 THEN 1 ELSE 0 END ELSE 0 END AS weight,
         CAST(CAST('0x' || sha256('2024:' || doc_id)[1:8] AS BIGINT) AS DOUBLE) AS h FROM documents LEFT JOIN w ON id = doc_id),
s AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM d),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s WHERE n_features >= 20)
SELECT s.doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, score,
       CASE WHEN rank <= (SELECT count(*) // 10 FROM r) THEN rank END AS rank FROM s LEFT JOIN r USING (doc_id)
"""
