import re
import zlib

import numpy as np

from arborframe.llm import quality
from tests.llm.conftest import prose


def test_held_out_accuracy_and_no_leak(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    labels = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet")
    got = quality.score_quality(docs, labels)
    x = got.join(labels, "doc_id").filter("held_out").toPandas()
    assert (x["predicted"] == x["quality"]).mean() >= 0.95
    # calibrated: better than the rate alone, and the mean probability is near the rate
    p, y = x["score"].clip(1e-6, 1 - 1e-6).to_numpy(), x["quality"].to_numpy()
    rate = y.mean()
    assert -np.log(np.where(y == 1, p, 1 - p)).mean() < -0.5 * (rate * np.log(rate) + (1 - rate) * np.log(1 - rate))
    assert abs(p.mean() - rate) < 0.08
    assert got.count() == docs.count()
    # labels of the held-out fold change nothing
    other = labels.selectExpr("doc_id", "IF(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - quality, quality) AS quality")
    again = quality.score_quality(docs, other).toPandas().set_index("doc_id")["score"]
    mine = got.toPandas().set_index("doc_id")["score"]
    assert np.allclose(mine.sort_index(), again.sort_index())


def brute(rows, labels, hashes):
    """Scores of (id, text) by dictionaries of words and loops over tokens; the network is the same."""
    import pyarrow as pa

    split = [re.findall(r"[A-Za-z\x80-\U0010ffff]+|[0-9]+|[^A-Za-z0-9\s\x80-\U0010ffff]+", t or "") for _, t in rows]
    words = sorted({w for ws in split for w in ws})
    found = quality.runs(pa.array(words))
    place, sign = (dict(zip(words, x.tolist(), strict=True)) for x in quality.index_vectors(found.hashes))
    context = {w: np.zeros(quality.DIM) for w in words}
    index = {w: np.zeros(quality.DIM) for w in words}
    for w in words:
        for p, s in zip(place[w], sign[w], strict=True):
            index[w][p] += s
    for ws in split:
        for a, b in zip(ws, ws[1:], strict=False):
            context[a] += index[b]
            context[b] += index[a]
    unit = lambda v: v / max(np.sqrt((v**2).sum()), 1e-9)
    vector = {w: np.concatenate([unit(context[w]), unit(index[w]), [unit(context[w]) @ unit(index[w])]]) for w in words}
    x = np.array([np.mean([vector[w] for w in ws], 0) if ws else np.zeros(quality.WIDTH) for ws in split])
    own = sorted((hashes[i], y, at) for i, y in labels for at, (k, _) in enumerate(rows) if k == i and zlib.crc32(str(i).encode()) % 5)
    net = quality.Network(x[[at for _, _, at in own]].astype(np.float32).astype(np.float64), np.array([y for _, y, _ in own], float))
    return net.score(x)


def test_scores_by_brute_force(spark):
    rows = [(i, prose(30 + i % 17, i)) if i % 3 else (i, " ".join(["spam!!", f"x{i}"] * (5 + i % 7))) for i in range(240)] + [(240, None), (241, "")]
    labels = [(i, int(i % 3 > 0)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    hashes = {r[0]: r[1] for r in docs.selectExpr("doc_id", "xxhash64(doc_id)").collect()}
    got = quality.score_texts(docs, spark.createDataFrame(labels, "doc_id long, quality int")).toPandas().set_index("doc_id")["score"]
    assert np.allclose(got.loc[[i for i, _ in rows]].to_numpy(), brute(rows, labels, hashes), atol=0.02)


def test_kept_rows(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    kept = quality.keep_accepted(docs, labels)
    assert kept.columns == docs.columns
    want = quality.score_quality(docs, labels).filter("predicted = 1").select(*docs.columns)
    assert kept.exceptAll(want).isEmpty() and want.exceptAll(kept).isEmpty()


def test_edges(spark, edge, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 0), (8, None), (None, 1), (99, 0), (6, 3)], "doc_id long, quality int")
    got = quality.score_quality(edge, labels).toPandas()
    assert len(got) == edge.count() and got["score_"].between(0, 1).all() and got["score"].eq(0.5).all()
    assert got["score_"][got["text"].isna()].nunique() == 1
    assert quality.score_quality(edge, labels.limit(0)).toPandas()["score_"].eq(0.5).all()
    assert quality.score_quality(nothing, labels).count() == 0


def test_temperature_keeps_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] + 0.3 * rng.normal(size=400) > 0).astype(float)
    net = quality.Network(x, y)
    s = net.score(x)
    assert ((s > 0.5) == (y == 1)).mean() > 0.9
    net.temperature *= 2
    assert (np.argsort(net.score(x)) == np.argsort(s)).mean() > 0.9


def test_words_are_projected_in_parts():
    import tracemalloc

    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 50_000).astype(np.uint64)
    context, by = rng.integers(-9, 9, (len(keys), quality.DIM)), rng.normal(size=(quality.WIDTH, quality.HIDDEN)).astype(np.float32)
    tracemalloc.start()
    value = quality.projected(keys, context, by)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(value, quality.word_vectors(context, keys) @ by, atol=1e-2) and peak < context.nbytes


def test_a_slice_takes_few_times_its_text():
    import tracemalloc

    import pyarrow as pa

    from arborframe.llm.textscan import first_of_doc, runs

    rng = np.random.default_rng(1)
    words = np.array([f"w{i:x}" for i in range(20_000)])
    texts = pa.array([*(" ".join(words[rng.integers(0, len(words), n)]) for n in rng.integers(0, 4_000, 300)), None, "", "x" * 3_000_000, "a-1"])
    tracemalloc.start()
    made = quality.Slice(texts, 7)
    quality.contexts(made.word, made.doc, made.keys)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    found = runs(texts)
    assert (made.keys[made.word] == found.hashes).all() and (made.doc == found.doc).all() and (made.n == np.diff(first_of_doc(found))).all()
    assert peak < 20 * texts.nbytes
