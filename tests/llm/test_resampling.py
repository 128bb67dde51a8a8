import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from arborframe.llm import resampling as s
from arborframe.llm.textscan import ALNUM, scan

from .conftest import SCHEMA, prose

LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def bags(texts, n, buckets):
    out = []
    for t in texts:
        w = words(t)
        out.append(Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)))
    return out


def brute(rows, target, n=1, buckets=s.BUCKETS, share=s.SHARE, least=s.LEAST_WORDS):
    """rows: (key, text). Sorted (key, n_features, weight, score, rank)."""
    mine, theirs = bags([t for _, t in rows], n, buckets), bags(target, n, buckets)
    raw, goal = sum(mine, Counter()), sum(theirs, Counter())
    a, b = sum(raw.values()), sum(goal.values())
    gain = {k: math.floor(1000 * math.log((goal[k] + 1) * (a + buckets) / ((raw[k] + 1) * (b + buckets)))) for k in raw}
    out = []
    for (key, text), bag in zip(rows, mine, strict=True):
        many = sum(bag.values())
        weight = sum(c * gain[k] for k, c in bag.items()) // many if many else 0
        h = None if key is None else int(hashlib.sha256(f"2024:{key}".encode()).hexdigest()[:8], 16)
        out.append([key, many, weight, None if h is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    may = sorted((o for o in out if o[5] >= least and o[3] is not None), key=lambda o: (-o[3], o[0], o[1], o[2]))
    for i, o in enumerate(may[: math.floor(share * len(may) + 1e-9)]):
        o[4] = i + 1
    return sorted((tuple(o[:5]) for o in out), key=str)


def got(df, target, **options):
    return sorted((tuple(r) for r in s.resample(df, target, **options).collect()), key=str)


@pytest.mark.parametrize(("n", "buckets"), [(1, 10_000), (3, 97)])
def test_by_brute_force(spark, monkeypatch, n, buckets):
    monkeypatch.setattr(s, "SLICE", 4000)
    monkeypatch.setattr(s, "SLICES_A_TASK", 2)
    rows = [(i, prose(5 + 7 * (i % 9), i) + " Ünïcode ABC,def" * (i % 3)) for i in range(150)]
    target = [prose(30, 1000 + i) + " wanted rare stuff" for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    goal = spark.createDataFrame(list(enumerate(target)), "item_id long, text string")
    assert got(df, goal, n=n, buckets=buckets, share=0.3) == brute(rows, target, n, buckets, 0.3)


def test_edges(spark, edge, edge_rows, nothing):
    goal = spark.createDataFrame([(1, prose(40, 1)), (2, None), (3, ""), (None, "x y z")], "item_id long, text string").selectExpr("*", "1 as slice")
    df = edge.withColumnRenamed("lang", "slice").withColumnRenamed("source", "a.b")
    rows = [(r[0], r[1]) for r in edge_rows]
    assert got(df, goal, share=0.5) == brute(rows, [prose(40, 1), None, "", "x y z"], share=0.5)
    assert got(nothing, goal) == []
    assert got(df, goal.limit(0), share=1.0) == brute(rows, [], share=1.0)
    named = s.resample(df.withColumnRenamed("score", "old").withColumnRenamed("doc_id", "score"), goal, key="score")
    assert named.columns == ["score", "n_features", "weight", "score_", "rank"]
    assert spark.createDataFrame([], SCHEMA).count() == 0


def test_crc():
    r = np.random.default_rng(1)
    texts = ["".join(r.choice(list("abcxyz019éß語")) for _ in range(k)) for k in [1, 2, 3, 7, 8, 63, 64, 65, 66, 500, 5, 64]]
    w = scan(pa.array(texts), ALNUM, hashed=False)
    crc, doc = s.features(w, 1)
    assert crc.tolist() == [zlib.crc32(t.encode()) for t in texts] and doc.tolist() == list(range(len(texts)))
    crc, doc = s.features(scan(pa.array(["a b c", "d", "e f"]), ALNUM, hashed=False), 3)
    assert sorted(zip(doc.tolist(), crc.tolist(), strict=True)) == sorted((d, zlib.crc32(t.encode())) for d, t in [(0, "a"), (0, "b"), (0, "c"), (0, "a b"), (0, "b c"), (0, "a b c"), (1, "d"), (2, "e"), (2, "f"), (2, "e f")])
