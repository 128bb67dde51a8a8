import hashlib
import re

import numpy as np
import pytest

from arborframe.llm import decontamination as d


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def brute(docs, items, window=10):
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for k, x in items:
            x = words(x)
            n = min(len(x), window)
            for s in range(len(x) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == x[s : s + n]:
                        hit |= set(range(p, p + n))
                        found.add(str(k))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [2_000_000, 30])
def test_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(d, "BLOCK_WORDS", block)
    r = np.random.default_rng(2)
    text = lambda n: " ".join(r.choice(["a", "b", "C", "d1", "é"], n))
    items = [(i, text(int(r.integers(0, 25)))) for i in range(12)] + [(50, None), (51, "short One"), (52, "short, one")]
    docs = [(i, text(int(r.integers(0, 200)))) for i in range(30)] + [(i + 100, text(5) + ". " + items[i][1].upper() + " " + text(9)) for i in range(12)] + [(900, None), (901, ""), (902, "so short one it is"), (902, "so short one it is")]
    got = d.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).drop("text").collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items)


def test_suffix_array_and_longest_matches(spark):
    r = np.random.default_rng(3)
    w = r.integers(1, 4, 300).astype(np.uint64)
    order = d.suffix_array(w, 512)
    assert order.tolist() == sorted(range(300), key=lambda i: w[i:].tolist())
    docs = spark.createDataFrame([(1, "x y " + " ".join(map(str, range(30)))), (2, "nothing")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "q " + " ".join(map(str, range(5, 25))) + " z")], "item_id long, text string")
    best = d.matches(docs, items).orderBy("item_word").first()
    assert tuple(best) == ("7", 1, 20, 1, 7)


def test_edges(spark, edge, nothing):
    items = spark.createDataFrame([(1, "two words")], "item_id long, text string")
    got = d.decontaminate(edge.withColumnRenamed("size", "n_words"), items).toPandas()
    assert len(got) == edge.count() and got.loc[got["contaminated"], "doc_id"].tolist() == [8] and "n_words_" in got
    assert d.decontaminate(edge, items.limit(0)).filter("contaminated").count() == 0
    assert d.decontaminate(nothing, items).count() == 0
