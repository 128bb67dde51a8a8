import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from arborframe.llm import katz


def brute(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tok = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)) + ["\0end"] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    uc = Counter(w for t, h in zip(tok, held, strict=True) if not h for w in t)
    grams = [list(zip(["\0begin", "\0begin", *t], ["\0begin", *t], t, strict=False)) for t in tok]
    tc = Counter(g for x, h in zip(grams, held, strict=True) if not h for g in x)
    bc = Counter(g[1:] for x, h in zip(grams, held, strict=True) if not h for g in x)
    hist = lambda c: np.array([0] + [sum(1 for x in c.values() if x == r) for r in range(1, 7)])
    n, uni = sum(uc.values()), katz.Unigrams(sum(uc.values()), len(uc), hist(uc))
    d = {1: katz.discounts(hist(bc)), 2: katz.discounts(hist(tc))}
    one = lambda w: uni.p(np.array([uc.get(w, 0)]))[0]
    after = defaultdict(dict)
    for (u, v, w), c in tc.items():
        after[u, v][w] = c
    for (v, w), c in bc.items():
        after[v,][w] = c
    weights = {}

    def p(history, w):
        """Recursively: the n-gram's discounted share, or the history's weight times the shorter history's probability."""
        if not history:
            return one(w)
        seen = after.get(history)
        if not seen:
            return p(history[1:], w)
        if history not in weights:
            kept = sum(d[len(history)][min(c, 6)] * c for c in seen.values())
            total = sum(seen.values())
            total += total - kept <= 1e-9 * total
            weights[history] = total, (1 - kept / total) / (1 - sum(p(history[1:], x) for x in seen))
        total, weight = weights[history]
        return d[len(history)][min(seen[w], 6)] * seen[w] / total if w in seen else weight * p(history[1:], w)

    out = []
    for (i, _), t, h in zip(rows, tok, held, strict=True):
        base = sum(math.log10((uc.get(w, 0) + 0.1) / (n + 0.1 * (len(uc) + 1))) for w in t) if n else 0.0
        out.append((i, h, len(t), sum(w in uc for w in t), n, base, sum(math.log10(p((a, b), w)) for a, b, w in zip(["\0begin", "\0begin", *t], ["\0begin", *t], t, strict=False))))
    sums = [sum(p(h, w) for w in uc) + p(h, "\0other") for h in [*list(after)[:30], *list(after)[-10:], ("\0none",), ("\0none", "\0none")]]
    return out, sums


@pytest.mark.parametrize("small", [False, True])
def test_by_brute_force(spark, edge, edge_rows, monkeypatch, small):
    if small:  # many slices, partitions and frequent histories
        monkeypatch.setattr(katz, "SLICE_BYTES", 2000)
        monkeypatch.setattr(katz, "PARTITION_BYTES", 1000)
    rows = [(r[0], r[1]) for r in edge_rows] + [(100 + i, f"the old the new the hill {i % 7} the Old {'far ' * (i % 5)}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, katz.score_texts(df).collect()), key=str)
    want, sums = brute(rows)
    assert sums == pytest.approx([1] * len(sums))
    for g, w in zip(got, sorted(want, key=str), strict=True):
        assert g[0] == w[0]
    by = lambda x: sorted(x, key=lambda r: (str(r[0]), r[2], r[3], round(r[5], 6)))
    for g, w in zip(by(got), by(want), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


def test_nothing_to_learn_from(spark, nothing):
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    got = katz.score_texts(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert [tuple(r) for r in got] == [(held, True, 3, 0, 0, 0.0, 0.0)]
    assert katz.score_texts(nothing).count() == 0
