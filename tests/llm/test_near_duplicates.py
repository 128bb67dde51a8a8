import numpy as np
import pyarrow as pa

from arborframe.llm import near_duplicates as nd
from tests.llm.conftest import prose


def brute(rows, threshold=0.8):
    """doc -> class by union of all pairs; rows: (id, text)."""
    element, doc, _, n = nd.elements(pa.array([t for _, t in rows], pa.string()))
    sets = [set(element[doc == i].tolist()) for i in range(n)]
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            common = len(sets[i] & sets[j])
            same = rows[i][1] is not None and rows[i][1] == rows[j][1]
            if same or (common and common >= threshold * (len(sets[i]) + len(sets[j]) - common) - 1e-9):
                up[find(i)] = find(j)
    groups = {}
    for i in range(n):
        groups.setdefault(find(i), []).append(i)
    return {frozenset(g) for g in groups.values()}


def family(n, size, edits, seed):
    r = np.random.default_rng(seed)
    base = prose(size, seed).split()
    out = []
    for _ in range(n):
        w = list(base)
        for k in r.integers(0, size, r.integers(0, edits + 1)):
            w[k] = f"new{r.integers(0, 10**6)}"
        out.append(" ".join(w))
    return out


def test_classes_by_brute_force(spark):
    texts = family(60, 120, 6, 3) + family(40, 40, 2, 4) + [prose(50, 100 + i) for i in range(20)]
    passage = prose(60, 999)
    texts += [passage + " " + prose(60, 200 + i) for i in range(30)] + ["same text"] * 5 + ["a b c", "A, b. c!", "a b d", "", "", None, None]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert len(got) == len(rows)
    mine = {frozenset(g["doc_id"]) for _, g in got.groupby("class_id")}
    assert mine == brute(rows)
    assert (got.groupby("class_id")["doc_id"].min() == got.groupby("class_id").size().index).all()
    assert (got.groupby("class_id")["class_size"].first() == got.groupby("class_id").size()).all()


def test_signatures_estimate_weighted_similarity():
    a = prose(400, 1).split()
    b = a[:300] + prose(100, 2).split()
    texts = pa.array([" ".join(a), " ".join(b)])
    element, doc, weight, _ = nd.elements(texts)
    w = [dict(zip(element[doc == i].tolist(), weight[doc == i].tolist(), strict=True)) for i in (0, 1)]
    keys = set(w[0]) | set(w[1])
    true = sum(min(w[0].get(k, 0), w[1].get(k, 0)) for k in keys) / sum(max(w[0].get(k, 0), w[1].get(k, 0)) for k in keys)
    signature, has = nd.signatures(*nd.elements(texts))
    assert has.all() and abs((signature[0] == signature[1]).mean() - true) < 4 * (true * (1 - true) / nd.K) ** 0.5


def test_edges(edge, nothing):
    got = nd.near_duplicates(edge).toPandas()
    assert len(got) == edge.count()
    kept = nd.deduplicate(edge).toPandas()
    assert set(kept.columns) == set(edge.columns)
    # one of the copies, one of the empty texts, both nulls
    assert sorted(kept["doc_id"].dropna()) == [1, 3, 5, 6, 7, 8, 9, 10] and kept["text"].isna().sum() == 2
    assert nd.near_duplicates(nothing).count() == 0 and nd.deduplicate(nothing).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 9), (9, 8), (8, 7), (7, 6), (20, 21), (21, 20)]
    df = spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in links], "a binary, b binary")
    got = {r["node"][0]: r["root"][0] for r in nd.components(df).collect()}
    assert got == {2: 1, 3: 1, 7: 6, 8: 6, 9: 6, 10: 6, 21: 20}


def test_copies_that_repeat_a_line(spark):
    rows = []
    for k in range(12):
        base, line = prose(204, 5000 + k), prose(60, 7000 + k)
        rows += [(4 * k + j, " ".join([base, *[line] * n])) for j, n in enumerate((1, 8, 64, 512))]
    # signatures follow the sets, whatever the repeats: the four have similarities of 0.98 and more
    signature, has = nd.signatures(*nd.elements(pa.array([t for _, t in rows])))
    assert has.all()
    for k in range(12):
        assert min((signature[4 * k] == signature[4 * k + j]).mean() for j in (1, 2, 3)) > 0.85
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert {frozenset(g["doc_id"]) for _, g in got.groupby("class_id")} == brute(rows) == {frozenset(range(4 * k, 4 * k + 4)) for k in range(12)}


def similar_pairs(texts, threshold=0.8):
    """All pairs (i, j) of texts with a Jaccard similarity of the threshold or more, by an exact prefix join over sets of five words read by a pattern."""
    import re
    from collections import Counter, defaultdict

    sets = []
    for t in texts:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))})  # fewer words are one shingle
    often = Counter(x for s in sets for x in s)
    index, found = defaultdict(list), set()
    for j, s in enumerate(sets):
        first = sorted(s, key=lambda x: (often[x], x))[: len(s) - int(np.ceil(threshold * len(s) - 1e-9)) + 1]
        for i in {i for x in first for i in index[x]}:
            common = len(s & sets[i])
            if common >= threshold * (len(s) + len(sets[i]) - common) - 1e-9:
                found.add((i, j))
        for x in first:
            index[x].append(j)
    return found


def recall(spark, sf):
    """Pairs of the whole table of documents at 0.8 or more, how many of them are in one class, and whether the classes are just what those pairs and equal texts connect."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").toPandas()
    of = nd.op4_near_duplicates(spark, sf).toPandas().set_index("doc_id")["class_id"]
    label = of.loc[docs["doc_id"]].to_numpy()
    pairs = similar_pairs(docs["text"])
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    same = docs.groupby("text").indices
    for i, j in [*pairs, *((g[0], x) for g in same.values() for x in g[1:])]:
        up[find(i)] = find(j)
    mine, want = {}, {}
    for i, c in enumerate(label):
        mine.setdefault(c, []).append(i)
        want.setdefault(find(i), []).append(i)
    return len(pairs), sum(label[i] == label[j] for i, j in pairs), {*map(tuple, mine.values())} == {*map(tuple, want.values())}


def test_recall_on_the_whole_table(spark, sf):
    n, found, exact = recall(spark, sf)
    assert n > 0 and found == n and exact
