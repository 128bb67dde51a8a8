import numpy as np
import pytest

from arborframe.llm import top_k as k


def brute(ids, x, every, n):
    out = []
    for i, q in zip(ids, x, strict=True):
        if i % every == 0:
            all_ = sorted((-int(q @ c), j) for j, c in zip(ids, x, strict=True) if j != i)[:n]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(all_)]
    return sorted(out)


@pytest.mark.parametrize("spread", [3, 300])
def test_by_brute_force(spark, spread, monkeypatch):
    monkeypatch.setattr(k, "SHARD_ROWS", 150)
    monkeypatch.setattr(k, "BLOCK_ROWS", 10)
    monkeypatch.setattr(k, "LEAF", 8)
    r = np.random.default_rng(1)
    x = r.integers(-spread, spread + 1, (500, 8))
    df = spark.createDataFrame([(i, (v / 256).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, k.top_k(df, every=10).collect()))
    assert got == brute(list(range(500)), x, 10, 5)


def test_edges(spark):
    rows = [(0, [1.0, 2.0]), (50, [1.0, None]), (100, None), (150, [float("nan"), 1.0]), (200, [float("inf"), 1.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0]), (None, [1.0, 1.0]), (250, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as score", "2 as rank")
    got = sorted(map(tuple, k.top_k(df).collect()))
    assert got == [(0, 1, 1, 5 * 65536), (0, 2, 2, 5 * 65536)]
    assert k.top_k(df.limit(0)).count() == 0
    huge = spark.createDataFrame([(0, [3e15, 1.0]), (1, [2.0, 3.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in k.top_k(huge).orderBy("rank").collect()] == [1, 2]
