import numpy as np
import pytest
from pyspark.sql import functions as F

from arborframe.llm import whitening as w

NAMES = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def brute(ids, x, components=32):
    """By numpy on the whole matrix in Python's exact integers; signs as they come."""
    n, sums = len(x), [sum(int(c) for c in column) for column in x.T]
    exact = [[n * int(c) - s for c, s in zip(row, sums, strict=True)] for row in x]
    centred = np.array(exact, float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    out = {}
    for k in range(min(components, x.shape[1])):
        z = centred @ axes[:, k] / np.sqrt(values[k])
        for i, row in enumerate(exact):
            out[ids[i], k + 1] = (n, sum(c * c for c in row), z[i], values[k] / values.sum())
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_against_numpy(spark, parts):
    r = np.random.default_rng(2)
    c = r.standard_normal((300, 6)) * [3, 1, 0.5, 0.2, 0.1, 0.05] + [5, -3, 0, 0, 2, 1]
    df = spark.createDataFrame([(i, v.astype(np.float32).tolist()) for i, v in enumerate(c)], "vec_id long, embedding array<float>").repartition(parts)
    got = w.whiten(df, w.scaled("embedding"), components=4).toPandas()
    x = np.floor(64 * c.astype(np.float32).astype(float)).astype(np.int64) + 1_000_000
    want = brute(range(300), x, 4)
    assert list(got.columns) == NAMES and len(got) == 1200 and got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
    for k in range(1, 5):
        mine = got[got["component"] == k].sort_values("vec_id")
        rest = [want[i, k] for i in range(300)]
        sign = np.sign(mine["whitened"].iloc[0] * rest[0][2])
        assert mine["deviation"].tolist() == [b for _, b, _, _ in rest] and mine["n"].eq(300).all()
        assert np.allclose(mine["whitened"] * sign, [z for _, _, z, _ in rest], rtol=1e-7, atol=1e-8) and np.allclose(mine["explained"], rest[0][3], rtol=1e-9)


def test_merging_is_the_whole(spark):
    r = np.random.default_rng(4)
    x = r.integers(-1000, 1000, (500, 5)) + 10**9
    whole, parts = w.moments(x), [w.moments(p) for p in np.array_split(x, 9)]
    one = parts[0]
    for p in parts[1:]:
        one = w.merged(one, p)
    assert one.n == 500 and one.total == [int(s) for s in x.sum(0)] == whole.total
    exact = x - x.mean(0)
    assert np.allclose(one.scatter, exact.T @ exact, rtol=1e-9) and np.allclose(one.mean, whole.mean, rtol=1e-15)


def test_edges(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, -1.0]), (None, [0.0, 5.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, []), (8, [1.0]), (9, [2.0]), (10, [4.0, 4.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as n", "2 as component", "'x' as `a.b`")
    got = sorted(map(tuple, w.whiten(df, w.scaled("embedding")).select("vec_id", "component", "n", "deviation").collect()), key=str)
    x = np.array([[64, 128], [64, 128], [192, -64], [0, 320]], object)
    far = [sum(int(4 * v - s) ** 2 for v, s in zip(row, x.sum(0), strict=True)) for row in x]
    want = [(i, k, 4, d) for i, d in zip([1, 1, 2, None], far, strict=True) for k in (1, 2)] + [(8, 1, 2, 64**2), (9, 1, 2, 64**2)]
    assert got == sorted(want, key=str)  # one vector of three entries has no variance
    assert w.whiten(df.limit(0), w.scaled("embedding")).collect() == []
    same = df.limit(2)
    assert w.whiten(same.filter("vec_id = 1"), w.scaled("embedding")).collect() == []


def test_huge_and_constant(spark):
    huge = spark.createDataFrame([(1, [10**17, 1, 5]), (2, [-(10**17), 2, 5]), (3, [3, 9, 5])], "vec_id long, embedding array<bigint>")
    got = w.whiten(huge).collect()
    assert {r["vec_id"]: r["deviation"] for r in got} == {1: None, 2: None, 3: 6**2 + 15**2} and max(r["component"] for r in got) == 1
    assert abs(sum(r["whitened"] ** 2 for r in got) / 3 - 1) < 1e-9
    floats = spark.createDataFrame([(i, [1e-3 * i, 2.0 + (i % 3)]) for i in range(10)], "vec_id long, embedding array<double>").withColumn("n", F.lit(0))
    out = w.whiten(floats).toPandas()
    assert out["deviation"].isna().all() and out["component"].max() == 2 and out["identity_error"].iloc[0] < 1e-9
