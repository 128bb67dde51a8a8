import numpy as np
import pytest

from arborframe.llm import mixing, sharding


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000])
def test_feistel_is_a_permutation_with_an_inverse(n):
    f = sharding.Feistel(n, 5)
    x = np.arange(n)
    y = f.forward(x)
    assert sorted(y) == list(x)
    assert (f.inverse(y) == x).all()
    if n > 60:
        assert (y != sharding.Feistel(n, 6).forward(x)).any()


def test_shards_differ_by_one_and_slots_have_no_gaps(spark, edge):
    got = sharding.assign_shards(edge, 4).toPandas()
    assert len(got) == edge.count() and set(edge.columns) <= set(got.columns)
    counts = got.groupby("shard_").size()
    assert counts.max() - counts.min() <= 1
    for _, g in got.groupby("shard_"):
        assert sorted(g["slot"]) == list(range(len(g)))
    again = sharding.assign_shards(edge.repartition(3), 4).toPandas()
    key = ["doc_id", "text", "shard_", "slot"]
    assert sorted(map(str, got[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))


def test_shards_of_nothing(nothing):
    assert sharding.assign_shards(nothing).count() == 0


def test_targets_by_brute_force(spark):
    sizes = {"a": 10, "b": 500, "c": 0, "d": 70, None: 30}
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df, 1.5, 2.0).collect()}
    order = ["a", "b", "c", "d", None]
    weight = dict(zip(order, (3, 1, 2, 3, 1), strict=True))
    total, free, want = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        left = total - sum(want.values())
        w = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > 2 * sizes[s]]
        if not over:
            want |= {s: left * weight[s] / w for s in free}
            break
        want |= {s: 2.0 * sizes[s] for s in over}
        free -= set(over)
    assert got == pytest.approx(want)


def test_mix_meets_targets_and_repeats_agree(spark, edge, nothing):
    got = mixing.mix(edge).toPandas()
    assert len(got) == edge.count() and set(edge.columns) <= set(got.columns)
    assert got["copies"].between(0, 2).all()
    got["taken"] = got["copies"] * got["size_"]
    for _, g in got.groupby("source", dropna=False):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= g["size_"].max() / 2 + 1e-6
    again = mixing.mix(edge.repartition(5)).toPandas()
    key = ["doc_id", "text", "copies"]
    assert sorted(map(str, got[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))
    assert mixing.materialise(mixing.mix(edge), edge.columns).count() == got["copies"].sum()
    assert mixing.mix(nothing).count() == 0


def test_mix_of_equal_rows_cuts_between_them(spark):
    rows = [(1, "one two three", "a")] * 101 + [(2, "one two three", "b")] * 40
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    for _, g in got.groupby("source"):
        assert abs((g["copies"] * 3).sum() - g["target"].iloc[0]) <= 1.5


def test_op1_columns_by_brute_force(spark, sf):
    import zlib

    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    got = sharding.op1_sharding(spark, sf).toPandas()
    assert [str(t) for t in got.dtypes] == ["int64", "int64", "int64", "object", "int32", "int64", "object"] or len(got.columns) == 7
    raw = {i: t.encode() if t is not None else None for i, t in zip(docs["doc_id"], docs["text"], strict=True)}
    mine = got.set_index("doc_id")
    assert len(mine) == len(docs) and set(mine.index) == set(raw)
    for i, b in raw.items():
        assert mine.loc[i, "size"] == (len(b) if b is not None else 0) + 1
        assert b is None and mine["text_crc32"].isna()[i] or mine.loc[i, "text_crc32"] == zlib.crc32(b)
    assert set(mine["law"]) == {"rows"} and mine["grown_shard"].isna().all()
    n = mine.groupby("shard").size()
    assert set(n.index) == set(range(8)) and n.max() - n.min() <= 1
    for _, g in mine.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    # shard and slot are what the permutation makes of the row's place
    place = mine["slot"] * 8 + mine["shard"]
    assert sorted(place) == list(range(len(mine)))


def test_mix_keeps_columns_named_like_its_own(spark):
    names = ["__size", "__rank", "__source", "__class", "__digest", "__row", "__i", "__all", "copies", "target"]
    df = spark.range(40).selectExpr("id doc_id", "concat_ws(' ', array_repeat('w', int(id % 7)), id) text", "string(id % 3) source", *[f"id + {k} AS `{n}`" for k, n in enumerate(names)])
    got = mixing.mix(df).toPandas()
    for k, n in enumerate(names):
        assert (got[n] == got["doc_id"] + k).all()
    assert mixing.materialise(mixing.mix(df), df.columns, "copies_").count() == got["copies_"].sum()
