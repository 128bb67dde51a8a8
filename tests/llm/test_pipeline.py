import duckdb
import pytest

import corpus_pipeline
from arborframe.llm import queries
from tests.llm.test_decontamination import brute as hits
from tests.llm.test_near_duplicates import brute as classes
from tests.test_queries import rows


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept.toPandas(), corpus_pipeline._stored(spark, stage(spark, kept, sf), name)
        after = kept.toPandas()
        if name == "near_duplicates":
            rows = list(zip(before["doc_id"], before["text"], strict=True))
            assert set(after["doc_id"]) == {min(rows[i][0] for i in g) for g in classes(rows)}
        if name == "decontamination":
            items = spark.read.parquet(f"{sf}/benchmark.parquet").toPandas()
            rows = list(zip(before["doc_id"], before["text"], strict=True))
            clean = {r[0] for r in hits(rows, list(zip(items["item_id"], items["text"], strict=True))) if not r[-1]}
            assert set(after["doc_id"]) == clean
        if name == "mixing":
            assert set(after["doc_id"]) <= set(before["doc_id"]) and after.groupby("doc_id").size().max() <= 2
        if name != "sharding":
            assert list(after.columns) == docs.columns
    assert after.groupby("shard").size().max() - after.groupby("shard").size().min() <= 1
    assert corpus_pipeline.run(spark, sf).count() == len(after)


def test_edges_of_all_stages(spark, sf, edge, nothing):
    """Nulls, empty, repeated and very long rows, and further columns named like results, with dots and back-ticks, go through every stage."""
    docs = edge.withColumnsRenamed({"size": "a.b", "score": "x`y.z"}).selectExpr("*", "1 as n_hit", "2 as copies", "3 as `doc.id`", "4 as slot")
    rows = docs.select("doc_id", "text").collect()
    kept, counts = docs, []
    for name, stage in corpus_pipeline.STAGES:
        before = {(r["doc_id"], r["text"]) for r in kept.collect()}
        kept = corpus_pipeline._stored(spark, stage(spark, kept, sf), name)
        assert kept.columns[: len(docs.columns)] == docs.columns and {(r["doc_id"], r["text"]) for r in kept.collect()} <= before
        counts.append(kept.count())
    assert kept.columns[len(docs.columns) :] == ["shard_", "slot_"] and counts[0] <= len(rows)
    assert all(r["a.b"] is not None and r["x`y.z"] == 0.5 and r["doc.id"] == 3 for r in kept.collect())
    empty = nothing.withColumnRenamed("size", "a.b")
    for name, stage in corpus_pipeline.STAGES:
        empty = corpus_pipeline._stored(spark, stage(spark, empty, sf), name)
        assert empty.count() == 0


def test_odd_names_of_the_columns_asked_for(spark, edge):
    from arborframe.llm import mixing, near_duplicates

    plain = sorted((str(tuple(r)) for r in mixing.mix(edge.select("doc_id", "text", "source")).collect()))
    odd = mixing.mix(edge.select("doc_id", "text", "source").toDF("doc.id", "te`xt", "source"), key="doc.id", text="te`xt")
    assert odd.columns == ["doc.id", "te`xt", "source", "size", "source_size", "target", "copies"] and sorted(str(tuple(r)) for r in odd.collect()) == plain
    assert near_duplicates.deduplicate(edge.withColumnRenamed("doc_id", "doc.id"), key="doc.id").count() == near_duplicates.deduplicate(edge).count()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, sf).toPandas()
    key = sorted(want.columns)
    assert sorted(got.columns) == key
    assert rows(got) == rows(want)  # missing numbers have other types in the two
