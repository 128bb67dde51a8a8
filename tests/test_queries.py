import duckdb
import pandas as pd
import pytest

from arborframe.plans import ORACLES, QUERIES

TABLES = ("orders", "lineitem", "events", "embeddings")
#: A few of each kind; the driver compares all of them.
SOME = ["tree_segments", "tree_path_between", "neuron_betweenness", "mask_reindex_faces", "graph_components", "graph_shortest_paths", "spatial_nearest", "annotation_anchor", "property_to_skeleton", "swc_export", "score_histogram"]


def rows(df):
    show = lambda v: "" if pd.isna(v) else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(show, r)) for r in df[sorted(df.columns)].astype(object).to_numpy().tolist())


@pytest.mark.parametrize("name", SOME)
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
