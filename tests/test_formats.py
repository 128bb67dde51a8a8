import os

import pytest
from pyspark.sql import functions as F

from arborframe.sources import formats as fo


@pytest.fixture(scope="module")
def ready(spark):
    fo.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield spark
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def trees(spark, n=5, size=40):
    rows = [(k, i, i % 4, 0.1 * i, -1.5 * k, 1e-7 * i, 2.0, i - 1) for k in range(n) for i in range(size + k)]
    return spark.createDataFrame(rows, fo.SWC).repartition(3)


def test_swc_round_trip(ready, tmp_path, monkeypatch):
    path, df = str(tmp_path / "swc"), trees(ready)
    fo.tree_rows(df).write.format("swc").mode("append").save(path)
    back = ready.read.format("swc").load(path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    names = os.listdir(path)
    assert len([n for n in names if n.endswith(".swc")]) == 5 and "_SUCCESS" in names and not any("_temporary" in n for n in names)
    fo.tree_rows(df.filter("skel_id = 2")).write.format("swc").mode("overwrite").save(path)
    assert {r["skel_id"] for r in ready.read.format("swc").load(path).collect()} == {2}


def test_large_files_are_cut_by_bytes(ready, tmp_path, monkeypatch):
    path = tmp_path / "cut"
    path.mkdir()
    lines = [f"{i} 3 {i}.5 0 0 1 {i - 1}" for i in range(200)]
    (path / "7.swc").write_text("# a header\n\n" + "\n".join(lines))
    (path / "8-x.swc").write_text("\n".join(lines[:3]) + "\n")
    (path / "notes.txt").write_text("0 0 0 0 0 0 0\n")
    for size in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(fo, "PARTITION_BYTES", size)
        reader = fo.SwcReader(str(path))
        parts = reader.partitions()
        got = [r for p in parts for b in reader.read(p) for r in zip(*[c.to_pylist() for c in b.columns], strict=True)]
        assert sorted((r[0], r[1]) for r in got) == [(7, i) for i in range(200)] + [(8, i) for i in range(3)], size
        assert (len(parts) > 20) == (size < 100)
    assert ready.read.format("swc").load(str(path)).count() == 203


def test_filters_pick_files(ready, tmp_path):
    path, df = str(tmp_path / "picked"), trees(ready)
    fo.tree_rows(df).write.format("swc").mode("append").save(path)
    for f, want in (("skel_id = 3", {3}), ("skel_id in (1, 4, 9)", {1, 4}), ("skel_id = 3 and x > 1", {3}), ("skel_id > 2", {3, 4}), ("skel_id = 3 and skel_id in (1, 2)", set())):
        assert {r["skel_id"] for r in ready.read.format("swc").load(path).filter(f).collect()} == want
    for n in os.listdir(path):  # files that the filter excludes aren't opened
        if n.startswith("0-"):
            with open(os.path.join(path, n), "a") as f:
                f.write("no number\n")
    assert ready.read.format("swc").load(path).filter("skel_id = 1").count() == 41
    with pytest.raises(Exception, match="(?s)int"):
        ready.read.format("swc").load(path).filter("skel_id < 2").collect()


def test_wavefront_round_trip(ready, tmp_path):
    path = str(tmp_path / "obj")
    v = ready.createDataFrame([(k, i, i + 0.1, float(k), -1e-9 * i) for k in (1, 2, 3) for i in range(20)], fo.PARTS["vertex"])
    f = ready.createDataFrame([(k, i, i, i + 1, i + 2) for k in (1, 2, 3) for i in range(18)], fo.PARTS["face"])
    fo.mesh_rows(v, f).write.format("wavefront").mode("append").save(path)
    read = lambda part: ready.read.format("wavefront").option("part", part).load(path)
    assert sorted(map(tuple, read("vertex").collect())) == sorted(map(tuple, v.collect()))
    assert sorted(map(tuple, read("face").filter("mesh_id = 2").collect())) == sorted(map(tuple, f.filter("mesh_id = 2").collect()))
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "4.obj").write_text("# cube\nvn 0 0 1\nv 1 2 3\nv 4 5 6\n\nv 7 8 9\nf 1/1/1 2//2 3\n")
    assert [tuple(r) for r in ready.read.format("wavefront").option("part", "face").load(str(tmp_path / "one")).collect()] == [(4, 0, 0, 1, 2)]
    assert ready.read.format("wavefront").load(str(tmp_path / "one")).count() == 3


def test_a_failed_job_leaves_nothing(ready, tmp_path):
    path = str(tmp_path / "failed")
    # the error comes while files are being written
    bad = fo.tree_rows(trees(ready)).withColumn("x", F.when((F.col("skel_id") == 4) & (F.col("id") == 30), F.expr("raise_error('no')")).otherwise(F.col("x")))
    with pytest.raises(Exception, match="no"):
        bad.write.format("swc").mode("append").save(path)
    assert os.listdir(path) == [] and ready.read.format("swc").load(path).count() == 0
