"""Skeletons in rounds against the one-task kernel, which takes one target after the other."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborframe.operators import graph as gr
from arborframe.operators import kernels as ke
from arborframe.operators import skeletons as sk

VERTEX = "mesh_id long, vid long, x double, y double, z double"


def tubes(spark, arms=5, length=30, meshes=2, seed=1):
    """Meshes of arms around a middle, each a strip three vertices wide, bent and jittered so that no two distances are equal; and a small island a mesh."""
    r = random.Random(seed)
    v, e = [], []
    for m in range(meshes):
        ids = {}
        for a in range(arms):
            turn = 2 * np.pi * a / arms + 0.1 * m
            for i in range(length):
                for j in range(3):
                    ids[a, i, j] = len(ids)
                    across, along = j - 1 + r.random() / 5, 2 + i + r.random() / 5
                    v.append((m, ids[a, i, j], along * np.cos(turn) - across * np.sin(turn), along * np.sin(turn) + across * np.cos(turn), r.random() / 5 + (i / 10) ** 2))
            e += [(m, ids[a, i, j], ids[a, i + p, j + q]) for i in range(length) for j in range(3) for p, q in ((1, 0), (0, 1), (1, 1)) if (a, i + p, j + q) in ids]
        e += [(m, ids[a, 0, 1], ids[(a + 1) % arms, 0, 1]) for a in range(arms)]
        e += [(m, ids[a, length // 2, 2], ids[a, length // 2, 0]) for a in range(arms)]
        island = range(len(ids), len(ids) + 6)
        v += [(m, i, 500.0 + i + r.random(), r.random(), 0.0) for i in island]
        e += [(m, i, i + 1) for i in island[:-1]]
    vertex = spark.createDataFrame([tuple(map(float, row)) for row in v], "mesh_id double, vid double, x double, y double, z double").select(F.col("mesh_id").cast("long").alias("mesh_id"), F.col("vid").cast("long").alias("vid"), *"xyz")
    return vertex, gr.length(vertex, spark.createDataFrame(e, "mesh_id long, src long, dst long"))


def rows(df, *names):
    return sorted(map(tuple, df.select(*names).collect()), key=str)


@pytest.mark.parametrize("invalidation,block,shape", [(3.0, 40, (4, 18, 2)), (9.0, 10_000, (4, 18, 2)), (3.0, 10_000, (5, 30, 1))])
def test_rounds_give_what_turns_give(spark, invalidation, block, shape):
    v, e = tubes(spark, *shape)
    v, e = v.cache(), e.cache()
    want, m = ke.skeletonize(v, e, invalidation, min_component=10)
    taken = []
    got = sk.skeletonize(v, e, invalidation, min_component=10, block=block, taken=taken)
    assert rows(got.tree, "skel_id", "sid", "parent") == rows(want, "skel_id", "sid", "parent")
    assert np.allclose([r[2] for r in rows(got.tree, "skel_id", "sid", "w")], [r[2] for r in rows(want, "skel_id", "sid", "w")])
    assert rows(got.mapping, "mesh_id", "vid", "sid") == rows(m, "mesh_id", "vid", "sid")
    tips = got.tree.join(got.tree.select("skel_id", F.col("parent").alias("sid")), ["skel_id", "sid"], "left_anti").count()
    assert taken[0] < tips


def test_soma_smoothing_and_radius(spark):
    v, e = tubes(spark, arms=3, length=14, meshes=1)
    soma = spark.createDataFrame([(0, 0.0, 0.0, 0.0)], "mesh_id long, px double, py double, pz double")
    want, m = ke.skeletonize(v, e, 4.0, min_component=10, soma=soma, soma_radius=5.0)
    known = v.filter("vid % 3 = 0").select("mesh_id", "vid", F.lit(7.0).alias("radius"))
    got = sk.skeletonize(v, e, 4.0, min_component=10, soma=soma, soma_radius=5.0, smooth=3, radius=known, block=60)
    assert rows(got.tree, "skel_id", "sid", "parent") == rows(want, "skel_id", "sid", "parent")
    assert rows(got.mapping, "mesh_id", "vid", "sid") == rows(m, "mesh_id", "vid", "sid")
    tree = got.tree.toPandas().set_index("sid")
    root = tree[tree["parent"].isna()]
    assert len(root) == 1 and root[["x", "y", "z", "radius"]].to_numpy().tolist() == [[0.0, 0.0, 0.0, 5.0]]
    assert tree["radius"].notna().all() and set(tree["radius"][tree.index % 3 == 0]) <= {5.0, 7.0}
    at = v.toPandas().set_index("vid").loc[tree.index]
    assert (np.abs(at["x"] - tree["x"]) > 1e-9).sum() > len(tree) / 2
    up = tree.dropna(subset=["parent"])
    gap = np.sqrt(((up[list("xyz")].to_numpy() - tree.loc[up["parent"].astype(int), list("xyz")].to_numpy()) ** 2).sum(1))
    assert np.allclose(gap, up["w"])


def test_a_soma_grows_along_the_mesh_only(spark):
    """A strip that comes back into the ball is no part of the soma."""
    xyz = [(float(i), 0.0, 0.0) for i in range(12)] + [(11.5, 1.0, 0.0)] + [(11.0 - i + 0.01 * i, 2.0, 0.0) for i in range(12)]
    v = spark.createDataFrame([(0, i, *p) for i, p in enumerate(xyz)], VERTEX)
    e = gr.length(v, spark.createDataFrame([(0, i, i + 1) for i in range(len(xyz) - 1)], "mesh_id long, src long, dst long"))
    soma = spark.createDataFrame([(0, 0.0, 0.0, 0.0)], "mesh_id long, px double, py double, pz double")
    got = sk.skeletonize(v, e, 1.5, min_component=3, soma=soma, soma_radius=3.5)
    parent = {r["sid"]: r["parent"] for r in got.tree.collect()}
    assert parent == {0: None, 4: 0} | {i: i - 1 for i in range(5, 25)}
    assert {r["vid"]: r["sid"] for r in got.mapping.collect()} == {i: 0 for i in range(4)} | {i: i for i in range(4, 25)}


def test_nothing_to_do(spark):
    v = spark.createDataFrame([(0, 1, 0.0, 0.0, 0.0), (0, 2, 1.0, 0.0, 0.0)], VERTEX)
    e = spark.createDataFrame([(0, 1, 2, 1.0)], "mesh_id long, src long, dst long, w double")
    got = sk.skeletonize(v, e, 3.0, min_component=2)
    assert got.tree.count() == 0 and rows(got.mapping, "vid", "sid") == [(1, None), (2, None)]
    got = sk.skeletonize(v.limit(0), e.limit(0), 3.0)
    assert got.tree.count() == 0 and got.mapping.count() == 0


def test_fronts():
    found = []
    assert sk.add(found, 5.0, (-9.0, 1)) and sk.add(found, 2.0, (-3.0, 2)) and not sk.add(found, 6.0, (-8.0, 0))
    assert sk.add(found, 2.0, (-4.0, 7)) and sorted(found) == [(2.0, (-4.0, 7)), (5.0, (-9.0, 1))]
