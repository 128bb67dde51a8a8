"""Per-object work that is sequential by nature, as grouped maps over many objects: skeletons, link repair.

One object's rows meet in one task, as these algorithms need; objects run side
by side. Anything that is a join or an aggregate is elsewhere.
"""

from __future__ import annotations

import heapq
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

XYZ = ["x", "y", "z"]


# --- shortest ways on one graph ---


def adjacency(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> list[list[tuple[int, float]]]:
    out: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for i, j, d in zip(a.tolist(), b.tolist(), w.tolist(), strict=True):
        out[i].append((j, d))
        out[j].append((i, d))
    return out


def dijkstra(adj: list, sources: list[int], limit: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Distances and predecessors (-1: none) from the nearest source."""
    dist, pred = np.full(len(adj), np.inf), np.full(len(adj), -1)
    heap = [(0.0, s) for s in sources]
    dist[list(sources)] = 0
    while heap:
        d, v = heapq.heappop(heap)
        if d > dist[v]:
            continue
        for u, w in adj[v]:
            if d + w < dist[u] and d + w <= limit:
                dist[u], pred[u] = d + w, v
                heapq.heappush(heap, (d + w, u))
    return dist, pred


def components(adj: list) -> np.ndarray:
    label = np.full(len(adj), -1)
    for s in range(len(adj)):
        if label[s] < 0:
            label[s] = s
            todo = deque([s])
            while todo:
                for u, _ in adj[todo.popleft()]:
                    if label[u] < 0:
                        label[u] = s
                        todo.append(u)
    return label


# --- skeletons ---


def teasar(xyz: np.ndarray, adj: list, root: int, invalidation: float, skip: set[int] = frozenset()) -> tuple[list[list[int]], np.ndarray]:
    """Paths from far vertices to what is reached already, until every vertex lies within `invalidation` of a path along the mesh; each vertex' nearest path vertex."""
    dist, pred = dijkstra(adj, [root])
    valid = np.isfinite(dist)
    valid[list(skip)] = False
    valid[root] = False
    near, owner = np.full(len(adj), np.inf), np.full(len(adj), -1)
    on = {root}
    owner[root], near[root] = root, 0
    paths = []
    while valid.any():
        far = int(np.where(valid, dist, -1).argmax())
        path = [far]
        while path[-1] not in on:
            path.append(int(pred[path[-1]]))
        paths.append(path)
        on.update(path)
        heap = [(0.0, v, v) for v in path]
        for _, v, _ in heap:
            if near[v] > 0:
                near[v], owner[v] = 0.0, v
            valid[v] = False
        while heap:  # what lies within reach of the new path, nearest first
            d, v, o = heapq.heappop(heap)
            if d > near[v] or owner[v] != o:
                continue
            for u, w in adj[v]:
                if d + w <= invalidation and d + w < near[u]:
                    near[u], owner[u] = d + w, o
                    valid[u] = False
                    heapq.heappush(heap, (d + w, u, o))
    return paths, owner


def _far_root(adj: list, members: np.ndarray) -> int:
    at, best = int(members[0]), -1.0
    while True:
        d, _ = dijkstra(adj, [at])
        far = int(members[np.where(np.isfinite(d[members]), d[members], -1).argmax()])
        if d[far] <= best:
            return at
        at, best = far, float(d[far])


def skeletonize(vertex: DataFrame, edges: DataFrame, invalidation: float, min_component: int = 100, soma: DataFrame | None = None, soma_radius: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Trees of meshes: skel (skel_id, sid, parent, w, x, y, z) and mesh_to_skel (mesh_id, vid, sid).

    edges (mesh_id, src, dst, w). Components of min_component vertices or fewer are left out.
    soma (mesh_id, px, py, pz): the root is the vertex nearest to it, and vertices of its
    component within soma_radius collapse to the root. sid is the mesh vertex' id.
    """
    where = soma if soma is not None else vertex.sparkSession.createDataFrame([], "mesh_id long, px double, py double, pz double")
    rows = vertex.select("mesh_id", F.lit(0).alias("kind"), F.col("vid").alias("i"), F.lit(0).cast("long").alias("j"), *[F.col(k).cast("double").alias(k) for k in XYZ])
    rows = rows.unionAll(edges.select("mesh_id", F.lit(1), "src", "dst", F.col("w").cast("double"), F.lit(0.0), F.lit(0.0)))
    rows = rows.unionAll(where.select(F.col("mesh_id").cast("long"), F.lit(2), F.lit(0).cast("long"), F.lit(0).cast("long"), *[F.col(f"p{k}").cast("double") for k in XYZ]))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        v = group[group["kind"] == 0].sort_values("i")
        e = group[group["kind"] == 1]
        s = group[group["kind"] == 2]
        ids, xyz = v["i"].to_numpy(), v[XYZ].to_numpy()
        adj = adjacency(len(ids), np.searchsorted(ids, e["i"]), np.searchsorted(ids, e["j"]), e["x"].to_numpy())
        label = components(adj)
        parent, to = {}, np.full(len(ids), -1)
        near = ((xyz - s[XYZ].to_numpy()[:1]) ** 2).sum(1) if len(s) and len(ids) else None
        for c in np.unique(label):
            members = np.flatnonzero(label == c)
            if len(members) <= min_component:
                continue
            ball: set[int] = set()
            if near is not None and near[members].min() <= soma_radius**2:
                root = int(members[near[members].argmin()])
                ball = {int(m) for m in members if near[m] <= soma_radius**2}
            else:
                root = _far_root(adj, members)
            paths, owner = teasar(xyz, adj, root, invalidation, ball)
            for path in paths:
                for a, b in zip(path[:-1], path[1:], strict=True):
                    parent[a] = b
            parent[root] = None
            to[members] = owner[members]
            for a in ball - {root}:
                to[to == a] = root
                to[a] = root
            for a in list(parent):  # soma vertices become the root
                if a in ball and a != root:
                    del parent[a]
                elif parent.get(a) in ball:
                    parent[a] = root if a != root else None
        out = []
        for a, b in parent.items():
            out.append((0, ids[a], ids[b] if b is not None else None, float(np.sqrt(((xyz[a] - xyz[b]) ** 2).sum())) if b is not None else 0.0, *xyz[a]))
        out += [(1, ids[i], ids[k] if k >= 0 else None, 0.0, 0.0, 0.0, 0.0) for i, k in enumerate(to)]
        made = pd.DataFrame(out, columns=["kind", "i", "j", "w", *XYZ])
        made["j"] = made["j"].astype("Int64")
        return made.assign(mesh_id=group["mesh_id"].iloc[0])

    made = rows.groupBy("mesh_id").applyInPandas(one, "kind int, i long, j long, w double, x double, y double, z double, mesh_id long")
    skel = made.filter("kind = 0").select(F.col("mesh_id").alias("skel_id"), F.col("i").alias("sid"), F.col("j").alias("parent"), "w", *XYZ)
    return skel, made.filter("kind = 1").select("mesh_id", F.col("i").alias("vid"), F.col("j").alias("sid"))


# --- normals ---


def vertex_normals(vertex: DataFrame, face: DataFrame) -> DataFrame:
    """(mesh_id, vid, nx, ny, nz): unit mean of the faces' normals, weighted by area."""
    corner = lambda c: vertex.select("mesh_id", F.col("vid").alias(c), *[F.col(k).cast("double").alias(f"{c}{k}") for k in XYZ])
    t = face
    for c in "abc":
        t = t.join(corner(c), ["mesh_id", c])
    d = lambda c, k: F.col(f"{c}{k}") - F.col(f"a{k}")
    n = {"nx": d("b", "y") * d("c", "z") - d("b", "z") * d("c", "y"), "ny": d("b", "z") * d("c", "x") - d("b", "x") * d("c", "z"), "nz": d("b", "x") * d("c", "y") - d("b", "y") * d("c", "x")}
    each = t.withColumns(n).select("mesh_id", F.explode(F.array("a", "b", "c")).alias("vid"), *n)
    s = each.groupBy("mesh_id", "vid").agg(*[F.sum(k).alias(k) for k in n])
    norm = F.sqrt(sum((F.col(k) ** 2 for k in n), F.lit(0.0)))
    return s.select("mesh_id", "vid", *[(F.col(k) / F.when(norm > 0, norm)).alias(k) for k in n])


# --- link repair ---


def link_merges(vertex: DataFrame, edges: DataFrame, merges: DataFrame) -> DataFrame:
    """merges (mesh_id, merge, a, b: vertices) -> links (mesh_id, merge, a, b) that join the two ends.

    Mutually nearest pairs between the components of the ends, within a ball of twice their
    distance about the middle (all pairs if there are none); of these, what the shortest way uses.
    """
    rows = vertex.select("mesh_id", F.lit(0).alias("kind"), F.col("vid").alias("a"), F.lit(0).cast("long").alias("b"), *[F.col(k).cast("double").alias(k) for k in XYZ])
    rows = rows.unionAll(edges.select("mesh_id", F.lit(1), "src", "dst", F.col("w").cast("double"), F.lit(0.0), F.lit(0.0))).unionAll(merges.select("mesh_id", F.lit(2), "a", "b", F.col("merge").cast("double"), F.lit(0.0), F.lit(0.0)))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        v = group[group["kind"] == 0].sort_values("a")
        e, m = group[group["kind"] == 1], group[group["kind"] == 2]
        ids, xyz = v["a"].to_numpy(), v[XYZ].to_numpy()
        ea, eb, ew = np.searchsorted(ids, e["a"]), np.searchsorted(ids, e["b"]), e["x"].to_numpy()
        out = []
        for p, q, k in zip(np.searchsorted(ids, m["a"]), np.searchsorted(ids, m["b"]), m["x"], strict=True):
            d = np.sqrt(((xyz[p] - xyz[q]) ** 2).sum())
            near = ((xyz - (xyz[p] + xyz[q]) / 2) ** 2).sum(1) <= (2 * d) ** 2
            near[[p, q]] = True
            at = np.flatnonzero(near)
            pos = np.full(len(ids), -1)
            pos[at] = np.arange(len(at))
            inside = near[ea] & near[eb]
            adj = adjacency(len(at), pos[ea[inside]], pos[eb[inside]], ew[inside])
            label = components(adj)
            one_, two = np.flatnonzero(label == label[pos[p]]), np.flatnonzero(label == label[pos[q]])
            if label[pos[p]] == label[pos[q]]:
                continue
            gap = np.sqrt(((xyz[at[one_]][:, None] - xyz[at[two]][None]) ** 2).sum(2))
            there, back = gap.argmin(1), gap.argmin(0)
            pairs = [(i, j) for i, j in enumerate(there) if back[j] == i] or [(i, j) for i in range(len(one_)) for j in range(len(two))]
            new = {}
            for i, j in pairs:
                x, y = int(one_[i]), int(two[j])
                adj[x].append((y, float(gap[i, j])))
                adj[y].append((x, float(gap[i, j])))
                new[x, y] = new[y, x] = True
            _, pred = dijkstra(adj, [int(pos[p])])
            t = int(pos[q])
            while pred[t] >= 0:
                if (int(pred[t]), t) in new:
                    out.append((int(k), int(ids[at[pred[t]]]), int(ids[at[t]])))
                t = int(pred[t])
        return pd.DataFrame(out, columns=["merge", "a", "b"]).assign(mesh_id=group["mesh_id"].iloc[0])

    return rows.groupBy("mesh_id").applyInPandas(one, "merge long, a long, b long, mesh_id long")
