"""Surfaces of meshes in a hierarchy of grids: nearest points on triangles, and first hits of rays.

A mesh' grid of level l has cells of step 2^l. A triangle is cut into pieces no
larger than a cell and written to every cell that these touch, at the finest level at
which they are no more than PIECES; so a long thin triangle is in the cells
along it and a huge one in a few large cells, and no triangle is in many rows.

`nearest` descends from the largest occupied cells: of the cells below those
that are left, a point keeps the ones that are no farther than a point of the surface that it
has seen already. `first_hits` walks along each ray, a stretch twice as long
each round, through the cells of all levels, until a hit lies in the stretch that has been
walked or the ray has left the mesh. A ray carries its numbers to its cells, so that a round is one
shuffle, and meets a cell's triangles there in numpy. Only rows of a cell meet, and no task holds a mesh.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut

PIECES, LEVELS = 128, 20
STRIDE, SALTS, FIRST_CELLS = 2, 16, 2
RAY_STEP, MET = 3.0, 1 << 18  # rays walk cells so many times as large; pairs of ray and triangle held at once
_CORNERS = [f"{c}{k}" for c in "abc" for k in "xyz"]
_PLACES = [f"t{c}" for c in _CORNERS]  # beside a cell, whose columns are named like corners
_CELL = ["mesh_id", "level", "cx", "cy", "cz"]


def triangles(vertex: DataFrame, face: DataFrame) -> DataFrame:
    """(mesh_id, fid, a, b, c, ax .. cz): faces with the places of their corners; faces that lack one are left out."""
    out = face.select("mesh_id", "fid", "a", "b", "c")
    for c in "abc":
        out = out.join(vertex.select("mesh_id", F.col("vid").alias(c), *[F.col(k).cast("double").alias(f"{c}{k}") for k in "xyz"]), ["mesh_id", c])
    return out.select("mesh_id", "fid", "a", "b", "c", *_CORNERS)


def grids(tri: DataFrame) -> DataFrame:
    """(mesh_id, ox, oy, oz, step, side): origin, finest cells as large as a mean triangle, and the extent of each mesh."""
    low = {k: F.least(*[F.col(f"{c}{k}") for c in "abc"]) for k in "xyz"}
    high = {k: F.greatest(*[F.col(f"{c}{k}") for c in "abc"]) for k in "xyz"}
    size = F.greatest(*[high[k] - low[k] for k in "xyz"])
    box = tri.groupBy("mesh_id").agg(*[F.min(low[k]).alias(f"o{k}") for k in "xyz"], *[F.max(high[k]).alias(f"h{k}") for k in "xyz"], F.avg(size).alias("mean"))
    side = F.greatest(*[F.col(f"h{k}") - F.col(f"o{k}") for k in "xyz"])
    step = F.greatest(F.col("mean"), side / F.lit(float(1 << (LEVELS - 1))))
    return box.select("mesh_id", "ox", "oy", "oz", F.when(step > 0, step).otherwise(1.0).alias("step"), side.alias("side"))


def cover(tri: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, levels and cells of triangles (n x 3 x 3, from the grid's origin)."""
    edge = np.linalg.norm(tri - np.roll(tri, 1, 1), axis=2).max(1)
    area = np.linalg.norm(np.cross(tri[:, 1] - tri[:, 0], tri[:, 2] - tri[:, 0]), axis=1) / 2
    level = np.zeros(len(tri), np.int64)
    for _ in range(LEVELS):
        s = step * 2.0**level
        level += 4 * area / s**2 + 4 * edge / s > PIECES
    size = step * 2.0**level
    found, row, piece = [], np.arange(len(tri)), tri
    while len(row):
        s = size[row][:, None]
        low, high = piece.min(1), piece.max(1)
        small = ((high - low) <= s).all(1)
        # a little wider than the piece, so that what touches a wall between cells is in both
        first, last = (np.floor(x / s[small] + d).astype(np.int64) for x, d in ((low[small], -1e-7), (high[small], 1e-7)))
        for d in np.ndindex(3, 3, 3):
            at = first + d
            inside = (at <= last).all(1)
            found.append(np.column_stack([row[small][inside], at[inside]]))
        row, piece = row[~small], piece[~small]
        # the longest edge is halved
        e = np.linalg.norm(piece - np.roll(piece, -1, 1), axis=2).argmax(1)
        i = np.arange(len(row))
        p, q, r = piece[i, e], piece[i, (e + 1) % 3], piece[i, (e + 2) % 3]
        m = (p + q) / 2
        piece = np.concatenate([np.stack([p, m, r], 1), np.stack([m, q, r], 1)])
        row = np.concatenate([row, row])
    cells = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 4), np.int64)
    return cells[:, 0], level[cells[:, 0]], cells[:, 1:]


def _numbers(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.float64) for n in names])


def covered(tri: DataFrame, grid: DataFrame) -> DataFrame:
    """(mesh_id, level, cx, cy, cz, fid): every cell that a triangle touches at its level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _numbers(b, _CORNERS).reshape(-1, 3, 3) - _numbers(b, ["ox", "oy", "oz"])[:, None, :]
            row, level, cell = cover(x, b.column("step").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([b.column("mesh_id").take(pa.array(row)), pa.array(level, pa.int32()), *[pa.array(cell[:, k]) for k in range(3)], b.column("fid").take(pa.array(row))], names=[*_CELL, "fid"])

    kind = tri.schema["fid"].dataType.simpleString()
    return tri.join(grid, "mesh_id").select("mesh_id", "fid", *_CORNERS, "ox", "oy", "oz", "step").mapInArrow(run, f"mesh_id long, level int, cx long, cy long, cz long, fid {kind}")


def closest(p: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The point of each triangle that is nearest to each p (rows): inside it, or on the nearest of its sides."""

    def on_side(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        d = v - u
        length = (d**2).sum(1)
        t = np.clip(((p - u) * d).sum(1) / np.where(length > 0, length, 1), 0, 1)
        return u + t[:, None] * d

    best = on_side(a, b)
    for q in (on_side(b, c), on_side(c, a)):
        nearer = ((p - q) ** 2).sum(1) < ((p - best) ** 2).sum(1)
        best = np.where(nearer[:, None], q, best)
    normal = np.cross(b - a, c - a)
    length = (normal**2).sum(1)
    foot = p - (((p - a) * normal).sum(1) / np.where(length > 0, length, 1))[:, None] * normal
    inside = length > 0
    for u, v in ((a, b), (b, c), (c, a)):
        inside &= (np.cross(v - u, foot - u) * normal).sum(1) >= 0
    return np.where(inside[:, None], foot, best)


def _exact(pairs: DataFrame, kind: str) -> DataFrame:
    """Append d2 and the nearest point to rows of points with corners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, x = _numbers(b, ["px", "py", "pz"]), _numbers(b, _CORNERS).reshape(-1, 3, 3)
            q = closest(p, x[:, 0], x[:, 1], x[:, 2])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("mesh_id", "pid", "fid", "a")], pa.array(((p - q) ** 2).sum(1)), *[pa.array(q[:, k]) for k in range(3)]], names=["mesh_id", "pid", "fid", "a", "d2", "qx", "qy", "qz"])

    return pairs.select("mesh_id", "pid", "fid", "a", "px", "py", "pz", *_CORNERS).mapInArrow(run, f"mesh_id long, {kind}, a long, d2 double, qx double, qy double, qz double")


def nearest(points: DataFrame, vertex: DataFrame, face: DataFrame, max_distance: float | None = None) -> DataFrame:
    """(mesh_id, pid, fid, a, d2, qx, qy, qz): the triangle nearest to each point (mesh_id, pid, px, py, pz), its first corner and the nearest point on it; ties go to the smaller fid.

    Points of meshes without triangles, or without one within max_distance (inclusive), are left out; points of one place are looked up once.
    """
    own = points.select("mesh_id", "pid", *[F.col(f"p{k}").cast("double").alias(f"p{k}") for k in "xyz"])
    places = cut(own.drop("pid").distinct().withColumn("pid", F.monotonically_increasing_id()))
    found = _nearest(places, vertex, face, max_distance).join(places, ["mesh_id", "pid"]).drop("pid")
    return own.join(found.hint("merge"), ["mesh_id", "px", "py", "pz"]).select("mesh_id", "pid", "fid", "a", "d2", "qx", "qy", "qz")


def _nearest(points: DataFrame, vertex: DataFrame, face: DataFrame, max_distance: float | None) -> DataFrame:
    tri = cut(triangles(vertex, face))
    grid = cut(grids(tri))
    cells = cut(covered(tri, grid))
    top = int(cells.agg(F.coalesce(F.ceil(F.log2(F.greatest(F.max(F.greatest("cx", "cy", "cz") * F.pow(F.lit(2.0), "level")), F.lit(1.0)))) + 1, F.lit(0))).first()[0])
    corner = tri.select("mesh_id", "fid", "ax", "ay", "az")
    levels = list(range(top, 0, -STRIDE)) + [0]
    key, kind = ["mesh_id", "pid"], ", ".join(f"{c} {d.schema[c].dataType.simpleString()}" for c, d in (("pid", points), ("fid", tri)))
    bound = float("inf") if max_distance is None else float(max_distance) ** 2
    at = points.join(grid, "mesh_id")
    at = cut(at.withColumn("reach", F.lit(bound)))

    def nodes(level: int) -> DataFrame:
        """Occupied cells of a level, with a point of the surface."""
        up = cells.filter(F.col("level") <= level).withColumns({c: F.expr(f"shiftright({c}, {level} - level)") for c in ("cx", "cy", "cz")})
        return up.groupBy("mesh_id", "cx", "cy", "cz").agg(F.min("fid").alias("fid")).join(corner, ["mesh_id", "fid"]).drop("fid")

    front, best = None, None
    for n, level in enumerate(levels):
        size = F.col("step") * float(1 << level)
        gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"o{k}") + F.col(f"c{k}") * size - F.col(f"p{k}"), F.col(f"p{k}") - F.col(f"o{k}") - (F.col(f"c{k}") + 1) * size), F.lit(2.0)) for k in "xyz"), F.lit(0.0))
        seen = sum((F.pow(F.col(f"a{k}") - F.col(f"p{k}"), F.lit(2.0)) for k in "xyz"), F.lit(0.0))
        if n == 0:
            made = at.join(nodes(level), "mesh_id")
        else:
            by = levels[n - 1] - level
            below = nodes(level).withColumns({f"u{k}": F.shiftright(f"c{k}", by) for k in "xyz"})
            parents = front.withColumnsRenamed({f"c{k}": f"u{k}" for k in "xyz"})
            on = ["mesh_id", "ux", "uy", "uz"]
            if n <= 2:  # few cells, hence hot ones: their rows are dealt over tasks
                below = below.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
                parents, on = parents.withColumn("salt", F.pmod(F.xxhash64("pid"), F.lit(SALTS)).cast("int")), [*on, "salt"]
            made = parents.join(below, on).drop("salt", "ux", "uy", "uz")
        made = cut(made.select(*at.columns, "cx", "cy", "cz", gap.alias("gap"), seen.alias("seen")))
        nearer = made.groupBy(*key).agg(F.min("seen").alias("seen_least"))
        front = made.join(nearer, key).withColumn("reach", F.least("reach", "seen_least")).filter(F.col("gap") <= F.col("reach") * (1 + 1e-9)).select(*at.columns, "cx", "cy", "cz")
        # triangles of this level, and of those between it and the next
        mine = cells.filter((F.col("level") <= level) & (F.col("level") > (levels[n + 1] if n + 1 < len(levels) else -1)))
        mine = mine.select("mesh_id", "fid", *[F.expr(f"shiftright({c}, {level} - level)").alias(c) for c in ("cx", "cy", "cz")])
        pairs = front.join(mine, ["mesh_id", "cx", "cy", "cz"]).select(*key, "fid", "px", "py", "pz", "reach").distinct().join(tri, ["mesh_id", "fid"])
        found = _exact(pairs, kind)
        one = F.min(F.struct("d2", "fid", "a", "qx", "qy", "qz")).alias("m")
        found = found.groupBy(*key).agg(one).select(*key, "m.*")
        best = found if best is None else best.unionByName(found).groupBy(*key).agg(one).select(*key, "m.*")
        best = cut(best)
        if n + 1 < len(levels):
            reached = best.select(*key, F.col("d2").alias("best_d2"))
            front = cut(front.join(reached, key, "left").withColumn("reach", F.least("reach", F.coalesce("best_d2", "reach"))).drop("best_d2"))
    return best.filter(F.col("d2") <= bound).select(*key, "fid", "a", "d2", "qx", "qy", "qz")


# --- rays ---


def hit(origin: np.ndarray, ray: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, eps: float = 1e-9) -> np.ndarray:
    """Multiple of each ray at which it meets each triangle (rows); NaN: not at all, or at its own start."""
    e1, e2, s = b - a, c - a, origin - a
    p = np.cross(ray, e2)
    det = (e1 * p).sum(1)
    ok = np.abs(det) > eps
    inv = 1 / np.where(ok, det, 1)
    u = (s * p).sum(1) * inv
    q = np.cross(s, e1)
    v = (ray * q).sum(1) * inv
    t = (e2 * q).sum(1) * inv
    return np.where(ok & (u >= -eps) & (v >= -eps) & (u + v <= 1 + eps) & (t > 1e-6), t, np.nan)


def along(origin: np.ndarray, ray: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and cells (of size 1) that the stretches from begin to end (multiples of ray) pass, in order."""
    n = len(begin)
    rows, ts = [np.arange(n), np.arange(n)], [begin, end]
    for k in range(3):
        x0, x1 = origin[:, k] + begin * ray[:, k], origin[:, k] + end * ray[:, k]
        first, last = np.ceil(np.minimum(x0, x1)).astype(np.int64), np.floor(np.maximum(x0, x1)).astype(np.int64)
        many = np.where(ray[:, k] != 0, np.maximum(last - first + 1, 0), 0)
        row = np.repeat(np.arange(n), many)
        wall = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        rows.append(row)
        ts.append((wall - origin[row, k]) / ray[row, k])
    row, t = np.concatenate(rows), np.concatenate(ts)
    t = np.clip(t, begin[row], end[row])
    order = np.lexsort((t, row))
    row, t = row[order], t[order]
    between = np.flatnonzero(row[:-1] == row[1:])
    row, middle = row[between], (t[between] + t[between + 1]) / 2
    cell = np.floor(origin[row] + middle[:, None] * ray[row]).astype(np.int64)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (cell[1:] != cell[:-1]).any(1)
    return row[new], cell[new]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A stream sorted by cell, triangles (kind 0) before rays (kind 1): the nearest hit of each ray in each of its cells. Only one cell's triangles are carried from batch to batch."""
    held, held_key, held_corner = None, None, None
    for batch in batches:
        kind = batch.column("kind").to_numpy(zero_copy_only=False)
        cell = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in _CELL])
        tri = np.flatnonzero(kind == 0)
        whole = lambda c: batch.column(c).fill_null(0).to_numpy(zero_copy_only=False)  # noqa: B023, E731
        corner, x = np.column_stack([whole(c)[tri] for c in "abc"]), _numbers(batch, _PLACES)[tri]
        tri_cell = cell[tri]
        if held is not None:
            tri_cell, corner, x = np.concatenate([np.repeat(held_key[None], len(held), 0), tri_cell]), np.concatenate([held_corner, corner]), np.concatenate([held, x])
        if not len(tri_cell):
            continue
        new = np.append(True, (tri_cell[1:] != tri_cell[:-1]).any(1))
        first = np.flatnonzero(new)
        many = np.diff(np.append(first, len(tri_cell)))
        # the triangles that were last before a ray are its cell's, if its cell has any
        before = np.cumsum(kind == 0) - 1 + len(tri_cell) - len(tri)
        group = np.cumsum(new)[np.maximum(before, 0)] - 1
        ray = np.flatnonzero((kind == 1) & (before >= 0) & (tri_cell[first[group]] == cell).all(1))
        if len(ray):
            at, n = first[group[ray]], many[group[ray]]
            origin, way = _numbers(batch, ["px", "py", "pz"]), _numbers(batch, ["x", "y", "z"])
            vid = whole("vid")
            upto, begin, rows, dist = np.cumsum(n), 0, [], []
            while begin < len(ray):
                end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + MET, "right")))
                for low in range(0, int(n[begin]) if end == begin + 1 else 1, MET):  # a cell with very many triangles is met in parts
                    k = np.minimum(n[begin:end] - low, MET)
                    r = np.repeat(ray[begin:end], k)
                    i = np.repeat(at[begin:end] + low - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
                    good = (corner[i] != vid[r][:, None]).all(1)
                    r, i = r[good], i[good]
                    t = hit(origin[r], way[r], x[i, 0:3], x[i, 3:6], x[i, 6:9])
                    ok = ~np.isnan(t)
                    rows.append(r[ok])
                    dist.append(t[ok])
                begin = end
            row, t = np.concatenate(rows), np.concatenate(dist)
            if len(row):
                order = np.lexsort((t, row))
                row, t = row[order], t[order]
                one = np.append(True, row[1:] != row[:-1])
                take = pa.array(row[one])
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(take) for c in ("mesh_id", "vid", "i")], pa.array(t[one])], names=["mesh_id", "vid", "i", "dist"])
        last = first[-1]
        held, held_key, held_corner = x[last:], tri_cell[last], corner[last:]


def first_hits(vertex: DataFrame, face: DataFrame, rays: DataFrame, taken: list | None = None) -> DataFrame:
    """rays (mesh_id, vid, i, x, y, z, angle) from their vertex -> (mesh_id, vid, i, angle, dist), NULL for a miss.

    dist is in lengths of the ray. Triangles at the vertex itself don't count. taken, if given, gets the number of rounds.
    """
    tri = cut(triangles(vertex, face))
    grid = grids(tri).withColumn("step", F.col("step") * RAY_STEP)
    cells = cut(covered(tri.filter("a <> b and a <> c"), grid))  # one whose corners are the same vertex isn't hit
    corners = tri.select("mesh_id", "fid", *[F.col(c).cast("long").alias(c) for c in "abc"], *[F.col(c).alias(f"t{c}") for c in _CORNERS])
    filled = cut(cells.join(corners.hint("merge"), ["mesh_id", "fid"]).select(F.lit(0).alias("kind"), *_CELL, *"abc", *_PLACES))
    present = sorted(r[0] for r in cells.select("level").distinct().collect())
    start = vertex.select("mesh_id", "vid", *[F.col(k).cast("double").alias(f"p{k}") for k in "xyz"])
    key = ["mesh_id", "vid", "i"]
    told = [*key, "x", "y", "z", "px", "py", "pz"]
    kinds = {c: "double" for c in told} | {c: "long" for c in (*key, *_CELL)} | {"level": "int"}
    length = F.sqrt(sum((F.col(k) * F.col(k) for k in "xyz"), F.lit(0.0)))
    todo = cut(rays.select("mesh_id", "vid", F.col("i").cast("long").alias("i"), *[F.col(k).cast("double").alias(k) for k in "xyz"], "angle").join(start, ["mesh_id", "vid"]).join(grid, "mesh_id", "left").withColumn("length", length))
    missed = todo.filter(F.col("step").isNull() | ~(F.col("length") > 0)).select(*key, "angle", F.lit(None).cast("double").alias("dist"))
    todo = todo.filter(F.col("step").isNotNull() & (F.col("length") > 0))

    def walk(begin: float, end: float):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                step = b.column("step").to_numpy(zero_copy_only=False)
                origin, ray = _numbers(b, ["px", "py", "pz"]) - _numbers(b, ["ox", "oy", "oz"]), _numbers(b, ["x", "y", "z"])
                long = b.column("length").to_numpy(zero_copy_only=False)
                for level in present:
                    size = step * 2.0**level
                    row, cell = along(origin / size[:, None], ray / size[:, None], begin * step / long, end * step / long)
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in told], pa.array(np.full(len(row), level), pa.int32()), *[pa.array(cell[:, k]) for k in range(3)]], names=[*told, *_CELL[1:]])

        return run

    done, begin, end, turns = missed, 0.0, float(FIRST_CELLS), 0
    while True:
        turns += 1
        passed = todo.select(*told, "ox", "oy", "oz", "step", "length").mapInArrow(walk(begin, end), ", ".join(f"{c} {kinds[c]}" for c in [*told, *_CELL[1:]]))
        both = filled.unionByName(passed.withColumn("kind", F.lit(1)), allowMissingColumns=True)
        ordered = both.repartition(*_CELL).sortWithinPartitions(*_CELL, "kind").select("kind", *_CELL, *told[1:], *"abc", *_PLACES)
        least = ordered.mapInArrow(_meet, "mesh_id long, vid long, i long, dist double").groupBy(*key).agg(F.min("dist").alias("dist"))
        after = cut(todo.join(least, key, "left"))
        final = F.col("dist") * F.col("length") <= end * F.col("step")  # a farther one may have others before it, in cells that haven't been walked
        out = F.lit(end) * F.col("step") > 2 * F.col("side")
        sure = F.coalesce(final, F.lit(False))
        done = done.unionAll(after.filter(sure | out).select(*key, "angle", "dist"))
        todo = after.filter(~sure & ~out).drop("dist")
        if todo.isEmpty():
            if taken is not None:
                taken.append(turns)
            return done
        begin, end = end, 2 * end
