"""SWC and Wavefront files as Spark data sources: spark.read.format("swc"), df.write.format("wavefront").

One object's text is <id>.swc or <id>.obj, or several such with -<anything>
after the id, in a folder that driver and executors share as a file system (for other stores read_swc
and read_obj go through Spark's text reader). Large SWC files are cut by bytes, since their rows
number themselves; Wavefront lines are numbered by their place, so a file is one partition, read line by line;
small files share one. A filter on the object's id (=, in) picks files before any is
opened, where spark.sql.python.filterPushdown.enabled is on. Tasks write into a folder of the job, whose files
take their places when all have ended; a job that fails leaves none.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

PARTITION_BYTES, BATCH_ROWS = 64 << 20, 50_000


@dataclass
class Pieces(InputPartition):
    """(object, file, first byte, end) of what one task reads."""

    pieces: list[tuple[int, str, int, int]]


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class _Reader(DataSourceReader):
    """Files of one ending in a folder; subclasses give the columns and turn lines into rows."""

    ending, column, splits = "", "", False

    def __init__(self, path: str):
        self.path, self.ids = path, None

    def pushFilters(self, filters):
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if wanted is None or f.attribute != (self.column,):
                yield f  # Spark applies it
            else:
                self.ids = wanted if self.ids is None else self.ids & wanted

    def partitions(self) -> list[Pieces]:
        found = []
        for folder, _, names in sorted(os.walk(self.path)):
            for name in sorted(names):
                m = re.fullmatch(rf"(\d+)(-.*)?{re.escape(self.ending)}", name)
                if m and "_temporary" not in folder and (self.ids is None or int(m[1]) in self.ids):
                    file = os.path.join(folder, name)
                    found.append((int(m[1]), file, os.path.getsize(file)))
        out, room = [], 0
        for one, file, size in found:
            step = PARTITION_BYTES if self.splits else max(size, 1)
            for start in range(0, size, step):
                piece = (one, file, start, min(size, start + step))
                if not out or room < piece[3] - start:
                    out.append(Pieces([]))
                    room = PARTITION_BYTES
                out[-1].pieces.append(piece)
                room -= piece[3] - start
        return out or [Pieces([])]

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        schema, rows = self.arrow(), []
        for one, file, start, end in partition.pieces:
            for row in self.rows(_lines(file, start, end)):
                rows.append((one, *row))
                if len(rows) == BATCH_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _lines(file: str, start: int, end: int) -> Iterator[list[str]]:
    """Words of the lines that begin in a range of bytes."""
    with open(file, "rb") as f:
        if start:
            f.seek(start - 1)
            f.readline()  # the line that began before is the range's before this one
        while f.tell() < end and (line := f.readline()):
            yield line.decode().split()


def _schema(columns: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in columns.split(", ")])


SWC = "skel_id long, id long, label int, x double, y double, z double, radius double, parent long"
PARTS = {"vertex": "mesh_id long, vid long, x double, y double, z double", "face": "mesh_id long, fid long, a long, b long, c long"}
MESH = "mesh_id long, vid long, x double, y double, z double, fid long, a long, b long, c long"


class SwcReader(_Reader):
    ending, column, splits = ".swc", "skel_id", True

    def arrow(self) -> pa.Schema:
        return _schema(SWC)

    def rows(self, lines: Iterator[list[str]]) -> Iterator[tuple]:
        for p in lines:
            if p and not p[0].startswith("#"):
                yield int(p[0]), int(p[1]), *map(float, p[2:6]), int(p[6])


class WavefrontReader(_Reader):
    ending, column = ".obj", "mesh_id"

    def __init__(self, path: str, part: str):
        super().__init__(path)
        self.part = part

    def arrow(self) -> pa.Schema:
        return _schema(PARTS[self.part])

    def rows(self, lines: Iterator[list[str]]) -> Iterator[tuple]:
        n = 0
        for p in lines:
            if p and p[0] == self.part[0]:
                # corners are numbered from 1, or from the last one back; what follows a slash is of no interest
                yield (n, *map(float, p[1:4])) if self.part == "vertex" else (n, *(int(c.split("/")[0]) - 1 for c in p[1:4]))
                n += 1


class _Writer(DataSourceWriter):
    def __init__(self, path: str, ending: str, overwrite: bool):
        self.path, self.ending, self.overwrite = path, ending, overwrite
        self.job = os.path.join(path, f"_temporary-{uuid.uuid4().hex}")
        os.makedirs(self.job)

    def line(self, row) -> str:
        raise NotImplementedError

    def write(self, rows) -> Written:
        files: list[str] = []
        last, out = None, None
        for row in rows:
            if row[0] is None:
                raise ValueError("an object without an id has no file")
            if row[0] != last:
                if out is not None:
                    out.close()
                last = row[0]
                # an attempt never writes to another's file; an object that comes in several runs has several
                files.append(os.path.join(self.job, f"{last}-{uuid.uuid4().hex}{self.ending}"))
                out = open(files[-1], "w")
            out.write(self.line(row) + "\n")
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        if self.overwrite:
            for name in os.listdir(self.path):
                if re.fullmatch(rf"\d+(-.*)?{re.escape(self.ending)}", name):
                    os.remove(os.path.join(self.path, name))
        for m in messages:
            for file in m.files if m is not None else []:
                os.rename(file, os.path.join(self.path, os.path.basename(file)))
        shutil.rmtree(self.job)
        open(os.path.join(self.path, "_SUCCESS"), "w").close()

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.job, ignore_errors=True)


class SwcWriter(_Writer):
    def line(self, row) -> str:
        return " ".join([str(row["id"]), str(row["label"]), *(repr(float(row[k])) for k in ("x", "y", "z", "radius")), str(row["parent"])])


class WavefrontWriter(_Writer):
    def line(self, row) -> str:
        if row["fid"] is None:
            return " ".join(["v", *(repr(float(row[k])) for k in "xyz")])
        return " ".join(["f", *(str(row[k] + 1) for k in "abc")])


class Swc(DataSource):
    """Rows of SWC files. To write, have each tree's rows together and in order."""

    @classmethod
    def name(cls) -> str:
        return "swc"

    def schema(self) -> str:
        return SWC

    def reader(self, schema) -> SwcReader:
        return SwcReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> SwcWriter:
        return SwcWriter(self.options["path"], ".swc", overwrite)


class Wavefront(DataSource):
    """Vertices (option part=vertex, the default) or faces (part=face) of Wavefront files. To write, give the rows of mesh_rows."""

    @classmethod
    def name(cls) -> str:
        return "wavefront"

    def schema(self) -> str:
        part = self.options.get("part", "vertex")
        if part not in PARTS:
            raise ValueError("part is vertex or face")
        return PARTS[part]

    def reader(self, schema) -> WavefrontReader:
        return WavefrontReader(self.options["path"], self.options.get("part", "vertex"))

    def writer(self, schema, overwrite: bool) -> WavefrontWriter:
        return WavefrontWriter(self.options["path"], ".obj", overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Swc)
    spark.dataSource.register(Wavefront)


def mesh_rows(vertex: DataFrame, face: DataFrame) -> DataFrame:
    """Vertices and faces as the rows of files, each mesh's together and vertices first; faces name vertices by place, so ids have to be 0, 1, 2, ..."""
    v = vertex.select("mesh_id", "vid", *[F.col(k).cast("double").alias(k) for k in "xyz"])
    rows = v.unionByName(face.select("mesh_id", "fid", "a", "b", "c"), allowMissingColumns=True)
    return rows.select(*[c.split()[0] for c in MESH.split(", ")]).repartition("mesh_id").sortWithinPartitions("mesh_id", F.col("fid").asc_nulls_first(), "vid")


def tree_rows(rows: DataFrame) -> DataFrame:
    """swc_rows in the order of files."""
    return rows.select(*[c.split()[0] for c in SWC.split(", ")]).repartition("skel_id").sortWithinPartitions("skel_id", "id")
