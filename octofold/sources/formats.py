"""Data sources that read and write real files: recordings (also as a stream), meshes and clouds.

A write makes a folder of parts whose names, in order, are the order of the file: ``cat folder/*`` gives
a file in the format. Tasks write parts under names of their own attempt; the commit, which knows
all counts, writes the heads and gives the parts of the attempts that succeeded their names; an abort
deletes all. Rows are written in the order of the DataFrame, so sort it by ranges first.

Paths are opened through Arrow's file systems: plain paths, file, HDFS, S3 and the like.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return fs.LocalFileSystem(), path


def parts_of(path: str) -> list[tuple[str, int]]:
    """The files of a path in order, with their sizes; a file is its own part, hidden ones don't count."""
    store, at = opened(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return [(at, info.size)]
    found = store.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))


class Frames(InputPartition):
    """Frames of a part: number of the first, its place in the part, how many."""

    def __init__(self, path: str, part: str, frame: int, first: int, count: int, width: int, height: int, record: int):
        super().__init__(frame)
        self.path, self.part, self.frame, self.first, self.count = path, part, frame, first, count
        self.width, self.height, self.record = width, height, record


class Recording:
    """A file or folder of records: a header (width, height), 16-bit millimetres, and unless
    ``light`` a second header with RGB bytes. The first record's size holds for all; an
    incomplete last record is not a frame. Frames are read by seek, ``frames`` of them in a task."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.light = options.get("light", "false").lower() == "true"
        self.step = int(options.get("frames", "8"))

    def ranges(self, low: int = 0, high: int | None = None) -> list[Frames]:
        """The frames from ``low`` to before ``high``."""
        store, _ = opened(self.path)
        out, number, size = [], 0, None
        for part, length in parts_of(self.path):
            if size is None and length >= 8:
                with store.open_input_file(part) as f:
                    size = struct.unpack("<II", f.read(8))
            if size is None:
                continue
            w, h = size
            record = 8 + 2 * w * h + (0 if self.light else 8 + 3 * w * h)
            n = length // record
            first, last = max(0, low - number), n if high is None else min(n, high - number)
            out += [Frames(self.path, part, number + k, k, min(self.step, last - k), w, h, record) for k in range(first, last, self.step)]
            number += n
        return out

    def read(self, p: Frames) -> Iterator[pa.RecordBatch]:
        n = p.width * p.height
        place = np.arange(n, dtype=np.int32)
        store, _ = opened(p.path)
        with store.open_input_file(p.part) as f:
            for k in range(p.count):
                f.seek((p.first + k) * p.record + 8)
                depth = np.frombuffer(f.read(2 * n), "<u2").astype(np.int32)
                cols = (np.full(n, p.frame + k, np.int32), place % p.width, place // p.width, depth)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["frame", "u", "v", "mm"])


class RecordingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.recording = Recording(options)

    def partitions(self) -> list[InputPartition]:
        return self.recording.ranges()

    def read(self, part: Frames) -> Iterator[pa.RecordBatch]:
        return self.recording.read(part)


class RecordingStream(DataSourceStreamReader):
    """Offsets are counts of whole frames, so a growing recording is read once each frame."""

    def __init__(self, options: dict):
        self.recording = Recording(options)

    def initialOffset(self) -> dict:
        return {"frame": 0}

    def latestOffset(self) -> dict:
        return {"frame": max((p.frame + p.count for p in self.recording.ranges()), default=0)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.recording.ranges(start["frame"], end["frame"])

    def read(self, part: Frames) -> Iterator[pa.RecordBatch]:
        return self.recording.read(part)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Part(WriterCommitMessage):
    """The files of a task by section, and how many rows it wrote."""

    task: int
    files: dict[str, str]
    rows: int


class PartsWriter(DataSourceWriter):
    """Sections are written side by side, one file of each in a task. Formats say what a row adds to
    each section (``lines``) and what stands before a section (``head``)."""

    sections: tuple[str, ...] = ()

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.run = uuid.uuid4().hex

    def lines(self, row) -> tuple[bytes, ...]:
        raise NotImplementedError

    def head(self, section: str, rows: int) -> bytes:
        return b""

    def write(self, iterator) -> Part:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, at = opened(self.path)
        store.create_dir(at)
        names = {s: f"{at}/_{self.run}-{task.partitionId():05d}-{task.taskAttemptId()}-{s}" for s in self.sections}
        files, rows = {s: store.open_output_stream(n) for s, n in names.items()}, 0
        for row in iterator:
            for s, text in zip(self.sections, self.lines(row)):
                files[s].write(text)
            rows += 1
        for f in files.values():
            f.close()
        return Part(task.partitionId(), names, rows)

    def mine(self) -> list[str]:
        store, at = opened(self.path)
        return [f.path for f in store.get_file_info(fs.FileSelector(at, allow_not_found=True)) if f.base_name.startswith(f"_{self.run}-")]

    def commit(self, messages: list[Part | None]) -> None:
        store, at = opened(self.path)
        old = parts_of(self.path)
        if old and not self.overwrite:
            self.abort(messages)
            raise ValueError(f"{self.path} has files already")
        for path, _ in old:
            store.delete_file(path)
        store.create_dir(at)
        parts = sorted((m for m in messages if m), key=lambda m: m.task)
        rows = sum(m.rows for m in parts)
        for k, s in enumerate(self.sections):
            head = self.head(s, rows)
            if head:
                with store.open_output_stream(f"{at}/part-{k}-{s}-head") as f:
                    f.write(head)
            for m in parts:
                if m.rows:
                    store.move(m.files[s], f"{at}/part-{k}-{s}-part{m.task:05d}")
        self.abort(messages)  # what failed attempts left

    def abort(self, messages: list[Part | None]) -> None:
        store, _ = opened(self.path)
        for path in self.mine():
            store.delete_file(path)


def xyz(p) -> str:
    return f"{p[0]!r} {p[1]!r} {p[2]!r}"


class ObjWriter(PartsWriter):
    """Three fresh vertices a triangle (id dense from 0, v0, v1, v2), then faces, counted from 1."""

    sections = ("v", "vf")

    def lines(self, row) -> tuple[bytes, ...]:
        at = 3 * row[0] + 1
        return "".join(f"v {xyz(v)}\n" for v in row[1:4]).encode(), f"f {at} {at + 1} {at + 2}\n".encode()

    def head(self, section: str, rows: int) -> bytes:
        return f"# OBJ file format with ext .obj\n# vertex count = {3 * rows}\n# face count = {rows}\n".encode() if section == "v" else b""


class VtkWriter(PartsWriter):
    """Three fresh points a triangle, then polygons, counted from 0."""

    sections = ("points", "polygons")

    def lines(self, row) -> tuple[bytes, ...]:
        at = 3 * row[0]
        return "".join(f"{xyz(v)}\n" for v in row[1:4]).encode(), f"3 {at} {at + 1} {at + 2}\n".encode()

    def head(self, section: str, rows: int) -> bytes:
        if section == "points":
            return f"# vtk DataFile Version 1.0\nmesh\nASCII\nDATASET POLYDATA\nPOINTS {3 * rows} FLOAT\n".encode()
        return f"POLYGONS {rows} {4 * rows}\n".encode()


class CloudWriter(PartsWriter):
    """A point a line (x, y, z); W15's rows of numbers, whatever their columns."""

    sections = ("rows",)

    def lines(self, row) -> tuple[bytes, ...]:
        return ((" ".join("" if c is None else c if isinstance(c, str) else repr(c) for c in row) + "\n").encode(),)


class RecordWriter(PartsWriter):
    """The records (last column) of frames, one after the other."""

    sections = ("raw",)

    def lines(self, row) -> tuple[bytes, ...]:
        return (bytes(row[-1]),)


def source(title: str, columns: str, writing: type[PartsWriter]) -> type[DataSource]:
    """A data source of that name that only writes."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return title

        def schema(self) -> str:
            return columns

        def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
            return writing(self.options, overwrite)

    return Source


class RawDepth(DataSource):
    """spark.read.format("raw_depth").load(path), or readStream: frame, u, v, mm. Writes (frame,
    record), see ``files.record``."""

    @classmethod
    def name(cls) -> str:
        return "raw_depth"

    def schema(self) -> str:
        return "frame int, u int, v int, mm int"

    def reader(self, schema: StructType) -> DataSourceReader:
        return RecordingReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return RecordingStream(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return RecordWriter(self.options, overwrite)


TRIANGLE = "id long, v0 struct<x: double, y: double, z: double>, v1 struct<x: double, y: double, z: double>, v2 struct<x: double, y: double, z: double>"
SOURCES = (RawDepth, source("obj_mesh", TRIANGLE, ObjWriter), source("vtk_mesh", TRIANGLE, VtkWriter), source("number_rows", "x double, y double, z double", CloudWriter))


def register(spark: SparkSession) -> None:
    for s in SOURCES:
        spark.dataSource.register(s)
