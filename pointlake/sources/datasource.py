"""A Spark data source for point-cloud files and bags: byte ranges of fixed-stride files, whole files of the others.

``spark.read.format("pointlake").option("path", ...)`` gives a cloud; ``df.write.format("pointlake")`` writes one file per
partition. Paths are files, folders or patterns: local ones where driver and executors see the same disk, or URIs (``hdfs://``,
``s3://``, ``gs://`` and the like) that the Arrow file systems of the machines can open.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from pointlake.sources import e57, packets, parsing, ros

CLOUD = "cloud_id string, pid bigint, x double, y double, z double, nx double, ny double, nz double, r int, g int, b int, intensity double"
BAG = "topic string, message_type string, ts_ns bigint, data binary"
_KINDS = {"cloud_id": pa.string(), "pid": pa.int64(), **{c: pa.float64() for c in ("x", "y", "z", "nx", "ny", "nz")}, **{c: pa.int32() for c in "rgb"}, "intensity": pa.float64()}
_NAMES = {"red": "r", "green": "g", "blue": "b", "normal_x": "nx", "normal_y": "ny", "normal_z": "nz", "scalar_intensity": "intensity"}
EXTENSIONS = {".ply": "ply", ".pcd": "pcd", ".bin": "kitti", ".obj": "obj", ".stl": "stl", ".pcap": "velodyne", ".lvx": "lvx", ".lvx2": "lvx2", ".e57": "e57", ".mcap": "mcap", ".db3": "db3"}
LINES = "path string, pid bigint, value string"
#: Points and bytes of text of a byte range.
RANGE_ROWS, RANGE_BYTES = 2_000_000, 32 << 20


class UnsupportedFormat(ValueError):
    """The format is known but cannot be read or written."""


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if "://" in path and not path.startswith("file://"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file://").removeprefix("file:"))


def opened(path: str) -> BinaryIO:
    """A file for reading at any place."""
    system, place = located(path)
    return system.open_input_file(place)


def size_of(path: str) -> int:
    system, place = located(path)
    return system.get_file_info(place).size


def written_file(path: str, data: bytes) -> None:
    """Write a file aside and move it, so that a task that runs twice leaves one whole file."""
    system, place = located(path)
    system.create_dir(os.path.dirname(place), recursive=True)
    aside = f"{place}.{os.getpid()}.tmp"
    with system.open_output_stream(aside) as out:
        out.write(data)
    system.move(aside, place)


def files_of(path: str) -> list[str]:
    """Files of a path, a folder or a pattern, in order; none is an error. Names that begin with a point or line are no files."""
    system, place = located(path)
    head = path[: path.index("://") + 3] if "://" in path and not path.startswith("file://") else ""
    about = system.get_file_info(place)
    if about.type == fs.FileType.File:
        return [head + place]
    base = place
    while any(c in base for c in "*?["):
        base = os.path.dirname(base)
    inside = system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    found = sorted(i.path for i in inside if i.type == fs.FileType.File and not os.path.basename(i.path).startswith((".", "_")))
    if base != place:
        found = [f for f in found if fnmatch(f, place) and f.count("/") == place.count("/")]
    if not found:
        raise FileNotFoundError(path)
    return [head + f for f in found]


def format_of(path: str, hint: str | None = None) -> str:
    """The format of a file: the hint, its extension, else its first bytes."""
    if hint:
        return hint
    known = EXTENSIONS.get(os.path.splitext(path)[1].lower())
    if known:
        return known
    with opened(path) as f:
        seen = parsing.sniff(f.read(4096))
    if seen == "las" or os.path.splitext(path)[1].lower() in (".las", ".laz"):
        raise UnsupportedFormat(f"{path}: LAS and LAZ are not supported")
    if not seen:
        raise ValueError(f"{path}: unknown format")
    return {"pcap": "velodyne"}.get(seen, seen)


@dataclass
class Range(InputPartition):
    path: str
    form: str
    start: int = 0
    rows: int = -1  # all


def _strided(path: str, form: str) -> tuple[np.dtype, int, int, dict[str, str]] | None:
    """Row layout, first byte, number of rows and column names of a file whose points have a fixed size."""
    size = size_of(path)
    if form == "kitti":
        if size % 16:
            raise ValueError(f"{path}: the size is no multiple of 16")
        return parsing.KITTI, 0, size // 16, {c: c for c in parsing.KITTI.names}
    if form not in ("ply", "pcd"):
        return None
    # a header may be longer than any guess: more is read until its end is in sight
    last = b"end_header" if form == "ply" else b"DATA "
    with opened(path) as f:
        head = f.read(1 << 16)
        while len(head) < size and b"\n" not in head[head.find(last) :] if last in head else len(head) < size:
            head += f.read(len(head))
    if form == "ply":
        h = parsing.ply_header(head)
        if h.form == "ascii" or not h.elements or h.elements[0].name != "vertex" or not h.elements[0].is_fixed:
            return None
        kind, start, rows = h.dtype(h.elements[0]), h.size, h.elements[0].count
        names = {c: c for c in kind.names}
    else:
        h = parsing.pcd_header(head)
        if h.form != "binary":
            return None
        kind, start, rows = h.dtype, h.size, h.points
        names = {n: f for n, f, c in zip(kind.names, h.fields, h.counts) if c == 1}
    if size < start + rows * kind.itemsize:
        raise ValueError(f"{path}: the file is too short")
    return kind, start, rows, names


def cloud_columns(path: str, form: str) -> dict[str, np.ndarray]:
    """Columns of a whole file."""
    with opened(path) as f:
        data = f.read()
    if form == "ply":
        return dict(parsing.read_ply(data).get("vertex", {}))
    if form == "pcd":
        return parsing.read_pcd(data)[1]
    if form == "e57":
        return e57.read_e57(data)
    if form == "kitti":
        rows = parsing.read_kitti(data)
        return {c: rows[c] for c in rows.dtype.names}
    if form == "obj":
        points = np.array([v[:3] for v in parsing.read_obj(data.decode("utf-8", "replace")).vertices]).reshape(-1, 3)
    elif form == "stl":
        points, _, _ = parsing.weld(parsing.read_stl(data)[1])
    elif form == "velodyne":
        points = packets.read_capture(data, packets.VELODYNE_PORT)
    elif form == "ouster":
        points = packets.read_capture(data, packets.OUSTER_PORT)
    elif form == "lvx":
        points = packets.read_lvx(data)
    elif form == "lvx2":
        points = packets.read_lvx2(data)
    else:
        raise UnsupportedFormat(f"{form} holds no points that can be read")
    return {c: points[:, i] for i, c in enumerate("xyz")}


def _batch(path: str, columns: dict[str, np.ndarray], first: int) -> pa.RecordBatch:
    named = {_NAMES.get(k, k): v for k, v in columns.items() if not isinstance(v, list) and np.ndim(v) == 1}
    if not {"x", "y", "z"} <= set(named):
        raise ValueError(f"{path}: no x, y and z")
    n = len(named["x"])
    arrays = []
    for c, kind in _KINDS.items():
        if c == "cloud_id":
            arrays.append(pa.array([os.path.basename(path)] * n, kind))
        elif c == "pid":
            arrays.append(pa.array(np.arange(first, first + n), kind))
        elif c in named:
            arrays.append(pa.array(np.asarray(named[c]).astype("i4" if c in "rgb" else "f8"), kind))
        else:
            arrays.append(pa.nulls(n, kind))
    return pa.RecordBatch.from_arrays(arrays, names=list(_KINDS))


class CloudReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.hint, self.rows = options["path"], options.get("form"), int(options.get("rangerows", RANGE_ROWS))

    def partitions(self) -> list[Range]:
        out = []
        for path in files_of(self.path):
            form = format_of(path, self.hint)
            fixed = _strided(path, form)
            if fixed is None:
                out.append(Range(path, form))
            else:
                out += [Range(path, form, a, min(self.rows, fixed[2] - a)) for a in range(0, max(1, fixed[2]), self.rows)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.rows < 0:
            yield _batch(partition.path, cloud_columns(partition.path, partition.form), 0)
            return
        kind, start, _, names = _strided(partition.path, partition.form)
        with opened(partition.path) as f:
            f.seek(start + partition.start * kind.itemsize)
            for a in range(0, partition.rows, 100_000):
                n = min(100_000, partition.rows - a)
                part = np.frombuffer(f.read(n * kind.itemsize), kind, n)
                yield _batch(partition.path, {n: part[c].reshape(len(part)) for c, n in names.items()}, partition.start + a)


class BagReader(DataSourceReader):
    """Messages of bags, one task per file; topics and (inclusive) times are applied while reading."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.topics = set(options["topics"].split(",")) if options.get("topics") else None
        self.start, self.end = (int(options[k]) if k in options else None for k in ("start", "end"))

    def partitions(self) -> list[Range]:
        files = files_of(self.path)
        # a bag's folder holds files about the bag too
        files = [f for f in files if f.endswith((".db3", ".mcap"))] or files
        return [Range(f, format_of(f)) for f in files]

    def read(self, partition: Range) -> Iterator[tuple]:
        if partition.form == "db3":
            data = None
            if not isinstance(located(partition.path)[0], fs.LocalFileSystem):
                with opened(partition.path) as f:
                    data = f.read()
            yield from ros.sqlite_messages(partition.path, self.topics, self.start, self.end, data)
        elif partition.form == "mcap":
            with opened(partition.path) as f:
                yield from ros.mcap_messages(f.read(), self.topics, self.start, self.end)
        else:
            raise UnsupportedFormat(f"{partition.path} is no bag")


class LineReader(DataSourceReader):
    """``(path, pid, value)``: lines of text files by byte ranges; ``pid`` is the byte at which a line starts in its file.

    A line belongs to the range in which it starts, so ids do not depend on how files are cut. Lines keep their line end: the
    bytes of a range are handed on as they are. With ``heads`` only the first line of each file that is no comment comes out.
    """

    def __init__(self, options: dict) -> None:
        self.path, self.width, self.heads = options["path"], int(options.get("rangebytes", RANGE_BYTES)), options["kind"] == "heads"

    def partitions(self) -> list[Range]:
        if self.heads:
            return [Range(f, "text") for f in files_of(self.path)]
        return [Range(f, "text", a, self.width) for f in files_of(self.path) for a in range(0, size_of(f), self.width)]

    @staticmethod
    def _head(path: str) -> Iterator[pa.RecordBatch]:
        at = 0
        with opened(path) as f:
            held = b""
            while True:
                more = f.read(1 << 16)
                held += more
                while (end := held.find(b"\n") + 1) or (not more and (end := len(held))):
                    line, held = held[:end], held[end:]
                    bare = line.strip()
                    if bare and not bare.startswith((b"#", b"//")):
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([at]), pa.array([line.decode("utf-8", "replace")])], names=["path", "pid", "value"])
                        return
                    at += len(line)
                if not more:
                    return

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if self.heads:
            yield from self._head(partition.path)
            return
        start, end = partition.start, partition.start + partition.rows
        with opened(partition.path) as f:
            first = max(0, start - 1)
            f.seek(first)
            data = f.read(end - first)
            while data and not data.endswith(b"\n"):
                more = f.read(1 << 16)
                if not more:
                    break
                cut = more.find(b"\n") + 1
                data += more[:cut] if cut else more
        begin = data.find(b"\n") + 1 if start else 0
        if start and not begin or begin + first >= end:
            return
        stops = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10) + 1
        stops = stops[stops > begin]
        if not len(stops) or stops[-1] < len(data):
            stops = np.append(stops, len(data))
        starts = np.concatenate([[begin], stops[:-1]])
        kept = int(np.searchsorted(starts + first, end))
        edges = np.append(starts[:kept], stops[kept - 1])
        whole = pa.py_buffer(data)
        for a in range(0, kept, 50_000):
            part = edges[a : a + 50_001]
            value = pa.StringArray.from_buffers(len(part) - 1, pa.py_buffer(part.astype(np.int32).tobytes()), whole)
            # a copy of the batch's own bytes: a slice would carry the whole range along
            value = pa.concat_arrays([value, pa.array([], pa.string())])
            yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(value)), pa.array(part[:-1] + first), value], names=["path", "pid", "value"])


@dataclass
class Written(WriterCommitMessage):
    path: str
    rows: int


class CloudWriter(DataSourceArrowWriter):
    """One file per partition; a single partition writes to the path itself where that names a file."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path = options["path"]
        self.form = options.get("form") or EXTENSIONS.get(os.path.splitext(self.path)[1].lower(), "ply")
        self.ascii = options.get("ascii", "false").lower() == "true"
        self.single = os.path.splitext(self.path)[1].lower() in EXTENSIONS
        if self.form not in ("ply", "pcd", "kitti", "obj", "e57"):
            raise UnsupportedFormat(f"{self.form} cannot be written")
        if not overwrite and self.single and located(self.path)[0].get_file_info(located(self.path)[1]).type != fs.FileType.NotFound:
            raise FileExistsError(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        batches = list(iterator)
        index = TaskContext.get().partitionId()
        table = pa.Table.from_batches(batches) if batches else None
        rows = table.num_rows if table is not None else 0
        names = [c for c in ("x", "y", "z", "nx", "ny", "nz", "r", "g", "b", "intensity") if table is not None and c in table.column_names and table[c].null_count < max(1, rows)]
        columns = {c: table[c].to_numpy() for c in names}
        columns = {c: np.nan_to_num(v).astype("u1") if c in "rgb" else v.astype("f8") for c, v in columns.items()}
        if not rows:
            columns = {c: np.empty(0) for c in "xyz"}
        if self.form == "ply":
            data = parsing.write_ply(columns, form="ascii" if self.ascii else "binary_little_endian")
        elif self.form == "pcd":
            data = parsing.write_pcd(columns, "ascii" if self.ascii else "binary")
        elif self.form == "e57":
            data = e57.write_e57(columns)
        elif self.form == "obj":
            data = parsing.write_obj(np.stack([columns[c] for c in "xyz"], 1), np.empty((0, 3), int)).encode()
        else:
            table_rows = np.zeros(rows, parsing.KITTI)
            for c in parsing.KITTI.names:
                if c in columns:
                    table_rows[c] = columns[c]
            data = table_rows.tobytes()
        end = {v: k for k, v in EXTENSIONS.items()}[self.form]
        target = self.path if self.single else os.path.join(self.path, f"part-{index:05d}{end}")
        if self.single and index > 0:
            if rows:
                raise ValueError("a single file is written from a single partition: coalesce(1) first")
            return Written("", 0)
        written_file(target, data)
        return Written(target, rows)

    def commit(self, messages: list) -> None:
        return None

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and m.path:
                system, place = located(m.path)
                if system.get_file_info(place).type == fs.FileType.File:
                    system.delete_file(place)


class PointSource(DataSource):
    """Clouds (``kind`` cloud, the default), bags (``bag``), lines of text (``lines``) and first lines (``heads``)."""

    @classmethod
    def name(cls) -> str:
        return "pointlake"

    def schema(self) -> str:
        return {"bag": BAG, "lines": LINES, "heads": LINES}.get(self.options.get("kind"), CLOUD)

    def reader(self, schema) -> DataSourceReader:
        if "path" not in self.options:
            raise ValueError("option path is missing")
        return {"bag": BagReader, "lines": LineReader, "heads": LineReader}.get(self.options.get("kind"), CloudReader)(dict(self.options))

    def writer(self, schema, overwrite: bool) -> CloudWriter:
        return CloudWriter(dict(self.options), overwrite)
