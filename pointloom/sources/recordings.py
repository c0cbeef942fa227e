"""Packet recordings as a data source: files of any length, read by byte ranges and as a stream.

A file is cut into ranges. A range begins at the first record that starts in it, and nothing in a file marks where records
start, so it is searched for: a place from which so many records in a row have plausible times. A range
whose beginning has no such place, or more than one, has no beginning of its own, and the range before reads on through it. Both
find that out by the same search, without a word between them. A range ends where the next one begins, and checks that its
own records lead there: as the first range starts with the file, that proves every range right, or else the reading fails.
"""

from __future__ import annotations

import fnmatch
import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

# Fixed values of the file format: seconds and length, big-endian, before each payload.
HEADER, HEADER_BYTES, MOST_BYTES = ">dH", 10, 10 + 0xFFFF
#: So many records in a row, of rising times up to an hour apart, show where records start; the last ones of a file have no range of their own.
PROOF, GAP_S, BACK_S = 16, 3600.0, 1.0
WIDTH = 64 << 20
BATCH_RECORDS, BATCH_BYTES, READ_BYTES = 4096, 8 << 20, 1 << 20
PACKETS = "file string, packet_id bigint, ts double, payload binary"


class SeamError(ValueError):
    """Two ranges of a recording don't meet: its times aren't those of a recorder. Read it with width=None."""


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it; paths without a scheme are local."""
    scheme, found, rest = uri.partition("://")
    if found:
        return pafs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + found + rest)
    return pafs.LocalFileSystem(), uri.removeprefix("file:")


def list_files(path: str, suffix: str = "") -> list[tuple[str, int]]:
    """Names and sizes of the files of a folder, of one file, or of a pattern in the last part of the path; hidden ones are left out.

    A folder that has manifests holds what they name.
    """
    fs, root = file_system(path)
    folder, _, last = root.rstrip("/").rpartition("/")
    if any(c in last for c in "*?["):
        infos = [x for x in fs.get_file_info(pafs.FileSelector(folder)) if fnmatch.fnmatch(x.base_name, last)]
    else:
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(path)
        infos = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root))
        if info.type == pafs.FileType.Directory and (named := manifest(fs, root)) is not None:
            infos = [x for x in infos if x.base_name in named]
    return sorted((x.path, x.size) for x in infos if x.type == pafs.FileType.File and x.base_name[0] not in "._" and x.base_name.endswith(suffix))


def manifest(fs: pafs.FileSystem, root: str) -> set[str] | None:
    """The names in the manifests of a folder, or None if there are none."""
    at = fs.get_file_info(f"{root}/_manifest")
    if at.type != pafs.FileType.Directory:
        return None
    names: set[str] = set()
    for x in fs.get_file_info(pafs.FileSelector(at.path)):
        with fs.open_input_stream(x.path) as f:
            names.update(json.loads(line)["file"] for line in f.read().decode().splitlines())
    return names


class Bytes:
    """Some bytes of a file at a time: the last two stretches that were read."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size, self.parts = file, size, {}

    def __call__(self, at: int, n: int) -> bytes:
        first, last = at // READ_BYTES, (at + n - 1) // READ_BYTES
        if first == last:
            return self.part(first)[at - first * READ_BYTES : at - first * READ_BYTES + n]
        return b"".join(self.part(k) for k in range(first, last + 1))[at - first * READ_BYTES :][:n]

    def part(self, k: int) -> bytes:
        if k not in self.parts:
            if len(self.parts) > 2:
                self.parts.pop(min(self.parts))
            self.parts[k] = self.file.read_at(min(READ_BYTES, self.size - k * READ_BYTES), k * READ_BYTES)
        return self.parts[k]

    def header(self, at: int) -> tuple[float, int] | None:
        """Time and length of the record at a place, None unless all of it is there."""
        if at + HEADER_BYTES > self.size:
            return None
        t, n = struct.unpack(HEADER, self(at, HEADER_BYTES))
        return (t, n) if at + HEADER_BYTES + n <= self.size else None


def plausible(data: Bytes, at: int) -> bool:
    """Whether records seem to start at a place."""
    before = None
    for _ in range(PROOF):
        head = data.header(at)
        if head is None:
            return False
        t, n = head
        if not 1e-3 <= t < 1e11 or before is not None and not -BACK_S <= t - before <= GAP_S:
            return False
        before, at = t, at + HEADER_BYTES + n
    return True


def _likely(data: Bytes, at: int, end: int) -> list[int]:
    """The places from ``at`` to ``end`` whose next eight bytes are a time that ``plausible`` takes: few, and found all at once."""
    raw = np.frombuffer(data(at, min(end + 7, data.size) - at), np.uint8)
    if len(raw) < 8:
        return []
    with np.errstate(invalid="ignore"):
        t = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, 8)).view(">f8")[:, 0].astype(float)
        return (at + np.flatnonzero((t >= 1e-3) & (t < 1e11))).tolist()


def seam(data: Bytes, at: int) -> int | None:
    """Where the first record from a place on starts, if that can be told: there is one plausible start, and no other but those that follow it."""
    if at == 0:
        return 0
    found, follow = None, set()
    for o in _likely(data, at, min(at + MOST_BYTES, data.size)):
        if o in follow:
            head = data.header(o)
            if head:
                follow.add(o + HEADER_BYTES + head[1])
        elif plausible(data, o):
            if found is not None:
                return None
            found = o
            head = data.header(o)
            follow.add(o + HEADER_BYTES + head[1])
    return found


def records(data: Bytes, starts: list[int], k: int) -> Iterator[tuple[int, float, bytes]]:
    """(place, time, payload) of the records of range ``k``; ``starts`` are the first bytes of all ranges."""
    at = seam(data, starts[k])
    if at is None:
        return
    k += 1
    while True:
        while k < len(starts) and starts[k] <= at:
            if (begin := seam(data, starts[k])) is not None:
                if begin != at:
                    raise SeamError(f"records lead to byte {at}, the next range begins at {begin}")
                return
            k += 1
        head = data.header(at)
        if head is None:
            return
        yield at, head[0], data(at + HEADER_BYTES, head[1]) if head[1] else b""
        at += HEADER_BYTES + head[1]


def batches(uri: str, rows: Iterator[tuple[int, float, bytes]]) -> Iterator[pa.RecordBatch]:
    part, size = [], 0
    for row in rows:
        part.append(row)
        size += len(row[2])
        if len(part) == BATCH_RECORDS or size >= BATCH_BYTES:
            yield _batch(uri, part)
            part, size = [], 0
    if part:
        yield _batch(uri, part)


def _batch(uri: str, part: list[tuple[int, float, bytes]]) -> pa.RecordBatch:
    columns = [pa.array([uri] * len(part)), pa.array([x[0] for x in part], pa.int64()), pa.array([x[1] for x in part], pa.float64()), pa.array([x[2] for x in part], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["file", "packet_id", "ts", "payload"])


@dataclass
class Range(InputPartition):
    """Range ``number`` of a file of so many bytes; for a stream the bytes after ``since``."""

    path: str
    size: int
    number: int = 0
    since: int = 0


class RecordingReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.width = options["path"], int(options.get("width", WIDTH))
        self.scheme = self.root.partition("://")[0] + "://" if "://" in self.root else "file:"

    def starts(self, size: int) -> list[int]:
        return list(range(0, max(size, 1), self.width)) if self.width > 0 else [0]

    def partitions(self) -> list[Range]:
        return [Range(path, size, k) for path, size in list_files(self.root) if size for k in range(len(self.starts(size)))]

    def named(self, path: str) -> str:
        return self.scheme + path.lstrip("/") if self.scheme != "file:" and not self.scheme.startswith("file") else "file:" + path

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.root)
        with fs.open_input_file(partition.path) as f:
            yield from batches(self.named(partition.path), records(Bytes(f, partition.size), self.starts(partition.size), partition.number))


class RecordingStream(DataSourceStreamReader):
    """Recordings that are still written: a record belongs to the batch in which it is whole. Offsets are the sizes of the files."""

    def __init__(self, options: dict) -> None:
        self.reader = RecordingReader(options)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return dict(list_files(self.reader.root))

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [Range(path, size, since=start.get(path, 0)) for path, size in end.items() if size > start.get(path, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.reader.root)
        with fs.open_input_file(partition.path) as f:
            data = Bytes(f, partition.size)
            # back by the longest record and further, to where records can be told
            at, back = None, MOST_BYTES
            while at is None or at > partition.since:
                at = seam(data, max(0, partition.since - back))
                back *= 4
            rows = records(data, [at], 0) if at == 0 else self._from(data, at)
            yield from batches(self.reader.named(partition.path), (r for r in rows if r[0] + HEADER_BYTES + len(r[2]) > partition.since))

    @staticmethod
    def _from(data: Bytes, at: int) -> Iterator[tuple[int, float, bytes]]:
        while (head := data.header(at)) is not None:
            yield at, head[0], data(at + HEADER_BYTES, head[1]) if head[1] else b""
            at += HEADER_BYTES + head[1]


class RecordingSource(DataSource):
    """Format ``recording``: rows (file, packet_id, ts, payload) of a folder, file or pattern; option ``width`` is the bytes of a range, 0 for whole files."""

    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        return PACKETS

    def reader(self, schema) -> RecordingReader:
        return RecordingReader(self.options)

    def streamReader(self, schema) -> RecordingStream:
        return RecordingStream(self.options)


def split_records(content: bytes) -> Iterator[tuple[float, bytes]]:
    """(time, payload) of a recording; a record that is cut short ends it."""
    at = 0
    while at + HEADER_BYTES <= len(content):
        t, n = struct.unpack_from(HEADER, content, at)
        if at + HEADER_BYTES + n > len(content):
            return
        yield t, content[at + HEADER_BYTES : at + HEADER_BYTES + n]
        at += HEADER_BYTES + n


def read_recordings(spark: SparkSession, path: str, width: int | None = WIDTH) -> DataFrame:
    """Rows (file, packet_id, ts, payload) of recorded packet files; packet_id is the byte at which the record starts in its file.

    Files are read in ranges of ``width`` bytes by as many tasks, or whole with None; a task holds some megabytes. A record cut short ends its file; files
    whose times jump by over an hour close to the start of a range may fail with SeamError, but never give other rows. A store that only
    Spark can open is read by whole files of up to 2 GiB.
    """
    try:
        file_system(path)
    except pa.ArrowInvalid:
        return _read_whole(spark, path)
    spark.dataSource.register(RecordingSource)
    return spark.read.format("recording").option("width", width or 0).load(path)


def stream_recordings(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ``read_recordings`` as a stream, which follows files that are still written; one task for what is new in a file."""
    spark.dataSource.register(RecordingSource)
    return spark.readStream.format("recording").load(path)


def _read_whole(spark: SparkSession, path: str) -> DataFrame:
    def split(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for name, content in zip(batch.column("path"), batch.column("content")):
                data = content.as_py()
                yield from batches(name.as_py(), RecordingStream._from(Bytes(pa.BufferReader(data), len(data)), 0))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(split, PACKETS)

