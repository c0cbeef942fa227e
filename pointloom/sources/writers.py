"""Files of groups of rows: packet recordings, inertial archives and maps, written by tasks and made visible all at once.

A task writes under a folder of its attempt, out of sight. Once all tasks are done the driver moves the files that they report into
place and adds their names to a manifest, by which this library's readers go; a job that fails takes its folder away. What an attempt
that was lost has written goes with the folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from pointloom.sources.files import IMU_COLUMNS, imu_archive
from pointloom.sources.recordings import HEADER_BYTES, file_system

WRITTEN = "file string, rows bigint, bytes bigint"


def file_name(group: Column) -> Column:
    """A name for each group that no other group has: percent-encoded, null as %null and empty as %empty."""
    name = F.replace(F.url_encode(group.cast("string")), F.lit("*"), F.lit("%2A"))
    hidden = F.concat(F.when(F.startswith(name, F.lit(".")), "%2E").otherwise("%5F"), F.substring(name, 2, 1 << 30))
    return F.when(group.isNull(), "%null").when(name == "", "%empty").when(F.substring(name, 1, 1).isin(".", "_"), hidden).otherwise(name)


def _xyz(part: pa.RecordBatch) -> bytes:
    return np.stack([part.column(c).to_numpy() for c in "xyz"], axis=1).astype("<f8").tobytes()


def _records(part: pa.RecordBatch) -> bytes:
    """Headers and payloads of all rows, laid out at once."""
    payload = part.column("payload").cast(pa.large_binary())
    body = pa.concat_arrays([payload])  # offsets from the slice's own
    ends = np.frombuffer(body.buffers()[1], np.int64)[body.offset : body.offset + len(body) + 1]
    sizes = np.diff(ends)
    if (sizes > 0xFFFF).any():
        raise ValueError("a payload is longer than its length can tell")
    out = np.empty(len(body) * HEADER_BYTES + int(sizes.sum()), np.uint8)
    starts = np.arange(len(body)) * HEADER_BYTES + ends[:-1] - ends[0]
    heads = np.empty(len(body), np.dtype([("t", ">f8"), ("n", ">u2")]))
    heads["t"], heads["n"] = part.column("ts").to_numpy(zero_copy_only=False), sizes
    head = (starts[:, None] + np.arange(HEADER_BYTES)).ravel()
    out[head] = heads.view(np.uint8)
    rest = np.ones(len(out), bool)
    rest[head] = False
    out[rest] = np.frombuffer(body.buffers()[2], np.uint8)[ends[0] : ends[-1]] if sizes.sum() else np.empty(0, np.uint8)
    return out.tobytes()


def _ply_head(part: pa.RecordBatch) -> bytes:
    return f"ply\nformat binary_little_endian 1.0\nelement vertex {part.column('n')[0].as_py()}\nproperty double x\nproperty double y\nproperty double z\nend_header\n".encode()


def _pcd_head(part: pa.RecordBatch) -> bytes:
    n = part.column("n")[0].as_py()
    return f"# .PCD v0.7 - Point Cloud Data file format\nVERSION 0.7\nFIELDS x y z\nSIZE 8 8 8\nTYPE F F F\nCOUNT 1 1 1\nWIDTH {n}\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS {n}\nDATA binary\n".encode()


#: For each kind of file what its first rows begin it with, and what every batch of rows adds.
KINDS: dict[str, tuple[Callable[[pa.RecordBatch], bytes], Callable[[pa.RecordBatch], bytes]]] = {
    "vlp16": (lambda part: b"", _records),
    "npz": (lambda part: b"", lambda part: b"".join(part.column("content").to_pylist())),
    "ply": (_ply_head, _xyz),
    "pcd": (_pcd_head, _xyz),
}


@dataclass
class Files(WriterCommitMessage):
    """What one attempt has written: its folder, and name, rows and bytes of each file."""

    folder: str
    files: list[tuple[str, int, int]] = field(default_factory=list)


class GroupWriter(DataSourceArrowWriter):
    """Writes rows that come in order of ``_name``, one file for each name."""

    def __init__(self, options: dict) -> None:
        self.folder, self.kind, self.job = options["path"], options["kind"], options["job"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Files:
        fs, root = file_system(self.folder)
        head, body = KINDS[self.kind]
        done = Files(f"{root}/_job-{self.job}/{uuid.uuid4().hex}")
        name, out, rows, size = None, None, 0, 0
        for batch in iterator:
            names = batch.column("_name").to_pylist()
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if names[a] != name:
                    if out is None:
                        fs.create_dir(done.folder, recursive=True)
                    else:
                        out.close()
                        done.files.append((f"{name}.{self.kind}", rows, size))
                    name, rows = names[a], 0
                    out = fs.open_output_stream(f"{done.folder}/{name}.{self.kind}", compression=None)
                    begin = head(part)
                    out.write(begin)
                    size = len(begin)
                content = body(part)
                out.write(content)
                rows, size = rows + part.num_rows, size + len(content)
        if out is not None:
            out.close()
            done.files.append((f"{name}.{self.kind}", rows, size))
        return done

    def commit(self, messages: list[Files | None]) -> None:
        fs, root = file_system(self.folder)
        fs.create_dir(f"{root}/_manifest", recursive=True)
        found = [(m.folder, *f) for m in messages if m for f in m.files]
        with ThreadPoolExecutor(16) as pool:  # names only: a move copies nothing but in object stores
            list(pool.map(lambda x: fs.move(f"{x[0]}/{x[1]}", f"{root}/{x[1]}"), found))
        lines = "".join(json.dumps({"file": name, "rows": rows, "bytes": size}) + "\n" for _, name, rows, size in found)
        with fs.open_output_stream(f"{root}/_manifest/{self.job}.jsonl", compression=None) as f:
            f.write(lines.encode())
        self._clear(fs, root)

    def abort(self, messages: list[Files | None]) -> None:
        self._clear(*file_system(self.folder))

    def _clear(self, fs: pafs.FileSystem, root: str) -> None:
        if fs.get_file_info(f"{root}/_job-{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/_job-{self.job}")


class GroupFiles(DataSource):
    """Format ``group_files`` for writing: options path, kind and job, a name that no other writing has."""

    @classmethod
    def name(cls) -> str:
        return "group_files"

    def writer(self, schema, overwrite: bool) -> GroupWriter:
        return GroupWriter(self.options)


def write_groups(rows: DataFrame, by: str, order: str, folder: str, kind: str) -> DataFrame:
    """Write the rows of each group, in their order, to ``folder``/<group>.<kind>; returns rows (file, rows, bytes) once all are in place.

    A group streams through one task. Names are those of ``file_name``, so different groups never share a file; a file of that name that was there before is replaced.
    Nothing can be seen of a writing that fails.
    """
    spark, job = rows.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(GroupFiles)
    dealt = rows.withColumn("_name", file_name(F.col(by))).repartition("_name").sortWithinPartitions("_name", order)
    dealt.write.format("group_files").mode("append").option("kind", kind).option("job", job).save(folder)
    return spark.read.schema(WRITTEN).json(f"{folder}/_manifest/{job}.jsonl")


def write_recordings(packets: DataFrame, folder: str, by: str = "sensor_id", order: str = "packet_id") -> DataFrame:
    """A .vlp16 recording of the packets (by, order, ts, payload) of each sensor: time, length and payload of each; null payloads are left out."""
    return write_groups(packets.where("payload is not null").select(by, order, "ts", "payload"), by, order, folder, "vlp16")


def write_imu_archives(rows: DataFrame, folder: str, by: str = "sensor_id", order: str = "t", piece: int = 1_000_000) -> DataFrame:
    """Archives (.npz) of the inertial rows of each sensor, every reading kept, ``piece`` rows to a file: <sensor>-<number>."""
    number = F.floor((F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1) / piece)
    named = rows.select(F.concat_ws("-", F.coalesce(F.col(by).cast("string"), F.lit("%null")), number.cast("string")).alias("archive"), *IMU_COLUMNS)

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        return pa.table({"archive": table["archive"].slice(0, 1), "content": pa.array([imu_archive(table)], pa.large_binary()).cast(pa.binary())})

    packed = named.groupBy("archive").applyInArrow(pack, "archive string, content binary")
    return write_groups(packed, "archive", "archive", folder, "npz")


def write_maps(points: DataFrame, folder: str, by: str = "session", voxel: float | None = None, kind: str = "ply") -> DataFrame:
    """A binary map (ply or pcd) of the points (by, x, y, z) of each session, thinned to voxels if asked for; RuntimeError if there are none."""
    from pointloom.operators.cloud import voxel_downsample

    if kind not in ("ply", "pcd"):
        raise ValueError(f"maps are written as ply or pcd, not {kind}")
    if points.isEmpty():
        raise RuntimeError("an empty map can't be saved")
    points = voxel_downsample(points, voxel, by=(by,)) if voxel else points
    counts = points.groupBy(by).agg(F.count("*").alias("n")).withColumnRenamed(by, "_of")
    rows = points.join(counts, points[by].eqNullSafe(F.col("_of"))).select(by, "n", "x", "y", "z")
    return write_groups(rows, by, "x", folder, kind)
