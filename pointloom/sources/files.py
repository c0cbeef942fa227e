"""Files: inertial archives, point clouds as PLY, PCD and XYZ, configurations."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import fields, is_dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.sources.calibration import read_mapping

IMU_COLUMNS = ("t", "ax", "ay", "az", "gx", "gy", "gz", "mx", "my", "mz", "temp_c", "qw", "qx", "qy", "qz", "roll", "pitch", "yaw")


def read_imu_archives(spark: SparkSession, path: str) -> DataFrame:
    """Rows (file, seq, t, ax ..) of npz archives of nine arrays. A field that is NaN throughout, and a NaN temperature, are null."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content")):
                with np.load(io.BytesIO(content.as_py()), allow_pickle=False) as z:
                    n = len(z["timestamp"])
                    if not n:
                        continue
                    parts = [z["timestamp"].reshape(n, 1), z["accel"].reshape(n, 3), z["gyro"].reshape(n, 3), z["mag"].reshape(n, 3), z["temperature"].reshape(n, 1), z["quaternion"].reshape(n, 4), *(z[k].reshape(n, 1) for k in ("roll", "pitch", "yaw"))]
                table = np.concatenate(parts, axis=1).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * n), pa.array(np.arange(n)), *(pa.array(table[:, k].copy()) for k in range(len(IMU_COLUMNS)))], names=["file", "seq", *IMU_COLUMNS])

    schema = "file string, seq bigint, " + ", ".join(f"{c} double" for c in IMU_COLUMNS)
    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(load, schema)
    none = F.isnan("mx") & F.isnan("my") & F.isnan("mz")
    return rows.withColumns({**{c: F.when(~none, F.col(c)) for c in ("mx", "my", "mz")}, "temp_c": F.when(~F.isnan("temp_c"), F.col("temp_c"))})


def imu_archive(rows: pa.Table) -> bytes:
    """An npz archive of rows with the columns above; nulls become NaN."""
    at = lambda *names: np.stack([rows[n].cast(pa.float64()).to_numpy() for n in names], axis=1)
    out = io.BytesIO()
    np.savez(out, timestamp=at("t").ravel(), accel=at("ax", "ay", "az"), gyro=at("gx", "gy", "gz"), mag=at("mx", "my", "mz"), temperature=at("temp_c").ravel(), quaternion=at("qw", "qx", "qy", "qz"), roll=at("roll").ravel(), pitch=at("pitch").ravel(), yaw=at("yaw").ravel())
    return out.getvalue()


PLY_TYPES = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "float32": "f4", "float64": "f8", "uint8": "u1", "int32": "i4"}


def parse_ply(content: bytes) -> np.ndarray:
    """Points (n, 3) of an ASCII or binary little-endian PLY file."""
    head, found, body = content.partition(b"end_header\n")
    lines = head.decode("ascii").split("\n")
    if not found or lines[0].strip() != "ply":
        raise ValueError("not a PLY file")
    form, names, kinds, n, inside = "", [], [], 0, False
    for line in (x.split() for x in lines[1:]):
        if line[:1] == ["format"]:
            form = line[1]
        elif line[:1] == ["element"]:
            inside = line[1] == "vertex"
            n = int(line[2]) if inside else n
        elif line[:1] == ["property"] and inside:
            kinds.append(PLY_TYPES[line[1]])
            names.append(line[2])
    if form == "ascii":
        rows = np.array([x.split()[: len(names)] for x in body.decode("ascii").split("\n")[:n]], dtype=float).reshape(n, len(names))
        return rows[:, [names.index(c) for c in "xyz"]]
    if form != "binary_little_endian":
        raise ValueError(f"unknown PLY format {form}")
    rows = np.frombuffer(body, dtype=[(a, "<" + k) for a, k in zip(names, kinds)], count=n)
    return np.stack([rows[c].astype(float) for c in "xyz"], axis=1)


def parse_pcd(content: bytes) -> np.ndarray:
    """Points (n, 3) of an ASCII or binary PCD file."""
    fields_, at = {}, 0
    while "DATA" not in fields_:
        end = content.index(b"\n", at)
        key, *values = content[at:end].decode("ascii").split() or ["#"]
        if not key.startswith("#"):
            fields_[key] = values
        at = end + 1
    names, n = fields_["FIELDS"], int(fields_["POINTS"][0])
    if fields_["DATA"][0] == "ascii":
        rows = np.array([x.split() for x in content[at:].decode("ascii").split("\n")[:n]], dtype=float).reshape(n, -1)
        return rows[:, [names.index(c) for c in "xyz"]]
    kinds = [(a, f"<{t.lower()}{s}") for a, t, s in zip(names, fields_["TYPE"], fields_["SIZE"])]
    rows = np.frombuffer(content, dtype=kinds, count=n, offset=at)
    return np.stack([rows[c].astype(float) for c in "xyz"], axis=1)


def read_cloud(spark: SparkSession, path: str) -> DataFrame:
    """Rows (file, point_id, x, y, z) of .ply, .pcd and .xyz files."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                kind = name.rsplit(".", 1)[-1].lower()
                data = content.as_py()
                if kind == "xyz":
                    xyz = np.array([x.split()[:3] for x in data.decode().split("\n") if x.strip()], dtype=float).reshape(-1, 3)
                elif kind in ("ply", "pcd"):
                    xyz = parse_ply(data) if kind == "ply" else parse_pcd(data)
                else:
                    raise ValueError(f"unknown kind of cloud: {name}")
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(xyz)), pa.array(np.arange(len(xyz))), *(pa.array(xyz[:, k].copy()) for k in range(3))], names=["file", "point_id", "x", "y", "z"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(load, "file string, point_id bigint, x double, y double, z double")


def write_xyz(cloud: DataFrame, path: str) -> None:
    """Text files of one point a line; RuntimeError if there are none."""
    if cloud.isEmpty():
        raise RuntimeError("an empty map can't be saved")
    cloud.select(F.concat_ws(" ", "x", "y", "z").alias("value")).write.text(path)


def ply_bytes(xyz: np.ndarray) -> bytes:
    head = f"ply\nformat binary_little_endian 1.0\nelement vertex {len(xyz)}\nproperty double x\nproperty double y\nproperty double z\nend_header\n"
    return head.encode() + np.ascontiguousarray(xyz, dtype="<f8").tobytes()


def load_config(path: str, kind: type):
    """A dataclass (nested ones too) from a JSON, TOML or YAML file: missing keys keep their defaults, unknown ones are ignored."""
    return _fill(kind, read_mapping(path))


def _fill(kind: type, data: dict):
    default, given = kind(), {}
    for f in fields(kind):
        if f.name in data:
            now = getattr(default, f.name)
            given[f.name] = _fill(type(now), data[f.name]) if is_dataclass(now) and isinstance(data[f.name], dict) else data[f.name]
    return kind(**given)
