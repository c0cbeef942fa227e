"""LiDAR packets: decoding to returns."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the packet format.
PACKET_BYTES = 1206
BLOCK_FLAG = 0xEEFF
DISTANCE_M = 0.002
BLOCK_US = 55.296
SEQUENCE_OFFSET = 16
CHANNEL_US = 2.304
LEAST_RANGE_M = 0.1

BLOCK = np.dtype([("flag", "<u2"), ("azimuth", "<u2"), ("channels", [("distance", "<u2"), ("intensity", "u1")], 32)])
RETURNS = "packet_id bigint, block int, seq int, channel int, azimuth_deg double, distance_m double, intensity double, timestamp_us double, x double, y double, z double"


def elevation(channel: np.ndarray) -> np.ndarray:
    """Degrees: even channels channel - 15, odd channels channel."""
    return np.where(channel % 2 == 0, channel - 15, channel).astype(float)


def decode_packet(payload: bytes) -> dict[str, np.ndarray]:
    """The returns of one packet as columns; ValueError unless it has 1206 bytes.

    Blocks with another flag are skipped. The second firing of a block is half a step of azimuth on, the step being taken
    from the valid block before. Returns nearer than 0.1 m are dropped.
    """
    if len(payload) != PACKET_BYTES:
        raise ValueError(f"a packet has {PACKET_BYTES} bytes, not {len(payload)}")
    blocks = np.frombuffer(payload, dtype=BLOCK, count=12)
    start = struct.unpack_from("<I", payload, 1200)[0]
    number = np.flatnonzero(blocks["flag"] == BLOCK_FLAG)
    azimuth = blocks["azimuth"][number] / 100.0
    step = np.diff(azimuth, prepend=azimuth[:1])
    second = (azimuth + np.where(step < 0, step + 360, step) / 2) % 360
    shape = (len(number), 2, 16)
    d = blocks["channels"]["distance"][number].reshape(shape) * DISTANCE_M
    spread = lambda v: np.broadcast_to(v, shape)
    block, seq, channel = spread(number[:, None, None]), spread(np.arange(2)[None, :, None]), spread(np.arange(16)[None, None, :])
    az = spread(np.stack((azimuth, second), axis=1)[:, :, None])
    t = start + block * BLOCK_US + seq * CHANNEL_US * SEQUENCE_OFFSET
    keep = d >= LEAST_RANGE_M
    out = {"block": block, "seq": seq, "channel": channel, "azimuth_deg": az, "distance_m": d, "intensity": blocks["channels"]["intensity"][number].reshape(shape).astype(float), "timestamp_us": t}
    out = {k: v[keep] for k, v in out.items()}
    el, a = np.radians(elevation(out["channel"])), np.radians(out["azimuth_deg"])
    flat = out["distance_m"] * np.cos(el)
    return out | {"x": flat * np.sin(a), "y": flat * np.cos(a), "z": out["distance_m"] * np.sin(el)}


def decode_packets(packets: DataFrame, payload: str = "payload", key: str = "packet_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of returns from rows (packet_id, payload), with the columns ``keep`` of their packet; payloads of another length give none."""
    names = [f.split()[0] for f in RETURNS.split(", ")]
    whole = ("block", "seq", "channel")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [(i, decode_packet(p)) for i, p in enumerate(part.column(1).to_pylist()) if p is not None and len(p) == PACKET_BYTES]
                if found:
                    row = pa.array(np.repeat([i for i, _ in found], [len(c["x"]) for _, c in found]))
                    columns = [np.concatenate([c[k] for _, c in found]) for k in names[1:]]
                    arrays = [pa.array(v.astype(np.int32) if k in whole else v) for k, v in zip(names[1:], columns)]
                    carried = [part.column(2 + i).take(row) for i in range(len(keep))]
                    yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()).take(row), *arrays, *carried], names=[*names, *keep])

    kept = packets.select(key, payload, *keep)
    schema = T.StructType([*T._parse_datatype_string(RETURNS).fields, *kept.schema.fields[2:]])
    return kept.mapInArrow(decode, schema)


def polar_to_xyz(df: DataFrame, distance: str = "distance_m", azimuth: str = "azimuth_deg", channel: str = "channel") -> DataFrame:
    """x right, y ahead at azimuth 0, z up, as column expressions."""
    el = F.radians(F.when(F.col(channel) % 2 == 0, F.col(channel) - 15).otherwise(F.col(channel)).cast("double"))
    az, flat = F.radians(azimuth), F.col(distance) * F.cos(el)
    return df.withColumns({"x": flat * F.sin(az), "y": flat * F.cos(az), "z": F.col(distance) * F.sin(el)})


def distance_to_walls(rays: DataFrame, room: tuple[float, float, float, float, float, float], sensor: tuple[float, float, float] = (0.0, 0.0, 0.0), most: float = 100.0) -> DataFrame:
    """Rays (azimuth_deg, channel, ..) with distance_m from a sensor to the walls of a box (x0, x1, y0, y1, z0, z1); 0 without a hit."""
    rays = polar_to_xyz(rays.withColumn("_one", F.lit(1.0)), "_one")
    hits = []
    for c, (low, high), s in zip("xyz", (room[:2], room[2:4], room[4:]), sensor):
        for wall in (low, high):
            t = F.when(F.abs(c) > 1e-9, (F.lit(wall) - s) / F.col(c))
            hits.append(F.when(t > 0, t))
    d = F.least(*hits)
    return rays.withColumn("distance_m", F.when(d < most, d).otherwise(0.0)).drop("_one", "x", "y", "z")
