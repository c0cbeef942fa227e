"""Serial sensor text and frames as Column expressions: CSV and PASHR lines, mount replies, inertial registers, bus frames."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.binary import byte_at, checksum, crc8, crc8_of, signed, unsigned
from pointloom.functions.geometry import quaternion_from_euler
from pointloom.operators.reports import capture_stats

# Fixed values of the sensors' protocols.
STANDARD_GRAVITY = 9.80665
WITMOTION_GRAVITY = 9.81
ACCEL_LSB_PER_G = {2: 16384.0, 4: 8192.0, 8: 4096.0, 16: 2048.0}
GYRO_LSB_PER_DPS = {250: 131.0, 500: 65.5, 1000: 32.8, 2000: 16.4}
FRAME_LENGTHS = (5, 7, 9, 10)

IMU_NAMES = ("ax", "ay", "az", "gx", "gy", "gz", "mx", "my", "mz")


def parse_csv_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Rows with ax .. gz, and mx .. mz where the line has 9 fields; ok is false (and all are null) with fewer than 6 or a field that is no number."""
    parts = F.transform(F.split(F.col(line), ","), lambda p: F.trim(p).try_cast("double"))
    n = F.size(parts)
    head = F.slice(parts, 1, F.when(n >= 9, 9).otherwise(6))
    ok = F.coalesce((n >= 6) & ~F.exists(head, lambda v: v.isNull()), F.lit(False))
    out = lines.withColumn("_p", parts).withColumn("ok", ok)
    for i, name in enumerate(IMU_NAMES):
        out = out.withColumn(name, F.when(F.col("ok") & ((F.size("_p") >= 9) if i >= 6 else F.lit(True)), F.get("_p", i)))
    return out.drop("_p")


def parse_pashr(lines: DataFrame, line: str = "line") -> DataFrame:
    """Rows with yaw, pitch, roll and a quaternion of ``$PASHR,heading,pitch,roll..*xx`` lines; ok is false for any other line. The checksum is not looked at."""
    fields = F.split(F.element_at(F.split(F.trim(F.col(line)), r"\*"), 1), ",")
    out = lines.withColumn("_f", fields)
    for i, name in ((1, "yaw"), (2, "pitch"), (3, "roll")):
        out = out.withColumn(name, F.trim(F.get("_f", i)).try_cast("double"))
    ok = (F.get("_f", 0) == "$PASHR") & F.col("yaw").isNotNull() & F.col("pitch").isNotNull() & F.col("roll").isNotNull()
    out = out.withColumn("ok", F.coalesce(ok, F.lit(False)))
    out = out.withColumns({c: F.when(F.col("ok"), F.col(c)) for c in ("yaw", "pitch", "roll")})
    q = quaternion_from_euler("roll", "pitch", "yaw")
    return out.withColumns(dict(zip(("qw", "qx", "qy", "qz"), q))).drop("_f")


def parse_mount_status(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Rows with longitude and latitude (degrees) and six digits of state; null unless the reply has 23 characters."""
    text = F.when(F.length(reply) >= 23, F.col(reply))
    digit = lambda i: F.substring(text, i, 1).try_cast("int")
    names = ("gps", "system", "rate", "speed", "time_source", "hemisphere")
    return replies.withColumns({"longitude": F.substring(text, 1, 9).try_cast("int") / 360000.0, "latitude": F.substring(text, 10, 8).try_cast("int") / 360000.0 - 90, **{n: digit(18 + i) for i, n in enumerate(names)}})


def expects_terminator(command: Column) -> Column:
    """Whether a mount's reply ends with a hash."""
    return F.coalesce(command.rlike("^:[GVF]") | (command == ":MountInfo#"), F.lit(False))


def reply_problem(command: Column, reply: Column) -> Column:
    """Why a mount's reply is not to be trusted: none, incomplete or unexpected; null if it is."""
    short = (F.length(F.trim(reply)) == 1) & ~F.trim(reply).isin("0", "1")
    ends = expects_terminator(F.trim(command))
    return F.when(F.coalesce(F.length(reply), F.lit(0)) == 0, "none").when(ends & ~reply.endswith("#"), "incomplete").when(~ends & short, "unexpected")


def mpu9250(registers: DataFrame, accel_g: int = 2, gyro_dps: int = 250) -> DataFrame:
    """Rows with ax .. gz and temp_c from 14 big-endian bytes in ``data``; ValueError for an unknown range."""
    if accel_g not in ACCEL_LSB_PER_G or gyro_dps not in GYRO_LSB_PER_DPS:
        raise ValueError("unknown range")
    d = F.col("data")
    raw = [signed(d, 2 * i, 2, little=False) for i in range(7)]
    a, g = STANDARD_GRAVITY / ACCEL_LSB_PER_G[accel_g], math.pi / 180 / GYRO_LSB_PER_DPS[gyro_dps]
    return registers.withColumns({**{c: raw[i] * a for i, c in enumerate(("ax", "ay", "az"))}, "temp_c": raw[3] / 333.87 + 21, **{c: raw[4 + i] * g for i, c in enumerate(("gx", "gy", "gz"))}})


def ak8963(registers: DataFrame, asa: tuple[int, int, int]) -> DataFrame:
    """Rows with mx .. mz (microtesla) from the status byte, 6 little-endian bytes and the second status byte in ``data``; null if not ready or overflown."""
    d = F.col("data")
    good = (byte_at(d, 0).bitwiseAND(F.lit(1)) == 1) & (byte_at(d, 7).bitwiseAND(F.lit(8)) == 0)
    return registers.withColumns({c: F.when(good, signed(d, 1 + 2 * i, 2) * (4912 / 32760 * ((asa[i] - 128) / 256 + 1))) for i, c in enumerate(("mx", "my", "mz"))})


def bno055(registers: DataFrame) -> DataFrame:
    """Rows of scaled units from raw integer columns r_ax .. r_mz, r_qw .. r_qz."""
    scale = {**{f"a{c}": 100.0 for c in "xyz"}, **{f"g{c}": 900.0 for c in "xyz"}, **{f"m{c}": 16.0 for c in "xyz"}, **{f"q{c}": 16384.0 for c in "wxyz"}}
    return registers.withColumns({k: F.col(f"r_{k}") / s for k, s in scale.items()})


def lsm9ds1(registers: DataFrame) -> DataFrame:
    g, a, m = 500 / 32768 * math.pi / 180, 2 / 32768 * STANDARD_GRAVITY, 400 / 32768
    out = {f"{k}{c}": F.col(f"r_{k}{c}") * s for k, s in (("g", g), ("a", a), ("m", m)) for c in "xyz"}
    return registers.withColumns({**out, "temp_c": F.col("r_t") / 16.0 + 25})


def frame_witmotion(content: bytes) -> list[tuple[int, int, bytes]]:
    """(position, type, 8 bytes) of every 11-byte frame whose checksum is right; after a wrong one the search goes on at the next byte."""
    found, at = [], 0
    while (at := content.find(b"\x55", at)) >= 0 and at + 11 <= len(content):
        if sum(content[at : at + 10]) & 0xFF == content[at + 10]:
            found.append((at, content[at + 1], content[at + 2 : at + 10]))
            at += 11
        else:
            at += 1
    return found


def _framed(rows: DataFrame, data: str, split, schema: str, names: list[str], most: int = 65_536) -> DataFrame:
    """A row for each frame that ``split`` finds in ``data``, with the other columns of its row; about ``most`` frames an Arrow batch."""
    keys = [c for c in rows.columns if c != data]

    def table(batch: pa.RecordBatch, owners: list[int], frames: list[tuple]) -> pa.RecordBatch:
        at = pa.array(owners, pa.int64())
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in keys), *(pa.array(x) for x in zip(*frames))], names=[*keys, *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners: list[int] = []
            frames: list[tuple] = []
            for i, content in enumerate(batch.column(data)):
                found = split(content.as_py() or b"")
                owners += [i] * len(found)
                frames += found
                while len(frames) >= most:
                    yield table(batch, owners[:most], frames[:most])
                    owners, frames = owners[most:], frames[most:]
            if frames:
                yield table(batch, owners, frames)

    prefix = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys)
    return rows.select(*keys, data).mapInArrow(run, f"{prefix}, {schema}" if prefix else schema)


def witmotion_frames(captures: DataFrame, data: str = "data") -> DataFrame:
    """Rows (other columns, position, kind, body) of the frames of each capture."""
    return _framed(captures, data, frame_witmotion, "position bigint, kind bigint, body binary", ["position", "kind", "body"])


def witmotion_readings(frames: DataFrame, by: tuple[str, ...] = (), order: str = "position") -> DataFrame:
    """A reading for each angle frame, with the acceleration and rate last seen before it (0 at first) and the angles' quaternion."""
    body = F.col("body")
    value = lambda kind, i, scale: F.when(F.col("kind") == kind, signed(body, 2 * i, 2) * scale)
    rows = frames
    for i, c in enumerate("xyz"):
        rows = rows.withColumns({f"a{c}": value(0x51, i, 16 * WITMOTION_GRAVITY / 32768), f"g{c}": value(0x52, i, 2000 * math.pi / 180 / 32768), ("roll", "pitch", "yaw")[i]: value(0x53, i, 180 / 32768)})
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({c: F.coalesce(F.last(c, True).over(w), F.lit(0.0)) for c in ("ax", "ay", "az", "gx", "gy", "gz")})
    rows = rows.where(F.col("kind") == 0x53)
    return rows.withColumns(dict(zip(("qw", "qx", "qy", "qz"), quaternion_from_euler("roll", "pitch", "yaw")))).drop("kind", "body")


def frame_bus(content: bytes, lengths: dict[int, int] | None = None) -> list[tuple[int, bytes]]:
    """(position, frame) of frames that begin with FD FE, of their id's fixed length.

    Where the id has none, or the content ends before it, a frame goes up to the next such mark, if that gives 4 bytes; without a
    next mark it is unfinished and left out.
    """
    marks = [m.start() for m in re.finditer(b"(?=\xfd\xfe)", content)]
    found, until = [], 0
    for at, following in zip(marks, [*marks[1:], None]):
        if at < until:
            continue
        fixed = (lengths or {}).get(content[at + 2]) if at + 2 < len(content) else None
        if fixed and at + fixed <= len(content):
            until = at + fixed
            found.append((at, content[at:until]))
        elif following is not None and following - at >= 4:
            found.append((at, content[at:following]))
    return found


def bus_frames(captures: DataFrame, data: str = "data", lengths: dict[int, int] | None = None) -> DataFrame:
    return _framed(captures, data, lambda c: frame_bus(c, lengths), "position bigint, frame binary", ["position", "frame"])


# Fixed values of the mount's bus: frame lengths and fields by frame id.
BUS_LENGTHS = {0x11: 5, 0x13: 7, 0x15: 9, 0x16: 10, 0x21: 5, 0x23: 7, 0x25: 9, 0x26: 10, 0x41: 5, 0x65: 9}
BUS_FIELDS = {0x16: "azimuth_raw", 0x26: "tilt_raw", 0x13: "remote_axis_a", 0x23: "remote_axis_b", 0x15: "remote_state_a", 0x25: "remote_state_b", 0x65: "remote_state_c"}
#: Length of frames with a field -> where it begins and its bytes.
BUS_PLACES = {10: (5, 4), 7: (4, 2), 9: (4, 4)}
BUS_MARK = b"\xfd\xfe"


def bus_fields(frames: DataFrame, frame: str = "frame") -> DataFrame:
    """Rows with frame_id, field and value (unsigned, little-endian); field and value are null for frames of other ids or lengths."""
    data, kind, n = F.col(frame), byte_at(F.col(frame), 2), F.length(frame)
    name = F.lit(None).cast("string")
    value = F.lit(None).cast("long")
    for i, label in BUS_FIELDS.items():
        fits = (kind == i) & (n == BUS_LENGTHS[i])
        name = F.when(fits, label).otherwise(name)
        value = F.when(fits, unsigned(data, *BUS_PLACES[BUS_LENGTHS[i]])).otherwise(value)
    return frames.withColumns({"frame_id": kind, "field": name, "value": value})


def bus_packet(frame_id, mode, value) -> Column:
    """FD FE, id, mode, the value in two little-endian bytes, and the CRC over all before it."""
    low = lambda c: (F.lit(c) if isinstance(c, int) else c).bitwiseAND(F.lit(255)).cast("int")
    v = F.lit(value) if isinstance(value, int) else value
    head = F.array(*map(F.lit, BUS_MARK), low(frame_id), low(mode), low(v), low(F.shiftright(v, 8)))
    hexed = F.transform(F.array(head), lambda h: F.transform(F.concat(h, F.array(crc8_of(h))), lambda b: F.lpad(F.hex(b), 2, "0")))
    return F.unhex(F.array_join(F.get(hexed, F.lit(0)), ""))


# Fixed values of the mount's bus: frame lengths and fields by frame id.
BUS_LENGTHS = {0x11: 5, 0x13: 7, 0x15: 9, 0x16: 10, 0x21: 5, 0x23: 7, 0x25: 9, 0x26: 10, 0x41: 5, 0x65: 9}
BUS_FIELDS = {0x16: "azimuth_raw", 0x26: "tilt_raw", 0x13: "remote_axis_a", 0x23: "remote_axis_b", 0x15: "remote_state_a", 0x25: "remote_state_b", 0x65: "remote_state_c"}
#: Length of frames with a field -> where it begins and its bytes.
BUS_PLACES = {10: (5, 4), 7: (4, 2), 9: (4, 4)}
BUS_MARK = b"\xfd\xfe"


def bus_fields(frames: DataFrame, frame: str = "frame") -> DataFrame:
    """Rows with frame_id, field and value (unsigned, little-endian); field and value are null for frames of other ids or lengths."""
    data, kind, n = F.col(frame), byte_at(F.col(frame), 2), F.length(frame)
    name = F.lit(None).cast("string")
    value = F.lit(None).cast("long")
    for i, label in BUS_FIELDS.items():
        fits = (kind == i) & (n == BUS_LENGTHS[i])
        name = F.when(fits, label).otherwise(name)
        value = F.when(fits, unsigned(data, *BUS_PLACES[BUS_LENGTHS[i]])).otherwise(value)
    return frames.withColumns({"frame_id": kind, "field": name, "value": value})


def bus_packet(frame_id, mode, value) -> Column:
    """FD FE, id, mode, the value in two little-endian bytes, and the CRC over all before it."""
    byte = lambda c: F.lpad(F.hex((F.lit(c) if isinstance(c, int) else c).bitwiseAND(F.lit(255))), 2, "0")
    v = F.lit(value) if isinstance(value, int) else value
    head = F.unhex(F.concat(F.lit(BUS_MARK.hex()), byte(frame_id), byte(mode), byte(v), byte(F.shiftright(v, 8))))
    return F.concat(head, F.unhex(F.lpad(F.hex(crc8(head)), 2, "0")))


# Fixed values of the mount's commands: heartbeats (frame id, mode, value), axes, directions, and the modes that move and release.
HEARTBEATS = ((0x11, 0x01, 0), (0x21, 0x01, 0))
AXES = {"azimuth": 0x13, "tilt": 0x23}
DIRECTIONS = {"positive": 0xBC14, "negative": 0xE010}
MOVE_MODE, RELEASE_MODE = 0x04, 0x02


def command_packets(commands: DataFrame) -> DataFrame:
    """Rows (columns of ``commands``, step, packet): the packets that move an ``axis`` in a ``direction`` for ``repeats`` periods.

    Each period sends both heartbeats and the command; at the end come the release and both heartbeats. Other axes and directions are an
    error, no or negative repeats send the end only.
    """
    known = lambda c, table: F.coalesce(*(F.when(F.col(c) == k, F.lit(v)) for k, v in table.items()), F.raise_error(F.concat(F.lit(f"unknown {c} "), F.coalesce(c, F.lit("null")))).cast("int"))
    periods = F.greatest(F.coalesce(F.col("repeats"), F.lit(0)), F.lit(0)).cast("int")
    rows = commands.withColumns({"_axis": known("axis", AXES), "_value": known("direction", DIRECTIONS)}).withColumn("step", F.explode(F.sequence(F.lit(0), periods * 3 + 2)))
    after = F.col("step") - periods * 3  # from 0 on: release, heartbeat, heartbeat
    beat = F.when(after >= 0, after - 1).otherwise(F.col("step") % 3)
    one, two, moving = beat == 0, beat == 1, after < 0
    pick = lambda i, move, end: F.when(one, HEARTBEATS[0][i]).when(two, HEARTBEATS[1][i]).when(moving, move).otherwise(end).cast("int")
    packet = bus_packet(pick(0, F.col("_axis"), F.col("_axis")), pick(1, F.lit(MOVE_MODE), F.lit(RELEASE_MODE)), pick(2, F.col("_value"), F.lit(0)))
    return rows.withColumn("packet", packet).drop("_axis", "_value")


def bus_report(captures: DataFrame, by: tuple[str, ...], data: str = "data", t: str = "t") -> DataFrame:
    """Rows (by, chunks, bytes, printable, bytes_per_second, frames, fields, crc_valid, crc_invalid) over all captures.

    The last byte of every frame of 5 bytes is its CRC; frames of other lengths carry none.
    """
    frames = bus_fields(bus_frames(captures.select(*by, data), data, BUS_LENGTHS))
    short = F.length("frame") == 5
    right = crc8(F.expr("substring(frame, 1, length(frame) - 1)")) == byte_at(F.col("frame"), F.length("frame") - 1)
    counts = frames.groupBy(*by).agg(F.count("*").alias("frames"), F.count("field").alias("fields"), F.count_if(short & right).alias("crc_valid"), F.count_if(short & ~right).alias("crc_invalid"))
    out = capture_stats(captures, by, data, t).join(counts, list(by), "left")
    return out.fillna(0, ["frames", "fields", "crc_valid", "crc_invalid"])


def sensor_counts(rows: DataFrame, by: tuple[str, ...], data: str | None = None) -> DataFrame:
    """Rows (by, n, bytes, ok): how many rows, and bytes of ``data``, each sensor gave; ok if there are any of both."""
    size = F.coalesce(F.sum(F.octet_length(data)), F.lit(0)) if data else F.lit(0).cast("long")
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), size.cast("long").alias("bytes"))
    return out.withColumn("ok", (F.col("n") > 0) & (F.col("bytes") > 0 if data else F.lit(True)))


def probe_table(replies: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Rows (by, opened, responses, replies) from rows (by, command, reply): a map of the commands that were answered; a port that gave no reply at all was not opened."""
    answered = F.filter(F.collect_list(F.struct("command", "reply")), lambda x: x["reply"].isNotNull() & (x["reply"] != ""))
    out = replies.groupBy(*by).agg(F.array_sort(answered).alias("_a"), F.max(F.col("reply").isNotNull()).alias("opened"))
    return out.select(*by, "opened", F.size("_a").alias("responses"), F.map_from_entries(F.array_distinct("_a")).alias("replies"))


def gap_histogram(positions: DataFrame, by: tuple[str, ...], most: int = 6) -> DataFrame:
    """The most frequent distances between successive positions; ties to the one seen first."""
    w = Window.partitionBy(*by).orderBy("position")
    gaps = positions.withColumn("gap", F.lead("position").over(w) - F.col("position")).where("gap is not null")
    counts = gaps.groupBy(*by, "gap").agg(F.count("*").alias("n"), F.min("position").alias("first"))
    order = Window.partitionBy(*by).orderBy(F.col("n").desc(), "first")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("first")


def valid_checksum(frame: Column) -> Column:
    """Whether the last byte of an 11-byte frame is the sum of the others."""
    return (F.length(frame) == 11) & (checksum(F.substring(frame, 1, 10)) == byte_at(frame, 10))
