"""Whole jobs over recorded files: frames from packets, counts of a recording, and maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.operators import mapping, ordered
from pointloom.sources import files, packets, recordings, writers


def replay_frames(spark: SparkSession, path: str) -> DataFrame:
    """Returns (file, frame, packet_id, channel, x, y, z, intensity, ..) of all recordings of a folder.

    A frame is one sweep; the last one of a file is there even if it is not complete. Packets of a wrong length are left out.
    """
    returns = packets.decode_packets(recordings.read_recordings(spark, path), keep=("file", "ts"))
    return ordered.sweep_ids(returns, ("file",), ("packet_id", "block", "seq", "channel")).withColumnRenamed("sweep", "frame")


def recording_counts(spark: SparkSession, path: str) -> DataFrame:
    """Rows (file, packets, bytes, frames, seconds) of each recording."""
    recorded = recordings.read_recordings(spark, path)
    sizes = recorded.groupBy("file").agg(F.count("*").alias("packets"), F.sum(F.octet_length("payload")).cast("long").alias("bytes"), (F.max("ts") - F.min("ts")).alias("seconds"))
    frames = replay_frames(spark, path).groupBy("file").agg((F.max("frame") + 1).alias("frames"))
    return sizes.join(frames, "file", "left").fillna(0, ["frames"])


def _stem(name: str) -> Column:
    """The name of a file without its folders and what follows its last dot."""
    return F.regexp_replace(F.regexp_extract(name, r"([^/]+)$", 1), r"\.[^.]*$", "")


def readings_beside(spark: SparkSession, archives: str, sessions: DataFrame) -> DataFrame:
    """Rows (session, t, gx, gy, gz) of the inertial archives that are named as a session (a file name), or as one with a number behind a hyphen."""
    names = sessions.select("session", _stem("session").alias("stem")).distinct()
    rows = files.read_imu_archives(spark, archives).select(_stem("file").alias("whole"), "t", "gx", "gy", "gz").withColumn("part", F.regexp_replace("whole", r"-\d+$", ""))
    rows = rows.join(names.select(F.col("stem").alias("whole"), F.col("session").alias("one")), "whole", "left")
    rows = rows.join(names.select(F.col("stem").alias("part"), F.col("session").alias("two")), "part", "left")
    return rows.select(F.coalesce("one", "two").alias("session"), "t", "gx", "gy", "gz").where("session is not null")


def map_recordings(spark: SparkSession, path: str, folder: str, most_frames: int | None = None, voxel: float = 0.2, archives: str | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """Poses (session, scan, pose, converged) and the written maps (file, rows, bytes): each recording is a session whose frames are its scans.

    Frames without returns do not occur; with ``most_frames`` only the first ones of each recording are used. ``archives`` is a
    folder or pattern of inertial archives (``readings_beside``); frames then start from the rotation up to their last packet.
    """
    frames = replay_frames(spark, path).withColumn("session", F.regexp_extract("file", r"([^/]+)$", 1)).withColumnRenamed("frame", "scan")
    if most_frames is not None:
        frames = frames.where(F.col("scan") < most_frames)
    if archives is not None:
        times = frames.groupBy("session", "scan").agg(F.max("ts").alias("t"))
        options |= {"readings": readings_beside(spark, archives, times), "times": times}
    poses, cloud = mapping.map_scans(frames.select("session", "scan", "x", "y", "z"), voxel=voxel, **options)
    return poses, writers.write_maps(cloud, folder)
