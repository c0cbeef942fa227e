"""A mapping session over a stream of scans: poses and a map that grow by batches, in tables that survive a restart."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pointloom.functions.geometry import Pose
from pointloom.operators import mapping
from pointloom.operators.cloud import voxel_downsample
from pointloom.operators.durable import temporary_tables

#: Tables of a session, each with a folder for every batch.
TABLES = ("pending", "poses", "cloud", "last", "log")


class MappingSession:
    """Maps the scans (by, order, t, x, y, z) of a stream as ``map_scans`` does those of a table.

    All rows of a scan carry its time t. ``order`` has to rise with t within a session. With ``late`` (seconds) scans are held back
    until that much later ones have come, so that files may come in any order within it; what is not newer than a scan of its
    session that was processed already is counted as late and left out. ``folder`` is shared by driver and executors and keeps
    everything: a batch writes its tables and then a line of the log, by which readers go, so a batch that is run again
    replaces what a first attempt left and one that is logged is not run twice. ``options`` are those of ``map_scans``.
    """

    def __init__(self, spark: SparkSession, folder: str, late: float = 0.0, by: str = "session", order: str = "scan", voxel: float = 0.2, **options: Any):
        self.spark, self.folder, self.late, self.by, self.order = spark, folder.rstrip("/"), late, by, order
        self.voxel, self.options, self.running = voxel, options, None

    def start(self, stream: DataFrame) -> StreamingQuery:
        """Begin, or go on where an earlier run of this folder ended."""
        if self.running is not None and self.running.isActive:
            raise RuntimeError("the session is running")
        self.running = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", f"{self.folder}/checkpoint").start()
        return self.running

    def stop(self) -> None:
        """End the stream; does nothing where none runs."""
        if self.running is not None:
            self.running.stop()

    def poses(self) -> DataFrame:
        """Rows (by, order, pose, converged) of all scans processed."""
        return self._all("poses", self._last()).drop("batch")

    def cloud(self) -> DataFrame:
        """The map (by, x, y, z), thinned to voxels."""
        return voxel_downsample(self._all("cloud", self._last()), self.voxel, by=(self.by,)).select(self.by, "x", "y", "z")

    def status(self) -> dict[str, Any]:
        """Whether it runs, scans and points processed, late points, scans held back, and the last error."""
        error = self.running.exception() if self.running is not None else None
        last = self._last()
        log = self._all("log", last).agg(F.sum("scans"), F.sum("points"), F.sum("late")).first() if last is not None else (0, 0, 0)
        held = self._at("pending", last).select(self.by, self.order).distinct().count() if last is not None else 0
        return {"running": self.running is not None and self.running.isActive, "scans": log[0], "points": log[1], "late": log[2], "held": held, "last_error": str(error) if error else None}

    def process(self, batch: DataFrame, number: int) -> None:
        """One batch of the stream; its number makes it happen once."""
        last = self._last()
        if last is not None and number <= last:
            return
        with temporary_tables(self.spark):
            self._process(batch.select(self.by, self.order, "t", "x", "y", "z"), number, last)

    def _process(self, batch: DataFrame, number: int, last: int | None) -> None:
        by, order = self.by, self.order
        rows = batch
        if last is not None:
            rows = rows.unionByName(self._at("pending", last).drop("batch"))
        rows = mapping.materialise(rows, "session-rows")
        before = self._at("log", last).first().newest if last is not None else None
        newest = max((x for x in (before, rows.agg(F.max("t")).first()[0]) if x is not None), default=None)
        until = newest - self.late if newest is not None else 0.0
        self._write(rows.where(F.col("t") > until), "pending", number)
        prior = self._at("last", last).drop("batch") if last is not None else None
        ready = rows.where(F.col("t") <= until)
        if prior is not None:
            reached = prior.groupBy(by).agg(F.first(order).alias("_reached"), F.first("pose").alias("_base"))
            ready = ready.join(reached, by, "left")
        else:
            ready = ready.withColumns({"_reached": F.lit(None).cast(rows.schema[order].dataType), "_base": F.lit(None).cast(mapping.POSE_KIND)})
        fresh = F.col("_reached").isNull() | (F.col(order) > F.col("_reached"))
        late = ready.where(~fresh).count()
        new = mapping.materialise(ready.where(fresh), "session-scans")
        bases = new.groupBy(by).agg(F.first("_base").alias("_base"), F.first("_reached").alias("_reached"))
        scans = new.select(by, order, "x", "y", "z")
        if prior is not None:  # the scan before, for those that go on
            scans = scans.unionByName(prior.join(bases.select(by), by, "left_semi").select(by, order, "x", "y", "z"))
        found, kept = mapping.scan_poses(scans, by, order, self.voxel, **self.options)
        base, pose = Pose.from_struct("_base"), Pose.from_struct("pose")
        moved = F.when(F.col("_base").isNull(), F.col("pose")).otherwise((base @ pose).struct())
        poses = found.join(bases, by).where(fresh).select(by, order, moved.alias("pose"), "converged")
        self._write(poses, "poses", number)
        poses = self._at("poses", number).drop("batch")
        self._write(mapping.placed(kept, poses, by, order), "cloud", number)
        ends = poses.groupBy(by).agg(F.max_by(F.struct(order, "pose"), order).alias("_end")).select(by, F.col(f"_end.{order}").alias(order), "_end.pose")
        newly = new.select(by, order, "x", "y", "z").join(ends, [by, order]).select(by, order, "x", "y", "z", "pose")
        if prior is not None:
            newly = newly.unionByName(prior.join(bases.select(by), by, "left_anti").select(newly.columns))
        self._write(newly, "last", number)
        counts = poses.agg(F.count("*").alias("scans")).crossJoin(new.agg(F.count("*").alias("points")))  # a row each
        self._write(counts.withColumns({"late": F.lit(late).cast("long"), "newest": F.lit(newest).cast("double")}), "log", number)

    def _write(self, rows: DataFrame, table: str, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{table}/batch={number}")

    def _at(self, table: str, number: int) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.folder}/{table}").parquet(f"{self.folder}/{table}/batch={number}")

    def _all(self, table: str, last: int | None) -> DataFrame:
        if last is None:
            raise ValueError("the session has processed nothing yet")
        return self.spark.read.parquet(f"{self.folder}/{table}").where(F.col("batch") <= last)

    def _last(self) -> int | None:
        """The newest batch that is logged."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/log")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return None
        done = [int(f.getPath().getName()[6:]) for f in files.listStatus(path) if f.getPath().getName().startswith("batch=") and files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
        return max(done, default=None)
