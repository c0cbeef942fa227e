"""Window operators over ordered sensor rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.geometry import Pose, matmul, quaternion_from_rotation, rotation_from_quaternion, slerp, transpose


def sweep_ids(returns: DataFrame, by: tuple[str, ...], order: tuple[str, ...], azimuth: str = "azimuth_deg") -> DataFrame:
    """Rows with sweep: a new one begins where the azimuth falls from over 270 to under 90 degrees."""
    w = Window.partitionBy(*by).orderBy(*order)
    last = F.lag(azimuth).over(w)
    wrap = ((F.col(azimuth) < last) & (last > 270) & (F.col(azimuth) < 90)).cast("int")
    marked = returns.withColumn("_wrap", F.coalesce(wrap, F.lit(0)))
    return marked.withColumn("sweep", F.sum("_wrap").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_wrap")


def unwrap_yaw(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...], yaw: str = "yaw") -> DataFrame:
    """Rows with yaw_unwrapped: jumps of over half a turn are taken as wraps."""
    w = Window.partitionBy(*by).orderBy(*order)
    step = F.col(yaw) - F.lag(yaw).over(w)
    marked = rows.withColumn("_turn", F.when(step > 180, -360.0).when(step < -180, 360.0).otherwise(0.0))
    return marked.withColumn("yaw_unwrapped", F.col(yaw) + F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_turn")


def dead_reckoning(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...], yaw: str = "yaw", step: Column | float = 1.0) -> DataFrame:
    """Rows with x and y: running sums of steps along the heading (degrees)."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = step if isinstance(step, Column) else F.lit(float(step))
    return rows.withColumns({"x": F.sum(d * F.cos(F.radians(yaw))).over(w), "y": F.sum(d * F.sin(F.radians(yaw))).over(w)})


def pose_deltas(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...], columns: tuple[str, ...] = ("x", "y", "z", "yaw")) -> DataFrame:
    """Rows with d_*: the difference to the row before, null at the first; angles are not wrapped."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumns({f"d_{c}": F.col(c) - F.lag(c).over(w) for c in columns})


def delta_rotation(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...], q: tuple[str, str, str, str] = ("qw", "qx", "qy", "qz")) -> DataFrame:
    """Rows with r00 .. r22: the rotation from the row before, R_before^T R; null at the first."""
    w = Window.partitionBy(*by).orderBy(*order)
    now = rotation_from_quaternion(tuple(F.col(c) for c in q))
    before = rotation_from_quaternion(tuple(F.lag(c).over(w) for c in q))
    d = matmul(transpose(before), now)
    return rows.withColumns({f"r{i}{j}": d[3 * i + j] for i in range(3) for j in range(3)})


def odometry(poses: DataFrame, by: tuple[str, ...], order: tuple[str, ...], pose: str = "pose") -> DataFrame:
    """Rows with step: the transform to the next pose, inverse(T) next(T); the last row of a group has none and goes."""
    w = Window.partitionBy(*by).orderBy(*order)
    both = poses.withColumn("_next", F.lead(pose).over(w)).where("_next is not null")
    step = Pose.from_struct(pose).inverse() @ Pose.from_struct("_next")
    return both.withColumn("step", step.struct()).drop("_next")


def poses_between(rows: DataFrame, t0: str, a: str, t1: str, b: str, t: str, out: str = "pose") -> DataFrame:
    """Rows with the pose at time t of a motion from pose a at t0 to pose b at t1: the translation goes on beyond both ends, the rotation does not; a where the times are equal.

    The steps are columns of their own, for a single expression would repeat each of them in the next.
    """
    quaternion = lambda q: F.struct(*(v.alias(c) for v, c in zip(q, "wxyz")))
    of = lambda name: tuple(F.col(f"{name}.{c}") for c in "wxyz")
    span = F.col(t1) - F.col(t0)
    staged = rows.withColumns({"_alpha": F.when(span == 0, 0.0).otherwise((F.col(t) - F.col(t0)) / F.when(span == 0, 1.0).otherwise(span)), "_qa": quaternion(quaternion_from_rotation(Pose.from_struct(a).r)), "_qb": quaternion(quaternion_from_rotation(Pose.from_struct(b).r))})
    staged = staged.withColumn("_q", quaternion(slerp(of("_qa"), of("_qb"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_alpha"))))))
    place = tuple(F.col(f"{a}.t{c}") + F.col("_alpha") * (F.col(f"{b}.t{c}") - F.col(f"{a}.t{c}")) for c in "xyz")
    return staged.withColumn(out, Pose(rotation_from_quaternion(of("_q"), unit=True), place).struct()).drop("_alpha", "_qa", "_qb", "_q")


def segments(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...], columns: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Rows with to_*: the next row's position; a group's last row has no segment."""
    w = Window.partitionBy(*by).orderBy(*order)
    out = rows.withColumns({f"to_{c}": F.lead(c).over(w) for c in columns})
    return out.where(F.col(f"to_{columns[0]}").isNotNull())


def rates(rows: DataFrame, by: tuple[str, ...], t: str = "t", width: float = 1.0) -> DataFrame:
    """Rows (by, slot, n, hz): counts in slots of ``width`` seconds."""
    slot = F.floor(F.col(t) / width).cast("long").alias("slot")
    return rows.groupBy(*by, slot).agg(F.count("*").alias("n")).withColumn("hz", F.col("n") / F.lit(width))


def latest(rows: DataFrame, by: tuple[str, ...], t: str = "t", tie: str = "seq") -> DataFrame:
    """The last row of each group."""
    value = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*value), F.struct(t, tie)).alias("v")).select(*by, "v.*")


def newest(rows: DataFrame, by: tuple[str, ...], n: int, t: str = "t", tie: str = "seq") -> DataFrame:
    """The last n rows of each group."""
    w = Window.partitionBy(*by).orderBy(F.col(t).desc(), F.col(tie).desc())
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def decimate(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...], most: int) -> DataFrame:
    """Every k-th row of each group, k being its length over ``most`` (at least 1); groups of no more than ``most`` stay whole."""
    w = Window.partitionBy(*by)
    n = F.count("*").over(w)
    step = F.when(n <= most, 1).otherwise(F.greatest(F.lit(1), F.floor(n / most)))
    numbered = rows.withColumns({"_step": step, "_at": F.row_number().over(w.orderBy(*order)) - 1})
    return numbered.where(F.col("_at") % F.col("_step") == 0).drop("_step", "_at")


def rotation_report(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...], expected: float = 0.0, tolerance: float = 5.0) -> DataFrame:
    """The rotation test per sensor: slope of the unwrapped yaw, mean gyro in degrees, elapsed time, total turn, and whether either estimate is within tolerance."""
    seq = F.struct(*order)
    turned = unwrap_yaw(rows, by, order)
    out = turned.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.regr_slope("yaw_unwrapped", "t").alias("slope"),
        (F.avg("gz") * (180 / math.pi)).alias("gyro_rate"),
        (F.max("t") - F.min("t")).alias("elapsed"),
        (F.max_by("yaw_unwrapped", seq) - F.min_by("yaw_unwrapped", seq)).alias("total_turn"),
    )
    off = lambda c: F.abs(F.col(c) - expected) <= tolerance
    return out.withColumn("passed", F.coalesce(off("slope"), F.lit(False)) | F.coalesce(off("gyro_rate"), F.lit(False)))


def accumulate_world(cloud: DataFrame, attitudes: DataFrame, scan: str = "scan_id", q: tuple[str, str, str, str] = ("qw", "qx", "qy", "qz")) -> DataFrame:
    """Points with wx, wy, wz: turned by their scan's quaternion; scans without one go."""
    r = rotation_from_quaternion(tuple(F.col(c) for c in q))
    world = [r[3 * i] * F.col("x") + r[3 * i + 1] * F.col("y") + r[3 * i + 2] * F.col("z") for i in range(3)]
    turned = cloud.join(attitudes.where(F.col(q[0]).isNotNull()).select(scan, *q), scan)
    return turned.withColumns(dict(zip(("wx", "wy", "wz"), world))).drop(*q)
