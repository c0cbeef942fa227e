"""Running sums and products over one order of all rows, however long a group is.

Rows are sorted once, by ranges that Spark finds by sampling. Each partition of the sort makes its own running values; what is added up in one
place is a row or two for each partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.functions.geometry import Pose
from pointloom.operators.durable import materialise

POSE = (*(f"r{i}{j}" for i in range(3) for j in range(3)), "tx", "ty", "tz")


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """The rows in one global order, with their number (``position``, from 1) and running sums over all rows up to each.

    Rows are dealt to partitions by ranges of the order, which Spark finds by sampling, so that no task holds a whole
    group. What is added up in one place is one row for each partition. Ties are ordered somehow.
    """
    cells = rows.orderBy(*order).withColumn("part", F.spark_partition_id()).withColumn("position", F.monotonically_increasing_id())
    cells = materialise(cells.withColumn("position", F.col("position").bitwiseAND(F.lit((1 << 33) - 1)) + 1), name)
    totals = cells.groupBy("part").agg(F.max("position").alias("_position"), *(F.sum(v).alias(f"_{k}") for k, v in sums.items()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    names = ["position", *sums]
    totals = totals.select(F.col("part").alias("_part"), *(F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in names))
    inside = Window.partitionBy("part").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    out = cells.withColumns({k: F.sum(v).over(inside) for k, v in sums.items()}) if sums else cells
    out = out.join(F.broadcast(totals), F.col("part") == F.col("_part"))  # one row for each partition of a sort
    return out.withColumns({k: F.col(k) + F.col(f"_{k}") for k in names}).drop("part", "_part", *(f"_{k}" for k in names))


# --- one long session over all partitions ----------------------------------------------------------------------------


def _local(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...], columns: tuple[str, ...], out: tuple[str, ...], run: Callable, name: str) -> DataFrame:
    """The rows in order of group and ``order``, with what ``run`` makes of each group's columns within a partition of the sort (``out``); written down.

    ``run`` gets the values of some rows, where groups begin in them, and what it returned last, and returns the values of ``out`` and that.
    _part and _place are a row's partition and number in it, and _first is whether its group is the partition's first, which may have begun before.
    """
    ordered = rows.orderBy(*(F.col(c) for c in by), *(F.col(c) for c in order))
    kinds = [("_part", T.IntegerType()), ("_place", T.LongType()), ("_first", T.BooleanType()), *((c, T.DoubleType()) for c in out)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, groups, last, state = TaskContext.get().partitionId(), 0, 0, None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = list(zip(*(batch.column(c).to_pylist() for c in by))) or [()] * n
            starts = np.array([k != b for k, b in zip(keys, [last, *keys])])
            values = np.stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns], axis=1)
            made, state = run(values, starts, state)
            number = groups + np.cumsum(starts)
            groups, last = int(number[-1]), keys[-1]
            added = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(place, place + n)), pa.array(number == 1), *(pa.array(made[:, k].copy()) for k in range(len(out)))]
            place += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *(k for k, _ in kinds)])

    schema = T.StructType([*rows.schema.fields, *(T.StructField(k, t) for k, t in kinds)])
    return materialise(ordered.mapInArrow(work, schema), name)


def _ends(cells: DataFrame, by: tuple[str, ...], columns: tuple[str, ...]) -> list[tuple]:
    """For each partition in order: its number, the first and last group, whether they are one, and ``columns`` in the first and the last row."""
    group = F.struct(F.lit(0).alias("_"), *by)
    values = F.struct(*columns)
    found = cells.groupBy("_part").agg(F.min_by(group, "_place"), F.max_by(group, "_place"), F.bool_and("_first"), F.min_by(values, "_place"), F.max_by(values, "_place"))
    return sorted((r[0], tuple(r[1]), tuple(r[2]), r[3], np.array(r[4], float), np.array(r[5], float)) for r in found.collect())  # a row for each partition


def _with_offsets(cells: DataFrame, offsets: list[tuple], names: tuple[str, ...]) -> DataFrame:
    kind = ", ".join(["_of int", *(f"_o_{c} double" for c in names)])
    table = cells.sparkSession.createDataFrame([(p, *map(float, o)) for p, o in offsets], kind)
    return cells.join(F.broadcast(table), F.col("_first") & (F.col("_part") == F.col("_of")), "left")  # a row for each partition


def _products(values: np.ndarray, starts: np.ndarray, state: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Running products of poses within groups, in steps of doubling length."""
    m = np.zeros((len(values), 4, 4))
    m[:, :3, :3], m[:, :3, 3], m[:, 3, 3] = values[:, :9].reshape(-1, 3, 3), values[:, 9:], 1
    closed, d = starts.copy(), 1
    while d < len(m):
        open_ = np.flatnonzero(~closed[d:]) + d
        fresh = m[open_ - d] @ m[open_]
        later = closed[d:] | closed[:-d]
        m[open_] = fresh
        closed[d:] = later
        d *= 2
    if state is not None:
        before = np.cumsum(starts) == 0
        m[before] = state @ m[before]
    return np.concatenate((m[:, :3, :3].reshape(-1, 9), m[:, :3, 3]), axis=1), m[-1]


def _matrix(flat: np.ndarray) -> np.ndarray:
    m = np.eye(4)
    m[:3, :3], m[:3, 3] = flat[:9].reshape(3, 3), flat[9:]
    return m


def pose_chain(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...], carry: tuple[str, ...] = ()) -> DataFrame:
    """``folds.pose_chain`` for groups of any length: rows (by, carry, r00 .. r22, tx, ty, tz), the product of all steps up to each row.

    ``order`` tells rows of a group apart. An empty table gives an empty result.
    """
    names = tuple(dict.fromkeys((*by, *carry)))
    steps = rows.select(*dict.fromkeys((*by, *order, *carry, *POSE)))
    cells = _local(steps, by, order, POSE, tuple(f"_{c}" for c in POSE), _products, "pose-products")
    offsets, now, open_group = [], np.eye(4), None
    for part, first, last, one, _, end in _ends(cells, by, tuple(f"_{c}" for c in POSE)):
        now = now if first == open_group else np.eye(4)
        offsets.append((part, [*now[:3, :3].ravel(), *now[:3, 3]]))
        now, open_group = (now @ _matrix(end) if one else _matrix(end)), last
    both = _with_offsets(cells, offsets, POSE)
    own = Pose(tuple(F.col(f"_{c}") for c in POSE[:9]), tuple(F.col(f"_{c}") for c in POSE[9:]))
    before = Pose(tuple(F.col(f"_o_{c}") for c in POSE[:9]), tuple(F.col(f"_o_{c}") for c in POSE[9:]))
    whole = before @ own
    flat = dict(zip(POSE, zip((*whole.r, *whole.t), (*own.r, *own.t))))
    return both.select(*names, *(F.when(F.col("_of").isNotNull(), a).otherwise(b).alias(c) for c, (a, b) in flat.items()))


def _jumps(jump: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    def run(values: np.ndarray, starts: np.ndarray, state: tuple[float, float] | None) -> tuple[np.ndarray, tuple[float, float]]:
        v = values[:, 0]
        last, total = state or (np.nan, 0.0)
        own = np.where(starts, 0.0, jump(np.concatenate(([last], v[:-1])), v))
        sums = total + np.cumsum(own)
        at = np.maximum.accumulate(np.where(starts, np.arange(len(v)), -1))
        sums = np.where(at >= 0, sums - sums[np.maximum(at, 0)], sums)
        return sums[:, None], (float(v[-1]), float(sums[-1]))

    return run


def _jump_sums(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...], column: str, jump: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Rows with _sum: the sum of ``jump`` of each value of ``column`` and the one before in its group, up to each row. Nulls are NaN to it."""
    cells = _local(rows, by, order, (column,), ("_sum",), _jumps(jump), "jump-sums")
    offsets, now, open_group, before = [], 0.0, None, np.nan
    for part, first, last, one, begin, end in _ends(cells.withColumn("_v", F.col(column).cast("double")), by, ("_v", "_sum")):
        now = now + float(jump(np.array([before]), begin[:1])[0]) if first == open_group else 0.0
        offsets.append((part, [now]))
        now, open_group, before = (now if one else 0.0) + end[1], last, end[0]
    both = _with_offsets(cells, offsets, ("sum",))
    return both.select(*rows.columns, (F.col("_sum") + F.coalesce("_o_sum", F.lit(0.0))).alias("_sum"))


def unwrap_yaw(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...], yaw: str = "yaw") -> DataFrame:
    """``ordered.unwrap_yaw`` for groups of any length."""

    def turn(before: np.ndarray, now: np.ndarray) -> np.ndarray:
        return np.where(now - before > 180, -360.0, np.where(now - before < -180, 360.0, 0.0))

    return _jump_sums(rows, by, order, yaw, turn).withColumn("yaw_unwrapped", F.col(yaw) + F.col("_sum")).drop("_sum")


def sweep_ids(returns: DataFrame, by: tuple[str, ...], order: tuple[str, ...], azimuth: str = "azimuth_deg") -> DataFrame:
    """``ordered.sweep_ids`` for groups of any length."""

    def wrap(before: np.ndarray, now: np.ndarray) -> np.ndarray:
        return ((now < before) & (before > 270) & (now < 90)).astype(float)

    return _jump_sums(returns, by, order, azimuth, wrap).withColumn("sweep", F.col("_sum").cast("long")).drop("_sum")
