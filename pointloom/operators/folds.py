"""Ordered folds over sensor rows: attitude filters, gyro pre-integration, keyframes.

A group is sequential, but groups are not: rows are dealt by their group, numbered in its order and streamed by number,
so that each step advances all groups of a partition at once. What is held is the state of each group, never its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.operators.durable import discard, materialise

#: State and inputs of some groups (rows), to their next state, outputs, and which of them give a row (None: all).
Step = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray | None]]
IDENTITY = (1.0, 0.0, 0.0, 0.0)


def ordered_fold(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...], inputs: tuple[str, ...], start: tuple[float, ...], step: Step, out: tuple[str, ...], carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (by, carry, out): ``step`` goes over each group in its order, from the state ``start``; null inputs are NaN.

    Ties in ``order`` are taken in any order. All outputs are doubles. A fold without rows has none.
    """
    names = list(dict.fromkeys([*by, *carry]))
    w = Window.partitionBy(*by).orderBy(*order)
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    numbered = numbered.select(*names, *(F.col(c).cast("double").alias(f"_in{i}") for i, c in enumerate(inputs)), F.row_number().over(w).alias("_step"), F.first("_row").over(w).alias("_group"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, state = np.empty(0, np.int64), np.empty((0, len(start)))
        for batch in batches:
            if not batch.num_rows:
                continue
            number, group = (batch.column(c).to_numpy() for c in ("_step", "_group"))
            x = np.stack([batch.column(f"_in{i}").to_numpy(zero_copy_only=False) for i in range(len(inputs))], axis=1)
            made, keep = np.empty((batch.num_rows, len(out))), np.ones(batch.num_rows, dtype=bool)
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if number[a] == 1:  # groups begin, in the order of their numbers
                    groups = np.concatenate((groups, group[a:b]))
                    state = np.concatenate((state, np.tile(np.array(start, dtype=float), (b - a, 1))))
                at = np.searchsorted(groups, group[a:b])
                state[at], made[a:b], some = step(state[at], x[a:b])
                if some is not None:
                    keep[a:b] = some
            columns = [batch.column(c) for c in names] + [pa.array(made[:, i]) for i in range(len(out))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *out]).filter(pa.array(keep))

    schema = T.StructType([*(rows.schema[c] for c in names), *(T.StructField(c, T.DoubleType()) for c in out)])
    return numbered.repartition(*by).sortWithinPartitions("_step", "_group").mapInArrow(run, schema)


def _unit(v: np.ndarray, least: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """Rows of unit length, and which rows are long enough to have one; the others stay as they are."""
    n = np.sqrt((v * v).sum(axis=1))
    ok = n >= least
    return np.where(ok[:, None], v / np.where(ok, n, 1.0)[:, None], v), ok


def _finish(q: np.ndarray, moved: np.ndarray) -> np.ndarray:
    unit, ok = _unit(moved)
    return np.where(ok[:, None], unit, q)


def _rate(q: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Half of q times the pure quaternion of g."""
    w, x, y, z = q.T
    a, b, c = g.T
    return 0.5 * np.stack((-x * a - y * b - z * c, w * a + y * c - z * b, w * b - x * c + z * a, w * c + x * b - y * a), axis=1)


def gyro_step(q: np.ndarray, g: np.ndarray, dt: float) -> np.ndarray:
    """One Euler step whose components are updated in turn, each from those already updated."""
    w, x, y, z = (c.copy() for c in q.T)
    a, b, c = g.T
    w += 0.5 * (-x * a - y * b - z * c) * dt
    x += 0.5 * (w * a + y * c - z * b) * dt
    y += 0.5 * (w * b - x * c + z * a) * dt
    z += 0.5 * (w * c + x * b - y * a) * dt
    return _finish(q, np.stack((w, x, y, z), axis=1))


def _descend(q: np.ndarray, g: np.ndarray, slope: np.ndarray, beta: float, dt: float) -> np.ndarray:
    return _finish(q, q + (_rate(q, g) - beta * _unit(slope)[0]) * dt)


def _north(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The field in the world's frame."""
    w, x, y, z = q.T
    a, b, c = m.T
    return np.stack(
        (
            2 * a * (0.5 - y * y - z * z) + 2 * b * (x * y - w * z) + 2 * c * (x * z + w * y),
            2 * a * (x * y + w * z) + 2 * b * (0.5 - x * x - z * z) + 2 * c * (y * z - w * x),
            2 * a * (x * z - w * y) + 2 * b * (y * z + w * x) + 2 * c * (0.5 - x * x - y * y),
        ),
        axis=1,
    )


def _field(q: np.ndarray, bx: np.ndarray, bz: np.ndarray) -> np.ndarray:
    """A field (bx, 0, bz) of the world as the sensor should see it."""
    w, x, y, z = q.T
    return np.stack((2 * bx * (0.5 - y * y - z * z) + 2 * bz * (x * z - w * y), 2 * bx * (x * y - w * z) + 2 * bz * (w * x + y * z), 2 * bx * (w * y + x * z) + 2 * bz * (0.5 - x * x - y * y)), axis=1)


def _six_axes(q: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The slope of the six-axis form. It is a form kept for compatibility: the published step has the Jacobian of f with
    the signs (-2y, 2z, -2w, 2x), (2x, 2w, 2z, 2y), (0, -4x, -4y, 0); here the parts of w, x and y are negated, that of z
    is not, and a pull towards x^2 + y^2 = 1/2 is added to w, x and y."""
    w, x, y, z = q.T
    f = np.stack((2 * (x * z - w * y) - a[:, 0], 2 * (w * x + y * z) - a[:, 1], 1 - 2 * (x * x + y * y) - a[:, 2]), axis=1)
    o = np.zeros_like(w)
    # fixed coefficients of the six-axis form
    rows = np.array(((2 * y, -2 * z, 2 * w, 2 * x), (-2 * x, -2 * w, -2 * z, 2 * y), (o, 4 * x, 4 * y, o)))
    pull = 4 * (x * x + y * y - 0.5)
    return pull[:, None] * np.stack((w, x, y, o), axis=1) + np.einsum("kin,nk->ni", rows, f)


def _nine_axes(q: np.ndarray, a: np.ndarray, m: np.ndarray) -> np.ndarray:
    w, x, y, z = q.T
    f = np.stack((2 * (x * z - w * y) - a[:, 0], 2 * (w * x + y * z) - a[:, 1], 1 - 2 * (x * x + y * y) - a[:, 2]), axis=1)
    h = _north(q, m)
    bx, bz = np.hypot(h[:, 0], h[:, 1]), h[:, 2]
    d = _field(q, bx, bz) - m
    o = np.zeros_like(w)
    jacobian = np.array(
        (
            (-2 * y, 2 * z, -2 * w, 2 * x),
            (2 * x, 2 * w, 2 * z, 2 * y),
            (o, -4 * x, -4 * y, o),
            (-2 * bz * y, 2 * bz * z, -4 * bx * y - 2 * bz * w, -4 * bx * z + 2 * bz * x),
            (-2 * bx * z + 2 * bz * x, 2 * bx * y + 2 * bz * w, 2 * bx * x + 2 * bz * z, -2 * bx * w + 2 * bz * y),
            (2 * bx * y, 2 * bx * z - 4 * bz * x, 2 * bx * w - 4 * bz * y, 2 * bx * x),
        )
    )
    return np.einsum("kin,nk->ni", jacobian, np.concatenate((f, d), axis=1))


def _directions(a: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit gravity and field, and which rows have each; a null component (NaN) is no field."""
    a, falls = _unit(np.nan_to_num(a))
    known = ~np.isnan(m).any(axis=1)
    m, points = _unit(np.nan_to_num(m))
    return a, falls, m, falls & known & points


def madgwick(q: np.ndarray, g: np.ndarray, a: np.ndarray, m: np.ndarray, beta: float, dt: float) -> np.ndarray:
    """Gradient descent on gravity, and on the field where there is one; without gravity the gyro alone."""
    a, falls, m, points = _directions(a, m)
    out = q.copy()
    for some, slope in ((~falls, None), (falls & ~points, lambda i: _six_axes(q[i], a[i])), (points, lambda i: _nine_axes(q[i], a[i], m[i]))):
        i = np.flatnonzero(some)
        if len(i):
            out[i] = gyro_step(q[i], g[i], dt) if slope is None else _descend(q[i], g[i], slope(i), beta, dt)
    return out


def mahony(q: np.ndarray, total: np.ndarray, g: np.ndarray, a: np.ndarray, m: np.ndarray, kp: float, ki: float, dt: float) -> tuple[np.ndarray, np.ndarray]:
    """Proportional and integral feedback of direction errors; without gravity nothing changes."""
    a, falls, m, points = _directions(a, m)
    w, x, y, z = q.T
    e = np.cross(a, np.stack((2 * (x * z - w * y), 2 * (w * x + y * z), w * w - x * x - y * y + z * z), axis=1))
    h = _north(q, m)
    e = np.where(points[:, None], e + np.cross(m, _field(q, np.hypot(h[:, 0], h[:, 1]), h[:, 2])), e)
    summed = total + e * dt if ki > 0 else total
    turned = gyro_step(q, g + ki * summed + kp * e if ki > 0 else g + kp * e, dt)
    return np.where(falls[:, None], turned, q), np.where(falls[:, None], summed, total)


IMU = ("gx", "gy", "gz", "ax", "ay", "az", "mx", "my", "mz")
QUATERNION = ("qw", "qx", "qy", "qz")


def attitude(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...], method: str = "madgwick", rate: float = 100.0, beta: float = 0.1, kp: float = 0.5, ki: float = 0.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (by, carry, qw, qx, qy, qz) of an attitude filter with a fixed step of 1 / rate; rows with null field columns take six axes."""
    dt = 1.0 / rate
    if method == "madgwick":

        def step(q, x):
            q = madgwick(q, x[:, :3], x[:, 3:6], x[:, 6:9], beta, dt)
            return q, q, None

        return ordered_fold(rows, by, order, IMU, IDENTITY, step, QUATERNION, carry)
    if method == "mahony":

        def step(s, x):
            q, total = mahony(s[:, :4], s[:, 4:], x[:, :3], x[:, 3:6], x[:, 6:9], kp, ki, dt)
            return np.concatenate((q, total), axis=1), q, None

        return ordered_fold(rows, by, order, IMU, (*IDENTITY, 0.0, 0.0, 0.0), step, QUATERNION, carry)
    if method == "gyro":

        def step(q, x):
            q = gyro_step(q, x, dt)
            return q, q, None

        return ordered_fold(rows, by, order, IMU[:3], IDENTITY, step, QUATERNION, carry)
    raise ValueError(f"no attitude filter {method!r}")


def _valid(s: np.ndarray, x: np.ndarray, at: int, still: float, most_dt: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows (t, gx, gy, gz) turn anything after the time at ``s[:, at]`` (NaN before the first), and their time steps."""
    dt = x[:, 0] - s[:, at]
    return (dt > 0) & (dt <= most_dt) & (np.sqrt((x[:, 1:] ** 2).sum(axis=1)) >= still), np.nan_to_num(dt)


def preintegrate(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...], still: float = 0.005, most_dt: float = 1.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (by, carry, qw .. qz) of the rotation integrated so far from gx, gy, gz and t.

    Steps of no or over ``most_dt`` seconds, and rates below ``still``, turn nothing. A group begins with the identity.
    """

    def step(s, x):
        ok, dt = _valid(s, x, 4, still, most_dt)
        q = np.where(ok[:, None], _finish(s[:, :4], s[:, :4] + _rate(s[:, :4], x[:, 1:]) * dt[:, None]), s[:, :4])
        return np.concatenate((q, x[:, :1]), axis=1), q, None

    return ordered_fold(rows, by, order, ("t", "gx", "gy", "gz"), (*IDENTITY, np.nan), step, QUATERNION, carry)


def skew_matrices(v: np.ndarray) -> np.ndarray:
    """The matrices (n, 3, 3) whose product with a vector is the cross product of each row of v with it."""
    k = np.zeros((len(v), 3, 3))
    k[:, 2, 1], k[:, 0, 2], k[:, 1, 0] = v.T
    return k - k.transpose(0, 2, 1)


def rotations(v: np.ndarray) -> np.ndarray:
    """The rotation matrices (n, 3, 3) of rotation vectors."""
    angle = np.sqrt((v * v).sum(axis=1))
    safe, k = np.where(angle > 1e-12, angle, 1.0), skew_matrices(v)
    a = np.where(angle > 1e-12, np.sin(safe) / safe, 1.0)[:, None, None]
    b = np.where(angle > 1e-12, (1 - np.cos(safe)) / safe**2, 0.5)[:, None, None]
    return np.eye(3) + a * k + b * (k @ k)


ROTATION = tuple(f"r{i}{j}" for i in range(3) for j in range(3))


def preintegrate_matrix(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...], most_dt: float = 1.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (by, carry, r00 .. r22): the rotation matrix integrated so far, each step turned exactly by the rate's rotation vector.

    Steps of no or over ``most_dt`` seconds turn nothing. A group begins with the identity.
    """

    def step(s, x):
        ok, dt = _valid(s, x, 9, 0.0, most_dt)
        v = np.where(ok[:, None], x[:, 1:] * dt[:, None], 0.0)
        u, _, vt = np.linalg.svd(s[:, :9].reshape(-1, 3, 3) @ rotations(v))  # back to the nearest rotation
        r = (u @ vt).reshape(-1, 9)
        return np.concatenate((r, x[:, :1]), axis=1), r, None

    start = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, np.nan)
    return ordered_fold(rows, by, order, ("t", "gx", "gy", "gz"), start, step, ROTATION, carry)


def keyframes(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...], distance: float = 0.05, angle: float = 2.0, both: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """The rows (by, carry, x, y, z, yaw) that are keyframes: the first, and each that is ``distance`` away or turned ``angle`` degrees since the last keyframe.

    With ``both`` unset either suffices; a row within both limits is skipped. yaw is in degrees, turns take the shorter way.
    """
    if distance < 0 or angle < 0:
        raise ValueError("thresholds can't be negative")

    def step(last, x):
        first = np.isnan(last[:, 4])
        d = x[:, :3] - last[:, :3]
        far = np.sqrt((d * d).sum(axis=1)) >= distance
        turned = np.abs((x[:, 3] - last[:, 3] + 180) % 360 - 180) >= angle
        take = first | (far & turned if both else far | turned)
        state = np.where(take[:, None], np.concatenate((x, np.zeros((len(x), 1))), axis=1), last)
        return state, x, take

    return ordered_fold(rows, by, order, ("x", "y", "z", "yaw"), (0.0, 0.0, 0.0, 0.0, np.nan), step, ("x", "y", "z", "yaw"), carry)


def pose_chain(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...], carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (by, carry, r00 .. r22, tx, ty, tz): the product of all steps up to each row.

    A step has the columns r00 .. r22 and tx, ty, tz and is taken in the frame that the steps before lead to (T = T_before step).
    """

    def step(s, x):
        r, d = s[:, :9].reshape(-1, 3, 3), x[:, :9].reshape(-1, 3, 3)
        t = s[:, 9:] + (r @ x[:, 9:, None])[:, :, 0]
        out = np.concatenate(((r @ d).reshape(-1, 9), t), axis=1)
        return out, out, None

    names = (*ROTATION, "tx", "ty", "tz")
    return ordered_fold(rows, by, order, names, (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0), step, names, carry)


def farthest_points(cloud: DataFrame, by: tuple[str, ...], n: int, key: str = "point_id", seed: int = 0, small: int = 1_000_000) -> DataFrame:
    """Rows (by, key, rank): from the point number seed mod count of each group on, the point farthest from all chosen so far, ties to the smaller key.

    Groups of up to ``small`` points are held by one task each; larger ones are never gathered: each choice is a grouped maximum over
    the distances, which are a table. Both give the same points.
    """
    import pandas as pd

    sizes = materialise(cloud.groupBy(*by).agg(F.count("*").alias("_size")), "group-sizes")
    rows = cloud.select(*by, key, "x", "y", "z")

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(key)
        xyz = group[["x", "y", "z"]].to_numpy()
        chosen, d = [seed % len(xyz)], np.full(len(xyz), np.inf)
        while len(chosen) < min(n, len(xyz)):
            d = np.minimum(d, ((xyz - xyz[chosen[-1]]) ** 2).sum(axis=1))
            chosen.append(int(d.argmax()))
        return group.iloc[chosen][[*by, key]].assign(rank=np.arange(1, len(chosen) + 1))

    schema = ", ".join([*(f"{c} {cloud.schema[c].dataType.simpleString()}" for c in (*by, key)), "rank long"])
    few = sizes.where(F.col("_size") <= small).drop("_size")
    out = rows.join(few, list(by), "left_semi").groupBy(*by).applyInPandas(pick, schema)
    many = sizes.where(F.col("_size") > small)
    if many.isEmpty():
        return out
    place = F.row_number().over(Window.partitionBy(*by).orderBy(key)) - 1
    state = rows.join(many, list(by)).withColumn("_first", place == F.lit(seed) % F.col("_size"))
    state = materialise(state.withColumn("_d", F.when(F.col("_first"), float("inf")).otherwise(-1.0)).drop("_first", "_size"), "farthest-distances")
    for rank in range(1, n + 1):
        best = materialise(state.groupBy(*by).agg(F.min_by(F.struct(key, "x", "y", "z", "_d"), F.struct(-F.col("_d"), key)).alias("_c")), "farthest-choice")
        out = out.unionByName(best.where("_c._d <> 0 or {} = 1".format(rank)).select(*by, f"_c.{key}", F.lit(rank).cast("long").alias("rank")))
        if rank == n:
            break
        d = sum((F.col(c) - F.col(f"_c.{c}")) * (F.col(c) - F.col(f"_c.{c}")) for c in "xyz")
        near = F.when(F.col("_d") < 0, d).otherwise(F.least("_d", d)) if rank == 1 else F.least("_d", d)
        old, state = state, materialise(state.join(best, list(by)).withColumn("_d", near).drop("_c"), "farthest-distances")
        discard(old)
    return out
