"""Rotations, rigid transforms, cameras and colours as Column expressions.

All functions take and return Columns (or tuples of them), so that they stay inside generated code. Angles of Euler
functions are degrees, quaternions are (w, x, y, z), matrices are row-major tuples of nine.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Matrix = tuple[Column, ...]
Vector = tuple[Column, Column, Column]
Quaternion = tuple[Column, Column, Column, Column]


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def cols(*xs) -> tuple[Column, ...]:
    return tuple(col(x) for x in xs)


def norm(*xs) -> Column:
    return F.sqrt(sum((x * x for x in cols(*xs)), F.lit(0.0)))


def matmul(a: Matrix, b: Matrix) -> Matrix:
    return tuple(a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j] for i in range(3) for j in range(3))


def transpose(a: Matrix) -> Matrix:
    return tuple(a[3 * j + i] for i in range(3) for j in range(3))


def rotate(a: Matrix, v: Vector) -> Vector:
    return tuple(a[3 * i] * v[0] + a[3 * i + 1] * v[1] + a[3 * i + 2] * v[2] for i in range(3))


def skew(x, y, z) -> Matrix:
    x, y, z = cols(x, y, z)
    o = F.lit(0.0)
    return (o, -z, y, z, o, -x, -y, x, o)


def rotation_from_euler(roll, pitch, yaw) -> Matrix:
    """Rz(yaw) Ry(pitch) Rx(roll)."""
    (sr, cr), (sp, cp), (sy, cy) = ((F.sin(F.radians(a)), F.cos(F.radians(a))) for a in cols(roll, pitch, yaw))
    return (cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr, sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr, -sp, cp * sr, cp * cr)


def euler_from_rotation(r: Matrix) -> Vector:
    """(roll, pitch, yaw); near the pole yaw is 0."""
    flat = F.sqrt(r[0] * r[0] + r[3] * r[3])
    pole = flat < 1e-6
    roll = F.when(pole, F.atan2(-r[5], r[4])).otherwise(F.atan2(r[7], r[8]))
    yaw = F.when(pole, 0.0).otherwise(F.atan2(r[3], r[0]))
    return tuple(F.degrees(a) for a in (roll, F.atan2(-r[6], flat), yaw))


def quaternion_from_euler(roll, pitch, yaw) -> Quaternion:
    (sr, cr), (sp, cp), (sy, cy) = ((F.sin(F.radians(a) / 2), F.cos(F.radians(a) / 2)) for a in cols(roll, pitch, yaw))
    return (cr * cp * cy + sr * sp * sy, sr * cp * cy - cr * sp * sy, cr * sp * cy + sr * cp * sy, cr * cp * sy - sr * sp * cy)


def euler_from_quaternion(q: Quaternion) -> Vector:
    w, x, y, z = q
    s = 2 * (w * y - z * x)
    pitch = F.when(F.abs(s) >= 1, F.signum(s) * math.pi / 2).otherwise(F.asin(s))
    return (F.degrees(F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y))), F.degrees(pitch), F.degrees(F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))))


def normalised(q: Quaternion) -> Quaternion:
    n = norm(*q)
    return tuple(c / n for c in q)


def rotation_from_quaternion(q: Quaternion, unit: bool = False) -> Matrix:
    """``unit`` tells that q is known to be normalised and is used as it is."""
    w, x, y, z = q if unit else normalised(q)
    return (1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y))


def quaternion_from_rotation(r: Matrix) -> Quaternion:
    """The branch with the largest divisor, as for any rotation matrix; w is positive where the trace is."""
    trace = r[0] + r[4] + r[8]
    s0, s1, s2, s3 = (2 * F.sqrt(F.greatest(v, F.lit(0.0))) for v in (trace + 1, 1 + r[0] - r[4] - r[8], 1 + r[4] - r[0] - r[8], 1 + r[8] - r[0] - r[4]))
    one, two = (r[0] > r[4]) & (r[0] > r[8]), r[4] > r[8]
    pick = lambda a, b, c, d: F.when(trace > 0, a).when(one, b).when(two, c).otherwise(d)
    return (
        pick(s0 / 4, (r[7] - r[5]) / s1, (r[2] - r[6]) / s2, (r[3] - r[1]) / s3),
        pick((r[7] - r[5]) / s0, s1 / 4, (r[1] + r[3]) / s2, (r[2] + r[6]) / s3),
        pick((r[2] - r[6]) / s0, (r[1] + r[3]) / s1, s2 / 4, (r[5] + r[7]) / s3),
        pick((r[3] - r[1]) / s0, (r[2] + r[6]) / s1, (r[5] + r[7]) / s2, s3 / 4),
    )


def slerp(a: Quaternion, b: Quaternion, alpha) -> Quaternion:
    """The shorter way round; nearly equal quaternions are interpolated linearly and normalised."""
    t = col(alpha)
    dot = sum((x * y for x, y in zip(a, b)), F.lit(0.0))
    sign = F.when(dot < 0, -1.0).otherwise(1.0)
    d = F.least(F.abs(dot), F.lit(1.0))
    angle = F.acos(d)
    near = d > 0.9995
    wa = F.when(near, 1 - t).otherwise(F.sin((1 - t) * angle) / F.sin(angle))
    wb = F.when(near, t).otherwise(F.sin(t * angle) / F.sin(angle)) * sign
    return normalised(tuple(wa * x + wb * y for x, y in zip(a, b)))


def rotation_angle(r: Matrix) -> Column:
    """Degrees."""
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (r[0] + r[4] + r[8] - 1) / 2))))


def axis_angle(r: Matrix) -> Vector:
    """Rotation vector in radians; 0 below 1e-9, and near half a turn from the diagonal, without signs."""
    a = F.radians(rotation_angle(r))
    scale = a / (2 * F.sin(a))
    off = ((r[7] - r[5]), (r[2] - r[6]), (r[3] - r[1]))
    return tuple(F.when(a < 1e-9, 0.0).when(a > math.pi - 1e-6, a * F.sqrt(F.greatest((d + 1) / 2, F.lit(0.0)))).otherwise(scale * o) for o, d in zip(off, (r[0], r[4], r[8])))


@dataclass(frozen=True)
class Pose:
    """A rigid transform: rotation, then translation."""

    r: Matrix
    t: Vector

    @staticmethod
    def identity() -> Pose:
        return Pose(cols(1, 0, 0, 0, 1, 0, 0, 0, 1), cols(0, 0, 0))

    @staticmethod
    def from_euler(roll=0, pitch=0, yaw=0, x=0, y=0, z=0) -> Pose:
        return Pose(rotation_from_euler(roll, pitch, yaw), cols(x, y, z))

    @staticmethod
    def from_4dof(x, y, z, yaw) -> Pose:
        """yaw in radians."""
        s, c = F.sin(col(yaw)), F.cos(col(yaw))
        o = F.lit(0.0)
        return Pose((c, -s, o, s, c, o, o, o, F.lit(1.0)), cols(x, y, z))

    @staticmethod
    def from_struct(name: str) -> Pose:
        return Pose(tuple(F.col(f"{name}.r{i}{j}") for i in range(3) for j in range(3)), tuple(F.col(f"{name}.t{c}") for c in "xyz"))

    @staticmethod
    def from_columns(*names: str) -> Pose:
        """From twelve columns: the rotation by rows, then the translation."""
        return Pose(tuple(F.col(c) for c in names[:9]), tuple(F.col(c) for c in names[9:]))

    def struct(self) -> Column:
        return F.struct(*(self.r[3 * i + j].alias(f"r{i}{j}") for i in range(3) for j in range(3)), *(v.alias(f"t{c}") for v, c in zip(self.t, "xyz")))

    def __matmul__(self, other: Pose) -> Pose:
        moved = rotate(self.r, other.t)
        return Pose(matmul(self.r, other.r), tuple(a + b for a, b in zip(moved, self.t)))

    def inverse(self) -> Pose:
        back = transpose(self.r)
        return Pose(back, tuple(-v for v in rotate(back, self.t)))

    def apply(self, x, y, z) -> Vector:
        return tuple(a + b for a, b in zip(rotate(self.r, cols(x, y, z)), self.t))

    def interpolate(self, other: Pose, alpha, clip: bool = True) -> Pose:
        """Linear in translation, slerp in rotation; the translation extrapolates if ``clip`` is off."""
        a = col(alpha)
        inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), a))
        q = slerp(quaternion_from_rotation(self.r), quaternion_from_rotation(other.r), inside)
        k = inside if clip else a
        return Pose(rotation_from_quaternion(q), tuple(u + k * (v - u) for u, v in zip(self.t, other.t)))

    def to_4dof(self) -> tuple[Column, ...]:
        return (*self.t, F.atan2(self.r[3], self.r[0]))


def tilt_from_accel(ax, ay, az) -> tuple[Column, Column]:
    """(roll, pitch) in radians."""
    ax, ay, az = cols(ax, ay, az)
    return F.atan2(ay, az), F.atan2(-ax, F.sqrt(ay * ay + az * az))


def normalize_angle(a) -> Column:
    """Into [-pi, pi]; values already there stay as they are."""
    a = col(a)
    return F.when(F.abs(a) <= math.pi, a).otherwise(a - 2 * math.pi * F.floor((a + math.pi) / (2 * math.pi)))


@dataclass(frozen=True)
class Intrinsics:
    fx: float
    fy: float
    cx: float
    cy: float
    width: int
    height: int
    distortion: tuple[float, float, float, float, float] = (0.0,) * 5

    def __post_init__(self):
        if self.fx <= 0 or self.fy <= 0 or self.width <= 0 or self.height <= 0:
            raise ValueError("focal lengths and sizes have to be positive")
        if len(self.distortion) != 5:
            raise ValueError("distortion is k1, k2, p1, p2, k3")

    @staticmethod
    def from_matrix(k, width: int, height: int, distortion: tuple[float, ...] = (0.0,) * 5) -> Intrinsics:
        """From a 3x3 camera matrix without skew."""
        if len(k) != 3 or any(len(row) != 3 for row in k):
            raise ValueError("a camera matrix is 3x3")
        return Intrinsics(float(k[0][0]), float(k[1][1]), float(k[0][2]), float(k[1][2]), width, height, tuple(map(float, distortion)))

    @staticmethod
    def from_fov(width: int, height: int, degrees: float) -> Intrinsics:
        f = width / 2 / math.tan(math.radians(degrees) / 2)
        return Intrinsics(f, f, width / 2, height / 2, width, height)


def distort(x: Column, y: Column, k: tuple[float, ...]) -> tuple[Column, Column]:
    """Radial (k1, k2, k3) and tangential (p1, p2) distortion of normalised coordinates."""
    k1, k2, p1, p2, k3 = k
    r2 = x * x + y * y
    radial = 1 + r2 * (k1 + r2 * (k2 + r2 * k3))
    return x * radial + 2 * p1 * x * y + p2 * (r2 + 2 * x * x), y * radial + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y


def project(x, y, z, camera: Intrinsics) -> tuple[Column, Column, Column]:
    """(u, v, valid): null behind the camera; out of the image u and v stay and valid is false."""
    x, y, z = cols(x, y, z)
    front = z > 1e-3
    a, b = x / z, y / z
    if any(camera.distortion):
        a, b = distort(a, b, camera.distortion)
    u = F.when(front, camera.fx * a + camera.cx)
    v = F.when(front, camera.fy * b + camera.cy)
    return u, v, F.coalesce(front & (u >= 0) & (u < camera.width) & (v >= 0) & (v < camera.height), F.lit(False))


def in_depth_band(x, y, z, camera: Intrinsics, near: float = 0.3, far: float = 60.0) -> tuple[Column, Column, Column]:
    """(u, v, valid) like ``project``; valid are points strictly between ``near`` and ``far`` that fall into the image."""
    u, v, valid = project(x, y, z, camera)
    return u, v, valid & (col(z) > near) & (col(z) < far)


def centre_band(width: int, fraction: float) -> tuple[int, int]:
    """First and end column of the middle ``fraction`` (from 0.05 to 1) of an image."""
    band = round(width * min(1.0, max(0.05, fraction)))
    first = (width - band) // 2
    return first, first + band


def back_project(u, v, depth, camera: Intrinsics) -> Vector:
    u, v, d = cols(u, v, depth)
    return (u - camera.cx) * d / camera.fx, (v - camera.cy) * d / camera.fy, d


def jet(t) -> Vector:
    """Red, green and blue of a ramp from 0 to 1."""
    return tuple(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.5 - 4 * F.abs(col(t) - c))) for c in (0.75, 0.5, 0.25))


def intensity_colour(i) -> Vector:
    r = col(i) / 255
    return r, 1 - r, F.lit(0.8)
