"""Relative motion and pose of cameras from matched points, frame pair by frame pair.

Spark deals the matches of a pair to a task; hypotheses from small random samples, drawn with a fixed seed, are scored all
at once, and the best one is refined over its inliers.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from pointloom.functions.geometry import Intrinsics
from pointloom.operators.fit import POSE
from pointloom.operators.folds import rotations


def _samples(n: int, size: int, tries: int, seed: int) -> np.ndarray:
    """The places of the ``size`` least of n random numbers for each try, so many tries at a time that a few million numbers are held."""
    rng = np.random.default_rng(seed)
    some = max(1, CHUNK // max(n, 1))
    return np.concatenate([np.argsort(rng.random((min(some, tries - at), n)), axis=1)[:, :size].copy() for at in range(0, tries, some)])


#: Numbers that a step over all tries and points holds at a time.
CHUNK = 1 << 21


def _best(score: Callable[[slice], np.ndarray], tries: int, n: int) -> tuple[int, np.ndarray]:
    """The first of the tries that most points agree with, and which these are; ``score`` tells it for some tries and all points."""
    best, most, inside = 0, -1, np.zeros(n, bool)
    some = max(1, CHUNK // (4 * max(n, 1)))
    for at in range(0, tries, some):
        good = score(slice(at, at + some))
        count = good.sum(axis=1)
        if count.max() > most:
            best, most = at + int(count.argmax()), count.max()
            inside = good[best - at].copy()
    return best, inside


def _essential(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Essential matrices of batches of eight or more rays (.., n, 2) with b^T E a = 0: the least singular direction, with two equal singular values and a zero."""
    x, y = np.concatenate((a, np.ones_like(a[..., :1])), axis=-1), np.concatenate((b, np.ones_like(b[..., :1])), axis=-1)
    rows = (y[..., :, None] * x[..., None, :]).reshape(*x.shape[:-1], 9)
    e = np.linalg.svd(rows.swapaxes(-1, -2) @ rows)[2][..., -1, :].reshape(*x.shape[:-2], 3, 3)
    u, _, vt = np.linalg.svd(e)
    return u @ np.diag([1.0, 1.0, 0.0]) @ vt


def _sampson(e: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared first-order distances (.., n) of all rays from matrices (.., 3, 3)."""
    x, y = np.column_stack((a, np.ones(len(a)))), np.column_stack((b, np.ones(len(b))))
    ex, ey = x @ e.swapaxes(-1, -2), y @ e
    top = (y * ex).sum(axis=-1)
    return top * top / np.maximum((ex[..., :2] ** 2).sum(axis=-1) + (ey[..., :2] ** 2).sum(axis=-1), 1e-18)


def _by_pair(rows: DataFrame, by: tuple[str, ...], inputs: tuple[str, ...], out: str, run: Callable[[np.ndarray], list]) -> DataFrame:
    names = [c.split()[0] for c in out.split(", ")]

    def one(group: pd.DataFrame) -> pd.DataFrame:
        x = group.sort_values(list(inputs))[list(inputs)].to_numpy(dtype=float)
        return pd.DataFrame([[*(group[c].iloc[0] for c in by), *run(x[np.isfinite(x).all(axis=1)])]], columns=[*by, *names])

    schema = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by), out])
    return rows.select(*by, *inputs).groupBy(*by).applyInPandas(one, schema)


def verify_matches(matches: DataFrame, by: tuple[str, ...], camera: Intrinsics, pixels: float = 1.0, least: int = 8, tries: int = 512, seed: int = 0) -> DataFrame:
    """Rows (by, n, inliers, confidence, error, accepted, e00 .. e22) of the matches (by, u1, v1, u2, v2) of each pair of frames.

    An essential matrix is sought for which most matches lie within ``pixels`` of their epipolar lines; confidence is their share,
    error the root mean square distance of these in pixels. Pairs of fewer than ``least`` matches or inliers are not accepted (no matrix
    with fewer than 8 matches); matches with nulls are left out. Coordinates are taken as free of distortion.
    """

    def run(x: np.ndarray) -> list:
        n = len(x)
        if n < 8:
            return [n, 0, 0.0, None, False, *[None] * 9]
        f = (camera.fx + camera.fy) / 2
        a, b = ((x[:, i : i + 2] - (camera.cx, camera.cy)) / (camera.fx, camera.fy) for i in (0, 2))
        limit = (pixels / f) ** 2
        at = _samples(n, 8, tries, seed)
        e = _essential(a[at], b[at])
        best, inside = _best(lambda some: _sampson(e[some], a, b) <= limit, len(e), n)
        e = e[best]
        for _ in range(5):
            if inside.sum() < 8:
                break
            again = _essential(a[inside], b[inside])
            now = _sampson(again, a, b) <= limit
            if now.sum() < inside.sum():
                break
            e, inside = again, now
        k = int(inside.sum())
        error = float(np.sqrt(_sampson(e, a, b)[inside].mean()) * f) if k else None
        return [n, k, k / n, error, n >= least and k >= least, *e.ravel().tolist()]

    out = "n long, inliers long, confidence double, error double, accepted boolean, " + ", ".join(f"e{i}{j} double" for i in range(3) for j in range(3))
    return _by_pair(matches, by, ("u1", "v1", "u2", "v2"), out, run)


def _resection(xyz: np.ndarray, rays: np.ndarray) -> np.ndarray:
    """Camera poses (.., 3, 4) from batches of six or more points (.., n, 3) and rays (.., n, 2): direct linear transform, its rotation made one."""
    p = np.concatenate((xyz, np.ones_like(xyz[..., :1])), axis=-1)
    o = np.zeros_like(p)
    u, v = rays[..., 0:1], rays[..., 1:2]
    rows = np.concatenate((np.concatenate((p, o, -u * p), axis=-1), np.concatenate((o, p, -v * p), axis=-1)), axis=-2)
    m = np.linalg.svd(rows.swapaxes(-1, -2) @ rows)[2][..., -1, :].reshape(*xyz.shape[:-2], 3, 4)
    m = m * np.where(np.linalg.det(m[..., :3]) < 0, -1.0, 1.0)[..., None, None]
    uu, s, vt = np.linalg.svd(m[..., :3])
    return np.concatenate((uu @ vt, m[..., 3:] / np.maximum(s.mean(axis=-1), 1e-12)[..., None, None]), axis=-1)


def _reproject(m: np.ndarray, xyz: np.ndarray, rays: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Differences in rays (.., n, 2) under poses (.., 3, 4), infinite behind the camera; and the points in the camera's frame."""
    c = xyz @ m[..., :3].swapaxes(-1, -2) + m[..., None, :, 3]
    front = c[..., 2:] > 1e-6
    return np.where(front, c[..., :2] / np.where(front, c[..., 2:], 1.0) - rays, np.inf), c


def camera_poses(points: DataFrame, by: tuple[str, ...], camera: Intrinsics, pixels: float = 3.0, least: int = 12, tries: int = 256, seed: int = 0) -> DataFrame:
    """Rows (by, n, inliers, error, accepted, r00 .. tz) with the transform from the points' frame to the camera's, from points (by, x, y, z, u, v).

    Poses of samples of six are scored by the points that they project to within ``pixels``, the best is refined by Gauss-Newton over
    its inliers; error is their root mean square in pixels. Groups of fewer than ``least`` points or inliers are not accepted (no pose with
    fewer than 6); points with nulls are left out. Coordinates are taken as free of distortion.
    """

    def run(x: np.ndarray) -> list:
        n = len(x)
        if n < 6:
            return [n, 0, None, False, *[None] * 12]
        f = (camera.fx + camera.fy) / 2
        xyz, rays = x[:, :3], (x[:, 3:] - (camera.cx, camera.cy)) / (camera.fx, camera.fy)
        limit = (pixels / f) ** 2
        at = _samples(n, 6, tries, seed)
        m = _resection(xyz[at], rays[at])
        best, inside = _best(lambda some: (_reproject(m[some], xyz, rays)[0] ** 2).sum(axis=-1) <= limit, len(m), n)
        m = m[best]
        for _ in range(20):
            if inside.sum() < 6:
                break
            e, c = _reproject(m, xyz[inside], rays[inside])
            z = c[:, 2]
            j = np.zeros((len(c), 2, 6))  # of a turn and a move in the camera's frame
            j[:, 0, 3], j[:, 0, 5], j[:, 1, 4], j[:, 1, 5] = 1 / z, -c[:, 0] / z**2, 1 / z, -c[:, 1] / z**2
            j[:, :, 0] = j[:, :, 5] * c[:, 1:2] - j[:, :, 4] * c[:, 2:]
            j[:, :, 1] = j[:, :, 3] * c[:, 2:] - j[:, :, 5] * c[:, :1]
            j[:, :, 2] = j[:, :, 4] * c[:, :1] - j[:, :, 3] * c[:, 1:2]
            flat = j.reshape(-1, 6)
            step = np.linalg.lstsq(flat, -e.ravel(), rcond=None)[0]
            turn = rotations(step[None, :3])[0]
            m = np.concatenate((turn @ m[:, :3], (turn @ m[:, 3] + step[3:])[:, None]), axis=1)
            inside = (_reproject(m, xyz, rays)[0] ** 2).sum(axis=-1) <= limit
            if np.abs(step).max() < 1e-10:
                break
        k = int(inside.sum())
        error = float(np.sqrt((_reproject(m, xyz[inside], rays[inside])[0] ** 2).sum(axis=-1).mean()) * f) if k else None
        return [n, k, error, n >= least and k >= least, *m[:, :3].ravel().tolist(), *m[:, 3].tolist()]

    out = "n long, inliers long, error double, accepted boolean, " + ", ".join(f"{c} double" for c in POSE)
    return _by_pair(points, by, ("x", "y", "z", "u", "v"), out, run)
