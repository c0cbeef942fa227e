"""Calibration files, configuration look-up and saving: small values for the driver, which become literals in expressions."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from pointloom.functions.geometry import Intrinsics, Pose

#: Camera axes (right, down, forward) from those of the laser scanner (forward, left, up): fixed values.
CAMERA_FROM_SCANNER = ((0.0, -1.0, 0.0), (0.0, 0.0, -1.0), (1.0, 0.0, 0.0))
SUFFIXES = (".toml", ".yaml", ".yml", ".json")


def _camera_on_body() -> list[list[float]]:
    out = np.eye(4)
    out[:3, :3] = np.array(CAMERA_FROM_SCANNER).T
    return out.tolist()


@dataclass
class Calibration:
    """Extrinsics on the body of the inertial sensor (4x4) and one camera; missing values are those of sensors in one place."""

    T_imu_lidar: list[list[float]] = field(default_factory=lambda: np.eye(4).tolist())
    T_imu_cam: list[list[float]] = field(default_factory=_camera_on_body)
    image_width: int = 1280
    image_height: int = 720
    K: list[list[float]] | None = None
    dist: list[float] = field(default_factory=lambda: [0.0] * 5)
    vo_center_fraction: float = 1.0

    def __post_init__(self):
        if self.K is None:
            c = Intrinsics.from_fov(self.image_width, self.image_height, 70.0)
            self.K = [[c.fx, 0.0, c.cx], [0.0, c.fy, c.cy], [0.0, 0.0, 1.0]]
        for name in ("T_imu_lidar", "T_imu_cam"):
            if np.shape(getattr(self, name)) != (4, 4):
                raise ValueError(f"{name} is a 4x4 matrix")

    def camera(self) -> Intrinsics:
        return Intrinsics.from_matrix(self.K, self.image_width, self.image_height, tuple(self.dist))

    def camera_from_body(self) -> Pose:
        return pose_of(np.linalg.inv(np.array(self.T_imu_cam, dtype=float)))

    def camera_from_scanner(self, yaw_offset: float = 0.0) -> Pose:
        """The scanner's points in the camera's frame; the scanner is first turned by ``yaw_offset`` degrees about its axis."""
        m = np.linalg.inv(np.array(self.T_imu_cam, dtype=float)) @ np.array(self.T_imu_lidar, dtype=float)
        c, s = np.cos(np.radians(yaw_offset)), np.sin(np.radians(yaw_offset))
        m[:3, :3] = m[:3, :3] @ np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]])
        return pose_of(m)


def pose_of(m) -> Pose:
    """A 4x4 matrix as literals."""
    m = np.asarray(m, dtype=float)
    return Pose(tuple(F.lit(float(v)) for v in m[:3, :3].ravel()), tuple(F.lit(float(v)) for v in m[:3, 3]))


def chain_extrinsics(links: list[tuple[str, str, np.ndarray]]) -> tuple[str, str, np.ndarray]:
    """(first source, last target, product) of transforms (source, target, 4x4) that follow one another; ValueError where an end does not meet the next."""
    if not links:
        raise ValueError("nothing to chain")
    source, at, out = links[0]
    for a, b, m in links[1:]:
        if a != at:
            raise ValueError(f"{at} does not meet {a}")
        at, out = b, m @ out
    return source, at, out


def read_mapping(path: str | Path) -> dict:
    """The mapping of a JSON, TOML or YAML file (YAML where its library is installed)."""
    file = Path(path)
    if not file.exists():
        raise FileNotFoundError(path)
    text = file.read_text()
    if file.suffix == ".json":
        data = json.loads(text)
    elif file.suffix == ".toml":
        import tomllib

        data = tomllib.loads(text)
    elif file.suffix in (".yaml", ".yml"):
        import yaml

        data = yaml.safe_load(text)
    else:
        raise ValueError(f"unknown kind of configuration: {file.suffix}")
    if not isinstance(data, dict):
        raise ValueError("a configuration is a mapping")
    return data


def load_calibration(path: str | Path) -> Calibration:
    """Keys of the file replace the defaults one by one; unknown ones are ignored."""
    data = read_mapping(path)
    return Calibration(**{f.name: data[f.name] for f in fields(Calibration) if f.name in data})


def find_config(name: str = "pointloom", variable: str = "POINTLOOM_CONFIG") -> Path | None:
    """The file named by the environment variable, else ``name`` with a known suffix here, else under ~/.config; None without one."""
    named = os.environ.get(variable)
    here = [Path.cwd() / f"{name}{s}" for s in SUFFIXES] + [Path.home() / ".config" / name / f"config{s}" for s in SUFFIXES]
    return next((p for p in ([Path(named)] if named else []) + here if p.is_file()), None)


def _toml(value) -> str:
    if value is None:
        return '""'
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, list | tuple):
        return "[" + ", ".join(map(_toml, value)) + "]"
    return json.dumps(value) if isinstance(value, str) else str(value)


def save_config(config, path: str | Path) -> None:
    """A dataclass (with nested ones) as JSON or TOML, by the suffix; None is an empty string in TOML."""
    file = Path(path)
    data = asdict(config) if is_dataclass(config) else dict(config)
    if file.suffix == ".json":
        text = json.dumps(data, indent=2) + "\n"
    elif file.suffix == ".toml":
        plain = [f"{k} = {_toml(v)}" for k, v in data.items() if not isinstance(v, dict)]
        tables = ["\n".join([f"\n[{k}]", *(f"{n} = {_toml(x)}" for n, x in v.items())]) for k, v in data.items() if isinstance(v, dict)]
        text = "\n".join([*plain, *tables]) + "\n"
    else:
        raise ValueError(f"unknown kind of configuration: {file.suffix}")
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(text)
