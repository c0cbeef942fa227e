"""From scans to a map: registration of many pairs at once, chains of poses, loop closures and corrections.

Registration runs as rounds of Spark jobs over all pairs together: closest points by grid cells, sums of the 6x6 normal
equations for each pair, and a solver that gets one row of sums for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.geometry import Intrinsics, Matrix, Pose, back_project, matmul, rotate, rotation_from_quaternion, skew, transpose
from pointloom.operators import align, cloud as clouds, folds, vision
from pointloom.operators.durable import discard, materialise

ROTATION = folds.ROTATION
TRANSLATION = ("tx", "ty", "tz")
POSE = (*ROTATION, *TRANSLATION)
POSE_KIND = "struct<" + ",".join(f"{c}:double" for c in POSE) + ">"


def identity() -> Column:
    return Pose.identity().struct()


def _symmetric_inverse(m: Matrix) -> Matrix:
    """Inverse of a symmetric 3x3 matrix by cofactors."""
    a, b, c, _, e, f, _, _, i = m
    xx, xy, xz, yy, yz, zz = e * i - f * f, c * f - b * i, b * f - c * e, a * i - c * c, b * c - a * f, a * e - b * b
    det = a * xx + b * xy + c * xz
    return tuple(v / det for v in (xx, xy, xz, xy, yy, yz, xz, yz, zz))


def _shape(n: tuple[Column, ...], thin: float = 1e-3) -> Matrix:
    """The spread of a small plane with this normal: 1 along it and ``thin`` across."""
    return tuple((F.lit(1.0) if i == j else F.lit(0.0)) - (1 - thin) * n[i] * n[j] for i in range(3) for j in range(3))


def solve_step(rows: pd.DataFrame, damping: float = 1e-6) -> pd.DataFrame:
    """The transform of each row's damped normal equations (h00 .. h55 upper triangle, g0 .. g5), as r00 .. tz."""
    n = len(rows)
    h, g = np.zeros((n, 6, 6)), rows[[f"g{i}" for i in range(6)]].to_numpy()
    for i in range(6):
        for j in range(i, 6):
            h[:, i, j] = h[:, j, i] = rows[f"h{i}{j}"]
    weak = damping * (np.trace(h, axis1=1, axis2=2) / 6 + 1e-9)
    x = np.linalg.solve(h + weak[:, None, None] * np.eye(6), -g[:, :, None])[:, :, 0] if n else np.zeros((0, 6))
    r = folds.rotations(x[:, :3])
    return pd.DataFrame(np.concatenate((r.reshape(-1, 9), x[:, 3:]), axis=1), columns=list(POSE))


def register_pairs(sources: DataFrame, targets: DataFrame, by: str = "pair_id", start: DataFrame | None = None, voxel: float = 0.2, reach: float | None = None, most: int = 30, generalised: bool = False, tolerance: float = 1e-6) -> DataFrame:
    """Rows (by, pose, fitness, rmse, converged), one for each group of ``sources`` (by, x, y, z): its alignment to the same group of ``targets``.

    ``start`` (by, pose) gives first guesses, else they are the identity. Both clouds are thinned to voxels. Errors are taken
    along the target's normals, or with ``generalised`` weighed by the shapes of both surfaces. Pairs stop when fitness and rmse
    settle. A pair of fewer than 3 points on a side or within ``reach`` keeps its guess with fitness 0 and does not converge.
    """
    reach = reach or 3 * voxel
    thin = lambda df: materialise(clouds.voxel_downsample(df, voxel, by=(by,)).withColumn("point_id", F.monotonically_increasing_id()).select(by, "point_id", "x", "y", "z"), "registration-points")
    names = sources.select(by).distinct()
    source, target = thin(sources), thin(targets)
    with_normals = lambda df: df.join(clouds.estimate_normals(df, 3 * voxel, 30, by=(by,)), [by, "point_id"])
    shaped = materialise(with_normals(target).select(by, F.col("point_id").alias("other"), *(F.col(c).alias(f"t{c}") for c in "xyz"), *(F.col(f"n{c}").alias(f"t_n{c}") for c in "xyz")), "registration-targets")
    if generalised:
        source = materialise(with_normals(source), "registration-sources")
    counts = source.groupBy(by).agg(F.count("*").alias("points"))
    guesses = names.join(start.select(by, "pose"), by, "left") if start is not None else names.withColumn("pose", F.lit(None).cast(POSE_KIND))
    state = guesses.join(counts, by, "left").select(by, F.coalesce("pose", identity()).alias("pose"), F.coalesce("points", F.lit(0)).alias("points"), F.lit(0.0).alias("fitness"), F.lit(float("inf")).alias("rmse"), F.lit(False).alias("done"))
    state = materialise(state, "registration-state")
    for _ in range(most):
        open_ = state.where("not done and points >= 3").select(by, "pose")
        if open_.isEmpty():
            break
        pose = Pose.from_struct("pose")
        moved = source.join(open_, by).withColumns(dict(zip(("x", "y", "z"), pose.apply("x", "y", "z"))))
        near = clouds.nearest_within(moved, shaped.select(by, "other", "tx", "ty", "tz"), reach, by=(by,))
        met = moved.join(near, [by, "point_id"]).join(shaped, [by, "other"])
        p, e = tuple(F.col(c) for c in "xyz"), tuple(F.col(c) - F.col(f"t{c}") for c in "xyz")
        # a target without a normal is a point of round shape
        normal = tuple(F.col(f"t_n{c}") for c in "xyz")
        if generalised:
            round_ = tuple(F.lit(1.0) if i % 4 == 0 else F.lit(0.0) for i in range(9))
            own = rotate(pose.r, tuple(F.col(f"n{c}") for c in "xyz"))
            pick = lambda n, flag: tuple(F.when(F.col(flag).isNotNull(), s).otherwise(r) for s, r in zip(_shape(n), round_))
            weight = _symmetric_inverse(tuple(a + b for a, b in zip(pick(normal, "t_nx"), pick(own, "nx"))))
        else:
            weight = tuple(F.coalesce(normal[i] * normal[j], F.lit(0.0)) for i in range(3) for j in range(3))
        met = met.select(by, "distance", *(v.alias(f"p{i}") for i, v in enumerate(p)), *(v.alias(f"e{i}") for i, v in enumerate(e)), *(v.alias(f"w{i}") for i, v in enumerate(weight)))
        w = tuple(F.col(f"w{i}") for i in range(9))
        a = tuple(-v for v in skew("p0", "p1", "p2"))
        wa = matmul(w, a)
        awa = matmul(transpose(a), wa)
        we = rotate(w, tuple(F.col(f"e{i}") for i in range(3)))
        g = (*rotate(transpose(a), we), *we)
        block = lambda i, j: awa[3 * i + j] if j < 3 else wa[3 * (j - 3) + i] if i < 3 else w[3 * (i - 3) + j - 3]
        sums = met.groupBy(by).agg(F.count("*").alias("met"), F.sqrt(F.avg(F.col("distance") * F.col("distance"))).alias("now_rmse"), *(F.sum(block(i, j)).alias(f"h{i}{j}") for i in range(6) for j in range(i, 6)), *(F.sum(v).alias(f"g{i}") for i, v in enumerate(g)))

        def steps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield pd.concat([frame[[by, "met", "now_rmse"]], solve_step(frame)], axis=1)

        kind = sources.schema[by].dataType.simpleString()
        solved = sums.where("met >= 3").mapInPandas(steps, f"{by} {kind}, met long, now_rmse double, " + ", ".join(f"{c} double" for c in POSE))
        solved = solved.select(by, "met", "now_rmse", F.struct(*POSE).alias("step"))
        both = state.join(solved, by, "left")
        turned = (Pose.from_struct("step") @ pose).struct()
        fitness = F.col("met") / F.col("points")
        settled = (F.abs(fitness - F.col("fitness")) < tolerance) & (F.abs(F.col("now_rmse") - F.col("rmse")) < tolerance)
        going = F.col("step").isNotNull()
        lost = ~F.col("done") & ~going  # too few partners: fitness 0
        after = both.select(
            by,
            F.when(going, turned).otherwise(F.col("pose")).alias("pose"),
            "points",
            F.when(going, fitness).when(lost, 0.0).otherwise(F.col("fitness")).alias("fitness"),
            F.when(going, F.col("now_rmse")).when(lost, float("inf")).otherwise(F.col("rmse")).alias("rmse"),
            F.when(going, settled).otherwise(F.lit(True)).alias("done"),
        )
        old, state = state, materialise(after, "registration-state")
        discard(old)
    return state.select(by, "pose", "fitness", "rmse", (F.col("fitness") > 0).alias("converged"))


def accepted(registrations: DataFrame, fitness: float = 0.5, rmse: float = 0.5) -> DataFrame:
    """Converged registrations of at least this fitness and at most this rmse."""
    return registrations.where(F.col("converged") & (F.col("fitness") >= fitness) & (F.col("rmse") <= rmse))


def verify_loops(candidates: DataFrame, scans: DataFrame, poses: DataFrame, fitness: float = 0.5, rmse: float = 0.5, **options) -> DataFrame:
    """The candidates (query, match) whose scans register, with pose (query in the frame of match), fitness and rmse.

    ``scans`` has (idx, x, y, z), ``poses`` (idx, pose). Registration starts from inverse(T_match) T_query.
    """
    pair = F.concat_ws("/", "query", "match").alias("pair_id")
    pairs = materialise(candidates.select(pair, "query", "match").distinct(), "loop-pairs")
    cloud = lambda end: pairs.select("pair_id", F.col(end).alias("idx")).join(scans.select("idx", "x", "y", "z"), "idx").drop("idx")
    at = lambda end, name: poses.select(F.col("idx").alias(end), F.col("pose").alias(name))
    start = pairs.join(at("query", "q"), "query").join(at("match", "m"), "match")
    start = start.select("pair_id", (Pose.from_struct("m").inverse() @ Pose.from_struct("q")).struct().alias("pose"))
    found = accepted(register_pairs(cloud("query"), cloud("match"), "pair_id", start, **options), fitness, rmse)
    return pairs.join(found, "pair_id").select("query", "match", "pose", "fitness", "rmse")


def chain(steps: DataFrame, by: tuple[str, ...], order: tuple[str, ...], carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (by, carry, pose): the product of the structs ``step`` up to each row; a null step stands still."""
    flat = steps.withColumns({c: F.coalesce(F.col(f"step.{c}"), F.lit(1.0 if c in ("r00", "r11", "r22") else 0.0)) for c in POSE})
    out = folds.pose_chain(flat, by, order, carry)
    names = list(dict.fromkeys([*by, *carry]))
    return out.select(*names, F.struct(*POSE).alias("pose"))


def inertial_hints(readings: DataFrame, times: DataFrame, by: str = "session", order: str = "scan", explicit: DataFrame | None = None, least: int = 2, most: int = 5000, bucket: float | None = None, **options) -> DataFrame:
    """Rows (by, order, pose): the rotation that ``readings`` (by, t, gx, gy, gz) give from one scan of ``times`` (by, order, t) to the next.

    A reading counts for the first scan at or after it. Scans with an ``explicit`` hint (by, order) take no readings, these stay
    for the next scan. Each interval is integrated from the identity, over its newest ``most`` readings. An interval of fewer than
    ``least`` readings, or that turns nothing, gives no hint.
    """
    marks = times.select(by, order, "t")
    if explicit is not None:
        marks = marks.join(explicit.select(by, order), [by, order], "left_anti")
    met = align._neighbours(readings.select(by, "t", "gx", "gy", "gz"), marks, (by,), "t", bucket, False)
    inside = met.where("_after is not null").select(by, F.col(f"_after.{order}").alias(order), "t", "gx", "gy", "gz")
    newest = F.row_number().over(Window.partitionBy(by, order).orderBy(F.desc("t"), "gx", "gy", "gz"))
    inside = inside.withColumn("_rank", newest).where(F.col("_rank") <= most).drop("_rank")
    turned = folds.preintegrate(inside, (by, order), ("t", "gx", "gy", "gz"), carry=("t",), **options)
    last = turned.groupBy(by, order).agg(F.count("*").alias("n"), F.max_by(F.struct("qw", "qx", "qy", "qz"), "t").alias("q")).where(F.col("n") >= least)
    r = rotation_from_quaternion(tuple(F.col(f"q.q{c}") for c in "wxyz"))
    turns = [F.abs(v - (1.0 if i % 4 == 0 else 0.0)) > (1.001e-5 if i % 4 == 0 else 1e-8) for i, v in enumerate(r)]
    return last.where(F.greatest(*turns)).select(by, order, Pose(r, tuple(F.lit(0.0) for _ in "xyz")).struct().alias("pose"))


def scan_poses(scans: DataFrame, by: str = "session", order: str = "scan", voxel: float = 0.2, near: float = 0.5, far: float = 100.0, hints: DataFrame | None = None, heights: tuple[float, float] | None = None, ground: float | None = None, readings: DataFrame | None = None, times: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """Poses and the prepared points of the scans; the parameters are those of ``map_scans``."""
    kept = clouds.range_filter(scans, near, far).select(by, order, "x", "y", "z")
    kept = materialise(clouds.passthrough_filter(kept, "z", *heights) if heights else kept, "mapping-scans")
    if ground is not None:
        kept = materialise(clouds.remove_ground(kept, (by, order), ground), "mapping-above-ground")
    if readings is not None:
        turned = inertial_hints(readings, times, by, order, hints)
        hints = turned if hints is None else hints.select(by, order, "pose").unionByName(turned)
    w = Window.partitionBy(by).orderBy(order)
    pairs = scans.select(by, order).distinct().withColumn("before", F.lag(order).over(w)).withColumn("pair_id", F.concat_ws("/", by, order))
    pairs = materialise(pairs, "mapping-pairs")
    later = pairs.where("before is not null")
    source = later.select("pair_id", by, order).join(kept, [by, order]).select("pair_id", "x", "y", "z")
    target = later.select("pair_id", by, F.col("before").alias(order)).join(kept, [by, order]).select("pair_id", "x", "y", "z")
    start = later.join(hints, [by, order]).select("pair_id", "pose") if hints is not None else None
    found = register_pairs(source, target, "pair_id", start, voxel=voxel, **options)
    steps = pairs.join(found, "pair_id", "left").withColumn("converged", F.coalesce("converged", F.col("before").isNull()))
    steps = materialise(steps.select(by, order, "converged", F.when(F.col("converged"), F.col("pose")).alias("step")), "mapping-steps")
    return materialise(chain(steps, (by,), (order,), (order, "converged")), "mapping-poses"), kept


def placed(kept: DataFrame, poses: DataFrame, by: str = "session", order: str = "scan") -> DataFrame:
    """The points (by, order, x, y, z) of converged scans in the frame of their session."""
    rows = kept.join(poses.where("converged"), [by, order])
    return rows.withColumns(dict(zip(("x", "y", "z"), Pose.from_struct("pose").apply("x", "y", "z")))).select(by, order, "x", "y", "z")


def map_scans(scans: DataFrame, by: str = "session", order: str = "scan", voxel: float = 0.2, **options) -> tuple[DataFrame, DataFrame]:
    """Poses (by, order, pose, converged) and the map (by, x, y, z) of the scans (by, order, x, y, z) of each session.

    Every scan is registered to the one before it in its session, all pairs at once, from the identity or ``hints`` (by, order,
    pose); a session's first scan has the identity. With inertial ``readings`` and the scans' ``times``, scans without such a
    hint start from the rotation in between (``inertial_hints``). A scan that does not register keeps the pose before it and
    adds nothing to the map, but the next one is registered to it. Points nearer than ``near`` or beyond ``far`` are left out,
    as are those outside of ``heights`` on z and, with ``ground`` (a distance), those of the largest plane of a scan of over 100
    points. The map is thinned to voxels.
    """
    poses, kept = scan_poses(scans, by, order, voxel, **options)
    return poses, clouds.voxel_downsample(placed(kept, poses, by, order), voxel, by=(by,)).select(by, "x", "y", "z")


def visual_odometry(keypoints: DataFrame, bits: tuple[str, ...], camera: Intrinsics, by: str = "session", order: str = "frame", ratio: float = 0.75, **options) -> DataFrame:
    """Rows (by, order, pose, matches, inliers, accepted): the camera's path from keypoints (by, order, id, u, v, depth, bits) of its frames.

    Each frame is matched to the one before it; matched keypoints with a depth there are points of that frame, from which the camera's
    motion is found. A frame whose motion is not accepted stays where the one before it is. Frames are numbered by order, gaps do no harm.
    """
    w = Window.partitionBy(by).orderBy(order)
    frames = materialise(keypoints.select(by, order).distinct().withColumn("before", F.lag(order).over(w)), "odometry-frames")
    later = frames.where("before is not null")
    old = later.join(keypoints.withColumnRenamed(order, "before"), [by, "before"])
    new = later.select(by, order).join(keypoints, [by, order])
    pairs = align.descriptor_matches(old, new, bits, ratio, (by, order))
    at = old.select(by, order, F.col("id").alias("query"), *(v.alias(c) for v, c in zip(back_project("u", "v", "depth", camera), "xyz"))).where("z is not null")
    points = pairs.join(at, [by, order, "query"]).join(new.select(by, order, F.col("id").alias("train"), "u", "v"), [by, order, "train"])
    found = vision.camera_poses(points, (by, order), camera, **options)
    steps = frames.join(found, [by, order], "left").withColumn("step", F.when(F.col("accepted"), Pose.from_columns(*POSE).inverse().struct()))
    steps = materialise(steps.select(by, order, "step", F.coalesce("n", F.lit(0)).alias("matches"), F.coalesce("inliers", F.lit(0)).alias("inliers"), F.coalesce("accepted", F.lit(False)).alias("accepted")), "odometry-steps")
    return chain(steps, (by,), (order,), (order, "matches", "inliers", "accepted"))


def cap_map(points: DataFrame, most: int = 2_000_000, voxel: float = 0.2, by: str = "session") -> DataFrame:
    """The map, thinned to voxels where a session has over ``most`` points."""
    large = points.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") > most).select(by)
    thin = clouds.voxel_downsample(points.join(large, by, "left_semi"), voxel, by=(by,)).select(by, "x", "y", "z")
    return points.join(large, by, "left_anti").select(by, "x", "y", "z").unionByName(thin)


def apply_corrections(dense: DataFrame, keyframes: DataFrame, by: tuple[str, ...] = (), idx: str = "idx", bucket: float = 100_000) -> DataFrame:
    """Dense rows (by, idx, pose ..) with ``corrected``: the pose moved as the last keyframe at or before it was, T_corrected inverse(T) pose.

    ``keyframes`` has (by, idx, pose, corrected); rows before the first keyframe follow the first. Null without keyframes.
    """
    # the move is worked out once for each keyframe, and only it goes along with the rows
    move = F.when(F.col("pose").isNotNull(), (Pose.from_struct("corrected") @ Pose.from_struct("pose").inverse()).struct())
    both = align.correct_poses(dense, keyframes.select(*by, idx, move.alias("move")), idx, bucket, by)
    moved = Pose.from_struct("key_move") @ Pose.from_struct("pose")
    return both.withColumn("corrected", F.when(F.col("key_move").isNotNull(), moved.struct())).select(*dense.columns, "corrected")


def ranked_candidates(pairs: DataFrame, query: str = "query", order: tuple[Column | str, ...] = ("distance", "match"), most: int | None = None) -> DataFrame:
    """Candidates with their rank within each query, best first; only the first ``most`` if given."""
    out = pairs.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*order)))
    return out if most is None else out.where(F.col("rank") <= most)
