"""Point clouds: filters, voxels, neighbourhoods, planes, rasters. A cloud has a row per point with x, y and z."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.geometry import Intrinsics, jet, norm, project
from pointloom.operators import pieces
from pointloom.operators.durable import materialise


def range_filter(cloud: DataFrame, least: float = 0.5, most: float = 100.0) -> DataFrame:
    """Distance from the origin within both ends, inclusive."""
    return cloud.where(norm("x", "y", "z").between(least, most))


def intensity_filter(cloud: DataFrame, least: float = 1.0, column: str = "intensity") -> DataFrame:
    """Unchanged where the cloud has no such column."""
    return cloud.where(F.col(column) >= least) if column in cloud.columns else cloud


def passthrough_filter(cloud: DataFrame, axis: str = "z", least: float = -10.0, most: float = 10.0) -> DataFrame:
    return cloud.where(F.col(axis).between(least, most))


def crop_box(cloud: DataFrame, x: tuple[float, float], y: tuple[float, float], z: tuple[float, float]) -> DataFrame:
    return cloud.where(F.col("x").between(*x) & F.col("y").between(*y) & F.col("z").between(*z))


def sample_exactly(cloud: DataFrame, n: int, key: str = "point_id", seed: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """n points (of each group) without replacement, by a multiplicative hash of an integer key; all if there are no more.

    With groups n should be small: one task ranks up to n rows of a group from every partition.
    """
    order = F.pmod((F.col(key) + seed) * F.lit(2654435761), F.lit(4294967296))
    if not by:
        return cloud.orderBy(order, key).limit(n)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(order, key))
    return cloud.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def cell(size: float, *columns: str) -> list[Column]:
    return [F.floor(F.col(c) / size).cast("long").alias(f"cell_{c}") for c in columns]


def voxel_downsample(cloud: DataFrame, voxel: float = 0.05, by: tuple[str, ...] = ()) -> DataFrame:
    """The mean point of every occupied voxel, cells counted from the origin; other columns are dropped."""
    keys = [f"cell_{c}" for c in "xyz"]
    return cloud.select(*by, "x", "y", "z", *cell(voxel, "x", "y", "z")).groupBy(*by, *keys).agg(*(F.avg(c).alias(c) for c in "xyz"), F.count("*").alias("n"))


def _within(points: DataFrame, targets: DataFrame, radius: float, by: tuple[str, ...]) -> DataFrame:
    """Pairs at most ``radius`` apart, by an equality join on grid cells: targets (tx, ty, tz) stay in their cell, points visit 27."""
    keys = ["cell_x", "cell_y", "cell_z"]
    steps = F.array(*(F.lit(d) for d in (-1, 0, 1)))
    around = points.select("*", *(F.floor(F.col(c) / radius).cast("long").alias(f"at_{c}") for c in "xyz"))
    for c in "xyz":
        around = around.withColumn(f"step_{c}", F.explode(steps))
    around = around.select(*points.columns, *((F.col(f"at_{c}") + F.col(f"step_{c}")).alias(f"cell_{c}") for c in "xyz"))
    there = targets.select("*", *(F.floor(F.col(f"t{c}") / radius).cast("long").alias(f"cell_{c}") for c in "xyz"))
    d2 = reduce(lambda s, c: s + (F.col(c) - F.col(f"t{c}")) * (F.col(c) - F.col(f"t{c}")), "xyz", F.lit(0.0))
    return around.join(there, [*by, *keys]).withColumn("d2", d2).where(F.col("d2") <= radius * radius).drop(*keys)


def point_density(cloud: DataFrame, radius: float = 1.0, key: str = "point_id", by: tuple[str, ...] = ()) -> DataFrame:
    """Rows (by, key, density): how many other points lie within the radius. Coincident points are counted by their place's weight.

    Places are packed by cell into pieces, and a task compares two pieces at a time; pieces wholly within or beyond the radius are not compared.
    """
    at = lambda size, c: F.floor(F.col(c) / size).cast("long")
    places = cloud.groupBy(*by, "x", "y", "z").agg(F.count("*").alias("weight"))
    places = places.where(reduce(lambda s, c: s & (F.abs(c) < float("inf")), "xyz", F.lit(True)))  # others are near nothing
    places = places.withColumns({f"cell_{c}": at(radius, c) for c in "xyz"} | {f"fine_{c}": at(radius / 4, c) for c in "xyz"})
    cells = [f"cell_{c}" for c in "xyz"]
    packed = pieces.packed(places, (*by, *cells), tuple(f"fine_{c}" for c in "xyz"), ("x", "y", "z", "weight"), 1024, "place-pieces", ("x", "y", "z"))
    bounds = [f"{e}_{c}" for c in "xyz" for e in ("lo", "hi")]
    here = packed.select(*by, F.col("piece").alias("a"), *cells, *(F.col(c).alias(f"a_{c}") for c in bounds))
    for c in cells:
        here = here.withColumn(c, F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)))
    there = packed.select(*by, F.col("piece").alias("b"), *cells, *(F.col(c).alias(f"b_{c}") for c in bounds))
    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"a_lo_{c}") - F.col(f"b_hi_{c}"), F.col(f"b_lo_{c}") - F.col(f"a_hi_{c}"))
    apart = sum((gap(c) * gap(c) for c in "xyz"), F.lit(0.0))
    links = here.hint("merge").join(there, [*by, *cells]).where(apart <= radius * radius * (1 + 1e-9)).select(*by, "a", "b")
    side = lambda end: packed.select(F.col("piece").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in ("x", "y", "z", "weight")))
    near = pieces.weights_within(pieces.dealt(links, side("a"), side("b"), ("a", "b")), radius, by)
    near = near.groupBy(*by, "x", "y", "z").agg((F.sum("near") - 1).alias("density"))
    return cloud.select(*by, key, "x", "y", "z").join(near, [*by, "x", "y", "z"]).select(*by, key, "density")


def remove_radius_outliers(cloud: DataFrame, least: int = 16, radius: float = 0.5, key: str = "point_id", by: tuple[str, ...] = ()) -> DataFrame:
    keep = point_density(cloud, radius, key, by).where(F.col("density") >= least).select(*by, key)
    return cloud.join(keep, [*by, key], "left_semi")


def nearest_neighbours(cloud: DataFrame, k: int, start: float, key: str = "point_id", by: tuple[str, ...] = (), most_rounds: int = 40) -> DataFrame:
    """Rows (by, key, rank, other, distance): each point's k nearest others, ties to the smaller key.

    Points are asked within a radius of their own, ``start`` or less where the points around are dense; those with k neighbours inside it are
    done, the others ask again within twice the radius. Points with fewer than k others in their group end with all of them.
    """
    targets = _first_of_places(cloud, k + 1, key, by)
    spans = cloud.groupBy(*by).agg(*((F.max(c) - F.min(c)).alias(f"_{c}") for c in "xyz"))
    across = spans.agg(F.max(norm("_x", "_y", "_z"))).first()[0] or 0.0  # of the widest group
    left = materialise(_with_level(cloud.select(*by, key, "x", "y", "z"), k, start, by), "points-by-level")
    done = None
    order = Window.partitionBy(*by, key).orderBy("d2", "other")
    for _ in range(most_rounds + LEVELS // 2):
        pairs = _within_own(left, targets, start, by).where(F.col(key) != F.col("other"))
        ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        ranked = materialise(ranked.select(*by, key, "rank", "other", F.sqrt("d2").alias("distance")), "neighbours")
        final = F.lit(start) * F.pow(F.lit(2.0), -F.col("level") / 2) > across
        found = ranked.groupBy(*by, key).agg(F.count("*").alias("found"))
        full = left.join(found, [*by, key], "left").where(final | (F.col("found") == k)).select(*by, key)
        part = ranked.join(full, [*by, key], "left_semi")
        done = part if done is None else done.union(part)
        left = materialise(left.join(full, [*by, key], "left_anti").withColumn("level", F.col("level") - 2), "lonely-points")
        if left.isEmpty():
            return done
    raise ValueError("the first radius is too small for this cloud")


def _first_of_places(cloud: DataFrame, most: int, key: str, by: tuple[str, ...]) -> DataFrame:
    """Targets (by, tx, ty, tz, other): of points at one place the ``most`` of smallest key; the others are no one's nearest."""
    rank = F.row_number().over(Window.partitionBy(*by, "x", "y", "z").orderBy(key))
    rows = cloud.select(*by, "x", "y", "z", key).withColumn("_rank", rank).where(F.col("_rank") <= most)
    return rows.select(*by, *(F.col(c).alias(f"t{c}") for c in "xyz"), F.col(key).alias("other"))


#: Radii are divided by the root of 2 so many times at most.
LEVELS = 24


def _with_level(points: DataFrame, k: int, start: float, by: tuple[str, ...]) -> DataFrame:
    """Points with level: by how many roots of 2 ``start`` is divided, so that a cell of that size around the point still has k / 2 points."""
    at = lambda size: [F.floor(F.col(c) / size).cast("long").alias(f"c{c}") for c in "xyz"]
    levels = F.explode(F.array(*(F.struct(F.lit(n).alias("level"), *at(start * 2 ** (-n / 2))) for n in range(1, LEVELS + 1))))
    cells = points.select(*by, levels.alias("m")).groupBy(*by, "m").agg(F.count("*").alias("n")).where(F.col("n") >= max(2.0, k / 2))
    dense = cells.select(*by, "m.*")
    out = points.withColumn("level", F.lit(0))
    top = dense.agg(F.max("level")).first()[0] or 0
    for n in range(1, top + 1):
        here = dense.where(F.col("level") == n).select(*by, "cx", "cy", "cz", F.lit(n).alias("_found"))
        out = out.select("*", *at(start * 2 ** (-n / 2))).join(here, [*by, "cx", "cy", "cz"], "left")
        out = out.withColumn("level", F.coalesce("_found", "level")).drop("_found", "cx", "cy", "cz")
    return out


def _within_own(points: DataFrame, targets: DataFrame, start: float, by: tuple[str, ...]) -> DataFrame:
    """``_within`` for points that have radii of their own, by ``level``."""
    radius = F.lit(start) * F.pow(F.lit(2.0), -F.col("level") / 2)
    used = points.select("level").distinct().select(F.col("level").alias("_level"))  # a few
    there = targets.crossJoin(F.broadcast(used)).withColumn("_radius", F.lit(start) * F.pow(F.lit(2.0), -F.col("_level") / 2))
    there = there.select("*", *(F.floor(F.col(f"t{c}") / F.col("_radius")).cast("long").alias(f"cell_{c}") for c in "xyz")).drop("_radius")
    around = points.withColumn("_radius", radius).withColumn("_level", F.col("level"))
    around = around.select("*", *(F.floor(F.col(c) / F.col("_radius")).cast("long").alias(f"cell_{c}") for c in "xyz"))
    for c in "xyz":
        around = around.withColumn(f"cell_{c}", F.explode(F.array(F.col(f"cell_{c}") - 1, F.col(f"cell_{c}"), F.col(f"cell_{c}") + 1)))
    d2 = reduce(lambda s, c: s + (F.col(c) - F.col(f"t{c}")) * (F.col(c) - F.col(f"t{c}")), "xyz", F.lit(0.0))
    near = around.hint("merge").join(there, [*by, "_level", "cell_x", "cell_y", "cell_z"]).withColumn("d2", d2)
    return near.where(F.col("d2") <= F.col("_radius") * F.col("_radius")).drop("_level", "_radius", "cell_x", "cell_y", "cell_z")


def remove_statistical_outliers(cloud: DataFrame, k: int = 20, ratio: float = 2.0, start: float = 0.1, key: str = "point_id") -> DataFrame:
    """Points whose mean distance to k neighbours is at most the cloud's mean of that plus ``ratio`` deviations."""
    mean = nearest_neighbours(cloud, k, start, key).groupBy(key).agg(F.avg("distance").alias("mean_distance"))
    mean = materialise(mean, "mean-distances")
    limit = mean.agg((F.avg("mean_distance") + ratio * F.stddev_samp("mean_distance")).alias("limit"))
    keep = mean.join(limit, F.col("mean_distance") <= F.col("limit")).select(key)
    return cloud.join(keep, key, "left_semi")


def _normals(moments: pd.DataFrame) -> pd.DataFrame:
    m = moments[["xx", "xy", "xz", "xy", "yy", "yz", "xz", "yz", "zz"]].to_numpy().reshape(-1, 3, 3)
    _, vectors = np.linalg.eigh(m)
    n = vectors[:, :, 0]
    away = (n * moments[["x", "y", "z"]].to_numpy()).sum(axis=1) > 0
    n[away] *= -1
    return pd.DataFrame({"nx": n[:, 0], "ny": n[:, 1], "nz": n[:, 2]})


def estimate_normals(cloud: DataFrame, radius: float = 0.1, most: int = 30, key: str = "point_id", by: tuple[str, ...] = ()) -> DataFrame:
    """Rows (by, key, nx, ny, nz): the direction of least spread among the nearest points within the radius, towards the origin; null with fewer than 3."""
    targets = _first_of_places(cloud, most, key, by)
    left = materialise(_with_level(cloud.select(*by, key, "x", "y", "z"), most, radius, by), "points-by-level")
    rank = F.row_number().over(Window.partitionBy(*by, key).orderBy("d2", "other"))
    parts = []
    while True:  # from a small radius where points are dense to ``radius`` for those that have too few in it
        pairs = _within_own(left, targets, radius, by)
        ranked = materialise(pairs.withColumn("rank", rank).where(F.col("rank") <= most), "normal-neighbours")
        found = ranked.groupBy(*by, key).agg(F.count("*").alias("found")).where(F.col("found") == most).select(*by, key)
        full = left.where("level = 0").select(*by, key).unionByName(found).distinct()
        parts.append(ranked.join(full, [*by, key], "left_semi").drop("level"))
        left = materialise(left.join(full, [*by, key], "left_anti").withColumn("level", F.greatest(F.lit(0), F.col("level") - 2)), "lonely-points")
        if left.isEmpty():
            break
    near = reduce(DataFrame.unionByName, parts)
    spread = [F.covar_pop(f"t{a}", f"t{b}").alias(a + b) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]
    moments = near.groupBy(*by, key).agg(*spread, *(F.first(c).alias(c) for c in "xyz"), F.count("*").alias("n"))

    @F.pandas_udf("nx double, ny double, nz double")
    def normal(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series, x: pd.Series, y: pd.Series, z: pd.Series) -> pd.DataFrame:
        return _normals(pd.DataFrame({"xx": xx, "xy": xy, "xz": xz, "yy": yy, "yz": yz, "zz": zz, "x": x, "y": y, "z": z}))

    got = moments.withColumn("v", F.when(F.col("n") >= 3, normal("xx", "xy", "xz", "yy", "yz", "zz", "x", "y", "z")))
    return got.select(*by, key, "v.nx", "v.ny", "v.nz")


def ground_plane(cloud: DataFrame, distance: float = 0.15, tries: int = 200, key: str = "point_id", seed: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """A row (by, a, b, c, d, inliers) for each group: of ``tries`` planes through three sampled points each, that with most points within ``distance``.

    The sample of 3 * tries points is bounded; without groups it is joined to the cloud by broadcast. Ties go to the earlier
    plane. A group of fewer than 3 points, or of points on one line, has no row.
    """
    order = F.pmod((F.col(key) + seed) * F.lit(2654435761), F.lit(4294967296))
    some = cloud.select(*by, "x", "y", "z", order.alias("h"), F.col(key).alias("k"))
    some = some if by else some.orderBy("h", "k").limit(3 * tries)
    i = F.row_number().over(Window.partitionBy(*by).orderBy("h", "k")) - 1
    some = some.withColumn("i", i).where(F.col("i") < 3 * tries).select(*by, F.floor(F.col("i") / 3).alias("plane"), (F.col("i") % 3).alias("corner"), "x", "y", "z")
    at = lambda c, n: F.max(F.when(F.col("corner") == n, F.col(c)))
    p = some.groupBy(*by, "plane").agg(*(at(c, n).alias(f"{c}{n}") for c in "xyz" for n in range(3)))
    u, v = ([F.col(f"{c}{n}") - F.col(f"{c}0") for c in "xyz"] for n in (1, 2))
    n = (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
    p = p.select(*by, "plane", "x0", "y0", "z0", *(c.alias(f"n{i}") for i, c in enumerate(n))).withColumn("len", norm("n0", "n1", "n2")).where("len > 1e-12")
    p = p.select(*by, "plane", *((F.col(f"n{i}") / F.col("len")).alias(c) for i, c in enumerate("abc")), "x0", "y0", "z0")
    p = p.withColumn("d", -(F.col("a") * F.col("x0") + F.col("b") * F.col("y0") + F.col("c") * F.col("z0"))).select(*by, "plane", "a", "b", "c", "d")
    off = F.abs(F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("c") * F.col("z") + F.col("d"))
    points = cloud.select(*by, "x", "y", "z")
    met = points.join(p, list(by)).where(off <= distance) if by else points.join(F.broadcast(p), off <= distance)
    votes = met.groupBy(*by, "plane", "a", "b", "c", "d").agg(F.count("*").alias("inliers"))
    best = votes.groupBy(*by).agg(F.max_by(F.struct("a", "b", "c", "d", "inliers"), F.struct("inliers", -F.col("plane"))).alias("best"))
    return best.where("best is not null").select(*by, "best.*")


def split_ground(cloud: DataFrame, plane: DataFrame, distance: float = 0.15, by: tuple[str, ...] = ()) -> DataFrame:
    """The cloud with a column ground (within ``distance`` of the plane of its group, or of the one-row plane); false in groups without a plane."""
    off = F.abs(F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("c") * F.col("z") + F.col("d"))
    planes = plane.select(*by, "a", "b", "c", "d")
    both = cloud.join(planes, list(by), "left") if by else cloud.join(F.broadcast(planes), how="cross")
    return both.withColumn("ground", F.coalesce(off <= distance, F.lit(False))).drop("a", "b", "c", "d")


def remove_ground(cloud: DataFrame, by: tuple[str, ...], distance: float = 0.15, tries: int = 200, over: int = 100) -> DataFrame:
    """The cloud (by, x, y, z) without the points of the largest plane of each group; groups of at most ``over`` points stay whole."""
    rows = cloud.withColumn("_key", F.pmod(F.xxhash64("x", "y", "z"), F.lit(2**31)))
    large = cloud.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > over).drop("_n")
    planes = ground_plane(rows.join(large, list(by), "left_semi"), distance, tries, "_key", by=by)
    return split_ground(cloud, planes, distance, by).where(~F.col("ground")).drop("ground")


def depth_image(cloud: DataFrame, camera: Intrinsics) -> DataFrame:
    """Rows (row, col, depth): the least z of the points of each pixel; pixels without points have no row."""
    u, v, valid = project("x", "y", "z", camera)
    clip = lambda c, most: F.least(F.greatest(F.rint(c), F.lit(0.0)), F.lit(float(most))).cast("int")
    hit = cloud.select("z", u.alias("u"), v.alias("v"), valid.alias("valid")).where("valid")
    return hit.groupBy(clip(F.col("v"), camera.height - 1).alias("row"), clip(F.col("u"), camera.width - 1).alias("col")).agg(F.min("z").alias("depth"))


def top_down_raster(cloud: DataFrame, centre: tuple[float, float], reach: float, size: int, key: str = "point_id") -> DataFrame:
    """Rows (px, py, intensity): points within ``reach`` of the centre on both axes; the point of the largest key wins its pixel."""
    scale = size / 2 / reach
    rx, ry = F.col("x") - centre[0], F.col("y") - centre[1]
    pixel = lambda c: (F.lit(size / 2) + c).cast("int")  # towards zero
    inside = cloud.where((F.abs(rx) < reach) & (F.abs(ry) < reach)).select(pixel(rx * scale).alias("px"), pixel(-ry * scale).alias("py"), key, "intensity")
    inside = inside.where(F.col("px").between(0, size - 1) & F.col("py").between(0, size - 1))
    return inside.groupBy("px", "py").agg(F.max_by("intensity", key).alias("intensity"))


def colour_by(cloud: DataFrame, column: str, by: str = "scan_id") -> DataFrame:
    """The cloud with r, g, b of a ramp over the column's range in its group; a flat group gets the middle."""
    if column not in ("z", "intensity"):
        raise ValueError("clouds are coloured by z or intensity")
    span = cloud.groupBy(by).agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    t = F.when(F.col("hi") > F.col("lo"), (F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.5)
    r, g, b = jet(F.col("t"))
    return cloud.join(span, by).withColumn("t", t).withColumns({"r": r, "g": g, "b": b}).drop("lo", "hi", "t")


def nearest_within(points: DataFrame, targets: DataFrame, radius: float, key: str = "point_id", by: tuple[str, ...] = ()) -> DataFrame:
    """Rows (by, key, other, distance): each point's nearest target (other, tx, ty, tz) within the radius, ties to the smaller other; none without one."""
    near = _within(points.select(*by, key, "x", "y", "z"), targets, radius, by)
    best = near.groupBy(*by, key).agg(F.min(F.struct("d2", "other")).alias("m"))
    return best.select(*by, key, "m.other", F.sqrt("m.d2").alias("distance"))
