"""Grouped summaries: histograms, trials, captures, probes, registration scores, and rows for dashboards and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.geometry import Pose, euler_from_rotation, quaternion_from_rotation


def most_common(rows: DataFrame, by: tuple[str, ...], value: str, order: str, k: int) -> DataFrame:
    """Rows (by, value, n, rank): each group's k most frequent values, ties to the one seen first."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    w = Window.partitionBy(*by).orderBy(F.col("n").desc(), "_first")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_first")


def trial_summary(trials: DataFrame, by: tuple[str, ...], rate: str) -> DataFrame:
    """Rows (by, n, median_rate, seconds_per_unit): nulls are left out of the median; the reciprocal of none or no rate is 0."""
    out = trials.groupBy(*by).agg(F.count("*").alias("n"), F.median(rate).alias("median_rate"))
    return out.withColumn("seconds_per_unit", F.when(F.col("median_rate") > 0, 1 / F.col("median_rate")).otherwise(0.0))


def median_shift(tracks: DataFrame, by: tuple[str, ...], least: int = 8) -> DataFrame:
    """Rows (by, dx, dy, size): medians of the tracked features' shifts; null with fewer than ``least``."""
    out = tracks.groupBy(*by).agg(F.count("*").alias("_n"), F.median("dx").alias("dx"), F.median("dy").alias("dy"))
    out = out.withColumns({c: F.when(F.col("_n") >= least, F.col(c)) for c in ("dx", "dy")})
    return out.withColumn("size", F.hypot("dx", "dy")).drop("_n")


def capture_stats(captures: DataFrame, by: tuple[str, ...], data: str, t: str) -> DataFrame:
    """Rows (by, chunks, bytes, printable, bytes_per_second); ratios of empty captures and of no time are 0."""
    size = F.octet_length(data).cast("long")
    plain = F.octet_length(F.regexp_replace(F.col(data), r"[^\x20-\x7E]", "")).cast("long")
    out = captures.groupBy(*by).agg(F.count("*").alias("chunks"), F.sum(size).alias("bytes"), F.sum(plain).alias("_plain"), (F.max(t) - F.min(t)).alias("_time"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return out.withColumns({"printable": ratio("_plain", "bytes"), "bytes_per_second": ratio("bytes", "_time")}).drop("_plain", "_time")


def best_probe(probes: DataFrame, by: tuple[str, ...], responses: str, opened: str, order: str) -> DataFrame:
    """The probe of most responses among those opened with any, the first one of equals; groups without such a probe have no row."""
    good = probes.where(F.col(opened) & (F.col(responses) > 0))
    w = Window.partitionBy(*by).orderBy(F.col(responses).desc(), order)
    return good.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def registration_scores(pairs: DataFrame, by: tuple[str, ...], distance: str, reach: float) -> DataFrame:
    """Rows (by, fitness, rmse): the share of points with a partner within reach, and these pairs' root mean square distance."""
    inlier = F.coalesce(F.col(distance) <= reach, F.lit(False))
    return pairs.groupBy(*by).agg(F.avg(inlier.cast("double")).alias("fitness"), F.sqrt(F.avg(F.when(inlier, F.col(distance) * F.col(distance)))).alias("rmse"))


def pose_json(pose: Pose, digits: int = 6) -> Column:
    """Position, quaternion and Euler angles as a JSON object."""
    r = lambda v: F.round(v, digits) + F.lit(0.0)
    q = quaternion_from_rotation(pose.r)
    return F.to_json(F.struct(F.struct(*(r(v).alias(c) for v, c in zip(pose.t, "xyz"))).alias("position"), F.struct(*(r(v).alias(c) for v, c in zip(q, "wxyz"))).alias("quaternion"), F.struct(*(r(v).alias(c) for v, c in zip(euler_from_rotation(pose.r), ("roll", "pitch", "yaw")))).alias("euler_deg")))


def calibration_json(trials: DataFrame, by: tuple[str, ...], rate: str) -> DataFrame:
    """One row (report): all trials and their ``trial_summary`` as a JSON object; for the trials of one calibration, which are few."""
    rows = trials.agg(F.array_sort(F.collect_list(F.struct(*by, *(c for c in trials.columns if c not in by)))).alias("trials"))
    summary = trial_summary(trials, by, rate)
    short = summary.agg(F.array_sort(F.collect_list(F.struct(*summary.columns))).alias("summary"))
    return rows.crossJoin(F.broadcast(short)).select(F.to_json(F.struct("trials", "summary")).alias("report"))  # a row each


def fit_to_canvas(cloud: DataFrame, width: int, height: int, by: tuple[str, ...] = (), margin: int = 4) -> DataFrame:
    """Rows with px, py: x and y scaled alike to fill a canvas less its margin, y upwards; a single place goes to the corner of the margin."""
    span = cloud.groupBy(*by).agg(*(f(c).alias(f"_{n}{c}") for c in "xy" for f, n in ((F.min, "lo"), (F.max, "hi"))))
    wide = F.greatest(F.col("_hix") - F.col("_lox"), F.lit(1e-9))
    high = F.greatest(F.col("_hiy") - F.col("_loy"), F.lit(1e-9))
    scale = F.least((width - 2 * margin) / wide, (height - 2 * margin) / high)
    both = cloud.join(span, list(by)) if by else cloud.crossJoin(F.broadcast(span))  # without groups a single row
    out = both.withColumns({"px": margin + (F.col("x") - F.col("_lox")) * scale, "py": height - margin - (F.col("y") - F.col("_loy")) * scale})
    return out.drop("_lox", "_hix", "_loy", "_hiy")
