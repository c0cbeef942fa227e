"""Joins in time and space: as-of, bracket, interval, depth and pixel lookups, loop candidates, descriptor matches.

Time joins take one or more grouping columns. With ``bucket`` (seconds) a group is also divided in time: windows then run
within a bucket, and only the first and last row of each bucket are carried across, so that no task needs a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.operators import pieces

#: Descriptors that meet as many others at a time in a task.
PIECE = 2048


def _neighbours(left: DataFrame, right: DataFrame, by: tuple[str, ...], t: str, bucket: float | None, closed_before: bool) -> DataFrame:
    """``left`` with _before and _after: structs of the right rows last before and first after t. An equal time counts as
    before if ``closed_before`` and else as after."""
    names = [c for c in right.columns if c not in by]
    value = F.struct(*(F.col(c) for c in names))
    part = F.floor(F.col(t) / bucket).cast("long") if bucket else F.lit(0).cast("long")
    a = left.select(*by, F.col(t).alias("_t"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("_right"), F.lit(1).alias("_side"), part.alias("_part"))
    b = right.select(*by, F.col(t).alias("_t"), F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), value.alias("_right"), F.lit(0).alias("_side"), part.alias("_part"))
    both = a.unionByName(b)
    side = F.col("_side") if closed_before else -F.col("_side")
    # what comes after is the last row in the order turned round: a frame up to the end of its group would be summed anew for each row
    order, turned = (Window.partitionBy(*by, "_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0) for keys in (("_t", side), (F.desc("_t"), side.desc())))
    found = both.select(*by, "_part", "_left", F.last("_right", True).over(order).alias("_before"), F.last("_right", True).over(turned).alias("_after")).where("_left is not null")
    if bucket:
        ends = b.groupBy(*by, "_part").agg(F.min_by("_right", "_t").alias("_first"), F.max_by("_right", "_t").alias("_last"))
        parts = found.select(*by, "_part").distinct().join(ends, [*by, "_part"], "full")
        order, turned = (Window.partitionBy(*by).orderBy(key).rowsBetween(Window.unboundedPreceding, -1) for key in (F.asc("_part"), F.desc("_part")))
        parts = parts.select(*by, "_part", F.last("_last", True).over(order).alias("_prior"), F.last("_first", True).over(turned).alias("_next"))
        found = found.join(parts, [*by, "_part"], "left").withColumns({"_before": F.coalesce("_before", "_prior"), "_after": F.coalesce("_after", "_next")})
    return found.select("_left.*", "_before", "_after")


def asof_nearest(left: DataFrame, right: DataFrame, by: tuple[str, ...] = (), t: str = "t", prefix: str = "near_", bucket: float | None = None) -> DataFrame:
    """``left`` with the columns of the right row nearest in time (any distance, ties to the earlier); null where the right side has none."""
    both = _neighbours(left, right, by, t, bucket, True)
    before = F.col("_after").isNull() | (F.col(t) - F.col(f"_before.{t}") <= F.col(f"_after.{t}") - F.col(t))
    near = F.when(F.col("_before").isNotNull() & before, F.col("_before")).otherwise(F.col("_after"))
    return both.withColumn("_near", near).select(*left.columns, *(F.col(f"_near.{c}").alias(f"{prefix}{c}") for c in right.columns if c not in by))


def bracket(left: DataFrame, right: DataFrame, by: tuple[str, ...] = (), t: str = "t", bucket: float | None = None) -> DataFrame:
    """``left`` with the right rows on both sides of t, as columns lo_* and hi_*; null outside of the right side's times.

    An exact hit is the upper row, save at the first row, which is the lower one with the second above it.
    """
    both = _neighbours(left, right, by, t, bucket, False)
    names = [c for c in right.columns if c not in by]
    order = Window.partitionBy(*by).orderBy(t)
    first = right.withColumn("_rank", F.row_number().over(order)).where("_rank <= 2").groupBy(*by)
    first = first.agg(F.min_by(F.struct(*names), "_rank").alias("_one"), F.max_by(F.struct(*names), "_rank").alias("_two"), F.count("*").alias("_rows"))
    both = both.join(first, list(by), "left") if by else both.crossJoin(F.broadcast(first))  # without groups a single row
    enough = F.col("_rows") >= 2
    start = F.col("_before").isNull() & (F.col(f"_after.{t}") == F.col(t))
    inside = F.col("_before").isNotNull() & F.col("_after").isNotNull()
    lo = F.when(enough & start, F.col("_one")).when(enough & inside, F.col("_before"))
    hi = F.when(enough & start, F.col("_two")).when(enough & inside, F.col("_after"))
    both = both.withColumns({"_lo": lo, "_hi": hi})
    return both.select(*left.columns, *(F.col(f"_lo.{c}").alias(f"lo_{c}") for c in names), *(F.col(f"_hi.{c}").alias(f"hi_{c}") for c in names))


def interval_join(left: DataFrame, right: DataFrame, by: tuple[str, ...] = (), start: str = "t0", end: str = "t1", t: str = "t", width: float = 1.0) -> DataFrame:
    """Right rows with t from start to end, both inclusive. Intervals visit every time cell of ``width`` that they touch, so the join is an equality join."""
    first, last = (F.floor(F.col(c) / width).cast("long") for c in (start, end))
    a = left.where(F.col(start) <= F.col(end)).withColumn("_cell", F.explode(F.sequence(first, last)))
    b = right.withColumn("_cell", F.floor(F.col(t) / width).cast("long"))
    return a.join(b, [*by, "_cell"]).where(F.col(t).between(F.col(start), F.col(end))).drop("_cell")


def synchronised(streams: list[DataFrame], by: tuple[str, ...] = (), t: str = "t", tolerance: float = 0.05, bucket: float | None = None) -> DataFrame:
    """Rows of the first stream with the nearest row of every other (t_1, t_2 ..), where all lie within ``tolerance``."""
    out = streams[0]
    times = [F.col(t)]
    for i, s in enumerate(streams[1:], 1):
        out = asof_nearest(out, s, by, t, f"s{i}_", bucket)
        times.append(F.col(f"s{i}_{t}"))
    have = [x.isNotNull() for x in times]
    ok = have[0]
    for h in have[1:]:
        ok = ok & h
    return out.where(ok & ((F.greatest(*times) - F.least(*times)) <= tolerance)) if len(times) > 1 else out


def loop_candidates(poses: DataFrame, radius: float, gap: int, by: tuple[str, ...] = (), index: str = "idx") -> DataFrame:
    """Pairs (query, match, distance) of poses within ``radius`` whose query comes at least ``gap`` later; by an equality join on grid cells.

    Cells are four radii wide, so that most queries visit one or two along an axis. Spark sizes a table before its rows are multiplied, so it is
    told to sort both sides: it would else send the visits of a small table to everyone.
    """
    size = 4 * radius
    cell = lambda v: F.floor(v / size).cast("long")
    old = poses.select(*by, F.col(index).alias("match"), *(F.col(c).alias(f"m{c}") for c in "xyz"), *(cell(F.col(c)).alias(f"c{c}") for c in "xyz"))
    new = poses.select(*by, F.col(index).alias("query"), "x", "y", "z")
    for c in "xyz":
        reach = F.lit(radius * (1 + 1e-6)) + F.abs(c) * 1e-12  # no pair is lost by rounding
        new = new.withColumn(f"c{c}", F.explode(F.sequence(cell(F.col(c) - reach), cell(F.col(c) + reach))))
    d = F.sqrt(sum(((F.col(c) - F.col(f"m{c}")) * (F.col(c) - F.col(f"m{c}")) for c in "xyz"), F.lit(0.0)))
    pairs = new.hint("merge").join(old, [*by, "cx", "cy", "cz"]).withColumn("distance", d)
    return pairs.where((F.col("distance") <= radius) & (F.col("query") - F.col("match") >= gap)).select(*by, "query", "match", "distance")


def assign_depth(keypoints: DataFrame, projected: DataFrame, radius: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Keypoints (kp, u, v) with the depth z of the nearest projected point (idx, u, v, z) strictly within ``radius``; ties to the smaller idx, null without one."""
    size = max(1, int(radius))
    key = lambda c: (F.col(c) / size).cast("long")  # towards zero
    around = keypoints
    for c, k in (("u", "_cu"), ("v", "_cv")):
        around = around.withColumn(k, F.explode(F.array(key(c) - 1, key(c), key(c) + 1)))
    there = projected.select(*by, F.col("idx"), F.col("u").alias("pu"), F.col("v").alias("pv"), F.col("z").alias("depth"), key("u").alias("_cu"), key("v").alias("_cv"))
    d2 = (F.col("u") - F.col("pu")) * (F.col("u") - F.col("pu")) + (F.col("v") - F.col("pv")) * (F.col("v") - F.col("pv"))
    near = around.join(there, [*by, "_cu", "_cv"]).withColumn("d2", d2).where(F.col("d2") < radius * radius)
    best = near.groupBy(*by, "kp").agg(F.min_by("depth", F.struct("d2", "idx")).alias("depth"))
    return keypoints.join(best, [*by, "kp"], "left")


def hamming(a: list[Column], b: list[Column]) -> Column:
    return sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b)), F.lit(0))


def descriptor_matches(queries: DataFrame, trains: DataFrame, bits: tuple[str, ...], ratio: float = 0.75, by: tuple[str, ...] = ()) -> DataFrame:
    """Ratio-tested matches (by, query, train, distance): the nearest descriptor, where it is less than ``ratio`` times as far as the second.

    Queries of a group (a frame pair, say) meet the descriptors of the same group, piece by piece, so a task's share is bounded however large a
    group is. Descriptors with nulls are left out.
    """
    one, two = _pieces(queries, bits, by, "query-descriptors"), _pieces(trains, bits, by, "train-descriptors")
    q, t = one.select(*by, F.col("piece").alias("q")), two.select(*by, F.col("piece").alias("t"))
    return _best(q.join(t, list(by)) if by else q.crossJoin(t), one, two, bits, ratio, by, queries.schema["id"].dataType, trains.schema["id"].dataType)


def _pieces(rows: DataFrame, bits: tuple[str, ...], by: tuple[str, ...], name: str) -> DataFrame:
    longs = rows.select(*by, *(F.col(c).cast("long").alias(c) for c in ("id", *bits))).dropna()
    return pieces.packed(longs, by, ("id",), ("id", *bits), PIECE, name)


def _best(links: DataFrame, queries: DataFrame, trains: DataFrame, bits: tuple[str, ...], ratio: float, by: tuple[str, ...], *kinds) -> DataFrame:
    """Ratio-tested matches of the pairs of pieces (by, q, t)."""
    side = lambda rows, end: rows.select(F.col("piece").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in ("id", *bits)))
    found = pieces.nearest_two(pieces.dealt(links, side(queries, "q"), side(trains, "t"), ("q", "t")), bits, by)
    nearest = F.sort_array(F.array_compact(F.flatten(F.collect_list(F.array("one", "two")))))  # two for each piece that the query met
    best = found.groupBy(*by, "query").agg(F.min(F.struct("one", "train")).alias("m"), F.get(nearest, F.lit(1)).alias("second"))
    best = best.where(F.col("m.one") < ratio * F.col("second"))
    return best.select(*by, F.col("query").cast(kinds[0]).alias("query"), F.col("m.train").cast(kinds[1]).alias("train"), F.col("m.one").alias("distance"))


def lookup_pixels(points: DataFrame, pixels: DataFrame, width: int, height: int, channels: tuple[str, ...] = ("b", "g", "r"), bilinear: bool = False) -> DataFrame:
    """Points (u, v) with the colour of their pixel, nearest or of the four around; only points inside the image are returned."""
    inside = points.where((F.col("u") >= 0) & (F.col("u") < width) & (F.col("v") >= 0) & (F.col("v") < height))
    if not bilinear:
        clip = lambda c, n: F.least(F.greatest(F.rint(c), F.lit(0.0)), F.lit(float(n - 1))).cast("int")
        at = inside.withColumns({"row": clip(F.col("v"), height), "col": clip(F.col("u"), width)})
        return at.join(pixels.select("row", "col", *channels), ["row", "col"], "left").drop("row", "col")
    u, v = F.least(F.col("u"), F.lit(width - 1.0001)), F.least(F.col("v"), F.lit(height - 1.0001))
    keys = inside.columns
    taps = inside.withColumns({"_u": u, "_v": v}).withColumn("_tap", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)))))
    taps = taps.withColumns({"row": (F.floor("_v") + F.col("_tap.i")).cast("int"), "col": (F.floor("_u") + F.col("_tap.j")).cast("int")})
    along = lambda c, t: F.when(F.col(t) == 1, F.col(c) - F.floor(c)).otherwise(1 - (F.col(c) - F.floor(c)))
    weight = along("_v", "_tap.i") * along("_u", "_tap.j")
    hit = taps.withColumn("_w", weight).join(pixels.select("row", "col", *channels), ["row", "col"])
    return hit.groupBy(*keys).agg(*(F.sum(F.col("_w") * F.col(c)).cast("int").alias(c) for c in channels))


def correct_poses(dense: DataFrame, keyframes: DataFrame, idx: str = "idx", bucket: float = 100_000, by: tuple[str, ...] = ()) -> DataFrame:
    """Dense rows with the last keyframe row at or before their index (columns key_*); rows before the first take the first."""
    both = _neighbours(dense, keyframes, by, idx, bucket, True)
    pick = F.coalesce("_before", "_after")
    return both.withColumn("_key", pick).select(*dense.columns, *(F.col(f"_key.{c}").alias(f"key_{c}") for c in keyframes.columns if c not in by))


def visual_candidates(descriptors: DataFrame, bits: tuple[str, ...], recent: int = 3, least: int = 20, ratio: float = 0.75) -> DataFrame:
    """Rows (query, match, n): earlier frames, not among the last ``recent``, that share ``least`` ratio-tested matches with a frame.

    ``descriptors`` has (frame, id, bits). Every frame is a query against those before it, a stated set of comparisons.
    """
    packed = _pieces(descriptors, bits, ("frame",), "frame-descriptors")
    q, t = packed.select(F.col("frame").alias("query_frame"), F.col("piece").alias("q")), packed.select(F.col("frame").alias("match_frame"), F.col("piece").alias("t"))
    kind = descriptors.schema["id"].dataType
    found = _best(q.join(t, F.col("match_frame") <= F.col("query_frame") - recent), packed, packed, bits, ratio, ("query_frame", "match_frame"), kind, kind)
    counts = found.groupBy(F.col("query_frame").alias("query"), F.col("match_frame").alias("match")).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= least)
