"""Named queries over the tables of a folder, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions import geometry as g
from pointloom.operators import align, cloud as clouds, fit, folds, ordered, scans
from pointloom.plans import bridge
from pointloom.plans.base import ORACLE_SQL, QUERIES, query, r6, rounded, sql_round  # noqa: F401
from pointloom.sources import packets, serial

CAMERA = g.Intrinsics(500.0, 500.0, 320.0, 240.0, 640, 480, (0.1, -0.05, 0.001, -0.002, 0.01))


XYZ = sql_round("x", "y", "z")
C, I, T, R, D = (f"WITH {x} " for x in (bridge.CLOUD, bridge.IMU, bridge.TRAJECTORY, bridge.RETURNS, bridge.DESCRIPTORS))
OUT = ("point_id", "scan_id", "intensity")

# --- filters --------------------------------------------------------------------------------------------------------


def points(df: DataFrame) -> DataFrame:
    return rounded(df.select(*OUT, "x", "y", "z"), "x", "y", "z")


POINTS = f"SELECT point_id, scan_id, intensity, {XYZ} FROM cloud WHERE "


@query("flt01_range_filter", C + POINTS + "sqrt(x*x + y*y + z*z) BETWEEN 2 AND 9")
def flt01(spark, d):
    return points(clouds.range_filter(bridge.cloud(spark, d), 2, 9))


@query("flt02_intensity_filter", C + POINTS + "intensity >= 130")
def flt02(spark, d):
    return points(clouds.intensity_filter(bridge.cloud(spark, d), 130))


@query("flt03_passthrough_filter", C + POINTS + "z BETWEEN -1 AND 1.5")
def flt03(spark, d):
    return points(clouds.passthrough_filter(bridge.cloud(spark, d), "z", -1, 1.5))


@query("flt04_crop_box", C + POINTS + "x BETWEEN -5 AND 5 AND y BETWEEN -4 AND 6 AND z BETWEEN -2 AND 2")
def flt04(spark, d):
    return points(clouds.crop_box(bridge.cloud(spark, d), (-5, 5), (-4, 6), (-2, 2)))


@query("flt05_sample_exactly", C + f"SELECT point_id, {XYZ} FROM cloud ORDER BY ((point_id + 3) * 2654435761) % 4294967296, point_id LIMIT 100")
def flt05(spark, d):
    return rounded(clouds.sample_exactly(bridge.cloud(spark, d), 100, seed=3).select("point_id", "x", "y", "z"), "x", "y", "z")


def farthest_sql(n: int) -> str:
    """One table for each point that is chosen: every point's distance to all chosen so far."""
    steps = ["g1 AS (SELECT scan_id, point_id, x, y, z, 'inf'::DOUBLE AS d FROM cloud)", "c1 AS (SELECT scan_id, min(point_id) AS point_id, arg_min(x, point_id) AS x, arg_min(y, point_id) AS y, arg_min(z, point_id) AS z FROM g1 GROUP BY scan_id)"]
    for k in range(2, n + 1):
        steps.append(f"g{k} AS (SELECT g.scan_id, g.point_id, g.x, g.y, g.z, least(g.d, (g.x-c.x)*(g.x-c.x) + (g.y-c.y)*(g.y-c.y) + (g.z-c.z)*(g.z-c.z)) AS d FROM g{k - 1} g JOIN c{k - 1} c USING (scan_id))")
        steps.append(f"c{k} AS (SELECT scan_id, point_id, x, y, z FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY d DESC, point_id) AS r FROM g{k}) WHERE r = 1)")
    return C + ", " + ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT scan_id, point_id, {k}::BIGINT AS rank FROM c{k}" for k in range(1, n + 1))


@query("flt06_farthest_points", farthest_sql(8))
def flt06(spark, d):
    return folds.farthest_points(bridge.cloud(spark, d), ("scan_id",), 8)


@query("flt07_preprocess", C + """SELECT cell_x, cell_y, cell_z, count(*) AS n FROM (SELECT floor(x / 2)::BIGINT AS cell_x, floor(y / 2)::BIGINT AS cell_y, floor(z / 2)::BIGINT AS cell_z FROM cloud
  WHERE sqrt(x*x + y*y + z*z) BETWEEN 0.5 AND 100 AND z BETWEEN -10 AND 10) GROUP BY ALL""")
def flt07(spark, d):
    kept = clouds.passthrough_filter(clouds.range_filter(bridge.cloud(spark, d)))
    return clouds.voxel_downsample(kept, 2.0).select("cell_x", "cell_y", "cell_z", "n")


@query("flt12_decimate", T + """, n AS (SELECT sensor_id, seq, count(*) OVER (PARTITION BY sensor_id) AS c, row_number() OVER (PARTITION BY sensor_id ORDER BY t, seq) - 1 AS k FROM trajectory)
  SELECT sensor_id, seq FROM n WHERE k % (CASE WHEN c <= 20 THEN 1 ELSE greatest(1, c // 20) END) = 0""")
def flt12(spark, d):
    return ordered.decimate(bridge.trajectory(spark, d), ("sensor_id",), ("t", "seq"), 20).select("sensor_id", "seq")


# --- aggregations ---------------------------------------------------------------------------------------------------


@query("agg01_voxel_downsample", C + f"""SELECT {XYZ}, n, cell_x, cell_y, cell_z FROM (SELECT avg(x) AS x, avg(y) AS y, avg(z) AS z, count(*) AS n,
  floor(x / 3)::BIGINT AS cell_x, floor(y / 3)::BIGINT AS cell_y, floor(z / 3)::BIGINT AS cell_z FROM cloud GROUP BY cell_x, cell_y, cell_z)""")
def agg01(spark, d):
    return rounded(clouds.voxel_downsample(bridge.cloud(spark, d), 3.0), "x", "y", "z")


@query("agg02_statistical_outliers", C + """, p AS (SELECT a.point_id, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS d, b.point_id AS other FROM cloud a JOIN cloud b ON a.point_id <> b.point_id),
  k AS (SELECT point_id, avg(d) AS m FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d, other) AS r FROM p) WHERE r <= 8 GROUP BY point_id)
  SELECT point_id FROM k WHERE m <= (SELECT avg(m) + 1.5 * stddev_samp(m) FROM k)""")
def agg02(spark, d):
    return clouds.remove_statistical_outliers(bridge.cloud(spark, d), 8, 1.5, start=2.0).select("point_id")


DENSITY = """, n AS (SELECT a.point_id, count(*) - 1 AS density FROM cloud a JOIN cloud b ON (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= 4 GROUP BY a.point_id) """


@query("agg03_radius_outliers", C + DENSITY + "SELECT point_id FROM n WHERE density >= 3")
def agg03(spark, d):
    return clouds.remove_radius_outliers(bridge.cloud(spark, d), 3, 2.0).select("point_id")


@query("agg04_point_density", C + DENSITY + "SELECT point_id, density FROM n")
def agg04(spark, d):
    return clouds.point_density(bridge.cloud(spark, d), 2.0)


@query("agg05_normals")
def agg05(spark, d):
    return rounded(clouds.estimate_normals(bridge.cloud(spark, d), 4.0), "nx", "ny", "nz")


@query("agg06_ground_plane", C + """, s AS (SELECT x, y, z, row_number() OVER (ORDER BY (point_id * 2654435761) % 4294967296, point_id) - 1 AS i FROM cloud),
  t AS (SELECT i // 3 AS plane, i % 3 AS corner, x, y, z FROM s WHERE i < 150),
  c AS (SELECT plane, max(x) FILTER (corner = 0) AS x0, max(y) FILTER (corner = 0) AS y0, max(z) FILTER (corner = 0) AS z0, max(x) FILTER (corner = 1) AS x1, max(y) FILTER (corner = 1) AS y1,
    max(z) FILTER (corner = 1) AS z1, max(x) FILTER (corner = 2) AS x2, max(y) FILTER (corner = 2) AS y2, max(z) FILTER (corner = 2) AS z2 FROM t GROUP BY plane),
  n AS (SELECT plane, x0, y0, z0, (y1-y0)*(z2-z0) - (z1-z0)*(y2-y0) AS n0, (z1-z0)*(x2-x0) - (x1-x0)*(z2-z0) AS n1, (x1-x0)*(y2-y0) - (y1-y0)*(x2-x0) AS n2 FROM c),
  p AS (SELECT plane, n0/l AS a, n1/l AS b, n2/l AS c, -(n0*x0 + n1*y0 + n2*z0)/l AS d FROM (SELECT *, sqrt(n0*n0 + n1*n1 + n2*n2) AS l FROM n)),
  v AS (SELECT plane, a, b, c, d, count(*) AS inliers FROM p JOIN cloud ON abs(a*x + b*y + c*z + d) <= 0.5 GROUP BY ALL)
  SELECT round(a, 6) + 0.0::DOUBLE AS a, round(b, 6) + 0.0::DOUBLE AS b, round(c, 6) + 0.0::DOUBLE AS c, round(d, 6) + 0.0::DOUBLE AS d, inliers FROM v ORDER BY inliers DESC, plane LIMIT 1""")
def agg06(spark, d):
    return rounded(clouds.ground_plane(bridge.cloud(spark, d), 0.5, 50), "a", "b", "c", "d")


@query("agg07_depth_image", C + """, p AS (SELECT z + 12 AS z, 500 * x / (z + 12) + 320 AS u, 500 * y / (z + 12) + 240 AS v FROM cloud)
  SELECT least(479, round_even(v, 0))::INT AS row, least(639, round_even(u, 0))::INT AS col, round(min(z), 6) + 0.0::DOUBLE AS depth FROM p WHERE z > 1e-3 AND u >= 0 AND u < 640 AND v >= 0 AND v < 480 GROUP BY 1, 2""")
def agg07(spark, d):
    camera = g.Intrinsics(500.0, 500.0, 320.0, 240.0, 640, 480)
    pts = bridge.cloud(spark, d).withColumn("z", F.col("z") + 12)
    return rounded(clouds.depth_image(pts, camera), "depth")


@query("agg08_clock_offset", "WITH " + bridge.IMU + "SELECT sensor_id, round(median(yaw - gz), 6) + 0.0::DOUBLE AS median_offset, round(avg(yaw - gz), 6) + 0.0::DOUBLE AS mean_offset FROM imu GROUP BY sensor_id")
def agg08(spark, d):
    off = F.col("yaw") - F.col("gz")
    return rounded(bridge.imu(spark, d).groupBy("sensor_id").agg(F.median(off).alias("median_offset"), F.avg(off).alias("mean_offset")), "median_offset", "mean_offset")


def matched(spark, d):
    return bridge.cloud(spark, d).select("scan_id", F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("z").alias("sz"), (0.8 * F.col("x") - 0.6 * F.col("y") + 1).alias("dx"), (0.6 * F.col("x") + 0.8 * F.col("y") - 2).alias("dy"), (F.col("z") + 0.5).alias("dz"))


MATCHED = ", m AS (SELECT scan_id, x AS sx, y AS sy, z AS sz, 0.8::DOUBLE*x - 0.6::DOUBLE*y + 1 AS dx, 0.6::DOUBLE*x + 0.8::DOUBLE*y - 2 AS dy, z + 0.5::DOUBLE AS dz FROM cloud) "
MOMENTS = [f"{a}_{c}" for a in "sd" for c in "xyz"] + [f"h_{a}{b}" for a in "xyz" for b in "xyz"]


@query("agg09_pair_moments", C + MATCHED + "SELECT scan_id, count(*) AS n, " + ", ".join([f"round(avg({a}{c}), 5) + 0.0::DOUBLE AS {a}_{c}" for a in "sd" for c in "xyz"] + [f"round(covar_pop(s{a}, d{b}) * count(*), 5) + 0.0::DOUBLE AS h_{a}{b}" for a in "xyz" for b in "xyz"]) + " FROM m GROUP BY scan_id")
def agg09(spark, d):
    return fit.pair_moments(matched(spark, d), ("scan_id",)).withColumns({c: F.round(c, 5) + F.lit(0.0) for c in MOMENTS})


@query("agg18_colour_by_height", C + """SELECT point_id, round(greatest(0, least(1, 1.5 - 4*abs(t - 0.75))), 6) + 0.0::DOUBLE AS r, round(greatest(0, least(1, 1.5 - 4*abs(t - 0.5))), 6) + 0.0::DOUBLE AS g, round(greatest(0, least(1, 1.5 - 4*abs(t - 0.25))), 6) + 0.0::DOUBLE AS b
  FROM (SELECT point_id, (z - min(z) OVER w) / (max(z) OVER w - min(z) OVER w) AS t FROM cloud WINDOW w AS (PARTITION BY scan_id))""")
def agg18(spark, d):
    return rounded(clouds.colour_by(bridge.cloud(spark, d), "z").select("point_id", "r", "g", "b"), "r", "g", "b")


# --- scalar functions -----------------------------------------------------------------------------------------------


def posed(spark, d) -> DataFrame:
    """Rows with Euler angles and a position."""
    return bridge.imu(spark, d).select("seq", (F.col("gx") * 600).alias("roll"), (F.col("gy") * 400).alias("pitch"), "yaw", F.col("ax").alias("x"), F.col("ay").alias("y"), F.col("az").alias("z"))


POSED = I + ", posed AS (SELECT seq, gx * 600 AS roll, gy * 400 AS pitch, yaw, ax AS x, ay AS y, az AS z FROM imu), s AS (SELECT *, sin(radians(roll)) AS sr, cos(radians(roll)) AS cr, sin(radians(pitch)) AS sp, cos(radians(pitch)) AS cp, sin(radians(yaw)) AS sy, cos(radians(yaw)) AS cy FROM posed), rot AS (SELECT *, cy*cp AS r00, cy*sp*sr - sy*cr AS r01, cy*sp*cr + sy*sr AS r02, sy*cp AS r10, sy*sp*sr + cy*cr AS r11, sy*sp*cr - cy*sr AS r12, -sp AS r20, cp*sr AS r21, cp*cr AS r22 FROM s) "


def euler() -> g.Pose:
    return g.Pose.from_euler("roll", "pitch", "yaw", "x", "y", "z")


NAMES9 = [f"r{i}{j}" for i in range(3) for j in range(3)]


def named(df: DataFrame, names, values, *keep: str) -> DataFrame:
    return df.select(*keep, *(r6(v).alias(n) for n, v in zip(names, values)))


@query("fn09_rotation_from_euler", POSED + f"SELECT seq, {sql_round(*NAMES9)} FROM rot")
def fn09(spark, d):
    return named(posed(spark, d), NAMES9, euler().r, "seq")


@query("fn05_apply_transform", POSED + f"SELECT seq, {sql_round('r00*1 + r01*2 + r02*3 + x AS px', 'r10*1 + r11*2 + r12*3 + y AS py', 'r20*1 + r21*2 + r22*3 + z AS pz')} FROM rot")
def fn05(spark, d):
    return named(posed(spark, d), ("px", "py", "pz"), euler().apply(1, 2, 3), "seq")


@query("fn04_invert_transform", POSED + f"SELECT seq, {sql_round('-(r00*x + r10*y + r20*z) AS tx', '-(r01*x + r11*y + r21*z) AS ty', '-(r02*x + r12*y + r22*z) AS tz')} FROM rot")
def fn04(spark, d):
    return named(posed(spark, d), ("tx", "ty", "tz"), euler().inverse().t, "seq")


@query("fn03_compose_inverse_is_identity", I + "SELECT seq, 1.0::DOUBLE AS r00, 0.0::DOUBLE AS r01, 1.0::DOUBLE AS r11, 1.0::DOUBLE AS r22, 0.0::DOUBLE AS tx, 0.0::DOUBLE AS tz FROM imu")
def fn03(spark, d):
    both = euler() @ euler().inverse()
    return named(posed(spark, d), ("r00", "r01", "r11", "r22", "tx", "tz"), (both.r[0], both.r[1], both.r[4], both.r[8], both.t[0], both.t[2]), "seq")


@query("fn10_euler_from_rotation", POSED + f"SELECT seq, {sql_round('degrees(atan2(r21, r22)) AS roll', 'degrees(atan2(-r20, sqrt(r00*r00 + r10*r10))) AS pitch', 'degrees(atan2(r10, r00)) AS yaw')} FROM rot WHERE sqrt(r00*r00 + r10*r10) > 1e-3")
def fn10(spark, d):
    df = posed(spark, d).where(F.sqrt(euler().r[0] * euler().r[0] + euler().r[3] * euler().r[3]) > 1e-3)
    return named(df, ("roll", "pitch", "yaw"), g.euler_from_rotation(euler().r), "seq")


HALF = POSED + ", h AS (SELECT seq, sin(radians(roll)/2) AS sr, cos(radians(roll)/2) AS cr, sin(radians(pitch)/2) AS sp, cos(radians(pitch)/2) AS cp, sin(radians(yaw)/2) AS sy, cos(radians(yaw)/2) AS cy FROM posed), q AS (SELECT seq, cr*cp*cy + sr*sp*sy AS w, sr*cp*cy - cr*sp*sy AS x, cr*sp*cy + sr*cp*sy AS y, cr*cp*sy - sr*sp*cy AS z FROM h) "


@query("fn14_quaternion_from_euler", HALF + f"SELECT seq, {sql_round('w', 'x', 'y', 'z')} FROM q")
def fn14(spark, d):
    return named(posed(spark, d), "wxyz", g.quaternion_from_euler("roll", "pitch", "yaw"), "seq")


@query("fn13_euler_from_quaternion", HALF + f"SELECT seq, {sql_round('degrees(atan2(2*(w*x + y*z), 1 - 2*(x*x + y*y))) AS roll', 'degrees(atan2(2*(w*z + x*y), 1 - 2*(y*y + z*z))) AS yaw')} FROM q WHERE abs(2*(w*y - z*x)) < 0.99")
def fn13(spark, d):
    q = g.quaternion_from_euler("roll", "pitch", "yaw")
    roll, _, yaw = g.euler_from_quaternion(q)
    return named(posed(spark, d).where(F.abs(2 * (q[0] * q[2] - q[3] * q[1])) < 0.99), ("roll", "yaw"), (roll, yaw), "seq")


@query("fn12_quaternion_round_trip", POSED + f"SELECT seq, {sql_round(*NAMES9)} FROM rot")
def fn12(spark, d):
    # one column set for each step: nested, the expressions would be repeated many times over
    rows = posed(spark, d).select("seq", *(v.alias(n) for n, v in zip(NAMES9, euler().r)))
    rows = rows.select("seq", *(v.alias(n) for n, v in zip("wxyz", g.quaternion_from_rotation(tuple(F.col(n) for n in NAMES9)))))
    return named(rows, NAMES9, g.rotation_from_quaternion(tuple(F.col(n) for n in "wxyz")), "seq")


@query("fn15_rotation_angle", POSED + f"SELECT seq, round(degrees(acos(greatest(-1, least(1, (r00 + r11 + r22 - 1) / 2)))), 4) + 0.0::DOUBLE AS angle FROM rot")
def fn15(spark, d):
    return posed(spark, d).select("seq", (F.round(g.rotation_angle(euler().r), 4) + F.lit(0.0)).alias("angle"))


PROJECT = C + ", p AS (SELECT point_id, z + 12 AS z, x / (z + 12) AS a, y / (z + 12) AS b FROM cloud), r AS (SELECT *, a*a + b*b AS r2, 1 + (a*a + b*b) * (0.1::DOUBLE + (a*a + b*b) * (-0.05::DOUBLE + (a*a + b*b) * 0.01::DOUBLE)) AS k FROM p), uv AS (SELECT point_id, z, 500 * (a*k + 2*0.001::DOUBLE*a*b - 0.002::DOUBLE*(r2 + 2*a*a)) + 320 AS u, 500 * (b*k + 0.001::DOUBLE*(r2 + 2*b*b) - 2*0.002::DOUBLE*a*b) + 240 AS v FROM r) "


@query("fn18_project_distorted", PROJECT + f"SELECT point_id, {sql_round('u', 'v')}, u >= 0 AND u < 640 AND v >= 0 AND v < 480 AS valid FROM uv")
def fn18(spark, d):
    u, v, valid = g.project("x", "y", F.col("z") + 12, CAMERA)
    return bridge.cloud(spark, d).select("point_id", r6(u).alias("u"), r6(v).alias("v"), valid.alias("valid"))


@query("fn20_tilt", I + f"SELECT seq, {sql_round('atan2(ay, az) AS roll', 'atan2(-ax, sqrt(ay*ay + az*az)) AS pitch')} FROM imu")
def fn20(spark, d):
    roll, pitch = g.tilt_from_accel("ax", "ay", "az")
    return named(bridge.imu(spark, d), ("roll", "pitch"), (roll, pitch), "seq")


@query("fn21_normalize_angle", I + f"SELECT seq, {sql_round('CASE WHEN abs(yaw) <= pi() THEN yaw ELSE yaw - 2*pi()*floor((yaw + pi()) / (2*pi())) END AS angle')} FROM imu")
def fn21(spark, d):
    return named(bridge.imu(spark, d), ("angle",), (g.normalize_angle("yaw"),), "seq")


@query("src01b_polar_to_xyz", R + f""", e AS (SELECT *, radians(CASE WHEN channel % 2 = 0 THEN channel - 15 ELSE channel END) AS el, radians(azimuth_deg) AS az FROM returns WHERE distance_m >= 0.1)
  SELECT channel, {sql_round('distance_m * cos(el) * sin(az) AS x', 'distance_m * cos(el) * cos(az) AS y', 'distance_m * sin(el) AS z')} FROM e""")
def src01b(spark, d):
    return rounded(packets.polar_to_xyz(bridge.returns(spark, d).where(F.col("distance_m") >= 0.1)).select("channel", "x", "y", "z"), "x", "y", "z")


# --- serial lines ---------------------------------------------------------------------------------------------------


@query("src07_csv_lines", """WITH l AS (SELECT event_id AS seq, CASE WHEN event_id % 11 = 0 THEN 'bad' ELSE concat_ws(',', value, ' ' || event_id, user_id, '1.5', '-2', '3') || CASE WHEN event_id % 2 = 0 THEN ',10,20,30' ELSE '' END END AS line FROM events), p AS (SELECT seq, string_split(line, ',') AS p FROM l)
  SELECT seq, len(p) >= 6 AS ok, CASE WHEN len(p) >= 6 THEN trim(p[1])::DOUBLE END AS ax, CASE WHEN len(p) >= 6 THEN trim(p[2])::DOUBLE END AS ay, CASE WHEN len(p) >= 6 THEN trim(p[6])::DOUBLE END AS gz, CASE WHEN len(p) >= 9 THEN trim(p[7])::DOUBLE END AS mx FROM p""")
def src07(spark, d):
    line = F.concat_ws(",", F.col("value").cast("string"), F.concat(F.lit(" "), F.col("event_id")), "user_id", F.lit("1.5"), F.lit("-2"), F.lit("3"))
    line = F.when(F.col("event_id") % 11 == 0, "bad").otherwise(F.concat(line, F.when(F.col("event_id") % 2 == 0, ",10,20,30").otherwise("")))
    return serial.parse_csv_lines(bridge.table(spark, d, "events").select(F.col("event_id").alias("seq"), line.alias("line"))).select("seq", "ok", "ax", "ay", "gz", "mx")


@query("src08_pashr_lines", I + f""", l AS (SELECT seq, yaw AS y, gx * 100 AS p, gy * 100 AS r FROM imu), h AS (SELECT *, radians(r)/2 AS hr, radians(p)/2 AS hp, radians(y)/2 AS hy FROM l)
  SELECT seq, {sql_round('y AS yaw', 'p AS pitch', 'r AS roll', 'cos(hr)*cos(hp)*cos(hy) + sin(hr)*sin(hp)*sin(hy) AS qw')} FROM h""")
def src08(spark, d):
    line = F.concat(F.lit("$PASHR,"), F.concat_ws(",", F.col("yaw").cast("string"), (F.col("gx") * 100).cast("string"), (F.col("gy") * 100).cast("string"), F.lit("0")), F.lit("*5A"))
    parsed = serial.parse_pashr(bridge.imu(spark, d).select("seq", line.alias("line")))
    return rounded(parsed.select("seq", "yaw", "pitch", "roll", "qw"), "yaw", "pitch", "roll", "qw")


@query("src19_mount_status", """SELECT c_custkey AS id, round((c_custkey * 7919 % 64800000) / 360000.0::DOUBLE, 6) AS longitude, round((c_custkey * 104729 % 64800000) / 360000.0::DOUBLE - 90, 6) + 0.0::DOUBLE AS latitude, (c_custkey % 3)::INT AS gps, (c_custkey % 8)::INT AS system FROM customer""")
def src19(spark, d):
    k = F.col("c_custkey")
    reply = F.concat(F.lpad((k * 7919 % 64800000).cast("string"), 9, "0"), F.lpad((k * 104729 % 64800000).cast("string"), 8, "0"), (k % 3).cast("string"), (k % 8).cast("string"), F.lit("2170#"))
    parsed = serial.parse_mount_status(bridge.table(spark, d, "customer").select(k.alias("id"), reply.alias("reply")))
    return rounded(parsed.select("id", "longitude", "latitude", "gps", "system"), "longitude", "latitude")


# --- joins ----------------------------------------------------------------------------------------------------------

SIDES = I + ", l AS (SELECT sensor_id, seq, t FROM imu WHERE kind = 'click'), r AS (SELECT sensor_id, t, min(seq) AS seq FROM imu WHERE kind = 'view' GROUP BY sensor_id, t) "


def sides(spark, d):
    rows = bridge.imu(spark, d)
    return rows.where("kind = 'click'").select("sensor_id", "seq", "t"), rows.where("kind = 'view'").groupBy("sensor_id", "t").agg(F.min("seq").alias("seq"))


@query("join01_asof_nearest", SIDES + "SELECT sensor_id, seq, near_seq FROM (SELECT l.sensor_id, l.seq, r.seq AS near_seq, row_number() OVER (PARTITION BY l.seq ORDER BY abs(l.t - r.t), r.t) AS k FROM l LEFT JOIN r ON l.sensor_id = r.sensor_id) WHERE k = 1")
def join01(spark, d):
    left, right = sides(spark, d)
    return align.asof_nearest(left, right, ("sensor_id",), bucket=5.0).select("sensor_id", "seq", "near_seq")


@query("join02_bracket", SIDES + """, f AS (SELECT sensor_id, seq, t, row_number() OVER (PARTITION BY sensor_id ORDER BY t) AS k, count(*) OVER (PARTITION BY sensor_id) AS n FROM r),
  b AS (SELECT l.sensor_id, l.seq, l.t, (SELECT max(k) FROM f WHERE f.sensor_id = l.sensor_id AND f.t < l.t) AS lo, (SELECT min(k) FROM f WHERE f.sensor_id = l.sensor_id AND f.t >= l.t) AS hi FROM l)
  SELECT b.sensor_id, b.seq, x.seq AS lo_seq, y.seq AS hi_seq FROM b LEFT JOIN f x ON x.sensor_id = b.sensor_id AND x.k = b.lo AND b.hi IS NOT NULL LEFT JOIN f y ON y.sensor_id = b.sensor_id AND y.k = b.hi AND b.lo IS NOT NULL""")
def join02(spark, d):
    left, right = sides(spark, d)
    return align.bracket(left, right, ("sensor_id",), bucket=5.0).select("sensor_id", "seq", "lo_seq", "hi_seq")


@query("join03_interval", SIDES + "SELECT l.sensor_id, l.seq, r.seq AS other FROM l JOIN r ON l.sensor_id = r.sensor_id AND r.t BETWEEN l.t - 0.5::DOUBLE AND l.t + 0.5::DOUBLE")
def join03(spark, d):
    left, right = sides(spark, d)
    left = left.select("sensor_id", "seq", (F.col("t") - 0.5).alias("t0"), (F.col("t") + 0.5).alias("t1"))
    return align.interval_join(left, right.withColumnRenamed("seq", "other"), ("sensor_id",)).select("sensor_id", "seq", "other")


@query("join04_descriptor_matches", D + """, p AS (SELECT a.id AS query, b.id AS train, bit_count(xor(a.b0, b.b0)) + bit_count(xor(a.b1, b.b1)) AS distance FROM descriptors a JOIN descriptors b ON b.frame = a.frame + 1),
  k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, train) AS r, lead(distance) OVER (PARTITION BY query ORDER BY distance, train) AS second FROM p)
  SELECT query, train, distance::INT AS distance FROM k WHERE r = 1 AND distance < 0.95 * second""")
def join04(spark, d):
    rows = bridge.descriptors(spark, d)
    a, b = rows.withColumn("pair", F.col("frame") + 1), rows.withColumn("pair", F.col("frame"))
    return align.descriptor_matches(a, b, ("b0", "b1"), 0.95, ("pair",)).select("query", "train", F.col("distance").cast("int").alias("distance"))


@query("join06_loop_candidates", T + """, k AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY t, seq) AS idx FROM trajectory)
  SELECT a.sensor_id, a.idx AS query, b.idx AS match, round(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)), 6) AS distance FROM k a JOIN k b ON a.sensor_id = b.sensor_id AND a.idx - b.idx >= 10
  AND sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) <= 0.8""")
def join06(spark, d):
    w = Window.partitionBy("sensor_id").orderBy("t", "seq")
    poses = bridge.trajectory(spark, d).withColumn("idx", F.row_number().over(w).cast("long"))
    return rounded(align.loop_candidates(poses, 0.8, 10, ("sensor_id",)), "distance")


@query("join07_assign_depth", C + """, p AS (SELECT point_id, z + 12 AS z, 500 * x / (z + 12) + 320 AS u, 500 * y / (z + 12) + 240 AS v FROM cloud), k AS (SELECT point_id AS kp, u, v FROM p WHERE point_id % 3 = 0 AND u > 0 AND v > 0), i AS (SELECT * FROM p WHERE point_id % 3 <> 0 AND u > 0 AND v > 0),
  j AS (SELECT k.kp, i.z, row_number() OVER (PARTITION BY k.kp ORDER BY (k.u-i.u)*(k.u-i.u) + (k.v-i.v)*(k.v-i.v), i.point_id) AS r FROM k JOIN i ON (k.u-i.u)*(k.u-i.u) + (k.v-i.v)*(k.v-i.v) < 400)
  SELECT k.kp, round(j.z, 6) AS depth FROM k LEFT JOIN j ON j.kp = k.kp AND j.r = 1""")
def join07(spark, d):
    pts = bridge.cloud(spark, d).withColumn("z", F.col("z") + 12)
    pts = pts.select("point_id", "z", (500 * F.col("x") / F.col("z") + 320).alias("u"), (500 * F.col("y") / F.col("z") + 240).alias("v")).where("u > 0 AND v > 0")
    kp = pts.where("point_id % 3 = 0").select(F.col("point_id").alias("kp"), "u", "v")
    return align.assign_depth(kp, pts.where("point_id % 3 <> 0").withColumnRenamed("point_id", "idx"), 20.0).select("kp", F.round("depth", 6).alias("depth"))


# --- windows --------------------------------------------------------------------------------------------------------


@query("win01_sweeps", R + """, k AS (SELECT seq, packet_id, channel, azimuth_deg, lag(azimuth_deg) OVER w AS last FROM returns WINDOW w AS (PARTITION BY seq ORDER BY packet_id, channel, azimuth_deg, distance_m, intensity)),
  s AS (SELECT seq, (azimuth_deg < last AND last > 270 AND azimuth_deg < 90)::INT AS wrap FROM k) SELECT seq, sum(wrap)::BIGINT AS sweeps FROM s GROUP BY seq""")
def win01(spark, d):
    marked = ordered.sweep_ids(bridge.returns(spark, d), ("seq",), ("packet_id", "channel", "azimuth_deg", "distance_m", "intensity"))
    return marked.groupBy("seq").agg(F.max("sweep").alias("sweeps"))


UNWRAP = I + """, k AS (SELECT *, yaw - lag(yaw) OVER (PARTITION BY sensor_id ORDER BY t, seq) AS step FROM imu), u AS (SELECT *, yaw + sum(CASE WHEN step > 180 THEN -360 WHEN step < -180 THEN 360 ELSE 0 END) OVER (PARTITION BY sensor_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS yaw_unwrapped FROM k) """


@query("win01_long_session", R + """, n AS (SELECT *, row_number() OVER (ORDER BY packet_id, seq, channel, azimuth_deg, distance_m, intensity) AS i FROM returns), k AS (SELECT *, lag(azimuth_deg) OVER (ORDER BY i) AS last FROM n)
  SELECT packet_id, seq, channel, azimuth_deg, sum(coalesce(azimuth_deg < last AND last > 270 AND azimuth_deg < 90, false)::INT) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING)::BIGINT AS sweep FROM k""")
def win01_long(spark, d):
    """All returns as those of one sensor."""
    rows = scans.sweep_ids(bridge.returns(spark, d), (), ("packet_id", "seq", "channel", "azimuth_deg", "distance_m", "intensity"))
    return rows.select("packet_id", "seq", "channel", "azimuth_deg", "sweep")


@query("win14_long_session", UNWRAP.replace("PARTITION BY sensor_id ", "") + "SELECT seq, round(yaw_unwrapped, 6) + 0.0::DOUBLE AS yaw_unwrapped FROM u")
def win14_long(spark, d):
    """All rows as those of one sensor."""
    return rounded(scans.unwrap_yaw(bridge.imu(spark, d).select("t", "seq", "yaw"), (), ("t", "seq")).select("seq", "yaw_unwrapped"), "yaw_unwrapped")


@query("win14_unwrap_yaw", UNWRAP + "SELECT seq, round(yaw_unwrapped, 6) + 0.0::DOUBLE AS yaw_unwrapped FROM u")
def win14(spark, d):
    return rounded(ordered.unwrap_yaw(bridge.imu(spark, d), ("sensor_id",), ("t", "seq")).select("seq", "yaw_unwrapped"), "yaw_unwrapped")


QUATERNION = sql_round("w AS qw", "x AS qx", "y AS qy", "z AS qz")
NUMBERED = "WITH RECURSIVE " + bridge.IMU + ", k AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY t, seq) AS i, t - lag(t) OVER (PARTITION BY sensor_id ORDER BY t, seq) AS dt FROM imu), "


@query("win05_gyro_only", NUMBERED + f"""f AS (SELECT sensor_id, 0::BIGINT AS i, -1::BIGINT AS seq, 1.0::DOUBLE AS w, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z FROM k WHERE i = 1
  UNION ALL SELECT sensor_id, i, seq, w1 / n, x1 / n, y1 / n, z1 / n FROM (SELECT *, sqrt(w1*w1 + x1*x1 + y1*y1 + z1*z1) AS n FROM (SELECT *, z + 0.005::DOUBLE * (w1*gz + x1*gy - y1*gx) AS z1 FROM
    (SELECT *, y + 0.005::DOUBLE * (w1*gy - x1*gz + z*gx) AS y1 FROM (SELECT *, x + 0.005::DOUBLE * (w1*gx + y*gz - z*gy) AS x1 FROM
      (SELECT k.sensor_id, k.i, k.seq, gx, gy, gz, w, x, y, z, w + 0.005::DOUBLE * (-x*gx - y*gy - z*gz) AS w1 FROM f JOIN k ON k.sensor_id = f.sensor_id AND k.i = f.i + 1))))))
  SELECT sensor_id, seq, {QUATERNION} FROM f WHERE i > 0""")
def win05(spark, d):
    return rounded(folds.attitude(nine_axes(spark, d), ("sensor_id",), ("t", "seq"), "gyro", carry=("seq",)), "qw", "qx", "qy", "qz")


def nine_axes(spark, d):
    return bridge.imu(spark, d).withColumns({"mx": F.when(F.col("seq") % 2 == 0, F.lit(25.0)), "my": F.when(F.col("seq") % 2 == 0, F.col("gx") * 10), "mz": F.when(F.col("seq") % 2 == 0, F.lit(-40.0))})


def filter_sql(extra: list[str], steps: list[str], rate: tuple[str, str, str]) -> str:
    """A recursion over each sensor's rows: ``steps`` name values in turn, then the gyro step at ``rate`` or, without it, the named w1 .. z1."""
    gx, gy, gz = rate or ("", "", "")
    gyro = [f"w + 0.005::DOUBLE * (-x*({gx}) - y*({gy}) - z*({gz})) AS w1", f"x + 0.005::DOUBLE * (w1*({gx}) + y*({gz}) - z*({gy})) AS x1", f"y + 0.005::DOUBLE * (w1*({gy}) - x1*({gz}) + z*({gx})) AS y1", f"z + 0.005::DOUBLE * (w1*({gz}) + x1*({gy}) - y1*({gx})) AS z1"] if rate else []
    rows = "SELECT k.sensor_id, k.i, k.seq, gx, gy, gz, ax, ay, az, mx, my, mz, w, x, y, z" + "".join(f", {c}" for c in extra) + " FROM f JOIN k ON k.sensor_id = f.sensor_id AND k.i = f.i + 1"
    for step in [*steps, *gyro, "sqrt(w1*w1 + x1*x1 + y1*y1 + z1*z1) AS n1"]:
        rows = f"SELECT *, {step} FROM ({rows})"
    kept = "".join(f", {c}1" for c in extra)
    start = "".join(f", 0.0::DOUBLE AS {c}" for c in extra)
    return f"""WITH RECURSIVE {bridge.IMU}, k AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY t, seq) AS i, CASE WHEN seq % 2 = 0 THEN 25.0::DOUBLE END AS mx, CASE WHEN seq % 2 = 0 THEN gx * 10 END AS my, CASE WHEN seq % 2 = 0 THEN -40.0::DOUBLE END AS mz FROM imu),
  f AS (SELECT sensor_id, 0::BIGINT AS i, -1::BIGINT AS seq, 1.0::DOUBLE AS w, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z{start} FROM k WHERE i = 1 UNION ALL SELECT sensor_id, i, seq, w1 / n1, x1 / n1, y1 / n1, z1 / n1{kept} FROM ({rows}))
  SELECT sensor_id, seq, {QUATERNION} FROM f WHERE i > 0"""


#: Unit gravity (a, b, c) and field (d, e, g), the field in the world's frame, and its image bx, bz as the sensor should see it.
DIRECTIONS = [
    "sqrt(ax*ax + ay*ay + az*az) AS an, sqrt(mx*mx + my*my + mz*mz) AS mn",
    "ax/an AS a, ay/an AS b, az/an AS c, mx/mn AS d, my/mn AS e, mz/mn AS g",
    "2*d*(0.5 - y*y - z*z) + 2*e*(x*y - w*z) + 2*g*(x*z + w*y) AS hx, 2*d*(x*y + w*z) + 2*e*(0.5 - x*x - z*z) + 2*g*(y*z - w*x) AS hy, 2*d*(x*z - w*y) + 2*e*(y*z + w*x) + 2*g*(0.5 - x*x - y*y) AS bz",
    "sqrt(hx*hx + hy*hy) AS bx",
    "2*bx*(0.5 - y*y - z*z) + 2*bz*(x*z - w*y) AS fx, 2*bx*(x*y - w*z) + 2*bz*(w*x + y*z) AS fy, 2*bx*(w*y + x*z) + 2*bz*(0.5 - x*x - y*y) AS fz",
]
# the gradient of half the squared differences, over six rows, or the six-axis form where there is no field
JACOBIAN = (
    ("-2*y", "2*z", "-2*w", "2*x"), ("2*x", "2*w", "2*z", "2*y"), ("0", "-4*x", "-4*y", "0"), ("-2*bz*y", "2*bz*z", "-4*bx*y - 2*bz*w", "-4*bx*z + 2*bz*x"),
    ("-2*bx*z + 2*bz*x", "2*bx*y + 2*bz*w", "2*bx*x + 2*bz*z", "-2*bx*w + 2*bz*y"), ("2*bx*y", "2*bx*z - 4*bz*x", "2*bx*w - 4*bz*y", "2*bx*x"),
)
NINE = [" + ".join(f"({row[i]})*d{k}" for k, row in enumerate(JACOBIAN)) for i in range(4)]
SIX = [" + ".join(f"({row[i]})*d{k}" for k, row in enumerate(JACOBIAN[:3])) for i in range(4)]
MADGWICK = [
    *DIRECTIONS,
    "2*(x*z - w*y) - a AS d0, 2*(w*x + y*z) - b AS d1, 1 - 2*(x*x + y*y) - c AS d2, fx - d AS d3, fy - e AS d4, fz - g AS d5",
    "4*(x*x + y*y - 0.5) AS pull",
    f"CASE WHEN d IS NULL THEN pull*w - ({SIX[0]}) ELSE {NINE[0]} END AS s0, CASE WHEN d IS NULL THEN pull*x - ({SIX[1]}) ELSE {NINE[1]} END AS s1, CASE WHEN d IS NULL THEN pull*y - ({SIX[2]}) ELSE {NINE[2]} END AS s2, CASE WHEN d IS NULL THEN {SIX[3]} ELSE {NINE[3]} END AS s3",
    "greatest(sqrt(s0*s0 + s1*s1 + s2*s2 + s3*s3), 1e-300::DOUBLE) AS sn",
    "w + 0.01::DOUBLE * (0.5*(-x*gx - y*gy - z*gz) - 0.1::DOUBLE*s0/sn) AS w1, x + 0.01::DOUBLE * (0.5*(w*gx + y*gz - z*gy) - 0.1::DOUBLE*s1/sn) AS x1, y + 0.01::DOUBLE * (0.5*(w*gy - x*gz + z*gx) - 0.1::DOUBLE*s2/sn) AS y1, z + 0.01::DOUBLE * (0.5*(w*gz + x*gy - y*gx) - 0.1::DOUBLE*s3/sn) AS z1",
]
MAHONY = [
    *DIRECTIONS,
    "2*(x*z - w*y) AS vx, 2*(w*x + y*z) AS vy, w*w - x*x - y*y + z*z AS vz",
    "b*vz - c*vy + coalesce(e*fz - g*fy, 0) AS e0, c*vx - a*vz + coalesce(g*fx - d*fz, 0) AS e1, a*vy - b*vx + coalesce(d*fy - e*fx, 0) AS e2",
    "i0 + 0.01::DOUBLE*e0 AS i01, i1 + 0.01::DOUBLE*e1 AS i11, i2 + 0.01::DOUBLE*e2 AS i21",
]


@query("win03_madgwick", filter_sql([], MADGWICK, ()))
def win03(spark, d):
    return rounded(folds.attitude(nine_axes(spark, d), ("sensor_id",), ("t", "seq"), carry=("seq",)), "qw", "qx", "qy", "qz")


@query("win06_mahony", filter_sql(["i0", "i1", "i2"], MAHONY, tuple(f"g{c} + 0.1::DOUBLE*i{k}1 + 0.5::DOUBLE*e{k}" for k, c in enumerate("xyz"))))
def win06(spark, d):
    return rounded(folds.attitude(nine_axes(spark, d), ("sensor_id",), ("t", "seq"), "mahony", ki=0.1, carry=("seq",)), "qw", "qx", "qy", "qz")


@query("win08_preintegration", NUMBERED + f"""f AS (SELECT sensor_id, 0::BIGINT AS i, -1::BIGINT AS seq, 1.0::DOUBLE AS w, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z FROM k WHERE i = 1
  UNION ALL SELECT sensor_id, i, seq, w1 / n, x1 / n, y1 / n, z1 / n FROM (SELECT *, sqrt(w1*w1 + x1*x1 + y1*y1 + z1*z1) AS n FROM
    (SELECT sensor_id, i, seq, w + h * (-x*gx - y*gy - z*gz) AS w1, x + h * (w*gx + y*gz - z*gy) AS x1, y + h * (w*gy - x*gz + z*gx) AS y1, z + h * (w*gz + x*gy - y*gx) AS z1 FROM
      (SELECT k.sensor_id, k.i, k.seq, gx, gy, gz, w, x, y, z, CASE WHEN dt > 0 AND dt <= 1 AND sqrt(gx*gx + gy*gy + gz*gz) >= 0.005::DOUBLE THEN 0.5::DOUBLE * dt ELSE 0.0::DOUBLE END AS h FROM f JOIN k ON k.sensor_id = f.sensor_id AND k.i = f.i + 1))))
  SELECT sensor_id, seq, {QUATERNION} FROM f WHERE i > 0""")
def win08(spark, d):
    return rounded(folds.preintegrate(bridge.imu(spark, d), ("sensor_id",), ("t", "seq"), carry=("seq",)), "qw", "qx", "qy", "qz")


@query("win09_preintegration_matrix", NUMBERED + """f AS (SELECT sensor_id, 0::BIGINT AS i, -1::BIGINT AS seq, [1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0]::DOUBLE[] AS r FROM k WHERE i = 1
  UNION ALL SELECT sensor_id, i, seq, [list_dot_product(r[1:3], [e0, e3, e6]), list_dot_product(r[1:3], [e1, e4, e7]), list_dot_product(r[1:3], [e2, e5, e8]), list_dot_product(r[4:6], [e0, e3, e6]), list_dot_product(r[4:6], [e1, e4, e7]),
      list_dot_product(r[4:6], [e2, e5, e8]), list_dot_product(r[7:9], [e0, e3, e6]), list_dot_product(r[7:9], [e1, e4, e7]), list_dot_product(r[7:9], [e2, e5, e8])] FROM
    (SELECT sensor_id, i, seq, r, 1 - b*(y*y + z*z) AS e0, b*x*y - a*z AS e1, b*x*z + a*y AS e2, b*x*y + a*z AS e3, 1 - b*(x*x + z*z) AS e4, b*y*z - a*x AS e5, b*x*z - a*y AS e6, b*y*z + a*x AS e7, 1 - b*(x*x + y*y) AS e8 FROM
      (SELECT *, CASE WHEN n > 1e-12 THEN sin(n) / n ELSE 1.0::DOUBLE END AS a, CASE WHEN n > 1e-12 THEN (1 - cos(n)) / (n * n) ELSE 0.5::DOUBLE END AS b FROM (SELECT *, sqrt(x*x + y*y + z*z) AS n FROM
        (SELECT k.sensor_id, k.i, k.seq, r, h * gx AS x, h * gy AS y, h * gz AS z FROM f JOIN (SELECT *, CASE WHEN dt > 0 AND dt <= 1 THEN dt ELSE 0.0::DOUBLE END AS h FROM k) k ON k.sensor_id = f.sensor_id AND k.i = f.i + 1)))))
  SELECT sensor_id, seq, """ + ", ".join(f"round(r[{n + 1}], 6) + 0.0::DOUBLE AS r{n // 3}{n % 3}" for n in range(9)) + " FROM f WHERE i > 0")
def win09(spark, d):
    return rounded(folds.preintegrate_matrix(bridge.imu(spark, d), ("sensor_id",), ("t", "seq"), carry=("seq",)), *folds.ROTATION)


@query("win11_keyframes", "WITH RECURSIVE " + bridge.TRAJECTORY + """, k AS (SELECT sensor_id, seq, x, y, z, yaw, row_number() OVER (PARTITION BY sensor_id ORDER BY t, seq) AS i FROM trajectory),
  f AS (SELECT sensor_id, i, seq, x, y, z, yaw, true AS picked FROM k WHERE i = 1 UNION ALL
    SELECT k.sensor_id, k.i, CASE WHEN p THEN k.seq ELSE f.seq END, CASE WHEN p THEN k.x ELSE f.x END, CASE WHEN p THEN k.y ELSE f.y END, CASE WHEN p THEN k.z ELSE f.z END, CASE WHEN p THEN k.yaw ELSE f.yaw END, p
    FROM f JOIN (SELECT * FROM k) k ON k.sensor_id = f.sensor_id AND k.i = f.i + 1, LATERAL (SELECT sqrt((k.x-f.x)*(k.x-f.x) + (k.y-f.y)*(k.y-f.y) + (k.z-f.z)*(k.z-f.z)) >= 1.5 OR least(abs(k.yaw - f.yaw), 360 - abs(k.yaw - f.yaw)) >= 75 AS p))
  SELECT sensor_id, seq FROM f WHERE picked""")
def win11(spark, d):
    return folds.keyframes(bridge.trajectory(spark, d), ("sensor_id",), ("t", "seq"), distance=1.5, angle=75.0, carry=("seq",)).select("sensor_id", "seq")


@query("win17_pose_deltas", T + f", k AS (SELECT seq, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, yaw - lag(yaw) OVER w AS dyaw FROM trajectory WINDOW w AS (PARTITION BY sensor_id ORDER BY t, seq)) SELECT seq, {sql_round('dx AS d_x', 'dy AS d_y', 'dyaw AS d_yaw')} FROM k")
def win17(spark, d):
    rows = ordered.pose_deltas(bridge.trajectory(spark, d), ("sensor_id",), ("t", "seq"))
    return rounded(rows.select("seq", "d_x", "d_y", "d_yaw"), "d_x", "d_y", "d_yaw")


@query("win18_rates", I + "SELECT sensor_id, floor(t)::BIGINT AS slot, count(*) AS n, count(*)::DOUBLE AS hz FROM imu GROUP BY sensor_id, slot")
def win18(spark, d):
    return ordered.rates(bridge.imu(spark, d), ("sensor_id",))


@query("win19_latest", I + "SELECT sensor_id, seq, round(yaw, 6) + 0.0::DOUBLE AS yaw FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY t DESC, seq DESC) AS r FROM imu) WHERE r = 1")
def win19(spark, d):
    return rounded(ordered.latest(bridge.imu(spark, d), ("sensor_id",)).select("sensor_id", "seq", "yaw"), "yaw")


@query("win20_newest", I + "SELECT sensor_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY t DESC, seq DESC) AS r FROM imu) WHERE r <= 5")
def win20(spark, d):
    return ordered.newest(bridge.imu(spark, d), ("sensor_id",), 5).select("sensor_id", "seq")


@query("snk13_segments", T + f", k AS (SELECT seq, x, y, lead(x) OVER w AS to_x, lead(y) OVER w AS to_y FROM trajectory WINDOW w AS (PARTITION BY sensor_id ORDER BY t, seq)) SELECT seq, {sql_round('x', 'y', 'to_x', 'to_y')} FROM k WHERE to_x IS NOT NULL")
def snk13(spark, d):
    return rounded(ordered.segments(bridge.trajectory(spark, d), ("sensor_id",), ("t", "seq")).select("seq", "x", "y", "to_x", "to_y"), "x", "y", "to_x", "to_y")


@query("snk10_top_down_raster", C + """, p AS (SELECT point_id, intensity, trunc(100 + (x - 1) * 20)::INT AS px, trunc(100 - (y + 1) * 20)::INT AS py FROM cloud WHERE abs(x - 1) < 5 AND abs(y + 1) < 5)
  SELECT px, py, arg_max(intensity, point_id) AS intensity FROM p WHERE px BETWEEN 0 AND 199 AND py BETWEEN 0 AND 199 GROUP BY px, py""")
def snk10(spark, d):
    return clouds.top_down_raster(bridge.cloud(spark, d), (1, -1), 5.0, 200)


# --- pose graphs ----------------------------------------------------------------------------------------------------


def graph(spark, d):
    """Poses and factors of the first sensors' paths: steps between consecutive poses, each a little off."""
    w = Window.partitionBy("sensor_id").orderBy("t", "seq")
    rows = bridge.trajectory(spark, d)
    poses = rows.select(F.col("seq").alias("id"), "x", "y", "z", "yaw")
    steps = rows.select(F.col("seq").alias("a"), F.lead("seq").over(w).alias("b"), *((F.lead(c).over(w) - F.col(c) + F.col("gx")).alias(c) for c in fit.DOF), F.lit(1.0).alias("weight")).where("b is not null")
    return poses, steps


@query("agg19_residual_norm", T + """, s AS (SELECT lead(seq) OVER w AS b, gx FROM trajectory WINDOW w AS (PARTITION BY sensor_id ORDER BY t, seq)) SELECT round(sqrt(sum(4 * gx * gx)), 6) AS norm FROM s WHERE b IS NOT NULL""")
def agg19(spark, d):
    return rounded(fit.residual_norm(*graph(spark, d)), "norm")


@query("agg20_normal_equations", T + f""", s AS (SELECT seq AS a, lead(seq) OVER w AS b, gx FROM trajectory WINDOW w AS (PARTITION BY sensor_id ORDER BY t, seq)), f AS (SELECT * FROM s WHERE b IS NOT NULL),
  u AS (SELECT a AS i, -gx AS e FROM f UNION ALL SELECT b, gx FROM f), r AS (SELECT i, sum(e) AS e FROM u GROUP BY i),
  m AS (SELECT a AS i, a AS j, 1.0::DOUBLE AS h FROM f UNION ALL SELECT b, b, 1 FROM f UNION ALL SELECT a, b, -1 FROM f UNION ALL SELECT b, a, -1 FROM f), h AS (SELECT i, j, sum(h) AS h FROM m GROUP BY i, j)
  SELECT h.i, h.j, h.h, {", ".join(f"CASE WHEN h.i = h.j THEN round(e, 6) + 0.0::DOUBLE END AS b_{c}" for c in fit.DOF)} FROM h JOIN r USING (i)""")
def agg20(spark, d):
    h, b = fit.normal_equations(*graph(spark, d))
    both = h.join(b, "i").select("i", "j", "h", *(F.when(F.col("i") == F.col("j"), F.col(f"b_{c}")).alias(f"b_{c}") for c in fit.DOF))
    return rounded(both, *(f"b_{c}" for c in fit.DOF))


@query("fit03_rigid_fit")
def fit03(spark, d):
    m = fit.rigid_fit(matched(spark, d))
    return spark.createDataFrame([tuple(float(v) for v in r) for r in m.round(6)], "c0 double, c1 double, c2 double, c3 double")


# --- the rotation test, flagship ------------------------------------------------------------------------------------


@query("pipe09_rotation_test", UNWRAP + """, r AS (SELECT sensor_id, count(*) AS n, regr_slope(yaw_unwrapped, t) AS slope, avg(gz) * (180 / pi()) AS gyro_rate, round(max(t) - min(t), 6) AS elapsed,
  round(arg_max(yaw_unwrapped, (t, seq)) - arg_min(yaw_unwrapped, (t, seq)), 6) + 0.0::DOUBLE AS total_turn FROM u GROUP BY sensor_id)
  SELECT sensor_id, n, round(slope, 4) + 0.0::DOUBLE AS slope, round(gyro_rate, 6) + 0.0::DOUBLE AS gyro_rate, elapsed, total_turn, coalesce(abs(slope) <= 5, false) OR coalesce(abs(gyro_rate) <= 5, false) AS passed FROM r""")
def flagship(spark, d):
    out = ordered.rotation_report(bridge.imu(spark, d), ("sensor_id",), ("t", "seq"))
    return rounded(out, "gyro_rate", "elapsed", "total_turn").withColumn("slope", F.round("slope", 4) + F.lit(0.0))


from pointloom.plans import mapping_queries, more_queries  # noqa: E402, F401  they register their own
