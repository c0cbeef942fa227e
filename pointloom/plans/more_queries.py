"""Further named queries: reports, serial formats, image lookups, interpolation and accumulation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pointloom.functions import binary, geometry as g
from pointloom.operators import align, cloud as clouds, folds, ordered, reports, scans
from pointloom.plans import bridge
from pointloom.plans.base import query, r6, rounded, sql_round
from pointloom.operators import durable
from pointloom.operators.durable import scratch_path
from pointloom.sources import packets, recordings, serial, writers

C, I, T, D = (f"WITH {x} " for x in (bridge.CLOUD, bridge.IMU, bridge.TRAJECTORY, bridge.DESCRIPTORS))
DEG = "0.017453292519943295::DOUBLE"


@query("agg12_trial_summary", f"""WITH t AS (SELECT l_returnflag AS axis, l_linestatus AS direction, CASE WHEN l_linenumber <> 3 THEN l_quantity - 20 END AS rate FROM lineitem)
  SELECT axis, direction, count(*) AS n, median(rate) AS median_rate, CASE WHEN median(rate) > 0 THEN round(1 / median(rate), 6) ELSE 0 END AS seconds_per_unit FROM t GROUP BY axis, direction""")
def agg12(spark, d):
    rate = F.when(F.col("l_linenumber") != 3, F.col("l_quantity") - 20)
    trials = bridge.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("axis"), F.col("l_linestatus").alias("direction"), rate.alias("rate"))
    return rounded(reports.trial_summary(trials, ("axis", "direction"), "rate"), "seconds_per_unit")


@query("agg13_median_shift", I + "SELECT sensor_id, CASE WHEN count(*) >= 8 THEN round(median(gx), 6) + 0.0::DOUBLE END AS dx, CASE WHEN count(*) >= 8 THEN round(median(gy), 6) + 0.0::DOUBLE END AS dy, CASE WHEN count(*) >= 8 THEN round(sqrt(median(gx)*median(gx) + median(gy)*median(gy)), 6) END AS size FROM imu GROUP BY sensor_id")
def agg13(spark, d):
    tracks = bridge.imu(spark, d).select("sensor_id", F.col("gx").alias("dx"), F.col("gy").alias("dy"))
    return rounded(reports.median_shift(tracks, ("sensor_id",)), "dx", "dy", "size")


@query("agg14_most_common", I + ", c AS (SELECT sensor_id, kind, count(*) AS n, min(seq) AS f FROM imu GROUP BY sensor_id, kind), r AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY n DESC, f)::INT AS rank FROM c) SELECT sensor_id, kind, n, rank FROM r WHERE rank <= 2")
def agg14(spark, d):
    return reports.most_common(bridge.imu(spark, d), ("sensor_id",), "kind", "seq", 2)


@query("agg15_gap_histogram", I + """, g AS (SELECT sensor_id, seq AS position, lead(seq) OVER (PARTITION BY sensor_id ORDER BY seq) - seq AS gap FROM imu), c AS (SELECT sensor_id, gap, count(*) AS n, min(position) AS f FROM g WHERE gap IS NOT NULL GROUP BY sensor_id, gap),
  r AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY n DESC, f)::INT AS rank FROM c) SELECT sensor_id, gap, n, rank FROM r WHERE rank <= 6""")
def agg15(spark, d):
    return serial.gap_histogram(bridge.imu(spark, d).select("sensor_id", F.col("seq").alias("position")), ("sensor_id",))


@query("agg16_capture_stats", I + """, e AS (SELECT i.sensor_id, i.t, e.props || 'é' AS data FROM imu i JOIN events e ON e.event_id = i.seq) SELECT sensor_id, count(*) AS chunks, sum(octet_length(encode(data)))::BIGINT AS bytes,
  round(sum(octet_length(encode(data)) - 2) / sum(octet_length(encode(data))), 6) AS printable, CASE WHEN max(t) > min(t) THEN round(sum(octet_length(encode(data))) / (max(t) - min(t)), 3) ELSE 0 END AS bytes_per_second FROM e GROUP BY sensor_id""")
def agg16(spark, d):
    data = bridge.table(spark, d, "events").select(F.col("event_id").alias("seq"), F.concat("props", F.lit("é")).alias("data"))
    out = reports.capture_stats(bridge.imu(spark, d).join(data, "seq"), ("sensor_id",), "data", "t")
    return rounded(out, "printable").withColumn("bytes_per_second", F.round("bytes_per_second", 3))


@query("agg17_best_probe", """WITH p AS (SELECT c_nationkey AS port, c_custkey AS baud, c_custkey * 7 % 5 AS responses, c_custkey % 3 <> 0 AS opened FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY port ORDER BY responses DESC, baud) AS k FROM p WHERE opened AND responses > 0)
  SELECT port, baud, responses FROM r WHERE k = 1""")
def agg17(spark, d):
    k = F.col("c_custkey")
    probes = bridge.table(spark, d, "customer").select(F.col("c_nationkey").alias("port"), k.alias("baud"), (k * 7 % 5).alias("responses"), (k % 3 != 0).alias("opened"))
    return reports.best_probe(probes, ("port",), "responses", "opened", "baud").select("port", "baud", "responses")


NEAR = C + """, t AS (SELECT scan_id, point_id AS other, x + 0.3::DOUBLE AS x, y - 0.2::DOUBLE AS y, z AS z FROM cloud),
  n AS (SELECT a.scan_id, a.point_id, t.other, sqrt((a.x-t.x)*(a.x-t.x) + (a.y-t.y)*(a.y-t.y) + (a.z-t.z)*(a.z-t.z)) AS d FROM cloud a JOIN t ON a.scan_id = t.scan_id), b AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d, other) AS k FROM n WHERE d <= 2) """


def correspondences(spark, d):
    cloud = bridge.cloud(spark, d)
    targets = cloud.select("scan_id", F.col("point_id").alias("other"), (F.col("x") + 0.3).alias("tx"), (F.col("y") - 0.2).alias("ty"), F.col("z").alias("tz"))
    return cloud, clouds.nearest_within(cloud, targets, 2.0, by=("scan_id",))


@query("join10_correspondence", NEAR + "SELECT point_id, other, round(d, 6) AS distance FROM b WHERE k = 1")
def join10(spark, d):
    return rounded(correspondences(spark, d)[1].select("point_id", "other", "distance"), "distance")


@query("agg21_registration_scores", NEAR + "SELECT c.scan_id, round(avg((b.d IS NOT NULL AND b.d <= 1)::INT), 6) AS fitness, round(sqrt(avg(CASE WHEN b.d <= 1 THEN b.d * b.d END)), 6) AS rmse FROM cloud c LEFT JOIN b ON b.point_id = c.point_id AND b.k = 1 GROUP BY c.scan_id")
def agg21(spark, d):
    cloud, near = correspondences(spark, d)
    pairs = cloud.select("scan_id", "point_id").join(near.select("point_id", "distance"), "point_id", "left")
    return rounded(reports.registration_scores(pairs, ("scan_id",), "distance", 1.0), "fitness", "rmse")


@query("join05_visual_candidates", D + """, p AS (SELECT a.frame AS query, b.frame AS match, a.id, b.id AS train, bit_count(xor(a.b0, b.b0)) + bit_count(xor(a.b1, b.b1)) AS h FROM descriptors a JOIN descriptors b ON b.frame <= a.frame - 3),
  k AS (SELECT *, row_number() OVER (PARTITION BY id, match ORDER BY h, train) AS r, lead(h) OVER (PARTITION BY id, match ORDER BY h, train) AS second FROM p)
  SELECT query, match, count(*) AS n FROM k WHERE r = 1 AND h < 0.9 * second GROUP BY query, match HAVING count(*) >= 5""")
def join05(spark, d):
    rows = bridge.descriptors(spark, d)
    return align.visual_candidates(rows, ("b0", "b1"), recent=3, least=5, ratio=0.9)


PIXELS = """, px AS (SELECT r.range AS row, c.range AS col, (r.range * 7 + c.range * 3) % 256 AS b FROM range(120) r, range(160) c), uv AS (SELECT point_id, 80 + x * 4 AS u, 60 + y * 4 AS v FROM cloud) """


def image(spark, d):
    pixels = spark.range(120 * 160).select((F.col("id") / 160).cast("int").alias("row"), (F.col("id") % 160).cast("int").alias("col"))
    pixels = pixels.withColumn("b", (F.col("row") * 7 + F.col("col") * 3) % 256)
    return bridge.cloud(spark, d).select("point_id", (80 + F.col("x") * 4).alias("u"), (60 + F.col("y") * 4).alias("v")), pixels


@query("join08_pixel_nearest", C + PIXELS + "SELECT point_id, b::INT AS b FROM uv JOIN px ON px.row = least(119, greatest(0, round_even(v, 0))) AND px.col = least(159, greatest(0, round_even(u, 0))) WHERE u >= 0 AND u < 160 AND v >= 0 AND v < 120")
def join08(spark, d):
    return align.lookup_pixels(*image(spark, d), 160, 120, ("b",)).select("point_id", F.col("b").cast("int").alias("b"))


@query("join08_pixel_bilinear", C + PIXELS + """, k AS (SELECT point_id, least(u, 158.9999::DOUBLE) AS u, least(v, 118.9999::DOUBLE) AS v FROM uv WHERE u >= 0 AND u < 160 AND v >= 0 AND v < 120)
  SELECT point_id, trunc(round(sum(b * (CASE WHEN px.row = floor(v) THEN 1 - (v - floor(v)) ELSE v - floor(v) END) * (CASE WHEN px.col = floor(u) THEN 1 - (u - floor(u)) ELSE u - floor(u) END)), 6))::INT AS b FROM k JOIN px ON px.row BETWEEN floor(v) AND floor(v) + 1 AND px.col BETWEEN floor(u) AND floor(u) + 1 GROUP BY point_id""")
def join08b(spark, d):
    return align.lookup_pixels(*image(spark, d), 160, 120, ("b",), bilinear=True).select("point_id", "b")


@query("join09_synchronised", I + ", a AS (SELECT sensor_id, seq, t FROM imu WHERE kind = 'click'), b AS (SELECT sensor_id, min(seq) AS seq, t FROM imu WHERE kind = 'view' GROUP BY sensor_id, t), n AS (SELECT a.sensor_id, a.seq, b.seq AS other, abs(a.t - b.t) AS gap, row_number() OVER (PARTITION BY a.seq ORDER BY abs(a.t - b.t), b.t) AS k FROM a JOIN b ON a.sensor_id = b.sensor_id) SELECT sensor_id, seq, other FROM n WHERE k = 1 AND gap <= 0.3")
def join09(spark, d):
    rows = bridge.imu(spark, d)
    a = rows.where("kind = 'click'").select("sensor_id", "seq", "t")
    b = rows.where("kind = 'view'").groupBy("sensor_id", "t").agg(F.min("seq").alias("seq"))
    return align.synchronised([a, b], ("sensor_id",), tolerance=0.3, bucket=5.0).select("sensor_id", "seq", F.col("s1_seq").alias("other"))


@query("join14_exact_time", I + ", y AS (SELECT seq AS t, yaw FROM imu WHERE seq % 2 = 0), g AS (SELECT seq AS t, gz FROM imu WHERE seq % 3 = 0) SELECT y.t, round(yaw, 6) + 0.0::DOUBLE AS yaw, round(gz, 6) + 0.0::DOUBLE AS gz FROM y LEFT JOIN g ON y.t = g.t")
def join14(spark, d):
    rows = bridge.imu(spark, d)
    y = rows.where("seq % 2 = 0").select(F.col("seq").alias("t"), "yaw")
    return rounded(y.join(rows.where("seq % 3 = 0").select(F.col("seq").alias("t"), "gz"), "t", "left"), "yaw", "gz")


@query("win12_lidar_keyframes", "WITH RECURSIVE " + bridge.TRAJECTORY + """, k AS (SELECT sensor_id, seq, x, y, z, yaw, row_number() OVER (PARTITION BY sensor_id ORDER BY t, seq) AS i FROM trajectory),
  f AS (SELECT sensor_id, i, seq, x, y, z, yaw, true AS picked FROM k WHERE i = 1 UNION ALL
    SELECT k.sensor_id, k.i, CASE WHEN p THEN k.seq ELSE f.seq END, CASE WHEN p THEN k.x ELSE f.x END, CASE WHEN p THEN k.y ELSE f.y END, CASE WHEN p THEN k.z ELSE f.z END, CASE WHEN p THEN k.yaw ELSE f.yaw END, p
    FROM f JOIN (SELECT * FROM k) k ON k.sensor_id = f.sensor_id AND k.i = f.i + 1, LATERAL (SELECT sqrt((k.x-f.x)*(k.x-f.x) + (k.y-f.y)*(k.y-f.y) + (k.z-f.z)*(k.z-f.z)) >= 2 OR least(abs(k.yaw - f.yaw), 360 - abs(k.yaw - f.yaw)) >= 90 AS p))
  SELECT sensor_id, seq FROM f WHERE picked""")
def win12(spark, d):
    return folds.keyframes(bridge.trajectory(spark, d), ("sensor_id",), ("t", "seq"), distance=2.0, angle=90.0, carry=("seq",)).select("sensor_id", "seq")


@query("win16_delta_rotation", I + f", k AS (SELECT seq, radians(yaw - lag(yaw) OVER (PARTITION BY sensor_id ORDER BY t, seq)) AS a FROM imu) SELECT seq, {sql_round('cos(a) AS r00', 'sin(a) AS r10')} FROM k")
def win16(spark, d):
    q = g.quaternion_from_euler(0, 0, "yaw")
    rows = bridge.imu(spark, d).withColumns(dict(zip(("qw", "qx", "qy", "qz"), q)))
    return rounded(ordered.delta_rotation(rows, ("sensor_id",), ("t", "seq")).select("seq", "r00", "r10"), "r00", "r10")


@query("join15_odometry", T + f", k AS (SELECT seq, radians(yaw) AS a, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM trajectory WINDOW w AS (PARTITION BY sensor_id ORDER BY t, seq)) SELECT seq, {sql_round('cos(a)*dx + sin(a)*dy AS fx', '-sin(a)*dx + cos(a)*dy AS fy')} FROM k WHERE dx IS NOT NULL")
def join15(spark, d):
    pose = g.Pose.from_euler(0, 0, "yaw", "x", "y", "z").struct()
    steps = ordered.odometry(bridge.trajectory(spark, d).withColumn("pose", pose), ("sensor_id",), ("t", "seq"))
    return rounded(steps.select("seq", F.col("step.tx").alias("fx"), F.col("step.ty").alias("fy")), "fx", "fy")


@query("win21_world_accumulation", C + f""", i AS (SELECT event_id AS t, value * 7.3::DOUBLE % 360 - 180 AS yaw FROM events), s AS (SELECT DISTINCT scan_id, scan_id * 7 + 0.25::DOUBLE AS t FROM cloud),
  n AS (SELECT s.scan_id, i.yaw, row_number() OVER (PARTITION BY s.scan_id ORDER BY abs(i.t - s.t), i.t) AS k FROM s CROSS JOIN i), m AS (SELECT c.*, radians(n.yaw) AS a FROM cloud c JOIN n ON n.scan_id = c.scan_id AND n.k = 1)
  SELECT point_id, {sql_round('cos(a)*x - sin(a)*y AS wx', 'sin(a)*x + cos(a)*y AS wy', 'z AS wz')} FROM m""")
def win21(spark, d):
    imu = bridge.imu(spark, d).select(F.col("seq").cast("double").alias("t"), *(v.alias(n) for v, n in zip(g.quaternion_from_euler(0, 0, "yaw"), ("qw", "qx", "qy", "qz"))))
    scans = bridge.cloud(spark, d).select("scan_id").distinct().withColumn("t", F.col("scan_id") * 7 + 0.25)
    world = ordered.accumulate_world(bridge.cloud(spark, d), align.asof_nearest(scans, imu, prefix="", bucket=1000.0), "scan_id")
    return named_points(world)


def named_points(df):
    return df.select("point_id", r6("wx").alias("wx"), r6("wy").alias("wy"), r6("wz").alias("wz"))


@query("fn08_slerp", I + f""", q AS (SELECT seq, cos(radians(yaw)) AS w, sin(radians(yaw)) AS z FROM imu), h AS (SELECT *, abs(w) AS d, acos(least(1, abs(w))) AS a, CASE WHEN w < 0 THEN -1 ELSE 1 END AS s FROM q),
  k AS (SELECT seq, w, z, CASE WHEN d > 0.9995 THEN 0.7::DOUBLE ELSE sin(0.7::DOUBLE * a) / sin(a) END AS u, s * CASE WHEN d > 0.9995 THEN 0.3::DOUBLE ELSE sin(0.3::DOUBLE * a) / sin(a) END AS v FROM h),
  m AS (SELECT seq, u + v * w AS w, v * z AS z FROM k) SELECT seq, {sql_round('w / sqrt(w*w + z*z) AS w', 'z / sqrt(w*w + z*z) AS z')} FROM m""")
def fn08(spark, d):
    """Turns of up to a whole circle to either side, so that all branches are taken."""
    rows = bridge.imu(spark, d).select("seq", *(v.alias(n) for n, v in zip("wxyz", g.quaternion_from_euler(0, 0, F.col("yaw") * 2))))
    q = g.slerp(g.cols(1, 0, 0, 0), tuple(F.col(c) for c in "wxyz"), 0.3)
    return rows.select("seq", r6(q[0]).alias("w"), r6(q[3]).alias("z"))


@query("fn16_axis_angle", I + f", a AS (SELECT seq, CASE WHEN abs(radians(yaw)) > pi() - 1e-6 THEN abs(radians(yaw)) WHEN abs(radians(yaw)) < 1e-9 THEN 0 ELSE radians(yaw) END AS rz FROM imu) SELECT seq, {sql_round('rz')} FROM a")
def fn16(spark, d):
    return bridge.imu(spark, d).select("seq", r6(g.axis_angle(g.rotation_from_euler(0, 0, "yaw"))[2]).alias("rz"))


@query("fn22_four_dof", I + f"SELECT seq, {sql_round('ax AS x', 'radians(yaw) AS yaw')} FROM imu")
def fn22(spark, d):
    x, _, _, yaw = g.Pose.from_4dof("ax", "ay", "az", F.radians("yaw")).to_4dof()
    return bridge.imu(spark, d).select("seq", r6(x).alias("x"), r6(yaw).alias("yaw"))


@query("fn26_back_project", C + f"SELECT point_id, {sql_round('x', 'y')} FROM cloud")
def fn26(spark, d):
    camera = g.Intrinsics(500.0, 480.0, 320.0, 240.0, 640, 480)
    z = F.col("z") + 15
    u, v, _ = g.project("x", "y", z, camera)
    x, y, _ = g.back_project(u, v, z, camera)
    return bridge.cloud(spark, d).select("point_id", r6(x).alias("x"), r6(y).alias("y"))


@query("fn29_intensity_colour", C + f"SELECT point_id, {sql_round('intensity / 255 AS r', '1 - intensity / 255 AS g')}, 0.8::DOUBLE AS b FROM cloud")
def fn29(spark, d):
    r, gr, b = g.intensity_colour("intensity")
    return bridge.cloud(spark, d).select("point_id", r6(r).alias("r"), r6(gr).alias("g"), b.alias("b"))


@query("fn31_checksum", "SELECT event_id, (list_sum(list_transform(string_split(event_type || props, ''), lambda c: ascii(c))) % 256)::INT AS checksum FROM events")
def fn31(spark, d):
    data = F.encode(F.concat("event_type", "props"), "utf-8")
    return bridge.table(spark, d, "events").select("event_id", binary.checksum(data).cast("int").alias("checksum"))


@query("fn33_crc8", """WITH RECURSIVE s AS (SELECT DISTINCT event_type AS s FROM events), c AS (SELECT s, 0 AS i, 0 AS crc FROM s UNION ALL
  SELECT s, i + 1, list_reduce([xor(crc, ascii(substr(s, i + 1, 1)))::INT, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a >= 128 THEN xor((a * 2) & 255, 7) ELSE a * 2 END) FROM c WHERE i < length(s))
  SELECT e.event_id, c.crc::INT AS crc FROM events e JOIN c ON c.s = e.event_type AND c.i = length(e.event_type)""")
def fn33(spark, d):
    return bridge.table(spark, d, "events").select("event_id", binary.crc8(F.encode("event_type", "utf-8")).alias("crc"))


@query("fn34_previews", "SELECT event_id, trim(regexp_replace(hex(encode(event_type || chr(9))), '(..)', '\\1 ', 'g')) AS hex, event_type || '.' AS text FROM events")
def fn34(spark, d):
    data = F.encode(F.concat("event_type", F.lit("\t")), "utf-8")
    return bridge.table(spark, d, "events").select("event_id", binary.hex_preview(data).alias("hex"), binary.ascii_preview(data).alias("text"))


@query("fn35_marker_positions", "SELECT event_id, i AS position FROM (SELECT event_id, event_type AS s, unnest(range(0, length(event_type)))::INT AS i FROM events) WHERE substr(s, i + 1, 1) = 'r'")
def fn35(spark, d):
    at = binary.marker_positions(F.encode("event_type", "utf-8"), b"r")
    return bridge.table(spark, d, "events").select("event_id", F.explode(at).alias("position"))


@query("fn36_terminator", "SELECT c_custkey, regexp_matches(c, '^:[GVF]') OR c = ':MountInfo#' AS ends FROM (SELECT c_custkey, [':GLS#', ':MountInfo#', ':mn#', 'V', ':V#'][c_custkey % 5 + 1] AS c FROM customer)")
def fn36(spark, d):
    c = F.get(F.array(*(F.lit(x) for x in (":GLS#", ":MountInfo#", ":mn#", "V", ":V#"))), (F.col("c_custkey") % 5).cast("int"))
    return bridge.table(spark, d, "customer").select("c_custkey", serial.expects_terminator(c).alias("ends"))


@query("src06_carry_forward", """WITH f AS (SELECT user_id, event_id, event_id % 3 AS kind, (event_id * 131 % 65536 - 32768)::DOUBLE AS v FROM events),
  w AS (SELECT *, coalesce(last_value(CASE WHEN kind = 0 THEN v * (16 * 9.81::DOUBLE / 32768) END IGNORE NULLS) OVER p, 0) AS ax, coalesce(last_value(CASE WHEN kind = 1 THEN v * (2000 * pi() / 180 / 32768) END IGNORE NULLS) OVER p, 0) AS gx FROM f WINDOW p AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
  SELECT user_id, event_id AS position, round(ax, 6) + 0.0::DOUBLE AS ax, round(gx, 6) + 0.0::DOUBLE AS gx, round(v * 180 / 32768, 6) + 0.0::DOUBLE AS roll FROM w WHERE kind = 2""")
def src06(spark, d):
    v = F.pmod(F.col("event_id") * 131, F.lit(65536)) - 32768
    raw = F.lpad(F.hex(F.pmod(v, F.lit(65536))), 4, "0")
    body = F.unhex(F.concat(F.substring(raw, 3, 2), F.substring(raw, 1, 2), F.lit("000000000000")))
    frames = bridge.table(spark, d, "events").select("user_id", F.col("event_id").alias("position"), (F.col("event_id") % 3 + 0x51).alias("kind"), body.alias("body"))
    return rounded(serial.witmotion_readings(frames, ("user_id",)).select("user_id", "position", "ax", "gx", "roll"), "ax", "gx", "roll")


@query("src09_mpu9250", f"""SELECT event_id, round((event_id % 65536 - CASE WHEN event_id % 65536 > 32767 THEN 65536 ELSE 0 END) * 9.80665::DOUBLE / 16384, 6) + 0.0::DOUBLE AS ax, 21.0::DOUBLE AS temp_c,
  round((event_id * 7 % 65536 - CASE WHEN event_id * 7 % 65536 > 32767 THEN 65536 ELSE 0 END) * pi() / 180 / 131, 6) + 0.0::DOUBLE AS gz FROM events""")
def src09(spark, d):
    word = lambda v: F.lpad(F.hex(F.pmod(v, F.lit(65536))), 4, "0")
    data = F.unhex(F.concat(word(F.col("event_id")), F.lit("0000" * 5), word(F.col("event_id") * 7)))
    return rounded(serial.mpu9250(bridge.table(spark, d, "events").select("event_id", data.alias("data"))).select("event_id", "ax", "temp_c", "gz"), "ax", "gz")


@query("src11_bno055", "SELECT event_id, event_id / 100.0::DOUBLE AS ax, event_id / 900.0::DOUBLE AS gx, event_id / 16384.0::DOUBLE AS qw FROM events")
def src11(spark, d):
    rows = bridge.table(spark, d, "events")
    raw = [F.col("event_id").alias(f"r_{a}{c}") for a in "agm" for c in "xyz"] + [F.col("event_id").alias(f"r_q{c}") for c in "wxyz"]
    return serial.bno055(rows.select("event_id", *raw)).select("event_id", "ax", "gx", "qw")


@query("src02_recordings", """SELECT 's/' || (l_suppkey % 5) AS sensor, round(l_orderkey + l_linenumber / 10.0::DOUBLE, 6) AS ts, md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_returnflag)) AS payload,
  count(*) OVER (PARTITION BY l_suppkey % 5) AS of_sensor FROM lineitem""")
def src02(spark, d):
    """A recording of each sensor is written, of packets made of whole rows, and read back by ranges of a megabyte."""
    rows = bridge.table(spark, d, "lineitem")
    body = F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag").cast("binary")
    rows = rows.select(F.concat(F.lit("s/"), F.col("l_suppkey") % 5).alias("sensor_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("packet_id"), (F.col("l_orderkey") + F.col("l_linenumber") / 10.0).alias("ts"), body.alias("payload"))
    folder = scratch_path(spark, "recordings")
    written = writers.write_recordings(rows, folder).select(F.regexp_extract("file", "(.*)[.]vlp16", 1).alias("name"), F.col("rows").alias("of_sensor"))
    read = recordings.read_recordings(spark, folder, 1 << 20).withColumn("name", F.regexp_extract("file", "([^/]+)[.]vlp16$", 1))
    return rounded(read.join(written, "name").select(F.url_decode("name").alias("sensor"), "ts", F.md5("payload").alias("payload"), "of_sensor"), "ts")


@query("src25_room", """WITH r AS (SELECT event_id, (event_id % 16)::INT AS channel, radians((event_id * 37 % 3600) / 10.0::DOUBLE) AS az FROM events),
  e AS (SELECT *, radians(CASE WHEN channel % 2 = 0 THEN channel - 15 ELSE channel END) AS el FROM r),
  v AS (SELECT *, cos(el) * sin(az) AS x, cos(el) * cos(az) AS y, sin(el) AS z FROM e),
  h AS (SELECT *, least(CASE WHEN abs(x) > 1e-9 AND -4 / x > 0 THEN -4 / x END, CASE WHEN abs(x) > 1e-9 AND 5 / x > 0 THEN 5 / x END, CASE WHEN abs(y) > 1e-9 AND -3 / y > 0 THEN -3 / y END, CASE WHEN abs(y) > 1e-9 AND 6 / y > 0 THEN 6 / y END,
    CASE WHEN abs(z) > 1e-9 AND -1 / z > 0 THEN -1 / z END, CASE WHEN abs(z) > 1e-9 AND 2 / z > 0 THEN 2 / z END) AS d FROM v)
  SELECT event_id, channel, round(CASE WHEN d < 100 THEN d ELSE 0 END, 6) AS distance_m FROM h""")
def src25(spark, d):
    rays = bridge.table(spark, d, "events").select("event_id", (F.col("event_id") % 16).cast("int").alias("channel"), (F.col("event_id") * 37 % 3600 / 10.0).alias("azimuth_deg"))
    return rounded(packets.distance_to_walls(rays, (-4, 5, -3, 6, 0, 3), (0, 0, 1)).select("event_id", "channel", "distance_m"), "distance_m")


@query("snk05_pose_json", T + f"""SELECT seq, {sql_round('x', 'y', 'z')}, round(s * cos(radians(yaw) / 2), 6) + 0.0::DOUBLE AS qw, round(s * sin(radians(yaw) / 2), 6) + 0.0::DOUBLE AS qz, round(yaw, 6) + 0.0::DOUBLE AS yaw
  FROM (SELECT *, CASE WHEN yaw <= -120 THEN -1 ELSE 1 END AS s FROM trajectory)""")
def snk05(spark, d):
    """The JSON objects, read back."""
    pose = reports.pose_json(g.Pose.from_euler(0, 0, "yaw", "x", "y", "z"))
    kind = "struct<position:struct<x:double,y:double,z:double>,quaternion:struct<w:double,x:double,y:double,z:double>,euler_deg:struct<roll:double,pitch:double,yaw:double>>"
    rows = bridge.trajectory(spark, d).select("seq", F.from_json(pose, kind).alias("p"))
    return rows.select("seq", "p.position.*", F.col("p.quaternion.w").alias("qw"), F.col("p.quaternion.z").alias("qz"), "p.euler_deg.yaw")


@query("snk18_preview", C + f""", s AS (SELECT *, min(x) OVER w AS lx, max(x) OVER w AS hx, min(y) OVER w AS ly, max(y) OVER w AS hy FROM cloud WINDOW w AS (PARTITION BY scan_id)), f AS (SELECT point_id, x, y, lx, ly, least(312 / (hx - lx), 232 / (hy - ly)) AS k FROM s)
  SELECT point_id, {sql_round('4 + (x - lx) * k AS px', '236 - (y - ly) * k AS py')} FROM f""")
def snk18(spark, d):
    return rounded(reports.fit_to_canvas(bridge.cloud(spark, d), 320, 240, ("scan_id",)).select("point_id", "px", "py"), "px", "py")


@query("set01_map_merge", C + f", w AS (SELECT point_id, x + 1 AS x, y, z FROM cloud WHERE scan_id = 0 UNION ALL SELECT point_id, x, y + 2, z FROM cloud WHERE scan_id <> 0) SELECT point_id, {sql_round('x', 'y', 'z')} FROM w")
def set01(spark, d):
    rows = bridge.cloud(spark, d)
    move = lambda df, x, y: df.select("point_id", *(v.alias(c) for c, v in zip("xyz", g.Pose.from_euler(x=x, y=y).apply("x", "y", "z"))))
    return rounded(move(rows.where("scan_id = 0"), 1, 0).unionByName(move(rows.where("scan_id <> 0"), 0, 2)), "x", "y", "z")


@query("agg22_statistics", T + "SELECT count(*) AS poses, count(DISTINCT sensor_id) AS sensors, round(max(t) - min(t), 6) AS elapsed FROM trajectory")
def agg22(spark, d):
    return rounded(bridge.trajectory(spark, d).agg(F.count("*").alias("poses"), F.countDistinct("sensor_id").alias("sensors"), (F.max("t") - F.min("t")).alias("elapsed")), "elapsed")


@query("fit05_long_path", T + f""", n AS (SELECT *, row_number() OVER (ORDER BY t, seq) AS id FROM trajectory), s AS (SELECT *, coalesce(sum(gx) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS e FROM n)
  SELECT id, {", ".join(f"round({c} + e, 4) + 0.0::DOUBLE AS {c}" for c in ("x", "y", "z", "yaw"))} FROM s""")
def fit05_long(spark, d):
    """All rows as one path in order of time, with a loop over every hundredth pose that agrees with the steps between: the fit is their sum."""
    from pointloom.operators import fit

    step = F.col("gx").cast("decimal(8,3)")  # fortieths, so that sums are exact
    path = scans.running(bridge.trajectory(spark, d).select("t", "seq", "gx", *fit.DOF), [F.col("t"), F.col("seq")], {"up_to": step}, "path-in-order")
    path = durable.materialise(path.withColumnRenamed("position", "id"), "path")
    off = (F.col("up_to") - step).cast("double")
    ends = path.select(F.col("id").alias("to"), *(F.col(c).alias(f"to_{c}") for c in fit.DOF), off.alias("to_off"))

    def factors(rows, ahead, weight):
        both = rows.join(ends, F.col("id") + ahead == F.col("to"))
        return both.select(F.col("id").alias("a"), F.col("to").alias("b"), *((F.col(f"to_{c}") - F.col(c) + (F.col("to_off") - off)).alias(c) for c in fit.DOF), F.lit(weight).alias("weight"))

    links = durable.materialise(factors(path, 1, 1.0).unionByName(factors(path.where("id % 100 = 0"), 1000, 5.0)), "path-links")
    poses = fit.optimise(path.select("id", *fit.DOF), links, small=2000, tolerance=1e-13)
    return poses.select("id", *((F.round(c, 4) + 0.0).alias(c) for c in fit.DOF))


@query("fit05_pose_graph", T + f""", s AS (SELECT *, coalesce(sum(gx) OVER (PARTITION BY sensor_id ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM trajectory),
  f AS (SELECT *, off - arg_min(off, seq) OVER (PARTITION BY sensor_id) AS e FROM s) SELECT seq AS id, {sql_round('x + e AS x', 'y + e AS y', 'z + e AS z', 'yaw + e AS yaw')} FROM f""")
def fit05(spark, d):
    """Each sensor's steps, each a little off, make a chain: the fit is the sum of its steps from the fixed pose on."""
    from pointloom.operators import fit

    w = Window.partitionBy("sensor_id").orderBy("t", "seq")
    path = bridge.trajectory(spark, d)
    poses = path.select("sensor_id", F.col("seq").alias("id"), "x", "y", "z", "yaw")
    steps = path.select(F.col("seq").alias("a"), F.lead("seq").over(w).alias("b"), *((F.lead(c).over(w) - F.col(c) + F.col("gx")).alias(c) for c in fit.DOF), F.lit(1.0).alias("weight")).where("b is not null")
    return rounded(fit.optimise(poses, steps, by="sensor_id"), *fit.DOF)
