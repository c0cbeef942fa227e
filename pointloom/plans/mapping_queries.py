"""Named queries of mapping, calibration and the mount's bus."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pointloom.functions import geometry as g, text
from pointloom.functions.binary import crc8
from pointloom.operators import align, cloud as clouds, fit, mapping, ordered, reports, scans, vision
from pointloom.plans import bridge
from pointloom.plans.base import query, r6, rounded, sql_round
from pointloom.sources import serial
from pointloom.sources.calibration import Calibration

C, I, T = (f"WITH {x} " for x in (bridge.CLOUD, bridge.IMU, bridge.TRAJECTORY))

# --- poses --------------------------------------------------------------------------------------------------------


@query("win15_pose_chain", I + f""", a AS (SELECT *, radians(sum(gz * 20) OVER w) AS h, radians(sum(gz * 20) OVER w - gz * 20) AS b FROM imu WINDOW w AS (PARTITION BY sensor_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING)),
  p AS (SELECT seq, h, sum(cos(b)*(1 + gx) - sin(b)*gy) OVER w AS x, sum(sin(b)*(1 + gx) + cos(b)*gy) OVER w AS y, sum(az - 9.8::DOUBLE) OVER w AS z FROM a WINDOW w AS (PARTITION BY sensor_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING))
  SELECT seq, {sql_round('x', 'y', 'z', 'cos(h) AS r00', 'sin(h) AS r10')} FROM p""")
def win15(spark, d):
    step = g.Pose.from_euler(0, 0, F.col("gz") * 20, 1 + F.col("gx"), "gy", F.col("az") - 9.8).struct()
    out = mapping.chain(bridge.imu(spark, d).withColumn("step", step), ("sensor_id",), ("t", "seq"), ("seq",))
    return out.select("seq", *(r6(f"pose.t{c}").alias(c) for c in "xyz"), r6("pose.r00").alias("r00"), r6("pose.r10").alias("r10"))


@query("win15_long_session", I + f""", a AS (SELECT *, radians(sum(gz * 20) OVER w) AS h, radians(sum(gz * 20) OVER w - gz * 20) AS b FROM imu WINDOW w AS (ORDER BY t, seq ROWS UNBOUNDED PRECEDING)),
  p AS (SELECT seq, h, sum(cos(b)*(1 + gx) - sin(b)*gy) OVER w AS x, sum(sin(b)*(1 + gx) + cos(b)*gy) OVER w AS y, sum(az - 9.8::DOUBLE) OVER w AS z FROM a WINDOW w AS (ORDER BY t, seq ROWS UNBOUNDED PRECEDING))
  SELECT seq, {", ".join(f"round({v}, 4) + 0.0::DOUBLE AS {c}" for v, c in (("x", "x"), ("y", "y"), ("z", "z"), ("cos(h)", "r00"), ("sin(h)", "r10")))} FROM p""")
def win15_long(spark, d):
    """All rows as one path."""
    step = g.Pose.from_euler(0, 0, F.col("gz") * 20, 1 + F.col("gx"), "gy", F.col("az") - 9.8)
    rows = bridge.imu(spark, d).select("t", "seq", *(v.alias(c) for c, v in zip(scans.POSE, (*step.r, *step.t))))
    out = scans.pose_chain(rows, (), ("t", "seq"), ("seq",))
    return out.select("seq", *((F.round(v, 4) + 0.0).alias(c) for v, c in (("tx", "x"), ("ty", "y"), ("tz", "z"), ("r00", "r00"), ("r10", "r10"))))


@query("join11_correct_poses", T + f""", n AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY t, seq) AS idx FROM trajectory), k AS (SELECT sensor_id, idx, x, y, z, yaw FROM n WHERE idx % 10 = 4),
  m AS (SELECT n.*, coalesce((SELECT max(idx) FROM k WHERE k.sensor_id = n.sensor_id AND k.idx <= n.idx), (SELECT min(idx) FROM k WHERE k.sensor_id = n.sensor_id)) AS ki FROM n),
  b AS (SELECT m.seq, m.x - k.x AS dx, m.y - k.y AS dy, m.z - k.z AS dz, m.yaw, k.x AS kx, k.y AS ky, k.z AS kz FROM m JOIN k ON k.sensor_id = m.sensor_id AND k.idx = m.ki)
  SELECT seq, {sql_round('kx + 1 + cos(radians(15))*dx - sin(radians(15))*dy AS x', 'ky - 2 + sin(radians(15))*dx + cos(radians(15))*dy AS y', 'kz + 0.5::DOUBLE + dz AS z', 'cos(radians(yaw + 15)) AS r00')} FROM b""")
def join11(spark, d):
    w = Window.partitionBy("sensor_id").orderBy("t", "seq")
    pose = g.Pose.from_euler(0, 0, "yaw", "x", "y", "z")
    rows = bridge.trajectory(spark, d).withColumn("idx", F.row_number().over(w)).withColumn("pose", pose.struct())
    # each keyframe is turned by 15 degrees where it is, and moved
    corrected = g.Pose.from_euler(0, 0, F.col("yaw") + 15, F.col("x") + 1, F.col("y") - 2, F.col("z") + 0.5)
    keys = rows.where("idx % 10 = 4").select("sensor_id", "idx", "pose", corrected.struct().alias("corrected"))
    out = mapping.apply_corrections(rows.select("sensor_id", "seq", "idx", "pose"), keys, ("sensor_id",), bucket=1000.0).where("corrected is not null")
    return out.select("seq", *(r6(f"corrected.t{c}").alias(c) for c in "xyz"), r6("corrected.r00").alias("r00"))


@query("fn07_pose_in_time", I + f""", k AS (SELECT *, row_number() OVER w AS i, lead(t) OVER w AS t1, lead(gx) OVER w AS gx1, lead(yaw) OVER w AS yaw1 FROM imu WINDOW w AS (PARTITION BY sensor_id ORDER BY t, seq)),
  p AS (SELECT seq, gx, gx1, (seq % 7) / 4.0::DOUBLE - 0.25::DOUBLE AS a, radians(yaw / 3) AS y0, radians(yaw1 / 3) AS y1 FROM k WHERE t1 > t), q AS (SELECT *, least(1, greatest(0, a)) AS c FROM p),
  r AS (SELECT *, CASE WHEN cos((y1 - y0) / 2) > 0.9995::DOUBLE THEN 2 * atan2((1 - c) * sin(y0 / 2) + c * sin(y1 / 2), (1 - c) * cos(y0 / 2) + c * cos(y1 / 2)) ELSE y0 + c * (y1 - y0) END AS h FROM q)
  SELECT seq, {sql_round('gx + a * (gx1 - gx) AS x', 'cos(h) AS r00', 'sin(h) AS r10')} FROM r""")
def fn07(spark, d):
    """Between successive readings, and beyond both: the time asked for is a seventh part from -1/4 to 5/4."""
    w = Window.partitionBy("sensor_id").orderBy("t", "seq")
    rows = bridge.imu(spark, d).withColumns({f"{c}1": F.lead(c).over(w) for c in ("t", "gx", "yaw")}).where("t1 > t")
    rows = rows.withColumns({"at": F.col("t") + ((F.col("seq") % 7) / 4.0 - 0.25) * (F.col("t1") - F.col("t")), "a": g.Pose.from_euler(0, 0, F.col("yaw") / 3, "gx").struct(), "b": g.Pose.from_euler(0, 0, F.col("yaw1") / 3, "gx1").struct()})
    out = ordered.poses_between(rows, "t", "a", "t1", "b", "at")
    return out.select("seq", r6("pose.tx").alias("x"), r6("pose.r00").alias("r00"), r6("pose.r10").alias("r10"))


@query("srt01_ranked_candidates", T + """, k AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY t, seq) AS idx FROM trajectory),
  p AS (SELECT a.sensor_id, a.idx AS query, b.idx AS match, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS distance FROM k a JOIN k b ON a.sensor_id = b.sensor_id AND a.idx - b.idx >= 10),
  r AS (SELECT *, row_number() OVER (PARTITION BY sensor_id, query ORDER BY distance, match)::INT AS rank FROM p WHERE distance <= 0.8) SELECT sensor_id, query, match, rank FROM r WHERE rank <= 3""")
def srt01(spark, d):
    w = Window.partitionBy("sensor_id").orderBy("t", "seq")
    poses = bridge.trajectory(spark, d).withColumn("idx", F.row_number().over(w))
    pairs = align.loop_candidates(poses, 0.8, 10, ("sensor_id",)).withColumn("key", F.struct("sensor_id", "query"))
    return mapping.ranked_candidates(pairs, "key", most=3).select("sensor_id", "query", "match", "rank")


# --- cameras --------------------------------------------------------------------------------------------------------


@query("flt10_image_cull", C + f""", p AS (SELECT point_id, z + 12 AS z, 500 * x / (z + 12) + 320 AS u, 500 * y / (z + 12) + 240 AS v FROM cloud) SELECT point_id, {sql_round('u', 'v')} FROM p WHERE z > 0.3 AND z < 13.5 AND u >= 0 AND u < 640 AND v >= 0 AND v < 480""")
def flt10(spark, d):
    u, v, valid = g.in_depth_band("x", "y", F.col("z") + 12, g.Intrinsics(500.0, 500.0, 320.0, 240.0, 640, 480), 0.3, 13.5)
    return bridge.cloud(spark, d).where(valid).select("point_id", r6(u).alias("u"), r6(v).alias("v"))


@query("flt11_centre_band", C + "SELECT point_id FROM cloud WHERE 80 + x * 4 >= 24 AND 80 + x * 4 < 136")
def flt11(spark, d):
    first, end = g.centre_band(160, 0.7)
    u = 80 + F.col("x") * 4
    return bridge.cloud(spark, d).where((u >= first) & (u < end)).select("point_id")


@query("fn24_camera_from_scanner", C + f""", r AS (SELECT point_id, cos(radians(30))*x - sin(radians(30))*y AS x, sin(radians(30))*x + cos(radians(30))*y AS y, z FROM cloud) SELECT point_id, {sql_round('-y AS cx', '-z AS cy', 'x AS cz')} FROM r""")
def fn24(spark, d):
    moved = Calibration().camera_from_scanner(yaw_offset=30.0).apply("x", "y", "z")
    return bridge.cloud(spark, d).select("point_id", *(r6(v).alias(n) for v, n in zip(moved, ("cx", "cy", "cz"))))


# --- the mount's bus --------------------------------------------------------------------------------------------------

FRAMES = """f AS (SELECT event_id, user_id, [22, 38, 19, 101, 65][event_id % 5 + 1] AS id, event_id * 2654435761 % 4294967296 AS v FROM events)"""


def bus_frame(spark, d):
    e = F.col("event_id")
    kind = F.get(F.array(*(F.lit(i) for i in (0x16, 0x26, 0x13, 0x65, 0x41))), (e % 5).cast("int"))
    raw = F.lpad(F.hex(e * 2654435761 % 4294967296), 8, "0")
    little = F.concat(*(F.substring(raw, i, 2) for i in (7, 5, 3, 1)))
    rest = F.when(e % 5 <= 1, F.concat(F.lit("0000"), little, F.lit("00"))).when(e % 5 == 2, F.concat(F.lit("00"), F.substring(little, 1, 4), F.lit("00"))).when(e % 5 == 3, F.concat(F.lit("00"), little, F.lit("00"))).otherwise(F.lit("0000"))
    frame = F.unhex(F.concat(F.lit("FDFE"), F.lpad(F.hex(kind), 2, "0"), rest))
    return bridge.table(spark, d, "events").select("event_id", "user_id", frame.alias("frame"))


@query("src22_bus_fields", "WITH " + FRAMES + """ SELECT event_id, id::INT AS frame_id, [ 'azimuth_raw', 'tilt_raw', 'remote_axis_a', 'remote_state_c', NULL][event_id % 5 + 1] AS field, CASE WHEN id = 19 THEN v % 65536 WHEN id <> 65 THEN v END::BIGINT AS value FROM f""")
def src22(spark, d):
    return serial.bus_fields(bus_frame(spark, d)).select("event_id", "frame_id", "field", "value")


@query("snk16_bus_packets", """WITH b AS (SELECT event_id, [253, 254, event_id % 256, 16, event_id * 7 % 256, event_id * 7 // 256 % 256] AS p FROM events)
  SELECT event_id, list_reduce(list_transform(list_append(p, list_reduce(list_prepend(0, p), lambda c, x: list_reduce([xor(c::BIGINT, x::BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a >= 128 THEN xor((a * 2) & 255, 7) ELSE a * 2 END))), lambda x: printf('%02X', x::INT)), lambda a, z: a || z) AS packet FROM b""")
def snk16(spark, d):
    e = F.col("event_id")
    packet = serial.bus_packet((e % 256).cast("int"), 0x10, (e * 7 % 65536).cast("int"))
    return bridge.table(spark, d, "events").select("event_id", F.hex(packet).alias("packet"))


@query("flt14_option_lists", """WITH t AS (SELECT c_custkey, [NULL, '0, 1,-1', ' 2.5 ', '', '1,2,3,4', '-1,,video0'][c_custkey % 6 + 1] AS s FROM customer),
  p AS (SELECT *, list_filter(list_transform(string_split(coalesce(s, ''), ','), lambda x: trim(x)), lambda x: x <> '') AS p FROM t)
  SELECT c_custkey, array_to_string(list_filter(p, lambda x: x <> '-1'), '|') AS devices, CASE WHEN len(list_filter(p, lambda x: try_cast(x AS DOUBLE) IS NULL)) = 0 THEN list_sum((list_transform(p, lambda x: x::DOUBLE) || [0.5, 0.5, 0.5])[1:3]) END AS total FROM p""")
def flt14(spark, d):
    options = F.get(F.array(*(F.lit(x) for x in (None, "0, 1,-1", " 2.5 ", "", "1,2,3,4", "-1,,video0"))), (F.col("c_custkey") % 6).cast("int"))
    numbers = text.float_list(F.col("s"), 3, 0.5)
    total = F.when(numbers.isNotNull(), F.aggregate(numbers, F.lit(0.0), lambda a, b: a + b))
    return bridge.table(spark, d, "customer").withColumn("s", options).select("c_custkey", F.array_join(text.device_list(F.col("s")), "|").alias("devices"), total.alias("total"))


@query("snk17_reply_problems", """WITH t AS (SELECT c_custkey, [':GLS#', ':mn#', ':V#'][c_custkey % 3 + 1] AS c, ['', '1', '0', 'x', '12#', '12', NULL][c_custkey % 7 + 1] AS r FROM customer)
  SELECT c_custkey, CASE WHEN r IS NULL OR r = '' THEN 'none' WHEN c <> ':mn#' AND NOT ends_with(r, '#') THEN 'incomplete' WHEN c = ':mn#' AND r = 'x' THEN 'unexpected' END AS problem FROM t""")
def snk17(spark, d):
    k = F.col("c_custkey")
    pick = lambda values: F.get(F.array(*(F.lit(v) for v in values)), (k % len(values)).cast("int"))
    problem = serial.reply_problem(pick((":GLS#", ":mn#", ":V#")), pick(("", "1", "0", "x", "12#", "12", None)))
    return bridge.table(spark, d, "customer").select("c_custkey", problem.alias("problem"))


@query("snk15_calibration_json", """WITH t AS (SELECT l_returnflag AS axis, l_linenumber AS trial, round(sum(l_quantity), 2) AS rate FROM lineitem GROUP BY 1, 2) SELECT axis, count(*) AS n, median(rate) AS median_rate, sum(rate) AS total FROM t GROUP BY axis""")
def snk15(spark, d):
    """The report, read back."""
    trials = bridge.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("axis"), F.col("l_linenumber").alias("trial")).agg(F.round(F.sum("l_quantity"), 2).alias("rate"))
    kind = "struct<trials:array<struct<axis:string,trial:int,rate:double>>,summary:array<struct<axis:string,n:long,median_rate:double>>>"
    report = reports.calibration_json(trials, ("axis",), "rate").select(F.from_json("report", kind).alias("r"))
    totals = report.select(F.explode("r.trials").alias("t")).groupBy("t.axis").agg(F.sum("t.rate").alias("total"))
    return report.select(F.explode("r.summary").alias("s")).select("s.axis", "s.n", "s.median_rate").join(totals, "axis")


@query("agg23_sensor_counts", I + "SELECT i.sensor_id, count(*) AS n, sum(octet_length(encode(e.props)))::BIGINT AS bytes, sum(octet_length(encode(e.props))) > 0 AS ok FROM imu i JOIN events e ON e.event_id = i.seq GROUP BY i.sensor_id")
def agg23(spark, d):
    rows = bridge.table(spark, d, "events").select(F.col("user_id").alias("sensor_id"), "props")
    return serial.sensor_counts(rows, ("sensor_id",), "props")


@query("pipe10_bus_report", "WITH " + FRAMES + """, n AS (SELECT user_id, count(*) AS chunks, sum(CASE WHEN id < 39 AND id <> 19 THEN 10 WHEN id = 19 THEN 7 WHEN id = 101 THEN 9 ELSE 5 END)::BIGINT AS bytes, count(*) AS frames, sum((id <> 65)::INT)::BIGINT AS fields, sum((id = 65)::INT)::BIGINT AS short FROM f GROUP BY user_id)
  SELECT user_id, chunks, bytes, frames, fields, short AS crc_checked FROM n""")
def pipe10(spark, d):
    captures = bus_frame(spark, d).withColumn("t", F.col("event_id").cast("double"))
    out = serial.bus_report(captures, ("user_id",), "frame")
    return out.select("user_id", "chunks", "bytes", "frames", "fields", (F.col("crc_valid") + F.col("crc_invalid")).alias("crc_checked"))


@query("agg16_crc_counts", "SELECT user_id, count(*) AS frames, count(*) FILTER (event_id % 3 <> 0) AS crc_valid, count(*) FILTER (event_id % 3 = 0) AS crc_invalid FROM events GROUP BY user_id")
def agg16(spark, d):
    """Short frames, of which every third has a wrong CRC."""
    e = F.col("event_id")
    head = F.unhex(F.concat(F.lit("FDFE41"), F.lpad(F.hex(e % 256), 2, "0")))
    last = crc8(head).bitwiseXOR(F.when(e % 3 == 0, 1).otherwise(0))
    captures = bridge.table(spark, d, "events").select("user_id", e.cast("double").alias("t"), F.concat(head, F.unhex(F.lpad(F.hex(last), 2, "0"))).alias("data"))
    return serial.bus_report(captures, ("user_id",)).select("user_id", "frames", "crc_valid", "crc_invalid")


CRC_SQL = "list_reduce(list_prepend(0, p), lambda c, x: list_reduce([xor(c::BIGINT, x::BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a >= 128 THEN xor((a * 2) & 255, 7) ELSE a * 2 END))"


@query("snk16_command_packets", f"""WITH c AS (SELECT event_id, event_id % 2 AS tilt, event_id // 2 % 2 AS negative, event_id % 3 AS n FROM events),
  s AS (SELECT *, unnest(range(3 * n + 3)) AS step FROM c), k AS (SELECT *, CASE WHEN step < 3 * n THEN [1, 2, 3][step % 3 + 1] ELSE [4, 1, 2][step - 3 * n + 1] END AS kind FROM s),
  b AS (SELECT event_id, step, CASE kind WHEN 1 THEN [253, 254, 17, 1, 0, 0] WHEN 2 THEN [253, 254, 33, 1, 0, 0] WHEN 3 THEN [253, 254, 19 + 16 * tilt, 4] || CASE WHEN negative = 1 THEN [16, 224] ELSE [20, 188] END ELSE [253, 254, 19 + 16 * tilt, 2, 0, 0] END AS p FROM k)
  SELECT event_id, step::INT AS step, list_reduce(list_transform(list_append(p, {CRC_SQL}), lambda x: printf('%02X', x::INT)), lambda a, z: a || z) AS packet FROM b""")
def snk16_commands(spark, d):
    e = F.col("event_id")
    commands = bridge.table(spark, d, "events").select("event_id", F.when(e % 2 == 1, "tilt").otherwise("azimuth").alias("axis"), F.when(F.floor(e / 2) % 2 == 1, "negative").otherwise("positive").alias("direction"), (e % 3).alias("repeats"))
    return serial.command_packets(commands).select("event_id", "step", F.hex("packet").alias("packet"))


@query("agg06_ground_by_scan", "WITH " + bridge.CLOUD + """, s AS (SELECT scan_id, x, y, z, row_number() OVER (PARTITION BY scan_id ORDER BY (point_id * 2654435761) % 4294967296, point_id) - 1 AS i FROM cloud),
  t AS (SELECT scan_id, i // 3 AS plane, i % 3 AS corner, x, y, z FROM s WHERE i < 60),
  c AS (SELECT scan_id, plane, max(x) FILTER (corner = 0) AS x0, max(y) FILTER (corner = 0) AS y0, max(z) FILTER (corner = 0) AS z0, max(x) FILTER (corner = 1) AS x1, max(y) FILTER (corner = 1) AS y1,
    max(z) FILTER (corner = 1) AS z1, max(x) FILTER (corner = 2) AS x2, max(y) FILTER (corner = 2) AS y2, max(z) FILTER (corner = 2) AS z2 FROM t GROUP BY scan_id, plane),
  n AS (SELECT scan_id, plane, x0, y0, z0, (y1-y0)*(z2-z0) - (z1-z0)*(y2-y0) AS n0, (z1-z0)*(x2-x0) - (x1-x0)*(z2-z0) AS n1, (x1-x0)*(y2-y0) - (y1-y0)*(x2-x0) AS n2 FROM c),
  p AS (SELECT scan_id, plane, n0/l AS a, n1/l AS b, n2/l AS c, -(n0*x0 + n1*y0 + n2*z0)/l AS d FROM (SELECT *, sqrt(n0*n0 + n1*n1 + n2*n2) AS l FROM n) WHERE l > 1e-12),
  v AS (SELECT p.scan_id, plane, a, b, c, d, count(*) AS inliers FROM p JOIN cloud ON p.scan_id = cloud.scan_id AND abs(a*x + b*y + c*z + d) <= 0.5 GROUP BY ALL)
  SELECT scan_id, round(a, 6) + 0.0::DOUBLE AS a, round(b, 6) + 0.0::DOUBLE AS b, round(c, 6) + 0.0::DOUBLE AS c, round(d, 6) + 0.0::DOUBLE AS d, inliers FROM v QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY inliers DESC, plane) = 1""")
def agg06_by_scan(spark, d):
    return rounded(clouds.ground_plane(bridge.cloud(spark, d), 0.5, 20, by=("scan_id",)), "a", "b", "c", "d")


@query("pipe03_inertial_hints", "WITH " + bridge.IMU + """, s AS (SELECT sensor_id, min(seq) AS scan, t FROM imu WHERE kind = 'view' GROUP BY sensor_id, t),
  m AS (SELECT i.sensor_id, s.scan, i.t, i.gz FROM imu i ASOF JOIN s ON i.sensor_id = s.sensor_id AND i.t <= s.t),
  d AS (SELECT sensor_id, scan, gz, t - lag(t) OVER (PARTITION BY sensor_id, scan ORDER BY t, gz) AS dt FROM m),
  a AS (SELECT sensor_id, scan, count(*) AS n, sum(CASE WHEN dt > 0 AND dt <= 1 AND abs(gz) >= 0.005 THEN 2 * atan(gz * dt / 2) ELSE 0 END) AS a FROM d GROUP BY ALL)
  SELECT sensor_id, scan, round(cos(a), 6) + 0.0::DOUBLE AS r00, round(sin(a), 6) + 0.0::DOUBLE AS r10 FROM a WHERE n >= 2 AND (abs(cos(a) - 1) > 1.001e-5 OR abs(sin(a)) > 1e-8)""")
def pipe03_hints(spark, d):
    """Turns about the vertical between the views of each sensor."""
    rows = bridge.imu(spark, d).withColumns({"gx": F.lit(0.0), "gy": F.lit(0.0)})
    times = rows.where("kind = 'view'").groupBy("sensor_id", "t").agg(F.min("seq").alias("scan"))
    hints = mapping.inertial_hints(rows, times, "sensor_id", "scan", bucket=5.0)
    return rounded(hints.select("sensor_id", "scan", "pose.r00", "pose.r10"), "r00", "r10")


@query("snk18_preview_sample", "WITH " + bridge.CLOUD + """, r AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY (point_id * 2654435761) % 4294967296, point_id) AS i FROM cloud),
  s AS (SELECT *, min(x) OVER w AS lx, max(x) OVER w AS hx, min(y) OVER w AS ly, max(y) OVER w AS hy FROM r WHERE i <= 12 WINDOW w AS (PARTITION BY scan_id)),
  f AS (SELECT point_id, x, y, lx, ly, least(312 / greatest(hx - lx, 1e-9), 232 / greatest(hy - ly, 1e-9)) AS k FROM s)
  SELECT point_id, round(4 + (x - lx) * k, 6) + 0.0::DOUBLE AS px, round(236 - (y - ly) * k, 6) + 0.0::DOUBLE AS py FROM f""")
def snk18_sample(spark, d):
    some = clouds.sample_exactly(bridge.cloud(spark, d), 12, by=("scan_id",))
    return rounded(reports.fit_to_canvas(some, 320, 240, ("scan_id",)).select("point_id", "px", "py"), "px", "py")


@query("fit04_hand_eye", I + """, k AS (SELECT sensor_id, radians(10 + sensor_id % 7 * 5) AS a FROM imu GROUP BY sensor_id HAVING count(*) >= 2)
  SELECT sensor_id, round(cos(a), 4) + 0.0::DOUBLE AS r00, round(sin(a), 4) + 0.0::DOUBLE AS r10, 0.5::DOUBLE AS tx, -0.25::DOUBLE AS ty, (sensor_id % 3)::DOUBLE AS tz FROM k""")
def fit04(spark, d):
    """The readings of each sensor as motions, seen by a second sensor whose place on it is known."""
    own = g.Pose.from_euler(F.col("gx") * 60, F.col("gy") * 60, F.col("yaw") / 3, "ax", "ay", F.col("az") - 9.8)
    mount = g.Pose.from_euler(0, 0, 10 + F.col("sensor_id") % 7 * 5, 0.5, -0.25, (F.col("sensor_id") % 3).cast("double"))
    motions = bridge.imu(spark, d).select("sensor_id", (mount @ own @ mount.inverse()).struct().alias("a"), own.struct().alias("b"))
    out = fit.hand_eye(motions, ("sensor_id",)).select("sensor_id", "x.r00", "x.r10", "x.tx", "x.ty", "x.tz")
    return out.withColumns({c: F.round(c, 4) + F.lit(0.0) for c in ("r00", "r10", "tx", "ty", "tz")})


CAMERA = g.Intrinsics(500.0, 500.0, 320.0, 240.0, 640, 480)


def seen(pose: g.Pose, *at) -> tuple:
    """Pixel of a point under a pose, without clipping to the image."""
    x, y, z = pose.apply(*at)
    return CAMERA.fx * x / z + CAMERA.cx, CAMERA.fy * y / z + CAMERA.cy


@query("fit13_camera_poses", C + """, n AS (SELECT scan_id, count(*) AS n, radians(scan_id % 10 * 4) AS a FROM cloud GROUP BY scan_id)
  SELECT scan_id, n, n AS inliers, n >= 12 AS accepted, round(cos(a), 4) + 0.0::DOUBLE AS r00, round(sin(a), 4) + 0.0::DOUBLE AS r10, round(scan_id % 5 / 10.0::DOUBLE, 4) AS tx, 0.25::DOUBLE AS ty, 30.0::DOUBLE AS tz FROM n WHERE n >= 6""")
def fit13(spark, d):
    """Every scan seen by a camera whose pose is known."""
    pose = g.Pose.from_euler(0, 0, F.col("scan_id") % 10 * 4, F.col("scan_id") % 5 / 10, 0.25, 30.0)
    u, v = seen(pose, "x", "y", "z")
    found = vision.camera_poses(bridge.cloud(spark, d).withColumns({"u": u, "v": v}), ("scan_id",), CAMERA).where("n >= 6")
    out = found.select("scan_id", "n", "inliers", "accepted", "r00", "r10", "tx", "ty", "tz")
    return out.withColumns({c: F.round(c, 4) + F.lit(0.0) for c in ("r00", "r10", "tx", "ty", "tz")})


@query("fit11_verified_matches", C + "SELECT scan_id, count(*) AS n, count(*) AS inliers, true AS accepted FROM cloud GROUP BY scan_id HAVING count(*) >= 8")
def fit11(spark, d):
    """Every scan seen by two cameras, all of whose matches agree with one motion."""
    one, two = g.Pose.from_euler(z=30.0), g.Pose.from_euler(0, 4.0, F.col("scan_id") % 10, 1.0, 0.5, 30.0)
    views = dict(zip(("u1", "v1", "u2", "v2"), (*seen(one, "x", "y", "z"), *seen(two, "x", "y", "z"))))
    return vision.verify_matches(bridge.cloud(spark, d).withColumns(views), ("scan_id",), CAMERA).where("n >= 8").select("scan_id", "n", "inliers", "accepted")


@query("pipe01_scan_poses")
def pipe01(spark, d):
    """Every frame of the descriptor table as a scan of one session, each registered to the one before."""
    scans = bridge.cloud(spark, d).select(F.lit("all").alias("session"), F.col("scan_id").alias("scan"), "x", "y", "z")
    poses, _ = mapping.map_scans(scans, voxel=2.0, most=4)
    return rounded(poses.select("scan", "converged", *(F.col(f"pose.t{c}").alias(f"t{c}") for c in "xyz")), "tx", "ty", "tz")
