"""Sensor views over the star-schema tables, in Spark and as SQL common table expressions that give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.operators.ordered import dead_reckoning

#: Start of the events, in seconds, and the factor that brings their gaps to those of a sensor.
EPOCH, SPEED = 1704067200, 1e-5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    axis = lambda i: F.get(e, i).cast("double")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("point_id"), F.col("label").alias("scan_id"), (axis(0) * 40).alias("x"), (axis(1) * 40).alias("y"), (axis(2) * 10).alias("z"), F.floor((axis(3) + 1) * 127).cast("double").alias("intensity")
    )


CLOUD = """cloud AS (SELECT vec_id AS point_id, label AS scan_id, embedding[1]::DOUBLE * 40 AS x, embedding[2]::DOUBLE * 40 AS y,
  embedding[3]::DOUBLE * 10 AS z, floor((embedding[4]::DOUBLE + 1) * 127) AS intensity FROM embeddings)"""


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.pmod(F.col("l_linenumber") * 7 + F.col("l_suppkey"), F.lit(16)).cast("int").alias("channel"),
        (F.pmod(F.col("l_orderkey") * 37 + F.col("l_linenumber") * 101, F.lit(36000)) / F.lit(100.0)).alias("azimuth_deg"),
        (F.pmod(F.floor("l_extendedprice"), F.lit(40000)) * F.lit(0.002)).alias("distance_m"),
        F.col("l_quantity").alias("intensity"), F.col("l_orderkey").alias("packet_id"), F.col("l_linenumber").alias("seq"),
    )


RETURNS = """returns AS (SELECT ((l_linenumber * 7 + l_suppkey) % 16)::INT AS channel,
  ((l_orderkey * 37 + l_linenumber * 101) % 36000) / 100.0::DOUBLE AS azimuth_deg,
  (floor(l_extendedprice)::BIGINT % 40000) * 0.002::DOUBLE AS distance_m, l_quantity AS intensity, l_orderkey AS packet_id, l_linenumber AS seq FROM lineitem)"""


def imu(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    events = table(spark, sf_dir, "events").withColumn("k", k)
    unit = lambda m, d: (F.col("k") % m - m // 2) / F.lit(float(d))
    return events.select(
        F.col("user_id").alias("sensor_id"), F.col("event_id").alias("seq"),
        ((F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6) - EPOCH) * SPEED).alias("t"),
        (F.col("value") * 7.3 % 360 - 180).alias("yaw"), unit(7, 3).alias("ax"), unit(5, 2).alias("ay"), (F.lit(9.8) + unit(3, 10)).alias("az"),
        unit(11, 40).alias("gx"), unit(13, 60).alias("gy"), ((F.col("k").cast("double") - 50) / 50).alias("gz"), F.col("event_type").alias("kind"),
    )


IMU = """imu AS (SELECT user_id AS sensor_id, event_id AS seq, (epoch_us(ts) / 1e6::DOUBLE - 1704067200) * 1e-5::DOUBLE AS t,
  value * 7.3::DOUBLE % 360 - 180 AS yaw, (k % 7 - 3) / 3.0::DOUBLE AS ax, (k % 5 - 2) / 2.0::DOUBLE AS ay, 9.8::DOUBLE + (k % 3 - 1) / 10.0::DOUBLE AS az,
  (k % 11 - 5) / 40.0::DOUBLE AS gx, (k % 13 - 6) / 60.0::DOUBLE AS gy, (k::DOUBLE - 50) / 50 AS gz, event_type AS kind
  FROM (SELECT *, json_extract(props, '$.k')::INT AS k FROM events))"""


def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dead_reckoning(imu(spark, sf_dir), ("sensor_id",), ("t", "seq")).withColumn("z", F.col("gz"))


TRAJECTORY = IMU + """, trajectory AS (SELECT *, sum(cos(radians(yaw))) OVER w AS x, sum(sin(radians(yaw))) OVER w AS y, gz AS z FROM imu
  WINDOW w AS (PARTITION BY sensor_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING))"""


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign bits of the vectors, 32 in each of two longs."""
    bits = lambda at: F.aggregate(F.transform(F.slice("embedding", at, 32), lambda x: F.when(x > 0, 1).otherwise(0).cast("long")), F.lit(0).cast("long"), lambda s, b: s * 2 + b)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("frame"), bits(1).alias("b0"), bits(33).alias("b1"))


DESCRIPTORS = """descriptors AS (SELECT vec_id AS id, label AS frame,
  list_reduce(list_transform(embedding[1:32], lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END::BIGINT), lambda s, b: s * 2 + b) AS b0,
  list_reduce(list_transform(embedding[33:64], lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END::BIGINT), lambda s, b: s * 2 + b) AS b1 FROM embeddings)"""
