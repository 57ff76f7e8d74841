"""The given tables seen as survey data, row by row, in Spark and in SQL alike.

Positions are whole micro-degrees until the last step, so that both engines start from equal numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as flights: one track a user, one row every 1/24 s in order of time."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value", F.row_number().over(w).cast("long").alias("rn"))
    rows = rows.select(F.col("user_id").alias("track_id"), "event_id", "value", "rn", ((F.col("rn") - 1) / 24.0).alias("t"), F.floor("value").cast("long").alias("v"))
    kind = F.col("track_id") % 25
    la = F.when(kind == 0, 0).when(kind == 1, F.col("v") % 3 - 1).otherwise(F.col("rn") * ((F.col("track_id") * 7) % 21 - 10) + F.col("v") % 3 - 1)
    lo = F.when(kind == 0, 0).when(kind == 1, F.col("v") % 2).otherwise(F.col("rn") * ((F.col("track_id") * 11) % 21 - 10) + F.col("v") % 2)
    rows = rows.withColumns({"la": F.lit(13398962).cast("long") + la, "lo": F.lit(79563553).cast("long") + lo})
    return rows.withColumns({"latitude": F.col("la") / 1e6, "longitude": F.col("lo") / 1e6, "altitude": 200 + F.col("value") / 10})


TRACKS = """tracks AS (
  SELECT *, la / 1e6 AS latitude, lo / 1e6 AS longitude, 200 + value / 10 AS altitude FROM (
    SELECT *,
      13398962 + CASE WHEN track_id % 25 = 0 THEN 0 WHEN track_id % 25 = 1 THEN v % 3 - 1 ELSE rn * ((track_id * 7) % 21 - 10) + v % 3 - 1 END AS la,
      79563553 + CASE WHEN track_id % 25 = 0 THEN 0 WHEN track_id % 25 = 1 THEN v % 2 ELSE rn * ((track_id * 11) % 21 - 10) + v % 2 END AS lo
    FROM (SELECT *, (rn - 1) / 24.0::DOUBLE AS t, CAST(floor(value) AS BIGINT) AS v FROM (
      SELECT user_id AS track_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events))))"""

ENU = TRACKS + """, enu AS (
  SELECT *, (lo - lo0) / 1e6 * (111412.84 * cos(p) - 93.5 * cos(3 * p) + 0.118 * cos(5 * p)) AS east,
    (la - la0) / 1e6 * (111132.92 - 559.82 * cos(2 * p) + 1.175 * cos(4 * p) - 0.0023 * cos(6 * p)) AS north,
    altitude - 200 AS up
  FROM (SELECT *, radians(la0 / 1e6) AS p FROM (SELECT *, round(avg(la) OVER (PARTITION BY track_id)) AS la0, round(avg(lo) OVER (PARTITION BY track_id)) AS lo0 FROM tracks)))"""

KINEMATICS = ENU + """, kin AS (
  SELECT *, CASE WHEN ok AND sp >= 0.5 AND sp * span > 0.33 THEN (degrees(atan2(ve, vn)) + 360) % 360 END AS course,
    CASE WHEN ok THEN least(1.0, sp * span / 0.33) ELSE 0 END AS quality FROM (
    SELECT *, CASE WHEN ok THEN sqrt(ve * ve + vn * vn) ELSE 0 END AS sp FROM (
      SELECT *, n >= 3 AND span >= 1e-6 AS ok FROM (
        SELECT *, regr_slope(east, t) OVER w AS ve, regr_slope(north, t) OVER w AS vn, regr_slope(up, t) OVER w AS vu,
          count(*) OVER w AS n, max(t) OVER w - min(t) OVER w AS span
        FROM enu WINDOW w AS (PARTITION BY track_id ORDER BY rn ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING)))))"""


def enu(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.kinematics import to_enu

    whole = Window.partitionBy("track_id")
    origin = F.round(F.avg("la").over(whole)) / 1e6, F.round(F.avg("lo").over(whole)) / 1e6, F.lit(200.0)
    return to_enu(tracks(spark, sf_dir), origin=origin)


def kinematics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.kinematics import track_kinematics

    return track_kinematics(enu(spark, sf_dir))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tracks as telemetry intervals with gaps between them; a row in three lacks its number or bears another."""
    rows = tracks(spark, sf_dir)
    cnt = F.when(F.col("rn") % 5 == 0, F.col("rn") + 1).when(F.col("rn") % 7 != 0, F.col("rn"))
    return rows.select("track_id", F.col("rn").alias("pos"), F.col("t").alias("start_sec"), (F.col("t") + 0.03).alias("end_sec"), (F.col("t") + 0.015).alias("mid_sec"), cnt.alias("frame_cnt"), "latitude", "longitude", "altitude")


TELEMETRY = TRACKS + """, telemetry AS (
  SELECT track_id, rn AS pos, t AS start_sec, t + 0.03 AS end_sec, t + 0.015 AS mid_sec,
    CASE WHEN rn % 5 = 0 THEN rn + 1 WHEN rn % 7 <> 0 THEN rn END AS frame_cnt, latitude, longitude, altitude FROM tracks)"""


def visual_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth row of a track as a visual attitude sample, now and then a degenerate one."""
    rows = tracks(spark, sf_dir).filter("rn % 4 = 0 AND track_id % 6 <> 5")
    off = F.when(F.col("rn") % 36 == 0, 25.0).otherwise(0.0)
    return rows.select("track_id", F.col("rn").alias("idx"), (-38 + (F.col("v") % 7 - 3) * 0.5 + off).alias("pitch"), ((F.col("v") % 5 - 2) * 0.25).alias("roll"), ((F.col("v") * 37) % 360).cast("double").alias("yaw"), (50.0 + F.col("v") % 5).alias("agl"))


VISUAL = TRACKS + """, samples AS (
  SELECT track_id, rn AS idx, -38 + (v % 7 - 3) * 0.5::DOUBLE + CASE WHEN rn % 36 = 0 THEN 25.0 ELSE 0.0 END::DOUBLE AS pitch, (v % 5 - 2) * 0.25::DOUBLE AS roll,
    ((v * 37) % 360)::DOUBLE AS yaw, 50.0::DOUBLE + v % 5 AS agl FROM tracks WHERE rn % 4 = 0 AND track_id % 6 <> 5)"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as posed photographs."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("track_id"), k.alias("k"), F.floor("value").cast("long").alias("v"))
    return rows.select(
        "event_id",
        "track_id",
        "k",
        F.lit(3840).alias("width"),
        F.lit(2160).alias("height"),
        (24.0 + F.col("k") % 8).alias("focal"),
        (-90.0 + F.col("k") % 60).alias("pitch"),
        ((F.col("k") % 7) - 3.0).alias("roll"),
        (F.col("v") % 360).cast("double").alias("yaw"),
        (40.0 + F.col("k")).alias("agl"),
        (13398962 + F.col("event_id") % 1000).alias("la"),
        (79563553 - F.col("event_id") % 777).alias("lo"),
        ((13398962 + F.col("event_id") % 1000) / 1e6).alias("latitude"),
        ((79563553 - F.col("event_id") % 777) / 1e6).alias("longitude"),
    )


IMAGES = """images AS (
  SELECT event_id, track_id, k, 3840 AS width, 2160 AS height, 24.0::DOUBLE + k % 8 AS focal, -90.0::DOUBLE + k % 60 AS pitch, (k % 7) - 3.0::DOUBLE AS roll,
    (v % 360)::DOUBLE AS yaw, 40.0::DOUBLE + k AS agl, 13398962 + event_id % 1000 AS la, 79563553 - event_id % 777 AS lo, (13398962 + event_id % 1000) / 1e6 AS latitude, (79563553 - event_id % 777) / 1e6 AS longitude
  FROM (SELECT event_id, user_id AS track_id, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INT) AS k, CAST(floor(value) AS BIGINT) AS v FROM events))"""
