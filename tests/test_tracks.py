from __future__ import annotations

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from skytab.functions import camera, geodesy
from skytab.operators import asof, kinematics, robust


def straight(spark, bearing, speed=9.0, n=200, fps=24, climb=0.0):
    lat0, lon0 = 13.4, 79.56
    rows = []
    for i in range(n):
        d = speed * i / fps
        lat = lat0 + d * math.cos(math.radians(bearing)) / 110650.0
        lon = lon0 + d * math.sin(math.radians(bearing)) / 108300.0
        rows.append((1, i + 1, i / fps, round(lat, 6), round(lon, 6), 100.0 + climb * i / fps))
    return spark.createDataFrame(rows, "track_id long, rn long, t double, latitude double, longitude double, altitude double")


def kin(df):
    return kinematics.turn_rate(kinematics.track_kinematics(kinematics.to_enu(df))).toPandas()


@pytest.mark.parametrize("bearing", [0, 45, 160.5, 250, 330])
def test_course_of_a_straight_track(spark, bearing):
    k = kin(straight(spark, bearing))
    c = k.course.dropna()
    error = ((c - bearing + 540) % 360 - 180).abs()
    assert len(c) > 150 and error.max() < 2 and error.mean() < 0.6
    assert (k.ground_speed - 9).abs().median() < 0.45
    assert k.heading_change.dropna().abs().median() < 10


def test_idle_climb_and_short_tracks(spark):
    still = kin(straight(spark, 0, speed=0.0))
    assert still.course.isna().all() and still.heading_change.isna().all() and (still.ground_speed == 0).all()
    climb = kin(straight(spark, 90, climb=2.0))
    assert (climb.vertical_speed - 2).abs().max() < 0.01
    short = kin(straight(spark, 90, n=2))
    assert (short.ground_speed == 0).all() and (short.course_quality == 0).all() and short.course.isna().all()


def test_long_tracks_are_dealt_out(spark):
    enu = kinematics.to_enu(straight(spark, 77.0))
    rows = lambda c: sorted(map(tuple, kinematics.track_kinematics(enu, chunk=c).collect()))
    assert rows(30) == rows(1 << 16) and len(rows(30)) == 200


def test_circular_stats(spark):
    df = spark.createDataFrame([(1, a) for a in (350.0, 10.0, 355.0, 5.0, None)], "k int, a double")
    r = kinematics.circular_stats(df, "a", "k").first()
    assert r.n == 4 and min(r["mean"], 360 - r["mean"]) < 1e-6 and 7 < r["std"] < 9


@pytest.mark.parametrize("values,kept", [([1.5, 1.6, 1.4, 1.5, 1.55, 24.4, 1.45, 1.5], [True] * 5 + [False] + [True] * 2), ([1.0, 1.1, 0.9, 1.0], [True] * 4), ([1.0, None, 50.0], [True, False, True]), ([2.0, 2.0, 2.0, 9.0, 2.0], [True] * 5)])
def test_mad(spark, values, kept):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k int, i int, v double")
    assert [r.v_ok for r in robust.mad_inliers(df, ["v"], "k").orderBy("i").collect()] == kept


def test_nearest_lookup(spark):
    rows = spark.createDataFrame([(1, i, float(i)) for i in range(1, 21)] + [(1, 5, 5.5)], "track_id long, id long, v double")
    targets = spark.createDataFrame([(1, x) for x in (5, 999, -5)] + [(2, 1)], "track_id long, target long")
    got = {(r.track_id, r.target): r.match and (r.match.id, r.match.v) for r in asof.nearest(targets, rows).collect()}
    assert got == {(1, 5): (5, 5.5), (1, 999): (20, 20.0), (1, -5): (1, 1.0), (2, 1): None}


def test_asof_boundaries(spark):
    tel = spark.createDataFrame([(1, 0.0, 0.04, 0.02, "a"), (1, 0.04, 0.08, 0.06, "b"), (1, 0.2, 0.24, 0.22, "c")], "track_id long, start_sec double, end_sec double, mid_sec double, name string")
    times = {-1.0: "a", 0.0: "a", 0.04: "a", 0.05: "b", 0.13: "b", 0.15: "c", 0.2: "c", 9.0: "c"}
    targets = spark.createDataFrame([(1, t) for t in times], "track_id long, at double")
    assert {r.at: r.match["name"] for r in asof.asof_interval(targets, tel).collect()} == times


def test_median_smooth_ends(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([9.0, 1.0, 2.0, 3.0, 50.0, 4.0])], "track_id int, idx int, v double")
    got = [r.v for r in robust.median_smooth(df, ["v"]).orderBy("idx").collect()]
    assert got == [9.0, 3.0, 3.0, 3.0, 4.0, 4.0]


def test_fuse_without_samples(spark):
    frames = spark.createDataFrame([(1, 1), (1, 2)], "track_id long, idx long")
    none = spark.createDataFrame([], "track_id long, idx long, pitch double, roll double, yaw double, agl double")
    assert {r.attitude_source for r in robust.fuse_attitude(frames, none).collect()} == {"gps-track"}


def test_fill_attitude(spark):
    df = spark.createDataFrame([(1.0, None, None, 7.0, 8.0, 9.0), (None, None, None, 7.0, None, 9.0)], "yaw double, pitch double, roll double, camera_yaw double, camera_pitch double, camera_roll double")
    assert [(r.yaw, r.pitch, r.roll) for r in robust.fill_attitude(df).collect()] == [(1.0, 8.0, 9.0), (None, None, None)]


def yaw(spark, down, motion, track):
    cols = lambda v: [F.lit(float(x)) for x in v]
    return spark.range(1).select(camera.yaw_from_motion(cols(down), cols(motion), F.lit(float(track)))).first()[0]


def test_yaw_from_motion(spark):
    # level camera: down is +y, ahead +z; moving ahead looks along the track, moving right looks left of it
    assert yaw(spark, (0, 1, 0), (0, 0, 1), 160.5) == pytest.approx(160.5)
    assert yaw(spark, (0, 1, 0), (1, 0, 0), 90) % 360 == pytest.approx(0, abs=1e-9)
    assert yaw(spark, (0, 1, 0), (0, 0, -1), 10) == pytest.approx(190)
    assert yaw(spark, (0, 1, 0), (0, 1, 0), 10) is None


def test_yaw_round_trip(spark):
    """A camera with a known attitude sees down and its motion; yaw comes back."""
    rows = [(y, p, r, t) for y in (0.0, 77.0, 200.0, 359.0) for p in (-80.0, -38.0, 0.0) for r in (-10.0, 5.0) for t in (30.0, 290.0)]
    df = spark.createDataFrame(rows, "y double, p double, r double, t double")
    rot = camera.rotation_world_to_camera(F.col("y"), F.col("p"), F.col("r"))
    down = [-rot[k][2] for k in range(3)]
    motion = [rot[k][0] * F.sin(F.radians("t")) + rot[k][1] * F.cos(F.radians("t")) for k in range(3)]
    pitch, roll = camera.pitch_roll_from_down(*down)
    for x in df.select("*", camera.yaw_from_motion(down, motion, F.col("t")).alias("yaw"), pitch.alias("pitch"), roll.alias("roll")).collect():
        assert abs((x.yaw - x.y + 540) % 360 - 180) < 1e-6
        assert x.pitch == pytest.approx(x.p, abs=1e-6) and x.roll == pytest.approx(x.r, abs=1e-6)


def test_one_long_track(spark):
    """A track of 400,000 rows: linear, and the same in chunks."""
    import time

    from pyspark.sql import functions as F

    from skytab.operators import asof

    n = 200_000
    rows = spark.range(n).select(F.lit(1).alias("track_id"), (F.col("id") * 3 % (3 * n)).alias("idx"), (F.col("id") % 101).cast("double").alias("x"))
    targets = spark.range(n).select(F.lit(1).alias("track_id"), (F.col("id") * 3 + F.col("id") % 3).alias("idx"))
    packed = rows.select("track_id", "idx", F.struct("idx", "x").alias("r"))
    began = time.time()
    plain = asof.neighbours(targets, packed, "track_id", "idx", "idx", "r", strict=False)
    sums = lambda df: df.agg(F.sum("prev.idx"), F.sum("next.idx"), F.sum("prev.x"), F.count("prev"), F.count("next")).first()
    got = sums(plain)
    assert time.time() - began < 60
    assert got[0] == sum(3 * k for k in range(n)) and got[3] == n
    assert sums(asof.neighbours(targets, packed, "track_id", "idx", "idx", "r", strict=False, chunk=20_000)) == got


def test_lookups_in_chunks(spark):
    import random

    from skytab.operators import asof

    rng = random.Random(5)
    rows = [(t, rng.randrange(40), rng.random()) for t in ("a", "b") for _ in range(60)] + [("c", 5, 0.5)]
    seek = [(t, rng.randrange(-5, 50)) for t in ("a", "b", "c", "d") for _ in range(50)]
    packed = spark.createDataFrame([(t, i, (i, x)) for t, i, x in rows], "track_id string, idx int, r struct<idx:int,x:double>")
    targets = spark.createDataFrame(seek, "track_id string, idx int")
    for strict in (True, False):
        got = [sorted(map(str, asof.neighbours(targets, packed, "track_id", "idx", "idx", "r", strict, chunk).collect())) for chunk in (None, 10)]
        assert got[0] == got[1] and len(got[0]) == 200


def test_path_of_a_long_track_over_chunks(spark):
    n, i = 50_000, F.col("id")
    place = {"latitude": 10 + (i * 7919 % 1000) / 1e5, "longitude": 20 + (i * 104729 % 1000) / 1e5, "altitude": (i % 17).cast("double")}
    one = spark.range(n).select(F.lit("a").alias("track_id"), (i * 3 - 999).alias("rn"), (i / 24.0).alias("t"), *(c.alias(k) for k, c in place.items()))
    rows = one.unionByName(one.filter("rn % 2 = 0").withColumn("track_id", F.lit(None).cast("string")))
    got = {c: {r.track_id: (r.total_points, round(r.total_distance, 3), r.start_t, r.end_t) for r in kinematics.path_length(rows, chunk=c).collect()} for c in (100, 1 << 40)}
    assert got[100] == got[1 << 40] and got[100]["a"][0] == n
    w = Window.partitionBy("track_id").orderBy("rn")
    plain = rows.withColumn("d", geodesy.haversine_3d(*(F.lag(c).over(w) for c in place), *(F.col(c) for c in place))).groupBy("track_id").agg(F.round(F.sum("d"), 3).alias("d"))
    assert {r.track_id: r.d for r in plain.collect()} == {k: v[1] for k, v in got[100].items()}
