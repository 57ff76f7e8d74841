"""Robust filtering of samples and their fusion with a track."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geodesy import wrap360
from .asof import interpolate
from .kinematics import circular_stats


def mad_inliers(df: DataFrame, columns: list[str], *keys: str, k: float = 4.0) -> DataFrame:
    """Add <column>_ok: not null, and within k scaled median absolute deviations of the group's median.

    Groups of fewer than four values, or without deviation, keep all that is not null.
    """
    w = Window.partitionBy(*keys)
    out = df
    for c in columns:
        out = out.withColumns({"__med": F.median(c).over(w), "__cnt": F.count(c).over(w)})
        out = out.withColumn("__mad", F.median(F.abs(F.col(c) - F.col("__med"))).over(w))
        near = F.abs(F.col(c) - F.col("__med")) <= k * 1.4826 * F.col("__mad")
        out = out.withColumn(f"{c}_ok", F.col(c).isNotNull() & ((F.col("__cnt") < 4) | (F.col("__mad") < 1e-9) | near))
    return out.drop("__med", "__cnt", "__mad")


def median_smooth(df: DataFrame, columns: list[str], key: str = "track_id", order: str = "idx") -> DataFrame:
    """Replace ``columns`` by their medians over five rows, ends repeated; groups of under five stay."""
    w = Window.partitionBy(key).orderBy(order)
    whole = Window.partitionBy(key)
    out = {}
    for c in columns:
        first = F.first(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        last = F.last(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        five = [*(F.coalesce(F.lag(c, n).over(w), first) for n in (2, 1)), F.col(c), *(F.coalesce(F.lead(c, n).over(w), last) for n in (1, 2))]
        out[c] = F.when(F.count(F.lit(1)).over(whole) < 5, F.col(c)).otherwise(F.sort_array(F.array(*five))[2])
    return df.withColumns(out)


def smooth_interpolate(targets: DataFrame, samples: DataFrame, column: str, key: str = "track_id", at: str = "idx", angle: bool = False) -> DataFrame:
    """``targets`` with ``column`` of ``samples``: median-filtered, then interpolated; an angle by its sine and cosine."""
    good = samples.filter(F.col(column).isNotNull()).select(key, at, column)
    if not angle:
        return interpolate(targets, median_smooth(good, [column], key, at), [column], key, at)
    parts = good.select(key, at, F.sin(F.radians(column)).alias("__s"), F.cos(F.radians(column)).alias("__c"))
    out = interpolate(targets, median_smooth(parts, ["__s", "__c"], key, at), ["__s", "__c"], key, at)
    return out.withColumn(column, wrap360(F.degrees(F.atan2("__s", "__c")))).drop("__s", "__c")


def fuse_attitude(frames: DataFrame, samples: DataFrame, key: str = "track_id", at: str = "idx") -> DataFrame:
    """``frames`` (key, idx) with camera_pitch, camera_roll, camera_yaw, agl_m and attitude_source.

    Samples (key, idx, pitch, roll, yaw, agl) must be sane in pitch, roll and height alike, unless
    that leaves fewer than four of a track: then all count. Values are held flat outside the span of
    the samples and called visual-extrapolated there; tracks without samples are gps-track.
    """
    checked = mad_inliers(samples, ["pitch", "roll", "agl"], key)
    checked = checked.withColumn("__ok", F.col("pitch_ok") & F.col("roll_ok") & F.col("agl_ok"))
    enough = F.count_if("__ok").over(Window.partitionBy(key)) >= 4
    kept = checked.withColumn("__enough", enough).filter(F.col("__ok") | ~F.col("__enough")).select(key, at, "pitch", "roll", "yaw", "agl")
    kept = kept.withColumns({"ys": F.sin(F.radians("yaw")), "yc": F.cos(F.radians("yaw"))}).drop("yaw")
    names = ["pitch", "roll", "agl", "ys", "yc"]
    span = kept.groupBy(key).agg(F.min(at).alias("__lo"), F.max(at).alias("__hi"))
    out = interpolate(frames, median_smooth(kept, names, key, at), names, key, at).join(span, key, "left")
    source = F.when(F.col("pitch").isNull(), "gps-track").when(F.col(at).between(F.col("__lo"), F.col("__hi")), "visual-homography").otherwise("visual-extrapolated")
    return out.select(
        *frames.columns,
        F.col("pitch").alias("camera_pitch"),
        F.col("roll").alias("camera_roll"),
        wrap360(F.degrees(F.atan2("ys", "yc"))).alias("camera_yaw"),
        F.col("agl").alias("agl_m"),
        source.alias("attitude_source"),
    )


def fill_attitude(frames: DataFrame) -> DataFrame:
    """Where a camera pitch is known, yaw, pitch and roll that telemetry lacks come from the camera's."""
    known = F.col("camera_pitch").isNotNull()
    return frames.withColumns({c: F.when(known, F.coalesce(c, f"camera_{c}")).otherwise(F.col(c)) for c in ("yaw", "pitch", "roll")})


def count_sources(fused: DataFrame, key: str = "track_id") -> DataFrame:
    """How many frames of each track have a solved attitude, an extrapolated one, and none but the track's."""
    kind = lambda s: F.count_if(F.col("attitude_source") == s)
    return fused.groupBy(key).agg(kind("visual-homography").alias("n_solved"), kind("visual-extrapolated").alias("n_extrapolated"), kind("gps-track").alias("n_gps"))


def attitude_report(motion: DataFrame, samples: DataFrame, fused: DataFrame, key: str = "track_id") -> DataFrame:
    """One report a track as JSON text (key, report): of motion (key, course, ground_speed) the mean course, its
    spread and the speeds; of samples (key, pitch, roll, yaw, agl) means and deviations; of fused frames how
    many are solved and extrapolated. A track without samples has no visual part."""
    speed = motion.groupBy(key).agg(F.count(F.lit(1)).alias("records"), F.avg("ground_speed").alias("mean"), F.max("ground_speed").alias("most"))
    course = circular_stats(motion, "course", key).select(key, F.col("mean").alias("course"), F.col("std").alias("course_std"))
    turn = circular_stats(samples, "yaw", key).select(key, F.col("mean").alias("yaw"), F.col("std").alias("yaw_std"))
    both = lambda c: F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c)
    seen = samples.groupBy(key).agg(F.count(F.lit(1)).alias("samples"), both("pitch"), both("roll"), both("agl"))
    rows = speed.join(course, key, "left").join(seen.join(turn, key), key, "left").join(count_sources(fused, key), key, "left")
    track = F.struct(F.col("course").alias("mean_course_deg"), F.col("course_std").alias("course_circ_std_deg"), F.col("mean").alias("mean_speed_mps"), F.col("most").alias("max_speed_mps"))
    visual = F.struct("samples", F.col("pitch").alias("pitch_deg"), F.col("roll").alias("roll_deg"), F.struct(F.col("yaw").alias("mean"), F.col("yaw_std").alias("circ_std")).alias("yaw_deg"), F.col("agl").alias("agl_m"))
    report = F.struct("records", track.alias("track"), F.when(F.col("samples").isNotNull(), visual).alias("visual"), F.coalesce("n_solved", F.lit(0)).alias("frames_with_visual_attitude"), F.coalesce("n_extrapolated", F.lit(0)).alias("frames_extrapolated"))
    return rows.select(key, F.to_json(report).alias("report"))


def metrics_report(metrics: DataFrame, *keys: str) -> DataFrame:
    """Rows of metrics as JSON texts (keys, metrics), for a file of metrics or curves."""
    return metrics.select(*keys, F.to_json(F.struct(*(c for c in metrics.columns if c not in keys))).alias("metrics"))
