"""Track kinematics: windowed regression over noisy positions, course, turn rate, baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geodesy import angle_difference, bearing, meters_per_degree, wrap360


def to_enu(tracks: DataFrame, track: str = "track_id", origin: tuple[Column, Column, Column] | None = None) -> DataFrame:
    """Add east, north, up in metres about each track's mean position, or about ``origin`` (lat, lon, alt). The means are
    an aggregate joined back, so that a long track stays spread over tasks."""
    if origin:
        out = tracks.withColumns(dict(zip(("__lat0", "__lon0", "__alt0"), origin)))
    else:
        mean = tracks.groupBy(track).agg(*(F.avg(c).alias(f"__{n}0") for c, n in (("latitude", "lat"), ("longitude", "lon"), ("altitude", "alt"))))
        out = tracks.join(mean, track, "left")
    north, east = meters_per_degree(F.col("__lat0"))
    out = out.withColumns({"east": (F.col("longitude") - F.col("__lon0")) * east, "north": (F.col("latitude") - F.col("__lat0")) * north, "up": F.col("altitude") - F.col("__alt0")})
    return out.drop("__lat0", "__lon0", "__alt0")


def with_halo(df: DataFrame, order: str, size: int, halo: int) -> DataFrame:
    """Rows dealt to __chunk by a consecutive row number, those near an edge to the next chunk too; __own marks the home chunk.

    A window partitioned by track and __chunk then sees all of ``halo`` rows on either side, so one
    very long track is spread over tasks.
    """
    n = F.col(order)
    chunks = F.sequence(F.floor((n - halo) / size), F.floor((n + halo) / size))
    out = df.withColumn("__chunk", F.explode(chunks))
    return out.withColumn("__own", F.floor(n / size) == F.col("__chunk"))


def with_previous(rows: DataFrame, track: str, order: str, value: str, out: str, chunk: int = 1 << 16) -> DataFrame:
    """Add the ``value`` (a struct) of the row before, by ``order`` and then by value; null for a track's first row. A window
    spans the rows whose order falls into one ``chunk`` only, and the last value of each chunk is carried over, so
    one very long track is spread over tasks. A null order goes first."""
    at = F.coalesce(F.floor(F.greatest(F.col(order).cast("double"), F.lit(-1e15)) / chunk), F.lit(-(2**60)))
    rows = rows.withColumn("__chunk", at)
    ends = rows.groupBy(track, "__chunk").agg(F.max_by(value, F.struct(order, value)).alias("__end"))  # one row a chunk
    before = ends.select(F.col(track).alias("__k"), F.col("__chunk").alias("__c"), F.lag("__end").over(Window.partitionBy(track).orderBy("__chunk")).alias("__end"))
    rows = rows.join(before, F.col(track).eqNullSafe(F.col("__k")) & (F.col("__chunk") == F.col("__c")), "left")
    here = F.lag(value).over(Window.partitionBy(track, "__chunk").orderBy(order, value))
    return rows.withColumn(out, F.coalesce(here, F.col("__end"))).drop("__chunk", "__k", "__c", "__end")


def track_kinematics(enu: DataFrame, track: str = "track_id", order: str = "rn", half: int = 8, min_speed: float = 0.5, grain: float = 0.11, chunk: int = 1 << 16) -> DataFrame:
    """Add ground_speed, vertical_speed, course (null when idle) and course_quality.

    The slope of a line through the positions of ``half`` rows on either side, fewer at the ends, is
    the velocity. A course needs min_speed and a path of over three times the coordinates' grain;
    quality is that ratio, 1 at most. Windows of under three rows or no time span give zeros. ``order``
    numbers the rows of a track one after another; a task's window holds at most ``chunk`` of them.
    """
    w = Window.partitionBy(track, "__chunk").orderBy(order).rowsBetween(-half, half)
    fit = with_halo(enu, order, chunk, half).withColumns(
        {
            "__n": F.count(F.lit(1)).over(w),
            "__span": F.max("t").over(w) - F.min("t").over(w),
            "__e": F.regr_slope("east", "t").over(w),
            "__no": F.regr_slope("north", "t").over(w),
            "__u": F.regr_slope("up", "t").over(w),
        }
    )
    fit = fit.filter("__own").drop("__own", "__chunk")
    ok = (F.col("__n") >= 3) & (F.col("__span") >= 1e-6)
    speed = F.when(ok, F.sqrt(F.col("__e") * F.col("__e") + F.col("__no") * F.col("__no"))).otherwise(0.0)
    fit = fit.withColumn("ground_speed", speed).withColumn("__path", F.col("ground_speed") * F.col("__span"))
    moving = ok & (F.col("ground_speed") >= min_speed) & (F.col("__path") > grain * 3)
    fit = fit.withColumns(
        {
            "vertical_speed": F.when(ok, F.col("__u")).otherwise(0.0),
            "course": F.when(moving, bearing(F.col("__e"), F.col("__no"))),
            "course_quality": F.when(ok, F.least(F.lit(1.0), F.col("__path") / (grain * 3))).otherwise(0.0),
        }
    )
    return fit.drop("__n", "__span", "__e", "__no", "__u", "__path")


def turn_rate(kinematics: DataFrame, track: str = "track_id", order: str = "rn") -> DataFrame:
    """Add heading_change, degrees a second, over the rows with a course: the second-order difference
    of the unwrapped course, one-sided at the ends; null elsewhere and with a single course."""
    w = Window.partitionBy(track, F.col("course").isNull()).orderBy(order)
    step = lambda a, b: F.when((F.abs(angle_difference(a, b)) == 180.0) & (a > b), 180.0).otherwise(angle_difference(a, b))
    back, ahead = F.col("t") - F.lag("t").over(w), F.lead("t").over(w) - F.col("t")
    out = kinematics.withColumns({"__a": step(F.col("course"), F.lag("course").over(w)), "__b": step(F.lead("course").over(w), F.col("course")), "__h": back, "__k": ahead})
    inner = (F.col("__h") * F.col("__h") * F.col("__b") + F.col("__k") * F.col("__k") * F.col("__a")) / (F.col("__h") * F.col("__k") * (F.col("__h") + F.col("__k")))
    rate = F.coalesce(inner, F.col("__b") / F.col("__k"), F.col("__a") / F.col("__h"))
    return out.withColumn("heading_change", F.when(F.col("course").isNotNull(), rate)).drop("__a", "__b", "__h", "__k")


def circular_stats(df: DataFrame, angle: str, *keys: str) -> DataFrame:
    """For each group the circular mean (0 to 360) and standard deviation in degrees, and the count, of an angle."""
    sums = df.filter(F.col(angle).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.sin(F.radians(angle))).alias("s"), F.avg(F.cos(F.radians(angle))).alias("c"))
    r = F.least(F.lit(1.0), F.greatest(F.lit(1e-12), F.sqrt(F.col("s") * F.col("s") + F.col("c") * F.col("c"))))
    return sums.select(*keys, "n", wrap360(F.degrees(F.atan2("s", "c"))).alias("mean"), F.degrees(F.sqrt(-2 * F.log(r))).alias("std"))


def baseline_samples(enu: DataFrame, track: str = "track_id", order: str = "rn", stride: int = 4, gap: int = 8, half: int = 4, min_baseline: float = 0.8) -> DataFrame:
    """Every stride-th row with its displacement since ``gap`` rows before, both positions averaged over
    ``half`` rows on either side, if that is at least min_baseline: index, baseline, bearing."""
    near = Window.partitionBy(track).orderBy(order).rowsBetween(-half, half)
    line = Window.partitionBy(track).orderBy(order)
    smooth = enu.withColumns({"__e": F.avg("east").over(near), "__n": F.avg("north").over(near), "__i": F.row_number().over(line) - 1})
    moved = smooth.withColumns({"__de": F.col("__e") - F.lag("__e", gap).over(line), "__dn": F.col("__n") - F.lag("__n", gap).over(line)})
    length = F.sqrt(F.col("__de") * F.col("__de") + F.col("__dn") * F.col("__dn"))
    out = moved.filter((F.col("__i") % stride == 0) & (length >= min_baseline))
    return out.select(track, F.col("__i").alias("index"), length.alias("baseline"), bearing(F.col("__de"), F.col("__dn")).alias("bearing"))


def path_length(tracks: DataFrame, track: str = "track_id", order: str = "rn", chunk: int = 1 << 16) -> DataFrame:
    """For each track the length of its path, its bounds, and its first and last time and number of points. ``chunk``
    is as in with_previous."""
    from ..functions.geodesy import haversine_3d

    place = ("latitude", "longitude", "altitude")
    rows = with_previous(tracks.withColumn("__at", F.struct(*place)), track, order, "__at", "__last", chunk)
    leg = haversine_3d(*(F.col("__last")[c] for c in place), *map(F.col, place))
    return (
        rows.withColumn("__leg", leg)
        .groupBy(track)
        .agg(
            F.count(F.lit(1)).alias("total_points"),
            F.coalesce(F.sum("__leg"), F.lit(0.0)).alias("total_distance"),
            *(f(c).alias(f"{n}_{k}") for n, f in (("min", F.min), ("max", F.max)) for c, k in (("longitude", "lon"), ("latitude", "lat"), ("altitude", "alt"))),
            F.min_by("t", order).alias("start_t"),
            F.max_by("t", order).alias("end_t"),
        )
    )


def accepted_solutions(samples: DataFrame, tracks: DataFrame, key: str = "track_id", at: str = "index", most_error: float = 1.0, least_tracks: int = 60, least_inliers: int = 200, least_baseline: float = 0.8) -> DataFrame:
    """Samples (key, index, baseline) with enough support: of feature tracks (key, index, forward, backward error, inlier)
    those whose way there and back ends less than ``most_error`` pixels off count; there must be ``least_tracks`` of
    them, and ``least_inliers`` that fit one homography, over a baseline long enough. With n_tracks and n_inliers."""
    held = tracks.filter(F.col("fb_error") < most_error).groupBy(key, at).agg(F.count(F.lit(1)).alias("n_tracks"), F.count_if("inlier").alias("n_inliers"))
    rows = samples.filter(F.col("baseline") >= least_baseline).join(held, [key, at])
    return rows.filter((F.col("n_tracks") >= least_tracks) & (F.col("n_inliers") >= least_inliers))
