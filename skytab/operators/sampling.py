"""Frame sampling: which frames of a video to take, by interval, by rate or by step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frame_targets(videos: DataFrame, interval_sec: float | None = None, fps: float | None = None, frame_step: int = 1, start_sec: float = 0.0, end_sec: float | None = None, max_frames: int | None = None) -> DataFrame:
    """``videos`` (fps, total_frames, keys) to rows (keys, ordinal, frame_idx, t_sec), frames from 0.

    An interval, or else a target rate, gives the times start + k step up to the end, the end
    included, and the nearest frame of each (ties to even); frames past the last are left out. Else
    every frame_step-th frame. max_frames keeps the first ones. Without a rate of its own a video lasts 0 s.
    """
    keys = [c for c in videos.columns if c not in ("fps", "total_frames")]
    duration = F.coalesce(F.when(F.col("fps") > 0, F.try_divide("total_frames", "fps")), F.lit(0.0))
    lo = F.lit(max(0.0, start_sec or 0.0))
    hi = F.least(duration, F.lit(float(end_sec))) if end_sec else duration
    rows = videos.withColumns({"__lo": lo, "__hi": hi})
    step = interval_sec if interval_sec and interval_sec > 0 else 1.0 / fps if fps and fps > 0 else None
    if step:
        last = F.floor((F.col("__hi") - F.col("__lo")) / step + 1e-9).cast("long")
        rows = rows.filter(F.col("__hi") >= F.col("__lo")).withColumn("ordinal", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        rows = rows.withColumn("t_sec", F.col("__lo") + F.col("ordinal") * step).withColumn("frame_idx", F.rint(F.col("t_sec") * F.col("fps")).cast("long"))
        rows = rows.filter(F.col("frame_idx") < F.col("total_frames"))
    else:
        first = F.rint(F.col("__lo") * F.col("fps")).cast("long")
        end = F.when(F.col("__hi") > 0, F.least(F.col("total_frames").cast("long"), F.rint(F.col("__hi") * F.col("fps")).cast("long"))).otherwise(F.col("total_frames").cast("long"))
        rows = rows.withColumns({"__f": first, "__e": end}).filter("__e > __f")
        rows = rows.select("*", F.posexplode(F.sequence("__f", F.col("__e") - 1, F.lit(max(1, frame_step)).cast("long"))).alias("ordinal", "frame_idx"))
        rows = rows.withColumns({"ordinal": F.col("ordinal").cast("long"), "t_sec": F.try_divide("frame_idx", "fps")})
    if max_frames:
        rows = rows.filter(F.col("ordinal") < max_frames)
    return rows.select(*keys, "ordinal", "frame_idx", "t_sec")


def last_per_frame(targets: DataFrame, *keys: str) -> DataFrame:
    """One row a frame: of times that fall on the same frame, the last."""
    return targets.groupBy(*keys, "frame_idx").agg(F.max_by("t_sec", "ordinal").alias("t_sec"))


def frame_filename(frame: Column, extension: str) -> Column:
    return F.format_string(f"frame_%06d.{'jpg' if extension == 'jpeg' else extension}", frame)


def positive_or(value: Column, default: float | int | None) -> Column:
    """A parameter given as text: blank, 'null', no number or not positive means the default."""
    from ..functions.text import as_double

    number = as_double(value)
    return F.when(number > 0, number).otherwise(F.lit(default))
