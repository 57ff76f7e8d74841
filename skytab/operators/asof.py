"""Lookups in ordered tables: by time interval, by frame number, by nearest id, with interpolation.

Each is a union of targets and rows with two running windows over it: linear in the rows, no pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut


def neighbours(targets: DataFrame, rows: DataFrame, key: str, target_at: str, row_at: str, row: str, strict: bool, chunk: int | None = None) -> DataFrame:
    """``targets`` with the structs prev and next of ``rows``: the last row before the target's place and
    the first one after it. strict: a row at the very place is next; else it is prev. Of rows at one
    place, prev is the last by the struct's order and next the first.

    Both come from frames that run along with the order, up for prev and down for next, so a row is
    looked at twice, however long its track. chunk: rows of a track that one task is to take, where
    tracks can be too long for one: places are cut at approximate quantiles, as many as the track's length asks for, and the
    last and the first row of each chunk are carried over to its neighbours.
    """
    a = targets.select("*", F.col(target_at).alias("__at"), F.lit(None).cast(rows.select(row).schema[0].dataType).alias("__row"), F.lit(0 if strict else 1).alias("__side"))
    b = rows.select(F.col(key), F.col(row_at).alias("__at"), F.col(row).alias("__row"), F.lit(1 if strict else 0).alias("__side"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("__target", F.col("__row").isNull())
    keys = [key]
    if chunk:
        both = cut(both, "both")
        size = both.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
        most = size.agg(F.max("__n")).first()[0] or 0
        k = 1 << max(0, -(-most // chunk) - 1).bit_length()  # for the longest track; shorter ones take every second, fourth, ...
        marks = both.join(size.filter(F.col("__n") > chunk), key).groupBy(key, "__n").agg(F.percentile_approx("__at", [i / k for i in range(1, k)] or [0.5], max(1000, 10 * k)).alias("__q"))
        own = F.pow(F.lit(2), F.floor(F.log2(F.lit(float(k)) * chunk / F.col("__n"))))
        some = F.filter("__q", lambda x, i: F.pmod(i + 1, F.greatest(F.lit(1), own).cast("int")) == 0)
        marks = marks.select(key, F.array_distinct(some).alias("__marks"))
        both = both.join(marks, key, "left").withColumn("__chunk", F.coalesce(F.size(F.filter("__marks", lambda m: m < F.col("__at"))), F.lit(0)))
        both, keys = cut(both.drop("__marks"), "chunked"), [key, "__chunk"]
    up = Window.partitionBy(*keys).orderBy("__at", "__side", "__row").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys).orderBy(F.desc("__at"), F.desc("__side"), F.desc("__row")).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("prev", F.last("__row", True).over(up)).withColumn("next", F.last("__row", True).over(down)).filter("__target")
    if chunk:
        place = F.struct("__at", "__side", "__row")
        ends = both.filter(~F.col("__target")).groupBy(*keys).agg(F.max(place).alias("hi"), F.min(place).alias("lo"))
        ends = both.select(*keys).distinct().join(ends, keys, "left")
        w = Window.partitionBy(key).orderBy("__chunk")
        before = F.last("hi.__row", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("__before")
        after = F.last("lo.__row", True).over(Window.partitionBy(key).orderBy(F.desc("__chunk")).rowsBetween(Window.unboundedPreceding, -1)).alias("__after")
        out = out.join(ends.select(*keys, before, after), keys).withColumns({"prev": F.coalesce("prev", "__before"), "next": F.coalesce("next", "__after")})
    return out.select(*targets.columns, "prev", "next")


def asof_interval(targets: DataFrame, telemetry: DataFrame, key: str = "track_id", at: str = "at", chunk: int | None = None) -> DataFrame:
    """``targets`` with ``match``: the telemetry struct (start_sec, end_sec, mid_sec, ...) for a time.

    The last row that starts before the time if its interval holds it, else the next one if that
    does, else the one with the nearer middle (the former on a tie); before the first start the
    first, after the last start the last, whatever their ends. chunk: see ``neighbours``.
    """
    columns = ["start_sec", "end_sec", "mid_sec", *(c for c in telemetry.columns if c not in (key, "start_sec", "end_sec", "mid_sec"))]
    rows = telemetry.select(key, F.col("start_sec").alias("__start"), F.struct(*columns).alias("__tel"))
    both = neighbours(targets, rows, key, at, "__start", "__tel", strict=True, chunk=chunk)
    t, p, n = F.col(at), F.col("prev"), F.col("next")
    match = (
        F.when(p.isNull(), n)
        .when(n.isNull(), p)
        .when(t.between(p["start_sec"], p["end_sec"]), p)
        .when(t.between(n["start_sec"], n["end_sec"]), n)
        .when(F.abs(p["mid_sec"] - t) <= F.abs(n["mid_sec"] - t), p)
        .otherwise(n)
    )
    return both.withColumn("match", match).drop("prev", "next")


def frame_lookup(targets: DataFrame, telemetry: DataFrame, key: str = "track_id", frame: str = "frame", pos: str = "pos", cnt: str = "frame_cnt", value: str = "value") -> DataFrame:
    """``targets`` with ``value`` of the telemetry row for a frame number: the row at that place if it
    bears the number, else the first row that does, else the row at that place."""
    at = telemetry.select(key, F.col(pos).alias(frame), F.col(cnt).alias("__cnt"), F.col(value).alias("__at"))
    first = telemetry.filter(F.col(cnt).isNotNull()).groupBy(key, F.col(cnt).alias(frame)).agg(F.min_by(value, pos).alias("__first"), F.lit(True).alias("__has"))
    both = targets.join(at, [key, frame], "left").join(first, [key, frame], "left")
    found = F.when(F.col("__cnt") == F.col(frame), F.col("__at")).when(F.col("__has"), F.col("__first")).otherwise(F.col("__at"))
    return both.select(*targets.columns, found.alias(value))


def frame_telemetry(targets: DataFrame, telemetry: DataFrame, key: str = "track_id", frame: str = "frame", at: str = "at", pos: str = "pos", cnt: str = "frame_cnt", chunk: int | None = None) -> DataFrame:
    """``targets`` with ``telemetry``: the row for the frame number, else the one for the time, and with
    latitude, longitude and altitude of it, 0.0 where there is none or it lacks them."""
    columns = ["start_sec", "end_sec", "mid_sec", *(c for c in telemetry.columns if c not in (key, "start_sec", "end_sec", "mid_sec"))]
    by_frame = frame_lookup(targets, telemetry.withColumn("telemetry", F.struct(*columns)), key, frame, pos, cnt, "telemetry")
    both = asof_interval(by_frame, telemetry, key, at, chunk).withColumn("telemetry", F.coalesce("telemetry", "match"))
    zero = {c: F.coalesce(F.col(f"telemetry.{c}"), F.lit(0.0)) for c in ("latitude", "longitude", "altitude")}
    return both.withColumns(zero).select(*targets.columns, "telemetry", *zero)


def nearest(targets: DataFrame, rows: DataFrame, key: str = "track_id", target_id: str = "target", row_id: str = "id", chunk: int | None = None) -> DataFrame:
    """``targets`` with ``match``: the row struct with the nearest id, the lower one on a tie; of rows
    that repeat an id the last (by the struct's order) counts."""
    packed = rows.groupBy(key, row_id).agg(F.max(F.struct(row_id, *(c for c in rows.columns if c not in (key, row_id)))).alias("__r"))
    both = neighbours(targets, packed, key, target_id, row_id, "__r", strict=False, chunk=chunk)
    p, n, t = F.col("prev"), F.col("next"), F.col(target_id)
    match = F.when(p.isNull(), n).when(n.isNull(), p).when(t - p[row_id] <= n[row_id] - t, p).otherwise(n)
    return both.withColumn("match", match).drop("prev", "next")


def interpolate(targets: DataFrame, samples: DataFrame, columns: list[str], key: str = "track_id", at: str = "idx", chunk: int | None = None) -> DataFrame:
    """``targets`` with ``columns`` of ``samples`` (key, at, ...) interpolated linearly, held flat beyond the ends."""
    packed = samples.select(key, at, F.struct(at, *columns).alias("__s"))
    both = neighbours(targets, packed, key, at, at, "__s", strict=False, chunk=chunk)
    p, n, t = F.col("prev"), F.col("next"), F.col(at)
    out = {}
    for c in columns:
        slope = (n[c] - p[c]) / F.when(n[at] != p[at], n[at] - p[at])
        out[c] = F.when(p.isNull(), n[c]).when(n.isNull() | (n[at] == p[at]), p[c]).otherwise(p[c] + slope * (t - p[at]))
    return both.withColumns(out).drop("prev", "next")
