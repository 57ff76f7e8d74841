"""Queries over tracks: kinematics, distances, lookups, fusion. Each has the same query in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asof, kinematics, robust
from . import bindings as b

QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r(c, n: int):
    return F.round(c, n)


@query(f"WITH {b.KINEMATICS} SELECT track_id, rn, round(sp, 4) AS ground_speed, round(vu_, 4) AS vertical_speed, round(course, 3) AS course, round(quality, 4) AS course_quality FROM (SELECT *, CASE WHEN ok THEN vu ELSE 0 END AS vu_ FROM kin)")
def track_kinematics(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = b.kinematics(spark, sf_dir)
    return k.select("track_id", "rn", r("ground_speed", 4).alias("ground_speed"), r("vertical_speed", 4).alias("vertical_speed"), r("course", 3).alias("course"), r("course_quality", 4).alias("course_quality"))


@query(f"WITH {b.KINEMATICS} SELECT track_id, round(avg(sp), 4) AS mean_speed, round(stddev_pop(sp), 4) AS std_speed, round(median(sp), 4) AS median_speed, round(max(sp), 4) AS max_speed, count(*) AS n FROM kin GROUP BY track_id")
def track_speed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = b.kinematics(spark, sf_dir), "ground_speed"
    return k.groupBy("track_id").agg(r(F.avg(s), 4).alias("mean_speed"), r(F.stddev_pop(s), 4).alias("std_speed"), r(F.median(s), 4).alias("median_speed"), r(F.max(s), 4).alias("max_speed"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {b.KINEMATICS} SELECT track_id, n, round((degrees(atan2(s, c)) + 360) % 360, 3) AS mean_course, round(degrees(sqrt(-2 * ln(least(1.0, greatest(1e-12, sqrt(s * s + c * c)))))), 3) AS std_course
FROM (SELECT track_id, count(*) AS n, avg(sin(radians(course))) AS s, avg(cos(radians(course))) AS c FROM kin WHERE course IS NOT NULL GROUP BY track_id)""")
def track_course_circular(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = kinematics.circular_stats(b.kinematics(spark, sf_dir), "course", "track_id")
    return c.select("track_id", "n", r("mean", 3).alias("mean_course"), r("std", 3).alias("std_course"))


@query(f"""WITH {b.KINEMATICS}, v AS (SELECT track_id, rn, t, course, lag(course) OVER w AS pc, lead(course) OVER w AS nc, t - lag(t) OVER w AS h, lead(t) OVER w - t AS k
  FROM kin WHERE course IS NOT NULL WINDOW w AS (PARTITION BY track_id ORDER BY rn)),
d AS (SELECT *, ((course - pc + 540 + 360) % 360) - 180 AS a, ((nc - course + 540 + 360) % 360) - 180 AS b FROM v)
SELECT track_id, rn, round(coalesce((h * h * b + k * k * a) / (h * k * (h + k)), b / k, a / h), 3) AS heading_change FROM d""")
def track_turn_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = kinematics.turn_rate(b.kinematics(spark, sf_dir)).filter("course IS NOT NULL")
    return t.select("track_id", "rn", r("heading_change", 3).alias("heading_change"))


@query(f"""WITH {b.TRACKS}, legs AS (SELECT *, sin(radians(latitude - lag(latitude) OVER w) / 2) AS sp, sin(radians(longitude - lag(longitude) OVER w) / 2) AS sl, cos(radians(latitude)) * cos(radians(lag(latitude) OVER w)) AS cc, altitude - lag(altitude) OVER w AS da
  FROM tracks WINDOW w AS (PARTITION BY track_id ORDER BY rn)), l AS (SELECT *, sp * sp + cc * sl * sl AS a FROM legs)
SELECT track_id, count(*) AS total_points, round(coalesce(sum(sqrt(pow(2 * 6371000 * atan2(sqrt(a), sqrt(1 - a)), 2) + da * da)), 0), 2) AS total_distance,
  round(min(longitude), 6) AS min_lon, round(min(latitude), 6) AS min_lat, round(min(altitude), 2) AS min_alt, round(max(longitude), 6) AS max_lon, round(max(latitude), 6) AS max_lat, round(max(altitude), 2) AS max_alt,
  round(arg_min(t, rn), 4) AS start_t, round(arg_max(t, rn), 4) AS end_t FROM l GROUP BY track_id""")
def track_distance_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = kinematics.path_length(b.tracks(spark, sf_dir))
    digits = {"total_distance": 2, "min_lon": 6, "min_lat": 6, "min_alt": 2, "max_lon": 6, "max_lat": 6, "max_alt": 2, "start_t": 4, "end_t": 4}
    return p.select("track_id", "total_points", *(r(c, n).alias(c) for c, n in digits.items()))


@query(f"""WITH {b.ENU}, s AS (SELECT track_id, rn, avg(east) OVER n AS e, avg(north) OVER n AS no, row_number() OVER l - 1 AS i FROM enu WINDOW n AS (PARTITION BY track_id ORDER BY rn ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), l AS (PARTITION BY track_id ORDER BY rn)),
d AS (SELECT *, e - lag(e, 8) OVER l AS de, no - lag(no, 8) OVER l AS dn FROM s WINDOW l AS (PARTITION BY track_id ORDER BY rn))
SELECT track_id, i AS index, round(sqrt(de * de + dn * dn), 4) AS baseline, round((degrees(atan2(de, dn)) + 360) % 360, 3) AS bearing FROM d WHERE i % 4 = 0 AND sqrt(de * de + dn * dn) >= 0.8""")
def rolling_baseline_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = kinematics.baseline_samples(b.enu(spark, sf_dir))
    return s.select("track_id", F.col("index").cast("long").alias("index"), r("baseline", 4).alias("baseline"), r("bearing", 3).alias("bearing"))


@query(f"""WITH {b.TELEMETRY}, q AS (SELECT track_id, rn, (rn - 1) * 0.05::DOUBLE + 0.013 AS q_at FROM tracks),
p AS (SELECT q.*, t.pos AS p_pos, t.start_sec AS ps, t.end_sec AS pe, t.mid_sec AS pm FROM q ASOF LEFT JOIN telemetry t ON q.track_id = t.track_id AND q.q_at > t.start_sec),
n AS (SELECT p.*, t.pos AS n_pos, t.start_sec AS ns, t.end_sec AS ne, t.mid_sec AS nm FROM p ASOF LEFT JOIN telemetry t ON p.track_id = t.track_id AND p.q_at <= t.start_sec)
SELECT track_id, rn, round(q_at, 4) AS at_sec, CASE WHEN p_pos IS NULL THEN n_pos WHEN n_pos IS NULL THEN p_pos WHEN q_at BETWEEN ps AND pe THEN p_pos WHEN q_at BETWEEN ns AND ne THEN n_pos WHEN abs(pm - q_at) <= abs(nm - q_at) THEN p_pos ELSE n_pos END AS pos FROM n""")
def asof_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = b.tracks(spark, sf_dir).select("track_id", "rn", ((F.col("rn") - 1) * 0.05 + 0.013).alias("at"))
    found = asof.asof_interval(targets, b.telemetry(spark, sf_dir))
    return found.select("track_id", "rn", r("at", 4).alias("at_sec"), F.col("match.pos").alias("pos"))


@query(f"""WITH {b.TELEMETRY}, q AS (SELECT track_id, rn + 3 AS frame FROM tracks), f AS (SELECT track_id, frame_cnt, arg_min(start_sec, pos) AS s FROM telemetry WHERE frame_cnt IS NOT NULL GROUP BY ALL)
SELECT q.track_id, q.frame, round(CASE WHEN p.frame_cnt = q.frame THEN p.start_sec WHEN f.frame_cnt IS NOT NULL THEN f.s ELSE p.start_sec END, 4) AS start_sec
FROM q LEFT JOIN telemetry p ON p.track_id = q.track_id AND p.pos = q.frame LEFT JOIN f ON f.track_id = q.track_id AND f.frame_cnt = q.frame""")
def frame_lookup_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = b.tracks(spark, sf_dir).select("track_id", (F.col("rn") + 3).alias("frame"))
    found = asof.frame_lookup(targets, b.telemetry(spark, sf_dir), value="start_sec")
    return found.select("track_id", "frame", r("start_sec", 4).alias("start_sec"))


@query(f"""WITH {b.TRACKS}, ids AS (SELECT track_id, rn AS id, altitude FROM tracks WHERE rn % 9 = 4), p AS (SELECT t.track_id, t.rn, i.id AS pi, i.altitude AS pa FROM tracks t ASOF LEFT JOIN ids i ON t.track_id = i.track_id AND t.rn >= i.id),
n AS (SELECT p.*, i.id AS ni, i.altitude AS na FROM p ASOF LEFT JOIN ids i ON p.track_id = i.track_id AND p.rn <= i.id)
SELECT track_id, rn, CASE WHEN pi IS NULL THEN ni WHEN ni IS NULL OR rn - pi <= ni - rn THEN pi ELSE ni END AS id, round(CASE WHEN pi IS NULL THEN na WHEN ni IS NULL OR rn - pi <= ni - rn THEN pa ELSE na END, 4) AS altitude FROM n""")
def attitude_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.tracks(spark, sf_dir)
    ids = rows.filter("rn % 9 = 4").select("track_id", F.col("rn").alias("id"), "altitude")
    found = asof.nearest(rows.select("track_id", F.col("rn").alias("target")), ids)
    return found.select("track_id", F.col("target").alias("rn"), F.col("match.id").alias("id"), r("match.altitude", 4).alias("altitude"))


@query(f"""WITH {b.TRACKS}, s AS (SELECT track_id, rn AS idx, altitude FROM tracks WHERE rn % 7 = 3), p AS (SELECT t.track_id, t.rn, s.idx AS pi, s.altitude AS pa FROM tracks t ASOF LEFT JOIN s ON t.track_id = s.track_id AND t.rn >= s.idx),
n AS (SELECT p.*, s.idx AS ni, s.altitude AS na FROM p ASOF LEFT JOIN s ON p.track_id = s.track_id AND p.rn <= s.idx)
SELECT track_id, rn AS idx, round(CASE WHEN pi IS NULL THEN na WHEN ni IS NULL OR ni = pi THEN pa ELSE pa + (na - pa) / (ni - pi) * (rn - pi) END, 4) AS altitude FROM n""")
def sample_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.tracks(spark, sf_dir)
    samples = rows.filter("rn % 7 = 3").select("track_id", F.col("rn").alias("idx"), "altitude")
    found = asof.interpolate(rows.select("track_id", F.col("rn").alias("idx")), samples, ["altitude"])
    return found.select("track_id", "idx", r("altitude", 4).alias("altitude"))


MAD = b.VISUAL + """, med AS (SELECT track_id, median(pitch) AS pm, median(roll) AS rm, median(agl) AS am, count(*) AS n FROM samples GROUP BY track_id),
mad AS (SELECT track_id, median(abs(pitch - pm)) AS pd, median(abs(roll - rm)) AS rd, median(abs(agl - am)) AS ad FROM samples JOIN med USING (track_id) GROUP BY track_id),
checked AS (SELECT *, (n < 4 OR pd < 1e-9 OR abs(pitch - pm) <= 4 * 1.4826::DOUBLE * pd) AS pitch_ok, (n < 4 OR rd < 1e-9 OR abs(roll - rm) <= 4 * 1.4826::DOUBLE * rd) AS roll_ok, (n < 4 OR ad < 1e-9 OR abs(agl - am) <= 4 * 1.4826::DOUBLE * ad) AS agl_ok FROM samples JOIN med USING (track_id) JOIN mad USING (track_id))"""


@query(f"WITH {MAD} SELECT track_id, idx, pitch_ok, roll_ok, agl_ok FROM checked")
def mad_inliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust.mad_inliers(b.visual_samples(spark, sf_dir), ["pitch", "roll", "agl"], "track_id").select("track_id", "idx", "pitch_ok", "roll_ok", "agl_ok")


def _five(c: str) -> str:
    return f"CASE WHEN n < 5 THEN {c} ELSE list_sort([coalesce(lag({c}, 2) OVER l, first({c}) OVER a), coalesce(lag({c}, 1) OVER l, first({c}) OVER a), {c}, coalesce(lead({c}, 1) OVER l, last({c}) OVER a), coalesce(lead({c}, 2) OVER l, last({c}) OVER a)])[3] END"


_FRAMES = "WINDOW l AS (PARTITION BY track_id ORDER BY idx), a AS (PARTITION BY track_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


@query(f"WITH {b.VISUAL} SELECT track_id, idx, round({_five('pitch')}, 4) AS pitch FROM (SELECT *, count(*) OVER (PARTITION BY track_id) AS n FROM samples) {_FRAMES}")
def median_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = robust.median_smooth(b.visual_samples(spark, sf_dir), ["pitch"])
    return s.select("track_id", "idx", r("pitch", 4).alias("pitch"))


def _lerp(c: str) -> str:
    return f"CASE WHEN pi IS NULL THEN n_{c} WHEN ni IS NULL OR ni = pi THEN p_{c} ELSE p_{c} + (n_{c} - p_{c}) / (ni - pi) * (rn - pi) END"


def _interp(source: str, names: list[str]) -> str:
    pick = lambda k: ", ".join(f"s.{c} AS {k}_{c}" for c in names)
    return f"""ip AS (SELECT t.track_id, t.rn, s.idx AS pi, {pick("p")} FROM tracks t ASOF LEFT JOIN {source} s ON t.track_id = s.track_id AND t.rn >= s.idx),
inn AS (SELECT ip.*, s.idx AS ni, {pick("n")} FROM ip ASOF LEFT JOIN {source} s ON ip.track_id = s.track_id AND ip.rn <= s.idx)"""


@query(f"""WITH {b.VISUAL}, sc AS (SELECT track_id, idx, sin(radians(yaw)) AS ys, cos(radians(yaw)) AS yc, count(*) OVER (PARTITION BY track_id) AS n FROM samples), sm AS (SELECT track_id, idx, {_five("ys")} AS ys, {_five("yc")} AS yc FROM sc {_FRAMES}),
{_interp("sm", ["ys", "yc"])} SELECT track_id, rn AS idx, round((degrees(atan2({_lerp("ys")}, {_lerp("yc")})) + 360) % 360, 2) AS yaw FROM inn""")
def angle_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = b.tracks(spark, sf_dir).select("track_id", F.col("rn").alias("idx"))
    s = robust.smooth_interpolate(targets, b.visual_samples(spark, sf_dir), "yaw", angle=True)
    return s.select("track_id", "idx", r("yaw", 2).alias("yaw"))


@query(f"""WITH {MAD}, kept AS (SELECT track_id, idx, pitch, roll, agl, sin(radians(yaw)) AS ys, cos(radians(yaw)) AS yc, count(*) OVER (PARTITION BY track_id) AS n FROM (
  SELECT *, pitch_ok AND roll_ok AND agl_ok AS ok, count(*) FILTER (WHERE pitch_ok AND roll_ok AND agl_ok) OVER (PARTITION BY track_id) AS oks FROM checked) WHERE ok OR oks < 4),
sm AS (SELECT track_id, idx, {", ".join(f"{_five(c)} AS {c}" for c in ("pitch", "roll", "agl", "ys", "yc"))} FROM kept {_FRAMES}), span AS (SELECT track_id, min(idx) AS lo, max(idx) AS hi FROM kept GROUP BY track_id),
{_interp("sm", ["pitch", "roll", "agl", "ys", "yc"])}
SELECT inn.track_id, rn AS idx, round({_lerp("pitch")}, 3) AS camera_pitch, round({_lerp("roll")}, 3) AS camera_roll, round((degrees(atan2({_lerp("ys")}, {_lerp("yc")})) + 360) % 360, 2) AS camera_yaw, round({_lerp("agl")}, 2) AS agl_m,
 CASE WHEN {_lerp("pitch")} IS NULL THEN 'gps-track' WHEN rn BETWEEN lo AND hi THEN 'visual-homography' ELSE 'visual-extrapolated' END AS attitude_source FROM inn LEFT JOIN span USING (track_id)""")
def fuse_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = b.tracks(spark, sf_dir).select("track_id", F.col("rn").alias("idx"))
    f = robust.fuse_attitude(frames, b.visual_samples(spark, sf_dir))
    return f.select("track_id", "idx", r("camera_pitch", 3).alias("camera_pitch"), r("camera_roll", 3).alias("camera_roll"), r("camera_yaw", 2).alias("camera_yaw"), r("agl_m", 2).alias("agl_m"), "attitude_source")
