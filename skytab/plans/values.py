"""Queries over expressions of a single row: parameters, attitudes, image metadata, bands, windows, homographies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import camera
from ..operators import mosaic, robust, sampling
from ..sources import files
from . import bindings as b
from .tracks import r

QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


_TEXTS = "CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'null' WHEN 2 THEN ' ' || k || '.5 ' WHEN 3 THEN '-' || k WHEN 4 THEN k || 'x' WHEN 5 THEN k || 'e-1' END"


@query(f"WITH {b.IMAGES}, p AS (SELECT event_id, trim({_TEXTS}) AS v FROM images) SELECT event_id, CASE WHEN regexp_full_match(v, '[-+]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][-+]?[0-9]+)?') AND TRY_CAST(v AS DOUBLE) > 0 THEN CAST(v AS DOUBLE) ELSE 1.0 END AS interval_sec FROM p")
def given_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters as they come: blank, 'null', negative, no number, in exponents."""
    return b.images(spark, sf_dir).select("event_id", sampling.positive_or(F.expr(_TEXTS), 1.0).alias("interval_sec"))


@query(f"WITH {b.IMAGES} SELECT event_id, CASE WHEN k % 2 = 0 OR k % 3 > 0 THEN yaw END AS yaw, CASE WHEN k % 5 > 0 THEN pitch WHEN k % 3 > 0 THEN -80.0 END AS pitch, CASE WHEN k % 4 = 0 THEN roll WHEN k % 3 > 0 AND k % 7 > 0 THEN 1.5 END AS roll FROM (SELECT * REPLACE (CASE WHEN k % 2 = 0 THEN yaw ELSE 12.25::DOUBLE END AS yaw) FROM images)")
def filled_attitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry without a yaw, pitch or roll now and then, and cameras of which two in three know their pitch."""
    k = F.col("k")
    rows = b.images(spark, sf_dir).select("event_id", F.when(k % 2 == 0, F.col("yaw")).alias("yaw"), F.when(k % 5 > 0, F.col("pitch")).alias("pitch"), F.when(k % 4 == 0, F.col("roll")).alias("roll"), F.lit(12.25).alias("camera_yaw"), F.when(k % 3 > 0, -80.0).alias("camera_pitch"), F.when(k % 7 > 0, 1.5).alias("camera_roll"))
    return robust.fill_attitude(rows).select("event_id", "yaw", "pitch", "roll")


_XMP = """concat(CASE WHEN k % 3 = 0 THEN concat('drone-dji:GimbalPitchDegree="', CASE WHEN k % 2 = 0 THEN 'unknown' ELSE concat('-', CAST(k % 90 AS STRING), '.50') END, '" ') ELSE '' END, CASE WHEN k % 4 = 0 THEN concat('Camera:Pitch="-7.25" Camera:Yaw="', CAST(k AS STRING), '" ') ELSE '' END, CASE WHEN k % 5 = 0 THEN 'drone-dji:RelativeAltitude="+0.00"' WHEN k % 5 = 1 THEN 'drone-dji:RelativeAltitude="+33.10" drone-dji:AbsoluteAltitude="+214.71"' ELSE '' END)"""
_NOTE = """CASE WHEN k % 7 > 3 THEN concat('{"pitch": ', CASE WHEN k % 2 = 0 THEN 'null' ELSE '-45.5' END, ', "yaw": 77.5, "roll": ', CAST(k % 9 AS STRING), ', "agl_m": 12.0}') WHEN k % 7 = 3 THEN 'no json' END"""


@query(f"""WITH {b.IMAGES}, i AS (SELECT *, CASE WHEN k % 3 = 0 AND k % 2 = 1 THEN -(k % 90) - 0.5::DOUBLE WHEN k % 4 = 0 THEN -7.25 WHEN k % 7 > 3 AND k % 2 = 1 THEN -45.5 END AS known, CASE k % 5 WHEN 0 THEN 0 WHEN 1 THEN 33.1::DOUBLE ELSE CASE WHEN k % 7 > 3 THEN 12 END END AS above FROM images)
SELECT event_id, event_id || '.JPG' AS filename, CASE WHEN k % 5 = 1 THEN 214.71 WHEN k % 8 > 0 THEN agl ELSE 100 END::DOUBLE AS altitude_m, CASE WHEN k % 6 > 0 THEN focal ELSE 24 END AS focal_length_mm, CASE WHEN k % 4 = 0 THEN k WHEN k % 7 > 3 THEN 77.5 WHEN k % 10 > 0 THEN yaw ELSE 0 END::DOUBLE AS yaw_deg,
 coalesce(known, -90)::DOUBLE AS pitch_deg, CASE WHEN k % 7 > 3 THEN k % 9 ELSE 0 END::DOUBLE AS roll_deg, above::DOUBLE AS agl_m, known IS NOT NULL AND coalesce(above > 0, false) AS pose_is_known FROM i WHERE event_id % 9 > 0""")
def image_infos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What images say of themselves: XMP before the comment, that before EXIF, then the defaults; no position, no row."""
    k, none = F.col("k"), F.lit(None)
    raw = b.images(spark, sf_dir).select(
        "event_id",
        F.concat(F.lit("file:/flight/"), F.col("event_id").cast("string"), F.lit(".JPG")).alias("path"),
        "width",
        "height",
        F.when(F.col("event_id") % 9 > 0, F.col("latitude")).alias("latitude"),
        "longitude",
        F.when(k % 8 > 0, F.col("agl")).alias("gps_altitude"),
        F.when(k % 6 > 0, F.col("focal")).alias("focal_length"),
        none.cast("double").alias("focal_35mm"),
        F.when(k % 10 > 0, F.col("yaw")).alias("direction"),
        none.cast("string").alias("taken"),
        F.expr(_NOTE).alias("comment"),
        F.expr(_XMP).alias("xmp"),
    )
    rows = files.resolve_image_info(raw)
    return rows.select(F.regexp_extract("filename", r"^(\d+)", 1).cast("long").alias("event_id"), "filename", "altitude_m", "focal_length_mm", "yaw_deg", "pitch_deg", "roll_deg", "agl_m", "pose_is_known")


_BANDS = ("k * 7 % 256", "event_id % 256", "v * 37 % 256")


@query(f"WITH {b.IMAGES.replace('SELECT event_id, track_id, k, 3840', 'SELECT event_id, track_id, k, v, 3840')} SELECT event_id, {', '.join(f'round((({v}) / 255.0::DOUBLE - {m}) / {s}, 6) AS {n}' for n, v, m, s in zip(('red', 'green', 'blue'), _BANDS, mosaic.BAND_MEAN, mosaic.BAND_STD))} FROM images")
def normalised_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.floor("value").cast("long").alias("v"))
    n = mosaic.normalise_bands(F.array(*(F.expr(f"CAST({x} AS DOUBLE)") for x in _BANDS)))
    return rows.select("event_id", n.alias("n")).select("event_id", *(r(F.col("n")[k], 6).alias(c) for k, c in enumerate(("red", "green", "blue"))))


@query(f"""WITH {b.IMAGES}, s AS (SELECT track_id, CASE event_id % 3 WHEN 0 THEN 20 WHEN 1 THEN 24 ELSE 28 END AS focal, 1000.0::DOUBLE AS vx, -8000.0::DOUBLE AS vy, (k * 13 % 2000)::DOUBLE AS x1, (k * 29 % 900)::DOUBLE AS y1, (k * 13 % 2000 + event_id % 5 - 2)::DOUBLE AS x2, (k * 29 % 900 + 40 + k)::DOUBLE AS y2 FROM images),
g AS (SELECT *, x2 - x1 AS ax, y2 - y1 AS ay, vx - (x1 + x2) / 2 AS bx, vy - (y1 + y2) / 2 AS by_ FROM s),
h AS (SELECT track_id, focal, sum(CASE WHEN degrees(asin(least(1.0::DOUBLE, abs(ax * by_ - ay * bx) / (sqrt(ax * ax + ay * ay) * sqrt(bx * bx + by_ * by_))))) < 1.2 THEN sqrt(ax * ax + ay * ay) ELSE 0 END) AS support FROM g GROUP BY track_id, focal)
SELECT track_id, focal, round(support, 4) AS support, row_number() OVER (PARTITION BY track_id ORDER BY support DESC, focal) = 1 AS best FROM h""")
def focal_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of three focal lengths the most line segments of a flight speak for."""
    k, e = F.col("k"), F.col("event_id")
    x, y = k * 13 % 2000, k * 29 % 900
    whole = lambda c, n: c.cast("double").alias(n)
    rows = b.images(spark, sf_dir).select("track_id", F.when(e % 3 == 0, 20).when(e % 3 == 1, 24).otherwise(28).alias("focal"), F.lit(1000.0).alias("vx"), F.lit(-8000.0).alias("vy"), whole(x, "x1"), whole(y, "y1"), whole(x + e % 5 - 2, "x2"), whole(y + 40 + k, "y2"))
    return mosaic.vertical_support(rows, "track_id").select("track_id", "focal", r("support", 4).alias("support"), "best")


@query(f"""WITH {b.IMAGES}, c AS (SELECT event_id, (event_id % 971)::DOUBLE - 60 AS east, 800 - (event_id % 877)::DOUBLE AS north, agl * 1.5::DOUBLE AS radius FROM images)
SELECT event_id, {', '.join(f"greatest(0, least({n}, {f}(({x}) / 2.5::DOUBLE)))::INT AS {c}" for c, n, f, x in (('col0', 300, 'floor', 'east - radius'), ('col1', 300, 'ceil', 'east + radius'), ('row0', 280, 'floor', '700 - north - radius'), ('row1', 280, 'ceil', '700 - north + radius')))} FROM c""")
def coverage_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a canvas of 300 x 280 that each camera may reach; some cameras are beyond its edges."""
    e = F.col("event_id")
    w = mosaic.coverage_window((e % 971).cast("double") - 60, 800 - (e % 877).cast("double"), F.col("agl") * 1.5, F.lit(0.0), F.lit(700.0), F.lit(2.5), F.lit(300), F.lit(280))
    return b.images(spark, sf_dir).select("event_id", *(c.alias(n) for n, c in w.items()))


# a homography between previews for each image, and the two scales of preview to whole
_H = ("1 + k / 100", "k / 50", "k * 3", "-k / 40", "1 - k / 200", "v % 97", "k / 100000", "-k / 200000", "1")
_FROM, _TO = "1 / (2.0 + event_id % 3)", "1 / (2.0 + event_id % 5)"
_AS_DOUBLE = [h.replace("k /", "k * 1.0e0 /").replace("1 ", "1.0e0 ") for h in _H]


@query(f"""WITH i AS (SELECT event_id, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INT) AS k, CAST(floor(value) AS BIGINT) AS v FROM events), h AS (SELECT event_id, 1 / (2.0::DOUBLE + event_id % 3) AS a, 1 / (2.0::DOUBLE + event_id % 5) AS z, {', '.join(f"({x})::DOUBLE AS h{n}" for n, x in enumerate(_AS_DOUBLE))} FROM i),
p AS (SELECT *, 640.1::DOUBLE * a AS px, 480.3::DOUBLE * a AS py FROM h), q AS (SELECT *, h6 * px + h7 * py + h8 AS d FROM p) SELECT event_id, round((h0 * px + h1 * py + h2) / d / z, 5) AS x, round((h3 * px + h4 * py + h5) / d / z, 5) AS y FROM q""")
def rescaled_homography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the rescaled homography takes a point of the whole image; the oracle goes by way of the previews."""
    rows = b.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.floor("value").cast("long").alias("v"))
    real = lambda n: 1 / (2.0 + F.col("event_id") % n)
    m = mosaic.rescale_homography(F.array(*(F.expr(f"CAST({x} AS DOUBLE)") for x in _AS_DOUBLE)), real(3), real(5))
    rows = rows.select("event_id", m.alias("m"))
    row = lambda k: F.col("m")[k] * 640.1 + F.col("m")[k + 1] * 480.3 + F.col("m")[k + 2]
    return rows.select("event_id", r(row(0) / row(6), 5).alias("x"), r(row(3) / row(6), 5).alias("y"))


@query(f"""WITH {b.IMAGES}, s AS (SELECT event_id, (k % 7 - 3)::DOUBLE AS d0, (k % 5 + 1)::DOUBLE AS d1, (k % 3 + 2)::DOUBLE AS d2, (event_id % 5 - 2)::DOUBLE AS t0, (event_id % 3 - 1)::DOUBLE AS t1, CASE WHEN event_id % 5 = 2 AND event_id % 3 = 1 THEN 0 ELSE (event_id % 4)::DOUBLE END AS t2, radians(yaw + 0.37) AS a FROM images),
l AS (SELECT *, t0 - g * d0 AS h0, t1 - g * d1 AS h1, t2 - g * d2 AS h2 FROM (SELECT *, (t0 * d0 + t1 * d1 + t2 * d2) / (d0 * d0 + d1 * d1 + d2 * d2) AS g FROM s)),
z AS (SELECT *, h2 AS along, (d0 * h1 - d1 * h0) / sqrt(d0 * d0 + d1 * d1 + d2 * d2) AS across FROM l)
SELECT event_id, CASE WHEN h0 * h0 + h1 * h1 + h2 * h2 > 1e-9 THEN round((degrees(atan2(along * sin(a) + across * cos(a), along * cos(a) - across * sin(a))) + 360) % 360, 4) END AS yaw FROM z""")
def yaw_of_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cameras that see down and the direction of flight; of some the motion is null or points down."""
    k, e = F.col("k"), F.col("event_id")
    real = lambda c: c.cast("double")
    still = (e % 5 == 2) & (e % 3 == 1)
    down = [real(k % 7 - 3), real(k % 5 + 1), real(k % 3 + 2)]
    motion = [real(e % 5 - 2), real(e % 3 - 1), F.when(still, 0.0).otherwise(real(e % 4))]
    return b.images(spark, sf_dir).select("event_id", r(camera.yaw_from_motion(down, motion, F.col("yaw") + 0.37), 4).alias("yaw"))
