"""Queries over grids, seams, boxes under homographies, losses and EXIF values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import camera
from ..operators import exif, mosaic, points
from . import bindings as b
from .objects import _INSTANCES, _LABELS, _PAIRS, _PIXELS, _instances, _labels, _pixels
from .tracks import r

QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT p_partkey, round(CASE WHEN side > 16000 THEN gsd * side / 16000 ELSE gsd END, 6) AS gsd, greatest(ceil(w / (CASE WHEN side > 16000 THEN gsd * side / 16000 ELSE gsd END)), 1)::BIGINT AS width, greatest(ceil(h / (CASE WHEN side > 16000 THEN gsd * side / 16000 ELSE gsd END)), 1)::BIGINT AS height
 FROM (SELECT *, greatest(ceil(w / gsd), ceil(h / gsd)) AS side FROM (SELECT p_partkey, p_size * 13.7::DOUBLE AS w, p_retailprice / 3.1::DOUBLE AS h, 0.03::DOUBLE AS gsd FROM part))""")
def canvas_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.lit(0.0)
    gsd, w, h = points.canvas_size(zero, zero, F.col("p_size") * 13.7, F.col("p_retailprice") / 3.1, F.lit(0.03))
    return b.table(spark, sf_dir, "part").select("p_partkey", r(gsd, 6).alias("gsd"), w.cast("long").alias("width"), h.cast("long").alias("height"))


_BOXES = f"{b.IMAGES}, f AS (SELECT track_id, event_id AS frame, lo::DOUBLE AS x1, la::DOUBLE AS y1, lo + agl AS x2, la + agl / 2 AS y2 FROM images)"


@query(f"""WITH {_BOXES}, o AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY frame) AS n FROM f)
SELECT p.track_id, p.frame AS i, q.frame AS j FROM o p JOIN o q ON p.track_id = q.track_id AND q.n IN (p.n + 1, p.n + 2) AND p.x2 + 40 > q.x1 - 40 AND q.x2 + 40 > p.x1 - 40 AND p.y2 + 40 > q.y1 - 40 AND q.y2 + 40 > p.y1 - 40""")
def seam_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.images(spark, sf_dir).select("track_id", F.col("event_id").alias("frame"), F.col("lo").cast("double").alias("x1"), F.col("la").cast("double").alias("y1"), (F.col("lo") + F.col("agl")).alias("x2"), (F.col("la") + F.col("agl") / 2).alias("y2"))
    return mosaic.seam_neighbours(rows, padding=40.0)


_H = "[1 + (instance % 5) / 100.0::DOUBLE, 0.02::DOUBLE, instance % 7 - 3, -0.03::DOUBLE, 1.0::DOUBLE, instance % 4 - 2, 0.0005::DOUBLE, 0.0002::DOUBLE, 1.0::DOUBLE]"


@query(f"""WITH {_INSTANCES}, h AS (SELECT image, instance, {_H} AS m, x1, y1, x2, y2 FROM inst), c AS (SELECT *, unnest([x1, x2, x2, x1])::DOUBLE AS x, unnest([y1, y1, y2, y2])::DOUBLE AS y FROM h),
p AS (SELECT image, instance, (m[1] * x + m[2] * y + m[3]) / (m[7] * x + m[8] * y + m[9]) AS u, (m[4] * x + m[5] * y + m[6]) / (m[7] * x + m[8] * y + m[9]) AS v FROM c),
e AS (SELECT image, instance, greatest(0, floor(min(u)))::BIGINT AS x1, greatest(0, floor(min(v)))::BIGINT AS y1, least(15, ceil(max(u)))::BIGINT AS x2, least(15, ceil(max(v)))::BIGINT AS y2 FROM p GROUP BY ALL) SELECT * FROM e WHERE x2 > x1 AND y2 > y1""")
def warped_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("instance")
    m = F.array(*(F.coalesce(c.cast("double")) for c in (1 + k % 5 / 100.0, F.lit(0.02), k % 7 - 3, F.lit(-0.03), F.lit(1.0), k % 4 - 2, F.lit(0.0005), F.lit(0.0002), F.lit(1.0))))
    rows = _instances(spark, sf_dir).withColumn("m", m)
    rows = rows.withColumn("warped", mosaic.transform_box(F.col("box"), F.col("m"), F.lit(15), F.lit(15))).filter("warped IS NOT NULL")
    return rows.select("image", "instance", "warped.x1", "warped.y1", "warped.x2", "warped.y2")


@query(f"""WITH RECURSIVE {_INSTANCES}, boxes AS (SELECT image, x1, y1, x2, y2, min(instance) AS a FROM inst GROUP BY ALL),
touch AS (SELECT p.image, p.a, q.a AS b FROM boxes p JOIN boxes q ON p.image = q.image AND least(p.x2, q.x2) > greatest(p.x1, q.x1) AND least(p.y2, q.y2) > greatest(p.y1, q.y1)),
reach AS (SELECT image, a, a AS other FROM boxes UNION SELECT r.image, r.a, t.b FROM reach r JOIN touch t ON t.image = r.image AND t.a = r.other), comp AS (SELECT image, a, min(other) AS component FROM reach GROUP BY image, a)
SELECT i.image, i.instance, c.component FROM inst i JOIN boxes b USING (image, x1, y1, x2, y2) JOIN comp c ON c.image = b.image AND c.a = b.a""")
def box_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _instances(spark, sf_dir).select("image", "instance", "box")
    return mosaic.box_components(rows, "image").select("image", "instance", "component")


@query(f"WITH {_PIXELS} SELECT image, count(*) AS covered FROM (SELECT DISTINCT image, px, py FROM pixels) GROUP BY image")
def union_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mosaic.union_mask(_pixels(spark, sf_dir), "image").groupBy("image").agg(F.count(F.lit(1)).alias("covered"))


_ROWS = f"{_LABELS}, z AS (SELECT *, prob * 8 - 4 AS z FROM l), e AS (SELECT *, greatest(z, 0) - z * t + ln(1 + exp(-abs(z))) AS bce, 1 / (1 + exp(-z)) AS q FROM z), w AS (SELECT *, q * t + (1 - q) * (1 - t) AS pt FROM e)"


@query(f"""WITH {_ROWS} SELECT batch, round(avg(bce), 6) AS bce, round(avg((0.25 * t + 0.75 * (1 - t)) * pow(1 - pt, 2) * bce), 6) AS focal, round(avg(bce) + 1 - (2 * sum(q * t) + 1e-6) / (sum(q) + sum(t) + 1e-6), 6) AS bce_dice FROM w GROUP BY batch""")
def segmentation_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mosaic.losses(_labels(spark, sf_dir), F.col("prob") * 8 - 4, F.col("t"), "batch")
    return rows.select("batch", *(r(c, 6).alias(c) for c in ("bce", "focal", "bce_dice")))


@query(f"WITH {_LABELS} SELECT batch, count(*) > 0 AS not_empty, bool_or(t > 0) AS has_positive, bool_and(prob IS NOT NULL AND isfinite(prob)) AS finite, bool_and(t IN (0, 1)) AS binary, NOT bool_and(prob >= 0.5) AND bool_or(prob >= 0.5) AS mixed FROM l GROUP BY batch")
def batch_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mosaic.sanity(mosaic.require_valid(_labels(spark, sf_dir), "t"), F.col("prob"), F.col("t"), "batch")


@query(f"""WITH {b.IMAGES} SELECT event_id, 2.8::DOUBLE * 100 AS fnum, CAST(round_even(focal * 100, 0) AS BIGINT) AS focal_num, CAST(round_even(focal, 0) AS INT) AS focal_35mm, CASE WHEN k % 3 = 0 THEN 'S' ELSE 'N' END AS latitude_ref, floor(latitude)::BIGINT AS d,
 CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS altitude_ref, CAST(round_even(agl * 1000, 0) AS BIGINT) AS altitude_num, CAST(round_even(((yaw - 180 + 360) % 360) * 100, 0) AS BIGINT) AS direction_num, CASE WHEN k % 5 = 0 THEN 'none' ELSE '2024:05:01 11:35:42' END AS taken FROM images""")
def exif_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    stamp = F.when(k % 5 == 0, "2024/05/01 11:35").otherwise("2024-05-01 11:35:42,416")
    lat = F.when(k % 3 == 0, -F.col("latitude")).otherwise(F.col("latitude"))
    alt = F.when(k % 2 == 0, -F.col("agl")).otherwise(F.col("agl"))
    e = mosaic.exif_fields(F.lit(100), F.lit(2.8), F.col("focal"), lat, F.col("longitude"), alt, F.col("yaw") - 180, stamp)
    rows = b.images(spark, sf_dir).select("event_id", e.alias("e"))
    return rows.select("event_id", F.col("e.fnum.num").cast("double").alias("fnum"), F.col("e.focal.num").alias("focal_num"), "e.focal_35mm", "e.latitude_ref", F.col("e.latitude.d.num").alias("d"), "e.altitude_ref", F.col("e.altitude.num").alias("altitude_num"), F.col("e.direction.num").alias("direction_num"), F.coalesce("e.taken", F.lit("none")).alias("taken"))


_BLOCK = f"""{b.IMAGES}, v AS (SELECT event_id, CASE WHEN k % 7 <> 0 THEN CASE WHEN k % 3 = 0 THEN -latitude ELSE latitude END END AS lat, longitude AS lon, CASE WHEN k % 2 = 0 THEN -agl ELSE agl END AS alt, CASE WHEN k % 5 = 0 THEN '2024/05/01 11:35' ELSE '2024-05-01 11:35:42,416' END AS stamp,
  CASE WHEN k % 5 <> 0 THEN '2024:05:01 11:35:42' END AS taken, CASE WHEN k % 4 = 0 THEN 'x' ELSE '1/640.0' END AS shutter, focal, yaw - 180 AS yaw, pitch, roll, k FROM images),
w AS (SELECT *, abs(lat) AS a, abs(lon) AS o, '{{"frame_index":' || event_id || ',"timestamp":"' || stamp || '","latitude":' || coalesce(lat::VARCHAR, 'null') || ',"longitude":' || lon || ',"altitude_m":' || alt || ',"iso":100,"shutter":"' || shutter || '","fnum":2.8,"focal_len":' || focal
  || ',"yaw":' || yaw || ',"pitch":' || pitch || ',"roll":' || roll || ',"k":' || k || '}}' AS note, 'Frame: ' || event_id || CASE WHEN lat IS NULL THEN '' ELSE printf(' | GPS: (%.6f, %.6f)', lat, lon) END || printf(' | Alt: %.2fm', alt) AS about FROM v),
e AS ({" UNION ALL ".join(f"SELECT event_id, {d} AS dir, {tag} AS tag, {kind} AS kind, {n} AS n, {data} AS data FROM w" for d, tag, kind, n, data in [
    *((d, tag, 2, f"length({text}) + 1", f"hex({text}) || '00'") for d, tag, text in ((0, 270, "about"), (0, 271, "'DJI'"), (0, 272, "'Drone Camera'"), (0, 305, "'skytab'"), (0, 306, "taken"), (1, 36867, "taken"), (1, 36868, "taken"), (2, 1, "CASE WHEN lat >= 0 THEN 'N' WHEN lat < 0 THEN 'S' END"), (2, 3, "CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END"), (2, 16, "'T'"), (2, 18, "'WGS-84'"), (2, 29, "taken[:10]"))),
    *((d, tag, 5, 1, f"printf('%08X%08X', CAST(round_even({num}, 0) AS BIGINT), {den}::BIGINT)") for d, tag, num, den in ((0, 282, "72", 1), (0, 283, "72", 1), (1, 33437, "280", 100), (1, 37386, "focal * 100", 100), (2, 6, "abs(alt) * 1000", 1000), (2, 17, "((yaw + 360) % 360) * 100", 100))),
    (1, 33434, 5, 1, "CASE WHEN shutter <> 'x' THEN printf('%08X%08X', 1000, 640000) END"),
    *((2, tag, 5, 3, f"printf('%08X00000001%08X00000001%08X000F4240', floor({x})::BIGINT, floor(({x} - floor({x})) * 60)::BIGINT, CAST(round_even((({x} - floor({x})) * 60 - floor(({x} - floor({x})) * 60)) * 60 * 1000000, 0) AS BIGINT))") for tag, x in ((2, "a"), (4, "o"))),
    (2, 7, 5, 3, "CASE WHEN taken IS NOT NULL THEN printf('%08X00000001%08X00000001%08X00000001', 11, 35, 42) END"),
    (0, 296, 3, 1, "'0002'"), (1, 34855, 3, 1, "'0064'"), (1, 36864, 7, 4, "hex('0231')"), (1, 37510, 7, "length(note) + 8", "'4153434949000000' || hex(note)"), (1, 41989, 3, 1, "printf('%04X', CAST(round_even(focal, 0) AS BIGINT))"), (2, 0, 1, 4, "'02030000'"), (2, 5, 1, 1, "CASE WHEN alt >= 0 THEN '00' ELSE '01' END"),
])}),
s AS (SELECT *, CASE WHEN length(data) <= 8 THEN '' WHEN length(data) % 4 = 0 THEN data ELSE data || '00' END AS beyond FROM e WHERE data IS NOT NULL),
d AS (SELECT event_id, dir, count(*) + CASE dir WHEN 0 THEN 2 ELSE 0 END AS entries, 6 + 12 * count(*) + CASE dir WHEN 0 THEN 24 ELSE 0 END + sum(length(beyond)) // 2 AS size FROM s GROUP BY event_id, dir),
begun AS (SELECT *, (8 + coalesce(sum(size) OVER (PARTITION BY event_id ORDER BY dir ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS place FROM d),
u AS (SELECT event_id, dir, tag, kind, n, data, beyond FROM s UNION ALL SELECT event_id, 0, CASE dir WHEN 1 THEN 34665 ELSE 34853 END, 4, 1, printf('%08X', place), '' FROM begun WHERE dir > 0),
o AS (SELECT u.*, place + 6 + 12 * entries + coalesce(sum(length(beyond) // 2) OVER (PARTITION BY event_id, dir ORDER BY tag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS to_data, entries FROM u JOIN begun USING (event_id, dir)),
t AS (SELECT event_id, dir, printf('%04X', any_value(entries)) || string_agg(printf('%04X%04X%08X', tag, kind, n) || CASE WHEN length(data) <= 8 THEN rpad(data, 8, '0') ELSE printf('%08X', to_data::BIGINT) END, '' ORDER BY tag) || '00000000' || string_agg(beyond, '' ORDER BY tag) AS part FROM o GROUP BY event_id, dir)"""


@query(f"WITH {_BLOCK} SELECT event_id, '4578696600004D4D002A00000008' || string_agg(part, '' ORDER BY dir) AS exif FROM t GROUP BY event_id")
def exif_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole EXIF blocks of photographs, in hex digits: some without a latitude, a time or a shutter."""
    k = F.col("k")
    lat = F.when(k % 7 != 0, F.when(k % 3 == 0, -F.col("latitude")).otherwise(F.col("latitude")))
    stamp = F.when(k % 5 == 0, "2024/05/01 11:35").otherwise("2024-05-01 11:35:42,416")
    shutter = F.when(k % 4 == 0, "x").otherwise("1/640.0")
    alt = F.when(k % 2 == 0, -F.col("agl")).otherwise(F.col("agl"))
    rows = exif.with_exif_bytes(b.images(spark, sf_dir), latitude=lat, longitude=F.col("longitude"), altitude=alt, timestamp=stamp, iso=F.lit(100), shutter=shutter, fnum=F.lit(2.8), focal=F.col("focal"), yaw=F.col("yaw") - 180, pitch=F.col("pitch"), roll=F.col("roll"), frame_index=F.col("event_id"), extra={"k": k})
    return rows.select("event_id", F.hex("exif").alias("exif"))


_CAMERAS = f"{b.IMAGES}, cams AS (SELECT event_id AS frame, (event_id % 97) * 7.0::DOUBLE AS east, (event_id % 89) * 7.0::DOUBLE AS north, agl AS up, yaw, -90.0::DOUBLE + k % 20 AS pitch, roll, focal * width / 36 AS focal, width, height, agl * 1.5::DOUBLE AS radius FROM images)"
_CELLS = "cells AS (SELECT r AS row, c AS col, c * 25.0::DOUBLE + 12.5 AS x, r * 25.0::DOUBLE + 12.5 AS y, ((r * 7 + c * 3) % 5)::DOUBLE AS z FROM (SELECT unnest(range(0, 26)) AS r), (SELECT unnest(range(0, 28)) AS c))"


@query(f"""WITH {_CAMERAS}, {_CELLS}, t AS (SELECT row, col, frame, x - east AS e, y - north AS n, z - up AS u, focal, width, height, radius, cos(radians(roll)) AS cr, sin(radians(roll)) AS sr, cos(radians(pitch)) AS cp, sin(radians(pitch)) AS sp, cos(radians(yaw)) AS ca, sin(radians(yaw)) AS sa
  FROM cells JOIN cams ON (x - east) * (x - east) + (y - north) * (y - north) <= radius * radius),
p AS (SELECT *, (cr * ca + sr * sp * sa) * e + (sr * sp * ca - cr * sa) * n - sr * cp * u AS px, (cr * sp * sa - sr * ca) * e + (cr * sp * ca + sr * sa) * n - cr * cp * u AS py, cp * sa * e + cp * ca * n + sp * u AS pz FROM t),
q AS (SELECT *, focal * px / pz + width / 2.0::DOUBLE AS uu, focal * py / pz + height / 2.0::DOUBLE AS vv FROM p WHERE pz > 0),
w AS (SELECT *, pow(greatest(-u / sqrt(e * e + n * n + u * u), 0), 3) * least(1 - abs(uu / width * 2 - 1), 1 - abs(vv / height * 2 - 1)) AS weight FROM q WHERE uu >= 0 AND uu < width AND vv >= 0 AND vv < height)
SELECT row, col, count(*) AS n_frames, round(sum(weight), 5) AS weight FROM w GROUP BY row, col""")
def ray_cast_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cameras see each cell of a ground grid, and their weights."""
    k = F.col("event_id")
    cams = b.images(spark, sf_dir).select(k.alias("frame"), (k % 97 * 7.0).alias("east"), (k % 89 * 7.0).alias("north"), F.col("agl").alias("up"), "yaw", (-90.0 + F.col("k") % 20).alias("pitch"), "roll", camera.focal_px(F.col("focal"), F.col("width")).alias("focal"), "width", "height", (F.col("agl") * 1.5).alias("radius"))
    side = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    cells = spark.range(1).select(F.explode(side(26)).alias("row")).select("row", F.explode(side(28)).alias("col"))
    cells = cells.withColumns({"x": F.col("col") * 25.0 + 12.5, "y": F.col("row") * 25.0 + 12.5, "z": ((F.col("row") * 7 + F.col("col") * 3) % 5).cast("double")})
    seen = mosaic.cast_rays(cells, cams)
    long = lambda c: F.col(c).cast("long").alias(c)
    return seen.groupBy("row", "col").agg(F.count(F.lit(1)).alias("n_frames"), r(F.sum("weight"), 5).alias("weight")).select(long("row"), long("col"), "n_frames", "weight")


@query(f"""WITH {b.TRACKS}, s AS (SELECT track_id, rn, ln(100.0::DOUBLE + lead(v) OVER w % 5) - ln(100.0::DOUBLE + v % 7) AS r, lead(rn) OVER w AS nxt FROM tracks WINDOW w AS (PARTITION BY track_id ORDER BY rn)),
x AS (SELECT track_id, rn, -coalesce(sum(r) OVER (PARTITION BY track_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x FROM s)
SELECT track_id, rn AS frame, round(least(1.22, greatest(0.82, exp(x - avg(x) OVER (PARTITION BY track_id)))), 4) AS gain FROM x WHERE track_id IN (SELECT track_id FROM s WHERE nxt IS NOT NULL)""")
def seam_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a track, each with a seam to the next: on a chain the gains follow from sums of logs."""
    from pyspark.sql import Window

    w = Window.partitionBy("track_id").orderBy("rn")
    rows = b.tracks(spark, sf_dir).select("track_id", F.col("rn").alias("i"), F.lead("rn").over(w).alias("j"), (100.0 + F.col("v") % 7).alias("mean_i"), (100.0 + F.lead("v").over(w) % 5).alias("mean_j"), F.lit(None).cast("double").alias("weight"))
    return points.seam_gains(rows, "track_id").select("track_id", "frame", r("gain", 4).alias("gain"))
