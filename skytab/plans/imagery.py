"""Queries over photographs and rasters: footprints, projection, sampling, tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import camera, geodesy
from ..operators import sampling, tiles
from . import bindings as b
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


_LONLAT = "SELECT c_custkey, (c_custkey * 7919 % 36000) / 100.0::DOUBLE - 180 AS lon, (c_custkey * 104729 % 16000) / 100.0::DOUBLE - 80 AS lat FROM customer"


def _lonlat(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return b.table(spark, sf_dir, "customer").select("c_custkey", (k * 7919 % 36000 / 100.0 - 180).alias("lon"), (k * 104729 % 16000 / 100.0 - 80).alias("lat"))


@query(f"SELECT c_custkey, 'EPSG:' || (CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + CAST(floor((lon + 180) / 6) AS INT) + 1) AS epsg FROM ({_LONLAT})")
def utm_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lonlat(spark, sf_dir).select("c_custkey", geodesy.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg"))


_N, _R, _ALPHA, _BETA = geodesy._third_flattening()
_E = 2 * _N**0.5 / (1 + _N)


@query(f"""WITH p AS (SELECT c_custkey, lat, radians(lat) AS f, radians(lon - (floor((lon + 180) / 6) * 6 + 3 - 180)) AS dl FROM ({_LONLAT})),
q AS (SELECT *, sinh(atanh(sin(f)) - {_E!r}::DOUBLE * atanh({_E!r}::DOUBLE * sin(f))) AS t FROM p), x AS (SELECT *, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta FROM q)
SELECT c_custkey, round(500000 + 0.9996::DOUBLE * {_R!r}::DOUBLE * (eta + {" + ".join(f"{a!r}::DOUBLE * cos({2 * k + 2} * xi) * sinh({2 * k + 2} * eta)" for k, a in enumerate(_ALPHA))}), 3) AS easting,
 round(CASE WHEN lat < 0 THEN 10000000 ELSE 0 END + 0.9996::DOUBLE * {_R!r}::DOUBLE * (xi + {" + ".join(f"{a!r}::DOUBLE * sin({2 * k + 2} * xi) * cosh({2 * k + 2} * eta)" for k, a in enumerate(_ALPHA))}), 3) AS northing FROM x""")
def utm_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geodesy.utm_forward(F.col("lon"), F.col("lat"))
    return _lonlat(spark, sf_dir).select("c_custkey", r(x, 3).alias("easting"), r(y, 3).alias("northing"))


@query(f"SELECT c_custkey, round(lon, 7) AS lon, round(lat, 7) AS lat FROM ({_LONLAT})")
def utm_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projected and back: the oracle has the coordinates it started from."""
    rows = _lonlat(spark, sf_dir).withColumn("zone", geodesy.utm_zone(F.col("lon")))
    x, y = geodesy.utm_forward(F.col("lon"), F.col("lat"), F.col("zone"))
    rows = rows.withColumns({"x": x, "y": y})
    lon, lat = geodesy.utm_inverse(F.col("x"), F.col("y"), F.col("zone"), F.col("lat") < 0)
    return rows.select("c_custkey", r(lon, 7).alias("lon"), r(lat, 7).alias("lat"))


def _footprint():
    none = F.lit(None).cast("double")
    return geodesy.footprint(F.col("width"), F.col("height"), F.when(F.col("k") % 10 != 0, F.col("agl")), F.col("agl") + 160, F.when(F.col("k") % 4 != 0, F.col("focal")), F.col("focal") / 5, F.lit(6.4), F.lit(4.8)), none


_FOOT = f"""{b.IMAGES}, foot AS (SELECT *, h * sw / fl AS gw, h * sh / fl AS gh FROM (SELECT *, greatest(5.0, CASE WHEN k % 10 <> 0 THEN agl ELSE agl + 160 END) AS h,
 CASE WHEN k % 4 <> 0 THEN 36.0 ELSE 6.4 END::DOUBLE AS sw, CASE WHEN k % 4 <> 0 THEN 36.0 * height / width ELSE 4.8 END::DOUBLE AS sh, CASE WHEN k % 4 <> 0 THEN greatest(1.0, focal) ELSE greatest(5.0, focal / 5) END::DOUBLE AS fl FROM images))"""


@query(f"WITH {_FOOT} SELECT event_id, round(gw, 4) AS ground_w, round(gh, 4) AS ground_h, round(gw / width, 6) AS gsd FROM foot")
def footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    (w, h, gsd), _ = _footprint()
    return b.images(spark, sf_dir).select("event_id", r(w, 4).alias("ground_w"), r(h, 4).alias("ground_h"), r(gsd, 6).alias("gsd"))


@query(f"""WITH {_FOOT}, p AS (SELECT *, radians(latitude) AS f, radians(longitude - (floor((longitude + 180) / 6) * 6 + 3 - 180)) AS dl FROM foot),
q AS (SELECT *, sinh(atanh(sin(f)) - {_E!r}::DOUBLE * atanh({_E!r}::DOUBLE * sin(f))) AS t FROM p), x AS (SELECT *, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta FROM q),
u AS (SELECT *, 500000 + 0.9996::DOUBLE * {_R!r}::DOUBLE * (eta + {" + ".join(f"{a!r}::DOUBLE * cos({2 * k + 2} * xi) * sinh({2 * k + 2} * eta)" for k, a in enumerate(_ALPHA))}) AS x, 0.9996::DOUBLE * {_R!r}::DOUBLE * (xi + {" + ".join(f"{a!r}::DOUBLE * sin({2 * k + 2} * xi) * cosh({2 * k + 2} * eta)" for k, a in enumerate(_ALPHA))}) AS y, abs(cos(radians(yaw))) AS c, abs(sin(radians(yaw))) AS s FROM x)
SELECT track_id, round(min(x - (gw * c + gh * s) / 2), 3) AS min_x, round(min(y - (gw * s + gh * c) / 2), 3) AS min_y, round(max(x + (gw * c + gh * s) / 2), 3) AS max_x, round(max(y + (gw * s + gh * c) / 2), 3) AS max_y FROM u GROUP BY track_id""")
def rotated_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of all turned footprints of a track, in metres of its UTM zone."""
    (w, h, _), _ = _footprint()
    rows = b.images(spark, sf_dir).withColumns({"w": w, "h": h})
    hw, hh = geodesy.rotated_half_extent(F.col("w"), F.col("h"), F.col("yaw"))
    x, y = geodesy.utm_forward(F.col("longitude"), F.col("latitude"))
    rows = rows.withColumns({"hw": hw, "hh": hh, "x": x, "y": y})
    ends = {"min_x": F.min(F.col("x") - F.col("hw")), "min_y": F.min(F.col("y") - F.col("hh")), "max_x": F.max(F.col("x") + F.col("hw")), "max_y": F.max(F.col("y") + F.col("hh"))}
    return rows.groupBy("track_id").agg(*(r(c, 3).alias(n) for n, c in ends.items()))


@query(f"""WITH {b.IMAGES}, g AS (SELECT *, agl / (focal * width / 36) AS nadir, 0.01::DOUBLE + (event_id % 50) / 500.0::DOUBLE AS target FROM images), k AS (SELECT *, target / nadir AS q FROM g), s AS (SELECT *, (sqrt(1 + 4 * q * q) - 1) / (2 * q) AS s FROM k)
SELECT event_id, round(CASE WHEN q <= 1 THEN 0.4 ELSE least(4.0, greatest(0.4, s / sqrt(1 - s * s))) END, 6) AS range_factor FROM s""")
def usable_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.images(spark, sf_dir).withColumns({"nadir": F.col("agl") / camera.focal_px(F.col("focal"), F.col("width")), "target": 0.01 + F.col("event_id") % 50 / 500.0})
    return rows.select("event_id", r(camera.usable_range_factor(F.col("nadir"), F.col("target")), 6).alias("range_factor"))


def _posed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images with their rotation and ground homographies as array columns, so that each is computed once."""
    rows = b.images(spark, sf_dir)
    f = camera.focal_px(F.col("focal"), F.col("width"))
    rot = camera.rotation_world_to_camera(F.col("yaw"), F.col("pitch"), F.col("roll"))
    rows = rows.withColumn("rot", F.array(*(c for row in rot for c in row)))
    h = camera.image_from_ground(f, F.col("width"), F.col("height"), unpack("rot"), F.col("agl"))
    rows = rows.withColumn("img", F.array(*(c for row in h for c in row)))
    return rows.withColumn("gnd", F.array(*(c for row in camera.inverse(unpack("img")) for c in row)))


def unpack(name: str) -> camera.Matrix:
    return [[F.col(name)[3 * i + j] for j in range(3)] for i in range(3)]


_POSE = f"""{b.IMAGES}, pose AS (SELECT *, focal * width / 36 AS f, cos(radians(roll)) AS cr, sin(radians(roll)) AS sr, cos(radians(pitch)) AS cp, sin(radians(pitch)) AS sp, cos(radians(yaw)) AS ca, sin(radians(yaw)) AS sa FROM images),
axes AS (SELECT *, cr * ca + sr * sp * sa AS xe, sr * sp * ca - cr * sa AS xn, -sr * cp AS xu, cr * sp * sa - sr * ca AS ye, cr * sp * ca + sr * sa AS yn, -cr * cp AS yu, cp * sa AS ze, cp * ca AS zn, sp AS zu FROM pose)"""


@query(f"WITH {_POSE} SELECT event_id, round(xe, 6) AS r00, round(xn, 6) AS r01, round(xu, 6) AS r02, round(ye, 6) AS r10, round(yn, 6) AS r11, round(yu, 6) AS r12, round(ze, 6) AS r20, round(zn, 6) AS r21, round(zu, 6) AS r22 FROM axes")
def camera_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rot = unpack("rot")
    return _posed(spark, sf_dir).select("event_id", *(r(rot[i][j], 6).alias(f"r{i}{j}") for i in range(3) for j in range(3)))


@query(f"""WITH {_POSE}, c AS (SELECT *, unnest([0, 1, 2, 3]) AS corner FROM axes), d AS (SELECT *, ((CASE WHEN corner IN (1, 2) THEN width ELSE 0 END) - width / 2.0::DOUBLE) / f AS u, ((CASE WHEN corner IN (2, 3) THEN height ELSE 0 END) - height / 2.0::DOUBLE) / f AS v FROM c),
g AS (SELECT *, xe * u + ye * v + ze AS de, xn * u + yn * v + zn AS dn, xu * u + yu * v + zu AS du FROM d), o AS (SELECT *, -agl / du * de AS e, -agl / du * dn AS n FROM g), k AS (SELECT *, sqrt(e * e + n * n) AS rr, 4 * agl AS lim FROM o)
SELECT event_id, corner, round(CASE WHEN du > 0 THEN -e / rr * lim WHEN rr > lim THEN e / rr * lim ELSE e END, 3) AS east, round(CASE WHEN du > 0 THEN -n / rr * lim WHEN rr > lim THEN n / rr * lim ELSE n END, 3) AS north FROM k""")
def homography_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners by the inverse homography; the oracle casts rays."""
    rows = _posed(spark, sf_dir)
    corners = camera.ground_corners(F.col("gnd"), F.col("width").cast("double"), F.col("height").cast("double"), 4.0 * F.col("agl"))
    rows = rows.select("event_id", F.posexplode(corners).alias("corner", "p"))
    return rows.select("event_id", "corner", r("p.east", 3).alias("east"), r("p.north", 3).alias("north"))


@query(f"""WITH {_POSE}, d AS (SELECT *, (event_id % 640)::DOUBLE * 6 AS px, (event_id % 360)::DOUBLE * 6 AS py FROM axes), q AS (SELECT *, (px - width / 2.0::DOUBLE) / f AS u, (py - height / 2.0::DOUBLE) / f AS v FROM d),
g AS (SELECT *, xe * u + ye * v + ze AS de, xn * u + yn * v + zn AS dn, xu * u + yu * v + zu AS du FROM q),
j AS (SELECT *, agl / f * (xe * du - de * xu) / (du * du) AS a, agl / f * (ye * du - de * yu) / (du * du) AS b, agl / f * (xn * du - dn * xu) / (du * du) AS c, agl / f * (yn * du - dn * yu) / (du * du) AS d FROM g)
SELECT event_id, round(sqrt(abs(a * d - b * c)) / 0.05, 4) AS scale FROM j""")
def canvas_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canvas pixels a source pixel at one point of each image; the oracle differentiates the ray's ground point."""
    rows = _posed(spark, sf_dir)
    canvas = camera.canvas_from_ground(F.lit(500.0), F.lit(900.0), F.lit(100.0), F.lit(1000.0), F.lit(0.05))
    rows = rows.withColumn("m", F.array(*(c for row in camera.multiply(canvas, unpack("gnd")) for c in row)))
    x, y = (F.col("event_id") % 640).cast("double") * 6, (F.col("event_id") % 360).cast("double") * 6
    return rows.select("event_id", r(camera.local_scale(unpack("m"), x, y), 4).alias("scale"))


@query(f"""WITH {b.IMAGES}, g AS (SELECT event_id, agl, unnest(range(-3, 4)) AS i FROM images), h AS (SELECT *, unnest(range(-3, 4)) AS j FROM g), w AS (SELECT *, (i * 20.0::DOUBLE) * (i * 20.0::DOUBLE) + (j * 15.0::DOUBLE) * (j * 15.0::DOUBLE) AS r2 FROM h)
SELECT event_id, round(sum(CASE WHEN r2 > (1.5 * agl) * (1.5 * agl) THEN 0 ELSE pow(agl / sqrt(r2 + agl * agl), 3) END), 6) AS weight, count(*) FILTER (WHERE r2 <= (1.5 * agl) * (1.5 * agl)) AS cells FROM w GROUP BY event_id""")
def nadir_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.sequence(F.lit(-3), F.lit(3))
    rows = b.images(spark, sf_dir).select("event_id", "agl", F.explode(side).alias("i")).select("*", F.explode(side).alias("j"))
    e, n = F.col("i") * 20.0, F.col("j") * 15.0
    rows = rows.withColumn("w", camera.nadir_weight(e, n, F.col("agl"), 1.5 * F.col("agl")))
    return rows.groupBy("event_id").agg(r(F.sum("w"), 6).alias("weight"), F.count_if(F.col("w") > 0).alias("cells"))


@query(f"""WITH {b.IMAGES} SELECT track_id, count(*) AS n, count(*) FILTER (WHERE abs(pitch + 90) >= 5) AS n_oblique, count(*) FILTER (WHERE k % 10 <> 0) AS n_posed, round(median(CASE WHEN k % 10 <> 0 THEN agl END), 3) AS median_agl,
 round(coalesce(median(CASE WHEN k % 4 <> 0 THEN focal END), 24), 3) AS median_focal, avg(lo) AS centre_lo, avg(la) AS centre_la FROM images GROUP BY track_id""")
def image_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.images(spark, sf_dir)
    posed, nadir = F.col("k") % 10 != 0, F.abs(F.col("pitch") + 90) < 5
    return rows.groupBy("track_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~nadir).alias("n_oblique"),
        F.count_if(posed).alias("n_posed"),
        r(F.median(F.when(posed, F.col("agl"))), 3).alias("median_agl"),
        r(F.coalesce(F.median(F.when(F.col("k") % 4 != 0, F.col("focal"))), F.lit(24.0)), 3).alias("median_focal"),
        F.avg("lo").alias("centre_lo"),
        F.avg("la").alias("centre_la"),
    )


@query(f"WITH {b.IMAGES} SELECT event_id, round(degrees(acos(greatest(-1, least(1, z / n)))) - 90, 4) AS pitch, round(degrees(atan2(x / n, y / n)), 4) AS roll FROM (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM (SELECT event_id, (k % 7 - 3) / 10.0::DOUBLE AS x, 0.2::DOUBLE + (k % 5) / 10.0 AS y, 0.5::DOUBLE + (k % 9) / 10.0 AS z FROM images))")
def down_vector_attitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, z = (F.col("k") % 7 - 3) / 10.0, 0.2 + F.col("k") % 5 / 10.0, 0.5 + F.col("k") % 9 / 10.0
    pitch, roll = camera.pitch_roll_from_down(x, y, z)
    return b.images(spark, sf_dir).select("event_id", r(pitch, 4).alias("pitch"), r(roll, 4).alias("roll"))


def _videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = b.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("track_id")).agg(F.count(F.lit(1)).alias("total_frames"))
    return counts.withColumn("fps", F.lit(24.0))


_VIDEOS = "SELECT user_id AS track_id, count(*) AS total_frames, 24.0::DOUBLE AS fps FROM events GROUP BY user_id"


def _grid(step: str, start: str = "0.0") -> str:
    return f"""SELECT track_id, ordinal, CAST(round_even(({start} + ordinal * {step}) * fps, 0) AS BIGINT) AS frame_idx, round({start} + ordinal * {step}, 6) AS t_sec FROM (
  SELECT *, unnest(range(0, CAST(floor((total_frames / fps - {start}) / {step} + 1e-9) AS BIGINT) + 1)) AS ordinal FROM ({_VIDEOS}) WHERE total_frames / fps >= {start}) WHERE CAST(round_even(({start} + ordinal * {step}) * fps, 0) AS BIGINT) < total_frames"""


def _targets(df: DataFrame) -> DataFrame:
    return df.select("track_id", "ordinal", "frame_idx", r("t_sec", 6).alias("t_sec"))


@query(_grid("0.3::DOUBLE", "0.25::DOUBLE"))
def frame_targets_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _targets(sampling.frame_targets(_videos(spark, sf_dir), interval_sec=0.3, start_sec=0.25))


@query(_grid("(1.0::DOUBLE / 7)"))
def frame_targets_fps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _targets(sampling.frame_targets(_videos(spark, sf_dir), fps=7.0))


@query(f"SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY f) - 1 AS ordinal, f AS frame_idx, round(f / fps, 6) AS t_sec FROM (SELECT *, unnest(range(12, total_frames, 5)) AS f FROM ({_VIDEOS}))")
def frame_targets_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _targets(sampling.frame_targets(_videos(spark, sf_dir), frame_step=5, start_sec=0.5))


@query(f"SELECT track_id, frame_idx, round(arg_max(t_sec, ordinal), 6) AS t_sec FROM ({_grid('0.01::DOUBLE')}) WHERE ordinal < 40 GROUP BY ALL")
def frame_targets_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = sampling.frame_targets(_videos(spark, sf_dir), interval_sec=0.01, max_frames=40)
    return sampling.last_per_frame(t, "track_id").select("track_id", "frame_idx", r("t_sec", 6).alias("t_sec"))


_RASTERS = "SELECT p_partkey, 200 + p_size * 40 AS width, CAST(150 + p_partkey % 900 AS INT) AS height FROM part"


def _rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "part").select("p_partkey", (200 + F.col("p_size") * 40).alias("width"), (150 + F.col("p_partkey") % 900).cast("int").alias("height"))


def _origin_sql(c: str) -> str:
    return f"list_sort(list_distinct(list_append(range(0, greatest({c} - 512, 0) + 1, 384), greatest({c} - 512, 0))))"


_TILES = f"""tiles AS (SELECT p_partkey, width, height, y, unnest(xs) AS x FROM (SELECT *, {_origin_sql("width")} AS xs, unnest({_origin_sql("height")}) AS y FROM ({_RASTERS})))"""


@query(f"WITH {_TILES} SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY y, x) - 1 AS ordinal, x, y, least(512, width - x) AS tile_width, least(512, height - y) AS tile_height FROM tiles")
def tile_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.iter_tiles(_rasters(spark, sf_dir), 512, 384).select("p_partkey", "ordinal", "x", "y", "tile_width", "tile_height")


_SPLIT = "CASE WHEN p_partkey % 14 < 8 THEN 'train' WHEN p_partkey % 14 < 11 THEN 'val' ELSE 'test' END"


@query(f"WITH {_TILES}, s AS (SELECT *, {_SPLIT} AS split, (x + y + p_partkey) % 3 AS m FROM tiles) SELECT split, count(*) AS n_tiles, count(*) FILTER (WHERE m > 0) AS n_positive, count(*) FILTER (WHERE m = 0) AS n_empty, sum(m)::BIGINT AS total, min(m) AS min_instances, max(m) AS max_instances, round(avg(m), 6) AS mean_instances FROM s GROUP BY split")
def tile_split_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 14
    t = tiles.iter_tiles(_rasters(spark, sf_dir), 512, 384).withColumns({"split": F.when(k < 8, "train").when(k < 11, "val").otherwise("test"), "m": (F.col("x") + F.col("y") + F.col("p_partkey")) % 3})
    m = F.col("m")
    return t.groupBy("split").agg(F.count(m).alias("n_tiles"), F.count_if(m > 0).alias("n_positive"), F.count_if(m == 0).alias("n_empty"), F.sum(m).alias("total"), F.min(m).alias("min_instances"), F.max(m).alias("max_instances"), r(F.avg(m), 6).alias("mean_instances"))


@query(f"""SELECT p_partkey, x, y, least(256, width - x) AS patch_width, least(256, height - y) AS patch_height, p_partkey || '_' || x || '_' || y || '_patch' AS name FROM (SELECT *, unnest(range(0, height, 192)) AS y FROM (SELECT *, unnest(range(0, width, 192)) AS x FROM ({_RASTERS}))) WHERE least(256, width - x) >= 16 AND least(256, height - y) >= 16""")
def patch_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rasters(spark, sf_dir).withColumn("stem", F.col("p_partkey").cast("string"))
    return tiles.patches(rows, 256, 192).select("p_partkey", "x", "y", "patch_width", "patch_height", "name")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <= 0 THEN 0.5 WHEN l_discount <= 0.01 THEN 1.5 WHEN l_discount <= 0.10 THEN 3.0 ELSE 4.0 END::DOUBLE AS weight FROM lineitem")
def patch_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", tiles.fraction_weight(F.col("l_discount")).alias("weight"))


@query("""SELECT l_returnflag AS split, count(*) FILTER (WHERE l_discount <= 0) AS n_empty, count(*) FILTER (WHERE l_discount > 0 AND l_discount <= 0.01) AS n_tiny, count(*) FILTER (WHERE l_discount > 0.01 AND l_discount <= 0.10) AS n_small, count(*) FILTER (WHERE l_discount > 0.10) AS n_large,
 min(l_discount) AS min_fraction, max(l_discount) AS max_fraction, round(avg(l_discount), 6) AS mean_fraction, round(least(5.0, greatest(1.0, (1 - avg(l_discount)) / avg(l_discount))), 6) AS pos_weight FROM lineitem GROUP BY l_returnflag""")
def fraction_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("l_discount")
    kind = tiles.fraction_class(x)
    mean = F.avg(x)
    return b.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("split")).agg(*(F.count_if(kind == k).alias(f"n_{k}") for k in ("empty", "tiny", "small", "large")), F.min(x).alias("min_fraction"), F.max(x).alias("max_fraction"), r(mean, 6).alias("mean_fraction"), r(F.least(F.lit(5.0), F.greatest(F.lit(1.0), (1 - mean) / mean)), 6).alias("pos_weight"))


@query(f"WITH {_TILES}, s AS (SELECT *, (x + y + p_partkey) % 3 > 0 AS positive FROM tiles) SELECT p_partkey, x, y, round(CASE WHEN positive THEN 1.0 ELSE (SELECT count(*) FROM s WHERE positive) * 0.5 / (SELECT greatest(count(*), 1) FROM s WHERE NOT positive) END, 6) AS weight FROM s")
def empty_tile_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tiles.iter_tiles(_rasters(spark, sf_dir), 512, 384).withColumn("positive", (F.col("x") + F.col("y") + F.col("p_partkey")) % 3 > 0)
    return tiles.empty_tile_weight(t, "positive", 0.5).select("p_partkey", "x", "y", r("weight", 6).alias("weight"))
