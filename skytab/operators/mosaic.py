"""Metadata side of mosaicking and learning: grids, camera coverage, ray casts, seams, losses, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions import camera
from .components import connected_components
from .detections import overlapping_pairs

# per-band mean and deviation of the usual pretrained encoders, fixed values
BAND_MEAN, BAND_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def focal_candidates(low: int = 20, high: int = 35) -> Column:
    return F.sequence(F.lit(low), F.lit(high))


def grid(canvas: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """``canvas`` (min_x, max_y, gsd and sizes) with one row a cell: row, col and the centre's x and y.
    Rows of cells are dealt out before they are written out, so that one canvas is the work of many tasks."""
    rows = canvas.select("*", F.explode(F.sequence(F.lit(0), F.col(height) - 1)).alias("row")).repartition("row")
    cells = rows.select("*", F.explode(F.sequence(F.lit(0), F.col(width) - 1)).alias("col"))
    return cells.withColumns({"x": F.col("min_x") + (F.col("col") + 0.5) * F.col("gsd"), "y": F.col("max_y") - (F.col("row") + 0.5) * F.col("gsd")})


def coverage_window(east: Column, north: Column, radius: Column, min_x: Column, max_y: Column, gsd: Column, width: Column, height: Column) -> dict[str, Column]:
    """Half-open index ranges of the cells within a radius of a camera, clipped to the canvas."""
    clip = lambda v, n: F.greatest(F.lit(0), F.least(n, v)).cast("int")
    return {
        "col0": clip(F.floor((east - radius - min_x) / gsd), width),
        "col1": clip(F.ceil((east + radius - min_x) / gsd), width),
        "row0": clip(F.floor((max_y - north - radius) / gsd), height),
        "row1": clip(F.ceil((max_y - north + radius) / gsd), height),
    }


def cast_rays(cells: DataFrame, cameras: DataFrame, radius: str = "radius", block: float = 64.0) -> DataFrame:
    """Cells (row, col, x, y, z) seen by cameras (frame, east, north, up, yaw, pitch, roll, focal, width, height, radius):
    row, col, frame, u, v and weight (cube of the cosine from nadir times closeness to the image's centre).

    Cameras reach the blocks of ground within their radius, and cells join them there by an equi join. A camera's rotation
    is worked out once, and cameras are dealt out before they reach, however few files they come from.
    """
    rotation = camera.rotation_world_to_camera(F.col("yaw"), F.col("pitch"), F.col("roll"))
    cameras = cameras.withColumn("__r", F.array(*(v for row in rotation for v in row))).repartition("frame")
    near = lambda c, s: F.floor((F.col(c) + s * F.col(radius)) / block)
    cams = cameras.withColumn("__bx", F.explode(F.sequence(near("east", -1), near("east", 1)))).withColumn("__by", F.explode(F.sequence(near("north", -1), near("north", 1))))
    home = cells.withColumns({"__bx": F.floor(F.col("x") / block), "__by": F.floor(F.col("y") / block)})
    both = home.join(cams, ["__bx", "__by"])
    both = both.withColumns({"__e": F.col("x") - F.col("east"), "__n": F.col("y") - F.col("north"), "__u": F.col("z") - F.col("up")})
    both = both.filter(F.col("__e") * F.col("__e") + F.col("__n") * F.col("__n") <= F.col(radius) * F.col(radius))
    rot = [[F.col("__r")[3 * i + j] for j in range(3)] for i in range(3)]
    both = both.withColumns({f"__{k}": row[0] * F.col("__e") + row[1] * F.col("__n") + row[2] * F.col("__u") for k, row in zip("xyz", rot)}).filter("__z > 0")
    both = both.withColumns({"u": F.col("focal") * F.col("__x") / F.col("__z") + F.col("width") / 2, "v": F.col("focal") * F.col("__y") / F.col("__z") + F.col("height") / 2})
    both = both.filter("u >= 0 AND u < width AND v >= 0 AND v < height")
    cos = -F.col("__u") / F.sqrt(F.col("__e") * F.col("__e") + F.col("__n") * F.col("__n") + F.col("__u") * F.col("__u"))
    edge = F.least(1 - F.abs(F.col("u") / F.col("width") * 2 - 1), 1 - F.abs(F.col("v") / F.col("height") * 2 - 1))
    return both.select("row", "col", "frame", "u", "v", (F.pow(F.greatest(cos, F.lit(0.0)), 3) * edge).alias("weight"))


def seam_neighbours(frames: DataFrame, key: str = "track_id", order: str = "frame", padding: float = 0.0, reach: int = 2) -> DataFrame:
    """Pairs (key, i, j) of frames with their next ones in order whose boxes (x1, y1, x2, y2), padded, overlap."""
    w = Window.partitionBy(key).orderBy(order)
    me = F.struct(F.col(order).alias("id"), "x1", "y1", "x2", "y2")
    rows = frames.select(key, me.alias("p"), F.array(*(F.lead(me, k).over(w) for k in range(1, reach + 1))).alias("next"))
    rows = rows.select(key, "p", F.explode(F.array_compact("next")).alias("q"))
    p, q = F.col("p"), F.col("q")
    meet = [(p[f"{a}2"] + padding > q[f"{a}1"] - padding) & (q[f"{a}2"] + padding > p[f"{a}1"] - padding) for a in "xy"]
    return rows.filter(meet[0] & meet[1]).select(key, p["id"].alias("i"), q["id"].alias("j"))


def transform_box(box: Column, homography: Column, width: Column, height: Column) -> Column:
    """Half-open pixel box around a box's corners under a homography (array of nine), clipped to an image; null if empty."""
    m = homography
    corners = F.array(*(F.struct(box[x].cast("double").alias("x"), box[y].cast("double").alias("y")) for x, y in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))))
    lift = F.transform(corners, lambda c: F.struct(*((m[3 * k] * c["x"] + m[3 * k + 1] * c["y"] + m[3 * k + 2]).alias(n) for k, n in enumerate("xyw"))))
    flat = F.transform(lift, lambda c: F.struct((c["x"] / c["w"]).alias("x"), (c["y"] / c["w"]).alias("y")))
    ends = F.aggregate(flat, F.struct(*(F.lit(v).alias(n) for n, v in (("a", 1e300), ("b", 1e300), ("c", -1e300), ("d", -1e300)))), lambda s, c: F.struct(F.least(s["a"], c["x"]).alias("a"), F.least(s["b"], c["y"]).alias("b"), F.greatest(s["c"], c["x"]).alias("c"), F.greatest(s["d"], c["y"]).alias("d")))
    clip = lambda e: F.struct(F.greatest(F.lit(0), F.floor(e["a"])).cast("long").alias("x1"), F.greatest(F.lit(0), F.floor(e["b"])).cast("long").alias("y1"), F.least(width, F.ceil(e["c"])).cast("long").alias("x2"), F.least(height, F.ceil(e["d"])).cast("long").alias("y2"))
    return F.get(F.filter(F.transform(F.array(ends), clip), lambda b: (b["x2"] > b["x1"]) & (b["y2"] > b["y1"])), F.lit(0))


def rescale_homography(m: Column, from_scale: Column, to_scale: Column) -> Column:
    """A homography between previews (array of nine) for the whole images: S2^-1 M S1, scales as preview / whole."""
    by = [from_scale / to_scale, from_scale / to_scale, 1 / to_scale, from_scale / to_scale, from_scale / to_scale, 1 / to_scale, from_scale, from_scale, F.lit(1.0)]
    return F.array(*(m[k] * s for k, s in enumerate(by)))


def box_components(boxes: DataFrame, key: str) -> DataFrame:
    """Boxes (key, instance, box; instance unique over all keys) with component: the least instance of those whose boxes touch in a chain.

    Instances with equal boxes touch each other, so one of them, the least, stands for all in the search for pairs.
    """
    full = boxes.filter(F.col(key).isNotNull()).filter("box.x2 > box.x1 AND box.y2 > box.y1")
    least = cut(full.groupBy(key, "box").agg(F.min("instance").alias("instance")), "least")
    pairs = overlapping_pairs(least, least, key).select(F.col("a.instance").alias("src"), F.col("b.instance").alias("dst"))
    found = connected_components(pairs).withColumnRenamed("node", "instance")
    found = least.join(found, "instance").select(key, "box", "component")
    return boxes.join(found, [key, "box"], "left").withColumn("component", F.coalesce("component", "instance"))


def union_mask(pixels: DataFrame, key: str) -> DataFrame:
    """All pixels that any instance of an image covers, once."""
    return pixels.select(key, "px", "py").distinct()


def normalise_bands(bands: Column) -> Column:
    """Three bands of 0 to 255 in the form pretrained encoders want."""
    return F.array(*((bands[k] / 255.0 - BAND_MEAN[k]) / BAND_STD[k] for k in range(3)))


def losses(df: DataFrame, logit: Column, target: Column, *keys: str, alpha: float = 0.25, gamma: float = 2.0, eps: float = 1e-6) -> DataFrame:
    """Mean binary cross entropy, focal loss, and cross entropy plus dice loss, of logits against 0 or 1."""
    z, t = logit.cast("double"), target.cast("double")
    bce = F.greatest(z, F.lit(0.0)) - z * t + F.log1p(F.exp(-F.abs(z)))
    p = 1 / (1 + F.exp(-z))
    rows = df.select(*keys, bce.alias("bce"), p.alias("p"), t.alias("t"))
    pt = F.col("p") * F.col("t") + (1 - F.col("p")) * (1 - F.col("t"))
    at = alpha * F.col("t") + (1 - alpha) * (1 - F.col("t"))
    sums = rows.groupBy(*keys).agg(F.avg("bce").alias("bce"), F.avg(at * F.pow(1 - pt, F.lit(gamma)) * F.col("bce")).alias("focal"), F.sum(F.col("p") * F.col("t")).alias("i"), F.sum("p").alias("sp"), F.sum("t").alias("st"))
    dice = 1 - (2 * F.col("i") + eps) / (F.col("sp") + F.col("st") + eps)
    return sums.select(*keys, "bce", "focal", (F.col("bce") + dice).alias("bce_dice"))


def sanity(df: DataFrame, p: Column, t: Column, *keys: str) -> DataFrame:
    """Flags of predictions and targets: not empty, some positive, finite, targets 0 or 1, predictions not all one class."""
    finite = p.isNotNull() & ~F.isnan(p) & (F.abs(p) != float("inf"))
    return df.groupBy(*keys).agg(
        (F.count(F.lit(1)) > 0).alias("not_empty"),
        F.bool_or(t > 0).alias("has_positive"),
        F.bool_and(finite).alias("finite"),
        F.bool_and(t.isin(0, 1)).alias("binary"),
        (~F.bool_and(p >= 0.5) & F.bool_or(p >= 0.5)).alias("mixed"),
    )


def require_valid(df: DataFrame, target: str) -> DataFrame:
    """``df``, failing while it is read if a target is neither 0 nor 1."""
    bad = F.raise_error(F.concat(F.lit("target is neither 0 nor 1: "), F.coalesce(F.col(target).cast("string"), F.lit("null"))))
    return df.withColumn(target, F.when(F.col(target).isin(0, 1), F.col(target)).otherwise(bad.cast(df.schema[target].dataType)))


def vertical_support(segments: DataFrame, key: str, tolerance: float = 1.2) -> DataFrame:
    """For each focal candidate (key, focal, vx, vy: where vertical lines would meet) of line segments (x1, y1, x2, y2), the
    length of those that point there within the tolerance in degrees; best marks the largest."""
    mx, my = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    ax, ay, bx, by = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("vx") - mx, F.col("vy") - my
    length = F.sqrt(ax * ax + ay * ay)
    sine = F.abs(ax * by - ay * bx) / F.greatest(length * F.sqrt(bx * bx + by * by), F.lit(1e-12))
    held = segments.withColumn("__w", F.when(F.degrees(F.asin(F.least(F.lit(1.0), sine))) < tolerance, length).otherwise(0.0))
    sums = held.groupBy(key, "focal").agg(F.sum("__w").alias("support"))
    w = Window.partitionBy(key).orderBy(F.desc("support"), "focal")
    return sums.withColumn("best", F.row_number().over(w) == 1)


def exif_fields(iso: Column, fnum: Column, focal: Column, latitude: Column, longitude: Column, altitude: Column, yaw: Column, timestamp: Column) -> Column:
    """Values of an EXIF block as a struct; what is null stays null. A timestamp that is no
    ``yyyy-MM-dd HH:mm:ss`` gives null rather than the present time."""
    from ..functions.text import dms_rational

    ratio = lambda v, n: F.when(v.isNotNull(), F.struct(F.rint(v * n).cast("long").alias("num"), F.lit(n).cast("long").alias("den")))
    ref = lambda v, pos, neg: F.when(v.isNotNull(), F.when(v >= 0, pos).otherwise(neg))
    time = F.try_to_timestamp(F.substring(F.replace(timestamp, F.lit(","), F.lit(".")), 1, 19), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.struct(
        F.date_format(time, "yyyy:MM:dd HH:mm:ss").alias("taken"),
        F.date_format(time, "yyyy:MM:dd").alias("gps_date"),
        F.when(time.isNotNull(), F.array(F.hour(time), F.minute(time), F.second(time))).alias("gps_time"),
        iso.cast("int").alias("iso"),
        ratio(fnum, 100).alias("fnum"),
        ratio(focal, 100).alias("focal"),
        F.rint(focal).cast("int").alias("focal_35mm"),
        ref(latitude, "N", "S").alias("latitude_ref"),
        dms_rational(latitude).alias("latitude"),
        ref(longitude, "E", "W").alias("longitude_ref"),
        dms_rational(longitude).alias("longitude"),
        F.when(altitude.isNotNull(), F.when(altitude >= 0, 0).otherwise(1)).alias("altitude_ref"),
        ratio(F.abs(altitude), 1000).alias("altitude"),
        ratio(F.pmod(yaw, F.lit(360.0)), 100).alias("direction"),
    )
