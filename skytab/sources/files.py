"""File sources besides telemetry: image folders, point clouds, inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions import text as tx
from .headers import read_raw_metadata

SUFFIXES = r"\.(jpg|jpeg|png|tif|tiff)$"


def resolve_image_info(raw: DataFrame) -> DataFrame:
    """One row an image with a position: XMP goes before the user comment, that before EXIF, defaults last."""
    rows = raw.filter("latitude IS NOT NULL AND longitude IS NOT NULL").withColumn("__t", tx.xmp_map(F.coalesce("xmp", F.lit(""))))
    tag = lambda k: F.try_element_at("__t", F.lit(k))
    note = lambda k: F.get_json_object("comment", f"$.{k}")
    pitch = tx.pick(tag("GimbalPitchDegree"), tag("Pitch"), note("pitch"))
    agl = tx.pick(tag("RelativeAltitude"), note("agl_m"))
    return rows.select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        "width",
        "height",
        "latitude",
        "longitude",
        F.coalesce(tx.pick(tag("AbsoluteAltitude")), "gps_altitude", F.lit(100.0)).alias("altitude_m"),
        F.coalesce("focal_length", F.lit(24.0)).alias("focal_length_mm"),
        "focal_35mm",
        F.coalesce(tx.pick(tag("GimbalYawDegree"), tag("Yaw"), note("yaw")), "direction", F.lit(0.0)).alias("yaw_deg"),
        F.coalesce(pitch, F.lit(-90.0)).alias("pitch_deg"),
        F.coalesce(tx.pick(tag("GimbalRollDegree"), tag("Roll"), note("roll")), F.lit(0.0)).alias("roll_deg"),
        agl.alias("agl_m"),
        (pitch.isNotNull() & F.coalesce(agl > 0, F.lit(False))).alias("pose_is_known"),
        F.col("taken").alias("timestamp_str"),
    )


def scan_directory(spark: SparkSession, path: str, max_images: int | None = None) -> DataFrame:
    """Image infos of the JPEG, PNG and TIFF files under a path; with max_images the first valid ones by name (a top-k)."""
    rows = resolve_image_info(read_raw_metadata(spark, path))
    return rows.orderBy("filename", "path").limit(max_images) if max_images else rows


def list_images(spark: SparkSession, path: str, contains: str = "orthophoto", without: str = "preview") -> DataFrame:
    """Files under a path whose names hold ``contains`` and not ``without``: path, filename, stem, length."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.withColumn("filename", name).withColumn("stem", F.regexp_replace("filename", r"\.[^.]*$", ""))
    return rows.filter(F.lower("filename").contains(contains) & ~F.lower("filename").contains(without) & F.lower("filename").rlike(SUFFIXES))


def list_orthophotos(spark: SparkSession, path: str, inventory: DataFrame | None = None) -> DataFrame:
    """TIFF orthophotos under a path, without previews; with an inventory (filename, annotation) those it names."""
    rows = list_images(spark, path).filter(F.lower("filename").endswith(".tif"))
    return rows if inventory is None else rows.join(inventory.select("filename"), "filename", "left_semi")


def require_inventory(inventory: DataFrame, images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Every row of the inventory (filename, annotation) with the path of its image (the first by name) and of its
    annotation file (name, path); reading it fails if one of them is missing."""
    image = images.groupBy("filename").agg(F.min("path").alias("image_path"))
    note = annotations.groupBy(F.col("name").alias("annotation")).agg(F.min("path").alias("annotation_path"))
    rows = inventory.join(image, "filename", "left").join(note, "annotation", "left")
    need = lambda c, what: F.coalesce(F.col(c), F.raise_error(F.concat(F.lit("missing "), F.col(what))).cast("string")).alias(c)
    return rows.select("filename", "annotation", need("image_path", "filename"), need("annotation_path", "annotation"))


def find_annotation(images: DataFrame, annotations: DataFrame, inventory: DataFrame, required: bool = False) -> DataFrame:
    """``images`` (filename, stem) with annotation: by the inventory (filename, annotation), else the file (name) called
    like the image's id, else like its stem; of several the first by name. Without one it is null, or, where
    ``required``, reading fails."""
    from ..operators.tiles import orthophoto_id

    names = annotations.groupBy(F.regexp_replace("name", r"\.[^.]*$", "").alias("__n")).agg(F.min("name").alias("__a"))
    rows = images.withColumn("__id", orthophoto_id(F.col("stem"))).join(inventory.select("filename", F.col("annotation").alias("__inv")), "filename", "left")
    for key, out in (("__id", "__by_id"), ("stem", "__by_stem")):
        rows = rows.join(names.withColumnsRenamed({"__n": key, "__a": out}), key, "left")
    none = [F.raise_error(F.concat(F.lit("no annotation for "), "filename")).cast("string")] if required else []
    return rows.withColumn("annotation", F.coalesce("__inv", "__by_id", "__by_stem", *none)).drop("__id", "__inv", "__by_id", "__by_stem")


def read_ply(spark: SparkSession, path: str, at_least: int = 4) -> DataFrame:
    """Points (file, x, y, z, nx, ny, nz) of ASCII PLY files under a path, by the names and the number of vertices in
    each header; properties a file lacks are null. An error with fewer than ``at_least`` points in all.

    Lines are numbered without a window over a file: within a task as they come, and after the counts of
    the tasks before.
    """
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("m"), F.trim("value").alias("value"))
    lines = cut(lines.select("file", F.shiftright("m", 33).alias("task"), F.expr("m & 8589934591").alias("at"), "value"), "lines")
    sizes = lines.groupBy("file", "task").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = lines.join(sizes.select("file", "task", (before - F.col("first")).alias("shift")), ["file", "task"]).withColumn("line", F.col("at") + F.col("shift"))
    head = lines.filter(F.rlike("value", F.lit(r"^(element|property)\s|^end_header$")))
    head = head.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("line", "value"))).alias("h"))  # some dozen lines a file
    end = F.array_min(F.transform(F.filter("h", lambda x: x["value"] == "end_header"), lambda x: x["line"]))
    head = head.withColumn("end", end).withColumn("h", F.filter("h", lambda x: x["line"] < F.col("end")))
    elements = F.filter("h", lambda x: F.startswith(x["value"], F.lit("element")))
    vertex = F.get(F.filter(elements, lambda x: F.rlike(x["value"], F.lit(r"^element\s+vertex\s"))), F.lit(0))
    other = F.array_min(F.transform(F.filter(elements, lambda x: x["line"] > vertex["line"]), lambda x: x["line"]))
    own = F.filter("h", lambda x: F.startswith(x["value"], F.lit("property")) & (x["line"] > vertex["line"]) & (x["line"] < F.coalesce(other, F.col("end"))))
    names = F.transform(own, lambda x: F.element_at(F.split(x["value"], r"\s+"), -1))
    head = head.select("file", "end", F.element_at(F.split(vertex["value"], r"\s+"), 3).try_cast("long").alias("n"), names.alias("names"))
    rows = lines.join(head, "file").filter("line > end AND line <= end + n").withColumn("v", F.split("value", r"\s+"))
    part = lambda c: tx.as_double(F.get("v", F.nullif(F.array_position("names", c), F.lit(0)).cast("int") - 1)).alias(c)
    rows = rows.select("file", *map(part, ("x", "y", "z", "nx", "ny", "nz"))).filter("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    if rows.limit(at_least).count() < at_least:
        raise ValueError(f"fewer than {at_least} points")
    return rows


def read_pairs(spark: SparkSession, path: str, pair_id: str | None = None) -> DataFrame:
    """Before and after pairs (id, before, after) of a JSON list, one or all."""
    rows = spark.read.schema("id string, before string, after string").option("multiLine", True).json(path)
    return rows.filter(F.col("id") == pair_id) if pair_id else rows
