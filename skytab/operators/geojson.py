"""GeoJSON out of frames and in as features; polygon measures and checks over ring arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.geodesy import haversine_3d
from .kinematics import with_previous

PROPERTIES = ["frame_index", "frame_id", "filename", "timestamp", "timestamp_sec", "latitude", "longitude", "altitude_m", "iso", "shutter", "f_number", "focal_length_mm", "ev", "ct", "color_mode", "yaw", "pitch", "roll"]


def point_features(frames: DataFrame) -> DataFrame:
    """``frames`` with feature: a Point feature as text; properties that are null are left out."""
    own = {"altitude_m": F.round("altitude", 3)}
    have = [own[c].alias(c) if c in own else F.col(c) for c in PROPERTIES if c in frames.columns or c in own]
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col("longitude"), F.col("latitude"), F.round("altitude", 3)).alias("coordinates"))
    return frames.withColumn("feature", F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("frame_index").alias("id"), point.alias("geometry"), F.struct(*have).alias("properties"))))


def trajectory(frames: DataFrame, key: str, order: str = "frame_index") -> DataFrame:
    """For each track of two frames or more (key, feature): its LineString, length, and first and last timestamp."""
    place = ("latitude", "longitude", "altitude")
    legs = with_previous(frames.withColumn("__at", F.struct(*place)), key, order, "__at", "__last")
    legs = legs.withColumn("__leg", haversine_3d(*(F.col("__last")[c] for c in place), *map(F.col, place)))
    point = F.struct(order, F.array("longitude", "latitude", F.round("altitude", 3)).alias("p"))
    time = F.col("timestamp") if "timestamp" in frames.columns else F.lit(None).cast("string")
    line = legs.groupBy(key).agg(F.sort_array(F.collect_list(point)).alias("pts"), F.round(F.sum("__leg"), 2).alias("d"), F.min_by(time, order).alias("a"), F.max_by(time, order).alias("z")).filter(F.size("pts") >= 2)
    geometry = F.struct(F.lit("LineString").alias("type"), F.col("pts.p").alias("coordinates"))
    props = F.struct(F.lit("Flight trajectory").alias("name"), F.size("pts").alias("total_points"), F.col("d").alias("total_distance_meters"), F.col("a").alias("start_time"), F.col("z").alias("end_time"))
    return line.select(key, F.to_json(F.struct(F.lit("Feature").alias("type"), F.lit("flight_trajectory").alias("id"), geometry.alias("geometry"), props.alias("properties"))).alias("feature"))


def feature_collection(frames: DataFrame, key: str, order: str = "frame_index", line: bool = True) -> DataFrame:
    """One FeatureCollection text a track (key, geojson): points in order, then the trajectory, and the bounds."""
    points = point_features(frames).select(key, F.col(order).cast("long").alias("__o"), "feature")
    if line:
        points = points.unionByName(trajectory(frames, key, order).select(key, F.lit(2**62).alias("__o"), "feature"))
    body = points.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__o", "feature"))), lambda x: x["feature"]), ",").alias("body"))
    ends = [F.round(f(c), n) for f in (F.min, F.max) for c, n in (("longitude", 6), ("latitude", 6), ("altitude", 2))]
    box = frames.groupBy(key).agg(F.to_json(F.array(*ends)).alias("bbox"))
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.col("body"), F.lit('],"bbox":'), F.col("bbox"), F.lit("}"))
    return body.join(box, key).select(key, text.alias("geojson"))


RINGS = "array<array<array<double>>>"


def read_features(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """GeoJSON files under a path as rows (file, feature_idx, geometry_type, parts, rings): parts are lists of rings, of
    which the first is the outer one and the others holes; rings are those of all parts one after another. Other
    geometries have null parts. With ``lines`` a file has one collection a line, and file is the name that the collection
    gives itself: many small collections are as few files as tasks."""
    schema = "type string, name string, features array<struct<type:string,geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>"
    rows = spark.read.schema(schema).option("multiLine", not lines).json(path).withColumn("file", F.col("name") if lines else F.input_file_name())
    rows = rows.select("file", F.posexplode("features").alias("feature_idx", "f")).select("file", "feature_idx", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("c"))
    parts = F.when(F.col("geometry_type") == "Polygon", F.array(F.from_json("c", RINGS))).when(F.col("geometry_type") == "MultiPolygon", F.from_json("c", f"array<{RINGS}>"))
    return rows.withColumn("parts", parts).withColumn("rings", F.flatten("parts")).drop("c")


def load_parts(features: DataFrame) -> DataFrame:
    """Of features as of read_features the polygons' parts, in image space: file, feature_idx, part, rings (the outer
    one first, then its holes, of (x, y) structs with y down), area. Other kinds and parts without an area are left out."""
    rows = features.filter(F.col("geometry_type").isin("Polygon", "MultiPolygon")).select("file", "feature_idx", F.posexplode("parts").alias("part", "r"))
    rings = F.transform("r", lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), (-p[1]).alias("y"))))
    rows = rows.withColumn("rings", rings)
    area = F.aggregate(F.transform("rings", lambda ring, i: F.when(i == 0, F.abs(signed_area(ring))).otherwise(-F.abs(signed_area(ring)))), F.lit(0.0), lambda s, x: s + x)
    return rows.withColumn("area", area).filter("area > 0").drop("r")


def save_collections(collections: DataFrame, path: str, key: str, packed: bool = False) -> None:
    """Each collection (key, geojson) as a text file of its own, in a folder for its key. See save_in_parts for long tracks.
    ``packed``: a line each (read_packed) in as few files as tasks, for very many collections."""
    if packed:
        collections.select(_packed(key, "geojson")).write.text(path)
    else:
        collections.select(key, "geojson").repartition(key).write.partitionBy(key).option("maxRecordsPerFile", 1).text(path)


def _packed(key: str, text: str) -> Column:
    """A line that says whose text it is: the key as JSON, a tab, which JSON texts never have, and the text."""
    return F.concat(F.to_json(F.array(key)), F.lit("\t"), F.col(text)).alias("value")


def read_packed(spark: SparkSession, path: str, key: str, kind: str) -> DataFrame:
    """Lines of packed files: key, of type ``kind``, text and path."""
    tab = F.instr("value", "\t")
    own = F.from_json(F.substring("value", F.lit(1), tab - 1), f"array<{kind}>")[0].alias(key)
    return spark.read.text(path).select(own, F.expr("substring(value, instr(value, '\t') + 1)").alias("text"), F.col("_metadata.file_path").alias("path"))


def collection_lines(frames: DataFrame, key: str, order: str = "frame_index", chunk: int = 1 << 16) -> DataFrame:
    """A FeatureCollection a track as lines (key, section, __o, __p, text), which joined in order of the first four are its text:
    points, the trajectory (from two points on) and the bounds. No row holds more than one point, and no window more
    than the frames whose order differs by less than ``chunk``. A null order goes first, ties go by position."""
    xyz = F.array("longitude", "latitude", F.round("altitude", 3))
    time = F.col("timestamp") if "timestamp" in frames.columns else F.lit(None).cast("string")
    own = {"__o": F.coalesce(F.col(order).cast("double"), F.lit(float("-inf"))), "__p": F.struct("longitude", "latitude", "altitude"), "__xyz": F.to_json(xyz), "__time": time}
    rows = point_features(frames).select(F.col(key), "feature", *(c.alias(n) for n, c in own.items()))
    rows = with_previous(rows, key, "__o", "__p", "__last", chunk)
    place = lambda p: (p["latitude"], p["longitude"], p["altitude"])
    rows = rows.withColumn("__leg", haversine_3d(*place(F.col("__last")), *place(F.col("__p"))))

    first = F.col("__last").isNull()
    line = lambda section, text: F.struct(F.lit(section).alias("section"), text.alias("text"))
    point = line(1, F.concat(F.when(first, "").otherwise(","), F.col("feature")))
    vertex = F.when(~first, line(3, F.concat(F.lit(","), F.col("__xyz"))))
    body = rows.select(key, "__o", "__p", F.inline(F.array_compact(F.array(point, vertex))))

    p, at = F.col("__p"), F.struct("__o", "__p")
    box = [F.round(f(p[c]), n) for f in (F.min, F.max) for c, n in (("longitude", 6), ("latitude", 6), ("altitude", 2))]
    track = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("__leg"), 2).alias("d"), F.min_by("__time", at).alias("a"), F.max_by("__time", at).alias("z"), F.min_by("__xyz", at).alias("start"), F.to_json(F.array(*box)).alias("bbox"))
    props = F.to_json(F.struct(F.lit("Flight trajectory").alias("name"), F.col("n").alias("total_points"), F.col("d").alias("total_distance_meters"), F.col("a").alias("start_time"), F.col("z").alias("end_time")))
    whole = [
        line(0, F.lit('{"type":"FeatureCollection","features":[')),
        F.when(F.col("n") > 1, line(2, F.concat(F.lit(',{"type":"Feature","id":"flight_trajectory","geometry":{"type":"LineString","coordinates":['), F.col("start")))),
        F.when(F.col("n") > 1, line(4, F.concat(F.lit(']},"properties":'), props, F.lit("}")))),
        line(5, F.concat(F.lit('],"bbox":'), F.col("bbox"), F.lit("}"))),
    ]
    frame = track.select(key, F.lit(None).cast("double").alias("__o"), F.lit(None).cast(body.schema["__p"].dataType).alias("__p"), F.inline(F.array_compact(F.array(*whole))))
    return body.unionByName(frame)


def save_in_parts(lines: DataFrame, path: str, key: str, parts: int | None = None, packed: bool = False) -> DataFrame:
    """Lines as of collection_lines as text files in a folder for each key, dealt out by range, so that many tasks write
    a long track. Returns the manifest: key (as a folder names it), part, path, bytes and the byte of the collection at
    which the part begins. The files of a key in order of their parts are one valid collection. ``packed``: a file a task with
    the lines of all its keys (read_packed), for very many tracks; those of a key in order of their parts are the collection, and
    bytes counts what the part has of it."""
    by = [key, "section", "__o", "__p"]
    dealt = lines.repartitionByRange(parts, *by) if parts else lines.repartitionByRange(*by)
    dealt = dealt.sortWithinPartitions(*by)
    if packed:
        dealt.select(_packed(key, "text")).write.text(path)
        files = read_packed(lines.sparkSession, path, key, dict(lines.dtypes)[key]).groupBy(key, "path").agg(F.sum(F.octet_length("text") + 1).alias("bytes"))
    else:
        dealt.select(key, "text").write.partitionBy(key).text(path)
        files = lines.sparkSession.read.format("binaryFile").load(path).select(key, "path", F.col("length").alias("bytes"))
    files = files.withColumn("part", F.regexp_extract("path", r"/part-(\d+)-[^/]*$", 1).cast("int"))
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.select(key, "part", "path", "bytes", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("begins"))


def flag_features(features: DataFrame, invalid: DataFrame) -> DataFrame:
    """The features (file, feature_idx, ...) that the invalid records (filename, feature_idx) name."""
    return features.join(invalid.select(F.col("filename").alias("file"), "feature_idx").distinct(), ["file", "feature_idx"], "left_semi")


def edges(ring: Column) -> Column:
    """Pairs of neighbouring points of a ring of (x, y) structs."""
    return F.zip_with(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))


def signed_area(ring: Column) -> Column:
    """Shoelace area of a closed ring, positive counter-clockwise."""
    return F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + (e["x1"] * e["y2"] - e["x2"] * e["y1"])) / 2


def bounds(ring: Column) -> tuple[Column, Column, Column, Column]:
    side = lambda k: F.transform(ring, lambda p: p[k])
    return F.array_min(side("x")), F.array_min(side("y")), F.array_max(side("x")), F.array_max(side("y"))


def flip_y(ring: Column) -> Column:
    return F.transform(ring, lambda p: F.struct(p["x"].alias("x"), (-p["y"]).alias("y")))


def all_finite(ring: Column) -> Column:
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return ~F.exists(ring, lambda p: bad(p["x"]) | bad(p["y"]))


def is_closed(ring: Column) -> Column:
    first, last = F.get(ring, F.lit(0)), F.get(ring, F.size(ring) - 1)
    return F.coalesce((first["x"] == last["x"]) & (first["y"] == last["y"]), F.lit(False))


def crosses_itself(ring: Column) -> Column:
    """Whether two edges that are not neighbours cross within."""
    side = lambda ax, ay, bx, by, px, py: F.signum((bx - ax) * (py - ay) - (by - ay) * (px - ax))
    es = F.transform(edges(ring), lambda e, i: F.struct(i.alias("i"), *(e[c].alias(c) for c in ("x1", "y1", "x2", "y2"))))

    def cross(a: Column, b: Column) -> Column:
        ends_b = side(a["x1"], a["y1"], a["x2"], a["y2"], b["x1"], b["y1"]) * side(a["x1"], a["y1"], a["x2"], a["y2"], b["x2"], b["y2"])
        ends_a = side(b["x1"], b["y1"], b["x2"], b["y2"], a["x1"], a["y1"]) * side(b["x1"], b["y1"], b["x2"], b["y2"], a["x2"], a["y2"])
        return (ends_a < 0) & (ends_b < 0)

    return F.exists(es, lambda a: F.exists(es, lambda b: (b["i"] > a["i"] + 1) & cross(a, b)))


def validity(ring: Column) -> Column:
    """valid, or the first thing that is wrong: non-finite, too few points, unclosed, no area, self-crossing.
    Repairing a polygon is out of scope; only its detection is."""
    return (
        F.when(~all_finite(ring), "non-finite")
        .when(F.size(ring) < 4, "too few points")
        .when(~is_closed(ring), "unclosed")
        .when(F.abs(signed_area(ring)) < 1e-12, "no area")
        .when(crosses_itself(ring), "self-crossing")
        .otherwise("valid")
    )


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule."""
    hit = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / F.when(e["y2"] != e["y1"], e["y2"] - e["y1"]) + e["x1"])
    return F.size(F.filter(edges(ring), lambda e: F.coalesce(hit(e), F.lit(False)))) % 2 == 1


def rasterize(polygons: DataFrame, ring: str = "ring") -> DataFrame:
    """``polygons`` with one row (px, py) for each pixel whose centre lies inside (even-odd); y runs down, from 0.

    By scan lines: each line's crossings are sorted, and the pixels between the first and the second,
    the third and the fourth and so on come out as ranges; no pixel is tested by itself. A column of
    several rings counts their edges together, so holes stay free.
    """
    several = isinstance(polygons.schema[ring].dataType.elementType, ArrayType)
    outer = F.col(ring)[0] if several else F.col(ring)
    _, y0, _, y1 = bounds(outer)
    box = polygons.withColumns({"__edges": F.flatten(F.transform(ring, edges)) if several else edges(F.col(ring)), "__y0": F.floor(y0).cast("int"), "__y1": F.ceil(y1).cast("int")})
    lines = box.select("*", F.explode(F.sequence("__y0", "__y1")).alias("py"))
    y = F.col("py") + 0.5
    hit = F.filter("__edges", lambda e: (e["y1"] > y) != (e["y2"] > y))
    xs = F.sort_array(F.transform(hit, lambda e: (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]))
    lines = lines.withColumn("__xs", xs).filter("size(__xs) > 1")
    edge = lambda i: F.ceil(F.get("__xs", i) - 0.5).cast("int")
    spans = F.transform(F.sequence(F.lit(0), F.size("__xs") - 2, F.lit(2)), lambda i: F.when(edge(i + 1) > edge(i), F.sequence(edge(i), edge(i + 1) - 1)).otherwise(F.array().cast("array<int>")))
    return lines.select(*polygons.columns, F.explode(F.flatten(spans)).alias("px"), "py").select(*polygons.columns, "px", "py")


def merge_repaired(original: DataFrame, repaired: DataFrame, *keys: str, value: str = "ring") -> DataFrame:
    """``original`` with ``value`` replaced where ``repaired`` has a row for the same keys, and was_repaired."""
    other = repaired.select(*keys, F.col(value).alias("__new"), F.lit(True).alias("__has"))
    both = original.join(other, list(keys), "left")
    return both.select(*(F.when(F.col("__has"), F.col("__new")).otherwise(F.col(value)).alias(value) if c == value else F.col(c) for c in original.columns), F.coalesce("__has", F.lit(False)).alias("was_repaired"))


def repair_report(original: DataFrame, merged: DataFrame, *keys: str, group: str, value: str = "ring") -> DataFrame:
    """For each ``group`` how many polygons were invalid, how many of those have been replaced by valid ones, and how
    many are invalid still, with the share that was mended (null where nothing was invalid)."""
    wrong = lambda c: validity(F.col(c)) != "valid"
    both = original.select(*keys, group, wrong(value).alias("__was")).join(merged.select(*keys, wrong(value).alias("__is")), list(keys))
    counts = both.groupBy(group).agg(F.count_if("__was").alias("n_invalid"), F.count_if(F.col("__was") & ~F.col("__is")).alias("n_repaired"), F.count_if("__is").alias("n_left"))
    return counts.withColumn("repaired_share", F.col("n_repaired") / F.nullif("n_invalid", F.lit(0)))


def within_image(ring: Column, width: Column, height: Column) -> Column:
    """Whether annotation coordinates (y up, negative) lie in the image."""
    x0, y0, x1, y1 = bounds(ring)
    return (x0 >= 0) & (x1 <= width) & (y0 >= -height) & (y1 <= 0)
