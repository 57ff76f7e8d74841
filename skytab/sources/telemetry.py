"""Telemetry files: subtitle blocks, CSV, attitude CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

FIELDS = ["frame_cnt", "diff_time_ms", "timestamp_str", "latitude", "longitude", "altitude", "iso", "shutter", "fnum", "focal_len", "ev", "ct", "color_md", "yaw", "pitch", "roll"]


# The input format, fixed values: of each field the bracketed tags in order of preference, and the pattern by which it
# is found in text without brackets (group 1). Patterns without a word boundary match inside longer names too.
SIGNED, PLAIN = tx.NUMBER, r"(\d+\.?\d*)"
FORMAT = {
    "frame_cnt": ([], r"(?i)(?:FrameCnt|Frame)\s*[:=]\s*(\d+)"),
    "diff_time_ms": ([], r"(?i)DiffTime\s*[:=]\s*(\d+)\s*ms"),
    "timestamp_str": ([], r"(\d{4}[-/]\d{2}[-/]\d{2}\s+\d{2}:\d{2}:\d{2}(?:[,.]\d+)?)"),
    "latitude": (["latitude", "lat"], rf"(?i)(?:latitude|lat)\s*[:=]\s*{SIGNED}"),
    "longitude": (["longtitude", "longitude", "lon", "lng"], rf"(?i)(?:longtitude|longitude|lon|lng)\s*[:=]\s*{SIGNED}"),
    "altitude": (["altitude", "alt", "rel_alt"], rf"(?i)(?:altitude|alt|rel_alt)\s*[:=]\s*{SIGNED}"),
    "iso": (["iso"], r"(?i)\biso\s*[:=]\s*(\d+)"),
    "shutter": (["shutter"], r"(?i)\bshutter\s*[:=]\s*([0-9/.]+)"),
    "fnum": (["fnum"], rf"(?i)\bfnum\s*[:=]\s*{PLAIN}"),
    "focal_len": (["focal_len"], rf"(?i)\bfocal_len\s*[:=]\s*{PLAIN}"),
    "ev": (["ev"], rf"(?i)\bev\s*[:=]\s*{SIGNED}"),
    "ct": (["ct"], r"(?i)\bct\s*[:=]\s*(\d+)"),
    "color_md": (["color_md"], r"(?i)\bcolor_md\s*[:=]\s*(\w+)"),
    "yaw": (["gb_yaw", "yaw"], rf"(?i)(?:gb_yaw|yaw)\s*[:=]\s*{SIGNED}"),
    "pitch": (["gb_pitch", "pitch"], rf"(?i)(?:gb_pitch|pitch)\s*[:=]\s*{SIGNED}"),
    "roll": (["gb_roll", "roll"], rf"(?i)(?:gb_roll|roll)\s*[:=]\s*{SIGNED}"),
}
WHOLE, TEXT, ANGLES = ("frame_cnt", "diff_time_ms", "iso", "ct"), ("timestamp_str", "shutter", "color_md"), ("yaw", "pitch", "roll")
SCALES = {"fnum": 100.0, "focal_len": 10.0}


def telemetry_fields(text: Column, tags: tuple[Column, Column]) -> dict[str, Column]:
    """Columns for FIELDS of one payload text without markup, and its tag arrays.

    A bracketed tag goes before the looser pattern, and one that does not parse gives null, not what the
    pattern finds; of an angle an empty tag is as good as none.
    """
    out = {}
    for field, (names, pattern) in FORMAT.items():
        parse = tx.as_int if field in WHOLE else (lambda v: v) if field in TEXT else tx.as_double
        value = parse(tx.extract(text, pattern))
        for name in reversed(names):
            found = tx.tag(*tags, name)
            there = F.coalesce(found != "", F.lit(False)) if field in ANGLES else F.array_contains(tags[0], name)
            value = F.when(there, parse(found)).otherwise(value)
        out[field] = tx.scaled(value, SCALES[field]) if field in SCALES else value
    out["timestamp_str"] = F.replace(out["timestamp_str"], F.lit(","), F.lit("."))
    return out


def parse_payload(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """Add FIELDS of a payload column."""
    keys, values = tx.tag_arrays(F.col(text))
    tagged = df.withColumns({"__keys": keys, "__values": values})
    return tagged.withColumns(telemetry_fields(F.col(text), (F.col("__keys"), F.col("__values")))).drop("__keys", "__values")


def parse_srt(files: DataFrame, key: str = "track_id", content: str = "content") -> DataFrame:
    """Rows of subtitle files (key, content): key, index, start_sec, end_sec, mid_sec, raw_text and FIELDS.

    Blocks are set apart by blank lines and numbered with those that bear no time line, which are
    dropped. What follows the time line, markup removed, is the payload.
    """
    trimmed = F.regexp_replace(F.regexp_replace(content, "\r\n?", "\n"), r"^\s+|\s+$", "")
    blocks = files.select(key, F.posexplode(F.split(trimmed, r"\n\s*\n")).alias("at", "block"))
    lines = F.filter(F.transform(F.split("block", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    blocks = blocks.select(key, (F.col("at") + 1).alias("index"), lines.alias("lines"))
    hits = F.transform("lines", lambda x: F.rlike(x, F.lit(tx.CLOCK)))
    blocks = blocks.withColumn("line", F.array_position(hits, True).cast("int")).filter("line > 0")
    clock = F.get("lines", F.col("line") - 1)
    payload = F.array_join(F.slice("lines", F.col("line") + 1, F.size("lines")), " ")
    rows = blocks.select(key, "index", tx.clock_seconds(clock, 0).alias("start_sec"), tx.clock_seconds(clock, 1).alias("end_sec"), tx.strip_tags(payload).alias("raw_text"))
    return parse_payload(rows.withColumn("mid_sec", (F.col("start_sec") + F.col("end_sec")) / 2))


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """Subtitle files under a path; bytes that are not UTF-8 are replaced. track_id is the file's path."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("track_id"), F.try_validate_utf8(F.col("content").cast("string")).alias("ok"), "content")
    return parse_srt(files.select("track_id", F.coalesce("ok", F.make_valid_utf8(F.col("content").cast("string"))).alias("content")))


def read_csv(spark: SparkSession, path: str, key: str = "track_id") -> DataFrame:
    """Telemetry CSV with Start, End and positions, or a Text payload. Rows are numbered in file order
    within a file, which Spark reads as one line-ordered stream; Start defaults to the row's number
    from 0, End to Start + 0.04. The misspelt longtitude goes before longitude."""
    rows = spark.read.option("header", True).csv(path)
    have = {c.strip() for c in rows.columns}
    from pyspark.sql import Window

    rows = rows.withColumns({key: F.input_file_name(), "__order": F.monotonically_increasing_id()})
    rows = rows.withColumn("index", F.row_number().over(Window.partitionBy(key).orderBy("__order")))
    col = lambda c: tx.as_double(F.col(c)) if c in have else F.lit(None).cast("double")
    start = F.coalesce(col("Start"), (F.col("index") - 1).cast("double"))
    out = rows.withColumn("start_sec", start).withColumn("end_sec", F.coalesce(col("End"), F.col("start_sec") + 0.04))
    out = out.withColumn("mid_sec", (F.col("start_sec") + F.col("end_sec")) / 2).withColumn("raw_text", F.col("Text") if "Text" in have else F.lit(""))
    direct = {"latitude": col("latitude"), "longitude": col("longtitude") if "longtitude" in have else col("longitude"), "altitude": col("altitude")}
    base = [key, "index", "start_sec", "end_sec", "mid_sec", "raw_text"]
    out = out.select(*base, *(c.alias(f"__{k}") for k, c in direct.items()))
    parsed = parse_payload(out)
    placed = F.col("__latitude").isNotNull() & F.col("__longitude").isNotNull()
    own = {c: F.when(placed, F.col(f"__{c}")).otherwise(F.col(c)) for c in direct}
    rest = {c: F.when(~placed, F.col(c)) for c in FIELDS if c not in direct}
    return parsed.withColumns(own | rest).select(*base, *FIELDS)


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """By suffix: .csv is CSV, all else subtitles."""
    return read_csv(spark, path) if path.lower().endswith(".csv") else read_srt(spark, path)


ATTITUDE_COLUMNS = ["frame_id", "timestamp", "time_sec", "latitude", "longitude", "altitude", "estimated_yaw", "ground_speed", "heading_change", "vertical_speed", "camera_yaw", "camera_pitch", "camera_roll", "agl_m", "attitude_source", "course_quality"]


def read_attitude_csv(spark: SparkSession, path: str) -> DataFrame:
    """Attitude CSV: blanks and what is no number are null; a frame id may be written as a decimal."""
    rows = spark.read.option("header", True).csv(path)
    text = {"timestamp": F.nullif("timestamp", F.lit("")), "attitude_source": F.coalesce(F.nullif("attitude_source", F.lit("")), F.lit("none"))}
    number = {c: tx.as_double(F.col(c)) for c in ATTITUDE_COLUMNS if c not in text}
    number["frame_id"] = number["frame_id"].cast("int")
    number["time_sec"] = F.coalesce(number["time_sec"], F.lit(0.0))
    return rows.select(*(({**text, **number})[c].alias(c) for c in ATTITUDE_COLUMNS))


def write_attitude_csv(frames: DataFrame, path: str) -> None:
    """All columns of ATTITUDE_COLUMNS in order; nulls are blank."""
    frames.select(*ATTITUDE_COLUMNS).write.option("header", True).option("nullValue", "").option("emptyValue", "").mode("overwrite").csv(path)
