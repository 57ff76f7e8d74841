"""EXIF blocks as bytes, put together by Column expressions: directories, offset tables and the telemetry comment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .mosaic import exif_fields

# TIFF value types, fixed values
BYTE, ASCII, SHORT, LONG, RATIONAL, UNDEFINED = 1, 2, 3, 4, 5, 7


def _number(value: Column, size: int) -> Column:
    """Big-endian hex digits of a whole number of ``size`` bytes."""
    return F.lpad(F.hex(value.cast("long")), 2 * size, "0")


def _ratio(value: Column) -> Column:
    return F.concat(_number(value["num"], 4), _number(value["den"], 4))


def _entry(tag: int, kind: int, count: Column | int, data: Column) -> Column:
    """A directory entry whose value is ``data`` in hex digits; null where that is null."""
    count = F.lit(count) if isinstance(count, int) else count
    row = F.struct(F.lit(f"{tag:04X}{kind:04X}").alias("head"), count.cast("long").alias("n"), data.alias("data"))
    return F.when(data.isNotNull(), row)


def _ascii(tag: int, value: Column) -> Column:
    return _entry(tag, ASCII, F.octet_length(value) + 1, F.concat(F.hex(F.encode(value, "UTF-8")), F.lit("00")))


def _outside(entry: Column) -> Column:
    """Hex digits that do not fit in the entry, filled up to whole words of two bytes."""
    digits = F.length(entry["data"])
    return F.when(digits <= 8, F.lit("")).otherwise(F.concat(entry["data"], F.when(digits % 4 != 0, F.lit("00")).otherwise(F.lit(""))))


def _size(entries: Column) -> Column:
    """Bytes of a directory and of the values behind it."""
    return 6 + 12 * F.size(entries) + F.aggregate(entries, F.lit(0), lambda n, e: n + F.length(_outside(e))).cast("long") / F.lit(2)


def _directory(entries: Column, at: Column) -> Column:
    """Hex digits of a directory that begins at the byte ``at``: its entries, then what they point to."""
    tail = at + 6 + 12 * F.size(entries)
    none = F.struct(F.lit("").alias("table"), F.lit("").alias("tail"))

    def add(done: Column, e: Column) -> Column:
        place = F.when(F.length(e["data"]) <= 8, F.rpad(e["data"], 8, "0")).otherwise(_number(tail + F.length(done["tail"]) / 2, 4))
        return F.struct(F.concat(done["table"], e["head"], _number(e["n"], 4), place).alias("table"), F.concat(done["tail"], _outside(e)).alias("tail"))

    return F.aggregate(entries, none, add, lambda d: F.concat(_number(F.size(entries), 2), d["table"], F.lit("00000000"), d["tail"]))


def telemetry_comment(**values: Column) -> Column:
    """JSON of telemetry values by name; what is null is written as null."""
    return F.to_json(F.struct(*(v.alias(k) for k, v in values.items())), {"ignoreNullFields": "false"})


def with_exif_bytes(
    frames: DataFrame,
    *,
    latitude: Column,
    longitude: Column,
    altitude: Column,
    timestamp: Column,
    iso: Column,
    shutter: Column,
    fnum: Column,
    focal: Column,
    yaw: Column,
    pitch: Column,
    roll: Column,
    frame_index: Column,
    extra: dict[str, Column] | None = None,
    make: str = "DJI",
    model: str = "Drone Camera",
    software: str = "skytab",
    out: str = "exif",
) -> DataFrame:
    """``frames`` with an EXIF block as bytes: camera and time, position, and all telemetry as JSON in the user comment,
    with what ``extra`` names, which goes before. A value that is null has no entry, nor have a shutter that is no
    number and a timestamp that is none. Big-endian, offsets from behind the leading ``Exif`` mark."""
    note = {"frame_index": frame_index, "timestamp": timestamp, "latitude": latitude, "longitude": longitude, "altitude_m": altitude, "iso": iso, "shutter": shutter, "fnum": fnum, "focal_len": focal, "yaw": yaw, "pitch": pitch, "roll": roll}
    rows = frames.withColumns(
        {
            "__f": exif_fields(iso, fnum, focal, latitude, longitude, altitude, yaw, timestamp),
            "__shutter": tx.shutter_rational(shutter),
            "__about": F.nullif(tx.image_description(frame_index, latitude, longitude, altitude), F.lit("")),
            "__note": telemetry_comment(**(note | (extra or {}))),
        }
    )
    f = F.col("__f")
    dms = lambda v: F.when(v.isNotNull(), F.concat(_ratio(v["d"]), _ratio(v["m"]), _ratio(v["s"])))
    rational = lambda tag, v: _entry(tag, RATIONAL, 1, F.when(v.isNotNull(), _ratio(v)))
    clock = F.concat(*(F.concat(_number(f["gps_time"][k], 4), F.lit("00000001")) for k in range(3)))
    mark = F.hex(F.lit(b"ASCII\0\0\0"))
    exif = [
        rational(0x829A, F.col("__shutter")),
        rational(0x829D, f["fnum"]),
        _entry(0x8827, SHORT, 1, _number(f["iso"], 2)),
        _entry(0x9000, UNDEFINED, 4, F.hex(F.lit(b"0231"))),
        _ascii(0x9003, f["taken"]),
        _ascii(0x9004, f["taken"]),
        rational(0x920A, f["focal"]),
        _entry(0x9286, UNDEFINED, F.octet_length("__note") + 8, F.concat(mark, F.hex(F.encode("__note", "UTF-8")))),
        _entry(0xA405, SHORT, 1, _number(f["focal_35mm"], 2)),
    ]
    gps = [
        _entry(0, BYTE, 4, F.lit("02030000")),
        _ascii(1, f["latitude_ref"]),
        _entry(2, RATIONAL, 3, F.when(f["latitude_ref"].isNotNull(), dms(f["latitude"]))),
        _ascii(3, f["longitude_ref"]),
        _entry(4, RATIONAL, 3, F.when(f["longitude_ref"].isNotNull(), dms(f["longitude"]))),
        _entry(5, BYTE, 1, _number(f["altitude_ref"], 1)),
        rational(6, f["altitude"]),
        _entry(7, RATIONAL, 3, clock),
        _ascii(16, F.when(f["direction"].isNotNull(), F.lit("T"))),
        rational(17, f["direction"]),
        _ascii(18, F.lit("WGS-84")),
        _ascii(29, f["gps_date"]),
    ]
    top = [
        _ascii(0x010E, F.col("__about")),
        _ascii(0x010F, F.lit(make)),
        _ascii(0x0110, F.lit(model)),
        _entry(0x011A, RATIONAL, 1, F.lit("0000004800000001")),
        _entry(0x011B, RATIONAL, 1, F.lit("0000004800000001")),
        _entry(0x0128, SHORT, 1, F.lit("0002")),
        _ascii(0x0131, F.lit(software)),
        _ascii(0x0132, f["taken"]),
    ]
    rows = rows.withColumns({"__exif": F.array_compact(F.array(*exif)), "__gps": F.array_compact(F.array(*gps)), "__top": F.array_compact(F.array(*top))})
    # the first directory has two entries more, which say where the others begin
    rows = rows.withColumn("__at", 8 + 24 + _size(F.col("__top"))).withColumn("__gps_at", F.col("__at") + _size(F.col("__exif")))
    pointers = F.array(_entry(0x8769, LONG, 1, _number(F.col("__at"), 4)), _entry(0x8825, LONG, 1, _number(F.col("__gps_at"), 4)))
    whole = F.concat(F.hex(F.lit(b"Exif\0\0MM\0*\0\0\0\x08")), _directory(F.concat("__top", pointers), F.lit(8)), _directory(F.col("__exif"), F.col("__at")), _directory(F.col("__gps"), F.col("__gps_at")))
    return rows.withColumn(out, F.unhex(whole)).drop("__f", "__shutter", "__about", "__note", "__exif", "__gps", "__top", "__at", "__gps_at")
