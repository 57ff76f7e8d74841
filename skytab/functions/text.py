"""Telemetry text as Column expressions: tags, fallback patterns, number syntax, XMP and EXIF values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# input formats, fixed values
CLOCK = r"(\d{2}):(\d{2}):(\d{2})[,.](\d{3})\s*-->\s*(\d{2}):(\d{2}):(\d{2})[,.](\d{3})"
TAG = r"\[\s*([\w_]+)\s*[:=]\s*([^\]]+)\s*\]"
NUMBER = r"([-+]?\d+\.?\d*)"
XMP_ATTRIBUTE = r'(?:drone-dji|Camera):(\w+)="([^"]*)"'
XMP_HEADER = '<?xpacket begin="\ufeff" id="W5M0MpCehiHzreSzNTczkc9d"?>'
XMP_FOOTER = '<?xpacket end="w"?>'
XMP_NAMESPACES = {
    "drone-dji": "http://www.dji.com/drone-dji/1.0/",
    "Camera": "http://pix4d.com/camera/1.0/",
    "photomechanic": "http://ns.camerabits.com/photomechanic/1.0/",
}
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """Null where the pattern is not found."""
    found = F.regexp_extract(text, pattern, group)
    return F.when(F.rlike(text, F.lit(pattern)), found)


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", " ")


def _last_wins(keys: Column, values: Column) -> Column:
    """Map from parallel arrays; of a key that repeats the last value counts."""
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    later = lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), p["k"])
    return F.map_from_entries(F.filter(pairs, later))


def tag_arrays(text: Column) -> tuple[Column, Column]:
    """Keys in lower case and trimmed values of bracketed ``[key : value]`` pairs, last pair first.

    Keep both as columns before looking tags up: then the text is searched twice, whatever the number of lookups.
    """
    keys = F.transform(F.reverse(F.regexp_extract_all(text, F.lit(TAG), F.lit(1))), lambda k: F.lower(F.trim(k)))
    return keys, F.transform(F.reverse(F.regexp_extract_all(text, F.lit(TAG), F.lit(2))), lambda v: F.trim(v))


def tag(keys: Column, values: Column, name: str) -> Column:
    """The value of the last pair with a key; null without one."""
    return F.get(values, F.array_position(keys, name).cast("int") - 1)


def xmp_map(packet: Column) -> Column:
    """Attitude attributes of an XMP packet."""
    return _last_wins(F.regexp_extract_all(packet, F.lit(XMP_ATTRIBUTE), F.lit(1)), F.regexp_extract_all(packet, F.lit(XMP_ATTRIBUTE), F.lit(2)))


def as_double(text: Column) -> Column:
    return F.when(F.rlike(F.trim(text), F.lit(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$")), F.trim(text).try_cast("double"))


def as_int(text: Column) -> Column:
    """Whole-number syntax only: "100.0" is null."""
    return F.when(F.rlike(text, F.lit(r"^\s*[+-]?\d+\s*$")), F.trim(text).try_cast("int"))


def clock_seconds(text: Column, side: int) -> Column:
    """Seconds of the start (0) or end (1) of a subtitle's time line."""
    h, m, s, ms = (F.regexp_extract(text, CLOCK, 4 * side + k).try_cast("int") for k in (1, 2, 3, 4))
    return h * 3600 + m * 60 + s + ms / 1000.0


def scaled(value: Column, by: float) -> Column:
    """Values of 100 or more are written in fractions: divide them."""
    return F.when(value >= 100, value / by).otherwise(value)


def dms_rational(degrees: Column) -> Column:
    """|degrees| as (d, 1), (m, 1), (s, 1000000)."""
    a = F.abs(degrees)
    d = F.floor(a)
    m = F.floor((a - d) * 60)
    s = F.rint(((a - d) * 60 - m) * 60 * 1_000_000).cast("long")
    part = lambda n, den: F.struct(n.cast("long").alias("num"), F.lit(den).cast("long").alias("den"))
    return F.struct(part(d, 1).alias("d"), part(m, 1).alias("m"), part(s, 1_000_000).alias("s"))


def dms_decimal(dms: Column, ref: Column) -> Column:
    """Degrees of a (d, m, s) struct of rationals; south and west are negative; null for a zero denominator."""
    value = lambda p: F.when(p["den"] != 0, p["num"] / p["den"])
    out = value(dms["d"]) + value(dms["m"]) / 60 + value(dms["s"]) / 3600
    return F.when(ref.isin("S", "W"), -out).otherwise(out)


def shutter_rational(text: Column) -> Column:
    """``a/b`` as (1000 a, 1000 b), a positive decimal x as (1, round(1 / x)); else null."""
    trimmed = F.trim(text)
    parts = F.split(trimmed, "/")
    a, b, x = as_double(F.get(parts, F.lit(0))), as_double(F.get(parts, F.lit(1))), as_double(trimmed)
    pair = lambda n, d: F.struct(n.cast("long").alias("num"), d.cast("long").alias("den"))
    slash = F.contains(trimmed, F.lit("/"))
    return F.when(slash & a.isNotNull() & b.isNotNull(), pair(F.rint(a * 1000), F.rint(b * 1000))).when(~slash & (x > 0), pair(F.lit(1), F.rint(1 / x)))


def signed(value: Column, places: int = 2) -> Column:
    return F.when(value.isNotNull(), F.format_string(f"%+.{places}f", value))


def xml_attribute(name: str, value: Column) -> Column:
    """``name="value"`` with the value escaped; null for a null value."""
    safe = F.replace(F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.concat(F.lit(f'{name}="'), F.replace(safe, F.lit('"'), F.lit("&quot;")), F.lit('"'))


def xmp_attributes(gimbal_yaw: Column, gimbal_pitch: Column, gimbal_roll: Column, absolute_altitude: Column, relative_altitude: Column, latitude: Column, longitude: Column, flight_yaw: Column) -> Column:
    """The attributes of an XMP packet, one a line; what is null is left out."""
    turn = lambda a: F.pmod(a, F.lit(360.0))
    plain = lambda v, f: F.when(v.isNotNull(), F.format_string(f, v))
    return F.concat_ws(
        "\n",
        xml_attribute("drone-dji:GimbalRollDegree", signed(gimbal_roll)),
        xml_attribute("drone-dji:GimbalPitchDegree", signed(gimbal_pitch)),
        xml_attribute("drone-dji:GimbalYawDegree", signed(turn(gimbal_yaw))),
        xml_attribute("drone-dji:FlightYawDegree", signed(turn(flight_yaw))),
        xml_attribute("drone-dji:AbsoluteAltitude", signed(absolute_altitude)),
        xml_attribute("drone-dji:RelativeAltitude", signed(relative_altitude)),
        xml_attribute("drone-dji:GpsLatitude", plain(latitude, "%.8f")),
        xml_attribute("drone-dji:GpsLongitude", plain(longitude, "%.8f")),
        xml_attribute("Camera:Yaw", plain(turn(gimbal_yaw), "%.2f")),
        xml_attribute("Camera:Pitch", plain(gimbal_pitch, "%.2f")),
        xml_attribute("Camera:Roll", plain(gimbal_roll, "%.2f")),
    )


def xml_text(value: Column) -> Column:
    return F.replace(F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def xmp_packet(attributes: Column, source: Column, software: str) -> Column:
    """A whole XMP packet around attributes as of xmp_attributes (none: an empty text), with a note of where
    the attitude comes from, unless that is null or empty."""
    names = "\n".join(f'    xmlns:{k}="{v}"' for k, v in XMP_NAMESPACES.items())
    lines = F.when(attributes == "", F.lit("")).otherwise(F.concat(F.regexp_replace(attributes, "(?m)^", "    "), F.lit("\n")))
    note = F.when(F.coalesce(source, F.lit("")) != "", F.concat(F.lit("\n   <photomechanic:Prefs>attitude-source: "), xml_text(source), F.lit("</photomechanic:Prefs>"))).otherwise(F.lit(""))
    head = F.concat(F.lit(f'{XMP_HEADER}\n<x:xmpmeta xmlns:x="adobe:ns:meta/" '), xml_attribute("x:xmptk", F.lit(software)), F.lit(f'>\n <rdf:RDF xmlns:rdf="{RDF}">\n  <rdf:Description rdf:about=""\n{names}\n'))
    return F.concat(head, lines, F.lit("  >"), note, F.lit(f"\n  </rdf:Description>\n </rdf:RDF>\n</x:xmpmeta>\n{XMP_FOOTER}"))


def image_description(frame: Column, latitude: Column, longitude: Column, altitude: Column) -> Column:
    gps = F.when(latitude.isNotNull() & longitude.isNotNull(), F.format_string("GPS: (%.6f, %.6f)", latitude, longitude))
    return F.concat_ws(" | ", F.concat(F.lit("Frame: "), frame.cast("string")), gps, F.when(altitude.isNotNull(), F.format_string("Alt: %.2fm", altitude)))


def pick(*values: Column) -> Column:
    """The first text that is a number."""
    return F.coalesce(*(as_double(v) for v in values))
