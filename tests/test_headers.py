from __future__ import annotations

import io
import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F
from skytab.operators import exif
from skytab.sources import files, headers
from test_sources import ifd, jpeg

SCHEMA = "id int, latitude double, longitude double, altitude double, stamp string, iso int, shutter string, fnum double, focal double, yaw double, pitch double, roll double, zoom string"
FULL = (1, -13.5, 79.26, -4.25, "2024-05-01 11:35:42,416", 100, "1/640.0", 2.8, 28.0, -6.5, -38.1, 1.5, 'a "b" é')
EMPTY = (2, *[None] * 12)
PART = (3, 0.0, -0.000001, 214.707, "no time", None, "x", None, 24.4, 360.0, None, None, None)


@pytest.fixture(scope="module")
def blocks(spark):
    rows = spark.createDataFrame([FULL, EMPTY, PART], SCHEMA)
    c = F.col
    made = exif.with_exif_bytes(rows, latitude=c("latitude"), longitude=c("longitude"), altitude=c("altitude"), timestamp=c("stamp"), iso=c("iso"), shutter=c("shutter"), fnum=c("fnum"), focal=c("focal"), yaw=c("yaw"), pitch=c("pitch"), roll=c("roll"), frame_index=c("id"), extra={"zoom": c("zoom")})
    assert made.columns == [*rows.columns, "exif"]
    return {r.id: bytes(r.exif) for r in made.collect()}


def segment(marker, body):
    return b"\xff" + bytes([marker]) + struct.pack(">H", len(body) + 2) + body


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(exif_block, xmp, pixels=0):
    head = struct.pack(">IIBBBBB", 640, 480, 8, 2, 0, 0, 0)
    return headers.PNG_SIGNATURE + chunk(b"IHDR", head) + chunk(b"iTXt", headers.XMP_PNG + b"\1\0\0\0" + zlib.compress(xmp)) + chunk(b"eXIf", exif_block) + chunk(b"IDAT", b"\0" * pixels) + chunk(b"IEND", b"")


def tiff(xmp, pixels=0):
    """Little-endian, its directories behind the pixels."""
    ratio = lambda *v: b"".join(struct.pack("<II", a, b) for a, b in v)
    at = 8 + pixels
    place = ifd([(1, 2, 2, b"N\0"), (2, 5, 3, ratio((48, 1), (30, 1), (0, 1))), (3, 2, 2, b"W\0"), (4, 5, 3, ratio((2, 1), (15, 1), (0, 1)))], at + 4000)
    top = ifd([(0x100, 4, 1, struct.pack("<I", 70000)), (0x101, 3, 1, struct.pack("<H", 500)), (0x111, 4, 9999, b"\0" * 8), (0x2BC, 1, len(xmp), xmp), (0x8825, 4, 1, struct.pack("<I", at + 4000))], at)
    return b"II*\0" + struct.pack("<I", at) + b"\0" * pixels + top.ljust(4000, b"\0") + place


def wide_tiff():
    """Offsets of eight bytes."""
    entry = lambda tag, kind, n, value: struct.pack("<HHQ", tag, kind, n) + value.ljust(8, b"\0")
    head = b"II" + struct.pack("<HHHQ", 43, 8, 0, 16)
    top = struct.pack("<Q", 3) + entry(0x100, 3, 1, struct.pack("<H", 9)) + entry(0x101, 3, 1, struct.pack("<H", 7)) + entry(0x8825, 16, 1, struct.pack("<Q", 200)) + b"\0" * 8
    gps = struct.pack("<Q", 2) + entry(17, 5, 1, struct.pack("<II", 9000, 100)) + entry(6, 5, 1, struct.pack("<II", 5, 2)) + b"\0" * 8
    return (head + top).ljust(200, b"\0") + gps


def test_written_values_are_read_back(spark, tmp_path, blocks):
    for k, block in blocks.items():
        (tmp_path / f"{k}.jpg").write_bytes(b"\xff\xd8" + segment(0xE1, block) + segment(0xC2, struct.pack(">BHH", 8, 2160, 3840)) + b"\xff\xda")
    got = {r.path.rsplit("/", 1)[1][0]: r for r in headers.read_raw_metadata(spark, str(tmp_path)).collect()}
    full, empty, part = got["1"], got["2"], got["3"]
    assert (full.width, full.height, full.latitude, full.gps_altitude, full.focal_length, full.focal_35mm, full.direction, full.taken) == (3840, 2160, -13.5, 4.25, 28.0, 28.0, 353.5, "2024:05:01 11:35:42")
    assert full.longitude == pytest.approx(79.26, abs=1e-9)
    names = ["frame_index", "timestamp", "latitude", "longitude", "altitude_m", "iso", "shutter", "fnum", "focal_len", "yaw", "pitch", "roll", "zoom"]
    values = [FULL[0], FULL[4], *FULL[1:4], *FULL[5:]]
    assert json.loads(full.comment) == dict(zip(names, values))
    assert [empty[c] for c in ("latitude", "longitude", "gps_altitude", "focal_length", "direction", "taken")] == [None] * 6
    assert json.loads(empty.comment) == dict.fromkeys(names) | {"frame_index": 2}
    assert (part.latitude, part.longitude, part.focal_length, part.focal_35mm, part.direction, part.taken) == (0.0, pytest.approx(-1e-6, abs=1e-12), 24.4, 24.0, 0.0, None)


def test_directories_are_sorted_and_even(blocks):
    for block in blocks.values():
        body = block[6:]
        assert block[:6] == b"Exif\0\0" and body[:8] == b"MM\0*\0\0\0\x08"
        todo, end = [8], 0
        while todo:
            at = todo.pop()
            assert at % 2 == 0
            (n,) = struct.unpack_from(">H", body, at)
            tags = []
            for k in range(n):
                tag, kind, count, place = struct.unpack_from(">HHII", body, at + 2 + 12 * k)
                size = headers.TIFF_TYPES[kind][0] * count
                tags.append(tag)
                if tag in (0x8769, 0x8825):
                    todo.append(place)
                elif size > 4:
                    assert place % 2 == 0 and place + size <= len(body)
                    end = max(end, place + size + size % 2)
            assert tags == sorted(set(tags))
        assert end == len(body)


def test_three_formats_by_a_few_blocks(spark, tmp_path, blocks):
    big, xmp = 3_000_000, b'drone-dji:GimbalPitchDegree="-80.50" drone-dji:RelativeAltitude="+9.00"'
    (tmp_path / "a.jpg").write_bytes(jpeg(xmp.decode()) + b"\0" * big)
    (tmp_path / "b.PNG").write_bytes(png(blocks[1][6:], xmp, big))
    (tmp_path / "c.tiff").write_bytes(tiff(xmp, big))
    (tmp_path / "d e%20f.tif").write_bytes(tiff(xmp))
    (tmp_path / "f.tif").write_bytes(wide_tiff())
    raw = headers.read_raw_metadata(spark, str(tmp_path))
    assert raw.count() == 5 and raw.agg(F.max("bytes_read")).first()[0] < 32_768
    got = {r.filename: r for r in files.scan_directory(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["a.jpg", "b.PNG", "c.tiff", "d e%20f.tif"]
    assert {(r.pitch_deg, r.agl_m, r.pose_is_known) for r in got.values()} == {(-80.5, 9.0, True)}
    assert (got["b.PNG"].width, got["b.PNG"].height, got["b.PNG"].latitude) == (640, 480, -13.5)
    assert (got["c.tiff"].width, got["c.tiff"].height, got["c.tiff"].latitude, got["c.tiff"].longitude) == (70000, 500, 48.5, -2.25)
    wide = raw.filter(F.endswith("path", F.lit("f.tif")) & (F.col("width") == 9)).first()
    assert (wide.height, wide.direction, wide.gps_altitude, wide.latitude) == (7, 90.0, 2.5, None)


def test_broken_files(blocks):
    whole = {"jpeg": jpeg("x"), "png": png(blocks[1][6:], b"x"), "tiff": tiff(b"xmp"), "wide": wide_tiff()}
    for data in whole.values():
        for n in range(0, len(data), 7):
            headers.image_metadata(headers.Blocks(io.BytesIO(data[:n])))  # whatever is missing, no error
    endless = b"II*\0\x08\0\0\0" + struct.pack("<HHHII", 1, 0x2BC, 1, 2**32 - 1, 8)
    assert headers.image_metadata(headers.Blocks(io.BytesIO(endless + b"\0" * 8))) is None
    assert headers.image_metadata(headers.Blocks(io.BytesIO(b""))) is None
