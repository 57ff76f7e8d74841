from __future__ import annotations

import struct

import pytest
from pyspark.sql import functions as F
from skytab.functions import geodesy
from skytab.functions import text as tx
from skytab.operators import sampling
from skytab.sources import files, telemetry

SRT = """1
00:00:00,000 --> 00:00:00,041
<font size="28">FrameCnt : 1, DiffTime : 41ms
2024-05-01 11:35:42,416,841
[iso : 100] [shutter : 1/640.0] [fnum : 280] [ev : 0.7] [ct : 5378] [color_md : default] [focal_len : 280] [latitude : 13.398962] [longtitude : 79.563553] [altitude: 214.707001] </font>

no clock in this block

3
00:00:00.041 --> 00:00:00,083
FrameCnt : 2 [lat: 13.0] [lon: 79.0]

4
00:01:00,083 --> 00:01:00,125
"""


def test_srt(spark, tmp_path):
    (tmp_path / "a.SRT").write_bytes(SRT.encode() + b"\xff")
    rows = telemetry.read_telemetry(spark, str(tmp_path / "a.SRT")).orderBy("index").collect()
    assert [r["index"] for r in rows] == [1, 3, 4]
    a = rows[0]
    assert (a.frame_cnt, a.diff_time_ms, a.timestamp_str, a.iso, a.shutter, a.ct, a.color_md) == (1, 41, "2024-05-01 11:35:42.416", 100, "1/640.0", 5378, "default")
    assert (a.fnum, a.focal_len, a.ev, a.latitude, a.longitude, a.altitude) == (2.8, 28.0, 0.7, 13.398962, 79.563553, 214.707001)
    assert (a.start_sec, a.end_sec, a.mid_sec) == (0.0, 0.041, 0.0205)
    assert (rows[1].latitude, rows[1].longitude, rows[1].frame_cnt, rows[1].iso) == (13.0, 79.0, 2, None)
    assert rows[2].start_sec == 60.083 and rows[2].latitude is None


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Start,End,Text,latitude,longtitude,altitude\n1.5,2.5,x,13.1,79.1,10\n,,[iso: 200] [lat: 5.5],,,\n")
    a, b = telemetry.read_telemetry(spark, str(tmp_path / "a.csv")).orderBy("index").collect()
    assert (a.start_sec, a.mid_sec, a.latitude, a.longitude, a.iso) == (1.5, 2.0, 13.1, 79.1, None)
    assert (b.start_sec, b.end_sec, b.latitude, b.iso) == (1.0, 1.04, 5.5, 200)


def test_attitude_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "att")
    kinds = {"timestamp": "string", "attitude_source": "string", "frame_id": "int"}
    schema = ", ".join(f"`{c}` {kinds.get(c, 'double')}" for c in telemetry.ATTITUDE_COLUMNS)
    row = [1, None, 0.5, 13.0, 79.0, None, None, 9.0, None, 0.0, None, -38.5, 1.5, 55.2, "visual-homography", 1.0]
    telemetry.write_attitude_csv(spark.createDataFrame([row], schema), path)
    assert list(telemetry.read_attitude_csv(spark, path).first()) == row
    (tmp_path / "b.csv").write_text(",".join(telemetry.ATTITUDE_COLUMNS) + "\n7.0,,,abc" + "," * 12 + "\n")
    r = telemetry.read_attitude_csv(spark, str(tmp_path / "b.csv")).first()
    assert (r.frame_id, r.time_sec, r.latitude, r.attitude_source) == (7, 0.0, None, "none")


def scalars(spark, *columns):
    return list(spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(columns))).first())


def test_exif_values(spark):
    d, s1, s2, s3, s4, s5 = scalars(spark, tx.dms_rational(F.lit(13.398962)), *(tx.shutter_rational(F.lit(x)) for x in ("1/640.0", "1/500", "0.002", "x/2", "-1")))
    assert (d.d.num, d.m.num, d.s.den) == (13, 23, 1_000_000) and abs(d.s.num - 56263200) <= 1
    assert (tuple(s1), tuple(s2), tuple(s3), s4, s5) == ((1000, 640000), (1000, 500000), (1, 500), None, None)
    assert scalars(spark, tx.image_description(F.lit(3), F.lit(1.5), F.lit(None).cast("double"), F.lit(7.0))) == ["Frame: 3 | Alt: 7.00m"]


def test_xmp(spark):
    none = F.lit(None).cast("double")
    (text,) = scalars(spark, tx.xmp_attributes(F.lit(-7.0), none, F.lit(1.5), none, none, none, none, F.lit(371.5)))
    assert text.split("\n") == ['drone-dji:GimbalRollDegree="+1.50"', 'drone-dji:GimbalYawDegree="+353.00"', 'drone-dji:FlightYawDegree="+11.50"', 'Camera:Yaw="353.00"', 'Camera:Roll="1.50"']
    assert scalars(spark, tx.xml_attribute("a", F.lit('<"&>'))) == ['a="&lt;&quot;&amp;&gt;"']


def test_geodesy(spark):
    lon, lat = F.lit(79.563553), F.lit(13.398962)
    x, y = geodesy.utm_forward(lon, lat)
    back = geodesy.utm_inverse(x, y, F.lit(44), F.lit(False))
    none = F.lit(None).cast("double")
    foot = geodesy.footprint(F.lit(3840), F.lit(2160), none, F.lit(200.0), none, F.lit(28.0), F.lit(6.4), F.lit(4.8))
    got = scalars(spark, geodesy.utm_epsg(lon, lat), geodesy.utm_epsg(F.lit(2.35), F.lit(48.85)), geodesy.utm_epsg(F.lit(180.0), F.lit(-1.0)), *back, foot[0], geodesy.haversine_3d(lat, lon, F.lit(0.0), lat, lon, F.lit(3.0)), *geodesy.utm_forward(F.lit(9.0), F.lit(45.0), F.lit(32)))
    assert got[:3] == ["EPSG:32644", "EPSG:32631", "EPSG:32761"]
    assert got[3] == pytest.approx(79.563553, abs=1e-9) and got[4] == pytest.approx(13.398962, abs=1e-9)
    assert got[5] == pytest.approx(200 * 6.4 / 28, abs=1e-3) and got[6] == 3.0
    # on a central meridian northing is the scaled meridian arc: 4982950.400 m to 45 degrees
    assert got[7] == pytest.approx(500000.0, abs=1e-6) and got[8] == pytest.approx(0.9996 * 4984944.378, abs=0.01)


def ifd(entries, at):
    """Little-endian TIFF directory at an offset: (tag, type, count, packed value)."""
    head, tail, end = b"", b"", at + 2 + 12 * len(entries) + 4
    for tag, kind, n, value in entries:
        place = value.ljust(4, b"\0") if len(value) <= 4 else struct.pack("<I", end + len(tail))
        tail += b"" if len(value) <= 4 else value
        head += struct.pack("<HHI", tag, kind, n) + place
    return struct.pack("<H", len(entries)) + head + b"\0" * 4 + tail


def jpeg(xmp="", comment=b"", gps=True):
    ratio = lambda *v: b"".join(struct.pack("<II", a, b) for a, b in v)
    exif = ifd([(0x920A, 5, 1, ratio((2800, 100))), (0xA405, 3, 1, struct.pack("<H", 28)), (0x9003, 2, 20, b"2024:05:01 11:35:42\0"), (0x9286, 7, len(comment), comment)], 100)
    place = ifd([(1, 2, 2, b"S\0"), (2, 5, 3, ratio((13, 1), (30, 1), (0, 1))), (3, 2, 2, b"E\0"), (4, 5, 3, ratio((79, 1), (15, 1), (36, 1))), (6, 5, 1, ratio((214707, 1000))), (17, 5, 1, ratio((9000, 100)))], 1000)
    top = ifd([(0x8769, 4, 1, struct.pack("<I", 100)), (0x8825, 4, 1, struct.pack("<I", 1000))] if gps else [], 8)
    tiff = bytearray(b"II*\0\x08\0\0\0" + b"\0" * 1500)
    for at, part in ((8, top), (100, exif), (1000, place)):
        tiff[at : at + len(part)] = part
    segment = lambda marker, body: b"\xff" + bytes([marker]) + struct.pack(">H", len(body) + 2) + body
    return b"\xff\xd8" + segment(0xE1, b"Exif\0\0" + bytes(tiff)) + segment(0xE1, b"http://ns.adobe.com/xap/1.0/\0" + xmp.encode()) + segment(0xC0, struct.pack(">BHH", 8, 2160, 3840) + b"\0" * 6) + b"\xff\xda"


def test_image_folder(spark, tmp_path):
    (tmp_path / "b.jpg").write_bytes(jpeg('drone-dji:GimbalPitchDegree="-38.10" drone-dji:GimbalYawDegree="+153.50" drone-dji:RelativeAltitude="+54.60"'))
    (tmp_path / "c.JPEG").write_bytes(jpeg(comment=b'ASCII\0\0\0{"pitch": -89.0, "yaw": 12.5}'))
    (tmp_path / "a.jpg").write_bytes(b"no jpeg")
    (tmp_path / "d.jpg").write_bytes(jpeg(gps=False))
    (tmp_path / "e.txt").write_text("x")
    b, c = files.scan_directory(spark, str(tmp_path)).orderBy("filename").collect()
    assert (b.filename, b.width, b.height, b.latitude, b.focal_length_mm, b.focal_35mm) == ("b.jpg", 3840, 2160, -13.5, 28.0, 28.0)
    assert b.longitude == pytest.approx(79.26) and (b.yaw_deg, b.pitch_deg, b.agl_m, b.pose_is_known, b.altitude_m) == (153.5, -38.1, 54.6, True, 214.707)
    assert (c.yaw_deg, c.pitch_deg, c.roll_deg, c.agl_m, c.pose_is_known, c.timestamp_str) == (12.5, -89.0, 0.0, None, False, "2024:05:01 11:35:42")
    assert [r.filename for r in files.scan_directory(spark, str(tmp_path), 1).collect()] == ["b.jpg"]


def test_ply_and_inventories(spark, tmp_path):
    head = "ply\nformat ascii 1.0\nelement vertex 4\nproperty float z\nproperty float x\nproperty float y\nproperty float nx\nelement face 2\nproperty list uchar int vertex_indices\nend_header\n"
    (tmp_path / "p.ply").write_text(head + "".join(f"{k} {k}.5 7 1\n" for k in range(4)) + "3 0 1 2\n3 1 2 3\n")
    got = sorted((r.x, r.y, r.z, r.nx, r.ny) for r in files.read_ply(spark, str(tmp_path / "p.ply")).collect())
    assert got == [(k + 0.5, 7.0, float(k), 1.0, None) for k in range(4)]
    with pytest.raises(ValueError):
        files.read_ply(spark, str(tmp_path / "p.ply"), 5)
    for name in ("A_2sec_orthophoto.tif", "B_orthophoto.tif", "B_orthophoto_preview.tif", "C_orthophoto.tif"):
        (tmp_path / name).write_bytes(b"x")
    images = files.list_images(spark, str(tmp_path))
    notes = spark.createDataFrame([("A.geojson",), ("B_orthophoto.geojson",), ("z.geojson",)], "name string")
    inventory = spark.createDataFrame([("C_orthophoto.tif", "z.geojson")], "filename string, annotation string")
    got = {r.filename: r.annotation for r in files.find_annotation(images, notes, inventory).collect()}
    assert got == {"A_2sec_orthophoto.tif": "A.geojson", "B_orthophoto.tif": "B_orthophoto.geojson", "C_orthophoto.tif": "z.geojson"}
    (tmp_path / "pairs.json").write_text('[{"id": "F1", "before": "a", "after": "b"}, {"id": "F2", "before": "c", "after": "d"}]')
    assert files.read_pairs(spark, str(tmp_path / "pairs.json"), "F2").first().after == "d"


def test_parameters(spark):
    df = spark.createDataFrame([(x,) for x in (None, "", "null", "0", "-1", "abc", "2.5")], "v string")
    assert [r[0] for r in df.select(sampling.positive_or(F.col("v"), 1.0)).collect()] == [1.0] * 6 + [2.5]


def test_empty_ranges(spark):
    v = spark.createDataFrame([(1, 0, 24.0), (2, 5, 24.0), (3, 5, 0.0)], "id long, total_frames long, fps double")
    assert {r.id for r in sampling.frame_targets(v.filter("id < 3"), start_sec=10.0).collect()} == set()
    assert {r.t_sec for r in sampling.frame_targets(v.filter("id = 3")).collect()} == {None}
    assert sorted((r.id, r.frame_idx) for r in sampling.frame_targets(v.filter("id = 2"), frame_step=3).collect()) == [(2, 0), (2, 3)]
    assert sampling.frame_targets(v.filter("id < 3"), interval_sec=0.1).filter("id = 2").count() == 2
