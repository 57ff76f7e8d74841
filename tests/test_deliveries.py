"""What goes in and out: inventories, packets, change sets, parts with holes, jobs."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from skytab.functions import camera
from skytab.functions import text as tx
from skytab.operators import detections as det
from skytab.operators import geojson, jobs, points, tiles
from skytab.sources import files


def test_orthophotos_and_inventory(spark, tmp_path):
    for name in ("A_orthophoto.tif", "A_orthophoto_preview.tif", "A_orthophoto.png", "B_Orthophoto.TIF", "other.tif", "A_orthophoto.tfw"):
        (tmp_path / name).write_bytes(b"x")
    assert {r.filename for r in files.list_orthophotos(spark, str(tmp_path)).collect()} == {"A_orthophoto.tif", "B_Orthophoto.TIF"}
    inventory = spark.createDataFrame([("A_orthophoto.tif", "A.geojson")], "filename string, annotation string")
    assert [r.filename for r in files.list_orthophotos(spark, str(tmp_path), inventory).collect()] == ["A_orthophoto.tif"]
    images = spark.createDataFrame([("A_orthophoto.tif", "z/A"), ("A_orthophoto.tif", "a/A")], "filename string, path string")
    notes = spark.createDataFrame([("A.geojson", "n/A")], "name string, path string")
    assert tuple(files.require_inventory(inventory, images, notes).first()) == ("A_orthophoto.tif", "A.geojson", "a/A", "n/A")
    with pytest.raises(Exception, match="missing A.geojson"):
        files.require_inventory(inventory, images, notes.limit(0)).collect()


def test_packets_without_fields(spark):
    rows = spark.createDataFrame([("", None), ('Camera:Yaw="7.00"', ""), ('Camera:Yaw="7.00"\nCamera:Roll="1.00"', "a<b")], "attributes string, source string")
    got = [r[0] for r in rows.select(tx.xmp_packet(F.col("attributes"), F.col("source"), 'soft"ware')).collect()]
    assert all(x.startswith(tx.XMP_HEADER) and x.endswith(tx.XMP_FOOTER) and 'x:xmptk="soft&quot;ware"' in x for x in got)
    assert "Prefs>" not in got[0] + got[1] and "attitude-source: a&lt;b</photomechanic:Prefs>" in got[2]
    back = spark.createDataFrame([(x,) for x in got], "x string").select(tx.xmp_map(F.col("x"))).collect()
    assert [r[0] for r in back] == [{}, {"Yaw": "7.00"}, {"Yaw": "7.00", "Roll": "1.00"}]


def test_parts_keep_their_holes(spark, tmp_path):
    square = lambda a, b: [[a, -a], [b, -a], [b, -b], [a, -b], [a, -a]]
    shapes = [("Polygon", [square(0, 6), square(2, 4)]), ("MultiPolygon", [[square(0, 2)], [square(10, 13), square(11, 12)], [square(5, 5)]]), ("LineString", [[0, 0], [1, 1]]), ("Point", [0, 0])]
    text = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {}, "geometry": {"type": t, "coordinates": c}} for t, c in shapes]}
    (tmp_path / "f.geojson").write_text(json.dumps(text))
    features = geojson.read_features(spark, str(tmp_path / "f.geojson"))
    parts = geojson.load_parts(features)
    assert {(r.feature_idx, r.part): (len(r.rings), r.area) for r in parts.collect()} == {(0, 0): (2, 32.0), (1, 0): (1, 4.0), (1, 1): (2, 8.0)}
    px = geojson.rasterize(parts.select("feature_idx", "part", "rings"), "rings").groupBy("feature_idx", "part").count()
    assert {(r.feature_idx, r.part): r["count"] for r in px.collect()} == {(0, 0): 32, (1, 0): 4, (1, 1): 8}
    assert features.filter("geometry_type = 'Polygon'").first().rings[1][0] == [2.0, -2.0]


def test_fragments_of_four_pixels(spark):
    px = spark.createDataFrame([("a", 1, x, 0) for x in range(5, 12)], "image string, instance int, px int, py int")
    t = spark.createDataFrame([("a", x, 0, 8, 8) for x in (0, 8)] + [("b", 0, 0, 8, 8)], "image string, x int, y int, tile_width int, tile_height int")
    got = [tuple(r) for r in tiles.tile_instances(px, t, cell=4).collect()]
    assert got == [("a", 8, 0, 1, 4, 0, 0, 4, 1)]  # the three pixels of the first tile are too few


def test_splits_by_token(spark):
    splits = spark.createDataFrame([("D_1", "val"), ("D_12", "train")], "token string, split string")
    images = spark.createDataFrame([("D_12",), ("D_1",), ("x_D_12_0_patch",), ("other",)], "image_id string")
    assert {tuple(r) for r in tiles.assign_split(images, splits).collect()} == {("D_12", "train"), ("D_1", "val")}
    assert {tuple(r) for r in tiles.assign_split(images, splits, within=True).collect()} == {("D_12", "train"), ("D_1", "val"), ("x_D_12_0_patch", "train")}


def test_changes_out_and_colours(spark, tmp_path):
    changes = spark.createDataFrame([("p", 1, 7, "CHANGED_BUILDING"), ("p", 1, 5, "UNCHANGED"), ("p", 2, None, "REMOVED_BUILDING"), ("q", None, 9, "NEW_BUILDING")], "pair string, before_id int, after_id int, classification string")
    det.write_change_set(changes, str(tmp_path / "set"))
    assert {p.name for p in (tmp_path / "set").iterdir() if p.is_dir()} == {"pair=p", "pair=q"}
    inst = spark.createDataFrame([("p", 1), ("p", 2), ("p", 3)], "pair string, instance int")
    assert {r.instance: r.classification for r in det.change_of_instance(inst, changes, "pair").collect()} == {1: "UNCHANGED", 2: "REMOVED_BUILDING", 3: "UNCHANGED"}
    box = "struct<x1:int,y1:int,x2:int,y2:int>"
    stats = spark.createDataFrame([(1.0, 2.0, (0, 0, 4, 4)), (None, None, (0, 0, 4, 2))], f"cx double, cy double, box {box}")
    assert [(r.cx, r.cy) for r in det.centroid(stats).collect()] == [(1.0, 2.0), (2.0, 1.0)]


def test_jobs_and_attitudes(spark):
    rows = spark.createDataFrame([(1, None), (2, "  "), (3, "named")], "request_id int, job_name string")
    made = [tuple(r) for r in jobs.create_jobs(rows, "/jobs/").select("job_id", "job_name", "status", "output_dir").collect()]
    assert made == [tuple(r) for r in jobs.create_jobs(rows, "/jobs").select("job_id", "job_name", "status", "output_dir").collect()]
    assert [n for _, n, *_ in made] == [f"job_{made[0][0]}", f"job_{made[1][0]}", "named"] and all(len(j) == 8 and d == f"/jobs/{j}" for j, _, _, d in made)
    a = spark.createDataFrame([([(-90.0, 36.0), (-80.0, -3.0), (-70.0, 3.0)],), ([(-90.0, 40.0)],), ([],)], "c array<struct<pitch:double,roll:double>>")
    assert [r[0] and r[0].pitch for r in a.select(camera.best_attitude(F.col("c"))).collect()] == [-80.0, None, None]


def test_surface_without_points(spark):
    cells = spark.createDataFrame([(1, 0.0, 0.0, None), (2, 9.0, 9.0, 3.0)], "cell_id int, x double, y double, z double")
    held = spark.createDataFrame([(7, 1000.0, 0.0, 5.0), (3, -1000.0, 0.0, 6.0)], "point_id int, x double, y double, z double")
    assert {r.cell_id: r.z for r in points.fill_nearest(cells, held, 4.0).collect()} == {1: 6.0, 2: 3.0}
    assert {r.cell_id: r.z for r in points.fill_nearest(cells, held.limit(0), 4.0).collect()} == {1: 0.0, 2: 3.0}
