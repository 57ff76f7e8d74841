from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from skytab.operators import geojson

SCHEMA = "track_id long, frame_index long, latitude double, longitude double, altitude double, timestamp string"


def joined(manifest):
    """The text of each key from its files in order of their parts."""
    out, rows = {}, sorted(manifest.collect(), key=lambda r: (str(r.track_id), r.part))
    for r in rows:
        with open(r.path.removeprefix("file:"), encoding="utf-8") as f:
            text = f.read()
        assert r.begins == len(out.get(r.track_id, "").encode()) and r.bytes == len(text.encode())
        out[r.track_id] = out.get(r.track_id, "") + text
    return {k: json.loads(v) for k, v in out.items()}


def test_parts_equal_the_one_row_form(spark, tmp_path):
    rows = [(k % 3 * 10, (k * 37) % 101, 13.0 + k * 1e-5, 79.0 - k * 1e-5, 100.0 + k % 7, f"t{(k * 37) % 101:03d}") for k in range(101)]
    rows += [(7, 0, 1.0, 2.0, 3.0, None), (8, 0, 1.0, 2.0, 3.0, "a"), (8, 0, 1.0, 2.0, 3.0, "a"), (9, -200, 1.0, 2.0, None, "x"), (9, 700, 1.5, 2.0, None, "y")]
    frames = spark.createDataFrame(rows, SCHEMA)
    whole = {r.track_id: json.loads(r.geojson) for r in geojson.feature_collection(frames, "track_id").collect()}
    for chunk, parts in ((1 << 16, 3), (4, 40)):
        manifest = geojson.save_in_parts(geojson.collection_lines(frames, "track_id", chunk=chunk), str(tmp_path / str(parts)), "track_id", parts)
        assert joined(manifest) == whole
    assert manifest.count() > len(whole)


def test_null_keys_and_orders_and_no_rows(spark, tmp_path):
    rows = [(None, None, 1.0, 2.0, 3.0, "b"), (None, 5, 1.5, 2.0, 3.0, "c"), (None, None, 1.0, 1.0, 3.0, "a"), (1, None, None, None, None, None)]
    frames = spark.createDataFrame(rows, SCHEMA)
    got = joined(geojson.save_in_parts(geojson.collection_lines(frames, "track_id"), str(tmp_path / "a"), "track_id"))
    line = got[None]["features"][-1]
    assert line["geometry"]["coordinates"] == [[1.0, 1.0, 3.0], [2.0, 1.0, 3.0], [2.0, 1.5, 3.0]]
    assert (line["properties"]["total_points"], line["properties"]["start_time"], line["properties"]["end_time"]) == (3, "a", "c")
    assert len(got[1]["features"]) == 1
    assert geojson.collection_lines(frames.limit(0), "track_id").count() == 0


def test_one_long_track_is_written_by_many_tasks(spark, tmp_path):
    n = 200_000
    i = F.col("id")
    frames = spark.range(n, numPartitions=8).select(F.lit(1).cast("long").alias("track_id"), i.alias("frame_index"), (10 + i / 1e6).alias("latitude"), F.lit(20.0).alias("longitude"), F.lit(50.0).alias("altitude"), i.cast("string").alias("timestamp"))
    manifest = geojson.save_in_parts(geojson.collection_lines(frames, "track_id", chunk=10_000), str(tmp_path / "long"), "track_id", 16)
    sizes = [r.bytes for r in manifest.collect()]
    assert len(sizes) == 16 and max(sizes) < sum(sizes) / 4
    c = joined(manifest)[1]
    assert [f["id"] for f in c["features"]] == [*range(n), "flight_trajectory"]
    assert [p[1] for p in c["features"][-1]["geometry"]["coordinates"]] == [10 + k / 1e6 for k in range(n)]
    assert c["features"][-1]["properties"]["total_points"] == n and c["features"][-1]["properties"]["end_time"] == str(n - 1)


@pytest.mark.parametrize("parts", [1, 3])
def test_packed_files_are_as_few_as_tasks(spark, tmp_path, parts):
    frames = spark.createDataFrame([(None if t == 0 else f"a\t{t}", i, 13.0 + t, 79.0 + i, 200.0) for t in range(40) for i in range(3)], "track_id string, frame_index long, latitude double, longitude double, altitude double")
    expected = {r.track_id: r.geojson for r in geojson.feature_collection(frames, "track_id").collect()}
    geojson.save_collections(geojson.feature_collection(frames, "track_id").coalesce(2), str(tmp_path / "whole"), "track_id", packed=True)
    assert {r.track_id: r.text for r in geojson.read_packed(spark, str(tmp_path / "whole"), "track_id", "string").collect()} == expected
    manifest = geojson.save_in_parts(geojson.collection_lines(frames, "track_id"), str(tmp_path / "parts"), "track_id", parts, packed=True).collect()
    assert len(list((tmp_path / "whole").glob("part-*"))) <= 2 and len({r.path for r in manifest}) == len(list((tmp_path / "parts").glob("part-*"))) <= parts
    texts = {}
    for r in sorted(manifest, key=lambda r: r.part):
        mine = [x for x in open(r.path.removeprefix("file:").replace("///", "/")).read().split("\n") if x.startswith(json.dumps([r.track_id]) + "\t")]
        text = "".join(x.split("\t", 1)[1] + "\n" for x in mine)
        assert r.begins == len(texts.get(r.track_id, "")) and r.bytes == len(text)
        texts[r.track_id] = texts.get(r.track_id, "") + text
    assert len(json.loads(texts.pop(None))["features"]) == 4  # the form of one row has no null keys
    assert {k: json.loads(t) for k, t in texts.items()} == {k: json.loads(t) for k, t in expected.items()}
