"""What made queries fail on larger tables, on small ones."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from skytab.operators import mosaic, points, polygons, tiles
from skytab.plans import deliveries, objects


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tiles_are_not_broadcast(spark, tmp_path):
    spark.createDataFrame([("a", 1, x, 0) for x in range(5, 12)], "image string, instance int, px int, py int").write.parquet(str(tmp_path / "px"))
    spark.createDataFrame([("a", x, 0, 8, 8) for x in (0, 8)], "image string, x int, y int, tile_width int, tile_height int").write.parquet(str(tmp_path / "t"))
    seen = tiles.tile_instances(spark.read.parquet(str(tmp_path / "px")), spark.read.parquet(str(tmp_path / "t")), cell=4)
    assert "Broadcast" not in plan(seen) and seen.count() == 1


def test_many_collections_are_few_files(spark, tmp_path, monkeypatch):
    rows = [(k, k % 9 + 1) for k in range(1, 301)]
    spark.createDataFrame(rows, "p_partkey long, p_size int").coalesce(2).write.parquet(str(tmp_path / "part.parquet"))
    monkeypatch.setattr(deliveries, "_folder", lambda spark: str(tmp_path / "out"))
    got = {(r.p_partkey, r.part): (r.n_rings, r.area) for r in deliveries.QUERIES["geojson_parts"](spark, str(tmp_path)).collect()}
    assert got == {(k, 0): (2, (s + 4.0) * 5 - 1) for k, s in rows} | {(k, 1): (1, 0.5 * s) for k, s in rows if k % 2 == 0}
    assert len(list((tmp_path / "out").rglob("part-*"))) <= 16


def test_cameras_are_dealt_out_before_they_reach(spark):
    cells = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0)], "row int, col int, x double, y double, z double")
    cams = spark.createDataFrame([(k, 1.0, 1.0, 50.0, 0.0, -90.0, 0.0, 3000.0, 3840, 2160, 75.0) for k in range(9)], "frame long, east double, north double, up double, yaw double, pitch double, roll double, focal double, width int, height int, radius double").coalesce(1)
    seen = mosaic.cast_rays(cells, cams)
    assert "hashpartitioning(frame" in plan(seen) and seen.count() == 9


def test_edges_are_not_broadcast(spark):
    square = F.array(F.array(*(F.struct((F.col("shape") % 7 + p).alias("x"), F.lit(float(q)).alias("y")) for p, q in [(0.0, 0), (4.0, 4), (4.0, 0), (0.0, 4)])))
    rows = spark.range(20).select(F.lit("g").alias("group"), F.col("id").alias("shape")).withColumn("rings", square)
    assert "BroadcastHashJoin" not in plan(polygons.crossed_shapes(rows))
    parts = polygons.repair(rows)
    assert "BroadcastHashJoin" not in plan(parts) and parts.groupBy("shape").count().filter("count = 2").count() == 20


def test_neighbour_cells_follow_the_density(spark, tmp_path, monkeypatch):
    tried, real = [], points._within

    def within(seekers, others, k, cell, *args):
        tried.append(cell)
        return real(seekers, others, k, cell, *args)

    monkeypatch.setattr(points, "_within", within)
    for n in (200, 1600):
        rng = np.random.default_rng(3)
        rows = [(k, [float(x) for x in rng.random(64)], 3) for k in range(n)]
        spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / f"{n}" / "embeddings.parquet"))
        tried.append(None)
        assert objects._neighbours(spark, str(tmp_path / f"{n}"), 2).filter("rank = 2").count() == n
    dense = tried[tried.index(None, 1) + 1]
    assert dense < 0.6 * tried[1]  # eight times the points: cells of half the side


def test_nearest_heights_are_sought_once_a_place(spark, monkeypatch):
    asked, real = [], points._nearest_of

    def nearest(seekers, others, cell):
        asked.append((seekers.count(), others.count()))
        return real(seekers, others, cell)

    monkeypatch.setattr(points, "_nearest_of", nearest)
    cells = spark.createDataFrame([(k, float(k % 3), 0.0, None) for k in range(60)], "cell_id long, x double, y double, z double")
    held = spark.createDataFrame([(k, 5.0 * (k % 2), 0.0, float(k)) for k in range(40)], "point_id long, x double, y double, z double")
    got = {r.cell_id: r.z for r in points.fill_nearest(cells, held, 4.0).collect()}
    assert got == {k: 0.0 for k in range(60)} and asked == [(3, 2)]
