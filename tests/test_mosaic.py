from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from skytab.operators import mosaic
from skytab.operators.components import connected_components


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(50, 51), (52, 51), (60, 60), (1, None)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {k: 0 for k in range(21)} | {50: 50, 51: 50, 52: 50, 60: 60}


def test_vertical_support(spark):
    rows = [("f", 24, 0.0, 100.0, 0.0, 0.0, 0.0, 10.0), ("f", 24, 0.0, 100.0, 0.0, 0.0, 50.0, 0.0), ("f", 28, 1e9, 0.0, 0.0, 0.0, 50.0, 0.0)]
    df = spark.createDataFrame(rows, "k string, focal int, vx double, vy double, x1 double, y1 double, x2 double, y2 double")
    got = {(r.focal, round(r.support, 6), r.best) for r in mosaic.vertical_support(df, "k").collect()}
    assert got == {(24, 10.0, False), (28, 50.0, True)}


def test_require_valid(spark):
    df = spark.createDataFrame([(0,), (1,)], "t int")
    assert mosaic.require_valid(df, "t").count() == 2
    with pytest.raises(Exception, match="neither 0 nor 1"):
        mosaic.require_valid(df.union(spark.createDataFrame([(2,)], "t int")), "t").collect()


def test_grid_and_windows(spark):
    canvas = spark.createDataFrame([(0.0, 10.0, 2.0, 3, 2)], "min_x double, max_y double, gsd double, width int, height int")
    cells = mosaic.grid(canvas).orderBy("row", "col").collect()
    assert [(r.x, r.y) for r in cells] == [(1.0, 9.0), (3.0, 9.0), (5.0, 9.0), (1.0, 7.0), (3.0, 7.0), (5.0, 7.0)]
    w = mosaic.coverage_window(F.lit(5.0), F.lit(9.0), F.lit(1.5), F.lit(0.0), F.lit(10.0), F.lit(2.0), F.lit(3), F.lit(2))
    assert tuple(spark.range(1).select(*(c.alias(n) for n, c in w.items())).first()) == (1, 3, 0, 2)


def test_normalise_and_rescale(spark):
    n, m = spark.range(1).select(mosaic.normalise_bands(F.array(*(F.lit(v) for v in (123.675, 0.0, 255.0)))).alias("n"), mosaic.rescale_homography(F.array(*(F.lit(float(v)) for v in (1, 0, 10, 0, 1, 20, 0, 0, 1))), F.lit(0.5), F.lit(0.25)).alias("m")).first()
    assert n[0] == pytest.approx(0, abs=1e-9) and n[1] == pytest.approx(-0.456 / 0.224)
    assert m == [2.0, 0.0, 40.0, 0.0, 2.0, 80.0, 0.0, 0.0, 1.0]
