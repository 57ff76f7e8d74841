"""Queries against results without a cut: brute force, or the SQL twin with the cut taken out of it."""

from __future__ import annotations

import random

import pytest
from oracle import connect
from pyspark.sql import functions as F

from skytab.operators import detections as det
from skytab.operators import mosaic, points
from skytab.plans import QUERIES, SQL, objects
from skytab.plans.objects import _INSTANCES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_no_query_is_cut():
    """The SQL twins of these, which tests/test_registry.py compares, read their whole tables and know no radius."""
    assert "% 10 = 0" not in SQL["ray_cast_coverage"] and "% 3 = 0" not in SQL["box_components"]
    assert all("distance <= 0.2" not in SQL[name] for name in ("outlier_filter", "knn2_ratio"))


def test_components_of_all_instances(spark, con, sf_dir):
    boxes = con.execute(f"WITH {_INSTANCES} SELECT image, instance, x1, y1, x2, y2 FROM inst").fetchall()
    root = {k: k for _, k, *_ in boxes}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for n, (i, a, *p) in enumerate(boxes):
        for j, b, *q in boxes[:n]:
            if i == j and min(p[2], q[2]) > max(p[0], q[0]) and min(p[3], q[3]) > max(p[1], q[1]):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    got = {(r.image, r.instance): r.component for r in QUERIES["box_components"](spark, sf_dir).collect()}
    assert got == {(i, k): find(k) for i, k, *_ in boxes}


def test_chain_of_boxes(spark):
    boxes = [("a", 1, 0, 4), ("a", 2, 3, 7), ("a", 3, 6, 9), ("a", 4, 20, 22), ("a", 5, 20, 22), ("b", 6, 20, 22), ("a", 7, 5, 5)]
    rows = spark.createDataFrame([(i, k, (lo, 0, hi, 2)) for i, k, lo, hi in boxes], "image string, instance long, box struct<x1:long,y1:long,x2:long,y2:long>")
    got = {r.instance: r.component for r in mosaic.box_components(rows, "image").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7}


@pytest.mark.parametrize("name", ["y_flip_bounds", "raster_cover"])
def test_polygons_are_kept_by_validity(spark, sf_dir, monkeypatch, name):
    part = spark.createDataFrame([(k, 1 + k % 50) for k in range(1, 40)], "p_partkey long, p_size int")
    monkeypatch.setattr(objects.b, "table", lambda *_: part)
    shift = objects._polygons(spark, sf_dir).withColumn("p_partkey", F.col("p_partkey") + 1)
    valid = {r.p_partkey for r in shift.filter(objects.geojson.validity(F.col("ring")) == "valid").collect()}
    monkeypatch.setattr(objects, "_polygons", lambda *_: shift)
    assert {r.p_partkey for r in QUERIES[name](spark, sf_dir).collect()} == valid != set()


def test_far_points_have_neighbours(spark):
    xs = {1: 0.0, 2: 0.1, 3: 0.15, 4: 90.0, 5: -4000.0, 6: float("nan")}
    rows = [(k, "a", x, 0.0, 0.0) for k, x in xs.items()] + [(7, "b", 0.0, 0.0, 0.0), (8, "b", 7.0, 0.0, 0.0), (9, "c", 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "point_id long, label string, x double, y double, z double")
    got = {}
    for r in points.nearest_neighbours(df, 2, 0.2, block="label").orderBy("point_id", "rank").collect():
        got.setdefault(r.point_id, []).append((r.other, round(r.distance, 6)))
    assert got == {1: [(2, 0.1), (3, 0.15)], 2: [(3, 0.05), (1, 0.1)], 3: [(2, 0.05), (1, 0.15)], 4: [(3, 89.85), (2, 89.9)], 5: [(1, 4000.0), (2, 4000.1)], 7: [(8, 7.0)], 8: [(7, 7.0)]}


def test_truths_are_assigned_in_rounds_of_joins(spark):
    rng = random.Random(9)
    dets = [(i, a, rng.randrange(8) / 8) for i in range(3) for a in range(20)]
    ious = {(i, a, b): rng.randrange(10) / 10 for i, a, _ in dets for b in range(15) if rng.random() < 0.7}
    detections, pairs = spark.createDataFrame(dets, "image int, a int, score double"), spark.createDataFrame([(*k, v) for k, v in ious.items()], "image int, a int, b int, mask_iou double")
    for threshold in (0.0, 0.3, 0.8):
        used, hits = set(), set()
        for i, a, _ in sorted(dets, key=lambda d: (d[0], -d[2], d[1])):
            free = [(v, b) for (j, c, b), v in ious.items() if (j, c) == (i, a) and v >= threshold and (i, b) not in used]
            if free:
                used.add((i, max(free)[1]))
                hits.add((i, a))
        assigned = det.assign_truths(detections, pairs, threshold, "image")
        assert {(r.image, r.a) for r in assigned.filter("hit").collect()} == hits
        assert "FlatMapGroupsInPandas" not in assigned._jdf.queryExecution().toString()
    assert det.assign_truths(detections, pairs.limit(0), 0.3, "image").filter("hit").isEmpty()
