from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from skytab.operators import detections as det
from skytab.operators import geojson, jobs, points, tiles


def masks(seed, n, images=3):
    rng = np.random.default_rng(seed)
    out = {}
    for k in range(n):
        x, y, w, h = rng.integers(0, 12), rng.integers(0, 12), rng.integers(1, 9), rng.integers(1, 9)
        m = np.zeros((24, 24), bool)
        m[y : y + h, x : x + w] = rng.random((h, w)) < 0.8
        if m.any():
            out[k % images, k] = m
    return out


def frames(spark, group, scores=None):
    px = [(i, k, int(x), int(y)) for (i, k), m in group.items() for y, x in np.argwhere(m)]
    pixels = spark.createDataFrame(px, "image int, instance long, px long, py long")
    score = spark.createDataFrame([(k, float(s)) for k, s in (scores or {k: 0.0 for _, k in group}).items()], "instance long, score double")
    return det.instance_stats(pixels, "image", "instance").join(score, "instance"), pixels


def box(m):
    ys, xs = np.where(m)
    return xs.min(), ys.min(), xs.max() + 1, ys.max() + 1


def ious(a, b):
    inter, union = (a & b).sum(), (a | b).sum()
    p, q = box(a), box(b)
    w, h = max(0, min(p[2], q[2]) - max(p[0], q[0])), max(0, min(p[3], q[3]) - max(p[1], q[1]))
    areas = (p[2] - p[0]) * (p[3] - p[1]) + (q[2] - q[0]) * (q[3] - q[1]) - w * h
    return inter / union, w * h / areas


def test_pairs_and_greedy_matching(spark):
    a, b = masks(1, 40), {(i, k + 100): m for (i, k), m in masks(2, 40).items()}
    (ia, pa), (ib, pb) = frames(spark, a), frames(spark, b)
    pairs = det.pair_overlaps(ia, ib, pa, pb, "image")
    got = {(r.image, r.a, r.b): (r.mask_iou, r.box_iou) for r in pairs.collect()}
    expected = {(i, k, j): ious(m, n) for (i, k), m in a.items() for (i2, j), n in b.items() if i == i2 and ious(m, n)[1] > 0}
    assert got.keys() == expected.keys()
    assert all(got[k] == pytest.approx(expected[k]) for k in got)
    scored = det.change_candidates(pairs).withColumn("score", F.round("score", 9))
    used, plain = set(), set()
    for r in sorted(scored.collect(), key=lambda r: (r.score, r.a, r.b), reverse=True):
        if not {(r.image, "a", r.a), (r.image, "b", r.b)} & used:
            used |= {(r.image, "a", r.a), (r.image, "b", r.b)}
            plain.add((r.image, r.a, r.b))
    matches = det.match_one_to_one(scored, "image")
    assert {(r.image, r.a, r.b) for r in matches.collect()} == plain
    changes = det.classify_changes(ia, ib, matches, "image").collect()
    assert len(changes) == len(a) + len(b) - len(plain)
    for c in changes:
        if c.classification in ("CHANGED_BUILDING", "UNCHANGED"):
            share = (c.after_area - c.before_area) / c.before_area
            assert (c.classification == "CHANGED_BUILDING") == (abs(share) >= 0.3 or c.mask_iou < 0.5)


@pytest.mark.parametrize("rule", ["box_iou >= 0.4 AND mask_iou >= 0.2", "mask_iou >= 0.3 OR box_iou >= 0.5"])
def test_suppression(spark, rule):
    group = masks(3, 60, images=2)
    rng = random.Random(1)
    scores = {k: rng.randrange(20) / 20 for _, k in group}
    inst, px = frames(spark, group, scores)
    dup = det.pair_overlaps(inst, inst, px, px, "image").filter("a < b").filter(rule)
    got = {(r.image, r.instance) for r in det.suppress(inst, dup, "image").collect()}
    kept = []
    for i, k in sorted(group, key=lambda x: (-scores[x[1]], x[1])):
        def same(j):
            mask_iou, box_iou = ious(group[i, k], group[i, j])
            return eval(rule.replace("AND", "and").replace("OR", "or"))

        if not any(i == i2 and same(j) for i2, j in kept):
            kept.append((i, k))
    assert got == set(kept)


def test_average_precision(spark):
    pred, truth = masks(4, 50, images=4), {(i, k + 100): m for (i, k), m in masks(5, 40, images=4).items()}
    rng = random.Random(2)
    scores = {k: rng.randrange(30) / 30 for _, k in pred}
    (ip, pp), (it, pt) = frames(spark, pred, scores), frames(spark, truth)
    pairs = det.pair_overlaps(ip, it, pp, pt, "image")
    assigned = det.assign_truths(ip.withColumnRenamed("instance", "a"), pairs, 0.3, "image")
    used, hits = set(), []
    for i, k in sorted(pred, key=lambda x: (-scores[x[1]], x[0], x[1])):
        best = max(((ious(pred[i, k], m)[0], j) for (i2, j), m in truth.items() if i2 == i and j not in used), default=(0.0, -1))
        hits.append(best[0] >= 0.3)
        if hits[-1]:
            used.add(best[1])
    tp = np.cumsum(hits)
    area = sum(tp[n] / (n + 1) for n in range(len(hits)) if hits[n]) / len(truth)
    twice = assigned.withColumn("threshold", F.explode(F.array(F.lit(0.3), F.lit(0.7))))
    got = det.average_precision(twice, it, "threshold", order=("image", "a")).collect()
    assert {r.threshold: r.ap for r in got} == {0.3: pytest.approx(area), 0.7: pytest.approx(area)}
    assert det.average_precision(twice.limit(0), it.limit(0), "threshold", order=("image", "a")).count() == 0
    assert [r.ap for r in det.average_precision(twice, it.limit(0), "threshold", order=("image", "a")).collect()] == [0.0, 0.0]


@pytest.mark.parametrize("points_,expected", [([(0, 0), (4, 0), (4, 3), (0, 0)], "valid"), ([(0, 0), (4, 4), (4, 0), (0, 3), (0, 0)], "self-crossing"), ([(0, 0), (1, 0), (2, 0), (0, 0)], "no area"), ([(0, 0), (1, 0), (1, 1), (0, 1)], "unclosed"), ([(0, 0), (1, 0), (0, 0)], "too few points"), ([(0, 0), (float("inf"), 0), (1, 1), (0, 0)], "non-finite"), ([], "too few points")])
def test_validity(spark, points_, expected):
    ring = spark.createDataFrame([([(float(x), float(y)) for x, y in points_],)], "ring array<struct<x:double,y:double>>")
    assert ring.select(geojson.validity(F.col("ring"))).first()[0] == expected


def test_geojson_files(spark, tmp_path):
    (tmp_path / "a.geojson").write_text('{"type": "FeatureCollection",\n "features": [{"type": "Feature", "properties": {"a": 1}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}, {"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]}}, {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}}]}')
    rows = geojson.read_features(spark, str(tmp_path)).orderBy("feature_idx").collect()
    assert [(r.geometry_type, r.rings and len(r.rings)) for r in rows] == [("Polygon", 1), ("MultiPolygon", 2), ("Point", None)]


@pytest.mark.parametrize("width,height", [(100, 512), (513, 896), (1281, 600), (2000, 1500)])
def test_tiles_cover(spark, width, height):
    rows = tiles.iter_tiles(spark.createDataFrame([(width, height)], "width int, height int"), 512, 384).collect()
    side = lambda n: sorted({*range(0, max(n - 512, 0) + 1, 384), max(n - 512, 0)})
    assert [(r.y, r.x) for r in sorted(rows, key=lambda r: r.ordinal)] == [(y, x) for y in side(height) for x in side(width)]
    with pytest.raises(ValueError):
        tiles.iter_tiles(spark.createDataFrame([(1, 1)], "width int, height int"), 0, 1)


def test_points(spark):
    rng = np.random.default_rng(6)
    p = rng.random((200, 3))
    df = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(p)], "point_id long, x double, y double, z double")
    got = {(r.point_id, r["rank"]): r.other for r in points.nearest_neighbours(df, 3, 0.25, rings=2).collect()}
    d = np.linalg.norm(p[:, None] - p[None], axis=2) + np.eye(200) * 9
    for k in range(200):
        near = [int(j) for j in np.argsort(d[k])[:3] if d[k, j] <= 0.5]
        assert [got.get((k, r + 1)) for r in range(len(near))] == near
    pairs = df.select("x", "y", "z", (2 * F.col("y") + 1).alias("u"), (-2 * F.col("x")).alias("v"), (2 * F.col("z") - 3).alias("w"))
    scale, rot, shift = points.similarity_transform(pairs)
    assert scale == pytest.approx(2) and np.allclose(rot, [[0, 1, 0], [-1, 0, 0], [0, 0, 1]]) and np.allclose(shift, [1, 0, -3])
    seams = spark.createDataFrame([(0, 1, 100.0, 110.0, 1.0), (1, 2, 110.0, 100.0, 1.0), (0, 2, 100.0, 100.0, 1.0), (5, 6, 0.0, 1.0, 1.0)], "i int, j int, mean_i double, mean_j double, weight double")
    gains = {r.frame: r.gain for r in points.seam_gains(seams.withColumn("mosaic", F.lit("m")), "mosaic").collect()}
    assert gains[0] == pytest.approx(gains[2]) and gains[0] / gains[1] == pytest.approx(1.1)
    assert points.seam_gains(seams.limit(0).withColumn("mosaic", F.lit("m")), "mosaic").count() == 0


def test_jobs(spark, tmp_path):
    ev = spark.createDataFrame([(1, "QUEUED", 1, None), (1, "PROCESSING", 2, None), (1, "FAILED", 2, "bad"), (2, "QUEUED", 1, None)], "job_id int, status string, at int, error string")
    assert {(r.job_id, r.status, r.error) for r in jobs.latest_state(ev).collect()} == {(1, "FAILED", "bad"), (2, "QUEUED", None)}
    many = spark.createDataFrame([(k, k % 7) for k in range(30)], "job_id int, created_at int")
    assert [r.job_id for r in jobs.last_jobs(many, 3).collect()] == [13, 20, 27]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.bin").write_bytes(b"12345")
    assert tuple(jobs.storage_bytes(spark, str(tmp_path)).first()) == (5, 1)
