from __future__ import annotations

import random

import pytest
from skytab import checkpoints
from skytab.operators import detections as det

PAIRS = "image string, a long, b long, score double, note string"


def matched(rows):
    out, used_a, used_b = set(), set(), set()
    for image, a, b, score, _ in sorted(rows, key=lambda r: (-r[3], -r[1], -r[2])):
        if (image, a) not in used_a and (image, b) not in used_b:
            used_a.add((image, a))
            used_b.add((image, b))
            out.add((image, a, b))
    return out


def random_pairs(rng):
    return [("x" if k % 3 else "y", *ab, round(rng.random(), 2), "kept") for k, ab in enumerate({(rng.randrange(60), rng.randrange(60)) for _ in range(900)})]


@pytest.mark.parametrize("small", [0, 5, 200_000])
def test_matching_equals_the_loop(spark, small):
    rows = random_pairs(random.Random(1)) + [("z", k, k + d, 1000.0 - 2 * k - d, "kept") for k in range(60) for d in (0, 1)]
    got = det.match_one_to_one(spark.createDataFrame(rows, PAIRS).repartition(4), "image", small=small).collect()
    assert {(r.image, r.a, r.b) for r in got} == matched(rows) and len(got) == len(matched(rows)) and got[0].note == "kept"
    assert det.match_one_to_one(spark.createDataFrame([], PAIRS), "image", small=small).count() == 0


@pytest.mark.parametrize("small", [10, 1_000_000])
def test_a_chain_of_100000_takes_few_tables(spark, small, monkeypatch):
    n = 50_000  # pairs (k, k) and (k, k + 1): each stands against the one before it only
    df = spark.range(2 * n).selectExpr("'x' AS image", "id div 2 AS a", "id div 2 + id % 2 AS b", f"cast({2 * n} - id AS double) AS score", "'' AS note")
    written = []
    for module in (det, det.greedy):
        monkeypatch.setattr(module, "cut", lambda rows, name, *a, **k: (written.append(name), checkpoints.cut(rows, name, *a, **k))[1])
    got = det.match_one_to_one(df, "image", small=small)
    assert got.count() == n and got.filter("a = b").count() == n and len(written) < 20, written


def kept(rows, pairs):
    stay = set()
    against = {}
    for k, a, b in pairs:
        against.setdefault((k, a), set()).add(b)
        against.setdefault((k, b), set()).add(a)
    for k, i, s in sorted(rows, key=lambda r: (-r[2], r[1])):
        if not any((k, j) in stay for j in against.get((k, i), ()) if j != i):
            stay.add((k, i))
    return stay


@pytest.mark.parametrize("small", [0, 5, 200_000])
def test_suppression_equals_the_loop(spark, small):
    rng = random.Random(2)
    rows = [(k, i, round(rng.random(), 2)) for k in "xy" for i in range(120)] + [("z", i, 100.0 - i) for i in range(90)]
    pairs = [(k, rng.randrange(120), rng.randrange(120)) for k in "xy" for _ in range(300)] + [("z", i + 1, i) for i in range(89)] + [("z", 5, 5)]
    got = det.suppress(spark.createDataFrame(rows, "image string, instance long, score double"), spark.createDataFrame(pairs, "image string, a long, b long"), "image", small=small)
    assert {(r.image, r.instance) for r in got.collect()} == kept(rows, pairs)
    assert det.suppress(spark.createDataFrame(rows, "image string, instance long, score double"), spark.createDataFrame([], "image string, a long, b long"), "image", small=small).count() == len(rows)


@pytest.mark.parametrize("small", [0, 200_000])
def test_assignment_equals_the_loop(spark, small):
    rng = random.Random(3)
    found = [("x", k, round(rng.random(), 1)) for k in range(60)] + [("y", 0, None), ("y", 1, 0.5)]
    pairs = [("x", a, b, round(rng.random(), 2)) for a, b in {(rng.randrange(60), rng.randrange(40)) for _ in range(500)}] + [("y", 0, 7, 0.9), ("y", 1, 7, 0.8)]
    hit, used = set(), set()
    for image, a, _ in sorted(found, key=lambda r: (r[2] is None, -(r[2] or 0), r[1])):
        mine = sorted(((iou, b) for g, x, b, iou in pairs if g == image and x == a and iou >= 0.3 and (g, b) not in used), reverse=True)
        if mine:
            used.add((image, mine[0][1]))
            hit.add((image, a))
    got = det.assign_truths(spark.createDataFrame(found, "image string, a long, score double"), spark.createDataFrame(pairs, "image string, a long, b long, mask_iou double"), 0.3, "image", small=small)
    assert {(r.image, r.a) for r in got.collect() if r.hit} == hit and got.count() == len(found)
