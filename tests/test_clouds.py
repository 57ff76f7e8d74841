from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from skytab.operators import descriptors, normals, points, quantiles, surfaces

# quantiles


def test_quantiles_equal_percentile(spark):
    rng = random.Random(1)
    rows = [("even", float(k)) for k in range(1000)] + [("one", 5.0)] + [("same", 2.5)] * 50 + [(None, rng.gauss(0, 1)) for _ in range(333)]
    rows += [("wide", rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300)) for _ in range(500)] + [("odd", None), ("odd", float("nan")), ("ends", -1.7e308), ("ends", 1.7e308), ("ends", 0.0)]
    rows += [("skew", 1e-9 * k) for k in range(2000)] + [("skew", 1e9)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = [0.0, 0.05, 0.5, 0.99, 1.0]
    got = {r.g: r.quantiles for r in quantiles.quantiles(df, "v", shares, "g", marks=5).collect()}
    clean = df.filter("v IS NOT NULL AND NOT isnan(v)")
    want = {r.g: r.q for r in clean.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("q")).collect()}
    assert set(got) == set(want) and "odd" not in got
    for g in want:
        assert got[g] == pytest.approx(want[g], rel=1e-12), g
    whole = quantiles.quantiles(df.filter("g = 'even'"), "v", [0.25, 0.5]).collect()
    assert [r.quantiles for r in whole] == [[249.75, 499.5]]
    assert quantiles.quantiles(df.limit(0), "v", [0.5], "g").count() == 0


# surfaces


def delaunay(pts):
    """All triangles whose circle is empty, over all triples."""
    out = []
    for i, j, k in itertools.combinations(range(len(pts)), 3):
        tri = np.array([pts[i][:2], pts[j][:2], pts[k][:2]])
        u, v = tri[1] - tri[0], tri[2] - tri[0]
        d = u[0] * v[1] - u[1] * v[0]
        if abs(d) < 1e-14:
            continue
        c, r2 = surfaces.circles(tri[None])
        d2 = ((np.array(pts)[:, :2] - c[0]) ** 2).sum(1)
        d2[[i, j, k]] = np.inf
        if d2.min() >= r2[0] * (1 - 1e-10):
            out.append((i, j, k))
    return out


def height(pts, tris, q):
    for t in tris:
        tri = np.array([pts[i][:2] for i in t])
        w = surfaces.barycentric(np.array([q]), tri[None])[0]
        if w.min() >= -1e-12:
            return float(sum(a * pts[i][2] for a, i in zip(w, t)))
    return None


@pytest.mark.parametrize("kind", ["even", "clusters", "line of clusters"])
def test_linear_heights_equal_all_triples(spark, kind):
    rng = np.random.default_rng(2)
    n = 70
    xy = rng.uniform(0, 10, (n, 2))
    if kind == "clusters":
        xy = rng.normal(0, 0.05, (n, 2)) + rng.uniform(0, 10, (5, 2))[rng.integers(5, size=n)]
    if kind == "line of clusters":
        xy = rng.normal(0, 0.02, (n, 2)) + np.stack([np.arange(n) // 10 * 3.0, np.arange(n) // 10 * 1.1], 1)
    pts = [(*p, rng.normal()) for p in xy.tolist()]
    low, high = xy.min(0) - 0.5, xy.max(0) + 0.5
    cells = [(k, *p) for k, p in enumerate((rng.uniform(0, 1, (150, 2)) * (high - low) + low).tolist())] + [(1000 + k, *p[:2]) for k, p in enumerate(pts)]
    tris = delaunay(pts)
    frame = spark.createDataFrame([("a", k, *map(float, p)) for k, p in enumerate(pts)] + [("b", 900, 1.0, 1.0, 7.0)], "key string, point_id long, x double, y double, z double").repartition(3)
    places = spark.createDataFrame([("a", *c) for c in cells] + [("b", 5000, 1.0, 1.0), ("c", 5001, 1.0, 1.0)], "key string, cell_id long, x double, y double").repartition(3)
    got = {r.cell_id: r.z for r in surfaces.linear_heights(places, frame, per=4, most=6).collect()}
    for k, *q in cells:
        want = height(pts, tris, q)
        if want is None:
            assert k not in got or k >= 1000
        else:
            assert got[k] == pytest.approx(want, abs=1e-6), (kind, k)


def test_surface_falls_back_to_near_points_and_the_median(spark):
    pts = [(float(x), float(y), 2.0 * x - y + 3) for x in range(5) for y in range(5)]
    frame = spark.createDataFrame([("a", k, *p) for k, p in enumerate(pts)] + [("a", 90, 1.5, 1.5, float("nan")), ("a", 91, None, 1.0, 1.0), (None, 92, 1.0, 1.0, 99.0)], "key string, point_id long, x double, y double, z double")
    cells = [("a", 1, 1.25, 3.5), ("a", 2, 4.5, 2.0), ("a", 3, 900.0, 900.0), ("b", 4, 1.0, 1.0), ("a", 5, None, 1.0), ("a", 6, 4.0, 4.0)]
    got = {r.cell_id: (r.how, r.z) for r in surfaces.surface(spark.createDataFrame(cells, "key string, cell_id long, x double, y double"), frame, 0.5, reach=3.0).collect()}
    assert got == {1: ("linear", pytest.approx(2.0)), 2: ("nearest", 9.0), 3: ("median", 5.0 + 0.0), 4: ("none", None), 5: ("median", 5.0), 6: ("linear", pytest.approx(7.0))}
    empty = surfaces.surface(spark.createDataFrame(cells, "key string, cell_id long, x double, y double"), frame.limit(0), 0.5)
    assert {r.how for r in empty.collect()} == {"none"}


# descriptors


@pytest.mark.parametrize("kind", ["even", "groups", "copies"])
def test_nearest_descriptors_equal_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(descriptors, "BLOCK", 64)
    rng = np.random.default_rng(3)
    n, dim = 900, 16
    e = rng.normal(size=(n, dim))
    if kind == "groups":
        e = e * 0.05 + rng.normal(size=(30, dim))[rng.integers(30, size=n)]
    if kind == "copies":
        e[100:500] = e[7]
    rows = [("a" if k % 3 else "b", k, e[k].tolist()) for k in range(n)]
    odd = [("a", 2000, None), ("a", 2001, []), ("a", 2002, [float("nan")] * dim), (None, 2003, e[0].tolist())]
    frame = spark.createDataFrame(rows + odd, "key string, id long, v array<double>").repartition(4)
    got = {}
    seen = {}
    for r in descriptors.nearest_descriptors(frame.filter("id % 2 = 1"), frame, 3, itself=False).collect():
        got.setdefault(r.id, []).append((r["rank"], r.other, r.distance))
        seen[r.id] = r.visits
    for key in "ab":
        ids = [k for g, k, _ in rows if g == key]
        for q in (k for k in ids if k % 2):
            d = np.sqrt(((e[ids] - e[q]) ** 2).sum(1))
            want = sorted((x, k) for x, k in zip(d.tolist(), ids) if k != q)[:3]
            mine = sorted(got[q])
            assert [k for _, k, _ in mine] == [k for _, k in want] and [x for *_, x in mine] == pytest.approx([x for x, _ in want], abs=1e-12)
    assert set(got) == {k for k in range(n) if k % 2}
    if kind == "groups":
        blocks = n / 32
        assert np.mean(list(seen.values())) < 0.5 * blocks


def test_ratio_matches_need_eight(spark):
    rows = [("a", k, r, 10 * k + r, 1.0 if r == 1 else 2.0) for k in range(8) for r in (1, 2)] + [("b", k, r, 10 * k + r, 1.0 if r == 1 else 2.0) for k in range(7) for r in (1, 2)]
    rows += [("a", 50, 1, 1, 1.0), ("a", 51, 1, 1, 1.6), ("a", 51, 2, 2, 2.0)]
    df = spark.createDataFrame(rows, "key string, id long, rank int, other long, distance double")
    got = descriptors.ratio_matches(df).collect()
    assert {(r.key, r.n_good, r.enough) for r in got} == {("a", 8, True), ("b", 7, False)} and len(got) == 15


# normals


def test_eigenvectors_in_closed_form(spark):
    rng = np.random.default_rng(4)
    mats = []
    for k in range(300):
        a = rng.normal(size=(3, 3)) * 10.0 ** rng.integers(-3, 4)
        if k % 4 == 1:
            a[:, 2] = a[:, 1]
        if k % 4 == 2:
            a[:, 1:] *= 1e-4
        mats.append(a @ a.T)
    mats += [np.zeros((3, 3)), np.eye(3), np.diag([1.0, 1.0, 2.0]), np.diag([1.0, 2.0, 2.0])]
    df = spark.createDataFrame([(k, 30, *(float(m[i, j]) for i in range(3) for j in range(i, 3))) for k, m in enumerate(mats)], "point_id long, n long, " + ", ".join(f"{c} double" for c in normals.COVARIANCE))
    for r in normals.normals(df).collect():
        m, v = mats[r.point_id], np.array([r.nx, r.ny, r.nz])
        scale = max(np.abs(m).max(), 1e-300)
        assert np.linalg.norm(v) == pytest.approx(1, abs=1e-12)
        assert np.linalg.norm(m @ v - r.variance * v) <= 1e-9 * scale and r.residual <= 1e-9 * scale
        assert r.variance == pytest.approx(np.linalg.eigvalsh(m)[0], abs=1e-9 * scale)


def test_orientation_agrees_on_a_bent_sheet(spark):
    rng = np.random.default_rng(5)
    a, b = rng.uniform(0.2, 2.9, 400), rng.uniform(0, 3, 400)
    xyz = np.stack([np.cos(a) * 3, b, np.sin(a) * 3], 1)
    df = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(xyz)], "point_id long, x double, y double, z double").repartition(4)
    near = points.nearest_neighbours(df, 29, 0.6)
    got = {r.point_id: r for r in normals.cloud_normals(df, near).collect()}
    assert len(got) == 400 and len({r.component for r in got.values()}) == 1
    outward = [np.dot([r.nx, r.ny, r.nz], [xyz[k][0], 0, xyz[k][2]]) for k, r in got.items()]
    assert min(outward) > 0 and any(r.flipped for r in got.values())


def test_orientation_follows_the_least_spanning_forest(spark):
    rng = random.Random(6)
    n = {k: [rng.gauss(0, 1) for _ in range(3)] for k in range(60)}
    n = {k: [x / math.sqrt(sum(y * y for y in v)) for x in v] for k, v in n.items()}
    z = {k: rng.random() for k in n}
    edges = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(120)} | {tuple(sorted(rng.sample(range(40, 58), 2))) for _ in range(40)}
    dot = lambda a, b: sum(x * y for x, y in zip(n[a], n[b]))
    root, tree = {k: k for k in n}, {k: [] for k in n}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in sorted(edges, key=lambda e: (1 - abs(dot(*e)), *e)):
        if find(a) != find(b):
            root[find(a)] = find(b)
            tree[a].append(b)
            tree[b].append(a)
    want = {}
    for k in sorted(n, key=lambda k: -z[k]):
        if k in want:
            continue
        want[k] = -1 if n[k][2] < 0 else 1
        todo = [k]
        while todo:
            a = todo.pop()
            for b in tree[a]:
                if b not in want:
                    want[b] = want[a] * (-1 if dot(a, b) < 0 else 1)
                    todo.append(b)
    frame = spark.createDataFrame([(k, z[k], *n[k], "x") for k in n], "point_id long, z double, nx double, ny double, nz double, kept string")
    links = spark.createDataFrame([(a, b) for a, b in edges] + [(b, a) for a, b in edges] + [(1, 1), (1, 999), (2, None)], "point_id long, other long")
    got = normals.oriented(frame, links).collect()
    assert {r.point_id: -1 if r.flipped else 1 for r in got} == want and all(r.kept == "x" for r in got)
    assert normals.oriented(frame.limit(0), links).count() == 0
