from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from skytab.llm import hard_negatives, nearest_vectors, resampling

VECTORS = "vec_id long, label int, embedding array<float>, kept string"


# hard negatives


def mined(rows, s=hard_negatives.Settings()):
    """By brute force: rows are (vec_id, label, vector)."""
    v = {i: (label, [math.floor(s.scale * float(np.float32(x))) for x in e]) for i, label, e in rows}
    out = []
    for a in (i for i in v if i % 10 == 0):
        score = {i: sum(x * y for x, y in zip(v[a][1], e)) for i, (_, e) in v.items() if i != a and len(e) == len(v[a][1])}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if v[i][0] == v[a][0]][: s.positives]:
            fit = [i for i in order if v[i][0] != v[a][0] and s.low * score[p] <= 100 * score[i] <= s.high * score[p]]
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(fit[: s.negatives])]
    return sorted(out)


def vectors(rng, n, labels=4, dim=8, spread=1.0):
    """Of several lengths, with copies and ties."""
    out = []
    for i in range(n):
        e = (rng.normal(size=dim) * (1 + spread * (i % 5))).tolist()
        out.append((i, int(rng.integers(labels)), e if i % 7 else out[-1][2] if out else e))
    return out


@pytest.mark.parametrize("bucket", [16, 1024])
def test_hard_negatives_equal_brute_force(spark, bucket):
    s = hard_negatives.Settings(block=60, anchors=7, bucket=bucket, negatives=4)
    rows = vectors(np.random.default_rng(1), 300) + [(1000, 1, [0.5] * 4), (1001, 1, [0.6] * 4), (1002, 2, [0.3] * 4), (2000, 3, [0.0] * 8), (2010, 2, [-1.0] * 8)]
    got = hard_negatives.mine_hard_negatives(spark.createDataFrame([(*r, "x") for r in rows], VECTORS).repartition(5), "anchor_id % 10 = 0", s)
    want = mined(rows, s)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 300


def test_hard_negatives_edges(spark):
    good = vectors(np.random.default_rng(2), 60)
    odd = [(None, 1, [1.0] * 8), (500, None, [1.0] * 8), (510, 1, None), (520, 1, [1.0, None] * 4), (530, 1, [float("nan")] * 8), (540, 2, [float("inf")] * 8), (550, 2, []), (560, 2, [1e30] * 8)]
    again = [(good[3][0], 9, [9.0] * 8)]  # the row with the least label counts
    frame = lambda rows: spark.createDataFrame([(*r, "x") for r in rows], VECTORS)
    got = hard_negatives.mine_hard_negatives(frame(good + odd + again), "anchor_id % 10 = 0")
    assert sorted(map(tuple, got.collect())) == mined(good)
    assert hard_negatives.mine_hard_negatives(frame([]), "anchor_id % 10 = 0").count() == 0
    names = frame(good).withColumn("label", F.concat(F.lit("l"), "label"))
    assert sorted(map(tuple, hard_negatives.mine_hard_negatives(names, "anchor_id % 10 = 0").collect())) == mined(good)


def test_products_too_large_for_doubles_are_exact(spark):
    s = hard_negatives.Settings(scale=1, low=-10**6, high=10**6, negatives=3)
    rng = random.Random(4)
    rows = [(i, i % 2, [float(rng.randrange(2**26, 2**29)) for _ in range(4)]) for i in range(40)]
    got = hard_negatives.mine_hard_negatives(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, kept string"), "anchor_id % 10 = 0", s)
    v = {i: [int(x) for x in e] for i, _, e in rows}
    for r in got.collect():
        assert r.positive_score == sum(a * b for a, b in zip(v[r.anchor_id], v[r.positive_id]))
        assert r.negative_score == sum(a * b for a, b in zip(v[r.anchor_id], v[r.negative_id]))


def test_feasible_ranges_hold_every_direction_that_is_near_enough():
    rng = np.random.default_rng(5)
    a, b = (x / np.linalg.norm(x, axis=1)[:, None] for x in rng.normal(size=(2, 20000, 3)))
    for least in (-0.5, 0.0, 0.6, 0.95):
        near = (a * b).sum(1) >= least
        low, high = hard_negatives.feasible(a, np.full((len(a), 1), least))
        assert ((b[near] >= low[near]) & (b[near] <= high[near])).all()
    assert (high[near] - low[near]).mean() < 0.9  # and they prune


def test_coordinate_lists_are_intersected_where_they_prune():
    rng = np.random.default_rng(6)
    base = rng.integers(-3, 4, size=(4000, 6)) + 40 * np.eye(6, dtype=np.int64)[rng.integers(6, size=4000)]
    x = {"id": np.arange(4000), "label": np.zeros(4000, np.int64), "v": base}
    q = {"id": np.arange(20), "label": np.zeros(20, np.int64), "v": base[:20], "anchor": np.arange(20), "low": np.full(20, -(1 << 62)), "high": np.full(20, 1 << 62)}
    scored = []
    exact = hard_negatives._exact
    hard_negatives._exact = lambda a, b, m: scored.append(len(a) * len(b)) or exact(a, b, m)
    try:
        at, ids, score = hard_negatives.search(q, x, True, 5, hard_negatives.Settings(bucket=250))
    finally:
        hard_negatives._exact = exact
    assert sum(scored) < 0.5 * 20 * 4000
    for i in range(20):
        want = sorted(((-int(base[i] @ base[j]), j) for j in range(4000) if j != i))[:5]
        assert sorted(zip(-score[at == i], ids[at == i])) == want


# importance resampling


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def found(text):
    w = WORD.findall((text or "").translate(LOWER))
    return w, [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def resampled(docs, target, share=5):
    """doc_id to (n_features, weight, score, rank) by brute force."""
    s, t = [0] * 10000, [0] * 10000
    for side, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for b in found(x)[1]:
                side[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10000) / ((a + 1) * (sum(t) + 10000)))) for a, b in zip(s, t)]
    out, able = {}, []
    for i, x in docs:
        w, f = found(x)
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out[i] = [len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        if len(w) >= 20:
            able.append(i)
    for rank, i in enumerate(sorted(able, key=lambda i: (-out[i][2], i))[: share * len(able) // 100]):
        out[i][3] = rank + 1
    return {i: tuple(x) for i, x in out.items()}


def prose(rng, n, vocabulary=400):
    return " ".join(rng.choice(["", "Ü", "x1"]) + f"W{rng.randrange(vocabulary)}" + rng.choice(["", ",", "'s", "é"]) for _ in range(n))


def test_resampling_equals_brute_force(spark):
    rng = random.Random(7)
    docs = [(i, prose(rng, rng.randrange(1, 90))) for i in range(400)]
    docs += [(1000, None), (1001, ""), (1002, "?! ..."), (1003, "a" * 300 + " " + "b" * 65 + " " + "c" * 64 + " c"), (1004, "one"), (1005, "İstanbul ẞ 日本 語 K A_b[c]`d{e}~f\x7fg\x00h")]
    docs += [(2000 + i, docs[5][1]) for i in range(30)]  # copies
    target = [prose(rng, 60, 40) for _ in range(20)] + [None, ""]
    want = resampled(docs, target)
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, rank string, n_words int").repartition(6)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in resampling.importance_resample(frame, aim).collect()}
    assert got == want
    assert sum(x[3] is not None for x in want.values()) == 5 * sum(len(found(t)[0]) >= 20 for _, t in docs) // 100
    small = resampling.Settings(share=60, pivots=2, ranked=20)
    got = {r.doc_id: r["rank"] for r in resampling.importance_resample(frame, aim, small).collect()}
    assert got == {i: x[3] for i, x in resampled(docs, target, 60).items()}


def test_long_texts_are_taken_whole_in_parts(monkeypatch):
    rng = random.Random(8)
    text = prose(rng, 30_000) + " " + "z" * 5000 + " end"
    monkeypatch.setattr(resampling, "PART", 1 << 12)
    monkeypatch.setattr(resampling, "row_slices", lambda at: iter([(k, k + 1) for k in range(len(at) - 1)]))
    parts = list(resampling.features(pa.array([text, "after", None])))
    assert len(parts) > 50
    words, want = found(text)
    assert sum(int(n[0]) for rows, n, _, _ in parts if rows[0] == 0) == len(words)
    mine = np.concatenate([b[row == 0] for _, _, row, b in parts])
    assert sorted(mine.tolist()) == sorted(want)


def test_resampling_edges(spark):
    aim = spark.createDataFrame([("some words",)], "text string")
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.importance_resample(empty, aim).count() == 0
    few = spark.createDataFrame([(1, "only a few words")], "doc_id long, text string")
    assert [(r.doc_id, r["rank"]) for r in resampling.importance_resample(few, aim).collect()] == [(1, None)]
    text = " ".join(f"w{k}" for k in range(30))
    same = spark.createDataFrame([(None if i < 10 else 7, text) for i in range(40)], "doc_id int, text string")
    got = resampling.importance_resample(same, aim.limit(0), resampling.Settings(share=50)).collect()
    assert len(got) == 40 and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 21))
    texts = spark.createDataFrame([("b", text), ("a", text)], "doc_id string, text string")
    assert resampling.importance_resample(texts, aim, resampling.Settings(share=100)).count() == 2


# nearest neighbours


def truth(ids, e, queries, k):
    out = {}
    for q in queries:
        score = np.einsum("ij,j->i", e, e[ids.index(q)])
        out[q] = [(ids[j], score[j]) for j in sorted(range(len(ids)), key=lambda j: (-score[j], ids[j])) if ids[j] != q][:k]
    return out


@pytest.mark.parametrize("kind", ["even", "groups", "lengths"])
def test_nearest_vectors_reach_the_recall(spark, kind):
    rng = np.random.default_rng(9)
    e = rng.normal(size=(3000, 32))
    if kind == "groups":
        e = e * 0.3 + rng.normal(size=(60, 32))[rng.integers(60, size=3000)]
    if kind == "lengths":
        e = e * rng.lognormal(0, 0.5, size=(3000, 1))
    e = e.astype(np.float32)
    ids = [3 * i for i in range(3000)]
    frame = spark.createDataFrame([(i, v.tolist(), "x") for i, v in zip(ids, e)], "vec_id long, embedding array<float>, rank string").repartition(5)
    got = nearest_vectors.nearest_vectors(frame, "vec_id % 20 = 0", nearest_vectors.Settings(rows=500, queries=40)).collect()
    want = truth(ids, e.astype(float), [i for i in ids if i % 20 == 0], 20)
    near = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        near.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(near) == set(want)
    hits = sum(len({i for i, _ in near[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    for q, found_rows in near.items():
        assert len(found_rows) == 20 and found_rows == sorted(found_rows, key=lambda x: (-x[1], x[0])) and q not in [i for i, _ in found_rows]
        for i, score in found_rows[:3]:
            assert score == pytest.approx(float(e[ids.index(q)].astype(float) @ e[ids.index(i)].astype(float)), abs=1e-12)


def test_clustered_vectors_are_searched_in_part(spark):
    rng = np.random.default_rng(10)
    s = nearest_vectors.Settings()
    e = rng.normal(size=(4000, 32)) * 0.1 + rng.normal(size=(200, 32))[rng.integers(200, size=4000)]
    owner = np.repeat(np.arange(50), 5)
    near = np.concatenate([e[np.argsort(-(e @ e[q]))[1:6]] for q in range(50)])
    index = nearest_vectors.fit_index(e, float(np.linalg.norm(e, axis=1).max()), e[:50], near, owner, s)
    cells = np.floor(nearest_vectors.places(nearest_vectors._raised(e, index.longest), index))
    asked = nearest_vectors.places(nearest_vectors._asking(e[:50], index.rest), index)
    met = np.zeros((50, 4000), bool)
    for t in range(s.tables):
        there, visited = nearest_vectors.codes(cells[:, t], t, 32), nearest_vectors.codes(nearest_vectors.probe_sequence(asked[:, t], index.probes), t, 32)
        met |= (visited[:, :, None] == there[None, None]).any(1)
    assert met.mean() < 0.3


def test_probes_come_in_order_of_distance():
    rng = np.random.default_rng(11)
    place = rng.normal(size=(5, 4)) * 3
    got = nearest_vectors.probe_sequence(place, 20)
    for p, cells in zip(place, got):
        own = np.floor(p)
        every = []
        for step in np.ndindex(3, 3, 3, 3):
            d = np.array(step) - 1
            every.append(sum(0 if x == 0 else (p[m] - own[m]) ** 2 if x < 0 else (1 - p[m] + own[m]) ** 2 for m, x in enumerate(d)))
        cost = [sum(0 if x == 0 else (p[m] - own[m]) ** 2 if x < 0 else (1 - p[m] + own[m]) ** 2 for m, x in enumerate(c - own)) for c in cells]
        assert np.allclose(cost, sorted(every)[:20]) and (cells[0] == own).all() and len({tuple(c) for c in cells}) == 20


def test_nearest_vectors_edges(spark):
    schema = "vec_id long, label int, embedding array<float>, score string"
    rows = [(i, 0, [1.0, 2.0, 3.0], "x") for i in range(0, 60)]  # ties: smaller ids
    odd = [(None, 0, [1.0] * 3, "x"), (100, 0, None, "x"), (120, 0, [], "x"), (140, 0, [0.0] * 3, "x"), (160, 0, [1.0, None, 1.0], "x"), (180, 0, [float("nan")] * 3, "x"), (200, 0, [float("inf")] * 3, "x"), (220, None, [1.0, 2.0], "x")]
    again = [(1, 5, [9.0, 9.0, 9.0], "x")]
    got = nearest_vectors.nearest_vectors(spark.createDataFrame(rows + odd + again, schema), "vec_id % 20 = 0").collect()
    for q in (0, 20, 40):
        assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == [i for i in range(21) if i != q][:20]
        assert [r.rank for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == list(range(1, 21))
    assert {r.query_id for r in got} == {0, 20, 40}
    assert nearest_vectors.nearest_vectors(spark.createDataFrame([], schema), "vec_id % 20 = 0").count() == 0
    few = nearest_vectors.nearest_vectors(spark.createDataFrame(rows[:3], schema), "vec_id = 0").collect()
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(few, key=lambda r: r["rank"])] == [(1, 1, 14.0), (2, 2, 14.0)]
