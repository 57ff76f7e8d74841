from __future__ import annotations

import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
from skytab.llm import near_text, near_vectors
from skytab.operators.components import connected_components

DOCS = "doc_id long, text string, kept string"


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def group(texts, s=near_text.Settings()):
    """Components by brute force with the exact document frequencies."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        if w:
            sets[i] = Counter(tuple(w[k : k + s.width]) for k in range(max(1, len(w) - s.width + 1)))
    df, n = Counter(x for c in sets.values() for x in c), len(texts)
    weight = {x: 1 + s.boost * min(1.0, np.log(n / k) / np.log(1 / s.rare)) for x, k in df.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = sum(min(sets[a][x], sets[b][x]) * weight[x] for x in sets[a] if x in sets[b])
        total = sum(k * weight[x] for c in (sets[a], sets[b]) for x, k in c.items()) - both
        if both / total >= s.similarity:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {i: find(i) for i in texts}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(1)
    texts = {}
    for k in range(30):
        base = words(rng, rng.randrange(20, 200))
        texts[len(texts)] = " ".join(base)
        for edits in (0, 1, 2, 3, 30):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = "changed%d" % rng.randrange(10**6)
            texts[len(texts)] = " ".join(copy) if edits else " ".join(base).upper().replace("W", "w") + " \n"
    texts |= {1000: None, 1001: "", 1002: " \n\t", 1003: "two words", 1004: "Two  Words", 1005: " ".join(words(rng, 30000)), 1006: " ".join(f"u{k}" for k in range(300_000)), 1007: " ".join(f"u{k}" for k in range(50, 300_000))}
    docs = spark.createDataFrame([(i, t, "other") for i, t in texts.items()], DOCS)
    got = near_text.near_duplicates(docs.repartition(7)).collect()
    assert len(got) == len(texts)
    assert {r.doc_id: r.component_id for r in got} == group(texts)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    same = {r.doc_id: (r.class_id, r.n_copies) for r in got}
    assert same[0] == (0, 2) and same[1004] == (1003, 2) and same[1000] == (1000, 1)


def test_near_duplicates_edges(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", ""), (1, "a b c d e f", ""), (2, "A b c d e f", ""), (None, "a b c d e f", "")], DOCS)
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_text.near_duplicates(docs).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False)]
    assert near_text.near_duplicates(docs.limit(0)).count() == 0


def test_mixed_buckets_are_compared_in_blocks(spark):
    """A bucket with many copies of two texts that differ too much to link: blocks of four find each group."""
    rng = random.Random(2)
    base = words(rng, 200)
    other = base[:130] + words(rng, 70)
    texts = {}
    for k in range(24):
        copy = list(base if k % 2 else other)
        copy[k] = f"edit{k}"
        texts[k] = " ".join(copy)
    s = near_text.Settings(block=4)
    got = near_text.near_duplicates(spark.createDataFrame([(i, t, "") for i, t in texts.items()], DOCS), s).collect()
    assert {r.doc_id: r.component_id for r in got} == group(texts, s)


def test_components(spark):
    chain = [(k, k + 1) for k in range(1, 60)] + [(100, 101), (101, 102), (100, 100), (200, 200), (7, None)]
    rng = random.Random(3)
    rng.shuffle(chain)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert got == {k: 1 for k in range(1, 61)} | {100: 100, 101: 100, 102: 100, 200: 200}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, dim string"


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows, x = [], rng.normal(size=(60, 64))
    for k in range(600):
        v = x[k % 60] + rng.normal(size=64) * rng.choice([0.05, 0.1, 0.15, 0.3])
        rows.append((k, [float(np.float32(a)) for a in v], int(k % 60 % 3)))
    crowd = x[0] + rng.normal(size=(400, 64)) * 0.08  # one bucket with more rows than a block
    rows += [(1000 + k, [float(np.float32(a)) for a in v], 0) for k, v in enumerate(crowd)]
    rows += [(2000 + k, rows[k % 7][1], rows[k % 7][2]) for k in range(300)]  # copies
    got = near_vectors.near_duplicate_vectors(spark.createDataFrame([(*r, "z") for r in rows], VECTORS), near_vectors.Settings(block=64)).collect()
    ids = np.array([r[0] for r in rows])
    unit = np.array([r[1] for r in rows])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    link = (unit @ unit.T >= 0.98) & (label[:, None] == label) & ~np.eye(len(rows), dtype=bool)
    n = dict(zip(ids.tolist(), link.sum(1).tolist()))
    found = {r.vec_id: r.n_links for r in got}
    assert all(found[k] <= n[k] for k in n)
    assert sum(found.values()) >= 0.999 * sum(n.values()) > 10_000
    if found == n:
        root = ids.copy()
        while True:
            new = np.minimum(root, np.where(link, root[None, :], 1 << 40).min(1))
            if (new == root).all():
                break
            root = new
        assert {r.vec_id: r.component_id for r in got} == dict(zip(ids.tolist(), root.tolist()))


def test_vectors_edges(spark):
    nan, one = float("nan"), [1.0, 0.0, 0.0]
    rows = [(1, one, 1, ""), (2, one, 1, ""), (3, one, None, ""), (4, one, 2, ""), (5, None, 1, ""), (6, [0.0, 0.0, 0.0], 1, ""), (7, [nan, 0.0, 0.0], 1, ""), (8, [None, 1.0, 0.0], 1, ""), (9, [1.0, 0.0], 1, ""), (10, [], 1, ""), (2, one, 1, ""), (None, one, 1, ""), (11, [float("inf"), 0.0, 0.0], 1, ""), (12, [2e30, 0.0, 0.0], 5, ""), (13, [1e-30, 0.0, 0.0], 5, ""), (14, [1e30, 0.5e30, 0.0], 5, "")]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors.near_duplicate_vectors(spark.createDataFrame(rows, VECTORS)).collect()}
    alone = {k: (0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, 10, 11, 14)}
    assert got == {1: (1, 1, True), 2: (1, 1, False), 12: (1, 12, True), 13: (1, 12, False)} | alone
    huge = spark.createDataFrame([(1, [1e200, 0.0], 1), (2, [2e200, 1e199], 1), (3, [1e-200, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    assert {r.vec_id: r.component_id for r in near_vectors.near_duplicate_vectors(huge).collect()} == {1: 1, 2: 1, 3: 1}
    assert near_vectors.near_duplicate_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_wider_tables_for_more_vectors():
    s = near_vectors.Settings()
    assert s.sized(1000) == s and s.sized(1 << 17) == s
    wide = s.sized(1 << 25)
    assert (wide.bits, wide.tables) == (29, 2) and wide.probes > s.probes
    rng = np.random.default_rng(8)
    x = near_vectors._unit(rng.normal(size=(3000, 64)))
    e = rng.normal(size=x.shape)
    e = near_vectors._unit(e - (e * x).sum(1)[:, None] * x)
    y = 0.981 * x + np.sqrt(1 - 0.981**2) * e
    for t, least in ((s, 0.999), (wide, 0.985)):
        rotation = near_vectors.learn_rotation(x, t)
        a, b = near_vectors.lookups(x, rotation, t), near_vectors.lookups(y, rotation, t)
        assert ((a == b[:, :, :1]).any(2) | (b == a[:, :, :1]).any(2)).any(1).mean() >= least


def test_codes_are_balanced():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 32)) * np.linspace(3, 0.2, 32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = near_vectors.Settings(tables=2, bits=8)
    rotation = near_vectors.learn_rotation(x, s)
    assert np.allclose(rotation.axes.T @ rotation.axes, np.eye(16), atol=1e-8)
    share = ((x - rotation.mean) @ rotation.axes >= 0).mean(0)
    assert share.min() > 0.4 and share.max() < 0.6
    codes = near_vectors.lookups(x[:50], rotation, s)
    assert all(len(set(row.tolist())) == codes.shape[2] for v in codes for row in v)


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(6)
    sampler = near_text.Sampler(1024, 1.0, 1)
    codes = np.sort(rng.integers(0, 1 << 63, 300, np.uint64))
    w = rng.choice([1.0, 1.2, 2.0, 3.0], 300).astype(np.float32)
    v = np.where(rng.random(300) < 0.3, np.float32(1), w)
    a, b = (slice(0, 240), slice(60, 300))
    sig = [sampler.signatures(codes[p], q[p], np.array([240]))[0] for p, q in ((a, w), (b, v))]
    x, y = np.zeros(300), np.zeros(300)
    x[a], y[b] = w[a], v[b]
    exact = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.05
