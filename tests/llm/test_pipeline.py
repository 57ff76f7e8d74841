"""The stages on a small corpus, against plain Python, and on rows that are hard to keep."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from test_lines_rules import dedup, features
from test_near import group

import corpus_pipeline
from skytab.llm import mixing, quality, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tokens string, kept string, weight double"
OWN = ("the tokens column", "kept", 0.5)


def _corpus():
    rng = random.Random(31)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, 8)))
    shared = " ".join(word() for _ in range(12))
    texts = {}
    for k in range(60):
        lines = [" ".join(word() for _ in range(rng.randrange(8, 25))) + "." for _ in range(rng.randrange(4, 9))]
        if k % 6 == 0:
            lines.insert(1, shared)
        texts[k] = "\n".join(lines)
    for k in range(60, 80):  # copies, exact and near
        base = texts[k - 50].split(" ")
        if k % 2:
            base[len(base) // 2] = word()
        texts[k] = " ".join(base)
    texts |= {80: "too short", 81: None, 82: "", 83: "again and " * 80, 84: " ".join(f"{word()}#%$" for _ in range(70))}
    return texts


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    texts = _corpus()
    rows = [(k, t, "en" if k % 3 else "de", f"s{k % 4}", len(t or ""), *OWN) for k, t in texts.items()]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(0, 60, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return texts, path


def test_stages_equal_plain_python(spark, tables):
    texts, path = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    got = lambda df: {r.doc_id: r.text for r in df.collect()}

    # under a hundred labelled documents a language: no cutoffs, only the base rules
    kept = stage["quality_rules"](spark, docs, path)
    counts = {k: features(t) for k, t in texts.items()}
    good = {k: t for k, t in texts.items() if counts[k][0] >= 50 and 100 * counts[k][4] <= 50 * counts[k][0]}
    assert got(kept) == good and kept.columns == docs.columns and not {80, 81, 82, 83} & set(good)

    lines = stage["line_dedup"](spark, kept, path)
    after = {k: t for k, (t, _, _) in dedup(good).items()}
    assert got(lines) == after and after != good
    assert all((r.n_chars, r.tokens, r.kept, r.weight) == (len(r.text), *OWN) for r in lines.collect())

    near = stage["near_dedup"](spark, lines, path)
    root = group(after)
    first = {k: t for k, t in after.items() if root[k] == k}
    assert got(near) == first and len(first) < len(after)

    mixed = stage["source_mixing"](spark, near, path)
    chance = {r.doc_id: r.probability for r in mixing.mix_sources(near).collect()}
    hashed = {k: int(hashlib.md5(f"23:{k}".encode()).hexdigest()[:8], 16) / 2**32 for k in first}
    assert got(mixed) == {k: t for k, t in first.items() if hashed[k] < chance[k]}
    assert all((r.tokens, r.kept, r.weight) == OWN for r in mixed.collect())

    pieces = defaultdict(list)
    for r in stage["packing"](spark, mixed, path).collect():
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32))
    assert set(pieces) == set(got(mixed))
    for k, t in got(mixed).items():
        ids, at = tokens.token_ids(t, "byte_bpe_50k").astype("<u4"), 0
        for start, n, crc in sorted(pieces[k]):
            assert start == at and crc == zlib.crc32(ids[start : start + n].tobytes())
            at += n
        assert at == len(ids)

    # run() is these stages one after another
    run = sorted((r.doc_id, r.start, r.ids_crc32) for r in corpus_pipeline.run(spark, path).collect())
    assert run == sorted((k, start, crc) for k, own in pieces.items() for start, _, crc in own)


def test_stages_take_hard_rows(spark, tables):
    """Null and repeated ids, null columns, very long texts, no rows: nothing fails, and nothing is lost that a stage has no reason to drop."""
    _, path = tables
    long = " ".join(f"w{k % 9001}x{k}" for k in range(120_000))
    rows = [(None, long, None, None, None, *OWN), (7, long + " y", None, "s", 1, *OWN), (7, "z " + long[:5000], "en", None, 2, *OWN), (7, "z " + long[:5000], "en", None, 2, *OWN), (8, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        if name != "near_dedup":  # see test_near.py
            assert stage(spark, docs.limit(0), path).count() == 0
        out = stage(spark, docs, path)
        ids = sorted(str(r.doc_id) for r in out.select("doc_id").distinct().collect())
        if name != "packing":
            assert out.columns == docs.columns
        if name in ("line_dedup", "packing"):
            assert ids == ["7", "8", "None"]
        if name == "line_dedup":
            assert out.count() == len(rows)
        if name == "quality_rules":
            assert ids == ["7", "None"] and out.count() == 4
        if name == "near_dedup":
            assert out.count() == 3
    assert quality.Settings().min_words == 50


def test_only_the_result_stays_in_the_shared_folder(spark, tables, tmp_path, monkeypatch):
    monkeypatch.setattr("skytab.checkpoints.shared_dir", lambda _: f"file://{tmp_path}")
    done = corpus_pipeline.run(spark, tables[1])
    assert [p.name.split("-")[1] for p in tmp_path.iterdir()] == ["packing"] and done.count() > 0
