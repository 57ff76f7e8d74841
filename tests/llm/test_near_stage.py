from __future__ import annotations

import random

import corpus_pipeline


def _texts(n: int) -> list[str]:
    rng = random.Random(11)
    return [" ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(40)) for _ in range(n)]


def _kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    return sorted(((r.doc_id is None, r.doc_id, r.text) for r in out.collect()), key=lambda x: (x[0], x[1] or 0, x[2]))


def test_rows_without_an_id_stay(spark):
    a, b, c, *_ = _texts(3)
    rows = [(1, a, 0), (None, b, 0), (None, c, 0), (2, a, 0), (None, a, 0), (None, b, 0)]
    assert [(i, t) for _, i, t in _kept(spark, [(k, t, n) for k, t, n in rows])] == [(1, a), *((None, t) for t in sorted([b, c]))]


def test_one_row_of_each_text_stays_where_ids_repeat(spark):
    for seed in range(2):
        a, b = _texts(2 * seed + 2)[-2:]
        assert [(i, t) for _, i, t in _kept(spark, [(3, a, 0), (5, a, 0), (5, b, 0), (7, b, 0)])] == [(3, a), (5, b)]


def test_unique_ids_keep_the_least(spark):
    a, b = _texts(2)
    assert [(i, t) for _, i, t in _kept(spark, [(9, a, 0), (4, a, 0), (6, b, 0)])] == [(4, a), (6, b)]
