"""Language identification: averaged hashed subword embeddings and a linear softmax layer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcodes import _LOWER, mix, row_slices, utf8

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """sample: labelled documents the model is fitted on at most, those with the smallest hashes, their
    whole texts. buckets, dim: of the embedding table. keep_precision: precision that accepted predictions reach on the calibration part."""

    sample: int = 4000
    buckets_bits: int = 14
    dim: int = 16
    epochs: int = 12
    rate: float = 0.5
    batch: int = 32
    keep_precision: float = 0.99
    seed: int = 5


@dataclass(frozen=True)
class Model:
    """table: logits that one subword of each bucket adds (embedding times output layer), by language;
    bias; temperature of the calibrated softmax; least score of an accepted prediction."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float
    bits: int


_SALT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def subwords(data: np.ndarray, at: np.ndarray, i: int, j: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all runs of two, three and four bytes (A-Z lower-cased) of rows i to j, and the row of each."""
    lo, hi = int(at[i]), int(at[j])
    b = _LOWER[data[lo:hi]].astype(np.uint64)
    row = np.repeat(np.arange(j - i), np.diff(at[i : j + 1]))
    out, rows = [], []
    code = b
    for n, salt in zip((2, 3, 4), _SALT):
        code = (code[:-1] << np.uint64(8)) | b[n - 1 :]
        same = row[: len(code)] == row[n - 1 :]
        out.append((mix(code[same] * salt + np.uint64(n)) >> np.uint64(64 - bits)).astype(np.int32))
        rows.append(row[: len(code)][same])
    return np.concatenate(out), np.concatenate(rows)


def parts(at: np.ndarray, i: int, j: int) -> list[tuple[np.ndarray, int, int]]:
    """Rows i to j in one, or a long row in overlapping parts, so that no run of bytes is lost: offsets and rows for ``subwords``."""
    if j - i > 1 or at[j] - at[i] <= 1 << 21:
        return [(at, i, j)]
    ends = range(int(at[i]), int(at[j]), 1 << 20)
    return [(np.array([p, min(p + (1 << 20) + 3, at[j])]), 0, 1) for p in ends]


def logits(column: pa.Array, model: Model) -> np.ndarray:
    """Mean logits of whole texts."""
    data, at = utf8(column)
    out = np.zeros((len(column), len(model.languages)))
    for i, j in row_slices(at, 1 << 19):
        n = j - i
        total, count = np.zeros((n, out.shape[1])), np.zeros(n)
        for edges, a, b in parts(at, i, j):
            bucket, row = subwords(data, edges, a, b, model.bits)
            count += np.bincount(row, minlength=n)
            for k in range(out.shape[1]):
                total[:, k] += np.bincount(row, model.table[bucket, k], n)
        out[i:j] = total / np.maximum(count, 1)[:, None] + model.bias
    return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], s: Settings) -> Model | None:
    """Fit on (language, buckets, counts) of documents by stochastic gradient descent; a fifth of them calibrates."""
    languages = sorted({r[0] for r in rows})
    if not languages:
        return None
    rng = np.random.default_rng(s.seed)
    y = np.array([languages.index(r[0]) for r in rows])
    held = np.arange(len(rows)) % 5 == 4
    emb = rng.normal(0, 0.1, (1 << s.buckets_bits, s.dim))
    out, bias = np.zeros((s.dim, len(languages))), np.zeros(len(languages))
    shares = [r[2] / max(r[2].sum(), 1) for r in rows]

    def mean(k: int) -> np.ndarray:
        return shares[k] @ emb[rows[k][1]]

    train = np.flatnonzero(~held)
    for epoch in range(s.epochs):
        rate = s.rate * (1 - epoch / s.epochs)
        for lo in range(0, len(train), s.batch):
            if lo == 0:
                rng.shuffle(train)
            batch = train[lo : lo + s.batch]
            h = np.stack([mean(k) for k in batch])
            g = softmax(h @ out + bias)
            g[np.arange(len(batch)), y[batch]] -= 1
            back = g @ out.T
            out -= rate * h.T @ g
            bias -= rate * 0.1 * g.mean(0)
            for k, d in zip(batch, back):
                emb[rows[k][1]] -= rate * 8 * shares[k][:, None] * d
    test = np.flatnonzero(held) if held.any() else train
    z = np.stack([mean(k) @ out + bias for k in test])
    loss = [(-np.log(softmax(z / t)[np.arange(len(test)), y[test]] + 1e-12).mean(), t) for t in np.geomspace(0.05, 20, 61)]
    temperature = min(loss)[1]
    p = softmax(z / temperature)
    score, right = p.max(1), p.argmax(1) == y[test]
    least = 0.0
    order = np.argsort(-score)
    precision = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(precision >= s.keep_precision)
    if len(good):
        least = float(score[order[good[-1]]]) if good[-1] + 1 < len(order) else 0.0
    return Model(languages, (emb @ out).astype(np.float32), bias, float(temperature), least, s.buckets_bits)


def train_language_model(docs: DataFrame, settings: Settings = Settings()) -> Model | None:
    """Fit on rows (doc_id, text, lang); rows without a lang or text are left out, repeated rows count once.
    Of at most ``sample`` rows the counts of hashed subwords, one for each bucket at most, reach the driver."""
    s = settings
    key = [F.crc32(F.concat_ws(":", F.lit("sample"), "doc_id").cast("binary")).alias("h"), F.xxhash64("doc_id", "lang", "text").alias("row")]
    rows = docs.select("doc_id", "lang", "text", *key).filter("lang is not null and text is not null and length(text) > 0")
    chosen = rows.select("h", "row").distinct().orderBy("h", "row").limit(s.sample)
    sampled = rows.join(F.broadcast(chosen), ["h", "row"])  # at most ``sample`` rows of two numbers

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(3))
            buckets, counts = [], []
            for k in range(len(batch)):
                total = np.zeros(1 << s.buckets_bits, np.int64)
                for edges, a, b in parts(at, k, k + 1):
                    total += np.bincount(subwords(data, edges, a, b, s.buckets_bits)[0], minlength=len(total))
                buckets.append(np.flatnonzero(total).astype(np.int32))
                counts.append(total[buckets[-1]].astype(np.int32))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(buckets, kind), pa.array(counts, kind)], ["h", "row", "lang", "buckets", "counts"])

    counted = sampled.select("h", "row", "lang", "text").mapInArrow(count, "h long, row long, lang string, buckets array<int>, counts array<int>")
    got = counted.dropDuplicates(["h", "row"]).toArrow()
    order = np.lexsort((got.column(1).to_numpy(), got.column(0).to_numpy()))
    langs, buckets, counts = (got.column(k) for k in (2, 3, 4))
    return fit([(langs[k].as_py(), buckets[k].values.to_numpy().astype(np.int64), counts[k].values.to_numpy().astype(np.float64)) for k in order.tolist()], s)


def identify_language(docs: DataFrame, model: Model | None) -> DataFrame:
    """Rows (doc_id, lang_pred, score, accepted) for each row (doc_id, text) of ``docs``.

    score is the calibrated probability of lang_pred; accepted says that it reaches the score at which
    predictions are precise enough. A null text, one without a letter, and every text where nothing
    was learned, is ``und`` with score 0. Whole texts are read, long ones in parts. Repeated rows and
    null doc_ids are judged each; an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            letter = np.array(batch.column(2).fill_null(False), bool)
            pred, score = np.full(len(batch), UNKNOWN, object), np.zeros(len(batch))
            if m is not None and len(batch):
                p = softmax(logits(batch.column(1), m) / m.temperature)
                pred = np.where(letter, np.array(m.languages, object)[p.argmax(1)], UNKNOWN)
                score = np.where(letter, p.max(1), 0.0)
            accepted = letter & (score >= (m.least if m else 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred.tolist(), pa.string()), pa.array(score), pa.array(accepted)], ["doc_id", "lang_pred", "score", "accepted"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.rlike("text", F.lit(r"\p{L}")).alias("letter"))
    return rows.mapInArrow(predict, "doc_id long, lang_pred string, score double, accepted boolean")
