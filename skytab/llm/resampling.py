"""Target-distribution importance resampling: hashed n-gram weights, perturbed scores, distributed quickselect."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, scratch
from .textcodes import row_slices, utf8


@dataclass(frozen=True)
class Settings:
    """orders: features are runs of 1 to so many words. buckets: of hashed features. share: per cent of the documents
    with ``min_words`` words that are drawn. seed: of the perturbation. pivots: random keys that a round of the
    selection counts against. ranked: winners that one task sorts."""

    orders: int = 3
    buckets: int = 10_000
    share: int = 5
    min_words: int = 20
    seed: int = 42
    pivots: int = 31
    ranked: int = 50_000


_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
PART = 1 << 22  # bytes of a long text that are taken at once
SHORT = 64  # bytes of a word that is hashed together with others


@cache
def _steps() -> np.ndarray:
    """What a byte does to the state of a CRC-32."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


@cache
def _shifts() -> tuple[np.ndarray, np.ndarray]:
    """[length, byte, value]: a CRC-32 after so many zero bytes, of 0 to SHORT + 1 zeros and of 2 ** k zeros."""
    step = _steps()
    shift = lambda c: step[c & np.uint32(255)] ^ (c >> np.uint32(8))
    own = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    lengths = [own]
    for _ in range(SHORT + 1):
        lengths.append(shift(lengths[-1]))
    powers = [lengths[1]]
    for _ in range(40):
        powers.append(_apply(powers[-1][None], np.zeros(4 * 256, np.int64), powers[-1].ravel()).reshape(4, 256))
    return np.stack(lengths), np.stack(powers)


def _apply(tables: np.ndarray, at: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Each state c after the zeros of the table at its index."""
    out = tables[at, 0, c & np.uint32(255)]
    for j in (1, 2, 3):
        out = out ^ tables[at, j, (c >> np.uint32(8 * j)) & np.uint32(255)]
    return out


def _after(c: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """CRCs after so many zero bytes each: the CRC of a and b joined is that of a after len(b) zeros, xor that of b."""
    lengths, powers = _shifts()
    out = _apply(lengths, np.minimum(zeros, SHORT + 1), c)
    for i in np.flatnonzero(zeros > SHORT + 1):
        own = c[i : i + 1]
        for k in range(int(zeros[i]).bit_length()):
            if zeros[i] >> k & 1:
                own = _apply(powers, np.array([k]), own)
        out[i] = own[0]
    return out


def _words(text: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC-32, length and start of each word of lower-cased bytes; ``heads``: bytes where a row begins."""
    on = _WORD[text]
    first = on.copy()
    first[1:] &= ~on[:-1]
    first[heads] |= on[heads]
    starts = np.flatnonzero(first)
    last = on.copy()
    last[:-1] &= ~on[1:]
    ends = heads[heads > 0] - 1
    last[ends] |= on[ends]
    size = np.flatnonzero(last) + 1 - starts
    crc = np.zeros(len(starts), np.uint32)
    order = np.argsort(-size, kind="stable")
    order = order[np.searchsorted(-size[order], -SHORT) :]
    state = np.full(len(order), 0xFFFFFFFF, np.uint32)
    at, left, step = starts[order], -size[order], _steps()
    for k in range(int(-left[0]) if len(left) else 0):
        n = int(np.searchsorted(left, -k))
        state[:n] = step[(state[:n] ^ text[at[:n] + k]) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
    crc[order] = ~state
    for i in np.flatnonzero(size > SHORT):
        crc[i] = zlib.crc32(text[starts[i] : starts[i] + size[i]].tobytes())
    return crc, size, starts


def _runs(crc: np.ndarray, size: np.ndarray, place: np.ndarray, s: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """For 1, 2, ... words: the last word's index and the bucket of each run; ``place``: a word's number in its row."""
    blank = np.full(len(crc), zlib.crc32(b" "), np.uint32)
    joined = _after(blank, size) ^ crc
    ends, run = np.arange(len(crc)), crc
    out = [(ends, run % np.uint32(s.buckets))]
    for k in range(1, s.orders):
        keep = place[ends] >= k  # the run of k words that ends a word earlier lies in the same row
        ends, before = ends[keep], np.flatnonzero(keep) - 1
        run = _after(run[before], size[ends] + 1) ^ joined[ends]
        out.append((ends, run % np.uint32(s.buckets)))
    return out


def features(column: pa.Array, s: Settings = Settings()) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of parts of a string column: rows, how many words each has there, and row and bucket of each feature.

    A row longer than PART comes in several parts, each of which goes on from the last words of the one before."""
    data, at = utf8(column)
    for i, j in row_slices(at):
        lo, hi = int(at[i]), int(at[j])
        if j - i > 1 or hi - lo <= PART:
            text = _LOWER[data[lo:hi]]
            heads = np.unique(at[i:j] - lo)
            crc, size, starts = _words(text, heads[heads < hi - lo])
            row = np.searchsorted(at[i : j + 1] - lo, starts, "right") - 1
            place = np.arange(len(row)) - np.searchsorted(row, row)
            runs = _runs(crc, size, place, s)
            yield np.arange(i, j), np.bincount(row, minlength=j - i), np.concatenate([row[e] for e, _ in runs]) + i, np.concatenate([b for _, b in runs])
            continue
        crc, size, seen = np.zeros(0, np.uint32), np.zeros(0, np.int64), 0
        while lo < hi:
            end = min(hi, lo + PART)
            while end < hi and _WORD[_LOWER[data[end]]]:
                end += 1
            new_crc, new_size, _ = _words(_LOWER[data[lo:end]], np.zeros(0, np.int64))
            old = len(crc)
            crc, size = np.concatenate([crc, new_crc]), np.concatenate([size, new_size])
            buckets = np.concatenate([b[e >= old] for e, b in _runs(crc, size, seen - old + np.arange(len(crc)), s)])
            yield np.array([i]), np.array([len(new_crc)]), np.full(len(buckets), i), buckets
            seen += len(new_crc)
            crc, size, lo = crc[len(crc) - min(len(crc), s.orders - 1) :], size[len(size) - min(len(size), s.orders - 1) :], end


def feature_counts(texts: DataFrame, s: Settings = Settings()) -> DataFrame:
    """How many features of all ``texts`` (text) fall in each bucket: bucket, n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(s.buckets, np.int64)
        for batch in batches:
            for _, _, _, buckets in features(batch.column(0), s):
                n += np.bincount(buckets, minlength=s.buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], ["bucket", "n"])

    return texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, s: Settings = Settings()) -> np.ndarray:
    """Thousandths of the log of how much likelier each bucket is in the target, smoothed by one; one number a bucket."""
    both = feature_counts(corpus, s).withColumn("side", F.lit(0)).unionByName(feature_counts(target, s).withColumn("side", F.lit(1)))
    n = np.zeros((2, s.buckets))
    for r in both.collect():  # at most two numbers a bucket
        n[r.side, r.bucket] = r.n
    total = n.sum(1) + s.buckets
    return np.array([math.floor(1000 * math.log((t + 1.0) * total[0] / ((c + 1.0) * total[1]))) for c, t in n.T], np.int64)


def _scored(docs: DataFrame, gains: np.ndarray, s: Settings) -> DataFrame:
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = gains.astype(np.float64)
        for batch in batches:
            n_words, n, total = (np.zeros(len(batch), np.int64) for _ in range(3))
            for rows, words, row, buckets in features(batch.column(1), s):
                i, m = int(rows[0]), len(rows)
                n_words[rows] += words
                n[rows] += np.bincount(row - i, minlength=m)
                total[rows] += np.bincount(row - i, own[buckets], m).astype(np.int64)  # sums of whole numbers are exact
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n_words, n, total))], ["doc_id", "n_words", "n_features", "weight"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text").mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")
    key = F.concat(F.lit(f"{s.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return rows.withColumns({"score": F.col("weight") + noise, "row": F.monotonically_increasing_id()})


def _key() -> list[Column]:
    """Least first: higher scores, then smaller doc_ids (null last), then rows as stored."""
    return [(-F.col("score")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"), F.col("row").alias("d")]


def kth_key(rows: DataFrame, k: int, n: int, s: Settings = Settings()) -> Column:
    """The k-th least composite key of ``n`` ``rows`` by quickselect.

    A round draws random keys out of the range that is left and counts exactly how many rows lie below, at and between
    them; the range shrinks to the part that holds the k-th. Only pivots and counts reach the driver.
    """
    key, kinds = F.struct(*_key()), [f.dataType for f in rows.select(*_key()).schema]
    literal = lambda p: F.struct(*(F.lit(v).cast(t).alias(c) for v, t, c in zip(p, kinds, "abcd")))
    left, turn = rows, 0
    while True:
        turn += 1
        spread = 1 << 40
        part = min(1.0, 2 * s.pivots / n)
        drawn = left.filter(F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(spread)) < int(part * spread)) if part < 1 else left
        pivots = [literal(p) for p in sorted({tuple(r) for r in drawn.select(*_key()).limit(4 * s.pivots).collect()}, key=lambda p: (p[0], p[1], p[1] or p[2], p[3]))]
        if not pivots:
            continue
        place = sum(((key > p).cast("int") + (key >= p).cast("int") for p in pivots[1:]), (key > pivots[0]).cast("int") + (key >= pivots[0]).cast("int"))
        for at, count in sorted(tuple(r) for r in left.groupBy(place.alias("place")).count().collect()):
            if k <= count:
                break
            k -= count
        if at % 2:
            return pivots[at // 2]
        n = count
        if at:
            left = left.filter(key > pivots[at // 2 - 1])
        if at // 2 < len(pivots):
            left = left.filter(key < pivots[at // 2])


def importance_resample(docs: DataFrame, target: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Draw the documents (doc_id, text) that look most like ``target`` (text), perturbed so that the draw is a sample.

    A-Z are lower-cased, words are runs of digits, letters and characters beyond ASCII; runs of one to three words
    are hashed into buckets, whose gains weigh the documents. A Gumbel term from a hash of doc_id is added, and ``share``
    per cent of the documents with ``min_words`` words are drawn by the largest scores. One row a document: doc_id,
    n_words, n_features, weight, score, rank (1 the highest; null if not drawn).

    A null or empty text has no features and weight 0. Rows that repeat a doc_id are rows of their own, in the order
    in which they are stored where they tie; rows without a doc_id share one perturbation and come last of a tie. Long
    texts are taken whole, in parts. An empty table gives no rows, an empty target equal counts of 0. Other columns are ignored.
    """
    s = settings
    with scratch(docs.sparkSession) as keep:
        gains = bucket_gains(docs, target, s)
        rows = cut(_scored(docs, gains, s), "scored")
        able = rows.filter(F.col("n_words") >= s.min_words)
        n = able.count()
        k = s.share * n // 100
        out, unranked = ["doc_id", "n_words", "n_features", "weight", "score"], F.lit(None).cast("long").alias("rank")
        if k == 0:
            return keep(rows.select(*out, unranked), "resampled")
        last = kth_key(able, k, n, s)
        drawn = (F.col("n_words") >= s.min_words) & (F.struct(*_key()) <= last)
        parts = -(-k // s.ranked)
        winners = rows.filter(drawn).repartitionByRange(parts, *_key()).withColumn("part", F.spark_partition_id())
        winners = cut(winners, "winners")
        before = 0
        starts = []
        for r in winners.groupBy("part").count().orderBy("part").collect():  # one row a task
            starts.append((r["part"], before))
            before += r["count"]
        starts = docs.sparkSession.createDataFrame(starts, "part int, before long")
        place = F.row_number().over(Window.partitionBy("part").orderBy(*_key()))
        ranked = winners.withColumn("place", place).join(starts, "part").select(*out, (F.col("before") + F.col("place")).cast("long").alias("rank"))
        return keep(rows.filter(~drawn).select(*out, unranked).unionByName(ranked), "resampled")
