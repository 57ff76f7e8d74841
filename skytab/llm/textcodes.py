"""Numpy codes of words and word shingles, from Arrow string columns, a slice of rows at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_WS = np.zeros(256, bool)
_WS[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD_MIX = np.array([0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0xA0761D6478BD642F], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of uint64 values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null rows are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def row_slices(at: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes each, one row at least."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, j
        i = j


def _hashes(text: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of ``text``; ``heads``: bytes where a row begins."""
    ws = _WS[text]
    first = np.empty(len(text), bool)
    first[:1] = True
    first[1:] = ws[:-1]
    first[heads] = True
    starts = np.flatnonzero(first & ~ws)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    spans = np.diff(starts, append=len(text))
    place = np.arange(starts[0], len(text)) - np.repeat(starts, spans)
    power = np.cumprod(np.full(int(spans.max()), _BASE, np.uint64))
    value = _LOWER[text[starts[0] :]].astype(np.uint64) + np.uint64(1)
    value[ws[starts[0] :]] = 0
    return mix(np.add.reduceat(value * power[place], starts - starts[0])), starts


def word_hashes(data: np.ndarray, at: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z lower-cased) of rows i to j, and how many words each row has.

    A row longer than a slice is hashed in parts that end at white space.
    """
    lo, hi = int(at[i]), int(at[j])
    if hi - lo <= 4 * SLICE_BYTES:
        heads = np.unique(at[i:j] - lo)
        found, starts = _hashes(data[lo:hi], heads[heads < hi - lo])
        return found, np.diff(np.searchsorted(starts, at[i : j + 1] - lo))
    parts, p = [], lo
    while p < hi:
        q = min(hi, p + SLICE_BYTES)
        while q < hi and not _WS[data[q]]:
            q += 1
        parts.append(_hashes(data[p:q], np.zeros(1, np.int64))[0])
        p = q
    found = np.concatenate(parts)
    return found, np.array([len(found)])


def shingle_codes(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the runs of ``width`` words of each row, and how many each row has.

    A row of fewer words, one at least, has one shingle of all its words.
    """
    n = len(words)
    row = np.repeat(np.arange(len(counts)), counts)
    size = np.where(counts == 0, 0, np.maximum(counts - width + 1, 1))
    if n == 0:
        return words, size
    total = np.zeros(n, np.uint64)
    for k in range(width):
        m = max(n - k, 0)
        same = row[k:] == row[:m]
        total[:m] += np.where(same, words[k:] * _WORD_MIX[k], np.uint64(0))
    left = np.repeat(np.cumsum(counts), counts) - np.arange(n)
    first = np.arange(n) == np.repeat(np.cumsum(counts) - counts, counts)
    return mix(total[(left >= width) | first]), size


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of rows: first row, sorted distinct codes of all rows one after another, how often
    each occurs in its row, how many each row has, and a hash of each row's word sequence."""
    data, at = utf8(column)
    for i, j in row_slices(at):
        words, counts = word_hashes(data, at, i, j)
        codes, size = shingle_codes(words, counts, width)
        ends, wends = np.cumsum(size), np.cumsum(counts)
        sets, times, sizes, whole = [], [], np.zeros(j - i, np.int64), np.zeros((j - i, 2), np.uint64)
        for k in range(j - i):
            own = codes[ends[k] - size[k] : ends[k]]
            if len(own):
                own.sort()
                cut_at = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                sets.append(own[cut_at])
                times.append(np.diff(cut_at, append=len(own)))
                sizes[k] = len(cut_at)
                w = words[wends[k] - counts[k] : wends[k]]
                p = np.arange(1, len(w) + 1, dtype=np.uint64)
                whole[k] = np.sum(mix(w + p * _BASE), dtype=np.uint64), np.sum(mix((w ^ _WORD_MIX[0]) * (p + p + np.uint64(1))), dtype=np.uint64)
        yield i, np.concatenate(sets) if sets else codes[:0], np.concatenate(times) if times else np.zeros(0, np.int64), sizes, whole
