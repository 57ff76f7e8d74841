"""Toxicity: a gap-weighted subsequence kernel, Nyström landmarks and a linear support vector machine."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, scratch
from .textcodes import mix

_INNER = re.compile(r"[\W_]+")
_SPACED = re.compile(r"(?<!\S)(?:\S[ \t]){3,}\S(?!\S)")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n")
_PIECE = re.compile(r"\S.{0,510}(?!\S)|\S{1,512}")
LONGEST = 24
_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """sample: labelled documents the model is fitted on at most, those with the smallest hashes.
    sentences: labelled sentences of them on which the machine is fitted at most, of each label; all of
    their words take part. span: letters over which the four letters of a subsequence may be spread.
    decay: weight of each letter skipped. landmarks: of the Nyström space. evidence: log-likelihood
    ratio from which on a word is taken as toxic at first. odds: how many times as many toxic documents
    as clean ones must show a word that is taken as toxic later. fits: rounds of fitting. put_in:
    letters put in at each place of a toxic word to make forms that are learned too, and gaps: what these
    forms together weigh against the word. strict: weight of a
    clean word against that of the mean toxic one. cost: weight of the hinges against the norm."""

    sample: int = 8000
    sentences: int = 25_000
    span: int = 7
    decay: float = 0.9
    landmarks: int = 384
    evidence: float = 6.0
    odds: float = 4.0
    strict: float = 1.0
    fits: int = 2
    put_in: int = 2
    gaps: float = 4.0
    cost: float = 10_000.0
    seed: int = 3


@dataclass(frozen=True)
class Model:
    """gain: for each subsequence code of the landmarks what it adds to the margin of a word of unit norm."""

    codes: np.ndarray
    gain: np.ndarray
    bias: float
    slope: np.ndarray
    shift: float
    floor: float
    settings: Settings


def sentences(text: str) -> list[str]:
    """The sentences of a text; overlong ones in pieces of at most 512 characters, at white space where there is some."""
    return [p for x in _SENTENCE.split(text) if x for p in (_PIECE.findall(x) if len(x) > 512 else [x])]


def words(text: str) -> set[str]:
    """Lower-case words without inner marks (w.o-r_d is word), and runs of single letters joined (w o r d)."""
    low = text.lower()
    out = set(low.split())
    odd = [w for w in out if not w.isalnum()]
    out.difference_update(odd)
    out.update(_INNER.sub("", w) for w in odd)
    if len(joined := _SPACED.findall(low)):
        out.update(_INNER.sub("", w) for w in joined)
    out.discard("")
    return out


def _patterns(span: int, decay: float) -> list[tuple[tuple[int, ...], float]]:
    return [((0, *c), decay ** (c[-1] - 3)) for c in combinations(range(1, span), 3)]


def subsequences(items: list[str], s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For groups of words of one length: their places in ``items``, codes [word, subsequence] and weights.

    The start and the end of a word count as letters. A word longer than LONGEST is read in windows
    that overlap by half.
    """
    by_length: dict[int, list[tuple[int, str]]] = {}
    for k, w in enumerate(items):
        w = f"\x02{w}\x03"
        for lo in range(0, max(1, len(w) - LONGEST // 2), LONGEST // 2) if len(w) > LONGEST else (0,):
            part = w[lo : lo + LONGEST]
            if len(part) >= 4:
                by_length.setdefault(len(part), []).append((k, part))
    for n, group in by_length.items():
        for lo in range(0, len(group), 20_000):
            at = np.array([k for k, _ in group[lo : lo + 20_000]])
            chars = np.array([w for _, w in group[lo : lo + 20_000]], f"<U{n}").view(np.uint32).reshape(len(at), n).astype(np.uint64)
            codes, weights = [], []
            for places, weight in _patterns(s.span, s.decay):
                m = n - places[-1]
                if m <= 0:
                    continue
                code = chars[:, :m]
                for p in places[1:]:
                    code = code * _BASE + chars[:, p : p + m]
                codes.append(code)
                weights.append(np.full(m, weight, np.float32))
            yield at, np.concatenate(codes, 1), np.concatenate(weights)


@dataclass(frozen=True)
class Features:
    """Rows of subsequence codes and values of unit norm, one after another; start: where each row begins, and the end."""

    codes: np.ndarray
    values: np.ndarray
    start: np.ndarray

    def take(self, rows: np.ndarray) -> Features:
        size = np.diff(self.start)[rows]
        at = np.repeat(self.start[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return Features(self.codes[at], self.values[at], np.r_[0, np.cumsum(size)])

    def blocks(self, codes: np.ndarray, columns: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Products of the rows with columns over the sorted ``codes``, some thousand rows at a time: first row, products."""
        for lo in range(0, len(self.start) - 1, 4096):
            edges = self.start[lo : lo + 4097]
            out = np.zeros((len(edges) - 1, columns.shape[1]), np.float32)
            own = self.codes[edges[0] : edges[-1] if len(codes) else edges[0]]
            at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
            hit = np.flatnonzero(codes[at] == own)
            row = np.searchsorted(edges - edges[0], hit, "right") - 1
            for k in range(0, len(hit), 1 << 14):
                some, r = hit[k : k + (1 << 14)], row[k : k + (1 << 14)]
                first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                out[r[first]] += np.add.reduceat(self.values[edges[0] + some][:, None] * columns[at[some]], first)
            yield lo, out

    def margins(self, codes: np.ndarray, gain: np.ndarray) -> np.ndarray:
        column = gain[:, None].astype(np.float32)
        return np.concatenate([x[:, 0] for _, x in self.blocks(codes, column)])


def _joined(parts: list[Features]) -> Features:
    ends = np.cumsum([0, *(len(p.codes) for p in parts)])
    start = [p.start[:-1] + e for p, e in zip(parts, ends)]
    return Features(np.concatenate([p.codes for p in parts]), np.concatenate([p.values for p in parts]), np.concatenate([*start, ends[-1:]]))


def _features(items: list[str], s: Settings) -> Features:
    """Distinct codes and summed weights of each word, scaled to unit norm."""
    if len(items) > 8192:
        return _joined([_features(items[lo : lo + 8192], s) for lo in range(0, len(items), 8192)])
    rows, codes, values = [], [], []
    for at, own, weights in subsequences(items, s):
        rows.append(np.repeat(at, own.shape[1]))
        codes.append(own.ravel())
        values.append(np.tile(weights, len(at)))
    if not rows:
        return Features(np.zeros(0, np.uint64), np.zeros(0, np.float32), np.zeros(len(items) + 1, np.int64))
    row, code, value = np.concatenate(rows), np.concatenate(codes), np.concatenate(values)
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (code[1:] != code[:-1])])
    x, row, code = np.add.reduceat(value[order].astype(np.float64), first), row[first], code[first]
    norm = np.sqrt(np.bincount(row, x * x, len(items)))
    return Features(code, (x / norm[row]).astype(np.float32), np.r_[0, np.cumsum(np.bincount(row, minlength=len(items)))])


def _choose_landmarks(features: Features, weight: np.ndarray, n: int) -> list[int]:
    """Rows, heaviest first, that are not yet close to a chosen one; then closer ones.

    Closeness is taken from 1024 hashed subsequences, which is enough to spread the choice.
    """
    size = np.diff(features.start)
    x = np.zeros((len(size), 1024), np.float32)
    np.add.at(x, (np.repeat(np.arange(len(size)), size), (mix(features.codes) >> np.uint64(54)).astype(np.int64)), features.values)
    order, chosen, close = np.argsort(-weight, kind="stable"), [], np.zeros(len(size))
    for bound in (0.3, 0.5, 0.7, 0.9):
        for k in order.tolist():
            if len(chosen) >= n:
                return chosen
            if close[k] < bound and size[k]:
                chosen.append(k)
                close = np.maximum(close, x @ x[k])
    return chosen


def _dense(features: Features, codes: np.ndarray) -> np.ndarray:
    """Rows as columns over the sorted ``codes``, which hold all of theirs."""
    out = np.zeros((len(codes), len(features.start) - 1), np.float32)
    out[np.searchsorted(codes, features.codes), np.repeat(np.arange(out.shape[1]), np.diff(features.start))] = features.values
    return out


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, s: Settings) -> np.ndarray:
    """Weights of a squared-hinge machine over rows that end in a one, for the bias, by Newton steps: least
    squares over the rows within the margin."""
    ridge = np.diag(np.r_[np.full(x.shape[1] - 1, 0.5 / s.cost), 1e-9])
    w = np.r_[np.zeros(x.shape[1] - 1), -0.5]
    for _ in range(30):
        gram, side = ridge.copy(), np.zeros(len(w))
        for lo in range(0, len(x), 8192):
            part, sign, each = x[lo : lo + 8192], y[lo : lo + 8192], weight[lo : lo + 8192]
            inside = sign * (part @ w.astype(np.float32)) < 1
            xi = part[inside] * np.sqrt(each[inside, None]).astype(np.float32)
            gram += xi.T @ xi
            side += xi.T @ (sign * np.sqrt(each))[inside]
        new = np.linalg.solve(gram, side)
        if np.allclose(new, w, atol=1e-5):
            break
        w = new
    return w


def put_in(word: str, letters: list[str], rng: np.random.Generator, n: int) -> list[str]:
    """The word with one more letter, ``n`` times at each place within it."""
    return [word[:at] + letters[int(rng.integers(len(letters)))] + word[at:] for at in range(1, len(word)) for _ in range(n)]


def fit_sentences(rows: list[tuple[object, int, str]], s: Settings) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Codes, gains and bias of the machine fitted on labelled sentences (document, toxic, sentence).

    A sentence bears its document's label, yet only some sentences of a toxic document are toxic, and
    those by some of their words. So documents are bags: every word of a clean sentence is to lie
    below the margin, and of each toxic document the sentence with the highest margin, by its best
    word, above it. 1. Words that toxic sentences show far more often stand in at first. 2. Landmarks
    are the toxic words, spread out, and the clean words nearest to them; the machine is fitted in
    their Nyström space, on forms with a letter put in too. 3. Each toxic document's best words under the
    machine take over, and it is fitted again.
    """
    seen: tuple[Counter, Counter] = Counter(), Counter()
    bags: dict[object, set[str]] = {}
    clean: dict[object, set[str]] = {}
    for doc, toxic, text in rows:
        (bags if toxic else clean).setdefault(doc, set()).update(words(text))
    for own in clean.values():
        seen[0].update(own)
    for own in bags.values():
        seen[1].update(own)
    if not seen[0] or not seen[1]:
        return None
    base = len(bags) / (len(bags) + len(clean))

    def evidence(w: str) -> float:
        """Log-likelihood ratio of the word's own share of toxic documents to the share of all."""
        a, b = seen[1][w], seen[0][w]
        p = a / (a + b)
        return 0.0 if p <= max(base, 0.5) else a * np.log(p / base) + (b * np.log((1 - p) / (1 - base)) if b else 0.0)

    first = {w: evidence(w) for w, n in seen[1].items() if n > 1}
    positive = {w: seen[1][w] for w, e in first.items() if e >= s.evidence}
    if not positive:
        best = max(first.values(), default=0.0)
        positive = {w: seen[1][w] for w, e in first.items() if e == best > 0} or {w: 1 for w in seen[1].keys() - seen[0].keys()}
    if not positive:
        return None
    rng = np.random.default_rng(s.seed)
    letters = sorted({c for w in positive for c in w})
    given = dict(positive)
    vocabulary = sorted(seen[1].keys() | seen[0].keys())
    place = {w: k for k, w in enumerate(vocabulary)}
    everything = _features(vocabulary, s)
    at_clean = np.array([place[w] for w in seen[0]])
    machine = None
    for _ in range(s.fits):
        names = sorted(positive, key=lambda w: (-positive[w], w))
        at_toxic, count = np.array([place[w] for w in names]), np.array([positive[w] for w in names], float)
        negative = np.setdiff1d(at_clean, at_toxic)
        forms = [(w, f) for w in names if len(w) > 3 for f in put_in(w, letters, rng, s.put_in)]
        toxic, gapped = everything.take(at_toxic), _features([f for _, f in forms], s)
        marks = at_toxic[_choose_landmarks(toxic, count, s.landmarks * 2 // 3)]
        codes = np.unique(everything.take(marks).codes)
        columns = _dense(everything.take(marks), codes)
        close = np.concatenate([x.max(1, initial=0) for _, x in everything.blocks(codes, columns)])[negative]
        near = np.argsort(-close, kind="stable")[: s.landmarks // 3]
        marks = np.r_[marks, negative[near[close[near] > 0.2]]]
        land = everything.take(marks)
        codes = np.unique(land.codes)
        columns = _dense(land, codes)
        value, vector = np.linalg.eigh((columns.T @ columns).astype(np.float64))
        keep = value > 1e-4
        to_space = (columns @ (vector[:, keep] / np.sqrt(value[keep]))).astype(np.float32)  # codes to Nyström features
        signs = np.zeros(len(vocabulary), np.int8)
        signs[negative], signs[at_toxic] = -1, 1
        rows_of, held = [], []
        for features, sign in ((everything, signs), (gapped, np.ones(len(forms), np.int8))):
            for lo, x in features.blocks(codes, to_space):
                # clean words that no landmark knows are all alike; one row stands for them
                use = np.flatnonzero((sign[lo : lo + len(x)] > 0) | ((sign[lo : lo + len(x)] < 0) & (np.abs(x).max(1, initial=0) > 1e-3)))
                held.append(np.hstack([x[use], np.ones((len(use), 1), np.float32)]))
                rows_of.append(use + lo + (len(vocabulary) if features is gapped else 0))
        at = np.concatenate(rows_of)
        share = dict.fromkeys(names, 0.0)  # every toxic document weighs the same, dealt out to its toxic words
        for own in bags.values():
            for v in (mine := [v for v in own if v in share]):
                share[v] += 1 / len(mine) / len(bags)
        each = s.strict / len(bags)
        weight = np.full(len(vocabulary) + len(forms), each)
        weight[at_toxic] = [share[v] for v in names]
        weight[len(vocabulary) :] = [s.gaps * share[v] / s.put_in / (len(v) - 1) for v, _ in forms]
        left = len(negative) - (signs[at[at < len(vocabulary)]] < 0).sum()
        held.append(np.r_[np.zeros(to_space.shape[1]), 1][None].astype(np.float32))
        x = np.concatenate(held)
        del held
        y = np.r_[np.r_[signs, np.ones(len(forms), np.int8)][at], -1].astype(np.float64)
        w = _machine(x, y, np.r_[weight[at], max(1, left) * each], s)
        del x
        machine = codes, to_space.astype(np.float64) @ w[:-1], float(w[-1])
        margin = everything.margins(codes, machine[1]) + w[-1]
        found: Counter = Counter(given)
        for own in filter(None, bags.values()):
            best = max(own, key=lambda w: (margin[place[w]], w))
            found.update({w for w in own - given.keys() if w == best or (margin[place[w]] > 0 and w not in seen[0])})
        positive = {w: n for w, n in found.items() if w in given or s.odds * seen[0][w] <= n}
    return machine


class Scorer:
    """Margins of words, kept by word; a word that shares no subsequence with a landmark has the bias."""

    def __init__(self, codes: np.ndarray, gain: np.ndarray, bias: float, s: Settings) -> None:
        self.codes, self.gain, self.bias, self.s = codes, gain, bias, s
        self.table = np.zeros(1 << 20, bool)
        self.table[self._slot(codes)] = True
        self.kept: dict[str, float] = {}

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        return mix(codes) >> np.uint64(44)

    def learn(self, items: Iterable[str]) -> None:
        if len(self.kept) > 400_000:
            self.kept.clear()
        new = [w for w in items if w not in self.kept]
        margin = np.full(len(new), self.bias)
        for at, codes, weights in subsequences(new, self.s):
            hit = np.flatnonzero(self.table[self._slot(codes)].any(1))
            if not len(hit):
                continue
            own = codes[hit]
            order = np.argsort(own, 1)
            sorted_codes, w = np.take_along_axis(own, order, 1), weights[order]
            place = np.minimum(np.searchsorted(self.codes, sorted_codes), len(self.codes) - 1)
            gain = np.where(self.codes[place] == sorted_codes, self.gain[place], 0)
            first = np.ones(own.shape, bool)
            first[:, 1:] = sorted_codes[:, 1:] != sorted_codes[:, :-1]
            run = np.flatnonzero(first.ravel())
            square = np.add.reduceat(w.ravel(), run) ** 2
            norm = np.sqrt(np.bincount(run // own.shape[1], square, len(own)))
            found = self.bias + (w * gain).sum(1) / norm
            np.maximum.at(margin, at[hit], found)
        self.kept.update(zip(new, margin.tolist()))

    def margins(self, texts: list[str | None]) -> np.ndarray:
        """The two largest margins of each text's words, the bias where it has fewer, and the logarithm of the number of its words."""
        sets = [words(t) if t else set() for t in texts]
        self.learn(set().union(*sets))
        out = np.full((len(sets), 3), self.bias)
        for k, own in enumerate(sets):
            out[k, 2] = np.log1p(len(own))
            found = np.fromiter(map(self.kept.__getitem__, own), float, len(own))
            if len(found) > 1:
                out[k, :2] = np.partition(found, -2)[:-3:-1]
            elif len(found):
                out[k, 0] = found[0]
        return out


def _document_margins(docs: DataFrame, machine: tuple[np.ndarray, np.ndarray, float], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*machine, s)
        for batch in batches:
            found = scorer.margins(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in found.T.copy()), batch.column(1)], ["first", "second", "size", "toxic"])

    got = docs.select("text", "toxic").mapInArrow(score, "first double, second double, size double, toxic int").toArrow()
    return np.stack([got.column(k).to_numpy() for k in range(3)], 1), got.column(3).to_numpy()


def labelled_sentences(docs: DataFrame) -> DataFrame:
    """Of (doc_id, text, toxic), one row for each sentence: doc_id, toxic, h (a hash), sentence."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, toxic in zip(*(batch.column(k).to_pylist() for k in range(3))):
                own = sentences(text)
                if own:
                    n = len(own)
                    yield pa.RecordBatch.from_arrays([pa.array([doc] * n, pa.int64()), pa.array([toxic] * n, pa.int32()), pa.array([zlib.crc32(f"{doc}:{k}".encode()) for k in range(n)], pa.int64()), pa.array(own)], ["doc_id", "toxic", "h", "sentence"])

    return docs.select("doc_id", "text", "toxic").mapInArrow(cut_up, "doc_id long, toxic int, h long, sentence string")


def train_toxicity_model(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model | None:
    """Fit on the labelled rows of ``docs`` (doc_id, text), labels being (doc_id, toxic of 0 or 1).

    Of at most ``sample`` labelled documents a fifth is kept aside; at most ``sentences`` sentences of
    each label, those with the smallest hashes, of the rest reach the driver, where fit_sentences takes
    them. The largest margins of a document's words are calibrated on the documents kept aside.
    None without toxic and clean documents. Labels of a null doc_id or another value than 0 or 1 are left
    out; a doc_id with both labels is toxic; rows that repeat a doc_id are sampled together.
    """
    s = settings
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    named = docs.select(F.col("doc_id").cast("long"), "text").filter("text is not null")
    key = F.crc32(F.concat_ws(":", F.lit("sample"), "doc_id").cast("binary")).alias("h")
    chosen = rows.join(named.select("doc_id"), "doc_id", "left_semi").select("doc_id", "toxic", key).orderBy("h", "doc_id").limit(s.sample)
    with scratch(docs.sparkSession):
        sample = cut(named.join(F.broadcast(chosen), "doc_id"), "sample")  # at most ``sample`` slim rows
        aside = F.pmod("h", F.lit(5)) == 0
        parts = labelled_sentences(sample.filter(~aside))
        found = []
        for toxic in (0, 1):
            got = parts.filter(F.col("toxic") == toxic).orderBy("h", "doc_id", "sentence").limit(s.sentences).toArrow()
            found += [(doc, toxic, text) for doc, text in zip(got.column("doc_id").to_pylist(), got.column("sentence").to_pylist())]
        machine = fit_sentences(found, s)
        if machine is None:
            return None
        margin, toxic = _document_margins(sample.filter(aside), machine, s)
        if len(set(toxic.tolist())) < 2:
            margin, toxic = _document_margins(sample, machine, s)
    return Model(*machine, *_calibrate(margin, toxic), s)


def _inputs(margins: np.ndarray, floor: float) -> np.ndarray:
    return np.clip(np.maximum(margins, [-2, floor, np.log1p(4)]), -2, [3, 3, 9])


def probability(margins: np.ndarray, slope: np.ndarray, shift: float, floor: float) -> np.ndarray:
    """Of the margins of texts; a second one counts as ``floor`` at least. Of two texts with the same
    margins the shorter one is likelier toxic: a long one has more chances of a word that looks so."""
    return 1 / (1 + np.exp(-np.clip(_inputs(margins, floor) @ slope + shift, -30, 30)))


def _calibrate(margins: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Slopes, shift and floor of a logistic curve over margins and size, with smoothed targets; the floor is the median of clean texts."""
    n1, n0 = (toxic == 1).sum(), (toxic == 0).sum()
    floor = float(np.median(margins[toxic == 0, 1])) if n0 else -2.0
    target = np.where(toxic == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.hstack([_inputs(margins, floor), np.ones((len(margins), 1))])
    w = np.zeros(4)
    ridge = np.diag([0.5, 0.5, 0.5, 1e-3])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - target) + ridge @ w
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge
        w = w - np.clip(np.linalg.solve(hess, grad), -2, 2)
    return np.clip(w[:3], [0.1, 0, -2], [np.inf, np.inf, 0]), float(w[3]), floor


def score_toxicity(docs: DataFrame, model: Model | None, threshold: float = 0.3) -> DataFrame:
    """Rows (doc_id, score, predicted) for each row (doc_id, text) of ``docs``; whole texts are read.

    A text's score is that of its two most toxic words, given its number of words; a null or empty text,
    or one without words, has the score of a short text that shares nothing with a landmark. Without a model all scores are 0.
    Repeated rows and null doc_ids are scored each; an empty table gives no rows; other columns are
    ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer = Scorer(m.codes, m.gain, m.bias, m.settings) if m else None
        for whole in batches:
            for lo in range(0, len(whole), 512):
                batch = whole.slice(lo, 512)
                if scorer is None:
                    p = np.zeros(len(batch))
                else:
                    p = probability(scorer.margins(batch.column(1).to_pylist()), m.slope, m.shift, m.floor)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, score double, predicted int")
