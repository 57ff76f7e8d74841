"""Near-duplicate documents by consistent weighted sampling over TF-IDF shingles."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .shared import cut, scratch
from .textcodes import mix, shingle_sets

SKETCH_BITS, SKETCH_CHUNKS = 20, 64
MOST_FREQUENT = 1 << 21
BINS, STEPS = 256, 4


@dataclass(frozen=True)
class Settings:
    """width: words in a shingle. similarity: least weighted Jaccard similarity of a link.
    bands x rows samples are drawn. Weights fall from 1 + boost, for shingles in at most the share
    ``rare`` of all documents, with the logarithm of the share to 1 for a shingle in every document.
    The boost is small on purpose: the shingles of a large group of near copies are frequent just
    because of the group, and a plain IDF would push its members below the threshold. block:
    documents of a bucket compared in one block.
    """

    width: int = 5
    similarity: float = 0.8
    bands: int = 12
    rows: int = 4
    boost: float = 0.25
    rare: float = 1 / 256
    block: int = 256
    seed: int = 17


def document_frequencies(docs: DataFrame, width: int) -> tuple[np.ndarray, int]:
    """Hashed document frequencies of all shingles of all documents, and the number of documents.

    The sketch has 2**20 counters whatever the input, so merging and broadcasting it is bounded.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << SKETCH_BITS, np.int64), 0
        for batch in batches:
            n += len(batch)
            for _, codes, _, _, _ in shingle_sets(batch.column(0), width):
                total += np.bincount((codes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
        if n:
            parts = [zlib.compress(x.astype(np.uint32).tobytes(), 1) for x in np.split(total, SKETCH_CHUNKS)]
            chunk = np.arange(SKETCH_CHUNKS, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(chunk), pa.array(parts, pa.binary()), pa.array(np.where(chunk == 0, n, 0))], ["chunk", "counts", "n"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), np.uint32).astype(np.int64) for x in pdf["counts"])
        return pd.DataFrame({"chunk": pdf["chunk"][:1], "counts": [total.tobytes()], "n": [int(pdf["n"].sum())]})

    schema = "chunk int, counts binary, n long"
    found = docs.select("text").mapInArrow(count, schema).groupBy("chunk").applyInPandas(merge, schema).collect()
    table, n = np.zeros(1 << SKETCH_BITS, np.int64), 0
    for row in found:
        part = np.frombuffer(row["counts"], np.int64)
        table[row["chunk"] * len(part) : (row["chunk"] + 1) * len(part)] = part
        n += row["n"]
    return table, n


@dataclass(frozen=True)
class Weights:
    """codes, values: frequent shingles in order and their weights; heavy: counters that may hold one; rest: the weight of all others."""

    codes: np.ndarray
    values: np.ndarray
    heavy: np.ndarray
    rest: np.float32

    def of(self, codes: np.ndarray) -> np.ndarray:
        out = np.full(len(codes), self.rest, np.float32)
        at = np.flatnonzero(self.heavy[codes >> np.uint64(64 - SKETCH_BITS)])
        if len(at) and len(self.codes):
            place = np.minimum(np.searchsorted(self.codes, codes[at]), len(self.codes) - 1)
            hit = self.codes[place] == codes[at]
            out[at[hit]] = self.values[place[hit]]
        return out


def shingle_weights(docs: DataFrame, s: Settings) -> Weights:
    """Inverse document frequency weights, from exact frequencies over all documents.

    Only shingles in more than the share ``rare`` of the documents differ from the rest; there are at
    most (mean shingles of a document) / rare of them, whatever the number of documents. A first pass
    counts in a sketch, which never counts too little; a second one counts exactly the shingles whose
    counter reaches that share. Where documents are so long that more than 2**21 shingles could be so
    frequent, the share is raised to what keeps them within that number.
    """
    table, n_docs = document_frequencies(docs, s.width)
    rare = max(s.rare, table.sum() / max(n_docs, 1) / MOST_FREQUENT)
    least = rare * n_docs
    heavy = table >= max(least, 1)
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(heavy))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may, held, size = np.unpackbits(shared.value).astype(bool), [], 0

        def counted() -> pa.RecordBatch:
            u, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(_signed(u)), pa.array(n)], ["code", "n"])

        for batch in batches:
            for _, codes, _, _, _ in shingle_sets(batch.column(0), s.width):
                held.append(codes[may[codes >> np.uint64(64 - SKETCH_BITS)]])
                size += len(held[-1])
                if size > 1 << 21:
                    yield counted()
                    held, size = [], 0
        if size:
            yield counted()

    found = docs.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).filter(F.col("n") >= float(least)).toArrow()
    codes, n = found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy()
    order = np.argsort(codes)
    value = 1 + s.boost * np.clip(np.log(np.maximum(n_docs, 1) / n) / np.log(1 / min(rare, 0.5)), 0, 1)
    return Weights(codes[order], value[order].astype(np.float32), heavy, np.float32(1 + s.boost))


class Sampler:
    """Improved consistent weighted sampling.

    The random variables of a shingle (two gamma ones and a uniform one for each sample) come from
    tables of 2**16 entries that a hash of the shingle selects.
    """

    def __init__(self, samples: int, common: float, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.factor = rng.integers(1, 1 << 63, samples, np.uint64) * np.uint64(2) + np.uint64(1)
        self.r = rng.gamma(2, 1, (samples, 1 << 16)).astype(np.float32)
        self.log_c = np.log(rng.gamma(2, 1, (samples, 1 << 16))).astype(np.float32)
        self.beta = rng.random((samples, 1 << 16), np.float32)
        self.common = np.float32(common)
        self.t, self.a = self._draw(np.log(self.common), self.r, self.log_c, self.beta)

    @staticmethod
    def _draw(log_w, r, log_c, beta):
        t = np.floor(log_w / r + beta)
        return t, log_c - r * (t + 1 - beta)

    def signatures(self, codes: np.ndarray, weights: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """uint32 samples of the sets that lie one after another in codes; rows of empty sets are 0."""
        full = np.flatnonzero(sizes)
        out = np.zeros((len(sizes), len(self.factor)), np.uint32)
        if not len(full):
            return out
        spans = sizes[full]
        starts = np.cumsum(spans) - spans
        other = np.flatnonzero(weights != self.common)
        log_w = np.log(weights[other])
        for k, factor in enumerate(self.factor):
            entry = (codes * factor) >> np.uint64(48)
            a = self.a[k][entry]
            e = entry[other]
            t_other, a[other] = self._draw(log_w, self.r[k][e], self.log_c[k][e], self.beta[k][e])
            low = np.minimum.reduceat(a, starts)
            hit = np.flatnonzero(a == np.repeat(low, spans))
            at = hit[np.searchsorted(hit, starts)]
            t = self.t[k][entry[at]]
            place = np.minimum(np.searchsorted(other, at), max(len(other) - 1, 0))
            if len(other):
                t = np.where(other[place] == at, t_other[place], t)
            out[full, k] = mix(codes[at] + (t.astype(np.int64).astype(np.uint64) << np.uint64(1))).astype(np.uint32)
        return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sign_documents(docs: DataFrame, weights: Weights, s: Settings) -> DataFrame:
    """Rows (doc_id, h1, h2, sig, bands): a 128-bit hash of the word sequence, the samples and one
    key for each band; documents without a word are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = shared.value
        sampler = Sampler(s.bands * s.rows, float(idf.rest), s.seed)
        for batch in batches:
            ids = batch.column(0)
            for first, codes, times, sizes, whole in shingle_sets(batch.column(1), s.width):
                w = times.astype(np.float32) * idf.of(codes)
                sig = sampler.signatures(codes, w, sizes)
                keep = np.flatnonzero(sizes)
                if not len(keep):
                    continue
                sig, whole = sig[keep], whole[keep]
                parts = sig.reshape(len(sig), s.bands, s.rows).astype(np.uint64)
                keys = np.zeros((len(sig), s.bands), np.uint64) + np.arange(1, s.bands + 1, dtype=np.uint64)
                for k in range(s.rows):
                    keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, s.bands, dtype=np.int32)), pa.array(_signed(keys.ravel())))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(keep + first)), pa.array(_signed(whole[:, 0].copy())), pa.array(_signed(whole[:, 1].copy())), pa.array([x.tobytes() for x in sig], pa.binary()), bands],
                    ["doc_id", "h1", "h2", "sig", "bands"],
                )

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, h1 long, h2 long, sig binary, bands array<long>")


Weighted = tuple[np.ndarray, np.ndarray]


def _weighted_sets(column: pa.Array, idf: Weights, width: int) -> list[Weighted]:
    """Sorted codes and weights of each row of a text column."""
    out = []
    for _, codes, times, sizes, _ in shingle_sets(column, width):
        w = times * idf.of(codes).astype(np.float64)
        ends = np.cumsum(sizes)
        out += [(codes[e - n : e], w[e - n : e]) for e, n in zip(ends, sizes)]
    return out


def _similarity(a: Weighted, b: Weighted) -> float:
    """Weighted Jaccard similarity; 0 if a side is empty."""
    (ca, wa), (cb, wb) = a, b
    if not len(ca) or not len(cb):
        return 0.0
    at = np.minimum(np.searchsorted(cb, ca), len(cb) - 1)
    same = cb[at] == ca
    both = np.minimum(wa[same], wb[at[same]]).sum()
    return both / (wa.sum() + wb.sum() - both)


def verify_pairs(pairs: DataFrame, weights: Weights, s: Settings) -> DataFrame:
    """Of rows (a, b, text_a, text_b), the (a, b) at or over the threshold, with whole texts."""
    shared = pairs.sparkSession.sparkContext.broadcast(weights)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = shared.value
        for whole in batches:
            for i in range(0, len(whole), 256):
                batch = whole.slice(i, 256)
                sides = zip(_weighted_sets(batch.column(2), idf, s.width), _weighted_sets(batch.column(3), idf, s.width))
                keep = pa.array([_similarity(x, y) >= s.similarity - 1e-9 for x, y in sides], pa.bool_())
                yield batch.select([0, 1]).filter(keep)

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(verify, "a long, b long")


def _profile(weighted: Weighted) -> tuple[float, np.ndarray]:
    """Total weight of a set and its sums by hash bin, rounded up to quarters; what two sets share is at
    most what their bins share. Bins that overflow are all full, which says nothing and loses nothing."""
    codes, w = weighted
    bins = np.ceil(np.bincount((codes & np.uint64(BINS - 1)).astype(np.int64), w, BINS) * STEPS - 1e-6)
    return float(w.sum()), np.full(BINS, 65535, np.uint16) if bins.max() >= 65535 else bins.astype(np.uint16)


def profile_documents(texts: DataFrame, weights: Weights, s: Settings) -> DataFrame:
    """Rows (doc_id, total, bins): see _profile."""
    shared = texts.sparkSession.sparkContext.broadcast(weights)

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_profile(x) for x in _weighted_sets(batch.column(1), shared.value, s.width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.float64()), pa.array([x.tobytes() for _, x in found], pa.binary())], ["doc_id", "total", "bins"])

    return texts.select("doc_id", "text").mapInArrow(profile, "doc_id long, total double, bins binary")


def _open_pairs(part: pa.Table, total: np.ndarray, bins: np.ndarray, s: Settings) -> np.ndarray:
    """Rows (x, y) of pairs of a block that may link, likeliest first: of different labels, not met in a
    band before, and neither their totals nor their bins keep them below the threshold."""
    i, j, band = (part.column(k)[0].as_py() for k in (1, 2, 4))
    ids, labels = part.column(5).to_numpy(), part.column(6).to_numpy()
    sig = np.frombuffer(b"".join(part.column(7).to_pylist()), np.uint32).reshape(len(part), -1)
    side, full = part.column(3).to_numpy() == i, bins[:, 0] == 65535
    left = np.flatnonzero(side)
    right = left if i == j else np.flatnonzero(~side)
    least, found = s.similarity - 1e-9, [np.zeros((0, 3))]
    for x in left:
        y = right[(labels[right] != labels[x]) & ((i != j) | (ids[right] > ids[x]))]
        y = y[np.minimum(total[y], total[x]) >= least * np.maximum(total[y], total[x])]
        y = y[~(sig[y] == sig[x]).reshape(len(y), s.bands, s.rows).all(2)[:, :band].any(1)]
        both = np.minimum(bins[y], bins[x]).sum(1, dtype=np.int64) / STEPS
        both = np.minimum(np.where(full[x] | full[y], np.inf, both), np.minimum(total[y], total[x]))
        bound = both / (total[x] + total[y] - both)
        ok = bound >= least
        found.append(np.stack([bound[ok], np.full(ok.sum(), x), y[ok]], 1))
    pairs = np.concatenate(found)
    return pairs[np.argsort(-pairs[:, 0], kind="stable"), 1:].astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first three columns, of two rows at least."""
    rest: list[pa.RecordBatch] = []
    for whole in batches:
        for lo in range(0, len(whole), 2048):
            rows = pa.Table.from_batches([*rest, whole.slice(lo, 2048)])
            new = np.zeros(len(rows), bool)
            for k in range(3):
                x = rows.column(k).to_numpy()
                new[1:] |= x[1:] != x[:-1]
            edges = [0, *np.flatnonzero(new).tolist()]
            for a, b in zip(edges, edges[1:]):
                if b - a > 1:
                    yield rows.slice(a, b - a).combine_chunks()
            rest = rows.slice(edges[-1]).to_batches()
    if rest and sum(map(len, rest)) > 1:
        yield pa.Table.from_batches(rest).combine_chunks()


MEMBER = ["bucket", "i", "j", "chunk", "band", "doc_id", "label", "sig"]


def _mixed_links(members: DataFrame, texts: DataFrame, weights: Weights, s: Settings) -> DataFrame:
    """Rows (bucket, n, band, doc_id, label, sig) of mixed buckets to verified links (a, b) between labels.

    A bucket is dealt out as blocks of two chunks of documents, so that no task holds a whole one; a
    pair that meets in many bands is looked at in the first of them only. Slim rows go first: ids,
    samples and profiles, which show what pairs cannot reach the threshold. The texts of those
    documents that are left in a block follow, and every pair of different labels is verified, unless
    links found before in the block join the two already. Pairs are not written out.
    """
    session = members.sparkSession
    shared = session.sparkContext.broadcast(weights)
    profiles = cut(profile_documents(texts.join(members.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi"), weights, s), "profiles")
    chunks = F.ceil(F.col("n") / s.block).cast("int")
    parts = members.withColumn("k", chunks).withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("k")).cast("int")).hint("merge").join(profiles, "doc_id")
    parts = parts.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumns({"i": F.least("chunk", "o"), "j": F.greatest("chunk", "o")})
    parts = parts.select(*MEMBER, "total", "bins").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _blocks(batches):
            bins = np.frombuffer(b"".join(part.column(9).to_pylist()), np.uint16).reshape(len(part), BINS)
            if len(open_ := np.unique(_open_pairs(part, part.column(8).to_numpy(), bins, s))):
                yield from part.select(MEMBER).take(pa.array(open_)).to_batches()

    met = cut(parts.mapInArrow(sift, parts.select(*MEMBER).schema), "met")
    full = met.hint("merge").join(texts.select("doc_id", "text"), "doc_id").select(*MEMBER, "text")
    full = full.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _blocks(batches):
            ids, labels = part.column(5).to_numpy(), part.column(6).to_numpy()
            sets = _weighted_sets(part.column(8).combine_chunks(), shared.value, s.width)
            total, bins = zip(*map(_profile, sets))
            root = {x: x for x in labels.tolist()}

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            links = []
            for x, y in _open_pairs(part, np.array(total), np.stack(bins), s).tolist():
                p, q = find(int(labels[x])), find(int(labels[y]))
                if p != q and _similarity(sets[x], sets[y]) >= s.similarity - 1e-9:
                    root[max(p, q)] = min(p, q)
                    links.append((int(ids[x]), int(ids[y])))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], ["a", "b"])

    return full.mapInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Group the rows (doc_id, text) of ``docs``; one row a document: doc_id, class_id, component_id, n_copies, kept.

    Documents with the same word sequence (A-Z lower-cased, split at white space) form a class, named
    by its smallest doc_id. Two classes are linked when the weighted Jaccard similarity of their
    shingle multisets is at least ``settings.similarity``; weights are term frequency times inverse
    document frequency over all documents. component_id is the smallest doc_id reachable by links;
    kept holds for that document alone.

    1. samples by improved consistent weighted sampling, cut into bands;
    2. in each bucket of a band every class is verified against the one class with most copies;
    3. buckets that still hold several components are compared in blocks: every pair of different
       components that could reach the threshold is verified as well.

    A pair at the threshold shares a bucket with probability 1 - (1 - 0.8**4)**12 = 0.998; nothing
    else is left to chance.

    A null or empty text, or one of white space, is a class of its own without links. A text of
    fewer words than a shingle has one shingle. Rows with a null doc_id are left out; rows that
    repeat a doc_id give one row each but count as one document here (smallest hash of its texts).
    An empty table gives no rows; other columns are ignored.
    """
    with scratch(docs.sparkSession) as keep:
        return keep(_grouped(docs.select("doc_id", "text").filter("doc_id is not null"), settings), "groups")


def _grouped(docs: DataFrame, s: Settings) -> DataFrame:
    weights = shingle_weights(docs, s)
    signed = cut(sign_documents(docs, weights, s), "signed")
    classes = cut(signed.groupBy("h1", "h2").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n_copies")), "classes")
    # a repeated doc_id with different texts belongs to the class of its smallest hash
    of_doc = signed.groupBy("doc_id").agg(F.min(F.struct("h1", "h2")).alias("h")).select("doc_id", "h.h1", "h.h2")
    of_doc = cut(of_doc.join(classes, ["h1", "h2"]).select("doc_id", "class_id", "n_copies"), "of_doc")
    first = signed.groupBy("doc_id").agg(F.min(F.struct("h1", "h2", "sig", "bands")).alias("x")).select("doc_id", "x.sig", "x.bands")
    reps = cut(first.join(classes.select(F.col("class_id").alias("doc_id"), "n_copies").distinct(), "doc_id"), "reps")

    banded = cut(reps.select("doc_id", "n_copies", F.posexplode("bands").alias("band", "bucket")), "banded")
    centre = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("n_copies", (-F.col("doc_id")).alias("m"))).alias("c"))
    centre = cut(centre.filter("n > 1").select("bucket", "n", (-F.col("c.m")).alias("centre")), "centre")
    members = cut(banded.join(centre, "bucket").select("bucket", "n", "band", "doc_id", "centre"), "members")

    # the joins on texts are merged at every size; which side is small differs from corpus to corpus
    texts = docs.join(members.select("doc_id").distinct().hint("merge"), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    texts = cut(texts, "texts")
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    star = members.filter("doc_id <> centre").select(F.col("doc_id").alias("a"), F.col("centre").alias("b")).distinct()
    links = cut(verify_pairs(star.hint("merge").join(left, "a").hint("merge").join(right, "b"), weights, s), "links")

    label = connected_components(links, "a", "b").withColumnsRenamed({"node": "doc_id", "component": "label"})
    labelled = cut(members.join(label, "doc_id", "left").select("bucket", "n", "band", "doc_id", F.coalesce("label", "doc_id").alias("label")), "labelled")
    mixed = cut(labelled.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("bucket"), "mixed")
    rest = cut(labelled.join(mixed, "bucket").hint("merge").join(reps.select("doc_id", "sig"), "doc_id"), "rest")
    links = links.union(cut(_mixed_links(rest, texts, weights, s), "links"))

    component = connected_components(links, "a", "b").withColumnsRenamed({"node": "class_id", "component": "component_id"})
    of_doc = of_doc.join(component, "class_id", "left").select("doc_id", "class_id", F.coalesce("component_id", "class_id").alias("component_id"), "n_copies")
    out = docs.select("doc_id").join(of_doc, "doc_id", "left")
    return out.select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        (F.coalesce("component_id", "doc_id") == F.col("doc_id")).alias("kept"),
    )
