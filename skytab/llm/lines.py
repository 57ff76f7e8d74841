"""Reversible line dedup: exact reference counts of line keys behind sharded cuckoo filters."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut
from .textcodes import mix

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLOTS = 4


@dataclass(frozen=True)
class Settings:
    """min_chars: code points of a key that counts. min_docs: documents from which on it is dropped.
    shard_keys: keys a shard is planned for. piece: postings that meet a copy of a shard's filter at
    once, so that a shard with a very common line is dealt out. load: of a new filter."""

    min_chars: int = 20
    min_docs: int = 3
    shard_keys: int = 20_000
    piece: int = 50_000
    load: float = 0.85


class Cuckoo:
    """Cuckoo filter of 64-bit keys: buckets of four 16-bit fingerprints, 0 for a free slot.

    A key lies in one of two buckets; the second follows from the first and the fingerprint, so
    that a fingerprint can be moved, and removed, without its key. What no longer fits goes to
    ``spare``, an exact list, so that no key is ever missed.
    """

    def __init__(self, buckets: int) -> None:
        self.slots = np.zeros((1 << max(1, int(buckets - 1).bit_length()), SLOTS), np.uint16)
        self.spare: list[tuple[int, int]] = []

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix(keys.astype(np.int64).view(np.uint64))
        mask = np.uint64(len(self.slots) - 1)
        mark = ((h >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)
        first = h & mask
        return mark, first.astype(np.int64), self._other(first, mark).astype(np.int64)

    def _other(self, bucket, mark):
        return (bucket ^ mix(mark.astype(np.uint64))) & np.uint64(len(self.slots) - 1)

    def insert(self, keys: np.ndarray) -> None:
        """Add keys, each of them once; a key added twice must be removed twice."""
        for mark, a, b in zip(*(x.tolist() for x in self.places(keys))):
            for n in range(200):
                for bucket in (a, b):
                    free = np.flatnonzero(self.slots[bucket] == 0)
                    if len(free):
                        self.slots[bucket, free[0]] = mark
                        break
                else:
                    slot = (mark + n) % SLOTS
                    mark, self.slots[b, slot] = int(self.slots[b, slot]), mark
                    a, b = b, int(self._other(np.array([b], np.uint64), np.array([mark]))[0])
                    continue
                break
            else:
                self.spare.append((mark, a))

    def remove(self, keys: np.ndarray) -> None:
        """Take out keys that were added before."""
        for mark, a, b in zip(*(x.tolist() for x in self.places(keys))):
            for bucket in (a, b):
                hit = np.flatnonzero(self.slots[bucket] == mark)
                if len(hit):
                    self.slots[bucket, hit[0]] = 0
                    break
            else:
                here = next(x for x in self.spare if x in ((mark, a), (mark, b)))
                self.spare.remove(here)

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key may be inside; False is certain."""
        mark, a, b = self.places(keys)
        hit = (self.slots[a] == mark[:, None]).any(1) | (self.slots[b] == mark[:, None]).any(1)
        for m, bucket in self.spare:
            hit |= (mark == m) & ((a == bucket) | (b == bucket))
        return hit

    def to_bytes(self) -> bytes:
        spare = np.array(self.spare, np.int64).reshape(-1, 2)
        return np.array([len(self.slots), len(spare)], np.int64).tobytes() + self.slots.tobytes() + spare.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Cuckoo:
        n, m = np.frombuffer(data, np.int64, 2)
        out = cls.__new__(cls)
        out.slots = np.frombuffer(data, np.uint16, n * SLOTS, 16).reshape(n, SLOTS).copy()
        out.spare = [tuple(x) for x in np.frombuffer(data, np.int64, 2 * m, 16 + n * SLOTS * 2).reshape(m, 2).tolist()]
        return out


def line_key(line: Column) -> Column:
    """White space off both ends, A-Z lower-cased."""
    return F.translate(F.trim(line, F.lit(" \t\n\x0b\x0c\r")), UPPER, LOWER)


def document_keys(docs: DataFrame, s: Settings) -> DataFrame:
    """Postings (doc_id, key): the 128-bit digests of each document's countable lines, each once."""
    keys = F.transform(F.split("text", "\n", -1), line_key)
    keys = F.array_distinct(F.filter(keys, lambda k: F.length(k) >= s.min_chars))
    keys = docs.filter("doc_id is not null and text is not null").select("doc_id", F.explode(keys).alias("key"))
    return keys.select("doc_id", F.unhex(F.md5("key")).alias("key")).distinct()


def count_references(postings: DataFrame) -> DataFrame:
    """Exact reference counts: (key, n_docs, last_doc)."""
    return postings.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), "key"), F.lit(shards)).cast("int").alias("shard")


FILTERS = "shard int, cuckoo binary, spare long"


def _refilter(filters: DataFrame, change: DataFrame, shards: int, s: Settings) -> DataFrame:
    """Filters after the changes (key, added): keys come in where added, go out otherwise."""

    def update(old: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        if len(old):
            out = Cuckoo.from_bytes(bytes(old["cuckoo"].iloc[0]))
        else:
            out = Cuckoo(int(max(len(pdf), s.shard_keys / 64) / SLOTS / s.load) + 1)
        out.remove(pdf["mark"][~pdf["added"]].to_numpy(np.int64))
        out.insert(pdf["mark"][pdf["added"]].to_numpy(np.int64))
        shard = (old if len(old) else pdf)["shard"].iloc[0]
        return pd.DataFrame({"shard": [shard], "cuckoo": [out.to_bytes()], "spare": [len(out.spare)]})

    change = change.select(_shard(shards), F.xxhash64("key").alias("mark"), "added")
    return filters.groupBy("shard").cogroup(change.groupBy("shard")).applyInPandas(update, FILTERS)


@dataclass(frozen=True)
class LineStore:
    """State of incremental line dedup, as tables: postings (doc_id, key), counts (key, n_docs,
    last_doc) and filters (shard, cuckoo, spare) over the keys that are to be dropped. A filter that
    no longer takes a key is built again, larger, from the counts."""

    postings: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    settings: Settings

    def insert(self, docs: DataFrame) -> LineStore:
        """The store with the lines of documents it does not hold yet; those it holds stay as they are."""
        new = document_keys(docs, self.settings).join(self.postings.select("doc_id").distinct(), "doc_id", "left_anti")
        new = cut(new, "new")
        add = count_references(new).withColumnsRenamed({"n_docs": "n", "last_doc": "last"})
        merged = self.counts.join(add, "key", "full_outer")
        merged = merged.select("key", F.coalesce("n_docs", F.lit(0)).alias("before"), (F.coalesce("n_docs", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n_docs"), F.greatest("last_doc", "last").alias("last_doc"))
        return self._after(cut(self.postings.unionByName(new), "postings"), cut(merged, "counts"))

    def delete(self, doc_ids: DataFrame) -> LineStore:
        """The store without the documents (doc_id): counts fall and dropped lines come back."""
        gone = doc_ids.select("doc_id").distinct()
        rest = cut(self.postings.join(gone, "doc_id", "left_anti"), "postings")
        touched = self.postings.join(gone, "doc_id", "left_semi").select("key").distinct()
        again = count_references(rest.join(touched, "key", "left_semi")).withColumnsRenamed({"n_docs": "n", "last_doc": "last"})
        merged = self.counts.join(touched.withColumn("touched", F.lit(True)), "key", "left").join(again, "key", "left")
        merged = merged.select(
            "key",
            F.col("n_docs").alias("before"),
            F.when(F.col("touched"), F.coalesce("n", F.lit(0))).otherwise(F.col("n_docs")).alias("n_docs"),
            F.when(F.col("touched"), F.col("last")).otherwise(F.col("last_doc")).alias("last_doc"),
        )
        return self._after(rest, cut(merged, "counts"))

    def _after(self, postings: DataFrame, merged: DataFrame) -> LineStore:
        least = self.settings.min_docs
        change = merged.filter((F.col("before") >= least) != (F.col("n_docs") >= least)).select("key", (F.col("n_docs") >= least).alias("added"))
        filters = cut(_refilter(self.filters, change, self.shards, self.settings), "filters")
        full = filters.filter("spare > 0").select("shard")
        if not full.isEmpty():
            keys = merged.filter(F.col("n_docs") >= least).select("key", F.lit(True).alias("added"), _shard(self.shards)).join(full, "shard", "left_semi")
            again = _refilter(filters.limit(0), keys, self.shards, self.settings)
            filters = cut(filters.filter("spare = 0").union(again), "filters")
        return LineStore(postings, merged.filter("n_docs > 0").drop("before"), filters, self.shards, self.settings)

    def droppable(self, postings: DataFrame) -> DataFrame:
        """Of postings, those (doc_id, key) whose lines go: what the filters let through, joined with the exact counts."""
        frequent = cut(self.counts.filter(F.col("n_docs") >= self.settings.min_docs), "frequent")
        return cut(self.probe(postings), "found").join(frequent, "key").filter("doc_id < last_doc").select("doc_id", "key")

    def probe(self, postings: DataFrame) -> DataFrame:
        """The postings whose key may be in the filter of its shard. Filters go to the tasks that hold their
        shard's postings, ahead of them; a shard of many postings is dealt out in pieces, each with a copy."""
        s = self.settings
        marked = postings.select("doc_id", "key", _shard(self.shards), F.xxhash64("key").alias("mark"))
        pieces = cut(marked.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / s.piece).cast("int").alias("pieces")), "pieces")
        marked = marked.join(pieces, "shard").withColumn("piece", F.pmod(F.xxhash64("doc_id"), F.col("pieces")).cast("int"))
        copies = self.filters.join(pieces, "shard").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        blank = F.lit(None)
        rows = copies.select("shard", "piece", "cuckoo", blank.cast("long").alias("doc_id"), blank.cast("binary").alias("key"), blank.cast("long").alias("mark"))
        rows = rows.union(marked.select("shard", "piece", blank.cast("binary").alias("cuckoo"), "doc_id", "key", "mark"))
        rows = rows.repartition("shard", "piece").sortWithinPartitions("shard", "piece", F.col("cuckoo").isNull())

        def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place, held = None, None
            for batch in batches:
                at = np.stack([batch.column(k).to_numpy() for k in (0, 1)], 1)
                edges = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1).tolist(), len(batch)]
                for a, b in zip(edges, edges[1:]):
                    if b == a:
                        continue
                    part, here = batch.slice(a, b - a), tuple(at[a].tolist())
                    if here != place:
                        place, held = here, None
                    if part.column(2)[0].is_valid:
                        held = Cuckoo.from_bytes(part.column(2)[0].as_py())
                        part = part.slice(1)
                    if held is not None and len(part):
                        yield part.select([3, 4]).filter(pa.array(held.may_hold(part.column(5).to_numpy())))

        return rows.mapInArrow(test, postings.schema)


def line_store(docs: DataFrame, settings: Settings = Settings()) -> LineStore:
    """A store filled with all of ``docs``; the number of shards follows the number of keys."""
    postings = cut(document_keys(docs, settings), "postings")
    counts = cut(count_references(postings), "counts")
    frequent = counts.filter(F.col("n_docs") >= settings.min_docs).select("key", F.lit(True).alias("added"))
    shards = max(1, -(-frequent.count() // settings.shard_keys))
    none = docs.sparkSession.createDataFrame([], FILTERS)
    return LineStore(postings, counts, cut(_refilter(none, frequent, shards, settings), "filters"), shards, settings)


_ASCII_LOWER = {ord(a): b for a, b in zip(UPPER, LOWER)}


def dedup_lines(docs: DataFrame, settings: Settings = Settings(), store: LineStore | None = None) -> DataFrame:
    """``docs`` (doc_id, text and any others) with text rid of repeated lines; n_lines (before) and n_dropped follow.

    A text is cut at line feeds (null or empty: one empty line). A line's key is the line without
    white space at its ends, A-Z lower-cased. A key of at least min_chars code points that is found
    in at least min_docs documents loses all its lines except those of the largest doc_id that holds
    it. store: a LineStore that covers ``docs``; by default one of ``docs`` alone.

    Rows with a null doc_id keep all their lines; rows that repeat a doc_id count as one document and
    are treated alike. An empty table gives no rows; columns named n_lines or n_dropped are replaced.
    """
    own = store or line_store(docs, settings)
    postings = own.postings if store is None else document_keys(docs, own.settings)
    drop = own.droppable(postings).groupBy("doc_id").agg(F.collect_list("key").alias("__drop"))
    held = docs.drop("n_lines", "n_dropped").join(drop, "doc_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    least = own.settings.min_chars

    @F.pandas_udf("text string, n_dropped long")
    def strip(text: pd.Series, drop: pd.Series) -> pd.DataFrame:
        out, n = [], []
        for t, keys in zip(text, drop):
            if t is None:
                out.append(None)
                n.append(0)
                continue
            gone, lines, kept = set(keys), t.split("\n"), []
            for line in lines:
                key = line.strip(" \t\n\x0b\x0c\r").translate(_ASCII_LOWER)
                if len(key) < least or hashlib.md5(key.encode()).digest() not in gone:
                    kept.append(line)
            out.append("\n".join(kept))
            n.append(len(lines) - len(kept))
        return pd.DataFrame({"text": out, "n_dropped": n})

    # texts that keep all lines do not go to Python
    less = strip(F.when(F.col("__drop").isNotNull(), F.col("text")), F.col("__drop"))
    held = held.withColumn("__less", less).withColumn("n_lines", F.size(F.split("text", "\n", -1)).cast("long"))
    text = F.when(F.col("__drop").isNotNull(), F.col("__less.text")).otherwise(F.col("text"))
    n_dropped = F.when(F.col("__drop").isNotNull(), F.col("__less.n_dropped")).otherwise(F.lit(0)).cast("long")
    kept = [text.alias("text") if c == "text" else F.col(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return held.select(*kept, "n_lines", n_dropped.alias("n_dropped"))
