"""Token ids of documents, packing into sequences, and shards in training order."""

from __future__ import annotations

import base64
import functools
import json
import math
import re
import uuid
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, shared_dir
from .textcodes import mix

END = 0  # the id after each document
LONG = 1 << 16  # characters from which on ids come as an array, slower but without an object for each
WIDEST = 10_000  # characters of white space in a row that the rank form is given


@functools.lru_cache(maxsize=2)
def encoder(name: str):
    """The byte-level BPE of ``name`` (without suffix) of the public tokenizer files, in the form of ranks."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=2)
def json_encoder(name: str):
    """The same vocabulary in the .json form, which defines the ids."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))


@functools.lru_cache(maxsize=2)
def added_tokens(name: str) -> dict[str, int]:
    """The tokens that the .json form has beside its vocabulary; a text may hold them. They stand ahead of the
    vocabulary in the file, which is not loaded for them."""
    import public_tokenizers

    with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as f:
        text = f.read()
    found, _ = json.JSONDecoder().raw_decode(text, re.search(r'"added_tokens"\s*:\s*', text).end())
    return {t["content"]: t["id"] for t in found}


@functools.lru_cache(maxsize=2)
def sentence_ends(name: str) -> np.ndarray:
    """For each id, whether it ends a sentence or a line; added tokens do."""
    words = {i: w for w, i in encoder(name)._mergeable_ranks.items()}
    ends = np.zeros(max([*words, *added_tokens(name).values()]) + 1, bool)
    for i, w in words.items():
        ends[i] = b"\n" in w or (w.strip() != b"" and not w.strip(b" .!?"))
    ends[list(added_tokens(name).values())] = True
    return ends


def _wide(text: str) -> bool:
    return len(text) > WIDEST and any(m.end() - m.start() > WIDEST for m in re.finditer(r"\s{2,}", text))


def token_ids(text: str | None, name: str) -> np.ndarray:
    """uint32 ids of a text as the .json form gives them by default, and the id that ends a document.

    The rank form gives the same ids in a fifth of the time, but it knows no added tokens, and its
    pattern overflows the stack on very long white space; such texts go to the .json form itself.
    """
    if text and (any(t in text for t in added_tokens(name)) or _wide(text)):
        ids = json_encoder(name).encode(text, add_special_tokens=False).ids
    elif text and len(text) > LONG:
        return np.append(encoder(name).encode_to_numpy(text, disallowed_special=()), np.uint32(END))
    else:
        ids = encoder(name).encode_ordinary(text or "")
    return np.array([*ids, END], np.uint32)


@dataclass(frozen=True)
class Packing:
    """length: tokens of a full sequence. sentence_cut, inner_cut: what cutting a document at a
    sentence end, or within an overlong sentence, costs in tokens of padding. block: tokens that one
    run of the dynamic program spans; its last sequence is opened again by the next run."""

    tokenizer: str = "byte_bpe_50k"
    length: int = 1024
    sentence_cut: int = 2
    inner_cut: int = 48
    block: int = 1 << 17


def choose_cuts(ends: np.ndarray, costs: np.ndarray, length: int) -> list[int]:
    """Ends of the sequences over ascending boundaries ``ends`` with ``costs``; the last end is one.

    Least sum of padding and costs: padding is what a sequence lacks of ``length``, none at a power
    of two. With best[j] the least cost up to boundary j, padding is linear in the boundaries, so the
    least of best[j] + ends[j] in reach, kept in a monotone queue, gives best[i] in constant time.
    """
    at, cost = [0, *ends.tolist()], [0, *costs.tolist()]
    place = {p: i for i, p in enumerate(at)}
    powers = [1 << k for k in range(int(math.log2(length))) if 1 << k >= 32]
    best, back = [0] * len(at), [0] * len(at)
    queue = deque([0])
    for i in range(1, len(at)):
        here = at[i]
        while at[queue[0]] < here - length:
            queue.popleft()
        j = queue[0]
        least, arg = best[j] + at[j] + length - here, j
        for p in powers:
            j = place.get(here - p, -1)
            if j >= 0 and best[j] < least:
                least, arg = best[j], j
        best[i], back[i] = least + cost[i], arg
        key = best[i] + here
        while queue and best[queue[-1]] + at[queue[-1]] >= key:
            queue.pop()
        queue.append(i)
    cuts, i = [], len(at) - 1
    while i:
        cuts.append(at[i])
        i = back[i]
    return cuts[::-1]


def _boundaries(docs: list[np.ndarray], skip: int, ends_sentence: np.ndarray, s: Packing) -> tuple[np.ndarray, np.ndarray]:
    """Boundaries of joined documents and their costs; ``skip``: ids of the first that are gone."""
    pos, cost, base = [], [], 0
    for k, ids in enumerate(docs):
        ids = ids[skip:] if k == 0 else ids
        own = np.flatnonzero(ends_sentence[ids[:-1]]) + 1
        own = own[own < len(ids)]
        edges = np.concatenate([[0], own, [len(ids)]])
        wide = np.flatnonzero(np.diff(edges) > s.length)
        inner = [np.arange(edges[w] + 64, edges[w + 1], 64) for w in wide]
        p = np.concatenate([own, [len(ids)], *inner]).astype(np.int64)
        c = np.concatenate([np.full(len(own), s.sentence_cut), [0], *(np.full(len(x), s.inner_cut) for x in inner)]).astype(np.int64)
        order = np.argsort(p, kind="stable")
        pos.append(p[order] + base)
        cost.append(c[order])
        base += len(ids)
    return np.concatenate(pos), np.concatenate(cost)


def pack_documents(docs: DataFrame, settings: Packing = Packing()) -> DataFrame:
    """Pack all rows (doc_id, text), in the order they are stored, into sequences of at most ``length`` ids.

    One row for each piece: doc_id, start (its document's ids before it), length, ids (uint32, little
    endian), doc_tokens, sequence_id, offset in the sequence, sequence_length. Every id, the one that
    ends a document too, lies in one piece; documents and pieces keep their order. Cuts lie at ends of
    documents or sentences, within a sentence only if it is longer than a sequence.

    Each input partition is packed by itself, as a stream: a block of documents at a time is in
    memory, and only the last sequence of a partition is filled up. No shuffle takes place; ids of
    sequences name the partition and the place in it, so a task that runs again gives the same rows.

    A null or empty text is the end id alone; null doc_ids are kept; repeated rows are packed each; an
    empty table gives no rows; other columns are ignored.
    """
    s = settings

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends_sentence = sentence_ends(s.tokenizer)
        sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        held: list[np.ndarray] = []
        owner: list[int | None] = []
        skip, size = 0, 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, owner, skip, size, sequence
            cuts = choose_cuts(*_boundaries(held, skip, ends_sentence, s), s.length)
            rows: list[tuple] = []
            k, at = 0, skip  # the next document and its first id not yet packed
            done = 0
            for end in cuts if last else cuts[:-1]:
                offset, whole = 0, end - done
                while done < end:
                    n = min(len(held[k]) - at, end - done)
                    rows.append((owner[k], at, n, held[k][at : at + n].tobytes(), len(held[k]), sequence, offset, whole))
                    offset, done, at = offset + n, done + n, at + n
                    if at == len(held[k]):
                        k, at = k + 1, 0
                sequence += 1
            held, owner, skip, size = held[k:], owner[k:], at, size - done
            for lo in range(0, len(rows), 4096):
                columns = list(zip(*rows[lo : lo + 4096]))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], NAMES)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.append(token_ids(text.as_py(), s.tokenizer))
                owner.append(doc_id)
                size += len(held[-1])
                if size >= s.block:
                    yield from flush(False)
        if held:
            yield from flush(True)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pack, SCHEMA)


NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_length"]
RECORD_END = "\0\0"  # after each record of a shard: the end id
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_length long"


@dataclass(frozen=True)
class Order:
    """length: ids of a sequence, two bytes each. key: of the permutation. shard: sequences of a
    shard file. tasks: range partitions at most, each of as many shards as that takes."""

    tokenizer: str = "byte_bpe_50k"
    length: int = 1024
    key: int = 0x5DEECE66D
    rounds: int = 6
    shard: int = 8192
    tasks: int = 100_000

    @property
    def stride(self) -> int:
        """Bytes from one sequence of a shard to the next: its ids and one end id that closes the record."""
        return 2 * self.length + len(RECORD_END)


def permute(index: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """A keyed permutation of 0..n-1: a balanced Feistel network over the next even number of bits,
    walked along its cycle until the value is below n."""
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    mask = np.uint64((1 << half) - 1)
    keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))
    out = np.asarray(index, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def token_sequences(docs: DataFrame, settings: Order = Order()) -> DataFrame:
    """Rows (part, place, n_tokens, crc32, doc_ids, payload): the ids of the documents of each input
    partition one after another, cut every ``length`` ids; the last sequence is filled up with the end
    id. payload: uint16, little endian, always 2 * length bytes. A null or empty text is the end id;
    repeated rows and null doc_ids are written each; an empty table gives no rows; other columns are
    ignored. Raises ValueError for a vocabulary whose ids two bytes do not hold."""
    s = settings
    if len(sentence_ends(s.tokenizer)) > 1 << 16:
        raise ValueError(f"ids of {s.tokenizer} do not fit into two bytes")

    def chop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        place, size, held = 0, 0, []

        def flush(n: int) -> pa.RecordBatch:
            nonlocal held, place, size
            ids = np.concatenate([x for _, x in held])
            ends = np.cumsum([len(x) for _, x in held])
            full = ids[: n * s.length]
            used = np.minimum(s.length, len(ids) - np.arange(n) * s.length)
            full = np.pad(full, (0, n * s.length - len(full))).astype("<u2").reshape(n, s.length)
            owners = []
            for k in range(n):
                a, b = np.searchsorted(ends, k * s.length, "right"), np.searchsorted(ends, min((k + 1) * s.length, len(ids)), "left")
                owners.append([held[i][0] for i in range(a, b + 1)])
            rest = ids[n * s.length :]
            if len(rest):  # what remains keeps its documents
                a = int(np.searchsorted(ends, n * s.length, "right"))
                cut_at = n * s.length - (int(ends[a - 1]) if a else 0)
                held = [(held[a][0], held[a][1][cut_at:]), *held[a + 1 :]]
            else:
                held = []
            size = len(rest)
            places = np.arange(place, place + n)
            place += n
            rows = [x.tobytes() for x in full]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part, np.int32)), pa.array(places), pa.array(used.astype(np.int64)), pa.array([zlib.crc32(x) for x in rows], pa.int64()), pa.array(owners, pa.list_(pa.int64())), pa.array(rows, pa.binary())],
                ["part", "place", "n_tokens", "crc32", "doc_ids", "payload"],
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.append((doc_id, token_ids(text.as_py(), s.tokenizer)))
                size += len(held[-1][1])
                if size >= 256 * s.length:
                    yield flush(size // s.length)
        if size:
            yield flush(-(-size // s.length))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(chop, "part int, place long, n_tokens long, crc32 long, doc_ids array<long>, payload binary")


def write_training_order(sequences: DataFrame, path: str, settings: Order = Order()) -> DataFrame:
    """Write sequences (as of token_sequences, read from a table) to shards in training order.

    Sequence number i of N (by part and place) gets slot permute(i, N, key), so slots are 0..N-1, each
    once. Shard k is a file of raw bytes under ``path``/shards that holds the slots from k * shard on,
    at a fixed stride: slot j starts at (j mod shard) * stride, so any reader can seek to a slot and go
    on from there, and numpy can map a file as uint16 rows of length + 1 ids. Range partitions of
    whole shards are sorted by slot and written by Spark's text writer, whose commit protocol sees to
    retries, on any file system. ``path``/slots, returned as read back, has a row for each sequence:
    slot, shard, byte_offset, part, place, n_tokens, crc32, doc_ids. Only one count for each part goes
    through the driver. No sequences give an empty table and no shards.
    """
    s = settings
    counts = {r["part"]: r["n"] for r in sequences.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    base, total = {}, 0
    for part in sorted(counts):
        base[part], total = total, total + counts[part]
    shards = max(1, -(-total // s.shard))
    each = -(-shards // s.tasks)  # shards of a task

    def slots(batch: pa.RecordBatch) -> np.ndarray:
        index = np.array([base[p] for p in batch.column(0).to_pylist()], np.int64) + batch.column(1).to_numpy()
        return permute(index, total, s.key, s.rounds)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(slots(batch)), *batch.columns], ["slot", *batch.schema.names])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(5, dict_data=zstandard.ZstdCompressionDict(common)).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(slots(batch)), pa.array([squeeze(x.as_py()) for x in batch.column(2)], pa.binary())], ["slot", "payload"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(common)).decompress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([whole(x.as_py()) for x in batch.column(1)], pa.binary())], ["payload"])

    if total:
        # rows are squeezed one by one for the shuffle, with the bytes of some others as their dictionary
        common = b"".join(r[0] for r in sequences.select("payload").limit(64).collect())
        dealt = sequences.select("part", "place", "payload").mapInArrow(deal, "slot long, payload binary")
        task = (F.col("slot") / F.lit(s.shard * each)).cast("int")
        dealt = dealt.repartitionById(-(-shards // each), task).sortWithinPartitions("slot")
        # a cast of binary keeps the bytes, and a task's file goes on to the next after a shard's records
        rows = dealt.mapInArrow(unpack, "payload binary").select(F.col("payload").cast("string"))
        rows.write.option("lineSep", RECORD_END).option("maxRecordsPerFile", s.shard).option("compression", "none").text(f"{path}/shards")
    columns = ["part", "place", "n_tokens", "crc32", "doc_ids"]
    named = sequences.select(*columns).mapInArrow(place, "slot long, part int, place long, n_tokens long, crc32 long, doc_ids array<long>")
    shard = F.floor(F.col("slot") / F.lit(s.shard)).cast("int").alias("shard")
    named = named.select("slot", shard, (F.pmod("slot", F.lit(s.shard)) * s.stride).alias("byte_offset"), *columns)
    named.write.option("compression", "zstd").parquet(f"{path}/slots")
    return sequences.sparkSession.read.schema(named.schema).parquet(f"{path}/slots")


def shard_files(spark: SparkSession, path: str, settings: Order = Order()) -> DataFrame:
    """Rows (path, shard, n, content) of the shards at ``path``; what is not selected is not read."""
    files = spark.read.format("binaryFile").load(f"{path}/shards")
    name = F.col("_metadata.file_name")
    task, count = (F.regexp_extract(name, r"^part-(\d+)-.*-c(\d+)", k).cast("int") for k in (1, 2))
    each = files.agg(F.max(count) + 1).first()[0] or 1
    return files.select("path", (task * each + count).alias("shard"), (F.col("length") / F.lit(settings.stride)).cast("long").alias("n"), "content")


def read_from(spark: SparkSession, path: str, slot: int = 0, settings: Order = Order()) -> DataFrame:
    """Rows (slot, ids of two bytes each) of the shards at ``path`` from ``slot`` on; earlier shards are not read."""
    s = settings
    rows = shard_files(spark, path, s).filter(F.col("shard") >= slot // s.shard)
    rows = rows.select("shard", "content", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    ids = F.substring("content", (F.col("k") * s.stride + 1).cast("int"), F.lit(2 * s.length))
    return rows.select((F.col("shard").cast("long") * s.shard + F.col("k")).alias("slot"), ids.alias("ids")).filter(F.col("slot") >= slot)


def training_order(docs: DataFrame, settings: Order = Order(), path: str | None = None) -> DataFrame:
    """Tokenise ``docs`` (doc_id, text), write shards in training order (by default into the shared
    folder) and return the rows of write_training_order, one for each sequence. Every row of ``docs``
    is written, those with a null or repeated doc_id too; a null or empty text is the end id alone; an
    empty table gives no rows; other columns are ignored."""
    sequences = cut(token_sequences(docs, settings), "sequences", "zstd", **{"parquet.compression.codec.zstd.level": 7})
    path = path or f"{shared_dir(docs.sparkSession)}/skytab-shards-{uuid.uuid4().hex}"
    return write_training_order(sequences, path, settings)
