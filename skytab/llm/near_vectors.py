"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .shared import cut, scratch


@dataclass(frozen=True)
class Settings:
    """similarity: least cosine of a link. sample: vectors that the rotation is learned on (the
    index holds all). tables x bits: codes are cut into so many tables. probes: table codes looked
    up for a vector, those with the least squared margin over the flipped bits, its own included.
    block: rows of a bucket compared in one block. Two vectors meet unless in every table either
    one's code lies outside the other's probes; with random vectors just at the threshold that is so
    for 15 pairs in 100,000. ``sized`` makes tables wider for large corpora.
    """

    similarity: float = 0.98
    sample: int = 8192
    tables: int = 3
    bits: int = 21
    probes: int = 24
    iterations: int = 40
    block: int = 512
    seed: int = 11

    def sized(self, n: int) -> Settings:
        """Tables of eight times as many codes as there are vectors at least, so that unlike vectors seldom
        meet; two at least, with more probes the wider they are (at 30 bits 0.994 of the pairs just at the threshold meet)."""
        bits = min(32, max(self.bits, n.bit_length() + 3))
        if bits == self.bits:
            return self
        return replace(self, bits=bits, tables=max(2, self.tables * self.bits // bits), probes=self.probes + self.probes * (bits - self.bits) // 5)


@dataclass(frozen=True)
class Rotation:
    """mean: centre of the unit vectors; axes: orthonormal columns, one for each bit."""

    mean: np.ndarray
    axes: np.ndarray


def learn_rotation(sample: np.ndarray, s: Settings) -> Rotation:
    """Principal axes of unit vectors, then the rotation that brings them nearest to their signs."""
    dim = sample.shape[1]
    bits = min(dim, s.tables * s.bits)
    mean = sample.mean(0)
    centred = sample - mean
    _, _, axes = np.linalg.svd(centred.T @ centred)
    axes = axes[:bits].T
    low = centred @ axes
    rotation, _ = np.linalg.qr(np.random.default_rng(s.seed).normal(size=(bits, bits)))
    for _ in range(s.iterations):
        u, _, v = np.linalg.svd(np.where(low @ rotation >= 0, 1.0, -1.0).T @ low)
        rotation = (u @ v).T
    return Rotation(mean, axes @ rotation)


def _subsets(margins: np.ndarray, probes: int) -> np.ndarray:
    """For each row of squared margins, the ``probes`` bit masks with the least sums, 0 first."""
    n, bits = margins.shape
    order = np.argsort(margins, 1, kind="stable")
    near = order[:, : min(bits, 8)]
    sums = np.zeros((n, 1))
    masks = np.zeros((n, 1), np.int64)
    for k in range(near.shape[1]):
        cost = np.take_along_axis(margins, near[:, k : k + 1], 1)
        bit = np.int64(1) << near[:, k : k + 1].astype(np.int64)
        sums, masks = np.hstack([sums, sums + cost]), np.hstack([masks, masks | bit])
        if sums.shape[1] > probes:
            best = np.argsort(sums, 1, kind="stable")[:, :probes]
            sums, masks = np.take_along_axis(sums, best, 1), np.take_along_axis(masks, best, 1)
    return masks


def lookups(unit: np.ndarray, rotation: Rotation, s: Settings) -> np.ndarray:
    """Codes of unit vectors: [vector, table, probe]; probe 0 is the vector's own code."""
    y = (unit - rotation.mean) @ rotation.axes
    parts = np.array_split(np.arange(y.shape[1]), min(s.tables, y.shape[1]))
    out = []
    for part in parts:
        own = ((y[:, part] >= 0) << np.arange(len(part))).sum(1).astype(np.int64)
        out.append(own[:, None] ^ _subsets(y[:, part] ** 2, min(s.probes, 1 << len(part))))
    width = max(x.shape[1] for x in out)
    return np.stack([np.pad(x, ((0, 0), (0, width - x.shape[1])), mode="edge") for x in out], 1)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, all of one length, as doubles of unit length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _unit(flat.reshape(len(column), -1))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1))[:, None]


SMALL = 64


def _close_pairs(group: np.ndarray, part: dict[str, np.ndarray], unit: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Rows a, b of one group each (groups lie together) that link: not both visitors, and of different
    chunks where a block has two. Small groups are compared all at once, at a distance of one row, two
    rows and so on; large ones by a matrix product each, whose pairs near the threshold or over it are
    judged by the same sum as those of small groups."""
    ids, visits, chunk, two = part["vec_id"], part["visits"], part["chunk"], part["i"] != part["j"]
    sizes = np.bincount(group)
    starts = np.cumsum(sizes) - sizes
    out = []
    for d in range(1, min(SMALL, int(sizes.max()))):
        a = np.flatnonzero((group[d:] == group[:-d]) & (sizes[group[d:]] <= SMALL))
        if not len(a):
            break
        a = a[~(visits[a] & visits[a + d]) & (ids[a] != ids[a + d]) & (~two[a] | (chunk[a] != chunk[a + d]))]
        for lo in range(0, len(a), 1 << 14):
            x = a[lo : lo + (1 << 14)]
            out.append(np.stack([x, x + d])[:, np.einsum("ij,ij->i", unit[x], unit[x + d]) >= s.similarity])
    for g in np.flatnonzero(sizes > SMALL):
        rows = np.arange(starts[g], starts[g] + sizes[g])
        first = chunk[rows] == part["i"][rows[0]]
        left, right = rows[first], rows[~first] if two[rows[0]] else rows[first]
        found = np.argwhere(unit[left] @ unit[right].T >= s.similarity - 1e-9)
        a, b = left[found[:, 0]], right[found[:, 1]]
        keep = ~(visits[a] & visits[b]) & (ids[a] != ids[b])
        if not two[rows[0]]:
            keep &= a < b
        a, b = a[keep], b[keep]
        for lo in range(0, len(a), 1 << 14):
            x, y = a[lo : lo + (1 << 14)], b[lo : lo + (1 << 14)]
            out.append(np.stack([x, y])[:, np.einsum("ij,ij->i", unit[x], unit[y]) >= s.similarity])
    pairs = np.concatenate(out, 1) if out else np.zeros((2, 0), np.int64)
    return pairs[0], pairs[1]


def _links(group: np.ndarray, part: dict[str, np.ndarray], unit: np.ndarray, rotation: Rotation, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of some blocks: vector ids, how many vectors each links with here, and the root of each among these links."""
    ids, visits, copies = part["vec_id"], part["visits"], part["copies"]
    a, b = _close_pairs(group, part, unit, s)
    a, b = np.where(ids[a] < ids[b], a, b), np.where(ids[a] < ids[b], b, a)
    # a pair can meet in several buckets: it counts where it meets first, by table, both at home
    # first, then the smaller id as the visitor
    used = np.unique(np.concatenate([a, b]))
    at = np.zeros(len(ids), np.int64)
    at[used] = np.arange(len(used))
    codes = lookups(unit[used], rotation, s) if len(used) else None
    keep = np.zeros(len(a), bool)
    for lo in range(0, len(a), 4096):
        x, y = a[lo : lo + 4096], b[lo : lo + 4096]
        cx, cy = codes[at[x]], codes[at[y]]
        way = np.where((cy == cx[:, :, :1]).any(2), 2, 3)
        way = np.where((cx == cy[:, :, :1]).any(2), 1, way)
        way = np.where(cx[:, :, 0] == cy[:, :, 0], 0, way)
        table = (way < 3).argmax(1)
        here = np.where(visits[x], 1, np.where(visits[y], 2, 0))
        keep[lo : lo + 4096] = (table == part["t"][x]) & (way[np.arange(len(x)), table] == here)
    names, place = np.unique(ids, return_inverse=True)
    a, b, n_a, n_b = place[a[keep]], place[b[keep]], copies[a[keep]], copies[b[keep]]
    root = np.arange(len(names))
    while True:
        before = root.copy()
        np.minimum.at(root, b, root[a])
        np.minimum.at(root, a, root[b])
        root = root[root]
        if (before == root).all():
            break
    n = np.zeros(len(names), np.int64)
    np.add.at(n, a, n_b)
    np.add.at(n, b, n_a)
    some = np.flatnonzero(n)
    return names[some], n[some], names[root[some]]


def near_duplicate_vectors(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Link the rows (vec_id, embedding, label) of ``vectors`` whose labels are equal and whose cosine,
    in double precision, is at least ``settings.similarity``. One row a vector: vec_id, n_links,
    component_id (the smallest vec_id reachable by links), kept (vec_id = component_id).

    Vectors of one label with the same components form a class, which goes on as one vector with its
    number of copies. Signs of the rotated unit vectors give balanced binary codes, cut into tables.
    Every vector is filed under its own code and looks up the codes nearest to it; buckets in which nobody meets are
    dropped while rows are slim, the others are compared with the original vectors in blocks, so
    that no task holds a whole bucket and no pair is written out.

    Vectors that are null, empty, zero or hold a null or non-finite component, and rows with a null
    label, link with nothing; vectors of different length never link. Rows that repeat a vec_id count
    as one vector (the smallest label and embedding); rows with a null vec_id are left out. An empty
    table gives no rows; other columns are ignored.
    """
    with scratch(vectors.sparkSession) as keep:
        return keep(_grouped(vectors, settings), "groups")


def _grouped(vectors: DataFrame, s: Settings) -> DataFrame:
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>")).filter("vec_id is not null")
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("v")).select("vec_id", "v.label", "v.embedding")
    same = [F.xxhash64(F.lit(k), "embedding").alias(f"h{k}") for k in (1, 2)]
    rows = cut(rows.select("*", F.coalesce(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite, F.lit(False)).alias("good"), *same), "vectors")
    key = ["label", "h1", "h2"]
    classes = cut(rows.filter("good").groupBy(*key).agg(F.min("vec_id").alias("class_id"), F.count(F.lit(1)).alias("copies")), "classes")
    first = classes.select(F.col("class_id").alias("vec_id"), "copies")
    good = cut(rows.filter("good").select("vec_id", "label", "embedding").join(first, "vec_id").withColumn("dim", F.size("embedding")), "good")

    s = s.sized(good.count())
    learned: dict[int, Rotation] = {}
    sample = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(s.sample).select("embedding").toArrow()
    parts: dict[int, list] = {}
    for x in sample.column(0).to_pylist():
        parts.setdefault(len(x), []).append(x)
    for dim, x in parts.items():
        learned[dim] = learn_rotation(_unit(np.array(x, np.float64)), s)
    shared = vectors.sparkSession.sparkContext.broadcast(learned)

    def rotation(dim: int) -> Rotation:
        """Of a length that the sample lacks, a fixed random one."""
        if dim not in shared.value:
            shared.value[dim] = learn_rotation(np.random.default_rng(s.seed).normal(size=(4 * dim, dim)), s)
        return shared.value[dim]

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            dims = whole.column(2).to_numpy()
            for dim in np.unique(dims):
                own = whole.filter(pa.array(dims == dim))
                for lo in range(0, len(own), 1024):
                    batch = own.slice(lo, 1024)
                    codes = lookups(_matrix(batch.column(3)), rotation(int(dim)), s)
                    n, tables, probes = codes.shape
                    flat = np.arange(n * tables * probes)
                    again = np.zeros(codes.shape, bool)  # padding of narrow tables
                    again[:, :, 1:] = (codes[:, :, 1:] == codes[:, :, :1]) | (np.diff(codes, axis=2) == 0)
                    keep = flat[~again.ravel()]
                    row = keep // (tables * probes)
                    t = (keep // probes % tables).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), batch.column(2).take(pa.array(row)), pa.array(t), pa.array(codes.ravel()[keep]), pa.array(keep % probes > 0)],
                        ["vec_id", "label", "dim", "t", "code", "visits"],
                    )

    kind = dict(good.dtypes)["label"]
    filed = good.select("vec_id", "label", "dim", "embedding").mapInArrow(file, f"vec_id long, label {kind}, dim int, t int, code long, visits boolean")
    place = ["label", "dim", "t", "code"]
    filed = cut(filed, "filed")
    alive = filed.groupBy(*place).agg(F.count(F.lit(1)).alias("n"), F.min("visits").alias("no_home"))
    alive = cut(alive.filter("n > 1 and not no_home").withColumn("bucket", F.xxhash64(*place)).drop("no_home"), "alive")
    met = filed.join(alive, place).select("vec_id", "t", "visits", "n", *place[:1], "code", "dim")
    met = cut(met, "met").join(good.select("vec_id", "embedding", "copies"), "vec_id")
    met = met.withColumn("k", F.ceil(F.col("n") / s.block).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("k")).cast("int"))
    met = met.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    met = met.select(*place, F.least("chunk", "o").alias("i"), F.greatest("chunk", "o").alias("j"), "chunk", "visits", "vec_id", "copies", "embedding")
    block = [*place, "i", "j"]
    met = met.repartition(*block).sortWithinPartitions(*block)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            """Of whole blocks only; a length at a time."""
            for dim in np.unique(rows.column("dim").to_numpy()):
                own = rows.filter(pa.array(rows.column("dim").to_numpy() == dim)).combine_chunks()
                part = {k: own.column(k).to_numpy() for k in ("vec_id", "visits", "copies", "chunk", "i", "j", "t")}
                new = edges(own)
                out = _links(np.cumsum(new) - 1, part, _matrix(own.column("embedding").combine_chunks()), rotation(int(dim)), s)
                if len(out[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["vec_id", "n", "root"])

        def edges(rows: pa.Table) -> np.ndarray:
            """Whether a row begins a block."""
            new = np.zeros(len(rows), bool)
            new[:1] = True
            for k in block:
                x = rows.column(k).to_numpy(zero_copy_only=False)
                new[1:] |= x[1:] != x[:-1]
            return new

        rest: list[pa.RecordBatch] = []
        for whole in batches:
            for lo in range(0, len(whole), 2048):
                batch = whole.slice(lo, 2048)
                rows = pa.Table.from_batches([*rest, batch])
                last = int(np.flatnonzero(edges(rows))[-1])  # the last block may go on
                if last:
                    yield from links(rows.slice(0, last))
                rest = rows.slice(last).to_batches()
        if rest:
            yield from links(pa.Table.from_batches(rest))

    links = cut(met.mapInArrow(compare, "vec_id long, n long, root long"), "links")
    counts = links.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    component = connected_components(links, "vec_id", "root").withColumnsRenamed({"node": "vec_id", "component": "component_id"})
    found = classes.join(counts.withColumnRenamed("vec_id", "class_id"), "class_id", "left").join(component.withColumnRenamed("vec_id", "class_id"), "class_id", "left")
    n_links = F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1
    found = found.select(*key, n_links.alias("n_links"), F.coalesce("component_id", "class_id").alias("component_id"))
    found = cut(found, "found").withColumn("good", F.lit(True))
    out = rows.select("vec_id", *key, "good").join(found, [*key, "good"], "left")
    component_id = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), (component_id == F.col("vec_id")).alias("kept"))
