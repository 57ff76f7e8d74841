"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing with exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, scratch


@dataclass(frozen=True)
class Settings:
    """k: neighbours returned. tables: hash tables. width: of a cell, in standard deviations of a projection. probes: most
    buckets that a query visits in a table. recall: share of the true neighbours of the trial queries that have to be found.
    sample, trials: bounds of the vectors that centres and deviations are taken from, and of the queries compared with
    all rows to choose the cells. rows, queries: of a bucket that meet in one block."""

    k: int = 20
    tables: int = 2
    width: float = 2.0
    probes: int = 16
    recall: float = 0.96
    sample: int = 8192
    trials: int = 128
    rows: int = 16384
    queries: int = 2048
    most_hashes: int = 24
    seed: int = 5


@dataclass(frozen=True)
class Index:
    """Projections of one length of vectors. longest: largest length of a row, which the extra coordinate fills up to; rest: its mean.
    axes: [table, coordinate, hash]; shift, width: by which a projection is cut into cells; probes: buckets visited."""

    longest: float
    rest: float
    axes: np.ndarray
    shift: np.ndarray
    width: np.ndarray
    probes: int

    def hashes(self, n: int) -> Index:
        """With the first n hashes of each table only."""
        return Index(self.longest, self.rest, self.axes[:, :, :n], self.shift[:, :n], self.width[:, :n], self.probes)


def _raised(x: np.ndarray, longest: float) -> np.ndarray:
    """Rows with one more coordinate, so that all are as long as the longest: then the nearest have the largest inner product."""
    x = x / longest
    rest = np.sqrt(np.maximum(0.0, 1 - (x * x).sum(1)))
    return np.hstack([x, rest[:, None]])


def _asking(x: np.ndarray, rest: float) -> np.ndarray:
    """Queries at length one, whose extra coordinate is that of a mean row: then their cells lie where their neighbours' do."""
    x = x / np.abs(x).max(1, keepdims=True)
    return np.hstack([x * (np.sqrt(1 - rest * rest) / np.sqrt((x * x).sum(1)))[:, None], np.full((len(x), 1), rest)])


def places(raised: np.ndarray, index: Index) -> np.ndarray:
    """[vector, table, hash]: projections in units of a cell."""
    return (np.einsum("nd,tdm->ntm", raised, index.axes) + index.shift) / index.width


def probe_sequence(place: np.ndarray, probes: int) -> np.ndarray:
    """Cells of one table that queries visit: [query, probe, hash], the own cell first, then those whose perturbations by one
    cell down or up in some hashes have the least sums of squared distances to the boundaries crossed, which is the order of
    estimated success."""
    n, hashes = place.shape
    own = np.floor(place)
    down = place - own
    cost, step = np.zeros((n, 1)), np.zeros((n, 1, hashes))
    for m in range(hashes):
        parts = []
        for by, add in ((0, np.zeros(n)), (-1, down[:, m] ** 2), (1, (1 - down[:, m]) ** 2)):
            new = step.copy()
            new[:, :, m] = by
            parts.append((cost + add[:, None], new))
        cost, step = np.concatenate([c for c, _ in parts], 1), np.concatenate([x for _, x in parts], 1)
        if cost.shape[1] > probes:  # a prefix that probes others beat is part of no probe
            best = np.argsort(cost, 1, kind="stable")[:, :probes]
            cost, step = np.take_along_axis(cost, best, 1), np.take_along_axis(step, best[:, :, None], 1)
    best = np.argsort(cost, 1, kind="stable")
    return own[:, None, :] + np.take_along_axis(step, best[:, :, None], 1)


def codes(cells: np.ndarray, table: int, dim: int) -> np.ndarray:
    """One number for each cell [..., hash] of a table."""
    out = np.full(cells.shape[:-1], np.uint64(table * 1_000_003 + dim))
    for m in range(cells.shape[-1]):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + cells[..., m].astype(np.int64).astype(np.uint64)
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return (out ^ (out >> np.uint64(31))).view(np.int64)


def fit_index(sample: np.ndarray, longest: float, asked: np.ndarray, near: np.ndarray, owner: np.ndarray, s: Settings) -> Index:
    """As many hashes a table as the recall allows: with each number of them, the least number of probes is looked for that finds
    ``recall`` of the trial queries' (``asked``) true neighbours (``near``, of the query at ``owner``); the finest
    cells that need at most ``probes`` are taken. With no hash a table has one bucket."""
    rng = np.random.default_rng(s.seed)
    raised = _raised(sample, longest)
    rest = float(raised[:, -1].mean()) if len(raised) else 0.0
    axes = rng.normal(size=(s.tables, raised.shape[1], s.most_hashes))
    spread = np.einsum("nd,tdm->ntm", raised, axes).std(0) if len(raised) else np.ones((s.tables, s.most_hashes))
    centre = np.einsum("nd,tdm->ntm", raised, axes).mean(0) if len(raised) else np.zeros((s.tables, s.most_hashes))
    width = s.width * np.where(spread > 1e-9, spread, 1.0)
    whole = Index(longest, rest, axes, rng.uniform(0, 1, width.shape) * width - centre, width, s.probes)
    if not len(near):
        return whole.hashes(0)
    mine, theirs = places(_asking(asked, rest), whole), np.floor(places(_raised(near, longest), whole))
    for n in range(s.most_hashes, 0, -1):
        rank = np.full(len(near), s.probes)
        for t in range(s.tables):
            hit = (probe_sequence(mine[:, t, :n], s.probes)[owner] == theirs[:, t, None, :n]).all(2)
            rank = np.minimum(rank, np.where(hit.any(1), hit.argmax(1), s.probes))
        need = int(np.sort(rank)[min(len(rank) - 1, int(np.ceil(s.recall * len(rank))) - 1)]) + 1
        if need <= s.probes:
            index = whole.hashes(n)
            return Index(longest, rest, index.axes, index.shift, index.width, need)
    return whole.hashes(0)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def best_rows(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k rows of each query by inner product, then smaller id: index of the query, id, score. A matrix product finds
    those that come near the k-th; one sum a pair, the same wherever a pair meets, decides."""
    out = []
    for lo in range(0, len(q), 128):
        part = q[lo : lo + 128]
        score = part @ x.T
        slack = 1e-12 * np.abs(part).max(1) * max(1.0, np.abs(x).max(initial=0.0)) * x.shape[1]
        least = np.partition(score, score.shape[1] - k, 1)[:, score.shape[1] - k] if score.shape[1] > k else np.full(len(part), -np.inf)
        i, j = np.nonzero(score >= (least - slack)[:, None])
        exact = np.empty(len(i))
        for a in range(0, len(i), 1 << 15):
            exact[a : a + (1 << 15)] = np.einsum("ij,ij->i", part[i[a : a + (1 << 15)]], x[j[a : a + (1 << 15)]])
        order = np.lexsort((ids[j], -exact, i))
        g = i[order]
        order = order[np.arange(len(g)) - np.searchsorted(g, g) < k]
        out.append((i[order] + lo, ids[j[order]], exact[order]))
    return tuple(np.concatenate(y) for y in zip(*out)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)


def _by_length(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column(at).to_numpy()
    for dim in np.unique(dims):
        yield int(dim), batch.filter(pa.array(dims == dim))


def _classes(vectors: DataFrame, queries: Column | str, s: Settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows that can be found, distinct vectors that are asked for, and the queries with the vector each asks for."""
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", "embedding").filter("vec_id IS NOT NULL AND embedding IS NOT NULL").filter(finite)
    rows = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    same = [F.xxhash64(F.lit(k), "embedding").alias(f"h{k}") for k in (1, 2)]
    rows = cut(rows.select("vec_id", "embedding", F.size("embedding").alias("dim"), *same), "vectors")
    # of equal vectors only the first k + 1 can be among the k nearest of any row
    slim = rows.select("vec_id", "h1", "h2", "dim")
    place = F.row_number().over(Window.partitionBy("h1", "h2", "dim").orderBy("vec_id"))
    ranked = slim.withColumn("place", place).filter(F.col("place") <= s.k + 1).select("vec_id", "place")
    found = cut(rows.join(ranked, "vec_id").select("vec_id", "dim", "place", "h1", "h2", "embedding"), "found")
    asked = cut(slim.filter(queries), "asked")
    first = found.filter("place = 1").select("h1", "h2", "dim", F.col("vec_id").alias("class_id"), "embedding")
    wanted = asked.select("h1", "h2", "dim").distinct()
    distinct = cut(first.join(wanted, ["h1", "h2", "dim"]), "distinct")
    return found.drop("h1", "h2", "place"), distinct, asked.join(distinct.select("h1", "h2", "dim", "class_id"), ["h1", "h2", "dim"]).select("vec_id", "class_id")


def _share(rows: DataFrame, n: int, most: int, key: str, seed: int) -> DataFrame:
    """About ``most`` of n rows, by a hash; never many more."""
    spread = 1 << 40
    return rows.filter(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(spread)) < int(min(1.0, most / max(n, 1)) * spread)).limit(2 * most)


def _fitted(found: DataFrame, asked: DataFrame, s: Settings) -> dict[int, Index]:
    """An index for each length of vectors, from bounded samples, and from the true neighbours of some trial queries."""
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x.cast("double") * x))
    longest = {r["dim"]: (r["longest"], r["n"]) for r in found.groupBy("dim").agg(F.max(length).alias("longest"), F.count(F.lit(1)).alias("n")).collect()}
    n = sum(x[1] for x in longest.values())
    sample: dict[int, list] = {}
    for r in _share(found, n, s.sample, "vec_id", s.seed).select("dim", "embedding").toArrow().to_pylist():
        sample.setdefault(r["dim"], []).append(r["embedding"])
    trial = [r for r in _share(asked, asked.count(), s.trials, "class_id", s.seed).select("class_id", "dim", "embedding").toArrow().to_pylist()]
    by_dim = {d: (np.array([r["class_id"] for r in trial if r["dim"] == d]), np.array([r["embedding"] for r in trial if r["dim"] == d], np.float64)) for d in {r["dim"] for r in trial}}
    shared = found.sparkSession.sparkContext.broadcast(by_dim)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The true neighbours among the rows of a task, kept up from batch to batch."""
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for whole in batches:
            for dim, batch in _by_length(whole, 1):
                if dim not in shared.value:
                    continue
                x, ids = _matrix(batch.column(2)), batch.column(0).to_numpy()
                i, name, score = best_rows(shared.value[dim][1], x, ids, s.k + 1)
                order = np.argsort(ids, kind="stable")
                vectors = x[order[np.searchsorted(ids[order], name)]]
                if dim in best:
                    i, name, score, vectors = (np.concatenate(y) for y in zip(best[dim], (i, name, score, vectors)))
                order = np.lexsort((name, -score, i))
                g = i[order]
                order = order[np.arange(len(g)) - np.searchsorted(g, g) < s.k + 1]
                best[dim] = i[order], name[order], score[order], vectors[order]
        for dim, (i, name, score, vectors) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), dim, np.int32)), pa.array(shared.value[dim][0][i]), pa.array(name), pa.array(score), pa.array(list(vectors), pa.list_(pa.float64()))], ["dim", "class_id", "vec_id", "score", "v"])

    kind = "dim int, class_id long, vec_id long, score double, v array<double>"
    place = F.row_number().over(Window.partitionBy("class_id").orderBy(F.desc("score"), "vec_id"))
    truth = found.select("vec_id", "dim", "embedding").mapInArrow(nearest, kind).withColumn("place", place).filter((F.col("place") <= s.k + 1) & (F.col("vec_id") != F.col("class_id")))
    near = truth.select("dim", "class_id", "v").collect()  # trials times k rows
    out = {}
    for dim, (far, _) in longest.items():
        own = [r for r in near if r["dim"] == dim]
        names, asking = by_dim.get(dim, (np.zeros(0, np.int64), np.zeros((0, dim))))
        at = {c: i for i, c in enumerate(names.tolist())}
        out[dim] = fit_index(np.array(sample.get(dim, np.zeros((0, dim))), np.float64), far, asking, np.array([r["v"] for r in own], np.float64).reshape(-1, dim), np.array([at[r["class_id"]] for r in own], np.int64), s)
    return out


def nearest_vectors(vectors: DataFrame, queries: Column | str, settings: Settings = Settings()) -> DataFrame:
    """The ``k`` rows (vec_id, embedding) of ``vectors`` nearest to each row for which ``queries``, a condition on vec_id, holds, by
    inner product in double precision, the row itself left out: query_id, rank, vec_id, score; ties: smaller vec_id.

    Rows get an extra coordinate that makes all equally long, so that the nearest by distance have the largest inner
    product. Every table cuts some random projections into cells. Queries visit their own bucket and those that one cell's
    step in some projections leads to, the likeliest first; candidates of all tables are merged and compared with the original
    vectors, in blocks, of which each returns k rows a query. How many projections a table has and how many buckets are visited follows
    from the true neighbours of at most 2 x ``trials`` queries, so that ``recall`` of them are found; all rows are
    indexed. Of equal vectors the first k + 1 are kept, more cannot be nearest; equal queries are answered once.

    Rows with a null vec_id, and vectors that are null, empty, zero or hold a null or non-finite component, take no part;
    vectors of different length never meet. Rows that repeat a vec_id count as one (the smallest vector). Where there
    are fewer candidates than k, or buckets hold fewer, all found are returned; an empty table gives no rows. Other columns are ignored.
    """
    s = settings
    with scratch(vectors.sparkSession) as keep:
        found, distinct, asked = _classes(vectors, queries, s)
        shared = vectors.sparkSession.sparkContext.broadcast(_fitted(found, distinct, s))

        def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Every row under its bucket in each table."""
            for whole in batches:
                for dim, batch in _by_length(whole, 1):
                    index = shared.value[dim]
                    cells = np.floor(places(_raised(_matrix(batch.column(2)), index.longest), index))
                    for t in range(cells.shape[1]):
                        yield pa.RecordBatch.from_arrays([pa.array(codes(cells[:, t], t, dim)), *batch.columns], ["code", "vec_id", "dim", "embedding"])

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Every query under the buckets that it visits."""
            for whole in batches:
                for dim, all_rows in _by_length(whole, 1):
                    index = shared.value[dim]
                    for lo in range(0, len(all_rows), 1024):
                        batch = all_rows.slice(lo, 1024)
                        place = places(_asking(_matrix(batch.column(2)), index.rest), index)
                        for t in range(place.shape[1]):
                            code = codes(probe_sequence(place[:, t], index.probes), t, dim)
                            row = pa.array(np.repeat(np.arange(len(batch)), code.shape[1]))
                            yield pa.RecordBatch.from_arrays([pa.array(code.ravel()), batch.column(0).take(row), batch.column(1).take(row), batch.column(2).take(row)], ["code", "class_id", "dim", "embedding"])

        kind = dict(found.dtypes)["embedding"]
        filed = cut(found.mapInArrow(file, f"code long, vec_id long, dim int, embedding {kind}"), "filed")
        visits = cut(distinct.select("class_id", "dim", "embedding").mapInArrow(visit, f"code long, class_id long, dim int, embedding {kind}"), "visits")
        size = filed.groupBy("code").agg(F.count(F.lit(1)).alias("n_rows")).join(visits.groupBy("code").agg(F.count(F.lit(1)).alias("n_queries")), "code")
        size = cut(size.select("code", F.ceil(F.col("n_rows") / s.rows).cast("int").alias("i_n"), F.ceil(F.col("n_queries") / s.queries).cast("int").alias("j_n")), "size")
        own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = filed.join(size, "code").select("code", own("vec_id", "i_n").alias("i"), each("j_n").alias("j"), "vec_id", "dim", "embedding")
        right = visits.join(size, "code").select("code", each("i_n").alias("i"), own("class_id", "j_n").alias("j"), "class_id", "dim", "embedding")

        def compare(x: pa.Table, q: pa.Table) -> pa.Table:
            out = []
            for dim in np.intersect1d(x.column("dim").to_numpy(), q.column("dim").to_numpy()):
                a, b = (t.filter(pa.array(t.column("dim").to_numpy() == dim)) for t in (x, q))
                i, ids, score = best_rows(_matrix(b.column("embedding")), _matrix(a.column("embedding")), a.column("vec_id").to_numpy(), s.k + 1)
                out.append(pa.table({"class_id": b.column("class_id").to_numpy()[i], "vec_id": ids, "score": score}))
            return pa.concat_tables(out) if out else pa.table({"class_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

        block = ["code", "i", "j"]
        met = left.groupBy(*block).cogroup(right.groupBy(*block)).applyInArrow(compare, "class_id long, vec_id long, score double")
        place = F.row_number().over(Window.partitionBy("class_id").orderBy(F.desc("score"), "vec_id"))
        best = met.groupBy("class_id", "vec_id").agg(F.max("score").alias("score")).withColumn("place", place).filter(F.col("place") <= s.k + 1)
        best = cut(best, "best")
        answers = asked.withColumnRenamed("vec_id", "query_id").join(best, "class_id").filter("query_id <> vec_id")
        before = best.select("class_id", F.col("vec_id").alias("query_id"), F.col("place").alias("own"))
        answers = answers.join(before, ["class_id", "query_id"], "left")
        rank = (F.col("place") - F.when(F.col("own") < F.col("place"), 1).otherwise(0)).cast("int")
        return keep(answers.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= s.k), "nearest")
