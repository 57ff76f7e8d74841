"""Nearest descriptors, exactly and in any number of dimensions: cells around pivots, bounds by the triangle inequality."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut, tidy

BLOCK = 4096  # rows of a block


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Good enough for bounds, which get a margin; what is returned is summed anew."""
    d2 = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
    return np.sqrt(np.maximum(d2, 0.0))


def _margin(*arrays: np.ndarray) -> float:
    return 1e-6 * max([1e-3, *(float(np.abs(x).max(initial=0.0)) for x in arrays)]) * np.sqrt(max(x.shape[1] for x in arrays))


def _usable(rows: DataFrame) -> DataFrame:
    """key, id, v of descriptors that can be compared, in blocks j of their key."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.select("key", "id", F.col("v").cast("array<double>").alias("v")).filter("key IS NOT NULL AND id IS NOT NULL AND size(v) > 0").filter(~bad)
    rows = cut(rows, "descriptors")
    n = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("m"))
    return cut(rows.join(n, "key").withColumn("j", F.pmod(F.xxhash64("id"), F.col("m")).cast("int")), "blocks")


def _cells(targets: DataFrame, pivots: DataFrame) -> DataFrame:
    """targets with the pivot nearest to each and the distance to it."""
    kind = dict(targets.dtypes)

    def assign(x: pa.Table, p: pa.Table) -> pa.Table:
        dim = len(x.column("v")[0])
        d = _distances(_matrix(x.column("v"), dim), _matrix(p.column("v"), dim))
        near = d.argmin(1)
        return pa.table({"key": x.column("key"), "id": x.column("id"), "v": x.column("v"), "pivot": p.column("pivot").take(pa.array(near)), "d": d[np.arange(len(near)), near]})

    side = targets.select("key", "j", "id", "v")
    each = cut(side.select("key", "j").distinct().join(pivots.select("key", "pivot", "v"), "key"), "each")
    return side.groupBy("key", "j").cogroup(each.groupBy("key", "j")).applyInArrow(assign, f"key {kind['key']}, id {kind['id']}, v array<double>, pivot int, d double")


@tidy("nearest")
def nearest_descriptors(queries: DataFrame, targets: DataFrame, k: int, *, itself: bool = True, pivots: int = 256) -> DataFrame:
    """The k targets (key, id, v) nearest to each query (key, id, v) of the same key: key, id, other, distance, rank, visits.

    Targets lie in cells around at most ``pivots`` of them, and in rings around the pivot, of blocks of 4096. A query looks into one
    block of its own cell first; the k-th distance there bounds the true one, and every other block that the triangle
    inequality does not rule out is looked into next, so the result is exact. visits: how many blocks that were. Ties: smaller id.
    itself: whether a target with the query's id counts. Fewer than k targets give fewer rows. Descriptors that are null or empty,
    or have a component that is null or not finite, neither find nor are found; all of a key must have the same length.
    """
    kinds = dict(targets.dtypes)
    seen, asked = _usable(targets), _usable(queries)
    order = Window.partitionBy("key").orderBy(F.xxhash64("id"), "id")
    chosen = seen.withColumn("pivot", F.row_number().over(order)).filter(F.col("pivot") <= pivots)
    size = seen.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / (BLOCK // 2)).cast("int").alias("p"))
    chosen = cut(chosen.join(size, "key").filter("pivot <= p").select("key", "pivot", "v"), "pivots")

    cells = cut(_cells(seen, chosen), "cells")
    rings = cells.groupBy("key", "pivot").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("d", F.array(*(F.lit(i / 32) for i in range(1, 32)))).alias("at"))
    stride = F.greatest(F.lit(1), F.floor(F.lit(32 * BLOCK) / F.col("n")).cast("int"))
    rings = rings.select("key", "pivot", F.filter("at", lambda x, i: (i + 1) % stride == 0).alias("at"))
    cells = cells.join(rings, ["key", "pivot"]).withColumn("ring", F.size(F.filter("at", lambda x: x < F.col("d")))).drop("at")
    cells = cut(cells, "rings")
    blocks = cells.groupBy("key", "pivot", "ring").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("m"), F.min("d").alias("low"), F.max("d").alias("high"))
    blocks = cut(blocks, "sizes")
    cells = cut(cells.join(blocks.select("key", "pivot", "ring", "m"), ["key", "pivot", "ring"]).withColumn("c", F.pmod(F.xxhash64("id"), F.col("m")).cast("int")).drop("m"), "cells")

    # queries and the pivots that they have to think of: all at first
    away = F.greatest(F.col("dq") - F.col("high"), F.col("low") - F.col("dq"), F.lit(0.0))
    first = _to_pivots(asked.withColumn("most", F.lit(float("inf"))), chosen, blocks, nearest=True).join(blocks, ["key", "pivot"]).withColumn("away", away)
    first = first.groupBy("key", "id").agg(F.min_by(F.struct("pivot", "ring"), F.struct("away", "pivot", "ring")).alias("b")).select("key", "id", F.col("b.pivot").alias("pivot"), F.col("b.ring").alias("ring"), F.lit(0).alias("c"))
    first = cut(first, "first")
    near = cut(_compare(asked.withColumn("most", F.lit(float("inf"))), first, cells, k, itself, kinds), "near")
    bound = near.filter(F.col("rank") == k).select("key", "id", F.col("distance").alias("most"))
    bounded = cut(asked.join(bound, ["key", "id"], "left").withColumn("most", F.coalesce("most", F.lit(float("inf")))), "bounded")
    then = _to_pivots(bounded, chosen, blocks, nearest=False).join(blocks, ["key", "pivot"]).filter(away <= F.col("reach"))
    then = then.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).select("key", "id", "pivot", "ring", "c")
    then = cut(then.join(first, ["key", "id", "pivot", "ring", "c"], "left_anti"), "then")
    far = cut(_compare(bounded, then, cells, k, itself, kinds), "far")

    visits = first.unionByName(then).groupBy("key", "id").agg(F.count(F.lit(1)).alias("visits"))
    w = Window.partitionBy("key", "id").orderBy("distance", "other")
    both = near.drop("rank").unionByName(far.drop("rank")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return both.join(visits, ["key", "id"]).select("key", "id", "other", "distance", "rank", "visits")


def _to_pivots(asked: DataFrame, pivots: DataFrame, blocks: DataFrame, nearest: bool) -> DataFrame:
    """Queries with the pivots whose cells may hold a target at most ``most`` away (or with the nearest pivot only): key, id, pivot, dq, reach.

    A target of a cell is nearer to its pivot than to the query's own; so it is at least (dq^2 - d0^2) / (2 d(p, p0)) away."""
    kind = dict(asked.dtypes)
    held = blocks.groupBy("key", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high"))

    def bounds(q: pa.Table, p: pa.Table) -> pa.Table:
        dim = len(p.column("v")[0])
        a, b = _matrix(q.column("v"), dim), _matrix(p.column("v"), dim)
        slack = _margin(a, b)
        d, most = _distances(a, b), q.column("most").to_numpy() + slack
        own = d.argmin(1)
        if nearest:
            i, j = np.arange(len(a)), own
        else:
            apart = _distances(b, b)[own]
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = (d * d - d[np.arange(len(a)), own][:, None] ** 2) / (2 * apart)
            least = np.maximum(d - p.column("high").to_numpy(), p.column("low").to_numpy() - d)
            least = np.maximum(least, np.where(apart > slack, plane, 0.0) - slack)
            i, j = np.nonzero(least <= most[:, None])
        take = pa.array(i)
        return pa.table({"key": q.column("key").take(take), "id": q.column("id").take(take), "pivot": p.column("pivot").take(pa.array(j)), "dq": d[i, j], "reach": most[i] + slack})

    side = asked.select("key", "j", "id", "v", "most")
    each = cut(side.select("key", "j").distinct().join(pivots.join(held, ["key", "pivot"]), "key"), "each")
    return side.groupBy("key", "j").cogroup(each.groupBy("key", "j")).applyInArrow(bounds, f"key {kind['key']}, id {kind['id']}, pivot int, dq double, reach double")


def _compare(asked: DataFrame, visits: DataFrame, cells: DataFrame, k: int, itself: bool, kinds: dict[str, str]) -> DataFrame:
    """Of the blocks that queries visit the k nearest targets each, at most ``most`` away: key, id, other, distance, rank."""
    kind = dict(asked.dtypes)
    block = ["key", "pivot", "ring", "c"]
    rows = visits.join(asked.select("key", "id", "v", "most"), ["key", "id"])
    n = visits.groupBy(*block).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("m"))
    left = cut(rows.join(n, block).select(*block, F.pmod(F.xxhash64("id"), F.col("m")).cast("int").alias("i"), "id", "v", "most"), "asked")
    right = cells.join(n, block).select(*block, F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("i"), F.col("id").alias("other"), "v")

    def nearest(q: pa.Table, x: pa.Table) -> pa.Table:
        empty = pa.table({"key": q.column("key").slice(0, 0), "id": q.column("id").slice(0, 0), "other": x.column("other").slice(0, 0), "distance": np.zeros(0)})
        if not len(q) or not len(x):
            return empty
        dim = len(x.column("v")[0])
        a, b = _matrix(q.column("v"), dim), _matrix(x.column("v"), dim)
        most, out, slack = q.column("most").to_numpy(), [empty], _margin(a, b)
        names = x.column("other").combine_chunks()
        order = np.argsort(names.to_numpy(zero_copy_only=False), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        for lo in range(0, len(a), 256):
            part = a[lo : lo + 256]
            d = _distances(part, b)
            want = k + (not itself)
            least = np.partition(d, want - 1, 1)[:, want - 1] if d.shape[1] > want else np.full(len(part), np.inf)
            i, j = np.nonzero(d <= np.minimum(least, most[lo : lo + 256])[:, None] + 2 * slack)
            exact = np.concatenate([np.sqrt(np.einsum("ij,ij->i", y, y)) for c in range(0, len(i), 1 << 14) for y in [part[i[c : c + (1 << 14)]] - b[j[c : c + (1 << 14)]]]] or [np.zeros(0)])
            keep = exact <= most[lo : lo + 256][i]
            if not itself:
                keep &= ~np.array([u == v for u, v in zip(q.column("id").take(pa.array(i + lo)).to_pylist(), names.take(pa.array(j)).to_pylist())], bool)
            i, j, exact = i[keep], j[keep], exact[keep]
            order = np.lexsort((place[j], exact, i))
            g = i[order]
            order = order[np.arange(len(g)) - np.searchsorted(g, g) < k]
            take = pa.array(i[order] + lo)
            out.append(pa.table({"key": q.column("key").take(take), "id": q.column("id").take(take), "other": names.take(pa.array(j[order])), "distance": exact[order]}))
        return pa.concat_tables(out)

    met = left.groupBy(*block, "i").cogroup(right.groupBy(*block, "i")).applyInArrow(nearest, f"key {kind['key']}, id {kind['id']}, other {kinds['id']}, distance double")
    w = Window.partitionBy("key", "id").orderBy("distance", "other")
    return met.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def ratio_matches(neighbours: DataFrame, ratio: float = 0.75, least: int = 8) -> DataFrame:
    """Of the two nearest of each descriptor (as nearest_descriptors) those whose first is nearer than ``ratio`` times the second: key, id, other,
    distance, second, n_good (of the key), enough: whether there are at least ``least``, so that a transform can be
    estimated. Descriptors with one neighbour only are no match."""
    two = neighbours.filter("rank <= 2").groupBy("key", "id").agg(F.min_by("other", "rank").alias("other"), F.min("distance").alias("distance"), F.max("distance").alias("second"), F.count(F.lit(1)).alias("n"))
    good = two.filter((F.col("n") == 2) & (F.col("distance") < ratio * F.col("second"))).drop("n")
    count = good.groupBy("key").agg(F.count(F.lit(1)).alias("n_good"))
    return good.join(count, "key").withColumn("enough", F.col("n_good") >= least)
