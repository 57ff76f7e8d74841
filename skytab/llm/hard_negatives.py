"""Hard negatives by exact inner-product search with length buckets and coordinate pruning."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .shared import cut, scratch

LONGEST = float(1 << 30)  # of a scaled vector; products of two fit in a long


@dataclass(frozen=True)
class Settings:
    """positives: rows of an anchor's label that are its positives. negatives: returned for each of them, whose scores
    are ``low`` to ``high`` per cent of the positive's. scale: a component x becomes floor(scale * x). block,
    anchors: rows and anchors of a block. bucket: rows of a length bucket in a block. focus: an anchor's largest
    coordinates, whose feasible ranges are intersected."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    scale: int = 256
    block: int = 8192
    anchors: int = 2048
    bucket: int = 1024
    focus: int = 3


class _Bucket:
    """Rows of similar length: sorted lists of the coordinates of their directions, made when a list is first asked for."""

    def __init__(self, x: np.ndarray, length: np.ndarray) -> None:
        self.x, self.most = x, float(length[0])
        self.unit = x / np.maximum(length, 1e-300)[:, None]
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def ranges(self, f: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where values of coordinate f from low to high stand in its list."""
        if f not in self.lists:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.lists[f] = order, self.unit[order, f]
        values = self.lists[f][1]
        return np.searchsorted(values, low, "left"), np.searchsorted(values, high, "right")


def feasible(c: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Range of a coordinate of unit vectors whose cosine with another unit vector is ``least`` at least, c being that
    one's coordinate: the angle to the axis is off by the angle between the two at most."""
    wide = np.sqrt(np.maximum(0.0, (1 - c * c) * (1 - least * least)))
    low = np.where(-c > least, -1.0, c * least - wide)
    high = np.where(c > least, 1.0, c * least + wide)
    return low - 1e-9, high + 1e-9


def first_rows(group: np.ndarray, score: np.ndarray, name: np.ndarray, k: int) -> np.ndarray:
    """Indices of the first k rows of each group by score downwards, then by name."""
    order = np.lexsort((name, -score, group))
    g = group[order]
    return order[np.arange(len(g)) - np.searchsorted(g, g) < k]


def _exact(q: np.ndarray, x: np.ndarray, longest: float) -> np.ndarray:
    """Inner products of whole numbers; as doubles where these hold every sum exactly."""
    if longest < 2.0**53:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return q @ x.T


def search(q: dict[str, np.ndarray], x: dict[str, np.ndarray], same: bool, k: int, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block of targets (id, label, v, low, high) and a block of rows (id, label, v): index of the target, id of the row and
    score of the first k rows of each target whose label is the same (or another one) and whose score lies in its bounds.

    Rows lie in buckets by length, longest first. The k-th best score so far of a target is its threshold: buckets too
    short for it are passed over, and in the others only rows whose coordinates lie in the feasible ranges of the
    anchor's focus coordinates are scored.
    """
    length = np.sqrt((x["v"].astype(np.float64) ** 2).sum(1))
    order = np.argsort(-length, kind="stable")
    ids, labels, v, length = x["id"][order], x["label"][order], x["v"][order], length[order]
    buckets = [(i, _Bucket(v[i : i + s.bucket], length[i : i + s.bucket])) for i in range(0, len(ids), s.bucket)]
    found: list[list[np.ndarray]] = [[], [], []]
    least = np.iinfo(np.int64).min
    for lo in range(0, len(q["id"]), 256):
        part = {c: y[lo : lo + 256] for c, y in q.items()}
        n = len(part["id"])
        size = np.sqrt((part["v"].astype(np.float64) ** 2).sum(1))
        unit = part["v"] / np.maximum(size, 1e-300)[:, None]
        focus = np.argsort(-np.abs(unit), 1, kind="stable")[:, : s.focus]
        bound, best = part["low"].copy(), [np.zeros(0, np.int64)] * 3
        for start, b in buckets:
            reach = size * b.most * (1 + 1e-12) + 1e-6
            alive = np.flatnonzero((reach >= bound) & (part["high"] >= part["low"]))
            if not len(alive):
                break  # the buckets that follow are shorter
            cosine = np.clip(bound[alive] / np.maximum(reach[alive], 1e-300), -1.0, 1.0)
            cosine = np.where(bound[alive] > 0, cosine, -1.0)  # a bound of 0 or less grows towards short rows: all are open
            c = np.take_along_axis(unit[alive], focus[alive], 1)
            low, high = feasible(c, cosine[:, None])
            at, to = np.zeros(c.shape, np.int64), np.zeros(c.shape, np.int64)
            for f in np.unique(focus[alive]):
                i, j = np.nonzero(focus[alive] == f)
                at[i, j], to[i, j] = b.ranges(int(f), low[i, j], high[i, j])
            few = (to - at).min(1, initial=len(b.x)) < len(b.x) // 2
            rows = slice(start, start + len(b.x))
            score = np.full((len(alive), len(b.x)), least)
            whole = np.flatnonzero(~few)
            if len(whole):
                names, where = np.unique(part["anchor"][alive[whole]], return_index=True)
                score[whole] = _exact(part["v"][alive[whole[where]]], b.x, float(size.max()) * b.most)[np.searchsorted(names, part["anchor"][alive[whole]])]
            for i in np.flatnonzero(few):
                j = int((to[i] - at[i]).argmin())
                own = b.lists[int(focus[alive[i], j])][0][at[i, j] : to[i, j]]
                for other in np.delete(np.arange(c.shape[1]), j):
                    y = b.unit[own, focus[alive[i], other]]
                    own = own[(y >= low[i, other]) & (y <= high[i, other])]
                score[i, own] = _exact(part["v"][alive[i]][None], b.x[own], float(size[alive[i]]) * b.most)[0]
            fits = (labels[rows][None] == part["label"][alive, None]) == same
            fits &= (score >= bound[alive, None]) & (score <= part["high"][alive, None]) & (score != least) & (ids[rows][None] != part["anchor"][alive, None])
            score[~fits] = least
            if score.shape[1] > k:
                fits &= score >= np.partition(score, score.shape[1] - k, 1)[:, score.shape[1] - k, None]
            i, j = np.nonzero(fits)
            if len(i):
                best = [np.concatenate(y) for y in zip(best, (alive[i], ids[rows][j], score[i, j]))]
                keep = first_rows(best[0], best[2], best[1], k)
                best = [y[keep] for y in best]
                full = np.bincount(best[0], minlength=n) == k
                worst = np.full(n, np.iinfo(np.int64).max)
                np.minimum.at(worst, best[0], best[2])
                bound = np.where(full, np.maximum(bound, worst), bound)
        for y, new in zip(found, (best[0] + lo, best[1], best[2])):
            y.append(new)
    return tuple(np.concatenate(y) if y else np.zeros(0, np.int64) for y in found)


def _arrays(table: pa.Table, name: str) -> dict[str, np.ndarray]:
    v = table.column("v").combine_chunks()
    v = v.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(table), -1)
    return {"id": table.column(name).to_numpy(), "label": table.column("label").to_numpy(), "v": v}


def _scaled(vectors: DataFrame, s: Settings) -> DataFrame:
    """vec_id, label (a number for each), v: whole numbers; rows that take no part are gone."""
    x = F.col("embedding").cast("array<double>")
    fit = ~F.exists(x, lambda y: y.isNull() | F.isnan(y) | (F.abs(y) * s.scale > LONGEST)) & (F.size(x) > 0)
    rows = vectors.select("vec_id", "label", x.alias("embedding")).filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").filter(fit)
    label = F.col("label").cast("long") if isinstance(vectors.schema["label"].dataType, IntegralType) else F.xxhash64("label")
    rows = rows.select("vec_id", label.alias("label"), F.transform("embedding", lambda y: F.floor(s.scale * y).cast("int")).alias("v"))
    rows = rows.filter(F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, y: t + y.cast("double") * y)) <= LONGEST)
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v", F.size("r.v").alias("dim"))


def _in_blocks(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """``rows`` with ``name``, the number of their block, and how many blocks there are; a label lies in few of them."""
    n = max(1, -(-rows.count() // size))
    rows = cut(rows.repartitionByRange(n, "dim", "label", F.xxhash64(rows.columns[0])).withColumn(name, F.spark_partition_id()), name)
    return rows, (rows.agg(F.max(name)).first()[0] or 0) + 1


def _found(targets: DataFrame, rows: DataFrame, same: bool, k: int, s: Settings) -> DataFrame:
    """Targets and rows that share (a_block, block), searched: anchor_id, positive_score, vec_id, score."""

    def one(q: pa.Table, x: pa.Table) -> pa.Table:
        out = []
        for dim in np.intersect1d(q.column("dim").to_numpy(), x.column("dim").to_numpy()):
            own, other = (t.filter(pa.array(t.column("dim").to_numpy() == dim)) for t in (q, x))
            part = _arrays(own, "anchor_id")
            part |= {"anchor": part["id"], "low": own.column("low").to_numpy(), "high": own.column("high").to_numpy()}
            at, ids, score = search(part, _arrays(other, "vec_id"), same, k, s)
            out.append(pa.table({"anchor_id": part["id"][at], "positive_score": own.column("positive_score").to_numpy()[at], "vec_id": ids, "score": score}))
        empty = pa.array([], pa.int64())
        return pa.concat_tables(out) if out else pa.table({c: empty for c in ("anchor_id", "positive_score", "vec_id", "score")})

    by = ("a_block", "block")
    pairs = targets.groupBy(*by).cogroup(rows.groupBy(*by))
    return pairs.applyInArrow(one, "anchor_id long, positive_score long, vec_id long, score long")


def mine_hard_negatives(vectors: DataFrame, anchors: Column | str, settings: Settings = Settings()) -> DataFrame:
    """Positives and hard negatives of the rows (vec_id, label, embedding) of ``vectors`` for which ``anchors``, a condition
    on anchor_id (their vec_id), holds: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x); scores are inner products of these whole numbers, exact. Higher scores come
    first, ties by smaller vec_id. An anchor's positives are its first ``positives`` other rows of its label; its
    negatives for one of them the first ``negatives`` rows of other labels with a score of low to high per cent of the
    positive's. Every anchor meets every block of rows that can hold what it looks for; blocks are dealt by label and a hash, so copies and
    hot labels fill many, and inside them lengths and coordinate ranges prune.

    Rows with a null vec_id or label, a null or empty vector, a null or non-finite component, or a scaled length above 2**30 (whose
    scores need not fit in a long) take no part; vectors of different length never meet. Rows that repeat a vec_id count as one
    (the least label and vector). Anchors without a positive, and positives with no row in their range (which is empty
    below 0, and at 0 holds scores of 0 only), give no rows; an empty table gives none. Other columns are ignored.
    """
    s = settings
    with scratch(vectors.sparkSession) as keep:
        rows, n = _in_blocks(cut(_scaled(vectors, s), "scaled"), s.block, "block")
        asked, m = _in_blocks(rows.drop("block").withColumnRenamed("vec_id", "anchor_id").filter(anchors), s.anchors, "a_block")

        meet = asked.select("dim", "label", "a_block").distinct().join(rows.select("dim", "label", "block").distinct(), ["dim", "label"]).select("a_block", "block").distinct()
        meet = cut(meet, "meet")
        any_score = {"positive_score": F.lit(0).cast("long"), "low": F.lit(-(1 << 62)), "high": F.lit(1 << 62)}
        near = _found(asked.withColumns(any_score).join(meet, "a_block"), rows.join(meet, "block"), True, s.positives, s)
        first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))
        positives = near.withColumn("__n", first("anchor_id")).filter(F.col("__n") <= s.positives)
        positives = cut(positives.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

        p = F.col("positive_score")
        wide = "cast(positive_score AS decimal(20, 0))"
        low, high = F.expr(f"({s.low} * {wide} + 99) div 100"), F.expr(f"({s.high} * {wide}) div 100")
        ranges = positives.select("anchor_id", "positive_score").distinct().filter(p >= 0)  # below 0 the range is empty
        ranges = ranges.withColumns({"low": low.cast("long"), "high": high.cast("long")}).filter("low <= high")
        targets = cut(asked.join(ranges, "anchor_id"), "targets")
        each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
        far = _found(targets.withColumn("block", each(n)), rows.withColumn("a_block", each(m)), False, s.negatives, s)
        far = far.withColumn("rank", first("anchor_id", "positive_score")).filter(F.col("rank") <= s.negatives)
        out = positives.join(far, ["anchor_id", "positive_score"])
        return keep(out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
