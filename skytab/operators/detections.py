"""Relations between detected instances: overlap, one-to-one matching, suppression, changes, scores.

Masks are tables of pixels (key, instance, px, py); overlap joins are equi joins on pixels or grid
cells, so no pair of far instances is ever formed. Greedy rules run as rounds of joins, and in one task where little is left.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut, tidy
from . import greedy


def box_area(b: Column) -> Column:
    return F.greatest(F.lit(0), b["x2"] - b["x1"]) * F.greatest(F.lit(0), b["y2"] - b["y1"])


def box_intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(F.lit(0), w) * F.greatest(F.lit(0), h)


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union of half-open boxes, 0 where both are empty."""
    inter = box_intersection(a, b)
    union = box_area(a) + box_area(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def instance_stats(pixels: DataFrame, *keys: str) -> DataFrame:
    """For each instance of a pixel table (keys, px, py): area, centroid (cx, cy) and half-open box."""
    box = F.struct(F.min("px").alias("x1"), F.min("py").alias("y1"), (F.max("px") + 1).alias("x2"), (F.max("py") + 1).alias("y2"))
    return pixels.groupBy(*keys).agg(F.count(F.lit(1)).alias("area"), F.avg("px").alias("cx"), F.avg("py").alias("cy"), box.alias("box"))


def overlapping_pairs(a: DataFrame, b: DataFrame, key: str, cell: int = 16, left: str = "a", right: str = "b") -> DataFrame:
    """Pairs of rows of ``a`` and ``b`` (key, instance, box, ...) of one key whose boxes overlap: key, and the
    structs left and right. Boxes meet in grid cells; a pair counts in the cell of its overlap's corner."""

    def cells(df: DataFrame, name: str) -> DataFrame:
        span = lambda lo, hi: F.sequence(F.floor(F.col(f"box.{lo}") / cell), F.floor((F.col(f"box.{hi}") - 1) / cell))
        rows = df.filter("box.x2 > box.x1 AND box.y2 > box.y1").select(key, F.struct(*(c for c in df.columns if c != key)).alias(name), F.explode(span("x1", "x2")).alias("gx"), "box")
        return rows.select(key, name, "gx", F.explode(span("y1", "y2")).alias("gy"))

    both = cells(a, left).join(cells(b, right), [key, "gx", "gy"])
    p, q = F.col(left)["box"], F.col(right)["box"]
    first = (F.floor(F.greatest(p["x1"], q["x1"]) / cell) == F.col("gx")) & (F.floor(F.greatest(p["y1"], q["y1"]) / cell) == F.col("gy"))
    return both.filter(first & (box_intersection(p, q) > 0)).select(key, left, right)


def same_box_pairs(a: DataFrame, b: DataFrame, key: str, value: Callable[[Column, Column], Column]) -> DataFrame:
    """Pairs of instances of one key whose boxes overlap: key, a, b, value of their boxes, which is worked out once for a pair of different boxes."""
    boxes = lambda df: df.select(key, "box").distinct()
    unlike = cut(overlapping_pairs(boxes(a), boxes(b), key).select(key, F.col("a.box").alias("box_a"), F.col("b.box").alias("box_b"), value(F.col("a.box"), F.col("b.box")).alias("value")), "boxes")
    some = unlike.join(cut(a.select(key, F.col("box").alias("box_a"), F.col("instance").alias("a")), "boxed"), [key, "box_a"])
    return some.join(cut(b.select(key, F.col("box").alias("box_b"), F.col("instance").alias("b")), "boxed"), [key, "box_b"]).select(key, "a", "b", "value")


def mask_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Shared pixels of instances of two pixel tables (key, instance, px, py): key, a, b, inter."""
    x = a.select(key, "px", "py", F.col("instance").alias("a"))
    return x.join(b.select(key, "px", "py", F.col("instance").alias("b")), [key, "px", "py"]).groupBy(key, "a", "b").agg(F.count(F.lit(1)).alias("inter"))


def pair_overlaps(a: DataFrame, b: DataFrame, pixels_a: DataFrame, pixels_b: DataFrame, key: str) -> DataFrame:
    """Of instances (key, instance, area, cx, cy, box) whose boxes overlap: key, a, b, box_iou, mask_iou, distance."""
    pairs = overlapping_pairs(a, b, key).select(key, F.col("a.instance").alias("ia"), F.col("b.instance").alias("ib"), box_iou(F.col("a.box"), F.col("b.box")).alias("box_iou"), (F.col("a.area") + F.col("b.area")).alias("areas"), F.sqrt(F.pow(F.col("a.cx") - F.col("b.cx"), 2) + F.pow(F.col("a.cy") - F.col("b.cy"), 2)).alias("distance"))
    shared = mask_overlap(pixels_a, pixels_b, key).withColumnsRenamed({"a": "ia", "b": "ib"})
    both = pairs.join(shared, [key, "ia", "ib"], "left").withColumn("inter", F.coalesce("inter", F.lit(0)))
    union = F.col("areas") - F.col("inter")
    return both.select(key, F.col("ia").alias("a"), F.col("ib").alias("b"), "box_iou", F.when(union > 0, F.col("inter") / union).otherwise(0.0).alias("mask_iou"), "distance")


@tidy("matches")
def match_one_to_one(candidates: DataFrame, key: str, score: str = "score", a: str = "a", b: str = "b", small: int = greedy.SMALL) -> DataFrame:
    """Greedy matching: pairs by descending (score, a, b), each side used once. Rows of ``candidates`` that match.

    A pair that is the best one left of both its sides is what the greedy rule takes; a round takes all of those and drops
    what they use. Ties are settled by the ids, so the order is total and the rounds give the greedy result. After two
    rounds, what is left of a key is settled in one task if it is at most ``small`` rows; for larger keys the rounds go on, and
    pairs that one better pair alone stands against are settled along the whole chain of such pairs at once.
    """
    numbered = cut(candidates.withColumn("__id", F.monotonically_increasing_id()), "candidates")
    left, done, turn = numbered.select(key, "__id", F.col(score).alias("__s"), F.col(a).alias("__a"), F.col(b).alias("__b")), None, 0
    rank = [F.desc("__s"), F.desc("__a"), F.desc("__b")]

    def loop(rows: pa.Table) -> pa.Table:
        order = rows.sort_by([("__s", "descending"), ("__a", "descending"), ("__b", "descending")])
        used_a, used_b, keep = set(), set(), []
        for i, (x, y) in enumerate(zip(order.column("__a").to_pylist(), order.column("__b").to_pylist())):
            if x not in used_a and y not in used_b:
                used_a.add(x)
                used_b.add(y)
                keep.append(i)
        return order.select(["__id"]).take(pa.array(keep, pa.int64()))

    def take(state: DataFrame, taken: str) -> DataFrame:
        """What is left of ``state`` and what has been taken of it, by the column ``taken``."""
        used = lambda side: F.max(taken).over(Window.partitionBy(key, side))
        return state.withColumns({"__ua": used("__a"), "__ub": used("__b")}).filter(F.col(taken) | ~(F.col("__ua") | F.col("__ub"))).drop("__ua", "__ub")

    while True:
        better = lambda side: F.row_number().over(Window.partitionBy(key, side).orderBy(*rank)) - 1
        state = left.withColumns({"__na": better("__a"), "__nb": better("__b")})
        state = cut(take(state.withColumn("__taken", F.col("__na") + F.col("__nb") == 0), "__taken"), "candidates")
        new = state.filter("__taken").select("__id")
        done = new if done is None else done.unionByName(new)
        left, turn = state.filter("NOT __taken").select(key, "__id", "__s", "__a", "__b"), turn + 1
        if left.isEmpty():
            break
        if turn == greedy.ROUNDS:
            settled, left = greedy.settle_small(left, [key], loop, "__id long", small)
            done = done.unionByName(settled)
            if left is None:
                break
        if turn >= greedy.ROUNDS:
            near = lambda side: Window.partitionBy(key, side).orderBy(*rank)
            state = left.withColumns({"__na": better("__a"), "__nb": better("__b"), "__pa": F.lag("__id").over(near("__a")), "__pb": F.lag("__id").over(near("__b"))})
            state = cut(state.withColumn("__only", F.when(F.col("__na") + F.col("__nb") == 1, F.coalesce("__pa", "__pb"))), "chained")
            known = greedy.taken_along_chains(state, [key], "__id", "__only", F.col("__na") + F.col("__nb") == 0)
            state = left.join(known.filter("taken").select("__id", F.lit(True).alias("__taken")), "__id", "left").withColumn("__taken", F.coalesce("__taken", F.lit(False)))
            state = cut(take(state, "__taken"), "candidates")
            done = done.unionByName(state.filter("__taken").select("__id"))
            left = state.filter("NOT __taken").drop("__taken")
            if left.isEmpty():
                break
    return numbered.join(done, "__id", "left_semi").drop("__id")


def accept(detections: DataFrame, pixels: DataFrame, key: str, least_score: float, least_mask: float = 0.5) -> DataFrame:
    """Detections (key, instance, score, ...) of at least ``least_score`` with a mask that is not empty: with the
    statistics of the pixels (key, instance, px, py, mask) that reach ``least_mask``."""
    stats = instance_stats(pixels.filter(F.col("mask") >= least_mask), key, "instance")
    return detections.filter(F.col("score") >= least_score).join(stats, [key, "instance"])


def centroid(stats: DataFrame) -> DataFrame:
    """``stats`` with cx and cy, for an instance without pixels (null) the middle of its box."""
    return stats.withColumns({"cx": F.coalesce("cx", (F.col("box.x1") + F.col("box.x2")) / 2), "cy": F.coalesce("cy", (F.col("box.y1") + F.col("box.y2")) / 2)})


def detection_rows(detections: DataFrame, key: str) -> DataFrame:
    """Detections (key, instance, score, box, tile) as rows of a detection file, without masks: instance_id from 1 by
    descending score (ties: lower instance), mask_path, and all of it as a JSON text."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "instance")
    rows = detections.withColumn("instance_id", F.row_number().over(w)).withColumn("mask_path", F.format_string("masks/instance_%04d.png", "instance_id"))
    array = lambda b: F.array(*(b[c] for c in ("x1", "y1", "x2", "y2")))
    text = F.struct(array(F.col("box")).alias("box"), "score", F.col(key).alias("source_image"), "instance_id", "mask_path")
    return rows.withColumn("detection", F.to_json(text))


def write_change_set(changes: DataFrame, path: str, pair: str = "pair") -> None:
    """Changes as JSON lines, one folder a pair; any number of pairs in one job."""
    changes.repartition(pair).write.partitionBy(pair).json(path)


def change_of_instance(instances: DataFrame, changes: DataFrame, key: str, side: str = "before_id", default: str = "UNCHANGED") -> DataFrame:
    """``instances`` with the classification of their first change (by the other side's id, none last), by which they are coloured."""
    other = "after_id" if side == "before_id" else "before_id"
    order = F.struct(F.col(other).isNull(), F.col(other))
    first = changes.filter(F.col(side).isNotNull()).groupBy(key, F.col(side).alias("instance")).agg(F.min_by("classification", order).alias("classification"))
    return instances.join(first, [key, "instance"], "left").withColumn("classification", F.coalesce("classification", F.lit(default)))


def may_be_one(pair, least_mask_iou: float = 0.1, least_box_iou: float = 0.2, most_distance: float = 250.0):
    """Whether before and after may be one building, of the measures (Columns or arrays) by name."""
    return ((pair["mask_iou"] >= least_mask_iou) | (pair["box_iou"] >= least_box_iou)) & (pair["distance"] <= most_distance)


def change_score(pair, most_distance: float = 250.0):
    return pair["mask_iou"] + 0.25 * pair["box_iou"] - pair["distance"] / max(most_distance, 1.0)


def change_candidates(pairs: DataFrame, least_mask_iou: float = 0.1, least_box_iou: float = 0.2, most_distance: float = 250.0) -> DataFrame:
    """Pairs of before and after that may be one building, with their score."""
    return pairs.filter(may_be_one(pairs, least_mask_iou, least_box_iou, most_distance)).withColumn("score", change_score(pairs, most_distance))


def classify_changes(before: DataFrame, after: DataFrame, matches: DataFrame, key: str, area_change: float = 0.30, least_mask_iou: float = 0.50) -> DataFrame:
    """Matched, removed and new buildings: key, before_id, after_id, classification, areas, change and overlaps."""
    a = before.select(key, F.col("instance").alias("a"), F.col("area").alias("before_area"), F.col("score").alias("before_score"))
    b = after.select(key, F.col("instance").alias("b"), F.col("area").alias("after_area"), F.col("score").alias("after_score"))
    both = matches.select(key, "a", "b", "mask_iou", "box_iou", "distance").join(a, [key, "a"]).join(b, [key, "b"])
    share = F.when(F.col("before_area") > 0, (F.col("after_area") - F.col("before_area")) / F.col("before_area")).otherwise(0.0)
    changed = (F.abs(share) >= area_change) | (F.col("mask_iou") < least_mask_iou)
    out = ["before_id", "after_id", "classification", "before_area", "after_area", "area_change", "area_change_percent", "mask_iou", "bounding_box_iou", "centroid_distance", "before_score", "after_score"]

    def rows(df: DataFrame, **columns) -> DataFrame:
        return df.select(key, *(columns[c].alias(c) for c in out))

    none = lambda t: F.lit(None).cast(t)
    zero, c = F.lit(0.0), F.col
    kind = dict(a.dtypes)["a"]
    long = lambda x: x.cast("long")
    matched = rows(both, before_id=c("a"), after_id=c("b"), classification=F.when(changed, "CHANGED_BUILDING").otherwise("UNCHANGED"), before_area=long(c("before_area")), after_area=long(c("after_area")), area_change=long(c("after_area") - c("before_area")), area_change_percent=share * 100.0, mask_iou=c("mask_iou"), bounding_box_iou=c("box_iou"), centroid_distance=c("distance"), before_score=c("before_score"), after_score=c("after_score"))
    removed = a.join(matches.select(key, "a"), [key, "a"], "left_anti")
    removed = rows(removed, before_id=c("a"), after_id=none(kind), classification=F.lit("REMOVED_BUILDING"), before_area=long(c("before_area")), after_area=long(F.lit(0)), area_change=long(-c("before_area")), area_change_percent=F.lit(-100.0), mask_iou=zero, bounding_box_iou=zero, centroid_distance=none("double"), before_score=c("before_score"), after_score=none("double"))
    new = b.join(matches.select(key, "b"), [key, "b"], "left_anti")
    new = rows(new, before_id=none(kind), after_id=c("b"), classification=F.lit("NEW_BUILDING"), before_area=long(F.lit(0)), after_area=long(c("after_area")), area_change=long(c("after_area")), area_change_percent=none("double"), mask_iou=zero, bounding_box_iou=zero, centroid_distance=none("double"), before_score=none("double"), after_score=c("after_score"))
    return matched.unionByName(removed).unionByName(new)


@tidy("kept")
def suppress(instances: DataFrame, duplicates: DataFrame, key: str, small: int = greedy.SMALL) -> DataFrame:
    """Instances (key, instance, score) that stay when, by descending score (ties: lower instance first), one goes if
    it duplicates one that stays. duplicates: pairs (key, a, b) either way round.

    In a round, instances without an undecided or kept better duplicate stay, and those with a kept better one go. After two rounds, keys with
    at most ``small`` pairs left are settled in one task each; for larger ones the rounds go on, and instances with one
    better duplicate alone are settled along the whole chain of such instances at once.
    """
    rank = instances.select(key, "instance", "score")
    a = rank.select(key, F.col("instance").alias("a"), F.col("score").alias("sa"))
    b = rank.select(key, F.col("instance").alias("b"), F.col("score").alias("sb"))
    both = duplicates.select(key, "a", "b").join(a, [key, "a"]).join(b, [key, "b"])
    lower = (F.col("sa") > F.col("sb")) | ((F.col("sa") == F.col("sb")) & (F.col("a") < F.col("b")))
    better = both.select(key, F.when(lower, F.col("a")).otherwise(F.col("b")).alias("up"), F.when(lower, F.col("b")).otherwise(F.col("a")).alias("instance"), F.least("sa", "sb").alias("s")).filter("up <> instance").distinct()
    better, gone, turn = cut(better, "better"), None, 0

    def loop(rows: pa.Table) -> pa.Table:
        order = rows.sort_by([("s", "descending"), ("instance", "ascending")])
        out: dict = {}
        for x, up in zip(order.column("instance").to_pylist(), order.column("up").to_pylist()):
            out[x] = out.get(x, False) or not out.get(up, False)  # those above have been settled before
        lost = [x for x, off in out.items() if off]
        return pa.table({key: rows.column(key).slice(0, 1).take(pa.array([0] * len(lost), pa.int64())), "instance": pa.array(lost, rows.schema.field("instance").type)})

    def drop(state: DataFrame) -> DataFrame:
        """``state`` with __lost, without pairs whose better one is lost."""
        lost = state.filter("__lost").select(key, F.col("instance").alias("up")).distinct().withColumn("__off", F.lit(True))
        return state.join(lost, [key, "up"], "left").filter("__lost OR __off IS NULL").drop("__off")

    kinds = dict(better.dtypes)
    while not better.isEmpty():
        if turn == greedy.ROUNDS:
            settled, better = greedy.settle_small(better, [key], loop, f"{key} {kinds[key]}, instance {kinds['instance']}", small)
            gone = settled if gone is None else gone.unionByName(settled)
            if better is None:
                break
        if turn >= greedy.ROUNDS:
            nodes = better.groupBy(key, "instance").agg(F.count(F.lit(1)).alias("__n"), F.max("up").alias("__up"))
            tops = better.select(key, F.col("up").alias("instance")).distinct().join(nodes.select(key, "instance"), [key, "instance"], "left_anti")
            nodes = cut(nodes.select(key, "instance", F.when(F.col("__n") == 1, F.col("__up")).alias("__only"), F.lit(False).alias("__top")).unionByName(tops.select(key, "instance", F.lit(None).cast(kinds["up"]).alias("__only"), F.lit(True).alias("__top"))), "nodes")
            known = cut(greedy.taken_along_chains(nodes, [key], "instance", "__only", F.col("__top")).withColumnRenamed("taken", "__kept"), "known")
            below = known.filter("__kept").select(key, F.col("instance").alias("up"), F.lit(True).alias("__beaten"))
            state = better.join(below, [key, "up"], "left").join(known, [key, "instance"], "left")
            lost = F.max(F.coalesce("__beaten", F.lit(False)) | ~F.coalesce("__kept", F.lit(True))).over(Window.partitionBy(key, "instance"))
            state = cut(drop(state.withColumn("__lost", lost).select(key, "up", "instance", "s", "__lost")), "better")
            new = state.filter("__lost").select(key, "instance").distinct()
            gone, better = gone.unionByName(new), state.filter("NOT __lost").drop("__lost")
        # an instance that is below none that is left stays; what it beats goes
        below = better.select(key, F.col("instance").alias("up")).distinct().withColumn("__below", F.lit(True))
        state = better.join(below, [key, "up"], "left").withColumn("__lost", F.max(F.col("__below").isNull()).over(Window.partitionBy(key, "instance")))
        state = cut(drop(state.select(key, "up", "instance", "s", "__lost")), "better")
        new = state.filter("__lost").select(key, "instance").distinct()
        gone = new if gone is None else gone.unionByName(new)
        better, turn = state.filter("NOT __lost").drop("__lost"), turn + 1
    return instances if gone is None else instances.join(gone, [key, "instance"], "left_anti")


def detection_metrics(counts: DataFrame) -> DataFrame:
    """Of rows (tp, fp, fn, ious: array) one row: precision, recall, dice, matched_mask_iou, tp, fp, fn."""
    total = counts.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.sum(F.aggregate("ious", F.lit(0.0), lambda s, x: s + x)).alias("s"), F.sum(F.size("ious")).alias("n"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return total.select(ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("dice"), ratio(F.col("s"), F.col("n")).alias("matched_mask_iou"), "tp", "fp", "fn")


@tidy("assigned")
def assign_truths(detections: DataFrame, pairs: DataFrame, threshold: float | Column, *keys: str, small: int = greedy.SMALL) -> DataFrame:
    """``detections`` (keys, a, score) with hit: by descending score (ties: lower a), each takes its best free
    truth b of ``pairs`` (keys, a, b, mask_iou; ties: higher b) if that reaches the threshold.

    In a round every detection asks for its best truth left, and a truth drops all pairs with detections that
    come after the first that asks for it, for they can never have it. When no pair is dropped, all have what the
    loop in order of score would give them. After two rounds, groups of keys with at most ``small`` pairs left are settled in one task each.
    """
    turn = F.struct(F.coalesce(-F.col("score"), F.lit(float("nan"))).alias("score"), "a")
    left = pairs.filter(F.col("mask_iou") >= threshold).select(*keys, "a", "b", "mask_iou").join(detections.select(*keys, "a", turn.alias("turn")), [*keys, "a"])
    left = cut(left, "asks")
    n, rounds, hits = left.count(), 0, None
    kinds = dict(left.dtypes)

    def loop(rows: pa.Table) -> pa.Table:
        asks: dict = {}
        for x, y, iou, at in zip(*(rows.column(c).to_pylist() for c in ("a", "b", "mask_iou", "turn"))):
            asks.setdefault((at["score"] != at["score"], at["score"], x), []).append((iou, y))
        used, hit = set(), []
        for place in sorted(asks):
            for _, y in sorted(asks[place], reverse=True):
                if y not in used:
                    used.add(y)
                    hit.append(place[2])
                    break
        first = pa.array([0] * len(hit), pa.int64())
        return pa.table({**{k: rows.column(k).slice(0, 1).take(first) for k in keys}, "a": pa.array(hit, rows.schema.field("a").type)})

    while True:
        asks = left.groupBy(*keys, "a").agg(F.max(F.struct("mask_iou", "b")).alias("best"), F.min("turn").alias("turn"))
        asks = asks.select(*keys, "a", F.col("best.b").alias("b"), "turn")
        first = asks.groupBy(*keys, "b").agg(F.min("turn").alias("first"))
        rest = cut(left.join(first, [*keys, "b"], "left").filter("first IS NULL OR turn <= first").drop("first"), "asks")
        before, n, left, rounds = n, rest.count(), rest, rounds + 1
        if n == before:
            break
        if rounds == greedy.ROUNDS and keys:
            hits, left = greedy.settle_small(left, [*keys], loop, ", ".join(f"{k} {kinds[k]}" for k in (*keys, "a")), small)
            if left is None:
                break
            n = left.count()
    if left is not None:
        own = left.select(*keys, "a").distinct()
        hits = own if hits is None else hits.unionByName(own)
    return detections.join(hits.withColumn("hit", F.lit(True)), [*keys, "a"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def average_precision(assigned: DataFrame, truths: DataFrame, *keys: str, order: tuple[str, ...] = ()) -> DataFrame:
    """For each of ``keys`` (such as a threshold) the area under precision over recall, as rectangles, of rows
    (keys, score, hit) by descending score, ties by ``order``: keys, ap. truths: all truths, for each key the same.

    Ranks come from counts of score buckets first, so that no window holds all rows of a key: the
    precision at a hit needs only how many hits and rows go before it.
    """
    ranked = assigned.withColumn("__g", F.floor(F.coalesce("score", F.lit(0.0)) * 64))
    buckets = ranked.groupBy(*keys, "__g").agg(F.count_if("hit").alias("__h"), F.count(F.lit(1)).alias("__c"))
    above = Window.partitionBy(*keys).orderBy(F.desc("__g")).rowsBetween(Window.unboundedPreceding, -1)  # 65 buckets for scores in 0..1
    before = lambda c: F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above")
    buckets = buckets.select(*keys, "__g", before("__h"), before("__c"))
    w = Window.partitionBy(*keys, "__g").orderBy(F.desc("score"), *order).rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranked.join(buckets, [*keys, "__g"]).withColumns({"__tp": F.sum(F.col("hit").cast("long")).over(w) + F.col("__h_above"), "__n": F.sum(F.lit(1)).over(w) + F.col("__c_above")})
    n = truths.agg(F.count(F.lit(1)).alias("__truths"))  # one row
    sums = ranked.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("hit"), F.col("__tp") / F.col("__n"))), F.lit(0.0)).alias("__s"))
    return sums.join(F.broadcast(n)).select(*keys, F.coalesce(F.col("__s") / F.nullif("__truths", F.lit(0)), F.lit(0.0)).alias("ap"))


def pixel_metrics(df: DataFrame, p: Column, t: Column, *keys: str, eps: float = 1e-6) -> DataFrame:
    """IoU, dice, precision and recall of predicted against true pixels (0 or 1), and their shares in percent."""
    s = df.groupBy(*keys).agg(F.sum(p * t).alias("i"), F.sum(p).alias("p"), F.sum(t).alias("t"), F.count(F.lit(1)).alias("n"))
    i, ps, ts = F.col("i"), F.col("p"), F.col("t")
    return s.select(*keys, ((i + eps) / (ps + ts - i + eps)).alias("iou"), ((2 * i + eps) / (ps + ts + eps)).alias("dice"), ((i + eps) / (ps + eps)).alias("precision"), ((i + eps) / (ts + eps)).alias("recall"), (100.0 * ps / F.col("n")).alias("predicted_percent"), (100.0 * ts / F.col("n")).alias("actual_percent"))
