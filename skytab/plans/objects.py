"""Queries over detections, polygons, points, jobs and telemetry text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import detections as det
from ..operators import geojson, jobs, points
from ..operators import overlaps as ov
from ..sources import telemetry
from . import bindings as b
from .tracks import r

QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# -- instances: vectors as 8 x 8 masks placed on a canvas ------------------------------------------


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "embeddings").select(F.col("label").alias("image"), F.col("vec_id").alias("instance"), F.posexplode("embedding").alias("i", "e")).filter("e > 0")
    k = F.col("instance")
    return rows.select("image", "instance", (F.col("i") % 8 + k * 37 % 12).cast("long").alias("px"), (F.floor(F.col("i") / 8) + k * 53 % 12).cast("long").alias("py"))


_PIXELS = "pixels AS (SELECT label AS image, vec_id AS instance, (i - 1) % 8 + vec_id * 37 % 12 AS px, (i - 1) // 8 + vec_id * 53 % 12 AS py FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings) WHERE embedding[i] > 0)"
_INSTANCES = _PIXELS + ", inst AS (SELECT image, instance, count(*) AS area, avg(px) AS cx, avg(py) AS cy, min(px) AS x1, min(py) AS y1, max(px) + 1 AS x2, max(py) + 1 AS y2, (SELECT round(embedding[1] + 0.6, 4) FROM embeddings WHERE vec_id = instance) AS score FROM pixels GROUP BY image, instance)"


def _instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = b.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("instance"), F.round(F.col("embedding")[0].cast("double") + 0.6, 4).alias("score"))
    return det.instance_stats(_pixels(spark, sf_dir), "image", "instance").join(score, "instance")


_INSTANCES = _INSTANCES.replace("round(embedding[1] + 0.6, 4)", "round(embedding[1]::DOUBLE + 0.6::DOUBLE, 4)")


@query(f"WITH {_INSTANCES} SELECT image, instance, area, round(cx, 4) AS cx, round(cy, 4) AS cy, x1, y1, x2, y2 FROM inst")
def mask_pixels_area_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = det.instance_stats(_pixels(spark, sf_dir), "image", "instance")
    return s.select("image", "instance", "area", r("cx", 4).alias("cx"), r("cy", 4).alias("cy"), "box.x1", "box.y1", "box.x2", "box.y2")


_PAIRS = _INSTANCES + """, near AS (SELECT p.image, p.instance AS a, q.instance AS b, p.area + q.area AS areas, sqrt((p.cx - q.cx) * (p.cx - q.cx) + (p.cy - q.cy) * (p.cy - q.cy)) AS distance,
  (least(p.x2, q.x2) - greatest(p.x1, q.x1)) * (least(p.y2, q.y2) - greatest(p.y1, q.y1)) AS bi, (p.x2 - p.x1) * (p.y2 - p.y1) + (q.x2 - q.x1) * (q.y2 - q.y1) AS boxes
  FROM inst p JOIN inst q ON p.image = q.image AND least(p.x2, q.x2) > greatest(p.x1, q.x1) AND least(p.y2, q.y2) > greatest(p.y1, q.y1)),
shared AS (SELECT x.image, x.instance AS a, y.instance AS b, count(*) AS inter FROM pixels x JOIN pixels y USING (image, px, py) GROUP BY ALL),
pairs AS (SELECT image, a, b, bi / (boxes - bi) AS box_iou, coalesce(inter, 0) / (areas - coalesce(inter, 0)) AS mask_iou, distance FROM near LEFT JOIN shared USING (image, a, b))"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    inst = _instances(spark, sf_dir)
    return inst.filter("instance % 2 = 0"), inst.filter("instance % 2 = 1")


def _masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ov.with_masks(_instances(spark, sf_dir), _pixels(spark, sf_dir), "image")


def _masked_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    inst = _masked(spark, sf_dir)
    return inst.filter("instance % 2 = 0"), inst.filter("instance % 2 = 1")


@query(f"WITH {_PAIRS} SELECT image, a, b, round(box_iou, 6) AS box_iou FROM pairs WHERE a % 2 = 0 AND b % 2 = 1")
def box_iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _sides(spark, sf_dir)
    p = det.same_box_pairs(before, after, "image", lambda a, b: r(det.box_iou(a, b), 6))
    return p.select("image", "a", "b", F.col("value").alias("box_iou"))


@query(f"WITH {_PAIRS} SELECT image, a, b, round(box_iou, 6) AS box_iou, round(mask_iou, 6) AS mask_iou, round(distance, 4) AS distance FROM pairs WHERE a % 2 = 0 AND b % 2 = 1")
def mask_iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ov.pairs_of(*_masked_sides(spark, sf_dir), "image", digits={"box_iou": 6, "mask_iou": 6, "distance": 4})


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = lambda p: det.may_be_one(p, most_distance=25.0)
    return ov.match_best(*_masked_sides(spark, sf_dir), "image", rule, lambda p: ov.rounded(det.change_score(p, 25.0), 9))


_WALK = """ranked AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, a DESC, b DESC) AS k FROM cand),
walk AS (SELECT image, 0::BIGINT AS k, []::BIGINT[] AS used_a, []::BIGINT[] AS used_b, -1::BIGINT AS a, -1::BIGINT AS b FROM (SELECT DISTINCT image FROM ranked) UNION ALL
  SELECT w.image, c.k, CASE WHEN list_contains(w.used_a, c.a) OR list_contains(w.used_b, c.b) THEN w.used_a ELSE list_append(w.used_a, c.a) END, CASE WHEN list_contains(w.used_a, c.a) OR list_contains(w.used_b, c.b) THEN w.used_b ELSE list_append(w.used_b, c.b) END,
   CASE WHEN list_contains(w.used_a, c.a) OR list_contains(w.used_b, c.b) THEN -1 ELSE c.a END, CASE WHEN list_contains(w.used_a, c.a) OR list_contains(w.used_b, c.b) THEN -1 ELSE c.b END FROM walk w JOIN ranked c ON c.image = w.image AND c.k = w.k + 1),
matched AS (SELECT c.* FROM cand c JOIN walk w USING (image, a, b))"""
_GREEDY = _PAIRS + """, cand AS (SELECT *, round(mask_iou + 0.25::DOUBLE * box_iou - distance / 25.0::DOUBLE, 9) AS score FROM pairs WHERE a % 2 = 0 AND b % 2 = 1 AND (mask_iou >= 0.1 OR box_iou >= 0.2) AND distance <= 25),
""" + _WALK


@query(f"WITH RECURSIVE {_GREEDY} SELECT image, a, b, round(score, 6) AS score FROM matched")
def match_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir).select("image", "a", "b", r("score", 6).alias("score"))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _sides(spark, sf_dir)
    return det.classify_changes(before, after, _matches(spark, sf_dir), "image")


_CHANGES = _GREEDY + """, m AS (SELECT x.*, p.area AS aa, q.area AS ba, p.score AS sa, q.score AS sb FROM matched x JOIN inst p ON p.image = x.image AND p.instance = x.a JOIN inst q ON q.image = x.image AND q.instance = x.b),
changes AS (SELECT image, a AS before_id, b AS after_id, CASE WHEN abs((ba - aa) / aa) >= 0.3 OR mask_iou < 0.5 THEN 'CHANGED_BUILDING' ELSE 'UNCHANGED' END AS classification, aa AS before_area, ba AS after_area, ba - aa AS area_change, (ba - aa) / aa * 100 AS pct, mask_iou, distance FROM m
  UNION ALL SELECT image, instance, NULL, 'REMOVED_BUILDING', area, 0, -area, -100, 0, NULL FROM inst i WHERE instance % 2 = 0 AND NOT EXISTS (SELECT 1 FROM matched x WHERE x.image = i.image AND x.a = i.instance)
  UNION ALL SELECT image, NULL, instance, 'NEW_BUILDING', 0, area, area, NULL, 0, NULL FROM inst i WHERE instance % 2 = 1 AND NOT EXISTS (SELECT 1 FROM matched x WHERE x.image = i.image AND x.b = i.instance))"""


@query(f"WITH RECURSIVE {_CHANGES} SELECT image, coalesce(before_id, -1) AS before_id, coalesce(after_id, -1) AS after_id, classification, before_area, after_area, area_change, round(pct, 4) AS area_change_percent, round(mask_iou, 6) AS mask_iou, round(distance, 4) AS centroid_distance FROM changes")
def change_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _changes(spark, sf_dir)
    own = [F.coalesce(k, F.lit(-1)).alias(k) for k in ("before_id", "after_id")]  # -1: none
    return c.select("image", *own, "classification", "before_area", "after_area", "area_change", r("area_change_percent", 4).alias("area_change_percent"), r("mask_iou", 6).alias("mask_iou"), r("centroid_distance", 4).alias("centroid_distance"))


@query(f"WITH RECURSIVE {_CHANGES} SELECT image, classification, count(*) AS n, sum(area_change)::BIGINT AS area_change FROM changes GROUP BY image, classification")
def change_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).groupBy("image", "classification").agg(F.count(F.lit(1)).alias("n"), F.sum("area_change").alias("area_change"))


# looser bounds than usual, since random masks of 64 pixels hardly overlap by half
def _nms(rule: str) -> str:
    return f"""WITH RECURSIVE {_PAIRS}, ranked AS (SELECT image, instance, row_number() OVER (PARTITION BY image ORDER BY score DESC, instance) AS k FROM inst), dup AS (SELECT image, a, b FROM pairs WHERE a <> b AND ({rule})),
dups AS (SELECT image, a, list(b) AS bs FROM dup GROUP BY image, a), todo AS (SELECT ranked.image, instance, k, coalesce(bs, []) AS bs FROM ranked LEFT JOIN dups ON dups.image = ranked.image AND a = instance),
walk AS (SELECT image, 0::BIGINT AS k, []::BIGINT[] AS kept FROM (SELECT DISTINCT image FROM ranked) UNION ALL SELECT w.image, c.k, CASE WHEN list_has_any(w.kept, c.bs) THEN w.kept ELSE list_append(w.kept, c.instance) END FROM walk w JOIN todo c ON c.image = w.image AND c.k = w.k + 1)
SELECT image, unnest(kept) AS instance FROM (SELECT image, arg_max(kept, k) AS kept FROM walk GROUP BY image)"""


@query(_nms("box_iou >= 0.4 AND mask_iou >= 0.2"))
def nms_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ov.suppress_overlapping(_masked(spark, sf_dir), "image", lambda p: (p["box_iou"] >= 0.4) & (p["mask_iou"] >= 0.2)).select("image", "instance")


@query(_nms("mask_iou >= 0.25 OR box_iou >= 0.5"))
def nms_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ov.suppress_overlapping(_masked(spark, sf_dir), "image", lambda p: (p["mask_iou"] >= 0.25) | (p["box_iou"] >= 0.5)).select("image", "instance")


def _rounded_iou(p: ov.Pairs):
    return ov.rounded(p["mask_iou"], 9)


@query(f"""WITH RECURSIVE {_PAIRS}, cand AS (SELECT image, a, b, round(mask_iou, 9) AS score FROM pairs WHERE a % 2 = 0 AND b % 2 = 1 AND round(mask_iou, 9) >= 0.05),
{_WALK}, n AS (SELECT (SELECT count(*) FROM matched) AS tp, (SELECT sum(score) FROM matched) AS s, (SELECT count(*) FROM inst WHERE instance % 2 = 0) AS p, (SELECT count(*) FROM inst WHERE instance % 2 = 1) AS t)
SELECT round(tp / p, 6) AS precision, round(tp / t, 6) AS recall, round(2 * tp / (p + t), 6) AS dice, coalesce(round(s / tp, 6), 0) AS matched_mask_iou, tp, p - tp AS fp, t - tp AS fn FROM n""")
def detection_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred, truth = _sides(spark, sf_dir)
    matches = ov.match_best(*_masked_sides(spark, sf_dir), "image", lambda p: _rounded_iou(p) >= 0.05, _rounded_iou)
    got = matches.groupBy("image").agg(F.count(F.lit(1)).alias("tp"), F.collect_list("score").alias("ious"))
    n = pred.groupBy("image").agg(F.count(F.lit(1)).alias("p")).join(truth.groupBy("image").agg(F.count(F.lit(1)).alias("t")), "image", "full_outer").join(got, "image", "left")
    tp = F.coalesce("tp", F.lit(0))
    counts = n.select(tp.alias("tp"), (F.coalesce("p", F.lit(0)) - tp).alias("fp"), (F.coalesce("t", F.lit(0)) - tp).alias("fn"), F.coalesce("ious", F.array().cast("array<double>")).alias("ious"))
    m = det.detection_metrics(counts)
    return m.select(*(r(c, 6).alias(c) for c in ("precision", "recall", "dice", "matched_mask_iou")), "tp", "fp", "fn")


_THRESHOLDS = [round(0.05 + 0.02 * k, 2) for k in range(10)]
_USUAL = [round(0.5 + 0.05 * k, 2) for k in range(10)]
_AP = _PAIRS + """, th AS (SELECT unnest($thresholds)::DOUBLE AS threshold), cand AS (SELECT threshold, image, a, list(b ORDER BY round(mask_iou, 9) DESC, b DESC) AS bs FROM pairs, th WHERE a % 2 = 0 AND b % 2 = 1 AND round(mask_iou, 9) >= threshold GROUP BY ALL),
ranked AS (SELECT th.threshold, i.image, i.instance AS a, score, coalesce(bs, []) AS bs, row_number() OVER (PARTITION BY th.threshold, i.image ORDER BY score DESC, i.instance) AS k FROM inst i CROSS JOIN th LEFT JOIN cand c ON c.threshold = th.threshold AND c.image = i.image AND c.a = i.instance WHERE i.instance % 2 = 0),
walk AS (SELECT DISTINCT threshold, image, 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS b FROM ranked
  UNION ALL SELECT w.threshold, w.image, r.k, CASE WHEN len(list_filter(r.bs, lambda z: NOT list_contains(w.used, z))) > 0 THEN list_append(w.used, list_filter(r.bs, lambda z: NOT list_contains(w.used, z))[1]) ELSE w.used END, list_filter(r.bs, lambda z: NOT list_contains(w.used, z))[1]
  FROM walk w JOIN ranked r ON r.threshold = w.threshold AND r.image = w.image AND r.k = w.k + 1),
hits AS (SELECT r.threshold, w.b IS NOT NULL AS hit, row_number() OVER o AS n, count(w.b) OVER o AS tp FROM ranked r JOIN walk w ON w.threshold = r.threshold AND w.image = r.image AND w.k = r.k WINDOW o AS (PARTITION BY r.threshold ORDER BY score DESC, r.image, r.a ROWS UNBOUNDED PRECEDING)),
ap AS (SELECT threshold, coalesce(sum(tp / n) FILTER (WHERE hit), 0) / (SELECT count(*) FROM inst WHERE instance % 2 = 1) AS ap FROM hits GROUP BY threshold)"""


def _precision(spark: SparkSession, sf_dir: str, thresholds: list[float]) -> DataFrame:
    pred, truth = _masked_sides(spark, sf_dir)
    turn = Window.partitionBy("image").orderBy(F.coalesce(-F.col("score"), F.lit(float("nan"))), "instance")
    pred = pred.withColumn("turn", -F.row_number().over(turn).cast("long"))
    hits = ov.match_best(pred, truth, "image", lambda p: _rounded_iou(p) >= min(thresholds), _rounded_iou, thresholds)
    each = pred.select("image", F.col("instance").alias("a"), "score", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    assigned = each.join(hits.select("threshold", "image", "a", F.lit(True).alias("hit")), ["threshold", "image", "a"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return det.average_precision(assigned, truth, "threshold", order=("image", "a"))


@query(f"WITH RECURSIVE {_AP.replace('$thresholds', str(_THRESHOLDS))} SELECT threshold, round(ap, 6) AS ap FROM ap")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At ten low thresholds, as random masks of 64 pixels hardly overlap by half."""
    return _precision(spark, sf_dir, _THRESHOLDS).select("threshold", r("ap", 6).alias("ap"))


@query(f"WITH RECURSIVE {_AP.replace('$thresholds', str(_USUAL))} SELECT round(avg(ap), 6) AS ap_50_95, round(max(ap) FILTER (WHERE threshold = 0.5), 6) AS ap_50 FROM ap")
def average_precision_50_95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean over the ten usual thresholds, and the first of them."""
    return _precision(spark, sf_dir, _USUAL).agg(r(F.avg("ap"), 6).alias("ap_50_95"), r(F.max(F.when(F.col("threshold") == 0.5, F.col("ap"))), 6).alias("ap_50"))


# -- pixel metrics over labels ---------------------------------------------------------------------

_METRICS = "sum(p * t) AS i, sum(p) AS p, sum(t) AS t, count(*) AS n"
_RATIOS = "(i + 1e-6) / (p + t - i + 1e-6) AS iou, (2 * i + 1e-6) / (p + t + 1e-6) AS dice, (i + 1e-6) / (p + 1e-6) AS precision, (i + 1e-6) / (t + 1e-6) AS recall"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("p"), F.col("toxic").alias("t"), F.floor(F.col("doc_id") / 32).alias("batch"), (F.col("doc_id") * 37 % 100 / 100.0).alias("prob"))


_LABELS = "l AS (SELECT doc_id, 1 - quality AS p, toxic AS t, doc_id // 32 AS batch, doc_id * 37 % 100 / 100.0::DOUBLE AS prob FROM labels)"
_NAMES = ("iou", "dice", "precision", "recall")


@query(f"WITH {_LABELS}, s AS (SELECT {_METRICS} FROM l) SELECT round(iou, 6) AS iou, round(dice, 6) AS dice, round(precision, 6) AS precision, round(recall, 6) AS recall, round(100.0 * p / n, 6) AS predicted_percent, round(100.0 * t / n, 6) AS actual_percent FROM (SELECT *, {_RATIOS} FROM s)")
def pixel_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = det.pixel_metrics(_labels(spark, sf_dir), F.col("p"), F.col("t"))
    return m.select(*(r(c, 6).alias(c) for c in (*_NAMES, "predicted_percent", "actual_percent")))


@query(f"WITH {_LABELS}, s AS (SELECT batch, {_METRICS} FROM l GROUP BY batch) SELECT count(*) AS batches, round(avg(iou), 6) AS iou, round(avg(dice), 6) AS dice, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall FROM (SELECT *, {_RATIOS} FROM s)")
def batch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = det.pixel_metrics(_labels(spark, sf_dir), F.col("p"), F.col("t"), "batch")
    return m.agg(F.count(F.lit(1)).alias("batches"), *(r(F.avg(c), 6).alias(c) for c in _NAMES))


@query(f"WITH {_LABELS}, x AS (SELECT th / 100.0::DOUBLE AS threshold, batch, CASE WHEN prob >= th / 100.0::DOUBLE THEN 1 ELSE 0 END AS p, t FROM l, (SELECT unnest([30, 35, 40, 45, 50, 55, 60, 65, 70]) AS th)), s AS (SELECT threshold, batch, {_METRICS} FROM x GROUP BY ALL) SELECT threshold, round(avg(iou), 6) AS iou, round(avg(dice), 6) AS dice, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall FROM (SELECT *, {_RATIOS} FROM s) GROUP BY threshold")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labels(spark, sf_dir).select("batch", "t", "prob", F.explode(F.array(*(F.lit(k / 100.0) for k in range(30, 75, 5)))).alias("threshold"))
    m = det.pixel_metrics(rows, F.when(F.col("prob") >= F.col("threshold"), 1).otherwise(0), F.col("t"), "threshold", "batch")
    return m.groupBy("threshold").agg(*(r(F.avg(c), 6).alias(c) for c in _NAMES))


# -- polygons --------------------------------------------------------------------------------------


def _polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of four to six points; by number some are unclosed, crossed, without area or too short."""
    k, s = F.col("p_partkey"), F.col("p_size").cast("double")
    point = lambda x, y: F.struct((x + 0.0).alias("x"), (y + 0.0).alias("y"))
    a, c, d, e = point(F.lit(0.25), F.lit(0.25)), point(s + 1, F.lit(0.25)), point(s + 2, s / 2 + 1), point(F.lit(0.5), s / 3 + 1)
    ring = (
        F.when(k % 7 == 1, F.array(a, c, d, e))
        .when(k % 7 == 2, F.array(a, d, c, e, a))
        .when(k % 7 == 3, F.array(a, c, a, c, a))
        .when(k % 7 == 4, F.array(a, c, a))
        .when(k % 7 == 5, F.array(a, c, point(F.lit(float("nan")), s), e, a))
        .otherwise(F.array(a, c, d, e, a))
    )
    return b.table(spark, sf_dir, "part").select("p_partkey", "p_size", ring.alias("ring"))


# the same rings as lists of points; what is wrong with one is worked out from its points
_RINGS = """ends AS (SELECT p_partkey, p_size, p_brand, p_partkey % 7 AS shape, {'x': 0.25::DOUBLE, 'y': 0.25::DOUBLE} AS a, {'x': p_size + 1.0::DOUBLE, 'y': 0.25::DOUBLE} AS c, {'x': p_size + 2.0::DOUBLE, 'y': p_size / 2.0::DOUBLE + 1} AS d, {'x': 0.5::DOUBLE, 'y': p_size / 3.0::DOUBLE + 1} AS e FROM part),
rings AS (SELECT p_partkey, p_size, p_brand, CASE shape WHEN 1 THEN [a, c, d, e] WHEN 2 THEN [a, d, c, e, a] WHEN 3 THEN [a, c, a, c, a] WHEN 4 THEN [a, c, a] WHEN 5 THEN [a, c, {'x': 'nan'::DOUBLE, 'y': p_size::DOUBLE}, e, a] ELSE [a, c, d, e, a] END AS ring FROM ends),
points AS (SELECT p_partkey, i, ring[i].x AS x, ring[i].y AS y FROM (SELECT *, unnest(range(1, len(ring) + 1)) AS i FROM rings)),
legs AS (SELECT p.p_partkey, p.i, p.x AS ax, p.y AS ay, q.x AS zx, q.y AS zy FROM points p JOIN points q ON q.p_partkey = p.p_partkey AND q.i = p.i + 1),
crossed AS (SELECT DISTINCT f.p_partkey FROM legs f JOIN legs g ON f.p_partkey = g.p_partkey AND g.i > f.i + 1
  AND sign((f.zx - f.ax) * (g.ay - f.ay) - (f.zy - f.ay) * (g.ax - f.ax)) * sign((f.zx - f.ax) * (g.zy - f.ay) - (f.zy - f.ay) * (g.zx - f.ax)) < 0
  AND sign((g.zx - g.ax) * (f.ay - g.ay) - (g.zy - g.ay) * (f.ax - g.ax)) * sign((g.zx - g.ax) * (f.zy - g.ay) - (g.zy - g.ay) * (f.zx - g.ax)) < 0),
odd AS (SELECT p_partkey, bool_or(NOT isfinite(x) OR NOT isfinite(y)) AS wild, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM points GROUP BY p_partkey),
areas AS (SELECT p_partkey, sum(ax * zy - zx * ay) / 2 AS area FROM legs GROUP BY p_partkey),
judged AS (SELECT r.*, area, x0, x1, y0, y1, CASE WHEN wild THEN 'non-finite' WHEN len(ring) < 4 THEN 'too few points' WHEN ring[1] <> ring[-1] THEN 'unclosed' WHEN abs(area) < 1e-12 THEN 'no area' WHEN c.p_partkey IS NOT NULL THEN 'self-crossing' ELSE 'valid' END AS validity
  FROM rings r JOIN odd USING (p_partkey) JOIN areas USING (p_partkey) LEFT JOIN crossed c USING (p_partkey))"""


@query(f"WITH {_RINGS} SELECT p_partkey, len(ring)::INT AS n_points, validity FROM judged")
def polygon_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _polygons(spark, sf_dir)
    return p.select("p_partkey", F.size("ring").alias("n_points"), geojson.validity(F.col("ring")).alias("validity"))


@query(f"WITH {_RINGS} SELECT p_partkey, round(area, 6) AS area, round(x0, 6) AS x0, round(-y1, 6) AS y0, round(x1, 6) AS x1, round(-y0, 6) AS y1, x0 >= 0 AND x1 <= 40 AND y0 >= 0 AND y1 <= 20 AS inside FROM judged WHERE validity = 'valid'")
def y_flip_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area, and bounds after the flip to annotation coordinates, of valid polygons."""
    p = _polygons(spark, sf_dir).filter(geojson.validity(F.col("ring")) == "valid").withColumn("flip", geojson.flip_y(F.col("ring")))
    x0, y0, x1, y1 = geojson.bounds(F.col("flip"))
    inside = geojson.within_image(F.col("flip"), F.lit(40.0), F.lit(20.0))
    return p.select("p_partkey", r(geojson.signed_area(F.col("ring")), 6).alias("area"), r(x0, 6).alias("x0"), r(y0, 6).alias("y0"), r(x1, 6).alias("x1"), r(y1, 6).alias("y1"), inside.alias("inside"))


@query(f"WITH {_RINGS} SELECT p_brand AS file, count(*) AS n, count(*) FILTER (WHERE validity = 'valid') AS n_valid, count(*) FILTER (WHERE validity <> 'valid') AS n_invalid, count(*) FILTER (WHERE validity = 'non-finite') AS n_nonfinite, sum(len(ring))::BIGINT AS n_points FROM judged GROUP BY p_brand")
def polygon_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _polygons(spark, sf_dir).join(b.table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey").withColumn("v", geojson.validity(F.col("ring")))
    return p.groupBy(F.col("p_brand").alias("file")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") == "valid").alias("n_valid"), F.count_if(F.col("v") != "valid").alias("n_invalid"), F.count_if(F.col("v") == "non-finite").alias("n_nonfinite"), F.sum(F.size("ring")).alias("n_points"))


@query(f"WITH {_RINGS}, w AS (SELECT *, validity = 'unclosed' AS was_repaired FROM judged) SELECT p_partkey, was_repaired, (len(ring) + was_repaired::INT)::INT AS n_points, validity = 'valid' OR (was_repaired AND abs(area + (ring[-1].x * ring[1].y - ring[1].x * ring[-1].y) / 2) >= 1e-12 AND p_partkey NOT IN (SELECT p_partkey FROM crossed)) AS is_valid FROM w")
def repaired_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unclosed rings are closed and put in the place of the originals."""
    p = _polygons(spark, sf_dir)
    fixed = p.filter(geojson.validity(F.col("ring")) == "unclosed").select("p_partkey", F.concat("ring", F.array(F.col("ring")[0])).alias("ring"))
    m = geojson.merge_repaired(p, fixed, "p_partkey")
    return m.select("p_partkey", "was_repaired", F.size("ring").alias("n_points"), (geojson.validity(F.col("ring")) == "valid").alias("is_valid"))


@query(f"""WITH {_RINGS}, w AS (SELECT *, validity = 'valid' OR (validity = 'unclosed' AND abs(area + (ring[-1].x * ring[1].y - ring[1].x * ring[-1].y) / 2) >= 1e-12 AND p_partkey NOT IN (SELECT p_partkey FROM crossed)) AS good FROM judged)
SELECT p_brand AS file, count(*) FILTER (WHERE validity <> 'valid') AS n_invalid, count(*) FILTER (WHERE validity <> 'valid' AND good) AS n_repaired, count(*) FILTER (WHERE NOT good) AS n_left, round(count(*) FILTER (WHERE validity <> 'valid' AND good) / nullif(count(*) FILTER (WHERE validity <> 'valid'), 0), 6) AS repaired_share FROM w GROUP BY p_brand""")
def repair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _polygons(spark, sf_dir).join(b.table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("file")), "p_partkey")
    fixed = p.filter(geojson.validity(F.col("ring")) == "unclosed").select("p_partkey", F.concat("ring", F.array(F.col("ring")[0])).alias("ring"))
    report = geojson.repair_report(p, geojson.merge_repaired(p, fixed, "p_partkey"), "p_partkey", group="file")
    return report.select("file", "n_invalid", "n_repaired", "n_left", r("repaired_share", 6).alias("repaired_share"))


_COVER = _RINGS + """, g AS (SELECT p_partkey, p_size, unnest(range(0, p_size + 3)) AS px FROM judged WHERE validity = 'valid'), h AS (SELECT *, unnest(range(0, p_size // 2 + 3)) AS py FROM g),
cover AS (SELECT h.p_partkey, px, py FROM h JOIN legs l ON l.p_partkey = h.p_partkey AND (l.ay > py + 0.5) <> (l.zy > py + 0.5) AND px + 0.5 < (l.zx - l.ax) * (py + 0.5 - l.ay) / (l.zy - l.ay) + l.ax GROUP BY ALL HAVING count(*) % 2 = 1)"""


@query(f"WITH {_COVER} SELECT p_partkey, count(*) AS n_pixels, min(px) AS x0, min(py) AS y0, max(px) AS x1, max(py) AS y1 FROM cover GROUP BY p_partkey")
def raster_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = _polygons(spark, sf_dir).filter(geojson.validity(F.col("ring")) == "valid")
    # dealt out first: few bytes of ``part`` are many pixels; by number, as few bytes would be put together again
    p = geojson.rasterize(valid.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey"))
    long = lambda c: c.cast("long")
    return p.groupBy("p_partkey").agg(F.count(F.lit(1)).alias("n_pixels"), long(F.min("px")).alias("x0"), long(F.min("py")).alias("y0"), long(F.max("px")).alias("x1"), long(F.max("py")).alias("y1"))


# -- points ----------------------------------------------------------------------------------------


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return b.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), "label", *(e[k].cast("double").alias(c) for k, c in enumerate("xyz")))


_POINTS = "pts AS (SELECT vec_id AS point_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"
_NEAR = _POINTS + """, nn AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY distance, other) AS rank FROM (SELECT p.point_id, p.label, q.point_id AS other, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2)) AS distance FROM pts p JOIN pts q ON p.label = q.label AND p.point_id <> q.point_id))"""


def _neighbours(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    rows = _points(spark, sf_dir)
    return points.nearest_neighbours(rows, k, points.cell_for(rows, k, "label"), block="label")


@query(f"WITH {_NEAR} SELECT point_id, arg_min(other, rank) AS other, round(min(distance), 6) AS distance, round(max(distance), 6) AS second FROM nn WHERE rank <= 2 GROUP BY point_id HAVING count(*) = 2 AND min(distance) < 0.75 * max(distance)")
def knn2_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = points.ratio_test(_neighbours(spark, sf_dir, 2))
    return t.select("point_id", "other", r("distance", 6).alias("distance"), r("second", 6).alias("second"))


@query(f"WITH {_NEAR}, m AS (SELECT point_id, avg(distance) AS mean_distance FROM nn WHERE rank <= 5 GROUP BY point_id) SELECT point_id, round(mean_distance, 6) AS mean_distance, mean_distance <= (SELECT avg(mean_distance) + 1.5 * stddev_samp(mean_distance) FROM m) AS inlier FROM m")
def outlier_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = points.mean_distance_outliers(_neighbours(spark, sf_dir, 5), 1.5)
    return o.select("point_id", r("mean_distance", 6).alias("mean_distance"), "inlier")


@query(f"WITH {_POINTS} SELECT label, round(quantile_cont(x, 0.01) - 5, 6) AS min_x, round(quantile_cont(y, 0.01) - 5, 6) AS min_y, round(quantile_cont(x, 0.99) + 5, 6) AS max_x, round(quantile_cont(y, 0.99) + 5, 6) AS max_y, round(median(z), 6) AS median_z FROM pts GROUP BY label")
def percentile_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = points.percentile_extent(_points(spark, sf_dir), "label")
    return e.select("label", *(r(c, 6).alias(c) for c in ("min_x", "min_y", "max_x", "max_y", "median_z")))


@query(f"""WITH {_POINTS}, m AS (SELECT *, 1.5 * (0.6 * x - 0.8 * y) + 10 + 0.1 * sin(point_id) AS u, 1.5 * (0.8 * x + 0.6 * y) - 20 + 0.1 * cos(point_id) AS v FROM pts),
s AS (SELECT avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv, covar_pop(x, u) + covar_pop(y, v) AS a, covar_pop(x, v) - covar_pop(y, u) AS b, var_pop(x) + var_pop(y) AS d FROM m)
SELECT round(sqrt(a * a + b * b) / d, 6) AS scale, round(a / sqrt(a * a + b * b), 6) AS r00, round(-b / sqrt(a * a + b * b), 6) AS r01, round(mu - (a * mx - b * my) / d, 6) AS shift_x, round(mv - (b * mx + a * my) / d, 6) AS shift_y FROM s""")
def similarity_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points moved in their plane, with noise; the oracle solves the plane case by sums of complex numbers."""
    p, x, y = _points(spark, sf_dir), F.col("x"), F.col("y")
    u, v = 1.5 * (0.6 * x - 0.8 * y) + 10 + 0.1 * F.sin("point_id"), 1.5 * (0.8 * x + 0.6 * y) - 20 + 0.1 * F.cos("point_id")
    pairs = p.select("x", "y", F.lit(0.0).alias("z"), u.alias("u"), v.alias("v"), F.lit(0.0).alias("w"))
    scale, rot, shift = points.similarity_transform(pairs)
    row = [round(float(c), 6) + 0.0 for c in (scale, rot[0][0], rot[0][1], shift[0], shift[1])]
    return spark.createDataFrame([row], "scale double, r00 double, r01 double, shift_x double, shift_y double")


_CELLS = "c AS (SELECT l_orderkey % 40 AS row, l_partkey % 50 AS col, l_linenumber AS frame, round(l_discount * 100) * l_quantity AS weight, round(l_extendedprice * 100) AS value FROM lineitem)"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 40).alias("row"), (F.col("l_partkey") % 50).alias("col"), F.col("l_linenumber").alias("frame"), (F.round(F.col("l_discount") * 100) * F.col("l_quantity")).alias("weight"), F.round(F.col("l_extendedprice") * 100).alias("value"))


@query(f"WITH {_CELLS}, k AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY weight DESC, frame) AS n FROM c WHERE weight > 0) SELECT row, col, frame, weight FROM k WHERE n = 1")
def best_frame_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.best_frame(_cells(spark, sf_dir), "row", "col")


@query(f"WITH {_CELLS} SELECT row, col, CASE WHEN sum(weight) > 1e-4 THEN sum(weight * value) / sum(weight) END AS value FROM c GROUP BY row, col")
def weighted_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.weighted_average(_cells(spark, sf_dir), "row", "col").select("row", "col", "value")


@query(f"WITH {_CELLS}, l AS (SELECT row, col, max(frame) AS label FROM c GROUP BY row, col) SELECT a.row, a.col, median(b.label)::DOUBLE AS label FROM l a JOIN l b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY a.row, a.col")
def label_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir).groupBy("row", "col").agg(F.max("frame").alias("label"))
    return points.median_smooth_labels(cells)


# -- jobs ------------------------------------------------------------------------------------------


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    status = F.when(s == "F", "COMPLETED").when(s == "O", "QUEUED").otherwise("PROCESSING")
    return b.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"), F.round("o_totalprice").cast("long").alias("elapsed"), F.col("o_orderpriority").alias("name"))


_JOBS = "jobs AS (SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'QUEUED' ELSE 'PROCESSING' END AS status, o_orderdate AS created_at, CAST(round(o_totalprice) AS BIGINT) AS elapsed, o_orderpriority AS name FROM orders)"


@query(f"WITH {_JOBS} SELECT name, count(*) AS n_jobs, count(*) FILTER (WHERE status = 'QUEUED') AS n_queued, count(*) FILTER (WHERE status = 'PROCESSING') AS n_processing, count(*) FILTER (WHERE status = 'COMPLETED') AS n_completed, 0::BIGINT AS n_failed, count(*) FILTER (WHERE status <> 'COMPLETED') AS active, avg(elapsed) AS mean_elapsed, max(elapsed) AS max_elapsed FROM jobs GROUP BY name")
def job_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.summary(_jobs(spark, sf_dir), "name")


@query(f"WITH {_JOBS} SELECT job_id, status, elapsed FROM jobs ORDER BY created_at DESC, job_id DESC LIMIT 50")
def jobs_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.last_jobs(_jobs(spark, sf_dir)).select("job_id", "status", "elapsed")


@query(f"WITH {_JOBS}, e AS (SELECT job_id % 500 AS job_id, created_at, CASE status WHEN 'QUEUED' THEN 1 WHEN 'PROCESSING' THEN 2 ELSE 3 END AS k, status FROM jobs) SELECT job_id, arg_max(status, (created_at, k)) AS status FROM e GROUP BY job_id")
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _jobs(spark, sf_dir).select((F.col("job_id") % 500).alias("job_id"), "status", F.col("created_at").alias("at"), F.lit(None).cast("string").alias("error"))
    return jobs.latest_state(e).select("job_id", "status")


# -- telemetry text --------------------------------------------------------------------------------

_CLOCK = "'%02d:%02d:%02d,%03d'"


def _render(rows: DataFrame, body) -> DataFrame:
    """One subtitle file a track out of rows with start and end in whole milliseconds."""
    clock = lambda c: F.format_string("%02d:%02d:%02d,%03d", F.floor(c / 3600000), F.floor(c / 60000) % 60, F.floor(c / 1000) % 60, c % 1000)
    ms = F.floor((F.col("rn") - 1) * 125 / 3).cast("long")
    block = F.concat(F.col("rn").cast("string"), F.lit("\n"), clock(ms), F.lit(" --> "), clock(ms + 40), F.lit('\n<font size="28">'), body, F.lit("</font>\n"))
    return rows.select("track_id", "rn", block.alias("block")).groupBy("track_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "block"))), lambda x: x["block"]), "\n").alias("content"))


@query(f"""WITH {b.TRACKS} SELECT track_id, rn AS index, round(floor((rn - 1) * 125 / 3) / 1000, 3) AS start_sec, round((floor((rn - 1) * 125 / 3) + 40) / 1000, 3) AS end_sec, rn AS frame_cnt, 41 AS diff_time_ms, '2024-05-01 10:00:00.416' AS timestamp_str, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude,
 100 + rn % 3 AS iso, '1/640.0' AS shutter, 2.8::DOUBLE AS fnum, CASE WHEN rn % 2 = 0 THEN 28.0 ELSE 24.0 END::DOUBLE AS focal_len, 0.7::DOUBLE AS ev, 5378 AS ct, 'default' AS color_md FROM tracks""")
def srt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks written as subtitle files, parsed back; the oracle has the tracks."""
    rows = b.tracks(spark, sf_dir)
    body = F.format_string("FrameCnt : %d, DiffTime : 41ms\n2024-05-01 10:00:00,416,841\n[iso : %d] [shutter : 1/640.0] [fnum : 280] [ev : 0.7] [ct : 5378] [color_md : default] [focal_len : %s] [latitude : %.6f] [longtitude : %.6f] [altitude: 214.707001]", F.col("rn"), 100 + F.col("rn") % 3, F.when(F.col("rn") % 2 == 0, "280").otherwise("240"), F.col("latitude"), F.col("longitude"))
    p = telemetry.parse_srt(_render(rows, body))
    long = lambda c: F.col(c).cast("long").alias(c)
    return p.select("track_id", long("index"), r("start_sec", 3).alias("start_sec"), r("end_sec", 3).alias("end_sec"), long("frame_cnt"), "diff_time_ms", "timestamp_str", r("latitude", 6).alias("latitude"), r("longitude", 6).alias("longitude"), long("iso"), "shutter", "fnum", "focal_len", "ev", "ct", "color_md")


_CASES = ["[latitude: 12.5] [alt: 1.5] [iso: 100]", "[latitude: north] lat: 5.0 [rel_alt: 1.2 abs_alt: 200.1] [iso: 100.0]", "[lat: 1.0] [LAT: 13.25] iso: 400", "latitude = -7.5, abs_alt: 200.1", "xlat: 2.0 [altitude: 9] [Altitude: 7] [gb_yaw: 350.5] [yaw: 1]", "nothing [iso: ]", "[latitude: 44] [yaw: -7]"]


def _dirty(names: list[str], loose: str, form: str, kind: str) -> str:
    """A field worked out in SQL: the last tag of the first name that is there, else what the loose pattern finds."""
    number = lambda x: f"CASE WHEN regexp_full_match(trim({x}), '{form}') THEN CAST(trim({x}) AS {kind}) END"
    tag = lambda n: f"vs[len(ks) - list_position(list_reverse(ks), '{n}') + 1]"
    whens = " ".join(f"WHEN list_contains(ks, '{n}') THEN {number(tag(n))}" for n in names)
    return f"CASE {whens} ELSE {number(f"nullif(regexp_extract(t, '{loose}', 1), '')")} END"


_DOUBLE = r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?"
_LOOSE = r"(?i)(?:{})\s*[:=]\s*([-+]?\d+\.?\d*)"


@query(rf"""WITH {b.TRACKS}, c AS (SELECT track_id, rn, [{", ".join(f"'{c}'" for c in _CASES)}][rn % 7 + 1] AS t FROM tracks),
k AS (SELECT *, list_transform(regexp_extract_all(t, '\[\s*([\w_]+)\s*[:=]\s*([^\]]+)\s*\]', 1), lambda x: lower(trim(x))) AS ks, list_transform(regexp_extract_all(t, '\[\s*([\w_]+)\s*[:=]\s*([^\]]+)\s*\]', 2), lambda x: trim(x)) AS vs FROM c)
SELECT track_id, rn AS index, {_dirty(["latitude", "lat"], _LOOSE.format("latitude|lat"), _DOUBLE, "DOUBLE")} AS latitude, {_dirty(["altitude", "alt", "rel_alt"], _LOOSE.format("altitude|alt|rel_alt"), _DOUBLE, "DOUBLE")} AS altitude,
 coalesce({_dirty(["iso"], r"(?i)\biso\s*[:=]\s*(\d+)", r"[+-]?\d+", "INT")}, -1) AS iso, {_dirty(["gb_yaw", "yaw"], _LOOSE.format("gb_yaw|yaw"), _DOUBLE, "DOUBLE")} AS yaw FROM k""")
def srt_dirty_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry with repeated, broken and missing tags; the oracle reads the same texts."""
    body = F.element_at(F.array(*map(F.lit, _CASES)), (F.col("rn") % 7 + 1).cast("int"))
    p = telemetry.parse_srt(_render(b.tracks(spark, sf_dir), body))
    return p.select("track_id", F.col("index").cast("long").alias("index"), "latitude", "altitude", F.coalesce("iso", F.lit(-1)).alias("iso"), "yaw")


@query("SELECT page_id, length(regexp_replace(html, '<[^>]+>', ' ', 'g')) AS n_chars, md5(regexp_replace(html, '<[^>]+>', ' ', 'g')) AS digest FROM pages")
def strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tx.strip_tags(F.col("html"))
    return b.table(spark, sf_dir, "pages").select("page_id", F.length(t).alias("n_chars"), F.md5(t).alias("digest"))


@query("""SELECT c_custkey, floor(a)::BIGINT AS d, floor((a - floor(a)) * 60)::BIGINT AS m, round_even(((a - floor(a)) * 60 - floor((a - floor(a)) * 60)) * 60 * 1000000, 0)::BIGINT AS s_num, round(CASE WHEN lat < 0 THEN -a ELSE a END, 7) AS decimal
 FROM (SELECT c_custkey, c_acctbal / 117 AS lat, abs(c_acctbal / 117) AS a FROM customer)""")
def dms_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 117).alias("lat")).withColumn("dms", tx.dms_rational(F.col("lat")))
    back = tx.dms_decimal(F.col("dms"), F.when(F.col("lat") < 0, "S").otherwise("N"))
    return rows.select("c_custkey", F.col("dms.d.num").alias("d"), F.col("dms.m.num").alias("m"), F.col("dms.s.num").alias("s_num"), r(back, 7).alias("decimal"))


@query(f"""WITH {b.IMAGES} SELECT event_id, 'drone-dji:GimbalRollDegree="' || printf('%+.2f', roll) || '"' || chr(10) || 'drone-dji:GimbalPitchDegree="' || printf('%+.2f', pitch) || '"' || chr(10) || 'drone-dji:GimbalYawDegree="' || printf('%+.2f', (yaw - 180 + 360) % 360) || '"'
 || CASE WHEN k % 10 <> 0 THEN chr(10) || 'drone-dji:RelativeAltitude="' || printf('%+.2f', agl) || '"' ELSE '' END || chr(10) || 'drone-dji:GpsLatitude="' || printf('%.8f', latitude) || '"' || chr(10) || 'drone-dji:GpsLongitude="' || printf('%.8f', longitude) || '"'
 || chr(10) || 'Camera:Yaw="' || printf('%.2f', (yaw - 180 + 360) % 360) || '"' || chr(10) || 'Camera:Pitch="' || printf('%.2f', pitch) || '"' || chr(10) || 'Camera:Roll="' || printf('%.2f', roll) || '"' AS attributes FROM images""")
def xmp_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("double")
    text = tx.xmp_attributes(F.col("yaw") - 180, F.col("pitch"), F.col("roll"), none, F.when(F.col("k") % 10 != 0, F.col("agl")), F.col("latitude"), F.col("longitude"), none)
    return b.images(spark, sf_dir).select("event_id", text.alias("attributes"))


@query(f"WITH {b.IMAGES} SELECT event_id, round((yaw - 180 + 360) % 360, 2) AS yaw, round(pitch, 2) AS pitch, round(roll, 2) AS roll, CASE WHEN k % 10 <> 0 THEN round(agl, 2) END AS agl, k % 10 <> 0 AS pose_is_known, abs(pitch + 90) < 5 AS is_nadir FROM images")
def xmp_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes written, parsed again and resolved by precedence; the oracle has the images."""
    tags = xmp_attributes(spark, sf_dir).withColumn("tags", tx.xmp_map(F.col("attributes")))
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    yaw, pitch, roll = (tx.pick(tag(f"Gimbal{k}Degree"), tag(k)) for k in ("Yaw", "Pitch", "Roll"))
    rows = tags.select("event_id", F.coalesce(yaw, F.lit(0.0)).alias("yaw"), F.coalesce(pitch, F.lit(-90.0)).alias("pitch"), F.coalesce(roll, F.lit(0.0)).alias("roll"), tx.pick(tag("RelativeAltitude")).alias("agl"), pitch.isNotNull().alias("has"))
    return rows.select("event_id", "yaw", "pitch", "roll", "agl", (F.col("has") & F.coalesce(F.col("agl") > 0, F.lit(False))).alias("pose_is_known"), (F.abs(F.col("pitch") + 90) < 5).alias("is_nadir"))


@query(f"WITH {b.TRACKS} SELECT track_id, rn AS frame_index, printf('frame_%06d.jpg', rn) AS filename, round(longitude, 6) AS lon, round(latitude, 6) AS lat, round(altitude, 3) AS alt FROM tracks")
def track_geojson_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point features written as text and read back."""
    from ..operators.sampling import frame_filename

    frames = b.tracks(spark, sf_dir).select("track_id", F.col("rn").alias("frame_index"), frame_filename(F.col("rn"), "jpeg").alias("filename"), "latitude", "longitude", "altitude", F.lit(None).cast("int").alias("iso"))
    f = geojson.point_features(frames)
    kind = "struct<type:string,id:bigint,geometry:struct<type:string,coordinates:array<double>>,properties:struct<filename:string,iso:int>>"
    p = f.select("track_id", F.from_json("feature", kind).alias("f"))
    c = F.col("f.geometry.coordinates")
    return p.select("track_id", F.col("f.id").alias("frame_index"), "f.properties.filename", r(c[0], 6).alias("lon"), r(c[1], 6).alias("lat"), r(c[2], 3).alias("alt"))


@query(f"WITH {b.TRACKS} SELECT track_id, count(*) + 1 AS n_features, round(min(longitude), 6) AS min_lon, round(max(latitude), 6) AS max_lat FROM tracks GROUP BY track_id")
def track_geojson_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = b.tracks(spark, sf_dir).select("track_id", F.col("rn").alias("frame_index"), "latitude", "longitude", "altitude")
    c = geojson.feature_collection(frames, "track_id")
    p = c.select("track_id", F.from_json("geojson", "struct<features:array<string>,bbox:array<double>>").alias("g"))
    return p.select("track_id", F.size("g.features").cast("long").alias("n_features"), F.col("g.bbox")[0].alias("min_lon"), F.col("g.bbox")[4].alias("max_lat"))
