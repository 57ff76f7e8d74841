"""Queries over polygons by their edges. All corners lie on whole numbers and all edges run along a side or a diagonal of a
unit square, so areas follow in SQL from quarter squares, cut by both diagonals, without a crossing being worked out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import polygons
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


_FIGURES = {
    "angle": [(0, 0), (6, 0), (6, 2), (2, 2), (2, 6), (0, 6)],
    "clamp": [(0, 0), (8, 0), (8, 6), (6, 6), (6, 2), (2, 2), (2, 6), (0, 6)],
    "diamond": [(3, 0), (6, 3), (3, 6), (0, 3)],
    "bow tie": [(0, 0), (4, 4), (4, 0), (0, 4)],
}


def _at(points: list[tuple[int, int]], x: Column, y: Column) -> Column:
    return F.array(*(F.struct((x + p).cast("double").alias("x"), (y + q).cast("double").alias("y")) for p, q in [*points, points[0]]))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, dealt out before its few bytes a row become polygons."""
    return b.table(spark, sf_dir, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")


def _figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as outlines, strewn over a strip for each brand."""
    k = F.col("p_partkey")
    x, y = k * 37 % 97, F.floor(k / 100) * 3 + k * 13 % 7
    ring = F.when(k % 4 == 0, _at(_FIGURES["angle"], x, y)).when(k % 4 == 1, _at(_FIGURES["clamp"], x, y)).when(k % 4 == 2, _at(_FIGURES["diamond"], x, y)).otherwise(_at(_FIGURES["bow tie"], x, y))
    return _parts(spark, sf_dir).select(F.col("p_brand").alias("group"), k.alias("shape"), F.array(ring).alias("rings"))


def _sql_points(points: list[tuple[int, int]]) -> str:
    return "[" + ", ".join(f"[{x}, {y}]" for x, y in [*points, points[0]]) + "]"


_EDGES = """pts AS (SELECT "group", shape, ring, i, x + p[i][1] AS x, y + p[i][2] AS y FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM figures)),
edges AS (SELECT a."group", a.shape, a.ring, a.i, a.x AS x1, a.y AS y1, c.x AS x2, c.y AS y2 FROM pts a JOIN pts c ON c.shape = a.shape AND c.ring = a.ring AND c.i = a.i + 1),
boxes AS (SELECT "group", shape, min(x1)::INT AS lx, min(y1)::INT AS ly, max(x1)::INT AS hx, max(y1)::INT AS hy FROM edges GROUP BY ALL),
spots AS (SELECT shape, cx, cy, q, cx + [0.5, 0.5, 0.2, 0.8][q]::DOUBLE AS x, cy + [0.2, 0.8, 0.5, 0.5][q]::DOUBLE AS y FROM (SELECT *, unnest(range(1, 5)) AS q FROM (SELECT *, unnest(range(ly, hy)) AS cy FROM (SELECT *, unnest(range(lx, hx)) AS cx FROM boxes)))),
quarters AS (SELECT s.shape, cx, cy, q FROM spots s JOIN edges e ON e.shape = s.shape AND (e.y1 > s.y) <> (e.y2 > s.y) AND e.x1 + (e.x2 - e.x1) * (s.y - e.y1) / (e.y2 - e.y1) > s.x GROUP BY ALL HAVING count(*) % 2 = 1)"""



def _side(e: str, f: str, k: int) -> str:
    """On which side of edge e the end k of edge f lies."""
    return f"sign(({e}.x2 - {e}.x1) * ({f}.y{k} - {e}.y1) - ({e}.y2 - {e}.y1) * ({f}.x{k} - {e}.x1))"


@query(f"""WITH RECURSIVE figures AS (SELECT p_brand AS "group", p_partkey AS shape, 0 AS ring, p_partkey * 37 % 97 AS x, p_partkey // 100 * 3 + p_partkey * 13 % 7 AS y,
  CASE p_partkey % 4 {" ".join(f"WHEN {k} THEN {_sql_points(p)}" for k, p in enumerate(_FIGURES.values()))} END AS p FROM part), {_EDGES},
near AS (SELECT p.shape AS a, q.shape AS b FROM boxes p JOIN boxes q ON p."group" = q."group" AND p.shape <> q.shape AND p.lx <= q.hx AND q.lx <= p.hx AND p.ly <= q.hy AND q.ly <= p.hy),
touch AS (SELECT DISTINCT n.a, n.b FROM near n JOIN edges e ON e.shape = n.a JOIN edges f ON f.shape = n.b AND greatest(e.x1, e.x2) >= least(f.x1, f.x2) AND greatest(f.x1, f.x2) >= least(e.x1, e.x2) AND greatest(e.y1, e.y2) >= least(f.y1, f.y2) AND greatest(f.y1, f.y2) >= least(e.y1, e.y2)
  WHERE {_side("e", "f", 1)} * {_side("e", "f", 2)} <= 0 AND {_side("f", "e", 1)} * {_side("f", "e", 2)} <= 0),
meet AS (SELECT a, b FROM touch UNION SELECT s.shape, t.shape FROM quarters s JOIN quarters t USING (cx, cy, q) JOIN near n ON n.a = s.shape AND n.b = t.shape),
reach AS (SELECT shape, shape AS other FROM boxes UNION SELECT r.shape, m.b FROM reach r JOIN meet m ON m.a = r.other), comp AS (SELECT shape, min(other) AS component FROM reach GROUP BY shape),
sums AS (SELECT component, count(DISTINCT (cx, cy, q)) / 4 AS area FROM quarters JOIN comp USING (shape) GROUP BY component)
SELECT shape, component, area::DOUBLE AS area FROM comp JOIN sums USING (component)""")
def polygon_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concave outlines that meet (not only their boxes) as components, each with the area of its union."""
    found, rim = polygons.components(_figures(spark, sf_dir))
    area = rim.groupBy("component").agg((F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2).alias("area"))
    return found.join(area, "component").select("shape", "component", r("area", 6).alias("area"))


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as polygons of which a third crosses itself as often as it is long, a third has a hole, and a third a spike."""
    k, n = F.col("p_partkey"), F.col("p_size") % 9 + 1
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    zigzag = F.concat(F.transform(F.sequence(F.lit(0), n), lambda i: point(2 * i, 2 * (i % 2))), F.transform(F.sequence(n, F.lit(0), F.lit(-1)), lambda i: point(2 * i, 2 * ((i + 1) % 2))), F.array(point(F.lit(0), F.lit(0))))
    zero = F.lit(0)
    holed = F.array(_at([(0, 0), (6, 0), (6, 6), (0, 6)], zero, zero), _at([(3, 1), (5, 3), (3, 5), (1, 3)], zero, zero))
    spike = _at([(0, 0), (4, 0), (4, 4), (6, 6), (4, 4), (0, 4)], zero, zero)
    rings = F.when(k % 3 == 0, F.array(zigzag)).when(k % 3 == 1, holed).otherwise(F.array(spike))
    return _parts(spark, sf_dir).select(F.col("p_brand").alias("group"), k.alias("shape"), "p_size", rings.alias("rings"))


@query(f"""WITH base AS (SELECT p_brand AS "group", p_partkey AS shape, p_size % 9 + 1 AS n, 0 AS x, 0 AS y FROM part),
figures AS (SELECT "group", shape, 0 AS ring, x, y, list_transform(range(0, n + 1), lambda i: [2 * i, 2 * (i % 2)]) || list_transform(range(n, -1, -1), lambda i: [2 * i, 2 * ((i + 1) % 2)]) || [[0::BIGINT, 0]] AS p FROM base WHERE shape % 3 = 0
  UNION ALL SELECT "group", shape, 0, x, y, {_sql_points([(0, 0), (6, 0), (6, 6), (0, 6)])} FROM base WHERE shape % 3 = 1 UNION ALL SELECT "group", shape, 1, x, y, {_sql_points([(3, 1), (5, 3), (3, 5), (1, 3)])} FROM base WHERE shape % 3 = 1
  UNION ALL SELECT "group", shape, 0, x, y, {_sql_points([(0, 0), (4, 0), (4, 4), (6, 6), (4, 4), (0, 4)])} FROM base WHERE shape % 3 = 2), {_EDGES},
crossed AS (SELECT e.shape, count(*) AS n FROM edges e JOIN edges f ON e.shape = f.shape AND (e.ring, e.i) < (f.ring, f.i) AND {_side("e", "f", 1)} * {_side("e", "f", 2)} < 0 AND {_side("f", "e", 1)} * {_side("f", "e", 2)} < 0 GROUP BY e.shape),
sums AS (SELECT shape, count(*) / 4 AS area FROM quarters GROUP BY shape)
SELECT s.shape, coalesce(c.n, 0) AS n_crossings, coalesce(c.n, 0) + 1 AS n_parts, coalesce(c.n, 0) + 1 + (s.shape % 3 = 1)::INT AS n_rings, s.area::DOUBLE AS area FROM sums s LEFT JOIN crossed c USING (shape)""")
def mended_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each polygon crosses itself, and the parts, rings and area of its mended form."""
    mended, crossed = polygons.mended(_broken(spark, sf_dir))
    parts = mended.groupBy("shape").agg(F.count(F.lit(1)).alias("n_parts"), F.sum(F.size("rings")).alias("n_rings"), r(F.sum("area"), 6).alias("area"))
    out = parts.join(crossed, "shape", "left")
    return out.select("shape", F.coalesce("n_crossings", F.lit(0)).cast("long").alias("n_crossings"), "n_parts", "n_rings", "area")
