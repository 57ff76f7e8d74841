"""Queries over point clouds and descriptors: surfaces, matches, normals. Clouds are the vectors of a label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import descriptors, normals, points, surfaces
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


_CLOUD = "pts AS (SELECT vec_id AS id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"


def _cloud(spark: SparkSession, sf_dir: str, *axes: int) -> DataFrame:
    e = F.col("embedding")
    return b.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("key"), *(e[k].cast("double").alias(c) for k, c in zip(axes, "xyz")))


@query(f"""WITH {_CLOUD}, cells AS (SELECT vec_id AS id, label, embedding[4]::DOUBLE AS x, embedding[5]::DOUBLE AS y FROM embeddings),
tri AS (SELECT a.label, a.x AS ax, a.y AS ay, a.z AS az, p.x AS px, p.y AS py, p.z AS pz, c.x AS cx, c.y AS cy, c.z AS cz, (p.x - a.x) * (c.y - a.y) - (p.y - a.y) * (c.x - a.x) AS w FROM pts a JOIN pts p ON p.label = a.label AND p.id > a.id JOIN pts c ON c.label = a.label AND c.id > p.id),
mid AS (SELECT *, ((cy - ay) * (pow(px - ax, 2) + pow(py - ay, 2)) - (py - ay) * (pow(cx - ax, 2) + pow(cy - ay, 2))) / (2 * w) AS ox, ((px - ax) * (pow(cx - ax, 2) + pow(cy - ay, 2)) - (cx - ax) * (pow(px - ax, 2) + pow(py - ay, 2))) / (2 * w) AS oy FROM tri WHERE w <> 0),
good AS (SELECT m.* FROM mid m WHERE NOT EXISTS (SELECT 1 FROM pts d WHERE d.label = m.label AND pow(d.x - m.ax - m.ox, 2) + pow(d.y - m.ay - m.oy, 2) < (pow(m.ox, 2) + pow(m.oy, 2)) * (1 - 1e-10))),
lam AS (SELECT q.id, g.*, ((px - q.x) * (cy - q.y) - (py - q.y) * (cx - q.x)) / w AS l1, ((cx - q.x) * (ay - q.y) - (cy - q.y) * (ax - q.x)) / w AS l2, ((ax - q.x) * (py - q.y) - (ay - q.y) * (px - q.x)) / w AS l3 FROM cells q JOIN good g ON g.label = q.label),
linear AS (SELECT id, avg(l1 * az + l2 * pz + l3 * cz) AS z FROM lam WHERE l1 >= -1e-12 AND l2 >= -1e-12 AND l3 >= -1e-12 GROUP BY id),
near AS (SELECT q.id, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) AS d, p.z FROM cells q JOIN pts p ON p.label = q.label QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY d, p.id) = 1),
middle AS (SELECT label, median(z) AS z FROM pts GROUP BY label)
SELECT q.id AS cell_id, round(CASE WHEN l.id IS NOT NULL THEN l.z WHEN n.d <= 0.06 THEN n.z ELSE m.z END, 6) AS z, CASE WHEN l.id IS NOT NULL THEN 'linear' WHEN n.d <= 0.06 THEN 'nearest' ELSE 'median' END AS how FROM cells q LEFT JOIN linear l USING (id) LEFT JOIN near n USING (id) LEFT JOIN middle m ON m.label = q.label""")
def surface_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights between the points of a cloud, those of near points around it, and its median farther out."""
    cells = _cloud(spark, sf_dir, 3, 4).withColumnRenamed("id", "cell_id")
    points = _cloud(spark, sf_dir, 0, 1, 2).withColumnRenamed("id", "point_id")
    return surfaces.surface(cells, points, 0.02, reach=0.06).select("cell_id", r("z", 6).alias("z"), "how")


@query("""WITH d AS (SELECT vec_id AS id, label, vec_id % 2 AS side, embedding::DOUBLE[] AS v FROM embeddings),
nn AS (SELECT a.label, a.id, c.id AS other, list_distance(a.v, c.v) AS distance FROM d a JOIN d c ON c.label = a.label AND a.side = 1 AND c.side = 0 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY distance, c.id) <= 2),
two AS (SELECT label, id, arg_min(other, distance) AS other, min(distance) AS distance, max(distance) AS second FROM nn GROUP BY label, id HAVING count(*) = 2),
good AS (SELECT * FROM two WHERE distance < 0.98 * second), n AS (SELECT label, count(*) AS n_good FROM good GROUP BY label)
SELECT label AS key, id, other, round(distance, 6) AS distance, round(second, 6) AS second, n_good, n_good >= 8 AS enough FROM good JOIN n USING (label)""")
def descriptor_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other vector of a label matched with the rest, by all of its components."""
    rows = b.table(spark, sf_dir, "embeddings").select(F.col("label").alias("key"), F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    near = descriptors.nearest_descriptors(rows.filter("id % 2 = 1"), rows.filter("id % 2 = 0"), 2)
    good = descriptors.ratio_matches(near, 0.98)
    return good.select("key", "id", "other", r("distance", 6).alias("distance"), r("second", 6).alias("second"), "n_good", "enough")


_NORMALS = f"""{_CLOUD}, nn AS (SELECT p.id, q.id AS other, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2)) AS d FROM pts p JOIN pts q ON p.label = q.label AND p.id <> q.id QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY d, q.id) <= 29),
c AS (SELECT s.id, count(*) AS n, covar_pop(x, x) AS a, covar_pop(y, y) AS b, covar_pop(z, z) AS c, covar_pop(x, y) AS d, covar_pop(x, z) AS e, covar_pop(y, z) AS f FROM (SELECT id, other FROM nn WHERE d <= 2 UNION ALL SELECT id, id FROM pts) s JOIN pts ON pts.id = s.other GROUP BY s.id),
m AS (SELECT *, (a + b + c) / 3 AS q FROM c), p AS (SELECT *, sqrt((pow(a - q, 2) + pow(b - q, 2) + pow(c - q, 2) + 2 * (d * d + e * e + f * f)) / 6) AS p FROM m),
v AS (SELECT *, q + 2 * p * cos((acos(greatest(-1, least(1, ((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)) / (2 * p * p * p)))) + 2 * pi()) / 3) AS l FROM p),
x AS (SELECT *, [[d * f - e * (b - l), e * d - (a - l) * f, (a - l) * (b - l) - d * d], [d * (c - l) - e * f, e * e - (a - l) * (c - l), (a - l) * f - d * e], [(b - l) * (c - l) - f * f, f * e - d * (c - l), d * f - (b - l) * e]] AS r FROM v),
y AS (SELECT *, list_transform(r, lambda t: [t[1] * t[1] + t[2] * t[2] + t[3] * t[3], t[1], t[2], t[3]]) AS t FROM x), z AS (SELECT *, list_aggregate(t, 'max') AS k FROM y),
normals AS (SELECT z.id, label, pts.z AS height, z.n, l, k[2] / sqrt(k[1]) AS nx, k[3] / sqrt(k[1]) AS ny, k[4] / sqrt(k[1]) AS nz FROM z JOIN pts ON pts.id = z.id)"""


@query(f"""WITH RECURSIVE {_NORMALS}, edges AS (SELECT DISTINCT least(id, other) AS a, greatest(id, other) AS b FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS rank FROM nn) WHERE rank <= 10),
w AS (SELECT a, b, p.nx * q.nx + p.ny * q.ny + p.nz * q.nz AS g FROM edges JOIN normals p ON p.id = a JOIN normals q ON q.id = b), o AS (SELECT a, b, CASE WHEN g < 0 THEN -1 ELSE 1 END AS s, row_number() OVER (ORDER BY 1 - abs(g), a, b) AS w FROM w),
both_ways AS (SELECT a, b, w FROM o UNION ALL SELECT b, a, w FROM o),
lighter AS (SELECT w, a, a AS at FROM o UNION SELECT l.w, l.a, e.b FROM lighter l JOIN both_ways e ON e.a = l.at AND e.w < l.w),
tree AS (SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM lighter l WHERE l.w = o.w AND l.at = o.b)),
links AS (SELECT a, b, s FROM tree UNION ALL SELECT b, a, s FROM tree),
reach AS (SELECT id, id AS at, 1 AS s FROM normals UNION SELECT r.id, l.b, r.s * l.s FROM reach r JOIN links l ON l.a = r.at),
root AS (SELECT r.at AS id, arg_max(r.id, (n.height, -n.id)) AS root FROM reach r JOIN normals n ON n.id = r.id GROUP BY r.at),
turned AS (SELECT r.at AS id, r.s * CASE WHEN n.nz < 0 THEN -1 ELSE 1 END AS t FROM reach r JOIN root ON root.id = r.at AND root.root = r.id JOIN normals n ON n.id = r.id)
SELECT n.id AS point_id, n.n, round(l, 7) AS variance, round(nx * t, 4) AS nx, round(ny * t, 4) AS ny, round(nz * t, 4) AS nz, true AS exact FROM normals n JOIN turned USING (id)""")
def oriented_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normals of all points of the clouds, from up to thirty neighbours, that agree with each other."""
    rows = _cloud(spark, sf_dir, 0, 1, 2).withColumnRenamed("id", "point_id")
    near = points.nearest_neighbours(rows, 29, points.cell_for(rows, 29, "key"), block="key")
    found = normals.cloud_normals(rows, near)
    return found.select("point_id", "n", r("variance", 7).alias("variance"), *(r(c, 4).alias(c) for c in ("nx", "ny", "nz")), (F.col("residual") < 1e-9).alias("exact"))
