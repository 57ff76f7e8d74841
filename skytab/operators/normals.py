"""Normals of point clouds: covariances of neighbourhoods, eigenvectors in closed form, one orientation along a spanning forest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut, tidy

AXES = ("x", "y", "z")
COVARIANCE = ("xx", "xy", "xz", "yy", "yz", "zz")


def covariances(points: DataFrame, neighbours: DataFrame, most: int = 30, radius: float = 2.0, key: str = "point_id") -> DataFrame:
    """Covariance of each point (key, x, y, z) and its neighbours (key, other, distance, rank), of which ``most`` - 1 at most, within
    ``radius``, count beside the point itself: key, n, xx, xy, xz, yy, yz, zz."""
    near = neighbours.filter((F.col("rank") < most) & (F.col("distance") <= radius)).select(key, "other")
    both = near.unionByName(points.select(key, F.col(key).alias("other")))
    at = points.select(F.col(key).alias("other"), *AXES)
    pairs = [(a, b) for i, a in enumerate(AXES) for b in AXES[i:]]
    return both.join(at, "other").groupBy(key).agg(F.count(F.lit(1)).alias("n"), *(F.covar_pop(a, b).alias(a + b) for a, b in pairs))


def _matrix() -> tuple[tuple[Column, Column, Column], ...]:
    c = {k: F.col(k) for k in COVARIANCE}
    return (c["xx"], c["xy"], c["xz"]), (c["xy"], c["yy"], c["yz"]), (c["xz"], c["yz"], c["zz"])


def _roots(rows: DataFrame) -> DataFrame:
    """``rows`` with top, whether the largest eigenvalue of the matrix in the columns xx to zz stands apart, and root: that one, or else
    the smallest. By cosines; a step a column, so that no expression is written out twice."""
    (a, d, e), (_, b, f), (_, _, c) = _matrix()
    rows = rows.withColumn("mean", (a + b + c) / 3)
    x, y, z = (m - F.col("mean") for m in (a, b, c))
    rows = rows.withColumns({"p": F.sqrt((x * x + y * y + z * z + 2 * (d * d + e * e + f * f)) / 6), "det": x * (y * z - f * f) - d * (d * z - f * e) + e * (d * f - y * e)})
    p = F.col("p")
    rows = rows.withColumn("angle", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.col("det") / F.nullif(2 * p * p * p, F.lit(0.0)), F.lit(1.0))))) / 3)
    rows = rows.withColumn("top", (p > 0) & (F.col("det") > 0))
    shift = F.when(F.col("top"), F.cos("angle")).otherwise(F.cos(F.col("angle") + 2 * F.pi() / 3))
    return rows.withColumn("root", F.when(p > 0, F.col("mean") + 2 * p * shift).otherwise(F.col("mean"))).drop("mean", "p", "det", "angle")


def _eigenvectors(rows: DataFrame) -> DataFrame:
    """``rows`` with v, the unit vector that the matrix less ``root`` brings nearest to nothing: of the cross products of its rows the
    longest; straight up if all vanish."""
    m = [[x - F.col("root") if i == j else x for j, x in enumerate(row)] for i, row in enumerate(_matrix())]
    crosses = []
    for i, j in ((0, 1), (0, 2), (1, 2)):
        (a, b, c), (d, e, f) = m[i], m[j]
        crosses.append(F.struct((b * f - c * e).alias("x"), (c * d - a * f).alias("y"), (a * e - b * d).alias("z")))
    rows = rows.withColumn("crosses", F.array(*crosses))
    size = lambda t: F.struct((t["x"] * t["x"] + t["y"] * t["y"] + t["z"] * t["z"]).alias("n2"), t["x"].alias("x"), t["y"].alias("y"), t["z"].alias("z"))
    rows = rows.withColumn("best", F.array_max(F.transform("crosses", size))).withColumn("size", F.sqrt("best.n2"))
    unit = F.struct(*((F.col(f"best.{c}") / F.col("size")).alias(c) for c in AXES))
    return rows.withColumn("v", F.when(F.col("size") > 0, unit).otherwise(_up())).drop("crosses", "best", "size")


def _up() -> Column:
    return F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("z"))


def _times(v: str) -> list[Column]:
    return [sum((row[j] * F.col(v)[c] for j, c in enumerate(AXES[1:], 1)), row[0] * F.col(v)["x"]) for row in _matrix()]


def normals(covariances: DataFrame) -> DataFrame:
    """``covariances`` with nx, ny, nz (unit, of either direction), variance (along it) and residual, the length of C n - variance n.

    The eigenvector of the eigenvalue that stands apart is taken first. If that is the smallest, it is the normal; if it is the
    largest, the normal lies in the plane across it, where it is that of a 2 x 2 matrix. So neither suffers from two
    eigenvalues that are nearly equal. Neighbourhoods without a direction (fewer than three points, or all in one place) have
    the normal (0, 0, 1)."""
    rows = _eigenvectors(_roots(covariances))
    v = {c: F.col("v")[c] for c in AXES}
    wide = F.abs(v["x"]) > F.abs(v["y"])
    rows = rows.withColumn("u", F.when(wide, F.struct((-v["z"]).alias("x"), F.lit(0.0).alias("y"), v["x"].alias("z"))).otherwise(F.struct(F.lit(0.0).alias("x"), v["z"].alias("y"), (-v["y"]).alias("z"))))
    rows = rows.withColumn("size", F.sqrt(F.pow("u.x", 2) + F.pow("u.y", 2) + F.pow("u.z", 2)))
    rows = rows.withColumn("u", F.struct(*((F.col(f"u.{c}") / F.col("size")).alias(c) for c in AXES)))
    u = {c: F.col("u")[c] for c in AXES}
    rows = rows.withColumn("w", F.struct((v["y"] * u["z"] - v["z"] * u["y"]).alias("x"), (v["z"] * u["x"] - v["x"] * u["z"]).alias("y"), (v["x"] * u["y"] - v["y"] * u["x"]).alias("z")))
    dot = lambda p, q: sum((F.col(p)[c] * t for c, t in zip(AXES[1:], _times(q)[1:])), F.col(p)["x"] * _times(q)[0])
    turn = F.atan2(2 * dot("u", "w"), dot("u", "u") - dot("w", "w")) / 2  # of the larger one in the plane
    rows = rows.withColumn("turn", turn)
    plane = F.struct(*((F.cos("turn") * F.col("w")[c] - F.sin("turn") * F.col("u")[c]).alias(c) for c in AXES))
    rows = rows.withColumn("v", F.when(F.col("n") < 3, _up()).when(F.col("top"), plane).otherwise(F.col("v")))
    rows = rows.withColumn("variance", dot("v", "v"))
    off = [t - F.col("variance") * F.col("v")[c] for c, t in zip(AXES, _times("v"))]
    residual = F.sqrt(off[0] * off[0] + off[1] * off[1] + off[2] * off[2])
    return rows.select(*covariances.columns, *(F.col("v")[c].alias(f"n{c}") for c in AXES), "variance", residual.alias("residual"))


@tidy("oriented")
def oriented(points: DataFrame, edges: DataFrame, key: str = "point_id") -> DataFrame:
    """``points`` (key a whole number, z, nx, ny, nz) with normals that agree along a spanning forest, and component and flipped.

    Edges (key, other) of points are weighed by 1 - |cosine of the normals|, ties by their ends. In the forest of least weight a normal is turned where it
    points against the one before; each tree begins at its highest point (ties: smaller key), whose normal points up. The forest
    grows by rounds: every tree takes its lightest edge out, trees that are so joined are named and turned together by
    doubling pointers. Points without an edge are trees of their own. Edges to points that are not there, and self
    loops, are ignored.
    """
    own = cut(points.select(F.col(key).alias("id"), "z", *(f"n{c}" for c in AXES)), "normals")
    ends = edges.select(F.least(key, "other").alias("a"), F.greatest(key, "other").alias("b")).filter("a < b").distinct()
    at = lambda k: own.select(F.col("id").alias(k), *(F.col(f"n{c}").alias(f"{c}{k}") for c in AXES))
    cosine = F.col("xa") * F.col("xb") + F.col("ya") * F.col("yb") + F.col("za") * F.col("zb")
    work = ends.join(at("a"), "a").join(at("b"), "b").select("a", "b", (1 - F.abs(cosine)).alias("w"), F.when(cosine < 0, -1).otherwise(1).alias("s"))
    # ra, rb: the trees of the ends; s: how their normals stand to each other
    work = cut(work.select("a", "b", "w", "s", F.col("a").alias("ra"), F.col("b").alias("rb")), "edges")
    labels = cut(own.select("id", F.col("id").alias("component"), F.lit(1).alias("turn")), "labels")
    while not work.isEmpty():
        each = work.select(F.col("ra").alias("tree"), F.col("rb").alias("up"), "w", "a", "b", "s").union(work.select("rb", "ra", "w", "a", "b", "s"))
        out = each.groupBy("tree").agg(F.min(F.struct("w", "a", "b", "up", "s")).alias("m")).select("tree", "m.up", F.col("m.s").alias("turn"))
        out = cut(out, "lightest")
        back = out.select(F.col("tree").alias("up"), F.col("up").alias("over"))
        # of two trees that chose each other the smaller one stays
        root = (F.col("over") == F.col("tree")) & (F.col("tree") < F.col("up"))
        up = out.join(back, "up", "left").select("tree", F.when(root, F.col("tree")).otherwise(F.col("up")).alias("up"), F.when(root, 1).otherwise(F.col("turn")).alias("turn"))
        up = cut(up, "up")
        while True:
            over = up.select(F.col("tree").alias("up"), F.col("up").alias("over"), F.col("turn").alias("turn2"))
            step = cut(up.join(over, "up").select("tree", F.col("over").alias("up"), F.when(F.col("over") == F.col("up"), F.col("turn")).otherwise(F.col("turn") * F.col("turn2")).alias("turn"), (F.col("over") != F.col("up")).alias("moved")), "up")
            up = step.drop("moved")
            if step.filter("moved").isEmpty():
                break
        name = lambda k: up.select(F.col("tree").alias(f"r{k}"), F.col("up").alias(f"u{k}"), F.col("turn").alias(f"t{k}"))
        work = work.join(name("a"), "ra").join(name("b"), "rb").filter("ua <> ub")
        work = cut(work.select("a", "b", "w", (F.col("s") * F.col("ta") * F.col("tb")).alias("s"), F.col("ua").alias("ra"), F.col("ub").alias("rb")), "edges")
        to = up.select(F.col("tree").alias("component"), "up", F.col("turn").alias("turn2"))
        labels = labels.join(to, "component", "left").select("id", F.coalesce("up", "component").alias("component"), (F.col("turn") * F.coalesce("turn2", F.lit(1))).alias("turn"))
        labels = cut(labels, "labels")
    full = cut(own.join(labels, "id"), "turned")
    top = full.groupBy("component").agg(F.max_by(F.when(F.col("nz") * F.col("turn") < 0, -1).otherwise(1), F.struct("z", -F.col("id"))).alias("up"))
    turn = full.join(top, "component").select(F.col("id").alias(key), "component", (F.col("turn") * F.col("up")).alias("__turn"))
    out = points.join(turn, key)
    return out.select(*((F.col(c) * F.col("__turn")).alias(c) if c in ("nx", "ny", "nz") else c for c in points.columns), "component", (F.col("__turn") < 0).alias("flipped"))


def cloud_normals(points: DataFrame, neighbours: DataFrame, links: int = 10, key: str = "point_id") -> DataFrame:
    """Oriented normals of points (key, x, y, z) from their neighbours (key, other, distance, rank), 29 at least: key, z, n, the normal, variance,
    residual, component, flipped. Orientation goes along the ``links`` nearest neighbours of each point."""
    found = normals(covariances(points, neighbours, key=key)).join(points.select(key, "z"), key)
    return oriented(found.drop(*COVARIANCE), neighbours.filter(F.col("rank") <= links).select(key, "other"), key)


