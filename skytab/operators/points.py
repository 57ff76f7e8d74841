"""Point sets: nearest neighbours, outliers, extents, similarity alignment, small-grid compositing."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from .quantiles import quantiles


def nearest_neighbours(points: DataFrame, k: int, cell: float, rings: int = 1, key: str = "point_id", block: str | None = None) -> DataFrame:
    """For each point (key, x, y, z) its k nearest others, fewer only if there are no more: key, other, distance, rank.

    Points meet by an equi join on grid cells, so the work follows the density of the cloud. A search of ``rings``
    cells of size ``cell`` is exact up to rings * cell; points that have fewer than k others there search again
    with cells of twice the size, until the cells span the whole cloud. ``block``: a column that must be equal.
    Ties: smaller key. Points with a coordinate that is null or not finite neither find nor are found.
    """
    axes = ("x", "y", "z")
    finite = [F.abs(F.col(a)) < float("inf") for a in axes]
    points = cut(points.filter(finite[0] & finite[1] & finite[2]).select(key, *([block] if block else []), *axes), "points")
    ends = points.agg(*(F.max(a) - F.min(a) for a in axes)).first()
    span = math.hypot(*(e or 0.0 for e in ends))
    seekers, found = points, None
    while True:
        near = cut(_within(seekers, points, k, cell, rings, key, block), "near")
        if rings * cell >= span:
            return near if found is None else found.unionByName(near)
        whole = near.filter(F.col("rank") == k).select(key)
        near = near.join(whole, key, "left_semi")
        found = near if found is None else found.unionByName(near)
        seekers = cut(seekers.join(whole, key, "left_anti"), "seekers")
        if seekers.isEmpty():
            return found
        cell *= 2


def cell_for(points: DataFrame, k: int, block: str | None = None) -> float:
    """A cell size for ``nearest_neighbours`` at which the cells around a point hold about 2 k others, from the extents of all points and
    the number in the fullest block; 1 if there are none or they are all in one place. The search is exact with any other."""
    finite = points.filter("abs(x) < double('infinity') AND abs(y) < double('infinity') AND abs(z) < double('infinity')")
    sizes = finite.groupBy(*([block] if block else [])).agg(F.count(F.lit(1)).alias("n"), *(f(a).alias(f"{n}{a}") for a in ("x", "y", "z") for n, f in (("lo", F.min), ("hi", F.max))))
    row = sizes.agg(F.max("n"), *(F.max(f"hi{a}") - F.min(f"lo{a}") for a in ("x", "y", "z"))).first()
    sides = [s for s in row[1:] if s]
    if not sides:
        return 1.0
    return (2 * k * math.prod(sides) / (3 ** len(sides) * row[0])) ** (1 / len(sides))


def _within(seekers: DataFrame, points: DataFrame, k: int, cell: float, rings: int, key: str, block: str | None) -> DataFrame:
    """The up to k nearest ``points`` of each of ``seekers`` at most rings * cell away: key, other, distance, rank."""
    axes = ("x", "y", "z")
    at = {f"__g{a}": F.floor(F.col(a) / cell).cast("long") for a in axes}
    side = F.sequence(F.lit(-rings), F.lit(rings))
    home, seen = points.withColumns(at), seekers.withColumns(at)
    for cell_axis in (f"__g{a}" for a in axes):
        seen = seen.withColumn("__d", F.explode(side)).withColumn(cell_axis, F.col(cell_axis) + F.col("__d")).drop("__d")
    on = [*(f"__g{a}" for a in axes), *([block] if block else [])]
    other = home.select(*on, F.col(key).alias("other"), *(F.col(a).alias(f"__o{a}") for a in axes))
    d2 = sum((F.pow(F.col(a) - F.col(f"__o{a}"), 2) for a in axes[1:]), F.pow(F.col("x") - F.col("__ox"), 2))
    pairs = seen.join(other, on).filter(F.col("other") != F.col(key)).select(key, "other", F.sqrt(d2).alias("distance"))
    pairs = pairs.filter(F.col("distance") <= rings * cell)
    w = Window.partitionBy(key).orderBy("distance", "other")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def ratio_test(neighbours: DataFrame, ratio: float = 0.75, key: str = "point_id") -> DataFrame:
    """Points whose nearest neighbour is clearly nearer than the second: key, other, distance, second."""
    two = neighbours.filter("rank <= 2").groupBy(key).agg(F.min_by("other", "rank").alias("other"), F.min("distance").alias("distance"), F.max("distance").alias("second"), F.count(F.lit(1)).alias("n"))
    return two.filter((F.col("n") == 2) & (F.col("distance") < ratio * F.col("second"))).drop("n")


def mean_distance_outliers(neighbours: DataFrame, deviations: float = 2.0, key: str = "point_id", *groups: str) -> DataFrame:
    """Points with mean_distance to their neighbours and inlier: at most the mean plus some deviations of all."""
    mean = neighbours.groupBy(key, *groups).agg(F.avg("distance").alias("mean_distance"))
    stats = mean.groupBy(*groups).agg(F.avg("mean_distance").alias("m"), F.stddev_samp("mean_distance").alias("s"))
    both = mean.join(stats, list(groups)) if groups else mean.join(F.broadcast(stats))  # one row
    return both.select(key, *groups, "mean_distance", (F.col("mean_distance") <= F.col("m") + deviations * F.coalesce("s", F.lit(0.0))).alias("inlier"))


def percentile_extent(points: DataFrame, *groups: str, low: float = 0.01, high: float = 0.99, margin: float = 5.0) -> DataFrame:
    """Extent between percentiles (linear interpolation) with a margin, and the median height; of groups of any size."""
    axes = F.explode(F.array(*(F.struct(F.lit(c).alias("axis"), F.col(c).cast("double").alias("v")) for c in ("x", "y", "z"))))
    rows = points.select(*groups, axes.alias("a")).select(*groups, "a.axis", "a.v")
    found = quantiles(rows, "v", [low, 0.5, high], *groups, "axis")
    of = lambda axis, k: F.max(F.when(F.col("axis") == axis, F.col("quantiles")[k]))
    ends = [of(c, k) + s * margin for k, s in ((0, -1), (2, 1)) for c in ("x", "y")]
    return found.groupBy(*groups).agg(*(c.alias(n) for c, n in zip(ends, ("min_x", "min_y", "max_x", "max_y"))), of("z", 1).alias("median_z"))


def canvas_size(min_x, min_y, max_x, max_y, gsd, cap: int = 16000):
    """(gsd, width, height) of a canvas; beyond the cap on its longer side the cell grows."""
    side = F.greatest(F.ceil((max_x - min_x) / gsd), F.ceil((max_y - min_y) / gsd))
    size = F.when(side > cap, gsd * side / cap).otherwise(gsd)
    return size, F.greatest(F.ceil((max_x - min_x) / size), F.lit(1)), F.greatest(F.ceil((max_y - min_y) / size), F.lit(1))


def similarity_transform(pairs: DataFrame) -> tuple[float, np.ndarray, np.ndarray]:
    """Scale, rotation and shift that take (x, y, z) to (u, v, w) with least squares.

    Sixteen sums come from Spark in one aggregate; only a 3 x 3 decomposition runs on the driver.
    """
    a, b = ("x", "y", "z"), ("u", "v", "w")
    means = [F.avg(c) for c in (*a, *b)]
    cross = [F.covar_pop(p, q) for p in b for q in a]
    row = pairs.agg(*means, *cross, sum((F.var_pop(c) for c in a[1:]), F.var_pop("x"))).first()
    mu_a, mu_b = np.array(row[:3], float), np.array(row[3:6], float)
    cov, var = np.array(row[6:15], float).reshape(3, 3), float(row[15])
    u, d, vt = np.linalg.svd(cov)
    s = np.diag([1.0, 1.0, np.sign(np.linalg.det(u) * np.linalg.det(vt)) or 1.0])
    rotation = u @ s @ vt
    scale = float(np.trace(np.diag(d) @ s) / var) if var > 0 else 1.0
    return scale, rotation, mu_b - scale * rotation @ mu_a


def seam_gains(pairs: DataFrame, key: str, low: float = 0.82, high: float = 1.22) -> DataFrame:
    """Exposure gain (key, frame, gain) of each frame of each mosaic from seams (key, i, j, mean_i, mean_j, weight): least
    squares of log gains with mean zero, clamped. Each mosaic is solved where its seams are, by conjugate
    gradients over the seams; seams of a mosaic are as many as its frames have neighbours."""
    ok = pairs.filter("mean_i > 0 AND mean_j > 0 AND i <> j")
    ok = ok.select(key, F.col("i").cast("long"), F.col("j").cast("long"), F.coalesce("weight", F.lit(1.0)).alias("w"), (F.log("mean_j") - F.log("mean_i")).alias("r"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        frames, at = np.unique(pdf[["i", "j"]].to_numpy(), return_inverse=True)
        i, j = at.reshape(-1, 2).T
        w, n = pdf["w"].to_numpy(), len(frames)
        spread = lambda v: np.bincount(i, v, n) - np.bincount(j, v, n)
        x, rest = np.zeros(n), spread(w * pdf["r"].to_numpy())
        step, size = rest.copy(), rest @ rest
        goal = 1e-26 * size
        for _ in range(20 * n):
            if size <= goal:
                break
            pull = spread(w * (step[i] - step[j]))
            a = size / (step @ pull)
            x, rest = x + a * step, rest - a * pull
            size, last = rest @ rest, size
            step = rest + size / last * step
        return pd.DataFrame({key: pdf[key].iloc[0], "frame": frames, "gain": np.clip(np.exp(x - x.mean()), low, high)})

    return ok.groupBy(key).applyInPandas(solve, f"{key} {dict(pairs.dtypes)[key]}, frame long, gain double")


def best_frame(weights: DataFrame, *cell: str) -> DataFrame:
    """For each cell the frame with the largest positive weight, the first one on a tie: cell, frame, weight."""
    best = F.max(F.struct("weight", (-F.col("frame")).alias("n"))).alias("b")
    return weights.filter("weight > 0").groupBy(*cell).agg(best).select(*cell, (-F.col("b.n")).alias("frame"), F.col("b.weight").alias("weight"))


def weighted_average(pixels: DataFrame, *cell: str, value: str = "value", least: float = 1e-4) -> DataFrame:
    """For each cell the weighted mean of a value; null where the weights sum to ``least`` or less."""
    sums = pixels.groupBy(*cell).agg(F.sum(F.col("weight") * F.col(value)).alias("s"), F.sum("weight").alias("w"))
    return sums.select(*cell, F.when(F.col("w") > least, F.col("s") / F.col("w")).alias(value), "w")


def median_smooth_labels(cells: DataFrame, half: int = 1) -> DataFrame:
    """Cells (row, col, label) with the median label of the cells around each, by an equi join on neighbours."""
    side = F.sequence(F.lit(-half), F.lit(half))
    near = cells.select(F.explode(F.transform(side, lambda d: F.col("row") + d)).alias("row"), "col", "label").select("row", F.explode(F.transform(side, lambda d: F.col("col") + d)).alias("col"), "label")
    return near.join(cells.select("row", "col"), ["row", "col"]).groupBy("row", "col").agg(F.median("label").alias("label"))


def density_filter(vertices: DataFrame, *groups: str, share: float = 0.05) -> DataFrame:
    """``vertices`` without those under the quantile ``share`` (linear interpolation) of the density of their group."""
    least = quantiles(vertices, "density", [share], *groups).select(*groups, F.col("quantiles")[0].alias("__least"))
    both = vertices.join(least, list(groups)) if groups else vertices.join(F.broadcast(least))  # one row
    return both.filter(F.col("density") >= F.col("__least")).drop("__least")


def pivot_radii(neighbours: DataFrame, *groups: str) -> DataFrame:
    """Radii of a rolling ball, 3, 6 and 12 times the mean distance to the nearest neighbour."""
    mean = F.avg(F.when(F.col("rank") == 1, F.col("distance")))
    return neighbours.groupBy(*groups).agg(mean.alias("mean_distance")).withColumn("radii", F.array(*(F.lit(k) * F.col("mean_distance") for k in (3.0, 6.0, 12.0))))


def fill_nearest(cells: DataFrame, points: DataFrame, cell: float, *, key: str = "cell_id") -> DataFrame:
    """``cells`` (key, x, y, z) with z, where null, that of the nearest of ``points`` (point_id, x, y, z; ties: smaller
    id) in the plane, and where there are no points at all 0."""
    flat = points.filter("z IS NOT NULL").groupBy("x", "y").agg((F.min("point_id") - (1 << 62)).alias("p"), F.min_by("z", "point_id").alias("height"))  # one for each place
    places = cut(cells.filter("z IS NULL").select("x", "y").distinct().select(F.monotonically_increasing_id().alias("p"), "x", "y", F.lit(0.0).alias("z")), "places")
    near = _nearest_of(places, flat.select("p", "x", "y", F.lit(0.0).alias("z")), cell)
    found = near.join(flat.select(F.col("p").alias("other"), "height"), "other").join(places.select("p", "x", "y"), "p").select("x", "y", "height")
    return cells.join(found, ["x", "y"], "left").withColumn("z", F.coalesce("z", "height", F.lit(0.0))).select(*cells.columns)


def _nearest_of(seekers: DataFrame, points: DataFrame, cell: float) -> DataFrame:
    """For each seeker (p, x, y, z) its nearest point (p, other), by grid cells of growing size."""
    seekers, points = cut(seekers, "seekers"), cut(points, "points")
    ends = seekers.select("x", "y").union(points.select("x", "y")).agg(*(F.max(a) - F.min(a) for a in ("x", "y"))).first()
    span, found = math.hypot(*(e or 0.0 for e in ends)), None
    while True:
        near = cut(_within(seekers, points, 1, cell, 1, "p", None).select("p", "other"), "near")
        found = near if found is None else found.unionByName(near)
        if cell >= span:
            return found
        seekers = cut(seekers.join(near, "p", "left_anti"), "seekers")
        if seekers.isEmpty():
            return found
        cell *= 2


def surface_summary(cells: DataFrame, gsd: float, *groups: str) -> DataFrame:
    """Lowest and highest ground, covered hectares (cells with a label of 0 or more) and how many cells each surface has."""
    covered = F.count_if(F.col("label") >= 0)
    return cells.groupBy(*groups).agg(F.min("z").alias("min_elevation"), F.max("z").alias("max_elevation"), (covered * gsd * gsd / 10000.0).alias("hectares"), F.count(F.lit(1)).alias("n_cells"), F.count_distinct(F.when(F.col("label") >= 0, F.col("label"))).alias("n_labels"))


def last_by_name(geo: DataFrame, order: str, name: str = "filename") -> DataFrame:
    """One row a name, the last one by ``order``."""
    rows = geo.groupBy(name).agg(F.max(F.struct(order, *(c for c in geo.columns if c not in (name, order)))).alias("__r"))
    return rows.select(name, "__r.*").select(*geo.columns)


def sfm_to_geo(cameras: DataFrame, geo: DataFrame, order: str, name: str = "filename") -> DataFrame:
    """Camera centres (name, x, y, z) with the photograph (name, u, v, w, ...) of that name, the last one where it repeats."""
    return cameras.join(last_by_name(geo, order, name), name)
