"""Linear surfaces between scattered points: for each place the Delaunay triangle around it, without a triangulation.

A triangle is Delaunay if no point lies in its circle. For one place the right triangle is the lowest one over it when heights
are squares of distances, which is a linear program with three active points: a point in the circle enters, and the
corner leaves that keeps the place inside. Most places are settled among the points of their tile and the tiles around it; whether a circle
that reaches farther is empty is asked of all points, by boxes within boxes, and what lies in it enters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut, tidy
from .points import _within
from .quantiles import quantiles

FAN = 4  # boxes along a side of the box above


def hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Indices of the corners of the convex hull, counter-clockwise; of points on one line its two ends."""
    order = np.lexsort((y, x))
    sides = []
    for way in (order, order[::-1]):
        side: list[int] = []
        for i in way.tolist():
            while len(side) > 1 and (x[side[-1]] - x[side[-2]]) * (y[i] - y[side[-2]]) <= (y[side[-1]] - y[side[-2]]) * (x[i] - x[side[-2]]):
                side.pop()
            side.append(i)
        sides.append(side[:-1])
    return np.array(sides[0] + sides[1] if len(order) > 1 else order.tolist(), np.int64)


def barycentric(q: np.ndarray, tri: np.ndarray) -> np.ndarray:
    """[place, corner]: weights of the corners tri [place, corner, axis] that give the places q."""
    a, b, c = tri[:, 0], tri[:, 1], tri[:, 2]
    cross = lambda u, v: u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]
    whole = cross(b - a, c - a)
    whole = np.where(whole == 0, np.nan, whole)
    return np.stack([cross(b - q, c - q), cross(c - q, a - q), cross(a - q, b - q)], 1) / whole[:, None]


def circles(tri: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and squared radii of the circles through three corners."""
    a, u, v = tri[:, 0], tri[:, 1] - tri[:, 0], tri[:, 2] - tri[:, 0]
    d = 2 * (u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0])
    uu, vv = (u * u).sum(1), (v * v).sum(1)
    off = np.stack([v[:, 1] * uu - u[:, 1] * vv, u[:, 0] * vv - v[:, 0] * uu], 1) / d[:, None]
    return a + off, (off * off).sum(1)


def leaving(q: np.ndarray, tri: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Which corner the point p, inside the circle of the triangle, takes the place of, so that q stays inside."""
    have, new = barycentric(q, tri), barycentric(p, tri)
    ratio = np.where(new > 1e-14, np.maximum(have, 0) / np.where(new > 1e-14, new, 1), np.inf)
    return ratio.argmin(1)


def settle(q: np.ndarray, p: np.ndarray, corners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners [place, 3] of the Delaunay triangle of the points p around each place q, -1 outside the hull (``corners``, indices
    of p), and the places moved off edges by next to nothing, which are what the triangles are chosen for."""
    out = np.full((len(q), 3), -1, np.int64)
    if len(corners) < 3:
        return out, q
    fan = np.stack([np.full(len(corners) - 2, corners[0]), corners[1:-1], corners[2:]], 1)
    best = np.full(len(q), -np.inf)
    for tri in fan:
        least = barycentric(q, np.broadcast_to(p[tri], (len(q), 3, 2))).min(1)
        better = np.nan_to_num(least, nan=-np.inf) > best
        out[better], best[better] = tri, least[better]
    out[best < -1e-12] = -1
    inner = np.flatnonzero(out[:, 0] >= 0)
    moved = q.copy()
    moved[inner] += 1e-9 * (np.einsum("k,nkd->nd", [0.5, 0.3, 0.2], p[out[inner]]) - q[inner])
    for lo in range(0, len(inner), 512):
        todo = inner[lo : lo + 512]
        while len(todo):
            centre, r2 = circles(p[out[todo]])
            d2 = ((p[None, :, :] - centre[:, None, :]) ** 2).sum(2)
            np.put_along_axis(d2, out[todo], np.inf, 1)
            near = d2.argmin(1)
            open_ = d2[np.arange(len(todo)), near] < r2 * (1 - 1e-10)
            todo, near = todo[open_], near[open_]
            if len(todo):
                out[todo, leaving(moved[todo], p[out[todo]], p[near])] = near
    return out, moved


def _hulls(points: DataFrame) -> DataFrame:
    """Corners of the hull of each cloud (key, x, y, z): those of the hulls of its batches, then of what is left."""

    def corners(table: pa.Table) -> pa.Table:
        return table.take(pa.array(hull(table.column("x").to_numpy(), table.column("y").to_numpy())))

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for key in table.column("key").unique():
                yield from corners(table.filter(pa.array([k == key for k in table.column("key")]))).to_batches()

    part = points.select("key", "x", "y", "z")
    order = lambda table: table.append_column("nr", pa.array(np.arange(len(table))))
    schema = part.schema
    return part.mapInArrow(of_batches, schema).groupBy("key").applyInArrow(lambda t: order(corners(t)), f"key {dict(points.dtypes)['key']}, x double, y double, z double, nr long")


def linear_heights(cells: DataFrame, points: DataFrame, per: int = 32, most: int = 256) -> DataFrame:
    """Heights of places (key, cell_id, x, y) on the linear surface over the Delaunay triangles of the points (key, x, y, z) of their
    cloud: cell_id, z; places outside the hull of their cloud have no row.

    per: points of a tile on average; of a tile with more than ``most``, so many take part in the first guess and the rest in
    the test of the circles. Where four points or more lie on one circle any of its triangulations may be met. Points with a
    coordinate or height that is null or not finite are left out; of points at the same place the lowest counts.
    """
    finite = lambda *names: F.expr(" AND ".join(f"abs({c}) < double('infinity')" for c in names))
    clean = points.select("key", *(F.col(c).cast("double").alias(c) for c in "xyz")).filter(finite("x", "y", "z")).filter("key IS NOT NULL")
    clean = clean.groupBy("key", "x", "y").agg(F.min("z").alias("z"))
    ends = clean.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    side = F.greatest(F.sqrt(w * h * per / F.col("n")), F.greatest(w, h) * F.lit(1e-6))
    ends = cut(ends.withColumn("side", F.when(side > 0, side).otherwise(1.0)), "ends")
    tile = {"tx": F.floor((F.col("x") - F.col("x0")) / F.col("side")), "ty": F.floor((F.col("y") - F.col("y0")) / F.col("side"))}
    clean = cut(clean.join(ends.select("key", "x0", "y0", "side"), "key").withColumns(tile).select("key", "tx", "ty", "x", "y", "z"), "points")
    places = cells.select("key", "cell_id", *(F.col(c).cast("double").alias(c) for c in "xy")).filter(finite("x", "y")).join(ends, "key").filter("x >= x0 AND x <= x1 AND y >= y0 AND y <= y1")
    places = cut(places.withColumns(tile).select("key", "tx", "ty", "cell_id", "x", "y"), "places")

    asked = places.groupBy("key", "tx", "ty").agg(F.ceil(F.count(F.lit(1)) / 4096).cast("int").alias("m"))
    some = Window.partitionBy("key", "tx", "ty").orderBy(F.xxhash64("x", "y"))
    counts = clean.groupBy("key", "tx", "ty").agg(F.count(F.lit(1)).alias("n"))
    first = clean.withColumn("nr", F.row_number().over(some)).filter(F.col("nr") <= most).join(counts, ["key", "tx", "ty"])
    step = F.array(*(F.lit(d) for d in (-1, 0, 1)))
    around = first.withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step)).select("key", (F.col("tx") + F.col("dx")).alias("tx"), (F.col("ty") + F.col("dy")).alias("ty"), "x", "y", "z", (F.col("n") > most).alias("thin"), F.lit(-1).cast("long").alias("nr"))
    rim = asked.select("key", "tx", "ty").join(_hulls(clean), "key").select("key", "tx", "ty", "x", "y", "z", F.lit(False).alias("thin"), "nr")
    each = F.explode(F.sequence(F.lit(0), F.col("m") - 1))
    side_a = around.join(asked, ["key", "tx", "ty"]).withColumn("j", each).drop("m").unionByName(rim.join(asked, ["key", "tx", "ty"]).withColumn("j", each).drop("m"))
    side_b = places.join(asked, ["key", "tx", "ty"]).withColumn("j", F.pmod(F.xxhash64("cell_id"), F.col("m")).cast("int")).join(ends.select("key", "x0", "y0", "x1", "y1", "side"), "key")

    names = [f"{c}{k}" for k in (1, 2, 3) for c in "xyz"]
    kind = f"key {dict(cells.dtypes)['key']}, cell_id long, qx double, qy double, mx double, my double, {', '.join(f'{c} double' for c in names)}, cx double, cy double, r2 double, open boolean"

    def as_table(keys: pa.Array, ids: np.ndarray, q: np.ndarray, moved: np.ndarray, tri: np.ndarray, open_: np.ndarray) -> pa.Table:
        centre, r2 = circles(tri[:, :, :2]) if len(tri) else (np.zeros((0, 2)), np.zeros(0))
        columns = [keys, ids, q[:, 0], q[:, 1], moved[:, 0], moved[:, 1], *tri.reshape(len(tri), 9).T, centre[:, 0], centre[:, 1], r2, open_]
        return pa.table([c if isinstance(c, pa.Array | pa.ChunkedArray) else pa.array(c) for c in columns], ["key", "cell_id", "qx", "qy", "mx", "my", *names, "cx", "cy", "r2", "open"])

    def guess(p: pa.Table, q: pa.Table) -> pa.Table:
        xyz = np.stack([p.column(c).to_numpy() for c in "xyz"], 1).reshape(len(p), 3)
        at, thin, nr = np.stack([q.column(c).to_numpy() for c in "xy"], 1).reshape(len(q), 2), p.column("thin").to_numpy().any(), p.column("nr").to_numpy()
        zero = at.mean(0) if len(at) else np.zeros(2)
        corners = np.flatnonzero(nr >= 0)
        corners = corners[np.argsort(nr[corners])]
        tri, moved = settle(at - zero, xyz[:, :2] - zero, corners)
        ok = np.flatnonzero(tri[:, 0] >= 0)
        own = xyz[tri[ok]]
        if not len(ok):
            return as_table(q.column("key").slice(0, 0), np.zeros(0, np.int64), at[ok], moved[ok], own, np.zeros(0, bool))
        x0, y0, x1, y1, side, tx, ty = (q.column(c).to_numpy()[0] for c in ("x0", "y0", "x1", "y1", "side", "tx", "ty"))
        # what the tiles hold, without an end where the cloud has none
        low = np.where([tx <= 1, ty <= 1], -np.inf, np.array([x0, y0]) + (np.array([tx, ty]) - 1) * side)
        high = np.array([x0, y0]) + (np.array([tx, ty]) + 2) * side
        high = np.where(high > [x1, y1], np.inf, high)
        centre, r2 = circles(own[:, :, :2])
        reach = np.sqrt(r2)[:, None]
        open_ = ((centre - reach < low) | (centre + reach > high)).any(1) | thin
        return as_table(q.column("key").take(pa.array(ok)), q.column("cell_id").to_numpy()[ok], at[ok], moved[ok] + zero, own, open_)

    block = ["key", "tx", "ty", "j"]
    state = cut(side_a.groupBy(*block).cogroup(side_b.groupBy(*block)).applyInArrow(guess, kind), "triangles")

    boxes, levels = _boxes(clean)
    done = state.filter("NOT open")
    state = state.filter("open")
    while not state.isEmpty():
        inner = cut(_one_inside(state.select("key", "cell_id", "cx", "cy", "r2"), boxes, levels, clean), "inside")
        done = done.unionByName(state.join(inner.select("cell_id"), "cell_id", "left_anti").select(*done.columns))
        state = state.join(inner, "cell_id")

        def pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                get = lambda *c: np.stack([batch.column(k).to_numpy() for k in c], 1)  # noqa: E731, B023
                tri, p, moved = get(*names).reshape(-1, 3, 3).copy(), get("px", "py", "pz"), get("mx", "my")
                tri[np.arange(len(tri)), leaving(moved, tri[:, :, :2], p[:, :2])] = p
                yield from as_table(batch.column("key"), batch.column("cell_id").to_numpy(), get("qx", "qy"), moved, tri, np.ones(len(tri), bool)).to_batches()

        state = cut(state.mapInArrow(pivot, kind), "triangles")

    def heights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda *c: np.stack([batch.column(k).to_numpy() for k in c], 1)  # noqa: E731, B023
            tri = get(*names).reshape(-1, 3, 3)
            z = (barycentric(get("qx", "qy"), tri[:, :, :2]) * tri[:, :, 2]).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column("cell_id"), pa.array(z)], ["cell_id", "z"])

    return done.mapInArrow(heights, "cell_id long, z double")


def _boxes(points: DataFrame) -> tuple[DataFrame, int]:
    """Boxes around the points of each tile, and around FAN x FAN boxes each, up to one a cloud: key, level, tx, ty and ends."""
    ends = [F.min("lx").alias("lx"), F.min("ly").alias("ly"), F.max("hx").alias("hx"), F.max("hy").alias("hy")]
    level = points.select("key", "tx", "ty", F.col("x").alias("lx"), F.col("y").alias("ly"), F.col("x").alias("hx"), F.col("y").alias("hy")).groupBy("key", "tx", "ty").agg(*ends)
    levels, out = 0, level.withColumn("level", F.lit(0))
    most = level.agg(F.greatest(F.max("tx"), F.max("ty"))).first()[0] or 0
    while most > 0:
        most, levels = most // FAN, levels + 1
        level = level.withColumns({"tx": F.floor(F.col("tx") / FAN), "ty": F.floor(F.col("ty") / FAN)}).groupBy("key", "tx", "ty").agg(*ends)
        out = out.unionByName(level.withColumn("level", F.lit(levels)))
    return cut(out, "boxes"), levels


def _one_inside(circle: DataFrame, boxes: DataFrame, levels: int, points: DataFrame) -> DataFrame:
    """For each circle (key, cell_id, cx, cy, r2) that has points inside, one of them: cell_id, px, py, pz.

    Boxes that a circle does not reach are passed over. A box wholly inside holds a point for certain, so the others are not
    looked at any more; otherwise only boxes on the circle's line are, which get fewer with every level."""
    now = circle.withColumns({"tx": F.lit(0).cast("long"), "ty": F.lit(0).cast("long")})
    within = F.lit(1 - 1e-9) * F.col("r2")
    for k in range(levels, -1, -1):
        met = now.join(boxes.filter(F.col("level") == k).drop("level"), ["key", "tx", "ty"])
        off = lambda c: F.greatest(F.col(f"l{c}") - F.col(f"c{c}"), F.col(f"c{c}") - F.col(f"h{c}"), F.lit(0.0))
        far = lambda c: F.greatest(F.abs(F.col(f"l{c}") - F.col(f"c{c}")), F.abs(F.col(f"h{c}") - F.col(f"c{c}")))
        met = met.filter(off("x") * off("x") + off("y") * off("y") < within)
        met = met.withColumn("far", far("x") * far("x") + far("y") * far("y"))
        w = Window.partitionBy("cell_id").orderBy("far", "tx", "ty")
        met = met.withColumn("nr", F.row_number().over(w)).withColumn("least", F.min("far").over(Window.partitionBy("cell_id")))
        now = met.filter((F.col("nr") == 1) | (F.col("least") >= within)).select("key", "cell_id", "cx", "cy", "r2", "tx", "ty")
        if k:
            step = F.array(*(F.lit(d) for d in range(FAN)))
            now = now.withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step))
            now = now.select("key", "cell_id", "cx", "cy", "r2", (F.col("tx") * FAN + F.col("dx")).alias("tx"), (F.col("ty") * FAN + F.col("dy")).alias("ty"))
    d2 = (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy"))
    inner = now.join(points, ["key", "tx", "ty"]).withColumn("d2", d2).filter(F.col("d2") < within)
    return inner.groupBy("cell_id").agg(F.min_by(F.struct("x", "y", "z"), F.struct("d2", "x", "y")).alias("p")).select("cell_id", F.col("p.x").alias("px"), F.col("p.y").alias("py"), F.col("p.z").alias("pz"))


@tidy("surface")
def surface(cells: DataFrame, points: DataFrame, cell: float, reach: float = float("inf")) -> DataFrame:
    """Heights of places (key, cell_id, x, y) over the points (key, point_id, x, y, z) of their cloud: key, cell_id, x, y, z, and how.

    linear: between the corners of the Delaunay triangle around the place. nearest: outside the hull of the cloud the height of the
    nearest point, at most ``reach`` away (ties: smaller point_id); the search begins with grid cells of size ``cell``. median: farther out the
    median height of the cloud. A cloud without usable points leaves its places null (how: none); so do places with a
    coordinate that is null or not finite, which take the median. cell_id is a place's own, across all clouds.
    """
    points = cut(points.filter("abs(x) < double('infinity') AND abs(y) < double('infinity') AND abs(z) < double('infinity') AND key IS NOT NULL"), "points")
    found = cut(linear_heights(cells, points), "linear")
    rest = cut(cells.join(found, "cell_id", "left_anti").filter("abs(x) < double('infinity') AND abs(y) < double('infinity') AND key IS NOT NULL"), "rest")
    near = _nearest(rest, points, cell, reach)
    middle = quantiles(points, "z", [0.5], "key").select("key", F.col("quantiles")[0].alias("middle"))
    out = cells.select("key", "cell_id", "x", "y").join(found.withColumnRenamed("z", "linear"), "cell_id", "left").join(near, "cell_id", "left").join(middle, "key", "left")
    how = F.when(F.col("linear").isNotNull(), "linear").when(F.col("nearest").isNotNull(), "nearest").when(F.col("middle").isNotNull(), "median").otherwise("none")
    return out.select("key", "cell_id", "x", "y", F.coalesce("linear", "nearest", "middle").alias("z"), how.alias("how"))


def _nearest(places: DataFrame, points: DataFrame, cell: float, reach: float) -> DataFrame:
    """Heights of the nearest points of the same cloud at most ``reach`` away: cell_id, nearest. Grid cells grow until all have one."""
    flat = points.select("key", (F.col("point_id") - (1 << 62)).alias("p"), "x", "y", F.lit(0.0).alias("z"), F.col("z").alias("height"))
    flat = cut(flat, "flat")
    seekers = places.join(flat.select("key").distinct(), "key", "left_semi").select("key", F.col("cell_id").alias("p"), "x", "y", F.lit(0.0).alias("z"))
    seekers, found = cut(seekers, "seekers"), None
    while not seekers.isEmpty():
        near = cut(_within(seekers, flat.drop("height"), 1, cell, 1, "p", "key").select("p", "other", "distance"), "near")
        found = near if found is None else found.unionByName(near)
        if cell >= reach:
            break
        seekers = cut(seekers.join(near, "p", "left_anti"), "seekers")
        cell *= 2
    if found is None:
        return places.select("cell_id", F.lit(None).cast("double").alias("nearest")).limit(0)
    return found.filter(F.col("distance") <= reach).join(flat.select(F.col("p").alias("other"), "height"), "other").select(F.col("p").alias("cell_id"), F.col("height").alias("nearest"))
