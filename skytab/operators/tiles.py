"""Tiles and patches of rasters, splits, sampling weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUFFIX = r"_(2sec_|1fps_)?orthophoto$"


def orthophoto_id(stem: Column) -> Column:
    return F.regexp_replace(stem, SUFFIX, "")


def orthophoto_token(stem: Column) -> Column:
    """The other form of the id: marked endings go wherever they stand, a plain one stays."""
    return F.regexp_replace(stem, r"_(2sec|1fps)_orthophoto", "")


def assign_split(images: DataFrame, splits: DataFrame, image_id: str = "image_id", within: bool = False) -> DataFrame:
    """``images`` that a table (token, split) names, with split. within: the token may stand anywhere in the
    id, and of several the first split by train, val, test counts; else it must be the id. Splits are few."""
    order = F.array_position(F.array(F.lit("train"), F.lit("val"), F.lit("test")), F.col("split"))
    if not within:
        return images.join(splits.select(F.col("token").alias(image_id), "split"), image_id)
    held = splits.agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), "token", "split"))).alias("__s"))  # one row
    rows = images.join(F.broadcast(held))
    first = F.get(F.filter("__s", lambda x: F.contains(F.col(image_id), x["token"])), F.lit(0))
    return rows.withColumn("split", first["split"]).filter("split IS NOT NULL").drop("__s")


def tile_records(images: DataFrame, splits: DataFrame, size: int, stride: int) -> DataFrame:
    """Images x tiles x split: ``images`` (image_id, width, height, ...) that have a split, one row for each tile."""
    return iter_tiles(assign_split(images, splits), size, stride)


def tile_instances(pixels: DataFrame, tiles: DataFrame, image: str = "image", cell: int = 64, least_pixels: int = 4) -> DataFrame:
    """Instances as the tiles see them, from pixels (image, instance, px, py) and tiles (image, x, y, tile_width,
    tile_height): image, x, y, instance, n_pixels and the box x1, y1, x2, y2 (half open) within the tile.

    Pixels meet tiles by an equi join on grid cells, both shuffled: tiles times cells are far more than the files of the images tell. Fragments of fewer than ``least_pixels`` pixels are left out.
    """
    span = lambda c, n: F.sequence(F.floor(F.col(c) / cell), F.floor((F.col(c) + F.col(n) - 1) / cell))
    near = tiles.select(image, "x", "y", "tile_width", "tile_height", F.explode(span("x", "tile_width")).alias("__gx")).select("*", F.explode(span("y", "tile_height")).alias("__gy"))
    home = pixels.withColumns({"__gx": F.floor(F.col("px") / cell), "__gy": F.floor(F.col("py") / cell)})
    both = home.join(near.hint("merge"), [image, "__gx", "__gy"]).withColumns({"u": F.col("px") - F.col("x"), "v": F.col("py") - F.col("y")})
    both = both.filter("u >= 0 AND v >= 0 AND u < tile_width AND v < tile_height")
    box = [F.min("u").alias("x1"), F.min("v").alias("y1"), (F.max("u") + 1).alias("x2"), (F.max("v") + 1).alias("y2")]
    return both.groupBy(image, "x", "y", "instance").agg(F.count(F.lit(1)).alias("n_pixels"), *box).filter(F.col("n_pixels") >= least_pixels)


def origins(extent: Column, size: int, stride: int) -> Column:
    """Starts of tiles along a side: every stride, and one flush with the end."""
    last = F.greatest(extent - size, F.lit(0)).cast("int")
    return F.array_sort(F.array_distinct(F.array_append(F.sequence(F.lit(0), last, F.lit(stride)), last)))


def iter_tiles(rasters: DataFrame, size: int, stride: int, width: str = "width", height: str = "height") -> DataFrame:
    """``rasters`` with one row for each tile: ordinal (rows first), x, y, tile_width, tile_height."""
    if size <= 0 or stride <= 0:
        raise ValueError("size and stride must be positive")
    grid = rasters.withColumns({"__xs": origins(F.col(width), size, stride), "__ys": origins(F.col(height), size, stride)})
    grid = grid.select("*", F.posexplode("__ys").alias("__j", "y")).select("*", F.posexplode("__xs").alias("__i", "x"))
    out = grid.withColumn("ordinal", F.col("__j") * F.size("__xs") + F.col("__i"))
    out = out.withColumns({"tile_width": F.least(F.lit(size), F.col(width) - F.col("x")), "tile_height": F.least(F.lit(size), F.col(height) - F.col("y"))})
    return out.select(*rasters.columns, "ordinal", "x", "y", "tile_width", "tile_height")


def patches(rasters: DataFrame, size: int, stride: int, least: int = 16, stem: str = "stem") -> DataFrame:
    """``rasters`` with one row a patch, columns first, clipped at the right and the bottom; patches under
    ``least`` pixels a side are left out: x, y, patch_width, patch_height, name."""
    grid = rasters.filter("width > 0 AND height > 0")
    starts = lambda c: F.sequence(F.lit(0), (F.col(c) - 1).cast("int"), F.lit(stride))
    grid = grid.select("*", F.explode(starts("width")).alias("x")).select("*", F.explode(starts("height")).alias("y"))
    grid = grid.withColumns({"patch_width": F.least(F.lit(size), F.col("width") - F.col("x")), "patch_height": F.least(F.lit(size), F.col("height") - F.col("y"))})
    return grid.filter(f"patch_width >= {least} AND patch_height >= {least}").withColumn("name", F.format_string("%s_%d_%d_patch", stem, "x", "y"))


def fraction_weight(fraction: Column) -> Column:
    """Sampling weight by the share of building pixels: none, up to 1 %, up to 10 %, more."""
    return F.when(fraction <= 0, 0.5).when(fraction <= 0.01, 1.5).when(fraction <= 0.10, 3.0).otherwise(4.0)


def fraction_class(fraction: Column) -> Column:
    return F.when(fraction <= 0, "empty").when(fraction <= 0.01, "tiny").when(fraction <= 0.10, "small").otherwise("large")


def empty_tile_weight(tiles: DataFrame, positive: str, negative_ratio: float) -> DataFrame:
    """Add weight: 1 for positive tiles; empty ones share negative_ratio times the count of positive ones."""
    counts = tiles.agg(F.count_if(positive).alias("__p"), F.count_if(~F.col(positive)).alias("__e"))
    both = tiles.join(F.broadcast(counts))  # one row
    return both.withColumn("weight", F.when(F.col(positive), 1.0).otherwise(F.col("__p") * negative_ratio / F.greatest(F.col("__e"), F.lit(1)))).drop("__p", "__e")
