"""Training patches around points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions.georef import Affine, Grid, column_of, intersect, origin_of, reproject, row_of


def within(points: DataFrame, bounds: tuple[float, float, float, float]) -> DataFrame:
    """Points inside the bounds (left, bottom, right, top), edges included."""
    left, bottom, right, top = bounds
    return points.where(F.col("x").between(left, right) & F.col("y").between(bottom, top))


def locate(points: DataFrame, grid: Grid, size: int, crs: str | None = None) -> DataFrame:
    """Patch locations: centre and pixel bounds of a square of `size` pixels around every point of the grid's extent."""
    t, half = grid.transform, size * grid.transform.a / 2
    x, y = reproject(F.col("x"), F.col("y"), crs or grid.crs, grid.crs)
    moved = within(points.withColumns({"x": x, "y": y}), grid.bounds)
    return moved.select(
        "point_id", F.lit(grid.path or grid.raster_id).alias("image_path"), F.col("x").alias("center_x"), F.col("y").alias("center_y"),
        column_of(F.col("x") - half, t).alias("px_min"), row_of(F.col("y") + half, t).alias("py_min"),
        column_of(F.col("x") + half, t).alias("px_max"), row_of(F.col("y") - half, t).alias("py_max"),
    )


def inside(patches: DataFrame, grid: Grid) -> DataFrame:
    """Patches that lie wholly in the raster."""
    return patches.where((F.col("px_min") >= 0) & (F.col("px_max") <= grid.width) & (F.col("py_min") >= 0) & (F.col("py_max") <= grid.height))


def dense_ids(rows: DataFrame, key: str, name: str = "patch_id", start: int = 0, span: int = 1 << 20) -> DataFrame:
    """Consecutive ids in the order of a unique, non-negative integer key.

    Rows are numbered within spans of the key, and the spans' offsets come from their counts: no window holds more than
    `span` rows, and the running sum is over one row a span.
    """
    spanned = rows.withColumn("__span", F.floor(F.col(key) / span))
    counts = spanned.groupBy("__span").count()
    offsets = counts.select("__span", (F.sum("count").over(Window.orderBy("__span")) - F.col("count")).alias("__before"))
    number = F.row_number().over(Window.partitionBy("__span").orderBy(key))
    return spanned.withColumn("__number", number).join(offsets, "__span").withColumn(name, F.lit(start - 1) + F.col("__before") + F.col("__number")).drop("__span", "__before", "__number")


def origins(patches: DataFrame, transform: Affine) -> DataFrame:
    """The world origin of every patch; the resolution stays."""
    x, y = origin_of(F.col("py_min"), F.col("px_min"), transform)
    return patches.withColumns({"origin_x": x, "origin_y": y})


def shape_gate(height: Column, width: Column, size: int, compat: bool = False) -> Column:
    """crop, keep or skip for an image of this shape.

    Both sides must reach `size`.  With compat the shape is compared as a pair, so one long side outweighs a short one.
    """
    larger = F.struct(height, width) > F.struct(F.lit(size), F.lit(size)) if compat else (height >= size) & (width >= size) & ((height > size) | (width > size))
    return F.when(larger, "crop").when((height == size) & (width == size), "keep").otherwise("skip")


def align(first: DataFrame, first_grid: Grid, second: DataFrame, second_grid: Grid) -> DataFrame:
    """The common pixels of two rasters of one resolution: (row, col, first, second), counted from the common corner."""
    left, _, _, top = bounds = intersect(first_grid, second_grid)

    def placed(pixels: DataFrame, grid: Grid, name: str) -> DataFrame:
        t = grid.transform
        row0, col0 = round((top - t.f) / t.e), round((left - t.c) / t.a)
        high, wide = round((bounds[1] - top) / t.e), round((bounds[2] - left) / t.a)
        kept = pixels.where(F.col("row").between(row0, row0 + high - 1) & F.col("col").between(col0, col0 + wide - 1))
        return kept.select((F.col("row") - row0).alias("row"), (F.col("col") - col0).alias("col"), F.col("value").alias(name))

    return placed(first, first_grid, "first").join(placed(second, second_grid, "second"), ["row", "col"])
