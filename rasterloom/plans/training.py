"""Training plans: image and label patches around points, and batches of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.georef import Affine, Grid, intersect
from rasterloom.operators import dataset, patches, tiling


def located(image_grid: Grid, label_grid: Grid, points: DataFrame, size: int, start_id: int = 0) -> DataFrame:
    """The patches of patch_pairs with their pixel bounds and world origins.

    Bounds are counted from the corner of the common area, as its pixels are.
    """
    left, bottom, right, top = intersect(image_grid, label_grid)
    t = image_grid.transform
    common = Grid(image_grid.raster_id, round((right - left) / t.a), round((bottom - top) / t.e), Affine(t.a, 0.0, left, 0.0, t.e, top), image_grid.crs)
    found = patches.dense_ids(patches.inside(patches.locate(points, common, size), common), "point_id", start=start_id)
    return patches.origins(found, common.transform)


def patch_pairs(image: DataFrame, image_grid: Grid, label: DataFrame, label_grid: Grid, points: DataFrame, size: int, start_id: int = 0) -> DataFrame:
    """(patch_id, r, c, first, second): image and label pixels of every patch that lies in the common area."""
    both = patches.align(image, image_grid, label, label_grid)
    found = located(image_grid, label_grid, points, size, start_id)
    pixels = both.select("row", "col", F.struct("first", "second").alias("value"))
    return tiling.window_pixels(found, pixels).select("patch_id", "r", "c", "value.first", "value.second")


def patch_tiles(pairs: DataFrame, places: DataFrame, size: int, grid: Grid, stacked: bool | None = False) -> DataFrame:
    """Patches as tiles to be written, each with its own origin (`places`) and the grid's coordinate system.

    Files are {id}_img.tif and {id}_lab.tif, or with `stacked` {id}_pair.tif with both bands, or all three with None;
    missing pixels are 0.
    """
    values = F.struct(F.col("first").cast("double").alias("first"), F.col("second").cast("double").alias("second"))
    cells = pairs.groupBy("patch_id").agg(F.collect_list(F.struct((F.col("r") * size + F.col("c")).cast("int").alias("k"), values.alias("v"))).alias("m"))
    band = lambda name: F.transform("m", lambda z: F.coalesce(z["v"][name], F.lit(0.0)).cast("float"))
    at = lambda start: F.transform("m", lambda z: z["k"] + start)
    single = [F.struct(F.lit(kind).alias("kind"), F.lit(1).alias("bands"), at(0).alias("at"), band(name).alias("data")) for kind, name in (("img", "first"), ("lab", "second"))]
    double = [F.struct(F.lit("pair").alias("kind"), F.lit(2).alias("bands"), F.concat(at(0), at(size * size)).alias("at"), F.concat(band("first"), band("second")).alias("data"))]
    files = F.array(*[*(single if not stacked else ()), *(double if stacked is not False else ())])
    placed = cells.join(places.select("patch_id", "origin_x", "origin_y"), "patch_id").withColumn("file", F.explode(files))
    return _tiles(placed, size, grid, "file.at")


def _tiles(placed: DataFrame, size: int, grid: Grid, *more: str) -> DataFrame:
    return placed.select(
        F.format_string("%d_%s.tif", "patch_id", "file.kind").alias("name"), F.lit(size).alias("height"), F.lit(size).alias("width"), *more, "file.data", "file.bands",
        "origin_x", "origin_y", F.lit(grid.transform.a).alias("resolution"), F.lit(grid.epsg).cast("int").alias("crs"),
    )


def cut_tiles(image: DataFrame, image_grid: Grid, label: DataFrame, label_grid: Grid, points: DataFrame, size: int, start_id: int = 0) -> DataFrame:
    """The tiles that patch_tiles, with None, makes of patch_pairs, cut from blocks of the rasters: no pixel of a patch is shuffled."""
    both = patches.align(image, image_grid, label, label_grid)
    found = located(image_grid, label_grid, points, size, start_id).select("patch_id", "px_min", "py_min", "px_max", "py_max", "origin_x", "origin_y")
    cut = tiling.window_tiles(found, both, size, ["first", "second"])
    file = lambda kind, bands, data: F.struct(F.lit(kind).alias("kind"), F.lit(bands).alias("bands"), data.alias("data"))
    files = F.array(file("img", 1, F.col("first")), file("lab", 1, F.col("second")), file("pair", 2, F.concat("first", "second")))
    return _tiles(cut.withColumn("file", F.explode(files)), size, image_grid)


def training_batches(pairs: DataFrame, size: int, batch: int, min_area: int, threshold: float = 30, epoch: int = 0) -> DataFrame:
    """(batch_id, slot, patch_id): shuffled whole batches of patches with enough label area, filled up from the start.

    No batch at all if no patch has enough of it.
    """
    area = pairs.groupBy("patch_id").agg(F.sum(F.when(F.col("second") > threshold, 1).otherwise(0)).alias("area"), F.count("*").alias("n"))
    usable = area.where((F.col("area") >= min_area) & (F.col("n") == size * size)).select("patch_id")
    n_batches = -(-usable.count() // batch)
    if not n_batches:
        return pairs.sparkSession.createDataFrame([], "batch_id int, slot int, patch_id long")
    return dataset.refilled(usable, "patch_id", batch, n_batches, epoch)
