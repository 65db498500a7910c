"""The prediction plan: tile, pad, fill, normalise, score, crop, suppress, merge."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions import radiometry
from rasterloom.functions.georef import Grid
from rasterloom.operators import tiling


def predict_mosaic(spark: SparkSession, pixels: DataFrame, grid: Grid, patch: int, overlap: int, model: Callable[[DataFrame], DataFrame] | None = None, nodata: float | None = None) -> DataFrame:
    """(row, col, pred) of a whole raster.

    `model` maps normalised tile pixels (row_off, col_off, r, c, value) to probabilities of the same shape; without one
    the value itself is the probability.  Single-precision probabilities are scored in single precision.  Padding and filled cells take part in a tile's extremes as zeros.
    """
    tiles = tiling.tile_grid(spark, grid, patch, overlap)
    padded = tiling.pad(tiling.to_tiles(pixels, grid, patch, overlap), tiles, patch)
    filled = padded.withColumn("value", radiometry.fill_nan(F.col("value"), nodata=nodata))
    scaled = filled.withColumn("value", radiometry.min_max_over(F.col("value"), "row_off", "col_off"))
    judged = model(scaled) if model else scaled
    scored = judged.withColumn("pred", radiometry.suppress(radiometry.score_of(judged, "value")))
    return tiling.merge_max(tiling.crop(scored, grid))
