"""Images as arrays: pixels of an image are collected once, batches of images are worked on together, cells come out again.

One shuffle by image, and no join of cells.  An image has to fit a task, as patches do; whole rasters are tiled first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

#: Cells of the images that are worked on at once.
AT_ONCE = 1 << 20


def map_images(images: DataFrame, place: Column, rank: Column | None, shape: tuple[int, int], out_shape: tuple[int, int], function: Callable, amounts: dict[str, Column] | None = None, missing: float = 0.0) -> DataFrame:
    """(image_id, row, col, value) of every cell of `function`'s images.

    `place` is a pixel's place in an image of `shape`, row by row, and null where it has none; of pixels with one place
    that of highest `rank` stays.  function(stack, amounts) maps images x rows x columns to as many images of `out_shape`;
    amounts are columns made from image_id, as arrays by name.  Cells without a pixel hold `missing`.
    """
    amounts = amounts or {}
    names = tuple(amounts)
    cell = F.struct(*([rank.cast("long").alias("rank")] if rank is not None else []), place.cast("int").alias("k"), F.col("value").cast("double").alias("v"))
    # sorted by rank, where there is one, so that the highest is written last
    cells = F.array_sort(F.collect_list(cell)) if rank is not None else F.collect_list(cell)
    packed = images.withColumn("__place", place).groupBy("image_id").agg(F.filter(cells, lambda c: c["k"].isNotNull()).alias("cells"))
    rows = packed.select("image_id", F.transform("cells", lambda c: c["k"]).alias("k"), F.transform("cells", lambda c: c["v"]).alias("v"), *[c.cast("double").alias(n) for n, c in amounts.items()])
    (height, width), (high, wide) = shape, out_shape
    at_once = max(1, AT_ONCE // max(height * width, high * wide))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, cols = (x.ravel().astype(np.int32) for x in np.meshgrid(np.arange(high), np.arange(wide), indexing="ij"))
        for batch in batches:
            for start in range(0, batch.num_rows, at_once):
                part = batch.slice(start, at_once)
                n = part.num_rows
                which = np.repeat(np.arange(n), part.column(1).value_lengths().to_numpy(zero_copy_only=False))
                stack = np.full((n, height * width), missing)
                stack[which, part.column(1).flatten().to_numpy()] = part.column(2).flatten().to_numpy(zero_copy_only=False)
                found = function(stack.reshape(n, height, width), {name: part.column(name).to_numpy(zero_copy_only=False) for name in names})
                ids = part.column(0).take(pa.array(np.repeat(np.arange(n), high * wide)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(rows, n)), pa.array(np.tile(cols, n)), pa.array(found.ravel())], names=["image_id", "row", "col", "value"])

    return rows.mapInArrow(run, StructType([images.schema["image_id"], StructField("row", IntegerType()), StructField("col", IntegerType()), StructField("value", DoubleType())]))


def taps(extent: int, size: int) -> np.ndarray:
    """size x extent weights of bilinear resizing along one axis: half-pixel centres, edges repeated, no antialiasing."""
    at = (np.arange(size) + 0.5) * (extent / size) - 0.5
    low = np.floor(at).astype(int)
    share = at - low
    found = np.zeros((size, extent))
    for k, weight in ((low, 1 - share), (low + 1, share)):
        np.add.at(found, (np.arange(size), np.clip(k, 0, extent - 1)), weight)
    return found


def folded(at: np.ndarray, extent: int, mode: str) -> np.ndarray:
    """Whole places inside 0 .. extent - 1 for any: the edge repeated, mirrored edge included, or started over."""
    if mode == "nearest":
        return np.clip(at, 0, extent - 1)
    if mode == "reflect":
        at = np.mod(at, 2 * extent)
        return np.where(at < extent, at, 2 * extent - 1 - at)
    if mode == "wrap":
        return np.mod(at, extent)
    raise ValueError(f"fill mode {mode} is none of constant, nearest, reflect, wrap")


def sampled(stack: np.ndarray, y: np.ndarray, x: np.ndarray, order: int, mode: str, fill: float) -> np.ndarray:
    """Values of each image at its own places (images x cells): the nearest pixel (order 0) or bilinear (order 1).

    In mode `constant` places outside of the pixels' centres, for the nearest pixel outside of the image, give `fill`.
    """
    n, height, width = stack.shape
    which = np.arange(n)[:, None]
    # a null amount makes no image
    there = np.isfinite(y) & np.isfinite(x)
    y, x = np.where(there, y, 0), np.where(there, x, 0)
    if order == 0:
        i, j = np.floor(y + 0.5).astype(int), np.floor(x + 0.5).astype(int)
        inside = (i >= 0) & (i < height) & (j >= 0) & (j < width)
        edge = "nearest" if mode == "constant" else mode
        found = stack[which, folded(i, height, edge), folded(j, width, edge)]
    else:
        inside = (y >= 0) & (y <= height - 1) & (x >= 0) & (x <= width - 1)
        edge = "nearest" if mode == "constant" else mode
        i, j = np.floor(y).astype(int), np.floor(x).astype(int)
        u, v = y - i, x - j
        pixel = lambda di, dj: stack[which, folded(i + di, height, edge), folded(j + dj, width, edge)]
        found = (1 - u) * ((1 - v) * pixel(0, 0) + v * pixel(0, 1)) + u * ((1 - v) * pixel(1, 0) + v * pixel(1, 1))
    keep = there & inside if mode == "constant" else there
    return np.where(keep, found, fill)
