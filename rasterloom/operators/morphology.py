"""Cleaning of binary masks (image_id, row, col, value): components, small objects, thinning, dilation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.operators.labelling import components, without_small  # noqa: F401  (part of this module's interface)
from rasterloom.sources.scratch import checkpointed

#: Parts over which the pixels of one component are dealt.
SALTS = 16

def component_sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("image_id", "label").agg(F.count("*").alias("size"))


def remove_small(labelled: DataFrame, min_size: int = 200) -> DataFrame:
    """The pixels of components of at least min_size pixels; those of a large one are dealt over SALTS parts.

    Straight from a mask, `labelling.without_small` does the same without a join of pixels.
    """
    large = component_sizes(labelled).where(F.col("size") >= min_size).withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = labelled.withColumn("__part", F.pmod(F.xxhash64("row", "col"), F.lit(SALTS)).cast("int"))
    return dealt.join(large, ["image_id", "label", "__part"], "left_semi").select("image_id", "row", "col", "label")


def dilate(mask: DataFrame, height: int, width: int, size: int = 3) -> DataFrame:
    """Set pixels (image_id, row, col) grown by a square of `size`, clipped to the image."""
    low = -((size - 1) // 2)
    reach = F.sequence(F.lit(low), F.lit(low + size - 1))
    grown = mask.where("value = 1").withColumn("dr", F.explode(reach)).withColumn("dc", F.explode(reach))
    placed = grown.select("image_id", (F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"))
    return placed.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)).distinct()


def thin(images: np.ndarray, steps: int | None = None) -> np.ndarray:
    """Zhang and Suen's thinning of boolean images (..., rows, columns).

    Two kinds of sub-iteration take turns to peel border pixels, until nothing changes or `steps` of them are done.
    """
    img = np.pad(images.astype(np.uint8), [(0, 0)] * (images.ndim - 2) + [(1, 1), (1, 1)])
    done, still = 0, 0
    while still < 2 and (steps is None or done < steps):
        n = [np.roll(img, s, (-2, -1)) for s in ((1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1))]  # clockwise from north
        count = sum(n)
        turns = sum((n[k] == 0) & (n[(k + 1) % 8] == 1) for k in range(8))
        north, east, south, west = n[0], n[2], n[4], n[6]
        free = (north * east * west == 0) & (north * south * west == 0) if done % 2 else (north * east * south == 0) & (east * south * west == 0)
        peel = (img == 1) & (count >= 2) & (count <= 6) & (turns == 1) & free
        still = 0 if peel.any() else still + 1
        img[peel] = 0
        done += 1
    return img[..., 1:-1, 1:-1].astype(bool)


def thinned(mask: DataFrame, height: int, width: int, block: int = 256, halo: int = 32) -> DataFrame:
    """(image_id, row, col) of the thinned set pixels.

    Images are thinned in blocks.  A block that has neighbours is read with a margin of `halo` pixels and takes `halo`
    (an even number of) sub-iterations, as far as its own pixels depend on the margin; then blocks exchange their pixels
    and go on, until a round changes nothing.  An image of one block is thinned at once.  A round ends in a checkpoint.
    """
    if halo % 2:
        raise ValueError("halo must be even: two kinds of sub-iteration take turns")
    pixels = mask.where("value = 1").select("image_id", "row", "col")
    alone = height <= block and width <= block
    margin = 0 if alone else halo
    side = block + 2 * margin
    rows, cols = (min(height, block), min(width, block)) if alone else (side, side)
    schema = "image_id long, i int, j int, cells array<int>, changed boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at_once = max(1, (1 << 22) // (rows * cols))
            for k in range(0, batch.num_rows, at_once):
                part = batch.slice(k, at_once)
                sizes = part.column(3).value_lengths().to_numpy(zero_copy_only=False)
                images = np.zeros((part.num_rows, rows * cols), bool)
                images[np.repeat(np.arange(part.num_rows), sizes), part.column(3).flatten().to_numpy()] = True
                images = images.reshape(-1, rows, cols)
                own = (slice(None), slice(margin, rows - margin or None), slice(margin, cols - margin or None))
                after = thin(images, None if alone else halo)[own]
                changed = (after != images[own]).any(axis=(1, 2)) & (not alone)
                which, r, c = np.nonzero(after)
                cells = pa.ListArray.from_arrays(pa.array(np.searchsorted(which, np.arange(part.num_rows + 1)), pa.int32()), pa.array((r * after.shape[2] + c).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], cells, pa.array(changed)], ["image_id", "i", "j", "cells", "changed"])

    while True:
        touched = lambda axis, size: F.explode(F.sequence(F.greatest(F.floor((F.col(axis) - margin) / block), F.lit(0)), F.least(F.floor((F.col(axis) + margin) / block), F.lit((size - 1) // block))).cast("array<int>"))
        placed = pixels.withColumn("i", touched("row", height)).withColumn("j", touched("col", width))
        cell = (F.col("row") - F.col("i") * block + margin) * cols + F.col("col") - F.col("j") * block + margin
        tiles = placed.groupBy("image_id", "i", "j").agg(F.collect_list(cell.cast("int")).alias("cells")).mapInArrow(run, schema)
        inner = cols - 2 * margin
        if not alone:
            tiles = checkpointed(tiles)
        found = tiles.select("image_id", "i", "j", F.explode("cells").alias("k"))
        pixels = found.select("image_id", (F.col("i") * block + F.floor(F.col("k") / inner)).cast("int").alias("row"), (F.col("j") * block + F.col("k") % inner).cast("int").alias("col"))
        if alone or tiles.where("changed").isEmpty():
            return pixels


def skeleton_buffer(mask: DataFrame, height: int, width: int, buffer_size: int = 3, block: int = 256, halo: int = 32) -> DataFrame:
    """Thinned and dilated set pixels (image_id, row, col)."""
    return dilate(thinned(mask, height, width, block, halo).withColumn("value", F.lit(1)), height, width, buffer_size)


def enough_area(mask: DataFrame, min_area: int) -> DataFrame:
    """(image_id, area) of images with at least min_area set pixels."""
    return mask.groupBy("image_id").agg(F.sum("value").alias("area")).where(F.col("area") >= min_area)
