"""Training sets: pairs, splits, shuffles, batches, augmentation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.operators import arrays


def key_hash(*parts: Column) -> Column:
    """A hash order that any engine can repeat: md5 over the parts joined by dashes."""
    return F.md5(F.concat_ws("-", *[p.cast("string") for p in parts]).cast("binary"))


def pair(images: DataFrame, labels: DataFrame, key: str = "patch_id") -> DataFrame:
    """Images with their labels, by id; either without the other is left out."""
    return images.join(labels, key)


def large_enough(images: DataFrame, size: int) -> DataFrame:
    return images.where((F.col("height") >= size) & (F.col("width") >= size))


def split(ids: DataFrame, key: str, share: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds is_val: the ceil(share * n) rows with the least hash.

    The threshold hash comes from a top-k of the hashes, so no task holds all rows.
    """
    hashed = ids.withColumn("__h", key_hash(F.lit(seed), F.col(key)))
    n = ids.count()
    wanted = -(-round(n * share * 1_000_000) // 1_000_000)
    if not wanted:
        return hashed.withColumn("is_val", F.lit(False)).drop("__h")
    # rank by hash within buckets of its first digits, offset by the counts of the buckets before
    return _ranked(hashed, "__h").withColumn("is_val", F.col("__rank") <= wanted).drop("__h", "__rank")


def _ranked(rows: DataFrame, key: str) -> DataFrame:
    """Adds __rank, the position of each row in the order of a hexadecimal hash, by 4096 buckets of its first digits."""
    bucketed = rows.withColumn("__b", F.substring(key, 1, 3))
    counts = bucketed.groupBy("__b").count()
    before = counts.select("__b", (F.sum("count").over(Window.orderBy("__b")) - F.col("count")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__b").orderBy(key))
    return bucketed.withColumn("__n", place).join(F.broadcast(before), "__b").withColumn("__rank", F.col("__before") + F.col("__n")).drop("__b", "__before", "__n")


def shuffled(ids: DataFrame, key: str, epoch: int = 0, seed: int = 42) -> DataFrame:
    """Adds position, the row's place (from 0) in this epoch's order."""
    hashed = ids.withColumn("__h", key_hash(F.lit(seed), F.lit(epoch), F.col(key)))
    return _ranked(hashed, "__h").withColumn("position", F.col("__rank") - 1).drop("__h", "__rank")


def batches(ids: DataFrame, key: str, size: int, epoch: int = 0, seed: int = 42) -> DataFrame:
    """Adds batch_id and slot; the last incomplete batch is left out."""
    n = ids.count()
    placed = shuffled(ids, key, epoch, seed)
    return placed.where(F.col("position") < n // size * size).select(*ids.columns, F.floor(F.col("position") / size).cast("int").alias("batch_id"), (F.col("position") % size).cast("int").alias("slot"))


def refilled(survivors: DataFrame, key: str, size: int, n_batches: int, epoch: int = 0, seed: int = 42) -> DataFrame:
    """n_batches full batches from the survivors, taken around again in order where they are too few."""
    n = survivors.count()
    if not n:
        raise ValueError("no patch is left to fill a batch")
    total = size * n_batches
    placed = shuffled(survivors.select(key), key, epoch, seed)
    again = placed.where(F.col("position") < total).withColumn("at", F.explode(F.sequence(F.col("position"), F.lit(total - 1), F.lit(n))))
    return again.select(F.floor(F.col("at") / size).cast("int").alias("batch_id"), (F.col("at") % size).cast("int").alias("slot"), key)


def steps_per_epoch(samples: int, batch_size: int) -> dict[str, int]:
    """Whole batches, and the figure that results where a batch count is divided by the batch size once more."""
    return {"intended": samples // batch_size, "divided_twice": samples // batch_size // batch_size}


def turned(row: Column, col: Column, height: int, width: int, flip: Column, quarter: Column) -> tuple[Column, Column]:
    """The place of a pixel after an optional left-right flip and `quarter` counter-clockwise quarter turns."""
    c = F.when(flip, width - 1 - col).otherwise(col)
    rows = F.when(quarter == 0, row).when(quarter == 1, width - 1 - c).when(quarter == 2, height - 1 - row).otherwise(c)
    cols = F.when(quarter == 0, c).when(quarter == 1, row).when(quarter == 2, width - 1 - c).otherwise(height - 1 - row)
    return rows, cols


def place_before(k: Column, size: int, flip: Column, quarter: Column) -> Column:
    """The row-major place in a square image from which the pixel comes that `turned` brings to place k."""
    row, col = F.floor(k / size).cast("int"), (k % size).cast("int")
    last = size - 1
    r = F.when(quarter == 0, row).when(quarter == 1, col).when(quarter == 2, last - row).otherwise(last - col)
    c = F.when(quarter == 0, col).when(quarter == 1, last - row).when(quarter == 2, last - col).otherwise(row)
    return (r * size + F.when(flip, last - c).otherwise(c)).cast("int")


def drawn_turn(key: Column, draw: int = 0, seed: int = 42) -> tuple[Column, Column]:
    """A flip with probability one half and a quarter turn, from a hash of the row's key."""
    digest = key_hash(F.lit(seed), F.lit(draw), key)
    digit = lambda k: F.conv(F.substring(digest, k, 1), 16, 10).cast("int")
    return digit(1) < 8, digit(2) % 4


def drawn(key: Column, name: str, low: float, high: float, draw: int = 0, seed: int = 42) -> Column:
    """A number from [low, high), uniform over keys, from a hash of the row's key and the name of what is drawn."""
    digest = key_hash(F.lit(seed), F.lit(draw), F.lit(name), key)
    return F.lit(low) + F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0) * F.lit(high - low)


def affine_sampled(
    images: DataFrame, height: int, width: int, degrees: float | Column, shear: float | Column, shift: float | Column, flip: bool | Column, fill: float = 0.0, order: int = 0, mode: str = "constant",
) -> DataFrame:
    """Images under a rotation, shear, vertical shift and flip about the centre, by the nearest pixel or (order 1) bilinear.

    The amounts may be columns made from image_id, so that every image has its own.  Beyond the image lies `fill`, or by
    mode its edge (`nearest`), its mirror image (`reflect`) or the image again (`wrap`).
    """
    if order not in (0, 1) or mode not in ("constant", "nearest", "reflect", "wrap"):
        raise ValueError(f"order {order} or fill mode {mode} is not known")
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    amounts = {"a": F.radians(lit(degrees)), "s": F.radians(lit(shear)), "shift": lit(shift), "flip": lit(flip).cast("int")}
    cy, cx = (height - 1) / 2, (width - 1) / 2

    def turn(stack: np.ndarray, own: dict[str, np.ndarray]) -> np.ndarray:
        a, s, shift, flip = (own[n][:, None] for n in ("a", "s", "shift", "flip"))
        row, col = (v.ravel()[None] for v in np.meshgrid(np.arange(height), np.arange(width), indexing="ij"))
        y, x = row - cy - shift * height, np.where(flip == 1, width - 1 - col, col) - cx
        sr = np.cos(a) * y + np.sin(a) * x + cy
        sc = (-np.sin(a) + np.tan(s) * np.cos(a)) * y + (np.cos(a) + np.tan(s) * np.sin(a)) * x + cx
        return arrays.sampled(stack, sr, sc, order, mode, fill)

    return arrays.map_images(images, F.col("row") * width + F.col("col"), None, (height, width), (height, width), turn, amounts)
