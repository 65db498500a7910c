"""Tiles and windows: where they start, which pixels they cover, padding, patches and their reassembly.

Pixels are rows (row, col, value); a tile is found from a pixel by arithmetic, so covering windows is an explode and an
equi join, never a range join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StructField, StructType

from rasterloom.functions.georef import Grid
from rasterloom.operators.arrays import map_images, taps
from rasterloom.operators.catalog import dealt


def stride_of(patch: int, overlap: int) -> int:
    if patch - overlap <= 0:
        raise ValueError("the overlap must be smaller than the patch")
    return patch - overlap


def starts(extent: int | Column, patch: int, stride: int) -> Column:
    """0, stride, ... up to extent - patch, and extent - patch itself; only 0 for an extent within one patch."""
    extent = F.lit(extent) if isinstance(extent, int) else extent
    last = F.greatest(extent - patch, F.lit(0))
    return F.array_sort(F.array_union(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last)))


def starts_covering(at: Column, extent: int, patch: int, stride: int) -> Column:
    """The starts whose windows hold position `at`: the regular ones and the one at the far edge."""
    if extent <= patch:
        return F.array(F.lit(0))
    last = extent - patch
    low = F.greatest(F.lit(0), F.ceil((at - (patch - 1)) / F.lit(stride)).cast("int"))
    high = F.least(F.floor(at / F.lit(stride)).cast("int"), F.lit(last // stride))
    regular = F.when(low <= high, F.transform(F.sequence(low, F.greatest(low, high)), lambda k: k * stride)).otherwise(F.array().cast("array<int>"))
    edge = F.when(at >= last, F.array(F.lit(last))).otherwise(F.array().cast("array<int>"))
    return F.array_union(regular, edge)


def tile_grid(spark: SparkSession, grid: Grid, patch: int, overlap: int) -> DataFrame:
    """(row_off, col_off, height, width) of the windows of a raster, clipped to it.

    The k-th start is k strides, or the last possible one: windows are made in parallel from their number alone.
    """
    stride = stride_of(patch, overlap)
    last_row, last_col = max(grid.height - patch, 0), max(grid.width - patch, 0)
    down, across = -(-last_row // stride) + 1, -(-last_col // stride) + 1
    at = lambda k, last: F.least(k * stride, F.lit(last)).cast("int")
    tiles = spark.range(down * across).select(at(F.floor(F.col("id") / across), last_row).alias("row_off"), at(F.col("id") % across, last_col).alias("col_off"))
    return tiles.select("row_off", "col_off", F.least(F.lit(patch), grid.height - F.col("row_off")).alias("height"), F.least(F.lit(patch), grid.width - F.col("col_off")).alias("width"))


def to_tiles(pixels: DataFrame, grid: Grid, patch: int, overlap: int) -> DataFrame:
    """Every pixel once for each window that covers it: (row_off, col_off, r, c, value)."""
    stride = stride_of(patch, overlap)
    return (
        pixels.withColumn("row_off", F.explode(starts_covering(F.col("row"), grid.height, patch, stride)))
        .withColumn("col_off", F.explode(starts_covering(F.col("col"), grid.width, patch, stride)))
        .select("row_off", "col_off", (F.col("row") - F.col("row_off")).alias("r"), (F.col("col") - F.col("col_off")).alias("c"), "value")
    )


def cells(tiles: DataFrame, patch: int) -> DataFrame:
    """Every cell (r, c) of each tile."""
    side = F.sequence(F.lit(0), F.lit(patch - 1))
    return tiles.withColumn("r", F.explode(side)).withColumn("c", F.explode(side))


def pad(tile_pixels: DataFrame, tiles: DataFrame, patch: int, fill: float = 0.0) -> DataFrame:
    """Tiles with all their cells; those without a pixel hold `fill`.

    Pixels and empty cells are dealt together by tile, once: the windows here and any later one over the tile's key need
    no further shuffle, which a join on the cell would.
    """
    tile, value = ["row_off", "col_off"], F.coalesce(F.col("value").cast("double"), F.lit(fill))
    spine = cells(tiles.select(*tile), patch).select(*tile, "r", "c", F.lit(fill).alias("value"), F.lit(0).alias("__real"))
    both = tile_pixels.select(*tile, "r", "c", value.alias("value"), F.lit(1).alias("__real")).union(spine).repartition(*tile)
    best = F.max("__real").over(Window.partitionBy(*tile, "r", "c"))
    return both.withColumn("__best", best).where("__real = __best").select(*tile, "r", "c", "value")


def crop(tile_pixels: DataFrame, grid: Grid) -> DataFrame:
    """The cells of tiles that lie in the raster, with their place in it."""
    placed = tile_pixels.withColumns({"row": F.col("row_off") + F.col("r"), "col": F.col("col_off") + F.col("c")})
    return placed.where((F.col("row") < grid.height) & (F.col("col") < grid.width))


def read_window(pixels: DataFrame, row_off: int, col_off: int, height: int, width: int, grid: Grid | None = None) -> DataFrame:
    """The pixels of one window, clipped to the raster; the range reaches the scan as a pushed filter."""
    if grid is not None:
        height, width = min(height, grid.height - row_off), min(width, grid.width - col_off)
    inside = F.col("row").between(row_off, row_off + height - 1) & F.col("col").between(col_off, col_off + width - 1)
    return pixels.where(inside)


def window_pixels(patches: DataFrame, pixels: DataFrame, block: int = 128, lot: int = 1 << 20) -> DataFrame:
    """Pixels of each patch (patch_id, px_min, py_min, px_max, py_max), which are half open and may overlap: (patch_id, r, c, value).

    Pixels, one a place, are packed into blocks of `block` x `block`, and patches listed under every block that they touch.
    A block meets its patches once, as an array of places from which each patch takes its slice.  A block whose patches take
    more than `lot` pixels is copied, and its patches are dealt over the copies, so no task gets all of a crowded block.
    """
    key = ["block_row", "block_col"]
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / block), F.floor((F.col(b) - 1) / block)))
    usable = patches.select("patch_id", "px_min", "py_min", "px_max", "py_max").where("px_min < px_max AND py_min < py_max")
    listed = usable.withColumn("block_row", span("py_min", "py_max")).withColumn("block_col", span("px_min", "px_max"))
    shared = lambda low, high, at: F.least(F.col(high), (F.col(at) + 1) * block) - F.greatest(F.col(low), F.col(at) * block)
    taken = listed.groupBy(*key).agg(F.sum(shared("py_min", "py_max", "block_row") * shared("px_min", "px_max", "block_col")).alias("taken"))
    crowded = taken.where(F.col("taken") > lot).select(*key, F.ceil(F.col("taken") / lot).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("patch_id"), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = listed.join(crowded, key, "left").withColumn("part", part).drop("parts")
    place = ((F.col("row") % block) * block + F.col("col") % block).cast("int").alias("k")
    packed = pixels.withColumns({"block_row": F.floor(F.col("row") / block), "block_col": F.floor(F.col("col") / block)}).groupBy(*key).agg(F.collect_list(F.struct(place, "value")).alias("cells"))
    copied = packed.join(crowded, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    names = [*key, "part"]
    out = StructType([StructField("patch_id", patches.schema["patch_id"].dataType), StructField("r", IntegerType()), StructField("c", IntegerType()), StructField("value", pixels.schema["value"].dataType)])
    return dealt.groupBy(*names).cogroup(copied.groupBy(*names)).applyInArrow(lambda a, b: _slices(a, b, block), out)


def _slices(patches: pa.Table, blocks: pa.Table, block: int) -> pa.Table:
    """The pixels that each patch takes from one block."""
    cells = blocks.column("cells").combine_chunks()
    cells = (cells.chunk(0) if isinstance(cells, pa.ChunkedArray) else cells).flatten() if blocks.num_rows else pa.array([], cells.type.value_type)
    at = np.full((block, block), -1)
    at.ravel()[cells.field("k").to_numpy()] = np.arange(len(cells))
    columns = {n: patches.column(n).to_numpy() for n in ("px_min", "py_min", "px_max", "py_max", "block_row", "block_col")} if patches.num_rows else {}
    which, rows, cols, found = [], [], [], []
    for k in range(patches.num_rows if blocks.num_rows else 0):
        top, left = columns["py_min"][k] - columns["block_row"][k] * block, columns["px_min"][k] - columns["block_col"][k] * block
        high, right = columns["py_max"][k] - columns["block_row"][k] * block, columns["px_max"][k] - columns["block_col"][k] * block
        r0, c0 = max(top, 0), max(left, 0)
        own = at[r0:high, c0:right]
        r, c = np.nonzero(own >= 0)
        which.append(np.full(len(r), k))
        rows.append(r + (r0 - top))
        cols.append(c + (c0 - left))
        found.append(own[r, c])
    joined = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.table({"patch_id": patches.column("patch_id").take(pa.array(joined(which), pa.int64())), "r": pa.array(joined(rows), pa.int32()), "c": pa.array(joined(cols), pa.int32()), "value": cells.field("value").take(pa.array(joined(found), pa.int64()))})


def window_tiles(patches: DataFrame, pixels: DataFrame, size: int, bands: list[str], block: int = 64, lot: int = 1 << 20) -> DataFrame:
    """patches (px_min, py_min, px_max, py_max, ...) with each of the bands of pixels (row, col, ...) as an array of size x size values.

    Values lie row by row; missing ones and those beyond a patch's bounds are 0.  Patches without a pixel are left out.

    A patch is cut as a whole from the block that its corner lies in and the pixels up to `size` cells beyond, so pixels are
    shuffled before they are multiplied by the patches that share them, and tiles not at all.  Crowded blocks are copied as
    in `window_pixels`.  The parts of crowded blocks are broadcast, at most a row for `lot` pixels of all patches.
    """
    key, side = ["block_row", "block_col"], block + size - 1
    names = [*key, "part"]
    corner = lambda at: F.floor(F.col(at) / block)
    listed = patches.where("px_min < px_max AND py_min < py_max").withColumn("block_row", corner("py_min")).withColumn("block_col", corner("px_min"))
    crowded = listed.groupBy(*key).agg(F.ceil(F.count("*") * (size * size) / lot).cast("int").alias("parts")).where("parts > 1")
    parts = F.coalesce("parts", F.lit(1))
    copies = lambda rows: rows.join(F.broadcast(crowded), key, "left")
    placed = copies(listed).withColumn("part", F.pmod(F.xxhash64(*patches.columns), parts).cast("int")).drop("parts")
    near = lambda at: F.explode(F.sequence(F.floor((F.col(at) - (size - 1)) / block), F.floor(F.col(at) / block)))
    place = ((F.col("row") - F.col("block_row") * block) * side + F.col("col") - F.col("block_col") * block).cast("int").alias("k")
    spread = copies(pixels.withColumn("block_row", near("row")).withColumn("block_col", near("col"))).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    cells = spread.select(*names, place, *[F.coalesce(F.col(b).cast("float"), F.lit(0.0).cast("float")).alias(b) for b in bands])
    out = StructType([*patches.schema.fields, *[StructField(b, ArrayType(FloatType())) for b in bands]])
    return dealt(placed, *names).groupBy(*names).cogroup(dealt(cells, *names).groupBy(*names)).applyInArrow(lambda a, b: _tiles(a, b, size, bands, block, out.names), out)


def _tiles(patches: pa.Table, pixels: pa.Table, size: int, bands: list[str], block: int, names: list[str]) -> pa.Table:
    """The patches that have pixels of one block, with their values."""
    side = block + size - 1
    held = np.zeros((1 + len(bands), side * side), np.float32)  # whether there is a pixel, then the bands
    if pixels.num_rows and patches.num_rows:
        k = pixels.column("k").to_numpy()
        held[0, k] = 1
        for n, b in enumerate(bands, 1):
            held[n, k] = pixels.column(b).to_numpy()
    top, left, bottom, right = (patches.column(n).to_numpy().astype(np.int64) if patches.num_rows else np.zeros(0, np.int64) for n in ("py_min", "px_min", "py_max", "px_max"))
    windows = np.lib.stride_tricks.sliding_window_view(held.reshape(-1, side, side), (size, size), axis=(1, 2))[:, top % block, left % block]
    within = (np.arange(size)[:, None] < (bottom - top)[:, None, None]) & (np.arange(size) < (right - left)[:, None, None])
    windows = windows if within.all() else np.where(within, windows, np.float32(0))
    there = np.flatnonzero(windows[0].any(axis=(1, 2)))
    offsets = pa.array(np.arange(len(there) + 1, dtype=np.int32) * (size * size))
    arrays = [pa.ListArray.from_arrays(offsets, pa.array(w[there].ravel())) for w in windows[1:]]
    kept = patches.select(names[: -len(bands)]).take(pa.array(there))
    return pa.table([*kept.columns, *arrays], names=names)


def margined_blocks(pixels: DataFrame, grid: Grid, block: int, margin: int) -> DataFrame:
    """(block_row, block_col, k, v) of every block of the raster: places and values of its pixels and of those around it.

    k counts row by row in a square of block + 2 * margin cells whose corner lies `margin` before the block's; cells without
    a pixel are left out.  Windows that overlap much are cut from blocks, where each would have to be dealt its own pixels.
    Blocks are dealt in a fixed number of partitions, since few bytes of them make many windows.
    """
    key, side = ["block_row", "block_col"], block + 2 * margin
    down, across = -(-grid.height // block), -(-grid.width // block)
    near = lambda at, n: F.explode(F.sequence(F.greatest(F.floor((F.col(at) - margin) / block), F.lit(0)), F.least(F.floor((F.col(at) + margin) / block), F.lit(n - 1))))
    inside = pixels.where(F.col("row").between(0, grid.height - 1) & F.col("col").between(0, grid.width - 1))
    listed = inside.withColumn("block_row", near("row", down)).withColumn("block_col", near("col", across))
    place = (F.col("row") - F.col("block_row") * block + margin) * side + F.col("col") - F.col("block_col") * block + margin
    every = pixels.sparkSession.range(down * across).select(F.floor(F.col("id") / across).alias("block_row"), (F.col("id") % across).alias("block_col"), F.lit(None).cast("struct<k:int,v:double>").alias("cell"))
    both = listed.select(*key, F.struct(place.cast("int").alias("k"), F.col("value").cast("double").alias("v")).alias("cell")).union(every)
    packed = dealt(both, *key).groupBy(*key).agg(F.collect_list("cell").alias("cells"))  # without the nulls
    return packed.select(*key, F.transform("cells", lambda c: c["k"]).alias("k"), F.transform("cells", lambda c: c["v"]).alias("v"))


def _patches_along(extent: int, size: int, stride: int) -> int:
    if size % stride:
        raise ValueError("the size must be a multiple of the stride")
    return extent // stride - (size // stride - 1 if stride != size else 0)


def sliding_patches(images: DataFrame, height: int, width: int, size: int = 256, stride: int = 256) -> DataFrame:
    """(image_id, patch, r, c, value): patches in row-major order from images (image_id, row, col, value)."""
    down, across = _patches_along(height, size, stride), _patches_along(width, size, stride)

    def covering(at: Column, count: int) -> Column:
        low = F.greatest(F.lit(0), F.ceil((at - (size - 1)) / F.lit(stride)).cast("int"))
        high = F.least(F.floor(at / F.lit(stride)).cast("int"), F.lit(count - 1))
        return F.when(low <= high, F.sequence(low, F.greatest(low, high)))

    placed = images.withColumn("i", F.explode(covering(F.col("row"), down))).withColumn("j", F.explode(covering(F.col("col"), across)))
    return placed.select("image_id", (F.col("i") * across + F.col("j")).alias("patch"), (F.col("row") - F.col("i") * stride).alias("r"), (F.col("col") - F.col("j") * stride).alias("c"), "value")


def reconstruct(patches: DataFrame, height: int, width: int, size: int, stride: int) -> DataFrame:
    """Images from patches: where patches overlap the last one stays, and cells without a patch are 0."""
    across = width // stride + 1 - size // stride
    rows = F.floor(F.col("patch") / across).cast("int") * stride + F.col("r")
    cols = (F.col("patch") % across) * stride + F.col("c")
    place = F.when((rows < height) & (cols < width), rows * width + cols)
    return map_images(patches, place, F.col("patch"), (height, width), (height, width), lambda stack, _: stack)


def centre_pad(mask: DataFrame, height: int, width: int, wanted: int) -> DataFrame:
    """A mask (image_id, row, col, value) with zeros on all sides; an odd difference leaves it one short."""
    top, side = (wanted - height) // 2, (wanted - width) // 2
    margins = ((0, 0), (top, top), (side, side))
    return map_images(mask, F.col("row") * width + F.col("col"), None, (height, width), (height + 2 * top, width + 2 * side), lambda stack, _: np.pad(stack, margins))


def crop_margins(target: Column, refer: Column) -> tuple[Column, Column]:
    """Margins that crop a target extent to a smaller one; an odd pixel goes to the end.  An error if it is larger."""
    gap = F.when(target >= refer, target - refer).otherwise(F.raise_error(F.lit("the target is smaller than the reference")).cast("int"))
    return F.floor(gap / 2).cast("int"), F.ceil(gap / 2).cast("int")


def merge_max(scores: DataFrame) -> DataFrame:
    """The mosaic (row, col, pred) of overlapping scores, starting from 0."""
    return scores.groupBy("row", "col").agg(F.greatest(F.max("pred"), F.lit(0)).cast("smallint").alias("pred"))


def resize_bilinear(images: DataFrame, height: int, width: int, size: int) -> DataFrame:
    """(image_id, row, col, value) at size x size, half-pixel centres, edges repeated, no antialiasing; missing pixels are 0.

    Rows and columns are interpolated by one matrix each, for all images of a batch together.
    """
    down, across = taps(height, size), taps(width, size)
    return map_images(images, F.col("row") * width + F.col("col"), None, (height, width), (size, size), lambda stack, _: down @ stack @ across.T)
