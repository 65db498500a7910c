"""Connected components of masks of any size, and the removal of small ones.

Pixels are packed into blocks once, and blocks are labelled as arrays, many at a time.  Then the border graph is contracted
level by level: FAN x FAN blocks form a larger one, whose task joins the labels that touch inside of it and passes on the
pixels of its own border alone.  The number of levels follows from the raster's extent, so no round depends on how a
component winds, and no key is that of a component: all joins are by block.  On the way back each block is told what its
labels have become, and only then pixels are written, by one pass over the blocks.  Sizes are summed over the labels of
blocks, never over pixels.

A label is the least row * width + col of its component; so a label lies in its own block, which is found by arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.sources.scratch import stored

#: Blocks along each side of the next larger block; cells of the blocks that are labelled at once.
FAN, AT_ONCE = 8, 1 << 22
_PIXELS = "image_id long, row int, col int, label long"
_BLOCKS = "image_id long, i long, j long, cells array<int>, labels array<int>"
_LEVEL = "image_id long, i long, j long, old array<long>, new array<long>, rows array<int>, cols array<int>, labels array<long>"


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least member of each of n nodes' components, by hooking and pointer jumping over the edges."""
    parent = np.arange(n)
    while True:
        a, b = parent[left], parent[right]
        apart = a != b
        if not apart.any():
            return parent
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent[parent] != parent).any():
            parent = parent[parent]


def label_stack(stack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat places of the set pixels of boolean images (images x rows x columns), and those of their components' least pixels."""
    n, height, width = stack.shape
    places = np.flatnonzero(stack)
    number = np.full(stack.size + width, -1, np.int64)
    number[places] = np.arange(len(places))
    beside, below = places % width < width - 1, places // width % height < height - 1
    left, right = [], []
    for there, step in ((beside, 1), (below, width)):
        own = np.flatnonzero(there & (number[places + step] >= 0))
        left.append(own)
        right.append(number[places[own] + step])
    return places, places[roots(len(places), np.concatenate(left), np.concatenate(right))] if len(places) else places


def labelled_blocks(mask: DataFrame, block: int) -> DataFrame:
    """A stored row for each block that has set pixels: their places in it, ascending, and the places of their labels."""
    place = (F.col("row") % block * block + F.col("col") % block).cast("int")
    packed = mask.where("value = 1").groupBy("image_id", F.floor(F.col("row") / block).alias("i"), F.floor(F.col("col") / block).alias("j")).agg(F.collect_set(place).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_once = max(1, AT_ONCE // (block * block))
        for batch in batches:
            for k in range(0, batch.num_rows, at_once):
                part = batch.slice(k, at_once)
                n = part.num_rows
                stack = np.zeros((n, block * block), bool)
                stack[np.repeat(np.arange(n), part.column(3).value_lengths().to_numpy(zero_copy_only=False)), part.column(3).flatten().to_numpy()] = True
                places, least = label_stack(stack.reshape(n, block, block))
                ends = pa.array(np.searchsorted(places, np.arange(n + 1) * block * block).astype(np.int32))
                inside = lambda at: pa.ListArray.from_arrays(ends, pa.array((at % (block * block)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], inside(places), inside(least)], names=["image_id", "i", "j", "cells", "labels"])

    return stored(packed.select(F.col("image_id").cast("long").alias("image_id"), "i", "j", "cells").mapInArrow(run, _BLOCKS), "blocks")


def _borders(blocks: DataFrame, width: int, block: int) -> DataFrame:
    """The border pixels of each block: (image_id, i, j, rows, cols, labels), labels over the whole raster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, j = (np.repeat(batch.column(n).to_numpy(), batch.column("cells").value_lengths().to_numpy(zero_copy_only=False)) for n in "ij")
            owner = np.repeat(np.arange(batch.num_rows), batch.column("cells").value_lengths().to_numpy(zero_copy_only=False))
            at, least = (batch.column(n).flatten().to_numpy().astype(np.int64) for n in ("cells", "labels"))
            r, c = at // block, at % block
            edge = (r == 0) | (r == block - 1) | (c == 0) | (c == block - 1)
            owner, i, j, r, c, least = (x[edge] for x in (owner, i, j, r, c, least))
            ends = pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32))
            whole = (i * block + least // block) * width + j * block + least % block
            arrays = [(i * block + r).astype(np.int32), (j * block + c).astype(np.int32), whole]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.ListArray.from_arrays(ends, pa.array(x)) for x in arrays]], names=["image_id", "i", "j", "rows", "cols", "labels"])

    return blocks.mapInArrow(run, "image_id long, i long, j long, rows array<int>, cols array<int>, labels array<long>")


def _joined(parts: pa.Table, side: int) -> pa.Table:
    """One larger block of `side` pixels: what the labels of its parts become, and the pixels of its own border."""
    row, col, label = (np.concatenate([x.flatten().to_numpy() for x in parts.column(n).chunks]).astype(np.int64) for n in ("rows", "cols", "labels"))
    i, j = parts.column("i")[0].as_py() // FAN, parts.column("j")[0].as_py() // FAN
    key = (row - i * side) * (side + 1) + col - j * side  # one column more, so that lines do not run into each other
    order = np.argsort(key)
    key, row, col, label = key[order], row[order], col[order], label[order]
    old, number = np.unique(label, return_inverse=True)
    left, right = [], []
    for step in (1, side + 1):
        near = np.searchsorted(key, key + step)
        own = np.flatnonzero((near < len(key)) & (key[np.minimum(near, len(key) - 1)] == key + step)) if len(key) else np.zeros(0, np.int64)
        left.append(number[own])
        right.append(number[near[own]])
    new = old[roots(len(old), np.concatenate(left), np.concatenate(right))] if len(old) else old
    r, c = row - i * side, col - j * side
    edge = (r == 0) | (r == side - 1) | (c == 0) | (c == side - 1)
    moved = old != new
    lists = {"old": (old[moved], pa.int64()), "new": (new[moved], pa.int64()), "rows": (row[edge], pa.int32()), "cols": (col[edge], pa.int32()), "labels": (new[number[edge]] if len(old) else old, pa.int64())}
    return pa.table({"image_id": parts.column("image_id").slice(0, 1), "i": pa.array([i], pa.int64()), "j": pa.array([j], pa.int64()), **{n: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, t)) for n, (x, t) in lists.items()}})


def renamed(blocks: DataFrame, width: int, block: int) -> DataFrame | None:
    """(image_id, i, j, names: array of (old, new)) for blocks whose labels, over the raster, join others; None for single blocks."""
    last = blocks.agg(F.greatest(F.max("i"), F.max("j"))).first()[0]
    if not last:
        return None
    levels, side, parts, n = [], block, _borders(blocks, width, block), last + 1
    while n > 1:
        side, n = side * FAN, -(-n // FAN)
        above = parts.groupBy("image_id", F.floor(F.col("i") / FAN).alias("up"), F.floor(F.col("j") / FAN).alias("across")).applyInArrow(_at_side(side), _LEVEL)
        levels.append(stored(above, "level"))
        parts = levels[-1].select("image_id", "i", "j", "rows", "cols", "labels")
    names = _pairs(levels[-1])
    for level in levels[-2::-1]:
        # what the level's own new labels have become above
        side //= FAN
        own = _by_block(names, width, side)
        names = _pairs(level.select("image_id", "i", "j", "old", "new").join(own, ["image_id", "i", "j"], "left").mapInArrow(_through, "image_id long, i long, j long, old array<long>, new array<long>"))
    return _by_block(names, width, block)


def _at_side(side: int):
    return lambda parts: _joined(parts, side)


def _pairs(level: DataFrame) -> DataFrame:
    return level.select("image_id", F.explode(F.arrays_zip("old", "new")).alias("p")).select("image_id", "p.old", "p.new")


def _by_block(names: DataFrame, width: int, side: int) -> DataFrame:
    """Renamings by the block of `side` pixels in which the old label lies."""
    at = lambda v: F.floor(v / side)
    return names.groupBy("image_id", at(F.floor(F.col("old") / width)).alias("i"), at(F.col("old") % width).alias("j")).agg(F.collect_list(F.struct("old", "new")).alias("names"))


def _through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a level after the renamings of the level above, which also rename labels that the level left alone."""
    for batch in batches:
        rows = batch.to_pylist()
        old, new = [], []
        for r in rows:
            above = {p["old"]: p["new"] for p in r["names"] or ()}
            own = dict(zip(r["old"], r["new"], strict=True))
            whole = {a: above.get(b, b) for a, b in own.items()} | {a: b for a, b in above.items() if a not in own}
            old.append(list(whole))
            new.append(list(whole.values()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(old, pa.list_(pa.int64())), pa.array(new, pa.list_(pa.int64()))], names=["image_id", "i", "j", "old", "new"])


def _named(blocks: DataFrame, width: int, block: int) -> DataFrame:
    """Block rows with `names`, null where no label changes."""
    names = renamed(blocks, width, block)
    return blocks.withColumn("names", F.lit(None).cast("array<struct<old: bigint, new: bigint>>")) if names is None else blocks.join(names, ["image_id", "i", "j"], "left")


def _labels_of(batch: pa.RecordBatch, width: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every pixel of a batch of block rows: its block's number in the batch, row, column and label."""
    sizes = batch.column("cells").value_lengths().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(batch.num_rows), sizes)
    i, j = batch.column("i").to_numpy()[owner], batch.column("j").to_numpy()[owner]
    at, least = (batch.column(n).flatten().to_numpy().astype(np.int64) for n in ("cells", "labels"))
    label = (i * block + least // block) * width + j * block + least % block
    ends = np.concatenate([[0], np.cumsum(sizes)])
    for k, names in enumerate(batch.column("names").to_pylist()):
        if names:
            old, new = (np.array([p[n] for p in names]) for n in ("old", "new"))
            order = np.argsort(old)
            old, new, own = old[order], new[order], label[ends[k] : ends[k + 1]]
            found = np.minimum(np.searchsorted(old, own), len(old) - 1)
            label[ends[k] : ends[k + 1]] = np.where(old[found] == own, new[found], own)
    return owner, i * block + at // block, j * block + at % block, label


def _pixels(rows: DataFrame, width: int, block: int) -> DataFrame:
    """Pixels of block rows; with a column `kept`, only those whose label is in it."""
    some = "kept" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, row, col, label = _labels_of(batch, width, block)
            if some:
                kept = [np.array(k or [], np.int64) for k in batch.column("kept").to_pylist()]
                ends = np.searchsorted(owner, np.arange(batch.num_rows + 1))
                stays = np.concatenate([np.isin(label[a:b], k) for a, b, k in zip(ends, ends[1:], kept, strict=False)]) if kept else np.zeros(0, bool)
                owner, row, col, label = owner[stays], row[stays], col[stays], label[stays]
            yield pa.RecordBatch.from_arrays([batch.column("image_id").take(pa.array(owner)), pa.array(row, pa.int32()), pa.array(col, pa.int32()), pa.array(label, pa.int64())], names=["image_id", "row", "col", "label"])

    return rows.mapInArrow(run, _PIXELS)


def components(mask: DataFrame, width: int, block: int = 256) -> DataFrame:
    """(image_id, row, col, label) of the set pixels (image_id, row, col, value = 1); pixels that repeat count once."""
    return _pixels(_named(labelled_blocks(mask, block), width, block), width, block)


def without_small(mask: DataFrame, width: int, min_size: int, block: int = 256) -> DataFrame:
    """The pixels of components of at least min_size pixels, with their labels.

    Blocks report how many pixels each of their labels has; the sums decide which labels stay, and blocks are told theirs.
    """
    named = _named(labelled_blocks(mask, block), width, block)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, _, _, label = _labels_of(batch, width, block)
            order = np.lexsort((label, owner))
            owner, label = owner[order], label[order]
            first = np.flatnonzero(np.concatenate([[True], (np.diff(owner) > 0) | (np.diff(label) > 0)])) if len(label) else np.zeros(0, np.int64)
            which = pa.array(owner[first])
            yield pa.RecordBatch.from_arrays([*[batch.column(n).take(which) for n in ("image_id", "i", "j")], pa.array(label[first], pa.int64()), pa.array(np.diff(np.append(first, len(label))), pa.int64())], names=["image_id", "i", "j", "label", "size"])

    sizes = stored(named.mapInArrow(count, "image_id long, i long, j long, label long, size long"), "sizes")
    large = sizes.groupBy("image_id", "label").agg(F.sum("size").alias("size")).where(F.col("size") >= min_size).drop("size")
    kept = sizes.join(large, ["image_id", "label"], "left_semi").groupBy("image_id", "i", "j").agg(F.collect_list("label").alias("kept"))
    return _pixels(named.join(kept, ["image_id", "i", "j"]), width, block)
