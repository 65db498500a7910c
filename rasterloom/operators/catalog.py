"""Many rasters at once: a catalog of headers meets points, and other rasters, through cells of a grid.

A catalog is a DataFrame (path, width, height, a, c, e, f, crs) of north-up rasters, as `read_rasters(..., "headers")`
gives it.  Everything with an extent is keyed by the cells of a grid whose cells are as large as the next power of two
above the extent, so it lies in four of them at most, whatever the sizes in a catalog are.  Points are keyed once for each
level that occurs; of two extents the smaller one is also keyed at the other's level.  So all joins are on equal keys,
followed by the exact test; keys carry salts, because points along a trail, or small rasters below a large one, share a
cell.

Rasters may have different coordinate systems.  Points have one: a raster's border is moved to it to find its cells, and
the exact test moves the point to the raster's system, both as arrays.  Only the levels of a catalog reach the driver; there
are at most `LEVELS` of them.  A raster without a system, or of one that is not known, is an error or has no points.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from rasterloom.functions.georef import Arrays, reproject

#: Points along each edge of a border that is moved; what its extent is enlarged by, as a share, since edges bend.
EDGE, BEND = 16, 0.02
#: Cells have sides from 2**-FINEST to 2**COARSEST; the extent of a raster whose border cannot be moved is the largest.
FINEST, COARSEST = 30, 27
LEVELS = FINEST + COARSEST + 1
#: Parts into which the rows of one cell are dealt.
SALTS = 8
#: Resolutions agree if they differ by no more than this share; classes of resolutions overlap by somewhat more.
SAME, CLASS_EDGE = 1e-9, 2e-9
#: Tasks for each core when rows are dealt out that are few and short but have much work each.
TASKS = 4


def with_bounds(catalog: DataFrame) -> DataFrame:
    """The catalog with left, bottom, right and top in each raster's own system."""
    return catalog.withColumns({"left": F.col("c"), "top": F.col("f"), "right": F.col("c") + F.col("a") * F.col("width"), "bottom": F.col("f") + F.col("e") * F.col("height")})


def level_of(*extents: Column) -> Column:
    """The level of the smallest cell that is as large as the extents."""
    return F.least(F.greatest(F.ceil(F.log2(F.greatest(*extents, F.lit(2.0**-FINEST)))), F.lit(-FINEST)), F.lit(COARSEST)).cast("int")


def cell_of(at: Column, level: Column) -> Column:
    return F.floor(at / F.pow(F.lit(2.0), level)).cast("long")


def dealt(rows: DataFrame, *keys: str | Column) -> DataFrame:
    """rows by the keys, in a fixed number of partitions: Spark would put short rows into few ones, whatever they grow to."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS * spark.sparkContext.defaultParallelism), *keys)


def _cells(rows: DataFrame, level: Column, left: str, bottom: str, right: str, top: str) -> DataFrame:
    """A row for each cell of the level that the extent meets."""
    span = lambda low, high: F.explode(F.sequence(cell_of(F.col(low), F.col("level")), cell_of(F.col(high), F.col("level"))))
    return rows.withColumn("level", level).withColumn("cell_x", span(left, right)).withColumn("cell_y", span(bottom, top))


def footprints(catalog: DataFrame, crs: str) -> DataFrame:
    """The catalog with bounds and fx0, fy0, fx1, fy1: an extent in `crs` that holds each raster.

    Where a border leaves the area that the system can show, that is an extent that holds everything.
    """
    placed = with_bounds(catalog)
    names = ("left", "bottom", "right", "top", "crs")
    out = pa.schema([pa.field(n, pa.float64()) for n in ("fx0", "fy0", "fx1", "fy1")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = np.arange(EDGE + 1) / EDGE
        for batch in batches:
            left, bottom, right, top = (batch.column(n).to_numpy(zero_copy_only=False)[:, None] for n in names[:4])
            x, y = left + (right - left) * share, bottom + (top - bottom) * share
            xs, ys = np.hstack([x, x, np.repeat(left, EDGE + 1, 1), np.repeat(right, EDGE + 1, 1)]), np.hstack([np.repeat(bottom, EDGE + 1, 1), np.repeat(top, EDGE + 1, 1), y, y])
            systems = batch.column("crs").to_pylist()
            mx, my = moved(xs, ys, systems, [crs] * len(systems))
            shown = np.isfinite(mx).all(1) & np.isfinite(my).all(1) & (np.abs(mx) < 2.0**COARSEST).all(1) & (np.abs(my) < 2.0**COARSEST).all(1)
            found = []
            for v in (mx, my):
                low, high = v.min(1), v.max(1)
                room = (high - low) * BEND
                found.append((np.where(shown, low - room, -(2.0**COARSEST)), np.where(shown, high + room, 2.0**COARSEST)))
            (x0, x1), (y0, y1) = found
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, (x0, y0, x1, y1))], schema=pa.schema([*batch.schema, *out]))

    return placed.mapInArrow(run, StructType([*placed.schema.fields, *[StructField(f.name, DoubleType()) for f in out]]))


def moved(x: np.ndarray, y: np.ndarray, sources: list[str], targets: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of coordinates, each moved from its own system to its own target; a null system gives NaN."""
    found = np.full(x.shape, np.nan), np.full(x.shape, np.nan)
    coded = [pa.array(names, pa.string()).dictionary_encode() for names in (sources, targets)]
    at = [c.indices.fill_null(len(c.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64) for c in coded]
    names = [[*c.dictionary.to_pylist(), None] for c in coded]
    both = at[0] * len(names[1]) + at[1]
    with np.errstate(all="ignore"):
        for pair in np.unique(both):
            source, target = names[0][pair // len(names[1])], names[1][pair % len(names[1])]
            if source and target:
                rows = np.flatnonzero(both == pair)
                found[0][rows], found[1][rows] = reproject(x[rows], y[rows], source, target, Arrays)
    return found


def points_in(points: DataFrame, catalog: DataFrame, crs: str) -> DataFrame:
    """Every point (point_id, x, y, ...) in `crs` with every raster whose extent holds it, edges included.

    Adds the catalog's columns, its bounds, and x and y in the raster's system as center_x and center_y.
    """
    covered = footprints(catalog, crs)
    level = level_of(F.col("fx1") - F.col("fx0"), F.col("fy1") - F.col("fy0"))
    levels = sorted(r.level for r in covered.select(level.alias("level")).distinct().collect())
    if not levels:
        levels = [0]  # an empty catalog
    listed = _cells(covered, level, "fx0", "fy0", "fx1", "fy1").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keyed = points.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).withColumns({"cell_x": cell_of(F.col("x"), F.col("level")), "cell_y": cell_of(F.col("y"), F.col("level")), "__salt": F.pmod(F.xxhash64("point_id"), F.lit(SALTS)).cast("int")})
    near = F.col("x").between(F.col("fx0"), F.col("fx1")) & F.col("y").between(F.col("fy0"), F.col("fy1"))
    keys = ["level", "cell_x", "cell_y", "__salt"]
    both = dealt(keyed, *keys).join(dealt(listed, *keys), keys).where(near).drop("level", "cell_x", "cell_y", "__salt", "fx0", "fy0", "fx1", "fy1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in "xy")
            own = batch.column("crs").to_pylist()
            at = [pa.array(v) for v in moved(x, y, [crs] * len(own), own)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *at], schema=pa.schema([*batch.schema, pa.field("center_x", pa.float64()), pa.field("center_y", pa.float64())]))

    placed = both.mapInArrow(run, StructType([*both.schema.fields, StructField("center_x", DoubleType()), StructField("center_y", DoubleType())]))
    inside = F.col("center_x").between(F.col("left"), F.col("right")) & F.col("center_y").between(F.col("bottom"), F.col("top"))
    return placed.where(inside)


def locate(points: DataFrame, catalog: DataFrame, size: int, crs: str) -> DataFrame:
    """Patch locations as `patches.locate` gives them, of every point in every raster that holds it, and the raster's shape."""
    half = F.lit(size) * F.col("a") / 2
    col = lambda x: F.floor((x - F.col("c")) / F.col("a")).cast("int")
    row = lambda y: F.floor((y - F.col("f")) / F.col("e")).cast("int")
    x, y = F.col("center_x"), F.col("center_y")
    return points_in(points, catalog, crs).select(
        "point_id", F.col("path").alias("image_path"), "center_x", "center_y", col(x - half).alias("px_min"), row(y + half).alias("py_min"), col(x + half).alias("px_max"), row(y - half).alias("py_max"), "width", "height",
    )


def inside(located: DataFrame) -> DataFrame:
    """Patches that lie wholly in their raster."""
    return located.where((F.col("px_min") >= 0) & (F.col("px_max") <= F.col("width")) & (F.col("py_min") >= 0) & (F.col("py_max") <= F.col("height")))


def overlapping(images: DataFrame, masks: DataFrame) -> DataFrame:
    """Pairs of an image and a mask of one system and resolution that have an area in common.

    (image_path, mask_path, crs, left, bottom, right, top, height, width, image_row, image_col, mask_row, mask_col): the
    common area, its size in pixels, the smaller one where rounding differs, and where it starts in either raster.
    """
    sides = []
    for name, catalog in (("image", images), ("mask", masks)):
        whole = with_bounds(catalog)
        sides.append(whole.select("crs", F.struct(*[F.col(c) for c in ("path", "width", "height", "a", "c", "e", "f", "left", "bottom", "right", "top")]).alias(name), level_of(F.col("right") - F.col("left"), F.col("top") - F.col("bottom")).alias("own")))
    own = [sorted(r.own for r in side.select("own").distinct().collect()) for side in sides]
    # A pair meets at the larger one's level only: the image's (fit 0), or the mask's if the image is smaller (fit 1).
    # Classes of resolutions have their edges where a power of two has none; a resolution near an edge counts to both.
    resolution = lambda a: F.floor(F.log2(F.abs(a)) + 0.3)
    above_at = {True: lambda v: F.struct(v.alias("level"), F.lit(1).alias("fit")), False: lambda v: F.struct(v.alias("level"), F.lit(0).alias("fit"))}
    keys, keyed = ["crs", "level", "fit", "resolution", "cell_x", "cell_y", "__image", "__mask"], []
    for name, side, fixed, other, smaller in (("image", sides[0], "__image", "__mask", own[1]), ("mask", sides[1], "__mask", "__image", own[0])):
        is_image = name == "image"
        at = F.struct(F.col("own").alias("level"), F.lit(0).alias("fit")), F.struct(F.col("own").alias("level"), F.lit(1).alias("fit"))
        above = F.transform(F.filter(F.array(*map(F.lit, smaller)).cast("array<int>"), lambda v: v > F.col("own")), above_at[is_image])
        a = F.col(f"{name}.a")
        classes = F.array_distinct(F.array(resolution(a * (1 - CLASS_EDGE)), resolution(a * (1 + CLASS_EDGE)))) if is_image else F.array(resolution(a))
        placed = side.withColumn("__at", F.explode(F.concat(F.array(*(at[:1] if is_image else at)), above))).withColumn("resolution", F.explode(classes)).withColumn("fit", F.col("__at.fit"))
        cells = _cells(placed, F.col("__at.level"), f"{name}.left", f"{name}.bottom", f"{name}.right", f"{name}.top").drop("__at", "own")
        first = {f"{name}_first_{axis}": F.col(f"cell_{axis}") == cell_of(F.col(f"{name}.{low}"), F.col("level")) for axis, low in (("x", "left"), ("y", "bottom"))}
        salted = cells.withColumns(first).withColumn(fixed, F.pmod(F.xxhash64(f"{name}.path"), F.lit(SALTS // 2)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(SALTS // 2 - 1))))
        keyed.append(dealt(salted, *keys))
    both = keyed[0].join(keyed[1], keys)
    # a pair meets in every cell that both touch; the one that holds the lower left corner of what they share counts
    once = (F.col("image_first_x") | F.col("mask_first_x")) & (F.col("image_first_y") | F.col("mask_first_y"))
    same = reduce(Column.__and__, [F.abs(F.col(f"image.{k}") - F.col(f"mask.{k}")) <= SAME * F.abs(F.col(f"image.{k}")) for k in "ae"])
    meet = [F.col(f"{one}.{low}") < F.col(f"{other}.{high}") for low, high in (("left", "right"), ("bottom", "top")) for one, other in (("image", "mask"), ("mask", "image"), ("image", "image"), ("mask", "mask"))]
    shared = both.where(once & same & reduce(Column.__and__, meet))
    # bound one after the other by lambdas: a filter on these columns would be pushed into the join with all of them written out
    area = F.struct(F.greatest("image.left", "mask.left").alias("left"), F.greatest("image.bottom", "mask.bottom").alias("bottom"), F.least("image.right", "mask.right").alias("right"), F.least("image.top", "mask.top").alias("top"))
    names = {"row": ("top", "f", "e"), "col": ("left", "c", "a")}
    place = lambda z, side, axis: F.round((z[names[axis][0]] - F.col(f"{side}.{names[axis][1]}")) / F.col(f"{side}.{names[axis][2]}")).cast("int")
    starts = lambda z: F.struct(*[z[n].alias(n) for n in ("left", "bottom", "right", "top")], *[place(z, side, axis).alias(f"{side}_{axis}") for side in ("image", "mask") for axis in ("row", "col")])
    extent = lambda z, high, low, step, side, axis: F.least(F.round((z[high] - z[low]) / F.col(f"image.{step}")).cast("int"), *[F.col(f"{n}.{side}") - z[f"{n}_{axis}"] for n in ("image", "mask")]).alias(side)
    order = ("left", "bottom", "right", "top"), ("image_row", "image_col", "mask_row", "mask_col")
    sized = lambda z: F.struct(*[z[n].alias(n) for n in order[0]], extent(z, "bottom", "top", "e", "height", "row"), extent(z, "right", "left", "a", "width", "col"), *[z[n].alias(n) for n in order[1]])
    found = F.filter(F.transform(F.transform(F.array(area), starts), sized), lambda z: (z["height"] > 0) & (z["width"] > 0))
    return shared.select(F.col("image.path").alias("image_path"), F.col("mask.path").alias("mask_path"), "crs", F.inline(found))


def pair_patches(points: DataFrame, images: DataFrame, masks: DataFrame, size: int, crs: str) -> DataFrame:
    """Windows of `size` x `size` pixels around points in every image and in the masks below them, for `read_windows`.

    (point_id, image_path, mask_path, kind, path, row_off, col_off, height, width): two rows a patch, one of kind `image`
    and one of kind `mask`; only patches that lie wholly in the area common to both.
    """
    common = overlapping(images, masks).withColumnsRenamed({"height": "common_height", "width": "common_width"}).drop("crs", "left", "bottom", "right", "top")
    # an image may hold most points
    salt, salts = F.pmod(F.xxhash64("point_id"), F.lit(SALTS)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    found = locate(points, images, size, crs).withColumn("__salt", salt).join(common.withColumn("__salt", salts), ["image_path", "__salt"])
    row, col = F.col("py_min") - F.col("image_row"), F.col("px_min") - F.col("image_col")
    whole = found.where((row >= 0) & (col >= 0) & (row + size <= F.col("common_height")) & (col + size <= F.col("common_width")))
    window = lambda kind: F.struct(F.lit(kind).alias("kind"), F.col(f"{kind}_path").alias("path"), (row + F.col(f"{kind}_row")).alias("row_off"), (col + F.col(f"{kind}_col")).alias("col_off"))
    return whole.select("point_id", "image_path", "mask_path", F.explode(F.array(window("image"), window("mask"))).alias("w")).select("point_id", "image_path", "mask_path", "w.*", F.lit(size).alias("height"), F.lit(size).alias("width"))
