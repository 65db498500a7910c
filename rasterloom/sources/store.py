"""Pixel tables on disk, laid out so that windows read little."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_pixels(pixels: DataFrame, path: str, block: int = 256, files: int | None = None) -> None:
    """Writes (raster_id?, band?, row, col, value, ...) sorted by blocks of `block` x `block` pixels.

    Rows are dealt by ranges of blocks and sorted by them, so a file covers few blocks and the extremes of its row groups
    prune by row and column.  A raster_id column becomes a folder, and so does a band column.
    """
    folders = [c for c in ("raster_id", "band") if c in pixels.columns]
    keyed = pixels.withColumns({"block_row": F.floor(F.col("row") / block).cast("int"), "block_col": F.floor(F.col("col") / block).cast("int")})
    order = [*folders, "block_row", "block_col"]
    dealt = keyed.repartitionByRange(files, *order) if files else keyed.repartitionByRange(*order)
    writer = dealt.sortWithinPartitions(*order, "row", "col").write.mode("overwrite")
    (writer.partitionBy(*folders) if folders else writer).parquet(path)


def read_pixels(spark: SparkSession, path: str, row_off: int | None = None, col_off: int | None = None, height: int | None = None, width: int | None = None, block: int = 256, **folders) -> DataFrame:
    """The stored pixels, of one window if it is given; folders: raster_id=..., band=... .

    All bounds are on stored columns and reach the scan as pushed filters; folder values prune whole folders.
    """
    found = spark.read.parquet(path)
    for name, value in folders.items():
        found = found.where(F.col(name) == value)
    for axis, off, size in (("row", row_off, height), ("col", col_off, width)):
        if off is not None and size is not None:
            last = off + size - 1
            found = found.where(F.col(f"block_{axis}").between(off // block, last // block) & F.col(axis).between(off, last))
    return found.drop("block_row", "block_col")
