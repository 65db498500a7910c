"""A Spark data source for TIFF rasters that reads by ranges of bytes.

    read_rasters(spark, "hdfs://store/rasters", rows=(0, 512), bands=[1])

Views: `headers` (one row a file), `blocks` (one row for each strip or tile and band), `pixels`.  Files are packed into
partitions by their size.  A file larger than `partition_bytes` is split by ranges of its strips or tiles, for which its
header is read while the scan is planned; headers of other files are read by the tasks.  Files, strips, tiles and bands
outside of the window, bands and paths that are asked for are neither planned nor fetched.  `read_windows` fetches many
windows, each from its own file, where the rows that describe them lie.  Bytes come through pyarrow's file systems; a store
that only Spark reaches needs `tiff.files`, which reads whole files.

The window is an option of each load and no pushed filter: Spark 4.1 keeps the filters that it pushed into a Python source
with the loaded table, so the same frame under two conditions in one query would lose rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rasterloom.sources.ranges import Member, RangeFile, listed, members
from rasterloom.sources.tiff import Tiff

HEADERS = "path string, width int, height int, band_count int, dtype string, crs string, nodata double, a double, c double, e double, f double"
BLOCKS = "path string, band int, row_off int, col_off int, height int, width int, data array<double>"
PIXELS = "path string, band int, row int, col int, value double"
_SCHEMAS = {"headers": HEADERS, "blocks": BLOCKS, "pixels": PIXELS}
_ARROW = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
#: Headers that one planning process reads at a time; pixels that one batch holds.
THREADS, BATCH = 16, 1 << 18
#: Headers of one batch.
HEADS = 1 << 12
#: Bytes of decoded blocks that windows of one file share.
KEEP = 1 << 25
_FAR = 1 << 31


@dataclass
class Piece:
    """A file, or the blocks of one with these rows and columns (half open); last None: all."""

    path: str
    rows: tuple[int, int | None] = (0, None)
    cols: tuple[int, int | None] = (0, None)


@dataclass
class Pieces(InputPartition):
    pieces: list[Piece]


class RasterReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.view = options.get("view", "pixels")
        if self.view not in _SCHEMAS:
            raise ValueError(f"view {self.view} is none of {', '.join(_SCHEMAS)}")
        path = options["path"]
        self.roots = json.loads(path) if path.startswith("[") else [path]
        self.glob, self.size = options.get("glob", "*.tif"), int(options.get("partition_bytes", 64 << 20))
        chosen = lambda name: json.loads(options[name]) if name in options else None
        self.row_range, self.col_range = chosen("rows") or (0, _FAR), chosen("cols") or (0, _FAR)
        self.bands, self.names = chosen("bands"), chosen("names")

    def partitions(self) -> list[Pieces]:
        found = [(path, size) for root in self.roots for path, size in listed(root, self.glob) if self.names is None or path.rsplit("/", 1)[-1] in self.names]
        small = [f for f in found if f[1] <= self.size or self.view == "headers"]
        with ThreadPoolExecutor(THREADS) as pool:
            parts = [Pieces([p]) for pieces in pool.map(self.split, [path for path, size in found if size > self.size and self.view != "headers"]) for p in pieces]
        held, room = [], 0
        for path, size in small:
            cost = 4096 if self.view == "headers" else size + 4096
            if held and room < cost:
                parts.append(Pieces(held))
                held = []
            if not held:
                room = self.size // 16 if self.view == "headers" else self.size
            held.append(Piece(path))
            room -= cost
        return [*parts, Pieces(held)] if held or not parts else parts

    def window(self, tiff: Tiff) -> tuple[int, int, int, int]:
        """The wanted rows and columns of a raster, half open."""
        return max(0, self.row_range[0]), min(tiff.height, self.row_range[1]), max(0, self.col_range[0]), min(tiff.width, self.col_range[1])

    def split(self, path: str) -> list[Piece]:
        """Ranges of a large file's blocks that hold about `size` bytes of pixels each, of those that the window meets."""
        with RangeFile(path) as file:
            tiff = Tiff(file)
        r0, r1, c0, c1 = self.window(tiff)
        if r0 >= r1 or c0 >= c1:
            return []
        down, across = tiff.touched(r0, c0, r1 - r0, c1 - c0)
        block = tiff.block_width * tiff.block_height * tiff.bands * tiff.dtype.itemsize
        wide = max(1, min(len(across), self.size // block))
        high = max(1, self.size // (block * len(across))) if wide == len(across) else 1
        return [Piece(path, (i, min(i + high, down.stop)), (j, min(j + wide, across.stop))) for i in range(down.start, down.stop, high) for j in range(across.start, across.stop, wide)]

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        for piece in partition.pieces:
            with RangeFile(piece.path) as file:
                yield from self.rows(piece, Tiff(file))

    def rows(self, piece: Piece, tiff: Tiff) -> Iterator[pa.RecordBatch]:
        if self.view == "headers":
            yield self.heads([self.head(piece.path, tiff)])
            return
        r0, r1, c0, c1 = self.window(tiff)
        bh, bw = tiff.block_height, tiff.block_width
        r0, r1 = max(r0, piece.rows[0] * bh), min(r1, r1 if piece.rows[1] is None else piece.rows[1] * bh)
        c0, c1 = max(c0, piece.cols[0] * bw), min(c1, c1 if piece.cols[1] is None else piece.cols[1] * bw)
        bands = [b for b in range(tiff.bands) if self.bands is None or b + 1 in self.bands]
        if r0 >= r1 or c0 >= c1 or not bands:
            return
        down, across = tiff.touched(r0, c0, r1 - r0, c1 - c0)
        for i in down:
            top, high = max(r0, i * bh), min(r1, i * bh + bh)
            # blocks of one row of blocks are read together, as many as a batch holds
            step = max(1, BATCH // (bh * bw * len(bands)))
            for j in range(across.start, across.stop, step):
                left, right = max(c0, j * bw), min(c1, (j + step) * bw)
                yield from self.cells(piece.path, tiff, top, high, left, right, bands)

    def head(self, path: str, tiff: Tiff) -> tuple:
        g = tiff.grid(path, path)
        t = g.transform
        return path, g.width, g.height, g.band_count, g.dtype, g.crs, g.nodata, t.a, t.c, t.e, t.f

    def heads(self, rows: list[tuple]) -> pa.RecordBatch:
        return self.batch(list(zip(*rows, strict=True)) or [[] for _ in HEADERS.split(", ")])

    def cells(self, path: str, tiff: Tiff, top: int, high: int, left: int, right: int, bands: list[int]) -> Iterator[pa.RecordBatch]:
        data = tiff.read(top, left, high - top, right - left, bands).astype(np.float64)
        if self.view == "blocks":
            edges = [left, *range(left - left % tiff.block_width + tiff.block_width, right, tiff.block_width), right]
            parts = [(b, a, data[n, :, a - left : z - left]) for n, b in enumerate(bands) for a, z in zip(edges, edges[1:], strict=False)]
            yield self.batch([[path] * len(parts), [b + 1 for b, _, _ in parts], [top] * len(parts), [a for _, a, _ in parts], [p.shape[0] for *_, p in parts], [p.shape[1] for *_, p in parts], [p.ravel() for *_, p in parts]])
            return
        rows, cols = (x.ravel() for x in np.meshgrid(np.arange(top, high), np.arange(left, right), indexing="ij"))
        for n, b in enumerate(bands):
            values = data[n].ravel()
            for k in range(0, len(values), BATCH):
                part = slice(k, k + BATCH)
                size = len(values[part])
                yield self.batch([pa.array([path]).take(pa.array(np.zeros(size, np.int32))), np.full(size, b + 1), rows[part], cols[part], values[part]])

    def batch(self, columns: list) -> pa.RecordBatch:
        fields = [f.split(" ") for f in _SCHEMAS[self.view].split(", ")]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])


class RasterSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tiff_raster"

    def schema(self) -> str:
        return _SCHEMAS[self.options.get("view", "pixels")]

    def reader(self, schema) -> RasterReader:
        return RasterReader(dict(self.options))


def read_rasters(
    spark: SparkSession, path: str | list[str], view: str = "pixels", rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None,
    bands: list[int] | None = None, names: list[str] | None = None, glob: str = "*.tif", partition_bytes: int = 64 << 20,
) -> DataFrame:
    """A view of the rasters at `path` (a file, a folder or a list of them): files whose names match the glob, or of `names`.

    rows and cols (half open) and bands (from 1) restrict blocks and pixels; blocks are clipped to the window.
    partition_bytes counts the bytes of files that are read together and the decoded pixels of a file that is split.
    """
    spark.dataSource.register(RasterSource)
    chosen = {k: json.dumps(v) for k, v in (("rows", rows), ("cols", cols), ("bands", bands), ("names", names)) if v is not None}
    return spark.read.format("tiff_raster").options(view=view, glob=glob, partition_bytes=partition_bytes, **chosen).load(path if isinstance(path, str) else json.dumps(path))


def read_headers(paths: DataFrame) -> DataFrame:
    """The view `headers` of the rasters at these paths (a column path), each read where its row lies; the driver lists no files.

    A path that ends in .zip is that of an archive, all of whose members are rasters.
    """

    def opened(path: str) -> Iterator[tuple[str, RangeFile | Member]]:
        if path.endswith(".zip"):
            yield from members(path)
            return
        with RangeFile(path) as file:
            yield path, file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        view = RasterReader({"view": "headers", "path": ""})
        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                for own, file in opened(path):
                    found.append(view.head(own, Tiff(file)))
                    if len(found) == HEADS:
                        yield view.heads(found)
                        found = []
            yield view.heads(found)

    return paths.select("path").mapInArrow(run, HEADERS)


def read_windows(windows: DataFrame, band: int | None = None) -> DataFrame:
    """windows (path, row_off, col_off, height, width, ...) with band and data, the pixels row by row; one band or all.

    A window is clipped to its raster: height and width are those of the data, a window outside of it has no row.  Rows of
    one batch that follow each other with the same path share the open file and its last decoded blocks; sort or partition by path to make use of it.
    """
    fields = [f for f in windows.schema.fields if f.name not in ("band", "data")]
    names = [f.name for f in fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", band int, data array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file, tiff = None, None, None
        for batch in batches:
            at = [batch.column(names.index(n)).to_pylist() for n in ("path", "row_off", "col_off", "height", "width")]
            taken, found, held = [], [], 0
            for k, (own, row, col, height, width) in enumerate(zip(*at, strict=True)):
                if own != path:
                    if file is not None:
                        file.close()
                    file = RangeFile(own)
                    path, tiff = own, Tiff(file, KEEP)
                r0, r1, c0, c1 = max(row, 0), min(row + height, tiff.height), max(col, 0), min(col + width, tiff.width)
                if r0 >= r1 or c0 >= c1:
                    continue
                wanted = [b for b in range(tiff.bands) if band in (None, b + 1)]
                for b, values in zip(wanted, tiff.read(r0, c0, r1 - r0, c1 - c0, wanted).astype(np.float64), strict=True) if wanted else ():
                    taken.append(k)
                    found.append((b + 1, r0, c0, r1 - r0, c1 - c0, values.ravel()))
                    held += values.size
                if held >= BATCH:
                    yield _windows_batch(batch, names, taken, found)
                    taken, found, held = [], [], 0
            if taken:
                yield _windows_batch(batch, names, taken, found)
        if file is not None:
            file.close()

    return windows.select(*names).mapInArrow(run, schema)


def _windows_batch(batch: pa.RecordBatch, names: list[str], taken: list[int], found: list[tuple]) -> pa.RecordBatch:
    kept = dict(zip(names, batch.take(pa.array(taken)).columns, strict=True))
    band, row, col, height, width, data = zip(*found, strict=True)
    for name, values in (("row_off", row), ("col_off", col), ("height", height), ("width", width)):
        kept[name] = pa.array(values, kept[name].type)
    return pa.RecordBatch.from_arrays([*kept.values(), pa.array(band, pa.int32()), pa.array(data, pa.list_(pa.float64()))], names=[*kept, "band", "data"])
