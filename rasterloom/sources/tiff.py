"""TIFF rasters: headers, windows and whole bands from binary files, and files from tiles.

Baseline files with strips or tiles, uncompressed, deflated or LZW-packed (also with horizontal differencing), any
number of bands, integer and floating samples, either byte order, with the tags for pixel scale, tie point and nodata.
Bytes reach the executors through Spark's binaryFile source, so any file system that Spark reads will do.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions.georef import Affine, Grid
from rasterloom.sources import lzw
from rasterloom.sources.file_sink import save  # noqa: F401  (part of this module's interface)
from rasterloom.sources.ranges import Held, Member, RangeFile

#: TIFF tags and field types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, BANDS, ROWS_PER_STRIP, STRIP_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 284, 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, GEO_KEYS, NODATA = 33550, 33922, 34735, 42113
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
_DTYPES = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}


class Tiff:
    """The first image of a classic or big TIFF file, held in memory or read by ranges.

    Only the tags that are asked for are fetched, and of the offsets of strips or tiles only those of a window's blocks.
    With `keep`, decoded blocks of up to so many bytes are kept for windows that share them.
    """

    def __init__(self, source: bytes | RangeFile | Member, keep: int = 0):
        self.keep, self._kept, self._room = keep, {}, keep
        self.file = source if isinstance(source, (RangeFile, Member)) else Held(source)
        head = self.file.read_at(0, 16)
        self.order = {b"II": "<", b"MM": ">"}.get(head[:2])
        kind = struct.unpack(self.order + "H", head[2:4])[0] if self.order and len(head) >= 8 else 0
        if kind not in (42, 43) or kind == 43 and (len(head) < 16 or struct.unpack(self.order + "HH", head[4:8]) != (8, 0)):
            raise ValueError("not a TIFF file")
        # a directory: the number of entries, then (tag, type, number of values, the values or their offset) for each
        number, entry, place = ("H", "HHI4s", "I") if kind == 42 else ("Q", "HHQ8s", "Q")
        at = struct.unpack(self.order + place, head[4:8] if kind == 42 else head[8:16])[0]
        size, wide = struct.calcsize(self.order + number), struct.calcsize(self.order + entry)
        count = struct.unpack(self.order + number, self.file.read_at(at, size))[0]
        entries = self.file.read_at(at + size, count * wide)
        self._entries, self._place = {}, place
        for k in range(count):
            tag, code, n, raw = struct.unpack(self.order + entry, entries[k * wide : (k + 1) * wide])
            if code in _TYPES:
                self._entries[tag] = _TYPES[code], n, raw
        self.width, self.height = self.tag(WIDTH)[0], self.tag(HEIGHT)[0]
        self.bands = self.tag(BANDS, (1,))[0]
        key = self.tag(SAMPLE_FORMAT, (1,))[0], self.tag(BITS, (8,))[0]
        if key not in _DTYPES:
            raise ValueError(f"samples of format and bits {key} are not read")
        self.dtype = np.dtype(self.order + _DTYPES[key])
        self.planar = self.tag(PLANAR, (1,))[0] == 2
        self.tiled = TILE_WIDTH in self._entries
        self.block_width = self.tag(TILE_WIDTH)[0] if self.tiled else self.width
        self.block_height = self.tag(TILE_HEIGHT)[0] if self.tiled else min(self.tag(ROWS_PER_STRIP, (self.height,))[0], self.height)
        self.across, self.down = -(-self.width // self.block_width), -(-self.height // self.block_height)

    def tag(self, tag: int, default=None, first: int = 0, number: int | None = None):
        """The values of a tag from `first` on, all or `number` of them; text comes as bytes."""
        if tag not in self._entries:
            return default
        code, n, raw = self._entries[tag]
        number = n - first if number is None else max(0, min(number, n - first))
        each = struct.calcsize(self.order + code)
        if each * n <= len(raw):
            data = raw[first * each : (first + number) * each]
        else:
            data = self.file.read_at(struct.unpack(self.order + self._place, raw)[0] + first * each, number * each)
        return data if code == "s" else struct.unpack(self.order + code * number, data)

    def grid(self, raster_id: str, path: str = "") -> Grid:
        sx, sy = self.tag(PIXEL_SCALE, (1.0, 1.0))[:2]
        i, j, _, x, y, _ = self.tag(TIE_POINT, (0.0,) * 6)[:6]
        keys = self.tag(GEO_KEYS, ())
        codes = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
        crs = next((f"EPSG:{codes[k]}" for k in (3072, 2048) if k in codes), "")
        nodata = self.tag(NODATA, b"").rstrip(b"\0 ").decode() or None
        return Grid(raster_id, self.width, self.height, Affine(sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy), crs, self.bands, self.dtype.name, float(nodata) if nodata else None, "GTiff", path)

    def touched(self, row: int, col: int, height: int, width: int) -> tuple[range, range]:
        """Rows and columns of the blocks that a window meets."""
        return range(row // self.block_height, -(-(row + height) // self.block_height)), range(col // self.block_width, -(-(col + width) // self.block_width))

    def read(self, row: int = 0, col: int = 0, height: int | None = None, width: int | None = None, bands: list[int] | None = None) -> np.ndarray:
        """Bands x rows x columns of a window clipped to the raster; all bands or those listed, from 0 on."""
        height, width = min(height or self.height, self.height - row), min(width or self.width, self.width - col)
        bands = list(range(self.bands)) if bands is None else bands
        bw, bh = self.block_width, self.block_height
        down, across = self.touched(row, col, height, width)
        out = np.zeros((len(bands), height, width), self.dtype.newbyteorder("="))
        offset_tag, count_tag = (TILE_OFFSETS, TILE_COUNTS) if self.tiled else (STRIP_OFFSETS, STRIP_COUNTS)
        planes = [(b, slice(n, n + 1)) for n, b in enumerate(bands)] if self.planar else [(0, slice(None))]
        wanted = [(layer, (p * self.down + i) * self.across + j, i, j) for p, layer in planes for i in down for j in across]
        blocks = self._blocks(sorted({k for _, k, _, _ in wanted}), offset_tag, count_tag)
        for layer, k, i, j in wanted:
            block = blocks[k]
            if block is None:
                continue  # a block that was never written holds zeros
            r0, r1, c0, c1 = max(row, i * bh), min(row + height, i * bh + block.shape[1]), max(col, j * bw), min(col + width, j * bw + bw)
            part = block[:, r0 - i * bh : r1 - i * bh, c0 - j * bw : c1 - j * bw]
            out[layer, r0 - row : r1 - row, c0 - col : c1 - col] = part if self.planar else part[bands]
        return out

    def _blocks(self, numbers: list[int], offset_tag: int, count_tag: int) -> dict[int, np.ndarray | None]:
        """Blocks by their numbers in the file; neighbours' offsets and bytes are fetched together."""
        found = {k: self._kept[k] for k in numbers if k in self._kept}
        missing = [k for k in numbers if k not in found]
        if not missing:
            return found
        spans = []
        starts = [n for n, k in enumerate(missing) if not n or missing[n - 1] != k - 1]
        for n, stop in zip(starts, [*starts[1:], len(missing)], strict=True):
            spans += list(zip(*(self.tag(t, None, missing[n], stop - n) for t in (offset_tag, count_tag)), strict=True))
        for k, (_, size), data in zip(missing, spans, self.file.read_many(spans), strict=True):
            i = k // self.across % self.down
            found[k] = self._block(data, self.block_height if self.tiled else min(self.block_height, self.height - i * self.block_height), self.block_width) if size else None
            if self.keep and found[k] is not None:
                self._room -= found[k].nbytes
                if self._room < 0:
                    self._kept, self._room = {}, self.keep
                self._kept[k] = found[k]
        return found

    def _block(self, data: bytes, rows: int, cols: int) -> np.ndarray:
        packing, samples = self.tag(COMPRESSION, (1,))[0], 1 if self.planar else self.bands
        if packing == 5:
            data = lzw.decode(data)
        elif packing in (8, 32946):
            data = zlib.decompress(data)
        elif packing != 1:
            raise ValueError(f"compression {packing} is not read")
        values = np.frombuffer(data, self.dtype, rows * cols * samples).reshape(rows, cols, samples).astype(self.dtype.newbyteorder("="))
        if self.tag(PREDICTOR, (1,))[0] == 2:
            values = np.cumsum(values, axis=1, dtype=values.dtype)
        return values.transpose(2, 0, 1)


def encode(data: np.ndarray, transform: Affine, nodata: float | None = None, compression: str = "lzw", crs: int | None = None, rows_per_strip: int = 64, tile: int | None = None, planar: bool = False, big: bool = False) -> bytes:
    """A file with all bands of data (bands x rows x columns), in strips or square tiles; `big` has offsets of 64 bits."""
    if data.ndim != 3:
        raise ValueError("data must have three dimensions: bands, rows, columns")
    packers = {"none": (1, bytes), "lzw": (5, lzw.encode), "deflate": (8, zlib.compress)}
    code, packer = packers[compression]
    bands, height, width = data.shape
    data = np.ascontiguousarray(data, data.dtype.newbyteorder("<"))
    high, wide = (tile, tile) if tile else (rows_per_strip, width)
    blocks = []
    for plane in data[:, None] if planar else [data]:
        for r in range(0, height, high):
            for c in range(0, width, wide):
                block = plane[:, r : r + high, c : c + wide]
                if tile:
                    block = np.pad(block, ((0, 0), (0, high - block.shape[1]), (0, wide - block.shape[2])))
                blocks.append(packer(block.transpose(1, 2, 0).tobytes()))
    kind, place = {"u": 1, "i": 2, "f": 3}[data.dtype.kind], 16 if big else 4
    offset_tag, count_tag = (TILE_OFFSETS, TILE_COUNTS) if tile else (STRIP_OFFSETS, STRIP_COUNTS)
    tags: list[tuple[int, int, tuple | bytes]] = [
        (WIDTH, 4, (width,)), (HEIGHT, 4, (height,)), (BITS, 3, (data.dtype.itemsize * 8,) * bands), (COMPRESSION, 3, (code,)), (PHOTOMETRIC, 3, (1,)),
        (offset_tag, place, (0,) * len(blocks)), (BANDS, 3, (bands,)), (count_tag, place, tuple(map(len, blocks))), *([(TILE_WIDTH, 4, (tile,)), (TILE_HEIGHT, 4, (tile,))] if tile else [(ROWS_PER_STRIP, 4, (rows_per_strip,))]),
        (PLANAR, 3, (2 if planar else 1,)), (SAMPLE_FORMAT, 3, (kind,) * bands), (PIXEL_SCALE, 12, (transform.a, -transform.e, 0.0)), (TIE_POINT, 12, (0.0, 0.0, 0.0, transform.c, transform.f, 0.0)),
    ]
    if crs:
        tags.append((GEO_KEYS, 3, (1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, crs)))
    if nodata is not None:
        tags.append((NODATA, 2, f"{nodata:g}".encode() + b"\0"))
    tags.sort(key=lambda t: t[0])
    head, number, entry, end, inline = (struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16), "<Q", "<HHQ", "<Q", 8) if big else (struct.pack("<2sHI", b"II", 42, 8), "<H", "<HHI", "<I", 4)
    pack = lambda kind, v: v if isinstance(v, bytes) else struct.pack("<" + _TYPES[kind] * len(v), *v)
    after = len(head) + struct.calcsize(number) + (struct.calcsize(entry) + inline) * len(tags) + struct.calcsize(end)
    sizes = [len(pack(k, v)) for _, k, v in tags]
    first = after + sum(n + n % 2 for n in sizes if n > inline)
    offsets = tuple((np.cumsum([0, *map(len, blocks)])[:-1] + first).tolist())
    entries, tail = b"", b""
    for tag, k, v in tags:
        raw = pack(k, offsets if tag == offset_tag else v)
        if len(raw) > inline:
            where, tail = struct.pack(end, after + len(tail)), tail + raw + b"\0" * (len(raw) % 2)
        else:
            where = raw.ljust(inline, b"\0")
        entries += struct.pack(entry, tag, k, len(v)) + where
    return head + struct.pack(number, len(tags)) + entries + struct.pack(end, 0) + tail + b"".join(blocks)


def files(spark: SparkSession, folder: str, glob: str = "*.tif") -> DataFrame:
    """(path, modificationTime, length, content) of a folder's files; selecting path alone reads no content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)


_HEADER = "path string, width int, height int, band_count int, dtype string, crs string, nodata double, a double, c double, e double, f double"


def headers(content: DataFrame) -> DataFrame:
    """The catalog: one row for each file of files()."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                g = Tiff(data).grid(path, path)
                rows.append((path, g.width, g.height, g.band_count, g.dtype, g.crs, g.nodata, g.transform.a, g.transform.c, g.transform.e, g.transform.f))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _HEADER.split(", ")]).astype({"nodata": "float64"})

    return content.select("path", "content").mapInPandas(run, _HEADER)


def blocks(content: DataFrame, block: int = 256, band: int | None = None) -> DataFrame:
    """Tiles (path, band, row_off, col_off, height, width, data) of every file; one band (from 1) or all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                tiff = Tiff(data)
                for r in range(0, tiff.height, block):
                    rows = []
                    for c in range(0, tiff.width, block):
                        part = tiff.read(r, c, block, block)
                        rows += [(path, b + 1, r, c, *part.shape[1:], part[b].astype(np.float32).ravel()) for b in range(tiff.bands) if band in (None, b + 1)]
                    yield pd.DataFrame(rows, columns=["path", "band", "row_off", "col_off", "height", "width", "data"])

    return content.select("path", "content").mapInPandas(run, "path string, band int, row_off int, col_off int, height int, width int, data array<float>")


def to_files(tiles: DataFrame, dtype: str = "f4", nodata: float | None = None, compression: str = "lzw", tile: int | None = None, big: bool = False, missing: float = 0.0) -> DataFrame:
    """(name, content) for tiles (name, height, width, data, origin_x, origin_y, resolution, at?, bands?, crs?).

    data holds one band after the other, row by row; without a column `bands` there is one.  With `at`, data holds only
    the cells at those places and the others are `missing`.  crs is an EPSG number.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t in pdf.itertuples():
                data, bands = np.asarray(t.data), getattr(t, "bands", 1)
                if hasattr(t, "at"):
                    whole = np.full(bands * t.height * t.width, missing)
                    whole[np.asarray(t.at, np.int64)] = data
                    data = whole
                data = data.reshape(bands, t.height, t.width).astype(dtype)
                out.append(encode(data, Affine(t.resolution, 0.0, t.origin_x, 0.0, -t.resolution, t.origin_y), nodata, compression, getattr(t, "crs", None), tile=tile, big=big))
            yield pd.DataFrame({"name": pdf["name"], "content": out})

    return tiles.mapInPandas(run, "name string, content binary")


def square_tiles(pixels: DataFrame, value: str, grid: Grid, side: int, prefix: str) -> DataFrame:
    """Tiles for to_files from pixels (row, col, value): squares of `side` cells, missing cells 0, with origins and system."""
    at = lambda axis: F.floor(F.col(axis) / side).cast("int")
    squares = pixels.groupBy(at("row").alias("i"), at("col").alias("j")).agg(F.collect_list(F.struct((F.col("row") % side).alias("r"), (F.col("col") % side).alias("c"), F.col(value).cast("float").alias("v"))).alias("m"))
    high, wide, t = F.least(F.lit(side), grid.height - F.col("i") * side), F.least(F.lit(side), grid.width - F.col("j") * side), grid.transform
    return squares.select(
        F.format_string(prefix + "_%d_%d.tif", "i", "j").alias("name"), high.alias("height"), wide.alias("width"), F.transform("m", lambda z: (z["r"] * wide + z["c"]).cast("int")).alias("at"), F.transform("m", lambda z: z["v"]).alias("data"),
        (F.lit(t.c) + t.a * side * F.col("j")).alias("origin_x"), (F.lit(t.f) + t.e * side * F.col("i")).alias("origin_y"), F.lit(t.a).alias("resolution"), F.lit(grid.epsg).cast("int").alias("crs"),
    )
