"""Point shapefiles with their attributes and coordinate systems, GeoJSON points, and statistics sidecars."""

from __future__ import annotations

import itertools
import json
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a table file that are held as objects at a time.
ROWS = 1 << 14


def parse_points(content: bytes) -> list[tuple[int, float, float]]:
    """(record number from 0, x, y) of a .shp file; shapes other than points are refused, null shapes are skipped."""
    if len(content) < 100 or struct.unpack(">i", content[:4])[0] != 9994:
        raise ValueError("not a shapefile")
    at, out = 100, []
    while at + 8 <= len(content):
        number, words = struct.unpack(">ii", content[at : at + 8])
        kind = struct.unpack("<i", content[at + 8 : at + 12])[0]
        if kind in (1, 11, 21):
            out.append((number - 1, *struct.unpack("<dd", content[at + 12 : at + 28])))
        elif kind:
            raise ValueError(f"shape type {kind} is not a point")
        at += 8 + 2 * words
    return out


def encode_points(points: list[tuple[float, float]]) -> bytes:
    """A .shp file of points."""
    xs, ys = [p[0] for p in points] or [0.0], [p[1] for p in points] or [0.0]
    records = b"".join(struct.pack(">ii", k, 10) + struct.pack("<idd", 1, x, y) for k, (x, y) in enumerate(points, 1))
    head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(records)) // 2) + struct.pack("<ii", 1000, 1)
    return head + struct.pack("<8d", min(xs), min(ys), max(xs), max(ys), 0, 0, 0, 0) + records


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """(path, point_id, x, y) of the point shapefiles at `path`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = [(name, *r) for r in parse_points(content)]
                yield pd.DataFrame(rows, columns=["path", "point_id", "x", "y"])

    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.shp").load(path)
    return content.select("path", "content").mapInPandas(run, "path string, point_id long, x double, y double")


def parse_attributes(content: bytes, first: int = 0, number: int | None = None) -> list[dict[str, str]]:
    """The rows of a .dbf file as text by column, from `first` on, all or `number` of them; the n-th row belongs to the n-th shape.  Deleted rows stay, as None."""
    count, head, size = struct.unpack("<IHH", content[4:12])
    columns, at = [], 32
    while content[at] != 0x0D:
        columns.append((content[at : at + 11].split(b"\0")[0].decode(), content[at + 16]))
        at += 32
    rows = []
    for k in range(first, count if number is None else min(count, first + number)):
        row, at = content[head + k * size : head + (k + 1) * size], 1
        values = {}
        for name, width in columns:
            values[name] = row[at : at + width].decode("utf-8", "replace").strip()
            at += width
        rows.append(values if row[:1] != b"*" else {name: None for name, _ in columns})
    return rows


def encode_attributes(rows: list[dict[str, str]]) -> bytes:
    """A .dbf file of text columns."""
    names = list(rows[0]) if rows else []
    widths = [max(1, *(len(str(r[n]).encode()) for r in rows)) for n in names]
    size = 1 + sum(widths)
    head = struct.pack("<B3BIHH20x", 3, 100, 1, 1, len(rows), 32 + 32 * len(names) + 1, size)
    fields = b"".join(struct.pack("<11sc4xBB14x", n.encode()[:10], b"C", w, 0) for n, w in zip(names, widths, strict=True))
    body = b"".join(b" " + b"".join(str(r[n]).encode().ljust(w) for n, w in zip(names, widths, strict=True)) for r in rows)
    return head + fields + b"\r" + body + b"\x1a"


def read_attributes(spark: SparkSession, path: str) -> DataFrame:
    """(path, point_id, attributes map<string,string>) of the .dbf files at `path`; path ends in .shp, as in read_points."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                first = 0
                while rows := parse_attributes(content, first, ROWS):
                    yield pd.DataFrame({"path": name[:-4] + ".shp", "point_id": range(first, first + len(rows)), "attributes": rows})
                    first += len(rows)

    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.dbf").load(path)
    return content.select("path", "content").mapInPandas(run, "path string, point_id long, attributes map<string,string>")


def crs_of_prj(text: Column) -> Column:
    """The system that a .prj text names: by its authority's number, or by the name of a UTM zone, Mercator or WGS 84."""
    numbers = F.regexp_extract_all(text, F.lit(r'(?i)AUTHORITY\["EPSG",\s*"?(\d+)"?\]'), F.lit(1))
    zone, half = F.regexp_extract(text, r"(?i)UTM[ _]zone[ _](\d+)([NS])", 1), F.upper(F.regexp_extract(text, r"(?i)UTM[ _]zone[ _](\d+)([NS])", 2))
    base = F.when(text.rlike("(?i)ETRS"), 25800).when(half == "S", 32700).otherwise(32600)
    named = F.when(zone != "", F.concat(F.lit("EPSG:"), (base + zone.try_cast("int")).cast("string"))).when(text.rlike("(?i)^\\s*PROJCS.*Web_Mercator"), "EPSG:3857").when(text.rlike("(?i)^\\s*GEOGCS.*WGS_(19)?84"), "EPSG:4326")
    return F.when(F.size(numbers) > 0, F.concat(F.lit("EPSG:"), F.element_at(numbers, -1))).otherwise(named)


def read_crs(spark: SparkSession, path: str) -> DataFrame:
    """(path, crs) of the .prj files at `path`; path ends in .shp, crs is null where the text is not understood."""
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.prj").load(path)
    return content.select(F.regexp_replace("path", r"\.prj$", ".shp").alias("path"), crs_of_prj(F.col("content").cast("string")).alias("crs"))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(path, point_id, x, y, properties as JSON) of the point features of GeoJSON files; other geometries are left out.

    A file is one JSON value, so it is read by one task; newline-delimited features (.geojsonl) are split among tasks.
    """
    def rows(name: str, content: bytes) -> Iterator[tuple]:
        try:
            features = json.loads(content).get("features")
        except (ValueError, AttributeError):  # no JSON, or no object
            return
        for k, f in enumerate(features if isinstance(features, list) else ()):
            shape = f.get("geometry") if isinstance(f, dict) else None
            if isinstance(shape, dict) and shape.get("type") == "Point":
                at = shape.get("coordinates")
                at = [float(v) if isinstance(v, int | float) else None for v in at[:2]] if isinstance(at, list) else []
                own = f.get("properties")
                yield name, k, *(at + [None, None])[:2], None if own is None else json.dumps(own, ensure_ascii=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = rows(name, content.as_py())
                while part := list(itertools.islice(found, ROWS)):
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*part, strict=True), kinds, strict=True)], names=["path", "point_id", "x", "y", "properties"])

    # Spark's JSON source goes back to the file for every nested value that is wanted as it stands
    kinds = pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.string()
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.geojson").load(path)
    return content.select("path", "content").mapInArrow(run, "path string, point_id long, x double, y double, properties string")


def sidecar_xml(stats: dict[str, float], low: float, high: float, counts: list[int]) -> bytes:
    """An .aux.xml sidecar of one band: statistics by their names and a histogram of equal buckets."""
    items = "".join(f'<MDI key="STATISTICS_{name}">{value!r}</MDI>' for name, value in stats.items())
    bars = f"<HistItem><HistMin>{low!r}</HistMin><HistMax>{high!r}</HistMax><BucketCount>{len(counts)}</BucketCount><IncludeOutOfRange>0</IncludeOutOfRange><Approximate>0</Approximate><HistCounts>{'|'.join(map(str, counts))}</HistCounts></HistItem>"
    return f'<PAMDataset><PAMRasterBand band="1"><Histograms>{bars}</Histograms><Metadata>{items}</Metadata></PAMRasterBand></PAMDataset>'.encode()


def sidecar_stats(spark: SparkSession, path: str) -> DataFrame:
    """(band, key, value) of the statistics in .aux.xml sidecars."""
    schema = "_band int, Metadata array<struct<_domain: string, MDI: array<struct<_VALUE: string, _key: string>>>>"
    bands = spark.read.schema(schema).format("xml").option("rowTag", "PAMRasterBand").load(path)
    items = bands.select(F.col("_band").alias("band"), F.explode("Metadata").alias("m")).select("band", F.explode("m.MDI").alias("i"))
    return items.select("band", F.col("i._key").alias("key"), F.col("i._VALUE").cast("double").alias("value"))


def sidecar_histogram(spark: SparkSession, path: str) -> DataFrame:
    """(band, low, high, bucket, count) of the histograms in .aux.xml sidecars; buckets from 1."""
    schema = "_band int, Histograms struct<HistItem: array<struct<HistMin: double, HistMax: double, BucketCount: int, HistCounts: string>>>"
    bands = spark.read.schema(schema).format("xml").option("rowTag", "PAMRasterBand").load(path)
    items = bands.select(F.col("_band").alias("band"), F.explode("Histograms.HistItem").alias("h"))
    counts = items.select("band", F.col("h.HistMin").alias("low"), F.col("h.HistMax").alias("high"), F.posexplode(F.split("h.HistCounts", r"\|")).alias("k", "n"))
    return counts.select("band", "low", "high", (F.col("k") + 1).alias("bucket"), F.col("n").cast("long").alias("count"))
