"""GeoPackage points, and point shapefiles read in parts.

A GeoPackage is an SQLite database; it is opened from its bytes in memory, so any store that Spark reads will do, and one
file is read by one task.  Points have two or more coordinates, of which x and y count; features of other kinds, empty and
missing geometries are left out.
"""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.sources.ranges import RangeFile, listed

SCHEMA = "path string, layer string, point_id long, x double, y double, crs string, attributes map<string,string>"
#: Sizes of the envelope by its code, and the kinds of points in well-known binary.
ENVELOPES, POINTS = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}, (1, 1001, 2001, 3001)
ROWS = 1 << 16
#: Tasks for each core that read parts of shapefiles.
PART_TASKS = 4


def parse_geometry(blob: bytes | None) -> tuple[float, float] | None:
    """x and y of a point; None for other geometries."""
    if not blob or len(blob) < 8 or blob[:2] != b"GP":
        return None
    flags = blob[3]
    at = 8 + ENVELOPES.get(flags >> 1 & 7, 0)
    if flags >> 4 & 1 or len(blob) < at + 21:
        return None
    order = "<" if blob[at] else ">"
    kind = struct.unpack(order + "I", blob[at + 1 : at + 5])[0]
    if kind & 0x0FFFFFFF not in POINTS:
        return None
    x, y = struct.unpack(order + "dd", blob[at + 5 : at + 21])
    return None if x != x or y != y else (x, y)


def encode_geometry(x: float, y: float, srs: int) -> bytes:
    return struct.pack("<2sBBi", b"GP", 0, 1, srs) + struct.pack("<BIdd", 1, 1, x, y)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def parse(content: bytes) -> Iterator[tuple[str, int, float, float, str, dict[str, str]]]:
    """(layer, key, x, y, system, attributes as text) of every point of every layer."""
    base = sqlite3.connect(":memory:")
    base.deserialize(content)
    base.text_factory = lambda b: b.decode("utf-8", "replace")
    systems = {k: f"{o.upper()}:{n}" for k, o, n in base.execute("SELECT srs_id, organization, organization_coordsys_id FROM gpkg_spatial_ref_sys")}
    for layer, column, srs in base.execute("SELECT table_name, column_name, srs_id FROM gpkg_geometry_columns ORDER BY table_name").fetchall():
        rows = base.execute(f"SELECT rowid, * FROM {_quoted(layer)} ORDER BY rowid")
        names = [d[0] for d in rows.description][1:]
        at = names.index(column)
        for key, *values in rows:
            if (xy := parse_geometry(values[at])) is not None:
                yield layer, key, *xy, systems.get(srs, ""), {n: str(v) for n, v in zip(names, values, strict=True) if n != column and v is not None and not isinstance(v, bytes)}
    base.close()


def encode(layer: str, points: list[tuple[float, float]], attributes: list[dict[str, str]], epsg: int) -> bytes:
    """A GeoPackage with one layer of points and text attributes."""
    base = sqlite3.connect(":memory:")
    names = list(attributes[0]) if attributes else []
    base.executescript(f"""
PRAGMA application_id = 1196444487; PRAGMA user_version = 10300;
CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);
CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, srs_id INTEGER);
CREATE TABLE gpkg_geometry_columns (table_name TEXT NOT NULL, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL, PRIMARY KEY (table_name, column_name));
CREATE TABLE {_quoted(layer)} (fid INTEGER PRIMARY KEY, geom BLOB{"".join(f", {_quoted(n)} TEXT" for n in names)});""")
    base.execute("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, 'EPSG', ?, 'undefined', NULL)", (f"EPSG:{epsg}", epsg, epsg))
    base.execute("INSERT INTO gpkg_contents VALUES (?, 'features', ?, ?)", (layer, layer, epsg))
    base.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'POINT', ?, 0, 0)", (layer, epsg))
    rows = [(k, encode_geometry(x, y, epsg), *[own[n] for n in names]) for k, ((x, y), own) in enumerate(zip(points, attributes, strict=True))]
    base.executemany(f"INSERT INTO {_quoted(layer)} VALUES ({', '.join('?' * (2 + len(names)))})", rows)
    base.commit()
    return base.serialize()


def read_geopackage(spark: SparkSession, path: str) -> DataFrame:
    """(path, layer, point_id, x, y, crs, attributes) of the points in the GeoPackages at `path`."""
    kinds = (pa.string(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.string(), pa.map_(pa.string(), pa.string()))
    names = [f.split(" ")[0] for f in SCHEMA.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for name, content in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                rows = []
                for layer, key, x, y, crs, own in parse(content.as_py()):
                    rows.append((name, layer, key, x, y, crs, list(own.items())))
                    if len(rows) == ROWS:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.gpkg").load(path)
    return content.select("path", "content").mapInArrow(run, SCHEMA)


def encode_index(points: list[tuple[float, float]]) -> bytes:
    """The .shx file that goes with `vector.encode_points`: offset and length of each record, in words of two bytes."""
    head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + 8 * len(points)) // 2) + struct.pack("<ii", 1000, 1) + bytes(64)
    return head + b"".join(struct.pack(">ii", 50 + 14 * k, 10) for k in range(len(points)))


def parse_records(data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in starts, x, y) of the points among records that begin at these bytes; null shapes are skipped."""
    raw = np.frombuffer(data + bytes(28), np.uint8)
    kind = raw[starts[:, None] + np.arange(8, 12)].copy().view("<i4")[:, 0]
    if not np.isin(kind, (0, 1, 11, 21)).all():
        raise ValueError("a shape is not a point")
    own = np.flatnonzero(kind)
    xy = raw[starts[own][:, None] + np.arange(12, 28)].copy().view("<f8").reshape(-1, 2)
    return own, xy[:, 0], xy[:, 1]


def _points(parts: list[tuple]) -> pa.RecordBatch:
    """One batch of some parts: (place in parts, point_id, x, y, path) each."""
    place, own, x, y = (np.concatenate(v) for v in list(zip(*parts, strict=True))[:4])
    return pa.RecordBatch.from_arrays([pa.array([p[4] for p in parts]).take(pa.array(place)), pa.array(own), pa.array(x), pa.array(y)], names=["path", "point_id", "x", "y"])


def read_shapes(spark: SparkSession, path: str, records: int = 1 << 20) -> DataFrame:
    """(path, point_id, x, y) of the point shapefiles at `path`, `records` records of a file at a time.

    Parts are found by the index file (.shx) beside each file and read by ranges, so one file is read by many tasks; the
    number of tasks follows from the cores, and a task's parts of one file share it.  Bytes come through pyarrow's file systems.
    """
    found = [(name[:-1] + "p", name, (size - 100) // 8) for name, size in listed(path, "*.shx")]
    files = spark.createDataFrame(found, "path string, index string, n long").where("n > 0")
    parts = files.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(records).cast("long"))))
    tasks = min(max(1, sum(-(-n // records) for _, _, n in found)), PART_TASKS * spark.sparkContext.defaultParallelism)
    rows = parts.select("path", "index", "first", F.least(F.lit(records), F.col("n") - F.col("first")).alias("number")).repartition(tasks, "path", "first").sortWithinPartitions("path", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, index, shapes, held = None, None, None, []
        try:
            for batch in batches:
                for r in batch.to_pylist():
                    if r["path"] != path:
                        for file in (index, shapes) if path else ():
                            file.close()
                        path, index, shapes = r["path"], RangeFile(r["index"]), RangeFile(r["path"])
                    at = np.frombuffer(index.read_at(100 + 8 * r["first"], 8 * r["number"]), ">i4").reshape(-1, 2).astype(np.int64) * 2
                    low, high = int(at[:, 0].min()), int((at[:, 0] + at[:, 1] + 8).max())
                    own, x, y = parse_records(shapes.read_at(low, high - low), at[:, 0] - low)
                    held.append((np.full(len(own), len(held)), own + r["first"], x, y, path))
                    if len(held) * records >= ROWS:
                        yield _points(held)
                        held = []
            if held:
                yield _points(held)
        finally:
            for file in (index, shapes) if path else ():
                file.close()

    return rows.mapInArrow(run, "path string, point_id long, x double, y double")
