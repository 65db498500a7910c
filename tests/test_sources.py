"""Files: TIFF, shapefile, sidecar, stream."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rasterloom.functions.georef import Affine
from rasterloom.sources import lzw, tiff, vector
from rasterloom.streaming import mosaic

T = Affine(0.5, 0.0, 100.0, 0.0, -0.5, 200.0)


@settings(max_examples=60, deadline=None)
@given(data=st.binary(max_size=3000))
def test_lzw_round_trip(data):
    assert lzw.decode(lzw.encode(data)) == data


def test_lzw_long_and_even():
    for data in (b"\0" * 200_000, np.random.default_rng(0).integers(0, 255, 50_000, "u1").tobytes(), bytes(range(256)) * 400):
        assert lzw.decode(lzw.encode(data)) == data


def test_lzw_is_the_greedy_code():
    """Codes as a table of strings gives them: clear, the longest known strings, the end; and data cut short."""
    rng = np.random.default_rng(3)
    for data in (b"", b"a", b"aaaaaaa", bytes(rng.integers(97, 100, 5_000, "u1")), bytes(rng.integers(0, 256, 9_000, "u1"))):
        codes, table, word = [(256, 9)], {bytes([k]): k for k in range(256)}, b""
        size, width = 258, 9
        for byte in data:
            longer = word + bytes([byte])
            if longer in table:
                word = longer
                continue
            codes.append((table[word], width))
            table[longer], size = size, size + 1
            width = max(9, size.bit_length())
            if size == 4095:
                codes.append((256, 12))
                table, size, width = {bytes([k]): k for k in range(256)}, 258, 9
            word = bytes([byte])
        if word:
            codes.append((table[word], width))
            width = max(9, (size + 1).bit_length())
        codes.append((257, width))
        bits = "".join(f"{c:0{w}b}" for c, w in codes)
        assert lzw.encode(data) == bytes(int(bits[k : k + 8].ljust(8, "0"), 2) for k in range(0, len(bits), 8))
    packed = lzw.encode(b"abcabcabc" * 50)
    assert (b"abcabcabc" * 50).startswith(lzw.decode(packed[: len(packed) // 2]))
    with pytest.raises(ValueError):
        lzw.decode(b"\x80\x3f\xff\xff\xff")


@pytest.mark.parametrize("compression", ["none", "lzw", "deflate"])
@pytest.mark.parametrize("dtype", ["u1", "i2", "u2", "f4", "f8"])
@pytest.mark.parametrize("form", [{}, {"tile": 16}, {"tile": 16, "planar": True, "big": True}, {"planar": True}, {"big": True}])
def test_round_trip(compression, dtype, form):
    data = (np.random.default_rng(1).random((3, 70, 33)) * 100).astype(dtype)
    read = tiff.Tiff(tiff.encode(data, T, nodata=0, compression=compression, crs=32633, rows_per_strip=16, **form))
    assert (read.read(10, 5, 20, 100, [2, 0]) == data[[2, 0], 10:30, 5:]).all()
    grid = read.grid("x")
    assert (read.read() == data).all() and (read.read(10, 5, 20, 100) == data[:, 10:30, 5:]).all()
    assert (grid.width, grid.height, grid.band_count, grid.nodata, grid.crs) == (33, 70, 3, 0.0, "EPSG:32633") and grid.transform == T


@pytest.fixture(scope="module")
def sheets(tmp_path_factory):
    """A tiled big file of 7.2 MB, a file of strips, and two that are no part of it."""
    folder = tmp_path_factory.mktemp("sheets")
    data = (np.random.default_rng(5).random((2, 1000, 900)) * 100).astype("f4")
    (folder / "a.tif").write_bytes(tiff.encode(data, T, nodata=-1, compression="none", crs=32633, tile=64, big=True))
    (folder / "b.tif").write_bytes(tiff.encode(data[:, :100], T, compression="lzw"))
    (folder / "_c.tif").write_bytes(b"hidden")
    (folder / "d.txt").write_bytes(b"another kind")
    return folder, data


def test_ranges_read_little(sheets):
    from rasterloom.sources.ranges import RangeFile

    folder, data = sheets
    with RangeFile(f"file:{folder}/a.tif") as file:
        read = tiff.Tiff(file)
        grid = read.grid("a")
        assert (grid.width, grid.height, grid.nodata, grid.crs) == (900, 1000, -1.0, "EPSG:32633") and file.bytes_read < 65536
        assert (read.read(100, 200, 70, 50) == data[:, 100:170, 200:250]).all()
        assert file.bytes_read < 65536 + 4 * 3 * 64 * 64 * 2 * 4 < file.size  # at most 3 x 2 tiles, and what lies between two of a row


def test_window_of_ranged_source(spark, sheets):
    from rasterloom.sources import raster_source as source

    folder, data = sheets
    found = source.read_rasters(spark, f"file://{folder}", rows=(95, 105), cols=(880, 2000), bands=[2], partition_bytes=1 << 20)
    rows = found.collect()
    assert {(r.path[-5:], r.row, r.col) for r in rows} == {(f, i, j) for f, n in (("a.tif", 105), ("b.tif", 100)) for i in range(95, n) for j in range(880, 900)}
    assert len(rows) == 300 and all(r.band == 2 and r.value == data[1, r.row, r.col] for r in rows)
    # two windows of one folder in one query
    other = source.read_rasters(spark, f"file://{folder}", rows=(0, 10), bands=[2], names=["a.tif"])
    assert found.alias("f").join(other.alias("o"), (found.col == other.col) & (found.row == other.row + 95)).count() == 300


def test_partitions_of_ranged_source(spark, sheets, monkeypatch):
    from rasterloom.sources import raster_source as source

    folder, data = sheets
    fetched = []
    reads = source.RangeFile
    monkeypatch.setattr(source, "RangeFile", lambda uri: fetched.append(reads(uri)) or fetched[-1])
    options = {"path": str(folder), "partition_bytes": str(1 << 20)}
    parts = source.RasterReader(options).partitions()
    assert len(parts) == 9 and all(f.bytes_read < 65536 for f in fetched)  # eight of two rows of tiles, one for the small file
    fetched.clear()
    reader = source.RasterReader(options | {"rows": "[95, 105]", "cols": "[880, 900]", "bands": "[1]"})
    parts = reader.partitions()
    assert sorted(p.path[-5:] for part in parts for p in part.pieces) == ["a.tif", "b.tif"]
    assert sum(b.num_rows for part in parts for b in reader.read(part)) == 300
    assert sum(f.bytes_read for f in fetched if f.size > 1 << 20) < 200_000  # of 7.7 MB
    with pytest.raises(FileNotFoundError):
        source.RasterReader({"path": f"{folder}/none"}).partitions()


def test_views_of_ranged_source(spark, sheets, tmp_path):
    from rasterloom.sources import raster_source as source

    folder, data = sheets
    heads = {r.path[-5:]: r for r in source.read_rasters(spark, [f"{folder}/a.tif", f"{folder}/b.tif"], "headers").collect()}
    assert heads["a.tif"].height == 1000 and heads["b.tif"].height == 100 and heads["a.tif"].nodata == -1 and heads["b.tif"].nodata is None
    blocks = source.read_rasters(spark, str(folder), "blocks", rows=(60, 70), cols=(60, 200), bands=[1], names=["a.tif"]).collect()
    assert sorted((b.row_off, b.col_off, b.height, b.width) for b in blocks) == sorted((r, c, h, w) for r, h in ((60, 4), (64, 6)) for c, w in ((60, 4), (64, 64), (128, 64), (192, 8)))
    for b in blocks:
        assert (np.array(b.data).reshape(b.height, b.width) == data[0, b.row_off : b.row_off + b.height, b.col_off : b.col_off + b.width]).all()
    (tmp_path / "e").mkdir()
    assert source.read_rasters(spark, str(tmp_path / "e")).count() == 0
    with pytest.raises(Exception, match="view"):
        source.RasterReader({"path": str(folder), "view": "none"})


def test_windows_of_many_files(spark, sheets):
    from rasterloom.sources import raster_source as source

    folder, data = sheets
    places = [(k, f"{folder}/{'ab'[k % 2]}.tif", k * 31 - 20, k * 29 - 10, 40, 30) for k in range(30)]
    rows = spark.createDataFrame(places, "id long, path string, row_off int, col_off int, height int, width int").repartition(3)
    found = source.read_windows(rows, band=2).collect()
    heights = {"a": 1000, "b": 100}
    assert {r.id for r in found} == {k for k, p, r, c, h, w in places if r < heights[p[-5]] and c < 900}
    for r in found:
        assert (np.array(r.data).reshape(r.height, r.width) == data[1, r.row_off : r.row_off + r.height, r.col_off : r.col_off + r.width]).all()
        _, path, row, col, h, w = places[r.id]
        assert (r.row_off, r.height) == (max(row, 0), min(row + h, heights[path[-5]]) - max(row, 0))
    assert source.read_windows(rows).count() == 2 * len(found)


def test_refusals():
    with pytest.raises(ValueError):
        tiff.encode(np.zeros((3, 3)), T)
    with pytest.raises(ValueError):
        tiff.Tiff(b"GIF89a..")
    with pytest.raises(ValueError):
        vector.parse_points(b"nothing")


def test_shapefile(spark, tmp_path):
    points = [(1.5, 2.0), (-3.0, 1e6)]
    (tmp_path / "p.shp").write_bytes(vector.encode_points(points))
    (tmp_path / "q.shp").write_bytes(vector.encode_points([]))
    found = vector.read_points(spark, str(tmp_path)).orderBy("point_id").collect()
    assert [(r.point_id, r.x, r.y) for r in found] == [(0, 1.5, 2.0), (1, -3.0, 1e6)]


def test_geopackage(spark, tmp_path):
    import sqlite3
    import struct

    from rasterloom.sources import geopackage

    points, rows = [(1.5, -2.0), (3e6, 4.25)], [{"name": "Ärger", "kind": "a"}, {"name": "", "kind": "b"}]
    content = geopackage.encode('odd "layer"', points, rows, 32633)
    (tmp_path / "a.gpkg").write_bytes(content)
    base = sqlite3.connect(":memory:")
    base.deserialize(content)
    wide = struct.pack(">2sBBi", b"GP", 0, 0b0010, 32633) + struct.pack(">4d", 7, 7, 8, 8) + struct.pack(">BIddd", 0, 1001, 7.0, 8.0, 9.0)  # big-endian, with an envelope and a height
    line = struct.pack("<2sBBi", b"GP", 0, 1, 32633) + struct.pack("<BII4d", 1, 2, 2, 0, 0, 1, 1)
    empty = struct.pack("<2sBBi", b"GP", 0, 0b10001, 32633) + struct.pack("<BIdd", 1, 1, float("nan"), float("nan"))
    for k, blob in enumerate((wide, line, empty, None, b"GP")):
        base.execute('INSERT INTO "odd ""layer""" VALUES (?, ?, NULL, ?)', (10 + k, blob, "x"))
    base.commit()
    (tmp_path / "b.gpkg").write_bytes(base.serialize())
    found = geopackage.read_geopackage(spark, str(tmp_path)).orderBy("path", "point_id").collect()
    first = [(0, 1.5, -2.0, {"fid": "0", "name": "Ärger", "kind": "a"}), (1, 3e6, 4.25, {"fid": "1", "name": "", "kind": "b"})]
    assert [(r.point_id, r.x, r.y, r.attributes) for r in found] == [*first, *first, (10, 7.0, 8.0, {"fid": "10", "kind": "x"})]
    assert {(r.layer, r.crs) for r in found} == {('odd "layer"', "EPSG:32633")}


def test_shapefile_in_parts(spark, tmp_path):
    import struct

    from rasterloom.sources import geopackage

    points = [(float(k), k / 7) for k in range(1_000)]
    (tmp_path / "p.shp").write_bytes(vector.encode_points(points))
    (tmp_path / "p.shx").write_bytes(geopackage.encode_index(points))
    # a null shape between two points, whose records are shorter
    body = [struct.pack("<idd", 1, 5.0, 6.0), struct.pack("<i", 0), struct.pack("<idd", 1, 7.0, 8.0)]
    shp, shx = vector.encode_points([])[:100], geopackage.encode_index([])
    for k, part in enumerate(body, 1):
        shx += struct.pack(">ii", len(shp) // 2, len(part) // 2)
        shp += struct.pack(">ii", k, len(part) // 2) + part
    (tmp_path / "q.shp").write_bytes(shp)
    (tmp_path / "q.shx").write_bytes(shx)
    found = geopackage.read_shapes(spark, f"file://{tmp_path}", records=64)
    rows = sorted((r.path[-5:], r.point_id, r.x, r.y) for r in found.collect())
    assert rows == [*[("p.shp", k, x, y) for k, (x, y) in enumerate(points)], ("q.shp", 0, 5.0, 6.0), ("q.shp", 2, 7.0, 8.0)]
    whole = sorted((r.path[-5:], r.point_id, r.x, r.y) for r in vector.read_points(spark, str(tmp_path)).collect())
    assert rows == whole and found.where("path LIKE '%p.shp'").select(F.spark_partition_id()).distinct().count() > 4


def test_sidecar(spark, tmp_path):
    counts = "|".join(str(k) for k in range(1, 100))
    (tmp_path / "a.tif.aux.xml").write_text(
        "<PAMDataset><PAMRasterBand band=\"1\"><Histograms><HistItem><HistMin>0.505</HistMin><HistMax>99.495</HistMax><BucketCount>99</BucketCount>"
        f"<HistCounts>{counts}</HistCounts></HistItem></Histograms><Metadata><MDI key=\"STATISTICS_MAXIMUM\">99</MDI><MDI key=\"STATISTICS_MEAN\">44.5</MDI></Metadata></PAMRasterBand></PAMDataset>"
    )
    assert {r.key: r.value for r in vector.sidecar_stats(spark, str(tmp_path)).collect()} == {"STATISTICS_MAXIMUM": 99.0, "STATISTICS_MEAN": 44.5}
    rows = vector.sidecar_histogram(spark, str(tmp_path)).collect()
    assert len(rows) == 99 and sum(r["count"] for r in rows) == 4950 and rows[0].low == 0.505


def test_stream_takes_late_tiles(spark, tmp_path):
    folder = str(tmp_path)
    for rows in ([(0, 0, 5), (0, 1, 50)], [(0, 0, 20), (0, 1, 3)]):
        spark.createDataFrame(rows, mosaic.SCORES).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        mosaic.write_mosaic(mosaic.mosaic_stream(mosaic.read_scores(spark, f"{folder}/in", 1)), f"{folder}/out", f"{folder}/state").awaitTermination()
    assert sorted(map(tuple, mosaic.current(spark, f"{folder}/out").collect())) == [(0, 0, 20), (0, 1, 50)]


def test_weights_round_trip(spark, tmp_path):
    from rasterloom.operators import nn

    net = nn.unet(filters=2, layers=1)
    nn.save_weights(spark, net.weights(3), f"{tmp_path}/w")
    read = nn.load_weights(spark, net, f"{tmp_path}/w")
    assert all((a[k] == b[k]).all() for a, b in zip(read, net.weights(3), strict=True) for k in b)
    with pytest.raises(FileNotFoundError):
        nn.load_weights(spark, net, f"{tmp_path}/none")
    with pytest.raises(ValueError):
        nn.load_weights(spark, nn.unet(filters=3, layers=1), f"{tmp_path}/w")


def test_patch_files(spark, tmp_path):
    from rasterloom.functions.georef import Grid
    from rasterloom.plans import training

    grid = Grid("g", 12, 10, T)
    image = spark.createDataFrame([(r, c, float(r * 12 + c)) for r in range(10) for c in range(12)], "row int, col int, value double")
    label = image.withColumn("value", image.value % 2)
    points = spark.createDataFrame([(5, 102.1, 197.9), (9, 103.1, 197.4), (11, 100.1, 199.9)], "point_id long, x double, y double")
    pairs = training.patch_pairs(image, grid, label, grid, points, 4, start_id=7)
    assert {r.patch_id for r in pairs.collect()} == {7, 8} and pairs.count() == 32
    places = training.located(grid, grid, points, 4, start_id=7)
    for stacked in (False, True):
        tiff.save(tiff.to_files(training.patch_tiles(pairs, places, 4, grid, stacked)), f"file://{tmp_path}/out")
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert names == ["7_img.tif", "7_lab.tif", "7_pair.tif", "8_img.tif", "8_lab.tif", "8_pair.tif"]
    both = tiff.Tiff((tmp_path / "out" / "8_pair.tif").read_bytes())
    head, at = both.grid("x"), {r.patch_id: r for r in places.collect()}[8]
    assert head.crs == grid.crs and head.band_count == 2 and (head.transform.c, head.transform.f) == (at.origin_x, at.origin_y) == (T.c + T.a * at.px_min, T.f + T.e * at.py_min)
    assert (both.read()[1] == both.read()[0] % 2).all()
    first = tiff.Tiff((tmp_path / "out" / "7_img.tif").read_bytes()).read()[0]
    assert (first == np.arange(120).reshape(10, 12)[2:6, 2:6]).all()


def test_file_set_is_all_or_nothing(spark, tmp_path):
    from rasterloom.sources import file_sink

    folder = tmp_path / "out"
    files = spark.range(40).selectExpr("concat('f', id, '.bin') AS name", "CAST(concat('content ', id) AS BINARY) AS content").repartition(4)
    there = lambda: sorted(p.name for p in folder.iterdir() if p.name[0] not in "._")
    assert file_sink.save(files, f"file://{folder}") == 40 and len(there()) == 40 and (folder / "f7.bin").read_bytes() == b"content 7"
    assert file_sink.save(files, f"file://{folder}") == 40 and len(there()) == 40  # the same job again
    before = {p: (folder / p).read_bytes() for p in there()}
    # one row in a late batch makes its task fail, after others have written
    broken = files.withColumn("content", F.when(F.col("name") == "f33.bin", F.raise_error(F.lit("lost"))).otherwise(F.lit("new")).cast("binary"))
    with pytest.raises(Exception, match="lost"):
        file_sink.save(broken, f"file://{folder}")
    for bad in (F.lit("same.bin"), F.lit("../x"), F.lit("_hidden"), F.lit(None).cast("string")):
        with pytest.raises(Exception, match="name"):
            file_sink.save(files.withColumn("name", bad), f"file://{folder}")
    assert {p: (folder / p).read_bytes() for p in there()} == before and spark.read.format("binaryFile").load(str(folder)).count() == 40
    file_sink.sweep(f"file://{folder}")
    assert len(list(folder.iterdir())) == 40
    assert file_sink.save(files.where("name < 'f2'").withColumn("content", F.lit(None).cast("binary")), f"file://{folder}", overwrite=True) == 12
    assert len(there()) == 12 == len(file_sink.written(f"file://{folder}")) and (folder / "f1.bin").read_bytes() == b""
    assert file_sink.save(files.limit(0), f"file://{tmp_path}/none") == 0 and len(there()) == 12


def test_stored_pixels_prune(spark, tmp_path):
    from rasterloom.sources import store

    pixels = spark.range(64 * 64).selectExpr("'a' AS raster_id", "1 + id % 2 AS band", "CAST(id DIV 64 AS INT) AS row", "CAST(id % 64 AS INT) AS col", "id AS value")
    store.write_pixels(pixels, f"{tmp_path}/p", block=16, files=8)
    window = store.read_pixels(spark, f"{tmp_path}/p", 20, 30, 5, 4, block=16, raster_id="a", band=1)
    assert sorted(r.value for r in window.collect()) == sorted(r * 64 + c for r in range(20, 25) for c in range(30, 34) if (r * 64 + c) % 2 == 0)
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(window._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(row,20)" in plan and "LessThanOrEqual(col,33)" in plan and "PartitionFilters: [isnotnull(raster_id" in plan


def test_driver_sees_no_single_files(spark, tmp_path):
    """A commit message, the manifest and the driver's work grow with tasks and not with files."""
    import os

    from rasterloom.sources import file_sink

    folder = f"file://{tmp_path}/out"
    files = spark.range(3_000).selectExpr("concat('f', id, '.bin') AS name", "CAST(CAST(id AS STRING) AS BINARY) AS content").repartition(4)
    assert file_sink.save(files, folder) == 3_000
    assert os.path.getsize(tmp_path / "_out.manifest.json") < 400
    assert file_sink.saved(spark, folder).distinct().count() == 3_000
    assert file_sink.save(files.where("name < 'f2'"), folder) == 1_112
    assert file_sink.saved(spark, folder).count() == 3_000
    assert file_sink.save(files.where("name < 'f2'"), folder, overwrite=True) == 1_112
    assert file_sink.saved(spark, folder).count() == 1_112 == len(list((tmp_path / "out").iterdir()))


def test_geojson_is_read_once(spark, tmp_path):
    """Nested values come from the bytes at hand; the JSON source read the file again for them."""
    import json

    features = [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [k / 4, -k, 7]}, "properties": {"k": k, "of": {"a": [1, "ä"]}}} for k in range(50)]
    features[3]["geometry"] = {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1, ensure_ascii=False))
    (tmp_path / "b.geojson").write_text('{"type": "FeatureCollection", "features": []}')
    found = vector.read_geojson(spark, str(tmp_path))
    rows = found.orderBy("point_id").collect()
    assert [(r.point_id, r.x, r.y, json.loads(r.properties)) for r in rows] == [(k, k / 4, -k, f["properties"]) for k, f in enumerate(features) if k != 3]
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(found._jdf.queryExecution(), "simple")
    assert "binaryFile" in plan and "FileScan json" not in plan


def test_attributes_come_in_parts(spark, tmp_path, monkeypatch):
    """No more than so many rows of a table file are held as objects at a time, and they are numbered on."""
    rows = [{"k": str(k), "s": "ä" * (k % 3)} for k in range(10)]
    content = vector.encode_attributes(rows)
    assert vector.parse_attributes(content, 4, 3) == rows[4:7] and vector.parse_attributes(content, 8, 9) == rows[8:] and vector.parse_attributes(content, 10, 3) == []
    many = [{"k": str(k)} for k in range(vector.ROWS + 5)]
    (tmp_path / "p.dbf").write_bytes(vector.encode_attributes(many))
    found = vector.read_attributes(spark, str(tmp_path)).select("point_id", F.col("attributes")["k"].alias("k"))
    assert found.where("point_id = CAST(k AS LONG)").distinct().count() == len(many)


def test_parts_of_shapefiles_share_tasks(spark, tmp_path):
    """Many small parts do not make a task each."""
    from rasterloom.sources import geopackage

    points = [(float(k), k / 7) for k in range(3_000)]
    for name in ("p", "q"):
        (tmp_path / f"{name}.shp").write_bytes(vector.encode_points(points))
        (tmp_path / f"{name}.shx").write_bytes(geopackage.encode_index(points))
    (tmp_path / "none.shx").write_bytes(geopackage.encode_index([]))
    found = geopackage.read_shapes(spark, f"file://{tmp_path}", records=8)
    assert 4 < found.rdd.getNumPartitions() <= geopackage.PART_TASKS * spark.sparkContext.defaultParallelism
    assert sorted((r.path[-5:], r.point_id, r.x, r.y) for r in found.collect()) == [(f"{n}.shp", k, x, y) for n in "pq" for k, (x, y) in enumerate(points)]


def test_packed_files_are_whole(spark, tmp_path):
    """Archives hold the same files, published all or none, and take no block and no entry of the file system for each."""
    import os
    import zipfile

    from rasterloom.sources import file_sink, ranges

    folder = tmp_path / "out"
    files = spark.range(3_000).selectExpr("concat('f', id, '.bin') AS name", "CASE WHEN id % 7 > 0 THEN CAST(repeat(id, id) AS BINARY) END AS content").repartition(4)
    assert file_sink.save(files, f"file://{folder}", packed=True) == 3_000
    paths = [r.path for r in file_sink.saved(spark, f"file://{folder}").collect()]
    assert len(paths) == len(list(folder.iterdir())) == len(file_sink.written(f"file://{folder}")) <= 4
    found = {name: file.read_at(0, file.size) for path in paths for name, file in ((p.rsplit("/", 1)[1], f) for p, f in ranges.members(path))}
    assert found == {f"f{k}.bin": (str(k) * k).encode() if k % 7 else b"" for k in range(3_000)}
    assert sum(os.stat(p).st_blocks * 512 for p in folder.iterdir()) < 3_000 * 4_096 / 4
    assert all(zipfile.ZipFile(p).testzip() is None for p in folder.iterdir())
    with pytest.raises(ValueError, match="already"):
        file_sink.save(files, f"file://{folder}", packed=True)
    with pytest.raises(Exception, match="same file name"):
        file_sink.save(files.union(files.limit(1)), f"file://{folder}", overwrite=True, packed=True)
    assert sorted(p.name for p in folder.iterdir()) == sorted(p.rsplit("/", 1)[1] for p in paths)
    assert file_sink.save(files.where("name < 'f2'"), f"file://{folder}", overwrite=True, packed=True) == 1_112
    again = [r.path for r in file_sink.saved(spark, f"file://{folder}").collect()]
    assert len(again) == len(list(folder.iterdir())) and sum(1 for p in again for _ in ranges.members(p)) == 1_112
    assert file_sink.save(files.limit(0), f"file://{tmp_path}/none", packed=True) == 0
    assert file_sink.saved(spark, f"file://{tmp_path}/none").count() == 0


def test_archives_end_at_a_size(tmp_path, monkeypatch):
    import zipfile

    import pyarrow as pa
    from pyarrow import fs

    from rasterloom.sources import file_sink

    monkeypatch.setattr(file_sink, "ARCHIVE", 1_000)
    out = file_sink._Archives(fs.LocalFileSystem(), str(tmp_path), "a")
    content = [np.random.default_rng(k).bytes(400) for k in range(10)]
    for k, data in enumerate(content):
        out.add(f"{k}.bin", pa.py_buffer(data))
    names = out.close()
    assert names == sorted(p.name for p in tmp_path.iterdir()) and len(names) > 2
    read = [(i.filename, z.read(i)) for n in names for z in [zipfile.ZipFile(tmp_path / n)] for i in z.infolist()]
    assert read == [(f"{k}.bin", data) for k, data in enumerate(content)]


def test_cut_tiles_are_those_of_patch_pairs(spark, tmp_path):
    """The same bytes, with missing, null and NaN pixels and patches at borders of blocks, in crowded blocks and beyond the pixels."""
    from rasterloom.functions.georef import Grid
    from rasterloom.operators import tiling
    from rasterloom.plans import training
    from rasterloom.sources import file_sink, ranges
    from rasterloom.sources.raster_source import read_headers

    image, label = Grid("g", 150, 90, T), Grid("h", 150, 90, T.shifted(2, 4))
    value = "CASE WHEN id % 11 = 0 THEN NULL WHEN id % 13 = 0 THEN CAST('NaN' AS DOUBLE) ELSE id / 7 END"
    cells = spark.range(90 * 150).where("id % 5 > 0 AND id % 150 NOT BETWEEN 30 AND 60").selectExpr("CAST(id DIV 150 AS INT) AS row", "CAST(id % 150 AS INT) AS col", f"{value} AS value", "id")
    mask = cells.selectExpr("row", "col", "CASE WHEN id % 17 > 0 THEN CAST(id % 256 AS INT) END AS value")
    points = spark.range(400).selectExpr("id AS point_id", f"{T.c} + (id * 37 % 150) * {T.a} + 0.01 AS x", f"{T.f} + (id * 53 % 90) * {T.e} - 0.01 AS y")
    pairs = training.patch_pairs(cells.drop("id"), image, mask, label, points, 8)
    slow = {r.name: bytes(r.content) for r in tiff.to_files(training.patch_tiles(pairs, training.located(image, label, points, 8), 8, image, None)).collect()}
    tiles = training.cut_tiles(cells.drop("id"), image, mask, label, points, 8)
    assert {r.name: bytes(r.content) for r in tiff.to_files(tiles).collect()} == slow and 300 < len(slow) < 3 * training.located(image, label, points, 8).count()
    assert file_sink.save(tiff.to_files(tiles), f"file://{tmp_path}/out", packed=True) == len(slow)
    heads = {r.path.rsplit("/", 1)[1]: r for r in read_headers(file_sink.saved(spark, f"file://{tmp_path}/out")).collect()}
    for name, content in slow.items():
        g, h = tiff.Tiff(content).grid(name), heads[name]
        assert (h.width, h.height, h.band_count, h.dtype, h.crs, h.c, h.f) == (g.width, g.height, g.band_count, g.dtype, g.crs, g.transform.c, g.transform.f)
    assert len(heads) == len(slow)
    for path in file_sink.written(f"file://{tmp_path}/out"):
        for own, file in ranges.members(f"file://{tmp_path}/out/{path}"):
            kept = tiff.Tiff(slow[own.rsplit("/", 1)[1]]).read()
            assert np.array_equal(tiff.Tiff(file).read(), kept, equal_nan=True)
    # patches of uneven bounds that reach beyond the pixels, and a lot so small that blocks are copied
    patches = spark.createDataFrame([(k, k % 9 - 4, k % 7 - 3, k % 9 + 3, k % 7 + 9) for k in range(200)], "patch_id long, px_min int, py_min int, px_max int, py_max int")
    pixels = spark.range(400).selectExpr("CAST(id DIV 20 AS INT) AS row", "CAST(id % 20 AS INT) AS col", "CAST(id + 1 AS INT) AS value")
    wanted = {}
    for r in tiling.window_pixels(patches, pixels).collect():
        wanted.setdefault(r.patch_id, np.zeros((12, 12)))[r.r, r.c] = r.value
    for lot in (1 << 20, 144 * 20):
        found = {r.patch_id: np.array(r.value).reshape(12, 12) for r in tiling.window_tiles(patches, pixels, 12, ["value"], block=16, lot=lot).collect()}
        assert found.keys() == wanted.keys() and all((found[k] == wanted[k]).all() for k in wanted)


def test_patch_files_shuffles_no_pixels_of_patches(spark):
    """What is shuffled grows with the rasters' pixels, and not with the pixels of all patches, which share them."""
    from rasterloom.functions.georef import Grid
    from rasterloom.plans import training

    grid = Grid("g", 150, 90, T)
    cells = spark.range(90 * 150).selectExpr("CAST(id DIV 150 AS INT) AS row", "CAST(id % 150 AS INT) AS col", "CAST(id AS DOUBLE) AS value")
    points = spark.range(100).selectExpr("id AS point_id", f"{T.c} + 20 * {T.a} AS x", f"{T.f} + 20 * {T.e} AS y")
    tiles = training.cut_tiles(cells, grid, cells, grid, points, 16)
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(tiles._jdf.queryExecution(), "simple")
    assert "FlatMapCoGroupsInArrow" in plan and "Exchange" not in plan.split("FlatMapCoGroupsInArrow")[0]
