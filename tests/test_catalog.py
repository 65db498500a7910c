"""Catalogs of many rasters, windows of crowded blocks: brute force, plans without nested loops, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions.georef import Arrays, reproject
from rasterloom.operators import catalog, tiling

CATALOG = "path string, width int, height int, a double, c double, e double, f double, crs string"


def plan_of(df):
    return df.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


@pytest.fixture(scope="module")
def rasters(spark):
    """Sizes from 2 m to 800 km in three systems."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(120):
        side = int(rng.choice([4, 40, 400, 4000]))
        res = float(rng.choice([0.5, 2.0, 200.0]))
        x, y = 500000 + rng.uniform(-3000, 3000) - side * res / 2, 6200000 + rng.uniform(-3000, 3000) + side * res / 2
        crs = ("EPSG:32633", "EPSG:32632", "EPSG:4326")[k % 3]
        if crs != "EPSG:32633":
            (x,), (y,) = reproject(np.array([x]), np.array([y]), "EPSG:32633", crs, Arrays)
        if crs == "EPSG:4326":
            res /= 111_000
        rows.append((f"r{k}", side, side // 2 + 1, res, float(x), -res, float(y), crs))
    return spark.createDataFrame(rows, CATALOG)


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(4)
    rows = [(k, float(500000 + rng.uniform(-4000, 4000)), float(6200000 + rng.uniform(-4000, 4000))) for k in range(500)]
    return spark.createDataFrame([*rows, (1000, None, 6200000.0), (1001, float("nan"), 6200000.0), rows[0], (rows[1][0], *rows[2][1:])], "point_id long, x double, y double")


def test_points_in_many_rasters(spark, points, rasters):
    found = catalog.locate(points, rasters, 6, "EPSG:32633")
    want = []
    there = points.where("x < 1e9").collect()
    for r in rasters.collect():
        xs, ys = reproject(np.array([p.x for p in there]), np.array([p.y for p in there]), "EPSG:32633", r.crs, Arrays)
        for p, x, y in zip(there, xs, ys, strict=True):
            if r.c <= x <= r.c + r.a * r.width and r.f + r.e * r.height <= y <= r.f:
                want.append((p.point_id, r.path, int(np.floor((x - 3 * r.a - r.c) / r.a)), int(np.floor((y + 3 * r.a - r.f) / r.e))))
    assert sorted((r.point_id, r.image_path, r.px_min, r.py_min) for r in found.collect()) == sorted(want) and len(want) > 5000
    assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found)


def test_points_in_one_system_need_no_moving(spark, points, rasters):
    own = rasters.where("crs = 'EPSG:32633'")
    found = {(r.point_id, r.path) for r in catalog.points_in(points, own, "EPSG:32633").collect()}
    there, sheets = points.where("x < 1e9").collect(), own.collect()
    want = {(p.point_id, r.path) for p in there for r in sheets if r.c <= p.x <= r.c + r.a * r.width and r.f + r.e * r.height <= p.y <= r.f}
    assert found == want


def test_empty_catalogs(spark, points, rasters):
    nothing = rasters.limit(0)
    assert catalog.locate(points, nothing, 6, "EPSG:32633").count() == 0
    assert catalog.locate(points.limit(0), rasters, 6, "EPSG:32633").count() == 0
    assert catalog.overlapping(rasters, nothing).count() == catalog.overlapping(nothing, rasters).count() == 0
    assert catalog.pair_patches(points, rasters, nothing, 6, "EPSG:32633").count() == 0


def test_overlapping_rasters(spark, rasters):
    masks = rasters.withColumns({"path": F.concat(F.lit("m"), "path"), "c": F.col("c") + F.col("a") * 7, "height": F.col("height") + 5})
    found = catalog.overlapping(rasters, masks)
    want, below = {}, masks.collect()
    for i in rasters.collect():
        for m in below:
            left, right = max(i.c, m.c), min(i.c + i.a * i.width, m.c + m.a * m.width)
            top, bottom = min(i.f, m.f), max(i.f + i.e * i.height, m.f + m.e * m.height)
            if i.crs == m.crs and abs(i.a - m.a) <= 1e-9 * i.a and left < right and bottom < top:
                want[i.path, m.path] = (left, top), min(right - left, top - bottom) / i.a
    rows = found.collect()
    got = {(r.image_path, r.mask_path): (r.left, r.top) for r in rows}
    # of a strip thinner than a pixel nothing may be left
    thick = {k for k, (_, size) in want.items() if size >= 1}
    assert len(rows) == len(got) and thick <= set(got) <= set(want) and len(thick) > 500
    assert all(want[k][0] == v for k, v in got.items())
    for r in rows:
        assert min(r.height, r.width) > 0 and min(r.image_row, r.image_col, r.mask_row, r.mask_col) >= 0
    assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found)


def brute_windows(patches, pixels):
    out = []
    for p in patches:
        out += [(p.patch_id, i - p.py_min, j - p.px_min, v) for (i, j), v in pixels.items() if p.py_min <= i < p.py_max and p.px_min <= j < p.px_max]
    return sorted(out)


@pytest.mark.parametrize("lot", [1 << 20, 40])
def test_windows_across_blocks(spark, lot):
    rng = np.random.default_rng(8)
    pixels = {(int(i), int(j)): float(v) for i, j, v in zip(rng.integers(0, 40, 900), rng.integers(0, 30, 900), rng.random(900), strict=True)}
    rows = [(k, int(x), int(y), int(x + w), int(y + h)) for k, (x, y, w, h) in enumerate(rng.integers([-5, -5, 0, 0], [35, 45, 14, 14], (60, 4)))]
    patches = spark.createDataFrame(rows, "patch_id long, px_min int, py_min int, px_max int, py_max int")
    cells = spark.createDataFrame([(i, j, v) for (i, j), v in pixels.items()], "row int, col int, value double")
    found = tiling.window_pixels(patches, cells, block=8, lot=lot)
    assert sorted(map(tuple, found.collect())) == brute_windows(patches.collect(), pixels)
    assert tiling.window_pixels(patches, cells.limit(0)).count() == tiling.window_pixels(patches.limit(0), cells).count() == 0


def test_crowded_block_is_dealt(spark):
    """10,000 patches in one block: no task gets more than a few lots."""
    pixels = spark.range(64 * 64).selectExpr("CAST(id DIV 64 AS INT) AS row", "CAST(id % 64 AS INT) AS col", "named_struct('first', id, 'second', 'x') AS value")
    patches = spark.range(10_000).selectExpr("id AS patch_id", "CAST(id % 5 AS INT) AS px_min", "CAST(id % 7 AS INT) AS py_min", "CAST(id % 5 + 8 AS INT) AS px_max", "CAST(id % 7 + 8 AS INT) AS py_max")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        found = tiling.window_pixels(patches, pixels, lot=1 << 14)
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(sizes) == 640_000 and max(sizes) < 8 * np.median(sizes) and len(sizes) > 10
    assert found.where("value.first <> (r + patch_id % 7) * 64 + c + patch_id % 5 OR value.second <> 'x'").count() == 0


def test_short_rows_are_dealt_over_all_tasks(spark):
    """Rows that are few and short, and become many by the join, stay in as many tasks as there are."""
    rasters = spark.range(400).selectExpr("concat('r', id) AS path", "40 AS width", "40 AS height", "0.5D AS a", "500000 + id % 20 * 7.0D AS c", "-0.5D AS e", "6200000 + id DIV 20 * 100.0D AS f", "'EPSG:32633' AS crs")
    points = spark.range(300).selectExpr("id AS point_id", "500000 + id % 17 * 9.0D AS x", "6200000 + id % 99 * 20.0D AS y")
    pairs, located = catalog.overlapping(rasters, rasters), catalog.points_in(points, rasters, "EPSG:32633")
    for found in (pairs, located):
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) >= 8 and max(sizes) < sum(sizes) / 3
    # a pair is made once for each salt's cell that both touch, and only at the larger one's level
    assert pairs.count() == pairs.select("image_path", "mask_path").distinct().count() > 1_000


def test_resolutions_at_the_edge_of_a_class(spark):
    """Resolutions that differ by less than a billionth agree, wherever they lie."""
    edges = [2.0 ** (k - 0.3) * (1 + d * 4e-10) for k in (-3, 0, 4) for d in (-1, 0, 1)] + [0.5, 0.5 * (1 + 9e-10), 0.5 * (1 + 3e-9)]
    rows = [(f"r{k}", 100, 100, a, 0.0, -a, 0.0, "EPSG:32633") for k, a in enumerate(edges)]
    rasters = spark.createDataFrame(rows, CATALOG)
    got = {(r.image_path, r.mask_path) for r in catalog.overlapping(rasters, rasters).collect()}
    assert got == {(f"r{i}", f"r{j}") for i, a in enumerate(edges) for j, b in enumerate(edges) if abs(a - b) <= 1e-9 * a}
