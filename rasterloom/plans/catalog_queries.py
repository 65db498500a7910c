"""Queries over many rasters: a catalog of headers against points, masks and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.operators import catalog
from rasterloom.plans.registry import query
from rasterloom.plans.support_queries import ZONE32_SQL
from rasterloom.sources import grids, tiff
from rasterloom.sources.grids import DTM_SQL, MASK_SQL, POINTS_SQL
from rasterloom.sources.raster_source import read_rasters, read_windows
from rasterloom.sources.scratch import work_folder

PATCH, SHEET, MASK_SHEET = 8, 48, 32

#: Rasters along the terrain, every other one in the next UTM zone, where the terrain lies turned by five degrees.
RASTERS_SQL = """SELECT '{name}_' || k AS path, {width} AS width, {height} AS height, {res} AS a, -{res} AS e,
  CASE WHEN k % 2 = 0 THEN 'EPSG:32633' ELSE 'EPSG:32632' END AS crs,
  CASE WHEN k % 2 = 0 THEN 499990.0E0 ELSE 874468.0E0 + d * 0.08691E0 END + k * 29 % 120 * 0.5E0 AS c, CASE WHEN k % 2 = 0 THEN 6200005.0E0 ELSE 6216274.0E0 END - d AS f
FROM (SELECT {key} AS k, {key} * 17 % h * 0.5E0 AS d FROM {table}, dims)"""
_IMAGES = {"name": "image", "width": "CAST(16 + k % 48 AS INT)", "height": "CAST(16 + k % 32 AS INT)", "res": "0.5E0", "key": "p_partkey", "table": "part"}
_MASKS = {"name": "mask", "width": "CAST(64 + k * 7 % 64 AS INT)", "height": "CAST(48 + k % 32 AS INT)", "res": "CASE WHEN k % 5 = 0 THEN 1.0E0 ELSE 0.5E0 END", "key": "s_suppkey", "table": "supplier"}


def _rasters(spark, sf_dir, kind: dict[str, str]) -> DataFrame:
    k, h = F.col("k"), F.lit(grids.terrain_grid(spark, sf_dir).height)
    rows = spark.read.parquet(f"{sf_dir}/{kind['table']}.parquet").select(F.col(kind["key"]).alias("k")).withColumn("d", k * 17 % h * F.lit(0.5))
    res, even = F.expr(kind["res"].replace("E0", "D")), k % 2 == 0
    c = F.when(even, F.lit(499990.0)).otherwise(F.lit(874468.0) + F.col("d") * F.lit(0.08691)) + k * 29 % 120 * F.lit(0.5)
    f = F.when(even, F.lit(6200005.0)).otherwise(F.lit(6216274.0)) - F.col("d")
    return rows.select(F.concat(F.lit(kind["name"] + "_"), k.cast("string")).alias("path"), F.expr(kind["width"]).alias("width"), F.expr(kind["height"]).alias("height"), res.alias("a"), (-res).alias("e"), F.when(even, "EPSG:32633").otherwise("EPSG:32632").alias("crs"), c.alias("c"), f.alias("f"))


@query(f"""WITH {DTM_SQL}, {POINTS_SQL}, {ZONE32_SQL}, rasters AS ({RASTERS_SQL.format(**_IMAGES)}),
placed AS (SELECT point_id, z.*, 'EPSG:32633' AS system, x AS px, y AS py FROM zone32 z JOIN points USING (point_id) UNION ALL SELECT point_id, z.*, 'EPSG:32632', x32, y32 FROM zone32 z)
SELECT p.point_id, path AS image_path, round(px, 3) AS center_x, round(py, 3) AS center_y, CAST(floor((px - 4 * a - c) / a) AS INT) AS px_min, CAST(floor((py + 4 * a - f) / e) AS INT) AS py_min,
  CAST(floor((px + 4 * a - c) / a) AS INT) AS px_max, CAST(floor((py - 4 * a - f) / e) AS INT) AS py_max
FROM placed p JOIN rasters r ON system = crs AND px BETWEEN c AND c + a * width AND py BETWEEN f + e * height AND f
WHERE floor((px - 4 * a - c) / a) >= 0 AND floor((py + 4 * a - f) / e) >= 0 AND floor((px + 4 * a - c) / a) <= width AND floor((py - 4 * a - f) / e) <= height""".replace("SELECT point_id, z.*,", "SELECT z.point_id,"))
def catalog_points(spark, sf_dir):
    """Patches around all points in all the rasters of two zones that hold them whole."""
    points = grids.points(spark, sf_dir, grids.terrain_grid(spark, sf_dir))
    found = catalog.inside(catalog.locate(points, _rasters(spark, sf_dir, _IMAGES), PATCH, "EPSG:32633"))
    return found.select("point_id", "image_path", F.round("center_x", 3).alias("center_x"), F.round("center_y", 3).alias("center_y"), "px_min", "py_min", "px_max", "py_max")


@query(f"""WITH {DTM_SQL}, images AS ({RASTERS_SQL.format(**_IMAGES)}), masks AS ({RASTERS_SQL.format(**_MASKS)}),
shared AS (SELECT i.path AS image_path, m.path AS mask_path, i.crs, greatest(i.c, m.c) AS l, least(i.f, m.f) AS t, least(i.c + i.a * i.width, m.c + m.a * m.width) AS r, greatest(i.f + i.e * i.height, m.f + m.e * m.height) AS b,
  i.a, i.e, i.c AS ic, i.f AS if_, m.c AS mc, m.f AS mf, i.width AS iw, i.height AS ih, m.width AS mw, m.height AS mh FROM images i JOIN masks m ON i.crs = m.crs AND i.a = m.a),
starts AS (SELECT *, CAST(round((t - if_) / e) AS INT) AS image_row, CAST(round((l - ic) / a) AS INT) AS image_col, CAST(round((t - mf) / e) AS INT) AS mask_row, CAST(round((l - mc) / a) AS INT) AS mask_col FROM shared WHERE l < r AND b < t),
sized AS (SELECT *, least(CAST(round((b - t) / e) AS INT), ih - image_row, mh - mask_row) AS height, least(CAST(round((r - l) / a) AS INT), iw - image_col, mw - mask_col) AS width FROM starts)
SELECT image_path, mask_path, crs, round(l, 3) AS "left", round(b, 3) AS bottom, round(r, 3) AS "right", round(t, 3) AS top, height, width, image_row, image_col, mask_row, mask_col FROM sized WHERE height > 0 AND width > 0""")
def catalog_pairs(spark, sf_dir):
    """All images and masks of one system and resolution that have an area in common."""
    found = catalog.overlapping(_rasters(spark, sf_dir, _IMAGES), _rasters(spark, sf_dir, _MASKS))
    return found.withColumns({n: F.round(n, 3) for n in ("left", "bottom", "right", "top")})


def _sheets(spark, pixels: DataFrame, name: str, high: int) -> DataFrame:
    """A grid written as big, tiled files of `high` rows each, and their headers."""
    cell = F.struct((F.col("row") % high * grids.WIDTH + F.col("col")).cast("int").alias("at"), F.col("value").cast("float").alias("v"))
    t = grids.TRANSFORM
    sheets = pixels.groupBy(F.floor(F.col("row") / high).alias("k")).agg((F.max(F.col("row") % high) + 1).cast("int").alias("height"), F.collect_list(cell).alias("m"))
    tiles = sheets.select(
        F.format_string(name + "_%d.tif", "k").alias("name"), "height", F.lit(grids.WIDTH).alias("width"), F.transform("m", lambda z: z["at"]).alias("at"), F.transform("m", lambda z: z["v"]).alias("data"),
        F.lit(t.c).alias("origin_x"), (F.lit(t.f) + t.e * high * F.col("k")).alias("origin_y"), F.lit(t.a).alias("resolution"), F.lit(32633).alias("crs"),
    )
    tiff.save(tiff.to_files(tiles, tile=16, big=True, missing=float("nan")), folder := work_folder(spark, "sheets"))
    return read_rasters(spark, folder, "headers")


@query(f"""WITH {DTM_SQL}, {MASK_SQL}, {POINTS_SQL}, mdims AS (SELECT max("row") + 1 AS mh FROM mask),
images AS (SELECT k * {SHEET} AS r0, least(h, k * {SHEET} + {SHEET}) AS r1 FROM dims, (SELECT unnest(range(0, (SELECT h // {SHEET} + 1 FROM dims))) AS k) WHERE k * {SHEET} < h),
masks AS (SELECT k * {MASK_SHEET} AS r0, least(mh, k * {MASK_SHEET} + {MASK_SHEET}) AS r1 FROM mdims, (SELECT unnest(range(0, (SELECT mh // {MASK_SHEET} + 1 FROM mdims))) AS k) WHERE k * {MASK_SHEET} < mh),
located AS (SELECT point_id, i.r0 AS i0, m.r0 AS m0, greatest(i.r0, m.r0) AS low, least(i.r1, m.r1) AS high, CAST(floor((x - 2.0E0 - 500000) / 0.5E0) AS INT) AS px, CAST(floor((y + 2.0E0 - 6200000) / -0.5E0) AS INT) AS py
  FROM points, images i, masks m WHERE x BETWEEN 500000 AND 500064 AND y BETWEEN 6200000 - 0.5E0 * i.r1 AND 6200000 - 0.5E0 * i.r0 AND i.r0 < m.r1 AND m.r0 < i.r1),
whole AS (SELECT * FROM located WHERE px >= 0 AND px + {PATCH} <= 128 AND py >= low AND py + {PATCH} <= high),
cells AS (SELECT 'image' AS kind, "row", col, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value FROM dtm WHERE NOT isnan(value) UNION ALL SELECT 'mask', "row", col, CAST(value AS DOUBLE) FROM mask)
SELECT point_id, 'image_' || i0 // {SHEET} || '.tif' AS image, 'mask_' || m0 // {MASK_SHEET} || '.tif' AS mask, kind, CAST("row" - py AS INT) AS r, CAST(col - px AS INT) AS c, value
FROM whole JOIN cells ON "row" >= py AND "row" < py + {PATCH} AND col >= px AND col < px + {PATCH}""")
def catalog_patches(spark, sf_dir):
    """Image and mask patches around all points, read by ranges from the files of terrain and mask that hold them."""
    points = grids.points(spark, sf_dir, grids.terrain_grid(spark, sf_dir))
    images, masks = _sheets(spark, grids.terrain(spark, sf_dir).where(~F.isnan("value")), "image", SHEET), _sheets(spark, grids.mask(spark, sf_dir), "mask", MASK_SHEET)
    last = {n: F.substring_index(f"{n}_path", "/", -1) for n in ("image", "mask")}  # once a window, not once a cell
    windows = catalog.pair_patches(points, images, masks, PATCH, "EPSG:32633").withColumns(last)
    read = read_windows(catalog.dealt(windows, "path", F.floor(F.col("row_off") / PATCH)).sortWithinPartitions("path", "row_off"), band=1)
    cell = read.select("point_id", "image", "mask", "kind", F.posexplode("data").alias("k", "value"))
    return cell.where(~F.isnan("value")).select("point_id", "image", "mask", "kind", F.floor(F.col("k") / PATCH).cast("int").alias("r"), (F.col("k") % PATCH).cast("int").alias("c"), "value")
