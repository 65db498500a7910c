"""Queries over the terrain grid: tiles, patches, alignment, padding, prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions import georef, radiometry
from rasterloom.operators import dataset, patches, tiling
from rasterloom.plans.prediction import predict_mosaic as predict_plan
from rasterloom.plans.registry import query
from rasterloom.sources import grids
from rasterloom.sources.grids import DTM_SQL, MASK_SQL, POINTS_SQL

PATCH, OVERLAP, STRIDE, SIZE = 32, 8, 24, 16

TILES_SQL = f"""starts AS (
  SELECT 'r' AS axis, unnest(list_distinct(list_concat(range(0, greatest(h - {PATCH}, 0) + 1, {STRIDE}), [greatest(h - {PATCH}, 0)]))) AS off, h AS extent FROM dims
  UNION ALL
  SELECT 'c', unnest(list_distinct(list_concat(range(0, greatest(w - {PATCH}, 0) + 1, {STRIDE}), [greatest(w - {PATCH}, 0)]))), w FROM dims),
tiles AS (SELECT CAST(a.off AS INT) AS row_off, CAST(b.off AS INT) AS col_off, CAST(least({PATCH}, a.extent - a.off) AS INT) AS height,
  CAST(least({PATCH}, b.extent - b.off) AS INT) AS width FROM starts a, starts b WHERE a.axis = 'r' AND b.axis = 'c')"""
TILE_PIXELS_SQL = f"""tile_pixels AS (SELECT row_off, col_off, "row" - row_off AS r, col - col_off AS c, value FROM tiles JOIN dtm
  ON "row" BETWEEN row_off AND row_off + {PATCH - 1} AND col BETWEEN col_off AND col_off + {PATCH - 1})"""
PADDED_SQL = f"""padded AS (SELECT t.row_off, t.col_off, CAST(r AS INT) AS r, CAST(c AS INT) AS c, coalesce(value, 0) AS value
  FROM tiles t CROSS JOIN (SELECT unnest(range({PATCH})) AS r) CROSS JOIN (SELECT unnest(range({PATCH})) AS c)
  LEFT JOIN tile_pixels p USING (row_off, col_off, r, c))"""
NORM_SQL = """filled AS (SELECT * REPLACE (CASE WHEN isnan(value) THEN 0 ELSE value END AS value) FROM padded),
norm AS (SELECT row_off, col_off, r, c, CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE value END AS value
  FROM filled JOIN (SELECT row_off, col_off, min(value) AS lo, max(value) AS hi FROM filled GROUP BY ALL) USING (row_off, col_off))"""
LOCATED_SQL = f"""located AS (SELECT point_id, 'dtm' AS image_path, x AS center_x, y AS center_y,
  CAST(floor((x - 4.0E0 - 500000) / 0.5E0) AS INT) AS px_min, CAST(floor((y + 4.0E0 - 6200000) / -0.5E0) AS INT) AS py_min,
  CAST(floor((x + 4.0E0 - 500000) / 0.5E0) AS INT) AS px_max, CAST(floor((y - 4.0E0 - 6200000) / -0.5E0) AS INT) AS py_max
  FROM points, dims WHERE x BETWEEN 500000 AND 500000 + 0.5E0 * w AND y BETWEEN 6200000 - 0.5E0 * h AND 6200000),
inside AS (SELECT located.* FROM located, dims WHERE px_min >= 0 AND px_max <= w AND py_min >= 0 AND py_max <= h),
numbered AS (SELECT row_number() OVER (ORDER BY point_id) + 99 AS patch_id, * FROM inside)"""
_D, _P = f"WITH {DTM_SQL}", f"WITH {DTM_SQL}, {POINTS_SQL}, {LOCATED_SQL}"
_T = f"WITH {DTM_SQL}, {TILES_SQL}, {TILE_PIXELS_SQL}, {PADDED_SQL}, {NORM_SQL}"


def _tiles(spark: SparkSession, sf_dir: str):
    grid = grids.terrain_grid(spark, sf_dir)
    return grid, tiling.tile_grid(spark, grid, PATCH, OVERLAP)


def _padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid, tiles = _tiles(spark, sf_dir)
    return tiling.pad(tiling.to_tiles(grids.terrain(spark, sf_dir), grid, PATCH, OVERLAP), tiles, PATCH)


def _located(spark: SparkSession, sf_dir: str):
    grid = grids.terrain_grid(spark, sf_dir)
    return grid, patches.locate(grids.points(spark, sf_dir, grid), grid, SIZE)


def _numbered(spark: SparkSession, sf_dir: str):
    grid, found = _located(spark, sf_dir)
    return grid, patches.dense_ids(patches.inside(found, grid), "point_id", start=100)


@query(f"WITH {DTM_SQL}, {TILES_SQL} SELECT * FROM tiles")
def tile_grid(spark, sf_dir):
    return _tiles(spark, sf_dir)[1]


@query(f"WITH {DTM_SQL}, {TILES_SQL}, {TILE_PIXELS_SQL} SELECT row_off, col_off, CAST(r AS INT) AS r, CAST(c AS INT) AS c, value FROM tile_pixels WHERE NOT isnan(value)")
def tile_pixels(spark, sf_dir):
    grid, _ = _tiles(spark, sf_dir)
    return tiling.to_tiles(grids.terrain(spark, sf_dir).where(~F.isnan("value")), grid, PATCH, OVERLAP)


@query(f'{_D} SELECT "row", col, value FROM dtm, dims WHERE "row" BETWEEN 4 AND 4 + least(40, h - 4) - 1 AND col BETWEEN 100 AND 127 AND NOT isnan(value)')
def read_window(spark, sf_dir):
    grid = grids.terrain_grid(spark, sf_dir)
    return tiling.read_window(grids.terrain(spark, sf_dir), 4, 100, 40, 40, grid).where(~F.isnan("value"))


@query(f"{_P} SELECT * EXCLUDE (point_id) FROM located")
def patch_locations(spark, sf_dir):
    return _located(spark, sf_dir)[1].drop("point_id")


@query(f"{_P} SELECT * FROM inside")
def patch_inside(spark, sf_dir):
    grid, found = _located(spark, sf_dir)
    return patches.inside(found, grid)


@query(f"{_P} SELECT patch_id, point_id, px_min, py_min FROM numbered")
def patch_ids(spark, sf_dir):
    return _numbered(spark, sf_dir)[1].select("patch_id", "point_id", "px_min", "py_min")


@query(f"{_P} SELECT patch_id, 500000 + 0.5E0 * px_min AS origin_x, 6200000 - 0.5E0 * py_min AS origin_y FROM numbered")
def patch_origins(spark, sf_dir):
    grid, found = _numbered(spark, sf_dir)
    return patches.origins(found, grid.transform).select("patch_id", "origin_x", "origin_y")


@query(f'{_P} SELECT patch_id, CAST("row" - py_min AS INT) AS r, CAST(col - px_min AS INT) AS c, value FROM numbered JOIN dtm ON "row" >= py_min AND "row" < py_max AND col >= px_min AND col < px_max WHERE NOT isnan(value)')
def patch_pixels(spark, sf_dir):
    _, found = _numbered(spark, sf_dir)
    return tiling.window_pixels(found, grids.terrain(spark, sf_dir).where(~F.isnan("value")))


@query(f"{_P} SELECT point_id, py_min - 3 AS px_min, px_min - 3 AS py_min, py_min + 3 AS px_max, px_min + 3 AS py_max FROM located")
def pixel_bounds(spark, sf_dir):
    found = _located(spark, sf_dir)[1]
    return found.select("point_id", *georef.pixel_bounds(F.col("py_min"), F.col("px_min"), 3))


@query(f"""WITH {DTM_SQL}, {MASK_SQL} SELECT d."row" - 5 AS "row", d.col - 10 AS col, d.value AS first, m.value AS second
FROM dtm d JOIN mask m ON m."row" = d."row" - 5 AND m.col = d.col - 10 WHERE NOT isnan(d.value)""")
def bbox_align(spark, sf_dir):
    """The mask is taken to start ten columns and five rows into the terrain."""
    grid = grids.terrain_grid(spark, sf_dir)
    other = georef.Grid("mask", grid.width, grid.height, grid.transform.shifted(5, 10))
    return patches.align(grids.terrain(spark, sf_dir).where(~F.isnan("value")), grid, grids.mask(spark, sf_dir), other)


@query("""WITH shapes AS (SELECT p_partkey, 250 + CAST(p_partkey % 13 AS INT) AS h, 246 + p_size % 17 AS w FROM part)
SELECT p_partkey, h, w, CASE WHEN h >= 256 AND w >= 256 AND (h > 256 OR w > 256) THEN 'crop' WHEN h = 256 AND w = 256 THEN 'keep' ELSE 'skip' END AS action,
  CASE WHEN h > 256 OR (h = 256 AND w > 256) THEN 'crop' WHEN h = 256 AND w = 256 THEN 'keep' ELSE 'skip' END AS action_pairwise FROM shapes""")
def shape_gate(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    shapes = part.select("p_partkey", (F.lit(250) + (F.col("p_partkey") % 13).cast("int")).alias("h"), (F.lit(246) + F.col("p_size") % 17).alias("w"))
    gate = lambda compat: patches.shape_gate(F.col("h"), F.col("w"), 256, compat)
    return shapes.withColumns({"action": gate(False), "action_pairwise": gate(True)})


@query("SELECT p_partkey, 250 + CAST(p_partkey % 13 AS INT) AS height, 246 + p_size % 17 AS width FROM part WHERE 250 + p_partkey % 13 >= 256 AND 246 + p_size % 17 >= 256")
def min_dimension(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return dataset.large_enough(part.select("p_partkey", (F.lit(250) + (F.col("p_partkey") % 13).cast("int")).alias("height"), (F.lit(246) + F.col("p_size") % 17).alias("width")), 256)


@query(f"{_T} SELECT * FROM padded WHERE NOT isnan(value)")
def pad_patch(spark, sf_dir):
    return _padded(spark, sf_dir).where(~F.isnan("value"))


@query(f'{_D} SELECT "row", col, CASE WHEN isnan(value) THEN 0 ELSE value END AS value FROM dtm')
def nan_fill(spark, sf_dir):
    return grids.terrain(spark, sf_dir).withColumn("value", radiometry.fill_nan(F.col("value")))


@query(f"{_D} SELECT count(*) > 0 AS any_nan FROM dtm WHERE isnan(value)")
def any_nan(spark, sf_dir):
    return grids.terrain(spark, sf_dir).agg(F.coalesce(F.bool_or(F.isnan("value")), F.lit(False)).alias("any_nan"))


@query(f"{_T} SELECT row_off, col_off, r, c, round(value, 9) AS value FROM norm")
def norm_predict(spark, sf_dir):
    filled = _padded(spark, sf_dir).withColumn("value", radiometry.fill_nan(F.col("value")))
    return filled.withColumn("value", F.round(radiometry.min_max_over(F.col("value"), "row_off", "col_off"), 9))


@query(f"""{_T} SELECT CAST(row_off + r AS INT) AS "row", CAST(col_off + c AS INT) AS col,
  CAST(greatest(max(CASE WHEN trunc(value * 100.0E0) > 10 THEN trunc(value * 100.0E0) ELSE 0 END), 0) AS SMALLINT) AS pred
FROM norm, dims WHERE row_off + r < h AND col_off + c < w GROUP BY 1, 2""")
def predict_mosaic(spark, sf_dir):
    """The prediction plan with the normalised value itself as the model."""
    return predict_plan(spark, grids.terrain(spark, sf_dir), grids.terrain_grid(spark, sf_dir), PATCH, OVERLAP)


@query(f"{_D} SELECT round(min(value), 6) AS minimum, round(max(value), 6) AS maximum, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS stddev, round(100.0E0 * count(value) / (SELECT count(*) FROM dtm), 6) AS valid_percent FROM dtm WHERE NOT isnan(value)")
def band_stats(spark, sf_dir):
    from rasterloom.operators.stats import band_stats as stats

    found = stats(grids.terrain(spark, sf_dir))
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


@query(f"WITH {MASK_SQL}, counted AS (SELECT CAST(floor((value - 0.505E0) / ((99.495E0 - 0.505E0) / 99)) AS INT) + 1 AS bucket, count(*) AS n FROM mask WHERE value >= 0.505E0 AND value < 99.495E0 GROUP BY 1) SELECT CAST(b AS INT) AS bucket, coalesce(n, 0) AS count FROM (SELECT unnest(range(1, 100)) AS b) LEFT JOIN counted ON b = bucket")
def histogram99(spark, sf_dir):
    from rasterloom.operators.stats import histogram

    return histogram(grids.mask(spark, sf_dir), 0.505, 99.495, 99)


@query(f'WITH {MASK_SQL} SELECT "row", col, CASE WHEN value > 30 THEN 1 ELSE 0 END AS label FROM mask')
def label_binarise(spark, sf_dir):
    return grids.mask(spark, sf_dir).select("row", "col", radiometry.binarise_label(F.col("value")).alias("label"))


@query(f"{_P}, ids AS (SELECT patch_id FROM numbered), ranked AS (SELECT patch_id, row_number() OVER (ORDER BY md5('42-' || patch_id)) AS rn, count(*) OVER () AS n FROM ids) SELECT patch_id, rn <= ceil(0.1E0 * n) AS is_val FROM ranked")
def split(spark, sf_dir):
    return dataset.split(_numbered(spark, sf_dir)[1].select("patch_id"), "patch_id")


@query(f"{_P}, ranked AS (SELECT patch_id, row_number() OVER (ORDER BY md5('42-1-' || patch_id)) - 1 AS p, count(*) OVER () AS n FROM numbered) SELECT patch_id, CAST(p // 8 AS INT) AS batch_id, CAST(p % 8 AS INT) AS slot FROM ranked WHERE p < n // 8 * 8")
def batches(spark, sf_dir):
    return dataset.batches(_numbered(spark, sf_dir)[1].select("patch_id"), "patch_id", 8, epoch=1)


@query("""WITH kept AS (SELECT s_suppkey, row_number() OVER (ORDER BY md5('42-0-' || s_suppkey)) - 1 AS p, count(*) OVER () AS n FROM supplier WHERE s_acctbal > 0)
SELECT CAST(k // 16 AS INT) AS batch_id, CAST(k % 16 AS INT) AS slot, s_suppkey FROM (SELECT unnest(range(0, CAST((SELECT (count(*) + 15) // 16 * 16 FROM kept) AS BIGINT))) AS k), kept WHERE p = k % n""")
def refill(spark, sf_dir):
    """As many batches as the survivors need; the last one is filled up from the start."""
    survivors = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_acctbal > 0").select("s_suppkey")
    return dataset.refilled(survivors, "s_suppkey", 16, -(-survivors.count() // 16))


@query(f"{_P} SELECT count(*) AS located, CAST(count_if(px_min >= 0 AND px_max <= w AND py_min >= 0 AND py_max <= h) AS BIGINT) AS saved FROM located, dims")
def row_counts(spark, sf_dir):
    grid, found = _located(spark, sf_dir)
    inside = (F.col("px_min") >= 0) & (F.col("px_max") <= grid.width) & (F.col("py_min") >= 0) & (F.col("py_max") <= grid.height)
    return found.agg(F.count("*").alias("located"), F.count_if(inside).alias("saved"))


@query("SELECT CAST(count(*) // 8 AS BIGINT) AS intended, CAST(count(*) // 8 // 8 AS BIGINT) AS divided_twice FROM customer")
def steps_per_epoch(spark, sf_dir):
    n = F.count("*")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").agg(F.floor(n / 8).alias("intended"), F.floor(F.floor(n / 8) / 8).alias("divided_twice"))
