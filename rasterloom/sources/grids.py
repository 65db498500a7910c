"""Grids derived from relational tables: a terrain raster, a mask, survey points, image chips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions.georef import Affine, Grid

WIDTH = 128
TRANSFORM = Affine(0.5, 0.0, 500000.0, 0.0, -0.5, 6200000.0)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, col, value) with some NaN and some missing pixels."""
    o = _table(spark, sf_dir, "orders")
    value = F.when(F.col("o_orderkey") % 997 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice") / 1000.0 - 250)
    return o.select(F.floor(F.col("o_orderkey") / WIDTH).cast("int").alias("row"), (F.col("o_orderkey") % WIDTH).cast("int").alias("col"), value.alias("value"))


def terrain_grid(spark: SparkSession, sf_dir: str) -> Grid:
    """The header: one aggregate over the key column."""
    top = _table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0]
    return Grid("dtm", WIDTH, top // WIDTH + 1, TRANSFORM)


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, col, value) with values 0 to 255."""
    sums = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"))
    return sums.select(F.floor(F.col("l_orderkey") / WIDTH).cast("int").alias("row"), (F.col("l_orderkey") % WIDTH).cast("int").alias("col"), F.least("q", F.lit(255)).cast("int").alias("value"))


def points(spark: SparkSession, sf_dir: str, grid: Grid) -> DataFrame:
    """(point_id, x, y); some lie outside the grid."""
    c = _table(spark, sf_dir, "customer")
    x = F.lit(500000.0) + ((F.col("c_custkey") * 37) % 140 - 6) * 0.5 + 0.1
    y = F.lit(6200000.0) - ((F.col("c_custkey") * 53) % (grid.height + 12) - 6) * 0.5 - 0.1
    return c.select(F.col("c_custkey").alias("point_id"), x.alias("x"), y.alias("y"))


def chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, row, col, value): 8 x 8 single-precision images."""
    e = _table(spark, sf_dir, "embeddings")
    cell = e.select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("k", "value"))
    return cell.select("image_id", F.floor(F.col("k") / 8).cast("int").alias("row"), (F.col("k") % 8).cast("int").alias("col"), "value")


#: The same grids as DuckDB SQL, to be put before a query.
DTM_SQL = """dtm AS (SELECT CAST(floor(o_orderkey / 128) AS INT) AS "row", CAST(o_orderkey % 128 AS INT) AS col,
  CASE WHEN o_orderkey % 997 = 0 THEN CAST('NaN' AS DOUBLE) ELSE o_totalprice / 1000.0E0 - 250 END AS value FROM orders),
dims AS (SELECT CAST(max(floor(o_orderkey / 128)) AS INT) + 1 AS h, 128 AS w FROM orders)"""
MASK_SQL = """mask AS (SELECT CAST(floor(l_orderkey / 128) AS INT) AS "row", CAST(l_orderkey % 128 AS INT) AS col,
  CAST(least(sum(l_quantity), 255) AS INT) AS value FROM lineitem GROUP BY l_orderkey)"""
POINTS_SQL = """points AS (SELECT c_custkey AS point_id, 500000.0E0 + ((c_custkey * 37) % 140 - 6) * 0.5E0 + 0.1E0 AS x,
  6200000.0E0 - ((c_custkey * 53) % (h + 12) - 6) * 0.5E0 - 0.1E0 AS y FROM customer, dims)"""
CHIPS_SQL = """chips AS (SELECT vec_id AS image_id, CAST((k - 1) // 8 AS INT) AS "row", CAST((k - 1) % 8 AS INT) AS col, embedding[k] AS value
  FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS k FROM embeddings))"""
