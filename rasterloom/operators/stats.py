"""Band statistics and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def band_stats(pixels: DataFrame, value: str = "value", nodata: float | None = None, weight: Column | None = None) -> DataFrame:
    """minimum, maximum, mean, population stddev, valid percent; nodata, null and NaN are not valid."""
    v, w = F.col(value).cast("double"), (weight if weight is not None else F.lit(1)).cast("double")
    ok = v.isNotNull() & ~F.isnan(v)
    if nodata is not None:
        ok = ok & (v != nodata)
    v, w_ok = F.when(ok, v), F.when(ok, w)
    share = (F.try_divide(F.coalesce("n", F.lit(0.0)), "all") * 100).alias("valid_percent")
    extremes = [F.min(v).alias("minimum"), F.max(v).alias("maximum"), F.sum(w_ok).alias("n"), F.sum(w).alias("all")]
    if weight is None:
        return pixels.agg(*extremes, F.avg(v).alias("mean"), F.stddev_pop(v).alias("stddev")).select("minimum", "maximum", "mean", "stddev", share)
    # squares are summed around the mean, which a first aggregate gives as one row
    first = pixels.agg(*extremes, F.sum(v * w_ok).alias("s")).withColumn("mean", F.try_divide("s", "n"))
    around = pixels.select(v.alias("v"), w_ok.alias("w")).crossJoin(F.broadcast(first.select(F.col("mean").alias("m"))))
    spread = around.agg(F.sqrt(F.try_divide(F.sum(F.col("w") * (F.col("v") - F.col("m")) * (F.col("v") - F.col("m"))), F.sum("w"))).alias("stddev"))
    return first.crossJoin(F.broadcast(spread)).select("minimum", "maximum", "mean", "stddev", share)


def histogram(pixels: DataFrame, low: float, high: float, buckets: int, value: str = "value") -> DataFrame:
    """(bucket, count) for all equal buckets of [low, high); values outside are not counted."""
    counted = pixels.where(~F.isnan(F.col(value).cast("double"))).groupBy(F.width_bucket(F.col(value).cast("double"), F.lit(low), F.lit(high), F.lit(buckets)).cast("int").alias("bucket")).count()
    spine = pixels.sparkSession.range(1, buckets + 1).select(F.col("id").cast("int").alias("bucket"))
    return spine.join(counted, "bucket", "left").select("bucket", F.coalesce("count", F.lit(0)).alias("count"))


def counted(rows: DataFrame, **conditions: Column) -> tuple[DataFrame, Observation]:
    """rows unchanged, and their number and that of each condition, observed while the rows are used."""
    seen = Observation()
    named = [F.count_if(condition).alias(name) for name, condition in conditions.items()]
    return rows.observe(seen, F.count("*").alias("rows"), *named), seen
