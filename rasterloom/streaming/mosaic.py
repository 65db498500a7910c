"""A mosaic that grows while scored tiles arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from rasterloom.operators.tiling import merge_max

SCORES = "row int, col int, pred smallint"


def read_scores(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """Scored pixels from Parquet files as they appear in a folder."""
    return spark.readStream.schema(SCORES).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def mosaic_stream(scores: DataFrame) -> DataFrame:
    """The running mosaic.  The maximum needs no watermark: a late tile changes its pixels whenever it comes."""
    return merge_max(scores)


def write_mosaic(mosaic: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch's changed pixels as a Parquet table of its own; a pixel's newest value is its largest.

    The batch number is in the path and the write replaces that path, so a batch that runs again leaves no copies.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return mosaic.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The mosaic as written so far."""
    return merge_max(spark.read.schema(SCORES).parquet(f"{folder}/batch=*"))
