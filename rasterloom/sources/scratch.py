"""The folder for intermediate tables that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set a temporary folder serves a session in one process (master local...), whose executor reads what
    the driver wrote; a session with other executors gets an error, since they do not see each other's disks.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="rasterloom-")
    context.setCheckpointDir(folder)
    return folder


def work_folder(spark: SparkSession, name: str) -> str:
    """A new path for one table of this application; `clear` removes all of them."""
    return f"{shared_folder(spark)}/rasterloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again, which ends its lineage and computes it once."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def make(spark: SparkSession, path: str) -> None:
    """Makes a folder, so that it can be read even if nothing is written to it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder through the file system that Spark uses for it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def clear(spark: SparkSession) -> None:
    """Deletes every table that this application has left in the shared folder; results not yet read are lost."""
    delete(spark, f"{shared_folder(spark)}/rasterloom-{spark.sparkContext.applicationId}")
