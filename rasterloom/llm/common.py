"""Helpers that several corpus operators share."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.sources import scratch

#: The characters that separate words: the space and the controls 0x09 to 0x0D.
WHITE = " \t\n\x0b\x0c\r"
#: Characters of words that a worker keeps besides their number, so that long words do not fill its memory.
CACHE_CHARS = 4_000_000


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back, which ends its lineage."""
    spark = df.sparkSession
    path = scratch.work_folder(spark, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.__dict__["written_to"] = path
    return found


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables of `materialise` that no later plan reads; others are left alone."""
    for t in tables:
        if t is not None and (path := t.__dict__.pop("written_to", None)):
            scratch.delete(t.sparkSession, path)


def slices(batch: pa.RecordBatch, text: int, rows: int, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most `rows` rows and, beyond one row, `size` bytes of text in the column at `text`."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, side="right"))))
        yield batch.slice(at, end - at)
        at = end


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo `modulus` (null for a null id)."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def crc_of_ids(ids) -> int:
    """crc32 of ids as little-endian unsigned 32-bit integers; ids is a NumPy array."""
    return zlib.crc32(ids.astype("<u4").tobytes())
