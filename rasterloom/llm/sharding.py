"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a row's hash.  It starts with one bucket of depth 0; a bucket whose rows
weigh more than the byte limit is split on the next bit, and only such a bucket.  After the split rule has come to rest
every row lies in the one bucket of least depth that fits, so the directory can be computed without moving rows: rows
are summed into cells of `step` bits (map-side combined), every cell adds its bytes to each of its prefixes, and the
shallowest prefix that fits is the cell's bucket.  Cells that are still too large go on with the next `step` bits in
another round over those rows alone, until the hash is used up.

Defined results: the hash covers the id alone, and a null id counts as an empty string; a null text weighs 0 bytes; rows
with the same id share a hash, and where they alone exceed the limit their bucket gets numbered overflow pages, filled in scan order
within each scan partition; a single row heavier than the limit has a page of its own; an empty table gives no shards;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import materialise

HASH_BITS = 60


def row_hash(*columns: Column) -> Column:
    """60 bits of md5 over the columns as text: fifteen hexadecimal digits, so that any engine gets the same."""
    text = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def directory(weights: DataFrame, limit: int, first: int, step: int) -> DataFrame:
    """Buckets for rows (hash, bytes) below buckets of `first` bits that are known to be too heavy (or first = 0).

    Returns (cell, depth, prefix, n_bytes, alike), a row for each cell of first + step bits: its bucket, and whether all
    rows of the bucket share one hash, in which case no further bit can split it.
    """
    last = first + step
    cells = weights.groupBy(F.shiftright("hash", HASH_BITS - last).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.min("hash").alias("low"), F.max("hash").alias("high"))
    spread = cells.withColumn("depth", F.explode(F.sequence(F.lit(first), F.lit(last)))).withColumn("prefix", F.expr(f"shiftright(cell, {last} - depth)"))
    sums = spread.groupBy("depth", "prefix").agg(F.sum("bytes").alias("n_bytes"), (F.min("low") == F.max("high")).alias("alike"))
    settled = sums.where((F.col("n_bytes") <= limit) | F.col("alike") | (F.col("depth") == last))
    # a cell keeps the shallowest of its prefixes at which splitting stops
    best = spread.select("cell", "depth", "prefix").join(settled, ["depth", "prefix"]).groupBy("cell").agg(F.min(F.struct("depth", "prefix", "n_bytes", "alike")).alias("b"))
    return best.select("cell", "b.*")


def shard(docs: DataFrame, limit: int, step: int = 12, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, shard_depth, shard_prefix, shard_page, doc_bytes) for every row of docs.

    The first directory has at most 2**step cells and is broadcast; later ones, which grow with the number of oversized
    buckets, are joined on the cell.  Each round ends in a written table, so a lost executor costs one round at most.
    """
    rows = docs.select(F.col(key).alias("doc_id"), row_hash(F.col(key)).alias("hash"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"))
    todo = rows.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    done, first = [], 0
    while True:
        width = min(step, HASH_BITS - first)
        found = materialise(directory(todo, limit, first, width), "directory")
        placed = todo.withColumn("cell", F.shiftright("hash", HASH_BITS - first - width)).join(F.broadcast(found) if first == 0 else found, "cell")
        fits, alike = F.col("n_bytes") <= limit, F.col("alike") | F.lit(first + width == HASH_BITS)
        done.append(_as_shards(placed.where(fits), F.lit(0).cast("long")))
        state = found.agg(F.max((~fits & alike).cast("int")).alias("full"), F.max((~fits & ~alike).cast("int")).alias("heavy")).first()
        if state.full:
            done.append(_overflow(placed.where(~fits & alike), limit))
        if not state.heavy:
            return reduce(DataFrame.unionByName, done)
        todo = materialise(placed.where(~fits & ~alike).select(*todo.columns), "oversized")
        first += width


def _as_shards(placed: DataFrame, page: Column) -> DataFrame:
    return placed.select("doc_id", F.col("depth").cast("int").alias("shard_depth"), F.col("prefix").alias("shard_prefix"), page.alias("shard_page"), F.col("bytes").alias("doc_bytes"))


def _overflow(placed: DataFrame, limit: int) -> DataFrame:
    """Rows of one hash value that exceed the limit together: pages within each scan partition.

    A page starts where the running sum before a row enters another half limit, or with a row above half the limit, so
    every page of more than one row keeps within the limit.
    """
    in_order = Window.partitionBy("cell", "__part").orderBy("__at")
    half = max(1, limit // 2)
    before = F.sum("bytes").over(in_order) - F.col("bytes")
    large = (F.col("bytes") > half).cast("long")
    lot = placed.withColumn("__lot", F.floor(before / half).cast("long") * 2 + large)
    starts = lot.withColumn("__new", F.coalesce((F.col("__lot") != F.lag("__lot").over(in_order)) | (large == 1), F.lit(True)).cast("long"))
    page = F.sum("__new").over(in_order) + F.col("__part").cast("long") * F.lit(1 << 40)
    return _as_shards(starts.withColumn("__page", page), F.col("__page"))


def shard_sql(limit: int, step: int = 12) -> str:
    """The result for op10 as DuckDB SQL, valid while no bucket needs more than `step` bits."""
    return f"""
WITH rows_ AS (
  SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {HASH_BITS // 4}) AS BIGINT) AS hash,
         CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS bytes FROM documents),
spread AS (
  SELECT depth, hash >> ({HASH_BITS} - depth) AS prefix, sum(bytes) AS n_bytes
  FROM rows_, (SELECT unnest(range(0, {step + 1})) AS depth) GROUP BY ALL),
placed AS (
  SELECT doc_id, bytes, min(depth) AS depth, any_value(hash) AS hash
  FROM rows_ JOIN spread ON spread.prefix = rows_.hash >> ({HASH_BITS} - spread.depth)
  WHERE n_bytes <= {limit} OR depth = {step} GROUP BY rows_.doc_id, bytes, hash)
SELECT doc_id, CAST(depth AS INTEGER) AS shard_depth, CAST(hash >> ({HASH_BITS} - depth) AS BIGINT) AS shard_prefix,
       CAST(0 AS BIGINT) AS shard_page, bytes AS doc_bytes FROM placed"""
