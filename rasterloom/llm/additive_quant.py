"""Approximate nearest neighbours by additive quantisation.

A vector is coded as the sum of one codeword from each of several full-dimensional codebooks.  Codebooks start from
k-means over residuals and are then refitted by least squares between rounds of beam-search encoding.  With the
squared norm of the coded sum stored, the distance to a query needs one table of inner products: a lookup and an
addition for each codebook.  The best rows of each block by that score (the shortlist, with every row that ties with its
last one) are measured again on the original vectors, and each query keeps its `k` best.

Codebooks are fitted on at most `sample` rows (those with the smallest hash of their id); every row is coded.  Rows are
dealt into blocks of about `block` rows by a hash of the id, and the queries, in chunks, meet each block: nothing
but the fitted codebooks is broadcast.  The shortlist is one row in `share` of a block, twice k at least, at every size.

Vectors keep their type: float stays float, anything else becomes double.  They are coded in single precision after a
scaling by a power of two, and measured in double precision as they are.  A row whose scaled components leave the range
of single precision cannot be coded and is measured in every search; a query of that kind measures all rows.

Defined results: rows with a null id, or a vector that is null, empty, all zero, or holds a null or non-finite
component, take no part, and neither do vectors of a length other than that of most sampled rows; a query never finds
rows of its own id; equal distances go by the smaller id; repeated rows of one id are found once, at the distance of the
nearest; a query id that repeats asks with the least of its vectors, compared component by component; with fewer
candidates than k all are returned; an empty table, or one without queries, gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import materialise

BOOKS, WORDS, BEAM, ROUNDS, SWEEPS = 24, 256, 4, 2, 3
#: Squared norms of scaled vectors up to this are coded.
LARGEST = 1e30


def valid(vector: Column) -> Column:
    """Whether a vector takes part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(steps):
        near = np.argmin((centres * centres).sum(1) - 2 * (x @ centres.T), axis=1)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], x[rng.choice(len(x), k)])
    return centres.astype(np.float32)


def beam_encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (n, books): each codebook in turn extends the `beam` best partial sums of each vector."""
    n, (m, k, _) = len(x), books.shape
    norms = (books * books).sum(2)
    residual, codes = x[:, None, :], np.zeros((n, 1, 0), np.int64)
    for j in range(m):
        # |r - c|^2 for every kept residual and codeword
        cost = (residual * residual).sum(2)[:, :, None] - 2 * (residual @ books[j].T) + norms[j]
        flat = cost.reshape(n, -1)
        keep = min(beam if j < m - 1 else 1, flat.shape[1])
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.tile(np.arange(flat.shape[1]), (n, 1))
        came, word = best // k, best % k
        rows = np.arange(n)[:, None]
        residual = residual[rows, came] - books[j][word]
        codes = np.concatenate([codes[rows, came], word[:, :, None]], axis=2)
        del cost, flat
    return codes[:, 0, :].astype(np.uint8)


def fit(x: np.ndarray, seed: int = 7) -> np.ndarray:
    """Codebooks (books, words, dimension) for the sample x."""
    rng = np.random.default_rng(seed)
    words = int(min(WORDS, max(1, len(x))))
    books, rest = [], x.astype(np.float32)
    for _ in range(BOOKS):
        centres = _kmeans(rest, words, rng)
        near = np.argmin((centres * centres).sum(1) - 2 * (rest @ centres.T), axis=1)
        books.append(centres)
        rest = rest - centres[near]
    books = np.array(books)
    for _ in range(ROUNDS):
        codes = _encode(x, books)
        # least squares by blocks: each codebook in turn is fitted to what the others leave
        left = x - decode(codes, books)
        for j in list(range(BOOKS)) * SWEEPS:
            of = codes[:, j]
            left += books[j][of]
            counts, sums = np.bincount(of, minlength=words), np.zeros_like(books[j])
            np.add.at(sums, of, left)
            books[j] = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], books[j])
            left -= books[j][of]
    return books


def _encode(x: np.ndarray, books: np.ndarray, at_once: int = 1024) -> np.ndarray:
    parts = [beam_encode(x[i : i + at_once].astype(np.float32), books) for i in range(0, len(x), at_once)]
    return np.concatenate(parts) if parts else np.zeros((0, len(books)), np.uint8)


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[j][codes[:, j]] for j in range(len(books)))


def _matrix(column, dim: int) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim)


def distances(rows: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, without overflow for finite vectors whose distance is finite."""
    with np.errstate(over="ignore", invalid="ignore"):
        gap = rows.astype(np.float64) - vector.astype(np.float64)
        found = np.sqrt((gap * gap).sum(1))
        odd = np.flatnonzero(~np.isfinite(found) | (found < 1e-140))
        if len(odd):
            top = np.abs(gap[odd]).max(1)
            top = np.where(np.isfinite(top) & (top > 0), top, 1.0)
            part = gap[odd] / top[:, None]
            found[odd] = top * np.sqrt((part * part).sum(1))
    return found


def scaled(x: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows in single precision and whether each is in the range of the codes; zeros stand for those that are not."""
    with np.errstate(over="ignore", invalid="ignore"):
        y = x.astype(np.float64) * scale
        fits = (y * y).sum(1) <= LARGEST
    return np.where(fits[:, None], y, 0.0).astype(np.float32), fits


def search_block(ids: np.ndarray, x: np.ndarray, codes: np.ndarray, norms: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, books: np.ndarray, scale: float, k: int, shortlist: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its id, and the ids and distances of its best rows in this block; norms are infinite without a code."""
    order = np.lexsort((norms, ids))
    ids, x, codes, norms = ids[order], x[order], codes[order], norms[order]
    coded, rest = np.flatnonzero(np.isfinite(norms)), np.flatnonzero(~np.isfinite(norms))
    codes, norms = np.ascontiguousarray(codes[coded].T), norms[coded]
    small, fits = scaled(queries, scale)
    for q, vector, short, fit_ in zip(query_ids, queries, small, fits, strict=True):
        chosen = coded
        if fit_ and len(coded) > shortlist:
            near = norms.copy()
            for codes_of, row in zip(codes, books @ (-2 * short), strict=True):
                near += row[codes_of]
            limit = np.partition(near, shortlist - 1)[shortlist - 1]
            chosen = coded[near <= limit]  # with every tie
        chosen = np.concatenate([chosen, rest])
        chosen = chosen[ids[chosen] != q]
        distance = distances(x[chosen], vector)
        best = np.lexsort((ids[chosen], distance))
        _, first = np.unique(ids[chosen][best], return_index=True)
        best = best[np.sort(first)[:k]]
        yield q, ids[chosen][best], distance[best]


def index(vectors: DataFrame, books: np.ndarray, scale: float = 1.0) -> DataFrame:
    """Adds code (binary) and norm (float, infinite for a row that cannot be coded) to rows (vec_id, embedding)."""
    shared = vectors.sparkSession.sparkContext.broadcast(pickle.dumps(books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(shared.value)
        for batch in batches:
            if batch.num_rows:
                x, fits = scaled(_matrix(batch.column(1), own.shape[2]), scale)
                codes = _encode(x, own)
                norm = np.where(fits, (decode(codes, own) ** 2).sum(1), np.inf).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm)], ["vec_id", "embedding", "code", "norm"])

    return vectors.mapInArrow(run, f"vec_id long, embedding {vectors.schema['embedding'].dataType.simpleString()}, code binary, norm float")


def search(embeddings: DataFrame, is_query: Column, k: int = 10, sample: int = 8192, block: int = 32_768, chunk: int = 65_536, share: int = 100, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row with is_query(vec_id) true."""
    spark = embeddings.sparkSession
    kind = "float" if embeddings.schema[vector].dataType.elementType.typeName() == "float" else "double"
    rows = embeddings.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast(f"array<{kind}>").alias("embedding")).where(F.col("vec_id").isNotNull() & valid(F.col("embedding")))
    rows = materialise(rows.dropDuplicates(["vec_id", "embedding"]), "vectors")
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(sample).toPandas()
    empty = "query_id long, rank int, vec_id long, score double"
    if drawn.empty:
        return spark.createDataFrame([], empty)
    dim = int(drawn.embedding.map(len).mode().iloc[0])
    rows = rows.where(F.size("embedding") == dim)
    x = np.array([v for v in drawn.embedding if len(v) == dim], np.float64)
    scale = 2.0 ** -float(np.clip(np.floor(np.log2(np.median(np.abs(x).max(1)))), -900, 900))
    x, fits = scaled(x, scale)
    books = fit(x[fits])
    total, asked = rows.agg(F.count("*"), F.count_if(is_query)).first()
    blocks, chunks = max(1, -(-total // block)), max(1, -(-asked // chunk))
    coded = index(rows, books, scale).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    # the stated queries meet every block
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("chunk", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(chunks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    shared = spark.sparkContext.broadcast(pickle.dumps(books))

    def meet(data: pa.Table, asked: pa.Table) -> pa.Table:
        own, found = pickle.loads(shared.value), ([], [], [])
        if data.num_rows and asked.num_rows:
            codes = np.frombuffer(b"".join(data["code"].to_pylist()), np.uint8).reshape(-1, len(own))
            args = (data["vec_id"].to_numpy(), _matrix(data["embedding"], dim), codes, data["norm"].to_numpy(), asked["vec_id"].to_numpy(), _matrix(asked["embedding"], dim))
            for q, ids, distance in search_block(*args, own, scale, k, max(2 * k, -(-data.num_rows // share))):
                for column, values in zip(found, ([q] * len(ids), ids, distance), strict=True):
                    column.extend(values)
        return pa.table([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], names=["query_id", "vec_id", "score"])

    near = coded.groupBy("block", "chunk").cogroup(queries.groupBy("block", "chunk")).applyInArrow(meet, "query_id long, vec_id long, score double")
    best_first = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
