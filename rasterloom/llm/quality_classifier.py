"""Quality classifier: logistic regression over hashed word n-grams, trained by follow the regularised leader.

A text becomes a sparse vector: one- and two-word n-grams of its words and one- to three-word n-grams of the shapes of
its words (case, trailing symbols, a mark for a repeated word), hashed to 2**BITS places; values are the square roots of
the counts, scaled to length one.  The fit passes over the sample in a fixed order with FTRL-proximal updates (per-place
learning rates, L1 and L2).  A score is the logistic function of a sparse dot product.

The fit uses at most `max_rows` labelled rows (of each label those with the smallest hash of their id) and `max_bytes` of their text, in
one task; all rows are scored where they lie.

Defined results: a null text counts as empty, and an empty text gets the score of the constant alone; rows with a null
id are scored but never learned from; labels other than 0 and 1 are left out, repeated labels of an id count once, with the larger
one; without labels the score is 0.5; repeated rows get equal scores; an empty table gives an empty table; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import CACHE_CHARS, slices
from rasterloom.llm.toxicity import fit_in_one_task, labelled_sample

BITS = 18
ALPHA, BETA, L1, L2, PASSES = 0.3, 1.0, 0.3, 1.0, 4
CACHE_WORDS = 150_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)

_HALF, _LOW = np.uint64(32), np.uint64(0xFFFFFFFF)


def word_shape(word: str) -> str:
    """Case of the letters, whether it has digits, and its last character if that is no letter."""
    case = "A" if word.isupper() and len(word) > 1 else "Aa" if word[:1].isupper() else "a" if word.islower() else "-"
    tail = "" if word[-1:].isalpha() else word[-2:] if not word[-2:-1].isalnum() else word[-1:]
    return f"{case}{'0' if any(map(str.isdigit, word)) else ''}{tail}"


class Hasher:
    """Sparse vectors of texts; a word's hash and shape are computed once and kept."""

    def __init__(self):
        self.words: dict[str, int] = {}
        self.chars = 0

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        if not words:
            return np.zeros(0, np.int64), np.zeros(0)
        if len(self.words) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self.words, self.chars = {}, 0
        known = self.words
        for w in set(words):
            if w in known:
                continue
            self.chars += len(w)
            known[w] = zlib.crc32(w.lower().encode()) << 32 | zlib.crc32(word_shape(w).encode(), 7)
        both = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        own, shape = both >> _HALF, both & _LOW
        shape[1:][own[1:] == own[:-1]] = 1  # a word that repeats the one before
        grams = [_mix(own, 1), _mix(shape, 2)]
        if len(words) > 1:
            grams += [_mix(own[:-1] * _ODD[0] + own[1:], 3), _mix(shape[:-1] * _ODD[0] + shape[1:], 4)]
        if len(words) > 2:
            grams.append(_mix((shape[:-2] * _ODD[0] + shape[1:-1]) * _ODD[1] + shape[2:], 5))
        places = np.sort(np.concatenate(grams))
        first = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
        values = np.sqrt(np.diff(np.append(first, len(places))))
        return places[first], values / np.sqrt(np.dot(values, values))


def _mix(x: np.ndarray, kind: int) -> np.ndarray:
    x = (x + np.uint64(kind)) * _ODD[0]
    x ^= x >> np.uint64(31)
    x *= _ODD[1]
    return (x >> np.uint64(64 - BITS)).astype(np.int64)


def ftrl(vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, passes: int = PASSES, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights of 2**BITS places and, last, of the constant; a row's gradient counts by its own weight."""
    weight = np.ones(len(labels)) if weight is None else weight
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    full = [(np.append(i, size - 1), np.append(v, 1.0)) for i, v in vectors]
    for _ in range(passes):
        for (i, v), y, share in zip(full, labels, weight, strict=True):
            w = weights(i)
            g = share * (1 / (1 + np.exp(-np.clip(w @ v, -30, 30))) - y) * v
            ni = n[i]
            z[i] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[i] = ni + g * g
    return weights(np.arange(size)).astype(np.float32)


def fit(rows: list[tuple[int, str, int, float]]) -> bytes:
    """The weights as float32 bytes, from rows (doc_id, text, label, weight) in any order."""
    hasher = Hasher()
    rows = sorted(rows, key=lambda r: (zlib.crc32(str(r[0]).encode()), r))
    return ftrl([hasher.vector(r[1]) for r in rows], np.array([r[2] for r in rows], float), weight=np.array([r[3] for r in rows])).tobytes()


def quality_model(docs: DataFrame, labels: DataFrame, learn: Column, max_rows: int = 12_000, max_bytes: int = 1 << 26) -> bytes:
    return fit_in_one_task(labelled_sample(docs, labels, "quality", learn, max_rows), fit, max_bytes)


def score(docs: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, score) for every row; the model has 2**BITS + 1 weights, about 1 MB."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, hasher = np.frombuffer(shared.value, np.float32).astype(float), Hasher()
        for batch in batches:
            for part in slices(batch, 1, 512):
                found = [hasher.vector(t or "") for t in part.column(1).to_pylist()]
                total = weights[-1] + np.array([weights[i] @ v for i, v in found])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
