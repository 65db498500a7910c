"""Packing: documents into fixed windows by order-preserving dynamic programming.

Documents keep their scan order.  Each scan partition is one token stream; cuts may fall at document ends (free), at
sentence ends (a small penalty) and, where both are sparse or the stream ends, inside a sentence (a larger penalty).
A window pays for its padding up to the window size, except that a window whose length is a power of two pays none.
With cost(j) the least cost of a stream cut at position p[j],

    cost(j) = penalty(j) + overhead + min( min over p[j] - p[i] <= size of cost(i) + size - (p[j] - p[i]),
                                           min over p[j] - p[i] a power of two of cost(i) )

the first minimum is a sliding-window minimum of cost(i) + p[i], kept in a monotone queue, so a cut costs amortised
constant time.  The stream is solved in stretches; the last windows of a stretch are solved again with the next one,
which bounds memory by the stretch and keeps every window near the optimum.  There is no shuffle.

Defined results: a null text is empty and gives the end id alone; a null id stays null; repeated rows are packed once
for each row; a text longer than a window is cut into pieces; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import json
import os
from array import array
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from rasterloom.llm.common import CACHE_CHARS, slices

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

#: In tokens: what a cut after a sentence costs, a cut inside one, and any window at all.
SENTENCE_CUT, HARD_CUT, OVERHEAD = 8.0, 32.0, 1.0
#: A stretch between possible cuts is not longer than this; the tokens solved at once; the tokens solved again.
SPACING, STRETCH, AGAIN = 256, 1 << 18, 1 << 14
#: Marks that may follow the letters of a word; the tokenizer splits before them (an apostrophe is not among them).
MARKS = '.,!?;:*%&$#-"()'
#: Words that an encoder keeps in each of its two generations, of CACHE_CHARS characters at most.
CACHE_WORDS = 150_000


class _Kept(dict):
    """Values made on demand, in two generations: what the older one still held moves on when it is asked for."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older, self.chars = make, {}, 0

    def __missing__(self, key: str) -> bytes:
        if (value := self.older.get(key)) is None:
            value = self.make(key)
        self.chars += len(key)
        if len(self) >= CACHE_WORDS or self.chars > CACHE_CHARS:
            self.older, self.chars = dict(self), len(key)
            self.clear()
        self[key] = value
        return value


class WordEncoder:
    """Encodes whole texts with a tokenizer that drops white space, word by word with a cache.

    Such a tokenizer never looks across a blank or a line feed, so the ids of a text are those of its parts in order.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = _letters_encoder(path)
        self.words, self.marks = _Kept(self._word), _Kept(self._whole)
        ends = [i for token, i in self.tokenizer.get_vocab().items() if token.removesuffix("</w>")[-1:] in (".", "!", "?") and token.endswith("</w>")]
        self.ends_sentence = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.ends_sentence[ends] = True

    def _whole(self, part: str) -> bytes:
        return array("I", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes() if part else b""

    def _word(self, word: str) -> bytes:
        core = word.rstrip(MARKS)
        # Latin letters alone need no normaliser but lower case, and the marks after them are a part of their own
        if self.letters and core.isalpha() and (core.isascii() or (max(core) < "\u0250" and "\u0130" not in core)):
            ids = array("I", self.letters(core.lower().encode() + b"\xff")).tobytes()
            return ids if len(core) == len(word) else ids + self.marks[word[len(core) :]]
        return self._whole(word)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        ids = self.words.__getitem__
        return [b"".join(map(ids, t.replace("\n", " ").split(" "))) for t in texts]


def _letters_encoder(path: str):
    """The same merges in tiktoken's form, which is several times faster for a single run of letters, or None.

    A byte that UTF-8 never holds stands for the word end.  The merges are applied in the order of their ids, as the
    file's own list has them; the tests hold the ids against the tokenizer's.
    """
    import tiktoken

    model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
    if model.get("end_of_word_suffix") != "</w>":
        return None
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    byte_of = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in visible)}
    ranks = {}
    for token, rank in model["vocab"].items():
        body = token.removesuffix("</w>")
        if all(c in byte_of for c in body) and not token.startswith("<|"):
            ranks[bytes(byte_of[c] for c in body) + b"\xff" * (body != token)] = rank
    return tiktoken.Encoding("letters", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker, so that its words outlive a task."""
    return WordEncoder(path)


def plan(doc_ends: np.ndarray, sentence_ends: np.ndarray, total: int, size: int, last: bool) -> list[int]:
    """The window ends for a stream of `total` tokens; `last`: the stream ends there."""
    marks = np.unique(np.concatenate([doc_ends, sentence_ends, [0, total]]))
    gaps = np.diff(marks)
    space = max(1, min(SPACING, size // 2))
    extra = [np.arange(marks[i] + space, marks[i + 1], space) for i in np.flatnonzero(gaps > space)]
    if last:  # the tail may be cut anywhere, so that powers of two fill it
        extra.append(np.arange(max(0, total - size), total))
    place = np.unique(np.concatenate([marks, *extra])) if extra else marks
    penalty = np.full(len(place), HARD_CUT)
    penalty[np.searchsorted(place, sentence_ends)] = SENTENCE_CUT
    penalty[np.searchsorted(place, doc_ends)] = 0.0
    penalty[-1] = 0.0
    exact: list[list[int]] = [[] for _ in range(len(place))]
    step = 1
    while step <= size:
        wanted = place - step
        at = np.searchsorted(place, wanted)
        for j in np.flatnonzero((wanted >= 0) & (place[at] == wanted)).tolist():
            exact[j].append(int(at[j]))
        step *= 2
    p, pen = place.tolist(), penalty.tolist()
    cost, back = [0.0] * len(p), [0] * len(p)
    queue: deque[int] = deque([0])
    for j in range(1, len(p)):
        here = p[j]
        while p[queue[0]] < here - size:
            queue.popleft()
        i = queue[0]
        best = cost[i] + size - here + p[i]
        for k in exact[j]:
            if cost[k] < best:
                best, i = cost[k], k
        cost[j], back[j] = best + pen[j] + OVERHEAD, i
        key = cost[j] + here
        while queue and cost[queue[-1]] + p[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    ends, j = [], len(p) - 1
    while j > 0:
        ends.append(p[j])
        j = back[j]
    return ends[::-1]


class Packer:
    """Packs one stream.  add() and finish() return pieces as columns of SCHEMA."""

    def __init__(self, ends_sentence: np.ndarray, size: int, first_sequence: int):
        self.ends_sentence, self.size, self.next = ends_sentence, size, first_sequence
        self.docs: list[tuple[int | None, int, int, bytes]] = []  # id, start, tokens of the whole document, ids from start on
        self.held = 0

    def add(self, doc_id: int | None, ids: bytes) -> list[tuple]:
        self.docs.append((doc_id, 0, len(ids) // 4, ids))
        self.held += len(ids) // 4
        return self._cut(False) if self.held >= STRETCH else []

    def finish(self) -> list[tuple]:
        return self._cut(True) if self.held else []

    def _cut(self, last: bool) -> list[tuple]:
        raw = b"".join(d[3] for d in self.docs)
        ids = np.frombuffer(raw, "<u4")
        doc_ends = np.cumsum([len(d[3]) // 4 for d in self.docs])
        sentence_ends = np.flatnonzero(self.ends_sentence[np.minimum(ids, len(self.ends_sentence) - 1)]) + 1
        ends = np.array(plan(doc_ends, sentence_ends, len(ids), self.size, last))
        if not last:
            ends = ends[ends <= len(ids) - AGAIN]
        done = int(ends[-1])
        bounds = np.union1d(ends, doc_ends[doc_ends <= done])
        starts = np.concatenate([[0], bounds[:-1]])
        of_doc = np.searchsorted(doc_ends, starts, side="right")
        of_window = np.searchsorted(ends, starts, side="right")
        window_start = np.concatenate([[0], ends[:-1]])[of_window]
        doc_start = np.concatenate([[0], doc_ends[:-1]])[of_doc]
        out = []
        for a, b, d, w, ws, ds in zip(starts.tolist(), bounds.tolist(), of_doc.tolist(), of_window.tolist(), window_start.tolist(), doc_start.tolist(), strict=True):
            doc_id, start, whole, _ = self.docs[d]
            out.append((doc_id, start + a - ds, b - a, raw[4 * a : 4 * b], whole, self.next + w, a - ws))
        self.next += len(ends)
        keep = int(np.searchsorted(doc_ends, done, side="right"))
        rest = self.docs[keep:]
        if rest:
            used = done - int(doc_ends[keep] - len(self.docs[keep][3]) // 4)
            doc_id, start, whole, own = rest[0]
            rest[0] = (doc_id, start + used, whole, own[4 * used :])
        self.docs, self.held = rest, len(ids) - done
        return out


def _batches(rows: Iterator[pa.RecordBatch], at_once: int = 256) -> Iterator[tuple[list, list]]:
    for batch in rows:
        for part in slices(batch, 1, at_once):
            yield part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents (SCHEMA); ids holds a piece's ids as little-endian unsigned 32-bit integers.

    `tokenizer` is the path of a tokenizer that drops white space; it must be readable on every executor.
    """
    tail = np.array([end_id], "<u4").tobytes()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        packer = Packer(encoder.ends_sentence, size, TaskContext.get().partitionId() << 33)
        types = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

        def batch(pieces: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*pieces, strict=True), types, strict=True)], names)

        for ids, texts in _batches(rows):
            for doc_id, encoded in zip(ids, encoder.encode(texts), strict=True):
                if pieces := packer.add(doc_id, encoded + tail):
                    yield batch(pieces)
        if pieces := packer.finish():
            yield batch(pieces)

    from pyspark.sql import functions as F

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)
