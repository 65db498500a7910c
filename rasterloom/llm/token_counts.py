"""Token counts by section: encode a whole document once and join token spans with section spans.

A document is encoded once; each token has a span of characters.  Sections partition the text (`lines`: every line with
its line feed), and the token spans are joined with them as intervals, by binary search over the section starts.
A token whose span crosses a section boundary is allocated by an explicit rule:

    first   the section with the token's first character
    last    the section with its last character
    most    the section with most of its characters; a tie goes to the earliest
    split   each section gets its share of the characters (only in token_share, which follows this rule always)

Defined results: a null text has no sections, and neither has an empty one, so such rows give no result rows; several
tokens inside one character all have that character as span; rows are counted one by one, so repeated rows repeat their
sections; a very long text is encoded whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import CACHE_CHARS, slices

SCHEMA = "doc_id long, section int, kind string, char_start long, n_chars long, n_tokens long, n_crossing long, token_share double"
RULES = ("first", "last", "most")
#: Parts that an encoder keeps in each of its two generations, of CACHE_CHARS characters at most but for the last batch.
CACHE_PARTS = 400_000


class SpanEncoder:
    """Token spans of whole texts for a byte-level BPE, with a cache of the parts between which merges never reach."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text here
        self.parts = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.chars = 0

    def spans(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Starts and ends of the tokens of each text, in characters."""
        if len(self.known) > CACHE_PARTS or self.chars > CACHE_CHARS:
            self.known, self.older, self.chars = {}, self.known, 0
        known, older, split = self.known, self.older, [self.parts(t) for t in texts]
        order = []
        for part in set().union(*split):  # `set - keys()` would walk all keys
            if part in known:
                continue
            self.chars += len(part)
            if (spans := older.get(part)) is None:
                order.append(part)
            else:
                known[part] = spans
        for part, e in zip(order, self.tokenizer.encode_batch(order, add_special_tokens=False), strict=True):
            known[part] = array("I", chain.from_iterable(e.offsets)).tobytes()
        for parts in split:
            found = list(map(known.__getitem__, parts))
            relative = np.frombuffer(b"".join(found), "<u4").reshape(-1, 2)
            length = np.fromiter(map(len, parts), np.int64, len(parts))
            tokens = np.fromiter(map(len, found), np.int64, len(parts)) // 8
            base = np.repeat(np.cumsum(length) - length, tokens)
            yield base + relative[:, 0], base + relative[:, 1]


@lru_cache(maxsize=2)
def span_encoder(path: str, pattern: str) -> SpanEncoder:
    """One encoder for each Python worker, so that its parts outlive a task."""
    return SpanEncoder(path, pattern)


def lines(text: str) -> tuple[np.ndarray, list[str]]:
    """Starts of the lines of a text and their kinds; a line holds its line feed, and no line is empty."""
    parts = [p + "\n" for p in text.split("\n")]
    parts[-1] = parts[-1][:-1]
    if not parts[-1]:
        parts.pop()
    length = np.fromiter(map(len, parts), np.int64, len(parts))
    kinds = ["table" if " | " in p else "list" if p.lstrip()[:2] in ("- ", "* ") else "heading" if k == 0 and len(parts) > 1 else "blank" if p.isspace() else "body" for k, p in enumerate(parts)]
    return np.cumsum(length) - length, kinds


def attribute(starts: np.ndarray, ends: np.ndarray, section_starts: np.ndarray, total: int, rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, crossing tokens and shares of each section."""
    n = len(section_starts)
    low = np.searchsorted(section_starts, starts, side="right") - 1
    high = np.searchsorted(section_starts, np.maximum(ends - 1, starts), side="right") - 1
    owner = low.copy() if rule != "last" else high.copy()
    share = np.bincount(low[low == high], minlength=n).astype(float)
    crossing = np.zeros(n, np.int64)
    bounds = np.append(section_starts, total)
    for t in np.flatnonzero(low != high):
        touched = np.arange(low[t], high[t] + 1)
        inside = np.minimum(bounds[touched + 1], ends[t]) - np.maximum(bounds[touched], starts[t])
        share[touched] += inside / (ends[t] - starts[t])
        crossing[touched] += 1
        if rule == "most":
            owner[t] = touched[np.argmax(inside)]
    return np.bincount(owner, minlength=n), crossing, share


def token_counts(docs: DataFrame, tokenizer: str, pattern: str, rule: str = "most", sections=lines, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (SCHEMA) for each section of each document.  `sections` maps a text to section starts and kinds."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = span_encoder(tokenizer, pattern)
        names = ["doc_id", "section", "kind", "char_start", "n_chars", "n_tokens", "n_crossing", "token_share"]
        for batch in rows:
            for part in slices(batch, 1, 256):
                ids, texts = part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]
                out: list[list] = [[] for _ in range(8)]
                for doc_id, body, (starts, ends) in zip(ids, texts, encoder.spans(texts), strict=True):
                    if not body:
                        continue
                    at, kinds = sections(body)
                    tokens, crossing, share = attribute(starts, ends, at, len(body), rule)
                    size = np.diff(np.append(at, len(body)))
                    for column, values in zip(out, ([doc_id] * len(at), range(len(at)), kinds, at, size, tokens, crossing, np.round(share, 9)), strict=True):
                        column.extend(values)
                types = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)
