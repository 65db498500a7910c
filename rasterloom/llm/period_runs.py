"""Periodic run detection: a suffix automaton whose end-position sets are merged from small to large.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), at least `least` words and
`times` * q words long, that no neighbouring word extends with that period.

The automaton of the words has a state for each set of end positions; a state's set is the union of those of the states
that link to it.  Sets are ordered lists, the smaller is put into the larger one by binary search, longest states first,
and only the distances to a new position's two neighbours are looked at: a distance d of at most the state's length (its
length over times - 1, since a run has `times` periods) means that the words before both positions agree over a period
at least, which is a square and seeds a run of period d.  A seed is extended to both sides as far as words d apart agree.
A run of smallest period q has two neighbours q apart in the set of all its words but the last q, so none is lost; a
stretch found with several periods keeps the least.

Before that a text is cut where no run passes: inside a run of L >= times * q words each group of three words that follow
one another occurs floor((L - 2) / q) times or more, which is `times` - 1 for q > 1, and L - 2 times for q = 1.  Stretches
of groups that are frequent enough within their own stretch are found again until nothing changes; words outside of them
belong to no run, and each stretch gets an automaton of its own.  No run crosses a cut, so this loses none.

Memory grows with the longest such stretch of a single text, by some 700 bytes a word; stretches without repetitions,
however long, take 100 bytes a word of a batch of at most 4 MB or one text.

Defined results: a null text has no words and no runs; words are separated by the space and the controls 0x09 to 0x0D
alone; repeated rows get equal results; a null id is kept, and its text is left as it is by `looped`; very long texts are
read whole; an empty table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import slices

#: (start, length, period) of a run, in words.
Run = tuple[int, int, int]


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix automaton: (length, link) of every state and the state of every prefix; state 0 is the empty word's."""
    length, link, step = [0], [-1], [{}]
    prefixes, last = [], 0
    for word in words:
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        step.append({})
        p = last
        while p >= 0 and word not in step[p]:
            step[p][word] = new
            p = link[p]
        if p >= 0:
            q = step[p][word]
            if length[q] != length[p] + 1:
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                step.append(step[q].copy())
                link[q] = copy
                while p >= 0 and step[p].get(word) == q:
                    step[p][word] = copy
                    p = link[p]
                q = copy
            link[new] = q
        prefixes.append(new)
        last = new
    return length, link, prefixes


def seeds(words: list[int], times: int) -> Iterator[tuple[int, int, int]]:
    """(period, first, last) of periodic stretches, first and last included, from new neighbours in end-position sets.

    Positions are kept as distances from the end: in a periodic text they arrive from back to front, at the end of a list.
    """
    length, link, prefixes = automaton(words)
    at: list[list[int] | None] = [None] * len(length)
    end = len(words) - 1
    for k, state in enumerate(prefixes):
        at[state] = [end - k]
    for state in np.argsort(-np.array(length), kind="stable").tolist():
        parent = link[state]
        if parent <= 0:  # the root's set is that of the empty word
            continue
        small, large, own = at[state], at[parent], length[parent]
        at[state] = None
        if large is None:
            at[parent] = small
            continue
        if len(small) > len(large):
            small, large = large, small
        reach = own // (times - 1)
        for x in small:
            if x > large[-1]:
                place = len(large)
                large.append(x)
            else:
                place = bisect_left(large, x)
                large.insert(place, x)
                if 0 < (d := large[place + 1] - x) <= reach:
                    yield d, end - large[place + 1] - own + 1, end - x
            if place and (d := x - large[place - 1]) <= reach:
                yield d, end - x - own + 1, end - large[place - 1]
        at[parent] = large


def agreeing(same, k: int, step: int, stop: int) -> int:
    """How many places from k on, going by `step` (1 or -1), hold before `stop`, as `same(low, high)` tells; in growing spans."""
    done, span = 0, 32
    while True:
        room = min(span, (stop - k) * step - done)
        if room <= 0:
            return done
        low = k + done if step > 0 else k - done - room + 1
        found = same(low, low + room)
        if not found.all():
            return done + int(np.argmin(found if step > 0 else found[::-1]))
        done, span = done + room, span * 4


def runs_of(words: np.ndarray, least: int = 6, times: int = 4) -> list[Run]:
    """All runs of a stretch of word numbers, by start and then period; times is 2 or more."""
    n, found = len(words), {}
    for d, first, last in seeds(words.tolist(), times):
        starts, ends = found.setdefault(d, ([], []))
        k = bisect_right(starts, first) - 1
        if k >= 0 and last <= ends[k]:
            continue  # inside a stretch known to have this period
        same = lambda low, high, d=d: words[low:high] == words[low - d : high - d]
        left = first + d - agreeing(same, first + d - 1, -1, d - 1) - d
        right = last + agreeing(same, last + 1, 1, n)
        k = bisect_left(starts, left)
        starts.insert(k, left)
        ends.insert(k, right)
    shortest: dict[tuple[int, int], int] = {}
    for d, (starts, ends) in found.items():
        for span in zip(starts, ends, strict=True):
            shortest[span] = min(d, shortest.get(span, d))
    return sorted((a, b - a + 1, d) for (a, b), d in shortest.items() if b - a + 1 >= max(least, times * d))


def stretches(codes: np.ndarray, ends: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """(first, last) word of every stretch of the texts that may hold runs; text k ends before word ends[k].

    A group of three words is looked for within its own stretch, first a whole text, then what is left of it.
    """
    need = min(times - 1, max(1, least - 2)) if least >= 3 else 1
    n = len(codes)
    owner = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
    if need < 2 or n < 3:
        bounds = np.flatnonzero(np.diff(owner)) + 1
        return [(int(a), int(b) - 1) for a, b in zip(np.concatenate([[0], bounds]), np.append(bounds, n), strict=True)] if n else []
    # numbers of groups of three: pairs first, so that no product overflows
    pair = np.unique(codes[:-1] * np.int64(codes.max() + 1) + codes[1:], return_inverse=True)[1].astype(np.int64)
    group = np.unique(pair[:-1] * np.int64(pair.max() + 1) + pair[1:], return_inverse=True)[1].astype(np.int64)
    place = np.flatnonzero(owner[:-2] == owner[2:])
    part = owner[place].astype(np.int64)
    while len(place):
        _, back, count = np.unique(part * np.int64(len(group)) + group[place], return_inverse=True, return_counts=True)
        kept = count[back] >= need
        if kept.all():
            break
        gap = np.concatenate([[True], (np.diff(place[kept]) > 1) | (np.diff(part[kept]) > 0)]) if kept.any() else np.zeros(0, bool)
        place, part = place[kept], np.cumsum(gap)
    if not len(place):
        return []
    first = np.flatnonzero(np.concatenate([[True], np.diff(part) > 0]))
    last = np.append(first[1:], len(place)) - 1
    return [(int(a), int(b) + 2) for a, b in zip(place[first], place[last], strict=True) if b + 3 - a >= least]


def looped(words: list, n: int, h: int) -> list:
    """The words of a text, and, where 10 divides h, a tail that repeats its own first part."""
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    head = words[a : a + p]
    return words[:a] + (head * (-(-(n - a) // p)))[: n - a]


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[k] for k in np.flatnonzero(keep).tolist()]


def longest_power(runs: list[Run]) -> Run | None:
    """The run of greatest length over period, compared exactly; ties go to the least start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def find_runs(texts: list[list[bytes]], least: int = 6, times: int = 4) -> list[list[Run]]:
    """The runs of each text, a text being its words."""
    numbers: dict[bytes, int] = {}
    codes = np.fromiter((numbers.setdefault(w, len(numbers)) for t in texts for w in t), np.int64)
    ends = np.cumsum([len(t) for t in texts]) if texts else np.zeros(0, np.int64)
    found: list[list[Run]] = [[] for _ in texts]
    for first, last in stretches(codes, ends, least, times):
        k = int(np.searchsorted(ends, first, side="right"))
        start = first - (int(ends[k - 1]) if k else 0)
        found[k] += [(start + a, length, period) for a, length, period in runs_of(codes[first : last + 1], least, times)]
    return [sorted(own, key=lambda r: (r[0], r[2])) for own in found]


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"


def periodic_runs(docs: DataFrame, loop: bool = False, least: int = 6, times: int = 4) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs, collapsed) for every row of docs.

    start to exponent_milli describe the run of greatest exponent; collapsed is the text, one space between words, without
    what its runs repeat.  With `loop` the words are first changed as `looped` says, by the crc32 of the id in decimal.
    """
    fields = [(f.split()[0], pa.int64()) for f in SCHEMA.split(", ")[:6]]
    out = pa.schema([*fields, ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 256):
                ids = part.column(0).to_pylist()
                texts = [(t or b"").split() for t in part.column(1).to_pylist()]  # bytes are split at ASCII white space alone
                if loop:
                    texts = [t if i is None else looped(t, len(t), zlib.crc32(str(i).encode())) for i, t in zip(ids, texts, strict=True)]
                found = find_runs(texts, least, times)
                best = [longest_power(r) or (None, None, None) for r in found]
                rows = {
                    "doc_id": part.column(0), "n_runs": [len(r) for r in found], "start": [b[0] for b in best], "length": [b[1] for b in best], "period": [b[2] for b in best],
                    "exponent_milli": [None if b[0] is None else 1000 * b[1] // b[2] for b in best],
                    "runs": [[{"start": a, "length": n, "period": q} for a, n, q in r] for r in found],
                    "collapsed": [b" ".join(collapsed(t, r)) for t, r in zip(texts, found, strict=True)],
                }
                yield pa.RecordBatch.from_arrays([rows[f.name] if f.name == "doc_id" else pa.array(rows[f.name], f.type) for f in out], schema=out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, SCHEMA)
