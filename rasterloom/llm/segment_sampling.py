"""Sampled segmentations: Gumbel top-k without replacement over the lattice of a SentencePiece vocabulary.

A text becomes a lattice whose edges are vocabulary pieces; the probability of a path is proportional to the product of
its piece weights, w(piece) = (rank + 2)**-theta with rank from the model file.  Characters outside the vocabulary are
one edge of byte pieces.  A piece never reaches past a blank that follows another character, so the lattice factors into
units (blanks and the characters after them), and the backward sums of a unit are computed once and kept.  Long units,
as of scripts without blanks, are cut again wherever no piece that the vocabulary holds reaches across.

Search.  Every path has a Gumbel perturbed log probability; the k largest are a sample without replacement.  A best-first
search keeps regions of the path space with the perturbed value of their best path.  The root's value is a Gumbel, and
its best path an ordinary sample.  When a region's best path is popped, the rest of the region splits by the first unit
that differs; each part's best value is a Gumbel at its log mass truncated at the popped value, and its best path is a
sample from that part.  So paths come out in falling order, and all are distinct.  The inclusion score of a path is
1 - exp(-exp(logp - kappa)) with kappa the (k+1)-th value.  All random numbers are hashes of the row's key.

Defined results: a null or empty text has no path and gives no rows; a text with fewer than k paths gives all of them,
with inclusion score 1; a null key counts as a key of its own; repeated rows get equal samples; very long texts are
sampled whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.llm.bag_minhash import mix
from rasterloom.llm.common import slices

SCHEMA = "doc_id long, sample int, ids binary, log_prob double, perturbed double, inclusion double"
BLANK = "▁"
#: Units and edges that a bank keeps between batches.
CACHE_UNITS, CACHE_EDGES = 300_000, 6_000_000
#: Units of more characters than this are cut where no piece reaches across.
LONG = 64
_STEP, _BASE = np.uint64(0x9E3779B97F4A7C15), 0x100000001B3
_runs = re.compile(f"{BLANK}+[^{BLANK}]*").findall


def _uniform(key: np.ndarray) -> np.ndarray:
    return ((mix(key) >> np.uint64(11)).astype(float) + 0.5) / 9007199254740992.0


def _mixed(x: int) -> int:
    """`mix` of one number."""
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % (1 << 64)
    x = (x ^ x >> 27) * 0x94D049BB133111EB % (1 << 64)
    return x ^ x >> 31


def _units(text: str) -> list[str]:
    """Blanks and the characters after them; a text begins with a blank of its own."""
    if not text:
        return []
    if "  " in text or text[0] == " " or BLANK in text:
        return _runs(BLANK + text.replace(" ", BLANK))
    return (BLANK + text.replace(" ", " " + BLANK)).split(" ")


class Vocabulary:
    """The pieces of a model, hashed by length, with their log weights."""

    def __init__(self, model: str, theta: float):
        import sentencepiece

        self.processor = p = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [(i, p.id_to_piece(i)) for i in range(p.vocab_size()) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i))]
        self.byte_ids = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.low_bytes = np.array(self.byte_ids[:0x80], np.int64)
        rank = {i: min(-p.get_score(i), float(p.vocab_size())) for i, _ in pieces}
        self.log_weight = np.full(p.vocab_size(), -theta * np.log(p.vocab_size() + 2.0))
        for i, r in rank.items():
            self.log_weight[i] = -theta * np.log(r + 2.0)
        self.tables = {}
        self.screen = np.zeros(1 << 20, bool)
        by_length: dict[int, list[tuple[int, int]]] = {}
        for i, piece in pieces:
            codes = mix(np.frombuffer(piece.encode("utf-32-le"), np.uint32).astype(np.uint64) + _STEP)
            h = 0
            for t, c in enumerate(codes.tolist()):
                h = (h + c * pow(_BASE, t, 1 << 64)) % (1 << 64)
            by_length.setdefault(len(piece), []).append((h, i))
        for length, found in by_length.items():
            found.sort()
            self.tables[length] = np.array([h for h, _ in found], np.uint64), np.array([i for _, i in found], np.int64)
            self.screen[(self.tables[length][0] >> np.uint64(44)).astype(np.int64)] = True


class Numbers(dict):
    """Numbers units in the order in which they are first looked up."""

    def __missing__(self, unit: str) -> int:
        self[unit] = number = len(self)
        return number


class Bank:
    """Lattices of units as flat arrays: nodes are character positions, and the edges of a node lie together."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.index = vocabulary, Numbers()
        self.units = self.nodes = self.edges = 0
        self.first_node, self.size, self.first_edge = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 19, np.int32)
        self.cum, self.logp = np.zeros(1 << 20), np.zeros(1 << 20)
        self.length, self.piece = np.zeros(1 << 20, np.int32), np.zeros(1 << 20, np.int32)

    def clear(self) -> None:
        """Forgets all units; the arrays keep their room."""
        self.index, self.units, self.nodes, self.edges = Numbers(), 0, 0, 0

    def _matches(self, codes: np.ndarray, left: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, starts, ids) of the pieces found in hashed characters, by length; left: characters to a unit's end."""
        v = self.vocabulary
        h, power, place = np.zeros(len(codes), np.uint64), 1, np.arange(len(codes))
        for length in range(1, max(v.tables) + 1):
            place = place[left[place] >= length]
            if not len(place):
                return
            h[place] += codes[place + length - 1] * np.uint64(power)
            power = power * _BASE % (1 << 64)
            if length not in v.tables:
                continue
            hashes, ids = v.tables[length]
            maybe = place[v.screen[(h[place] >> np.uint64(44)).astype(np.int64)]]
            at = np.minimum(np.searchsorted(hashes, h[maybe]), len(hashes) - 1)
            hit = hashes[at] == h[maybe]
            yield length, maybe[hit], ids[at[hit]]

    def cut(self, unit: str) -> list[str]:
        """A unit in parts between which no piece reaches, so that its paths are those of the parts one after another."""
        n = len(unit)
        codes = mix(np.frombuffer(unit.encode("utf-32-le"), np.uint32).astype(np.uint64) + _STEP)
        inside = np.zeros(n + 1, np.int64)  # pieces that begin to reach across a place, less those that no longer do
        for length, starts, _ in self._matches(codes, n - np.arange(n)):
            if length > 1:
                np.add.at(inside, starts + 1, 1)
                np.add.at(inside, starts + length, -1)
        at = [0, *np.flatnonzero(np.cumsum(inside)[1:n] == 0) + 1, n]
        return [unit[a:b] for a, b in zip(at, at[1:], strict=False)]

    def _put(self, name: str, at: int, new: np.ndarray) -> None:
        old = getattr(self, name)
        if at + len(new) > len(old):
            setattr(self, name, old := np.concatenate([old, np.zeros(max(len(old) // 2, at + len(new) - len(old)), old.dtype)]))
        old[at : at + len(new)] = new

    def numbers(self, units: Iterable[str], count: int) -> np.ndarray:
        """The numbers of `count` units; those that the bank lacks are added."""
        found = np.fromiter(map(self.index.__getitem__, units), np.int64, count)
        if len(self.index) > self.units:
            self._add(list(islice(self.index, self.units, None)))
        return found

    def _add(self, units: list[str]) -> None:
        """Adds the lattices of the units that were numbered last."""
        v = self.vocabulary
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        raw = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        codes = mix(raw.astype(np.uint64) + _STEP)
        n = len(codes)
        ends = np.repeat(np.cumsum(sizes), sizes)
        left = ends - np.arange(n)  # characters from here to the unit's end
        starts, lengths, pieces = [], [], []
        for length, found, ids in self._matches(codes, left):
            starts.append(found)
            lengths.append(np.full(len(found), length))
            pieces.append(ids)
            if length == 1:  # characters without a piece become bytes; several bytes are kept as the negative code point
                bare = np.setdiff1d(np.arange(n), found, assume_unique=True)
                starts.append(bare)
                lengths.append(np.ones(len(bare), np.int64))
                pieces.append(np.where(raw[bare] < 0x80, v.low_bytes[np.minimum(raw[bare], 0x7F)], -raw[bare].astype(np.int64) - 1))
        # edges by their start, the longest first: they tend to be the likeliest
        start = np.concatenate(starts[::-1])
        order = np.argsort(start, kind="stable")
        start, length, piece = start[order], np.concatenate(lengths[::-1])[order], np.concatenate(pieces[::-1])[order]
        weight = v.log_weight[np.maximum(piece, 0)]
        if len(bare := np.flatnonzero(piece < 0)):
            code = -piece[bare] - 1
            weight[bare] = (1 + (code > 0x7F).astype(int) + (code > 0x7FF) + (code > 0xFFFF)) * v.log_weight[0]
        # backward sums, from the end of every unit: nodes with the same number of characters left go together
        togo = left[start]
        togo = togo.astype(np.uint16) if togo.max() < 1 << 16 else togo
        order = np.argsort(togo, kind="stable")
        s, far = start[order], start[order] + length[order]
        weight = weight[order]
        inside = far < ends[s]
        far[~inside] = n
        back, total = np.zeros(n + 1), np.empty(len(s))
        bounds = np.flatnonzero(np.diff(togo[order].astype(np.int64), prepend=0))
        for a, b in zip(bounds.tolist(), [*bounds[1:].tolist(), len(s)], strict=True):
            total[a:b] = weight[a:b] + back[far[a:b]]
            heads = np.flatnonzero(np.diff(s[a:b], prepend=-1))
            back[s[a:b][heads]] = np.logaddexp.reduceat(total[a:b], heads)
        logp = np.empty(len(s))
        logp[order] = total - back[s]
        heads = np.bincount(start, minlength=n)
        heads = np.cumsum(heads) - heads
        p = np.exp(logp)
        cum = np.cumsum(p)
        cum -= np.repeat(cum[heads] - p[heads], np.diff(np.append(heads, len(start))))
        cum[np.append(heads[1:], len(start)) - 1] = 2.0  # the last edge of a node takes what rounding leaves
        for name, at, new in (
            ("first_node", self.units, np.cumsum(sizes) - sizes + self.nodes), ("size", self.units, sizes), ("first_edge", self.nodes, np.append(heads, len(start)) + self.edges),
            ("cum", self.edges, cum), ("logp", self.edges, logp), ("length", self.edges, length), ("piece", self.edges, piece),
        ):
            self._put(name, at, new)
        self.units, self.nodes, self.edges = self.units + len(units), self.nodes + n, self.edges + len(start)

    def draw(self, units: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A sampled path for each unit: edges in order, the number of edges of each unit, and log probabilities."""
        node = self.first_node[units]
        end = node + self.size[units]
        alive, steps = np.arange(len(units)), []
        counts, logp = np.zeros(len(units), np.int64), np.zeros(len(units))
        while len(alive):
            u = _uniform(keys + np.array([len(steps) + 1], np.uint64) * _STEP)
            e = self.first_edge[node]
            late = np.flatnonzero(u > self.cum[e])
            while len(late):
                e[late] += 1
                late = late[u[late] > self.cum[e[late]]]
            steps.append((alive, e))
            logp[alive] += self.logp[e]
            counts[alive] += 1
            node = node + self.length[e]
            on = np.flatnonzero(node < end)
            alive, keys, node, end = alive[on], keys[on], node[on], end[on]
        first = np.cumsum(counts) - counts
        edges = np.empty(int(counts.sum()), np.int64)
        for number, (owner, e) in enumerate(steps):
            edges[first[owner] + number] = e
        return edges, counts, logp

    def other_path(self, unit: int, excluded: set[tuple[int, ...]], key: int) -> tuple[tuple[int, ...], float]:
        """A path of the unit sampled from those that are not excluded; at least one is not.

        At each node an edge is drawn by its probability less that of the excluded paths through it.
        """
        base, size = int(self.first_node[unit]), int(self.size[unit])
        path, place, total = [], 0, 0.0
        taboo = [(x, math.exp(self.logp[list(x)].sum())) for x in excluded]  # with the probability from here on
        while place < size:
            a, b = int(self.first_edge[base + place]), int(self.first_edge[base + place + 1])
            logp = self.logp[a:b].tolist()
            depth = len(path)
            free = [max(0.0, math.exp(x) - sum(m for t, m in taboo if t[depth] == e)) for e, x in enumerate(logp, a)]
            # where rounding leaves nothing, the edges off the excluded paths remain
            if sum(free) <= 0.0:
                free = [0.0 if any(t[depth] == e for t, _ in taboo) else 1.0 for e in range(a, b)] if taboo else [1.0] * (b - a)
                free = free if sum(free) else [1.0] * (b - a)
            mark = ((_mixed((key + depth * 0x51ED2701) % (1 << 64)) >> 11) + 0.5) / 9007199254740992.0 * sum(free)
            e = a
            while mark > free[e - a] and e < b - 1:
                mark -= free[e - a]
                e += 1
            p = math.exp(logp[e - a])
            taboo = [(t, m / p) for t, m in taboo if t[depth] == e]
            path.append(e)
            total += logp[e - a]
            place += int(self.length[e])
        return tuple(path), total


def _truncated(location, u, bound):
    """Gumbel at `location` from uniform u, conditioned to lie below `bound`."""
    value = location - np.log(-np.log(u))
    return -np.logaddexp(-bound, -value)


class Search:
    """Best-first search over the segmentations of one text."""

    def __init__(self, bank: Bank, units: np.ndarray, key: int):
        self.bank, self.units, self.key = bank, units, key
        self.regions: list[dict] = []
        self.popped = 0

    def root(self, value: float, edges: np.ndarray, counts: np.ndarray, logp: np.ndarray) -> dict:
        return {"value": value, "edges": edges, "counts": counts, "logp": logp, "at": -1, "excluded": set(), "gone": 0.0}

    def best(self) -> tuple[float, int, int]:
        return max((float(r["values"][at := int(r["values"].argmax())]), i, at) for i, r in enumerate(self.regions))

    def pop(self, fresh: tuple[np.ndarray, np.ndarray, np.ndarray]) -> dict | None:
        """The next leaf; `fresh` are independent samples of all units, for the units behind the one that differs."""
        value, i, at = self.best()
        if value == -np.inf:
            return None
        region = self.regions[i]
        region["values"][at] = -np.inf
        leaf = region["leaf"]
        bounds = np.cumsum(leaf["counts"])
        own = tuple(leaf["edges"][bounds[at] - leaf["counts"][at] : bounds[at]].tolist())
        same = at == leaf["at"]
        excluded = set(region["excluded"]) if same else {own}
        gone = region["gone"] if same else float(np.exp(leaf["logp"][at]))
        path, path_logp = self.bank.other_path(int(self.units[at]), excluded, _mixed((self.key + 7919 * (self.popped + 3)) % (1 << 64)))
        new_edges, new_counts, new_logp = fresh
        tail = int(new_counts[: at + 1].sum())
        return {
            "value": value,
            "edges": np.concatenate([leaf["edges"][: bounds[at] - leaf["counts"][at]], np.array(path, np.int64), new_edges[tail:]]),
            "counts": np.concatenate([leaf["counts"][:at], [len(path)], new_counts[at + 1 :]]),
            "logp": np.concatenate([leaf["logp"][:at], [path_logp], new_logp[at + 1 :]]),
            "at": at, "excluded": excluded, "gone": gone,
        }


def split(searches: list[Search], leaves: list[dict]) -> None:
    """Adds to every search what is left of its leaf's region once the leaf is out."""
    sizes = np.array([len(x["logp"]) for x in leaves])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    logp, ahead = np.concatenate([x["logp"] for x in leaves]), np.zeros(int(ends[-1]))
    for leaf, a, b in zip(leaves, starts.tolist(), ends.tolist(), strict=True):
        np.cumsum(leaf["logp"][:-1], out=ahead[a + 1 : b])
    place = np.arange(len(logp)) - np.repeat(starts, sizes)
    for search in searches:
        search.popped += 1
    key = mix(np.array([(s.key + (1000 * s.popped + 2) * 0x9E3779B97F4A7C15) % (1 << 64) for s in searches], np.uint64))
    u = _uniform(np.repeat(key, sizes) + place.astype(np.uint64) * _STEP)
    ok = np.flatnonzero((logp < -1e-13) & (place > np.repeat([x["at"] for x in leaves], sizes)))
    values = np.full(len(logp), -np.inf)
    with np.errstate(divide="ignore"):
        values[ok] = _truncated(ahead[ok] + np.log(-np.expm1(logp[ok])), u[ok], np.repeat([x["value"] for x in leaves], sizes)[ok])
    for search, leaf, a, b in zip(searches, leaves, starts.tolist(), ends.tolist(), strict=True):
        at, excluded, gone = leaf["at"], leaf["excluded"], leaf["gone"]
        if at >= 0:  # the same unit, with one path less
            first = int(leaf["counts"][:at].sum())
            excluded = excluded | {tuple(leaf["edges"][first : first + leaf["counts"][at]].tolist())}
            gone += math.exp(logp[a + at])
            if gone < 1 - 1e-12:
                values[a + at] = _truncated(ahead[a + at] + np.log1p(-gone), u[a + at], leaf["value"])
        search.regions.append({"values": values[a:b], "leaf": leaf, "excluded": excluded, "gone": gone})


def piece_ids(bank: Bank, edges: np.ndarray) -> np.ndarray:
    """Vocabulary ids of edges, with byte pieces for characters outside the vocabulary."""
    ids = bank.piece[edges]
    bare = np.flatnonzero(ids < 0)
    if len(bare):
        table = bank.vocabulary.byte_ids
        parts = [[table[b] for b in chr(-i - 1).encode()] for i in ids[bare].tolist()]
        sizes = np.ones(len(ids), np.int64)
        sizes[bare] = [len(x) for x in parts]
        at = (np.cumsum(sizes) - sizes)[bare]
        ids = np.repeat(ids, sizes)
        ids[np.concatenate([np.arange(i, i + len(x)) for i, x in zip(at.tolist(), parts, strict=True)])] = np.concatenate(parts)
    return ids.astype("<u4")


@lru_cache(maxsize=1)
def vocabulary(model: str, theta: float) -> Vocabulary:
    return Vocabulary(model, theta)


_banks: dict[tuple[str, float], Bank] = {}


def sample_texts(texts: list[str], keys: np.ndarray, model: str, theta: float, k: int) -> list[list[tuple[bytes, float, float, float]]]:
    """For each text up to k tuples (ids, log probability, perturbed value, inclusion score), in falling order."""
    bank = _banks.get((model, theta))
    if bank is None:
        _banks[model, theta] = bank = Bank(vocabulary(model, theta))
    if len(bank.index) > CACHE_UNITS or bank.edges > CACHE_EDGES:
        bank.clear()
    parts = [_units(t) if t else [] for t in texts]
    for units_of in parts:
        if units_of and max(map(len, units_of)) > LONG:
            units_of[:] = chain.from_iterable(bank.cut(u) if len(u) > LONG else (u,) for u in units_of)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    units = bank.numbers(chain.from_iterable(parts), int(sizes.sum()))
    ends = np.cumsum(sizes)
    place = np.arange(len(units)) - np.repeat(ends - sizes, sizes)
    own = mix(np.repeat(keys, sizes) + place.astype(np.uint64) * _STEP)
    fresh = []
    for r in range(k):
        edges, counts, logp = bank.draw(units, mix(own + np.uint64(r)))
        fresh.append((edges, np.concatenate([[0], np.cumsum(counts)]), counts, logp))
    spans = {d: (int(end - size), int(end)) for d, (size, end) in enumerate(zip(sizes, ends, strict=True)) if size}
    drawn = lambda d, r: (fresh[r][0][fresh[r][1][spans[d][0]] : fresh[r][1][spans[d][1]]], *(x[slice(*spans[d])] for x in fresh[r][2:]))
    roots = -np.log(-np.log(_uniform(mix(keys + _STEP))))
    searches = {d: Search(bank, units[a:b], int(keys[d])) for d, (a, b) in spans.items()}
    leaves = {d: search.root(float(roots[d]), *drawn(d, 0)) for d, search in searches.items()}
    found: list[list[dict]] = [[] for _ in texts]
    for number in range(1, k + 1):
        if not leaves:
            break
        split([searches[d] for d in leaves], list(leaves.values()))
        for d, leaf in leaves.items():
            found[d].append(leaf)
        if number < k:
            leaves = {d: leaf for d in leaves if (leaf := searches[d].pop(drawn(d, number))) is not None}
    out = []
    for d, leaves_of in enumerate(found):
        kappa = searches[d].best()[0] if len(leaves_of) == k else -np.inf
        rows = []
        for leaf in leaves_of:
            logp = float(leaf["logp"].sum())
            rows.append((piece_ids(bank, leaf["edges"]).tobytes(), logp, leaf["value"], 1.0 if kappa == -np.inf else float(-np.expm1(-np.exp(min(logp - kappa, 50.0))))))
        out.append(rows)
    return out


def decode(ids, model: str) -> str:
    """The text of ids."""
    return vocabulary(model, 1.0).processor.decode([int(i) for i in ids])


def _decoded(rows: Iterable[bytes | None], model: str) -> list[str | None]:
    processor = vocabulary(model, 1.0).processor
    return [None if x is None else processor.decode(np.frombuffer(x, "<u4").tolist()) if x else "" for x in rows]


def decode_rows(rows: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """Rows with their ids (little-endian unsigned 32-bit integers) replaced by `text`; null ids give a null text."""
    at, kept = rows.columns.index(ids), [f for f in rows.schema.fields if f.name not in (ids, "text")]
    places, names = [rows.columns.index(f.name) for f in kept], [*(f.name for f in kept), "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at, 256):
                yield pa.RecordBatch.from_arrays([*map(part.column, places), pa.array(_decoded(part.column(at).to_pylist(), model), pa.string())], names)

    return rows.mapInArrow(run, T.StructType([*kept, T.StructField("text", T.StringType())]))


def sample_segmentations(docs: DataFrame, model: str, k: int = 2, theta: float = 1.0, seed: int = 0, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """Up to k distinct sampled segmentations (SCHEMA) of every text; ids are little-endian unsigned 32-bit integers.

    With `decoded`, a column `text` holds what the ids of a row decode to.
    """
    fields = pa.schema([("doc_id", pa.int64()), ("sample", pa.int32()), ("ids", pa.binary()), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("inclusion", pa.float64())])
    if decoded:
        fields = fields.append(pa.field("text", pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 256, 1 << 20):
                ids = part.column(0).to_pylist()
                keys = mix(part.column(2).to_numpy().view(np.uint64))
                rows = []
                for doc_id, found in zip(ids, sample_texts(part.column(1).to_pylist(), keys, model, theta, k), strict=True):
                    rows += [(doc_id, number, *f) for number, f in enumerate(found, 1)]
                if rows:
                    columns = list(zip(*rows, strict=True))
                    if decoded:
                        columns.append(_decoded(columns[2], model))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, fields.types, strict=True)], schema=fields)

    keyed = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.xxhash64(F.lit(seed), F.col(key)).alias("key"))
    return keyed.mapInArrow(run, f"{SCHEMA}, text string" if decoded else SCHEMA)
