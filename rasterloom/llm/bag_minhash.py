"""Near duplicates by BagMinHash: weighted-Jaccard signatures of word shingles, bands, and verified multiset overlap.

Signature.  A text is the multiset of its five-word shingles.  For every shingle the weight axis is cut into dyadic
blocks [0,1), [1,2), [2,4), ...; each block carries a Poisson process whose points have a time, a slot of the signature
and a place in the block.  The place is read bit by bit down the block's dyadic tree, and a point counts if it lies
below the shingle's weight, so processes of equal shingles share all points below the smaller weight.  The least time
of each slot is the signature, and two slots agree with the probability of the weighted Jaccard similarity.  Times are
generated only up to the horizon at which all slots are filled, so the work is near linear in the text and not in text
times slots.

Links.  Texts that share a band's key meet in a bucket.  The bucket's most central member (the one whose buckets are the
largest) leads: every member is compared with the leader exactly, on the whole multisets.  Verified links make components,
and a bucket whose members lie in one component is settled.  What is left in small buckets is compared pair by pair.  In
larger ones edits keep the comparisons few.  Let C be the leader with every edit that more than half of the members share,
D(x) the symmetric difference of x and C, and q(x) = 9 |D(x)| - |x|.  Two texts reach the similarity 0.8 if and only if

    18 |D(x) & D(y)| >= q(x) + q(y).

The member l of least q is compared with all others.  For an x without a link to l the right side is above
q(y) - q(l) >= 0, so x links only to texts that share edits with it, at least (q(x) + q(y)) / 18 of them.  First x is
compared with the member of least q for each of its edits.  Whoever is then still outside the component of l looks for
the rest: y is listed under the rarest of its edits only, as many as leave fewer than x would need, in a list for each
range of q(x), and x looks under the rarest of its own.  Every pair that shares a bucket is thus compared, ruled out, or
already connected: no bucket is capped, and copies with edits of their own never meet pair by pair.

Identical texts (by a 64-bit hash) are one node from the start.  Every stage ends in a written table.

Defined results: null, empty and blank texts have no shingles and are linked to identical texts only; a text of fewer
than five words has one shingle, of all its words; rows with a null id take part but never name a class, so a class of
null ids has a null class_id; repeated rows are copies; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from rasterloom.llm.common import CACHE_CHARS, discard, materialise, slices

SHINGLE, SIMILARITY = 5, 0.8
#: At a similarity of 0.8, 20 bands of 4 slots miss one pair in 37,000.
BANDS, ROWS = 20, 4
#: Buckets of up to so many members are compared pair by pair.
SMALL = 12
#: Edits that a lot of a star holds on average, rows of a lot that one task looks up, entries folded at once.
LOT, SPREAD, FOLD = 8192, 2048, 1 << 20
#: Rows of a star's own columns, to be met by its members.
SALTS = 8
#: Champions that a text outside the main component is compared with first.
CHAMPIONS = 2
CACHE_WORDS = 150_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Multisets of shingles as sorted 64-bit hashes with counts; word hashes are kept between texts."""

    def __init__(self):
        self.words: dict[str, int] = {}
        self.chars = 0

    def bag(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        if len(self.words) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self.words, self.chars = {}, 0
        known = self.words
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
                self.chars += len(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = max(1, len(h) - SHINGLE + 1) if len(h) else 0
        total = np.zeros(n, np.uint64)
        for k in range(min(SHINGLE, len(h))):
            total = total * _A + h[k : k + n]
        return np.unique(mix(total), return_counts=True)


@lru_cache(maxsize=1)
def shingler() -> Shingler:
    return Shingler()


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], slots: int = BANDS * ROWS) -> np.ndarray:
    """Times of the first point in each slot, a row for each bag; bags must not be empty."""
    doc = np.repeat(np.arange(len(bags)), [len(h) for h, _ in bags])
    shingle, weight = np.concatenate([h for h, _ in bags]), np.concatenate([c for _, c in bags])
    total = np.array([c.sum() for _, c in bags], float)
    # block 0 is [0,1), block j is [2**(j-1), 2**j): as many as reach below the weight
    blocks = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 2))).astype(np.int64) + 1, 1)
    doc, shingle, weight = np.repeat(doc, blocks), np.repeat(shingle, blocks), np.repeat(weight, blocks)
    block = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    low = np.where(block > 0, 1 << np.maximum(block - 1, 0), 0)
    width = np.maximum(low, 1)
    key = mix(shingle + block.astype(np.uint64) * _A)
    times = _gap(key, 0) / width
    horizon = slots * (np.log(slots) + 2.0) / total
    out = np.full(len(bags) * slots, np.inf)
    count = 0
    alive = np.arange(len(key))
    step = np.zeros(len(key), np.uint64)
    while True:
        alive = alive[times[alive] <= horizon[doc[alive]]]
        while len(alive):
            k, d = key[alive], doc[alive]
            draw = mix(k + (step[alive] * np.uint64(2) + np.uint64(1)) * _C)
            place = low[alive] + ((draw >> np.uint64(20)) & (width[alive] - 1).astype(np.uint64)).astype(np.int64)
            slot = ((draw & np.uint64(0xFFFFF)) * np.uint64(slots) >> np.uint64(20)).astype(np.int64)
            inside = place < weight[alive]
            np.minimum.at(out, (d * slots + slot)[inside], times[alive][inside])
            step[alive] += np.uint64(1)
            times[alive] += _gap(k, step[alive]) / width[alive]
            alive = alive[times[alive] <= horizon[d]]
            count += 1
        open_ = np.isinf(out.reshape(-1, slots)).any(axis=1)
        if not open_.any():
            return out.reshape(-1, slots)
        horizon = np.where(open_, horizon * 2, horizon)
        alive = np.flatnonzero(open_[doc])


def _gap(key: np.ndarray, step) -> np.ndarray:
    """Exponential gaps of rate one from the hash of a process and the number of a point."""
    bits = mix(key + (np.asarray(step, np.uint64) * np.uint64(2)) * _C) >> np.uint64(11)
    return -np.log((bits.astype(float) + 0.5) / 9007199254740992.0)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    bits = signature.view(np.uint64).reshape(len(signature), BANDS, ROWS)
    key = np.tile(np.arange(BANDS, dtype=np.uint64), (len(signature), 1))
    for r in range(ROWS):
        key = mix(key * _A + bits[:, :, r])
    return key.view(np.int64)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both)) if both else 0.0


def with_node(docs: DataFrame) -> DataFrame:
    """doc_id, text and node, the hash of the text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("node", F.xxhash64("text"))


def banded(nodes: DataFrame) -> DataFrame:
    """(doc_id, node, keys) for rows (doc_id, node, text); no keys for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shingler()
        for batch in batches:
            for part in slices(batch, 2, 64):
                bags = [own.bag(t) for t in part.column(2).to_pylist()]
                full = [i for i, b in enumerate(bags) if len(b[0])]
                keys: list = [[]] * len(bags)
                if full:
                    for i, row in zip(full, band_keys(signatures([bags[i] for i in full])), strict=True):
                        keys[i] = row
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "node", "keys"])

    return nodes.select("doc_id", "node", "text").mapInArrow(run, "doc_id long, node long, keys array<long>")


def edits(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The symmetric difference of multisets a and b, as hashes of (element, side, number of the copy)."""
    every = np.union1d(a[0], b[0])
    count = np.zeros((2, len(every)), np.int64)
    for side, (h, c) in enumerate((a, b)):
        count[side, np.searchsorted(every, h)] = c
    gap = count[0] - count[1]
    times = np.abs(gap)
    element = np.repeat(mix(every + (gap > 0).astype(np.uint64) * _A), times)
    copy = np.arange(len(element)) - np.repeat(np.cumsum(times) - times, times)
    return mix(element + copy.astype(np.uint64) * _C).view(np.int64)


def compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, linked, size_a, size_b, edits) for pairs (a, b, wide); edits only where wide.  b may be frequent."""
    mine = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = mine.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, kept = shingler(), OrderedDict()
        names = ["a", "b", "linked", "size_a", "size_b", "edits"]
        types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                found = []
                for a, b, wide, x, y in zip(*[c.to_pylist() for c in batch.slice(k, 256).columns], strict=True):
                    if b not in kept:
                        kept[b] = own.bag(y)
                        if len(kept) > 64:
                            kept.popitem(last=False)
                    bag, lead = own.bag(x), kept[b]
                    found.append((a, b, overlap(bag, lead) >= SIMILARITY, int(bag[1].sum()), int(lead[1].sum()), edits(bag, lead) if wide else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)

    return both.select("a", "b", "wide", "text_a", "text_b").mapInArrow(run, "a long, b long, linked boolean, size_a long, size_b long, edits array<long>")


_LOTS = "b long, lot long, edits array<long>, times array<long>, low array<long>, high array<long>, open array<long>, q array<long>, best array<long>"


def _lists(lengths: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values, pa.int64()))


def _flat(batch: pa.RecordBatch, lists: str, *others: str) -> list[np.ndarray]:
    """The values of a list column, and other columns repeated for each of them."""
    column = batch.column(lists)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    return [column.flatten().to_numpy(), *[np.repeat(batch.column(o).to_numpy(zero_copy_only=False).astype(np.int64), lengths) for o in others]]


def _lot_of(edit: np.ndarray, lots: np.ndarray) -> np.ndarray:
    return (edit.view(np.uint64) % lots.astype(np.uint64)).astype(np.int64)


def _folded(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Columns b, lot, edit, times, low, high, open, q, best with one entry for each edit of a star, in order."""
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    b, lot, edit, _, _, _, _, q, best = columns
    order = np.lexsort((best, q, edit, lot, b))
    b, lot, edit, times, low, high, open_, q, best = (c[order] for c in columns)
    new = np.flatnonzero(np.concatenate([[True], (edit[1:] != edit[:-1]) | (b[1:] != b[:-1])]))
    return [b[new], lot[new], edit[new], np.add.reduceat(times, new), np.minimum.reduceat(low, new), np.maximum.reduceat(high, new), np.maximum.reduceat(open_, new), q[new], best[new]]


def _lot_rows(folded: list[np.ndarray]) -> pa.RecordBatch:
    b, lot = folded[:2]
    new = np.flatnonzero(np.concatenate([[True], (lot[1:] != lot[:-1]) | (b[1:] != b[:-1])]))
    lengths = np.diff(np.append(new, len(b)))
    names = [x.split()[0] for x in _LOTS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(b[new]), pa.array(lot[new]), *[_lists(lengths, c) for c in folded[2:]]], names)


def tally(members: DataFrame) -> DataFrame:
    """What a star's members have in common, by edit: rows (_LOTS) that each list the edits of one lot of a star.

    Members are rows (b, a, q, lots, label, out, edits).  For every edit: how many members have it, their least and
    greatest label, whether one of them is out, and the member of least q among them.  Edits of a star are dealt into
    `lots` by their value and counted before they are shuffled; a task holds the distinct edits of one lot at a time.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            edit, b, a, q, lots, label, out = _flat(batch, "edits", "b", "a", "q", "lots", "label", "out")
            held.append([b, _lot_of(edit, lots), edit, np.ones(len(edit), np.int64), label, label, out, q, a])
            size += len(edit)
            if size > FOLD:
                yield _lot_rows(_folded(held))
                held, size = [], 0
        if size:
            yield _lot_rows(_folded(held))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            edit, b, lot = _flat(batch, "edits", "b", "lot")
            held.append([b, lot, edit, *[batch.column(c).flatten().to_numpy() for c in ("times", "low", "high", "open", "q", "best")]])
            size += len(edit)
            if size > FOLD:  # the last lot may go on in the next batch
                folded = _folded(held)
                last = (folded[0] == b[-1]) & (folded[1] == lot[-1]) if len(b) else np.zeros(len(folded[0]), bool)
                if not last.all():
                    yield _lot_rows([c[~last] for c in folded])
                held = [[c[last] for c in folded]]
                size = int(last.sum())
        if size:
            yield _lot_rows(_folded(held))

    counted = members.select("b", "a", "q", "lots", "label", F.col("out").cast("long").alias("out"), "edits").mapInArrow(count, _LOTS)
    return counted.repartition("b", "lot").sortWithinPartitions("b", "lot").mapInArrow(merge, _LOTS)


def dealt(members: DataFrame) -> DataFrame:
    """(b, lot, a, edits): the edits of each member by lots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.append_column("row", pa.array(np.arange(batch.num_rows)))
            edit, b, a, lots, row = _flat(batch, "edits", "b", "a", "lots", "row")
            if not len(edit):
                continue
            lot = _lot_of(edit, lots)
            order = np.lexsort((edit, lot, row))
            edit, b, a, lot, row = edit[order], b[order], a[order], lot[order], row[order]
            new = np.flatnonzero(np.concatenate([[True], (lot[1:] != lot[:-1]) | (row[1:] != row[:-1])]))
            yield pa.RecordBatch.from_arrays([pa.array(b[new]), pa.array(lot[new]), pa.array(a[new]), _lists(np.diff(np.append(new, len(edit))), edit)], ["b", "lot", "a", "edits"])

    return members.select("b", "a", "lots", "edits").mapInArrow(run, "b long, lot long, a long, edits array<long>")


def looked_up(members: DataFrame, lots: DataFrame, value: str, keep) -> DataFrame:
    """(b, a, found): for each member its edits that a lot keeps, as structs (value, edit) in order.

    `lots` comes from tally, `value` is one of its lists, and keep(entry) tells by the lists of an edit whether it counts.
    Lots that many members touch are looked up by several tasks.
    """
    kept = lots.select("b", "lot", F.aggregate("times", F.lit(0).cast("long"), lambda x, y: x + y).alias("rows"), F.filter(F.arrays_zip("edits", "times", "low", "high", "open", "best"), keep).alias("z")).where(F.size("z") > 0)
    listed = materialise(kept.select("b", "lot", F.ceil(F.col("rows") / SPREAD).alias("parts"), F.transform("z", lambda z: z["edits"]).alias("edits"), F.transform("z", lambda z: z[value]).alias("values")), "lots")
    parts = listed.where("parts > 1").select("b", "lot", "parts")
    table = listed.select("b", "lot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).cast("long").alias("a"), "edits", "values")
    asking = dealt(members).join(parts, ["b", "lot"], "left").select("b", "lot", F.coalesce(F.pmod(F.xxhash64("a"), "parts"), F.lit(0)).alias("part"), "a", "edits", F.lit(None).cast("array<long>").alias("values"))
    both = table.union(asking).repartition("b", "lot", "part").sortWithinPartitions("b", "lot", "part", F.col("values").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known, values = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            found = []
            for b, lot, part, a, own, given in zip(*[batch.column(c).to_numpy(zero_copy_only=False) if c in ("edits", "values") else batch.column(c).to_pylist() for c in ("b", "lot", "part", "a", "edits", "values")], strict=True):
                if given is not None:
                    at, known, values = (b, lot, part), own, given
                elif at == (b, lot, part):
                    place = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    hit = known[place] == own
                    if hit.any():
                        found.append((b, a, own[hit], values[place[hit]]))
            if found:
                lengths = [len(f[2]) for f in found]
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found]), pa.array([f[1] for f in found]), _lists(lengths, np.concatenate([f[2] for f in found])), _lists(lengths, np.concatenate([f[3] for f in found]))], ["b", "a", "edit", "value"])

    hits = both.mapInArrow(run, "b long, a long, edit array<long>, value array<long>")
    return hits.groupBy("b", "a").agg(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("value", "edit")))).alias("found"))


def _with_star(members: DataFrame, stars: DataFrame, how: str = "inner", key: str = "b", member: str = "a") -> DataFrame:
    """Members with the columns of their star: a row for each key, laid out SALTS times so that no task gets a whole star."""
    salted = stars.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return members.withColumn("salt", F.pmod(F.xxhash64(member), F.lit(SALTS))).join(salted, [key, "salt"], how).drop("salt")


def centred(stars: DataFrame) -> DataFrame:
    """(b, a, size, lots, q, edits) of the members a of each leader b, with edits against the members' centre."""
    sizes = stars.groupBy("b").agg(F.count("*").alias("n"), F.ceil(F.greatest(F.sum(F.size("edits")), F.lit(1)) / LOT).alias("lots"))
    raw = materialise(_with_star(stars.select("b", "a", F.col("size_a").alias("size"), "edits"), sizes), "raw")
    zero = F.lit(0).cast("long")
    counts = tally(raw.select("b", "a", zero.alias("q"), "lots", zero.alias("label"), zero.alias("out"), "edits")).join(raw.groupBy("b").agg(F.first("n").alias("n")), "b")
    frequent = counts.select("b", F.transform(F.filter(F.arrays_zip("edits", "times"), lambda z: 2 * z["times"] > F.col("n")), lambda z: z["edits"]).alias("often"))
    usual = frequent.where(F.size("often") > 0).groupBy("b").agg(F.flatten(F.collect_list("often")).alias("usual"))
    z = F.coalesce("usual", F.array().cast("array<long>"))
    own = F.concat(F.array_except("edits", z), F.array_except(z, "edits"))
    moved = _with_star(raw, usual, "left").select("b", "a", "size", "lots", own.alias("edits"))
    return moved.withColumn("q", 9 * F.size("edits").cast("long") - F.col("size"))


def _linked(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Of the pairs (b, a, m) in stars of b those that reach the similarity, compared by their edits."""
    one = members.select("b", "a", F.col("q").alias("q_a"), F.col("edits").alias("d_a"))
    two = members.select("b", F.col("a").alias("m"), F.col("q").alias("q_m"), F.col("edits").alias("d_m"))
    met = pairs.join(one, ["b", "a"]).join(two, ["b", "m"])
    return met.where(18 * F.size(F.array_intersect("d_a", "d_m")) >= F.col("q_a") + F.col("q_m")).select("a", F.col("m").alias("b"))


def _unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of stars that still have members outside the component of the member l of least q.

    Adds label, out (whether outside), l and q_l.  Members inside stay only if one outside might be linked to them: for
    that their edits must suffice for the least q outside.
    """
    named = members.join(labels.select(F.col("node").alias("a"), "label"), "a", "left").withColumn("label", F.coalesce("label", "a"))
    nearest = named.groupBy("b").agg(F.min(F.struct("q", "a", "label")).alias("l"))
    told = _with_star(named, nearest).withColumn("out", F.col("label") != F.col("l.label"))
    least = told.where("out").groupBy("b").agg(F.min("q").alias("q_out"))
    open_ = _with_star(told, least).where(F.col("out") | (9 * F.size("edits") + F.col("size") >= F.col("q_out")))
    return open_.select("b", "a", "size", "q", "lots", "label", "out", F.col("l.a").alias("l"), F.col("l.q").alias("q_l"), "edits")


def _band(need: Column) -> Column:
    """Half octaves of the edits that a text must share with the nearest member."""
    return F.floor(F.log2(F.greatest(need, F.lit(0.0)) + 1) * 2).cast("int")


def by_edits(stars: DataFrame, links: DataFrame, labels: DataFrame) -> DataFrame:
    """More links (a, b), between members of one leader's star.

    `stars` has the compared pairs (a member, b leader) with their edits; `links` are the links known so far, and `labels`
    components of them.
    """
    members = materialise(centred(stars), "members")
    todo = materialise(_unsettled(members, labels), "unsettled")
    if todo.isEmpty():
        return links.limit(0)
    # members of least q for some edit of x; x tries those that come up most often, and l
    votes = looked_up(todo.where("out"), tally(todo), "best", lambda z: z["times"] > 1).select("b", "a", F.transform("found", lambda z: z["value"]).alias("v"))
    often = F.slice(F.array_sort(F.transform(F.array_distinct("v"), lambda m: F.struct((-F.size(F.filter("v", lambda x: x == m))).alias("n"), m.alias("m")))), 1, CHAMPIONS)
    tries = votes.select("b", "a", F.explode(F.transform(often, lambda x: x["m"])).alias("m")).union(todo.where("out").select("b", "a", "l"))
    near = materialise(_linked(tries.where("a != m").distinct(), members), "near")
    if not near.isEmpty():
        # whoever is linked now takes a label of those it is linked to, which belong to its component as well
        named = near.join(labels.select(F.col("node").alias("b"), "label"), "b", "left").select(F.col("a").alias("node"), F.coalesce("label", "b").alias("label"))
        labels = named.union(labels.join(named, "node", "left_anti").select("node", "label")).groupBy("node").agg(F.min("label").alias("label"))
        todo = materialise(_unsettled(members, labels), "unsettled")
    # an edit matters if a member outside and a member of another component have it
    useful = looked_up(todo, tally(todo), "times", lambda z: (z["low"] != z["high"]) & (z["open"] == 1))
    ranked = materialise(todo.select("b", "a", "label", "q", "q_l", "out", ((F.col("q") + F.col("q_l")) / 18).alias("need")).join(useful, ["b", "a"]), "useful")
    reach = lambda need: F.slice("found", 1, F.greatest(F.size("found") - F.greatest(F.ceil(need), F.lit(1)) + 1, F.lit(0)).cast("int"))
    asking = ranked.where("out").select("b", F.explode(F.transform(reach(F.col("need")), lambda z: z["edit"])).alias("edit"), "a", "label", _band(F.col("need")).alias("band"))
    bands = ranked.where("out").select("b", _band(F.col("need")).alias("band")).distinct().withColumn("least", F.pow(F.lit(2.0), F.col("band") / 2) - 1 - 1e-9)
    # an x of this band has need >= least, so x and y share at least least + (q(y) - q(l)) / 18 edits
    above = _with_star(ranked, bands).select("b", "band", "a", "label", reach(F.col("least") + (F.col("q") - F.col("q_l")) / 18 - 1e-9).alias("prefix"))
    shown = above.select("b", "band", F.explode(F.transform("prefix", lambda z: z["edit"])).alias("edit"), F.col("a").alias("m"), F.col("label").alias("label_m"))
    met = asking.join(shown, ["b", "band", "edit"]).where("label != label_m").select("b", "a", "m").distinct()
    return near.union(materialise(_linked(met, members), "late"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of undirected edges (a, b); the label is the component's least node.

    Alternates large-star and small-star steps; each step shuffles the edges once and ends in a written table, whose
    number and hash of edges are observed while it is written.
    """
    stars = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    written = mark = None
    while True:
        both = stars.union(stars.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        seen = Observation()
        stars = materialise(small.observe(seen, F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")), "stars")
        discard(written)
        written, now = stars, seen.get
        if now == mark:
            roots = stars.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            return materialise(stars.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots).groupBy("node").agg(F.min("label").alias("label")), "labels")
        mark = now


def link_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, node) of all documents, and (node, label) for nodes that have links to other nodes."""
    nodes = with_node(docs)
    rows = materialise(banded(nodes), "bands")
    keyed = rows.where(F.size("keys") > 0).groupBy("node").agg(F.first("keys").alias("keys")).select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    buckets = materialise(keyed.join(shared, "key").select("key", "node", "n"), "buckets")
    weight = materialise(buckets.groupBy("node").agg(F.sum("n").alias("weight")), "weights")
    texts = materialise(nodes.select("node", "text").join(weight, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")), "texts")
    lead = buckets.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", "node"))["node"].alias("lead"))
    led = materialise(buckets.join(lead, "key"), "led")
    pairs = led.where("node != lead").groupBy(F.col("node").alias("a"), F.col("lead").alias("b")).agg(F.max(F.col("n") > SMALL).alias("wide"))
    stars = materialise(compared(pairs, texts), "stars")
    labels = components(stars.where("linked").select("a", "b"))
    left = led.where("node != lead").join(labels, "node", "left").select("key", "node", "n", "lead", F.coalesce("label", "node").alias("label"))
    unsettled = left.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("key")
    left = materialise(_with_star(left, unsettled, key="key", member="node"), "unsettled")
    small = left.where(F.col("n") <= SMALL).select("key", "node", "label")
    other = small.select("key", F.col("node").alias("b"), F.col("label").alias("label_b"))
    rest = small.join(other, "key").where("node < b AND label != label_b").select(F.col("node").alias("a"), "b").distinct()
    found = materialise(compared(rest.withColumn("wide", F.lit(False)), texts).where("linked").select("a", "b"), "found")
    wide = left.where(F.col("n") > SMALL).select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct()
    known = labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(found)
    met = by_edits(_with_star(stars.where(F.col("edits").isNotNull()), wide.select("b").distinct()), known, labels)
    return rows.select("doc_id", "node"), components(known.union(met))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id) for every row: the least id of all documents that verified links or equal texts connect."""
    rows, labels = link_classes(docs)
    return rows.join(_named(rows, labels), "node", "left").select("doc_id", "class_id")


def _named(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, label, class_id) for every node."""
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("least"))
    known = nodes.join(labels, "node", "left").select("node", "least", F.coalesce("label", "node").alias("label"))
    return known.join(known.groupBy("label").agg(F.min("least").alias("class_id")), "label").select("node", "label", "class_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs without all but one of each class: the one with the least id, one of them if ids repeat."""
    rows, labels = link_classes(docs)
    named = _named(rows, labels)
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("node"))
    first = boxed.join(named, "node").where(F.col("row.doc_id").eqNullSafe(F.col("class_id")))
    return first.dropDuplicates(["label"]).select("row.*")
