"""Toxicity: a Levenshtein automaton intersected with a lexicon trie, and context windows around its hits.

The lexicon holds whole words and stems (a stem matches every word that it begins).  It is learned from labelled rows:
terms whose document frequency is far higher among toxic texts.  A word is run through the trie and the automaton at
once; states are sets of (trie node, edits, awaited letter), made when first reached.  An edit is a letter that is
missing, too many or another one, or two neighbours that changed places, the first letter included.  Terms of five
letters or more allow one edit, of eight or more two, and words of four one that keeps their length.  Signs at the ends
of a word are tried as letters, too.  Only terms that enough toxic texts hold, and whose near hits unseen clean texts
hardly have, allow edits, and words that clean training texts use are never near misses.  Each hit gets the log odds of
its term, a near hit NEAR_SHARE of it; hits between quotation marks or after a reporting word are summed apart from the
rest, and a small logistic regression over those sums gives the score.

The fit uses at most `max_rows` labelled rows (of each label those with the smallest hash of their id) and `max_bytes` of their text, in
one task, and keeps at most `most_terms` terms (2,000), the weightiest; everything else runs on every row where it lies.

Defined results: a null text counts as empty, and an empty text gets the score of a text without hits; rows with a null
id are scored but never learned from; labels that are null are left out; repeated labels of an id count once, with the
larger label; labels other than 0 and 1 are left out; without labels of both kinds a fixed lexicon and fixed coefficients serve; repeated rows get equal scores;
an empty table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import CACHE_CHARS, slices

#: Insults that serve where no labels are given.
SEED_TERMS = "idiot moron stupid loser scum trash worthless pathetic disgusting clown".split()
#: Usual words that are near those insults.
ORDINARY = frozenset(
    "crown crowns crowned clone cloned crash crashed thrash brash track tracks trace lower lowers closer loner loser's laser lasers loses loose looser lose poser user "
    "slum sum scam spam swum scrum strum sculpt maroon boron moon motor micron stud stupor pathetically".split()
)
#: Words that report what others say.
REPORTING = frozenset("said says wrote quoted quote called asked sagte schrieb sagt zitat dit écrit cite dijo escribió cita".split())
OPENING, CLOSING = '"“«„‘', '"”»“’'
MASKS = "*%&$#|!+~_=/-"
STRIP = " \t.,;:!?|*%&$#()[]{}<>\"'“”«»„‘’-_~=+/\\"
PUNCTUATION = "".join(c for c in STRIP if c not in MASKS)

WINDOW = 6
STEM_LOW, STEM_HIGH, EDIT_FROM, TWO_FROM = 3, 9, 5, 8
MOST_STATES = 20_000
WIDE = True
#: What a near hit counts of its term's log odds.
NEAR_SHARE = 0.75
#: A term allows edits if so large a share of the toxic texts hold it, and near hits on it are in no larger a share of clean ones.
NEAR_SUPPORT, NEAR_CLEAN = 0.03, 0.002
CACHE_WORDS = 300_000
#: Coefficients that serve without labels: constant, strongest hit, plain, quoted and near hits, density.
DEFAULT = np.array([-4.0, 0.8, 0.8, 0.1, 0.3, 0.0])


class Matcher:
    """The trie of a lexicon {term: log odds}; a stem is written with a star at its end.

    Terms in `exact_only` allow no edits.  Without `wide`, the narrower rule holds: the first letters agree, and terms of
    EDIT_FROM letters or more allow one edit, where a transposition counts as two.
    """

    def __init__(self, lexicon: dict[str, float], clean: frozenset[str] = frozenset(), exact_only: frozenset[str] = frozenset(), wide: bool = False):
        self.lexicon, self.clean, self.wide = lexicon, clean, wide
        self.root: dict = {}
        # the trie of terms that allow edits: children, ends of stems and words, most edits of any term below
        self.below: list[dict[str, int]] = [{}]
        self.ends: list[dict[bool, tuple[str, int]]] = [{}]
        self.reach = [0]
        for term in lexicon:
            body, stem = term.rstrip("*"), term.endswith("*")
            node = self.root
            for c in body:
                node = node.setdefault(c, {})
            # keys longer than a character mark ends: of a stem, of a word
            node["stem" if stem else "word"] = term
            if term not in exact_only and (edits := self.allowed(body, stem)):
                self._add(body, stem, term, edits)
        self.letters = frozenset(c for children in self.below for c in children)
        self._forget()
        self.plain: set[str] = set()
        self.chars = 0
        self.hits: dict[str, tuple[float, bool]] = {}

    def allowed(self, body: str, stem: bool) -> int:
        """How many edits a term allows."""
        if len(body) >= EDIT_FROM:
            return 2 if self.wide and len(body) >= TWO_FROM else 1
        return int(self.wide and not stem and len(body) == EDIT_FROM - 1)

    def _add(self, body: str, stem: bool, term: str, edits: int) -> None:
        at = 0
        self.reach[0] = max(self.reach[0], edits)
        for c in body:
            if c not in self.below[at]:
                self.below[at][c] = len(self.below)
                self.below.append({})
                self.ends.append({})
                self.reach.append(0)
            at = self.below[at][c]
            self.reach[at] = max(self.reach[at], edits)
        self.ends[at][stem] = (term, edits)

    def _forget(self) -> None:
        """States of the automaton are sets of (trie node, edits, awaited letter); they are made when first reached."""
        self.states: list[tuple] = []
        self.numbers: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.start = self._state({(0, 0, "")})

    def _state(self, found: set[tuple[int, int, str]]) -> int:
        todo, least = list(found), {}
        while todo:
            node, e, held = todo.pop()
            if least.get((node, held), 9) <= e:
                continue
            least[node, held] = e
            if not held and (self.wide or node):  # a missing letter
                todo.extend((child, e + 1, "") for child in self.below[node].values() if self.reach[child] > e)
        key = frozenset((node, e, held) for (node, held), e in least.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            ended = {stem: [t for node, e, held in key if not held and (t := self.ends[node].get(stem)) and t[1] >= e] for stem in (True, False)}
            self.states.append((key, [t for t, _ in ended[True]], [t for t, _ in ended[False]]))
            self.moves.append({})
        return self.numbers[key]

    def _move(self, state: int, c: str) -> int:
        """The state after a letter; -1 if no term can follow."""
        out = set()
        for node, e, held in self.states[state][0]:
            if held:  # the second letter of a transposition
                if c == held:
                    out.add((node, e, ""))
                continue
            if (child := self.below[node].get(c)) is not None and self.reach[child] >= e:
                out.add((child, e, ""))
            if self.reach[node] > e and (self.wide or node):
                out.add((node, e + 1, ""))  # a letter too many
                for d, child in self.below[node].items():
                    if d != c and self.reach[child] > e:
                        out.add((child, e + 1, ""))
                        if self.wide and (after := self.below[child].get(c)) is not None and self.reach[after] > e:
                            out.add((after, e + 1, d))
        self.moves[state][c] = found = self._state(out) if out else -1
        return found

    def find(self, word: str) -> tuple[str, bool] | None:
        """The term of the greatest log odds that the word matches, and whether it needs edits.

        Exact matches come first; if `wide`, a word that only begins with a stem may count more as a near hit.
        """
        exact, node, size = [], self.root, len(word)
        for at in range(size + 1):
            if end := node.get("stem"):
                exact.append(end)
            if at == size:
                if end := node.get("word"):
                    exact.append(end)
            elif (node := node.get(word[at])) is None:
                break
        weight = self.lexicon.__getitem__
        best = max(exact, key=weight, default=None)
        if word in self.clean or (best and not (self.wide and best.endswith("*"))):
            return best and (best, False)
        if len(self.states) > MOST_STATES:
            self._forget()
        near, state = [], self.start
        for c in word:
            if c not in self.letters:
                c = ""
            if (after := self.moves[state].get(c)) is None:
                after = self._move(state, c)
            if (state := after) < 0:
                break
            near += self.states[state][1]
        else:  # a term of four letters must keep its length
            near += [t for t in self.states[state][2] if len(t) >= EDIT_FROM or len(t) == size]
        if near and (best is None or NEAR_SHARE * max(map(weight, near)) > weight(best)):
            return max(near, key=weight), True
        return best and (best, False)

    def match(self, word: str) -> tuple[float, bool] | None:
        """The greatest log odds of a term that the word matches, and whether it needs edits."""
        found = self.find(word)
        return found and (self.lexicon[found[0]], found[1])

    def look(self, written: str) -> tuple[str, bool] | None:
        """find for a word as it is written; signs at its ends may also stand for letters."""
        best = None
        for form in forms(written) if self.wide else forms(written)[:1]:
            found = self.find(form)
            if found and (best is None or (not found[1], self.lexicon[found[0]]) > (not best[1], self.lexicon[best[0]])):
                best = found
        return best

    def features(self, text: str) -> list[float]:
        words = text.split()
        if len(self.plain) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self.plain, self.chars = set(), 0
        # `set - keys()` would walk all keys, so the words are looked up one by one
        new = [w for w in set(words).difference(self.plain) if w not in self.hits]
        if new:
            for w in new:
                found = self.look(w)
                if found:
                    self.hits[w] = self.lexicon[found[0]], found[1]
                else:
                    self.plain.add(w)
                    self.chars += len(w)
        out = [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]
        if self.hits.keys().isdisjoint(words):
            return out
        get, strongest, plain, quoted, near = self.hits.get, 0.0, 0.0, 0.0, 0.0
        for i, w in enumerate(words):
            if (hit := get(w)) is None:
                continue
            if is_quoted(words, i):
                quoted += hit[0]
                continue
            share = hit[0]
            if hit[1]:
                near += share
                share *= NEAR_SHARE
            plain += share
            strongest = max(strongest, share)
        if len(self.hits) > CACHE_WORDS:
            self.hits = {}
        return [1.0, strongest, math.log1p(plain), math.log1p(quoted), math.log1p(near), plain / math.sqrt(len(words))]


def forms(written: str) -> list[str]:
    """A written word without the signs at its ends, and with those that may mask a letter, if it has any."""
    low = written.lower()
    bare, masked = low.strip(STRIP), low.strip(PUNCTUATION)
    return [bare] if masked == bare else [bare, masked]


def is_quoted(words: list[str], at: int) -> bool:
    """Whether the context window of a word shows quotation: marks on both sides, or a reporting word before."""
    before, after = words[max(0, at - WINDOW) : at], words[at + 1 : at + 1 + WINDOW]
    own = words[at]
    opened = own[:1] in OPENING or any(w[:1] in OPENING and w[-1:] not in CLOSING for w in before)
    closed = own.rstrip(".,;:!?")[-1:] in CLOSING or any(w.rstrip(".,;:!?")[-1:] in CLOSING for w in after)
    return (opened and closed) or any(w.lower().strip(STRIP) in REPORTING for w in before[-3:])


def bare_word(word: str) -> str:
    return word.strip(STRIP)


def terms_of(words: set[str]) -> set[str]:
    """The words and their stems."""
    found = set(words)
    for w in words:
        found.update([w[:k] + "*" for k in range(STEM_LOW, min(len(w), STEM_HIGH + 1))])
    return found


def learn_lexicon(texts: list[set[str]], toxic: np.ndarray, least: float = 2.0, most_terms: int = 2000) -> dict[str, float]:
    """Terms with log odds of `least` or more; a stem or word whose own prefix does as well is left out."""
    n1, n0 = int(toxic.sum()), int((1 - toxic).sum())
    bad, good = Counter(), Counter()
    for words, y in zip(texts, toxic, strict=True):
        if y:
            bad.update(terms_of(words))
    support = max(3, round(0.004 * n1))
    bad = Counter({t: c for t, c in bad.items() if c >= support})
    for words, y in zip(texts, toxic, strict=True):
        if not y:
            good.update(bad.keys() & terms_of(words))
    odds = {t: math.log((a + 0.5) / (n1 + 1)) - math.log((good[t] + 0.5) / (n0 + 1)) for t, a in bad.items()}
    strong = {t: o for t, o in odds.items() if o >= least and bad[t] > 2 * good[t] * n1 / n0}
    for t in sorted(strong, key=lambda t: (-len(t.rstrip("*")), t)):  # of terms with nearly the same texts, the longest
        if t not in strong:
            continue
        body = t.rstrip("*")
        for k in range(STEM_LOW, len(body)):
            if (stem := body[:k] + "*") in strong and bad[t] >= 0.9 * bad[stem]:
                del strong[stem]
        if not t.endswith("*") and bad[t] >= 0.9 * bad.get(t + "*", math.inf):
            strong.pop(t + "*", None)
    kept = {}
    for t in sorted(strong, key=lambda t: (-strong[t] * math.sqrt(bad[t]), t)):
        body = t.rstrip("*")
        if not any(strong.get(body[:k] + "*", 0.0) >= strong[t] - 0.2 for k in range(STEM_LOW, len(body))):
            kept[t] = strong[t]
        if len(kept) == most_terms:
            break
    return kept


def near_words(matcher: Matcher, texts: Iterable[str]) -> frozenset[str]:
    """The words of texts, in all their forms, that would be near hits."""
    written = {w for t in texts for w in t.split()}
    return frozenset(f for w in written for f in forms(w) if (found := matcher.find(f)) and found[1])


def rarely_held(lexicon: dict[str, float], toxic_texts: Iterable[set[str]], n: int) -> frozenset[str]:
    """Terms that too few toxic texts hold to look for misspellings of them."""
    seen = Counter()
    for words in toxic_texts:
        seen.update(lexicon.keys() & terms_of(words))
    return frozenset(t for t in lexicon if seen[t] < max(3, NEAR_SUPPORT * n))


def loose_terms(matcher: Matcher, clean_texts: list[str]) -> frozenset[str]:
    """Terms whose near hits are found in too many clean texts that the matcher has not seen."""
    found = Counter()
    for text in clean_texts:
        hits = [hit for w in set(text.split()) if (hit := matcher.look(w))]
        found.update({term for term, near in hits if near})
    return frozenset(t for t, count in found.items() if count > max(1, NEAR_CLEAN * len(clean_texts)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Newton steps for ridge logistic regression over weighted rows."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        move = np.linalg.solve(hessian, x.T @ (weight * (p - y)) + penalty * w)
        w -= np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-8:
            break
    return w


def fit(rows: list[tuple[int, str, int, float]]) -> bytes:
    """A pickled (lexicon, clean words, terms without edits, coefficients) from rows (doc_id, text, label, weight), in any order."""
    rows = sorted(rows)
    weight = np.array([r[3] for r in rows])
    rows = [r[:3] for r in rows]
    toxic = np.array([r[2] for r in rows], np.int64)
    held = np.arange(len(rows)) % 10 >= 7  # the coefficients come from rows that the lexicon has not seen
    if min(toxic[~held].sum(), (1 - toxic[~held]).sum()) < 5:
        lexicon = {t: 4.0 for t in SEED_TERMS}
        clean = near_words(Matcher(lexicon, wide=WIDE), (t for _, t, y in rows if not y))
        return pickle.dumps((lexicon, clean | ORDINARY, frozenset(), DEFAULT))
    one: dict[str, str] = {}  # a word of many texts is held once
    words = [{one.setdefault(w, w) for w in map(bare_word, t.lower().split()) if w} for _, t, _ in rows]
    del one
    lexicon = learn_lexicon([w for w, h in zip(words, held, strict=True) if not h], toxic[~held])
    exact_only = rarely_held(lexicon, (w for w, y, h in zip(words, toxic, held, strict=True) if y and not h), int(toxic[~held].sum()))
    matcher = Matcher(lexicon, frozenset(), exact_only, WIDE)
    clean = near_words(matcher, (t for (_, t, y), h in zip(rows, held, strict=True) if not y and not h))
    exact_only |= loose_terms(Matcher(lexicon, clean, exact_only, WIDE), [t for (_, t, y), h in zip(rows, held, strict=True) if not y and h])
    clean |= near_words(Matcher(lexicon, clean, exact_only, WIDE), (t for (_, t, y), h in zip(rows, held, strict=True) if not y and h))
    matcher = Matcher(lexicon, clean, exact_only, WIDE)
    x = np.array([matcher.features(t) for (_, t, _), h in zip(rows, held, strict=True) if h]).reshape(-1, len(DEFAULT))
    y = toxic[held]
    coefficients = DEFAULT
    if min(y.sum(), (1 - y).sum()) >= 3:
        used = np.ones(len(DEFAULT), bool)
        while True:  # no hit may speak against toxicity: a negative coefficient is taken out
            coefficients = np.zeros(len(DEFAULT))
            coefficients[used] = logistic(x[:, used], y, weight[held])
            worst = 1 + int(np.argmin(coefficients[1:]))
            if coefficients[worst] >= 0:
                break
            used[worst] = False
    return pickle.dumps((lexicon, clean, exact_only, coefficients))


def takes(counts: dict[int, int], max_rows: int) -> dict[int, tuple[int, float]]:
    """How many rows of each label a sample takes, and what each of them weighs.

    Labels are taken by their shares; a rarer label gets a twentieth of the rows if it has so many, and then weighs less,
    so that the weights keep the shares.
    """
    total = sum(counts.values())
    if total <= max_rows:
        return {y: (n, 1.0) for y, n in counts.items()}
    found = {y: max(round(max_rows * n / total), min(n, max_rows // 20)) for y, n in counts.items()}
    most = max(found, key=found.get)
    found[most] -= sum(found.values()) - max_rows
    natural = all(min(n, max_rows // 20) <= round(max_rows * n / total) for n in counts.values())
    return {y: (k, 1.0 if natural else counts[y] / total * max_rows / k) for y, k in found.items() if k}


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, max_rows: int) -> DataFrame:
    """At most max_rows rows (doc_id, text, label, weight) with `learn` true and a label of 0 or 1.

    Of each label the rows with the smallest hash of their id are taken, as many as `takes` says.  Labels of documents
    that are not there take up no place.  Of rows that repeat an id the least text counts, so a frequent id cannot make the
    sample grow.
    """
    there = docs.select(F.col("doc_id").cast(labels.schema["doc_id"].dataType).alias("doc_id"))
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).where(learn).join(there, "doc_id", "left_semi")
    single = usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    counts = {r.label: r["count"] for r in single.groupBy("label").count().collect()}
    parts = [single.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(k).withColumn("weight", F.lit(w)) for y, (k, w) in sorted(takes(counts, max_rows).items())]
    chosen = reduce(DataFrame.union, parts) if parts else single.limit(0).withColumn("weight", F.lit(1.0))
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"), F.max("weight").alias("weight"))


def fit_in_one_task(sample: DataFrame, fitter, max_bytes: int) -> bytes:
    """fitter(rows) on an executor, over a sample of bounded size.

    Rows come in the order of their id's hash; one whose text would bring the texts above max_bytes is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, room = [], max_bytes
        for batch in batches:
            for part in slices(batch, 1, 256):
                sizes = pc.binary_length(part.column(1)).to_pylist()
                for k, size in enumerate(sizes):
                    if size <= room:
                        room -= size
                        rows.append(tuple(c[k].as_py() for c in part.columns))
        yield pa.RecordBatch.from_arrays([pa.array([fitter(rows)], pa.binary())], ["model"])

    found = sample.select("doc_id", "text", "label", "weight").repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").mapInArrow(run, "model binary").first()
    return bytes(found.model) if found else fitter([])


def score(docs: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, score, n_hits_sum) for every row; the model is small (at most 2,000 terms and the clean near misses)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, clean, exact_only, coefficients = pickle.loads(shared.value)
        matcher = Matcher(lexicon, clean, exact_only, WIDE)
        for batch in batches:
            for part in slices(batch, 1, 512):
                x = np.array([matcher.features(t or "") for t in part.column(1).to_pylist()]).reshape(-1, len(coefficients))
                p = 1 / (1 + np.exp(-np.clip(x @ coefficients, -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array(x[:, 1])], ["doc_id", "score", "strongest"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, strongest double")


def toxicity_model(docs: DataFrame, labels: DataFrame, learn: Column, max_rows: int = 12_000, max_bytes: int = 1 << 26) -> bytes:
    return fit_in_one_task(labelled_sample(docs, labels, "toxic", learn, max_rows), fit, max_bytes)


def without_toxic(docs: DataFrame, model: bytes, threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose score is below the threshold, with all their columns."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, clean, exact_only, coefficients = pickle.loads(shared.value)
        matcher = Matcher(lexicon, clean, exact_only, WIDE)
        for batch in batches:
            for part in slices(batch, at, 512):
                x = np.array([matcher.features(t or "") for t in part.column(at).to_pylist()]).reshape(-1, len(coefficients))
                p = 1 / (1 + np.exp(-np.clip(x @ coefficients, -30, 30)))
                yield part.filter(pa.array(p < threshold))

    return docs.mapInArrow(run, docs.schema)
