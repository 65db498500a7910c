"""Language identification: a text as a mixture of languages, fitted by expectation-maximisation.

A word (a run of letters, in lower case) has a likelihood in every learned language: the product over its letters and its
end of their probabilities given the two letters before, interpolated with shorter contexts.  A text's words are drawn
from a mixture of languages; EM estimates the mixture's shares.  Languages are then added in the order of their shares,
each set with an EM of its own, as long as the penalised log likelihood

    sum over words of log(sum over the set of share * likelihood) - PENALTY * (languages - 1) * log(words + 1)

grows; the set with the largest value is the text's set of languages, the largest share its language.  A word's
likelihood in a language is not taken to be less than exp(-DOUBT) of its largest, so names and slips do not decide.

All texts of a batch go through one EM as arrays.  The model comes from a sample of the learned rows, of each language the
`per_language` ids with the smallest hash, at most `max_bytes` of text in one task, the `most_languages` languages with most ids and
the `most_grams` most frequent groups of three letters; it has 4 bytes a group and language.

Defined results: a null text and one without letters get `und`, a score of 0 and no languages, as do all texts when nothing
could be learned; the score is the share of the language, (words + 1/2) / (all words + languages learned / 2), so short
texts score less; ties go to the language that comes first by code points; rows with a null id or language are predicted
but never learned from; an id that repeats counts once a language, with its least text; an empty table gives an empty
table; very long texts are read whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import slices
from rasterloom.llm.toxicity import fit_in_one_task

#: Weight of the shorter context, in letters counted; least likelihood of a word, as a power of e; price of a language.
BACKOFF, DOUBT, PENALTY = 4.0, 5.0, 2.0
#: EM ends when no share moves by more than this.
STILL, MOST_STEPS = 1e-3, 200
UNKNOWN = "und"
_PLACES = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000)


def letter_groups(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the groups of three of all words, where each word starts among them, and the number of words of each text.

    A word gives a group for every letter and one for its end; letters before its start count as 0.
    """
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer("\0".join([*lowered, ""]).encode("utf-32-le"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])
    codes = np.where(_letters()[codes], codes, 0)
    before = np.concatenate([[0], codes[:-1]])
    kept = (codes > 0) | (before > 0)  # letters, and the first place after a word
    owner, c, b = owner[kept], codes[kept], before[kept]
    a = np.where(b > 0, np.concatenate([[0], b[:-1]]), 0)
    starts = np.flatnonzero(b == 0)
    return (a << 42) | (b << 21) | c, starts, np.bincount(owner[starts], minlength=len(texts))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every row its key's sum over all rows that share the key, and the key's number."""
    _, back = np.unique(keys, return_inverse=True)
    total = np.zeros((back.max() + 1, counts.shape[1]))
    np.add.at(total, back, counts)
    return total[back], back


def fit(rows: list[tuple], most_grams: int = 1 << 18) -> bytes:
    """The model from rows (doc_id, text, language, weight): languages, codes and their log probabilities."""
    languages = sorted({r[2] for r in rows})
    found = []
    for language in languages:
        codes, _, _ = letter_groups([r[1] for r in rows if r[2] == language])
        found.append(np.unique(codes, return_counts=True))
    everything = np.unique(np.concatenate([c for c, _ in found])) if found else np.zeros(0, np.int64)
    if not len(everything):
        return pickle.dumps(([], everything, np.zeros((0, 0), np.float32)))
    counts = np.zeros((len(everything), len(languages)))
    for k, (codes, n) in enumerate(found):
        counts[np.searchsorted(everything, codes), k] = n
    c, b, context = everything & 0x1FFFFF, everything >> 21 & 0x1FFFFF, everything >> 21
    of_context, _ = _summed(context, counts)
    of_pair, _ = _summed(everything & (1 << 42) - 1, counts)
    of_before, _ = _summed(b, counts)
    of_letter, number = _summed(c, counts)
    one = (of_letter + 0.5) / (counts.sum(axis=0) + 0.5 * (number.max() + 1))
    two = (of_pair + BACKOFF * one) / (of_before + BACKOFF)
    three = (counts + BACKOFF * two) / (of_context + BACKOFF)
    order = np.argsort(-counts.sum(axis=1), kind="stable")[:most_grams]
    return pickle.dumps((languages, everything[order], np.log(three[order]).astype(np.float32)))


class Identifier:
    """Scores words with a model and fits mixtures to texts."""

    def __init__(self, model: bytes):
        self.languages, self.codes, self.log_p = pickle.loads(model)
        self.slots = np.full(_PLACES, -1, np.int32)
        places = _place(self.codes)
        self.slots[places[::-1]] = np.arange(len(self.codes) - 1, -1, -1)  # the most frequent group keeps a shared place
        # the last row serves groups that are not known, which say nothing
        self.log_p = np.concatenate([self.log_p, np.zeros((1, len(self.languages)), np.float32)])
        self.codes = np.append(self.codes, -1)

    def word_likelihoods(self, groups: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Words x languages, each word's largest value 1 and none below exp(-DOUBT)."""
        slot = self.slots[_place(groups)]
        slot = np.where(self.codes[slot] == groups, slot, -1)
        total = np.add.reduceat(self.log_p[slot], starts, axis=0, dtype=np.float64)
        return np.exp(np.maximum(total - total.max(axis=1, keepdims=True), -DOUBT))

    def mixtures(self, texts: list[str]) -> tuple[list[list[tuple[str, float]]], list[int]]:
        """(language, share of the words) of each text's set of languages, largest share first; the texts' numbers of words."""
        groups, starts, sizes = letter_groups(texts)
        found: list[list[tuple[str, float]]] = [[] for _ in texts]
        if not len(starts) or not self.languages:
            return found, sizes.tolist()
        texts_with = np.flatnonzero(sizes)
        shares, _ = em(likely := self.word_likelihoods(groups, starts), sizes[texts_with], np.ones((len(texts_with), len(self.languages)), bool))
        rank = np.argsort(-np.round(shares, 6), axis=1, kind="stable")
        best = np.full(len(texts_with), -np.inf)
        chosen = np.zeros_like(shares)
        open_, words, size = np.arange(len(texts_with)), likely, sizes[texts_with]
        for k in range(1, len(self.languages) + 1):
            allowed = np.zeros((len(open_), len(self.languages)), bool)
            np.put_along_axis(allowed, rank[open_, :k], True, axis=1)
            shares, fit_ = em(words, size, allowed)
            value = fit_ - PENALTY * (k - 1) * np.log(size + 1)
            better = value > best[open_] + 1e-9
            best[open_[better]], chosen[open_[better]] = value[better], shares[better]
            if not better.any():
                break
            words, open_, size = words[np.repeat(better, size)], open_[better], size[better]
        for row, k in zip(chosen, texts_with.tolist(), strict=True):
            order = np.argsort(-np.round(row, 6), kind="stable")
            found[k] = [(self.languages[j], float(row[j])) for j in order if row[j] > 0]
        return found, sizes.tolist()


def _place(codes: np.ndarray) -> np.ndarray:
    return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)


def em(likely: np.ndarray, sizes: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the allowed languages in every text and its log likelihood; sizes are its numbers of words, none 0."""
    shares = allowed / allowed.sum(axis=1, keepdims=True)
    fit_ = np.zeros(len(sizes))
    moving, words, size = np.arange(len(sizes)), likely, sizes
    for _ in range(MOST_STEPS):
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        joint = np.repeat(shares[moving], size, axis=0) * words
        whole = joint.sum(axis=1)
        new = np.add.reduceat(joint / whole[:, None], starts, axis=0) / size[:, None]
        fit_[moving] = np.add.reduceat(np.log(whole), starts)
        on = np.abs(new - shares[moving]).max(axis=1) > STILL
        shares[moving] = new
        if not on.any():
            break
        if not on.all():
            words, moving, size = words[np.repeat(on, size)], moving[on], size[on]
    return shares, fit_


def language_model(docs: DataFrame, learn: Column, per_language: int = 1_500, max_bytes: int = 1 << 25, most_languages: int = 256) -> bytes:
    """The model, learned from text and lang of the rows for which `learn` holds."""
    usable = docs.where(learn & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.col("lang").alias("label"))
    counts = usable.groupBy("label").agg(F.approx_count_distinct("doc_id", 0.02).alias("n")).orderBy(F.desc("n"), "label").limit(most_languages).collect()
    if not counts:
        return fit([])
    # of a frequent language a part of the ids by their hash, somewhat more than needed; the rest is cut by rank
    most = 1 << 40
    least = F.create_map(*[F.lit(x) for r in counts for x in (r.label, min(most, int(most * 1.25 * per_language / max(r.n, 1))))])
    some = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(most)) < least[F.col("label")])
    single = some.groupBy("label", "doc_id").agg(F.min("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(most)), "doc_id"))
    sample = single.withColumn("__place", place).where(F.col("__place") <= per_language).withColumn("weight", F.lit(1.0))
    return fit_in_one_task(sample, fit, max_bytes)


SCHEMA = "doc_id long, lang_pred string, score double, languages array<struct<lang: string, share: double>>"


def identify(docs: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, lang_pred, score, languages) for every row; languages is the text's set with shares, largest first."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    listed = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identifier = Identifier(shared.value)
        for batch in batches:
            for part in slices(batch, 1, 512, 1 << 20):
                texts = [t or "" for t in part.column(1).to_pylist()]
                found, sizes = identifier.mixtures(texts)
                half = len(identifier.languages) / 2
                score = [(m[0][1] * n + 0.5) / (n + half) if m else 0.0 for m, n in zip(found, sizes, strict=True)]
                sets = pa.array([[{"lang": a, "share": s} for a, s in m] for m in found], listed)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([m[0][0] if m else UNKNOWN for m in found]), pa.array(score, pa.float64()), sets], ["doc_id", "lang_pred", "score", "languages"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
