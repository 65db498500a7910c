"""Packing, token counts, toxicity, quality rules and classifier, segmentations: brute force, round trips, odd rows."""

import math
import pickle
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

pytest.importorskip("rasterloom.llm")
import public_tokenizers
from tokenizers import Tokenizer

from rasterloom.llm import packing, quality_classifier, quality_rules, queries, segment_sampling, token_counts, toxicity
from rasterloom.llm.common import id_bucket
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORDS, BYTES, PIECES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, label int, hash string"
ODD = [None, "", " ", "\n\n", "a", "x " * 30_000, "ü" * 5_000, "It's  a\ttest.\n\nNew line!  中文 😀😀 <|endoftext|> é x ΣΑΣ İ", "same text here again", "same text here again", "▁ under ▁▁ score", "\x00 \x0b\x85 odd"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i != 4 else None, t, "en", None, None, 0.5, 1, "h") for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[3]], SCHEMA).repartition(2)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def check_pieces(pieces, texts, size=4096):
    """Every id in one piece, the ids right, offsets without gaps; returns the share of padding."""
    reference = Tokenizer.from_file(WORDS)
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(texts)
    for doc_id, text in texts.items():
        ids = [*reference.encode(text or "", add_special_tokens=False).ids, 2]
        at = 0
        for p in sorted(by_doc[doc_id], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert np.frombuffer(p.ids, "<u4").tolist() == ids[at : at + p.length]
            at += p.length
        assert at == len(ids)
    padding = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding / sum(p.length for p in pieces)


def test_packing_whole_table(docs, texts):
    assert check_pieces(packing.pack(docs, WORDS, 2).collect(), texts) < 0.02


def test_packing_odd_rows(odd):
    unique = odd.dropDuplicates(["doc_id"])
    assert check_pieces(packing.pack(unique, WORDS, 2, size=64).collect(), {i if i != 4 else None: t for i, t in enumerate(ODD)}, 64) < 0.5
    assert packing.pack(odd.limit(0), WORDS, 2).count() == 0
    assert packing.pack(odd, WORDS, 2).where("doc_id = 3").count() == 2


def test_packing_query_digest(spark):
    rows = queries.op1_packing(spark, SF).limit(3).collect()
    assert set(rows[0].asDict()) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}


def plain_plan(doc_ends, sentence_ends, total, size):
    """The same dynamic programme over every allowed cut, quadratic."""
    marks = sorted({0, total, *doc_ends, *sentence_ends})
    for a, b in zip(marks, marks[1:]):
        space = min(packing.SPACING, size // 2)
        marks += range(a + space, b, space)
    place = sorted({*marks, *range(max(0, total - size), total)})
    cost = {0: 0.0}
    for j in place[1:]:
        own = 0.0 if j in doc_ends or j == total else packing.SENTENCE_CUT if j in sentence_ends else packing.HARD_CUT
        ways = [cost[i] + (0 if (j - i) & (j - i - 1) == 0 else size - (j - i)) for i in place if i < j and j - i <= size]
        cost[j] = min(ways) + own + packing.OVERHEAD
    return cost


def test_plan_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(15):
        total, size = int(rng.integers(50, 900)), 64
        ends = sorted({*rng.integers(1, total, 12).tolist(), total})
        sentences = sorted(set(rng.integers(1, total, 40).tolist()))
        cuts = packing.plan(np.array(ends), np.array(sentences), total, size, True)
        assert cuts[-1] == total and all(0 < b - a <= size for a, b in zip([0, *cuts], cuts))
        cost = sum((0 if (b - a) & (b - a - 1) == 0 else size - (b - a)) + packing.OVERHEAD + (0 if b in ends else packing.SENTENCE_CUT if b in sentences else packing.HARD_CUT) for a, b in zip([0, *cuts], cuts))
        assert cost == pytest.approx(plain_plan(set(ends), set(sentences), total, size)[total])


def test_word_encoder_equals_tokenizer(texts):
    reference = Tokenizer.from_file(WORDS)
    words = sorted({w for t in texts.values() for w in t.split(" ")})
    extra = ["don't", "IT'S", "ŉa", "İx", "ÅÄ", "ﬁn", "éa", "word,,", 'q"', "(a)", "a-b", "x***", "<|startoftext|>", "123abc", "ǅ", "ß", "…a…"]
    for part, found in zip([*words, *extra], packing.WordEncoder(WORDS).encode([*words, *extra]), strict=True):
        assert np.frombuffer(found, "<u4").tolist() == reference.encode(part, add_special_tokens=False).ids, part


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts_against_encoding(spark, rule):
    rows = [(1, "one two\n\n\n three"), (2, None), (3, ""), (4, "a\n"), (5, "中文 😀\nplain | table\n- list"), (6, "x\n\n\n\ny"), (6, "x\n\n\n\ny")]
    found = token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), BYTES, public_tokenizers.PATTERN, rule).collect()
    reference = Tokenizer.from_file(BYTES)
    for doc_id, text in rows:
        own = sorted((r for r in found if r.doc_id == doc_id), key=lambda r: r.section)[:: 2 if doc_id == 6 else 1]
        if not text:
            assert not own
            continue
        assert "".join(text[r.char_start : r.char_start + r.n_chars] for r in own) == text
        owners, shares = Counter(), Counter()
        for s, e in reference.encode(text, add_special_tokens=False).offsets:
            inside = {r.section: max(0, min(e, r.char_start + r.n_chars) - max(s, r.char_start)) for r in own}
            touched = [k for k, v in inside.items() if v]
            for k in touched:
                shares[k] += inside[k] / (e - s)
            owners[touched[0] if rule == "first" else touched[-1] if rule == "last" else max(touched, key=lambda k: (inside[k], -k))] += 1
        assert {r.section: r.n_tokens for r in own} == {r.section: owners[r.section] for r in own}
        assert all(r.token_share == pytest.approx(shares[r.section]) for r in own)


def test_token_counts_sum(spark, docs, texts):
    reference = Tokenizer.from_file(BYTES)
    reference.encode_special_tokens = True
    totals = {r.doc_id: r.n for r in queries.op2_token_counts(spark, SF).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    assert totals == {i: len(reference.encode(t).ids) for i, t in texts.items() if t}
    with pytest.raises(ValueError):
        token_counts.token_counts(docs, BYTES, public_tokenizers.PATTERN, "any")


def test_token_counts_odd_rows(odd):
    found = token_counts.token_counts(odd, BYTES, public_tokenizers.PATTERN)
    assert found.select("doc_id").distinct().count() == len(ODD) - 2 and found.where("n_tokens < 0").count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    order = lambda f: f[sorted(f.columns)].sort_values(sorted(f.columns)).reset_index(drop=True)
    ours, theirs = order(queries.QUERIES[name](spark, SF).toPandas()), order(con.execute(queries.SQL[name]).df())
    assert list(ours.columns) == list(theirs.columns) and len(ours) == len(theirs) and (ours == theirs).all().all()


def brute_repeats(words, size=8):
    grams = Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    return len({j for i in range(len(words) - size + 1) if grams[tuple(words[i : i + size])] > 1 for j in range(i, i + size)})


def test_quality_counts_odd_rows(spark, odd):
    loops = ["a b c d e f g h " * 3, " ".join(map(str, range(40))), "a b c d e f g h x a b c d e f g h", "w " * 8, "w " * 9, "# x\n# x\n\n  \n# x", "l\nl\r\nl"]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(loops)], "doc_id long, text string")
    every = {**dict(enumerate(ODD)), **{100 + i: t for i, t in enumerate(loops)}}
    for r in quality_rules.quality_counts(odd.select("doc_id", "text").union(more)).collect():
        text = every[4 if r.doc_id is None else r.doc_id] or ""
        words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w]
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)))
        assert r.n_repeat_words == brute_repeats(words), text[:40]
        assert r.base_failed == (len(words) < 20 or 100 * r.n_repeat_words > 30 * len(words)) and not (r.base_failed and r.kept)
    assert quality_rules.quality_filter(odd).columns == odd.columns and quality_rules.quality_filter(odd.limit(0)).count() == 0


def test_quality_plan_is_native(docs):
    plan = quality_rules.quality_counts(docs)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Exchange"))


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_against_edit_distance():
    terms = {"idiot": 3.0, "moron": 2.0, "scum": 4.0, "vequ*": 5.0, "pathetic": 6.0, "strange*": 1.0}
    matcher = toxicity.Matcher(terms)
    rng = np.random.default_rng(0)
    words = ["", "i", "idiot", "idiots", "scums", "vequaire", "path", "strangely", "stranely", "vekuaire"]
    for term in terms:
        for _ in range(150):
            w = list(term.rstrip("*") + ("xy" if rng.random() < 0.3 else ""))
            for _ in range(rng.integers(0, 3)):
                k = int(rng.integers(0, len(w) + 1))
                w[k : k + int(rng.integers(0, 2))] = ["abdiortm"[rng.integers(0, 8)]] * int(rng.integers(0, 2))
            words.append("".join(w))
    for w in words:
        exact = max([o for t, o in terms.items() if (w.startswith(t[:-1]) if t.endswith("*") else w == t)], default=0.0)
        near = 0.0
        for t, o in terms.items():
            body = t.rstrip("*")
            if len(body) >= toxicity.EDIT_FROM and w[:1] == body[:1]:
                ends = [w[:k] for k in range(len(w) + 1)] if t.endswith("*") else [w]
                if any(edit_distance(e, body) <= 1 for e in ends):
                    near = max(near, o)
        found = matcher.match(w)
        assert (found or (0.0, False))[0] == (exact or near), w
        assert found is None or found[1] == (not exact)


def test_quotation_is_not_abuse():
    matcher = toxicity.Matcher({"idiot": 4.0})
    abuse, quote, report = (matcher.features(t) for t in ("you are an idiot and more", 'he used the word "idiot" in court', "she said idiot was wrong"))
    assert abuse[2] > 0 and abuse[3] == 0 and quote[3] > 0 and quote[2] == 0 and report[3] > 0
    assert matcher.features("an idiiot here")[4] > 0 and matcher.features("nothing here") == [1.0, 0, 0, 0, 0, 0]


def toxic_scorer():
    """The score under a model fitted on made-up prose, some with insults, none of them misspelled."""
    rng = np.random.default_rng(3)
    parts = ["ba", "ce", "du", "fo", "gi", "ha", "lem", "nor", "pas", "rit"]
    prose = lambda: ["".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(12)]
    rows = []
    for k in range(600):
        words = prose()
        if k % 4 == 0:
            words.insert(int(rng.integers(0, 12)), str(rng.choice(toxicity.SEED_TERMS)))
        rows.append((k, " ".join(words), int(k % 4 == 0), 1.0))
    lexicon, clean, exact_only, weights = pickle.loads(toxicity.fit(rows))
    matcher = toxicity.Matcher(lexicon, clean, exact_only, toxicity.WIDE)
    return lambda text: 1 / (1 + np.exp(-np.dot(matcher.features(text), weights))), prose


def test_misspelled_insults_are_toxic():
    score, prose = toxic_scorer()
    for text in ("you are an idiiot and no more", "stupyd idiiot", "what a mooron he is", "you are a clowwn and no more"):
        assert score(text) >= 0.3, text
    assert np.mean([score(" ".join(prose())) >= 0.3 for _ in range(300)]) < 0.01


def close(a, b, most):
    """Whether a becomes b by so many edits; neighbours that change places are one."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        rows.append([i])
        for j, y in enumerate(b, 1):
            least = min(rows[i - 1][j] + 1, rows[i][-1] + 1, rows[i - 1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                least = min(least, rows[i - 2][j - 2] + 1)
            rows[i].append(least)
    return rows[-1][-1] <= most


def test_wide_automaton_against_edit_distance():
    terms = {"idiot": 3.0, "moron": 2.0, "scum": 4.0, "pathetic": 6.0, "disgusting": 5.0, "strange*": 1.0}
    matcher = toxicity.Matcher(terms, wide=True)
    rng = np.random.default_rng(5)
    words = ["", "1diot", "ztupid", "idoit", "scvm", "cum", "scums", "d1sgust1ng", "apthetci", "ohtepatic", "tsrangely"]
    for term in terms:
        for _ in range(300):
            w = list(term.rstrip("*") + ("xy" if rng.random() < 0.3 else ""))
            for _ in range(rng.integers(0, 4)):
                k = int(rng.integers(0, len(w)))
                w[k : k + 2] = [w[k : k + 2][::-1], w[k + 1 : k + 2], ["x", *w[k : k + 2]], ["1", *w[k + 1 : k + 2]]][rng.integers(0, 4)]
                w = w or ["i"]
            words.append("".join(w))
    for w in words:
        near = []
        for t, o in terms.items():
            body = t.rstrip("*")
            ends = [w[:k] for k in range(len(w) + 1)] if t.endswith("*") else [w]
            most = 2 if len(body) >= 8 else 1
            if any(close(e, body, most) for e in ends if len(body) > 4 or len(e) == 4):
                near.append(o)
        exact = max([o for t, o in terms.items() if (w.startswith(t[:-1]) if t.endswith("*") else w == t)], default=0.0)
        if exact and (exact > 1 or not near or 0.75 * max(near) <= exact):
            assert matcher.match(w) == (exact, False), w
        else:
            assert matcher.match(w) == ((max(near), True) if near else None), w


def test_disguised_insults_are_toxic():
    score, prose = toxic_scorer()
    for text in ("1diot", "ztupid man", "$tupid", "*diot", "you idoit", "so stuipd", "you are scvm", "you are $cum", "d1sgust1ng"):
        assert score(text) >= 0.3, text
    assert np.mean([score(" ".join(prose())) >= 0.3 for _ in range(300)]) < 0.01


def auc(y, s):
    rank = np.argsort(np.argsort(s))
    n = sum(y)
    return (rank[np.array(y) == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize(("name", "label", "least"), [("op3_toxicity", "toxic", 0.9), ("op8_quality_classifier", "quality", 0.97)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.1"
    scored = queries.QUERIES[name](spark, sf)
    rows = scored.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    modulus, fold = (4, 2) if label == "toxic" else (5, 0)
    assert all(zlib.crc32(str(r.doc_id).encode()) % modulus == fold for r in rows)
    assert auc([r[label] for r in rows], [r.score for r in rows]) > least
    assert np.mean([r.predicted == r[label] for r in rows]) > 0.95 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_classifiers_odd_rows(spark, odd):
    labels = spark.createDataFrame([(0, 1, 0), (None, 1, 1), (1, None, None), (5, 0, 1), (5, 1, 1)], "doc_id long, quality int, toxic int")
    every = id_bucket(F.col("doc_id"), 4) != 2
    toxic = toxicity.toxicity_model(odd, labels, every)
    scores = toxicity.score(odd, toxic).collect()
    assert len(scores) == len(ODD) + 1 and all(0 <= r.score <= 1 for r in scores)
    kept = toxicity.without_toxic(odd, toxic)
    assert kept.columns == odd.columns and kept.count() == sum(r.score < 0.3 for r in scores)
    quality = quality_classifier.quality_model(odd, labels, every)
    assert quality_classifier.score(odd, quality).count() == len(ODD) + 1
    none = quality_classifier.quality_model(odd, labels.limit(0), every)
    assert {r.score for r in quality_classifier.score(odd, none).collect()} == {0.5}
    assert toxicity.score(odd.limit(0), toxicity.toxicity_model(odd, labels.limit(0), every)).count() == 0


def test_ftrl_separates():
    rows = [(i, ("good calm words " if i % 2 else "BAD!! LOUD!! ") * 5 + str(i), i % 2, 1.0) for i in range(200)]
    weights = np.frombuffer(quality_classifier.fit(rows), np.float32)
    assert quality_classifier.fit(rows[::-1]) == quality_classifier.fit(rows)
    hasher = quality_classifier.Hasher()
    for text, sign in (("good calm words again", 1), ("BAD!! LOUD!! again", -1)):
        i, v = hasher.vector(text)
        assert sign * (weights[-1] + weights[i] @ v) > 0


def enumerate_paths(text, vocabulary):
    """All segmentations of a text with their probabilities."""
    pieces = {vocabulary.processor.id_to_piece(i): i for i in range(vocabulary.processor.vocab_size()) if not vocabulary.processor.is_byte(i)}
    whole, found, open_ = "▁" + text.replace(" ", "▁"), [], [((), 0, 0.0)]
    while open_:
        path, at, logw = open_.pop()
        if at == len(whole):
            found.append((path, logw))
            continue
        for n in range(1, 17):
            part = whole[at : at + n]
            if len(part) == n and part in pieces:
                open_.append(((*path, pieces[part]), at + n, logw + vocabulary.log_weight[pieces[part]]))
    logz = np.logaddexp.reduce([w for _, w in found])
    return {p: math.exp(w - logz) for p, w in found}


def test_sampling_without_replacement():
    vocabulary = segment_sampling.vocabulary(PIECES, 0.3)
    p = enumerate_paths("ab the", vocabulary)
    n, keys = 6000, segment_sampling.mix(np.arange(6000, dtype=np.uint64))
    drawn = segment_sampling.sample_texts(["ab the"] * n, keys, PIECES, 0.3, 3)
    paths = [[tuple(np.frombuffer(x[0], "<u4").tolist()) for x in row] for row in drawn]
    assert all(len(set(x)) == 3 for x in paths) and all(a[1] == pytest.approx(math.log(p[q])) for row, own in zip(drawn, paths) for a, q in zip(row, own))
    assert all(row[0][2] > row[1][2] > row[2][2] for row in drawn)
    first, second = Counter(x[0] for x in paths), Counter(x[1] for x in paths)
    for path, q in p.items():
        assert first[path] / n == pytest.approx(q, abs=0.03)
        assert second[path] / n == pytest.approx(sum(p[o] * q / (1 - p[o]) for o in p if o != path), abs=0.03)
    # inclusion scores are unbiased: the sum of p / inclusion has mean 1
    assert np.mean([sum(p[q] / a[3] for a, q in zip(row, own)) for row, own in zip(drawn, paths)]) == pytest.approx(1, abs=0.02)


def test_sampling_runs_out_of_paths():
    p = enumerate_paths("ab", segment_sampling.vocabulary(PIECES, 1.0))
    found = segment_sampling.sample_texts(["ab", None, ""], np.arange(3, dtype=np.uint64), PIECES, 1.0, len(p) + 5)
    assert {tuple(np.frombuffer(x[0], "<u4").tolist()) for x in found[0]} == set(p) and all(x[3] == 1 for x in found[0]) and found[1:] == [[], []]


def test_segmentation_round_trip(odd, docs, texts):
    rows = segment_sampling.sample_segmentations(docs, PIECES, k=2).collect()
    assert Counter(r.doc_id for r in rows).most_common()[-1][1] == 2 and len(rows) == 2 * len(texts)
    for r in rows:
        assert segment_sampling.decode(np.frombuffer(r.ids, "<u4"), PIECES) == texts[r.doc_id]
    for r in segment_sampling.sample_segmentations(odd, PIECES, k=3).collect():
        assert segment_sampling.decode(np.frombuffer(r.ids, "<u4"), PIECES) == ODD[4 if r.doc_id is None else r.doc_id].replace("▁", " ")
    again = segment_sampling.sample_segmentations(docs.repartition(7), PIECES, k=2).collect()
    assert {(r.doc_id, r.sample, bytes(r.ids)) for r in again} == {(r.doc_id, r.sample, bytes(r.ids)) for r in rows}


def test_decoding_rows(spark, docs, texts):
    drawn = segment_sampling.sample_segmentations(docs, PIECES, k=1).withColumn("text", F.lit("other"))
    back = segment_sampling.decode_rows(drawn, PIECES)
    assert "ids" not in back.columns and {r.doc_id: r.text for r in back.collect()} == texts
    odd = spark.createDataFrame([(1, None), (2, b"")], "doc_id long, ids binary")
    assert {r.doc_id: r.text for r in segment_sampling.decode_rows(odd, PIECES).collect()} == {1: None, 2: ""}


def test_query_decodes_what_it_draws(spark, docs, texts):
    rows = queries.op5_segment_sampling(spark, SF).collect()
    assert Counter(r.doc_id for r in rows) == {i: 2 for i in texts}
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)
    both = segment_sampling.sample_segmentations(docs, PIECES, k=2, decoded=True).select("ids", "text")
    assert all(r.text == segment_sampling.decode(np.frombuffer(r.ids, "<u4"), PIECES) for r in both.limit(200).collect())


def test_frequent_id_keeps_the_sample_small(spark):
    docs = spark.createDataFrame([(7, f"text {k}") for k in range(500)] + [(8, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, toxic int")
    rows = toxicity.labelled_sample(docs, labels, "toxic", F.lit(True), 10).collect()
    assert sorted((r.doc_id, r.text, r.label) for r in rows) == [(7, "text 0", 1), (8, "other", 0)]


def plain_score(text, lexicon, clean, exact_only, weights):
    """The score word by word: every form of a word against every term by edit distance."""

    def best(form):
        exact = [t for t in lexicon if (form.startswith(t[:-1]) if t.endswith("*") else form == t)]
        top = max(exact, key=lexicon.get, default=None)
        if form in clean or (top and not top.endswith("*")):
            return top and (False, top)
        near = []
        for t in lexicon:
            body = t.rstrip("*")
            most = 0 if t in exact_only else 2 if len(body) >= 8 else 1 if len(body) >= 5 or (len(body) == 4 and t == body) else 0
            ends = [form[:k] for k in range(len(form) + 1)] if t.endswith("*") else [form]
            if most and any(close(e, body, most) for e in ends if len(body) > 4 or len(e) == 4):
                near.append(t)
        if near and (top is None or 0.75 * max(map(lexicon.get, near)) > lexicon[top]):
            return True, max(near, key=lexicon.get)
        return top and (False, top)

    words = text.split()
    plain = quoted = close_ = strongest = 0.0
    for i, w in enumerate(words):
        found = [f for f in map(best, toxicity.forms(w)) if f]
        if not found:
            continue
        near, term = max(found, key=lambda f: (not f[0], lexicon[f[1]]))
        odds = lexicon[term]
        if toxicity.is_quoted(words, i):
            quoted += odds
            continue
        close_ += odds if near else 0.0
        odds *= 0.75 if near else 1.0
        plain, strongest = plain + odds, max(strongest, odds)
    x = [1.0, strongest, math.log1p(plain), math.log1p(quoted), math.log1p(close_), plain / math.sqrt(len(words)) if words else 0.0]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, weights))))


def test_scores_against_plain_distances(spark):
    lexicon = {"idiot": 4.0, "worthless": 5.0, "scum": 3.0, "pathet*": 2.5, "clown": 3.5, "loser": 3.2}
    clean, exact_only, weights = frozenset({"crown", "lower"}), frozenset({"loser"}), np.array([-4.0, 0.8, 0.9, 0.1, 0.3, 0.5])
    rng = np.random.default_rng(9)
    pool = "idiot idoit 1diot idiooot worthless wrothless wprthlss scum scvm $cum pathetic pathtic clown crown loser looser lower the a man said \"idiot\" 'clown' and so it is".split()
    texts = [" ".join(rng.choice(pool, rng.integers(0, 9))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.score for r in toxicity.score(df, pickle.dumps((lexicon, clean, exact_only, weights))).collect()}
    for i, t in enumerate(texts):
        assert found[i] == pytest.approx(plain_score(t, lexicon, clean, exact_only, weights), abs=1e-9), t


def test_ftrl_against_a_scalar_loop():
    rng = np.random.default_rng(1)
    hasher = quality_classifier.Hasher()
    vectors = [hasher.vector(" ".join(rng.choice(["good", "Bad!!", "calm", "word", "x1"], rng.integers(0, 8)))) for _ in range(60)]
    labels = rng.integers(0, 2, 60).astype(float)
    a, b, l1, l2, bias = quality_classifier.ALPHA, quality_classifier.BETA, quality_classifier.L1, quality_classifier.L2, 1 << quality_classifier.BITS
    z, n = Counter(), Counter()

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((b + math.sqrt(n[i])) / a + l2)

    for _ in range(3):
        for (places, values), y in zip(vectors, labels):
            x = [*zip(places.tolist(), values.tolist()), (bias, 1.0)]
            w = {i: weight(i) for i, _ in x}
            gap = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x))) - y
            for i, v in x:
                g = gap * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / a * w[i]
                n[i] += g * g
    found = quality_classifier.ftrl(vectors, labels, 3)
    assert all(found[i] == pytest.approx(weight(i), abs=1e-6) for i in z) and np.count_nonzero(found) == sum(weight(i) != 0 for i in z)


def test_scores_are_sparse_dot_products(spark):
    weights = np.random.default_rng(0).standard_normal((1 << quality_classifier.BITS) + 1).astype(np.float32)
    texts = ["Good WORDS here. and good good", "", "one", "a b\nc D!!"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_classifier.score(df, weights.tobytes()).collect():
        places, values = quality_classifier.Hasher().vector(texts[r.doc_id])
        total = float(weights[-1]) + sum(float(weights[i]) * v for i, v in zip(places.tolist(), values.tolist()))
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)))
        assert not len(values) or sum(v * v for v in values) == pytest.approx(1)


def test_fit_samples_are_bounded_in_bytes(spark):
    rows = spark.createDataFrame([(i, "x" * (10_000 if i % 2 else 100), i % 2, 1.0) for i in range(100)], "doc_id long, text string, label int, weight double")
    held = pickle.loads(toxicity.fit_in_one_task(rows, lambda r: pickle.dumps(r), 60_000))
    assert sum(len(r[1]) for r in held) <= 60_000 and sum(r[2] for r in held) >= 5 and len(held) > 45
    labels = spark.createDataFrame([(i, 1) for i in range(1000)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, "t") for i in range(0, 1000, 100)], "doc_id long, text string")
    assert toxicity.labelled_sample(docs, labels, "toxic", F.lit(True), 10).count() == 10


@pytest.mark.parametrize("text", ["ab the cat=" * 9, "中文字" * 30, "The/quick-brown/fox" * 4, "=" * 60, "x中y" * 20, "nothing long"])
def test_cut_units_keep_all_paths(text):
    """A path's log probability against a plain forward sum over the whole lattice."""
    vocabulary = segment_sampling.vocabulary(PIECES, 0.5)
    own = vocabulary.processor
    pieces = {own.id_to_piece(i): i for i in range(own.vocab_size()) if not (own.is_byte(i) or own.is_control(i) or own.is_unknown(i))}
    whole = "▁" + text.replace(" ", "▁")
    longest = max(map(len, pieces))
    edges = lambda i: [(k, vocabulary.log_weight[pieces[whole[i:k]]]) for k in range(i + 1, min(len(whole), i + longest) + 1) if whole[i:k] in pieces]
    single = lambda c: len(c.encode()) * vocabulary.log_weight[vocabulary.byte_ids[0]]
    total = [0.0] + [-np.inf] * len(whole)
    for i in range(len(whole)):
        found = edges(i)
        if whole[i] not in pieces:
            found.append((i + 1, single(whole[i])))
        for k, w in found:
            total[k] = np.logaddexp(total[k], total[i] + w)
    for ids, logp, _, _ in segment_sampling.sample_texts([text], np.array([5], np.uint64), PIECES, 0.5, 2)[0]:
        at, weight = 0, 0.0
        held = b""
        for i in np.frombuffer(ids, "<u4").tolist():
            if i in vocabulary.byte_ids:
                held += bytes([vocabulary.byte_ids.index(i)])
                weight += vocabulary.log_weight[vocabulary.byte_ids[0]]
                continue
            weight += vocabulary.log_weight[i]
        assert logp == pytest.approx(weight - total[-1], abs=1e-6)
        assert segment_sampling.decode(np.frombuffer(ids, "<u4"), PIECES) == text


def test_worker_caches_are_bounded_by_characters(monkeypatch):
    rng = np.random.default_rng(0)
    lines = ["".join(map(chr, rng.integers(0x4E00, 0x9000, 300))) for _ in range(400)]
    for module in (packing, token_counts, quality_classifier, toxicity):
        monkeypatch.setattr(module, "CACHE_CHARS", 20_000)
    encoder, spans, hasher, matcher = packing.WordEncoder(WORDS), token_counts.SpanEncoder(BYTES, public_tokenizers.PATTERN), quality_classifier.Hasher(), toxicity.Matcher({"idiot": 1.0})
    monkeypatch.setattr(segment_sampling, "CACHE_EDGES", 5_000)
    bank = segment_sampling._banks.setdefault((PIECES, 0.7), segment_sampling.Bank(segment_sampling.vocabulary(PIECES, 0.7)))
    held = lambda *kept: sum(len(w) for k in kept for w in k)
    whole = Tokenizer.from_file(WORDS)
    for line in lines:
        assert np.frombuffer(encoder.encode([line])[0], "<u4").tolist() == whole.encode(line, add_special_tokens=False).ids
        list(spans.spans([line]))
        hasher.vector(line)
        matcher.features(line)
        segment_sampling.sample_texts([line], np.array([1], np.uint64), PIECES, 0.7, 1)
        assert held(encoder.words, encoder.words.older) < 42_000 and held(spans.known, spans.older) < 42_000
        assert held(hasher.words) < 21_000 and held(matcher.plain) < 21_000 and bank.edges < 8_000


def test_rare_labels_are_not_lost(spark):
    assert toxicity.takes({0: 50, 1: 3}, 100) == {0: (50, 1.0), 1: (3, 1.0)}
    assert toxicity.takes({0: 6000, 1: 4000}, 100) == {0: (60, 1.0), 1: (40, 1.0)}
    for counts in ({0: 100_000, 1: 100}, {0: 10, 1: 5000}, {1: 500}, {0: 99_999, 1: 1}):
        found = toxicity.takes(counts, 100)
        assert sum(k for k, _ in found.values()) == 100 and found[1][0] >= min(counts[1], 5)
        shares = {y: k * w for y, (k, w) in found.items()}
        assert all(shares[y] / sum(shares.values()) == pytest.approx(counts[y] / sum(counts.values()), abs=0.006) for y in shares)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    labels = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 500 == 0).cast("int").alias("toxic"))
    rows = toxicity.labelled_sample(docs, labels, "toxic", F.lit(True), 100).collect()
    assert len(rows) == 100 and sum(r.label for r in rows) == 5 and {r.weight for r in rows if not r.label} != {1.0}
    x, y = np.array([[1.0, 0.0]] * 30 + [[1.0, 1.0]] * 10), np.array([0, 1] * 20)
    whole = toxicity.logistic(np.concatenate([x, x[:20]]), np.concatenate([y, y[:20]]), np.ones(60))
    assert toxicity.logistic(x, y, np.array([2.0] * 20 + [1.0] * 20)) == pytest.approx(whole, abs=1e-6)
