"""Merkle manifest, periodic runs and language mixtures: plain recomputation, brute force, held-out accuracy, odd rows."""

import hashlib
import random
import zlib
from glob import glob

import duckdb
import numpy as np
import pytest

pytest.importorskip("rasterloom.llm")
from pyspark.sql import functions as F

from rasterloom.llm import language_mixture, merkle_manifest, period_runs, queries
from rasterloom.llm.period_runs import find_runs, looped, periodic_runs

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, pos long, g string, runs int, languages string, score double"
ODD = [None, "", " ", "\n\n", "a", "x " * 3_000, "ü" * 5_000, "It's  a\ttest.\n\nNew line!  中文 😀😀 é x ΣΑΣ İ", "same text Here again", "same text Here again", "\x00 \x0b\x85\xa0 odd   1234 --", "12 34 --"]


def odd_rows():
    rows = [(i if i != 4 else None, t, None if i in (2, 3) else "en" if i % 2 else "ü", None if i % 3 else "s", None if i == 6 else len(t or ""), "l", 0, "g", 1, "x", 0.5) for i, t in enumerate(ODD)]
    return [*rows, rows[3], rows[3], (3, "other", None, "s", 1, "l", 0, "g", 1, "x", 0.5)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def ascii_lower(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def up(nodes):
    """Levels of a tree of hex digests."""
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([sha("".join(found[-1][k : k + 8])) for k in range(0, len(found[-1]), 8)])
    return found


def plain_manifest(rows):
    """The contract, row by row: sorted result rows."""
    groups = {}
    for r in rows:
        leaf = sha("".join(map(field, (r.doc_id, r.source, r.lang, r.n_chars, r.text))))
        changed = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
        shown = sha("".join(map(field, (r.doc_id, r.source, r.lang, r.n_chars, ascii_lower(r.text) if changed else r.text))))
        groups.setdefault(r.lang, []).append((r.doc_id is not None, r.doc_id or 0, leaf, shown))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: up([x[2] for x in sorted(groups[g])]) for g in names}
    top = up([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, (there, doc_id, leaf, shown) in enumerate(sorted(groups[g])):
            node, proof = shown, ""
            for levels, at in ((trees[g], i), (top, k)):
                for level in levels[:-1]:
                    start = at - at % 8
                    left, right = "".join(level[start:at]), "".join(level[at + 1 : start + 8])
                    node, proof, at = sha(left + node + right), proof + left + right, at // 8
            out.append((doc_id if there else -1, leaf, trees[g][-1][0], top[-1][0], sha(proof), node, node == top[-1][0]))
    return sorted(out)


def manifest(docs, step=merkle_manifest.STEP):
    rows = merkle_manifest.verify(docs, merkle_manifest.lower_cased(F.col("doc_id")), step=step).collect()
    return sorted((-1 if r.doc_id is None else r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in rows)


def test_manifest_odd_rows(odd):
    found = manifest(odd)
    assert found == plain_manifest(odd.collect()) and len(found) == len(ODD) + 3
    assert {r[-1] for r in found} == {True, False}


@pytest.mark.parametrize("step", [1, 2])
def test_manifest_in_many_rounds(spark, docs, step):
    """Small blocks, so that languages take several rounds, and many languages, so that the upper tree does too."""
    some = docs.limit(140).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.concat("lang", F.col("doc_id") % 30)).otherwise(F.col("lang")))
    some = spark.createDataFrame(some.collect(), some.schema).repartition(4)
    assert manifest(some, step) == plain_manifest(some.collect())


def test_manifest_small_tables(spark, odd):
    assert merkle_manifest.verify(odd.limit(0), F.lit(False)).count() == 0
    one = spark.createDataFrame([(7, "Text", "en", "s", 4)], "doc_id long, text string, lang string, source string, n_chars long")
    (row,) = merkle_manifest.verify(one, F.lit(True)).collect()
    assert row.leaf == row.subroot == row.root != row.folded_root and row.proof_sha256 == sha("") and not row.verified


def test_manifest_leaves_two_tables(spark, docs):
    """The ranked leaves and the paths of their blocks; all others are deleted."""
    from rasterloom.sources import scratch

    here = lambda: set(glob(f"{scratch.work_folder(spark, 'x').rsplit('/', 1)[0].removeprefix('file://')}/*"))
    before = here()
    merkle_manifest.verify(docs, F.lit(False), step=1)
    assert sorted(p.rsplit("/", 1)[1].split("-")[0] for p in here() - before) == ["paths", "ranked"]


def test_manifest_of_a_third_alike(spark):
    """Copies of one row are dealt over ranges; every copy is a leaf."""
    rows = spark.range(900).select(F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id")).alias("doc_id"), F.lit("Same").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(4).alias("n_chars"))
    assert manifest(rows) == plain_manifest(rows.collect())


def test_manifest_equals_sql(spark):
    con = duckdb.connect()
    for path in glob(f"{SF}/*.parquet"):
        con.execute(f"create view {path.rsplit('/', 1)[1][:-8]} as select * from '{path}'")
    theirs = con.execute(queries.SQL["op11_merkle_manifest"]).df()
    ours = queries.QUERIES["op11_merkle_manifest"](spark, SF).toPandas()
    assert len(ours) == spark.read.parquet(f"{SF}/documents.parquet").count()
    key = ["doc_id", "leaf"]
    assert ours.sort_values(key).reset_index(drop=True)[sorted(ours)].equals(theirs.sort_values(key).reset_index(drop=True)[sorted(ours)])


# --- runs


def brute_runs(words, least=6, times=4):
    n, out = len(words), {}
    for q in range(1, n // times + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            if j - i + q >= max(least, times * q):
                out.setdefault((i - q, j - i + q), q)  # the least period comes first
            i = j
    return sorted(((a, n, q) for (a, n), q in out.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize(("least", "times"), [(6, 4), (2, 2), (4, 3), (1, 2)])
def test_runs_against_all_periods(least, times):
    rng = random.Random(least * 10 + times)
    for _ in range(800):
        size, letters, words = rng.randint(0, 70), rng.choice([1, 2, 3, 5]), []
        while len(words) < size:
            words += [rng.randrange(letters) for _ in range(rng.randint(1, 6))] * rng.choice([1, 1, 2, 3, 4, 5, 7])
        words = words[:size]
        assert find_runs([[b"%d" % w for w in words]], least, times) == [brute_runs(words, least, times)]


def test_runs_of_several_texts_stay_apart():
    text = [b"a"] * 5
    assert find_runs([text, text, text + [b"a"], []]) == [[], [], [(0, 6, 1)], []]


def test_runs_of_long_texts():
    for words, want in (([0] * 30_000, [(0, 30_000, 1)]), (list(range(7_000)) * 4, [(0, 28_000, 7_000)]), (([0] * 9 + [1]) * 2_000, None)):
        found = find_runs([[b"%d" % w for w in words]])[0]
        assert found == want if want else len(found) == 2_001 and (0, 20_000, 10) in found


def plain_periods(doc_id, text):
    """The contract for one document."""
    words = [w for w in (text or "").translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w]
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-(10**9 * r[1] // r[2]), r[0], r[2])) if runs else (None,) * 3
    gone = {k for a, m, q in runs for k in range(a + q, a + m)}
    listed = "".join(f"{a},{m},{q}\n" for a, m, q in runs)
    kept = " ".join(w for k, w in enumerate(words) if k not in gone)
    return len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], sha(listed), sha(kept)


def test_runs_query_against_brute_force(spark, docs, tmp_path):
    docs.unionByName(docs.selectExpr("doc_id + 1000000 AS doc_id", "concat(substring(text, 1, 400), repeat(' again', doc_id % 9)) AS text", "lang", "source", "n_chars")).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES["op12_period_runs"](spark, str(tmp_path)).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}
    assert len(found) == len(texts)
    for r in found:
        assert tuple(r)[1:] == plain_periods(r.doc_id, texts[r.doc_id])
    assert sum(r.n_runs > 0 for r in found) > 20


def test_runs_odd_rows(odd):
    found = periodic_runs(odd, loop=True)
    want = sorted(((r.doc_id, plain_periods(r.doc_id, r.text)) for r in odd.collect()), key=repr)
    got = sorted(((r.doc_id, (r.n_runs, r.start, r.length, r.period, r.exponent_milli, sha("".join(f"{a},{n},{q}\n" for a, n, q in r.runs)), hashlib.sha256(r.collapsed).hexdigest())) for r in found.collect()), key=repr)
    assert got == want
    assert periodic_runs(odd.limit(0)).count() == 0


def test_looped_words():
    words = [b"%d" % k for k in range(17)]
    for h in range(0, 4_000, 10):
        a, g = h // 10 % 17, h // 10
        p = 1 + (17 - a) // (3 + g % 8)
        assert looped(words, 17, h) == [words[i] if i < a else words[a + (i - a) % p] for i in range(17)]


# --- languages


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.QUERIES["op13_language_mixture"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held, right = found.where("held_out").agg(F.count("*"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert held > 250 and right > 0.99
    assert found.where("score < 0 OR score > 1 OR score IS NULL").count() == 0


def plain_shares(likely):
    """EM for one text, a word at a time."""
    shares = np.full(likely.shape[1], 1 / likely.shape[1])
    for _ in range(language_mixture.MOST_STEPS):
        new = np.zeros_like(shares)
        for word in likely:
            new += shares * word / (shares * word).sum() / len(likely)
        moved, shares = np.abs(new - shares).max(), new
        if moved <= language_mixture.STILL:
            break
    return shares


def test_em_against_a_plain_loop():
    rng = np.random.default_rng(4)
    sizes = np.array([1, 7, 40, 3])
    likely = rng.random((sizes.sum(), 3)) ** 3 + 1e-3
    shares, fit = language_mixture.em(likely, sizes, np.ones((4, 3), bool))
    for k, part in enumerate(np.split(likely, np.cumsum(sizes)[:-1])):
        assert np.allclose(shares[k], plain_shares(part), atol=1e-9)
        assert fit[k] <= np.log(part @ shares[k]).sum() + 1e-9  # the likelihood grows with the last step, too


@pytest.fixture(scope="module")
def model(spark, docs):
    return language_mixture.language_model(docs, F.lit(True))


def test_mixtures_of_two_languages(spark, docs, model):
    by_lang = {k: [r.text for r in docs.where(F.col("lang") == k).limit(4).collect()] for k in ("en", "fr", "de")}
    identifier = language_mixture.Identifier(model)
    pure, _ = identifier.mixtures([t for texts in by_lang.values() for t in texts])
    assert [m[0][0] for m in pure] == ["en"] * 4 + ["fr"] * 4 + ["de"] * 4
    cut = lambda t, n: " ".join(t.split()[:n])
    (mixed,), _ = identifier.mixtures([cut(" ".join(by_lang["en"]), 200) + "\n" + cut(" ".join(by_lang["de"]), 100)])
    assert [a for a, _ in mixed] == ["en", "de"] and abs(mixed[0][1] - 2 / 3) < 0.1 and abs(sum(s for _, s in mixed) - 1) < 0.01


def test_likelihood_of_a_word_is_a_product(model):
    identifier = language_mixture.Identifier(model)
    groups, starts, sizes = language_mixture.letter_groups(["Then the, ô-9x"])
    assert sizes.tolist() == [4]
    log_p = dict(zip(identifier.codes[:-1].tolist(), identifier.log_p[:-1].tolist(), strict=True))
    code = lambda a, b, c: (a << 42) | (b << 21) | c
    want = []
    for word in ("then", "the", "ô", "x"):
        chars = [0, 0, *map(ord, word), 0]
        rows = [log_p.get(code(*chars[k : k + 3]), [0.0] * len(identifier.languages)) for k in range(len(word) + 1)]
        total = np.sum(rows, axis=0)
        want.append(np.exp(np.maximum(total - total.max(), -language_mixture.DOUBT)))
    assert np.allclose(identifier.word_likelihoods(groups, starts), want, atol=1e-5)


def test_languages_odd_rows(spark, odd, model):
    found = language_mixture.identify(odd, model).collect()
    assert len(found) == len(ODD) + 3
    texts = {r.doc_id: r.text for r in odd.where("doc_id <> 3 OR text <> 'other'").collect()}
    for r in found:
        letters = any(map(str.isalpha, texts[r.doc_id] or "")) or r.doc_id == 3
        assert 0 <= r.score <= 1 and ((r.lang_pred == "und") == (not r.languages))
        assert letters or (r.lang_pred, r.score) == ("und", 0.0)
    assert language_mixture.identify(odd.limit(0), model).count() == 0
    nothing = language_mixture.language_model(odd, F.lit(False))
    assert {r.lang_pred for r in language_mixture.identify(odd, nothing).collect()} == {"und"}
    own = language_mixture.language_model(odd, F.lit(True))
    assert {r.lang_pred for r in language_mixture.identify(odd, own).collect()} == {"und", "en", "ü"}


def test_language_sample_is_bounded(spark):
    """A language that holds nearly all rows, and an id that holds a third of them, do not make the sample grow."""
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("the words of "), F.col("id")).alias("text"), F.when(F.col("id") % 500 == 1, "xx").otherwise("en").alias("lang"))
    seen = {}
    model = language_mixture.fit

    def counted(rows):
        return b"%d %d" % (sum(r[2] == "en" for r in rows), sum(r[2] == "xx" for r in rows))

    language_mixture.fit = counted
    try:
        seen = language_mixture.language_model(rows, F.lit(True), per_language=100).split()
    finally:
        language_mixture.fit = model
    assert 60 <= int(seen[0]) <= 100 and 20 <= int(seen[1]) <= 40
