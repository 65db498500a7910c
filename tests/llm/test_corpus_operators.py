"""Near duplicates, extraction, nearest neighbours, sharding and the pipeline: brute force and odd rows."""

import html.parser
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("rasterloom.llm")
from pyspark.sql import functions as F

from rasterloom.llm import additive_quant, bag_minhash, html_extract, queries, sharding

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, node long, label int, class_id long"


def bag(text):
    words = text.split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def similarity(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if both else 0.0


def brute_classes(texts):
    """Class (least index) of each text: links of similarity 0.8 or equal texts, by comparing all pairs."""
    bags, parent = [bag(t or "") for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or "") or similarity(bags[i], bags[j]) >= 0.8:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def near_copies(seed, copies, most_edits, words=90):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(words)]
    out = []
    for k in range(copies):
        own = list(base)
        for _ in range(rng.randrange(most_edits + 1)):
            at = rng.randrange(len(own))
            own[at : at + rng.randrange(2)] = [f"e{seed}-{k}-{rng.randrange(3)}"] * rng.randrange(2)
        out.append(" ".join(own))
    return out


def classes(spark, texts):
    df = spark.createDataFrame([(i, t, "en", 0, 0, 0) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    found = {r.doc_id: r.class_id for r in bag_minhash.near_duplicates(df).collect()}
    return [found[i] for i in range(len(texts))]


def test_signature_is_unbiased():
    own = bag_minhash.Shingler()
    rng = np.random.default_rng(0)
    for a, b in (("a b c d e " * 100, "a b c d e " * 130), ("x y z q r s " * 3, "x y z q r t " * 3), (" ".join(map(str, rng.integers(0, 50, 200))), " ".join(map(str, rng.integers(0, 3, 200))))):
        one, two = own.bag(a), own.bag(b)
        signature = bag_minhash.signatures([one, two], 4000)
        want = similarity(bag(a), bag(b))
        assert bag_minhash.overlap(one, two) == pytest.approx(want)
        assert (signature[0] == signature[1]).mean() == pytest.approx(want, abs=0.03)
        assert (bag_minhash.signatures([two], 4000)[0] == signature[1]).all()


def test_edits_measure_similarity():
    own, rng = bag_minhash.Shingler(), random.Random(1)
    for _ in range(30):
        a, b, c = (" ".join(rng.choices("abcd", k=rng.randrange(3, 40))) for _ in range(3))
        x, y, z = (own.bag(t) for t in (a, b, c))
        dx, dy = set(bag_minhash.edits(x, z).tolist()), set(bag_minhash.edits(y, z).tolist())
        apart = sum((bag(a) - bag(b)).values()) + sum((bag(b) - bag(a)).values())
        assert len(dx ^ dy) == apart


@pytest.mark.parametrize("case", ["mixed", "one hot group", "two generations", "far group"])
def test_classes_against_all_pairs(spark, case):
    if case == "mixed":
        texts = [*near_copies(1, 6, 2), *near_copies(2, 9, 5), *near_copies(3, 4, 1, 12), *near_copies(2, 2, 0), "a b", "a b", "b a", "x", "", None, " ", "", *(" ".join(map(str, range(k, k + 30))) for k in range(12))]
    elif case == "one hot group":
        texts = near_copies(7, 130, 6)[1:]
    elif case == "two generations":
        first = near_copies(8, 40, 3)
        texts = [*first, *(t.replace(t.split()[10], "zz qq", 1) for t in first), *(" ".join(t.split()[6:]) for t in first)]
    else:
        rng = random.Random(4)
        shared = " ".join(f"s{rng.randrange(99)}" for _ in range(40))
        texts = [f"{shared} " + " ".join(f"o{k}-{rng.randrange(99)}" for _ in range(rng.randrange(4, 30))) for k in range(90)]
    assert classes(spark, texts) == brute_classes(texts)


def test_copies_with_odd_rows(spark):
    rows = [(1, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f"), (7, "other words in this text here"), (None, "null ids only"), (None, "null ids only"), (3, None), (4, "")]
    df = spark.createDataFrame([(i, t, "en", 0, 0, 0) for i, t in rows], SCHEMA)
    found = bag_minhash.near_duplicates(df).collect()
    assert Counter((r.doc_id, r.class_id) for r in found) == Counter([(1, 1), (None, 1), (7, 1), (7, 7), (None, None), (None, None), (3, 3), (4, 3)])
    kept = bag_minhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(1, "a b c d e f"), (7, "other words in this text here"), (0, "null ids only"), (3, None)], key=lambda x: (x[0], x[1] or ""))
    assert bag_minhash.near_duplicates(df.limit(0)).count() == 0 and bag_minhash.keep_one(df.limit(0)).count() == 0


def test_near_duplicate_query(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id)
    want = brute_classes([r.text for r in docs])
    found = {r.doc_id: r.class_id for r in queries.op4_bag_minhash(spark, SF).collect()}
    assert found == {r.doc_id: docs[w].doc_id for r, w in zip(docs, want, strict=True)}


@pytest.fixture(scope="module")
def model():
    return html_extract.train()


def test_extraction_of_made_up_pages(model):
    rng, right = random.Random(123), 0
    for _ in range(120):
        source, _ = html_extract.training_page(rng)
        page = html_extract.Page(source)
        kept = [False] * len(page.tags)
        for block, text, _ in page.pieces:
            kept[block] |= "​" in text
        for k in range(len(kept) - 1, 0, -1):
            kept[page.parents[k]] |= kept[k]
        right += html_extract.extract_texts([source.replace("​", "")], model)[0] == page.text(kept).replace("​", "")
    assert right >= 114


def test_extraction_rules(model):
    nav = '<nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav><script>var x = "<p>no</p>";</script>'
    foot = '<div class="comments"><h2>Comments</h2><div class="comment"><p>I liked this very much, thank you all.</p></div></div><footer><p>&copy; 2020 site</p></footer>'
    body = "<h1>A title</h1><p>First&nbsp;para <b>bo</b>ld &amp; &lt;kept&gt;,\n with  space.</p><p>Second one, which is a longer sentence about things.<br>Third line."
    found = html_extract.extract_texts([f"<html><head><title>x</title></head><body>{nav}<article>{body}</article>{foot}</body></html>"], model)[0]
    assert found == "A title First para bold & <kept>, with space. Second one, which is a longer sentence about things. Third line."


def test_decoding_has_no_contradictions(model):
    rng = random.Random(5)
    for _ in range(20):
        page = html_extract.Page(html_extract.training_page(rng)[0])
        kept = page.decode(np.random.default_rng(1).random(len(page.tags)))
        assert all(kept[page.parents[k]] for k in range(1, len(kept)) if kept[k])


def test_extraction_odd_rows(spark, model):
    rows = [(1, "u", None), (2, "u", ""), (None, None, "<p"), (4, "u", "<div>" * 20_000 + "deep"), (5, "u", "</p></div>< > <!-- open"), (6, "u", "plain words only"), (6, "u", "plain words only"), (7, "u", "<script>x")]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    found = html_extract.extract(df, model).collect()
    assert len(found) == len(rows) and all(r.text is not None for r in found) and html_extract.extract(df.limit(0), model).count() == 0
    assert {r.page_id: r.text for r in found}[1] == "" and [r.text for r in found if r.page_id == 6] == ["plain words only"] * 2


def test_extraction_query(spark):
    rows = queries.op7_html_extraction(spark, SF).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(pages) and all(r.n_chars == len(r.text) and r.text for r in rows)


def brute_nearest(ids, x, k=10):
    out = {}
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def test_neighbours_recall(spark):
    sf = "/root/testdata/sf0.1"
    t = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    want = brute_nearest(t.vec_id.to_numpy(), np.stack(t.embedding).astype(float))
    found = {}
    for r in sorted(queries.op9_additive_quantisation(spark, sf).collect(), key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(found) == set(want)
    hits = [len({i for i, _ in found[q]} & {i for i, _ in want[q]}) / 10 for q in want]
    assert np.mean(hits) >= 0.95
    for q, own in want.items():
        assert len(found[q]) == 10 and [s for _, s in found[q]] == sorted(s for _, s in found[q])
        assert all(s == pytest.approx(dict(own)[i], rel=1e-12) for i, s in found[q] if i in dict(own))


def test_neighbours_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (200, [0.0, 0.0]), (300, [nan, 1.0]), (400, None), (500, [inf, 1.0]), (600, [None, 1.0]), (None, [1.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (3, [2.0, 0.0]), (4, [1.0]), (5, [])]
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id long, embedding array<float>, rank int, score int")
    found = additive_quant.search(df, F.col("vec_id") % 100 == 0, block=3).collect()
    own = {q: [(r["rank"], r.vec_id, round(r.score, 6)) for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q] for q in {r.query_id for r in found}}
    assert own == {0: [(1, 1, 0.0), (2, 2, 0.0), (3, 3, 1.0), (4, 100, 1.414214)], 100: [(1, 0, 1.414214), (2, 1, 1.414214), (3, 2, 1.414214), (4, 3, 2.236068)]}
    assert additive_quant.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert additive_quant.search(df.where("vec_id = 3"), F.col("vec_id") % 100 == 0).count() == 0


def test_neighbours_recall_of_a_hundredth(spark):
    """Random vectors, the hardest case for codes: a shortlist of one row in a hundred of a table that the fit has not seen."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((16_000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = {}
    for r in additive_quant.search(df, F.col("vec_id") % 400 == 0, sample=4096).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for i in range(0, 16_000, 400):
        d = ((x.astype(float) - x[i]) ** 2).sum(1)
        d[i] = np.inf
        hits.append(len(found[i] & set(np.argsort(d, kind="stable")[:10].tolist())) / 10)
    assert np.mean(hits) >= 0.9


def test_neighbours_in_double_precision(spark):
    rng = np.random.default_rng(0)
    x = rng.random((300, 4))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, [1e300, 0.0, 0.0, 0.1]), (1001, [1e300, 0.0, 0.0, 0.2]), (1002, [1e-300, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute_nearest(np.arange(300), x)
    found = sorted(additive_quant.search(df, F.col("vec_id") % 100 == 0).collect(), key=lambda r: (r.query_id, r["rank"]))
    for q in (100, 200):
        own = [r for r in found if r.query_id == q]
        assert all(r.score == dict(want[q])[r.vec_id] for r in own if r.vec_id in dict(want[q])) and len({r.vec_id for r in own} & set(dict(want[q]))) >= 9
    assert [(r.vec_id, r.score) for r in found if r.query_id == 1000][0] == (1001, pytest.approx(0.1)) and len([r for r in found if r.query_id == 1000]) == 10
    cast = additive_quant.search(spark.createDataFrame([(100, [0.1]), (1, [0.4])], "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect()
    assert [(r.vec_id, r.score) for r in cast] == [(1, 0.4 - 0.1)]


def test_repeated_query_ids_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.random(3).tolist()) for i in range(40)] + [(0, [9.0, 9.0, 9.0]), (0, [0.5, 0.5, 0.5]), (5, [0.5, 0.5, 0.6]), (5, [8.0, 8.0, 8.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = [sorted(map(tuple, additive_quant.search(df.repartition(n), F.col("vec_id") % 100 == 0, block=16).collect())) for n in (3, 4, 5)]
    assert found[0] == found[1] == found[2] and len({r[2] for r in found[0]}) == len(found[0]) == 10
    asked = min(v for i, v in rows if i == 0)
    nearest = {}
    for i, v in rows:
        if i:
            nearest[i] = min(nearest.get(i, 99.0), float(np.sqrt(((np.array(v) - asked) ** 2).sum())))
    assert [(r[2], r[3]) for r in sorted(found[0], key=lambda r: r[1])] == [(i, pytest.approx(d)) for d, i in sorted((d, i) for i, d in nearest.items())[:10]]


def test_a_third_alike(spark):
    """More equal vectors than the shortlist holds."""
    rng = np.random.default_rng(0)
    rows = [(i, [0.5, 0.5, 0.5] if i % 3 == 0 else rng.random(3).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute_nearest(np.arange(600), np.array([np.float32(v) for _, v in rows]).astype(float))
    for r in additive_quant.search(df, F.col("vec_id") % 300 == 0).collect():
        assert want[r.query_id][r["rank"] - 1][0] == r.vec_id


def plain_directory(rows, limit, bits=60):
    """Extendible hashing row by row: split oversized buckets on the next bit; returns hash -> (depth, prefix)."""
    buckets, out = [(0, 0, rows)], {}
    while buckets:
        depth, prefix, own = buckets.pop()
        if sum(b for _, b in own) <= limit or len({h for h, _ in own}) == 1 or depth == bits:
            out |= {h: (depth, prefix) for h, _ in own}
            continue
        for bit in (0, 1):
            part = [(h, b) for h, b in own if h >> (bits - depth - 1) & 1 == bit]
            if part:
                buckets.append((depth + 1, prefix * 2 + bit, part))
    return out


@pytest.mark.parametrize(("limit", "step"), [(20_000, 3), (200_000, 12), (5_000, 2)])
def test_sharding_against_directory(spark, limit, step):
    import hashlib

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: (int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16), len(r.text.encode())) for r in docs.collect()}
    want = plain_directory(list(rows.values()), limit)
    found = sharding.shard(docs, limit, step).collect()
    assert {r.doc_id: (r.shard_depth, r.shard_prefix) for r in found} == {i: want[h] for i, (h, _) in rows.items()}
    shards = {}
    for r in found:
        shards.setdefault((r.shard_depth, r.shard_prefix, r.shard_page), []).append(r.doc_bytes)
    assert all(sum(b) <= limit or len(b) == 1 for b in shards.values())


def test_sharding_odd_rows(spark):
    rows = [(1, "x" * 40)] * 30 + [(None, None), (None, "y"), (2, ""), (3, "z" * 500), (4, "ü" * 10)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, hash int, bytes int").repartition(3)
    found = sharding.shard(df, 100, 2).collect()
    assert Counter(r.doc_id for r in found) == Counter(i for i, _ in rows)
    shards = {}
    for r in found:
        shards.setdefault((r.shard_depth, r.shard_prefix, r.shard_page), []).append(r.doc_bytes)
    assert all(sum(b) <= 100 or len(b) == 1 for b in shards.values())
    assert sharding.shard(df.limit(0), 100).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.keep_quality(spark, docs, SF)
    calm = corpus_pipeline.drop_toxic(spark, kept, SF)
    single = corpus_pipeline.drop_copies(spark, calm, SF)
    assert kept.columns == calm.columns == single.columns == docs.columns
    ids = [r.doc_id for r in single.collect()]
    calm_rows = sorted(calm.collect(), key=lambda r: r.doc_id)
    want = brute_classes([r.text for r in calm_rows])
    assert sorted(ids) == sorted({calm_rows[w].doc_id for w in want})
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {p.doc_id for p in pieces} == set(ids)
    assert all(zlib.crc32(p.ids) >= 0 and len(p.ids) == 4 * p.length for p in pieces)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "toxicity", "minhash near-dedup", "packing"]


@pytest.mark.parametrize(
    "source",
    [
        "<html><head><title>T</title><meta charset=x><article><p>one two</p><p>three four</article>",
        "<body><article><p>one two <svg class='i' /></p><math/><p>three four</p></article>",
        "<body><article><p>one two <button>no</p><p>three four</p></article>",
        "<body><article><div>one two<object data=x>no</div><div>three four</div></article>",
        "<body><article><p>one two <noscript><div>no</div></p><p>three four</p></article>",
        "<body><article><p>one two <option>no</p><p>three four</p></article>",
        "<body><article><p>one two <svg><title/><path/></svg></p><p>three four</p></article>",
        "<html><head><script>'<div>'</script></head><body><p>one two</p><p>three four</p>",
    ],
)
def test_open_elements_end_with_their_parent(source):
    page = html_extract.Page(source)
    assert page.text([True] * len(page.tags)) == "one two three four"


class PlainReader(html.parser.HTMLParser):
    """The text of the article element of a well-formed page, by the standard library's parser."""

    BREAKS = {"p", "div", "h1", "h2", "h3", "li", "ul", "ol", "br", "section", "blockquote", "table", "tr", "td", "article"}

    def __init__(self, source):
        super().__init__(convert_charrefs=True)
        self.out, self.depth, self.off = [], 0, []
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag in ("script", "style", "form", "aside", "nav") or dict(attrs).get("class") in ("ad", "comment", "comments", "share"):
            self.off.append([tag, 0])
        elif self.off and tag == self.off[-1][0]:
            self.off[-1][1] += 1
        if tag in self.BREAKS:
            self.out.append(" ")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        if self.off and tag == self.off[-1][0]:
            self.off[-1][1] -= 1
            if self.off[-1][1] < 0:
                self.off.pop()
        if tag in self.BREAKS:
            self.out.append(" ")

    def handle_data(self, data):
        if self.depth and not self.off:
            self.out.append(data)


def test_extraction_of_the_tables_pages(spark):
    """All pages of the tables, which no training saw, against the standard library's reading of their article."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    found = html_extract.extract_texts([r.html for r in pages], html_extract.train())
    whole = [(t, " ".join("".join(PlainReader(r.html).out).split())) for t, r in zip(found, pages, strict=True) if "<article" in r.html]
    assert len(whole) >= 0.5 * len(pages) and np.mean([a == b for a, b in whole]) >= 0.99


HAND_MADE = [
    ("""<!doctype html><title>Bread</title><body><div id=top class="site-header"><a href=/>Home</a> | <a href=/b>Blog</a></div>
<div id="content"><h1>Baking bread at home</h1><p>Mix the flour, the water and the salt, and let the dough rest for an hour.
<p>Bake it in a very hot oven until the crust is dark brown, and let it cool on a rack, since it goes on baking inside.</div>
<div class="sidebar"><h2>Popular</h2><ul><li><a href=/1>Ten soups</a><li><a href=/2>Cakes</a></ul></div>
<div id=footer>&copy; 2021 The kitchen</div>""",
     "Baking bread at home Mix the flour, the water and the salt, and let the dough rest for an hour. Bake it in a very hot oven until the crust is dark brown, and let it cool on a rack, since it goes on baking inside."),
    ("""<html><body><nav><ul><li><a href="/">Start</a></li><li><a href="/n">News</a></li></ul></nav><main data-id="sidebar" title="a > b, class='menu'">
<h1>River levels fall</h1><p data-role="navigation">The river fell by two metres in a week, the water board said, and boats can use the harbour again.</p>
<p>Farmers near the coast expect a good harvest &mdash; if the weather stays dry &amp; warm for another month.</p></main>
<form action="/search"><input name=q><button>Search the site</button></form><footer><p>Contact us</p></footer></body></html>""",
     "River levels fall The river fell by two metres in a week, the water board said, and boats can use the harbour again. Farmers near the coast expect a good harvest — if the weather stays dry & warm for another month."),
    ("""<body><article><h1>On maps</h1><p>A map shows less than the land it stands for, and that is what makes it useful to us.<p>An <svg viewBox='0 0 1 1'/> icon, an <math/> sign and a <b>bold</b> word do not end a text, nor do 3 < 4 and a &lt;tag&gt;.</article>
<section class="comments"><h2>Comments</h2><div class=comment><p>I do not agree with this at all, sorry.</div></section>""",
     "On maps A map shows less than the land it stands for, and that is what makes it useful to us. An icon, an sign and a bold word do not end a text, nor do 3 < 4 and a <tag>."),
]


@pytest.mark.parametrize(("source", "want"), HAND_MADE)
def test_extraction_of_hand_made_pages(model, source, want):
    assert html_extract.extract_texts([source], model)[0] == want


def test_tree_against_the_standard_parser():
    """Random well-formed pages: the same tags, parents and text as the standard library's parser gives."""
    rng = random.Random(8)
    blocks = ["div", "section", "ul", "table", "blockquote", "article"]

    def element(depth):
        tag = rng.choice(blocks)
        inner = "".join(rng.choice([lambda: f"w{rng.randrange(99)} ", lambda: element(depth + 1) if depth < 6 else "deep ", lambda: "<i>x</i> ", lambda: "<br>", lambda: "&amp; ", lambda: "<!-- <div> -->", lambda: "<script>'</div>'</script>"])() for _ in range(rng.randrange(5)))
        marks = rng.choice(["", " title='a > b'", ' data-x="</div>"', " hidden", " a=b/c"])
        return f"<{tag}{marks}>{inner}</{tag}>"

    class Tree(html.parser.HTMLParser):
        def __init__(self, source):
            super().__init__()
            self.tags, self.parents, self.open, self.words, self.raw = ["body"], [-1], [0], [], False
            self.feed(source)
            self.close()

        def handle_starttag(self, tag, attrs):
            self.raw = self.raw or tag == "script"
            if tag in blocks:
                self.tags.append(tag)
                self.parents.append(self.open[-1])
                self.open.append(len(self.tags) - 1)

        def handle_endtag(self, tag):
            self.raw = self.raw and tag != "script"
            if tag in blocks:
                self.open.pop()

        def handle_data(self, data):
            if not self.raw:
                self.words += [(self.open[-1], w) for w in data.split()]

    for _ in range(200):
        source = "<body>" + "".join(element(0) for _ in range(3)) + "</body>"
        page, tree = html_extract.Page(source), Tree(source)
        assert page.tags == tree.tags and page.parents == tree.parents
        words = [(b, w) for b, t, _ in page.pieces for w in t.replace("&amp;", "&").split()]
        assert words == tree.words


@pytest.mark.parametrize("source", ["<name " * 200_000, '<a x="' * 180_000, '<a x=">" ' * 120_000, "<div>" * 20_000 + "<td></td>" * 60_000, "<li><ul>" + "<div>" * 20_000 + "<li></li>" * 60_000, "<svg>" * 100_000, "<" * 600_000, "<a " + "=" * 900_000, "<!-" * 300_000, "<p " + "a " * 400_000 + ">x"])
def test_broken_markup_takes_linear_time(model, source):
    began = time.perf_counter()
    html_extract.extract_texts([source], model)
    assert time.perf_counter() - began < 10


def test_pipeline_with_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and ids, and columns with the operators' own names."""
    import corpus_pipeline

    good = "The house by the river is old and the people in it were kind to us, for that is how it was with them, and we ate %s."
    docs = [(i, good % f"dish {i} and dish {i + 1}") for i in range(30)]
    docs += [(3, docs[3][1]), (77, docs[5][1]), (None, good % "nothing"), (80, None), (81, ""), (82, " "), (83, "word " * 40_000), (84, " ".join(f"the w{k} of it" for k in range(30_000)))]
    docs += [(90 + i, (good % f"soup {i}") + " you stupid idiot, you are worthless scum and a pathetic loser.") for i in range(20)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, node long, label int, class_id long, score double, kept boolean, keys string"
    folder = str(tmp_path)
    df = spark.createDataFrame([(i, t, "en", "s", 1, 0, 0, 0, 0.0, True, "k") for i, t in docs], schema)
    labels = spark.createDataFrame([(i, 1, int(i >= 90)) for i, _ in docs if i is not None] + [(999, 1, 1), (None, 0, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    df.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality rules"](spark, df, folder)
    calm = stages["toxicity"](spark, kept, folder)
    single = stages["minhash near-dedup"](spark, calm, folder)
    assert kept.columns == calm.columns == single.columns == df.columns
    ids = lambda d: Counter(r.doc_id for r in d.collect())
    assert not set(ids(kept)) & {80, 81, 82, 83} and ids(kept)[3] == 2 and ids(kept)[84] == 1 and ids(kept)[None] == 1
    assert not any(i is not None and 90 <= i < 120 for i in ids(calm)) and ids(calm)[0] == 1
    rows = calm.collect()
    want = brute_classes([r.text for r in rows])
    assert sum(ids(single).values()) == len(set(want)) and 84 in ids(single) and 77 not in ids(single)
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert Counter(p.doc_id for p in pieces if p.start == 0) == ids(single)
    empty = f"{folder}/empty"
    df.limit(0).write.parquet(f"{empty}/documents.parquet")
    labels.limit(0).write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), empty).count() == 0
