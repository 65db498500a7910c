"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

A page is read into a tree of its block elements; inline elements only lend their text (and links) to the block around
them.  Every block gets features: its tag, tokens of its class, id and role, depth, text and link density of its subtree,
what its ancestors are, and statistics of its siblings.  Boosted trees give the probability that a block holds main text.
Decoding keeps a block only if all its ancestors are kept: from the leaves up, each node adds the log probability of
being kept to the better choice of every child, or the log probability of being dropped to the dropping of them all.

The trees are trained here on a bounded set of pages that `training_page` makes up from layout words; no page of the
input is used for training, so a page's text never depends on other rows.

Defined results: a null or empty page gives an empty text; scripts, styles, heads and form controls never give text;
text outside any element counts as the body's; broken markup is read as far as it goes (unclosed elements end with their
parent, an unclosed head with the first text or element that cannot stand in it, unclosed scripts, styles, titles, text
areas and frames with the page, as in browsers; stray end tags are skipped; a tag without an end is text); repeated rows
give equal texts; very long pages are read whole, without recursion and in time linear in their length; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import pickle
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import slices

#: Elements that make blocks, elements without content, elements whose content is never text.
BLOCKS = frozenset(
    "html body div p section article main header footer nav aside ul ol li dl dt dd table thead tbody tfoot tr td th "
    "caption form fieldset blockquote pre figure figcaption h1 h2 h3 h4 h5 h6 address details summary dialog center".split()
)
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
RAW = "script style iframe textarea title"
HIDDEN = frozenset("noscript template svg object select button option canvas video audio math datalist".split())
#: Elements whose start tag may also be their end, and elements that a head may hold.
FOREIGN = ("svg", "math")
IN_HEAD = frozenset("base basefont bgsound link meta noscript template".split())
#: Elements that a start tag of the same kind closes, and where that search ends.
SELF_CLOSING = {"p": "", "li": "ul ol", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table"}

#: What follows a tag's name up to its end; a quotation mark opens a value only after an equals sign.  No part of the
#: pattern gives back what it took, so a tag is read in one pass.
_REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I) for name in RAW.split()}
_EMPTY = re.compile(r"[^<>]*+/>")
#: One attribute after the other, so that a name inside another attribute's value is not taken for one.
_ATTRIBUTE = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?+|["'=]""")
_WORD = re.compile(r"[a-z]+")

#: Words of class, id and role attributes, by what they usually mark.
TOKENS = {
    "main": "article content main post entry body story text page single blogpost maincontent news read prose",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc tabs pagination pager links sitemap topbar toolbar",
    "head": "header masthead banner logo brand hero top",
    "foot": "footer foot bottom copyright legal colophon",
    "side": "sidebar side aside rail widget widgets related recommended more teaser popular trending secondary complementary",
    "advert": "ad ads advert advertisement advertising sponsor sponsored promo promoted adslot adbox dfp commercial",
    "notice": "cookie cookies consent gdpr notice notification alert popup modal overlay dialog privacy paywall",
    "form": "form search login signup subscribe newsletter register contact signin",
    "comment": "comment comments commentlist reply replies discussion disqus respond reader responses feedback",
    "share": "share social follow sharing tags tag byline meta author",
}
_GROUP = {w: k for k, words in enumerate(TOKENS.values()) for w in words.split()}
_TAGS = ["p", "div", "section", "article", "main", "header", "footer", "nav", "aside", "ul", "li", "table", "form", "h1", "h2", "body", "blockquote", "figure"]
_TAG = {t: k for k, t in enumerate(_TAGS)}
_BAD_TAGS = frozenset("nav header footer aside form dialog".split())
N_FEATURES = len(_TAGS) + 2 * len(TOKENS) + 16


def tokens(source: str) -> Iterator[tuple[str, str, str]]:
    """Tokens of a page: ("text", text, ""), ("open", name, attributes) and ("close", name, "").

    Comments, declarations and the content of raw elements are left out.  The work is linear in the page: every scan that
    finds nothing is the last of its kind.  If a tag's quotes leave it open up to the page's end, from there on the first
    ">" ends a tag; a "<" without any ">" behind it is text.
    """
    at, size, quoted, ends, foreign = 0, len(source), True, True, 0
    while at < size:
        start = source.find("<", at)
        if start < 0:
            start = size
        if start > at:
            yield "text", source[at:start], ""
            at = start
            continue
        if source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            at = end + 3 if end >= 0 else size
            continue
        if source[at + 1 : at + 2] in ("!", "?") and ends:
            end = source.find(">", at)
            ends = end >= 0
            if ends:
                at = end + 1
                continue
        closing = source[at + 1 : at + 2] == "/"
        name = _NAME.match(source, at + 1 + closing) if ends else None
        rest = None
        if name is not None:
            rest = _REST.match(source, name.end()) if quoted else None
            if rest is None:
                quoted = False
                end = source.find(">", name.end())
                ends = end >= 0
        if name is None or not ends:
            yield "text", "<", ""
            at += 1
            continue
        at = rest.end() if rest else end + 1
        tag, attributes = name.group().lower(), source[name.end() : at - 1]
        if closing:
            foreign -= tag in FOREIGN and foreign > 0
            yield "close", tag, ""
            continue
        if tag in FOREIGN and not attributes.endswith("/"):
            foreign += 1
        if tag in _RAW_END and not (foreign and attributes.endswith("/")):
            end_tag = _RAW_END[tag].search(source, at)
            at = end_tag.end() if end_tag else size
            continue
        yield "open", tag, attributes


class Page:
    """Block elements in document order with their parents, and pieces of text with their block."""

    def __init__(self, source: str):
        self.tags, self.parents, self.groups = ["body"], [-1], [0]
        self.pieces: list[tuple[int, str, bool]] = []  # block, raw text, inside a link; an empty text parts blocks
        self.stack = [0]
        self.places: dict[str, list[int]] = {}  # for each tag the places of its open elements in the stack
        linked, in_head = 0, False
        hidden: list[str] = []  # a hidden element that is open, and the elements open inside it
        inside = Counter()  # the same by name
        tags, pieces, stack = self.tags, self.pieces, self.stack
        for kind, name, attributes in tokens(source):
            if kind == "text":
                if in_head and not name.isspace():
                    in_head = False
                if not hidden and not in_head:
                    pieces.append((stack[-1], name, linked > 0))
                continue
            opens = kind == "open"
            if name == "head":
                in_head = opens and len(tags) == 1 and not hidden
                continue
            if in_head and opens and not hidden and name not in IN_HEAD:
                in_head = False
            empty = name in FOREIGN and attributes.endswith("/")
            if hidden:
                if opens:
                    if (name in BLOCKS or name in HIDDEN) and not empty:
                        hidden.append(name)
                        inside[name] += 1
                    continue
                if inside[name]:
                    while (gone := hidden.pop()) != name:
                        inside[gone] -= 1
                    inside[name] -= 1
                    continue
                if name not in ("html", "body") and not self.places.get(name):
                    continue
                hidden, inside = [], Counter()  # the parent closes
            if name in HIDDEN:
                if opens and not empty:
                    hidden, inside = [name], Counter([name])
                continue
            if name not in BLOCKS:
                if name == "a":
                    linked = int(opens)
                elif name in ("br", "hr"):
                    pieces.append((stack[-1], "", False))
                continue
            linked = 0
            if name in ("html", "body"):
                if opens and name == "body":
                    self.groups[0] |= _groups(attributes)
                continue
            if not opens:
                if places := self.places.get(name):
                    self._close(places[-1])
                pieces.append((stack[-1], "", False))
                continue
            if tags[stack[-1]] == "p" and len(stack) > 1:
                self._close(len(stack) - 1)
            if name in SELF_CLOSING and (places := self.places.get(name)):
                ends = SELF_CLOSING[name].split()
                if places[-1] > max((self.places[e][-1] for e in ends if self.places.get(e)), default=0) and (ends or places[-1] == len(stack) - 1):
                    self._close(places[-1])
            tags.append(name)
            self.parents.append(stack[-1])
            self.groups.append(_groups(attributes))
            self.places.setdefault(name, []).append(len(stack))
            stack.append(len(tags) - 1)
            pieces.append((stack[-1], "", False))

    def _close(self, place: int) -> None:
        """Takes the element at a place of the stack and all that are open in it off the stack."""
        while len(self.stack) > place:
            self.places[self.tags[self.stack.pop()]].pop()

    def features(self) -> np.ndarray:
        """A row for each block."""
        n = len(self.tags)
        own, links, stops = [0] * n, [0] * n, [0] * n
        for block, text, linked in self.pieces:
            size = len(text) - text.count(" ") - text.count("\n")
            own[block] += size
            if linked:
                links[block] += size
            stops[block] += text.count(".") + text.count(",")
        total, all_links, all_stops = own[:], links[:], stops[:]
        below, paragraphs, children, heads = [1] * n, [0] * n, [0] * n, [0] * n
        parents, tags = self.parents, self.tags
        for k in range(n - 1, 0, -1):
            p = parents[k]
            total[p] += total[k]
            all_links[p] += all_links[k]
            all_stops[p] += all_stops[k]
            below[p] += below[k]
            paragraphs[p] += paragraphs[k] + (tags[k] == "p")
            heads[p] += heads[k] + (tags[k] in ("h1", "h2"))
            children[p] += 1
        depth, above, bad_above, good_above, place = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
        alike: dict[tuple[int, str], int] = {}  # siblings of one tag, and the text in them
        alike_text: dict[tuple[int, str], int] = {}
        siblings = [0] * n
        for k in range(1, n):
            p = parents[k]
            depth[k] = depth[p] + 1
            above[k] = above[p] | self.groups[p]
            bad_above[k] = bad_above[p] or tags[p] in _BAD_TAGS
            good_above[k] = good_above[p] or tags[p] in ("article", "main")
            alike[p, tags[k]] = alike.get((p, tags[k]), 0) + 1
            alike_text[p, tags[k]] = alike_text.get((p, tags[k]), 0) + total[k]
            place[k] = siblings[p]
            siblings[p] += 1
        has_article = any(t in ("article", "main") for t in tags)
        out = np.zeros((n, N_FEATURES), np.float32)
        whole = max(1, total[0])
        for k in range(n):
            p = max(parents[k], 0)
            if (t := _TAG.get(tags[k])) is not None:
                out[k, t] = 1
            for g in range(len(TOKENS)):
                if self.groups[k] >> g & 1:
                    out[k, len(_TAGS) + g] = 1
                if above[k] >> g & 1:
                    out[k, len(_TAGS) + len(TOKENS) + g] = 1
            count, chars = alike.get((parents[k], tags[k]), 1), alike_text.get((parents[k], tags[k]), total[k])
            size = max(1, total[k])
            out[k, -16:] = (
                math.log1p(total[k]), math.log1p(own[k]), all_links[k] / size, all_stops[k] / size, total[k] / below[k] / 100, depth[k],
                total[k] / whole, total[k] / max(1, total[p]), min(place[k], 30), min(count, 30), math.log1p(chars / max(1, count)),
                paragraphs[k], children[k], bad_above[k], good_above[k] + 2 * has_article, heads[k],
            )
        return out

    def text(self, kept: list[bool]) -> str:
        parts = [html.unescape(text) if text else " " for block, text, _ in self._joined(kept)]
        return " ".join("".join(parts).split())

    def _joined(self, kept: list[bool]) -> Iterator[tuple[int, str, bool]]:
        last = -1
        for block, text, linked in self.pieces:
            if block != last:
                yield block, "", False
                last = block
            if kept[block]:
                yield block, text, linked

    def decode(self, p: np.ndarray) -> list[bool]:
        """The likeliest choice of blocks such that a kept block's parent is kept."""
        n = len(self.tags)
        q = np.clip(p, 1e-4, 1 - 1e-4)
        keep, drop = np.log(q).tolist(), np.log1p(-q).tolist()
        for k in range(n - 1, 0, -1):
            above = self.parents[k]
            keep[above] += max(keep[k], drop[k])
            drop[above] += drop[k]
        kept = [True] * n  # the body is kept: a page without any kept block is empty anyway
        for k in range(1, n):
            kept[k] = kept[self.parents[k]] and keep[k] > drop[k]
        return kept


def _groups(attributes: str) -> int:
    """The groups of marks in the class, id and role of a tag, as bits."""
    return _marked(attributes) if len(attributes) <= 200 else _marked.__wrapped__(attributes)


@lru_cache(maxsize=50_000)
def _marked(attributes: str) -> int:
    found = 0
    for m in _ATTRIBUTE.finditer(attributes):
        if m.group(1) and m.group(2) and m.group(1).lower() in ("class", "id", "role"):
            for w in _WORD.findall(m.group(2).lower()):
                if (g := _GROUP.get(w)) is not None:
                    found |= 1 << g
    return found


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 24) -> dict:
    """Gradient-boosted trees for the logistic loss, by histograms; each tree is three arrays in heap order."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    start = float(np.log(y.mean() / (1 - y.mean())))
    score, forest = np.full(len(y), start), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        feature, cut, value = np.full(2**depth - 1, -1), np.zeros(2**depth - 1), np.zeros(2 ** (depth + 1) - 1)
        node = np.zeros(len(y), np.int64)
        for k in range(2 ** (depth + 1) - 1):
            rows = np.flatnonzero(node == k)
            if not len(rows):
                continue
            gs, hs = g[rows].sum(), h[rows].sum()
            value[k] = rate * gs / (hs + 1.0)
            if k >= 2**depth - 1 or len(rows) < 20:
                continue
            best = 1e-3
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                b = binned[rows, j]
                gl = np.cumsum(np.bincount(b, g[rows], len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, h[rows], len(c) + 1))[:-1]
                gain = gl**2 / (hl + 1.0) + (gs - gl) ** 2 / (hs - hl + 1.0) - gs**2 / (hs + 1.0)
                i = int(np.argmax(gain))
                if gain[i] > best:
                    best, feature[k], cut[k] = gain[i], j, c[i]
            if feature[k] >= 0:
                node[rows] = 2 * k + 1 + (x[rows, feature[k]] > cut[k])
        score += value[node]
        forest.append((feature, cut, value))
    return {"start": start, "depth": depth, "forest": forest}


def probabilities(model: dict, x: np.ndarray) -> np.ndarray:
    score, rows = np.full(len(x), model["start"]), np.arange(len(x))
    for feature, cut, value in model["forest"]:
        node = np.zeros(len(x), np.int64)
        for _ in range(model["depth"]):
            inner = node < len(feature)
            f = np.where(inner, feature[np.minimum(node, len(feature) - 1)], -1)
            right = x[rows, np.maximum(f, 0)] > cut[np.minimum(node, len(feature) - 1)]
            node = np.where(f >= 0, 2 * node + 1 + right, node)
        score += value[node]
    return 1 / (1 + np.exp(-score))


def training_page(rng: random.Random) -> tuple[str, str]:
    """A made-up page and its main text: a body with a varying layout of regions around an article."""
    syllables = [rng.choice("bcdfghklmnprstvwäñé") + rng.choice("aeiouyüó") + rng.choice(["", "n", "r", "s", "t"]) for _ in range(30)]
    word = lambda: "".join(rng.choices(syllables, k=rng.choice((1, 1, 2, 2, 3)))) + rng.choice(["", "", "", "", ",", ".", "***", "%%%"] if odd else ["", "", "", "", "", ",", "."])
    odd = rng.random() < 0.15
    words = lambda low, high: " ".join(word() for _ in range(rng.randint(low, high)))

    def marks(group: str) -> str:
        own = rng.choice(TOKENS[group].split())
        return rng.choice([f' class="{own}"', f' id="{own}"', f' class="{own} {rng.choice(["box", "wrap", "row", "x1"])}"', f' class="site-{own}"'])

    def inline(text: str) -> str:
        return rng.choice([text, f"<b>{text}</b>", f"<b>{text}", f'{text} <a href="/x">{word()}</a>', f"<em>{text}</em>"]) if rng.random() < 0.3 else text

    def bad(group: str) -> str:
        tag = {"menu": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form"}.get(group)
        plain = tag is None or rng.random() < 0.5
        opening = f"div{marks(group)}" if plain else tag + (marks(group) if rng.random() < 0.5 else "")
        if group in ("menu", "side") and rng.random() < 0.8:
            items = "".join(f'<li><a href="/{word()}">{words(1, 4)}</a>{rng.choice(["</li>", ""])}' for _ in range(rng.randint(2, 12)))
            inner = f"{rng.choice(['', f'<h2>{words(1, 3)}</h2>'])}<ul>{items}</ul>"
        elif group == "form":
            inner = f'<label>{words(1, 4)}</label><input name="q"><p>{words(2, 10)}</p><button>{word()}</button>'
        elif group == "comment":
            inner = f"<h2>{words(1, 3)}</h2>" + "".join(f'<div class="comment"><p>{words(4, 60)}</p></div>' for _ in range(rng.randint(1, 8)))
        else:
            inner = rng.choice([f"<p>{words(3, 40)}</p>", words(3, 40), f"<p>&copy; {words(2, 12)} &middot; {words(1, 20)}", f'<a href="/">{words(1, 3)}</a>', f"<h2>{words(1, 4)}</h2><p>{words(3, 25)}</p>"])
        return f"<{opening}>{inner}</{opening.split()[0].split('>')[0]}>"

    parts, count = [], rng.randint(1, 14)
    parts.append(f"<h1>{words(2, 12)}</h1>" if rng.random() < 0.8 else "")
    for _ in range(count):
        kind = rng.random()
        if kind < 0.75:
            parts.append(f"<p>{inline(words(1, 90))}{rng.choice(['</p>', '</p>', '<br>'])}")
        elif kind < 0.83:
            parts.append(f"<h2>{words(1, 6)}</h2>")
        elif kind < 0.9:
            parts.append("<ul>" + "".join(f"<li>{words(2, 25)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>")
        elif kind < 0.95:
            parts.append(f"<blockquote><p>{words(4, 40)}</p></blockquote>")
        else:
            parts.append(f"<table><tr><td>{words(1, 8)}</td><td>{words(1, 8)}</td></tr></table>")
    inside = [bad(rng.choice(["advert", "share", "advert", "side", "form", "notice"])) if rng.random() < 0.15 else "" for _ in parts]
    wrap = rng.choice([("<article>", "</article>"), ("<main>", "</main>"), ("<article" + marks("main") + ">", "</article>"), ("<div" + marks("main") + ">", "</div>"), ("<div" + marks("main") + ">", "</div>"), ("<main><article>", "</article></main>"), ("<section><div>", "</div></section>"), ("<div>", "</div>")])
    before = [bad(g) for g in ("notice", "head", "menu", "advert", "form", "side", "advert") if rng.random() < 0.4]
    after = [bad(g) for g in ("share", "side", "comment", "form", "advert", "notice", "foot") if rng.random() < 0.45]
    rng.shuffle(before)
    # every piece of main text is marked by a zero-width character, so that its blocks can be told
    body = "".join(re.sub(r"(>|^)([^<>]+)", lambda m: m[1] + "\u200b" + m[2], p) + i for p, i in zip(parts, inside, strict=True))
    page = "".join(before) + wrap[0] + body + wrap[1] + "".join(after)
    if rng.random() < 0.3:
        page = f'<div id="{rng.choice(["wrapper", "container", "root", "layout"])}">{page}</div>'
    return f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title></head><body>{page}</body></html>", body


@lru_cache(maxsize=2)
def train(pages: int = 700, seed: int = 11) -> dict:
    """Trees from `pages` made-up pages; a block is positive if its subtree holds main text."""
    rng, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        page = Page(training_page(rng)[0])
        label = np.zeros(len(page.tags))
        for block, text, _ in page.pieces:
            if "\u200b" in text:
                label[block] = 1
        for k in range(len(page.tags) - 1, 0, -1):
            label[page.parents[k]] = max(label[page.parents[k]], label[k])
        page.pieces = [(b, t.replace("\u200b", ""), x) for b, t, x in page.pieces]
        xs.append(page.features())
        ys.append(label)
    return boost(np.concatenate(xs), np.concatenate(ys))


def extract_texts(pages: list[str], model: dict) -> list[str]:
    read = [Page(p) for p in pages]
    p = probabilities(model, np.concatenate([r.features() for r in read])) if read else np.zeros(0)
    ends = np.cumsum([len(r.tags) for r in read])
    return [r.text(r.decode(p[e - len(r.tags) : e])) for r, e in zip(read, ends, strict=True)]


def extract(pages: DataFrame, model: dict | None = None) -> DataFrame:
    """(page_id, url, text) for every row."""
    shared = pages.sparkSession.sparkContext.broadcast(pickle.dumps(model or train()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(shared.value)
        for batch in batches:
            for part in slices(batch, 2, 128):
                texts = extract_texts([h or "" for h in part.column(2).to_pylist()], own)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string")
