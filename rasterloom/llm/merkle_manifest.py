"""Merkle manifest of a table: leaf digests, a tree for each group, a tree over the groups, a proof for every row.

A leaf is the sha256, as lower-case hexadecimal text, of a row's fields one after the other.  Leaves of a group ascend by
key; while several nodes remain, every `FANOUT` consecutive ones (a last run may be shorter, even one) are replaced by the
digest of their digests.  What remains, a lone leaf itself, is the group's subroot; the subroots, ordered by group, go
through the same steps to the root.

Spark sorts the leaves once by ranges of (group, key) and numbers them within ranges; a position is that number plus the
rows of the group in the ranges before.  Aligned blocks of FANOUT**step consecutive nodes are then reduced, each in one
call: its digests are one contiguous matrix of 64 columns, a level reshapes it to rows of FANOUT digests and hashes these.
Block roots are the nodes of the next round, so a table of n rows takes log(n) / log(FANOUT**step) rounds and no task
holds more than one block.  On the way back every block gets the siblings along its own path and adds those inside the
block by index arithmetic: node i of a level lies in the run from i - i % FANOUT on.

`verify` folds a leaf through its siblings again, once from the row as it is or, where `tampered` holds, from its text in
lower case (A to Z alone), and compares the outcome with the root.

Defined results: a null field counts as `-`, others as their number of UTF-8 bytes, a colon and the value; a null group is
a group of its own, the first one; null keys come first within their group and are never tampered with; repeated rows are
leaves of their own, and rows with the same key are ordered by their digests; texts of any length are hashed whole; an
empty table gives no rows; other columns, whatever their names, are neither hashed nor returned.
"""

from __future__ import annotations

import hashlib
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import discard, id_bucket, materialise

#: Children of a node; levels that one block goes up, so that it has at most 512 nodes.
FANOUT, STEP = 8, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def hashed(data) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def matrix(digests: list[bytes]) -> np.ndarray:
    """Digests as one contiguous matrix, a row of 64 bytes each."""
    return np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 64)


def parents(nodes: np.ndarray) -> np.ndarray:
    """The next level: whole runs as one reshaped matrix, then the shorter last run."""
    whole = len(nodes) // FANOUT
    rows = list(nodes[: whole * FANOUT].reshape(whole, FANOUT * 64))
    if len(nodes) % FANOUT:
        rows.append(nodes[whole * FANOUT :].reshape(-1))
    return matrix([hashed(r) for r in rows])


def levels(leaves: np.ndarray, alone: bool, step: int) -> list[np.ndarray]:
    """Levels of a block from its leaves to its root: `step` steps up, or up to a single node where the block is `alone`."""
    found = [leaves]
    while len(found[-1]) > 1 if alone else len(found) <= step:
        found.append(parents(found[-1]))
    return found


def siblings(tree: list[np.ndarray], i: int) -> list[tuple[bytes, bytes]]:
    """Digests to the left and to the right of leaf i's ancestor in its run, for each level below the root."""
    found = []
    for level in tree[:-1]:
        start = i - i % FANOUT
        found.append((level[start:i].tobytes(), level[i + 1 : start + FANOUT].tobytes()))
        i //= FANOUT
    return found


def fold(node: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    for left, right in path:
        node = hashed(left + node + right)
    return node


def _tree(block: pa.Table, step: int) -> tuple[pa.Table, list[np.ndarray]]:
    """A block's nodes by position, and their levels."""
    block = block.sort_by("pos")
    return block, levels(matrix(block.column("digest").to_pylist()), block.column("n")[0].as_py() <= FANOUT**step, step)


def _root(block: pa.Table, step: int) -> pa.Table:
    """One row (g, pos, n, digest) for a block: a node of the next round."""
    block, tree = _tree(block, step)
    pos, n = block.column("pos")[0].as_py() // FANOUT**step, block.column("n")[0].as_py()
    return pa.table({"g": [block.column("g")[0].as_py()], "pos": [pos], "n": [-(-n // FANOUT**step)], "digest": [tree[-1].tobytes()]}, pa.schema([("g", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())]))


_STEPS = pa.list_(pa.struct([("l", pa.binary()), ("r", pa.binary())]))
_PATHS = "g string, pos long, path array<struct<l: binary, r: binary>>, subroot binary, root binary"


def _paths(block: pa.Table, above: pa.Table, step: int) -> pa.Table:
    """The path of every node of a block: its siblings inside the block, then the block's own path."""
    (block, tree), (upper,) = _tree(block, step), above.to_pylist()
    rest = [(s["l"], s["r"]) for s in upper["path"]]
    steps = [[{"l": a, "r": b} for a, b in siblings(tree, i) + rest] for i in range(len(block))]
    return pa.table({"g": block.column("g"), "pos": block.column("pos"), "path": pa.array(steps, _STEPS), "subroot": [upper["subroot"]] * len(block), "root": [upper["root"]] * len(block)})


def _verified(block: pa.Table, above: pa.Table, step: int) -> pa.Table:
    """The result's rows of a block of leaves."""
    (block, tree), (upper,) = _tree(block, step), above.to_pylist()
    rest = [(s["l"], s["r"]) for s in upper["path"]]
    tail = b"".join(a + b for a, b in rest)
    roots: dict[bytes, bytes] = {}  # what a block's root folds to, by that root
    proofs, folded = [], []
    for i, start in enumerate(block.column("shown").to_pylist()):
        path = siblings(tree, i)
        proofs.append(hashed(b"".join(a + b for a, b in path) + tail).decode())
        own = fold(start, path)
        if own not in roots:
            roots[own] = fold(own, rest)
        folded.append(roots[own].decode())
    root, subroot = upper["root"].decode(), upper["subroot"].decode()
    same = [f == root for f in folded]
    return pa.table({"doc_id": block.column("doc_id"), "leaf": block.column("digest").cast(pa.string()), "subroot": [subroot] * len(same), "root": [root] * len(same), "proof_sha256": proofs, "folded_root": folded, "verified": same})


def ranked(nodes: DataFrame, name: str, *order: str) -> tuple[DataFrame, DataFrame]:
    """nodes with pos, its place within g by `order`, and n, the number of rows of g; and the written table it reads.

    Rows that are alike in all of `order` are dealt by a number of their own, so that many copies of a row do not make
    one range.
    """
    tied = nodes.withColumn("__tie", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20)))
    keys = ["g", *order, "__tie"]
    numbered = tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie").withColumn("__at", F.monotonically_increasing_id())
    written = materialise(numbered, name)
    lying = written.withColumn("__range", F.shiftright("__at", 33))
    counts = lying.groupBy("g", "__range").agg(F.count("*").alias("__rows"), F.min("__at").alias("__first"))
    whole = Window.partitionBy("g")
    before = counts.withColumn("n", F.sum("__rows").over(whole)).withColumn("__before", F.sum("__rows").over(whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__rows"))
    return lying.join(before, ["g", "__range"]).withColumn("pos", F.col("__at") - F.col("__first") + F.col("__before")).drop("__at", "__range", "__first", "__before", "__rows"), written


def _blocks(nodes: DataFrame, step: int):
    return nodes.withColumn("block", F.floor(F.col("pos") / FANOUT**step).cast("long")).groupBy("g", "block")


def _below(nodes: DataFrame, paths: DataFrame, function, schema: str, step: int) -> DataFrame:
    return _blocks(nodes, step).cogroup(paths.withColumnRenamed("pos", "block").groupBy("g", "block")).applyInArrow(_given(function, step, 2), schema)


def _given(function, step: int, tables: int):
    """The function of `tables` arguments that Spark calls."""
    return (lambda block: function(block, step)) if tables == 1 else (lambda block, above: function(block, above, step))


def climb(nodes: DataFrame, name: str, step: int) -> list[DataFrame]:
    """Rounds (g, pos, n, digest) from ranked nodes up to the one in which every group has a single node, its root."""
    largest, rounds = nodes.agg(F.max("n")).first()[0] or 1, [nodes]
    while True:
        above = _blocks(rounds[-1].select("g", "pos", "n", "digest"), step).applyInArrow(_given(_root, step, 1), "g string, pos long, n long, digest binary")
        rounds.append(materialise(above, name))
        largest = -(-largest // FANOUT**step)
        if largest == 1:
            return rounds


def descend(rounds: list[DataFrame], paths: DataFrame, name: str, step: int) -> DataFrame:
    """Paths of the blocks of the first round, from those of the roots; tables go as soon as the next one is written."""
    for nodes in rounds[-2:0:-1]:
        before, paths = paths, materialise(_below(nodes.select("g", "pos", "n", "digest"), paths, _paths, _PATHS, step), name)
        discard(before)
    return paths


def verify(docs: DataFrame, tampered: Column, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "lang", text: str = "text", step: int = STEP) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of docs."""
    lower = F.translate(F.col(text), string.ascii_uppercase, string.ascii_lowercase)
    leaf = digest(*[field(F.col(c)) for c in fields])
    shown = F.when(tampered, digest(*[field(lower if c == text else F.col(c)) for c in fields])).otherwise(leaf)
    # a null group sorts before the others
    g = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))
    leaves = materialise(docs.select(g.alias("g"), F.col(key).cast("long").alias("doc_id"), leaf.cast("binary").alias("digest"), shown.cast("binary").alias("shown")), "leaves")
    base, _ = ranked(leaves, "ranked", "doc_id", "digest")
    discard(leaves)
    rounds = climb(base, "nodes", step)
    subroots, written = ranked(rounds[-1].select(F.lit("").alias("g"), F.col("g").alias("of"), "digest"), "subroots", "of")
    upper = climb(subroots, "nodes", step)
    top = upper[-1].select("g", "pos", F.expr("cast(array() as array<struct<l: binary, r: binary>>)").alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    below = descend(upper, top, "paths", step)
    of_group = _below(subroots.select("g", "pos", "n", "digest"), below, _paths, _PATHS, step).join(subroots.select("g", "pos", "of", "digest"), ["g", "pos"])
    paths = materialise(of_group.select(F.col("of").alias("g"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"), "root"), "paths")
    discard(written, below, *upper[1:])
    paths = descend(rounds, paths, "paths", step)
    discard(*rounds[1:])
    return _below(base, paths, _verified, SCHEMA, step)


def lower_cased(doc_id: Column) -> Column:
    """Whether 3 divides the crc32 of the id in decimal; false for a null id."""
    return F.coalesce(id_bucket(doc_id, 3) == 0, F.lit(False))


def manifest_sql(heights: int = 8, top_heights: int = 3) -> str:
    """The query's result as DuckDB SQL, for groups of at most FANOUT**heights rows and FANOUT**top_heights groups."""
    part = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(part(text if c == "text" else c) for c in FIELDS) + ")"
    lower = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    bits = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"
    codes = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: {bits}), 4294967295)"
    tables = [f"""
leaves AS (SELECT doc_id, coalesce('1' || lang, '0') AS g, {leaf("text")} AS leaf,
  CASE WHEN {crc} % 3 = 0 THEN {leaf(lower)} ELSE {leaf("text")} END AS shown FROM documents),
a0 AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n, leaf AS d, doc_id, shown FROM leaves)"""]

    def tree(t: str, height: int) -> None:
        """Levels t0.., and paths: for every node of t0 the digests left and right of its ancestors."""
        for k in range(height):
            tables.append(f"""
{t}{k + 1} AS (SELECT g, i // {FANOUT} AS i, (any_value(n) + {FANOUT - 1}) // {FANOUT} AS n, CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d
  FROM {t}{k} GROUP BY g, i // {FANOUT}),
{t}s{k} AS (SELECT a.g, a.i, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r, any_value(a.n) > 1 AS up
  FROM {t}{k} a JOIN {t}{k} b ON a.g = b.g AND a.i // {FANOUT} = b.i // {FANOUT} GROUP BY a.g, a.i)""")

    tree("a", heights)
    tables.append(f"\nb0 AS (SELECT '' AS g, row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS n, d, g AS of_g FROM a{heights})")
    tree("b", top_heights)
    tables.append("\nf0 AS (SELECT a0.g, a0.i, a0.doc_id, a0.d AS leaf, a0.shown AS cur, '' AS proof FROM a0)")
    for k in range(heights):
        tables.append(f"\nf{k + 1} AS (SELECT f.g, f.i, doc_id, leaf, CASE WHEN up THEN sha256(l || cur || r) ELSE cur END AS cur, CASE WHEN up THEN proof || l || r ELSE proof END AS proof FROM f{k} f JOIN as{k} s ON f.g = s.g AND f.i // {FANOUT**k} = s.i)")
    tables.append(f"\nh0 AS (SELECT f.doc_id, f.leaf, b0.d AS subroot, b0.i, f.cur, f.proof FROM f{heights} f JOIN b0 ON f.g = b0.of_g)")
    for k in range(top_heights):
        tables.append(f"\nh{k + 1} AS (SELECT doc_id, leaf, subroot, h.i, CASE WHEN up THEN sha256(l || cur || r) ELSE cur END AS cur, CASE WHEN up THEN proof || l || r ELSE proof END AS proof FROM h{k} h JOIN bs{k} s ON h.i // {FANOUT**k} = s.i)")
    return "WITH " + ",".join(tables) + f"\nSELECT doc_id, leaf, subroot, b{top_heights}.d AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = b{top_heights}.d AS verified FROM h{top_heights}, b{top_heights}"
