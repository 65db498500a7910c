"""Quality rules: a threshold table compiled into one projection of native expressions.

`measures` adds integer counts for every whole text; `compile_rules` turns rows of `RULES` into one boolean
column.  All comparisons are on integers (percent of a denominator), so another engine gives the same verdicts.

Defined results: a null text counts as empty; an empty text has zero for every count and fails; rows are judged one
by one, so repeated rows get equal verdicts; an empty table gives an empty table; extra columns of the input, whatever
their names, are ignored by `quality_counts` and kept by `quality_filter`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import WHITE

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that for it as was with be by on are this from or an at "
    "der die das und ist von den mit zu ein eine nicht auf für sich des dem im als auch "
    "le la les de des et est un une que qui dans pour sur pas avec du en par "
    "el los las del y que se por con no una su para es al lo como más"
).split()

SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """Keep a text only while low <= 100 * numerator / denominator <= high (None: no bound)."""

    name: str
    numerator: str
    denominator: str
    low: int | None = None
    high: int | None = None


#: The threshold table.  Percentages of the denominator.
RULES = (
    Rule("mean word length", "word_chars", "n_words", 200, 1500),
    Rule("symbol ratio", "n_symbols", "word_chars", None, 10),
    Rule("exclamation ratio", "n_shouts", "n_words", None, 20),
    Rule("stop-word ratio", "n_stop_words", "n_words", 5, None),
    Rule("duplicate-line ratio", "n_dup_lines", "n_lines", None, 50),
)

#: Words that a text needs, and the percent of its words that may lie in repeated windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_shouts")


def _bind(value: Column, body) -> Column:
    """body(value) with value computed once for the row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column, size: int = WINDOW) -> Column:
    """Words inside windows of `size` words that occur twice or more in the text.

    Windows are compared by a 64-bit hash.  Positions of repeated windows come from one sort of the hashes, and the
    words covered are summed over the sorted positions, so the cost is n log n in the length of the text.
    """

    def covered(hashes: Column) -> Column:
        def scan(ordered: Column) -> Column:
            same = lambda e, k: (e["h"] == F.get(ordered, k - 1)["h"]) | (e["h"] == F.get(ordered, k + 1)["h"])
            repeated = F.filter(ordered, lambda e, k: F.coalesce(same(e, k), F.lit(False)))
            places = F.sort_array(F.transform(repeated, lambda e: e["i"]))
            start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-size).alias("last"))
            add = lambda a, i: F.struct((a["sum"] + F.least(F.lit(size), i - a["last"])).cast("long").alias("sum"), i.alias("last"))
            return F.aggregate(places, start, add)["sum"]

        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_bind(ordered, scan))

    def windows(hashed: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(hashed) - (size - 1)), lambda i: F.xxhash64(F.slice(hashed, i, size)))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= size, F.lit(0).cast("long")).otherwise(_bind(_bind(hashed, windows), covered))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts that the rules use to every row of docs; existing columns of those names are replaced."""
    body = F.coalesce(F.col(text), F.lit(""))
    bare = lambda c: F.length(F.translate(c, WHITE, ""))
    stop = F.array(*[F.lit(w) for w in sorted(set(STOP_WORDS))])
    lines = F.filter(F.split(body, "\n", -1), lambda x: bare(x) > 0)
    counted = (
        docs.withColumn("__words", F.array_remove(F.split(body, "[\\x20\\x09-\\x0D]+", -1), ""))
        .withColumn("__lines", lines)
        .withColumns({
            "n_words": F.size("__words").cast("long"),
            "word_chars": bare(body).cast("long"),
            "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": _repeat_words(F.col("__words")),
            "n_lines": F.size("__lines").cast("long"),
            "n_stop_words": F.size(F.filter("__words", lambda w: F.array_contains(stop, w))).cast("long"),
            "n_shouts": F.size(F.filter("__words", lambda w: w.endswith("!!"))).cast("long"),
        })
    )
    return counted.drop("__words", "__lines")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def compile_rules(rules=RULES) -> Column:
    """One boolean column: every rule of the table holds."""
    verdict = F.lit(True)
    for rule in rules:
        top, below = 100 * F.col(rule.numerator), F.col(rule.denominator)
        if rule.low is not None:
            verdict = verdict & (top >= rule.low * below)
        if rule.high is not None:
            verdict = verdict & (top <= rule.high * below)
    return verdict


def quality_counts(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, the counts, base_failed and kept for every row; no row is left out."""
    counted = measures(docs.select("doc_id", "text"))
    return counted.select("doc_id", *_COUNTS, base_failed().alias("base_failed"), (~base_failed() & compile_rules(rules)).alias("kept"))


def quality_filter(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs."""
    # the counts live in one struct under a reserved name, so that columns of docs may have any name
    inner = measures(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("text")))
    # a row is kept as often as its verdict is true; a plain filter would be pushed below the counts, which its many
    # mentions of them would then compute again
    verdict = F.filter(F.array(~base_failed() & compile_rules(rules)), lambda kept: kept)
    return inner.select("__row", F.explode(verdict).alias("__kept")).select("__row.*")


def rules_sql(rules=RULES) -> str:
    """The same result as DuckDB SQL over the table documents."""
    stops = ", ".join("'" + w + "'" for w in sorted(set(STOP_WORDS)))
    verdict = [f"100 * {r.numerator} >= {r.low} * {r.denominator}" for r in rules if r.low is not None]
    verdict += [f"100 * {r.numerator} <= {r.high} * {r.denominator}" for r in rules if r.high is not None]
    failed = f"(n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)"
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
split_texts AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM texts),
windows AS (
  SELECT doc_id, i, array_to_string(list_slice(words, i, i + {WINDOW - 1}), ' ') AS piece
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM split_texts)),
repeated AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, piece) AS times FROM windows),
covered AS (
  SELECT doc_id, count(DISTINCT w) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS w FROM repeated WHERE times > 1) GROUP BY doc_id),
counts AS (
  SELECT doc_id, len(words) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(lines) AS n_lines, len(list_filter(words, lambda w: list_contains([{stops}], w))) AS n_stop_words,
         len(list_filter(words, lambda w: ends_with(w, '!!'))) AS n_shouts
  FROM split_texts LEFT JOIN covered USING (doc_id))
SELECT doc_id, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _COUNTS)}, {failed} AS base_failed,
       (NOT {failed} AND {' AND '.join(verdict)}) AS kept FROM counts"""
