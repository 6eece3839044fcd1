"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a boolean column over a document's text. A bounded sample of documents gives each rule's cost
(median time of ``RUNS`` scans that evaluate only it, after one that compiles it, less that of a bare scan) and selectivity (share rejected); the
cascade is one ``CASE WHEN`` whose branches are ordered by rejection per cost, so a document stops at the
first rule that it fails and the dear rules see only what the cheap ones left. The order changes which
rule is named first, never whether a document is kept.

Nulls and edges: a null or empty text has no words and fails ``min_words``; ties in rejection per cost are
ordered by the rules' order; an empty table has no sample and keeps the given order; repeated rows and
very long texts are judged row by row; other columns pass through, and the verdict is two new columns.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from statistics import median

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, estimated_bytes, free, texts

#: The sample's rows; bounds the estimates, not the input.
SAMPLE_ROWS = 2000
#: Timed scans for each rule.
RUNS = 3
WINDOW = 8


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``value``, evaluated once however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def words(text: Column) -> Column:
    """Maximal runs outside ``[\\x20\\x09-\\x0D]``."""
    return F.filter(F.split(text, "[ \\t-\\r]+", -1), lambda w: w != "")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long")


def n_lines(text: Column) -> Column:
    return F.size(_worded_lines(text)).cast("long")


def _worded_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^ \\t-\\r]"))


def n_dup_lines(text: Column) -> Column:
    return bound(_worded_lines(text), lambda ls: (F.size(ls) - F.size(F.array_distinct(ls))).cast("long"))


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more: sort (hash, index), keep indexes with an equal neighbour, add up what each window adds."""

    def of(s: Column) -> Column:
        equal = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda j: F.get(s, j - 1)["h"].eqNullSafe(F.get(s, j)["h"]) | F.get(s, j + 1)["h"].eqNullSafe(F.get(s, j)["h"]),
        )
        at = F.sort_array(F.transform(equal, lambda j: F.get(s, j)["i"]))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(at, start, lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")))["n"]

    return bound(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), of)


def n_repeat_words(ws: Column) -> Column:
    """Words in 8-word windows that a text with these words has twice or more. Only texts with an equal pair of windows are sorted."""

    def of(ws: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(ws) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(ws, i, F.lit(WINDOW))))
        repeated = bound(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h)).otherwise(F.lit(0).cast("long")))
        return F.when(F.size(ws) > WINDOW, repeated).otherwise(F.lit(0).cast("long"))

    return bound(F.transform(ws, lambda w: F.xxhash64(w)), of)


#: Each takes the text and its words.
METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda text, ws: F.size(ws).cast("long"),
    "word_chars": lambda text, ws: F.length(F.array_join(ws, "")).cast("long"),
    "n_symbols": lambda text, ws: n_symbols(text),
    "n_lines": lambda text, ws: n_lines(text),
    "n_dup_lines": lambda text, ws: n_dup_lines(text),
    "n_repeat_words": lambda text, ws: n_repeat_words(ws),
    "n_shouts": lambda text, ws: F.regexp_count(text, F.lit("!!")).cast("long"),
}
_OF_WORDS = {"n_words", "word_chars", "n_repeat_words"}


@dataclass(frozen=True)
class Rule:
    """``fails`` takes a lookup from metric name to column and says whether a document is rejected."""

    name: str
    fails: Callable[[Callable[[str], Column]], Column]


#: The contract's two rules.
BASE_RULES = (
    Rule("min_words", lambda m: m("n_words") < 20),
    Rule("repeated_words", lambda m: 100 * m("n_repeat_words") > 30 * m("n_words")),
)
#: Further rules of the method's verdict.
MORE_RULES = (
    Rule("symbols", lambda m: m("n_symbols") * 10 > m("n_words")),
    Rule("shouts", lambda m: m("n_shouts") * 10 > m("n_words")),
    Rule("repeated_lines", lambda m: m("n_dup_lines") * 2 > m("n_lines")),
    Rule("word_length", lambda m: (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 30 * m("n_words"))),
)
RULES = BASE_RULES + MORE_RULES


def _uses(rule: Rule) -> set[str]:
    """The metrics that a rule asks for."""
    asked: set[str] = set()

    def look(name: str) -> Column:
        asked.add(name)
        return F.lit(0)

    rule.fails(look)
    return asked


def _lookup(have: set[str], text: Column, ws: Column) -> Callable[[str], Column]:
    """A metric's column if the frame has it already, else its expression."""
    return lambda name: F.col(name) if name in have else METRICS[name](text, ws)


def with_metrics(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(doc_id, text) rows with the named metrics as columns, their words split once."""
    split = rows.select("doc_id", "text", words(F.col("text")).alias("ws"))
    return split.select("doc_id", "text", *[METRICS[n](F.col("text"), F.col("ws")).alias(n) for n in names])


def ordered_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, given: tuple[str, ...] = ()) -> list[Rule]:
    """``rules`` by rejection per cost on at most ``sample_rows`` documents; ``given``: metrics that are columns where the cascade runs and cost nothing there."""
    rows = texts(docs)
    fraction = min(1.0, sample_rows * 2000.0 / max(1, estimated_bytes(rows)))
    sample = cut(with_metrics(rows.sample(fraction, 7).limit(sample_rows), given), "rules-sample")
    look = _lookup(set(given), F.col("text"), words(F.col("text")))

    def timed(c: Column) -> tuple[float, int, int]:
        scan, took = sample.agg(F.count_if(c).alias("n"), F.count("*").alias("total")), []
        row = scan.first()  # compiles
        for _ in range(RUNS):
            began = time.perf_counter()
            row = scan.first()
            took.append(time.perf_counter() - began)
        return median(took), row["n"], row["total"]

    bare = timed(F.length("text") < 0)[0]
    gain = {}
    for rule in rules:
        took, rejected, total = timed(rule.fails(look))
        gain[rule.name] = (rejected / total if total else 0.0) / max(took - bare, 1e-3)
    free(sample)
    return sorted(rules, key=lambda r: -gain[r.name])


def cascade(docs: DataFrame, rules: list[Rule], have: set[str] = frozenset()) -> Column:
    """The name of the first rule that a document fails, null for none; ``have``: metrics that are columns already."""
    text = F.coalesce(docs["text"], F.lit(""))

    def of(some: list[Rule], ws: Column, rest: Column) -> Column:
        look, out = _lookup(set(have), text, ws), F
        for rule in some:
            out = out.when(rule.fails(look), F.lit(rule.name))
        return out.otherwise(rest) if some else rest

    none = F.lit(None).cast("string")
    first = next((k for k, rule in enumerate(rules) if _uses(rule) & _OF_WORDS - set(have)), len(rules))
    # a text is split once, and only if a rule that needs its words is reached
    rest = bound(words(text), lambda ws: of(rules[first:], ws, none)) if first < len(rules) else none
    return of(rules[:first], text, rest)


def passing(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that fail no rule, as they are."""
    return docs.where(cascade(docs, ordered_rules(docs, rules)).isNull())


#: The metrics that the query returns for every document; the rules on them cost a comparison, and the cascade skips the rest.
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the base metrics, the base verdict and the cascade's verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rules = ordered_rules(docs, given=REPORTED)
    base = with_metrics(texts(docs), REPORTED)
    failed = F.coalesce(F.col("n_words") < 20, F.lit(True)) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return base.select("doc_id", *REPORTED, failed.alias("base_failed"), cascade(base, rules, set(REPORTED)).isNull().alias("kept"))


QUERIES = {"op7_quality_rules": op7_quality_rules}
SQL = {
    "op7_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, list_filter(regexp_split_to_array(text, '[ \t-\r]+'), lambda x: x <> '') AS ws, string_split(text, chr(10)) AS ls FROM d),
l AS (SELECT *, list_filter(ls, lambda x: regexp_matches(x, '[^ \t-\r]')) AS wl FROM w),
m AS (
  SELECT rid, doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(wl) AS n_lines,
    len(wl) - len(list_distinct(wl)) AS n_dup_lines, len(regexp_extract_all(text, '!!')) AS n_shouts FROM l),
g AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS gram FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c >= 2),
s AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM r) GROUP BY rid),
f AS (SELECT m.*, coalesce(s.n, 0)::BIGINT AS n_repeat_words FROM m LEFT JOIN s USING (rid))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR n_symbols * 10 > n_words OR n_shouts * 10 > n_words
    OR n_dup_lines * 2 > n_lines OR word_chars < 2 * n_words OR word_chars > 30 * n_words) AS kept
FROM f""",
}
