"""Filters in every order: what each removes, what others had removed before it, and what is lost with it.

A document's failures are one mask of five bits, so all 120 orders follow from counts by (part, mask): documents go
through the filters once, and 32 counts a part are expanded by the 600 (order, step) pairs.

Duplicates (filter E) are found by partition refinement: rows are split by code-point length, then by the hashes of
successive blocks of text, each round on what the round before left together; classes of one row drop out. Full texts are
compared only among rows that no block tells apart: they are grouped by class and text, so equal copies collapse before
the shuffle, and every row above the smallest id of its text is marked. Counts and texts are pre-aggregated; keys with over a
thousandth of the rows are broadcast, at most a thousand (``links.lookup``), so no length, class or text gathers in a task.

Nulls and edges: a null text is empty; a null lang is the part ''; a null doc_id is no smaller than any and fails no
duplicate test; rows that repeat one doc_id and text are each a document, none the other's duplicate; a document counts as good or
toxic if any of its label rows says so; an empty table gives no rows; very long texts are hashed in place; other columns,
whatever their names, aren't read.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .links import lookup
from .quality_rules import words
from .shared import cut, free

FILTERS = "ABCDE"
#: Classes of alike texts, of eight bytes each, that are broadcast at most; beyond it texts are shuffled to them.
BROADCAST_CLASSES = 1 << 20
BIT = {name: 1 << k for k, name in enumerate(FILTERS)}
#: Code points where a text's blocks end; the last block is what follows.
BLOCK_ENDS = (64, 576, 4672)
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_failures(text: Column, ws: Column) -> Column:
    """The bits of the filters that look at one text."""
    n, length = F.size(ws), F.length(text)
    capitals = length - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    bit = lambda name, fails: F.when(fails, F.lit(BIT[name])).otherwise(F.lit(0))
    return bit("A", n < 100) + bit("B", 100 * F.size(F.array_distinct(ws)) < 80 * n) + bit("C", 100 * capitals > 10 * length) + bit("D", text.rlike("[#$%&*|]"))


def block_hashes(text: Column) -> list[Column]:
    """One hash for each successive block of a text; together they cover all of it."""
    starts = (0, *BLOCK_ENDS)
    inner = [F.xxhash64(F.substring(text, a + 1, b - a)) for a, b in zip(starts, BLOCK_ENDS)]
    return [*inner, F.xxhash64(F.substring(text, F.lit(BLOCK_ENDS[-1] + 1), F.length(text)))]


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, part, text) without nulls in part and text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def _parts() -> Column:
    """What refinement splits by, in order: a text's length and its blocks' hashes."""
    text = F.col("text")
    return F.array(F.length(text).cast("long"), *block_hashes(text))


def _mask() -> Column:
    return text_failures(F.col("text"), words(F.col("text")))


def _class(n: int) -> Column:
    """A row's class after ``n`` rounds."""
    return F.xxhash64(F.slice("parts", 1, n))


def refined(rows: DataFrame, rounds: int) -> DataFrame:
    """The written ``rows`` that agree with another in all ``parts``; each round tells classes apart by one part more and drops those of one row."""
    left = rows
    for k in range(1, rounds + 1):
        counts = cut(left.groupBy(_class(k).alias("key")).agg(F.count("*").alias("n")).where("n > 1").withColumn("again", F.lit(True)), "classes")
        before, left = left, cut(lookup(left, _class(k), counts, "again").where("again").drop("again"), "refined")
        free(counts, *([before] if k > 1 else []))
    return left


def duplicates(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of rows whose text a smaller id has; ``judged`` has (doc_id, part, mask, parts) of ``docs``.

    A class of one text is marked by its class alone. Classes in which several texts met, by equal lengths and hashes, are marked by their texts.
    """
    rounds = len(BLOCK_ENDS) + 2
    alike = refined(judged.where("doc_id IS NOT NULL"), rounds)
    sizes = cut(alike.groupBy(_class(rounds).alias("key")).agg(F.count("*").alias("n")).withColumn("again", F.lit(True)), "alike-classes")
    few = sizes.count() <= BROADCAST_CLASSES  # rows are the same either way

    def whole_texts(columns: list[Column]) -> DataFrame:
        """Rows of the classes left, with their class and text."""
        rows = _rows(docs).where("doc_id IS NOT NULL").withColumn("parts", _parts()).select("doc_id", "text", _class(rounds).alias("class"), *columns)
        return rows.join(F.broadcast(sizes.select(F.col("key").alias("_key"))), F.col("class") == F.col("_key"), "left_semi") if few else lookup(rows, F.col("class"), sizes, "again").where("again")

    full = whole_texts([])
    compared = cut(full.groupBy("class", "text").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "compared-texts")
    classes = cut(compared.groupBy(F.col("class").alias("key")).agg(F.min("least").alias("least"), F.sum("n").alias("n"), F.count("*").alias("n_texts")), "least-of-class")
    plain = cut(classes.where("n_texts = 1"), "plain-classes")
    marked = lookup(alike, _class(rounds), plain, "least").where("doc_id > least").select("doc_id", "part", "mask")
    mixed = classes.where("n_texts > 1").select(F.col("key").alias("_key"))
    if not mixed.isEmpty():
        least = compared.join(mixed, F.col("class") == F.col("_key")).select(F.col("class").alias("_class"), F.col("text").alias("_text"), "least")
        met = whole_texts([F.col("part"), _mask().alias("mask")]).join(least, (F.col("class") == F.col("_class")) & (F.col("text") == F.col("_text")))
        marked = marked.unionByName(met.where("doc_id > least").select("doc_id", "part", "mask"))
    out = cut(marked, "marked-duplicates")
    free(alike, sizes, compared, classes, plain)
    return out


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and by the set of filters that they fail."""
    judged = cut(_rows(docs).select("doc_id", "part", _mask().alias("mask"), _parts().alias("parts")), "judged-documents")
    marked = duplicates(docs, judged)
    counted = judged.select("doc_id", "part", "mask", F.lit(1).alias("k")).unionByName(marked.select("doc_id", "part", "mask", F.lit(-1).alias("k"))).unionByName(marked.select("doc_id", "part", F.col("mask").bitwiseOR(BIT["E"]).alias("mask"), F.lit(1).alias("k")))
    by_id = counted.groupBy("doc_id", "part", "mask").agg(F.sum("k").alias("n")).where("n > 0")
    flags = labels.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    held = by_id.join(flags, F.col("doc_id") == F.col("_id"), "left")
    share = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0))
    out = cut(held.groupBy("part", "mask").agg(F.sum("n").alias("n"), share("good").alias("good"), share("bad").alias("toxic")), "mask-counts")
    free(judged, marked)
    return out


def audit(counts: DataFrame) -> DataFrame:
    """All orders and steps of each part of ``mask_counts``."""
    steps = [{"filter_order": "".join(o), "step": k + 1, "bit": BIT[f], "before": sum(BIT[g] for g in o[:k])} for o in permutations(FILTERS) for k, f in enumerate(o)]
    schema = "array<struct<filter_order: string, step: int, bit: int, before: int>>"
    rows = counts.withColumn("_s", F.explode(F.from_json(F.lit(json.dumps(steps)), schema))).select("part", "mask", "n", "good", "toxic", "_s.*")
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda c, when: F.sum(F.when(when, c).otherwise(F.lit(0))).cast("long")
    n = F.col("n")
    # in 120 / k of all orders a filter comes before the others of the k that a document fails
    value = F.expr("n * (120 div bit_count(mask))")
    sums = (total(n, ~fails & ~gone), total(n, fails & ~gone), total(n, fails & gone), total(n, F.col("mask") == F.col("bit")), total(F.col("good"), fails & ~gone), total(F.col("toxic"), fails & ~gone), total(value, fails))
    return rows.groupBy("part", "filter_order", "step").agg(*[c.alias(name) for c, name in zip(sums, MEASURES)])


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order and step of the five filters, for each language of ``documents``."""
    return audit(mask_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op11_filter_audit": op11_filter_audit}
SQL = {
    "op11_filter_audit": r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[ 	-
]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
f AS (
  SELECT doc_id, part, (len(ws) < 100)::INT + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::INT
    + 4 * (100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 10 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(least < doc_id, false)::INT AS mask FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id),
m AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(bad), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
b(name, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
  SELECT p.name || q.name || r.name || s.name || u.name AS filter_order, [p.bit, q.bit, r.bit, s.bit, u.bit] AS bits
  FROM b p, b q, b r, b s, b u WHERE p.bit | q.bit | r.bit | s.bit | u.bit = 31),
s AS (SELECT filter_order, k AS step, bits[k] AS bit, coalesce(list_sum(bits[1:k - 1]), 0)::INT AS before FROM (SELECT filter_order, bits, unnest(range(1, 6)) AS k FROM o))
SELECT part, filter_order, step::INT AS step,
  sum(CASE WHEN mask & bit = 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost,
  sum(CASE WHEN mask & bit <> 0 THEN n * (120 // bit_count(mask)) ELSE 0 END)::BIGINT AS shapley
FROM m, s GROUP BY part, filter_order, step""",
}
