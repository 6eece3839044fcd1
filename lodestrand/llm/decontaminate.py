"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A seed is a hash of the tokens of a window that a fixed mask selects, so a substituted token at an ignored
place doesn't change it. Seeds of all windows of the corpus are joined with the benchmark's. Around a hit
the two texts are laid side by side and the best stretch of the item is found in which a matching token
counts 1 and another one ``-PENALTY``: an overlap that tolerates one substitution for each ``PENALTY``
matches. A document leaks an item if such a stretch has ``MIN_MATCHES`` matching tokens, or if four fifths of
all its tokens lie in place, wherever the others are. From 16 tokens on those leave some run of ``RUN`` as it
was, and shorter items that have none left keep a window that a mask selects; so runs are seeds too, and
none of these leaks is missed. An item under ``SPAN`` tokens leaks only
as a whole; its first tokens are its seed.

The seeds of the benchmark are counted first. Up to ``BROADCAST_SEEDS`` of them, two bit tables drop nearly
all windows within the row, the first by the window's end tokens alone, which every mask and run keeps, the second
by the seed, and the join is a broadcast. Beyond that the seeds of all windows go through a
shuffled join, 16 bytes and the document's key each, which skew splitting serves. Either way hits are counted by document, item and
diagonal before anything is fetched; the tokens of documents with a hit are then read once, and each diagonal is verified
once, around its hits or over the whole item, so the work of a long item grows with its length.

Nulls and edges: tokens are runs of letters and digits, lowered; a null or empty text has none and leaks
nothing; an item without tokens never leaks; a null item_id is an item like
any other; rows that share a doc_id are one document; repeated items are one; items and texts may be of any length; empty tables leak nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality_rules import bound
from .shared import cut, free

#: Fixed masks: places of a window whose tokens count.
MASKS = ((0, 1, 3, 4, 7, 8), (0, 2, 3, 5, 6, 8), (0, 1, 2, 5, 6, 8))
SPAN, RUN = 9, 4
PENALTY, MIN_MATCHES = 4, 13
#: Seeds up to which the benchmark's side is broadcast (24 bytes each), and bits of the table for them.
BROADCAST_SEEDS, TABLE_BITS = 1 << 20, 20


def tokens(text: Column) -> Column:
    """Hashes of the tokens of a text."""
    return F.transform(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+", -1), lambda w: w != ""), lambda w: F.xxhash64(w))


def _ends(ts: Column, i: Column, span: int = SPAN) -> Column:
    """The first and last token of a window in one long; every mask keeps these two places."""
    return F.get(ts, i).bitwiseXOR(F.shiftrightunsigned(F.get(ts, i + (span - 1)), 1))


def _windows(ts: Column, span: int = SPAN) -> Column:
    """Where windows start."""
    return F.when(F.size(ts) >= span, F.sequence(F.lit(0), F.size(ts) - span)).otherwise(F.array().cast("array<int>"))


def _seeds(ts: Column, windows: Column) -> Column:
    """Array of (at, h) for these windows and every mask."""

    def of(mask: int) -> Column:
        return F.transform(windows, lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(mask), *[F.get(ts, i + k) for k in MASKS[mask]]).alias("h")))

    return F.concat(*[of(m) for m in range(len(MASKS))])


def _needed(length: Column) -> Column:
    """Tokens in place that make a leak: four fifths of an item, all of a short one."""
    return F.when(length < SPAN, length).otherwise(length - F.floor(length / 5).cast("int"))


def _run_seeds(ts: Column, windows: Column, length: int) -> Column:
    """Array of (at, h) for the runs of ``length`` tokens that start there."""
    return F.transform(windows, lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(len(MASKS) + length), *[F.get(ts, i + k) for k in range(length)]).alias("h")))


def _word_and_bit(h: Column) -> tuple[Column, Column]:
    return h.bitwiseAND(F.lit((1 << (TABLE_BITS - 6)) - 1)).cast("int"), F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(63)).cast("int")


def bit_table(values: DataFrame) -> Column:
    """A literal of 2 ** TABLE_BITS bits, set by the longs ``h``: an array, bounded whatever the benchmark."""
    word, bit = _word_and_bit(F.col("h"))
    # one row for each word of the table at most
    rows = values.groupBy(word.alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("v")).collect()
    table = [0] * (1 << (TABLE_BITS - 6))
    for r in rows:
        table[r["w"]] = r["v"]
    return F.from_json(F.lit("[" + ",".join(map(str, table)) + "]"), "array<bigint>")


def in_table(table: Column, h: Column) -> Column:
    word, bit = _word_and_bit(h)
    return F.call_function("shiftrightunsigned", F.get(table, word), bit).bitwiseAND(F.lit(1)) == 1


def _stretch(near: Column, first: Column, item: Column) -> Column:
    """Matching tokens of the best stretch; item token j lies at ``near[first + j]``."""
    start = F.struct(F.lit(0).alias("score"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, j: Column) -> Column:
        at = first + j
        same = (at >= 0) & F.coalesce(F.get(near, at) == F.get(item, j), F.lit(False))
        score = F.when(same, acc["score"] + 1).otherwise(acc["score"] - PENALTY)
        run = F.when(score <= 0, F.lit(0)).otherwise(F.when(same, acc["run"] + 1).otherwise(acc["run"]))
        return F.struct(F.greatest(score, F.lit(0)).alias("score"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(F.sequence(F.lit(0), F.size(item) - 1), start, step)["best"]


def _in_place(near: Column, first: Column, item: Column) -> Column:
    """Matching tokens of the whole item; item token j lies at ``near[first + j]``."""
    same = lambda j: (first + j >= 0) & F.coalesce(F.get(near, first + j) == F.get(item, j), F.lit(False))
    return F.aggregate(F.sequence(F.lit(0), F.size(item) - 1), F.lit(0), lambda acc, j: acc + same(j).cast("int"))


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_matches) for each document and benchmark item that it leaks."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), tokens(F.col("text")).alias("item")).where(F.size("item") > 0).distinct()
    items = cut(items.withColumn("item_key", F.xxhash64("item_id", "item")), "items")
    items = items.withColumn("run", F.least(F.size("item"), F.lit(RUN)))
    # 1 to RUN
    lengths = sorted(r["run"] for r in items.select("run").distinct().collect())
    item, short = F.col("item"), F.size("item") < SPAN
    # a short item leaks as a whole, so its first run is enough
    runs = {n: F.when(F.col("run") == n, F.when(short, F.array(F.lit(0))).otherwise(_windows(item, n))).otherwise(F.array().cast("array<int>")) for n in lengths}
    of_item = F.concat(_seeds(item, _windows(item)), *[_run_seeds(item, runs[n], n) for n in lengths])
    seeds = cut(items.select("item_key", F.explode(of_item).alias("s")).select(F.col("s.h").alias("h"), "item_key", F.col("s.at").alias("item_at")).distinct(), "seeds")
    size = seeds.agg(F.count("*").alias("n")).first()["n"]
    small = size <= BROADCAST_SEEDS
    if small:
        ends_of = lambda ws, n: F.transform(ws, lambda i: _ends(item, i, n))
        ends = items.select(F.explode(F.concat(ends_of(_windows(item), SPAN), *[ends_of(runs[n], n) for n in lengths])).alias("h"))
        by_ends, by_seed = bit_table(ends), bit_table(seeds)

    def seeds_of(ts: Column) -> Column:
        return F.concat(seeded(ts, SPAN, _seeds), *[seeded(ts, n, partial(_run_seeds, length=n)) for n in lengths])

    def seeded(ts: Column, span: int, of: Callable[[Column, Column], Column]) -> Column:
        if small:  # by two tokens first; few windows are hashed
            return bound(F.filter(_windows(ts, span), lambda i: in_table(by_ends, _ends(ts, i, span))), lambda ws: F.filter(of(ts, ws), lambda s: in_table(by_seed, s["h"])))
        return of(ts, _windows(ts, span))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL").withColumn("text_key", F.xxhash64("text"))
    # the outer form keeps the optimizer from evaluating the hits again as a filter on their number
    hits = rows.select("doc_id", "text_key", F.explode_outer(bound(tokens(F.col("text")), seeds_of)).alias("hit")).select("doc_id", "text_key", F.col("hit.h").alias("hit_h"), F.col("hit.at").alias("at"))
    met = hits.join(F.broadcast(seeds) if small else seeds, F.col("hit_h") == F.col("h"))
    diagonals = met.groupBy("doc_id", "text_key", "item_key", (F.col("at") - F.col("item_at")).alias("diagonal")).agg(F.count("*").alias("n_hits"), F.min("item_at").alias("lo"), F.max("item_at").alias("hi"))
    diagonals = cut(diagonals, "diagonals")
    named = cut(diagonals.select(F.col("doc_id").alias("of_doc"), F.col("text_key").alias("of_text")).distinct(), "hit-texts")
    is_named = (F.col("text_key") == F.col("of_text")) & F.col("doc_id").eqNullSafe(F.col("of_doc"))
    few = named.count() <= BROADCAST_SEEDS
    held = cut(rows.join(F.broadcast(named) if few else named, is_named, "left_semi").dropDuplicates(["doc_id", "text_key"]).select("doc_id", "text_key", tokens(F.col("text")).alias("ts")), "hit-tokens")
    found = diagonals.withColumnsRenamed({"doc_id": "of_doc", "text_key": "of_text"}).join(held, is_named).join(F.broadcast(items) if small else items, "item_key")
    verified = cut(_verified(found).groupBy("doc_id", "item_id").agg(F.max("n").cast("long").alias("n_matches")), "leaks")
    free(diagonals, named, held)
    return verified


def _verified(found: DataFrame) -> DataFrame:
    """(doc_id, item_id, n) of diagonals that leak, each looked at once.

    A diagonal with so few hits that four fifths of the item can't lie in place is only read around them: a stretch of M
    matches keeps M / 4 - 2 runs at least, so with n hits it is no longer than 5 * n + 12 tokens.
    """
    length, reach = F.size("item"), F.col("n_hits").cast("int") * 5 + 12
    whole = (length <= 64) | (F.col("n_hits") * 5 + 15 >= length)
    lo = F.when(whole, F.lit(0)).otherwise(F.greatest(F.lit(0), F.col("lo") - reach))
    hi = F.when(whole, length).otherwise(F.least(length, F.col("hi") + SPAN + reach))
    found = found.select("doc_id", "item_id", "ts", "item", "diagonal", _needed(length).alias("needed"), lo.alias("lo"), hi.alias("hi"))
    begin = F.greatest(F.lit(0), F.col("diagonal") + F.col("lo"))
    end = F.greatest(begin, F.least(F.size("ts"), F.col("diagonal") + F.col("hi")))
    first = F.col("diagonal") + F.col("lo") - begin
    # the slices are bound, or each step of a walk would cut them anew
    walk = lambda near, item: F.struct(_stretch(near, first, item).alias("n"), _in_place(near, first, item).alias("m"))
    seen = bound(F.slice("ts", begin + 1, end - begin), lambda near: bound(F.slice("item", F.col("lo") + 1, F.col("hi") - F.col("lo")), lambda item: walk(near, item)))
    pairs = found.select("doc_id", "item_id", "needed", seen.alias("w")).select("doc_id", "item_id", "needed", "w.n", "w.m")
    return pairs.select("doc_id", "item_id", F.greatest("n", F.when(F.col("m") >= F.col("needed"), F.col("m"))).alias("n"), "needed").where(F.col("n") >= F.least(F.lit(MIN_MATCHES), "needed"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document leaks no item, as they are."""
    # written first, so that the join knows its size: texts are shuffled only beyond the broadcast threshold
    found = cut(leaks(docs, benchmark).select(F.col("doc_id").alias("leaking_id")).distinct(), "leaking")
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found["leaking_id"]), "left_anti")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the benchmark items that it leaks."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = leaks(docs, benchmark).groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("n_matches").alias("n_matches")).withColumnRenamed("doc_id", "leaking_id")
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(found, F.col("doc_id").eqNullSafe(F.col("leaking_id")), "left")
    return out.select("doc_id", F.col("leaking_id").isNotNull().alias("contaminated"), F.array_join(F.transform(F.coalesce("item_ids", F.array().cast("array<bigint>")), lambda x: x.cast("string")), ",").alias("item_ids"), F.coalesce("n_matches", F.lit(0).cast("long")).alias("n_matches"))


QUERIES = {"op8_decontaminate": op8_decontaminate}
SQL: dict[str, str] = {}
