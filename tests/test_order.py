"""Order, ranks, sequences and multisets over whole tables, and identities as columns."""

from __future__ import annotations

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from lodestrand.functions import ids
from lodestrand.operators import order


def previous(rows):
    out, was = {}, None
    for p, v in sorted(rows, key=lambda x: x[0]):
        out[p] = was
        was = v
    return out


@pytest.mark.parametrize("bits", [1, 3, 16])
def test_row_before_across_buckets_and_gaps(spark, bits):
    r = random.Random(bits)
    rows = [(p, r.choice([None, "a", "b", "c"])) for p in r.sample(range(-500, 4000), 300)]
    frame = spark.createDataFrame(rows, "p long, v string").repartition(5)
    got = {x.p: (x._was.v if x._was else None) for x in order.with_previous(frame, "p", ["v"], bits).collect()}
    assert got == previous(rows)
    firsts = [x.p for x in order.with_previous(frame, "p", ["v"], bits).where("_was IS NULL").collect()]
    assert firsts == [min(p for p, _ in rows)]
    before = previous(rows)
    low = lambda v: (v is not None, v or "")
    want = sorted(p for p, v in rows if p != firsts[0] and not low(before[p]) < low(v))
    assert sorted(x.p for x in order.order_breaks(frame, "p", ["v"], bits).collect()) == want
    assert order.order_breaks(frame.limit(0), "p", ["v"], bits).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_ranks_do_not_depend_on_partitions(spark, parts):
    rows = [(k, (k * 7919) % 1000) for k in range(1000)]
    frame = spark.createDataFrame(rows, "id long, v long").repartition(parts)
    got = {x.v: x.rank for x in order.ranked(frame, ["v"], parts=parts).collect()}
    assert got == {v: v for v in range(1000)}


def test_repeats_sequences_and_multisets(spark):
    frame = spark.createDataFrame([(0, "a"), (5, "b"), (7, "a"), (9, None), (11, None), (12, "a")], "p long, v string")
    assert sorted(x.p for x in order.repeats(frame, ["v"], "p").collect()) == [7, 11, 12]
    left = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (2, 0, "x"), (3, 0, "x"), (3, 1, None)], "k long, p long, v string")
    right = spark.createDataFrame([(1, 0, "y"), (1, 1, "x"), (2, 0, "x"), (3, 0, "x"), (4, 0, "x")], "k long, p long, v string")
    got = {tuple(x) for x in order.sequence_differences(left, right, ["k"], "p", "v").collect()}
    assert got == {(1, True, False, 0), (2, True, True, None), (3, False, False, 1), (4, False, False, 0)}
    got = {tuple(x) for x in order.unmatched(left.select("v"), right.select("v"), ["v"]).collect()}
    assert got == {(None, 1, "extra"), ("x", 1, "missing")} and order.unmatched(left, left, ["k", "p", "v"]).count() == 0


def test_composed_names(spark):
    r = random.Random(2)
    names = ["plain", "", "Å", "Å", "éx̂", "한", "한", "하", "Å", "café", "á̂", "́x"] + ["".join(r.choice("aeiouAń̀̃é한가") for _ in range(6)) for _ in range(60)]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", ids.nfc(F.col("n")).alias("c")).collect()
    assert [(x.n, x.c) for x in got] == [(n, unicodedata.normalize("NFC", n)) for n in names]


def test_ids_follow_from_what_they_name(spark):
    one = spark.range(1)
    lit = F.lit
    row = one.select(
        ids.file_id(lit("a//b/./c.h")).alias("a"), ids.file_id(lit("a/b/c.h")).alias("b"), ids.file_id(lit("../c.h")).alias("none"),
        ids.child_id(lit("p"), lit("parameter"), lit("x"), lit("t"), lit(1)).alias("p1"), ids.child_id(lit("p"), lit("parameter"), lit("renamed"), lit("u"), lit(1)).alias("p2"),
        ids.child_id(lit("p"), lit("field"), lit("x"), lit("t"), lit(1)).alias("f1"), ids.child_id(lit("p"), lit("field"), lit("x"), lit("u"), lit(2)).alias("f2"),
        ids.child_id(lit("p"), lit("field"), lit(None).cast("string"), lit("t"), lit(0)).alias("g1"), ids.child_id(lit("p"), lit("field"), lit(None).cast("string"), lit("t"), lit(1)).alias("g2"),
        ids.macro_id(lit("f"), lit("")).alias("m"), ids.entity_id(lit("tag"), lit("unit"), lit(None).cast("string"), lit("n")).alias("e1"), ids.entity_id(lit("ordinary"), lit("unit"), lit(None).cast("string"), lit("n")).alias("e2"),
    ).first()
    assert row.a == row.b and row.none is None and row.p1 == row.p2 and row.f1 == row.f2 and row.g1 != row.g2 and row.m is None and row.e1 != row.e2


def test_fold_over_ordered_rows(spark):
    """State that no window holds: how often the sum of values since it was last over ten goes over ten."""
    from lodestrand.operators import ordered

    def fold(rows):
        total, out = 0, []
        for x in rows:
            total += x["v"]
            if total > 10:
                out.append({"k": x["k"], "at": x["at"]})
                total = 0
        return out

    rows = [(k, at, (at * 7 + k) % 5) for k in (1, 2) for at in range(20)]
    got = ordered.ordered_fold(spark.createDataFrame(rows, "k long, at long, v long").repartition(3), ["k"], ["at"], "k long, at long", fold)
    want = [(x["k"], x["at"]) for k in (1, 2) for x in fold([dict(zip(("k", "at", "v"), r)) for r in rows if r[0] == k])]
    assert sorted((r.k, r["at"]) for r in got.collect()) == want
