"""Operators on tiny inputs with rows worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestrand.functions import text as T
from lodestrand.operators import closure, intervals, ordered, sets


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_closure_of_a_cycle_raises_needs(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "a", 1), ("b", "c", 1), ("d", "b", 2)], "src string, dst string, need int")
    roots = spark.createDataFrame([("a", 1), ("d", 2)], "id string, need int")
    assert rows(closure.closure(roots, edges), "id", "need") == [("a", 1), ("b", 2), ("c", 1), ("d", 2)]


def test_closure_of_nothing(spark):
    edges = spark.createDataFrame([], "src string, dst string, need int")
    assert closure.closure(spark.createDataFrame([], "id string, need int"), edges).count() == 0


def test_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "e")], "src string, dst string")
    assert rows(closure.on_cycle(edges), "id") == [("a",), ("b",), ("c",), ("e",)]


def test_merge_is_idempotent_and_finds_conflicts(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, None)], "k int, v string")
    assert rows(sets.merge(a, a, ["k"]), "k", "v") == [(1, "x"), (2, "y")]
    with pytest.raises(sets.Conflict):
        sets.merge(a, b, ["k"])


def test_carry_forward_with_an_unknown_value(spark):
    # X, Y = 5, Z, W = unknown, V, U = 9, T
    data = [(1, None, False), (2, 5, False), (3, None, False), (4, None, True), (5, None, False), (6, 9, False), (7, None, False)]
    df = spark.createDataFrame([(0, *x) for x in data], "g int, o int, e long, u boolean")
    out = ordered.carry_forward(df, ["g"], ["o"], F.col("e"), F.col("u"))
    assert [r["value"] for r in out.orderBy("o").collect()] == [0, 5, 6, None, None, 9, 10]


def test_budget_stops_for_good(spark):
    df = spark.createDataFrame([(0, 1, 4), (0, 2, 9), (0, 3, 1)], "g int, o int, n int")
    assert rows(ordered.within_budget(df, ["g"], ["o"], F.col("n"), 10), "o") == [(1,)]


def test_unmatched_closes(spark):
    df = spark.createDataFrame([(0, i, c) for i, c in enumerate(")(())()")], "g int, o int, c string")
    out = ordered.nesting_depth(df, ["g"], ["o"], F.col("c") == "(", F.col("c") == ")", floor=True)
    assert [r["depth"] for r in out.orderBy("o").collect()] == [0, 1, 2, 1, 0, 1, 0]


def test_overlap_gives_each_pair_once(spark):
    a = spark.createDataFrame([("f", 0, 100), ("f", 5, 6)], "f string, r_start long, r_end long")
    b = spark.createDataFrame([("f", 0, 5), ("f", 5, 50), ("f", 100, 101)], "f string, s_start long, s_end long")
    assert rows(intervals.overlap_join(a, b, ["f"], 7), "r_start", "s_start") == [(0, 0), (0, 5), (5, 5)]


def test_remap_fails_where_segments_differ(spark):
    segments = spark.createDataFrame([("t", 0, 10, "a.h", 100, 110), ("t", 10, 20, "b.h", 0, 10)], "t string, s_start long, s_end long, file string, o_start long, o_end long")
    ranges = spark.createDataFrame([("t", 1, 2, 9), ("t", 2, 8, 12)], "t string, id int, r_start long, r_end long")
    assert rows(intervals.remap(ranges, segments, ["t"], ["id"], ["file"], 4), "id", "file", "o_start", "o_end") == [(1, "a.h", 100, 110)]


def test_longest_prefix(spark):
    paths = spark.createDataFrame([(1, "/a/b/c"), (2, "/ab/c"), (3, None)], "id int, p string")
    roots = spark.createDataFrame([("/a", "x"), ("/a/b", "y")], "root string, logical string")
    assert rows(intervals.longest_prefix(paths, F.col("p"), roots), "id", "logical") == [(1, "y"), (2, None), (3, None)]


def test_integers(spark):
    cases = {"0x1fU": 31, "0b101": 5, "017": 15, "42ull": 42, "08": None, "x": None, "0": 0, "99999999999999999999": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["v"] for r in df.select("t", T.parse_integer(F.col("t")).alias("v")).collect()} == cases


def test_paths(spark):
    cases = {"a//b/./c": "a/b/c", "a\\b": "a/b", "../a": None, "/a": None, "C:x": None, ".": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["v"] for r in df.select("t", T.normalize_path(F.col("t")).alias("v")).collect()} == cases


def test_framing_keeps_lists_apart(spark):
    df = spark.createDataFrame([(["ab", "c"],), (["a", "bc"],)], "x array<string>")
    assert df.select(T.fingerprint("t1_", F.col("x")).alias("f")).distinct().count() == 2


def test_overlapping_roots(spark):
    roots = spark.createDataFrame([("/a", "x"), ("/a/b", "y"), ("/ab", "z"), ("/c", "u"), ("/c", "v")], "root string, logical string")
    assert rows(intervals.overlapping_roots(roots), "root", "within") == [("/a/b", "/a"), ("/c", "/c")]
