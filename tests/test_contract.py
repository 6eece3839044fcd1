"""Exact integers at their ends, selections and what they keep, nested rows of packages."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestrand.functions import integers
from lodestrand.operators import retention, validation

from .test_package_validation import broken, package  # noqa: F401


def test_exact_integers(spark):
    good = [("signed", str(v)) for v in (0, 1, -1, 10**19, -(2**127), 2**127 - 1)] + [("unsigned", str(v)) for v in (0, 2**64, 2**128 - 1)]
    bad = [("signed", str(2**127)), ("signed", str(-(2**127) - 1)), ("unsigned", str(2**128)), ("unsigned", "-1"), ("signed", "-0"), ("signed", "00"), ("signed", "+1"), ("signed", ""), ("signed", "-"), ("signed", "1\n"), ("signed", "١"), ("odd", "1"), ("signed", None), (None, "1")]
    df = spark.createDataFrame(good + bad, "sign string, value string").withColumn("text", integers.encode(F.col("sign"), F.col("value")))
    rows = df.select("sign", "value", "text", integers.decode(F.col("text")).alias("back"), integers.order_key(F.col("value")).alias("k")).collect()
    assert {(r.sign, r.value) for r in rows if r.text is not None} == set(good)
    assert all(tuple(r.back) == (r.sign, r.value) for r in rows if r.text is not None)
    signed = [r for r in rows if (r.sign, r.value) in good]
    assert [r.value for r in sorted(signed, key=lambda r: (r.k, r.sign))] == [r.value for r in sorted(signed, key=lambda r: (int(r.value), r.sign))]


def test_strict_objects(spark):
    texts = ['{"value":"5","sign":"signed"}', '{"sign":"signed","value":5}', '{"sign":"signed"}', '{"sign":"signed","value":"5","more":"x"}', '["signed","5"]', "nothing", None]
    got = [r.d for r in spark.createDataFrame([(t,) for t in texts], "t string").select(integers.decode(F.col("t")).alias("d")).collect()]
    assert [None if g is None else tuple(g) for g in got] == [("signed", "5")] + [None] * 6


def _tables(spark):
    declarations = spark.createDataFrame([("a", "alias", 0), ("r", "record", 0), ("f", "function", 1), ("z", "record", 0)], "id string, kind string, support int")
    diagnostics = spark.createDataFrame([("P2", "m", None, None, None, 1, "z"), ("P1", "m", None, None, None, 1, None), ("P1", "m", None, None, None, 1, "a"), ("W1", "w", None, None, None, 0, "r")], "code string, message string, file string, start long, end long, impact int, declaration string")
    edges = spark.createDataFrame([("a", "r", 2), ("f", "a", 1)], "src string, dst string, need int")
    files = spark.createDataFrame([("x",)], "id string")
    return {"declarations": declarations, "diagnostics": diagnostics, "files": files}, edges


def test_retain(spark):
    tables, edges = _tables(spark)
    one = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    d = tables["declarations"]
    kept, state = retention.retain(tables, edges, retention.selection(d, one("f", "f")))
    assert {r.id for r in kept["declarations"].collect()} == {"f", "a", "r"}
    assert sorted((r.code, r.declaration or "") for r in kept["diagnostics"].collect()) == [("P1", ""), ("P1", "a"), ("W1", "r")]
    assert [(r.position, r.code) for r in kept["reasons"].collect()] == [(0, "P1")]
    assert state == "partial" and kept["files"].count() == 1
    assert {r.id for r in retention.retain(tables, edges, retention.selection(d))[0]["declarations"].collect()} == {"a", "r", "z"}
    for roots in (retention.selection(d, one("gone")), retention.selection(d, one("a"), opaque=True)):
        with pytest.raises(retention.BadSelection):
            retention.retain(tables, edges, roots)
    with pytest.raises(retention.BadSelection):
        retention.retain(tables, edges.unionByName(spark.createDataFrame([("r", "lost", 2)], "src string, dst string, need int")), retention.selection(d, one("a")))
    empty, state = retention.retain({**tables, "diagnostics": tables["diagnostics"].limit(0)}, edges, retention.selection(d, one()))
    assert empty["declarations"].isEmpty() and state == "complete"


def test_nested_rows(package, spark):  # noqa: F811
    f = package["files"].where("role = 'entry'").first().id
    make = spark.createDataFrame
    nested = {
        "attributes": make([("d.attributes[0]", "packed", "packed", f, 0, 4), ("d.attributes[1]", "", "x", f, 0, 900)], "path string, name string, spelling string, file string, start long, end long"),
        "related": make([("r0", 0, 0, f, 3, 4, "m"), ("r1", 0, 1, f, 3, 4, "m"), ("r2", 1, 0, f, 1, 2, "m")], "path string, of long, position long, file string, start long, end long, message string"),
        "include_chain": make([("i0", f, 0, 5, "gone")], "path string, file string, start long, end long, included string"),
        "macro_expansions": make([("e0", f, 9, 2, None, None, None), ("e1", f, 0, 2, f, 0, 999)], "path string, file string, start long, end long, d_file string, d_start long, d_end long"),
    }
    assert broken(package, **nested) == {
        ("d.attributes[1]", "invalid_name"), ("d.attributes[1].range", "invalid_range"), ("diagnostics[0].related[1]", "non_canonical_order"),
        ("i0.included", "invalid_reference"), ("e0.invocation", "invalid_range"), ("e1.definition", "invalid_range"),
    }


def test_diagnostics_of_another_target(package):  # noqa: F811
    tables = package | {"diagnostics": package["diagnostics"].withColumn("target", F.lit("t"))}
    paths = lambda target: {r.path for r in validation.package_violations(tables, "partial", target=target).collect()}
    assert paths("t") == set() and paths("u") == {"diagnostics[0].target", "diagnostics[1].target"}
