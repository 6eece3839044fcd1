"""Package algebra over small units, and target facts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestrand.functions.target import Target, parse_triple
from lodestrand.operators import sets
from lodestrand.operators.packages import Incomplete, Package

A = "struct a; struct b { struct a *next; int n; }; typedef struct b B; B make(int n); struct a { B b; }; int other;"


@pytest.fixture(scope="module")
def package(spark):
    return Package.of_texts(spark.createDataFrame([("a.h", A)], "file string, text string"))


def ids(p, *names):
    rows = {(r.name, r.kind): r.id for r in p.declarations.collect()}
    return [next(i for (n, _), i in rows.items() if n == name) for name in names]


def names(p):
    return sorted(r.name for r in p.declarations.collect())


def test_retain_takes_what_is_referred_to(package):
    kept = package.retain(package.roots(ids(package, "make")))
    assert names(kept) == ["B", "a", "b", "make"] and kept.completeness() == "complete"
    assert names(package.retain(package.roots(ids(package, "other")))) == ["other"]
    with pytest.raises(KeyError):
        package.retain(package.roots(["decl1_" + "0" * 64]))
    with pytest.raises(ValueError):
        package.roots([])


def test_merge_is_idempotent_and_commutes(spark, package):
    other = Package.of_texts(spark.createDataFrame([("b.h", "int more(void); int other;")], "file string, text string"))
    assert package.merge(package).fingerprint() == package.fingerprint()
    assert package.merge(other).fingerprint() == other.merge(package).fingerprint() != package.fingerprint()
    clash = Package.of_texts(spark.createDataFrame([("c.h", "long other;")], "file string, text string"))
    with pytest.raises(sets.Conflict):
        package.merge(clash)


def test_many_units_are_one_package(spark):
    both = Package.of_texts(spark.createDataFrame([("a.h", A), ("b.h", "int other; long make;")], "file string, text string"))
    assert both.occurrences.where("file = 'b.h'").count() == 2 and both.conflicts().count() == 1


def test_completion_needs_definitions_only_where_asked(spark):
    text = "struct s; struct s *p(void); struct s v; enum e; "
    p = Package.of_texts(spark.createDataFrame([("a.h", text)], "file string, text string"))
    assert p.into_complete(p.roots(ids(p, "p"))).count() == 2
    with pytest.raises(Incomplete) as e:
        p.into_complete(p.roots(ids(p, "v")))
    assert [x[1] for x in e.value.blockers] == ["incomplete"]


def test_partial_and_rejected(spark):
    of = lambda text: Package.of_texts(spark.createDataFrame([("a.h", text)], "file string, text string"))
    assert of("int a;").completeness() == "complete" and of("_Static_assert(1);").completeness() == "complete"
    assert of("enum { A = (1)+(1) };").completeness() == "partial" and of("int a[-1];").completeness() == "rejected"
    lost = of("int a b; int c;")
    assert lost.completeness() == "partial" and names(lost) == ["c"] and lost.reasons().first().code == "P0002"


def test_encode_and_decode(spark, package):
    again = Package.decode(package.encode())
    assert again.fingerprint() == package.fingerprint()
    with pytest.raises(ValueError):
        Package.decode(package.encode().withColumn("json", F.replace("json", F.lit('"need"'), F.lit('"want"'))))


def test_constraints(spark, package):
    assert package.violations().count() == 0
    broken = Package(package.declarations.where("name <> 'B'"), package.occurrences, package.edges, package.diagnostics)
    assert {r.code for r in broken.violations().collect()} == {"occurrence of nothing", "reference to nothing"}


def test_nothing(spark):
    none = Package.of_texts(spark.createDataFrame([], "file string, text string"))
    assert none.declarations.count() == 0 and none.completeness() == "complete" and none.violations().count() == 0


def test_triples():
    assert parse_triple("x86_64-pc-linux-gnu").system == "linux" and parse_triple("arm64-apple-darwin20.1").environment == ""
    for bad in ("x86_64", "z80-a-linux", "x86_64--linux", "a-b-c-d-e"):
        with pytest.raises(ValueError):
            parse_triple(bad)


def test_target_facts():
    good = Target("x86_64-pc-linux-gnu", "elf", 64, "lp64", {"char": (8, 8), "short": (16, 16), "int": (32, 32), "long": (64, 64), "long_long": (64, 64)}, ("a", "b"), ("-fvisibility=hidden", "-fvisibility=default"))
    assert good.violations() == [] and good.default_visibility() == "default" and good.fingerprint().startswith("tgt1_")
    bad = Target("x86_64-pc-windows-musl", "elf", 32, "lp64", {"int": (64, 24), "long": (32, 32)}, ("b", "a"), ("\x01",), "big")
    assert len(bad.violations()) == 9
