"""A whole package in tables: sound as made, and each fault found by its path."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestrand.functions import ids
from lodestrand.operators import validation

OCCURRENCE = "position long, of string, file string, start long, end long, name_start long, name_end long, tokens string, ordinal long, origin string"


@pytest.fixture(scope="module")
def package(spark):
    """Two files, an alias of a record, the record with a field, a function with a parameter, a macro; everything by ids that follow."""
    make = spark.createDataFrame
    by_id = lambda df: df.orderBy("id").rdd.map(lambda r: r).collect()
    files = make([("a.h", 100, [0, 10], "user"), ("m.c", 80, [0], "entry")], "logical_path string, byte_len long, line_starts array<long>, role string").withColumn("id", ids.file_id(F.col("logical_path")))
    files = make([(k, *r) for k, r in enumerate(by_id(files))], "position long, logical_path string, byte_len long, line_starts array<long>, role string, id string")
    f = {r.logical_path: r.id for r in files.collect()}
    named = make([("ordinary", "unit", None, "T", "t1", 0, "alias", "none", None), ("tag", "file", f["a.h"], "R", "t2", 0, "record", "none", None), ("ordinary", "unit", None, "run", "t3", 0, "function", "external", "run")], "namespace string, scope string, owner string, name string, tokens string, ordinal long, kind string, linkage string, link_name string")
    named = named.withColumn("id", ids.entity_id(F.col("namespace"), F.col("scope"), F.col("owner"), F.col("name")))
    declarations = make([(k, *r) for k, r in enumerate(by_id(named))], "position long, namespace string, scope string, owner string, name string, tokens string, ordinal long, kind string, linkage string, link_name string, id string").withColumns({"convention": F.lit("c"), "support": F.lit(0)})
    d = {r.name: r.id for r in declarations.collect()}
    occurrences = make([(0, d["T"], f["m.c"], 0, 20, 17, 18, "t1", 0, "entry"), (1, d["R"], f["a.h"], 5, 60, 12, 13, "t2", 0, "user"), (2, d["run"], f["m.c"], 30, 70, None, None, "t3", 0, "entry")], OCCURRENCE)
    occurrences = occurrences.withColumn("id", ids.occurrence_id(F.col("of"), F.col("file"), F.col("tokens"), F.col("ordinal")))
    children = make([("R.x", d["R"], "field", "x", "tx", 0, f["a.h"], 20, 26), ("run.p", d["run"], "parameter", "p", "tp", 0, f["m.c"], 40, 45)], "path string, parent string, role string, name string, tokens string, ordinal long, file string, start long, end long")
    children = children.withColumn("id", ids.child_id(F.col("parent"), F.col("role"), F.col("name"), F.col("tokens"), F.col("ordinal")))
    node = "tree string, node string, parent string, ordinal long, kind string, context string, ref string, bound string"
    types = make([(d["T"], "0", None, 0, "record_ref", "general", d["R"], None), ("x", "0", None, 0, "array", "field", None, "4"), ("x", "0.0", "0", 0, "pointer", None, None, None), ("x", "0.0.0", "0.0", 0, "alias_ref", None, d["T"], None), (d["run"], "0", None, 0, "void", "general", None, None)], node)
    macros = make([(0, f["a.h"], "M")], "position long, file string, name string").withColumn("id", ids.macro_id(F.col("file"), F.col("name")))
    m = macros.first().id
    macro_occurrences = make([(0, m, f["a.h"], 0, 4, None, None, "tm", 0, "user")], OCCURRENCE).withColumn("id", ids.occurrence_id(F.col("of"), F.col("file"), F.col("tokens"), F.col("ordinal")))
    reason = "position long, code string, message string, file string, start long, end long"
    return {
        "files": files, "inputs": make([("entry_files", 0, f["m.c"], None, None)], "list string, position long, id string, name string, value string"), "declarations": declarations, "occurrences": occurrences, "children": children, "types": types,
        "macros": macros, "macro_occurrences": macro_occurrences, "diagnostics": make([(0, "P1", "lost", f["m.c"], 1, 2, 1, d["T"]), (1, "W1", "odd", None, None, None, 0, None)], reason + ", impact int, declaration string"), "reasons": make([(0, "P1", "lost", f["m.c"], 1, 2)], reason),
    }


def broken(tables, state="partial", **changed):
    return {(r.path, r.code) for r in validation.package_violations(tables | changed, state).collect()}


def test_a_sound_package(package):
    assert broken(package) == set()
    assert broken({t: df.limit(0) for t, df in package.items()}, "complete") == {("inputs.entry_files", "invalid_file")}


def test_faults_by_path(package):
    p = package
    when = lambda df, c, test, value: df.withColumn(c, F.when(F.expr(test), F.lit(value)).otherwise(F.col(c)))
    alias = p["declarations"].where("kind = 'alias'").first()
    run = p["declarations"].where("kind = 'function'").first()
    changed = {
        "declarations": when(when(when(p["declarations"], "link_name", "kind = 'function'", ""), "convention", "kind = 'function'", "unsupported"), "linkage", "kind = 'alias'", "internal"),
        "occurrences": when(when(p["occurrences"], "end", "position = 1", 500), "name_end", "position = 0", 30),
        "children": when(when(p["children"], "start", "path = 'R.x'", 2), "ordinal", "path = 'run.p'", 1),
        "types": when(when(p["types"], "ref", "kind = 'record_ref'", alias.id), "kind", "kind = 'record_ref'", "alias_ref"),
        "macros": when(p["macros"], "name", "position = 0", "1M"),
        "diagnostics": when(p["diagnostics"], "declaration", "position = 0", "gone"),
        "reasons": p["reasons"].limit(0),
    }
    got = broken(p, **changed)
    want = {
        (f"declarations[{run.position}].link_name", "invalid_name"), (f"declarations[{run.position}].support", "invalid_type"), (f"declarations[{alias.position}].scope", "invalid_id"),
        ("occurrences[1].range", "invalid_range"), ("occurrences[0].name_range", "invalid_range"), ("R.x", "invalid_range"), ("run.p.id", "invalid_id"), (f"{run.id}.parameter", "non_canonical_order"),
        (alias.id, "alias_cycle"), ("macros[0].name", "invalid_name"), ("macros[0].id", "invalid_id"), ("diagnostics[0].declaration", "invalid_reference"),
    }
    assert want <= got
    rest = got - want
    assert len(rest) == 1 and next(iter(rest))[0].startswith("missing") and next(iter(rest))[1] == "invalid_completeness"
