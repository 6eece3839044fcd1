"""Constraints, merges, envelopes, provenance and target rules on small tables written by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestrand.functions import ids, target_rules
from lodestrand.operators import envelope, merging, provenance, validation
from lodestrand.plans import event_queries, package_queries

FILE = "position long, id string, logical_path string, byte_len long, line_starts array<long>, role string"
INPUT = "list string, position long, id string, name string, value string"


def found(df):
    return sorted((r.path, r.code) for r in df.collect())


def file_rows(spark, rows):
    """Rows (position, path, byte_len, line_starts, role) with ids that follow."""
    frame = spark.createDataFrame(rows, "position long, logical_path string, byte_len long, line_starts array<long>, role string")
    return frame.select("position", ids.file_id(F.col("logical_path")).alias("id"), "logical_path", "byte_len", "line_starts", "role")


def test_files(spark):
    names = [f"a{k}.h" for k in range(4)]
    held = file_rows(spark, [(k, n, 10, [0, 4], "entry") for k, n in enumerate(names)])
    by_id = [r.logical_path for r in held.orderBy("id").collect()]
    good = file_rows(spark, [(k, n, 10, [0, 4], "entry") for k, n in enumerate(by_id)])
    assert found(validation.file_violations(good)) == []
    bad = file_rows(spark, [(0, by_id[1], 10, [0, 4, 4], "entry"), (1, by_id[0], 10, [], "entry"), (2, by_id[0], 3, [0, 4], "entry"), (5, "x/../y", 3, None, "entry"), (9, "./z", 3, [1], "entry")])
    codes = found(validation.file_violations(bad))
    assert {("files[1]", "non_canonical_order"), ("files[2]", "non_canonical_order"), ("files[2].id", "duplicate_id"), ("files[5].id", "invalid_id"), ("files[5].logical_path", "invalid_file"), ("files[9].logical_path", "invalid_file")} <= set(codes)
    assert {p for p, c in codes if p.endswith("line_starts")} == {f"files[{k}].line_starts" for k in (0, 1, 2, 5, 9)}
    assert found(validation.file_violations(good.limit(0))) == []
    assert found(validation.limit_violations({"files": good}, {"files": 3})) == [("files", "limit_exceeded")] and found(validation.limit_violations({"files": good}, {"files": 4})) == []


def test_references_ranges_roles_and_containment(spark):
    keys = spark.createDataFrame([("file", "f", 10, "entry"), ("declaration", "f", None, None)], "kind string, id string, byte_len long, role string")
    refs = [("a", "file", "f", 0, 10, "entry"), ("b", "file", "g", 0, 1, None), ("c", "file", "f", 5, 11, None), ("d", "file", "f", 3, 2, None), ("e", "file", "f", 0, 1, "builtin"), ("f", "declaration", "f", None, None, None), ("g", "macro", "f", None, None, None), ("h", "file", None, 7, 1, None)]
    out = validation.reference_violations(spark.createDataFrame(refs, "path string, kind string, id string, start long, end long, role string"), keys)
    assert found(out) == [("b", "invalid_reference"), ("c", "invalid_range"), ("d", "invalid_range"), ("e", "invalid_file"), ("g", "invalid_reference")]
    children = spark.createDataFrame([("a", "p", "f", 2, 4), ("b", "p", "f", 2, 2), ("c", "p", "f", 4, 9), ("d", "p", "g", 2, 4), ("e", "q", "f", 2, 4)], "path string, parent string, file string, start long, end long")
    parents = spark.createDataFrame([("p", "f", 0, 5), ("p", "f", 8, 9)], "parent string, file string, start long, end long")
    assert found(validation.containment_violations(children, parents)) == [(x, "invalid_range") for x in "bcde"]


def test_inputs(spark):
    files = spark.createDataFrame([(0, "f1", "entry"), (1, "f2", "user"), (2, "f3", "entry")], "position long, id string, role string")
    rows = [("entry_files", 0, "f2", None, None), ("entry_files", 1, "f1", None, None), ("entry_files", 2, "gone", None, None), ("forced_includes", 0, "f2", None, None), ("forced_includes", 1, "no", None, None), ("include_search", 0, None, None, "inc/x"), ("include_search", 1, None, None, "./inc"), ("define_events", 0, None, "A_1", "x"), ("define_events", 1, None, "1A", None), ("define_events", 2, None, "B", "\x01"), ("variables", 0, None, "B", ""), ("variables", 1, None, "A=", "")]
    got = found(validation.input_violations(spark.createDataFrame(rows, INPUT), files))
    want = [("files[2].role", "invalid_file"), ("inputs.entry_files[0]", "invalid_file"), ("inputs.entry_files[1]", "non_canonical_order"), ("inputs.entry_files[2]", "invalid_reference"), ("inputs.forced_includes[1]", "invalid_reference"), ("inputs.include_search[1]", "invalid_file"), ("inputs.define_events[1]", "invalid_name"), ("inputs.define_events[2]", "invalid_name"), ("inputs.variables[1]", "invalid_name"), ("inputs.variables[1]", "non_canonical_order")]
    assert got == sorted(want)
    assert ("inputs.entry_files", "invalid_file") in found(validation.input_violations(spark.createDataFrame([], INPUT), files))


def test_completeness(spark):
    row = "code string, message string, file string, start long, end long"
    reasons = spark.createDataFrame([(0, "P1", "a", "f", 1, 2), (1, "P2", "b", None, None, None)], "position long, " + row)
    diagnostics = spark.createDataFrame([("P1", "a", "f", 1, 2, 1), ("P1", "a", "f", 1, 2, 1), ("P2", "b", None, None, None, 1), ("W", "c", None, None, None, 0)], row + ", impact int")
    assert found(validation.completeness_violations("partial", reasons, diagnostics)) == []
    assert [c for _, c in found(validation.completeness_violations("rejected", reasons, diagnostics))] == ["invalid_completeness"]
    twice = reasons.unionByName(reasons.withColumn("position", F.col("position") + 2))
    codes = found(validation.completeness_violations("partial", twice, diagnostics))
    assert [c for _, c in codes].count("invalid_completeness") == 2 and ("completeness.reasons[2]", "non_canonical_order") in codes
    missing = found(validation.completeness_violations("partial", reasons.where("position = 0"), diagnostics))
    assert len(missing) == 1 and missing[0][0].startswith("missing")


def test_children(spark):
    schema = "path string, parent string, role string, name string, tokens string, ordinal long"
    rows = [("a", "p", "parameter", "x", "t", 0), ("b", "p", "parameter", None, "t", 1), ("c", "p", "field", "x", "t", 0), ("d", "p", "field", "y", "t", 2)]
    frame = spark.createDataFrame(rows, schema).withColumn("id", ids.child_id(F.col("parent"), F.col("role"), F.col("name"), F.col("tokens"), F.col("ordinal")))
    assert found(validation.child_id_violations(frame)) == [("p.field", "non_canonical_order")]
    wrong = frame.withColumn("id", F.when(F.col("path") == "b", F.lit("child1_x")).otherwise(F.col("id"))).unionByName(frame.where("path = 'a'"))
    got = found(validation.child_id_violations(wrong))
    assert ("b.id", "invalid_id") in got and ("p.parameter", "non_canonical_order") in got and any(c == "duplicate_id" for _, c in got)


def package(spark, files=(), target=(("triple", "t"),), inputs=(), macros=(), occurrences=(), diagnostics=()):
    make = spark.createDataFrame
    return {
        "target": make(list(target), "fact string, value string"), "inputs": make(list(inputs), INPUT), "diagnostics": make(list(diagnostics), "code string, message string"),
        "files": make(list(files), "id string, logical_path string, role string, content string, byte_len long, line_starts array<long>"),
        "macros": make(list(macros), "id string, file string, name string, form string, category string, body string, tokens string, value string, support int"),
        "macro_occurrences": make(list(occurrences), "id string, macro string, file string, start long, end long, ordinal long"),
    }


def rows_of(tables):
    return {t: sorted(map(str, df.collect())) for t, df in tables.items()}


def test_merge_is_commutative_and_idempotent(spark):
    f = lambda k, content="c": (f"f{k}", f"{k}.h", "entry", content, 1, [0])
    search = ("include_search", 0, None, None, "inc")
    entry = lambda k: ("entry_files", 0, f"f{k}", None, None)
    m = ("m1", "f1", "M", "object", "integer", "1", "1", "1", 0)
    a = package(spark, [f(1), f(2)], inputs=[search, entry(1)], macros=[m], occurrences=[("o1", "m1", "f1", 0, 1, 0)], diagnostics=[("W", "x")])
    b = package(spark, [f(2), f(3)], inputs=[search, entry(3)], macros=[m], occurrences=[("o2", "m1", "f1", 5, 6, 1)], diagnostics=[("W", "x"), ("W", "y")])
    one, two = rows_of(merging.merge(a, b)), rows_of(merging.merge(b, a))
    assert one == two and len(one["files"]) == 3 and len(one["macro_occurrences"]) == 2 and len(one["diagnostics"]) == 2
    assert rows_of(merging.merge(merging.merge(a, b), b)) == one
    assert [r.split("position=")[1][0] for r in one["inputs"] if "entry" in r] == ["0", "1"]


def test_merge_names_what_differs(spark):
    f = lambda content, starts: ("f1", "1.h", "entry", content, 1, starts)
    a = package(spark, [f("c", [0])], target=[("triple", "t"), ("bits", "64")], inputs=[("define_events", 0, None, "A", "1"), ("define_events", 1, None, "B", None)])
    b = package(spark, [f(None, [0, 1])], target=[("triple", "u")], inputs=[("define_events", 0, None, "B", None), ("define_events", 1, None, "A", "1"), ("variables", 0, None, "X", "")])
    got = sorted((r.path, r.field) for r in merging.conflicts(a, b).collect())
    assert got == [("files[f1]", "content"), ("files[f1]", "line_starts"), ("inputs.define_events[0]", "element"), ("inputs.variables[0]", "length"), ("target", "bits"), ("target", "triple")]
    with pytest.raises(merging.MergeConflict, match="target"):
        merging.merge(package(spark), package(spark, target=[("triple", "v")]))


def test_digest_follows_rows_and_order_only(spark):
    rows = spark.range(1000).select("id", F.concat(F.lit("x"), F.col("id").cast("string")).alias("v"))
    one = envelope.ordered_digest(rows.repartition(1), ["id"], F.col("v"), 64)
    assert one == envelope.ordered_digest(rows.repartition(7, "v"), ["id"], F.col("v"), 64)
    assert one != envelope.ordered_digest(rows.withColumn("v", F.when(F.col("id") == 500, F.lit("y")).otherwise(F.col("v"))), ["id"], F.col("v"), 64)
    assert one != envelope.ordered_digest(rows, ["v"], F.col("v"), 64)
    empty = envelope.ordered_digest(rows.limit(0), ["id"], F.col("v"))
    assert len(empty) == 64
    mark = envelope.package_fingerprint({"a": (rows, ["id"]), "b": (rows.limit(0), ["id"])})
    assert mark.startswith("pkg2_") and mark == envelope.package_fingerprint({"b": (rows.limit(0), ["id"]), "a": (rows.repartition(3), ["id"])})


def test_sealed_envelopes_are_read_and_changed_ones_refused(spark):
    payload = '{"note":"a \\" {\\"kind\\":\\"void\\",","files":[{"id":"f","size":3}],"type":{"kind":"void"}}'
    sealed = envelope.sealed(spark.createDataFrame([(1, payload)], "id long, p string"), "package", "schema", 2, F.col("p"))
    text = sealed.first().json
    many = {
        "good": text, "kind": text.replace('"kind":"package"', '"kind":"other"'), "schema version": text.replace('"version":2},"fingerprint"', '"version":3},"fingerprint"', 1), "envelope fingerprint": text.replace('"fingerprint":"', '"fingerprint":"0', 1),
        "unit variant field": text.replace('{"kind":"void"}', '{"kind":"void","x":1}'), "limit files": text.replace('[{"id":"f","size":3}]', '[{},{},{}]'), "fields": text[:-1], "limit bytes": text.replace("a ", "a" * 2000),
    }
    frame = spark.createDataFrame(list(many.items()), "id string, json string")
    limits = envelope.Limits(1500, (("files", 2),))
    got = {r.id: r.problem for r in envelope.header_problems(frame, "package", "schema", 2, limits).collect()}
    assert got == {k: None if k == "good" else k for k in many}
    accepted = envelope.header_problems(frame, "package", "schema", 2, limits).where("problem IS NULL")
    mark = F.get_json_object("json", "$.fingerprint")
    assert accepted.where(envelope.payload_digest(F.col("json")) == mark).count() == 1
    changed = spark.createDataFrame([("x", text.replace('"size":3', '"size":4'))], "id string, json string")
    assert changed.where(envelope.payload_digest(F.col("json")) == mark).count() == 0
    assert [tuple(r) for r in envelope.unpacked(accepted, {"files": "id string, size long"})["files"].collect()] == [("good", 0, "f", 3)]


def test_ranges_of_several_tables_in_one_join(spark):
    segments = spark.createDataFrame([("g", 0, 10, "a.h", 100, 110), ("g", 10, 20, "a.h", 300, 310), ("g", 25, 30, "b.h", 0, 5), ("g", 20, 25, "a.h", 0, 5)], "file string, s_start long, s_end long, o_file string, o_start long, o_end long")
    rows = spark.createDataFrame([("d1", "g", 2, 15, 2, 4, 0), ("d2", "g", 22, 28, None, None, 0), ("d3", "g", 26, 40, 26, 27, 2)], "id string, file string, s long, e long, ns long, ne long, support int")
    ranges = provenance.range_columns(rows, "declarations", "file", ["id"], {"range": (F.col("s"), F.col("e")), "name": (F.col("ns"), F.col("ne"))})
    mapped, gaps = provenance.remap_ranges(ranges, segments, 8)
    assert sorted((r.key, r.column, r.o_file, r.o_start, r.o_end) for r in mapped.collect()) == [("d1", "name", "a.h", 100, 110), ("d1", "range", "a.h", 100, 310), ("d3", "name", "b.h", 0, 5)]
    assert sorted((r.key, r.column) for r in gaps.collect()) == [("d2", "range"), ("d3", "range")]
    assert {(r.id, r.support) for r in provenance.lowered_support(rows, ["id"], gaps, "declarations").collect()} == {("d1", 0), ("d2", 1), ("d3", 2)}
    assert provenance.gap_diagnostics(gaps).where("impact = 1 AND code = 'P2000'").count() == 2


def test_every_range_is_mapped_or_lost_in_one_pass(spark):
    segments = spark.createDataFrame([("g", 0, 10, "a.h", 100, 110), ("g", 10, 20, "a.h", 300, 310), ("g", 22, 22, "a.h", 0, 0)], "file string, s_start long, s_end long, o_file string, o_start long, o_end long")
    given = [("d", "g", "across", 9, 11), ("d", "g", "long", 0, 20), ("d", "g", "out", 15, 25), ("d", "g", "empty", 5, 5), ("d", "g", "behind", 40, 50), ("d", "h", "elsewhere", 0, 5), ("d", None, "nowhere", 0, 5), ("e", "g", "across", 9, 11)]
    ranges = spark.createDataFrame(given, "table string, file string, key string, r_start long, r_end long").withColumn("column", F.lit("c"))
    for parts in (None, 7):
        out = provenance.remapped(ranges, segments, 4, parts)
        got = {(r.table, r.file, r.key): (r.o_file, r.o_start, r.o_end) for r in out.collect()}
        lost = (None, None, None)
        assert got == {(t, f, k): ("a.h", 100, 310) if k in ("across", "long") else lost for t, f, k, _, _ in given} and out.count() == len(given)
    assert out.rdd.getNumPartitions() == 7
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_ranges_of_conversations_are_dealt_by_turns(spark, tmp_path, monkeypatch):
    turns = [(c, t, "user", "x" * (70 * t + c)) for c in range(12) for t in range(4)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(package_queries, "TURNS", 4, raising=False)
    out = package_queries.package_remap(spark, str(tmp_path))
    assert out.rdd.getNumPartitions() == 13  # as many as turns ask for, however few bytes they are
    starts = sum(len(range(0, sum(70 * t + c for t in range(4)) + 1, 120)) for c in range(12))
    assert out.count() == 3 * starts and out.where("o_file IS NOT NULL").count() > starts
    monkeypatch.setattr(event_queries, "TURNS", 4, raising=False)
    cut = event_queries.provenance_remap(spark, str(tmp_path))
    assert cut.rdd.getNumPartitions() == 13
    assert cut.count() == sum(len(range(0, sum(70 * t + c for t in range(4)), 120)) for c in range(12))


def test_include_stacks(spark):
    text = 'x\n# 1 "m.c"\na\n# 1 "h\\"1" 1\nb\nc\n# 7 "deep" 1 3\nd\n# 3 "h\\"1" 2\ne\n# 9 "m.c" 2\nf\n# 1 "m.c" 2\ng\n# 5 "q" 1 2\nh\n#12 "no"'
    texts = spark.createDataFrame([(1, text), (2, ""), (3, None)], "k long, t string")
    at = lambda c: text.index(f"\n{c}\n") + 1
    offsets = spark.createDataFrame([(1, 0)] + [(1, at(c)) for c in "abcdefgh"] + [(1, len(text) - 2), (2, 0), (3, 0)], "k long, offset long")
    got = {(r.k, r.offset): (r.file, r.line, [tuple(s) for s in r.stack]) for r in provenance.include_stacks(texts, "k", "t", offsets).collect()}
    h = 'h\\"1'
    want = {
        (1, 0): ("", 1, []), (1, at("a")): ("m.c", 1, []), (1, at("b")): (h, 1, [("m.c", 2)]), (1, at("c")): (h, 2, [("m.c", 2)]), (1, at("d")): ("deep", 7, [("m.c", 2), (h, 3)]), (1, at("e")): (h, 3, [("m.c", 2)]), (1, at("f")): ("m.c", 9, []),
        (1, at("g")): ("m.c", 1, []), (1, at("h")): ("q", 5, []), (1, len(text) - 2): ("q", 6, []), (2, 0): ("", 1, []), (3, 0): ("", 1, []),
    }
    assert got == want


def test_directories_that_a_search_used(spark):
    files = [("a/x.h", "1"), ("a/b/y.h", "2"), ("c/z.h", "3"), ("a", "4")]
    make = lambda rows: spark.createDataFrame(rows, "path string, digest string")
    lookups = spark.createDataFrame([("a",), ("a/b",), ("a",), ("none",)], "root string")
    of = lambda rows: {r.root: (r.n_files, r.content) for r in provenance.searched_directories(make(rows), lookups).collect()}
    one = of(files)
    assert {k: n for k, (n, _) in one.items()} == {"a": 2, "a/b": 1}
    assert of(files[::-1]) == one and of([("a/x.h", "9"), *files[1:]])["a"] != one["a"] and of([("a/x.h", "9"), *files[1:]])["a/b"] == one["a/b"]


def test_target_rules(spark):
    columns = ("id", "machine", "pointer_bits", "endian", "system", "environment", "object_format", "vendor", "compiler", "long_double", "long_double_bits", "data_model", "int_bits", "long_bits")
    rows = [
        ("linux", "x86_64", 64, "little", "linux", "gnu", "elf", "unknown", "gcc", "x87_extended80", 128, "lp64", 32, 64), ("windows", "x86_64", 64, "little", "windows", "msvc", "coff", "pc", "msvc", "ieee_binary64", 64, "llp64", 32, 32),
        ("ibm", "powerpc64", 64, "big", "none", "none", "xcoff", "ibm", "clang", "ibm_double_double128", 128, "lp64", 32, 64), ("apple", "aarch64", 64, "little", "macos", "gnu", "elf", "unknown", "gcc", "ieee_binary128", 64, "lp64", 32, 32),
        ("wasm", "wasm32", 32, "little", "none", "none", "wasm", "unknown", "clang", "ieee_binary128", 128, "ilp32", 32, 32), ("odd", "z80", 16, "little", None, "none", "elf", "unknown", "clang", "ieee_binary64", 64, "ilp32", 32, 32),
    ]
    frame = spark.createDataFrame(rows, ", ".join(f"{c} {'int' if c.endswith('bits') else 'string'}" for c in columns))
    got = {}
    for r in target_rules.target_violations(frame, target_rules.rules_table(spark)).collect():
        got.setdefault(r.id, set()).add(r.rule)
    assert got == {"apple": {"environment", "format", "vendor", "compiler", "floating", "model"}, "odd": {"environment", "machine", "system", "format", "vendor", "model"}}
