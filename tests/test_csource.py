"""Preprocessing of small units, with results worked out by hand."""

from __future__ import annotations

from random import Random

import pytest
from pyspark.sql import functions as F

from lodestrand.csource import conditions, lexing
from lodestrand.csource.lexing import lexemes, line_starts, text_of, tokenize
from lodestrand.csource.macros import arguments, parse_definition, value_and_category
from lodestrand.csource.preprocess import Config, Limits, Unit, unsafe_spelling
from lodestrand.plans import source_queries


def run(text: str, policy: str = "checked", files: dict[str, str] | None = None, **more) -> Unit:
    files = {k: v.encode() for k, v in (files or {}).items()} | {"main.c": text.encode()}
    return Unit(Config(["main.c"], policy=policy, **more), files).run()


def words(unit: Unit) -> str:
    return " ".join(text_of(unit.tokens).split())


def codes(unit: Unit) -> list[str]:
    return [d.code for d in unit.diagnostics]


def test_tokens_cover_the_text():
    text = 'int x = 0x1e+3 /* c\n */ + .5e-3; // end\nL"a\\"b" u8"é" \'\\n\' a->b <<= ... é $'
    tokens = tokenize(text)
    assert text_of(tokens) == text
    assert [t.text for t in tokens if t.kind == "number"] == ["0x1e+3", ".5e-3"]
    assert [t.text for t in tokens if t.kind == "string"] == ['L"a\\"b"', 'u8"é"']


def test_continued_lines_keep_byte_ranges():
    raw = "ab\\\ncd \\\r\n ef"
    tokens = [t for t in tokenize(raw) if t.kind == "identifier"]
    assert [(t.text, t.start, t.end) for t in tokens] == [("abcd", 0, 6), ("ef", 11, 13)]
    assert line_starts(b"a\n\nb") == [0, 2, 3]


def test_totals_by_kind_make_no_tokens(monkeypatch):
    pieces = ["u8", "L", '"', "'", "\\", "\n", "\r", " ", "\t", "\x0b", "\x00", "\x85", "é日", "a_9", "x", ".", "5", "e+", "//", "/*", "*/", "#", "##", "<<", "=", "!", "->", "-", "&", ",", ";", "(", "@", "`", "word word. ", "\\\n", "\\\r\n"]
    random = Random(11)
    texts = ["", "\0", 'L"a" xL"b" u8\'c\' don\'t', "a  b\n\n .5 .b !=! !"] + ["".join(random.choices(pieces, k=random.randint(1, 30))) for _ in range(3000)]
    want = {}
    for t in (t for text in texts for t in tokenize(text)):
        seen = want.setdefault(t.kind, [0, 0])
        seen[0], seen[1] = seen[0] + 1, seen[1] + t.end - t.start
    assert lexing.kind_totals(t.encode() for t in texts) == want
    monkeypatch.setattr(lexing, "Token", None)
    assert lexing.kind_totals([b"int caf\xc3\xa9, x.y;\n#if 1 // c\n"]) == {"identifier": [5, 10], "space": [4, 4], "punctuation": [4, 5], "newline": [2, 2], "hash": [1, 1], "number": [1, 1], "line_comment": [1, 4]}


@pytest.mark.parametrize(
    ("text", "lenient", "checked", "constant"),
    [
        ("1 + 2 * 3", 7, 7, 7), ("1 / 0", 0, None, None), ("0 && 1 / 0", 0, 0, None), ("1 ? 2 : 1 / 0", 2, 2, 2), ("NAME", 0, 0, None), ("10u", 10, None, 10), ("~0", -1, None, -1), ("'a'", 97, None, None),
        ("09", 0, None, None), ("-7 / 2", -3, -3, -3), ("-7 % 2", -1, -1, -1), ("1 << 63", 1 << 63, None, 1 << 63), ("9223372036854775807 + 1", 1 << 63, None, 1 << 63), ("", 0, None, None), ("1 2", 1, None, None),
        ("(1", 1, None, None), ("0x10 == 16 && 0b11 == 3 && 017 == 15", 1, 1, 1), ("-1 & 1", 1, None, 1), ("5 >> 1", 2, 2, 2), ("1 ? 2", 2, None, None), ("!3 || 2", 1, 1, 1),
    ],
)
def test_three_evaluators(text, lenient, checked, constant):
    tokens = tokenize(text)
    got = [conditions.value_of(tokens, p) for p in (conditions.LENIENT, conditions.CHECKED, conditions.CONSTANT)]
    assert got == [lenient, checked, constant]


def test_policies_share_a_parse(monkeypatch):
    parsed = []
    parse = conditions.parse
    monkeypatch.setattr(conditions, "parse", lambda t, p: parsed.append(p) or parse(t, p))
    assert conditions.values_of(lexemes("(3 + \\\n4) * 2 - NAME /* é */")) == [14, 14, None] and len(parsed) == 1
    assert conditions.values_of(lexemes("(1")) == [1, None, None] and len(parsed) == 3
    assert conditions.values_of(lexemes("2 - 3 - 4 << 1 + 1 < 0 ? 7 : 8")) == [7, None, 7]
    deep = "(" * 150 + "1" + ")" * 150
    assert conditions.values_of(lexemes(deep)) == [1, 1, 1]


def test_conditions_are_dealt_out(spark, tmp_path):
    spark.range(40).selectExpr("id AS p_partkey", "CAST(id AS int) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    out = source_queries.condition_policies(spark, str(tmp_path))
    assert out.select(F.spark_partition_id()).distinct().count() > 1  # one file of few bytes
    assert [tuple(r) for r in out.where("p_partkey IN (5, 8, 26)").orderBy("p_partkey").collect()] == [(5, -10, None, None), (8, 19, 19, None), (26, 743, 743, 743)]


def test_conditionals_and_inactive_errors():
    unit = run("#if 0\n#error no\n#elif defined(A) || 1\nyes\n#if 0\nx\n#else\ninner\n#endif\n#else\nno\n#endif\n")
    assert words(unit) == "yes inner" and not codes(unit)


def test_malformed_conditionals():
    assert codes(run("#endif\n#else\n")) == ["E2106", "E2106"]
    assert codes(run("#if 1\n#else\n#else\n#endif\n")) == ["E2107"]
    assert codes(run("#if 1\n")) == ["E2105"]
    assert codes(run("#if 1 +\n#endif")) == ["E2113"]
    assert codes(run("#if defined\n#endif")) == ["E2113"]


def test_self_reference_ends():
    assert words(run("#define A B\n#define B A\nA B\n")) == "A B"


def test_function_like_macros():
    text = "#define F(x, y) x + y\n#define G(...) f(__VA_ARGS__)\n#define H() h\nF(1, (2, 3)) G(a, b) H() F G\n"
    assert words(run(text)) == "1 + (2, 3) f(a,b) h F G"
    assert codes(run("#define F(x) x\nF(1, 2)\n")) == ["E2110"]
    assert codes(run("#define F(x) x\nF(1\n")) == ["E2112"]


def test_stringify_and_paste_are_reported():
    unit = run('#define S(x) #x\n#define P(a, b) a ## b\nS(q "r") P(x, 1)\n')
    assert words(unit) == '"q \\"r\\"" x1' and codes(unit) == ["E2111", "E2111"]


def test_policies_differ_in_when_they_expand():
    text = "X\n#define X 1\nX\n#undef X\nX\n"
    assert words(run(text)) == "X 1 X" and words(run(text, "lenient")) == "X X X"
    assert words(run("X\n#define X 1\n", "lenient")) == "1"
    assert codes(run("a # b\n")) == ["E2108"] and not codes(run("a # b\n", "lenient"))


def test_includes():
    files = {"inc/a.h": '#pragma once\n#include "b.h"\nA', "inc/b.h": "B", "sys/b.h": "SYS"}
    unit = run('#include <a.h>\n#include <a.h>\n#include "b.h"\n#include <stdbool.h>\ntrue\n', files=files, roots=["inc", "sys"])
    assert words(unit) == "B A B 1" and not codes(unit)
    assert unit.used["<builtin>/stdbool.h"] == "builtin" and unit.used["main.c"] == "entry"
    a = next(t for t in unit.tokens if t.text == "A")
    assert a.chain[0][3] == "inc/a.h"


def test_include_problems():
    assert codes(run('#include "no.h"\n')) == ["P2100"] and codes(run('#include "../x.h"\n')) == ["E2102"]
    assert unsafe_spelling("/a") and unsafe_spelling("a/../b") and not unsafe_spelling("a..b")
    loop = run('#include "main.c"\n', limits=Limits().tightened(include_depth=5))
    assert codes(loop) == ["E2203"]
    with pytest.raises(ValueError):
        Limits().tightened(tokens=10**9)


def test_directives_that_are_not_followed():
    text = '#pragma pack(1)\n#pragma odd\n#line 3\n#warning w\n#include_next <a>\n#odd\n# 1 "f"\n#\n'
    assert codes(run(text)) == ["E2104", "P2103", "P2104", "W2100", "P2102", "P2101", "P2104"]


def test_redefinition_and_final_macros():
    unit = run('#define A 1\n#define A  1 \n#define A 2\n#define B\n#define C "s"\n#define D(x) x\n#define E 0x1FuL\n#define G\n#undef G\n', defines=[("Z", "1"), ("Y", "1"), ("Y", None)])
    assert codes(unit) == ["P2110"]
    macros = {m["name"]: (m["value_kind"], m["value"], m["category"]) for m in unit.macros()}
    assert macros == {
        "A": ("signed", "2", "bindable_constant"), "B": (None, None, "configuration_flag"), "C": ("string", '"s"', "bindable_constant"), "D": ("tokens", "x", "bindable_constant"),
        "E": ("unsigned", "31", "bindable_constant"), "Z": ("signed", "1", "bindable_constant"),
    }


def test_expanded_tokens_know_where_they_are_from():
    unit = run("#define A B\n#define B 7\nint x = A;\n")
    seven = next(t for t in unit.tokens if t.text == "7")
    assert [v[0] for v in seven.via] == ["A", "B"] and (seven.start, seven.end) == (32, 33)


def test_expansion_ceiling():
    bomb = "#define A B B\n#define B C C\n#define C x x\nA\n"
    assert codes(run(bomb, limits=Limits().tightened(expansions=3))) == ["E2206"]
    assert words(run(bomb, limits=Limits().tightened(expansions=7))) == words(run(bomb))


def test_definitions():
    assert parse_definition(tokenize("F (x) y")).params is None
    assert parse_definition(tokenize("F(x, ...) y")).variadic
    assert arguments(tokenize("()"), 0) == ([], 2)
    assert value_and_category(parse_definition(tokenize("F() ")))[2] == "abi_affecting"


def test_scan_of_units(spark):
    from lodestrand.operators import source_scan

    files = spark.createDataFrame([("main.c", b'#include "a.h"\n#ifdef V\nV\n#endif\nN\n'), ("a.h", b'#include "b.h"\n#define N 3\n'), ("b.h", b"B\n"), ("other.h", b"O\n"), ("bad.c", b"#error e\n")], "path string, content binary")
    units = spark.createDataFrame([(1, ["main.c"], [], [("V", "9")], "checked"), (2, ["main.c"], [], [], "lenient"), (3, ["bad.c"], [], [], "checked"), (4, ["none.c"], [], [], "checked")], source_scan.UNITS)
    out = source_scan.scan(units, files)
    assert {r.unit_id: " ".join(r.text.split()) for r in source_scan.unit_text(out).collect() if r.text.strip()} == {1: "B 9 3", 2: "B 3"}
    assert {r.unit_id: r.completeness for r in source_scan.completeness(out).collect()} == {1: "complete", 2: "complete", 3: "rejected", 4: "partial"}
    assert {(r.unit_id, r.file) for r in out.where("what = 'file'").collect()} == {(1, "main.c"), (1, "a.h"), (1, "b.h"), (2, "main.c"), (2, "a.h"), (2, "b.h"), (3, "bad.c")}


def test_guards():
    from lodestrand.csource.preprocess import guard_of

    assert guard_of(tokenize("/* c */\n#ifndef A\n#define A\n#if 1\nx\n#endif\n#endif\n")) == "A"
    for text in ("#ifndef A\n#define B\n#endif\n", "#ifndef A\n#define A\n#endif\nx\n", "#ifndef A\n#define A\n#else\n#endif\n", "x\n"):
        assert guard_of(tokenize(text)) is None
    files = {"g.h": "#ifndef G\n#define G\nonce\n#endif\n"}
    assert words(run('#include "g.h"\n#include "g.h"\n#undef G\n#include "g.h"\n', files=files)) == "once once"


def test_environment():
    from lodestrand.csource.environment import capture

    assert capture(None, {"A": "1"}).variables == ()
    got = capture(("CPATH", "B"), {"CPATH": "x::y", "C_INCLUDE_PATH": "z"})
    assert [(n, v is None) for n, v in got.variables] == [("B", True), ("CPATH", False)] and got.user_roots == ("x", "y") and got.system_roots == ()
    with pytest.raises(ValueError):
        capture(("a b",), {})


def test_external_commands():
    import sys

    from lodestrand.csource.environment import ExternalFailure, external

    call = lambda code, **more: external([sys.executable, "-c", code], **more)
    assert call("print('x')")[0] == "x\n"
    for code, expected, more in (("import time; time.sleep(9)", "E2210", {"seconds": 0.3}), ("print('x' * 99)", "E2211", {"most_bytes": 9}), ("raise SystemExit(3)", "E2213", {}), ("import os; os.write(1, b'\\xff')", "E2214", {})):
        with pytest.raises(ExternalFailure) as e:
            call(code, **more)
        assert e.value.code == expected


def test_a_file_that_is_not_utf8_is_left_out():
    unit = Unit(Config(["main.c"], policy="checked"), {"main.c": b'#include "a.h"\nx\n', "a.h": b"ok \xff\n"}).run()
    assert codes(unit) == ["E2214"] and (unit.diagnostics[0].file, unit.diagnostics[0].start) == ("a.h", 3)
    assert words(unit) == "x"
