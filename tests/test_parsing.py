"""Trees of small inputs."""

from __future__ import annotations

import pytest

from lodestrand.csource.parsing import ParseError, Parser, dump, parse, rows


def shape(text, rule="expression", **more):
    node = parse(text, rule, **more)

    def of(n):
        inner = " ".join(of(c) for c in n.children)
        name = n.attrs.get("op") or n.attrs.get("name") or n.attrs.get("value") or n.kind
        return f"({name} {inner})" if inner else name

    return of(node)


def test_precedence_and_association():
    assert shape("a + b * c - d") == "(- (+ a (* b c)) d)"
    assert shape("a = b ? c : d ? e : f") == "(= a (Conditional b c (Conditional d e f)))"
    assert shape("-x[1].y->z++ << 2 || !p") == "(|| (<< (- (post++ (-> (. ([] x 1))))) 2) (! p))"
    assert shape("f(a, (b, c))") == "(Call f a (Comma b c))"


def test_typedef_names_decide():
    assert parse("(T)*x", "expression", typenames=("T",)).kind == "Cast" and parse("(T)*x", "expression").kind == "BinaryOperator"
    assert parse("sizeof(T)", "expression", typenames=("T",)).kind == "SizeOfTy" and parse("sizeof(T)", "expression").kind == "SizeOfVal"
    assert parse("(T){1}.x", "expression", typenames=("T",)).kind == "Member"


def test_scopes_hide_typedef_names():
    unit = parse("typedef int T; void f(void) { int T = 1; T * 2; } T x;", "translation_unit")
    statement = unit.children[1].children[-1].children[1]
    assert statement.kind == "ExpressionStatement" and len(unit.children) == 3


def test_declarators():
    tree = dump(parse("int (*f(int a, ...))(long), *b[static 3], c : 1;".replace(", c : 1", ""), "declaration"))
    assert "InitDeclarator name=f" in tree and "Array form=static" in tree and "Function variadic=yes" in tree


def test_dialects():
    for text in ("({ int y = 1; y; })", "__builtin_offsetof(struct s, a[1].b)", "__extension__ 1", "a ?: b"):
        parse(text, "expression", "gnu")
    with pytest.raises(ParseError):
        parse("({ 1; })", "expression", "core")
    parse("int * _Nonnull p;", "declaration", flavor="clang")
    parse('extern int f(void) __asm__("g") __attribute__((visibility("hidden"), noreturn));', "declaration")


def test_constants():
    for good in ("0x1fuLL", "017", "0", "1e5f", ".5", "0x1.8p3", "'\\n'", "L'a'", "1.0f128"):
        assert parse(good, "constant").kind == "Constant"
    for bad in ("08", "1a", "0b2", "1lul", "'\\c'", "0xX"):
        with pytest.raises(ParseError):
            parse(bad, "constant")


def test_errors_have_the_furthest_offset():
    with pytest.raises(ParseError) as e:
        parse("int a = 1 +;", "declaration")
    assert e.value.offset == 11


def test_recovery_keeps_what_parses():
    unit, lost = Parser("int a; int b c d; typedef int T; T e; int f { ; } int g;").recovered()
    names = [c.children[-1].attrs["name"] for c in unit.children]
    assert names == ["a", "T", "e", "g"] and [x["start"] for x in lost] == [7, 38]


def test_rows_nest():
    out = rows(parse("a + b * c", "expression"))
    by_id = {r["node_id"]: r for r in out}
    for r in out[1:]:
        parent = by_id[r["parent_id"]]
        assert parent["pre"] < r["pre"] and r["post"] < parent["post"]
    assert [r["kind"] for r in out] == ["BinaryOperator", "Identifier", "BinaryOperator", "Identifier", "Identifier"]


def test_statements():
    text = "{ for (int i = 0; i < 3; ++i) if (i) continue; else break; switch (x) { case 1 ... 3: ; default: return 1; } do x--; while (x); l: goto l; asm(\"nop\"); }"
    kinds = {n.kind for n, _ in parse(text, "statement").walk()}
    assert {"For", "If", "Switch", "CaseRange", "Default", "DoWhile", "Labeled", "Goto", "Asm", "Return", "Continue", "Break"} <= kinds
