"""Declarations and types of small units."""

from __future__ import annotations

from lodestrand.csource.extraction import extract, references, type_rows
from lodestrand.csource.parsing import parse


def of(text, file="<unit>"):
    return extract(parse(text), text, file)


def named(result, name):
    return next(d for d in result.declarations.values() if d.name == name)


def spelled(t):
    inner = [*([t["to"]] if "to" in t else []), *t.get("params", [])]
    label = t.get("name") or t.get("rank") or t.get("bound") or t["kind"]
    if t["kind"] == "int" and t["signed"] is False:
        label = "u" + label
    quals = "".join(q + " " for q in sorted(t.get("quals", ())))
    return f"{quals}{label}" + (f"({', '.join(spelled(x) for x in inner)})" if inner else "")


def test_scalars():
    out = of("unsigned long int a; char b; long long unsigned c; long double d; short e; _Complex float f; unsigned g; int long long h;")
    assert [spelled(d.type) for d in out.declarations.values()] == ["ulong", "char", "ulong long", "long double", "short", "float", "uint", "long long"]
    assert [d["code"] for d in of("long float x;").diagnostics] == ["E1100"]


def test_declarators_are_read_inside_out():
    out = of("int *(*f(const char *s, int n[static 3]))[4]; int a[2][3]; void (*const p)(void);")
    assert spelled(named(out, "f").type) == "function(pointer(fixed 4(pointer(int))), pointer(const char), at least 3(int))"
    assert spelled(named(out, "a").type) == "fixed 2(fixed 3(int))"
    assert spelled(named(out, "p").type) == "const pointer(function(void))"


def test_records_and_references():
    out = of("struct a; struct b { struct a *next; int bits : 3; char tail[]; }; typedef struct b B; struct a { B b; };")
    b, a = named(out, "b"), named(out, "a")
    assert [(c["name"], c["bits"]) for c in b.children] == [("next", None), ("bits", 3), ("tail", None)] and b.children[2]["type"]["bound"] == "flexible"
    assert references(b.children[0]["type"]) == [(a.id, "opaque")] and references(a.children[0]["type"]) == [(named(out, "B").id, "definition")]
    assert len(a.occurrences) == 3 and a.complete and not out.diagnostics


def test_enumerators():
    out = of("enum e { X, Y = 5, Z, W = (1)+(0), V, U = -2, T };")
    assert [c["value"] for c in named(out, "e").children] == [0, 5, 6, None, None, -2, -1]
    assert [d["code"] for d in out.diagnostics] == ["P1203", "P1203"]


def test_identity():
    one, two = of("int f(int a); int g;"), of("int g; int f(int other);")
    assert named(one, "f").id == named(two, "f").id and named(one, "f").id != named(one, "g").id
    assert named(of("static int f(void);", "a.c"), "f").id != named(of("static int f(void);", "b.c"), "f").id
    twice = of("int f( int a ) ; int f(int a); int f(int b);")
    assert [o["ordinal"] for o in named(twice, "f").occurrences] == [0, 1, 0] and not twice.diagnostics
    unnamed = of("struct { int x; } a; struct { int x; } b;")
    assert len([d for d in unnamed.declarations.values() if d.kind == "record"]) == 2


def test_redeclarations():
    assert [d["code"] for d in of("int f(int); int f(long);").diagnostics] == ["E1204"]
    assert [d["code"] for d in of("extern int a[]; int a[3];").diagnostics] == ["E1204"]
    assert [d["code"] for d in of("struct s { int a; }; struct s { int a; };").diagnostics] == ["E1204"]


def test_linkage_storage_and_definitions():
    out = of("extern int a; static int b; int c = 1; typedef int T; int f(void); int g(void) { return 0; }")
    seen = {d.name: (d.linkage, d.occurrences[0]["storage"], d.occurrences[0]["definition"]) for d in out.declarations.values()}
    assert seen == {"a": ("external", "extern", False), "b": ("internal", "static", True), "c": ("external", None, True), "T": ("none", None, True), "f": ("external", None, False), "g": ("external", None, True)}


def test_attributes():
    out = of('int f(void) __asm__("g\\"x") __attribute__((visibility("hidden"), stdcall)); int h(void) __attribute__((odd));')
    f = named(out, "f")
    assert (f.link_name, f.visibility, f.convention) == ('g"x', "hidden", "stdcall") and [d["code"] for d in out.diagnostics] == ["P1205"]
    assert "E1214" in [d["code"] for d in of("int f(void) __attribute__((stdcall, fastcall));").diagnostics]


def test_bounds():
    codes = lambda text: [d["code"] for d in of(text).diagnostics]
    assert codes("int a[-1];") == ["E1103"] and codes("int a[static 3];") == ["E1105"] and codes("int a[const 3];") == ["E1106"]
    assert spelled(named(of("enum { N = 3 }; int a[N]; int b[1 << 2];"), "b").type) == "fixed 4(int)"
    assert spelled(named(of("int f(a, b);"), "f").type) == "function(int)" and codes("int f(a, b);") == ["E1201"]
    assert codes("_Static_assert(1, \"x\");") == ["P1200"] and codes("inline int f(void);") == ["E1217"]


def test_type_rows_number_their_children():
    rows = type_rows(named(of("int *f(char);"), "f").type)
    assert [(r["path"], r["depth"], r["kind"]) for r in rows] == [("0", 0, "function"), ("0.0", 1, "pointer"), ("0.0.0", 2, "int"), ("0.1", 1, "int")]


def test_partial_support():
    codes = lambda text: [d["code"] for d in of(text).diagnostics]
    assert codes("_Float16 x;") == ["P1108"] and codes("_BitInt(7) y;") == ["P1107"] and codes("enum e { A __attribute__((odd)) = 1 };") == ["P1202"]
    assert codes("int * __attribute__((odd)) p;") == ["P1102"]


def codes(text):
    return [(d["code"], d["declaration"] is not None) for d in of(text).diagnostics]


def test_conflicts_and_misplaced_parts():
    out = of("struct s { int a; int b[]; int c; };")
    assert codes("struct s { int a; int b[]; int c; };") == [("E1212", True)] and named(out, "s").support[1] == "E1212"
    for text in ("enum e { A }; enum e { B };", "struct s; union s { int a; };", "struct t { int a; }; enum t { B };", "int x; long x;"):
        assert codes(text) == [("E1204", True)]
    assert codes("inline int f(void);") == [("E1217", True)] and named(of("inline int f(void);"), "f").support[1] == "E1217"


def test_restrict_needs_a_pointer():
    assert codes("int restrict x;") == [("E1100", True)]
    assert not codes("typedef int *P; typedef P Q; Q restrict x; int *restrict y; void f(P restrict p);")
    assert "restrict" in named(of("typedef int *P; P restrict x;"), "x").type["quals"]
