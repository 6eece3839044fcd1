"""Declarations of a parsed unit: identities, types, occurrences, children, and diagnostics.

Two passes: the first gives every name and tag its id, so later references find it; the second lowers each
declarator. An id is a hash of namespace, scope and name, or, for an unnamed tag, of its tokens and how many
equal ones stand before it. What cannot be lowered exactly stays as an ``unsupported`` type with a code.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

from . import conditions
from .lexing import BLANK, tokenize
from .parsing import Node

# Attributes whose meaning is modelled, calling conventions, visibilities, and integer ranks.
MODELLED = frozenset({"cdecl", "stdcall", "fastcall", "thiscall", "vectorcall", "regcall", "ms_abi", "sysv_abi", "pcs", "visibility", "deprecated", "unused", "warn_unused_result", "nonnull", "noreturn"})
CONVENTIONS = frozenset({"cdecl", "stdcall", "fastcall", "thiscall", "vectorcall", "regcall", "ms_abi", "sysv_abi", "pcs"})
VISIBILITIES = frozenset({"default", "hidden", "protected", "internal"})
_NULLABLE = {"_Nonnull": "nonnull", "_Nullable": "nullable", "_Null_unspecified": "unspecified"}
SUPPORTED, PARTIAL, UNSUPPORTED = 0, 1, 2


def framed_hash(prefix: str, *fields: str) -> str:
    """SHA-256 over length-framed fields behind a typed prefix."""
    body = "".join(f"{len(f.encode())}:{f}" for f in fields)
    return prefix + hashlib.sha256(body.encode()).hexdigest()


def normal(name: str) -> str:
    return unicodedata.normalize("NFC", name)


def declaration_id(namespace: str, scope: str, name: str) -> str:
    return framed_hash("decl1_", namespace, scope, normal(name))


def unnamed_id(tokens: list[str], ordinal: int) -> str:
    return framed_hash("decl1_", "tag", "unnamed", str(ordinal), *tokens)


@dataclass
class Declaration:
    id: str
    namespace: str
    scope: str
    name: str | None
    kind: str = ""
    linkage: str = "external"
    visibility: str | None = None
    link_name: str | None = None
    storage: str | None = None
    complete: bool = False
    type: dict | None = None
    convention: str = "c"
    occurrences: list[dict] = field(default_factory=list)
    children: list[dict] = field(default_factory=list)
    attributes: list[dict] = field(default_factory=list)
    support: tuple[int, str | None] = (SUPPORTED, None)


def unsupported(code: str, reason: str) -> dict:
    return {"kind": "unsupported", "code": code, "reason": reason}


def type_rows(of: dict, path: str = "0", depth: int = 0) -> list[dict]:
    """Adjacency rows of a type, pre-order; children are numbered in their paths."""
    inner = [*([of["to"]] if "to" in of else []), *of.get("params", [])]
    row = {k: str(v) for k, v in of.items() if k not in ("to", "params", "kind", "quals") and v is not None}
    rows = [{"path": path, "depth": depth, "kind": of["kind"], "quals": sorted(of.get("quals", ())), "attrs": row}]
    for k, t in enumerate(inner):
        rows += type_rows(t, f"{path}.{k}", depth + 1)
    return rows


def references(of: dict, behind: bool = False) -> list[tuple[str, str]]:
    """(id, need) of the declarations that a type names: behind a pointer a record or alias may stay opaque; a function's own types are needed in full; an enum always is."""
    kind = of["kind"]
    if kind in ("alias", "record", "enum"):
        return [(of["ref"], "opaque" if behind and kind != "enum" else "definition")]
    behind = True if kind == "pointer" else False if kind == "function" else behind
    return [r for t in [*([of["to"]] if "to" in of else []), *of.get("params", [])] for r in references(t, behind)]


class Extraction:
    def __init__(self, unit: Node, text: str, file: str = "<unit>"):
        self.unit, self.raw, self.file = unit, text.encode(), file
        self.declarations: dict[str, Declaration] = {}
        self.diagnostics: list[dict] = []
        self.tags: dict[int, str] = {}
        self.names: dict[str, str] = {}
        self.unnamed: Counter = Counter()
        self.constants: dict[str, int] = {}

    def report(self, code: str, message: str, node: Node, declaration: str | None = None) -> None:
        self.diagnostics.append({"code": code, "message": message, "start": node.start, "end": node.end, "declaration": declaration})

    def words(self, node: Node) -> list[str]:
        return [t.text for t in tokenize(self.raw[node.start : node.end].decode("utf-8", "replace")) if t.kind not in BLANK]

    # pass one

    def index(self) -> None:
        for item in self.unit.children:
            for node, _ in item.walk():
                if node.kind in ("Record", "Enum"):
                    self.tag(node)
            if item.kind in ("Declaration", "FunctionDefinition"):
                for name, _ in self.declared(item):
                    internal = "static" in self.storages(item)
                    scope = f"file:{self.file}" if internal else "global"
                    self.names.setdefault(name, declaration_id("ordinary", scope, name))

    def tag(self, node: Node) -> str:
        if node.start not in self.tags:
            name = node.attrs.get("name")
            if name:
                made = declaration_id("tag", "global", name)
            else:
                tokens = self.words(node)
                made = unnamed_id(tokens, self.unnamed[tuple(tokens)])
                self.unnamed[tuple(tokens)] += 1
            self.tags[node.start] = made
        return self.tags[node.start]

    @staticmethod
    def storages(item: Node) -> list[str]:
        return [s.attrs["name"] for s in item.find("StorageClass")]

    @staticmethod
    def declared(item: Node) -> list[tuple[str, Node]]:
        if item.kind == "FunctionDefinition":
            return [(item.attrs["name"], item)] if item.attrs.get("name") else []
        return [(d.attrs["name"], d) for d in item.find("InitDeclarator") if d.attrs.get("name")]

    # pass two

    def run(self) -> Extraction:
        self.index()
        for item in self.unit.children:
            if item.kind == "StaticAssert":
                self.report("P1200", "static assertion", item)
            elif item.kind in ("Declaration", "FunctionDefinition"):
                self.lower(item)
                made = [self.declarations[i] for i in dict.fromkeys(self.names[n] for n, _ in self.declared(item)) if i in self.declarations]
                for node in item.children:
                    if node.kind == "FunctionSpecifier":
                        self.demote(made, "E1217", f"function specifier {node.attrs['name']}", node)
                    if node.kind == "AlignmentSpecifier":
                        self.demote(made, "E1216", "explicit alignment", node)
        for d in self.declarations.values():
            if not d.occurrences:
                self.report("E1208", "no occurrence", self.unit, d.id)
            if d.support[0] and not any(x["code"] == d.support[1] and x["declaration"] == d.id for x in self.diagnostics):
                self.diagnostics.append({"code": d.support[1], "message": f"{d.kind} {d.name or '(unnamed)'} is not fully modelled", "start": d.occurrences[0]["start"] if d.occurrences else 0, "end": d.occurrences[0]["end"] if d.occurrences else 0, "declaration": d.id})
        unique = {tuple(sorted((k, str(v)) for k, v in x.items())): x for x in self.diagnostics}
        self.diagnostics = sorted(unique.values(), key=lambda x: (x["code"], x["start"], x["end"], x["message"], x["declaration"] or ""))
        return self

    def lower(self, item: Node) -> None:
        storages = self.storages(item)
        base = self.base_type([c for c in item.children if c.kind in ("TypeSpecifier", "TypeQualifier", "Record", "Enum", "Attribute")])
        if item.kind == "FunctionDefinition":
            self.declare(item.attrs["name"], item, item.find("Declarator")[0], base, storages, True, item.find("Attribute"))
            return
        for d in item.find("InitDeclarator"):
            name = d.attrs.get("name")
            if not name:
                self.report("E1213", "declarator without a name", d)
                continue
            extensions = [*item.find("Attribute"), *d.find("Attribute"), *d.find("AsmLabel")]
            self.declare(name, item, d.find("Declarator")[0], base, storages, bool(d.find("Initializer")), extensions)

    def declare(self, name: str, item: Node, declarator: Node, base: dict, storages: list[str], body: bool, extensions: list[Node]) -> None:
        extensions = [*extensions, *declarator.find("Attribute"), *declarator.find("AsmLabel")]
        made = self.finished(base, declarator, False)
        typedef = "typedef" in storages
        kind = "alias" if typedef else "function" if made["kind"] == "function" else "variable"
        storage = next((s for s in storages if s not in ("typedef", "constexpr")), None)
        d = self.get(self.names[name], "ordinary", f"file:{self.file}" if "static" in storages else "global", name)
        d.linkage = "none" if typedef else "internal" if "static" in storages else "external"
        labels = [x for x in extensions if x.kind == "AsmLabel"]
        if labels:
            value = labels[0].attrs["value"]
            plain = value[1:-1]
            if "\\" in plain.replace("\\\\", "").replace('\\"', "").replace("\\'", "").replace("\\?", ""):
                self.report("E1211", "assembler label cannot be read", labels[0], d.id)
            else:
                d.link_name = plain.replace('\\"', '"').replace("\\'", "'").replace("\\?", "?").replace("\\\\", "\\")
        self.attributes(d, [x for x in extensions if x.kind == "Attribute"], item)
        if kind == "function":
            made = made | {"convention": d.convention}
            if made.get("old"):
                d.support = (UNSUPPORTED, "E1201")
            d.children = d.children or [{"role": "parameter", "ordinal": k, "name": n, "type": t} for k, (n, t) in enumerate(zip(made["names"], made["params"]))]
        self.settle(d, kind, made, item)
        definition = typedef or (body if kind == "function" else body or storage != "extern")
        self.occur(d, item, storage, definition)

    def get(self, key: str, namespace: str, scope: str, name: str | None) -> Declaration:
        return self.declarations.setdefault(key, Declaration(key, namespace, scope, normal(name) if name else None))

    def occur(self, d: Declaration, node: Node, storage: str | None, definition: bool) -> None:
        tokens = self.words(node)
        ordinal = sum(1 for o in d.occurrences if o["tokens"] == tokens)
        d.occurrences.append({"id": framed_hash("occ1_", d.id, str(ordinal), *tokens), "start": node.start, "end": node.end, "tokens": tokens, "ordinal": ordinal, "storage": storage, "definition": definition})

    def demote(self, made: list[Declaration], code: str, message: str, node: Node) -> None:
        """Report for each declaration, or for none, and take its support away unless it has gone already."""
        for d in made:
            self.report(code, message, node, d.id)
            if not d.support[0]:
                d.support = (UNSUPPORTED, code)
        if not made:
            self.report(code, message, node)

    def conflict(self, d: Declaration, message: str, node: Node) -> None:
        """One entity is declared in ways that don't go together."""
        self.report("E1204", message, node, d.id)
        d.support = (UNSUPPORTED, "E1204")

    def limited(self, d: Declaration, made: dict) -> None:
        """The declaration is no better supported than a type in it."""
        rows = type_rows(made)
        code = next((r["attrs"]["code"] for r in rows if r["kind"] == "unsupported"), None) or next((r["attrs"]["partial"] for r in rows if "partial" in r["attrs"]), None)
        if code and not d.support[0]:
            d.support = (PARTIAL if code[0] == "P" else UNSUPPORTED, code)

    def settle(self, d: Declaration, kind: str, made: dict, node: Node) -> None:
        """First type stays; an equal one is kept, a different one is a conflict. Parameter names do not count."""
        plain = lambda t: type_rows({k: v for k, v in t.items() if k != "names"})
        if d.type is None:
            d.kind, d.type = kind, made
            self.limited(d, made)
        elif d.kind != kind or plain(d.type) != plain(made):
            self.conflict(d, f"incompatible redeclaration of {d.name}", node)

    def attributes(self, d: Declaration, nodes: list[Node], item: Node) -> None:
        seen = set()
        for x in nodes:
            name = x.attrs["name"].lower()
            d.attributes.append({"name": name, "modelled": name in MODELLED, "start": x.start, "end": x.end})
            if name in CONVENTIONS:
                seen.add(name)
            elif name == "visibility":
                value = x.children[0].attrs.get("value", "").strip('"') if x.children else ""
                if value not in VISIBILITIES or (d.visibility and d.visibility != value and any(a is not x for a in nodes if a.attrs["name"] == "visibility")):
                    self.report("E1215", "visibility malformed or conflicting", x, d.id)
                else:
                    d.visibility = value
            elif name not in MODELLED:
                self.report("P1205", f"attribute {name} is not modelled", x, d.id)
        if len(seen) > 1:
            self.report("E1214", "calling conventions conflict", item, d.id)
        elif seen:
            d.convention = seen.pop()

    # types

    def constant(self, node: Node) -> int | None:
        return conditions.value_of(tokenize(self.raw[node.start : node.end].decode("utf-8", "replace")), conditions.CONSTANT)

    def exact(self, node: Node) -> int | None:
        """Literals with a sign only."""
        if node.kind == "Constant" and node.attrs["type"] == "integer":
            return self.constant(node)
        if node.kind == "UnaryOperator" and node.attrs["op"] in "+-" and node.children[0].kind == "Constant":
            value = self.exact(node.children[0])
            return value if value is None or node.attrs["op"] == "+" else -value
        return None

    def qualified(self, of: dict, marks: list[Node]) -> dict:
        names = {m.attrs["name"] for m in marks if m.kind == "TypeQualifier"}
        nullable = [_NULLABLE[n] for n in names if n in _NULLABLE]
        if len(nullable) > 1:
            return unsupported("E1109", "conflicting nullability")
        quals = {n.strip("_").lower() for n in names if n not in _NULLABLE}
        if not quals and not nullable:
            return of
        return of | {"quals": frozenset(of.get("quals", frozenset()) | quals)} | ({"nullability": nullable[0]} if nullable else {})

    def base_type(self, nodes: list[Node]) -> dict:
        special = [n for n in nodes if n.kind in ("Record", "Enum")]
        words = Counter(n.attrs["name"] for n in nodes if n.kind == "TypeSpecifier")
        alias = next((n for n in nodes if n.kind == "TypeSpecifier" and n.attrs.get("typedef")), None)
        if special:
            node = special[0]
            made = self.record(node) if node.kind == "Record" else self.enumeration(node)
        elif alias is not None:
            name = alias.attrs["name"]
            made = {"kind": "alias", "ref": self.names.get(name) or declaration_id("ordinary", "global", name), "name": name}
        elif "typeof" in words:
            made = unsupported("E1100", "typeof")
        elif "_Atomic" in words:
            node = next(n for n in nodes if n.attrs.get("name") == "_Atomic")
            made = self.type_name(node.children[0])
            made = made | {"quals": frozenset(made.get("quals", frozenset()) | {"atomic"})}
        elif "_BitInt" in words:
            made = {"kind": "int", "rank": f"bit{self.constant(next(n for n in nodes if n.attrs.get('name') == '_BitInt').children[0])}", "signed": "unsigned" not in words, "partial": "P1107"}
        else:
            made = self.scalar(words)
        return self.qualified(made, nodes)

    @staticmethod
    def scalar(words: Counter) -> dict:
        """The type that a multiset of keywords means."""
        w = Counter(words)
        signed, unsigned, complex_, longs, ints = (w.pop(k, 0) for k in ("signed", "unsigned", "_Complex", "long", "int"))
        rest = sorted(w.elements())
        sign_ok = signed + unsigned <= 1 and ints <= 1
        signless = not signed and not unsigned and not ints
        real = None
        if rest == ["float"] and signless and not longs:
            real = "float"
        elif rest == ["double"] and signless and longs <= 1:
            real = "long double" if longs else "double"
        elif len(rest) == 1 and (rest[0].startswith(("_Float", "_Decimal")) or rest[0] == "__float128") and signless and not longs:
            real = rest[0].strip("_").lower()
        if real:
            extended = {"partial": "P1108"} if real not in ("float", "double", "long double") else {}
            return {"kind": "complex" if complex_ else "float", "rank": real} | extended
        if complex_ or not sign_ok:
            return unsupported("E1100", "invalid specifiers")
        if rest == ["void"] and signless and not longs:
            return {"kind": "void"}
        if rest == ["_Bool"] and signless and not longs:
            return {"kind": "bool"}
        if rest == ["char"] and not ints and not longs:
            return {"kind": "int", "rank": "char", "signed": True if signed else False if unsigned else "plain"}
        if rest == ["__builtin_va_list"] and signless and not longs:
            return {"kind": "alias", "ref": declaration_id("ordinary", "builtin", "__builtin_va_list"), "name": "__builtin_va_list"}
        if rest == ["__int128"] and not ints and not longs:
            return {"kind": "int", "rank": "int128", "signed": not unsigned}
        if rest == ["short"] and not longs:
            return {"kind": "int", "rank": "short", "signed": not unsigned}
        if not rest and longs <= 2 and (longs or ints or signed or unsigned):
            return {"kind": "int", "rank": ("int", "long", "long long")[longs], "signed": not unsigned}
        return unsupported("E1100", "invalid specifiers")

    def points(self, of: dict) -> bool:
        """Whether a type is a pointer, itself or through aliases."""
        seen = set()
        while of["kind"] == "alias" and of["ref"] not in seen:
            seen.add(of["ref"])
            target = self.declarations.get(of["ref"])
            if target is None or target.type is None:
                return False
            of = target.type
        return of["kind"] == "pointer"

    def finished(self, base: dict, declarator: Node | None, parameter: bool) -> dict:
        """The declarator applied to the specifiers' type; ``restrict`` and nullability among these go to the outcome, which must be a pointer."""
        quals, nullable = base.get("quals", frozenset()), base.get("nullability")
        if "restrict" not in quals and nullable is None or base["kind"] == "unsupported":
            return self.derived(base, declarator, parameter) if declarator else base
        bare = {k: v for k, v in base.items() if k not in ("quals", "nullability")} | ({"quals": quals - {"restrict"}} if quals - {"restrict"} else {})
        made = self.derived(bare, declarator, parameter) if declarator else bare
        if not self.points(made):
            return unsupported("E1100", "restrict or nullability on what is no pointer")
        more = {"quals": made.get("quals", frozenset()) | {"restrict"}} if "restrict" in quals else {}
        return made | more | ({"nullability": nullable} if nullable is not None else {})

    def type_name(self, node: Node) -> dict:
        base = self.base_type([c for c in node.children if c.kind in ("TypeSpecifier", "TypeQualifier", "Record", "Enum")])
        inner = node.find("Declarator")
        return self.finished(base, inner[0] if inner else None, False)

    def derived(self, of: dict, declarator: Node, parameter: bool) -> dict:
        """Inside out: pointers, then arrays and functions from the last, then the nested declarator."""
        for p in declarator.find("Pointer"):
            of = self.qualified({"kind": "pointer", "to": of} | ({"partial": "P1102"} if p.find("Attribute") else {}), p.children)
        for x in reversed([c for c in declarator.children if c.kind in ("Array", "Function")]):
            of = self.array(of, x, parameter) if x.kind == "Array" else self.function(of, x)
        nested = declarator.find("Declarator")
        return self.derived(of, nested[0], parameter) if nested else of

    def array(self, of: dict, node: Node, parameter: bool) -> dict:
        form = node.attrs["form"]
        size = next((c for c in node.children if c.kind != "TypeQualifier"), None)
        value = self.constant(size) if size is not None else None
        if form == "static" and not parameter:
            return unsupported("E1105", "static bound outside a parameter")
        if node.find("TypeQualifier") and not parameter:
            return unsupported("E1106", "qualifiers in brackets outside a parameter")
        if form == "unknown":
            bound = "incomplete"
        elif form == "variable_unknown" or value is None:
            bound = "variable"
        elif value < 0 or value >= 1 << 64 or (value == 0 and form == "static"):
            return unsupported("E1103", "array bound out of range")
        else:
            bound = f"at least {value}" if form == "static" else f"fixed {value}"
        return {"kind": "array", "to": of, "bound": bound}

    def function(self, of: dict, node: Node) -> dict:
        if node.attrs.get("old"):
            return {"kind": "function", "to": of, "params": [], "names": [], "prototype": "none", "variadic": False, "old": True}
        given = node.find("Parameter")
        params, names = [], []
        for p in given:
            base = self.base_type([c for c in p.children if c.kind in ("TypeSpecifier", "TypeQualifier", "Record", "Enum")])
            inner = p.find("Declarator")
            params.append(self.finished(base, inner[0] if inner else None, True))
            names.append(p.attrs.get("name"))
        if len(params) == 1 and params[0] == {"kind": "void"} and names == [None]:
            params, names, prototype = [], [], "prototyped"
        else:
            prototype = "prototyped" if given else "unspecified"
        return {"kind": "function", "to": of, "params": params, "names": names, "prototype": prototype, "variadic": bool(node.attrs.get("variadic"))}

    def record(self, node: Node) -> dict:
        key = self.tag(node)
        d = self.get(key, "tag", "global", node.attrs.get("name"))
        body = bool(node.attrs.get("body"))
        if d.kind not in ("", "record") or d.type and d.type.get("form") != node.attrs["kind"]:
            self.conflict(d, f"{d.name or '(unnamed)'} is declared as another kind of tag", node)
            body = False
        d.kind, d.linkage = d.kind or "record", "none"
        d.type = d.type or {"kind": "record", "ref": key, "form": node.attrs["kind"]}
        if body and d.complete:
            self.conflict(d, f"{d.name or '(unnamed)'} is defined twice", node)
        elif body:
            d.complete = True
            fields = node.find("StructField")
            for f in fields:
                base = self.base_type([c for c in f.children if c.kind in ("TypeSpecifier", "TypeQualifier", "Record", "Enum")])
                for s in f.find("StructDeclarator") or [None]:
                    inner = s.find("Declarator") if s else []
                    made = self.finished(base, inner[0] if inner else None, False)
                    last = f is fields[-1] and (s is None or s is f.find("StructDeclarator")[-1])
                    if made["kind"] == "array" and made["bound"] == "incomplete":
                        made = made | {"bound": "flexible"} if last and d.children and node.attrs["kind"] == "struct" else unsupported("E1212", "unsized field is not last")
                    width = s.find("BitWidth") if s else []
                    bits = self.constant(width[0].children[0]) if width else None
                    if width and bits is None:
                        self.report("P1207", "bit-field width is not evaluated", width[0], key)
                    elif width and bits < 0:
                        self.report("E1207", "bit-field width is negative", width[0], key)
                    d.children.append({"role": "field", "ordinal": len(d.children), "name": inner[0].attrs.get("name") if inner else None, "type": made, "bits": bits})
                    self.limited(d, made)
        self.occur(d, node, None, bool(node.attrs.get("body")))
        return {"kind": "record", "ref": key, "form": node.attrs["kind"], "name": node.attrs.get("name")}

    def enumeration(self, node: Node) -> dict:
        """Implicit values count on from the one before; after one that is not a literal they stay unknown."""
        key = self.tag(node)
        d = self.get(key, "tag", "global", node.attrs.get("name"))
        if d.kind not in ("", "enum"):
            self.conflict(d, f"{d.name or '(unnamed)'} is declared as another kind of tag", node)
        elif node.attrs.get("body") and d.complete:
            self.conflict(d, f"{d.name or '(unnamed)'} is defined twice", node)
        d.kind, d.linkage = d.kind or "enum", "none"
        d.type = d.type or {"kind": "enum", "ref": key}
        if node.attrs.get("body") and not d.complete and d.kind == "enum":
            d.complete, value = True, -1
            for m in node.find("Enumerator"):
                given = [c for c in m.children if c.kind != "Attribute"]
                value = self.exact(given[0]) if given else None if value is None else value + 1
                for x in m.find("Attribute"):
                    if x.attrs["name"].lower() not in MODELLED:
                        self.report("P1202", f"attribute {x.attrs['name']} of {m.attrs['name']} is not modelled", x, key)
                if value is None:
                    self.report("P1203", f"value of {m.attrs['name']} is not evaluated", m, key)
                d.children.append({"role": "variant", "ordinal": len(d.children), "name": m.attrs["name"], "value": value, "type": None})
        self.occur(d, node, None, bool(node.attrs.get("body")))
        return {"kind": "enum", "ref": key, "name": node.attrs.get("name")}


def extract(unit: Node, text: str, file: str = "<unit>") -> Extraction:
    return Extraction(unit, text, file).run()
