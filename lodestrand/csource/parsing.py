"""A parser for preprocessed C: text to a tree of nodes, strict or with recovery.

Recursive descent with precedence climbing. The only state is the scope stack, which tells typedef names
from other identifiers; it is why a unit is parsed by one task. Dialects: ``core`` (C11), ``gnu`` and
``clang``, each with the words it adds.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

from .lexing import BLANK, Token, tokenize

# Words with a meaning of their own, and the operators by level, loosest first.
_STORAGE = {"extern", "static", "typedef", "auto", "register", "_Thread_local", "constexpr", "__thread"}
_QUALIFIERS = {"const", "volatile", "restrict", "_Atomic", "__const", "__const__", "__volatile", "__volatile__", "__restrict", "__restrict__", "_Nonnull", "_Nullable", "_Null_unspecified"}
_FUNCTION = {"inline", "_Noreturn", "__inline", "__inline__"}
_TYPES = {"void", "char", "short", "int", "long", "float", "double", "signed", "unsigned", "_Bool", "_Complex", "__signed", "__signed__", "__complex__", "__int128", "__float128", "_Float16", "_Float32", "_Float64", "_Float128", "_Float32x", "_Float64x", "_Decimal32", "_Decimal64", "_Decimal128", "__builtin_va_list"}
_OTHER = {"struct", "union", "enum", "if", "else", "while", "do", "for", "switch", "case", "default", "break", "continue", "return", "goto", "sizeof", "_Alignof", "_Alignas", "_Static_assert", "_Generic", "typeof", "_BitInt"}
_GNU = {"__typeof", "__typeof__", "asm", "__asm", "__asm__", "__attribute__", "__attribute", "__extension__", "__alignof__", "__alignof", "__builtin_va_arg", "__builtin_offsetof"}
LEVELS = (("||",), ("&&",), ("|",), ("^",), ("&",), ("==", "!="), ("<", ">", "<=", ">="), ("<<", ">>"), ("+", "-"), ("*", "/", "%"))
ASSIGN = frozenset({"=", "*=", "/=", "%=", "+=", "-=", "<<=", ">>=", "&=", "^=", "|="})
#: One spelling for each.
PLAIN = {"__const": "const", "__const__": "const", "__volatile": "volatile", "__volatile__": "volatile", "__restrict": "restrict", "__restrict__": "restrict", "__inline": "inline", "__inline__": "inline", "__signed": "signed", "__signed__": "signed", "__complex__": "_Complex", "__thread": "_Thread_local"}
#: Later spellings of C11 words; a declared name hides them.
_LATER = {"bool": "_Bool", "alignas": "_Alignas", "alignof": "_Alignof", "thread_local": "_Thread_local", "static_assert": "_Static_assert", "noreturn": "_Noreturn", "complex": "_Complex"}
_INTEGER = re.compile(r"(0[xX][0-9a-fA-F]+|0[bB][01]+|0[0-7]*|[1-9][0-9]*)([uU]?(?:ll|LL|[lL])?|(?:ll|LL|[lL])[uU])([iIjJ]?)")
_FLOAT = re.compile(r"((?:[0-9]*\.[0-9]+|[0-9]+\.)(?:[eE][+-]?[0-9]+)?|[0-9]+[eE][+-]?[0-9]+|0[xX](?:[0-9a-fA-F]*\.[0-9a-fA-F]+|[0-9a-fA-F]+\.?)[pP][+-]?[0-9]+)([fFlL]|[fF](?:16|32|64|128)x?|[dD][fFdDlL]|[dD](?:32|64|128)|[qQwW])?([iIjJ]?)")
_CHARACTER = re.compile(r"""[LuU]?'(?:[^'\\\n]|\\(?:['"?\\abefnrtv]|[0-7]{1,3}|x[0-9a-fA-F]+|[uU][0-9a-fA-F]{4,8}))+'""")


class ParseError(ValueError):
    def __init__(self, offset: int, expected: str):
        super().__init__(f"at {offset}: expected {expected}")
        self.offset, self.expected = offset, expected


@dataclass
class Node:
    kind: str
    start: int
    end: int
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node] = field(default_factory=list)

    def find(self, kind: str) -> list[Node]:
        return [c for c in self.children if c.kind == kind]

    def walk(self, depth: int = 0) -> Iterator[tuple[Node, int]]:
        """Pre-order, with depths."""
        yield self, depth
        for c in self.children:
            yield from c.walk(depth + 1)


def dump(node: Node) -> str:
    """One line for each node, four spaces for each level."""
    return "\n".join("    " * d + " ".join([n.kind, *(f"{k}={v}" for k, v in n.attrs.items())]) for n, d in node.walk())


def rows(node: Node) -> list[dict]:
    """(node_id, parent_id, ordinal, kind, attrs, start, end, pre, post): pre and post order numbers nest."""
    out: list[dict] = []
    clock = 0

    def visit(n: Node, parent: int | None, ordinal: int) -> None:
        nonlocal clock
        row = {"node_id": len(out), "parent_id": parent, "ordinal": ordinal, "kind": n.kind, "attrs": n.attrs, "start": n.start, "end": n.end, "pre": clock, "post": 0}
        out.append(row)
        clock += 1
        for k, c in enumerate(n.children):
            visit(c, row["node_id"], k)
        row["post"] = clock
        clock += 1

    visit(node, None, 0)
    return out


class Parser:
    def __init__(self, text: str, flavor: str = "gnu", typenames: tuple[str, ...] = ()):
        markers = re.sub(r"(?m)^#.*$", lambda m: " " * len(m.group().encode()), text)  # line markers are blank
        named = set(typenames)
        self.tokens = [replace(t, text=_LATER[t.text]) if t.kind == "identifier" and t.text in _LATER and t.text not in named else t for t in tokenize(markers) if t.kind not in BLANK]
        self.at, self.flavor, self.size = 0, flavor, len(text.encode())
        gnu = flavor in ("gnu", "clang")
        self.words = _STORAGE | _QUALIFIERS | _FUNCTION | _TYPES | _OTHER | (_GNU if gnu else set())
        self.scopes: list[dict[str, bool]] = [dict.fromkeys(typenames, True) | ({"__builtin_va_list": True} if gnu else {})]
        self.furthest = (0, "")

    # tokens

    @property
    def token(self) -> Token | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def text(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead].text if self.at + ahead < len(self.tokens) else ""

    def here(self) -> int:
        return self.token.start if self.token else self.size

    def last(self) -> int:
        return self.tokens[self.at - 1].end if self.at else 0

    def fail(self, expected: str) -> ParseError:
        if self.here() >= self.furthest[0]:
            self.furthest = (self.here(), expected)
        return ParseError(self.here(), expected)

    def take(self, *texts: str) -> str | None:
        if self.token and self.token.kind != "string" and self.text() in texts:
            self.at += 1
            return self.tokens[self.at - 1].text
        return None

    def need(self, text: str) -> None:
        if not self.take(text):
            raise self.fail(repr(text))

    def attempt(self, rule: Callable[[], Node]) -> Node | None:
        """The rule's node, or nothing and the state as it was."""
        at, depth = self.at, len(self.scopes)
        try:
            return rule()
        except ParseError:
            self.at = at
            del self.scopes[depth:]
            return None

    def node(self, kind: str, start: int, children: list[Node | None] = (), /, **attrs: str) -> Node:
        return Node(kind, start, self.last(), {k: v for k, v in attrs.items() if v}, [c for c in children if c is not None])

    # names

    def is_type(self, name: str) -> bool:
        return next((s[name] for s in reversed(self.scopes) if name in s), False)

    def declare(self, name: str | None, is_type: bool) -> None:
        if name:
            self.scopes[-1][name] = is_type

    def identifier(self) -> str:
        if self.token is None or self.token.kind != "identifier" or self.text() in self.words:
            raise self.fail("identifier")
        self.at += 1
        return self.tokens[self.at - 1].text

    # expressions

    def expression(self) -> Node:
        start, first = self.here(), self.assignment()
        if self.text() != ",":
            return first
        parts = [first]
        while self.take(","):
            parts.append(self.assignment())
        return self.node("Comma", start, parts)

    def assignment(self) -> Node:
        start, left = self.here(), self.conditional()
        if (op := self.text()) in ASSIGN and self.token.kind == "punctuation":
            self.at += 1
            return self.node("BinaryOperator", start, [left, self.assignment()], op=op)
        return left

    def conditional(self) -> Node:
        start, head = self.here(), self.binary(0)
        if not self.take("?"):
            return head
        yes = None if self.text() == ":" else self.expression()
        self.need(":")
        return self.node("Conditional", start, [head, yes, self.conditional()])

    def binary(self, level: int) -> Node:
        if level == len(LEVELS):
            return self.cast()
        start, left = self.here(), self.binary(level + 1)
        while self.token and self.token.kind == "punctuation" and self.text() in LEVELS[level]:
            op = self.take(self.text())
            left = self.node("BinaryOperator", start, [left, self.binary(level + 1)], op=op)
        return left

    def cast(self) -> Node:
        start = self.here()
        if self.text() == "(" and self.starts_type(1):
            self.need("(")
            name = self.type_name()
            self.need(")")
            if self.text() == "{":
                return self.postfix(self.node("CompoundLiteral", start, [name, self.initializer()]), start)
            return self.node("Cast", start, [name, self.cast()])
        return self.unary()

    def unary(self) -> Node:
        start = self.here()
        if self.take("__extension__"):
            return self.cast()
        if op := self.take("++", "--"):
            return self.node("UnaryOperator", start, [self.unary()], op="pre" + op)
        if self.text() in ("&", "*", "+", "-", "~", "!") and self.token.kind == "punctuation":
            op = self.take(self.text())
            return self.node("UnaryOperator", start, [self.cast()], op=op)
        if self.take("sizeof"):
            if self.text() == "(" and self.starts_type(1):
                at = self.at
                self.need("(")
                name = self.type_name()
                self.need(")")
                if self.text() != "{":
                    return self.node("SizeOfTy", start, [name])
                self.at = at
            return self.node("SizeOfVal", start, [self.unary()])
        if self.take("_Alignof", "__alignof__", "__alignof"):
            self.need("(")
            name = self.type_name()
            self.need(")")
            return self.node("AlignOf", start, [name])
        if self.flavor != "core" and self.take("&&"):
            return self.node("UnaryOperator", start, [], op="label", name=self.identifier())
        return self.postfix(self.primary(), start)

    def primary(self) -> Node:
        start, token = self.here(), self.token
        if token is None:
            raise self.fail("expression")
        if token.kind == "number":
            whole, real = _INTEGER.fullmatch(token.text), _FLOAT.fullmatch(token.text)
            m = whole or real
            if not m or (self.flavor == "core" and m.group(3)):
                raise self.fail("constant")
            self.at += 1
            return self.node("Constant", start, value=token.text, type="integer" if whole else "float")
        if token.kind == "char":
            if not _CHARACTER.fullmatch(token.text):
                raise self.fail("character")
            self.at += 1
            return self.node("Constant", start, value=token.text, type="character")
        if token.kind == "string":
            parts = []
            while self.token and self.token.kind == "string":
                parts.append(self.token.text)
                self.at += 1
            return self.node("StringLiteral", start, value=" ".join(parts))
        if self.text() == "(":
            if self.flavor != "core" and self.text(1) == "{":
                self.need("(")
                body = self.compound()
                self.need(")")
                return self.node("Statement", start, [body])
            self.need("(")
            inner = self.expression()
            self.need(")")
            return inner
        if self.take("_Generic"):
            self.need("(")
            parts = [self.assignment()]
            while self.take(","):
                at = self.here()
                name = None if self.take("default") else self.type_name()
                self.need(":")
                parts.append(self.node("GenericAssociation", at, [name, self.assignment()]))
            self.need(")")
            return self.node("GenericSelection", start, parts)
        if self.take("__builtin_va_arg"):
            self.need("(")
            value = self.assignment()
            self.need(",")
            name = self.type_name()
            self.need(")")
            return self.node("VaArg", start, [value, name])
        if self.take("__builtin_offsetof"):
            self.need("(")
            name = self.type_name()
            self.need(",")
            members = [Node("OffsetMember", self.here(), self.here(), {"name": self.identifier()})]
            while op := self.take(".", "->", "["):
                at = self.here()
                if op == "[":
                    members.append(self.node("OffsetIndex", at, [self.expression()]))
                    self.need("]")
                else:
                    members.append(Node("OffsetMember", at, at, {"name": self.identifier()}))
            self.need(")")
            return self.node("OffsetOf", start, [name, *members])
        return self.node("Identifier", start, name=self.identifier())

    def postfix(self, head: Node, start: int) -> Node:
        while True:
            if self.take("["):
                head = self.node("BinaryOperator", start, [head, self.expression()], op="[]")
                self.need("]")
                head.end = self.last()
            elif self.take("("):
                given = []
                while self.text() != ")":
                    given.append(self.assignment())
                    if not self.take(","):
                        break
                self.need(")")
                head = self.node("Call", start, [head, *given])
            elif self.text() == "." and self.text(1) == ".":
                return head  # three dots are a range
            elif op := self.take(".", "->"):
                head = self.node("Member", start, [head], op=op, name=self.identifier())
            elif op := self.take("++", "--"):
                head = self.node("UnaryOperator", start, [head], op="post" + op)
            else:
                return head

    # types

    def starts_type(self, ahead: int = 0) -> bool:
        word = self.text(ahead)
        if word in _QUALIFIERS | _TYPES or word in ("struct", "union", "enum"):
            return True
        if word in self.words and word in ("typeof", "__typeof", "__typeof__", "_BitInt", "__attribute__", "__extension__"):
            return word != "__extension__" or self.starts_type(ahead + 1)
        k = self.at + ahead
        return k < len(self.tokens) and self.tokens[k].kind == "identifier" and word not in self.words and self.is_type(word)

    def starts_declaration(self) -> bool:
        return self.text() in _STORAGE | _FUNCTION or self.text() in ("_Alignas", "_Static_assert") or self.starts_type()

    def specifiers(self, storage: bool = True) -> list[Node]:
        """Declaration specifiers; a typedef name counts only before any other type."""
        out, typed = [], False
        while True:
            start, word = self.here(), self.text()
            if self.token is None or self.token.kind != "identifier":
                break
            if word in _STORAGE and storage:
                self.at += 1
                out.append(self.node("StorageClass", start, name=PLAIN.get(word, word)))
            elif word == "_Atomic" and self.text(1) == "(":
                self.at += 2
                name = self.type_name()
                self.need(")")
                out.append(self.node("TypeSpecifier", start, [name], name="_Atomic"))
                typed = True
            elif word in _QUALIFIERS:
                self.at += 1
                out.append(self.node("TypeQualifier", start, name=PLAIN.get(word, word)))
            elif word in _FUNCTION and storage:
                self.at += 1
                out.append(self.node("FunctionSpecifier", start, name=PLAIN.get(word, word)))
            elif word == "_Alignas":
                self.at += 1
                self.need("(")
                inner = self.type_name() if self.starts_type() else self.conditional()
                self.need(")")
                out.append(self.node("AlignmentSpecifier", start, [inner]))
            elif word in _TYPES:
                self.at += 1
                out.append(self.node("TypeSpecifier", start, name=PLAIN.get(word, word)))
                typed = True
            elif word == "_BitInt" and word in self.words:
                self.at += 1
                self.need("(")
                width = self.conditional()
                self.need(")")
                out.append(self.node("TypeSpecifier", start, [width], name="_BitInt"))
                typed = True
            elif word in ("struct", "union"):
                out.append(self.record())
                typed = True
            elif word == "enum":
                out.append(self.enumeration())
                typed = True
            elif word in ("typeof", "__typeof", "__typeof__") and word in self.words:
                self.at += 1
                self.need("(")
                inner = self.type_name() if self.starts_type() else self.expression()
                self.need(")")
                out.append(self.node("TypeSpecifier", start, [inner], name="typeof"))
                typed = True
            elif word in ("__attribute__", "__attribute") and word in self.words:
                out += self.extensions()
            elif word == "__extension__" and word in self.words:
                self.at += 1
            elif not typed and word not in self.words and self.is_type(word):
                self.at += 1
                out.append(self.node("TypeSpecifier", start, name=word, typedef="yes"))
                typed = True
            else:
                break
        if not out:
            raise self.fail("declaration specifier")
        return out

    def record(self) -> Node:
        start, kind = self.here(), self.take("struct", "union")
        more = self.extensions()
        name = self.identifier() if self.text() != "{" else None
        if name is None or self.text() == "{":
            self.need("{")
            fields = []
            if self.text() == "}" and self.flavor == "core":
                raise self.fail("field")
            while self.text() != "}":
                if self.take(";"):
                    continue
                fields.append(self.static_assert() if self.text() == "_Static_assert" else self.struct_field())
            self.need("}")
            return self.node("Record", start, [*fields, *more, *self.extensions()], kind=kind, name=name, body="yes")
        return self.node("Record", start, more, kind=kind, name=name)

    def struct_field(self) -> Node:
        start, specifiers, declarators = self.here(), self.specifiers(False), []
        while self.text() != ";":
            at = self.here()
            inner = None if self.text() == ":" else self.declarator()
            width = self.conditional() if self.take(":") else None
            declarators.append(self.node("StructDeclarator", at, [inner, *([self.node("BitWidth", width.start, [width])] if width else []), *self.extensions()]))
            if not self.take(","):
                break
        self.need(";")
        return self.node("StructField", start, [*specifiers, *declarators])

    def enumeration(self) -> Node:
        start = self.here()
        self.need("enum")
        more = self.extensions()
        name = self.identifier() if self.text() != "{" else None
        if name is not None and self.text() != "{":
            return self.node("Enum", start, more, name=name)
        self.need("{")
        members = []
        while self.text() != "}":
            at, member = self.here(), self.identifier()
            extra = self.extensions()
            value = self.conditional() if self.take("=") else None
            members.append(self.node("Enumerator", at, [value, *extra], name=member))
            self.declare(member, False)
            if not self.take(","):
                break
        self.need("}")
        return self.node("Enum", start, [*members, *more, *self.extensions()], name=name, body="yes")

    def extensions(self) -> list[Node]:
        """Attributes and assembler labels."""
        out = []
        while self.flavor != "core" and self.text() in ("__attribute__", "__attribute", "asm", "__asm__", "__asm"):
            start, word = self.here(), self.take(self.text())
            if word not in ("__attribute__", "__attribute"):
                self.take("volatile", "__volatile__")
                self.need("(")
                label = self.primary()
                self.need(")")
                out.append(self.node("AsmLabel", start, value=label.attrs.get("value", "")))
                continue
            self.need("(")
            self.need("(")
            while self.text() != ")":
                if self.take(","):
                    continue
                at = self.here()
                if self.token is None or self.token.kind != "identifier":
                    raise self.fail("attribute")
                name, given = {v: k for k, v in _LATER.items()}.get(self.text(), self.text()), []
                self.at += 1
                if name == "availability" and self.text() == "(":
                    begin = self.at
                    while self.token is not None and self.text() != ")":
                        self.at += 1
                    given.append(Node("Availability", at, self.here(), {"clauses": "".join(t.text for t in self.tokens[begin + 1 : self.at])}))
                    self.need(")")
                elif self.take("("):
                    while self.text() != ")":
                        given.append(self.type_name() if self.starts_type() else self.assignment())
                        if not self.take(","):
                            break
                    self.need(")")
                out.append(self.node("Attribute", at, given, name=name.strip("_") if name.startswith("__") else name))
            self.need(")")
            self.need(")")
        return out

    def pointer(self) -> Node | None:
        start = self.here()
        if not self.take("*") and not (self.flavor == "clang" and self.take("^")):
            return None
        marks = []
        while self.text() in _QUALIFIERS or (self.flavor != "core" and self.text() in ("__attribute__",)):
            at = self.here()
            marks += self.extensions() if self.text() == "__attribute__" else [self.node("TypeQualifier", at, name=PLAIN.get(w := self.take(self.text()), w))]
        return self.node("Pointer", start, marks)

    def declarator(self, abstract: bool = False, maybe: bool = False) -> Node:
        """Children: pointers, then a nested declarator if any, then arrays and functions; attrs name."""
        start, pointers, nested, name = self.here(), [], None, None
        more = self.extensions()
        while p := self.pointer():
            pointers.append(p)
        more += self.extensions()
        if self.token and self.token.kind == "identifier" and self.text() not in self.words and not (abstract and not maybe):
            name = self.identifier()
        elif self.text() == "(" and not ((abstract or maybe) and (self.text(1) == ")" or self.starts_type(1))):
            self.need("(")
            nested = self.declarator(abstract, maybe)
            self.need(")")
        elif not abstract and not maybe:
            raise self.fail("declarator")
        derived = []
        while self.text() in ("[", "("):
            derived.append(self.array() if self.text() == "[" else self.function())
        inner = nested.attrs.get("name") if nested else None
        return self.node("Declarator", start, [*pointers, nested, *derived, *more, *self.extensions()], name=name or inner)

    def array(self) -> Node:
        start = self.here()
        self.need("[")
        marks, static = [], False
        while self.text() in _QUALIFIERS or self.text() == "static":
            at, word = self.here(), self.take(self.text())
            if word == "static":
                static = True
            else:
                marks.append(self.node("TypeQualifier", at, name=PLAIN.get(word, word)))
        if self.text() == "*" and self.text(1) == "]":
            self.need("*")
            form, size = "variable_unknown", None
        elif self.text() == "]":
            form, size = "unknown", None
        else:
            form, size = "static" if static else "expression", self.assignment()
        self.need("]")
        return self.node("Array", start, [*marks, size], form=form)

    def function(self) -> Node:
        start = self.here()
        self.need("(")
        self.scopes.append({})
        given, variadic, old = [], False, False
        if self.text() != ")" and not self.starts_declaration() and self.token.kind == "identifier" and self.text() not in self.words:
            old = True
            while True:
                given.append(self.node("OldParameter", self.here(), name=self.identifier()))
                if not self.take(","):
                    break
        else:
            while self.text() != ")":
                if self.text() == "." and self.text(1) == "." and self.text(2) == ".":
                    self.at += 3
                    variadic = True
                    break
                at, specifiers = self.here(), self.specifiers()
                inner = None if self.text() in (",", ")") else self.declarator(maybe=True)
                given.append(self.node("Parameter", at, [*specifiers, inner], name=inner.attrs.get("name") if inner else None))
                self.declare(inner.attrs.get("name") if inner else None, False)
                if not self.take(","):
                    break
        self.need(")")
        self.scopes.pop()
        return self.node("Function", start, given, variadic="yes" if variadic else "", old="yes" if old else "")

    def type_name(self) -> Node:
        start, specifiers = self.here(), self.specifiers(False)
        inner = None if self.text() in (")", ",", ":") else self.declarator(abstract=True)
        return self.node("TypeName", start, [*specifiers, inner])

    # declarations

    def initializer(self) -> Node:
        start = self.here()
        if not self.take("{"):
            return self.assignment()
        items = []
        while self.text() != "}":
            at, marks = self.here(), []
            while op := self.take(".", "["):
                spot = self.here()
                if op == ".":
                    marks.append(self.node("MemberDesignator", spot, name=self.identifier()))
                else:
                    first = self.conditional()
                    if self.text() == "." and self.flavor != "core":
                        self.at += 3
                        marks.append(self.node("RangeDesignator", spot, [first, self.conditional()]))
                    else:
                        marks.append(self.node("IndexDesignator", spot, [first]))
                    self.need("]")
            if marks:
                self.take("=") if self.flavor != "core" else self.need("=")
            elif self.flavor != "core" and self.token and self.token.kind == "identifier" and self.text(1) == ":":
                marks.append(self.node("MemberDesignator", at, name=self.identifier()))
                self.need(":")
            items.append(self.node("InitializerItem", at, [*marks, self.initializer()]))
            if not self.take(","):
                break
        self.need("}")
        return self.node("InitializerList", start, items)

    def static_assert(self) -> Node:
        start = self.here()
        self.need("_Static_assert")
        self.need("(")
        parts = [self.conditional()]
        if self.take(","):
            parts.append(self.primary())
        self.need(")")
        self.need(";")
        return self.node("StaticAssert", start, parts)

    def declaration(self) -> Node:
        start = self.here()
        if self.text() == "_Static_assert":
            return self.static_assert()
        specifiers = self.specifiers()
        return self.declarators(start, specifiers)

    def declarators(self, start: int, specifiers: list[Node], first: Node | None = None) -> Node:
        typedef = any(s.kind == "StorageClass" and s.attrs["name"] == "typedef" for s in specifiers)
        out = []
        while first is not None or self.text() != ";":
            at = first.start if first else self.here()
            inner, first = first or self.declarator(), None
            self.declare(inner.attrs.get("name"), typedef)
            more = self.extensions()
            value = self.initializer() if self.take("=") else None
            out.append(self.node("InitDeclarator", at, [inner, *more, *([self.node("Initializer", value.start, [value])] if value else [])], name=inner.attrs.get("name")))
            if not self.take(","):
                break
        self.need(";")
        return self.node("Declaration", start, [*specifiers, *out])

    def external(self) -> Node | None:
        if self.take(";"):
            return None
        if self.flavor != "core" and self.text() == "__extension__" and self.text(1) == "_Static_assert":
            self.at += 1
        if self.text() == "_Static_assert":
            return self.static_assert()
        if self.flavor != "core" and self.text() in ("asm", "__asm__", "__asm"):
            start = self.here()
            out = self.extensions()
            self.need(";")
            return self.node("AsmStatement", start, out)
        start = self.here()
        specifiers = self.specifiers()
        if self.text() == ";":
            return self.declarators(start, specifiers)
        first = self.declarator()
        functions = first.find("Function")
        if functions and self.text() not in (";", "=", ",", "asm", "__asm__", "__asm"):
            self.declare(first.attrs.get("name"), False)
            self.scopes.append(dict.fromkeys((p.attrs["name"] for p in functions[0].children if p.attrs.get("name")), False))
            old = []
            while self.text() != "{":
                old.append(self.declaration())
            body = self.compound(scope=False)
            self.scopes.pop()
            return self.node("FunctionDefinition", start, [*specifiers, first, *old, body], name=first.attrs.get("name"))
        return self.declarators(start, specifiers, first)

    # statements

    def compound(self, scope: bool = True) -> Node:
        start = self.here()
        self.need("{")
        if scope:
            self.scopes.append({})
        items = []
        while self.text() != "}":
            if self.token is None:
                raise self.fail("'}'")
            items.append(self.block_item())
        self.need("}")
        if scope:
            self.scopes.pop()
        return self.node("Compound", start, items)

    def block_item(self) -> Node:
        label = self.token.kind == "identifier" and self.text(1) == ":" and self.text() not in self.words
        return self.declaration() if not label and self.starts_declaration() else self.statement()

    def scoped(self) -> Node:
        self.scopes.append({})
        out = self.statement()
        self.scopes.pop()
        return out

    def statement(self) -> Node:
        start, word = self.here(), self.text()
        if word == "{":
            return self.compound()
        if self.take(";"):
            return self.node("ExpressionStatement", start)
        if word in ("case", "default") and self.token.kind == "identifier":
            self.at += 1
            first = self.conditional() if word == "case" else None
            second = None
            if word == "case" and self.flavor != "core" and self.text() == "." and self.text(1) == ".":
                self.at += 3
                second = self.conditional()
            self.need(":")
            label = self.node("CaseRange" if second else word.capitalize(), start, [first, second])
            return self.node("Labeled", start, [label, self.statement()])
        if self.token and self.token.kind == "identifier" and word not in self.words and self.text(1) == ":":
            self.at += 2
            more = self.extensions()
            return self.node("Labeled", start, [Node("Label", start, self.last(), {"name": word}), *more, self.statement()])
        if self.take("if"):
            self.need("(")
            self.scopes.append({})  # of the whole statement; each branch has one of its own
            parts = [self.expression()]
            self.need(")")
            parts.append(self.scoped())
            if self.take("else"):
                parts.append(self.scoped())
            self.scopes.pop()
            return self.node("If", start, parts)
        if word in ("switch", "while") and self.take(word):
            self.need("(")
            self.scopes.append({})
            head = self.expression()
            self.need(")")
            body = self.scoped()
            self.scopes.pop()
            return self.node(word.capitalize(), start, [head, body])
        if self.take("do"):
            body = self.scoped()
            self.need("while")
            self.need("(")
            head = self.expression()
            self.need(")")
            self.need(";")
            return self.node("DoWhile", start, [body, head])
        if self.take("for"):
            self.need("(")
            self.scopes.append({})
            parts: list[Node | None] = []
            if self.starts_declaration():
                parts.append(self.declaration())
            else:
                parts.append(self.node("ForExpression", self.here(), [None if self.text() == ";" else self.expression()]))
                self.need(";")
            parts.append(self.node("ForCondition", self.here(), [None if self.text() == ";" else self.expression()]))
            self.need(";")
            parts.append(self.node("ForStep", self.here(), [None if self.text() == ")" else self.expression()]))
            self.need(")")
            parts.append(self.statement())
            self.scopes.pop()
            return self.node("For", start, parts)
        if self.take("goto"):
            target = self.expression() if self.text() == "*" else self.node("Label", self.here(), name=self.identifier())
            self.need(";")
            return self.node("Goto", start, [target])
        if word in ("continue", "break") and self.take(word):
            self.need(";")
            return self.node(word.capitalize(), start)
        if self.take("return"):
            value = None if self.text() == ";" else self.expression()
            self.need(";")
            return self.node("Return", start, [value])
        if self.flavor != "core" and word in ("asm", "__asm__", "__asm"):
            depth = 0
            while self.token is not None and not (self.text() == ";" and not depth):
                depth += (self.text() == "(") - (self.text() == ")")
                self.at += 1
            self.need(";")
            return self.node("Asm", start)
        value = self.expression()
        self.need(";")
        return self.node("ExpressionStatement", start, [value])

    # whole inputs

    def unit(self) -> Node:
        items = []
        while self.token is not None:
            item = self.external()
            if item is not None:
                items.append(item)
        return Node("TranslationUnit", 0, self.size, {}, items)

    def skip(self) -> None:
        """Beyond the next semicolon at depth zero, or the brace that closes, with a semicolon after it."""
        depth = 0
        while self.token is not None:
            text = self.take(self.text()) if self.token.kind != "string" else (setattr(self, "at", self.at + 1) or "")
            depth += (text in ("{", "(", "[")) - (text in ("}", ")", "]"))
            if text == ";" and depth <= 0:
                return
            if text == "}" and depth <= 0:
                self.take(";")
                return

    def recovered(self) -> tuple[Node, list[dict]]:
        """The unit, and what was skipped: (start, end, expected) for each part that does not parse."""
        at, saved = self.at, [dict(s) for s in self.scopes]
        try:
            return self.unit(), []
        except (ParseError, RecursionError):
            self.at, self.scopes = at, saved
        items, lost = [], []
        while self.token is not None:
            begin, depth = self.at, len(self.scopes)
            start = self.here()
            try:
                item = self.external()
                if item is not None:
                    items.append(item)
            except (ParseError, RecursionError) as e:
                del self.scopes[depth:]
                self.at = begin
                self.skip()
                if self.at == begin:
                    self.at += 1
                lost.append({"start": start, "end": self.last(), "expected": getattr(e, "expected", "less nesting")})
        return Node("TranslationUnit", 0, self.size, {}, items), lost


RULES = {"expression": "expression", "constant": "primary", "declaration": "declaration", "statement": "statement", "translation_unit": "unit"}


def parse(text: str, rule: str = "translation_unit", flavor: str = "gnu", typenames: tuple[str, ...] = ()) -> Node:
    """All of ``text`` as ``rule``; a :class:`ParseError` has the furthest offset that was reached."""
    parser = Parser(text, flavor, typenames)
    try:
        out = getattr(parser, RULES[rule])()
        if parser.token is not None:
            raise parser.fail("end of input")
        return out
    except ParseError:
        raise ParseError(*parser.furthest) from None
