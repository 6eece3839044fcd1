"""Preprocessing of one unit under two policies.

``checked`` expands what is pending before each directive, takes ``#`` as a directive only at the start of a
line, and reports every gap by a coded diagnostic that lowers completeness. ``lenient`` takes any ``#`` as a
directive, drops includes that aren't found, raises nothing for malformed conditionals, and expands once at
the end with the final table.
"""

from __future__ import annotations

import posixpath
import re
from dataclasses import dataclass, field

from . import conditions
from .headers import builtin_headers, predefined
from .lexing import BLANK, Token, significant, stripped, text_of, tokenize
from .macros import Expansion, Macro, parse_definition, value_and_category

COMPLETE, PARTIAL, REJECTED = 0, 1, 2
#: Codes by letter: E forces rejection, P partiality, W and P1200 neither.
BUILTIN = "<builtin>/"


@dataclass(frozen=True)
class Diagnostic:
    code: str
    message: str
    file: str
    start: int
    end: int

    @property
    def impact(self) -> int:
        return {"E": REJECTED, "P": PARTIAL, "W": COMPLETE}[self.code[0]]


@dataclass(frozen=True)
class Limits:
    """Ceilings; callers may lower them."""

    file_bytes: int = 16 << 20
    total_bytes: int = 64 << 20
    include_depth: int = 128
    includes: int = 4096
    definitions: int = 100_000
    expansions: int = 1_000_000
    nesting: int = 256
    tokens: int = 4_000_000
    generated_bytes: int = 64 << 20

    def tightened(self, **lower: int) -> Limits:
        for name, value in lower.items():
            if not 0 < value <= getattr(self, name):
                raise ValueError(f"{name} may only be lowered")
        return Limits(**{**self.__dict__, **lower})


@dataclass
class Config:
    entries: list[str]
    forced: list[str] = field(default_factory=list)
    roots: list[str] = field(default_factory=list)
    #: (name, value or null) in order; a null value undefines.
    defines: list[tuple[str, str | None]] = field(default_factory=list)
    machine: str = "x86_64"
    system: str = "linux"
    model: str = "lp64"
    policy: str = "checked"
    limits: Limits = Limits()


@dataclass
class _Branch:
    active: bool
    taken: bool
    parent: bool
    else_seen: bool = False


class Stop(Exception):
    """A ceiling was hit: nothing further is read."""


def unsafe_spelling(path: str) -> bool:
    return path.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", path)


def candidates(including: str, name: str, system: bool, roots: list[str]) -> list[str]:
    """Paths to try, in order: the including file's folder (quoted form), the roots, the built-in headers."""
    here = [] if system else [posixpath.normpath(posixpath.join(posixpath.dirname(including), name))]
    return [*here, *(posixpath.normpath(posixpath.join(r, name)) for r in roots), BUILTIN + name]


def guard_of(tokens: list[Token]) -> str | None:
    """The name that guards a whole file: its first directive is ``#ifndef NAME``, the next ``#define NAME``, and nothing follows the last ``#endif``."""
    lines: list[list[Token]] = [[]]
    for t in tokens:
        if t.kind == "newline":
            lines.append([])
        elif t.kind not in BLANK:
            lines[-1].append(t)
    lines = [x for x in lines if x]
    heads = [[t.text for t in x[:3]] for x in lines]
    if len(heads) < 3 or heads[0][:2] != ["#", "ifndef"] or heads[1][:2] != ["#", "define"] or heads[0][2:] != heads[1][2:] or heads[-1][:2] != ["#", "endif"]:
        return None
    depth = 0
    for k, head in enumerate(heads):
        if head[0] == "#" and len(head) > 1:
            depth += head[1] in ("if", "ifdef", "ifndef")
            depth -= head[1] == "endif"
            if depth == 0 and k < len(heads) - 1 or depth == 1 and head[1] in ("else", "elif"):
                return None
    return heads[0][2] if len(heads[0]) > 2 else None


class Unit:
    """One run over ``files`` (path to bytes). Results: tokens, macros(), diagnostics, used."""

    def __init__(self, config: Config, files: dict[str, bytes]):
        self.config, self.files = config, {BUILTIN + k: v.encode() for k, v in builtin_headers(config.model).items()} | files
        self.table: dict[str, Macro] = {}
        self.history: list[Macro] = []
        self.diagnostics: list[Diagnostic] = []
        self.used: dict[str, str] = {}
        self.once: set[str] = set()
        self.guards: dict[str, str | None] = {}
        self.includes = self.read = self.lexed = 0
        self.checked = config.policy == "checked"
        self.expand = Expansion(self.table, self._call_problem, config.limits.expansions, config.limits.nesting)
        self.tokens: list[Token] = []

    def report(self, code: str, message: str, file: str = "", start: int = 0, end: int = 0) -> None:
        if self.checked:
            self.diagnostics.append(Diagnostic(code, message, file, start, end))

    def _call_problem(self, digits: str, token: Token) -> None:
        messages = {"2110": "macro arity mismatch", "2112": "macro call is not closed", "2206": "expansion ceiling", "2209": "expansion nesting ceiling"}
        self.report("E" + digits, f"{messages[digits]}: {token.text}", token.file, token.start, token.end)

    def ceiling(self, code: str, what: str, file: str = "", start: int = 0, end: int = 0) -> None:
        self.report(code, f"{what} ceiling", file, start, end)
        raise Stop

    def run(self) -> Unit:
        for name, value in predefined(self.config.machine, self.config.system, self.config.model).items():
            self.table[name] = Macro(name, None, False, tuple(tokenize(value, "<target>")), "<target>")
        for name, value in self.config.defines:
            if value is None:
                self.table.pop(name, None)
            else:
                self.define(Macro(name, None, False, tuple(tokenize(value, "<command line>")), "<command line>"))
        try:
            for role, paths in (("forced", self.config.forced), ("entry", self.config.entries)):
                for path in paths:
                    if path not in self.files:
                        self.report("P2100", f"not found: {path}")
                        continue
                    self.tokens += self.process(path, role, (), 0)
        except Stop:
            pass
        if not self.checked:
            self.tokens = self.expand(self.tokens)
        if sum(len(t.text) for t in self.tokens) > self.config.limits.generated_bytes:
            self.report("E2207", "generated bytes ceiling")
        return self

    def define(self, macro: Macro) -> None:
        was = self.table.get(macro.name)
        if len(self.history) >= self.config.limits.definitions:
            self.ceiling("E2208", "definition", macro.file, macro.start, macro.end)
        if was is not None and not was.same(macro):
            self.report("P2110", f"redefined differently: {macro.name}", macro.file, macro.start, macro.end)
        if any(t.kind in ("hash", "hash_hash") for t in macro.body):
            self.report("E2111", f"# or ## in the body of {macro.name}", macro.file, macro.start, macro.end)
        self.table[macro.name] = macro
        self.history.append(macro)

    def condition(self, tokens: list[Token], file: str, start: int, end: int) -> bool:
        """``defined`` is settled first, then macros are expanded, then the policy's evaluator decides."""
        out, k = [], 0
        while k < len(tokens):
            if tokens[k].text != "defined":
                out.append(tokens[k])
                k += 1
                continue
            rest = significant(tokens[k + 1 : k + 12])
            names = [t.text for t in rest[:3]]
            if names[:1] == ["("] and len(names) == 3 and names[2] == ")" and rest[1].kind == "identifier":
                name, last = names[1], rest[2]
            elif rest and rest[0].kind == "identifier":
                name, last = names[0], rest[0]
            elif self.checked:
                self.report("E2113", "malformed defined", file, start, end)
                return False
            else:
                out.append(Token("number", "0"))
                k += 1
                continue
            out.append(Token("number", str(int(name in self.table))))
            k = next(i for i in range(k + 1, len(tokens)) if tokens[i] is last) + 1
        value = conditions.value_of(self.expand(out), conditions.CHECKED if self.checked else conditions.LENIENT, 64)
        if value is None:
            self.report("E2113", "condition outside the exact subset", file, start, end)
        return bool(value)

    def process(self, path: str, role: str, chain: tuple, depth: int) -> list[Token]:
        limits, raw = self.config.limits, self.files[path]
        if path in self.once or self.guards.get(path) in self.table:
            return []
        if depth > limits.include_depth:
            self.ceiling("E2203", "include depth", *(chain[-1][:3] if chain else ()))
        if path not in self.used:
            if len(raw) > limits.file_bytes:
                self.ceiling("E2201", "file bytes", path)
            self.read += len(raw)
            if self.read > limits.total_bytes:
                self.ceiling("E2202", "total bytes", path)
            self.used[path] = "builtin" if path.startswith(BUILTIN) else role
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError as e:
            self.report("E2214", "the file is not UTF-8 and is left out", path, e.start, e.end)
            return []
        tokens = tokenize(text, path, chain)
        self.guards[path] = guard_of(tokens)
        self.lexed += len(tokens)
        if self.lexed > limits.tokens:
            self.ceiling("E2205", "token", path)
        out: list[Token] = []
        pending: list[Token] = []
        stack: list[_Branch] = []
        k, fresh = 0, True

        def flush() -> None:
            out.extend(self.expand(pending) if self.checked else pending)
            pending.clear()

        while k < len(tokens):
            token = tokens[k]
            active = not stack or stack[-1].active
            if token.kind == "hash" and (fresh or not self.checked):
                flush()
                line_end = next((i for i in range(k, len(tokens)) if tokens[i].kind == "newline"), len(tokens))
                last = tokens[min(line_end, len(tokens) - 1)]
                out += self.directive(tokens[k + 1 : line_end], stack, active, path, chain, depth, token.start, last.end)
                out.append(Token("space", "\n", path, token.start, last.end, chain))
                k, fresh = line_end + 1, True
                continue
            if active:
                if token.kind == "hash":
                    self.report("E2108", "# not at the start of a line", path, token.start, token.end)
                if token.kind in BLANK:
                    token = Token("space", "\n" if token.kind == "newline" else token.text if token.kind == "space" else " ", path, token.start, token.end, chain)
                pending.append(token)
            if tokens[k].kind == "newline" or (tokens[k].kind.endswith("comment") and "\n" in tokens[k].text):
                fresh = True
            elif tokens[k].kind not in BLANK:
                fresh = False
            k += 1
        flush()
        if stack:
            self.report("E2105", "conditional is not closed", path, 0, len(raw))
        return out

    def directive(self, line: list[Token], stack: list[_Branch], active: bool, path: str, chain: tuple, depth: int, start: int, end: int) -> list[Token]:
        line = stripped(line)
        name, rest = (line[0].text, stripped(line[1:])) if line else ("", [])
        if name in ("if", "ifdef", "ifndef"):
            if name == "if":
                taken = active and self.condition(rest, path, start, end)
            else:
                taken = active and ((rest[0].text if rest else "") in self.table) == (name == "ifdef")
            stack.append(_Branch(taken, taken, active))
        elif name in ("elif", "else", "endif"):
            if not stack:
                self.report("E2106", f"#{name} without #if", path, start, end)
            elif name == "endif":
                stack.pop()
            elif stack[-1].else_seen and self.checked:
                self.report("E2107", f"#{name} after #else", path, start, end)
                stack[-1].active = False
            else:
                top = stack[-1]
                top.active = top.parent and not top.taken and (name == "else" or self.condition(rest, path, start, end))
                top.taken |= top.active or name == "else"
                top.else_seen = name == "else"
        elif not active or not line:
            pass
        elif name == "define":
            made = parse_definition(rest)
            if made is not None:
                self.define(Macro(made.name, made.params, made.variadic, made.body, path, start, end))
        elif name == "undef":
            self.table.pop(rest[0].text if rest else "", None)
        elif name == "include":
            return self.include(text_of(rest).strip(), path, chain, depth, start, end)
        elif name in ("error", "warning"):
            self.report("E2103" if name == "error" else "W2100", f"active #{name}: {text_of(rest)}", path, start, end)
        elif name == "pragma":
            spelling = text_of(rest).strip()
            if spelling == "once":
                self.once.add(path)
            elif spelling.startswith("pack"):
                self.report("E2104", "#pragma pack", path, start, end)
            else:
                self.report("P2103", f"unknown pragma: {spelling}", path, start, end)
        elif name == "line" or line[0].kind == "number":
            self.report("P2104", "line markers are not followed", path, start, end)
        else:
            self.report("P2102" if name == "include_next" else "P2101", f"unknown directive: {name}", path, start, end)
        return []

    def include(self, spelling: str, path: str, chain: tuple, depth: int, start: int, end: int) -> list[Token]:
        self.includes += 1
        if self.includes > self.config.limits.includes:
            self.ceiling("E2204", "include", path, start, end)
        m = re.match(r'<([^>]+)>|"([^"]+)"', spelling)
        if not m:
            self.report("P2100", f"not found: {spelling}", path, start, end)
            return []
        name, system = m.group(1) or m.group(2), m.group(1) is not None
        if self.checked and unsafe_spelling(name):
            self.report("E2102", f"unsafe include: {name}", path, start, end)
            return []
        found = next((c for c in candidates(path, name, system, self.config.roots) if c in self.files), None)
        if found is None:
            self.report("P2100", f"not found: {name}", path, start, end)
            return []
        return self.process(found, "include", (*chain, (path, start, end, found)), depth + 1)

    def macros(self) -> list[dict]:
        """Definitions by file and name, of the names whose final definition is in that file."""
        out = []
        for macro in self.table.values():
            if macro.file == "<target>":
                continue
            kind, value, category = value_and_category(macro)
            times = sum(1 for m in self.history if (m.file, m.name) == (macro.file, macro.name))
            out.append({"name": macro.name, "file": macro.file, "start": macro.start, "end": macro.end, "function_like": macro.params is not None, "body": text_of(list(macro.body)).strip(), "value_kind": kind, "value": value, "category": category, "n_definitions": times})
        return sorted(out, key=lambda m: (m["file"], m["name"]))
