"""Macro definitions, argument collection, substitution and expansion."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from .conditions import integer
from .lexing import BLANK, Token, significant, stripped, text_of, tokenize


@dataclass(frozen=True)
class Macro:
    """``params`` is null for an object-like macro."""

    name: str
    params: tuple[str, ...] | None
    variadic: bool
    body: tuple[Token, ...]
    file: str = ""
    start: int = 0
    end: int = 0

    def same(self, other: Macro) -> bool:
        """Equal parameters and, white space apart, bodies."""
        words = lambda m: [t.text for t in significant(list(m.body))]
        return (self.params, self.variadic, words(self)) == (other.params, other.variadic, words(other))


def parse_definition(line: list[Token]) -> Macro | None:
    """The tokens after ``define``; a parameter list must touch the name."""
    line = stripped(line)
    if not line or line[0].kind != "identifier":
        return None
    name, rest, params, variadic = line[0].text, line[1:], None, False
    if rest and rest[0].text == "(":
        close = next((k for k, t in enumerate(rest) if t.text == ")"), None)
        if close is None:
            return None
        words = [t.text for t in significant(rest[1:close]) if t.text != ","]
        if words[-3:] == [".", ".", "."]:
            words, variadic = words[:-3], True
        params, rest = tuple(words), rest[close + 1 :]
    return Macro(name, params, variadic, tuple(stripped(rest)))


def arguments(tokens: list[Token], at: int) -> tuple[list[list[Token]], int] | None:
    """The arguments of the call whose parenthesis may follow ``at``, and the index after it; null without a call."""
    while at < len(tokens) and tokens[at].kind in BLANK:
        at += 1
    if at >= len(tokens) or tokens[at].text != "(":
        return None
    depth, parts = 0, [[]]
    for k in range(at, len(tokens)):
        text = tokens[k].text if tokens[k].kind == "punctuation" else ""
        if text == "(":
            depth += 1
            if depth == 1:
                continue
        elif text == ")":
            depth -= 1
            if not depth:
                parts = [stripped(p) for p in parts]
                return ([] if parts == [[]] else parts), k + 1
        elif text == "," and depth == 1:
            parts.append([])
            continue
        parts[-1].append(tokens[k])
    return [], -1  # never closed


def stringified(tokens: list[Token]) -> Token:
    body = re.sub(r"\s+", " ", text_of(stripped(tokens))).replace("\\", "\\\\").replace('"', '\\"')
    return Token("string", f'"{body}"')


def substitute(macro: Macro, given: list[list[Token]]) -> list[Token]:
    """The body with arguments in place, ``#`` and ``##`` done; arguments are not expanded beforehand."""
    names = dict(zip(macro.params or (), given))
    if macro.variadic:
        more: list[Token] = []
        for k, part in enumerate(given[len(macro.params) :]):
            more += [Token("punctuation", ","), *part] if k else part
        names["__VA_ARGS__"] = more
    out: list[Token] = []
    body, k = list(macro.body), 0

    def after(k: int) -> int:
        while k < len(body) and body[k].kind in BLANK:
            k += 1
        return k

    while k < len(body):
        token = body[k]
        if token.kind == "hash" and macro.params is not None and (n := after(k + 1)) < len(body) and body[n].text in names:
            out.append(stringified(names[body[n].text]))
            k = n + 1
        elif token.kind == "hash_hash" and out and (n := after(k + 1)) < len(body):
            while out and out[-1].kind in BLANK:
                out.pop()
            right = names.get(body[n].text, [body[n]]) if body[n].kind == "identifier" else [body[n]]
            left = out.pop() if out else None
            joined = (left.text if left else "") + (right[0].text if right else "")
            out += tokenize(joined) + list(right[1:])
            k = n + 1
        else:
            out += names[token.text] if token.kind == "identifier" and token.text in names else [token]
            k += 1
    return out


@dataclass
class Expansion:
    """Expands against a live table. ``problem`` hears (code, token) of calls that can't be made and of ceilings."""

    table: dict[str, Macro]
    problem: Callable[[str, Token], None] = lambda code, token: None
    most: int = 1_000_000
    deepest: int = 256
    done: int = 0
    stopped: bool = False

    def __call__(self, tokens: list[Token], painted: tuple[str, ...] = ()) -> list[Token]:
        """Names in ``painted`` are being expanded and stay, so self-reference ends."""
        out, k = [], 0
        while k < len(tokens):
            token = tokens[k]
            macro = self.table.get(token.text) if token.kind == "identifier" and token.text not in painted and not self.stopped else None
            if macro is None:
                out.append(token)
                k += 1
                continue
            given, after = [], k + 1
            if macro.params is not None:
                call = arguments(tokens, k + 1)
                if call is None:
                    out.append(token)
                    k += 1
                    continue
                given, after = call
                if after < 0:
                    self.problem("2112", token)
                    out += tokens[k:]
                    break
                if len(macro.params) == 1 and not given:
                    given = [[]]
                if len(given) < len(macro.params) or (len(given) > len(macro.params) and not macro.variadic):
                    self.problem("2110", token)
                    out += tokens[k:after]
                    k = after
                    continue
            self.done += 1
            if self.done > self.most or len(painted) >= self.deepest:
                self.problem("2206" if self.done > self.most else "2209", token)
                self.stopped = True
                return out + tokens[k:]
            step = (macro.name, token.file, token.start, tokens[after - 1].end if tokens[after - 1].file == token.file else token.end, macro.file, macro.start, macro.end)
            made = [t.at(token, (*token.via, step)) for t in substitute(macro, given)]
            out += self(made, (*painted, macro.name))
            k = after
        return out


def value_and_category(macro: Macro) -> tuple[str | None, str | None, str]:
    """(kind of value, value, category) of a final definition."""
    words = [t.text for t in significant(list(macro.body))]
    kind = value = None
    if len(words) == 1 and words[0].startswith('"'):
        kind, value = "string", words[0]
    elif len(words) == 1 and words[0][0].isdigit():
        m = re.fullmatch("(.*?)([uUlL]*)", words[0])
        number = integer(m.group(1))
        kind, value = ("unsigned" if "u" in m.group(2).lower() else "signed", str(number)) if number is not None else ("tokens", words[0])
    elif words:
        kind, value = "tokens", " ".join(words)
    if macro.params is None and not words:
        return kind, value, "configuration_flag"
    return kind, value, "bindable_constant" if kind else "abi_affecting"
