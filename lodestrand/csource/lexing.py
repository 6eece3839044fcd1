"""Preprocessing tokens with byte ranges of the original text."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable
from dataclasses import dataclass, replace

import numpy as np

# The token kinds in the order they are tried, and the operators longest first.
_KINDS = (
    ("newline", r"\n"), ("space", r"[ \t\r\f]+"), ("line_comment", r"//[^\n]*"), ("block_comment", r"/\*(?s:.*?)(?:\*/|\Z)"), ("hash_hash", r"\#\#"), ("hash", r"\#"),
    ("string", r'(?:u8|[LuU])?"(?:\\.|[^"\\\n])*"?'), ("char", r"[LuU]?'(?:\\.|[^'\\\n])*'?"), ("identifier", r"[A-Za-z_][A-Za-z0-9_]*"), ("number", r"\.?[0-9](?:[eEpP][+-]|[A-Za-z0-9_.])*"),
    ("punctuation", r"<<=|>>=|<<|>>|==|!=|<=|>=|&&|\|\||\+\+|--|->|[-+*/%&|^]=|[\x80-\xff]+|(?s:.)"),
)
_TOKEN = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _KINDS))
#: Stretches of tokens that no neighbour changes: names (but before a quote), white space, bytes beyond ASCII, and signs that begin no longer token.
_PLAIN = rb"""(?:[A-Za-z_][A-Za-z0-9_]*+(?!["'])|[ \t\r\f\n]++|[\x80-\xff]++|[,;:?()\[\]{}~@$]|\.(?![0-9])|!(?!=))++"""
_STRETCH = re.compile(b"(?P<plain>" + _PLAIN + b")|" + b"|".join(f"(?P<{k}>{p})".encode("latin-1") for k, p in _KINDS))
#: The kinds in a stretch by a byte's number in ``_CLASS``: equal neighbours are one token of the first three, each byte is one of the others. Number 5, a zero byte, parts stretches.
_IN_PLAIN = ("identifier", "space", "punctuation", "newline", "punctuation")
_CLASS = bytes(5 if b == 0 else 2 if b > 127 else 3 if b == 10 else 1 if b in b" \t\r\f" else 0 if chr(b).isalnum() or b == 95 else 4 for b in range(256))
BLANK = frozenset({"space", "newline", "line_comment", "block_comment"})


@dataclass(frozen=True)
class Token:
    """``file[start:end]`` is where it stands; ``chain`` how the file was reached, ``via`` the macros that made it."""

    kind: str
    text: str
    file: str = ""
    start: int = 0
    end: int = 0
    chain: tuple = ()
    via: tuple = ()

    def at(self, other: Token, via: tuple) -> Token:
        """This token, standing where ``other`` does."""
        return replace(self, file=other.file, start=other.start, end=other.end, chain=other.chain, via=via)


def spliced(raw: bytes) -> tuple[str, list[int], list[int]]:
    """Text without continued line ends, a character for each byte; and where bytes went: (position in it, bytes gone before)."""
    out, places, gone, at, lost = [], [], [], 0, 0
    for m in re.finditer(rb"\\\r?\n", raw):
        out.append(raw[at : m.start()])
        lost += m.end() - m.start()
        places.append(m.end() - lost)
        gone.append(lost)
        at = m.end()
    return b"".join([*out, raw[at:]]).decode("latin-1"), places, gone


def tokenize(source: str, file: str = "", chain: tuple = ()) -> list[Token]:
    """All tokens, white space and comments included; their ranges cover the text but for continued line ends."""
    text, places, gone = spliced(source.encode())

    def original(position: int, end: bool) -> int:
        k = bisect_right(places, position - 1 if end else position)
        return position + (gone[k - 1] if k else 0)

    return [Token(m.lastgroup, m.group().encode("latin-1").decode("utf-8", "replace"), file, original(m.start(), False), original(m.end(), True), chain) for m in _TOKEN.finditer(text)]


def lexemes(source: str) -> list[tuple[str, str]]:
    """(kind, text) of all tokens, without their places."""
    if source.isascii() and "\\" not in source:
        return [(m.lastgroup, m.group()) for m in _TOKEN.finditer(source)]
    return [(t.kind, t.text) for t in tokenize(source)]


def kind_totals(sources: Iterable[bytes]) -> dict[str, list[int]]:
    """Tokens and their bytes by kind, as ``tokenize`` has them. Plain stretches are told by their bytes, a token has no object of its own."""
    totals: dict[str, list[int]] = {}

    def add(kind: str, n: int, size: int) -> None:
        seen = totals.setdefault(kind, [0, 0])
        seen[0], seen[1] = seen[0] + n, seen[1] + size

    for raw in sources:
        if b"\\\n" in raw or b"\\\r\n" in raw:
            for t in tokenize(raw.decode()):
                add(t.kind, 1, t.end - t.start)
            continue
        plain = []
        for m in _STRETCH.finditer(raw):
            if m.lastgroup == "plain":
                plain.append(m.group())
            else:
                add(m.lastgroup, 1, m.end() - m.start())
        of = np.frombuffer(b"\0".join([b"", *plain]).translate(_CLASS), np.uint8)
        first = of[1:][(of[1:] != of[:-1]) | (of[1:] > 2)]
        for kind, n, size in zip(_IN_PLAIN, np.bincount(first, minlength=6).tolist(), np.bincount(of, minlength=6).tolist(), strict=False):  # the parting bytes come last
            if n:
                add(kind, n, size)
    return totals


def significant(tokens: list[Token]) -> list[Token]:
    return [t for t in tokens if t.kind not in BLANK]


def stripped(tokens: list[Token]) -> list[Token]:
    """Without white space at the ends."""
    a, b = 0, len(tokens)
    while a < b and tokens[a].kind in BLANK:
        a += 1
    while b > a and tokens[b - 1].kind in BLANK:
        b -= 1
    return tokens[a:b]


def text_of(tokens: list[Token]) -> str:
    return "".join(t.text for t in tokens)


def line_starts(raw: bytes) -> list[int]:
    return [0] + [i + 1 for i, b in enumerate(raw) if b == 10]
