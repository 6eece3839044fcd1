"""Integer expressions under three policies.

* ``LENIENT``: 128-bit values, an undefined name is 0, what is malformed or divides by zero is 0.
* ``CHECKED``: the target's ``long long``; whatever is outside the exact subset is an error; the right side
  of ``&&`` and ``||`` and the branch not taken of ``?:`` are not evaluated.
* ``CONSTANT``: for bounds and widths; names and overflow give no value, both sides of ``&&`` and ``||`` must have one.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence

from .lexing import BLANK, Token

LENIENT, CHECKED, CONSTANT = "lenient", "checked", "constant"
#: Binary operators by level, loosest first.
LEVELS = (("||",), ("&&",), ("|",), ("^",), ("&",), ("==", "!="), ("<", ">", "<=", ">="), ("<<", ">>"), ("+", "-"), ("*", "/", "%"))
_LEVEL_OF = {o: n for n, level in enumerate(LEVELS) for o in level}
_ARITHMETIC = {"+": operator.add, "-": operator.sub, "*": operator.mul}
_COMPARED = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}
_BITS = {"&": operator.and_, "|": operator.or_, "^": operator.xor}
_ESCAPES = {"n": 10, "t": 9, "r": 13, "0": 0, "\\": 92, "'": 39, '"': 34, "a": 7, "b": 8, "f": 12, "v": 11}


class Malformed(ValueError):
    """The expression has no value under the policy."""


class _Parser:
    """Lexemes (kind, text) to nested tuples: (operator, operands...)."""

    def __init__(self, lexemes: list[tuple[str, str]], strict: bool):
        self.tokens, self.at, self.strict = [t for t in lexemes if t[0] not in BLANK], 0, strict

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else None

    def take(self, text: str) -> bool:
        if self.peek() == text:
            self.at += 1
            return True
        if self.strict:
            raise Malformed(f"expected {text}")
        return False

    def choice(self) -> tuple:
        head = self.binary(0)
        if self.peek() != "?":
            return head
        self.at += 1
        yes = self.choice()
        if not self.take(":"):
            return ("?", head, yes, ("value", 0))
        return ("?", head, yes, self.choice())

    def binary(self, level: int) -> tuple:
        """Operators of ``level`` or tighter; a right side has only tighter ones than its operator, so equals go from the left."""
        left = self.unary()
        while (own := _LEVEL_OF.get(sign := self.peek(), -1)) >= level:
            self.at += 1
            left = (sign, left, self.binary(own + 1))
        return left

    def unary(self) -> tuple:
        text = self.peek()
        if text in ("!", "-", "+", "~"):
            self.at += 1
            return ("u" + text, self.unary())
        if text == "(":
            self.at += 1
            inner = self.choice()
            self.take(")")
            return inner
        if text is None:
            if self.strict:
                raise Malformed("an operand is missing")
            return ("value", 0)
        self.at += 1
        return self.tokens[self.at - 1]


def parse(lexemes: list[tuple[str, str]], policy: str) -> tuple:
    parser = _Parser(lexemes, policy != LENIENT)
    if not parser.tokens:
        if parser.strict:
            raise Malformed("empty expression")
        return ("value", 0)
    tree = parser.choice()
    if parser.strict and parser.peek() is not None:
        raise Malformed(f"unexpected {parser.peek()}")
    return tree


def integer(text: str) -> int | None:
    """Value of the digits of a literal in its radix, null if they don't fit it."""
    low = text.lower()
    digits, base = (low[2:], 16) if low.startswith("0x") else (low[2:], 2) if low.startswith("0b") else (low[1:], 8) if len(low) > 1 and low[0] == "0" else (low, 10)
    try:
        return int(digits, base) if digits and "_" not in digits else None
    except ValueError:
        return None


def _literal(text: str, policy: str, top: int) -> int:
    digits = text.rstrip("uUlL")
    suffix = text[len(digits) :]
    if policy == CHECKED and suffix.lower() not in ("", "l", "ll"):
        raise Malformed(f"suffix {suffix}")
    value = integer(digits)
    if value is None or (policy != LENIENT and value > top):
        if policy == LENIENT:
            return 0
        raise Malformed(f"not an integer in range: {text}")
    return value


def _character(text: str) -> int:
    body = text[text.index("'") + 1 :].rstrip("'")
    if body.startswith("\\"):
        return _ESCAPES.get(body[1:2], ord(body[1]) if len(body) > 1 else 0)
    return ord(body[0]) if body else 0


def evaluate(tree: tuple, policy: str, width: int = 64) -> int:
    """The tree's value; ``width`` bounds the checked policy, the others have 128 bits."""
    bits = width if policy == CHECKED else 128
    top = (1 << (bits - 1)) - 1

    def fit(x: int) -> int:
        if -top - 1 <= x <= top:
            return x
        if policy == LENIENT:
            return (x + top + 1) % (1 << bits) - top - 1
        raise Malformed("overflow")

    def of(t: tuple) -> int:
        kind = t[0]
        if kind == "value":
            return t[1]
        if kind == "number":
            return _literal(t[1], policy, top)
        if kind == "char":
            if policy != LENIENT:
                raise Malformed("character constant")
            return _character(t[1])
        if kind == "identifier":
            if policy == CONSTANT:
                raise Malformed(f"name {t[1]}")
            return 0
        if kind == "?":
            if policy == LENIENT:
                head, yes, no = of(t[1]), of(t[2]), of(t[3])
                return yes if head else no
            return of(t[2]) if of(t[1]) else of(t[3])
        if kind in ("&&", "||"):
            left = of(t[1])
            if policy == CHECKED and bool(left) == (kind == "||"):
                return int(bool(left))
            right = of(t[2])
            return int(bool(left) and bool(right)) if kind == "&&" else int(bool(left) or bool(right))
        if kind in ("u!", "u-", "u+", "u~"):
            x = of(t[1])
            if kind == "u~" and policy == CHECKED:
                raise Malformed("~ depends on the width")
            return {"u!": lambda: int(not x), "u-": lambda: fit(-x), "u+": lambda: x, "u~": lambda: ~x}[kind]()
        if len(t) != 3:
            if policy == LENIENT:
                return 0
            raise Malformed(f"unexpected {t[1]}")
        x, y = of(t[1]), of(t[2])
        if kind in ("/", "%"):
            if y == 0:
                if policy == LENIENT:
                    return 0
                raise Malformed("division by zero")
            quotient = abs(x) // abs(y) * (1 if (x < 0) == (y < 0) else -1)
            return fit(quotient if kind == "/" else x - y * quotient)
        if kind in ("<<", ">>"):
            if policy == CHECKED and (not 0 <= y < width or x < 0):
                raise Malformed("shift out of range")
            if policy == CONSTANT and not 0 <= y < 128:
                raise Malformed("shift out of range")
            y %= 128
            if kind == ">>":
                return x >> y
            if policy == CHECKED:
                return fit(x << y)
            return ((x << y) + top + 1) % (1 << bits) - top - 1
        if kind in ("&", "|", "^"):
            if policy == CHECKED and (x < 0 or y < 0):
                raise Malformed("bits of a negative value")
            return _BITS[kind](x, y)
        if kind in _ARITHMETIC:
            return fit(_ARITHMETIC[kind](x, y))
        return int(_COMPARED[kind](x, y))

    return of(tree)


def _value(tree: tuple, policy: str, width: int) -> int | None:
    try:
        return evaluate(tree, policy, width)
    except (Malformed, RecursionError):
        return 0 if policy == LENIENT else None


def _tree(lexemes: list[tuple[str, str]], policy: str) -> tuple | None:
    try:
        return parse(lexemes, policy)
    except (Malformed, RecursionError):
        return ("value", 0) if policy == LENIENT else None


def values_of(lexemes: list[tuple[str, str]], policies: Sequence[str] = (LENIENT, CHECKED, CONSTANT), width: int = 64) -> list[int | None]:
    """The value under each policy. What the strict grammar takes has the same tree under all, so it is parsed once."""
    tree = _tree(lexemes, CHECKED)
    trees = [_tree(lexemes, p) if tree is None and p == LENIENT else tree for p in policies]
    return [None if t is None else _value(t, p, width) for t, p in zip(trees, policies, strict=True)]


def value_of(tokens: list[Token], policy: str, width: int = 64) -> int | None:
    """The value; null where the policy has none."""
    tree = _tree([(t.kind, t.text) for t in tokens], policy)
    return None if tree is None else _value(tree, policy, width)
