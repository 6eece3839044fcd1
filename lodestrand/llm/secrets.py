"""Secret scans: three fixed patterns, and a linear-chain conditional random field that adds spans.

Tokens are runs of ``[A-Za-z0-9+/_.-]``. The field labels every one as begin, inside or outside of a secret
from its shape, the words and marks around it, the shapes of its neighbours and features of the whole text; Viterbi finds the best
labels. It is trained here, on sentences made from a fixed seed: secrets of many forms in many contexts, some of
several tokens, some of letters alone, and what is often mistaken for one (numbers, dates, addresses, versions,
links, long words, sentences about passwords). A span counts only if its path beats the one without it by a bar that no span that on
``PROSE`` other texts without secrets one span in ``WORDS_A_SPAN`` words exceeds.

A feature is a hash of small numbers that are counted for all tokens of a batch at once, so no token is left out
beforehand. Of a text none of whose tokens can gain anything by a label other than outside, whatever the
labels beside it, the best path is known; Viterbi runs over all others side by side.

Nulls and edges: a null text is empty and has no spans; offsets are code points, ends exclusive; the patterns'
spans stay, and those of the field stand beside them as kind ``crf``, also where they meet; other columns are ignored; repeated
rows are scanned row by row; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import texts

# The contract's patterns, in its order of kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")
FEATURES = 1 << 15
#: Texts of prose, some 130 words each, on which the bar is set, and its part of the greatest false margin there.
PROSE, BAR = 1500, 0.6
OUT, BEGIN, INSIDE = 0, 1, 2
#: Stands for a step that can't be, and for what ends a text in a batch.
NEVER, END = -1e9, "\0"


def _class(members: str) -> np.ndarray:
    """Which code points below 129 are members; 128 stands for all others."""
    out = np.zeros(129, bool)
    out[[ord(c) for c in members]] = True
    return out


DIGIT, LOWER, UPPER, MARK = (_class(x) for x in (string.digits, string.ascii_lowercase, string.ascii_uppercase, "+/_.-"))
VOWEL, HEXADECIMAL, BLANK, CODE = _class("aeiouAEIOU"), _class("0123456789abcdef"), _class(" \t"), _class("={};<>")
IN_TOKEN = DIGIT | LOWER | UPPER | MARK
#: Of a code point: 0 none, 1 digit, 2 lower, 3 upper, 4 mark; and its lower case.
KIND = (DIGIT + 2 * LOWER + 3 * UPPER + 4 * MARK).astype(np.int8)
LOWERED = np.where(UPPER, np.arange(129) + 32, np.arange(129)).astype(np.uint64)
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, ordered."""
    out = []
    low = text.lower()
    if "pass" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


class Tokens:
    """The tokens of some texts, end to end: ``start`` and ``end`` in ``codes``, ``row`` of each, and ``base`` of each row."""

    def __init__(self, rows: list[str]):
        self.codes = np.minimum(np.frombuffer(END.join([*rows, ""]).encode("utf-32-le", "replace"), np.uint32), 128).astype(np.uint8)
        self.base = np.r_[0, np.cumsum([len(t) + 1 for t in rows])].astype(np.int64)
        edge = np.flatnonzero(np.diff(np.r_[False, IN_TOKEN[self.codes], False].astype(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        self.row = np.searchsorted(self.base, self.start, "right") - 1

    def count(self, kind: np.ndarray) -> np.ndarray:
        """Code points of a kind in each token."""
        seen = np.r_[0, np.cumsum(kind[self.codes], dtype=np.int32)]
        return seen[self.end] - seen[self.start]

    def words(self) -> np.ndarray:
        """A hash of each token in lower case."""
        size = self.end - self.start
        at = np.repeat(self.start - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(int(size.sum())) if len(size) else np.zeros(0, np.int64)
        place = at - np.repeat(self.start, size)
        total = np.r_[np.uint64(0), np.cumsum((LOWERED[self.codes[at]] + np.uint64(1)) * _POWERS[place & 63], dtype=np.uint64)]
        edge = np.r_[0, np.cumsum(size)]
        return total[edge[1:]] - total[edge[:-1]]


def _beside(x: np.ndarray, row: np.ndarray, by: int) -> np.ndarray:
    """The value ``by`` tokens on in the same text, else 0."""
    out = np.zeros_like(x)
    if abs(by) >= len(x):
        return out
    here, there = (slice(-by, None), slice(None, by)) if by < 0 else (slice(None, -by), slice(by, None))
    out[here] = np.where(row[here] == row[there], x[there], 0)
    return out


def features(tokens: Tokens) -> Iterator[np.ndarray]:
    """Arrays of one feature's index for each token."""
    codes, row, start, end = tokens.codes, tokens.row, tokens.start, tokens.end
    size = end - start
    digits, lower, upper, marks = (tokens.count(k) for k in (DIGIT, LOWER, UPPER, MARK))
    kind = KIND[codes]
    turned = np.r_[0, np.cumsum(np.r_[False, kind[1:] != kind[:-1]], dtype=np.int32)]
    turns = turned[end] - turned[np.minimum(start + 1, len(codes))]
    kinds = (digits > 0) + 2 * (lower > 0) + 4 * (upper > 0) + 8 * (marks > 0)
    length = np.where(size < 12, size, np.minimum(12 + (size - 12) // 4, 20))
    shape = kinds * 32 + length
    padded = np.r_[np.zeros(3, np.uint8), codes, np.zeros(3, np.uint8)]
    touches, after, after2 = padded[start + 2], padded[end + 3], padded[end + 4]
    place = np.arange(len(codes))
    solid = np.maximum.accumulate(np.where(BLANK[codes], -1, place))  # the last code point up to here that isn't blank
    mark = np.where(start > 0, codes[solid[np.maximum(start - 1, 0)]] if len(codes) else 0, 0)
    head = sum(LOWERED[padded[start + 3 + k]] * np.uint64(200**k) * (size > k).astype(np.uint64) for k in range(3))
    word = tokens.words()
    previous, second, following = _beside(word, row, -1), _beside(word, row, -2), _beside(word, row, 1)
    assigned = np.isin(mark, [ord(c) for c in "=:\"'>"])
    before, behind = _beside(shape, row, -1), _beside(shape, row, 1)
    code_marks = np.add.reduceat(CODE[codes].astype(np.int32), tokens.base[:-1])
    long_text, marked = np.diff(tokens.base), None
    marked = np.minimum(5, 100 * code_marks // long_text)
    long_text = np.minimum(6, np.log2(long_text).astype(np.int64) // 2)
    values = (
        (0,), (shape,), (digits * 10 // np.maximum(size, 1), length), (turns * 10 // np.maximum(size, 1), length), (tokens.count(HEXADECIMAL) == size, length), (tokens.count(VOWEL) * 6 // np.maximum(lower + upper, 1), shape),
        (head,), (mark, shape), (touches, kinds), (after, after2, kinds), (previous,), (second,), (previous, second), (following,), (previous, assigned, length > 5), (previous, shape), (second, previous, kinds),
        (before, shape), (behind, shape), (word,), (size == size[np.maximum(np.arange(len(size)) - 1, 0)], before == shape, behind == shape, mark, kinds), (long_text[row], kinds), (marked[row], kinds),
    )
    for name, parts in enumerate(values):
        h = np.full(len(size), 0x9E3779B97F4A7C15 * (name + 1) % 2**64, np.uint64)
        for part in parts:
            h = (h ^ np.asarray(part).astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
        yield (h % np.uint64(FEATURES)).astype(np.int32)


class Field:
    """Weights of begin and inside by feature (outside is zero), and of each step between labels."""

    def __init__(self):
        self.bar = 0.0
        self.weight = np.zeros((2, FEATURES))
        self.step = np.zeros((3, 3))
        self.step[OUT, INSIDE] = NEVER

    def scores(self, tokens: Tokens) -> np.ndarray:
        """Of each token: begin and inside."""
        out = np.zeros((len(tokens.start), 2))
        for index in features(tokens):
            out[:, 0] += self.weight[0][index]
            out[:, 1] += self.weight[1][index]
        return out

    def most_gained(self, scores: np.ndarray) -> np.ndarray:
        """What a token can add to a path at most by begin or inside, over outside for all."""
        into = self.step.max(0)
        leave = max(0.0, self.step[BEGIN:, OUT].max() - self.step[OUT, OUT])
        return np.maximum(scores[:, 0] + into[BEGIN], scores[:, 1] + into[INSIDE]) - self.step[OUT, OUT] + leave

    def decode(self, chains: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi over chains of scores side by side; before and after each is outside."""
        order = sorted(range(len(chains)), key=lambda k: -len(chains[k]))
        sizes = np.array([len(chains[k]) for k in order], np.int64)
        best, back = np.tile(np.r_[0.0, NEVER, NEVER], (len(order), 1)), []
        offs = np.r_[0, np.cumsum(sizes)]
        flat = np.concatenate([chains[k] for k in order]) if order else np.zeros((0, 2))
        for t in range(int(sizes[0]) if len(sizes) else 0):
            n = int(np.searchsorted(-sizes, -t, "left"))  # chains that are longer
            way = best[:n, :, None] + self.step
            back.append(way.argmax(1).astype(np.int8))
            best[:n] = way.max(1)
            best[:n, 1:] += flat[offs[:n] + t]
        label = (best + self.step[:, OUT]).argmax(1)
        labels = [np.zeros(len(c), np.int8) for c in chains]
        for t in range(len(back) - 1, -1, -1):
            n = len(back[t])
            for k in range(n):
                labels[order[k]][t] = label[k]
            label[:n] = back[t][np.arange(n), label[:n]]
        return labels


def margins(labels: np.ndarray, scores: np.ndarray, field: Field) -> list[tuple[int, int, float]]:
    """(first, end, margin) of each span of a path: by how much the path beats the same one with that span outside."""
    begins, out = np.flatnonzero(labels == BEGIN).tolist(), []
    for a in begins:
        e = a + 1
        while e < len(labels) and labels[e] == INSIDE:
            e += 1
        path = [int(labels[a - 1]) if a else OUT, *labels[a:e].tolist(), int(labels[e]) if e < len(labels) else OUT]
        gain = sum(scores[a + k, x - 1] for k, x in enumerate(path[1:-1])) + sum(field.step[x, y] for x, y in zip(path, path[1:]))
        none = [path[0], *[OUT] * (e - a), path[-1]]
        out.append((a, e, float(gain - sum(field.step[x, y] for x, y in zip(none, none[1:])))))
    return out


def _above_bar(labels: np.ndarray, scores: np.ndarray, field: Field) -> np.ndarray:
    """The labels without spans that don't beat outside by the field's bar."""
    if field.bar > 0 and labels.any():
        labels = labels.copy()
        for a, e, margin in margins(labels, scores, field):
            if margin <= field.bar:
                labels[a:e] = OUT
    return labels


def field_spans(rows: list[str], field: Field) -> list[list[tuple[int, int]]]:
    """The secrets that the field finds in each text: a begin with the insides that follow, and the ``=`` that pad it."""
    tokens, out = Tokens(rows), [[] for _ in rows]
    scores = field.scores(tokens)
    able = np.unique(tokens.row[field.most_gained(scores) > 0])
    first, last = np.searchsorted(tokens.row, able, "left"), np.searchsorted(tokens.row, able, "right")
    chains = [scores[a:b] for a, b in zip(first, last)]
    for r, a, chain, labels in zip(able.tolist(), first.tolist(), chains, field.decode(chains)):
        base = int(tokens.base[r])
        labels = _above_bar(labels, chain, field)
        for t in np.flatnonzero(labels).tolist():
            s, e = int(tokens.start[a + t]) - base, int(tokens.end[a + t]) - base
            while rows[r][e : e + 1] == "=":
                e += 1
            if labels[t] == BEGIN:
                out[r].append((s, e))
            else:
                out[r][-1] = (out[r][-1][0], e)
    return out


# Made-up sentences to learn from.
NAMES = ("auth", "pwd", "pass", "key", "client_secret", "private_key", "access_key", "credentials", "bearer", "token", "secret", "password", "api key", "api_key", "signature", "db_pass", "passphrase", "login", "pin", "recovery code", "app password", "secret key")
PLAIN = ("is", "the", "a", "was", "for", "required", "expired", "invalid", "reset", "must", "be", "changed", "and", "of", "here", "forgot", "your", "not", "found", "please", "enter", "to", "new", "strong", "missing", "manager", "policy", "field", "rotated", "yesterday", "by", "admin", "never", "share", "it", "with", "anyone", "in", "on", "success", "ingredient", "success", "holder", "ring", "unknown", "empty", "set", "user", "server", "should", "only", "very", "long", "without", "every", "month")
OFTEN = ("the", "is", "to", "for", "of", "and", "a", "in", "that", "on", "as", "it", "be", "was", "by", "from", "at", "with")
COMMON = ("river", "maple", "stone", "orange", "tiger", "window", "copper", "silent", "garden", "rocket", "planet", "velvet", "harbor", "falcon", "summer", "winter", "marble", "candle", "forest", "thunder", "hunter", "dragon", "monkey", "sunshine", "keyboard", "qwerty", "coffee", "purple", "castle", "bridge")


class Maker:
    """Made-up texts with the spans of their secrets."""

    def __init__(self, seed: int, names: tuple[str, ...] = NAMES, common: tuple[str, ...] = COMMON):
        self.r, self.names, self.common = random.Random(seed), names, common
        self.parts = ["th", "er", "on", "an", "in", "ed", "re", "at", "es", "or", "ti", "la", "que", "ment", "ung", "der", "ción", "os", "aux", "eau", "wh", "ly", "sch", "ein", "è"]

    def pick(self, alphabet: str, low: int, high: int) -> str:
        return "".join(self.r.choice(alphabet) for _ in range(self.r.randint(low, high)))

    def word(self) -> str:
        w = "".join(self.r.choice(self.parts) for _ in range(self.r.randint(1, 4) if self.r.random() < 0.85 else self.r.randint(5, 7)))
        return w.capitalize() if self.r.random() < 0.15 else w

    def sentence(self) -> str:
        """Words without a secret, some of them those that stand beside secrets elsewhere, some again and again."""
        if self.r.random() < 0.06:
            return " ".join([self.word()] * self.r.randint(3, 20))
        return " ".join(self.r.choice(PLAIN) if self.r.random() < 0.25 else self.word() for _ in range(self.r.randint(2, 10)))

    def strong(self) -> str:
        """Strings that give themselves away."""
        mixed = string.ascii_letters + string.digits
        return self.r.choice([
            lambda: "sk-" + self.pick(mixed, 20, 48), lambda: "sk_live_" + self.pick(mixed, 20, 30), lambda: "ghp_" + self.pick(mixed, 30, 40), lambda: f"xoxb-{self.pick(string.digits, 10, 12)}-{self.pick(mixed, 20, 26)}",
            lambda: f"eyJ{self.pick(mixed, 16, 30)}.{self.pick(mixed + '_-', 20, 40)}.{self.pick(mixed + '_-', 20, 40)}", lambda: self.pick(mixed + "+/", 28, 60) + self.r.choice(["", "=", "=="]), lambda: "AIza" + self.pick(mixed + "_-", 35, 35),
            lambda: self.pick("0123456789abcdef", 24, 64), lambda: self.pick(mixed, 20, 40), lambda: "\n".join(self.pick(mixed + "+/", 48, 64) for _ in range(self.r.randint(2, 4))),
        ])()

    def weak(self) -> str:
        """Strings that only their place gives away: letters alone, short ones, several tokens."""
        mixed = string.ascii_letters + string.digits
        some = lambda n: [self.r.choice(self.common) for _ in range(n)]
        return self.r.choice([
            lambda: "".join(some(self.r.randint(2, 3))), lambda: "".join(w.capitalize() for w in some(self.r.randint(2, 3))), lambda: "-".join(some(self.r.randint(2, 4))), lambda: some(1)[0].capitalize() + self.pick(string.digits, 1, 4),
            lambda: self.pick(string.ascii_lowercase, 8, 14), lambda: self.pick(mixed, 6, 16), lambda: " ".join(self.pick(string.ascii_lowercase, 4, 4) for _ in range(4)), lambda: " ".join(self.pick("0123456789ABCDEF", 4, 4) for _ in range(self.r.randint(3, 6))),
            lambda: " ".join(self.pick(mixed + "+/", 8, 20) for _ in range(self.r.randint(2, 4))),
        ])()

    def decoy(self) -> str:
        digit, upper = string.digits, string.ascii_uppercase
        name = lambda: self.r.choice(self.names)
        return self.r.choice([
            lambda: self.pick(digit, 1, 18), lambda: ".".join(self.pick(digit, 1, 3) for _ in range(4)), lambda: f"{self.word()}.{self.pick(digit, 1, 3)}@mail{self.pick(digit, 1, 1)}.example.com", lambda: f"20{self.pick(digit, 2, 2)}-{self.pick(digit, 2, 2)}-{self.pick(digit, 2, 2)}",
            lambda: f"v{self.pick(digit, 1, 2)}.{self.pick(digit, 1, 2)}.{self.pick(digit, 1, 2)}", lambda: f"http://{self.word()}.example.net/{self.word()}/{self.pick(digit, 1, 6)}", lambda: f"+{self.pick(digit, 1, 2)} ({self.pick(digit, 3, 3)}) {self.pick(digit, 3, 3)}-{self.pick(digit, 4, 4)}",
            lambda: self.word() + self.pick(digit, 1, 4), lambda: "".join(self.word() for _ in range(5)), lambda: f"ISBN {self.pick(digit, 13, 13)}", lambda: f"{self.word()}-{self.word()}-{self.pick(digit, 2, 6)}", lambda: f"{self.pick(upper, 2, 2)}{self.pick(digit, 18, 22)}",
            lambda: f"{self.word()}_{self.word()}_{self.word()}_{self.word()}{self.pick(digit, 0, 2)}", lambda: " ".join(self.pick(digit, 4, 4) for _ in range(4)), lambda: " ".join(self.common[:3]), lambda: f"id {self.pick(digit, 4, 10)}",
            lambda: f"{name()} {' '.join(self.r.choice(PLAIN) for _ in range(self.r.randint(2, 5)))}", lambda: f"the {name()} is {self.r.choice(PLAIN)}", lambda: f"{name()}: {self.r.choice(PLAIN)}", lambda: f"{name()} {self.word()} {self.word()}", lambda: f"{self.word()} = {self.r.choice([self.word(), self.pick(digit, 1, 6)])}", lambda: f"{self.word()}{self.r.choice([':', ' is', ' for', ' to', ' use', ' as the', ' ->'])} {self.word()}",
            lambda: f"{self.word()}{self.r.choice([':', ' is', ' for', ' to', ' use'])} {self.word()} {self.word()} {self.word()}", lambda: f"{name()} {self.r.choice(['for', 'of', 'and', 'to'])} {self.word()} {self.word()}",
        ])()

    def prose(self) -> str:
        """A text without a secret, as long as documents are: sentences of made-up words, plain words among them, runs of one word, and what is mistaken for a secret."""
        out = []
        for _ in range(self.r.randint(3, 25)):
            ws = [self.r.choice(OFTEN if self.r.random() < 0.8 else PLAIN) if self.r.random() < 0.45 else self.word() for _ in range(self.r.randint(1, 16))]
            if self.r.random() < 0.04:
                ws = [self.r.choice((self.word(), self.r.choice(PLAIN).capitalize()))] * self.r.randint(3, 60)
            if self.r.random() < 0.04:
                ws.append(self.decoy())
            mark = self.r.choice(["", "", "", "", "", "!!", "###", " |", "$$$"])
            out.append((" ".join(w + (mark or ("," if self.r.random() < 0.1 else "")) for w in ws)).capitalize() + self.r.choice([".", ".", ".\n"]))
        return " ".join(out)

    FORMS = ('{k} = "{v}"', "{k}={v}", "{k}: {v}", "'{k}': '{v}'", "{k} is {v}", "{k} for {w}: {v}", "{k} for {w} is {v}", "export {K}={v}", "--{k} {v}", "use {v} as the {k}", "set {k} to {v}", "Authorization: Bearer {v}", "{k} -> {v}", "my {k} is {v}")

    def secret(self) -> tuple[str, str, str]:
        """(what stands before, the secret, what stands behind)."""
        strong = self.r.random() < 0.5
        form = "{v}" if strong and self.r.random() < 0.3 else self.r.choice(self.FORMS)
        k = self.r.choice(self.names)
        form = form.replace("{k}", k).replace("{K}", k.upper().replace(" ", "_")).replace("{w}", self.word())
        before, _, behind = form.partition("{v}")
        return before, self.strong() if strong else self.weak(), behind

    def text(self) -> tuple[str, list[tuple[int, int]]]:
        text, spans = "", []
        for _ in range(self.r.randint(1, 5)):
            text += self.sentence() + self.r.choice([" ", ". ", ", ", "\n"])
            if self.r.random() < 0.4:
                before, value, behind = self.secret()
                text += before
                spans.append((len(text), len(text) + len(value)))
                text += value + behind + self.r.choice([". ", "\n", ", ", " ; "])
            elif self.r.random() < 0.8:
                text += self.decoy() + self.r.choice([" ", ", ", ". ", "\n"])
        return text, spans


def labels_of(tokens: Tokens, spans: list[list[tuple[int, int]]]) -> np.ndarray:
    """The label of each token that the texts' spans give."""
    out = np.zeros(len(tokens.start), np.int64)
    for r, of_row in enumerate(spans):
        for a, b in of_row:
            a, b = a + tokens.base[r], b + tokens.base[r]
            hit = np.flatnonzero((tokens.start < b) & (tokens.end > a))
            out[hit[:1]], out[hit[1:]] = BEGIN, INSIDE
    return out


def _total(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis))


def trained(made: list[tuple[str, list[tuple[int, int]]]], rounds: int, rate: float = 0.5, decay: float = 2e-5) -> Field:
    """A field by full gradients of the log-likelihood, with steps by AdaGrad; expected counts by forward and backward sums over all texts side by side."""
    made = sorted(made, key=lambda m: -len(Tokens([m[0]]).start))
    tokens, field = Tokens([t for t, _ in made]), Field()
    label = labels_of(tokens, [s for _, s in made])
    index = np.stack(list(features(tokens)))
    sizes = np.bincount(tokens.row, minlength=len(made))
    offs, rows = np.r_[0, np.cumsum(sizes)], np.arange(len(made))
    active = [int((sizes > t).sum()) for t in range(int(sizes.max()))]
    ends = np.zeros((3, 3))
    same = tokens.row[1:] == tokens.row[:-1]
    np.add.at(ends, (label[:-1][same], label[1:][same]), 1)
    filled = sizes > 0
    np.add.at(ends, (OUT, label[offs[:-1][filled]]), 1)
    np.add.at(ends, (label[offs[1:][filled] - 1], OUT), 1)
    seen, seen_step = np.full((2, FEATURES), 1e-6), np.full((3, 3), 1e-6)
    for _ in range(rounds):
        emit = np.zeros((len(label), 3))
        for k in (0, 1):
            emit[:, k + 1] = field.weight[k][index].sum(0)
        forward, backward = np.zeros((len(label), 3)), np.zeros((len(label), 3))
        forward[offs[:-1][filled]] = field.step[OUT] + emit[offs[:-1][filled]]
        for t in range(1, len(active)):
            at = offs[rows[: active[t]]] + t
            forward[at] = _total(forward[at - 1][:, :, None] + field.step, 1) + emit[at]
        backward[offs[1:][filled] - 1] = field.step[:, OUT]
        for t in range(len(active) - 2, -1, -1):
            at = offs[rows[: active[t + 1]]] + t
            backward[at] = _total(field.step + (emit[at + 1] + backward[at + 1])[:, None, :], 2)
        whole = _total(forward[offs[1:][filled] - 1] + field.step[:, OUT], 1)
        of_token = np.repeat(whole, sizes[filled])
        share = np.exp(forward + backward - of_token[:, None])
        inner = np.flatnonzero(same)
        shift = ends - np.exp(forward[inner][:, :, None] + field.step + (emit[inner + 1] + backward[inner + 1])[:, None, :] - of_token[inner][:, None, None]).sum(0)
        shift[OUT] -= share[offs[:-1][filled]].sum(0)
        shift[:, OUT] -= share[offs[1:][filled] - 1].sum(0)
        shift[OUT, INSIDE] = 0
        for k in (0, 1):
            push = np.tile((label == k + 1) - share[:, k + 1], len(index))
            g = np.bincount(index.ravel(), push, FEATURES) / len(made) - decay * field.weight[k]
            seen[k] += g * g
            field.weight[k] += rate * g / np.sqrt(seen[k])
        g = shift / len(made)
        seen_step += g * g
        field.step += rate * g / np.sqrt(seen_step)
    return field


@lru_cache(1)
def trained_field(n: int = 2000, rounds: int = 60, seed: int = 17) -> Field:
    """A field trained on ``n`` made-up texts; the same for the same arguments."""
    maker = Maker(seed)
    # prose alone, as most documents are, keeps the field from what follows plain words
    field = trained([maker.text() for _ in range(n)] + [(maker.prose(), []) for _ in range(n // 4)], rounds)
    field.bar = bar_on([maker.prose() for _ in range(PROSE)], field)
    return field


def bar_on(texts_without: list[str], field: Field) -> float:
    """``BAR`` times the greatest margin of a span in texts without secrets."""
    tokens = Tokens(texts_without)
    scores = field.scores(tokens)
    edges = np.searchsorted(tokens.row, np.arange(len(texts_without) + 1))
    chains = [scores[a:b] for a, b in zip(edges, edges[1:])]
    found = [m for c, labels in zip(chains, field.decode(chains)) for _, _, m in margins(labels, c, field)]
    return BAR * max(found, default=0.0)


#: Texts whose tokens are scored at once, by code points; one text over it is scored alone.
SCORED = 1 << 20


def all_spans(rows: list[str], field: Field) -> list[list[tuple[int, int, int]]]:
    """Of each text the patterns' spans and those of the field."""
    out, held, size = [], [], 0
    for k, text in enumerate(rows):
        held.append(text)
        size += len(text)
        if size >= SCORED or k == len(rows) - 1:
            out += [sorted(base_spans(t) + [(s, 3, e) for s, e in more]) for t, more in zip(held, field_spans(held, field))]
            held, size = [], 0
    return out


def scan(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, spans): spans is an array of (kind, start, end), by start and then kind."""
    field = field or trained_field()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in found] for found in all_spans(batch.column("text").to_pylist(), field)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    return texts(docs).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: counts and digest of the patterns' spans, and all spans."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(F.filter("spans", lambda x: x["kind"] != "crf")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES = {"op5_secrets": op5_secrets}
SQL: dict[str, str] = {}
