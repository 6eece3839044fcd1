"""SentencePiece encoding by an Aho-Corasick automaton and one Viterbi pass, and decoding.

The automaton holds all pieces. One pass over a text follows, at each position, the output links to every
piece that ends there, and relaxes the best path to that position from the best path to the piece's start.
A path's score is the sum of its pieces' scores. In a unigram model any piece may follow any other. In a BPE
model a step scores minus infinity unless merging leaves just the two pieces side by side, so exactly
one path, the one that the merges give, has a finite score at each position; that test is remembered for each pair.
The kind, and whether a space is put first, are read from the model; a model that maps or trims characters, or has
symbols of its user's, is refused with an error, since its ids would not be the library's.

A text is cut beforehand only where no piece can reach over: before a run of spaces, around line feeds and
other characters that no piece has, and between a letter and a mark if no piece has such a pair. Parts are
remembered in a bounded cache.

Nulls and edges: a null text is encoded as an empty one, to no ids; a character without a piece becomes its
byte pieces, or the unknown piece if the model has none; decoding puts the bytes together again, so every
text comes back but for U+2581, which stands for a space in a model; a null id list decodes to null, other
columns are kept by ``encode`` and ``decode``, which add one or replace it; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches, texts, whole

SPACE = "▁"
#: Entries of each of the two generations of remembered parts, the longest part that is remembered, and remembered pairs.
#: A worker outlives its stage, so these bound what it holds while others run: some 180 MB.
CACHE, CACHED, PAIRS = 250_000, 48, 400_000
#: Kinds of model and of piece by their numbers in a model file.
KINDS, USER_DEFINED = {1: "unigram", 2: "bpe"}, 4


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message: an int for a varint, else bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value, shift = 0, 0
        while True:
            b = message[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(message):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, message[at : at + size]
        at += size


def settings(model: bytes) -> tuple[str, bool]:
    """(kind, whether a space is put first) of a model file's bytes; ``ValueError`` for what the operator doesn't do."""
    kind, space = 1, True
    for number, value in fields(model):
        if number == 1 and dict(fields(value)).get(3, 1) == USER_DEFINED:
            raise ValueError("the model has symbols of its user's")
        if number == 2:
            trainer = dict(fields(value))
            kind = trainer.get(3, 1)
            if trainer.get(24, 0):
                raise ValueError("the model treats white space as a suffix")
        if number == 3:
            rules = dict(fields(value))
            space = bool(rules.get(3, 1))
            if rules.get(2) or rules.get(4, 1) or not rules.get(5, 1):
                raise ValueError("the model maps characters, trims white space, or keeps spaces as they are")
    if kind not in KINDS:
        raise ValueError(f"the model is neither unigram nor BPE: type {kind}")
    return KINDS[kind], space


def default_model() -> str:
    """The path of the public BPE model of 32,000 pieces; only a default, the operators take any path."""
    try:
        import public_tokenizers
    except ImportError as e:
        raise ImportError("no default model here: give the path of a SentencePiece model") from e
    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A model's pieces, the automaton over them, and the two directions."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.kind, self.space = settings(model.serialized_model_proto())
        self.unknown = model.unk_id()
        special = {i for i in ids if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.names = {i: model.id_to_piece(i) for i in ids if i not in special}
        self.score = {i: model.get_score(i) for i in self.names}
        self.id_of = {p: i for i, p in self.names.items()}
        self.byte_id = {int(model.id_to_piece(i)[1:-1], 16): i for i in ids if model.is_byte(i)}
        self.alphabet = {c for p in self.names.values() for c in p}
        self.bytes_of = [b""] * len(ids)
        for i, p in self.names.items():
            self.bytes_of[i] = p.replace(SPACE, " ").encode()
        for b, i in self.byte_id.items():
            self.bytes_of[i] = bytes([b])
        if self.unknown >= 0:
            self.bytes_of[self.unknown] = " ⁇ ".encode()
        self.automaton = ahocorasick.Automaton()
        for i, p in self.names.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.parts = re.compile(self._boundaries())
        self.beside: dict[int, bool] = {}
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _boundaries(self) -> str:
        pairs = {(a, b) for p in self.names.values() for a, b in zip(p, p[1:])}
        if any(b == SPACE and a != SPACE for a, b in pairs):
            return r"(?s:.+)"  # pieces reach over spaces: no cut is safe
        marks = "".join(m for m in ".,!?;:" if not any(b == m and a.isalpha() for a, b in pairs))
        line = "" if "\n" in self.alphabet else "\n"
        ends = f"[{marks}{SPACE}{line}]|\\Z"
        return rf"{SPACE}*[^\W\d_]+(?={ends})|{SPACE}*[^{SPACE}{line}]+|{SPACE}+" + ("|\n" if line else "")

    def merged(self, text: str) -> list[int]:
        """The ids that merging pairs by score leaves, by its definition."""
        symbols = list(text)
        while len(symbols) > 1:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                i = self.id_of.get(symbols[k] + symbols[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if best is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return [self.id_of.get(s, -1) for s in symbols]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging leaves the two pieces side by side; ``left`` -1 is the start."""
        key = left << 32 | right
        if (known := self.beside.get(key)) is None:
            if len(self.beside) >= PAIRS:
                self.beside.clear()
            pair = [right] if left < 0 else [left, right]
            known = self.beside[key] = self.merged("".join(self.names[i] for i in pair)) == pair
        return known

    def _path(self, text: str) -> list[int]:
        """The best path over ``text``, whose characters all have pieces."""
        n, never = len(text), float("-inf")
        best, last, start = [never] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        score, one = self.score, self.kind == "bpe"
        beside, may_follow = self.beside, self.may_follow
        for end, (piece, size) in self.automaton.iter(text):
            end += 1
            at = end - size
            so_far = best[at]
            # no second path of a BPE model has a finite score
            if so_far == never or one and best[end] != never:
                continue
            if one:
                known = beside.get(last[at] << 32 | piece)
                if known is None:
                    known = may_follow(last[at], piece)
                if not known:
                    continue
            so_far += score[piece]
            if so_far > best[end]:
                best[end], last[end], start[end] = so_far, piece, at
        out = []
        while n:
            if last[n] < 0:
                raise ValueError(f"no path to position {n} of {text!r}")
            out.append(last[n])
            n = start[n]
        return out[::-1]

    def _part(self, part: str) -> list[int]:
        if self.alphabet.issuperset(part):
            return self._path(part)
        out, known = [], ""
        for c in part + "\0":
            if c in self.alphabet:
                known += c
                continue
            out += self._path(known) if known else []
            known = ""
            out += [self.byte_id[b] for b in c.encode("utf-8", "replace")] if self.byte_id else [self.unknown]
        return out[: -1]

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text."""
        if not text:
            return np.zeros(0, np.int32)
        out = []
        for part in self.parts.findall((SPACE if self.space else "") + text.replace(" ", SPACE)):
            ids = self.new.get(part)
            if ids is None:
                ids = self.old.get(part)
                if ids is None:
                    ids = array("i", self._part(part)).tobytes()
                if len(part) <= CACHED:
                    if len(self.new) >= CACHE:
                        self.old, self.new = self.new, {}
                    self.new[part] = ids
            out.append(ids)
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space that encoding puts first goes."""
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text.removeprefix(" ") if self.space else text


@lru_cache(2)
def pieces(path: str) -> Pieces:
    """Loaded once in each Python worker."""
    return Pieces(path)


def _add(df: DataFrame, of: str, columns: dict[str, str], f) -> DataFrame:
    """``df`` with more columns, of names and types; ``f`` makes a row's values, in their order, from the Python value of column ``of``."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    small_batches(df.sparkSession)
    fields = [StructType.fromDDL(f"x {kind}")["x"].dataType for kind in columns.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            made = [f(x.as_py()) for x in batch.column("value")]  # one row's Python values at a time
            added = [pa.array([m[k] for m in made], to_arrow_type(t)) for k, t in enumerate(fields)]
            kept = [(c.name, v) for c, v in zip(row.type, row.flatten()) if c.name not in columns]
            yield pa.RecordBatch.from_arrays([*[v for _, v in kept], *added], [*[k for k, _ in kept], *columns])

    schema = StructType([f for f in df.schema.fields if f.name not in columns])
    for name, t in zip(columns, fields):
        schema = schema.add(name, t)
    return df.select(whole(df).alias("row"), F.col(of).alias("value")).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, name: str = "token_ids") -> DataFrame:
    """``docs`` with the ids of ``text`` in column ``name``, last; one of that name is replaced."""
    return _add(docs, "text", {name: "array<int>"}, lambda text: (pieces(path).encode(text or ""),))


def decode(ids: DataFrame, path: str, of: str = "token_ids", name: str = "decoded") -> DataFrame:
    """``ids`` with the text of column ``of`` in column ``name``, last; one of that name is replaced."""
    return _add(ids, of, {name: "string"}, lambda x: (None if x is None else pieces(path).decode(x),))


def encode_and_decode(docs: DataFrame, path: str, name: str = "token_ids", same: str = "round_trip") -> DataFrame:
    """``docs`` with the ids of ``text``, and whether they decode to it (null: to the empty text), in two last columns; both ways in one Python worker."""

    def both(text: str | None) -> tuple[np.ndarray, bool]:
        ids = pieces(path).encode(text or "")
        return ids, pieces(path).decode(ids.tolist()) == (text or "")

    return _add(docs, "text", {name: "array<int>", same: "boolean"}, both)


def op9_sentencepiece(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Per document: tokens, the digest of its ids, and the digest of the text that they decode to."""
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            n, digests, decoded, same = [], [], [], []
            for text in batch.column("text").to_pylist():
                ids = model.encode(text)
                back = model.decode(ids.tolist())
                n.append(len(ids))
                digests.append(hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest())
                decoded.append(hashlib.sha256(back.encode()).hexdigest())
                same.append(back == text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])

    rows = texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")


QUERIES = {"op9_sentencepiece": op9_sentencepiece}
SQL: dict[str, str] = {}
