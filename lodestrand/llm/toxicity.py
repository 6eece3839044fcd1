"""Toxicity by a lexicon: Levenshtein automata run through a trie find terms and their misspellings, and the words around them decide.

**Lexicon.** On at most ``FIT_ROWS`` labelled rows, one of each group of near copies, whole words and word beginnings
(stems) are counted by label in grouped sums. A term is one whose share of toxic documents is beyond chance by ``LEAST_EVIDENCE``
nats; a beginning that nearly always goes on the same way gives way to what it goes on to.

**Misspellings.** Terms lie in one trie. A token's Levenshtein automaton (bit-parallel, one mask for each number of edits)
is run along the trie's edges and a branch is left when no state lives. Terms of five letters bear one edit, of nine two; figures
and signs that stand for letters are read as these. Only a token that has a term's piece where an edit could have left it is run at all
(of k + 1 pieces one stays whole under k edits), so nothing is missed. Words that occur in non-toxic rows are no misspellings.

**Context.** Each hit is weighed by the words within ``WINDOW`` tokens: quotation marks around it and words of reporting speak for a quotation,
address for abuse, and words whose share of toxic hits is beyond chance for what the labelled rows show. A document's score is a
logistic function, fitted on the same rows, of the sum over its distinct terms of weight x likeness x context.

Nulls and edges: a null or empty text has no hits and the score of such rows; a null doc_id has no label and is not held
out; several labels of one id count as toxic if one is; repeated rows are scored alike; without labelled rows of both kinds there
are no terms and the score is the share of toxic rows; an empty table gives none; texts are read whole, and other columns, whatever their names, never.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import cut, free, texts

#: Labelled rows to fit on, terms and neighbouring words to keep: they bound the model, not the input.
FIT_ROWS, MAX_TERMS, MAX_CUES = 12_000, 2000, 2000
#: Nats by which a count must exceed chance.
LEAST_EVIDENCE = 14.0
WINDOW = 4
PREDICT_AT = 0.7
#: Counters and caches of a worker are emptied at so many entries.
HELD = 300_000
# Likeness of a hit by edits; what signs stand for; words of reporting and of address.
LIKENESS = (1.0, 0.45, 0.35)
SIGNS = str.maketrans("013457@$!", "oieastasi")
REPORTING = frozenset("said says say wrote writes called calls quoted quote quotes term terms word words phrase slur insult insults means definition".split())
ADDRESS = frozenset("you your youre ur yourself du dich tu te toi vous tú usted".split())
#: Log odds that a hit is meant: of none of these, of quotation marks, of reporting, of address.
MEANT, QUOTED, REPORTED, ADDRESSED = 2.0, -3.0, -1.5, 1.0
_TOKEN = re.compile(r"[^\W_]+(?:[@$!][^\W_]+)*")
_QUOTES = "\"“”„«»'‘’"


def _plain(token: str) -> str:
    """A lower-case token with signs read as letters, if it has letters at all."""
    return token if token.isalpha() else token.translate(SIGNS) if any(c.isalpha() for c in token) else ""


def edits_for(length: int) -> int:
    return 0 if length < 5 else 1 if length < 9 else 2


class Lexicon:
    """A trie of terms: words that a token must be, and stems that it must begin with."""

    def __init__(self, terms: dict[str, tuple[float, bool]]):
        self.terms, self.root = terms, {}
        self.pieces: dict[tuple[int, int], set[str]] = {}
        self.stems = {t for t, (_, stem) in terms.items() if stem}
        self.stem_lengths = sorted({len(t) for t in self.stems})
        for term, (_, stem) in terms.items():
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = term
            # stems end anywhere, so one edit asks for more letters
            k = edits_for(len(term) - stem)
            cuts = [len(term) * j // (k + 1) for j in range(k + 2)] if k else []
            for a, b in zip(cuts, cuts[1:]):
                for shift in range(-k, k + 1):
                    if a + shift >= 0:
                        self.pieces.setdefault((a + shift, b - a), set()).add(term[a:b])

    def exact(self, token: str) -> str | None:
        held = self.terms.get(token)
        if held and not held[1]:
            return token
        return next((token[:n] for n in self.stem_lengths if token[:n] in self.stems), None)

    def near(self, token: str) -> tuple[str, int] | None:
        """The term with the fewest edits to the token, ties by spelling; the token's automaton intersected with the trie."""
        if not any(token[a : a + n] in held for (a, n), held in self.pieces.items()):
            return None
        m = len(token)
        masks: dict[str, int] = {}
        for i, c in enumerate(token):
            masks[c] = masks.get(c, 0) | 1 << i
        most, full, best = edits_for(m + 2), 1 << m, None
        # bit i of states[e]: i letters of the token are read with e edits
        start = tuple((1 << (e + 1)) - 1 for e in range(most + 1))
        todo = [(self.root, start)]
        while todo:
            node, states = todo.pop()
            term = node.get("")
            if term is not None:
                stem = self.terms[term][1]
                for e in range(edits_for(len(term) - stem) + 1):
                    if e < len(states) and (states[e] if stem else states[e] & full):
                        best = min(best or (9, ""), (e, term))
                        break
            for c, below in node.items():
                if c == "":
                    continue
                mask, after, last = masks.get(c, 0), [], 0
                for e, s in enumerate(states):
                    step = (s & mask) << 1
                    if e:
                        # a letter too many in the term, another letter, a letter too many in the token
                        step |= states[e - 1] | states[e - 1] << 1 | last << 1
                    last = step & (full << 1) - 1
                    after.append(last)
                if any(after):
                    todo.append((below, tuple(after)))
        return (best[1], best[0]) if best else None


@dataclass
class Model:
    """What is fitted; small, and sent to the tasks that score."""

    terms: dict[str, tuple[float, bool]] = field(default_factory=dict)
    benign: frozenset[str] = frozenset()
    cues: dict[str, float] = field(default_factory=dict)
    offset: float = 0.0
    slope: float = 0.0

    def lexicon(self) -> Finder:
        return Finder(self)


class Finder:
    """Hits of a model's terms in texts, with a bounded cache of tokens."""

    def __init__(self, model: Model):
        self.model, self.trie, self.cache = model, Lexicon(model.terms), {}

    def of(self, token: str) -> tuple[str, int] | None:
        """(term, edits) of a token."""
        if token in self.cache:
            return self.cache[token]
        if len(self.cache) >= HELD:
            self.cache.clear()
        plain = _plain(token)
        exact = self.trie.exact(plain) if plain else None
        found = (exact, 0) if exact else None
        if not found and plain and plain not in self.model.benign and len(plain) >= 4:
            found = self.trie.near(plain)
        self.cache[token] = found
        return found

    def hits(self, text: str) -> list[tuple[str, int, str, list[str]]]:
        """(term, edits, token, neighbours) of each hit; quotation marks and address stand among the neighbours as cues in brackets."""
        low = text.lower()
        if not any(self.of(t) for t in set(_TOKEN.findall(low))):
            return []
        found = list(_TOKEN.finditer(low))
        out = []
        for k, m in enumerate(found):
            hit = self.of(m[0])
            if not hit:
                continue
            a, b = max(0, k - WINDOW), k + WINDOW + 1
            around = [x[0] for x in found[a:k] + found[k + 1 : b]]
            before, after = low[found[a].start() : m.start()], low[m.end() : found[min(b, len(found)) - 1].end() + 1]
            if _opens(before) and any(q in after for q in _QUOTES):
                around.append("[quoted]")
            around += ["[reported]"] * bool(REPORTING & set(around)) + ["[addressed]"] * bool(ADDRESS & set(around))
            out.append((*hit, m[0], around))
        return out

    def evidence(self, text: str) -> float:
        """Sum over distinct terms of the best hit's weight x likeness x context."""
        cues, best = self.model.cues, {}
        for term, edits, _, around in self.hits(text):
            odds = MEANT + QUOTED * ("[quoted]" in around) + REPORTED * ("[reported]" in around) + ADDRESSED * ("[addressed]" in around) + sum(cues.get(c, 0.0) for c in set(around))
            value = self.model.terms[term][0] * LIKENESS[edits] * _sigmoid(odds) / _sigmoid(MEANT)
            best[term] = max(value, best.get(term, 0.0))
        return sum(best.values())


def _opens(before: str) -> bool:
    """Whether a quotation is open after ``before``: a mark stands at a word's beginning and none at a word's end after it."""
    for k in range(len(before) - 1, -1, -1):
        if before[k] in _QUOTES:
            inner = k and before[k - 1].isalnum()
            if inner and k + 1 < len(before) and before[k + 1].isalnum():
                continue  # an apostrophe
            return not inner
    return False


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-min(30.0, max(-30.0, x))))


def _signatures(text: str) -> tuple[int, int, int]:
    """Least hashes of the text's five-word shingles; near copies share most."""
    ws = text.lower().split()
    grams = {" ".join(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))}
    return tuple(min(xxhash.xxh64_intdigest(g, seed) for g in grams) >> 1 for seed in (1, 2, 3))


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, y) of at most ``rows`` labelled documents that are not held out, one of each group of near copies; written."""
    marks = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("y"))
    marks = F.broadcast(marks.where(~is_held_out(F.col("label_id"))).orderBy(F.xxhash64("label_id"), "label_id").limit(rows))
    held = texts(docs).join(marks, F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_signatures(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([x[k] for x in found], pa.int64()) for k in range(3))], ["doc_id", "text", "y", "s0", "s1", "s2"])

    held = cut(held.mapInArrow(run, "doc_id long, text string, y int, s0 long, s1 long, s2 long"), "toxicity-rows")
    kept = held.select("doc_id", "s0", "s1", "s2", F.xxhash64("text").alias("h"))
    for k in range(3):
        kept = kept.withColumn("_first", F.row_number().over(W.partitionBy(f"s{k}").orderBy("doc_id", "h"))).where("_first = 1").drop("_first")
    out = cut(held.join(kept.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")), (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_h")), "left_semi").select("text", "y"), "toxicity-sample")
    free(held)
    return out


def _forms(text: str) -> set[str]:
    """Whole words (with an end mark) and beginnings of a text."""
    out = set()
    for token in set(_TOKEN.findall(text.lower())):
        w = _plain(token)
        if 3 <= len(w) <= 24:
            out.add(w + "$")
            out.update(w[:n] for n in range(3, min(9, len(w) + 1)))
    return out


def _counted(sample: DataFrame, forms) -> DataFrame:
    """(form, c1, c0): toxic and other rows with a form; ``forms`` gives a text's distinct ones. Tasks add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())

        def flush():
            keys = list(counts[0].keys() | counts[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())], ["form", "c1", "c0"])
            counts[0].clear(), counts[1].clear()
            return out

        of = forms()
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                counts[y].update(of(text))
                if len(counts[0]) + len(counts[1]) > HELD:
                    yield flush()
        yield flush()

    return sample.mapInArrow(run, "form string, c1 long, c0 long").groupBy("form").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"))


def _evidence(c1: Column, c0: Column, share: float) -> Column:
    """Nats by which c1 of c1 + c0 differs from ``share``."""
    n = c1 + c0
    p = c1 / n
    part = lambda q, r: F.when(q > 0, q * F.log(q / r)).otherwise(F.lit(0.0))
    return n * (part(p, F.lit(max(share, 1e-9))) + part(1 - p, F.lit(max(1 - share, 1e-9))))


def _nats(c1: int, c0: int, share: float) -> float:
    """What ``_evidence`` says of two counts, zero where toxic rows aren't more than chance."""
    p = c1 / max(1, c1 + c0)
    return (c1 + c0) * sum(q * math.log(q / r) for q, r in ((p, share), (1 - p, 1 - share)) if q > 0) if p > share else 0.0


def _chosen(rows: list[tuple[str, int, int]], n1: int, n0: int) -> dict[str, tuple[float, bool]]:
    """Terms of candidate forms, the strongest first: a beginning that goes on one way goes, one that without its strongest term is no more than chance, and what a chosen stem begins."""
    onward: dict[str, int] = {}
    for f, c1, _ in rows:
        for n in range(3, len(f)):
            onward[f[:n]] = max(onward.get(f[:n], 0), c1)
    terms: dict[str, tuple[float, bool]] = {}
    under: dict[str, tuple[int, int]] = {}
    for form, c1, c0 in rows:
        word = form.removesuffix("$")
        stem = word == form
        of1, of0 = under.get(form, (0, 0))
        if stem and (onward.get(form, 0) >= 0.95 * c1 or of1 and _nats(c1 - of1, c0 - of0, n1 / (n1 + n0)) < LEAST_EVIDENCE) or any(word[:n] in terms and terms[word[:n]][1] for n in range(3, len(word) + 1)):
            continue
        for n in range(3, len(form)):
            under[form[:n]] = max(under.get(form[:n], (0, 0)), (c1, c0))
        if len(terms) < MAX_TERMS and word not in terms:
            terms[word] = (math.log((c1 + 0.5) / (n1 + 1)) - math.log((c0 + 0.5) / (n0 + 1)), stem)
    return terms


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """The model of at most ``rows`` labelled documents that aren't held out; the driver sees its bounded tables only."""
    sample = labelled(docs, labels, rows)
    sums = sample.agg(F.coalesce(F.sum("y"), F.lit(0)).alias("n1"), F.count("*").alias("n")).first()
    n1, n0 = sums["n1"], sums["n"] - sums["n1"]
    model = Model(offset=math.log((n1 + 0.5) / (n0 + 0.5)))
    if not n1 or not n0:
        return model
    share = n1 / (n1 + n0)
    counts = _counted(sample, lambda: _forms).where((F.col("c1") > share * (F.col("c1") + F.col("c0"))) & (2 * F.col("c1") >= F.col("c1") + F.col("c0")))
    strong = counts.withColumn("e", _evidence(F.col("c1"), F.col("c0"), share)).where(F.col("e") >= LEAST_EVIDENCE)
    # shorter forms come before what goes on from them, so a stem covers its words
    found = strong.orderBy(F.desc("e"), F.length("form"), "form").limit(20 * MAX_TERMS).collect()
    model.terms = _chosen([(r["form"], r["c1"], r["c0"]) for r in found], n1, n0)

    def finder():
        return Finder(model)

    def fuzzy():
        held = finder()
        return lambda text: {_plain(token) for _, edits, token, _ in held.hits(text) if edits}

    benign = _counted(sample, fuzzy).where(f"c0 >= 1 AND c1 <= {8 * share} * c0").orderBy(F.desc("c0"), "form").limit(20 * MAX_TERMS).collect()
    model.benign = frozenset(r["form"] for r in benign)

    def neighbours():
        held = finder()
        return lambda text: {c for *_, around in held.hits(text) for c in ["", *around]}

    cues = cut(_counted(sample, neighbours), "toxicity-cues")
    total = cues.where("form = ''").first()  # rows with a hit
    if total and total["c1"] and total["c0"]:
        odds = F.log((F.col("c1") + 1) / (total["c1"] + 2)) - F.log((F.col("c0") + 1) / (total["c0"] + 2))
        strong = cues.where("form <> ''").where(_evidence(F.col("c1"), F.col("c0"), total["c1"] / (total["c1"] + total["c0"])) >= LEAST_EVIDENCE)
        model.cues = {r["form"]: r["w"] for r in strong.select("form", odds.alias("w")).orderBy(F.desc(F.abs(odds)), "form").limit(MAX_CUES).collect()}
    points = sorted((r["evidence"], r["y"]) for r in _with_evidence(sample, model, ["y"]).select("evidence", "y").collect())
    model.offset, model.slope = _calibrated(np.array([x for x, _ in points]), np.array([y for _, y in points], float))
    free(sample, cues)
    return model


def _calibrated(x: np.ndarray, y: np.ndarray, decay: float = 0.5, rounds: int = 50) -> tuple[float, float]:
    """Offset and slope of a logistic function by Newton's steps; a decay keeps separable rows finite."""
    w = np.array([math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), 0.0])
    z = np.stack([np.ones_like(x), x], 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) + decay * w
        h = (z * (p * (1 - p))[:, None]).T @ z + decay * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), max(0.0, float(w[1]))


def _with_evidence(rows: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """(*keep, evidence) of rows with a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Finder(model)
        for batch in batches:
            found = [held.evidence(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(found, pa.float64())], [*keep, "evidence"])

    kinds = dict(rows.dtypes)
    return rows.select(*keep, "text").mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keep) + ", evidence double")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    rows = _with_evidence(texts(docs), model, ["doc_id"])
    x = F.lit(model.offset) + F.lit(model.slope) * F.col("evidence")
    value = F.round(1 / (1 + F.exp(-F.least(F.greatest(x, F.lit(-30.0)), F.lit(30.0)))), 6)
    out = rows.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), value.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= PREDICT_AT).cast("int"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, by a model of the labelled rows that aren't held out."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, fit(docs, labels))


QUERIES = {"op13_toxicity": op13_toxicity}
SQL: dict[str, str] = {}
