"""The prefix trie of conversations against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lodestrand.llm import conversation_trie


def brute(turns):
    """Nodes of the contract for (conv_id, turn, role, text)."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    by = {}
    for c, n, role, text in turns:
        if c is not None:
            by.setdefault(c, []).append((n is not None, n or 0, role or "", hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest(), text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(rows)] for c, rows in by.items()}
    made = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = tuple(own.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])[:h] + mine[h:])
    nodes = {}
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = []

    def total(p):
        below = [total(k) for k in kids.get(p, [])]
        saved = (len(nodes[p]) - 1) * len(p[-1][1]) if p else 0
        n, s = (sum(x[0] for x in below) or 1), saved + sum(x[1] for x in below)
        ends = ",".join(str(c) for c in sorted(nodes[p]) if len(made[c]) == len(p))
        out.append((min(nodes[p]), len(p), min(nodes[p[:-1]]) if p else None, len(nodes[p]), len(below), n, s, sha(ends)))
        return n, s

    if made:
        total(())
    return sorted(out, key=str)


def built(spark, turns):
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({k: F.lit(1) for k in ("conv", "node", "depth", "key", "len")})
    return sorted(map(tuple, conversation_trie.trie(*conversation_trie.rebuilt(frame)).select(*conversation_trie.NODE).collect()), key=str)


def odd_turns():
    r = random.Random(12)
    turns = []
    for c in [*range(0, 30), *range(95, 110), *range(300, 320), -5, -150, -100, 707]:
        for n in range(r.randint(1, 7)):
            turns.append((c, r.choice([n, n, n, None, 0]), r.choice(["user", "assistant", None, ""]), r.choice([None, "", "x", "𝄞é" * 3, f"{c} own", "hello"])))
    long = "z" * 200_000
    turns += [(401, 0, "user", long), (402, 0, "user", long), (None, 0, "user", "x"), (None, None, None, None)]
    turns += turns[:20]
    same = [(f"turn {n}") for n in range(9)]
    return turns + [(c, n, "user", t) for c in (600, 800, 900, 1000) for n, t in enumerate(same[: 9 - c // 1000])]


def test_against_brute_force(spark):
    turns = odd_turns()
    assert built(spark, turns) == brute(turns)


def test_empty_table(spark):
    assert built(spark, []) == []


@pytest.mark.parametrize("block", [4096, 7])
def test_hot_conversation_and_hot_node(spark, monkeypatch, block):
    """One conversation with a third of all turns, many that are copies, and ids in several blocks."""
    monkeypatch.setattr(conversation_trie, "ID_BLOCK", block)
    turns = [(5, n, "user", f"t{n % 7}") for n in range(600)] + [(100 * k, n, "user", f"c{n}") for k in range(1, 200) for n in range(3)] + [(100 * k + 1, 0, "user", "own") for k in range(1, 150)]
    assert built(spark, turns) == brute(turns)
