"""The near-duplicate stage against brute force."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from lodestrand.llm import near_copies
from tests.llm.test_operators import CLASH, lorem, odd_texts
from pyspark.sql import functions as F


def grouped(rows):
    def of(text):
        w = (text or "").lower().split()
        k = min(5, len(w))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()

    sets, group = [of(t) for _, t in rows], list(range(len(rows)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 5 * len(x & y) >= 4 * len(x | y):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    return group


def test_stage_keeps_one_of_each_group_of_near_copies(spark, monkeypatch):
    r = random.Random(11)
    rows = odd_texts()
    for k in range(100, 140, 2):
        words = lorem(r, r.randint(20, 300)).split()
        copy = words.copy()
        for at in r.sample(range(len(copy)), max(1, len(copy) // r.choice([40, 60, 90]))):
            copy[at] = "other"
        rows += [(k, " ".join(words)), (k + 1, " ".join(copy))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({k: F.lit(v) for k, v in CLASH.items()})
    group = grouped(rows)
    first = {}
    for (d, _), g in zip(rows, group):
        first[g] = min((d is None, d), first.get(g, (True, 1 << 60)), key=lambda v: (v[0], v[1] or 0))
    assert len(first) <= len(set(range(len(rows)))) - 10
    for hot, cell in ((32, 4096), (1, 3)):
        monkeypatch.setattr(near_copies, "HOT", hot)
        monkeypatch.setattr(near_copies, "CELL", cell)
        monkeypatch.setattr(near_copies, "SAMPLE", 16 if hot > 1 else 1)
        kept = corpus_pipeline.near_duplicates(spark, docs, "")
        assert kept.columns == docs.columns
        assert sorted((x.doc_id is None, x.doc_id) for x in kept.collect()) == sorted(first.values())


def test_near_copies_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_copies.representatives(docs).count() == 0


def test_shared_elements_over_batches():
    items = [1, 2, 2, 2, 3, 4, 4, 5, 5, 5, 5, 6]
    want = [(x, items.index(x)) for x in items if items.count(x) > 1]
    for size in (1, 2, 3, 5, 12):
        table = pa.table({"item": pa.array(items, pa.int64()), "fp": pa.array(range(12), pa.int64()), "n": pa.array([9] * 12, pa.int32()), "at": pa.array([0] * 12, pa.int32())})
        got = pa.Table.from_batches(near_copies._shared(iter(table.to_batches(max_chunksize=size))))
        assert list(zip(got["item"].to_pylist(), got["lead"].to_pylist())) == want


def test_pivots_lose_no_pair():
    r = np.random.default_rng(3)
    base = np.unique(r.integers(-(2**62), 2**62, 90))
    sets = [np.unique(np.r_[r.choice(base, r.integers(60, 91), replace=False), r.integers(-(2**62), 2**62, r.integers(0, 9))]) for _ in range(60)]
    rows = {"item": np.zeros(60, np.int64), "cell": np.full(60, -1), "block": np.zeros(60, np.int64), "fp": np.arange(60), "n": np.array([len(x) for x in sets]), "at": np.zeros(60, np.int64), "comp": np.arange(60), "major": np.r_[1, np.zeros(59, int)]}
    rows["bits"] = np.stack([near_copies.fingerprint(x) for x in sets]).view(np.uint64)
    got = near_copies._survivors(rows)
    got = set(zip(got.column("a").to_pylist(), got.column("b").to_pylist()))
    want = {(a, b) for b in range(60) for a in range(b) if 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))}
    assert want and want <= got and len(got) < 60 * 59 // 2


def test_templates_cost_one_comparison_a_page(spark, monkeypatch):
    """Pages that differ in a word are linked to their leaders; what is tested beyond doesn't grow with their pairs."""
    r = random.Random(21)
    base, other = lorem(r, 300).split(), lorem(r, 280).split()
    rows = []
    for k in range(1200):
        words = (base if k % 4 else other).copy()
        words[r.randrange(len(words))] = f"page{k}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tested, of = [], near_copies.candidates

    def counted(*given):
        found = of(*given)
        tested.append(found.count())
        return found

    monkeypatch.setattr(near_copies, "candidates", counted)
    kept = sorted(x.doc_id for x in near_copies.representatives(docs).collect())
    assert kept == [0, 1]
    assert len(tested) == 1 and tested[0] < len(rows)
