"""The filter audit against brute force, with texts that only a full comparison tells apart."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from lodestrand.llm import filter_audit


def brute(docs, labels):
    """Rows of the contract; docs are (doc_id, text, lang), labels (doc_id, quality, toxic)."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    bad = {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    fails = {}
    for k, (d, t, lang) in enumerate(docs):
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        of = {"A": len(ws) < 100, "B": 100 * len(set(ws)) < 80 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and least[t] < d}
        fails[k] = {f for f, x in of.items() if x}
    out = set()
    for part in {lang or "" for _, _, lang in docs}:
        mine = [k for k, x in enumerate(docs) if (x[2] or "") == part]
        rows, value = [], Counter()
        for o in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(o, 1):
                gone = [k for k in left if f in fails[k]]
                left = [k for k in left if f not in fails[k]]
                value[f] += len(gone)
                rows.append((part, "".join(o), step, len(left), len(gone), sum(f in fails[k] for k in mine) - len(gone) - sum(f in fails[k] for k in left), sum(fails[k] == {f} for k in mine), sum(docs[k][0] in good for k in gone), sum(docs[k][0] in bad for k in gone)))
        out |= {(*r, value[r[1][r[2] - 1]]) for r in rows}
    return out


def audited(spark, docs, labels):
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("part", F.lit("x")).withColumn("mask", F.lit(9)).withColumn("class", F.lit("y"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit(1))
    rows = filter_audit.audit(filter_audit.mask_counts(frame, marks)).select("part", "filter_order", "step", *filter_audit.MEASURES).collect()
    assert len(rows) == len(set(map(tuple, rows)))
    return set(map(tuple, rows))


def odd_documents():
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdeAB#é𝄞") for _ in range(r.randint(1, 6)))
    long = " ".join(word() for _ in range(30_000))
    texts = [None, "", " ", "A", "a b", long, long[:-1] + "~", long, "\t\x0b x \n"] + [" ".join(word() for _ in range(r.randint(90, 110))) for _ in range(8)]
    docs = [(r.randint(0, 60), r.choice(texts), r.choice(["en", None, "", "de"])) for _ in range(150)] + [(None, "a b", "en"), (None, None, None), (-4, "A", "en"), (7, "A", "en"), (7, "A", "en")]
    labels = [(r.randint(0, 60), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(60)] + [(None, 1, 1)]
    return docs, labels


def test_against_brute_force(spark):
    docs, labels = odd_documents()
    assert audited(spark, docs, labels) == brute(docs, labels)


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_texts_that_no_hash_tells_apart(spark, monkeypatch, most):
    """Blocks that all hash alike: lengths split, then full texts decide."""
    monkeypatch.setattr(filter_audit, "block_hashes", lambda text: [F.lit(0).cast("long")] * (len(filter_audit.BLOCK_ENDS) + 1))
    monkeypatch.setattr(filter_audit, "BROADCAST_CLASSES", most)
    docs, labels = odd_documents()
    docs += [(100 + k, f"same length {k % 3}", "en") for k in range(9)]
    assert audited(spark, docs, labels) == brute(docs, labels)


def test_empty_and_hot(spark):
    assert audited(spark, [], []) == set()
    docs = [(k, "copy of one text", "en") for k in range(4000)] + [(5000 + k, f"w{k}", "en") for k in range(500)]
    assert audited(spark, docs, [(3, 1, 1)]) == brute(docs, [(3, 1, 1)])
