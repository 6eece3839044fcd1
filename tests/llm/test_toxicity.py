"""Toxicity: the automaton against plain edit distance, held-out rows, misspellings, quotations and odd tables."""

from __future__ import annotations

import random
import zlib

from pyspark.sql import functions as F

from lodestrand.llm import registry, toxicity
from tests.llm.test_operators import SF


def distance(a, b):
    """Edit distance of ``a`` to ``b`` for each beginning of ``b``, by the textbook."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(now[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = now
    return row


def plainly(terms, token):
    best = None
    for term, (_, stem) in terms.items():
        row = distance(term, token)
        d = min(row) if stem else row[-1]
        if d <= toxicity.edits_for(len(term) - stem):
            best = min(best or (9, ""), (d, term))
    return (best[1], best[0]) if best else None


def test_automaton_and_trie_equal_edit_distance():
    r = random.Random(13)
    word = lambda n: "".join(r.choice("abc") for _ in range(n))
    for _ in range(60):
        terms = {word(r.randint(3, 12)): (1.0, r.random() < 0.3) for _ in range(6)}
        trie = toxicity.Lexicon(terms)
        for _ in range(60):
            base = list(r.choice(list(terms)) + word(r.randint(0, 2)))
            for _ in range(r.randint(0, 3)):
                at = r.randrange(len(base) + 1)
                base[at : at + r.randint(0, 1)] = word(r.randint(0, 1))
            token = "".join(base) or "a"
            want = plainly(terms, token)
            if want and want[1] == 0:
                assert trie.exact(token)
            else:
                assert trie.exact(token) is None and trie.near(token) == want, (terms, token)


def rows_for(r, n, start=0):
    """Prose of made-up words; an eighth of it abuses, some of the rest quotes the same words."""
    word = lambda: "".join(r.choice(["ba", "do", "ki", "lu", "me", "no", "ra", "si"]) for _ in range(r.randint(1, 4)))
    docs, labels = [], []
    for d in range(start, start + n):
        ws = [word() for _ in range(r.randint(40, 90))]
        kind = r.choice(["toxic", "toxic", "quotes", *["plain"] * 13])
        ws.insert(5, "you")
        for _ in range(3 if kind != "plain" else 0):
            term = r.choice(["zgrofle", "wumpfink", "quexling"])
            ws.insert(r.randrange(len(ws)), f'she said "{term}"' if kind == "quotes" else f"you {term}")
        docs.append((d, " ".join(ws)))
        labels.append((d, int(kind == "toxic")))
    return docs, labels


def test_misspellings_and_quotations(spark):
    r = random.Random(5)
    docs, labels = rows_for(r, 2500)
    extra = [(-1, "bado you zgrofel and you wumpfnk kilu"), (-2, "bado kilu me nosi"), (-3, 'bado she said "zgrofle" and he wrote "wumpfink" of kilu'), (-4, None), (-5, ""), (-6, "you zgr0fle you qu3xling"), (-7, "kilu " * 200_000 + "you zgrofle you quexling")]
    frame = spark.createDataFrame(docs + extra + docs[:3] + [(None, "you zgrofle")], "doc_id long, text string").withColumns({"score": F.lit(0), "y": F.lit(1), "label_id": F.lit(2)})
    marks = spark.createDataFrame(labels + labels[:2] + [(None, 1)], "doc_id long, toxic int").withColumn("text", F.lit("x"))
    model = toxicity.fit(frame, marks)
    assert set(model.terms) == {"zgrofle", "wumpfink", "quexling"} and model.slope > 0
    out = toxicity.score(frame, model).collect()
    assert len(out) == len(docs) + len(extra) + 4
    got = {x.doc_id: x for x in out}
    for d, x in got.items():
        assert x.held_out == (d is not None and zlib.crc32(str(d).encode()) % 3 == 1)
        assert 0 <= x.score <= 1 and x.predicted == (x.score >= 0.7)
    assert got[-1].score > max(got[-2].score, got[-3].score) and got[-6].score > got[-3].score
    assert got[-7].predicted == 1 and got[-2].score == got[-4].score == got[-5].score
    held = [(got[d].predicted, y) for d, y in labels if got[d].held_out]
    assert sum(p == y for p, y in held) >= 0.98 * len(held)


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [x.predicted for x in toxicity.score(docs, toxicity.fit(docs, none)).collect()] == [0, 0]
    one = spark.createDataFrame([(2, 1)], "doc_id long, toxic int")
    assert len(toxicity.score(docs, toxicity.fit(docs, one)).collect()) == 2
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), none)).count() == 0


def test_registered_query(spark):
    """Held-out rows in English, in which the smallest table has examples enough to learn from."""
    out = registry.queries()["op13_toxicity"](spark, SF.replace("0.001", "0.01"))
    d = SF.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    assert out.select("doc_id").distinct().count() == docs.count()
    assert out.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = out.where("held_out").join(labels.select("doc_id", "toxic"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id").where("lang = 'en'").collect()
    toxic = [x.predicted for x in rows if x.toxic]
    assert sum(toxic) >= 0.9 * len(toxic) and not any(x.predicted for x in rows if not x.toxic)
