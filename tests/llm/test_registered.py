"""The registered queries themselves, over whole small tables, against SQL or brute force."""

from __future__ import annotations

import hashlib
import random
import re

import duckdb
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from lodestrand.llm import quality_rules, registry, secrets, sentencepieces
from tests.llm.test_near_copies import grouped
from tests.llm.test_operators import CLASH, SF, base_spans, by_id, chunked, cover, deduped, fingerprint, groups, leaking, lorem, odd_texts


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def rows_of(spark, name, *columns):
    out = registry.queries()[name](spark, SF)
    return out, by_id(out.select(*columns).collect())


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_and_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "labels", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    _, got = rows_of(spark, name, *want.columns)
    assert got == by_id(want.fetchall())


def test_op2(spark, documents):
    out, got = rows_of(spark, "op2_suffix_dedup", "doc_id", "n_bytes", "n_removed", "kept_sha256")
    assert got == by_id((d, n, gone, sha(kept)) for d, n, gone, kept in cover(documents, 100))
    assert dict(out.dtypes) == {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}
    assert out.where("(n_spans = 0) <> (n_removed = 0)").count() == 0


def test_op5(spark, documents):
    out, got = rows_of(spark, "op5_secrets", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    want, spans = [], {}
    for d, text in documents:
        base = base_spans(text or "")
        joined = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base)
        want.append((d, *(sum(k == i for _, k, _ in base) for i in range(3)), sha(joined)))
        spans[d] = joined.split(",") if joined else []
    assert got == by_id(want)
    for r in out.collect():
        all_of = r.spans.split(",") if r.spans else []
        assert [x for x in all_of if not x.startswith("crf:")] == spans[r.doc_id]
        assert all(re.fullmatch(r"crf:\d+:\d+", x) for x in all_of if x.startswith("crf:"))


def test_op6(spark, documents):
    fps = [fingerprint(t) for _, t in documents]
    least = {}
    for (d, _), g in zip(documents, groups(fps)):
        least[g] = min(d, least.get(g, d))
    want = by_id((d, f"{f:016x}", least[g]) for (d, _), f, g in zip(documents, fps, groups(fps)))
    assert rows_of(spark, "op6_simhash", "doc_id", "fingerprint", "component_id")[1] == want


def test_op8(spark, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = {}
    for d, i in leaking(documents, items):
        found.setdefault(d, set()).add(i)
    want = by_id((d, d in found, ",".join(map(str, sorted(found.get(d, ()))))) for d, _ in documents)
    assert rows_of(spark, "op8_decontaminate", "doc_id", "contaminated", "item_ids")[1] == want


def test_op9(spark, documents):
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_model())
    want = []
    for d, t in documents:
        ids = library.encode(t or "")
        want.append((d, len(ids), sha(b"".join(i.to_bytes(4, "little") for i in ids)), sha(t or ""), True))
    assert rows_of(spark, "op9_sentencepiece", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip")[1] == by_id(want)


def test_op10(spark, documents):
    want = by_id((d, n, again, sha(kept)) for d, n, again, kept in chunked(documents))
    assert rows_of(spark, "op10_chunk_dedup", "doc_id", "n_chunks", "n_repeated", "kept_sha256")[1] == want


def test_op1(spark, documents):
    out, got = rows_of(spark, "op1_quality_bayes", "doc_id")
    assert got == by_id((d,) for d, _ in documents)
    assert out.where("quality IS NULL OR toxic IS NULL OR kept <> (quality >= 0.5 AND toxic < 0.2) AND abs(quality - 0.5) > 1e-4 AND abs(toxic - 0.2) > 1e-4").count() == 0


def after_stages(docs, items):
    """Texts by id that the first four stages keep, by brute force; ``docs`` passed the quality rules."""
    docs = [(r[0], r[3]) for r in deduped(docs)]
    first = {}
    for (d, _), g in zip(docs, grouped(docs)):
        first[g] = min(d, first.get(g, d))
    kept = set(first.values())
    dirty = {d for d, _ in leaking(docs, items)}
    return {d: t for d, t in docs if d in kept and d not in dirty}


def test_pipeline(spark, documents):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    passed = {r[0] for r in con.sql(quality_rules.SQL["op7_quality_rules"]).fetchall() if r[7]}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = after_stages([(d, t) for d, t in documents if d in passed], items)
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_model())
    got = {r.doc_id: (r.n_tokens, list(r.token_ids), r.round_trip) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {d: (len(ids), ids, True) for d, t in want.items() for ids in [library.encode(t)]}


def test_odd_rows_through_the_pipeline(spark, tmp_path):
    """Null texts and ids, repeated rows, clashing columns and one long text, and then no rows at all."""
    r = random.Random(8)
    rows = odd_texts() + [(500, lorem(r, 60_000)), (501, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({k: F.lit(v) for k, v in CLASH.items()} | {"n_chars": F.length("text").cast("long")})
    for name, table in (("some", docs), ("none", docs.limit(0))):
        folder = f"file://{tmp_path}/{name}"
        table.write.parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
        out = corpus_pipeline.run(spark, folder).collect()
        ids = [x.doc_id for x in out]
        assert all(x.round_trip for x in out) and len(ids) == len(set(ids))
        assert (500 in ids) == (name == "some") and not {3, 4, 41, 501} & set(ids)
