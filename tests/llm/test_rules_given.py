"""Rules timed beside metrics that are columns: the same rules, the same verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrand.llm import quality_rules as q
from lodestrand.llm.shared import texts


def test_given_metrics_change_no_verdict(spark):
    rows = [(1, "word " * 40), (2, None), (3, "a!! " * 30), (4, " ".join(f"w{i}" for i in range(50))), (5, "same line of words here\n" * 30), (5, " ".join(f"w{i}" for i in range(50))), (None, "# " * 99)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rules = q.ordered_rules(docs, given=q.REPORTED)
    assert {r.name for r in rules} == {r.name for r in q.RULES} and len(rules) == len(q.RULES)
    base = q.with_metrics(texts(docs), q.REPORTED)
    verdict = lambda df, *more: sorted((r.doc_id or 0, r.kept) for r in df.select("doc_id", q.cascade(df, rules, *more).isNull().alias("kept")).collect())
    assert verdict(base, set(q.REPORTED)) == verdict(texts(docs)) == [(0, False), (1, False), (2, False), (3, False), (4, True), (5, False), (5, True)]


def test_an_empty_table_keeps_the_given_order(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert q.ordered_rules(docs, given=q.REPORTED) == list(q.RULES)
    assert q.with_metrics(texts(docs), q.REPORTED).where(F.col("n_words") > 0).isEmpty()
