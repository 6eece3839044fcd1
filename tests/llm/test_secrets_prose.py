"""What the field adds to prose: nothing to the tables' own, and most secrets planted in it."""

from __future__ import annotations

import duckdb
import pytest

from lodestrand.llm import secrets
from tests.llm.test_operators import SF


@pytest.fixture(scope="module")
def prose():
    return [r[0] or "" for r in duckdb.sql(f"SELECT text FROM '{SF.replace('0.001', '0.01')}/documents.parquet' ORDER BY doc_id").fetchall()]


def beside_patterns(text, spans):
    base = secrets.base_spans(text)
    return [x for x in spans if not any(a < x[1] and x[0] < b for a, _, b in base)]


def test_prose_of_the_tables_stays_untouched(prose):
    found = secrets.field_spans(prose, secrets.trained_field())
    assert sum(len(beside_patterns(t, s)) for t, s in zip(prose, found)) <= 2


def test_secrets_planted_in_the_tables_prose(prose):
    maker, rows, want = secrets.Maker(31), [], []
    for text in prose:
        lines = text.split(". ")
        if len(lines) > 4 and len(rows) < 300:
            before, value, behind = maker.secret()
            head = ". ".join(lines[:2]) + ". " + before
            rows.append(head + value + behind + ". " + ". ".join(lines[2:]))
            want.append((len(head), len(head) + len(value)))
    found = secrets.field_spans(rows, secrets.trained_field())
    caught = sum(any(s < b and a < e for s, e in spans) for spans, (a, b) in zip(found, want))
    elsewhere = sum(not (s < b and a < e) for t, spans, (a, b) in zip(rows, found, want) for s, e in beside_patterns(t, spans))
    assert caught >= 0.7 * len(rows) and elsewhere <= 0.03 * len(rows)
    print(caught / len(rows), elsewhere)
