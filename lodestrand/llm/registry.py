"""Queries of the corpus operators, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules that register queries; each has QUERIES and SQL.
MODULES = ("line_dedup", "conversation_trie", "toxicity", "filter_audit", "quality_rules", "warc", "suffix_dedup", "chunk_dedup", "simhash", "sentencepieces", "secrets", "quality_bayes", "decontaminate")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in MODULES:
        found |= import_module(f"{__package__}.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found |= import_module(f"{__package__}.{name}").SQL
    return found
