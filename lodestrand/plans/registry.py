"""Queries of the engine's own operators, by name, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import contract_queries, event_queries, package_queries, relation_queries, source_queries, text_queries, validation_queries

MODULES = (text_queries, event_queries, relation_queries, source_queries, validation_queries, package_queries, contract_queries)
flagship = text_queries.flagship


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
