"""Keyed unions with conflict detection, reconciliation of sets, reference and order constraints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class Conflict(ValueError):
    """Two rows of one key differ."""


def checked_union(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Distinct rows of both, and ``n_variants``: over 1 where a key's rows differ."""
    both = left.unionByName(right).distinct()
    return both.withColumn("n_variants", F.count("*").over(W.partitionBy(*key)).cast("long"))


def conflicts(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that have different rows, and how many."""
    return left.unionByName(right).distinct().groupBy(*key).agg(F.count("*").cast("long").alias("n_variants")).where("n_variants > 1")


def merge(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """The union by key; raises :class:`Conflict` where rows of a key differ."""
    bad = conflicts(left, right, key).limit(5).collect()
    if bad:
        raise Conflict(f"rows differ for {[tuple(r)[:-1] for r in bad]}")
    return left.unionByName(right).distinct()


def reconcile(left: DataFrame, right: DataFrame, names: tuple[str, str] = ("left_only", "right_only")) -> DataFrame:
    """Rows that only one of two sets has, with ``side``."""
    return left.distinct().exceptAll(right.distinct()).withColumn("side", F.lit(names[0])).unionByName(right.distinct().exceptAll(left.distinct()).withColumn("side", F.lit(names[1])))


def dangling(rows: DataFrame, column: str, table: DataFrame, key: str) -> DataFrame:
    """Rows whose reference is not null and has no match; the referenced keys alone are shuffled."""
    return rows.where(F.col(column).isNotNull()).join(table.select(F.col(key).alias("_key")).distinct(), F.col(column) == F.col("_key"), "left_anti")


def order_violations(df: DataFrame, by: Sequence[str], order: Sequence[str], key: Column) -> DataFrame:
    """Rows that are not strictly above the row before; ``by`` splits the check, ``order`` is the stored order."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("_was", F.lag(key).over(w)).where(F.col("_was").isNotNull() & ~(F.col("_was") < key)).drop("_was")


def first_match(left: DataFrame, candidates: Sequence[tuple[str, DataFrame, Column]], id_columns: Sequence[str], value: str) -> DataFrame:
    """For each row of ``left`` the ``value`` of the first candidate table, in order, that matches; a chain of equi-joins, none of which multiplies rows.

    Each candidate is (name, table with unique join keys, condition).
    """
    out = left
    names = []
    for k, (name, table, on) in enumerate(candidates):
        out = out.join(table.withColumnRenamed(value, f"_v{k}").withColumn(f"_m{k}", F.lit(name)), on, "left")
        names.append((f"_m{k}", f"_v{k}"))
    source = F.coalesce(*[F.col(m) for m, _ in names])
    chosen = F.lit(None)
    for m, v in reversed(names):
        chosen = F.when(F.col(m).isNotNull(), F.col(v)).otherwise(chosen)
    return out.select(*id_columns, source.alias("resolved_by"), chosen.alias(value))


def rollup(diagnostics: DataFrame, by: Sequence[str], rank: Column, reason: Column) -> DataFrame:
    """Completeness by key: the worst impact, and the sorted distinct reasons of those that force one."""
    worst = F.max(rank)
    reasons = F.array_join(F.sort_array(F.collect_set(F.when(rank > 0, reason))), ";")
    return diagnostics.groupBy(*by).agg(F.when(worst >= 2, "rejected").when(worst == 1, "partial").otherwise("complete").alias("completeness"), reasons.alias("reasons"))
