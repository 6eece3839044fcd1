"""Ordered state over partitions, as windows: ordinals, last definitions, carry-forward, ceilings, depth."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _over(by: Sequence[str], order: Sequence[str | Column]):
    return W.partitionBy(*by).orderBy(*order)


def duplicate_ordinals(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], name: str = "ordinal") -> DataFrame:
    """Position of a row among those with equal ``by``, from zero."""
    return df.withColumn(name, (F.row_number().over(_over(by, order)) - 1).cast("long"))


def last_definition(df: DataFrame, by: Sequence[str], order: Sequence[str], values: Sequence[str], live: Column | None = None) -> DataFrame:
    """The last row of each ``by`` by the total order ``order``; with ``live``, only where that row is live (an event log of define and undefine)."""
    last = F.max_by(F.struct(*values, *([live.alias("_live")] if live is not None else [])), F.struct(*order))
    out = df.groupBy(*by).agg(last.alias("_last"))
    out = out.where("_last._live") if live is not None else out
    return out.select(*by, *[F.col("_last")[v].alias(v) for v in values])


def redefinitions(df: DataFrame, by: Sequence[str], order: Sequence[str], body: Sequence[str]) -> DataFrame:
    """Rows whose body differs from the definition before it (null-safe)."""
    w = _over(by, order)
    was = F.lag(F.struct(*body)).over(w)
    return df.withColumn("_was", was).where(F.col("_was").isNotNull() & ~F.col("_was").eqNullSafe(F.struct(*body))).drop("_was")


def carry_forward(df: DataFrame, by: Sequence[str], order: Sequence[str], explicit: Column, unknown: Column, name: str = "value") -> DataFrame:
    """Implicit values: one more than the row before; an explicit value restarts, an unknown one makes all that follow null until the next explicit one."""
    w = _over(by, order)
    marked = df.withColumn("_ord", F.row_number().over(w)).withColumn("_mark", F.when(unknown | explicit.isNotNull(), F.struct(F.when(~unknown, explicit).alias("v"), F.col("_ord").alias("at"), unknown.alias("unknown"))))
    last = F.last("_mark", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    marked = marked.withColumn("_last", last)
    value = F.when(F.col("_last").isNull(), F.col("_ord") - 1).when(~F.col("_last.unknown"), F.col("_last.v") + F.col("_ord") - F.col("_last.at"))
    return marked.withColumn(name, value.cast("long")).drop("_ord", "_mark", "_last")


def running_total(df: DataFrame, by: Sequence[str], order: Sequence[str], amount: Column, name: str = "running") -> DataFrame:
    return df.withColumn(name, F.sum(amount).over(_over(by, order).rowsBetween(W.unboundedPreceding, W.currentRow)).cast("long"))


def within_budget(df: DataFrame, by: Sequence[str], order: Sequence[str], amount: Column, cap: int) -> DataFrame:
    """The rows before the first that takes the running total over ``cap``; all that follow it go too, even if they would fit."""
    w = _over(by, order).rowsBetween(W.unboundedPreceding, W.currentRow)
    total = running_total(df, by, order, amount, "_total")
    return total.withColumn("_over", F.max((F.col("_total") > cap).cast("int")).over(w)).where("_over = 0").drop("_total", "_over")


def nesting_depth(df: DataFrame, by: Sequence[str], order: Sequence[str], opens: Column, closes: Column, name: str = "depth", floor: bool = False) -> DataFrame:
    """Depth after each row; with ``floor`` a close without an open is ignored: the depth less its lowest point below zero."""
    w = _over(by, order).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = df.withColumn("_sum", F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(w))
    if floor:
        out = out.withColumn("_sum", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(w)))
    return out.withColumn(name, F.col("_sum").cast("long")).drop("_sum")


def ordered_fold(df: DataFrame, by: Sequence[str], order: Sequence[str], schema: str, fold: Callable[[list[dict]], list[dict]]) -> DataFrame:
    """``fold`` over the rows of each partition key in order, for state that windows can't express. One key's rows meet in one task, as the sequential semantics demand."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(fold(table.sort_by([(c, "ascending") for c in order]).to_pylist()), schema=out)

    return df.groupBy(*by).applyInArrow(run, schema)
