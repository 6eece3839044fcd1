"""Order over a whole table: the row before, breaks of a strict order, repeats and ranks, never by a window over all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import written

#: Positions of a bucket, as a power of two.
BUCKET_BITS = 16


def with_previous(df: DataFrame, position: str, values: Sequence[str], bits: int = BUCKET_BITS) -> DataFrame:
    """``df`` with ``_was``: ``values`` of the row before by the unique long ``position`` as a struct, null for the first; gaps are fine.

    Rows are dealt to buckets of 2 ** ``bits`` positions and look back within theirs. A bucket's first row looks at
    the last one of the bucket before, which is found among the buckets in the same way; each level is 2 ** ``bits`` times
    smaller, so no task holds more than a bucket. Rows are shuffled once.
    """
    ends = df.agg(F.min(position).alias("lo"), F.max(position).alias("hi")).first()
    lo, hi = ends["lo"] or 0, ends["hi"] or 0
    held = df.withColumn("_bucket", F.shiftright(F.col(position) - F.lit(lo), bits))
    inner = F.lag(F.struct(*values)).over(W.partitionBy("_bucket").orderBy(position))
    held = held.withColumn("_was", inner)
    if hi - lo < 1 << bits:
        return held.drop("_bucket")
    last = df.groupBy(F.shiftright(F.col(position) - F.lit(lo), bits).alias("_at")).agg(F.max_by(F.struct(*values), position).alias("_last"))
    before = with_previous(last, "_at", ["_last"], bits).select(F.col("_at").alias("_of"), F.col("_was._last").alias("_before"))
    return held.join(before, F.col("_bucket") == F.col("_of"), "left").withColumn("_was", F.coalesce("_was", "_before")).drop("_bucket", "_of", "_before")


def order_breaks(df: DataFrame, position: str, keys: Sequence[str], bits: int = BUCKET_BITS) -> DataFrame:
    """Rows whose ``keys`` are not strictly above those of the row before; nulls are lowest."""
    return with_previous(df, position, keys, bits).where(F.col("_was").isNotNull() & ~(F.col("_was") < F.struct(*keys))).drop("_was")


def repeats(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """Rows whose ``keys`` a row at a lower position has too; keys are counted first, so only repeated ones are joined."""
    again = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count("*").alias("_n"), F.min(position).alias("_first")).where("_n > 1")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.join(again, on).where(F.col(position) > F.col("_first")).drop("_n", "_first", *[f"_{k}" for k in keys])


def ranked(df: DataFrame, order: Sequence[str | Column], name: str = "rank", parts: int | None = None) -> DataFrame:
    """``df``, written, with the place of each row in a total order, from zero; the same for any partitioning.

    One range-partitioned sort; a row's place is its place in its partition and the sizes of those before, of which
    there are as many as partitions.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    held = written(dealt.withColumn("_part", F.shiftright("_id", 33)), "ranked")
    sizes = held.groupBy("_part").agg(F.min("_id").alias("first"), F.count("*").alias("n")).agg(F.sort_array(F.collect_list(F.struct("_part", "first", "n"))).alias("all"))
    # as many as partitions, in one row
    before = sizes.select(F.explode(F.transform("all", lambda x, i: F.struct(x["_part"].alias("_of"), x["first"].alias("_first"), F.aggregate(F.slice("all", F.lit(1), i), F.lit(0).cast("long"), lambda acc, y: acc + y["n"]).alias("_before")))).alias("b")).select("b.*")
    return held.join(F.broadcast(before), F.col("_part") == F.col("_of")).withColumn(name, F.col("_id") - F.col("_first") + F.col("_before")).drop("_id", "_part", "_of", "_first", "_before")


def sequence_differences(left: DataFrame, right: DataFrame, by: Sequence[str], position: str, value: str) -> DataFrame:
    """(by, same_members, same_order, first_difference): how two sequences (by, position, value) of each key compare.

    The sequences are laid side by side by position; members are counted by value, so repeats count. A hot key's
    rows are spread, since both joins and sums go by position or value too.
    """
    sides = left.select(*by, position, value, F.lit(1).alias("_s")).unionByName(right.select(*by, position, value, F.lit(-1).alias("_s")))
    at = sides.groupBy(*by, position).agg(F.max(F.when(F.col("_s") == 1, F.struct(value))).alias("a"), F.max(F.when(F.col("_s") == -1, F.struct(value))).alias("b"))
    order = at.groupBy(*by).agg(F.min(F.when(~F.col("a").eqNullSafe(F.col("b")), F.col(position))).alias("first_difference"))
    members = sides.groupBy(*by, value).agg(F.sum("_s").alias("_left")).groupBy(*by).agg((F.max(F.abs("_left")) == 0).alias("same_members"))
    return order.join(members, list(by)).select(*by, "same_members", F.col("first_difference").isNull().alias("same_order"), "first_difference")


def unmatched(left: DataFrame, right: DataFrame, keys: Sequence[str], names: tuple[str, str] = ("extra", "missing")) -> DataFrame:
    """(keys, n, problem): what either multiset has more often than the other; a one-to-one match by rank leaves just these counts.

    Ranks need not be made: of a value that one side has m times and the other n times, |m - n| stay unmatched.
    """
    sides = left.select(*keys, F.lit(1).alias("_s")).unionByName(right.select(*keys, F.lit(-1).alias("_s")))
    left_over = sides.groupBy(*keys).agg(F.sum("_s").alias("_n")).where("_n <> 0")
    return left_over.select(*keys, F.abs("_n").cast("long").alias("n"), F.when(F.col("_n") > 0, names[0]).otherwise(names[1]).alias("problem"))
