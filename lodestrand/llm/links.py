"""Connected components of a link table, and joins that a hot key cannot stall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, free, whole

#: A key that this share of all rows has counts as heavy, so there are at most this many of them.
HEAVY = 1000


def lookup(rows: DataFrame, key: Column, dim: DataFrame, value: str) -> DataFrame:
    """``rows`` with ``value`` of the row of ``dim`` (key, value, n) for ``key``; n: how many rows have the key.

    Heavy keys, at most ``HEAVY`` whatever the input, are broadcast; rows that have one are dealt by a hash of
    the row in the shuffled join of all others, so none of them meet in one task. ``dim`` is a written table.
    """
    total = dim.agg(F.sum("n").alias("n")).first()["n"] or 0
    heavy = F.broadcast(dim.where(F.col("n") * HEAVY > total).select(F.col("key").alias("_heavy_key"), F.col(value).alias("_heavy_value")))
    light = dim.where(F.col("n") * HEAVY <= total).select(F.col("key").alias("_light_key"), F.col(value).alias("_light_value"))
    held = rows.select(whole(rows).alias("_row"), key.alias("_key")).join(heavy, F.col("_key") == F.col("_heavy_key"), "left")
    is_heavy = F.col("_heavy_key").isNotNull()
    held = held.withColumn("_salt", F.when(is_heavy, F.xxhash64("_row")).otherwise(F.lit(0).cast("long"))).withColumn("_join", F.when(~is_heavy, F.col("_key")))
    out = held.join(light.withColumn("_none", F.lit(0).cast("long")), (F.col("_salt") == F.col("_none")) & (F.coalesce(F.col("_join"), F.col("_key")) == F.col("_light_key")), "left")
    return out.select("_row.*", F.coalesce("_heavy_value", "_light_value").alias(value))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b): root is the smallest node reachable.

    Alternates large-star and small-star contraction (Kiveris et al., 2014): each round links a node's
    neighbours to the smallest of them, so chains shorten by halves and a hub's links never multiply. Each
    round is written to the shared folder; the driver sees only whether a round changed anything.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    state = None
    while True:
        around = both(edges)
        least = around.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("m", "a").alias("m"))
        large = around.join(least, F.col("a") == F.col("c")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.where("a <> b").distinct(), "large-star")
        lower = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), "m")
        small = large.join(lower, F.col("a") == F.col("c")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lower.select(F.col("c").alias("a"), F.col("m").alias("b")))
        before, edges = edges, cut(small.where("a <> b").distinct(), "small-star")
        free(before, large)
        seen = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (seen["n"], seen["h"]) == state:
            break
        state = (seen["n"], seen["h"])
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
