"""Interval joins by bins: overlap, containment, and remapping through segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def overlap_join(ranges: DataFrame, segments: DataFrame, by: Sequence[str], width: int, unmet: bool = False, parts: int | None = None) -> DataFrame:
    """Pairs of a range (r_start, r_end) and a segment (s_start, s_end) of one ``by`` that share a point; ends are exclusive.

    Both sides are dealt to bins of ``width``; a pair is kept in the first bin it shares, so the join is an
    equi-join and gives each pair once. With ``unmet`` a range also stays, with nulls for the segment, for each of its bins
    without a pair; an empty one stays once. The join has ``parts`` partitions at least, if given, which are not joined to larger ones.
    """
    bins = lambda s, e: F.sequence(F.floor(F.col(s) / width), F.floor((F.greatest(F.col(e), F.col(s) + 1) - 1) / width))
    if unmet:
        left = ranges.withColumn("_bin", F.explode_outer(F.when(F.col("r_start") < F.col("r_end"), bins("r_start", "r_end"))))
        more = [c for c in segments.columns if c not in by]
        right = segments.where("s_start < s_end").select(*[F.col(c).alias(f"_{c}") for c in by], *more, F.explode(bins("s_start", "s_end")).alias("_in"))
        met = F.expr("_bin = _in AND r_start < s_end AND s_start < r_end") & (F.col("_bin") == F.floor(F.greatest("r_start", "s_start") / width))
        for c in by:
            met &= F.col(c) == F.col(f"_{c}")
        if parts:
            left, right = left.repartition(parts, *by, "_bin"), right.repartition(parts, *[f"_{c}" for c in by], "_in")
        return left.join(right, met, "left").drop("_bin", "_in", *[f"_{c}" for c in by])
    left = ranges.where("r_start < r_end").withColumn("_bin", F.explode(bins("r_start", "r_end")))
    right = segments.where("s_start < s_end").withColumn("_bin", F.explode(bins("s_start", "s_end")))
    if parts:
        left, right = left.repartition(parts, *by, "_bin"), right.repartition(parts, *by, "_bin")
    pairs = left.join(right, [*by, "_bin"]).where("r_start < s_end AND s_start < r_end")
    return pairs.where(F.col("_bin") == F.floor(F.greatest("r_start", "s_start") / width)).drop("_bin")


def uncontained(children: DataFrame, parents: DataFrame, by: Sequence[str], key: str, width: int) -> DataFrame:
    """Children (r_start, r_end) that no parent (s_start, s_end) of the same ``by`` holds whole."""
    inside = overlap_join(children, parents, by, width).where("s_start <= r_start AND r_end <= s_end").select(key).distinct()
    return children.join(inside, key, "left_anti")


def remap(ranges: DataFrame, segments: DataFrame, by: Sequence[str], range_key: Sequence[str], same: Sequence[str], width: int, parts: int | None = None) -> DataFrame:
    """Hull of the segments that a range overlaps, if they agree in ``same``; ranges that don't map are absent.

    Segments carry (o_start, o_end), where they are from. Join and grouping have ``parts`` partitions at least, if given.
    """
    pairs = overlap_join(ranges, segments, by, width, parts=parts)
    if parts:
        pairs = pairs.repartition(parts, *by, *range_key)
    out = pairs.groupBy(*by, *range_key).agg(F.count_distinct(F.struct(*same)).alias("_kinds"), *[F.min(c).alias(c) for c in same], F.min("o_start").cast("long").alias("o_start"), F.max("o_end").cast("long").alias("o_end"))
    return out.where("_kinds = 1").drop("_kinds")


def locate(offsets: DataFrame, starts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Line (from 1) and column (from 1) of each ``offset``: the last line start at or before it, by one ordered window over both tables."""
    a = offsets.select(*by, F.col("offset"), F.lit(None).cast("long").alias("line"), F.lit(1).alias("_side"))
    b = starts.select(*by, F.col("start").alias("offset"), F.col("line").cast("long").alias("line"), F.lit(0).alias("_side"))
    w = W.partitionBy(*by).orderBy("offset", "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    mark = F.when(F.col("_side") == 0, F.struct("line", "offset"))
    out = a.unionByName(b).withColumn("_at", F.last(mark, ignorenulls=True).over(w)).where("_side = 1")
    return out.select(*by, "offset", F.col("_at.line").alias("line"), (F.col("offset") - F.col("_at.offset") + 1).alias("column"))


def longest_prefix(paths: DataFrame, path: Column, roots: DataFrame, separator: str = "/") -> DataFrame:
    """Each row with the longest root (root, logical) that is the path or ends at a separator in it; rows without one have nulls.

    The prefixes of a path are made from its parts and looked up by equality, so no root is tried against no path.
    """
    parts = F.split(path, separator)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), separator))
    names = paths.columns
    tried = paths.withColumn("_row", F.struct(*names)).withColumn("_root", F.explode(prefixes))
    found = tried.join(roots, F.col("_root") == F.col("root")).groupBy("_row").agg(F.max_by(F.struct("root", "logical"), F.length("root")).alias("_best"))
    held = paths.withColumn("_row", F.struct(*names)).join(found, "_row", "left")
    return held.select(*names, F.col("_best.root").alias("root"), F.col("_best.logical").alias("logical"))


def overlapping_roots(roots: DataFrame, separator: str = "/") -> DataFrame:
    """(root, within): mapped roots that equal or lie under another one, found by equality of prefixes."""
    numbered = roots.select("root", "logical")
    parts = F.split("root", separator)
    above = numbered.select(F.col("root"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), separator))).alias("within"))
    times = numbered.groupBy(F.col("root").alias("_root")).agg(F.count("*").alias("_n"))
    return above.join(times, F.col("within") == F.col("_root")).where("root <> within OR _n > 1").select("root", "within").distinct()
