"""Where generated text is from: all range columns of a package mapped back in one join, include stacks of offsets, and what searches looked at."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrand.functions.text import framed, line_table

from . import intervals
from .packages import PARTIAL

#: Code of the diagnostic of a range that has no one origin.
GAP = "P2000"


def range_columns(table: DataFrame, name: str, file: str, key: Sequence[str], columns: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(table, file, key, column, r_start, r_end): the range columns of a table as rows; ranges with a null are left out. ``key`` is spelled as one text."""
    parts = [F.struct(F.lit(c).alias("column"), s.cast("long").alias("r_start"), e.cast("long").alias("r_end")) for c, (s, e) in columns.items()]
    spelled = F.concat_ws("|", *[F.col(k).cast("string") for k in key])
    return table.select(F.lit(name).alias("table"), F.col(file).alias("file"), spelled.alias("key"), F.explode(F.array(*parts)).alias("r")).select("table", "file", "key", "r.*").where("r_start IS NOT NULL AND r_end IS NOT NULL")


def remapped(ranges: DataFrame, segments: DataFrame, width: int = 512, parts: int | None = None) -> DataFrame:
    """Ranges of any number of tables and columns, which differ in at least one of theirs, with where they are from (o_file, o_start, o_end) through segments (file, s_start, s_end, o_file, o_start, o_end); nulls for gaps.

    A range maps to the hull of the origins that it overlaps if they are of one file and it lies in segments from end to end; otherwise it is a gap.
    Ranges go through one overlap join and one grouping, however many columns there are and whether they map or not; both have ``parts``
    partitions, if given, so that those who know how many ranges there are bound what one task sorts.
    """
    pairs = intervals.overlap_join(ranges, segments, ["file"], width, unmet=True, parts=parts)
    if parts:
        pairs = pairs.repartition(parts, "file", "key")
    inside = F.least("r_end", "s_end") - F.greatest("r_start", "s_start")
    origin = {"o_file": F.min("o_file"), "o_start": F.min("o_start").cast("long"), "o_end": F.max("o_end").cast("long")}
    met = pairs.groupBy("table", "file", "key", "column", "r_start", "r_end").agg(*[c.alias(n) for n, c in origin.items()], F.max("o_file").alias("_last"), F.sum(F.when(F.col("s_start").isNotNull(), inside)).alias("_covered"))
    whole = F.expr("o_file = _last AND _covered >= r_end - r_start")
    return met.select("table", "file", "key", "column", "r_start", "r_end", *[F.when(whole, F.col(n)).alias(n) for n in origin])


def remap_ranges(ranges: DataFrame, segments: DataFrame, width: int = 512) -> tuple[DataFrame, DataFrame]:
    """(mapped, gaps): the rows of ``remapped`` that have an origin, and the ranges that have none."""
    every = remapped(ranges, segments, width)
    return every.where("o_file IS NOT NULL"), every.where("o_file IS NULL").drop("o_file", "o_start", "o_end")


def gap_diagnostics(gaps: DataFrame) -> DataFrame:
    """(code, impact, message, file, start, end, id): one for each range that was lost; it makes a package partial."""
    message = F.concat(F.col("table"), F.lit(" "), F.col("column"), F.lit(" has no one origin"))
    return gaps.select(F.lit(GAP).alias("code"), F.lit(1).alias("impact"), message.alias("message"), "file", F.col("r_start").alias("start"), F.col("r_end").alias("end"), F.col("key").alias("id"))


def lowered_support(rows: DataFrame, key: Sequence[str], gaps: DataFrame, table: str) -> DataFrame:
    """``rows`` (with support) of which those with a gap are partial at best."""
    lost = gaps.where(F.col("table") == table).select(F.col("key").alias("_lost")).distinct()
    spelled = F.concat_ws("|", *[F.col(k).cast("string") for k in key])
    held = rows.join(lost, spelled == F.col("_lost"), "left")
    return held.withColumn("support", F.when(F.col("_lost").isNotNull(), F.greatest("support", F.lit(PARTIAL))).otherwise(F.col("support"))).drop("_lost")


#: Fixed value: a line marker, ``# line "file" flags``.
MARKER = r'^# ([0-9]+) "((?:[^"\\]|\\.)*)"(.*)$'


def marker_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, at, start, size, line, file, new, back): the lines of texts from zero; of markers the line and file that they set, and whether they enter or leave a file."""
    lines = line_table(texts, key, text, F.length).withColumn("at", F.col("line") - 1)
    parts = texts.select(F.col(key).alias("_key"), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n", -1)).alias("_pos", "content"))
    held = lines.join(parts, (F.col(key) == F.col("_key")) & (F.col("at") == F.col("_pos")))
    content = F.col("content")
    is_marker = content.rlike(MARKER)
    flags = F.regexp_extract(content, MARKER, 3)
    of = lambda k: F.when(is_marker, F.regexp_extract(content, MARKER, k))
    return held.select(F.col(key), "at", "start", "size", of(1).try_cast("long").alias("line"), of(2).alias("file"), (is_marker & flags.contains("1")).alias("new"), (is_marker & flags.contains("2")).alias("back"))


def include_stacks(texts: DataFrame, key: str, text: str, offsets: DataFrame) -> DataFrame:
    """(key, offset, file, line, stack): where each offset (key, offset) of preprocessed text is from, and the places that included it, outermost first.

    A marker's line counts as read once the offset lies behind it. The stack is made of intervals: what is entered at a depth is left by
    the next marker that leaves this depth, its neighbour in a window by text and depth; an overlap join finds the intervals around a line. Leaving
    with nothing entered does nothing, and a marker that does both leaves the stack as it was.
    """
    lines = marker_lines(texts, key, text)
    ordered = W.partitionBy(key).orderBy("at")
    so_far = ordered.rowsBetween(W.unboundedPreceding, W.currentRow)
    enters, leaves = F.col("new") & ~F.col("back"), F.col("back") & ~F.col("new")
    place = F.when(F.col("line").isNotNull(), F.struct("at", "line", "file"))
    # the place after a line, and before it
    held = lines.withColumn("_after", F.last(place, ignorenulls=True).over(so_far)).withColumn("_sum", F.sum(F.when(enters, 1).when(leaves, -1).otherwise(0)).over(so_far))
    held = held.withColumn("_depth", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(so_far)))
    held = held.withColumn("_before", F.lag("_after").over(ordered)).withColumn("_was", F.coalesce(F.lag("_depth").over(ordered), F.lit(0)))
    here_file, here_line = F.coalesce("_before.file", F.lit("")), F.coalesce(F.col("_before.line") + F.col("at") - F.col("_before.at") - 1, F.col("at") + 1)
    moves = held.where((enters & (F.col("_depth") > F.col("_was"))) | (leaves & (F.col("_depth") < F.col("_was")))).select(key, "at", F.greatest("_depth", "_was").alias("level"), enters.alias("enters"), here_file.alias("file"), here_line.alias("line"))
    left_at = F.lead("at").over(W.partitionBy(key, "level").orderBy("at"))
    entered = moves.withColumn("_left", left_at).where("enters").select(key, "level", "file", "line", (F.col("at") + 1).alias("s_start"), (F.coalesce("_left", F.lit(1 << 40)) + 1).alias("_end"))
    # an interval that is never left ends with its text
    last = lines.groupBy(F.col(key).alias("_of")).agg((F.max("at") + 1).alias("_n"))
    entered = entered.join(last, F.col(key) == F.col("_of")).select(key, "level", "file", "line", "s_start", F.least("_end", "_n").alias("s_end"))

    starts = held.select(key, F.col("start").alias("offset"), F.lit(0).alias("_side"), F.struct("at", here_file.alias("file"), here_line.alias("line")).alias("_place"))
    asked = offsets.select(key, F.col("offset").cast("long").alias("offset"), F.lit(1).alias("_side")).distinct().withColumn("_place", F.lit(None).cast(starts.schema["_place"].dataType))
    w = W.partitionBy(key).orderBy("offset", "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = starts.unionByName(asked).withColumn("_place", F.last("_place", ignorenulls=True).over(w)).where("_side = 1").select(key, "offset", "_place.*")
    points = found.select(key, "offset", F.col("at").alias("r_start"), (F.col("at") + 1).alias("r_end"))
    around = intervals.overlap_join(points, entered, [key], 64).groupBy(key, "offset").agg(F.array_sort(F.collect_list(F.struct("level", "file", "line"))).alias("stack"))
    stack = F.transform(F.coalesce("stack", F.array().cast("array<struct<level:bigint,file:string,line:bigint>>")), lambda x: F.struct(x["file"].alias("file"), x["line"].alias("line")))
    return found.join(around, [key, "offset"], "left").select(key, "offset", "file", "line", stack.alias("stack"))


def searched_directories(files: DataFrame, lookups: DataFrame, separator: str = "/") -> DataFrame:
    """(root, n_files, content): a fingerprint of each directory that a lookup (root) went through, from the paths below it and their digests (path, digest).

    Files meet their directories by the prefixes of their paths; directories that no lookup names are dropped by a semi-join on the
    names first. Digests are combined in up to 4,096 groups by path and then once more, so no directory gathers its files.
    """
    used = lookups.select(F.col("root").alias("_root")).distinct()
    parts = F.split("path", separator)
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), separator))
    held = files.select("path", "digest", F.explode(above).alias("root")).where("root <> path").join(used, F.col("root") == F.col("_root"), "left_semi")
    below = F.substring(F.col("path"), F.length("root") + 2, F.length("path"))
    lines = held.select("root", F.substring(F.sha2(below, 256), 1, 3).alias("group"), F.sha2(framed(F.array(below, F.col("digest"))), 256).alias("line"))
    grouped = lines.groupBy("root", "group").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("line")), ""), 256).alias("d"), F.count("*").alias("n"))
    return grouped.groupBy("root").agg(F.sum("n").alias("n_files"), F.concat(F.lit("dir1_"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("group", "d"))), lambda x: x["d"]), ""), 256)).alias("content"))
