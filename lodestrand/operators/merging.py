"""Checked merges of package tables: every conflict as a row that names the field, and the merged table.

Two packages are compatible if they agree on target and inputs. Tables keyed by id are united; rows of one id must
agree in all fields, but occurrences of equal ones are united as sets. Nothing is merged where a conflict is found, and all conflicts
are told at once. All merges are idempotent and commutative.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class MergeConflict(ValueError):
    """Two packages disagree; ``conflicts`` is the table of (path, field) and the message names a few."""

    def __init__(self, conflicts: DataFrame):
        some = conflicts.limit(5).collect()
        super().__init__("; ".join(f"{r['path']}: {r['field']}" for r in some))
        self.conflicts = conflicts


def _spelled(c: str) -> Column:
    """A value as text, of any type; nulls differ from empty texts."""
    return F.to_json(F.struct(F.col(c).alias("v")))


def field_conflicts(left: DataFrame, right: DataFrame, table: str, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(path, field): per key that both sides, or one of them twice, have, the fields whose values differ.

    One aggregate over both tables: the least and the greatest value of each field, combined map-side, so a key with any number of rows costs its
    fields once.
    """
    both = left.select(*key, *fields).unionByName(right.select(*key, *fields))
    differ = [F.when(F.min(_spelled(f)) != F.max(_spelled(f)), F.lit(f)) for f in fields]
    found = both.groupBy(*key).agg(F.filter(F.array(*differ), lambda x: x.isNotNull()).alias("_f")).where(F.size("_f") > 0)
    path = F.concat(F.lit(f"{table}["), F.concat_ws("|", *[F.col(k).cast("string") for k in key]), F.lit("]"))
    return found.select(path.alias("path"), F.explode("_f").alias("field"))


def list_conflicts(left: DataFrame, right: DataFrame, name: str, by: Sequence[str], position: str, fields: Sequence[str]) -> DataFrame:
    """(path, field): where two ordered lists (by, position, fields) first differ; lists must agree in order and length."""
    sides = left.select(*by, position, *fields, F.lit(1).alias("_s")).unionByName(right.select(*by, position, *fields, F.lit(2).alias("_s")))
    of = lambda s: F.max(F.when(F.col("_s") == s, F.to_json(F.struct(*fields))))
    at = sides.groupBy(*by, position).agg(of(1).alias("a"), of(2).alias("b")).where(~F.col("a").eqNullSafe(F.col("b")))
    first = at.groupBy(*by).agg(F.min_by(F.struct(position, "a", "b"), position).alias("d"))
    what = F.when(F.col("d.a").isNull() | F.col("d.b").isNull(), "length").otherwise("element")
    key = F.concat_ws(".", F.lit(name), *[F.col(b).cast("string") for b in by])
    return first.select(F.concat(key, F.lit("["), F.col(f"d.{position}").cast("string"), F.lit("]")).alias("path"), what.alias("field"))


def united(left: DataFrame, right: DataFrame, key: Sequence[str], lattice: dict[str, str] | None = None) -> DataFrame:
    """One row for each key of both tables that don't conflict; ``lattice`` columns may differ and take their max or min."""
    fields = [c for c in left.columns if c not in key]
    kept = {c: (lattice or {}).get(c) for c in fields}
    merged = [(F.max(c) if how == "max" else F.min(c) if how == "min" else F.any_value(c)).alias(c) for c, how in kept.items()]
    return left.unionByName(right).groupBy(*key).agg(*merged).select(*left.columns) if fields else left.unionByName(right).distinct()


#: What must agree in all, as ordered lists, and what is united.
ORDERED_INPUTS = ("include_search", "define_events", "forced_includes", "preprocessor", "variables", "path_mapping")
FILE_FIELDS = ("logical_path", "role", "content", "byte_len", "line_starts")
MACRO_FIELDS = ("file", "name", "form", "category", "body", "tokens", "value", "support")
MACRO_OCCURRENCE_FIELDS = ("macro", "file", "start", "end", "ordinal")


def input_conflicts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Inputs (list, position, id, name, value): all lists but the entry files must agree, element by element."""
    ordered = lambda df: df.where(F.col("list").isin(*ORDERED_INPUTS))
    return list_conflicts(ordered(left), ordered(right), "inputs", ["list"], "position", ["id", "name", "value"])


def merge_inputs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Inputs of both, the entry files united and numbered by id; the lists are the left's."""
    from pyspark.sql import Window as W

    entries = left.unionByName(right).where("list = 'entry_files'").select("list", "id", "name", "value").distinct()
    numbered = entries.withColumn("position", (F.row_number().over(W.partitionBy("list").orderBy("id")) - 1).cast("long"))
    return left.where("list <> 'entry_files'").unionByName(numbered.select(*left.columns))


def target_conflicts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Targets (fact, value): every fact must be on both sides, with one value."""
    sides = left.select("fact", "value", F.lit(1).alias("_s")).unionByName(right.select("fact", "value", F.lit(2).alias("_s")))
    held = sides.groupBy("fact").agg(F.count_distinct("_s").alias("n"), F.min(_spelled("value")).alias("a"), F.max(_spelled("value")).alias("b"))
    return held.where("n < 2 OR a <> b").select(F.lit("target").alias("path"), F.col("fact").alias("field"))


def merge(left: dict[str, DataFrame], right: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Both packages as one, or :class:`MergeConflict` with all that differs.

    A package has the tables target, inputs, files, macros, macro_occurrences and diagnostics here; declarations and their occurrences
    are merged likewise by ``packages.Package``.
    """
    found = conflicts(left, right)
    if not found.isEmpty():
        raise MergeConflict(found)
    out = {"target": left["target"], "inputs": merge_inputs(left["inputs"], right["inputs"]), "diagnostics": left["diagnostics"].unionByName(right["diagnostics"]).distinct()}
    return out | {t: united(left[t], right[t], ["id"]) for t in ("files", "macros", "macro_occurrences")}


def conflicts(left: dict[str, DataFrame], right: dict[str, DataFrame]) -> DataFrame:
    """(path, field) of everything in which two packages disagree."""
    found = [
        target_conflicts(left["target"], right["target"]),
        input_conflicts(left["inputs"], right["inputs"]),
        field_conflicts(left["files"], right["files"], "files", ["id"], FILE_FIELDS),
        field_conflicts(left["macros"], right["macros"], "macros", ["id"], MACRO_FIELDS),
        field_conflicts(left["macro_occurrences"], right["macro_occurrences"], "macro_occurrences", ["id"], MACRO_OCCURRENCE_FIELDS),
    ]
    return reduce(DataFrame.unionByName, found)
