"""Selections of a package in tables: roots checked, their closure kept in every table, completeness made anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import closure, order
from .validation import REASON

FULL, OPAQUE = 2, 1
STATES = ("complete", "partial", "rejected")
#: Tables whose rows belong to a declaration, and the column that names it; all other tables are kept whole.
OWNED = {"declarations": "id", "occurrences": "of", "children": "parent", "types": "tree"}


class BadSelection(ValueError):
    """A selection that the package can't give; ``problems`` is the table of (id, problem) and the message names a few."""

    def __init__(self, problems: DataFrame):
        self.problems = problems
        super().__init__("; ".join(f"{r['id']}: {r['problem']}" for r in problems.limit(5).collect()))


def selection(declarations: DataFrame, only: DataFrame | None = None, opaque: bool = False) -> DataFrame:
    """(id, need): all supported declarations, or those of ``only`` (id), of which records may stay opaque."""
    ids = declarations.where("support = 0") if only is None else only
    return ids.select("id", F.lit(OPAQUE if opaque else FULL).alias("need")).distinct()


def selection_problems(declarations: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, problem): roots that are no declaration, or are to stay opaque but no record."""
    held = roots.join(declarations.select(F.col("id").alias("_id"), F.col("kind").alias("_kind")), F.col("id") == F.col("_id"), "left")
    problem = F.when(F.col("_id").isNull(), "missing").when((F.col("need") == OPAQUE) & ~F.col("_kind").eqNullSafe("record"), "opaque but no record")
    return held.select("id", problem.alias("problem")).where("problem IS NOT NULL").distinct()


def reasons(diagnostics: DataFrame) -> DataFrame:
    """(position, code, message, file, start, end): the distinct forcing diagnostics in their order."""
    forcing = diagnostics.where("impact > 0").select(*REASON).distinct()
    return order.ranked(forcing, list(REASON), "position").select("position", *REASON)


def state(diagnostics: DataFrame) -> str:
    """What the worst impact makes of a package; one row is fetched."""
    return STATES[diagnostics.agg(F.coalesce(F.max("impact"), F.lit(0)).alias("n")).first()["n"]]


def retain(tables: dict[str, DataFrame], edges: DataFrame, roots: DataFrame) -> tuple[dict[str, DataFrame], str]:
    """The tables and the state of what ``roots`` (id, need) reach over ``edges`` (src, dst, need).

    Declarations, their occurrences, children and types outside the closure go, and so do diagnostics bound to them;
    diagnostics bound to nothing stay. Files, inputs, macros and all other tables stay whole. Reasons are those of the
    diagnostics kept. A root that is missing, or opaque but no record, and a reference that leads out of the package
    raise :class:`BadSelection`. Empty roots keep no declaration; repeated roots count once.
    """
    declarations = tables["declarations"]
    bad = selection_problems(declarations, roots)
    if not bad.isEmpty():
        raise BadSelection(bad)
    kept = closure.closure(roots, edges).select(F.col("id").alias("_kept"))
    lost = closure.missing(kept.select(F.col("_kept").alias("id")), declarations.select("id"), "id").select("id", F.lit("referred to but missing").alias("problem"))
    if not lost.isEmpty():
        raise BadSelection(lost)
    out = {t: df.join(kept, F.col(OWNED[t]) == F.col("_kept"), "left_semi") if t in OWNED else df for t, df in tables.items()}
    told = tables["diagnostics"]
    out["diagnostics"] = told.where("declaration IS NULL").unionByName(told.where("declaration IS NOT NULL").join(kept, F.col("declaration") == F.col("_kept"), "left_semi"))
    out["reasons"] = reasons(out["diagnostics"])
    return out, state(out["diagnostics"])
