"""Packages of declarations as tables: extraction by unit, selection, merge, completeness, checks, JSON.

A package is four tables, keyed by declaration id so that packages of many units are one:

* ``declarations``: id, namespace, scope, name, kind, linkage, visibility, link_name, convention, complete,
  support, code, type (canonical text of the type rows), children (canonical text);
* ``occurrences``: id, occ_id, file, start, end, ordinal, storage, definition;
* ``edges``: src, dst, need (2 in full, 1 may stay opaque);
* ``diagnostics``: code, impact, message, file, start, end, id.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.csource.extraction import Extraction, references, type_rows
from lodestrand.csource.parsing import Parser
from lodestrand.csource.preprocess import COMPLETE, PARTIAL, REJECTED

from . import closure, sets
from .storage import written

DECLARATIONS = "id string, namespace string, scope string, name string, kind string, linkage string, visibility string, link_name string, convention string, complete boolean, support int, code string, type string, children string"
OCCURRENCES = "id string, occ_id string, file string, start long, end long, ordinal long, storage string, definition boolean"
EDGES = "src string, dst string, need int"
DIAGNOSTICS = "code string, impact int, message string, file string, start long, end long, id string"
_ROWS = f"what string, declaration struct<{DECLARATIONS}>, occurrence struct<{OCCURRENCES}>, edge struct<{EDGES}>, diagnostic struct<{DIAGNOSTICS}>"
FULL, OPAQUE = 2, 1
ORDER = ("code", "impact", "message", "file", "start", "end", "id")


class Incomplete(ValueError):
    """What keeps a selection from being complete, as rows."""

    def __init__(self, blockers: list[tuple]):
        super().__init__(f"{len(blockers)} blockers")
        self.blockers = blockers


def impact_of(code: str) -> int:
    """P1200 and warnings tell, other P codes make partial, E codes reject."""
    return COMPLETE if code == "P1200" or code[0] == "W" else PARTIAL if code[0] == "P" else REJECTED


def _canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=sorted)


def unit_rows(text: str, file: str, flavor: str = "gnu") -> list[dict]:
    """All rows of one unit's text."""
    unit, lost = Parser(text, flavor).recovered()
    got = Extraction(unit, text, file).run()
    blank = dict.fromkeys(("declaration", "occurrence", "edge", "diagnostic"))
    out = []
    for d in got.declarations.values():
        children = [{k: (type_rows(v) if k == "type" and v else v) for k, v in c.items()} for c in d.children]
        rows = type_rows({k: v for k, v in d.type.items() if k != "names"}) if d.type else []
        fields = {"id": d.id, "namespace": d.namespace, "scope": d.scope, "name": d.name, "kind": d.kind, "linkage": d.linkage, "visibility": d.visibility, "link_name": d.link_name, "convention": d.convention, "complete": d.complete, "support": d.support[0], "code": d.support[1], "type": _canonical(rows), "children": _canonical(children)}
        out.append(blank | {"what": "declaration", "declaration": fields})
        out += [blank | {"what": "occurrence", "occurrence": {"id": d.id, "occ_id": o["id"], "file": file, "start": o["start"], "end": o["end"], "ordinal": o["ordinal"], "storage": o["storage"], "definition": o["definition"]}} for o in d.occurrences]
        own = [] if d.kind in ("record", "enum") or not d.type else references(d.type)
        inner = [r for c in d.children if d.kind != "function" and c["type"] for r in references(c["type"])]
        out += [blank | {"what": "edge", "edge": {"src": d.id, "dst": ref, "need": FULL if need == "definition" else OPAQUE}} for ref, need in {*own, *inner}]
    issues = [(x["code"], x["message"], x["start"], x["end"], x["declaration"]) for x in got.diagnostics] + [("P0002", f"skipped: expected {x['expected']}", x["start"], x["end"], None) for x in lost]
    out += [blank | {"what": "diagnostic", "diagnostic": {"code": c, "impact": impact_of(c), "message": m, "file": file, "start": s, "end": e, "id": d}} for c, m, s, e, d in issues]
    return out


@dataclass
class Package:
    declarations: DataFrame
    occurrences: DataFrame
    edges: DataFrame
    diagnostics: DataFrame

    @staticmethod
    def of_texts(texts: DataFrame, flavor: str = "gnu") -> Package:
        """From (file, text) rows, one unit each; declarations of all units, merged by id where equal."""
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        schema = to_arrow_schema(StructType.fromDDL(_ROWS))

        def run(batches):
            for batch in batches:
                for file, text in zip(batch.column("file").to_pylist(), batch.column("text").to_pylist()):
                    yield from pa.Table.from_pylist(unit_rows(text or "", file, flavor), schema=schema).to_batches()

        rows = written(texts.select("file", "text").mapInArrow(run, _ROWS))
        table = lambda what: rows.where(F.col("what") == what).select(f"{what}.*")
        return Package(table("declaration").distinct(), table("occurrence").distinct(), table("edge").distinct(), table("diagnostic").distinct())

    def conflicts(self) -> DataFrame:
        """Ids whose declarations differ."""
        return self.declarations.groupBy("id").agg(F.count_distinct(F.struct("namespace", "scope", "name", "kind", "linkage", "type", "children")).alias("n_variants")).where("n_variants > 1")

    def merge(self, other: Package) -> Package:
        """Union by key; a declaration or occurrence that differs between the two is a conflict. Diagnostics are a set."""
        return Package(sets.merge(self.declarations, other.declarations, ["id"]), sets.merge(self.occurrences, other.occurrences, ["occ_id", "file", "start"]), self.edges.unionByName(other.edges).distinct(), self.diagnostics.unionByName(other.diagnostics).distinct())

    def roots(self, ids: list[str] | None = None, need: int = FULL) -> DataFrame:
        """A selection: the given ids, or all that are fully supported; none, or one twice, is an error."""
        if ids is None:
            return self.declarations.where("support = 0").select("id", F.lit(need).alias("need")).distinct()
        if not ids or len(set(ids)) < len(ids):
            raise ValueError("a selection names at least one id, and none twice")
        return self.declarations.sparkSession.createDataFrame([(i, need) for i in sorted(ids)], "id string, need int")

    def lacking(self, roots: DataFrame) -> DataFrame:
        return closure.missing(roots.select("id"), self.declarations.select("id").distinct(), "id")

    def retain(self, roots: DataFrame) -> Package:
        """The selection's closure, and the diagnostics bound to it or to nothing; an unknown root is an error."""
        if not self.lacking(roots).isEmpty():
            raise KeyError("a selected declaration is not in the package")
        kept = closure.closure(roots, self.edges).select("id")
        semi = lambda df, key: df.join(kept.withColumnRenamed("id", "_id"), F.col(key) == F.col("_id"), "left_semi")
        bound = self.diagnostics.where("id IS NOT NULL")
        return Package(semi(self.declarations, "id"), semi(self.occurrences, "id"), semi(self.edges, "src"), semi(bound, "id").unionByName(self.diagnostics.where("id IS NULL")))

    def completeness(self) -> str:
        """Derived from the diagnostics alone."""
        worst = self.diagnostics.agg(F.coalesce(F.max("impact"), F.lit(0)).alias("n")).first()["n"]
        return ("complete", "partial", "rejected")[worst]

    def reasons(self) -> DataFrame:
        """The distinct forcing diagnostics in their total order, nulls first."""
        return self.diagnostics.where("impact > 0").distinct().orderBy(*[F.asc_nulls_first(c) for c in ORDER])

    def blockers(self, roots: DataFrame) -> DataFrame:
        """(id, problem): what the closure needs and the package cannot give."""
        needs = closure.closure(roots, self.edges)
        held = needs.join(self.declarations, "id", "left")
        found = [
            held.where("kind IS NULL").select("id", F.lit("missing").alias("problem")),
            held.where("support > 0").select("id", F.concat(F.lit("unsupported "), F.coalesce("code", F.lit(""))).alias("problem")),
            held.where((F.col("kind").isin("record", "enum")) & ~F.col("complete") & (F.col("need") == FULL)).select("id", F.lit("incomplete").alias("problem")),
            self.diagnostics.where("impact > 0 AND id IS NULL").select(F.lit(None).cast("string").alias("id"), F.concat("code", F.lit(" "), "message").alias("problem")),
        ]
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        return out.distinct()

    def into_complete(self, roots: DataFrame) -> DataFrame:
        """(id, need) of the closure, or :class:`Incomplete` with all blockers."""
        bad = self.blockers(roots).orderBy("id", "problem").collect()
        if bad:
            raise Incomplete([tuple(r) for r in bad])
        return closure.closure(roots, self.edges)

    def violations(self) -> DataFrame:
        """(path, code) of every broken constraint, all checks together."""
        one = lambda df, path, code: df.select(path.alias("path"), F.lit(code).alias("code"))
        d, o = self.declarations, self.occurrences
        aliases = self.edges.join(d.where("kind = 'alias'").select(F.col("id").alias("src")), "src", "left_semi").join(d.where("kind = 'alias'").select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
        ordinals = o.groupBy("id", "occ_id").agg(F.count_distinct("ordinal").alias("n")).where("n > 1")
        found = [
            one(d.where("id NOT RLIKE '^decl1_[0-9a-f]{64}$'"), F.col("id"), "malformed id"),
            one(d.where("namespace = 'ordinary'").where("name IS NULL"), F.col("id"), "ordinary declaration without a name"),
            one(d.where("linkage = 'internal' AND scope NOT LIKE 'file:%'"), F.col("id"), "internal linkage outside a file scope"),
            one(d.where((F.col("namespace") == "tag") != F.col("kind").isin("record", "enum")), F.col("id"), "kind and namespace differ"),
            one(d.where((F.col("kind") == "function") != (F.get_json_object("type", "$[0].kind") == "function")).where("kind <> 'alias'"), F.col("id"), "kind and type differ"),
            one(d.where("kind IN ('alias', 'record', 'enum') AND linkage <> 'none'"), F.col("id"), "linkage of what has none"),
            one(d.where("(kind NOT IN ('record', 'enum') AND complete) OR (visibility IS NOT NULL AND visibility NOT IN ('default', 'hidden', 'protected', 'internal'))"), F.col("id"), "field that the kind lacks"),
            one(sets.dangling(d.select("id"), "id", o, "id"), F.col("id"), "no occurrence"),
            one(sets.dangling(o, "id", d, "id"), F.col("occ_id"), "occurrence of nothing"),
            one(o.where("start < 0 OR end <= start"), F.col("occ_id"), "empty range"),
            one(ordinals, F.col("occ_id"), "ordinal is not unique"),
            one(sets.dangling(self.edges.where("dst NOT IN ('')"), "dst", d, "id").where(F.col("need") == FULL), F.col("src"), "reference to nothing"),
            one(sets.dangling(self.diagnostics, "id", d, "id"), F.col("code"), "diagnostic of nothing"),
            one(closure.on_cycle(aliases), F.col("id"), "alias cycle"),
        ]
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        return out.distinct().orderBy("path", "code")

    def encode(self) -> DataFrame:
        """(table, key, json): one canonical line for each row, fields in order and nulls written."""
        line = lambda df, table, *key: df.select(F.lit(table).alias("table"), F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]).alias("key"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))
        parts = [line(self.declarations, "declarations", "id"), line(self.occurrences, "occurrences", "id", "file", "start"), line(self.edges, "edges", "src", "dst", "need"), line(self.diagnostics, "diagnostics", *ORDER)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def fingerprint(self) -> str:
        """The same for the same rows in any order: digests of lines, summed by table, hashed."""
        rows = self.encode().select("table", F.conv(F.substring(F.sha2(F.concat_ws("|", "table", "json"), 256), 1, 15), 16, 10).cast("decimal(38,0)").alias("a"), F.conv(F.substring(F.sha2(F.concat_ws("|", "table", "json"), 256), 16, 15), 16, 10).cast("decimal(38,0)").alias("b"))
        sums = rows.groupBy("table").agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")).orderBy("table").collect()
        from lodestrand.csource.extraction import framed_hash

        return framed_hash("pkg1_", *[str(x) for r in sums for x in r])

    @staticmethod
    def decode(lines: DataFrame) -> Package:
        """What ``encode`` wrote; a line with a field that is unknown, or lacks one, is an error."""
        tables = {}
        for table, schema in (("declarations", DECLARATIONS), ("occurrences", OCCURRENCES), ("edges", EDGES), ("diagnostics", DIAGNOSTICS)):
            rows = lines.where(F.col("table") == table)
            names = [c.split()[0] for c in schema.split(", ")]
            strange = rows.where(~F.coalesce(F.json_object_keys("json") == F.array(*[F.lit(n) for n in names]), F.lit(False)))
            if not strange.isEmpty():
                raise ValueError(f"{table}: a line has other fields than the schema")
            tables[table] = rows.select(F.from_json("json", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
        return Package(**tables)
