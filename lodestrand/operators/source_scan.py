"""Scans of C units as DataFrames: which files a unit can reach, then one task for each unit.

``files`` is (path, content binary), ``units`` (unit_id, entries, roots, defines, policy). Reachable files are
found by joins, round by round: the include lines of the files found so far, the candidate paths of each, and
the files that have such a path. Only then are a unit's files brought together and preprocessed.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.csource.preprocess import Config, Unit, candidates

from .storage import written

UNITS = "unit_id long, entries array<string>, roots array<string>, defines array<struct<name:string,value:string>>, policy string"
SCANNED = (
    "unit_id long, what string, ord long, kind string, text string, file string, start long, end long, code string, impact int, macros_via array<string>, depth int, value string, category string"
)
_INCLUDE = re.compile(rb'(?m)^[ \t]*#[ \t]*include[ \t]*(?:<([^>\n]+)>|"([^"\n]+)")')


def read_files(spark, folder: str, cap: int = 16 << 20) -> tuple[DataFrame, DataFrame]:
    """(files, rejected): files under ``folder`` by relative path; larger ones than ``cap`` are not read into rows but named."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    named = raw.withColumn("relative", F.regexp_replace("path", f"^.*?{re.escape(folder.rstrip('/').split(':')[-1])}/", ""))
    kept = named.where(F.col("length") <= cap).select(F.col("relative").alias("path"), "content")
    return kept, named.where(F.col("length") > cap).select(F.col("relative").alias("path"), "length")


def include_lines(files: DataFrame) -> DataFrame:
    """(path, name, system): every include line, whether its branch is active or not."""

    def run(batches):
        for batch in batches:
            rows = [(p, (m.group(1) or m.group(2)).decode("utf-8", "replace"), m.group(1) is not None) for p, c in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()) for m in _INCLUDE.finditer(c)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.bool_())], ["path", "name", "system"])

    return files.select("path", "content").mapInArrow(run, "path string, name string, system boolean")


def reachable(units: DataFrame, files: DataFrame) -> DataFrame:
    """(unit_id, path): the files that a unit may read; includes in inactive branches count."""
    lines = written(include_lines(files).distinct())
    paths = files.select("path")
    known = written(units.select("unit_id", F.explode("entries").alias("path")).distinct().join(paths, "path", "left_semi").select("unit_id", "path"))
    frontier = known
    while True:
        asked = frontier.join(lines, "path").join(units.select("unit_id", "roots"), "unit_id")

        def tried(batches):
            for batch in batches:
                rows = [(u, c) for u, p, n, s, r in zip(*(batch.column(k).to_pylist() for k in ("unit_id", "path", "name", "system", "roots"))) for c in candidates(p, n, s, r or [])]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["unit_id", "path"])

        found = asked.mapInArrow(tried, "unit_id long, path string").distinct().join(paths, "path", "left_semi").select("unit_id", "path")
        frontier = written(found.join(known, ["unit_id", "path"], "left_anti"))
        if frontier.isEmpty():
            return known
        known = written(known.unionByName(frontier))


def _unit_rows(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    first = rows[0]
    config = Config(list(first["entries"] or []), [], list(first["roots"] or []), [(d["name"], d["value"]) for d in first["defines"] or []], policy=first["policy"] or "checked")
    unit = Unit(config, {r["path"]: r["content"] for r in rows if r["path"] is not None}).run()
    blank = dict.fromkeys(("kind", "text", "file", "start", "end", "code", "impact", "macros_via", "depth", "value", "category"))
    out = [blank | {"what": "token", "ord": k, "kind": t.kind, "text": t.text, "file": t.file, "start": t.start, "end": t.end, "macros_via": [v[0] for v in t.via], "depth": len(t.chain)} for k, t in enumerate(unit.tokens)]
    out += [blank | {"what": "macro", "ord": k, "kind": m["value_kind"], "text": m["name"], "file": m["file"], "start": m["start"], "end": m["end"], "value": m["value"], "category": m["category"]} for k, m in enumerate(unit.macros())]
    issues = sorted(set(unit.diagnostics), key=lambda d: (d.code, d.message, d.file, d.start, d.end))
    out += [blank | {"what": "diagnostic", "ord": k, "text": d.message, "file": d.file, "start": d.start, "end": d.end, "code": d.code, "impact": d.impact} for k, d in enumerate(issues)]
    out += [blank | {"what": "file", "ord": k, "file": p, "kind": role} for k, (p, role) in enumerate(sorted(unit.used.items()))]
    types = {"ord": pa.int64(), "start": pa.int64(), "end": pa.int64(), "impact": pa.int32(), "depth": pa.int32(), "macros_via": pa.list_(pa.string()), "unit_id": pa.int64()}
    names = ["unit_id", "what", "ord", *blank]
    return pa.table({k: pa.array([first["unit_id"] if k == "unit_id" else r[k] for r in out], types.get(k, pa.string())) for k in names})


def scan(units: DataFrame, files: DataFrame) -> DataFrame:
    """All rows of all units, ``what`` telling tokens, macros, diagnostics and files apart."""
    held = units.join(reachable(units, files).join(files, "path"), "unit_id", "left").select("unit_id", "entries", "roots", "defines", "policy", "path", "content")
    return held.groupBy("unit_id").applyInArrow(_unit_rows, SCANNED)


def unit_text(scanned: DataFrame) -> DataFrame:
    """(unit_id, text): the preprocessed text."""
    tokens = scanned.where("what = 'token'").groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("ts"))
    return tokens.select("unit_id", F.array_join(F.transform("ts", lambda t: t["text"]), "").alias("text"))


def completeness(scanned: DataFrame) -> DataFrame:
    """(unit_id, completeness): by the worst diagnostic; a unit without any is complete."""
    worst = F.coalesce(F.max("impact"), F.lit(0))
    return scanned.groupBy("unit_id").agg(F.when(worst == 2, "rejected").when(worst == 1, "partial").otherwise("complete").alias("completeness"))
