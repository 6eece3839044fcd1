"""Queries of the C source operators, on units of text made from the relational tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.csource import conditions
from lodestrand.csource.lexing import kind_totals, lexemes
from lodestrand.operators import source_scan
from lodestrand.operators.packages import Package
from lodestrand.sources.tables import table


def lexer_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of the full lexer by kind, over all documents."""

    def run(batches):
        for batch in batches:
            seen = kind_totals(text or b"" for text in batch.column("text").cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([n[0] for n in seen.values()], pa.int64()), pa.array([n[1] for n in seen.values()], pa.int64())], ["kind", "n", "n_bytes"])

    counted = table(spark, d, "documents").select("text").mapInArrow(run, "kind string, n long, n_bytes long")
    return counted.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("n_bytes").alias("n_bytes"))


def condition_policies(spark: SparkSession, d: str) -> DataFrame:
    """One condition for each part under the three policies; nulls are where a policy has no value."""
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    text = F.concat(F.lit("("), key, F.lit(" + 3) * "), size, F.lit(" / ("), (F.col("p_size") % 5).cast("string"), F.lit(") - (7 % 4 << 2) + ("), size, F.lit(" > 25 ? 1 : 2)"), F.when(F.col("p_partkey") % 4 == 0, " + NAME").otherwise(""))

    def run(batches):
        for batch in batches:
            values = [conditions.values_of(lexemes(t)) for t in batch.column("condition").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("p_partkey"), *[pa.array([v[k] for v in values], pa.int64()) for k in range(3)]], ["p_partkey", "lenient", "checked", "constant"])

    # many parts fit one split of the file, and a condition costs far more than its key and size
    part = table(spark, d, "part").select("p_partkey", "p_size").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    return part.select("p_partkey", text.alias("condition")).mapInArrow(run, "p_partkey long, lenient long, checked long, constant long")


def _region_units(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A unit for each region that includes a header for each nation; a header defines the nation's key and twice the header of all."""
    nation = table(spark, d, "nation")
    header = F.concat(F.lit('#include <common.h>\n#define N'), F.col("n_nationkey"), F.lit(" ADD("), F.col("n_nationkey"), F.lit(", n"), F.col("n_regionkey"), F.lit(")\n"))
    headers = nation.select(F.concat(F.lit("n"), F.col("n_nationkey"), F.lit(".h")).alias("path"), header.alias("text"))
    common = spark.createDataFrame([("inc/common.h", "#pragma once\n#define ADD(a, b) a+b\nonce\n")], "path string, text string")
    lines = nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_nationkey")).alias("keys"))
    body = F.concat(F.array_join(F.transform("keys", lambda k: F.concat(F.lit('#include "n'), k.cast("string"), F.lit('.h"\n'))), ""), F.array_join(F.transform("keys", lambda k: F.concat(F.lit("N"), k.cast("string"))), " "), F.lit("\n#if N9 > 3 && !defined ADD\nno\n#elif defined(N1) || defined N2\nyes\n#else\nelse\n#endif\n#include <none.h>\n"))
    mains = lines.select(F.concat(F.lit("r"), F.col("n_regionkey"), F.lit(".c")).alias("path"), body.alias("text"))
    files = headers.unionByName(common).unionByName(mains).select("path", F.encode("text", "UTF-8").alias("content"))
    units = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("unit_id"), F.array(F.concat(F.lit("r"), F.col("r_regionkey"), F.lit(".c"))).alias("entries"), F.array(F.lit("inc")).alias("roots"), F.array().cast("array<struct<name:string,value:string>>").alias("defines"), F.lit("checked").alias("policy"))
    return units, files


def preprocessed_units(spark: SparkSession, d: str) -> DataFrame:
    """The expanded words of each region's unit and its completeness: the missing header makes it partial."""
    scanned = source_scan.scan(*_region_units(spark, d))
    words = F.array_join(F.filter(F.split(F.col("text"), "\\s+"), lambda w: w != ""), " ")
    return source_scan.unit_text(scanned).select("unit_id", words.alias("words")).join(source_scan.completeness(scanned), "unit_id")


def included_files(spark: SparkSession, d: str) -> DataFrame:
    """The files that each region's unit reads."""
    scanned = source_scan.scan(*_region_units(spark, d))
    return scanned.where("what = 'file'").select("unit_id", F.col("file").alias("path"), F.col("kind").alias("role"))


def effective_macros(spark: SparkSession, d: str) -> DataFrame:
    """The final macros of each region's unit."""
    scanned = source_scan.scan(*_region_units(spark, d))
    return scanned.where("what = 'macro'").select("unit_id", F.col("text").alias("name"), "file", "category")


def _headers(spark: SparkSession, d: str) -> DataFrame:
    """One header for each nation: a record that holds a pointer to its region's and an array, an alias of it, an enumeration and a function."""
    n, r = F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")
    text = F.concat(F.lit("struct region"), r, F.lit(";\nstruct nation"), n, F.lit(" { struct region"), r, F.lit(" *of; int key : 5; char name["), F.length("n_name").cast("string"), F.lit(" + 1]; };\ntypedef struct nation"), n, F.lit(" nation"), n, F.lit("_t;\nenum kind"), n, F.lit(" { A"), n, F.lit(" = "), n, F.lit(", B"), n, F.lit(" };\nnation"), n, F.lit("_t *find"), n, F.lit("(const char *name, ...);\n"))
    return table(spark, d, "nation").select(F.concat(F.lit("n"), n, F.lit(".h")).alias("file"), text.alias("text"))


def extracted_declarations(spark: SparkSession, d: str) -> DataFrame:
    """All declarations of the nations' headers, merged, with how often each is seen."""
    p = Package.of_texts(_headers(spark, d))
    seen = p.occurrences.groupBy("id").agg(F.count("*").alias("n"), F.max("definition").alias("defined"))
    return p.declarations.groupBy("id", "name", "kind", "linkage").agg(F.max("complete").alias("complete")).join(seen, "id").select("name", "kind", "linkage", "complete", "n", "defined")


def retained_declarations(spark: SparkSession, d: str) -> DataFrame:
    """What the functions of the first three nations need, and how much of it."""
    p = Package.of_texts(_headers(spark, d))
    names = p.declarations.select("id", "name", "kind").distinct()
    roots = names.where("name IN ('find0', 'find1', 'find2')").select("id", F.lit(2).alias("need"))
    from lodestrand.operators.closure import closure

    return closure(roots, p.edges).join(names, "id").select("name", "kind", F.col("need").cast("long").alias("need"))


QUERIES = {f.__name__: f for f in (lexer_kinds, condition_policies, preprocessed_units, included_files, effective_macros, extracted_declarations, retained_declarations)}
_CPP = r"""\n|[ \t\r\f]+|//[^\n]*|/\*(?s:.*?)(?:\*/|\z)|##|#|(?:u8|[LuU])?"(?:\\.|[^"\\\n])*"?|[LuU]?''(?:\\.|[^''\\\n])*''?|[A-Za-z_][A-Za-z0-9_]*|\.?[0-9](?:[eEpP][+-]|[A-Za-z0-9_.])*|<<=|>>=|<<|>>|==|!=|<=|>=|&&|\|\||\+\+|--|->|[-+*/%&|^]=|[^\x00-\x7f]+|(?s:.)"""
SQL = {
    "lexer_kinds": rf"""
SELECT CASE WHEN t = chr(10) THEN 'newline' WHEN regexp_matches(t, '^[ \t\r\f]') THEN 'space' WHEN starts_with(t, '//') THEN 'line_comment' WHEN starts_with(t, '/*') THEN 'block_comment' WHEN t = '##' THEN 'hash_hash' WHEN t = '#' THEN 'hash'
  WHEN regexp_matches(t, '^(u8|[LuU])?"') THEN 'string' WHEN regexp_matches(t, '^[LuU]?''') THEN 'char' WHEN regexp_matches(t, '^[A-Za-z_]') THEN 'identifier' WHEN regexp_matches(t, '^\.?[0-9]') THEN 'number' ELSE 'punctuation' END AS kind,
  count(*) AS n, sum(strlen(t))::BIGINT AS n_bytes FROM (SELECT unnest(regexp_extract_all(text, '{_CPP}')) AS t FROM documents WHERE text IS NOT NULL) GROUP BY kind""",
    "condition_policies": """
WITH x AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE ((p_partkey + 3) * p_size) // (p_size % 5) - 12 + CASE WHEN p_size > 25 THEN 1 ELSE 2 END END AS v, CASE WHEN p_size > 25 THEN 1 ELSE 2 END - 12 AS zero, p_partkey % 4 = 0 AS named FROM part)
SELECT p_partkey, coalesce(v, zero)::BIGINT AS lenient, v::BIGINT AS checked, CASE WHEN NOT named THEN v END::BIGINT AS constant FROM x""",
    "preprocessed_units": """
SELECT n_regionkey::BIGINT AS unit_id, 'once ' || string_agg(n_nationkey || '+n' || n_regionkey, ' ' ORDER BY n_nationkey) || CASE WHEN max(CASE WHEN n_nationkey IN (1, 2) THEN 1 ELSE 0 END) = 1 THEN ' yes' ELSE ' else' END AS words, 'partial' AS completeness
FROM nation GROUP BY n_regionkey""",
    "included_files": """
SELECT n_regionkey::BIGINT AS unit_id, 'n' || n_nationkey || '.h' AS path, 'include' AS role FROM nation
UNION ALL SELECT DISTINCT n_regionkey, 'inc/common.h', 'include' FROM nation UNION ALL SELECT DISTINCT n_regionkey, 'r' || n_regionkey || '.c', 'entry' FROM nation""",
    "effective_macros": """
SELECT n_regionkey::BIGINT AS unit_id, 'N' || n_nationkey AS name, 'n' || n_nationkey || '.h' AS file, 'bindable_constant' AS category FROM nation UNION ALL SELECT DISTINCT n_regionkey, 'ADD', 'inc/common.h', 'bindable_constant' FROM nation""",
    "extracted_declarations": """
SELECT 'nation' || n_nationkey AS name, 'record' AS kind, 'none' AS linkage, true AS complete, 2::BIGINT AS n, true AS defined FROM nation
UNION ALL SELECT 'nation' || n_nationkey || '_t', 'alias', 'none', false, 1, true FROM nation
UNION ALL SELECT 'kind' || n_nationkey, 'enum', 'none', true, 1, true FROM nation
UNION ALL SELECT 'find' || n_nationkey, 'function', 'external', false, 1, false FROM nation
UNION ALL SELECT 'region' || n_regionkey, 'record', 'none', false, 2 * count(*), false FROM nation GROUP BY n_regionkey""",
    "retained_declarations": """
WITH n AS (SELECT * FROM nation WHERE n_nationkey < 3)
SELECT 'find' || n_nationkey AS name, 'function' AS kind, 2::BIGINT AS need FROM n UNION ALL SELECT 'nation' || n_nationkey || '_t', 'alias', 1 FROM n
UNION ALL SELECT 'nation' || n_nationkey, 'record', 2 FROM n UNION ALL SELECT DISTINCT 'region' || n_regionkey, 'record', 1 FROM n""",
}
