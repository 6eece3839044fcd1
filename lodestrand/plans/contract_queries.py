"""Queries of exact integers, diagnostic tables and retained packages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrand.functions import integers
from lodestrand.operators import retention, validation
from lodestrand.sources.tables import table


def exact_integers(spark: SparkSession, d: str) -> DataFrame:
    """Lines as integers of 2 to some 80 digits under signs and zeros: which are exact, and which of them exceed 64 bits."""
    head = F.when(F.col("l_suppkey") % 5 == 0, "-").when(F.col("l_suppkey") % 5 == 1, "0").when(F.col("l_suppkey") % 5 == 2, "+").otherwise("")
    digits = F.expr("repeat(concat(cast(l_partkey AS string), cast(l_orderkey AS string)), cast(l_linenumber AS int))")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "N", integers.UNSIGNED).otherwise(integers.SIGNED).alias("sign"), F.concat(head, digits).alias("value"))
    read = integers.decode(F.to_json(F.struct("sign", "value")))
    wide = read.isNotNull() & (integers.order_key(F.col("value")) > integers.order_key(F.lit(str(2**64 - 1))))
    return rows.select("l_orderkey", "l_linenumber", "sign", "value", read.isNotNull().alias("exact"), wide.alias("wide"))


def diagnostic_table_violations(spark: SparkSession, d: str) -> DataFrame:
    """Orders as diagnostics of one target, their lines as related places: order, messages and targets."""
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("position"), F.col("o_orderpriority").alias("code"), (F.col("o_orderkey") % 3).alias("impact"), F.when(F.col("o_orderkey") % 17 == 0, "").otherwise(F.col("o_orderstatus")).alias("message"),
        F.lit("f").alias("file"), F.col("o_custkey").alias("start"), F.col("o_orderkey").alias("end"), F.lit("d").alias("declaration"), F.when(F.col("o_orderkey") % 23 == 0, "other").otherwise("t").alias("target"),
    )
    # line numbers repeat, so lines are numbered anew within their order
    number = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("of"), number.alias("position"), F.col("l_returnflag").alias("file"), F.col("l_partkey").alias("start"), F.col("l_suppkey").alias("end"), F.lit("m").alias("message"))
    return validation.diagnostic_violations(o, "t").unionByName(validation.related_violations(lines))


def retained_package(spark: SparkSession, d: str) -> DataFrame:
    """Parts need their suppliers, suppliers nations, nations regions; what the parts of one size keep, of diagnostics (orders) and reasons too."""
    part, supplier, nation, region = (table(spark, d, t) for t in ("part", "supplier", "nation", "region"))
    of = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    held = lambda df, kind, c: df.select(of(kind, c).alias("id"), F.lit("record").alias("kind"), F.lit(0).alias("support"))
    declarations = validation.together(held(part, "part", "p_partkey"), held(supplier, "supplier", "s_suppkey"), held(nation, "nation", "n_nationkey"), held(region, "region", "r_regionkey"))
    line = table(spark, d, "lineitem")
    edge = lambda df, a, b: df.select(a.alias("src"), b.alias("dst"), F.lit(2).alias("need"))
    edges = validation.together(
        edge(line, of("part", "l_partkey"), of("supplier", "l_suppkey")).distinct(), edge(supplier, of("supplier", "s_suppkey"), of("nation", "s_nationkey")), edge(nation, of("nation", "n_nationkey"), of("region", "n_regionkey"))
    )
    diagnostics = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("position"), F.col("o_orderpriority").alias("code"), F.col("o_orderstatus").alias("message"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"),
        (F.col("o_orderkey") % 2).cast("int").alias("impact"), F.when(F.col("o_orderkey") % 4 != 0, of("part", "o_custkey")).alias("declaration"),
    )
    roots = retention.selection(declarations, part.where("p_size = 7").select(of("part", "p_partkey").alias("id")))
    occurrences = line.select(of("part", "l_partkey").alias("of"), F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("key"))
    kept, state = retention.retain({"declarations": declarations, "occurrences": occurrences, "diagnostics": diagnostics}, edges, roots)
    row = lambda df, name, key: df.select(F.lit(name).alias("part_of"), key.alias("key"))
    return validation.together(
        row(kept["declarations"], "declarations", F.col("id")),
        row(kept["occurrences"], "occurrences", F.col("key")),
        row(kept["diagnostics"], "diagnostics", F.col("position").cast("string")),
        row(kept["reasons"], "reasons", F.concat_ws("|", F.col("position").cast("string"), "code", "message")),
        row(spark.range(1), "state", F.lit(state)),
    )


QUERIES = {f.__name__: f for f in (exact_integers, diagnostic_table_violations, retained_package)}
SQL = {
    "exact_integers": r"""
WITH v AS (
  SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN 'unsigned' ELSE 'signed' END AS sign,
    CASE l_suppkey % 5 WHEN 0 THEN '-' WHEN 1 THEN '0' WHEN 2 THEN '+' ELSE '' END || repeat(l_partkey::VARCHAR || l_orderkey::VARCHAR, l_linenumber) AS value FROM lineitem),
e AS (
  SELECT *, CASE WHEN regexp_full_match(value, '0|-?[1-9][0-9]*') AND sign = 'signed' THEN try_cast(value AS HUGEINT) END AS s,
    CASE WHEN regexp_full_match(value, '0|[1-9][0-9]*') AND sign = 'unsigned' THEN try_cast(value AS UHUGEINT) END AS u FROM v)
SELECT l_orderkey, l_linenumber, sign, value, s IS NOT NULL OR u IS NOT NULL AS exact,
  coalesce(s > 18446744073709551615::HUGEINT, u > 18446744073709551615::UHUGEINT, false) AS wide FROM e""",
    "diagnostic_table_violations": """
WITH o AS (
  SELECT o_orderkey AS position, row(o_orderpriority, o_orderkey % 3, CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE o_orderstatus END, o_custkey, o_orderkey) AS k FROM orders),
w AS (SELECT position, k, lag(k) OVER (ORDER BY position) AS was FROM o),
n AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS position, row(l_returnflag, l_partkey, l_suppkey) AS k FROM lineitem),
l AS (SELECT *, lag(k) OVER (PARTITION BY l_orderkey ORDER BY position) AS was FROM n)
SELECT 'diagnostics[' || position || ']' AS path, 'non_canonical_order' AS code FROM w WHERE was IS NOT NULL AND NOT was < k
UNION ALL SELECT 'diagnostics[' || o_orderkey || '].message', 'invalid_name' FROM orders WHERE o_orderkey % 17 = 0
UNION ALL SELECT 'diagnostics[' || o_orderkey || '].target', 'invalid_target' FROM orders WHERE o_orderkey % 23 = 0
UNION ALL SELECT 'diagnostics[' || l_orderkey || '].related[' || position || ']', 'non_canonical_order' FROM l WHERE was IS NOT NULL AND NOT was < k""",
    "retained_package": """
WITH RECURSIVE e(src, dst) AS (
  SELECT DISTINCT 'part:' || l_partkey, 'supplier:' || l_suppkey FROM lineitem UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation),
c(id) AS (SELECT 'part:' || p_partkey FROM part WHERE p_size = 7 UNION SELECT dst FROM c JOIN e ON c.id = e.src),
g AS (SELECT *, o_orderkey % 2 AS impact FROM orders WHERE o_orderkey % 4 = 0 OR 'part:' || o_custkey IN (SELECT id FROM c)),
r AS (SELECT DISTINCT o_orderpriority, o_orderstatus FROM g WHERE impact > 0)
SELECT 'declarations' AS part_of, id AS key FROM c
UNION ALL SELECT 'occurrences', l_orderkey || '/' || l_linenumber FROM lineitem WHERE 'part:' || l_partkey IN (SELECT id FROM c)
UNION ALL SELECT 'diagnostics', o_orderkey::VARCHAR FROM g
UNION ALL SELECT 'reasons', (row_number() OVER (ORDER BY o_orderpriority, o_orderstatus) - 1) || '|' || o_orderpriority || '|' || o_orderstatus FROM r
UNION ALL SELECT 'state', CASE WHEN coalesce(max(impact), 0) > 0 THEN 'partial' ELSE 'complete' END FROM g""",
}
