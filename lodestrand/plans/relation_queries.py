"""Queries of the set, closure and encoding operators over the relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.operators import closure, sets
from lodestrand.sources.tables import table


def _named(kind: str, c: Column) -> Column:
    return F.concat(F.lit(kind + ":"), c.cast("string"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """References order to customer to nation to region, and supplier to nation; a nation is needed in full by customers only."""
    orders, customer, nation, supplier = (table(spark, d, t) for t in ("orders", "customer", "nation", "supplier"))
    pairs = [
        orders.select(_named("order", F.col("o_orderkey")).alias("src"), _named("customer", F.col("o_custkey")).alias("dst"), F.lit(2).alias("need")),
        customer.select(_named("customer", F.col("c_custkey")).alias("src"), _named("nation", F.col("c_nationkey")).alias("dst"), F.lit(2).alias("need")),
        supplier.select(_named("supplier", F.col("s_suppkey")).alias("src"), _named("nation", F.col("s_nationkey")).alias("dst"), F.lit(1).alias("need")),
        nation.select(_named("nation", F.col("n_nationkey")).alias("src"), _named("region", F.col("n_regionkey")).alias("dst"), F.lit(1).alias("need")),
    ]
    out = pairs[0]
    for p in pairs[1:]:
        out = out.unionByName(p)
    return out


def retain_closure(spark: SparkSession, d: str) -> DataFrame:
    """All that dear orders refer to."""
    roots = table(spark, d, "orders").where("o_totalprice > 400000").select(_named("order", F.col("o_orderkey")).alias("id"), F.lit(2).alias("need"))
    return closure.closure(roots, _edges(spark, d)).select("id")


def closure_requirement(spark: SparkSession, d: str) -> DataFrame:
    """What all suppliers and orders need, and how much of it."""
    suppliers = table(spark, d, "supplier").select(_named("supplier", F.col("s_suppkey")).alias("id"), F.lit(2).alias("need"))
    orders = table(spark, d, "orders").select(_named("order", F.col("o_orderkey")).alias("id"), F.lit(2).alias("need"))
    return closure.closure(suppliers.unionByName(orders), _edges(spark, d)).select("id", F.col("need").cast("long").alias("need"))


def closure_missing_root(spark: SparkSession, d: str) -> DataFrame:
    return closure.missing(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


def _copies(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two overlapping parts of orders; the second has another price for some keys."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    left = orders.where("o_orderkey % 3 <> 0")
    right = orders.where("o_orderkey % 3 <> 1").withColumn("cents", F.when(F.col("o_orderkey") % 11 == 0, F.col("cents") + 1).otherwise(F.col("cents")))
    return left, right


def merge_checked_union(spark: SparkSession, d: str) -> DataFrame:
    return sets.checked_union(*_copies(spark, d), ["o_orderkey"])


def merge_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return sets.conflicts(*_copies(spark, d), ["o_orderkey"])


def set_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """Customers with orders against customers in credit."""
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    return sets.reconcile(orders.select(F.col("o_custkey").alias("custkey")), customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("custkey")))


def fk_violations(spark: SparkSession, d: str) -> DataFrame:
    """Line items whose order or part is gone, by table; parts of size over 45 are left out so that some are."""
    items = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    a = sets.dangling(items, "l_orderkey", table(spark, d, "orders"), "o_orderkey").select(F.lit("orders").alias("lacks"), F.col("l_orderkey").alias("key"))
    b = sets.dangling(items, "l_partkey", table(spark, d, "part").where("p_size <= 45"), "p_partkey").select(F.lit("part").alias("lacks"), F.col("l_partkey").alias("key"))
    return a.unionByName(b).groupBy("lacks", "key").agg(F.count("*").cast("long").alias("n"))


def strict_order_check(spark: SparkSession, d: str) -> DataFrame:
    """Line items that don't rise strictly by line number within their order; full rows break ties."""
    items = table(spark, d, "lineitem")
    bad = sets.order_violations(items, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], F.col("l_linenumber"))
    return bad.groupBy("l_orderkey").agg(F.count("*").cast("long").alias("n_violations"))


def first_match_resolution(spark: SparkSession, d: str) -> DataFrame:
    """For each order: its customer if in credit, else a supplier of that number, else nothing."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, d, "customer").where("c_acctbal > 5000").select("c_custkey", F.col("c_name").alias("name"))
    suppliers = table(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("name"))
    return sets.first_match(orders, [("customer", customers, F.col("o_custkey") == F.col("c_custkey")), ("supplier", suppliers, F.col("o_custkey") == F.col("s_suppkey"))], ["o_orderkey"], "name")


def checked_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    """Products that overflow 64 bits and divisions by zero are null, shifts out of range too."""
    big = (F.col("p_partkey") + 1) * 5_000_000_000_000_000
    shift = F.when((F.col("p_size") >= 0) & (F.col("p_size") < 40), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p_size")))
    return table(spark, d, "part").select("p_partkey", F.try_multiply(big, F.col("p_size").cast("long")).alias("product"), F.try_divide(F.col("p_partkey").cast("double"), F.col("p_size") % 7).alias("quotient"), shift.alias("shifted"))


def canonical_json_encode(spark: SparkSession, d: str) -> DataFrame:
    """One line of JSON for each nation, fields in order and nulls written."""
    row = F.struct("n_nationkey", "n_name", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey")).alias("n_regionkey"))
    return table(spark, d, "nation").select("n_nationkey", F.to_json(row, {"ignoreNullFields": "false"}).alias("json"))


def print_tree(spark: SparkSession, d: str) -> DataFrame:
    """Regions with their nations indented below, in order."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    lines = nation.groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    body = F.concat(F.col("r_name"), F.lit("\n"), F.array_join(F.transform("names", lambda n: F.concat(F.repeat(F.lit(" "), F.lit(4)), n)), "\n"))
    return region.join(lines, F.col("r_regionkey") == F.col("n_regionkey")).select("r_regionkey", body.alias("tree"))


def identity_digests(spark: SparkSession, d: str) -> DataFrame:
    """Content-derived ids of customers: length-framed fields, hashed, behind a typed prefix."""
    from lodestrand.functions.text import fingerprint

    fields = F.array(F.lit("customer"), F.col("c_nationkey").cast("string"), F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", fingerprint("ent1_", fields).alias("id"))


QUERIES = {
    f.__name__: f
    for f in (retain_closure, closure_requirement, closure_missing_root, merge_checked_union, merge_conflicts, set_reconciliation, fk_violations, strict_order_check, first_match_resolution, checked_arithmetic, canonical_json_encode, print_tree, identity_digests)
}
_EDGES = """e(src, dst, need) AS (
  SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 2 FROM orders UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 2 FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 1 FROM supplier UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 1 FROM nation)"""
_COPIES = """o AS (SELECT o_orderkey, o_custkey, round(o_totalprice * 100)::BIGINT AS cents FROM orders),
u AS (SELECT * FROM o WHERE o_orderkey % 3 <> 0 UNION SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 11 = 0 THEN cents + 1 ELSE cents END FROM o WHERE o_orderkey % 3 <> 1)"""
SQL = {
    "retain_closure": f"""WITH RECURSIVE {_EDGES},
c(id) AS (SELECT 'order:' || o_orderkey FROM orders WHERE o_totalprice > 400000 UNION SELECT dst FROM c JOIN e ON c.id = e.src) SELECT id FROM c""",
    "closure_requirement": f"""WITH RECURSIVE {_EDGES},
c(id, need) AS (SELECT 'supplier:' || s_suppkey, 2 FROM supplier UNION SELECT 'order:' || o_orderkey, 2 FROM orders UNION SELECT dst, e.need FROM c JOIN e ON c.id = e.src)
SELECT id, max(need)::BIGINT AS need FROM c GROUP BY id""",
    "closure_missing_root": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "merge_checked_union": f"WITH {_COPIES} SELECT *, count(*) OVER (PARTITION BY o_orderkey) AS n_variants FROM u",
    "merge_conflicts": f"WITH {_COPIES} SELECT o_orderkey, count(*) AS n_variants FROM u GROUP BY o_orderkey HAVING count(*) > 1",
    "set_reconciliation": """WITH a AS (SELECT DISTINCT o_custkey AS custkey FROM orders), b AS (SELECT DISTINCT c_custkey AS custkey FROM customer WHERE c_acctbal > 0)
SELECT custkey, 'left_only' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT custkey, 'right_only' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    "fk_violations": """SELECT 'orders' AS lacks, l_orderkey AS key, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey
UNION ALL SELECT 'part', l_partkey, count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 45) GROUP BY l_partkey""",
    "strict_order_check": """SELECT l_orderkey, count(*) AS n_violations FROM (SELECT l_orderkey, l_linenumber, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS was FROM lineitem)
WHERE was IS NOT NULL AND NOT was < l_linenumber GROUP BY l_orderkey""",
    "first_match_resolution": """SELECT o_orderkey, CASE WHEN c_custkey IS NOT NULL THEN 'customer' WHEN s_suppkey IS NOT NULL THEN 'supplier' END AS resolved_by, CASE WHEN c_custkey IS NOT NULL THEN c_name ELSE s_name END AS name
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) ON o_custkey = c_custkey LEFT JOIN supplier ON o_custkey = s_suppkey""",
    "checked_arithmetic": """SELECT p_partkey, CASE WHEN (p_partkey + 1)::HUGEINT * 5000000000000000 * p_size <= 9223372036854775807 THEN ((p_partkey + 1)::HUGEINT * 5000000000000000 * p_size)::BIGINT END AS product,
  CASE WHEN p_size % 7 <> 0 THEN p_partkey::DOUBLE / (p_size % 7) END AS quotient, CASE WHEN p_size < 40 THEN 1::BIGINT << p_size END AS shifted FROM part""",
    "canonical_json_encode": """SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey::VARCHAR ELSE 'null' END || '}' AS json FROM nation""",
    "print_tree": """SELECT r_regionkey, r_name || chr(10) || string_agg('    ' || n_name, chr(10) ORDER BY n_name) AS tree FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_regionkey, r_name""",
    "identity_digests": """SELECT c_custkey, 'ent1_' || sha256('8:customer' || strlen(c_nationkey::VARCHAR) || ':' || c_nationkey || strlen(c_name) || ':' || c_name) AS id FROM customer""",
}
