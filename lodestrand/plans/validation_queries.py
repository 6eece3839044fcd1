"""Queries of the validation operators: order of whole tables, files, references, ids, types, sequences and multisets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions import ids
from lodestrand.operators import order, validation
from lodestrand.sources.tables import table


def global_order_breaks(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the whole table, ranked by order and number, whose part and supplier are not above those of the line before."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return order.order_breaks(order.ranked(lines, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "position"), "position", ["l_partkey", "l_suppkey"])


def file_table_violations(spark: SparkSession, d: str) -> DataFrame:
    """Pages as a file table: the path is the url's without its scheme, some ids and line starts are wrong."""
    path = F.regexp_replace("url", "^[a-z]+://", "")
    length = F.octet_length("html").cast("long")
    starts = F.array(F.when(F.col("page_id") % 11 == 0, 1).otherwise(0).cast("long"), F.instr("html", "<").cast("long"), length - F.col("page_id") % 3 + 1)
    files = table(spark, d, "pages").select(F.col("page_id").alias("position"), F.when(F.col("page_id") % 7 == 0, ids.file_id(F.concat(path, F.lit("x")))).otherwise(ids.file_id(path)).alias("id"), F.when(F.col("page_id") % 13 == 0, F.concat(F.lit("./"), path)).otherwise(path).alias("logical_path"), length.alias("byte_len"), starts.alias("line_starts"))
    return validation.file_violations(files)


def polymorphic_references(spark: SparkSession, d: str) -> DataFrame:
    """Lines refer to orders, parts and suppliers, each with a range: one check of all kinds, where some keys are gone and ranges too long."""
    line = table(spark, d, "lineitem")
    of = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).alias("id"))
    refs = line.select("l_orderkey", "l_linenumber", (F.col("l_quantity") - 40).cast("long").alias("start"), F.col("l_quantity").cast("long").alias("end"), F.col("l_returnflag").alias("role"), F.explode(F.array(of("order", "l_orderkey"), of("part", "l_partkey"), of("supplier", "l_suppkey"))).alias("r"))
    path = F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), "r.kind")
    refs = refs.select(path.alias("path"), "r.kind", "r.id", F.greatest("start", F.lit(0).cast("long")).alias("start"), "end", "role")
    keys = validation.together(
        table(spark, d, "orders").where("o_orderkey % 97 <> 0").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.lit(50).cast("long").alias("byte_len"), F.lit(None).cast("string").alias("role")),
        table(spark, d, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("byte_len"), F.lit(None).cast("string").alias("role")),
        table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.lit(49).cast("long").alias("byte_len"), F.when(F.col("s_suppkey") % 2 == 0, "A").alias("role")),
    )
    return validation.reference_violations(refs, keys)


def sequence_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """Per user: event types by time beside event types by number, without each fiftieth event."""
    events = table(spark, d, "events")
    from pyspark.sql import Window as W

    numbered = lambda df, *by: df.select("user_id", F.row_number().over(W.partitionBy("user_id").orderBy(*by)).cast("long").alias("position"), "event_type")
    return order.sequence_differences(numbered(events, "ts", "event_id"), numbered(events.where("event_id % 50 <> 0"), "event_id"), ["user_id"], "position", "event_type")


def completeness_correspondence(spark: SparkSession, d: str) -> DataFrame:
    """Reasons of users beside their error events, both as multisets: what one side has more often."""
    errors = table(spark, d, "events").where("event_type = 'error'").select("user_id", F.floor("value").cast("long").alias("code"), "event_id")
    return order.unmatched(errors.where("event_id % 3 <> 0").select("user_id", "code"), errors.where("event_id % 3 <> 1").select("user_id", "code"), ["user_id", "code"])


def recomputed_ids(spark: SparkSession, d: str) -> DataFrame:
    """Orders as declarations named after their customers and scoped by status, each ninth under a wrong id, each tenth without a name."""
    o = table(spark, d, "orders")
    name = F.when(F.col("o_orderkey") % 10 != 0, F.concat(F.lit("c"), F.col("o_custkey").cast("string")))
    scope = F.when(F.col("o_orderstatus") == "F", "file").otherwise("unit")
    owner = F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))
    tokens, ordinal = F.col("o_orderpriority"), F.col("o_orderkey")
    right = F.coalesce(ids.entity_id(F.lit("ordinary"), scope, owner, name), ids.anonymous_id(scope, owner, tokens, ordinal))
    wrong = ids.entity_id(F.lit("tag"), scope, owner, F.coalesce(name, F.lit("x")))
    rows = o.select(F.col("o_orderkey").alias("position"), F.when(F.col("o_orderkey") % 9 == 0, wrong).otherwise(right).alias("id"), F.lit("ordinary").alias("namespace"), scope.alias("scope"), owner.alias("owner"), F.when(F.col("o_orderkey") % 8 == 1, F.lit("")).otherwise(name).alias("name"), tokens.alias("tokens"), ordinal.alias("ordinal"))
    return validation.declaration_id_violations(rows)


def type_tree_violations(spark: SparkSession, d: str) -> DataFrame:
    """Lines as type trees: each order is one, its lines lie below each other by number, kinds come from quantities, references go to parts."""
    kinds = ("pointer", "array", "function", "void", "integer", "alias_ref", "record_ref", "odd")
    line = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("k"), F.col("l_quantity").cast("long").alias("q"), "l_partkey", "l_suppkey")
    # line k hangs below line k div 2, so node 1 is the root
    path = lambda k: F.array_join(F.transform(F.filter(F.split(F.bin(k), ""), lambda x: x != ""), lambda x: x), ".")
    nodes = line.select(
        F.col("l_orderkey").alias("tree"), path(F.col("k")).alias("node"), F.when(F.col("k") > 1, path(F.expr("k div 2"))).alias("parent"), (F.col("k") % 2).alias("ordinal"),
        F.element_at(F.array(*map(F.lit, kinds)), (F.col("q") % len(kinds)).cast("int") + 1).alias("kind"), F.element_at(F.array(*map(F.lit, ("general", "parameter", "field"))), (F.col("l_suppkey") % 3).cast("int") + 1).alias("context"),
        F.when((F.col("q") % len(kinds)).isin(5, 6), F.col("l_partkey")).alias("ref"), F.when(F.col("q") % 8 == 1, F.when(F.col("q") > 30, "07").otherwise(F.col("q").cast("string"))).alias("bound"),
    )
    declarations = table(spark, d, "part").where("p_partkey % 19 <> 0").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, "alias").otherwise("record").alias("kind"))
    return validation.type_violations(nodes, declarations, most_depth=1)


QUERIES = {f.__name__: f for f in (global_order_breaks, file_table_violations, polymorphic_references, sequence_reconciliation, completeness_correspondence, recomputed_ids, type_tree_violations)}
_FRAME = lambda *xs: " || ".join(f"strlen({x})::VARCHAR || ':' || {x}" for x in xs)
SQL = {
    "global_order_breaks": """
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS position FROM lineitem),
p AS (SELECT *, lag(l_partkey) OVER w AS pp, lag(l_suppkey) OVER w AS ps FROM l WINDOW w AS (ORDER BY position))
SELECT position, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM p WHERE pp IS NOT NULL AND NOT (pp < l_partkey OR pp = l_partkey AND ps < l_suppkey)""",
    "file_table_violations": f"""
WITH p AS (SELECT page_id AS position, regexp_replace(url, '^[a-z]+://', '') AS raw, strlen(html) AS byte_len, [CASE WHEN page_id % 11 = 0 THEN 1 ELSE 0 END, instr(html, '<'), strlen(html) - page_id % 3 + 1] AS ls FROM pages),
c AS (SELECT *, list_filter(string_split(raw, '/'), lambda x: x <> '' AND x <> '.') AS parts, list_filter(string_split(raw || 'x', '/'), lambda x: x <> '' AND x <> '.') AS parts_x FROM p),
n AS (SELECT *, array_to_string(parts, '/') AS canon, array_to_string(parts_x, '/') AS canon_x, CASE WHEN position % 13 = 0 THEN './' || raw ELSE raw END AS logical_path FROM c),
f AS (SELECT *, CASE WHEN position % 7 = 0 THEN 'file1_' || sha256({_FRAME("'file-id'", "canon_x")}) ELSE 'file1_' || sha256({_FRAME("'file-id'", "canon")}) END AS id, 'file1_' || sha256({_FRAME("'file-id'", "canon")}) AS made FROM n),
o AS (SELECT *, lag(id) OVER (ORDER BY position) AS was, min(position) OVER (PARTITION BY id) AS first FROM f)
SELECT 'files[' || position || ']' AS path, 'non_canonical_order' AS code FROM o WHERE was >= id
UNION ALL SELECT 'files[' || position || '].id', 'duplicate_id' FROM o WHERE position > first
UNION ALL SELECT 'files[' || position || '].logical_path', 'invalid_file' FROM o WHERE logical_path <> canon
UNION ALL SELECT 'files[' || position || '].id', 'invalid_id' FROM o WHERE id <> made
UNION ALL SELECT 'files[' || position || '].line_starts', 'invalid_file' FROM o WHERE NOT (ls[1] = 0 AND ls[1] < ls[2] AND ls[2] < ls[3] AND ls[3] <= byte_len)""",
    "polymorphic_references": """
WITH r AS (
  SELECT l_orderkey || '/' || l_linenumber || '/' || kind AS path, kind, CASE kind WHEN 'order' THEN l_orderkey WHEN 'part' THEN l_partkey ELSE l_suppkey END AS id,
    greatest(trunc(l_quantity - 40), 0)::BIGINT AS s, trunc(l_quantity)::BIGINT AS e, l_returnflag AS role
  FROM lineitem, (VALUES ('order'), ('part'), ('supplier')) k(kind)),
k AS (
  SELECT 'order' AS kind, o_orderkey AS id, 50 AS n, NULL AS role FROM orders WHERE o_orderkey % 97 <> 0
  UNION ALL SELECT 'part', p_partkey, p_size, NULL FROM part
  UNION ALL SELECT 'supplier', s_suppkey, 49, CASE WHEN s_suppkey % 2 = 0 THEN 'A' END FROM supplier),
m AS (
  SELECT path, CASE WHEN k.id IS NULL THEN 'invalid_reference' WHEN s > e OR e > n THEN 'invalid_range' WHEN r.role <> k.role THEN 'invalid_file' END AS code
  FROM r LEFT JOIN k ON r.kind = k.kind AND r.id = k.id)
SELECT path, code FROM m WHERE code IS NOT NULL""",
    "sequence_reconciliation": """
WITH a AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position, event_type FROM events),
b AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS position, event_type FROM events WHERE event_id % 50 <> 0),
o AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, min(CASE WHEN a.event_type IS DISTINCT FROM b.event_type THEN coalesce(a.position, b.position) END) AS first_difference FROM a FULL JOIN b ON a.user_id = b.user_id AND a.position = b.position GROUP BY 1),
c AS (SELECT user_id, event_type, sum(s) AS n FROM (SELECT user_id, event_type, 1 AS s FROM a UNION ALL SELECT user_id, event_type, -1 FROM b) GROUP BY 1, 2),
m AS (SELECT user_id, bool_and(n = 0) AS same_members FROM c GROUP BY 1)
SELECT user_id, same_members, first_difference IS NULL AS same_order, first_difference FROM o JOIN m USING (user_id)""",
    "completeness_correspondence": """
WITH e AS (SELECT user_id, floor(value)::BIGINT AS code, event_id FROM events WHERE event_type = 'error'),
a AS (SELECT user_id, code, row_number() OVER (PARTITION BY user_id, code ORDER BY event_id) AS k FROM e WHERE event_id % 3 <> 0),
b AS (SELECT user_id, code, row_number() OVER (PARTITION BY user_id, code ORDER BY event_id) AS k FROM e WHERE event_id % 3 <> 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.code, b.code) AS code, count(*) AS n, CASE WHEN a.k IS NULL THEN 'missing' ELSE 'extra' END AS problem
FROM a FULL JOIN b ON a.user_id = b.user_id AND a.code = b.code AND a.k = b.k WHERE a.k IS NULL OR b.k IS NULL GROUP BY 1, 2, 4""",
    "recomputed_ids": f"""
WITH o AS (
  SELECT o_orderkey AS position, CASE WHEN o_orderkey % 10 <> 0 THEN 'c' || o_custkey END AS nm, CASE WHEN o_orderstatus = 'F' THEN 'file' ELSE 'unit' END AS scope,
    CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE '' END AS owner, o_orderpriority AS tokens, o_orderkey::VARCHAR AS ordinal FROM orders),
i AS (SELECT *, coalesce('decl1_' || sha256({_FRAME("'entity-id'", "'ordinary'", "scope", "owner", "nm")}), 'decl1_' || sha256({_FRAME("'entity-id'", "'anonymous'", "scope", "owner", "tokens", "ordinal")})) AS good,
    'decl1_' || sha256({_FRAME("'entity-id'", "'tag'", "scope", "owner", "coalesce(nm, 'x')")}) AS wrong, CASE WHEN position % 8 = 1 THEN '' ELSE nm END AS name FROM o),
m AS (SELECT *, CASE WHEN position % 9 = 0 THEN wrong ELSE good END AS id, CASE WHEN name = '' THEN NULL WHEN name IS NOT NULL THEN 'decl1_' || sha256({_FRAME("'entity-id'", "'ordinary'", "scope", "owner", "name")}) ELSE 'decl1_' || sha256({_FRAME("'entity-id'", "'anonymous'", "scope", "owner", "tokens", "ordinal")}) END AS made FROM i)
SELECT 'declarations[' || position || '].id' AS path, 'invalid_id' AS code FROM m WHERE id IS DISTINCT FROM made
UNION ALL SELECT 'declarations[' || position || '].name', 'invalid_name' FROM m WHERE name = ''""",
    "type_tree_violations": """
WITH l AS (
  SELECT l_orderkey AS tree, l_linenumber AS k, l_linenumber % 2 AS ordinal, trunc(l_quantity)::BIGINT AS q, l_partkey, ['pointer', 'array', 'function', 'void', 'integer', 'alias_ref', 'record_ref', 'odd'][trunc(l_quantity)::INT % 8 + 1] AS kind,
    ['general', 'parameter', 'field'][l_suppkey % 3 + 1] AS context FROM lineitem),
d AS (SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'alias' ELSE 'record' END AS of FROM part WHERE p_partkey % 19 <> 0),
n AS (
  SELECT l.*, array_to_string(string_split(bin(l.k), ''), '.') AS node, p.kind AS pk, p.k AS pid, c.n AS n, c.lo, c.hi, d.of, CASE WHEN l.q % 8 = 1 THEN CASE WHEN l.q > 30 THEN '07' ELSE l.q::VARCHAR END END AS bound
  FROM l LEFT JOIN l p ON p.tree = l.tree AND p.k = l.k // 2 AND l.k > 1
  LEFT JOIN (SELECT tree, k // 2 AS k, count(*) AS n, min(ordinal) AS lo, max(ordinal) AS hi FROM l WHERE k > 1 GROUP BY 1, 2) c ON c.tree = l.tree AND c.k = l.k
  LEFT JOIN d ON l.kind IN ('alias_ref', 'record_ref') AND d.id = l.l_partkey),
v AS (
  SELECT tree, node, 'kind' AS f, 'invalid_type' AS code FROM n WHERE kind = 'odd'
  UNION ALL SELECT tree, node, 'parts', 'invalid_type' FROM n WHERE kind IN ('pointer', 'array') AND coalesce(n, 0) <> 1 OR kind IN ('void', 'integer', 'alias_ref', 'record_ref') AND coalesce(n, 0) <> 0 OR kind = 'function' AND n IS NULL
  UNION ALL SELECT tree, node, 'parts', 'non_canonical_order' FROM n WHERE n > 0 AND (lo <> 0 OR hi <> n - 1)
  UNION ALL SELECT tree, node, 'element', 'invalid_type' FROM n WHERE pk = 'array' AND kind IN ('function', 'void')
  UNION ALL SELECT tree, node, 'result', 'invalid_type' FROM n WHERE pk = 'function' AND ordinal = 0 AND kind IN ('function', 'array')
  UNION ALL SELECT tree, node, 'parameter', 'invalid_type' FROM n WHERE (pk = 'function' AND ordinal > 0 OR k = 1 AND context = 'parameter') AND kind IN ('array', 'function', 'void')
  UNION ALL SELECT tree, node, 'field', 'invalid_type' FROM n WHERE k = 1 AND context = 'field' AND kind IN ('function', 'void')
  UNION ALL SELECT tree, node, 'bound', 'invalid_type' FROM n WHERE bound IS NOT NULL AND NOT regexp_full_match(bound, '0|[1-9][0-9]*')
  UNION ALL SELECT tree, node, 'ref', 'invalid_reference' FROM n WHERE kind IN ('alias_ref', 'record_ref') AND (of IS NULL OR of || '_ref' <> kind)
  UNION ALL SELECT tree, node, 'parent', 'invalid_reference' FROM n WHERE k > 1 AND pid IS NULL
  UNION ALL SELECT tree, node, 'depth', 'limit_exceeded' FROM n WHERE strlen(bin(k)) > 2)
SELECT tree || ':' || node || '.' || f AS path, code FROM v""",
}
