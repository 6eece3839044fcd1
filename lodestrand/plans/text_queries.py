"""Queries of the text operators over documents, pages, benchmark and part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions import text as T
from lodestrand.operators import intervals
from lodestrand.sources.tables import table

_TOKEN = r"[A-Za-z_][A-Za-z0-9_]*|[0-9][A-Za-z0-9_.]*|[ \t\n\x0B\f\r]+|[^ \t\n\x0B\f\rA-Za-z0-9_]"
_SPACE = r"^[ \t\n\x0B\f\r]"
_ALL = f"regexp_extract_all(coalesce(text, ''), '{_TOKEN}')"


def lex_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Per document: tokens and distinct identifiers."""
    rows = table(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("ts"))
    names = F.array_distinct(F.filter("ts", T.is_identifier))
    return rows.select("doc_id", F.size("ts").cast("long").alias("n_tokens"), F.size(names).cast("long").alias("n_identifiers"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Token counts joined with labels."""
    return lex_token_counts(spark, d).join(table(spark, d, "labels"), "doc_id").groupBy("quality", "toxic").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_identifiers").alias("n_identifiers"))


def lex_token_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Tokens by table and kind."""
    sides = [table(spark, d, t).select(F.lit(t).alias("side"), F.explode(T.tokens(F.col(c))).alias("token")) for t, c in (("documents", "text"), ("pages", "html"))]
    held = sides[0].unionByName(sides[1]).select("side", T.token_kind(F.col("token")).alias("kind"), F.octet_length("token").alias("size"))
    return held.groupBy("side", "kind").agg(F.count("*").cast("long").alias("n"), F.sum("size").cast("long").alias("n_bytes"))


def normalized_token_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprint of the significant tokens of documents and benchmark items."""
    sides = [table(spark, d, t).select(F.lit(t).alias("side"), F.col(k).alias("id"), T.fingerprint("tok1_", T.significant(T.tokens(F.col("text")))).alias("fingerprint")) for t, k in (("documents", "doc_id"), ("benchmark", "item_id"))]
    return sides[0].unionByName(sides[1])


def line_index(spark: SparkSession, d: str) -> DataFrame:
    """Per document: lines, and the byte offsets at which they start."""
    lines = T.line_table(table(spark, d, "documents"), "doc_id", "text")
    return lines.groupBy("doc_id").agg(F.count("*").cast("long").alias("n_lines"), F.max("start").alias("last_start"), F.sum("start").cast("long").alias("sum_starts"))


def byte_vs_char_length(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.length("text").cast("long").alias("n_code_points"))


def offset_to_line(spark: SparkSession, d: str) -> DataFrame:
    """Line and column of every 500th code point."""
    docs = table(spark, d, "documents")
    offsets = docs.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.length("text").cast("long"), F.lit(500).cast("long"))).alias("offset"))
    return intervals.locate(offsets, T.line_table(docs, "doc_id", "text", F.length), ["doc_id"])


def url_path_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Each page under the longest mapped root of its address."""
    pages = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^?#]*)", 1).alias("address"))
    hosts = pages.select(F.split("address", "/")[0].alias("root")).distinct().where(F.length("root") % 2 == 0)
    roots = hosts.select("root", F.concat(F.lit("host/"), F.length("root").cast("string")).alias("logical")).unionByName(hosts.select(F.concat("root", F.lit("/en")).alias("root"), F.lit("english").alias("logical")))
    out = intervals.longest_prefix(pages, F.col("address"), roots)
    return out.select("page_id", "root", "logical", F.when(F.col("root").isNotNull(), F.substring("address", F.length("root") + 1, 1 << 30)).alias("rest"))


def path_normalization(spark: SparkSession, d: str) -> DataFrame:
    """Logical paths of page addresses with doubled separators, dots, and climbing ones rejected."""
    raw = F.concat(F.regexp_extract("url", "^https?://([^?#]*)", 1), F.when(F.col("page_id") % 3 == 0, "/./a//b").when(F.col("page_id") % 3 == 1, "\\c\\d").otherwise("/../e"))
    return table(spark, d, "pages").select("page_id", T.normalize_path(raw).alias("logical_path"))


def radix_parse(spark: SparkSession, d: str) -> DataFrame:
    """Integer literals in four radices, made from part keys, and their values."""
    k = F.col("p_partkey")
    literal = F.when(k % 4 == 0, F.concat(F.lit("0x"), F.hex(k), F.lit("u"))).when(k % 4 == 1, F.concat(F.lit("0b"), F.bin(k))).when(k % 4 == 2, F.concat(F.lit("0"), F.conv(k.cast("string"), 10, 8))).otherwise(F.concat(k.cast("string"), F.when(k % 3 == 0, "UL").otherwise("q")))
    return table(spark, d, "part").select("p_partkey", literal.alias("literal")).select("p_partkey", "literal", T.parse_integer(F.col("literal")).alias("value"))


def token_offsets(spark: SparkSession, d: str) -> DataFrame:
    """The numbers of benchmark items with their byte ranges."""
    rows = T.token_table(table(spark, d, "benchmark"), "item_id", "text")
    return rows.groupBy("item_id", "kind").agg(F.count("*").cast("long").alias("n"), F.min("start").cast("long").alias("first_start"), F.max("end").cast("long").alias("last_end"))


def line_splicing(spark: SparkSession, d: str) -> DataFrame:
    """Texts whose line ends after commas are continued, spliced."""
    joined = F.replace(F.col("text"), F.lit(",\n"), F.lit(",\\\n"))
    spliced = T.splice_lines(F.replace(joined, F.lit(".\n"), F.lit(".\\\r\n")))
    return table(spark, d, "documents").select("doc_id", F.sha2(spliced, 256).alias("sha256"), F.octet_length(spliced).cast("long").alias("n_bytes"))


def visitor_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tags of pages by name."""
    tags = F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), 1)
    return table(spark, d, "pages").select("page_id", F.explode(tags).alias("kind")).groupBy("kind").agg(F.count("*").cast("long").alias("n"), F.count_distinct("page_id").cast("long").alias("n_pages"))


def subtree_filter(spark: SparkSession, d: str) -> DataFrame:
    """Tags within the navigation of each page: a pre-order interval test."""
    nav = F.regexp_extract("html", "(?s)<nav>(.*?)</nav>", 1)
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all(nav, F.lit("<([a-z][a-z0-9]*)"), 1)).alias("kind")).groupBy("page_id", "kind").agg(F.count("*").cast("long").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (lex_token_counts, lex_token_kinds, normalized_token_fingerprint, line_index, byte_vs_char_length, offset_to_line, url_path_mapping, path_normalization, radix_parse, token_offsets, line_splicing, visitor_counts, subtree_filter)
}
_LINES = "SELECT {key}, unnest(ls) AS content, generate_subscripts(ls, 1) AS line FROM (SELECT {key}, string_split(coalesce(text, ''), chr(10)) AS ls FROM {table})"
SQL = {
    "lex_token_counts": f"""SELECT doc_id, len(ts)::BIGINT AS n_tokens, len(list_distinct(list_filter(ts, lambda t: regexp_matches(t, '^[A-Za-z_]'))))::BIGINT AS n_identifiers FROM (SELECT doc_id, {_ALL} AS ts FROM documents)""",
    "lex_token_kinds": f"""
SELECT side, CASE WHEN regexp_matches(token, '^[A-Za-z_]') THEN 'identifier' WHEN regexp_matches(token, '^[0-9]') THEN 'number' WHEN regexp_matches(token, '{_SPACE}') THEN 'space' ELSE 'punctuation' END AS kind,
  count(*) AS n, sum(strlen(token))::BIGINT AS n_bytes
FROM (SELECT 'documents' AS side, unnest({_ALL}) AS token FROM documents UNION ALL SELECT 'pages', unnest({_ALL.replace("text", "html")}) FROM pages) GROUP BY ALL""",
    "normalized_token_fingerprint": f"""
SELECT side, id, 'tok1_' || sha256(coalesce(array_to_string(list_transform(list_filter(ts, lambda t: NOT regexp_matches(t, '{_SPACE}')), lambda t: strlen(t) || ':' || t), ''), '')) AS fingerprint
FROM (SELECT 'documents' AS side, doc_id AS id, {_ALL} AS ts FROM documents UNION ALL SELECT 'benchmark', item_id, {_ALL} FROM benchmark)""",
    "line_index": f"""
SELECT doc_id, count(*) AS n_lines, max(start)::BIGINT AS last_start, sum(start)::BIGINT AS sum_starts
FROM (SELECT doc_id, sum(strlen(content) + 1) OVER (PARTITION BY doc_id ORDER BY line) - strlen(content) - 1 AS start FROM ({_LINES.format(key="doc_id", table="documents")})) GROUP BY doc_id""",
    "byte_vs_char_length": "SELECT doc_id, strlen(text)::BIGINT AS n_bytes, length(text)::BIGINT AS n_code_points FROM documents",
    "offset_to_line": f"""
WITH l AS (SELECT doc_id, line, sum(length(content) + 1) OVER (PARTITION BY doc_id ORDER BY line) - length(content) - 1 AS start FROM ({_LINES.format(key="doc_id", table="documents")})),
o AS (SELECT doc_id, unnest(range(0, length(text) + 1, 500)) AS "offset" FROM documents WHERE text IS NOT NULL)
SELECT o.doc_id, o."offset"::BIGINT AS "offset", max(line)::BIGINT AS line, (o."offset" - max(start) + 1)::BIGINT AS "column" FROM o JOIN l ON o.doc_id = l.doc_id AND l.start <= o."offset" GROUP BY o.doc_id, o."offset" """,
    "url_path_mapping": """
WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^?#]*)', 1) AS address FROM pages),
h AS (SELECT DISTINCT split_part(address, '/', 1) AS root FROM p WHERE length(split_part(address, '/', 1)) % 2 = 0),
r AS (SELECT root, 'host/' || length(root) AS logical FROM h UNION ALL SELECT root || '/en', 'english' FROM h),
b AS (SELECT page_id, arg_max(root, length(root)) AS root, arg_max(logical, length(root)) AS logical FROM p JOIN r ON address = root OR starts_with(address, root || '/') GROUP BY page_id)
SELECT p.page_id, root, logical, CASE WHEN root IS NOT NULL THEN substring(address, length(root) + 1) END AS rest FROM p LEFT JOIN b USING (page_id)""",
    "path_normalization": r"""
WITH p AS (SELECT page_id, replace(regexp_extract(url, '^https?://([^?#]*)', 1) || CASE page_id % 3 WHEN 0 THEN '/./a//b' WHEN 1 THEN '\c\d' ELSE '/../e' END, '\', '/') AS path FROM pages),
q AS (SELECT page_id, path, list_filter(string_split(path, '/'), lambda c: c NOT IN ('', '.')) AS parts FROM p)
SELECT page_id, CASE WHEN NOT (starts_with(path, '/') OR list_contains(parts, '..') OR regexp_matches(path, '^[A-Za-z]:') OR len(parts) = 0) THEN array_to_string(parts, '/') END AS logical_path FROM q""",
    "radix_parse": """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '0x' || to_hex(p_partkey) || 'u' WHEN 1 THEN '0b' || to_binary(p_partkey) WHEN 2 THEN '0' || printf('%o', p_partkey)
    ELSE p_partkey || CASE WHEN p_partkey % 3 = 0 THEN 'UL' ELSE 'q' END END AS literal,
  CASE WHEN p_partkey % 4 = 3 AND p_partkey % 3 <> 0 THEN NULL ELSE p_partkey END AS value FROM part""",
    "token_offsets": f"""
WITH t AS (SELECT item_id, unnest(ts) AS token, generate_subscripts(ts, 1) AS ord FROM (SELECT item_id, {_ALL} AS ts FROM benchmark)),
o AS (SELECT item_id, token, sum(strlen(token)) OVER (PARTITION BY item_id ORDER BY ord) AS e FROM t)
SELECT item_id, CASE WHEN regexp_matches(token, '^[A-Za-z_]') THEN 'identifier' WHEN regexp_matches(token, '^[0-9]') THEN 'number' WHEN regexp_matches(token, '{_SPACE}') THEN 'space' ELSE 'punctuation' END AS kind,
  count(*) AS n, min(e - strlen(token))::BIGINT AS first_start, max(e)::BIGINT AS last_end FROM o GROUP BY ALL""",
    "line_splicing": r"""
SELECT doc_id, sha256(x) AS sha256, strlen(x)::BIGINT AS n_bytes FROM (SELECT doc_id, replace(replace(text, ',' || chr(10), ','), '.' || chr(10), '.') AS x FROM documents)""",
    "visitor_counts": "SELECT kind, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS kind FROM pages) GROUP BY kind",
    "subtree_filter": "SELECT page_id, kind, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<([a-z][a-z0-9]*)', 1)) AS kind FROM pages) GROUP BY ALL",
}
