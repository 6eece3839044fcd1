"""Queries of whole packages: merges with named conflicts, ordered digests, envelopes, remapped ranges, include stacks, searched directories, target rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions import target_rules
from lodestrand.operators import envelope, merging, ordered, provenance
from lodestrand.sources.tables import table


#: Turns of conversations in one task of ``package_remap``.
TURNS = 10_000


def merge_field_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Two overlapping parts of orders, of which the second has other prices, customers and priorities for some keys: what differs, by field."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), "o_orderpriority")
    k = F.col("o_orderkey")
    right = o.where("o_orderkey % 3 <> 1").select("o_orderkey", F.when(k % 13 == 0, F.lit(None).cast("long")).otherwise(F.col("o_custkey")).alias("o_custkey"), F.when(k % 11 == 0, F.col("cents") + 1).otherwise(F.col("cents")).alias("cents"), F.when(k % 17 == 0, F.lit("none")).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))
    return merging.field_conflicts(o.where("o_orderkey % 3 <> 0"), right, "orders", ["o_orderkey"], ["o_custkey", "cents", "o_orderpriority"])


def merge_list_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events as an ordered list, by time on one side and without the largest values on the other: where the lists first part."""
    events = table(spark, d, "events")
    numbered = lambda df: ordered.duplicate_ordinals(df, ["user_id"], ["ts", "event_id"], "position").select("user_id", "position", "event_type")
    return merging.list_conflicts(numbered(events), numbered(events.where("value < 150 OR user_id % 2 = 0")), "events", ["user_id"], "position", ["event_type"])


def ordered_payload_digest(spark: SparkSession, d: str) -> DataFrame:
    """The ordered digest of three tables, whatever their partitions."""
    of = {"customer": ("c_custkey", ("c_custkey", "c_name", "c_nationkey")), "orders": ("o_orderkey", ("o_orderkey", "o_custkey", "o_orderpriority")), "part": ("p_partkey", ("p_partkey", "p_name", "p_brand", "p_size"))}
    out = []
    for name, (key, columns) in of.items():
        df = table(spark, d, name)
        out.append((name, df.count(), envelope.ordered_digest(df, [key], F.concat_ws("|", *[F.col(c).cast("string") for c in columns]))))
    return spark.createDataFrame(out, "table_name string, n_rows long, digest string")


def _envelopes(spark: SparkSession, d: str) -> DataFrame:
    """Events as envelopes, some with another kind, version or fingerprint, too many files, a field too many, or no JSON at all."""
    k = F.col("event_id")
    when = lambda n, bad, good: F.when(k % n == 0, F.lit(bad)).otherwise(F.lit(good))
    files = F.array_join(F.array_repeat(F.lit('{"role":"entry"}'), (k % 9).cast("int")), ",")
    unit = F.when(k % 23 == 0, F.lit('{"state":"complete","x":1}')).otherwise(F.lit('{"state":"complete"}'))
    return table(spark, d, "events").select(
        k.alias("id"),
        F.concat(
            F.lit('{"kind":"'), when(5, "other", "package"), F.lit('","schema":{"id":"package","version":'), when(7, "3", "2"), F.lit('},"fingerprint":"'), k.cast("string"), F.lit('","payload":{"schema":{"id":"package","version":'), when(11, "1", "2"),
            F.lit('},"note":"'), F.col("event_type"), F.lit(' {,","completeness":'), unit, F.lit(',"files":['), files, F.lit('],"fingerprint":"'), when(13, "x", ""), k.cast("string"), F.lit('"}'), when(17, ',"more":1', ""), when(19, "", "}"),
        ).alias("json"),
    )


def envelope_headers(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with each envelope, null for those that may be decoded."""
    return envelope.header_problems(_envelopes(spark, d), "package", "package", 2, envelope.Limits(1 << 20, (("files", 6),))).select("id", "problem")


def package_remap(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as generated text made of turns: declarations of 120 code points with their names and attributes, all mapped back at once, and what is lost."""
    conv = table(spark, d, "conversations")
    # a turn becomes some twenty rows of ranges in bins, so the turns of a task are bounded, not the bytes that it reads
    parts = conv.count() // TURNS + 1
    sizes = conv.where("text <> ''").select("conv_id", "turn", "role", F.length("text").cast("long").alias("size")).repartition(parts, "conv_id")
    turns = ordered.running_total(sizes, ["conv_id"], ["turn"], F.col("size"), "e").select(F.col("conv_id").cast("string").alias("file"), "turn", "role", "size", "e", (F.col("e") - F.col("size")).alias("b"))
    segments = turns.select("file", F.col("b").alias("s_start"), F.col("e").alias("s_end"), F.col("role").alias("o_file"), (F.col("turn") * 10_000).alias("o_start"), (F.col("turn") * 10_000 + F.col("size")).alias("o_end"))
    # each turn has the declarations that start behind its first place and up to its end, the first turn that at zero too
    first, last = F.expr("IF(b = 0, 0L, (b div 120 + 1) * 120)"), F.expr("e div 120 * 120")
    declarations = turns.select("file", F.explode(F.when(first <= last, F.sequence(first, last, F.lit(120).cast("long")))).alias("s"))
    s = F.col("s")
    ranges = provenance.range_columns(declarations, "declarations", "file", ["file", "s"], {"range": (s, s + 120), "name_range": (s + 5, s + 25), "attribute": (s + 100, s + 140)})
    return provenance.remapped(ranges, segments, parts=parts).select("key", "column", "r_start", "r_end", "o_file", "o_start", "o_end")


def include_stack(spark: SparkSession, d: str) -> DataFrame:
    """Conversations with a line marker before each turn: where each line is from, and through which includes."""
    flags = F.element_at(F.array(*map(F.lit, (" 1", " 2", "", " 1 3", " 1 2"))), (F.length("text") % 5 + 1).cast("int"))
    piece = F.concat(F.lit("# "), (F.col("turn") + 1).cast("string"), F.lit(' "'), F.col("role"), F.lit('"'), flags, F.lit("\n"), F.col("text"))
    texts = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", piece.alias("p")))).alias("ps")).select("conv_id", F.array_join(F.transform("ps", lambda x: x["p"]), "\n").alias("text"))
    offsets = provenance.marker_lines(texts, "conv_id", "text").select("conv_id", F.col("start").alias("offset"))
    out = provenance.include_stacks(texts, "conv_id", "text", offsets)
    return out.select("conv_id", "offset", "file", "line", F.array_join(F.transform("stack", lambda x: F.concat(x["file"], F.lit(":"), x["line"].cast("string"))), ">").alias("stack"))


def _page_path() -> Column:
    return F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")


def searched_directories(spark: SparkSession, d: str) -> DataFrame:
    """Pages as files: the directories (host and first part) that the lookups of each third page went through, with their contents' fingerprints."""
    pages = table(spark, d, "pages").select("page_id", _page_path().alias("path"), F.sha2("html", 256).alias("digest"))
    lookups = pages.where("page_id % 3 = 0").select(F.substring_index("path", "/", 2).alias("root"))
    return provenance.searched_directories(pages, lookups)


def _pick(values: tuple, c: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (c % len(values) + 1).cast("int"))


#: Facts of the targets that parts stand for, each by a number of the part.
TARGET_FACTS = {
    "machine": (tuple(m for m, _, _ in target_rules.MACHINES), 1), "pointer_bits": ((64, 32, 64), 1), "endian": (("little", "little", "big"), 7), "system": (target_rules.SYSTEMS, 3), "environment": (("none", "gnu", "msvc", "eabi"), 5), "object_format": (("elf", "mach_o", "coff", "wasm", "xcoff"), 2),
    "vendor": (("unknown", "apple", "ibm"), 11), "compiler": (("gcc", "clang", "msvc", "apple_clang"), 13), "long_double": (tuple(target_rules.FLOATING), 17), "long_double_bits": ((128, 64, 80), 19), "data_model": (("lp64", "ilp32", "llp64"), 23), "int_bits": ((32,), 1), "long_bits": ((64, 32), 29),
}


def target_rule_check(spark: SparkSession, d: str) -> DataFrame:
    """Parts as targets, their facts picked by their numbers: every rule that each breaks."""
    part = table(spark, d, "part")
    facts = [_pick(values, F.expr(f"p_partkey div {by}")).alias(fact) for fact, (values, by) in TARGET_FACTS.items()]
    return target_rules.target_violations(part.select(F.col("p_partkey").alias("id"), *facts), target_rules.rules_table(spark))


QUERIES = {f.__name__: f for f in (merge_field_conflicts, merge_list_conflicts, ordered_payload_digest, envelope_headers, package_remap, include_stack, searched_directories, target_rule_check)}


def _digest_sql(name: str, key: str, columns: tuple[str, ...]) -> str:
    line = " || '|' || ".join(f"{c}::VARCHAR" for c in columns)
    return f"""SELECT '{name}' AS table_name, sum(n)::BIGINT AS n_rows, CASE WHEN count(*) = 1 THEN max(d) ELSE sha256(string_agg(d, '' ORDER BY b)) END AS digest
FROM (SELECT k // 4096 AS b, count(*) AS n, sha256(string_agg(sha256(line), '' ORDER BY k)) AS d FROM (SELECT row_number() OVER (ORDER BY {key}) - 1 AS k, {line} AS line FROM {name}) GROUP BY 1)"""


_RULES = ", ".join(str(r) for r in target_rules.combination_rows())
_FACTS = ", ".join(f"({list(values)})[(p_partkey // {by}) % {len(values)} + 1]::VARCHAR AS {fact}" for fact, (values, by) in TARGET_FACTS.items())
_ASKED = "\nUNION ALL ".join(f"SELECT id, '{rule}', " + ", ".join([*facts, *["'*'"] * (4 - len(facts))]) + " FROM t" for rule, facts in target_rules.FACTS.items())
SQL = {
    "merge_field_conflicts": """
WITH o AS (SELECT o_orderkey AS k, o_custkey AS a, round(o_totalprice * 100)::BIGINT AS b, o_orderpriority AS c FROM orders),
r AS (SELECT k, CASE WHEN k % 13 <> 0 THEN a END AS a, CASE WHEN k % 11 = 0 THEN b + 1 ELSE b END AS b, CASE WHEN k % 17 = 0 THEN 'none' ELSE c END AS c FROM o WHERE k % 3 <> 1),
j AS (SELECT l.k, l.a IS DISTINCT FROM r.a AS xa, l.b IS DISTINCT FROM r.b AS xb, l.c IS DISTINCT FROM r.c AS xc FROM o l JOIN r USING (k) WHERE l.k % 3 <> 0)
SELECT 'orders[' || k || ']' AS path, 'o_custkey' AS field FROM j WHERE xa UNION ALL SELECT 'orders[' || k || ']', 'cents' FROM j WHERE xb UNION ALL SELECT 'orders[' || k || ']', 'o_orderpriority' FROM j WHERE xc""",
    "merge_list_conflicts": """
WITH a AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p, event_type AS t FROM events),
b AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p, event_type AS t FROM events WHERE value < 150 OR user_id % 2 = 0),
j AS (SELECT coalesce(a.user_id, b.user_id) AS u, coalesce(a.p, b.p) AS p, a.t IS NULL OR b.t IS NULL AS short FROM a FULL JOIN b ON a.user_id = b.user_id AND a.p = b.p WHERE a.t IS DISTINCT FROM b.t)
SELECT 'events.' || u || '[' || min(p) || ']' AS path, CASE WHEN arg_min(short, p) THEN 'length' ELSE 'element' END AS field FROM j GROUP BY u""",
    "ordered_payload_digest": "\nUNION ALL ".join(_digest_sql(*x) for x in (("customer", "c_custkey", ("c_custkey", "c_name", "c_nationkey")), ("orders", "o_orderkey", ("o_orderkey", "o_custkey", "o_orderpriority")), ("part", "p_partkey", ("p_partkey", "p_name", "p_brand", "p_size")))),
    "envelope_headers": """
SELECT event_id AS id, CASE WHEN event_id % 19 = 0 OR event_id % 17 = 0 THEN 'fields' WHEN event_id % 5 = 0 THEN 'kind' WHEN event_id % 7 = 0 THEN 'schema version'
  WHEN event_id % 11 = 0 THEN 'payload schema' WHEN event_id % 13 = 0 THEN 'envelope fingerprint' WHEN event_id % 9 > 6 THEN 'limit files' WHEN event_id % 23 = 0 THEN 'unit variant field' END AS problem FROM events""",
    "package_remap": """
WITH t AS (SELECT conv_id, turn, role, length(text) AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS e FROM conversations WHERE text <> ''),
w AS (SELECT conv_id, unnest(range(0, sum(n)::BIGINT + 1, 120)) AS s FROM t GROUP BY conv_id),
r AS (SELECT conv_id, s, c AS "column", s + a AS r_start, s + b AS r_end FROM w, (VALUES ('range', 0, 120), ('name_range', 5, 25), ('attribute', 100, 140)) v(c, a, b)),
m AS (SELECT r.conv_id, s, "column", r_start, r_end, min(role) AS o_file, min(turn * 10000) AS o_start, max(turn * 10000 + n) AS o_end, count(DISTINCT role) AS k, sum(least(r_end, e) - greatest(r_start, e - n)) AS covered
  FROM r LEFT JOIN t ON r.conv_id = t.conv_id AND r_start < e AND e - n < r_end GROUP BY ALL)
SELECT conv_id || '|' || s AS key, "column", r_start, r_end, CASE WHEN ok THEN o_file END AS o_file, CASE WHEN ok THEN o_start END::BIGINT AS o_start, CASE WHEN ok THEN o_end END::BIGINT AS o_end
FROM (SELECT *, coalesce(k = 1 AND covered >= r_end - r_start, false) AS ok FROM m)""",
    "include_stack": r"""
WITH RECURSIVE t AS (
  SELECT conv_id, string_split(string_agg('# ' || (turn + 1) || ' "' || role || '"' || [' 1', ' 2', '', ' 1 3', ' 1 2'][length(text) % 5 + 1] || chr(10) || text, chr(10) ORDER BY turn), chr(10)) AS ls FROM conversations GROUP BY conv_id),
l AS (SELECT conv_id, unnest(ls) AS content, generate_subscripts(ls, 1) - 1 AS pos FROM t),
m AS (
  SELECT conv_id, pos, (sum(length(content) + 1) OVER (PARTITION BY conv_id ORDER BY pos) - length(content) - 1)::BIGINT AS start, regexp_matches(content, '^# [0-9]+ "[^"]*"') AS mark,
    regexp_extract(content, '^# ([0-9]+) "', 1) AS mline, regexp_extract(content, '^# [0-9]+ "([^"]*)"', 1) AS mfile, regexp_matches(content, '" 1') AS new, regexp_matches(content, '" (1 )?2') AS back FROM l),
s AS (
  SELECT conv_id, 0::BIGINT AS pos, '' AS file, 1::BIGINT AS line, []::STRUCT(f VARCHAR, n BIGINT)[] AS stack FROM t
  UNION ALL
  SELECT s.conv_id, s.pos + 1, CASE WHEN mark THEN mfile ELSE s.file END, CASE WHEN mark THEN mline::BIGINT ELSE s.line + 1 END,
    CASE WHEN mark AND new AND NOT back THEN list_append(s.stack, {'f': s.file, 'n': s.line}) WHEN mark AND back AND NOT new THEN s.stack[1:len(s.stack) - 1] ELSE s.stack END
  FROM s JOIN m ON m.conv_id = s.conv_id AND m.pos = s.pos)
SELECT s.conv_id, m.start AS "offset", s.file, s.line, coalesce(array_to_string(list_transform(s.stack, lambda x: x.f || ':' || x.n), '>'), '') AS stack FROM s JOIN m ON m.conv_id = s.conv_id AND m.pos = s.pos""",
    "searched_directories": """
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path, sha256(html) AS digest FROM pages),
u AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:2], '/') AS root FROM p WHERE page_id % 3 = 0),
a AS (SELECT path, digest, array_to_string(parts[1:k], '/') AS root FROM (SELECT path, digest, parts, unnest(range(1, len(parts))) AS k FROM (SELECT *, string_split(path, '/') AS parts FROM p))),
l AS (SELECT root, substr(path, length(root) + 2) AS below, digest FROM a SEMI JOIN u USING (root)),
g AS (SELECT root, sha256(below)[1:3] AS grp, sha256(strlen(below) || ':' || below || strlen(digest) || ':' || digest) AS line FROM l),
b AS (SELECT root, grp, sha256(string_agg(line, '' ORDER BY line)) AS d, count(*) AS n FROM g GROUP BY 1, 2)
SELECT root, sum(n)::BIGINT AS n_files, 'dir1_' || sha256(string_agg(d, '' ORDER BY grp)) AS content FROM b GROUP BY root""",
    "target_rule_check": f"""
WITH t AS (SELECT p_partkey AS id, {_FACTS} FROM part),
q(id, rule, a, b, c, d) AS ({_ASKED}),
r(rule, a, b, c, d) AS (VALUES {_RULES})
SELECT id, rule, concat_ws('/', a, nullif(b, '*'), nullif(c, '*'), nullif(d, '*')) AS facts FROM q
WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.rule = q.rule AND r.a = q.a AND (r.b = '*' OR r.b = q.b) AND (r.c = '*' OR r.c = q.c) AND (r.d = '*' OR r.d = q.d))""",
}
