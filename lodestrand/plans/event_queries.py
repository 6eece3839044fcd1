"""Queries of the ordered operators over events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.operators import closure, intervals, ordered, sets
from lodestrand.sources.tables import table

ORDER = ["ts", "event_id"]


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


#: Turns of conversations in one task of ``provenance_remap``.
TURNS = 10_000


def duplicate_ordinals(spark: SparkSession, d: str) -> DataFrame:
    return ordered.duplicate_ordinals(_events(spark, d), ["user_id", "event_type"], ORDER).select("event_id", "ordinal")


def effective_last_definition(spark: SparkSession, d: str) -> DataFrame:
    """Per user: the last event, unless it is an error, which undefines."""
    return ordered.last_definition(_events(spark, d), ["user_id"], ORDER, ["event_id", "event_type", "value"], F.col("event_type") != "error")


def macro_redefinition_check(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user and type whose properties differ from the one before."""
    return ordered.redefinitions(_events(spark, d), ["user_id", "event_type"], ORDER, ["props"]).select("event_id", "user_id", "event_type", "props")


def enum_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    explicit = F.when(F.col("event_id") % 5 == 0, F.floor(F.col("value")).cast("long"))
    return ordered.carry_forward(_events(spark, d), ["user_id"], ORDER, explicit, F.col("event_id") % 17 == 0, "carried").select("event_id", "carried")


def running_budget(spark: SparkSession, d: str) -> DataFrame:
    cents = F.round(F.col("value") * 100).cast("long")
    return ordered.running_total(_events(spark, d), ["user_id"], ORDER, cents).select("event_id", "running", (F.col("running") > 100_000).alias("over"))


def budget_cutoff(spark: SparkSession, d: str) -> DataFrame:
    cents = F.round(F.col("value") * 100).cast("long")
    return ordered.within_budget(_events(spark, d), ["user_id"], ORDER, cents, 100_000).select("event_id", "user_id")


def conditional_depth(spark: SparkSession, d: str) -> DataFrame:
    return ordered.nesting_depth(_events(spark, d), ["user_id"], ORDER, F.col("event_type") == "signup", F.col("event_type") == "error").select("event_id", "depth")


def ordered_fold_state(spark: SparkSession, d: str) -> DataFrame:
    """Depth with unmatched closes ignored: the running depth less its lowest point, so no fold in Python is needed."""
    return ordered.nesting_depth(_events(spark, d), ["user_id"], ORDER, F.col("event_type") == "signup", F.col("event_type") == "error", floor=True).select("event_id", "depth")


def alias_cycle_detection(spark: SparkSession, d: str) -> DataFrame:
    """Event types on a cycle of any length; a type leads to those that follow it more often than it follows them."""
    w = F.lead("event_type").over(ordered._over(["user_id"], ORDER))
    steps = _events(spark, d).withColumn("dst", w).where(F.col("dst").isNotNull()).groupBy(F.col("event_type").alias("src"), "dst").agg(F.count("*").alias("n"))
    back = steps.select(F.col("dst").alias("_src"), F.col("src").alias("_dst"), F.col("n").alias("_n"))
    both = steps.join(back, (F.col("src") == F.col("_src")) & (F.col("dst") == F.col("_dst")), "left")
    return closure.on_cycle(both.where(F.col("n") > F.coalesce("_n", F.lit(0))).select("src", "dst"))


def range_containment(spark: SparkSession, d: str) -> DataFrame:
    """Events whose value range lies in no band of their user: bands are the ranges of every tenth event."""
    e = _events(spark, d).withColumn("r_start", F.floor("value").cast("long")).withColumn("r_end", F.floor("value").cast("long") + 3)
    bands = e.where(F.col("event_id") % 10 == 0).select("user_id", (F.col("r_start") - 20).alias("s_start"), (F.col("r_end") + 20).alias("s_end"))
    return intervals.uncontained(e.select("user_id", "event_id", "r_start", "r_end"), bands, ["user_id"], "event_id", 64).select("event_id")


def provenance_remap(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation, cut into ranges of 120 code points to its end, mapped back through its turns, where one role covers a range."""
    conv = table(spark, d, "conversations")
    parts = conv.count() // TURNS + 1  # a turn becomes several rows, so turns are bounded, not the bytes that a task reads
    sizes = conv.select("conv_id", "turn", "role", F.length("text").cast("long").alias("size")).repartition(parts, "conv_id")
    turns = ordered.running_total(sizes, ["conv_id"], ["turn"], F.col("size"), "e").where("size > 0").withColumn("b", F.col("e") - F.col("size"))
    segments = turns.select("conv_id", "role", F.col("b").alias("s_start"), F.col("e").alias("s_end"), (F.col("turn") * 10_000).alias("o_start"), (F.col("turn") * 10_000 + F.col("size")).alias("o_end"))
    # each turn has the ranges that start in it
    first, last = F.expr("(b + 119) div 120 * 120"), F.expr("(e - 1) div 120 * 120")
    ranges = turns.select("conv_id", F.explode(F.when(first <= last, F.sequence(first, last, F.lit(120).cast("long")))).alias("r_start")).withColumn("r_end", F.col("r_start") + 120)
    return intervals.remap(ranges, segments, ["conv_id"], ["r_start"], ["role"], 512, parts)


def diagnostics_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Distinct turns by role and whole text."""
    return table(spark, d, "conversations").select("role", "text").distinct()


def completeness_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Per user: error events force rejection if large, partiality otherwise."""
    rank = F.when((F.col("event_type") == "error") & (F.col("value") > 100), 2).when(F.col("event_type") == "error", 1).otherwise(0)
    return sets.rollup(_events(spark, d), ["user_id"], rank, F.concat(F.col("event_type"), F.lit("/"), F.when(F.col("value") > 100, "large").otherwise("small")))


def json_strict_decode(spark: SparkSession, d: str) -> DataFrame:
    """Properties with exactly the field ``k``, decoded; unknown fields and bad values are errors."""
    raw = F.when(F.col("event_id") % 7 == 0, F.replace("props", F.lit("}"), F.lit(', "x": 1}'))).otherwise(F.col("props"))
    keys = F.json_object_keys(raw)
    value = F.get_json_object(raw, "$.k").try_cast("long")
    ok = F.coalesce((F.size(keys) == 1) & (keys[0] == "k"), F.lit(False)) & value.isNotNull()
    return _events(spark, d).select("event_id", F.when(ok, value).alias("k"), (~ok).alias("rejected"))


QUERIES = {
    f.__name__: f
    for f in (duplicate_ordinals, effective_last_definition, macro_redefinition_check, enum_carry_forward, running_budget, budget_cutoff, conditional_depth, ordered_fold_state, alias_cycle_detection, range_containment, provenance_remap, diagnostics_dedup, completeness_rollup, json_strict_decode)
}
_W = "PARTITION BY user_id ORDER BY ts, event_id"
SQL = {
    "duplicate_ordinals": "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS ordinal FROM events",
    "effective_last_definition": f"SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1 AND event_type <> 'error'",
    "macro_redefinition_check": "SELECT event_id, user_id, event_type, props FROM (SELECT *, lag(props) OVER w AS was, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)) WHERE k > 1 AND was IS DISTINCT FROM props",
    "enum_carry_forward": f"""
WITH a AS (SELECT event_id, row_number() OVER ({_W}) AS ord, event_id % 17 = 0 AS unknown, CASE WHEN event_id % 5 = 0 AND event_id % 17 <> 0 THEN floor(value)::BIGINT END AS v, user_id FROM events),
b AS (SELECT *, max(CASE WHEN unknown OR v IS NOT NULL THEN ord END) OVER (PARTITION BY user_id ORDER BY ord) AS at FROM a)
SELECT b.event_id, CASE WHEN b.at IS NULL THEN b.ord - 1 WHEN m.unknown THEN NULL ELSE m.v + b.ord - b.at END::BIGINT AS carried FROM b LEFT JOIN a m ON m.user_id = b.user_id AND m.ord = b.at""",
    "running_budget": f"SELECT event_id, running, running > 100000 AS over FROM (SELECT event_id, sum(round(value * 100)::BIGINT) OVER ({_W} ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM events)",
    "budget_cutoff": f"""
WITH r AS (SELECT *, sum(round(value * 100)::BIGINT) OVER ({_W} ROWS UNBOUNDED PRECEDING) > 100000 AS over, row_number() OVER ({_W}) AS k FROM events)
SELECT event_id, user_id FROM r WHERE k < coalesce((SELECT min(k) FROM r s WHERE s.user_id = r.user_id AND s.over), 1000000000)""",
    "conditional_depth": f"SELECT event_id, sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) OVER ({_W} ROWS UNBOUNDED PRECEDING)::BIGINT AS depth FROM events",
    "ordered_fold_state": f"""
WITH s AS (SELECT event_id, user_id, ts, sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS x FROM events)
SELECT event_id, (x - least(0, min(x) OVER ({_W} ROWS UNBOUNDED PRECEDING)))::BIGINT AS depth FROM s""",
    "alias_cycle_detection": f"""
WITH RECURSIVE s AS (SELECT event_type AS src, lead(event_type) OVER ({_W}) AS dst FROM events),
n AS (SELECT src, dst, count(*) AS n FROM s WHERE dst IS NOT NULL GROUP BY src, dst),
e AS (SELECT a.src, a.dst FROM n a LEFT JOIN n b ON a.src = b.dst AND a.dst = b.src WHERE a.n > coalesce(b.n, 0)),
p(head, node) AS (SELECT src, dst FROM e UNION SELECT p.head, e.dst FROM p JOIN e ON p.node = e.src)
SELECT head AS id FROM p WHERE head = node""",
    "range_containment": """
WITH e AS (SELECT event_id, user_id, floor(value)::BIGINT AS s, floor(value)::BIGINT + 3 AS t FROM events)
SELECT event_id FROM e WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.event_id % 10 = 0 AND b.user_id = e.user_id AND b.s - 20 <= e.s AND e.t <= b.t + 20)""",
    "provenance_remap": """
WITH t AS (SELECT conv_id, turn, role, length(text) AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS e FROM conversations),
r AS (SELECT conv_id, unnest(range(0, n::BIGINT, 120)) AS r_start FROM (SELECT conv_id, sum(length(text)) AS n FROM conversations GROUP BY conv_id))
SELECT r.conv_id, r_start::BIGINT AS r_start, min(role) AS role, min(turn * 10000)::BIGINT AS o_start, max(turn * 10000 + n)::BIGINT AS o_end
FROM r JOIN t ON r.conv_id = t.conv_id AND t.n > 0 AND r_start < e AND e - n < r_start + 120 GROUP BY r.conv_id, r_start HAVING count(DISTINCT role) = 1""",
    "diagnostics_dedup": "SELECT DISTINCT role, text FROM conversations",
    "completeness_rollup": """
WITH x AS (SELECT user_id, CASE WHEN event_type = 'error' AND value > 100 THEN 2 WHEN event_type = 'error' THEN 1 ELSE 0 END AS r, event_type || '/' || CASE WHEN value > 100 THEN 'large' ELSE 'small' END AS reason FROM events)
SELECT user_id, CASE max(r) WHEN 2 THEN 'rejected' WHEN 1 THEN 'partial' ELSE 'complete' END AS completeness, coalesce(string_agg(DISTINCT reason, ';' ORDER BY reason) FILTER (WHERE r > 0), '') AS reasons FROM x GROUP BY user_id""",
    "json_strict_decode": """SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN json_extract_string(props, '$.k')::BIGINT END AS k, event_id % 7 = 0 AS rejected FROM events""",
}
