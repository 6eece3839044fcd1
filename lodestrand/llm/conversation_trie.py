"""The prefix trie of conversations, built level by level and rolled up level by level.

A node is a distinct sequence of first turns; (depth, smallest member) names it, since a conversation passes one node
a level. Per depth the live conversations are grouped by (parent node, digest of the next turn) and get the smallest
member as their node. A conversation alone in its group has no company further down: its other turns are a chain whose
rows need no more levels. So there are as many levels as the longest prefix that two conversations share. Then levels are joined
from the deepest up: a parent adds up its children's leaves and savings.

Turns are read once, as a SHA-256 digest of role and text, and a length. A turn's place in its conversation comes from one
range-partitioned sort of all turns and the counts of each partition, so one conversation may span many tasks. Groups are
pre-aggregated, and keys with over a thousandth of the rows are broadcast, at most a thousand (``links.lookup``). The ids that
end at a node are concatenated in blocks of ``ID_BLOCK`` ids; nodes of several blocks stream them through one hash.

Nulls and edges: a null turn number comes first; null role or text is empty; turns of one number go by role and then by their
digest, so equal rows stay as repeated turns; rows whose conv_id is null belong to no conversation and are left out; an empty table has no
nodes, not even the root; very long texts are digested where they are read; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .links import lookup
from .shared import cut, free, group_count

#: Ids that are joined into one row at most.
ID_BLOCK = 4096
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def numbered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, mid, part, digest, chars), sorted and written, and (conv, part, first, before, n): a turn's place is ``mid - first + before``."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = cut(conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), digest.alias("digest"), F.length(text).cast("long").alias("chars")), "turns")
    dealt = rows.repartitionByRange(group_count(rows, 64 << 20, 4), F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"))
    dealt = dealt.sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "digest")
    placed = cut(dealt.select("conv", F.monotonically_increasing_id().alias("mid"), "digest", "chars").withColumn("part", F.shiftright("mid", 33)), "placed-turns")
    free(rows)
    counts = placed.groupBy("conv", "part").agg(F.min("mid").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return placed, counts.withColumn("before", before)


def crc32_mod(c: Column, n: int) -> Column:
    return F.crc32(c.cast("string").cast("binary")) % n


def rebuilt(conversations: DataFrame, block: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Steps (conv, depth, len, digest, chars) and conversations (conv, len): each is given the first turns of the first of its block.

    With h = crc32(conv_id) % (most + 1), conversation c becomes the first h turns of c - c % block and its own after its first h.
    """
    placed, counts = numbered_turns(conversations)
    sizes = cut(counts.groupBy("conv").agg(F.sum("n").alias("n_own")), "conversation-sizes")
    head = sizes.select(F.col("conv").alias("_head"), F.col("n_own").alias("n_head"))
    convs = sizes.select("conv", "n_own", crc32_mod(F.col("conv"), most + 1).alias("h"), (F.col("conv") - F.col("conv") % block).alias("head")).join(head, F.col("head") == F.col("_head"), "left")
    taken = F.least("h", F.coalesce("n_head", F.lit(0)))
    convs = cut(convs.select("conv", "h", "head", taken.alias("taken"), (taken + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("len")), "rebuilt-conversations")
    dim = counts.join(convs.withColumnRenamed("conv", "_conv"), F.col("conv") == F.col("_conv"))
    dim = cut(dim.select(F.struct("conv", "part").alias("key"), F.struct("first", "before", "h", "taken", "len").alias("at"), "n"), "places")
    at = lookup(placed, F.struct("conv", "part"), dim, "at").select("conv", "digest", "chars", "at.*", (F.col("mid") - F.col("at.first") + F.col("at.before")).alias("pos"))
    own = at.where("pos >= h").select("conv", (F.col("taken") + F.col("pos") - F.col("h") + 1).alias("depth"), "len", "digest", "chars")
    given = at.where((F.col("pos") < most) & (F.col("conv") % block == 0)).select(F.col("conv").alias("_head"), "pos", "digest", "chars")
    given = convs.where("taken > 0").join(given, (F.col("head") == F.col("_head")) & (F.col("pos") < F.col("taken"))).select("conv", (F.col("pos") + 1).alias("depth"), "len", "digest", "chars")
    steps = cut(own.unionByName(given), "rebuilt-turns")
    free(placed, sizes, dim)
    return steps, convs


def _ends(ending: DataFrame) -> DataFrame:
    """(depth, node, ends_sha256) for (depth, node, conv): the hash of the ids in ascending order, comma-joined."""
    blocks = ending.groupBy("depth", "node", F.expr(f"conv div {ID_BLOCK}").alias("block")).agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string"))).alias("ids"))
    blocks = cut(blocks, "end-blocks")
    many = blocks.groupBy("depth", "node").agg(F.count("*").alias("n")).where("n > 1").select(F.col("depth").alias("_depth"), F.col("node").alias("_node"))
    is_of = (F.col("depth") == F.col("_depth")) & (F.col("node") == F.col("_node"))
    single = blocks.join(many, is_of, "left_anti").select("depth", "node", F.sha2("ids", 256).alias("ends_sha256"))
    schema = "depth long, node long, ends_sha256 string"

    def run(batches):
        at, h = None, None
        for batch in batches:
            out = []
            for depth, node, ids in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if (depth, node) != at:
                    out += [(*at, h.hexdigest())] if at else []
                    at, h = (depth, node), hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["depth", "node", "ends_sha256"])
        if at:
            yield pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]]), pa.array([h.hexdigest()])], ["depth", "node", "ends_sha256"])

    dealt = blocks.join(many, is_of, "left_semi").repartition("depth", "node").sortWithinPartitions("depth", "node", "block")
    return single.unionByName(dealt.select("depth", "node", "ids").mapInArrow(run, schema))


def _levels(steps: DataFrame, root: int) -> tuple[list[DataFrame], list[DataFrame], list[DataFrame]]:
    """Top down: the groups of each level, who ends in groups of several, and the chains of those left alone."""
    groups, ends, tails = [], [], []
    rest, depth = steps.withColumn("node", F.lit(root).cast("long")), 0
    while True:
        depth += 1
        step = rest.where(F.col("depth") == depth)
        found = step.groupBy("node", "digest").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n"), F.max("chars").alias("chars"), F.max("len").alias("len"))
        level = cut(found.select(F.struct("node", "digest").alias("key"), F.struct("conv_id", "n").alias("to"), "node", "conv_id", "n", "chars", "len"), "level")
        if level.isEmpty():
            free(level)
            return groups, ends, tails
        groups.append(level)
        moved = lookup(step, F.struct("node", "digest"), level.select("key", "to", "n"), "to")
        moved = cut(moved.select(F.col("conv").alias("key"), "to", (F.col("len") - depth).alias("n"), "len"), "moved")
        ends.append(moved.where(f"len = {depth} AND to.n > 1").select(F.lit(depth).cast("long").alias("depth"), F.col("to.conv_id").alias("node"), F.col("key").alias("conv")))
        onward = lookup(rest.where(F.col("depth") > depth), F.col("conv"), moved.select("key", "to", "n"), "to")
        onward = cut(onward.select("conv", "depth", "len", "digest", "chars", F.col("to.conv_id").alias("node"), F.col("to.n").alias("n")), "onward")
        tails.append(onward.where("n = 1"))
        rest = onward.where("n > 1").drop("n")


def trie(steps: DataFrame, convs: DataFrame) -> DataFrame:
    """All nodes, the root included, of conversations (conv, len) with steps (conv, depth from 1, len, digest, chars)."""
    top = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n")).first()
    root = top["conv"] if top["n"] else 0
    groups, ends, tails = _levels(steps, root)
    ending = convs.where("len = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(root).cast("long").alias("node"), "conv")
    for e in ends:
        ending = ending.unionByName(e)
    ended = cut(_ends(ending), "ends")
    alone = lambda ends_here: F.when(ends_here, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(EMPTY_SHA))

    def with_children(level: DataFrame, below: DataFrame | None, depth: int) -> DataFrame:
        """Nodes of several members of one level, joined with what their children add up to."""
        if below is None:
            level = level.withColumns({"n_children": F.lit(0).cast("long"), "_leaves": F.lit(1).cast("long"), "_saved": F.lit(0).cast("long")})
        else:
            sums = below.groupBy("parent_conv_id").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("_leaves"), F.sum("saved_tokens").alias("_saved"))
            level = level.join(sums.withColumnRenamed("parent_conv_id", "_of"), F.col("conv_id") == F.col("_of"), "left")
        here = ended.where(F.col("depth") == depth).select(F.col("node").alias("_node"), "ends_sha256")
        level = level.join(here, F.col("conv_id") == F.col("_node"), "left")
        return level.select(
            "conv_id", F.lit(depth).cast("long").alias("depth"), F.col("node").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
            F.coalesce("_leaves", F.lit(1).cast("long")).alias("n_leaves"), ((F.col("n") - 1) * F.col("chars") + F.coalesce("_saved", F.lit(0))).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
        )

    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    rolled, below = [], None
    for k in reversed(range(len(groups))):
        depth, level = k + 1, groups[k]
        single = level.where("n = 1").select("conv_id", F.lit(depth).cast("long").alias("depth"), F.col("node").alias("parent_conv_id"), one.alias("n_convs"), (F.col("len") > depth).cast("long").alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"), alone(F.col("len") == depth).alias("ends_sha256"))
        below = cut(with_children(level.where("n > 1"), below, depth).unionByName(single), "rolled-level")
        rolled.append(below)
    first = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n")).where("n > 0").select("conv_id", F.lit(None).cast("long").alias("node"), "n", F.lit(0).cast("long").alias("chars"))
    out = with_children(first, below, 0)
    for level in rolled:
        out = out.unionByName(level)
    for tail in tails:
        chain = tail.select(F.col("conv").alias("conv_id"), "depth", F.col("conv").alias("parent_conv_id"), one.alias("n_convs"), (F.col("depth") < F.col("len")).cast("long").alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"), F.col("len"))
        out = out.unionByName(chain.withColumn("ends_sha256", alone(F.col("depth") == F.col("len"))).drop("len"))
    return out.select(*NODE)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the trie of the rebuilt conversations."""
    return trie(*rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


QUERIES = {"op12_conversation_trie": op12_conversation_trie}
SQL = {
    "op12_conversation_trie": """
WITH RECURSIVE bits(i, k, v) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos,
    struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) AS t
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(t ORDER BY pos) AS ts FROM turns GROUP BY c),
shares AS (
  SELECT c, ts, c - c % 100 AS head,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a >> 8, tab.t[(xor(a, b) & 255) + 1])), 4294967295) % 6 AS h
  FROM own, tab),
made AS (SELECT s.c, list_concat(coalesce(o.ts[1:s.h], []), s.ts[s.h + 1:]) AS ts FROM shares s LEFT JOIN own o ON o.c = s.head),
member AS (
  SELECT c, ts, d, min(c) OVER (PARTITION BY d, ts[1:d]) AS node FROM (SELECT c, ts, unnest(range(0, len(ts) + 1)) AS d FROM made)),
node AS (
  SELECT node AS conv_id, d AS depth, count(*) AS n_convs, max(CASE WHEN d = 0 THEN 0 ELSE length(ts[d].text) END) AS chars,
    coalesce(string_agg(CASE WHEN len(ts) = d THEN c::VARCHAR END, ',' ORDER BY c), '') AS ends
  FROM member GROUP BY node, d),
placed AS (SELECT n.*, m.node AS parent_conv_id FROM node n LEFT JOIN member m ON m.c = n.conv_id AND m.d = n.depth - 1),
children AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM placed WHERE depth > 0 GROUP BY 1, 2),
full_node AS (SELECT p.*, coalesce(k.n_children, 0) AS n_children FROM placed p LEFT JOIN children k USING (conv_id, depth)),
sums AS (
  SELECT m.node AS conv_id, m.d AS depth, sum((f.n_children = 0)::INT) AS n_leaves, sum((f.n_convs - 1) * f.chars) AS saved_tokens
  FROM full_node f JOIN member m ON m.c = f.conv_id AND m.d <= f.depth GROUP BY 1, 2)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(ends) AS ends_sha256
FROM full_node JOIN sums USING (conv_id, depth)""",
}
