"""Closures over an edge table, with and without a requirement that only rises."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import drop, rows, written


#: Ids of a round up to which they are broadcast, by their written count.
SMALL = 1 << 18


def closure(roots: DataFrame, edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(id, need): all ids reachable from ``roots`` (id, need) over ``edges`` (src, dst, need), cycles included.

    ``need`` is an integer rank of which an id keeps the maximum; an edge asks for its own need, whoever refers.
    Each round joins only the ids whose need rose in the last one with the edges, and looks only what they reach up among those
    known; both without a shuffle of the larger side while a round is small. What is known is added up once, at the end.
    """
    best = lambda df: df.groupBy("id").agg(F.max("need").alias("need"))
    few = lambda df, n: F.broadcast(df) if n <= SMALL else df
    frontier = written(best(roots), "closure")
    parts, known, n_known = [frontier], frontier, rows(frontier)
    for k in range(max_rounds):
        reached = best(few(frontier.select(F.col("id").alias("_from")), rows(frontier)).join(edges, F.col("_from") == F.col("src")).select(F.col("dst").alias("id"), "need"))
        if n_known <= SMALL:
            held, old = None, F.broadcast(best(known))
        else:
            held = reached = written(reached, "closure")
            old = best(known.join(few(reached.select(F.col("id").alias("_id")), rows(reached)), F.col("id") == F.col("_id"), "left_semi"))
        old = old.select(F.col("id").alias("_id"), F.col("need").alias("_need"))
        frontier = written(reached.join(old, F.col("id") == F.col("_id"), "left").where(F.col("_id").isNull() | (F.col("need") > F.col("_need"))).select("id", "need"), "closure")
        if held is not None:
            drop(held)
        if not rows(frontier):
            out = written(best(known), "closure") if len(parts) > 1 else known
            drop(*([frontier, *parts] if len(parts) > 1 else [frontier]))
            return out
        parts.append(frontier)
        known, n_known = known.unionByName(frontier), n_known + rows(frontier)
        if k % 8 == 7:  # a long closure is not a long union
            known = written(best(known), "closure")
            drop(*parts)
            parts, n_known = [known], rows(known)
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")


def missing(ids: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Ids that ``known`` lacks."""
    return ids.join(known.select(F.col(key)), key, "left_anti")


def on_cycle(edges: DataFrame) -> DataFrame:
    """(id): ids that lie on a cycle of ``edges`` (src, dst), whatever its length.

    An id that one edge leaves only follows it, so chains of such ids are jumped over by doubling: after k rounds a
    pointer spans 2 ** k edges. Ids that jump for ever come to rest on cycles of such ids alone; the others end at one that no edge leaves, and
    are on no cycle, or at a fork. What is left is the graph of forks, smaller each time, until
    every id in it forks or none is left; such a core is closed by doubling paths. Then the chains between forks of one cycle are marked, again by
    doubling. A chain of n ids takes about log2(n) rounds, and the tables of all rounds are deleted.
    """
    left = written(edges.select("src", "dst").distinct(), "cycle")
    out = _cycles(left)
    found = written(out.distinct(), "cycle")
    drop(left)
    return found


def _cycles(edges: DataFrame) -> DataFrame:
    """(id) on cycles of the written, distinct ``edges``."""
    degree = edges.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("to"))
    single = written(degree.where("n = 1").select("src", "to"), "cycle")
    n = rows(single)
    if not n:
        return _core(edges)
    jumps, step, k = [single], single, 0
    while 1 << k < n:
        far = step.select(F.col("src").alias("_via"), F.col("to").alias("_to"))
        step = written(step.join(far, F.col("to") == F.col("_via"), "left").select("src", F.coalesce("_to", "to").alias("to")), "cycle")
        jumps.append(step)
        k += 1
    chained = single.select(F.col("src").alias("_id"))
    # who still points into a chain after n steps points to a cycle of chained ids
    resting = step.join(chained, F.col("to") == F.col("_id"), "left_semi").select(F.col("to").alias("id")).distinct()
    ends = written(step.join(chained, F.col("to") == F.col("_id"), "left_anti"), "cycle")
    forks = written(degree.where("n > 1").select(F.col("src").alias("_fork")), "cycle")
    of = ends.select(F.col("src").alias("_chain"), F.col("to").alias("_end"))
    from_forks = edges.join(forks, F.col("src") == F.col("_fork"), "left_semi").join(of, F.col("dst") == F.col("_chain"), "left")
    # by way of ``dst``, where a chain begins or a fork stands
    ways = written(from_forks.select("src", "dst", F.coalesce("_end", "dst").alias("to")).join(forks, F.col("to") == F.col("_fork"), "left_semi"), "cycle")
    smaller = written(ways.select("src", F.col("to").alias("dst")).distinct(), "cycle")
    if not rows(smaller):
        found = written(resting, "cycle")
        drop(*jumps, ends, forks, ways, smaller)
        return found
    # an edge of the smaller graph is on a cycle if its source can be reached from its end
    closed = written(_on_cycle_edges(smaller), "cycle")
    real = ways.join(closed.select(F.col("src").alias("_s"), F.col("dst").alias("_d")), (F.col("src") == F.col("_s")) & (F.col("to") == F.col("_d")), "left_semi")
    marked = written(real.select(F.col("dst").alias("id")).distinct(), "cycle")
    for jump in jumps:
        on = jump.select(F.col("src").alias("_src"), "to")
        # a pointer that ends at a fork stops there
        more = marked.join(on, F.col("id") == F.col("_src")).select(F.col("to").alias("id"))
        marked = written(marked.unionByName(more).distinct(), "cycle")
    found = written(resting.unionByName(marked).unionByName(closed.select(F.col("src").alias("id"))).unionByName(closed.select(F.col("dst").alias("id"))).distinct(), "cycle")
    drop(*jumps, ends, forks, ways, smaller)
    return found


def _on_cycle_edges(edges: DataFrame) -> DataFrame:
    """Edges whose ends lie on one cycle, by strong components of the smaller graph."""
    labelled = _components(edges)
    one, other = (labelled.select(F.col("id").alias(f"_{k}"), F.col("component").alias(f"_c{k}")) for k in "xy")
    return edges.join(one, F.col("src") == F.col("_x")).join(other, F.col("dst") == F.col("_y")).where("_cx = _cy").select("src", "dst")


def _components(edges: DataFrame) -> DataFrame:
    """(id, component): strong components of written ``edges``, by colours.

    The least id that reaches an id is its colour; a colour's component is what leads back to its id within the colour. Components are
    taken out and the rest is coloured anew; rounds follow the graph's width, and rows are edges, never pairs of ids.
    """
    done, left = None, edges
    while True:
        ids = left.select(F.col("src").alias("id")).unionByName(left.select(F.col("dst").alias("id"))).distinct()
        colour = written(ids.select("id", F.col("id").alias("colour")), "cycle")
        while True:
            reached = left.join(colour, F.col("src") == F.col("id")).select(F.col("dst").alias("id"), "colour")
            after = written(colour.unionByName(reached).groupBy("id").agg(F.min("colour").alias("colour")), "cycle")
            changed = after.join(colour.withColumnsRenamed({"id": "_id", "colour": "_was"}), (F.col("id") == F.col("_id")) & (F.col("colour") == F.col("_was")), "left_anti").isEmpty()
            drop(colour)
            colour = after
            if changed:
                break
        of = colour.withColumnsRenamed({"id": "_of", "colour": "_colour"})
        inner = left.join(colour, F.col("src") == F.col("id")).join(of, F.col("dst") == F.col("_of")).where("colour = _colour").select("src", "dst")
        inner = written(inner, "cycle")
        back = frontier = written(colour.where("id = colour").select("id", F.col("colour").alias("component")), "cycle")
        while True:
            before = inner.join(frontier, F.col("dst") == F.col("id")).select(F.col("src").alias("id"), "component").distinct()
            frontier = written(before.join(back.select(F.col("id").alias("_id")), F.col("id") == F.col("_id"), "left_anti"), "cycle")
            if not rows(frontier):
                break
            back = back.unionByName(frontier)
        done = back if done is None else done.unionByName(back)
        taken = back.select(F.col("id").alias("_id"))
        rest = written(inner.join(taken, F.col("src") == F.col("_id"), "left_anti").join(taken, F.col("dst") == F.col("_id"), "left_anti"), "cycle")
        # ids that lost all their edges are components of their own, on no cycle
        if not rows(rest):
            return done
        left = rest


def _core(edges: DataFrame) -> DataFrame:
    """(id) on cycles of a graph in which no chain is left."""
    on = _on_cycle_edges(edges)
    return on.select(F.col("src").alias("id")).unionByName(on.select(F.col("dst").alias("id"))).distinct()
