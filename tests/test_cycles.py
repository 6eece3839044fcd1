"""Cycles of any length."""

from __future__ import annotations

import random
import time

import pytest

from lodestrand.operators import closure


def test_cycles_of_any_length(spark):
    ring = [(f"r{k}", f"r{(k + 1) % 17}") for k in range(17)]
    others = [("t1", "t2"), ("t2", "r0"), ("r3", "b1"), ("b1", "b2"), ("b2", "s"), ("s", "s"), ("s", "end")]
    found = closure.on_cycle(spark.createDataFrame(ring + others, "src string, dst string"))
    assert sorted(r.id for r in found.collect()) == sorted([a for a, _ in ring] + ["s"])
    assert closure.on_cycle(spark.createDataFrame([], "src string, dst string")).count() == 0


def by_brute_force(edges):
    """Ids from which a walk leads back."""
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    found = set()
    for start in out:
        seen, todo = set(), list(out[start])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out.get(x, ())
        if start in seen:
            found.add(start)
    return found


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    """Trees, chains, rings, forks and dense parts, all at once."""
    r = random.Random(seed)
    edges = {(r.randrange(30), r.randrange(30)) for _ in range((25, 40, 70)[seed])}
    edges |= {(100 + k, 101 + k) for k in range(20)} | {(120, 100 + 7 * seed), (40, 100), (110, 3)}
    edges |= {(a, b) for a in (200, 201, 202) for b in (200, 201, 202) if a != b} | {(202, 0), (300, 300), (300, 301)}
    frame = spark.createDataFrame([(str(a), str(b)) for a, b in edges], "src string, dst string")
    assert {int(x.id) for x in closure.on_cycle(frame).collect()} == by_brute_force(edges)


def test_long_chains_end_soon(spark):
    """10,000 ids in a row, once open and once closed."""
    began = time.perf_counter()
    chain = [(k, k + 1) for k in range(10_000)]
    open_ = spark.createDataFrame(chain + [(20_000, 5_000)], "src long, dst long")
    assert closure.on_cycle(open_).count() == 0
    ring = spark.createDataFrame(chain + [(9_000, 4_000)], "src long, dst long")
    assert {x.id for x in closure.on_cycle(ring).collect()} == set(range(4_000, 9_001))
    assert time.perf_counter() - began < 100


def test_package_reports_a_long_alias_cycle(spark):
    from lodestrand.operators import packages

    ids = [f"decl1_{k:064x}" for k in range(17)]
    kinds = {"id": "", "kind": "alias"}
    rows = spark.createDataFrame([(k, kinds["kind"]) for k in ids], "id string, kind string")
    blank = lambda schema: spark.createDataFrame([], schema)
    declarations = blank(packages.DECLARATIONS).unionByName(rows, allowMissingColumns=True)
    edges = spark.createDataFrame(list(zip(ids, ids[1:] + ids[:1])), "src string, dst string")
    edges = blank(packages.EDGES).unionByName(edges, allowMissingColumns=True)
    package = packages.Package(declarations, blank(packages.OCCURRENCES), edges, blank(packages.DIAGNOSTICS))
    assert {r.path for r in package.violations().where("code = 'alias cycle'").collect()} == set(ids)
