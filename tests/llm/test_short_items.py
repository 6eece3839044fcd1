"""Short benchmark items with substituted tokens, against brute force."""

from __future__ import annotations

import itertools
import random
import time

import pytest

from lodestrand.llm import decontaminate


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_every_substitution_of_up_to_a_fifth_leaks(spark, monkeypatch, bound):
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", bound)
    r = random.Random(4)
    items, rows, want = [], [], set()
    for length in (1, 3, 8, 9, 10, 15, 17, 20, 30):
        item = [f"w{length}x{k}" for k in range(length)]
        items.append((length, " ".join(item)))
        allowed = length // 5 if length >= 9 else 0
        for n in range(allowed + 2):
            places = list(itertools.combinations(range(length), n))
            for at in places if len(places) <= 120 else r.sample(places, 120):
                text = " ".join("new" if k in at else w for k, w in enumerate(item))
                rows.append((len(rows), f"Before it, {text} and after"))
                if n <= allowed:
                    want.add((len(rows) - 1, length))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x.doc_id, x.item_id): x.n_matches for x in decontaminate.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    # one token over a fifth leaks still if a stretch is long enough
    assert want <= set(got) and all(n == 30 or got[d, n] >= 13 for d, n in set(got) - want)
    assert not {(d, n) for d, n in got if n < 16} - want


@pytest.mark.parametrize("length", range(9, 23))
def test_masks_and_runs_miss_no_placement(length):
    kept = [{w + k for k in m} for w in range(length - decontaminate.SPAN + 1) for m in decontaminate.MASKS] + [set(range(w, w + decontaminate.RUN)) for w in range(length - decontaminate.RUN + 1)]
    for n in range(length // 5 + 1):
        for at in itertools.combinations(range(length), n):
            assert any(k.isdisjoint(at) for k in kept)


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_long_item(spark, monkeypatch, bound):
    """An item of 20,000 tokens: whole, with every fifth token changed, a stretch of it alone, and tokens here and there."""
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", bound)
    r = random.Random(3)
    item = [f"w{r.randrange(10**6)}" for _ in range(20_000)]
    changed = [f"x{k}" if k % 5 == 4 else w for k, w in enumerate(item)]
    lost = [f"x{k}" if k % 4 == 3 else w for k, w in enumerate(item)]  # no run of four is left
    other = [f"y{k}" for k in range(30_000)]
    docs = [(1, other[:500] + item), (2, changed + other), (3, lost), (4, other[:9000] + item[7000:7013] + other[9000:]), (5, other[:9000] + item[7000:7012] + other[9000:]), (6, other), (7, " ".join(item[:6000] + other[:1000]).split())]
    frame = spark.createDataFrame([(d, " ".join(ws)) for d, ws in docs], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item)), (2, "some other item that is nine tokens long here")], "item_id long, text string")
    began = time.perf_counter()
    got = {(x.doc_id, x.item_id): x.n_matches for x in decontaminate.leaks(frame, items).collect()}
    assert got == {(1, 1): 20_000, (2, 1): 16_000, (4, 1): 13, (7, 1): 6000}
    assert time.perf_counter() - began < 90
