"""Near copies by word shingles: wide fingerprints, pivot distance tables, and an exact count.

A text's set holds the XXH64 of its ``SHINGLE``-word shingles. Its fingerprint has ``BITS`` bits, each the
parity of the elements that fall on it, so two fingerprints differ in at most as many bits as their sets do
in elements. Sets are similar if they share four fifths of their union.

**Candidates.** In one global order of elements, similar sets share an element among the first fifth (and
one more) of each. Rows (element, set) are sorted by element; elements that one set alone has go at once.
Of the sets that share an element, sizes and what lies behind the element in each must allow similarity.

**Leaders.** Sets that share elements follow the one with the least fingerprint among them; each set is compared with the
leader that it follows most often, element by element, and those that are similar are contracted to components. So a group of any number
of near copies of one template costs a comparison and a link for each. Pairs within a component are not looked at again.

**Pivots.** For pairs of different components, a table holds each fingerprint's Hamming distances to fixed reference
fingerprints; a pair whose largest coordinate difference exceeds what similar sets may differ by is
discarded, then one whose fingerprints do, then one whose ``WIDE``-bit fingerprints do, which tell large sets apart.
Survivors are counted element by element. No step loses a link between components.

Of an element's sets those of its largest component are not paired with each other. An element that more than ``CELL`` sets
have is compared in cells of two blocks of sets, each a row group of its own, so none gathers more than two blocks. Equal sets count once. The order puts elements that many sets have
last, told from a sixteenth of the texts; any order gives the same components.

Nulls and edges: a text under ``SHINGLE`` words has one shingle; a text without words, and a null text, has
none, and all such are copies; repeated rows are copies; a null doc_id is never the first of a group unless
all are null; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontaminate import bit_table, in_table
from .links import components, lookup
from .shared import cut, estimated_bytes, free, texts
from .simhash import first_rows, named

SHINGLE, BITS, WIDE = 5, 1024, 1 << 14
#: Sampled sets (one in SAMPLE) that make an element a frequent one, and how many of those are told apart.
SAMPLE, HOT, MOST_HOT = 16, 32, 1000
#: Sets of a block, where an element has more than that; pairs tested at once; bytes of a shuffle partition.
CELL, TESTED, PART_BYTES = 4096, 1 << 17, 16 << 20
#: The reference fingerprints, from a fixed seed.
REFERENCES = np.random.default_rng(20240614).integers(0, 2**64, (16, BITS // 64), np.uint64)


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes of a text in order, as signed longs."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.int64)
    k = min(shingle, len(words))
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.r_[0, ends[:-1] + 1]
    hashed = xxhash.xxh64_intdigest
    h = np.array([hashed(flat[x:y], 42) for x, y in zip(begins[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64)
    return np.unique(h.view(np.int64))


def fingerprint(items: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The parity of a set's elements by their last bits, as bits / 64 signed longs."""
    return np.packbits(np.bincount(items & (bits - 1), minlength=bits).astype(np.uint8) & 1, bitorder="little").view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offs = np.r_[0, np.cumsum([len(a) for a in arrays])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64), pa.int64()))


def _digest(items: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(items.tobytes())


def _each(rows: DataFrame, shingle: int) -> DataFrame:
    """(fp, items, wide) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, shingle) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            fps = np.array([_digest(x) for x in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(fps), _lists(sets), _lists([fingerprint(x, WIDE) for x in sets])], ["fp", "items", "wide"])

    return rows.select("text").mapInArrow(run, "fp long, items array<bigint>, wide array<bigint>")


def frequent(rows: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """Elements that ``HOT`` or more of the sampled texts have, ``MOST_HOT`` at most, sorted."""
    sample = _each(rows.where(F.pmod("row_hash", F.lit(SAMPLE)) == 0).select("row_hash", "text").dropDuplicates(["row_hash"]), shingle)
    counts = sample.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= HOT)
    return np.sort(np.array([r["item"] for r in counts.orderBy(F.desc("n"), "item").limit(MOST_HOT).collect()], np.int64))


SETS = "doc_id long, row_hash long, fp long, n int, bits array<bigint>, first array<bigint>"


def described(rows: DataFrame, hot: np.ndarray, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, row_hash, fp, n, bits, first) of each row: digest and size of its set, the fingerprint, and its first elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sizes, bits, first = [], [], [], []
            for t in batch.column("text"):
                items = shingles(t.as_buffer().to_pybytes(), shingle)
                fps.append(_digest(items))
                sizes.append(len(items))
                bits.append(fingerprint(items))
                often = np.isin(items, hot)
                first.append(np.r_[items[~often], items[often]][: len(items) // 5 + 1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_hash"), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), _lists(bits), _lists(first)],
                ["doc_id", "row_hash", "fp", "n", "bits", "first"],
            )

    return rows.mapInArrow(run, SETS)


SHARED = "item long, fp long, n int, at int, lead long"


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of ``item`` and ``fp`` those whose item another row has too, with the item's first ``fp`` as ``lead``; one row is held."""
    held, before, lead = None, None, 0  # the row that waits for the next one; the item of the last row that went by, and its lead

    def out(batch: pa.RecordBatch, item: np.ndarray, after: np.int64 | None) -> pa.RecordBatch:
        nonlocal before, lead
        first = np.r_[before is None or before != item[0], item[1:] != item[:-1]]
        last = np.r_[first[1:], after is None or after != item[-1]]
        fp = batch.column("fp").to_numpy()
        at = np.maximum.accumulate(np.where(first, np.arange(len(item)), -1))
        leads = np.where(at >= 0, fp[np.maximum(at, 0)], lead)
        before, lead = item[-1], int(leads[-1])
        keep = pa.array(np.flatnonzero(~(first & last)))
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(keep) for c in ("item", "fp", "n", "at")), pa.array(leads).take(keep)], ["item", "fp", "n", "at", "lead"])

    for batch in batches:
        if not batch.num_rows:
            continue
        item = batch.column("item").to_numpy()
        if held is not None:
            yield out(held, held.column("item").to_numpy(), item[0])
        if batch.num_rows > 1:
            yield out(batch.slice(0, batch.num_rows - 1), item[:-1], item[-1])
        held = batch.slice(batch.num_rows - 1)
    if held is not None:
        yield out(held, held.column("item").to_numpy(), None)


def pairs_between(i: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) with lo <= j < hi for each ``i``, near ``TESTED`` of them at a time."""
    count = np.maximum(hi - lo, 0)
    edge, s = np.cumsum(count), 0
    while s < len(i):
        e = max(s + 1, int(np.searchsorted(edge, (edge[s - 1] if s else 0) + TESTED, "right")))
        c = count[s:e]
        of = np.repeat(np.arange(s, e), c)
        yield i[of], np.arange(len(of)) - np.repeat(np.cumsum(c) - c, c) + lo[of]
        s = e


def _survivors(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
    """(a, b): pairs of whole buckets (item, cell), of different components, that neither sizes nor places, pivots or fingerprints discard; those of the item's ``major`` component aren't paired."""
    new = np.r_[True, (rows["item"][1:] != rows["item"][:-1]) | (rows["cell"][1:] != rows["cell"][:-1])]
    bucket = np.cumsum(new)
    order = np.lexsort((rows["n"], bucket))
    bucket, (fp, n, at, block, cell, comp, major, bits) = bucket[order], (rows[k][order] for k in ("fp", "n", "at", "block", "cell", "comp", "major", "bits"))
    n = n.astype(np.int64)
    table = [np.bitwise_count(bits ^ r).sum(1, dtype=np.int32) for r in REFERENCES]
    others = np.flatnonzero(~major.astype(bool))
    place = (bucket << 32) + n
    lo, hi = (np.searchsorted(place, (bucket[others] << 32) + x, side) for x, side in (((4 * n[others] + 4) // 5, "left"), (n[others] * 5 // 4, "right")))
    a, b = [], []
    for i, j in pairs_between(others, lo, hi):
        both = n[i] + n[j]
        good = ((j > i) | (major[j] != 0)) & (i != j) & (comp[i] != comp[j]) & (np.minimum(n[i] - at[i], n[j] - at[j]) * 9 >= both * 4) & (fp[i] != fp[j]) & ((cell[i] < 0) | (block[i] != block[j]))
        i, j, both = i[good], j[good], both[good]
        for distance in table:
            good = np.abs(distance[i] - distance[j]) * 9 <= both
            i, j, both = i[good], j[good], both[good]
        good = np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64) * 9 <= both
        a.append(np.minimum(fp[i[good]], fp[j[good]]))
        b.append(np.maximum(fp[i[good]], fp[j[good]]))
    pair = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1) if a else np.zeros((2, 0), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["a", "b"])


def _tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        part = {k: batch.column(k).to_numpy() for k in ("item", "cell", "block", "fp", "n", "at", "comp", "major")}
        part["bits"] = batch.column("bits").flatten().to_numpy().view(np.uint64).reshape(-1, BITS // 64)
        held = {k: np.concatenate([held[k], v]) for k, v in part.items()} if held else part
        # the last bucket may go on in the next batch
        ends = np.flatnonzero((held["item"] != held["item"][-1]) | (held["cell"] != held["cell"][-1]))
        if len(ends):
            yield _survivors({k: v[: ends[-1] + 1] for k, v in held.items()})
            held = {k: v[ends[-1] + 1 :] for k, v in held.items()}
    if held:
        yield _survivors(held)


def _cells(shared: DataFrame) -> DataFrame:
    """Rows of ``shared`` (with comp) of items of several components, with (cell, block, major).

    Up to ``CELL`` rows are one cell, -1. Beyond it the sets of the item's largest component and the others are dealt to blocks by hash; each two
    blocks are a cell, and -2 - block a block alone, but for two blocks of the largest component.
    """
    sizes = shared.groupBy(F.col("item").alias("of"), "comp").agg(F.count("*").alias("c"))
    items = sizes.groupBy(F.col("of").alias("key")).agg(F.struct(F.max_by("comp", F.struct("c", "comp")).alias("most"), F.max("c").alias("m"), F.sum("c").alias("all")).alias("stats"), F.sum("c").alias("n"), F.count("*").alias("k"))
    items = cut(items.where("k > 1").select("key", "stats", "n"), "mixed-items")
    held = lookup(shared, F.col("item"), items, "stats").where("stats IS NOT NULL").select("item", "fp", "n", "at", "comp", (F.col("comp") == F.col("stats.most")).cast("int").alias("major"), F.col("stats.m").alias("m"), (F.col("stats.all") - F.col("stats.m")).alias("o"))
    blocks = lambda c: F.ceil(F.col(c) / CELL).cast("long")
    # blocks of the others first, then those of the largest component
    block = F.when(F.col("major") == 1, blocks("o") + F.pmod(F.xxhash64("fp"), blocks("m"))).otherwise(F.pmod(F.xxhash64("fp"), blocks("o")))
    held = held.withColumn("block", block)
    all_blocks = F.sequence(F.lit(0).cast("long"), F.when(F.col("major") == 1, blocks("o")).otherwise(blocks("o") + blocks("m")) - 1)
    with_others = F.transform(F.filter(all_blocks, lambda t: t != F.col("block")), lambda t: F.greatest(t, F.col("block")) * (1 << 31) + F.least(t, F.col("block")))
    alone = F.when(F.col("major") == 1, F.array().cast("array<bigint>")).otherwise(F.array(-2 - F.col("block")))
    cells = F.when(F.col("m") + F.col("o") <= CELL, F.array(F.lit(-1).cast("long"))).otherwise(F.concat(alone, with_others))
    return held.select("item", "fp", "n", "at", "comp", "major", "block", F.explode(cells).alias("cell"))


def _parts(distinct: DataFrame) -> int:
    return max(12, int(estimated_bytes(distinct) * 4 // PART_BYTES))


def shared_elements(distinct: DataFrame) -> DataFrame:
    """(item, fp, n, at, lead) of ``distinct`` (fp, n, first): the first elements that several sets have; a written table."""
    rows = distinct.where("n > 0").select("fp", "n", F.posexplode("first").alias("at", "item")).select("item", "fp", "n", "at")
    return cut(rows.repartition(_parts(distinct), "item").sortWithinPartitions("item", "fp").mapInArrow(_shared, SHARED), "shared")


def followers(shared: DataFrame, distinct: DataFrame) -> DataFrame:
    """(a, b): each set with the leader that it follows most often, if sizes and fingerprints allow similarity; a written table."""
    follows = shared.where("fp <> lead").groupBy("fp", "lead").agg(F.count("*").alias("c"))
    best = follows.groupBy("fp").agg(F.max_by("lead", F.struct("c", "lead")).alias("lead"))
    leads = cut(best, "followed")
    of = leads.groupBy(F.col("lead").alias("key")).agg(F.count("*").alias("n"))
    described_leads = of.join(distinct.select(F.col("fp").alias("_fp"), F.struct("bits", F.col("n").alias("size")).alias("led")), F.col("key") == F.col("_fp")).select("key", "led", "n")
    held = lookup(leads, F.col("lead"), cut(described_leads, "leaders"), "led")
    held = held.join(distinct.select(F.col("fp").alias("_fp"), F.col("n").alias("size"), "bits"), F.col("fp") == F.col("_fp"))
    both = F.col("size") + F.col("led.size")
    differ = F.aggregate(F.zip_with("bits", "led.bits", lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda acc, c: acc + c)
    return cut(held.where((differ * 9 <= both) & (5 * F.least("size", "led.size") >= 4 * F.greatest("size", "led.size"))).select(F.col("lead").alias("a"), F.col("fp").alias("b")), "followers")


def candidates(distinct: DataFrame, shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): pairs of ``distinct`` (fp, n, bits, first) of different components (node, root) that may be similar; a written table."""
    parts = _parts(distinct)
    of = cut(distinct.select("fp", "bits").join(roots, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("of"), "bits", F.coalesce("root", "fp").alias("comp")), "components")
    with_comp = shared.drop("lead").join(of.select("of", "comp"), F.col("fp") == F.col("of")).drop("of")
    held = _cells(cut(with_comp, "shared-components")).join(of.select("of", "bits"), F.col("fp") == F.col("of"))
    found = held.select("item", "cell", "block", "fp", "n", "at", "comp", "major", "bits").repartition(parts, "item", "cell").sortWithinPartitions("item", "cell").mapInArrow(_tested, "a long, b long")
    return cut(found.distinct(), "pairs")


def _with_both(pairs: DataFrame, items: DataFrame, column: str) -> DataFrame:
    """``pairs`` with the sizes n_x, n_y and ``column`` of both sets as x and y."""
    of = lambda k: items.select(F.col("fp").alias(f"fp_{k}"), F.size("items").alias(f"n_{k}"), F.col(column).alias(k))
    return pairs.join(of("x"), F.col("a") == F.col("fp_x")).join(of("y"), F.col("b") == F.col("fp_y"))


def _items_of(pairs: DataFrame, rows: DataFrame, sets: DataFrame, shingle: int) -> DataFrame:
    """(fp, items, wide) of the sets in ``pairs``, from one text of each; a written table."""
    tried = pairs.select(F.col("a").alias("of")).unionByName(pairs.select(F.col("b").alias("of"))).distinct()
    # a bounded bit table keeps most other texts out of the shuffle
    texts_of = cut(sets.select("fp", "row_hash").join(tried, F.col("fp") == F.col("of"), "left_semi").groupBy("fp").agg(F.min("row_hash").alias("h")), "tried")
    seen = rows.where(in_table(bit_table(texts_of.select("h")), F.col("row_hash"))).select("row_hash", "text")
    seen = seen.join(texts_of, F.col("row_hash") == F.col("h"), "left_semi").dropDuplicates(["row_hash"])
    items = cut(_each(seen, shingle).dropDuplicates(["fp"]), "items")
    free(texts_of)
    return items


def _alike() -> Column:
    """Whether sets x and y share four fifths of their union."""
    return F.size(F.array_intersect("x", "y")) * 9 >= (F.col("n_x") + F.col("n_y")) * 4


def _similar_followers(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Of ``pairs`` (a leader, b) the similar ones; a leader is copied once for each ``CELL`` of its followers, so it is no hot key."""
    salts = pairs.groupBy(F.col("a").alias("key")).agg(F.count("*").alias("n")).select("key", F.ceil(F.col("n") / CELL).cast("long").alias("salts"), "n")
    salts = cut(salts, "salts")
    dealt = lookup(pairs, F.col("a"), salts, "salts").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"))
    led = items.join(salts, F.col("fp") == F.col("key")).select(F.col("fp").alias("fp_x"), F.col("items").alias("x"), F.size("items").alias("n_x"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt_x"))
    own = items.select(F.col("fp").alias("fp_y"), F.col("items").alias("y"), F.size("items").alias("n_y"))
    out = dealt.join(own, F.col("b") == F.col("fp_y")).join(led, (F.col("a") == F.col("fp_x")) & (F.col("salt") == F.col("salt_x")))
    out = cut(out.where(_alike()).select("a", "b"), "similar-followers")
    free(salts)
    return out


def similar(rows: DataFrame, sets: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(a, b): links between distinct sets with a Jaccard similarity of four fifths or more that have the components of all such pairs; ``sets`` are those of ``rows``, written."""
    distinct = cut(sets.select("fp", "n", "bits", "first").dropDuplicates(["fp"]), "distinct-sets")
    shared = shared_elements(distinct)
    followed = followers(shared, distinct)
    items = _items_of(followed, rows, sets, shingle)
    near_leaders = _similar_followers(followed, items)
    free(followed, items)
    pairs = candidates(distinct, shared, components(near_leaders))
    free(distinct, shared)
    items = _items_of(pairs, rows, sets, shingle)
    differ = F.aggregate(F.zip_with("x", "y", lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda acc, c: acc + c)
    near = cut(_with_both(pairs, items, "wide").where(differ * 9 <= F.col("n_x") + F.col("n_y")).select("a", "b"), "near")
    out = cut(_with_both(near, items, "items").where(_alike()).select("a", "b").unionByName(near_leaders), "similar")
    free(pairs, items, near, near_leaders)
    return out


def representatives(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row of ``docs`` of each group of near copies, as it is; the first by doc_id (null last), then by text hash."""
    rows = texts(docs).withColumn("row_hash", F.xxhash64("text"))
    sets = cut(described(rows, frequent(rows, shingle), shingle), "shingle-sets")
    return first_rows(docs, named(sets.select("doc_id", "fp", "row_hash"), lambda _: similar(rows, sets, shingle)))
