"""Near-duplicates by SimHash and pivot distance tables.

Equal fingerprints count once. A fingerprint's row of the pivot table holds its Hamming distances to fixed
reference fingerprints; by the triangle inequality two fingerprints within ``radius`` bits differ by at
most ``radius`` in every coordinate, so a pair is discarded by its largest coordinate difference and only
survivors are compared bit by bit.

A coordinate alone keeps a third of all pairs of random fingerprints, too many to try them all against each
other. So pairs are tried within buckets: the 64 bits are dealt to six blocks, two differing bits leave at
least four of them equal, and each choice of four equal blocks is a bucket (15 for a fingerprint). At most
22 bits vary in a bucket, which bounds it whatever the input. A bucket over ``LARGE`` looks up the
fingerprints one and two bits away instead of pairing. Each bucket gives a spanning set of links, not all.

Nulls and edges: a text without words, and a null text, has fingerprint zero; a null doc_id is never the
smallest of a component unless all are null; repeated rows link like any copies; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .links import components, lookup
from .shared import cut, estimated_bytes, free, texts, whole

RADIUS, SHINGLE = 2, 3
LARGE = 4096
#: The reference fingerprints, from a fixed seed.
PIVOTS = np.random.default_rng(20240613).integers(0, 2**64, 24, np.uint64)
_SIZES = (11, 11, 11, 11, 10, 10)
_MASKS = np.array([((1 << n) - 1) << sum(_SIZES[:i]) for i, n in enumerate(_SIZES)], np.uint64)
_CHOICES = list(combinations(range(6), 4))
_KEYS = np.array([np.bitwise_or.reduce(_MASKS[list(c)]) for c in _CHOICES], np.uint64)
#: By the set of blocks that differ, the first choice that avoids them: the one bucket that tests the pair.
_FIRST = np.array([next((k for k, c in enumerate(_CHOICES) if not any(d >> b & 1 for b in c)), -1) for d in range(64)])


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text: majority bits of the XXH64 of its word shingles."""
    words = text.lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.r_[0, ends[:-1] + 1]
    k = min(shingle, len(words))
    hashed = xxhash.xxh64_intdigest
    h = np.array([hashed(flat[x:y], 42) for x, y in zip(begins[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64)
    return majority(h)


def majority(h: np.ndarray) -> int:
    """The bits that over half of ``h`` have."""
    n, count = len(h), np.zeros(64, np.int64)
    for s in range(0, n, 1 << 16):
        count += np.unpackbits(h[s : s + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, row_hash): fp is the fingerprint as a signed long, row_hash is ``xxhash64(text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(t, shingle) for t in batch.column("text").cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64)), batch.column("row_hash")], ["doc_id", "fp", "row_hash"])

    return texts(docs).withColumn("row_hash", F.xxhash64("text")).mapInArrow(run, "doc_id long, fp long, row_hash long")


def _table(fps: np.ndarray) -> np.ndarray:
    return np.stack([np.bitwise_count(fps ^ p) for p in PIVOTS]).astype(np.int8)


def _verified(fps: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, choice: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs, those that no coordinate discards and whose bits agree, each in its one bucket."""
    for row in table:
        near = np.abs(row[i] - row[j]) <= radius
        i, j, choice = i[near], j[near], choice[near]
        if not len(i):
            return i, j
    diff = fps[i] ^ fps[j]
    blocks = np.zeros(len(i), np.int64)
    for b, mask in enumerate(_MASKS):
        blocks |= ((diff & mask) != 0).astype(np.int64) << b
    good = (np.bitwise_count(diff) <= radius) & (_FIRST[blocks] == choice)
    return i[good], j[good]


class _Union:
    """Links that join two groups; the rest are dropped."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while (nxt := self.root[self.root])[...].tobytes() != self.root.tobytes():
                self.root = nxt

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.root != np.arange(len(self.root)))
        return at, self.root[at]


def _bucket_links(fps: np.ndarray, choice: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of one bucket of distinct fingerprints."""
    union = _Union(len(fps))
    if len(fps) <= LARGE:
        table = _table(fps)
        order = np.argsort(table[0], kind="stable")
        fps_, table = fps[order], table[:, order]
        reach = np.searchsorted(table[0], table[0] + np.int8(radius), "right")
        for s in range(0, len(fps_), 256):
            e = min(len(fps_), s + 256)
            count = reach[s:e] - np.arange(s, e) - 1
            i = np.repeat(np.arange(s, e), count)
            j = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + i + 1
            i, j = _verified(fps_, table, i, j, np.full(len(i), choice), radius)
            union.add(order[i], order[j])
        return union.links()
    order = np.argsort(fps)
    ranked = fps[order]
    free = [np.uint64(1 << b) for b in range(64) if not int(_KEYS[choice]) >> b & 1]
    for k in range(1, radius + 1):
        for bits in combinations(free, k):
            other = ranked ^ np.bitwise_or.reduce(np.array(bits))
            spot = np.minimum(np.searchsorted(ranked, other), len(ranked) - 1)
            hit = ranked[spot] == other
            union.add(order[hit], order[spot[hit]])
    return union.links()


def _links(radius: int):
    def of(choice: np.ndarray, key: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        new = np.r_[True, (choice[1:] != choice[:-1]) | (key[1:] != key[:-1])]
        head = np.flatnonzero(new)
        size = np.diff(np.r_[head, len(fps)])
        a, b = [], []
        # small buckets together: each row with the rows at a fixed distance
        small = np.repeat((size > 1) & (size <= 16), size)
        f, c, g = fps[small], choice[small], np.cumsum(new)[small]
        table = _table(f)
        for step in range(1, 16):
            i = np.flatnonzero(g[step:] == g[:-step]) if len(g) > step else np.zeros(0, np.int64)
            if not len(i):
                break
            x, y = _verified(f, table, i, i + step, c[i], radius)
            a.append(f[x])
            b.append(f[y])
        for s, n in zip(head[size > 16].tolist(), size[size > 16].tolist()):
            x, y = _bucket_links(fps[s : s + n], int(choice[s]), radius)
            a.append(fps[s + x])
            b.append(fps[s + y])
        a, b = (np.concatenate(v).view(np.int64) if v else np.zeros(0, np.int64) for v in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            part = [batch.column(k).to_numpy() for k in ("choice", "key", "fp")]
            held = [np.concatenate(x) for x in zip(held, part)] if held else part
            # the last bucket may go on in the next batch
            last = len(held[0]) - int(np.argmax((held[0] != held[0][-1])[::-1] | (held[1] != held[1][-1])[::-1])) if len(held[0]) else 0
            if len(held[0]) and not ((held[0] == held[0][-1]) & (held[1] == held[1][-1])).all():
                yield of(held[0][:last].astype(np.int64), held[1][:last], held[2][:last].view(np.uint64))
                held = [x[last:] for x in held]
        if held and len(held[0]):
            yield of(held[0].astype(np.int64), held[1], held[2].view(np.uint64))

    return run


def near_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links that span the same components as all pairs of ``distinct`` (fp) within ``radius`` bits."""
    keys = [F.struct(F.lit(k).cast("int").alias("choice"), F.col("fp").bitwiseAND(F.lit(int(np.array(m).view(np.int64)))).alias("key")) for k, m in enumerate(_KEYS)]
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("at")).select("at.choice", "at.key", "fp")
    parts = max(12, int(estimated_bytes(distinct) * 15 // (32 << 20)))
    return rows.repartition(parts, "choice", "key").sortWithinPartitions("choice", "key").mapInArrow(_links(radius), "a long, b long")


def named(fps: DataFrame, link: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``fps`` (with columns doc_id and fp) with ``of``: the root and the smallest doc_id of the component.

    ``link`` gives the links (a, b) of the distinct fingerprints.
    """
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "distinct")
    roots = components(link(distinct.select("fp")))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first_id", "n", F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted, "rooted")
    per_root = rooted.groupBy(F.col("root").alias("key")).agg(F.min("first_id").alias("component_id"), F.count("*").alias("n"))
    per_root = cut(per_root.select("key", "n", F.struct(F.col("key").alias("root"), "component_id").alias("of")), "components")
    by_fp = cut(lookup(rooted, F.col("root"), per_root, "of").select(F.col("fp").alias("key"), "of", "n"), "named")
    free(distinct, rooted, per_root)
    return lookup(fps, F.col("fp"), by_fp, "of")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id of the component."""
    rows = named(cut(fingerprints(docs, shingle), "fingerprints"), lambda distinct: near_links(distinct, radius))
    return rows.select("doc_id", "fp", F.col("of.component_id").alias("component_id"))


def first_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Of each component in ``rows`` (as ``named`` gives them) one row of ``docs``, as it is: that of the smallest doc_id (null last), of its rows that of the smallest text hash."""
    none, at = lambda c: c.isNull().cast("int"), lambda c: F.coalesce(c, F.lit(0).cast("long"))
    doc_id = F.col("doc.doc_id").cast("long")
    held = docs.select(whole(docs).alias("doc")).select("doc", none(doc_id).alias("k0"), at(doc_id).alias("k1"), F.xxhash64(F.coalesce("doc.text", F.lit(""))).alias("k2"))
    first = rows.groupBy("of.root").agg(F.min(F.struct(none(F.col("doc_id")).alias("none"), "doc_id", "row_hash")).alias("first"))
    kept = first.select(F.col("first.none").alias("d0"), at(F.col("first.doc_id")).alias("d1"), F.col("first.row_hash").alias("d2"))
    # plain keys without nulls: the repeated rows of one document meet without another shuffle
    rows = held.join(kept, (F.col("k0") == F.col("d0")) & (F.col("k1") == F.col("d1")) & (F.col("k2") == F.col("d2")), "left_semi")
    return rows.dropDuplicates(["k0", "k1", "k2"]).select("doc.*")


def representatives(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row of ``docs`` of each component, as it is."""
    return first_rows(docs, named(cut(fingerprints(docs, shingle), "fingerprints"), lambda distinct: near_links(distinct, radius)))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: fingerprint and component."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op6_simhash": op6_simhash}
SQL: dict[str, str] = {}
