"""Substring deduplication by content-defined chunks.

A gear rolling hash of 16 bits, so over the last 16 bytes, cuts a text wherever its top ``CUT_BITS`` bits are zero, so a
cut depends on nearby bytes alone and an insertion moves only the cuts around it. A repeated passage loses no more than what
lies before its first inner cut and after its last, some 32 and 16 bytes. Chunks are told apart by
128-bit digests. Blocks announce their distinct digests once each; a digest's bucket answers every block
but that of the smallest doc_id. A chunk is repeated if it starts earlier in its block or the answer names
it, and a run of repeated chunks of at least ``min_run`` bytes is removed: shorter ones, phrases that
texts share by chance, stay.

Nulls and edges: a null text is empty and has no chunks; a null doc_id sorts first; rows that share a
doc_id are ordered by text; a stretch without cuts is cut every ``MAX_CHUNK`` bytes; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import KEPT, Block, blocked, by_bucket, keep_rest, unpack_all

#: What counts as a repeated passage is a run of ``MIN_RUN`` bytes or more.
CUT_BITS, MAX_CHUNK, MIN_RUN = 4, 1024, 96
REACH = 16
#: The gear table, from a fixed seed.
_GEAR = np.random.default_rng(20240612).integers(0, 2**REACH, 256, np.uint16)
_STEP = 1 << 16


def gear_cuts(data: np.ndarray) -> np.ndarray:
    """Positions after which the rolling hash asks for a cut; the first that has ``REACH`` bytes before it counts."""
    found = []
    for s in range(0, max(0, len(data) - REACH + 1), _STEP):
        h, m = _GEAR[data[s : s + _STEP + REACH - 1]], 1
        while m < REACH:
            h = (h[:-m] << np.uint16(m)) + h[m:]
            m *= 2
        found.append(np.flatnonzero(h >> np.uint16(REACH - CUT_BITS) == 0) + s + REACH)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def chunks(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end, row and digest (two words) of each chunk of a block, in order."""
    cuts = gear_cuts(block.data)
    # a hash that reaches over the start of a text isn't its own
    cuts = cuts[cuts - block.offs[block.row_of(np.minimum(cuts, len(block.data) - 1))] >= REACH] if len(cuts) else cuts
    edges = np.unique(np.concatenate([cuts, block.offs]))
    start, size = edges[:-1], np.diff(edges)
    pieces = -(-size // MAX_CHUNK)
    part = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    a = np.repeat(start, pieces) + part * MAX_CHUNK
    b = np.minimum(a + MAX_CHUNK, np.repeat(edges[1:], pieces))
    view, digest = memoryview(np.ascontiguousarray(block.data)), xxhash.xxh3_128_digest
    words = np.frombuffer(b"".join([digest(view[x:y]) for x, y in zip(a.tolist(), b.tolist())]), np.uint64).reshape(-1, 2)
    return a, b, block.row_of(a), words[:, 0].copy(), words[:, 1].copy()


def _first_of(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Indexes of the first chunk of each digest."""
    order = np.lexsort((lo, hi))
    h, l = hi[order], lo[order]
    return order[np.r_[True, (h[1:] != h[:-1]) | (l[1:] != l[:-1])]] if len(order) else order


def _announce(key, table: pa.Table, n: int) -> pa.Table:
    block = Block(table)
    _, _, row, hi, lo = chunks(block)
    at = _first_of(hi, lo)
    rows = by_bucket(hi[at] % np.uint64(n), [hi[at], lo[at], block.doc_ids[row[at]]])
    return pa.table({"bucket": pa.array([b for b, _ in rows], pa.int64()), "block": pa.array([key[0].as_py()] * len(rows), pa.int64()), "blob": pa.array([x for _, x in rows], pa.binary())})


def _answer(table: pa.Table) -> pa.Table:
    """To each block the digests that another block has for a smaller doc_id."""
    blobs = table.column("blob").to_pylist()
    hi, lo, ids = unpack_all(blobs, np.uint64, np.uint64, np.int64)
    block = np.repeat(table.column("block").to_numpy(), [len(b) // 24 for b in blobs])
    order = np.lexsort((ids, lo, hi))
    hi, lo, block = hi[order], lo[order], block[order]
    later = np.r_[False, (hi[1:] == hi[:-1]) & (lo[1:] == lo[:-1])]
    rows = by_bucket(block[later], [hi[later], lo[later]])
    return pa.table({"block": pa.array([b for b, _ in rows], pa.int64()), "blob": pa.array([x for _, x in rows], pa.binary())})


CHUNKED = KEPT + ", n_chunks long, n_repeated long"


def _drop(left: pa.Table, right: pa.Table, min_run: int) -> pa.Table:
    block = Block(left)
    a, b, row, hi, lo = chunks(block)
    repeated = np.ones(len(a), bool)
    repeated[_first_of(hi, lo)] = False
    told_hi, told_lo = unpack_all(right.column("blob").to_pylist(), np.uint64, np.uint64)
    if len(told_hi):
        pair = np.dtype([("hi", np.uint64), ("lo", np.uint64)])
        told, own = np.empty(len(told_hi), pair), np.empty(len(a), pair)
        told["hi"], told["lo"], own["hi"], own["lo"] = told_hi, told_lo, hi, lo
        told.sort(order=("hi", "lo"))
        spot = np.searchsorted(told["hi"], hi)
        match = told["hi"][np.minimum(spot, len(told) - 1)] == hi
        # the answers are distinct digests; the few whose high words agree are compared one by one
        several = np.zeros(len(a), bool)
        if (told["hi"][1:] == told["hi"][:-1]).any():
            names = {(int(x), int(y)) for x, y in told.tolist()}
            several[match] = [(int(x), int(y)) in names for x, y in zip(hi[match].tolist(), lo[match].tolist())]
        else:
            several[match] = told["lo"][spot[match]] == lo[match]
        repeated |= several
    new = np.r_[True, (repeated[1:] != repeated[:-1]) | (row[1:] != row[:-1])] if len(a) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    tail = np.r_[head[1:], len(a)] - 1 if len(a) else head
    go = repeated[head] & (b[tail] - a[head] >= min_run)
    head, tail = head[go], tail[go]
    base = block.offs[row[head]]
    out = keep_rest(block, row[head], a[head] - base, b[tail] - base)
    count = np.bincount(row, minlength=len(block.doc_ids))
    times = np.bincount(row[repeated], minlength=len(block.doc_ids))
    return out.append_column("n_chunks", pa.array(count.astype(np.int64))).append_column("n_repeated", pa.array(times.astype(np.int64)))


def without_repeated_chunks(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """(doc_id, n_bytes, spans, kept, n_chunks, n_repeated): texts without runs of repeated chunks."""
    blocks, n = blocked(docs)
    announced = blocks.groupBy("block").applyInArrow(lambda key, t: _announce(key, t, n), "bucket long, block long, blob binary")
    answers = announced.groupBy("bucket").applyInArrow(lambda t: _answer(t), "block long, blob binary")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda x, y: _drop(x, y, min_run), CHUNKED)


def op10_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: bytes, chunks, what was removed and the digest of what is kept."""
    out = without_repeated_chunks(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", "n_chunks", "n_repeated", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op10_chunk_dedup": op10_chunk_dedup}
SQL: dict[str, str] = {}
