"""Blocks of documents, the unit in which the substring operators work.

A block holds the documents of one hash value of doc_id, near ``BLOCK_BYTES`` of estimated input, so it
fits a task at any scale. Blocks exchange packed arrays with buckets of hashes: one row for each (block,
bucket), whatever the number of hashes, and a text that many documents share counts once for each block.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import group_count, texts

#: Of the optimizer's estimate; the text of a block is some four times as large.
BLOCK_BYTES = 2 << 20
#: Stands for a null doc_id; sorts first.
NO_ID = -(1 << 63)
REMOVED = "block long, blob binary"


def blocked(docs: DataFrame) -> tuple[DataFrame, int]:
    """(block, doc_id, text), and the number of blocks."""
    rows = texts(docs)
    n = group_count(rows, BLOCK_BYTES)
    return rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(n).cast("long"))), n


class Block:
    """A block's texts as one byte array: ``data[offs[i]:offs[i + 1]]`` is row i, in order of (doc_id, text)."""

    def __init__(self, table: pa.Table):
        table = table.take(pc.sort_indices(table, [("doc_id", "ascending"), ("text", "ascending")], null_placement="at_start"))
        self.ids = table.column("doc_id")
        column = table.column("text").cast(pa.large_binary())
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
        offs = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
        body = column.buffers()[2]
        self.data = np.frombuffer(body, np.uint8)[offs[0] : offs[-1]] if body is not None else np.zeros(0, np.uint8)
        self.offs = offs - offs[0]
        self.doc_ids = self.ids.fill_null(NO_ID).to_numpy()

    def row_of(self, at: np.ndarray) -> np.ndarray:
        """The rows that hold the byte positions ``at``."""
        return np.searchsorted(self.offs, at, "right") - 1


def by_bucket(bucket: np.ndarray, arrays: list[np.ndarray]) -> list[tuple[int, bytes]]:
    """(bucket, packed arrays) for each bucket that occurs; the arrays are of 8-byte items."""
    order = np.argsort(bucket, kind="stable")
    bucket, arrays = bucket[order], [a[order] for a in arrays]
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, int)
    return [(int(bucket[s]), b"".join(a[s:e].tobytes() for a in arrays)) for s, e in zip(edges[:-1], edges[1:])]


def unpack(blob: bytes, *types: type) -> list[np.ndarray]:
    """What ``by_bucket`` packed."""
    n = len(blob) // (8 * len(types))
    return [np.frombuffer(blob, t, n, 8 * n * i) for i, t in enumerate(types)]


def unpack_all(blobs: list[bytes], *types: type) -> list[np.ndarray]:
    """The arrays of all blobs, end to end."""
    parts = [unpack(b, *types) for b in blobs]
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, t) for i, t in enumerate(types)]


def removals(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """Byte ranges of a block's rows, with overlapping ones merged, packed as (row, start, end)."""
    order = np.lexsort((starts, rows))
    rows, starts, ends = (x[order].astype(np.int64) for x in (rows, starts, ends))
    if not len(rows):
        return b""
    shift = np.int64(ends.max() + 2)  # ranges of different rows stay apart
    reach = np.maximum.accumulate(ends + rows * shift)
    new = np.r_[True, starts[1:] + rows[1:] * shift > reach[:-1]]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(rows) - 1]
    return rows[new].tobytes() + starts[new].tobytes() + (reach[last] - rows[last] * shift).tobytes()


KEPT = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def keep_rest(block: Block, rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Table:
    """The block's texts without these byte ranges of its rows."""
    n = len(block.data)
    edge = np.bincount(block.offs[rows] + starts, minlength=n + 1) - np.bincount(block.offs[rows] + ends, minlength=n + 1)
    gone = np.cumsum(edge)[:n] > 0
    before = np.zeros(n, bool)
    before[1:] = gone[:-1]
    after = np.zeros(n, bool)
    after[:-1] = gone[1:]
    first, last = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    filled = np.diff(block.offs) > 0
    first[block.offs[:-1][filled]] = True
    last[block.offs[1:][filled] - 1] = True
    s, e = np.flatnonzero(gone & (~before | first[:n])), np.flatnonzero(gone & (~after | last[:n])) + 1
    row = block.row_of(s)
    count = np.bincount(row, minlength=len(block.doc_ids))
    spans = pa.ListArray.from_arrays(
        pa.array(np.r_[0, np.cumsum(count)].astype(np.int32)),
        pa.StructArray.from_arrays([pa.array(s - block.offs[row]), pa.array(e - block.offs[row])], ["start", "end"]),
    )
    kept = block.data[~gone]
    at = np.r_[0, np.cumsum(~gone)][block.offs] if n else np.zeros(len(block.offs), np.int64)
    out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(block.doc_ids), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(kept)]).cast(pa.binary())
    return pa.table({"doc_id": block.ids, "n_bytes": pa.array(np.diff(block.offs)), "spans": spans, "kept": out})


def _apply(left: pa.Table, right: pa.Table) -> pa.Table:
    return keep_rest(Block(left), *unpack_all(right.column("blob").to_pylist(), np.int64, np.int64, np.int64))


def without(blocks: DataFrame, removed: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): each row's text without the ranges in ``removed``; spans are maximal."""
    return blocks.groupBy("block").cogroup(removed.groupBy("block")).applyInArrow(_apply, KEPT)
