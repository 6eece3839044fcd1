"""Removal of repeated substrings through a Burrows-Wheeler transform.

**The transform.** In a bucket of text slices, suffixes are sorted by their first ``width`` bytes and more,
which gives the BWT. Breadth-first backward extension then visits the intervals of all strings in order of
length: extending an interval by a byte gives another one, and the first to end at a position sets the
common prefix there, so values come out in increasing order. It stops at ``width``; a boundary that is
still unset has a longer common prefix, and a run of unset boundaries is a group of equal windows. Of each
group all but the earliest window, by (doc_id, start), are removed.

**The buckets.** A window is ``width`` bytes at one start. Its bucket is that of its smallest gram hash
(``GRAM`` bytes), so equal windows meet wherever they occur, and neighbouring windows mostly share a
bucket and travel as one slice. Blocks first tell the buckets the hashes of their distinct slices, 24
bytes each. A slice whose gram occurs nowhere else is never sent. Of equal slices in many blocks only
the earliest is sent, the others are covered by it whole: that is the pre-aggregation before the shuffle.
Grams that a share of a bounded sample's documents hold are *hot*: their slices are dealt by content, and
their windows one by one by both ends, so a common line does not gather in one task. The sample decides
how slices travel, never what is removed.

Nulls and edges: a null text is empty; a null doc_id sorts first; rows that share a doc_id are ordered by
text; texts under ``width`` bytes are kept whole; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import REMOVED, Block, blocked, by_bucket, removals, unpack, unpack_all, without
from .shared import cut, estimated_bytes, texts

WIDTH = 100
#: Buckets for each block: a bucket's slices take some hundred bytes a byte while they are sorted.
BUCKETS = 4
#: Rows of the sample that finds hot grams, and the share of it that makes a gram hot.
SAMPLE_ROWS, HOT_SHARE = 2000, 0.02
#: Odd multipliers and the seed of the byte table.
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
_BYTES = np.random.default_rng(20240611).integers(0, 2**64, 256, np.uint64)
#: Windows hashed at a time; with a window's width it stays below 2 ** 16.
_STEP = 60_000


def _grams(seg: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` bytes: powers of two by doubling, put together by the bits of ``size``."""
    power, level, out, have = _BYTES[seg], 0, None, 0
    for bit in range(size.bit_length()):
        length = 1 << bit
        if size & length:
            out = power if out is None else out[: len(power) - have] * _MIX[level] + power[have:]
            have += length
        if length << 1 <= size:
            power = power[:-length] * _MIX[level] + power[length:]
            level += 1
    out = out ^ (out >> np.uint64(31))
    out = out * _MIX[-1]
    return out ^ (out >> np.uint64(29))


def _least(h: np.ndarray, span: int) -> np.ndarray:
    """The minimum of each ``span`` neighbours, by doubling."""
    have = 1
    while have * 2 <= span:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    rest = span - have
    return np.minimum(h[:-rest], h[rest:]) if rest else h


def window_keys(data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the window at each start: its smallest gram hash (48 bits), and where that gram is last in it."""
    gram = max(1, width * 6 // 25)
    n = max(0, len(data) - width + 1)
    keys, at = np.empty(n, np.uint64), np.empty(n, np.int64)
    low = np.uint64(0xFFFF)
    for s in range(0, n, _STEP):
        e = min(n, s + _STEP)
        h = _grams(data[s : e + width - 1], gram)
        # positions count down in the low bits, so of equal hashes the last is the least
        least = _least((h & ~low) | (low - np.arange(len(h), dtype=np.uint64)), width - gram + 1)
        keys[s:e] = least >> np.uint64(16)
        at[s:e] = s + (low - (least & low)).astype(np.int64)
    return keys, at


def slices(block: Block, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one key: first byte, end of the last window, key, content hash, whether windows of the run can be equal."""
    keys, at = window_keys(block.data, width)
    ends = np.maximum(block.offs[1:] - width + 1, block.offs[:-1])  # beyond the last window of each row
    edges = np.unique(np.concatenate([np.flatnonzero(keys[1:] != keys[:-1]) + 1, block.offs, ends]))
    a, b = edges[:-1], edges[1:]
    valid = a < ends[block.row_of(a)] if len(a) else np.zeros(0, bool)
    a, b = a[valid], b[valid]
    # equal windows of one run have their grams at different places
    moves = np.flatnonzero((at[1:] != at[:-1]) & (keys[1:] == keys[:-1])) + 1
    run = np.searchsorted(a, moves, "right") - 1
    inner = (run >= 0) & (moves > a[run]) & (moves < b[run]) if len(a) else np.zeros(len(moves), bool)
    twice = np.zeros(len(a), bool)
    twice[run[inner]] = True
    b = b + width - 1
    view = memoryview(np.ascontiguousarray(block.data))
    digest = xxhash.xxh3_64_intdigest
    content = np.fromiter((digest(view[x:y]) for x, y in zip(a.tolist(), b.tolist())), np.uint64, len(a))
    return a, b, keys[a], content, twice


def _is_in(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    """``among`` is sorted."""
    if not len(among):
        return np.zeros(len(x), bool)
    return among[np.minimum(np.searchsorted(among, x), len(among) - 1)] == x


def _announce(key, table: pa.Table, width: int, n: int, hot: np.ndarray) -> pa.Table:
    """The distinct slices of a block: (gram hash, content hash, doc_id), to the bucket of the gram, or of the content if it is hot."""
    block = Block(table)
    a, _, h, content, _ = slices(block, width)
    _, first = np.unique(content, return_index=True)
    h, content, ids = h[first], content[first], block.doc_ids[block.row_of(a[first])]
    bucket = np.where(_is_in(h, hot), content, h) % np.uint64(n)
    rows = by_bucket(bucket, [h, content, ids])
    return pa.table({"bucket": pa.array([b for b, _ in rows], pa.int64()), "block": pa.array([key[0].as_py()] * len(rows), pa.int64()), "blob": pa.array([x for _, x in rows], pa.binary())})


def _answer(table: pa.Table, hot: np.ndarray) -> pa.Table:
    """To each block: the slices that it has first and must send (1), those that it has after another block (0)."""
    blobs, blocks = table.column("blob").to_pylist(), table.column("block").to_numpy()
    h, content, ids = unpack_all(blobs, np.uint64, np.uint64, np.int64)
    block = np.repeat(blocks, [len(b) // 24 for b in blobs])
    order = np.lexsort((ids, content, h))
    h, content, block = h[order], content[order], block[order]
    new_h = np.r_[True, h[1:] != h[:-1]]
    alone = np.r_[new_h[1:], True] & new_h & ~_is_in(h, hot)
    first = new_h | np.r_[True, content[1:] != content[:-1]]
    told = ~alone
    rows = by_bucket(block[told], [content[told], first[told].astype(np.int64)])
    return pa.table({"block": pa.array([b for b, _ in rows], pa.int64()), "blob": pa.array([x for _, x in rows], pa.binary())})


def _pack_slices(block: Block, a: np.ndarray, b: np.ndarray) -> bytes:
    """Slices with where they are from, compressed."""
    row = block.row_of(a)
    head = np.array([len(a)], np.int64).tobytes() + b"".join(x.astype(np.int64).tobytes() for x in (block.doc_ids[row], row, a - block.offs[row], b - a))
    view = memoryview(np.ascontiguousarray(block.data))
    return zstandard.compress(head + b"".join(view[x:y] for x, y in zip(a.tolist(), b.tolist())), 1)


SENT = "key long, kind int, block long, blob binary"
COVERED, SLICES = 0, 1


def _send(key, left: pa.Table, right: pa.Table, width: int, n: int, hot: np.ndarray) -> pa.Table:
    """Slices for the transform, and the ranges that earlier copies cover."""
    out = []
    if left.num_rows:
        block, number = Block(left), key[0].as_py()
        a, b, h, content, twice = slices(block, width)
        told, sent = unpack_all(right.column("blob").to_pylist(), np.uint64, np.int64)
        earliest = np.zeros(len(a), bool)
        earliest[np.unique(content, return_index=True)[1]] = True
        # equal slices of one block were announced once, so a repeat within it needs no answer
        covered = ~earliest | _is_in(content, np.sort(told[sent == 0]))
        mine = ~covered & (twice | _is_in(content, np.sort(told[sent == 1])))
        row = block.row_of(a[covered])
        out.append((number, COVERED, number, removals(row, a[covered] - block.offs[row], b[covered] - block.offs[row])))
        is_hot = _is_in(h, hot)
        plain = mine & ~is_hot
        parts = [(a[plain], b[plain], h[plain] % np.uint64(n))]
        if (mine & is_hot).any():
            at = np.concatenate([np.arange(x, y - width + 1) for x, y in zip(a[mine & is_hot].tolist(), b[mine & is_hot].tolist())])
            # equal windows of a block count once, as equal slices do
            view, digest = memoryview(np.ascontiguousarray(block.data)), xxhash.xxh3_64_intdigest
            once = np.unique(np.fromiter((digest(view[x : x + width]) for x in at.tolist()), np.uint64, len(at)), return_index=True)[1]
            again = np.delete(at, once)
            row = block.row_of(again)
            out.append((number, COVERED, number, removals(row, again - block.offs[row], again - block.offs[row] + width)))
            at, end = np.sort(at[once]), max(1, width // 3)
            ends = _grams(block.data, end)
            parts.append((at, at + width, (ends[at] * _MIX[0] + ends[at + width - end]) % np.uint64(n)))
        x, y, bucket = (np.concatenate(p) for p in zip(*parts))
        order = np.argsort(bucket, kind="stable")
        x, y, bucket = x[order], y[order], bucket[order]
        edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, int)
        out += [(int(bucket[s]), SLICES, number, _pack_slices(block, x[s:e], y[s:e])) for s, e in zip(edges[:-1], edges[1:])]
    return pa.table({k: pa.array([x[i] for x in out], t) for i, (k, t) in enumerate((("key", pa.int64()), ("kind", pa.int32()), ("block", pa.int64()), ("blob", pa.binary())))})


#: Symbols of the strings that the search starts from; nine bits each fill a word.
SEED = 7


def suffix_order(sym: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``sym`` (circular) ordered by at least ``width`` symbols of under 2 ** 9, and their first symbols as a word.

    Prefix doubling; a rank is where the group of equal positions starts, and each round sorts only the
    groups that still have several.
    """
    n, have = len(sym), min(SEED, width)
    key, around = np.zeros(n, np.uint64), np.r_[sym, sym[:have]].astype(np.uint64)
    for k in range(have):
        key = (key << np.uint64(9)) | around[k : k + n]
    order = np.argsort(key)
    first = key[order]
    new = np.r_[True, first[1:] != first[:-1]]
    rank = np.empty(n, np.uint64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while have < width:
        at = np.flatnonzero(~(new & np.r_[new[1:], True]))
        if not len(at):
            break
        here = order[at]
        after = here + have
        after[after >= n] -= n
        key = (rank[here] << np.uint64(32)) | rank[after]
        by_key = np.argsort(key)
        order[at], key = here[by_key], key[by_key]
        new[at] = np.r_[True, key[1:] != key[:-1]]
        rank[order[at]] = at[np.maximum.accumulate(np.where(new[at], np.arange(len(at)), 0))]
        have *= 2
    return order, first


def bounded_lcp(bwt: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Common prefixes of neighbouring suffixes below ``width``, -1 where they are longer or run over a separator (symbol 0).

    Breadth-first over the intervals of strings by length, from those of ``SEED`` symbols, which the sort
    has set apart: ``turn[i]`` leads from a row to the row of the suffix that is one symbol longer, so the
    first and last row with a symbol give the extended interval. An interval goes on if it is the first to
    end at its place, which then has the common prefix of that round.
    """
    n, seed = len(bwt), min(SEED, width)
    turn = np.empty(n, np.int64)
    turn[np.argsort(bwt, kind="stable")] = np.arange(n)  # a radix sort
    bits = int(n).bit_length()
    lcp = np.full(n + 1, -1, np.int16)
    lcp[0] = lcp[n] = 0
    edge = np.flatnonzero(first[1:] != first[:-1]) + 1
    below, above = first[edge - 1], first[edge]
    lcp[edge] = sum((below >> np.uint64(9 * k) == above >> np.uint64(9 * k)).astype(np.int16) for k in range(1, seed)) if seed > 1 else 0
    fresh = lcp[edge] == seed - 1
    for k in range(1, seed):  # a string goes on unless a separator is in it but at its end
        fresh &= (below >> np.uint64(9 * k)) & np.uint64(511) != 0
    left, right = np.r_[0, edge[:-1]][fresh] if len(edge) else edge, edge[fresh] - 1
    for length in range(seed, width):
        if not len(left):
            break
        size = right - left + 1
        one = size == 1
        lo, symbol = turn[left[one]], bwt[left[one]]
        hi = lo
        if not one.all():
            l, s = left[~one], size[~one]
            owner = np.repeat(np.arange(len(l)), s)
            at = np.arange(int(s.sum())) - np.repeat(np.cumsum(s) - s, s) + l[owner]
            key = np.sort((owner * 512 + bwt[at]) << bits | at)
            group, at = key >> bits, key & ((1 << bits) - 1)
            new = np.r_[True, group[1:] != group[:-1]]
            lo = np.r_[lo, turn[at[new]]]
            hi = np.r_[hi, turn[at[np.r_[new[1:], True]]]]
            symbol = np.r_[symbol, group[new] % 512]
        fresh = (lcp[hi + 1] < 0) & (symbol != 0)
        left, right = lo[fresh], hi[fresh]
        lcp[right + 1] = length
    return lcp[:n]


def later_windows(text: np.ndarray, lengths: np.ndarray, order: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(slice, offset) of each window in ``text`` that equals an earlier one; ``order``: rank of each slice's row, ``starts``: its place there."""
    k = len(lengths)
    begin = np.cumsum(lengths) - lengths  # of each slice in text; with separators its index more
    n = len(text) + k
    owner = np.repeat(np.arange(k), lengths)
    sym = np.zeros(n, np.uint16)
    sym[np.arange(len(text)) + owner] = text.astype(np.uint16) + 1
    suffixes, first = suffix_order(sym, width)
    lcp = bounded_lcp(sym[suffixes - 1], first, width)
    piece = np.repeat(np.arange(k), lengths + 1)
    offset = np.arange(n) - (begin + np.arange(k))[piece]
    group = np.cumsum(lcp >= 0)
    s, o = piece[suffixes], offset[suffixes]
    whole = o + width <= lengths[s]
    s, o, group = s[whole], o[whole], group[whole]
    if not len(s):
        return s, o
    place = (order[s].astype(np.int64) << np.int64(36)) + starts[s] + o
    head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    least = np.repeat(np.minimum.reduceat(place, head), np.diff(np.r_[head, len(group)]))
    later = place != least
    return s[later], o[later]


def _transform(key, table: pa.Table, width: int) -> pa.Table:
    if key[1].as_py() == COVERED:
        return table.select(["block", "blob"])
    ids, rows, starts, lengths, text, blocks = [], [], [], [], [], []
    for block, blob in zip(table.column("block").to_pylist(), table.column("blob").to_pylist()):
        raw = zstandard.decompress(blob)
        k = int(np.frombuffer(raw, np.int64, 1)[0])
        for into, x in zip((ids, rows, starts, lengths), unpack(raw[8 : 8 + 32 * k], np.int64, np.int64, np.int64, np.int64)):
            into.append(x)
        text.append(np.frombuffer(raw, np.uint8, offset=8 + 32 * k))
        blocks.append(np.full(k, block))
    ids, rows, starts, lengths, text, blocks = (np.concatenate(x) for x in (ids, rows, starts, lengths, text, blocks))
    by_row = np.lexsort((rows, ids))  # rows of one doc_id are in one block
    order = np.empty(len(ids), np.int64)
    order[by_row] = np.cumsum(np.r_[0, (np.diff(ids[by_row]) != 0) | (np.diff(rows[by_row]) != 0)])
    s, o = later_windows(text, lengths, order, starts, width)
    at = starts[s] + o
    out = []
    for block in np.unique(blocks[s]).tolist():
        here = blocks[s] == block
        out.append((block, removals(rows[s][here], at[here], at[here] + width)))
    return pa.table({"block": pa.array([b for b, _ in out], pa.int64()), "blob": pa.array([x for _, x in out], pa.binary())})


def hot_grams(docs: DataFrame, width: int = WIDTH) -> np.ndarray:
    """Gram hashes that over ``HOT_SHARE`` of at most ``SAMPLE_ROWS`` documents have as a window's key; at most 1 / HOT_SHARE times a document's own."""
    rows = texts(docs)
    sample = cut(rows.sample(min(1.0, SAMPLE_ROWS * 1000.0 / max(1, estimated_bytes(rows))), 5).limit(SAMPLE_ROWS), "sample")

    def keys(batches):
        for batch in batches:
            block = Block(pa.Table.from_batches([batch]))
            a, _, h, _, _ = slices(block, width)
            row = block.row_of(a)
            pair = np.unique(np.stack([h.astype(np.int64), row]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pair[0])], ["h"])

    # a count that a hot gram reaches in any sample; the floor keeps small samples from calling chance hot
    least = max(20, int(HOT_SHARE * sample.count()))
    found = sample.mapInArrow(keys, "h long").groupBy("h").count().where(F.col("count") > least).collect()
    return np.sort(np.array([r["h"] for r in found], np.int64).astype(np.uint64))


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): texts without the bytes of ``width``-byte strings that start earlier."""
    if not 1 <= width <= 5000:
        raise ValueError("width must be 1 to 5000: places within a step are held in 16 bits")
    blocks, n = blocked(docs)
    n *= BUCKETS
    hot = hot_grams(docs, width)
    announced = blocks.groupBy("block").applyInArrow(lambda key, t: _announce(key, t, width, n, hot), "bucket long, block long, blob binary")
    answers = announced.groupBy("bucket").applyInArrow(lambda t: _answer(t, hot), "block long, blob binary")
    sent = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda key, x, y: _send(key, x, y, width, n, hot), SENT)
    removed = sent.groupBy("key", "kind").applyInArrow(lambda key, t: _transform(key, t, width), REMOVED)
    return without(blocks, removed)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: bytes, removed bytes and runs, and the digest of what is kept."""
    out = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op2_suffix_dedup": op2_suffix_dedup}
SQL: dict[str, str] = {}
