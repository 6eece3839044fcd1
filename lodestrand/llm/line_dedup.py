"""Line deduplication: range-partitioned line hashes, streamed firsts, keep bitmaps for each document.

Every line of at least ``min_chars`` code points (stripped, A-Z lowered) is hashed to 128 bits. The hashes
are range-partitioned by (hash, doc_id) and sorted by (hash, doc_id, position) within a partition, so one
pass over a partition sees a line's first document before all others. A hot line spreads over as many
partitions as its documents need; a partition whose first hash continues an earlier one learns that from
the earlier partition's last hash, one row for each partition. Texts are never shuffled by the operator:
its result is one compressed bitmap of kept lines for each document.

Nulls and edges: a null or empty text is one empty line; a null doc_id counts as one document that sorts
before all others; rows that share a doc_id are one document, and each distinct text of it has its own
bitmap; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, free, group_count, texts, whole

#: Stands for a null doc_id in arrays; sorts first, as null does.
NO_ID = -(1 << 63)
DROP, IF_CONTINUED, LAST = 0, 1, 2
#: Range partitions at most; each is sorted with spilling and streamed, so a large one needs time, not memory.
MOST_PARTS = 20_000


def line_key(line: bytes) -> bytes:
    """The line without white space at its ends, A-Z lowered (bytes methods are ASCII-only)."""
    return line.strip().lower()


def _hashes(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hi, rows, positions = [], [], []
            for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                for pos, line in enumerate(text.split(b"\n")):
                    if len(line) < min_chars:
                        continue
                    key = line_key(line)
                    if len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars):
                        hi.append(xxhash.xxh3_128_digest(key))
                        rows.append(i)
                        positions.append(pos)
            words = np.frombuffer(b"".join(hi), dtype=">i8").reshape(-1, 2).astype(np.int64)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(words[:, 0]), pa.array(words[:, 1]), batch.column("doc_id").take(at), batch.column("row_hash").take(at), pa.array(positions, pa.int32())],
                ["h1", "h2", "doc_id", "row_hash", "pos"],
            )

    return run


STREAMED = "status int, part int, h1 long, h2 long, doc_id long, row_hash long, pos int"


def _stream_firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass in sorted order; only the current hash and its first document are held."""
    part, current, leading = TaskContext.get().partitionId(), None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, row_hash, pos = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("h1", "h2", "row_hash", "pos"))
        doc = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        if current is not None:
            new[0] = (h1[0], h2[0]) != current[:2]
        group = np.cumsum(new)
        first = np.concatenate([[current[2] if current is not None else NO_ID], doc[new]])[group]
        in_leading = group == (1 if current is None else 0) if leading else np.zeros(len(h1), bool)
        status = np.where(doc != first, DROP, np.where(in_leading, IF_CONTINUED, -1))
        leading = leading and bool(in_leading[-1])
        current = (h1[-1], h2[-1], first[-1])
        at = np.flatnonzero(status >= 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(status[at].astype(np.int32)), pa.array(np.full(len(at), part, np.int32)), pa.array(h1[at]), pa.array(h2[at]), batch.column("doc_id").take(pa.array(at)), pa.array(row_hash[at]), pa.array(pos[at])],
            ["status", "part", "h1", "h2", "doc_id", "row_hash", "pos"],
        )
    if current is not None:
        yield pa.RecordBatch.from_pylist([{"status": LAST, "part": part, "h1": int(current[0]), "h2": int(current[1]), "doc_id": None, "row_hash": 0, "pos": 0}], schema=pa.schema([("status", pa.int32()), ("part", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("row_hash", pa.int64()), ("pos", pa.int32())]))


@lru_cache(4096)
def _all_kept(n: int) -> bytes:
    return zlib.compress(np.packbits(np.ones(n, bool)).tobytes())


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for n, dropped in zip(batch.column("n_lines").to_pylist(), batch.column("dropped").to_pylist()):
            if dropped:
                keep = np.ones(n, bool)
                keep[dropped] = False
                out.append(zlib.compress(np.packbits(keep).tobytes()))
            else:
                out.append(_all_kept(n))
        sizes = pa.array([len(x) for x in batch.column("dropped").to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_hash"), batch.column("n_lines"), sizes, pa.array(out, pa.binary())], ["doc_id", "row_hash", "n_lines", "n_dropped", "keep_bitmap"])


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(doc_id, row_hash, n_lines, n_dropped, keep_bitmap): one row for each document and distinct text.

    ``keep_bitmap`` is a zlib-compressed bit string, most significant bit first, 1 for a kept line;
    ``row_hash`` is ``xxhash64(text)`` and tells apart the texts of rows that share a doc_id.
    """
    rows = texts(docs).withColumn("row_hash", F.xxhash64("text"))
    # written, so that the texts are hashed once and the sample of the range bounds reads hashes alone
    lines = cut(rows.mapInArrow(_hashes(min_chars), "h1 long, h2 long, doc_id long, row_hash long, pos int"), "line-hashes")
    parts = group_count(rows, 16 << 20, 12, MOST_PARTS)
    streamed = cut(
        lines.repartitionByRange(parts, "h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "pos").mapInArrow(_stream_firsts, STREAMED),
        "lines",
    )
    free(lines)
    # one row for each range partition: MOST_PARTS at most
    last = F.broadcast(streamed.where(F.col("status") == LAST).select(F.col("h1").alias("l1"), F.col("h2").alias("l2"), F.col("part").alias("before")))
    continued = streamed.where(F.col("status") == IF_CONTINUED).join(last, (F.col("h1") == F.col("l1")) & (F.col("h2") == F.col("l2")) & (F.col("before") < F.col("part")), "left_semi")
    drops = streamed.where(F.col("status") == DROP).unionByName(continued).select("doc_id", "row_hash", F.lit(None).cast("int").alias("n"), "pos")
    sizes = rows.select("doc_id", "row_hash", F.size(F.split("text", "\n", -1)).alias("n"), F.lit(None).cast("int").alias("pos"))
    by_doc = sizes.unionByName(drops).groupBy("doc_id", "row_hash").agg(F.max("n").cast("long").alias("n_lines"), F.collect_set("pos").alias("dropped"))
    out = cut(by_doc.mapInArrow(_bitmaps, "doc_id long, row_hash long, n_lines long, n_dropped long, keep_bitmap binary"), "bitmaps")
    free(streamed)
    return out


def kept_lines(text: bytes, n_lines: int, bitmap: bytes) -> bytes:
    """The text that a bitmap keeps."""
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines)
    return b"\n".join(line for line, k in zip(text.split(b"\n"), keep) if k)


def _joined(docs: DataFrame, maps: DataFrame) -> DataFrame:
    """The rows of ``docs`` as ``doc``, each with its bitmap; texts are shuffled once."""
    keyed = docs.select(whole(docs).alias("doc")).select("doc", F.col("doc.doc_id").cast("long").alias("k1"), F.xxhash64(F.coalesce("doc.text", F.lit(""))).alias("k2"))
    return keyed.join(maps, F.col("k1").eqNullSafe(F.col("doc_id")) & (F.col("k2") == F.col("row_hash")))


def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """The rows of ``docs`` with the repeated lines gone from ``text``; a null text stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, out = batch.column("doc"), []
            for text, n, dropped, bitmap in zip(doc.field("text").cast(pa.binary()).to_pylist(), *(batch.column(k).to_pylist() for k in ("n_lines", "n_dropped", "keep_bitmap"))):
                out.append(kept_lines(text, n, bitmap).decode("utf-8", "replace") if dropped else text)
            at = doc.type.get_field_index("text")
            columns = [pa.array([x.decode("utf-8", "replace") if isinstance(x, bytes) else x for x in out], pa.string()) if i == at else c for i, c in enumerate(doc.flatten())]
            yield pa.RecordBatch.from_arrays(columns, [doc.type[i].name for i in range(doc.type.num_fields)])

    return _joined(docs, keep_bitmaps(docs, min_chars)).select("doc", "n_lines", "n_dropped", "keep_bitmap").mapInArrow(run, docs.schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, n, dropped, bitmap in zip(batch.column("text").cast(pa.binary()).to_pylist(), *(batch.column(k).to_pylist() for k in ("n_lines", "n_dropped", "keep_bitmap"))):
            out.append(hashlib.sha256(kept_lines(text, n, bitmap) if dropped else text).hexdigest())
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc_id", "n_lines", "n_dropped")), pa.array(out, pa.string()), batch.column("keep_bitmap")], ["doc_id", "n_lines", "n_dropped", "kept_sha256", "keep_bitmap"])


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, dropped lines and the digest of what is kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = _joined(docs, keep_bitmaps(docs)).select(F.col("k1").alias("doc_id"), F.coalesce("doc.text", F.lit("")).alias("text"), "n_lines", "n_dropped", "keep_bitmap")
    return rows.mapInArrow(_digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string, keep_bitmap binary").drop("keep_bitmap")


QUERIES = {"op4_line_dedup": op4_line_dedup}
SQL = {
    "op4_line_dedup": r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM split),
keyed AS (
  SELECT doc_id, pos, line, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM lines),
firsts AS (SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND k.doc_id <> f.first_doc AS gone FROM keyed k LEFT JOIN firsts f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
}
