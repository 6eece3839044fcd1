"""WARC archives compressed with a shared Zstandard dictionary.

A dictionary is trained on a bounded sample of the records. Each archive starts with a skippable frame
(magic 0x184D2A5D) that holds it, followed by one Zstandard frame for each record, so a record can be read
alone at its offset. Archives are written by the executors straight to the shared folder, in files of a
bounded size with names of their own for each task attempt; the manifest, a written table, lists those of
the attempts that ended well, and readers open only these.

A payload of at least ``min_bytes`` that several records share is stored once, with the smallest page_id;
the others are ``revisit`` records that refer to it. The records of a payload that is over a thousandth of
the table meet their first page by a broadcast of at most a thousand rows, all others by a shuffled join.

Nulls and edges: a null html is an empty payload; a null url has no target header; a null page_id is never
referred to; rows that repeat the smallest page_id are all responses; a line break in a url, which no header can
hold, is percent-encoded, and every other url comes back as it is; an empty table writes no archive and gives an
empty manifest; columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, estimated_bytes, fresh_path

#: Bounds of the dictionary's sample: records, and bytes of a record.
SAMPLE_RECORDS, SAMPLE_BYTES = 500, 1 << 16
DICTIONARY_BYTES = 1 << 16
#: Uncompressed bytes after which a task starts another archive.
ARCHIVE_BYTES = 1 << 28
SKIPPABLE = 0x184D2A5D
#: A payload that this share of all records has counts as heavy.
HEAVY = 1000


def roles(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """(page_id, url, html, payload_digest, refers_to): refers_to is null for responses."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html")).withColumn("payload_digest", F.sha2("html", 256))
    shared = rows.where(F.octet_length("html") >= min_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    firsts = cut(shared, "payloads")
    least = pages.count() / HEAVY
    heavy = F.broadcast(firsts.where(F.col("n") > least).select(F.col("payload_digest").alias("heavy_digest"), F.col("first_id").alias("heavy_first")))
    light = firsts.where(F.col("n") <= least).select(F.col("payload_digest").alias("light_digest"), F.col("first_id").alias("light_first"))
    rows = rows.join(heavy, F.col("payload_digest") == F.col("heavy_digest"), "left")
    # the rows of heavy payloads are dealt by page, not by payload
    key = F.when(F.col("heavy_digest").isNull(), F.col("payload_digest")).otherwise(F.concat(F.lit("page "), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    rows = rows.withColumn("join_key", key).join(light, F.col("join_key") == F.col("light_digest"), "left")
    first = F.coalesce("heavy_first", "light_first")
    return rows.select("page_id", "url", "html", "payload_digest", F.when(~F.col("page_id").eqNullSafe(first), first).alias("refers_to"))


def train_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; raw content where there is too little to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICTIONARY_BYTES]


def _dictionary_for(rows: DataFrame) -> bytes:
    fraction = min(1.0, 50.0 * SAMPLE_RECORDS * 1000 / max(1, estimated_bytes(rows)))
    sample = rows.where(F.octet_length("html") <= SAMPLE_BYTES).select("page_id", "url", "html").sample(fraction, 11).limit(SAMPLE_RECORDS).collect()
    return train_dictionary([record(r.page_id, r.url, r.html.encode(), hashlib.sha256(r.html.encode()).hexdigest(), None) for r in sample])


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC 1.1 record; a revisit has the HTTP header alone."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        block += payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id)}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _writer(folder: str, dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        context = TaskContext.get()
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        done, out, name, size, n, at = [], None, "", 0, 0, 0
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(batch.column(k).to_pylist() for k in ("page_id", "url", "html", "payload_digest", "refers_to"))):
                if out is None:
                    name = f"{folder}/pages-{context.partitionId():06d}-{context.taskAttemptId()}-{len(done)}.warc.zst"
                    out = fs.open_output_stream(f"{root}/{name.rpartition('/')[2]}", compression=None)
                    head = struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary if dictionary else b""
                    out.write(head)
                    size, n, at = 0, 0, len(head)
                raw = record(page_id, url, html.encode("utf-8", "replace"), digest, refers_to)
                frame = packer.compress(raw)
                out.write(frame)
                size, n, at = size + len(raw), n + 1, at + len(frame)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((name, n, at))
                    out = None
        if out is not None:
            out.close()
            done.append((name, n, at))
        yield pa.RecordBatch.from_pylist([{"path": p, "n_records": k, "n_bytes": b} for p, k, b in done], schema=pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]))

    return run


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 100) -> DataFrame:
    """Write the archives now; the manifest (path, n_records, n_bytes) of what was written."""
    spark = pages.sparkSession
    rows = roles(pages, min_bytes)
    dictionary = _dictionary_for(pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")))
    written = rows.mapInArrow(_writer(folder or fresh_path(spark, "warc"), dictionary), "path string, n_records long, n_bytes long")
    return cut(written, "manifest")


def read_archive(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record; the dictionary is read from the leading frame."""
    head = stream.read(8)
    dictionary = b""
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == SKIPPABLE:
        dictionary, head = stream.read(struct.unpack("<I", head[4:])[0]), b""
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    if head:
        stream.seek(0)
    lines = io.BufferedReader(unpacker.stream_reader(stream, read_across_frames=True), 1 << 18)
    while version := lines.readline():
        if version.strip() != b"WARC/1.1":
            raise ValueError(f"not a record: {version[:80]!r}")
        headers = {}
        while (line := lines.readline()).strip():
            k, _, v = line.decode().partition(": ")
            headers[k] = v.rstrip("\r\n")
        block = lines.read(int(headers["Content-Length"]))
        if lines.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield headers, block


def _page_id(urn: str | None) -> int | None:
    value = (urn or "<urn:page:null>")[len("<urn:page:") : -1]
    return None if value == "null" else int(value)


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _reader(payloads: bool):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def rows(path: str) -> Iterator[dict]:
        fs, at = pafs.FileSystem.from_uri(path)
        with fs.open_input_file(at) as stream:
            for headers, block in read_archive(stream):
                http, _, payload = block.partition(b"\r\n\r\n")
                length = int(http.rpartition(b"Content-Length: ")[2])
                kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha256:")
                if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"{path}: {headers['WARC-Record-ID']} is damaged")
                uri = headers.get("WARC-Target-URI")
                yield {
                    "page_id": _page_id(headers["WARC-Record-ID"]), "url": uri, "payload_bytes": length, "payload_digest": digest,
                    "record_type": kind, "refers_to": _page_id(headers.get("WARC-Refers-To")), "payload": payload if payloads and kind == "response" else None,
                }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                held = []
                for row in rows(path):
                    held.append(row)
                    if len(held) >= 512:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held = []
                yield pa.RecordBatch.from_pylist(held, schema=schema)

    return run


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of a manifest's archives, each checked against its digest."""
    n = max(1, manifest.count())
    return manifest.select("path").repartition(n).mapInArrow(_reader(payloads), READ)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page and read the archives back."""
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_archives(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op3_warc": op3_warc}
SQL = {
    "op3_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE strlen(html) >= 100 GROUP BY payload_digest)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, p.payload_digest,
  CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest""",
}
