"""What the corpus operators share: the cluster's common folder, sizing and input normalisation."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that the contracts count as white space, as a SQL-free Python literal.
BLANKS = " \t\n\x0b\x0c\r"


#: Bytes after which Spark ends an Arrow batch, so a batch of long texts is as small as one of short texts.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by ``BATCH_BYTES``; a lower bound stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = int(re.sub(r"\D", "", spark.conf.get(key)) or 0)
    if not 0 < held <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


@lru_cache(1)
def _local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="lodestrand-")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a temporary one if all runs on this machine, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _local_dir()
    return root.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder once and read it back."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def free(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote, once everything made from them is written."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: The optimizer's estimate where it knows nothing, and what a row counts then.
UNKNOWN, ROW_BYTES = 1 << 60, 1000


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the plan's size, read without a pass over files; rows are counted where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < UNKNOWN else df.count() * ROW_BYTES


def group_count(df: DataFrame, target: int, least: int = 32, most: int = 1 << 62) -> int:
    """How many groups keep each near ``target`` estimated bytes; grows in proportion to the input, up to ``most``."""
    return min(most, max(least, estimated_bytes(df) // target))


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id long, text string): only the columns needed, so others can bear any name; null text is empty."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def whole(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, whatever their names."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])
