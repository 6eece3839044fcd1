"""Tables that an operator writes to cut its lineage: in the cluster's checkpoint folder, deleted when nothing reads them any more."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


@lru_cache(1)
def _local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="lodestrand-core-")


def written(df: DataFrame, what: str = "table") -> DataFrame:
    """``df`` written once and read again; in the folder of ``spark.checkpoint.dir``, one of this machine's only where none is set and all runs here."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _local_dir()
    path = f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    counted = Observation()
    df.observe(counted, F.count(F.lit(1)).alias("n")).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at, out._rows = path, counted.get["n"]
    return out


def rows(table: DataFrame) -> int:
    """How many rows ``written`` wrote, counted on the way; no job."""
    return table._rows


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made, once all that reads them is written."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
