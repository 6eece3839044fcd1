"""Parquet table access by directory and name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables stored as ``<sf_dir>/<name>.parquet``; Spark's readers open the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
