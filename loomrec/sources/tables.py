"""Readers of the project's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` of a data folder (one Parquet file or directory each)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
