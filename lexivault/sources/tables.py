"""Parquet tables in one folder, each ``<name>.parquet`` (a file or a folder of files)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The named table; columns are pruned and filters pushed into the scan by Catalyst."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
