"""Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairnstat.session import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``{folder}/{name}.parquet``, a file or a directory of files."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
