"""Folders of Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """<folder>/<name>.parquet, a file or a folder; filters and columns are pushed into the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*(partition_by or [])).parquet(path)
