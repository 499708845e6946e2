"""Written tables in a folder that driver and executors share."""

from __future__ import annotations

import os
import re
import uuid
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, which only a local master may, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (found or f"/tmp/tidegate-{os.getpid()}").rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/tidegate/{what}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, what: str = "table") -> DataFrame:
    """df written as Parquet and read again: its lineage ends there, and what lost executors held is not needed."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def add_files(df: DataFrame, root: str, partition_by: str | None = None) -> list[str]:
    """Write df as further files under root; their paths, as URIs."""
    path = f"{root}/{uuid.uuid4().hex[:12]}"
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return sorted(map(canonical, df.sparkSession.read.schema(df.schema).parquet(path).inputFiles()))


def canonical(uri: str) -> str:
    """file:/x and file:///x are one file."""
    u = urlsplit(uri)
    return f"{u.scheme or 'file'}://{u.netloc}{u.path}"


def read_files(spark: SparkSession, schema, files: list[str], partition_by: str | None = None, file: str | None = None) -> DataFrame:
    """The rows of these files; file: the name of a further column with each row's file.

    A partition's name is read from its folder's, and a filter on it leaves files out.
    """
    # files of several writes: the folder of each, behind which the partitions' begin, is a base of its own
    bases: dict[str, list[str]] = {}
    for f in files:
        at = f.rfind(f"/{partition_by}=") if partition_by else -1
        bases.setdefault(f[:at] if at >= 0 else "", []).append(unquote(f))
    out = None
    for base, some in bases.items():
        reader = spark.read.schema(schema).option("basePath", unquote(base)) if base else spark.read.schema(schema)
        one = reader.parquet(*some)
        one = one.select("*", F.col("_metadata.file_path").alias(file)) if file else one
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = spark.createDataFrame([], schema)
        out = out.withColumn(file, F.lit(None).cast("string")) if file else out
    return out


def delete_files(spark: SparkSession, files: list[str]) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for f in files:
        place = hadoop.Path(spark.sparkContext._jvm.java.net.URI(f))
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, False)
