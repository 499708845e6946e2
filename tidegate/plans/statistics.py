"""ANALYZE: statistics of all columns in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def analyze(df: DataFrame) -> DataFrame:
    """column_name, row_count, distinct_count (approximate), null_count, min_value, max_value."""
    plain = [c for c, t in df.dtypes if not t.startswith(("map", "array", "struct", "variant"))]
    aggs = [F.count("*").alias("_n")]
    for i, c in enumerate(df.columns):
        q = f"`{c}`"
        aggs.append(F.sum(F.col(q).isNull().cast("long")).alias(f"_null{i}"))
        if c in plain:
            aggs += [F.approx_count_distinct(q).alias(f"_ndv{i}"), F.min(q).cast("string").alias(f"_min{i}"), F.max(q).cast("string").alias(f"_max{i}")]
    one = df.agg(*aggs)
    structs = [
        F.struct(
            F.lit(c).alias("column_name"), F.col("_n").alias("row_count"),
            (F.col(f"_ndv{i}") if c in plain else F.lit(None).cast("long")).alias("distinct_count"),
            F.coalesce(F.col(f"_null{i}"), F.lit(0)).alias("null_count"),
            (F.col(f"_min{i}") if c in plain else F.lit(None).cast("string")).alias("min_value"),
            (F.col(f"_max{i}") if c in plain else F.lit(None).cast("string")).alias("max_value"))
        for i, c in enumerate(df.columns)
    ]
    return one.select(F.explode(F.array(*structs)).alias("s")).select("s.*")
