"""Order and limits: NULLs come last ascending and first descending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordering(*keys: str) -> list[Column]:
    """Keys like "name" or "-name" (descending)."""
    return [F.col(k[1:]).desc_nulls_first() if k.startswith("-") else F.col(k).asc_nulls_last() for k in keys]


def top(df: DataFrame, n: int, *keys: str, offset: int = 0) -> DataFrame:
    """The first n rows behind offset in order; without an offset a partial top-k in every task, never a whole sort."""
    ordered = df.orderBy(*ordering(*keys))
    return ordered.offset(offset).limit(n) if offset else ordered.limit(n)
