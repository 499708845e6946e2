"""Constraints as queries over the rows to be written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ConstraintError(ValueError):
    """Rows that break a constraint."""


def nulls(df: DataFrame, columns: list[str]) -> Column:
    """Whether a row lacks a value that it needs."""
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).isNull()
    return out


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that more than one row has; keys with a NULL do not count."""
    return df.filter(~nulls(df, key)).groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(child: DataFrame, columns: list[str], parent: DataFrame, target: list[str]) -> DataFrame:
    """Rows whose foreign key is nowhere in the parent; a NULL in the key refers to nothing."""
    keys = parent.select([F.col(t).alias(f"_p{i}") for i, t in enumerate(target)])
    return child.filter(~nulls(child, columns)).join(keys, [F.col(c) == F.col(f"_p{i}") for i, c in enumerate(columns)], "left_anti")


def demand(rows: DataFrame, what: str) -> None:
    """Fail if there are any rows."""
    if rows.take(1):
        raise ConstraintError(what)
