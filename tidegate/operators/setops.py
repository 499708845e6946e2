"""Set operations, from left to right; NULLs are equal to each other."""

from __future__ import annotations

from pyspark.sql import DataFrame

OPERATIONS = {
    "UNION": lambda a, b: a.union(b).distinct(),
    "UNION ALL": lambda a, b: a.union(b),
    "INTERSECT": lambda a, b: a.intersect(b),
    "INTERSECT ALL": lambda a, b: a.intersectAll(b),
    "EXCEPT": lambda a, b: a.subtract(b),
    "EXCEPT ALL": lambda a, b: a.exceptAll(b),
}


def chain(first: DataFrame, *rest: tuple[str, DataFrame]) -> DataFrame:
    """first op second op third ..., all operations of equal rank."""
    for how, df in rest:
        if len(df.columns) != len(first.columns):
            raise ValueError(f"{how}: {len(first.columns)} and {len(df.columns)} columns")
        first = OPERATIONS[how.upper()](first, df)
    return first
