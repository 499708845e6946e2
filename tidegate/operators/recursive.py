"""Recursion to a fixed point, for the form that Spark SQL does not have: WITH RECURSIVE ... UNION."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.storage import written

MOST_ROUNDS, MOST_ROWS = 1000, 100_000


def fixpoint(base: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int = MOST_ROUNDS, rows: int | None = MOST_ROWS) -> DataFrame:
    """All rows reached from base by step, each once: cycles converge.

    Semi-naive: a round joins only the last round's new rows, which are a written table, as is everything seen so far
    from time to time; so plans stay short however deep the recursion goes.
    """
    seen = fresh = written(base.distinct(), "recursion")
    total = fresh.count()
    for i in range(rounds):
        columns = seen.columns
        new = step(fresh).toDF(*columns).select([_cast(c, seen) for c in columns]).subtract(seen)
        fresh = written(new, "recursion")
        n = fresh.count()
        if not n:
            return seen
        total += n
        if rows is not None and total > rows:
            raise ValueError(f"recursion made more than {rows} rows")
        seen = seen.unionAll(fresh)
        if i % 16 == 15:
            seen = written(seen, "recursion")
    raise ValueError(f"recursion deeper than {rounds} rounds")


def _cast(column: str, like: DataFrame):
    return F.col(column).cast(like.schema[column].dataType).alias(column)
