"""Windows of the dialect's meaning."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from tidegate.operators.sort import ordering


def over(partition: list[str], order: list[str] | None = None, rows: tuple[int, int] | None = None) -> WindowSpec:
    """Partition and order (see sort.ordering); rows: a frame of physical rows, e.g. (-2, 0)."""
    spec = Window.partitionBy(*partition)
    if order:
        spec = spec.orderBy(*ordering(*order))
    return spec.rowsBetween(*rows) if rows else spec


def filtered(aggregate, value: str | None, condition: Column, spec: WindowSpec) -> Column:
    """AGG(value) FILTER (WHERE condition) OVER spec, which Spark does not have: other rows' values are NULL."""
    return aggregate(F.when(condition, F.lit(1) if value is None else F.col(value))).over(spec)


def first_value(column: str, partition: list[str], order: list[str]) -> Column:
    """Of the partition, whatever the frame."""
    return F.first(column).over(over(partition, order, (Window.unboundedPreceding, Window.unboundedFollowing)))


def last_value(column: str, partition: list[str], order: list[str], framed: bool = False) -> Column:
    """Without a frame the last peer's; with any frame the partition's last."""
    spec = over(partition, order)
    return F.last(column).over(spec.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing) if framed else spec)
