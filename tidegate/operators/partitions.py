"""Which partition a row belongs to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def route(column: str, how: str, bounds: list[tuple[str, int | None]] | None = None, n: int = 0) -> Column:
    """RANGE: the first partition whose bound is above the value (NULL beyond the last); HASH and LIST: |value| mod n."""
    x = F.col(column).cast("bigint")
    if how == "RANGE":
        out = None
        for name, bound in bounds or []:
            test = F.lit(True) if bound is None else x < bound
            out = F.when(test, name) if out is None else out.when(test, name)
        return F.when(x.isNotNull(), out)
    if how in ("HASH", "LIST") and n > 0:
        return F.abs(x % n).cast("string")
    raise ValueError(f"rows cannot be routed by {how}")
