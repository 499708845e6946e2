"""Time travel: rows carry the seconds at which they were made and deleted (0: not yet)."""

from __future__ import annotations

import re
import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CREATED, DELETED = "_created_at", "_deleted_at"
_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def seconds(text: str, now: float | None = None) -> int:
    """'2024-01-31 10:00:00', seconds since 1970, 'now', or an offset such as '-1 hour'."""
    now = time.time() if now is None else now
    text = text.strip()
    if text.lower() in ("now", "current_timestamp"):
        return int(now)
    if m := re.fullmatch(r"([+-]\s*\d+)\s*([a-zA-Z]+)", text):
        unit = m[2].lower()
        factor = 2592000 if unit.startswith("mon") else 31536000 if unit.startswith("y") else _UNITS.get(unit[0])
        if factor is None:
            raise ValueError(f"unknown unit {m[2]!r}")
        return int(now + int(m[1].replace(" ", "")) * factor)
    if re.fullmatch(r"\d{9,}", text):
        return int(text)
    return int(datetime.fromisoformat(text.replace("Z", "+00:00")).replace(tzinfo=timezone.utc).timestamp())


def live(versions: DataFrame) -> DataFrame:
    return versions.filter(F.col(DELETED) == 0)


def as_of(versions: DataFrame, at: int) -> DataFrame:
    """The rows that were there at a second; the conditions reach the scan."""
    return versions.filter((F.col(CREATED) <= at) & ((F.col(DELETED) == 0) | (F.col(DELETED) > at)))
