"""Windowed counts of an event stream, batch or streaming alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, time: str, size: str, keys: list[str], value: str, late: str | None = None) -> DataFrame:
    """Per window of `size` and keys: n events, total of value. late: how long a stream waits (its watermark)."""
    df = events.withColumn("_t", F.col(time).cast("timestamp"))
    if events.isStreaming:
        df = df.withWatermark("_t", late or size)
    out = df.groupBy(F.window("_t", size), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, key: str, late: str | None = None) -> DataFrame:
    """Per key, runs of events without a pause of `gap`: session_start, session_end, n."""
    df = events.withColumn("_t", F.col(time).cast("timestamp"))
    if events.isStreaming:
        df = df.withWatermark("_t", late or gap)
    out = df.groupBy(F.session_window("_t", gap), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")
