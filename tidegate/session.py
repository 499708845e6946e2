"""Spark sessions with the settings that the dialect needs."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Arithmetic wraps, bad casts and divisions by zero give NULL, times have no zone, recursion has the dialect's limits.
DIALECT = {
    "spark.sql.ansi.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.cteRecursionLevelLimit": "1000",
    "spark.sql.cteRecursionRowLimit": "100000",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def create(master: str = "local[*]", name: str = "tidegate", **conf: str) -> SparkSession:
    """A session of one's own; on a cluster, pass the session that is there to Engine instead."""
    builder = SparkSession.builder.master(master).appName(name)
    for k, v in {**DIALECT, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def dialect_session(spark: SparkSession) -> SparkSession:
    """A new session beside the given one: its settings and temporary views are its own, data and executors are shared."""
    new = spark.newSession()
    for k, v in DIALECT.items():
        new.conf.set(k, v)
    return new
