"""Foreign tables: a wrapper's name, declared columns and options make a DataFrame. CSV is built in, others register."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Opener = Callable[[SparkSession, list[tuple[str, str]], dict[str, str]], DataFrame]
_wrappers: dict[str, Opener] = {}


def register(name: str, opener: Opener) -> None:
    """Make a wrapper known; opener(spark, [(column, Spark type)], options) gives the rows.

    A Python data source (pyspark.sql.datasource) fits: register it with the session and open it by its format.
    """
    _wrappers[name.lower()] = opener


def open_table(spark: SparkSession, wrapper: str, columns: list[tuple[str, str]], options: dict[str, str]) -> DataFrame:
    if wrapper.lower() not in _wrappers:
        raise ValueError(f"unknown wrapper {wrapper!r}")
    return _wrappers[wrapper.lower()](spark, columns, {k.lower(): v for k, v in options.items()})


def is_header(cells: list[str]) -> bool:
    """A first line with a cell that is no number names the columns."""

    def number(x: str) -> bool:
        try:
            float(x)
            return True
        except ValueError:
            return False

    return any(not number(c) for c in cells)


def csv(spark: SparkSession, columns: list[tuple[str, str]], options: dict[str, str]) -> DataFrame:
    """Options: file, delimiter, header (true, false or sniffed), max_rows, max_field_bytes, max_columns.

    Columns go by place; a cell that does not fit its type is NULL. Beyond a limit the query fails. The schema is
    declared, so nothing is inferred, unused columns are not parsed and conditions reach the reader.
    """
    path, sep = options["file"], options.get("delimiter", ",")
    header = options.get("header")
    if header is None:
        first = spark.read.option("sep", sep).csv(path).limit(1).collect()
        header = str(bool(first) and is_header(["" if c is None else c for c in first[0]])).lower()
    limits = int(options.get("max_rows", 0)), int(options.get("max_field_bytes", 0)), int(options.get("max_columns", 0))
    if limits[2] and len(columns) > limits[2]:
        raise ValueError(f"column limit exceeded: {len(columns)} > {limits[2]}")
    schema = ", ".join(f"`{c}` {t}" for c, t in columns)
    df = spark.read.schema(schema).option("sep", sep).option("header", header).option("enforceSchema", "true").csv(path)
    if limits[0] and df.limit(limits[0] + 1).count() > limits[0]:
        raise ValueError(f"row limit exceeded: more than {limits[0]} rows")
    if limits[1]:
        for c, t in columns:
            if t == "string":
                df = df.withColumn(c, F.when(F.octet_length(c) > limits[1], F.raise_error(F.lit("field too long"))).otherwise(F.col(c)))
    return df


def _by_format(name: str) -> Opener:
    def opener(spark: SparkSession, columns: list[tuple[str, str]], options: dict[str, str]) -> DataFrame:
        rest = {k: v for k, v in options.items() if k != "file"}
        return spark.read.format(name).schema(", ".join(f"`{c}` {t}" for c, t in columns)).options(**rest).load(options.get("file"))

    return opener


register("csv", csv)
for _name in ("parquet", "orc", "json"):  # beyond the dialect's own wrapper
    register(_name, _by_format(_name))
