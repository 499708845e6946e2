"""Dialect type names and their Spark types."""

from __future__ import annotations

import re

from pyspark.sql import types as T

#: Synonyms of the dialect's types. Lengths and precisions are read and ignored; DATE and its kin are text.
NAMES = {
    "INTEGER": "bigint", "INT": "bigint", "BIGINT": "bigint", "SMALLINT": "bigint", "TINYINT": "bigint",
    "TEXT": "string", "STRING": "string", "VARCHAR": "string", "CHAR": "string", "NVARCHAR": "string", "NCHAR": "string", "CLOB": "string",
    "REAL": "double", "FLOAT": "double", "DOUBLE": "double", "NUMERIC": "double", "DECIMAL": "double",
    "BLOB": "binary", "BOOLEAN": "boolean", "BOOL": "boolean", "JSON": "string",
    "DATE": "string", "TIMESTAMP": "string", "DATETIME": "string", "TIME": "string", "VECTOR": "array<double>",
}


def spark_type(name: str) -> str:
    """The Spark type of a declared type, e.g. VARCHAR(20) or VECTOR(3)."""
    word = re.match(r"\s*([A-Za-z]+)", name)
    if not word or word[1].upper() not in NAMES:
        raise ValueError(f"unknown type {name!r}")
    return NAMES[word[1].upper()]


def dialect_type(kind: T.DataType) -> str:
    """The dialect's name of a Spark type."""
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return "INTEGER"
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        return "REAL"
    if isinstance(kind, T.BooleanType):
        return "BOOLEAN"
    if isinstance(kind, T.BinaryType):
        return "BLOB"
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.DoubleType, T.FloatType)):
        return "VECTOR"
    return "TEXT"
