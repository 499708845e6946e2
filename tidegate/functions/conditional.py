"""Conditional, type and session functions, and casts that never fail."""

from __future__ import annotations

from tidegate.types import spark_type


def cast(x: str, kind: str) -> str:
    """CAST: text that is no number gives 0, decimals are cut toward zero; dates and times stay as they are."""
    to = spark_type(kind)
    number = f"try_cast(({x}) AS double)"
    if to == "bigint":
        return f"(CASE WHEN ({x}) IS NULL THEN NULL ELSE coalesce(try_cast(({x}) AS bigint), try_cast({number} AS bigint), 0L) END)"
    if to == "double":
        return f"(CASE WHEN ({x}) IS NULL THEN NULL ELSE coalesce({number}, 0D) END)"
    if to == "boolean":
        return f"(CASE WHEN ({x}) IS NULL THEN NULL ELSE lower(cast(({x}) AS string)) IN ('true', '1') OR coalesce({number} != 0, false) END)"
    if to == "string" and kind.strip().upper().split("(")[0] in ("DATE", "TIMESTAMP", "DATETIME", "TIME", "JSON"):
        return f"({x})"
    return f"cast(({x}) AS {to})"


def typeof(x: str) -> str:
    return f"(CASE WHEN ({x}) IS NULL THEN 'null' WHEN typeof({x}) IN ('tinyint', 'smallint', 'int', 'bigint', 'boolean') THEN 'integer' WHEN typeof({x}) IN ('float', 'double') OR typeof({x}) LIKE 'decimal%' THEN 'real' ELSE 'text' END)"


def truth(x: str) -> str:
    """Whether a value counts as true: numbers other than 0, strings that are not empty."""
    return f"(CASE WHEN typeof({x}) = 'string' THEN cast(({x}) AS string) != '' ELSE cast(cast(({x}) AS string) AS double) != 0 OR cast(({x}) AS string) = 'true' END)"


def test(value: str):
    if value == "NULL":
        return lambda x: f"(({x}) IS NULL)"
    return lambda x: f"({truth(x)} IS {value})"


FUNCTIONS = {
    "COALESCE": lambda *a: f"coalesce({', '.join(a)})",
    "IFNULL": lambda a, b: f"coalesce({a}, {b})",
    "NULLIF": lambda a, b: f"nullif({a}, {b})",
    "IIF": lambda c, a, b: f"if({c}, {a}, {b})",
    "IF": lambda c, a, b: f"if({c}, {a}, {b})",
    "TYPEOF": typeof,
    "ZEROBLOB": lambda n: f"repeat(decode(unhex('00'), 'UTF-8'), cast(({n}) AS int))",
    "IS_TRUE": test("TRUE"),
    "IS_FALSE": test("FALSE"),
    "IS_UNKNOWN": test("NULL"),
    "VERSION": lambda: "'8.0.0'",
    "DATABASE": lambda: "'main'",
    "SCHEMA": lambda: "'main'",
    "CONNECTION_ID": lambda: "1L",
    "USER": lambda: "'root@localhost'",
    "CURRENT_USER": lambda: "'root@localhost'",
    "SESSION_USER": lambda: "'root@localhost'",
    "SYSTEM_USER": lambda: "'root@localhost'",
}
