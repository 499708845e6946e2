"""JSON functions on text. Those that change a document are Arrow-batched Python functions; the rest are built in."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def extract(doc: str, path: str) -> str:
    """NULL where the path leads nowhere or the document is no JSON; strings lose their quotes."""
    return f"get_json_object(cast(({doc}) AS string), {path})"


def kind(doc: str, path: str | None = None) -> str:
    v = f"try_parse_json(cast(({doc}) AS string))"
    if path is not None:
        v = f"try_variant_get({v}, {path}, 'variant')"
    s = f"schema_of_variant({v})"
    return f"(CASE WHEN {s} LIKE 'OBJECT%' THEN 'object' WHEN {s} LIKE 'ARRAY%' THEN 'array' WHEN {s} = 'STRING' THEN 'string' WHEN {s} = 'BOOLEAN' THEN 'boolean' WHEN {s} = 'VOID' THEN 'null' WHEN {s} IS NOT NULL THEN 'number' END)"


def make_object(*a: str) -> str:
    if len(a) % 2:
        raise ValueError("JSON_OBJECT needs keys and values in pairs")
    if not all(re.fullmatch(r"'(?:[^'\\]|\\.)*'", k) for k in a[::2]):  # keys of rows: member by member, in the order given
        members = [f"concat({FUNCTIONS['JSON_QUOTE'](k)}, ':', {_element(v)})" for k, v in zip(a[::2], a[1::2])]
        return f"concat('{{', concat_ws(',', {', '.join(members)}), '}}')"
    pairs = ", ".join(f"{k}, {v}" for k, v in zip(a[::2], a[1::2]))
    return f"to_json(named_struct({pairs}), map('ignoreNullFields', 'false'))" if a else "'{}'"


def _element(x: str) -> str:
    """A value of any type as JSON."""
    one = f"substring(to_json(named_struct('a', {x}), map('ignoreNullFields', 'false')), 6)"
    return f"left({one}, length({one}) - 1)"


def make_array(*a: str) -> str:
    """Elements of any types, one by one."""
    return f"concat('[', concat_ws(',', {', '.join(map(_element, a))}), ']')" if a else "'[]'"


FUNCTIONS = {
    "JSON_EXTRACT": extract,
    "JSON_VALID": lambda x: f"(try_parse_json({x}) IS NOT NULL)",
    "JSON_ARRAY_LENGTH": lambda x: f"(CASE WHEN ({x}) IS NOT NULL THEN cast(coalesce(json_array_length({x}), 0) AS bigint) END)",
    "JSON_TYPE": kind,
    "JSON_KEYS": lambda x: f"array_sort(json_object_keys({x}))",
    "JSON_QUOTE": lambda x: f"(CASE WHEN ({x}) IS NOT NULL THEN regexp_extract(to_json(named_struct('a', cast(({x}) AS string))), '^.{{5}}(.*)[}}]$', 1) END)",
    "JSON_UNQUOTE": lambda x: f"(CASE WHEN ({x}) LIKE '\"%\"' THEN coalesce(try_variant_get(try_parse_json({x}), '$', 'string'), {x}) ELSE ({x}) END)",
    "JSON_OBJECT": make_object,
    "JSON_ARRAY": make_array,
    "JSON_SET": lambda d, p, v: f"tidegate_json_set({d}, {p}, cast(({v}) AS string))",
    "JSON_REMOVE": lambda d, p: f"tidegate_json_remove({d}, {p})",
    "JSON_PRETTY": lambda d: f"tidegate_json_pretty({d})",
    "JSON_MINIFY": lambda d: f"tidegate_json_minify({d})",
    "JSON_MERGE": lambda a, b: f"tidegate_json_merge({a}, {b})",
}


def _load(text: str | None):
    try:
        return json.loads(text) if text is not None else None
    except ValueError:
        return None


def _steps(path: str) -> list[str | int]:
    return [int(i) if i else (q or k) for k, i, q in re.findall(r"\.([^.\[\]]+)|\[(\d+)\]|\['([^']*)'\]", path)]


def _dump(x, **how) -> str:
    return json.dumps(x, sort_keys=True, ensure_ascii=False, **({"separators": (",", ":")} | how))


def set_path(text: str | None, path: str | None, value: str | None) -> str | None:
    """The value is read as JSON if it is, and as a string else. Missing objects on the way are made."""
    doc = _load(text)
    if doc is None or path is None:
        return None
    try:
        new = json.loads(value) if value is not None else None
    except ValueError:
        new = value
    steps = _steps(path)
    if not steps:
        return _dump(new)
    at = doc
    for i, step in enumerate(steps):
        last = i == len(steps) - 1
        if isinstance(step, int):
            if not isinstance(at, list) or step > len(at) or (step == len(at) and not last):
                return None
            if last:
                at[step : step + 1] = [new]
            else:
                at = at[step]
        elif not isinstance(at, dict):
            return None
        elif last:
            at[step] = new
        else:
            at = at.setdefault(step, {})
    return _dump(doc)


def remove_path(text: str | None, path: str | None) -> str | None:
    """A path that leads nowhere removes nothing."""
    doc = _load(text)
    if doc is None or path is None:
        return None
    *way, last = _steps(path) or [None]
    at = doc
    for step in way:
        if isinstance(at, dict) and step in at or isinstance(at, list) and isinstance(step, int) and step < len(at):
            at = at[step]
        else:
            return _dump(doc)
    if isinstance(at, dict):
        at.pop(last, None)
    elif isinstance(at, list) and isinstance(last, int) and last < len(at):
        del at[last]
    return _dump(doc)


def merge(a: str | None, b: str | None) -> str | None:
    """Objects merge deeply, arrays join, else the right one wins."""
    x, y = _load(a), _load(b)
    if a is None or b is None:
        return None

    def both(x, y):
        if isinstance(x, dict) and isinstance(y, dict):
            return x | {k: both(x[k], v) if k in x else v for k, v in y.items()}
        return x + y if isinstance(x, list) and isinstance(y, list) else y

    return _dump(both(x, y))


def pretty(text: str | None) -> str | None:
    doc = _load(text)
    return None if doc is None else _dump(doc, indent=2, separators=(",", ": "))


def minify(text: str | None) -> str | None:
    doc = _load(text)
    return None if doc is None else _dump(doc)


def _null(x):
    return None if x is None or x != x else x


def register(spark: SparkSession) -> None:
    """Make the changing functions known to a session's SQL."""

    def set_(d: pd.Series, p: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series([set_path(*map(_null, x)) for x in zip(d, p, v)], dtype=object)

    def remove(d: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([remove_path(*map(_null, x)) for x in zip(d, p)], dtype=object)

    def merged(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([merge(*map(_null, x)) for x in zip(a, b)], dtype=object)

    def pretty_(d: pd.Series) -> pd.Series:
        return pd.Series([pretty(_null(x)) for x in d], dtype=object)

    def minify_(d: pd.Series) -> pd.Series:
        return pd.Series([minify(_null(x)) for x in d], dtype=object)

    for name, f in (("set", set_), ("remove", remove), ("merge", merged), ("pretty", pretty_), ("minify", minify_)):
        spark.udf.register(f"tidegate_json_{name}", F.pandas_udf(f, "string"))
