"""The dialect's functions as Spark SQL expressions.

Every function is a template: SQL text of its arguments in, SQL text out, built-in functions only unless it says
otherwise, so Catalyst sees through it and code generation covers it. `call` makes a Column of one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegate.functions import conditional, datetime, json, math, regex, strings, vector

Template = Callable[..., str]
SCALAR: dict[str, Template] = {
    **strings.FUNCTIONS, **math.FUNCTIONS, **conditional.FUNCTIONS, **datetime.FUNCTIONS,
    **json.FUNCTIONS, **regex.FUNCTIONS, **vector.FUNCTIONS,
}


def render(name: str, args: list[str]) -> str:
    """SQL of a scalar function of the dialect."""
    template = SCALAR.get(name.upper())
    if template is None:
        raise ValueError(f"unknown function {name}")
    try:
        return template(*args)
    except TypeError as e:
        raise ValueError(f"wrong number of arguments for {name}: {len(args)}") from e


def call(name: str, *args: str) -> Column:
    """A scalar function of the dialect on SQL expressions, e.g. call("SUBSTR", "name", "1", "3")."""
    return F.expr(render(name, list(args)))
