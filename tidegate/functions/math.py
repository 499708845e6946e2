"""Mathematical functions: results are doubles, a value outside a function's domain gives NULL."""

from __future__ import annotations

import re


def _d(x: str) -> str:
    return f"cast(({x}) AS double)"


#: From here on a double has no digits behind the point, and does not fit a bigint.
_WHOLE = "9007199254740992D"


def _whole(name: str):
    return lambda x: f"(CASE WHEN abs({_d(x)}) < {_WHOLE} THEN cast({name}({_d(x)}) AS double) ELSE {_d(x)} END)"


def _plain(name: str):
    return lambda x: f"{name}({_d(x)})"


def truncate(x: str, n: str = "0") -> str:
    """Toward zero, at n decimal places."""
    scaled = f"abs({_d(x)}) * pow(10D, {n})"
    return f"(CASE WHEN {scaled} < {_WHOLE} THEN sign({_d(x)}) * floor({scaled}) / pow(10D, {n}) ELSE {_d(x)} END)"


def logarithm(a: str, b: str | None = None) -> str:
    """log(x): natural; log(base, x)."""
    if b is None:
        return f"ln({_d(a)})"
    return f"(ln({_d(b)}) / ln({_d(a)}))"


def _extreme(name: str):
    """NULL if any argument is NULL. Arguments of one type keep it; numbers and texts mixed compare as text."""

    def template(*a: str) -> str:
        if len(a) == 1:
            return f"({a[0]})"
        kinds = [set() if re.fullmatch(r"NULL", x) else {"text"} if x.startswith("'") else {"number"} if re.fullmatch(r"-?[\d.]+(e[+-]?\d+)?[LD]?", x, re.I) else {"?"} for x in a]
        mixed = {"text", "number"} <= set().union(*kinds)
        shown = [f"cast(({x}) AS string)" for x in a] if mixed else a
        return f"(CASE WHEN {' OR '.join(f'({x}) IS NULL' for x in a)} THEN NULL ELSE {name}({', '.join(shown)}) END)"

    return template


def _inside(name: str):
    return lambda x: f"(CASE WHEN {_d(x)} BETWEEN -1D AND 1D THEN {name}({_d(x)}) END)"


FUNCTIONS = {
    "ABS": lambda x: f"abs({x})",
    "ROUND": lambda x, n="0": f"round({_d(x)}, {n})",
    "FLOOR": _whole("floor"),
    "CEIL": _whole("ceil"),
    "CEILING": _whole("ceil"),
    "MOD": lambda a, b: f"try_mod({a}, {b})",
    "POWER": lambda a, b: f"pow({_d(a)}, {_d(b)})",
    "POW": lambda a, b: f"pow({_d(a)}, {_d(b)})",
    "SQRT": lambda x: f"(CASE WHEN {_d(x)} >= 0D THEN sqrt({_d(x)}) END)",
    "SIGN": lambda x: f"sign({_d(x)})",
    "TRUNCATE": truncate,
    "TRUNC": truncate,
    "EXP": _plain("exp"),
    "LN": _plain("ln"),
    "LOG": logarithm,
    "LOG10": _plain("log10"),
    "LOG2": _plain("log2"),
    "PI": lambda: "pi()",
    "RADIANS": _plain("radians"),
    "DEGREES": _plain("degrees"),
    "GREATEST": _extreme("greatest"),
    "LEAST": _extreme("least"),
    **{n: _plain(n.lower()) for n in ("SIN", "COS", "TAN", "ATAN", "COT", "SINH", "COSH", "TANH")},
    "ASIN": _inside("asin"),
    "ACOS": _inside("acos"),
    "ATAN2": lambda y, x: f"atan2({_d(y)}, {_d(x)})",
    "RANDOM": lambda: "floor(rand() * 9223372036854775807D)",
    # user functions of the embedded host
    "SQUARE": lambda x: f"(({x}) * ({x}))",
    "CUBE": lambda x: f"(({x}) * ({x}) * ({x}))",
    "ABS_VAL": lambda x: f"abs({x})",
    "POWER_INT": lambda a, b: f"cast(pow({_d(a)}, {_d(b)}) AS bigint)",
}
