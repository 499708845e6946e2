"""Dates and times: text in, text or numbers out, without zones."""

from __future__ import annotations

import re


def moment(x: str) -> str:
    """A value as a timestamp: ISO text, dates with slashes, a time alone (of the year 0), `now`, or seconds since 1970; else NULL."""
    s = f"cast(({x}) AS string)"
    iso = rf"CASE WHEN {s} rlike '^\\s*[0-9]{{1,2}}:[0-9]{{2}}(:[0-9]{{2}})?\\s*$' THEN concat('0000-01-01 ', trim({s})) WHEN {s} LIKE '%/%' THEN replace({s}, '/', '-') ELSE {s} END"
    return f"(CASE WHEN lower(trim({s})) = 'now' THEN localtimestamp() ELSE coalesce(try_cast({iso} AS timestamp_ntz), cast(timestamp_seconds(try_cast({s} AS double)) AS timestamp_ntz)) END)"


def formatted(pattern: str):
    return lambda x: f"coalesce(date_format({moment(x)}, '{pattern}'), cast(({x}) AS string))"


def _now(pattern: str):
    return lambda: f"date_format(localtimestamp(), '{pattern}')"


def _part(name: str):
    return lambda x: f"cast({name}({moment(x)}) AS bigint)"


#: Specifiers of STRFTIME and their expressions.
SPECIFIERS = {
    "Y": "date_format({0}, 'yyyy')", "m": "date_format({0}, 'MM')", "d": "date_format({0}, 'dd')", "H": "date_format({0}, 'HH')",
    "M": "date_format({0}, 'mm')", "S": "date_format({0}, 'ss')", "j": "date_format({0}, 'DDD')", "w": "cast(dayofweek({0}) - 1 AS string)",
    "W": "lpad(cast(weekofyear({0}) AS string), 2, '0')", "s": "cast(unix_timestamp(cast({0} AS timestamp)) AS string)",
}


def strftime(form: str, x: str = "'now'") -> str:
    """The format must be a literal."""
    text = re.fullmatch(r"'((?:[^'\\]|\\.)*)'", form.strip())
    if not text:
        raise ValueError("STRFTIME needs a literal format")
    parts = []
    for literal, spec in re.findall(r"([^%]+)|%(.)", text[1]):
        if literal:
            parts.append(f"'{literal}'")
        elif spec == "%":
            parts.append("'%'")
        else:
            parts.append(SPECIFIERS[spec].format(moment(x)) if spec in SPECIFIERS else f"'%{spec}'")
    return f"concat({', '.join(parts) or chr(39) * 2})"


def shift(sign: str):
    def template(x: str, n: str) -> str:
        """n days; a date without a time stays one."""
        moved = f"({moment(x)} {sign} make_dt_interval(cast(({n}) AS int)))"
        return f"(CASE WHEN length(cast(({x}) AS string)) <= 10 THEN date_format({moved}, 'yyyy-MM-dd') ELSE date_format({moved}, 'yyyy-MM-dd HH:mm:ss') END)"

    return template


FUNCTIONS = {
    "DATE": formatted("yyyy-MM-dd"),
    "TIME": formatted("HH:mm:ss"),
    "DATETIME": formatted("yyyy-MM-dd HH:mm:ss"),
    "NOW": _now("yyyy-MM-dd HH:mm:ss"),
    "CURRENT_TIMESTAMP": _now("yyyy-MM-dd HH:mm:ss"),
    "CURRENT_DATE": _now("yyyy-MM-dd"),
    "CURRENT_TIME": _now("HH:mm:ss"),
    "STRFTIME": strftime,
    "YEAR": _part("year"),
    "MONTH": _part("month"),
    "DAY": _part("day"),
    "DAYOFMONTH": _part("day"),
    "HOUR": _part("hour"),
    "MINUTE": _part("minute"),
    "SECOND": _part("second"),
    "DAYOFYEAR": _part("dayofyear"),
    "DOY": _part("dayofyear"),
    "DAYOFWEEK": _part("dayofweek"),
    "DOW": _part("dayofweek"),
    "WEEKDAY": _part("weekday"),
    "DATE_ADD": shift("+"),
    "DATE_SUB": shift("-"),
    "DATEDIFF": lambda a, b: f"cast(datediff({moment(a)}, {moment(b)}) AS bigint)",
}
