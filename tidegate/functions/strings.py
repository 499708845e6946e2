"""String functions. Lengths and positions count bytes, as the dialect does."""

from __future__ import annotations

import re


def _bytes(s: str) -> str:
    return f"cast(({s}) AS binary)"


def substr(s: str, p: str, n: str | None = None) -> str:
    """From position p (1-based; 0 counts as 1; negative from the end, at most to the beginning), n bytes or the rest."""
    s = f"cast(({s}) AS string)"
    at = f"CASE WHEN ({p}) = 0 THEN 1 WHEN ({p}) < 0 THEN greatest(cast(({p}) AS int), -octet_length({s})) ELSE cast(({p}) AS int) END"
    if n is None:
        return f"cast(substring({_bytes(s)}, {at}) AS string)"
    return f"(CASE WHEN ({n}) < 0 THEN '' ELSE cast(substring({_bytes(s)}, {at}, cast(({n}) AS int)) AS string) END)"


def trim(side: str):
    def template(s: str, chars: str | None = None) -> str:
        return f"trim({side} {chars or chr(39) + ' ' + chr(92) + 't' + chr(92) + 'r' + chr(92) + 'n' + chr(39)} FROM ({s}))"

    return template


def locate(needle: str, hay: str, start: str | None = None) -> str:
    if start is None:
        return instr(hay, needle)
    tail = substr(hay, start)
    return f"(CASE WHEN ({start}) < 1 THEN 0L WHEN {instr(tail, needle)} > 0 THEN {instr(tail, needle)} + ({start}) - 1 ELSE {instr(tail, needle)} END)"


def instr(hay: str, needle: str) -> str:
    at = f"instr({hay}, {needle})"
    return f"(CASE WHEN {at} > 0 THEN cast(octet_length(left({hay}, {at} - 1)) + 1 AS bigint) ELSE cast({at} AS bigint) END)"


def pad(side: str):
    def template(s: str, n: str, fill: str = "' '") -> str:
        """n bytes; a fill of several bytes may be cut within a character."""
        left, s = substr(s, "1", n), f"cast(({s}) AS string)"
        filled = f"substring({_bytes(f'repeat({fill}, cast(({n}) AS int))')}, 1, cast(({n}) AS int) - octet_length({s}))"
        parts = [filled, _bytes(s)] if side == "lpad" else [_bytes(s), filled]
        return f"(CASE WHEN octet_length({s}) >= ({n}) THEN {left} WHEN ({fill}) = '' THEN {s} ELSE cast(concat({', '.join(parts)}) AS string) END)"

    return template


def printf(form: str, *args: str) -> str:
    """%s, %d and %i (cut toward zero), %f (six places), each with the next argument, nothing for what is no number.

    A format that is no literal is read for each row, with the arguments as texts.
    """
    text = re.fullmatch(r"'((?:[^'\\]|\\.)*)'", form.strip(), re.DOTALL)
    if not text:
        return f"format_string(regexp_replace({form}, '%[dif]', '%s'){''.join(f', cast(({a}) AS string)' for a in args)})"
    given, parts = iter(args), []
    for plain, spec in re.findall(r"((?:[^%]|%(?![sdif]))+)|%([sdif])", text[1]):
        if plain:
            parts.append(f"'{plain}'")
            continue
        x = next(given, None)
        if x is None:
            continue
        number = f"try_cast(({x}) AS double)"
        shown = f"cast(({x}) AS string)" if spec == "s" else f"format_string('%f', {number})" if spec == "f" else f"cast(cast({number} AS bigint) AS string)"
        parts.append(f"if(({x if spec == 's' else number}) IS NULL, '', {shown})")
    return f"concat({', '.join(parts) or chr(39) * 2})"


def char(*codes: str) -> str:
    return "concat(" + ", ".join(f"decode(unhex(lpad(hex(cast(({c}) AS bigint)), 8, '0')), 'UTF-32')" for c in codes) + ")"


def hexadecimal(x: str) -> str:
    """Numbers, and strings that look like one, as unsigned 64-bit integers; other strings by their bytes."""
    number = f"try_cast(cast(({x}) AS string) AS double)"
    return f"(CASE WHEN {number} IS NOT NULL THEN hex(cast({number} AS bigint)) ELSE hex(cast(({x}) AS string)) END)"


def glob(pattern: str, s: str) -> str:
    """* and ?, over the whole string."""
    quoted = rf"regexp_replace({pattern}, '([^A-Za-z0-9*?])', '\\\\$1')"
    return rf"(({s}) rlike concat('(?s)^', replace(replace({quoted}, '*', '.*'), '?', '.'), '$'))"


def quote(x: str) -> str:
    return f"(CASE WHEN ({x}) IS NULL THEN 'NULL' WHEN typeof({x}) IN ('tinyint', 'smallint', 'int', 'bigint', 'float', 'double') THEN cast(({x}) AS string) ELSE concat(chr(39), replace(cast(({x}) AS string), chr(39), concat(chr(39), chr(39))), chr(39)) END)"


def length(s: str) -> str:
    return f"cast(octet_length(cast(({s}) AS string)) AS bigint)"


FUNCTIONS = {
    "LENGTH": length,
    "LEN": length,
    "UPPER": lambda s: f"upper({s})",
    "LOWER": lambda s: f"lower({s})",
    "TRIM": trim("BOTH"),
    "LTRIM": trim("LEADING"),
    "RTRIM": trim("TRAILING"),
    "SUBSTR": substr,
    "SUBSTRING": substr,
    "CONCAT": lambda *a: f"concat({', '.join(a)})",
    "CONCAT_WS": lambda sep, *a: f"concat_ws({', '.join([sep, *(f'cast(({x}) AS string)' for x in a)])})",
    "REPLACE": lambda s, a, b: f"replace({s}, {a}, {b})",
    "INSTR": instr,
    "LOCATE": locate,
    "POSITION": locate,
    "SUBSTRING_INDEX": lambda s, d, n: f"substring_index({s}, {d}, cast(({n}) AS int))",
    "ASCII": lambda s: f"(CASE WHEN ({s}) = '' THEN 0L ELSE cast(conv(substring(hex(cast(({s}) AS string)), 1, 2), 16, 10) AS bigint) END)",
    "UNICODE": lambda s: f"cast(nullif(ascii({s}), 0) AS bigint)",
    "CHAR": char,
    "PRINTF": printf,
    "REVERSE": lambda s: f"reverse({s})",
    "REPEAT": lambda s, n: f"repeat({s}, cast(({n}) AS int))",
    "LEFT": lambda s, n: substr(s, "1", f"greatest(0, ({n}))"),
    "RIGHT": lambda s, n: f"(CASE WHEN ({n}) <= 0 THEN '' ELSE {substr(s, f'-({n})')} END)",
    "LPAD": pad("lpad"),
    "RPAD": pad("rpad"),
    "HEX": hexadecimal,
    "QUOTE": quote,
    "GLOB": glob,
}
