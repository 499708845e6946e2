"""Regular expressions, unanchored. Patterns of RE2's syntax: POSIX classes and (?P<name>...) become Java's."""

from __future__ import annotations

import re

#: POSIX classes, which stand within brackets, and their Java names.
CLASSES = {"alnum": "Alnum", "alpha": "Alpha", "ascii": "ASCII", "blank": "Blank", "cntrl": "Cntrl", "digit": "Digit", "graph": "Graph", "lower": "Lower", "print": "Print", "punct": "Punct", "space": "Space", "upper": "Upper", "xdigit": "XDigit"}


def java(pattern: str) -> str:
    """The pattern for Java: a literal is rewritten here, another expression for each row."""
    if not re.fullmatch(r"'(?:[^'\\]|\\.)*'", pattern.strip(), re.DOTALL):
        out = f"replace({pattern}, '(?P<', '(?<')"
        return f"if(contains({pattern}, '[:'), {_all(out)}, {out})"
    out = pattern.replace("(?P<", "(?<")
    for posix, name in CLASSES.items():
        out = out.replace(f"[:{posix}:]", rf"\\p{{{name}}}").replace(f"[:^{posix}:]", rf"\\P{{{name}}}")
    return out.replace("[:word:]", r"\\w")


def _all(x: str) -> str:
    for posix, name in CLASSES.items():
        x = rf"replace({x}, '[:{posix}:]', '\\p{{{name}}}')"
    return x


FUNCTIONS = {
    "REGEXP_LIKE": lambda s, p: f"(({s}) rlike ({java(p)}))",
    "REGEXP_MATCH": lambda s, p: f"(coalesce(({s}), '') != '' AND ({s}) rlike ({java(p)}))",
    "REGEXP_REPLACE": lambda s, p, r: f"regexp_replace({s}, {java(p)}, {r})",
    "REGEXP_EXTRACT": lambda s, p: f"regexp_extract_all({s}, {java(p)}, 0)",
}
