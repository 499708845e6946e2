"""Tokens of the dialect."""

from __future__ import annotations

import re
from typing import NamedTuple

MOST_BYTES, MOST_TOKENS = 1 << 20, 1 << 16


class DialectError(ValueError):
    """A statement that the dialect does not have."""


class Token(NamedTuple):
    kind: str  # word, name (quoted), string, number, blob, op, param, sysvar, end
    text: str

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "word" else ""


_PATTERN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|\#[^\n]*|/\*.*?\*/)
    |(?P<blob>[xX]'[0-9A-Fa-f]*')
    |(?P<string>'(?:[^'\\]|''|\\.)*')
    |(?P<dq>"(?:[^"\\]|""|\\.)*")
    |(?P<bt>`[^`]*`)
    |(?P<number>0[xX][0-9A-Fa-f]+|\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)
    |(?P<sysvar>@@[\w.]+)
    |(?P<word>[^\W\d]\w*)
    |(?P<param>\?)
    |(?P<op><=>|->>|\|\||<<|>>|<>|!=|<=|>=|->|@>|==|[-+*/%=<>(),.;\[\]&|^~:])""",
    re.VERBOSE | re.DOTALL,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}


def _unquoted(text: str) -> str:
    q = text[0]
    return re.sub(rf"{q}{q}|\\(.)", lambda m: q if m[1] is None else _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.DOTALL)


def tokens(sql: str) -> list[Token]:
    if len(sql.encode()) > MOST_BYTES:
        raise DialectError("statement too long")
    out, at = [], 0
    while at < len(sql):
        m = _PATTERN.match(sql, at)
        if not m:
            raise DialectError(f"unexpected character {sql[at]!r} at {at}")
        at, kind = m.end(), m.lastgroup
        if kind == "space":
            continue
        text = m[0]
        if kind in ("string", "dq"):
            out.append(Token("string" if kind == "string" else "name", _unquoted(text)))
        elif kind == "bt":
            out.append(Token("name", text[1:-1]))
        elif kind == "blob":
            out.append(Token("blob", text[2:-1]))
        else:
            out.append(Token(kind, text))
        if len(out) > MOST_TOKENS:
            raise DialectError("too many tokens")
    return [*out, Token("end", "")]
