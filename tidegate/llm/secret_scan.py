"""Secret scan by a trigram inverted index.

Each block of texts gets an index of the trigrams that some rule can ask for. From every rule's expression a Boolean
query of mandatory trigrams is derived; its postings are intersected and united to find candidate texts, which the
expression then verifies. A rule without mandatory trigrams scans every text.
"""

from __future__ import annotations

import re
import re._constants as op
import re._parser as parser
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm import _common as C


class Rule(NamedTuple):
    """A kind of secret; matches shorter than `least` characters (of `group`) are dropped."""

    kind: str
    pattern: str
    flags: int = 0
    group: int = 0
    least: int = 0


#: In the order of their kinds. The first three are the base rules. Letters match in either case within ASCII only.
RULES: list[Rule] = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # a run of these characters is one match, so shorter ones need not be found first
    Rule("temporary", r"ASIA[A-Z0-9]{16}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("code_host", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("package_host", r"npm_[A-Za-z0-9]{36}"),
    Rule("chat", r"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("payment", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("mail", r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9+/_.=-]{20,}", re.IGNORECASE),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^\s:/@]{1,64}:[^\s:/@]{3,64}@"),
]
BASE_KINDS = ("assign", "access", "hex")
#: Exact strings that a part of an expression is expanded to, at most.
MOST_STRINGS = 64

# A query is True (any text), a trigram, or ("and" | "or", frozenset of queries).
Query = bool | bytes | tuple


def _join(how: str, parts: list[Query]) -> Query:
    flat: set[Query] = set()
    for p in parts:
        if p is True:
            if how == "or":
                return True
        elif isinstance(p, tuple) and p[0] == how:
            flat |= p[1]
        else:
            flat.add(p)
    return True if not flat else next(iter(flat)) if len(flat) == 1 else (how, frozenset(flat))


def _strings(found: set[str]) -> Query:
    """What holds of a text that contains one of the strings. Trigrams are of UTF-8 bytes, lower-cased in ASCII."""
    raw = [x.lower().encode() if x.isascii() else x.encode() for x in found]
    return _join("or", [_join("and", [x[i : i + 3] for i in range(len(x) - 2)]) for x in raw])


def _walk(tree, flags: int) -> tuple[set[str] | None, Query]:
    """The strings that the parsed expression matches exactly, or None if they are too many; and what it demands."""
    exact: set[str] | None = {""}
    tail: set[str] = {""}  # exact strings gathered since the last part that had none
    needs: list[Query] = []
    for kind, arg in tree:
        found: set[str] | None = None
        query: Query = True
        if kind is op.LITERAL:
            found = {chr(arg).lower() if flags & re.IGNORECASE else chr(arg)}
        elif kind is op.IN and all(k is op.LITERAL for k, _ in arg) and len(arg) <= 8:
            found = {chr(x) for _, x in arg}
        elif kind is op.BRANCH:
            parts = [_walk(x, flags) for x in arg[1]]
            query = _join("or", [q for _, q in parts])
            if all(x is not None for x, _ in parts):
                found = set().union(*(x for x, _ in parts))
        elif kind is op.SUBPATTERN:
            found, query = _walk(arg[3], flags)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            least, most, inner = arg
            one, asked = _walk(inner, flags)
            if least:
                query = asked
                if one is not None and least == most and len(one) ** least <= MOST_STRINGS:
                    found = reduce(lambda a, b: {x + y for x in a for y in b}, [one] * least)
                elif one is not None and len(tail) * len(one) <= MOST_STRINGS:  # its first copy goes on from what stands before
                    query = _join("and", [query, _strings({x + y for x in tail for y in one})])
            elif most == 1 and one is not None:
                found = one | {""}
        elif kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
            found = {""}
        needs.append(query)
        if found is not None and len(tail) * len(found) <= MOST_STRINGS:
            tail = {x + y for x in tail for y in found}
            exact = None if exact is None else tail
        else:
            needs.append(_strings(tail))
            exact, tail = None, found or {""}
    needs.append(_strings(tail))
    return exact, _join("and", needs)


def trigram_query(pattern: str, flags: int = 0) -> Query:
    """The Boolean trigram query that every text with a match satisfies; True if there is none."""
    return _walk(parser.parse(pattern, flags), flags)[1]


def _asked(query: Query) -> set[bytes]:
    return {query} if isinstance(query, bytes) else set().union(*map(_asked, query[1])) if isinstance(query, tuple) else set()


def _matching(query: Query, postings: dict[bytes, np.ndarray], everything: np.ndarray) -> np.ndarray:
    """The rows that satisfy a query; of a conjunction the shortest lists are intersected first."""
    if query is True:
        return everything
    if isinstance(query, bytes):
        return postings.get(query, everything[:0])
    parts = [_matching(q, postings, everything) for q in query[1]]
    if query[0] == "or":
        return reduce(np.union1d, parts)
    parts.sort(key=len)
    return reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True) if len(a) else a, parts)


class Index:
    """The rules with their trigram queries, and the table that numbers the trigrams that they ask for."""

    def __init__(self, rules: list[Rule]):
        self.rules = [(r, re.compile(r.pattern, r.flags | re.ASCII), trigram_query(r.pattern, r.flags)) for r in rules]
        self.kinds = {k: i for i, k in enumerate(dict.fromkeys(r.kind for r in rules))}
        self.asked = sorted(set().union(*(_asked(q) for _, _, q in self.rules)))
        self.number = np.zeros(1 << 24, np.uint16)
        for i, t in enumerate(self.asked, 1):
            self.number[t[0] << 16 | t[1] << 8 | t[2]] = i

    def postings(self, text: pa.Array) -> dict[bytes, np.ndarray]:
        """The inverted index of a block of texts, for the trigrams asked for: their rows, ascending."""
        lower = pc.cast(pc.ascii_lower(text), pa.large_string())
        _, offsets, data = lower.buffers()
        ends = np.frombuffer(offsets, np.int64)[lower.offset : lower.offset + len(lower) + 1]
        raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        pairs = [np.zeros(0, np.int64)]
        for at in range(int(ends[0]), int(ends[-1]) - 2, 1 << 18):  # pieces that stay in a core's cache
            piece = raw[at : min(at + (1 << 18) + 2, int(ends[-1]))].astype(np.uint32)
            found = self.number[(piece[:-2] << 16) | (piece[1:-1] << 8) | piece[2:]]
            hit = np.flatnonzero(found)
            row = np.searchsorted(ends, hit + at, side="right") - 1
            inside = hit + at + 2 < ends[row + 1]
            pairs.append(np.unique(found[hit[inside]].astype(np.int64) << 32 | row[inside]))
        both = np.unique(np.concatenate(pairs))
        which, row = both >> 32, both & 0xFFFFFFFF
        cuts = np.flatnonzero(np.diff(which, prepend=-1))
        return {self.asked[int(which[a]) - 1]: row[a:b] for a, b in zip(cuts, np.append(cuts[1:], len(row)))}

    def scan(self, text: pa.Array) -> list[list[tuple[int, int, str]]]:
        """For each text its spans (start, end, kind): code points, end exclusive, by start, then kind as listed."""
        postings, everything = self.postings(text), np.arange(len(text))
        out: list[list] = [[] for _ in range(len(text))]
        shown: dict[int, str] = {}
        for rule, pattern, query in self.rules:
            for row in _matching(query, postings, everything).tolist():
                if row not in shown:
                    shown[row] = text[row].as_py()
                for m in pattern.finditer(shown[row]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        out[row].append((m.start(), m.end(), rule.kind))
        return [sorted(set(x), key=lambda s: (s[0], self.kinds[s[2]], s[1])) for x in out]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_SPANS_SQL = "array<struct<kind: string, start: long, end: long>>"


def scan(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """doc_id and spans (kind, start, end) of every whole text, by start, then kind as listed; nothing is shuffled.

    Matches of one rule do not overlap; those of different rules may. A null or empty text has no spans; null and
    repeated doc_ids give a row each; other columns are ignored.
    """
    C.settings(docs.sparkSession)
    rules = rules or RULES

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(rules)
        for batch in C.slices(batches):
            spans = [[{"kind": k, "start": a, "end": b} for a, b, k in x] for x in index.scan(batch.column("text"))]
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(spans, _SPANS)], ["doc_id", "spans"])

    return C.documents(docs, "doc_id", "text").mapInArrow(search, f"doc_id long, spans {_SPANS_SQL}")


def redact(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; overlapping spans by that of the first.

    Only text changes, and n_chars where there is such a column; a null text stays null. Rows are kept.
    """
    C.settings(docs.sparkSession)
    rules, at = rules or RULES, docs.columns.index("text")

    def hide(text: str, spans: list[tuple[int, int, str]]) -> str:
        out, done = [], 0
        for a, b, kind in spans:
            if a >= done:
                out += [text[done:a], f"<{kind}>"]
            done = max(done, b)
        return "".join([*out, text[done:]])

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(rules)
        for batch in batches:
            text = batch.column(at)
            found = index.scan(pc.fill_null(text, ""))
            if any(found):
                new = [hide(t.as_py(), s) if s else t.as_py() for t, s in zip(text, found)]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(new, text.type))
            yield batch

    out = docs.mapInArrow(change, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (all, as kind:start:end joined by commas)."""
    base = f"filter(spans, s -> s.kind IN {BASE_KINDS})"
    joined = "array_join(transform({0}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    count = "cast(size(filter(spans, s -> s.kind = '{0}')) as long)"
    return found.select(
        "doc_id", *[F.expr(count.format(k)).alias(f"n_{k}") for k in BASE_KINDS],
        F.expr(f"sha2({joined.format(base)}, 256)").alias("base_sha256"), F.expr(joined.format("spans")).alias("spans"))
