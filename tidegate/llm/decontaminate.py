"""Benchmark decontamination by pigeonhole edit matching.

Both sides are compared in lower case, with every run of other characters than letters and digits as one space. A
test item of m characters has a budget of k edits and is found where a run of whole words is within that budget: "art"
is not found in "party". It is split into k + 1 pieces: whoever differs from it by at most k edits holds a piece
unchanged. Pieces are found by one automaton; each hit's surroundings are verified by Myers' bit-parallel distance,
forwards for the words where a match can end, and from there backwards for the word where it begins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm import _common as C

#: Edits allowed per character of a test item.
ERROR_RATE = 1 / 12
#: Characters of test items that one pass over the documents looks for; more items make more passes.
BLOCK_CHARS = 2_000_000
_OTHER = re.compile(r"[\W_]+")


def normalize(text: str) -> str:
    return _OTHER.sub(" ", text.lower()).strip()


def _scan(peq: dict[str, int], m: int, text: str, anchored: bool, most: int) -> Iterator[tuple[int, int]]:
    """Myers' scan: (place, edits) behind each character of text where at most `most` edits lead from the pattern to a part
    of text that ends there. anchored: the part begins where text begins, else anywhere.

    peq: for each character the bits of its places in the pattern, of length m.
    """
    mask, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, left, first = mask, 0, m, len(text), int(anchored)
    get = peq.get
    for i, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (mask & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        if score <= most:
            yield i, score
        if score - (left - i) > most:
            return  # the rest of text cannot bring the edits down again
        ph = ph << 1 | first
        mh <<= 1
        pv = (mh | ~(xv | ph)) & mask
        mv = ph & xv & mask


def _bits(text: str) -> dict[str, int]:
    peq: dict[str, int] = {}
    for i, c in enumerate(text):
        peq[c] = peq.get(c, 0) | 1 << i
    return peq


def nearest(item: Item, text: str, a: int, b: int) -> tuple[int, int, int] | None:
    """The best match of the item in text[a:b]: edits, start, end; None beyond its budget.

    A match begins where a word begins and ends where one ends; of equal edits the earliest, then the shortest, counts.
    """
    m, k, best = len(item.text), item.budget, None
    for to, _ in _scan(item.peq, m, text[a:b], False, k):
        end = a + to
        if end < len(text) and text[end] != " " or text[end - 1] == " ":
            continue
        low = max(a, end - m - k)
        for back, edits in _scan(item.back, m, text[low:end][::-1], True, k):
            start = end - back
            if (start == 0 or text[start - 1] == " ") and text[start] != " " and (best is None or (edits, start, end) < best):
                best = edits, start, end
    return best


class Item(NamedTuple):
    item_id: int
    text: str
    budget: int
    peq: dict[str, int]
    back: dict[str, int]
    grams: list[str]


class Matcher:
    """An automaton of all items' pieces."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items: list[Item] = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            m = len(text)
            k = int(m * rate)
            for j in range(k + 1):
                a, b = m * j // (k + 1), m * (j + 1) // (k + 1)
                pieces.setdefault(text[a:b], []).append((len(self.items), a))
            self.items.append(Item(item_id, text, k, _bits(text), _bits(text[::-1]), [text[i : i + 3] for i in range(m - 2)]))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """For each item found in the normalized text: item_id, edits, start, end of its best match."""
        best: dict[int, tuple[int, int, int]] = {}
        tried: set[tuple[int, int]] = set()
        if not self.items:
            return []
        for last, (n, places) in self.automaton.iter(text):
            for which, offset in places:
                start = last + 1 - n - offset
                if (which, start) in tried or best.get(which, (1,))[0] == 0:
                    continue
                tried.add((which, start))
                item = self.items[which]
                m, k = len(item.text), item.budget
                end = start + m
                if start >= 0 and text.startswith(item.text, start) and (start == 0 or text[start - 1] == " ") and (end == len(text) or text[end] == " "):
                    best[which] = (0, start, end)
                    continue
                if k == 0:
                    continue
                a, b = max(0, start - k), min(len(text), end + k)
                # k edits leave all but 3k of the item's trigrams
                around = text[a:b]
                have = {around[i : i + 3] for i in range(len(around) - 2)}
                if sum(map(have.__contains__, item.grams)) < len(item.grams) - 3 * k:
                    continue
                found = nearest(item, text, a, b)
                if found and found < best.get(which, (k + 1,)):
                    best[which] = found
        return [(self.items[w].item_id, *found) for w, found in sorted(best.items())]


def item_blocks(items: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The normalized test items, in blocks whose size is bounded; empty ones match nothing and are left out."""
    block, size = [], 0
    rows = items.select(F.col("item_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    for item_id, text in rows.toLocalIterator():
        text = normalize(text)
        if text:
            block.append((item_id, text))
            size += len(text)
            if size >= block_chars:
                yield block
                block, size = [], 0
    if block:
        yield block


def matches(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, edits, start, end (in the normalized text) of the best match of each item in each whole text.

    The best has the fewest edits, then the earliest start. Documents without a match give no row; null and empty texts and items match nothing; equal items, and equal
    documents, each give their rows. Null doc_ids are kept, other columns are ignored. Items are broadcast in blocks of
    bounded size, one pass over the documents each; documents are not shuffled.
    """
    spark = docs.sparkSession
    C.settings(spark)
    text = C.documents(docs, "doc_id", "text")
    schema = "doc_id long, item_id long, edits int, start long, end long"
    out = None
    for block in item_blocks(items, block_chars):
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate)
            for batch in batches:
                rows = [(d, *x) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text")) for x in matcher.search(normalize(t.as_py()))]
                columns = list(zip(*rows)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "edits", "start", "end"])

        found = text.mapInArrow(search, schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents, with all their columns, in which no test item is found; a pass over them for each block of items.

    Null and empty texts hold nothing and stay, null and empty items are in nothing, without items all documents stay.
    Rows are decided one by one, so repeated ones go or stay alike. An item of one word is found wherever that word stands.
    """
    spark, at = docs.sparkSession, docs.columns.index("text")
    C.settings(spark)
    for block in item_blocks(items, block_chars):
        shared = spark.sparkContext.broadcast(block)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.search(normalize(t.as_py() or "")) for t in batch.column(at)], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
