"""Best-fit packing of documents into sequences of a fixed capacity, by large-item matching.

The plan is made from the histogram of piece lengths, of which there are at most as many as the capacity, so its
size does not depend on the number of documents. Pieces find their place in it by their rank among equal lengths.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm import _common as C
from tidegate.llm.token_orc import encoder


class Segment(NamedTuple):
    """Pieces of one length, with ranks from rank on: per_bin of them to a bin, from bin on, the first at offset."""

    length: int
    rank: int
    per_bin: int
    bin: int
    offset: int


def plan(counts: dict[int, int], capacity: int) -> tuple[list[Segment], int]:
    """Segments in order of length and rank, and the number of bins.

    Pieces above a third of the capacity fit at most two to a bin: the longest left is matched with the longest that
    fits beside it, which is optimal for these. Shorter ones follow in descending order, each length into the bins
    with the smallest gap that holds it, as many to a bin as fit; a new bin opens only if no gap holds it.
    """
    segments: list[Segment] = []
    taken = dict.fromkeys(counts, 0)
    left = {k: v for k, v in counts.items() if v}
    bins = 0
    gaps: list[tuple[int, int, int]] = []  # (gap, first bin, number of bins), ascending

    def place(length: int, n: int, per_bin: int, first: int, offset: int) -> None:
        segments.append(Segment(length, taken[length], per_bin, first, offset))
        taken[length] += n
        left[length] -= n

    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        a = large[-1]
        at = bisect_left(large, capacity - a + 1) - 1
        b = large[at] if at >= 0 else None
        if b is None:
            n = left[a]
        elif b == a:
            n = left[a] // 2
        else:
            n = min(left[a], left[b])
        if b == a and n == 0:  # a last one without a partner of its own length: the next shorter one
            b = large[at - 1] if at > 0 else None
            n = 1
        if b == a:
            place(a, 2 * n, 2, bins, 0)
        else:
            place(a, n, 1, bins, 0)
            if b is not None:
                place(b, n, 1, bins, a)
        gap = capacity - a - (b or 0)
        if gap:
            insort(gaps, (gap, bins, n))
        bins += n
        large = [k for k in large if left[k]]
    for s in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[s]:
            at = bisect_left(gaps, (s, -1, -1))
            if at == len(gaps):
                k = capacity // s
                n = max(1, left[s] // k)
                gap, first = capacity, bins
                bins += n
            else:
                gap, first, n = gaps.pop(at)
            k = min(gap // s, left[s])
            used = min(n, left[s] // k)
            place(s, used * k, k, first, capacity - gap)
            if gap - k * s:
                insort(gaps, (gap - k * s, first, used))
            if used < n:
                insort(gaps, (gap, first + used, n - used))
    return sorted(segments), bins


def pieces(docs: DataFrame, capacity: int, tokenizer: str, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """The pieces of every whole text and the end id behind it: doc_id, piece, start, length, ids_crc32, part, part_rank.

    part_rank counts the pieces of the same length in the same input partition (part).
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in C.slices(batches):
            ids, offsets = C.with_end(*encoder(tokenizer).encode(batch.column("text")), end_id)
            lens = np.diff(offsets)
            per_doc = -(-lens // capacity)
            row = np.repeat(np.arange(batch.num_rows), per_doc)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
            start = piece * capacity
            length = np.minimum(lens[row] - start, capacity)
            begin = offsets[row] + start
            raw = memoryview(ids.astype("<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist())]
            by = np.argsort(length, kind="stable")
            ordered = length[by]
            rank = np.empty(len(row), np.int64)
            rank[by] = np.arange(len(row)) - np.searchsorted(ordered, ordered) + seen[ordered]
            np.add.at(seen, length, 1)
            out = [batch.column("doc_id").cast(pa.int64()).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(row), part, np.int32)), pa.array(rank)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "part_rank"]
            if keep_ids:  # pieces follow one another in ids without gaps
                out.append(pa.ListArray.from_arrays(np.append(begin, offsets[-1]).astype(np.int32), ids.astype(np.int32)))
                names.append("ids")
            yield pa.record_batch(out, names)

    C.settings(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, part_rank long" + ", ids array<int>" * keep_ids
    return C.documents(docs, "doc_id", "text").mapInArrow(cut, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Pack all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with keep_ids the ids.

    A document is its ids and the end id; only those longer than the capacity are cut. A null text counts as empty
    (the end id alone); null and repeated doc_ids are packed like any other row; an empty table gives no row; other
    columns are ignored. Pieces of equal length are interchangeable, so ties are settled by their place in the input.
    The pieces' lengths are written once; only they, never texts or ids, are shuffled (ids too with keep_ids).
    """
    spark = docs.sparkSession
    rows = C.written(pieces(docs, capacity, tokenizer, end_id, keep_ids), "pieces")
    by_part = rows.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = by_part.groupBy("length").agg(F.sum("n").alias("n"))  # at most `capacity` rows
    segments, _ = plan({int(r[0]): int(r[1]) for r in counts.collect()}, capacity)
    before = Window.partitionBy("length").orderBy("part")
    base = by_part.select("part", "length", (F.sum("n").over(before) - F.col("n")).alias("base"))
    table = spark.sparkContext.broadcast(np.array(segments or [(0, 0, 1, 0, 0)], np.int64))

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = table.value
        key = (seg[:, 0] << 48) + seg[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            s = seg[np.searchsorted(key, (length << 48) + rank, side="right") - 1] if len(rank) else seg[:0]
            nth = rank - s[:, 1]
            at = batch.schema.get_field_index("rank")
            out = batch.remove_column(at)
            yield pa.record_batch([*out.columns, pa.array(s[:, 3] + nth // s[:, 2]), pa.array(s[:, 4] + nth % s[:, 2] * length)], [*out.schema.names, "sequence_id", "offset"])

    kept = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    ranked = rows.join(base, ["part", "length"]).select(*kept, (F.col("base") + F.col("part_rank")).alias("rank"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids array<int>, " * keep_ids + "sequence_id long, offset long"
    return ranked.mapInArrow(seat, schema)


def sequences(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """The packed sequences: sequence_id, n_tokens, ids, and doc_ids and starts of the pieces in their order."""
    packed = pack(docs, tokenizer, capacity, end_id, keep_ids=True)
    inside = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))  # a sequence holds `capacity` ids at most
    return packed.groupBy("sequence_id").agg(inside.alias("p")).select(
        "sequence_id", F.flatten("p.ids").alias("ids"), F.size(F.flatten("p.ids")).cast("long").alias("n_tokens"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("starts"))
