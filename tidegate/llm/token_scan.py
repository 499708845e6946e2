"""Token counts by separator scan: flat token files without an index, searched block by block for the end-of-document id.

Files are read in Spark's splits, so a file of any size is searched by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegate.llm import _common as C
from tidegate.llm.token_orc import encoder

#: Ids are unsigned 16-bit integers, big-endian. The end-of-document id is outside the vocabulary of 49,408.
#: Its low byte is a line feed, which Spark's text writer puts behind each row: so flat files need no writer of their own.
END_ID = 0xFF0A
#: Bytes of one block of the scan.
BLOCK_BYTES = 1 << 21


def write_flat(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Write the ids of every whole text as flat files under path/kind=ids: nothing but ids, END_ID behind each document.

    Beside them, under path/kind=docs, the same task writes its documents' list, "ordinal,doc_id" by line: a file and
    its list bear the same task number, whatever executor ran last. Files follow the input's partitions, so nothing is
    shuffled. A null text counts as empty; a null doc_id stays an empty field; an empty table writes no files.
    """
    C.settings(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinal = 0
        for batch in C.slices(batches):
            ids, offsets = encoder(tokenizer).encode(batch.column("text"))
            n = batch.num_rows
            # behind each document the end id's high byte; the writer adds the low one
            raw = np.insert(ids.astype(">u2").view(np.uint8), 2 * offsets[1:], END_ID >> 8)
            ends = (2 * offsets + np.arange(n + 1)).astype(np.int32)
            data = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(raw)])
            listed = [f"{i},{'' if x is None else x}".encode() for i, x in enumerate(batch.column("doc_id").to_pylist(), ordinal)]
            place = pa.array(np.arange(ordinal, ordinal + n))
            for kind, value in (("ids", data), ("docs", pa.array(listed, pa.binary()))):
                yield pa.record_batch([pa.array([kind] * n), place, value], ["kind", "ordinal", "raw"])
            ordinal += n

    made = C.documents(docs, "doc_id", "text").mapInArrow(encode, "kind string, ordinal long, raw binary")
    made.sortWithinPartitions("kind", "ordinal").select("kind", F.col("raw").cast("string").alias("value")).write.partitionBy("kind").text(path)


def blocks(spark: SparkSession, path: str, end_id: int = END_ID) -> DataFrame:
    """Search the flat files under path: part, split, block, size, n_bytes, first, last, ends, written.

    part is the number in a file's name, size the file's bytes. Spark splits files by its own rules (at a line feed's
    byte, which says nothing about ids), however large they are, and each split is searched in blocks of about
    BLOCK_BYTES bytes as they stream by: one vectorised comparison each. A split does not know whether it begins at an
    id's first byte, so ends holds the places of the end id's two bytes at odd and even distances (-1: the first one is the
    last byte of the block before); first and last are the block's outer bytes, by which those between splits are found.
    """
    C.settings(spark)
    # only a line feed ends a line: Spark's reader then splits files and keeps all other bytes as they are
    rows = spark.read.option("lineSep", "\n").text(path).select(
        F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int").alias("part"), F.col("_metadata.file_block_start").alias("split"),
        F.col("_metadata.file_size").alias("size"), F.concat(F.col("value").cast("binary"), F.lit(b"\n")).alias("raw"))
    high, low = end_id >> 8, end_id & 255

    def found(key: tuple[int, int, int], block: int, raw: np.ndarray, before: int) -> tuple:
        ends = np.flatnonzero((raw[:-1] == high) & (raw[1:] == low)).astype(np.int32)
        if before == high and raw[0] == low:
            ends = np.insert(ends, 0, -1)
        return (*key[:2], block, key[2], len(raw), int(raw[0]), int(raw[-1]), ends)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, held, n, before = None, 0, [], 0, -1
        out: list[tuple] = []

        def close() -> None:
            nonlocal block, held, n, before
            if n:
                raw = np.concatenate(held)
                out.append(found(key, block, raw, before))
                block, before = block + 1, int(raw[-1])
            held, n = [], 0

        def give() -> pa.RecordBatch:
            columns = list(zip(*out))
            return pa.record_batch([*(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()))), pa.array(columns[7], pa.list_(pa.int32()))], names)

        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in ("part", "split", "size")]
            cuts = np.flatnonzero(np.concatenate([[True], (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])])) if batch.num_rows else []
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
                here = tuple(int(k[a]) for k in keys)
                if here != key:
                    close()
                    key, block, before = here, 0, -1
                raw = batch.column("raw").slice(a, b - a)
                ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
                held.append(np.frombuffer(raw.buffers()[2], np.uint8)[ends[0] : ends[-1]].copy())
                n += len(held[-1])
                if n >= BLOCK_BYTES:
                    close()
            if out:
                yield give()
                out.clear()
        close()
        if out:
            yield give()

    names = ["part", "split", "block", "size", "n_bytes", "first", "last", "ends"]
    schema = "part int, split long, block int, size long, n_bytes long, first int, last int, ends array<int>"
    return C.written(rows.mapInArrow(search, schema), "blocks")


def separator_scan(spark: SparkSession, path: str, end_id: int = END_ID) -> DataFrame:
    """Token counts of the documents in flat token files: part, ordinal, start, n_tokens, terminated.

    start counts ids from the first file's beginning, end ids included; n_tokens leaves the end id out. Blocks are
    stitched by prefix scans over a file's blocks: their bytes sum up to each block's place, which tells which ends stand
    at an id's first byte; the running maximum of these is the last end id in any earlier block, and their running
    count the ordinal. Ids behind a file's last end id form a document that is not terminated. No files, or empty ones,
    give no row. Windows over whole tables see a row for each file.
    """
    high, low = end_id >> 8, end_id & 255
    found = blocks(spark, path, end_id)
    order = Window.partitionBy("part").orderBy("split", "block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = found.withColumn("base", F.coalesce(F.sum("n_bytes").over(earlier), F.lit(0))).withColumn("before", F.lag("last").over(order))
    # where a split begins, the end id's first byte may be the last one of the split before
    ends = F.when((F.col("block") == 0) & (F.col("before") == high) & (F.col("first") == low), F.concat(F.array(F.lit(-1)), "ends")).otherwise(F.col("ends"))
    places = F.transform(F.filter(ends, lambda x: ((F.col("base") + x) % 2 == 0) & (F.col("base") + x + 1 < F.col("size"))), lambda x: F.shiftright(F.col("base") + x, 1))
    placed = C.written(placed.select("part", "split", "block", "size", "n_bytes", places.alias("ends")), "places")
    C.forget(found)
    last = F.when(F.size("ends") > 0, F.element_at("ends", F.greatest(F.size("ends"), F.lit(1))))
    summary = placed.select("part", "split", "block", "size", "n_bytes", F.size("ends").cast("long").alias("n_ends"), last.alias("last"))
    carried = summary.select(
        "part", "split", "block",
        F.coalesce(F.max("last").over(earlier), F.lit(-1)).alias("carry"),
        F.coalesce(F.sum("n_ends").over(earlier), F.lit(0)).alias("ordinal"))
    parts = summary.groupBy("part").agg(F.max("size").alias("size"), F.sum("n_bytes").alias("n_bytes"), F.sum("n_ends").alias("n_ends"), F.coalesce(F.max("last"), F.lit(-1)).alias("last"))
    # a line feed is added behind a last line without one; a reader that leaves bytes out must not go unseen
    whole = F.when((F.col("n_bytes") - F.col("size")).isin(0, 1), F.shiftright("size", 1)).otherwise(F.raise_error(F.lit("bytes of a flat file were not read")).cast("long"))
    parts = parts.withColumn("n", whole)
    shift = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("shift"))
    each = placed.filter(F.size("ends") > 0).join(carried, ["part", "split", "block"]).select("part", "carry", "ordinal", "ends", F.posexplode("ends").alias("i", "end"))
    before = F.when(F.col("i") == 0, F.col("carry")).otherwise(F.expr("get(ends, i - 1)"))
    ended = each.select("part", (F.col("ordinal") + F.col("i")).alias("ordinal"), (before + 1).alias("start"), (F.col("end") - before - 1).alias("n_tokens"), F.lit(True).alias("terminated"))
    open_ = parts.filter(F.col("n") > F.col("last") + 1).select("part", F.col("n_ends").alias("ordinal"), (F.col("last") + 1).alias("start"), (F.col("n") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("terminated"))
    return ended.unionByName(open_).join(shift, "part").select("part", "ordinal", (F.col("start") + F.col("shift")).alias("start"), "n_tokens", "terminated")


def token_counts(docs: DataFrame, path: str, tokenizer: str) -> DataFrame:
    """Write docs as flat token files, scan them, name the documents again: doc_id, part, ordinal, start, n_tokens."""
    spark = docs.sparkSession
    write_flat(docs, path, tokenizer)
    if not docs.take(1):
        return spark.createDataFrame([], "doc_id long, part int, ordinal long, start long, n_tokens long")
    counts = separator_scan(spark, f"{path}/kind=ids")
    field = F.split("value", ",")
    listed = spark.read.text(f"{path}/kind=docs").select(
        F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int").alias("part"),
        field[0].cast("long").alias("ordinal"), F.expr("try_cast(split(value, ',')[1] as long)").alias("doc_id"))
    return listed.join(counts, ["part", "ordinal"]).select("doc_id", "part", "ordinal", "start", "n_tokens")
