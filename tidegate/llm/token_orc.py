"""Token ids as ORC: stripes of run-length encoded integers, row indexes, Bloom filters on document ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegate.llm import _common as C

#: ORC writer options: 16 MB stripes are the unit of parallel reads; a row index entry per 1,000 documents, with
#: minimum, maximum and a Bloom filter of doc_id, lets a reader skip the rest of a stripe.
ORC_OPTIONS = {
    "orc.stripe.size": str(16 << 20),
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.write.format": "0.12",
    "compression": "zstd",
}
_encoders: dict[str, C.WordEncoder] = {}


def encoder(path: str) -> C.WordEncoder:
    """One encoder for each worker process, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = C.WordEncoder(path)
    return _encoders[path]


def write_token_orc(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Write the ids of every whole text, the end id behind each, to ORC files under path, in ascending doc_id order.

    Files and rows in them ascend by doc_id. Columns: part (the file's number, ascending), doc_id, part_start (ids in
    the file before the document), n_tokens, ids. A null text counts as empty and holds the end id alone; null
    doc_ids come first; rows with equal doc_id are all kept, those of different text in order of a hash of it; an
    empty table writes no row; other columns are ignored. Texts are shuffled once, by ranges, before they are
    encoded: they are smaller than their ids. Rows that repeat an id and its text may fall into several ranges.

    Beside the files, path/_totals has a row for each: part, and base, the ids of all files before it; its window sees
    a row for each file.
    """
    C.settings(docs.sparkSession)
    text = C.documents(docs, "doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in C.slices(batches):
            ids, offsets = C.with_end(*encoder(tokenizer).encode(batch.column("text")), end_id)
            n = batch.num_rows
            yield pa.record_batch(
                [
                    pa.array(np.full(n, part, np.int32)),
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(before + offsets[:-1]),
                    pa.array(np.diff(offsets)),
                    pa.ListArray.from_arrays(offsets.astype(np.int32), ids.astype(np.int32)),
                ],
                ["part", "doc_id", "part_start", "n_tokens", "ids"],
            )
            before += int(offsets[-1])

    keys = text.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    ordered = keys.repartitionByRange("doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row")
    made = ordered.select("doc_id", "text").mapInArrow(encode, "part int, doc_id long, part_start long, n_tokens long, ids array<int>")
    made.write.options(**ORC_OPTIONS).orc(path)
    sizes = _files(docs.sparkSession, path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = F.sum("n").over(Window.orderBy("part")) - F.col("n")
    sizes.select("part", base.alias("base")).coalesce(1).write.parquet(f"{path}/_totals")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part int, doc_id long, part_start long, n_tokens long, ids array<int>").orc(path)


def _bases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part int, base long").parquet(f"{path}/_totals")


def read_token_orc(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids. A filter on doc_id prunes stripes and row groups."""
    return _files(spark, path).join(_bases(spark, path), "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def digests(tokens: DataFrame) -> DataFrame:
    """Each row's ids as their crc32 (unsigned 32-bit little-endian ids), recomputed from the ids read."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            flat, offsets = ids.values.to_numpy().astype("<u4"), ids.offsets.to_numpy()
            raw = memoryview(flat).cast("B")
            found = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.record_batch([*(batch.column(c) for c in ("part", "doc_id", "part_start")), pa.array(np.diff(offsets).astype(np.int64)), pa.array(found, pa.int64())], ["part", "doc_id", "part_start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(crc, "part int, doc_id long, part_start long, n_tokens long, ids_crc32 long")


def token_orc_digest(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write docs to path, read the files back: doc_id, start, n_tokens, ids_crc32.

    The ids stay out of the join with the files' starts, so only digests are ever shuffled.
    """
    spark = docs.sparkSession
    write_token_orc(docs, path, tokenizer, end_id)
    return digests(_files(spark, path)).join(_bases(spark, path), "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")
