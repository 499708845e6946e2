"""What the training-data operators share: scratch tables, text batches, tokenization."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import uuid
from collections.abc import Iterator
from contextlib import nullcontext, suppress
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that one vectorised step works on; bounds a worker's memory.
SLICE_CHARS = 4_000_000
#: Words that a worker keeps encoded. A full cache is emptied, so memory is bounded.
CACHE_WORDS = 800_000
#: A key is hot if it has more than this part of a join's rows: so there are fewer hot keys than this.
HOT_KEYS = 10_000


def settings(spark: SparkSession) -> None:
    """Arrow batches are bounded by their bytes: small ones, since the JVM keeps the buffers that it has used."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may leave it unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        checkpoint = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = checkpoint.get() if checkpoint.isDefined() else None
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"/tmp/tidegate-{os.getpid()}"
    return found.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder; what is still there when the driver ends is deleted then."""
    root = f"{shared_dir(spark)}/tidegate/{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(_delete, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), root, quiet=True)
    return f"{root}/{what}-{uuid.uuid4().hex[:12]}"


_roots: set[str] = set()


def _delete(jvm, conf, path: str, quiet: bool = False) -> None:
    with suppress(Exception) if quiet else nullcontext():
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a written table of the shared folder: its lineage ends there, and lost executors cost nothing."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again, by Spark's own file systems."""
    for df in tables:
        context = df.sparkSession.sparkContext
        _delete(context._jvm, context._jsc.hadoopConfiguration(), df.scratch_path)


def spread_join(left: DataFrame, right: DataFrame, key: str, n: str, total: int, by: Column) -> DataFrame:
    """left JOIN right USING (key), for keys that may be hot in left; no task gets the rows of a hot one whole.

    right has one row for each key, and in n how many of left's rows have it; left has `total` rows in all. The hot
    keys, fewer than HOT_KEYS, are broadcast with the number of parts that their rows are dealt into by `by`, which
    must be the same whenever a row is read again; right's row goes to every part.
    """
    bound = max(100, total // HOT_KEYS)
    parts = F.ceil(F.col(n) / bound)
    hot = right.filter(F.col(n) > bound).select(key, parts.cast("long").alias("_parts"))
    dealt = left.join(F.broadcast(hot), key, "left").withColumn("_part", F.coalesce(F.pmod(by, "_parts"), F.lit(0))).drop("_parts")
    every = right.withColumn("_part", F.explode(F.sequence(F.lit(0), F.when(F.col(n) > bound, parts - 1).otherwise(0).cast("long"))))
    return dealt.join(every, [key, "_part"]).drop("_part")


def documents(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns only, text as a string that is never null: other columns, however named, stay out."""
    return docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) if c == "text" else docs[c] for c in columns])


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about SLICE_CHARS bytes of text; a longer text stands alone."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            done = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, done + SLICE_CHARS - total, side="right")))
            held.append(batch.slice(at, to - at))
            total += int(sizes[to - 1] - done)
            if total >= SLICE_CHARS or to < batch.num_rows:
                yield _whole(held)
                held, total = [], 0
            at = to
    if held:
        yield _whole(held)
    give_back()


def _whole(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(held) == 1:
        return held[0]
    table = pa.Table.from_batches(held).combine_chunks()
    return pa.RecordBatch.from_arrays([c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in table.columns], schema=table.schema)


def give_back() -> None:
    """Return freed memory to the system: a worker lives on after its task, beside others of its executor."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between ASCII white space: per text the offsets into codes, the codes, and the distinct words of codes."""
    split = pc.ascii_split_whitespace(pc.cast(text, pa.large_string()))
    coded = pc.dictionary_encode(split.flatten())
    offsets = split.offsets.to_numpy().astype(np.int64)
    codes = coded.indices.to_numpy()
    distinct = coded.dictionary
    # the splitter gives empty words where a text begins or ends in white space
    empty = pc.index(distinct, pa.scalar("", pa.large_string())).as_py()
    if empty >= 0:
        keep = codes != empty
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets - offsets[0]]
        codes = codes[keep]
        return offsets, codes - (codes > empty), pa.concat_arrays([distinct.slice(0, empty), distinct.slice(empty + 1)])
    return offsets - offsets[0], codes, distinct


#: Byte-level BPE writes printable bytes as themselves and the other ones as characters from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: chr(b if b in _PRINTABLE else 256 + sum(x not in _PRINTABLE for x in range(b))) for b in range(256)}


class WordEncoder:
    """Token ids of whole texts by the tokenizers library, each distinct word encoded once.

    Exact for tokenizers whose pre-tokenizer drops white space, matches nothing across it and takes letters and other
    characters apart, as that of word_bpe_49k.json: then the ids of a text are the ids of its words, one after
    another. Words of Latin letters, of which the normalizer makes nothing but lower case, go straight to the model;
    those with a comma or a full stop behind them are their ids and that of the mark; others take the whole way.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.marks = {x: self.tokenizer.encode(x, add_special_tokens=False).ids for x in ",."}
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 20, np.int32)
        self.starts = np.zeros(CACHE_WORDS, np.int32)
        self.lens = np.zeros(CACHE_WORDS, np.int32)
        self.used = 0

    def fresh(self, new: list[str]) -> tuple[list[str], list[int], list[int]]:
        """The new words in some order, their ids one after another, and how many each has."""
        words, flat, lens, rest = [], [], [], []
        known, starts, lengths, store, tokenize, marks = self.known, self.starts, self.lens, self.flat, self.model.tokenize, self.marks
        for word in new:
            mark = marks.get(word[-1:])
            base = word[:-1] if mark else word
            if mark and base in known and base.isalpha():
                at = known[base]
                ids = store[starts[at] : starts[at] + lengths[at]].tolist()
            elif not base.isalpha():
                rest.append(word)
                continue
            elif base.isascii() and base.islower():
                ids = [x.id for x in tokenize(base)]
            elif max(base) < "\u0250" and "\u0130" not in base and is_normalized("NFC", base):  # of these, one letter's lower case is two
                ids = [x.id for x in tokenize("".join(map(_BYTES.__getitem__, base.lower().encode())))]
            else:
                rest.append(word)
                continue
            if mark:
                ids += mark
            words.append(word)
            flat += ids
            lens.append(len(ids))
        if rest:
            for word, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
                ids = e.ids
                words.append(word)
                flat += ids
                lens.append(len(ids))
        return words, flat, lens

    def places(self, distinct: list[str]) -> np.ndarray:
        """Where the words' ids are; encodes the new ones."""
        if len(self.known) + len(distinct) > len(self.starts):
            self.clear()
            if len(distinct) > len(self.starts):
                self.starts, self.lens = np.zeros(len(distinct), np.int32), np.zeros(len(distinct), np.int32)
        known = self.known
        new = [w for w in distinct if w not in known]
        if new:
            words, flat, lens = self.fresh(new)
            total, n = len(flat), len(known)
            if self.used + total > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(max(total, len(self.flat)), np.int32)])
            self.flat[self.used : self.used + total] = flat
            lens = np.array(lens, np.int32)
            self.starts[n : n + len(new)] = self.used + np.cumsum(lens, dtype=np.int32) - lens
            self.lens[n : n + len(new)] = lens
            self.used += total
            known.update(zip(words, range(n, n + len(new))))
        return np.fromiter(map(known.__getitem__, distinct), np.int32, len(distinct))

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and each text's offsets in it."""
        if not pc.any(pc.match_substring(text, "<|")).as_py():
            text = pc.ascii_lower(text)  # the normalizer does so too; fewer distinct words. Special tokens' strings keep their case
        offsets, codes, distinct = words(text)
        place = self.places(distinct.to_pylist())[codes] if len(codes) else np.zeros(0, np.int32)
        lens = self.lens[place]
        ends = np.zeros(len(lens) + 1, np.int32)
        np.cumsum(lens, out=ends[1:])
        at = np.repeat(self.starts[place] - ends[:-1], lens)
        at += np.arange(len(at), dtype=np.int32)
        return self.flat[at], ends[offsets].astype(np.int64)


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's ids with the end id behind them."""
    n = len(offsets) - 1
    return np.insert(ids, offsets[1:], end), offsets + np.arange(n + 1)
