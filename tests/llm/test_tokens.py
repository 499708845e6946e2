"""Token files, counts and packing against the tokenizer itself."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.conftest import SF, TEXTS
from tidegate.llm import _common as C
from tidegate.llm import packing, queries, token_orc, token_scan

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def ids(text, end=None):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + ([] if end is None else [end])


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_word_encoder_is_the_tokenizer(texts):
    found, offsets = ENCODER.encode(pa.array(texts, pa.string()))
    assert [found[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [ids(t) for t in texts]


ENCODER = C.WordEncoder(PATH)


@pytest.mark.parametrize("text", ["don't we're I'LL", "a,b. c., d.. e ,", "ΑΣ ﬁne ½ x²", "\x1c\x85  a", "<|EndOfText|> <|endoftext|>x", "É é é", "ſ K ǅ"])
def test_word_encoder_cases(text):
    found, _ = ENCODER.encode(pa.array([text]))
    assert found.tolist() == ids(text)


def test_orc(spark, texts):
    start = 0
    found = {r["doc_id"]: r for r in queries.op1_token_orc(spark, SF).collect()}
    for doc, text in texts:
        x = ids(text, 2)
        assert (found[doc]["start"], found[doc]["n_tokens"], found[doc]["ids_crc32"]) == (start, len(x), crc(x))
        start += len(x)
    assert len(found) == len(texts)


def test_orc_odd_and_files(spark, odd, empty):
    path = C.scratch(spark, "orc")
    token_orc.write_token_orc(odd, path, PATH)
    rows = token_orc.read_token_orc(spark, path).orderBy("start").collect()
    assert [r["start"] for r in rows] == np.cumsum([0, *(r["n_tokens"] for r in rows)])[:-1].tolist()
    order = [r["doc_id"] for r in rows]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    assert sorted(tuple(r["ids"]) for r in rows) == sorted(tuple(ids(t, 2)) for _, t in TEXTS)
    assert [r["n_tokens"] for r in token_orc.read_token_orc(spark, path).filter("doc_id = 4").collect()] == [1]
    raw = b"".join(open(f, "rb").read() for f in __import__("glob").glob(path.removeprefix("file://") + "/part-*"))
    assert raw[:3] == b"ORC"
    assert token_orc.token_orc_digest(empty, C.scratch(spark, "orc"), PATH).collect() == []


def test_orc_stripes_indexes_and_pruning(spark):
    """Files have stripes, row indexes and Bloom filters on doc_id; a filter on doc_id leaves most rows unread."""
    path = C.scratch(spark, "orc")
    docs = spark.range(20000).selectExpr("id * 2 AS doc_id", "concat('word ', id) AS text")
    token_orc.write_token_orc(docs, path, PATH)
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files = sorted(__import__("glob").glob(path.removeprefix("file://") + "/part-*.orc"))
    orc = jvm.org.apache.orc.OrcFile
    kinds = set()
    for f in files:
        reader = orc.createReader(jvm.org.apache.hadoop.fs.Path(f), orc.readerOptions(conf))
        assert reader.getRowIndexStride() == 1000 and reader.getStripes().size() >= 1
        rows = reader.rows()
        for i in range(reader.getStripes().size()):
            assert reader.getStripes().get(i).getIndexLength() > 0
            kinds |= {(s.getColumn(), s.getKind().toString()) for s in rows.readStripeFooter(reader.getStripes().get(i)).getStreamsList()}
        doc_id = list(reader.getSchema().getFieldNames()).index("doc_id") + 1
        rows.close()
    assert {(doc_id, "ROW_INDEX"), (doc_id, "BLOOM_FILTER_UTF8")} <= kinds

    def scanned(condition):
        df = spark.read.schema("doc_id long, n_tokens long").orc(path).filter(condition)
        found = len(df.collect())
        leaf = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        return found, leaf.metrics().apply("numOutputRows").value()

    assert scanned("doc_id >= 0") == (20000, 20000)
    found, read = scanned("doc_id = 12344")
    assert found == 1 and read <= 1000
    found, read = scanned("doc_id = 12345")  # within the range of a row group, so only a Bloom filter can tell
    assert found == 0 and read <= 1000
    assert [r["start"] for r in token_orc.read_token_orc(spark, path).filter("doc_id = 0").collect()] == [0]


def test_orc_of_one_repeated_row(spark):
    """Rows that repeat one id and text are dealt into several files, and all come back."""
    docs = spark.range(0, 30000, 1, 6).selectExpr("7L AS doc_id", "'the same words again' AS text")
    path = C.scratch(spark, "orc")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = token_orc.token_orc_digest(docs, path, PATH).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    n = len(ids("the same words again", 2))
    assert sorted(r["start"] for r in rows) == [n * i for i in range(30000)]
    assert {r["n_tokens"] for r in rows} == {n} and spark.read.orc(path).select("part").distinct().count() > 1


def test_separator_scan(spark, texts, odd, empty, monkeypatch):
    monkeypatch.setattr(token_scan, "BLOCK_BYTES", 200)  # many documents run over blocks
    found = {r["doc_id"]: r["n_tokens"] for r in queries.op4_token_counts(spark, SF).collect()}
    assert found == {d: len(ids(t)) for d, t in texts}
    rows = token_scan.token_counts(odd, C.scratch(spark, "flat"), PATH).collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in rows) == sorted((d or -1, len(ids(t))) for d, t in TEXTS)
    assert token_scan.token_counts(empty, C.scratch(spark, "flat"), PATH).collect() == []


def test_separator_scan_of_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_scan, "BLOCK_BYTES", 8)
    end = token_scan.END_ID
    np.array([1, 2, end, end, 5, 6, 7, 8, 9, 10, 11, 12, 13, end, 3], ">u2").tofile(tmp_path / "part-0")
    np.array([end], ">u2").tofile(tmp_path / "part-1")
    np.array([], ">u2").tofile(tmp_path / "part-2")
    rows = token_scan.separator_scan(spark, str(tmp_path)).orderBy("part", "ordinal").collect()
    assert [tuple(r) for r in rows] == [(0, 0, 0, 2, True), (0, 1, 3, 0, True), (0, 2, 4, 9, True), (0, 3, 14, 1, False), (1, 0, 15, 0, True)]


@pytest.mark.parametrize("end", [token_scan.END_ID, 0x0A0A, 0x0AFF, 7])
def test_separator_scan_of_splits(spark, tmp_path, monkeypatch, end):
    """Files that Spark splits anywhere, also within an id, with bytes that look like the end id between two ids."""
    monkeypatch.setattr(token_scan, "BLOCK_BYTES", 64)
    rng = np.random.default_rng(end)
    ids_of = [rng.choice([end, 0x0AFF, 0xFF0A, 0x0A0A, 0x0AF0, 0x00FF, 0x0A00, 0x0700, 7, 1, 300, 40000], n) for n in (1, 999, 5000, 20000)]
    for i, x in enumerate(ids_of):
        x.astype(">u2").tofile(tmp_path / f"part-{i:05}-x.bin")
    (tmp_path / "part-00009-odd.bin").write_bytes(b"\x01\x02\x03")  # an id and half of one
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("777", "4096", "1g"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            rows = sorted(map(tuple, token_scan.separator_scan(spark, str(tmp_path), end).collect()))
            want, shift = [], 0
            for part, x in enumerate(ids_of):
                ends = np.flatnonzero(x == end).tolist()
                for k, (a, b) in enumerate(zip([-1, *ends], [*ends, len(x)])):
                    if b < len(x) or b > a + 1:
                        want.append((part, k, shift + a + 1, b - a - 1, b < len(x)))
                shift += len(x)
            assert rows == [*want, (9, 0, shift, 1, False)]
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def check_packing(rows, docs, capacity, end):
    want = {}
    for d, t in docs:
        x = ids(t, end)
        for i in range(0, len(x), capacity):
            want.setdefault((d, i // capacity, i, len(x[i : i + capacity]), crc(x[i : i + capacity])), []).append(1)
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert sorted(map(str, got)) == sorted(str(k) for k, v in want.items() for _ in v)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        assert np.cumsum([0, *(n for _, n in sorted(s))]).tolist()[:-1] == [o for o, _ in sorted(s)]
        assert sum(n for _, n in s) <= capacity
    return len(sequences)


def test_packing(spark, texts, odd, empty):
    rows = queries.op10_best_fit_packing(spark, SF).collect()
    used = check_packing(rows, texts, 2048, 0)
    assert used <= sum(r["length"] for r in rows) / 2048 * 1.05 + 1
    check_packing(packing.pack(odd, PATH, capacity=64).collect(), TEXTS, 64, 0)
    assert packing.pack(empty, PATH).collect() == []


def test_sequences(spark, odd):
    for r in packing.sequences(odd, PATH, capacity=256).collect():
        assert r["n_tokens"] == len(r["ids"]) <= 256
        assert r["ids"].count(0) >= 0 and len(r["doc_ids"]) == len(r["starts"])
    total = sum(len(ids(t, 0)) for _, t in TEXTS)
    assert packing.sequences(odd, PATH, capacity=256).groupBy().sum("n_tokens").first()[0] == total


def brute_best_fit(lengths, capacity):
    """Descending best fit, one piece at a time."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, b in enumerate(bins) if b >= n]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= n
        else:
            bins.append(capacity - n)
    return len(bins)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_plan(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    segments, bins = packing.plan(counts, 30)
    fill, seen = defaultdict(list), {}
    for i, s in enumerate(segments):
        end = segments[i + 1].rank if i + 1 < len(segments) and segments[i + 1].length == s.length else counts[s.length]
        for r in range(s.rank, end):
            fill[s.bin + (r - s.rank) // s.per_bin].append((s.offset + (r - s.rank) % s.per_bin * s.length, s.length))
        seen[s.length] = end
    assert seen == counts
    for pieces in fill.values():
        assert [o for o, _ in sorted(pieces)] == np.cumsum([0, *(n for _, n in sorted(pieces))]).tolist()[:-1]
        assert sum(n for _, n in pieces) <= 30
    assert bins == len(fill) <= brute_best_fit(lengths, 30) + 1
