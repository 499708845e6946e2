"""License, quality, secret and decontamination scans against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import SF, TEXTS
from tidegate.llm import decontaminate, license_scan, quality_ledger, queries, secret_scan

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# licenses


def brute_license(text):
    words, starts, labels = LICENSE_WORD.findall((text or "").translate(UPPER)), [], set()
    for phrase, label in license_scan.BASE.items():
        p = phrase.split()
        hits = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += hits
        labels |= {label} if hits else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def license_base(r):
    return tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels"))


def test_license(spark, texts):
    found = by_id(queries.op2_license_scan(spark, SF))
    assert len(found) == len(texts)
    for d, t in texts:
        assert license_base(found[d]) == brute_license(t)
        assert set(found[d]["base_labels"].split(",")) <= set(found[d]["labels"].split(",")) | {""}
        assert 0 <= found[d]["score"] <= 1
        assert (detections(found[d]), found[d]["labels"], found[d]["score"]) == brute_detections(t)


def detections(r):
    return sorted((d["priority"], d["first_word"], d["end_word"], d["label"], d["confidence"]) for d in r["detections"])


def brute_detections(text):
    """All rules, all pairs of detections: what is kept, its labels, its best confidence."""
    found = every_detection(text or "")
    p, s, e = (np.array([x[k] for x in found], int) for k in range(3))
    kept = [x for x in found if x[0] == 0 or not (((s <= x[1]) & (e >= x[2])) & ((p < x[0]) | ((p == x[0]) & ((s < x[1]) | (e > x[2]))))).any()]
    return kept, ",".join(sorted({x[3] for x in kept})), max((x[4] for x in kept), default=0)


LICENSES = {
    "Licensed under the Apache License, Version 2.0.": "apache-2", "This work is licensed under the GNU General Public License, version 3.": "gpl-3",
    "GNU Lesser General Public License v2.1": "lgpl", "SPDX-License-Identifier: BSD-3-Clause": "bsd-3", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "licensed under CC BY-SA 4.0": "cc-by-sa",
    "under the MIT License under the MIT License": "mit", "Permission is hereby granted, free of charge, to any person obtaining a copy": "mit", "the Apache License version 20": "apache", "the Apache licenses are many": "", "commit licensees": "",
    "cc\nBY, nc": "cc-by-nc", "Éunder the MIT license": "mit", "All rights reserved.": "proprietary", "GNU Affero General Public License version 3": "agpl-3", "MIT LICENCE": "mit",
}


def test_license_labels(spark):
    df = spark.createDataFrame(list(enumerate(LICENSES)), "doc_id long, text string")
    found = by_id(license_scan.scan(df))
    for i, (text, want) in enumerate(LICENSES.items()):
        assert found[i]["labels"] == want, text
        assert license_base(found[i]) == brute_license(text)


def test_license_suppression(spark):
    """Of nested detections the better ones stay: checked against all pairs."""
    df = spark.createDataFrame([(1, "licensed under the MIT license. Apache License, Version 2.0 (apache license)")], "doc_id long, text string")
    (r,) = license_scan.scan(df).collect()
    spans = [(d["priority"], d["first_word"], d["end_word"]) for d in r["detections"]]
    for p, a, b in spans:
        assert p == 0 or not any(c <= a and b <= d and (q < p or q == p and (c, d) != (a, b)) for q, c, d in spans)
    assert len(license_scan.NAMES) + len(license_scan.NOTICES) + len(license_scan.SPDX) > 250


def every_detection(text):
    """(priority, first word, end word, label, confidence) of every rule's matches, by Python's expressions."""
    norm = " ".join(LICENSE_WORD.findall(text.translate(UPPER))) + " "
    found = set()
    for r in license_scan.rules():
        for m in re.finditer(r.pattern, norm) if r.keyword in norm else ():
            found.add((r.priority, norm.count(" ", 0, m.start()), norm.count(" ", 0, m.end()), r.label, r.confidence))
    return sorted(found)


def test_license_suppression_in_long_texts(spark):
    """Among 20,000 detections too only better or longer ones suppress, and only what they contain: against all pairs."""
    lines = ["the zlib license.", "licensed under the MIT license,", "All rights reserved!", "the ISC license", "Apache License, Version 2.0", "GNU General Public License", "released under the terms of the Mozilla Public License 2.0"]
    text = "\n".join(f"file {i}: {lines[i % len(lines)]}" for i in range(13000)) + "\nthe PHP license, last of all"
    (r,) = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert len(every_detection(text)) > 20000
    assert (detections(r), r["labels"], r["score"]) == brute_detections(text)
    assert "php" in r["labels"]


@settings(max_examples=600, deadline=None)
@given(st.sampled_from(license_scan.rules()).flatmap(lambda r: st.tuples(st.just(r), st.from_regex(r.pattern.removeprefix("(?<![^ ])"), fullmatch=True, alphabet="abcdefghijklmnopqrstuvwxyzé0123456789 "))))
def test_license_gate_lets_every_match_through(case):
    rule, text = case
    assert rule.keyword in text and rule.also in text
    assert regex.search(license_scan.GATE, text.upper()) or regex.search(license_scan.GATE, text)


def test_license_keywords_are_in_every_match():
    """A rule's keyword must stand in whatever its expression matches, or the gate would lose detections."""
    for r in license_scan.rules():
        query = secret_scan.trigram_query(r.pattern)
        grams = {r.keyword[i : i + 3].encode() for i in range(len(r.keyword) - 2)}
        assert all(demands(query, g) for g in grams) if grams else r.keyword in r.pattern, r


def demands(query, gram):
    if isinstance(query, tuple):
        return (any if query[0] == "and" else all)(demands(q, gram) for q in query[1])
    return query == gram


def test_license_odd(odd, empty):
    rows = license_scan.scan(odd).collect()
    assert sorted(map(str, map(license_base, rows))) == sorted(str(brute_license(t)) for _, t in TEXTS)
    assert license_scan.scan(empty).collect() == []


# quality


def brute_quality(text):
    text = text or ""
    w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    n, windows = len(w), Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(n - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def quality_base(r):
    return tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))


def test_quality(spark, texts, table):
    found = by_id(queries.op3_quality_ledger(spark, SF))
    for d, t in texts:
        n, *_, repeats = brute_quality(t)
        assert quality_base(found[d]) == brute_quality(t)
        assert found[d]["base_failed"] == (n < 50 or 100 * repeats > 50 * n)
        assert not (found[d]["kept"] and found[d]["base_failed"])
    good = [r for r in table("labels").collect() if r["quality"] == 1 and found[r["doc_id"]]["n_words"] >= 50]
    assert sum(found[r["doc_id"]]["kept"] for r in good) >= 0.97 * len(good)


def test_quality_odd(odd, empty):
    rows = quality_ledger.measure(odd).collect()
    assert sorted(map(quality_base, rows)) == sorted(brute_quality(t) for _, t in TEXTS)
    assert quality_ledger.ledger(empty).collect() == []


def test_policies_and_ablations(table):
    found = quality_ledger.ledger(table("documents")).cache()
    bits = [r["failed_bits"] for r in found.collect()]
    for version, mask in quality_ledger.POLICIES.items():
        assert quality_ledger.apply_policy(found, version).filter("kept").count() == sum(not b & mask for b in bits)
        got = {r["rule"]: (r["n_failed"], r["n_alone"]) for r in quality_ledger.ablations(found, version).collect()}
        assert got == {n: (sum(bool(b & x) for b in bits), sum(b & mask == x for b in bits)) for n, x in quality_ledger.BIT.items() if x & mask}
    found.unpersist()


# secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def brute_secrets(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))


def base_spans(spans):
    return ",".join(s for s in spans.split(",") if s.split(":")[0] in secret_scan.BASE_KINDS)


def test_secrets(spark, texts, odd, empty):
    found = by_id(queries.op8_secret_scan(spark, SF))
    for d, t in texts:
        assert base_spans(found[d]["spans"]) == brute_secrets(t)
        assert found[d]["base_sha256"] == hashlib.sha256(brute_secrets(t).encode()).hexdigest()
        assert found[d]["n_hex"] == brute_secrets(t).count("hex")
    rows = secret_scan.digest(secret_scan.scan(odd)).collect()
    assert sorted(base_spans(r["spans"]) for r in rows) == sorted(brute_secrets(t) for _, t in TEXTS)
    assert secret_scan.scan(empty).collect() == []


PARTS = ["password", "PASSWD", "token", "toKen", "api_key", "apikey", "=", ":", " ", '"', "'", "abc", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "g", "é", "\n", "-", "ghp_" + "a" * 36, "https://a:bcd@e"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), min_size=1, max_size=4))
def test_index_finds_what_scanning_finds(texts):
    """The index drops no text that any rule matches."""
    for text, spans in zip(texts, INDEX.scan(pa.array(texts))):
        want = set()
        for rule, pattern, _ in INDEX.rules:
            want |= {(m.start(), m.end(), rule.kind) for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least}
        assert set(spans) == want
        assert base_spans(",".join(f"{k}:{a}:{b}" for a, b, k in spans)) == brute_secrets(text)


INDEX = secret_scan.Index(secret_scan.RULES)


@pytest.mark.parametrize("pattern, query", [("abcd", ("and", frozenset({b"abc", b"bcd"}))), ("ab", True), ("abc|xyz", ("or", frozenset({b"abc", b"xyz"}))), ("a[bc]d", ("or", frozenset({b"abd", b"acd"}))), ("x*abc", b"abc"), ("abc?", True), (r"\d+", True), ("(?:abc)+", b"abc")])
def test_trigram_query(pattern, query):
    assert secret_scan.trigram_query(pattern) == query


def test_redact(odd):
    rows = {r["doc_id"]: r for r in secret_scan.redact(odd).collect()}
    assert rows[10]["text"] == "<assign> <access> <hex>" and rows[10]["n_chars"] == len(rows[10]["text"])
    assert rows[3]["text"] is None and rows[2]["text"] == TEXTS[1][1]


# decontamination


def brute_nearest(item, text):
    """(edits, start, end) of the nearest run of whole words, the earliest and shortest of equals."""
    best = (1 << 30, 0, 0)
    for start in range(len(text)):
        if text[start] == " " or start and text[start - 1] != " ":
            continue
        row = list(range(len(item) + 1))
        for end in range(start + 1, min(len(text), start + 2 * len(item) + 6) + 1):
            new = [end - start]
            for i, x in enumerate(item, 1):
                new.append(min(new[i - 1] + 1, row[i] + 1, row[i - 1] + (x != text[end - 1])))
            row = new
            if text[end - 1] != " " and (end == len(text) or text[end] == " "):
                best = min(best, (row[-1], start, end))
    return best


def brute_distance(item, text):
    return brute_nearest(item, text)[0]


def loose_distances(item, text):
    """For each place of the text the edits between the item and the nearest part that ends there, wherever it begins."""
    codes, place = np.array([ord(c) for c in text], np.int64), np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, x in enumerate(item, 1):
        new = np.minimum(row + 1, np.concatenate([[i], row[:-1] + (codes != ord(x))]))
        row = np.minimum.accumulate(new - place) + place
    return row


@settings(max_examples=300, deadline=None)
@given(st.text("ab ", min_size=1, max_size=12).map(decontaminate.normalize).filter(bool), st.text("ab c", max_size=30).map(decontaminate.normalize), st.integers(0, 6))
def test_nearest(text_of_item, text, budget):
    item = decontaminate.Item(1, text_of_item, budget, decontaminate._bits(text_of_item), decontaminate._bits(text_of_item[::-1]), [])
    want = brute_nearest(text_of_item, text)
    assert decontaminate.nearest(item, text, 0, len(text)) == (want if want[0] <= budget else None)


def test_items_are_whole_words(spark):
    items = spark.createDataFrame([(1, "yes"), (2, "art"), (3, "the art of war is old")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "green eyes at the party"), (2, "Oh yes!"), (3, "on the art of war is old men say"), (4, "the bart of war is cold")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["item_id"], r["edits"], r["start"], r["end"]) for r in decontaminate.matches(docs, items).collect()) == [(2, 1, 0, 3, 6), (3, 2, 0, 7, 10), (3, 3, 0, 3, 24)]
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, items).collect()) == [1, 4]


def test_matcher_finds_every_item_within_budget():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(60)]
    items = [(i, decontaminate.normalize(" ".join(rng.choices(words, k=8)))) for i in range(12)]
    matcher = decontaminate.Matcher(items, decontaminate.ERROR_RATE)
    for _ in range(150):
        i, item = rng.choice(items)
        text = list(item)
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(text))
            rng.choice([lambda: text.insert(at, "x"), lambda: text.pop(at), lambda: text.__setitem__(at, "y")])()
        text = " ".join(rng.choices(words, k=5)) + " " + "".join(text) + " " + " ".join(rng.choices(words, k=5))
        found = {x: e for x, *e in matcher.search(text)}
        for j, other in items:
            want = brute_nearest(other, text)
            assert found.get(j) == (list(want) if want[0] <= int(len(other) * decontaminate.ERROR_RATE) else None)


def test_decontamination(spark, table, texts, odd, empty):
    items = [(r["item_id"], decontaminate.normalize(r["text"])) for r in table("benchmark").collect()]
    found = {(r["doc_id"], r["item_id"]): r["edits"] for r in queries.op9_decontamination(spark, SF).collect()}
    exact = {(d, i) for d, t in texts for i, x in items if f" {x} " in f" {decontaminate.normalize(t)} "}
    assert {k for k, e in found.items() if e == 0} == exact and exact
    for (d, i), e in found.items():
        assert brute_distance(dict(items)[i], decontaminate.normalize(dict(texts)[d])) == e
    left = {r["doc_id"] for r in decontaminate.clean(table("documents"), table("benchmark"), block_chars=500).collect()}
    assert left == {d for d, _ in texts} - {d for d, _ in found}
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog"), (2, None), (3, "")], "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontaminate.matches(odd, bench).collect()) == [1, 2, 2]
    assert decontaminate.clean(odd, bench).count() == len(TEXTS) - 3
    assert decontaminate.matches(empty, bench).collect() == [] and decontaminate.matches(odd, bench.limit(0)).collect() == []
