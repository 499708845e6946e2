"""The Jaccard join against all pairs, and the pipeline's stages against plain Python, each on its own input."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import SF, TEXTS
from tests.llm.test_scans import UPPER, WORD, brute_distance, loose_distances
from tests.llm.test_tokens import check_packing
from tidegate.llm import _common as C
from tidegate.llm import decontaminate, jaccard_join, langid, queries, secret_scan


def shingles(text, k):
    w = WORD.findall((text or "").translate(UPPER))
    return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def brute_components(docs, k, num, den):
    """For each row (size, least doc_id of its component), by comparing all pairs of sets."""
    sets = [shingles(t, k) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * den >= num * max(len(a), len(b)) and den * len(a & b) >= num * len(a | b):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)].append(d)
    return [(d, len(s), min(least[find(i)], default=None)) for i, ((d, _), s) in enumerate(zip(docs, sets))]


def brute_kept(docs, k, num, den):
    """The (doc_id, text) that stay, row by row."""
    docs = [(d, t or "") for d, t in docs]
    hashed = [xxhash.xxh64_intdigest(t, seed=42) for _, t in docs]
    sets = [shingles(t, k) for _, t in docs]
    group = list(range(len(docs)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    order = lambda i: (docs[i][0] is None, docs[i][0] or 0, hashed[i] - (hashed[i] >> 63 << 64))
    first = {g: min((i for i in range(len(docs)) if group[i] == g), key=order) for g in set(group)}
    kept = [(d, t) for i, (d, t) in enumerate(docs) if not sets[i] or order(i) == order(first[group[i]])]
    return [x for i, x in enumerate(kept) if (x[0] is None and not shingles(x[1], k)) or x not in kept[:i]]


def test_one_row_of_each(spark):
    """Ids that occur with several texts, chains through them, rows without an id, repeated rows."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    docs = [(1, "a b c d e f"), (2, "a b c d e f"), (1, "g h i j k l"), (0, "g h i j k l"), (None, "m n o p q r"), (None, "m n o p q r"), (None, ""), (None, None), (7, ""), (7, ""), (8, "s t u v w x"), (8, "s t u v w x"), (None, "s t u v w x"), (9, "y z"), (9, "z y")]
    for _ in range(40):
        base = rng.choices(words, k=rng.randint(5, 60))
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = rng.choice(words)
            docs.append((rng.choice([None, *range(20, 40)]), " ".join(copy)))
            docs += [docs[-1]] * rng.choice([0, 0, 1])
    df = spark.createDataFrame([(*d, "x", i) for i, d in enumerate(docs)], "doc_id long, text string, jid string, th int").repartition(5)
    kept = jaccard_join.one_of_each(df, 3, (4, 5))
    assert kept.columns == df.columns
    same([(r["doc_id"], r["text"] or "") for r in kept.collect()], brute_kept(docs, 3, 4, 5))
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, df, SF)
    same([(r["doc_id"], r["text"] or "") for r in stage.collect()], brute_kept(docs, 5, 4, 5))


def test_hot_keys(spark, monkeypatch):
    """A class with a third of the rows, and keys that are dealt into many parts."""
    monkeypatch.setattr(C, "HOT_KEYS", 1_000_000)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    base = rng.choices(words, k=50)
    docs = [(i, " ".join(base)) for i in range(400)] + [(400 + i, " ".join([*base[:i], "zz", *base[i + 1 :]])) for i in range(50)]
    docs += [(500 + i, " ".join(rng.choices(words, k=20) + base[:15])) for i in range(700)] + [(3, docs[0][1])] * 300
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    same(jaccard_join.near_duplicates(df, 3, (4, 5)).collect(), brute_components(docs, 3, 4, 5))
    left = spark.createDataFrame([(i % 3 if i % 2 else i, i) for i in range(3000)], "key long, x long")
    right = left.groupBy("key").agg(F.count("*").alias("n"))
    found = C.spread_join(left, right, "key", "n", 3000, F.xxhash64("x"))
    assert sorted(map(tuple, found.select("key", "x").collect())) == sorted(map(tuple, left.collect()))


def same(rows, want):
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))


def test_registered(spark, texts):
    same(queries.op7_jaccard_join(spark, SF).collect(), brute_components(texts, 3, 9, 10))


@pytest.mark.parametrize("k, num, den, block", [(5, 4, 5, 1024), (3, 9, 10, 8), (2, 1, 2, 4), (1, 1, 1, 2)])
def test_groups_of_copies(spark, k, num, den, block, monkeypatch):
    """Groups of near copies, chains of them, shared passages, and tiny blocks."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = random.Random(k)
    words = [f"w{i}" for i in range(400)]
    passage = rng.choices(words, k=40)
    texts = []
    for _ in range(12):
        base = rng.choices(words, k=rng.randint(3, 90))
        if rng.random() < 0.4:
            base = base + passage
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
            if rng.random() < 0.3:
                base = copy
    docs = list(enumerate(texts)) + TEXTS[:9]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    same(jaccard_join.near_duplicates(df, k, (num, den)).collect(), brute_components(docs, k, num, den))


def test_small_sets(spark):
    """Sets that share one to three shingles at a low threshold, in many small groups."""
    rng = random.Random(1)
    docs = [(5 * g + i, " ".join(rng.sample([f"g{g}w{j}" for j in range(9)], rng.randint(2, 5)))) for g in range(150) for i in range(5)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    same(jaccard_join.near_duplicates(df, 1, (1, 2)).collect(), brute_components(docs, 1, 1, 2))


def test_odd(odd, empty):
    same(jaccard_join.near_duplicates(odd, 3, (9, 10)).collect(), brute_components(TEXTS, 3, 9, 10))
    assert jaccard_join.near_duplicates(empty).collect() == []
    kept = jaccard_join.one_of_each(odd, 5, (4, 5))
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, -1, 1, 3, 4, 5, 6, 7, 8, 10, 11, 12, 13, 14]
    assert jaccard_join.one_of_each(empty).collect() == []


def test_components(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, 3), (3, 9), (7, 7), (9, 5)]
    found = dict(map(tuple, jaccard_join.components(spark.createDataFrame(links, "x long, y long")).collect()))
    assert found == {**{i: 100 for i in range(100, 161)}, 3: 3, 5: 3, 9: 3}


def test_stages(spark, table):
    """Every stage on all that the one before it kept; clean documents stay."""
    docs = table("documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    bench = [decontaminate.normalize(r["text"]) for r in table("benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, SF)
        rows = out.collect()
        if name == "language_id":
            share = {r["doc_id"]: r for r in langid.identify(docs).collect()}
            assert {r["doc_id"] for r in rows} == {d for d, r in share.items() if r["lang_pred"] != "und"}
            assert len(rows) >= 0.95 * len(before)
        elif name == "near_duplicates":
            want = brute_components([(r["doc_id"], r["text"]) for r in before], 5, 4, 5)
            assert sorted(r["doc_id"] for r in rows) == sorted(d for d, _, c in want if d == c)
        elif name == "decontamination":
            hit = {r["doc_id"] for r in before for x in bench if brute_near(x, decontaminate.normalize(r["text"]))}
            assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in before} - hit
        elif name == "secrets":
            index = secret_scan.Index(secret_scan.RULES)
            assert len(rows) == len(before) and all(r["n_chars"] == len(r["text"]) for r in rows)
            assert not any(p.search(r["text"]) for r in rows for rule, p, _ in index.rules if rule.kind == "hex")
            plain = {r["doc_id"]: r["text"] for r in rows}
            assert all(("token" in r["text"] or plain[r["doc_id"]] == r["text"]) for r in before if "=" not in r["text"] and "@" not in r["text"])
        else:
            check_packing(rows, [(r["doc_id"], r["text"]) for r in before], 2048, 0)
            break
        assert out.columns == docs.columns
        docs = spark.createDataFrame(rows, docs.schema)


def brute_near(item, text):
    """Whether some run of whole words is within the budget, by dynamic programming over the whole text."""
    if f" {item} " in f" {text} ":
        return True
    k = int(len(item) * decontaminate.ERROR_RATE)
    grams = {item[i : i + 3] for i in range(len(item) - 2)}
    if not k or len(grams & {text[i : i + 3] for i in range(len(text) - 2)}) < len(grams) - 3 * k:
        return False
    tried = set()
    for end in np.flatnonzero(loose_distances(item, text) <= k).tolist():
        a, b = text.rfind(" ", 0, max(0, end - len(item) - k)) + 1, text.find(" ", end + k)
        if (a, b) not in tried and brute_distance(item, text[a : b if b >= 0 else len(text)]) <= k:
            return True
        tried.add((a, b))
    return False


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and set(rows[0].asDict()) >= {"doc_id", "piece", "sequence_id", "offset"}


def test_pipeline_odd(spark, odd, table, tmp_path):
    for name, docs in (("odd", odd), ("empty", odd.limit(0))):
        folder = f"{tmp_path}/{name}"
        docs.select("doc_id", "text", "lang", "source", "n_chars", "key").write.parquet(f"{folder}/documents.parquet")
        table("benchmark").write.parquet(f"{folder}/benchmark.parquet")
        rows = corpus_pipeline.run(spark, folder).collect()
        assert bool(rows) == (name == "odd")
