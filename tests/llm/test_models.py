"""Language identification and toxicity: held-out accuracy, gradients, and the cases that they must bear."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import TEXTS
from tidegate.llm import langid, queries, toxicity

MEDIUM = "/root/testdata/sf0.01"


def test_language(spark, table):
    found = {r["doc_id"]: r for r in queries.op6_language_id(spark, MEDIUM).collect()}
    truth = {r["doc_id"]: r["lang"] for r in table("documents", MEDIUM).collect()}
    assert found.keys() == truth.keys()
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in found.items())
    held = [d for d, r in found.items() if r["held_out"]]
    assert np.mean([found[d]["lang_pred"] == truth[d] for d in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in found.values())


def brute_proportions(model, text, chosen):
    """EM over the words of one text, one word at a time, for a given set of languages."""
    _, codes, distinct = langid._words(pa.array([text]))
    bucket, ends = langid._grams(distinct)
    like = [np.exp(model.log_p[bucket[ends[c] : ends[c + 1]]].sum(0).astype(float) - model.log_p[bucket[ends[c] : ends[c + 1]]].sum(0).max()) for c in codes]
    pi = np.full(len(chosen), 1 / len(chosen))
    for _ in range(60):
        pi = np.mean([x[chosen] * pi / (x[chosen] * pi).sum() for x in like], axis=0)
    return pi


def test_mixture(table):
    docs = [(r["text"], r["lang"]) for r in table("documents", MEDIUM).collect()]
    model = langid.train([t for t, _ in docs], [x for _, x in docs])
    en, de = (max((t for t, x in docs if x == k and 1000 < len(t) < 3000), key=len) for k in ("en", "de"))
    pi, words = langid.infer(model, pa.array([en, de, f"{en} {de}", ""]))
    names = [{model.languages[i] for i in np.flatnonzero(p > 0)} for p in pi]
    assert names[0] == {"en"} and names[1] == {"de"} and names[2] >= {"en", "de"} and names[3] == set()
    chosen = np.flatnonzero(pi[2] > 0)
    assert pi[2][chosen] == pytest.approx(brute_proportions(model, f"{en} {de}", chosen), abs=0.05)
    assert pi.sum(1) == pytest.approx([1, 1, 1, 0], abs=1e-4)


def test_long_texts_and_many_languages_in_blocks(table, monkeypatch):
    """The same proportions whether words are worked on at once or in small blocks."""
    docs = [(r["text"], r["lang"]) for r in table("documents").collect()]
    model = langid.train([t for t, _ in docs], [x for _, x in docs])
    texts = pa.array([t for t, _ in docs] + ["", f"{docs[0][0]} {docs[1][0]}", None, "x"])
    want, words = langid.infer(model, texts)
    for cells in (400, 4 * 37, 4):
        monkeypatch.setattr(langid, "CELLS", cells)
        some = texts if cells > 4 else texts.slice(len(docs) - 1, 5)
        got, n = langid.infer(model, some)
        assert n.tolist() == words.tolist()[-len(some) :] and got == pytest.approx(want[-len(some) :], abs=2e-3)


def test_three_hundred_languages(spark):
    """Every label is learned, also beyond some hundreds, and each language's texts are told from the others'."""
    rng = np.random.default_rng(2)
    syllables = [a + b for a in "bcdfghjklmnpqrstvwxz" for b in "aeiou"]
    vocabulary = {f"l{k:03}": ["".join(rng.choice(syllables, 3)) for _ in range(12)] for k in range(300)}
    rows = [(1000 * k + i, " ".join(rng.choice(v, 30)), x) for k, (x, v) in enumerate(vocabulary.items()) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert model.languages == sorted(vocabulary)
    assert np.array_equal(model.log_p, langid.train(*zip(*[(t, x) for d, t, x in rows if zlib.crc32(str(d).encode()) % 3 != 1])).log_p)
    found = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df, model).collect()}
    assert np.mean([found[d] == x for d, _, x in rows]) > 0.98


def test_documents_in_several_languages_stay(spark, table):
    docs = {r["lang"]: r["text"] for r in table("documents", MEDIUM).filter("n_chars between 2000 and 4000").collect()}
    mixed = " ".join(t[:1500] for t in docs.values())
    df = table("documents", MEDIUM).select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(-1, mixed, None), (-2, "123 456", None)], "doc_id long, text string, lang string"))
    assert len(docs) > 2 and {r["doc_id"] for r in langid.keep_identified(df).filter("doc_id < 0").collect()} == {-1}


def test_language_odd(odd, empty, table):
    model = langid.fit(table("documents"))
    rows = langid.identify(odd, model).collect()
    assert len(rows) == len(TEXTS)
    unknown = {r["doc_id"] for r in rows if r["lang_pred"] == "und"}
    assert unknown >= {3, 4, 5, 6} and not unknown & {1, 7, 11}
    assert langid.identify(empty, model).collect() == []
    assert {r["lang_pred"] for r in langid.identify(odd.drop("lang").selectExpr("*", "cast(NULL AS string) AS lang")).collect()} == {"und"}
    kept = langid.keep_identified(odd).collect()
    assert {r["doc_id"] for r in kept} >= {1, 7} and not {r["doc_id"] for r in kept} & {3, 4, 5, 6}
    assert langid.keep_identified(empty).collect() == []


def test_language_of_long_texts_only(spark):
    """A label whose labelled texts are all longer than the sample takes is learned and predicted too."""
    short, long = "the house stands by the river and the road", "zuq xoqa wyxu qazo vuqy"
    rows = [(i, f"{short} {i}", "aa") for i in range(20)] + [(100 + i, f"{long} " * (langid.TRAIN_CHARS // len(long) + 1), "bb") for i in range(9)]
    rows += [(200, f"{short} again", None), (201, f"{long} {long}", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert all(len(t) > langid.TRAIN_CHARS for _, t, x in rows if x == "bb")
    assert langid.fit(df).languages == ["aa", "bb"]
    found = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df).collect()}
    assert found == {i: "aa" if i < 100 or i == 200 else "bb" for i, _, _ in rows}


def test_toxicity(spark, table):
    found = {r["doc_id"]: r for r in queries.op5_toxicity(spark, MEDIUM).collect()}
    label = {r["doc_id"]: r["toxic"] for r in table("labels", MEDIUM).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for d, r in found.items())
    held = [d for d in label if d in found and found[d]["held_out"]]
    assert np.mean([found[d]["predicted"] == label[d] for d in held]) >= 0.9
    assert len(found) == table("documents", MEDIUM).count()


def test_gradients():
    net = toxicity.Network(1)
    rng = np.random.default_rng(0)
    net.p = {k: v.astype(float) + (0.1 * rng.standard_normal(v.shape) if k in "EG" else 0) for k, v in net.p.items()}
    offsets, codes, distinct = toxicity._words(pa.array(["a few words of some kind are here " * 5, "others stand there and wait"]))
    x = toxicity.inputs(distinct)
    net.vocabulary = np.unique(x.word[:4])
    begin, end, _ = toxicity.windows(offsets)
    step, mask = toxicity._steps(codes, begin, end)
    target, weight = np.array([1.0, 0, 1, 0][: len(begin)]), np.ones(len(begin))
    _, grad = net.gradients(x, step, mask, target, weight)
    for k, g in grad.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, losses = net.p[k][at], []
        for h in (1e-4, -1e-4):
            net.p[k][at] = old + h
            losses.append(net.gradients(x, step, mask, target, weight)[0])
        net.p[k][at] = old
        assert g[at] == pytest.approx((losses[0] - losses[1]) / 2e-4, rel=1e-2, abs=1e-6), k


def test_windows_cover_all_words():
    for words in range(0, 80):
        begin, end, _ = toxicity.windows(np.array([0, words]))
        assert sorted({i for a, b in zip(begin, end) for i in range(a, b)}) == list(range(words))
        assert all(b - a <= toxicity.WINDOW for a, b in zip(begin, end)) and (np.diff(begin) == toxicity.STRIDE).all()


def test_every_window_counts():
    """A cue at any place of a long text is found."""
    rng = np.random.default_rng(3)
    plain = ["alpha", "beta", "gamma", "delta", "omega"]
    clean = [" ".join(rng.choice(plain, 60)) for _ in range(300)]
    bad = []
    for t in clean[:150]:
        at = rng.integers(0, 60)
        bad.append(" ".join([*t.split()[:at], "vile", "scoundrel", *t.split()[at:]]))
    net = toxicity.train(clean + bad, np.array([0] * 300 + [1] * 150))
    words = rng.choice(["alpha", "beta", "gamma", "delta", "omega"], 5000).tolist()
    for at in (0, 777, 2500, 5000):
        assert toxicity.score_texts(net, pa.array([" ".join(words[:at] + ["vile", "scoundrel"] + words[at:])]))[0] > 0.5
    assert toxicity.score_texts(net, pa.array([" ".join(words), "", "...", None]))[0] < 0.5


def brute_scores(net, texts):
    """Every text's score, one window and one word at a time, by the network's definition."""
    p, h = net.p, toxicity.HIDDEN
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    known = {int(w): i for i, w in enumerate(net.vocabulary)}
    vectors, out = {}, []
    for text in texts:
        _, codes, distinct = langid._words(pa.array([text or ""]))
        words = [distinct[int(c)].as_py() for c in codes]
        best = -np.inf
        for at in range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE) if words else ():
            xs = []
            for w in words[at : at + toxicity.WINDOW]:
                if w not in vectors:
                    x = toxicity.inputs(pa.array([w], pa.large_string()))
                    vectors[w] = np.concatenate([p["E"][known.get(int(x.word[0]), toxicity.VOCABULARY)], sum(p["G"][c] for c in x.chars) / len(x.chars) ** 0.5]).astype(float)
                xs.append(vectors[w])
            states = []
            for k, order in (("f", range(len(xs))), ("b", reversed(range(len(xs))))):
                state, rows = np.zeros(h), {}
                for t in order:
                    a, u = xs[t] @ p[f"W{k}"] + p[f"b{k}"], p[f"U{k}"]
                    z, r = sigmoid(a[:h] + state @ u[:, :h]), sigmoid(a[h : 2 * h] + state @ u[:, h : 2 * h])
                    n = np.tanh(a[2 * h :] + r * (state @ u[:, 2 * h :]))
                    state = (1 - z) * n + z * state
                    rows[t] = state
                states.append([rows[t] for t in range(len(xs))])
            both = np.concatenate(states, axis=1)
            weight = np.exp(np.tanh(both @ p["A"]) @ p["v"])
            best = max(best, (weight / weight.sum()) @ both @ p["o"] + p["c"][0])
        a, b = net.scale.astype(float)
        out.append(sigmoid(a * best + b if words else min(0.0, b - 4)))
    return out


def test_toxicity_of_the_whole_table(spark, table, texts):
    """The registered query's scores against the plain loop, by the network that its sample gives."""
    net = toxicity.fit(table("documents"), table("labels"))
    again = toxicity.fit(table("documents").repartition(7), table("labels").repartition(3))
    assert all(np.array_equal(net.p[k], again.p[k]) for k in net.p) and np.array_equal(net.scale, again.scale)
    found = {r["doc_id"]: r["score"] for r in queries.op5_toxicity(spark, "/root/testdata/sf0.001").collect()}
    assert [found[d] for d, _ in texts] == pytest.approx(brute_scores(net, [t for _, t in texts]), abs=2e-4)


def test_toxicity_sample(spark):
    """Of texts that share an id the least is learned from, of labels the highest; held-out and long ones are not."""
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (3, "x" * (toxicity.TRAIN_CHARS + 1)), (4, None), (5, "e"), (None, "f")], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 1), (4, 1), (5, None), (None, 1), (6, 1)], "doc_id long, toxic int")
    want = {d: x for d, x in ((1, ("a", 1)), (2, ("c", 0)), (4, ("", 1))) if zlib.crc32(str(d).encode()) % 5}
    assert {r["doc_id"]: (r["text"], r["toxic"]) for r in toxicity.sample(docs, labels).collect()} == want


def test_toxicity_odd(spark, odd, empty, table):
    labels = spark.createDataFrame([(1, 1, "x"), (1, 0, "x"), (8, 0, "x"), (None, 1, "x"), (9, None, "x")], "doc_id long, toxic int, text string")
    rows = toxicity.score(odd, labels).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == 0 for r in rows if r["doc_id"] in (3, 4, 5))
    assert toxicity.score(empty, labels).collect() == []
    assert len({round(r["score"], 6) for r in toxicity.score(odd, labels.limit(0)).collect() if r["doc_id"] in (1, 8, 9)}) == 1
