"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word enters as its own embedding, if enough documents of the sample hold it, and as the sum of the embeddings of its
hashed character 4-grams. Windows of words, each overlapping the next by half, are scored all; a document's score is
calibrated from its best window's.

The sample is dealt into a fixed number of shards. In each round every shard is learned from by a task of its own, from
the same parameters, which are then averaged: the result depends on the sample alone, not on the cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm import _common as C
from tidegate.llm.langid import _words

#: Words of a window, and from one window's beginning to the next one's.
WINDOW, STRIDE = 24, 12
#: Labelled documents of either label that are learned from, at most; longer texts are not drawn into the sample.
TRAIN_PER_LABEL, TRAIN_CHARS = 2500, 30_000
#: Windows of documents labelled 0 that a training round uses.
TRAIN_WINDOWS = 12_000
VOCABULARY, CHAR_BUCKETS, WORD_DIM, CHAR_DIM, HIDDEN, ATTEND = 8192, 1 << 15, 6, 8, 8, 8
#: Documents of the sample that a word or 4-gram must stand in to be learned.
LEAST_DOCUMENTS = 4
#: Shards of the sample, rounds of averaging, and passes of a shard in a round; batches and steps of Adam.
SHARDS, ROUNDS, EPOCHS, BATCH, RATE, DECAY = 8, 6, 2, 128, 0.01, 0.002
#: Windows that run through the network together: their arrays stay in a core's cache.
TOGETHER = 2048


class Inputs(NamedTuple):
    """The distinct words of some texts: 64-bit hash, buckets and offsets of their character 4-grams."""

    word: np.ndarray
    chars: np.ndarray
    offsets: np.ndarray


def inputs(distinct: pa.Array) -> Inputs:
    """4-grams of bytes, over two spaces before a word and one behind it; a word's hash is made of them in order."""
    n = len(distinct)
    if not n:
        return Inputs(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(1, np.int64))
    space = [pa.scalar(x, pa.large_string()) for x in ("  ", " ", "")]
    padded = pc.binary_join_element_wise(space[0], distinct, space[1], space[2])
    _, ends, data = padded.buffers()
    ends = np.frombuffer(ends, np.int64)[padded.offset : padded.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].astype(np.uint32)
    code = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    lens = np.diff(ends) - 3
    offsets = np.concatenate([[0], np.cumsum(lens)])
    code = code[np.repeat(ends[:-1] - ends[0] - offsets[:-1], lens) + np.arange(offsets[-1])]
    place = (np.arange(len(code)) - np.repeat(offsets[:-1], lens)).astype(np.uint64)
    mixed = (code.astype(np.uint64) + place * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    word = np.add.reduceat(mixed ^ (mixed >> np.uint64(31)), offsets[:-1])
    return Inputs(word, ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64), offsets)


def windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and text of the windows over texts whose words lie between offsets. A text without words has none."""
    words = np.diff(offsets)
    n = np.where(words > 0, np.maximum(0, -(-(words - WINDOW) // STRIDE)) + 1, 0)
    text = np.repeat(np.arange(len(words)), n)
    begin = offsets[text] + (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    return begin, np.minimum(begin + WINDOW, offsets[text + 1]), text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters: E, G embeddings; for each direction W (input), U (recurrent), b of the gates z, r, n; A, v attention; o, c output."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        new = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"E": np.zeros((VOCABULARY + 1, WORD_DIM), np.float32), "G": np.zeros((CHAR_BUCKETS, CHAR_DIM), np.float32), "A": new(2 * h, ATTEND, scale=0.5), "v": new(ATTEND, scale=0.5), "o": new(2 * h, scale=0.5), "c": np.zeros(1, np.float32)}
        for k in "fb":
            self.p |= {f"W{k}": new(d, 3 * h, scale=d**-0.5), f"U{k}": new(h, 3 * h, scale=h**-0.5), f"b{k}": np.zeros(3 * h, np.float32)}
        self.vocabulary = np.zeros(0, np.uint64)  # hashes of the words that have a row in E, ascending; others have the last row
        self.word_odds, self.char_odds = np.zeros(1), np.zeros(CHAR_BUCKETS)  # log-odds of E's rows (0 in the last one) and of 4-grams
        self.scale = np.array([1.0, 0.0], np.float32)  # calibration of a document's best window

    def rows(self, word: np.ndarray) -> np.ndarray:
        """The words' rows in E."""
        if not len(self.vocabulary):
            return np.full(len(word), VOCABULARY)
        at = np.minimum(np.searchsorted(self.vocabulary, word), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == word, at, VOCABULARY)

    def begin(self, base: np.ndarray, word: np.ndarray, in_word: np.ndarray, in_char: np.ndarray, rng: np.random.Generator) -> None:
        """Choose the vocabulary and begin the embeddings at the log-odds of words and 4-grams in labelled documents.

        base: documents of label 0 and 1; in_word, in_char: rows of how many of them hold each word, each bucket's 4-grams.
        """
        base = np.maximum(base, 1)

        def odds(count: np.ndarray) -> np.ndarray:
            found = np.log((count[1] + 0.5) / (base[1] + 1)) - np.log((count[0] + 0.5) / (base[0] + 1))
            return np.where(count.sum(0) >= LEAST_DOCUMENTS, found, 0)

        word_odds = odds(in_word)
        frequent = np.flatnonzero(in_word.sum(0) >= LEAST_DOCUMENTS)
        frequent = frequent[np.lexsort((word[frequent], -np.abs(word_odds[frequent])))[:VOCABULARY]]
        frequent = frequent[np.argsort(word[frequent])]
        self.vocabulary, self.char_odds = word[frequent], odds(in_char)
        self.word_odds = np.append(word_odds[frequent], np.zeros(VOCABULARY + 1 - len(frequent)))
        for table, values, at in (("E", word_odds[frequent], np.arange(len(frequent))), ("G", self.char_odds, np.arange(CHAR_BUCKETS))):
            width = self.p[table].shape[1]
            self.p[table][at] = (values[:, None] * (rng.standard_normal(width) * 0.25)).astype(np.float32)

    def signal(self, x: Inputs) -> np.ndarray:
        """For each distinct word the greatest log-odds among it and its 4-grams."""
        return np.maximum(self.word_odds[self.rows(x.word)], np.maximum.reduceat(self.char_odds[x.chars], x.offsets[:-1]))

    def embed(self, x: Inputs) -> np.ndarray:
        out = np.empty((len(x.word), WORD_DIM + CHAR_DIM), np.float32)
        lens = np.diff(x.offsets)
        out[:, :WORD_DIM] = self.p["E"][self.rows(x.word)]
        for a in range(0, len(out), 16_384):
            b = min(a + 16_384, len(out))
            chars = self.p["G"][x.chars[x.offsets[a] : x.offsets[b]]]
            out[a:b, WORD_DIM:] = np.add.reduceat(chars, x.offsets[a:b] - x.offsets[a], axis=0) / np.sqrt(lens[a:b])[:, None]
        return out

    def _direction(self, k: str, projected: np.ndarray, codes: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """Hidden states, steps first. codes: steps x windows; beyond a window's end the state stays as it is."""
        h, U = HIDDEN, self.p[f"U{k}"]
        state = np.zeros((codes.shape[1], h), np.float32)
        out = np.empty((len(codes), codes.shape[1], h), np.float32)
        for t in range(len(codes)) if k == "f" else range(len(codes) - 1, -1, -1):
            x = projected[codes[t]]
            zr = _sigmoid(x[:, : 2 * h] + state @ U[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            again = state @ U[:, 2 * h :]
            n = np.tanh(x[:, 2 * h :] + r * again)
            if keep is not None:
                keep.append((t, z, r, n, again, state))
            state = np.where(mask[t][:, None], n + z * (state - n), state)
            out[t] = state
        return out

    def forward(self, embedded: np.ndarray, codes: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows; codes: steps x windows, into embedded."""
        p, states = self.p, []
        for k in "fb":
            steps: list | None = None if keep is None else keep.setdefault(k, [])
            states.append(self._direction(k, embedded @ p[f"W{k}"] + p[f"b{k}"], codes, mask, steps))
        return self._pool(np.concatenate(states, axis=2), mask, keep)

    def _pool(self, both: np.ndarray, mask: np.ndarray, keep: dict | None) -> np.ndarray:
        p = self.p
        tanh = np.tanh(both @ p["A"])
        score = np.where(mask, tanh @ p["v"], -1e9)
        weight = np.exp(score - score.max(0))
        weight /= weight.sum(0)
        pooled = (weight[:, :, None] * both).sum(0)
        if keep is not None:
            keep |= {"both": both, "tanh": tanh, "weight": weight, "pooled": pooled}
        return pooled @ p["o"] + p["c"][0]

    def gradients(self, x: Inputs, codes: np.ndarray, mask: np.ndarray, target: np.ndarray, importance: np.ndarray) -> tuple[float, dict]:
        """Cross-entropy of the windows and its gradient."""
        p, h = self.p, HIDDEN
        embedded, keep = self.embed(x), {}
        prob = _sigmoid(self.forward(embedded, codes, mask, keep))
        total = importance.sum()
        loss = float(-(importance * np.log(np.where(target > 0, prob, 1 - prob) + 1e-7)).sum() / total)
        dlogit = ((prob - target) * importance / total).astype(np.float32)
        g = {"o": keep["pooled"].T @ dlogit, "c": np.array([dlogit.sum()], np.float32)}
        dpooled = dlogit[:, None] * p["o"]
        both, weight, tanh = keep["both"], keep["weight"], keep["tanh"]
        dboth = weight[:, :, None] * dpooled
        dweight = (both * dpooled).sum(2)
        dscore = np.where(mask, weight * (dweight - (weight * dweight).sum(0)), 0)
        g["v"] = np.tensordot(dscore, tanh, ((0, 1), (0, 1)))
        dpre = dscore[:, :, None] * p["v"] * (1 - tanh**2)
        g["A"] = np.tensordot(both, dpre, ((0, 1), (0, 1)))
        dboth = dboth + dpre @ p["A"].T
        dembedded = np.zeros_like(embedded)
        for i, k in enumerate("fb"):
            U, dstate = p[f"U{k}"], np.zeros((codes.shape[1], h), np.float32)
            dU, dsteps = np.zeros_like(U), np.zeros((*codes.shape, 3 * h), np.float32)
            for t, z, r, n, again, before in reversed(keep[k]):
                dstate = dstate + dboth[t, :, i * h : (i + 1) * h]
                live = np.where(mask[t][:, None], dstate, 0)
                dn = live * (1 - z) * (1 - n**2)
                dz = live * (before - n) * z * (1 - z)
                dr = dn * again * r * (1 - r)
                gates = np.concatenate([dz, dr, dn * r], axis=1)
                dU += before.T @ gates
                dsteps[t] = np.concatenate([dz, dr, dn], axis=1)
                dstate = np.where(mask[t][:, None], live * z + gates @ U.T, dstate)
            dprojected = np.zeros((len(embedded), 3 * h), np.float32)
            np.add.at(dprojected, codes, dsteps)
            g[f"U{k}"], g[f"b{k}"], g[f"W{k}"] = dU, dprojected.sum(0), embedded.T @ dprojected
            dembedded += dprojected @ p[f"W{k}"].T
        g["E"], g["G"] = np.zeros_like(p["E"]), np.zeros_like(p["G"])
        np.add.at(g["E"], self.rows(x.word), dembedded[:, :WORD_DIM])
        g["E"][VOCABULARY] = 0
        lens = np.diff(x.offsets)
        np.add.at(g["G"], x.chars, np.repeat(dembedded[:, WORD_DIM:] / np.sqrt(lens)[:, None], lens, axis=0))
        return loss, g

    def calibrate(self, best: np.ndarray, label: np.ndarray) -> None:
        some = np.isfinite(best)
        if some.any():
            self.scale[:] = _calibrate(best[some], label[some])

    def logits(self, x: Inputs, codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Logits of all windows: inputs are projected once for each distinct word."""
        embedded, p = self.embed(x), self.p
        projected = {k: (embedded @ p[f"W{k}"] + p[f"b{k}"]).astype(np.float32) for k in "fb"}
        out = np.empty(len(begin), np.float32)
        for at in range(0, len(begin), TOGETHER):
            a, b = begin[at : at + TOGETHER], end[at : at + TOGETHER]
            step, mask = _steps(codes, a, b)
            both = np.concatenate([self._direction(k, projected[k], step, mask, None) for k in "fb"], axis=2)
            out[at : at + TOGETHER] = self._pool(both, mask, None)
        return out


def _steps(codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows' words, steps x windows, and which of these lie inside their window."""
    place = begin + np.arange(WINDOW)[:, None]
    mask = place < end
    return codes[np.where(mask, place, begin)], mask


def _most(signal: np.ndarray, codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    step, mask = _steps(codes, begin, end)
    return np.where(mask, signal[step], -9).max(0)


def _best(logits: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    best = np.full(n, -np.inf)
    np.maximum.at(best, text, logits)
    return best


class Shard(NamedTuple):
    """A part of the labelled sample, ready to be learned from."""

    label: np.ndarray
    x: Inputs
    codes: np.ndarray
    offsets: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    text: np.ndarray


def shard_of(texts: pa.Array, label: np.ndarray) -> Shard:
    offsets, codes, distinct = _words(texts)
    return Shard(label, inputs(distinct), codes, offsets, *windows(offsets))


def occurrences(s: Shard) -> tuple[np.ndarray, np.ndarray]:
    """How many documents of label 0 and 1 hold each distinct word, and each bucket's 4-grams."""
    lens = np.diff(s.x.offsets)
    in_word, in_char = np.zeros((2, len(s.x.word)), np.int64), np.zeros((2, CHAR_BUCKETS), np.int64)
    for k, a, b in zip(s.label.tolist(), s.offsets[:-1].tolist(), s.offsets[1:].tolist()):  # each document counts once
        own = np.unique(s.codes[a:b])
        in_word[k][own] += 1
        per = lens[own]
        grams = s.x.chars[np.repeat(s.x.offsets[own] - (np.cumsum(per) - per), per) + np.arange(per.sum())]
        in_char[k][np.unique(grams)] += 1
    return in_word, in_char


def learn(net: Network, s: Shard, turn: int, which: int) -> dict[str, np.ndarray]:
    """What a round's passes over one shard add to the parameters; net is left as it is.

    Of a document labelled 1 only its most telling windows count as such: first those whose words tell the labels apart
    best, later those that the network itself scores highest; of documents labelled 0 the windows that it scores highest
    join a draw of the others.
    """
    rng, start = np.random.default_rng([turn, which]), net.p
    if not len(s.begin):
        return {}
    if turn == 0:
        signal = net.signal(s.x)
        score = np.concatenate([_most(signal, s.codes, s.begin[a : a + 8192], s.end[a : a + 8192]) for a in range(0, len(s.begin), 8192)])
    else:
        score = net.logits(s.x, s.codes, s.begin, s.end)
    top = _best(score, s.text, len(s.label))
    chosen = np.flatnonzero((s.label[s.text] == 1) & (score >= top[s.text] - (0.5 if turn == 0 else 1.0)))
    clean, half = np.flatnonzero(s.label[s.text] == 0), TRAIN_WINDOWS // 2 // SHARDS
    hard = clean[np.argsort(-score[clean], kind="stable")[:half]]
    rest = np.union1d(hard, rng.choice(clean, min(len(clean), half), replace=False))
    rows = np.concatenate([chosen, rest])
    target = np.concatenate([np.ones(len(chosen)), np.zeros(len(rest))]).astype(np.float32)
    importance = np.where(target > 0, 0.5 / max(1, len(chosen)), 0.5 / max(1, len(rest))).astype(np.float32) * len(rows)
    net.p = {k: v.copy() for k, v in start.items()}
    adam = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    tick = 0
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // BATCH)):
            at, m = _steps(s.codes, s.begin[rows[part]], s.end[rows[part]])
            used, at = np.unique(at, return_inverse=True)
            _, grad = net.gradients(_subset(s.x, used), at.reshape(m.shape), m, target[part], importance[part])
            tick += 1
            for k, g in grad.items():
                # of the embeddings only the rows in use move
                hit = np.flatnonzero(g.any(1)) if k in "EG" else slice(None)
                first, second, g = adam[k][0], adam[k][1], g[hit]
                first[hit] += 0.1 * (g - first[hit])
                second[hit] += 0.001 * (g * g - second[hit])
                step = RATE * (first[hit] / (1 - 0.9**tick)) / (np.sqrt(second[hit] / (1 - 0.999**tick)) + 1e-8)
                net.p[k][hit] -= (step + (RATE * DECAY * net.p[k][hit] if k in "EG" else 0)).astype(np.float32)
    moved, net.p = {k: v - start[k] for k, v in net.p.items()}, start
    return moved


def average(net: Network, moved: list[dict[str, np.ndarray]]) -> None:
    """Move net by the shards' mean; a row of the embeddings by the mean of those shards that moved it."""
    moved = [m for m in moved if m]
    for k in net.p if moved else ():
        parts = [m[k] for m in moved]
        n = np.maximum(1, sum((x != 0).any(1) for x in parts))[:, None] if k in "EG" else len(parts)
        net.p[k] = (net.p[k] + sum(parts) / n).astype(np.float32)


def _untrained(label: np.ndarray) -> Network:
    """Without documents of both labels every text scores alike."""
    net = Network()
    net.p["o"][:] = 0
    net.scale[:] = [0.0, 4.0 * (2 * label.mean() - 1) if len(label) else -4.0]
    return net


def train(texts: list[str], label: np.ndarray) -> Network:
    """Fit to documents' labels in this process, with the documents dealt into shards by their place."""
    label = np.asarray(label)
    if len(set(label.tolist())) < 2:
        return _untrained(label)
    shards = [shard_of(pa.array(texts[i::SHARDS], pa.string()), label[i::SHARDS]) for i in range(min(SHARDS, len(texts)))]
    net, counted = Network(), [occurrences(s) for s in shards]
    word, at = np.unique(np.concatenate([s.x.word for s in shards]), return_inverse=True)
    in_word = np.stack([np.bincount(at, np.concatenate([c[0][k] for c in counted]), len(word)) for k in (0, 1)])
    net.begin(np.bincount(label, minlength=2), word, in_word, sum(c[1] for c in counted), np.random.default_rng(7))
    for turn in range(ROUNDS):
        average(net, [learn(net, s, turn, i) for i, s in enumerate(shards)])
    best = [_best(net.logits(s.x, s.codes, s.begin, s.end), s.text, len(s.label)) for s in shards]
    net.calibrate(np.concatenate(best), np.concatenate([s.label for s in shards]))
    return net


def _subset(x: Inputs, used: np.ndarray) -> Inputs:
    lens = np.diff(x.offsets)[used]
    ends = np.concatenate([[0], np.cumsum(lens)])
    return Inputs(x.word[used], x.chars[np.repeat(x.offsets[used] - ends[:-1], lens) + np.arange(ends[-1])], ends)


def _calibrate(best: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic regression of the label on the best window's logit, by Newton's method."""
    a, b, y = 1.0, 0.0, (label * (len(label) - 1) + 0.5) / len(label)
    for _ in range(30):
        p = _sigmoid(a * best + b)
        w, d = p * (1 - p) + 1e-6, p - y
        hessian = np.array([[(w * best * best).sum() + 1e-3, (w * best).sum()], [(w * best).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(hessian, [(d * best).sum() + 1e-3 * (a - 1), d.sum()])
        a, b = max(0.05, a - np.clip(step[0], -1, 1)), b - np.clip(step[1], -2, 2)
    return a, b


def score_texts(net: Network, text: pa.Array) -> np.ndarray:
    """Scores of whole texts, 0 to 1. One without words scores as the calibration's shift alone, never above 0.5."""
    offsets, codes, distinct = _words(text)
    begin, end, of = windows(offsets)
    best = _best(net.logits(inputs(distinct), codes, begin, end) if len(begin) else np.zeros(0), of, len(text))
    a, b = map(float, net.scale)
    empty = min(0.0, b - 4)
    return _sigmoid(np.where(np.isfinite(best), a * np.where(np.isfinite(best), best, 0) + b, empty).astype(np.float64))


def held_out() -> Column:
    """Rows that nothing is learned from; a null doc_id is not held out, and not learned from either."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(shard, doc_id, text, toxic) of at most TRAIN_PER_LABEL documents of each label, drawn by a hash of doc_id, written.

    Of several labels of one document the highest counts, of several texts with one doc_id the least in order. Longer
    texts than TRAIN_CHARS, held-out rows, and rows with a null doc_id or label are left out.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = [tuple(r) for k in (0, 1) for r in known.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_PER_LABEL).collect()]
    ids = F.broadcast(spark.createDataFrame(drawn, "doc_id long, toxic int"))  # 2 * TRAIN_PER_LABEL rows at most
    text = C.documents(docs, "doc_id", "text").filter(F.length("text") <= TRAIN_CHARS)
    rows = text.select(F.col("doc_id").cast("long"), "text").join(ids, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS)).cast("int"))
    # a file for each shard, of one row group: so shards are read by different tasks
    return C.written(rows.repartitionByRange(SHARDS, "shard").select("shard", "doc_id", "text", "toxic"), "sample")


def _by_shard(rows: DataFrame, step: Callable[[Shard, int], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """step on every shard of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            table = pa.Table.from_batches(held).sort_by("doc_id")
            for which in sorted(pc.unique(table.column("shard")).to_pylist()):
                part = table.filter(pc.equal(table.column("shard"), which))
                yield from step(shard_of(part.column("text").combine_chunks(), part.column("toxic").to_numpy().astype(np.int64)), which)

    return rows.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame) -> Network:
    """Learn from the sample. Executors count, learn and score; the driver gets counts of at most VOCABULARY words and of
    CHAR_BUCKETS 4-grams, each round's parameters of SHARDS shards, and the best windows' scores."""
    C.settings(docs.sparkSession)
    rows = sample(docs, labels)
    base = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(base) < 2:
        C.forget(rows)
        return _untrained(np.repeat(list(base), list(base.values())) if base else np.zeros(0))

    def count(s: Shard, which: int) -> Iterator[pa.RecordBatch]:
        in_word, in_char = occurrences(s)
        for kind, key, n in ((0, s.x.word.view(np.int64), in_word), (1, np.arange(CHAR_BUCKETS), in_char)):
            yield pa.record_batch([pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(n[0]), pa.array(n[1])], ["kind", "key", "n0", "n1"])

    counted = _by_shard(rows, count, "kind int, key long, n0 long, n1 long").groupBy("kind", "key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    odds = F.log((F.col("n1") + 0.5) / (base[1] + 1)) - F.log((F.col("n0") + 0.5) / (base[0] + 1))
    words = np.array([tuple(r) for r in counted.filter((F.col("kind") == 0) & (F.col("n0") + F.col("n1") >= LEAST_DOCUMENTS)).orderBy(F.desc(F.abs(odds)), "key").limit(VOCABULARY).select("key", "n0", "n1").collect()], np.int64).reshape(-1, 3)
    in_char = np.zeros((2, CHAR_BUCKETS), np.int64)
    for r in counted.filter("kind = 1").collect():  # CHAR_BUCKETS rows
        in_char[:, r["key"]] = r["n0"], r["n1"]
    net = Network()
    net.begin(np.array([base[0], base[1]]), words[:, 0].copy().view(np.uint64), words[:, 1:].T, in_char, np.random.default_rng(7))
    context = docs.sparkSession.sparkContext
    for turn in range(ROUNDS):
        shared = context.broadcast(net)

        def step(s: Shard, which: int, shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            for k, v in learn(shared.value, s, turn, which).items():
                yield pa.record_batch([pa.array([which], pa.int32()), pa.array([k]), pa.array([v.astype(np.float32).tobytes()], pa.binary())], ["shard", "name", "moved"])

        moved: dict[int, dict[str, np.ndarray]] = {}
        for r in _by_shard(rows, step, "shard int, name string, moved binary").collect():
            moved.setdefault(r["shard"], {})[r["name"]] = np.frombuffer(r["moved"], np.float32).reshape(net.p[r["name"]].shape)
        average(net, [moved[k] for k in sorted(moved)])
        shared.destroy()
    shared = context.broadcast(net)

    def judge(s: Shard, which: int) -> Iterator[pa.RecordBatch]:
        best = _best(shared.value.logits(s.x, s.codes, s.begin, s.end), s.text, len(s.label))
        yield pa.record_batch([pa.array([which] * len(best), pa.int32()), pa.array(np.arange(len(best))), pa.array(best.astype(float)), pa.array(s.label)], ["shard", "place", "best", "label"])

    found = np.array(sorted(map(tuple, _by_shard(rows, judge, "shard int, place long, best double, label long").collect())))
    net.calibrate(found[:, 2], found[:, 3])
    C.forget(rows)
    return net


def score(docs: DataFrame, labels: DataFrame, net: Network | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text.

    A null or empty text, or one without a letter, scores below 0.5; without labels of both kinds every text scores
    alike. Rows keep their doc_id, null or repeated; no column but text enters a score. Texts are not shuffled.
    """
    C.settings(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net or fit(docs, labels))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches):
            found = score_texts(shared.value, batch.column("text"))
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(found)], ["doc_id", "score"])

    out = C.documents(docs, "doc_id", "text").mapInArrow(search, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
