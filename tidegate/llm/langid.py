"""Language identification by multilingual mixture inference.

A document is a mixture of languages: each of its words was drawn from language l with proportion pi_l, and by l's
character n-grams. Expectation-maximisation estimates the proportions; the set of languages is that of the best
likelihood less a penalty for each language more.
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

#: Labelled documents that a language's n-grams are learned from, in expectation: the bound of the sample.
TRAIN_PER_LANGUAGE = 1000
#: Longer labelled texts are not drawn into the sample, but for the beginnings of those whose language has no shorter one; every
#: text is identified whole.
TRAIN_CHARS = 50_000
#: Hashed n-grams of bytes, and what is added to each count. A language takes 4 bytes a bucket in the model, 256 KB.
BUCKETS, SMOOTH = 1 << 16, 0.05
#: Words times languages that are worked on at once: bounds a worker's memory, however long a text or many the languages.
CELLS = 1 << 23
ROUNDS = 6
#: A language more must gain this many times log(words) / 2 of log-likelihood.
PENALTY = 2.0
UNKNOWN = "und"
#: Bytes of lower-case text that belong to words: ASCII letters and whatever is not ASCII.
_WORD_BYTE = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


class Model(NamedTuple):
    languages: list[str]
    log_p: np.ndarray  # BUCKETS x languages


def _words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of letters, lower-cased: as _common.words."""
    lower = pc.cast(pc.utf8_lower(text), pa.large_string())
    valid, offsets, data = lower.buffers()
    data = pa.py_buffer(_WORD_BYTE[np.frombuffer(data, np.uint8)]) if data else data
    return C.words(pa.Array.from_buffers(pa.large_string(), len(lower), [valid, offsets, data], offset=lower.offset))


def _grams(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashed byte trigrams of each word with a space on either side, and each word's offset in them."""
    n = len(distinct)
    if not n:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    padded = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), distinct, pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string()))
    _, offsets, data = padded.buffers()
    ends = np.frombuffer(offsets, np.int64)[padded.offset : padded.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].astype(np.uint32)
    code = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)
    # those that begin at a word's last two bytes run into the next word
    begin, lens = ends[:-1] - ends[0], np.diff(ends) - 2
    offsets = np.concatenate([[0], np.cumsum(lens)])
    return bucket[np.repeat(begin - offsets[:-1], lens) + np.arange(offsets[-1])], offsets


def _counts(texts: pa.Array) -> np.ndarray:
    """How often each bucket's n-grams stand in the texts."""
    _, codes, distinct = _words(texts)
    bucket, ends = _grams(distinct)
    times = np.bincount(codes, minlength=len(distinct))
    return np.bincount(bucket, np.repeat(times, np.diff(ends)), minlength=BUCKETS)


def _model(counts: dict[str, np.ndarray]) -> Model:
    languages = sorted(counts)
    log_p = np.empty((BUCKETS, len(languages)), np.float32)
    for k, x in enumerate(languages):
        log_p[:, k] = np.log((counts[x] + SMOOTH) / (counts[x].sum() + SMOOTH * BUCKETS))
    return Model(languages, log_p)


def train(texts: list[str], labels: list[str]) -> Model:
    return _model({x: _counts(pa.array([t for t, y in zip(texts, labels) if x == y], pa.string())) for x in set(labels)})


class _Block(NamedTuple):
    """Words that are worked on at once: likelihoods (words x languages, the best language has 1), and each word's document."""

    like: np.ndarray
    docs: np.ndarray  # the documents that have words here
    starts: np.ndarray  # where each one's words begin
    row: np.ndarray  # each word's place in docs


def _blocks(model: Model, distinct: pa.Array, offsets: np.ndarray, codes: np.ndarray) -> Iterator[_Block]:
    """The words in blocks of at most CELLS / languages words, from first to last."""
    bucket, ends = _grams(distinct)
    n, step = int(offsets[-1]), max(1, CELLS // max(1, len(model.languages)))
    for a in range(0, n, step):
        b = min(n, a + step)
        used, at = np.unique(codes[a:b], return_inverse=True)
        like = np.empty((len(used), len(model.languages)), np.float32)
        for i in range(0, len(used), max(1, step // 8)):  # a word has some eight n-grams
            part = used[i : i + max(1, step // 8)]
            lens = np.diff(ends)[part]
            to = np.concatenate([[0], np.cumsum(lens)])
            grams = bucket[np.repeat(ends[part] - to[:-1], lens) + np.arange(to[-1])]
            like[i : i + len(part)] = np.add.reduceat(model.log_p[grams], to[:-1], axis=0)
        like -= like.max(1, keepdims=True)
        like = np.exp(np.maximum(like, -60))[at]
        docs = np.arange(np.searchsorted(offsets, a, side="right") - 1, np.searchsorted(offsets, b))
        docs = docs[offsets[docs + 1] > np.maximum(offsets[docs], a)]  # not those without words
        starts = np.maximum(offsets[docs], a) - a
        row = np.repeat(np.arange(len(docs)), np.diff(np.append(starts, b - a)))
        yield _Block(like, docs, starts, row)


def _em(blocks: Callable[[], Iterator[tuple[_Block, np.ndarray]]], n: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each document after ROUNDS, and its log-likelihood. The blocks come with their likelihoods to use."""
    for i in range(ROUNDS + 1):
        new, found = np.zeros_like(pi), np.zeros(len(pi))
        for block, like in blocks():
            part = like * pi[block.docs][block.row]
            total = part.sum(1)
            if i < ROUNDS:
                part /= total[:, None]
                new[block.docs] += np.add.reduceat(part, block.starts, axis=0)
            else:
                found[block.docs] += np.add.reduceat(np.log(total.astype(np.float64)), block.starts)
        if i < ROUNDS:
            pi = new / n[:, None]
    return pi, found


def infer(model: Model, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (documents x languages, 0 outside the chosen set), and the words of each document."""
    n_lang = len(model.languages)
    offsets, codes, distinct = _words(text)
    words = np.diff(offsets)
    out = np.zeros((len(text), n_lang), np.float32)
    if not n_lang:
        return out, words
    group = max(1, CELLS // n_lang)  # documents of about so many words go together; a longer one alone, block by block
    at = 0
    while at < len(text):
        to = max(at + 1, min(int(np.searchsorted(offsets, offsets[at] + group, side="right")) - 1, at + group))
        some = at + np.flatnonzero(words[at:to])
        if len(some):
            ends = np.concatenate([[0], np.cumsum(words[some])])
            out[some] = _choose(model, distinct, ends, codes[offsets[at] : offsets[to]])
        at = to
    return out, words


def _choose(model: Model, distinct: pa.Array, offsets: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The proportions of some documents, each of which has words."""
    n, n_lang = np.diff(offsets).astype(np.float32), len(model.languages)
    made = list(_blocks(model, distinct, offsets, codes)) if offsets[-1] * n_lang <= CELLS else None
    blocks = lambda: made if made is not None else _blocks(model, distinct, offsets, codes)
    full, _ = _em(lambda: ((x, x.like) for x in blocks()), n, np.full((len(n), n_lang), 1 / n_lang, np.float32))
    order = np.argsort(-full, axis=1, kind="stable")
    # sets of the likeliest 1, 2, ... languages; a document goes on while one more pays
    chosen = np.zeros_like(full)
    np.put_along_axis(chosen, order[:, :1], 1.0, axis=1)
    best = np.zeros(len(n))
    for x in blocks():
        top = np.take_along_axis(x.like, order[x.docs][x.row, :1], axis=1)[:, 0]
        best[x.docs] += np.add.reduceat(np.log(top.astype(np.float64)), x.starts)
    going = np.arange(len(n))
    for size in range(2, n_lang + 1):
        # no more than a doubling of each word's likelihood can be gained where the next language explains nothing
        going = going[np.take_along_axis(full[going], order[going, size - 1 : size], axis=1)[:, 0] > 1e-3]
        if not len(going):
            break
        place = np.full(len(n), -1)
        place[going] = np.arange(len(going))

        def likely(size=size, place=place) -> Iterator[tuple[_Block, np.ndarray]]:
            for x in blocks():
                docs = np.flatnonzero(place[x.docs] >= 0)
                if len(docs):
                    keep = place[x.docs[x.row]] >= 0
                    lens = np.diff(np.append(x.starts, len(x.row)))[docs]
                    row = np.repeat(np.arange(len(docs)), lens)
                    like = np.take_along_axis(x.like[keep], order[x.docs[docs]][row, :size], axis=1)
                    yield _Block(like, place[x.docs[docs]], np.cumsum(lens) - lens, row), like

        pi = np.take_along_axis(full[going], order[going, :size], axis=1) + 1e-6
        pi, found = _em(likely, n[going], pi / pi.sum(1, keepdims=True))
        pays = found - best[going] > PENALTY * 0.5 * np.log(n[going] + 1)
        better = going[pays]
        chosen[better] = 0
        rows = np.repeat(better[:, None], size, axis=1)
        chosen[rows, order[better, :size]] = pi[pays]
        best[better] = found[pays]
        going = better
    return chosen


def held_out() -> Column:
    """Rows that nothing is learned from; a null doc_id is not held out, and not learned from either."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame) -> Model:
    """Learn each language's n-grams from a sample of labelled texts of at most TRAIN_CHARS, drawn by a hash of doc_id.

    Every label is learned. A language that has longer texts only is learned from the first TRAIN_CHARS of a sample of
    these. N-grams are counted by the executors; the driver gets the counts, at most BUCKETS of a language. Rows with a
    null lang or doc_id, or held out, are not learned from; repeated rows count as often as they stand; without labels
    the model has no language.
    """
    C.settings(docs.sparkSession)
    known = C.documents(docs, "doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.withColumn("lang", F.col("lang").cast("string"))
    short = F.length("text") <= TRAIN_CHARS
    each = known.groupBy("lang").agg(F.count_if(short).alias("short"), F.count("*").alias("every")).collect()
    counts, long = {r["lang"]: r["short"] or r["every"] for r in each}, [r["lang"] for r in each if not r["short"]]
    if not counts:
        return Model([], np.zeros((BUCKETS, 0), np.float32))
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, TRAIN_PER_LANGUAGE / n)))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)
    drawn = known.filter(draw & (short | F.col("lang").isin(long) if long else short)).select(F.substring("text", 1, TRAIN_CHARS).alias("text"), "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches):
            lang = batch.column("lang")
            for x in pc.unique(lang).to_pylist():
                n = _counts(batch.column("text").filter(pc.equal(lang, x)))
                bucket = np.flatnonzero(n)
                yield pa.record_batch([pa.array([x] * len(bucket), pa.string()), pa.array(bucket), pa.array(n[bucket].astype(np.int64))], ["lang", "bucket", "n"])

    found = drawn.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = found.groupBy("lang").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("counts"))
    learned = {x: np.zeros(BUCKETS) for x in counts}
    for r in found.toLocalIterator():
        learned[r["lang"]][r["buckets"]] = r["counts"]
    return _model(learned)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages, proportions of every whole text.

    lang_pred is the language of the largest proportion, score that proportion; languages and proportions list the
    chosen set in descending order. `und`, with score 0 and no languages, stands for a null or empty text, one
    without a letter, and everything if no row is labelled. Rows keep their doc_id, null or repeated; lang serves as
    a label only; other columns are ignored. Nothing but the sample leaves the executors.
    """
    C.settings(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches):
            found = _labels(shared.value, batch.column("text"))
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), *found], ["doc_id", "lang_pred", "score", "languages", "proportions"])

    out = C.documents(docs, "doc_id", "text").mapInArrow(search, "doc_id long, lang_pred string, score double, languages array<string>, proportions array<double>")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "languages", "proportions")


def _labels(model: Model, text: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    pi, words = infer(model, text)
    letter = pc.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False)
    good = letter & (words > 0) & (len(model.languages) > 0)
    pred, score, langs, shares = [], [], [], []
    for ok, p in zip(good.tolist(), pi.astype(np.float64)):
        order = [i for i in np.argsort(-p, kind="stable") if p[i] > 0] if ok else []
        langs.append([model.languages[i] for i in order])
        shares.append([float(p[i]) for i in order])
        pred.append(langs[-1][0] if order else UNKNOWN)
        score.append(min(1.0, shares[-1][0]) if order else 0.0)
    return pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(langs, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, in which a language, or several, is found; others go.

    None is found in a null or empty text and in one without a letter, and nowhere if no row is labelled. Rows are
    decided one by one: repeated ones stay or go alike. An empty table stays empty.
    """
    C.settings(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(fit(docs)), docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches):
            pred, _, _, _ = _labels(shared.value, pc.fill_null(batch.column(at), ""))
            yield batch.filter(pc.not_equal(pred, UNKNOWN))

    return docs.mapInArrow(keep, docs.schema)
