"""Language of words and documents by a linear-chain conditional random field (operator 7).

A word's emission score for a language sums learned weights of its features: byte trigrams with the white
space around it, its prefixes and suffixes of AFFIXES bytes, and the word itself as a hashed lexicon entry. A learned matrix scores the step from one word's language to the next. Forward-backward gives each
word's posterior over the whole text: words are cut into blocks, a block's steps are multiplied to one
matrix, blocks are chained per text, and posteriors are filled in block by block, all texts at once.

A document's language is the one with most posterior mass over words with a letter; its score is that
share. Training maximises the likelihood by AdaGrad on SAMPLE_DOCS documents at most, those of least hash, of a
longer one on SAMPLE_WORDS words from a place drawn by hash, and on sequences spliced from runs of several documents, which show the
transitions of code-switched text. Of several rows of a doc_id one trains; all are predicted row by row. Null texts and texts without a letter are `und` with score 0. Without
training rows every text is `und`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, slices, small_batches, table, texts_of, word_hashes, word_spans

SAMPLE_DOCS, SAMPLE_WORDS = 1200, 4000
GRAM_BITS, WORD_BITS = 16, 18
AFFIXES = (2, 3, 4)
EPOCHS, BATCH, RATE = 4, 60, 0.3
STEPS = 32
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True


@dataclass
class Words:
    """Words of many texts: n of each text, trigram ids of their bytes with bounds, lexicon ids, and whether a word has a letter."""

    n: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    lexicon: np.ndarray
    affixes: np.ndarray  # [words, 2 * len(AFFIXES)]; 0 where the word is no longer than the affix
    letters: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    starts, ends, n = word_spans(data, offsets)
    low = _LOWER[data]
    before, after = np.empty_like(low), np.empty_like(low)
    before[1:], after[:-1] = low[:-1], low[1:]
    before[starts], after[ends - 1] = 32, 32
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    np.subtract.at(inside, ends, 1)
    at = np.flatnonzero(np.cumsum(inside[:-1]) > 0) if len(data) else np.zeros(0, np.int64)
    grams = (before[at] * np.uint32(0x9E3779B1)) ^ (low[at] * np.uint32(0x85EBCA6B)) ^ (after[at] * np.uint32(0xC2B2AE35))
    grams = ((grams * np.uint32(0x27D4EB2F)) >> np.uint32(32 - GRAM_BITS)).astype(np.int64)
    first = np.cumsum(ends - starts) - (ends - starts)
    letters = np.add.reduceat(_LETTER[data[at]].astype(np.int32), first) > 0 if len(first) else np.zeros(0, bool)
    lexicon = (word_hashes(data, starts, ends) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    letters &= _spelled(data, starts, ends, letters)
    size, affixes = ends - starts, np.zeros((len(starts), 2 * len(AFFIXES)), np.int64)
    for k, long in enumerate(AFFIXES):
        cut = np.minimum(size, long)
        for side, h in enumerate((word_hashes(data, starts, starts + cut), word_hashes(data, ends - cut, ends))):
            own = ((h ^ np.uint64(2 * k + side + 1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - GRAM_BITS)
            affixes[:, 2 * k + side] = np.where(size > long, np.maximum(1, own.astype(np.int64)), 0)
    return Words(n, starts, ends, grams, first, lexicon, affixes, letters)


def _spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """False for words whose only candidates for letters are characters beyond ASCII that are none, such as dashes and quotes."""
    out = np.ones(len(starts), bool)
    if len(starts) and (data >= 128).any():
        plain = np.concatenate([[0], np.cumsum(_LETTER[data] & (data < 128))])
        seen: dict[bytes, bool] = {}
        for i in np.flatnonzero(letters & (plain[ends] == plain[starts])).tolist():
            word = data[starts[i] : ends[i]].tobytes()
            if word not in seen:
                seen[word] = any(c.isalpha() for c in word.decode("utf-8", "replace"))
            out[i] = seen[word]
    return out


@dataclass
class Model:
    langs: list[str]
    gram: np.ndarray  # [2**GRAM_BITS, L]
    word: np.ndarray  # [2**WORD_BITS, L]
    affix: np.ndarray  # [2**GRAM_BITS, L], row 0 stays 0
    step: np.ndarray  # [L, L], log scores

    def emissions(self, w: Words) -> np.ndarray:
        if not len(w.first):
            return np.zeros((0, len(self.langs)), np.float32)
        e = np.add.reduceat(self.gram[w.grams], w.first, axis=0) + self.word[w.lexicon]
        for k in range(w.affixes.shape[1]):
            e += self.affix[w.affixes[:, k]]
        e[~w.letters] = 0
        return e


def forward_backward(e: np.ndarray, n: np.ndarray, step: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Posteriors [words, L] of chains with n words each, and with pairs the expected counts of steps [L, L]."""
    total, size = e.shape
    if not total:
        return e, np.zeros((size, size)) if pairs else None
    psi, t = np.exp(e - e.max(1, keepdims=True)).astype(np.float32), np.exp(step - step.max()).astype(np.float32)
    psi += 1e-8
    nb = -(-n // STEPS)
    blocks = int(nb.sum())
    first_block = np.cumsum(nb) - nb
    nth = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
    slot = (np.repeat(first_block, n) + nth // STEPS) * STEPS + nth % STEPS
    grid = np.zeros((blocks * STEPS, size), np.float32)
    grid[slot] = psi
    grid = grid.reshape(blocks, STEPS, size)
    real = np.zeros(blocks * STEPS, bool)
    real[slot] = True
    count = real.reshape(blocks, STEPS).sum(1)
    by = np.argsort(-count, kind="stable")  # blocks with most words first, so that step s takes a prefix
    grid, count = grid[by], count[by]
    whole = np.broadcast_to(np.eye(size, dtype=np.float32), (blocks, size, size)).copy()
    upto = [int(np.searchsorted(-count, -s, side="left")) for s in range(STEPS)]  # blocks with more than s words
    for s in range(STEPS):
        k = upto[s]
        if not k:
            break
        m = (whole[:k].reshape(-1, size) @ t).reshape(k, size, size) * grid[:k, s, None, :]
        whole[:k] = m / m.max((1, 2), keepdims=True)
    place = np.empty(blocks, np.int64)
    place[by] = np.arange(blocks)
    enter, leave = np.full((blocks, size), 1 / size, np.float32), np.ones((blocks, size), np.float32)
    long_first = np.argsort(-nb, kind="stable")
    most = nb[long_first]
    for k in range(1, int(nb.max()) if len(nb) else 0):  # block k of every text that has one
        docs = long_first[: int(np.searchsorted(-most, -k, side="left"))]
        b = place[first_block[docs] + k]
        a = place[first_block[docs] + k - 1]
        v = np.einsum("di,dij->dj", enter[a], whole[a])
        enter[b] = v / v.sum(1, keepdims=True)
    for k in range(int(nb.max()) - 2 if len(nb) else -1, -1, -1):
        docs = long_first[: int(np.searchsorted(-most, -(k + 1), side="left"))]
        b = place[first_block[docs] + k]
        c = place[first_block[docs] + k + 1]
        v = np.einsum("dij,dj->di", whole[c], leave[c])
        leave[b] = v / v.max(1, keepdims=True)
    alpha, beta = np.zeros_like(grid), np.zeros_like(grid)
    v = enter.copy()
    counts = np.zeros((size, size)) if pairs else None
    for s in range(STEPS):
        k = upto[s]
        if not k:
            break
        x = (v[:k] @ t) * grid[:k, s]
        v[:k] = x / x.sum(1, keepdims=True)
        alpha[:k, s] = v[:k]
    v = leave.copy()
    for s in range(STEPS - 1, -1, -1):
        k = upto[s]
        if not k:
            continue
        beta[:k, s] = v[:k]
        own = v[:k] * grid[:k, s]
        if pairs:
            prev = alpha[:k, s - 1] if s else enter[:k]
            z = ((prev @ t) * own).sum(1, keepdims=True)
            counts += ((prev / z).T @ own) * t
        x = own @ t.T
        v[:k] = x / x.max(1, keepdims=True)
    post = alpha * beta
    post /= np.maximum(post.sum(2, keepdims=True), 1e-30)
    out = np.empty_like(post)
    out[by] = post
    return out.reshape(blocks * STEPS, size)[slot], counts


def _fit(texts: list[bytes], y: np.ndarray, langs: list[str]) -> Model:
    size, rng = len(langs), np.random.default_rng(7)
    model = Model(langs, np.zeros((1 << GRAM_BITS, size), np.float32), np.zeros((1 << WORD_BITS, size), np.float32), np.zeros((1 << GRAM_BITS, size), np.float32), np.zeros((size, size), np.float32))
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    w = words_of(data, offsets)
    label = np.repeat(y, w.n)
    at = np.cumsum(w.n) - w.n
    chains = [np.arange(a, a + k) for a, k in zip(at, w.n, strict=True) if k]
    spliced = []
    for _ in range(len(chains) // 2):  # runs of 3 to 30 words of 2 to 6 documents
        runs = []
        for _ in range(int(rng.integers(2, 7))):
            c = chains[int(rng.integers(len(chains)))]
            i = int(rng.integers(len(c)))
            runs.append(c[i : i + int(rng.integers(3, 31))])
        spliced.append(np.concatenate(runs))
    chains += spliced
    square = [np.full_like(p, 1e-3) for p in (model.gram, model.word, model.affix, model.step)]
    length = w.ends - w.starts
    for _ in range(EPOCHS):
        order = rng.permutation(len(chains))
        for i in range(0, len(order), BATCH):
            own = [chains[j] for j in order[i : i + BATCH]]
            k, n = np.concatenate(own), np.array([len(c) for c in own])
            bytes_ = np.repeat(w.first[k] - (np.cumsum(length[k]) - length[k]), length[k]) + np.arange(length[k].sum())
            part = Words(n, w.starts[k], w.ends[k], w.grams[bytes_], np.cumsum(length[k]) - length[k], w.lexicon[k], w.affixes[k], w.letters[k])
            post, pairs = forward_backward(model.emissions(part), n, model.step, True)
            g = post.astype(np.float64)
            g[np.arange(len(k)), label[k]] -= 1
            g[~part.letters] = 0
            seen = np.zeros((size, size))
            inner = np.ones(len(k), bool)
            inner[np.cumsum(n) - n] = False
            np.add.at(seen, (label[k][:-1][inner[1:]], label[k][1:][inner[1:]]), 1)
            seen += np.bincount(label[k][~inner], minlength=size)[None, :] / size  # first words come from any
            of = np.repeat(np.arange(len(k)), length[k])
            grads = [np.stack([np.bincount(part.grams, g[of, c], 1 << GRAM_BITS) for c in range(size)], 1), np.stack([np.bincount(part.lexicon, g[:, c], 1 << WORD_BITS) for c in range(size)], 1)]
            sides = part.affixes.shape[1]
            grads.append(np.stack([np.bincount(part.affixes.reshape(-1), np.repeat(g[:, c], sides), 1 << GRAM_BITS) for c in range(size)], 1))
            grads[-1][0] = 0
            grads.append(pairs - seen)
            for p, q, d in zip((model.gram, model.word, model.affix, model.step), square, grads, strict=True):
                d = d / len(k) * 100 + 1e-4 * p
                q += d * d
                p -= (RATE * d / np.sqrt(q)).astype(np.float32)
    return model


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """docs (doc_id, text, lang): the model, fitted on sample_docs documents at most."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    ids = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    one = rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "lang")).alias("r"))  # sample_docs rows

    def excerpt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                words = text.split(" ")
                at = zlib.crc32(text.encode()) % max(1, len(words) - SAMPLE_WORDS + 1)
                out.append(" ".join(w[:SAMPLE_WORDS] for w in words[at : at + SAMPLE_WORDS]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), b.column(2)], names=["doc_id", "text", "lang"])

    got = one.select(F.col("doc_id").cast("bigint").alias("doc_id"), "r.text", "r.lang").mapInArrow(excerpt, "doc_id bigint, text string, lang string").toPandas().sort_values(["doc_id"])
    langs = sorted(got["lang"].unique())
    if not langs:
        return Model([], np.zeros((0, 0)), np.zeros((0, 0)), np.zeros((0, 0)), np.zeros((0, 0)))
    return _fit([t.encode() for t in got["text"]], np.searchsorted(langs, got["lang"]).astype(np.int64), langs)


def _each(model: Model, column: pa.Array) -> Iterator[tuple[Words, np.ndarray, np.ndarray]]:
    data, offsets = texts_of(column)
    for i, j in slices(offsets, 500_000):
        part = data[offsets[i] : offsets[j]]
        w = words_of(part, offsets[i : j + 1] - offsets[i])
        yield w, forward_backward(model.emissions(w), w.n, model.step)[0], part


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with _lang and _score; all columns pass through."""

    @F.pandas_udf("struct<lang string, score double>")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        column = pa.Array.from_pandas(texts, type=pa.string())
        lang, score = [], []
        if not model.langs:
            return pd.DataFrame({"lang": ["und"] * len(texts), "score": 0.0})
        for w, post, _ in _each(model, column):
            of = np.repeat(np.arange(len(w.n)), w.n)
            mass = np.stack([np.bincount(of, post[:, c] * w.letters, len(w.n)) for c in range(len(model.langs))], 1)
            all_ = mass.sum(1)
            lang += np.array(model.langs, object)[mass.argmax(1)].tolist()
            score += np.where(all_ > 0, mass.max(1) / np.maximum(all_, 1e-12), 0).tolist()
        for i, t in enumerate(column.to_pylist()):
            if score[i] == 0 or not t or not (t.isascii() or any(c.isalpha() for c in t)):
                lang[i], score[i] = "und", 0.0
        return pd.DataFrame({"lang": lang, "score": np.minimum(score, 1.0)})

    return docs.withColumn("_p", predicted("text")).withColumn("_lang", F.col("_p.lang")).withColumn("_score", F.col("_p.score")).drop("_p")


def label_words(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, word, start, end, lang, probability) of every word with a letter; start and end are byte offsets in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, row = b.column(0), 0
            for w, post, _ in _each(model, b.column(1)) if model.langs else ():
                of = np.repeat(np.arange(len(w.n)), w.n)
                own = np.flatnonzero(w.letters)
                best = post[own].argmax(1)
                base = np.zeros(len(w.n), np.int64)
                data, offsets = texts_of(b.column(1).slice(row, len(w.n)))
                base = offsets[:-1]
                nth = np.arange(len(of)) - np.repeat(np.cumsum(w.n) - w.n, w.n)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row + of[own])), pa.array(nth[own]), pa.array(w.starts[own] - base[of[own]]), pa.array(w.ends[own] - base[of[own]]), pa.array([model.langs[c] for c in best], pa.string()), pa.array(post[own, best].astype(float))], names=["doc_id", "word", "start", "end", "lang", "probability"])
                row += len(w.n)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, word bigint, start bigint, end bigint, lang string, probability double")


def op7_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(crc_mod("doc_id", 5) != 0))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))
