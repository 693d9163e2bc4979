"""Document quality by attention-based multiple-instance learning (operator 4).

A document is a bag of passages of PASSAGE words. A passage is a vector of style features: shares of pairs
of byte classes, word length, words equal to the one before, and distinct words. An encoder e = tanh(W x)
and gated attention a = softmax(w . (tanh(V e) * sigmoid(U e))) are learned from document labels alone, by
Adam on the log loss; the score is a logistic function of the attention-weighted passage vector.

At most SAMPLE_DOCS labelled documents are used for fitting, those of least hash, each with BAG passages at most,
drawn by a hash from its whole text; every document is scored over its whole text. Rows with a repeated or null
doc_id are scored row by row. Null, empty and wordless texts are one passage of zeros.
Without labels of both classes every score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, slices, small_batches, table, texts_of, word_hashes, word_spans
from .toxicity import THRESHOLD, labelled, training_rows

PASSAGE = 64
HIDDEN, GATE = 24, 16
SAMPLE_DOCS, BAG = 4000, 256
EPOCHS, BATCH, RATE, DECAY = 12, 128, 0.01, 1e-4

_GROUPS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", "\t\r\x0b\x0c", ".", ",", "!", "?", "'\"", "|", "#*$%&", "<>"]
_CLASS = np.full(256, 15, np.int64)
_CLASS[:128] = 14
for _i, _g in enumerate(_GROUPS):
    for _c in _g:
        _CLASS[ord(_c)] = _i
#: Pairs of byte classes, then word length, words equal to the one before, distinct words, words of the passage.
WIDTH = 256 + 4


def passage_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[passages, WIDTH] and the passages of each text (one at least)."""
    starts, ends, n_words = word_spans(data, offsets)
    n = np.maximum(1, -(-n_words // PASSAGE))
    first = np.cumsum(n) - n
    doc = np.repeat(np.arange(len(n)), n_words)
    nth = np.arange(len(starts)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    of = first[doc] + nth // PASSAGE
    total = int(n.sum())
    x = np.zeros((total, WIDTH), np.float32)
    if len(starts):
        # bytes belong to the passage of the word that they follow or stand in
        heads = starts[nth % PASSAGE == 0]
        owner = of[nth % PASSAGE == 0]
        spans = np.diff(np.append(heads, len(data)))
        kind = _CLASS[data[heads[0] :]]
        pair = kind[:-1] * 16 + kind[1:]
        at = np.repeat(owner, spans)[:-1]
        counts = np.bincount(at * 256 + pair, minlength=total * 256)[: total * 256].reshape(total, 256)
        x[:, :256] = np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True)))
        h = word_hashes(data, starts, ends)
        words = np.bincount(of, minlength=total)
        some = np.maximum(1, words)
        same = np.concatenate([[False], (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])])
        order = np.lexsort((h, of))
        fresh = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])])
        x[:, 256] = np.bincount(of, ends - starts, total) / some / 10
        x[:, 257] = np.bincount(of, same, total) / some
        x[:, 258] = np.bincount(of[order], fresh, total) / some
        x[:, 259] = words / PASSAGE
    return x, n


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]
    rate: float

    def forward(self, x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, dict]:
        w, at = self.w, np.cumsum(n) - n
        e = np.tanh((x - self.mean) * self.scale @ w["W"] + w["b"])
        t, g = np.tanh(e @ w["V"]), 1 / (1 + np.exp(-(e @ w["U"])))
        s = (t * g) @ w["a"]
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, at), n))
        a = s / np.repeat(np.add.reduceat(s, at), n)
        z = np.add.reduceat(a[:, None] * e, at)
        return 1 / (1 + np.exp(-(z @ w["c"] + w["d"][0]))), {"e": e, "t": t, "g": g, "a": a, "z": z}

    def gradients(self, x: np.ndarray, n: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Slopes of the mean log loss of bags with n passages each."""
        w, at = self.w, np.cumsum(n) - n
        p, k = self.forward(x, n)
        dl = ((p - y) / len(n)).astype(w["c"].dtype)
        dz = np.repeat(dl[:, None] * w["c"], n, axis=0)
        da = (dz * k["e"]).sum(1)
        ds = k["a"] * (da - np.repeat(np.add.reduceat(k["a"] * da, at), n))
        dt, dg = ds[:, None] * w["a"] * k["g"] * (1 - k["t"] ** 2), ds[:, None] * w["a"] * k["t"] * k["g"] * (1 - k["g"])
        dh = (k["a"][:, None] * dz + dt @ w["V"].T + dg @ w["U"].T) * (1 - k["e"] ** 2)
        return {"W": ((x - self.mean) * self.scale).T @ dh, "b": dh.sum(0), "V": k["e"].T @ dt, "U": k["e"].T @ dg, "a": (k["t"] * k["g"]).T @ ds, "c": k["z"].T @ dl, "d": dl.sum(keepdims=True)}

    def score(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.forward(x, n)[0] if self.w else np.full(len(n), self.rate)


def _fit(x: np.ndarray, n: np.ndarray, y: np.ndarray) -> Model:
    rng = np.random.default_rng(4)
    mean, scale = x.mean(0), 1 / (x.std(0) + 0.02)
    model = Model(mean, scale, {}, float(y.mean()) if len(y) else 0.5)
    if not len(y) or y.min() == y.max():
        return model
    init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    model.w = {"W": init(WIDTH, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": init(HIDDEN, GATE), "U": init(HIDDEN, GATE), "a": init(GATE), "c": init(HIDDEN), "d": np.zeros(1, np.float32)}
    first = np.concatenate([[0], np.cumsum(n)])
    m1 = {k: np.zeros_like(v) for k, v in model.w.items()}
    m2 = {k: np.zeros_like(v) for k, v in model.w.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for i in range(0, len(y), BATCH):
            docs = order[i : i + BATCH]
            nb = n[docs]
            rows = np.repeat(first[docs] - (np.cumsum(nb) - nb), nb) + np.arange(nb.sum())
            w, grads = model.w, model.gradients(x[rows], nb, y[docs])
            step += 1
            for name, g in grads.items():
                g = g + DECAY * w[name]
                m1[name] = 0.9 * m1[name] + 0.1 * g
                m2[name] = 0.99 * m2[name] + 0.01 * g * g
                w[name] = (w[name] - RATE * (m1[name] / (1 - 0.9**step)) / (np.sqrt(m2[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """docs (doc_id, text), labels (doc_id, y 0/1). At most sample_docs documents reach the driver, as features of BAG passages each."""
    rows = training_rows(docs, labels, sample_docs)

    def drawn(x: np.ndarray) -> np.ndarray:
        if len(x) <= BAG:
            return x
        return x[np.sort(np.random.default_rng(len(x)).choice(len(x), BAG, replace=False))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = texts_of(b.column(1))
            for i, j in slices(offsets, 1_000_000):
                x, n = passage_features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                at = np.concatenate([[0], np.cumsum(n)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array([drawn(x[p:q]).astype(np.float16).tobytes() for p, q in zip(at, at[1:], strict=False)], pa.binary())], names=["doc_id", "y", "x"])

    got = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "y").mapInArrow(run, "doc_id bigint, y int, x binary").toPandas().sort_values(["doc_id", "x"])
    each = [np.frombuffer(v, np.float16).reshape(-1, WIDTH) for v in got["x"]]
    x = np.concatenate(each).astype(np.float32) if each else np.zeros((1, WIDTH), np.float32)
    return _fit(x, np.array([len(e) for e in each], np.int64), got["y"].to_numpy(np.float32))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with _score; all columns pass through."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        data, offsets = texts_of(pa.Array.from_pandas(texts, type=pa.string()))
        out = [model.score(*passage_features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])) for i, j in slices(offsets, 1_000_000)]
        return pd.Series(np.concatenate(out).astype(np.float64) if out else np.zeros(0))

    return docs.withColumn("_score", scored("text"))


def op4_attention_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, labelled(spark, sf_dir, "quality", 5, 0)))
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))
