"""Toxic passages by maximum-scoring segments (operator 3).

Training: the numbers of labelled documents that hold a token give log-odds with a Dirichlet prior (LEAST_PRIOR
for each token, and PRIOR documents spread by the token's share of both classes). Tokens and five-byte token
prefixes with |z| >= LEAST_Z make the model, the MODEL_ROWS strongest at most; the prefix serves words that
training did not show. At most SAMPLE_ROWS labelled rows are used, those of least hash: of ten parts, seven
for the log-odds and three for the calibration.

Scoring: tokens take their log-odds, all others a small negative drift. One linear scan (Ruzzo and Tompa)
over the running sum finds all disjoint maximal segments. A segment of score S in a text of n tokens has
the extreme-value expectation E = K n exp(-lambda S), lambda solving sum p(s) exp(lambda s) = 1 over the
scores of clean tokens, and K estimated by maximum likelihood from the best segments of clean calibration rows
(K n exp(-lambda S) of such a row is exponential with mean 1); segments with E <= LEAST_E are significant passages. A document's evidence is its
best segment's log(1 + 1/E) and its significant passages; a logistic curve fitted on the training rows maps it
to a probability.

Labels of a doc_id that contradict each other are left out, and where rows repeat a labelled doc_id one of their
texts trains. Repeated rows, null and repeated doc_ids are scored row by row. Null, empty and wordless texts have
no segment and the score of no evidence. Without labels of both
classes every score is the share of label 1 (0 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_ALNUM, crc_mod, mix64, slices, small_batches, table, texts_of, word_hashes, word_spans, written

SAMPLE_ROWS = 24_000
MODEL_ROWS = 50_000
LEAST_Z = 3.0
PRIOR = 100.0
LEAST_PRIOR = 0.5
PREFIX = 5
LEAST_E = 0.01
DRIFT = -0.1
CLIP = 8.0
THRESHOLD = 0.3
_SALT = np.uint64(0xA5A5F00DCAFE1234)


@dataclass
class Model:
    keys: np.ndarray
    scores: np.ndarray
    lam: float
    k: float
    curve: np.ndarray  # weights of (1, evidence, passages)
    rate: float


def _tokens(data: np.ndarray, offsets: np.ndarray):
    starts, ends, n = word_spans(data, offsets, NOT_ALNUM)
    words = word_hashes(data, starts, ends)
    heads = mix64(word_hashes(data, starts, np.minimum(ends, starts + PREFIX)) ^ _SALT)
    heads[ends - starts <= PREFIX] = 0
    return starts, ends, n, words, heads


def _counts(rows: DataFrame) -> DataFrame:
    """(text, y) -> (kind, h, y1, y0): texts of either label that hold the token; repeats within a text count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = texts_of(b.column(0))
            y = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j in slices(offsets):
                _, _, n, words, heads = _tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                doc = np.repeat(np.arange(j - i), n)
                for kind, h in ((0, words), (1, heads)):
                    order = np.lexsort((doc, h))
                    hs, ds = h[order], doc[order]
                    once = np.concatenate([[True], (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])]) & (hs != 0)
                    key, at = np.unique(hs[once], return_inverse=True)
                    y1 = np.bincount(at, y[i:j][ds[once]], len(key)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key.view(np.int64)), pa.array(y1), pa.array(np.bincount(at, minlength=len(key)) - y1)], names=["kind", "h", "y1", "y0"])

    return rows.mapInArrow(run, "kind int, h bigint, y1 bigint, y0 bigint").groupBy("kind", "h").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0"))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a score sequence, in linear time. Runs without a positive score are skipped by their running sum."""
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    found: list[list] = []  # start, end, sum before, sum after
    for p in up.tolist():
        own = [p, p + 1, total[p], total[p + 1]]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= own[2]:
                j -= 1
            if j < 0 or found[j][3] >= own[3]:
                break
            own = [found[j][0], own[1], found[j][2], own[3]]
            del found[j:]
        found.append(own)
    return [(a, b, float(after - before)) for a, b, before, after in found]


def _lookup(model: Model, words: np.ndarray, heads: np.ndarray) -> np.ndarray:
    out = np.full(len(words), DRIFT, np.float32)
    if not len(model.keys):
        return out
    for h in (heads, words):  # the word's own score replaces its prefix's
        at = np.minimum(np.searchsorted(model.keys, h), len(model.keys) - 1)
        hit = model.keys[at] == h
        out[hit] = model.scores[at[hit]]
    return out


def _evidence(model: Model, scores: np.ndarray) -> tuple[float, list[tuple[int, int, float, float]]]:
    """log(1 + 1 / E) of the best segment, 0 without one, and the significant passages with their E."""
    found = segments(scores)
    if not found:
        return 0.0, []
    e = [(a, b, s, float(model.k * len(scores) * np.exp(-min(700.0, model.lam * s)))) for a, b, s in found]
    return float(np.log1p(1 / max(1e-300, min(x[3] for x in e)))), [x for x in e if x[3] <= LEAST_E]


def _each(model: Model, column: pa.Array) -> Iterator[tuple[float, list, np.ndarray, np.ndarray, int]]:
    data, offsets = texts_of(column)
    for i, j in slices(offsets):
        starts, ends, n, words, heads = _tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        scores, at = _lookup(model, words, heads), np.concatenate([[0], np.cumsum(n)])
        ups = np.concatenate([[0], np.cumsum(scores > 0)])
        for r in range(j - i):
            a, b = at[r], at[r + 1]
            got = _evidence(model, scores[a:b]) if ups[b] > ups[a] else (0.0, [])
            yield *got, starts[a:b], ends[a:b], int(offsets[i + r] - offsets[i])


def _scored(model: Model, column: pa.Array) -> Iterator[tuple[list, np.ndarray]]:
    """All maximal segments of each text, with the starts of its tokens."""
    data, offsets = texts_of(column)
    for i, j in slices(offsets):
        starts, _, n, words, heads = _tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        scores, at = _lookup(model, words, heads), np.concatenate([[0], np.cumsum(n)])
        for a, b in zip(at, at[1:], strict=False):
            yield [(x, z, s, 0.0) for x, z, s in segments(scores[a:b])], starts[a:b]


def _probability(model: Model, evidence: np.ndarray, passages: np.ndarray) -> np.ndarray:
    x = np.stack([np.ones(len(evidence)), np.minimum(evidence, 60) / 10, np.minimum(passages, 10)], 1)
    return 1 / (1 + np.exp(-np.clip(x @ model.curve, -30, 30)))


def _logistic(x: np.ndarray, t: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Ridge logistic regression by damped Newton steps; slopes are held at 0 at least, so evidence never lowers a score."""

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - t @ z + ridge / 2 * w @ w)

    w = np.zeros(x.shape[1])
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        g = x.T @ (q - t) + ridge * w
        step, size = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(w)), g), 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(step).max() * size < 1e-8:
            break
    return np.concatenate([w[:1], np.maximum(w[1:], 0)])


def _fitted_k(model: Model, clean: DataFrame) -> float:
    """K = rows / sum(n exp(-lambda S)) over clean rows with a token, S their best segment; as if one token without a segment were seen too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [(len(starts), max((s for _, _, s, _ in found), default=0.0)) for found, starts in _scored(model, b.column(0))]
            x = [n * float(np.exp(-min(700.0, model.lam * s))) for n, s in each if n]
            yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int64()), pa.array([float(sum(x))])], names=["n", "x"])

    got = clean.mapInArrow(run, "n bigint, x double").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).first()
    return ((got["n"] or 0) + 1) / ((got["x"] or 0.0) + 1)


def training_rows(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, text, y): a row for each of the labelled doc_ids of least hash, most at most. Contradicting labels are left out; of several texts of a doc_id the one of least hash stays."""
    y = labels.where("y is not null and doc_id is not null").groupBy("doc_id").agg(F.min("y").cast("int").alias("y"), F.max("y").alias("z")).where("y = z").select("doc_id", "y")
    sample = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # most rows are broadcast
    one = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "y")).alias("r"))
    return written(one.select("doc_id", "r.text", "r.y"), "training")


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """docs (doc_id, text), labels (doc_id, y 0/1): the model. What reaches the driver is bounded by MODEL_ROWS and sample_rows."""
    rows = training_rows(docs, labels, sample_rows).select("text", "y", (F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(10)) < 7).alias("fit"))
    counts = written(_counts(rows.where("fit").select("text", "y")), "tokens")
    sums = {r["kind"]: (float(r["a"]), float(r["b"])) for r in counts.groupBy("kind").agg(F.sum("y1").alias("a"), F.sum("y0").alias("b")).collect()}
    n1, n0 = sums.get(0, (0.0, 0.0))
    empty = Model(np.zeros(0, np.uint64), np.zeros(0, np.float32), 1.0, 1.0, np.array([-30.0, 0, 0]), 0.0)
    y = rows.agg(F.avg("y").alias("y")).first()["y"]
    if not n1 or not n0:
        empty.curve[0] = np.log(max(1e-12, y or 0) / max(1e-12, 1 - (y or 0)))
        return empty
    a = LEAST_PRIOR + PRIOR * (F.col("y1") + F.col("y0")) / (n1 + n0)
    delta = F.log((F.col("y1") + a) / (n1 + PRIOR - F.col("y1") - a)) - F.log((F.col("y0") + a) / (n0 + PRIOR - F.col("y0") - a))
    z = delta / F.sqrt(1 / (F.col("y1") + a) + 1 / (F.col("y0") + a))
    kept = counts.withColumn("d", delta).withColumn("z", z).where(F.abs("z") >= LEAST_Z).orderBy(F.abs("z").desc(), "kind", "h").limit(MODEL_ROWS).select("kind", "h", "d", "y0").toPandas().sort_values("h", key=lambda s: s.to_numpy(np.int64).view(np.uint64))
    keys, d = kept["h"].to_numpy(np.int64).view(np.uint64), np.clip(kept["d"].to_numpy(float), -CLIP, CLIP)
    # clean tokens by score, with half a token more for each positive key
    own = (kept["kind"] == 0).to_numpy()
    share = np.where(d > 0, (kept["y0"].to_numpy(float) * own + 0.5) / n0, kept["y0"].to_numpy(float) * own / n0)
    s, p = np.concatenate([d, [DRIFT]]), np.concatenate([share, [max(1e-6, 1 - share.sum())]])
    p /= p.sum()
    lo, hi = 1e-4, 20.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (p * np.exp(np.clip(mid * s, -700, 700))).sum() < 1 else (lo, mid)
    model = Model(keys, d.astype(np.float32), max(lo, 0.1), 1.0, np.zeros(3), float(y))
    model.k = _fitted_k(model, rows.where("not fit and y = 0").select("text"))

    # calibrate on the training rows that the log-odds have not seen
    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(e, len(found)) for e, found, *_ in _each(model, b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.float64()), pa.array([x[1] for x in got], pa.int32()), b.column(1)], names=["e", "m", "y"])

    got = rows.where("not fit").select("text", "y").mapInArrow(evidence, "e double, m int, y int").toPandas()
    x = np.stack([np.ones(len(got)), np.minimum(got["e"].to_numpy(), 60) / 10, np.minimum(got["m"].to_numpy(), 10)], 1)
    model.curve = _logistic(x, got["y"].to_numpy(float))
    return model


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """Every significant passage: (doc_id, passage, start, end, tokens, score, e_value); start and end are byte offsets in the text's UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, (_, found, starts, ends, base) in zip(b.column(0).to_pylist(), _each(model, b.column(1)), strict=True):
                out += [(doc, i, int(starts[a]) - base, int(ends[z - 1]) - base, z - a, s, e) for i, (a, z, s, e) in enumerate(found)]
            cols = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()], strict=True)], names=["doc_id", "passage", "start", "end", "tokens", "score", "e_value"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, passage int, start bigint, end bigint, tokens bigint, score double, e_value double")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with _score and _passages; all columns pass through."""

    @F.pandas_udf("struct<score double, passages int>")
    def scored(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        got = [(e, len(found)) for e, found, *_ in _each(model, pa.Array.from_pandas(texts, type=pa.string()))]
        e, m = np.array([x[0] for x in got], float), np.array([x[1] for x in got], np.int32)
        return pd.DataFrame({"score": _probability(model, e, m), "passages": m})

    return docs.withColumn("_toxic", scored("text")).withColumn("_score", F.col("_toxic.score")).withColumn("_passages", F.col("_toxic.passages")).drop("_toxic")


def labelled(spark: SparkSession, sf_dir: str, column: str, k: int, held: int) -> DataFrame:
    """(doc_id, y) of the rows that training may see."""
    return table(spark, sf_dir, "labels").where(crc_mod("doc_id", k) != held).select("doc_id", F.col(column).alias("y"))


def op3_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, labelled(spark, sf_dir, "toxic", 4, 2))
    out = score(docs, model)
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"), F.col("_passages").alias("n_passages"))
