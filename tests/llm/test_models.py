"""Toxicity, quality and language models: brute force of the exact parts, held-out accuracy of the learned ones."""

import math

import numpy as np
import pytest
from helpers import DATA
from llm_brute import all_segments
from pyspark.sql import functions as F

from railspan.llm import language_crf, quality_model, toxicity


def test_segments_equal_brute_force():
    rng = np.random.default_rng(6)
    for n in [0, 1, 2, 5, 20, 40] * 10:
        scores = rng.integers(-7, 6, n) + rng.integers(0, 1000, n) / 1009
        got = toxicity.segments(scores)
        want = all_segments(scores.tolist())
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_forward_backward_equals_brute_force():
    rng = np.random.default_rng(0)
    n = np.array([3, 70, 1, 0, 33, 64])
    e, step = rng.standard_normal((n.sum(), 3)).astype(np.float32), rng.standard_normal((3, 3)).astype(np.float32)
    post, pairs = language_crf.forward_backward(e, n, step, True)
    at = 0
    for k in n:
        x, t = np.exp(e[at : at + k].astype(float)), np.exp(step.astype(float))
        a, ahead = np.full(3, 1 / 3), []
        for i in range(k):
            a = (a @ t) * x[i]
            a /= a.sum()
            ahead.append(a)
        b = np.ones(3)
        for i in range(k - 1, -1, -1):
            p = ahead[i] * b
            assert np.allclose(post[at + i], p / p.sum(), atol=1e-5)
            b = t @ (x[i] * b)
            b /= b.max()
        at += k
    assert pairs.sum() == pytest.approx(n.sum(), rel=1e-5)


def small_mil(seed, bags=7):
    rng = np.random.default_rng(seed)
    n = rng.integers(1, 5, bags)
    w = {k: rng.standard_normal(shape) * 0.5 for k, shape in {"W": (6, 4), "b": (4,), "V": (4, 3), "U": (4, 3), "a": (3,), "c": (4,), "d": (1,)}.items()}
    return quality_model.Model(rng.standard_normal(6), 1 + rng.random(6), w, 0.5), rng.standard_normal((n.sum(), 6)), n, rng.integers(0, 2, bags).astype(float)


def attention_by_hand(model, bag):
    """One bag's score, passage by passage."""
    w, gates, codes = model.w, [], []
    for x in bag:
        e = [math.tanh(sum((x[i] - model.mean[i]) * model.scale[i] * w["W"][i, j] for i in range(len(x))) + w["b"][j]) for j in range(len(w["b"]))]
        s = 0.0
        for g in range(len(w["a"])):
            s += w["a"][g] * math.tanh(sum(e[j] * w["V"][j, g] for j in range(len(e)))) / (1 + math.exp(-sum(e[j] * w["U"][j, g] for j in range(len(e)))))
        gates.append(s)
        codes.append(e)
    total = sum(math.exp(s) for s in gates)
    z = [sum(math.exp(s) / total * e[j] for s, e in zip(gates, codes, strict=True)) for j in range(len(w["c"]))]
    return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(z, w["c"], strict=True)) + w["d"][0])))


def test_attention_equals_brute_force():
    model, x, n, _ = small_mil(1)
    ends = np.cumsum(n)
    assert np.allclose(model.score(x, n), [attention_by_hand(model, x[e - k : e]) for e, k in zip(ends, n, strict=True)])


def test_attention_gradient_is_the_slope():
    model, x, n, y = small_mil(2)

    def loss():
        p = model.forward(x, n)[0]
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    for name, g in model.gradients(x, n, y).items():
        flat, got = model.w[name].reshape(-1), g.reshape(-1)
        for i in range(len(flat)):
            here = flat[i]
            flat[i] = here + 1e-6
            up = loss()
            flat[i] = here - 1e-6
            down = loss()
            flat[i] = here
            assert (up - down) / 2e-6 == pytest.approx(got[i], abs=1e-6), name


def test_attention_finds_the_telling_passage():
    rng = np.random.default_rng(3)
    n = rng.integers(1, 6, 200)
    y = rng.integers(0, 2, 200).astype(np.float32)
    x = rng.standard_normal((n.sum(), quality_model.WIDTH)).astype(np.float32) * 0.1
    x[np.cumsum(n) - n, 7] += 3 * y  # one passage of a bag tells
    model = quality_model._fit(x, n, y)
    assert ((model.score(x, n) > 0.5) == y).mean() > 0.97
    a = model.forward(x, n)[1]["a"]
    assert np.allclose(np.add.reduceat(a, np.cumsum(n) - n), 1)


def test_k_is_the_exponential_estimate(spark):
    """K n exp(-lambda S) has mean 1 over clean rows."""
    model = toxicity.Model(np.zeros(0, np.uint64), np.zeros(0, np.float32), 0.5, 1.0, np.zeros(3), 0.0)
    clean = spark.createDataFrame([("one two three",), ("four",), ("",), (None,)], "text string")
    assert toxicity._fitted_k(model, clean) == pytest.approx(3 / 5)  # (2 rows + 1) / (3 + 1 tokens + 1)


def test_training_rows_are_bounded_and_agree(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "c"), (3, None), (None, "d"), (4, "e")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (3, 0), (None, 1), (5, 1)], "doc_id long, y int")
    got = toxicity.training_rows(docs, labels, 10).collect()
    assert sorted((r.doc_id, r.y) for r in got) == [(1, 1), (3, 0)]
    assert len(toxicity.training_rows(docs, labels, 1).collect()) == 1


def accuracy(frame, truth, held, predicted, column):
    r = frame.join(truth, "doc_id").where(held).select(predicted, column).toPandas()
    return (r[predicted] == r[column]).mean(), len(r)


def test_held_out_accuracy(spark):
    folder = f"{DATA}/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    share, n = accuracy(quality_model.op4_attention_mil(spark, folder), labels, "held_out", "predicted", "quality")
    assert n > 40 and share > 0.95
    langs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    share, n = accuracy(language_crf.op7_language_crf(spark, folder), langs, "held_out", "lang_pred", "lang")
    assert n > 100 and share > 0.97
    r = toxicity.op3_toxic_segments(spark, folder).join(labels, "doc_id").where("held_out and toxic is not null").select("predicted", "toxic", "score").toPandas()
    toxic, clean = r[r["toxic"] == 1], r[r["toxic"] == 0]
    assert len(toxic) > 8 and len(clean) > 50
    assert toxic["predicted"].mean() > 0.5 and clean["predicted"].mean() < 0.03  # never or always saying toxic fails
    above = (toxic["score"].to_numpy()[:, None] > clean["score"].to_numpy()[None, :]).mean() + (toxic["score"].to_numpy()[:, None] == clean["score"].to_numpy()[None, :]).mean() / 2
    assert above > 0.75


def test_edge_cases(spark, folder, docs, none):
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    key = lambda v: (v is not None, v or 0)
    for op in (toxicity.op3_toxic_segments, quality_model.op4_attention_mil, language_crf.op7_language_crf):
        out = op(spark, folder).collect()
        assert sorted((r.doc_id for r in out), key=key) == sorted(ids, key=key)
        assert all(0 <= r.score <= 1 and not math.isnan(r.score) for r in out)
    lang = {r.doc_id: r for r in language_crf.op7_language_crf(spark, folder).collect()}
    for i in (0, 1, 2, 6):  # null, empty, blank, no letter
        assert (lang[i].lang_pred, lang[i].score) == ("und", 0.0)
    assert lang[7].lang_pred != "und"


def test_marks_beyond_ascii_are_no_letters():
    texts = ["— … «»", "été —", "日本", "abc"]
    raw = [t.encode() for t in texts]
    w = language_crf.words_of(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    assert w.letters.tolist() == [False, False, False, True, False, True, True]
    assert (w.affixes[-1] > 0).tolist() == [True, True, False, False, False, False]


def test_without_labels_or_rows(spark, docs, none):
    labels = spark.createDataFrame([], "doc_id long, y int")
    model = toxicity.train(docs, labels)
    assert toxicity.score(docs, model).where("_score > 1e-6").count() == 0
    assert toxicity.passages(docs, model).count() == 0
    assert toxicity.score(none, model).count() == 0
    assert quality_model.score(docs, quality_model.train(docs, labels)).agg(F.max("_score")).first()[0] == 0.5
    assert quality_model.score(none, quality_model.train(none, labels)).count() == 0
    model = language_crf.train(none)
    assert {r["_lang"] for r in language_crf.predict(docs, model).collect()} == {"und"}
    assert language_crf.label_words(docs, model).count() == 0


def test_passages_point_into_the_text(spark):
    good, bad = "the quiet river runs to the sea ", "you stupid moron "
    docs = spark.createDataFrame([(i, good * 6 + (bad * 3 if i % 3 == 0 else "") + good * 4) for i in range(300)], "doc_id long, text string")
    model = toxicity.train(docs, docs.selectExpr("doc_id", "cast(doc_id % 3 = 0 as int) as y"))
    got = toxicity.passages(docs, model).collect()
    assert {r.doc_id for r in got} == set(range(0, 300, 3))
    text = (good * 6 + bad * 3 + good * 4).encode()
    assert all(set(text[r.start : r.end].decode().split()) & {"stupid", "moron", "you"} for r in got)


def test_word_labels_of_switched_text(spark):
    d = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    model = language_crf.train(d, 300)
    en, de = (d.where(f"lang = '{x}' and length(text) > 900").orderBy("doc_id").first()["text"].split() for x in ("en", "de"))
    en, de = ([w for w in x if any(c.isalpha() for c in w)][:40] for x in (en, de))  # words without a letter have no label
    one = spark.createDataFrame([(1, " ".join(en + de))], "doc_id long, text string")
    got = [r.lang for r in language_crf.label_words(one, model).orderBy("word").collect()]
    assert sum(x == "en" for x in got[:40]) >= 34 and sum(x == "de" for x in got[40:]) >= 34
