"""Near-duplicates against all pairs."""

import random

import numpy as np
import pytest
from helpers import DATA
from llm_brute import shingles

from railspan.llm import components, near_dedup

def brute(texts, k, percent=80):
    sets = {i: shingles(x, k) for i, x in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def found(frame, k):
    return {r[0]: tuple(r)[1:4] for r in near_dedup.link_components(frame, k).collect()}


@pytest.mark.parametrize("k", [4, 5])
def test_edge_cases(docs, k):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.link_components(docs, k).collect()]
    assert sorted(got, key=str) == sorted(by_rows(rows, k), key=str)


def test_empty_table(none):
    assert near_dedup.link_components(none).count() == 0


@pytest.mark.parametrize(("small", "block"), [(32, 512), (2, 3)])
def test_family_of_mutated_copies(spark, monkeypatch, small, block):
    """A large group whose members differ from the base by up to a third: most pairs are near the threshold."""
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(11)
    base = [f"w{rng.randrange(500)}" for _ in range(90)]
    texts = {}
    for i in range(90):
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = f"m{rng.randrange(10**6)}"
        texts[i] = " ".join(w)
    texts[200], texts[201] = texts[5], " ".join(base)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert found(frame, 4) == brute(texts, 4)


def test_driver_documents(spark):
    d = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    assert found(d, 4) == brute({r.doc_id: r.text for r in d.collect()}, 4)


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**64, 3000, dtype=np.uint64), rng.integers(0, 2**64, 500, dtype=np.uint64)
    union = np.unique(np.concatenate([a, b]))
    assert (near_dedup.merge_registers(near_dedup.registers(a), near_dedup.registers(b)) == near_dedup.registers(union)).all()
    est, keep = near_dedup.estimate(near_dedup.registers(a)[None], near_dedup.registers(union)[None], np.array([3000.0]), np.array([float(len(union))]), 0.8)
    assert abs(est[0] - 3000 / 3500) < 0.12 and keep[0]
    far, keep = near_dedup.estimate(near_dedup.registers(a)[None], near_dedup.registers(b)[None], np.array([3000.0]), np.array([500.0]), 0.8)
    assert far[0] < 0.1 and not keep[0]


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(100, 101)], "u long, v long")
    got = {r.node: r.comp for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(71)} | {100: 100, 101: 100}
    assert components.components(links.where("u < 0")).count() == 0


def by_rows(rows, k, percent=80):
    """Rows (doc_id, text), ids repeated or null: (doc_id, size, component) of each row by all pairs of rows."""
    sets = [shingles(x, k) for _, x in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc, len(sets[i]), (min(ids) if ids else None) if sets[i] else doc))
    return out


def words(seed, n=120):
    rng = random.Random(seed)
    return [f"v{rng.randrange(3000)}" for _ in range(n)]


def changed(w, *at):
    return " ".join("other" if i in at else x for i, x in enumerate(w))


def repeated_rows():
    a, b, c = words(1), words(2), words(3)
    return [(1, " ".join(a)), (1, " ".join(b)), (2, changed(a, 7)), (3, changed(b, 9)), (3, changed(b, 9)), (9, " ".join(c)), (None, changed(c, 50)), (None, " ".join(words(4))), (None, None), (None, ""), (6, None), (6, ""), (7, " ".join(a).upper()), (8, "lone words here"), (8, "lone words here")]


def test_repeated_and_null_ids(spark):
    rows = repeated_rows()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key = lambda r: tuple(str(x) for x in r)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.link_components(frame, 4).collect()), key=key)
    assert got == sorted(by_rows(rows, 4), key=key)
    left = near_dedup.one_of_each(frame.withColumn("_code", frame.doc_id)).collect()
    assert sorted(str((r.doc_id, r.text)) for r in left) == sorted(str(r) for r in [rows[0], rows[1], rows[5], rows[7], rows[8], rows[9], rows[10], rows[11], rows[13]])


def morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_that_cancel_in_polynomials_stay_apart(spark):
    one, two = morse(1024), morse(1024).translate(str.maketrans("ab", "ba"))
    tail = " and then some more words follow here"
    rows = [(1, one), (2, two), (3, one + tail), (4, two + tail), (5, one.upper())]
    got = {r.doc_id: r.component_id for r in near_dedup.link_components(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def test_exact_sets_survive_colliding_hashes(monkeypatch):
    texts = ["one two three four five", "one two three four six", "ONE two three four five", "x"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    honest = [len(x) for x in near_dedup.exact_sets(data, offsets, 4)]
    monkeypatch.setattr(near_dedup, "word_hashes", lambda d, s, e: np.ones(len(s), np.uint64))
    sets = near_dedup.exact_sets(data, offsets, 4)
    assert [len(x) for x in sets] == honest == [2, 2, 2, 1]
    assert set(sets[0].tolist()) == set(sets[2].tolist()) and len(set(sets[0].tolist()) & set(sets[1].tolist())) == 1
