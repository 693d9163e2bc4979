"""Token files and packing: against the library on whole texts, and exact round trips."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from railspan.llm import packing, token_blocks, vocab
from railspan.llm.common import fresh_path


def whole(name, texts, end):
    t = Tokenizer.from_file(P.path(name))
    t.encode_special_tokens = True
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, end], np.uint32) for x in texts]


@pytest.mark.parametrize(("name", "lower"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
@given(texts=st.lists(st.text(alphabet=st.sampled_from(list(" \n\t\r.,!'’aAbBzéÉßǅİΣς日🙂0９5-_|  ́‍\x1c")), max_size=40), max_size=6))
@settings(max_examples=150, deadline=None)
def test_pieces_equal_the_whole_pipeline(name, lower, texts):
    enc = vocab.encoder(P.path(name), lower)
    ids, n = enc.encode([x.encode() for x in texts])
    assert n.sum() == len(ids)
    at = 0
    for x, k, want in zip(texts, n, whole(name, texts, 0), strict=True):
        assert ids[at : at + k].tolist() == want[:-1].tolist(), repr(x)
        at += k


def test_full_memo(monkeypatch):
    monkeypatch.setattr(vocab, "MEMO", 50)
    monkeypatch.setattr(vocab, "CORE", 10)
    enc = vocab.Encoder(P.path("byte_bpe_50k.json"), False)
    for k in range(5):
        texts = [f"the word{k}x{i} and w{k}{i}, the end" for i in range(30)]
        ids, n = enc.encode([x.encode() for x in texts])
        assert ids.tolist() == [i for w in whole("byte_bpe_50k.json", texts, 0) for i in w[:-1].tolist()]


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=700))
@settings(max_examples=80, deadline=None)
def test_segment_round_trip(values):
    ids = np.array(values, np.uint32)
    data = token_blocks.pack_segment(ids)
    assert (token_blocks.unpack_segment(data) == ids).all()
    for b in range(-(-len(ids) // token_blocks.BLOCK)):
        assert (token_blocks.unpack_segment(data, b) == ids[b * 128 : b * 128 + 128]).all()


def test_files_hold_every_document_in_order(spark, docs):
    files = token_blocks.write_ids(docs, fresh_path(spark, "t"), P.path("word_bpe_49k.json"), 2, True).collect()
    got = []
    for f in sorted(files, key=lambda f: f.part):
        held = []
        for doc, ids, last in token_blocks.read_file(f.path):
            held.append(ids)
            if last:
                got.append((doc, np.concatenate(held).tobytes()))
                held = []
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = [(i, ids.tobytes()) for (i, _), ids in zip(rows, whole("word_bpe_49k.json", [x for _, x in rows], 2), strict=True)]
    order = [first_nulls(i) for i, _ in got]
    assert order == sorted(order) and Counter(got) == Counter(want)


def first_nulls(i):
    return (i is not None, i or 0)


def test_op8(spark, folder, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = Counter((i, len(ids), zlib.crc32(ids.tobytes())) for (i, _), ids in zip(rows, whole("word_bpe_49k.json", [x for _, x in rows], 2), strict=True))
    out = sorted(token_blocks.op8_pfor_ids(spark, folder).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == want
    assert [r.start for r in out] == [sum(r.n_tokens for r in out[:k]) for k in range(len(out))]
    order = [first_nulls(r.doc_id) for r in out]
    assert order == sorted(order)
    again = sorted(token_blocks.op8_pfor_ids(spark, folder).collect(), key=lambda r: r.start)
    assert again == out  # ties have a defined order


def check_packing(rows, want):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    pieces = []
    for i, ids in want:
        n = -(-len(ids) // 2048)
        ends = [len(ids) - 2048 * (n - 1 - k) for k in range(n)]  # only the first may be shorter
        pieces += [(i, k, a, z - a, zlib.crc32(ids[a:z].tobytes())) for k, (a, z) in enumerate(zip([0, *ends], ends, strict=False))]
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == Counter(pieces)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    return len(by_sequence)


def test_op9(spark, folder, docs):
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    want = list(zip([i for i, _ in texts], whole("byte_bpe_50k.json", [x for _, x in texts], 0), strict=True))
    n = check_packing(packing.op9_pattern_packing(spark, folder).collect(), want)
    assert n <= 1.05 * -(-sum(len(x) for _, x in want) // 2048) + 1


def test_empty_tables(spark, none):
    cut = packing.pieces(none, P.path("byte_bpe_50k.json"), 0)
    assert packing.pack(cut).count() == 0
    assert token_blocks.write_ids(none, fresh_path(spark, "t"), P.path("word_bpe_49k.json"), 2, True).count() == 0


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=40))
@settings(max_examples=40, deadline=None)
def test_plan_uses_the_histogram_exactly(histogram):
    got, total = {}, 0
    for pattern, n in packing.plan(histogram, 64, 200):
        assert sum(pattern) <= 64 and n > 0
        total += n
        for k in pattern:
            got[k] = got.get(k, 0) + n
    assert got == histogram
    tokens = sum(k * v for k, v in histogram.items())
    assert total <= 2 * (-(-tokens // 64)) + 1


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(2)
    lengths, n = np.unique(np.clip(rng.lognormal(6.3, 0.9, 20_000).astype(int) + 1, 1, 2048), return_counts=True)
    plan = packing.plan(dict(zip(lengths.tolist(), n.tolist(), strict=True)))
    assert sum(x for _, x in plan) <= 1.01 * (lengths * n).sum() / 2048 + 1
