"""Audio round trips, shard stores, and the pipeline."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

import corpus_pipeline
from helpers import duck
from llm_brute import all_segments, shingles
from railspan.llm import audio, mixing, quality_rules, shards, toxicity
from railspan.llm.common import fresh_path
from railspan.llm.shards import Conflict, ShardStore


def test_op1_round_trip(spark, folder, docs):
    out = audio.op1_audio_features(spark, folder).collect()
    want, feature = Counter(), {}
    for r in docs.collect():
        x = (r.text or "").encode()
        payload = x + b"\xff" * (max(1, -(-len(x) // 576)) * 576 - len(x))
        clip = audio.wav(payload)
        digest = hashlib.sha256(payload).hexdigest()
        want[(r.doc_id, len(x), len(payload), digest, zlib.crc32(payload[-32:]), len(clip), hashlib.sha256(clip).hexdigest())] += 1
        mel, found = audio.features(clip)
        feature[digest] = (len(mel), len(found))
    assert Counter((g.doc_id, g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32, g.media_bytes, g.media_sha256) for g in out) == want
    assert len({(g.payload_sha256, g.feature) for g in out}) == len(feature)
    assert all((g.n_frames, g.n_segments) == feature[g.payload_sha256] for g in out)


@pytest.mark.parametrize("rate", [8_000, 16_000, 44_100, 48_000])
def test_features_honour_the_rate(rate):
    """A tone has its peak in the same band at any rate; blocks make no difference."""
    t = np.arange(rate) / rate
    clip = audio.wav((128 + 100 * np.sin(2 * np.pi * 1000 * t)).astype(np.uint8).tobytes(), rate)
    mel, _ = audio.features(clip)
    centre = np.median(mel.argmax(1))
    usual, _ = audio.features(audio.wav((128 + 100 * np.sin(2 * np.pi * 1000 * np.arange(24_000) / 24_000)).astype(np.uint8).tobytes()))
    assert abs(len(mel) - len(usual)) <= 1 and centre == np.median(usual.argmax(1))


def direct_features(clip):
    """The features by their definition: zero-stuffed convolution, frame by frame, band by band."""
    data, rate = audio.samples_of(clip)
    x = (np.frombuffer(data, np.uint8).astype(float) - 128) / 128
    h = np.stack(audio.phases(audio.UP, audio.DOWN), 1).reshape(-1).astype(float)
    n_taps = len(h) // audio.UP
    y = []
    for m in range(len(x) * audio.UP // audio.DOWN):
        at, phase = m * audio.DOWN // audio.UP, m * audio.DOWN % audio.UP
        y.append(sum(h[phase + audio.UP * (n_taps - 1 - k)] * x[j] for k in range(n_taps) if 0 <= (j := at + k + 1 - n_taps // 2) < len(x)))
    y = np.array(y + [0.0] * max(0, audio.FRAME - len(y)))
    out, energy = [], []
    for s in range(0, len(y) - audio.FRAME + 1, audio.HOP):
        f = y[s : s + audio.FRAME] * audio._HANN
        power = np.abs(np.fft.fft(f, audio.FFT)[: audio.FFT // 2 + 1]) ** 2
        out.append([np.log(power @ audio._MEL[:, b] + 1e-6) for b in range(audio.MELS)])
        energy.append(10 * np.log10((f * f).sum() / audio.FRAME + 1e-9))
    floor, open_, start, found = np.percentile(energy, 10), False, None, []
    for i, e in enumerate([*energy, -1e9]):
        if not open_ and e > floor + audio.OPEN_DB:
            open_, start = True, i
        elif open_ and e <= floor + audio.CLOSE_DB:
            open_ = False
            found.append((start, i))
    return np.array(out), found


@pytest.mark.parametrize("n", [1, 200, 576, 3000])
def test_features_equal_brute_force(n):
    clip = audio.wav(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes() + b"\xff" * 576)
    mel, found = audio.features(clip)
    want, spans = direct_features(clip)
    assert mel.shape == want.shape and np.allclose(mel, want, atol=2e-3) and found == spans


def test_resampling_keeps_a_tone_and_drops_what_would_fold():
    t = np.arange(24_000) / 24_000
    y = audio.resample(np.sin(2 * np.pi * 440 * t).astype(np.float32))
    assert len(y) == 16_000
    spectrum = np.abs(np.fft.rfft(y))
    assert spectrum.argmax() == 440 and abs(np.abs(y[200:-200]).max() - 1) < 0.02
    assert np.abs(audio.resample(np.sin(2 * np.pi * 11_000 * t).astype(np.float32))[200:-200]).max() < 0.1


def test_resampling_equals_the_direct_form():
    x = np.random.default_rng(1).standard_normal(301).astype(np.float32)
    up = np.zeros(len(x) * audio.UP + 400)
    up[200 : 200 + len(x) * audio.UP : audio.UP] = x
    h = np.stack(audio.phases(audio.UP, audio.DOWN), 1).reshape(-1)
    direct = np.convolve(up, h)
    y = audio.resample(x)
    lag = [k for k in range(150, 260) if np.allclose(direct[k : k + audio.DOWN * len(y) : audio.DOWN][: len(y)], y, atol=1e-4)]
    assert len(lag) == 1


def test_blocks_of_samples_make_no_difference(monkeypatch):
    raw = audio.wav(np.random.default_rng(0).integers(0, 256, 576 * 300, dtype=np.uint8).tobytes())
    whole = audio.features(raw)
    monkeypatch.setattr(audio, "_CHUNK", 20_000)
    parts = audio.features(raw)
    assert whole[0].shape == parts[0].shape and np.allclose(whole[0], parts[0], atol=1e-4) and whole[1] == parts[1]


def test_hysteresis():
    energy = np.array([0, 0, 4, 7, 4, 4, 1, 4, 4, 0, 9, 0], float)
    assert audio.hysteresis(energy) == [(3, 6), (10, 11)]
    assert audio.hysteresis(np.zeros(0)) == []


def test_tensors_have_a_fixed_shape_and_time_spans(spark, docs, none):
    rows = audio.tensors(audio.text_clips(docs.where("doc_id in (1, 12)").dropDuplicates(["doc_id"]))).collect()
    long = sorted((r for r in rows if r.doc_id == 12), key=lambda r: r.block)
    assert all(len(r.tensor) == audio.BLOCK * audio.MELS for r in rows)
    assert [r.block for r in long] == list(range(len(long))) and all(a.end_s > b.start_s > a.start_s for a, b in zip(long, long[1:], strict=False))
    array = audio.tensor_array(np.array([r.tensor for r in long], np.float32).reshape(-1, audio.BLOCK, audio.MELS))
    assert isinstance(array, pa.FixedShapeTensorArray) and array.type.shape == [audio.BLOCK, audio.MELS]
    assert audio.text_clips(none).count() == 0 and audio.tensors(audio.text_clips(none)).count() == 0
    with pytest.raises(ValueError):
        audio.samples_of(b"RIFX")


def test_store_appends_compacts_and_keeps_versions(spark, docs, monkeypatch):
    monkeypatch.setattr(shards, "LEAST_BYTES", 1 << 30)
    store = ShardStore(spark, fresh_path(spark, "store"))
    for k in range(5):
        assert store.append(docs.where(f"coalesce(doc_id, 0) % 5 = {k}").coalesce(1)) == k + 1
    assert len(store.manifest()[2]) == 5 and store.read(2).count() < docs.count()
    assert store.compact_all() == 6 and len(store.manifest()[2]) == 1
    key = lambda d: sorted(map(str, d.collect()))
    assert key(store.read()) == key(docs) == key(store.read(5))
    assert store.compact() == 6  # nothing is due
    assert store.vacuum() == 5 and store.versions() == [6] and key(store.read()) == key(docs)
    with pytest.raises(Conflict):
        store._commit(6, {}, [])
    with pytest.raises(ValueError):
        store.append(docs.select("doc_id"))


def test_store_of_an_empty_arrival(spark, none):
    store = ShardStore(spark, fresh_path(spark, "store"))
    assert store.append(none) == 1
    assert store.read().count() == 0 and store.compact_all() == 1 and store.vacuum() >= 0


def test_op2_of_the_edge_cases(spark, folder, docs):
    assert shards.op2_tiered_shards(spark, folder).count() == docs.count()


def test_stages_keep_columns_and_rows(spark, folder, docs):
    now = docs
    sizes = [now.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, folder)
        assert after.columns == docs.columns, name
        assert Counter(map(str, after.collect())) <= Counter(map(str, now.collect())), name
        now = after
        sizes.append(now.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[1] < sizes[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, now, folder)
    assert Counter(r.doc_id for r in packed.collect() if not r.piece) == Counter(r.doc_id for r in now.collect())


def test_vacuum_spares_writers_at_work(spark, docs):
    store = ShardStore(spark, fresh_path(spark, "store"))
    store.append(docs.limit(5))
    folder = store._intend()
    docs.limit(7).write.parquet(folder)  # written, not yet committed
    assert store.vacuum() == 0
    version, schema, held = store.manifest()
    store._commit(version + 1, schema, held + store._shards(folder))
    assert store.read().count() == 12
    store._done(folder)
    gone = store._intend()
    docs.limit(3).write.parquet(gone)  # a writer that was lost
    assert store.vacuum() == 0 and store.vacuum(grace_s=-60) > 0 and store.read().count() == 12


def duck_on(frame, sql, tmp_path):
    frame.toPandas().astype({"doc_id": "Int64"}).to_parquet(tmp_path / "documents.parquet")  # nulls must not turn ids into floats
    return duck(sql, tmp_path)


def test_stages_equal_brute_force(spark, folder, docs, tmp_path, monkeypatch):
    """Each deciding stage on whole input against SQL, segments by definition, or all pairs."""
    columns = ["doc_id", "text", "lang", "source"]
    rows = lambda d: Counter((r.doc_id, r.text) for r in d.collect())
    narrow = docs.select("doc_id", "text", "lang", "source")
    # quality rules: verdicts are equal for equal rows, so a count by doc_id tells
    verdict = duck_on(narrow, quality_rules.OP10_SQL, tmp_path)
    kept = corpus_pipeline.quality_stage(spark, narrow, folder)
    count = lambda ids: Counter(None if pd.isna(x) else int(x) for x in ids)
    assert kept.columns == columns and count(r.doc_id for r in kept.collect()) == count(verdict[verdict["kept"]]["doc_id"])
    # toxicity: every score again from segments by definition
    model = toxicity.train(narrow, toxicity.labelled(spark, folder, "toxic", 4, 2))
    want = Counter()
    for r in narrow.collect():
        raw = (r.text or "").encode()
        _, _, _, words, heads = toxicity._tokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        scores = toxicity._lookup(model, words, heads)
        if len(scores) > 2000:  # the definition is quadratic; one text of 30,000 words goes by the scan
            found = toxicity.segments(scores)
        else:
            found = all_segments(scores.tolist())
        e = [model.k * len(scores) * np.exp(-min(700.0, model.lam * s)) for *_, s in found]
        x = [1.0, min(60.0, np.log1p(1 / max(1e-300, min(e)))) / 10 if e else 0.0, min(10, sum(v <= toxicity.LEAST_E for v in e))]
        want[(r.doc_id, r.text)] += 1 / (1 + np.exp(-np.dot(x, model.curve))) < toxicity.THRESHOLD
    assert rows(corpus_pipeline.toxicity_stage(spark, narrow, folder)) == +want
    # near-duplicates: one row of each class by all pairs
    all_rows = [(r.doc_id, r.text) for r in narrow.collect()]
    sets = [shingles(x, 5) for _, x in all_rows]
    classes = {}
    for i, own in enumerate(sets):
        links = [c for c, held in classes.items() if own and any(100 * len(own & sets[j]) >= 80 * len(own | sets[j]) for j in held)]
        classes[i] = [i] + [j for c in links for j in classes.pop(c)]
    kept = corpus_pipeline.dedup_stage(spark, narrow, folder).collect()
    assert len(kept) == len(classes)
    least = Counter(min((all_rows[j][0] for j in held), key=lambda v: (v is None, v)) for held in classes.values())
    assert Counter(r.doc_id for r in kept) == least
    # mixing
    monkeypatch.setattr(mixing, "FRACTION", corpus_pipeline.MIX_FRACTION)
    drawn = duck_on(narrow, mixing._sql(), tmp_path)
    kept = corpus_pipeline.mixing_stage(spark, narrow, folder)
    assert count(r.doc_id for r in kept.collect()) == count(drawn[drawn["drawn"]]["doc_id"])


def test_dedup_stage_keeps_one_of_each_group(spark, folder, docs):
    kept = {r.doc_id for r in corpus_pipeline.dedup_stage(spark, docs, folder).collect()}
    assert 8 in kept and not kept & {9, 10, 11}


def test_pipeline_runs_and_takes_empty_tables(spark, folder, none):
    assert corpus_pipeline.run(spark, folder).count() > 0
    now = none
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, folder)
    assert now.count() == 0
