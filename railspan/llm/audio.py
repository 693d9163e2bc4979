"""Audio features in media columns (operator 1).

A clip is 8-bit mono PCM in a RIFF/WAVE container at SOURCE_HZ. Features:

- polyphase resampling by up/down from the clip's own rate to RATE: output m is the dot product of the input
  with phase (m * down) mod up of a windowed-sinc filter, so zeros that upsampling would insert are never
  multiplied;
- log-mel filterbanks of overlapping Hann frames (FRAME samples every HOP);
- segments of activity by hysteresis: a segment opens when the frame energy passes OPEN_DB and closes when
  it falls under CLOSE_DB, thresholds in dB over the clip's own floor.

Frames are stored in blocks of BLOCK frames x MELS bands: fixed-shape tensors with time spans. tensors()
gives a row for each block, tensor_array() the Arrow fixed-shape tensor column. Clips of any length are
processed in blocks of samples, so memory is bounded by the stored clip.

A clip under one frame is filled up with silence; a clip without samples has no frame, block or segment;
null clips give no tensor rows. Null texts count as empty; null and repeated doc_ids keep a row each. Equal clips
have equal features wherever they stand.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, small_batches, table, texts_of, written

SOURCE_HZ, UP, DOWN = 24_000, 2, 3
RATE = SOURCE_HZ * UP // DOWN
FRAME, HOP, FFT, MELS, BLOCK = 400, 160, 512, 40, 64
OPEN_DB, CLOSE_DB = 6.0, 3.0
PAD = 576
_LOBES = 8  # of the filter, at the lower of both rates
_CHUNK = 1 << 19


@lru_cache(maxsize=32)
def phases(up: int, down: int) -> np.ndarray:
    """[phase, tap] of the windowed-sinc low-pass at the lower of both Nyquist rates."""
    n = up * (-(-_LOBES * max(up, down) // (2 * up)) * 2)
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(up, down)) * np.hanning(n + 2)[1:-1]
    h *= up / h.sum()
    return np.stack([h[p::up] for p in range(up)]).astype(np.float32)


def _mels() -> np.ndarray:
    to_mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(to_mel(20), to_mel(RATE / 2), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FFT, 1 / RATE)
    up = (f[None, :] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - f[None, :]) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down)).T.astype(np.float32)


_MEL = _mels()
_HANN = np.hanning(FRAME + 1)[:-1].astype(np.float32)


def wav(samples: bytes, rate: int = SOURCE_HZ) -> bytes:
    """8-bit unsigned mono PCM in a RIFF/WAVE container; an odd length gets the format's pad byte."""
    data = b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * (len(samples) % 2)
    body = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def samples_of(clip: bytes) -> tuple[bytes, int]:
    """The samples and the rate of a stored clip, by walking its RIFF chunks."""
    if clip[:4] != b"RIFF" or clip[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE clip")
    at, rate = 12, 0
    while at + 8 <= len(clip):
        name, size = clip[at : at + 4], struct.unpack_from("<I", clip, at + 4)[0]
        if name == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", clip, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM")
        elif name == b"data":
            return clip[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no samples")


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Polyphase resampling of float samples by up/down; len(x) * up // down outputs."""
    n = len(x) * up // down
    if not n:
        return np.zeros(0, np.float32)
    bank = phases(up, down)
    n_taps = bank.shape[1]
    padded = np.concatenate([np.zeros(n_taps // 2, np.float32), x, np.zeros(n_taps, np.float32)])
    out = np.empty(n, np.float32)
    for first in range(min(up, n)):  # outputs first, first + up, ... share a phase
        count = -(-(n - first) // up)
        start, phase = first * down // up, first * down % up
        taps = bank[phase][::-1]
        acc = np.zeros(count, np.float32)
        for k in range(n_taps):
            acc += taps[k] * padded[start + k + 1 : start + k + 1 + down * count : down][:count]
        out[first::up] = acc
    return out


def log_mel(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[frames, MELS] log-mel features and the energy of each frame in dB."""
    if not len(y):
        return np.zeros((0, MELS), np.float32), np.zeros(0, np.float32)
    if len(y) < FRAME:  # a short clip is one frame
        y = np.concatenate([y, np.zeros(FRAME - len(y), np.float32)])
    n = 1 + (len(y) - FRAME) // HOP
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP][:n]
    out, energy = np.empty((n, MELS), np.float32), np.empty(n, np.float32)
    for i in range(0, n, 512):
        f = frames[i : i + 512] * _HANN
        power = np.abs(np.fft.rfft(f, FFT, axis=1)).astype(np.float32) ** 2
        out[i : i + 512] = np.log(power @ _MEL + 1e-6)
        energy[i : i + 512] = 10 * np.log10((f * f).sum(1) / FRAME + 1e-9)
    return out, energy


def hysteresis(energy: np.ndarray) -> list[tuple[int, int]]:
    """Segments [start, end) of frames: open over floor + OPEN_DB, kept while over floor + CLOSE_DB."""
    if not len(energy):
        return []
    floor = np.percentile(energy, 10)
    warm = np.concatenate([[False], energy > floor + CLOSE_DB, [False]]).astype(np.int8)
    starts, ends = np.flatnonzero(np.diff(warm) == 1), np.flatnonzero(np.diff(warm) == -1)
    hot = np.concatenate([[0], np.cumsum(energy > floor + OPEN_DB)])
    return [(int(a + np.argmax(energy[a:b] > floor + OPEN_DB)), int(b)) for a, b in zip(starts, ends, strict=True) if hot[b] > hot[a]]


def features(clip: bytes) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Log-mel frames and active segments (frame numbers) of a stored clip at its own rate; long clips go through the filters in blocks."""
    data, rate = samples_of(clip)
    if rate <= 0:
        raise ValueError("a clip without a rate")
    up, down = RATE // math.gcd(RATE, rate), rate // math.gcd(RATE, rate)
    raw = np.frombuffer(data, np.uint8)
    if len(raw) <= _CHUNK:
        mel, energy = log_mel(resample((raw.astype(np.float32) - 128) / 128, up, down))
        return mel, hysteresis(energy)
    mels, energies, step = [], [], max(1, _CHUNK // (HOP * down)) * HOP * down  # blocks begin on a frame
    reach = (FRAME // up + 1) * down + 2 * phases(up, down).shape[1]
    for a in range(0, len(raw), step):
        lead = min(a, HOP * down)
        if a and (len(raw) - a) * up // down < FRAME:
            break  # the rest is inside earlier frames
        x = (raw[a - lead : a + step + reach].astype(np.float32) - 128) / 128
        y = resample(x, up, down)[lead * up // down :]
        want = step * up // down // HOP if a + step < len(raw) else None
        m, e = log_mel(y)
        mels.append(m[:want])
        energies.append(e[:want])
    return np.concatenate(mels), hysteresis(np.concatenate(energies))


def blocks_of(mel: np.ndarray) -> np.ndarray:
    """[blocks, BLOCK, MELS]; the last block is filled up with zeros."""
    n = -(-len(mel) // BLOCK)
    out = np.zeros((n * BLOCK, MELS), np.float32)
    out[: len(mel)] = mel
    return out.reshape(n, BLOCK, MELS)


def tensor_array(blocks: np.ndarray) -> pa.Array:
    """The blocks as an Arrow fixed-shape tensor column."""
    kind = pa.fixed_shape_tensor(pa.float32(), (BLOCK, MELS), dim_names=["frame", "band"])
    return pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(pa.array(blocks.reshape(-1)), BLOCK * MELS))


def tensors(clips: DataFrame) -> DataFrame:
    """clips (doc_id, media): a row (doc_id, block, start_s, end_s, frames, active, tensor) for each block; tensor has BLOCK * MELS values, active the frames inside segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, clip in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if clip is None:
                    continue
                mel, found = features(clip)
                on = np.zeros(len(mel), np.int64)
                for s, e in found:
                    on[s:e] = 1
                stored = tensor_array(blocks_of(mel))
                for i in range(0, len(stored), 64):
                    part = stored[i : i + 64]
                    k = np.arange(i, i + len(part))
                    frames = np.minimum(BLOCK, len(mel) - k * BLOCK)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([doc] * len(k), pa.int64()),
                            pa.array(k.astype(np.int32)),
                            pa.array(k * BLOCK * HOP / RATE),
                            pa.array(((k * BLOCK + frames - 1) * HOP + FRAME) / RATE),
                            pa.array(frames.astype(np.int32)),
                            pa.array([int(on[j * BLOCK : (j + 1) * BLOCK].sum()) for j in k], pa.int32()),
                            pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * BLOCK * MELS, pa.int32()), part.storage.flatten()),
                        ],
                        names=["doc_id", "block", "start_s", "end_s", "frames", "active", "tensor"],
                    )

    return clips.select(F.col("doc_id").cast("bigint"), "media").mapInArrow(run, "doc_id bigint, block int, start_s double, end_s double, frames int, active int, tensor array<float>")


def text_clips(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): the UTF-8 bytes of each text and bytes 255 up to a positive multiple of PAD, as a clip."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = texts_of(b.column(1))
            for i, j in slices(offsets):
                clips = []
                for r in range(i, j):
                    x = data[offsets[r] : offsets[r + 1]].tobytes()
                    clips.append(wav(x + b"\xff" * (max(1, -(-len(x) // PAD)) * PAD - len(x))))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(offsets[i : j + 1])), pa.array(clips, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


def digests(clips: DataFrame) -> DataFrame:
    """Read the stored clips back: payload and media digests, and a digest of the tensors and the segments' time spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64()]
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "n_segments", "active_s"]
        for b in batches:
            rows = []
            for doc, n, clip in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                clip = clip.as_py()
                payload, _ = samples_of(clip)
                mel, found = features(clip)
                stored = tensor_array(blocks_of(mel)).to_numpy_ndarray() if len(mel) else np.zeros((0, BLOCK, MELS), np.float32)
                spans = ",".join(f"{a * HOP / RATE:.2f}-{((z - 1) * HOP + FRAME) / RATE:.4f}" for a, z in found)
                code = f"{len(mel)}x{MELS}:{zlib.crc32(np.round(stored, 2).astype('<f4').tobytes()):08x}:{len(found)}:{zlib.crc32(spans.encode()):08x}"
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(clip), hashlib.sha256(clip).hexdigest(), code, len(mel), len(found), sum(z - a for a, z in found) * HOP / RATE))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * len(kinds), kinds, strict=True)], names=names)

    return clips.mapInArrow(run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_frames int, n_segments int, active_s double")


def op1_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, 250)
    clips = written(text_clips(table(spark, sf_dir, "documents").select("doc_id", "text")), "clips")
    return digests(clips)
