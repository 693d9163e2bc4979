"""Best-fit packing by patterns (operator 9).

1. One scan turns each text into ids and an end id, and cuts only what exceeds the sequence length into
   full pieces (the first may be shorter). Pieces, without their ids, go to a written table.
2. The histogram of lengths (LENGTH rows at most, whatever the corpus) goes to the driver. Patterns of two
   to four lengths that fill a sequence exactly are enumerated; non-negative least squares fits their repeat
   counts to the histogram; counts are rounded down to what the histogram still holds. Three rounds, then
   best-fit decreasing on the histogram packs what is left, many equal sequences at a time.
3. A pattern with R repeats takes ranks k..k+R of a length to R sequences in turn, so a plan row stands for
   R pieces. Each piece finds its rank within its length by a salted count (length, bucket) and looks its
   place up by binary search in the plan.

Null and empty texts are one end id. Repeated doc_id rows are pieces of their own. An empty table gives no
rows. A length that a third of all pieces have is ranked in buckets, never in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import slices, small_batches, table, texts_of, written
from .vocab import encoder

LENGTH = 2048
PATTERNS = 6000
ROUNDS = 3
#: Pieces of a (length, bucket) that are ranked together, about.
BUCKET_ROWS = 20_000


def pieces(docs: DataFrame, vocab: str, end_id: int, lower_words: bool = False, length: int = LENGTH) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab, lower_words)
        for b in batches:
            data, offsets = texts_of(b.column(1))
            doc = b.column(0).to_pylist()
            out: tuple[list, ...] = ([], [], [], [], [])
            for i, j in slices(offsets, 1_000_000):
                ids, n = enc.encode([data[offsets[r] : offsets[r + 1]].tobytes() for r in range(i, j)])
                at = 0
                for r, c in zip(range(i, j), n.tolist(), strict=True):
                    own = np.append(ids[at : at + c], np.uint32(end_id)).astype("<u4")
                    at += c
                    cuts = [0, *range(len(own) % length or length, len(own) + 1, length)] if len(own) > length else [0, len(own)]
                    for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        for o, v in zip(out, (doc[r], k, x, y - x, zlib.crc32(own[x:y])), strict=True):
                            o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()], strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def enumerate_patterns(left: np.ndarray, most: int, rng: np.random.Generator) -> list[tuple[int, ...]]:
    """Patterns of two to four lengths with a sum of exactly len(left) - 1, all pairs and then the likeliest triples and quadruples."""
    full = len(left) - 1
    have = np.flatnonzero(left)
    if not len(have):
        return []
    found = {(full - a, a) if full - a >= a else (a, full - a) for a in have.tolist() if 0 < full - a <= full and left[full - a]}
    p = left[have] / left[have].sum()
    for size in (3, 4):
        draws = rng.choice(have, (most * 3, size - 1), p=p)
        last = full - draws.sum(1)
        ok = last > 0
        ok[ok] &= left[last[ok]] > 0
        rows = -np.sort(-np.concatenate([draws[ok], last[ok, None]], 1), 1)
        for row in rows[: most // 2].tolist():
            found.add(tuple(row))
    return sorted(found)


def fit_counts(patterns: list[tuple[int, ...]], left: np.ndarray, sweeps: int = 25) -> np.ndarray:
    """Non-negative least squares min |D (A x - left)| by coordinate descent; column j of A counts the lengths of pattern j, and D weighs a length by its tokens, as long pieces are the harder to place later."""
    columns = []
    for pat in patterns:
        lengths, n = np.unique(pat, return_counts=True)
        n = n.astype(float)
        d = (lengths / len(left)) ** 2
        columns.append((lengths.tolist(), n.tolist(), (n * d / (n * n * d).sum()).tolist()))
    x, rest = [0.0] * len(patterns), left.astype(float).tolist()
    for _ in range(sweeps):
        moved = 0.0
        for j, (lengths, n, pull) in enumerate(columns):
            g = 0.0
            for a, b in zip(lengths, pull, strict=True):
                g += rest[a] * b
            new = max(0.0, x[j] + 0.5 * g)
            d = new - x[j]
            if d:
                x[j] = new
                moved = max(moved, abs(d))
                for a, b in zip(lengths, n, strict=True):
                    rest[a] -= d * b
        if moved < 0.05:
            break
    return np.array(x)


def best_fit(left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing of a histogram of lengths: (pattern, repeats). Equal open sequences move together."""
    full = len(left) - 1
    open_: list[dict[tuple[int, ...], int]] = [{} for _ in range(full + 1)]  # by space left
    spaces = np.zeros(full + 1, np.int64)
    for length in range(full, 0, -1):
        todo = int(left[length])
        while todo:
            fit = np.flatnonzero(spaces[length:])
            if len(fit):
                space = int(fit[0]) + length
                pat, n = next(iter(open_[space].items()))
                take = min(n, todo)
                if take == n:
                    del open_[space][pat]
                else:
                    open_[space][pat] -= take
                spaces[space] -= take
                new, space = (*pat, length), space - length
            else:
                k = min(todo, full // length)
                take, new = max(1, todo // k), (length,) * k
                space = full - length * k
                open_[space][new] = open_[space].get(new, 0) + take
                spaces[space] += take
                todo -= take * k
                continue
            open_[space][new] = open_[space].get(new, 0) + take
            spaces[space] += take
            todo -= take
    return [(pat, n) for by in open_ for pat, n in by.items()]


def plan(histogram: dict[int, int], length: int = LENGTH, most: int = PATTERNS, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that use up the histogram exactly."""
    left = np.zeros(length + 1, np.int64)
    for k, v in histogram.items():
        left[k] = v
    out = [((length,), int(left[length]))] if left[length] else []
    left[length] = 0
    rng = np.random.default_rng(9)
    for _ in range(rounds):
        if left.sum() < 8:
            break
        patterns = enumerate_patterns(left, most, rng)
        x = fit_counts(patterns, left)
        for j in sorted(range(len(x)), key=lambda j: (-patterns[j][0], -x[j])):  # patterns of long pieces first
            n = int(x[j])
            lengths, each = np.unique(patterns[j], return_counts=True)
            n = min(n, int((left[lengths] // each).min()))
            if n > 0:
                left[lengths] -= n * each
                out.append((patterns[j], n))
    return out + best_fit(left)


def _places(planned: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """Plan rows sorted by (length, first rank): key, sequence and offset of the first piece."""
    rows, sequence = [], 0
    for pat, n in planned:
        at = 0
        for length in pat:
            rows.append((length, sequence, at, n))
            at += length
        sequence += n
    a = np.array(rows, np.int64).reshape(-1, 4)
    a = a[np.argsort(a[:, 0], kind="stable")]
    before = np.cumsum(a[:, 3]) - a[:, 3]
    first = np.searchsorted(a[:, 0], a[:, 0])
    rank = before - before[first] if len(a) else before
    return a[:, 0] * (1 << 48) + rank, a[:, 1], a[:, 2], rank


def pack(cut: DataFrame, length: int = LENGTH) -> DataFrame:
    """pieces (a written table) with sequence_id and offset."""
    counts = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # length rows at most
    keys, sequence, offset, rank0 = _places(plan(counts, length))
    buckets = max(1, -(-sum(counts.values()) // BUCKET_ROWS))
    marked = cut.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = marked.groupBy("length", "_b").agg(F.count("*").alias("n"))
    before = sizes.select("length", "_b", (F.sum("n").over(W.partitionBy("length").orderBy("_b")) - F.col("n")).alias("_before"))
    ranked = marked.withColumn("_r", F.row_number().over(W.partitionBy("length", "_b").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(before, ["length", "_b"]).select(*cut.columns, (F.col("_r") + F.col("_before")).alias("_rank"))
    names = cut.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, r = b.column(names.index("length")).to_numpy(), b.column(len(names)).to_numpy()
            at = np.searchsorted(keys, n * (1 << 48) + r, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(sequence[at] + r - rank0[at]), pa.array(offset[at])], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields)
    return ranked.mapInArrow(run, f"{schema}, sequence_id bigint, offset bigint")


def op9_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(written(pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), 0), "pieces"))
