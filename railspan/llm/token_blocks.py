"""Token ids in patched frame-of-reference files (operator 8).

A file holds the ids of a range of documents in ascending doc_id order, in segments of up to SEGMENT ids:

    segment  b"PFR1", u32 ids, u32 blocks, u32 exceptions, u32 payload bytes,
             u32 minimum[blocks], u8 width[blocks], u8 exception count[blocks], u32 payload start[blocks],
             u8 exception position[exceptions], u32 exception value[exceptions], payload
    footer   i64 doc_id[docs], i64 ids[docs], i64 segment start[segments], u64 docs, u64 nulls, u64 segments, b"PFRE"
             (the first nulls documents of a file have no doc_id; theirs reads 0)

A block is BLOCK ids. The block's minimum is subtracted and the rest is packed at the least width that holds
PERCENTILE of the block; wider values keep their place in the packing and their whole value in the exception
list. Block starts are indexed, so one block can be read alone. All numbers are little-endian.

Each try of a task writes a file of its own name; the result names the files of the tries that were committed,
and those of lost tries are in no result. Null and empty texts are one end id; an empty table writes no file and
returns no rows. Rows without doc_id come first; rows with equal doc_id are ordered by a hash of the text and the
text, so start is defined for them too.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import fresh_path, slices, small_batches, table, texts_of, written
from .vocab import encoder

BLOCK, PERCENTILE, SEGMENT = 128, 0.9, 1 << 19


def _width(x: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def pack_segment(ids: np.ndarray) -> bytes:
    n = len(ids)
    blocks = -(-n // BLOCK)
    x = np.zeros(blocks * BLOCK, np.uint32)
    x[:n] = ids
    if n:
        x[n:] = ids[-1]
    x = x.reshape(blocks, BLOCK)
    low = x.min(1) if blocks else np.zeros(0, np.uint32)
    x = x - low[:, None]
    bits = _width(x)
    width = np.sort(bits, 1)[:, int(np.ceil(BLOCK * PERCENTILE)) - 1] if blocks else np.zeros(0, np.uint8)
    over = bits > width[:, None]
    row, col = np.nonzero(over)
    size = width.astype(np.int64) * (BLOCK // 8)
    start = np.cumsum(size) - size
    payload = np.zeros(int(size.sum()), np.uint8)
    for w in np.unique(width).tolist():
        if not w:
            continue
        own = np.flatnonzero(width == w)
        for i in range(0, len(own), 1024):
            k = own[i : i + 1024]
            as_bytes = x[k].astype("<u4").view(np.uint8).reshape(len(k), BLOCK, 4)
            as_bits = np.unpackbits(as_bytes, axis=2, bitorder="little")[:, :, :w]
            packed = np.packbits(as_bits.reshape(len(k), -1), axis=1, bitorder="little")
            payload[start[k][:, None] + np.arange(packed.shape[1])] = packed
    return b"".join(
        [
            b"PFR1",
            struct.pack("<4I", n, blocks, len(row), len(payload)),
            low.astype("<u4").tobytes(),
            width.tobytes(),
            over.sum(1).astype(np.uint8).tobytes(),
            start.astype("<u4").tobytes(),
            col.astype(np.uint8).tobytes(),
            x[row, col].astype("<u4").tobytes(),
            payload.tobytes(),
        ]
    )


def unpack_segment(data: bytes, block: int | None = None) -> np.ndarray:
    """The ids of a segment, or of one of its blocks."""
    if data[:4] != b"PFR1":
        raise ValueError("not a segment")
    n, blocks, exceptions, size = struct.unpack_from("<4I", data, 4)
    at = 20
    parts = []
    for dtype, count in (("<u4", blocks), ("u1", blocks), ("u1", blocks), ("<u4", blocks), ("u1", exceptions), ("<u4", exceptions), ("u1", size)):
        parts.append(np.frombuffer(data, dtype, count, at))
        at += parts[-1].nbytes
    low, width, count, start, col, value, payload = parts
    row = np.repeat(np.arange(blocks), count)
    if block is not None:
        mine = row == block
        low, width, start, col, value, row = low[block : block + 1], width[block : block + 1], start[block : block + 1], col[mine], value[mine], row[mine] * 0
        n, blocks = min(BLOCK, n - block * BLOCK), 1
    x = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(width).tolist():
        if not w:
            continue
        own = np.flatnonzero(width == w)
        for i in range(0, len(own), 1024):
            k = own[i : i + 1024]
            packed = payload[start[k].astype(np.int64)[:, None] + np.arange(w * BLOCK // 8)]
            bits = np.zeros((len(k), BLOCK, 32), np.uint8)
            bits[:, :, :w] = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(k), BLOCK, w)
            x[k] = np.packbits(bits, axis=2, bitorder="little").view("<u4")[:, :, 0]
    x[row, col] = value
    return (x + low[:, None]).reshape(-1)[:n]


def write_ids(docs: DataFrame, folder: str, vocab: str, end_id: int, lower_words: bool) -> DataFrame:
    """Write the ids of every text; a row (part, path, first, docs, ids) for each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        enc, part = encoder(vocab, lower_words), TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(folder)
        path = f"{root}/part-{part:06d}-{uuid.uuid4().hex}.pfor"
        out, held, n_held, segments, doc_ids, counts, nulls = None, [], 0, [], [], [], 0

        def flush(least: int) -> None:
            nonlocal held, n_held
            while n_held >= least and n_held:
                ids = np.concatenate(held)
                segments.append(out.tell())
                out.write(pack_segment(ids[:SEGMENT]))
                held, n_held = [ids[SEGMENT:]], max(0, len(ids) - SEGMENT)

        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(path, compression=None)
            data, offsets = texts_of(b.column(1))
            for i, j in slices(offsets, 1_000_000):
                ids, n = enc.encode([data[offsets[r] : offsets[r + 1]].tobytes() for r in range(i, j)])
                ends = np.cumsum(n + 1)
                own = np.full(int(ends[-1]), end_id, np.uint32)
                inside = np.ones(len(own), bool)
                inside[ends - 1] = False
                own[inside] = ids
                held.append(own)
                n_held += len(own)
                counts.append(n + 1)
                flush(SEGMENT)
            nulls += b.column(0).null_count
            doc_ids.append(b.column(0).fill_null(0).to_numpy())
        if out is not None:
            flush(1)
            d, c = np.concatenate(doc_ids).astype("<i8"), np.concatenate(counts).astype("<i8")
            out.write(d.tobytes() + c.tobytes() + np.array(segments, "<i8").tobytes() + struct.pack("<3Q", len(d), nulls, len(segments)) + b"PFRE")
            out.close()
            uri = folder + path[len(root) :]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([part, uri, int(d[0]), len(d), int(c.sum())], [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()], strict=True)], names=["part", "path", "first", "docs", "ids"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    # the hash splits a doc_id that many rows have
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    return ordered.mapInArrow(run, "part bigint, path string, first bigint, docs bigint, ids bigint")


def read_file(uri: str) -> Iterator[tuple[int | None, np.ndarray, bool]]:
    """(doc_id, ids, whole): the documents of a file in turn; a document over several segments comes in parts, whole marking its last."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        size = f.size()
        f.seek(size - 28)
        tail = f.read(28)
        if tail[24:] != b"PFRE":
            raise ValueError(f"{uri} has no footer")
        docs, nulls, segments = struct.unpack("<3Q", tail[:24])
        f.seek(size - 28 - 8 * (2 * docs + segments))
        foot = np.frombuffer(f.read(8 * (2 * docs + segments)), "<i8")
        ends = [*foot[2 * docs + 1 :].tolist(), size - 28 - 8 * (2 * docs + segments)]
        doc, left = 0, int(foot[docs])
        for a, z in zip(foot[2 * docs :].tolist(), ends, strict=True):
            f.seek(a)
            ids = unpack_segment(f.read(z - a))
            at = 0
            while at < len(ids):
                take = min(left, len(ids) - at)
                left -= take
                yield None if doc < nulls else int(foot[doc]), ids[at : at + take], not left
                at += take
                if not left:
                    doc += 1
                    left = int(foot[docs + doc]) if doc < docs else 0


def read_ids(files: DataFrame) -> DataFrame:
    """files (path, base): (doc_id, start, n_tokens, ids_crc32) of every document, read from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                n = crc = 0
                for doc, ids, whole in read_file(uri):
                    n, crc = n + len(ids), zlib.crc32(ids.astype("<u4"), crc)
                    if whole:
                        rows.append((doc, start, n, crc))
                        start, n, crc = start + n, 0, 0
                for i in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + 10_000], strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("path", "base").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op8_pfor_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    files = written(write_ids(docs, fresh_path(spark, "ids"), public_tokenizers.path("word_bpe_49k.json"), 2, True), "files")
    # one row for each file: as many as partitions, not documents
    based = files.withColumn("base", F.sum("ids").over(W.orderBy("part")) - F.col("ids"))
    return read_ids(based.select("path", "base").repartition(max(1, files.count()), "path"))
