"""Shared pieces of the corpus operators: working folder, written tables, batched text scans."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch sent to a Python worker; texts are long, so batches are kept small.
BATCH_ROWS = 1000

#: The white space of the word contract: space and 0x09-0x0D.
WS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local master without one gets a folder of its own; a cluster without one is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="railspan-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/railspan/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder; a lost executor then costs no recomputation of what precedes."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of written() that no later plan reads."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._scratch)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def crc_mod(col: str, k: int):
    """crc32 of the column as text, modulo k."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(k)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most_bytes: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most most_bytes of text each; a longer text stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most_bytes, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


_IS_WS = np.zeros(256, dtype=bool)
_IS_WS[[0x20, *range(0x09, 0x0E)]] = True
_KEY = np.uint64(0x9E3779B97F4A7C15)
_NEAR = 64
_CODES = mix64((np.arange(_NEAR * 256, dtype=np.uint64) + np.uint64(1)) * _KEY)
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


#: Bytes that separate alphanumeric tokens: ASCII but digits and letters.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def word_spans(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _IS_WS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in the bytes of many texts, and the words of each text. A word never crosses texts; between marks the bytes that part words."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~between[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of byte ranges: the sum of a random code for each (place in the range, byte), finished with the length.

    Codes of different places are unrelated, so no order of bytes cancels out.
    """
    size = ends - starts
    total = int(size.sum())
    if not total:
        return np.zeros(len(starts), np.uint64)
    first = np.cumsum(size) - size
    place = np.arange(total) - np.repeat(first, size)
    byte = data[place + np.repeat(starts, size)]
    if lower:
        byte = _LOW[byte]
    at = place * 256 + byte
    if int(size.max()) <= _NEAR:
        code = _CODES[at]
    else:
        code = mix64((at.astype(np.uint64) + np.uint64(1)) * _KEY)
    sums = np.zeros(total + 1, np.uint64)
    np.cumsum(code, out=sums[1:])
    return mix64(sums[first + size] - sums[first] + size.astype(np.uint64))
