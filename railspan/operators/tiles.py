"""Pairs of near places by tiles: a task holds one tile with the places around it, and what is ranked or summed over pairs never goes through a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import KX, KY
from .meets import Meets
from .spatial import _around, _bucket
from .walks import seconds

#: Rows handed on at once, and pairs that are tested at once.
ROWS, TESTS = 100_000, 1_000_000
#: Parts that tiles with long work are dealt to.
TILES = 192


def by_tile(points: DataFrame, width: float, reach: int, run: Callable[..., Iterator[list]], schema: str | T.StructType, parts: int | None = None) -> DataFrame:
    """What run(stop, lon, lat, own) yields for each tile of width metres: its places (stop, lon, lat), own ones marked, with those of reach tiles to each side, by stop. Tiles are dealt to so many parts, or as Spark sees fit by their bytes."""
    gx, gy = _bucket(F.col("lon"), F.col("lat"), width)
    p = points.select("stop", "lon", "lat").where("stop is not null and not isnan(lon) and not isnan(lat)").withColumns({"_gx": gx, "_gy": gy, "_hx": gx, "_hy": gy})
    p = _around(p, reach).select("_gx", "_gy", "stop", "lon", "lat", ((F.col("_gx") == F.col("_hx")) & (F.col("_gy") == F.col("_hy"))).alias("own"))

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        held: list[list[np.ndarray]] = []
        for b in batches:
            if not b.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            ends = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)) + 1
            if held and (held[-1][0][-1], held[-1][1][-1]) != (cols[0][0], cols[1][0]):
                yield [np.concatenate(c) for c in zip(*held, strict=True)]
                held = []
            for lo, hi in zip([0, *ends], [*ends, b.num_rows], strict=True):
                if lo:
                    yield [np.concatenate(c) for c in zip(*held, strict=True)]
                    held = []
                held.append([c[lo:hi] for c in cols])
        if held:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, stop, lon, lat, own in tiles(batches):
            if not own.any():
                continue
            order = np.argsort(stop, kind="stable")
            for out in run(stop[order], lon[order], lat[order], own[order].astype(bool)):
                for k in range(0, len(out[0]), ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(c[k : k + ROWS]) for c in out], names=names)

    names = [c.split()[0] for c in schema.split(", ")] if isinstance(schema, str) else schema.names
    return p.repartition(*[parts] * (parts is not None), "_gx", "_gy").sortWithinPartitions("_gx", "_gy").mapInArrow(task, schema)


def _near(lon: np.ndarray, lat: np.ndarray, a: np.ndarray, b: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, m) of places a[i] and b[j] within the radius, by i and j; all of one i come together."""
    size = max(1, TESTS // max(1, len(b)))
    for k in range(0, len(a), size):
        x, y = (np.subtract.outer(v[a[k : k + size]], v[b]) * c for v, c in ((lon, KX), (lat, KY)))
        m = np.sqrt(x * x + y * y)
        i, j = np.nonzero(m <= radius)
        yield i + k, j, m[i, j]


def ranked_walks(points: DataFrame, radius: float) -> DataFrame:
    """(src, dst, cost, pos): the walks between places (stop, lon, lat) of different stops within radius metres, numbered by dst and cost for each src. Rows of one stop share a place."""

    def run(stop: np.ndarray, lon: np.ndarray, lat: np.ndarray, own: np.ndarray) -> Iterator[list[np.ndarray]]:
        a, b = np.flatnonzero(own), np.arange(len(stop))
        repeated = bool((np.diff(stop) == 0).any())
        parts = _near(lon, lat, a, b, radius)
        if repeated:  # walks of one stop from several rows are numbered together
            parts = [[np.concatenate(c) for c in zip(*parts, strict=True)]]
        for i, j, m in parts:
            src, dst = stop[a[i]], stop[j]
            other = src != dst
            src, dst, cost = src[other], dst[other], seconds(m[other])
            if repeated:
                order = np.lexsort((cost, dst, src))
                src, dst, cost = src[order], dst[order], cost[order]
            head = np.flatnonzero(np.concatenate([[True], src[1:] != src[:-1]])) if len(src) else np.zeros(0, int)
            pos = np.arange(len(src)) - np.repeat(head, np.diff(np.append(head, len(src)))) + 1
            yield [src, dst, cost, pos.astype(np.int32)]

    return by_tile(points, radius / 2, 2, run, "src bigint, dst bigint, cost bigint, pos int")


def met_pairs(points: DataFrame, radius: float, close: float) -> DataFrame:
    """(src, dst, close): stops src < dst that have a stop of a greater number within radius metres of both; whether the least way over such a stop is under close metres, which is at most radius. Rows of one stop share a place."""

    def run(stop: np.ndarray, lon: np.ndarray, lat: np.ndarray, own: np.ndarray) -> Iterator[list]:
        out, held = [], 0
        for s, short, rest in Meets(lon, lat, own, radius, close).pairs():
            for ends, is_close in ((short, True), (rest, False)):
                for k in range(0, len(ends), ROWS):
                    out.append((s, is_close, ends[k : k + ROWS]))
                    held += len(out[-1][2])
            if held >= ROWS:
                yield lists(stop, out)
                out, held = [], 0
        if out:
            yield lists(stop, out)

    def lists(stop: np.ndarray, rows: list[tuple[int, bool, np.ndarray]]) -> list:
        s, is_close, ends = zip(*rows, strict=True)
        at = np.concatenate([[0], np.cumsum([len(e) for e in ends])]).astype(np.int32)
        return [stop[list(s)], np.array(is_close), pa.ListArray.from_arrays(at, stop[np.concatenate(ends)])]

    kinds = (("src", T.LongType()), ("close", T.BooleanType()), ("dst", T.ArrayType(T.LongType(), False)))
    schema = T.StructType([T.StructField(c, kind, False) for c, kind in kinds])  # columns that can't be null are written faster
    d = by_tile(points.select("stop", "lon", "lat").distinct(), 2 * radius, 1, run, schema, TILES)
    return d.select("src", F.explode("dst").alias("dst"), "close")  # a row for each place and not for each pair comes from Python
