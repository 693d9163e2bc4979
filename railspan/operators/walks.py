"""Walks between places near each other, made from positions when labels need them: the pairs are never a table."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import KX, KY, WALK_MPS, walk_cost
from .spatial import radius_join

#: Cells across a radius in the search of one task, metres that a cell's edge may be off by rounding, and pairs that are tested at once.
PARTS, SLIP, AT_ONCE = 10, 1e-3, 4_000_000


@dataclass
class FootWalks:
    """Walks between any two places (stop, lon, lat) within radius metres; a walk takes walk_cost seconds."""

    places: DataFrame
    radius: float

    def joined(self, labels: DataFrame, meet: DataFrame | None = None) -> DataFrame:
        """(src, dst, best, cost) of all walks from labels (stop, best); with meet (stop, best), of those that end at just the label of meet."""
        at = self.places.select("stop", "lon", "lat")
        left = at.join(labels.select("stop", "best"), "stop").withColumnRenamed("stop", "src")
        right = at if meet is None else at.join(meet.select("stop", F.col("best").alias("reach")), "stop")
        right = right.withColumnsRenamed({"stop": "dst", "lon": "rlon", "lat": "rlat"})
        d = radius_join(left, right, self.radius).where("src <> dst").withColumn("cost", walk_cost(F.col("m")))
        if meet is not None:
            d = d.where("reach > best and reach = best + cost")
        return d.select("src", "dst", "best", "cost")


def seconds(m: np.ndarray) -> np.ndarray:
    """walk_cost over an array."""
    return np.rint(np.maximum(300.0, 90.0 + 1.25 * m / WALK_MPS)).astype(np.int64)


class Relaxer:
    """One walk from every changed label, over the places of one task. Cells whose earliest walk can't beat a cell's latest label are not tested pair by pair."""

    def __init__(self, stop: np.ndarray, lon: np.ndarray, lat: np.ndarray, radius: float) -> None:
        ok = ~(np.isnan(lon) | np.isnan(lat))
        stop, lon, lat = stop[ok], lon[ok], lat[ok]
        side = radius / PARTS
        cx, cy = (np.floor(v * k / side).astype(np.int64) for v, k in ((lon, KX), (lat, KY)))
        if len(cx):
            cx, cy = cx - cx.min(), cy - cy.min()
        self.wide = int(cy.max(initial=0)) + 2 * PARTS + 4  # rows of cells do not run into each other
        cell = cx * self.wide + cy
        order = np.argsort(cell, kind="stable")
        self.stop, self.lon, self.lat, self.cell = stop[order], lon[order], lat[order], cell[order]
        self.cells, self.head = np.unique(self.cell, return_index=True)
        self.size = np.diff(np.append(self.head, len(self.cell)))
        self.radius = radius
        self.steps = []
        for i in range(-PARTS - 1, PARTS + 2):
            for j in range(-PARTS - 1, PARTS + 2):
                least = max(0.0, side * np.hypot(max(abs(i) - 1, 0), max(abs(j) - 1, 0)) - SLIP)
                if least <= radius:
                    self.steps.append((least, side * np.hypot(abs(i) + 1, abs(j) + 1) + SLIP, i * self.wide + j))
        self.steps.sort()

    def relax(self, best: np.ndarray, changed: np.ndarray, deadline: int) -> np.ndarray:
        """best after one walk from every changed label."""
        out = best.copy()
        label = best[self.stop]
        src = np.flatnonzero(changed[self.stop] & (label + int(seconds(np.zeros(1))[0]) <= deadline))
        if not len(src):
            return out
        src = src[np.lexsort((label[src], self.cell[src]))]
        from_, head = np.unique(self.cell[src], return_index=True)
        first, rank = label[src][head], np.searchsorted(from_, self.cell[src])
        span = deadline + 1 - int(label[src].min())
        base = int(label[src].min())
        key = rank * (span + 1) + (label[src] - base)  # sources by cell, then label
        bound = np.minimum(np.maximum.reduceat(label, self.head), deadline)
        meets = []
        for least, most, step in self.steps:
            at = np.searchsorted(self.cells, from_ + step)
            s = np.flatnonzero((at < len(self.cells)) & (self.cells[np.minimum(at, len(self.cells) - 1)] == from_ + step))
            t = at[s]
            if most <= self.radius:
                bound[t] = np.minimum(bound[t], first[s] + seconds(np.array([most]))[0])
            meets.append((least, step, s.astype(np.int32), t.astype(np.int32)))
        for least, _, s, t in meets:
            room = bound[t] - int(seconds(np.array([least]))[0])
            use = first[s] <= room
            s, t, room = s[use], t[use], room[use]
            if not len(s):
                continue
            n = np.searchsorted(key, s.astype(np.int64) * (span + 1) + (room - base), "right") - head[s]
            work = np.cumsum(n * self.size[t])
            for a, b in _parts(work):
                u, k = _spread(head[s[a:b]], n[a:b])
                v, k2 = _spread(self.head[t[a:b]][k], self.size[t[a:b]][k])
                u = src[u][k2]
                x, y = (self.lon[u] - self.lon[v]) * KX, (self.lat[u] - self.lat[v]) * KY
                m = np.sqrt(x * x + y * y)
                got = label[u] + seconds(m)
                ok = (m <= self.radius) & (got <= deadline) & (got < label[v])
                np.minimum.at(out, self.stop[v[ok]], got[ok])
        return out


def _parts(work: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of about AT_ONCE pairs by their running sum; one item may be more."""
    marks = np.unique(np.searchsorted(work, np.arange(AT_ONCE, int(work[-1]) + AT_ONCE, AT_ONCE), "left") + 1)
    marks = np.unique(np.minimum(np.concatenate([[0], marks, [len(work)]]), len(work))).tolist()
    return list(zip(marks[:-1], marks[1:], strict=True))


def _spread(head: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers head, head + 1, ... of each range of n, and which range each is of."""
    of = np.repeat(np.arange(len(n)), n)
    return head[of] + np.arange(len(of)) - (np.cumsum(n) - n)[of], of
