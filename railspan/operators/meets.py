"""Which places meet at a third one, over the places of one task, without making the ways between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from ..functions.geo import KX, KY
from .walks import _spread

#: Bytes of a task's rows of bits, pairs that are tested at once, places of a cell that are aimed at, and metres that a bound may be off by rounding.
BYTES, TESTS, FULL, SLIP = 128_000_000, 1_000_000, 8, 1e-3
#: Levels of cells, each twice as wide; windows of fine cells around a point, and where on the way between two places, from -1 to 1, they are looked up.
LEVELS, WINDOWS, ALONG = 4, 12, (np.array([-0.35, 0.35]), np.array([-0.7, -0.55, -0.2, 0.0, 0.2, 0.55, 0.7]), np.linspace(-0.95, 0.95, 30))


class Meets:
    """Places in order of their numbers. Places s < d meet at a place v > d within radius metres of both; they are close if the way over some such v is under close metres.

    A place v has a row of bits: the places d < v near it. The rows of the places near s, laid over each other, are what meets s. Cells of
    places that are all near s are laid over each other once, so that only the places at the rim of the radius are taken one by one. Whether a pair is close
    is read from the greatest number in a square inside the ellipse of the ways under close; pairs that this leaves open are tested by all places.
    """

    def __init__(self, lon: np.ndarray, lat: np.ndarray, own: np.ndarray, radius: float, close: float) -> None:
        if not 0 < close <= radius:
            raise ValueError("close must be over 0 and at most the radius")
        self.lon, self.lat, self.radius, self.close = lon, lat, radius, close
        self.x, self.y = lon * KX, lat * KY
        self.limit = _square_limit(radius)
        mine = np.flatnonzero(own)
        box = [(v >= v[mine].min() - radius - SLIP) & (v <= v[mine].max() + radius + SLIP) for v in (self.x, self.y)]
        mid = np.flatnonzero(box[0] & box[1])
        x, y = self.x[mid], self.y[mid]
        dense = len(mid) / max((np.ptp(x) + radius / 8) * (np.ptp(y) + radius / 8), 1.0)
        self.side = radius / 2.0 ** np.clip(np.rint(np.log2(radius * np.sqrt(dense / FULL))), 1, 5)
        key = _mixed(np.floor((x - x.min()) / self.side).astype(np.int64), np.floor((y - y.min()) / self.side).astype(np.int64))
        order = np.argsort(key, kind="stable")
        key, self.mid = key[order], mid[order]  # by cell, and the cells of a wider one together
        self.own = own[self.mid]
        self.mx, self.my, self.mlon, self.mlat = self.x[self.mid], self.y[self.mid], lon[self.mid], lat[self.mid]
        self.heads, self.ups, self.boxes = [], [], []
        for k in range(LEVELS):
            cells, head = np.unique(key >> (2 * k), return_index=True)
            self.heads.append(np.append(head, len(key)))
            self.boxes.append([f.reduceat(v, head) for v in (self.mx, self.my) for f in (np.minimum, np.maximum)])
            self.ups.append(np.searchsorted(np.unique(cells >> 2), cells >> 2))
        self._windows()

    def _windows(self) -> None:
        """The greatest number in the square of 2 w + 1 fine cells to a side, for each w and each cell in its middle."""
        self.fine, self.x0, self.y0 = self.side / 4, self.mx.min(), self.my.min()
        cx, cy = (np.floor(v / self.fine).astype(np.int64) for v in (self.mx - self.x0, self.my - self.y0))
        self.wide, tall = int(cx.max()) + 1, int(cy.max()) + 1
        most = np.full((self.wide, tall), -1, np.int32)
        np.maximum.at(most, (cx, cy), self.mid.astype(np.int32))
        out = [most]
        for _ in range(WINDOWS - 1):
            p = np.pad(out[-1], 1, constant_values=-1)
            p = np.maximum(np.maximum(p[:-2], p[1:-1]), p[2:])
            out.append(np.maximum(np.maximum(p[:, :-2], p[:, 1:-1]), p[:, 2:]))
        self.most, self.tall = np.stack(out).ravel(), tall

    def pairs(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(s, those that are close, the others): the places that own places s meet, in pieces."""
        n = len(self.lon)
        parts = max(1, -(-n * len(self.mid) // (8 * BYTES)))
        edges = np.linspace(0, n, parts + 1).astype(int).tolist()
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if hi > lo:
                yield from self._part(lo, hi)

    def _part(self, lo: int, hi: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """pairs with places lo to hi."""
        rows = [self._rows(lo, hi)]
        laid = rows[0]
        for k in range(LEVELS):
            head = self.heads[0][:-1] if k == 0 else np.flatnonzero(np.diff(self.ups[k - 1], prepend=-1))
            laid = np.bitwise_or.reduceat(laid, head, axis=0)
            rows.append(laid)
        head = self.heads[0]
        start = np.searchsorted(np.flatnonzero(self.own), head)
        for a in np.flatnonzero(start[1:] > start[:-1]):
            at = np.arange(head[a], head[a + 1])
            at = at[self.own[at] & (self.mid[at] < hi - 1)]
            if len(at):
                yield from self._cell(a, at, rows, lo, hi)

    def _rows(self, lo: int, hi: int) -> np.ndarray:
        """For each place of mid, bits of the places lo to hi that are near it and less."""
        words = -(-(hi - lo) // 64)
        bits = np.zeros((len(self.mid), words), np.uint64)
        side = self.side
        x, y = self.x[lo:hi], self.y[lo:hi]
        x0, y0 = x.min(), y.min()
        cx, cy = (np.floor(v / side).astype(np.int64) for v in (x - x0, y - y0))
        tall = int(cy.max()) + 1
        order = np.argsort(cx * tall + cy, kind="stable")
        head = np.searchsorted((cx * tall + cy)[order], np.arange((int(cx.max()) + 1) * tall + 1))
        lon, lat = self.lon[lo:hi], self.lat[lo:hi]
        reach = self.radius + SLIP
        level = min(1, LEVELS - 1)
        ends, (bx0, bx1, by0, by1) = self.heads[level], self.boxes[level]
        x_lo, x_hi = (np.clip(np.floor((v - x0) / side), 0, cx.max()).astype(int) for v in (bx0 - reach, bx1 + reach))
        y_lo, y_hi = (np.clip(np.floor((v - y0) / side), 0, tall - 1).astype(int) for v in (by0 - reach, by1 + reach))
        for g in range(len(ends) - 1):
            at = np.arange(ends[g], ends[g + 1])
            at = at[self.mid[at] > lo]
            if not len(at):
                continue
            d = np.concatenate([order[head[c * tall + y_lo[g]] : head[c * tall + y_hi[g] + 1]] for c in range(x_lo[g], x_hi[g] + 1)])
            if not len(d):
                continue
            size = max(1, TESTS // max(len(d), words * 64))
            for k in range(0, len(at), size):
                v = at[k : k + size]
                near = self._squares(self.mlon[v], self.mlat[v], lon[d], lat[d]) <= self.limit
                near &= d < (self.mid[v] - lo)[:, None]
                flags = np.zeros((len(v), words * 64), bool)
                flags[:, d] = near
                bits[v] = np.packbits(flags, axis=1, bitorder="little").view(np.uint64)
        return bits

    @staticmethod
    def _squares(lon: np.ndarray, lat: np.ndarray, rlon: np.ndarray, rlat: np.ndarray) -> np.ndarray:
        x, y = np.subtract.outer(lon, rlon), np.subtract.outer(lat, rlat)
        x *= KX
        y *= KY
        x *= x
        y *= y
        x += y
        return x

    def _cell(self, a: int, at: np.ndarray, rows: list[np.ndarray], lo: int, hi: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """pairs of the own places at of cell a with places lo to hi."""
        x0, x1, y0, y1 = (b[a] for b in self.boxes[0])
        base = np.zeros(rows[0].shape[1], np.uint64)
        above = None
        for k in range(LEVELS - 1, -1, -1):
            bx0, bx1, by0, by1 = self.boxes[k]
            far = np.maximum(bx1 - x0, x1 - bx0) ** 2 + np.maximum(by1 - y0, y1 - by0) ** 2
            sure = far <= (self.radius - SLIP) ** 2
            use = np.flatnonzero(sure if above is None else sure & ~above[self.ups[k]])
            if len(use):
                base |= np.bitwise_or.reduce(rows[k + 1][use], axis=0)
            above = sure
        bx0, bx1, by0, by1 = self.boxes[0]
        apart = np.maximum(np.maximum(bx0 - x1, x0 - bx1), 0) ** 2 + np.maximum(np.maximum(by0 - y1, y0 - by1), 0) ** 2
        cells = np.flatnonzero(apart <= (self.radius + SLIP) ** 2)
        count = self.heads[0][cells + 1] - self.heads[0][cells]
        near, of = _spread(self.heads[0][cells], count)
        use = self.mid[near] >= lo
        near, rim = near[use], ~sure[cells][of[use]]
        if not len(near):
            return
        number = self.mid[near]
        lon, lat = self.mlon[near], self.mlat[near]
        size = max(1, TESTS // len(near))
        for k in range(0, len(at), size):
            part = at[k : k + size]
            square = self._squares(self.mlon[part], self.mlat[part], lon, lat)
            ok = square <= self.limit
            every = ok.all(axis=0)
            alone = rim & ~every
            every &= rim
            shared = near[every]
            laid = base | np.bitwise_or.reduce(rows[0][shared], axis=0) if len(shared) else base
            ok &= number > self.mid[part][:, None]
            close = self._close(part, near, number, square, ok, hi)
            ok &= alone
            for r, p in enumerate(part.tolist()):
                s = int(self.mid[p])
                met = np.bitwise_or.reduce(rows[0][near[ok[r].nonzero()[0]]], axis=0)
                met |= laid
                flags = np.unpackbits(met.view(np.uint8), bitorder="little").view(bool)
                if s >= lo:
                    flags[: s - lo + 1] = False
                short = number[close[r].nonzero()[0]]
                flags[short - lo] = False
                yield s, short, flags.nonzero()[0] + lo

    def _close(self, part: np.ndarray, near: np.ndarray, number: np.ndarray, square: np.ndarray, ok: np.ndarray, hi: int) -> np.ndarray:
        """Which of the pairs part x near that are ok and under hi are close."""
        x, y = self.mx[part] - self.x0, self.my[part] - self.y0
        rx, ry = self.mx[near] - self.x0, self.my[near] - self.y0
        cx, cy = (x.min() + x.max()) / 2, (y.min() + y.max()) / 2
        slack = np.hypot(np.ptp(x), np.ptp(y)) / 4 + SLIP  # from the middle of a pair to that of the part's middle and the other place
        room = np.sqrt(np.maximum(self.close**2 - square.max(axis=0), 0)) / 2 - slack
        all_close = self._seen((cx + rx) / 2, (cy + ry) / 2, room) > number
        found = ok & (number < hi)
        left = found & ~all_close
        left &= square < self.close**2
        found &= all_close
        i, j = left.nonzero()
        if len(i):
            v, gx, gy, hx, hy, least = square[i, j], x[i], y[i], rx[j], ry[j], number[j]
            room = np.sqrt(self.close**2 - v) / 2
            got = self._seen((gx + hx) / 2, (gy + hy) / 2, room - SLIP) > least
            for along in ALONG:
                go = (~got).nonzero()[0]
                if len(go):
                    got[go] = self._tried(part[i[go]], near[j[go]], room[go], along[:, None])
            found[i[got], j[got]] = True
            go = (~got).nonzero()[0]
            if len(go):
                self._tested(i[go], j[go], near, number, square, ok, found)
        return found

    def _tried(self, a: np.ndarray, b: np.ndarray, room: np.ndarray, along: np.ndarray) -> np.ndarray:
        """Whether the pairs of places a and b are close by the greatest of the places near points on the way."""
        x, y = self.mx[a] - self.x0, self.my[a] - self.y0
        dx, dy = (self.mx[b] - self.mx[a]) * ((1 + along) / 2), (self.my[b] - self.my[a]) * ((1 + along) / 2)
        w = np.clip((np.sqrt(1 - along * along) * room) / (self.fine * np.sqrt(2)), 1, WINDOWS).astype(np.int64)
        via = self.most[self._at(x + dx, y + dy, w)]
        way = self._metres(self.mlon[a], self.mlat[a], self.lon[via], self.lat[via])
        way += self._metres(self.mlon[b], self.mlat[b], self.lon[via], self.lat[via])
        return ((way < self.close) & (via > self.mid[b])).any(axis=0)

    @staticmethod
    def _metres(lon: np.ndarray, lat: np.ndarray, rlon: np.ndarray, rlat: np.ndarray) -> np.ndarray:
        x, y = (lon - rlon) * KX, (lat - rlat) * KY
        return np.sqrt(x * x + y * y)

    def _at(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Where the square of window w - 1 around x and y stands."""
        at = np.minimum((x / self.fine).astype(np.int64), self.wide - 1)
        at += (w - 1) * self.wide
        at *= self.tall
        at += np.minimum((y / self.fine).astype(np.int64), self.tall - 1)
        return at

    def _seen(self, x: np.ndarray, y: np.ndarray, room: np.ndarray) -> np.ndarray:
        """A number of a place within room metres of x and y, the greatest of a square; -1 without one."""
        w = np.minimum(room / (self.fine * np.sqrt(2)), WINDOWS).astype(np.int64)
        return np.where(w > 0, self.most[self._at(x, y, np.maximum(w, 1))], -1)

    def _tested(self, i: np.ndarray, j: np.ndarray, near: np.ndarray, number: np.ndarray, square: np.ndarray, ok: np.ndarray, found: np.ndarray) -> None:
        """Tests pairs i, j by all places that may be between."""
        ends = np.searchsorted(i, np.arange(len(square) + 1)).tolist()
        thin = square[i, j] >= (0.99 * self.close) ** 2
        for r in range(len(square)):
            of, slim = j[ends[r] : ends[r + 1]], thin[ends[r] : ends[r + 1]]
            for d in (of[slim], of[~slim]):
                if not len(d):
                    continue
                via = (ok[r] & (number > number[d].min())).nonzero()[0]
                if not len(via):
                    continue
                m = np.sqrt(square[r][via])
                size = max(1, TESTS // len(via))
                for k in range(0, len(d), size):
                    e = d[k : k + size]
                    way = np.sqrt(self._squares(self.mlon[near[e]], self.mlat[near[e]], self.mlon[near[via]], self.mlat[near[via]]))
                    way += m
                    found[r, e] = ((way < self.close) & (number[via] > number[e][:, None])).any(axis=1)


def _square_limit(radius: float) -> float:
    """The greatest number whose root is at most radius."""
    v = radius * radius
    while np.sqrt(v) > radius:
        v = np.nextafter(v, 0)
    while np.sqrt(np.nextafter(v, np.inf)) <= radius:
        v = np.nextafter(v, np.inf)
    return float(v)


def _mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The bits of x and y in turn."""
    out = np.zeros(len(x), np.int64)
    for k in range(int(max(x.max(initial=0), y.max(initial=0))).bit_length()):
        out |= ((x >> k) & 1) << (2 * k + 1) | ((y >> k) & 1) << (2 * k)
    return out
