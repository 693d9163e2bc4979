"""Geometry and travel-time expressions; all stay inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres of a degree on the flat projection, at the latitude that the tables use.
REF_LAT = 35.7
KX, KY = round(111320 * math.cos(math.radians(REF_LAT)), 6), 111132.0
EARTH_M = 6371000.0
#: Walking: metres a second, detour factor over the straight line.
WALK_MPS, DETOUR = 80.0 / 60, 1.3


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(a))


def flat_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Distance on the flat projection. Products, since pow is a call for each pair; a square is the same number either way."""
    dx, dy = (lon1 - lon2) * F.lit(KX), (lat1 - lat2) * F.lit(KY)
    return F.sqrt(dx * dx + dy * dy)


def round3(x: Column) -> Column:
    """round(x, 3). Spark rounds through decimal text; that is left for numbers near a tie and large ones, where the product could be on the wrong side."""
    y = x * 1000
    plain = (F.abs(x) < 1e5) & (F.abs(y - F.floor(y) - 0.5) > 1e-6)
    return F.when(plain, F.rint(y) / 1000).otherwise(F.round(x, 3))


def walk_seconds(m: Column) -> Column:
    return m * F.lit(DETOUR) / F.lit(WALK_MPS)


def walk_cost(m: Column, least: float = 300, base: float = 90, detour: float = 1.25) -> Column:
    """Whole seconds of a transfer on foot, rounded half to even, never under the least."""
    return F.rint(F.greatest(F.lit(float(least)), F.lit(float(base)) + F.lit(detour) * m / F.lit(WALK_MPS))).cast("bigint")


def cell_of(lon: Column, lat: Column, lon0: float, lat0: float, size_m: float, width: int, height: int) -> Column:
    """Number of the grid cell that holds a point, -1 outside."""
    x, y = F.floor((lon - lon0) * F.lit(KX) / size_m), F.floor((lat - lat0) * F.lit(KY) / size_m)
    return F.when((x >= 0) & (x < width) & (y >= 0) & (y < height), y * width + x).otherwise(F.lit(-1)).cast("bigint")


def cell_center(cell: Column, lon0: float, lat0: float, size_m: float, width: int) -> tuple[Column, Column]:
    return F.lit(lon0) + (cell % width + 0.5) * size_m / F.lit(KX), F.lit(lat0) + (F.floor(cell / width) + 0.5) * size_m / F.lit(KY)


def turn_deg(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Change of direction at b on the way a, b, c, in degrees; 0 where a step has no length."""
    ux, uy, vx, vy = bx - ax, by - ay, cx - bx, cy - by
    norm = F.sqrt((ux * ux + uy * uy) * (vx * vx + vy * vy))
    return F.when(norm > 0, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ux * vx + uy * vy) / norm))))).otherwise(0.0)


def segment_m(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment, all in metres."""
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    t = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / n))).otherwise(0.0)
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def phase_of(key: Column, headway: Column) -> Column:
    """A stable phase under the headway: a base-131 hash of the key's code points in 32 bits."""
    return F.aggregate(F.split(key, ""), F.lit(0).cast("bigint"), lambda h, c: (h * 131 + F.ascii(c)).bitwiseAND(F.lit(0xFFFFFFFF))) % headway


def leg_seconds(metres: Column, top_kmh: Column, accel: float = 0.7, dwell: float = 30.0) -> Column:
    """Time of a leg that starts and ends at rest under constant acceleration and a top speed, with the dwell."""
    v = top_kmh / 3.6
    ramp = v * v / accel
    return F.when(metres >= ramp, metres / v + v / accel).otherwise(2 * F.sqrt(metres / accel)) + dwell


def hhmm(sec: Column) -> Column:
    """25:13 for 90,780 s: hours go past 24."""
    return F.concat_ws(":", F.lpad(F.floor(sec / 3600).cast("string"), 2, "0"), F.lpad(F.floor(sec % 3600 / 60).cast("string"), 2, "0"))


def parse_hhmm(text: Column, before_hours: int = 30) -> Column:
    """Seconds of H:MM or HH:MM under the given hours; null for anything else."""
    h, m = (F.regexp_extract(text, r"^(\d{1,2}):(\d{2})$", i) for i in (1, 2))
    ok = text.rlike(r"^\d{1,2}:[0-5]\d$")
    sec = F.when(ok, F.when(ok, h).otherwise("0").cast("int") * 3600 + F.when(ok, m).otherwise("0").cast("int") * 60)
    return F.when(sec < before_hours * 3600, sec).cast("bigint")
