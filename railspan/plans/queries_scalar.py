"""Scalar, array and order-dependent functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import geo
from ..operators import folds, spatial
from ..registry import query
from ..sources.bindings import ORIGIN_LAT, ORIGIN_LON, Tables


@query("m01_haversine", f"SELECT stop, round(2 * 6371000.0 * asin(sqrt(pow(sin(radians({ORIGIN_LAT} - lat) / 2), 2) + cos(radians(lat)) * cos(radians({ORIGIN_LAT})) * pow(sin(radians({ORIGIN_LON} - lon) / 2), 2))), 3) AS m FROM stops")
def m01(t: Tables) -> DataFrame:
    return t.stops.select("stop", F.round(geo.haversine_m(F.col("lon"), F.col("lat"), F.lit(ORIGIN_LON), F.lit(ORIGIN_LAT)), 3).alias("m"))


@query("m03_walk_cost", "SELECT a, b, CAST(round_even(greatest(300, 90 + 1.25 * m / (80.0 / 60)), 0) AS BIGINT) AS cost, round(m * 1.3 / (80.0 / 60), 3) AS walk FROM near")
def m03(t: Tables) -> DataFrame:
    return t.near.select("a", "b", geo.walk_cost(F.col("m")).alias("cost"), geo.round3(geo.walk_seconds(F.col("m"))).alias("walk"))


@query("m04_cell_index", f"SELECT stop, CASE WHEN x >= 0 AND x < 60 AND y >= 0 AND y < 60 THEN CAST(y * 60 + x AS BIGINT) ELSE -1 END AS cell FROM (SELECT stop, floor((lon - 139.6) * {geo.KX} / 400) AS x, floor((lat - 35.55) * {geo.KY} / 400) AS y FROM stops)")
def m04(t: Tables) -> DataFrame:
    return t.stops.select("stop", geo.cell_of(F.col("lon"), F.col("lat"), 139.6, 35.55, 400, 60, 60).alias("cell"))


@query("m05_cell_center", f"SELECT cell, round(139.6 + (x + 0.5) * 400 / {geo.KX}, 6) AS lon, round(35.55 + (y + 0.5) * 400 / {geo.KY}, 6) AS lat FROM (SELECT cell, cell % 60 AS x, cell // 60 AS y FROM (SELECT DISTINCT x * 60 + y AS cell FROM cells WHERE x < 60 AND y < 60))")
def m05(t: Tables) -> DataFrame:
    """Cell number to position."""
    c = t.cells.where("x < 60 and y < 60").select((F.col("x") * 60 + F.col("y")).alias("cell"))
    lon, lat = geo.cell_center(F.col("cell"), 139.6, 35.55, 400, 60)
    return c.select("cell", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query("m06_leg_seconds", "SELECT stop, round(CASE WHEN m >= v * v / 0.7 THEN m / v + v / 0.7 ELSE 2 * sqrt(m / 0.7) END + 30, 4) AS sec FROM (SELECT stop, CAST(size AS DOUBLE) * 100 AS m, (40.0 + line) / 3.6 AS v FROM stops)")
def m06(t: Tables) -> DataFrame:
    """Leg time under acceleration, top speed and dwell."""
    return t.stops.select("stop", F.round(geo.leg_seconds(F.col("size").cast("double") * 100, 40.0 + F.col("line")), 4).alias("sec"))


@query("m07_midday_share", "SELECT stop, round(CASE WHEN size <= 10 THEN 1.0 WHEN size >= 40 THEN 0.55 ELSE 1.0 - (size - 10) * 0.45 / 30 END, 6) AS share FROM stops")
def m07(t: Tables) -> DataFrame:
    """A piecewise-linear share."""
    s = F.col("size")
    return t.stops.select("stop", F.round(F.when(s <= 10, 1.0).when(s >= 40, 0.55).otherwise(1.0 - (s - 10) * 0.45 / 30), 6).alias("share"))


@query("m08_phase", "SELECT stop, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(operator || '東', ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: (h * 131 + c) & 4294967295) % (600 + line) AS phase FROM stops")
def m08(t: Tables) -> DataFrame:
    return t.stops.select("stop", geo.phase_of(F.concat("operator", F.lit("東")), 600 + F.col("line")).alias("phase"))


@query("m09_turn", "SELECT trip, seq, round(degrees(acos(greatest(-1.0, least(1.0, (ux * vx + uy * vy) / sqrt((ux * ux + uy * uy) * (vx * vx + vy * vy)))))), 3) AS deg FROM (SELECT trip, seq, CAST(stop % 50 - lag(stop % 50) OVER w AS DOUBLE) AS ux, 1.0 AS uy, CAST(lead(stop % 50) OVER w - stop % 50 AS DOUBLE) AS vx, 1.0 AS vy FROM events WINDOW w AS (PARTITION BY trip ORDER BY seq)) WHERE ux IS NOT NULL AND vx IS NOT NULL")
def m09(t: Tables) -> DataFrame:
    w = W.partitionBy("trip").orderBy("seq")
    x = (F.col("stop") % 50).cast("double")
    d = t.events.select("trip", "seq", F.lag(x).over(w).alias("a"), x.alias("b"), F.lead(x).over(w).alias("c")).where("a is not null and c is not null")
    turn = geo.turn_deg(F.col("a"), F.lit(0.0), F.col("b"), F.lit(1.0), F.col("c"), F.lit(2.0))
    return d.select("trip", "seq", F.round(turn, 3).alias("deg"))


@query("m11_shoelace", "SELECT line, abs(sum(x * ny - nx * y)) AS twice FROM (SELECT line, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM (SELECT line, stop, CAST(stop % 31 AS DOUBLE) AS x, CAST(stop % 37 AS DOUBLE) AS y FROM stops) WINDOW w AS (PARTITION BY line ORDER BY stop)) GROUP BY line")
def m11(t: Tables) -> DataFrame:
    """Twice the area of each ring."""
    w = W.partitionBy("line").orderBy("stop")
    d = t.stops.select("line", "stop", (F.col("stop") % 31).cast("double").alias("x"), (F.col("stop") % 37).cast("double").alias("y"))
    d = d.select("line", "x", "y", F.coalesce(F.lead("x").over(w), F.first("x").over(w)).alias("nx"), F.coalesce(F.lead("y").over(w), F.first("y").over(w)).alias("ny"))
    return d.groupBy("line").agg(F.abs(F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y"))).alias("twice"))


@query("m13_point_segment", f"SELECT a, b, round(sqrt(pow(px - (ax + t * dx), 2) + pow(py - (ay + t * dy), 2)), 3) AS m FROM (SELECT *, greatest(0.0, least(1.0, ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy))) AS t FROM (SELECT a, b, (139.75 - p.lon) * {geo.KX} * 0 + (139.7 - 139.6) * {geo.KX} AS px, (35.7 - 35.55) * {geo.KY} AS py, (p.lon - 139.6) * {geo.KX} AS ax, (p.lat - 35.55) * {geo.KY} AS ay, (q.lon - p.lon) * {geo.KX} AS dx, (q.lat - p.lat) * {geo.KY} AS dy FROM near JOIN stops AS p ON p.stop = a JOIN stops AS q ON q.stop = b)) WHERE dx * dx + dy * dy > 0")
def m13(t: Tables) -> DataFrame:
    """Distance of a point from the segment between each near pair."""
    x = lambda c: (F.col(c) - 139.6) * F.lit(geo.KX)
    y = lambda c: (F.col(c) - 35.55) * F.lit(geo.KY)
    s = t.stops.select("stop", "lon", "lat")
    s = s.join(s.select("stop", F.col("lon").alias("alon"), F.col("lat").alias("alat")), "stop")
    d = spatial.ordered_pairs(s, "stop", 1000.0).where("stop < rstop and (alon <> ralon or alat <> ralat)")
    m = geo.segment_m(F.lit((139.7 - 139.6) * geo.KX), F.lit((35.7 - 35.55) * geo.KY), x("alon"), y("alat"), x("ralon"), y("ralat"))
    return d.select(F.col("stop").alias("a"), F.col("rstop").alias("b"), geo.round3(m).alias("m"))


@query("x14_clock", "SELECT trip, seq, lpad(CAST(arr // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(arr % 3600 // 60 AS VARCHAR), 2, '0') AS clock, CASE WHEN arr // 3600 < 30 THEN arr - arr % 60 END AS parsed FROM events")
def x14(t: Tables) -> DataFrame:
    """Seconds to 25:13 and back; hours of 30 or more are refused."""
    d = t.events.select("trip", "seq", geo.hhmm(F.col("arr")).alias("clock"))
    return d.withColumn("parsed", geo.parse_hhmm(F.col("clock")))


@query("z03_station_index", "SELECT name, idx FROM (SELECT operator AS name, row_number() OVER (ORDER BY operator) - 1 AS idx FROM (SELECT DISTINCT operator FROM stops))")
def z03(t: Tables) -> DataFrame:
    """Dense numbers of sorted names; the distinct names only meet in one task."""
    return t.stops.select(F.col("operator").alias("name")).distinct().select("name", (F.row_number().over(W.orderBy("name")) - 1).alias("idx"))


@query("z06_track_lengths", "SELECT a, b, round(CASE WHEN along BETWEEN 0.9 * m AND 2.0 * m THEN along ELSE m * 1.15 END, 3) AS length FROM (SELECT a, b, m, m * (0.5 + (a * 7 + b) % 20 * 0.1) AS along FROM near)")
def z06(t: Tables) -> DataFrame:
    """Track length where it is plausible, else the straight line with a factor."""
    d = t.near.withColumn("along", F.col("m") * (0.5 + (F.col("a") * 7 + F.col("b")) % 20 * 0.1))
    return d.select("a", "b", geo.round3(F.when(F.col("along").between(0.9 * F.col("m"), 2.0 * F.col("m")), F.col("along")).otherwise(F.col("m") * 1.15)).alias("length"))


@query("z11_resample", "SELECT c.cell, f.land FROM (SELECT cell, x // 2 AS fx, y // 2 AS fy FROM cells) AS c JOIN cells AS f ON f.x = c.fx AND f.y = c.fy")
def z11(t: Tables) -> DataFrame:
    """A raster read through another grid's rows and columns."""
    f = t.cells.select(F.col("x").alias("fx"), F.col("y").alias("fy"), "land")
    c = t.cells.select("cell", F.floor(F.col("x") / 2).alias("fx"), F.floor(F.col("y") / 2).alias("fy"))
    return c.join(f, ["fx", "fy"]).select("cell", "land")


@query("z18_symmetric_min", "SELECT a, b, min(sec) AS sec FROM (SELECT src AS a, dst AS b, sec FROM walk_edges UNION ALL SELECT dst, src, sec FROM walk_edges) GROUP BY a, b")
def z18(t: Tables) -> DataFrame:
    e = t.walk_edges
    return e.select(F.col("src").alias("a"), F.col("dst").alias("b"), "sec").union(e.select("dst", "src", "sec")).groupBy("a", "b").agg(F.min("sec").alias("sec"))


@query("r16_region_box", "SELECT operator, round(min(lon), 4) AS lon0, round(max(lon), 4) AS lon1, round(min(lat), 4) AS lat0, round(max(lat), 4) AS lat1, len(list_distinct(list(line))) AS lines FROM stops GROUP BY operator")
def r16(t: Tables) -> DataFrame:
    d = t.stops.groupBy("operator")
    return d.agg(F.round(F.min("lon"), 4).alias("lon0"), F.round(F.max("lon"), 4).alias("lon1"), F.round(F.min("lat"), 4).alias("lat0"), F.round(F.max("lat"), 4).alias("lat1"), F.countDistinct("line").alias("lines"))


@query("a08_density", "SELECT stop, count(*) AS n FROM (SELECT a AS stop FROM near UNION ALL SELECT b FROM near) GROUP BY stop")
def a08(t: Tables) -> DataFrame:
    return t.density


# --- folds ---------------------------------------------------------------------------------------------------

CLOCK = "SELECT trip, seq, (arr + trip % 3 * 14400) % 86400 - CASE WHEN stop % 23 = 0 THEN 2000 ELSE 0 END AS arr, (dep + trip % 3 * 14400) % 86400 AS dep FROM events"


@query(
    "w06_unwrap",
    f"""WITH RECURSIVE c AS MATERIALIZED ({CLOCK}), r AS (
  SELECT trip, seq, CAST(0 AS BIGINT) AS run, CAST(0 AS BIGINT) AS days, arr AS a, greatest(arr, dep) AS d FROM c WHERE seq = 1
  UNION ALL SELECT c.trip, c.seq, r.run + CASE WHEN c.arr + r.days + n < r.d THEN 1 ELSE 0 END, r.days + n, c.arr + r.days + n, greatest(c.arr, c.dep) + r.days + n
  FROM r JOIN c ON c.trip = r.trip AND c.seq = r.seq + 1, LATERAL (SELECT CASE WHEN c.arr + r.days < r.d - 21600 THEN 86400 ELSE 0 END AS n))
SELECT trip, seq, run, a AS arr, d AS dep FROM (SELECT *, count(*) OVER (PARTITION BY trip, run) AS k FROM r) WHERE k > 1""",
)
def w06(t: Tables) -> DataFrame:
    """Times past midnight unwrapped, runs split where time goes back."""
    d = t.events.select("trip", "seq", (F.expr("(arr + trip % 3 * 14400) % 86400") - F.when(F.col("stop") % 23 == 0, 2000).otherwise(0)).alias("arr"), F.expr("(dep + trip % 3 * 14400) % 86400").alias("dep"))
    return folds.unwrapped(d)


def _ways(t: Tables) -> DataFrame:
    return t.stops.select("line", "stop", ((F.col("lon") - 139.6) * F.lit(geo.KX)).alias("x"), ((F.col("lat") - 35.55) * F.lit(geo.KY)).alias("y"))


@query("r08_simplify")
def r08(t: Tables) -> DataFrame:
    """Ways simplified by Douglas-Peucker with a tolerance of 2 km."""

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        return p[folds.simplified(list(zip(p["x"].tolist(), p["y"].tolist(), strict=True)), 2000.0)][["line", "stop"]]

    return folds.by_group(_ways(t), "line", ["stop"], fold, "line bigint, stop bigint")


@query("r01_insert_cheapest")
def r01(t: Tables) -> DataFrame:
    """Stations put one by one where they lengthen their line least."""

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        order = folds.insertion_order(list(zip(p["x"].tolist(), p["y"].tolist(), strict=True)))
        return pd.DataFrame({"line": p["line"].iloc[0], "pos": range(len(order)), "stop": p["stop"].to_numpy()[order]})

    return folds.by_group(_ways(t), "line", ["stop"], fold, "line bigint, pos bigint, stop bigint")


@query("r04_stitch_ways")
def r04(t: Tables) -> DataFrame:
    """Two-point ways of a pattern chained by their ends."""
    from ..operators.sequences import adjacent

    d = adjacent(t.events.where("pattern > 0"), "trip", "seq", ["stop"]).select("pattern", (F.col("stop") % 60).alias("a"), (F.col("next_stop") % 60).alias("b")).where("a <> b").distinct()

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        got = folds.stitched([list(w) for w in zip(p["a"].tolist(), p["b"].tolist(), strict=True)])
        return pd.DataFrame([(p["pattern"].iloc[0], i, len(c), c[0], c[-1]) for i, c in enumerate(got)], columns=["pattern", "chain", "points", "first", "last"])

    return folds.by_group(d, "pattern", ["a", "b"], fold, "pattern bigint, chain bigint, points bigint, first bigint, last bigint")


@query("g14_fold_lines")
def g14(t: Tables) -> DataFrame:
    """Patterns of a region folded to skeletons that have 70 % of their stations."""
    d = t.events.select((F.col("trip") % 7).alias("region"), F.col("trip"), (F.col("stop") % 12).alias("s")).groupBy("region", "trip").agg(F.sort_array(F.collect_set("s")).alias("s"))

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        got = folds.folded_lines([(str(a), set(b.tolist() if hasattr(b, "tolist") else b)) for a, b in zip(p["trip"].tolist(), p["s"].tolist(), strict=True)])
        return pd.DataFrame([(p["region"].iloc[0], int(a), int(b)) for a, b in got], columns=["region", "trip", "skeleton"])

    return folds.by_group(d, "region", ["trip"], fold, "region bigint, trip bigint, skeleton bigint")


ROUTES = {"a": [0, 1, 2, 3, 4], "b": [3, 4, 5, 6], "c": [6, 7, 0]}


@query(
    "r05_through_route",
    f"""WITH RECURSIVE d AS MATERIALIZED (SELECT trip, seq, stop % 8 AS s FROM events),
p AS MATERIALIZED (SELECT * FROM (VALUES {", ".join(f"('{n}', {s}, {i})" for n, own in ROUTES.items() for i, s in enumerate(own))}) AS v(line, s, pos)),
e AS MATERIALIZED (SELECT trip, seq, d.s, line, pos, lag(d.s) OVER (PARTITION BY trip, line ORDER BY seq) AS unused FROM d JOIN p ON p.s = d.s),
r AS (SELECT trip, seq, s, line, pos, CAST(0 AS BIGINT) AS dir, 0 AS changes, 0 AS bare, CAST(line <> 'a' AS INTEGER) AS off, line AS route FROM e WHERE seq = 1
  UNION ALL SELECT e.trip, e.seq, e.s, e.line, e.pos, CASE WHEN e.line = r.line THEN sign(e.pos - r.pos) ELSE 0 END, r.changes + CAST(e.line <> r.line AS INTEGER),
    r.bare + CAST(e.line <> r.line AND NOT EXISTS (SELECT 1 FROM p WHERE p.line = r.line AND p.s = e.s) AND NOT EXISTS (SELECT 1 FROM p WHERE p.line = e.line AND p.s = r.s) AS INTEGER), r.off + CAST(e.line <> 'a' AS INTEGER), r.route || e.line
  FROM r JOIN e ON e.trip = r.trip AND e.seq = r.seq + 1 WHERE e.line <> r.line OR (e.pos <> r.pos AND r.dir IN (0, sign(e.pos - r.pos))))
SELECT n.trip, arg_min(r.route, (r.changes, r.bare, r.off, r.route)) AS route FROM (SELECT trip, max(seq) AS seq FROM d GROUP BY trip) AS n LEFT JOIN r ON r.trip = n.trip AND r.seq = n.seq GROUP BY n.trip""",
)
def r05(t: Tables) -> DataFrame:
    """Lines of a service's stops with the fewest changes."""
    d = t.events.select("trip", "seq", (F.col("stop") % 8).alias("s"))

    def fold(trip: int, stops: list[int]) -> list[tuple]:
        got = folds.fewest_changes(stops, ROUTES, "a")
        return [(trip, "".join(got) if got else None)]

    return folds.by_short_group(d, "trip", "seq", ["s"], fold, "trip bigint, route string")
