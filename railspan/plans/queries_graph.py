"""Searches, journeys, catchments, fields and timetable synthesis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import geo
from ..operators import graph, spatial
from ..registry import query
from ..sources.bindings import BUDGET, DEPART, GRID, Tables
from . import raptor
from .fixpoint import cut

DEADLINE, LIMIT = DEPART + BUDGET, 3600
ARRIVALS = raptor.arrivals_sql(DEPART, DEADLINE, LIMIT)
CELL_OF = f"least(greatest(CAST(floor((lon - 139.6) / 0.3001 * {2 * GRID}) AS BIGINT), 0), {2 * GRID - 1})", f"least(greatest(CAST(floor((lat - 35.55) / 0.2999 * {2 * GRID}) AS BIGINT), 0), {2 * GRID - 1})"


def arrivals(t: Tables, budget: int = BUDGET) -> DataFrame:
    return raptor.earliest_arrivals(t.events, t.walks, t.access, DEPART, DEPART + budget, LIMIT)


@query("g01_earliest_arrivals", f"WITH {ARRIVALS} SELECT stop, best FROM arrivals")
def g01(t: Tables) -> DataFrame:
    """Earliest arrival at every stop within an hour of 09:00: access on foot, trains, one walk a change, to the fixpoint."""
    return arrivals(t)


@query("a05_reached_groups", f"WITH {ARRIVALS} SELECT count(DISTINCT cluster) AS reached, count(DISTINCT line) AS lines FROM arrivals JOIN stops USING (stop)")
def a05(t: Tables) -> DataFrame:
    return arrivals(t).join(t.stops, "stop").agg(F.countDistinct("cluster").alias("reached"), F.countDistinct("line").alias("lines"))


TRACE = f"""{ARRIVALS},
onb AS (SELECT e.trip, e.seq, e.stop, e.arr, max(CASE WHEN r.best + 60 <= dep AND dep <= {DEADLINE} THEN e.seq END) OVER (PARTITION BY trip ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS boarded FROM ev AS e LEFT JOIN arrivals AS r ON r.stop = e.stop),
cand AS (SELECT stop, best AS t, 1 AS kind, CAST(NULL AS BIGINT) AS prev, CAST(NULL AS BIGINT) AS trip, CAST(NULL AS BIGINT) AS board, CAST(NULL AS BIGINT) AS alight FROM a0
  UNION ALL SELECT dst, best + cost, 2, src, NULL, NULL, NULL FROM arrivals JOIN transfers ON src = stop
  UNION ALL SELECT o.stop, o.arr, 3, b.stop, o.trip, o.boarded, o.seq FROM onb AS o JOIN ev AS b ON b.trip = o.trip AND b.seq = o.boarded),
traced AS MATERIALIZED (SELECT stop, best, kind, prev, trip, board, alight FROM (SELECT c.*, a.best, row_number() OVER (PARTITION BY c.stop ORDER BY kind, coalesce(prev, -1), coalesce(c.trip, -1), coalesce(alight, -1)) AS r FROM cand AS c JOIN arrivals AS a ON a.stop = c.stop AND a.best = c.t) WHERE r = 1)"""


def traced(t: Tables) -> DataFrame:
    ev, tr, ac = t.events, t.walks, t.access
    return graph.trace(arrivals(t), ev, tr, ac, DEPART, DEADLINE, LIMIT)


@query("g02_trace", f"WITH {TRACE} SELECT * FROM traced")
def g02(t: Tables) -> DataFrame:
    """How each arrival came about."""
    return traced(t)


FAR = "(SELECT stop FROM traced ORDER BY best DESC, stop LIMIT 1)"


@query("q02_journey", f"WITH RECURSIVE {TRACE}, j AS (SELECT 0 AS leg, stop, best, kind, prev, trip, board, alight FROM traced WHERE stop = {FAR} UNION ALL SELECT j.leg + 1, t.stop, t.best, t.kind, t.prev, t.trip, t.board, t.alight FROM j JOIN traced AS t ON t.stop = j.prev WHERE j.leg < 39) SELECT * FROM j")
def q02(t: Tables) -> DataFrame:
    """The journey to the last stop reached, leg by leg."""
    d = cut(traced(t))
    last = d.orderBy(F.col("best").desc(), "stop").limit(1).first()
    return graph.reconstruct(d, last["stop"] if last else -1)


@query("t03_best_destination", f"WITH {ARRIVALS} SELECT stop, least(CAST(best - {DEPART} + trunc(m * 0.975) AS BIGINT), CAST(trunc(direct) AS BIGINT)) AS sec, direct <= best - {DEPART} + m * 0.975 AS on_foot FROM (SELECT a.stop, best, sqrt(pow((lon - 139.78) * {geo.KX}, 2) + pow((lat - 35.68) * {geo.KY}, 2)) AS m, 3200.0 * 0.975 AS direct FROM arrivals AS a JOIN stops USING (stop)) ORDER BY best - {DEPART} + m * 0.975, stop LIMIT 1")
def t03(t: Tables) -> DataFrame:
    """The stop that gets to a destination first by train and on foot, against walking all the way. Arrivals are as many as stops, so neither is broadcast."""
    m = geo.flat_m(F.col("lon"), F.col("lat"), F.lit(139.78), F.lit(35.68))
    d = arrivals(t).hint("merge").join(t.stops.select("stop", "lon", "lat"), "stop").select("stop", "best", m.alias("m"))
    total, direct = F.col("best") - DEPART + F.col("m") * 0.975, F.lit(3200.0 * 0.975)
    d = d.orderBy(total, "stop").limit(1)
    return d.select("stop", F.least(F.col("best") - DEPART + F.floor(F.col("m") * 0.975), F.floor(direct)).alias("sec"), (direct <= total).alias("on_foot"))


# --- walking ------------------------------------------------------------------------------------------------

WALK_LIMIT = 600
STATION = f"st AS (SELECT stop, {CELL_OF[0]} AS x, {CELL_OF[1]} AS y FROM stops), sc AS (SELECT st.*, cell FROM st JOIN cells AS c ON c.x = st.x AND c.y = st.y AND c.land)"


def _sheds_sql(limit: int) -> str:
    parts, rounds = ["d0 AS (SELECT stop, cell, CAST(0 AS BIGINT) AS sec FROM sc)"], limit // 60
    for k in range(1, rounds + 1):
        parts.append(f"d{k} AS MATERIALIZED (SELECT stop, cell, min(sec) AS sec FROM (SELECT * FROM d{k - 1} UNION ALL SELECT stop, dst, d.sec + e.sec FROM d{k - 1} AS d JOIN walk_edges AS e ON e.src = d.cell WHERE d.sec + e.sec <= {limit}) GROUP BY stop, cell)")
    return f"{STATION}, {', '.join(parts)}, sheds AS (SELECT * FROM d{rounds})"


SHEDS = _sheds_sql(WALK_LIMIT)


def _stations(t: Tables) -> DataFrame:
    at = lambda c, lo, span: F.least(F.greatest(F.floor((F.col(c) - lo) / span * (2 * GRID)), F.lit(0).cast("bigint")), F.lit(2 * GRID - 1).cast("bigint"))
    st = t.stops.select("stop", at("lon", 139.6, 0.3001).alias("x"), at("lat", 35.55, 0.2999).alias("y"))
    return st.join(t.cells.where("land"), ["x", "y"]).select("stop", "cell", "x", "y")


def sheds(t: Tables) -> DataFrame:
    return graph.walksheds(_stations(t), t.walk_edges, t.cells.where("land"), WALK_LIMIT, WALK_LIMIT // 60 + 1)


@query("g03_bounded_walk", f"WITH {SHEDS} SELECT cell, sec FROM sheds WHERE stop = (SELECT min(stop) FROM sc)")
def g03(t: Tables) -> DataFrame:
    """All cells within ten minutes on foot of one station."""
    one = _stations(t).orderBy("stop").limit(1)
    return graph.walksheds(one, t.walk_edges, t.cells.where("land"), WALK_LIMIT, WALK_LIMIT // 60 + 1).select("cell", "sec")


@query("g06_walksheds", f"WITH {SHEDS} SELECT stop, cell, sec FROM sheds")
def g06(t: Tables) -> DataFrame:
    return sheds(t)


@query("g09_grid_graph", f"WITH p AS (SELECT trip, seq, CAST(floor((lon - 139.6) * {geo.KX} / 400) AS BIGINT) * 1000 + CAST(floor((lat - 35.55) * {geo.KY} / 400) AS BIGINT) AS cell FROM events JOIN stops USING (stop)), e AS (SELECT DISTINCT cell AS a, nxt AS b FROM (SELECT cell, lead(cell) OVER (PARTITION BY trip ORDER BY seq) AS nxt FROM p) WHERE nxt IS NOT NULL AND nxt <> cell) SELECT a, b FROM e UNION SELECT b, a FROM e")
def g09(t: Tables) -> DataFrame:
    """Ways snapped to a grid: distinct edges between following cells, both directions."""
    from ..operators.sequences import adjacent

    cell = F.floor((F.col("lon") - 139.6) * F.lit(geo.KX) / 400) * 1000 + F.floor((F.col("lat") - 35.55) * F.lit(geo.KY) / 400)
    p = t.events.join(t.stops.select("stop", "lon", "lat"), "stop").withColumn("cell", cell)
    e = adjacent(p, "trip", "seq", ["cell"]).where("next_cell <> cell").select(F.col("cell").alias("a"), F.col("next_cell").alias("b"))
    return e.union(e.select("b", "a")).distinct()


# --- components and chains ----------------------------------------------------------------------------------


@query("g04_components", "WITH RECURSIVE r AS (SELECT stop AS a, stop AS b FROM stops UNION SELECT r.a, e.y FROM r JOIN (SELECT a AS x, b AS y FROM near WHERE m <= 250 UNION ALL SELECT b, a FROM near WHERE m <= 250) AS e ON e.x = r.b) SELECT a AS node, min(b) AS comp FROM r GROUP BY a")
def g04(t: Tables) -> DataFrame:
    """Components of stops within 250 m of each other."""
    return spatial.clusters(t.stops, "stop", 250.0)


@query("g15_search_index", "WITH RECURSIVE e AS (SELECT n.a AS x, n.b AS y FROM near AS n JOIN stops AS s ON s.stop = n.a JOIN stops AS u ON u.stop = n.b WHERE m <= 700 AND s.operator = u.operator), r AS (SELECT stop AS a, stop AS b FROM stops UNION SELECT r.a, e2.y FROM r JOIN (SELECT x, y FROM e UNION ALL SELECT y, x FROM e) AS e2 ON e2.x = r.b), c AS (SELECT a, min(b) AS comp FROM r GROUP BY a) SELECT comp, operator, count(*) AS n, round(avg(lon), 6) AS lon, round(avg(lat), 6) AS lat FROM c JOIN stops ON stop = a GROUP BY comp, operator")
def g15(t: Tables) -> DataFrame:
    """Stops of one name within 700 m are one entry with its mean position."""
    s = t.stops
    c = spatial.clusters(s, "stop", 700.0, ("operator",))
    return c.join(s, F.col("node") == F.col("stop")).groupBy("comp", "operator").agg(F.count("*").alias("n"), F.round(F.avg("lon"), 6).alias("lon"), F.round(F.avg("lat"), 6).alias("lat"))


NEXT = "o_orderkey + 1 + (o_orderkey * 7919 + 13) % 40"
POINTERS = f"SELECT o_orderkey AS node, CASE WHEN o_orderkey % 50 = 10 THEN o_orderkey + 1 WHEN o_orderkey % 50 = 11 THEN o_orderkey - 1 WHEN o_orderkey % 17 > 0 THEN {NEXT} END AS next FROM orders"


@query("g05_through_services", f"WITH RECURSIVE p AS ({POINTERS}), k AS (SELECT p.next AS node, min(p.node) AS before FROM p JOIN p AS t ON t.node = p.next GROUP BY p.next), r AS (SELECT node, node AS head, CAST(0 AS BIGINT) AS pos FROM p WHERE node NOT IN (SELECT node FROM k) UNION ALL SELECT k.node, r.head, r.pos + 1 FROM r JOIN k ON k.before = r.node) SELECT p.node, coalesce(r.head, p.node) AS head, coalesce(r.pos, 0) AS pos FROM p LEFT JOIN r ON r.node = p.node")
def g05(t: Tables) -> DataFrame:
    """Trips chained to through services; cycles stay single."""
    o = t.raw("orders").select(F.col("o_orderkey").alias("node"), F.expr(f"case when o_orderkey % 50 = 10 then o_orderkey + 1 when o_orderkey % 50 = 11 then o_orderkey - 1 when o_orderkey % 17 > 0 then {NEXT} end").alias("next"))
    return graph.chains(o)


# --- timetable ----------------------------------------------------------------------------------------------


@query("g10_timetable", "WITH l AS (SELECT line, stop, row_number() OVER (PARTITION BY line ORDER BY stop) AS seq, 60 + stop % 240 AS leg, 600 + (line % 5) * 300 AS headway FROM stops), d AS (SELECT line, headway, 0 AS dir, seq, stop, sum(leg) OVER (PARTITION BY line ORDER BY seq ROWS UNBOUNDED PRECEDING) AS off FROM l UNION ALL SELECT line, headway, 1, row_number() OVER (PARTITION BY line ORDER BY seq DESC), stop, sum(leg) OVER (PARTITION BY line ORDER BY seq DESC ROWS UNBOUNDED PRECEDING) FROM l) SELECT line, dir, k, seq, stop, CAST(18000 + dir * (headway // 2) + k * headway + off AS BIGINT) AS arr FROM d, LATERAL (SELECT unnest(range(0, 68400 // headway)) AS k)")
def g10(t: Tables) -> DataFrame:
    """A synthetic timetable: a trip each headway both ways, the way back half a headway later, times laid along the legs."""
    w = W.partitionBy("line").orderBy("stop")
    l = t.stops.select("line", "stop", F.row_number().over(w).alias("seq"), (60 + F.col("stop") % 240).alias("leg"), (600 + F.col("line") % 5 * 300).alias("headway"))  # noqa: E741
    up, down = W.partitionBy("line").orderBy("seq"), W.partitionBy("line").orderBy(F.col("seq").desc())
    run = lambda w: F.sum("leg").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("at")
    d = l.select("line", "headway", F.lit(0).alias("dir"), "seq", "stop", run(up)).unionByName(l.select("line", "headway", F.lit(1).alias("dir"), F.row_number().over(down).alias("seq"), "stop", run(down)))
    d = d.withColumn("k", F.explode(F.expr("sequence(0L, 68400 div headway - 1)")))
    return d.select("line", "dir", "k", "seq", "stop", F.expr("18000 + dir * (headway div 2) + k * headway + at").cast("bigint").alias("arr"))


@query("g11_grade_segments", "WITH n AS (SELECT stop, count(*) AS n FROM (SELECT a AS stop FROM near UNION ALL SELECT b FROM near) GROUP BY stop) SELECT s.stop, coalesce(n, 0) AS density, CASE WHEN coalesce(n, 0) >= 8 THEN 300 WHEN coalesce(n, 0) >= 4 THEN 600 WHEN coalesce(n, 0) >= 1 THEN 1200 ELSE 3600 END AS headway FROM stops AS s LEFT JOIN n ON n.stop = s.stop")
def g11(t: Tables) -> DataFrame:
    """Headway of a segment by the density of stations around it."""
    d = t.stops.select("stop").join(t.density, "stop", "left").select("stop", F.coalesce("n", F.lit(0)).alias("density"))
    return d.withColumn("headway", F.when(F.col("density") >= 8, 300).when(F.col("density") >= 4, 600).when(F.col("density") >= 1, 1200).otherwise(3600))


@query("g12_tiles_with_halo", "SELECT tx, ty, CAST(count_if(core) AS BIGINT) AS core, count(*) AS with_halo FROM (SELECT tx, ty, x >= tx * 16 AND x < tx * 16 + 16 AND y >= ty * 16 AND y < ty * 16 + 16 AS core FROM cells JOIN (SELECT a AS tx, b AS ty FROM (SELECT unnest(range(0, 5)) AS a), (SELECT unnest(range(0, 5)) AS b)) ON x >= tx * 16 - 2 AND x < tx * 16 + 18 AND y >= ty * 16 - 2 AND y < ty * 16 + 18) GROUP BY tx, ty")
def g12(t: Tables) -> DataFrame:
    """Tiles with a margin: each node goes to its tile and the tiles whose margin holds it."""
    c = t.cells.withColumn("tx", F.explode(F.expr("array_distinct(array(floor((x - 2) / 16), floor(x / 16), floor((x + 2) / 16)))")))
    c = c.withColumn("ty", F.explode(F.expr("array_distinct(array(floor((y - 2) / 16), floor(y / 16), floor((y + 2) / 16)))"))).where("tx between 0 and 4 and ty between 0 and 4")
    core = (F.floor(F.col("x") / 16) == F.col("tx")) & (F.floor(F.col("y") / 16) == F.col("ty"))
    return c.groupBy("tx", "ty").agg(F.count_if(core).alias("core"), F.count("*").alias("with_halo"))


@query(
    "g13_line_ends",
    """WITH o AS (SELECT line, stop, stop % 1850 AS g, row_number() OVER (PARTITION BY line ORDER BY stop) AS up, row_number() OVER (PARTITION BY line ORDER BY stop DESC) AS down, count(*) OVER (PARTITION BY line) AS n FROM stops),
e AS (SELECT DISTINCT g FROM o WHERE n >= 2 AND (up = 1 OR down = 1) AND g NOT IN (SELECT g FROM o WHERE up > 1 AND down > 1)), d AS (SELECT stop, min(m) AS m FROM (SELECT a AS stop, m FROM near UNION ALL SELECT b, m FROM near) GROUP BY stop)
SELECT e.g, round(least(greatest(coalesce(min(d.m), 1000) / 2, 100), 400), 3) AS radius FROM e JOIN o ON o.g = e.g LEFT JOIN d ON d.stop = o.stop GROUP BY e.g""",
)
def g13(t: Tables) -> DataFrame:
    """Stations that end a line and are no line's middle, with half the distance to their nearest neighbour, clipped."""
    w = W.partitionBy("line")
    place = F.row_number().over(w.orderBy("stop"))
    o = t.stops.select("line", "stop", (F.col("stop") % 1850).alias("g"), place.alias("at"), F.count("*").over(w).alias("n"))
    ends, middles = o.where("n >= 2 and at in (1, n)").select("g").distinct(), o.where("at > 1 and at < n").select("g")
    m = t.near.select(F.col("a").alias("stop"), "m").union(t.near.select("b", "m")).groupBy("stop").agg(F.min("m").alias("m"))
    own = o.select("g", "stop").join(ends.join(middles, "g", "left_anti"), "g", "left_semi").join(m, "stop", "left").groupBy("g").agg(F.min("m").alias("m"))
    return own.select("g", F.round(F.least(F.greatest(F.coalesce("m", F.lit(1000.0)) / 2, F.lit(100.0)), F.lit(400.0)), 3).alias("radius"))


# --- fields -------------------------------------------------------------------------------------------------

FIELD = f"{ARRIVALS}, {SHEDS}, field AS MATERIALIZED (SELECT cell, min(best - {DEPART} + s.sec) AS sec FROM sheds AS s JOIN arrivals AS a ON a.stop = s.stop WHERE best - {DEPART} + s.sec <= {BUDGET} GROUP BY cell)"
OFFSETS = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if i * i + j * j <= 4]
SPREAD = FIELD + f", grown AS MATERIALIZED (SELECT cell + i * 1000 + j AS cell, min(sec + CAST(round_even(sqrt(i * i + j * j) * 75, 0) AS BIGINT)) AS sec FROM field, (VALUES {', '.join(f'({i}, {j})' for i, j in OFFSETS)}) AS o(i, j) WHERE sec + CAST(round_even(sqrt(i * i + j * j) * 75, 0) AS BIGINT) <= {BUDGET} GROUP BY 1)"
BANDS = (1200, 2400, 3600)


def entered(t: Tables) -> DataFrame:
    """(stop, x, y, elapsed): the cells with stations that are reached, by their number, and when first. Arrivals are as many as stops, so they are never broadcast."""
    a = arrivals(t).select("stop", (F.col("best") - DEPART).alias("elapsed"))
    return _stations(t).join(a.hint("merge"), "stop").groupBy(F.col("cell").alias("stop"), "x", "y").agg(F.min("elapsed").alias("elapsed"))


def field(t: Tables) -> DataFrame:
    doors = cut(entered(t))  # one search for each cell with stations
    walked = graph.walksheds(doors.select("stop", F.col("stop").alias("cell"), "x", "y"), t.walk_edges, t.cells.where("land"), WALK_LIMIT, WALK_LIMIT // 60 + 1)
    return walked.join(doors.select("stop", "elapsed"), "stop").withColumn("s", F.col("elapsed") + F.col("sec")).where(F.col("s") <= BUDGET).groupBy("cell").agg(F.min("s").alias("sec"))


def spread(f: DataFrame) -> DataFrame:
    """Min-plus dilation by the offsets within two cells: a stencil of thirteen rows, made in place, no join."""
    o = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(round(75 * (i * i + j * j) ** 0.5)).alias("c")) for i, j in OFFSETS]))
    d = f.withColumn("o", o).select((F.col("cell") + F.col("o.i") * 1000 + F.col("o.j")).alias("cell"), (F.col("sec") + F.col("o.c")).alias("sec"))
    return d.where(F.col("sec") <= BUDGET).groupBy("cell").agg(F.min("sec").alias("sec"))


@query("q01_isochrone_cells", f"WITH {SPREAD} SELECT cell, sec FROM grown")
def q01(t: Tables) -> DataFrame:
    """Travel time of every cell within an hour: arrivals, walksheds, minimum, spread."""
    return spread(field(t))


@query("t07_isochrone_bands", f"WITH {SPREAD} SELECT minutes, count(*) AS cells FROM grown, (VALUES {', '.join(f'({b})' for b in BANDS)}) AS b(minutes) WHERE sec <= minutes GROUP BY minutes")
def t07(t: Tables) -> DataFrame:
    """Cells of each travel-time band, widest first."""
    band = F.explode(F.filter(F.array(*[F.lit(b) for b in BANDS]), lambda b: b >= F.col("sec")))
    return spread(field(t)).select(band.alias("minutes")).groupBy("minutes").agg(F.count("*").alias("cells")).orderBy(F.col("minutes").desc())


@query(
    "r12_contours",
    f"""WITH {SPREAD}, b AS (SELECT cell, minutes FROM grown, (VALUES {', '.join(f'({b})' for b in BANDS)}) AS b(minutes) WHERE sec <= minutes), n AS (SELECT minutes, count(*) AS n FROM b GROUP BY minutes),
shared AS (SELECT x.minutes, count(*) AS n FROM (SELECT minutes, unnest([cell + 1, cell + 1000]) AS cell FROM b) AS x JOIN b ON b.minutes = x.minutes AND b.cell = x.cell GROUP BY x.minutes)
SELECT n.minutes, CAST(n.n AS DOUBLE) AS area, 4 * n.n - 2 * coalesce(shared.n, 0) AS sides FROM n LEFT JOIN shared USING (minutes)""",
)
def r12(t: Tables) -> DataFrame:
    """Rings around each band: the signed areas of rings and holes add up to its cells, their lengths to the sides without a neighbour."""
    band = F.explode(F.filter(F.array(*[F.lit(b) for b in BANDS]), lambda b: b >= F.col("sec")))
    c = spread(field(t)).select((F.floor((F.col("cell") + 500) / 1000)).alias("x"), F.col("cell"), band.alias("minutes")).withColumn("y", F.col("cell") - F.col("x") * 1000)
    return graph.contour(c.select("x", "y", "minutes"), "minutes").groupBy("minutes").agg(F.sum("area").alias("area"), F.sum("points").alias("sides"))


@query("r18_closing", "WITH l AS (SELECT x, y FROM cells WHERE land), o AS (SELECT i, j FROM (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) AS v(i, j)), dil AS (SELECT DISTINCT x + i AS x, y + j AS y FROM l, o) SELECT x, y FROM (SELECT d.x, d.y, count(*) AS n FROM dil AS d, o JOIN dil AS e ON e.x = d.x + o.i AND e.y = d.y + o.j GROUP BY d.x, d.y) WHERE n = 5")
def r18(t: Tables) -> DataFrame:
    """Morphological closing of the land cells: dilation, then erosion, each one stencil and one aggregate."""
    o = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))]))
    grow = lambda d: d.withColumn("o", o).select((F.col("x") + F.col("o.i")).alias("x"), (F.col("y") + F.col("o.j")).alias("y"))
    dilated = grow(t.cells.where("land").select("x", "y")).distinct()
    return grow(dilated).groupBy("x", "y").agg(F.count("*").alias("n")).where("n = 5").join(dilated, ["x", "y"], "left_semi").select("x", "y")


@query("r19_burn_line", "SELECT DISTINCT trip, CAST(round_even(a + (b - a) * k / n, 0) AS BIGINT) AS x FROM (SELECT trip, seq, stop % 80 AS a, lead(stop % 80) OVER (PARTITION BY trip ORDER BY seq) AS b FROM events), LATERAL (SELECT 10 AS n), LATERAL (SELECT unnest(range(0, 11)) AS k) WHERE b IS NOT NULL")
def r19(t: Tables) -> DataFrame:
    """Cells along each step of a way, rounded half to even."""
    from ..operators.sequences import adjacent

    d = adjacent(t.events.withColumn("a", F.col("stop") % 80), "trip", "seq", ["a"]).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(10))))
    return d.select("trip", F.bround(F.col("a") + (F.col("next_a") - F.col("a")) * F.col("k") / 10, 0).cast("bigint").alias("x")).distinct()


@query("q04_reason", f"WITH {STATION} SELECT cell, CASE WHEN NOT land THEN 'sea' WHEN x < 4 OR y < 4 THEN 'outside_region' WHEN NOT EXISTS (SELECT 1 FROM walk_edges AS e WHERE e.src = c.cell) THEN 'no_road' WHEN NOT EXISTS (SELECT 1 FROM sc WHERE abs(sc.x - c.x) + abs(sc.y - c.y) <= 6) THEN 'no_station_in_range' ELSE 'reachable' END AS reason FROM cells AS c")
def q04(t: Tables) -> DataFrame:
    """Why a place can't be reached, in order."""
    roads = t.walk_edges.select(F.col("src").alias("cell"), F.lit(True).alias("road")).distinct()
    o = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-6, 7) for j in range(-6, 7) if abs(i) + abs(j) <= 6]))
    near = _stations(t).withColumn("o", o).select(((F.col("x") + F.col("o.i")) * 1000 + F.col("y") + F.col("o.j")).alias("cell"), F.lit(True).alias("station")).distinct()
    d = t.cells.join(roads, "cell", "left").join(near, "cell", "left")
    r = F.when(~F.col("land"), "sea").when((F.col("x") < 4) | (F.col("y") < 4), "outside_region").when(F.col("road").isNull(), "no_road").when(F.col("station").isNull(), "no_station_in_range").otherwise("reachable")
    return d.select("cell", r.alias("reason"))


@query("q05_station_lookup", "SELECT stop, name, line FROM stops WHERE operator = 'Brand#11' AND contains(name, '1')")
def q05(t: Tables) -> DataFrame:
    return t.stops.where((F.col("operator") == "Brand#11") & F.col("name").contains("1")).select("stop", "name", "line")


LOG = "SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM rides"


@query("w17_rate_limit", f"WITH RECURSIVE l AS MATERIALIZED ({LOG}), r AS (SELECT user_id, event_id, n, [us] AS held, true AS accepted FROM l WHERE n = 1 UNION ALL SELECT l.user_id, l.event_id, l.n, CASE WHEN len(list_filter(held, lambda h: h > us - 864000000000)) < 2 THEN list_append(list_filter(held, lambda h: h > us - 864000000000), us) ELSE list_filter(held, lambda h: h > us - 864000000000) END, len(list_filter(held, lambda h: h > us - 864000000000)) < 2 FROM r JOIN l ON l.user_id = r.user_id AND l.n = r.n + 1) SELECT event_id, user_id, accepted FROM r")
def w17(t: Tables) -> DataFrame:
    """Calls under a sliding limit in which refused calls don't count (W17, Q08); the stream form is streaming.limiter."""
    return graph.limited(t.rides, 2, 864000)
