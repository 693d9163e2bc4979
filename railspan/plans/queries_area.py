"""Areas, coverage, clipping, bounded routes and stop lists completed along a line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import sequences, spatial
from ..registry import query
from ..sources.bindings import GRID, Tables
from .fixpoint import cut, fixpoint
from .queries_joins import PIP, RINGS, _rings

SIDE = 2 * GRID
PLACE = f"stop % {SIDE} AS x, (stop * 7) % {SIDE} AS y"
IN_AREA = f"pip AS ({PIP})"


def _placed(t: Tables) -> DataFrame:
    return t.stops.select("stop", "line", "size", (F.col("stop") % SIDE).alias("x"), (F.col("stop") * 7 % SIDE).alias("y"))


def _cells_of_areas(t: Tables) -> DataFrame:
    points = t.cells.select(F.col("cell").alias("point"), (F.col("x") + 0.5).alias("x"), (F.col("y") + 0.5).alias("y"))
    return spatial.points_in_polygons(points, _rings(t)).select(F.col("point").alias("cell"), "poly")


@query(
    "q10_boundary_tests",
    f"""WITH {IN_AREA}, s AS (SELECT stop, {PLACE} FROM stops), box AS (SELECT poly, min(least(x1, x2)) AS a, max(greatest(x1, x2)) AS b, min(least(y1, y2)) AS c, max(greatest(y1, y2)) AS d FROM ({RINGS}) GROUP BY poly)
SELECT s.stop, count(DISTINCT pip.poly) > 0 AS inside, count(DISTINCT box.poly) > 0 AS in_envelope, NOT bool_and(cells.land) AS is_sea
FROM s JOIN cells ON cells.x = s.x AND cells.y = s.y LEFT JOIN pip ON pip.point = cells.cell LEFT JOIN box ON s.x + 0.5 BETWEEN a AND b AND s.y + 0.5 BETWEEN c AND d GROUP BY s.stop""",
)
def q10(t: Tables) -> DataFrame:
    """For each stop: inside an area, inside the box of one, at sea. Boxes meet points in bands of their width, as edges do."""
    at = _placed(t).join(t.cells, ["x", "y"])
    inside = _cells_of_areas(t).select("cell").distinct().withColumn("inside", F.lit(True))
    box = _rings(t).groupBy("poly").agg(F.min(F.least("x1", "x2")).alias("a"), F.max(F.greatest("x1", "x2")).alias("b"), F.min(F.least("y1", "y2")).alias("c"), F.max(F.greatest("y1", "y2")).alias("d"))
    bands = box.withColumn("band", F.explode(F.sequence(F.floor(F.col("a") / 10), F.floor(F.col("b") / 10))))
    px, py = F.col("x") + 0.5, F.col("y") + 0.5
    boxed = at.withColumn("band", F.floor(px / 10)).join(bands, "band").where(px.between(F.col("a"), F.col("b")) & py.between(F.col("c"), F.col("d"))).select("stop").distinct().withColumn("in_envelope", F.lit(True))
    d = at.join(inside, "cell", "left").join(boxed, "stop", "left")
    return d.select("stop", F.coalesce("inside", F.lit(False)).alias("inside"), F.coalesce("in_envelope", F.lit(False)).alias("in_envelope"), (~F.col("land")).alias("is_sea"))


@query(
    "j25_face_votes",
    f"WITH {IN_AREA}, v AS (SELECT c.x // 8 AS fx, c.y // 8 AS fy, poly, count(*) AS n FROM cells AS c JOIN pip ON pip.point = c.cell WHERE c.land GROUP BY ALL) SELECT fx, fy, arg_min(poly, (-n, poly)) AS poly, max(n) AS votes FROM v GROUP BY fx, fy",
)
def j25(t: Tables) -> DataFrame:
    """Each face goes to the area that most of its sample points on land lie in, the least on ties."""
    v = t.cells.where("land").join(_cells_of_areas(t), "cell").groupBy(F.floor(F.col("x") / 8).alias("fx"), F.floor(F.col("y") / 8).alias("fy"), "poly").agg(F.count("*").alias("n"))
    best = v.groupBy("fx", "fy").agg(F.min(F.struct((-F.col("n")).alias("n"), "poly")).alias("b"))
    return best.select("fx", "fy", "b.poly", (-F.col("b.n")).alias("votes"))


@query(
    "r13_clip_lines",
    f"""WITH {IN_AREA}, s AS (SELECT stop, line, {PLACE} FROM stops), p AS (SELECT s.line, s.stop, row_number() OVER (PARTITION BY s.line ORDER BY s.stop) AS pos, EXISTS (SELECT 1 FROM pip WHERE pip.point = s.x * 1000 + s.y AND poly IN (0, 5, 6, 9)) AS inside FROM s)
SELECT line, min(stop) AS first, max(stop) AS last, count(*) AS points FROM (SELECT *, pos - row_number() OVER (PARTITION BY line ORDER BY pos) AS island FROM p WHERE inside) GROUP BY line, island""",
)
def r13(t: Tables) -> DataFrame:
    """Lines clipped to an outline of chosen areas: the runs of points inside."""
    keep = _cells_of_areas(t).where(F.col("poly").isin(0, 5, 6, 9)).select("cell").distinct()
    w = W.partitionBy("line").orderBy("stop")
    d = _placed(t).withColumn("pos", F.row_number().over(w)).withColumn("cell", F.col("x") * 1000 + F.col("y")).join(keep, "cell", "left_semi")
    d = d.withColumn("island", F.col("pos") - F.row_number().over(W.partitionBy("line").orderBy("pos")))
    return d.groupBy("line", "island").agg(F.min("stop").alias("first"), F.max("stop").alias("last"), F.count("*").alias("points")).drop("island")


@query("z26_missing_rings", f"SELECT DISTINCT line % 15 AS area FROM stops WHERE line % 15 NOT IN (SELECT poly FROM ({RINGS}))")
def z26(t: Tables) -> DataFrame:
    """Chosen areas that have no ring; must be empty for a region to be built."""
    return t.stops.select((F.col("line") % 15).alias("area")).distinct().join(_rings(t).select(F.col("poly").alias("area")), "area", "left_anti")


@query(
    "z27_outline_report",
    f"""WITH r AS ({RINGS}), v AS (SELECT poly, x, y, sum(o) AS d FROM (SELECT poly, x1 AS x, y1 AS y, 1 AS o FROM r UNION ALL SELECT poly, x2, y2, -1 FROM r) GROUP BY ALL)
SELECT poly, count(*) AS edges, (SELECT count(*) FROM v WHERE v.poly = r.poly AND d <> 0) = 0 AS closed, round(median(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)), 6) AS step, round(max(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)), 6) AS longest FROM r GROUP BY poly""",
)
def z27(t: Tables) -> DataFrame:
    """Each outline: edges, whether every vertex is left as often as reached, median and longest step."""
    r = _rings(t)
    vertex = r.select("poly", F.col("x1").alias("x"), F.col("y1").alias("y"), F.lit(1).alias("o")).union(r.select("poly", "x2", "y2", F.lit(-1)))
    open_ = vertex.groupBy("poly", "x", "y").agg(F.sum("o").alias("d")).groupBy("poly").agg((F.max(F.abs("d")) == 0).alias("closed"))
    step = F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2))
    return r.groupBy("poly").agg(F.count("*").alias("edges"), F.round(F.median(step), 6).alias("step"), F.round(F.max(step), 6).alias("longest")).join(open_, "poly")


@query(
    "z14_ride_options",
    "WITH hi AS (SELECT DISTINCT cluster FROM stops WHERE size > 40) SELECT e.trip, e.seq, s.line FROM events AS e JOIN stops AS s USING (stop) WHERE NOT (e.trip % 3 = 0 AND s.size <= 40 AND s.cluster IN (SELECT cluster FROM hi))",
)
def z14(t: Tables) -> DataFrame:
    """Lines a service may ride; a dual-mode one drops conventional stops at clusters with a high-speed stop."""
    fast = t.stops.where("size > 40").select("cluster").distinct().withColumn("fast", F.lit(True))
    d = t.events.join(t.stops, "stop").join(fast, "cluster", "left")
    return d.where(~((F.col("trip") % 3 == 0) & (F.col("size") <= 40) & F.col("fast").isNotNull())).select("trip", "seq", "line")


@query(
    "z10_pieces_in_region",
    f"""WITH {IN_AREA}, box AS (SELECT poly, min(x1) AS a, max(x1) AS b, min(y1) AS c, max(y1) AS d FROM ({RINGS}) GROUP BY poly),
gap AS (SELECT p.poly AS p, q.poly AS q FROM box AS p JOIN box AS q ON p.poly <> q.poly AND greatest(p.a, q.a) - least(p.b, q.b) <= 1 AND greatest(p.c, q.c) - least(p.d, q.d) <= 1),
k0 AS (SELECT DISTINCT poly FROM pip JOIN (SELECT x * 1000 + y AS cell FROM (SELECT {PLACE} FROM stops)) ON cell = point),
k1 AS (SELECT poly FROM k0 UNION SELECT q FROM gap JOIN k0 ON p = poly), k2 AS (SELECT poly FROM k1 UNION SELECT q FROM gap JOIN k1 ON p = poly) SELECT poly FROM k2""",
)
def z10(t: Tables) -> DataFrame:
    """Areas that hold a station, and in two passes those whose boxes are within a cell of a kept one."""
    box = _rings(t).groupBy("poly").agg(F.min("x1").alias("a"), F.max("x1").alias("b"), F.min("y1").alias("c"), F.max("y1").alias("d"))
    tile = F.explode(F.sequence(F.floor((F.col("a") - 1) / 30), F.floor((F.col("b") + 1) / 30)))
    p, q = box.withColumn("tile", tile).alias("p"), box.withColumn("tile", tile).alias("q")
    near = p.join(q, F.expr("p.tile = q.tile and p.poly <> q.poly and greatest(p.a, q.a) - least(p.b, q.b) <= 1 and greatest(p.c, q.c) - least(p.d, q.d) <= 1"))
    near = cut(near.select(F.col("p.poly").alias("poly"), F.col("q.poly").alias("q")).distinct())
    stations = _placed(t).select((F.col("x") * 1000 + F.col("y")).alias("cell"))
    kept = _cells_of_areas(t).join(stations, "cell", "left_semi").select("poly").distinct()
    for _ in range(2):
        kept = kept.union(near.join(kept, "poly", "left_semi").select("q")).distinct()
    return kept


@query(
    "z08_grown_coverage",
    f"""WITH s AS (SELECT DISTINCT x, y FROM (SELECT {PLACE} FROM stops)), o AS (SELECT i, j FROM (SELECT unnest(range(-3, 4)) AS i), (SELECT unnest(range(-3, 4)) AS j) WHERE i * i + j * j <= 9)
SELECT DISTINCT c.cell FROM (SELECT s.x + i AS x, s.y + j AS y FROM s, o) AS g JOIN cells AS c ON c.x = g.x AND c.y = g.y WHERE c.land""",
)
def z08(t: Tables) -> DataFrame:
    """Cells on land within three cells of a station: a stencil made in place, then an equi-join."""
    o = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-3, 4) for j in range(-3, 4) if i * i + j * j <= 9]))
    grown = _placed(t).select("x", "y").distinct().withColumn("o", o).select((F.col("x") + F.col("o.i")).alias("x"), (F.col("y") + F.col("o.j")).alias("y")).distinct()
    return grown.join(t.cells.where("land"), ["x", "y"]).select("cell")


@query(
    "g07_capped_routes",
    "WITH RECURSIVE r AS (SELECT cell, CAST(0 AS BIGINT) AS sec FROM cells WHERE land AND x = 20 UNION SELECT e.dst, r.sec + e.sec FROM r JOIN walk_edges AS e ON e.src = r.cell WHERE r.sec + e.sec <= 400) SELECT cell, min(sec) AS sec FROM r GROUP BY cell",
)
def g07(t: Tables) -> DataFrame:
    """Least seconds from any of several sources, up to a cap: rounds that relax edges of what changed."""
    edges = cut(t.walk_edges)

    def step(state: DataFrame) -> DataFrame:
        reached = state.where("moved").join(edges, F.col("cell") == F.col("src")).select(F.col("dst").alias("cell"), (F.col("d") + F.col("sec")).alias("d")).where("d <= 400").withColumn("old", F.lit(None).cast("bigint"))
        both = state.select("cell", "d", F.col("d").alias("old")).unionByName(reached).groupBy("cell").agg(F.min("d").alias("d"), F.min("old").alias("old"))
        return both.select("cell", "d", (F.col("old").isNull() | (F.col("d") < F.col("old"))).alias("moved"))

    start = t.cells.where("land and x = 20").select("cell", F.lit(0).cast("bigint").alias("d"), F.lit(True).alias("moved"))
    return fixpoint(cut(start), step, 60, keep_moved=True).select("cell", F.col("d").alias("sec"))


LOOP = 30
ON_LOOP = f"SELECT trip, seq, stop % {LOOP} AS s, lead(stop % {LOOP}) OVER (PARTITION BY trip ORDER BY seq) AS n FROM events"


def _on_loop(t: Tables) -> DataFrame:
    return sequences.adjacent(t.events.withColumn("s", F.col("stop") % LOOP), "trip", "seq", ["s"]).select("trip", "seq", "s", F.col("next_s").alias("n"))


@query(
    "r03_fill_missing",
    f"""WITH a AS ({ON_LOOP}), f AS (SELECT trip, seq, unnest(CASE WHEN n > s THEN range(s + 1, n) ELSE range(s - 1, n, -1) END) AS station FROM a WHERE abs(n - s) BETWEEN 2 AND 6)
SELECT trip, seq, station FROM f WHERE NOT EXISTS (SELECT 1 FROM events AS e WHERE e.trip = f.trip AND e.stop % {LOOP} = f.station)""",
)
def r03(t: Tables) -> DataFrame:
    """Stations of the line passed between two near stops of a service and not in its list, after the stop they follow."""
    step = F.when(F.col("n") > F.col("s"), 1).otherwise(-1)
    d = _on_loop(t).where(F.abs(F.col("n") - F.col("s")).between(2, 6)).select("trip", "seq", F.explode(F.sequence(F.col("s") + step, F.col("n") - step, step)).alias("station"))
    return d.join(t.events.select("trip", (F.col("stop") % LOOP).alias("station")), ["trip", "station"], "left_anti").select("trip", "seq", "station")


@query(
    "r10_loop_arcs",
    f"""WITH a AS ({ON_LOOP}) SELECT trip, seq, CASE WHEN (n - s + {LOOP}) % {LOOP} <= {LOOP} // 2 THEN list_aggregate(list_transform(range(0, (n - s + {LOOP}) % {LOOP} + 1), lambda k: (s + k) % {LOOP}), 'string_agg', ',')
  ELSE list_aggregate(list_transform(range(0, (s - n + {LOOP}) % {LOOP} + 1), lambda k: (s - k + {LOOP}) % {LOOP}), 'string_agg', ',') END AS arc FROM a WHERE n IS NOT NULL""",
)
def r10(t: Tables) -> DataFrame:
    """The shorter way round a loop line between consecutive stops, forward on ties."""
    ahead, back = (F.col("n") - F.col("s") + LOOP) % LOOP, (F.col("s") - F.col("n") + LOOP) % LOOP
    forward = F.transform(F.sequence(F.lit(0).cast("bigint"), ahead), lambda k: (F.col("s") + k) % LOOP)
    around = F.transform(F.sequence(F.lit(0).cast("bigint"), back), lambda k: (F.col("s") - k + LOOP) % LOOP)
    return _on_loop(t).where("n is not null").select("trip", "seq", F.array_join(F.when(ahead <= LOOP // 2, forward).otherwise(around).cast("array<string>"), ",").alias("arc"))


@query(
    "z12_pick_better",
    """WITH g AS (SELECT line, stop, stop * 7 % 80 AS a, stop * 11 % 80 AS b, row_number() OVER (PARTITION BY line ORDER BY stop) AS pos FROM stops),
m AS (SELECT line, max(abs(a - pa)) + max(a) % 7 AS miss_a, max(abs(b - pb)) + max(b) % 7 AS miss_b FROM (SELECT *, lag(a) OVER (PARTITION BY line ORDER BY pos) AS pa, lag(b) OVER (PARTITION BY line ORDER BY pos) AS pb FROM g) GROUP BY line)
SELECT line, CASE WHEN miss_b < miss_a THEN 'b' ELSE 'a' END AS pick, least(miss_a, miss_b) AS misfit FROM m WHERE miss_a IS NOT NULL""",
)
def z12(t: Tables) -> DataFrame:
    """Of two geometries of a line the one of less misfit (largest hole and end gap), the first on ties."""
    w = W.partitionBy("line").orderBy("stop")
    g = t.stops.select("line", "stop", (F.col("stop") * 7 % 80).alias("a"), (F.col("stop") * 11 % 80).alias("b"))
    g = g.withColumn("ha", F.abs(F.col("a") - F.lag("a").over(w))).withColumn("hb", F.abs(F.col("b") - F.lag("b").over(w)))
    m = g.groupBy("line").agg((F.max("ha") + F.max("a") % 7).alias("ma"), (F.max("hb") + F.max("b") % 7).alias("mb")).where("ma is not null")
    return m.select("line", F.when(F.col("mb") < F.col("ma"), "b").otherwise("a").alias("pick"), F.least("ma", "mb").alias("misfit"))


@query(
    "z05_line_headways",
    "SELECT line, operator, min(size) AS headway FROM stops WHERE size % 5 <> 0 GROUP BY line, operator",
)
def z05(t: Tables) -> DataFrame:
    """Headways of a region's lines by operator: a map for each line, entries without a value left out, as rows."""
    entry = t.stops.groupBy("line", "operator").agg(F.min(F.when(F.col("size") % 5 != 0, F.col("size"))).alias("h"))
    maps = entry.groupBy("line").agg(F.map_filter(F.map_from_entries(F.collect_list(F.struct("operator", "h"))), lambda _, h: h.isNotNull()).alias("m")).where(F.size("m") > 0)
    return maps.select("line", F.explode("m").alias("operator", "headway"))


@query(
    "z20_name_keys",
    "SELECT stop, unnest(list_distinct([n, replace(n, ' ', ''), split_part(n, ' ', 1)])) AS key FROM (SELECT stop, lower(name) AS n FROM stops)",
)
def z20(t: Tables) -> DataFrame:
    """Variants of a station's name: as written in lower case, without spaces, its first word."""
    n = F.lower("name")
    return t.stops.select("stop", F.explode(F.array_distinct(F.array(n, F.replace(n, F.lit(" "), F.lit("")), F.split_part(n, F.lit(" "), F.lit(1))))).alias("key"))


@query(
    "a16_component_area",
    f"""WITH RECURSIVE c AS MATERIALIZED (SELECT x, y, cell FROM cells WHERE (x * 31 + y * 17) % 7 < 3 AND x < 40 AND y < 40),
e AS MATERIALIZED (SELECT a.cell AS a, b.cell AS b FROM (SELECT cell, x + dx AS x, y + dy AS y FROM c, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) AS s(dx, dy)) AS a JOIN c AS b USING (x, y)),
r AS (SELECT cell, cell AS root FROM c UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.cell WHERE r.root < e.b)
SELECT comp, count(*) * 4 AS area FROM (SELECT cell, min(root) AS comp FROM r GROUP BY cell) GROUP BY comp HAVING count(*) * 4 < 350""",
)
def a16(t: Tables) -> DataFrame:
    """Areas of the connected patches of a raster, those under a size."""
    from ..operators.graph import components

    c = cut(t.cells.where("(x * 31 + y * 17) % 7 < 3 and x < 40 and y < 40").select("x", "y", "cell"))
    steps = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (0, 1))]))
    e = c.select(F.col("cell").alias("a"), "x", "y", steps.alias("s")).select("a", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y")).join(c.select("x", "y", F.col("cell").alias("b")), ["x", "y"])
    return components(c.select(F.col("cell").alias("node")), e.select("a", "b")).groupBy("comp").agg((F.count("*") * 4).alias("area")).where("area < 350")
