"""Relations and their members, lines split and cleaned by distance, paths redrawn on the fine network."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import geo, tags
from ..operators import graph
from ..registry import query
from ..sources.bindings import GRID, Tables
from .queries_text import NOT_TRAIN

STOP_NODE = f"(railway IN ('station', 'halt', 'tram_stop') OR (public_transport IN ('station', 'stop_position') AND NOT {NOT_TRAIN}))"
FAR_M, SLACK_M = 15_000.0, 20_000.0
LOCATED = "p AS (SELECT trip, seq, stop, lon, lat FROM events JOIN stops USING (stop))"


def _sql_m(a: str, b: str) -> str:
    return f"sqrt(pow(({a}lon - {b}lon) * {geo.KX}, 2) + pow(({a}lat - {b}lat) * {geo.KY}, 2))"


def _located(t: Tables) -> DataFrame:
    return t.events.select("trip", "seq", "stop").join(t.stops.select("stop", "lon", "lat"), "stop")


@query(
    "s08_relation_members",
    f"SELECT e.trip AS relation, count(*) AS members, count(DISTINCT e.stop) AS stations FROM events AS e JOIN tagged_nodes AS n ON n.stop = e.stop WHERE {STOP_NODE} GROUP BY e.trip HAVING count(DISTINCT e.stop) >= 2",
)
def s08(t: Tables) -> DataFrame:
    """Route relations with their station members, those of two stations or more (S08, S09): one join on the node instead of three scans."""
    d = t.events.select(F.col("trip").alias("relation"), "stop").join(t.tagged_nodes.where(tags.stop_node()).select("stop"), "stop")
    return d.groupBy("relation").agg(F.count("*").alias("members"), F.countDistinct("stop").alias("stations")).where("stations >= 2")


@query(
    "s12_admin_members",
    "SELECT l_suppkey AS area, count(DISTINCT way) AS ways, count(DISTINCT CASE WHEN shore = 'coastline' THEN way END) AS shores FROM lineitem JOIN tagged_ways ON way = l_orderkey WHERE l_linestatus = 'F' GROUP BY l_suppkey",
)
def s12(t: Tables) -> DataFrame:
    """Ways that bound each area of one level, and how many of them are coast."""
    member = t.raw("lineitem").where("l_linestatus = 'F'").select(F.col("l_suppkey").alias("area"), F.col("l_orderkey").alias("way"))
    d = member.distinct().join(t.tagged_ways.select("way", "shore"), "way")
    return d.groupBy("area").agg(F.count("*").alias("ways"), F.count(F.when(F.col("shore") == "coastline", 1)).alias("shores"))


@query("s19_dictionary_lookup", "SELECT s.stop, n.n_name AS book, CASE WHEN n.n_nationkey IS NULL THEN 0 ELSE length(n.n_name) END AS entries FROM stops AS s LEFT JOIN nation AS n ON n.n_nationkey = s.line")
def s19(t: Tables) -> DataFrame:
    """A dictionary looked up by key; keys that it lacks read as an empty entry."""
    n = t.raw("nation").select(F.col("n_nationkey").cast("bigint").alias("line"), F.col("n_name").alias("book"))
    return t.stops.join(n, "line", "left").select("stop", "book", F.coalesce(F.length("book"), F.lit(0)).alias("entries"))


@query(
    "r06_split_far",
    f"""WITH {LOCATED}, g AS (SELECT *, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat FROM p WINDOW w AS (PARTITION BY trip ORDER BY seq)), k AS (SELECT trip, seq, stop, sum(CASE WHEN {_sql_m('', 'p')} > {FAR_M} THEN 1 ELSE 0 END) OVER (PARTITION BY trip ORDER BY seq) AS part FROM g)
SELECT trip, part, count(*) AS stations, arg_min(stop, seq) AS first, arg_max(stop, seq) AS last FROM k GROUP BY trip, part""",
)
def r06(t: Tables) -> DataFrame:
    """Lines cut where neighbours are too far apart; the first part keeps the line's number."""
    w = W.partitionBy("trip").orderBy("seq")
    far = geo.flat_m(F.col("lon"), F.col("lat"), F.lag("lon").over(w), F.lag("lat").over(w)) > FAR_M
    d = _located(t).withColumn("far", F.when(far, 1).otherwise(0)).withColumn("part", F.sum("far").over(w))
    return d.groupBy("trip", "part").agg(F.count("*").alias("stations"), F.min_by("stop", "seq").alias("first"), F.max_by("stop", "seq").alias("last"))


@query(
    "r02_drop_strays",
    f"""WITH {LOCATED}, n AS (SELECT *, lag(lon) OVER w AS alon, lag(lat) OVER w AS alat, lead(lon) OVER w AS blon, lead(lat) OVER w AS blat FROM p WINDOW w AS (PARTITION BY trip ORDER BY seq)),
c AS (SELECT trip, seq, stop, round(coalesce({_sql_m('', 'a')}, 0) + coalesce({_sql_m('', 'b')}, 0) - coalesce({_sql_m('a', 'b')}, 0), 3) AS cost FROM n)
SELECT trip, seq, stop FROM (SELECT *, min(cost) OVER (PARTITION BY trip, stop % 3) AS least FROM c) WHERE cost <= least + {SLACK_M}""",
)
def r02(t: Tables) -> DataFrame:
    """Of a station named several times in a list, places that lengthen the way by far more than its best place go."""
    w = W.partitionBy("trip").orderBy("seq")
    d = _located(t).withColumns({x + c: step(c).over(w) for x, step in (("a", F.lag), ("b", F.lead)) for c in ("lon", "lat")})
    m = lambda a, b: F.coalesce(geo.flat_m(*[F.col(f"{x}{c}") for x in (a, b) for c in ("lon", "lat")]), F.lit(0.0))
    d = d.withColumn("cost", F.round(m("", "a") + m("", "b") - m("a", "b"), 3))
    least = F.min("cost").over(W.partitionBy("trip", F.col("stop") % 3))
    return d.withColumn("least", least).where(F.col("cost") <= F.col("least") + SLACK_M).select("trip", "seq", "stop")


SPAN, ROUNDS, DIAGONAL = 4, 24, 999  # land lies in strips along this diagonal
WAYS = f"(SELECT DISTINCT x0 * 1000 + y0 AS path, x0, y0 FROM (SELECT stop % {2 * GRID - 10} + 1 AS x0, (stop * 7) % {2 * GRID - 10} + 6 AS y0 FROM stops))"


def _routes_sql() -> str:
    parts = [
        f"w AS MATERIALIZED {WAYS}",
        f"co AS MATERIALIZED (SELECT DISTINCT path, (x0 + k + i) * 1000 + y0 - k + j AS cell FROM w, (SELECT unnest(range(0, {SPAN + 1})) AS k), (SELECT unnest(range(-1, 2)) AS i), (SELECT unnest(range(-1, 2)) AS j))",
        "ce AS MATERIALIZED (SELECT a.path, e.src, e.dst, e.sec FROM co AS a JOIN walk_edges AS e ON e.src = a.cell JOIN co AS b ON b.path = a.path AND b.cell = e.dst)",
        "d0 AS (SELECT path, path AS cell, CAST(0 AS BIGINT) AS sec FROM w)",
    ]
    for k in range(1, ROUNDS + 1):
        parts.append(f"d{k} AS MATERIALIZED (SELECT path, cell, min(sec) AS sec FROM (SELECT * FROM d{k - 1} UNION ALL SELECT d.path, dst, d.sec + ce.sec FROM d{k - 1} AS d JOIN ce ON ce.path = d.path AND ce.src = d.cell) GROUP BY path, cell)")
    parts.append(f"bk AS MATERIALIZED (SELECT ce.path, ce.dst AS cell, min(ce.src) AS before FROM ce JOIN d{ROUNDS} AS u ON u.path = ce.path AND u.cell = ce.src JOIN d{ROUNDS} AS v ON v.path = ce.path AND v.cell = ce.dst AND v.sec = u.sec + ce.sec GROUP BY ALL)")
    parts.append(f"r AS (SELECT w.path, path + {SPAN * DIAGONAL} AS cell, CAST(0 AS BIGINT) AS back FROM w JOIN d{ROUNDS} USING (path) WHERE d{ROUNDS}.cell = path + {SPAN * DIAGONAL} UNION ALL SELECT r.path, bk.before, r.back + 1 FROM r JOIN bk ON bk.path = r.path AND bk.cell = r.cell WHERE r.cell <> r.path)")
    return ", ".join(parts)


@query("g08_corridor_paths", f"WITH RECURSIVE {_routes_sql()} SELECT path, cell, max(back) OVER (PARTITION BY path) - back AS pos FROM r")
def g08(t: Tables) -> DataFrame:
    """Coarse straight paths redrawn on the walking network, within a cell of the straight line."""
    n = 2 * GRID - 10
    w = t.stops.select((F.col("stop") % n + 1).alias("x0"), (F.col("stop") * 7 % n + 6).alias("y0")).distinct().withColumn("path", F.col("x0") * 1000 + F.col("y0"))
    around = F.explode(F.array(*[F.lit(v) for v in sorted({(k + i) * 1000 - k + j for k in range(SPAN + 1) for i in (-1, 0, 1) for j in (-1, 0, 1)})]))
    paths = w.select("path", F.col("path").alias("src"), (F.col("path") + SPAN * DIAGONAL).alias("dst"))
    return graph.corridor_paths(paths, w.select("path", around.alias("o")).select("path", (F.col("path") + F.col("o")).alias("cell")), t.walk_edges)
