"""Scans, sinks, filters, aggregates, windows, sorts and set operations over the timetable."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import geo, tags
from ..operators import sequences as S
from ..operators import tiles
from ..registry import query
from ..sources.bindings import BUDGET, DEPART, Tables
from . import raptor
from .fixpoint import shared_folder

DEADLINE = DEPART + BUDGET


# --- scans -------------------------------------------------------------------------------------------------


@query("s01_load_graph", "SELECT trip, seq, stop, arr, dep, first_value(stop) OVER (PARTITION BY trip ORDER BY seq) AS first_stop FROM events")
def s01(t: Tables) -> DataFrame:
    """Events with the first stop of their trip (scan S01 and window W03)."""
    return t.events.select("trip", "seq", "stop", "arr", "dep", F.first("stop").over(W.partitionBy("trip").orderBy("seq")).alias("first_stop"))


@query("s02_load_walk", "SELECT src, dst, sec FROM walk_edges")
def s02(t: Tables) -> DataFrame:
    return t.walk_edges


@query("s04_fine_tiles", f"SELECT CAST(floor((lon - 139.6) * {geo.KX} / 2000) AS BIGINT) AS tx, CAST(floor((lat - 35.55) * {geo.KY} / 2000) AS BIGINT) AS ty, count(*) AS points FROM stops GROUP BY ALL")
def s04(t: Tables) -> DataFrame:
    """Points bucketed by tiles of 2 km (sink K06 writes by the same key)."""
    return t.stops.groupBy(F.floor((F.col("lon") - 139.6) * F.lit(geo.KX) / 2000).alias("tx"), F.floor((F.col("lat") - 35.55) * F.lit(geo.KY) / 2000).alias("ty")).agg(F.count("*").alias("points"))


@query("s06_available", "SELECT l_returnflag AS calendar, count(DISTINCT l_orderkey) AS trips FROM lineitem GROUP BY 1")
def s06(t: Tables) -> DataFrame:
    return t.raw("lineitem").groupBy(F.col("l_returnflag").alias("calendar")).agg(F.countDistinct("l_orderkey").alias("trips"))


@query("s07_timetables_of_calendar", "SELECT id, max(n) AS n FROM (SELECT 'T' || (l_orderkey % 500) || '.' || l_returnflag AS id, l_linenumber AS n FROM lineitem) WHERE split_part(id, '.', -1) = 'A' GROUP BY id")
def s07(t: Tables) -> DataFrame:
    """Timetables whose id ends in the calendar; the last of an id wins."""
    d = t.raw("lineitem").select(F.concat(F.lit("T"), (F.col("l_orderkey") % 500).cast("string"), F.lit("."), "l_returnflag").alias("id"), F.col("l_linenumber").alias("n"))
    return d.where(F.element_at(F.split("id", r"\."), -1) == "A").groupBy("id").agg(F.max("n").alias("n"))


@query("s11_walkable", "SELECT way, highway = 'steps' AS steps FROM tagged_ways WHERE highway IN ('footway', 'steps', 'residential', 'cycleway') AND coalesce(foot, '') NOT IN ('no', 'private') AND NOT (coalesce(access, '') IN ('no', 'private') AND foot IS NULL)")
def s11(t: Tables) -> DataFrame:
    """Ways of walkable kinds without a ban; a foot tag outweighs an access ban."""
    return t.tagged_ways.where(tags.walkable()).select("way", (F.col("highway") == "steps").alias("steps"))


@query("s14_densify", "SELECT trip, seq, k, s0 + (s1 - s0) * k / n AS pos FROM (SELECT trip, seq, arr AS s0, lead(arr) OVER (PARTITION BY trip ORDER BY seq) AS s1, CAST(ceil((lead(arr) OVER (PARTITION BY trip ORDER BY seq) - arr) / 40.0) AS BIGINT) AS n FROM events), LATERAL (SELECT unnest(range(0, n)) AS k) WHERE s1 IS NOT NULL AND n > 0")
def s14(t: Tables) -> DataFrame:
    """Points at most 40 units apart along each step of a way."""
    return S.densify(t.events, "trip", "seq", "arr", 40).select("trip", "seq", "k", "pos")


@query("s20_first_wins", "SELECT stop, trip, seq FROM (SELECT stop, trip, seq, row_number() OVER (PARTITION BY stop ORDER BY trip, seq) AS r FROM events) WHERE r = 1")
def s20(t: Tables) -> DataFrame:
    """Union of extracts in which the first row of a key wins (U-1); an aggregate, so hot keys combine before the shuffle."""
    return S.first_wins(t.events, "stop", ["trip", "seq"]).select("stop", "trip", "seq")


# --- sinks -------------------------------------------------------------------------------------------------


def _round_trip(df: DataFrame, kind: str, *by: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/sink-{uuid.uuid4().hex}"
    df.write.format(kind).partitionBy(*by).save(path) if by else df.write.format(kind).save(path)
    return spark.read.schema(df.schema).format(kind).load(path)


@query("k01_write_timetable", "SELECT pattern, count(*) AS n, CAST(sum(arr) AS BIGINT) AS arr, CAST(sum(dep) AS BIGINT) AS dep FROM events GROUP BY pattern")
def k01(t: Tables) -> DataFrame:
    """The timetable written by pattern, read back."""
    d = _round_trip(t.events.select("trip", "seq", "stop", "arr", "dep", F.col("pattern").cast("bigint").alias("pattern")), "parquet", "pattern")
    return d.groupBy(F.col("pattern").cast("bigint").alias("pattern")).agg(F.count("*").alias("n"), F.sum("arr").alias("arr"), F.sum("dep").alias("dep"))


@query("k02_write_stops_json", "SELECT stop, line, cluster, operator, name FROM stops")
def k02(t: Tables) -> DataFrame:
    return _round_trip(t.stops.select("stop", "line", "cluster", "operator", "name"), "json")


@query("k06_write_tiles", f"SELECT CAST(floor((lon - 139.6) * {geo.KX} / 2000) AS BIGINT) AS tile, stop, size FROM stops")
def k06(t: Tables) -> DataFrame:
    d = t.stops.select(F.floor((F.col("lon") - 139.6) * F.lit(geo.KX) / 2000).alias("tile"), "stop", "size")
    return _round_trip(d, "parquet", "tile").select(F.col("tile").cast("bigint").alias("tile"), "stop", "size")


@query("k08_json_rows", "SELECT stop, '{\"stop\":' || stop || ',\"line\":' || line || ',\"operator\":\"' || operator || '\"}' AS body FROM stops")
def k08(t: Tables) -> DataFrame:
    return t.stops.select("stop", F.to_json(F.struct("stop", "line", "operator")).alias("body"))


# --- filters -----------------------------------------------------------------------------------------------


@query("p01_boardable", f"SELECT trip, seq, stop FROM events JOIN access USING (stop) WHERE trunc({DEPART} + sec) + 60 <= dep AND dep <= {DEADLINE}")
def p01(t: Tables) -> DataFrame:
    labels = t.access.select("stop", (F.lit(DEPART) + F.col("sec")).cast("bigint").alias("best"))
    return t.events.where(F.col("dep") <= DEADLINE).join(labels, "stop").where(raptor.boardable(F.col("best"), F.col("dep"), DEADLINE)).select("trip", "seq", "stop")


@query("p03_deadline_prune", f"SELECT stop, CAST(trunc({DEPART} + sec) AS BIGINT) AS best FROM access WHERE sec <= 3600 AND trunc({DEPART} + sec) <= {DEADLINE}")
def p03(t: Tables) -> DataFrame:
    """Access labels within the limit and the deadline."""
    return raptor.initial_labels(t.access, DEPART, 3600, DEADLINE)


RESTRICT_SQL = "SELECT trip, dense_rank() OVER (PARTITION BY trip ORDER BY island) AS run, row_number() OVER (PARTITION BY trip, island ORDER BY seq) AS pos, seq, stop FROM (SELECT trip, seq, stop, seq - row_number() OVER (PARTITION BY trip ORDER BY seq) AS island FROM events WHERE stop % 5 <> 0 AND trip % 11 <> 0)"


@query("p05_restrict", RESTRICT_SQL)
def p05(t: Tables) -> DataFrame:
    """Events at kept stops without dropped trips, split at gaps."""
    keep = t.stops.where("stop % 5 <> 0")
    drop = t.events.where("trip % 11 = 0").select("trip").distinct()
    return raptor.restrict(t.events, keep, drop).select("trip", "run", "pos", "seq", "stop")


@query("p06_bbox_ways", "SELECT trip, count(*) AS inside FROM events JOIN stops USING (stop) WHERE lon >= 139.65 AND lon < 139.8 AND lat >= 35.6 AND lat < 35.75 GROUP BY trip HAVING count(*) >= 2")
def p06(t: Tables) -> DataFrame:
    """Ways with two points or more inside a half-open box."""
    box = t.stops.where("lon >= 139.65 and lon < 139.8 and lat >= 35.6 and lat < 35.75").select("stop")
    return t.events.join(box, "stop").groupBy("trip").agg(F.count("*").alias("inside")).where("inside >= 2")


@query("p09_excluded", "SELECT stop, name FROM stops WHERE NOT (name = 'part 7' OR split_part(name, ' ', 2) = '11' OR starts_with(name, 'part 1') OR starts_with(name, 'Part#1') OR operator = 'Brand#11')")
def p09(t: Tables) -> DataFrame:
    """Rows not excluded by name, base name or prefix."""
    bad = (F.col("name") == "part 7") | (F.coalesce(F.get(F.split("name", " "), F.lit(1)), F.lit("")) == "11") | F.col("name").startswith("part 1") | F.col("name").startswith("Part#1") | (F.col("operator") == "Brand#11")
    return t.stops.where(~bad).select("stop", "name")


@query("p13_superset", "SELECT l_orderkey AS trip FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT CASE WHEN l_linenumber IN (1, 2, 3) THEN l_linenumber END) = 3")
def p13(t: Tables) -> DataFrame:
    """Lines that have all of the listed stations (relational division)."""
    d = t.raw("lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("have"))
    return d.where(F.size(F.array_except(F.array(*[F.lit(i) for i in (1, 2, 3)]), "have")) == 0).select(F.col("l_orderkey").alias("trip"))


@query("p16_rides_compatible", "SELECT DISTINCT trip % 17 AS service, line FROM events JOIN stops USING (stop) WHERE (trip % 2 = 0) = (line % 2 = 0)")
def p16(t: Tables) -> DataFrame:
    """Services and lines of the same kind (high-speed with high-speed only)."""
    d = t.events.select("stop", (F.col("trip") % 17).alias("service"), (F.col("trip") % 2 == 0).alias("fast")).join(t.stops.select("stop", "line"), "stop")
    return d.where(F.col("fast") == (F.col("line") % 2 == 0)).select("service", "line").distinct()


@query("p17_clamped_request", "SELECT event_id, least(greatest(CAST(floor(value) AS BIGINT), 1), 300) AS budget, least(least(greatest(CAST(floor(value / 2) AS BIGINT), 0), 60), least(greatest(CAST(floor(value) AS BIGINT), 1), 300)) AS egress, least(greatest(CAST(floor(value * 2) AS BIGINT), least(least(greatest(CAST(floor(value / 2) AS BIGINT), 0), 60), least(greatest(CAST(floor(value) AS BIGINT), 1), 300))), least(greatest(CAST(floor(value) AS BIGINT), 1), 300)) AS walk_total FROM rides")
def p17(t: Tables) -> DataFrame:
    """Request parameters held to egress <= walk_total <= budget <= 300 minutes."""
    b = F.least(F.greatest(F.floor("value"), F.lit(1).cast("bigint")), F.lit(300).cast("bigint"))
    d = t.rides.select("event_id", "value", b.alias("budget"))
    d = d.withColumn("egress", F.least(F.greatest(F.floor(F.col("value") / 2), F.lit(0).cast("bigint")), F.lit(60).cast("bigint"), F.col("budget")))
    return d.withColumn("walk_total", F.least(F.greatest(F.floor(F.col("value") * 2), F.col("egress")), F.col("budget"))).drop("value")


@query("p18_covered_services", "WITH s AS (SELECT DISTINCT trip, stop FROM events), o AS (SELECT stop, count(*) AS n FROM s GROUP BY stop) SELECT trip, count(*) AS stations FROM s JOIN o USING (stop) GROUP BY trip HAVING NOT (100 * count_if(n > 30) >= 95 * count(*))")
def p18(t: Tables) -> DataFrame:
    """Services of which less than 95 % of stations are served by thirty others or more."""
    s = t.events.select("trip", "stop").distinct()
    n = s.groupBy("stop").agg(F.count("*").alias("n"))
    return s.join(n, "stop").groupBy("trip").agg(F.count("*").alias("stations"), F.count_if(F.col("n") > 30).alias("c")).where("not (100 * c >= 95 * stations)").select("trip", "stations")


@query("p19_usable_groups", "SELECT cluster, bool_or(size > 40 AND stop % 3 = 0) AS usable FROM stops GROUP BY cluster")
def p19(t: Tables) -> DataFrame:
    return t.stops.groupBy("cluster").agg(F.bool_or((F.col("size") > 40) & (F.col("stop") % 3 == 0)).alias("usable"))


@query("p20_segment_class", "SELECT stop, CASE WHEN kind LIKE 'PROMO%' THEN 'fast' WHEN size >= 25 THEN 'electric' ELSE 'plain' END AS class FROM stops")
def p20(t: Tables) -> DataFrame:
    return t.stops.select("stop", F.when(F.col("kind").startswith("PROMO"), "fast").when(F.col("size") >= 25, "electric").otherwise("plain").alias("class"))


# --- aggregates --------------------------------------------------------------------------------------------


@query("a01_min_arrival", "SELECT stop, min(arr) AS best FROM events GROUP BY stop")
def a01(t: Tables) -> DataFrame:
    return t.events.groupBy("stop").agg(F.min("arr").alias("best"))


@query("a02_best_per_group", "SELECT stop, arr, trip, seq FROM (SELECT *, row_number() OVER (PARTITION BY stop ORDER BY arr, seq, trip) AS r FROM events) WHERE r = 1")
def a02(t: Tables) -> DataFrame:
    """The row with the least (value, tie-breaker) of each key, by one partial aggregate."""
    return t.events.groupBy("stop").agg(F.min(F.struct("arr", "seq", "trip")).alias("b")).select("stop", "b.arr", "b.trip", "b.seq")


@query("a03_cell_min", f"SELECT CAST(floor((lon - 139.6) * {geo.KX} / 500) AS BIGINT) AS x, CAST(floor((lat - 35.55) * {geo.KY} / 500) AS BIGINT) AS y, round(min(sec), 4) AS sec FROM stops JOIN access USING (stop) GROUP BY 1, 2")
def a03(t: Tables) -> DataFrame:
    d = t.stops.join(t.access, "stop").groupBy(F.floor((F.col("lon") - 139.6) * F.lit(geo.KX) / 500).alias("x"), F.floor((F.col("lat") - 35.55) * F.lit(geo.KY) / 500).alias("y"))
    return d.agg(F.round(F.min("sec"), 4).alias("sec"))


@query("a04_coarse_min", "SELECT x // 4 AS x, y // 4 AS y, min(x * 17 + y) AS sec FROM cells WHERE land GROUP BY 1, 2")
def a04(t: Tables) -> DataFrame:
    """Cells merged to coarser ones, minimum again."""
    return t.cells.where("land").groupBy(F.floor(F.col("x") / 4).alias("x"), F.floor(F.col("y") / 4).alias("y")).agg(F.min(F.col("x") * 17 + F.col("y")).alias("sec"))


@query("a06_scope_total", "SELECT operator, count(DISTINCT cluster) AS groups, count(DISTINCT line) AS lines FROM stops WHERE size > 10 GROUP BY operator")
def a06(t: Tables) -> DataFrame:
    return t.stops.where("size > 10").groupBy("operator").agg(F.countDistinct("cluster").alias("groups"), F.countDistinct("line").alias("lines"))


@query("a07_mean_position", "SELECT cluster, round(avg(lon), 6) AS lon, round(avg(lat), 6) AS lat FROM stops GROUP BY cluster")
def a07(t: Tables) -> DataFrame:
    """Mean position of a cell's or group's points."""
    return t.stops.groupBy("cluster").agg(F.round(F.avg("lon"), 6).alias("lon"), F.round(F.avg("lat"), 6).alias("lat"))


@query("a09_majority_vote", "SELECT line, count_if(size > 25) * 2 > count(*) AS land FROM stops GROUP BY line")
def a09(t: Tables) -> DataFrame:
    return t.stops.groupBy("line").agg((F.count_if(F.col("size") > 25) * 2 > F.count("*")).alias("land"))


@query("a10_median", "SELECT line, median(size) AS m FROM stops GROUP BY line")
def a10(t: Tables) -> DataFrame:
    return t.stops.groupBy("line").agg(F.median("size").alias("m"))


@query("a11_weighted_mean", "SELECT p_brand AS brand, round(sum(p_retailprice * p_size) / sum(p_size), 6) AS mean, max_by(kind, struct_pack(n := w, k := kind)) AS kind FROM part JOIN (SELECT p_brand AS pb, p_type AS kind, sum(p_size) AS w FROM part GROUP BY 1, 2) ON pb = p_brand GROUP BY p_brand")
def a11(t: Tables) -> DataFrame:
    """Length-weighted mean, and the kind with most length (the greatest name on ties)."""
    p = t.raw("part")
    by_kind = p.groupBy("p_brand", "p_type").agg(F.sum("p_size").alias("w"), F.sum(F.col("p_retailprice") * F.col("p_size")).alias("v"))
    return by_kind.groupBy(F.col("p_brand").alias("brand")).agg(F.round(F.sum("v") / F.sum("w"), 6).alias("mean"), F.max(F.struct("w", F.col("p_type").alias("kind")))["kind"].alias("kind"))


@query("a12_most_common", "SELECT line, operator FROM (SELECT line, operator, row_number() OVER (PARTITION BY line ORDER BY count(*) DESC, operator) AS r FROM stops GROUP BY line, operator) WHERE r = 1")
def a12(t: Tables) -> DataFrame:
    """Most common value, the least on ties."""
    n = t.stops.groupBy("line", "operator").agg(F.count("*").alias("n"))
    return n.groupBy("line").agg(F.min(F.struct((-F.col("n")).alias("n"), "operator"))["operator"].alias("operator"))


HEAD_SQL = "SELECT a, b, min(h) AS headway FROM (SELECT stop AS a, nxt AS b, h FROM s UNION ALL SELECT nxt, stop, h FROM s) GROUP BY a, b"


@query("a13_symmetric_headway", "WITH s AS (SELECT * FROM (SELECT stop, lead(stop) OVER w AS nxt, lead(arr) OVER w - dep AS h FROM events WINDOW w AS (PARTITION BY trip ORDER BY seq)) WHERE nxt IS NOT NULL) " + HEAD_SQL)
def a13(t: Tables) -> DataFrame:
    """Least headway of a pair of stations, the same both ways."""
    s = S.adjacent(t.events, "trip", "seq", ["stop", "arr"]).select("stop", F.col("next_stop").alias("nxt"), (F.col("next_arr") - F.col("dep")).alias("h"))
    both = s.select(F.col("stop").alias("a"), F.col("nxt").alias("b"), "h").union(s.select("nxt", "stop", "h"))
    return both.groupBy("a", "b").agg(F.min("h").alias("headway"))


@query("a15_large_components", "SELECT stop, cluster FROM (SELECT stop, cluster, count(*) OVER (PARTITION BY cluster) AS n FROM stops) WHERE n >= 5")
def a15(t: Tables) -> DataFrame:
    n = t.stops.groupBy("cluster").agg(F.count("*").alias("n")).where("n >= 5")
    return t.stops.join(n, "cluster", "left_semi").select("stop", "cluster")


@query("a17_merge_books", "SELECT line, array_to_string(list_sort(list(DISTINCT operator)), ',') AS operators, min_by(name, stop) AS first_name FROM stops GROUP BY line")
def a17(t: Tables) -> DataFrame:
    """Merged dictionaries: lists are united, the first writer of a scalar wins."""
    return t.stops.groupBy("line").agg(F.array_join(F.sort_array(F.collect_set("operator")), ",").alias("operators"), F.min_by("name", "stop").alias("first_name"))


@query("a18_tally", "SELECT operator, count(*) AS n FROM stops GROUP BY operator")
def a18(t: Tables) -> DataFrame:
    return t.stops.groupBy("operator").agg(F.count("*").alias("n"))


@query("a19_unambiguous", "SELECT stop % 1500 AS k, min_by(name, struct_pack(n := length(name), v := name)) AS name FROM stops GROUP BY 1 HAVING count(DISTINCT operator) = 1")
def a19(t: Tables) -> DataFrame:
    """Shortest name of a key; a key with conflicting values is dropped."""
    d = t.stops.groupBy((F.col("stop") % 1500).alias("k")).agg(F.min(F.struct(F.length("name").alias("n"), "name"))["name"].alias("name"), F.countDistinct("operator").alias("c"))
    return d.where("c = 1").select("k", "name")


@query("a20_any_all", "SELECT line, bool_or(size > 45) AS any_large, bool_and(size > 2) AS all_some FROM stops GROUP BY line")
def a20(t: Tables) -> DataFrame:
    return t.stops.groupBy("line").agg(F.bool_or(F.col("size") > 45).alias("any_large"), F.bool_and(F.col("size") > 2).alias("all_some"))


# --- windows -----------------------------------------------------------------------------------------------


BOARD_SQL = f"SELECT e.trip, e.seq, max(CASE WHEN trunc({DEPART} + sec) + 60 <= dep AND dep <= {DEADLINE} THEN e.seq END) OVER (PARTITION BY e.trip ORDER BY e.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS boarded FROM events AS e LEFT JOIN access USING (stop)"


@query("w01_running_boarding", BOARD_SQL)
def w01(t: Tables) -> DataFrame:
    labels = t.access.select("stop", (F.lit(DEPART) + F.col("sec")).cast("bigint").alias("best"))
    return raptor.board(t.events, labels, DEADLINE).select("trip", "seq", "boarded")


@query("w02_least_walk_boarding", f"SELECT trip, seq, CASE WHEN b IS NOT NULL THEN -b.s END AS boarded FROM (SELECT e.trip, e.seq, min(CASE WHEN trunc({DEPART} + sec) + 60 <= dep AND dep <= {DEADLINE} THEN struct_pack(w := CAST(trunc(sec) AS BIGINT), s := -e.seq) END) OVER (PARTITION BY e.trip ORDER BY e.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events AS e LEFT JOIN access USING (stop))")
def w02(t: Tables) -> DataFrame:
    """Boarding with the least walk so far, the latest on ties."""
    d = t.events.join(t.access, "stop", "left").withColumn("best", (F.lit(DEPART) + F.col("sec")).cast("bigint"))
    ok = raptor.boardable(F.col("best"), F.col("dep"), DEADLINE)
    w = W.partitionBy("trip").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    b = F.min(F.when(ok, F.struct(F.col("sec").cast("bigint").alias("w"), (-F.col("seq")).alias("s")))).over(w)
    return d.select("trip", "seq", (-b["s"]).alias("boarded"))


@query("w04_arc_length", f"SELECT trip, seq, round(sum(coalesce(d, 0)) OVER (PARTITION BY trip ORDER BY seq ROWS UNBOUNDED PRECEDING), 3) AS m FROM (SELECT trip, seq, sqrt(pow((lon - lag(lon) OVER w) * {geo.KX}, 2) + pow((lat - lag(lat) OVER w) * {geo.KY}, 2)) AS d FROM events JOIN stops USING (stop) WINDOW w AS (PARTITION BY trip ORDER BY seq))")
def w04(t: Tables) -> DataFrame:
    """Length along each trip."""
    d = t.events.join(t.stops.select("stop", "lon", "lat"), "stop")
    return S.arc_length(d, "trip", "seq").select("trip", "seq", F.round("along", 3).alias("m"))


@query("w05_laid_times", "SELECT trip, seq, CAST(18000 + sum(60 + stop % 300) OVER (PARTITION BY trip ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS t FROM events")
def w05(t: Tables) -> DataFrame:
    return t.events.select("trip", "seq", (18000 + F.sum(60 + F.col("stop") % 300).over(W.partitionBy("trip").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))).alias("t"))


@query("w08_runs", "SELECT trip, CAST(run AS BIGINT) AS run, v, count(*) AS n, min(seq) AS first FROM (SELECT *, sum(c) OVER (PARTITION BY trip ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT trip, seq, stop % 3 AS v, CASE WHEN lag(stop % 3) OVER (PARTITION BY trip ORDER BY seq) IS NOT DISTINCT FROM stop % 3 THEN 0 ELSE 1 END AS c FROM events)) GROUP BY trip, run, v")
def w08(t: Tables) -> DataFrame:
    """Run-length encoding of equal neighbours."""
    return S.runs(t.events.withColumn("v", F.col("stop") % 3), "trip", "seq", "v").select("trip", "run", "v", "n", "first")


@query("w09_adjacent_pairs", "SELECT trip, seq, stop, nxt FROM (SELECT trip, seq, stop, lead(stop) OVER (PARTITION BY trip ORDER BY seq) AS nxt FROM events) WHERE nxt IS NOT NULL")
def w09(t: Tables) -> DataFrame:
    return S.adjacent(t.events, "trip", "seq", ["stop"]).select("trip", "seq", "stop", F.col("next_stop").alias("nxt"))


@query("w10_consecutive_dedupe", "SELECT trip, seq, v FROM (SELECT trip, seq, stop % 4 AS v, lag(stop % 4) OVER (PARTITION BY trip ORDER BY seq) AS p FROM events) WHERE p IS DISTINCT FROM v")
def w10(t: Tables) -> DataFrame:
    return S.consecutive_distinct(t.events.withColumn("v", F.col("stop") % 4), "trip", "seq", "v").select("trip", "seq", "v")


@query("w11_first_occurrence", "SELECT trip, stop % 10 AS c, min(seq) AS seq FROM events GROUP BY 1, 2")
def w11(t: Tables) -> DataFrame:
    return t.events.groupBy("trip", (F.col("stop") % 10).alias("c")).agg(F.min("seq").alias("seq"))


GAP = "(SELECT trip, seq, arr, arr - lag(arr) OVER (PARTITION BY trip ORDER BY seq) AS gap FROM events)"


@query("w12_outlier_gaps", f"SELECT trip, seq, gap FROM (SELECT *, median(gap) OVER (PARTITION BY trip) AS m FROM {GAP}) WHERE gap > greatest(1.5 * m, 400)")
def w12(t: Tables) -> DataFrame:
    """Gaps far over the median of their trip."""
    return S.outlier_gaps(t.events, "trip", "seq", "arr", 1.5, 400).select("trip", "seq", "gap")


@query("w13_max_gap", f"SELECT trip, max(gap) AS longest, CAST(sum(gap) AS BIGINT) AS total FROM {GAP} GROUP BY trip")
def w13(t: Tables) -> DataFrame:
    g = S.gaps(t.events, "trip", "seq", "arr")
    return g.groupBy("trip").agg(F.max("gap").alias("longest"), F.sum("gap").alias("total"))


@query("w14_false_close", "SELECT trip, (max_by(stop, seq) - min_by(stop, seq)) > 3 * median(stop) AS false_close FROM events GROUP BY trip")
def w14(t: Tables) -> DataFrame:
    """Trips whose closing gap is far over the median."""
    return t.events.groupBy("trip").agg((F.max_by("stop", "seq") - F.min_by("stop", "seq") > 3 * F.median("stop")).alias("false_close"))


@query("w15_monotonic", "SELECT trip, coalesce(bool_and(d >= 0), true) OR coalesce(bool_and(d <= 0), true) AS follows FROM (SELECT trip, stop - lag(stop) OVER (PARTITION BY trip ORDER BY seq) AS d FROM events) GROUP BY trip")
def w15(t: Tables) -> DataFrame:
    g = S.gaps(t.events, "trip", "seq", "stop")
    return g.groupBy("trip").agg((F.coalesce(F.bool_and(F.col("gap") >= 0), F.lit(True)) | F.coalesce(F.bool_and(F.col("gap") <= 0), F.lit(True))).alias("follows"))


@query("w16_lexicographic_winner", "SELECT line, stop FROM (SELECT line, stop, row_number() OVER (PARTITION BY line ORDER BY size DESC, kind, name, stop) AS r FROM stops) WHERE r = 1")
def w16(t: Tables) -> DataFrame:
    return t.stops.groupBy("line").agg(F.min(F.struct((-F.col("size")).alias("s"), "kind", "name", "stop"))["stop"].alias("stop"))


# --- sorts and set operations ------------------------------------------------------------------------------


@query("t01_farthest", "SELECT name, sec FROM (SELECT operator AS name, round(sec, 3) AS sec, row_number() OVER (PARTITION BY operator ORDER BY sec DESC, stop) AS r FROM stops JOIN access USING (stop) WHERE sec <= 7200) WHERE r = 1 ORDER BY sec DESC, name LIMIT 8")
def t01(t: Tables) -> DataFrame:
    """The eight farthest places reached, one for each name."""
    d = t.stops.join(t.access.where("sec <= 7200"), "stop").groupBy(F.col("operator").alias("name")).agg(F.round(F.max("sec"), 3).alias("sec"))
    return d.orderBy(F.col("sec").desc(), "name").limit(8)


@query("t02_nearest_station", "SELECT stop, round(sec, 3) AS sec FROM access WHERE sec <= CASE WHEN EXISTS (SELECT 1 FROM access WHERE sec <= 3600) THEN 3600 ELSE 21600 END ORDER BY access.sec, stop LIMIT 1")
def t02(t: Tables) -> DataFrame:
    """Nearest station within one hour, else within six."""
    first = t.access.where("sec <= 3600").orderBy("sec", "stop").limit(1)
    wide = t.access.where("sec <= 21600").orderBy("sec", "stop").limit(1)
    return first.unionByName(wide).orderBy("sec", "stop").limit(1).select("stop", F.round("sec", 3).alias("sec"))


@query("t04_sorted_edges", "SELECT src, dst, cost, row_number() OVER (PARTITION BY src ORDER BY dst, cost) AS pos FROM transfers")
def t04(t: Tables) -> DataFrame:
    """Walks numbered at their stop, by destination."""
    return tiles.ranked_walks(t.stops, 1000.0)


@query("t05_regions_by_size", "SELECT operator, count(*) AS n FROM stops GROUP BY operator ORDER BY n DESC, operator")
def t05(t: Tables) -> DataFrame:
    return t.stops.groupBy("operator").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "operator")


@query("t06_skeleton_order", "SELECT trip, trip % 2 AS x, trip % 3 AS y, count(*) AS n FROM events GROUP BY trip ORDER BY x, y, n DESC, trip")
def t06(t: Tables) -> DataFrame:
    """Services ordered by several keys: a range-partitioned sort, no task holds all rows."""
    d = t.events.groupBy("trip").agg(F.count("*").alias("n"))
    return d.select("trip", (F.col("trip") % 2).alias("x"), (F.col("trip") % 3).alias("y"), "n").orderBy("x", "y", F.col("n").desc(), "trip")


@query("t09_biggest_parts", "SELECT line, cluster FROM (SELECT line, cluster, sum(size) AS a, max(sum(size)) OVER (PARTITION BY line) AS m FROM stops GROUP BY line, cluster) WHERE a * 5 >= m")
def t09(t: Tables) -> DataFrame:
    """Parts of a fifth of the largest part or more."""
    a = t.stops.groupBy("line", "cluster").agg(F.sum("size").alias("a"))
    return a.withColumn("m", F.max("a").over(W.partitionBy("line"))).where("a * 5 >= m").select("line", "cluster")


@query("u02_intersection", "SELECT stop FROM events WHERE pattern = 3 INTERSECT SELECT stop FROM events WHERE pattern = 5")
def u02(t: Tables) -> DataFrame:
    return t.events.where("pattern = 3").select("stop").intersect(t.events.where("pattern = 5").select("stop"))


@query("u03_difference", "SELECT stop FROM stops EXCEPT SELECT stop FROM events WHERE pattern = 3")
def u03(t: Tables) -> DataFrame:
    return t.stops.select("stop").exceptAll(t.events.where("pattern = 3").select("stop").distinct())


@query("u04_union_cells", "SELECT cell, min(sec) AS sec FROM (SELECT cell, x AS sec FROM cells WHERE land UNION ALL SELECT cell, y FROM cells WHERE x < 20) GROUP BY cell")
def u04(t: Tables) -> DataFrame:
    return t.cells.where("land").select("cell", F.col("x").alias("sec")).union(t.cells.where("x < 20").select("cell", "y")).groupBy("cell").agg(F.min("sec").alias("sec"))


@query("u05_union_minus_duplicates", "SELECT line, kind, 0 AS src FROM stops WHERE size < 10 GROUP BY ALL UNION ALL SELECT line, kind, 1 FROM (SELECT DISTINCT line, kind FROM stops WHERE size < 14) AS w WHERE NOT EXISTS (SELECT 1 FROM stops AS s WHERE s.size < 10 AND s.line = w.line AND s.kind = w.kind)")
def u05(t: Tables) -> DataFrame:
    a = t.stops.where("size < 10").select("line", "kind").distinct()
    b = t.stops.where("size < 14").select("line", "kind").distinct().join(a, ["line", "kind"], "left_anti")
    return a.withColumn("src", F.lit(0)).unionByName(b.withColumn("src", F.lit(1)))


@query("u06_same_service", "SELECT key, min(trip) AS trip, count(*) AS n FROM (SELECT trip, array_to_string(list_sort(list(DISTINCT stop % 6)), ',') AS key FROM events GROUP BY trip) GROUP BY key")
def u06(t: Tables) -> DataFrame:
    """Services with the same set of stops, once."""
    d = t.events.groupBy("trip").agg(F.array_join(F.sort_array(F.collect_set(F.col("stop") % 6)).cast("array<string>"), ",").alias("key"))
    return d.groupBy("key").agg(F.min("trip").alias("trip"), F.count("*").alias("n"))


@query("u08_unique_rows", "SELECT CAST(round_even(lon * 1000, 0) AS BIGINT) AS x, CAST(round_even(lat * 1000, 0) AS BIGINT) AS y, min(stop) AS first FROM stops GROUP BY 1, 2")
def u08(t: Tables) -> DataFrame:
    return t.stops.groupBy(F.bround(F.col("lon") * 1000, 0).cast("bigint").alias("x"), F.bround(F.col("lat") * 1000, 0).cast("bigint").alias("y")).agg(F.min("stop").alias("first"))
