"""Typed tables of the engine, bound to the driver's tables by integer formulas.

Each method of Tables gives a DataFrame; VIEWS has the same table in SQL, for the oracles. A real deployment
replaces this module by readers of its own stops, events and transfers; the operators only see the columns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.geo import KX, KY

#: The query point and times of the flagship query.
ORIGIN_LON, ORIGIN_LAT, DEPART, BUDGET = 139.75, 35.70, 9 * 3600, 60 * 60
#: Half width of the walking grid around the origin, in cells of 100 m.
GRID = 40

VIEWS = {
    "stops": """SELECT CAST(p_partkey AS BIGINT) AS stop, p_partkey % 97 AS line, p_partkey % 401 AS cluster, p_brand AS operator, p_name AS name, p_type AS kind, p_size AS size,
  139.6 + ((p_partkey * 7919) % 3001) * 1e-4 AS lon, 35.55 + ((p_partkey * 104729) % 2999) * 1e-4 AS lat FROM part""",
    "events": """SELECT l_orderkey AS trip, seq, l_partkey AS stop, arr, arr + (CAST(floor(l_quantity) AS BIGINT) % 3) * 20 AS dep, CASE WHEN l_orderkey % 17 = 0 THEN -1 ELSE l_orderkey % 17 END AS pattern
  FROM (SELECT *, CAST(18000 + (l_orderkey * 613) % 68400 + sum(120 + (l_suppkey * 31 + l_linenumber * 17) % 600) OVER (PARTITION BY l_orderkey ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS arr
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq FROM lineitem))""",
    "near": f"""SELECT a.stop AS a, b.stop AS b, sqrt(pow((a.lon - b.lon) * {KX}, 2) + pow((a.lat - b.lat) * {KY}, 2)) AS m FROM stops AS a JOIN stops AS b ON a.stop < b.stop
  AND a.lat BETWEEN b.lat - 0.0091 AND b.lat + 0.0091 AND sqrt(pow((a.lon - b.lon) * {KX}, 2) + pow((a.lat - b.lat) * {KY}, 2)) <= 1000""",
    "transfers": """SELECT a AS src, b AS dst, CAST(round_even(greatest(300, 90 + 1.25 * m / (80.0 / 60)), 0) AS BIGINT) AS cost FROM near
  UNION ALL SELECT b, a, CAST(round_even(greatest(300, 90 + 1.25 * m / (80.0 / 60)), 0) AS BIGINT) FROM near""",
    "access": f"""SELECT stop, sqrt(pow((lon - {ORIGIN_LON}) * {KX}, 2) + pow((lat - {ORIGIN_LAT}) * {KY}, 2)) * 1.3 / (80.0 / 60) AS sec FROM stops""",
    "cells": f"""SELECT x, y, x * 1000 + y AS cell, ((x * 31 + y * 17) % 7 <> 0) AS land FROM (SELECT i % {2 * GRID} AS x, i // {2 * GRID} AS y FROM (SELECT unnest(range(0, {4 * GRID * GRID})) AS i))""",
    "walk_edges": """SELECT a.cell AS src, b.cell AS dst, CAST(60 + (a.x * 7 + a.y * 13 + b.x * 7 + b.y * 13) % 50 AS BIGINT) AS sec
  FROM (SELECT cell, x, y, x + dx AS nx, y + dy AS ny FROM cells, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) AS s(dx, dy) WHERE land) AS a JOIN cells AS b ON b.x = a.nx AND b.y = a.ny AND b.land""",
    "tagged_nodes": """SELECT stop, name, CASE stop % 5 WHEN 0 THEN 'station' WHEN 1 THEN 'halt' WHEN 2 THEN 'tram_stop' END AS railway, CASE stop % 3 WHEN 0 THEN 'station' WHEN 1 THEN 'stop_position' END AS public_transport,
  CASE WHEN stop % 7 = 0 THEN 'yes' END AS bus, CASE WHEN stop % 11 = 0 THEN 'bus_stop' END AS highway, CASE WHEN stop % 13 = 0 THEN 'yes' END AS ferry, CASE WHEN stop % 17 = 0 THEN 'gondola' END AS aerialway,
  CASE stop % 19 WHEN 0 THEN 'bus_station' WHEN 1 THEN 'ferry_terminal' END AS amenity, CASE stop % 23 WHEN 0 THEN 'training' WHEN 1 THEN 'main' WHEN 2 THEN 'tourism' END AS usage, CASE WHEN stop % 29 = 0 THEN 'yes' END AS monorail FROM stops""",
    "tagged_ways": """SELECT o_orderkey AS way, CASE o_orderkey % 7 WHEN 0 THEN 'footway' WHEN 1 THEN 'steps' WHEN 2 THEN 'motorway' WHEN 3 THEN 'residential' WHEN 4 THEN 'cycleway' END AS highway,
  CASE o_orderkey % 5 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' WHEN 2 THEN 'private' END AS foot, CASE o_orderkey % 4 WHEN 0 THEN 'private' WHEN 1 THEN 'no' END AS access, CASE WHEN o_orderkey % 9 = 0 THEN 'coastline' END AS shore FROM orders""",
    "rides": "SELECT event_id, user_id, event_type, value, ts FROM events_raw",
}


def with_views(sql: str) -> str:
    """sql with the CTEs of the views that it names, in order. A view named events_raw is the driver's events."""
    need: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                visit(VIEWS[name])

    visit(sql)
    head = ", ".join(f"{name} AS ({VIEWS[name]})" for name in VIEWS if name in need)
    sql, head = (x.replace("events_raw", "main.events") for x in (sql, head))
    if not head:
        return sql
    body = sql.strip()
    if re.match(r"WITH RECURSIVE\b", body):
        return f"WITH RECURSIVE {head}, {body[14:]}"
    return f"WITH {head}, {body[5:]}" if re.match(r"WITH\b", body) else f"WITH {head} {body}"


@dataclass
class Tables:
    spark: SparkSession
    sf_dir: str

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def stops(self) -> DataFrame:
        p = F.col("p_partkey").cast("bigint")
        return self.raw("part").select(
            p.alias("stop"), (p % 97).alias("line"), (p % 401).alias("cluster"), F.col("p_brand").alias("operator"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_size").alias("size"),
            (F.lit(139.6) + (p * 7919 % 3001) * F.lit(1e-4)).alias("lon"), (F.lit(35.55) + (p * 104729 % 2999) * F.lit(1e-4)).alias("lat"),
        )

    @cached_property
    def events(self) -> DataFrame:
        """(trip, seq, stop, arr, dep, pattern): one shuffle by trip, which later windows by trip reuse."""
        by = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
        leg = 120 + (F.col("l_suppkey") * 31 + F.col("l_linenumber") * 17) % 600
        arr = 18000 + F.col("l_orderkey") * 613 % 68400 + F.sum(leg).over(by.rowsBetween(W.unboundedPreceding, 0))
        d = self.raw("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity")
        d = d.withColumn("seq", F.row_number().over(by)).withColumn("arr", arr)
        return d.select(
            F.col("l_orderkey").alias("trip"), "seq", F.col("l_partkey").alias("stop"), "arr", (F.col("arr") + F.floor("l_quantity") % 3 * 20).alias("dep"),
            F.when(F.col("l_orderkey") % 17 == 0, -1).otherwise(F.col("l_orderkey") % 17).alias("pattern"),
        )

    @cached_property
    def near(self) -> DataFrame:
        from ..operators.spatial import radius_pairs

        return radius_pairs(self.stops.select("stop", "lon", "lat"), "stop", 1000.0).select("a", "b", "m")

    @cached_property
    def density(self) -> DataFrame:
        """(stop, n): stops within the radius of near, for stops with any."""
        from ..operators.spatial import neighbours

        return neighbours(self.stops.select("stop", "lon", "lat"), "stop", 1000.0)

    @cached_property
    def transfers(self) -> DataFrame:
        from ..functions.geo import walk_cost

        n = self.near.select("a", "b", walk_cost(F.col("m")).alias("cost"))
        return n.select(F.col("a").alias("src"), F.col("b").alias("dst"), "cost").union(n.select("b", "a", "cost"))

    @cached_property
    def walks(self):  # noqa: ANN201
        """The transfers, made from positions where a search needs them."""
        from ..operators.walks import FootWalks

        return FootWalks(self.stops.select("stop", "lon", "lat"), 1000.0)

    @cached_property
    def access(self) -> DataFrame:
        from ..functions.geo import flat_m, walk_seconds

        return self.stops.select("stop", walk_seconds(flat_m(F.col("lon"), F.col("lat"), F.lit(ORIGIN_LON), F.lit(ORIGIN_LAT))).alias("sec"))

    @cached_property
    def cells(self) -> DataFrame:
        n = 2 * GRID
        d = self.spark.range(n * n).select((F.col("id") % n).alias("x"), (F.col("id") / n).cast("bigint").alias("y"))
        return d.select("x", "y", (F.col("x") * 1000 + F.col("y")).alias("cell"), ((F.col("x") * 31 + F.col("y") * 17) % 7 != 0).alias("land"))

    @cached_property
    def walk_edges(self) -> DataFrame:
        """Edges between neighbouring land cells: the four neighbours of a cell are made and looked up, no pair join."""
        land = self.cells.where("land")
        steps = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))]))
        out = land.select("x", "y", "cell", steps.alias("s")).select(F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("cell").alias("src"), (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"))
        out = out.join(land.select("x", "y", F.col("cell").alias("dst")), ["x", "y"])
        return out.select("src", "dst", (60 + (F.col("ax") * 7 + F.col("ay") * 13 + F.col("x") * 7 + F.col("y") * 13) % 50).cast("bigint").alias("sec"))

    @cached_property
    def tagged_nodes(self) -> DataFrame:
        return self._bound("tagged_nodes", self.stops)

    @cached_property
    def tagged_ways(self) -> DataFrame:
        return self._bound("tagged_ways", self.raw("orders"))

    def _bound(self, view: str, source: DataFrame) -> DataFrame:
        """A view whose formulas read one table and are the same in Spark's SQL."""
        return source.sparkSession.sql(re.sub(r" FROM \w+$", " FROM {source}", VIEWS[view]), source=source)

    @cached_property
    def rides(self) -> DataFrame:
        return self.raw("events").select("event_id", "user_id", "event_type", "value", "ts")
