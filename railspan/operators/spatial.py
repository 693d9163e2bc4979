"""Radius, nearest-neighbour and containment joins by grid buckets.

The bucket width is the radius, so partners lie in the 3 x 3 neighbourhood: one side is copied to nine
buckets, an equi-join on the bucket follows, and the exact distance is the residual. There is no cross join,
and a dense bucket is split by AQE's skew handling. The copied side is never broadcast: Spark guesses its size from
the file, without the nine copies. Joins that return all pairs use buckets of half the width, which leaves fewer pairs to test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import KX, KY, flat_m


def _bucket(lon: Column, lat: Column, radius: float) -> tuple[Column, Column]:
    return F.floor(lon * F.lit(KX) / radius), F.floor(lat * F.lit(KY) / radius)


def _around(d: DataFrame, parts: int = 1) -> DataFrame:
    """Copies of each row to the bucket's neighbourhood, parts buckets to each side."""
    steps = f"sequence({-parts}, {parts})"
    near = F.expr(f"flatten(transform({steps}, i -> transform({steps}, j -> named_struct('i', i, 'j', j))))")
    return d.withColumn("_n", F.explode(near)).withColumn("_gx", F.col("_gx") + F.col("_n.i")).withColumn("_gy", F.col("_gy") + F.col("_n.j")).drop("_n")


def radius_join(left: DataFrame, right: DataFrame, radius: float, on: tuple[str, ...] = (), parts: int = 1) -> DataFrame:
    """Pairs of left (lon, lat, ...) and right (rlon, rlat, ...) within radius metres and equal in the columns on, with their distance m. Rows without a position match nothing.

    parts is the number of buckets across a radius.
    """
    gx, gy = _bucket(F.col("lon"), F.col("lat"), radius / parts)
    a = left.where("not isnan(lon) and not isnan(lat)").withColumns({"_gx": gx, "_gy": gy})
    gx, gy = _bucket(F.col("rlon"), F.col("rlat"), radius / parts)
    b = _around(right.where("not isnan(rlon) and not isnan(rlat)").withColumns({"_gx": gx, "_gy": gy}), parts)
    m = flat_m(F.col("lon"), F.col("lat"), F.col("rlon"), F.col("rlat"))
    return a.join(b.hint("merge"), ["_gx", "_gy", *on]).withColumn("m", m).where(F.col("m") <= radius).drop("_gx", "_gy")


def ordered_pairs(points: DataFrame, key: str, radius: float) -> DataFrame:
    """Pairs of points (key, lon, lat, ...) of different keys within radius metres, both ways: the columns of one, those of the other with r before their names, and m."""
    right = points.withColumnsRenamed({c: f"r{c}" for c in points.columns})
    return radius_join(points, right, radius, parts=2).where(F.col(key) != F.col(f"r{key}"))


def radius_pairs(points: DataFrame, key: str, radius: float) -> DataFrame:
    """Unordered pairs (a, b, m), a < b, of points (key, lon, lat) within radius metres."""
    d = ordered_pairs(points.select(key, "lon", "lat"), key, radius)
    return d.where(F.col(key) < F.col(f"r{key}")).select(F.col(key).alias("a"), F.col(f"r{key}").alias("b"), "m")


def neighbours(points: DataFrame, key: str, radius: float) -> DataFrame:
    """(key, n): how many points of another key lie within radius metres, for points with any. One join counts each pair at both ends."""
    right = points.select(F.col(key).alias("_b"), F.col("lon").alias("rlon"), F.col("lat").alias("rlat"))
    return radius_join(points.select(key, "lon", "lat"), right, radius).where(F.col(key) != F.col("_b")).groupBy(key).agg(F.count("*").alias("n"))


def clusters(points: DataFrame, key: str, radius: float, on: tuple[str, ...] = ()) -> DataFrame:
    """(node, comp): components of points (key, lon, lat, on) that lie within radius metres of each other and are equal in the columns on; comp is the least key.

    Points of one cell whose diagonal is under the radius are linked with no test, and cells are linked once, however many of their points
    are: what is written grows with the cells met, not with the pairs.
    """
    from ..plans.fixpoint import cut
    from .graph import components

    cell = list(_bucket(F.col("lon"), F.col("lat"), radius / 1.5))
    p = points.select(F.col(key).alias("node"), "lon", "lat", *on).withColumns({"_cx": cell[0], "_cy": cell[1]})
    placed = F.lit(True)
    for c in ("lon", "lat", *on):
        placed = placed & F.col(c).isNotNull()
    placed = placed & ~F.isnan("lon") & ~F.isnan("lat")
    least = p.where(placed).groupBy(*on, "_cx", "_cy").agg(F.min("node").alias("rep"))
    p = cut(p.where(placed).join(least, [*on, "_cx", "_cy"]).select("node", "rep", "lon", "lat", *on).unionByName(p.where(~placed).select("node", F.col("node").alias("rep"), "lon", "lat", *on)))
    right = p.select(F.col("rep").alias("_rep"), F.col("lon").alias("rlon"), F.col("lat").alias("rlat"), *on)
    met = radius_join(p.select("rep", "lon", "lat", *on), right, radius, on).where("rep < _rep").select(F.col("rep").alias("a"), F.col("_rep").alias("b")).distinct()
    again = p.groupBy("node").agg(F.min("rep").alias("a"), F.max("rep").alias("b"))  # a key that stands at several places links them
    again = p.join(again.where("a < b"), "node").select("a", F.col("rep").alias("b"))
    found = components(p.select(F.col("rep").alias("node")).distinct(), met.unionByName(again))
    return p.join(found.select(F.col("node").alias("rep"), "comp"), "rep").groupBy("node").agg(F.min("comp").alias("comp"))


def closest(left: DataFrame, right: DataFrame, key: str, right_key: str, radius: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(key, by, right_key, m): the nearest right row within radius metres of each left row, for each value of the right columns by; the least right_key on ties.

    The least distance goes back to the left rows and the join runs again for the rows at it: both aggregates are hashed on numbers,
    where the least of a struct sorts all pairs.
    """
    d = left.select(key, "lon", "lat")
    least = radius_join(d, right, radius).groupBy(key, *by).agg(F.min("m").alias("_least"))
    at = radius_join(d.join(least, key), right, radius, by).where(F.col("m") == F.col("_least"))
    return at.groupBy(key, *by).agg(F.min(right_key).alias(right_key), F.min("m").alias("m"))


def nearest(left: DataFrame, right: DataFrame, key: str, right_key: str, radius: float) -> DataFrame:
    """(key, right_key, m): the nearest right row within radius metres of each left row, the least right_key on ties; null without one."""
    return left.select(key).join(closest(left, right, key, right_key, radius), key, "left").select(key, right_key, "m")


def pairs_within_slack(points: DataFrame, key: str, radius: float, slack: float) -> DataFrame:
    """Pairs (a, b, m), a < b, of radius_pairs within slack metres of the least m of their a. Only the least goes through a shuffle by key, not the pairs."""
    least = radius_pairs(points, key, radius).groupBy("a").agg(F.min("m").alias("_least"))
    left = points.select(F.col(key).alias("a"), "lon", "lat").join(least, "a")
    right = points.select(F.col(key).alias("b"), F.col("lon").alias("rlon"), F.col("lat").alias("rlat"))
    return radius_join(left, right, radius).where((F.col("a") < F.col("b")) & (F.col("m") <= F.col("_least") + slack)).select("a", "b", "m")


def points_in_polygons(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(point, poly) by ray casting. points (point, x, y); edges (poly, x1, y1, x2, y2) of closed rings, holes included (even-odd).

    Points meet edges in horizontal bands of unit height: an edge is copied to the bands that it spans, so only edges
    at the point's height are tested.
    """
    p = points.withColumn("_band", F.floor("y"))
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    e = edges.withColumn("_band", F.explode(F.sequence(F.floor(low), F.floor(high))))
    cross = (F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))
    at = F.col("x1") + (F.col("y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / F.when(F.col("y2") != F.col("y1"), F.col("y2") - F.col("y1"))
    hits = p.join(e, "_band").where(cross & (F.col("x") < at))
    return hits.groupBy("point", "poly").agg(F.count("*").alias("n")).where("n % 2 = 1").select("point", "poly")
