"""Ordered operators over (group, position) rows; each is one window, so one shuffle by the group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def adjacent(d: DataFrame, group: str, order: str, columns: list[str]) -> DataFrame:
    """Rows with next_<column> of the following row; the last row of a group is left out."""
    w = W.partitionBy(group).orderBy(order)
    out = d.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns} | {"_more": F.lead(F.lit(True)).over(w)})
    return out.where("_more").drop("_more")


def gaps(d: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Rows with gap, the value less that of the row before (null first)."""
    return d.withColumn("gap", F.col(value) - F.lag(value).over(W.partitionBy(group).orderBy(order)))


def outlier_gaps(d: DataFrame, group: str, order: str, value: str, times: float, least: float) -> DataFrame:
    """Rows whose gap is over max(times * median gap of the group, least)."""
    g = gaps(d, group, order, value)
    m = g.groupBy(F.col(group).alias("_g")).agg(F.median("gap").alias("_m"))
    return g.join(m, F.col(group) == F.col("_g")).where(F.col("gap") > F.greatest(F.lit(times) * F.col("_m"), F.lit(float(least)))).drop("_g", "_m")


def runs(d: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Runs of equal neighbours: (group, run from 1, value, n, first, last)."""
    w = W.partitionBy(group).orderBy(order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    d = d.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return d.groupBy(group, "run", value).agg(F.count("*").alias("n"), F.min(order).alias("first"), F.max(order).alias("last"))


def consecutive_distinct(d: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Rows that differ from the one before."""
    w = W.partitionBy(group).orderBy(order)
    return d.withColumn("_same", F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1)).where("not _same").drop("_same")


def first_wins(d: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in d.columns if c != key and c not in order]
    return d.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("_r")).select(key, "_r.*")


def densify(d: DataFrame, group: str, order: str, value: str, step: float) -> DataFrame:
    """Points k = 0, 1, ... at most step apart between each row's value and the next one's."""
    a = adjacent(d, group, order, [value])
    span = F.col(f"next_{value}") - F.col(value)
    a = a.withColumn("_n", F.ceil(span / F.lit(float(step))).cast("bigint")).where("_n > 0")
    return a.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1))).withColumn("pos", F.col(value) + span * F.col("k") / F.col("_n")).drop("_n")


def arc_length(d: DataFrame, group: str, order: str) -> DataFrame:
    """Rows (lon, lat, ...) with along, the metres from the group's first row."""
    from ..functions.geo import flat_m

    w = W.partitionBy(group).orderBy(order)
    d = d.withColumn("_d", flat_m(F.col("lon"), F.col("lat"), F.lag("lon").over(w), F.lag("lat").over(w)))
    return d.withColumn("along", F.sum(F.coalesce("_d", F.lit(0.0))).over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_d")
