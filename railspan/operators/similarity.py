"""Set-similarity and as-of joins over inverted indexes and ordered windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def overlaps(sets: DataFrame, group: str, item: str) -> DataFrame:
    """(a, b, shared, na, nb), a < b: groups that share an item. Only groups with a common item meet."""
    x = sets.select(F.col(group).alias("a"), F.col(item).alias("i"))
    y = sets.select(F.col(group).alias("b"), F.col(item).alias("i"))
    n = sets.groupBy(group).agg(F.count("*").alias("n"))
    o = x.join(y, "i").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    return o.join(n.select(F.col(group).alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col(group).alias("b"), F.col("n").alias("nb")), "b")


def jaccard_pairs(sets: DataFrame, group: str, item: str, at_least: float, shared: int = 1) -> DataFrame:
    """(a, b, shared, na, nb) with Jaccard similarity and shared items of at least the given numbers, by prefix filtering.

    Items are ranked rarest first; sets this similar share an item among their first n - ceil(at_least * n) + 1, so only
    those items are joined, and the frequent ones never meet. The exact sizes of the candidates follow.
    """
    freq = sets.groupBy(item).agg(F.count("*").alias("_f"))
    n = sets.groupBy(group).agg(F.count("*").alias("_n"))
    w = W.partitionBy(group).orderBy("_f", item)
    d = sets.join(freq, item).join(n, group).withColumn("_r", F.row_number().over(w))
    head = d.where(F.col("_r") <= F.col("_n") - F.ceil(F.lit(at_least) * F.col("_n") - 1e-9) + 1).select(group, item, "_n")
    x = head.select(F.col(group).alias("a"), F.col(item).alias("i"), F.col("_n").alias("na"))
    y = head.select(F.col(group).alias("b"), F.col(item).alias("i"), F.col("_n").alias("nb"))
    pairs = x.join(y, "i").where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.lit(at_least) * F.greatest("na", "nb") - 1e-9)).select("a", "b", "na", "nb").distinct()
    left = pairs.join(sets.select(F.col(group).alias("a"), F.col(item).alias("i")), "a")
    both = left.join(sets.select(F.col(group).alias("b"), F.col(item).alias("i")), ["b", "i"]).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared"))
    return both.where((F.col("shared") >= shared) & (F.col("shared") >= F.lit(at_least) * (F.col("na") + F.col("nb") - F.col("shared")) - 1e-9))


def asof_next(left: DataFrame, at: str, right: DataFrame, time: str, key: str) -> DataFrame:
    """left with the least right time at or after its own, by one sort of both sides together; null without one."""
    a = left.select("*", F.col(at).alias("_t"), F.lit(0).alias("_side"))
    b = right.select(F.col(key), F.col(time).alias("_t"), F.lit(1).alias("_side"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = W.partitionBy(key).orderBy("_t", "_side").rowsBetween(1, W.unboundedFollowing)
    nxt = F.first(F.when(F.col("_side") == 1, F.col("_t")), ignorenulls=True).over(w)
    return both.withColumn(time, nxt).where("_side = 0").drop("_t", "_side")


def pairs_of_key(rows: DataFrame, key: str, on: str, parts: int = 16) -> DataFrame:
    """Ordered pairs of rows of different keys and equal in on: the columns of one, those of the other with r before their names.

    Few values of on would leave few tasks with all the pairs, and Spark sees only the small tables: rows are dealt to parts, the others copied to each.
    """
    a = rows.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    b = rows.withColumnsRenamed({c: f"r{c}" for c in rows.columns if c != on}).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return a.join(b.hint("merge"), [on, "_part"]).where(F.col(key) != F.col(f"r{key}")).drop("_part")
