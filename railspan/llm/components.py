"""Connected components of a link table, by minimum-label propagation with pointer jumping. Nothing is collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(links: DataFrame, start: DataFrame | None = None, most_rounds: int = 60) -> DataFrame:
    """links (u, v) -> (node, comp): comp is the smallest node reachable. Nodes without links have no row.

    start: labels (node, comp) of an earlier, smaller link table; its rows count as links too. Each round is
    one written table; a hub's rows are pre-aggregated before the shuffle. An empty table gives no rows.
    """
    if start is not None:
        links = links.select("u", "v").unionByName(start.where("node <> comp").select(F.col("node").alias("u"), F.col("comp").alias("v")))
    both = written(links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct(), "edges")
    label = written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("comp")), "labels")
    before = label
    for _ in range(most_rounds):
        near = both.join(label, F.col("v") == F.col("node")).groupBy(F.col("u").alias("a")).agg(F.min("comp").alias("best"))
        stepped = label.join(near, F.col("node") == F.col("a"), "left").select("node", F.col("comp").alias("old"), F.least("comp", "best").alias("c"))
        # pointer jumping: take the label of one's label
        jump = label.select(F.col("node").alias("p"), F.col("comp").alias("q"))
        new = written(stepped.join(jump, F.col("c") == F.col("p"), "left").select("node", F.least("c", "q").alias("comp"), (F.least("c", "q") != F.col("old")).alias("moved")), "labels")
        discard(before)
        before, label = new, new.select("node", "comp")
        if new.where("moved").isEmpty():
            discard(both)
            return label
    raise RuntimeError("labels still change; raise most_rounds")
