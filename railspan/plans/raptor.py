"""Earliest arrivals by trains and walking, in rounds (a label-correcting search over the timetable).

A round starts from the stops whose label changed in the round before: trips that can be boarded there are
boarded at the first such event, passengers alight at all later events of those trips and walk one transfer,
and the least arrival of each stop stays. Events outside the time window are filtered before the first round.
A window of few rows is searched in one task over arrays; a larger one is kept twice, by stop for boarding and by trip for riding, so a round shuffles labels and trips
boarded, not the events.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.walks import FootWalks, Relaxer
from .fixpoint import cut, fixpoint

#: Seconds between arriving at a stop and boarding there, and rounds at most.
CHANGE, ROUNDS = 60, 12
#: Rows of a time window, events and transfers, that one task may hold (about 50 bytes each).
TASK_ROWS = 4_000_000


def initial_labels(access: DataFrame, depart: int, limit: float, deadline: int) -> DataFrame:
    """(stop, best): access seconds cut to whole ones after the departure."""
    a = access.where(F.col("sec") <= limit).select("stop", (F.lit(depart) + F.col("sec")).cast("bigint").alias("best"))
    return a.where(F.col("best") <= deadline)


def boardable(best: Column, dep: Column, deadline: int) -> Column:
    return (best + CHANGE <= dep) & (dep <= deadline)


def board(events: DataFrame, best: DataFrame, deadline: int) -> DataFrame:
    """Events with the label of their stop and the last boardable event before each in its trip (null: not on board)."""
    e = events.join(best, "stop", "left")
    w = W.partitionBy("trip").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    return e.withColumn("boarded", F.max(F.when(boardable(F.col("best"), F.col("dep"), deadline), F.col("seq"))).over(w))


def alight(boarded: DataFrame, deadline: int) -> DataFrame:
    return boarded.where(F.col("boarded").isNotNull() & (F.col("arr") <= deadline)).groupBy("stop").agg(F.min("arr").alias("best"))


def walked_from(best: DataFrame, transfers: DataFrame | FootWalks) -> DataFrame:
    """(src, dst, best, cost) of the walks from labels (stop, best)."""
    if isinstance(transfers, FootWalks):
        return transfers.joined(best)
    return best.join(transfers, F.col("stop") == F.col("src")).select("src", "dst", "best", "cost")


def relax_transfers(best: DataFrame, transfers: DataFrame | FootWalks, deadline: int) -> DataFrame:
    """Labels after one walk at most from each stop."""
    walked = walked_from(best, transfers).select(F.col("dst").alias("stop"), (F.col("best") + F.col("cost")).alias("best"))
    return best.select("stop", "best").union(walked).where(F.col("best") <= deadline).groupBy("stop").agg(F.min("best").alias("best"))


def earliest_arrivals(events: DataFrame, transfers: DataFrame | FootWalks, access: DataFrame, depart: int, deadline: int, limit: float, rounds: int = ROUNDS) -> DataFrame:
    """(stop, best): the earliest arrival at every stop reached by the deadline. Transfers are rows (src, dst, cost) or walks between places."""
    ev = cut(events.select("trip", "seq", "stop", "arr", "dep").where((F.col("dep") >= depart) & (F.col("arr") <= deadline)))
    if isinstance(transfers, FootWalks):
        walks = FootWalks(cut(transfers.places.select("stop", "lon", "lat")), transfers.radius)
        first = initial_labels(access, depart, limit, deadline)
        if ev.count() + walks.places.count() <= TASK_ROWS:
            return _in_one_task(ev, walks, first, deadline, rounds)
        return _in_rounds(ev, walks, relax_transfers(first, walks, deadline), deadline, rounds)
    walks = cut(transfers.select("src", "dst", "cost"))
    start = relax_transfers(initial_labels(access, depart, limit, deadline), walks, deadline)
    # a window of a checked size is searched in one task, as a small side is broadcast
    if ev.count() + walks.count() <= TASK_ROWS:
        return _in_one_task(ev, walks, start, deadline, rounds)
    return _in_rounds(ev, walks, start, deadline, rounds)


def _in_one_task(ev: DataFrame, walks: DataFrame | FootWalks, start: DataFrame, deadline: int, rounds: int) -> DataFrame:
    """The rounds over arrays in one task, for a window of TASK_ROWS rows at most. On foot between places, start is before the first walk."""
    none, nowhere = F.lit(None).cast("bigint"), (F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))
    foot, radius = isinstance(walks, FootWalks), walks.radius if isinstance(walks, FootWalks) else 0.0
    rows = ev.select(F.lit(0).alias("kind"), "trip", F.col("seq").cast("bigint"), "stop", "arr", "dep", *nowhere)
    if foot:
        rows = rows.unionAll(walks.places.where("lon is not null and lat is not null").select(F.lit(3), "stop", none, none, none, none, "lon", "lat"))
    else:
        rows = rows.unionAll(walks.select(F.lit(1), "src", "dst", F.col("cost").cast("bigint"), none, none, *nowhere))
    rows = rows.unionAll(start.select(F.lit(2), "stop", "best", none, none, none, *nowhere))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        t = pa.Table.from_batches(held)
        kind = t["kind"].to_numpy()
        of = lambda k, n: [c.filter(pa.array(kind == k)).to_numpy() for c in t.columns[1 : n + 1]]
        trip, seq, stop, arr, dep = of(0, 5)
        src, dst, cost = of(1, 3)
        first, since = of(2, 2)
        (place,), (lon, lat) = of(3, 1), (t[c].filter(pa.array(kind == 3)).to_numpy() for c in ("x", "y"))
        del held, t, kind
        order = np.lexsort((seq, trip))
        trip, stop, arr, dep = trip[order], stop[order], arr[order], dep[order]
        names, at = np.unique(np.concatenate([stop, src, dst, first, place]), return_inverse=True)
        stop, src, dst, first, place = np.split(at, np.cumsum([len(stop), len(src), len(dst), len(first)]))
        never = np.iinfo(np.int64).max // 2
        best = np.full(len(names), never)
        np.minimum.at(best, first, since)
        head = np.searchsorted(trip, trip)  # where each event's trip begins
        relaxer = Relaxer(place, lon, lat, radius) if foot else None
        moved = best < never  # labels whose walks were not taken yet
        if foot:
            before, best = best, relaxer.relax(best, moved, deadline)
            moved = best < before
        for _ in range(rounds):
            on = np.concatenate([[0], np.cumsum((best[stop] + CHANGE <= dep) & (dep <= deadline))])
            ride = (on[:-1] > on[head]) & (arr <= deadline)
            new = best.copy()
            np.minimum.at(new, stop[ride], arr[ride])
            if foot:
                ridden, new = new, relaxer.relax(new, moved | (new < best), deadline)
                moved = new < ridden
            walked = new[src] + cost
            near = walked <= deadline
            np.minimum.at(new, dst[near], walked[near])
            if (new == best).all():
                break
            best = new
        got = best < never
        yield pa.RecordBatch.from_arrays([pa.array(names[got]), pa.array(best[got])], names=["stop", "best"])

    return cut(rows.coalesce(1).mapInArrow(run, "stop bigint, best bigint"))


def _in_rounds(ev: DataFrame, walks: DataFrame | FootWalks, start: DataFrame, deadline: int, rounds: int) -> DataFrame:
    """The rounds as joins of what changed with the events by stop and by trip."""
    by_stop = ev.select("stop", "trip", "seq", "dep").repartition("stop").persist()
    by_trip = ev.select("trip", F.col("seq").alias("at"), F.col("stop").alias("to"), "arr").repartition("trip").persist()
    walks = walks if isinstance(walks, FootWalks) else walks.repartition("src").persist()
    start = start.withColumn("moved", F.lit(True))

    def step(labels: DataFrame) -> DataFrame:
        fresh = labels.where("moved").select("stop", "best")
        boarded = fresh.join(by_stop, "stop").where(boardable(F.col("best"), F.col("dep"), deadline)).groupBy("trip").agg(F.min("seq").alias("first"))
        rides = boarded.join(by_trip, "trip").where("at > first").groupBy(F.col("to").alias("stop")).agg(F.min("arr").alias("best"))
        open_ = fresh.unionByName(rides)
        walked = walked_from(open_, walks).select(F.col("dst").alias("stop"), (F.col("best") + F.col("cost")).alias("best")).where(F.col("best") <= deadline)
        found = labels.select("stop", "best", F.col("best").alias("old")).unionByName(rides.unionByName(walked).withColumn("old", F.lit(None).cast("bigint")))
        new = found.groupBy("stop").agg(F.min("best").alias("best"), F.min("old").alias("old"))
        return new.select("stop", "best", (F.col("old").isNull() | (F.col("best") < F.col("old"))).alias("moved"))

    try:
        return fixpoint(cut(start), step, rounds, keep_moved=True, strict=False)
    finally:
        for kept in (by_stop, by_trip, walks):
            if isinstance(kept, DataFrame):
                kept.unpersist()


def restrict(events: DataFrame, keep: DataFrame, drop_trips: DataFrame | None = None) -> DataFrame:
    """Events at kept stops, without dropped trips; a trip is split where a stop between is gone. Runs are numbered within (trip, run)."""
    e = events.join(keep.select("stop"), "stop", "left_semi")
    if drop_trips is not None:
        e = e.join(drop_trips.select("trip"), "trip", "left_anti")
    w = W.partitionBy("trip").orderBy("seq")
    e = e.withColumn("_island", F.col("seq") - F.row_number().over(w))
    return e.withColumn("run", F.dense_rank().over(W.partitionBy("trip").orderBy("_island"))).withColumn("pos", F.row_number().over(W.partitionBy("trip", "_island").orderBy("seq"))).drop("_island")


def arrivals_sql(depart: int, deadline: int, limit: float, rounds: int = ROUNDS, name: str = "arrivals") -> str:
    """The same search as unrolled CTEs, the last named name."""
    relax = lambda t: f"SELECT stop, min(best) AS best FROM (SELECT stop, best FROM {t} UNION ALL SELECT dst, best + cost FROM {t} JOIN transfers ON src = stop) WHERE best <= {deadline} GROUP BY stop"
    parts = [
        f"ev AS MATERIALIZED (SELECT * FROM events WHERE dep >= {depart} AND arr <= {deadline})",
        f"a0 AS (SELECT stop, CAST(trunc({depart} + sec) AS BIGINT) AS best FROM access WHERE sec <= {limit} AND trunc({depart} + sec) <= {deadline})",
        f"r0 AS MATERIALIZED ({relax('a0')})",
    ]
    for k in range(1, rounds + 1):
        parts.append(f"b{k} AS (SELECT e.stop, arr, max(CASE WHEN r.best + {CHANGE} <= dep AND dep <= {deadline} THEN seq END) OVER (PARTITION BY trip ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS boarded FROM ev AS e LEFT JOIN r{k - 1} AS r ON r.stop = e.stop)")
        parts.append(f"m{k} AS (SELECT stop, min(best) AS best FROM (SELECT stop, best FROM r{k - 1} UNION ALL SELECT stop, arr FROM b{k} WHERE boarded IS NOT NULL AND arr <= {deadline}) GROUP BY stop)")
        parts.append(f"r{k} AS MATERIALIZED ({relax(f'm{k}')})")
    return ", ".join(parts) + f", {name} AS (SELECT * FROM r{rounds})"
