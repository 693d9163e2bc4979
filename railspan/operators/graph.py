"""Graph operators: components, chains, bounded shortest paths, journeys."""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import cut, discard


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """nodes (node), edges (a, b) -> (node, comp), comp the least node of the component.

    Each round every node of the edge table points to its least neighbour below it, pointers are followed to their ends by doubling, and
    the table shrinks to the edges between the ends. Rounds do not grow with the length of a path, as they do when labels walk along edges.
    """
    of, node = cut(nodes.select("node", F.col("node").alias("comp")).distinct()), nodes.select("node")
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    e = cut(e.join(node.withColumnRenamed("node", "a"), "a", "left_semi").join(node.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b").distinct())
    for _ in range(most_rounds):
        if e.isEmpty():
            discard(e)
            return of
        ends = _ends(e.groupBy("a").agg(F.min("b").alias("to")), most_rounds)
        to = lambda d, c: d.join(ends.withColumnRenamed("a", c), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")  # noqa: B023, E731
        moved = to(to(e, "a"), "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        old, e, of = (e, of), cut(moved), cut(to(of, "comp").select("node", "comp"))
        for table in (*old, ends):
            discard(table)
    raise RuntimeError(f"edges between components remain after {most_rounds} rounds")


def _ends(pointers: DataFrame, most_rounds: int) -> DataFrame:
    """pointers (a, to), to < a -> (a, to) with to where following them ends. A round follows twice as many steps as the one before."""
    p = cut(pointers)
    for _ in range(most_rounds):
        on = p.select(F.col("a").alias("to"), F.col("to").alias("next"))
        new = cut(p.join(on, "to", "left").select("a", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        discard(p)
        p = new
        if p.where("moved").isEmpty():
            break
        p = p.drop("moved")
        p._scratch = new._scratch
    else:
        raise RuntimeError(f"pointers run on after {most_rounds} doublings")
    done = p.drop("moved")
    done._scratch = p._scratch
    return done


def chains(pointers: DataFrame, most_rounds: int = 24) -> DataFrame:
    """pointers (node, next or null) -> (node, head, pos): runs that follow next. Of several that point to a node the least keeps it; cycles become single nodes.

    Pointer doubling: rounds grow as the logarithm of the longest run.
    """
    nodes = cut(pointers.select("node", "next"))
    kept = nodes.join(nodes.select(F.col("node").alias("t")), F.col("next") == F.col("t")).groupBy("next").agg(F.min("node").alias("before"))
    start = nodes.join(kept.withColumnRenamed("next", "n"), F.col("node") == F.col("n"), "left").select("node", F.coalesce("before", "node").alias("head"), F.when(F.col("before").isNull(), 0).otherwise(1).cast("bigint").alias("pos"), F.col("before").isNull().alias("done"))

    def step(s: DataFrame) -> DataFrame:
        up = s.select(F.col("node").alias("u"), F.col("head").alias("uh"), F.col("pos").alias("up"), F.col("done").alias("ud"))
        j = s.join(up, F.col("head") == F.col("u"))
        return j.select("node", F.col("uh").alias("head"), (F.col("pos") + F.when(F.col("head") == F.col("node"), 0).otherwise(F.col("up"))).alias("pos"), (F.col("done") | F.col("ud")).alias("done"), (~F.col("done") & F.col("ud")).alias("moved"))

    state, idle = cut(start), 0
    for _ in range(most_rounds):  # a round may finish no run and still shorten the way of the longer ones; a cycle never ends
        new = cut(step(state))
        if new.where("not done").isEmpty():
            state = new.drop("moved")
            break
        idle = idle + 1 if new.where("moved").isEmpty() else 0
        state = new.drop("moved")
        if idle > 8:
            break
    else:
        raise RuntimeError(f"runs are longer than {most_rounds} doublings")
    return state.select("node", F.when(F.col("done"), F.col("head")).otherwise(F.col("node")).alias("head"), F.when(F.col("done"), F.col("pos")).otherwise(0).alias("pos"))


def walksheds(stations: DataFrame, edges: DataFrame, nodes: DataFrame, limit: int, reach: int) -> DataFrame:
    """(stop, cell, sec) of every cell within limit seconds on foot of each station.

    stations (stop, cell, x, y), nodes (cell, x, y), edges (src, dst, sec). reach bounds how many cells a walk of the limit can
    cross. Stations of one cell share a search. Cells are grouped by tiles of that width, and an edge is copied to the tiles around it, so a task runs the
    searches of one tile over a bounded piece of the network. No task or broadcast holds the whole network.
    """
    tile = lambda c: F.floor(F.col(c) / reach)
    s = stations.select("cell", tile("x").alias("tx"), tile("y").alias("ty")).distinct()
    near = F.explode(F.expr("flatten(transform(array(-1, 0, 1), i -> transform(array(-1, 0, 1), j -> named_struct('i', i, 'j', j))))"))
    e = edges.join(nodes.select(F.col("cell").alias("src"), tile("x").alias("tx"), tile("y").alias("ty")), "src")
    e = e.withColumn("o", near).select((F.col("tx") + F.col("o.i")).alias("tx"), (F.col("ty") + F.col("o.j")).alias("ty"), "src", "dst", "sec")

    def search(starts: pd.DataFrame, net: pd.DataFrame) -> pd.DataFrame:
        out: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for a, b, c in zip(net["src"].tolist(), net["dst"].tolist(), net["sec"].tolist(), strict=True):
            out[a].append((b, c))
        rows = []
        for cell in starts["cell"].tolist():
            best, heap = {cell: 0}, [(0, cell)]
            while heap:
                d, at = heapq.heappop(heap)
                if d > best[at]:
                    continue
                for b, c in out.get(at, ()):
                    if d + c <= limit and d + c < best.get(b, limit + 1):
                        best[b] = d + c
                        heapq.heappush(heap, (d + c, b))
            rows += [(cell, c, d) for c, d in best.items()]
        return pd.DataFrame(rows, columns=["door", "cell", "sec"]).astype("int64")

    walked = s.groupBy("tx", "ty").cogroup(e.groupBy("tx", "ty")).applyInPandas(search, "door bigint, cell bigint, sec bigint")
    return walked.join(stations.select("stop", F.col("cell").alias("door")), "door").select("stop", "cell", "sec")


def trace(best: DataFrame, events: DataFrame, transfers: DataFrame, access: DataFrame, depart: int, deadline: int, limit: float) -> DataFrame:
    """(stop, best, kind, prev, trip, board, alight): how each label came about: 1 access, 2 transfer, 3 ride, the least of (kind, prev, trip, alight).

    Every step back is strictly earlier, so following prev always ends at an access label.
    """
    from ..plans.raptor import board, initial_labels, walked_from
    from .walks import FootWalks

    null = F.lit(None).cast("bigint")
    a = initial_labels(access, depart, limit, deadline).select("stop", F.col("best").alias("t"), F.lit(1).alias("kind"), null.alias("prev"), null.alias("trip"), null.alias("board"), null.alias("alight"))
    # walks from places are tested against the label they must meet inside their join: the rest are never rows of a shuffle
    w = (transfers.joined(best, best) if isinstance(transfers, FootWalks) else walked_from(best, transfers)).select(F.col("dst").alias("stop"), (F.col("best") + F.col("cost")).alias("t"), F.lit(2), F.col("src"), null, null, null)
    ev = events.select("trip", "seq", "stop", "arr", "dep").where((F.col("dep") >= depart) & (F.col("arr") <= deadline))
    on = board(ev, best, deadline).where(F.col("boarded").isNotNull())
    at = ev.select(F.col("trip").alias("bt"), F.col("seq").alias("bs"), F.col("stop").alias("prev"))
    r = on.join(at, (F.col("trip") == F.col("bt")) & (F.col("boarded") == F.col("bs"))).select("stop", F.col("arr").alias("t"), F.lit(3), "prev", "trip", F.col("boarded").cast("bigint"), F.col("seq").cast("bigint"))
    found = a.union(w).union(r).join(best.select(F.col("stop").alias("s"), "best"), (F.col("stop") == F.col("s")) & (F.col("t") == F.col("best")))
    x = found.groupBy("stop", "best").agg(F.min(F.struct("kind", F.coalesce("prev", F.lit(-1)).alias("prev"), F.coalesce("trip", F.lit(-1)).alias("trip"), F.coalesce("alight", F.lit(-1)).alias("alight"), F.coalesce("board", F.lit(-1)).alias("board"))).alias("x"))
    return x.select("stop", "best", "x.kind", *[F.when(F.col(f"x.{c}") >= 0, F.col(f"x.{c}")).alias(c) for c in ("prev", "trip", "board", "alight")])


def reconstruct(traced: DataFrame, stop: int, most_legs: int = 40) -> DataFrame:
    """The legs of the journey to stop, from its end back to the access leg: (leg, stop, best, kind, prev, trip, board, alight)."""
    return traced.sparkSession.sql(
        f"""WITH RECURSIVE j AS (
              SELECT 0 AS leg, stop, best, kind, prev, trip, board, alight FROM {{t}} WHERE stop = {int(stop)}
              UNION ALL SELECT j.leg + 1, t.stop, t.best, t.kind, t.prev, t.trip, t.board, t.alight FROM j JOIN {{t}} AS t ON t.stop = j.prev WHERE j.leg < {int(most_legs)} - 1)
            SELECT * FROM j""",
        t=traced,
    )


def limited(log: DataFrame, per_window: int, seconds: int) -> DataFrame:
    """log (user_id, ts, event_id) with accepted: at most per_window accepted calls of a user in any window; refused calls don't count. A user's log is folded in time order."""

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        p, held, ok = p.sort_values(["at", "event_id"]), [], []
        for at in p["at"].tolist():
            held = [h for h in held if h > at - seconds * 1_000_000]
            ok.append(len(held) < per_window)
            if ok[-1]:
                held.append(at)
        return p.assign(accepted=ok)[["event_id", "user_id", "accepted"]]

    return log.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at")).groupBy("user_id").applyInPandas(fold, "event_id bigint, user_id bigint, accepted boolean")


def contour(cells: DataFrame, by: str) -> DataFrame:
    """Closed rings around the cells (x, y) of each group: (by, ring, points, area). Outer rings have positive area, holes negative.

    Each side of a cell that no neighbour shares is a directed edge; edges chain to rings.
    """

    def rings(p: pd.DataFrame) -> pd.DataFrame:
        have = set(zip(p["x"].tolist(), p["y"].tolist(), strict=True))
        out: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for x, y in sorted(have):
            for gone, a, b in (((x, y - 1), (x, y), (x + 1, y)), ((x + 1, y), (x + 1, y), (x + 1, y + 1)), ((x, y + 1), (x + 1, y + 1), (x, y + 1)), ((x - 1, y), (x, y + 1), (x, y))):
                if gone not in have:
                    out[a].append(b)
        rows = []
        for ring in _closed(out):
            twice = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], ring[0]], strict=True))
            rows.append((p[by].iloc[0], len(rows), len(ring), twice / 2))
        return pd.DataFrame(rows, columns=[by, "ring", "points", "area"])

    kind = dict(cells.dtypes)[by]
    return cells.groupBy(by).applyInPandas(rings, f"{by} {kind}, ring bigint, points bigint, area double")


def _closed(out: dict[tuple[int, int], list[tuple[int, int]]]) -> Iterator[list[tuple[int, int]]]:
    """Rings of directed unit edges; at a corner with two ways on, the sharpest left turn keeps touching rings apart."""
    while out:
        start = at = min(out)
        ring, before = [], None
        while True:
            ways = out[at]
            if before is not None and len(ways) > 1:
                dx, dy = at[0] - before[0], at[1] - before[1]
                ways.sort(key=lambda b: -(dx * (b[1] - at[1]) - dy * (b[0] - at[0])))
            nxt = ways.pop(0)
            if not ways:
                del out[at]
            ring.append(at)
            before, at = at, nxt
            if at == start:
                break
        yield ring


def corridor_paths(paths: DataFrame, corridor: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, pos, cell): the least-cost way of each path (path, src, dst) over edges whose ends lie in its corridor (path, cell).

    Of equal ways the one whose cells, read back from the end, are least. A path without a way is left out. What a search holds is
    one corridor; the edges reach it by two equi-joins, and searches run a batch at a time.
    """
    inside = corridor.select("path", "cell").distinct()
    e = inside.join(edges, F.col("cell") == F.col("src")).select("path", "src", "dst", "sec")
    e = e.join(inside.withColumnRenamed("cell", "dst"), ["path", "dst"])
    nets = e.groupBy("path").agg(F.collect_list("src").alias("a"), F.collect_list("dst").alias("b"), F.collect_list("sec").alias("sec"))
    work = nets.join(paths.select("path", F.col("src").alias("first"), F.col("dst").alias("last")), "path")

    def walk(first: int, last: int, a: list[int], b: list[int], sec: list[int]) -> list[int]:
        out: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for u, v, c in zip(a, b, sec, strict=True):
            out[u].append((v, c))
        best, back, heap = {first: 0}, {}, [(0, first)]
        while heap:
            d, at = heapq.heappop(heap)
            if d > best[at]:
                continue
            for v, c in out.get(at, ()):
                if (d + c, at) < (best.get(v, math.inf), back.get(v, -1)):
                    if d + c < best.get(v, math.inf):
                        heapq.heappush(heap, (d + c, v))
                    best[v], back[v] = d + c, at
        if last not in best:
            return []
        way = [last]
        while way[-1] != first:
            way.append(back[way[-1]])
        return way[::-1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = [(path, i, cell) for path, first, last, a, b, s in zip(p["path"], p["first"], p["last"], p["a"], p["b"], p["sec"], strict=True) for i, cell in enumerate(walk(first, last, a.tolist(), b.tolist(), s.tolist()))]
            yield pd.DataFrame(rows, columns=["path", "pos", "cell"])

    return work.select("path", "first", "last", "a", "b", "sec").mapInPandas(run, "path bigint, pos bigint, cell bigint")
