"""Operators against brute force and known cases."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from railspan.functions import geo, names
from railspan.operators import folds, graph, sequences, similarity, spatial, walks
from railspan.plans import raptor


def test_radius_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    points = [(i, 139.7 + rng.random() * 0.05, 35.6 + rng.random() * 0.05) for i in range(150)] + [(900, float("nan"), 35.6)]
    got = {(r.a, r.b) for r in spatial.radius_pairs(spark.createDataFrame(points, "k long, lon double, lat double"), "k", 700.0).collect()}
    dist = lambda p, q: math.hypot((p[1] - q[1]) * geo.KX, (p[2] - q[2]) * geo.KY)
    assert got == {(p[0], q[0]) for p in points for q in points if p[0] < q[0] and dist(p, q) <= 700}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_radius_join_never_broadcasts_the_copies(spark):
    """Nine copies of a table that looks small in its file filled the driver."""
    rng = random.Random(5)
    points = [(i, 139.7 + rng.random() * 0.05, 35.6 + rng.random() * 0.05) for i in range(200)] + [(900, float("nan"), 35.6), (901, None, 35.6)]
    d = spark.createDataFrame(points, "k long, lon double, lat double")
    counted = spatial.neighbours(d, "k", 700.0)
    assert "Broadcast" not in plan_of(spatial.radius_pairs(d, "k", 700.0)) + plan_of(counted)
    dist = lambda p, q: math.hypot((p[1] - q[1]) * geo.KX, (p[2] - q[2]) * geo.KY)
    want = {p[0]: sum(p[0] != q[0] and dist(p, q) <= 700 for q in points[:200]) for p in points[:200]}
    assert {r.k: r.n for r in counted.collect()} == {k: n for k, n in want.items() if n}


def test_nearest_keeps_rows_without_partner(spark):
    left = spark.createDataFrame([(1, 139.7, 35.6), (2, 140.9, 35.6)], "k long, lon double, lat double")
    right = spark.createDataFrame([(7, 139.7001, 35.6), (6, 139.7001, 35.6)], "n long, rlon double, rlat double")
    assert {r.k: r.n for r in spatial.nearest(left, right, "k", "n", 300.0).collect()} == {1: 6, 2: None}


def test_closest_and_slack_sort_no_pairs_and_equal_brute_force(spark):
    """The least of a struct sorted every pair; ties go to the least key."""
    rng = random.Random(6)
    points = [(i, 139.7 + rng.randrange(40) / 2000, 35.6 + rng.randrange(40) / 2000) for i in range(150)]
    d = spark.createDataFrame(points, "k long, lon double, lat double")
    right = d.select(F.col("k").alias("n"), F.col("lon").alias("rlon"), F.col("lat").alias("rlat"), (F.col("k") % 3).alias("g"))
    dist = lambda p, q: math.sqrt(((p[1] - q[1]) * geo.KX) ** 2 + ((p[2] - q[2]) * geo.KY) ** 2)
    got = spatial.closest(d, right, "k", "n", 300.0, ("g",))
    assert "SortAggregate" not in plan_of(got)
    want = {(p[0], g): min((dist(p, q), q[0]) for q in points if q[0] % 3 == g and dist(p, q) <= 300)[1] for p in points for g in range(3) if any(q[0] % 3 == g and dist(p, q) <= 300 for q in points)}
    assert {(r.k, r.g): r.n for r in got.collect()} == want
    pairs = [(p[0], q[0], dist(p, q)) for p in points for q in points if p[0] < q[0] and dist(p, q) <= 700]
    least = {a: min(m for x, _, m in pairs if x == a) for a, _, _ in pairs}
    assert {(r.a, r.b) for r in spatial.pairs_within_slack(d, "k", 700.0, 15.0).collect()} == {(a, b) for a, b, m in pairs if m <= least[a] + 15}


def test_clusters_of_a_long_chain_equal_union_find(spark):
    """A street of 400 stops, 200 m apart: labels that walk along links needed more rounds than there are."""
    rng = random.Random(9)
    order = rng.sample(range(400), 400)
    points = [(k, 139.6, 35.0 + i * 200 / geo.KY, "x" if i % 3 else None) for i, k in enumerate(order)]
    points += [(1000 + i, 139.7 + rng.random() * 0.03, 35.6 + rng.random() * 0.03, rng.choice("xy")) for i in range(150)] + [(2000, float("nan"), 35.6, "x"), (order[7], 139.9, 35.6, "x"), (2001, 139.9, 35.6, "x")]
    d = spark.createDataFrame(points, "k long, lon double, lat double, g string")
    for on in ((), ("g",)):
        root = {p[0]: p[0] for p in points}

        def find(k, root=root):
            while root[k] != k:
                k = root[k]
            return k

        for p in points:
            for q in points:
                if math.hypot((p[1] - q[1]) * geo.KX, (p[2] - q[2]) * geo.KY) <= 250 and (not on or p[3] == q[3] and p[3]):
                    a, b = find(p[0]), find(q[0])
                    root[max(a, b)] = min(a, b)
        assert {r.node: r.comp for r in spatial.clusters(d, "k", 250.0, on).collect()} == {k: find(k) for k in root}


def test_point_in_polygon_with_hole(spark):
    ring = lambda p, c: [(p, *a, *b) for a, b in zip(c, [*c[1:], c[0]], strict=True)]
    edges = ring(1, [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]) + ring(1, [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0)])
    e = spark.createDataFrame(edges, "poly int, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 11.0, 5.0), (4, 5.0, 9.5)], "point int, x double, y double")
    assert {r.point for r in spatial.points_in_polygons(p, e).collect()} == {1, 4}


def test_components_and_chains(spark):
    nodes = spark.createDataFrame([(i,) for i in range(9)], "node long")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (5, 4), (4, 6), (8, 8)], "a long, b long")
    assert {r.node: r.comp for r in graph.components(nodes, edges).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 4, 6: 4, 7: 7, 8: 8}
    pointers = [(i, i + 1 if i < 40 else None) for i in range(41)] + [(50, 51), (51, 50), (60, 5), (61, 999)]
    got = {r.node: (r.head, r.pos) for r in graph.chains(spark.createDataFrame(pointers, "node long, next long")).collect()}
    assert got[40] == (0, 40) and got[0] == (0, 0) and got[50] == (50, 0) and got[51] == (51, 0) and got[60] == (60, 0) and got[61] == (61, 0)


def test_jaccard_prefix_filter_equals_brute_force(spark):
    rng = random.Random(5)
    sets = {g: set(rng.sample(range(25), rng.randint(3, 12))) for g in range(60)}
    sets[60] = set(sets[3])
    rows = spark.createDataFrame([(g, i) for g, s in sets.items() for i in s], "g long, i long")
    got = {(r.a, r.b) for r in similarity.jaccard_pairs(rows, "g", "i", 0.6, 2).collect()}
    assert got == {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= max(2, 0.6 * len(sets[a] | sets[b]))}


def test_asof_next(spark):
    left = spark.createDataFrame([("a", 5), ("a", 11), ("b", 1)], "k string, at long")
    right = spark.createDataFrame([("a", 5), ("a", 9), ("c", 2)], "k string, dep long")
    assert {(r.k, r["at"]): r.dep for r in similarity.asof_next(left, "at", right, "dep", "k").collect()} == {("a", 5): 5, ("a", 11): None, ("b", 1): None}


def test_restrict_with_all_stops_is_identity(spark):
    e = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (2, 1, 12)], "trip long, seq int, stop long")
    got = raptor.restrict(e, e.select("stop").distinct()).collect()
    assert {(r.trip, r.run, r.pos, r.seq) for r in got} == {(1, 1, 1, 1), (1, 1, 2, 2), (2, 1, 1, 1)}
    cut = raptor.restrict(e, spark.createDataFrame([(10,), (12,)], "stop long"))
    assert cut.count() == 2


def _timetable(spark):
    events = spark.createDataFrame(
        [(1, 1, 1, 100, 100), (1, 2, 2, 200, 210), (1, 3, 3, 300, 300), (2, 1, 2, 260, 260), (2, 2, 4, 400, 400), (3, 1, 3, 340, 340), (3, 2, 5, 420, 420)], "trip long, seq int, stop long, arr long, dep long"
    )
    transfers = spark.createDataFrame([(4, 6, 50)], "src long, dst long, cost long")
    access = spark.createDataFrame([(1, 20.9), (5, 9999.0)], "stop long, sec double")
    return events, transfers, access


def test_arrivals_trace_and_journey(spark):
    events, transfers, access = _timetable(spark)
    best = raptor.earliest_arrivals(events, transfers, access, 0, 1000, 600)
    # the change at 2 takes 60 s: 200 + 60 <= 260 holds; at 3, 300 + 60 > 340 fails
    assert {r.stop: r.best for r in best.collect()} == {1: 20, 2: 200, 3: 300, 4: 400, 6: 450}
    traced = graph.trace(best, events, transfers, access, 0, 1000, 600)
    legs = sorted(graph.reconstruct(traced, 6).collect(), key=lambda r: r.leg)
    assert [(r.stop, r.kind, r.prev) for r in legs] == [(6, 2, 4), (4, 3, 2), (2, 3, 1), (1, 1, None)]
    assert graph.reconstruct(traced, 77).count() == 0


def test_arrivals_grow_with_the_budget(spark):
    events, transfers, access = _timetable(spark)
    near = {r.stop for r in raptor.earliest_arrivals(events, transfers, access, 0, 250, 600).collect()}
    far = {r.stop for r in raptor.earliest_arrivals(events, transfers, access, 0, 420, 600).collect()}
    assert near <= far and near == {1, 2}
    assert raptor.earliest_arrivals(events, transfers, access.where("sec < 0"), 0, 1000, 600).count() == 0


def test_contour_area_and_holes(spark):
    ring = [(x, y) for x in range(3) for y in range(3) if (x, y) != (1, 1)] + [(9, 9), (10, 10)]
    got = graph.contour(spark.createDataFrame([(x, y, 1) for x, y in ring], "x long, y long, g int"), "g").collect()
    assert sum(r.area for r in got) == len(ring)
    assert sorted(r.area for r in got) == [-1.0, 1.0, 1.0, 9.0]


def test_runs_and_consecutive_distinct(spark):
    d = spark.createDataFrame([(1, i, v) for i, v in enumerate([None, None, 2, 2, 3, 2])], "g int, o int, v int")
    assert sorted((r.run, r.v, r.n) for r in sequences.runs(d, "g", "o", "v").collect() if r.v is not None) == [(2, 2, 2), (3, 3, 1), (4, 2, 1)]
    assert [r.v for r in sequences.consecutive_distinct(d, "g", "o", "v").orderBy("o").collect()] == [None, 2, 3, 2]


def test_limiter_ignores_refused_calls(spark):
    log = spark.sql("SELECT id AS event_id, 1L AS user_id, timestamp_seconds(id * 10) AS ts FROM range(6)")
    got = {r.event_id: r.accepted for r in graph.limited(log, 2, 25).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True, 5: False}


def test_limiter_stream_equals_batch(spark, tmp_path):
    from railspan.streaming.limiter import calls_per_window, limited_stream

    log = spark.sql("SELECT id AS event_id, id % 3 AS user_id, timestamp_seconds(1700000000 + id * 7) AS ts FROM range(60)")
    log.write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    for name, frame, mode in (("limited", limited_stream(stream, 2, 60), "append"), ("windows", calls_per_window(stream), "complete")):
        q = frame.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert {tuple(r) for r in spark.table("limited").collect()} == {tuple(r) for r in graph.limited(log, 2, 60).collect()}
    assert spark.table("windows").agg(F.sum("n")).first()[0] == 60


@given(st.lists(st.tuples(st.integers(0, 86399), st.integers(0, 600)), max_size=30))
@settings(max_examples=60, deadline=None)
def test_unwrapped_times_never_go_back_within_a_run(rows):
    got = folds.unwrap_times([(a, a + w) for a, w in rows])
    assert len(got) == len(rows)
    for (r1, _, d1), (r2, a2, d2) in zip(got, got[1:], strict=False):
        assert d2 >= a2 and (r2 > r1 or a2 >= d1)


def test_unwrap_midnight_and_split():
    assert folds.unwrap_times([(86000, 86100), (500, 600), (300, 400)]) == [(0, 86000, 86100), (0, 86900, 87000), (1, 86700, 86800)]


def test_simplify_insert_stitch_fold():
    assert folds.simplified([(0, 0), (1, 0.1), (2, 0), (3, 5), (4, 0)], 0.5) == [True, False, True, True, True]
    assert folds.simplified([], 1) == []
    assert folds.insertion_order([(0, 0), (10, 0), (5, 0), (20, 0)]) == [3, 1, 2, 0]  # a tie goes to the first place
    assert folds.stitched([[1, 2], [3, 2], [3, 4], [9, 8]]) == [[1, 2, 3, 4], [9, 8]]
    assert folds.folded_lines([("a", {1, 2, 3, 4}), ("b", {1, 2, 3}), ("c", {8, 9})]) == [("a", "a"), ("b", "a"), ("c", "c")]


def test_fewest_changes():
    lines = {"x": [1, 2, 3], "y": [3, 4, 5], "z": [2, 3]}
    assert folds.fewest_changes([1, 2, 3, 4, 5], lines) == ["x", "x", "x", "y", "y"]
    assert folds.fewest_changes([1, 2, 3, 4, 5], lines, "y") == ["x", "x", "y", "y", "y"]
    assert folds.fewest_changes([], lines) is None
    assert folds.fewest_changes([1, 4], {"x": [1, 2], "y": [3, 4], "z": [2, 4]}) == ["x", "y"]
    assert folds.fewest_changes([1, 99], lines) is None
    assert folds.fewest_changes([1, 3, 2], {"x": [1, 2, 3]}) is None


def test_cleaning_is_idempotent(spark):
    d = spark.createDataFrame([("上野のりばのりば",), ("柘植駅1番のりば",), (None,), ("",), ("北千住01",)], "n string")
    once = names.clean_station_name(F.col("n"))
    assert d.where(names.clean_station_name(once) != once).count() == 0
    assert {r[0] for r in d.select(once).collect()} == {"上野", "柘植", "", "北千住"}


@pytest.mark.parametrize(("text", "sec"), [("25:13", 90780), ("9:05", 32700), ("30:00", None), ("9:5", None), ("", None), (None, None), ("12:60", None)])
def test_parse_hhmm(spark, text, sec):
    assert spark.createDataFrame([(text,)], "t string").select(geo.parse_hhmm(F.col("t"))).first()[0] == sec


def test_engine_does_not_need_the_corpus_operators():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['railspan.llm'] = None; import railspan.registry; assert not [m for m in sys.modules if m.startswith('railspan.llm.')]"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True, timeout=120)


def test_search_in_one_task_equals_rounds(spark, monkeypatch):
    from helpers import DATA

    from railspan.sources.bindings import DEPART, Tables

    t = Tables(spark, f"{DATA}/sf0.001")
    found = lambda: sorted(map(tuple, raptor.earliest_arrivals(t.events, t.transfers, t.access, DEPART, DEPART + 7200, 3600).collect()))
    one = found()
    monkeypatch.setattr(raptor, "TASK_ROWS", 0)
    assert one and found() == one


@pytest.mark.parametrize("rows", [0, 4_000_000])
def test_search_on_foot_equals_search_over_transfers(spark, monkeypatch, rows):
    """Walks made from positions, in one task and in rounds, against the table of all walks, which did not fit."""
    from helpers import DATA

    from railspan.sources.bindings import DEPART, Tables

    t = Tables(spark, f"{DATA}/sf0.01")
    found = lambda by, rounds: sorted(map(tuple, raptor.earliest_arrivals(t.events, by, t.access, DEPART, DEPART + 3600, 3600, rounds).collect()))
    want = {rounds: found(t.transfers, rounds) for rounds in (1, 12)}
    monkeypatch.setattr(raptor, "TASK_ROWS", rows)
    monkeypatch.setattr(walks, "AT_ONCE", 1000)
    assert want[12] and {rounds: found(t.walks, rounds) for rounds in (1, 12)} == want


def test_trace_on_foot_equals_trace_over_transfers(spark):
    from helpers import DATA

    from railspan.sources.bindings import DEPART, Tables

    t = Tables(spark, f"{DATA}/sf0.01")
    best = raptor.earliest_arrivals(t.events, t.walks, t.access, DEPART, DEPART + 3600, 3600)
    traced = lambda by: sorted(graph.trace(best, t.events, by, t.access, DEPART, DEPART + 3600, 3600).collect(), key=str)
    assert any(r.kind == 2 for r in traced(t.walks)) and traced(t.walks) == traced(t.transfers)


def test_relaxer_equals_all_pairs():
    rng = np.random.default_rng(4)
    for n, wide in ((400, 0.03), (400, 0.003), (3, 0.5)):
        lon, lat = 139.7 + rng.random(n) * wide, 35.6 + rng.random(n) * wide
        stop = rng.permutation(n)
        stop[0], lon[1] = stop[n - 1], np.nan  # a stop at two places, and one without a place
        best = rng.integers(0, 3000, n)
        best[rng.random(n) < 0.5] = np.iinfo(np.int64).max // 2
        changed, want = rng.random(n) < 0.8, best.copy()
        for i in range(n):
            for j in range(n):
                m = math.sqrt(((lon[i] - lon[j]) * geo.KX) ** 2 + ((lat[i] - lat[j]) * geo.KY) ** 2)
                got = best[stop[i]] + round(max(300, 90 + 1.25 * m / geo.WALK_MPS)) if m <= 1000 else 10**9
                if changed[stop[i]] and got <= 2500:
                    want[stop[j]] = min(want[stop[j]], got)
        assert (walks.Relaxer(stop, lon, lat, 1000.0).relax(best, changed, 2500) == want).all()
