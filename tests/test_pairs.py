"""Pairs of near places and of groups: whole results, and no pairs in a shuffle."""

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from railspan import registry
from railspan.functions import geo
from railspan.operators import meets, similarity, spatial, tiles
from railspan.plans import queries_graph
from railspan.sources.bindings import DEPART, Tables

SMALL = "/root/testdata/sf0.001"


def plan_of(d):
    return d._jdf.queryExecution().executedPlan().toString()


def first_join(d):
    """The uppermost join of the plan that makes d."""
    return re.search(r"\w+Join.*", plan_of(d)).group()


def places(n, seed, keys=10**6):
    r = random.Random(seed)
    rows = [(k, 139.7 + r.random() * 0.05, 35.6 + r.random() * 0.05) for k in r.sample(range(keys), n)]
    return [*rows, (keys + 1, float("nan"), 35.6), (keys + 2, None, 35.6), (keys + 3, *rows[0][1:]), rows[1]]


def metres(p, q):
    return math.sqrt(((p[1] - q[1]) * geo.KX) ** 2 + ((p[2] - q[2]) * geo.KY) ** 2)


def near(rows, radius):
    """Ordered pairs of rows of different keys, by brute force."""
    ok = [p for p in rows if p[1] is not None and p[1] == p[1]]
    return [(p, q, m) for p in ok for q in ok if p[0] != q[0] and (m := metres(p, q)) <= radius]


def test_round3_equals_round(spark):
    r = random.Random(5)
    xs = [0.0, -0.0, 0.0005, 0.0015, 2.0005, 1.0005, 999.9995, 0.125, 1e15 + 0.3, 123456.7895, 1e-12, -1.2345, float("nan"), float("inf"), None]
    xs += [k / 10000 for k in range(0, 40005, 5)] + [r.random() * 10 ** r.randrange(-3, 9) for _ in range(3000)]
    d = spark.createDataFrame([(x,) for x in xs], "x double").select("x", geo.round3(F.col("x")).alias("got"), F.round("x", 3).alias("want"))
    assert d.where("not got <=> want").collect() == []


def test_ordered_pairs_equal_brute_force(spark):
    rows = places(150, 1)
    d = spatial.ordered_pairs(spark.createDataFrame(rows, "k long, lon double, lat double"), "k", 900.0)
    assert sorted((r.k, r.rk, round(r.m, 6)) for r in d.collect()) == sorted((p[0], q[0], round(m, 6)) for p, q, m in near(rows, 900.0))


def test_met_pairs_equal_brute_force_without_joining_pairs(spark):
    rows = places(220, 2)
    d = tiles.met_pairs(spark.createDataFrame(rows, "stop long, lon double, lat double"), 700.0, 700.0)
    assert "Join" not in plan_of(d) and "Join" not in plan_of(registry.QUERIES["j12_section_match"](spark, SMALL))
    least = {}
    pairs = [(p[0], q[0], m) for p, q, m in near(rows, 700.0) if p[0] < q[0]]
    by = {}
    for a, b, m in pairs:
        by.setdefault(b, []).append((a, m))
    for ends in by.values():
        for a, m in ends:
            for b, n in ends:
                if a < b:
                    least[a, b] = min(m + n, least.get((a, b), 1e9))
    want = sorted((a, b, m < 700.0) for (a, b), m in least.items())
    assert len({c for _, _, c in want}) == 2 and sorted(map(tuple, d.collect())) == want


def test_meets_equal_brute_force_in_parts_and_dense_places(monkeypatch):
    r = np.random.default_rng(4)

    def compare(lon, lat, own, radius, close):
        m = np.sqrt((np.subtract.outer(lon, lon) * geo.KX) ** 2 + (np.subtract.outer(lat, lat) * geo.KY) ** 2)
        m[m > radius] = np.inf
        least = {(s, d): (m[s, d + 1 :] + m[d, d + 1 :]).min() for s in np.flatnonzero(own).tolist() for d in range(s + 1, len(lon) - 1)}
        got = [(s, d, c) for s, *ends in meets.Meets(lon, lat, own, radius, close).pairs() for c, ds in zip((True, False), ends, strict=True) for d in ds.tolist()]
        assert sorted(got) == [(s, d, bool(v < close)) for (s, d), v in sorted(least.items()) if v < np.inf]

    for size, tests in ((64_000_000, 1_000_000), (900, 2_000)):  # in one part, and in many
        monkeypatch.setattr(meets, "BYTES", size)
        monkeypatch.setattr(meets, "TESTS", tests)
        for span, step in ((0.05, 0), (0.02, 1e-4), (0.01, 1e-3), (0.0, 0)):
            lon, lat = (v + (np.rint(x / step) * step if step else x) for v, x in zip((139.6, 35.5), r.random((2, 350)) * span, strict=True))
            compare(lon, lat, (lon >= 139.6 + span * 0.3) & (lat < 35.5 + span * 0.7) | (span == 0), 1000.0, 1000.0)
        lon, lat = (v + r.normal(size=350) ** 3 * 0.004 for v in (139.6, 35.5))
        compare(lon, lat, np.abs(lon - 139.6) < 0.004, 1000.0, 400.0)


def test_section_match_does_not_take_a_step_for_each_way(monkeypatch):
    r, taken = np.random.default_rng(6), []
    squares = meets.Meets._squares
    monkeypatch.setattr(meets.Meets, "_squares", staticmethod(lambda *a: taken.append(len(a[0]) * len(a[2])) or squares(*a)))
    lon, lat = 139.6 + r.random(3000) * 0.01, 35.5 + r.random(3000) * 0.01
    pairs = sum(len(c) + len(d) for _, c, d in meets.Meets(lon, lat, np.ones(3000, bool), 1000.0, 1000.0).pairs())
    assert pairs > 4_000_000 and sum(taken) < 10 * pairs  # there are over 3,000,000,000 ways


def test_section_match_takes_a_row_for_each_place_from_python(spark):
    assert "Generate explode(dst" in plan_of(registry.QUERIES["j12_section_match"](spark, SMALL))


def test_tiles_take_empty_tables_and_one_place(spark):
    for rows in ([], [(1, 139.7, 35.6)], [(1, None, 35.6)]):
        d = spark.createDataFrame(rows, "stop long, lon double, lat double")
        assert tiles.met_pairs(d, 700.0, 700.0).collect() == []


def test_ranked_walks_equal_brute_force_without_a_window(spark):
    rows = places(150, 3)
    d = tiles.ranked_walks(spark.createDataFrame(rows, "stop long, lon double, lat double"), 900.0)
    assert "Window" not in plan_of(d) and "Window" not in plan_of(registry.QUERIES["t04_sorted_edges"](spark, SMALL))
    walks, want = {}, []
    for p, q, m in near(rows, 900.0):
        walks.setdefault(p[0], []).append((q[0], round(max(300.0, 90 + 1.25 * m / geo.WALK_MPS))))
    for src, ends in walks.items():
        want += [(src, dst, cost, k + 1) for k, (dst, cost) in enumerate(sorted(ends))]
    assert sorted(map(tuple, d.collect())) == sorted(want)
    assert tiles.ranked_walks(spark.createDataFrame([], "stop long, lon double, lat double"), 900.0).collect() == []


def test_point_segment_takes_positions_along_and_does_not_join_pairs(spark):
    assert "_gx" in first_join(registry.QUERIES["m13_point_segment"](spark, SMALL))


def test_walk_transfers_take_lines_along_and_do_not_join_pairs(spark):
    assert "_gx" in first_join(registry.QUERIES["j06_walk_transfers"](spark, SMALL))


def test_pairs_of_key_equal_brute_force_and_deal_a_single_key(spark):
    rows = [(k, 7 if k < 120 else k % 3, k % 4) for k in range(150)] + [(500, None, 1), (3, 7, 9)]
    d = similarity.pairs_of_key(spark.createDataFrame(rows, "k long, g long, v long"), "k", "g")
    assert "_part" in first_join(d) and "Broadcast" not in plan_of(d)
    want = sorted((p[0], p[1], p[2], q[0], q[2]) for p in rows for q in rows if p[1] is not None and p[1] == q[1] and p[0] != q[0])
    assert sorted((r.k, r.g, r.v, r.rk, r.rv) for r in d.collect()) == want
    assert "_part" in first_join(registry.QUERIES["j07_group_transfers"](spark, SMALL))


def test_platform_transfers_deal_large_groups(spark):
    assert "_part" in first_join(registry.QUERIES["j08_platform_transfers"](spark, SMALL))


def test_track_lengths_are_rounded_without_text(spark):
    assert "/ 1000.0)" in plan_of(registry.QUERIES["z06_track_lengths"](spark, SMALL))


def test_walk_times_are_rounded_without_text(spark):
    assert "/ 1000.0)" in plan_of(registry.QUERIES["m03_walk_cost"](spark, SMALL))


def test_arrivals_are_not_broadcast_to_the_cells_they_enter(spark):
    d = queries_graph.entered(Tables(spark, SMALL))
    got = d.collect()
    assert got and first_join(d).startswith("SortMergeJoin")  # as it ran, with a table far under the broadcast threshold
    best = {r.stop: r.best - DEPART for r in registry.QUERIES["g01_earliest_arrivals"](spark, SMALL).collect()}
    want = {}
    for r in queries_graph._stations(Tables(spark, SMALL)).collect():
        if r.stop in best:
            want[r.cell] = min(best[r.stop], want.get(r.cell, best[r.stop]))
    assert {r.stop: r.elapsed for r in got} == want and len(got) == len(want)


def test_arrivals_are_not_broadcast_to_their_places(spark):
    d = registry.QUERIES["t03_best_destination"](spark, SMALL)
    assert len(d.collect()) == 1 and first_join(d).startswith("SortMergeJoin")


def test_isochrone_cells_broadcast_no_arrivals(spark):
    store = spark._jsparkSession.sharedState().statusStore()

    def plans():
        """What Spark has run so far, by number."""
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        ran = store.executionsList()
        return {x.executionId(): x.physicalPlanDescription() for x in map(ran.apply, range(ran.size()))}

    before = plans()
    assert registry.QUERIES["q01_isochrone_cells"](spark, SMALL).collect()
    meet = [p for k, p in plans().items() if k not in before and "elapsed" in p and "p_partkey" in p]
    assert len(meet) == 1  # where arrivals meet the cells of stops
    assert set(re.findall(r"(\w+Join)[^\n]*\nLeft keys \[1\]: \[stop#", meet[0])) == {"SortMergeJoin"}
