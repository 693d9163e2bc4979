"""Redrawn paths, wiki tables, tags and made-up colours against plain Python."""

import colorsys
import hashlib
import itertools
import random

from pyspark.sql import functions as F

from railspan.functions import names, tags
from railspan.functions.wikitable import stopping_patterns
from railspan.operators import folds, graph


def test_corridor_paths_equal_brute_force(spark):
    rng = random.Random(11)
    net = {(a, b): rng.randint(1, 9) for a, b in itertools.permutations(range(9), 2) if rng.random() < 0.35}
    inside = {p: sorted(rng.sample(range(9), 6)) for p in range(40)}
    ends = {p: (c[0], c[-1]) for p, c in inside.items()}
    paths = spark.createDataFrame([(p, a, b) for p, (a, b) in ends.items()], "path long, src long, dst long")
    corridor = spark.createDataFrame([(p, c) for p, cells in inside.items() for c in cells * 2], "path long, cell long")
    edges = spark.createDataFrame([(a, b, c) for (a, b), c in net.items()], "src long, dst long, sec long")
    got = {}
    for r in sorted(graph.corridor_paths(paths, corridor, edges).collect()):
        got.setdefault(r.path, []).append(r.cell)
    for p, cells in inside.items():
        a, b = ends[p]
        ways = [(a, *mid, b) for n in range(5) for mid in itertools.permutations([c for c in cells if c not in (a, b)], n)]
        costs = [(sum(net[s] for s in itertools.pairwise(w)), w[::-1], w) for w in ways if all(s in net for s in itertools.pairwise(w))]
        assert got.get(p) == (list(min(costs)[2]) if costs else None)
    assert graph.corridor_paths(paths, corridor.limit(0), edges).count() == 0


def test_made_up_colour_is_the_hls_colour(spark):
    words = [f"線{i}" for i in range(2000)]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", names.made_up_colour(F.col("w")).alias("c")).collect()
    hues = set()
    for r in got:
        hue = int(hashlib.md5(r.w.encode()).hexdigest()[:8], 16) % 360
        hues.add(hue)
        assert r.c == "#" + "".join(f"{int(255 * v):02x}" for v in colorsys.hls_to_rgb(hue / 360, 0.42, 0.62)), hue
    assert len(hues) > 350


def test_station_tables(spark):
    head = "[[#駅一覧]] intro\n{|\n|-\n|[[偽駅]]||●||●\n|}\n== 駅一覧 ==\n{| class=\"x\"\n|-\n!駅||特急||特急〈ひたち〉\n|-\n"
    rows = ["|[[上野駅]]||●||○", '| style="a" | [[日暮里]]||●||●', "|[[三河島 (町)|三河島駅]]\n|｜\n|▲", "|[[南千住駅]]||&nbsp;||レ||●", "|[[北千住駅]]||文||字"]
    pages = [(1, head + "\n|-\n".join(rows) + "\n|}\n[[外駅]]||●||●"), (2, None), (3, ""), (4, "== 駅一覧 ==\nno table"), (5, "== 駅一覧 ==\n{|\n|-\n!駅||特急\n|-\n|[[甲駅]]||●"), (6, head + rows[0])]
    got = {tuple(r) for r in stopping_patterns(spark.createDataFrame(pages, "page int, text string"), "page", "text").select("page", "kind", "column", "station").collect()}
    full = {(1, "特急", 0, "上野駅"), (1, "特急", 1, "上野駅"), (1, "特急", 1, "三河島駅"), (1, "特急", 1, "南千住駅")}
    assert got == full | {(6, "特急", 0, "上野駅"), (6, "特急", 1, "上野駅")}


def test_tags_and_missing_tags(spark):
    columns = ["railway", "public_transport", "bus", "highway", "ferry", "aerialway", "amenity", "usage", "monorail", "name", "foot", "access"]
    rows = [{}, {"railway": "station", "bus": "yes"}, {"public_transport": "station", "amenity": "bus_station"}, {"public_transport": "stop_position"}, {"railway": "halt", "usage": "training"}, {"railway": "station", "name": "北信号場"}, {"highway": "steps", "access": "private"}, {"highway": "path", "access": "no", "foot": "yes"}]
    d = spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], ", ".join(f"{c} string" for c in columns))
    got = [tuple(r) for r in d.select(tags.not_train(), tags.stop_node(), tags.passenger_station(), tags.walkable()).collect()]
    assert got == [(False, False, False, False), (True, True, True, False), (True, False, False, False), (False, True, False, False), (False, True, False, False), (False, True, False, False), (False, False, False, False), (False, False, False, True)]


def test_short_groups_in_batches(spark):
    rows = [(t, i, (t * 7 + i * 3) % 5) for t in range(300) for i in range(t % 6)]
    d = spark.createDataFrame(rows, "trip long, seq long, v long")
    got = {r.trip: r.s for r in folds.by_short_group(d, "trip", "seq", ["v"], lambda k, v: [(k, ",".join(map(str, v)))], "trip bigint, s string").collect()}
    assert got == {t: ",".join(str((t * 7 + i * 3) % 5) for i in range(t % 6)) for t in range(300) if t % 6}
