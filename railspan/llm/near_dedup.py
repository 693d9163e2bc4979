"""Near-duplicate documents by SetSketch registers (operator 5).

A document's set holds its distinct k-word shingles. Its sketch has M registers: register i is the
truncated exponent K = floor(1 - log_BASE(min h_i)) over the set's shingles, with h_i exponential of rate
RATE. Registers of a union are the register-wise maximum, so sketches merge. BAND registers form one
64-bit band key; sets of Jaccard similarity J share a band with probability at least
1 - (1 - J**BAND)**(M/BAND): 0.999998 at J = 0.8.

1. One scan makes sizes, 128-bit fingerprints of the whole sets, and sketches.
2. Equal sets collapse to one node each, whatever doc_ids hold them; a node carries one text.
3. In each bucket of a band, members are proposed to one hub (the most copied text). Pairs pass the size
   bound, then the joint likelihood of the registers, then the exact test on the full sets.
4. Components of the links. Buckets that still hold several components are searched for links between them:
   small ones by a join, larger ones in blocks. A pair within one component needs no test: it cannot change
   the result. So a group of n copies costs about n tests, and no pair that could join two components is
   left out. Blocks get registers only; texts follow for members that have a plausible pair there.

The exact test takes shingles by their words: hashes of one comparison are held against the words' bytes, and
changed for others should two different words or shingles ever share one. Set sizes and equal sets rest on the
64- and 128-bit hashes.

Null, empty and blank texts have an empty set and are linked with nothing; texts under k words have one
shingle. Rows are linked by their texts alone: repeated rows share a component, and rows with one doc_id and
different texts may lie in different ones. A row without doc_id links like any other; component_id is the
smallest doc_id there is in the component, null if there is none, and such a row is never kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _LOW, discard, mix64, slices, small_batches, table, texts_of, word_hashes, word_spans, written
from .components import components

M, BAND = 100, 4
BASE, RATE, TOP = 1.02, 20.0, 65534
#: A pair is dropped when its registers are exp(SLACK) times likelier at their best J than at any J of the threshold or more.
SLACK = 12.0
#: Members of a block, and shingles of a block about; a cell of two blocks is one task's work.
BLOCK, BLOCK_SHINGLES = 512, 400_000
#: Buckets up to this size are paired by a join.
SMALL = 32

_rng = np.random.default_rng(20240501)
_A = (_rng.integers(0, 2**32, M, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 2**32, M, dtype=np.uint64).astype(np.uint32)
_C = mix64(np.arange(11, 11 + 64, dtype=np.uint64)) | np.uint64(1)


def _rolled(h: np.ndarray, k: int, salt: np.uint64) -> np.ndarray:
    """Hashes of all runs of k words, across texts too."""
    out = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        out += h[j : len(h) - k + 1 + j] * _C[j]
    return mix64(out ^ salt)


def _own_sets(h: np.ndarray, rolled: np.ndarray, n_words: np.ndarray, k: int, salt: np.uint64) -> Iterator[np.ndarray]:
    at = 0
    for n in n_words:
        if n >= k:
            own = np.sort(rolled[at : at + n - k + 1])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif n:
            yield mix64((h[at : at + n] * _C[:n]).sum(dtype=np.uint64, keepdims=True) + _C[32 + n : 33 + n] ^ salt)
        else:
            yield np.zeros(0, np.uint64)
        at += n


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    starts, ends, n_words = word_spans(data, offsets)
    h = word_hashes(data, starts, ends)
    yield from _own_sets(h, _rolled(h, k, np.uint64(0)), n_words, k, np.uint64(0))


def _same_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> bool:
    """Whether words of equal hash are equal words, by their bytes."""
    order = np.argsort(h, kind="stable")
    twin = np.flatnonzero(h[order][1:] == h[order][:-1])
    a, b = order[twin], order[twin + 1]
    size = ends[a] - starts[a]
    if (size != ends[b] - starts[b]).any():
        return False
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    return bool((_LOW[data[place + np.repeat(starts[a], size)]] == _LOW[data[place + np.repeat(starts[b], size)]]).all())


def _same_shingles(h: np.ndarray, rolled: np.ndarray, k: int) -> bool:
    """Whether runs of equal hash are equal runs of word hashes."""
    order = np.argsort(rolled, kind="stable")
    twin = np.flatnonzero(rolled[order][1:] == rolled[order][:-1])
    a, b = order[twin], order[twin + 1]
    return all((h[a + j] == h[b + j]).all() for j in range(k))


def exact_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sets of several texts whose numbers are equal just where the shingles' words are: dense numbers stand for words if a hash should fail."""
    starts, ends, n_words = word_spans(data, offsets)
    h = word_hashes(data, starts, ends)
    if not _same_words(data, starts, ends, h):
        low, number = _LOW[data].tobytes(), {}
        h = mix64(np.array([number.setdefault(low[a:b], len(number) + 1) for a, b in zip(starts, ends, strict=True)], np.uint64))
    for salt in range(8):
        rolled = _rolled(h, k, np.uint64(salt))
        if salt:
            rolled = mix64(rolled + _rolled(mix64(h + np.uint64(salt)), k, np.uint64(salt)))
        if _same_shingles(h, rolled, k):
            return list(_own_sets(h, rolled, n_words, k, np.uint64(salt)))
    raise RuntimeError("shingle hashes collide under every salt")


def registers(own: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of hashes (all 0 for the empty set)."""
    if not len(own):
        return np.zeros(M, np.uint16)
    x = (own >> np.uint64(32)).astype(np.uint32)
    least = np.full(M, 2**32 - 1, np.uint32)
    for i in range(0, len(x), 4096):
        block = np.multiply.outer(x[i : i + 4096], _A)
        block += _B
        np.minimum(least, block.min(axis=0), out=least)
    h = -np.log1p(-(least.astype(np.float64) + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def merge_registers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of a union."""
    return np.maximum(a, b)


_GRID = np.linspace(0.0, 1.0, 101)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def estimate(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray, at_least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of register pairs and exact set sizes -> the likeliest J, and whether J >= at_least stays plausible."""
    if not len(na):
        return np.zeros(0), np.zeros(0, bool)
    more, less = (ra > rb).sum(1), (ra < rb).sum(1)
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.minimum(_GRID[None, :], np.minimum(u / v, v / u))
    pu, pv = np.clip(_p(np.clip(u - v * j, 0, 1)), 1e-9, 1), np.clip(_p(np.clip(v - u * j, 0, 1)), 1e-9, 1)
    ll = more[:, None] * np.log(pu) + less[:, None] * np.log(pv) + (M - more - less)[:, None] * np.log(np.clip(1 - pu - pv, 1e-9, 1))
    best = ll.argmax(1)
    high = np.where(_GRID[None, :] >= at_least - 1e-9, ll, -np.inf).max(1)
    return j[np.arange(len(j)), best], high >= ll.max(1) - SLACK


def _as_registers(bands: pa.Array) -> np.ndarray:
    flat = bands.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.view(np.uint16).reshape(len(bands), M)


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, code, n, f1, f2, bands): a hash of the text, set size, fingerprint of the whole set, and the registers as M/BAND 64-bit band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts_of(batch.column(2))
            n, f1, f2, bands = [], [], [], []
            for i, j in slices(offsets):
                for own in shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k):
                    n.append(len(own))
                    f1.append(own.sum(dtype=np.uint64))
                    f2.append(mix64(own ^ _C[40]).sum(dtype=np.uint64))
                    bands.append(registers(own).view(np.int64))
            flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(n, pa.int64()),
                    pa.array(np.array(f1, np.uint64).view(np.int64)),
                    pa.array(np.array(f2, np.uint64).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * (M // BAND), pa.int32()), pa.array(flat)),
                ],
                names=["doc_id", "code", "n", "f1", "f2", "bands"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("code"), "text").mapInArrow(run, "doc_id bigint, code bigint, n bigint, f1 bigint, f2 bigint, bands array<bigint>")


def _plausible(pairs: DataFrame, sk: DataFrame, at_least: float) -> DataFrame:
    """Pairs (u, v) whose registers leave J >= at_least plausible, with the estimate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = (b.column(i).to_numpy().astype(float) for i in (2, 3))
            est, keep = estimate(_as_registers(b.column(4)), _as_registers(b.column(5)), na, nb, at_least)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(est)], names=["u", "v", "est"]).filter(pa.array(keep))

    a = sk.select(F.col("g").alias("u"), F.col("n").alias("nu"), F.col("bands").alias("bu"))
    b = sk.select(F.col("g").alias("v"), F.col("n").alias("nv"), F.col("bands").alias("bv"))
    return pairs.select("u", "v").join(a, "u").join(b, "v").select("u", "v", "nu", "nv", "bu", "bv").mapInArrow(run, "u bigint, v bigint, est double")


def _meets(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets meet 100 * |both| >= percent * |either|."""
    if not len(a) or not len(b):
        return False
    both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _texts(wanted: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """(g, text) of the wanted sets, one row each."""
    key = sets.join(wanted.select("g").distinct(), "g").select("g", F.col("carrier.doc_id").alias("_id"), F.col("carrier.code").alias("_code"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("_of"), "text", F.xxhash64("text").alias("_hash"))
    found = rows.join(key, F.expr("_of <=> _id and _hash = _code"))
    # repeated rows, same doc_id and text, come together here
    return written(found.groupBy("g").agg(F.first("text").alias("text")), "texts")


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (u, v) whose full sets meet 100 * |both| >= percent * |either|, by their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            hubs = b.column(0).to_pylist()
            # a hub's rows often come in runs: its text stands once before them
            lead = [not i or u != hubs[i - 1] for i, u in enumerate(hubs)]
            size = np.diff(texts_of(b.column(3))[1])
            i = 0
            while i < len(hubs):
                j, held = i + 1, int(size[i])
                while j < len(hubs) and held + size[j] <= 1_000_000:
                    held += int(size[j])
                    j += 1
                heads = [r for r in range(i, j) if r == i or lead[r]]
                both = pa.concat_arrays([b.column(2).take(pa.array(heads, pa.int64())), b.column(3).slice(i, j - i)])
                sets = exact_sets(*texts_of(both), k)
                at = np.searchsorted(heads, np.arange(i, j), side="right") - 1
                keep += [_meets(sets[x], sets[len(heads) + y], percent) for y, x in enumerate(at)]
                i = j
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    withv = pairs.select("u", "v").join(texts.select(F.col("g").alias("v"), F.col("text").alias("tv")), "v")
    withu = withv.join(texts.select(F.col("g").alias("u"), F.col("text").alias("tu")), "u")
    return withu.select("u", "v", "tu", "tv").mapInArrow(run, "u bigint, v bigint")


def _fits(a: str, b: str, percent: int):
    return F.expr(f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})")


def _mixed(members: DataFrame) -> DataFrame:
    """Members of buckets that hold several components. members: band, key, doc, n, cnt, hub, comp."""
    mixed = members.groupBy("band", "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("band", "key")
    return members.join(mixed, ["band", "key"])


def _across_small(mixed: DataFrame, sk: DataFrame, percent: int) -> DataFrame:
    """Plausible pairs (u, v) of different components that share a bucket of SMALL members at most."""
    small = mixed.where(F.col("cnt") <= SMALL)
    a, b = small.alias("a"), small.alias("b")
    few = a.join(b, F.expr("a.band = b.band and a.key = b.key and a.doc < b.doc and a.comp <> b.comp") & _fits("a.n", "b.n", percent))
    few = few.select(F.col("a.doc").alias("u"), F.col("b.doc").alias("v")).distinct()
    return _plausible(few, sk, percent / 100).select("u", "v")


def _cells(mixed: DataFrame) -> DataFrame:
    """Rows (hub, same, i, j, doc, n, comp, q, blk): the cells of two blocks that each member of a large bucket meets.

    Buckets with one hub are a family. Its largest component is the base; every other member, as a query, meets
    all of the family in blocks.
    """
    family = mixed.where(F.col("cnt") > SMALL).select("hub", "doc", "n", "comp").distinct()
    sizes = family.groupBy("hub", "comp").agg(F.count("*").alias("m"), F.max("n").alias("big"))
    main = sizes.groupBy("hub").agg(F.max(F.struct("m", (-F.col("comp")).alias("c"))).alias("x"), F.sum("m").alias("all"), F.max("big").alias("big"))
    main = main.select("hub", (-F.col("x.c")).alias("base"), F.col("x.m").alias("nb"), (F.col("all") - F.col("x.m")).alias("nq"), F.greatest(F.lit(8), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_SHINGLES) / F.col("big")))).alias("size"))
    rows = family.join(main, "hub").withColumn("q", F.col("comp") != F.col("base"))
    rows = rows.withColumn("qs", F.ceil(F.col("nq") / F.col("size")).cast("int")).withColumn("bs", F.ceil(F.col("nb") / F.col("size")).cast("int"))
    rows = rows.withColumn("blk", F.pmod(F.xxhash64("doc"), F.when(F.col("q"), F.col("qs")).otherwise(F.col("bs"))).cast("int"))
    cell = "named_struct('same', {same}, 'i', {i}, 'j', {j})"
    to_base = "transform(sequence(0, bs - 1), j -> " + cell.format(same="false", i="blk", j="j") + ")"
    to_queries = "transform(sequence(0, qs - 1), j -> " + cell.format(same="true", i="least(blk, j)", j="greatest(blk, j)") + ")"
    from_base = "transform(sequence(0, qs - 1), i -> " + cell.format(same="false", i="i", j="blk") + ")"
    return rows.withColumn("cell", F.explode(F.expr(f"if(q, concat({to_base}, {to_queries}), {from_base})"))).select("hub", "cell.same", "cell.i", "cell.j", "doc", "n", "comp", "q", "blk")


def _cell_pairs(p: pd.DataFrame, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Plausible pairs (positions, estimate) of a cell that share a band and lie in different components."""
    regs = np.array(p["bands"].tolist(), np.int64).view(np.uint16).reshape(len(p), M)
    keys = regs.reshape(len(p), M // BAND, BAND).copy().view(np.int64)[:, :, 0]
    doc, comp, n, blk, q = (p[c].to_numpy() for c in ("doc", "comp", "n", "blk", "q"))
    same, within = bool(p["same"].iloc[0]), int(p["i"].iloc[0]) == int(p["j"].iloc[0])
    x_est, x_a, x_b = [np.zeros(0)], [np.zeros(0, int)], [np.zeros(0, int)]
    for x in np.flatnonzero(q):
        ok = (comp != comp[x]) & (100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x]))
        if not same:
            ok &= ~q
        elif within:
            ok &= doc > doc[x]
        else:
            ok &= blk > blk[x]
        ys = np.flatnonzero(ok)
        ys = ys[(keys[ys] == keys[x]).any(1)]
        if len(ys):
            est, keep = estimate(np.broadcast_to(regs[x], (len(ys), M)), regs[ys], np.full(len(ys), float(n[x])), n[ys].astype(float), percent / 100)
            x_est.append(est[keep])
            x_a.append(np.full(int(keep.sum()), x))
            x_b.append(ys[keep])
    return np.concatenate(x_a), np.concatenate(x_b), np.concatenate(x_est)


_CELL = ("hub", "same", "i", "j")


def _across_large(mixed: DataFrame, sets: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (u, v) between components that share a bucket of more members, confirmed on the full sets.

    A first pass over the cells has registers only and names the members with a plausible pair. They come again
    with their texts; a cell then tests its pairs, likeliest first, and skips those that its earlier links have
    joined: it returns a link for each joining at most, never all pairs.
    """
    sketch = sets.select(F.col("g").alias("doc"), "bands")
    cells = _cells(mixed)

    def involved(p: pd.DataFrame) -> pd.DataFrame:
        a, b, _ = _cell_pairs(p, percent)
        return p.iloc[np.union1d(a, b)][[*_CELL, "doc", "n", "comp", "q", "blk"]]

    some = written(cells.join(sketch, "doc").groupBy(*_CELL).applyInPandas(involved, "hub bigint, same boolean, i int, j int, doc bigint, n bigint, comp bigint, q boolean, blk int"), "involved")
    if some.isEmpty():
        return some.select(F.col("doc").alias("u"), F.col("doc").alias("v"))
    rows = some.join(sketch, "doc").join(_texts(some.select(F.col("doc").alias("g")), sets, docs).withColumnRenamed("g", "doc"), "doc")

    def run(p: pd.DataFrame) -> pd.DataFrame:
        a, b, est = _cell_pairs(p, percent)
        order = np.argsort(-est, kind="stable")
        doc, comp = p["doc"].to_numpy(), p["comp"].to_numpy()
        sets = exact_sets(*texts_of(pa.array(p["text"], pa.string())), k)
        root = {c: c for c in set(comp.tolist())}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        out = []
        for x, y in zip(a[order].tolist(), b[order].tolist(), strict=True):
            cx, cy = find(int(comp[x])), find(int(comp[y]))
            if cx != cy and _meets(sets[x], sets[y], percent):
                root[cx] = cy
                out.append((doc[x], doc[y]))
        return pd.DataFrame(out, columns=["u", "v"]).astype("int64")

    return rows.groupBy(*_CELL).applyInPandas(run, "u bigint, v bigint")


def link_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """documents (doc_id, text, ...) -> (doc_id, n_shingles, component_id, kept, set_id, code), a row for each row of docs.

    set_id is the component by its own number, for rows without doc_id too (null for empty sets); code is xxhash64 of the text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sk = written(sketches(docs, k), "sketches")
    # One node for each set; equal sets add up on the map side. Numbers are fixed by writing them.
    sets = sk.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies"), F.min(F.struct("doc_id", "code")).alias("carrier"), F.first("bands").alias("bands"))
    sets = written(sets.withColumn("g", F.monotonically_increasing_id()), "sets")

    bands = sets.select("g", "n", "copies", F.posexplode("bands").alias("band", "key"))
    hubs = bands.groupBy("band", "key").agg(F.count("*").alias("cnt"), F.max(F.struct("copies", (-F.col("g")).alias("neg"), "n")).alias("hub")).where("cnt > 1")
    members = bands.join(hubs, ["band", "key"]).select("band", "key", F.col("g").alias("doc"), "n", "cnt", (-F.col("hub.neg")).alias("hub"), F.col("hub.n").alias("hub_n"))
    members = written(members, "members")

    t = docs.select("doc_id", "text")
    stars = members.where("doc <> hub").where(_fits("n", "hub_n", percent)).select(F.col("hub").alias("u"), F.col("doc").alias("v")).distinct()
    tried = written(_plausible(stars, sets, percent / 100).select("u", "v"), "tried")
    ends = lambda d: d.select(F.col("u").alias("g")).union(d.select(F.col("v").alias("g")))
    texts = _texts(ends(tried), sets, t)
    links = written(verified(tried, texts, k, percent), "links")
    discard(texts)
    label = components(links)

    c = label.select(F.col("node").alias("doc"), "comp")
    current = members.select("band", "key", "doc", "n", "cnt", "hub").join(c, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
    mixed = written(_mixed(current), "mixed")
    discard(members, links)
    seen = tried.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    few = written(_across_small(mixed, sets, percent).join(seen, ["u", "v"], "left_anti"), "across")
    more = written(verified(few, _texts(ends(few), sets, t), k, percent).unionByName(_across_large(mixed, sets, t, k, percent)), "links")
    discard(tried, mixed, few)
    if not more.isEmpty():
        label = components(more, label)

    of = sets.select("n", "f1", "f2", "low", "g").join(label, F.col("g") == F.col("node"), "left").withColumn("set_id", F.coalesce("comp", "g"))
    lows = of.groupBy("set_id").agg(F.min("low").alias("component_id"))
    of = of.select("n", "f1", "f2", "set_id").join(lows, "set_id")
    out = sk.select("doc_id", "code", "n", "f1", "f2").join(of, ["n", "f1", "f2"], "left")
    out = out.withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"), "set_id", "code")


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without all but one row of each component: the row of least doc_id (a row without one goes first to go), of least text hash on ties.

    Rows with empty sets stay. docs needs doc_id and text; other columns pass through. Repeated rows are copies too.
    """
    out = link_components(docs, k, percent).where("set_id is not null")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "code")
    rows = written(out.groupBy("set_id", "doc_id", "code").agg(F.count("*").alias("m")), "rows")
    best = rows.groupBy("set_id").agg(F.min(order).alias("best"))
    judged = rows.join(best, "set_id").withColumn("stays", F.expr("doc_id <=> best.doc_id and code = best.code"))
    judged = written(judged.select(F.col("doc_id").alias("_id"), F.col("code").alias("_code"), "stays", "m"), "judged")
    discard(rows)
    def of(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        # columns by reference: docs may have any names
        return rows.join(keys, rows["doc_id"].eqNullSafe(keys["_id"]) & (F.xxhash64(rows["text"]) == keys["_code"]), how)

    left = of(docs, judged.where("not stays"), "left_anti")
    again = judged.where("stays and m > 1")
    if again.isEmpty():
        return left
    # repeated rows, same doc_id and text: any one of them stays
    one = of(left, again, "left_semi").withColumn("_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "_hash"]).drop("_hash")
    return of(left, again, "left_anti").unionByName(one)


def op5_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents").select("doc_id", "text"), k=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")
