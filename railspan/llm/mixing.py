"""Mixing sources to target weights by iterative proportional fitting (operator 6, DataFrame functions only).

Documents are counted into cells (source, lang, topic); a cell's weight is its tokens. Fitting rakes the
weights to the target share of every source, every language and every topic in turn, ROUNDS times. A cell's
rate is its fitted weight over its tokens; a document is drawn with probability min(1, c * rate), c set so
that the expected tokens are FRACTION of all. The draw compares a hash of doc_id with the probability, so it
is the same on every run and in every partitioning.

Targets: a table (dim, value, share), or by default tempered shares (own share to the power of TEMPER).
Tokens are words plus one end token, so a cell is never empty of weight. Null source, lang or topic is a
value of its own; null or empty texts count their end token. A value without a target keeps its weight.
A hot source is counted on the map side; cells, not documents, are shuffled.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WS, table, written

FRACTION = 0.5
ROUNDS = 6
#: Default targets: share ** power, normalised; 0 is uniform.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.0}
TOPICS, LONG = 8, 7
#: A marginal share may miss its target by this; else rake() warns.
TOLERANCE = 1e-3
SEED = "mix1"
#: Steps of the SQL form; the search itself goes on until nothing changes.
CAP_STEPS = 10


def _topic(docs: DataFrame) -> Column:
    """The column topic, or else the class that most words of the whole text fall in.

    Words are runs of LONG ASCII letters or more, classes come from a word's ends and length; the least class wins
    ties, and texts without such a word are a class of their own.
    """
    if "topic" in docs.columns:
        return F.coalesce(F.col("topic").cast("string"), F.lit("(null)"))
    words = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(f"[A-Za-z]{{{LONG},}}"), 0)
    low = lambda x: F.ascii(x).bitwiseOR(F.lit(32))
    classes = F.transform(words, lambda w: (low(w) * 31 + low(F.right(w, F.lit(1))) * 7 + F.length(w)) % TOPICS)

    def most(c: Column) -> Column:
        # a second parameter of the lambda would be the index
        size = lambda k: F.size(F.filter(c, lambda x: x == F.lit(k)))
        counts = F.array(*[F.struct(size(k).alias("n"), F.lit(-k).alias("k")) for k in range(TOPICS)])
        return F.when(F.size(c) > 0, F.concat(F.lit("t"), (-F.array_max(counts)["k"]).cast("string"))).otherwise(F.lit("none"))

    return F.element_at(F.transform(F.array(classes), most), 1)


def _marked(docs: DataFrame) -> DataFrame:
    words = F.size(F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), WS), lambda w: w != ""))
    return docs.withColumns({"_tokens": (words + 1).cast("bigint"), "_source": F.coalesce(F.col("source").cast("string"), F.lit("(null)")), "_lang": F.coalesce(F.col("lang").cast("string"), F.lit("(null)")), "_topic": _topic(docs)})


def rake(cells: DataFrame, targets: DataFrame | None = None, rounds: int = ROUNDS) -> DataFrame:
    """cells (_source, _lang, _topic, tokens) with column w: weights whose marginal shares meet the targets."""
    w = cells.withColumn("w", F.col("tokens").cast("double"))
    for dim in ("source", "lang", "topic"):
        if targets is None:
            each = cells.groupBy(f"_{dim}").agg(F.pow(F.sum("tokens").cast("double"), F.lit(TEMPER[dim])).alias("p"))
            total = each.agg(F.sum("p")).first()[0] or 1.0
            t = each.select(F.col(f"_{dim}").alias("v"), (F.col("p") / F.lit(total)).alias(f"t_{dim}"))
        else:
            t = targets.where(F.col("dim") == dim).select(F.col("value").alias("v"), F.col("share").cast("double").alias(f"t_{dim}"))
        w = w.join(t, F.col(f"_{dim}") == F.col("v"), "left").drop("v")
    w = written(w, "cells")
    for i in range(rounds):
        for dim in ("source", "lang", "topic"):
            have = F.sum("w").over(W.partitionBy(f"_{dim}"))
            w = w.withColumn("w", F.when(F.col(f"t_{dim}").isNull(), F.col("w")).otherwise(F.col("w") * F.col(f"t_{dim}") / have))
        if i % 2:
            w = written(w, "raked")
    miss = [w.groupBy(f"t_{dim}", f"_{dim}").agg(F.abs(F.sum("w") - F.first(f"t_{dim}")).alias("d")).where(F.col(f"t_{dim}").isNotNull()) for dim in ("source", "lang", "topic")]
    worst = max((m.agg(F.max("d")).first()[0] or 0.0) for m in miss)
    if worst > TOLERANCE:
        warnings.warn(f"a marginal misses its target by {worst:.2g} after {rounds} rounds; the targets may contradict each other", stacklevel=2)
    return w.drop("t_source", "t_lang", "t_topic")


def rates(cells: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """Raked cells with p, the probability of a cell's documents. Each step is one row at the driver."""
    r = cells.withColumn("r", F.col("w") / F.col("tokens"))
    total = r.agg(F.sum("tokens").alias("t"), F.sum("w").alias("w")).first()
    c = fraction * (total["t"] or 0) / (total["w"] or 1.0)
    while True:  # c grows and cells only become full, so it ends
        s = r.agg(F.sum(F.when(F.lit(c) * F.col("r") >= 1, F.col("tokens"))).alias("full"), F.sum(F.when(F.lit(c) * F.col("r") < 1, F.col("w"))).alias("rest")).first()
        if s["full"] is None or not s["rest"]:
            break
        after = max(c, (fraction * total["t"] - s["full"]) / s["rest"])
        if after <= c * (1 + 1e-12):
            break
        c = after
    return r.withColumn("p", F.least(F.lit(1.0), F.lit(c) * F.col("r"))).drop("r")


def uniform(doc_id: str) -> Column:
    """A hash of doc_id in [0, 1)."""
    digest = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(f":{SEED}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") / F.lit(2.0**48)


def mix(docs: DataFrame, targets: DataFrame | None = None, fraction: float = FRACTION) -> DataFrame:
    """docs with _tokens, _topic, _p and _drawn; every row of docs appears once."""
    marked = _marked(docs)
    cells = marked.groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").alias("tokens"))
    fitted = rates(written(rake(written(cells, "cells0"), targets), "fitted"), fraction).select(F.col("_source").alias("s"), F.col("_lang").alias("l"), F.col("_topic").alias("t"), "p")
    out = marked.join(fitted, F.expr("_source = s and _lang = l and _topic = t"), "left").drop("s", "l", "t")
    return out.withColumnRenamed("p", "_p").withColumn("_drawn", uniform("doc_id") < F.col("_p"))


def op6_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return d.select("doc_id", F.col("_tokens").alias("n_tokens"), F.col("_topic").alias("topic"), F.round("_p", 6).alias("p"), F.col("_drawn").alias("drawn"))


def _sql() -> str:
    parts = [
        f"""d0 AS (SELECT doc_id, len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) + 1 AS tokens, coalesce(source, '(null)') AS source, coalesce(lang, '(null)') AS lang,
  list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z]{{{LONG},}}'), lambda w: ((ascii(w) | 32) * 31 + (ascii(right(w, 1)) | 32) * 7 + length(w)) % {TOPICS}) AS cl FROM documents)""",
        f"""d AS (SELECT * EXCLUDE (cl), CASE WHEN len(cl) > 0 THEN 't' || -list_max([{", ".join(f"{{{{'n': len(list_filter(cl, lambda x: x = {k})), 'k': -{k}}}}}" for k in range(TOPICS))}]).k ELSE 'none' END AS topic FROM d0)""".replace("{{", "{").replace("}}", "}"),
        "cells AS (SELECT source, lang, topic, sum(tokens) AS tokens FROM d GROUP BY ALL)",
    ]
    for dim, power in TEMPER.items():
        parts.append(f"t_{dim} AS (SELECT {dim} AS v, p / sum(p) OVER () AS share FROM (SELECT {dim}, pow(sum(tokens)::DOUBLE, {power}) AS p FROM cells GROUP BY {dim}))")
    last, n = "(SELECT *, tokens::DOUBLE AS w FROM cells)", 0
    for _ in range(ROUNDS):
        for dim in TEMPER:
            n += 1
            parts.append(f"w{n} AS MATERIALIZED (SELECT x.source, x.lang, x.topic, x.tokens, x.w * t.share / sum(x.w) OVER (PARTITION BY x.{dim}) AS w FROM {last} AS x JOIN t_{dim} AS t ON t.v = x.{dim})")
            last = f"w{n}"
    parts.append(f"c0 AS (SELECT {FRACTION} * sum(tokens) / sum(w) AS c FROM {last})")
    for k in range(CAP_STEPS):
        parts.append(f"c{k + 1} AS (SELECT CASE WHEN s.f IS NULL OR coalesce(s.rest, 0) = 0 THEN s.c ELSE greatest(s.c, ({FRACTION} * s.t - s.f) / s.rest) END AS c FROM (SELECT any_value(c{k}.c) AS c, sum(CASE WHEN c{k}.c * w / tokens >= 1 THEN tokens END) AS f, sum(CASE WHEN c{k}.c * w / tokens < 1 THEN w END) AS rest, sum(tokens) AS t FROM {last}, c{k}) AS s)")
    return (
        "WITH "
        + ",\n".join(parts)
        + f"""
SELECT d.doc_id, CAST(d.tokens AS BIGINT) AS n_tokens, d.topic, round(least(1.0, c.c * (x.w / x.tokens)), 6) AS p,
  (('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || ':{SEED}'), 1, 12))::BIGINT / pow(2.0, 48)) < least(1.0, c.c * (x.w / x.tokens)) AS drawn
FROM d JOIN {last} AS x ON x.source = d.source AND x.lang = d.lang AND x.topic = d.topic, c{CAP_STEPS} AS c"""
    )


OP6_SQL = _sql()
