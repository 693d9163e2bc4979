"""Quality rules with adaptive thresholds (operator 10, DataFrame functions only).

Each document gets counts that are exact functions of its text. Every metric is summarised per (lang, source)
by a mergeable quantile sketch: a histogram over a fixed grid of integer buckets, so that sketches merge by
adding counts, any rank is right to one bucket, and a group's sketch has at most GRID + 1 rows whatever its
size. A hot source is pre-aggregated on the map side.

A metric has no cutoff of its own. Its fence in a group is

    q75 + FENCE * (q75 - q25 + noise) + 1 bucket,

with the quartiles of the group's sketch, and noise the sampling error of a ratio at the group's median rate
over the median number of trials of its documents (a second sketch; the rate is smoothed by one success and one
failure, so a metric that is zero almost everywhere has a spread too). Quartiles of a group of n documents are
drawn towards its language's, and a language's towards those of all documents, by PRIOR_DOCS / (n + PRIOR_DOCS):
small groups lean on their parents, and no group size switches the rule. Fences are joined back and compared.

Null or empty texts have no words and fail the base rule; null lang or source forms a group of its own; repeated
rows and ids count and are judged one by one; other columns of the input are passed through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WS, table, written

#: Buckets of a sketch: ratios in thousandths; word length in tenths of a character up to 100; sizes in their unit.
GRID = 1000
#: Documents that a parent's quartiles weigh as much as.
PRIOR_DOCS = 50
FENCE = 6
WINDOW = 8
#: metric -> (numerator, denominator, buckets of a ratio of 1)
METRICS = {
    "symbols": ("n_symbols", "word_chars", GRID),
    "dup_lines": ("n_dup_lines", "n_lines", GRID),
    "repeats": ("n_repeat_words", "n_words", GRID),
    "capitals": ("n_capitals", "word_chars", GRID),
    "word_length": ("word_chars", "n_words", 10),
}
#: size sketch -> units of a bucket; and metric -> (size sketch, trials of a bucket). A trial of repeats is a window.
SIZES = {"word_chars": 64, "n_lines": 1, "n_words": WINDOW}
TRIALS = {"symbols": ("word_chars", 64), "dup_lines": ("n_lines", 1), "repeats": ("n_words", 1), "capitals": ("word_chars", 64)}


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once: lambda variables are never inlined by the optimizer."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _windows(words: Column) -> Column:
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    rolled = _let(hashes, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, F.lit(WINDOW)))))
    return F.when(F.size(words) >= WINDOW, rolled).otherwise(F.array().cast("array<bigint>"))


def _covered(windows: Column) -> Column:
    """Words inside windows that occur twice or more: sort windows by hash, keep those equal to a neighbour, measure the union of their spans."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = _let(
        placed,
        lambda s: F.array_sort(
            F.transform(
                F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]).eqNullSafe(True) | (F.get(s, j + 1)["h"] == x["h"]).eqNullSafe(True)),
                lambda x: x["i"],
            )
        ),
    )
    return _let(
        twice,
        lambda p: F.aggregate(
            F.transform(p, lambda a, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - a, F.lit(WINDOW)))),
            F.lit(0).cast("bigint"),
            lambda acc, x: acc + x,
        ),
    )


def measure(docs: DataFrame) -> DataFrame:
    """The documents with a struct column _m of counts; one pass, no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumn("_words", F.filter(F.split(text, WS), lambda w: w != ""))
    d = d.withColumn("_windows", _windows(F.col("_words")))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    d = d.withColumn("_lines", lines)
    counts = F.struct(
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), _covered(F.col("_windows"))).otherwise(F.lit(0)).cast("bigint").alias("n_repeat_words"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))).cast("bigint").alias("n_capitals"),
    )
    return d.withColumn("_m", counts).drop("_words", "_windows", "_lines")


def _buckets() -> dict[str, str]:
    """SQL of the bucket of each metric and size over the counts, in integer arithmetic; word {div} stands for integer division."""
    ratio = {k: f"CASE WHEN {{m}}{b} > 0 THEN least({GRID}, ({{m}}{a} * {times}) {{div}} greatest({{m}}{b}, 1)) ELSE 0 END" for k, (a, b, times) in METRICS.items()}
    return ratio | {f"size:{k}": f"least({GRID}, {{m}}{k} {{div}} {unit})" for k, unit in SIZES.items()}


def _bucket(k: str) -> Column:
    return F.expr(_buckets()[k].format(m="_m.", div="div")).cast("bigint")


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n): the mergeable sketches. A (lang, source) pair adds its counts before the shuffle."""
    each = F.array(*[F.struct(F.lit(k).alias("metric"), _bucket(k).alias("bucket")) for k in _buckets()])
    return measured.select("lang", "source", F.explode(each).alias("e")).groupBy("lang", "source", "e.metric", "e.bucket").agg(F.count("*").alias("n"))


LEVELS = {"q25": 25, "q50": 50, "q75": 75}


def _quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """total and quartiles of each group of sketches, merged by adding counts."""
    merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    w = W.partitionBy(*keys, "metric")
    ranked = merged.withColumn("upto", F.sum("n").over(w.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(w))
    at = [F.min(F.when(F.col("upto") * 100 >= F.col("total") * q, F.col("bucket"))).cast("double").alias(k) for k, q in LEVELS.items()]
    return ranked.groupBy(*keys, "metric").agg(F.max("total").cast("double").alias("total"), *at)


def _drawn(own: str, parent: str) -> str:
    """SQL of a quartile drawn towards the parent's; {k} is the quartile."""
    return f"(({own}.total * {own}.{{k}} + {PRIOR_DOCS} * {parent}) / ({own}.total + {PRIOR_DOCS}))"


_SHRUNK = _drawn("f", _drawn("m", "c.{k}"))


def _fence(metric: str, own: str, size: str) -> str:
    """SQL of a fence; {own}, {size} name the columns of the quartiles, as q25 etc."""
    spread = f"({own}q75 - {own}q25)"
    if metric in TRIALS:
        trials = f"({size}q50 * {TRIALS[metric][1]} + 1)"
        rate = f"(({own}q50 / {GRID} * {trials} + 1) / ({trials} + 2))"
        spread = f"({spread} + {GRID} * sqrt({rate} * (1 - {rate}) / {trials}))"
    return f"({own}q75 + {FENCE} * {spread} + 1)"


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row for each (lang, source): a struct of the metrics' fences."""
    f, m, c = _quartiles(sketch, ["lang", "source"]).alias("f"), _quartiles(sketch, ["lang"]).alias("m"), _quartiles(sketch, []).alias("c")
    # c has a row for each metric: eight rows at any size
    joined = f.join(m, F.expr("f.lang <=> m.lang and f.metric = m.metric")).join(F.broadcast(c), F.expr("f.metric = c.metric"))
    drawn = F.struct(*[F.expr(_SHRUNK.format(k=k)).alias(k) for k in LEVELS])
    groups = joined.groupBy(F.col("f.lang").alias("_lang"), F.col("f.source").alias("_source")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("f.metric"), drawn.alias("v")))).alias("_q"))
    fences = [F.expr(_fence(k, f"_q['{k}'].", f"_q['size:{TRIALS[k][0]}']." if k in TRIALS else "")).alias(k) for k in METRICS]
    return groups.select("_lang", "_source", F.struct(*fences).alias("_fences"))


def judge(docs: DataFrame) -> DataFrame:
    """docs with _m (counts), _fences, _base_failed and _kept; every row of docs appears once.

    The counts, by far the dearest part, are made once and written with the rows that come with them.
    """
    measured = written(measure(docs), "measured")
    limits = thresholds(sketches(measured))
    # A hot (lang, source) is no skew here: AQE broadcasts limits when small, else splits the hot partition.
    judged = measured.join(limits, F.expr("lang <=> _lang and source <=> _source"), "left")
    within = F.lit(True)
    for k in METRICS:
        within = within & (_bucket(k) <= F.col("_fences")[k])
    m = F.col("_m")
    failed = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
    return judged.withColumn("_base_failed", failed).withColumn("_kept", ~failed & F.coalesce(within, F.lit(True))).drop("_lang", "_source")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    m = F.col("_m")
    return d.select("doc_id", *[m[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def _sql_quartiles(keys: str) -> str:
    over = f"PARTITION BY {keys}, metric" if keys else "PARTITION BY metric"
    k = f"{keys}, " if keys else ""
    at = ", ".join(f"CAST(min(CASE WHEN upto * 100 >= total * {q} THEN bucket END) AS DOUBLE) AS {name}" for name, q in LEVELS.items())
    return f"""SELECT {k}metric, CAST(max(total) AS DOUBLE) AS total, {at}
 FROM (SELECT {k}metric, bucket, sum(n) OVER ({over} ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER ({over}) AS total
       FROM (SELECT {k}metric, bucket, sum(n) AS n FROM sk GROUP BY ALL)) GROUP BY {k}metric"""


_SQL_FENCE = "CASE s.metric " + " ".join(f"WHEN '{k}' THEN {_fence(k, 's.', 'z.')}" for k in METRICS) + " END"
_SQL_SIZE = "CASE s.metric " + " ".join(f"WHEN '{k}' THEN 'size:{size}'" for k, (size, _) in TRIALS.items()) + " END"

OP10_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT id, i, array_to_string(list_slice(words, i, i + {WINDOW - 1}), ' ') AS k
  FROM (SELECT id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) >= {WINDOW})),
rep AS (SELECT id, count(DISTINCT i + o) AS n FROM (SELECT id, i, count(*) OVER (PARTITION BY id, k) AS c FROM win), (SELECT unnest(range(0, {WINDOW})) AS o) WHERE c > 1 GROUP BY id),
m AS (SELECT w.id, doc_id, lang, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(lines) AS n_lines,
  length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals FROM w LEFT JOIN rep ON rep.id = w.id),
u AS ({" UNION ALL ".join(f"SELECT id, lang, source, '{k}' AS metric, {v.format(m='', div='//')} AS bucket FROM m" for k, v in _buckets().items())}),
sk AS (SELECT lang, source, metric, bucket, count(*) AS n FROM u GROUP BY ALL),
f AS ({_sql_quartiles("lang, source")}), m1 AS ({_sql_quartiles("lang")}), c AS ({_sql_quartiles("")}),
s AS (SELECT f.lang, f.source, f.metric, {", ".join(_SHRUNK.format(k=k) + f" AS {k}" for k in LEVELS)}
  FROM f JOIN m1 AS m ON f.lang IS NOT DISTINCT FROM m.lang AND f.metric = m.metric JOIN c ON c.metric = f.metric),
lim AS (SELECT s.lang, s.source, s.metric, {_SQL_FENCE} AS fence
  FROM s LEFT JOIN s AS z ON s.lang IS NOT DISTINCT FROM z.lang AND s.source IS NOT DISTINCT FROM z.source AND z.metric = {_SQL_SIZE}),
bad AS (SELECT DISTINCT u.id FROM u JOIN lim ON u.lang IS NOT DISTINCT FROM lim.lang AND u.source IS NOT DISTINCT FROM lim.source AND u.metric = lim.metric WHERE u.bucket > lim.fence)
SELECT m.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND bad.id IS NULL AS kept
FROM m LEFT JOIN bad ON bad.id = m.id
"""
