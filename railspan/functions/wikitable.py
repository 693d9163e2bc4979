"""Stopping patterns read from the station tables of wiki pages; array expressions in one row, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds in order of search, marks and the table's heading that results must equal.
KINDS = ["快速特急", "通勤快急", "通勤特快", "通勤快速", "通勤急行", "通勤準急", "区間急行", "区間快速", "区間準急", "新快速", "快速急行", "直通特急", "特急", "急行", "準急", "快速"]
STOPS, PASSES = "●○▲△◎☆", "｜|↑↓∥∨∧ーレ"
HEADING = r"(?m)^==+\s*駅一覧\s*==+"

STYLE = r'^[a-z-]+\s*=\s*"'


def table_text(page: Column) -> Column:
    """The first table after the heading; null without heading or table. An unclosed table ends with the page."""
    after = F.get(F.split(page, HEADING, 2), F.lit(1))
    inside = F.regexp_extract(after, r"(?s)(\{\|.*?)(?:\n\|\}|\z)", 1)
    return F.when(inside != "", inside)


def cells(row: Column) -> Column:
    """A row's cells without style attributes."""
    raw = F.filter(F.transform(F.split(F.concat(F.lit("\n"), F.trim(row)), r"\n[!|]|\|\|"), lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")), lambda c: c != "")
    return F.transform(raw, lambda c: F.when(c.rlike(STYLE), F.trim(F.coalesce(F.get(F.split(c, r'"\s*\|', 2), F.lit(1)), F.lit("")))).otherwise(c))


def _kind(cell: Column) -> Column:
    upright = F.regexp_extract(cell, r"\{\{縦書き\|([^|}]+)", 1)
    text = F.trim(F.regexp_replace(F.when(upright != "", upright).otherwise(cell), r"<[^>]+>|\[\[|\]\]|\{\{|\}\}", ""))
    return F.regexp_extract(text, "^(" + "|".join(KINDS) + ")", 1)


def header_kinds(row: Column) -> Column:
    """Kinds of service that a row's cells begin with."""
    return F.filter(F.transform(cells(row), _kind), lambda k: k != "")


def station_of(cell: Column) -> Column:
    """The linked station of a cell; empty without one."""
    link = r"\[\[([^\]|]+?)(?:\|([^\]]+))?\]\]"
    label = F.regexp_extract(cell, link, 2)
    name = F.trim(F.when(label != "", label).otherwise(F.regexp_extract(cell, link, 1)))
    return F.when(name.endswith("駅"), name).otherwise("")


def _marked(cell: Column) -> Column:
    return F.when((F.length(cell) == 1) & F.instr(F.lit(STOPS + PASSES), cell).between(1, len(STOPS + PASSES)), 1).otherwise(0)


def _best_start(marks: Column, width: Column) -> Column:
    """Where the window of most marks begins, the first on ties."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(marks) - width, F.lit(0)))
    full = lambda s: F.aggregate(F.slice(marks, s + 1, width), F.lit(0), lambda a, x: a + x)
    return -F.array_max(F.transform(starts, lambda s: F.struct(full(s).alias("n"), (-s).alias("at"))))["at"]


def stopping_patterns(pages: DataFrame, title: str, text: str) -> DataFrame:
    """(title, kind, column, pos, station): the stations each kind stops at, in table order.

    The header is the first of four rows that names two kinds or more. Columns are kept apart by place, as two may begin with the
    same kind. A row with two marks too few is no station row.
    """
    d = pages.select(title, table_text(F.col(text)).alias("_t")).where("_t is not null").withColumn("_rows", F.split("_t", r"\n\|-"))
    heads = F.filter(F.transform(F.slice("_rows", 1, 4), header_kinds), lambda k: F.size(k) >= 2)
    d = d.withColumn("_kinds", F.get(heads, F.lit(0))).where("_kinds is not null")
    d = d.select(title, "_kinds", F.size("_kinds").alias("_w"), F.posexplode("_rows").alias("pos", "_row")).withColumn("_c", cells(F.col("_row")))
    d = d.withColumn("station", F.get(F.filter(F.transform("_c", station_of), lambda s: s != ""), F.lit(0))).where("station is not null")
    d = d.withColumn("_m", F.transform("_c", _marked)).where(F.aggregate("_m", F.lit(0), lambda a, x: a + x) >= F.col("_w") - 2)
    d = d.withColumn("_win", F.slice("_c", _best_start(F.col("_m"), F.col("_w")) + 1, F.col("_w"))).where(F.size("_win") == F.col("_w"))
    d = d.select(title, "pos", "station", "_kinds", F.posexplode("_win").alias("column", "_mark")).where((F.length("_mark") == 1) & (F.instr(F.lit(STOPS), F.col("_mark")) > 0))
    return d.select(title, F.get("_kinds", F.col("column")).alias("kind"), "column", "pos", "station")
