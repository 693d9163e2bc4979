"""Corpus pipeline: quality rules, toxicity, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a table: the rows of docs that it keeps with the columns of
documents, the last one the packing plan. Rows that a stage keeps are untouched, extra columns included, whatever
their names. Null and empty texts fail the quality rules. An empty table passes through as an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railspan.llm import mixing, near_dedup, packing, quality_rules, toxicity
from railspan.llm.common import small_batches, written

#: Share of the tokens that mixing keeps, on average.
MIX_FRACTION = 0.8
_USED = ("doc_id", "text", "lang", "source")


def _kept(docs: DataFrame, decide: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that decide() leaves. It sees the four columns that operators use; all others travel in one struct, out of reach of clashing names."""
    rest = [c for c in docs.columns if c not in _USED]
    carried = [F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_rest")] if rest else []
    left = decide(docs.select(*_USED, *carried))
    return left.select(*[F.col(c) if c in _USED else F.col("_rest").getField(c).alias(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay that pass the base rule and their group's fences; null and empty texts and texts under 20 words go. Repeated rows are judged alike."""
    return _kept(docs, lambda d: quality_rules.judge(d).where("_kept"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the threshold stay; the model learns from the labels of sf_dir that training may see. Null and empty texts and all texts without a model stay."""
    small_batches(spark)
    model = toxicity.train(docs, toxicity.labelled(spark, sf_dir, "toxic", 4, 2))
    return _kept(docs, lambda d: toxicity.score(d, model).where(F.col("_score") < toxicity.THRESHOLD))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of least doc_id: five-word shingles, similarity of 0.8 or more.

    Repeated rows are copies too. Texts without words stay.
    """
    return _kept(docs, lambda d: near_dedup.one_of_each(d, k=5, percent=80))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by the raked weights stay; null lang or source is a value of its own, repeated rows are drawn alike."""
    return _kept(docs, lambda d: mixing.mix(d, fraction=MIX_FRACTION).where("_drawn"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packing plan of every row: null texts are one end id, repeated rows are packed once each."""
    import public_tokenizers

    small_batches(spark)
    return packing.pack(written(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), 0), "pieces"))


STAGES = [
    ("quality_rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_dedup", dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The toxicity model, the register sketches and the packing plan have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
