"""Rounds until nothing changes, with the lineage cut after each."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share. A local master without one gets a folder of its own; a cluster without one is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="railspan-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and its size is known to later joins."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/railspan/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(table: DataFrame) -> None:
    """Delete a table of cut() that no later plan reads."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._scratch)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fixpoint(state: DataFrame, step: Callable[[DataFrame], DataFrame], most_rounds: int, moved: str = "moved", keep_moved: bool = False, strict: bool = True) -> DataFrame:
    """step gives the next state with a boolean column that marks changed rows; ends when none is.

    After most_rounds it fails if strict, else the rounds are a limit of the caller's own. keep_moved hands the mark to the next step.
    """
    before = None
    for _ in range(most_rounds):
        new = cut(step(state))
        if before is not None:
            discard(before)
        before, state = new, new if keep_moved else new.drop(moved)
        if new.where(moved).isEmpty():
            return new.drop(moved)
    if strict:
        raise RuntimeError(f"rows still change after {most_rounds} rounds")
    return state.drop(moved)
