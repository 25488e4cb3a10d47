"""Cutting the lineage of iterative jobs."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a key from which it is hot; a table has one hot key for each HOT of its rows at most.
HOT = 10_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a local master may go without, in a temporary folder."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "plumbline-checkpoints")
    return folder


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A new folder in the shared one, which goes when the block ends; what is to outlive it must be cut off in it."""
    path = f"{shared_folder(spark)}/plumbline-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def join_hot(rows: DataFrame, facts: DataFrame, key: str, count: str) -> DataFrame:
    """rows with the one row of facts that has their key, which ``count`` of them have; facts of hot keys are broadcast to their rows."""
    hot = facts.where(F.col(count) > HOT).drop(count)
    cool = facts.where(F.col(count) <= HOT).drop(count)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cool, key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)
