"""What the corpus operators share: reading tables, cutting lineage, word patterns."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a local master may go without, in a temporary folder."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = os.path.join(tempfile.gettempdir(), "plumbline-checkpoints")
    return found


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


@contextmanager
def written(df: DataFrame) -> Iterator[DataFrame]:
    """df as a table in the shared folder, for as long as the block lasts; what is to outlive it must be materialized in it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/plumbline-{uuid.uuid4().hex}"
    try:
        df.write.parquet(path)
        yield spark.read.parquet(path)
    finally:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def slices(batches: Iterator[pd.DataFrame], column: str, rows: int = 512, size: int = 2 << 20) -> Iterator[pd.DataFrame]:
    """The batches in parts of at most ``rows`` rows and about ``size`` characters or bytes of ``column``; a longer row is alone."""
    for batch in batches:
        start = held = 0
        for at, x in enumerate(batch[column]):
            n = len(x) if isinstance(x, str | bytes | bytearray) else 0
            if at > start and (at - start >= rows or held + n > size):
                yield batch.iloc[start:at]
                start, held = at, 0
            held += n
        if start < len(batch):
            yield batch.iloc[start:]


def arrow_slices(batches: Iterator[pa.RecordBatch], column: str, rows: int = 256, size: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Parts of Arrow batches with the values of ``column``, as ``slices`` makes them: of a batch only one part is Python's at a time."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for at, n in enumerate(lengths.tolist()):
            if at > start and (at - start >= rows or held + n > size):
                part = batch.slice(start, at - start)
                yield part, part[column].to_pylist()
                start, held = at, 0
            held += n
        if start < batch.num_rows:
            part = batch.slice(start)
            yield part, part[column].to_pylist()


def lower_ascii(column):
    """A-Z alone in lower case, whatever the locale; texts of ASCII alone take the shorter way."""
    text = F.col(column) if isinstance(column, str) else column
    return F.when(text.rlike(r"^\p{ASCII}*$"), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
