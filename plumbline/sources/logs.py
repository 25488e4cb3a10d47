"""Logs of JSON lines, read strictly: a file may end in a line that was cut off, and nothing else in it may be broken.

Which line is a file's last is told by the place of its split in the file, from ``_metadata``, and by its place in the split, so
one row of a file is kept while it is scanned and files are split as usual. Blank lines are skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line, place (start of the split and place in it), kind: object, other (JSON that is no object) or broken."""
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row")).alias("place"), F.trim("value").alias("line")
    )
    parsed = F.try_parse_json("line").isNotNull()
    kind = F.when(~parsed, "broken").when(F.col("line").startswith("{"), "object").otherwise("other")
    return rows.where("line <> ''").withColumn("kind", kind)


def report(spark: SparkSession, path: str) -> DataFrame:
    """file, records, broken, others, tail (whether the last line is broken), fatal."""
    bad = F.col("kind") == "broken"
    counts = lines(spark, path).groupBy("file").agg(
        F.count_if(F.col("kind") == "object").alias("records"), F.count_if(bad).alias("broken"), F.count_if(F.col("kind") == "other").alias("others"), F.max(F.struct("place", bad.alias("bad"))).alias("last")
    )
    tail = F.col("last.bad")
    return counts.select("file", "records", "broken", "others", tail.alias("tail"), ((F.col("others") > 0) | (F.col("broken") > tail.cast("int"))).alias("fatal"))


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of the files, typed; a ValueError names files that hold a broken line before their last, or a line that is no object."""
    if found := report(spark, path).where("fatal").limit(3).collect():
        raise ValueError("broken logs: " + ", ".join(f"{r['file']} ({r['broken']} broken lines, {r['others']} that are no objects)" for r in found))
    return lines(spark, path).where("kind = 'object'").select(F.from_json("line", schema).alias("r")).select("r.*")
