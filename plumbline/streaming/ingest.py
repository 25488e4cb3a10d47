"""Append logs as streams: tolerant reading, duplicates dropped, the latest record of a key kept in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of JSON lines; a line that can't be parsed comes as _bad, with nulls beside it."""
    return spark.readStream.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)


def latest(records: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """One row for each key, that of the greatest sequence number; arrival order has no say."""
    rest = [c for c in records.columns if c not in keys]
    best = records.groupBy(*keys).agg(F.max_by(F.struct(*rest), sequence).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def counts_by_window(events: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Records of each type in tumbling windows; rows later than the watermark are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("start"), "event_type", "n"
    )


def ingest(stream: DataFrame, keys: list[str], sequence: str, target: str, checkpoint: str):
    """Drain what has arrived into Parquet batches under target; read them back through ``latest``."""

    def put(batch: DataFrame, number: int) -> None:
        latest(batch.where("_bad IS NULL").drop("_bad"), keys, sequence).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
