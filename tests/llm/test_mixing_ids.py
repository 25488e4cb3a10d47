"""Mixing rows without an id, and rows that share one."""

from collections import Counter

from pyspark.sql import functions as F

from plumbline.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def taken(spark, rows, parts):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    own = {r["own"]: r["text"] for r in df.select(F.xxhash64("text").alias("own"), "text").collect()}
    return Counter((r["doc_id"], own[r["own"]], r["taken"]) for r in mixing.mix(df).collect())


def test_rows_without_an_id_are_spread_and_reruns_agree(spark):
    rows = [(None, f"word{i} and more", ["a", None][i % 2]) for i in range(300)] + [(i % 5, f"text {i} of five", "b") for i in range(50)]
    first = taken(spark, rows, 3)
    assert first == taken(spark, rows[::-1], 7) and sum(first.values()) == 350
    assert 0 < sum(k[2] for k in first if k[0] is None and k[2]) and all(k[2] <= 2 * len(k[1].split()) for k in first)
