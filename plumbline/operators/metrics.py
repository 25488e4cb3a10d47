"""Retrieval metrics over rankings that are joined with gold labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_gold(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    marks = gold.select("pid", F.lit(True).alias("is_gold"))
    return ranked.join(marks, "pid", "left").withColumn("is_gold", F.coalesce("is_gold", F.lit(False)))


def recall_at(k: int) -> Column:
    return F.count_if(F.col("is_gold") & (F.col("rank") <= k)) / F.count_if(F.col("is_gold"))


def reciprocal_rank() -> Column:
    return F.coalesce(1.0 / F.min(F.when(F.col("is_gold"), F.col("rank"))), F.lit(0.0))


def ndcg_at(k: int) -> Column:
    gain = F.sum(F.when(F.col("is_gold") & (F.col("rank") <= k), 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0))
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.least(F.count_if(F.col("is_gold")), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0)
    )
    return gain / ideal


def covered_at(k: int) -> Column:
    """Whether all gold passages are among the first k."""
    return F.bool_and(F.when(F.col("is_gold"), F.col("rank") <= k))


def average_precision() -> Column:
    """Needs hits, the gold passages up to this rank."""
    return F.sum(F.when(F.col("is_gold"), F.col("hits") / F.col("rank")).otherwise(0.0)) / F.count_if(F.col("is_gold"))


def nearest_rank(c: str, p: float) -> Column:
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {c})")


def per_question(marked: DataFrame, ks=(2, 5, 10)) -> DataFrame:
    return marked.groupBy("qid").agg(
        *[recall_at(k).alias(f"recall_at_{k}") for k in ks], reciprocal_rank().alias("mrr"), ndcg_at(10).alias("ndcg_at_10"),
        covered_at(5).alias("covered_at_5"),
    )


PARTS = ("mean", "p50", "p95")


def percentile_struct(c: str) -> Column:
    """mean, p50 and p95 of a group; null in a group without values."""
    return F.when(F.count(c) > 0, F.struct(F.avg(c).alias("mean"), nearest_rank(c, 0.5).alias("p50"), nearest_rank(c, 0.95).alias("p95")))


def combine_percentiles(left: Column, right: Column, by: Callable[[Column, Column], Column]) -> Column:
    """``by`` part for part; null if either side, or any part of it, is missing."""
    whole = F.lit(True)
    for part in PARTS:
        whole = whole & left[part].isNotNull() & right[part].isNotNull()
    return F.when(whole, F.struct(*[by(left[p], right[p]).alias(p) for p in PARTS]))


def constant_percentiles(value) -> Column:
    v = value if isinstance(value, Column) else F.lit(value)
    return F.struct(*[v.cast("double").alias(p) for p in PARTS])
