"""Caches of computed values as append-only tables: misses are computed in one batch, the last write of a key counts.

A cache is a folder of commits, ``batch=1``, ``batch=2`` and so on, each a Parquet folder that counts once its job has
succeeded. A run that dies leaves a commit that doesn't count; the next one computes those keys again under a new number. Values
of different identities (a model and its revision, say) never mix: a cache that holds another identity is refused.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def commits(spark: SparkSession, path: str) -> tuple[list[int], int]:
    """Numbers of the commits that count, in order, and the next free number."""
    folder, fs = _folder(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    found = sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))
    return [n for n in found if fs.exists(_folder(spark, f"{path}/batch={n}/_SUCCESS")[0])], max(found, default=0) + 1


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """key, identity, value and batch of all commits that count; None where there are none."""
    numbers, _ = commits(spark, path)
    if not numbers:
        return None
    return spark.read.option("basePath", path).parquet(*[f"{path}/batch={n}" for n in numbers])


def latest(rows: DataFrame) -> DataFrame:
    """key, value: the last write of each key. A commit has a key once."""
    return rows.groupBy("key").agg(F.max_by("value", "batch").alias("value"))


def identity_conflicts(rows: DataFrame, identity: str) -> DataFrame:
    """Identities other than the one asked for, with how many values they have."""
    return rows.where(~F.col("identity").eqNullSafe(F.lit(identity))).groupBy("identity").agg(F.count(F.lit(1)).alias("n"))


def get_or_compute(requests: DataFrame, path: str, identity: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """requests with value and hit, by their column key.

    ``compute`` gets one row of requests for each key that the cache lacks and gives key and value; what it gives is committed before
    this returns. A key that it doesn't give, or gives twice, is an error, and nothing is committed then. Requests may repeat keys; a null key is an error.
    """
    spark = requests.sparkSession
    if requests.where("key IS NULL").limit(1).count():
        raise ValueError("a request has no key")
    _, number = commits(spark, path)
    rows = stored(spark, path)
    known = None
    if rows is not None:
        if mixed := identity_conflicts(rows, identity).limit(3).collect():
            raise ValueError(f"the cache holds values of {', '.join(str(r['identity']) for r in mixed)}, not only of {identity}")
        known = latest(rows)
    missing = requests.dropDuplicates(["key"])
    if known is not None:
        missing = missing.join(known.select("key"), "key", "left_anti")
    # written under a name that is no commit, and looked at before it becomes one
    draft, target = f"{path}/_draft-{number}", f"{path}/batch={number}"
    compute(missing).select("key", F.lit(identity).alias("identity"), "value").write.mode("overwrite").parquet(draft)
    folder, fs = _folder(spark, draft)
    made = spark.read.parquet(draft).groupBy("key").agg(F.count(F.lit(1)).alias("given"))
    both = missing.select("key", F.lit(True).alias("asked")).join(made, "key", "full_outer")
    n, wrong = both.agg(F.count(F.lit(1)), F.count_if(F.col("asked").isNull() | F.col("given").isNull() | (F.col("given") > 1))).first()
    if wrong or not n:
        fs.delete(folder, True)
    if wrong:
        raise ValueError(f"of {n} keys, {wrong} came without being asked for, more than once or not at all")
    if n and not fs.rename(folder, _folder(spark, target)[0]):
        raise OSError(f"{target} is taken: another run commits to the cache")
    values = latest(stored(spark, path)) if commits(spark, path)[0] else None
    if values is None:
        return requests.withColumns({"value": F.lit(None), "hit": F.lit(None).cast("boolean")})
    hit = known.select("key", F.lit(True).alias("hit")) if known is not None else requests.select("key", F.lit(True).alias("hit")).limit(0)
    return requests.join(values, "key").join(hit, "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
