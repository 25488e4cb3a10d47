"""Uncertainty, agreement and multiple-comparison statistics."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.functions.lineage import cut

Z95 = 1.959963984540054


def wilson(successes, n, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the score interval, null where n is 0."""
    c = lambda x: F.col(x).cast("double") if isinstance(x, str) else x.cast("double")
    k, m = c(successes), F.nullif(c(n), F.lit(0.0))
    p = k / m
    middle = (p + z * z / (2 * m)) / (1 + z * z / m)
    half = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / (1 + z * z / m)
    some = m.isNotNull()
    return F.when(some, F.greatest(F.lit(0.0), middle - half)), F.when(some, F.least(F.lit(1.0), middle + half))


def holm(tests: DataFrame, family: str, name: str, p: str) -> DataFrame:
    """adjusted: the step-down values within each family; ties by name."""
    order = W.partitionBy(family).orderBy(p, name)
    step = (F.count(F.lit(1)).over(W.partitionBy(family)) - F.row_number().over(order) + 1) * F.col(p)
    return tests.withColumn("_s", F.least(F.lit(1.0), step)).withColumn("adjusted", F.max("_s").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("_s")


def aligned(left: DataFrame, right: DataFrame, key: str = "qid", value: str = "value") -> DataFrame:
    """Full outer alignment: key, candidate, comparator, delta."""
    a = left.select(key, F.col(value).alias("candidate"))
    b = right.select(key, F.col(value).alias("comparator"))
    return a.join(b, key, "full_outer").withColumn("delta", F.col("candidate") - F.col("comparator"))


#: Shares of draws of a Poisson count of mean one that are below 1, 2, ...
POISSON = (0.36787944117, 0.73575888234, 0.91969860293, 0.98101184312, 0.99634015317, 0.99940581518, 0.99991675885, 0.99998975081, 0.99999887481)


def weights(keys: list[str | None], replicates: int) -> np.ndarray:
    """A row of Poisson counts for each key, a column for each replicate: four bytes each of the hashes of (boot, block, key)."""
    blocks = range((replicates - 1) // 8 + 1)
    hashes = b"".join(hashlib.sha256(f"boot:{b}{'' if k is None else f':{k}'}".encode()).digest() for k in keys for b in blocks)
    u = np.frombuffer(hashes, ">u4").reshape(len(keys), -1)[:, :replicates] / 2.0**32
    return np.searchsorted(POISSON, u, side="right").astype(float)


def replicate_means(units: DataFrame, group: str, key: str, total: str, count: str, replicates: int) -> DataFrame:
    """group, r, m: each replicate's mean, where every unit counts as often as its hash draws from Poisson's distribution.

    The weights are a row's own, so nothing is joined and sums are made before the shuffle: a row of each group and replicate comes out of a task, or of
    1000 groups of a batch.
    """
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    rows = units.select(F.col(group).alias("g"), F.col(key).cast("string").alias("k"), number(total).alias("s"), number(count).alias("c"))
    kind = rows.schema["g"].dataType.simpleString()

    def put(sums: dict) -> pa.RecordBatch:
        columns = [pa.array([g for g in sums for _ in range(replicates)], named), pa.array(list(range(replicates)) * len(sums), pa.int32())]
        return pa.record_batch([*columns, *(pa.array(np.concatenate([x[i] for x in sums.values()])) for i in (0, 1))], names=["g", "r", "s", "c"])

    named = to_arrow_schema(rows.schema).field("g").type

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for part in (batch.slice(at, 1024) for at in range(0, batch.num_rows, 1024)):
                keys = part["k"].to_pylist()
                known = {k: i for i, k in enumerate(dict.fromkeys(keys))}
                drawn, places = weights(list(known), replicates), np.array([known[k] for k in keys])
                values = np.stack([part["s"].to_numpy(), part["c"].to_numpy()])
                members: dict = {}
                for i, g in enumerate(part["g"].to_pylist()):
                    members.setdefault(g, []).append(i)
                for g, own in members.items():
                    sums[g] = sums.get(g, 0) + values[:, own] @ drawn[places[own]]
                if len(sums) > 1000:
                    yield put(sums)
                    sums = {}
        if sums:
            yield put(sums)

    drawn = rows.mapInArrow(draw, f"g {kind}, r int, s double, c double").groupBy(F.col("g").alias(group), "r").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
    return drawn.where("c > 0").select(group, "r", (F.col("s") / F.col("c")).alias("m"))


def interval(means: DataFrame, group: str, tolerance: float = 0.0) -> DataFrame:
    """group, low, high, p_above and p_below: the shares of replicates over the tolerance and under its negative."""
    end = lambda p: F.percentile("m", F.lit(p))
    share = lambda c: F.avg(c.cast("int"))
    return means.groupBy(group).agg(
        end(0.025).alias("low"), end(0.975).alias("high"), share(F.col("m") > tolerance).alias("p_above"), share(F.col("m") < -tolerance).alias("p_below")
    )


def hashed_bootstrap(deltas: DataFrame, group: str, replicates: int = 200, key: str = "qid", tolerance: float = 0.0) -> DataFrame:
    """group, n, n_excluded (rows without a difference), mean, low, high, p_above of paired differences (group, key, delta); reruns and engines agree."""
    deltas = cut(deltas.select(group, key, "delta"))  # read twice
    sizes = deltas.groupBy(group).agg(F.count("delta").alias("n"), F.count_if(F.col("delta").isNull()).alias("n_excluded"), F.avg("delta").alias("mean"))
    units = deltas.where("delta IS NOT NULL").withColumn("_one", F.lit(1))
    ends = interval(replicate_means(units, group, key, "delta", "_one", replicates), group, tolerance)
    return sizes.join(ends, group, "left").select(group, "n", "n_excluded", "mean", "low", "high", "p_above")


def paired_analysis(deltas: DataFrame, group: str, lower_is_better: Column, replicates: int = 200, key: str = "qid", tolerance: float = 1e-9) -> DataFrame:
    """group, n, n_excluded, mean, low, high, p_above, p_below, excludes_zero, favorable of the differences (group, key, delta) of each group.

    ``lower_is_better`` is a condition on the group. All groups are drawn in one pass; those without any difference have nulls.
    """
    deltas = cut(deltas.select(group, key, "delta"))  # read twice
    sizes = deltas.groupBy(group).agg(F.count("delta").alias("n"), F.count_if(F.col("delta").isNull()).alias("n_excluded"), F.avg("delta").alias("mean"))
    units = deltas.where("delta IS NOT NULL").withColumn("_one", F.lit(1))
    ends = interval(replicate_means(units, group, key, "delta", "_one", replicates), group, tolerance)
    above, below = F.col("low") > tolerance, F.col("high") < -tolerance
    judged = sizes.join(ends, group, "left").withColumn("excludes_zero", above | below).withColumn("favorable", F.when(lower_is_better, below).otherwise(above))
    return judged.select(group, "n", "n_excluded", "mean", "low", "high", "p_above", "p_below", "excludes_zero", "favorable")


#: Rows that a task of a join by parts takes.
PART_ROWS = 500_000


def join_in_parts(many: DataFrame, one: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """many with the row of ``one`` of its key, in a task for each ``rows`` rows; what is grouped by the key afterwards needs no shuffle.

    Short rows pack so well that, dealt by their shuffled bytes, millions of them share a task, whose sorts and hash tables grow with them.
    """
    parts = max(1, -(-many.count() // (rows or PART_ROWS)))
    if parts > 1:  # with fewer than the session's the join would deal them out anew
        parts = max(parts, int(many.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return many.repartition(parts, key).join(one.repartition(parts, key), key)


def cluster_bootstrap(observations: DataFrame, replicates: int = 200, tolerance: float = 0.0) -> DataFrame:
    """One row: n_clusters, n_parents, n_excluded, n_duplicates, n_split_parents, estimate, low, high, p_above.

    Observations (cluster_id, parent_id, variant, candidate, comparator) are averaged within parents; the estimate is the parents' mean, and
    clusters are drawn with all their parents. Repeated variants of a parent and parents in several clusters make the input invalid: they
    are counted, and the estimate and its interval are then null.
    """
    both = observations.withColumn("d", F.col("candidate") - F.col("comparator"))
    variants = both.groupBy("parent_id", "variant").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("d").isNull()).alias("without"))
    checks = variants.agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("n_duplicates"), F.coalesce(F.sum("without"), F.lit(0)).alias("n_excluded"))
    homes = both.groupBy("parent_id").agg((F.min("cluster_id") != F.max("cluster_id")).alias("split"))
    homes = homes.agg(F.count_if("split").alias("n_split_parents"))
    parents = both.where("d IS NOT NULL").groupBy("cluster_id", "parent_id").agg(F.avg("d").alias("d"))
    clusters = parents.groupBy("cluster_id").agg(F.sum("d").alias("s"), F.count(F.lit(1)).alias("c")).withColumn("one", F.lit(1))
    point = clusters.agg(F.count(F.lit(1)).alias("n_clusters"), F.coalesce(F.sum("c"), F.lit(0)).alias("n_parents"), (F.sum("s") / F.sum("c")).alias("estimate"))
    ends = interval(replicate_means(clusters, "one", "cluster_id", "s", "c", replicates), "one", tolerance).drop("one").agg(
        F.max("low").alias("low"), F.max("high").alias("high"), F.max("p_above").alias("p_above")
    )
    valid = (F.col("n_duplicates") == 0) & (F.col("n_split_parents") == 0)
    one = checks.join(homes).join(point).join(ends)  # four tables of one row
    return one.select(
        "n_clusters", "n_parents", "n_excluded", "n_duplicates", "n_split_parents", *[F.when(valid, F.col(c)).alias(c) for c in ("estimate", "low", "high", "p_above")]
    )


def linear_quantile(values: list[float], p: float) -> float:
    at = (len(values) - 1) * p
    k = int(at)
    return values[k] if k + 1 == len(values) else values[k] + (values[k + 1] - values[k]) * (at - k)


def seed_of(*parts: str) -> int:
    return int.from_bytes(hashlib.sha256(":".join(parts).encode()).digest()[:8], "big")


def seeded_bootstrap(deltas: DataFrame, group: str, replicates: int = 10_000, seed: str = "0") -> DataFrame:
    """As hashed_bootstrap, with the standard generator's stream of a seed derived from the group.

    A group is one evaluation cell, a bounded list of questions; cells run side by side.
    """

    def cell(x: pd.DataFrame) -> pd.DataFrame:
        values = x.sort_values("qid")["delta"].tolist()
        rng, n = random.Random(seed_of(seed, str(x[group].iloc[0]))), len(values)
        means = sorted(sum(values[rng.randrange(n)] for _ in range(n)) / n for _ in range(replicates))
        return pd.DataFrame({group: [x[group].iloc[0]], "n": [n], "mean": [sum(values) / n], "low": [linear_quantile(means, 0.025)], "high": [linear_quantile(means, 0.975)]})

    return deltas.select(group, "qid", "delta").groupBy(group).applyInPandas(cell, f"{group} string, n long, mean double, low double, high double")


def cluster_points(observations: DataFrame) -> DataFrame:
    """cluster_id, delta: variants averaged within parents, parents within clusters."""
    both = observations.where("candidate IS NOT NULL AND comparator IS NOT NULL").withColumn("d", F.col("candidate") - F.col("comparator"))
    return both.groupBy("cluster_id", "parent_id").agg(F.avg("d").alias("d")).groupBy("cluster_id").agg(F.avg("d").alias("delta"))


def nominal_agreement(pairs: DataFrame) -> DataFrame:
    """raw, kappa, alpha of label pairs (a, b); alpha also pools the labels of incomplete pairs."""
    full = pairs.where("a IS NOT NULL AND b IS NOT NULL")
    cells = full.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    n = cells.agg(F.sum("c").alias("n"), (F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)) / F.sum("c")).alias("raw"))
    side = cells.select(F.col("a").alias("label"), F.col("c").alias("l"), F.lit(0).cast("long").alias("r")).unionByName(
        cells.select(F.col("b").alias("label"), F.lit(0).cast("long").alias("l"), F.col("c").alias("r"))
    )
    chance = side.groupBy("label").agg((F.sum("l") * F.sum("r")).alias("x"), F.sum("l").alias("l")).agg((F.sum("x") / F.pow(F.sum("l"), F.lit(2))).alias("pe"))
    pooled = pairs.select(F.explode(F.array("a", "b")).alias("label")).where("label IS NOT NULL").groupBy("label").agg(F.count(F.lit(1)).alias("k"))
    pool = pooled.agg(F.sum("k").alias("total"), F.sum(F.col("k") * (F.col("k") - 1)).alias("same"))
    one = n.join(chance).join(pool)  # three tables of one row
    kappa = F.when(F.col("pe") < 1, (F.col("raw") - F.col("pe")) / (1 - F.col("pe")))
    expected = 1 - F.col("same") / (F.col("total") * (F.col("total") - 1))
    alpha = F.when(expected > 0, 1 - (1 - F.col("raw")) / expected).otherwise(F.lit(1.0))
    return one.select("n", "raw", kappa.alias("kappa"), alpha.alias("alpha"))


def family_agreement(left: Column, right: Column) -> tuple[Column, Column]:
    """Symmetric best-match Jaccard and F1 of two families of sets."""
    jac = lambda x, y: F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
    f1 = lambda x, y: 2 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))
    way = lambda a, b, s: F.aggregate(F.transform(a, lambda x: F.array_max(F.transform(b, lambda y: s(x, y)))), F.lit(0.0), lambda p, q: p + q) / F.size(a)
    return tuple((way(left, right, s) + way(right, left, s)) / 2 for s in (jac, f1))
