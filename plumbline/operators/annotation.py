"""Blind double annotation: chains of amendments, assignment and schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.functions.lineage import cut, join_hot
from plumbline.operators.ranking import place_by_hash


def amendment_tips(amendments: DataFrame) -> DataFrame:
    """original, tip: the amendment of each original that no other one follows. In: original, amendment, previous."""
    followed = amendments.where("previous IS NOT NULL").select("original", F.col("previous").alias("amendment")).distinct()
    return amendments.join(followed, ["original", "amendment"], "left_anti").select("original", F.col("amendment").alias("tip"))


def chain_violations(amendments: DataFrame) -> DataFrame:
    """original, violation: several heads, no head (a cycle), forks, links into another original's chain."""
    heads = amendments.groupBy("original").agg(F.count_if(F.col("previous").isNull()).alias("heads"))
    bad_heads = heads.where("heads <> 1").select("original", F.when(F.col("heads") == 0, "no_head").otherwise("several_heads").alias("violation"))
    forks = amendments.where("previous IS NOT NULL").groupBy("original", "previous").count().where("count > 1")
    forks = forks.select("original", F.lit("fork").alias("violation"))
    known = amendments.select("original", F.col("amendment").alias("previous"))
    stray = amendments.where("previous IS NOT NULL").join(known, ["original", "previous"], "left_anti").select("original", F.lit("unknown_predecessor").alias("violation"))
    return bad_heads.union(forks).union(stray).distinct()


def schedule(assignments: DataFrame) -> DataFrame:
    """annotator, task, position (from 0): each annotator's tasks so that two of one group stand apart where that is possible.

    In: annotator, task, group. The fullest group that isn't the last one's goes next, ties by hashes. That needs no walk through a list: a group of n tasks
    stands at the levels n to 1, and without a neighbour of its own group each goes in the order of (level downward, hash). Only the largest group
    can meet itself there. While it is ahead, it takes turns with the others in their order; after that the order holds. Numbers are counted in buckets
    of hashes, and over a row for each level of an annotator, so no task gets an annotator's whole list. A null group is a group.
    """
    seed = lambda *parts: F.sha2(F.concat_ws(":", *parts), 256)
    rows = cut(assignments.select(
        "annotator", "task", F.to_json(F.array("annotator")).alias("_a"), F.to_json(F.array("annotator", "group")).alias("_key"),
        seed(F.lit("schedule"), "task", "group").alias("_h"), seed(F.lit("group"), "group").alias("_g"),
    ))
    rows = place_by_hash(rows, "_h", "_key", out="level").withColumn("_key", F.to_json(F.array("_a", F.col("level").cast("string"))))
    rows = cut(place_by_hash(rows, "_g", "_key", out="_order").drop("_h"))
    levels = rows.groupBy("_a", "_key", "level").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy("_a").orderBy(F.desc("level")).rowsBetween(W.unboundedPreceding, -1))
    levels = levels.select("_key", F.coalesce(before, F.lit(0)).alias("_before"), "_n")
    rows = join_hot(rows, levels, "_key", "_n").withColumn("_order", F.col("_order") + F.col("_before"))
    top = rows.groupBy("_a").agg(F.min(F.struct((-F.col("level")).alias("m"), "_g")).alias("t"), F.count(F.lit(1)).alias("_all"))
    rows = join_hot(rows, top.select("_a", (-F.col("t.m")).alias("m"), F.col("t._g").alias("_big"), "_all", F.col("_all").alias("_c")), "_a", "_c")
    # number: among the largest group's tasks, or among those of the others
    big, earlier = F.col("_g") == F.col("_big"), F.col("_big") < F.col("_g")
    rows = rows.withColumn("_big_one", big).withColumn("number", F.when(big, F.col("m") - F.col("level") + 1).otherwise(F.col("_order") - F.col("m") + F.col("level") - earlier.cast("long")))
    left = F.col("m") - F.col("number") + 1  # tasks of the largest group when the turn is this other one's
    ahead = (left > F.col("level")) | ((left == F.col("level")) & earlier)
    rows = cut(rows.select("annotator", "task", "_a", "_order", "_big_one", "number", (big | ahead).alias("_ahead"), "_all", "m"))
    turns = rows.groupBy("_a").agg(F.coalesce(F.min(F.when(~F.col("_ahead"), F.col("number") - 1)), F.max(F.col("_all") - F.col("m"))).alias("turns"), F.max("_all").alias("_c"))
    rows = join_hot(rows, turns, "_a", "_c")
    n, t = F.col("number"), F.col("turns")
    turn = F.when(F.col("_big_one"), 2 * n - 2).otherwise(2 * n - 1)
    return rows.select("annotator", "task", F.when(n <= t, turn).otherwise(t + n - 1 + F.greatest(F.lit(0), F.col("_order") - n - t)).cast("long").alias("position"))


def schedule_apart(assignments: DataFrame, seed: str = "0") -> DataFrame:
    """annotator, task, position (from 0): no two tasks of one group are neighbours wherever that is possible. In: annotator, task, group.

    Tasks are numbered with groups one after the other, the largest first; the first half of the numbers goes to the even positions and the rest
    to the odd ones. Neighbours then are half of the list apart in number, which a group that isn't more than half never spans. Numbers within a group are counted
    in buckets of a hash, those of groups over a row for each group, so no task gets an annotator's whole list. Repeated rows are tasks of their own.
    """
    sizes = assignments.groupBy("annotator", "group").agg(F.count(F.lit(1)).alias("n"))
    own = W.partitionBy("annotator")
    by = F.sha2(F.concat_ws(":", F.lit(seed), "group"), 256)
    largest = F.row_number().over(own.orderBy(F.desc("n"), by, "group"))
    order = own.orderBy(F.when(F.col("_place") == 1, 0).otherwise(1), by, "group")
    starts = sizes.withColumn("_place", largest).withColumn("start", F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("all", F.sum("n").over(own)).drop("_place", "n")
    key = F.to_json(F.array("annotator", "group"))
    placed = place_by_hash(assignments.withColumn("_key", key).withColumn("_h", F.sha2(F.concat_ws(":", F.lit(seed), "task"), 256)), "_h", "_key")
    rows = placed.join(starts.select(F.to_json(F.array("annotator", "group")).alias("_key"), "start", "all"), "_key")
    number, half = F.col("start") + F.col("place") - 1, F.ceil(F.col("all") / 2)
    return rows.select("annotator", "task", F.when(number < half, 2 * number).otherwise(2 * (number - half) + 1).cast("long").alias("position"))


def adjacent(scheduled: DataFrame) -> DataFrame:
    """Rows whose group is that of the row before. In: annotator, position, group."""
    before = F.lag("group").over(W.partitionBy("annotator").orderBy("position"))
    return scheduled.withColumn("before", before).where("before = group").drop("before")


def normal_text(c: Column) -> Column:
    """Trimmed, single spaces, lower case; null is the empty text."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))


def normal_family(c: Column) -> Column:
    """A family of sets of ids in one order: ids within sets, then the sets."""
    return F.array_sort(F.transform(c, lambda ids: F.array_sort(ids)))


def disagreement_reasons(left: Column, right: Column) -> Column:
    """In order, what two records (label, answer, families, ambiguous, defect) differ in; empty where they agree."""
    differ = {
        "answerability": left["label"] != right["label"],
        "answer_text": normal_text(left["answer"]) != normal_text(right["answer"]),
        "evidence_sets": normal_family(left["families"]) != normal_family(right["families"]),
        "ambiguity": left["ambiguous"] != right["ambiguous"],
        "dataset_defect": left["defect"] != right["defect"],
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in differ.items()]))


def agreement_exclusion(left: Column, right: Column) -> Column:
    """Why a task whose records agree is left out of the analysis, by the first rule that holds; null if it stays."""
    either = lambda field: left[field] | right[field]
    partial = (left["exhaustive"] == F.lit(False)) | (right["exhaustive"] == F.lit(False))
    return (
        F.when(left["label"] == "unclear", "unclear human decision")
        .when(either("defect"), "dataset defect")
        .when(either("ambiguous"), "annotator-marked ambiguity")
        .when((left["label"] == "answerable") & partial, "non-exhaustive evidence")
    )
