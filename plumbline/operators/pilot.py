"""Finalizing annotation pilots: manifest, submissions, amendments and adjudications reconciled in one grouped pass over tasks, with typed failures and a verdict for each pilot.

Frames, each with the column pilot:

- manifest: task, first, second (the assigned annotators), content (hash of what is shown), instructions (hash).
- submissions: id, task, annotator, label, content, instructions, payload (JSON as delivered).
- amendments: original (a submission), amendment, previous (null for the first), label.
- adjudications: id, task, adjudicator, first_id, second_id (the records it decided on: a submission, or the amendment that stands for it), label.

A pilot's tasks and records are joined and grouped by task, so none is brought together in a task of Spark; a pilot without a manifest has no verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.nested import private_nodes
from plumbline.operators.annotation import amendment_tips, chain_violations

LABELS = ("answerable", "unanswerable", "ambiguous")
#: Agreement that a pilot needs.
THRESHOLD = 0.7
VERDICTS = ("BLOCKED_PRIVACY", "BLOCKED_INTEGRITY", "BLOCKED_INCOMPLETE", "BLOCKED_UNRESOLVED_ADJUDICATION", "BLOCKED_LOW_IAA", "READY_FOR_HUMAN_FREEZE_REVIEW")


def effective(submissions: DataFrame, amendments: DataFrame) -> DataFrame:
    """submissions with the label of the amendment that no other follows, and record, the id of what stands."""
    tips = amendment_tips(amendments.select("original", "amendment", "previous"))
    last = tips.join(amendments.select("original", F.col("amendment").alias("tip"), F.col("label").alias("amended")), ["original", "tip"]).select(F.col("original").alias("id"), "tip", "amended")
    return submissions.join(last, "id", "left").withColumns({"label": F.coalesce("amended", "label"), "record": F.coalesce("tip", "id")}).drop("tip", "amended")


def tasks(manifest: DataFrame, standing: DataFrame, adjudications: DataFrame) -> DataFrame:
    """A row for each task: both records and labels, complete, disagreed, decided, final."""
    own = standing.join(manifest.select("pilot", "task", "first", "second"), ["pilot", "task"])
    side = lambda who, c: F.max(F.when(F.col("annotator") == F.col(who), F.col(c)))
    held = own.groupBy("pilot", "task").agg(*[side(w, c).alias(f"{w}_{c}") for w in ("first", "second") for c in ("label", "record")])
    decided = adjudications.groupBy("pilot", "task").agg(F.max("label").alias("decided"))
    rows = manifest.select("pilot", "task").join(held, ["pilot", "task"], "left").join(decided, ["pilot", "task"], "left")
    both = F.col("first_label").isNotNull() & F.col("second_label").isNotNull()
    rows = rows.withColumn("complete", both).withColumn("disagreed", F.coalesce(both & (F.col("first_label") != F.col("second_label")), F.lit(False)))
    return rows.withColumn("final", F.when(F.col("disagreed"), F.col("decided")).when(both, F.col("first_label")))


def failures(manifest: DataFrame, submissions: DataFrame, amendments: DataFrame, adjudications: DataFrame) -> DataFrame:
    """pilot, record, rule: whatever isn't bound to what it claims to be about."""
    plan = manifest.select("pilot", "task", "first", "second", F.col("content").alias("shown"), F.col("instructions").alias("told"), F.lit(True).alias("known"))
    twice = submissions.groupBy("pilot", "task", "annotator").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("pilot", "task", "annotator", F.lit(True).alias("twice"))
    s = submissions.join(plan, ["pilot", "task"], "left").join(twice, ["pilot", "task", "annotator"], "left")
    unknown = F.col("known").isNull()
    of_submission = {
        "unknown_task": unknown, "unassigned_annotator": ~unknown & ~F.coalesce((F.col("annotator") == F.col("first")) | (F.col("annotator") == F.col("second")), F.lit(False)), "wrong_content": ~unknown & ~F.col("content").eqNullSafe(F.col("shown")),
        "wrong_instructions": ~unknown & ~F.col("instructions").eqNullSafe(F.col("told")), "repeated_submission": F.coalesce("twice", F.lit(False)), "unknown_label": ~F.coalesce(F.col("label").isin(*LABELS), F.lit(False)),
    }
    where = submissions.select(F.col("id").alias("original"), "pilot")
    stray = amendments.join(where.select("original"), "original", "left_anti").select("pilot", F.col("amendment").alias("record"), F.lit("unknown_original").alias("rule"))
    chains = chain_violations(amendments.select("original", "amendment", "previous")).join(where, "original").select("pilot", F.col("original").alias("record"), F.col("violation").alias("rule"))
    standing = tasks(manifest, effective(submissions, amendments), adjudications).select("pilot", "task", "first_record", "second_record", "disagreed")
    several = adjudications.groupBy("pilot", "task").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("pilot", "task", F.lit(True).alias("several"))
    a = adjudications.join(plan, ["pilot", "task"], "left").join(standing, ["pilot", "task"], "left").join(several, ["pilot", "task"], "left")
    of_decision = {
        "unknown_task": unknown, "nothing_to_decide": ~unknown & ~F.coalesce("disagreed", F.lit(False)), "outdated_records": F.coalesce(F.col("disagreed"), F.lit(False)) & ~(F.col("first_id").eqNullSafe(F.col("first_record")) & F.col("second_id").eqNullSafe(F.col("second_record"))),
        "own_adjudicator": F.coalesce(F.col("adjudicator").isin(F.col("first"), F.col("second")), F.lit(False)), "repeated_adjudication": F.coalesce("several", F.lit(False)), "unknown_label": ~F.coalesce(F.col("label").isin(*LABELS), F.lit(False)),
    }
    told = lambda df, rules: df.select("pilot", F.col("id").alias("record"), F.explode(F.array_compact(F.array(*[F.when(bad, F.lit(n)) for n, bad in rules.items()]))).alias("rule"))
    same = manifest.where(F.col("first").eqNullSafe(F.col("second"))).select("pilot", F.col("task").alias("record"), F.lit("one_annotator").alias("rule"))
    planned = manifest.groupBy("pilot", "task").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("pilot", F.col("task").alias("record"), F.lit("repeated_task").alias("rule"))
    return told(s, of_submission).unionByName(told(a, of_decision)).unionByName(stray).unionByName(chains).unionByName(same).unionByName(planned)


def agreement(n: Column, agreed: Column, left: list[Column], right: list[Column]) -> tuple[Column, Column]:
    """Cohen's kappa and Krippendorff's alpha of n pairs, by how often each label is on either side; null without pairs."""
    raw = agreed / n
    chance = sum(a * b for a, b in zip(left, right, strict=True)) / (n * n)
    pooled = [a + b for a, b in zip(left, right, strict=True)]
    apart = 1 - sum(m * (m - 1) for m in pooled) / (2 * n * (2 * n - 1))
    kappa = F.when(chance < 1, (raw - chance) / (1 - chance)).when(n > 0, F.lit(1.0))
    return kappa, F.when(apart > 0, 1 - (1 - raw) / apart).when(n > 0, F.lit(1.0))


def finalize(manifest: DataFrame, submissions: DataFrame, amendments: DataFrame, adjudications: DataFrame, expected: int = 40, threshold: float = THRESHOLD) -> DataFrame:
    """pilot, tasks, completed, disagreed, adjudicated, kappa, alpha, private, failed, verdict: the first of VERDICTS that applies.

    ``expected`` is the least number of tasks of a pilot.
    """
    t = tasks(manifest, effective(submissions, amendments), adjudications)
    on = lambda c, x: F.count_if(F.col("complete") & (F.col(c) == x)).cast("double")
    sums = t.groupBy("pilot").agg(
        F.count(F.lit(1)).alias("tasks"), F.count_if("complete").alias("completed"), F.count_if("disagreed").alias("disagreed"), F.count_if(F.col("disagreed") & F.col("decided").isNotNull()).alias("adjudicated"),
        *[on("first_label", x).alias(f"_l{i}") for i, x in enumerate(LABELS)], *[on("second_label", x).alias(f"_r{i}") for i, x in enumerate(LABELS)],
    )
    sides = [[F.col(f"_{s}{i}") for i in range(len(LABELS))] for s in "lr"]
    n = F.nullif(F.col("completed").cast("double"), F.lit(0.0))
    kappa, alpha = agreement(n, n - F.col("disagreed"), *sides)
    private = private_nodes(submissions, "payload", "pilot").groupBy("pilot").agg(F.count(F.lit(1)).alias("private"))
    failed = failures(manifest, submissions, amendments, adjudications).groupBy("pilot").agg(F.count(F.lit(1)).alias("failed"))
    rows = sums.withColumns({"kappa": kappa, "alpha": alpha}).join(private, "pilot", "left").join(failed, "pilot", "left").fillna(0, ["private", "failed"])
    low = F.coalesce((F.col("kappa") < threshold) | (F.col("alpha") < threshold), F.lit(True))
    blocked = [F.col("private") > 0, (F.col("failed") > 0) | (F.col("tasks") < expected), F.col("completed") < F.col("tasks"), F.col("adjudicated") < F.col("disagreed"), low]
    verdict = F.lit(VERDICTS[-1])
    for bad, name in reversed([*zip(blocked, VERDICTS, strict=False)]):
        verdict = F.when(bad, F.lit(name)).otherwise(verdict)
    return rows.select("pilot", "tasks", "completed", "disagreed", "adjudicated", "kappa", "alpha", "private", "failed", verdict.alias("verdict"))
