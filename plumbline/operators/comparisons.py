"""Comparisons of methods with each other: which runs stand for a method, which pairs are compared, in which tier, and what p-values come to in a tier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import stats as S

#: Metrics of a comparison and whether less is better.
DIRECTIONS = {"f1_at_2": False, "mean_average_precision": False, "ndcg_at_10": False, "sufficiency": True, "comprehensiveness": False}


def unique_runs(runs: DataFrame) -> DataFrame:
    """split, method, is_control of methods with one run in a split; those with several can't be paired and go."""
    n = runs.groupBy("split", "method").agg(F.count(F.lit(1)).alias("n"), F.bool_or("is_control").alias("is_control"))
    return n.where("n = 1").drop("n")


def tier(candidate: Column, comparator: Column, confirmatory: tuple[str, str], exploratory: Sequence[str]) -> Column:
    planned = (candidate == confirmatory[0]) & (comparator == confirmatory[1])
    return F.when(planned, "confirmatory").when(candidate.isin(*exploratory), "exploratory").otherwise("secondary")


def pairs(runs: DataFrame, confirmatory: tuple[str, str], exploratory: Sequence[str], also: Sequence[str] = ("leave_one_out", "embedding")) -> DataFrame:
    """split, candidate, comparator, tier: every method that is no control against all controls and the methods ``also``. Methods are few, so splits are joined with themselves."""
    known = unique_runs(runs)
    a = known.where("NOT is_control").select("split", F.col("method").alias("candidate"))
    b = known.where(F.col("is_control") | F.col("method").isin(*also)).select("split", F.col("method").alias("comparator"))
    both = a.join(b, "split").where("candidate <> comparator")
    return both.withColumn("tier", tier(F.col("candidate"), F.col("comparator"), confirmatory, exploratory))


def compare(values: DataFrame, compared: DataFrame, replicates: int = 200) -> DataFrame:
    """split, tier, candidate, comparator, metric with the paired analysis of each cell, p (two-sided) and adjusted (by Holm within split and tier).

    values: split, method, qid, metric, value; null where a question isn't in a metric's subset. The arms of a question meet in one row, its
    methods, and each pair takes its difference there: nothing is joined with itself by question. Cells without pairs have no p.
    """
    few = F.broadcast(compared.groupBy("split").agg(F.collect_list(F.struct("candidate", "comparator", "tier")).alias("pairs")))  # a list of methods' pairs for each split
    held = values.groupBy("split", "qid", "metric").agg(F.map_from_entries(F.collect_list(F.struct("method", "value"))).alias("by")).join(few, "split")
    held = held.select("split", "qid", "metric", "by", F.explode("pairs").alias("pair")).where(F.map_contains_key("by", F.col("pair.candidate")) & F.map_contains_key("by", F.col("pair.comparator")))
    cell = F.concat_ws("|", "split", "pair.tier", "pair.candidate", "pair.comparator", "metric")
    deltas = held.select(cell.alias("cell"), "qid", (F.element_at("by", F.col("pair.candidate")) - F.element_at("by", F.col("pair.comparator"))).alias("delta"))
    less = F.substring_index("cell", "|", -1).isin(*[m for m, low in DIRECTIONS.items() if low])
    judged = S.paired_analysis(deltas, "cell", less, replicates)
    judged = judged.withColumn("p", F.least(F.lit(1.0), 2 * (1 - F.greatest("p_above", "p_below")))).withColumn("family", F.substring_index("cell", "|", 2))
    adjusted = S.holm(judged.where("p IS NOT NULL"), "family", "cell", "p").select("cell", "adjusted")
    part = F.split("cell", "[|]")
    names = [part[i].alias(n) for i, n in enumerate(("split", "tier", "candidate", "comparator", "metric"))]
    return judged.join(adjusted, "cell", "left").select(*names, "n", "n_excluded", "mean", "low", "high", "p_above", "p_below", "excludes_zero", "favorable", "p", "adjusted")


#: Gains of which one is enough, losses that no guardrail may exceed, and the milliseconds that reranking may add (95th percentile).
GAINS = {"ndcg_at_5": 0.02, "complete_evidence_at_5": 0.02}
GUARDRAILS = {"answer_f1": -0.02, "citation_coverage": -0.02, "complete_evidence_at_5": -0.01, "attribution_f1_at_2": -0.02}
COST_MS = 250
STAGES = ("complete_retrieval", "complete_generation", "complete_attribution")


def decision_gates(measured: DataFrame, formal: str = "eval") -> DataFrame:
    """measured with quality_met, guardrails_met, formal, quality_gate, guardrail_gate, cost_gate and retain.

    measured has a row for each split: the deltas named in GAINS and GUARDRAILS, p95 and the STAGES. A missing delta is no gain and breaks no
    guardrail. Gates of an incomplete experiment are null; the cost gate, and so whether reranking is retained, is for the split ``formal`` alone.
    Deltas are compared at nine digits, so that the order of a sum doesn't decide.
    """
    whole, quality, guarded = F.lit(True), F.lit(False), F.lit(True)
    for stage in STAGES:
        whole = whole & F.coalesce(F.col(stage), F.lit(False))
    for c, least in GAINS.items():
        quality = quality | (F.round(F.coalesce(F.col(c), F.lit(0.0)), 9) >= least)
    for c, least in GUARDRAILS.items():
        guarded = guarded & F.coalesce(F.round(F.col(c), 9) >= least, F.lit(True))
    is_formal = (F.col("split") == formal) & whole
    cost = F.when(is_formal, F.col("p95") <= COST_MS)
    rows = measured.withColumns({"quality_met": quality, "guardrails_met": guarded, "formal": is_formal, "cost_gate": cost})
    rows = rows.withColumns({"quality_gate": F.when(whole, F.col("quality_met")), "guardrail_gate": F.when(whole, F.col("guardrails_met"))})
    return rows.withColumn("retain", F.when(F.col("cost_gate").isNotNull(), F.col("quality_met") & F.col("guardrails_met") & F.col("cost_gate")))
