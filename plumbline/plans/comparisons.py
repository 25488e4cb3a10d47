"""Attribution methods compared by tiers on five metrics, and the arms of reranking by the gates that decide on it."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.functions.lineage import cut
from plumbline.operators import attribution as A
from plumbline.operators import comparisons as C
from plumbline.operators import metrics as M
from plumbline.operators import models
from plumbline.operators import ranking as R
from plumbline.plans import attribution as P
from plumbline.plans import retrieval
from plumbline.plans.book import Book
from plumbline.plans.data import H, h
from plumbline.plans.experiments import judged
from plumbline.plans.text import CITED, F1_SQL
from plumbline.sources import fixture as V

book = Book()
QUERIES, ORACLES = book.queries, book.oracles
CONFIRMATORY, EXPLORATORY = ("leave_one_out", "control_lexical"), ("oracle_gold",)


def values(spark, sf):
    """split, method, qid, metric, value: agreement with gold over questions that were answered correctly, diagnostics over all."""
    agreement = P.method_metrics(spark, sf).join(P.correct_marks(spark, sf).select("qid", "correct"), "qid")
    f1 = F.coalesce(F.try_divide(2 * F.col("p2") * F.col("r2"), F.col("p2") + F.col("r2")), F.lit(0.0))
    found = {"f1_at_2": f1, "mean_average_precision": F.col("ap"), "ndcg_at_10": F.col("ndcg")}
    agreement = agreement.select("split", "method", "qid", *[F.when(F.col("correct"), c).alias(m) for m, c in found.items()])
    scores = P.rows(spark, sf).withColumn("w", A.get_method("leave_one_out").score())
    words = F.greatest(F.lit(1), F.size(F.filter(F.split("answer", " "), lambda x: x != "")))
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), A.get_method(m).score().alias("score")) for m in P.METHODS]))
    ranked = R.rank_by_score(scores.select("qid", "split", "idx", "w", words.alias("words"), each.alias("x")).select("qid", "split", "idx", "w", "words", "x.*"), ("qid", "method"))
    lost = lambda c: (F.sum("w") - F.sum(F.when(c, F.col("w")))) / F.max("words")
    lost_by = ranked.groupBy("split", "method", "qid").agg(lost(F.col("rank") <= 2).alias("sufficiency"), lost(F.col("rank") > 2).alias("comprehensiveness"))
    long = lambda df, names: df.unpivot(["split", "method", "qid"], names, "metric", "value")
    return long(agreement, [*found]).unionByName(long(lost_by, ["sufficiency", "comprehensiveness"]))


def method_runs(rows):
    """split, method, is_control of the runs: one each, and a second one of control_length on the split smoke."""
    runs = rows.select("split", "method").distinct().withColumn("is_control", F.col("method").startswith("control_"))
    return runs.unionByName(runs.where("split = 'smoke' AND method = 'control_length'"))


OK = ", ok AS (SELECT qid, coalesce(NOT failed AND NOT contains(lower(response), 'insufficient evidence') AND (em = 1 OR f1 >= 0.5), false) AS correct FROM sc), pa AS"


@book.add(F1_SQL + P.BASE.replace(", pa AS", OK, 1) + """, wl AS (SELECT rs.method, rs.qid, rs.rank, lo.w, lo.answer FROM rs JOIN lo USING (pid)),
fx AS (SELECT method, qid, (sum(w) - sum(w) FILTER (rank <= 2)) / greatest(1, len(list_filter(string_split(max(answer), ' '), lambda x: x <> ''))) AS suf,
  (sum(w) - sum(w) FILTER (rank > 2)) / greatest(1, len(list_filter(string_split(max(answer), ' '), lambda x: x <> ''))) AS com FROM wl GROUP BY ALL),
vl AS (SELECT mq.method, mq.qid, mq.split, metric, CASE metric WHEN 'sufficiency' THEN suf WHEN 'comprehensiveness' THEN com WHEN 'f1_at_2' THEN CASE WHEN correct THEN CASE WHEN p2 + r2 > 0 THEN 2 * p2 * r2 / (p2 + r2) ELSE 0 END END
  WHEN 'mean_average_precision' THEN CASE WHEN correct THEN ap END ELSE CASE WHEN correct THEN ndcg END END AS value
  FROM mq JOIN ok USING (qid) JOIN fx USING (method, qid), (VALUES ('f1_at_2'), ('mean_average_precision'), ('ndcg_at_10'), ('sufficiency'), ('comprehensiveness')) u(metric)),
ru AS (SELECT DISTINCT split, method, method LIKE 'control%' AS is_control FROM mq UNION ALL SELECT DISTINCT split, method, true FROM mq WHERE split = 'smoke' AND method = 'control_length'),
un AS (SELECT split, method, bool_or(is_control) AS is_control FROM ru GROUP BY split, method HAVING count(*) = 1),
prs AS (SELECT a.split, a.method AS candidate, b.method AS comparator, CASE WHEN a.method = 'leave_one_out' AND b.method = 'control_lexical' THEN 'confirmatory' WHEN a.method = 'oracle_gold' THEN 'exploratory' ELSE 'secondary' END AS tier
  FROM un a JOIN un b ON a.split = b.split AND a.method <> b.method WHERE NOT a.is_control AND (b.is_control OR b.method = 'leave_one_out')),
dl AS (SELECT prs.split || '|' || tier || '|' || candidate || '|' || comparator || '|' || x.metric AS cell, x.qid, x.value - y.value AS delta
  FROM prs JOIN vl x ON x.split = prs.split AND x.method = candidate JOIN vl y ON y.qid = x.qid AND y.metric = x.metric AND y.method = comparator)""" + judged("dl", "cell") + """,
p1 AS (SELECT *, least(1, 2 * (1 - greatest(p_above, p_below))) AS p, split_part(cell, '|', 1) || '|' || split_part(cell, '|', 2) AS family FROM jd),
p2 AS (SELECT cell, least(1, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, cell) + 1) * p) AS st, family, p FROM p1 WHERE p IS NOT NULL),
p3 AS (SELECT cell, max(st) OVER (PARTITION BY family ORDER BY p, cell ROWS UNBOUNDED PRECEDING) AS adjusted FROM p2)
SELECT split_part(cell, '|', 1) AS split, split_part(cell, '|', 2) AS tier, split_part(cell, '|', 3) AS candidate, split_part(cell, '|', 4) AS comparator, split_part(cell, '|', 5) AS metric, n, n_excluded, round(mean, 6) + 0 AS mean, round(low, 6) + 0 AS low, round(high, 6) + 0 AS high,
  favorable, round(p, 6)::DOUBLE AS p, round(adjusted, 6)::DOUBLE AS adjusted FROM p1 LEFT JOIN p3 USING (cell)""")
def comparison_tiers(spark, sf):
    rows = cut(values(spark, sf))  # read for the runs and for the values
    compared = C.pairs(method_runs(rows), CONFIRMATORY, EXPLORATORY)
    got = C.compare(rows, compared)
    return got.select("split", "tier", "candidate", "comparator", "metric", "n", "n_excluded", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("mean", "low", "high")], "favorable", F.round("p", 6).alias("p"), F.round("adjusted", 6).alias("adjusted"))


BASELINE, CANDIDATE = "hybrid_rrf", "hybrid_rrf_rerank"
#: Methods whose runs make an arm's attribution complete, by mode.
REQUIRED = {"gold": ("leave_one_out", "embedding", "control_random", "control_retrieval", "control_lexical", "control_length", "control_shuffled")}
REQUIRED["generated"] = (*REQUIRED["gold"], "citations")
RUNS = ", ".join(f"('{a}', '{mode}', '{m}')" for a in retrieval.METHODS for mode, ms in REQUIRED.items() for m in ms)
BARE = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(response, '\\[ *P\\d+(?:[,;/ ]+P\\d+)* *\\]', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g'), '^[ \\t\\n.,;:]+', ''), '[ \\t\\n.,;:]+$', '')"
SCORED = ",\n" + F1_SQL[F1_SQL.index("nn AS") :].rstrip().replace("FROM pr)", "FROM gs)").replace("tk AS", "tk2 AS").replace("FROM tk)", "FROM tk2)")
DELTAS = {"ndcg_at_5": "nd", "complete_evidence_at_5": "cv", "answer_f1": "af", "citation_coverage": "cc", "attribution_f1_at_2": "fa"}
MEASURED = retrieval.RANKED + f""", cx AS (SELECT mk.method, mk.qid, mk.pid, mk.rank, mk.is_gold, coalesce(title, '') AS title, coalesce(body, '') AS body FROM mk JOIN passages USING (pid) WHERE rank <= 5),
ng AS (SELECT qid, count(*) AS n_gold FROM gold GROUP BY qid),
gx AS (SELECT method, qid, arg_max(title, rank) || ' [P' || max(rank) || ']' AS response, sum(CASE WHEN is_gold THEN 1.0 / log2(rank + 1) ELSE 0 END) AS gain, count(*) FILTER (is_gold) AS top5 FROM cx GROUP BY ALL),
gs AS (SELECT la.method, la.qid, la.split, la.failed, la.latency_ms, n_gold, answer, gain / list_sum(list_transform(range(1, least(n_gold, 5) + 1), lambda i: 1.0 / log2(i + 1))) AS nd, (top5 = n_gold)::INT AS cv,
  CASE WHEN NOT la.failed THEN response END AS response, {BARE} AS said FROM la JOIN questions q ON q.qid = la.qid LEFT JOIN gx ON gx.method = la.method AND gx.qid = la.qid LEFT JOIN ng ON ng.qid = la.qid){SCORED},
sv AS (SELECT *, contains(lower(response), 'insufficient evidence') AS ab, {CITED} AS cited FROM sc),
pl AS (SELECT cx.method, cx.qid, is_gold, list_contains(cited, 'P' || rank) AS c, row_number() OVER (PARTITION BY cx.method, cx.qid ORDER BY round(CASE WHEN (title <> '' AND contains(lower(said), lower(title))) OR (said <> '' AND contains(lower(body), lower(said))) THEN 2.0
  ELSE 0.1 * {P.UNIT.format("'w:' || pid")} END::DOUBLE, 9) DESC, rank) AS place FROM cx JOIN sv ON sv.method = cx.method AND sv.qid = cx.qid WHERE response IS NOT NULL),
hp AS (SELECT method, qid, count(*) FILTER (c AND is_gold) AS hit, count(*) FILTER (place <= 2 AND is_gold) AS top2 FROM pl GROUP BY ALL),
rv AS (SELECT sv.method, split, failed, latency_ms, nd, cv, response, CASE WHEN ab THEN 0 ELSE f1 END AS f1, CASE WHEN ab THEN 0 ELSE hit / n_gold END AS cc,
  CASE WHEN NOT ab AND na <> '' AND (em = 1 OR f1 >= 0.5) THEN CASE WHEN top2 = 0 THEN 0 ELSE 2 * (top2 / 2) * (top2 / n_gold) / (top2 / 2 + top2 / n_gold) END END AS fa FROM sv LEFT JOIN hp ON hp.method = sv.method AND hp.qid = sv.qid),
ag AS (SELECT split, method, count(*) AS n, count(*) FILTER (NOT failed AND nd IS NOT NULL) AS n_ok, count(*) FILTER (failed OR response IS NOT NULL) AS n_generated, avg(nd) FILTER (NOT failed) AS nd, avg(cv) FILTER (NOT failed) AS cv,
  avg(f1) FILTER (response IS NOT NULL) AS af, avg(cc) FILTER (response IS NOT NULL) AS cc, avg(fa) FILTER (response IS NOT NULL) AS fa, quantile_disc(latency_ms::DOUBLE, 0.95) FILTER (NOT failed) AS p95 FROM rv GROUP BY ALL),
ru AS (SELECT split, bool_and({h("arun", 100, "split || ':' || arm || ':' || mode || ':' || m")} >= 1) AS done FROM (SELECT DISTINCT split FROM questions), (VALUES {RUNS}) r(arm, mode, m) GROUP BY split),
me AS (SELECT split, max(n) AS n, {", ".join(f"max({c}) FILTER (method = '{CANDIDATE}') - max({c}) FILTER (method = '{BASELINE}') AS {name}" for name, c in DELTAS.items())},
  max(p95) FILTER (method = '{CANDIDATE}') AS p95, bool_and(n_ok = n) AS complete_retrieval, bool_and(n_generated = n) AS complete_generation, bool_and(done) AS complete_attribution FROM ag JOIN ru USING (split) GROUP BY split),
mt AS (SELECT *, coalesce(round(ndcg_at_5, 9), 0) >= 0.02 OR coalesce(round(complete_evidence_at_5, 9), 0) >= 0.02 AS quality_met, complete_retrieval AND complete_generation AND complete_attribution AS whole,
  {" AND ".join(f"coalesce(round({c}, 9) >= {least}, true)" for c, least in C.GUARDRAILS.items())} AS guardrails_met FROM me)"""


def arm_answers(spark, sf):
    """method, qid and, of each arm's first five passages, nd and cv, the answer that is generated from them, and its values: f1, cc, fa.

    A question's passages meet its ranks once by qid. Each arm's prompt goes to the generator and, of the two arms that are compared, the answer
    and its passages to the scorer.
    """
    kept = F.struct("pid", "is_gold", *[F.col(f"{m}_rank").alias(m) for m in retrieval.METHODS[:3]], F.col("rank").alias(CANDIDATE))
    ranks = retrieval.wide(spark, sf).groupBy("qid").agg(F.collect_list(kept).alias("rs"))
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    body = F.struct(F.coalesce("title", F.lit("")).alias("title"), F.coalesce(F.array_join(lines, " "), F.lit("")).alias("body"))
    texts = V.texts(spark, sf).groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("pid", body.alias("x")))).alias("by"))
    top = lambda m: F.array_sort(F.transform(F.filter("rs", lambda x: x[m] <= 5), lambda x: F.struct(x[m].alias("rank"), x["pid"].alias("pid"), x["is_gold"].alias("is_gold"))))
    arms = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), top(m).alias("ctx")) for m in retrieval.METHODS]))
    gold = V.gold_heads(spark, sf).groupBy("qid").agg(F.count(F.lit(1)).alias("n_gold"))
    q = V.questions(spark, sf).select("qid", "question", "answer").join(gold, "qid")
    rows = ranks.join(texts, "qid").join(q, "qid").select("qid", "question", "answer", "n_gold", "by", arms.alias("a")).select("*", "a.*").drop("a")
    text = lambda part: F.transform("ctx", lambda x: F.element_at("by", x["pid"])[part])
    rows = rows.withColumns({"titles": text("title"), "bodies": F.when(F.col("method").isin(BASELINE, CANDIDATE), text("body")).otherwise(F.array().cast("array<string>"))}).drop("by")
    named = F.zip_with("ctx", "titles", lambda x, t: F.concat(F.lit("P"), x["rank"], F.lit(": "), t))
    rows = rows.withColumn("response", models.generate("stub", F.array_join(F.concat(F.array(F.concat(F.lit("Question: "), "question")), named), "\n")))
    rows = rows.withColumns({"said": T.strip_citations("response"), "cited": T.cited_aliases("response"), "ab": T.is_abstention("response"), "scored": F.slice("ctx", 1, F.size("bodies"))})
    pids, titles = F.transform("scored", lambda x: x["pid"]), F.slice("titles", 1, F.size("bodies"))
    rows = rows.withColumn("w", models.leave_one_out("stub", "question", "said", pids, titles, F.col("bodies")))
    gain = F.aggregate("ctx", F.lit(0.0), lambda a, x: a + F.when(x["is_gold"], 1.0 / F.log2(x["rank"] + 1.0)).otherwise(0.0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold"), F.lit(5)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    found = lambda xs, f: F.size(F.filter(xs, f))
    hits = found("ctx", lambda x: x["is_gold"] & F.array_contains("cited", F.concat(F.lit("P"), x["rank"])))
    places = F.array_sort(F.zip_with("scored", "w", lambda x, w: F.struct((-F.round(w, 9)).alias("w"), x["rank"].alias("rank"), x["is_gold"].alias("is_gold"))))
    top2 = found(F.slice(places, 1, 2), lambda x: x["is_gold"])
    rows = rows.withColumns({"f1": F.when(F.col("ab"), 0.0).otherwise(T.f1("said", "answer")), "p2": top2 / 2, "r2": top2 / F.col("n_gold")})
    right = ~F.col("ab") & (T.normalize_answer("said") != "") & ((T.exact_match("said", "answer") == 1) | (F.col("f1") >= 0.5))
    own = F.coalesce(F.try_divide(2 * F.col("p2") * F.col("r2"), F.col("p2") + F.col("r2")), F.lit(0.0))
    return rows.select(
        "method", "qid", (gain / ideal).alias("nd"), (found("ctx", lambda x: x["is_gold"]) == F.col("n_gold")).cast("int").alias("cv"), F.lit(True).alias("held"),
        "f1", F.when(F.col("ab"), 0.0).otherwise(hits / F.col("n_gold")).alias("cc"), F.when(right, own).alias("fa"),
    )


def attribution_runs(spark, sf):
    """split, complete_attribution: whether all runs of attribution that are required are there. The tables have none, so a hash leaves some out."""
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(mode).alias("mode"), F.lit(m).alias("m")) for a in retrieval.METHODS for mode, ms in REQUIRED.items() for m in ms]))
    runs = V.questions(spark, sf).select("split").distinct().select("split", each.alias("x")).select("split", F.concat_ws(":", "split", "x.arm", "x.mode", "x.m").alias("run"))
    return runs.groupBy("split").agg(F.bool_and(H("arun", "run") >= 1).alias("complete_attribution"))


FLAGS = ("complete_retrieval", "complete_generation", "complete_attribution", "quality_met", "guardrails_met")


@book.add(MEASURED + f""" SELECT split, n, {", ".join(f"round({c}, 6) AS {c}" for c in DELTAS)}, p95, {", ".join(FLAGS)}, split = 'eval' AND whole AS formal,
  CASE WHEN whole THEN quality_met END AS quality_gate, CASE WHEN whole THEN guardrails_met END AS guardrail_gate, CASE WHEN split = 'eval' AND whole THEN p95 <= {C.COST_MS} END AS cost_gate,
  CASE WHEN split = 'eval' AND whole THEN quality_met AND guardrails_met AND p95 <= {C.COST_MS} END AS retain FROM mt""")
def rerank_retention_gates(spark, sf):
    """The whole decision on reranking: quality or guardrails over what each arm's own passages, answers and attributions come to, cost, and whether all runs are there."""
    rows = retrieval.runs(spark, sf).join(arm_answers(spark, sf), ["method", "qid"], "left")
    ok = lambda c: F.when(~F.col("failed"), F.col(c))
    rows = rows.withColumns({"lat": ok("latency_ms"), **{c: ok(c) for c in ("nd", "cv", "f1", "cc", "fa")}})
    arms = rows.groupBy("split", "method").agg(
        F.count(F.lit(1)).alias("n"), F.count("nd").alias("n_ok"), F.count_if(F.col("failed") | F.col("held")).alias("n_generated"), F.avg("nd").alias("nd"), F.avg("cv").alias("cv"),
        F.avg("f1").alias("af"), F.avg("cc").alias("cc"), F.avg("fa").alias("fa"), M.nearest_rank("lat", 0.95).cast("double").alias("p95"),
    )
    own = lambda m, c: F.max(F.when(F.col("method") == m, F.col(c)))
    measured = arms.groupBy("split").agg(
        F.max("n").alias("n"), *[(own(CANDIDATE, c) - own(BASELINE, c)).alias(name) for name, c in DELTAS.items()], own(CANDIDATE, "p95").alias("p95"),
        F.bool_and(F.col("n_ok") == F.col("n")).alias("complete_retrieval"), F.bool_and(F.col("n_generated") == F.col("n")).alias("complete_generation"),
    )
    got = C.decision_gates(measured.join(attribution_runs(spark, sf), "split"))
    return got.select("split", "n", *[F.round(c, 6).alias(c) for c in DELTAS], "p95", *FLAGS, "formal", "quality_gate", "guardrail_gate", "cost_gate", "retain")
