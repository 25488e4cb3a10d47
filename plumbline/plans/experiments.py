"""Queries over several runs at once: names and keys of runs, paired analyses, gates, reasons for skipping, records that disagree."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.functions import text as T
from plumbline.operators import annotation as N
from plumbline.operators import attribution as A
from plumbline.operators import metrics as M
from plumbline.operators import ranking as R
from plumbline.operators import stats as S
from plumbline.operators.challenges import AUXILIARY, edit_sentence
from plumbline.plans import annotation, retrieval
from plumbline.plans import attribution as P
from plumbline.plans.book import Book
from plumbline.plans.data import H, h
from plumbline.plans.stats import boot
from plumbline.plans.text import F1_SQL, NORM, scored_answers
from plumbline.sources import fixture as V

book = Book()
QUERIES, ORACLES = book.queries, book.oracles


@book.add("SELECT p_partkey, replace(m, '/', '__') AS model_tag, g AS generation_run, CASE WHEN ns <> '' THEN ns || '__' || g ELSE g END AS attribution_run FROM (SELECT p_partkey, p_brand || '/' || p_name AS m, p_type || CASE WHEN p_size % 3 <> 0 THEN '_int' || p_size ELSE '' END AS g, CASE WHEN p_size % 2 = 0 THEN '' ELSE p_brand END AS ns FROM part)", view=False)
def run_names(spark, sf):
    """Names of a configuration's runs: parts stand for configurations of a model, a quantization and a namespace."""
    model = F.concat(F.col("p_brand"), F.lit("/"), F.col("p_name"))
    quantization = F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("int"), "p_size"))
    namespace = F.when(F.col("p_size") % 2 != 0, F.col("p_brand"))
    run = F.concat_ws("_", "p_type", quantization)
    return V.read(spark, sf, "part").select("p_partkey", F.replace(model, F.lit("/"), F.lit("__")).alias("model_tag"), run.alias("generation_run"), F.concat_ws("__", namespace, run).alias("attribution_run"))


@book.add("SELECT qid, row_number() OVER (ORDER BY sha256('7:' || qid)) AS position FROM questions ORDER BY sha256('7:' || qid) LIMIT 15")
def manifest_limit(spark, sf):
    """The first 15 questions in the manifest's order: each task keeps 15, so nothing else is sorted or shuffled."""
    order = F.sha2(F.concat(F.lit("7:"), "qid"), 256)
    first = V.questions(spark, sf).select("qid", order.alias("o")).orderBy("o").limit(15)
    return first.select("qid", F.row_number().over(W.orderBy("o")).cast("long").alias("position"))


THREE = ("bm25", "dense", "hybrid_rrf")
SHARED = retrieval.RANKED + f", ok AS (SELECT * FROM la WHERE method IN {THREE} AND {h('gone', 100, 'method || qid')} >= 5)"


def present_runs(spark, sf):
    """Runs of three methods; some questions have no record in one of them."""
    r = retrieval.runs(spark, sf).where(F.col("method").isin(*THREE))
    return r.where(T.bucket(F.concat(F.lit("gone:"), "method", "qid")) >= 5)


@book.add(SHARED + " SELECT qid, max(failed) AS any_failed, CASE WHEN NOT max(failed) THEN greatest(max(latency_ms) FILTER (method = 'bm25'), max(latency_ms) FILTER (method = 'dense')) + max(latency_ms) FILTER (method = 'hybrid_rrf') END::DOUBLE AS estimate_ms FROM ok GROUP BY qid HAVING count(DISTINCT method) = 3")
def run_key_intersection(spark, sf):
    """Questions that all three runs hold, with the time of both sources side by side and their fusion where none failed."""
    own = lambda m: F.max(F.when(F.col("method") == m, F.col("latency_ms")))
    rows = present_runs(spark, sf).groupBy("qid").agg(
        F.collect_set("method").alias("held"), F.bool_or("failed").alias("any_failed"), (F.greatest(own("bm25"), own("dense")) + own("hybrid_rrf")).alias("ms")
    )
    return rows.where(F.size("held") == len(THREE)).select("qid", "any_failed", F.when(~F.col("any_failed"), F.col("ms").cast("double")).alias("estimate_ms"))


PERC = ", pc AS (SELECT split, method, avg(latency_ms) AS mean, quantile_disc(latency_ms::DOUBLE, 0.5) AS p50, quantile_disc(latency_ms::DOUBLE, 0.95) AS p95 FROM ok WHERE NOT failed AND NOT (split = 'smoke' AND method = 'dense') GROUP BY ALL), s AS (SELECT DISTINCT split FROM questions)"


@book.add(SHARED + PERC + " SELECT s.split, u.measure, " + ", ".join(
  f"round(CASE u.measure WHEN 'sources' THEN b.{p} + d.{p} WHEN 'fusion_over_bm25' THEN f.{p} - b.{p} ELSE f.{p} + 25 END, 6)::DOUBLE AS {p}" for p in M.PARTS)
  + " FROM s LEFT JOIN pc b ON b.split = s.split AND b.method = 'bm25' LEFT JOIN pc d ON d.split = s.split AND d.method = 'dense' LEFT JOIN pc f ON f.split = s.split AND f.method = 'hybrid_rrf', (VALUES ('sources'), ('fusion_over_bm25'), ('fusion_and_rerank')) u(measure)")
def percentile_arithmetic(spark, sf):
    """Sums and differences of mean, median and 95th percentile; null where a method has no timing (dense in the split smoke)."""
    ok = ~F.col("failed") & ~((F.col("split") == "smoke") & (F.col("method") == "dense"))
    rows = present_runs(spark, sf).where(ok).groupBy("split", "method").agg(M.percentile_struct("latency_ms").alias("x"))
    b, d, f = (F.max(F.when(F.col("method") == m, F.col("x"))) for m in THREE)
    wide = rows.groupBy("split").agg(b.alias("b"), d.alias("d"), f.alias("f"))
    add, less = (lambda x, y: x + y), (lambda x, y: x - y)
    measures = {
        "sources": M.combine_percentiles(F.col("b"), F.col("d"), add),
        "fusion_over_bm25": M.combine_percentiles(F.col("f"), F.col("b"), less),
        "fusion_and_rerank": M.combine_percentiles(F.col("f"), M.constant_percentiles(25), add),
    }
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), c.alias("x")) for n, c in measures.items()]))
    long = wide.select("split", each.alias("m"))
    return long.select("split", "m.measure", *[F.round(f"m.x.{p}", 6).alias(p) for p in M.PARTS])


#: Metrics of a paired analysis of two arms, with the subset of questions each is over.
FIRST = ("retrieval_ndcg_at_5", "complete_evidence_at_5")
SUBSETS = {
    "answer_em": "all_valid_paired_questions",
    "answer_f1": "all_valid_paired_questions",
    "citation_coverage": "all_successfully_processed_paired_questions",
    "leave_one_out_sufficiency": "all_paired_attributed_answers",
    "leave_one_out_comprehensiveness": "all_paired_attributed_answers",
    "citations_attribution_f1_at_2": "both_arms_correct_answer_subset",
    "embedding_attribution_f1_at_2": "both_arms_correct_answer_subset",
    "leave_one_out_attribution_f1_at_2": "both_arms_correct_answer_subset",
}
LOWER = ("leave_one_out_sufficiency",)
#: Share of questions without a value, by subset.
MISSING = {"all_valid_paired_questions": 5, "all_successfully_processed_paired_questions": 10, "all_paired_attributed_answers": 20, "both_arms_correct_answer_subset": 50}
VALUES = ", ".join(f"('{m}', '{s}', {MISSING[s]})" for m, s in SUBSETS.items())
TOLERANCE = "1e-9::DOUBLE"


def judged(rows: str, group: str) -> str:
    """Table jd of a paired analysis of rows (group, qid, delta); a group in LOWER, or one that ends in sufficiency, is better when low."""
    return boot(rows, group).rstrip() + f""", pw AS (SELECT {group}, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high, avg((m > {TOLERANCE})::INT) AS p_above, avg((m < -{TOLERANCE})::INT) AS p_below FROM bm0 GROUP BY {group}),
jd AS (SELECT *, low > {TOLERANCE} OR high < -{TOLERANCE} AS excludes_zero, CASE WHEN {group} LIKE '%sufficiency' THEN high < -{TOLERANCE} ELSE low > {TOLERANCE} END AS favorable
  FROM (SELECT {group}, count(delta) AS n, count(*) - count(delta) AS n_excluded, avg(delta) AS mean FROM {rows} GROUP BY {group}) LEFT JOIN pw USING ({group})) """


JUDGED = "n, n_excluded, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high, round(p_above, 6) AS p_above, round(p_below, 6) AS p_below, excludes_zero, favorable FROM jd"


@book.add(retrieval.RANKED + f""", n5 AS (SELECT method, qid, sum(CASE WHEN is_gold AND rank <= 5 THEN 1.0 / log2(rank + 1) ELSE 0 END) / list_sum(list_transform(range(1, least(count(*) FILTER (is_gold), 5) + 1), lambda i: 1.0 / log2(i + 1))) AS nd,
  (bool_and(rank <= 5) FILTER (is_gold))::INT::DOUBLE AS cv FROM mk WHERE method IN ('hybrid_rrf_rerank', 'hybrid_rrf') GROUP BY ALL),
a5 AS (SELECT qid, max(nd) FILTER (method = 'hybrid_rrf_rerank') - max(nd) FILTER (method = 'hybrid_rrf') AS nd, max(cv) FILTER (method = 'hybrid_rrf_rerank') - max(cv) FILTER (method = 'hybrid_rrf') AS cv FROM n5 GROUP BY qid),
md AS (SELECT '{FIRST[0]}' AS metric, qid, nd AS delta FROM a5 UNION ALL SELECT '{FIRST[1]}', qid, cv FROM a5
  UNION ALL SELECT metric, qid, CASE WHEN {h('lost', 100, "subset || ':' || qid")} >= missing THEN ({h('cand', 100, "metric || ':' || qid")} - {h('base', 100, "metric || ':' || qid")}) / 100 END FROM questions, (VALUES {VALUES}) m(metric, subset, missing))""" + judged("md", "metric") + "SELECT metric, " + JUDGED)
def paired_metric_analysis(spark, sf):
    """Ten metrics of the arm with reranking against the one without, each over its own subset; values of the last eight are hashes."""
    m = retrieval.marked(spark, sf).where("method IN ('hybrid_rrf_rerank', 'hybrid_rrf')").groupBy("qid", "method").agg(M.ndcg_at(5).alias("nd"), M.covered_at(5).cast("int").cast("double").alias("cv"))
    own = lambda c: F.max(F.when(F.col("method") == "hybrid_rrf_rerank", F.col(c))) - F.max(F.when(F.col("method") == "hybrid_rrf", F.col(c)))
    ranked = m.groupBy("qid").agg(own("nd").alias(FIRST[0]), own("cv").alias(FIRST[1])).unpivot("qid", list(FIRST), "metric", "delta")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.lit(s).alias("subset"), F.lit(MISSING[s]).alias("missing")) for n, s in SUBSETS.items()]))
    rest = V.questions(spark, sf).select("qid", each.alias("x")).select("qid", "x.*")
    b = lambda tag, of: T.bucket(F.concat_ws(":", F.lit(tag), of, "qid"))
    rest = rest.withColumn("delta", F.when(b("lost", "subset") >= F.col("missing"), (b("cand", "metric") - b("base", "metric")) / 100))
    got = S.paired_analysis(ranked.unionByName(rest.select("qid", "metric", "delta")), "metric", F.col("metric").isin(*LOWER))
    return got.select("metric", "n", "n_excluded", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high", "p_above", "p_below")], "excludes_zero", "favorable")


CHECKED = ("oracle_gold", "control_random", "control_answer_string")
ANSWERED = f"({NORM.format('answer')} <> '' AND contains(' ' || {NORM.format('body')} || ' ', ' ' || {NORM.format('answer')} || ' '))::INT::DOUBLE"
GATE = P.BASE + f""", s3 AS (SELECT 'oracle_gold' AS method, qid, split, idx, w, answer, is_gold::INT::DOUBLE AS score FROM lo UNION ALL SELECT 'control_random', qid, split, idx, w, answer, {P.UNIT.format("'random:' || pid")} FROM lo
  UNION ALL SELECT 'control_answer_string', qid, split, idx, w, answer, {ANSWERED} FROM lo),
r3 AS (SELECT *, row_number() OVER (PARTITION BY method, qid ORDER BY round(score, 9) DESC, idx) AS rank FROM s3),
f3 AS (SELECT method, qid, split, (sum(w) - sum(w) FILTER (rank <= 2)) / greatest(1, len(list_filter(string_split(max(answer), ' '), lambda x: x <> ''))) AS sufficiency,
  (sum(w) - sum(w) FILTER (rank > 2)) / greatest(1, len(list_filter(string_split(max(answer), ' '), lambda x: x <> ''))) AS comprehensiveness FROM r3 GROUP BY ALL),
gd AS (SELECT o.split || '|' || c.method || '|' || u.metric AS cell, o.qid, CASE u.metric WHEN 'sufficiency' THEN o.sufficiency - c.sufficiency ELSE o.comprehensiveness - c.comprehensiveness END AS delta
  FROM f3 o JOIN f3 c USING (qid), (VALUES ('sufficiency'), ('comprehensiveness')) u(metric) WHERE o.method = 'oracle_gold' AND c.method <> 'oracle_gold')"""


def interventions(spark, sf):
    """qid, split, method, sufficiency, comprehensiveness of three methods: log-probability lost with only the first two passages, and without them."""
    r = P.rows(spark, sf).withColumn("w", A.get_method("leave_one_out").score())
    n = F.greatest(F.lit(1), F.size(F.filter(F.split("answer", " "), lambda x: x != "")))
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), A.get_method(m).score().alias("score")) for m in CHECKED]))
    r = r.select("qid", "split", "idx", "w", n.alias("n"), each.alias("x")).select("qid", "split", "idx", "w", "n", "x.*")
    lost = lambda c: (F.sum("w") - F.sum(F.when(c, F.col("w")))) / F.max("n")
    ranked = R.rank_by_score(r, ("qid", "method"))
    return ranked.groupBy("qid", "split", "method").agg(lost(F.col("rank") <= 2).alias("sufficiency"), lost(F.col("rank") > 2).alias("comprehensiveness"))


@book.add(GATE + judged("gd", "cell") + "SELECT split_part(cell, '|', 1) AS split, split_part(cell, '|', 2) AS comparator, split_part(cell, '|', 3) AS metric, n, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high, favorable, CASE WHEN bool_and(favorable) OVER (PARTITION BY split_part(cell, '|', 1)) THEN 'passed' ELSE 'failed' END AS status FROM jd")
def construct_gate(spark, sf):
    """The oracle against both negative controls on both diagnostics; a split passes if all four intervals are on the right side."""
    two = ("sufficiency", "comprehensiveness")
    own = lambda m, c: F.max(F.when(F.col("method") == m, F.col(c)))
    wide = interventions(spark, sf).groupBy("qid", "split").agg(*[own(m, c).alias(f"{m}_{c}") for m in CHECKED for c in two])
    cells = [F.struct(F.concat_ws("|", "split", F.lit(m), F.lit(c)).alias("cell"), (F.col(f"{CHECKED[0]}_{c}") - F.col(f"{m}_{c}")).alias("delta")) for m in CHECKED[1:] for c in two]
    long = wide.select("qid", F.explode(F.array(*cells)).alias("x")).select("qid", "x.*")
    got = S.paired_analysis(long, "cell", F.col("cell").endswith("sufficiency"))
    part = F.split("cell", "[|]")
    got = got.select(part[0].alias("split"), part[1].alias("comparator"), part[2].alias("metric"), "n", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")], "favorable")
    passed = F.bool_and("favorable").over(W.partitionBy("split"))
    return got.withColumn("status", F.when(passed, "passed").otherwise("failed"))


@book.add(F1_SQL + f""", rec AS (SELECT * FROM sc WHERE {h('norec')} >= 4)
SELECT q.qid, m.mode, CASE WHEN m.mode = 'gold' THEN CASE WHEN {h('human', 100, 'q.qid')} < 10 THEN 'human_unanswerable' WHEN rec.qid IS NULL THEN 'generation_context_missing' END
  WHEN rec.qid IS NULL THEN 'generation_missing' WHEN failed THEN 'generation_failed' WHEN contains(lower(response), 'insufficient evidence') THEN 'abstained' WHEN na = '' THEN 'empty_answer' END AS reason
FROM questions q LEFT JOIN rec ON rec.qid = q.qid, (VALUES ('gold'), ('generated')) m(mode)""")
def context_skip_reasons(spark, sf):
    """Why a question has no context to attribute, by mode; null where it has one."""
    held = scored_answers(spark, sf).where(H("norec") >= 4).select("qid", "failed", "response", (T.normalize_answer("said") == "").alias("empty"), F.lit(True).alias("held"))
    rows = V.questions(spark, sf).select("qid", F.explode(F.array(F.lit("gold"), F.lit("generated"))).alias("mode")).join(held, "qid", "left")
    missing = F.col("held").isNull()
    gold = F.when(H("human") < 10, "human_unanswerable").when(missing, "generation_context_missing")
    generated = F.when(missing, "generation_missing").when(F.col("failed"), "generation_failed").when(T.is_abstention("response"), "abstained").when(F.col("empty"), "empty_answer")
    return rows.select("qid", "mode", F.when(F.col("mode") == "gold", gold).otherwise(generated).alias("reason"))


RECORDS = annotation.SUB.rstrip() + f""", rc2 AS (SELECT q.qid AS task, a, b, answer AS xa, CASE WHEN {h('tx')} < 20 THEN '  ' || upper(answer) || ' ' WHEN {h('tx')} < 35 THEN answer || ' x' ELSE answer END AS ya,
  {h('se')} < 15 AS other_sets, {h('am1')} < 10 AS xm, {h('am2')} < 10 AS ym, {h('de1')} < 8 AS xd, {h('de2')} < 8 AS yd, {h('ex1')} >= 10 AS xe, {h('ex2')} >= 10 AS ye FROM questions q JOIN lab ON lab.task = q.qid)"""
SAME = "lower(trim(regexp_replace(coalesce({}, ''), '\\s+', ' ', 'g')))"


def records(spark, sf):
    """task, x, y: the two records of a task; y is null where it is missing."""
    t = annotation.tasks(spark, sf).select(F.col("task").alias("qid"), "a", "b").join(V.questions(spark, sf).select("qid", "answer"), "qid")
    text = F.when(H("tx") < 20, F.concat(F.lit("  "), T.upper_each("answer"), F.lit(" "))).when(H("tx") < 35, F.concat("answer", F.lit(" x"))).otherwise(F.col("answer"))
    family = lambda *sets: F.array(*[F.array(*map(F.lit, s)) for s in sets])
    mine = family(("P1.S1", "P2.S1"), ("P3.S1",))
    same, other = family(("P3.S1",), ("P2.S1", "P1.S1")), family(("P1.S1",), ("P3.S1",))
    record = lambda k, label, answer, families: F.struct(
        F.col(label).alias("label"), answer.alias("answer"), families.alias("families"), (H(f"am{k}") < 10).alias("ambiguous"), (H(f"de{k}") < 8).alias("defect"), (H(f"ex{k}") >= 10).alias("exhaustive")
    )
    y = record(2, "b", text, F.when(H("se") < 15, other).otherwise(same))
    return t.select(F.col("qid").alias("task"), record(1, "a", F.col("answer"), mine).alias("x"), F.when(F.col("b").isNotNull(), y).alias("y"))


@book.add(RECORDS + f""", d AS (SELECT task, b, array_to_string(list_filter([CASE WHEN a <> b THEN 'answerability' END, CASE WHEN {SAME.format('xa')} <> {SAME.format('ya')} THEN 'answer_text' END, CASE WHEN other_sets THEN 'evidence_sets' END,
  CASE WHEN xm <> ym THEN 'ambiguity' END, CASE WHEN xd <> yd THEN 'dataset_defect' END], lambda r: r IS NOT NULL), ',') AS reasons FROM rc2)
SELECT task, CASE WHEN b IS NULL THEN 'incomplete' ELSE reasons END AS reasons FROM d WHERE b IS NULL OR reasons <> ''""")
def disagreement_reasons(spark, sf):
    """Tasks whose two records differ, with all reasons in order; a task with fewer records is a violation, incomplete."""
    r = records(spark, sf).withColumn("reasons", F.array_join(N.disagreement_reasons(F.col("x"), F.col("y")), ","))
    return r.select("task", F.when(F.col("y").isNull(), "incomplete").otherwise(F.col("reasons")).alias("reasons")).where("reasons <> ''")


@book.add(RECORDS + " SELECT task, CASE WHEN a = 'unclear' THEN 'unclear human decision' WHEN xd OR yd THEN 'dataset defect' WHEN xm OR ym THEN 'annotator-marked ambiguity' WHEN a = 'answerable' AND (NOT xe OR NOT ye) THEN 'non-exhaustive evidence' END AS exclusion FROM rc2 WHERE a = b")
def agreement_exclusions(spark, sf):
    agreed = records(spark, sf).where("y IS NOT NULL AND x.label = y.label")
    return agreed.select("task", N.agreement_exclusion(F.col("x"), F.col("y")).alias("exclusion"))


EDIT = f""", rp AS (SELECT qid, arg_min(title, sha256('swap:' || pid)) AS entity FROM passages JOIN questions USING (qid) WHERE pid NOT IN (SELECT pid FROM gold) AND {NORM.format('title')} <> '' AND {NORM.format('title')} <> {NORM.format('answer')} GROUP BY qid),
ed AS (SELECT pid, sentences[1] AS s, trim(answer) AS a, entity, strpos(lower(sentences[1]), lower(trim(answer))) AS loc, {NORM.format('answer')} = '' AS void,
  regexp_matches(sentences[1], '(?is){AUXILIARY}') AS aux, regexp_extract(sentences[1], '(?is){AUXILIARY}', 3) <> '' AS neg FROM gold JOIN questions USING (qid) JOIN rp USING (qid) WHERE len(sentences) > 0)
SELECT pid, CASE WHEN void THEN 'invalid' WHEN loc > 0 THEN 'answer_substitution' WHEN aux THEN 'negation_toggle' ELSE 'negation_prefix' END AS operation,
  sha256(CASE WHEN void THEN NULL WHEN loc > 0 THEN substr(s, 1, loc - 1) || entity || substr(s, loc + length(a)) WHEN aux AND neg THEN regexp_replace(s, '(?is){AUXILIARY}', '\\1\\2\\4') WHEN aux THEN regexp_replace(s, '(?is){AUXILIARY}', '\\1\\2 not\\4')
  ELSE 'It is not true that ' || s END) AS text_hash FROM ed"""


@book.add(EDIT)
def challenge_evidence_edit(spark, sf):
    """The first sentence of each gold passage made false: another passage's title for the answer, else its first auxiliary negated or no longer so,
    else a negating prefix. A question without an answer is invalid, and one without another title has no row."""
    q = V.questions(spark, sf).select("qid", F.trim("answer").alias("answer"), T.normalize_answer("answer").alias("na"))
    p, gold = V.texts(spark, sf), V.gold(spark, sf).select("qid", "pid", F.get("sentences", F.lit(0)).alias("s")).where("s IS NOT NULL")
    nt = T.normalize_answer("title")
    other = p.select("qid", "pid", "title").join(V.gold_heads(spark, sf).select("pid"), "pid", "left_anti").join(q, "qid").where((nt != "") & (nt != F.col("na")))
    entity = other.groupBy("qid").agg(F.min_by("title", F.sha2(F.concat(F.lit("swap:"), "pid"), 256)).alias("entity"))
    rows = gold.join(q, "qid").join(entity, "qid")
    edited, operation = edit_sentence(F.col("s"), F.col("answer"), F.col("na"), F.col("entity"))
    return rows.select("pid", operation.alias("operation"), F.sha2(edited, 256).alias("text_hash"))
