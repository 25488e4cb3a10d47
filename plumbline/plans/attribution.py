"""Attribution, generation-evaluation and record-outcome queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.functions import text as T
from plumbline.operators import attribution as A
from plumbline.operators import metrics as M
from plumbline.operators import ranking as R
from plumbline.plans import retrieval
from plumbline.plans.book import Book
from plumbline.plans.text import CITED, F1_SQL, NORM, scored_answers
from plumbline.sources import fixture as V

book = Book()
QUERIES, ORACLES = book.queries, book.oracles
STOP = ", ".join(f"'{w}'" for w in A.STOP_WORDS)
UNIT = "(('0x' || substr(sha256({0}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE)"
WORDS = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: w NOT IN (" + STOP + ")))"

BASE = f""", pa AS (SELECT p.*, 'P' || (p.idx + 1) AS alias, q.question, q.answer, q.split, q.qtype, g.pid IS NOT NULL AS is_gold, {CITED} AS cited, response, failed,
  array_to_string(list_filter([trim(q.question), trim(q.answer)], lambda x: x <> ''), ' ') AS query
  FROM passages p JOIN generations q USING (qid) LEFT JOIN gold g USING (pid)),
lo AS (SELECT *, CASE WHEN (title <> '' AND contains(lower(answer), lower(title))) OR (answer <> '' AND contains(lower(body), lower(answer))) THEN 2.0 ELSE 0.1 * {UNIT.format("'w:' || pid")} END::DOUBLE AS w FROM pa),
lx AS (SELECT *, len(list_intersect({WORDS.format("query")}, {WORDS.format("concat_ws(' ', title, body)")})) / greatest(1, len({WORDS.format("query")})) AS lex FROM lo),
sc0 AS (SELECT 'leave_one_out' AS method, qid, pid, idx, is_gold, split, w AS score FROM lx UNION ALL SELECT 'control_lexical', qid, pid, idx, is_gold, split, lex FROM lx
  UNION ALL SELECT 'control_length', qid, pid, idx, is_gold, split, len(toks) FROM lx UNION ALL SELECT 'control_random', qid, pid, idx, is_gold, split, {UNIT.format("'random:' || pid")} FROM lx
  UNION ALL SELECT 'oracle_gold', qid, pid, idx, is_gold, split, is_gold::INT FROM lx),
rs AS (SELECT *, row_number() OVER (PARTITION BY method, qid ORDER BY round(score, 9) DESC, idx) AS rank FROM sc0),
rh AS (SELECT *, sum(is_gold::INT) OVER (PARTITION BY method, qid ORDER BY rank) AS hits FROM rs),
mq AS (SELECT method, qid, split, sum(CASE WHEN is_gold THEN hits / rank ELSE 0 END) / count(*) FILTER (is_gold) AS ap, count(*) FILTER (is_gold AND rank <= 2) / 2 AS p2, count(*) FILTER (is_gold AND rank <= 2) / count(*) FILTER (is_gold) AS r2,
  sum(CASE WHEN is_gold AND rank <= 10 THEN 1.0 / log2(rank + 1) ELSE 0 END) / list_sum(list_transform(range(1, least(count(*) FILTER (is_gold), 10) + 1), lambda i: 1.0 / log2(i + 1))) AS ndcg FROM rh GROUP BY ALL)
"""
METHODS = ("leave_one_out", "control_lexical", "control_length", "control_random", "oracle_gold")


def rows(spark, sf):
    """Passages with their question, generation, gold mark and citations."""
    g = V.generations(spark, sf).withColumn("cited", T.cited_aliases("response"))
    marks = V.gold(spark, sf).select("pid", F.lit(True).alias("is_gold"))
    p = V.passages(spark, sf).join(g, "qid").join(marks, "pid", "left").withColumn("is_gold", F.coalesce("is_gold", F.lit(False)))
    return p.withColumn("alias", F.concat(F.lit("P"), F.col("idx") + 1)).withColumn("query", T.compose_query("question", "answer", "question_answer"))


def method_scores(spark, sf):
    each = F.array(*[F.struct(F.lit(m).alias("method"), A.get_method(m).score().alias("score")) for m in METHODS])
    return rows(spark, sf).select("qid", "pid", "idx", "is_gold", "split", F.explode(each).alias("x")).select("x.method", "qid", "pid", "idx", "is_gold", "split", "x.score")


def method_metrics(spark, sf):
    """method, qid, split, ap, p2, r2, ndcg."""
    ranked = R.rank_by_score(method_scores(spark, sf), ("method", "qid"))
    hits = F.sum(F.col("is_gold").cast("int")).over(W.partitionBy("method", "qid").orderBy("rank"))
    top = F.count_if(F.col("is_gold") & (F.col("rank") <= 2))
    return ranked.withColumn("hits", hits).groupBy("method", "qid", "split").agg(
        M.average_precision().alias("ap"), (top / 2).alias("p2"), (top / F.count_if("is_gold")).alias("r2"), M.ndcg_at(10).alias("ndcg")
    )


@book.add(BASE + "SELECT pid, list_contains(cited, alias)::INT::DOUBLE AS score FROM pa WHERE response IS NOT NULL")
def attr_citations(spark, sf):
    return rows(spark, sf).where("response IS NOT NULL").select("pid", A.get_method("citations").score().alias("score"))


@book.add(retrieval.RANKED + "SELECT pid, round(score, 6) AS score FROM dn")
def attr_embedding(spark, sf):
    return retrieval.dense_scores(spark, sf).select("pid", F.round("score", 6).alias("score"))


@book.add(BASE + "SELECT pid, round(w, 9) AS score FROM lo")
def attr_leave_one_out(spark, sf):
    return rows(spark, sf).select("pid", F.round(A.get_method("leave_one_out").score(), 9).alias("score"))


@book.add(BASE + f"SELECT qid, round(-10 - 5 * {UNIT.format(chr(39) + 'base:' + chr(39) + ' || qid')} + sum(w), 6) AS sum_logprob, greatest(1, len(list_filter(string_split(max(answer), ' '), lambda x: x <> '')))::BIGINT AS n_tokens FROM lo GROUP BY qid")
def stub_lm_scores(spark, sf):
    w = rows(spark, sf).withColumn("w", A.get_method("leave_one_out").score()).groupBy("qid").agg(F.sum("w").alias("w"), F.max("answer").alias("answer"))
    base = -10 - 5 * T.hash_unit(F.concat(F.lit("base:"), "qid"))
    n = F.greatest(F.lit(1), F.size(F.filter(F.split("answer", " "), lambda x: x != "")))
    return w.select("qid", F.round(base + F.col("w"), 6).alias("sum_logprob"), n.cast("long").alias("n_tokens"))


JSD = """, v AS (SELECT p.qid, p.pid, list_transform(a.v, lambda x: abs(x)) AS x, list_transform(b.v, lambda x: abs(x)) AS y FROM passages p JOIN vectors a ON a.vec_id = p.doc_id % (SELECT count(*) FROM embeddings)
  JOIN gold g ON g.qid = p.qid AND g.grank = 1 JOIN vectors b ON b.vec_id = g.doc_id % (SELECT count(*) FROM embeddings)),
n AS (SELECT pid, list_transform(x, lambda z: z / list_sum(x)) AS x, list_transform(y, lambda z: z / list_sum(y)) AS y FROM v)
SELECT pid, round(greatest(0, list_sum(list_transform(range(1, len(x) + 1), lambda i: x[i] * ln((x[i] + 1e-12) / ((x[i] + y[i]) / 2 + 1e-12)) + y[i] * ln((y[i] + 1e-12) / ((x[i] + y[i]) / 2 + 1e-12)))) / 2), 6)::DOUBLE AS score FROM n"""


@book.add(JSD)
def attr_arc_jsd(spark, sf):
    """Distributions stand for the model's: the vectors' absolute parts, of the full context and of a passage."""
    v = V.vectors(spark, sf)
    share = lambda c: F.transform(F.transform(c, lambda x: F.abs(x)), lambda x: x / F.aggregate(F.transform(c, lambda y: F.abs(y)), F.lit(0.0), lambda a, b: a + b))
    v = v.select("vec_id", share(F.col("v")).alias("v"))
    own = V.vector_of(spark, sf, V.texts(spark, sf)).select("qid", "pid", "vec_id").join(v, "vec_id").drop("vec_id")
    full = V.vector_of(spark, sf, V.gold_heads(spark, sf).where("grank = 1")).select("qid", "vec_id").join(v.withColumnRenamed("v", "f"), "vec_id").drop("vec_id")
    return own.join(full, "qid").select("pid", F.round(A.divergence(F.col("v"), F.col("f")), 6).alias("score"))


@book.add(BASE + "SELECT pid, is_gold::INT::DOUBLE AS score FROM pa")
def control_oracle_gold(spark, sf):
    return rows(spark, sf).select("pid", A.get_method("oracle_gold").score().alias("score"))


@book.add(BASE + f"SELECT pid, ({NORM.format('answer')} <> '' AND contains(' ' || {NORM.format('body')} || ' ', ' ' || {NORM.format('answer')} || ' '))::INT::DOUBLE AS score FROM pa")
def control_answer_string(spark, sf):
    return rows(spark, sf).select("pid", A.get_method("control_answer_string").score().alias("score"))


@book.add(f"SELECT pid, round({UNIT.format(chr(39) + 'random:' + chr(39) + ' || pid')}, 9) AS score FROM passages")
def control_random_hash(spark, sf):
    return V.passages(spark, sf).select("pid", F.round(A.get_method("control_random").score(), 9).alias("score"))


@book.add(retrieval.RANKED + "SELECT pid, -rank::DOUBLE AS score FROM bm")
def control_retrieval_rank(spark, sf):
    return retrieval.bm25(spark, sf).select("pid", (-F.col("rank")).cast("double").alias("score"))


@book.add(BASE + "SELECT pid, round(lex, 6) AS score FROM lx")
def control_lexical_overlap(spark, sf):
    return rows(spark, sf).select("pid", F.round(A.get_method("control_lexical").score(), 6).alias("score"))


@book.add("SELECT pid, len(toks)::DOUBLE AS score FROM passages")
def control_length(spark, sf):
    return V.passages(spark, sf).select("pid", A.get_method("control_length").score().alias("score"))


@book.add(BASE + ", k AS (SELECT qid, pid, idx, lex, row_number() OVER (PARTITION BY qid ORDER BY idx) AS a, row_number() OVER (PARTITION BY qid ORDER BY sha256('shuffle:' || pid)) AS b FROM lx) SELECT x.pid, round(y.lex, 6) AS score FROM k x JOIN k y ON x.qid = y.qid AND x.a = y.b")
def control_shuffled_hash(spark, sf):
    lex = rows(spark, sf).select("qid", "pid", "idx", A.get_method("control_lexical").score().alias("score"))
    return A.shuffled(lex, "shuffle").select("pid", F.round("score", 6).alias("score"))


@book.add(BASE + ", m AS (SELECT *, min(lex) OVER (PARTITION BY qid) AS lo_, max(lex) OVER (PARTITION BY qid) AS hi_ FROM lx) SELECT pid, hi_ - lo_ <= 1e-9 * greatest(abs(hi_), abs(lo_)) AS degenerate, round(CASE WHEN hi_ - lo_ <= 1e-9 * greatest(abs(hi_), abs(lo_)) THEN 0.5 ELSE (lex - lo_) / (hi_ - lo_) END, 6)::DOUBLE AS norm FROM m")
def score_minmax(spark, sf):
    lex = rows(spark, sf).select("qid", "pid", A.get_method("control_lexical").score().alias("score"))
    return A.normalized(lex).select("pid", "degenerate", F.round("norm", 6).alias("norm"))


@book.add(BASE + """, k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(lex, 9) DESC, idx) AS rank FROM lx),
f AS (SELECT qid, greatest(1, len(list_filter(string_split(max(answer), ' '), lambda x: x <> ''))) AS n, sum(w) AS full_, sum(w) FILTER (rank <= 2) AS top, sum(w) FILTER (rank > 2) AS rest FROM k GROUP BY qid)
SELECT qid, round((full_ - top) / n, 6) AS sufficiency, round((full_ - rest) / n, 6) AS comprehensiveness FROM f""")
def faithfulness(spark, sf):
    """With k = 2: the mean log-probability lost with only the first passages, and without them."""
    r = rows(spark, sf).withColumn("w", A.get_method("leave_one_out").score()).withColumn("score", A.get_method("control_lexical").score())
    r = R.rank_by_score(r).groupBy("qid").agg(
        F.max("answer").alias("answer"), F.sum("w").alias("full"), F.sum(F.when(F.col("rank") <= 2, F.col("w"))).alias("top"), F.sum(F.when(F.col("rank") > 2, F.col("w"))).alias("rest")
    )
    n = F.greatest(F.lit(1), F.size(F.filter(F.split("answer", " "), lambda x: x != "")))
    return r.select("qid", F.round((F.col("full") - F.col("top")) / n, 6).alias("sufficiency"), F.round((F.col("full") - F.col("rest")) / n, 6).alias("comprehensiveness"))


@book.add(BASE + "SELECT method, qid, round(p2, 6) AS p_at_2, round(r2, 6) AS r_at_2, round(CASE WHEN p2 + r2 > 0 THEN 2 * p2 * r2 / (p2 + r2) ELSE 0 END, 6)::DOUBLE AS f1_at_2 FROM mq")
def attr_prf_at_k(spark, sf):
    p, r = F.col("p2"), F.col("r2")
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return method_metrics(spark, sf).select("method", "qid", F.round(p, 6).alias("p_at_2"), F.round(r, 6).alias("r_at_2"), F.round(f1, 6).alias("f1_at_2"))


@book.add(BASE + "SELECT method, split, round(avg(ap), 6) AS map, round(avg(ndcg), 6) AS ndcg, count(*) AS n FROM mq GROUP BY method, split")
def attr_map(spark, sf):
    return method_metrics(spark, sf).groupBy("method", "split").agg(F.round(F.avg("ap"), 6).alias("map"), F.round(F.avg("ndcg"), 6).alias("ndcg"), F.count(F.lit(1)).alias("n"))


@book.add(BASE + "SELECT method, split, round(max(m) FILTER (method IN ('control_lexical', 'control_length', 'control_random')) OVER (PARTITION BY split), 6) AS strongest, round(m - max(m) FILTER (method IN ('control_lexical', 'control_length', 'control_random')) OVER (PARTITION BY split), 6) AS separation FROM (SELECT method, split, avg(ap) AS m FROM mq GROUP BY ALL)")
def control_separation(spark, sf):
    m = method_metrics(spark, sf).groupBy("method", "split").agg(F.avg("ap").alias("m"))
    best = F.max(F.when(F.col("method").isin("control_lexical", "control_length", "control_random"), F.col("m"))).over(W.partitionBy("split"))
    return m.select("method", "split", F.round(best, 6).alias("strongest"), F.round(F.col("m") - best, 6).alias("separation"))


@book.add(F1_SQL + BASE.replace(", pa AS", ", ok AS (SELECT qid, coalesce(NOT failed AND NOT contains(lower(response), 'insufficient evidence') AND (em = 1 OR f1 >= 0.5), false) AS correct FROM sc), pa AS", 1) +
  "SELECT method, mq.split, count(*) AS n_all, count(*) FILTER (correct) AS n_agreement, round(avg(ap) FILTER (correct), 6) AS map_correct, round(avg(r2), 6) AS recall_all FROM mq JOIN ok USING (qid) GROUP BY method, mq.split")
def eval_attribution_summary(spark, sf):
    """Agreement covers questions answered correctly; diagnostics cover all."""
    ok = correct_marks(spark, sf).select("qid", "correct")
    m = method_metrics(spark, sf).join(ok, "qid").groupBy("method", "split")
    return m.agg(F.count(F.lit(1)).alias("n_all"), F.count_if("correct").alias("n_agreement"), F.round(F.avg(F.when(F.col("correct"), F.col("ap"))), 6).alias("map_correct"), F.round(F.avg("r2"), 6).alias("recall_all"))


@book.add(", d(method, mode) AS (VALUES ('citations', 'gold'), ('citations', 'generated'), ('leave_one_out', 'gold'), ('leave_one_out', 'generated'), ('contextcite', 'generated')), f(method, mode) AS (VALUES ('leave_one_out', 'gold'), ('citations', 'generated')) SELECT d.method, d.mode, CASE WHEN d.method = 'contextcite' THEN 'experimental' WHEN d.method = 'citations' AND d.mode = 'gold' THEN 'unsupported' WHEN f.method IS NOT NULL THEN 'complete' ELSE 'not_run' END AS status FROM d LEFT JOIN f USING (method, mode)")
def experiment_matrix(spark, sf):
    declared = spark.createDataFrame([("citations", "gold"), ("citations", "generated"), ("leave_one_out", "gold"), ("leave_one_out", "generated"), ("contextcite", "generated")], "method string, mode string")
    found = spark.createDataFrame([("leave_one_out", "gold"), ("citations", "generated")], "method string, mode string").withColumn("found", F.lit(True))
    status = F.when(F.col("method") == "contextcite", "experimental").when((F.col("method") == "citations") & (F.col("mode") == "gold"), "unsupported").when(F.col("found"), "complete").otherwise("not_run")
    return declared.join(found, ["method", "mode"], "left").select("method", "mode", status.alias("status"))


@book.add(BASE + "SELECT qid, len(list_filter(list(w), lambda x: x IS NULL OR isnan(x) OR isinf(x)))::BIGINT AS not_finite, count(*) = 10 AS complete FROM lo GROUP BY qid")
def score_validation(spark, sf):
    r = rows(spark, sf).withColumn("w", A.get_method("leave_one_out").score())
    bad = F.col("w").isNull() | F.isnan("w") | (F.abs("w") == float("inf"))
    return r.groupBy("qid").agg(F.count_if(bad).alias("not_finite"), (F.count(F.lit(1)) == 10).alias("complete"))


def correct_marks(spark, sf):
    g = scored_answers(spark, sf)
    ok = ~F.col("failed") & ~T.is_abstention("response") & ((F.col("em") == 1) | (F.col("f1") >= 0.5))
    return g.withColumn("correct", F.coalesce(ok, F.lit(False)))


OK = F1_SQL + ", ok AS (SELECT *, coalesce(NOT failed AND NOT contains(lower(response), 'insufficient evidence') AND (em = 1 OR f1 >= 0.5), false) AS correct FROM sc) "


@book.add(OK + "SELECT qid, correct FROM ok")
def correct_subset(spark, sf):
    return correct_marks(spark, sf).select("qid", "correct")


@book.add(OK + "SELECT pid FROM passages JOIN ok USING (qid) WHERE correct")
def join_semi_correct(spark, sf):
    return V.passages(spark, sf).join(correct_marks(spark, sf).where("correct").select("qid"), "qid", "left_semi").select("pid")


@book.add("SELECT split, count(*) AS n, count(*) FILTER (NOT failed) AS ok, count(*) FILTER (failed) AS failed, count(*) FILTER (contains(lower(response), 'insufficient evidence')) AS skipped FROM generations GROUP BY split")
def run_outcome_counts(spark, sf):
    return V.generations(spark, sf).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("failed")).alias("ok"), F.count_if("failed").alias("failed"), F.count_if(T.is_abstention("response")).alias("skipped")
    )


@book.add(OK + "SELECT qid, CASE WHEN failed THEN 'failed' WHEN contains(lower(response), 'insufficient evidence') THEN 'abstained' WHEN na = '' THEN 'empty_answer' END AS reason FROM ok")
def attribution_skip_reasons(spark, sf):
    reason = F.when(F.col("failed"), "failed").when(T.is_abstention("response"), "abstained").when(T.normalize_answer("said") == "", "empty_answer")
    return scored_answers(spark, sf).select("qid", reason.alias("reason"))


@book.add(OK + "SELECT qid, em AS recomputed, stored FROM (SELECT qid, em, CASE WHEN b % 17 = 0 THEN 1 - em ELSE em END AS stored FROM ok WHERE NOT failed) WHERE stored <> em")
def em_consistency_check(spark, sf):
    g = scored_answers(spark, sf).where("NOT failed")
    stored = F.when(T.bucket(F.concat(F.lit("gen:"), "qid")) % 17 == 0, 1 - F.col("em")).otherwise(F.col("em"))
    return g.select("qid", F.col("em").alias("recomputed"), stored.alias("stored")).where("recomputed <> stored")


CIT = BASE + """, cq AS (SELECT qid, split, response, cited, contains(lower(response), 'insufficient evidence') AS ab, count(*) FILTER (list_contains(cited, alias) AND is_gold) AS hit, count(*) FILTER (list_contains(cited, alias)) AS valid, count(*) FILTER (is_gold) AS n_gold
  FROM pa WHERE response IS NOT NULL GROUP BY ALL),
cs AS (SELECT *, CASE WHEN len(cited) = 0 THEN 0 ELSE hit / len(cited) END AS p, hit / n_gold AS r FROM cq)
"""


def citation_rows(spark, sf):
    """qid, split, ab, p, r, hit, n_gold, n_cited of answered questions; aliases that no passage has count as cited."""
    r = rows(spark, sf).where("response IS NOT NULL").withColumn("c", F.array_contains("cited", F.col("alias")))
    q = r.groupBy("qid", "split").agg(
        F.first(T.is_abstention("response")).alias("ab"), F.first(F.size("cited")).alias("n_cited"), F.count_if(F.col("c") & F.col("is_gold")).alias("hit"), F.count_if("is_gold").alias("n_gold")
    )
    return q.withColumn("p", F.coalesce(F.try_divide("hit", "n_cited"), F.lit(0.0))).withColumn("r", F.col("hit") / F.col("n_gold"))


@book.add(CIT + "SELECT split, count(*) AS n, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS f1, count(*) FILTER (len(cited) = 0) AS uncited FROM cs WHERE NOT ab GROUP BY split")
def citation_prf(spark, sf):
    p, r = F.col("p"), F.col("r")
    return citation_rows(spark, sf).where("NOT ab").groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("precision"), F.round(F.avg("r"), 6).alias("recall"),
        F.round(F.avg(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))), 6).alias("f1"), F.count_if(F.col("n_cited") == 0).alias("uncited"),
    )


@book.add(CIT + "SELECT split, round(avg(CASE WHEN ab THEN 0 ELSE r END), 6) AS coverage, round(avg((NOT ab AND hit = n_gold)::INT), 6) AS complete FROM cs GROUP BY split")
def citation_coverage(spark, sf):
    full = (~F.col("ab") & (F.col("hit") == F.col("n_gold"))).cast("int")
    return citation_rows(spark, sf).groupBy("split").agg(F.round(F.avg(F.when(F.col("ab"), 0.0).otherwise(F.col("r"))), 6).alias("coverage"), F.round(F.avg(full), 6).alias("complete"))


@book.add(OK + """SELECT split, count(*) AS n, round(count(*) FILTER (failed) / greatest(1, count(*)), 6) AS failure_rate, round(count(*) FILTER (contains(lower(response), 'insufficient evidence')) / greatest(1, count(*) FILTER (NOT failed)), 6) AS abstain_rate,
  round(avg(em) FILTER (NOT failed), 6) AS em, round(avg(f1) FILTER (NOT failed), 6) AS f1, round(sum(tokens) FILTER (NOT failed) * 1000.0 / sum(latency_ms) FILTER (NOT failed), 6)::DOUBLE AS tokens_per_s, quantile_disc(latency_ms::DOUBLE, 0.5) FILTER (NOT failed) AS p50 FROM ok GROUP BY split""")
def eval_generation_summary(spark, sf):
    ok = lambda c: F.when(~F.col("failed"), F.col(c))
    g = scored_answers(spark, sf).withColumn("lat", ok("latency_ms")).groupBy("split")
    n, good = F.count(F.lit(1)), F.count_if(~F.col("failed"))
    return g.agg(
        n.alias("n"), F.round(F.count_if("failed") / F.greatest(F.lit(1), n), 6).alias("failure_rate"), F.round(F.count_if(T.is_abstention("response")) / F.greatest(F.lit(1), good), 6).alias("abstain_rate"),
        F.round(F.avg(ok("em")), 6).alias("em"), F.round(F.avg(ok("f1")), 6).alias("f1"), F.round(F.sum(ok("tokens")) * 1000.0 / F.sum("lat"), 6).alias("tokens_per_s"), M.nearest_rank("lat", 0.5).alias("p50"),
    )
