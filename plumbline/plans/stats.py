"""Statistical queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.functions import text as T
from plumbline.operators import stats as S
from plumbline.plans import attribution as P
from plumbline.plans import retrieval
from plumbline.plans.book import Book
from plumbline.sources import fixture as V

book = Book()
QUERIES, ORACLES = book.queries, book.oracles
BUCKET = "(('0x' || substr(sha256({0}), 1, 8))::UBIGINT % {1})::BIGINT"


def metric(spark, sf, method, value="ap"):
    return P.method_metrics(spark, sf).where(F.col("method") == method).select("qid", "split", F.col(value).alias("value"))


def deltas(spark, sf):
    m = P.method_metrics(spark, sf).where("method IN ('leave_one_out', 'control_lexical')")
    own = lambda x: F.max(F.when(F.col("method") == x, F.col("ap")))
    return m.groupBy("split", "qid").agg((own("leave_one_out") - own("control_lexical")).alias("delta"))


DELTA = P.BASE + ", de AS (SELECT split, qid, max(ap) FILTER (method = 'leave_one_out') - max(ap) FILTER (method = 'control_lexical') AS delta FROM mq GROUP BY ALL)"


def boot(rows: str, group: str = "split", key: str = "qid", total: str = "delta", count: str = "1") -> str:
    """Tables m (group, r, m) and iv (group, low, high, p_above) after one of units."""
    weight = " + ".join(f"(u >= {t})::INT" for t in S.POISSON)
    return f""", bw AS (SELECT {group}, r, {total} AS s, {count} AS c, {weight} AS w FROM (SELECT *, ('0x' || substr(sha256('boot:' || (r // 8) || ':' || {key}), (1 + 8 * (r % 8))::INT, 8))::UBIGINT::DOUBLE / 4294967296 AS u
  FROM {rows}, (SELECT unnest(range(200)) AS r)) WHERE {total} IS NOT NULL),
bm0 AS (SELECT {group}, r, sum(w * s) / sum(w * c) AS m FROM bw GROUP BY ALL HAVING sum(w * c) > 0),
iv AS (SELECT {group}, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high, avg((m > 0)::INT) AS p_above FROM bm0 GROUP BY {group}) """


PAIRED = "SELECT split, count(delta) AS n, count(*) - count(delta) AS n_excluded, round(avg(delta), 6) AS mean, round(max(low), 6) AS low, round(max(high), 6) AS high, round(max(p_above), 6) AS p_above FROM {} LEFT JOIN iv USING (split) GROUP BY split"


def paired(b):
    return b.select("split", "n", "n_excluded", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high", "p_above")])


@book.add(DELTA + boot("de") + PAIRED.format("de"))
def paired_bootstrap_hash(spark, sf):
    return paired(S.hashed_bootstrap(deltas(spark, sf), "split"))


@book.add()
def paired_bootstrap(spark, sf):
    return S.seeded_bootstrap(deltas(spark, sf), "split", 2000)


@book.add(DELTA + "SELECT split, round(quantile_cont(delta, 0.25), 6) AS q25, round(quantile_cont(delta, 0.5), 6) AS q50, round(quantile_cont(delta, 0.975), 6) AS q975 FROM de GROUP BY split")
def quantile_linear(spark, sf):
    q = lambda p, name: F.round(F.percentile("delta", F.lit(p)), 6).alias(name)
    return deltas(spark, sf).groupBy("split").agg(q(0.25, "q25"), q(0.5, "q50"), q(0.975, "q975"))


@book.add(P.BASE + ", a AS (SELECT qid, ap AS value FROM mq WHERE method = 'leave_one_out' AND right(qid, 1) <> '3'), b AS (SELECT qid, CASE WHEN right(qid, 1) <> '5' THEN ap END AS value FROM mq WHERE method = 'control_lexical' AND right(qid, 1) <> '7') SELECT count(*) FILTER (a.value IS NOT NULL AND b.value IS NOT NULL) AS n, count(*) FILTER (a.qid IS NULL) AS only_comparator, count(*) FILTER (b.qid IS NULL) AS only_candidate, round(avg(a.value - b.value), 6) AS mean_delta FROM a FULL JOIN b USING (qid)")
def join_outer_alignment(spark, sf):
    a = metric(spark, sf, "leave_one_out").where(F.right("qid", F.lit(1)) != "3").withColumn("l", F.lit(1))
    b = metric(spark, sf, "control_lexical").where(F.right("qid", F.lit(1)) != "7").withColumn("r", F.lit(1))
    b = b.withColumn("comparator", F.when(F.right("qid", F.lit(1)) != "5", F.col("value"))).select("qid", "comparator", "r")
    j = a.select("qid", F.col("value").alias("candidate"), "l").join(b, "qid", "full_outer")
    both = F.col("candidate").isNotNull() & F.col("comparator").isNotNull()
    return j.agg(F.count_if(both).alias("n"), F.count_if(F.col("l").isNull()).alias("only_comparator"), F.count_if(F.col("r").isNull()).alias("only_candidate"), F.round(F.avg(F.col("candidate") - F.col("comparator")), 6).alias("mean_delta"))


@book.add(P.BASE + ", m AS (SELECT split, method, avg(ap) AS ap, avg(ndcg) AS nd, avg(r2) AS r2 FROM mq GROUP BY ALL) SELECT a.split, a.method AS candidate, b.method AS comparator, u.metric, round(CASE u.metric WHEN 'ap' THEN a.ap - b.ap WHEN 'ndcg' THEN a.nd - b.nd ELSE a.r2 - b.r2 END, 6) AS delta FROM m a JOIN m b ON a.split = b.split AND a.method <> b.method, (VALUES ('ap'), ('ndcg'), ('recall')) u(metric) WHERE a.method = 'leave_one_out'")
def method_comparisons(spark, sf):
    m = P.method_metrics(spark, sf).groupBy("split", "method").agg(F.avg("ap").alias("ap"), F.avg("ndcg").alias("ndcg"), F.avg("r2").alias("recall"))
    long = m.unpivot(["split", "method"], ["ap", "ndcg", "recall"], "metric", "value")
    a = long.where("method = 'leave_one_out'").withColumnsRenamed({"method": "candidate", "value": "x"})
    b = long.withColumnsRenamed({"method": "comparator", "value": "y"})
    return a.join(b, ["split", "metric"]).where("candidate <> comparator").select("split", "candidate", "comparator", "metric", F.round(F.col("x") - F.col("y"), 6).alias("delta"))


@book.add(P.BASE + ", m AS (SELECT split, avg(ap) FILTER (method = 'oracle_gold') - avg(ap) FILTER (method = 'control_random') AS x, avg(ndcg) FILTER (method = 'oracle_gold') - avg(ndcg) FILTER (method = 'control_random') AS y, count(*) AS n FROM mq GROUP BY split) SELECT split, CASE WHEN n = 0 THEN 'not_run' WHEN x > 1e-9 AND y > 1e-9 THEN 'passed' ELSE 'failed' END AS status FROM m")
def construct_validation(spark, sf):
    own = lambda m, c: F.avg(F.when(F.col("method") == m, F.col(c)))
    gap = lambda c: own("oracle_gold", c) - own("control_random", c)
    m = P.method_metrics(spark, sf).groupBy("split").agg(gap("ap").alias("x"), gap("ndcg").alias("y"), F.count(F.lit(1)).alias("n"))
    status = F.when(F.col("n") == 0, "not_run").when((F.col("x") > 1e-9) & (F.col("y") > 1e-9), "passed").otherwise("failed")
    return m.select("split", status.alias("status"))


WILSON = "round(greatest(0, (k / n + {z2} / (2 * n)) / (1 + {z2} / n) - {z} * sqrt(k / n * (1 - k / n) / n + {z2} / (4 * n * n)) / (1 + {z2} / n)), 6)::DOUBLE AS low, round(least(1, (k / n + {z2} / (2 * n)) / (1 + {z2} / n) + {z} * sqrt(k / n * (1 - k / n) / n + {z2} / (4 * n * n)) / (1 + {z2} / n)), 6)::DOUBLE AS high".format(z=f"{S.Z95}::DOUBLE", z2=f"{S.Z95 * S.Z95}::DOUBLE")


@book.add(f"SELECT l_returnflag, k, n, {WILSON} FROM (SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS k, count(*) AS n FROM lineitem GROUP BY l_returnflag)", view=False)
def wilson_interval(spark, sf):
    c = V.read(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_linestatus") == "F").alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = S.wilson("k", "n")
    return c.select("l_returnflag", "k", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@book.add(f", t AS (SELECT split, qid, {BUCKET.format(chr(39) + 'p:' + chr(39) + ' || qid', 10000)} / 100000 AS p FROM questions), s AS (SELECT *, least(1, (count(*) OVER (PARTITION BY split) - row_number() OVER (PARTITION BY split ORDER BY p, qid) + 1) * p) AS st FROM t) SELECT split, qid, round(max(st) OVER (PARTITION BY split ORDER BY p, qid ROWS UNBOUNDED PRECEDING), 6)::DOUBLE AS adjusted FROM s")
def holm_adjust(spark, sf):
    t = V.questions(spark, sf).select("split", "qid", (T.bucket(F.concat(F.lit("p:"), "qid"), 10000) / 100000).alias("p"))
    return S.holm(t, "split", "qid", "p").select("split", "qid", F.round("adjusted", 6).alias("adjusted"))


CLUSTER = """WITH ob AS (SELECT o_custkey AS cluster_id, l_orderkey AS parent_id, l_linenumber AS variant, l_discount - l_tax AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
du AS (SELECT coalesce(sum(k - 1), 0)::BIGINT AS n_duplicates, coalesce(sum(z), 0)::BIGINT AS n_excluded FROM (SELECT count(*) AS k, count(*) FILTER (d IS NULL) AS z FROM ob GROUP BY parent_id, variant)),
sp AS (SELECT count(*) FILTER (a <> b) AS n_split_parents FROM (SELECT min(cluster_id) AS a, max(cluster_id) AS b FROM ob GROUP BY parent_id)),
cl AS (SELECT 1 AS one, cluster_id, sum(d) AS s, count(*) AS c FROM (SELECT cluster_id, parent_id, avg(d) AS d FROM ob WHERE d IS NOT NULL GROUP BY ALL) GROUP BY cluster_id)""" + boot("cl", "one", "cluster_id", "s", "c") + """
SELECT count(*) AS n_clusters, sum(c)::BIGINT AS n_parents, max(n_excluded) AS n_excluded, max(n_duplicates) AS n_duplicates, max(n_split_parents) AS n_split_parents,
  CASE WHEN max(n_duplicates) = 0 AND max(n_split_parents) = 0 THEN round(sum(s) / sum(c), 6) END AS estimate, CASE WHEN max(n_duplicates) = 0 AND max(n_split_parents) = 0 THEN round(max(low), 6) END AS low,
  CASE WHEN max(n_duplicates) = 0 AND max(n_split_parents) = 0 THEN round(max(high), 6) END AS high, CASE WHEN max(n_duplicates) = 0 AND max(n_split_parents) = 0 THEN round(max(p_above), 6) END AS p_above FROM cl JOIN iv USING (one), du, sp"""


@book.add(CLUSTER, view=False)
def cluster_bootstrap(spark, sf):
    """Customers are clusters, their orders parents and an order's lines its variants."""
    o = V.read(spark, sf, "orders").select(F.col("o_orderkey").alias("parent_id"), F.col("o_custkey").alias("cluster_id"))
    x = V.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("parent_id"), F.col("l_linenumber").alias("variant"), F.col("l_discount").alias("candidate"), F.col("l_tax").alias("comparator"))
    got = S.cluster_bootstrap(S.join_in_parts(x, o, "parent_id"))
    return got.select(*got.columns[:5], *[F.round(c, 6).alias(c) for c in got.columns[5:]])


AGREE = """, c AS (SELECT * FROM pr WHERE a IS NOT NULL AND b IS NOT NULL), n AS (SELECT count(*) AS n, avg((a = b)::INT) AS raw FROM c),
la AS (SELECT a AS l, count(*) AS k FROM c GROUP BY a), lb AS (SELECT b AS l, count(*) AS k FROM c GROUP BY b),
pe AS (SELECT coalesce(sum(la.k * lb.k), 0) / pow((SELECT n FROM n), 2) AS pe FROM la JOIN lb USING (l)),
po AS (SELECT l, count(*) AS k FROM (SELECT a AS l FROM pr UNION ALL SELECT b FROM pr) WHERE l IS NOT NULL GROUP BY l), ex AS (SELECT 1 - sum(k * (k - 1)) / (sum(k) * (sum(k) - 1)) AS de FROM po)
SELECT n, round(raw, 6) AS raw, round(CASE WHEN pe < 1 THEN (raw - pe) / (1 - pe) END, 6) AS kappa, round(CASE WHEN de > 0 THEN 1 - (1 - raw) / de ELSE 1 END, 6)::DOUBLE AS alpha FROM n, pe, ex"""


@book.add("WITH pr AS (SELECT CASE WHEN l_returnflag = 'N' THEN 'O' ELSE 'F' END AS a, CASE WHEN l_linenumber % 19 = 0 THEN NULL ELSE l_linestatus END AS b FROM lineitem)" + AGREE, view=False)
def nominal_agreement(spark, sf):
    a = F.when(F.col("l_returnflag") == "N", "O").otherwise("F")
    b = F.when(F.col("l_linenumber") % 19 != 0, F.col("l_linestatus"))
    r = S.nominal_agreement(V.read(spark, sf, "lineitem").select(a.alias("a"), b.alias("b")))
    return r.select("n", *[F.round(c, 6).alias(c) for c in ("raw", "kappa", "alpha")])


FAM = f""", an AS (SELECT qid, [['P1.S1', 'P' || (2 + {BUCKET.format("'e1:' || qid", 3)}) || '.S1'], ['P3.S1']] AS x, [['P' || (2 + {BUCKET.format("'e2:' || qid", 3)}) || '.S1', 'P1.S1'], ['P3.S1', 'P3.S2']] AS y,
  {BUCKET.format("'ans:' || qid", 100)} < 70 AS bothans FROM questions),
ag AS (SELECT *, (list_avg(list_transform(x, lambda s: list_max(list_transform(y, lambda t: len(list_intersect(s, t)) / len(list_distinct(list_concat(s, t))))))) + list_avg(list_transform(y, lambda t: list_max(list_transform(x, lambda s: len(list_intersect(s, t)) / len(list_distinct(list_concat(s, t)))))))) / 2 AS jac,
  (list_avg(list_transform(x, lambda s: list_max(list_transform(y, lambda t: 2 * len(list_intersect(s, t)) / (len(s) + len(t)))))) + list_avg(list_transform(y, lambda t: list_max(list_transform(x, lambda s: 2 * len(list_intersect(s, t)) / (len(s) + len(t))))))) / 2 AS f1 FROM an)
"""


def evidence(spark, sf):
    p = lambda s: F.concat(F.lit("P"), 2 + T.bucket(F.concat(F.lit(s), "qid"), 3), F.lit(".S1"))
    x = F.array(F.array(F.lit("P1.S1"), p("e1:")), F.array(F.lit("P3.S1")))
    y = F.array(F.array(p("e2:"), F.lit("P1.S1")), F.array(F.lit("P3.S1"), F.lit("P3.S2")))
    rows = V.questions(spark, sf).select("qid", x.alias("x"), y.alias("y"), (T.bucket(F.concat(F.lit("ans:"), "qid")) < 70).alias("both"))
    jac, f1 = S.family_agreement(F.col("x"), F.col("y"))
    return rows.select("qid", "both", jac.alias("jac"), f1.alias("f1"))


@book.add(FAM + "SELECT qid, round(jac, 6) AS jaccard, round(f1, 6) AS f1 FROM ag")
def evidence_agreement(spark, sf):
    return evidence(spark, sf).select("qid", F.round("jac", 6).alias("jaccard"), F.round("f1", 6).alias("f1"))


@book.add(FAM + "SELECT count(*) FILTER (bothans) AS n, count(*) FILTER (NOT bothans) AS excluded, round(avg(jac) FILTER (bothans), 6) AS jaccard, round(avg(f1) FILTER (bothans), 6) AS f1 FROM ag")
def evidence_agreement_summary(spark, sf):
    own = lambda c: F.round(F.avg(F.when(F.col("both"), F.col(c))), 6)
    return evidence(spark, sf).agg(F.count_if("both").alias("n"), F.count_if(~F.col("both")).alias("excluded"), own("jac").alias("jaccard"), own("f1").alias("f1"))


@book.add("SELECT user_id % 7 AS annotator, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(min(value), 6) AS least, round(max(value), 6) AS most FROM events WHERE value IS NOT NULL GROUP BY 1", view=False)
def annotator_timing(spark, sf):
    e = V.read(spark, sf, "events").where("value IS NOT NULL").groupBy((F.col("user_id") % 7).alias("annotator"))
    return e.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.median("value"), 6).alias("median"), F.round(F.min("value"), 6).alias("least"), F.round(F.max("value"), 6).alias("most"))


@book.add("SELECT split, qtype, level, count(*) AS n FROM questions GROUP BY ALL")
def split_distributions(spark, sf):
    return V.questions(spark, sf).groupBy("split", "qtype", "level").agg(F.count(F.lit(1)).alias("n"))


@book.add("SELECT title, count(DISTINCT split) AS n_splits FROM passages JOIN questions USING (qid) WHERE title <> '' GROUP BY title HAVING count(DISTINCT split) > 1")
def overlap_audit(spark, sf):
    t = V.passages(spark, sf).where("title <> ''").join(V.questions(spark, sf).select("qid", "split"), "qid")
    return t.groupBy("title").agg(F.count_distinct("split").alias("n_splits")).where("n_splits > 1")


ARMS = retrieval.RANKED + ", ar AS (SELECT q.qid, q.split, q.qtype, q.level, max(ndcg) FILTER (method = 'hybrid_rrf_rerank') AS cand, max(ndcg) FILTER (method = 'hybrid_rrf') AS base FROM pq JOIN questions q USING (qid) GROUP BY ALL) "


def arms(spark, sf):
    """qid, split, qtype, level, cand, base: nDCG with and without reranking."""
    from plumbline.operators import metrics as M

    m = retrieval.marked(spark, sf).where("method IN ('hybrid_rrf_rerank', 'hybrid_rrf')").groupBy("method", "qid").agg(M.ndcg_at(10).alias("nd"))
    own = lambda x: F.max(F.when(F.col("method") == x, F.col("nd")))
    wide = m.groupBy("qid").agg(own("hybrid_rrf_rerank").alias("cand"), own("hybrid_rrf").alias("base"))
    return V.questions(spark, sf).select("qid", "split", "qtype", "level").join(wide, "qid")


def direction(c):
    return F.when(c > 1e-9, "better").when(c < -1e-9, "worse").otherwise("same")


@book.add(ARMS + "SELECT qid, round(cand - base, 6) AS delta, CASE WHEN cand - base > 1e-9 THEN 'better' WHEN cand - base < -1e-9 THEN 'worse' ELSE 'same' END AS direction FROM ar")
def rerank_error_analysis(spark, sf):
    d = F.col("cand") - F.col("base")
    return arms(spark, sf).select("qid", F.round(d, 6).alias("delta"), direction(d).alias("direction"))


@book.add(ARMS + "SELECT qtype, level, count(*) AS n, round(avg(cand - base), 6) AS delta FROM ar GROUP BY GROUPING SETS ((qtype), (level))")
def rerank_group_analysis(spark, sf):
    sets = arms(spark, sf).groupingSets([["qtype"], ["level"]], "qtype", "level")
    return sets.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("cand") - F.col("base")), 6).alias("delta"))


@book.add(ARMS + ", g AS (SELECT qid, (('0x' || substr(sha256('gen:' || qid), 1, 8))::UBIGINT % 3)::BIGINT - 1 AS answer_delta, cand - base AS d FROM ar) SELECT CASE WHEN d > 1e-9 AND answer_delta > 0 THEN 'both_gain' WHEN d > 1e-9 THEN 'retrieval_only' WHEN d < -1e-9 AND answer_delta < 0 THEN 'both_loss' WHEN d < -1e-9 THEN 'retrieval_loss_only' WHEN answer_delta <> 0 THEN 'answer_only' ELSE 'unchanged' END AS class, count(*) AS n FROM g GROUP BY 1")
def transfer_taxonomy(spark, sf):
    a = arms(spark, sf).withColumn("answer_delta", T.bucket(F.concat(F.lit("gen:"), "qid"), 3) - 1).withColumn("d", F.col("cand") - F.col("base"))
    kind = (
        F.when((F.col("d") > 1e-9) & (F.col("answer_delta") > 0), "both_gain").when(F.col("d") > 1e-9, "retrieval_only").when((F.col("d") < -1e-9) & (F.col("answer_delta") < 0), "both_loss")
        .when(F.col("d") < -1e-9, "retrieval_loss_only").when(F.col("answer_delta") != 0, "answer_only").otherwise("unchanged")
    )
    return a.groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("n"))


@book.add(ARMS + "SELECT split, round(avg(cand - base), 6) AS delta, CASE WHEN count(*) = 0 THEN 'not_run' WHEN avg(cand - base) >= 0.02 AND min(cand - base) >= -1 THEN 'adopt' WHEN avg(cand - base) >= 0 THEN 'hold' ELSE 'reject' END AS decision FROM ar GROUP BY split")
def rerank_decision_gate(spark, sf):
    d = F.col("cand") - F.col("base")
    choice = F.when(F.count(F.lit(1)) == 0, "not_run").when((F.avg(d) >= 0.02) & (F.min(d) >= -1), "adopt").when(F.avg(d) >= 0, "hold").otherwise("reject")
    return arms(spark, sf).groupBy("split").agg(F.round(F.avg(d), 6).alias("delta"), choice.alias("decision"))


@book.add(ARMS.rstrip() + ", ad AS (SELECT split, qid, cand - base AS delta FROM ar)" + boot("ad") + PAIRED.format("ad"))
def rerank_paired_bootstrap(spark, sf):
    d = arms(spark, sf).select("split", "qid", (F.col("cand") - F.col("base")).alias("delta"))
    return paired(S.hashed_bootstrap(d, "split"))


@book.add(ARMS + "SELECT qid, round(cand, 6) AS candidate, round(base, 6) AS baseline, failed FROM ar JOIN generations USING (qid)")
def join_star_arms(spark, sf):
    g = V.generations(spark, sf).select("qid", "failed")
    return arms(spark, sf).join(g, "qid", "left").select("qid", F.round("cand", 6).alias("candidate"), F.round("base", 6).alias("baseline"), "failed")


@book.add("SELECT event_type, max(ts) AS snapshot FROM events GROUP BY event_type", view=False)
def source_snapshot(spark, sf):
    return V.read(spark, sf, "events").groupBy("event_type").agg(F.max("ts").alias("snapshot"))
