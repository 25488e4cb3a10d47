"""Retrieval, reranking and ranking-metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import metrics as M
from plumbline.operators import ranking as R
from plumbline.plans.book import Book
from plumbline.sources import fixture as V

book = Book()
QUERIES, ORACLES = book.queries, book.oracles

RANKED = """
, tk AS (SELECT qid, pid, idx, regexp_extract_all(lower(concat_ws(' ', title, body)), '[a-z0-9]+') AS t FROM passages),
co AS (SELECT qid, count(*) AS n, avg(len(t)) AS avgdl FROM tk GROUP BY qid),
tf AS (SELECT qid, pid, dl, term, count(*) AS tf FROM (SELECT qid, pid, len(t) AS dl, unnest(t) AS term FROM tk) GROUP BY ALL),
df0 AS (SELECT qid, term, count(*) AS df FROM tf GROUP BY ALL),
df1 AS (SELECT qid, term, avgdl, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df0 JOIN co USING (qid)),
df AS (SELECT qid, term, avgdl, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY qid) ELSE raw END AS idf FROM df1),
qt AS (SELECT qid, term, count(*) AS qn FROM (SELECT qid, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) AS term FROM questions) GROUP BY ALL),
bs AS (SELECT pid, sum(qn * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN qt USING (qid, term) JOIN df USING (qid, term) GROUP BY pid),
bm AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, idx) AS rank FROM (SELECT tk.qid, tk.pid, idx, coalesce(score, 0) AS score FROM tk LEFT JOIN bs USING (pid))),
dn AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, idx) AS rank FROM (SELECT p.qid, p.pid, p.idx, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS score
  FROM passages p JOIN vectors a ON a.vec_id = p.doc_id % (SELECT count(*) FROM embeddings) JOIN gold g ON g.qid = p.qid AND g.grank = 1 JOIN vectors b ON b.vec_id = g.doc_id % (SELECT count(*) FROM embeddings))),
hy AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, idx) AS rank FROM (SELECT bm.qid, pid, bm.idx, 1.0 / (60 + bm.rank) + 1.0 / (60 + dn.rank) AS score FROM bm JOIN dn USING (pid))),
rc AS (SELECT hy.*, rank AS source_rank, (length(question) + 2 * length(body))::DOUBLE AS rr FROM hy JOIN passages USING (pid) JOIN questions ON questions.qid = hy.qid),
rk AS (SELECT * EXCLUDE (rank, score), row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, source_rank) AS rank, score FROM (SELECT * EXCLUDE (score), source_rank <= 5 AS was_reranked,
  CASE WHEN source_rank <= 5 THEN rr ELSE min(rr) FILTER (source_rank <= 5) OVER (PARTITION BY qid) - 1 - (source_rank - 6) END AS score FROM rc)),
al AS (SELECT 'bm25' AS method, qid, pid, idx, rank, score FROM bm UNION ALL SELECT 'dense', qid, pid, idx, rank, score FROM dn UNION ALL SELECT 'hybrid_rrf', qid, pid, idx, rank, score FROM hy
  UNION ALL SELECT 'hybrid_rrf_rerank', qid, pid, idx, rank, score FROM rk),
mk AS (SELECT al.*, g.pid IS NOT NULL AS is_gold FROM al LEFT JOIN gold g USING (pid)),
pq AS (SELECT method, qid, count(*) FILTER (is_gold AND rank <= 2) / count(*) FILTER (is_gold) AS r2, count(*) FILTER (is_gold AND rank <= 5) / count(*) FILTER (is_gold) AS r5,
  count(*) FILTER (is_gold AND rank <= 10) / count(*) FILTER (is_gold) AS r10, coalesce(1.0 / min(rank) FILTER (is_gold), 0) AS mrr,
  sum(CASE WHEN is_gold AND rank <= 10 THEN 1.0 / log2(rank + 1) ELSE 0 END) / list_sum(list_transform(range(1, least(count(*) FILTER (is_gold), 10) + 1), lambda i: 1.0 / log2(i + 1))) AS ndcg,
  bool_and(rank <= 5) FILTER (is_gold) AS covered FROM mk GROUP BY method, qid),
la AS (SELECT m.method, q.qid, q.split, (('0x' || substr(sha256(m.method || ':' || q.qid), 1, 8))::UBIGINT % 1000)::BIGINT + 1 AS latency_ms, (('0x' || substr(sha256('err:' || m.method || ':' || q.qid), 1, 8))::UBIGINT % 100)::BIGINT < 3 AS failed,
  (('0x' || substr(sha256('hit:' || m.method || ':' || q.qid), 1, 8))::UBIGINT % 11)::BIGINT AS hits FROM questions q, (VALUES ('bm25'), ('dense'), ('hybrid_rrf'), ('hybrid_rrf_rerank')) m(method))
"""
METHODS = ("bm25", "dense", "hybrid_rrf", "hybrid_rrf_rerank")


def sourced(spark, sf):
    """Passages as ranking reads them; a passage's length is that of its lines joined by single spaces."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return V.vector_of(spark, sf, V.texts(spark, sf)).withColumn("chars", F.length(F.array_join(lines, " "))).withColumnRenamed("text", "body")


def bm25(spark, sf):
    return R.rank_by_score(R.bm25(V.texts(spark, sf).withColumnRenamed("text", "body"), V.questions(spark, sf)))


def dense_scores(spark, sf):
    asked = V.vector_of(spark, sf, V.gold_heads(spark, sf).where("grank = 1"))
    return R.dense(sourced(spark, sf), asked, V.vectors(spark, sf))


def dense(spark, sf):
    return R.rank_by_score(dense_scores(spark, sf))


def wide(spark, sf, k=5):
    """One row for each passage with its score and rank by every method and is_gold.

    BM25 scores meet their question's dense scores and gold ids by qid; all ranks are then windows over that partitioning.
    """
    rows = R.bm25(sourced(spark, sf), V.questions(spark, sf), keep=("chars",))
    own = dense_scores(spark, sf).groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("pid", "score"))).alias("near"))
    gold = V.gold_heads(spark, sf).groupBy("qid").agg(F.collect_list("pid").alias("gold"))
    rows = rows.join(own, "qid").join(gold, "qid", "left").select(
        "qid", "pid", "idx", F.col("score").alias("bm25"), F.col("near")[F.col("pid")].alias("dense"),
        R.stub_rerank_score(F.col("question"), F.col("chars")).alias("rerank_score"),
        F.coalesce(F.array_contains("gold", F.col("pid")), F.lit(False)).alias("is_gold"),
    ).where("dense IS NOT NULL")
    for m in ("bm25", "dense"):
        rows = R.rank_by_score(rows, score=m, out=f"{m}_rank")
    rows = R.rank_by_score(rows.withColumn("hybrid_rrf", R.reciprocal(F.col("bm25_rank")) + R.reciprocal(F.col("dense_rank"))), score="hybrid_rrf", out="rank")
    return R.rerank(rows.withColumn("hybrid_rrf_rank", F.col("rank")), k)


def hybrid(spark, sf):
    return wide(spark, sf).select("qid", "pid", "idx", F.col("hybrid_rrf").alias("score"), F.col("hybrid_rrf_rank").alias("rank"))


def reranked(spark, sf, k=5):
    return wide(spark, sf, k).select("qid", "pid", "idx", "score", "rank", "source_rank", "was_reranked")


def all_methods(spark, sf):
    """method, qid, pid, idx, rank, score, is_gold."""
    part = lambda m, score, rank: F.struct(F.lit(m).alias("method"), F.col(rank).alias("rank"), F.col(score).alias("score"))
    parts = [part(m, m, f"{m}_rank") for m in METHODS[:3]] + [part(METHODS[3], "score", "rank")]
    rows = wide(spark, sf).select("qid", "pid", "idx", "is_gold", F.explode(F.array(*parts)).alias("m"))
    return rows.select("m.method", "qid", "pid", "idx", "m.rank", "m.score", "is_gold")


def runs(spark, sf):
    """method, qid, split, latency_ms, failed, hits of each method's run of each question."""
    q = V.questions(spark, sf).select("qid", "split", F.explode(F.array(*[F.lit(m) for m in METHODS])).alias("method"))
    key = F.concat_ws(":", "method", "qid")
    return q.select(
        "method", "qid", "split", (T.bucket(key, 1000) + 1).alias("latency_ms"), (T.bucket(F.concat(F.lit("err:"), key)) < 3).alias("failed"),
        T.bucket(F.concat(F.lit("hit:"), key), 11).alias("hits"),
    )


def marked(spark, sf):
    return all_methods(spark, sf)


@book.add(RANKED + "SELECT qid, pid, round(score, 6) AS score, rank FROM bm")
def bm25_per_question(spark, sf):
    return bm25(spark, sf).select("qid", "pid", F.round("score", 6).alias("score"), "rank")


@book.add(RANKED + "SELECT qid, pid, round(score, 6) AS score, rank FROM dn")
def dense_cosine_rank(spark, sf):
    return dense(spark, sf).select("qid", "pid", F.round("score", 6).alias("score"), "rank")


@book.add(RANKED + "SELECT qid, pid, round(score, 9)::DOUBLE AS score, rank FROM hy")
def hybrid_rrf(spark, sf):
    return hybrid(spark, sf).select("qid", "pid", F.round("score", 9).alias("score"), "rank")


@book.add(RANKED + "SELECT qid, pid, rank, source_rank, was_reranked FROM rk")
def hybrid_rrf_rerank(spark, sf):
    return reranked(spark, sf).select("qid", "pid", "rank", "source_rank", "was_reranked")


@book.add(RANKED + "SELECT qid, pid, round(score, 6)::DOUBLE AS score, rank FROM rk WHERE NOT was_reranked")
def rerank_with_tail(spark, sf):
    return reranked(spark, sf).where("NOT was_reranked").select("qid", "pid", F.round("score", 6).alias("score"), "rank")


@book.add("SELECT qid, pid, length(body) % 7 AS score, row_number() OVER (PARTITION BY qid ORDER BY length(body) % 7 DESC, idx) AS rank FROM passages")
def rank_tiebreak(spark, sf):
    rows = V.passages(spark, sf).select("qid", "pid", "idx", (F.length("body") % 7).cast("long").alias("score"))
    return R.rank_by_score(rows).drop("idx")


@book.add(RANKED + "SELECT qid, pid, rank FROM bm WHERE rank <= 2")
def topk_passages(spark, sf):
    return R.top_k(bm25(spark, sf), 2).select("qid", "pid", "rank")


@book.add(RANKED + "SELECT qid, rank AS position, pid, title FROM hy JOIN passages USING (qid, pid) WHERE rank <= 5")
def context_topk(spark, sf):
    kept = R.top_k(hybrid(spark, sf), 5).select("pid", F.col("rank").alias("position"))
    return V.passages(spark, sf).join(kept, "pid").select("qid", "position", "pid", "title")


@book.add("SELECT qid, row_number() OVER (ORDER BY sha256('7:' || qid)) AS position FROM questions")
def seeded_group_order(spark, sf):
    keyed = V.questions(spark, sf).select("qid", F.sha2(F.concat(F.lit("7:"), "qid"), 256).alias("h"))
    return R.place_by_hash(keyed, "h", out="position").select("qid", "position")


@book.add(RANKED + "SELECT qid, round(r2, 6) AS recall_at_2, round(r5, 6) AS recall_at_5, round(r10, 6) AS recall_at_10 FROM pq WHERE method = 'bm25'")
def recall_at_k(spark, sf):
    gold = V.gold_heads(spark, sf).groupBy("qid").agg(F.collect_list("pid").alias("gold"))
    m = bm25(spark, sf).join(gold, "qid", "left").withColumn("is_gold", F.coalesce(F.array_contains("gold", F.col("pid")), F.lit(False)))
    return m.groupBy("qid").agg(*[F.round(M.recall_at(k), 6).alias(f"recall_at_{k}") for k in (2, 5, 10)])


@book.add(RANKED + "SELECT method, qid, round(mrr, 6)::DOUBLE AS mrr FROM pq")
def mrr(spark, sf):
    return marked(spark, sf).groupBy("qid", "method").agg(F.round(M.reciprocal_rank(), 6).alias("mrr"))


@book.add(RANKED + "SELECT method, qid, round(ndcg, 6)::DOUBLE AS ndcg_at_10 FROM pq")
def ndcg_at_k(spark, sf):
    return marked(spark, sf).groupBy("qid", "method").agg(F.round(M.ndcg_at(10), 6).alias("ndcg_at_10"))


@book.add(RANKED + "SELECT method, qid, covered FROM pq")
def complete_coverage_at_k(spark, sf):
    return marked(spark, sf).groupBy("qid", "method").agg(M.covered_at(5).alias("covered"))


@book.add(RANKED + "SELECT method, round(avg(latency_ms), 6) AS mean, quantile_disc(latency_ms::DOUBLE, 0.5) AS p50, quantile_disc(latency_ms::DOUBLE, 0.95) AS p95 FROM la WHERE NOT failed GROUP BY method")
def latency_percentiles(spark, sf):
    return runs(spark, sf).where("NOT failed").groupBy("method").agg(
        F.round(F.avg("latency_ms"), 6).alias("mean"), M.nearest_rank("latency_ms", 0.5).alias("p50"), M.nearest_rank("latency_ms", 0.95).alias("p95")
    )


@book.add("SELECT l_returnflag, quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.95) AS p95, count(*) AS n FROM lineitem GROUP BY l_returnflag", view=False)
def lineitem_percentiles(spark, sf):
    rows = V.read(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice").groupBy("l_returnflag")
    return rows.agg(M.nearest_rank("l_extendedprice", 0.5).alias("p50"), M.nearest_rank("l_extendedprice", 0.95).alias("p95"), F.count(F.lit(1)).alias("n"))


SUMMARY = """SELECT split, method, count(*) AS n, count(*) FILTER (failed) AS n_failed, round(count(*) FILTER (failed) / count(*), 6) AS failure_rate,
  round(avg(r2) FILTER (NOT failed), 6) AS recall_at_2, round(avg(r5) FILTER (NOT failed), 6) AS recall_at_5, round(avg(mrr) FILTER (NOT failed), 6) AS mrr, round(avg(ndcg) FILTER (NOT failed), 6) AS ndcg_at_10,
  round(avg(covered::INT) FILTER (NOT failed), 6) AS coverage, quantile_disc(latency_ms::DOUBLE, 0.95) FILTER (NOT failed) AS p95 FROM la JOIN pq USING (method, qid) GROUP BY split, method"""


@book.add(RANKED + SUMMARY)
def eval_retrieval_summary(spark, sf):
    per = marked(spark, sf).groupBy("qid", "method").agg(
        M.recall_at(2).alias("r2"), M.recall_at(5).alias("r5"), M.reciprocal_rank().alias("rr"), M.ndcg_at(10).alias("nd"), M.covered_at(5).alias("cv")
    )
    rows = runs(spark, sf).join(per, ["qid", "method"])
    ok = lambda c: F.when(~F.col("failed"), c)
    mean = lambda c, name: F.round(F.avg(ok(F.col(c))), 6).alias(name)
    return rows.withColumn("cv", F.col("cv").cast("int")).withColumn("lat", ok(F.col("latency_ms"))).groupBy("split", "method").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("n_failed"), F.round(F.count_if("failed") / F.count(F.lit(1)), 6).alias("failure_rate"),
        mean("r2", "recall_at_2"), mean("r5", "recall_at_5"), mean("rr", "mrr"), mean("nd", "ndcg_at_10"), mean("cv", "coverage"), M.nearest_rank("lat", 0.95).alias("p95"),
    )


@book.add(RANKED + "SELECT CASE WHEN hits = 0 THEN 'cold' WHEN hits = 10 THEN 'warm' ELSE 'mixed' END AS class, count(*) AS n, round(avg(latency_ms), 6) AS mean_ms, max(latency_ms) AS max_ms FROM la WHERE method = 'hybrid_rrf_rerank' GROUP BY 1")
def rerank_cache_classes(spark, sf):
    kind = F.when(F.col("hits") == 0, "cold").when(F.col("hits") == 10, "warm").otherwise("mixed")
    rows = runs(spark, sf).where("method = 'hybrid_rrf_rerank'").groupBy(kind.alias("class"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("latency_ms"), 6).alias("mean_ms"), F.max("latency_ms").alias("max_ms"))


@book.add(RANKED + "SELECT method, sum(hits)::BIGINT AS hits, sum(10 - hits)::BIGINT AS misses, round(sum(hits) / sum(10), 6) AS hit_rate, round(10.0 * count(*) * 1000 / sum(latency_ms), 6)::DOUBLE AS pairs_per_s FROM la GROUP BY method")
def cache_hit_miss_accounting(spark, sf):
    n = F.count(F.lit(1))
    return runs(spark, sf).groupBy("method").agg(
        F.sum("hits").alias("hits"), F.sum(10 - F.col("hits")).alias("misses"), F.round(F.sum("hits") / (10 * n), 6).alias("hit_rate"),
        F.round(F.try_divide(10.0 * n * 1000, F.sum("latency_ms")), 6).alias("pairs_per_s"),
    )


@book.add(RANKED + "SELECT qid, greatest(max(latency_ms) FILTER (method = 'bm25'), max(latency_ms) FILTER (method = 'dense')) + max(latency_ms) FILTER (method = 'hybrid_rrf') AS first_stage_ms, greatest(max(latency_ms) FILTER (method = 'bm25'), max(latency_ms) FILTER (method = 'dense')) + max(latency_ms) FILTER (method = 'hybrid_rrf') + max(latency_ms) FILTER (method = 'hybrid_rrf_rerank') AS end_to_end_ms FROM la GROUP BY qid")
def latency_estimate(spark, sf):
    own = lambda m: F.max(F.when(F.col("method") == m, F.col("latency_ms")))
    wide = runs(spark, sf).groupBy("qid").agg(*[own(m).alias(m) for m in METHODS])
    first = F.greatest("bm25", "dense") + F.col("hybrid_rrf")
    return wide.select("qid", first.alias("first_stage_ms"), (first + F.col("hybrid_rrf_rerank")).alias("end_to_end_ms"))


@book.add(RANKED + "SELECT method AS arm, qid, string_agg(pid, ',' ORDER BY rank) AS context FROM al WHERE rank <= 5 GROUP BY method, qid")
def rerank_arms(spark, sf):
    kept = R.top_k(all_methods(spark, sf), 5)
    pids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "pid"))), lambda x: x["pid"])
    return kept.groupBy(F.col("method").alias("arm"), "qid").agg(F.array_join(pids, ",").alias("context"))


@book.add(RANKED + ", t AS (SELECT method, qid, list(pid) AS p FROM al WHERE rank <= 2 GROUP BY ALL) SELECT a.qid, round(len(list_intersect(a.p, b.p)) / len(list_distinct(list_concat(a.p, b.p))), 6) AS jaccard FROM t a JOIN t b USING (qid) WHERE a.method = 'hybrid_rrf' AND b.method = 'hybrid_rrf_rerank'")
def top2_jaccard_stability(spark, sf):
    top = lambda rank, name: F.collect_set(F.when(F.col(rank) <= 2, F.col("pid"))).alias(name)
    both = wide(spark, sf).groupBy("qid").agg(top("hybrid_rrf_rank", "a"), top("rank", "b"))
    union = F.size(F.array_union("a", "b"))
    jaccard = F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect("a", "b")) / union)
    return both.select("qid", F.round(jaccard, 6).alias("jaccard"))
