"""Caches over several runs, strict scans of logs, configurations of runs and payloads, each on tables or files that Spark derives from them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.functions import nested as N
from plumbline.functions import text as T
from plumbline.functions.lineage import cut, scratch
from plumbline.operators.models import rerank_score
from plumbline.plans.book import Book
from plumbline.sources import cache, logs
from plumbline.sources import fixture as V
from plumbline.sources.fixture import _bucket

book = Book()
QUERIES, ORACLES = book.queries, book.oracles


@book.add(f""", rq AS (SELECT (length(q.question) + 2 * length(p.body))::DOUBLE AS score, {_bucket("'cache:' || pid")} < 30 AS early FROM passages p JOIN questions q USING (qid))
SELECT 1::BIGINT AS run, count(*) AS asked, 0::BIGINT AS hits, count(*) AS computed, sum(score) AS total FROM rq WHERE early
UNION ALL SELECT 2, count(*), count(*) FILTER (early), count(*) FILTER (NOT early), sum(score) FROM rq UNION ALL SELECT 3, count(*), count(*), 0, sum(score) FROM rq""")
def rerank_cache_runs(spark, sf):
    """Three runs over one cache of rerank scores: some pairs, all of them, and all again."""
    q = V.questions(spark, sf).select("qid", "question")
    pairs = V.passages(spark, sf).select("qid", "pid", "body").join(q, "qid")
    key = F.sha2(F.to_json(F.struct(F.lit("stub").alias("model"), "pid", "qid")), 256)
    pairs = pairs.select("pid", key.alias("key"), "question", "body")
    early = T.bucket(F.concat(F.lit("cache:"), "pid")) < 30
    with scratch(spark) as folder:
        rows = []
        for run, some in enumerate((pairs.where(early), pairs, pairs), 1):
            got = cache.get_or_compute(some, folder, "stub@1", lambda m: m.select("key", rerank_score("stub", F.col("question"), F.col("body")).alias("value")))
            rows.append(got.agg(F.lit(run).cast("long").alias("run"), F.count(F.lit(1)).alias("asked"), F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("computed"), F.sum("value").alias("total")))
            rows[-1] = cut(rows[-1])
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@book.add("""WITH e AS (SELECT user_id % 16 AS bucket, row_number() OVER w AS k, count(*) OVER (PARTITION BY user_id % 16) AS n FROM events WINDOW w AS (PARTITION BY user_id % 16 ORDER BY ts, event_id)),
c AS (SELECT bucket, CASE WHEN k = 4 AND bucket % 3 = 0 THEN 'blank' WHEN k = 3 AND bucket % 5 = 1 OR k = n AND bucket % 2 = 0 THEN 'broken' WHEN k = 2 AND bucket % 7 = 2 THEN 'other' ELSE 'object' END AS kind, k = n AS last_ FROM e)
SELECT bucket, count(*) FILTER (kind = 'object') AS records, count(*) FILTER (kind = 'broken') AS broken, count(*) FILTER (kind = 'other') AS others, bool_or(last_ AND kind = 'broken') AS tail,
  count(*) FILTER (kind = 'other' OR kind = 'broken' AND NOT last_) > 0 AS fatal FROM c GROUP BY bucket""", view=False)
def strict_log_scan(spark, sf):
    """Logs written from the events, one file for each sixteenth of the users: some end in half a line, some are broken before that, some hold what is no object."""
    e = V.read(spark, sf, "events").withColumn("bucket", F.col("user_id") % 16)
    own = W.partitionBy("bucket")
    e = e.withColumn("k", F.row_number().over(own.orderBy("ts", "event_id"))).withColumn("n", F.count(F.lit(1)).over(own))
    line, b = F.to_json(F.struct("event_id", "event_type", "value")), F.col("bucket")
    half = ((F.col("k") == 3) & (b % 5 == 1)) | ((F.col("k") == F.col("n")) & (b % 2 == 0))
    line = F.when((F.col("k") == 4) & (b % 3 == 0), "  ").when(half, F.left(line, F.lit(9))).when((F.col("k") == 2) & (b % 7 == 2), "[1]").otherwise(line)
    with scratch(spark) as folder:
        e.select("bucket", "k", line.alias("value")).repartition("bucket").sortWithinPartitions("bucket", "k").drop("k").write.partitionBy("bucket").text(folder)
        found = cut(logs.report(spark, folder))
    return found.select(F.regexp_extract("file", r"bucket=(\d+)", 1).cast("long").alias("bucket"), "records", "broken", "others", "tail", "fatal")


def configured(spark, sf):
    """Stored runs and the same asked for again, one for each customer; what changed goes by a hash."""
    c = V.read(spark, sf, "customer").withColumn("b", T.bucket(F.concat(F.lit("cfg:"), F.col("c_custkey").cast("string"))))
    b = F.col("b")

    def config(now: bool):
        changed = lambda low, high: (b >= low) & (b < high) & F.lit(now)
        data = F.struct(F.when(changed(40, 50), F.lit(True)).alias("extra"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
        model = F.struct(F.when(changed(0, 20), F.concat("c_name", F.lit("-v2"))).otherwise(F.col("c_name")).alias("id"), F.when(changed(60, 70), F.array(F.lit(1), F.lit(3))).otherwise(F.array(F.lit(1), F.lit(2))).alias("layers"))
        place = F.concat(F.lit("/out/"), F.col("c_custkey").cast("string"), F.when(changed(20, 40), "/new").otherwise(""))
        return F.to_json(F.struct(data.alias("data"), model.alias("model"), F.struct(place.alias("dir")).alias("output"), F.when(~changed(50, 60), F.col("c_custkey") % 5).alias("seed")))

    stored = c.where("b < 95").select(F.col("c_custkey").alias("run"), config(False).alias("config"), F.lit("real").alias("kind"), (b % 2).alias("records"))
    asked = c.select(F.col("c_custkey").alias("run"), config(True).alias("config"), F.when((b >= 70) & (b < 80), "mock").otherwise("real").alias("kind"), ((b < 80) | (b >= 90)).alias("resume"))
    return stored, asked


CFG = f"WITH c AS (SELECT *, {_bucket(chr(39) + 'cfg:' + chr(39) + ' || c_custkey')} AS b FROM customer) "


@book.add(CFG + """SELECT c_custkey AS run, 'model.id' AS path, '"' || c_name || '"' AS stored, '"' || c_name || '-v2"' AS current FROM c WHERE b < 20 UNION ALL SELECT c_custkey, 'data.extra', NULL, 'true' FROM c WHERE b >= 40 AND b < 50
UNION ALL SELECT c_custkey, 'seed', (c_custkey % 5)::VARCHAR, NULL FROM c WHERE b >= 50 AND b < 60 UNION ALL SELECT c_custkey, 'model.layers', '[1,2]', '[1,3]' FROM c WHERE b >= 60 AND b < 70""", view=False)
def run_config_diff(spark, sf):
    """Settings that differ between stored runs and the same asked for again; the output's place doesn't count."""
    stored, asked = configured(spark, sf)
    asked = asked.join(stored.select("run"), "run", "left_semi")
    return N.config_diffs(N.settings(stored, "run", "config", ["output"]), N.settings(asked, "run", "config", ["output"]), "run")


@book.add(CFG + "SELECT c_custkey AS run, CASE WHEN b >= 95 THEN 'start' WHEN b >= 80 AND b < 90 THEN CASE WHEN b % 2 > 0 THEN 'has_records' ELSE 'start' END WHEN b < 20 OR b >= 40 AND b < 70 THEN 'config_changed' WHEN b >= 70 AND b < 80 THEN 'kind_changed' ELSE 'resume' END AS verdict FROM c", view=False)
def run_resume_verdicts(spark, sf):
    stored, asked = configured(spark, sf)
    return N.resume_verdicts(stored, asked, ["output"])


PAY = f"""WITH t AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS k FROM conversations),
m AS (SELECT DISTINCT conv_id, {_bucket(chr(39) + 'pay:' + chr(39) + ' || conv_id')} AS b FROM conversations) """


@book.add(PAY + r"""SELECT conv_id, '$.turns[' || k || '].text' AS path, 'mail' AS rule FROM t WHERE regexp_matches(text, '\b[^\s@]+@[^\s@]+\.[^\s@]+\b')
UNION ALL SELECT conv_id, '$.turns[' || k || '].text', 'file_place' FROM t WHERE regexp_matches(text, '(?:^|[\s"''(])(?:[A-Za-z]:[\\/]|/(?:Users|home|root)/)')
UNION ALL SELECT conv_id, '$.meta.Gold_label', 'source_key' FROM m WHERE b < 10 UNION ALL SELECT conv_id, '$.meta.review.score', 'source_key' FROM m WHERE b >= 10 AND b < 20
UNION ALL SELECT conv_id, '$.meta.review.places[1]', 'file_place' FROM m WHERE b >= 20 AND b < 30 UNION ALL SELECT conv_id, '$.meta.review.places[0]', 'mail' FROM m WHERE b >= 25 AND b < 35""", view=False)
def payload_privacy_scan(spark, sf):
    """What must not be in nested payloads, each a conversation with its turns and a record of its making, by its path."""
    b = F.col("b")
    c = V.read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    c = c.withColumn("b", T.bucket(F.concat(F.lit("pay:"), F.col("conv_id").cast("string"))))
    places = F.array(F.when((b >= 25) & (b < 35), "ask a.b@c.org, or").otherwise("none @ all"), F.when((b >= 20) & (b < 30), "see /home/me/x").otherwise("see /homes/x"))
    review = F.struct(places.alias("places"), F.when((b >= 10) & (b < 20), F.lit(0.5)).alias("score"))
    meta = F.struct(F.when(b < 10, "yes").alias("Gold_label"), F.lit("b").alias("golden"), review.alias("review"))
    payload = F.to_json(F.struct("conv_id", meta.alias("meta"), F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")))
    return N.private_nodes(c.select("conv_id", payload.alias("payload")), "payload", "conv_id")
