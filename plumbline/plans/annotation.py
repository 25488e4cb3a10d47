"""Annotation workflow queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.functions import text as T
from plumbline.operators import annotation as A
from plumbline.operators import stats as S
from plumbline.plans.book import Book
from plumbline.plans.data import H, h
from plumbline.plans.stats import AGREE
from plumbline.sources import fixture as V

book = Book()
QUERIES, ORACLES = book.queries, book.oracles
LABELS = ("answerable", "unanswerable", "unclear")

SUB = f""", tk AS (SELECT qid AS task, split, 'ann' || (1 + {h('pair', 3)}) AS left_, 'ann' || (1 + ({h('pair', 3)} + 1) % 3) AS right_ FROM questions),
lab AS (SELECT qid AS task, ['answerable', 'unanswerable', 'unclear'][1 + {h('la', 3)}] AS a, CASE WHEN {h('miss')} < 5 THEN NULL WHEN {h('flip')} < 15 THEN ['answerable', 'unanswerable', 'unclear'][1 + ({h('la', 3)} + 1) % 3] ELSE ['answerable', 'unanswerable', 'unclear'][1 + {h('la', 3)}] END AS b FROM questions),
su AS (SELECT task, left_ AS annotator, a AS label FROM tk JOIN lab USING (task) UNION ALL SELECT task, right_, b FROM tk JOIN lab USING (task) WHERE b IS NOT NULL),
wf AS (SELECT task, split, a, b, b IS NOT NULL AS complete, b IS NOT NULL AND a <> b AS disagreed, b IS NOT NULL AND a <> b AND {h('adj', 100, 'task')} < 70 AS adjudicated, b IS NOT NULL AND (a = 'unclear' OR b = 'unclear') AS excluded FROM tk JOIN lab USING (task))
"""


def tasks(spark, sf):
    """task, split, left, right (the pair of annotators), a, b (their labels; b may be missing)."""
    k = T.bucket(F.concat(F.lit("pair:"), "qid"), 3)
    la = T.bucket(F.concat(F.lit("la:"), "qid"), 3)
    label = lambda i: F.element_at(F.array(*[F.lit(x) for x in LABELS]), (i + 1).cast("int"))
    b = F.when(H("miss") < 5, None).when(H("flip") < 15, label((la + 1) % 3)).otherwise(label(la))
    return V.questions(spark, sf).select(
        F.col("qid").alias("task"), "split", F.concat(F.lit("ann"), 1 + k).alias("left"), F.concat(F.lit("ann"), 1 + (k + 1) % 3).alias("right"), label(la).alias("a"), b.alias("b")
    )


def submissions(spark, sf):
    both = F.array(F.struct(F.col("left").alias("annotator"), F.col("a").alias("label")), F.struct(F.col("right").alias("annotator"), F.col("b").alias("label")))
    return tasks(spark, sf).select("task", F.explode(both).alias("x")).select("task", "x.*").where("label IS NOT NULL")


@book.add(SUB + "SELECT task, left_ AS first_annotator, right_ AS second_annotator FROM tk")
def assignment_pairs(spark, sf):
    return tasks(spark, sf).select("task", F.col("left").alias("first_annotator"), F.col("right").alias("second_annotator"))


@book.add()
def assignment_schedule(spark, sf):
    s = tasks(spark, sf).select("task", F.explode(F.array("left", "right")).alias("annotator"), F.substring("task", 1, 6).alias("group"))
    return A.schedule(s)


APART = SUB.rstrip() + """, sg AS (SELECT task, unnest([left_, right_]) AS annotator, substr(task, 1, 6) AS g FROM tk), sz AS (SELECT annotator, g, count(*) AS n FROM sg GROUP BY ALL),
bg AS (SELECT *, row_number() OVER (PARTITION BY annotator ORDER BY n DESC, sha256('0:' || g), g) = 1 AS big, sum(n) OVER (PARTITION BY annotator) AS total FROM sz),
so AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY annotator ORDER BY NOT big, sha256('0:' || g), g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM bg),
sn AS (SELECT annotator, task, g, start + row_number() OVER (PARTITION BY annotator, g ORDER BY sha256('0:' || task)) - 1 AS number, ceil(total / 2) AS half FROM sg JOIN so USING (annotator, g)),
sp AS (SELECT annotator, task, g, (CASE WHEN number < half THEN 2 * number ELSE 2 * (number - half) + 1 END)::BIGINT AS position FROM sn) """


def scheduled(spark, sf):
    s = tasks(spark, sf).select("task", F.explode(F.array("left", "right")).alias("annotator"), F.substring("task", 1, 6).alias("group"))
    return A.schedule_apart(s)


@book.add(APART + "SELECT annotator, task, position FROM sp")
def assignment_schedule_apart(spark, sf):
    return scheduled(spark, sf)


@book.add(APART + "SELECT annotator, task FROM (SELECT annotator, task, g, lag(g) OVER (PARTITION BY annotator ORDER BY position) AS before FROM sp) WHERE g = before")
def schedule_neighbours(spark, sf):
    """Tasks that follow one of their own group in the schedule: none, unless a group is more than half of an annotator's tasks."""
    return A.adjacent(scheduled(spark, sf).withColumn("group", F.substring("task", 1, 6))).select("annotator", "task")


@book.add(SUB + "SELECT annotator, task FROM (SELECT annotator, task, substr(task, 1, 6) AS g, lag(substr(task, 1, 6)) OVER (PARTITION BY annotator ORDER BY task) AS before FROM su) WHERE g = before")
def schedule_adjacency_violations(spark, sf):
    s = submissions(spark, sf).select("annotator", "task", F.col("task").alias("position"), F.substring("task", 1, 6).alias("group"))
    return A.adjacent(s).select("annotator", "task")


@book.add(SUB + f", x AS (SELECT task, CASE WHEN {h('wrong', 100, 'task')} < 6 THEN 'ann9' ELSE annotator END AS annotator FROM su UNION ALL SELECT task, annotator FROM su WHERE {h('twice', 100, 'task')} < 4) SELECT x.task, x.annotator, CASE WHEN x.annotator NOT IN (left_, right_) THEN 'not_assigned' ELSE 'duplicate' END AS violation FROM x JOIN tk USING (task) GROUP BY x.task, x.annotator, left_, right_ HAVING x.annotator NOT IN (left_, right_) OR count(*) > 1")
def submission_violations(spark, sf):
    s = submissions(spark, sf).select("task", "annotator")
    sent = s.withColumn("annotator", F.when(H("wrong", "task") < 6, "ann9").otherwise(F.col("annotator"))).unionByName(s.where(H("twice", "task") < 4))
    seen = sent.groupBy("task", "annotator").agg(F.count(F.lit(1)).alias("n")).join(tasks(spark, sf).select("task", "left", "right"), "task")
    stray = (F.col("annotator") != F.col("left")) & (F.col("annotator") != F.col("right"))
    kind = F.when(stray, "not_assigned").when(F.col("n") > 1, "duplicate")
    return seen.select("task", "annotator", kind.alias("violation")).where("violation IS NOT NULL")


AMEND = "WITH am AS (SELECT user_id AS original, event_id AS amendment, CASE WHEN event_id % 41 = 0 THEN NULL WHEN event_id % 43 = 0 THEN -event_id ELSE lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) END AS previous FROM events) "


def amendments(spark, sf):
    e = V.read(spark, sf, "events")
    before = F.lag("event_id").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    previous = F.when(F.col("event_id") % 41 == 0, None).when(F.col("event_id") % 43 == 0, -F.col("event_id")).otherwise(before)
    return e.select(F.col("user_id").alias("original"), F.col("event_id").alias("amendment"), previous.alias("previous"))


@book.add(AMEND + "SELECT original, amendment AS tip FROM am WHERE NOT EXISTS (SELECT 1 FROM am b WHERE b.original = am.original AND b.previous = am.amendment)", view=False)
def amendment_tip(spark, sf):
    return A.amendment_tips(amendments(spark, sf))


@book.add(AMEND + "SELECT original, 'several_heads' AS violation FROM am GROUP BY original HAVING count(*) FILTER (previous IS NULL) > 1 UNION SELECT original, 'no_head' FROM am GROUP BY original HAVING count(*) FILTER (previous IS NULL) = 0 UNION SELECT original, 'fork' FROM am WHERE previous IS NOT NULL GROUP BY original, previous HAVING count(*) > 1 UNION SELECT original, 'unknown_predecessor' FROM am WHERE previous IS NOT NULL AND NOT EXISTS (SELECT 1 FROM am b WHERE b.original = am.original AND b.amendment = am.previous)", view=False)
def amendment_chain_violations(spark, sf):
    return A.chain_violations(amendments(spark, sf))


@book.add(SUB + "SELECT task, a, b, CASE WHEN a = 'unclear' OR b = 'unclear' THEN 'unclear' ELSE 'answerability' END AS reason FROM wf WHERE disagreed")
def disagreement_queue(spark, sf):
    reasons = F.array_compact(F.array(F.when((F.col("a") == "unclear") | (F.col("b") == "unclear"), F.lit("unclear")), F.lit("answerability")))
    return tasks(spark, sf).where("b IS NOT NULL AND a <> b").select("task", "a", "b", reasons[0].alias("reason"))


def flow(spark, sf):
    t = tasks(spark, sf).withColumn("complete", F.col("b").isNotNull())
    t = t.withColumn("disagreed", F.coalesce(F.col("a") != F.col("b"), F.lit(False)))
    t = t.withColumn("adjudicated", F.col("disagreed") & (H("adj", "task") < 70))
    return t.withColumn("excluded", F.coalesce(F.col("complete") & ((F.col("a") == "unclear") | (F.col("b") == "unclear")), F.lit(False)))


@book.add(SUB + "SELECT split, count(*) AS assigned, count(*) FILTER (complete) AS completed, count(*) FILTER (disagreed) AS disagreed, count(*) FILTER (adjudicated) AS adjudicated, count(*) FILTER (excluded) AS excluded, count(*) FILTER (complete AND NOT excluded AND (NOT disagreed OR adjudicated)) AS eligible FROM wf GROUP BY split")
def workflow_flow_accounting(spark, sf):
    good = F.col("complete") & ~F.col("excluded") & (~F.col("disagreed") | F.col("adjudicated"))
    return flow(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("assigned"), F.count_if("complete").alias("completed"), F.count_if("disagreed").alias("disagreed"), F.count_if("adjudicated").alias("adjudicated"), F.count_if("excluded").alias("excluded"), F.count_if(good).alias("eligible"))


@book.add(SUB + "SELECT task, CASE WHEN NOT complete THEN 'incomplete' WHEN excluded THEN 'unclear' WHEN disagreed AND NOT adjudicated THEN 'unadjudicated' ELSE 'eligible' END AS status FROM wf")
def eligibility_records(spark, sf):
    status = F.when(~F.col("complete"), "incomplete").when(F.col("excluded"), "unclear").when(F.col("disagreed") & ~F.col("adjudicated"), "unadjudicated").otherwise("eligible")
    return flow(spark, sf).select("task", status.alias("status"))


@book.add(SUB.rstrip() + ", pr AS (SELECT a, b FROM lab)" + AGREE.replace("SELECT n, round(raw, 6) AS raw, round(CASE WHEN pe < 1 THEN (raw - pe) / (1 - pe) END, 6) AS kappa, round(CASE WHEN de > 0 THEN 1 - (1 - raw) / de ELSE 1 END, 6)::DOUBLE AS alpha FROM n, pe, ex",
  "SELECT n, CASE WHEN n < 40 THEN 'insufficient' WHEN (raw - pe) / (1 - pe) >= 0.7 AND 1 - (1 - raw) / de >= 0.7 THEN 'proceed' ELSE 'revise' END AS verdict FROM n, pe, ex"))
def pilot_verdict(spark, sf):
    r = S.nominal_agreement(tasks(spark, sf).select("a", "b"))
    verdict = F.when(F.col("n") < 40, "insufficient").when((F.col("kappa") >= 0.7) & (F.col("alpha") >= 0.7), "proceed").otherwise("revise")
    return r.select("n", verdict.alias("verdict"))


@book.add("SELECT sha256('blind:' || qid) AS task_id, sha256(question) AS content_hash, question FROM questions")
def blind_projection(spark, sf):
    return V.questions(spark, sf).select(F.sha2(F.concat(F.lit("blind:"), "qid"), 256).alias("task_id"), F.sha2("question", 256).alias("content_hash"), "question")


EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"


@book.add(f"SELECT pid, 'email' AS rule FROM passages WHERE regexp_matches(body, '{EMAIL}') UNION ALL SELECT pid, 'credential' FROM passages WHERE regexp_matches(body, 'token = \"') UNION ALL SELECT pid, 'address' FROM passages WHERE regexp_matches(body, '\\d{{1,3}}([.]\\d{{1,3}}){{3}}')")
def privacy_scan(spark, sf):
    # from the start of a run of its characters alone, so one pass over a text
    rules = {"email": f"(?<![A-Za-z0-9._%+-]){EMAIL}", "credential": 'token = "', "address": r"\d{1,3}([.]\d{1,3}){3}"}
    hits = F.array_compact(F.array(*[F.when(F.col("body").rlike(p), F.lit(n)) for n, p in rules.items()]))
    return V.passages(spark, sf).select("pid", F.explode(hits).alias("rule"))


@book.add(SUB + "SELECT annotator, count(*) AS n, sha256(string_agg(task || ':' || label, chr(10) ORDER BY task)) AS receipt FROM su GROUP BY annotator")
def collection_receipt(spark, sf):
    lines = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "task", "label"))), "\n")
    return submissions(spark, sf).groupBy("annotator").agg(F.count(F.lit(1)).alias("n"), F.sha2(lines, 256).alias("receipt"))


@book.add(SUB + f", v AS (SELECT task, annotator, CASE WHEN {h('conf', 100, 'task')} < 5 THEN 9 ELSE 3 END AS confidence, CASE WHEN {h('answer', 100, 'task')} < 8 THEN '' ELSE 'x' END AS answer, label FROM su) SELECT task, annotator, 'confidence_range' AS rule FROM v WHERE confidence NOT BETWEEN 1 AND 5 UNION ALL SELECT task, annotator, 'answer_missing' FROM v WHERE label = 'answerable' AND answer = ''")
def annotation_validation(spark, sf):
    v = submissions(spark, sf).withColumn("confidence", F.when(H("conf", "task") < 5, 9).otherwise(3)).withColumn("answer", F.when(H("answer", "task") < 8, "").otherwise("x"))
    rules = {"confidence_range": ~F.col("confidence").between(1, 5), "answer_missing": (F.col("label") == "answerable") & (F.col("answer") == "")}
    hits = F.array_compact(F.array(*[F.when(bad, F.lit(n)) for n, bad in rules.items()]))
    return v.select("task", "annotator", F.explode(hits).alias("rule"))


@book.add(SUB.rstrip() + """, pv AS (SELECT 'first' AS side, a AS label FROM lab UNION ALL SELECT 'second', b FROM lab UNION ALL SELECT 'pooled', a FROM lab UNION ALL SELECT 'pooled', b FROM lab)
SELECT side, label, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY side), 6)::DOUBLE AS share FROM pv WHERE label IS NOT NULL GROUP BY side, label""")
def label_prevalences(spark, sf):
    """How often each side gives each label, and both together."""
    sides = F.array(F.struct(F.lit("first").alias("side"), F.col("a").alias("label")), F.struct(F.lit("second").alias("side"), F.col("b").alias("label")), F.struct(F.lit("pooled").alias("side"), F.col("a").alias("label")), F.struct(F.lit("pooled").alias("side"), F.col("b").alias("label")))
    n = tasks(spark, sf).select(F.explode(sides).alias("x")).where("x.label IS NOT NULL").groupBy("x.side", "x.label").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("side")), 6))
