"""Seven pilots over the documents, each with its own fault; their failures and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import pilot as P
from plumbline.plans.book import Book
from plumbline.sources import fixture as V
from plumbline.sources.fixture import _bucket

book = Book()
QUERIES, ORACLES = book.queries, book.oracles
b = lambda tag: T.bucket(F.concat(F.lit(f"{tag}:"), F.col("doc_id").cast("string")))
h = lambda tag: _bucket(f"'{tag}:' || doc_id")


def frames(spark, sf):
    """manifest, submissions, amendments and adjudications. A tenth of the first submissions are amended, half of those twice; the last amendment has the label meant."""
    other = lambda c: F.when(c == "answerable", "unanswerable").otherwise("answerable")
    d = V.read(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 7).alias("k"), F.concat(F.lit("p"), (F.col("doc_id") % 7).cast("string")).alias("pilot"), F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("task"))
    d = d.withColumns({"first_label": F.when(b("lab") < 50, "answerable").otherwise("unanswerable"), "am": b("am"), "flip": b("flip") < F.when(F.col("k") == 3, 40).otherwise(6), "x": b("x")})
    d = d.withColumn("second_label", F.when(F.col("flip"), other(F.col("first_label"))).otherwise(F.col("first_label"))).withColumn("content", F.sha2("task", 256))
    manifest = d.select("pilot", "task", F.lit("ann").alias("first"), F.lit("bob").alias("second"), "content", F.lit("v2").alias("instructions"))
    private = F.to_json(F.struct(F.struct(F.when((F.col("k") == 5) & (F.col("x") < 5), F.lit(True)).alias("gold_label"), F.lit("fine").alias("note")).alias("meta")))
    wrong = F.when((F.col("k") == 4) & (F.col("x") < 5), F.lit("stale")).otherwise(F.col("content"))
    one = d.select("pilot", F.concat(F.lit("a-"), "task").alias("id"), "task", F.lit("ann").alias("annotator"), F.when(F.col("am") < 10, other(F.col("first_label"))).otherwise(F.col("first_label")).alias("label"), wrong.alias("content"), F.lit("v2").alias("instructions"), private.alias("payload"))
    two = d.where(~((F.col("k") == 1) & (F.col("x") < 5))).select("pilot", F.concat(F.lit("b-"), "task").alias("id"), "task", F.lit("bob").alias("annotator"), F.col("second_label").alias("label"), "content", F.lit("v2").alias("instructions"), F.lit("{}").alias("payload"))
    a = d.where("am < 10").select("pilot", F.concat(F.lit("a-"), "task").alias("original"), "am", "first_label")
    head = F.concat("original", F.lit("-1"))
    last = a.select("pilot", "original", F.when(F.col("am") < 5, F.concat("original", F.lit("-2"))).otherwise(head).alias("amendment"), F.when(F.col("am") < 5, head).alias("previous"), F.col("first_label").alias("label"))
    amendments = last.unionByName(a.where("am < 5").select("pilot", "original", head.alias("amendment"), F.lit(None).cast("string").alias("previous"), other(F.col("first_label")).alias("label")))
    stands = F.when(F.col("am") < 5, F.concat(F.lit("a-"), "task", F.lit("-2"))).when(F.col("am") < 10, F.concat(F.lit("a-"), "task", F.lit("-1"))).otherwise(F.concat(F.lit("a-"), "task"))
    decided = d.where("flip").where(~((F.col("k") == 2) & (F.col("x") < 50)))
    adjudications = decided.select(
        "pilot", F.concat(F.lit("j-"), "task").alias("id"), "task", F.lit("eve").alias("adjudicator"), F.when((F.col("k") == 6) & (F.col("x") < 50), F.concat(F.lit("a-"), "task", F.lit("-0"))).otherwise(stands).alias("first_id"), F.concat(F.lit("b-"), "task").alias("second_id"), F.lit("ambiguous").alias("label")
    )
    return manifest, two.unionByName(one), amendments, adjudications


BASE = f"""WITH d AS (SELECT doc_id, doc_id % 7 AS k, 'p' || (doc_id % 7) AS pilot, {h('lab')} < 50 AS yes, {h('flip')} < CASE WHEN doc_id % 7 = 3 THEN 40 ELSE 6 END AS flip, {h('x')} AS x FROM documents),
t AS (SELECT *, k = 1 AND x < 5 AS missing, yes <> flip AS other, flip AND NOT (k = 2 AND x < 50) AS decided FROM d) """


@book.add(BASE + """SELECT pilot, 'a-t' || doc_id AS record, 'wrong_content' AS rule FROM t WHERE k = 4 AND x < 5 UNION ALL SELECT pilot, 'j-t' || doc_id, 'outdated_records' FROM t WHERE k = 6 AND x < 50 AND flip
UNION ALL SELECT pilot, 'j-t' || doc_id, 'nothing_to_decide' FROM t WHERE decided AND missing""", view=False)
def pilot_failures(spark, sf):
    return P.failures(*frames(spark, sf))


@book.add(BASE + """, s AS (SELECT pilot, k, count(*) AS tasks, count(*) FILTER (NOT missing) AS completed, count(*) FILTER (flip AND NOT missing) AS disagreed, count(*) FILTER (decided AND NOT missing) AS adjudicated,
  count(*) FILTER (k = 5 AND x < 5) AS private, count(*) FILTER (k = 4 AND x < 5) + count(*) FILTER (k = 6 AND x < 50 AND flip) + count(*) FILTER (decided AND missing) AS failed,
  count(*) FILTER (NOT missing AND yes)::DOUBLE AS a, count(*) FILTER (NOT missing AND NOT yes)::DOUBLE AS b, count(*) FILTER (NOT missing AND other)::DOUBLE AS c, count(*) FILTER (NOT missing AND NOT other)::DOUBLE AS e FROM t GROUP BY pilot, k),
g AS (SELECT *, (completed - disagreed) / completed AS raw, (a * c + b * e) / (completed * completed) AS chance, 1 - ((a + c) * (a + c - 1) + (b + e) * (b + e - 1)) / (2.0::DOUBLE * completed * (2 * completed - 1)) AS apart FROM s),
w AS (SELECT *, (raw - chance) / (1 - chance) AS kappa, 1 - (1 - raw) / apart AS alpha FROM g)
SELECT pilot, tasks, completed, disagreed, adjudicated, round(kappa, 6)::DOUBLE AS kappa, round(alpha, 6)::DOUBLE AS alpha, private, failed, CASE WHEN private > 0 THEN 'BLOCKED_PRIVACY' WHEN failed > 0 OR tasks < 40 THEN 'BLOCKED_INTEGRITY' WHEN completed < tasks THEN 'BLOCKED_INCOMPLETE'
  WHEN adjudicated < disagreed THEN 'BLOCKED_UNRESOLVED_ADJUDICATION' WHEN kappa < 0.7 OR alpha < 0.7 THEN 'BLOCKED_LOW_IAA' ELSE 'READY_FOR_HUMAN_FREEZE_REVIEW' END AS verdict FROM w""", view=False)
def pilot_verdicts(spark, sf):
    return P.finalize(*frames(spark, sf)).withColumns({c: F.round(c, 6) for c in ("kappa", "alpha")})
