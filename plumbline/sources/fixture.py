"""Questions, passages, gold labels, vectors and generations derived from the driver's tables.

Ten consecutive documents are the candidates of one question. Every column is a function of the tables alone, and
``VIEW`` is the same derivation as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.functions.text import bucket, padded

BLANK = r"[ \t\n\r]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, pid, idx, doc_id, title, sentences, body, toks, quality."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality")
    d = d.join(labels, "doc_id", "left")
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    d = d.select(
        F.concat(F.lit("q"), padded(F.floor(F.col("doc_id") / 10), 6)).alias("qid"),
        (F.col("doc_id") % 10).alias("idx"),
        "doc_id",
        F.coalesce("quality", F.lit(0)).cast("long").alias("quality"),
        F.filter(F.split("text", BLANK), lambda w: w != "").alias("toks"),
        lines.alias("sentences"),
    )
    return d.select(
        "qid",
        F.concat("qid", F.lit("-p"), padded("idx", 2)).alias("pid"),
        "idx",
        "doc_id",
        "quality",
        "toks",
        "sentences",
        F.array_join("sentences", " ").alias("body"),
        F.array_join(F.slice("toks", 1, 3), " ").alias("title"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, pid, idx, doc_id, title, text: what ranking reads, without labels."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    qid = F.concat(F.lit("q"), padded(F.floor(F.col("doc_id") / 10), 6))
    rows = d.select(qid.alias("qid"), (F.col("doc_id") % 10).alias("idx"), "doc_id", "text", _head(3).alias("h"))
    return rows.select("qid", F.concat("qid", F.lit("-p"), padded("idx", 2)).alias("pid"), "idx", "doc_id", F.array_join("h", " ").alias("title"), "text")


def _head(n: int):
    """The first tokens of a text; the rest of it stays unsplit."""
    return F.slice(F.filter(F.slice(F.split("text", BLANK, n + 2), 1, n + 1), lambda w: w != ""), 1, n)


def gold_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, pid, doc_id, grank and the first tokens of the two gold passages; whole texts aren't shuffled for them."""
    d = read(spark, sf_dir, "documents").select("doc_id", _head(12).alias("head"))
    rows = d.join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    qid = F.concat(F.lit("q"), padded(F.floor(F.col("doc_id") / 10), 6))
    rows = rows.select(qid.alias("qid"), "doc_id", F.coalesce("quality", F.lit(0)).cast("long").alias("quality"), "head")
    best = W.partitionBy("qid").orderBy(F.col("quality").desc(), F.sha2(F.concat(F.lit("gold:"), F.col("doc_id").cast("string")), 256))
    ranked = rows.withColumn("grank", F.row_number().over(best).cast("long")).where("grank <= 2")
    return ranked.select("qid", F.concat("qid", F.lit("-p"), padded(F.col("doc_id") % 10, 2)).alias("pid"), "doc_id", "grank", "head")


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two gold passages of each question, with grank 1 and 2."""
    best = W.partitionBy("qid").orderBy(F.col("quality").desc(), F.sha2(F.concat(F.lit("gold:"), F.col("doc_id").cast("string")), 256))
    return passages(spark, sf_dir).withColumn("grank", F.row_number().over(best).cast("long")).where("grank <= 2")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, question, answer, qtype, level, split."""
    g = gold_heads(spark, sf_dir)
    part = lambda k, a, n: F.max(F.when(F.col("grank") == k, F.array_join(F.slice("head", a, n), " ")))
    q = g.groupBy("qid").agg(
        F.trim(F.concat_ws(" ", part(1, 5, 8), part(2, 5, 8))).alias("question"), F.coalesce(part(2, 2, 2), F.lit("")).alias("answer")
    )
    b = lambda name: bucket(F.concat(F.lit(f"{name}:"), "qid"))
    return q.select(
        "qid",
        "question",
        "answer",
        F.when(b("qtype") < 20, "comparison").otherwise("bridge").alias("qtype"),
        F.when(b("level") < 50, "medium").otherwise("hard").alias("level"),
        F.when(b("split") < 60, "eval").when(b("split") < 85, "dev").otherwise("smoke").alias("split"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id and the normalized vector."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    norm = F.sqrt(F.aggregate(F.transform("v", lambda x: x * x), F.lit(0.0), lambda x, y: x + y))
    return e.withColumn("n", norm).select("vec_id", F.transform("v", lambda x: x / F.col("n")).alias("v"))


def vector_of(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """rows with vec_id: which of all the vectors stands for a document."""
    return rows.withColumn("vec_id", F.col("doc_id") % F.lit(read(spark, sf_dir, "embeddings").count()))


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, question, answer, qtype, level, split, response (null where failed), failed, latency_ms, tokens."""
    b = bucket(F.concat(F.lit("gen:"), "qid"))
    text = (
        F.when(b < 40, F.concat("answer", F.lit(" [P1][P2]")))
        .when(b < 60, F.lit("wrong guess [P3, P3]"))
        .when(b < 75, F.lit("INSUFFICIENT EVIDENCE"))
        .when(b < 90, F.concat("answer", F.lit(" [P11; P2]. [note 3]")))
        .otherwise(F.col("answer"))
    )
    q = questions(spark, sf_dir)
    failed = bucket(F.concat(F.lit("fail:"), "qid")) < 5
    return q.select(
        *q.columns,
        failed.alias("failed"),
        F.when(~failed, text).alias("response"),
        (bucket(F.concat(F.lit("lat:"), "qid"), 1000) + 20).alias("latency_ms"),
        (bucket(F.concat(F.lit("tok:"), "qid"), 60) + 1).alias("tokens"),
    )


def _bucket(x: str, n: int = 100) -> str:
    return f"(('0x' || substr(sha256({x}), 1, 8))::UBIGINT % {n})::BIGINT"


VIEW = f"""
WITH RECURSIVE v_d AS (SELECT d.doc_id, d.doc_id // 10 AS g, d.doc_id % 10 AS idx, coalesce(l.quality, 0)::BIGINT AS quality,
  list_filter(regexp_split_to_array(text, '{BLANK}'), lambda x: x <> '') AS toks,
  list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS sentences
  FROM documents d LEFT JOIN labels l USING (doc_id)),
v_e AS (SELECT *, 'q' || lpad(g::VARCHAR, greatest(6, length(g::VARCHAR))::INTEGER, '0') AS qid FROM v_d),
passages AS (SELECT qid, qid || '-p' || lpad(idx::VARCHAR, 2, '0') AS pid, idx, doc_id, quality, toks, sentences, array_to_string(sentences, ' ') AS body,
  array_to_string(toks[1:3], ' ') AS title FROM v_e),
gold AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY quality DESC, sha256('gold:' || doc_id)) AS grank FROM passages) WHERE grank <= 2),
v_q AS (SELECT qid, trim(concat_ws(' ', max(array_to_string(toks[5:12], ' ')) FILTER (grank = 1), max(array_to_string(toks[5:12], ' ')) FILTER (grank = 2))) AS question,
  coalesce(max(array_to_string(toks[2:3], ' ')) FILTER (grank = 2), '') AS answer FROM gold GROUP BY qid),
questions AS (SELECT qid, question, answer, CASE WHEN {_bucket("'qtype:' || qid")} < 20 THEN 'comparison' ELSE 'bridge' END AS qtype,
  CASE WHEN {_bucket("'level:' || qid")} < 50 THEN 'medium' ELSE 'hard' END AS level,
  CASE WHEN {_bucket("'split:' || qid")} < 60 THEN 'eval' WHEN {_bucket("'split:' || qid")} < 85 THEN 'dev' ELSE 'smoke' END AS split FROM v_q),
vectors AS (SELECT vec_id, list_transform(v, lambda x: x / n) AS v FROM (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n
  FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings))),
generations AS (SELECT *, CASE WHEN NOT failed THEN CASE WHEN b < 40 THEN answer || ' [P1][P2]' WHEN b < 60 THEN 'wrong guess [P3, P3]'
  WHEN b < 75 THEN 'INSUFFICIENT EVIDENCE' WHEN b < 90 THEN answer || ' [P11; P2]. [note 3]' ELSE answer END END AS response FROM (SELECT *,
  {_bucket("'gen:' || qid")} AS b, {_bucket("'fail:' || qid")} < 5 AS failed, {_bucket("'lat:' || qid", 1000)} + 20 AS latency_ms,
  {_bucket("'tok:' || qid", 60)} + 1 AS tokens FROM questions))
"""
