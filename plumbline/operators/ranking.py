"""Ranking and retrieval scores. Every ranking is by descending score (to nine places), then position."""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.functions.text import dot
from plumbline.operators.models import rerank_score


def rank_by_score(scored: DataFrame, keys=("qid",), score: str = "score", position: str = "idx", out: str = "rank") -> DataFrame:
    order = W.partitionBy(*keys).orderBy(F.round(score, 9).desc(), position)
    return scored.withColumn(out, F.row_number().over(order).cast("long"))


def top_k(ranked: DataFrame, k: int, rank: str = "rank") -> DataFrame:
    return ranked.where(F.col(rank) <= k)


def question_scores(question: str, texts: list[str], k1: float, b: float) -> list[float]:
    """Okapi scores of a question's texts, which are the corpus; all are in lower case."""
    counts = [Counter(re.findall("[a-z0-9]+", x)) for x in texts]
    n, lengths = len(texts), [c.total() for c in counts]
    found = Counter(itertools.chain.from_iterable(counts))
    raw = lambda df: math.log(n - df + 0.5) - math.log(df + 0.5)
    floor = 0.25 * sum(raw(df) * k for df, k in sorted(Counter(found.values()).items())) / max(1, len(found))
    asked = [(t, qn, raw(found[t])) for t, qn in Counter(re.findall("[a-z0-9]+", question)).items() if t in found]
    asked = [(t, qn * (idf if idf >= 0 else floor) * (k1 + 1)) for t, qn, idf in asked]
    size = [k1 * (1 - b + b * n * x / max(1, sum(lengths))) for x in lengths]
    return [sum((w * c[t] / (c[t] + s) for t, w in asked if t in c), 0.0) for c, s in zip(counts, size, strict=True)]


def bm25(passages: DataFrame, questions: DataFrame, k1: float = 1.5, b: float = 0.75, keep: tuple[str, ...] = ()) -> DataFrame:
    """qid, question, pid, idx, ``keep``, score: Okapi scores, each question's passages being the corpus.

    Terms in more than half of the passages have negative idf, which a quarter of the vocabulary's mean idf replaces. A question has few passages:
    they and the question itself are shuffled once by qid, stand together by sort, and are scored as they come by.
    """
    text = F.lower(F.concat_ws(" ", "title", "body")).alias("_text")
    rows = passages.select("qid", F.lit(1).alias("_kind"), "pid", "idx", *keep, text, F.lit(None).cast("string").alias("question"))
    asked = questions.select("qid", F.lit(0).alias("_kind"), F.lower("question").alias("_text"), "question")
    together = rows.unionByName(asked, allowMissingColumns=True).repartition("qid").sortWithinPartitions("qid", "_kind")
    shape = together.select("qid", "question", "pid", "idx", *keep).schema.add("score", "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["qid", "_kind", "_text", "question", "pid", "idx", *keep]
        rows = (r for batch in batches for r in zip(*(batch[c].to_pylist() for c in names), strict=True))
        schema, out = to_arrow_schema(shape), []
        for qid, group in itertools.groupby(rows, key=lambda r: r[0]):
            group = list(group)
            own = [r for r in group if r[1]]
            text, question = next(((r[2], r[3]) for r in group if not r[1]), ("", None))
            scores = question_scores(text or "", [r[2] for r in own], k1, b)
            out += [(qid, question, *r[4:], x) for r, x in zip(own, scores, strict=True)]
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return together.mapInArrow(score, shape)


def dense(passages: DataFrame, asked: DataFrame, vectors: DataFrame) -> DataFrame:
    """qid, pid, idx, score: dot products of normalized vectors with the question's. passages and asked (a row for each question) have vec_id."""
    own = passages.select("qid", "pid", "idx", "vec_id").join(vectors, "vec_id").drop("vec_id")
    questions = asked.select("qid", "vec_id").join(vectors.withColumnRenamed("v", "qv"), "vec_id").drop("vec_id")
    return own.join(questions, "qid").select("qid", "pid", "idx", dot("v", "qv").alias("score"))


def reciprocal(rank: Column, rrf_k: int = 60) -> Column:
    return 1.0 / (rrf_k + rank)


def place_by_hash(rows: DataFrame, h: str, group: str | None = None, out: str = "place", digits: int = 3) -> DataFrame:
    """rows with their place, from 1, by the hexadecimal hash h within their group.

    Places are counted within buckets of the first digits and then over the buckets, so no task gets all rows.
    """
    keys = [group] if group else []
    rows = rows.withColumn("_bucket", F.substring(h, 1, digits))
    sizes = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = rows.withColumn("_own", F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy(h)))
    return own.join(sizes, [*keys, "_bucket"]).withColumn(out, (F.col("_own") + F.col("_before")).cast("long")).drop("_bucket", "_own", "_before")


def fuse(rankings: list[DataFrame], rrf_k: int = 60) -> DataFrame:
    """qid, pid, idx, score, n_sources: reciprocal ranks added up. A source that lacks a passage shows in n_sources."""
    rows = rankings[0].select("qid", "pid", "idx", "rank")
    for r in rankings[1:]:
        rows = rows.unionByName(r.select("qid", "pid", "idx", "rank"))
    return rows.groupBy("qid", "pid", "idx").agg(F.sum(reciprocal(F.col("rank"), rrf_k)).alias("score"), F.count(F.lit(1)).alias("n_sources"))


def stub_rerank_score(question: Column, passage_chars: Column) -> Column:
    """The offline stand-in for a cross-encoder, of the question and the passage's length."""
    return (F.length(question) + 2 * passage_chars).cast("double")


def score_pairs(pairs: DataFrame, scorer: str, *keep: str, batch: int = 64) -> DataFrame:
    """The columns ``keep`` and rerank_score of pairs (question, body), by a reranker of the registry of models."""
    return pairs.select(*keep, rerank_score(scorer, F.col("question"), F.col("body"), batch).alias("rerank_score"))


def rerank(ranked: DataFrame, candidate_k: int, rerank_score: str = "rerank_score") -> DataFrame:
    """The first candidate_k are ordered by the reranker, then by source rank; the others follow below the least score.

    In: qid, pid, idx, rank and the reranker's score. Out: source_rank, was_reranked, score, rank.
    """
    rows = ranked.withColumnRenamed("rank", "source_rank").withColumn("was_reranked", F.col("source_rank") <= candidate_k)
    floor = F.min(F.when(F.col("was_reranked"), F.col(rerank_score))).over(W.partitionBy("qid"))
    tail = floor - 1.0 - (F.col("source_rank") - candidate_k - 1)
    rows = rows.withColumn("score", F.when(F.col("was_reranked"), F.col(rerank_score)).otherwise(tail))
    return rank_by_score(rows, position="source_rank")
