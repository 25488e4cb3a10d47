"""Queries through the model boundaries: ablations, embeddings under each query convention, reranking, generation."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import attribution as A
from plumbline.operators import models as M
from plumbline.plans.attribution import BASE, UNIT, WORDS
from plumbline.plans.book import Book
from plumbline.sources import fixture as V

book = Book()
QUERIES, ORACLES = book.queries, book.oracles
CONVENTIONS = ("question", "answer", "question_answer")
QUERY_SQL = {"question": "trim(question)", "answer": "trim(answer)", "question_answer": "query"}


def contexts(spark, sf):
    """One row to a question: question, answer and its passages in order, as arrays pids, titles, bodies."""
    p = V.passages(spark, sf).select("qid", F.struct("idx", "pid", "title", "body").alias("p")).groupBy("qid").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    rows = p.join(V.questions(spark, sf).select("qid", "question", "answer"), "qid")
    return rows.select("qid", "question", "answer", F.col("ps.pid").alias("pids"), F.col("ps.title").alias("titles"), F.col("ps.body").alias("bodies"))


def _spread(rows, score):
    """pid, score of arrays that go with pids."""
    pairs = F.arrays_zip(F.col("pids").alias("pid"), F.col("s").alias("s"))
    return rows.withColumn("s", score).select(F.explode(pairs).alias("x")).select("x.pid", F.round("x.s", 6).alias("score"))


ASKED = ("question", "answer", "pids", "titles", "bodies")


@book.add(BASE + "SELECT pid, round(w, 6)::DOUBLE AS score FROM lo")
def ablation_leave_one_out(spark, sf):
    return _spread(contexts(spark, sf), M.leave_one_out("stub", *map(F.col, ASKED)))


@book.add(BASE + f""", ps AS (SELECT qid, pid, w, unnest(range(greatest(1, len(list_filter(string_split(answer, ' '), lambda x: x <> ''))))) AS pos FROM lo),
pv AS (SELECT *, unnest(range({M.StubScorer.vocabulary})) AS v FROM ps), ms AS (SELECT *, w * {UNIT.format("'d:' || pid || ':' || pos || ':' || v")} AS m FROM pv),
fu AS (SELECT *, 1 + sum(m) OVER (PARTITION BY qid, pos, v) AS f FROM ms),
di AS (SELECT *, f / sum(f) OVER (PARTITION BY pid, pos) AS p, (f - m) / sum(f - m) OVER (PARTITION BY pid, pos) AS q FROM fu)
SELECT pid, round(avg(j), 6) AS score FROM (SELECT pid, pos, greatest(0, sum(p * ln((p + 1e-12) / ((p + q) / 2 + 1e-12)) + q * ln((q + 1e-12) / ((p + q) / 2 + 1e-12))) / 2) AS j FROM di GROUP BY ALL) GROUP BY pid""")
def ablation_arc_jsd(spark, sf):
    return _spread(contexts(spark, sf), M.arc_jsd("stub", *map(F.col, ASKED)))


def _vector(text: str) -> str:
    dims = f"list_transform(regexp_extract_all(lower({text}), '[a-z0-9]+'), lambda t: ('0x' || substr(sha256(t), 1, 2))::INTEGER % {M.DIMENSIONS})"
    return f"list_transform(range({M.DIMENSIONS}), lambda d: len(list_filter(dims, lambda x: x = d))::DOUBLE) AS v FROM (SELECT *, {dims} AS dims"


CLOSE = "coalesce(list_dot_product(a.v, {0}.v) / nullif(sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product({0}.v, {0}.v)), 0), 0)"


@book.add(BASE + f", pe AS (SELECT qid, pid, {_vector('concat(title, chr(10), body)')} FROM passages)), "
  + ", ".join(f"e{i} AS (SELECT qid, {_vector(QUERY_SQL[c])} FROM (SELECT DISTINCT qid, question, answer, query FROM pa)))" for i, c in enumerate(CONVENTIONS))
  + " SELECT pid, " + ", ".join(f"round({CLOSE.format(f'e{i}')}, 6)::DOUBLE AS {c}" for i, c in enumerate(CONVENTIONS))
  + " FROM pe a JOIN e0 USING (qid) JOIN e1 USING (qid) JOIN e2 USING (qid)")
def attr_embedding_conventions(spark, sf):
    """Texts are embedded as title and body on two lines, queries under each convention."""
    q = V.questions(spark, sf).select("qid", *[M.embed("stub", T.compose_query("question", "answer", c), "query").alias(c) for c in CONVENTIONS])
    p = V.passages(spark, sf).select("qid", "pid", M.embed("stub", F.concat_ws("\n", "title", "body"), "passage").alias("v"))
    return p.join(q, "qid").select("pid", *[F.round(T.dot("v", c), 6).alias(c) for c in CONVENTIONS])


@book.add(BASE + "SELECT pid, " + ", ".join(
  f"round(len(list_intersect({WORDS.format(QUERY_SQL[c])}, {WORDS.format(chr(39) * 2 + ' || concat_ws(chr(32), title, body)')})) / greatest(1, len({WORDS.format(QUERY_SQL[c])})), 6)::DOUBLE AS {c}" for c in CONVENTIONS) + " FROM pa")
def control_lexical_conventions(spark, sf):
    q = V.questions(spark, sf).select("qid", *[A.content_words(T.compose_query("question", "answer", c)).alias(c) for c in CONVENTIONS])
    p = V.passages(spark, sf).select("qid", "pid", A.content_words(F.concat_ws(" ", "title", "body")).alias("w"))
    share = lambda c: F.size(F.array_intersect(c, "w")) / F.greatest(F.lit(1), F.size(c))
    return p.join(q, "qid").select("pid", *[F.round(share(c), 6).alias(c) for c in CONVENTIONS])


@book.add("SELECT pid, (length(question) + 2 * length(body))::DOUBLE AS score FROM passages JOIN questions USING (qid)")
def rerank_boundary_scores(spark, sf):
    rows = V.passages(spark, sf).select("qid", "pid", "body").join(V.questions(spark, sf).select("qid", "question"), "qid")
    return rows.select("pid", M.rerank_score("stub", F.col("question"), F.col("body")))


@book.add("SELECT qid, arg_max(title, idx) || ' [P' || (max(idx) + 1) || ']' AS response, sha256('Question: ' || any_value(question) || chr(10) || string_agg('P' || (idx + 1) || ': ' || title, chr(10) ORDER BY idx)) AS prompt_hash FROM passages JOIN questions USING (qid) GROUP BY qid")
def generated_answers(spark, sf):
    """A prompt of the question and its passages' titles under their aliases, its hash, and what the generator answers."""
    p = V.texts(spark, sf).select("qid", F.struct("idx", "title").alias("p")).groupBy("qid").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    lines = F.transform("ps", lambda p: F.concat(F.lit("P"), p["idx"] + 1, F.lit(": "), p["title"]))
    prompt = F.array_join(F.concat(F.array(F.concat(F.lit("Question: "), "question")), lines), "\n")
    rows = p.join(V.questions(spark, sf).select("qid", "question"), "qid").select("qid", prompt.alias("prompt"))
    return rows.select("qid", M.generate("stub", F.col("prompt")).alias("response"), F.sha2("prompt", 256).alias("prompt_hash"))
