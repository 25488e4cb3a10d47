"""Text, identifier and prompt queries."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.plans.book import Book
from plumbline.sources import fixture as V

book = Book()
QUERIES, ORACLES = book.queries, book.oracles
NORM = "array_to_string(list_filter(regexp_split_to_array(translate(lower({0}), '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', ''), '[\\s]+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')"
CITED = "list_distinct(flatten(list_transform(regexp_extract_all(response, '\\[ *P\\d+(?:[,;/ ]+P\\d+)* *\\]'), lambda g: regexp_extract_all(g, 'P\\d+'))))"


@book.add("SELECT pid, array_to_string(regexp_extract_all(lower(body), '[a-z0-9]+'), ' ') AS tokens, len(regexp_extract_all(lower(body), '[a-z0-9]+'))::BIGINT AS n FROM passages")
def tokenize_lower_alnum(spark, sf):
    t = T.tokenize("body")
    return V.passages(spark, sf).select("pid", F.array_join(t, " ").alias("tokens"), F.size(t).cast("long").alias("n"))


@book.add(f"SELECT pid, {NORM.format('title')} AS norm FROM passages")
def normalize_answer(spark, sf):
    return V.passages(spark, sf).select("pid", T.normalize_answer("title").alias("norm"))


F1_SQL = f""", pr AS (SELECT *, regexp_replace(coalesce(response, ''), '\\[[^\\]]*\\]', '', 'g') AS said FROM generations),
nn AS (SELECT *, {NORM.format('said')} AS na, {NORM.format('answer')} AS nb FROM pr),
tk AS (SELECT *, list_filter(string_split(na, ' '), lambda x: x <> '') AS p, list_filter(string_split(nb, ' '), lambda x: x <> '') AS g FROM nn),
sh AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(p), lambda t: least(len(list_filter(p, lambda y: y = t)), len(list_filter(g, lambda y: y = t))))), 0) AS s FROM tk),
sc AS (SELECT *, (na = nb)::BIGINT AS em, CASE WHEN (na IN ('yes', 'no', 'noanswer') OR nb IN ('yes', 'no', 'noanswer')) AND na <> nb THEN 0
  WHEN len(p) = 0 OR len(g) = 0 THEN (len(p) = len(g))::INT WHEN s = 0 THEN 0 ELSE 2 * (s / len(p)) * (s / len(g)) / (s / len(p) + s / len(g)) END AS f1 FROM sh)
"""


def scored_answers(spark, sf):
    """Generations with said (the response without bracket groups), em and f1."""
    g = V.generations(spark, sf).withColumn("said", F.regexp_replace(F.coalesce("response", F.lit("")), r"\[[^\]]*\]", ""))
    return g.withColumn("em", T.exact_match("said", "answer")).withColumn("f1", T.f1("said", "answer"))


@book.add(F1_SQL + "SELECT qid, em, round(f1, 6)::DOUBLE AS f1 FROM sc WHERE NOT failed")
def answer_em_f1(spark, sf):
    return scored_answers(spark, sf).where(~F.col("failed")).select("qid", "em", F.round("f1", 6).alias("f1"))


def canonical(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).split()))


@book.add()
def normalize_title(spark, sf):
    """Compatibility form, single spaces, case folded: no built-in function has the first and the last."""

    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        return canonical(s).map(lambda x: None if x is None else x.casefold())

    titles = V.passages(spark, sf).select("title").distinct()
    return V.passages(spark, sf).select("pid", "title").join(titles.withColumn("norm", fold("title")), "title").select("pid", "norm")


@book.add("""SELECT pid, sha256('["' || array_to_string(list_transform(sentences, lambda x: replace(replace(replace(regexp_replace(x, '[ \\t\\n\\r]+', ' ', 'g'), chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), '/', '/')), '","') || '"]') AS fingerprint
  FROM passages WHERE len(sentences) > 0""")
def paragraph_fingerprint(spark, sf):
    canon = F.transform("sentences", lambda x: F.regexp_replace(x, r"[ \t\n\r]+", " "))
    return V.passages(spark, sf).where(F.size("sentences") > 0).select("pid", F.sha2(F.to_json(canon), 256).alias("fingerprint"))


ESC = "replace(replace({0}, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"')"
EXAMPLE = f""", fp AS (SELECT qid, sha256('{{"answer":"' || {ESC.format('answer')} || '","id":"' || qid || '","level":"' || level || '","question":"' || {ESC.format('question')} || '","type":"' || qtype || '"}}') AS fingerprint, split FROM questions)
"""


def fingerprints(spark, sf):
    fields = F.struct("answer", F.col("qid").alias("id"), "level", "question", F.col("qtype").alias("type"))
    return V.questions(spark, sf).select("qid", "split", F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256).alias("fingerprint"))


@book.add(EXAMPLE + "SELECT qid, fingerprint FROM fp")
def example_fingerprint(spark, sf):
    return fingerprints(spark, sf).select("qid", "fingerprint")


@book.add(EXAMPLE + "SELECT split, count(*) AS n, sha256(string_agg(qid || ':' || fingerprint, chr(10) ORDER BY qid)) AS split_hash FROM fp GROUP BY split")
def split_hashes(spark, sf):
    return fingerprints(spark, sf).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sha2(F.expr("listagg(concat_ws(':', qid, fingerprint), '\n') WITHIN GROUP (ORDER BY qid)"), 256).alias("split_hash")
    )


TREE = """, lf AS (SELECT split, substr(sha256(qid), 1, 4) AS bucket, sha256(string_agg(qid || ':' || fingerprint, chr(10) ORDER BY qid || ':' || fingerprint)) AS digest FROM fp GROUP BY ALL)
SELECT split, count(*) AS buckets, sha256(string_agg(bucket || ':' || digest, chr(10) ORDER BY bucket)) AS split_hash FROM lf GROUP BY split"""


@book.add(EXAMPLE + TREE)
def split_tree_hashes(spark, sf):
    """The form of split_hashes for any number of examples: a digest of each range of ids' hashes, and one of those digests. No task holds a split."""
    f = fingerprints(spark, sf)
    return T.tree_digest(f.select("split", F.sha2("qid", 256).alias("h"), F.concat_ws(":", "qid", "fingerprint").alias("line")), "split").withColumnRenamed("digest", "split_hash")


@book.add("SELECT pid, regexp_extract(pid, '^(.*)-p(\\d+)$', 1) AS parent, regexp_extract(pid, '^(.*)-p(\\d+)$', 2)::BIGINT AS number, regexp_matches(pid, '^.*-p\\d{2,}$') AS valid FROM passages")
def passage_ids_roundtrip(spark, sf):
    form = r"^(.*)-p(\d+)$"
    return V.passages(spark, sf).select(
        "pid", F.regexp_extract("pid", form, 1).alias("parent"), F.regexp_extract("pid", form, 2).cast("long").alias("number"),
        F.col("pid").rlike(r"^.*-p\d{2,}$").alias("valid"),
    )


@book.add("SELECT qid, 'P' || row_number() OVER (PARTITION BY qid ORDER BY idx) AS alias, pid FROM passages")
def alias_map(spark, sf):
    pids = F.transform(F.array_sort(F.collect_list(F.struct("idx", "pid"))), lambda x: x["pid"])
    q = V.passages(spark, sf).groupBy("qid").agg(pids.alias("pids"))
    return q.select("qid", F.posexplode("pids").alias("at", "pid")).select("qid", F.concat(F.lit("P"), F.col("at") + 1).alias("alias"), "pid")


@book.add("SELECT pid, 'P' || (idx + 1) || '.S' || (k + 1) AS alias, pid || '-s' || CASE WHEN k < 10 THEN '0' || k ELSE k::VARCHAR END AS sentence_id FROM (SELECT pid, idx, unnest(range(len(sentences))) AS k FROM passages)")
def sentence_alias_map(spark, sf):
    s = V.passages(spark, sf).select("pid", "idx", F.posexplode("sentences").alias("at", "sentence"))
    return s.select(
        "pid", F.concat(F.lit("P"), F.col("idx") + 1, F.lit(".S"), F.col("at") + 1).alias("alias"),
        F.concat("pid", F.lit("-s"), T.padded("at", 2)).alias("sentence_id"),
    )


@book.add(""", ln AS (SELECT qid, string_agg('[P' || (idx + 1) || '] ' || title || ': ' || body, chr(10) ORDER BY idx) AS block FROM passages GROUP BY qid)
SELECT qid, substr(sha256('Question: ' || question || chr(10) || block), 1, 16) AS prompt_hash, length('Question: ' || question || chr(10) || block)::BIGINT AS n_chars FROM questions JOIN ln USING (qid)""")
def prompt_render(spark, sf):
    line = F.concat(F.lit("[P"), F.col("idx") + 1, F.lit("] "), "title", F.lit(": "), "body")
    block = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", line.alias("line")))), lambda x: x["line"]), "\n")
    rows = V.passages(spark, sf).groupBy("qid").agg(block.alias("block")).join(V.questions(spark, sf), "qid")
    prompt = F.concat(F.lit("Question: "), "question", F.lit("\n"), "block")
    return rows.select("qid", F.substring(F.sha2(prompt, 256), 1, 16).alias("prompt_hash"), F.length(prompt).cast("long").alias("n_chars"))


@book.add("SELECT qid, trim(question) AS question, trim(answer) AS answer, array_to_string(list_filter([trim(question), trim(answer)], lambda x: x <> ''), ' ') AS both FROM questions")
def compose_query(spark, sf):
    c = lambda how: T.compose_query("question", "answer", how)
    return V.questions(spark, sf).select("qid", c("question").alias("question"), c("answer").alias("answer"), c("question_answer").alias("both"))


@book.add(f"""SELECT qid, array_to_string(list_sort(list_filter({CITED}, lambda a: substr(a, 2)::INT BETWEEN 1 AND 10)), ',') AS valid,
  array_to_string(list_sort(list_filter({CITED}, lambda a: substr(a, 2)::INT NOT BETWEEN 1 AND 10)), ',') AS invalid FROM generations WHERE response IS NOT NULL""")
def parse_citations(spark, sf):
    known = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.concat(F.lit("P"), i))
    g = V.generations(spark, sf).where("response IS NOT NULL").withColumn("cited", T.cited_aliases("response"))
    return g.select(
        "qid", F.array_join(F.array_sort(F.array_intersect("cited", known)), ",").alias("valid"),
        F.array_join(F.array_sort(F.array_except("cited", known)), ",").alias("invalid"),
    )


@book.add("""SELECT qid, regexp_replace(regexp_replace(regexp_replace(regexp_replace(response, '\\[ *P\\d+(?:[,;/ ]+P\\d+)* *\\]', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g'), '^[ \\t\\n.,;:]+', ''), '[ \\t\\n.,;:]+$', '') AS bare
  FROM generations WHERE response IS NOT NULL""")
def strip_citations(spark, sf):
    return V.generations(spark, sf).where("response IS NOT NULL").select("qid", T.strip_citations("response").alias("bare"))


@book.add("SELECT split, count(*) AS n, count(*) FILTER (contains(lower(response), 'insufficient evidence')) AS abstained, round(count(*) FILTER (contains(lower(response), 'insufficient evidence')) / count(*), 6) AS rate FROM generations WHERE response IS NOT NULL GROUP BY split")
def abstention_rate(spark, sf):
    g = V.generations(spark, sf).where("response IS NOT NULL").groupBy("split")
    return g.agg(F.count(F.lit(1)).alias("n"), F.count_if(T.is_abstention("response")).alias("abstained")).withColumn("rate", F.round(F.col("abstained") / F.col("n"), 6))


@book.add(""", r AS (SELECT qid, response || ' [P1.S1, P2] [P12.S1]' AS t, contains(lower(response), 'insufficient evidence') AS ab FROM generations WHERE response IS NOT NULL),
c AS (SELECT *, list_distinct(flatten(list_transform(regexp_extract_all(t, '\\[ *P\\d+(?:\\.S\\d+)?(?:[,;/ ]+P\\d+(?:\\.S\\d+)?)* *\\]'), lambda g: regexp_extract_all(g, 'P\\d+(?:\\.S\\d+)?')))) AS cited FROM r)
SELECT qid, ab AS abstained, array_to_string(list_sort(list_filter(cited, lambda a: contains(a, '.'))), ',') AS sentences, array_to_string(list_sort(list_filter(cited, lambda a: NOT contains(a, '.'))), ',') AS passages, len(cited) = 0 AS missing FROM c""")
def parse_sentence_citations(spark, sf):
    g = V.generations(spark, sf).where("response IS NOT NULL").withColumn("t", F.concat("response", F.lit(" [P1.S1, P2] [P12.S1]")))
    g = g.withColumn("cited", T.cited_aliases("t", T.MIXED_GROUP))
    return g.select(
        "qid", T.is_abstention("response").alias("abstained"),
        F.array_join(F.array_sort(F.filter("cited", lambda a: a.contains("."))), ",").alias("sentences"),
        F.array_join(F.array_sort(F.filter("cited", lambda a: ~a.contains("."))), ",").alias("passages"), (F.size("cited") == 0).alias("missing"),
    )


@book.add("SELECT qid, ('0x' || substr(sha256('t:' || qid), 1, 16))::UBIGINT::VARCHAR AS seed, round(('0x' || substr(sha256('t:' || qid), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE, 9) AS unit FROM questions")
def stable_hash_unit(spark, sf):
    x = F.concat(F.lit("t:"), "qid")
    return V.questions(spark, sf).select("qid", T.hash_u64(x).cast("string").alias("seed"), F.round(T.hash_unit(x), 9).alias("unit"))
