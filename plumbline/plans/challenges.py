"""Challenge records of all three kinds, what keeps a question from having one, and the rules on planted faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.functions.lineage import cut
from plumbline.operators import challenges as C
from plumbline.plans.book import Book
from plumbline.plans.data import foreign_donors
from plumbline.plans.text import NORM
from plumbline.sources import fixture as V
from plumbline.sources.fixture import _bucket

book = Book()
QUERIES, ORACLES = book.queries, book.oracles


def examples(spark, sf):
    """The nested examples: ten passages by slot; the first two sentences of a gold passage are its support."""
    gold = V.gold_heads(spark, sf).select("pid", F.lit(True).alias("gold"))
    p = V.passages(spark, sf).join(gold, "pid", "left")
    sentences = F.coalesce("sentences", F.array().cast("array<string>"))
    passage = F.struct(F.col("idx").cast("int").alias("index"), F.coalesce("gold", F.lit(False)).alias("is_gold"), F.col("pid").alias("passage_id"), sentences.alias("sentences"), F.coalesce("title", F.lit("")).alias("title"))
    nested = p.groupBy("qid").agg(F.array_sort(F.collect_list(passage)).alias("passages"))
    first = F.transform("passages", lambda x, i: F.when(x["is_gold"], F.transform(F.slice(x["sentences"], 1, 2), lambda _, s: F.struct(i.alias("p"), s.alias("s")))).otherwise(F.array().cast("array<struct<p:int,s:int>>")))
    return V.questions(spark, sf).join(nested.withColumn("support", F.flatten(first)), "qid")


def donors(spark, sf):
    """qid, donor_qid, donor: the passages that foreign_donors names."""
    p = V.passages(spark, sf)
    donor = F.struct(F.col("idx").cast("int").alias("index"), F.lit(False).alias("is_gold"), F.col("pid").alias("passage_id"), "sentences", "title")
    return foreign_donors(spark, sf).join(p.select(F.col("pid").alias("donor_pid"), F.col("qid").alias("donor_qid"), donor.alias("donor")), "donor_pid").drop("donor_pid")


def records(spark, sf, x=None):
    """The records of all kinds; ``x`` are the examples where they are at hand. They are kept once and read for each kind."""
    x = cut(examples(spark, sf)) if x is None else x
    return C.missing_hops(x, donors(spark, sf)).unionByName(C.answer_distractors(x)).unionByName(C.evidence_swaps(x))


PAD = "lpad({0}::VARCHAR, greatest(2, length({0}::VARCHAR))::INTEGER, '0')".format
RANK = "sha256('7:' || qid || ':{}:' || {})".format
ANSWERED = f"({NORM.format('answer')} <> '' AND contains(' ' || {NORM.format('body')} || ' ', ' ' || {NORM.format('answer')} || ' '))"
AUX = C.AUXILIARY
RECORDS = f""", sup AS (SELECT qid, pid, idx AS p, unnest(range(least(2, len(sentences)))) AS s, sentences FROM gold),
ql AS (SELECT q.* FROM questions q WHERE qid IN (SELECT qid FROM sup)),
cell AS (SELECT p.qid, p.idx, p.pid, title || chr(31) || array_to_string(sentences, chr(31)) AS c, title, sentences, body, p.pid IN (SELECT pid FROM gold) AS is_gold FROM passages p),
other AS (SELECT cell.*, answer FROM cell JOIN ql USING (qid) WHERE NOT is_gold),
da AS (SELECT qid, 'answer_bearing_distractor' AS kind, idx AS slot, CASE WHEN has THEN 'salience_only' ELSE 'answer_free' END AS operation, c || chr(31) || title || ' has also been associated with ' || answer || '.' AS c, NULL::BIGINT AS s FROM
  (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY has, {RANK('answer_bearing_distractor', 'pid')}) AS k FROM (SELECT *, {ANSWERED} AS has FROM other)) WHERE k = 1),
en AS (SELECT qid, arg_min(title, {RANK('evidence_swap', 'pid')}) AS entity FROM other WHERE {NORM.format('title')} <> '' AND {NORM.format('title')} <> {NORM.format('answer')} AND {NORM.format('answer')} <> '' GROUP BY qid),
ss AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {RANK('evidence_swap', "pid || '-s' || " + PAD('s'))}) AS k FROM sup) WHERE k = 1),
sd AS (SELECT ss.qid, ss.p, ss.s, title, ss.sentences, ss.sentences[ss.s + 1] AS x, trim(answer) AS a, entity FROM ss JOIN en USING (qid) JOIN ql USING (qid) JOIN cell ON cell.pid = ss.pid),
se AS (SELECT *, CASE WHEN strpos(lower(x), lower(a)) > 0 THEN 'answer_substitution' WHEN regexp_matches(x, '(?is){AUX}') THEN 'negation_toggle' ELSE 'negation_prefix' END AS operation,
  CASE WHEN strpos(lower(x), lower(a)) > 0 THEN substr(x, 1, strpos(lower(x), lower(a)) - 1) || entity || substr(x, strpos(lower(x), lower(a)) + length(a))
  WHEN regexp_matches(x, '(?is){AUX}') AND regexp_extract(x, '(?is){AUX}', 3) <> '' THEN regexp_replace(x, '(?is){AUX}', '\\1\\2\\4') WHEN regexp_matches(x, '(?is){AUX}') THEN regexp_replace(x, '(?is){AUX}', '\\1\\2 not\\4')
  ELSE 'It is not true that ' || x END AS edited FROM sd),
ds AS (SELECT qid, 'evidence_swap' AS kind, p AS slot, operation, title || chr(31) || array_to_string(list_transform(sentences, lambda y, i: CASE WHEN i = s + 1 THEN edited ELSE y END), chr(31)) AS c, s FROM se),
dn AS (SELECT p.*, split FROM passages p JOIN questions USING (qid) WHERE pid NOT IN (SELECT pid FROM gold) AND body <> ''),
cd AS (SELECT q.qid, d.pid FROM questions q JOIN dn d ON d.split = q.split AND d.qid <> q.qid WHERE NOT EXISTS (SELECT 1 FROM passages o WHERE o.qid = q.qid AND (o.title = d.title OR o.body = d.body))
  AND ({NORM.format('q.answer')} = '' OR NOT contains(' ' || {NORM.format('d.body')} || ' ', ' ' || {NORM.format('q.answer')} || ' '))),
dp AS (SELECT qid, arg_min(pid, sha256('donor:' || pid)) AS pid FROM cd GROUP BY qid),
ms AS (SELECT qid, arg_min(idx, {RANK('missing_hop', 'pid')}) AS slot FROM gold WHERE qid IN (SELECT qid FROM sup) GROUP BY qid),
dm AS (SELECT ms.qid, 'missing_hop' AS kind, slot, dp.pid AS operation, c, NULL::BIGINT AS s FROM ms JOIN dp USING (qid) JOIN cell ON cell.pid = dp.pid),
made AS (SELECT *, 'ch-' || substr(sha256('["challenge-v1","' || split || '","' || qid || '","' || kind || '"]'), 1, 24) AS challenge_id FROM (FROM da UNION ALL FROM ds UNION ALL FROM dm) JOIN ql USING (qid)),
lf AS (SELECT m.challenge_id, u.p, u.s FROM made m JOIN sup u USING (qid) WHERE NOT coalesce(m.kind = 'missing_hop' AND u.p = m.slot OR m.kind = 'evidence_swap' AND u.p = m.slot AND u.s = m.s, false)),
gl AS (SELECT m.challenge_id, g.idx FROM made m JOIN gold g USING (qid) WHERE NOT (m.kind = 'missing_hop' AND g.idx = m.slot) AND NOT (m.kind = 'evidence_swap' AND g.idx = m.slot AND NOT EXISTS (SELECT 1 FROM lf WHERE lf.challenge_id = m.challenge_id AND lf.p = g.idx))) """


@book.add(RECORDS + f"""SELECT qid, kind, made.challenge_id, CASE WHEN kind = 'answer_bearing_distractor' THEN 'answerable' ELSE 'unanswerable' END AS expected, operation,
  CASE kind WHEN 'missing_hop' THEN '/example/gold_passage_ids,/example/passages/' || slot || ',/example/supporting_fact_sentence_ids' WHEN 'answer_bearing_distractor' THEN '/example/passages/' || slot || '/sentences'
  ELSE CASE WHEN (made.challenge_id, slot) IN (SELECT (challenge_id, idx) FROM gl) THEN '' ELSE '/example/gold_passage_ids,' END || '/example/passages/' || slot || '/sentences/' || s || ',/example/supporting_fact_sentence_ids' END AS changed,
  coalesce((SELECT string_agg(made.challenge_id || '-p' || {PAD('idx')}, ',' ORDER BY idx) FROM gl WHERE gl.challenge_id = made.challenge_id), '') AS gold_ids,
  coalesce((SELECT string_agg(made.challenge_id || '-p' || {PAD('p')} || '-s' || {PAD('lf.s')}, ',' ORDER BY p, lf.s) FROM lf WHERE lf.challenge_id = made.challenge_id), '') AS support_ids,
  (SELECT sha256(string_agg(CASE WHEN idx = slot THEN made.c ELSE cell.c END, chr(30) ORDER BY idx)) FROM cell WHERE cell.qid = made.qid) AS passages_hash FROM made""")
def challenge_records(spark, sf):
    """What the built records hold, by kind: operation is the selection, the edit or the donor."""
    r = F.col("record")
    told = F.coalesce(r["provenance"]["selection_mode"], r["provenance"]["edit_operator"], r["provenance"]["donor_source_passage_id"])
    cells = F.transform(r["example"]["passages"], lambda p: F.concat(p["title"], F.lit("\x1f"), F.array_join(p["sentences"], "\x1f")))
    return records(spark, sf).select(
        "qid", "kind", r["challenge_id"].alias("challenge_id"), r["expected_answerability"].alias("expected"), told.alias("operation"), F.array_join(r["changed_fields"], ",").alias("changed"),
        F.array_join(r["example"]["gold_passage_ids"], ",").alias("gold_ids"), F.array_join(r["example"]["supporting_fact_sentence_ids"], ",").alias("support_ids"), F.sha2(F.array_join(cells, "\x1e"), 256).alias("passages_hash"),
    )


@book.add(RECORDS + f""", k(kind) AS (VALUES ('missing_hop'), ('answer_bearing_distractor'), ('evidence_swap'))
SELECT qid, kind, CASE WHEN qid NOT IN (SELECT qid FROM sup) THEN 'no_support' WHEN kind = 'missing_hop' THEN 'no_donor' WHEN kind = 'answer_bearing_distractor' THEN 'no_passage' WHEN {NORM.format('answer')} = '' THEN 'empty_answer' ELSE 'no_entity' END AS reason
FROM questions, k WHERE NOT EXISTS (SELECT 1 FROM made WHERE made.qid = questions.qid AND made.kind = k.kind)""")
def challenge_failures(spark, sf):
    """Questions that can't have a record of a kind, with the reason."""
    kept = cut(examples(spark, sf))
    x = kept.select("qid", (F.size("support") > 0).alias("supported"), (T.normalize_answer("answer") == "").alias("empty"), F.explode(F.array(*map(F.lit, C.KINDS))).alias("kind"))
    missing = x.join(records(spark, sf, kept).select("qid", "kind"), ["qid", "kind"], "left_anti")
    reason = F.when(~F.col("supported"), "no_support").when(F.col("kind") == "missing_hop", "no_donor").when(F.col("kind") == "answer_bearing_distractor", "no_passage").when(F.col("empty"), "empty_answer").otherwise("no_entity")
    return missing.select("qid", "kind", reason.alias("reason"))


@book.add(RECORDS + "SELECT split, kind, count(*) AS n, sum(('0x' || substr(sha256(challenge_id), 1, 8))::UBIGINT)::BIGINT AS digest FROM made GROUP BY ALL")
def challenge_manifest(spark, sf):
    """Of what was prepared: records by split and kind, and a digest of their ids that needs no order."""
    first = F.conv(F.substring(F.sha2("record.challenge_id", 256), 1, 8), 16, 10).cast("long")
    return records(spark, sf).groupBy(F.col("record.source_split").alias("split"), "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(first).alias("digest"))


def planted(rows):
    """The records with one fault each by a hash of their id, and rule, which it breaks; every second one stays sound. Faults before the hash rules are hashed anew."""
    shape = rows.schema["record"].dataType.simpleString()  # in which any field may be null
    rows = rows.withColumn("record", F.col("record").cast(shape))
    r = F.col("record")
    put = lambda name, value: r.withField(name, value)
    gate = lambda need: F.struct(F.lit(not need).alias("confirmatory_eligible"), F.lit(need).alias("required"), F.lit("pending_two_annotators" if need else "not_required").alias("status"))
    first = lambda **more: put("example", r["example"].withField("passages", F.transform(r["example"]["passages"], lambda p, i: F.when(i == 0, p.withField(*next(iter(more.items())))).otherwise(p))))
    example = lambda name, value: put("example", r["example"].withField(name, value))
    none = lambda name: F.lit(None).cast(rows.schema["record"].dataType[name].dataType.simpleString())
    answerable = r["transformation"] == "answer_bearing_distractor"
    faults = {
        "schema_version": put("schema_version", F.lit(2)), "challenge_id": put("challenge_id", F.lit("bad")), "parent_question_id": put("parent_question_id", F.lit("")), "source_split": put("source_split", F.lit("train")),
        "transformation": put("transformation", F.lit("typo")), "transform_version": put("transform_version", F.lit("challenge-v0")), "seed": put("seed", F.lit(None).cast("int")), "expected_answerability": put("expected_answerability", F.lit("maybe")),
        "identity": put("challenge_id", F.lit("ch-" + "0" * 24)), "review": put("review", r["review"].withField("required", ~r["review"]["required"])), "gate": put("review", F.when(answerable, gate(True)).otherwise(gate(False))),
        "changed_paths": put("changed_fields", F.array(F.lit("/other"))), "changed_order": put("changed_fields", F.array(F.lit("/example/b"), F.lit("/example/a"))), "provenance": put("provenance", none("provenance")),
        "parent_fingerprint": put("parent_fingerprint", F.lit("xyz")), "example": put("example", none("example")), "example_id": example("question_id", F.lit("other")), "passage_ids": first(passage_id=F.lit("x")), "passage_indices": first(index=F.lit(7)),
        "gold_labels": example("gold_passage_ids", F.array(F.lit("other-p00"))), "support_ids": example("supporting_fact_sentence_ids", F.array(F.lit("nonsense"))),
        "support_range": example("supporting_fact_sentence_ids", F.array(F.concat(F.get(r["example"]["gold_passage_ids"], F.lit(0)), F.lit("-s999999999")))), "dropped_facts": example("dropped_supporting_facts", F.array(F.lit("x"))),
    }
    names = [*faults, "hash_form", "content_hash"]
    k = T.bucket(F.concat(F.lit("fault:"), r["challenge_id"]), 2 * len(names))
    out, fault = rows.withColumn("k", k), r
    for i, name in enumerate(faults):
        fault = F.when(F.col("k") == i, faults[name].cast(shape)).otherwise(fault)
    out = out.withColumn("planted", F.get(F.array(*map(F.lit, names)), F.col("k").cast("int"))).withColumn("own", r["challenge_id"]).withColumn("record", fault)
    hashed = F.when(F.col("planted") == "hash_form", F.lit("zz")).when(F.col("planted") == "content_hash", F.lit("0" * 64)).otherwise(C.content_hash(r))
    return out.withColumn("content_hash", hashed)


RULES = (
    "schema_version", "challenge_id", "parent_question_id", "source_split", "transformation", "transform_version", "seed", "expected_answerability", "identity", "review", "gate", "changed_paths", "changed_order", "provenance",
    "parent_fingerprint", "example", "example_id", "passage_ids", "passage_indices", "gold_labels", "support_ids", "support_range", "dropped_facts", "hash_form", "content_hash",
)


@book.add(RECORDS + f", f AS (SELECT challenge_id, {_bucket(chr(39) + 'fault:' + chr(39) + ' || challenge_id', 2 * len(RULES))} AS k FROM made) SELECT challenge_id, [{', '.join(f'{chr(39)}{x}{chr(39)}' for x in RULES)}][k + 1] AS rule FROM f WHERE k < {len(RULES)}")
def challenge_record_violations(spark, sf):
    """The first broken rule of each record, over records of which half have a planted fault. What is validated is stored records, so both are cut off."""
    return C.violations(cut(planted(cut(records(spark, sf))))).select(F.col("own").alias("challenge_id"), "rule")
