"""Challenge records built from small examples, their canonical hashes, the rules, and the search for donors."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators import challenges as C

SHAPE = (
    "qid string, question string, answer string, level string, qtype string, split string, "
    "passages array<struct<index:int,is_gold:boolean,passage_id:string,sentences:array<string>,title:string>>, support array<struct<p:int,s:int>>"
)


def example(qid, cells, support, answer="Blue Whale", split="dev"):
    """cells: (title, sentences, gold)."""
    return (qid, f"What is {qid}?", answer, "hard", "bridge", split, [(i, g, f"{qid}-p{i:02d}", s, t) for i, (t, s, g) in enumerate(cells)], support)


PLAIN = [("Whale", ["The blue whale is big.", "It swims.", "More."], True), ("Ocean", ["Water — wide.", "Deep."], True), ("Tree", ["A tree was green."], False), ("Rock", ["blue whale rock"], False)]


def build(spark, rows, donor=None):
    x = spark.createDataFrame(rows, SHAPE)
    d = spark.createDataFrame(donor or [(r[0], "q9", (3, False, "q9-p03", ["Foreign text."], "Foreign")) for r in rows], "qid string, donor_qid string, donor struct<index:int,is_gold:boolean,passage_id:string,sentences:array<string>,title:string>")
    made = C.missing_hops(x, d).unionByName(C.answer_distractors(x)).unionByName(C.evidence_swaps(x))
    return {(r["qid"], r["kind"]): json.loads(r["j"]) | {"hash": r["content_hash"]} for r in made.withColumn("j", F.to_json("record")).collect()}, made


def test_records(spark):
    got, made = build(spark, [example("q1", PLAIN, [(0, 0), (0, 1), (1, 0)])])
    assert set(got) == {("q1", k) for k in C.KINDS}
    for (_, kind), r in got.items():
        body = {k: v for k, v in r.items() if k != "hash"}
        assert hashlib.sha256(json.dumps(body, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest() == r["hash"]
        cid = "ch-" + hashlib.sha256(json.dumps(["challenge-v1", "dev", "q1", kind], separators=(",", ":")).encode()).hexdigest()[:24]
        assert r["challenge_id"] == r["example"]["question_id"] == cid
        assert [p["passage_id"] for p in r["example"]["passages"]] == [f"{cid}-p{i:02d}" for i in range(4)]
        assert r["example"]["gold_passage_ids"] == [p["passage_id"] for p in r["example"]["passages"] if p["is_gold"]]
        assert r["changed_fields"] == sorted(set(r["changed_fields"]))
    hop = got["q1", "missing_hop"]
    slot = hop["provenance"]["replaced_slot"]
    assert hop["example"]["passages"][slot]["title"] == "Foreign" and len(hop["example"]["gold_passage_ids"]) == 1
    assert len(hop["example"]["supporting_fact_sentence_ids"]) == (1 if slot == 0 else 2) and len(hop["provenance"]["removed_source_sentence_ids"]) == (2 if slot == 0 else 1)
    extra = got["q1", "answer_bearing_distractor"]
    assert extra["provenance"]["source_slot"] == 2 and extra["provenance"]["selection_mode"] == "answer_free" and extra["review"]["status"] == "not_required"
    assert extra["example"]["passages"][2]["sentences"][-1] == "Tree has also been associated with Blue Whale."
    swap = got["q1", "evidence_swap"]
    p = swap["provenance"]
    assert swap["example"]["passages"][p["source_passage_slot"]]["sentences"][p["source_sentence_slot"]] == p["edited_sentence"] != p["original_sentence"]
    assert f"{swap['challenge_id']}-p{p['source_passage_slot']:02d}-s{p['source_sentence_slot']:02d}" not in swap["example"]["supporting_fact_sentence_ids"]
    assert ("/example/gold_passage_ids" in swap["changed_fields"]) == (p["source_passage_slot"] == 1)
    assert C.violations(made).collect() == []


def test_what_has_no_record(spark):
    rows = [
        example("none", PLAIN, []), example("void", PLAIN, [(0, 0)], answer=" !"), example("gold", PLAIN[:2], [(0, 0), (1, 0)]),
        example("said", [PLAIN[0], PLAIN[3]], [(0, 0)]), example("same", [PLAIN[0], ("blue whale", ["x"], False)], [(0, 0)]),
    ]
    got, _ = build(spark, rows, [("gold", "q9", (0, False, "q9-p00", ["x"], "y"))])
    assert set(got) == {("gold", "missing_hop"), ("void", "answer_bearing_distractor"), ("said", "answer_bearing_distractor"), ("said", "evidence_swap"), ("same", "answer_bearing_distractor")}
    assert got["said", "answer_bearing_distractor"]["provenance"]["selection_mode"] == "salience_only"
    assert build(spark, rows)[1].limit(0).collect() == []


@pytest.mark.parametrize(("sentence", "want", "operation"), [
    ("The BLUE whale swims", "The Tree swims", "answer_substitution"), ("It is big and was so", "It is not big and was so", "negation_toggle"), ("It is  not big", "It is big", "negation_toggle"),
    ("Isolated words", "It is not true that Isolated words", "negation_prefix"), ("Could it", "Could not it", "negation_toggle"),
])
def test_edits(spark, sentence, want, operation):
    edited, how = C.edit_sentence(F.lit(sentence), F.lit("blue whale"), F.lit("blue whale"), F.lit("Tree"))
    assert tuple(spark.range(1).select(edited, how).first()) == (want, operation)


def test_all_broken_rules_are_told(spark):
    _, made = build(spark, [example("q1", PLAIN, [(0, 0), (1, 0)])])
    bad = made.withColumn("record", F.col("record").withField("seed", F.lit(None).cast("int")).withField("source_split", F.lit("train")))
    for r in C.violations(bad).collect():
        assert r["rule"] == "source_split" and set(r["rules"]) == {"source_split", "seed", "identity", "content_hash"}


@pytest.mark.parametrize(("near", "small"), [(25, 8 << 20), (1, 8 << 20), (1, 0)])
def test_first_donors(spark, near, small):
    h = lambda x: hashlib.sha256(x.encode()).hexdigest()
    words = ["alpha", "beta", "gamma", "delta"]
    donors = [(["dev", "eval"][i % 2], f"q{i % 30}", f"d{i}", f"t{i % 7}", f"b{i % 11}", f"{words[i % 4]} text {words[i % 3]}", h(f"d{i}")) for i in range(200)]
    asked = [(f"q{i}", ["dev", "eval", "smoke"][i % 3], ["alpha", "", "beta", "text"][i % 4], [f"t{i % 7}"], [f"b{(i * 5) % 11}", "b0"]) for i in range(30)]
    ok = lambda q, d: q[1] == d[0] and q[0] != d[1] and d[3] not in q[3] and d[4] not in q[4] and (not q[2] or f" {q[2]} " not in f" {d[5]} ")
    want = {(q[0], min((d for d in donors if ok(q, d)), key=lambda d: d[6])[2]) for q in asked if any(ok(q, d) for d in donors)}
    found = C.first_donors(spark.createDataFrame(asked, "qid string, split string, needle string, titles array<string>, bodies array<string>"), spark.createDataFrame(donors, "split string, dq string, pid string, title string, body string, hay string, h string"), near, small, 4)
    assert {tuple(r) for r in found.select("qid", "donor_pid").collect()} == want and len(want) > 10


def test_donors_beyond_need_are_not_read(spark):
    """Donors whose texts aren't needed are never normalized: one that fails where it is read does no harm; questions left over meet donors where these lie or dealt out, with one result."""
    h = lambda k: f"{k:064x}"
    step = (1 << 256) // 2000
    rows = [("dev", f"q{i}", f"d{i}", f"t{i}", f"b{i}", "rare word" if i < 1500 else "plain", h(i * step)) for i in range(2000)]
    donors = spark.createDataFrame(rows, "split string, dq string, pid string, title string, body string, hay string, h string")
    trap = donors.withColumn("hay", F.when(F.col("h") > h(1000 * step), F.raise_error(F.lit("read")).cast("string")).otherwise(F.col("hay")))
    shape = "qid string, split string, needle string, titles array<string>, bodies array<string>"
    got = C.first_donors(spark.createDataFrame([("x", "dev", "", ["t0"], ["b1"])], shape), trap)
    assert [tuple(r) for r in got.select("qid", "donor_pid").collect()] == [("x", "d2")]
    asked = spark.createDataFrame([("x", "dev", "rare", ["t1500"], []), ("y", "dev", "word", [], ["b9"]), ("z", "dev", "plain", [], [])], shape)
    for few in (0, 1000):
        got = C.first_donors(asked, donors, small=0, few=few)
        assert {tuple(r) for r in got.select("qid", "donor_pid").collect()} == {("x", "d1501"), ("y", "d1500"), ("z", "d0")}


def test_normalized_as_defined(spark):
    from plumbline.functions import text as T

    texts = ["", "a", " the", "A a the an x", "don't the-cat", "a\tan\nthe\r\x0b\fx", "ana the then an. x", "!a!", "\u3000a\u3000", "x  y ", "a " * 20000]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "t string").select(T.normalize_answer("t")).collect()]
    bare = ["".join(c for c in x.lower() if c not in T.PUNCTUATION) for x in texts]
    words = [[w for w in __import__("re").split("[ \t\n\x0b\f\r]+", x) if w not in ("", "a", "an", "the")] for x in bare]
    assert got == [" ".join(w) for w in words]
