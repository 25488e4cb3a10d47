"""Challenge records: one question's nested example rewritten by chained struct expressions, and the rules that a record must meet.

An example is a row of qid, question, answer, level, qtype, split, passages (array of structs in the order of their slots) and
support (array of passage and sentence slots). Each builder returns a row for each example: the record as one struct, whose fields
stand in alphabetical order at every level, so that its compact JSON is canonical, and the hash of that JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.functions.lineage import cut

VERSION, SEED = "challenge-v1", 7
SPLITS = ("smoke", "dev", "eval")
#: Kinds of transformation and what is expected of an answer.
KINDS = {"missing_hop": "unanswerable", "answer_bearing_distractor": "answerable", "evidence_swap": "unanswerable"}
#: The auxiliaries that a negation follows.
AUXILIARY = r"(^|[^\p{L}\p{N}_])(is|are|was|were|has|have|had|can|could|will|would|do|does|did)(\s+not)?($|[^\p{L}\p{N}_])"
HEX = r"^[0-9a-f]{64}$"
PASSAGE = "index:int,is_gold:boolean,passage_id:string,sentences:array<string>,title:string"
#: What a record tells of its making; a kind has some of them and the others are null, which JSON leaves out.
PROVENANCE = {
    "donor_parent_question_id": "string", "donor_source_passage_id": "string", "donor_title": "string", "edit_operator": "string", "edited_sentence": "string",
    "inserted_sentence": "string", "original_sentence": "string", "preexisting_answer_mention": "boolean", "removed_source_passage_id": "string",
    "removed_source_sentence_ids": "array<string>", "replaced_slot": "int", "replacement_entity": "string", "replacement_source_passage_id": "string",
    "selection_mode": "string", "source_passage_id": "string", "source_passage_slot": "int", "source_sentence_id": "string", "source_sentence_slot": "int", "source_slot": "int",
}


def challenge_id(qid: Column, split: Column, kind: Column) -> Column:
    return F.concat(F.lit("ch-"), F.substring(F.sha2(F.to_json(F.array(F.lit(VERSION), split, qid, kind)), 256), 1, 24))


def passage_id(owner: Column, slot: Column) -> Column:
    return F.concat(owner, F.lit("-p"), T.padded(slot, 2))


def sentence_id(passage: Column, slot: Column) -> Column:
    return F.concat(passage, F.lit("-s"), T.padded(slot, 2))


def rank(kind: str, subject: Column, seed: int = SEED) -> Column:
    """The seeded order of what a question may choose from."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), "qid", F.lit(kind), subject), 256)


def first_of(found: Column, key) -> Column:
    """The element of an array whose key is least; null where there is none."""
    keyed = F.transform(found, lambda x: F.struct(key(x).alias("key"), x.alias("x")))
    return F.array_min(keyed)["x"]


def chosen(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with the columns, without those where one is null; each is made once (a filter would make it a second time)."""
    for name, made in columns.items():
        rows = rows.select("*", F.explode(F.array_compact(F.array(made))).alias(name))
    return rows


def mentions(text: Column, answer: Column) -> Column:
    """Whether the normalized text holds the normalized answer as whole words; an empty answer is in no text."""
    pad = lambda c: F.concat(F.lit(" "), T.normalize_answer(c), F.lit(" "))
    return (T.normalize_answer(answer) != "") & pad(text).contains(pad(answer))


def edit_sentence(s: Column, answer: Column, normalized: Column, entity: Column) -> tuple[Column, Column]:
    """A sentence made false and by which operation: another entity for the answer, else its first auxiliary negated or no longer so, else a prefix."""
    first = rf"(?is)^(.*?){AUXILIARY}"
    at = F.instr(F.lower(s), F.lower(answer))
    negated = F.regexp_extract(s, rf"(?is){AUXILIARY}", 3) != ""
    toggled = F.when(negated, F.regexp_replace(s, first, "$1$2$3$5")).otherwise(F.regexp_replace(s, first, "$1$2$3 not$5"))
    swapped = F.concat(F.substring(s, F.lit(1), at - 1), entity, F.substr(s, at + F.length(answer)))
    void, has = normalized == "", s.rlike(rf"(?is){AUXILIARY}")
    edited = F.when(void, None).when(at > 0, swapped).when(has, toggled).otherwise(F.concat(F.lit("It is not true that "), s))
    return edited, F.when(void, "invalid").when(at > 0, "answer_substitution").when(has, "negation_toggle").otherwise("negation_prefix")


def with_slots(examples: DataFrame) -> DataFrame:
    """The examples that have support, with gold, the slots of gold passages."""
    slots = F.transform("passages", lambda p, i: F.struct(i.alias("i"), p["is_gold"].alias("gold")))
    return examples.where(F.size("support") > 0).withColumn("gold", F.transform(F.filter(slots, lambda x: x["gold"]), lambda x: x["i"]))


def replace_slot(slot: Column, passage: Column) -> Column:
    return F.transform("passages", lambda p, i: F.when(i == slot, passage).otherwise(p))


def record(rows: DataFrame, kind: str, passages: Column, gold: Column, support: Column, changed: Column, provenance: dict[str, Column]) -> DataFrame:
    """qid, kind, record, content_hash of rows; ids are those of the new example, and flags and labels follow the slots that are left."""
    rows = rows.withColumns({"_id": challenge_id(F.col("qid"), F.col("split"), F.lit(kind)), "_passages": passages, "_gold": F.array_sort(gold), "_support": F.array_sort(support), "_changed": F.array_sort(changed)})
    owner = F.col("_id")
    remapped = F.transform(
        "_passages",
        lambda p, i: F.struct(i.alias("index"), F.array_contains("_gold", i).alias("is_gold"), passage_id(owner, i).alias("passage_id"), p["sentences"].alias("sentences"), p["title"].alias("title")),
    )
    example = F.struct(
        F.col("answer"), F.array().cast("array<string>").alias("dropped_supporting_facts"), F.transform("_gold", lambda i: passage_id(owner, i)).alias("gold_passage_ids"), F.col("level"), remapped.alias("passages"),
        F.col("qtype"), F.col("question"), owner.alias("question_id"), F.transform("_support", lambda x: sentence_id(passage_id(owner, x["p"]), x["s"])).alias("supporting_fact_sentence_ids"),
    )
    pending = KINDS[kind] == "unanswerable"
    review = F.struct(F.lit(not pending).alias("confirmatory_eligible"), F.lit(pending).alias("required"), F.lit("pending_two_annotators" if pending else "not_required").alias("status"))
    told = F.struct(*[provenance.get(name, F.lit(None)).cast(kind_).alias(name) for name, kind_ in PROVENANCE.items()])
    made = F.struct(
        owner.alias("challenge_id"), F.col("_changed").alias("changed_fields"), example.alias("example"), F.lit(KINDS[kind]).alias("expected_answerability"), parent_fingerprint().alias("parent_fingerprint"),
        F.col("qid").alias("parent_question_id"), told.alias("provenance"), review.alias("review"), F.lit(1).alias("schema_version"), F.lit(SEED).alias("seed"), F.col("split").alias("source_split"),
        F.lit(VERSION).alias("transform_version"), F.lit(kind).alias("transformation"),
    )
    return rows.select("qid", F.lit(kind).alias("kind"), made.alias("record")).withColumn("content_hash", content_hash(F.col("record")))


def parent_fingerprint() -> Column:
    return F.sha2(F.to_json(F.struct("answer", "level", "passages", "qtype", "question", "support")), 256)


def content_hash(record: Column) -> Column:
    return F.sha2(F.to_json(record), 256)


def path(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])


def answer_distractors(examples: DataFrame) -> DataFrame:
    """A sentence that names the answer is put to one passage that isn't gold, of those without the answer if there are any."""
    kind = "answer_bearing_distractor"
    rows = with_slots(examples)
    others = F.filter(F.transform("passages", lambda p, i: F.struct(i.alias("i"), p.alias("p"))), lambda x: ~x["p"]["is_gold"])
    others = F.transform(others, lambda x: F.struct(x["i"].alias("i"), x["p"].alias("p"), mentions(F.array_join(x["p"]["sentences"], " "), F.col("answer")).alias("has")))
    rows = chosen(rows, _pick=first_of(others, lambda x: F.struct(x["has"], rank(kind, x["p"]["passage_id"]))))
    slot, passage, has = F.col("_pick.i"), F.col("_pick.p"), F.col("_pick.has")
    inserted = F.concat(passage["title"], F.lit(" has also been associated with "), F.col("answer"), F.lit("."))
    changed = passage.withField("sentences", F.concat(passage["sentences"], F.array(inserted)))
    told = {"source_slot": slot, "source_passage_id": passage["passage_id"], "inserted_sentence": inserted, "selection_mode": F.when(has, "salience_only").otherwise("answer_free"), "preexisting_answer_mention": has}
    return record(rows, kind, replace_slot(slot, changed), F.col("gold"), F.col("support"), F.array(path("/example/passages/", slot, "/sentences")), told)


def evidence_swaps(examples: DataFrame) -> DataFrame:
    """One supporting sentence is made false and is no longer support; its passage stays gold while another sentence supports."""
    kind = "evidence_swap"
    rows = with_slots(examples).withColumns({"_answer": F.trim("answer"), "_na": T.normalize_answer("answer")}).where("_na <> ''")
    titled = F.filter("passages", lambda p: ~p["is_gold"] & (T.normalize_answer(p["title"]) != "") & (T.normalize_answer(p["title"]) != F.col("_na")))
    rows = chosen(rows, _other=first_of(titled, lambda p: rank(kind, p["passage_id"])), _at=first_of(F.col("support"), lambda x: rank(kind, sentence_id(F.get("passages", x["p"])["passage_id"], x["s"]))))
    p, s, other = F.col("_at.p"), F.col("_at.s"), F.col("_other")
    rows = rows.withColumn("_passage", F.get("passages", p)).withColumn("_sentence", F.get("_passage.sentences", s))
    edited, operation = edit_sentence(F.col("_sentence"), F.col("_answer"), F.col("_na"), other["title"])
    rows = rows.withColumns({"_edited": edited, "_operation": operation})
    left = F.filter("support", lambda x: ~((x["p"] == p) & (x["s"] == s)))
    rows = rows.withColumn("_left", left).withColumn("_gone", ~F.exists("_left", lambda x: x["p"] == p))
    passage = F.col("_passage").withField("sentences", F.transform("_passage.sentences", lambda x, i: F.when(i == s, F.col("_edited")).otherwise(x)))
    fields = F.concat(
        F.array(path("/example/passages/", p, "/sentences/", s), F.lit("/example/supporting_fact_sentence_ids")), F.when(F.col("_gone"), F.array(F.lit("/example/gold_passage_ids"))).otherwise(F.array().cast("array<string>"))
    )
    told = {
        "source_passage_slot": p, "source_sentence_slot": s, "source_sentence_id": sentence_id(F.col("_passage.passage_id"), s), "replacement_source_passage_id": other["passage_id"], "replacement_entity": other["title"],
        "edit_operator": F.col("_operation"), "original_sentence": F.col("_sentence"), "edited_sentence": F.col("_edited"),
    }
    return record(rows, kind, replace_slot(p, passage), F.filter("gold", lambda i: ~F.col("_gone") | (i != p)), F.col("_left"), fields, told)


def missing_hops(examples: DataFrame, donors: DataFrame) -> DataFrame:
    """One gold passage gives way to a foreign one; donors has qid, donor (a passage) and donor_qid. Questions without a donor have no row."""
    kind = "missing_hop"
    rows = with_slots(examples).join(donors, "qid")
    rows = chosen(rows, _slot=first_of(F.col("gold"), lambda i: rank(kind, F.get("passages", i)["passage_id"])))
    slot, gone = F.col("_slot"), F.get("passages", F.col("_slot"))
    removed = F.array_sort(F.filter("support", lambda x: x["p"] == slot))
    told = {
        "replaced_slot": slot, "removed_source_passage_id": gone["passage_id"], "removed_source_sentence_ids": F.transform(removed, lambda x: sentence_id(gone["passage_id"], x["s"])),
        "donor_parent_question_id": F.col("donor_qid"), "donor_source_passage_id": F.col("donor.passage_id"), "donor_title": F.col("donor.title"),
    }
    fields = F.array(F.lit("/example/gold_passage_ids"), path("/example/passages/", slot), F.lit("/example/supporting_fact_sentence_ids"))
    return record(rows, kind, replace_slot(slot, F.col("donor")), F.filter("gold", lambda i: i != slot), F.filter("support", lambda x: x["p"] != slot), fields, told)


def rules(c: Column, hashed: Column) -> dict[str, Column]:
    """What is wrong with a record, in the order in which the first counts; a null field fails its rule."""
    e, review = c["example"], c["review"]
    wrong = lambda fine: ~F.coalesce(fine, F.lit(False))
    owner, pids = c["challenge_id"], F.transform(e["passages"], lambda p: p["passage_id"])
    flagged = F.transform(F.filter(e["passages"], lambda p: p["is_gold"]), lambda p: p["passage_id"])
    pending = (c["transformation"] != "answer_bearing_distractor")
    gate = F.when(pending, (c["expected_answerability"] == "unanswerable") & review["required"]).otherwise((c["expected_answerability"] == "answerable") & ~review["required"])
    gates = (review["required"] & (review["status"] == "pending_two_annotators") & ~review["confirmatory_eligible"]) | (~review["required"] & (review["status"] == "not_required") & review["confirmatory_eligible"])
    parts = F.transform(e["supporting_fact_sentence_ids"], lambda x: F.struct(F.regexp_extract(x, r"^(.+-p\d{2,})-s\d{2,}$", 1).alias("pid"), F.regexp_extract(x, r"-s(\d{2,})$", 1).try_cast("int").alias("s")))
    inside = F.forall(parts, lambda x: F.coalesce(x["s"] < F.size(F.get(F.filter(e["passages"], lambda p: p["passage_id"] == x["pid"]), F.lit(0))["sentences"]), F.lit(False)))
    return {
        "schema_version": wrong(c["schema_version"] == 1),
        "challenge_id": wrong(owner.rlike(r"^ch-[0-9a-f]{24}$")),
        "parent_question_id": wrong(c["parent_question_id"] != ""),
        "source_split": wrong(c["source_split"].isin(*SPLITS)),
        "transformation": wrong(c["transformation"].isin(*KINDS)),
        "transform_version": wrong(c["transform_version"] == VERSION),
        "seed": c["seed"].isNull(),
        "expected_answerability": wrong(c["expected_answerability"].isin("answerable", "unanswerable")),
        "identity": wrong(owner == challenge_id(c["parent_question_id"], c["source_split"], c["transformation"])),
        "review": wrong(gates),
        "gate": wrong(gate),
        "changed_paths": wrong(F.forall(c["changed_fields"], lambda x: x.startswith("/example/"))),
        "changed_order": wrong((F.size(c["changed_fields"]) > 0) & (c["changed_fields"] == F.array_sort(F.array_distinct(c["changed_fields"])))),
        "provenance": c["provenance"].isNull(),
        "parent_fingerprint": wrong(c["parent_fingerprint"].rlike(HEX)),
        "example": e.isNull(),
        "example_id": wrong(e["question_id"] == owner),
        "passage_ids": wrong(pids == F.transform(e["passages"], lambda p, i: passage_id(owner, i))),
        "passage_indices": wrong(F.transform(e["passages"], lambda p: p["index"]) == F.transform(e["passages"], lambda p, i: i)),
        "gold_labels": wrong(e["gold_passage_ids"] == flagged),
        "support_ids": wrong(F.forall(parts, lambda x: F.array_contains(e["gold_passage_ids"], x["pid"]))),
        "support_range": wrong(inside),
        "dropped_facts": wrong(F.size(e["dropped_supporting_facts"]) == 0),
        "hash_form": wrong(hashed.rlike(HEX)),
        "content_hash": wrong(hashed == content_hash(c)),
    }


def violations(records: DataFrame) -> DataFrame:
    """The records that break a rule, with the first one and all of them."""
    broken = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules(F.col("record"), F.col("content_hash")).items()]))
    return records.withColumn("rules", broken).where(F.size("rules") > 0).withColumn("rule", F.get("rules", F.lit(0)))


#: Donors of a split that are tried first, as few as that; bytes of their texts up to which they are broadcast; questions up to which these are broadcast instead; parts that donors are dealt out to beyond that.
NEAR, SMALL, FEW, SALTS = 25, 8 << 20, 1000, 64
#: How many times more donors each range of hashes has than those before it.
WIDER = 16


def first_donors(questions: DataFrame, donors: DataFrame, near: int = NEAR, small: int = SMALL, salts: int = SALTS, few: int = FEW) -> DataFrame:
    """qid and the first donor, by its hash h within the split, that is foreign to the question and free of its answer.

    questions: qid, split, needle (normalized answer), titles and bodies (hashes of its own passages). donors: split, dq (its question), pid, title and
    body (hashes), hay (normalized text), h. Nearly all questions are served by the donors of least hash, so those meet the questions first, where these lie;
    only questions that found none meet the next range, and ranges end with the questions, so texts of further donors are never normalized. Beyond
    ``small`` bytes of texts donors stay where they lie and meet the ``few`` questions that are left; more questions meet donors dealt out by salts, so no task
    has a whole split. A range is one of hashes: no order over a split is needed.
    """
    left = cut(questions)
    n, splits = donors.agg(F.count(F.lit(1)), F.count_distinct("split")).first()
    share = min(1.0, near * max(1, splits) / max(1, n))
    shares = [share]
    while shares[-1] < 1:
        shares.append(shares[-1] * WIDER)
    bounds = ["", *(format(int(x * (1 << 52)), "013x") for x in shares if x < 1), "g"]
    found, asked = None, left.count()
    for low, high, part in zip(bounds[:-1], bounds[1:], shares, strict=True):
        if found is not None and not asked:
            break
        some = donors.where((F.col("h") >= low) & (F.col("h") < high)).withColumnRenamed("pid", "donor_pid")
        first = part * n <= WIDER * near * max(1, splits)  # few enough to be kept
        some = cut(some) if first else some
        if first and (some.agg(F.sum(F.length("hay"))).first()[0] or 0) <= small:
            pairs = left.join(F.broadcast(some), "split")
        elif asked <= few:
            pairs = some.join(F.broadcast(left), "split")
        else:
            dealt = some.withColumn("_salt", F.pmod(F.xxhash64("donor_pid"), F.lit(salts)))
            pairs = left.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))).join(dealt, ["split", "_salt"])
        free = (F.col("needle") == "") | ~F.concat(F.lit(" "), "hay", F.lit(" ")).contains(F.concat(F.lit(" "), "needle", F.lit(" ")))
        ok = (F.col("dq") != F.col("qid")) & ~F.array_contains("titles", F.col("title")) & ~F.array_contains("bodies", F.col("body")) & free
        hit = cut(pairs.where(ok).groupBy("qid").agg(F.min_by("donor_pid", "h").alias("donor_pid")))
        found = hit if found is None else found.unionByName(hit)
        left = cut(left.join(hit.select("qid"), "qid", "left_anti"))
        asked = left.count()
    return found
