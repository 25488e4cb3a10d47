"""Records, leakage groups, splits, provenance and challenge queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.functions import text as T
from plumbline.functions.lineage import join_hot
from plumbline.operators import challenges as C
from plumbline.operators import grouping as G
from plumbline.operators.ranking import place_by_hash
from plumbline.plans.book import Book
from plumbline.plans.text import EXAMPLE, NORM, fingerprints
from plumbline.sources import fixture as V
from plumbline.sources.fixture import _bucket

book = Book()
QUERIES, ORACLES = book.queries, book.oracles
H = lambda tag, c="qid": T.bucket(F.concat(F.lit(f"{tag}:"), c))
h = lambda tag, n=100, c="qid": _bucket(f"'{tag}:' || {c}", n)


@book.add("SELECT user_id, count(*) FILTER (event_id % 97 = 0) AS corrupt, count(*) FILTER (event_id % 97 <> 0) AS good, bool_or(event_id % 97 = 0 AND NOT last_) AS fatal FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AS last_ FROM events) GROUP BY user_id", view=False)
def jsonl_corruption_audit(spark, sf):
    """A log's last line may be cut off; a broken line before it is fatal."""
    e = V.read(spark, sf, "events")
    line = F.to_json(F.struct("event_id", "event_type"))
    line = F.when(F.col("event_id") % 97 == 0, F.left(line, F.lit(9))).otherwise(line)
    last = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))) == 1
    parsed = e.select("user_id", last.alias("last"), F.from_json(line, "event_id bigint, event_type string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = F.col("r._bad").isNotNull()
    return parsed.groupBy("user_id").agg(F.count_if(bad).alias("corrupt"), F.count_if(~bad).alias("good"), F.bool_or(bad & ~F.col("last")).alias("fatal"))


@book.add(f"SELECT qid FROM questions WHERE NOT {h('done')} < 40 OR {h('err')} < 10")
def resume_pending_keys(spark, sf):
    q = V.questions(spark, sf).select("qid")
    done = q.where((H("done") < 40) & ~(H("err") < 10))
    return q.join(done, "qid", "left_anti")


@book.add(f"SELECT pid FROM passages WHERE {h('cache', 100, 'pid')} >= 30")
def join_anti_resume(spark, sf):
    p = V.passages(spark, sf).select("pid")
    return p.join(p.where(H("cache", "pid") < 30), "pid", "left_anti")


@book.add("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL", view=False)
def latest_record_wins(spark, sf):
    e = V.read(spark, sf, "events").groupBy("user_id", "event_type")
    return e.agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@book.add(EXAMPLE + ", m AS (SELECT qid, CASE WHEN right(qid, 1) = '3' THEN 'stale' ELSE fingerprint END AS expected FROM fp WHERE right(qid, 1) <> '4') SELECT coalesce(fp.qid, m.qid) AS qid, CASE WHEN m.qid IS NULL THEN 'unlisted' WHEN fp.qid IS NULL THEN 'missing' ELSE 'changed' END AS violation FROM fp FULL JOIN m USING (qid) WHERE m.qid IS NULL OR fp.qid IS NULL OR fingerprint <> expected")
def fingerprint_verification(spark, sf):
    own = fingerprints(spark, sf).select("qid", "fingerprint")
    last = F.right("qid", F.lit(1))
    manifest = own.where(last != "4").select("qid", F.when(last == "3", "stale").otherwise(F.col("fingerprint")).alias("expected"))
    both = own.join(manifest, "qid", "full_outer")
    kind = F.when(F.col("expected").isNull(), "unlisted").when(F.col("fingerprint").isNull(), "missing").when(F.col("fingerprint") != F.col("expected"), "changed")
    return both.select("qid", kind.alias("violation")).where("violation IS NOT NULL")


@book.add("SELECT qid, sha256(qid || '|' || string_agg(pid, ',' ORDER BY pid) || '|' || max(answer)) AS key FROM passages JOIN questions USING (qid) GROUP BY qid")
def logprob_cache_key(spark, sf):
    p = V.passages(spark, sf).groupBy("qid").agg(F.array_join(F.array_sort(F.collect_list("pid")), ",").alias("pids")).join(V.questions(spark, sf).select("qid", "answer"), "qid")
    return p.select("qid", F.sha2(F.concat_ws("|", "qid", "pids", "answer"), 256).alias("key"))


@book.add("""SELECT pid, sha256('{"model":"stub","pid":"' || pid || '","qid":"' || qid || '"}') AS key FROM passages""")
def rerank_cache_key(spark, sf):
    return V.passages(spark, sf).select("pid", F.sha2(F.to_json(F.struct(F.lit("stub").alias("model"), "pid", "qid")), 256).alias("key"))


@book.add("SELECT count(*) AS n_pages, count(*) FILTER (page_id % 11 = 0) AS conflicts FROM pages", view=False)
def bundle_conflict_audit(spark, sf):
    """Files of two bundles by path: those whose content hash differs conflict."""
    a = V.read(spark, sf, "pages").select("page_id", F.sha2("html", 256).alias("h"))
    changed = F.when(F.col("page_id") % 11 == 0, F.sha2(F.concat("h", F.lit("!")), 256)).otherwise(F.col("h"))
    j = a.join(a.select("page_id", changed.alias("other")), "page_id")
    return j.agg(F.count(F.lit(1)).alias("n_pages"), F.count_if(F.col("h") != F.col("other")).alias("conflicts"))


@book.add("SELECT q.qid, q.split, g.latency_ms, g.failed, (SELECT count(*) FROM gold WHERE gold.qid = q.qid) AS n_gold, string_agg(p.pid, ',' ORDER BY p.idx) AS pids FROM questions q JOIN generations g USING (qid) JOIN passages p USING (qid) GROUP BY ALL")
def benchmark_record_merge(spark, sf):
    p = V.passages(spark, sf).groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "pid"))), lambda x: x["pid"]), ",").alias("pids"))
    gold = V.gold(spark, sf).groupBy("qid").agg(F.count(F.lit(1)).alias("n_gold"))
    return V.generations(spark, sf).select("qid", "split", "latency_ms", "failed").join(gold, "qid", "left").join(p, "qid", "left")


@book.add("SELECT split, count(*) AS expected, count(*) FILTER (NOT failed) AS completed, count(*) FILTER (NOT failed) < count(*) AS partial FROM generations GROUP BY split")
def run_status_counts(spark, sf):
    g = V.generations(spark, sf).groupBy("split")
    n, ok = F.count(F.lit(1)), F.count_if(~F.col("failed"))
    return g.agg(n.alias("expected"), ok.alias("completed"), (ok < n).alias("partial"))


META = ", meta AS (SELECT split, CASE split WHEN 'dev' THEN 'interrupted' WHEN 'smoke' THEN 'completed' END AS status, CASE split WHEN 'smoke' THEN 'mock' ELSE 'real' END AS kind, count(*) AS expected FROM questions GROUP BY split)"


def run_meta(spark, sf):
    status = F.when(F.col("split") == "dev", "interrupted").when(F.col("split") == "smoke", "completed")
    m = V.questions(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("expected"))
    return m.withColumn("status", status).withColumn("kind", F.when(F.col("split") == "smoke", "mock").otherwise("real"))


@book.add(META + " SELECT m.split, status IS NULL OR status IN ('running', 'interrupted', 'aborted_oom') OR n < expected AS partial FROM meta m JOIN (SELECT split, count(*) FILTER (NOT failed) AS n FROM generations GROUP BY split) USING (split)")
def partial_run_exclusion(spark, sf):
    n = V.generations(spark, sf).groupBy("split").agg(F.count_if(~F.col("failed")).alias("n"))
    bad = F.col("status").isNull() | F.col("status").isin("running", "interrupted", "aborted_oom") | (F.col("n") < F.col("expected"))
    return run_meta(spark, sf).join(n, "split").select("split", bad.alias("partial"))


@book.add(META + " SELECT split FROM meta WHERE kind <> 'mock'")
def mock_gating(spark, sf):
    return run_meta(spark, sf).where("kind <> 'mock'").select("split")


FACTS = f""", fa AS (SELECT g.qid, g.grank, CASE WHEN {h('absent', 100, 'pid')} < 5 THEN 'no such title' ELSE g.title END AS title, CASE WHEN {h('range', 100, 'pid')} < 5 THEN 999 WHEN len(sentences) = 0 THEN 0 ELSE {_bucket("'sent:' || pid", 1000000)} % len(sentences) END AS sent FROM gold g),
du AS (SELECT qid, count(*) > count(DISTINCT title) AS dup FROM passages GROUP BY qid),
fx AS (SELECT f.qid, f.grank, f.title, f.sent, p.pid, len(p.sentences) AS n FROM fa f LEFT JOIN (SELECT qid, title, arg_min(pid, idx) AS pid, arg_min(sentences, idx) AS sentences FROM passages GROUP BY ALL) p USING (qid, title))
"""


def facts(spark, sf):
    """qid, grank, title, sent, pid and n (null where no passage has the title), dup."""
    p = V.passages(spark, sf)
    n = F.size("sentences")
    sent = F.when(H("range", "pid") < 5, 999).when(n == 0, 0).otherwise(T.bucket(F.concat(F.lit("sent:"), "pid"), 1000000) % n)
    f = V.gold(spark, sf).select("qid", "grank", F.when(H("absent", "pid") < 5, "no such title").otherwise(F.col("title")).alias("title"), sent.cast("long").alias("sent"))
    named = p.groupBy("qid", "title").agg(F.min_by("pid", "idx").alias("pid"), F.min_by(F.size("sentences").cast("long"), "idx").alias("n"))
    dup = p.groupBy("qid").agg((F.count(F.lit(1)) > F.count_distinct("title")).alias("dup"))
    return f.join(named, ["qid", "title"], "left").join(dup, "qid")


@book.add(FACTS + "SELECT qid, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM (SELECT fx.qid, CASE WHEN dup THEN 'duplicate_context_title' WHEN pid IS NULL THEN 'title_not_in_context' WHEN sent >= n THEN 'sent_id_out_of_range' END AS reason FROM fx JOIN du USING (qid)) WHERE reason IS NOT NULL GROUP BY qid")
def supporting_fact_errors(spark, sf):
    why = F.when(F.col("dup"), "duplicate_context_title").when(F.col("pid").isNull(), "title_not_in_context").when(F.col("sent") >= F.col("n"), "sent_id_out_of_range")
    r = facts(spark, sf).select("qid", why.alias("reason")).where("reason IS NOT NULL")
    return r.groupBy("qid").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


@book.add(FACTS + "SELECT coalesce(reason, 'eligible') AS reason, count(*) AS n FROM (SELECT q.qid, min(CASE WHEN dup THEN 'duplicate_context_title' WHEN pid IS NULL THEN 'title_not_in_context' WHEN sent >= n THEN 'sent_id_out_of_range' END) AS reason FROM questions q JOIN fx USING (qid) JOIN du USING (qid) GROUP BY q.qid) GROUP BY 1")
def eligible_pool(spark, sf):
    why = F.when(F.col("dup"), "duplicate_context_title").when(F.col("pid").isNull(), "title_not_in_context").when(F.col("sent") >= F.col("n"), "sent_id_out_of_range")
    r = facts(spark, sf).groupBy("qid").agg(F.coalesce(F.min(why), F.lit("eligible")).alias("reason"))
    return r.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@book.add(FACTS + "SELECT qid, grank, pid, CASE WHEN pid IS NOT NULL AND sent < n THEN pid || '-s' || CASE WHEN sent < 10 THEN '0' || sent ELSE sent::VARCHAR END END AS sentence_id, CASE WHEN pid IS NULL THEN 'title_not_in_context' WHEN sent >= n THEN 'sent_id_out_of_range' END AS dropped FROM fx")
def resolve_supporting_facts(spark, sf):
    ok = F.col("pid").isNotNull() & (F.col("sent") < F.col("n"))
    dropped = F.when(F.col("pid").isNull(), "title_not_in_context").when(F.col("sent") >= F.col("n"), "sent_id_out_of_range")
    return facts(spark, sf).select("qid", "grank", "pid", F.when(ok, F.concat("pid", F.lit("-s"), T.padded("sent", 2))).alias("sentence_id"), dropped.alias("dropped"))


@book.add("SELECT qid, idx AS position, title, len(sentences)::BIGINT AS n_sentences FROM passages")
def zip_parallel_arrays(spark, sf):
    cols = F.array_sort(F.collect_list(F.struct("idx", "title", F.size("sentences").alias("n"))))
    q = V.passages(spark, sf).groupBy("qid").agg(cols.alias("c")).select("qid", F.transform("c", lambda x: x["idx"]).alias("i"), F.transform("c", lambda x: x["title"]).alias("t"), F.transform("c", lambda x: x["n"]).alias("n"))
    z = q.select("qid", F.explode(F.arrays_zip("i", "t", "n")).alias("z"))
    return z.select("qid", F.col("z.i").alias("position"), F.col("z.t").alias("title"), F.col("z.n").cast("long").alias("n_sentences"))


TIE = "CASE WHEN {0} <> '' THEN sha256('{1}:' || trim(regexp_replace(lower({0}), '[ \\t\\n\\r]+', ' ', 'g'))) END"
LEAK = f""", id AS (SELECT DISTINCT qid, h FROM (SELECT qid, unnest([{TIE.format("title", "title")}, {TIE.format("body", "body")}]) AS h FROM passages) WHERE h IS NOT NULL),
st AS (SELECT id.qid AS a, b FROM id JOIN (SELECT h, min(qid) AS b FROM id GROUP BY h) USING (h)), ed AS (SELECT a, b FROM st UNION SELECT b, a FROM st),
rc AS (SELECT qid, qid AS c FROM questions UNION SELECT rc.qid, ed.b FROM rc JOIN ed ON ed.a = rc.c), lb AS (SELECT qid, min(c) AS label FROM rc GROUP BY qid),
gr AS (SELECT sha256(label || ':' || count(*) || ':' || sum(('0x' || substr(sha256(qid), 1, 8))::UBIGINT)::BIGINT) AS group_id, count(*) AS size, label FROM lb GROUP BY label) """


def leakage_labels(spark, sf):
    """Questions meet at a normalized title or text of any of their passages. Edges join each to the smallest question that has it."""
    tie = lambda c: F.when(F.col(c) != "", F.sha2(F.concat(F.lit(f"{c}:"), F.trim(F.regexp_replace(F.lower(c), V.BLANK, " "))), 256))
    own = V.passages(spark, sf).select("qid", F.explode(F.array(tie("title"), tie("body"))).alias("h")).where("h IS NOT NULL").distinct()
    least = own.groupBy("h").agg(F.min("qid").alias("b"), F.count(F.lit(1)).alias("c"))
    star = join_hot(own, least, "h", "c").select(F.col("qid").alias("a"), "b")
    lone = V.questions(spark, sf).select(F.col("qid").alias("a"), F.col("qid").alias("b"))
    return G.components(star.union(lone)).select(F.col("node").alias("qid"), "label")


def leakage_groups(labels):
    """label, group_id, size. A group's id is a digest of its label, size and the sum of its members' hashes, so none is brought together in a task."""
    first = F.conv(F.substring(F.sha2("qid", 256), 1, 8), 16, 10).cast("long")
    groups = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.sum(first).alias("sum"))
    return groups.select("label", F.sha2(F.concat_ws(":", "label", "size", "sum"), 256).alias("group_id"), "size")


@book.add(LEAK + "SELECT qid, group_id, size FROM lb JOIN gr USING (label)")
def leakage_components(spark, sf):
    labels = leakage_labels(spark, sf)
    groups = leakage_groups(labels)
    return join_hot(labels, groups.withColumn("c", F.col("size")), "label", "c").select("qid", "group_id", "size")


@book.add()
def split_allocation(spark, sf):
    """Whole leakage groups for each split, nearest to its size and then to the pool's share of bridge questions."""
    labels = leakage_labels(spark, sf)
    kinds = labels.join(V.questions(spark, sf).select("qid", "qtype"), "qid").groupBy("label").agg(F.count_if(F.col("qtype") == "bridge").alias("bridge"))
    g = leakage_groups(labels).join(kinds, "label").select("group_id", "size", "bridge", F.sha2(F.concat(F.lit("7:"), "group_id"), 256).alias("h"))
    n = g.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return G.allocate_balanced(g, {"eval": max(1, n * 6 // 10), "dev": max(1, n * 2 // 10), "smoke": max(1, n // 10)})


SHARES = (("eval", 5), ("dev", 3), ("smoke", 1))


@book.add("""WITH g AS (SELECT o_custkey AS k, count(*) AS size, count(*) FILTER (o_orderstatus = 'F') AS bridge FROM orders GROUP BY 1), t AS (SELECT sum(size)::BIGINT AS n, sum(bridge)::BIGINT AS b FROM g)
SELECT split, n * tenths // 10 AS requested, n * tenths // 10 AS realized, round_even((n * tenths // 10) * b / n, 0)::BIGINT AS bridge, 0::BIGINT AS shared FROM t, (VALUES ('eval', 5), ('dev', 3), ('smoke', 1)) s(split, tenths)""", view=False)
def split_balance(spark, sf):
    """Customers are groups and their orders the questions, finished ones bridge questions: what the splits come to, and customers that two of them share."""
    g = V.read(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("size"), F.count_if(F.col("o_orderstatus") == "F").alias("bridge"))
    g = g.select(F.col("o_custkey").cast("string").alias("group_id"), "size", "bridge", F.sha2(F.concat(F.lit("7:"), F.col("o_custkey").cast("string")), 256).alias("h"))
    n = g.agg(F.sum("size")).first()[0]
    wanted = {split: n * tenths // 10 for split, tenths in SHARES}
    found = G.allocate_balanced(g, wanted)
    shared = found.groupBy("group_id").agg(F.count_distinct("split").alias("n")).where("n > 1")
    sums = found.where("split <> 'unselected'").join(g, "group_id").groupBy("split").agg(F.sum("size").alias("realized"), F.sum("bridge").alias("bridge"))
    requested = F.element_at(F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair]), F.col("split")).cast("long").alias("requested")
    return sums.select("split", requested, "realized", "bridge").join(shared.agg(F.count(F.lit(1)).alias("shared")), how="cross")


@book.add(LEAK + "SELECT count(*) AS n_groups, sum(size)::BIGINT AS n_questions, max(size) AS largest, count(*) FILTER (size > 1) AS shared FROM gr")
def manifest_v2_summary(spark, sf):
    return leakage_groups(leakage_labels(spark, sf)).agg(F.count(F.lit(1)).alias("n_groups"), F.sum("size").alias("n_questions"), F.max("size").alias("largest"), F.count_if(F.col("size") > 1).alias("shared"))


DEAL = "SELECT qid, CASE WHEN k <= n * 6 // 10 THEN 'eval' WHEN k <= n * 6 // 10 + n * 2 // 10 THEN 'dev' ELSE 'smoke' END AS split FROM (SELECT qid, row_number() OVER (ORDER BY sha256('deal:7:' || qid)) AS k, count(*) OVER () AS n FROM questions)"


@book.add(DEAL)
def split_seeded_disjoint(spark, sf):
    """The questions in the order of a seeded hash, dealt to splits by their shares."""
    q = V.questions(spark, sf).select("qid", F.sha2(F.concat(F.lit("deal:7:"), "qid"), 256).alias("h"))
    n = q.count()
    placed = place_by_hash(q, "h", out="k")
    return placed.select("qid", F.when(F.col("k") <= n * 6 // 10, "eval").when(F.col("k") <= n * 6 // 10 + n * 2 // 10, "dev").otherwise("smoke").alias("split"))


CONFIG = "(VALUES ('a.k', '10'), ('a.model', 'x'), ('b.seed', '7')) l(path, v) FULL JOIN (VALUES ('a.k', '5'), ('a.model', 'x'), ('c.new', '1')) r(path, v) USING (path)"


@book.add(f"SELECT path, l.v AS stored, r.v AS current FROM {CONFIG} WHERE l.v IS DISTINCT FROM r.v", view=False)
def config_diff(spark, sf):
    a = spark.createDataFrame([("a.k", "10"), ("a.model", "x"), ("b.seed", "7")], "path string, stored string")
    b = spark.createDataFrame([("a.k", "5"), ("a.model", "x"), ("c.new", "1")], "path string, current string")
    return a.join(b, "path", "full_outer").where(~F.col("stored").eqNullSafe(F.col("current")))


@book.add(META + " SELECT split, sha256(split || ':' || kind) <> sha256(split || ':real') AS blocked FROM meta")
def resume_compatibility(spark, sf):
    key = lambda k: F.sha2(F.concat_ws(":", "split", k), 256)
    return run_meta(spark, sf).select("split", (key("kind") != key(F.lit("real"))).alias("blocked"))


@book.add("SELECT split, count(*) AS n_agreement, round(avg(latency_ms), 6) AS execution_mean, 2::BIGINT AS version FROM generations GROUP BY split")
def summary_schema_v2(spark, sf):
    flat = V.generations(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("latency_ms"), 6).alias("m"))
    nested = flat.select("split", F.struct(F.col("n").alias("n")).alias("agreement"), F.struct(F.col("m").alias("mean")).alias("execution"), F.lit(2).cast("long").alias("version"))
    return nested.select("split", F.col("agreement.n").alias("n_agreement"), F.col("execution.mean").alias("execution_mean"), "version")


@book.add("SELECT qid, string_agg(idx::VARCHAR, ',' ORDER BY idx) AS gold_slots FROM gold GROUP BY qid")
def source_slots(spark, sf):
    g = V.gold(spark, sf).select("qid", F.regexp_extract("pid", r"-p(\d+)$", 1).cast("long").alias("slot"))
    return g.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list("slot")), lambda x: x.cast("string")), ",").alias("gold_slots"))


SLOT = ", sl AS (SELECT qid, arg_min(pid, sha256('slot:' || pid)) AS slot_pid FROM gold GROUP BY qid) "


@book.add(SLOT + f""", dn AS (SELECT p.*, split, row_number() OVER (PARTITION BY split ORDER BY sha256('donor:' || pid)) AS k FROM passages p JOIN questions USING (qid) WHERE pid NOT IN (SELECT pid FROM gold) AND body <> ''),
cd AS (SELECT q.qid, d.pid, d.k FROM questions q JOIN dn d ON d.split = q.split AND d.qid <> q.qid WHERE NOT EXISTS (SELECT 1 FROM passages o WHERE o.qid = q.qid AND (o.title = d.title OR o.body = d.body))
  AND ({NORM.format('q.answer')} = '' OR NOT contains(' ' || {NORM.format('d.body')} || ' ', ' ' || {NORM.format('q.answer')} || ' ')))
SELECT qid, slot_pid, arg_min(pid, k) AS donor_pid FROM sl JOIN cd USING (qid) GROUP BY ALL""")
def challenge_missing_hop(spark, sf):
    """Each question's gold slot gets the first donor, in hash order within the split, that is foreign to it and free of its answer."""
    slots = V.gold(spark, sf).groupBy("qid").agg(F.min_by("pid", F.sha2(F.concat(F.lit("slot:"), "pid"), 256)).alias("slot_pid"))
    return slots.join(foreign_donors(spark, sf), "qid")


def foreign_donors(spark, sf):
    """qid, donor_pid."""
    p, q = V.passages(spark, sf), V.questions(spark, sf)
    hashed = p.select("qid", "pid", F.sha2("title", 256).alias("title"), F.sha2("body", 256).alias("body"))
    own = hashed.groupBy("qid").agg(F.collect_set("title").alias("titles"), F.collect_set("body").alias("bodies"))
    asked = q.select("qid", "split", T.normalize_answer("answer").alias("needle")).join(own, "qid")
    donors = p.where("body <> ''").join(V.gold_heads(spark, sf).select("pid"), "pid", "left_anti").join(q.select("qid", "split"), "qid")
    donors = donors.select("split", F.col("qid").alias("dq"), "pid", F.sha2("title", 256).alias("title"), F.sha2("body", 256).alias("body"), T.normalize_answer("body").alias("hay"), F.sha2(F.concat(F.lit("donor:"), "pid"), 256).alias("h"))
    return C.first_donors(asked, donors)


DIS = f""", ng AS (SELECT p.*, q.answer, ({NORM.format('q.answer')} <> '' AND contains(' ' || {NORM.format('p.body')} || ' ', ' ' || {NORM.format('q.answer')} || ' ')) AS has FROM passages p JOIN questions q USING (qid) WHERE pid NOT IN (SELECT pid FROM gold)) """


@book.add(DIS + "SELECT qid, arg_min(pid, (has, sha256('dis:' || pid))) AS pid, min(has) AS salience_only, sha256(arg_min(body || ' ' || title || ' has also been associated with ' || answer || '.', (has, sha256('dis:' || pid)))) AS text_hash FROM ng GROUP BY qid")
def challenge_answer_distractor(spark, sf):
    q = V.questions(spark, sf).select("qid", "answer")
    p = V.passages(spark, sf).join(V.gold(spark, sf).select("pid"), "pid", "left_anti").join(q, "qid")
    pad = lambda c: F.concat(F.lit(" "), T.normalize_answer(c), F.lit(" "))
    p = p.withColumn("has", (T.normalize_answer("answer") != "") & pad("body").contains(pad("answer")))
    key = F.struct("has", F.sha2(F.concat(F.lit("dis:"), "pid"), 256))
    text = F.concat("body", F.lit(" "), "title", F.lit(" has also been associated with "), "answer", F.lit("."))
    return p.groupBy("qid").agg(F.min_by("pid", key).alias("pid"), F.bool_and("has").alias("salience_only"), F.sha2(F.min_by(text, key), 256).alias("text_hash"))


SWAP = "(is|was|are|were|has|had|can|will)"


@book.add(f"SELECT pid, CASE WHEN regexp_matches(sentences[1], ' {SWAP} ') THEN 'negated' ELSE 'prefixed' END AS operation, sha256(CASE WHEN regexp_matches(sentences[1], ' {SWAP} ') THEN regexp_replace(sentences[1], ' {SWAP} ', ' \\1 not ') ELSE 'It is not true that ' || sentences[1] END) AS text_hash FROM gold WHERE len(sentences) > 0")
def challenge_evidence_swap(spark, sf):
    s = F.col("sentences")[0]
    auxiliary = rf"^(.*?) {SWAP} "
    negated = s.rlike(f" {SWAP} ")
    edited = F.when(negated, F.regexp_replace(s, rf"(?s){auxiliary}", "$1 $2 not ")).otherwise(F.concat(F.lit("It is not true that "), s))
    return V.gold(spark, sf).where(F.size("sentences") > 0).select("pid", F.when(negated, "negated").otherwise("prefixed").alias("operation"), F.sha2(edited, 256).alias("text_hash"))


KINDS = ("answer_bearing_distractor", "evidence_swap", "missing_hop")


def challenges(spark, sf):
    q = V.questions(spark, sf).select("qid", "split", "level", F.explode(F.array(*[F.lit(k) for k in KINDS])).alias("kind"))
    return q.withColumn("challenge_id", F.concat(F.lit("ch-"), F.substring(F.sha2(F.concat_ws(":", "qid", "kind"), 256), 1, 16)))


CH = ", ch AS (SELECT qid, split, level, kind, 'ch-' || substr(sha256(qid || ':' || kind), 1, 16) AS challenge_id FROM questions, (VALUES ('answer_bearing_distractor'), ('evidence_swap'), ('missing_hop')) k(kind)) "


@book.add(CH + "SELECT split, kind, level, count(*) AS n FROM ch GROUP BY ALL")
def challenge_counts(spark, sf):
    return challenges(spark, sf).groupBy("split", "kind", "level").agg(F.count(F.lit(1)).alias("n"))


@book.add(CH + "SELECT qid, kind, challenge_id FROM ch")
def challenge_ids(spark, sf):
    return challenges(spark, sf).select("qid", "kind", "challenge_id")


@book.add(CH + f", b AS (SELECT challenge_id, CASE WHEN {h('v1', 100, 'challenge_id')} < 4 THEN 'bad' ELSE challenge_id END AS cid, CASE WHEN {h('v2', 100, 'challenge_id')} < 4 THEN '' ELSE level END AS level FROM ch) SELECT challenge_id, 'malformed_id' AS rule FROM b WHERE NOT regexp_matches(cid, '^ch-[0-9a-f]{{16}}$') UNION ALL SELECT challenge_id, 'empty_level' FROM b WHERE level = ''")
def challenge_validation(spark, sf):
    c = challenges(spark, sf).withColumn("cid", F.when(H("v1", "challenge_id") < 4, "bad").otherwise(F.col("challenge_id"))).withColumn("level", F.when(H("v2", "challenge_id") < 4, "").otherwise(F.col("level")))
    rules = {"malformed_id": ~F.col("cid").rlike("^ch-[0-9a-f]{16}$"), "empty_level": F.col("level") == ""}
    hits = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    return c.select("challenge_id", F.explode(hits).alias("rule"))


@book.add(CH + f"SELECT challenge_id FROM ch WHERE {h('gate', 100, 'challenge_id')} < 60 AND {h('hash', 100, 'challenge_id')} >= 3")
def eligible_challenges(spark, sf):
    c = challenges(spark, sf).select("challenge_id")
    approved = c.where(H("gate", "challenge_id") < 60).withColumn("content", F.when(H("hash", "challenge_id") < 3, F.lit("stale")).otherwise(F.col("challenge_id")))
    return c.join(approved, "challenge_id").where("content = challenge_id").select("challenge_id")
