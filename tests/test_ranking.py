import math

import pytest
from pyspark.sql import functions as F

from plumbline.operators import attribution as A
from plumbline.operators import metrics as M
from plumbline.operators import ranking as R


def ranked(spark, order, gold):
    rows = [("q", p, i, i + 1, p in gold) for i, p in enumerate(order)]
    return spark.createDataFrame(rows, "qid string, pid string, idx int, rank long, is_gold boolean")


def test_ties_go_to_position(spark):
    rows = [("q", "p0", 0, 1.0), ("q", "p1", 1, 2.0), ("q", "p2", 2, 2.0)]
    got = R.rank_by_score(spark.createDataFrame(rows, "qid string, pid string, idx int, score double")).orderBy("rank").collect()
    assert [r["pid"] for r in got] == ["p1", "p2", "p0"]


def test_hand_values(spark):
    df = ranked(spark, "abcd", "ac")
    r = df.groupBy("qid").agg(M.recall_at(2).alias("r2"), M.recall_at(3).alias("r3"), M.ndcg_at(4).alias("n"), M.covered_at(2).alias("c2"), M.covered_at(3).alias("c3")).first()
    assert (r["r2"], r["r3"], r["c2"], r["c3"]) == (0.5, 1.0, False, True)
    assert r["n"] == pytest.approx(1.5 / (1 + 1 / math.log2(3)))
    assert ranked(spark, "abcd", "bd").groupBy("qid").agg(M.reciprocal_rank().alias("m")).first()["m"] == 0.5
    assert ranked(spark, "abcd", "z").groupBy("qid").agg(M.reciprocal_rank().alias("m")).first()["m"] == 0.0


def test_percentiles(spark):
    df = spark.createDataFrame([(float(x),) for x in (10, 20, 30, 40)], "x double")
    assert tuple(df.agg(F.avg("x"), M.nearest_rank("x", 0.5), M.nearest_rank("x", 0.95)).first()) == (25.0, 20.0, 40.0)


def test_fusion(spark):
    s = "qid string, pid string, idx int, rank long"
    a = spark.createDataFrame([("q", "p0", 0, 1), ("q", "p1", 1, 2), ("q", "p2", 2, 3)], s)
    b = spark.createDataFrame([("q", "p0", 0, 3), ("q", "p1", 1, 1), ("q", "p2", 2, 2)], s)
    got = {r["pid"]: r for r in R.rank_by_score(R.fuse([a, b])).collect()}
    assert got["p0"]["score"] == pytest.approx(1 / 61 + 1 / 63)
    assert got["p1"]["rank"] == 1 and got["p1"]["n_sources"] == 2


def test_rerank_tail(spark):
    rows = [("q", f"p{i}", i, i + 1, float(i)) for i in range(4)]
    got = R.rerank(spark.createDataFrame(rows, "qid string, pid string, idx int, rank long, rerank_score double"), 2).orderBy("rank").collect()
    assert [r["pid"] for r in got] == ["p1", "p0", "p2", "p3"]
    assert [r["score"] for r in got] == [1.0, 0.0, -1.0, -2.0]


def test_bm25_negative_idf(spark):
    p = spark.createDataFrame([("q", f"p{i}", i, "t", b) for i, b in enumerate(["common rare", "common", "common other"])], "qid string, pid string, idx int, title string, body string")
    q = spark.createDataFrame([("q", "common rare rare")], "qid string, question string")
    got = {r["pid"]: r["score"] for r in R.bm25(p, q).collect()}
    docs = [["t", "common", "rare"], ["t", "common"], ["t", "common", "other"]]
    df = {w: sum(w in d for d in docs) for w in ("t", "common", "rare", "other")}
    raw = {w: math.log(3 - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    mean = sum(raw.values()) / 4
    idf = {w: (x if x >= 0 else 0.25 * mean) for w, x in raw.items()}
    avg = 8 / 3
    for i, d in enumerate(docs):
        want = sum(idf[w] * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in ("common", "rare", "rare") if w in d)
        assert got[f"p{i}"] == pytest.approx(want)


def test_bm25_of_many_questions_is_that_of_each_alone(spark):
    rows = [(None if i % 50 == 49 else f"q{i // 10:04}", f"p{i}", i % 10, "t", None if i % 7 == 0 else f"w{i % 3} W{i % 4} x" * (i % 5)) for i in range(9000)]
    p = spark.createDataFrame(rows, "qid string, pid string, idx int, title string, body string").where("qid IS NOT NULL")
    q = spark.createDataFrame([(f"q{i:04}", "W1 w2 w1 gone" if i % 9 else None) for i in range(0, 900, 2)], "qid string, question string")
    got = {r["pid"]: r["score"] for r in R.bm25(p, q).collect()}
    own = {}
    for qid, pid, _, title, body in rows:
        own.setdefault(qid, []).append((pid, f"{title} {body or ''}".lower()))
    own.pop(None)
    want = {}
    for qid, ps in own.items():
        asked = "w1 w2 w1 gone" if int(qid[1:]) % 2 == 0 and int(qid[1:]) % 9 else ""
        want |= dict(zip((pid for pid, _ in ps), R.question_scores(asked, [x for _, x in ps], 1.5, 0.75), strict=True))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want) and any(want.values())


def test_normalized(spark):
    s = spark.createDataFrame([("q", 1.0), ("q", 3.0), ("r", 2.0), ("r", 2.0)], "qid string, score double")
    got = sorted((r["qid"], r["norm"], r["degenerate"]) for r in A.normalized(s).collect())
    assert got == [("q", 0.0, False), ("q", 1.0, False), ("r", 0.5, True), ("r", 0.5, True)]


def test_runs_of_words(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["b", "c"]), (["a"], ["a", "b"]), (["a"], [])], "h array<string>, n array<string>")
    assert [r[0] for r in df.select(A.has_run(F.col("h"), F.col("n"))).collect()] == [True, False, False]


def test_registry():
    assert A.get_method("oracle_gold").is_control
    with pytest.raises(KeyError):
        A.get_method("nothing")
