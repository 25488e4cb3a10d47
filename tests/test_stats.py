import collections
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import lineage
from plumbline.operators import annotation as N
from plumbline.operators import grouping as G
from plumbline.operators import ranking as R
from plumbline.operators import stats as S


def test_wilson(spark):
    df = spark.createDataFrame([(5, 10), (0, 0)], "k int, n int")
    low, high = S.wilson("k", "n")
    a, b = df.select(low.alias("l"), high.alias("h")).collect()
    assert (round(a["l"], 6), round(a["h"], 6)) == (0.236593, 0.763407)
    assert b["l"] is None and b["h"] is None


def test_holm(spark):
    df = spark.createDataFrame([("f", "f1", 0.01), ("f", "map", 0.04), ("f", "citation", 0.03)], "fam string, name string, p double")
    got = {r["name"]: round(r["adjusted"], 6) for r in S.holm(df, "fam", "name", "p").collect()}
    assert got == {"f1": 0.03, "map": 0.06, "citation": 0.06}


def test_agreement(spark):
    rows = [("a", "a"), ("u", "u"), ("a", "u"), ("a", None)]
    r = S.nominal_agreement(spark.createDataFrame(rows, "a string, b string")).first()
    assert (r["raw"], r["kappa"], r["alpha"]) == (pytest.approx(2 / 3), pytest.approx(0.4), pytest.approx(5 / 12))
    r = S.nominal_agreement(spark.createDataFrame([("a", "a"), ("a", "a")], "a string, b string")).first()
    assert (r["raw"], r["kappa"], r["alpha"]) == (1.0, None, 1.0)


def test_evidence_families(spark):
    df = spark.createDataFrame([([["P1.S1", "P2.S1"], ["P3.S1"]], [["P2.S1", "P1.S1"], ["P3.S1", "P3.S2"]])], "x array<array<string>>, y array<array<string>>")
    j, f = S.family_agreement(F.col("x"), F.col("y"))
    r = df.select(j.alias("j"), f.alias("f")).first()
    assert (r["j"], r["f"]) == (pytest.approx(0.75), pytest.approx(5 / 6))


def test_clusters(spark):
    rows = [("c", "p1", f"v{i}", 1.0, 0.0) for i in range(10)] + [("c", "p2", "v", 0.0, 1.0)]
    got = S.cluster_points(spark.createDataFrame(rows, "cluster_id string, parent_id string, variant string, candidate double, comparator double")).collect()
    assert [(r["cluster_id"], r["delta"]) for r in got] == [("c", 0.0)]


def test_cluster_bootstrap(spark):
    schema = "cluster_id string, parent_id string, variant string, candidate double, comparator double"
    rows = [(f"c{i % 6}", f"p{i}", v, i / 10 + (v == "b"), 0.5) for i in range(30) for v in "ab"]
    run = lambda x: S.cluster_bootstrap(spark.createDataFrame(x, schema), 100).first()
    a, b = run(rows), run(rows[::-1])
    assert (a["n_clusters"], a["n_parents"], a["n_excluded"], a["n_duplicates"], a["n_split_parents"]) == (6, 30, 0, 0, 0)
    assert a["estimate"] == pytest.approx(1.45) and a["low"] < a["estimate"] < a["high"] and a["p_above"] == 1.0
    assert [round(x, 9) for x in a] == [round(x, 9) for x in b]
    twice, split = run([*rows, rows[0]]), run([*rows, ("c9", "p0", "z", 1.0, 0.0)])
    assert twice["n_duplicates"] == 1 and twice["estimate"] is None and split["n_split_parents"] == 1 and split["low"] is None
    assert run([*rows, ("c1", "p1", "z", None, 0.0)])["n_excluded"] == 1 and run([])["n_clusters"] == 0


def test_bootstrap_weights(spark):
    """Poisson weights have mean and variance one, and an interval covers about what drawing with replacement does."""
    rows = [("g", f"q{i}", float(i % 10)) for i in range(400)] + [("g", "x", None)]
    got = S.hashed_bootstrap(spark.createDataFrame(rows, "g string, qid string, delta double"), "g", 400).first()
    spread = 2 * 1.96 * (8.25 / 400) ** 0.5
    assert (got["n"], got["n_excluded"], got["mean"]) == (400, 1, 4.5) and 0.8 * spread < got["high"] - got["low"] < 1.2 * spread


def test_alignment(spark):
    a = spark.createDataFrame([("q1", 0.8), ("q2", None), ("q3", 0.4)], "qid string, value double")
    b = spark.createDataFrame([("q1", 0.5), ("q2", 0.2), ("q4", 0.1)], "qid string, value double")
    d = [r["delta"] for r in S.aligned(a, b).collect() if r["delta"] is not None]
    assert d == [pytest.approx(0.3)]


@pytest.mark.parametrize("form", ["hash", "seed"])
def test_bootstraps(spark, form):
    rows = [("g", f"q{i}", i / 10) for i in range(20)]
    make = lambda x: spark.createDataFrame(x, "g string, qid string, delta double")
    run = (lambda d: S.hashed_bootstrap(d, "g", 100)) if form == "hash" else (lambda d: S.seeded_bootstrap(d, "g", 100))
    a, b = run(make(rows)).first(), run(make(rows[::-1])).first()
    assert a["low"] < a["mean"] < a["high"]
    assert tuple(round(x, 9) for x in a[1:]) == tuple(round(x, 9) for x in b[1:])


def test_components(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("x", "x")]
    got = {r["node"]: r["label"] for r in G.components(spark.createDataFrame(chain[::-1], "a string, b string")).collect()}
    assert len(got) == 62 and got.pop("x") == "x" and set(got.values()) == {"n000"}


def test_allocation(spark):
    rows = [(f"g{i}", s, f"{i}") for i, s in enumerate((2, 3, 4, 2, 3, 4))]
    got = G.allocate(spark.createDataFrame(rows, "group_id string, size long, h string"), {"eval": 7, "dev": 5, "smoke": 2}).collect()
    size = {f"g{i}": s for i, s in enumerate((2, 3, 4, 2, 3, 4))}
    total = {}
    for r in got:
        total[r["split"]] = total.get(r["split"], 0) + size[r["group_id"]]
    assert total == {"eval": 7, "dev": 5, "smoke": 2, "unselected": 4}


@given(st.lists(st.integers(1, 9), max_size=12), st.integers(0, 40))
@settings(max_examples=80, deadline=None)
def test_choice_is_the_best(sizes, want):
    got = G.choose_sizes(dict(collections.Counter(sizes)), want)
    sums = {0}
    for s in sizes:
        sums |= {x + s for x in sums}
    assert all(n <= sizes.count(s) for s, n in got.items())
    assert sum(s * n for s, n in got.items()) == max(x for x in sums if x <= want)


def test_allocation_of_empty_and_tied(spark):
    schema = "group_id string, size long, h string"
    assert G.allocate(spark.createDataFrame([], schema), {"eval": 3}).count() == 0
    tied = spark.createDataFrame([(f"g{i}", 1, "same") for i in range(6)], schema)
    got = [r["split"] for r in G.allocate(tied, {"eval": 2, "dev": 3}).collect()]
    assert sorted(got) == ["dev"] * 3 + ["eval"] * 2 + ["unselected"]


def test_places_by_hash(spark):
    rows = spark.range(500).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h"))
    got = [r["id"] for r in R.place_by_hash(rows, "h", digits=1).orderBy("place").collect()]
    assert got == sorted(range(500), key=lambda i: hashlib.sha256(str(i).encode()).hexdigest())


def test_pair_scorers(spark):
    pairs = spark.createDataFrame([("p1", "ab", "xyz"), ("p2", "a", "")], "pid string, question string, body string")
    assert {tuple(r) for r in R.score_pairs(pairs, "stub", "pid").collect()} == {("p1", 8.0), ("p2", 1.0)}


def test_hot_components(spark, monkeypatch):
    monkeypatch.setattr(lineage, "HOT", 2)
    edges = [("hub", f"n{i}") for i in range(30)] + [(f"n{i}", f"m{i}") for i in range(5)] + [("x", "y"), ("z", "z")]
    got = {r["node"]: r["label"] for r in G.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got.pop("x") == got.pop("y") == "x" and got.pop("z") == "z" and set(got.values()) == {"hub"} and len(got) == 36


def test_chains(spark):
    rows = [("o", "a1", None), ("o", "a2", "a1"), ("f", "b1", None), ("f", "b2", "b1"), ("f", "b3", "b1"), ("c", "d1", "d2"), ("c", "d2", "d1"), ("s", "e1", None), ("s", "e2", "a1")]
    df = spark.createDataFrame(rows, "original string, amendment string, previous string")
    assert {(r[0], r[1]) for r in N.chain_violations(df).collect()} == {("f", "fork"), ("c", "no_head"), ("s", "unknown_predecessor")}
    assert {tuple(r) for r in N.amendment_tips(df).where("original = 'o'").collect()} == {("o", "a2")}


def test_schedule_keeps_groups_apart(spark):
    rows = [("ann1", f"t{i}", f"g{i % 3}") for i in range(9)]
    s = N.schedule(spark.createDataFrame(rows, "annotator string, task string, group string"))
    with_group = s.withColumn("group", F.concat(F.lit("g"), (F.substring("task", 2, 1).cast("int") % 3).cast("string")))
    assert s.count() == 9 and N.adjacent(with_group).count() == 0


def test_replicates_weigh_units_by_their_hashes(spark):
    rows = [(f"g{i % 1500}", f"q{i // 2}", float(i % 7), i % 3) for i in range(3000)] + [(None, None, 2.0, 1)]
    df = spark.createDataFrame(rows, "g string, q string, s double, c long").coalesce(1)
    got = {(r["g"], r["r"]): r["m"] for r in S.replicate_means(df, "g", "q", "s", "c", 11).collect()}
    want = {}
    for g, q, s, c in rows:
        for r in range(11):
            h = hashlib.sha256(":".join(x for x in ("boot", str(r // 8), q) if x is not None).encode()).hexdigest()
            w = sum(int(h[8 * (r % 8) : 8 * (r % 8) + 8], 16) / 2**32 >= t for t in S.POISSON)
            a, b = want.get((g, r), (0.0, 0))
            want[g, r] = (a + w * s, b + w * c)
    want = {k: a / b for k, (a, b) in want.items() if b}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_join_in_parts(spark):
    """The tasks are as many as the rows need, and grouping by the key keeps them."""
    many, one = spark.range(4000).selectExpr("id div 2 AS k", "id AS v"), spark.range(2000).selectExpr("id AS k", "id * 3 AS w")
    got = S.join_in_parts(many, one, "k", 500)
    sizes = [r["n"] for r in got.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 4000 and len(sizes) >= 8 and max(sizes) < 1000
    assert got.where("w = 3 * k").groupBy("k", "v").count().where("count = 1").count() == 4000
    assert S.join_in_parts(many.limit(0), one, "k").count() == 0
