"""Comparisons of methods by tiers."""

from plumbline.operators import comparisons as C

RUNS = [("dev", "leave_one_out", False), ("dev", "control_a", True), ("dev", "control_b", True), ("dev", "control_b", True), ("dev", "arc", False), ("eval", "leave_one_out", False), ("eval", "control_b", True)]


def test_pairs_and_tiers(spark):
    runs = spark.createDataFrame(RUNS, "split string, method string, is_control boolean")
    got = {tuple(r) for r in C.pairs(runs, ("leave_one_out", "control_a"), ["arc"]).select("split", "candidate", "comparator", "tier").collect()}
    assert got == {
        ("dev", "leave_one_out", "control_a", "confirmatory"), ("dev", "arc", "control_a", "exploratory"), ("dev", "arc", "leave_one_out", "exploratory"), ("eval", "leave_one_out", "control_b", "secondary"),
    }
    assert C.pairs(runs.limit(0), ("a", "b"), []).collect() == []


def test_cells(spark):
    rows = []
    for i in range(40):
        for method, shift in (("leave_one_out", 0.5), ("control_a", 0.0), ("arc", 0.0)):
            if method == "arc" and i > 30:
                continue
            rows.append(("dev", method, f"q{i}", "f1_at_2", shift + (i % 3) / 10 if i else None))
            rows.append(("dev", method, f"q{i}", "sufficiency", shift + (i % 5) / 10))
    values = spark.createDataFrame(rows, "split string, method string, qid string, metric string, value double")
    runs = spark.createDataFrame([r for r in RUNS if r[0] == "dev"], "split string, method string, is_control boolean")
    got = {(r["candidate"], r["comparator"], r["metric"]): r for r in C.compare(values, C.pairs(runs, ("leave_one_out", "control_a"), ["arc"])).collect()}
    assert len(got) == 6
    one, low = got["leave_one_out", "control_a", "f1_at_2"], got["leave_one_out", "control_a", "sufficiency"]
    assert (one["n"], one["n_excluded"], one["favorable"], low["favorable"], low["n"]) == (39, 1, True, False, 40)
    assert abs(one["mean"] - 0.5) < 1e-9 and one["p"] == 0 == one["adjusted"] and one["tier"] == "confirmatory"
    same = got["arc", "control_a", "f1_at_2"]
    assert same["n"] == 30 and same["mean"] == 0 and same["p"] == same["adjusted"] == 1 and not same["favorable"]
    assert got["arc", "leave_one_out", "f1_at_2"]["adjusted"] == 0 and got["arc", "leave_one_out", "sufficiency"]["favorable"]


MEASURED = "split string, ndcg_at_5 double, complete_evidence_at_5 double, answer_f1 double, citation_coverage double, attribution_f1_at_2 double, p95 double, complete_retrieval boolean, complete_generation boolean, complete_attribution boolean"
GATES = ("formal", "quality_gate", "guardrail_gate", "cost_gate", "retain")


def gates(spark, split="eval", nd=0.03, cv=0.0, f1=0.0, cited=0.0, own=0.0, p95=200.0, whole=(True, True, True)):
    return tuple(C.decision_gates(spark.createDataFrame([(split, nd, cv, f1, cited, own, p95, *whole)], MEASURED)).select(*GATES).first())


def test_a_gain_is_not_enough_to_retain_reranking(spark):
    assert gates(spark) == (True,) * 5
    assert gates(spark, nd=0.0, cv=0.72 - 0.70)[1] and gates(spark, nd=0.0, cv=0.3 - 0.28)[1] and not gates(spark, nd=0.019)[4]
    for broken in ({"f1": -0.021}, {"cited": -0.021}, {"cv": -0.011}, {"own": -0.021}):
        assert gates(spark, **broken) == (True, True, False, True, False)
    assert gates(spark, f1=-0.02, cited=-0.02, cv=-0.01, own=-0.02)[4]
    assert gates(spark, p95=250.5) == (True, True, True, False, False)


def test_gates_of_missing_values_and_runs(spark):
    assert gates(spark, f1=None, cited=None, own=None) == (True,) * 5
    assert gates(spark, nd=None, cv=None)[1:3] == (False, True)
    assert gates(spark, p95=None) == (True, True, True, None, None)
    assert gates(spark, split="dev") == (False, True, True, None, None)
    for at in range(3):
        assert gates(spark, whole=tuple(i != at for i in range(3))) == (False, None, None, None, None)
