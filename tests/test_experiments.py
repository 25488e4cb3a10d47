from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import annotation as N
from plumbline.operators import metrics as M
from plumbline.operators import stats as S

RECORD = "struct<label:string,answer:string,families:array<array<string>>,ambiguous:boolean,defect:boolean,exhaustive:boolean>"


def record(label="answerable", answer="Paris", families=(("P1.S1", "P2.S1"), ("P3.S1",)), ambiguous=False, defect=False, exhaustive=True):
    return (label, answer, [list(f) for f in families], ambiguous, defect, exhaustive)


def both(spark, pairs, f):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], f"i int, x {RECORD}, y {RECORD}").coalesce(1)
    return [r[1] for r in df.select("i", f(F.col("x"), F.col("y"))).orderBy("i").collect()]


def test_reasons_look_through_spaces_case_and_order(spark):
    pairs = [
        (record(), record(answer="  PARIS ", families=(("P3.S1",), ("P2.S1", "P1.S1")))),
        (record(), record(label="unclear", answer=None, families=(), ambiguous=True, defect=True)),
        (record(answer="a\t b"), record(answer="A b", families=(("P1.S1",),))),
    ]
    every = ["answerability", "answer_text", "evidence_sets", "ambiguity", "dataset_defect"]
    assert both(spark, pairs, N.disagreement_reasons) == [[], every, ["evidence_sets"]]


def test_upper_case_comes_back_to_the_same_text(spark):
    df = spark.createDataFrame([("und. Dieüauß",), ("",), (None,), ("aŉ𐐨x",)], "s string").coalesce(1)
    assert [r[0] for r in df.select(T.upper_each("s")).collect()] == ["UND. DIEÜAUß", "", None, "Aŉ𐐀X"]


def test_the_first_exclusion_counts(spark):
    pairs = [
        (record(label="unclear", defect=True), record(label="unclear")),
        (record(ambiguous=True), record(defect=True)),
        (record(), record(ambiguous=True, exhaustive=False)),
        (record(), record(exhaustive=False)),
        (record(label="unanswerable"), record(label="unanswerable", exhaustive=False)),
        (record(exhaustive=None), record()),
    ]
    want = ["unclear human decision", "dataset defect", "annotator-marked ambiguity", "non-exhaustive evidence", None, None]
    assert both(spark, pairs, N.agreement_exclusion) == want


def test_percentiles_combine_part_for_part_or_not_at_all(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None)], "k string, v double").groupBy("k").agg(M.percentile_struct("v").alias("x"))
    got = rows.select("k", M.combine_percentiles(F.col("x"), M.constant_percentiles(10), lambda a, b: a + b).alias("y")).orderBy("k").collect()
    assert tuple(got[0]["y"]) == (12.0, 11.0, 13.0) and got[1]["y"] is None


def test_paired_analysis_judges_by_direction_and_counts_what_is_missing(spark):
    rows = [("up", f"q{i}", 0.5) for i in range(30)] + [("down", f"q{i}", -0.5) for i in range(30)] + [("none", "q1", None), ("flat", "q1", 0.0)]
    df = spark.createDataFrame(rows, "metric string, qid string, delta double")
    got = {r["metric"]: r for r in S.paired_analysis(df, "metric", F.col("metric") == "down", 20).collect()}
    assert got["up"]["favorable"] and got["down"]["favorable"] and got["up"]["low"] == 0.5 and got["down"]["p_below"] == 1
    assert (got["none"]["n"], got["none"]["n_excluded"], got["none"]["low"], got["none"]["favorable"]) == (0, 1, None, None)
    assert got["flat"]["excludes_zero"] is False and got["flat"]["favorable"] is False
