import pytest
from pyspark.sql import functions as F

from plumbline.operators import models as M

PASSAGES = "q string, a string, p array<string>, t array<string>, b array<string>"


def test_names_are_taken_once_and_unknown_ones_fail():
    with pytest.raises(ValueError, match="taken"):
        M.register("scorer", "stub", M.StubScorer)
    with pytest.raises(ValueError, match="kind"):
        M.register("oracle", "x", M.StubScorer)
    with pytest.raises(KeyError, match="stub"):
        M.get("reranker", "nobody")


def test_batches_hold_at_most_the_size_and_must_be_answered_whole():
    seen = []
    assert M.batched(lambda x: seen.append(len(x)) or x, [list(range(5))], 2) == [0, 1, 2, 3, 4]
    assert seen == [2, 2, 1]
    with pytest.raises(ValueError, match="1 results for 2"):
        M.batched(lambda x: x[:1], [[1, 2]], 2)


def test_a_model_that_drops_a_row_fails_the_job(spark):
    short = M.column(lambda: None, lambda m, x, _: x[1:], [F.col("x"), F.lit(0)], "string")
    with pytest.raises(Exception, match="results for"):
        spark.createDataFrame([("a",), ("b",)], "x string").coalesce(1).select(short).collect()


def test_leave_one_out_is_the_full_score_less_each_ablated_one(spark):
    class Lengths:
        def logprobs(self, contexts, questions, targets):
            return [sum(len(b) for _, _, b in c) + len(t) for c, t in zip(contexts, targets, strict=True)]

    if ("scorer", "lengths") not in M._factories:
        M.register("scorer", "lengths", Lengths)
    df = spark.createDataFrame([("q", "a", ["1", "2"], ["", ""], ["xx", "yyyyy"]), ("q", "a", [], [], [])], PASSAGES)
    got = [r[0] for r in df.select(M.leave_one_out("lengths", "q", "a", "p", "t", "b")).collect()]
    assert sorted(got) == [[], [2.0, 5.0]]


def test_divergence_is_zero_for_equal_and_log_two_for_disjoint():
    assert M._mean_divergence([[0.5, 0.5]], [[0.5, 0.5]]) == 0
    assert M._mean_divergence([[1, 0], [0.5, 0.5]], [[0, 1], [0.5, 0.5]]) == pytest.approx(0.6931471805599453 / 2, abs=1e-9)
    with pytest.raises(ValueError, match="length"):
        M._mean_divergence([[1.0]], [[1.0], [1.0]])


def test_the_stub_embedder_gives_unit_vectors_and_zeros():
    (some, none) = M.stub_embedder()(["one two two", "!"], "query")
    assert sum(x * x for x in some) == pytest.approx(1) and not any(none)


def test_rerankers_must_give_finite_scores(spark):
    from plumbline.operators import ranking as R

    M.register("reranker", "broken", lambda: lambda questions, passages: [float("nan") if p == "bad" else 1.0 for p in passages])
    pairs = spark.createDataFrame([("a", "q", "fine"), ("b", "q", "good")], "pid string, question string, body string")
    assert {tuple(r) for r in R.score_pairs(pairs, "broken", "pid").collect()} == {("a", 1.0), ("b", 1.0)}
    with pytest.raises(Exception, match="aren't finite"):
        R.score_pairs(spark.createDataFrame([("c", "q", "bad")], pairs.schema), "broken", "pid").collect()
    with pytest.raises(KeyError, match="no reranker"):
        R.score_pairs(pairs, "unknown", "pid")


def test_rows_come_from_arrow_batch_by_batch(spark):
    kinds = M.column(lambda: None, lambda m, x, y: [f"{type(a).__name__} {b} {len(x)}" for a, b in zip(x, y, strict=True)], [F.col("x"), F.col("y")], "string", batch=2)
    rows = spark.createDataFrame([(["a"], 1), (None, None), (["b"], 2)], "x array<string>, y int").coalesce(1)
    assert [r[0] for r in rows.select(kinds).collect()] == ["list 1 2", "NoneType None 2", "list 2 1"]
