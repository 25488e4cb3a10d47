"""Finalizing pilots: each failure by its rule, and the order of verdicts."""

from plumbline.operators import pilot as P

M = "pilot string, task string, first string, second string, content string, instructions string"
S = "pilot string, id string, task string, annotator string, label string, content string, instructions string, payload string"
A = "pilot string, original string, amendment string, previous string, label string"
J = "pilot string, id string, task string, adjudicator string, first_id string, second_id string, label string"


def plan(pilot, n):
    return [(pilot, f"{pilot}{i}", "ann", "bob", f"c{i}", "v2") for i in range(n)]


def said(pilot, n, differ=()):
    out = []
    for i in range(n):
        label = "answerable" if i % 2 else "unanswerable"
        out.append((pilot, f"a{pilot}{i}", f"{pilot}{i}", "ann", label, f"c{i}", "v2", '{"x": "fine"}'))
        out.append((pilot, f"b{pilot}{i}", f"{pilot}{i}", "bob", "ambiguous" if i in differ else label, f"c{i}", "v2", None))
    return out


def frames(spark, m, s, a=(), j=()):
    return spark.createDataFrame(m, M), spark.createDataFrame(s, S), spark.createDataFrame([*a], A), spark.createDataFrame([*j], J)


def verdict(spark, *x, expected=4):
    return {r["pilot"]: r["verdict"] for r in P.finalize(*frames(spark, *x), expected).collect()}


def failed(spark, *x):
    return {tuple(r) for r in P.failures(*frames(spark, *x)).select("record", "rule").collect()}


def test_verdicts(spark):
    m = [r for p in "pqrstu" for r in plan(p, 20)]
    s = said("p", 20) + said("q", 20)[:-1] + said("r", 20, {3}) + said("s", 20, range(0, 20, 2)) + said("t", 20, {1}) + said("u", 20)
    s[-1] = (*s[-1][:-1], '{"deep": [{"gold_x": 1}]}')
    j = [("t", "j1", "t1", "eve", "at1", "bt1", "answerable")] + [("s", f"js{i}", f"s{i}", "eve", f"as{i}", f"bs{i}", "answerable") for i in range(0, 20, 2)]
    assert verdict(spark, m, s, (), j) == {
        "p": "READY_FOR_HUMAN_FREEZE_REVIEW", "q": "BLOCKED_INCOMPLETE", "r": "BLOCKED_UNRESOLVED_ADJUDICATION", "s": "BLOCKED_LOW_IAA", "t": "READY_FOR_HUMAN_FREEZE_REVIEW", "u": "BLOCKED_PRIVACY",
    }
    assert verdict(spark, plan("p", 3), said("p", 3)) == {"p": "BLOCKED_INTEGRITY"}
    assert verdict(spark, plan("p", 4), []) == {"p": "BLOCKED_INCOMPLETE"}
    assert verdict(spark, [], said("p", 4)) == {}


def test_amendments_stand_for_their_originals(spark):
    m, s = plan("p", 4), said("p", 4, {2})
    a = [("p", "bp2", "x1", None, "answerable"), ("p", "bp2", "x2", "x1", "unanswerable")]
    t = {r["task"]: (r["second_label"], r["second_record"], r["disagreed"]) for r in P.tasks(frames(spark, m, s)[0], P.effective(*frames(spark, m, s, a)[1:3]), frames(spark, m, s)[3]).collect()}
    assert t["p2"] == ("unanswerable", "x2", False) and t["p1"] == ("answerable", "bp1", False)
    assert failed(spark, m, s, a, [("p", "j", "p2", "eve", "ap2", "bp2", "answerable")]) == {("j", "nothing_to_decide")}


def test_every_rule(spark):
    m, s = [*plan("p", 6), ("p", "p5", "ann", "ann", "c5", "v2")], said("p", 6, {0, 1, 2})
    s += [("p", "z1", "nowhere", "ann", "answerable", "c", "v2", None), ("p", "z2", "p3", "zoe", "answerable", "c3", "v1", None), ("p", "ap4-again", "p4", "ann", "maybe", "old", "v2", None)]
    a = [("p", "gone", "x1", None, "answerable"), ("p", "bp3", "y1", None, "answerable"), ("p", "bp3", "y2", None, "answerable"), ("p", "ap3", "z", "unknown", "answerable")]
    j = [("p", "j0", "p0", "ann", "ap0", "bp0", "answerable"), ("p", "j1", "p1", "eve", "ap1", "other", "answerable"), ("p", "j2", "p2", "eve", "ap2", "bp2", "x"), ("p", "j2b", "p2", "eve", "ap2", "bp2", "answerable"), ("p", "j9", "p9", "eve", "a", "b", "answerable")]
    got = failed(spark, m, s, a, j)
    assert {
        ("z1", "unknown_task"), ("z2", "unassigned_annotator"), ("z2", "wrong_instructions"), ("ap4-again", "wrong_content"), ("ap4-again", "repeated_submission"), ("ap4", "repeated_submission"), ("ap4-again", "unknown_label"),
        ("x1", "unknown_original"), ("bp3", "several_heads"), ("ap3", "no_head"), ("ap3", "unknown_predecessor"), ("j0", "own_adjudicator"), ("j1", "outdated_records"), ("j2", "unknown_label"), ("j2", "repeated_adjudication"),
        ("j2b", "repeated_adjudication"), ("j9", "unknown_task"), ("p5", "one_annotator"), ("p5", "repeated_task"),
    } <= got
    assert failed(spark, plan("p", 6), said("p", 6)) == set()
