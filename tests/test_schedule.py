"""Schedules that keep groups apart, for any sizes of groups."""

from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from plumbline.operators import annotation as N
from plumbline.operators.stats import seed_of


def test_groups_are_apart_wherever_that_is_possible(spark):
    rng = np.random.default_rng(5)
    rows, largest, total = [], {}, {}
    for a in range(60):
        sizes = rng.integers(1, 9, rng.integers(1, 6)).tolist()
        if a % 4 == 0:
            sizes.append(sum(sizes) + a % 3 - 1)  # about half
        largest[f"a{a}"], total[f"a{a}"] = max(sizes), sum(sizes)
        rows += [(f"a{a}", f"t{g}-{i}", f"g{g}") for g, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "annotator string, task string, group string")
    got = defaultdict(dict)
    for r in N.schedule_apart(df).collect():
        assert r["position"] not in got[r["annotator"]]
        got[r["annotator"]][r["position"]] = r["task"]
    assert {(a, t) for a, x in got.items() for t in x.values()} == {r[:2] for r in rows}
    for a, x in got.items():
        assert sorted(x) == list(range(total[a]))
        groups = [x[i].split("-")[0] for i in range(total[a])]
        near = sum(p == q for p, q in zip(groups, groups[1:]))
        least = max(0, 2 * largest[a] - total[a] - 1)
        assert near == 0 if least == 0 else least <= near <= least + 1
    again = {tuple(r) for r in N.schedule_apart(df.orderBy(F.rand(1)).repartition(5)).collect()}
    assert again == {(a, t, i) for a, x in got.items() for i, t in x.items()}


def test_edges(spark):
    shape = "annotator string, task string, group string"
    assert N.schedule_apart(spark.createDataFrame([], shape)).collect() == []
    same = N.schedule_apart(spark.createDataFrame([("a", "t", "g")] * 3 + [("a", "u", None), (None, "t", "g")], shape)).collect()
    assert Counter((r["annotator"], r["position"]) for r in same) == Counter([("a", i) for i in range(4)] + [(None, 0)])


def greedy(tasks):
    """The fullest group that isn't the last one's goes next, one task after the other."""
    waiting, out, last = defaultdict(list), [], None
    for task, group in sorted(tasks, key=lambda t: seed_of("schedule", *t)):
        waiting[group].append(task)
    while waiting:
        free = [g for g in waiting if g != last] or list(waiting)
        last = min(free, key=lambda g: (-len(waiting[g]), seed_of("group", g)))
        out.append(waiting[last].pop())
        if not waiting[last]:
            del waiting[last]
    return out


def test_levels_give_the_order_of_the_walk(spark):
    rng = np.random.default_rng(3)
    lists = {}
    for a in range(300):
        sizes = rng.integers(1, rng.integers(2, 9), rng.integers(1, 7)).tolist()
        if a % 3 == 0:
            sizes.append(sum(sizes) + int(rng.integers(-4, 4)))
        lists[f"a{a}"] = [(f"t{g}-{i}", f"g{a}-{g}") for g, n in enumerate(sizes) for i in range(n)]
    rows = [(a, t, g) for a, x in lists.items() for t, g in x]
    df = spark.createDataFrame(rows, "annotator string, task string, group string")
    got = {(r["annotator"], r["position"]): r["task"] for r in N.schedule(df).collect()}
    assert got == {(a, i): t for a, x in lists.items() for i, t in enumerate(greedy(x))}


def test_one_annotators_long_list_ends(spark):
    df = spark.range(200_000).selectExpr("'a' AS annotator", "cast(id AS string) AS task", "cast(id % 30000 AS string) AS `group`")
    got = N.schedule(df).withColumn("group", (F.col("task").cast("long") % 30000).cast("string"))
    assert got.agg(F.count_distinct("position"), F.max("position")).first()[:] == (200_000, 199_999)
    assert N.adjacent(got).count() == 0


def test_walks_edges(spark):
    shape = "annotator string, task string, group string"
    assert N.schedule(spark.createDataFrame([], shape)).collect() == []
    same = N.schedule(spark.createDataFrame([("a", "t", "g")] * 3 + [("a", "u", None), (None, "t", "g")], shape)).collect()
    assert Counter((r["annotator"], r["position"]) for r in same) == Counter([("a", i) for i in range(4)] + [(None, 0)])
