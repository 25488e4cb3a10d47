"""Allocation of whole groups by size and kind: the best of all choices on small pools, bounded on large ones."""

import itertools
import time
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.operators import grouping as G

SCHEMA = "group_id string, size long, bridge long, h string"
groups_of = st.lists(st.integers(1, 7).flatmap(lambda n: st.tuples(st.just(n), st.integers(0, n))), max_size=8)


def best(groups, want, bridge):
    """Of all choices of some groups, with the search's bound above the wanted size."""
    sums = [(sum(g[0] for g in c), sum(g[1] for g in c)) for n in range(1, len(groups) + 1) for c in itertools.combinations(groups, n)]
    return min(((abs(s - want), abs(b - bridge), s > want) for s, b in sums), default=None)


@given(groups_of, st.integers(1, 40), st.integers(0, 40))
@settings(max_examples=300, deadline=None)
def test_choice_is_the_best_of_all(groups, want, bridge):
    got = G.choose_groups(dict(Counter(groups)), want, bridge)
    assert all(0 < n <= groups.count(c) for c, n in got.items())
    size, b = (sum(c[k] * n for c, n in got.items()) for k in (0, 1))
    assert ((abs(size - want), abs(b - bridge), size > want) if got else None) == best(groups, want, bridge)


def test_nearest_group_where_no_size_fits():
    assert G.choose_groups({(3, 1): 3}, 2, 1) == {(3, 1): 1}
    assert G.choose_groups({(4, 0): 1, (4, 4): 1, (4, 2): 1}, 4, 2) == {(4, 2): 1}
    assert G.choose_groups({(2, 0): 1, (4, 3): 1}, 3, 3) == {(4, 3): 1}
    assert G.choose_groups({}, 3, 1) == {}


def test_large_pools_are_bounded():
    began = time.time()
    pool = {(s, b): 40_000 // s for s in range(1, 40) for b in range(0, s + 1, 3)}
    want = 3_000_001
    questions, bridges = (sum(c[k] * n for c, n in pool.items()) for k in (0, 1))
    assert questions > 2 * want
    bridge = round(want * bridges / questions)
    got = G.choose_groups(pool, want, bridge)
    assert sum(c[0] * n for c, n in got.items()) == want and abs(sum(c[1] * n for c, n in got.items()) - bridge) <= 3
    assert all(n <= pool[c] for c, n in got.items()) and time.time() - began < 30


def test_giant_group_stays_out():
    got = G.choose_groups({(10_000_000, 5_000_000): 1, (1, 1): 20, (1, 0): 20}, 30, 20)
    assert got == {(1, 1): 20, (1, 0): 10}


def test_giant_groups_are_chosen_without_a_search_over_their_square():
    began = time.time()
    assert G.choose_groups({(50_000, 40_000): 1, (1, 1): 20}, 30_000, 24_000) == {(50_000, 40_000): 1, (1, 1): 20}
    assert G.choose_groups({(70_000, 40_000): 1, (1, 1): 20}, 30_000, 24_000) == {(1, 1): 20}
    assert G.choose_groups({(70_000, 40_000): 1, (90_000, 1): 1}, 30_000, 24_000) == {(70_000, 40_000): 1}
    assert time.time() - began < 5


@given(groups_of, st.integers(1, 40), st.integers(0, 40), st.integers(0, 3))
@settings(max_examples=300, deadline=None)
def test_what_is_left_over_is_chosen_as_by_the_search(groups, want, bridge, rest):
    """One group more or none is as near as any choice among what is left, where that is all larger than the gap less ``rest``."""
    left = [c for c in groups if c[0] > want - rest]
    if want > 3 * rest and left:
        got = G.choose_groups(dict(Counter(left)), want, bridge, rest)
        size, b = (sum(c[k] * n for c, n in got.items()) for k in (0, 1))
        assert (abs(size - want), abs(b - bridge), size > want) == best(left, want, bridge)


def test_allocation_takes_each_group_once(spark):
    rows = [(f"g{i}", 1 + i % 4, i % (2 + i % 4) if i % (2 + i % 4) <= 1 + i % 4 else 0, f"{i:03d}") for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    sizes = {"eval": 60, "dev": 40, "smoke": 11}
    one = {(r["group_id"], r["split"]) for r in G.allocate_balanced(df, sizes).collect()}
    other = {(r["group_id"], r["split"]) for r in G.allocate_balanced(df.orderBy(F.desc("group_id")), sizes).collect()}
    size = {r[0]: r[1] for r in rows}
    assert one == other and len(one) == 60
    assert {s: sum(size[g] for g, x in one if x == s) for s in sizes} == sizes


def test_seeds_break_ties(spark):
    make = lambda seed: spark.createDataFrame([(f"g{i}", 2, 1) for i in range(9)], "group_id string, size long, bridge long").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), "group_id"), 256))
    chosen = {frozenset(r["group_id"] for r in G.allocate_balanced(make(seed), {"eval": 6}).where("split = 'eval'").collect()) for seed in range(6)}
    assert len(chosen) > 1 and all(len(c) == 3 for c in chosen)


def test_bad_groups_are_refused(spark):
    for row, sizes, why in ((("g", 1, 2, "h"), {"eval": 1}, "more bridge"), (("g", 1, -1, "h"), {"eval": 1}, "more bridge"), (("g", 1, 1, "h"), {"eval": 0}, "positive")):
        with pytest.raises(ValueError, match=why):
            G.allocate_balanced(spark.createDataFrame([row], SCHEMA), sizes)
    assert G.allocate_balanced(spark.createDataFrame([], SCHEMA), {"eval": 3}).count() == 0


@given(groups_of, st.integers(1, 40), st.integers(0, 40), st.sampled_from([1, 4, G.BEAM]))
@settings(max_examples=300, deadline=None)
def test_choice_for_a_split_is_the_best_of_all(groups, want, bridge, beam):
    got = G.best_groups(dict(Counter(groups)), want, bridge, beam)
    assert all(0 < n <= groups.count(c) for c, n in got.items())
    size, b = (sum(c[k] * n for c, n in got.items()) for k in (0, 1))
    assert ((abs(size - want), abs(b - bridge), size > want) if got else None) == best(groups, want, bridge)


@given(st.lists(st.integers(1, 6000).flatmap(lambda n: st.tuples(st.just(n), st.integers(0, n))), min_size=1, max_size=8), st.integers(3001, 20_000), st.integers(0, 20_000))
@settings(max_examples=30, deadline=None)
def test_choice_is_the_best_of_all_beyond_three_thousand_questions(groups, want, bridge):
    got = G.best_groups(dict(Counter(groups)), want, bridge)
    size, b = (sum(c[k] * n for c, n in got.items()) for k in (0, 1))
    assert (abs(size - want), abs(b - bridge), size > want) == best(groups, want, bridge)


def test_the_same_shares_of_a_pool_go_to_a_split_at_every_size():
    for n in (1, 10, 100, 1000):
        assert G.best_groups({(50 * n, 40 * n): 1, (1, 1): 2 * n}, 30 * n, 24 * n) == {(50 * n, 40 * n): 1}
    assert G.best_groups({}, 3, 1) == {}


def test_best_choice_in_large_pools_of_large_groups():
    began = time.time()
    pool = Counter((500 + 37 * i % 1000, (400 + 29 * i % 800) * (500 + 37 * i % 1000) // 1500) for i in range(300))
    questions, bridges = (sum(c[k] * n for c, n in pool.items()) for k in (0, 1))
    want = questions * 6 // 10
    bridge = round(want * bridges / questions)
    got = G.best_groups(pool, want, bridge)
    assert all(n <= pool[c] for c, n in got.items())
    assert [sum(c[k] * n for c, n in got.items()) for k in (0, 1)] == [want, bridge] and time.time() - began < 60


def test_a_giant_group_leaves_small_ones_to_the_next_split(spark):
    rows = [("giant", 25_581, 20_505, "0")] + [(f"g{i}", 1, int(i < 47), f"{i:03d}") for i in range(60)]
    got = G.allocate_balanced(spark.createDataFrame(rows, SCHEMA), {"eval": 15_384, "dev": 5_128, "smoke": 2_564}).collect()
    assert Counter(r["split"] for r in got) == {"eval": 1, "dev": 60} and ("giant", "eval") in {tuple(r) for r in got}
