"""Caches, strict logs, flattened configurations and payloads."""

import json
import os
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import nested as N
from plumbline.sources import cache, logs


def ask(spark, keys):
    return spark.createDataFrame([(k, f"text {k}") for k in keys], "key string, text string")


def length(rows):
    return rows.select("key", F.length("text").cast("double").alias("value"))


def test_cache_computes_only_what_it_lacks(spark, tmp_path):
    folder, asked = str(tmp_path / "cache"), []

    def compute(rows):
        asked.append({r["key"] for r in rows.collect()})
        return length(rows)

    run = lambda keys: {(r["key"], r["value"], r["hit"]) for r in cache.get_or_compute(ask(spark, keys), folder, "m@1", compute).collect()}
    assert run(["a", "b", "a"]) == {("a", 6.0, False), ("b", 6.0, False)}
    assert run(["b", "ccc"]) == {("b", 6.0, True), ("ccc", 8.0, False)}
    assert run(["a", "b", "ccc"]) == {("a", 6.0, True), ("b", 6.0, True), ("ccc", 8.0, True)}
    assert asked == [{"a", "b"}, {"ccc"}, set()] and cache.commits(spark, folder) == ([1, 2], 3)
    assert cache.get_or_compute(ask(spark, ["z"]).limit(0), str(tmp_path / "none"), "m@1", length).collect() == []


def test_cache_survives_a_run_that_died(spark, tmp_path):
    folder = str(tmp_path / "cache")
    cache.get_or_compute(ask(spark, ["a"]), folder, "m@1", length).collect()

    def dies(rows):
        fail = F.udf(lambda t: 1 / 0 if t == "text c" else 1.0, "double")
        return rows.repartition(4).select("key", fail("text").alias("value"))

    with pytest.raises(Exception, match="ZeroDivision"):
        cache.get_or_compute(ask(spark, ["b", "c"]), folder, "m@1", dies)
    os.makedirs(f"{folder}/batch=7")  # a commit that never succeeded
    spark.createDataFrame([("b", "m@1", 99.0)], "key string, identity string, value double").coalesce(1).write.mode("overwrite").parquet(f"{folder}/batch=7")
    os.remove(f"{folder}/batch=7/_SUCCESS")
    got = {(r["key"], r["value"], r["hit"]) for r in cache.get_or_compute(ask(spark, ["a", "b", "c"]), folder, "m@1", length).collect()}
    assert got == {("a", 6.0, True), ("b", 6.0, False), ("c", 6.0, False)} and cache.commits(spark, folder) == ([1, 8], 9)


def test_cache_takes_the_last_write_and_refuses_others(spark, tmp_path):
    folder = str(tmp_path / "cache")
    for n, value in ((1, 1.0), (2, 2.0), (10, 10.0)):
        spark.createDataFrame([("a", "m@1", value)], "key string, identity string, value double").write.parquet(f"{folder}/batch={n}")
    assert [tuple(r) for r in cache.latest(cache.stored(spark, folder)).collect()] == [("a", 10.0)]
    with pytest.raises(ValueError, match="m@1, not only of m@2"):
        cache.get_or_compute(ask(spark, ["b"]), folder, "m@2", length)
    for bad in (lambda r: length(r).limit(1), lambda r: length(r).union(length(r)), lambda r: length(r).withColumn("key", F.lit("x"))):
        with pytest.raises(ValueError, match="without being asked"):
            cache.get_or_compute(ask(spark, ["b", "c"]), folder, "m@1", bad)
    with pytest.raises(ValueError, match="no key"):
        cache.get_or_compute(spark.createDataFrame([(None, "t")], "key string, text string"), folder, "m@1", length)
    assert cache.commits(spark, folder)[0] == [1, 2, 10]


def put(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, text in files.items():
        (folder / f"{name}.jsonl").write_text(text)
    return str(folder)


def test_logs(spark, tmp_path):
    good = "".join(f'{{"k": {i}}}\n' for i in range(50))
    path = put(tmp_path / "logs", whole=good, tail=good + '{"k": 5', middle=good + '{"k"\n' + good, other=good + "[1]\n", blank="\n  \n" + good + "\n\n", scalar="3", cut_blank=good + '{"k\n\n', both='{"k"\n{"k"')
    got = {os.path.basename(r["file"]).removesuffix(".jsonl"): (r["records"], r["broken"], r["others"], r["tail"], r["fatal"]) for r in logs.report(spark, path).collect()}
    assert got == {
        "whole": (50, 0, 0, False, False), "tail": (50, 1, 0, True, False), "middle": (100, 1, 0, False, True), "other": (50, 0, 1, False, True),
        "blank": (50, 0, 0, False, False), "scalar": (0, 0, 1, False, True), "cut_blank": (50, 1, 0, True, False), "both": (0, 2, 0, True, True),
    }
    with pytest.raises(ValueError, match="broken logs"):
        logs.read_strict(spark, path, "k long")
    fine = put(tmp_path / "fine", whole=good, tail=good + '{"k": 5')
    assert logs.read_strict(spark, fine, "k long").count() == 100


def test_logs_in_many_splits(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        good = "".join(f'{{"k": {i}, "v": "{"x" * (i % 90)}"}}\n' for i in range(900))
        path = put(tmp_path / "logs", tail=good + '{"k": 5', middle=good + '{"k\n' + good)
        assert spark.read.text(path).rdd.getNumPartitions() > 20
        got = {os.path.basename(r["file"]): (r["records"], r["broken"], r["tail"], r["fatal"]) for r in logs.report(spark, path).collect()}
        assert got == {"tail.jsonl": (900, 1, True, False), "middle.jsonl": (1800, 1, False, True)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


values = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("ab.", max_size=3), x, max_size=3), max_leaves=12)


def visited(value, path="$", key=None):
    kind = "object" if isinstance(value, dict) else "list" if isinstance(value, list) else "string" if isinstance(value, str) else "other"
    yield path, key, kind
    for k, v in value.items() if isinstance(value, dict) else ():
        yield from visited(v, f"{path}.{k}", k)
    for i, v in enumerate(value if isinstance(value, list) else ()):
        yield from visited(v, f"{path}[{i}]", None)


@given(values)
@settings(max_examples=150, deadline=None)
def test_nodes_equal_a_recursive_walk(value):
    assert [n[:3] for n in N.nodes(json.dumps(value))] == list(visited(value))


def test_settings_and_hashes(spark):
    rows = [("a", '{"m": {"id": "x", "l": [2, 1]}, "o": {"d": 1}, "n": null}'), ("b", '{"o": {"d": 2}, "n": null, "m": {"l": [2,1], "id": "x"}}'), ("c", '{"m": {"id": 5, "l": []}, "oo": 1}'), ("d", None), ("e", "{")]
    s = N.settings(spark.createDataFrame(rows, "run string, config string"), "run", "config", ["o"])
    got = {(r["run"], r["path"], r["value"]) for r in s.collect()}
    assert got == {*((k, p, v) for k in "ab" for p, v in (("m.id", '"x"'), ("m.l", "[2,1]"), ("n", "null"))), ("c", "m.id", "5"), ("c", "m.l", "[]"), ("c", "oo", "1"), ("e", "", None)}
    hashes = {r["run"]: r["config_hash"] for r in N.config_hashes(s, "run").collect()}
    assert hashes["a"] == hashes["b"] != hashes["c"] and set(hashes) == set("abce")


def test_private_nodes(spark):
    deep = '{"a":' * 3000 + '"x@y.org"' + "}" * 3000
    rows = [(1, '{"a": {"Gold_x": 1, "gold": "me@x.org"}, "b": ["C:\\\\d", {"SCORES": []}, "http://home/x", "(/root/"]}'), (2, deep), (3, None), (4, json.dumps({"t": "a" * 1_000_000})), (5, json.dumps({"t": "x@" * 300_000})), (6, json.dumps({"t": "a@" + "b." * 400_000})), (7, "[" * 500_000), (8, "{")]
    began = time.time()
    got = {(r["i"], r["path"], r["rule"]) for r in N.private_nodes(spark.createDataFrame(rows, "i int, p string"), "p", "i").collect()}
    assert time.time() - began < 40
    one = {("$.a.Gold_x", "source_key"), ("$.a.gold", "mail"), ("$.b[0]", "file_place"), ("$.b[1].SCORES", "source_key"), ("$.b[3]", "file_place")}
    assert {g[1:] for g in got if g[0] == 1} == one
    assert {g for g in got if g[0] != 1} == {(2, "$" + ".a" * 3000, "mail"), (6, "$.t", "mail"), (7, "$", "unreadable"), (8, "$", "unreadable")}


@pytest.mark.parametrize(("text", "found"), [
    ("a@b.c", True), ("..@b.c", False), ("a.@b.c", True), ("@b.c", False), ("a@.c", False), ("a@b.", False), ("a@b.-", False), ("a@..c", True), ("x a@b c.d", False), ("a@b@c.d", True), ("a@b.-c", True), ("-a@-.c", True),
])
def test_mail_pattern(spark, text, found):
    import re

    assert (re.search(r"\b[^\s@]+@[^\s@]+\.[^\s@]+\b", text) is not None) == found
    assert spark.range(1).select(F.lit(text).rlike(N.MAIL)).first()[0] == found


def test_resume_verdicts(spark):
    stored = spark.createDataFrame([("a", '{"x": 1}', "real", 3), ("b", '{"x": 1}', "real", 0), ("c", '{"x": 1}', "real", 1)], "run string, config string, kind string, records long")
    asked = lambda config, kind, resume: spark.createDataFrame([(r, config, kind, resume) for r in "abcd"], "run string, config string, kind string, resume boolean")
    verdicts = lambda *x: "".join({"start": "s", "has_records": "h", "resume": "r", "config_changed": "c", "kind_changed": "k"}[r["verdict"]] for r in N.resume_verdicts(stored, asked(*x)).orderBy("run").collect())
    assert [verdicts('{"x": 1}', "real", True), verdicts('{"x": 1}', "real", False), verdicts('{"x": 2}', "mock", True), verdicts('{"x": 1}', "mock", True)] == ["rrrs", "hshs", "cccs", "kkks"]


def test_resumed_runs_are_not_broadcast(spark):
    stored = spark.createDataFrame([(1, '{"a":1}', "real", 1), (2, '{"a":1}', "real", 0)], "run long, config string, kind string, records long")
    asked = spark.createDataFrame([(1, '{"a":1}', "real", True), (2, '{"a":1}', "real", False), (3, "{}", "real", True)], "run long, config string, kind string, resume boolean")
    got = N.resume_verdicts(stored, asked)
    assert {tuple(r) for r in got.collect()} == {(1, "resume"), (2, "start"), (3, "start")}
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
