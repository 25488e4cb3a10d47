"""Nested JSON payloads as rows of paths: flattening, configurations compared by path, and what must not be in a payload."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE = "array<struct<path:string,key:string,kind:string,value:string>>"
#: Keys that tell of a payload's source, and beginnings of such keys.
PRIVATE_KEYS = (
    "abstention_expectation", "changed_fields", "expected_answerability", "gold_adjudicated_label", "gold_passage_ids", "is_gold", "method_name", "model_name", "parent_fingerprint", "parent_question_id", "provenance",
    "score", "scores", "supporting_fact_sentence_ids", "transform_version", "transformation",
)
PRIVATE_STARTS = ("expected_", "gold_")
#: Both sides of an @ are taken from the run's start in one pass: a word character somewhere before it, and one after a dot that isn't the first thing after it.
MAIL = r"(?U)(?<![^\s@])[^\s@\w]*+\w[^\s@]*+@[^\s@][^\s@.]*+\.[^\s@\w]*+\w"
PLACE = r"(?:^|[\s\"'(])(?:[A-Za-z]:[\\/]|/(?:Users|home|root)/)"


def nodes(text: str | None, lists: bool = True) -> list[tuple[str, str | None, str, str | None]]:
    """(path, key, kind, value) of everything in a JSON text, parents first; kinds are object, list, string, other for what is left, and broken.

    Values are texts for strings and compact JSON with sorted keys for the others; objects, and lists that are walked, have none. With
    ``lists`` their elements are walked as well, else a list is one value. A null text has no nodes, and one that can't be read (broken,
    or nested deeper than the parser goes) a root of the kind broken.
    """
    if text is None:
        return []
    try:
        root = json.loads(text)
    except (ValueError, RecursionError):
        return [("$", None, "broken", None)]
    out, left = [], [("$", None, root)]
    while left:
        path, key, x = left.pop()
        if isinstance(x, dict):
            out.append((path, key, "object", None))
            left += [(f"{path}.{k}", k, v) for k, v in reversed(x.items())]
        elif isinstance(x, list) and lists:
            out.append((path, key, "list", None))
            left += [(f"{path}[{i}]", None, v) for i, v in reversed([*enumerate(x)])]
        elif isinstance(x, str):
            out.append((path, key, "string", x))
        else:
            out.append((path, key, "list" if isinstance(x, list) else "other", json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)))
    return out


def walked(column: Column, lists: bool = True) -> Column:
    """The nodes of a column of JSON texts."""

    @F.pandas_udf(NODE)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([[dict(zip(("path", "key", "kind", "value"), n, strict=True)) for n in nodes(x, lists)] for x in part], dtype=object)

    return run(column)


def flatten(rows: DataFrame, json_column: str, *keep: str, lists: bool = True) -> DataFrame:
    """The columns ``keep`` with path, key, kind and value of each node."""
    return rows.select(*keep, F.explode(walked(F.col(json_column), lists)).alias("node")).select(*keep, "node.*")


def settings(configs: DataFrame, run: str, json_column: str, excluded: list[str] | None = None) -> DataFrame:
    """run, path (dotted), value of each setting; lists are one value. ``excluded`` are paths of settings, or of objects of them, that don't count."""
    leaves = flatten(configs, json_column, run, lists=False).where("kind <> 'object'")
    path = F.expr("substring(path, 3)")
    out = leaves.select(run, path.alias("path"), F.when(F.col("kind") == "string", F.concat(F.lit('"'), "value", F.lit('"'))).otherwise(F.col("value")).alias("value"))
    gone = [(F.col("path") == x) | F.col("path").startswith(f"{x}.") for x in excluded or []]
    for bad in gone:
        out = out.where(~bad)
    return out


def config_hashes(settings_: DataFrame, run: str) -> DataFrame:
    """run, config_hash: of its settings in the order of their paths."""
    pairs = F.array_sort(F.collect_list(F.struct("path", "value")))
    return settings_.groupBy(run).agg(F.concat(F.lit("sha256:"), F.sha2(F.to_json(pairs), 256)).alias("config_hash"))


def config_diffs(stored: DataFrame, current: DataFrame, run: str) -> DataFrame:
    """run, path, stored, current of the settings that differ; what one side lacks is null there."""
    both = stored.withColumnRenamed("value", "stored").join(current.withColumnRenamed("value", "current"), [run, "path"], "full_outer")
    return both.where(~F.col("stored").eqNullSafe(F.col("current")))


def resume_verdicts(stored: DataFrame, asked: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """run, verdict for runs (run, config, kind, records) that are asked for again (run, config, kind, resume).

    A run that isn't stored starts; without ``resume`` one that has records is refused; with it a run resumes only with the same settings and kind.
    All sides have a row for each run, so none is broadcast, however small it is thought to be.
    """
    hashes = lambda rows: config_hashes(settings(rows, "run", "config", excluded), "run").hint("merge")
    old = stored.join(hashes(stored), "run", "left").select("run", "kind", "records", "config_hash")
    new = asked.join(hashes(asked), "run", "left").select("run", "resume", F.col("kind").alias("kind_now"), F.col("config_hash").alias("hash_now"))
    both = new.join(old.withColumn("known", F.lit(True)).hint("merge"), "run", "left")
    fresh = F.when(F.col("records") > 0, "has_records").otherwise("start")
    again = F.when(~F.col("config_hash").eqNullSafe(F.col("hash_now")), "config_changed").when(~F.col("kind").eqNullSafe(F.col("kind_now")), "kind_changed").otherwise("resume")
    return both.select("run", F.when(F.col("known").isNull(), "start").when(F.col("resume"), again).otherwise(fresh).alias("verdict"))


def private_nodes(rows: DataFrame, json_column: str, *keep: str) -> DataFrame:
    """The columns ``keep``, path and rule of what a payload must not hold: keys that tell of its source, mail addresses and private places of files; a payload that can't be read is one as well."""
    key, text = F.lower("key"), F.when(F.col("kind") == "string", F.col("value"))
    named = key.isin(*PRIVATE_KEYS)
    for start in PRIVATE_STARTS:
        named = named | key.startswith(start)
    found = {"source_key": named, "mail": text.rlike(MAIL), "file_place": text.rlike(PLACE), "unreadable": F.col("kind") == "broken"}
    hits = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in found.items()]))
    return flatten(rows, json_column, *keep).select(*keep, "path", F.explode(hits).alias("rule"))
