"""Operator 3: license statements by an exact set-similarity join of text blocks with templates.

A block is a stretch of a text, as the set of its words that occur in templates: twice as many words as the longest template has,
from each multiple of its length on, so blocks overlap by half and a notice that is no longer than the longest template lies whole in one, however
its lines are wrapped. Words are put in order of their frequency in the whole table, rarest first. A block contains ``theta`` of a template's words only if the two
share a word among the first ``size - need + 1`` of each (prefix filter), the block has ``need`` words
(length filter), and enough words follow the shared one in both (positional filter). Blocks meet
templates on those words in an equality join, and what passes is verified, so every pair that meets the threshold is
found. The templates are a parameter of at most ``MAX_TEMPLATES``, which bounds what is broadcast and what
the driver learns of frequencies.

Places of the base phrases are found beside it. A null text counts as empty: no words, no labels, null places,
score 0. Rows that share id (or lack one) and text get equal results. Words of equal frequency go by code point, and of blocks with equal
shares it doesn't matter which counts. An empty table gives an empty result; other columns of the input aren't read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, table

#: What parts words of lower-cased texts.
PARTS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THETA = 0.8
MAX_TEMPLATES = 500
#: Wording of common notices, public knowledge, and the label of each.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("reserved", "All rights reserved"),
)


def words_of(text: str) -> list[str]:
    """A template's words, as Spark would part them."""
    out, word = [], ""
    for c in "".join(x.lower() if x.isascii() else x for x in text) + " ":
        if not c.isascii() or c.isalnum():
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def _words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(text), PARTS, -1), lambda w: w != "")


def stretch(templates) -> int:
    """Words from the start of a block to that of the next one."""
    return max((len(words_of(t)) for _, t in templates), default=1)


def _array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def word_order(docs: DataFrame, vocabulary: list[str], text_column: str = "text") -> list[str]:
    """The vocabulary, rarest in the table first; ties by word. As many rows come back as it has words."""
    own = F.explode(F.filter(_words(F.col(text_column)), lambda w: w.isin(vocabulary)))
    counted = dict(docs.select(own.alias("w")).groupBy("w").count().collect())
    return sorted(vocabulary, key=lambda w: (counted.get(w, 0), w))


def containment_join(
    docs: DataFrame, templates=TEMPLATES, theta: float = THETA, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, own (the text's hash), block, template, label, share of each block that contains ``theta`` of a template."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"over {MAX_TEMPLATES} templates")
    spark = docs.sparkSession
    sets = [sorted(set(words_of(t))) for _, t in templates]
    vocabulary = sorted({w for s in sets for w in s})
    order = word_order(docs, vocabulary, text_column)
    rank = {w: i for i, w in enumerate(order)}
    need = [math.ceil(theta * len(s) - 1e-9) for s in sets]
    index = [
        (w, k, templates[k][0], len(s), need[k], at, s)
        for k, s in enumerate(sets)
        for at, w in enumerate(sorted(s, key=rank.get)[: len(s) - need[k] + 1])
    ]
    prefixes = spark.createDataFrame(
        index, "word string, template int, label string, size int, need int, at int, words array<string>"
    )
    least = min(need)
    # words of no template are nulls, so places stay
    marked = F.transform(_words(F.col(text_column)), lambda w: F.when(w.isin(vocabulary), w))
    texts = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(text_column).alias("own"), marked.alias("words"))
    step = stretch(templates)
    part = lambda k: F.array_compact(F.slice("words", k * step + 1, F.lit(2 * step)))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("words") - 1) / step).cast("int")))
    cut = F.filter(F.transform(starts, lambda k: F.struct(k.alias("block"), part(k).alias("kept"))), lambda x: F.size(x["kept"]) >= least)
    blocks = texts.select("doc_id", "own", F.explode(cut).alias("x")).select("doc_id", "own", "x.*")
    # array_intersect keeps the order of its first side, so the block's words come out rarest first
    blocks = blocks.select("doc_id", "own", "block", F.array_intersect(_array(order), "kept").alias("held")).where(F.size("held") >= least)
    started = blocks.select(
        "doc_id", "own", "block", "held", F.posexplode(F.slice("held", F.lit(1), F.size("held") - least + 1)).alias("at_block", "word")
    )
    met = started.join(F.broadcast(prefixes), "word").where(
        (F.size("held") >= F.col("need"))
        & (F.col("at_block") <= F.size("held") - F.col("need"))
        & (F.least(F.col("size") - F.col("at"), F.size("held") - F.col("at_block")) >= F.col("need"))
    )
    met = met.withColumn("shared", F.size(F.array_intersect("held", "words"))).where(F.col("shared") >= F.col("need"))
    return met.select("doc_id", "own", "block", "template", "label", (F.col("shared") / F.col("size")).alias("share"))


def base_places(words: Column) -> Column:
    """(start, label) of each place of a base phrase."""
    ends = F.array_compact(F.transform(words, lambda w, i: F.when(w == "license", i)))
    before = lambda i, k: F.get(words, i - k)
    return F.array_compact(
        F.transform(
            ends,
            lambda i: F.when(before(i, 1) == "mit", F.struct((i - 1).alias("start"), F.lit("mit").alias("label")))
            .when(before(i, 1) == "apache", F.struct((i - 1).alias("start"), F.lit("apache").alias("label")))
            .when(
                (before(i, 1) == "public") & (before(i, 2) == "general"),
                F.struct((i - 2).alias("start"), F.lit("gpl").alias("label")),
            ),
        )
    )


def scan(docs: DataFrame, templates=TEMPLATES, theta: float = THETA, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row."""
    found = containment_join(docs, templates, theta, id_column, text_column)
    found = found.groupBy("doc_id", "own").agg(F.collect_set("label").alias("_labels"), F.max("share").alias("_score"))
    found = found.withColumnsRenamed({"doc_id": "_id", "own": "_own"})
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(text_column).alias("own"), _words(text).alias("words"))
    rows = rows.select(
        "doc_id",
        "own",
        F.size("words").cast("long").alias("n_words"),
        F.when(F.array_contains("words", "license"), base_places(F.col("words"))).alias("places"),
    )
    starts = F.transform("places", lambda p: p["start"].cast("long"))
    rows = rows.select(
        "doc_id",
        "own",
        "n_words",
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.coalesce(F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"]))), F.array().cast("array<string>")).alias("base"),
    ).withColumn("n_base", F.when(F.col("first_word").isNull(), F.lit(0)).otherwise(F.col("n_base")).cast("long"))
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("own") == F.col("_own")), "left")
    both = F.array_sort(F.array_union("base", F.coalesce(F.col("_labels"), F.array().cast("array<string>"))))
    return joined.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"),
        F.round(F.coalesce(F.col("_score"), F.lit(0.0)), 6).alias("score"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def _oracle() -> str:
    values = ", ".join(
        f"({k}, '{label}', [{', '.join(chr(39) + w + chr(39) for w in sorted(set(words_of(t))))}])" for k, (label, t) in enumerate(TEMPLATES)
    )
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH t(k, label, words) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS rid, doc_id, {lower.format("coalesce(text, '')")} AS x FROM documents),
w AS (SELECT rid, doc_id, list_filter(regexp_split_to_array(x, '{PARTS}'), lambda y: y <> '') AS words FROM d),
b AS (SELECT rid, list_distinct(words[k * {stretch(TEMPLATES)} + 1:k * {stretch(TEMPLATES)} + {2 * stretch(TEMPLATES)}]) AS block
  FROM (SELECT rid, words, unnest(range(0, greatest(1, (len(words) + {stretch(TEMPLATES) - 1}) // {stretch(TEMPLATES)}))) AS k FROM w)),
m AS (SELECT rid, label, len(list_intersect(t.words, block)) / len(t.words) AS share FROM b, t),
f AS (SELECT rid, list_distinct(list(label)) AS found, max(share) AS score FROM m WHERE share >= {THETA} - 1e-9 GROUP BY rid),
p AS (SELECT rid, words, unnest(range(1, len(words) + 1)) AS i FROM w),
q AS (SELECT rid, CASE WHEN words[i] = 'mit' AND words[i + 1] = 'license' THEN 'mit' WHEN words[i] = 'apache' AND words[i + 1] = 'license' THEN 'apache'
  WHEN words[i] = 'general' AND words[i + 1] = 'public' AND words[i + 2] = 'license' THEN 'gpl' END AS label, i - 1 AS start FROM p),
g AS (SELECT rid, count(*) AS n_base, min(start)::BIGINT AS first_word, max(start)::BIGINT AS last_word, list_distinct(list(label)) AS base FROM q WHERE label IS NOT NULL GROUP BY rid)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(found, [])))), ',') AS labels, round(coalesce(score, 0), 6)::DOUBLE AS score
FROM w LEFT JOIN g USING (rid) LEFT JOIN f USING (rid)"""


QUERIES = {"op3_license_scan": op3_license_scan}
ORACLES = {"op3_license_scan": _oracle()}
