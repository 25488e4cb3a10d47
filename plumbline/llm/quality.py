"""Operator 1: quality rules and divergence from language references, in DataFrame functions only.

One pass over the texts makes counts: words, symbols, repeated lines, repeated three-word windows, a
histogram of character classes and one of common words. The references are the summed histograms of all
rows of a language that pass the base rules. A row is kept if it passes them too and if the Jensen-Shannon
distances of its two histograms to its language's reference stay within limits. Texts under ``min_chars``
characters or ``min_words`` words are too short to be judged by a histogram, so only the base rules hold.
Rows of another or no language are held against the nearest reference; without any reference the base rules decide.

A null text counts as empty: no words, so it fails. Windows are compared by their hash: of texts up to
``PACKED_WORDS`` words by 51 bits of it, that are packed with the place so that plain numbers are sorted, and of longer ones by all 64.
Rows that repeat an id, with or without one, are judged each for itself; ties in any column change nothing; an empty table gives an
empty result and no references. Other columns of the input aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, materialize, table

#: Frequent function words of each language, public knowledge; the references' languages are its keys.
COMMON = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem".split(),
    "en": "the of and to in a is that for it as was with be by on".split(),
    "es": "de la que el en y a los del se las por un para con no".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par".split(),
}
#: Character classes, each taken from what the ones before it left; the rest is the last class.
CLASSES = ("[a-z]+", "[A-Z]+", r"[\x20\x09-\x0D]+", "[#*$%&|<>]+", "[0-9]+", r"[\x21-\x7E]+")
SPACES, SYMBOLS = 2, 3
WORDS = sorted({w for x in COMMON.values() for w in x})
#: Lengths from which each histogram is judged, and the largest distances allowed.
MIN_CHARS, MAX_CLASS_DISTANCE = 200, 0.25
MIN_WORDS, MAX_WORD_DISTANCE = 100, 0.31
#: Words up to which a window's hash shares 64 bits with its place.
PACKED_WORDS = (1 << 13) - 1


def features(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """doc_id, lang, the base counts, classes (array of counts) and common (array of counts, the other words last)."""
    rows = docs.select(
        F.col(id_column).alias("doc_id"), F.col(lang_column).alias("lang"), F.coalesce(F.col(text_column), F.lit("")).alias("t")
    )
    spell = sorted(set(WORDS) | {w[0].upper() + w[1:] for w in WORDS})
    rest = rows.select(
        "doc_id",
        "lang",
        F.length("t").alias("left0"),
        F.filter(F.split("t", SPACE, -1), lambda w: w != "").alias("words"),
        F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.regexp_replace("t", CLASSES[0], "").alias("r"),
    )
    for k, pattern in enumerate(CLASSES[1:], 1):
        others = [c for c in rest.columns if c != "r"]
        rest = rest.select(*others, F.length("r").alias(f"left{k}"), F.regexp_replace("r", pattern, "").alias("r"))
    n = len(CLASSES)
    left = [*(F.col(f"left{k}") for k in range(n)), F.length("r")]
    # a window's hash, shifted to make room for its place, so that sorting plain longs brings equal windows together
    bits = F.ceil(F.log2(F.size("words") + F.lit(1.0))).cast("int")
    b = rest.select(
        "doc_id",
        "lang",
        F.size("words").alias("n_words"),
        F.col("left0").alias("n_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.array(*[left[k] - left[k + 1] for k in range(n)], left[n]).alias("classes"),
        F.concat(F.lit(" "), F.lower(F.array_join(F.filter("words", lambda w: w.isin(spell)), "  ")), F.lit(" ")).alias("found"),
        "words",
        bits.alias("bits"),
    )
    window = lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))
    ordered = lambda each: F.sort_array(F.slice(F.transform("words", each), F.lit(1), F.greatest(F.lit(0), F.size("words") - 2)))
    packed = ordered(lambda w, i: F.call_function("shiftleft", window(w, i), F.col("bits")).bitwiseOR(i.cast("long")))
    whole = ordered(lambda w, i: F.struct(window(w, i).alias("h"), i.alias("i")))
    short = F.col("n_words") <= PACKED_WORDS
    c = b.withColumn("packed", F.when(short, packed)).withColumn("whole", F.when(~short, whole)).drop("words")
    following = lambda x, y: F.call_function("shiftrightunsigned", x.bitwiseXOR(y), F.col("bits")) == 0
    place = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")) - 1).cast("int")
    first_of_two = F.array_compact(F.transform("packed", lambda x, j: F.when(following(x, F.get("packed", j + 1)), j)))
    both = F.flatten(F.transform(first_of_two, lambda j: F.array(place(F.get("packed", j)), place(F.get("packed", j + 1)))))
    equal = F.array_compact(F.transform("whole", lambda x, j: F.when(x["h"] == F.get("whole", j + 1)["h"], F.array(x["i"], F.get("whole", j + 1)["i"]))))
    starts = F.sort_array(F.array_distinct(F.when(short, both).otherwise(F.flatten(equal))))
    d = c.withColumn("starts", starts).drop("packed", "whole")
    covered = F.transform("starts", lambda p, j: F.least(F.lit(3), p - F.coalesce(F.get("starts", j - 1), F.lit(-3))))
    # words stand between two spaces each side, so a word's count is what its removal takes away
    counts = [((F.length("found") - F.length(F.replace("found", F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("int") for w in WORDS]
    e = d.withColumn("common", F.array(*counts)).withColumn("n_repeat_words", _total(covered))
    return e.select(
        "doc_id",
        "lang",
        F.col("n_words").cast("long").alias("n_words"),
        (F.col("n_chars") - F.col("classes")[SPACES]).cast("long").alias("word_chars"),
        F.col("classes")[SYMBOLS].cast("long").alias("n_symbols"),
        F.col("n_dup_lines").cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        "n_chars",
        "classes",
        F.concat("common", F.array((F.col("n_words") - _total("common")).cast("int"))).alias("common"),
    )


def _total(name):
    return F.aggregate(name, F.lit(0).cast("long"), lambda x, y: x + y)


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _shares(name: str):
    return F.transform(name, lambda x: x / F.greatest(F.lit(1).cast("long"), _total(name)))


def distance(p, q):
    """Jensen-Shannon distance to base 2 of two arrays of shares: 0 to 1."""
    part = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)
    terms = F.zip_with(p, q, lambda x, y: part(x, y) + part(y, x))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda x, y: x + y) / 2))


def references(feats: DataFrame) -> DataFrame:
    """key, refs: for each language of COMMON its summed histograms as shares; the key '*' has all of them.

    A row for each language of COMMON at most, and one more, so it may be broadcast.
    """
    n, m = len(CLASSES) + 1, len(WORDS) + 1
    sums = (
        feats.where(~base_failed() & F.col("lang").isin(*COMMON))
        .groupBy("lang")
        .agg(
            F.array(*[F.sum(F.col("classes")[i].cast("long")) for i in range(n)]).alias("c"),
            F.array(*[F.sum(F.col("common")[i].cast("long")) for i in range(m)]).alias("w"),
        )
        .select("lang", F.struct(_shares("c").alias("c"), _shares("w").alias("w")).alias("ref"))
    )
    both = sums.select(F.explode(F.array("lang", F.lit("*"))).alias("key"), "ref")
    return both.groupBy("key").agg(F.collect_list("ref").alias("refs"))


def judge(
    feats: DataFrame,
    refs: DataFrame,
    min_chars: int = MIN_CHARS,
    max_class: float = MAX_CLASS_DISTANCE,
    min_words: int = MIN_WORDS,
    max_word: float = MAX_WORD_DISTANCE,
) -> DataFrame:
    known = F.coalesce(F.col("lang").isin(*COMMON), F.lit(False))
    rows = feats.withColumn("key", F.when(known, F.col("lang")).otherwise("*"))
    rows = rows.withColumn("n_all", _total("classes")).withColumn("w_all", _total("common"))
    share = lambda name, all_: F.transform(name, lambda x: x / F.greatest(F.lit(1).cast("long"), F.col(all_)))
    rows = rows.withColumn("p", share("classes", "n_all")).withColumn("q", share("common", "w_all"))
    joined = rows.join(F.broadcast(refs), "key", "left")
    near = lambda own, part: F.round(F.array_min(F.transform("refs", lambda r: distance(F.col(own), r[part]))), 6)
    judged = joined.withColumn("class_distance", near("p", "c")).withColumn("word_distance", near("q", "w"))
    fits = (
        ((F.col("n_chars") < min_chars) | (F.col("class_distance") <= max_class))
        & ((F.col("n_words") < min_words) | (F.col("word_distance") <= max_word))
    )
    return judged.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & F.coalesce(fits, F.lit(True)))


def op1_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = materialize(features(table(spark, sf_dir, "documents", "doc_id", "text", "lang")))
    return judge(feats, references(feats)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance",
        "base_failed", "kept",
    )


def _oracle() -> str:
    quoted = ", ".join("'" + w + "'" for w in WORDS)
    rest, cuts = "t", ["length(t)"]
    for pattern in CLASSES:
        rest = f"regexp_replace({rest}, '{pattern}', '', 'g')"
        cuts.append(f"length({rest})")
    classes = ", ".join([f"{a} - {b}" for a, b in zip(cuts, cuts[1:], strict=False)] + [cuts[-1]])
    langs = ", ".join("'" + x + "'" for x in COMMON)
    n, m = len(CLASSES) + 1, len(WORDS) + 1
    share = "list_transform({0}, lambda x: x / greatest(1, list_sum({0})))"
    part = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / ({0} + {1})) ELSE 0 END"
    gap = lambda p, q, k: (
        f"sqrt(greatest(0, list_sum(list_transform(range(1, {k + 1}), lambda i: {part.format(p + '[i]', q + '[i]')} + {part.format(q + '[i]', p + '[i]')})) / 2))"
    )
    sums = lambda name, k: "[" + ", ".join(f"sum({name}[{i + 1}])" for i in range(k)) + "]"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '{SPACE}'), lambda x: x <> '') AS words,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines, [{classes}] AS classes FROM d),
tri AS (SELECT rid, i, words[i] || chr(32) || words[i + 1] || chr(32) || words[i + 2] AS k
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM tri) WHERE n > 1),
rep AS (SELECT rid, sum(least(3, i - coalesce(before, -9))) AS n FROM
  (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM twice) GROUP BY rid),
f AS (SELECT rid, doc_id, lang, length(t) AS n_chars, len(words) AS n_words, length(t) - classes[{SPACES + 1}] AS word_chars,
  classes[{SYMBOLS + 1}] AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, classes,
  list_transform([{quoted}], lambda x: len(list_filter(words, lambda y: y = x OR y = upper(x[1]) || x[2:]))) AS found
  FROM w LEFT JOIN rep USING (rid)),
g AS (SELECT *, list_append(found, n_words - list_sum(found)::BIGINT) AS common,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
s AS (SELECT lang AS l, {sums("classes", n)} AS c, {sums("common", m)} AS w FROM g WHERE NOT base_failed AND lang IN ({langs}) GROUP BY lang),
r AS (SELECT l, {share.format("c")} AS c, {share.format("w")} AS w FROM s),
h AS (SELECT *, {share.format("classes")} AS p, {share.format("common")} AS q FROM g),
j AS (SELECT h.rid, round(min({gap("h.p", "r.c", n)}), 6) AS class_distance, round(min({gap("h.q", "r.w", m)}), 6) AS word_distance
  FROM h JOIN r ON h.lang = r.l OR coalesce(h.lang, '') NOT IN ({langs}) GROUP BY h.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_distance, word_distance, base_failed,
  NOT base_failed AND coalesce((n_chars < {MIN_CHARS} OR class_distance <= {MAX_CLASS_DISTANCE}) AND (n_words < {MIN_WORDS} OR word_distance <= {MAX_WORD_DISTANCE}), true) AS kept
FROM h LEFT JOIN j USING (rid)"""


QUERIES = {"op1_divergence": op1_divergence}
ORACLES = {"op1_divergence": _oracle()}
