"""Operator 4: cross-site boilerplate lines, in DataFrame functions only.

Each line's hash gets a HyperLogLog sketch of the sites it stands on; sketches merge by aggregation, so a
line that a third of the rows share costs one small sketch in each task. Estimates well under the
threshold end there. Lines near it get an exact distinct count of their sites. A line on ``min_sites`` sites or more stays
where it stands first (the smallest id, then the first place) and goes everywhere else.

What is known of such lines is small. Up to ``FEW`` of them are put in the plan as sets of hashes, so
texts are cleaned where they are read and never shuffled; beyond that, lines meet them in a join that
deals each line out by ``SALTS`` and the texts meet their places in another.

Lines are what newlines part; lines under ``min_words`` words are never boilerplate. Null texts count as
empty and come back null; null sites are no site. Rows that share an id and a text are the same place, so
the first place stays in each of them; rows without an id come after all others and are as one document. Ties can't
arise: the first place is one pair of id and position. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

MIN_SITES, MIN_WORDS = 6, 3
#: Registers of a sketch as a power of two, and the share of the threshold within which it isn't trusted.
LG_K, NEAR = 9, 0.3
#: Boilerplate lines that fit in a plan (two hashes each) and what a line's places are dealt out by beyond that.
FEW, SALTS = 10_000, 32
_word, _space = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"


def _hashes(line) -> tuple[Column, Column]:
    """Two 64-bit hashes of a line."""
    return F.xxhash64(line), F.xxhash64(F.lit("line"), line)


def line_places(docs: DataFrame, id_column: str, text_column: str, site_column: str, min_words: int = MIN_WORDS) -> DataFrame:
    """h1, h2 (the line's hash), doc_id, own (the text's hash), pos, site of each line long enough."""
    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        F.col(site_column).cast("string").alias("site"),
        F.xxhash64(text_column).alias("own"),
        F.posexplode(F.split(F.col(text_column), "\n", -1)).alias("pos", "line"),
    )
    # anchored and possessive: one pass over a line, whatever it is made of
    long_enough = F.col("line").rlike(rf"\A(?:{_space})?+(?:{_word}+{_space}+){{{min_words - 1}}}[^\x20\x09-\x0D]") if min_words > 0 else F.lit(True)
    h1, h2 = _hashes("line")
    return rows.where(long_enough).select(h1.alias("h1"), h2.alias("h2"), "doc_id", "own", "pos", "site")


def met(places: DataFrame, lines: DataFrame, few: bool) -> DataFrame:
    """places with what is known of their lines, where something is. ``few``: there are at most FEW lines."""
    if few:
        return places.join(F.broadcast(lines), ["h1", "h2"])
    salt = F.pmod(F.xxhash64("doc_id", "own", "pos"), F.lit(SALTS))
    each = lines.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return places.withColumn("salt", salt).join(each, ["h1", "h2", "salt"]).drop("salt")


def boilerplate_lines(places: DataFrame, min_sites: int = MIN_SITES, near: float = NEAR) -> tuple[DataFrame, int]:
    """h1, h2 and first (no_id, doc_id, pos) of the lines on so many sites, and how many they are."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "pos")).alias("first")
    sketched = places.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.count(F.lit(1)).alias("n"), first)
    wide = (
        sketched.where(F.col("n") >= min_sites)
        .select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("sites"))
        .where(F.col("sites") >= min_sites * (1 - near))
    )
    wide = materialize(wide.withColumn("unsure", F.col("sites") <= min_sites * (1 + near)))
    n, n_unsure = wide.agg(F.count(F.lit(1)), F.count_if("unsure")).first()
    if not n_unsure:
        return wide, n
    unsure = wide.where("unsure").select("h1", "h2")
    exact = met(places.select("h1", "h2", "doc_id", "own", "pos", "site"), unsure, n_unsure <= FEW)
    enough = exact.groupBy("h1", "h2").agg(F.count_distinct("site").alias("exact")).where(F.col("exact") >= min_sites).select("h1", "h2")
    both = materialize(wide.where("NOT unsure").unionByName(wide.where("unsure").join(enough, ["h1", "h2"])))
    return both, both.count()


def dedup_lines(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    site_column: str = "source",
    min_sites: int = MIN_SITES,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """docs with text cleaned, and n_lines and n_removed of each row; columns of these names are replaced."""
    places = line_places(docs, id_column, text_column, site_column, min_words)
    lines, n = boilerplate_lines(places, min_sites)
    rows = docs.withColumn("__plumbline_lines", F.split(F.col(text_column), "\n", -1))
    if n <= FEW:
        rows = _removed_by_sets(rows, lines, id_column)
    else:
        rows = _removed_by_join(rows, places, lines, id_column, text_column)
    kept = F.array_except(F.sequence(F.lit(0), F.size("__plumbline_lines") - 1), F.col("__plumbline_removed"))
    cleaned = F.array_join(F.transform(kept, lambda i: F.get("__plumbline_lines", i)), "\n")
    n_removed = F.coalesce(F.size("__plumbline_removed"), F.lit(0))
    return (
        rows.withColumn("n_lines", F.when(F.col(text_column).isNull(), F.lit(0)).otherwise(F.size("__plumbline_lines")).cast("long"))
        .withColumn("n_removed", F.when(F.col(text_column).isNull(), F.lit(0)).otherwise(n_removed).cast("long"))
        .withColumn(text_column, F.when(F.col("n_removed") == 0, F.col(text_column)).otherwise(cleaned))
        .drop("__plumbline_removed", "__plumbline_lines")
    )


def _removed_by_sets(rows: DataFrame, lines: DataFrame, id_column: str) -> DataFrame:
    """__plumbline_removed: positions of the lines to remove. The sets hold the lines' hashes, and those of their first places."""
    first = F.xxhash64(F.lit("first"), "h1", "first.doc_id", "first.pos")
    known = lines.select("h1", "h2", first.alias("p")).collect()  # FEW rows at most
    if not known:
        return rows.withColumn("__plumbline_removed", F.array().cast("array<int>"))
    ones, twos, firsts = (", ".join(f"{r[k]}L" for r in known) for k in ("h1", "h2", "p"))
    # as text, for thousands of literals cost a call to the JVM each otherwise; Spark makes hash sets of them
    gone = f"xxhash64(line) IN ({ones}) AND xxhash64('line', line) IN ({twos}) AND xxhash64('first', xxhash64(line), `{id_column}`, pos) NOT IN ({firsts})"
    return rows.withColumn("__plumbline_removed", F.array_compact(F.expr(f"transform(__plumbline_lines, (line, pos) -> IF({gone}, pos, NULL))")))


def _removed_by_join(rows: DataFrame, places: DataFrame, lines: DataFrame, id_column: str, text_column: str) -> DataFrame:
    found = met(places.drop("site"), lines.select("h1", "h2", "first"), few=False)
    first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("pos") == F.col("first.pos"))
    removed = found.where(~first).groupBy("doc_id", "own").agg(F.collect_set("pos").alias("__plumbline_removed"))
    removed = removed.withColumnsRenamed({"doc_id": "__plumbline_id", "own": "__plumbline_own"})
    at = rows[id_column].eqNullSafe(F.col("__plumbline_id")) & (F.xxhash64(rows[text_column]) == F.col("__plumbline_own"))
    return rows.join(removed, at, "left").drop("__plumbline_id", "__plumbline_own")


def op4_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


ORACLE = f"""
WITH l AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents WHERE text IS NOT NULL),
w AS (SELECT line, min(doc_id) AS first_id FROM l
  WHERE regexp_matches(line, '{_space.join([_word] * MIN_WORDS)}') GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
f AS (SELECT line, first_id, min(pos) AS first_pos FROM l JOIN w USING (line) WHERE doc_id = first_id GROUP BY line, first_id),
k AS (SELECT l.*, f.line IS NOT NULL AND NOT (doc_id = first_id AND pos = first_pos) AS gone FROM l LEFT JOIN f USING (line)),
g AS (SELECT doc_id, text, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS cleaned FROM k GROUP BY doc_id, text)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, cleaned AS text
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id AND d.text = g.text"""

QUERIES = {"op4_line_spread": op4_line_spread}
ORACLES = {"op4_line_spread": ORACLE}
