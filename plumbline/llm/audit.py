"""Operator 13: how far the sources of a language diverge, term by term and pair by pair.

Terms are runs of letters (ASCII letters, in lower case, and all characters beyond ASCII). A language keeps its terms that stand in at least
``min_docs`` of its documents. Each (language, source) group, and each language as a whole, gives each kept term a smoothed share
p = 1 + floor(1e9 * (count + 2) / (N + 2 * V)), and two shares diverge by f = floor((p - q)^2 / (p + q)).

``divergence`` returns two parts. ``pair``: for each two sources of a language the sum of f over all kept terms.
``term``: for each group the ``top`` kept terms by f among those it has and has more often than its language.

Most terms are in few groups, so the sum over pairs is split. Terms in many groups (heavy) make dense matrices, and numpy takes the
pairs of groups tile by tile. Terms in few groups (light) are nearly always pairs of two absences: that part is V times one
f, what one group's terms add against the other's absence is a sum over the histogram of its counts, and only two groups that
both have a term need a correction for it, at most LIGHT * (LIGHT - 1) / 2 for a term. All are whole numbers, so the parts add up exactly.

Null text, language and source count as ''. A group without terms, or a language without kept terms, gives pairs of
value 0 or of its absences. A language with one source has no pairs. Repeated rows count as often as they stand;
equal values rank by the item's bytes, so ties are defined; an empty table gives an empty one; other columns aren't read.

Counts of a task are kept in bounded tables that are passed on when full, so a long text or a hot source needs no
more memory. What every task gets to know is one number for each group; there may be MAX_GROUPS of them (their pairs are
the result), and beyond that a ValueError is raised. Counts of up to 9e15 words in a language are exact.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: A fixed value: the characters of terms.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS, TOP = 10, 10
#: Groups in all; groups that a light term stands in at most (or a quarter of the language's, if that is less).
MAX_GROUPS, LIGHT = 20_000, 32
#: Terms that a task counts before it passes them on; groups in a tile; numbers in a matrix.
HELD, TILE, CELLS = 500_000, 128, 1 << 21
_UNIT = 1_000_000_000


def share(count: np.ndarray, total) -> np.ndarray:
    """1 + floor(1e9 * (count + 2) / total), by long division: 1e9 * count needn't fit in 64 bits."""
    total = np.maximum(np.asarray(total, np.int64), 1)  # it is 0 only where there are no terms
    q, r = np.divmod(np.asarray(count, np.int64) + 2, total)
    for _ in range(3):
        more, r = np.divmod(r * 1000, total)
        q = q * 1000 + more
    return q + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs of the rows of a task (lang, source, text): a term comes again if the task passed it on before."""
    find = re.compile(TERM).findall

    def passed_on(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, rows) in held.items():
            names = (pa.array([x], pa.string()).take(pa.array(np.zeros(len(n), np.int64))) for x in (lang, source))
            counts = (pa.array(x, pa.int64(), size=len(n)) for x in (n.values(), map(rows.__getitem__, n)))
            yield pa.record_batch([*names, pa.array(n, pa.string(), size=len(n)), *counts], names=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for part in (batch.slice(i, 256) for batch in batches for i in range(0, batch.num_rows, 256)):
            for lang, source, text in zip(*(part[c].to_pylist() for c in ("lang", "source", "text")), strict=True):
                terms = find(text.encode().lower().decode())  # of bytes, lower() changes A-Z alone
                if terms:
                    n, rows = held.setdefault((lang, source), (Counter(), Counter()))
                    n.update(terms)
                    rows.update(set(terms))
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from passed_on(held)
                held = {}
        yield from passed_on(held)

    return docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def kept_terms(docs: DataFrame, groups: DataFrame, min_docs: int) -> DataFrame:
    """lang, term, total, at (numbers of the groups that have it, ascending), n (its counts there), light of kept terms."""
    counts = term_counts(docs).repartition("lang", "source", "term")  # the tasks have summed what they have
    counts = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    found = counts.join(F.broadcast(groups), ["lang", "source"])  # at most MAX_GROUPS rows
    places = F.array_sort(F.collect_list(F.struct("number", "n"))).alias("places")
    terms = found.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.max("most").alias("most"), places)
    light = (F.size("places") <= F.col("most")).alias("light")
    return terms.where(F.col("docs") >= min_docs).select("lang", "term", "total", F.col("places.number").alias("at"), F.col("places.n").alias("n"), light)


class Language:
    """What tasks know of a language: N of its groups by their number, V and the share of an absent term."""

    def __init__(self, sizes: list[int], terms: int):
        self.totals = np.array(sizes, np.int64) + 2 * terms
        self.absent = share(np.zeros(len(sizes), np.int64), self.totals)


def light_limit(groups: int) -> int:
    return max(2, min(LIGHT, groups // 4))


def summed(lang: str, g: np.ndarray, h: np.ndarray, value: np.ndarray) -> pd.DataFrame:
    """The sum of each pair's values."""
    keys = g.astype(np.int64) << 32 | h
    order = np.argsort(keys, kind="stable")
    keys, value = keys[order], value[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return pd.DataFrame({"lang": lang, "g": keys[starts] >> 32, "h": keys[starts] & 0xFFFFFFFF, "value": np.add.reduceat(value, starts)})


_PAIRS = "lang string, g long, h long, value long"


def heavy_pairs(terms: DataFrame, known) -> DataFrame:
    """Sums of f over heavy terms, for g < h: dense matrices of terms by groups, tile by tile."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, rows in batch.groupby("lang", sort=False):
                x = known.value[lang]
                size = len(x.totals)
                step = max(1, CELLS // size)
                for start in range(0, len(rows), step):
                    yield from tiles(lang, x, rows.iloc[start : start + step], size)

    def tiles(lang: str, x: Language, rows: pd.DataFrame, size: int) -> Iterator[pd.DataFrame]:
        p = np.repeat(x.absent[:, None], len(rows), 1)  # a row for each group
        lengths = rows["at"].map(len).to_numpy()
        at, n = np.concatenate(rows["at"].to_list()), np.concatenate(rows["n"].to_list())
        p[at, np.repeat(np.arange(len(rows)), lengths)] = share(n, x.totals[at])
        for top in range(0, size, TILE):
            for left in range(top, size, TILE):
                g, h = np.meshgrid(np.arange(top, min(top + TILE, size)), np.arange(left, min(left + TILE, size)), indexing="ij")
                value = np.stack([apart(p[i], p[left : left + TILE]).sum(1) for i in range(top, min(top + TILE, size))])
                below = g < h
                if below.any():
                    yield pd.DataFrame({"lang": lang, "g": g[below], "h": h[below], "value": value[below]})

    return terms.mapInPandas(run, _PAIRS)


def light_pairs(terms: DataFrame, known) -> DataFrame:
    """Corrections, for g < h, for light terms that both groups have."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, rows in batch.groupby("lang", sort=False):
                x = known.value[lang]
                for k, same in rows.groupby(rows["at"].map(len)):
                    for start in range(0, len(same) if k > 1 else 0, max(1, CELLS // (k * k))):
                        part = same.iloc[start : start + max(1, CELLS // (k * k))]
                        at, n = np.stack(part["at"].to_list()), np.stack(part["n"].to_list())
                        one, two = np.triu_indices(k, 1)
                        g, h = at[:, one].ravel(), at[:, two].ravel()
                        p = share(n, x.totals[at])
                        a, b, no_a, no_b = p[:, one].ravel(), p[:, two].ravel(), x.absent[g], x.absent[h]
                        yield summed(lang, g, h, apart(a, b) - apart(a, no_b) - apart(no_a, b) + apart(no_a, no_b))

    return terms.mapInPandas(run, _PAIRS)


def absent_pairs(histogram: DataFrame, known) -> DataFrame:
    """For light terms: what a group's counts (lang, g, n, times) add against each other group's absence; a row with n = -1 stands for ``times`` absences on both sides."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (lang, g), rows in batch.groupby(["lang", "g"], sort=False):
                x = known.value[lang]
                none = apart(x.absent[g], x.absent)
                both = rows["n"].to_numpy() < 0
                value = none * int(rows["times"][both].sum())
                value[: g + 1] = 0  # once for a pair
                p, times = share(rows["n"][~both].to_numpy(), x.totals[g]), rows["times"][~both].to_numpy()
                for start in range(0, len(p), max(1, CELLS // len(none))):
                    some = slice(start, start + max(1, CELLS // len(none)))
                    value += ((apart(p[some, None], x.absent) - none) * times[some, None]).sum(0)
                other = np.delete(np.arange(len(none)), g)
                yield pd.DataFrame({"lang": lang, "g": np.minimum(g, other), "h": np.maximum(g, other), "value": value[other]})

    return histogram.mapInPandas(run, _PAIRS)


def divergence(
    docs: DataFrame,
    text_column: str = "text",
    lang_column: str = "lang",
    source_column: str = "source",
    min_docs: int = MIN_DOCS,
    top: int = TOP,
) -> DataFrame:
    """lang, source, part, item, value, rank of both parts."""
    spark = docs.sparkSession
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(filled(lang_column).alias("lang"), filled(source_column).alias("source"), filled(text_column).alias("text"))
    names = sorted((r["lang"].encode(), r["source"].encode()) for r in rows.select("lang", "source").distinct().limit(MAX_GROUPS + 1).collect())
    if len(names) > MAX_GROUPS:
        raise ValueError(f"there are more than {MAX_GROUPS} groups of a language and a source")
    of_lang: Counter = Counter()
    numbered = []
    for lang, source in names:
        numbered.append((lang.decode(), source.decode(), of_lang[lang]))
        of_lang[lang] += 1
    size = {lang.decode(): n for lang, n in of_lang.items()}
    groups = spark.createDataFrame([(*x, light_limit(size[x[0]])) for x in numbered], "lang string, source string, number int, most int")
    kept = materialize(kept_terms(rows, groups, min_docs))

    # one number for each group, and for each language
    places = kept.select("lang", "term", "total", "light", F.arrays_zip(F.col("at").alias("g"), F.col("n").alias("n")).alias("places")).withColumn("place", F.explode("places"))
    places = places.select("lang", "term", "total", "light", F.col("place.g").alias("g"), F.col("place.n").alias("n"))
    in_group = {(r["lang"], r["g"]): r["n"] for r in places.groupBy("lang", "g").agg(F.sum("n").alias("n")).collect()}
    in_lang = {r["lang"]: r for r in kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.count_if("light").alias("light"), F.sum("total").alias("n")).collect()}
    terms = {lang: in_lang[lang]["terms"] if lang in in_lang else 0 for lang in size}
    sizes = {lang: [in_group.get((lang, g), 0) for g in range(n)] for lang, n in size.items()}
    known = spark.sparkContext.broadcast({lang: Language(sizes[lang], terms[lang]) for lang in size})

    shape = "lang string, g int, source string, group_total long, lang_total long"
    facts = [(lang, g, source, sizes[lang][g] + 2 * terms[lang], (in_lang[lang]["n"] if lang in in_lang else 0) + 2 * terms[lang]) for lang, source, g in numbered]
    facts = F.broadcast(spark.createDataFrame(facts, shape))

    absences = [(lang, g, -1, in_lang[lang]["light"] if lang in in_lang else 0) for lang, _, g in numbered]
    histogram = places.where("light").groupBy("lang", "g", "n").agg(F.count(F.lit(1)).alias("times"))
    histogram = histogram.unionByName(spark.createDataFrame(absences, "lang string, g int, n long, times long")).repartition("lang", "g")
    columns = kept.select("lang", "at", "n", "light")
    parts = absent_pairs(histogram, known).unionByName(light_pairs(columns.where("light"), known)).unionByName(heavy_pairs(columns.where("NOT light"), known))
    sums = parts.groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("g").alias("g"), F.col("h").alias("other")), F.struct(F.col("h").alias("g"), F.col("g").alias("other")))).alias("way")
    pairs = sums.select("lang", "value", ways).select("lang", F.col("way.g").cast("int").alias("g"), F.col("way.other").cast("int").alias("other"), "value")
    item = facts.select("lang", F.col("g").alias("other"), F.col("source").alias("item"))
    pairs = pairs.join(facts.select("lang", "g", "source"), ["lang", "g"]).join(F.broadcast(item), ["lang", "other"])
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(ranked))

    part_of = lambda n, total: F.expr(f"1 + (CAST({n} + 2 AS DECIMAL(20, 0)) * {_UNIT}) div CAST({total} AS DECIMAL(20, 0))")
    found = places.join(facts, ["lang", "g"]).withColumn("p", part_of("n", "group_total")).withColumn("q", part_of("total", "lang_total"))
    found = found.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    found = found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    return pairs.unionByName(found)


def op13_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents", "text", "lang", "source"))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS terms FROM documents),
w AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= {MIN_DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v, sum(total)::HUGEINT AS n FROM k GROUP BY lang),
g AS (SELECT s.lang, s.source, coalesce(sum(c.n), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN c USING (lang, source) GROUP BY s.lang, s.source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + ({_UNIT}::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.n + 2 * v.v) AS p,
    1 + ({_UNIT}::HUGEINT * (k.total + 2)) // (v.n + 2 * v.v) AS q
  FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r)
SELECT * FROM o WHERE part = 'pair' OR rank <= {TOP}"""

QUERIES = {"op13_divergence_audit": op13_divergence_audit}
ORACLES = {"op13_divergence_audit": ORACLE}
