"""Operator 11: phrases of two or three words that stand together more often than their parts would.

Texts are lowered (A-Z), cut at marks and line ends into pieces, and these into words at blanks. Identical pieces become one row with
a multiplicity, so boilerplate and copies are counted once. n-grams of pieces are counted by their
multiplicities: Arrow makes the n-grams of a batch, duckdb sums them out of core, once for what a task has and once for each bucket
of a hash of the phrase. So a hot phrase reaches its bucket as one row of each task, and neither needs more than
``MEMORY``; what duckdb puts on disk meanwhile is the task's own and goes with it.

Words and pairs are counted first. A triple can reach ``min_count`` only if its two pairs do, so triples are made only where both pairs are
marked in a bitmap of the frequent pairs (at most 2 ** MAX_BITS bits; a full bitmap costs time, never rows).

A candidate asks for the counts of its parts by rows that meet them at the parts' own place (a join by the part).
The score of a cut is floor(1e6 * a * a / (l * r)); the lowest counts. A pair goes where a triple around it has at least
``share`` percent of its count. All numbers are whole and compared as decimals of 38 digits (counts below 1e15).

Null texts have no pieces; a null language counts as ``und``. Repeated rows count as often as they stand; ties are ordered by the
phrase's bytes. An empty table gives an empty one; other columns aren't read. A long text is many pieces, and a piece without marks one row.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lower_ascii, materialize, table, written

#: What ends a piece, and blanks.
MARKS, BLANKS = r"[.,;:!?\x0A-\x0D]", r"[\x20\x09]+"
MIN_COUNT, SHARE, TOP = 10, 50, 2000
#: Of duckdb in a task, beyond which it goes to disk; bits of the bitmap of pairs as a power of two; parts that a language's ranking is dealt out by.
MEMORY, MAX_BITS, DEALT = "256MB", 28, 64
_COUNTS = "lang string, phrase string, n long"
_SCHEMA = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])


def pieces(docs: DataFrame, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """lang, piece (words joined by one blank), times of each different piece."""
    text = lower_ascii(text_column)
    text = F.when(text.rlike(r"\t|\x20\x20"), F.regexp_replace(text, BLANKS, " ")).otherwise(text)
    lang = F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang")
    rows = docs.select(lang, F.explode(F.split(text, MARKS, -1)).alias("piece")).select("lang", F.trim("piece").alias("piece"))
    return rows.where("piece <> ''").groupBy("lang", "piece").agg(F.count(F.lit(1)).alias("times"))


class Words:
    """The words of a batch of pieces in one array, with what they stand in."""

    def __init__(self, batch: pa.RecordBatch):
        lists = pc.split_pattern(batch["piece"], " ")
        self.flat = pc.list_flatten(lists)
        self.parent = pc.list_parent_indices(lists).to_numpy()
        self.lang, self.times = batch["lang"], batch["times"]

    def together(self, n: int) -> np.ndarray:
        """Places where n words of one piece begin."""
        return np.flatnonzero(self.parent[: len(self.parent) - n + 1] == self.parent[n - 1 :])

    def phrases(self, places: np.ndarray, n: int) -> pa.RecordBatch:
        words = [self.flat.take(pa.array(places + i)) for i in range(n)]
        owner = pa.array(self.parent[places])
        phrase = pc.binary_join_element_wise(*words, " ") if n > 1 else words[0]
        return pa.record_batch([self.lang.take(owner), phrase, self.times.take(owner)], schema=_SCHEMA)

    def pair_marks(self, bits: int) -> np.ndarray:
        """A place in the bitmap for each two words that follow each other."""
        words = hashes(self.flat)
        return pair_places(hashes(self.lang)[self.parent[:-1]], words[:-1], words[1:], bits)


def hashes(strings: pa.Array) -> np.ndarray:
    found = strings.dictionary_encode()
    return hash_array(found.dictionary.to_numpy(zero_copy_only=False).astype(object))[found.indices.to_numpy()]


def pair_places(lang: np.ndarray, one: np.ndarray, two: np.ndarray, bits: int) -> np.ndarray:
    x = (one * np.uint64(0x9E3779B97F4A7C15)) ^ (two * np.uint64(0xC2B2AE3D27D4EB4F) + lang)
    x ^= x >> np.uint64(29)
    return (x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)


def summed(rows: Iterator[pa.RecordBatch], least: int = 0, memory: str = MEMORY) -> Iterator[pa.RecordBatch]:
    """The sum of n of each (lang, phrase), by duckdb and out of core; those of at least ``least``, and the empty phrase. In order, so that they pack well."""
    import duckdb

    with tempfile.TemporaryDirectory() as folder, duckdb.connect() as db:  # the task's own, gone when it ends
        db.execute(f"SET threads = 1; SET memory_limit = '{memory}'; SET temp_directory = '{folder}'; SET preserve_insertion_order = false")
        db.register("given", pa.RecordBatchReader.from_batches(_SCHEMA, rows))
        db.execute(f"CREATE TABLE found AS SELECT lang, phrase, sum(n)::BIGINT AS n FROM given GROUP BY lang, phrase HAVING sum(n) >= {least} OR phrase = '' ORDER BY lang, phrase")
        for batch in db.sql("FROM found").to_arrow_reader(50_000):
            yield batch.cast(_SCHEMA)


def counted(parts: DataFrame, least: int, memory: str = MEMORY) -> DataFrame:
    """lang, phrase, n from partial counts, by bucket of the phrase."""
    return parts.repartition("lang", "phrase").mapInArrow(lambda rows: summed((b.cast(_SCHEMA) for b in rows), least, memory), _COUNTS)


def words_and_pairs(found: DataFrame, memory: str = MEMORY) -> DataFrame:
    """Partial counts of words, pairs and, under the empty phrase, of all words."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = Words(batch)
                every = np.arange(len(x.parent))
                words = x.phrases(every, 1)
                yield words
                yield words.set_column(1, _SCHEMA.field("phrase"), pa.array(np.full(len(every), "", object), pa.string()))
                yield x.phrases(x.together(2), 2)

    return found.mapInArrow(lambda batches: summed(grams(batches), memory=memory), _COUNTS)


def pair_bitmap(pairs: DataFrame) -> tuple[np.ndarray, int]:
    """The bitmap of the frequent pairs and the power of two of its size: 16 bits for a pair, as far as MAX_BITS."""
    n = pairs.count()
    bits = min(MAX_BITS, max(16, (16 * n).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, two = pc.split_pattern(batch["phrase"], " ").flatten(), None
                words = hashes(one)
                one, two = words[0::2], words[1::2]
                at = pair_places(hashes(batch["lang"]), one, two, bits).astype(np.int64)
                yield pa.record_batch([pa.array(at >> 6), pa.array(np.int64(1) << (at & 63))], names=["at", "bit"])

    marks = pairs.select("lang", "phrase").mapInArrow(places, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
    bitmap = np.zeros(1 << (bits - 6), np.uint64)
    bitmap[marks["at"].to_numpy()] = marks["bit"].to_numpy().view(np.uint64)
    return bitmap, bits


def triples(found: DataFrame, bitmap: np.ndarray, bits: int, memory: str = MEMORY) -> DataFrame:
    """Partial counts of triples whose pairs are both marked."""
    known = found.sparkSession.sparkContext.broadcast(bitmap)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = known.value
        for batch in batches:
            if batch.num_rows:
                x = Words(batch)
                at = x.pair_marks(bits)
                hit = (marked[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)
                places = x.together(3)
                yield x.phrases(places[(hit[places] & hit[places + 1]).astype(bool)], 3)

    return found.mapInArrow(lambda batches: summed(grams(batches), memory=memory), _COUNTS)


def phrase_counts(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", min_count: int = MIN_COUNT, memory: str = MEMORY) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, n, words of phrases of one to three words that stand ``min_count`` times; lang, n (all words)."""
    with written(pieces(docs, text_column, lang_column)) as found:
        short = materialize(counted(words_and_pairs(found, memory), min_count, memory).withColumn("words", F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))))
        bitmap, bits = pair_bitmap(short.where("words = 2"))
        long = materialize(counted(triples(found, bitmap, bits, memory), min_count, memory).where("phrase <> ''").withColumn("words", F.lit(3)))
    return short.where("words > 0").unionByName(long), short.where("words = 0").select("lang", "n")


def _score(a: str, one: str, two: str) -> str:
    """floor(1e6 * a * a / (l * r)) as a long."""
    x = lambda c: f"CAST({c} AS DECIMAL(15, 0))"
    return f"(({x(a)} * {x(a)} * 1000000) div ({x(one)} * {x(two)}))"


def candidates(counts: DataFrame, share: int = SHARE) -> DataFrame:
    """lang, phrase, words, a, l, r, score of the phrases of two and three words that no longer one stands for."""
    rows = counts.where("words >= 2").withColumnRenamed("n", "a")
    part = "get(split(phrase, ' '), {})".format
    pair = lambda i: f"concat_ws(' ', {part(i)}, {part(i + 1)})"
    asked = F.expr(f"CASE WHEN words = 2 THEN array({part(0)}, {part(1)}) ELSE array({part(0)}, {pair(1)}, {pair(0)}, {part(2)}) END")
    requests = rows.select("*", F.posexplode(asked).alias("place", "part"))
    parts = counts.where("words < 3").select(F.col("lang").alias("of"), F.col("phrase").alias("known"), "n")
    answers = requests.join(parts, (F.col("lang") == F.col("of")) & (F.col("part") == F.col("known")))
    each = [F.max(F.when(F.col("place") == i, F.col("n"))).alias(f"n{i}") for i in range(4)]
    met = answers.groupBy("lang", "phrase", "words", "a").agg(*each)
    cuts = f"CASE WHEN words = 2 THEN array(struct({_score('a', 'n0', 'n1')} AS score, 1 AS k, n0 AS l, n1 AS r)) ELSE array(struct({_score('a', 'n0', 'n1')} AS score, 1 AS k, n0 AS l, n1 AS r), struct({_score('a', 'n2', 'n3')} AS score, 2 AS k, n2 AS l, n3 AS r)) END"
    scored = met.withColumn("cut", F.array_min(F.expr(cuts))).select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")
    around = rows.where("words = 3").select(F.col("lang").alias("of"), "a", F.explode(F.array(F.expr(pair(0)), F.expr(pair(1)))).alias("inner"))
    around = around.groupBy("of", "inner").agg(F.max("a").alias("longer"))
    stands = (F.col("lang") == F.col("of")) & (F.col("phrase") == F.col("inner")) & (100 * F.col("longer") >= share * F.col("a"))
    return scored.join(around, stands, "left_anti")


def collocations(
    docs: DataFrame,
    text_column: str = "text",
    lang_column: str = "lang",
    min_count: int = MIN_COUNT,
    share: int = SHARE,
    top: int = TOP,
    memory: str = MEMORY,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases by score, count and phrase."""
    counts, totals = phrase_counts(docs, text_column, lang_column, min_count, memory)
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = candidates(counts, share).withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(DEALT)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*best))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return rows.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents", "text", "lang"))


ORACLE = f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents WHERE text IS NOT NULL),
p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(text, '{MARKS}')) AS piece FROM d)),
x AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p WHERE len(w) > 0),
g AS (SELECT lang, w[i] AS phrase, 1 AS words FROM x UNION ALL SELECT lang, w[i] || ' ' || w[i + 1], 2 FROM x WHERE i < len(w)
  UNION ALL SELECT lang, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2], 3 FROM x WHERE i + 1 < len(w)),
f AS MATERIALIZED (SELECT lang, phrase, words, count(*)::HUGEINT AS n FROM g GROUP BY ALL),
t AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE words = 1 GROUP BY lang),
c AS (SELECT lang, phrase, words, n AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND n >= {MIN_COUNT}),
k AS (SELECT *, unnest(range(1, words)) AS k FROM c),
h AS MATERIALIZED (SELECT *, lang || ':' || array_to_string(w[:k], ' ') AS one, lang || ':' || array_to_string(w[k + 1:], ' ') AS two FROM k),
q AS MATERIALIZED (SELECT lang || ':' || phrase AS part, n FROM f WHERE n >= {MIN_COUNT}),
s AS (SELECT lang, phrase, words, a, k, x.n AS l, y.n AS r, (1000000 * a * a) // (x.n * y.n) AS score FROM h JOIN q x ON x.part = one JOIN q y ON y.part = two),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM s),
u AS (SELECT lang, array_to_string(w[:2], ' ') AS phrase, a FROM c WHERE words = 3 UNION ALL SELECT lang, array_to_string(w[2:], ' '), a FROM c WHERE words = 3),
o AS (SELECT lang, phrase, max(a) AS longer FROM u GROUP BY lang, phrase),
r AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase
  WHERE place = 1 AND NOT coalesce(100 * longer >= {SHARE} * a, false))
SELECT r.lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r.r::BIGINT AS r, t.n, score::BIGINT AS score FROM r JOIN t ON t.lang = r.lang WHERE rank <= {TOP}"""

QUERIES = {"op11_phrases": op11_phrases}
ORACLES = {"op11_phrases": ORACLE}
