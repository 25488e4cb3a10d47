"""Operator 9: mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

The multiples of the golden ratio, taken modulo one, are mapped through the sources' cumulative targets, so every
stretch of the schedule holds each source in close to its share. A slot's rank among its source's slots is
the number of the block that it takes. Blocks are equal stretches of words of the source's documents in a
keyed random order, read round and round; a source too small for many blocks has shorter ones, and as many more slots; what a document's words share with the taken blocks is what the mix takes.

Running sums within a source are made in two steps, over buckets of the random order and inside each, so
no task gets a whole source. The table of sources is one row each, of at most ``MAX_SOURCES``, and one task orders it.

Null texts have size 0 and are never taken; a null source is a source of its own, the last. Repeated rows
count each for itself. An empty table gives an empty mix. The schedule depends on the rows and the seed alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, materialize, table

GOLDEN = 0.6180339887498949
#: Weights in turn of the sources in order; words taken of all; times that a source is taken at most.
WEIGHTS, SHARE, EPOCHS = (5, 2, 1), 1.5, 2
#: Slots at least, words of a block at most, rows of a bucket at least.
MIN_SLOTS, MAX_BLOCK, BUCKET_ROWS = 1 << 16, 1 << 20, 2000
#: Slots that each source's target is worth at least, as far as it has so many words.
SOURCE_SLOTS = 1024
#: Cells by which slots meet their source in an equality join.
CELLS = 1024
#: Sources at most; over them mixing fails and asks for coarser ones.
MAX_SOURCES = 1_000_000
SEED = "mix"


def targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """skey, source_size, target, k of each source: weights in turn by code point, nulls last, cut at ``epochs`` sizes."""
    by = materialize(sized.groupBy("skey", "source").agg(F.sum("size").alias("source_size")))
    if by.count() > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources")
    order = W.orderBy(F.col("source").asc_nulls_last())
    by = by.withColumn("k", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    by = by.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(epochs)))
    # in the order in which sources reach their limits: what is left to share, by what weight
    fill = W.orderBy((F.col("limit") / F.col("weight")).asc(), "k")
    all_ = W.partitionBy()
    by = by.withColumn("done", F.sum("limit").over(fill) - F.col("limit"))
    by = by.withColumn("weigh", F.sum("weight").over(all_) - F.sum("weight").over(fill) + F.col("weight"))
    by = by.withColumn("level", (F.sum("source_size").over(all_) * F.lit(share) - F.col("done")) / F.col("weigh"))
    by = by.withColumn("place", F.row_number().over(fill))
    first = F.min(F.when(F.col("limit") / F.col("weight") > F.col("level"), F.struct("place", "level"))).over(all_)["level"]
    by = by.withColumn("target", F.coalesce(F.least(F.col("limit"), first * F.col("weight")), F.col("limit")))
    return by.select("skey", "source_size", "target", "k")


def slot_shares(by: DataFrame, block: int) -> DataFrame:
    """Adds unit, the words of a source's blocks, extra, the words by which shorter blocks count more, and lo and hi, its part of the slots."""
    order, all_ = W.orderBy("k"), W.partitionBy()
    unit = F.least(F.lit(block).cast("long"), F.greatest(F.lit(1).cast("long"), F.floor(F.col("target") / SOURCE_SLOTS)))
    by = by.withColumn("unit", unit).withColumn("worth", F.col("target") * (F.lit(float(block)) / F.col("unit")))
    by = by.withColumn("upto", F.sum("worth").over(order)).withColumn("total", F.sum("worth").over(all_))
    top = F.when(F.col("upto") >= F.col("total"), F.lit(1.0)).otherwise(F.col("upto") / F.col("total"))
    return by.withColumn("lo", (F.col("upto") - F.col("worth")) / F.col("total")).withColumn("hi", top).select(
        "skey", "source_size", "target", "lo", "hi", "k", "unit", (F.col("worth") - F.col("target")).alias("extra")
    )


def running(df: DataFrame, group: str, bucket: str, order: list[str], value: Column, out: str) -> DataFrame:
    """Sum of ``value`` over the rows of the group before this one, by bucket and then ``order``."""
    rows = df.withColumn("_v", value)
    inside = W.partitionBy(group, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy(group, bucket).agg(F.sum("_v").alias("_s"))
    before = W.partitionBy(group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(group, bucket, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_b"))
    rows = rows.withColumn("_i", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    return rows.join(sums, [group, bucket]).withColumn(out, F.col("_i") + F.col("_b")).drop("_v", "_i", "_b")


def schedule(by: DataFrame, n_slots: int) -> DataFrame:
    """slot, skey, block: the source of each slot and the slot's rank among its source's."""
    spark = by.sparkSession
    u = F.col("slot") * F.lit(GOLDEN) - F.floor(F.col("slot") * F.lit(GOLDEN))
    slots = spark.range(n_slots).withColumnRenamed("id", "slot").withColumn("u", u)
    slots = slots.withColumn("cell", F.floor(F.col("u") * CELLS).cast("int"))
    last = F.least(F.lit(CELLS - 1), F.floor(F.col("hi") * CELLS).cast("int"))
    cells = by.where(F.col("hi") > F.col("lo")).select(
        "skey", "lo", "hi", F.explode(F.sequence(F.least(F.floor(F.col("lo") * CELLS).cast("int"), last), last)).alias("cell")
    )
    placed = slots.join(cells, "cell").where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("slot", "skey")
    size = max(BUCKET_ROWS, math.isqrt(n_slots))
    placed = placed.withColumn("part", F.floor(F.col("slot") / size))
    return running(placed, "skey", "part", ["slot"], F.lit(1), "block").select("slot", "skey", "block")


def mix(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", seed: str = SEED
) -> DataFrame:
    """doc_id, size, source_size, target, taken and own (the text's hash) of each row."""
    text, own = F.col(text_column), F.xxhash64(text_column)
    sized = docs.select(
        F.col(id_column).alias("doc_id"),
        F.col(source_column).alias("source"),
        F.coalesce(F.concat(F.lit("="), source_column), F.lit("null")).alias("skey"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_column).cast("string"), F.concat(F.lit("text:"), own.cast("string"))))), 1, 15).alias("key"),
        own.alias("own"),
    )
    sized = materialize(sized.withColumn("rid", F.monotonically_increasing_id()))
    n_rows, words = sized.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    block = max(1, min(MAX_BLOCK, math.ceil(SHARE * words / MIN_SLOTS)))
    by = materialize(slot_shares(targets(sized), block))
    extra = by.agg(F.coalesce(F.sum("extra"), F.lit(0.0))).first()[0]
    n_slots = math.ceil((SHARE * words + extra) / block)
    slots = schedule(by, n_slots).withColumn("block", F.col("block").cast("long"))
    # n multiples of the golden ratio miss an interval's share of n by at most 2 * (3 + 3.6 ln n) (discrepancy of partial quotients that are all one)
    stray = 2 * math.ceil(3 + 3.6 * math.log(max(2, n_slots)))
    n_buckets = max(1, n_rows // max(BUCKET_ROWS, math.isqrt(n_rows)))
    bucket = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * n_buckets / F.lit(2.0**32))
    rows = running(sized.withColumn("part", bucket), "skey", "part", ["key", "doc_id", "size", "own"], F.col("size"), "start")
    rows = rows.drop("part").join(by.select("skey", "source_size", "target", "unit"), "skey")
    # where the document stands in the source's words, read EPOCHS times
    stretch = F.explode(F.sequence(F.lit(0), F.lit(EPOCHS - 1)))
    placed = rows.where("size > 0").withColumn("epoch", stretch)
    placed = placed.withColumn("from", F.col("start") + F.col("epoch") * F.col("source_size")).withColumn("to", F.col("from") + F.col("size"))
    unit = F.col("unit")
    placed = placed.where(F.col("from") < F.ceil(F.col("target")) + (stray + 1) * unit)
    blocks = F.explode(F.sequence(F.floor(F.col("from") / unit), F.floor((F.col("to") - 1) / unit)))
    placed = placed.select("rid", "skey", "from", "to", "unit", blocks.alias("block"))
    shared = F.least(F.col("to"), (F.col("block") + 1) * unit) - F.greatest(F.col("from"), F.col("block") * unit)
    taken = placed.join(slots, ["skey", "block"]).groupBy("rid").agg(F.sum(shared).alias("taken"))
    out = rows.join(taken, "rid", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "own")


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents", "doc_id", "text", "source")).drop("own")


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce('=' || source, 'null') AS skey,
  coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size, substr(md5('{SEED}:' || doc_id), 1, 15) AS key FROM documents),
s AS (SELECT skey, source, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
a AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS k FROM s),
b AS (SELECT *, ([{", ".join(f"{w}.0::DOUBLE" for w in WEIGHTS)}])[k % {len(WEIGHTS)} + 1] AS weight, source_size * {float(EPOCHS)}::DOUBLE AS lim FROM a),
c AS (SELECT *, sum(lim) OVER f - lim AS done, sum(weight) OVER () - sum(weight) OVER f + weight AS weigh, row_number() OVER f AS place,
  sum(source_size) OVER () * {SHARE}::DOUBLE AS all_ FROM b WINDOW f AS (ORDER BY lim / weight, k)),
e AS (SELECT *, (all_ - done) / weigh AS level FROM c),
g AS (SELECT *, (SELECT arg_min(level, place) FROM e WHERE lim / weight > level) AS water FROM e),
h AS (SELECT *, coalesce(least(lim, water * weight), lim) AS target FROM g),
i AS (SELECT *, sum(target) OVER (ORDER BY k) AS upto, sum(target) OVER () AS total FROM h),
r AS (SELECT skey, source_size, target, (upto - target) / total AS lo, CASE WHEN upto >= total THEN 1.0::DOUBLE ELSE upto / total END AS hi FROM i),
p AS (SELECT greatest(1, least({MAX_BLOCK}, ceil({SHARE} * sum(size) / {MIN_SLOTS})))::BIGINT AS block, {SHARE} * sum(size) AS words FROM d),
u AS (SELECT (x * {GOLDEN}::DOUBLE) - floor(x * {GOLDEN}::DOUBLE) AS u FROM (SELECT unnest(range(ceil(words / block)::BIGINT)) AS x FROM p)),
n AS (SELECT skey, count(*) AS slots FROM u JOIN r ON u.u >= r.lo AND u.u < r.hi GROUP BY skey),
o AS (SELECT d.*, sum(size) OVER (PARTITION BY skey ORDER BY key, doc_id, size, rid) - size AS start FROM d)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  (greatest(0, least(start + size, coalesce(slots, 0) * block) - start)
   + greatest(0, least(start + size + source_size, coalesce(slots, 0) * block) - start - source_size))::BIGINT AS taken
FROM o JOIN r USING (skey) LEFT JOIN n USING (skey), p"""

QUERIES = {"op9_source_mix": op9_source_mix}
ORACLES = {"op9_source_mix": ORACLE}
