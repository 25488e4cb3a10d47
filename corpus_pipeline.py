"""From raw documents to the encoded training mix: five stages, each written and read again as the next one's input.

Every stage takes (spark, docs, sf_dir) and works on all rows it gets. All but the last return the columns of documents.
Columns of other names are left out, whatever they are called; an empty table gives an empty one at each stage. Nulls and ties:

- language_id: a null text, and one without a letter, goes; a null label is filled in. Repeated rows are judged alike.
- line_dedup: null and empty texts stay as they are; a null source is no site. Of equal lines the one of the smallest id, then place, stays;
  rows without an id come last and are as one.
- near_dedup: texts without words are no copies of each other. One row of each id stays, and rows without an id are documents of their own; ties
  by text and then the other columns, all of which are equal in what still ties.
- source_mix: null texts, and those without words, aren't taken; a null source is one of its own. Rows alike in id and text share their count.
- encode: null and empty texts have no tokens. Repeated rows have equal results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.llm import bpe, langid, lines, mixing, neardup
from plumbline.llm.common import WORD, shared_folder

#: What documents has and every stage but the last returns; other columns of the input are left out.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Posterior of its language under which a document goes.
MIN_SCORE = 0.5
#: Near duplicates share so many percent of their five-word shingles; all bands miss one at that with probability 4e-7.
NEAR_PERCENT, NEAR_BANDS = 80, 28


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognizable language go; a null lang is filled in. Without any labels none is judged."""
    model = langid.train(docs, where=F.crc32("id") % 4 != 2)
    if not model[0]:
        return docs.select(*COLUMNS)
    judged = langid.classify(docs, model, "text", *COLUMNS)
    kept = judged.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go but for their first place; a document of which nothing else was left goes with them."""
    cleaned = lines.dedup_lines(docs.select(*COLUMNS))
    gone = (F.col("n_removed") > 0) & ~F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    length = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.where(~gone).withColumn("n_chars", length).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of the smallest id.

    Of the rows under one id the first with words stays, by text and then the other columns. Rows without an id are
    documents of their own: copies of a text are one, after all those with an id, and each without words stays.
    """
    wordless = ~F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    loose = F.col("doc_id").isNull() & wordless
    unnamed = F.shiftrightunsigned(F.xxhash64("text"), 2) + F.lit(1 << 62)  # beyond any id
    docs = docs.select(*COLUMNS)
    keyed = docs.where(~loose).withColumn("_key", F.coalesce("doc_id", unnamed))
    found = neardup.near_duplicates(keyed, "_key", percent=NEAR_PERCENT, bands=NEAR_BANDS)
    judged = found.groupBy("doc_id").agg(F.coalesce(F.bool_and(F.when(F.col("n_shingles") > 0, F.col("kept"))), F.lit(True)).alias("_kept"))
    kept = judged.where("_kept").select(F.col("doc_id").alias("_key"))
    order = W.partitionBy("_key").orderBy(wordless, "text", "lang", "source", "n_chars")
    first = keyed.join(kept, "_key", "left_semi").withColumn("_place", F.row_number().over(order)).where("_place = 1")
    return first.select(*COLUMNS).union(docs.where(loose))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes all its words; one that is cut counts if most of it is taken."""
    share = mixing.mix(docs).groupBy("doc_id", "own").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    share = share.withColumn("copies", F.round(F.col("taken") / F.greatest(F.lit(1), "size")).cast("int")).where("copies > 0")
    docs = docs.select(*COLUMNS)
    share = share.select(F.col("doc_id").alias("_id"), F.col("own").alias("_own"), "copies")
    joined = docs.join(share, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_own")))
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of what they decode to."""
    import public_tokenizers as P

    return bpe.digests(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("encode", encode),
]

#: Language identification and byte-level BPE can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, with a Parquet table after each in the shared folder."""
    root = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{root}/{k}-{name}")
            docs = spark.read.parquet(f"{root}/{k}-{name}")
    return docs
