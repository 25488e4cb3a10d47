"""Operator 6: language identification by multinomial naive Bayes over hashed character n-grams.

Training counts the hashed n-grams of a bounded, evenly chosen sample of labelled rows per
language (``max_train`` rows are expected of each; rows are chosen by a hash of their id).
The log-probability matrix (buckets x languages, so bounded by ``max_languages``) is broadcast and
whole texts are scored in batches: one gather and one sum by text.

Letters are the characters that Unicode calls so (``str.isalpha``), which leaves out digits and number signs
of every script; marks are kept with the letters that they stand on. Null texts and texts without a letter are
``und`` with score 0. Where nothing was learned (an empty table, no labels), every row is ``und``. Ties go to the
smallest language name. Repeated rows get repeated results; columns that aren't named aren't read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: n-grams of these orders are hashed to so many buckets.
ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
#: Rows of each language that training expects to take.
MAX_TRAIN = 4000
MAX_LANGUAGES = 256
#: Code points handled at once; n-grams run on over the borders.
SEGMENT = 1 << 18

_MULTIPLIERS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def has_letter(text: str | None) -> bool:
    return isinstance(text, str) and any(map(str.isalpha, text))


@cache
def _kept() -> np.ndarray:
    """Whether each code point is a letter or a mark."""
    return np.array([unicodedata.category(chr(i))[0] in "LM" for i in range(0x110000)])


def buckets(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of all n-grams of the lower-cased text, other characters than letters as spaces."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
    reach = max(ORDERS) - 1
    for at in range(0, len(points), SEGMENT):
        begin = max(0, at - reach)
        c = points[begin : at + SEGMENT].astype(np.uint64)
        c[~_kept()[points[begin : at + SEGMENT]]] = 32
        out = []
        for order in ORDERS:
            first = max(0, at - begin - order + 1)
            n = len(c) - order + 1 - first
            if n <= 0:
                continue
            h = c[first : first + n] * _MULTIPLIERS[0]
            for k in range(1, order):
                h ^= h >> np.uint64(29)
                h += c[first + k : first + k + n]
                h *= _MULTIPLIERS[k]
            h ^= h >> np.uint64(32)
            h *= _MULTIPLIERS[3]
            out.append((h >> np.uint64(48)).astype(np.int64) % BUCKETS)
        if out:
            yield np.concatenate(out)


def train(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "lang",
    where: Column | None = None,
    max_train: int = MAX_TRAIN,
    smoothing: float = 0.5,
) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the BUCKETS x languages matrix of log-probabilities."""
    rows = docs.select(
        F.col(id_column).cast("string").alias("id"), F.col(text_column).alias("text"), F.col(label_column).alias("label")
    )
    rows = rows.where(F.col("label").isNotNull() & F.col("text").isNotNull())
    if where is not None:
        rows = rows.where(where)
    found = rows.groupBy("label").count().limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    if not found:
        return [], np.zeros((BUCKETS, 0))
    share = F.create_map(*[F.lit(x) for r in found for x in (r["label"], min(1.0, max_train / r["count"]))])
    sample = rows.where(F.crc32(F.concat(F.lit("sample:"), "id")) < share[F.col("label")] * 2**32)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for label, text in zip(batch["label"], batch["text"], strict=True):
                if has_letter(text):
                    total = counts.setdefault(label, np.zeros(BUCKETS, dtype=np.int64))
                    for b in buckets(text):
                        total += np.bincount(b, minlength=BUCKETS)
        for label, total in counts.items():
            at = np.flatnonzero(total)
            yield pd.DataFrame({"label": label, "bucket": at, "n": total[at]})

    counted = sample.select("label", "text").mapInPandas(count, "label string, bucket long, n long")
    summed = counted.groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()  # languages x BUCKETS rows at most
    languages = sorted(summed["label"].unique())
    matrix = np.zeros((BUCKETS, len(languages)))
    for k, label in enumerate(languages):
        own = summed[summed["label"] == label]
        matrix[own["bucket"].to_numpy(), k] = own["n"].to_numpy()
    return languages, np.log((matrix + smoothing) / (matrix.sum(axis=0) + smoothing * BUCKETS))


def classify(
    docs: DataFrame, model: tuple[list[str], np.ndarray], text_column: str = "text", *keep: Column | str
) -> DataFrame:
    """The columns ``keep``, lang_pred and score (the posterior under equal priors) of each row.

    Only texts go to the Python workers, and only the two results come back.
    """
    languages, matrix = model
    sent = docs.sparkSession.sparkContext.broadcast(matrix)

    def scored(texts: list[str]) -> np.ndarray:
        weights, out = sent.value, np.zeros((len(texts), len(languages)))
        held: list[np.ndarray] = []
        owners: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if held:
                starts = np.cumsum([0] + [len(x) for x in held[:-1]])
                np.add.at(out, owners, np.add.reduceat(weights[np.concatenate(held)], starts, axis=0))
            held.clear(), owners.clear()
            size = 0

        for i, text in enumerate(texts):
            for b in buckets(text):
                held.append(b)
                owners.append(i)
                size += len(b)
                if size >= SEGMENT:
                    flush()
        flush()
        return out

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            known = np.fromiter(map(has_letter, texts), dtype=bool, count=len(texts))
            pred = np.full(len(texts), "und", dtype=object)
            score = np.zeros(len(texts))
            if languages and known.any():
                log = scored(texts[known].tolist())
                pred[known] = np.array(languages, dtype=object)[log.argmax(axis=1)]
                score[known] = 1.0 / np.exp(log - log.max(axis=1, keepdims=True)).sum(axis=1)
            yield pd.DataFrame({"lang_pred": pred, "score": score})

    # a filter on the results would repeat the work if it were moved below them
    judged = F.pandas_udf(run, "lang_pred string, score double").asNondeterministic()
    rows = docs.select(*keep, judged(F.col(text_column)).alias("_judged"))
    return rows.select(*[c for c in rows.columns if c != "_judged"], "_judged.lang_pred", "_judged.score")


def held_out(id_column: str = "doc_id") -> Column:
    """A quarter of the ids, which training never sees."""
    return F.crc32(F.col(id_column).cast("string")) % 4 == 2


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = train(docs, where=F.crc32("id") % 4 != 2)
    return classify(docs, model, "text", "doc_id", held_out().alias("held_out"))


QUERIES = {"op6_langid": op6_langid}
ORACLES: dict[str, str] = {}
