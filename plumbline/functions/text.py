"""Column builders for tokens, normalized answers, citations, hashes and ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: A bracket group that holds nothing but passage references.
PURE_GROUP = r"\[ *P\d+(?:[,;/ ]+P\d+)* *\]"
MIXED_GROUP = r"\[ *P\d+(?:\.S\d+)?(?:[,;/ ]+P\d+(?:\.S\d+)?)* *\]"
ABSTENTION = "insufficient evidence"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def upper_each(c) -> Column:
    """Each character's own upper case. One that has several characters for it stays, so lower case brings the text back (``ß`` isn't ``SS``)."""
    up = lambda x: F.when(F.length(F.upper(x)) == 1, F.upper(x)).otherwise(x)
    return F.array_join(F.transform(F.split(as_column(c), ""), up), "")


def tokenize(c) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text."""
    return F.regexp_extract_all(F.lower(as_column(c)), F.lit("[a-z0-9]+"), F.lit(0))


def normalize_answer(c) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    bare = F.regexp_replace(F.lower(as_column(c)), r"\p{Punct}+", "")
    spaced = F.regexp_replace(F.concat(F.lit(" "), bare, F.lit(" ")), r"\s+", " ")
    return F.trim(F.regexp_replace(spaced, "(?<= )(?:an?|the) ", ""))


def answer_tokens(c) -> Column:
    return F.filter(F.split(normalize_answer(c), " "), lambda w: w != "")


def exact_match(a, b) -> Column:
    return (normalize_answer(a) == normalize_answer(b)).cast("long")


def shared_tokens(a: Column, b: Column) -> Column:
    """Size of the bag intersection of two arrays."""
    count = lambda xs, t: F.size(F.filter(xs, lambda y: y == t))
    each = F.transform(F.array_distinct(a), lambda t: F.least(count(a, t), count(b, t)))
    return F.aggregate(each, F.lit(0), lambda x, y: x + y)


def f1(pred, gold) -> Column:
    """Token F1. Answers of yes, no or noanswer match only themselves; two empty ones are equal."""
    p, g = normalize_answer(pred), normalize_answer(gold)
    a, b = answer_tokens(pred), answer_tokens(gold)
    special = ("yes", "no", "noanswer")
    n = shared_tokens(a, b)
    precision, recall = F.try_divide(n, F.size(a)), F.try_divide(n, F.size(b))
    return (
        F.when((p.isin(*special) | g.isin(*special)) & (p != g), F.lit(0.0))
        .when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double"))
        .when(n == 0, F.lit(0.0))
        .otherwise(2 * precision * recall / (precision + recall))
    )


def citation_groups(c, pattern: str = PURE_GROUP) -> Column:
    return F.regexp_extract_all(as_column(c), F.lit(pattern), F.lit(0))


def cited_aliases(c, pattern: str = PURE_GROUP) -> Column:
    """Aliases in the order of their first citation."""
    one = r"P\d+(?:\.S\d+)?" if pattern == MIXED_GROUP else r"P\d+"
    each = F.transform(citation_groups(c, pattern), lambda g: F.regexp_extract_all(g, F.lit(one), F.lit(0)))
    return F.array_distinct(F.flatten(each))


def strip_citations(c, pattern: str = PURE_GROUP) -> Column:
    """The text without citation groups, white space collapsed, separators cut off at both ends."""
    bare = F.regexp_replace(F.regexp_replace(as_column(c), pattern, " "), r"[ \t\n\r]+", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"^[ \t\n.,;:]+", ""), r"[ \t\n.,;:]+$", "")


def is_abstention(c) -> Column:
    return F.lower(as_column(c)).contains(ABSTENTION)


def hash_u64(c) -> Column:
    """The first 8 bytes of sha256 as an unsigned number."""
    return F.conv(F.substring(F.sha2(as_column(c), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def hash_unit(c) -> Column:
    """From 0 to 1, by the same bytes."""
    return hash_u64(c).cast("double") / F.lit(2.0**64)


def bucket(c, n: int = 100) -> Column:
    return F.conv(F.substring(F.sha2(as_column(c), 256), 1, 8), 16, 10).cast("long") % n


def padded(c, width: int) -> Column:
    """Zero-padded to ``width``; longer numbers stay whole."""
    s = as_column(c).cast("string")
    return F.lpad(s, F.greatest(F.lit(width), F.length(s)), F.lit("0"))


def compose_query(question, answer, convention: str) -> Column:
    parts = {"question": [question], "answer": [answer], "question_answer": [question, answer]}[convention]
    return F.array_join(F.filter(F.array(*[F.trim(as_column(p)) for p in parts]), lambda x: x != ""), " ")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(as_column(a), as_column(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda x, y: x + y)


def tree_digest(lines: DataFrame, group: str, digits: int = 4) -> DataFrame:
    """group, buckets, digest of its lines (group, h, line), whatever their order; h is a hexadecimal hash.

    Lines are put in order within the ranges of the first ``digits`` of their hash, 65,536 at most, so what is brought together is a range of lines and
    then a group's digests of ranges. Equal lines count as often as they stand.
    """
    ranges = lines.groupBy(group, F.substring("h", 1, digits).alias("bucket")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("digest"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "digest"))), lambda x: F.concat_ws(":", x["bucket"], x["digest"])), "\n")
    return ranges.groupBy(group).agg(F.count(F.lit(1)).alias("buckets"), F.sha2(joined, 256).alias("digest"))
