"""Attribution methods as scores of passages, their normalization and metrics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.functions.text import answer_tokens, hash_unit, tokenize

#: English function words that lexical overlap leaves out.
STOP_WORDS = (
    "a about after all an and any are as at be been before but by can could did do does for from had has have he her his how i if in into is it its "
    "me more most my no not of on one only or other our out over she so some such than that the their them then there these they this to was were what when which who will with you"
).split()


@dataclass(frozen=True)
class Method:
    name: str
    score: Callable[[], Column]
    is_control: bool = False
    needs_generation: bool = False


_methods: dict[str, Method] = {}


def register(method: Method) -> Method:
    """A method is a column over rows of (qid, pid, idx, is_gold, title, body, question, answer, cited, ...)."""
    if method.name in _methods:
        raise ValueError(f"{method.name} is taken")
    _methods[method.name] = method
    return method


def get_method(name: str) -> Method:
    if name not in _methods:
        raise KeyError(f"no attribution method {name}; there are {', '.join(sorted(_methods))}")
    return _methods[name]


def content_words(c) -> Column:
    return F.array_distinct(F.filter(tokenize(c), lambda w: ~w.isin(STOP_WORDS)))


def lexical_overlap(query, passage) -> Column:
    q = content_words(query)
    return F.size(F.array_intersect(q, content_words(passage))) / F.greatest(F.lit(1), F.size(q))


def has_run(words: Column, needle: Column) -> Column:
    """Whether the array ``needle`` stands in ``words`` in one piece; an empty one never does. Words have no blanks."""
    padded = lambda xs: F.concat(F.lit(" "), F.array_join(xs, " "), F.lit(" "))
    return (F.size(needle) > 0) & padded(words).contains(padded(needle))


register(Method("citations", lambda: F.array_contains("cited", F.col("alias")).cast("double"), needs_generation=True))
register(Method("oracle_gold", lambda: F.col("is_gold").cast("double"), is_control=True))
register(Method("control_answer_string", lambda: has_run(answer_tokens("body"), answer_tokens("answer")).cast("double"), is_control=True))
register(Method("control_random", lambda: hash_unit(F.concat(F.lit("random:"), "pid")), is_control=True))
register(Method("control_lexical", lambda: lexical_overlap("query", F.concat_ws(" ", "title", "body")), is_control=True))
register(Method("control_length", lambda: F.size("toks").cast("double"), is_control=True))
register(Method("leave_one_out", lambda: stub_weight("title", "body", "answer", "pid")))


def stub_weight(title, body, target, pid) -> Column:
    """What a passage adds to the offline model's score of the target: 2 if either names the other, else a little by hash."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    named = (c(title) != "") & F.lower(c(target)).contains(F.lower(c(title))) | (c(target) != "") & F.lower(c(body)).contains(F.lower(c(target)))
    return F.when(named, F.lit(2.0)).otherwise(0.1 * hash_unit(F.concat(F.lit("w:"), c(pid))))


def normalized(scores: DataFrame, score: str = "score", keys=("qid",)) -> DataFrame:
    """norm from 0 to 1 in each group; 0.5 and degenerate where all scores are alike."""
    w = W.partitionBy(*keys)
    low, high = F.min(score).over(w), F.max(score).over(w)
    flat = F.abs(high - low) <= 1e-9 * F.greatest(F.abs(high), F.abs(low))
    return scores.withColumn("degenerate", flat).withColumn("norm", F.when(flat, F.lit(0.5)).otherwise(F.try_divide(F.col(score) - low, high - low)))


def shuffled(scores: DataFrame, seed: str, score: str = "score") -> DataFrame:
    """The scores of each question dealt anew to its passages, in the order of a hash."""
    place = W.partitionBy("qid").orderBy("idx")
    dealt = W.partitionBy("qid").orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), "pid"), 256))
    to = scores.select("qid", "pid", "idx", F.row_number().over(place).alias("k"))
    of = scores.select("qid", F.col(score), F.row_number().over(dealt).alias("k"))
    return to.join(of, ["qid", "k"]).drop("k")


def divergence(p: Column, q: Column, eps: float = 1e-12) -> Column:
    """Jensen-Shannon divergence by natural logarithm, 0 at least."""
    part = lambda x, y: x * F.log((x + eps) / ((x + y) / 2 + eps))
    terms = F.zip_with(p, q, lambda x, y: part(x, y) + part(y, x))
    return F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) / 2)
