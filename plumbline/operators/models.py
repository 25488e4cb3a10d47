"""Models as pluggable boundaries: factories by name, called in batches of rows inside tasks.

A factory makes the model once for a task, so weights are loaded there and never shipped. Only the columns that a model
reads go to Python, and it must give one result for each row it gets. Four kinds of model:

- embedder: ``(texts, role)`` to vectors; role is "passage" or "query", for prompts that differ.
- reranker: ``(questions, passages)`` to numbers.
- generator: ``(prompts)`` to texts.
- scorer: an object with ``logprobs(contexts, questions, targets)`` to sums of log-probabilities and
  ``distributions(contexts, questions, targets)`` to a list of distributions for each, one for a token of the
  target; a context is a list of (pid, title, body).

The offline stubs below are functions of the texts alone, so SQL can express them.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

Factory = Callable[[], Any]
#: What models give, as Spark's types and as Arrow's.
RETURNS = {"double": pa.float64(), "string": pa.string(), "array<double>": pa.list_(pa.float64())}
KINDS = ("embedder", "reranker", "generator", "scorer")
_factories: dict[tuple[str, str], Factory] = {}


def register(kind: str, name: str, factory: Factory) -> None:
    if kind not in KINDS:
        raise ValueError(f"no kind of model is called {kind}")
    if (kind, name) in _factories:
        raise ValueError(f"the {kind} {name} is taken")
    _factories[kind, name] = factory


def get(kind: str, name: str) -> Factory:
    if (kind, name) not in _factories:
        known = ", ".join(sorted(n for k, n in _factories if k == kind))
        raise KeyError(f"no {kind} {name}; there are {known}")
    return _factories[kind, name]


def batched(call: Callable[..., Any], columns: list[list], size: int) -> list:
    """All results of a model, asked for at most ``size`` rows at once."""
    out: list = []
    for k in range(0, len(columns[0]), size):
        part = [c[k : k + size] for c in columns]
        got = list(call(*part))
        if len(got) != len(part[0]):
            raise ValueError(f"the model gave {len(got)} results for {len(part[0])} rows")
        out += got
    return out


def column(factory: Factory, call: Callable[..., Any], inputs: list[Column], returns: str, batch: int = 64) -> Column:
    """``call(model, *lists)`` over the rows of ``inputs``; of an Arrow batch only ``batch`` rows are Python's at a time."""

    @F.arrow_udf(returns)
    def run(parts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        model = factory()
        for part in parts:
            out: list = []
            for k in range(0, len(part[0]), batch):
                out += batched(lambda *x: call(model, *x), [c.slice(k, batch).to_pylist() for c in part], batch)
            yield pa.array(out, RETURNS[returns])

    return run(*inputs)


def embed(name: str, text: Column, role: str, batch: int = 64) -> Column:
    return column(get("embedder", name), lambda m, texts, _: m(texts, role), [text, F.lit(role)], "array<double>", batch)


def rerank_score(name: str, question: Column, passage: Column, batch: int = 64) -> Column:
    """A score that isn't a finite number fails the job."""

    def scores(model, questions, passages):
        got = [float(x) for x in model(questions, passages)]
        if not all(map(math.isfinite, got)):
            raise ValueError(f"the reranker {name} gave scores that aren't finite")
        return got

    return column(get("reranker", name), scores, [question, passage], "double", batch).alias("score")


def generate(name: str, prompt: Column, batch: int = 16) -> Column:
    return column(get("generator", name), lambda m, p, _: m(p), [prompt, F.lit(0)], "string", batch)


def _contexts(pids, titles, bodies) -> list[list[tuple[str, str, str]]]:
    """The whole context and those without each passage in turn."""
    whole = list(zip(pids, titles, bodies, strict=True))
    return [whole] + [whole[:i] + whole[i + 1 :] for i in range(len(whole))]


def _ablated(name: str, ask: Callable, reduce: Callable, batch: int) -> Callable[..., Column]:
    factory = get("scorer", name)

    def each(model, questions, targets, pids, titles, bodies):
        for q, t, *passages in zip(questions, targets, pids, titles, bodies, strict=True):
            contexts = _contexts(*passages)
            whole, *rest = batched(lambda *x: ask(model, *x), [contexts, [q] * len(contexts), [t] * len(contexts)], batch)
            yield [reduce(whole, x) for x in rest]

    return lambda *inputs: column(factory, each, list(inputs), "array<double>", batch)


def leave_one_out(name: str, question, target, pids, titles, bodies, batch: int = 16) -> Column:
    """For each passage of a row's arrays, the log-probability that the target loses without it.

    A question's n + 1 contexts are made in the task from one row, so its texts are shuffled once and not n times.
    """
    run = _ablated(name, lambda m, *x: m.logprobs(*x), lambda whole, without: whole - without, batch)
    return run(*(F.col(x) if isinstance(x, str) else x for x in (question, target, pids, titles, bodies)))


def arc_jsd(name: str, question, target, pids, titles, bodies, batch: int = 16) -> Column:
    """For each passage, the mean over the target's tokens of the divergence between distributions with it and without."""
    run = _ablated(name, lambda m, *x: m.distributions(*x), _mean_divergence, batch)
    return run(*(F.col(x) if isinstance(x, str) else x for x in (question, target, pids, titles, bodies)))


def _mean_divergence(whole, without, eps: float = 1e-12) -> float:
    if len(whole) != len(without):
        raise ValueError("distributions of the same target differ in length")
    p, q = np.asarray(whole, dtype=float), np.asarray(without, dtype=float)
    middle = (p + q) / 2 + eps
    both = p * np.log((p + eps) / middle) + q * np.log((q + eps) / middle)
    return float(np.maximum(0.0, both.sum(axis=1) / 2).mean())


@lru_cache(1 << 16)
def unit(text: str) -> float:
    """As hash_unit of the text functions."""
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big") / 2.0**64


class StubScorer:
    """A passage adds 2 if it names the target or the target names it, else a little by hash; four tokens to a distribution."""

    vocabulary = 4

    def weight(self, passage: tuple[str, str, str], target: str) -> float:
        pid, title, body = passage
        low = target.lower()
        named = (title != "" and title.lower() in low) or (low != "" and low in body.lower())
        return 2.0 if named else 0.1 * unit(f"w:{pid}")

    def logprobs(self, contexts, questions, targets):
        return [-10 + sum(self.weight(p, t) for p in c) for c, t in zip(contexts, targets, strict=True)]

    def distributions(self, contexts, questions, targets):
        for context, target in zip(contexts, targets, strict=True):
            weights = [(p[0], self.weight(p, target)) for p in context]
            places = range(max(1, len([w for w in target.split(" ") if w])))
            mass = [[1 + sum(w * unit(f"d:{pid}:{at}:{v}") for pid, w in weights) for v in range(self.vocabulary)] for at in places]
            yield [[m / sum(row) for m in row] for row in mass]


#: Dimensions of the stub's vectors.
DIMENSIONS = 16


@lru_cache(1 << 16)
def _dimension(word: str) -> int:
    return hashlib.sha256(word.encode()).digest()[0] % DIMENSIONS


def stub_embedder() -> Callable:
    """Words counted by a hash, at unit length; a text without words has zeros."""
    words = re.compile("[a-z0-9]+")

    def embed_texts(texts, role):
        for text in texts:
            counts = np.zeros(DIMENSIONS)
            for w in words.findall((text or "").lower()):
                counts[_dimension(w)] += 1
            yield (counts / (np.linalg.norm(counts) or 1.0)).tolist()

    return embed_texts


register("embedder", "stub", stub_embedder)
register("reranker", "stub", lambda: lambda questions, passages: [float(len(q) + 2 * len(p)) for q, p in zip(questions, passages, strict=True)])
register("generator", "stub", lambda: lambda prompts: ["{1} [{0}]".format(*p.rsplit("\n", 1)[-1].split(": ", 1)) for p in prompts])
register("scorer", "stub", StubScorer)
