"""Phrase mining: equal to brute force on drawn texts, on hot pieces and on every edge."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import phrases

SCHEMA = "doc_id long, text string, lang string, phrase string, n long, piece string, times long, words int"
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least, share=50, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            n["und" if lang is None else lang] += len(w)
            for k in (1, 2, 3):
                f.update(("und" if lang is None else lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    out = {}
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        longer = [f[lang, q] for (of, q) in f if of == lang and len(q) == 3 and len(p) == 2 and p in (q[:2], q[1:])]
        if any(x >= least and 100 * x >= share * a for x in longer):
            continue
        cuts = [(10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)}


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, *r, "phrase", 1, "piece", 2, 3) for i, r in enumerate(rows)], SCHEMA)
    got = [tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in phrases.collocations(df, **more).collect()]
    assert len(got) == len(set(got))
    return set(got)


def drawn(seed, docs=120):
    rng = np.random.default_rng(seed)
    words = ["the", "The", "of", "new", "york", "city", "é", "ÀB", "x\x00y", "nbsp word", "a"]
    rows = []
    for i in range(docs):
        chosen = rng.choice(words, int(rng.integers(0, 30)), p=np.r_[0.2, np.full(10, 0.08)])
        rows.append(("".join(w + rng.choice([" ", "  ", "\t", ", ", ".\n", "\r", " \t "], p=[0.6, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05]) for w in chosen), ["en", None, "und", ""][i % 4]))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = drawn(seed)
    assert run(spark, rows, min_count=3) == brute(rows, 3)


def test_top_and_ties(spark):
    rows = [(f"{a} {b}", "en") for a, b in ("ab", "cd", "ef", "éz", "Zy") for _ in range(10)]
    assert run(spark, rows, top=3) == brute(rows, 10, top=3)


def test_hot_piece_and_edges(spark):
    rows = [("one two three. one two three", "en")] * 400 + [(None, "en"), ("", None), (" \t ", "en"), (".,;", "fr"), ("word " * 60_000, "fr"), ("x" * 200_000, "fr"), ("one two", "en")]
    assert run(spark, rows) == brute(rows, 10)
    assert run(spark, []) == set() == run(spark, [(None, None)])


def test_pair_goes_with_a_triple_of_half_its_count(spark):
    rows = [("a b c", "en")] * 10 + [("a b", "en")] * 10 + [("b c", "en")] * 11
    got = {r[2] for r in run(spark, rows)}
    assert got == {r[2] for r in brute(rows, 10)} and "a b" not in got and "b c" in got


def test_full_bitmap_loses_nothing(spark, monkeypatch):
    rows = drawn(5)
    real = phrases.pair_bitmap
    monkeypatch.setattr(phrases, "pair_bitmap", lambda pairs: (np.full_like(real(pairs)[0], ~np.uint64(0)), real(pairs)[1]))
    assert run(spark, rows, min_count=4) == brute(rows, 4)


def test_large_counts_are_exact(spark):
    a, one, two = 999_999_999_999_989, 999_999_999_999_998, 999_999_999_999_991
    counts = spark.createDataFrame([("en", "x y", a, 2), ("en", "x", one, 1), ("en", "y", two, 1)], "lang string, phrase string, n long, words int")
    assert phrases.candidates(counts).first()["score"] == 10**6 * a * a // (one * two)


def test_sums_out_of_core():
    def given():
        for k in range(40):
            names = pa.array([f"phrase number {i} of {k % 20} " + "x" * 60 for i in range(10_000)])
            yield pa.record_batch([pa.array(["en"] * 10_000), names, pa.array([1] * 10_000)], schema=phrases._SCHEMA)

    found = [b for b in phrases.summed(given(), 2, "40MB")]
    assert sum(b.num_rows for b in found) == 200_000 and {x for b in found for x in b["n"].to_pylist()} == {2}
