"""Divergence of sources: equal to brute force in whole numbers, on every split of the terms."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import audit

SCHEMA = "doc_id long, text string, lang string, source string, g long, n long, item string, p string, number int"
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_docs=audit.MIN_DOCS):
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(audit.TERM, (text or "").translate(LOWER))
        n[lang, source].update(terms)
        docs[lang].update(set(terms))
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, k in docs[lang].items() if k >= min_docs]
        total = {s: sum(n[lang, s][t] for t in kept) for s in sources}
        all_of = {t: sum(n[lang, s][t] for s in sources) for t in kept}
        share = lambda c, size: 1 + 10**9 * (c + 2) // (size + 2 * len(kept))
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p = {s: {t: share(n[lang, s][t], total[s]) for t in kept} for s in sources}
        q = {t: share(all_of[t], sum(total.values())) for t in kept}
        for s in sources:
            pair = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            term = [(-f(p[s][t], q[t]), t.encode()) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:10])):
                out |= {(lang, s, part, x.decode(), -v, k) for k, (v, x) in enumerate(found, 1)}
    return out


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, *r, 5, 6, "item", "p", 7) for i, r in enumerate(rows)], SCHEMA)
    got = [tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in audit.divergence(df, **more).collect()]
    assert len(got) == len(set(got))
    return set(got)


def corpus(sources, docs=400, seed=1):
    """Words common to all sources, of a few of them, and of one."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(docs):
        s = 0 if rng.random() < 0.33 else int(rng.integers(sources))
        words = [f"all{'abc'[x]}" for x in rng.integers(0, 3, 6)] + [f"few{'abcdefghij'[(s + x) % 10]}x" for x in rng.integers(0, 2, 4)] + [f"Own{chr(97 + s % 26)}{chr(97 + s // 26)}"]
        rows.append((" ".join(words), ["en", "en", None][i % 3], f"s{s:03d}"))
    return rows


def test_equals_brute_force(spark):
    rows = [*corpus(12), (None, "en", None), ("", "en", ""), ("1 2 3", "xx", "a"), ("Éé é ÀB", "xx", None), ("rare", None, "s001"), ("long " * 50_000, "en", "s002")]
    assert run(spark, rows) == brute(rows)


def test_many_groups_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(audit, "TILE", 7)
    monkeypatch.setattr(audit, "CELLS", 90)
    monkeypatch.setattr(audit, "HELD", 10)
    rows = corpus(45, 900)
    assert run(spark, rows, min_docs=4) == brute(rows, 4)


@pytest.mark.parametrize("most", [0, 2, 99])
def test_any_split_gives_the_same(spark, monkeypatch, most):
    monkeypatch.setattr(audit, "light_limit", lambda groups: most)
    rows = corpus(9, 150)
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    assert run(spark, []) == set()
    assert run(spark, [(None, None, None)]) == set()
    rows = [("a", "en", "x"), (None, "en", "y"), ("b", "en", "x")]
    assert run(spark, rows) == brute(rows) == {("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)}
    same = [("tie one two", "en", s) for s in ("b", "a", "c")] * 5
    assert run(spark, same) == brute(same)


def test_groups_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(audit, "MAX_GROUPS", 3)
    with pytest.raises(ValueError, match="groups"):
        run(spark, [("a", "en", str(i)) for i in range(4)])


@given(st.lists(st.tuples(st.integers(0, 10**15), st.integers(0, 8 * 10**15)), min_size=1, max_size=20))
@settings(max_examples=100, deadline=None)
def test_shares_are_exact(pairs):
    counts, totals = zip(*((c, c + t + 2) for c, t in pairs), strict=True)
    assert audit.share(np.array(counts), np.array(totals)).tolist() == [1 + 10**9 * (c + 2) // t for c, t in zip(counts, totals, strict=True)]
