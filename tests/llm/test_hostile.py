"""Texts and files made to stall or end a job: each is taken within seconds, with the stated result."""

import struct
import time

import pytest
from pyspark.sql import functions as F

from plumbline.llm import extract, lines, media, pii

SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(autouse=True)
def within_seconds():
    began = time.time()
    yield
    assert time.time() - began < 90


def test_line_without_blanks(spark):
    rows = [(1, "x" * 3_000_000, "en", "a"), (2, "ab\t" * 300_000, "en", "b"), (3, "é" * 1_000_000 + " a", "en", "c"), *((9 + i, "one two three", "en", f"s{i}") for i in range(7))]
    got = {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {k for k, v in got.items() if v} == set(range(10, 16))


def test_words_of_a_line(spark):
    texts = ["a b c", " a b c ", "a b", "a  b\tc", "", " ", "a", "a b ", "\x0ba b\rc", "a\x1cb c d"]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], SCHEMA)
    for n in (0, 1, 2, 3):
        got = {r["doc_id"] for r in lines.line_places(df, "doc_id", "text", "source", n).collect()}
        assert got == {i for i, t in enumerate(texts) if len([w for w in t.replace("\x1c", "_").split() if w]) >= n}


def test_chain_of_labels(spark):
    texts = ["a@" + "b." * 1_000_000, "a@" + "b." * 400_000 + "com", "a" * 1_000_000, "a@b" * 200_000, "1 " * 4_000, "x@" + "-" * 1_000_000, "1." * 400_000, "4-" * 4_000]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r for r in pii.pseudonymize(df).collect()}
    assert len(got) == len(texts)
    assert got[0]["text"] == texts[0] and got[2]["text"] == texts[2] and got[5]["text"] == texts[5]
    assert len(got[1]["text"]) < 100 and got[1]["text"].endswith("@example.org")


def test_mail_pattern_takes_what_a_group_of_labels_takes(spark):
    grouped = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"
    texts = ["a@b.com", "a@b.com.1x", "a@b..com", "a@.b.com", "a@b.co..uk", "a@b.c", "a@b.c1d.ef2.gh", "x a@b.c.de. f@g.hi-", "a@-b-.com5", "a@b.com.", "a@a@b.org"]
    texts += ["a@" + "".join(p) for n in range(1, 6) for p in __import__("itertools").product(["b", ".", "co", "1", "-"], repeat=n)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    r = df.select(F.regexp_extract_all("t", F.lit(pii.EMAIL), 0).alias("ours"), F.regexp_extract_all("t", F.lit(grouped), 0).alias("theirs"), "t").where("ours <> theirs")
    assert r.collect() == []


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def track(stsz, stts, stsc=(1, 1, 1), stco=(8,)):
    u = lambda *x: struct.pack(f">{len(x)}I", *x)
    stbl = box(b"stbl", box(b"stsd", u(0, 1), box(b"raw ", bytes(8))), box(b"stts", u(0, len(stts) // 2, *stts)), box(b"stsc", u(0, len(stsc) // 3, *stsc)), box(b"stsz", u(0, *stsz)), box(b"stco", u(0, len(stco), *stco)))
    return box(b"moov", box(b"trak", box(b"mdia", box(b"mdhd", u(0, 0, 0, 1000, 0, 0)), box(b"hdlr", u(0, 0), b"vide", bytes(13)), box(b"minf", stbl))))


def test_counts_and_depth_of_boxes(spark):
    huge = (1 << 32) - 16
    deep = b""
    for _ in range(3000):
        deep = box(b"moov", deep)
    mdat = box(b"mdat", bytes(100))
    files = [
        mdat + track((1, huge), (huge, 1)), mdat + track((0, 1, 5), (huge, 1)), mdat + track((5, 1), (1, 1), (1, huge, 1)), mdat + track((5, 3), (3, 1), (1, 3, 1)), deep,
        mdat + box(b"moov", box(b"mvex")) + box(b"moof"), mdat + track((5, 2), (2, 7), (2, 1, 1), (8, 13)), mdat + track((5, 2), (2, 7), (1, 1, 1, 2, 1, 1), (8, 60)),
    ]
    df = spark.createDataFrame(list(enumerate(files)), "i int, media binary")
    got = {r["i"]: r for r in media.read_media(df, "media", "i").collect()}
    assert [got[i]["error"] is None for i in range(8)] == [False, False, True, True, False, False, False, True]
    assert "fragmented" in got[5]["error"] and "deeper" in got[4]["error"]
    assert got[3]["n_samples"] == 3 and len(got[3]["payload"]) == 15
    assert [tuple(k) for k in got[7]["key_ranges"]] == [(8, 13, 0), (60, 65, 7)]


def test_many_small_samples():
    payload = bytes(8_000_000)
    got, _ = media.parse_media(box(b"mdat", payload) + track((1, len(payload)), (len(payload), 1), (1, len(payload), 1)))
    assert got["n_samples"] == len(payload) and got["chunks"] == [(8, 8 + len(payload))]


@pytest.mark.parametrize(
    "page", ["<div>" * 100_000 + "<p>x " * 100_000, "<article><p>words and words" * 20_000, "<div class=comment>" * 30_000 + "<p>t" * 30_000, "<ul>" * 20_000 + "<li>a" * 50_000, "<div>" * 50_000 + "</p>" * 50_000]
)
def test_open_elements(page):
    extract.extract(page)


def test_open_elements_keep_text():
    assert extract.extract("<div>" * 50_000 + "<p>a text of words" * 3) == "a text of words a text of words a text of words"
