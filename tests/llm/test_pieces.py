"""SentencePiece encoding: equal to the library on drawn texts, on the given documents and on every edge."""

import hashlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from plumbline.llm import pieces

PATH = P.path("piece_bpe_32k.model")
ODD = [" ", "  ", "▁", "\n", "\t", "\x00", "é", "漢", "😀", "ı", "<0x41>", "<s>", "the", "ing", "The", ".", "...", "====", "a.b", "1,2", "²."]
SCHEMA = "doc_id long, text string, lang string, ids string, decoded string"


@pytest.fixture(scope="module")
def both():
    return pieces.piece_encoder(PATH), SentencePieceProcessor(model_file=PATH)


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


@given(st.lists(st.one_of(st.sampled_from(ODD), st.characters(exclude_categories=["Cs"]), st.integers(0, 40).map(lambda n: " " * n)), max_size=40).map("".join))
@settings(max_examples=400, deadline=None)
def test_equals_library_on_drawn_texts(both, text):
    ours, library = both
    coded = ours.encode(text)
    want = library.encode(text, add_bos=True, add_eos=True)
    assert ids(coded) == want and ours.decode(coded) == library.decode(want)


def test_every_piece_is_its_own_encoding(both):
    ours, library = both
    v = ours.vocabulary
    assert len(v.left) == len(v.names)
    for name in v.names[::97] + [pieces.BLANK * n for n in range(1, 60)]:
        last = [-1]
        v.extend(name, last, 0)
        assert [v.names[t] for t in v.walk(last, len(name))] == v.joined(name)


@given(st.lists(st.one_of(st.integers(1, 258), st.sampled_from([259, 260, 264, 28705, 226 + 3, 150 + 3, 129 + 3])), max_size=8))
@settings(max_examples=300, deadline=None)
def test_decodes_any_ids(both, numbers):
    ours, library = both
    assert ours.decode(np.array(numbers, "<u4").tobytes()) == library.decode(numbers)


def test_memory_is_bounded(both, monkeypatch):
    ours, library = both
    monkeypatch.setattr(pieces, "MEMO_BYTES", 4000)
    texts = [f"word{i}x, other{i}y" for i in range(300)]
    assert [ids(ours.encode(t)) for t in texts] == library.encode(texts, add_bos=True, add_eos=True)
    assert len(ours.memo) + len(ours.older) < 60


def test_edges(spark, both):
    long = "uninterrupted" * 80_000
    rows = [(1, None), (2, ""), (2, ""), (3, "   "), (None, "a  b\nc "), (4, long), (5, " " * 100_000 + "x"), (6, "漢" * 50_000)]
    df = spark.createDataFrame([(*r, "en", "other ids", "other") for r in rows], SCHEMA)
    got = sorted(((r["doc_id"] or 0), ids(r["ids"]), r["decoded"]) for r in pieces.encode_texts(df, PATH).collect())
    want = sorted(((i or 0), both[1].encode(t or "", add_bos=True, add_eos=True), both[1].decode(both[1].encode(t or ""))) for i, t in rows)
    assert got == want
    assert pieces.encode_texts(df.limit(0), PATH).collect() == []


def test_query_equals_library(spark, both):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = set()
    for d in docs:
        n = both[1].encode(d["text"] or "", add_bos=True, add_eos=True)
        want.add((d["doc_id"], len(n), hashlib.sha256(np.array(n, "<u4").tobytes()).hexdigest(), hashlib.sha256(both[1].decode(n).encode()).hexdigest()))
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in pieces.op12_sentencepiece(spark, sf).collect()}
    assert got == want


def test_other_models_are_refused():
    with pytest.raises(ValueError, match="equal score"):
        pieces.PieceVocabulary({"a": 0.0, "b": 0.0, "ab": -1.0, "ba": -1.0})
