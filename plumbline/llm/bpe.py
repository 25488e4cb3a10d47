"""Operator 5: byte-level BPE by dynamic programming over prefixes.

A token sequence is the encoding of its bytes exactly when each of its tokens and each of its
adjacent pairs encodes to itself: a merge across a border inside the sequence would be a merge in
the two tokens around it. So every byte prefix has one last token, which is the only token that
ends there and agrees with the last token of what precedes it. ``PrefixTable`` keeps that token
for each prefix; appended bytes only add entries, and an edit keeps every entry before it.

An automaton over the tokens lists those that end at each byte, longest first, and whether two tokens agree
is told by undoing their merges along the border, so little needs to be remembered: what a worker
keeps beside the vocabulary is bounded in bytes and dropped when a task ends.

Nulls count as the empty text, which has no tokens. Repeated rows and rows that tie in every column give
repeated results; an empty table gives an empty one, and other columns aren't read. Long
texts are split by the pattern into short pieces; a long piece takes one entry per byte.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_slices, table

#: Bytes that remembered pieces may take in a worker, what one takes beside its own bytes, and pairs of tokens; only speed depends on them.
MEMO_BYTES, ENTRY, PAIRS = 40 << 20, 200, 1 << 16


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Vocabulary:
    """Ranks, the last merge of each token, and an automaton that finds tokens by their last byte."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens: dict[int, bytes] = {v: k for k, v in ranks.items()}
        self.sizes = {v: len(k) for k, v in ranks.items()}
        #: Two tokens to what they merge to; the two of each token (a byte stands for itself).
        self.merges: dict[int, int] = {}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.pairs: dict[int, bool] = {}
        self.ending = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, data in sorted(self.tokens.items()):
            found = (token, token) if len(data) == 1 else self._parts(ranks, data, token)
            if found is None:
                continue  # nothing merges to it, so no encoding has it
            self.left[token], self.right[token] = found
            if len(data) > 1:
                self.merges[found[0] << 32 | found[1]] = token
            self.ending.add_word(data.decode("latin-1"), token)
        self.ending.make_automaton()
        self.longest = max(self.sizes.values())
        self.whole = {self.tokens[t].decode("latin-1"): t for t in self.left}

    def _parts(self, ranks: dict[bytes, int], data: bytes, token: int) -> tuple[int, int] | None:
        """The two tokens that are left of ``data`` before its last merge. Tokens of lesser rank are known."""
        for i in range(1, len(data)):
            a, b = ranks.get(data[:i], token), ranks.get(data[i:], token)
            if a < token and b < token and a in self.left and b in self.left and self.agree(a, b):
                return a, b
        return None

    def agree(self, a: int, b: int) -> bool:
        """Whether the bytes of the two tokens encode to just these tokens.

        Merges at the border are undone from the latest to the earliest. What stands on both sides of the border must
        not have merged while it was there: until the side that was undone last was made.
        """
        merged, left, right = self.merges.get, self.left, self.right
        until = 1 << 32  # rank of the first merge that comes too late
        while True:
            across = merged(a << 32 | b)
            if across is not None and across < until:
                return False
            one, two = right[a] != a, left[b] != b
            if not (one or two):
                return True
            # of equal tokens the left one is made first, so the right one is undone first
            if one and (a > b or not two):
                until, a = a, right[a]
            else:
                until, b = b + 1, left[b]

    def merged(self, data: bytes) -> list[int]:
        """The definition: merge the adjacent pair of least rank, leftmost first, until none is left. For tests."""
        ranks = {v: k for k, v in self.tokens.items()}
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 32), i) for i in range(len(parts) - 1))
            if best == 1 << 32:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def extend(self, data: bytes, last: list[int], start: int) -> None:
        """Fill last[start + 1:], the last token of each prefix of ``data``, from last[:start + 1]."""
        pairs, sizes, done = self.pairs, self.sizes, start
        begin = max(0, start + 1 - self.longest)
        for end, token in self.ending.iter(data.decode("latin-1"), begin):
            if end < done:
                continue
            before = end + 1 - sizes[token]
            if before:
                key = last[before] << 32 | token
                fits = pairs.get(key)
                if fits is None:
                    if len(pairs) >= PAIRS:
                        pairs.clear()
                    fits = pairs[key] = self.agree(last[before], token)
                if not fits:
                    continue
            if end > done:
                break
            last.append(token)
            done += 1
        if done < len(data):
            raise ValueError(f"the vocabulary has no token for byte {data[done]}")

    def walk(self, last: list[int], end: int) -> list[int]:
        out, sizes = [], self.sizes
        while end:
            token = last[end]
            out.append(token)
            end -= sizes[token]
        return out[::-1]


class PrefixTable:
    """The last token of every prefix of a byte string that can be appended to and edited."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> PrefixTable:
        start, self.data = len(self.data), self.data + more
        self.vocabulary.extend(self.data, self.last, start)
        return self

    def replace(self, start: int, end: int, by: bytes) -> PrefixTable:
        """Entries up to start stay; what follows is encoded anew."""
        rest = by + self.data[end:]
        self.data, self.last = self.data[:start], self.last[: start + 1]
        return self.append(rest)

    def ids(self, end: int | None = None) -> list[int]:
        """Of the prefix that ends at ``end``; the whole string by default."""
        return self.vocabulary.walk(self.last, len(self.data) if end is None else end)


class Encoder:
    """Texts to ids; pieces that recur are looked up."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary = Vocabulary(ranks)
        self.pieces_of = regex.compile(pattern).findall
        self.memo: dict[str, bytes] = {}
        self.held = 0

    def forget(self) -> None:
        self.memo.clear()
        self.vocabulary.pairs.clear()
        self.held = 0

    def piece(self, data: bytes) -> bytes:
        v = self.vocabulary
        whole = v.whole.get(data.decode("latin-1"))
        if whole is not None:
            return pack("<I", whole)
        last = [-1]
        v.extend(data, last, 0)
        ids = v.walk(last, len(data))
        return pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        pieces = self.pieces_of(text)
        memo = self.memo
        found = list(map(memo.get, pieces))
        if None in found:
            if self.held > MEMO_BYTES:
                self.forget()
            for i, x in enumerate(found):
                if x is None:
                    p = pieces[i]
                    x = memo.get(p)
                    if x is None:
                        x = self.piece(p.encode("utf-8"))
                        if len(x) < 1024:
                            memo[p] = x
                            self.held += ENTRY + len(x) + len(p)
                    found[i] = x
        return b"".join(found)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One to a worker process, of a bounded size."""
    if (path, pattern) not in _encoders:
        _encoders.clear()
        _encoders[path, pattern] = Encoder(load_ranks(path), pattern)
    return _encoders[path, pattern]


def encode_documents(
    docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers), decoded (bytes) of each row's text."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(ranks_path, pattern)
        try:
            for part, texts in arrow_slices(batches, "text"):
                ids = [b"" if t is None else e.encode(t) for t in texts]
                yield pa.record_batch([part["doc_id"], pa.array(ids, pa.binary()), pa.array(map(e.decode, ids), pa.binary(), size=len(ids))], names=["doc_id", "ids", "decoded"])
        finally:
            e.forget()

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, ids binary, decoded binary")


def digests(
    docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded and decoded as ``encode_documents`` does, hashed by Spark."""
    coded = encode_documents(docs, ranks_path, pattern, id_column, text_column)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return digests(table(spark, sf_dir, "documents", "doc_id", "text"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


QUERIES = {"op5_byte_bpe": op5_byte_bpe}
ORACLES: dict[str, str] = {}
