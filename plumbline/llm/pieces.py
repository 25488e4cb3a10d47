"""Operator 12: SentencePiece encoding and decoding (models of the merge type) by a table of prefixes.

A model of the merge type joins the adjacent pair whose piece has the best score, leftmost first. As with byte-level
merges (operator 5), a sequence of pieces is the encoding of its characters exactly when each piece and each
adjacent pair of pieces encodes to itself. So each prefix has one last piece: of those that an automaton finds ending
there, the one that agrees with the last piece of what precedes it. That piece is stored for each prefix, and the ids are
read from the end backwards.

Two things differ from bytes. Pieces of equal score are joined from the left, whatever they are; models give
equal scores only to runs of one character (blanks), and for two such runs the agreement is told by joining
them. Characters that no piece has stand alone and become the ids of their bytes.

A text starts with one blank more, and blanks are written U+2581, as the model's own normalization has it; models that
normalize in another way, or split words by rules of their own, are refused with a ValueError when they are read.

No piece holds a blank after another character, so a text is cut before its blanks, and what recurs is looked
up in a memory of bounded size. Nulls count as the empty text: begin and end ids alone. Repeated rows, and rows that tie in every column, give repeated
results; an empty table gives an empty one; other columns aren't read. A long text without blanks takes one table entry a character.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby
from struct import pack

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Vocabulary
from .common import slices, table

#: The sign for a blank. A fixed value.
BLANK = "▁"
#: Letters after which a mark is parted from a word, where no piece has them together; only speed depends on it.
LETTER = "[A-Za-zÀ-ÖØ-öø-ÿ]"
#: Bytes that remembered stretches may take in a worker, what one takes beside its own bytes, and pairs of pieces; only speed depends on them.
MEMO_BYTES, ENTRY, PAIRS = 80 << 20, 200, 1 << 18


class PieceVocabulary(Vocabulary):
    """Pieces by rank: single characters first, then the others from the best score to the least."""

    def __init__(self, scores: dict[str, float]):
        singles = sorted(p for p in scores if len(p) == 1)
        longer = sorted((p for p in scores if len(p) > 1), key=lambda p: (-scores[p], len(p), p))
        self.names = [*singles, *longer]
        self.ranks = {p: i for i, p in enumerate(self.names)}
        self.sizes = [len(p) for p in self.names]
        self.merges, self.left, self.right, self.pairs = {}, {}, {}, {}
        self.singles, self.least = frozenset(singles), len(self.names)
        self.scores = scores
        self._find_ties(longer)
        self.ending = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for rank, name in enumerate(self.names):
            found = (rank, rank) if len(name) == 1 else self._last_merge(name, rank)
            if found is None:
                continue  # nothing joins to it, so no encoding has it
            self.left[rank], self.right[rank] = found
            if len(name) > 1:
                self.merges[found[0] << 32 | found[1]] = rank
            self.ending.add_word(name, rank)
        self.ending.make_automaton()
        self.longest = max(map(len, self.names), default=0)
        self.whole = {self.names[r]: r for r in self.left}

    def _find_ties(self, longer: list[str]) -> None:
        """``least``: the first rank of those of equal score, which must be runs of one character and the last of all."""
        for score, tied in groupby(longer, key=self.scores.get):
            tied = list(tied)
            if len(tied) > 1:
                if any(len(set(p)) > 1 for p in tied) or score > self.scores[longer[-1]]:
                    raise ValueError("pieces of equal score must be runs of one character with the least score")
                self.least = self.ranks[tied[0]]

    def _last_merge(self, name: str, rank: int) -> tuple[int, int] | None:
        if rank >= self.least:
            parts = self.joined(name, stop=name)
            return (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        for i in range(1, len(name)):
            a, b = self.ranks.get(name[:i], rank), self.ranks.get(name[i:], rank)
            if a < rank and b < rank and a in self.left and b in self.left and self.agree(a, b):
                return a, b
        return None

    def joined(self, text: str, stop: str = "") -> list[str]:
        """The definition: join the adjacent pair of the best score, leftmost first. ``stop`` isn't made. For runs, and for tests."""
        parts = list(text)
        while len(parts) > 1:
            known = [(-self.scores[x], i) for i in range(len(parts) - 1) if (x := parts[i] + parts[i + 1]) != stop and x in self.scores]
            if not known:
                break
            at = min(known)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def agree(self, a: int, b: int) -> bool:
        one, two = self.names[a], self.names[b]
        if one[-1] == two[0] and max(a, b) >= self.least and one + two == one[-1] * (len(one) + len(two)):
            return self.joined(one + two) == [one, two]
        return super().agree(a, b)

    def extend(self, text: str, last: list[int], start: int) -> None:
        """Fill last[start + 1:], the last piece of each prefix of ``text``, from last[:start + 1]."""
        pairs, sizes, done, n = self.pairs, self.sizes, start, len(self.names)
        for end, piece in self.ending.iter(text, max(0, start + 1 - self.longest)):
            if end < done:
                continue
            if end > done:
                break
            before = end + 1 - sizes[piece]
            if before:
                key = last[before] * n + piece
                fits = pairs.get(key)
                if fits is None:
                    if len(pairs) >= PAIRS:
                        pairs.clear()
                    fits = pairs[key] = self.agree(last[before], piece)
                if not fits:
                    continue
            last.append(piece)
            done += 1
        if done < len(text):
            raise ValueError(f"no piece ends with character {text[done]!r}")


class PieceEncoder:
    """Texts to ids and back, by a model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)  # reads the file; nothing is encoded with it
        ids = range(model.vocab_size())
        special = {i for i in ids if model.is_byte(i) or model.is_control(i) or model.is_unknown(i)}
        if model.normalize(" AÅﬁ\t  b ") != f"{BLANK * 2}AÅﬁ\t{BLANK * 2}b{BLANK}":
            raise ValueError("the model normalizes texts in a way of its own")
        self.id_of = {model.id_to_piece(i): i for i in ids if i not in special}
        self.vocabulary = PieceVocabulary({p: model.get_score(i) for p, i in self.id_of.items()})
        self.ids = [self.id_of[p] for p in self.vocabulary.names]
        names = self.vocabulary.names
        if any(re.search(f"[^{BLANK}]{BLANK}", p) for p in names):
            raise ValueError("a piece holds a blank after another character")
        self.byte_of = {i: int(model.id_to_piece(i)[1:-1], 16) for i in ids if model.is_byte(i)}
        if len(self.byte_of) != 256:
            raise ValueError("the model has no ids for bytes")
        self.id_of_byte = {b: i for i, b in self.byte_of.items()}
        self.begin, self.end = np.uint32(model.bos_id()).tobytes(), np.uint32(model.eos_id()).tobytes()
        #: What an id adds to a text; bytes above 127 only do so together.
        self.texts = ["" if i in special else model.id_to_piece(i).replace(BLANK, " ") for i in ids]
        for i, b in self.byte_of.items():
            self.texts[i] = chr(b) if b < 128 else "�"
        self.high = np.zeros(len(ids), bool)
        self.high[[i for i, b in self.byte_of.items() if b > 127]] = True
        self.silent = {i for i in special if i not in self.byte_of}
        longer = [p for p in names if len(p) > 1]
        alone = "".join(c for c in "\n\r\t" if not any(c in p for p in longer)) or BLANK
        marks = "".join(c for c in ".,;:!?" if not any(re.search(f"{LETTER}[{c}]", p) for p in longer)) or BLANK
        self.cut = re.compile(f"{BLANK}*{LETTER}++(?=[{marks}])|{BLANK}*[^{BLANK}{alone}]+|{BLANK}+|[{alone}]").findall
        #: Ids of stretches met lately, and of those met before; together they take MEMO_BYTES at most.
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def forget(self) -> None:
        self.memo, self.older, self.held = {}, {}, 0
        self.vocabulary.pairs.clear()

    def stretch(self, text: str) -> bytes:
        """Ids of a stretch; characters that no piece has part it."""
        if self.vocabulary.singles.issuperset(text):
            out = self.known(text)
        else:
            out = []
            for known, chars in groupby(text, self.vocabulary.singles.__contains__):
                part = "".join(chars)
                out += self.known(part) if known else map(self.id_of_byte.__getitem__, part.encode())
        return pack(f"<{len(out)}I", *out)

    def known(self, text: str) -> list[int]:
        """Ids of characters that all have pieces, by their table of prefixes."""
        v = self.vocabulary
        whole = v.whole.get(text)
        if whole is not None:
            return [self.ids[whole]]
        last = [-1]
        v.extend(text, last, 0)
        return [*map(self.ids.__getitem__, v.walk(last, len(text)))]

    def encode(self, text: str) -> bytes:
        """The ids, with begin and end, as little-endian unsigned 32-bit integers."""
        if not text:
            return self.begin + self.end
        stretches = self.cut(BLANK + text.replace(" ", BLANK))
        if self.held > MEMO_BYTES // 2:
            self.memo, self.older, self.held = {}, self.memo, 0
        memo, older = self.memo, self.older
        found = list(map(memo.get, stretches))
        if None in found:
            for i, x in enumerate(found):
                if x is None:
                    s = stretches[i]
                    x = memo.get(s)
                    if x is None:
                        x = older.get(s) or self.stretch(s)
                        if len(x) < 1024:
                            memo[s] = x
                            self.held += ENTRY + len(x) + len(s)
                    found[i] = x
        return b"".join([self.begin, *found, self.end])

    def decode(self, ids: bytes) -> str:
        """The text of the ids: bytes that aren't UTF-8 become U+FFFD each, and the blank that was put in front goes."""
        numbers = np.frombuffer(ids, "<u4")
        if self.high[numbers].any():
            parts = []
            for is_byte, run in groupby(numbers.tolist(), self.byte_of.__contains__):
                parts.append(self._bytes(bytes(map(self.byte_of.__getitem__, run))) if is_byte else "".join(map(self.texts.__getitem__, run)))
            text = "".join(parts)
        else:
            text = "".join(map(self.texts.__getitem__, numbers.tolist()))
        if text.startswith(" "):
            first = next(i for i in numbers.tolist() if i not in self.silent)
            return text if first in self.byte_of else text[1:]
        return text

    @staticmethod
    def _bytes(data: bytes) -> str:
        text = ""
        while data:
            try:
                return text + data.decode()
            except UnicodeDecodeError as e:
                text += data[: e.start].decode() + "�"
                data = data[e.start + 1 :]
        return text


_encoders: dict[str, PieceEncoder] = {}


def piece_encoder(path: str) -> PieceEncoder:
    """One to a worker process, of a bounded size."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def encode_texts(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers), decoded (text) of each row's text."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = piece_encoder(model_path)
        try:
            for part in slices(batches, "text"):
                ids = [e.encode(t) if isinstance(t, str) else e.encode("") for t in part["text"]]
                yield pd.DataFrame({"doc_id": part["doc_id"], "ids": ids, "decoded": [e.decode(x) for x in ids]})
        finally:
            e.forget()

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInPandas(run, f"doc_id {kind}, ids binary, decoded string")


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    coded = encode_texts(table(spark, sf_dir, "documents", "doc_id", "text"), P.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


QUERIES = {"op12_sentencepiece": op12_sentencepiece}
ORACLES: dict[str, str] = {}
