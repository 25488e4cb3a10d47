"""Operator 2: ISO base media files as columns.

``read_media`` walks the nested boxes of files in a binary column and decodes the sample tables of each track
(sample sizes, chunk offsets, samples to chunks, sync samples, time to sample), so each row gets, of its first video track or else its
first one, the codec, duration and the byte range and time of each key frame, and the same of every track in ``tracks``; payload bytes
are only sliced, never decoded. A track's boxes are those inside its own; a duration of 0 is taken from the times of its samples.
``write_media`` packs bytes losslessly into such a file: one track of unsigned 8-bit samples ('raw ').

A null text counts as empty and is stored as 64 zero bytes. Files that are cut short or lack one of
the needed boxes give nulls and the reason in ``error``; so do tables that contradict each other or count more than the file holds, boxes nested
deeper than DEPTH and fragmented files, which have no tables of samples. Long texts stay one row's bytes; repeated
rows and ties give equal files, and an empty table gives an empty one. Of the input only the named columns are read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

#: Bytes of a sample, samples of a chunk, samples from a key frame to the next, samples per second.
SAMPLE, CHUNK, KEY, RATE = 64, 16, 8, 8000
#: Boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf"}
#: Boxes in one another at most; the tables of samples are at the fifth place.
DEPTH = 64

MEDIA_SCHEMA = (
    "codec string, timescale long, duration long, n_samples long, key_ranges array<struct<start:long,end:long,time:long>>, "
    "tracks array<struct<handler:string,codec:string,timescale:long,duration:long,n_samples:long,key_ranges:array<struct<start:long,end:long,time:long>>>>, "
    "payload binary, error string"
)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def write_media(payload: bytes) -> bytes:
    """A file whose samples are the payload's bytes in order; a pure function of the payload."""
    count = -(-len(payload) // SAMPLE)
    sizes = [SAMPLE] * (count - 1) + [len(payload) - SAMPLE * (count - 1)] if count else []
    times = [(x, len(list(same))) for x, same in groupby(sizes)]
    chunks = -(-count // CHUNK)
    last = count - CHUNK * (chunks - 1)
    duration = len(payload)
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    runs = ([(1, CHUNK)] if chunks > 1 else []) + ([(chunks, last)] if chunks and (chunks == 1 or last != CHUNK) else [])
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp41")
    wide = len(payload) + 4096 + 8 * chunks >= 1 << 32

    def moov(base: int) -> bytes:
        offsets = [base + SAMPLE * CHUNK * i for i in range(chunks)]
        entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHIHHI", 1, 8, 0, 0, 0, RATE << 16 & 0xFFFFFFFF))
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">I", len(times)), b"".join(struct.pack(">II", n, x) for x, n in times)),
            _full(b"stss", struct.pack(">I", -(-count // KEY)), b"".join(struct.pack(">I", i + 1) for i in range(0, count, KEY))),
            _full(b"stsc", struct.pack(">I", len(runs)), b"".join(struct.pack(">III", first, n, 1) for first, n in runs)),
            _full(b"stsz", struct.pack(">II", SAMPLE if set(sizes) == {SAMPLE} else 0, count), b"" if set(sizes) == {SAMPLE} else b"".join(struct.pack(">I", x) for x in sizes)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), b"".join(struct.pack(">Q" if wide else ">I", x) for x in offsets)),
        )
        minf = _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, duration & 0xFFFFFFFF, 0x55C4, 0)), _full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"), minf)
        tkhd = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, duration & 0xFFFFFFFF), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), matrix, bytes(8), flags=3)
        mvhd = _full(b"mvhd", struct.pack(">IIII", 0, 0, RATE, duration & 0xFFFFFFFF), struct.pack(">IH", 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    size = 8 + len(payload)
    lead = struct.pack(">I4s", size, b"mdat") if size < 1 << 32 else struct.pack(">I4sQ", 1, b"mdat", size + 8)
    base = len(head) + len(moov(0)) + len(lead)
    return b"".join((head, moov(base), lead, payload))


def walk(data: bytes) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, start, end) of every box's body, parents first; boxes nested deeper than DEPTH are an error."""
    within = [(0, len(data), ())]
    while within:
        start, end, path = within.pop()
        if start + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if start + 16 > end:
                raise ValueError("a box's size is cut off")
            size, body = struct.unpack_from(">Q", data, start + 8)[0], start + 16
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError(f"box {kind!r} at {start} doesn't fit")
        yield (*path, kind), body, start + size
        within.append((start + size, end, path))
        if kind in CONTAINERS:
            if len(path) == DEPTH:
                raise ValueError(f"boxes are nested deeper than {DEPTH}")
            within.append((body, start + size, (*path, kind)))


class Ranges(Sequence):
    """Byte ranges of samples, kept as arrays: 16 bytes a sample."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray):
        self.starts, self.ends = starts, ends

    def __len__(self) -> int:
        return len(self.starts)

    def __getitem__(self, at):
        if isinstance(at, slice):
            return list(zip(self.starts[at].tolist(), self.ends[at].tolist(), strict=True))
        return int(self.starts[at]), int(self.ends[at])


def times_at(runs: np.ndarray, samples: np.ndarray) -> np.ndarray:
    """When the samples (from 0) begin, by runs of (count, delta)."""
    first = np.cumsum(runs[:, 0]) - runs[:, 0]
    began = np.cumsum(runs[:, 0] * runs[:, 1]) - runs[:, 0] * runs[:, 1]
    run = np.searchsorted(first + runs[:, 0], samples, side="right")
    return began[run] + (samples - first[run]) * runs[run, 1]


def parse_track(data: bytes, found: dict[bytes, tuple[int, int]]) -> dict:
    """Handler, codec, time scale, duration, samples' and key frames' byte ranges, and key frames' times, by a track's boxes.

    Tables are read as arrays no longer than the file, and counts are held against its length before anything is made of them.
    """

    def table_of(kind: bytes, columns: int = 1, form: str = ">u4", skip: int = 4) -> np.ndarray:
        start, end = found[kind]
        n, at = struct.unpack_from(">I", data, start + skip)[0], start + skip + 4
        if at + n * columns * np.dtype(form).itemsize > end:
            raise ValueError(f"table {kind!r} is cut off")
        return np.frombuffer(data, form, n * columns, at).astype(np.int64).reshape(n, columns)

    try:
        handler = data[found[b"hdlr"][0] + 8 : found[b"hdlr"][0] + 12].decode("latin-1")
        codec = data[found[b"stsd"][0] + 12 : found[b"stsd"][0] + 16].decode("latin-1")
        at = found[b"mdhd"][0]
        timescale, duration = struct.unpack_from(">IQ", data, at + 20) if data[at] else struct.unpack_from(">II", data, at + 12)
        fixed, count = struct.unpack_from(">II", data, found[b"stsz"][0] + 4)
        if fixed and fixed * count > len(data):
            raise ValueError("samples take more bytes than the file has")
        sizes = np.full(count, fixed, np.int64) if fixed else table_of(b"stsz", skip=8)[:, 0]
        chunks = (table_of(b"co64", form=">u8") if b"co64" in found else table_of(b"stco"))[:, 0]
        runs = table_of(b"stsc", 3)
        times = table_of(b"stts", 2)
        sync = table_of(b"stss")[:, 0] if b"stss" in found else None
    except KeyError as e:
        raise ValueError(f"box {e.args[0]!r} is missing") from None
    if int(times[:, 0].sum()) != count:
        raise ValueError("times and samples differ in number")
    # samples of each chunk: a run holds from its first chunk to the next run's
    until = np.append(runs[1:, 0], len(chunks) + 1)
    if len(runs) and (runs[0, 0] < 1 or (until < runs[:, 0]).any() or until.max() > len(chunks) + 1):
        raise ValueError("runs of chunks are out of order")
    each = np.repeat(runs[:, 1], until - runs[:, 0])
    chunks = chunks[runs[0, 0] - 1 :] if len(runs) else chunks[:0]
    last = np.minimum(np.cumsum(each), count)
    if (int(last[-1]) if len(last) else 0) != count:
        raise ValueError("samples lie outside of the file")
    each = np.diff(last, prepend=0)
    before = np.cumsum(sizes) - sizes  # bytes of the samples before each
    starts = np.repeat(chunks, each) + before - np.repeat(before[(last - each)[each > 0]], each[each > 0])
    if ((starts < 0) | (starts > len(data)) | (starts + sizes > len(data))).any() or (sync is not None and ((sync < 1) | (sync > count)).any()):
        raise ValueError("samples lie outside of the file")
    keys = np.arange(count) if sync is None else sync - 1
    ranges = Ranges(starts, starts + sizes)
    full = each > 0
    first = (last - each)[full]
    return {
        "handler": handler, "codec": codec, "timescale": timescale, "duration": duration or int((times[:, 0] * times[:, 1]).sum()), "n_samples": count, "ranges": ranges,
        "chunks": list(zip(starts[first].tolist(), (starts + sizes)[last[full] - 1].tolist(), strict=True)),
        "key_ranges": list(zip(starts[keys].tolist(), (starts + sizes)[keys].tolist(), times_at(times, keys).tolist(), strict=True)),
    }


def parse_media(data: bytes) -> tuple[dict, list[dict]]:
    """The main track (the first of video, else the first) and all tracks."""
    found: list[dict[bytes, tuple[int, int]]] = []
    for path, start, end in walk(data):
        if path[-1] in (b"moof", b"mvex"):
            raise ValueError("the file is fragmented: its samples aren't in tables")
        if path == (b"moov", b"trak"):
            found.append({})
        elif path[:2] == (b"moov", b"trak"):
            found[-1].setdefault(path[-1], (start, end))
    if not found:
        raise ValueError("there is no track")
    tracks = [parse_track(data, x) for x in found]
    return next((x for x in tracks if x["handler"] == "vide"), tracks[0]), tracks


def read_media(files: DataFrame, media_column: str = "media", *keep: str) -> DataFrame:
    """The columns ``keep`` and MEDIA_SCHEMA of each row's file."""
    rows = files.select(*keep, F.col(media_column).alias("_media"))
    kept = [f for f in rows.schema.fields if f.name != "_media"]
    names = [x.split(" ")[0] for x in ("codec", "timescale", "duration", "n_samples", "key_ranges", "tracks", "payload", "error")]

    def keys(x: dict) -> list[dict]:
        return [{"start": a, "end": b, "time": t} for a, b, t in x["key_ranges"]]

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 7 + ("no file",)
        try:
            x, tracks = parse_media(data)
        except (ValueError, struct.error, IndexError) as e:
            return (None,) * 7 + (str(e),)
        each = [{k: t[k] for k in ("handler", "codec", "timescale", "duration", "n_samples")} | {"key_ranges": keys(t)} for t in tracks]
        return (x["codec"], x["timescale"], x["duration"], x["n_samples"], keys(x), each, b"".join(data[a:b] for a, b in x["chunks"]), None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in slices(batches, "_media", 256):
            part = part.reset_index(drop=True)
            got = pd.DataFrame([one(m) for m in part["_media"]], columns=names)
            for c in ("timescale", "duration", "n_samples"):
                got[c] = got[c].astype("Int64")
            yield pd.concat([part[[f.name for f in kept]], got], axis=1)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [MEDIA_SCHEMA])
    return rows.mapInPandas(run, schema)


def store_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: each text's UTF-8 bytes, filled up with zeros to 64, as a file."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in slices(batches, "text", 256):
            raw = [t.encode("utf-8") if isinstance(t, str) else b"" for t in part["text"]]
            media = [write_media(x + bytes(max(64, -(-len(x) // 64) * 64) - len(x))) for x in raw]
            yield pd.DataFrame({"doc_id": part["doc_id"], "n_bytes": [len(x) for x in raw], "media": media})

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInPandas(run, f"doc_id {kind}, n_bytes long, media binary")


def op2_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store_texts(table(spark, sf_dir, "documents", "doc_id", "text"))
    read = read_media(stored, "media", "doc_id", "n_bytes", "media")
    ranges = F.transform("key_ranges", lambda r: F.concat_ws("-", r["start"], r["end"], r["time"]))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(
            "|", "codec", "timescale", "duration", "n_samples", F.size("key_ranges"), F.sha2(F.array_join(ranges, ","), 256)
        ).alias("feature"),
    )


QUERIES = {"op2_iso_media": op2_iso_media}
ORACLES: dict[str, str] = {}
