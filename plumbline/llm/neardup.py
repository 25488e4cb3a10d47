"""Operator 7: near-duplicate documents by SetSketch registers.

A document is the set of its five-word shingles. Register k of its sketch is the truncated logarithm of the least of
exponential variates of its shingles, so sketches merge by maximum and agree in a register about as often as
the sets' Jaccard similarity. Documents with equal sets are one class from the start, and only one of a class goes on.
Classes that agree in a band of registers are candidates; the likelihood of a pair's three register counts
(greater, less, equal) at given set sizes tells whether its similarity can reach the threshold; what passes is
verified on the full sets. Groups that share a band are never written out as pairs:

1. In some bands each member meets only two members of its bucket, a central one and a drawn one. Verified
   links join large groups into components at a cost in proportion to their members.
2. In all bands only members of different components are compared, in bounded blocks inside tasks, and each
   pair that may pass counts in its first common band only. A block tells which of its members have such a pair; their
   full sets come to the block once, and all of its links are found there by products of 0/1 matrices.

A key that holds many rows (a hub, a bucket, a component, a set of copies) never sends them to one task: what belongs to it is
broadcast, or copied and dealt out with its rows.

A band misses a linked pair by chance: all ``BANDS`` miss one at the threshold with probability below 4e-7. The
likelihood may drop one by ``MARGIN`` deviations; with a ``margin`` of None it drops none, and all candidates are verified.

Null texts and texts without words have the empty set: n_shingles 0, linked with nothing, kept. Rows that share an id
are linked with each other if they have shingles. Rows without an id are linked with nothing: component_id null, kept. Repeated rows get equal
results, and ties have no part in groups. Texts of any length are hashed in segments. An empty table gives an empty result; other
columns of the input aren't read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_slices, materialize, table

WIDTH = 5
#: Link where 100 * intersection >= PERCENT * union.
PERCENT = 85
#: SetSketch parameters: registers, base, rate.
M, BASE, RATE = 256, 1.001, 20.0
ROWS, BANDS, FIRST_BANDS = 4, 20, 6
#: Standard deviations of the estimate below the threshold that still pass.
MARGIN = 4.0
#: Members of a block of a bucket, and their mean of shingles at most; pairs compared at once; hashes in a matrix at once; ids that may be broadcast.
BLOCK, BLOCK_MEAN, CHUNK, COLUMNS, BROADCAST_IDS = 256, 4096, 1 << 16, 1 << 13, 2_000_000
#: Rows of a key from which it is hot. So a table has a hot key for each HOT of its rows at most, which bounds what is broadcast of them.
HOT = 10_000
#: Tasks for a step over fewer than HOT rows.
FEW_TASKS = 8
#: Words hashed at once.
SEGMENT = 1 << 16

_rng = np.random.default_rng(20260101)
_BYTES = _rng.integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BY = np.uint64(0x9E3779B97F4A7C15 | 5)
_BACK = np.uint64(pow(int(_BY), -1, 1 << 64))
_REGISTERS = _rng.integers(1, 1 << 63, size=M, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, by in enumerate((_BY, _BACK)):
            _powers[k] = np.concatenate([np.ones(1, dtype=np.uint64), np.cumprod(np.full(size, by, dtype=np.uint64))])
    return _powers[0][:n], _powers[1][:n]


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of WIDTH words, or of all its words where it has fewer."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # ASCII letters and white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    width = min(WIDTH, len(words))
    out = []
    for at in range(0, len(words) - width + 1, SEGMENT):
        part = words[at : at + SEGMENT + width - 1]
        data = np.frombuffer(b" ".join(part), dtype=np.uint8)
        power, back = _power(len(data) + 1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTES[data] * power[:-1], out=sums[1:])
        sizes = np.fromiter(map(len, part), dtype=np.int64, count=len(part))
        ends = np.cumsum(sizes + 1) - 1
        starts, ends = (ends - sizes)[: len(part) - width + 1], ends[width - 1 :]
        h = (sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64)
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        out.append(np.unique(h ^ (h >> np.uint64(31))))
    return out[0] if len(out) == 1 else np.unique(np.concatenate(out))


def registers(hashes: np.ndarray) -> np.ndarray:
    """The sketch of a set: M registers from 0 to 65535."""
    least = np.full(M, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 512):
        x = hashes[at : at + 512, None] * _REGISTERS
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        np.minimum(least, x.min(axis=0), out=least)
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64)
    return np.clip(np.floor(1 - np.log(np.maximum(exponential, 1e-300) / RATE) / math.log(BASE)), 0, 65535).astype("<u2")


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def _slope(t, greater, less, equal, n_a, n_b):
    """Derivative by the similarity of the log-likelihood of the counts of registers at sizes n_a and n_b."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    c, d = (BASE - 1) / BASE, math.log(BASE)
    x, y = np.maximum(u - v * t, 1e-12), np.maximum(v - u * t, 1e-12)
    p, q = -np.log1p(-x * c) / d, -np.log1p(-y * c) / d
    dp, dq = c / d / (1 - x * c), c / d / (1 - y * c)
    return equal * (v * dp + u * dq) / np.maximum(1 - p - q, 1e-12) - greater * v * dp / p - less * u * dq / q


def estimate(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> float:
    """The similarity of greatest likelihood, by bisection on the slope of a concave function."""
    counts = (np.sum(a > b), np.sum(a < b), np.sum(a == b))
    low, high = 1e-9, min(n_a, n_b) / max(n_a, n_b) - 1e-9
    for _ in range(50):
        middle = (low + high) / 2
        low, high = (middle, high) if _slope(middle, *counts, n_a, n_b) > 0 else (low, middle)
    return (low + high) / 2


def may_reach(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int = PERCENT, margin: float | None = MARGIN) -> np.ndarray:
    """Rows whose estimate isn't more than ``margin`` deviations below the threshold and whose sizes allow it; by sizes alone where it is None."""
    t = percent / 100
    fits = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    if margin is None:
        return fits
    low = max(0.01, t - margin * math.sqrt(t * (1 - t) / M))
    greater, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    return fits & (_slope(low, greater, less, M - greater - less, n_a.astype(float), n_b.astype(float)) >= 0)


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<u2").reshape(-1, M)


def sketch(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, key (a digest of the set, null if empty), regs of each row."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in arrow_slices(batches, "text"):
            sizes, keys, regs = [], [], []
            for t in texts:
                h = shingles(t)
                full = len(h) > 0
                sizes.append(len(h))
                keys.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if full else None)
                regs.append(registers(h).tobytes() if full else None)
            yield pa.record_batch([part["doc_id"], pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(regs, pa.binary())], names=["doc_id", "n", "key", "regs"])

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n long, key binary, regs binary")


def join_hot(rows: DataFrame, facts: DataFrame, key: str, count: str, how: str = "inner") -> DataFrame:
    """rows with the one row of facts that has their key; ``count`` is how many rows have it and isn't returned.

    Hot keys' facts are broadcast to their rows where they lie; the others meet in a shuffle.
    """
    hot = facts.where(F.col(count) > HOT).drop(count)
    cool = facts.where(F.col(count) <= HOT).drop(count)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cool, key, how)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def join_sets(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """pairs (a, b) with the sets of a and of b. A hub's set is copied once for each HOT of its pairs, which are dealt out to the copies."""
    both = pairs
    for key, other, sets in (("a", "b", left), ("b", "a", right)):
        hubs = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > HOT)  # of the pairs alone, before sets are joined to them
        hubs = F.broadcast(hubs.select(key, F.ceil(F.col("c") / HOT).cast("int").alias("parts")))
        parts = F.coalesce("parts", F.lit(1))
        dealt = both.join(hubs, key, "left").withColumn("part", F.pmod(F.hash(other), parts)).drop("parts")
        copies = sets.join(hubs, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
        both = dealt.join(copies, [key, "part"]).drop("part")
    return both


def of_nodes(rows: DataFrame, key: str, nodes: DataFrame) -> DataFrame:
    """The rows whose key is in nodes (key, each once); these are broadcast, unless they are too many."""
    nodes = materialize(nodes)
    few = nodes.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(nodes) if few else nodes, key, "left_semi")


def full_sets(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, hashes: the sets of the documents whose ids are in nodes (doc_id, each once); docs has doc_id and text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = of_nodes(docs, "doc_id", nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in arrow_slices(batches, "text"):
            sets = [shingles(t).view(np.int64) for t in own]
            ends = np.cumsum([0, *map(len, sets)])
            yield pa.record_batch([part["doc_id"], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))], names=["node", "hashes"])

    return materialize(texts.select("doc_id", "text").mapInArrow(run, f"node {kind}, hashes array<bigint>"))


def verify(pairs: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets meet the threshold. pairs is materialized; docs has doc_id and text."""
    sets = full_sets(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), docs)
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    both = join_sets(pairs.select("a", "b"), left, right)
    shared = F.size(F.array_intersect("x", "y"))
    both = both.select("a", "b", shared.alias("i"), (F.size("x") + F.size("y")).alias("s"))
    return both.where(100 * F.col("i") >= percent * (F.col("s") - F.col("i"))).select("a", "b")


def intersections(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of x with each of y, exactly: products of 0/1 matrices over COLUMNS hashes at a time."""
    out = np.zeros((len(x), len(y)), dtype=np.int64)
    common = np.intersect1d(np.concatenate(x), np.concatenate(y))
    if not len(common):
        return out
    sides = []
    for sets in (x, y):
        hashes, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(v) for v in sets])
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        found = np.flatnonzero(common[at] == hashes)
        found = found[np.argsort(at[found], kind="stable")]
        sides.append((at[found], row[found]))
    for start in range(0, len(common), COLUMNS):
        width = min(COLUMNS, len(common) - start)
        ones = []
        for (at, row), sets in zip(sides, (x, y), strict=True):
            own = slice(*np.searchsorted(at, [start, start + width]))
            ones.append(np.zeros((len(sets), width), dtype=np.float32))
            ones[-1][row[own], at[own] - start] = 1
        out += (ones[0] @ ones[1].T).astype(np.int64)
    return out


def components(links: DataFrame) -> DataFrame:
    """node, label: for each node of the links but the smallest of its component, that smallest one.

    Stars are rearranged until they stay: each node's greater neighbours move to its least neighbour, then each
    node and its lesser neighbours do.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen or not mark[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        seen = mark
        few = 2 * mark[0] <= HOT  # so no key can be hot, and a few tasks do
        gather = lambda rows: rows.coalesce(FEW_TASKS) if few else rows
        with_least = lambda rows, facts: rows.join(facts.drop("c"), "u") if few else join_hot(rows, facts, "u", "c")
        edges = gather(edges)
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c")).withColumn("m", F.least("u", "m"))
        large = with_least(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = gather(large.distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c"))
        moved = with_least(large, least).select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        edges = materialize(gather(moved.where("e.u <> e.m").select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).distinct()))


def _hashes(bands: int) -> Column:
    """The buckets of a sketch, one in each band."""
    width = 2 * ROWS
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, F.substr("regs", b * width + 1, F.lit(width))))


def star_pairs(classes: DataFrame, percent: int = PERCENT, margin: float | None = MARGIN) -> DataFrame:
    """Pairs of a member and its bucket's chosen members that may be linked, in the first bands.

    Copies differ from what they were made of in less than they do from each other, so the member whose buckets are the
    fullest stands for its bucket; one drawn by hash stands beside it.
    """
    rows = classes.select("node", F.explode(_hashes(FIRST_BANDS)).alias("bucket"))
    sizes = materialize(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    rows = materialize(join_hot(rows, sizes.withColumn("c", F.col("size")), "bucket", "c").select("bucket", "node", "size"))
    central = rows.groupBy("node").agg(F.sum("size").alias("weight"))
    drawn = F.pmod(F.xxhash64("node", "bucket"), F.lit(1 << 20))
    hubs = rows.join(central, "node").groupBy("bucket").agg(
        F.max_by("node", F.col("weight") * (1 << 20) + drawn).alias("full"), F.min_by("node", drawn).alias("drawn"), F.count(F.lit(1)).alias("c")
    )
    hubs = materialize(hubs.select("bucket", F.array_distinct(F.array("full", "drawn")).alias("hubs"), "c"))
    pairs = join_hot(rows, hubs, "bucket", "c").withColumn("hub", F.explode("hubs")).where("node <> hub")
    pairs = pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                take = may_reach(_matrix(x["ra"]), _matrix(x["rb"]), x["na"].to_numpy(), x["nb"].to_numpy(), percent, margin)
                yield x.loc[take, ["a", "b"]]

    kind = classes.schema["node"].dataType.simpleString()
    pairs = materialize(pairs)
    met = of_nodes(classes, "node", pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    left = met.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
    right = met.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))
    return join_sets(pairs, left, right).mapInPandas(run, f"a {kind}, b {kind}").distinct()


def rest_members(classes: DataFrame, labels: DataFrame, percent: int = PERCENT, bands: int = BANDS, margin: float | None = MARGIN) -> DataFrame:
    """block, node, comp, out: members of a bucket's blocks that may be linked with one of another component, in all bands.

    In a block those with ``out`` meet those without.
    """
    if ROWS * bands > M:
        raise ValueError(f"over {M // ROWS} bands")
    known = classes.select("node", "n", _hashes(bands).alias("buckets")).join(labels, "node", "left")  # without the registers, which few of them need
    known = materialize(known.select("node", F.coalesce("label", "node").alias("comp"), "n", "buckets"))
    rows = known.select("node", "comp", "n", F.posexplode("buckets").alias("band", "bucket"))
    parts = rows.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"))
    mixed = parts.groupBy("bucket").agg(F.max(F.struct("c", "comp", "w")).alias("most"), F.sum("c").alias("total"), F.sum("w").alias("weight"), F.count(F.lit(1)).alias("k"))
    # blocks' numbers, by members and by their shingles
    blocks = lambda c, w: F.ceil(F.greatest(c / BLOCK, w / (BLOCK * BLOCK_MEAN)))
    n_out, n_all = blocks(F.col("total") - F.col("most.c"), F.col("weight") - F.col("most.w")), blocks(F.col("total"), F.col("weight"))
    mixed = mixed.where("k > 1").select("bucket", F.col("most.comp").alias("main"), n_out.alias("n_out"), n_all.alias("n_all"), "total")
    own = join_hot(rows, materialize(mixed.withColumn("c", F.col("total"))), "bucket", "c")
    # those outside of a bucket's largest component, in blocks, meet all of it, in blocks
    n_out, n_all = F.col("n_out"), F.col("n_all")
    spread = F.pmod(F.xxhash64("node"), F.lit(1 << 40))
    outside = F.transform(F.sequence(F.lit(0).cast("long"), n_all - 1), lambda j: F.struct(F.lit(True).alias("out"), (spread % n_out).alias("i"), j.alias("j")))
    inside = F.transform(F.sequence(F.lit(0).cast("long"), n_out - 1), lambda i: F.struct(F.lit(False).alias("out"), i.alias("i"), (spread % n_all).alias("j")))
    roles = F.when(F.col("comp") != F.col("main"), F.concat(outside, inside)).otherwise(inside)
    own = own.select("band", "bucket", "node", "comp", "n", F.explode(roles).alias("r")).select("band", "bucket", "node", "comp", "n", "r.*")
    full = own.join(classes.select("node", "regs"), "node")
    full = full.withColumn("block", F.xxhash64("bucket", "i", "j"))
    full = full.repartition("block").sortWithinPartitions("block").select("block", "band", "node", "comp", "out", "n", "regs")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if not len(held):
                continue
            keys = held["block"].to_numpy()
            done = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0
            if done:
                yield from compare(held.iloc[:done])
                held = held.iloc[done:].reset_index(drop=True)
        if held is not None and len(held):
            yield from compare(held)

    def compare(x: pd.DataFrame) -> Iterator[pd.DataFrame]:
        keys, out = x["block"].to_numpy(), x["out"].to_numpy(dtype=bool)
        comp, n, band, regs = x["comp"].to_numpy(), x["n"].to_numpy(), x["band"].to_numpy(), _matrix(x["regs"])
        words = np.ascontiguousarray(regs[:, : ROWS * bands]).view("<u8").reshape(len(x), bands)
        begin = np.searchsorted(keys, keys[out], "left") if (np.diff(keys) >= 0).all() else None
        at = np.flatnonzero(out)
        if begin is None:
            raise ValueError("blocks aren't in order")
        size = np.searchsorted(keys, keys[out], "right") - begin
        used = np.zeros(len(x), dtype=bool)
        k = 0
        while k < len(at):
            upto = k + max(1, int(np.searchsorted(np.cumsum(size[k:]), CHUNK, "right")))
            s = size[k:upto]
            i = np.repeat(at[k:upto], s)
            j = np.repeat(begin[k:upto] - np.concatenate([[0], np.cumsum(s)[:-1]]), s) + np.arange(s.sum())
            k = upto
            keep = ~out[j] & (comp[i] != comp[j])
            i, j = i[keep], j[keep]
            first = (words[i] == words[j]).argmax(axis=1) == band[i]
            i, j = i[first], j[first]
            take = may_reach(regs[i], regs[j], n[i], n[j], percent, margin)
            used[i[take]] = used[j[take]] = True
        yield x.loc[used, ["block", "node", "comp", "out"]]

    kind = classes.schema["node"].dataType.simpleString()
    return full.mapInPandas(run, f"block long, node {kind}, comp {kind}, out boolean").distinct()


def rest_links(members: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between different components in the blocks of ``members``, which is materialized: one of each member outside with each component it is linked with."""
    sets = full_sets(members.select(F.col("node").alias("doc_id")).distinct(), docs)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(x: pa.Table) -> pa.Table:
        out, comp = x["out"].to_numpy(), pd.factorize(x["comp"].to_pandas())[0]
        hashes = x["hashes"].combine_chunks()
        values, ends = hashes.values.to_numpy(), hashes.offsets.to_numpy()
        left, right = np.flatnonzero(out), np.flatnonzero(~out)
        if not len(left) or not len(right):
            return x.select(["node", "node"]).slice(0, 0).rename_columns(["a", "b"])
        own = lambda at: [values[ends[k] : ends[k + 1]] for k in at]
        shared, size = intersections(own(left), own(right)), np.diff(ends)
        union = size[left][:, None] + size[right][None, :] - shared
        i, j = np.nonzero((100 * shared >= percent * union) & (comp[left][:, None] != comp[right][None, :]))
        _, first = np.unique(i * (comp.max() + 1) + comp[right][j], return_index=True)
        return pa.table([x["node"].take(left[i[first]]), x["node"].take(right[j[first]])], names=["a", "b"])

    return members.join(sets, "node").groupBy("block").applyInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = PERCENT, bands: int = BANDS, margin: float | None = MARGIN
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row. A lower ``percent`` needs more ``bands``."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    own = materialize(sketch(rows))
    known = own.where("n > 0 AND doc_id IS NOT NULL")
    classes = known.groupBy("key").agg(F.min(F.struct("doc_id", "n", "regs")).alias("x"), F.count(F.lit(1)).alias("rows"))
    classes = materialize(classes.select("key", F.col("x.doc_id").alias("node"), F.col("x.n").alias("n"), F.col("x.regs").alias("regs"), "rows"))
    pairs = materialize(star_pairs(classes, percent, margin))
    labels = components(verify(pairs, rows, percent))
    more = materialize(rest_members(classes, labels, percent, bands, margin))
    links = labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(rest_links(more, rows, percent))
    # an id whose rows have several sets links their classes
    several = known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    keys = join_hot(known.select("doc_id", "key"), several, "doc_id", "c").distinct()
    same_id = keys.join(classes.select("key", "node"), "key").where("doc_id <> node")
    links = links.union(same_id.select("doc_id", "node"))
    labels = components(links)
    named = classes.join(labels, "node", "left").select("key", F.coalesce("label", "node").alias("component_id"), "rows")
    out = join_hot(own.select("doc_id", "n", "key"), named, "key", "rows", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = out.withColumn("component_id", component)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op7_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def _oracle() -> str:
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < {WIDTH} THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + {WIDTH - 1}], ' ') END AS sh
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - {WIDTH - 2}))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= {PERCENT} * (x.n + y.n - i)),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.c),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)"""


QUERIES = {"op7_setsketch": op7_setsketch}
ORACLES = {"op7_setsketch": _oracle()}
