"""Leakage groups of questions and their split."""

from __future__ import annotations

from fractions import Fraction
from math import gcd, inf

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.lineage import cut, join_hot
from plumbline.operators.ranking import place_by_hash

#: Total up to which a split is filled by an exact search; sizes of groups at most.
EXACT, MAX_SIZES = 1_000_000, 10_000
#: Questions of a split that are chosen by an exact search over sizes and kinds together; bitsets of its square are held.
REST = 1000
#: Sums that a search of groups keeps at first; eight times as many as often as it takes to be sure of the best.
BEAM = 4096


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of each component of the undirected edges (a, b), lone nodes as (a, a).

    Stars are rearranged until they stay: each node's greater neighbours move to its least neighbour, then each node and its lesser
    ones do. Each round ends in a checkpoint, so plans stay short and a lost executor costs one round; hot nodes' rows stay where they are.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    nodes = cut(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct())
    stars, seen = cut(pairs.where("u <> v").distinct()), None
    while True:
        mark = stars.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen or not mark[0]:
            return nodes.join(stars.select(F.col("u").alias("node"), "v"), "node", "left").select("node", F.coalesce("v", "node").alias("label"))
        seen = mark
        both = stars.union(stars.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c")).withColumn("m", F.least("u", "m"))
        large = join_hot(both, least, "u", "c").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c"))
        moved = join_hot(large, least, "u", "c").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        stars = cut(moved.where("e.u <> e.m").select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).distinct())


def choose_sizes(histogram: dict[int, int], want: int) -> dict[int, int]:
    """How many groups of each size to take, of so many, for a total of ``want``, or of the most below it that can be reached.

    An exact search over reachable sums where ``want`` is at most EXACT; beyond it the largest that still fit are taken first.
    """
    if want > EXACT:
        out = {}
        for size in sorted(histogram, reverse=True):
            out[size] = min(histogram[size], want // size)
            want -= size * out[size]
        return out
    items = []
    for size in sorted(histogram, reverse=True):
        left, k = min(histogram[size], want // size), 1
        while left:
            items.append((size, min(k, left)))
            left, k = left - min(k, left), 2 * k
    mask, reach = (1 << (want + 1)) - 1, [1]
    for size, k in items:
        reach.append((reach[-1] | reach[-1] << size * k) & mask)
    total, out = reach[-1].bit_length() - 1, {}
    for (size, k), before in zip(reversed(items), reversed(reach[:-1]), strict=True):
        if not before >> total & 1:
            out[size] = out.get(size, 0) + k
            total -= size * k
    return out


def allocate(groups: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """group_id, split: whole groups (group_id, size, h) for each split in turn, filling its size exactly if any choice of groups does.

    The choice is made on the histogram of sizes, which has at most the square root of twice the questions' number of rows; of
    a size, groups go to the splits in the order of their hash.
    """
    left = {r["size"]: r["n"] for r in groups.groupBy("size").agg(F.count(F.lit(1)).alias("n")).limit(MAX_SIZES + 1).collect()}
    if len(left) > MAX_SIZES:
        raise ValueError(f"groups have over {MAX_SIZES} sizes")
    taken = dict.fromkeys(left, 0)
    spans = []
    for split, want in sizes.items():
        for size, n in choose_sizes(left, want).items():
            spans += [(size, split, taken[size], taken[size] + n)] if n else []
            taken[size] += n
            left[size] -= n
    known = groups.sparkSession.createDataFrame(spans, "size long, split string, first long, last long")
    placed = place_by_hash(groups.withColumn("size", F.col("size").cast("long")), "h", "size")
    within = (placed["size"] == known["size"]) & (F.col("place") > F.col("first")) & (F.col("place") <= F.col("last"))
    return placed.join(F.broadcast(known), within, "left").select("group_id", F.coalesce("split", F.lit("unselected")).alias("split"))


def reachable(items: list[tuple[int, int, int]], cap: int) -> list[int]:
    """Bitsets of the (size, bridge) sums that the items so far reach, up to size ``cap``: bit size * (cap + 1) + bridge."""
    width = cap + 1
    mask, states = (1 << width * width) - 1, [1]
    for size, bridge, k in items:
        states.append((states[-1] | states[-1] << k * (size * width + bridge)) & mask)
    return states


def chunks(histogram: dict[tuple[int, int], int], cap: int) -> list[tuple[int, int, int]]:
    """(size, bridge, k): stacks of 1, 2, 4, ... groups of a class, whose sums are all counts that fit under ``cap``."""
    items = []
    for size, bridge in sorted(histogram, reverse=True):
        left, k = min(histogram[size, bridge], cap // size), 1
        while left:
            items.append((size, bridge, min(k, left)))
            left, k = left - min(k, left), 2 * k
    return items


def choose_groups(histogram: dict[tuple[int, int], int], want: int, bridge: int, rest: int = REST) -> dict[tuple[int, int], int]:
    """How many groups of each class (size, bridge questions) to take: the size nearest to ``want``, then the number of bridge
    questions nearest to ``bridge``, then under rather than over; at least one group if there is any.

    The last ``rest`` questions, or all if they aren't more, are chosen exactly among all reachable sums; where none is of the size
    itself, sums as far above it as the nearest one lies below are searched too. Before that each class gives its share, and what
    rounding leaves is taken from the largest groups downward. If more than three times ``rest`` is still missing then, each group that is left
    is larger than what is missing less ``rest``, so two of them are never nearer than one or none, and these alone are compared.
    """
    pool = {c: n for c, n in histogram.items() if n and c[0] > 0}
    out: dict[tuple[int, int], int] = {}
    total = sum(c[0] * n for c, n in pool.items())
    share = min(1, Fraction(max(0, want - rest), total)) if total else 0
    for c, n in pool.items():
        if k := int(n * share):
            out[c], want, bridge = k, want - k * c[0], bridge - k * c[1]
    pool = {c: n - out.get(c, 0) for c, n in pool.items()}
    for c in sorted(pool, key=lambda c: (-c[0], abs(c[1] * want - bridge * c[0]), c[1])):
        n = min(pool[c], max(0, want - rest) // c[0])
        if n:
            out[c] = out.get(c, 0) + n
            pool[c] -= n
            want, bridge = want - n * c[0], bridge - n * c[1]
    pool = {c: n for c, n in pool.items() if n}
    if not pool or (out and want <= 0):
        return out
    if want > 3 * rest:
        size, got = min([*pool, *([(0, 0)] if out else [])], key=lambda c: (abs(c[0] - want), abs(c[1] - bridge), c[0] > want, c[1], c[0]))
        if size:
            out[size, got] = out.get((size, got), 0) + 1
        return out
    cap = want
    states = reachable(items := chunks(pool, cap), cap)
    if not states[-1] >> want * (cap + 1):
        under = max((states[-1].bit_length() - 1) // (cap + 1), 0)
        cap = 2 * want - under if under or out else min(size for size, _ in pool)
        states = reachable(items := chunks(pool, cap), cap)
    size, got = nearest(states[-1], cap, want, bridge, nonempty=not out)
    for (s, b, k), before in zip(reversed(items), reversed(states[:-1]), strict=True):
        if not before >> (size * (cap + 1) + got) & 1:
            out[s, b] = out.get((s, b), 0) + k
            size, got = size - k * s, got - k * b
    return out


def nearest(states: int, cap: int, want: int, bridge: int, nonempty: bool) -> tuple[int, int]:
    """The reachable (size, bridge) that comes nearest."""
    width = cap + 1
    for off in range(max(want, cap - want) + 1):
        found = []
        for size in {want - off, want + off}:
            row = states >> size * width & (1 << width) - 1 if nonempty <= size <= cap else 0
            if row:
                at = min(max(bridge, 0), cap)
                low, high = (row & (2 << at) - 1).bit_length() - 1, row >> at
                below = [low] if low >= 0 else []
                above = [at + (high & -high).bit_length() - 1] if high else []
                found += [(abs(b - bridge), size > want, b, size) for b in below + above]
        if found:
            return min(found)[3], min(found)[2]
    return 0, 0


def nearest_sizes(pool: dict[tuple[int, int], int], want: int) -> list[int]:
    """The sizes, one or two, nearest to ``want`` that some groups add up to, of all that there are."""
    least = min(size for size, _ in pool)
    if least >= want:
        return [least]
    cap = min(2 * want, sum(c[0] * n for c, n in pool.items()))
    counts: dict[int, int] = {}
    for (size, _), n in pool.items():
        counts[size] = counts.get(size, 0) + n
    mask, sums = (1 << (cap + 1)) - 1, 1
    for size, _, k in chunks({(size, 0): n for size, n in counts.items()}, cap):
        sums = (sums | sums << size * k) & mask
    under, above = (sums & (1 << (want + 1)) - 1).bit_length() - 1, sums >> want
    over = want + (above & -above).bit_length() - 1 if above else inf
    off = min(want - under, over - want)
    return sorted({t for t in (under, over) if abs(t - want) == off})


def least_off(pool: dict[tuple[int, int], int], size: int, bridge: int) -> int:
    """A number of bridge questions that no choice of ``size`` comes nearer to ``bridge`` than.

    What classes add up to lies in the lattice that they span, and between what the classes with the lowest and the highest shares give.
    """
    p, q, g = 0, 0, 0
    for s, b in pool:
        while s:
            p, q, s, b = s, b, p - p // s * s, q - p // s * b
        g = gcd(g, abs(b))
    ends = []
    for sign in (1, -1):
        left, total = size, Fraction(0)
        for (s, b), n in sorted(pool.items(), key=lambda x: sign * Fraction(x[0][1], x[0][0])):
            part = min(Fraction(left, s), n)
            left, total = left - part * s, total + part * b
            if not left:
                break
        ends.append(total)
    low, high = -(-ends[0] // 1), ends[1] // 1
    at, first = min(max(bridge, low), high), size // p * q
    if not g:
        return abs(first - bridge)
    below = at - (at - first) % g
    return min((abs(b - bridge) for b in (below, below + g) if low <= b <= high), default=0)


def search(pool: dict[tuple[int, int], int], size: int, bridge: int, below: float, beam: int) -> tuple[int | None, dict[tuple[int, int], int], bool]:
    """off, choice, whole: groups of ``size`` in all with their bridge questions ``off`` from ``bridge``, the nearest and nearer than ``below``, if there are any.

    All sums of the smallest groups are built, four times ``beam`` at most, and sums of the others from the largest downward; then the two are matched.
    A sum goes on only if those that follow can still fill it and bring it nearer. Where more than ``beam`` would, those go on that leave the
    most room to both sides, and the search isn't whole.
    """
    items = chunks(pool, size)
    weight, kind = (np.array([x[j] * x[2] for x in items], dtype=np.int64) for j in (0, 1))
    order, width = np.argsort(kind / weight, kind="stable"), int(kind.sum()) + 1
    codes = [int(w) * width + int(b) for w, b in zip(weight, kind, strict=True)]
    start, tails = len(items), {len(items): np.zeros(1, dtype=np.int64)}
    while start and len(tails[start]) <= 4 * beam:
        more = np.union1d(tails[start], tails[start] + codes[start - 1])
        start -= 1
        tails[start] = more[more // width <= size]
    left, sums, levels, whole = np.ones(len(items), dtype=bool), np.zeros(1, dtype=np.int64), [], True
    for i in range(start):
        left[i] = False
        levels.append(sums)
        rest = order[left[order]]
        rising, falling = ([np.concatenate(([0], np.cumsum(x[r]))) for x in (weight, kind)] for r in (rest, rest[::-1]))
        sums = np.union1d(sums, sums + codes[i])
        need, own = size - sums // width, sums % width
        low, high = own + np.interp(need, *rising), own + np.interp(need, *falling)
        fits = (need >= 0) & (need <= rising[0][-1]) & (low - bridge <= below - 1 + 1e-6) & (bridge - high <= below - 1 + 1e-6)
        sums, need, low, high = sums[fits], need[fits], low[fits], high[fits]
        if len(sums) > beam:
            whole = False
            room = abs(need / rising[0][-1] - 0.5) + abs(np.divide(bridge - low, high - low, out=np.full(len(low), 0.5), where=high - low > 1e-6) - 0.5)
            sums = np.sort(sums[np.argpartition(room, beam)[:beam]])
    best, tail = None, tails[start]
    need, own = size - sums // width, sums % width
    at = np.searchsorted(tail, need * width + np.clip(bridge - own, 0, width - 1))
    for place in (at - 1, at):
        place = np.clip(place, 0, len(tail) - 1)
        off = np.where(tail[place] // width == need, abs(own + tail[place] % width - bridge), width + abs(bridge))
        if len(off) and (k := int(np.argmin(off))) >= 0 and off[k] < min(below, width + abs(bridge)):
            below, best = int(off[k]), (int(sums[k]), int(tail[place[k]]))
    if best is None:
        return None, {}, whole
    held = lambda xs, x: (k := np.searchsorted(xs, x)) < len(xs) and xs[k] == x
    upper, lower = best
    taken = []
    for i in range(start - 1, -1, -1):
        if not held(levels[i], upper):
            taken.append(i)
            upper -= codes[i]
    for i in range(start, len(items)):
        if not held(tails[i + 1], lower):
            taken.append(i)
            lower -= codes[i]
    chosen: dict[tuple[int, int], int] = {}
    for s, b, k in (items[i] for i in taken):
        chosen[s, b] = chosen.get((s, b), 0) + k
    return below, chosen, whole


def best_groups(histogram: dict[tuple[int, int], int], want: int, bridge: int, beam: int = BEAM) -> dict[tuple[int, int], int]:
    """How many groups of each class (size, bridge questions) to take: the best of all choices at every size of the input, in the order of ``choose_groups``.

    The size comes from all reachable sums. A choice is final once it is as near as sums can be at all, or once the search left nothing out; the shares of
    ``choose_groups`` are the first to be tried, and then a search that keeps ever more sums.
    """
    pool = {c: n for c, n in histogram.items() if n and c[0] > 0}
    if not pool:
        return {}
    least = {size: least_off(pool, size, bridge) for size in nearest_sizes(pool, want)}
    aim = min((off, size > want) for size, off in least.items())
    found: dict[int, tuple[float, dict[tuple[int, int], int]]] = dict.fromkeys(least, (inf, {}))
    first = choose_groups(pool, want, bridge)
    size, got = (sum(c[k] * n for c, n in first.items()) for k in (0, 1))
    if size in found:
        found[size] = (abs(got - bridge), first)
    while True:
        off, over, size = min((found[size][0], size > want, size) for size in found)
        if (off, over) == aim:
            return found[size][1]
        searched = True
        for size in found:
            nearer, chosen, whole = search(pool, size, bridge, found[size][0], beam)
            found[size] = found[size] if nearer is None else (nearer, chosen)
            searched = searched and (whole or nearer == least[size])
        if searched:
            return min((off, size > want, size, chosen) for size, (off, chosen) in found.items())[3]
        beam *= 8


def allocate_balanced(groups: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """group_id, split: whole groups (group_id, size, bridge, h) for each split in turn, nearest to its size and then to the pool's share of bridge questions.

    The choice is made on the histogram of (size, bridge), of at most MAX_SIZES rows, and is the best of all; of a class, groups go to the splits
    in the order of their hash. An empty table gives an empty one, and what no split takes is ``unselected``.
    """
    counted = groups.groupBy("size", "bridge").agg(F.count(F.lit(1)).alias("n")).limit(MAX_SIZES + 1).collect()
    if len(counted) > MAX_SIZES:
        raise ValueError(f"groups have over {MAX_SIZES} sizes")
    if any(want <= 0 for want in sizes.values()):
        raise ValueError("sizes of splits must be positive")
    if any(not 0 <= r["bridge"] <= r["size"] for r in counted):
        raise ValueError("a group has more bridge questions than questions")
    left = {(r["size"], r["bridge"]): r["n"] for r in counted}
    questions, bridges = (sum(c[k] * n for c, n in left.items()) for k in (0, 1))
    taken = dict.fromkeys(left, 0)
    spans = []
    for split, want in sizes.items():
        for c, n in best_groups(left, want, round(Fraction(want * bridges, questions)) if questions else 0).items():
            spans.append((f"{c[0]}:{c[1]}", split, taken[c], taken[c] + n))
            taken[c] += n
            left[c] -= n
    known = groups.sparkSession.createDataFrame(spans, "class string, split string, first long, last long")
    placed = place_by_hash(groups.withColumn("class", F.concat_ws(":", "size", "bridge")), "h", "class")
    within = (placed["class"] == known["class"]) & (F.col("place") > F.col("first")) & (F.col("place") <= F.col("last"))
    return placed.join(F.broadcast(known), within, "left").select("group_id", F.coalesce("split", F.lit("unselected")).alias("split"))
