"""Operator 5: pack tokenised documents into sequences by bin completion."""

from __future__ import annotations

import base64
import math
import random
import zlib
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import gapless_rank, materialize

#: Pieces are ranked in buckets of one length that hold at most about this share of all pieces.
BUCKETS = 4096


@lru_cache(2)
def _encoder(json_path: str, ranks_path: str | None, pattern: str | None):
    """text -> ids as by tokenizers and json_path. With the same vocabulary as a rank file, tiktoken makes the same ids
    several times faster; texts that hold a special token's string go through tokenizers all the same."""
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path)
    plain = lambda t: np.array(slow.encode(t, add_special_tokens=False).ids, np.uint32)
    if ranks_path is None:
        return plain
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    special = [x.content for x in slow.get_added_tokens_decoder().values()]

    def encode(t: str) -> np.ndarray:
        if any(s in t for s in special):
            return plain(t)
        return fast.encode_to_numpy(t, allowed_special=set(), disallowed_special=())

    return encode


def piece_lengths(n: int, capacity: int) -> list[int]:
    """A document of n tokens is cut into pieces of `capacity`, the first of which may be shorter."""
    first = n % capacity
    return ([first] if first else []) + [capacity] * (n // capacity)


def pieces(docs: DataFrame, key: str, text: str, capacity: int, end: int, json_path: str, ranks_path: str | None, pattern: str | None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""

    def run(batches):
        encode = _encoder(json_path, ranks_path, pattern)
        for b in batches:
            rows: list[tuple] = []
            for i, t in enumerate(b.column(1).to_pylist()):
                ids = np.append(encode(t or ""), np.uint32(end)).astype("<u4")
                start = 0
                for k, n in enumerate(piece_lengths(len(ids), capacity)):
                    rows.append((i, k, start, n, zlib.crc32(ids[start : start + n].tobytes())))
                    start += n
            at, k, s, n, crc = (np.array(x, np.int64) for x in zip(*rows)) if rows else [np.zeros(0, np.int64)] * 5
            key_of = b.column(0).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([key_of, pa.array(k.astype(np.int32)), *map(pa.array, (s, n, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[key].dataType.simpleString()
    cols = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return cols.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs (Martello and Toth's L2): for each k, pieces over capacity - k stand alone, pieces
    over half of it have a bin each, and what pieces of k to half can't find room for there needs further bins."""
    best = 0
    for k in range(capacity // 2 + 1):
        alone = sum(c for s, c in counts.items() if s > capacity - k)
        large = [(s, c) for s, c in counts.items() if capacity // 2 < s <= capacity - k]
        room = sum(c * (capacity - s) for s, c in large)
        rest = sum(c * s for s, c in counts.items() if k <= s <= capacity // 2)
        best = max(best, alone + sum(c for _, c in large) + max(0, math.ceil((rest - room) / capacity)))
    return best


#: Fillings of a node that are tried first, and groups of bins that are packed again at most.
FIRST_FILLINGS, TURNS = 40, 24


def _reach(sizes: list[int], counts: dict[int, int], room: int) -> list[int]:
    """For each i the sums up to room that pieces of sizes[i:] can make, as the bits of a number."""
    out = [1] * (len(sizes) + 1)
    mask = (1 << (room + 1)) - 1
    for i in range(len(sizes) - 1, -1, -1):
        sums, n, step = out[i + 1], min(counts[sizes[i]], room // sizes[i]), 1
        while n > 0:
            take = min(step, n)
            sums |= (sums << (take * sizes[i])) & mask
            n -= take
            step *= 2
        out[i] = sums
    return out


def fillings(room: int, counts: dict[int, int], slack: int, most: int | None = None, left: list[int] | None = None):
    """The undominated fillings of `room`, as lists of sizes, that waste at most `slack`; least waste first, and of equal waste
    the largest pieces first. Given `most`, only so many, found among the first 4 * most of each waste. left: a budget that each
    filling takes one of, dominated or not; without any left there are no more.

    A filling is dominated if an unused piece fits into what it leaves free, or could take the place of one of its
    smaller pieces. What sums the smaller sizes can still make is known at each step, so no step is in vain.
    """
    sizes = sorted((s for s, c in counts.items() if c and s <= room), reverse=True)
    reach = _reach(sizes, counts, room)

    def exactly(i: int, total: int):
        if not total:
            yield []
            return
        for j in range(i, len(sizes)):
            if not reach[j] >> total & 1:
                return
            s = sizes[j]
            for k in range(min(counts[s], total // s), 0, -1):
                if reach[j + 1] >> (total - k * s) & 1:
                    for rest in exactly(j + 1, total - k * s):
                        yield [s] * k + rest

    def undominated(chosen: list[int], free: int) -> bool:
        if not free:
            return True
        spare = [s for s in sizes if counts[s] > chosen.count(s)]
        return not any(s <= free or any(a < s <= a + free for a in chosen) for s in spare)

    for waste in range(min(slack, room) + 1):
        if not reach[0] >> (room - waste) & 1:
            continue
        for x in islice(exactly(0, room - waste), None if most is None else 4 * most):
            if left is not None:
                left[0] -= 1
                if left[0] < 0:
                    return
            if undominated(x, waste):
                yield x
                if most is not None:
                    most -= 1
                    if not most:
                        return


def plain_filling(room: int, counts: dict[int, int]) -> list[int]:
    """Of the fillings of least waste one whose smallest piece is largest: small pieces, which fit in anywhere, are left
    for later. Least waste means that no other filling dominates it."""
    sizes = sorted((s for s, c in counts.items() if c and s <= room), reverse=True)
    mask = (1 << (room + 1)) - 1
    down = [1]  # sums that the i largest sizes can make
    for s in sizes:
        sums, n, step = down[-1], min(counts[s], room // s), 1
        while n > 0:
            take = min(step, n)
            sums |= (sums << (take * s)) & mask
            n -= take
            step *= 2
        down.append(sums)
        if sums >> room & 1:
            break
    total, out = down[-1].bit_length() - 1, []
    i = len(down) - 1
    while total:
        while down[i - 1] >> total & 1:
            i -= 1
        s = sizes[i - 1]
        k = next(k for k in range(1, total // s + 1) if down[i - 1] >> (total - k * s) & 1)
        out += [s] * k
        total -= k * s
        i -= 1
    return out


def _best_fit(items: list[int], capacity: int) -> list[list[int]]:
    bins: list[list[int]] = []
    free: list[int] = []
    for s in sorted(items, reverse=True):
        fits = [i for i, f in enumerate(free) if f >= s]
        if fits:
            i = min(fits, key=free.__getitem__)
            bins[i].append(s)
            free[i] -= s
        else:
            bins.append([s])
            free.append(capacity - s)
    return bins


def complete_bins(items: list[int], capacity: int, nodes: int = 20_000, best: list[list[int]] | None = None) -> tuple[list[list[int]], bool]:
    """Branch and bound over a list of pieces: (bins, whether they are proven fewest). The incumbent is the best-fit packing, or
    `best`; each node fills a bin around the largest piece left, tries its undominated fillings, and is pruned once the waste so
    far exceeds what a packing of one bin fewer than the incumbent may waste.

    Fewer bins are looked for twice: among the first few fillings of each node, which reaches far apart packings soon, and then
    among all of them. The bins are proven fewest if they meet the lower bound, or if the second search ends before `nodes`
    fillings are used up.
    """
    fit = _best_fit(items, capacity)
    best = fit if best is None or len(fit) < len(best) else best
    counts: dict[int, int] = {}
    for s in items:
        counts[s] = counts.get(s, 0) + 1
    least = lower_bound(counts, capacity) if items else 0
    left = [nodes]

    def search(open_bins: list[list[int]], slack: int, few: int | None) -> bool:
        left[0] -= 1
        top = max((s for s, c in counts.items() if c), default=0)
        if not top:
            return True
        if left[0] < 0:
            return False
        counts[top] -= 1
        for more in fillings(capacity - top, counts, slack, few, left):
            for s in more:
                counts[s] -= 1
            open_bins.append([top, *more])
            if search(open_bins, slack - (capacity - top - sum(more)), few):
                return True
            open_bins.pop()
            for s in more:
                counts[s] += 1
        counts[top] += 1
        return False

    for few in (FIRST_FILLINGS, None):
        left[0] = nodes
        while len(best) > least:
            found: list[list[int]] = []
            for s in counts:
                counts[s] = 0
            for s in items:
                counts[s] += 1
            if not search(found, (len(best) - 1) * capacity - sum(items), few):
                break
            best = found
    return best, len(best) <= least or left[0] > 0


def _greedy(counts: dict[int, int], capacity: int, filling) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns that pack the counts: a filling around the largest piece, as many times as the counts allow. Each pattern
    nearly uses up a size, so there are few however many pieces."""
    left = {s: c for s, c in counts.items() if c}
    out: list[tuple[int, tuple[int, ...]]] = []
    while left:
        top = max(left)
        left[top] -= 1
        one = (top, *filling(capacity - top, left))
        left[top] += 1
        need = {s: one.count(s) for s in set(one)}
        times = min(left[s] // n for s, n in need.items())
        out.append((times, tuple(sorted(one, reverse=True))))
        for s, n in need.items():
            left[s] -= times * n
            if not left[s]:
                del left[s]
    return out


def _best_fit_patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """_best_fit() of the whole histogram, bins of equal content being handled together."""
    free: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            f = min((f for f, bins in free.items() if f >= s and bins), default=0)
            if f:
                have, one = free[f].pop()
                t = min(have, n)
                if have > t:
                    free[f].append((have - t, one))
            else:
                t, one, f = max(1, n // (capacity // s)), (), capacity
            k = 1 if one else min(n, capacity // s)
            free.setdefault(f - k * s, []).append((t, (*one, *[s] * k)))
            n -= t * k
    return [p for bins in free.values() for p in bins]


def _bins(patterns: list[tuple[int, tuple[int, ...]]]) -> int:
    return sum(t for t, _ in patterns)


def _take(patterns, most: int, wanted) -> tuple[list, list]:
    """(kept, taken): up to `most` bins of the patterns for which `wanted` gives a number, that many at most of each."""
    kept, taken = [], []
    for times, one in patterns:
        n = min(times, most, wanted(times, one))
        most -= n
        kept += [(times - n, one)] if n < times else []
        taken += [(n, one)] if n else []
    return kept, taken


def plan_packing(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(times, sizes) patterns that pack counts[size] pieces of each size: bin completion over the histogram.

    Bins around pieces of over half the capacity take the undominated filling of largest pieces, others the one whose
    smallest piece is largest; if that misses the lower bound, the second rule throughout and best fit are tried too, and the
    fewest bins are kept. Then, as long as the bound isn't met, TURNS groups of bins are opened again, most waste first and later by chance,
    and packed by branch and bound. Only a packing that meets the bound is known to be the best one.
    """
    least = lower_bound(counts, capacity)
    large = lambda room, left: next(fillings(room, left, room, 1))
    half = lambda room, left: (large if 2 * room < capacity else plain_filling)(room, left)
    patterns: list[tuple[int, tuple[int, ...]]] = _greedy(counts, capacity, half)
    for other in (lambda: _best_fit_patterns(counts, capacity), lambda: _greedy(counts, capacity, plain_filling)):
        if _bins(patterns) > least:
            patterns = min(patterns, other(), key=_bins)
    rng = random.Random(5)
    for turn in range(TURNS):
        if _bins(patterns) <= least:
            break
        pieces, many = [0], (24, 60, 150)[turn % 3]

        def wanted(times: int, one: tuple[int, ...], many=many, pieces=pieces) -> int:
            n = min(times, max(0, many - pieces[0]) // len(one))
            if turn > 2:
                n = min(n, 1 + many // 30)  # bins of many patterns
            pieces[0] += n * len(one)
            return n

        # at first the most wasteful bins, then these beside others by chance, whose pieces they may be exchanged with
        wasted = {one: capacity - sum(one) for _, one in patterns}
        order = sorted(patterns, key=lambda x: -wasted[x[1]] if turn < 3 else -rng.random() * (1 + wasted[x[1]]))
        kept, opened = _take(order, len(counts) + many, wanted)
        bins = [list(one) for t, one in opened for _ in range(t)]
        again, _ = complete_bins([s for x in bins for s in x], capacity, best=bins)
        if len(again) < len(bins):
            patterns = kept + [(1, tuple(sorted(x, reverse=True))) for x in again]
    return patterns


def _places(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(size, lo, hi, each, base, offset): pieces of a size with ranks lo..hi-1 go, `each` to a bin, into the bins from
    base on, the first at the offset."""
    rows, used, base = [], {}, 0
    for times, sizes in patterns:
        offset = 0
        for s in sorted(set(sizes), reverse=True):
            each, lo = sizes.count(s), used.get(s, 0)
            used[s] = lo + times * each
            rows.append((s, lo, used[s], each, base, offset))
            offset += each * s
        base += times
    return rows


def pack(
    docs: DataFrame,
    json_path: str,
    ranks_path: str | None = None,
    pattern: str | None = None,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = 1024,
    end: int = 2,
) -> DataFrame:
    """Pack all documents into as few sequences of at most `capacity` tokens as bin completion finds.

    Returns one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is
    the end token alone. Pieces of full length are sequences of their own, with negative ids. Repeated rows and null
    keys are packed like any others; an empty table gives no rows.

    Only the histogram of lengths (capacity - 1 numbers) goes to the driver, and the plan that comes back has a few
    rows for each length; pieces find their places by their length and their rank among pieces of that length, which is
    counted in buckets. json_path, ranks_path: tokenizer files that every executor has.
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, key, text, capacity, end, json_path, ranks_path, pattern))
    whole = cut.where(F.col("length") == capacity)
    whole = whole.withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    counts = {r[0]: r[1] for r in cut.where(F.col("length") < capacity).groupBy("length").count().collect()}
    if not counts:
        return whole
    total = sum(counts.values())
    per_length = F.array(*[F.lit(1 + BUCKETS * counts.get(s, 0) // total) for s in range(1, capacity)])
    ranked = gapless_rank(
        cut.where(F.col("length") < capacity), ["length"], ["doc_id", "piece", "start", "ids_crc32"], "rank",
        buckets=F.element_at(per_length, F.col("length").cast("int")),
    )
    names = "size long, lo long, hi long, each long, base long, first long"
    places = spark.createDataFrame(_places(plan_packing(counts, capacity)), names)
    here = (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    put = ranked.join(F.broadcast(places), here)  # the plan has under a few thousand rows whatever the input
    n = F.col("rank") - F.col("lo")
    rest = put.select(
        *cut.columns,
        (F.col("base") + F.floor(n / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("first") + F.pmod(n, F.col("each")) * F.col("length")).alias("offset"),
    )
    return whole.unionByName(rest)
