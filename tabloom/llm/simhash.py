"""Operator 10: SimHash near-duplicates, linked by a self-join of binary tries."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import hot_join, materialize, shuffle_partitions, text_or_empty, text_slices
from tabloom.llm.components import components

#: Node pairs whose ranges make at most so many combinations are compared outright instead of being split further.
LEAF = 32
#: Node pairs or combinations that are handled at a time, which bounds a task's memory.
CHUNK = 200_000
#: Runs of more fingerprints than this that agree in their first block of bits are dealt anew by a second one.
HOT_RUN = 50_000
#: Runs of near-copy tries that hold more shingles than this (8 bytes each) are dealt in cells.
HOT_SHINGLES = 4_000_000
#: Keys to drop are broadcast if they are no more than this (16 bytes each); beyond, Spark shuffles both sides.
BROADCAST_KEYS = 1_000_000
#: Shingles that are hashed for the sketches at a time.
SKETCHED = 1 << 12


def text_words(text: str | bytes | None) -> list[bytes]:
    """Words of the text's UTF-8 with A-Z lower-cased; white space is x20 and x09 to x0d alone."""
    raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    return raw.lower().split()  # of bytes: ASCII only


def _shingled(w: list[bytes], words: int) -> tuple[Iterable[bytes], int]:
    """The shingles of `words` words, repeats included, and their number; of fewer words, all of them are one."""
    if words == 1 or not w:
        return w, len(w)
    if len(w) < words:
        return [b" ".join(w)], 1
    return map(b" ".join, zip(*(w[i:] for i in range(words)))), len(w) - words + 1


def _majority(h: np.ndarray, at_once: int = 1 << 16) -> int:
    """The 64 bits that are set in over half the hashes."""
    count = np.zeros(64, np.int64)
    for i in range(0, len(h), at_once):
        part = h[i : i + at_once].view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(h), bitorder="little").view(np.uint64)[0])


def word_fingerprint(w: list[bytes], words: int) -> int:
    """64-bit SimHash over the XXH64 (seed 42) of shingles of `words` words; of no words zero."""
    if not w:
        return 0
    each, n = _shingled(w, words)
    digest = xxhash.xxh64_intdigest
    return _majority(np.fromiter((digest(s, 42) for s in each), np.uint64, n))


def fingerprint(text: str | None, words: int = 3) -> int:
    return word_fingerprint(text_words(text), words)


def fingerprints(docs: DataFrame, key: str, text: str, words: int, other: int | None) -> DataFrame:
    """(k, fp, other): the fingerprints of shingles of `words` and of `other` words (None: zero) as signed longs."""

    def run(batches):
        for b in batches:
            fps, more = np.zeros((2, b.num_rows), np.uint64)
            for start, texts in text_slices(b.column(1)):
                for i, w in enumerate(map(text_words, texts), start):
                    fps[i] = word_fingerprint(w, words)
                    more[i] = word_fingerprint(w, other) if other else 0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), pa.array(more.view(np.int64))], ["k", "fp", "other"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, fp bigint, other bigint")


def _split(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
    """For nodes lo:hi that agree in `depth` bits: where their upper child starts (hi: there is none)."""
    s, one = np.uint64(63 - depth), np.uint64(1)
    lo, hi = lo.copy(), hi.copy()
    open_ = np.flatnonzero(lo < hi)
    while len(open_):
        mid = (lo[open_] + hi[open_]) // 2
        upper = (values[mid] >> s) & one == one
        hi[open_[upper]] = mid[upper]
        lo[open_[~upper]] = mid[~upper] + 1
        open_ = open_[lo[open_] < hi[open_]]
    return lo


def _compared(values, alo, ahi, blo, bhi, budget, more):
    """All links between the members of paired ranges (i < j)."""
    na, nb = ahi - alo, bhi - blo
    size = na * nb
    ends = np.cumsum(size)
    start = 0
    while start < len(size):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CHUNK, "right")))
        cut = slice(start, stop)
        pair = np.repeat(np.arange(start, stop), size[cut])
        within = np.arange(len(pair)) - np.repeat(np.cumsum(size[cut]) - size[cut], size[cut])
        i, j = alo[pair] + within // nb[pair], blo[pair] + within % nb[pair]
        good = (i < j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
        i, j = i[good], j[good]
        if more is not None:
            good = np.bitwise_count(more[0][i] ^ more[0][j]) <= more[1]
            i, j = i[good], j[good]
        yield i, j
        start = stop


def trie_links(
    values: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int, budget: int = 3, more: tuple[np.ndarray, int] | None = None, label: np.ndarray | None = None
):
    """Chunks (i, j) of all links within each run values[start:end], i < j; given labels, of those between different ones.

    values: sorted within each run; the members of a run agree in their first `depth` bits, so a run is a node of the binary
    trie over its values. Pairs of nodes of one level are traversed together, beginning with each run and itself. Splitting
    both gives the pairs that agree in the next bit, at the same count of differing bits, and those that don't, at one
    more; pairs over the budget are pruned. Small ranges are compared outright. more: further fingerprints, and how many
    of their bits a link's may differ in. Pairs of nodes that hold one label alone are pruned too.
    """
    changes = None if label is None else np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
    many = ends - starts > 1
    lo, hi = starts[many], ends[many]
    stack = [(depth, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    while stack:
        depth, alo, ahi, blo, bhi, diff = stack.pop()
        if len(alo) > CHUNK:
            mid = len(alo) // 2
            stack += [(depth, *(x[:mid] for x in (alo, ahi, blo, bhi, diff))), (depth, *(x[mid:] for x in (alo, ahi, blo, bhi, diff)))]
            continue
        done = ((ahi - alo) * (bhi - blo) <= LEAF) | (depth == 64)
        if done.any():
            for i, j in _compared(values, alo[done], ahi[done], blo[done], bhi[done], budget, more):
                if label is not None:
                    i, j = (x[label[i] != label[j]] for x in (i, j))
                yield i, j
            alo, ahi, blo, bhi, diff = (x[~done] for x in (alo, ahi, blo, bhi, diff))
        if not len(alo):
            continue
        am, bm = _split(values, alo, ahi, depth), _split(values, blo, bhi, depth)
        own = alo == blo  # a node with itself: its two children meet once
        parts = [(alo, am, blo, bm, diff), (am, ahi, bm, bhi, diff), (alo, am, bm, bhi, diff + 1)]
        parts.append(tuple(x[~own] for x in (am, ahi, blo, bm, diff + 1)))
        alo, ahi, blo, bhi, diff = (np.concatenate(x) for x in zip(*parts))
        live = (ahi > alo) & (bhi > blo) & (diff <= budget) & ~((alo == blo) & (ahi - alo < 2))
        if label is not None:
            a, b = alo[live], blo[live]
            live[live] = (label[a] != label[b]) | (changes[a] != changes[ahi[live] - 1]) | (changes[b] != changes[bhi[live] - 1])
        stack.append((depth + 1, *(x[live] for x in (alo, ahi, blo, bhi, diff))))


def _forest(n: int, chunks) -> np.ndarray:
    """For each of n nodes the smallest node of its component under the chunks of links, kept in n numbers."""
    root = np.arange(n)
    for i, j in chunks:
        while len(i):
            a, b = root[i], root[j]
            i, j, a, b = (x[a != b] for x in (i, j, a, b))
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
    return root


def _runs(batches):
    """Whole runs of equal (kind, block), the first two columns, from sorted batches, as many at a time as have come in."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        kind, block = (b.column(k).to_numpy(zero_copy_only=False) for k in range(2))
        other = (kind != kind[-1]) | (block != block[-1])
        cut = b.num_rows - int(np.argmax(other[::-1])) if other.any() else 0  # where the batch's last run begins
        if cut or last != (kind[-1], block[-1]):
            if held or cut:
                yield pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks()
            held = []
        held.append(b.slice(cut))
        last = kind[-1], block[-1]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _longs(t: pa.Table, *names: str) -> list[np.ndarray]:
    return [t.column(x).to_numpy().astype(np.int64) for x in names]


def _link_runs(budget: int, more: int | None, turns: list[list[tuple[int, int]]], depths: list[int]):
    """Links of a partition's runs as a forest. For each kind: the order of the fingerprint's bits in its trie, as
    (shift, bits) from the top, and the depth of the runs' nodes."""

    def run(batches):
        for t in _runs(batches):
            kinds, blocks, fps, others = _longs(t, "kind", "block", "fp", "other")
            for kind in np.unique(kinds).tolist():
                at = kinds == kind
                fp, other, block = fps[at].view(np.uint64), others[at].view(np.uint64), blocks[at]
                values = _turned(fp, turns[kind])
                order = np.argsort(values, kind="stable")
                values, fp, other, block = values[order], fp[order], other[order], block[order]
                new = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
                chunks = trie_links(values, new, np.append(new[1:], len(fp)), depths[kind], budget, None if more is None else (other, more))
                root = _forest(len(fp), chunks)
                a = np.flatnonzero(root != np.arange(len(fp)))
                cols = [x[i].view(np.int64) for i in (a, root[a]) for x in (fp, other)]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), ["a1", "a2", "b1", "b2"])

    return run


def _turned(fp: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros_like(fp)
    for shift, bits in order:
        out = (out << np.uint64(bits)) | ((fp >> np.uint64(shift)) & np.uint64((1 << bits) - 1))
    return out


def _bits(places: list[int]) -> list[tuple[int, int]]:
    return [(p, 1) for p in places]


def _cut(places: list[int], parts: int) -> list[list[int]]:
    """The places (of bits, from the top) in `parts` blocks of nearly equal length."""
    ends = [len(places) * k // parts for k in range(parts + 1)]
    return [places[a:b] for a, b in zip(ends, ends[1:])]


def _value(places: list[int]) -> Column:
    """The bits at these places of the fingerprint as a number."""
    if places == list(range(places[0], places[0] - len(places), -1)):
        return F.shiftrightunsigned(F.col("fp"), places[-1]).bitwiseAND(F.lit((1 << len(places)) - 1))
    parts = [F.shiftleft(F.shiftrightunsigned(F.col("fp"), p).bitwiseAND(F.lit(1)), len(places) - 1 - i) for i, p in enumerate(places)]
    return reduce(lambda x, y: x.bitwiseOR(y), parts)


def links(fps: DataFrame, budget: int = 3, more: int | None = None, hot_run: int = HOT_RUN) -> DataFrame:
    """Links (a, b) that connect all rows whose `fp` is within `budget` differing bits, and, unless more is None, whose
    `other` is within `more`. fps: distinct (fp, other); a and b: structs of both.

    Each row goes to budget + 1 tries, in each of which another block of bits comes first; two fingerprints that differ
    in at most `budget` bits agree in one of these blocks, so the traversal there begins at their common node with no
    differing bits. A trie's nodes are dealt over all partitions, which hold whole nodes sorted. From each node comes a
    spanning forest, never all its pairs. Nodes of over hot_run rows are dealt by a further block of bits, by which the
    same argument holds for the rest.
    """
    if not 1 <= budget <= 7:
        raise ValueError("the budget must be 1 to 7 bits")
    n = shuffle_partitions(fps.sparkSession)
    places = list(range(63, -1, -1))
    first = _cut(places, budget + 1)
    turns = [_bits(b + [p for p in places if p not in b]) for b in first]
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), _value(b).alias("block")) for k, b in enumerate(first)])
    cols = ["fp", "other"]
    dealt = fps.select(*cols, F.explode(kinds).alias("x")).select("x.kind", "x.block", *cols)
    # runs are at most as many as there are values of the blocks, budget + 1 times 2 ** (64 / (budget + 1)), or (budget + 1) / hot_run of the rows
    many = materialize(dealt.groupBy("kind", "block").count().where(F.col("count") > hot_run).select("kind", "block"))

    def joined(rows: DataFrame, turns, depths) -> DataFrame:
        placed = rows.repartition(n, "kind", "block").sortWithinPartitions("kind", "block")
        got = placed.mapInArrow(_link_runs(budget, more, turns, depths), "a1 bigint, a2 bigint, b1 bigint, b2 bigint")
        node = lambda x: F.struct(F.col(f"{x}1").alias("fp"), F.col(f"{x}2").alias("other")).alias(x)
        return got.select(node("a"), node("b"))

    if many.isEmpty():
        return joined(dealt, turns, [len(b) for b in first])
    cold = dealt.join(F.broadcast(many), ["kind", "block"], "left_anti").select("kind", "block", *cols)
    hot = dealt.join(F.broadcast(many), ["kind", "block"], "left_semi").select("kind", "block", *cols)
    inner, inner_turns, depths = [], [], []
    for k, b in enumerate(first):
        for second in _cut([p for p in places if p not in b], budget + 1):
            block = F.shiftleft("block", len(second)).bitwiseOR(_value(second))
            inner.append(F.when(F.col("kind") == k, F.struct(F.lit(len(inner)).alias("kind"), block.alias("block"))))
            inner_turns.append(_bits(b + second + [p for p in places if p not in b and p not in second]))
            depths.append(len(b) + len(second))
    again = hot.select(*cols, F.explode(F.filter(F.array(*inner), lambda x: x.isNotNull())).alias("x"))
    again = again.select("x.kind", "x.block", *cols)
    return joined(cold, turns, [len(b) for b in first]).unionByName(joined(again, inner_turns, depths))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, budget: int = 3, confirm: tuple[int, int] | None = None
) -> DataFrame:
    """One row per input row: key, fingerprint (16 hex digits) and component_id, the smallest key that it reaches
    over links. Texts link if their fingerprints of shingles of `words` differ in at most `budget` bits and, with
    confirm = (words, bits), their fingerprints of shingles of that many words in at most so many bits.

    Null and blank texts have fingerprint zero, which links like any other; texts of fewer words than a shingle are
    hashed whole. Repeated rows each return a row; rows with a null key have component_id of the others that they
    reach, or null. An empty table stays empty. Equal fingerprints are joined first, so groups of copies of any size
    take part as one fingerprint.
    """
    marked = materialize(fingerprints(docs, key, text, words, confirm[0] if confirm else None))
    distinct = materialize(marked.groupBy("fp", "other").agg(F.min("k").alias("least"), F.count("*").alias("rows")))
    found = components(links(distinct.select("fp", "other"), budget, confirm[1] if confirm else None))
    found = found.select("node.fp", "node.other", "root")
    itself = F.struct("fp", "other")
    rooted = materialize(distinct.join(found, ["fp", "other"], "left").select("fp", "other", "least", "rows", F.coalesce("root", itself).alias("root")))
    best = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("nodes"))
    each = materialize(hot_join(rooted, best, ["root"], "nodes").select("fp", "other", "rows", "component_id"))
    out = hot_join(marked, each, ["fp", "other"], "rows")
    return out.select(F.col("k").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingles(w: list[bytes], words: int) -> np.ndarray:
    """The distinct XXH64 of shingles of `words` words, sorted."""
    each, n = _shingled(w, words)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, each), np.uint64, n))


def sketches(hashes: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """For each band a number that two sets share with probability (their similarity) ** rows: their `rows` minima under
    as many hash functions, folded."""
    n = rows * bands
    keys = np.array([[xxhash.xxh64_intdigest(str(i), seed) for i in range(n)] for seed in (1, 2)], np.uint64)
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), SKETCHED):
        x = (hashes[i : i + SKETCHED] ^ keys[0][:, None]) * (keys[1] | np.uint64(1))[:, None]
        np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=1), out=least)
    out = np.zeros(bands, np.uint64)
    for column in least.reshape(bands, rows).T:
        out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
    return out


def _sketched(words: int, rows: int, bands: int):
    """(k, id, fp, n, blocks): the SimHash of the set of a text's shingles, its size and its sketches (null: no shingles)."""

    def run(batches):
        for b in batches:
            for start, texts in text_slices(b.column(2)):
                sets = [shingles(text_words(t), words) for t in texts]
                fps = np.array([_majority(h) for h in sets], np.uint64).view(np.int64)
                blocks = [sketches(h, rows, bands).view(np.int64) if len(h) else None for h in sets]
                cols = [b.column(k).slice(start, len(texts)) for k in range(2)]
                cols += [pa.array(fps), pa.array(list(map(len, sets)), pa.int32()), pa.array(blocks, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, ["k", "id", "fp", "n", "blocks"])

    return run


def _shingle_sets(words: int):
    """(id, s): a text's distinct shingles."""

    def run(batches):
        for b in batches:
            for start, texts in text_slices(b.column(1)):
                sets = [shingles(text_words(t), words).view(np.int64) for t in texts]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(texts)), pa.array(sets, pa.list_(pa.int64()))], ["id", "s"])

    return run


def _alike(fp, n, i, j, budget: int, similar: float) -> np.ndarray:
    """Whether the texts i and j can be similar, by their fingerprints and their sizes."""
    return (np.bitwise_count(fp[i] ^ fp[j]) <= budget) & (np.minimum(n[i], n[j]) >= similar * np.maximum(n[i], n[j]))


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _neighbours(budget: int, similar: float):
    """Pairs of rows (kind, block, fp, id, n) that follow one another in a run and can be similar."""

    def run(batches):
        held = None
        for b in batches:
            new = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)])
            if not new.shape[1]:
                continue
            rows = new if held is None else np.concatenate([held, new], axis=1)
            held = rows[:, -1:]
            i = np.flatnonzero((rows[:2, 1:] == rows[:2, :-1]).all(axis=0))
            good = i[_alike(rows[2].view(np.uint64), rows[4], i, i + 1, budget, similar)]
            yield _pairs(rows[3][good], rows[3][good + 1])

    return run


def _between(budget: int, similar: float):
    """Links (a, b) within the runs of rows (kind, block, fp, id, n, label, s) that join all labels that similar texts join. Pairs
    of the fewest differing bits come first; what is joined already isn't compared."""

    def run(batches):
        for t in _runs(batches):
            kinds, blocks, fps, ids, n, label = _longs(t, "kind", "block", "fp", "id", "n", "label")
            sets = t.column("s").combine_chunks()
            sets = sets.chunk(0) if isinstance(sets, pa.ChunkedArray) else sets
            flat, stop = sets.flatten().to_numpy(), np.cumsum(sets.value_lengths().to_numpy())
            fps = fps.view(np.uint64)
            order = np.lexsort((fps, blocks, kinds))
            kinds, blocks, fps, ids, n, label, stop = (x[order] for x in (kinds, blocks, fps, ids, n, label, stop))
            new = np.flatnonzero(np.concatenate([[True], (blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])]))
            part = np.unique(label, return_inverse=True)[1].tolist()
            root = list(range(len(label)))

            def top(x: int) -> int:
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            for i, j in trie_links(fps, new, np.append(new[1:], len(fps)), 0, budget, label=label):
                good = _alike(fps, n, i, j, budget, similar)
                i, j = i[good], j[good]
                near = np.argsort(np.bitwise_count(fps[i] ^ fps[j]), kind="stable")
                found = []
                for x, y in zip(i[near].tolist(), j[near].tolist()):
                    p, q = top(part[x]), top(part[y])
                    if p != q:
                        both = len(np.intersect1d(flat[stop[x] - n[x] : stop[x]], flat[stop[y] - n[y] : stop[y]], assume_unique=True))
                        if both >= similar * (n[x] + n[y] - both):
                            root[max(p, q)] = min(p, q)
                            found.append((x, y))
                x, y = np.array(found, int).reshape(-1, 2).T
                yield _pairs(ids[x], ids[y])

    return run


def _cells(rows: DataFrame, hot_run: int) -> DataFrame:
    """Rows (kind, block, fp, id, n, label) of runs that hold several labels, runs of over hot_run shingles dealt in cells.

    In a cell stands a part of the run's commonest label, of hot_run shingles or so, and a part of its other rows, or two
    parts of these. So all pairs of different labels meet, pairs of the commonest label don't, and no task holds a hot run.
    """
    each = rows.groupBy("kind", "block", "label").agg(F.sum("n").alias("c"))
    runs = each.groupBy("kind", "block").agg(F.count("*").alias("labels"), F.sum("c").alias("all"), F.max("c").alias("most"), F.max_by("label", F.struct("c", "label")).alias("main"))
    runs = materialize(runs.where("labels > 1").drop("labels"))
    both = rows.join(runs.where(F.col("all") <= hot_run).select("kind", "block"), ["kind", "block"], "left_semi").select(*rows.columns)
    large = runs.where(F.col("all") > hot_run)
    if large.isEmpty():
        return both
    parts = lambda n: F.ceil(n / F.lit(hot_run)).cast("int")
    mine = rows.join(_few(large), ["kind", "block"])
    mine = mine.withColumns({"m": parts(F.col("most")), "o": parts(F.col("all") - F.col("most"))})
    h, first = F.xxhash64("id"), F.col("label") == F.col("main")
    own = F.when(first, F.pmod(h, F.col("m"))).otherwise(F.col("m") + F.pmod(h, F.col("o"))).cast("int")
    others = F.when(first, F.sequence(F.col("m"), F.col("m") + F.col("o") - 1)).otherwise(F.sequence(F.lit(0), F.col("m") + F.col("o") - 1))
    met = mine.withColumn("own", own).withColumn("met", F.explode(others))
    cell = F.xxhash64("block", F.least("own", "met"), F.greatest("own", "met"))
    return both.unionByName(met.withColumn("block", cell).select(*rows.columns))


def _few(keys: DataFrame) -> DataFrame:
    """The keys, to be broadcast if they aren't many, which spares the texts a shuffle."""
    return F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys


def near_copies(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similar: float = 0.8, budget: int = 18, rows: int = 3, bands: int = 10, hot_run: int = HOT_SHINGLES
) -> tuple[DataFrame, DataFrame]:
    """(k, id) for every input row, and (id, least, component_id) for every different text: the smallest key that has
    it, and the smallest that it reaches over links. Texts link if the Jaccard similarity of their sets of shingles of `words`
    words is at least `similar`. Texts are told apart by 64-bit hashes of their words, and so are shingles.

    Every text stands in `bands` tries over the SimHash of its shingles, each of which is dealt by a sketch: texts of
    similarity s share one with probability 1 - (1 - s ** rows) ** bands (0.999 at 0.8). Pairs of nodes are traversed together
    under a budget of differing bits (at 0.8 fingerprints differ in 9.7 of 64 bits on average, in 18 or fewer with probability
    0.998), and each pair that is left is confirmed by its exact similarity. A budget so wide leaves nothing to deal by
    blocks of bits, as links() does.

    Neighbours in a run are compared first. What these join has one label from then on, and nodes of one label aren't
    paired, so a large group of near copies doesn't make all its pairs; all other pairs of a run are compared where it stands,
    unless links found there have joined their labels meanwhile. A null key counts as no key; repeated rows and keys do no harm.
    """
    kind = docs.schema[key].dataType.simpleString()
    body = text_or_empty(text)
    body = F.when(F.rlike(body, F.lit(r"^[ \t-\r]*+$")), "").otherwise(body)  # no words: no sketches either, so these are one text
    named = docs.select(F.col(key).alias("k"), F.xxhash64(body).alias("id"), body.alias("t"))
    marked = materialize(named.mapInArrow(_sketched(words, rows, bands), f"k {kind}, id bigint, fp bigint, n int, blocks array<bigint>"))
    nodes = materialize(marked.groupBy("id").agg(F.min("k").alias("least"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.min("blocks").alias("blocks")))
    partitions = shuffle_partitions(docs.sparkSession)
    cols = ["kind", "block", "fp", "id", "n"]

    def dealt(rows: DataFrame, *more: str) -> DataFrame:
        return rows.select(F.posexplode("blocks").alias("kind", "block"), "fp", "id", "n", *more).select(*cols, *more)

    placed = dealt(nodes).repartitionByRange(partitions, "kind", "block", "fp").sortWithinPartitions("kind", "block", "fp")
    first = materialize(placed.mapInArrow(_neighbours(budget, similar), "a bigint, b bigint").distinct())
    near = materialize(_confirmed(first, named, words, similar))
    part = components(near)
    labelled = materialize(nodes.join(part.select(F.col("node").alias("id"), F.col("root").alias("label")), "id", "left").withColumn("label", F.coalesce("label", "id")))
    mixed = materialize(_cells(dealt(labelled, "label"), hot_run))
    with_sets = mixed.join(_sets(mixed.select("id").distinct(), named, words), "id").select(*cols, "label", "s")
    mixed = with_sets.repartition(partitions, "kind", "block").sortWithinPartitions("kind", "block")
    more = materialize(mixed.mapInArrow(_between(budget, similar), "a bigint, b bigint").distinct())
    found = components(near.unionByName(more)).select(F.col("node").alias("id"), F.col("root").alias("root"))
    rooted = materialize(nodes.select("id", "least").join(found, "id", "left").withColumn("root", F.coalesce("root", "id")))
    best = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("rows"))
    return marked.select("k", "id"), hot_join(rooted, best, ["root"], "rows").select("id", "least", "component_id")


def _sets(ids: DataFrame, named: DataFrame, words: int) -> DataFrame:
    """(id, s): the sets of shingles of the texts with these ids; named: (id, t)."""
    texts = named.select("id", "t").join(_few(materialize(ids)), "id", "left_semi").groupBy("id").agg(F.first("t").alias("t"))
    return materialize(texts.mapInArrow(_shingle_sets(words), "id bigint, s array<bigint>"))


def _confirmed(pairs: DataFrame, named: DataFrame, words: int, similar: float) -> DataFrame:
    """Those of the pairs (a, b) of texts whose sets of shingles are similar."""
    sets = _sets(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), named, words)
    for x in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("id").alias(x), F.col("s").alias(f"s{x}")), x)
    pairs = pairs.withColumn("n", F.size(F.array_intersect("sa", "sb")))
    return pairs.where(F.col("n") >= F.lit(similar) * (F.size("sa") + F.size("sb") - F.col("n"))).select("a", "b")


def keep_one(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, budget: int = 3, confirm: tuple[int, int] | None = None, similar: float | None = None
) -> DataFrame:
    """The rows of docs whose key is the smallest of its component, by near_copies() if `similar` is given (with `words` words and
    a budget of `budget` bits), or else by near_duplicates(). Of rows that repeat one key, all stay or go, and rows with a null
    key stay. An empty table stays empty; null and empty texts are copies of each other; other columns are handed through."""
    if similar is None:
        found = near_duplicates(docs, key, text, words, budget, confirm)
        worse = found.where(F.col(key) != F.col("component_id")).select(F.col(key).alias("__k"))
    else:
        rows, texts = near_copies(docs, key, text, words, similar, budget)
        stay = texts.where(F.col("least") == F.col("component_id")).select(F.col("least").alias("k"))
        worse = rows.where(F.col("k").isNotNull()).join(stay, "k", "left_anti").select(F.col("k").alias("__k"))
    worse = materialize(worse.distinct())
    return docs.join(_few(worse), F.col(key) == F.col("__k"), "left_anti")
