"""Operator 4: language-model scores of whole texts by context-tree weighting over bytes, beside a word-unigram base."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import materialize, shuffle_partitions

#: Bytes of context.
DEPTH = 5
#: Bytes of context by which contexts are dealt into slices, and one in how many symbols must follow such a context for it to be hot:
#: hot ones, fewer than HOT_PAIRS, are dealt by a byte more.
TOP, HOT_PAIRS = 2, 2_000
#: Bytes of text that share a block of statistics, that are handled at a time, and that are scored at a time.
BLOCK_BYTES, CHUNK_BYTES, SCORE_BYTES = 16 << 20, 2 << 20, 1 << 19
#: Bytes of text for which there is a slice of statistics, and the fewest and most slices.
SLICE_BYTES, SLICES = 256 << 20, (32, 65_536)
#: Stands before and after each text; it never occurs in UTF-8.
EDGE = 255
#: Hash of the end token, which no word has as its bytes.
END = xxhash.xxh64_intdigest(b"\n")


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma of positive numbers: Stirling's series after shifting small ones up."""
    y = np.asarray(x, float)
    small = np.maximum(0, np.ceil(8 - y)).astype(int)
    shift = np.zeros_like(y)
    for k in range(int(small.max(initial=0))):
        shift += np.where(k < small, np.log(y + k), 0.0)
    z = y + small
    s = 1 / (z * z)
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + (1 / 12 - s * (1 / 360 - s * (1 / 1260 - s / 1680))) / z - shift


def kt_block(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of any sequence with these counts."""
    out = np.zeros(np.broadcast(zeros, ones).shape)
    a, b = np.broadcast_arrays(zeros, ones)
    some = (a > 0) | (b > 0)
    a, b = a[some].astype(float), b[some].astype(float)
    out[some] = _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1) - math.log(math.pi)
    return out


def _kt_next(counts: np.ndarray) -> np.ndarray:
    """The estimator's probability of a one at each decision."""
    zeros, ones = decisions(counts)
    return (ones + 0.5) / (zeros + ones + 1.0)


def _sliced(f, *arrays: np.ndarray, rows: int = 512) -> np.ndarray:
    """f over slices of the arrays' rows, which keeps what it needs in between small."""
    return np.concatenate([f(*(a[i : i + rows].astype(float) for a in arrays)) for i in range(0, len(arrays[0]), rows)] or [np.zeros((0, 255))])


def decisions(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From symbol counts (nodes x 256) the counts of zeros and ones at each of the 255 decisions that spell a byte,
    highest bit first, the decisions of a bit together."""
    zeros, ones, s = [], [], counts
    while s.shape[1] > 1:
        zeros.append(s[:, 0::2])
        ones.append(s[:, 1::2])
        s = s[:, 0::2] + s[:, 1::2]
    return np.concatenate(zeros[::-1], axis=1), np.concatenate(ones[::-1], axis=1)


def spelled(one: np.ndarray) -> np.ndarray:
    """log10 probabilities of all 256 symbols from P(1) at the 255 decisions."""
    out = np.zeros((len(one), 1))
    at = 0
    for _ in range(8):
        p = one[:, at : at + out.shape[1]]
        at += out.shape[1]
        new = np.empty((len(one), 2 * out.shape[1]))
        new[:, 0::2] = out + np.log10(1 - p)
        new[:, 1::2] = out + np.log10(p)
        out = new
    return out


@dataclass
class Model:
    classes: np.ndarray  # byte -> class of a context byte; 0: none of the model's contexts have it
    moves: np.ndarray  # state x class -> state one byte further back; states from `nodes` on have stopped
    logs: np.ndarray  # node x byte -> log10 probability
    nodes: int
    depth: int


def build(depths: np.ndarray, keys: np.ndarray, counts: np.ndarray, depth: int = DEPTH) -> Model:
    """The weighted tree from rows (depth d, key, count); key: a context of d bytes, oldest first, then the symbol.

    Contexts that aren't given fall into their parent's `rest` leaf, which has what the given children leave of the
    parent's counts. So all contexts belong to just one leaf, and this is context-tree weighting over the trees that
    can be pruned from this one: P_w = P_kt / 2 + (product of the children's P_w) / 2, for each decision by itself.
    """
    order = np.lexsort((keys, depths))
    depths, keys, counts = depths[order], keys[order].astype(np.int64), counts[order]
    level: list[tuple[np.ndarray, np.ndarray]] = []  # contexts, symbol counts
    for d in range(depth + 1):
        at = depths == d
        ctx, row = np.unique(keys[at] >> 8, return_inverse=True)
        if d == 0:
            ctx, row = np.zeros(1, np.int64), np.zeros(at.sum(), int)
        c = np.zeros((len(ctx), 256), np.float32 if counts[at].max(initial=0) < 1 << 24 else np.float64)  # exact in either
        c[row, keys[at] & 255] = counts[at]
        level.append((ctx, c))
    parent = [np.zeros(0, int)] + [np.searchsorted(level[d - 1][0], level[d][0] & ((1 << 8 * (d - 1)) - 1)) for d in range(1, depth + 1)]

    blocks = lambda c: kt_block(*decisions(c))
    stay: list[np.ndarray] = [np.zeros(0)] * (depth + 1)  # posterior weight of stopping at a node
    rests: list[np.ndarray] = [np.zeros(0)] * (depth + 1)
    has = [np.zeros(len(ctx), bool) for ctx, _ in level]
    below = np.zeros((0, 255))  # log P_w of the level underneath
    for d in reversed(range(depth + 1)):
        own = _sliced(blocks, level[d][1])
        up = parent[d + 1] if d < depth else np.zeros(0, int)
        has[d][up] = True
        rests[d] = level[d][1].copy()
        if len(up):
            np.subtract.at(rests[d], up, level[d + 1][1])
            split = _sliced(blocks, rests[d])
            np.add.at(split, up, below)
            np.logaddexp(own, split, out=split)
            split -= math.log(2)
            split[~has[d]] = own[~has[d]]
            own -= split
            own[has[d]] -= math.log(2)
            stay[d], below = np.exp(own, out=own).astype(np.float32), split
        else:
            stay[d], below = np.ones(own.shape, np.float32), own
    del own, below

    first = np.cumsum([0] + [len(c) for c, _ in level])
    n = int(first[-1])
    logs = np.empty((n, 256), np.float32)
    used = np.unique(np.concatenate([ctx >> 8 * (d - 1) for d, (ctx, _) in enumerate(level) if d] or [np.zeros(0, np.int64)]))
    classes = np.zeros(256, np.int32)
    classes[used] = np.arange(1, len(used) + 1)
    moves = np.empty((2 * n, len(used) + 1), np.int32)
    moves[:n] = n + np.arange(n)[:, None]
    moves[n:] = n + np.arange(n)[:, None]
    said, left = np.zeros((1, 255)), np.ones((1, 255))  # P(1) gathered on the way down, and the weight not yet given
    ends = lambda said, left, rest, has: spelled(np.clip(said + has * left * _kt_next(rest), 1e-12, 1 - 1e-12))
    for d in range(depth + 1):
        ctx, c = level[d]
        if not len(ctx):
            break
        if d:
            said, left = said[parent[d]], left[parent[d]]
            moves[first[d - 1] + parent[d], classes[ctx >> 8 * (d - 1)]] = first[d] + np.arange(len(ctx))
        said += left * stay[d] * _sliced(_kt_next, c)
        left *= 1.0 - stay[d]
        logs[first[d] : first[d + 1]] = _sliced(ends, said, left, rests[d], has[d][:, None])
    return Model(classes, moves, logs, n, depth)


def _chunks(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def _padded(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts with their edges as one array; the places of their symbols; how many each has."""
    edge = bytes([EDGE])
    data = np.frombuffer(b"".join([edge * depth + t + edge for t in texts]), np.uint8)
    n = np.array([len(t) + 1 for t in texts])
    at = np.arange(int(n.sum())) + np.repeat(depth * np.arange(1, len(texts) + 1), n)
    return data, at, n


def text_logs(model: Model, texts: list[bytes]) -> np.ndarray:
    """log10 probability of each text and its end."""
    out = np.zeros(len(texts))
    width = model.moves.shape[1]
    moves, logs = model.moves.ravel(), model.logs.ravel()
    for a, b in _chunks(texts, CHUNK_BYTES):
        data, at, n = _padded(texts[a:b], model.depth)
        classes = model.classes[data]
        state = np.zeros(len(at), np.int32)
        for d in range(1, model.depth + 1):
            state = moves[state * np.int32(width) + classes[at - d]]
        node = np.where(state >= model.nodes, state - model.nodes, state)
        p = logs[node * np.int32(256) + data[at]].astype(float)
        out[a:b] = np.add.reduceat(p, np.cumsum(n) - n)
    return out


def grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (contexts of `depth` bytes, symbol) as keys, and their counts."""
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in _chunks(texts, CHUNK_BYTES):
        data, at, _ = _padded(texts[a:b], depth)
        key = np.zeros(len(at), np.int64)
        for d in range(depth, -1, -1):
            key <<= 8
            key |= data[at - d]
        del data, at
        key.sort()
        k, n = _merged(key, np.ones(len(key), np.int64))
        keys.append(k)
        counts.append(n)
    return _merged(np.concatenate(keys), np.concatenate(counts))


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    if (keys[1:] < keys[:-1]).any():
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[new], np.add.reduceat(counts, new)


def _pack(ids: np.ndarray) -> bytes:
    """A text's tokens in order of their numbers, as compressed steps."""
    return zstandard.compress(np.diff(np.sort(ids), prepend=0).astype("<i4").tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(packed), "<i4"))


#: Rows of block statistics. kind 0: key, a context with its symbol, n times in the block's training texts. kind 1: key,
#: a slice of tokens; ids and more, the hashes of the block's tokens in it and how often the training texts have them. kind 2:
#: a text, its tokens in ids, by their places among all of the block in the order of slices and hashes.
#: kind 3: key, a slice of contexts; ids and more, the block's contexts of it with their symbols and how often the training
#: texts have them. kind 4: a text, lower-cased, in ids.
_STATS = "kind int, block bigint, key bigint, at int, n bigint, mark string, ids binary, more binary"


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about CHUNK_BYTES of text, or one row."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False) + 1)
    start = 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CHUNK_BYTES, "right")))
        yield start, stop
        start = stop


def _lower(texts: pa.Array) -> pa.Array:
    return pc.ascii_lower(texts)


def _as_bytes(texts: pa.Array) -> list[bytes]:
    return texts.cast(pa.binary()).to_pylist()


def _block_grams(train: np.ndarray, texts: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in _slices(texts):
        part = _as_bytes(_lower(texts.slice(a, b - a)).filter(pa.array(train[a:b])))
        k, n = grams(part, depth)
        keys.append(k)
        counts.append(n)
    return _merged(np.concatenate(keys), np.concatenate(counts))


def _block_tokens(texts: pa.Array) -> tuple[list[str], list[np.ndarray]]:
    """The distinct words of a block, and for each text its words as numbers in that list."""
    chunks, docs = [], []
    for a, b in _slices(texts):
        words = pc.split_pattern_regex(_lower(texts.slice(a, b - a)), "[ \t-\r]+")
        real = pc.not_equal(words.flatten(), "")
        docs.append(a + np.repeat(np.arange(b - a), pc.list_value_length(words).to_numpy(zero_copy_only=False))[real.to_numpy(zero_copy_only=False)])
        chunks.append(words.flatten().filter(real).dictionary_encode())
    whole = pa.chunked_array(chunks).unify_dictionaries()
    ids = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in whole.chunks]).astype(np.int32)
    ends = np.searchsorted(np.concatenate(docs), np.arange(len(texts) + 1))
    return whole.chunk(0).dictionary.to_pylist(), [ids[a:b] for a, b in zip(ends, ends[1:])]


def _block_rows(block: int, marks: pa.Array, train: np.ndarray, texts: pa.Array, depth: int, parts: int, hot: np.ndarray | None):
    if hot is not None:
        key, n = _all_grams(train, texts, depth)
        slot = slice_of(key, depth, parts, hot)
        order = np.argsort(slot, kind="stable")
        yield _slice_rows(3, block, slot[order], key[order], n[order])
        del slot, order
        for a, b in _slices(texts):
            yield _rows(4, block, mark=marks.slice(a, b - a), ids=[zstandard.compress(t, 1) for t in _as_bytes(_lower(texts.slice(a, b - a)))])
    else:
        key, n = _block_grams(train, texts, depth)
        yield _rows(0, block, key=key, n=n)
    del key, n
    names, ids = _block_tokens(texts)
    codes = np.array([xxhash.xxh64_intdigest(w) for w in names] + [END], np.uint64)
    in_train = np.zeros(len(codes), np.int64)
    in_train += np.bincount(np.concatenate([x for x, t in zip(ids, train) if t] or [np.zeros(0, np.int32)]), minlength=len(codes))
    in_train[-1] = train.sum()
    slot = (codes % np.uint64(parts)).astype(np.int64)
    codes = codes.view(np.int64)
    order = np.lexsort((codes, slot))
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    codes, in_train, slot = codes[order], in_train[order], slot[order]
    yield _slice_rows(1, block, slot, codes, in_train)
    yield _rows(2, block, mark=marks, ids=[_pack(place[np.append(x, np.int32(len(names)))]) for x in ids])


def _slice_rows(kind: int, block: int, slot: np.ndarray, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """A row for each slice: its keys and their counts, packed; all in the order of slot."""
    first = np.flatnonzero(np.diff(slot, prepend=-1))
    cuts = list(zip(first, [*first[1:], len(slot)]))
    return _rows(kind, block, key=slot[first], ids=[_pack_keys(keys[a:b]) for a, b in cuts], more=[_planes(n[a:b]) for a, b in cuts])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many symbols follow each context of TOP bytes."""
    n = np.zeros(1 << 16, np.int64)
    for b in batches:
        for i, j in _slices(b.column(0)):
            data, at, _ = _padded(_as_bytes(_lower(b.column(0).slice(i, j - i))), TOP)
            n += np.bincount(data[at - 1].astype(np.int64) << 8 | data[at - 2], minlength=len(n))
    seen = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(n[seen], pa.int64())], ["pair", "n"])


def _stats(depth: int, parts: int, hot: np.ndarray | None):
    """Statistics of blocks of (mark, train, text), mark being what names a text; with `parts` slices of tokens, and of contexts if
    the whole model is wanted, for which the hot pairs are given; otherwise contexts are rows."""

    def run(batches):
        part = TaskContext.get().partitionId() << 32
        held, size, block = [], 0, 0
        for b in batches:
            start = 0
            for i, n in enumerate(pc.binary_length(b.column(2)).to_pylist()):
                if size and size + n > BLOCK_BYTES:
                    held.append(b.slice(start, i - start))
                    yield from flush(held, part + block)
                    held, size, start, block = [], 0, i, block + 1
                size += n
            held.append(b.slice(start))
        yield from flush(held, part + block)

    def flush(held, block):
        if sum(map(len, held)):
            marks, train, texts = (pa.chunked_array([h.column(k) for h in held]).combine_chunks() for k in range(3))
            yield from _block_rows(block, marks, train.to_numpy(zero_copy_only=False).astype(bool), texts, depth, parts, hot)
            del marks, train, texts
        pa.default_memory_pool().release_unused()

    return run


def _rows(kind: int, block: int, **cols) -> pa.RecordBatch:
    n = len(next(iter(cols.values())))
    types = {"kind": pa.int32(), "block": pa.int64(), "key": pa.int64(), "at": pa.int32(), "n": pa.int64(), "mark": pa.string(), "ids": pa.binary(), "more": pa.binary()}
    cols |= {"kind": np.full(n, kind, np.int32), "block": np.full(n, block, np.int64)}
    return pa.RecordBatch.from_arrays([pa.array(cols[k], t) if k in cols else pa.nulls(n, t) for k, t in types.items()], list(types))


# The whole model. A context's bytes are reversed here, the last one first, above the symbol: contexts that share their last
# bytes are neighbours, and each slice holds whole subtrees below contexts of TOP bytes, or below contexts of a byte more that
# end in hot ones: no hot pair of bytes makes a slice that can't be split. All contexts that occur are in the
# tree, so a context's counts are the sum of its children's and no `rest` leaf has any.


def _planes(a: np.ndarray) -> bytes:
    """Numbers, compressed byte by byte of their places."""
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes(), 1)


def _unplanes(packed: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(packed), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _pack_keys(keys: np.ndarray) -> bytes:
    return _planes(np.diff(keys, prepend=0))


def _unpack_keys(packed: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(packed, np.int64))


def _turned_keys(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For all symbols of the texts and their ends the reversed context with the symbol; how many each text has."""
    data, at, n = _padded(texts, depth)
    key = np.zeros(len(at), np.int64)
    for d in (*range(1, depth + 1), 0):
        key <<= 8
        key |= data[at - d]
    return key, n


def _all_grams(train: np.ndarray, texts: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct reversed contexts with symbols of all texts, and how often the training texts have them. Chunks' keys are merged
    whenever there are as many new ones as old, which bounds the memory."""
    keys, counts, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for a, b in _slices(texts):
        key, n = _turned_keys(_as_bytes(_lower(texts.slice(a, b - a))), depth)
        key <<= 1
        key |= np.repeat(train[a:b], n)
        key.sort()
        k, n = _merged(key >> 1, key & 1)
        del key
        keys.append(k)
        counts.append(n)
        size += len(k)
        if size > max(len(keys[0]), 1 << 20):
            k, n = _merged(np.concatenate(keys), np.concatenate(counts))
            keys, counts, size = [k], [n], 0
    return _merged(np.concatenate(keys), np.concatenate(counts))


def slice_of(keys: np.ndarray, depth: int, slices: int, hot: np.ndarray) -> np.ndarray:
    """The slice of reversed contexts with symbols, by a hash of their last TOP bytes (0 to slices - 1), or of a byte more if the pair is
    hot (slices and above)."""
    pair = keys >> 8 * (depth + 1 - TOP)
    out = (pair * 2654435761 >> 8) % slices
    split = np.isin(pair, hot)
    out[split] = slices + ((keys[split] >> 8 * (depth - TOP)) * 2654435761 >> 8) % slices
    return out


def _log_gammas() -> list[np.ndarray]:
    if not _TABLES:
        _TABLES.extend(_lgamma(np.arange(1 << 16) + x) for x in (0.5, 1.0))
    return _TABLES


_TABLES: list[np.ndarray] = []


def _kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """kt_block() of whole numbers, the small ones by a table."""
    half, one = _log_gammas()
    out = half[np.minimum(zeros, len(half) - 1)] + half[np.minimum(ones, len(half) - 1)] - one[np.minimum(zeros + ones, len(one) - 1)] - math.log(math.pi)
    big = zeros + ones >= len(half)
    out[big] = kt_block(zeros[big], ones[big])
    return out


@dataclass
class Level:
    """Decisions at one depth that spell one bit: the context above the decision's number (1 to 255), counts of zeros and
    ones, log P_w, and the posterior weight of stopping."""

    codes: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    weighted: np.ndarray
    stay: np.ndarray


def _above(codes: np.ndarray) -> np.ndarray:
    """Codes or keys of the contexts that are one byte shorter."""
    return codes >> 16 << 8 | codes & 255


def subtrees(keys: np.ndarray, n: np.ndarray, depth: int, root: int) -> list[list[Level]]:
    """For each bit, highest first, the levels of depths `root` to `depth` of whole subtrees; keys: distinct, sorted, seen n > 0 times."""
    grams = [(keys, n)]
    while len(grams) <= depth - root:
        grams.append(_merged(_above(grams[-1][0]), grams[-1][1]))
    out = []
    for bit in range(8):
        levels: list[Level] = []
        for k, c in grams:
            symbol = k & 255
            codes = k >> 8 << 8 | 1 << bit | symbol >> 8 - bit  # as sorted as the keys
            new = np.flatnonzero(np.diff(codes, prepend=-1))
            one = symbol >> 7 - bit & 1
            codes = codes[new]
            zeros, ones = (np.add.reduceat(x, new) if len(new) else x for x in (c * (1 - one), c * one))
            own = _kt(zeros, ones)
            if levels:
                up = np.searchsorted(codes, _above(levels[-1].codes))
                weighted = np.logaddexp(own, np.bincount(up, levels[-1].weighted, len(codes))) - math.log(2)
                levels.append(Level(codes, zeros, ones, weighted, np.exp(own - math.log(2) - weighted)))
            else:
                levels.append(Level(codes, zeros, ones, own, np.ones(len(codes))))
        out.append(levels[::-1])
    return out


@dataclass
class Top:
    """What the contexts above the slices' roots give on the way down, their P(1), and the weight that they leave: for last byte (row) and decision
    (column), and for the decisions at hot pairs by their codes."""

    said: np.ndarray
    left: np.ndarray
    codes: np.ndarray
    hot_said: np.ndarray
    hot_left: np.ndarray


def top_levels(roots: np.ndarray, codes: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> Top:
    """The tree's top from its decisions one byte above the slices' roots: depth of the roots, code, counts, and the sum of the roots' log P_w."""
    hot = roots > TOP
    order = np.flatnonzero(hot)[np.argsort(codes[hot])]
    code, z, o, split = codes[order], zeros[order], ones[order], below[order]
    own = _kt(z, o)
    weighted = np.logaddexp(own, split) - math.log(2)
    hot_stay, hot_p = np.exp(own - math.log(2) - weighted), (o + 0.5) / (z + o + 1.0)
    up = np.concatenate([codes[~hot], _above(code)])
    last, j = up >> 8, up & 255
    sums = []
    for x, y in ((zeros, z), (ones, o), (below, weighted)):
        sums.append(np.zeros((256, 256), x.dtype))
        np.add.at(sums[-1], (last, j), np.concatenate([x[~hot], y]))
    z, o, split = sums
    said, left = 0.0, 1.0
    steps = []
    for _ in range(TOP):
        own = _kt(z, o)
        under = np.logaddexp(own, split) - math.log(2)
        steps.append((np.exp(own - math.log(2) - under), (o + 0.5) / (z + o + 1.0)))
        z, o, split = (x.sum(axis=0, keepdims=True) for x in (z, o, under))
    for stay, p in reversed(steps):
        said = said + left * stay * p
        left = left * (1 - stay)
    at = code >> 16, code & 255
    return Top(said, left, code, said[at] + left[at] * hot_stay * hot_p, left[at] * (1 - hot_stay))


def _find(codes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the wanted codes are among sorted ones, and which are there at all."""
    i = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
    return i, codes[i] == wanted if len(codes) else np.zeros(len(wanted), bool)


def gram_logs(keys: np.ndarray, trees: list[list[Level]], top: Top, depth: int, root: int) -> np.ndarray:
    """log10 probabilities of symbols after reversed contexts, for distinct sorted keys whose subtrees from depth `root` on are given. The longest
    contexts that occur are used; what weight they leave goes to unseen ones, which predict 1/2."""
    out = np.zeros(len(keys))
    symbol, last = keys & 255, keys >> 8 * depth
    for bit, levels in enumerate(trees):
        number = 1 << bit | symbol >> 8 - bit
        said, left = top.said[last, number], top.left[last, number]
        if root > TOP:
            i, hit = _find(top.codes, keys >> 8 * (depth + 1 - TOP) << 8 | number)
            said[hit], left[hit] = top.hot_said[i[hit]], top.hot_left[i[hit]]
        at, up = np.arange(len(keys)), None
        for d, level in enumerate(levels, root):
            if not len(level.codes) or not len(at):
                break
            if up is None and root > TOP:  # what the level's own decisions have gathered from above
                i = np.searchsorted(top.codes, _above(level.codes))
                s, w = top.hot_said[i], top.hot_left[i]
            elif up is None:
                s, w = (x[level.codes >> 16, level.codes & 255] for x in (top.said, top.left))
            else:
                i = np.searchsorted(up.codes, _above(level.codes))
                s, w = s[i], w[i]
            s = s + w * level.stay * (level.ones + 0.5) / (level.zeros + level.ones + 1.0)
            w, up = w * (1 - level.stay), level
            codes = keys[at] >> 8 * (depth - d + 1) << 8 | number[at]
            i, hit = _find(level.codes, codes)
            at, i = at[hit], i[hit]
            said[at], left[at] = s[i], w[i]
        one = np.clip(said + left / 2, 1e-12, 1 - 1e-12)
        out += np.log10(np.where(symbol >> 7 - bit & 1, one, 1 - one))
    return out


def _slice_grams(rows: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Each block's keys of a slice; all distinct ones, and their counts."""
    parts = [_unpack_keys(x) for x in rows.column("ids").to_pylist()]
    counts = np.concatenate([_unplanes(x, np.int64) for x in rows.column("more").to_pylist()])
    return parts, *_merged(np.concatenate(parts), counts)


def _root(key: int, slices: int) -> int:
    return TOP + (key >= slices)


_SUMS = "root int, code bigint, zeros bigint, ones bigint, below double, key bigint, ids binary, more binary"


def _slice_sums(depth: int, slices: int):
    """A slice over all blocks, which come one after another: its grams and counts, packed, and the decisions above its roots as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, size, slot = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0, 0
        for b in batches:
            slot = b.column(0)[0].as_py()
            for ids, more in zip(b.column(1), b.column(2)):
                keys.append(_unpack_keys(ids.as_py()))
                counts.append(_unplanes(more.as_py(), np.int64))
                size += len(keys[-1])
                if size > max(len(keys[0]), 1 << 20):
                    k, n = _merged(np.concatenate(keys), np.concatenate(counts))
                    keys, counts, size = [k], [n], 0
        k, n = _merged(np.concatenate(keys), np.concatenate(counts))
        del keys, counts
        root = _root(slot, slices)
        parts = []
        for first, *_ in subtrees(k[n > 0], n[n > 0], depth, root):
            codes, at = np.unique(_above(first.codes), return_inverse=True)
            sums = [np.bincount(at, x, len(codes)) for x in (first.zeros, first.ones, first.weighted)]
            parts.append((codes, *(x.astype(t) for x, t in zip(sums, (np.int64, np.int64, float)))))
        cols = [np.concatenate(x) for x in zip(*parts)]
        rows = len(cols[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(np.full(rows, root), 0), pa.int32()), *(pa.array(np.append(x, 0).astype(x.dtype)) for x in cols),
             pa.array([None] * rows + [slot], pa.int64()), pa.array([None] * rows + [_pack_keys(k)], pa.binary()), pa.array([None] * rows + [_planes(n)], pa.binary())],
            [x.split()[0] for x in _SUMS.split(", ")],
        )

    return run


def _slice_logs(depth: int, slices: int, top):
    """For rows of slices, sorted: of each first the sums (block null), then the blocks' keys, for which the logs are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = logs = None
        for b in batches:
            out, size = [], 0
            for slot, block, ids, more in zip(*b.columns):
                if block.as_py() is None:
                    keys, n = _unpack_keys(ids.as_py()), _unplanes(more.as_py(), np.int64)
                    root = _root(slot.as_py(), slices)
                    logs = gram_logs(keys, subtrees(keys[n > 0], n[n > 0], depth, root), top.value, depth, root).astype(np.float32)
                    continue
                mine = _planes(logs[np.searchsorted(keys, _unpack_keys(ids.as_py()))])
                out.append((block, ids, mine))
                size += len(mine)
                if size > 4 << 20:
                    yield _log_rows(out)
                    out, size = [], 0
            yield _log_rows(out)
        pa.default_memory_pool().release_unused()

    return run


def _log_rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = [[r[0].as_py() for r in rows], [r[1].as_py() for r in rows], [r[2] for r in rows]]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.binary(), pa.binary()))], ["block", "ids", "more"])


def _block_scores(depth: int):
    def run(logs: pa.Table, texts: pa.Table) -> pa.Table:
        keys = np.concatenate([np.zeros(0, np.int64), *(_unpack_keys(x) for x in logs.column("ids").to_pylist())])
        value = np.concatenate([np.zeros(0, np.float32), *(_unplanes(x, np.float32) for x in logs.column("more").to_pylist())])
        order = np.argsort(keys)
        keys, value = keys[order], value[order]
        packed = texts.column("ids").to_pylist()
        out = np.zeros(len(packed))
        start = 0
        while start < len(packed):
            part, size = [], 0
            while start + len(part) < len(packed) and len(part) < 1 << 15 and size < SCORE_BYTES:
                part.append(zstandard.decompress(packed[start + len(part)]))
                size += len(part[-1]) + 1
            key, n = _turned_keys(part, depth)
            key = key.astype(np.uint64) << np.uint64(16) | np.repeat(np.arange(len(part), dtype=np.uint64), n)
            key.sort()
            gram = (key >> np.uint64(16)).astype(np.int64)
            new = np.diff(gram, prepend=-1) != 0
            own = value[np.searchsorted(keys, gram[new])]
            out[start : start + len(part)] = np.bincount((key & np.uint64(0xFFFF)).astype(np.int64), own[np.cumsum(new) - 1], len(part))
            start += len(part)
        del keys, value
        pa.default_memory_pool().release_unused()
        return pa.table([texts.column("mark"), pa.array(out)], ["mark", "score"])

    return run


def whole_scores(stats: DataFrame, depth: int, slices: int) -> DataFrame:
    """(mark, score) from rows of kinds 3 and 4. Slices of contexts are summed over all blocks; from the decisions above their
    roots (65,536 and 256 for each hot pair at most) the driver makes the tree's top. Then the blocks' rows pass their slice's sums, and the
    symbols' probabilities go back to the blocks that have them. A task holds the distinct grams of one slice and a batch of blocks' rows."""
    grams = stats.where(F.col("kind") == 3).select("key", "block", "ids", "more")
    summed = materialize(grams.select("key", "ids", "more").groupBy("key").applyInArrow(_slice_sums(depth, slices), _SUMS))
    above = summed.where("root > 0").groupBy("root", "code").agg(F.sum("zeros").alias("z"), F.sum("ones").alias("o"), F.sum("below").alias("b")).toArrow()
    top = stats.sparkSession.sparkContext.broadcast(top_levels(*(x.to_numpy() for x in above.columns)))
    both = summed.where("root = 0").select("key", F.lit(None).cast("bigint").alias("block"), "ids", "more").unionByName(grams)
    logs = both.repartition("key").sortWithinPartitions("key", F.col("block").asc_nulls_first()).mapInArrow(_slice_logs(depth, slices, top), "block bigint, ids binary, more binary")
    texts = stats.where(F.col("kind") == 4).select("block", "mark", "ids")
    return logs.groupBy("block").cogroup(texts.groupBy("block")).applyInArrow(_block_scores(depth), "mark string, score double")


def tree_rows(counted: DataFrame, nodes: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows for build(): those of the at most `nodes` most frequent contexts of all depths; counted: key, n.

    A context is at least as frequent as the longer ones that end in it, so what stays is a tree. Contexts as frequent
    as the first that finds no room are left to their parents' rest.
    """
    at = F.array(*[F.struct(F.lit(d).alias("d"), F.col("key").bitwiseAND(F.lit((1 << 8 * (d + 1)) - 1)).alias("key")) for d in range(depth + 1)])
    every = counted.select(F.explode(at).alias("x"), "n").groupBy("x.d", "x.key").agg(F.sum("n").alias("n"))
    every = materialize(every)
    contexts = every.groupBy("d", F.shiftright("key", 8).alias("ctx")).agg(F.sum("n").alias("total"))
    top = [r[0] for r in contexts.orderBy(F.desc("total")).limit(nodes + 1).select("total").collect()]
    least = min(top) + 1 if len(top) > nodes else 1
    kept = contexts.where((F.col("total") >= least) | (F.col("d") == 0)).select("d", "ctx")
    rows = every.withColumn("ctx", F.shiftright("key", 8)).join(F.broadcast(kept), ["d", "ctx"], "left_semi")
    got = rows.select("d", "key", "n").toArrow()  # at most `nodes` contexts of at most 256 symbols
    return tuple(got.column(k).to_numpy() for k in range(3))  # type: ignore[return-value]


def _slice_counts(rows: pa.Table) -> pa.Table:
    """A slice's counts over all blocks, packed, for the tokens of each block; on the first row their sum and how many aren't 0."""
    parts, keys, n = _slice_grams(rows)
    sums = [[int(x)] + [0] * (len(parts) - 1) for x in (n.sum(), (n > 0).sum())]
    mine = [_planes(n[np.searchsorted(keys, x)]) for x in parts]
    return pa.table([rows.column("block"), rows.column("key"), pa.array(mine, pa.binary()), *(pa.array(x, pa.int64()) for x in sums)], ["block", "key", "more", "whole", "tokens"])


def _base(counts: pa.Table, texts: pa.Table) -> pa.Table:
    """For a block: per text its n_tokens, n_known and sum of log10(c + 0.5)."""
    counts = counts.sort_by("key")
    c = np.concatenate([np.zeros(0, np.int64), *(_unplanes(x, np.int64) for x in counts.column("more").to_pylist())])
    logs, known = np.log10(c + 0.5), c > 0
    ids = [_unpack(x) for x in texts.column("ids").to_pylist()]
    n = [pa.array([f(x) for x in ids], kind) for f, kind in ((len, pa.int64()), (lambda x: int(known[x].sum()), pa.int64()), (lambda x: float(logs[x].sum()), pa.float64()))]
    return pa.table([texts.column("mark"), *n], ["mark", "n_tokens", "n_known", "logs"])


def _bounded_scores(marked: DataFrame, stats: DataFrame, nodes: int, depth: int) -> DataFrame:
    """score and __bytes in place of the texts __t, by a model of at most `nodes` contexts."""
    counted = stats.where(F.col("kind") == 0).groupBy("key").agg(F.sum("n").alias("n"))
    sent = stats.sparkSession.sparkContext.broadcast(build(*tree_rows(counted, nodes, depth), depth))
    schema = marked.drop("__t").schema.add("score", "double").add("__bytes", "long")

    def score(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index("__t"))
            logs = [text_logs(sent.value, _as_bytes(_lower(texts.slice(i, j - i)))) for i, j in _slices(texts)]
            out = [pa.array(np.concatenate(logs or [np.zeros(0)])), pc.binary_length(texts).cast(pa.int64())]
            kept = b.drop_columns(["__t"])
            yield pa.RecordBatch.from_arrays([*kept.columns, *out], [*kept.schema.names, "score", "__bytes"])

    return marked.mapInArrow(score, schema)


def score_texts(docs: DataFrame, train: Column, text: str = "text", depth: int = DEPTH, nodes: int | None = None) -> DataFrame:
    """Add n_tokens, n_known, train_tokens, base_score, score and bits_per_byte to docs; the model and the base learn
    from the rows for which `train` holds. Columns of these names are replaced.

    score: log10 probability of the text, lower-cased (A-Z), as bytes, and of its end, under context-tree weighting of
    the training texts' statistics. base_score: that of its words and an end token, under smoothed unigrams. bits_per_byte:
    code length by the model, over bytes of the text and its end. Null texts count as empty; equal texts get equal
    results; without training texts all contexts predict 1/2 for each bit and base_score is 0. Empty tables stay empty.

    All contexts of up to `depth` bytes that the training texts have are in the model, or, if `nodes` is given, only so many
    of the most frequent.

    Statistics are gathered block by block of texts, summed over all blocks by key, and follow the corpus in size. So does
    the model, of which contexts of one byte, and of two where these are hot, alone are broadcast: longer ones are dealt into slices by
    their last two bytes, hot ones by three, and the probabilities of a block's symbols come back to it by a second shuffle. With `nodes` the model is broadcast whole. Word counts come
    back to the blocks they came from likewise, packed slice by slice.
    """
    if nodes is None and not TOP <= depth <= 5:
        raise ValueError(f"without a bound of nodes the depth must be {TOP} to 5 bytes")
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    usable = F.coalesce(train, F.lit(False))
    # what names a text: rows that agree in it have equal texts and so equal results
    mark = F.md5(body.cast("binary"))
    named = docs.select(mark.alias("mark"), usable.alias("train"), body.alias("t"))
    hot = None
    if nodes is None:
        pairs = named.select("t").mapInArrow(_pairs, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # 65,536 rows at most
        n = pairs.column("n").to_numpy()
        size = int(n.sum())
        hot = pairs.column("pair").to_numpy()[n > size // HOT_PAIRS] if depth > TOP else np.zeros(0, np.int64)
    else:
        size = named.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    slices = min(SLICES[1], max(SLICES[0], 2 * shuffle_partitions(spark), size // SLICE_BYTES))
    stats = materialize(named.mapInArrow(_stats(depth, slices, hot), _STATS))

    tokens = stats.where(F.col("kind") == 1).select("key", "block", "ids", "more").groupBy("key")
    totals = materialize(tokens.applyInArrow(_slice_counts, "block bigint, key bigint, more binary, whole bigint, tokens bigint"))
    whole, distinct = totals.agg(F.coalesce(F.sum("whole"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    texts = stats.where(F.col("kind") == 2).select("block", "mark", "ids")
    by_text = totals.select("block", "key", "more").groupBy("block").cogroup(texts.groupBy("block"))
    base = by_text.applyInArrow(_base, "mark string, n_tokens bigint, n_known bigint, logs double")
    if nodes is None:
        base = base.unionByName(whole_scores(stats, depth, slices), allowMissingColumns=True)
        base = base.groupBy("mark").agg(*[F.min(c).alias(c) for c in ("n_tokens", "n_known", "logs", "score")])
    else:
        base = base.groupBy("mark").agg(*[F.min(c).alias(c) for c in ("n_tokens", "n_known", "logs")])

    cols = [c for c in docs.columns if c not in ("n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")]
    if nodes is None:
        scored = docs.select(*cols, mark.alias("__mark"), F.octet_length(body).cast("long").alias("__bytes"))
    else:
        scored = _bounded_scores(docs.select(*cols, body.alias("__t"), mark.alias("__mark")), stats, nodes, depth)
    norm = math.log10(whole + 0.5 * (distinct + 1))
    joined = scored.join(base, F.col("__mark") == F.col("mark"))
    return joined.select(
        *cols, "n_tokens", "n_known", F.lit(whole).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(norm)).alias("base_score"), "score",
        (-F.col("score") * F.lit(math.log2(10)) / (F.col("__bytes") + 1)).alias("bits_per_byte"),
    )
