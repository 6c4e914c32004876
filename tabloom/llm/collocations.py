"""Operator 13: phrases that are more frequent than their parts suggest, from suffix arrays of word ids per shard."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.llm.common import discard, gapless_rank, hot_join, materialize

#: Bytes of text in a shard. Longer texts are cut where a piece ends, since no phrase crosses that.
SHARD_BYTES = 2 << 20
#: So many hashes, or phrases with their ids, go to every task (12 or 16 bytes each); more of them meet the shards by a shuffle. Words go so if they take
#: WORD_BYTES each on average at most.
BROADCAST_HASHES, WORD_BYTES = 2_000_000, 16
#: Texts, and shards, that a task looks at together.
TEXTS_AT_ONCE, SHARDS_AT_ONCE = 1_000, 3
#: Hashes or phrases of several shards that a task merges before it hands them on.
HELD_HASHES, HELD_PHRASES = 2_000_000, 400_000
#: Phrases in a row of counts.
ROW_PHRASES = 50_000
#: Bytes of a row group of shards: a task holds the columns of one, compressed.
GROUP_BYTES = 16 << 20
#: Bits of the hashes by which words are first merged; words that share one only pass together.
HASH_BITS = 40

#: A cut's score; 1000 * a * n may pass 64 bits, and a quotient of decimals without scale is exact.
SCORE = "(1000BD * cast({a} as decimal(15,0)) * cast({n} as decimal(18,0))) div (cast({l} as decimal(18,0)) * cast({r} as decimal(18,0)))"

_WORD, _BLANK, _BREAK = range(3)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_CLASS = np.full(256, _WORD, np.uint8)
_CLASS[[0x20, 0x09]] = _BLANK
_CLASS[[*b".,;:!?", *range(0x0A, 0x0E)]] = _BREAK

_SHARD = "shard long, tokens binary, starts binary, words binary, langs binary, names array<string>"
_NUMBERED = "shard long, tokens binary, starts binary, ids binary, heads binary"
_FOUND = "lang array<string>, phrase array<string>, n array<long>, h array<long>"
_STRINGS, _LONGS = pa.list_(pa.string()), pa.list_(pa.int64())
_SHARD_ARROW = pa.schema([("shard", pa.int64()), ("tokens", pa.binary()), ("starts", pa.binary()), ("words", pa.binary()), ("langs", pa.binary()), ("names", _STRINGS)])
_NUMBERED_ARROW = pa.schema([("shard", pa.int64()), ("tokens", pa.binary()), ("starts", pa.binary()), ("ids", pa.binary()), ("heads", pa.binary())])
_FOUND_ARROW = pa.schema([("lang", _STRINGS), ("phrase", _STRINGS), ("n", _LONGS), ("h", _LONGS)])
_TOTAL_ARROW = pa.schema([("total_lang", _STRINGS), ("total_n", _LONGS)])


def _cuts(data: np.ndarray, offsets: np.ndarray, at_once: int) -> Iterator[tuple[int, int]]:
    """(from, to) bytes of slices of about at_once: at ends of texts, or within a long one after a byte that ends a piece."""
    start, end = int(offsets[0]), int(offsets[-1])
    while start < end:
        stop = min(start + at_once, end)
        if stop < end:
            text = int(offsets[np.searchsorted(offsets, stop, "right") - 1])  # the last text's begin
            if text > start:
                stop = text
            else:
                breaks = np.flatnonzero(_CLASS[data[start:stop]] == _BREAK)
                while not len(breaks) and stop < end and stop not in offsets:
                    step = min(stop + at_once, int(offsets[np.searchsorted(offsets, stop, "right")]))
                    breaks = np.flatnonzero(_CLASS[data[stop:step]] == _BREAK) + (stop - start)
                    stop = step
                stop = start + int(breaks[-1]) + 1 if len(breaks) else stop
        yield start, stop
        start = stop


def shard_tokens(data: np.ndarray, text_starts: np.ndarray, text_langs: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Tokens of a slice of texts as ids from 1, with 0 after each piece, the words of the ids, and their langs (numbers as in text_langs)."""
    kind = _CLASS[data]
    inside = kind == _WORD
    first = np.zeros(len(data), bool)
    first[text_starts[text_starts < len(data)]] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | first[1:]
    at = np.flatnonzero(begins)
    if not len(at):
        return np.zeros(0, np.int32), [], np.zeros(0, np.int32)
    offsets = np.concatenate([[0], np.cumsum(np.flatnonzero(stops) + 1 - at)])
    spelled = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(_LOWER[data[inside]])])
    coded = spelled.dictionary_encode()
    piece = np.cumsum((kind == _BREAK) | first, dtype=np.int32)[at]
    lang = text_langs[np.searchsorted(text_starts, at, "right") - 1].astype(np.int64)
    pairs, ids, often = np.unique(lang * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True)
    common = np.argsort(-often, kind="stable")  # common words get small ids
    place = np.empty(len(common), np.int64)
    place[common] = np.arange(len(common))
    pairs, ids = pairs[common], place[ids]
    ends = np.flatnonzero(np.concatenate([piece[1:] != piece[:-1], [True]]))
    tokens = np.insert(ids.astype(np.int32) + 1, ends + 1, 0)
    words = coded.dictionary.take(pa.array(pairs % len(coded.dictionary)))
    return tokens, words, (pairs // len(coded.dictionary)).astype(np.int32)


def ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, ranks): places by key, equal ones by place, and the key's rank, equal ones alike. Key and place are sorted as one number where they fit."""
    n, bits = len(key), int(len(key)).bit_length()
    if not n or int(key.max()).bit_length() + bits > 62:
        return np.argsort(key, kind="stable"), np.unique(key, return_inverse=True)[1]
    both = (key << bits) | np.arange(n)
    both.sort()
    order, key = both & ((1 << bits) - 1), both >> bits
    ranks = np.empty(n, np.int64)
    ranks[order] = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
    return order, ranks


class Suffixes:
    """Suffix array of word ids (0 ends a piece) by prefix doubling, as deep as `depth` words, of the places in `of`."""

    def __init__(self, tokens: np.ndarray, depth: int, of: np.ndarray):
        n = len(tokens)
        ends = np.flatnonzero(tokens == 0)
        #: Words from each place to its piece's end.
        self.left = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(n) if n else np.zeros(0, int)
        self.ranks, width, rank = {1: tokens.astype(np.int64)}, 1, tokens.astype(np.int64)
        while width < depth:
            step = min(width, depth - width)  # the second half may overlap the first
            behind = np.zeros(n, np.int64)
            behind[: n - step] = rank[step:]
            behind[self.left <= step] = 0
            rank = ranked(rank * (int(rank.max(initial=0)) + 1) + behind)[1]
            width += step
            self.ranks[width] = rank
        places = np.flatnonzero(of)
        self.places = places[ranked(rank[places])[0]]
        self.depth = depth
        self.lcp = self._lcp()

    def _lcp(self) -> np.ndarray:
        """Words that each suffix shares with the one before it in the array."""
        here, before = self.places[1:], self.places[:-1]
        shared = np.zeros(len(here), np.int64)
        last = len(self.left) - 1
        for width in sorted((w for w in self.ranks if w & (w - 1) == 0), reverse=True):
            a, b = np.minimum(here + shared, last), np.minimum(before + shared, last)
            shared += width * ((self.ranks[width][a] == self.ranks[width][b]) & (self.ranks[1][a] > 0))
        shared = np.minimum(np.minimum(shared, self.depth), np.minimum(self.left[here], self.left[before]))
        return np.concatenate([[0], shared])[: len(self.places)]

    def intervals(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The phrases of k words as intervals in which neighbours share k words: a place and the size of each, then all places with k words
        left and their intervals' numbers. Suffixes that end earlier sort before an interval, never into it."""
        whole = self.left[self.places] >= k
        places = self.places[whole]
        new = self.lcp[whole] < k
        number = np.cumsum(new) - 1
        return places[new], np.bincount(number, minlength=int(new.sum())), places, number


_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bytes_hash(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64 bits of each string's bytes and their places; none is empty."""
    size = np.diff(offsets)
    if not len(size):
        return np.zeros(0, np.uint64)
    at = np.arange(len(data)) - np.repeat(offsets[:-1], size)
    weight = _POWERS[at % 64] + at.astype(np.uint64) // np.uint64(64) * np.uint64(0xD1342543DE82EF95)
    return _mixed(np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * weight, offsets[:-1]) + size.astype(np.uint64))


def _hashes(words: pa.Array, langs: np.ndarray, names: list[str]) -> np.ndarray:
    """Of each word in its lang."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[: len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[: offsets[-1]]
    return _mixed(_bytes_hash(data, offsets) + pd.util.hash_array(np.array(names, object))[langs]) if len(words) else np.zeros(0, np.uint64)


def _phrase_hash(word_hash: np.ndarray, tokens: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    out = np.full(len(at), k, np.uint64)
    for i in range(k):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + word_hash[tokens[at + i] - 1]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return (out >> np.uint64(64 - HASH_BITS)).view(np.int64)


def _spell(words: pa.Array, tokens: np.ndarray, at: np.ndarray, k: int) -> pa.Array:
    parts = [words.take(pa.array(tokens[at + i] - 1)) for i in range(k)]
    return pc.binary_join_element_wise(*parts, pa.scalar(" ", words.type)) if k > 1 else parts[0]


def _pack(numbers: np.ndarray) -> bytes:
    """Token ids, their low bytes first and then the higher ones, compressed: common words have small ids, so that most high bytes are 0."""
    most = int(numbers.max(initial=0))
    width = 2 if most < 1 << 16 else 4 if most < 1 << 31 else 8
    planes = numbers.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return bytes([width]) + zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    width = packed[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed[1:]), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int32 if width < 8 else np.int64)


def _zipped(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _unzipped(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)


def _packed(shard: int, tokens: np.ndarray, starts: np.ndarray, words: pa.Array, langs: np.ndarray, names: list[str]) -> dict:
    """A row of _SHARD: tokens, the places at which phrases may begin, the words of the ids, each with a blank behind it, and their langs as places in
    names. It is a few binary values, since a reader holds thousands of array elements a word apiece."""
    spelled = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.binary())), b" ")[0].as_py() + b" " if len(words) else b""
    return {"shard": shard, "tokens": _pack(tokens), "starts": _zipped(np.packbits(starts).tobytes()), "words": _zipped(spelled), "langs": _pack(langs), "names": names}


def _unpacked(batch: pa.RecordBatch, i: int) -> tuple[int, np.ndarray, np.ndarray, pa.Array, np.ndarray, list[str]]:
    """Number, tokens, places, words, their langs' places in the names, and these."""
    row = {c: batch.column(c)[i].as_py() for c in ("shard", "tokens", "starts", "words", "langs", "names")}
    tokens = _unpack(row["tokens"])
    starts = np.unpackbits(_unzipped(row["starts"]), count=len(tokens)).astype(bool)
    spelled = _unzipped(row["words"])
    ends = np.flatnonzero(spelled == 0x20)
    offsets = np.concatenate([[0], ends - np.arange(len(ends))]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(spelled[spelled != 0x20]))])
    return row["shard"], tokens, starts, words, _unpack(row["langs"]), row["names"]


def _numbered_row(shard: int, tokens: np.ndarray, starts: np.ndarray, ids: np.ndarray, heads: np.ndarray | None) -> dict:
    """A row of _NUMBERED: instead of words it has their ids, and heads are the ids of the phrases of one word less at the places in starts (null: words)."""
    return {"shard": shard, "tokens": _pack(tokens), "starts": _zipped(np.packbits(starts).tobytes()), "ids": _pack(ids), "heads": None if heads is None else _pack(heads)}


def _numbered_shard(batch: pa.RecordBatch, i: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number, tokens, places, ids of the words, and heads, by place (-1 where no phrase may begin)."""
    row = {c: batch.column(c)[i].as_py() for c in ("shard", "tokens", "starts", "ids", "heads")}
    tokens, ids = _unpack(row["tokens"]), _unpack(row["ids"]).astype(np.int64)
    starts = np.unpackbits(_unzipped(row["starts"]), count=len(tokens)).astype(bool)
    heads = np.full(len(tokens), -1, np.int64)
    heads[starts] = ids[tokens[starts] - 1] if row["heads"] is None else _unpack(row["heads"])
    return row["shard"], tokens, starts, ids, heads


def _batch(row: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({f.name: pa.array([row[f.name]], f.type) for f in schema}, schema)


def _first(batches: Iterator[pa.RecordBatch], at_once: int) -> Iterator[pa.RecordBatch]:
    """Texts to shards and how many words each lang has in them."""
    from pyspark import TaskContext

    base, made = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        texts, lang = pc.fill_null(batch.column(0).cast(pa.large_binary()), b""), pc.fill_null(batch.column(1), "und").dictionary_encode()
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data, numbers, names = np.frombuffer(texts.buffers()[2] or b"", np.uint8), lang.indices.to_numpy(zero_copy_only=False), lang.dictionary.to_pylist()
        for start, stop in _cuts(data, offsets, at_once):
            first, end = np.searchsorted(offsets, start, "right") - 1, np.searchsorted(offsets, stop, "left")
            tokens, words, of = shard_tokens(data[start:stop], np.maximum(offsets[first:end] - start, 0), numbers[first:end])
            if len(tokens):
                each = np.bincount(of[tokens[tokens > 0] - 1], minlength=len(names))
                row = _packed(base + made, tokens, tokens > 0, words, of, names) | {"total_lang": names, "total_n": each}
                yield _batch(row, pa.schema([*_SHARD_ARROW, *_TOTAL_ARROW]))
                made += 1


def _hashed(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The phrases of k words of each shard: their numbers in it and hashes."""
    for batch in batches:
        for i in range(batch.num_rows):
            shard, tokens, starts, *words = _unpacked(batch, i)
            at = Suffixes(tokens, k, starts).intervals(k)[0]
            h = _phrase_hash(_hashes(*words), tokens, at, k)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard)), pa.array(np.arange(len(at), dtype=np.int32)), pa.array(h)], ["shard", "number", "h"])


def _counted(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Hashes and counts of the phrases of k words, merged over shards."""

    def counts():
        for batch in batches:
            for i in range(batch.num_rows):
                _, tokens, starts, *words = _unpacked(batch, i)
                at, count, _, _ = Suffixes(tokens, k, starts).intervals(k)
                yield _phrase_hash(_hashes(*words), tokens, at, k), count.astype(np.int64)

    return _merged(counts())


def _counted_keys(batches: Iterator[pa.RecordBatch], k: int, words: int) -> Iterator[pa.RecordBatch]:
    """Keys and counts of the phrases of k words, merged over shards."""

    def counts():
        for batch in batches:
            for i in range(batch.num_rows):
                _, tokens, starts, ids, heads = _numbered_shard(batch, i)
                at, count, _, _ = Suffixes(tokens, k, starts).intervals(k)
                yield _keys(tokens, ids, heads, at, k, words), count.astype(np.int64)

    return _merged(counts())


def _keys(tokens: np.ndarray, ids: np.ndarray, heads: np.ndarray, at: np.ndarray, k: int, words: int) -> np.ndarray:
    """Of the phrases of k words at these places: the id of the first k - 1 words and the last word's in one number, which no other phrase has."""
    return heads[at] * words + ids[tokens[at + k - 1] - 1]


def _merged(counts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for one in counts:
        held.append(one)
        if sum(len(h) for h, _ in held) > HELD_HASHES:
            held = [_summed(held)]
            if len(held[0][0]) > HELD_HASHES // 2:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, held[0])), ["h", "c"])
                held = []
    if held:
        yield pa.RecordBatch.from_arrays(list(map(pa.array, _summed(held))), ["h", "c"])


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    h, c = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(h)
    h, c = h[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
    return h[first], np.add.reduceat(c, first) if len(h) else c


def _found_rows(held: pa.Table, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Counts as rows of arrays, without a shard."""
    for start in range(0, held.num_rows, ROW_PHRASES):
        part = held.slice(start, ROW_PHRASES)
        row = {c: part.column(c).combine_chunks() for c in part.column_names}
        at = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        yield pa.RecordBatch.from_arrays([at(row[f.name].cast(f.type.value_type)) if f.name in row else pa.nulls(1, f.type) for f in schema], schema=schema)


def _next(batches: Iterator[pa.RecordBatch], k: int, longest: int, often: np.ndarray | None, tasks: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """The counts of the phrases of k words that were kept (their hashes are in `often`, sorted, or their numbers in a shard in its column kept), merged
    over shards in rows of their own, and, but for the last k, each shard cut down to where phrases of k + 1 words may be. With `tasks`, which are those that
    shall spell each hash, or else a column `spelled` of numbers, only phrases of a task's own are in those rows."""
    last = k == longest
    schema = _FOUND_ARROW if last else pa.schema([*_SHARD_ARROW, *_FOUND_ARROW])
    held: list[pa.Table] = []

    def merged() -> pa.Table:
        return _by_phrase(held)

    for batch in batches:
        for i in range(batch.num_rows):
            shard, tokens, allowed, words, langs, names = _unpacked(batch, i)
            at, count, places, number = Suffixes(tokens, k, allowed).intervals(k)
            kept = np.zeros(len(at), bool)
            h = _phrase_hash(_hashes(words, langs, names), tokens, at, k)
            if often is None:
                kept[batch.column("kept")[i].values.to_numpy()] = True
                own = np.zeros(len(at), bool)
                own[batch.column("spelled")[i].values.to_numpy()] = True
            else:
                kept, near = _among(often, h)
                own = kept if tasks is None or not len(often) else kept & (tasks[near] == batch.column("task")[i].as_py())
            at, count, h = at[own], count[own], h[own]
            if len(at):
                lang = pa.array(names, pa.large_string()).take(pa.array(langs[tokens[at] - 1]))
                held.append(pa.table({"lang": lang, "phrase": _spell(words, tokens, at, k), "n": count.astype(np.int64), "h": h}))
            if sum(t.num_rows for t in held) > HELD_PHRASES:
                held = [merged()]
                if held[0].num_rows > HELD_PHRASES // 2:
                    yield from _found_rows(held[0], schema)
                    held = []
            if not last:
                starts = np.zeros(len(tokens) + 1, bool)
                starts[places[kept[number]]] = True
                follow = starts[:-1] & starts[1:]  # phrases of k + 1 words of which both parts are left
                if not follow.any():
                    continue
                tokens, follow, keep = _compact(tokens, follow, k + 1)
                row = _packed(shard, tokens, follow, words.take(pa.array(keep)), langs[keep], names)
                yield _batch(row | {f.name: None for f in _FOUND_ARROW}, schema)
    if held:
        yield from _found_rows(merged(), schema)


def _by_phrase(held: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(held).group_by(["lang", "phrase", "h"]).aggregate([("n", "sum")]).select(["lang", "phrase", "n_sum", "h"]).rename_columns(["lang", "phrase", "n", "h"])


def _among(often: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of h are among `often`, sorted, and where."""
    if not len(often):
        return np.zeros(len(h), bool), np.zeros(len(h), int)
    near = np.minimum(np.searchsorted(often, h), len(often) - 1)
    return often[near] == h, near


def _strays(batches: Iterator[pa.RecordBatch], often: np.ndarray, known: tuple[np.ndarray, np.ndarray, pa.Array]) -> Iterator[pa.RecordBatch]:
    """Counts of the words that passed by their hash but aren't known, merged over shards: they share it with another word, or nobody has spelled them."""
    held: list[pa.Table] = []
    for batch in batches:
        for i in range(batch.num_rows):
            _, tokens, starts, words, langs, names = _unpacked(batch, i)
            h = _phrase_hash(_hashes(words, langs, names), np.arange(1, len(words) + 1), np.arange(len(words)), 1)
            stray = np.flatnonzero(_among(often, h)[0] & (_word_ids(words, langs, names, known) < 0))
            if len(stray):
                n = np.bincount(tokens[starts], minlength=len(words) + 1)[1:][stray]
                lang = pa.array(names, pa.large_string()).take(pa.array(langs[stray]))
                held.append(pa.table({"lang": lang, "phrase": words.take(pa.array(stray)), "n": n.astype(np.int64), "h": h[stray]}))
            if sum(t.num_rows for t in held) > HELD_PHRASES:
                yield from _plain_rows(_by_phrase(held))
                held = []
    if held:
        yield from _plain_rows(_by_phrase(held))


def _plain_rows(held: pa.Table) -> Iterator[pa.RecordBatch]:
    strings = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64()), ("h", pa.int64())])
    yield from held.cast(strings).to_batches(ROW_PHRASES)


def _compact(tokens: np.ndarray, follow: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Only what the phrases of k words cover that begin at `follow`, these places, and the words that are used; whatever lies between becomes one end of a piece."""
    covered = follow.copy()
    for j in range(1, min(k, len(follow))):
        covered[j:] |= follow[:-j]
    ends = np.concatenate([[False], covered[:-1]]) & ~covered
    stay = covered | ends
    used = np.zeros(int(tokens.max(initial=0)) + 1, bool)
    tokens, follow = np.where(covered, tokens, 0)[stay], follow[stay]
    used[tokens] = True
    used[0] = True
    return (np.cumsum(used) - 1)[tokens], follow, np.flatnonzero(used)[1:] - 1


def _with_lang(words: pa.Array, langs: np.ndarray, names: list[str]) -> pa.Array:
    """No word holds a blank, so that word and lang are told apart."""
    return pc.binary_join_element_wise(words, pa.array(names, words.type).take(pa.array(langs)), pa.scalar(" ", words.type))


def _vocabulary(table: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """lang, phrase and id of words as (hashes, sorted, ids, words with their langs)."""
    lang = table.column("lang").combine_chunks().dictionary_encode()
    langs, names = lang.indices.to_numpy(zero_copy_only=False), lang.dictionary.to_pylist()
    words = pa.concat_arrays([pa.array([], pa.large_string()), *table.column("phrase").cast(pa.large_string()).chunks])
    h = _hashes(words, langs, names)
    order = np.argsort(h)
    return h[order], table.column("id").to_numpy()[order], _with_lang(words, langs, names).take(pa.array(order))


def _word_ids(words: pa.Array, langs: np.ndarray, names: list[str], vocabulary: tuple[np.ndarray, np.ndarray, pa.Array]) -> np.ndarray:
    """Ids of a shard's words, -1 for those that the vocabulary lacks; words that share a hash are told apart."""
    hashes, ids, known = vocabulary
    out = np.full(len(words), -1, np.int64)
    if not len(words):
        return out
    h, spelled, left = _hashes(words, langs, names), _with_lang(words, langs, names), np.arange(len(words))
    at = np.searchsorted(hashes, h)
    while True:
        there = at < len(hashes)
        there[there] = hashes[at[there]] == h[left[there]]
        left, at = left[there], at[there]
        if not len(left):
            return out
        same = pc.equal(known.take(pa.array(at)), spelled.take(pa.array(left))).to_numpy(zero_copy_only=False)
        out[left[same]] = ids[at[same]]
        left, at = left[~same], at[~same] + 1


def _of_kept(batch: pa.RecordBatch, i: int, n: int) -> np.ndarray:
    """The ids that a join has found for n numbers, else -1."""
    kept, out = batch.column("kept")[i].values, np.full(n, -1, np.int64)
    out[kept.field("number").to_numpy()] = kept.field("id").to_numpy()
    return out


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each shard, their hashes and counts."""
    for batch in batches:
        for i in range(batch.num_rows):
            shard, tokens, starts, words, langs, names = _unpacked(batch, i)
            lang = pa.array(names, pa.string()).take(pa.array(langs))
            h = _phrase_hash(_hashes(words, langs, names), np.arange(1, len(words) + 1), np.arange(len(words)), 1)
            n = np.bincount(tokens[starts], minlength=len(words) + 1)[1:]
            columns = [np.full(len(words), shard), np.arange(len(words), dtype=np.int32), lang, words.cast(pa.string()), h, n]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["shard", "number", "lang", "phrase", "h", "n"])


def _numbered(batches: Iterator[pa.RecordBatch], vocabulary: tuple[np.ndarray, np.ndarray, pa.Array] | None) -> Iterator[pa.RecordBatch]:
    """Shards of words as shards of ids (of the vocabulary, or those in the column kept), cut down to where two such words meet."""
    for batch in batches:
        for i in range(batch.num_rows):
            shard, tokens, starts, words, langs, names = _unpacked(batch, i)
            ids = _of_kept(batch, i, len(words)) if vocabulary is None else _word_ids(words, langs, names, vocabulary)
            known = np.concatenate([[False], ids >= 0])[tokens]
            follow = starts & known & np.append(known[1:], False)
            if follow.any():
                tokens, follow, keep = _compact(tokens, follow, 2)
                yield _batch(_numbered_row(shard, tokens, follow, ids[keep], None), _NUMBERED_ARROW)


def _keyed(batches: Iterator[pa.RecordBatch], k: int, words: int) -> Iterator[pa.RecordBatch]:
    """The phrases of k words of each shard: their numbers in it and keys."""
    for batch in batches:
        for i in range(batch.num_rows):
            shard, tokens, starts, ids, heads = _numbered_shard(batch, i)
            at = Suffixes(tokens, k, starts).intervals(k)[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard)), pa.array(np.arange(len(at), dtype=np.int32)), pa.array(_keys(tokens, ids, heads, at, k, words))], ["shard", "number", "h"])


def _next_numbered(batches: Iterator[pa.RecordBatch], k: int, words: int, often: tuple[np.ndarray, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
    """Each shard cut down to where phrases of k + 1 words may be, with the ids of the phrases of k words there (of `often`, sorted keys and their ids, or
    those in the column kept)."""
    for batch in batches:
        for i in range(batch.num_rows):
            shard, tokens, starts, ids, heads = _numbered_shard(batch, i)
            at, _, places, number = Suffixes(tokens, k, starts).intervals(k)
            if often is None:
                of = _of_kept(batch, i, len(at))
            elif len(often[0]):
                key = _keys(tokens, ids, heads, at, k, words)
                near = np.minimum(np.searchsorted(often[0], key), len(often[0]) - 1)
                of = np.where(often[0][near] == key, often[1][near], -1)
            else:
                continue
            phrase = np.full(len(tokens) + 1, -1, np.int64)
            phrase[places] = of[number]
            follow = (phrase[:-1] >= 0) & (phrase[1:] >= 0)
            if follow.any():
                new = phrase[:-1][follow]
                tokens, follow, keep = _compact(tokens, follow, k + 1)
                yield _batch(_numbered_row(shard, tokens, follow, ids[keep], new), _NUMBERED_ARROW)


@contextmanager
def _rows_at_once(spark: SparkSession, rows: int):
    """Jobs within read and hand so many rows at once to Python: a shard takes some MB in a row, so that thousands, as usual, are a whole partition."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = [spark.conf.get(name) for name in names]
    for name in names:
        spark.conf.set(name, rows)
    try:
        yield
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 5, least: int = 100, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals). phrases: lang, k, phrase, f for every phrase of 1 to `longest` words that occurs `least` times in a
    lang; totals: lang, n (all word occurrences).

    Each shard of texts becomes word ids, a suffix array by prefix doubling, and counts from its LCP intervals; counts are merged by
    key over all shards. So that not every word that occurs once must be shuffled as text, words are first merged by a hash alone; those that pass
    are spelled by one task each (see _words) and numbered. A longer phrase is only looked at where both its parts of one word less passed. Its key is the number of its first
    part and that of its last word, so that keys, which no two phrases share, are all that tasks hand on; each phrase that passed is spelled once, from
    its key. That loses none that occurs `least` times. Hashes, words and keys that passed are broadcast if they are BROADCAST_HASHES at most; else
    they are joined to the shards. Keys are 64 bits: phrases that pass, times words that pass, must stay under 2^63, which holds up to 3e11 words at a least count of 100.
    """
    spark = docs.sparkSession
    read = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    with _rows_at_once(spark, TEXTS_AT_ONCE):
        shards = materialize(read.mapInArrow(lambda batches: _first(batches, shard_bytes), f"{_SHARD}, total_lang array<string>, total_n array<long>"), GROUP_BYTES)
    totals = shards.select(F.explode(F.arrays_zip("total_lang", "total_n")).alias("x")).groupBy(F.col("x.total_lang").alias("lang")).agg(F.sum("x.total_n").alias("n")).where("n > 0")
    totals = materialize(totals)
    shards, exact = _words(shards, longest, least)
    vocabulary = materialize(gapless_rank(exact, [], ["lang", "phrase"], "id").withColumn("k", F.lit(1)))
    found = [vocabulary]
    if longest > 1:
        shards = _to_numbers(shards, vocabulary)
    words = vocabulary.count()
    for k in range(2, longest + 1):
        if found[-1].count() * words >= 1 << 63:
            raise ValueError("phrases and words that pass are too many for keys of 64 bits")
        counted = shards.mapInArrow(lambda batches, k=k: _counted_keys(batches, k, words), "h long, c long")
        with _rows_at_once(spark, SHARDS_AT_ONCE):
            passed = materialize(counted.groupBy("h").agg(F.sum("c").alias("f")).where(F.col("f") >= least))
            phrases = materialize(_spell_keys(passed, found[-1], vocabulary, words, k))
        found.append(phrases)
        if k < longest:
            shards = _cut_down(shards, phrases, k, words)
    return reduce(DataFrame.unionByName, [p.select("lang", "k", "phrase", "f") for p in found]), totals


def _words(shards: DataFrame, longest: int, least: int) -> tuple[DataFrame, DataFrame]:
    """The shards cut down to where words that passed by their hash meet, and lang, phrase and f of the words that passed.

    A hash's words are spelled by one of the tasks that have it, so that words aren't handed on once for each task. Of a hash of which one word
    was spelled, that one has the hash's count less that of its strays, which each task counts by themselves; so have all words of other hashes.
    """
    spark = shards.sparkSession
    state = shards.select("shard", "tokens", "starts", "words", "langs", "names", F.spark_partition_id().alias("task"))
    counted = state.mapInArrow(lambda batches: _counted(batches, 1), "h long, c long").withColumn("task", F.spark_partition_id())
    with _rows_at_once(spark, SHARDS_AT_ONCE):
        often = materialize(counted.groupBy("h").agg(F.sum("c").alias("n"), F.min("task").alias("task")).where(F.col("n") >= least))
    small = often.count() <= BROADCAST_HASHES
    if small:
        h, tasks = (often.select("h", "task").toArrow().column(c).to_numpy() for c in ("h", "task"))
        order = np.argsort(h)
        sent = spark.sparkContext.broadcast((h[order], tasks[order]))
        step = state.mapInArrow(lambda batches: _next(batches, 1, longest, *sent.value), _next_schema(1, longest))
    else:
        hashed = state.mapInArrow(lambda batches: _hashed(batches, 1), "shard long, number int, h long").withColumn("task", F.spark_partition_id())
        passed = hashed.join(often.select("h", F.col("task").alias("by")), "h")
        kept = passed.groupBy("shard").agg(F.collect_list("number").alias("kept"), F.collect_list(F.when(F.col("task") == F.col("by"), F.col("number"))).alias("spelled"))
        step = state.join(kept, "shard").mapInArrow(lambda batches: _next(batches, 1, longest, None), _next_schema(1, longest))
    with _rows_at_once(spark, SHARDS_AT_ONCE):
        cut = materialize(step, GROUP_BYTES)
    each = cut.where("n is not null").select(F.explode(F.arrays_zip("lang", "phrase", "h")).alias("x")).select("x.*").distinct()
    alone = each.groupBy("h").agg(F.first("lang").alias("lang"), F.first("phrase").alias("phrase"), F.count("*").alias("words")).where("words = 1").drop("words")
    known = materialize(alone.join(often.select("h", "n"), "h"))
    if small and _fits(known):
        names = spark.sparkContext.broadcast(_vocabulary(known.select("lang", "phrase", F.lit(0).cast("long").alias("id")).toArrow()))
        strays = state.mapInArrow(lambda batches: _strays(batches, sent.value[0], names.value), "lang string, phrase string, n long, h long")
    else:
        spelled = state.mapInArrow(_spelled, "shard long, number int, lang string, phrase string, h long, n long")
        strays = spelled.join(often.select("h"), "h", "left_semi").join(known.select("lang", "phrase"), ["lang", "phrase"], "left_anti").select("lang", "phrase", "n", "h")
    both = known.select("lang", "phrase", "n", "h", F.lit(False).alias("stray")).unionByName(strays.withColumn("stray", F.lit(True)))
    summed = both.groupBy("h", "stray", "lang", "phrase").agg(F.sum("n").alias("n"))
    of_strays = F.coalesce(F.sum(F.when(F.col("stray"), F.col("n"))).over(Window.partitionBy("h")), F.lit(0))
    f = F.when(F.col("stray"), F.col("n")).otherwise(F.col("n") - of_strays)
    with _rows_at_once(spark, SHARDS_AT_ONCE):
        exact = materialize(summed.withColumn("f", f).where(F.col("f") >= least).select("lang", "phrase", "f"))
    discard(shards)  # its counts and what is left of it have been written
    return cut, exact


def _fits(words: DataFrame) -> bool:
    """Whether words may be broadcast."""
    n, size = words.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("phrase")), F.lit(0))).first()
    return n <= BROADCAST_HASHES and size <= WORD_BYTES * BROADCAST_HASHES


def _to_numbers(shards: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The shards as _NUMBERED."""
    spark = shards.sparkSession
    state = shards.select("shard", "tokens", "starts", "words", "langs", "names").where("shard is not null")
    if _fits(vocabulary):
        sent = spark.sparkContext.broadcast(_vocabulary(vocabulary.select("lang", "phrase", "id").toArrow()))
        step = state.mapInArrow(lambda batches: _numbered(batches, sent.value), _NUMBERED)
    else:
        spelled = state.mapInArrow(_spelled, "shard long, number int, lang string, phrase string, h long, n long")
        step = state.join(_kept(spelled, vocabulary, ["lang", "phrase"]), "shard").mapInArrow(lambda batches: _numbered(batches, None), _NUMBERED)
    with _rows_at_once(spark, SHARDS_AT_ONCE):
        out = materialize(step, GROUP_BYTES)
    discard(shards)
    return out


def _cut_down(shards: DataFrame, phrases: DataFrame, k: int, words: int) -> DataFrame:
    """The shards for phrases of k + 1 words."""
    spark = shards.sparkSession
    if phrases.count() <= BROADCAST_HASHES:
        h, ids = (phrases.select("h", "id").toArrow().column(c).to_numpy() for c in ("h", "id"))
        order = np.argsort(h)
        sent = spark.sparkContext.broadcast((h[order], ids[order]))
        step = shards.mapInArrow(lambda batches: _next_numbered(batches, k, words, sent.value), _NUMBERED)
    else:
        keyed = shards.mapInArrow(lambda batches: _keyed(batches, k, words), "shard long, number int, h long")
        step = shards.join(_kept(keyed, phrases, ["h"]), "shard").mapInArrow(lambda batches: _next_numbered(batches, k, words, None), _NUMBERED)
    with _rows_at_once(spark, SHARDS_AT_ONCE):
        out = materialize(step, GROUP_BYTES)
    discard(shards)
    return out


def _kept(of_shards: DataFrame, ids: DataFrame, on: list[str]) -> DataFrame:
    return of_shards.join(ids.select(*on, "id"), on).groupBy("shard").agg(F.collect_list(F.struct("number", "id")).alias("kept"))


def _spell_keys(passed: DataFrame, shorter: DataFrame, vocabulary: DataFrame, words: int, k: int) -> DataFrame:
    """lang, phrase, f, h (the key), id and k of the keys that passed."""
    parts = gapless_rank(passed, [], ["h"], "id").withColumn("head", F.expr(f"h div {max(words, 1)}L")).withColumn("tail", F.expr(f"h % {max(words, 1)}L"))
    first = shorter.select(F.col("id").alias("head"), "lang", F.col("phrase").alias("first"))
    last = vocabulary.select(F.col("id").alias("tail"), F.col("phrase").alias("last"))
    spelled = parts.join(first, "head").join(last, "tail")
    return spelled.select("lang", F.concat_ws(" ", "first", "last").alias("phrase"), "f", "h", "id", F.lit(k).alias("k"))


def _next_schema(k: int, longest: int) -> str:
    return _FOUND if k == longest else f"{_SHARD}, {_FOUND}"


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 5, least: int = 100, first: int = 2_000, absorb: int = 100, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The `first` best phrases of 2 to `longest` words of each lang: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A to Z), cut into pieces at `.,;:!?` and line ends, and those into words at blanks. a is how often the
    phrase occurs within pieces, n all words of the lang, l and r how often the two parts occur of the cut that scores lowest,
    score = floor(1000 * a * n / (l * r)); equal scores go to the shorter first part. A phrase goes if a longer one that
    contains it occurs at least `absorb` percent as often; it is enough to look at those of one word more, since any
    longer one contains such a phrase that is no rarer. Products are decimals of 38 digits.

    Null texts are empty, null langs are `und`; texts without words add nothing; repeated rows count each time; an empty table
    gives no rows; other columns of docs are ignored, whatever their names. Ties in score go to the larger a, then the
    smaller phrase by bytes. A piece longer than a shard stays whole.
    """
    phrases, totals = phrase_counts(docs, text, lang, longest, least, shard_bytes)
    split = phrases.withColumn("words", F.split("phrase", " "))
    part = lambda start, size: F.array_join(F.slice("words", start, size), " ")
    longer = split.where("k > 2").select("lang", F.col("f"), F.explode(F.array(part(F.lit(1), F.col("k") - 1), part(F.lit(2), F.col("k") - 1))).alias("phrase"))
    over = longer.groupBy("lang", "phrase").agg(F.max("f").alias("over"))
    stay = split.where("k > 1").join(over, ["lang", "phrase"], "left").where(F.col("over").isNull() | (100 * F.col("over") < absorb * F.col("f"))).drop("over")
    cut = stay.select("lang", "phrase", "words", "k", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    sides = F.array(F.struct(F.lit(True).alias("left"), part(F.lit(1), F.col("cut")).alias("part")), F.struct(F.lit(False).alias("left"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("part")))
    parts = materialize(cut.select("lang", "phrase", "a", "cut", F.explode(sides).alias("side")).select("lang", "phrase", "a", "cut", "side.*"))
    known = phrases.select("lang", F.col("phrase").alias("part"), F.col("f").alias("of"))
    known = materialize(parts.groupBy("lang", "part").agg(F.count("*").alias("rows")).join(known, ["lang", "part"]))
    with_counts = hot_join(parts, known, ["lang", "part"], "rows")
    cuts = range(1, longest)
    of = lambda i, left: F.max(F.when((F.col("cut") == i) & (F.col("left") == left), F.col("of")))
    gathered = with_counts.groupBy("lang", "phrase", "a").agg(*[of(i, True).alias(f"l{i}") for i in cuts], *[of(i, False).alias(f"r{i}") for i in cuts])
    gathered = materialize(gathered)
    in_lang = materialize(gathered.groupBy("lang").agg(F.count("*").alias("rows")).join(totals, "lang"))

    def scored(i: int):
        """Null where the phrase has no such cut, which F.least and the minimum below pass over."""
        score = F.expr(SCORE.format(a="a", n="n", l=f"l{i}", r=f"r{i}"))
        return F.when(F.col(f"r{i}").isNotNull(), F.struct(score.alias("score"), F.lit(i).alias("cut"), F.col(f"l{i}").alias("l"), F.col(f"r{i}").alias("r")))

    best = F.array_min(F.array(*[scored(i) for i in cuts]))
    scores = hot_join(gathered, in_lang, ["lang"], "rows").withColumn("best", best).select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return scores.withColumn("rank", rank.cast("long")).where(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The query's rows from a plain count of all phrases.
ORACLE = r"""
with pieces as (
    select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents
), words as (
    select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces
), grams as (
    select lang, w[i:i + k - 1] as p, k from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from words, range(1, 6) as sizes(k))
), f as (
    select lang, p, k, count(*) as f from grams group by lang, p, k having count(*) >= 100
), total as (
    select lang, sum(len(w))::hugeint as n from words group by lang
), longer as (
    select lang, part, max(f) as over from (select lang, f, unnest([p[:k - 1], p[2:]]) as part from f where k > 2) group by lang, part
), candidates as (
    select c.* from f c left join longer o on c.lang = o.lang and c.p = o.part where c.k > 1 and (o.over is null or 100 * o.over < 100 * c.f)
), cuts as (
    select c.lang, c.p, c.f as a, x.f as l, y.f as r, n, cut, (1000::hugeint * c.f * n) // (x.f::hugeint * y.f) as score
    from (select *, unnest(range(1, k)) as cut from candidates) c join total using (lang)
    join f x on x.lang = c.lang and x.p = c.p[:cut] join f y on y.lang = c.lang and y.p = c.p[cut + 1:]
), best as (
    select * from cuts qualify row_number() over (partition by lang, p order by score, cut) = 1
), ranked as (
    select lang, array_to_string(p, ' ') as phrase, a, l, r, n, score, row_number() over (partition by lang order by score desc, a desc, encode(array_to_string(p, ' '))) as rank from best
)
select lang, rank::bigint as rank, phrase, a, l, r, n::bigint as n, score::bigint as score from ranked where rank <= 2000
"""
