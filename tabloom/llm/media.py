"""Operator 2: columns from ISO base media files (MP4, QuickTime): codecs, durations and keyframe byte ranges."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boxes that hold boxes, among those that lead to sample tables.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf"}
#: Nesting deeper than this is refused.
DEEPEST = 16


class Malformed(ValueError):
    """The bytes don't follow the format."""


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, start of its content, end) of the boxes in data[start:end], by their 32- or 64-bit sizes, 0 meaning to the end."""
    at = start
    while at < end:
        if end - at < 8:
            raise Malformed("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if end - at < 16:
                raise Malformed("a box header is cut off")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise Malformed(f"box {kind!r} has a wrong size")
        yield kind, at + head, at + size
        at += size


@dataclass
class Track:
    track_id: int = 0
    handler: str = ""
    codec: str = ""
    width: int = 0
    height: int = 0
    timescale: int = 0
    duration: int = 0
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    keyframes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # numbers of samples, from 0

    def ranges(self, which: np.ndarray) -> list[tuple[int, int]]:
        """(start, length) of these samples, neighbours in the file joined."""
        o, s = self.offsets[which], self.sizes[which]
        if not len(o):
            return []
        new = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1] + s[:-1]]))
        return list(zip(o[new].tolist(), np.add.reduceat(s, new).tolist()))


def _full(data: memoryview, at: int, end: int, kind: str, count_at: int, width: int) -> np.ndarray:
    """The rows of a table box: `count_at` bytes into it stands how many numbers-by-row follow."""
    if end - at < count_at + 4:
        raise Malformed(f"{kind} is cut off")
    n = struct.unpack_from(">I", data, at + count_at)[0]
    if end - at - count_at - 4 < n * width * 4:
        raise Malformed(f"{kind} is cut off")
    return np.frombuffer(data, ">u4", n * width, at + count_at + 4).astype(np.int64).reshape(n, width)


def _walk(data: memoryview, start: int, end: int, tables: dict[bytes, tuple[int, int]], tracks: list[dict], deep: int) -> None:
    if deep > DEEPEST:
        raise Malformed("boxes are nested too deeply")
    for kind, a, b in boxes(data, start, end):
        if kind == b"trak":
            tracks.append({})
            _walk(data, a, b, tracks[-1], tracks, deep + 1)
        elif kind in NESTED:
            _walk(data, a, b, tables, tracks, deep + 1)
        else:
            tables[kind] = (a, b)


def _sample_tables(data: memoryview, t: dict[bytes, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Sizes and offsets of all samples, numbers of the keyframes, and their durations' sum."""
    if b"stsz" in t:
        a, b = t[b"stsz"]
        if b - a < 12:
            raise Malformed("stsz is cut off")
        same, n = struct.unpack_from(">II", data, a + 4)
        if same * n > len(data):
            raise Malformed("samples lie outside the file")
        sizes = np.full(n, same, np.int64) if same else _full(data, a, b, "stsz", 8, 1)[:, 0]
    elif b"stz2" in t:
        a, b = t[b"stz2"]
        if b - a < 12:
            raise Malformed("stz2 is cut off")
        bits, n = data[a + 7], struct.unpack_from(">I", data, a + 8)[0]
        if bits not in (4, 8, 16) or b - a - 12 < (n * bits + 7) // 8:
            raise Malformed("stz2 is wrong")
        raw = np.frombuffer(data, np.uint8, (n * bits + 7) // 8, a + 12)
        sizes = {4: lambda: np.column_stack([raw >> 4, raw & 15]).ravel(), 8: lambda: raw, 16: lambda: raw.view(">u2")}[bits]()[:n].astype(np.int64)
    else:
        raise Malformed("a track has no sample sizes")
    if b"co64" in t:
        a, b = t[b"co64"]
        pairs = _full(data, a, b, "co64", 4, 2)
        chunks = (pairs[:, 0] << 32) + pairs[:, 1]
    elif b"stco" in t:
        chunks = _full(data, *t[b"stco"], "stco", 4, 1)[:, 0]
    else:
        raise Malformed("a track has no chunk offsets")
    if b"stsc" not in t:
        raise Malformed("a track has no sample-to-chunk table")
    runs = _full(data, *t[b"stsc"], "stsc", 4, 3)
    if len(chunks) and (not len(runs) or runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any()):
        raise Malformed("stsc is wrong")
    each = runs[np.searchsorted(runs[:, 0], np.arange(1, len(chunks) + 1), "right") - 1, 1] if len(chunks) else np.zeros(0, np.int64)
    if each.sum() != len(sizes):
        raise Malformed("chunks and samples don't agree")
    chunk = np.repeat(np.arange(len(chunks)), each)
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(each) - each
    inside = before - before[np.minimum(first[chunk], max(len(sizes) - 1, 0))] if len(sizes) else before
    offsets = chunks[chunk] + inside
    keyframes = np.arange(len(sizes))
    if b"stss" in t:
        keyframes = _full(data, *t[b"stss"], "stss", 4, 1)[:, 0] - 1
        if len(keyframes) and (keyframes.min() < 0 or keyframes.max() >= len(sizes)):
            raise Malformed("stss is wrong")
    times = _full(data, *t[b"stts"], "stts", 4, 2) if b"stts" in t else np.zeros((0, 2), np.int64)
    return sizes, offsets, keyframes, int((times[:, 0] * times[:, 1]).sum())


def parse(content: bytes) -> list[Track]:
    """The tracks of a file, from its boxes and sample tables alone; payloads are never read. Raises Malformed."""
    data = memoryview(content)
    found: list[dict] = []
    top: dict[bytes, tuple[int, int]] = {}
    _walk(data, 0, len(data), top, found, 0)
    if b"mvhd" not in top:
        raise Malformed("there is no movie header")
    if b"moof" in top or b"mvex" in top:
        raise Malformed("the samples are in fragments, which have no sample tables")
    out = []
    try:
        for t in found:
            x = Track()
            if b"tkhd" in t:
                a, _ = t[b"tkhd"]
                x.track_id = struct.unpack_from(">I", data, a + (20 if data[a] else 12))[0]
            if b"hdlr" in t:
                x.handler = bytes(data[t[b"hdlr"][0] + 8 :][:4]).decode("latin-1")
            if b"mdhd" in t:
                a, _ = t[b"mdhd"]
                x.timescale = struct.unpack_from(">I", data, a + (20 if data[a] else 12))[0]
            if b"stsd" in t:
                a, b = t[b"stsd"]
                for kind, c, _ in boxes(data, a + 8, b):
                    x.codec = x.codec or kind.decode("latin-1")
                    if x.handler == "vide" and not x.width:
                        x.width, x.height = struct.unpack_from(">HH", data, c + 24)
            x.sizes, x.offsets, x.keyframes, x.duration = _sample_tables(data, t)
            if len(x.sizes) and int((x.offsets + x.sizes).max()) > len(data):
                raise Malformed("samples lie outside the file")
            out.append(x)
    except struct.error as e:
        raise Malformed("a box is cut off") from e
    return out


TRACKS = (
    "array<struct<track_id: bigint, handler: string, codec: string, width: int, height: int, timescale: bigint, duration: bigint, "
    "samples: bigint, keyframes: array<struct<start: bigint, length: bigint>>>>"
)


def media_columns(df: DataFrame, content: str = "content") -> DataFrame:
    """Add tracks (one struct per track, with codec, duration in timescale units and the keyframes' byte ranges) and
    problem (null, or why the container can't be read) to rows with a binary column. A null or malformed container has
    null tracks; an empty one is malformed, and so is one in fragments (moof), whose samples stand in no table; in a track without a sync-sample table every sample is a keyframe, and
    ranges that touch are joined. Columns of these names are replaced. Empty tables stay empty; equal contents get equal values."""
    cols = [c for c in df.columns if c not in ("tracks", "problem")]

    def row(c: bytes | None) -> tuple:
        if c is None:
            return None, None
        try:
            return [
                {"track_id": t.track_id, "handler": t.handler, "codec": t.codec, "width": t.width, "height": t.height, "timescale": t.timescale, "duration": t.duration,
                 "samples": len(t.sizes), "keyframes": [{"start": a, "length": n} for a, n in t.ranges(t.keyframes)]}
                for t in parse(c)
            ], None
        except Malformed as e:
            return None, str(e)

    schema = spark_schema(df.select(*cols))
    kinds = pa.list_(pa.struct([
        ("track_id", pa.int64()), ("handler", pa.string()), ("codec", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("timescale", pa.int64()),
        ("duration", pa.int64()), ("samples", pa.int64()), ("keyframes", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
    ]))

    def run(batches):
        for b in batches:
            got = [row(x.as_py()) for x in b.column(b.schema.get_field_index(content))]
            more = [pa.array([t for t, _ in got], kinds), pa.array([p for _, p in got], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "tracks", "problem"])

    return df.select(*cols).mapInArrow(run, schema)


def spark_schema(df: DataFrame):
    return df.withColumns({"tracks": F.lit(None).cast(TRACKS), "problem": F.lit(None).cast("string")}).schema


# ---- writing: texts as raw grey video, 24 x 24 pixels of 8 bits a frame ----

SIDE = 24
FRAME = SIDE * SIDE
#: Frames a second, frames from one keyframe to the next, and frames in a chunk.
RATE, KEY_EVERY, CHUNK = 25, 12, 8


def _box(kind: bytes, *content: bytes) -> bytes:
    body = b"".join(content)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _table(kind: bytes, rows: np.ndarray) -> bytes:
    return _box(kind, struct.pack(">II", 0, len(rows)), rows.astype(">u4").tobytes())


_UNIT = struct.pack(">9i", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
_FILE_TYPE = _box(b"ftyp", b"qt  ", struct.pack(">I", 0x200), b"qt  ")


def write(payload: bytes) -> bytes:
    """A QuickTime file with one video track of codec `raw `, whose samples are payload, FRAME bytes each."""
    n, rest = divmod(len(payload), FRAME)
    if rest or not n:
        raise ValueError("the payload must be whole frames")
    chunks = -(-n // CHUNK)
    last = n - (chunks - 1) * CHUNK
    per_chunk = [(1, min(CHUNK, n), 1)] + ([(chunks, last, 1)] if chunks > 1 and last < CHUNK else [])
    entry = _box(
        b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", SIDE, SIDE, 72 << 16, 72 << 16, 0, 1), bytes(32), struct.pack(">Hh", 40, -1),
    )  # fmt: skip  # depth 40: 8-bit grey

    def movie(base: int) -> bytes:
        offsets = base + np.arange(chunks, dtype=np.int64) * CHUNK * FRAME
        wide = int(offsets[-1]) >> 32
        where = _box(b"co64", struct.pack(">II", 0, chunks), offsets.astype(">u8").tobytes()) if wide else _table(b"stco", offsets)
        samples = _box(
            b"stbl", _box(b"stsd", struct.pack(">II", 0, 1), entry), _table(b"stts", np.array([(n, 1)])), _table(b"stss", np.arange(1, n + 1, KEY_EVERY)),
            _table(b"stsc", np.array(per_chunk)), _box(b"stsz", struct.pack(">III", 0, FRAME, n)), where,
        )
        info = _box(b"minf", _box(b"vmhd", struct.pack(">IQ", 1, 0)), _box(b"dinf", _box(b"dref", struct.pack(">II", 0, 1), _box(b"url ", struct.pack(">I", 1)))), samples)
        media = _box(b"mdia", _box(b"mdhd", struct.pack(">IIIIIHH", 0, 0, 0, RATE, n, 0x55C4, 0)), _box(b"hdlr", bytes(8), b"vide", bytes(13)), info)
        head = _box(b"tkhd", struct.pack(">IIIIII8xhhhh", 7, 0, 0, 1, 0, n, 0, 0, 0, 0), _UNIT, struct.pack(">II", SIDE << 16, SIDE << 16))
        top = _box(b"mvhd", struct.pack(">IIIIIIH10x", 0, 0, 0, RATE, n, 1 << 16, 1 << 8), _UNIT, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", top, _box(b"trak", head, media))

    base = len(_FILE_TYPE) + len(movie(0)) + 8
    return _FILE_TYPE + movie(base) + _box(b"mdat", payload)


def text_media(text: str | None) -> tuple[bytes, bytes]:
    """The text's UTF-8 (null: empty), and it stored, filled up with bytes 255 to whole frames, one at least."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw, write(raw + b"\xff" * (-len(raw) % FRAME or (0 if raw else FRAME)))


def feature(t: Track) -> str:
    keys = ",".join(f"{a}+{n}" for a, n in t.ranges(t.keyframes))
    return f"codec={t.codec.strip()};size={t.width}x{t.height};timescale={t.timescale};duration={t.duration};samples={len(t.sizes)};keyframes={keys}"


def text_digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store each whole text in a media file, read its payload back by the sample tables, and digest both.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature (what
    media_columns finds). Null texts are empty ones; repeated rows and null keys give a row each; an empty table none.
    """

    def digest(t: str | None) -> tuple:
        raw, stored = text_media(t)
        track = parse(stored)[0]
        back = b"".join(stored[a : a + n] for a, n in track.ranges(np.arange(len(track.sizes))))
        return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(track)

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for b in batches:
            cols = list(zip(*(digest(t.as_py()) for t in b.column(1)))) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", *names])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, schema)
