import hashlib
import struct
import zlib

import numpy as np
import pytest

from tabloom.llm import media


def box(kind, body, wide=False, open_end=False):
    if wide:
        return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body
    return struct.pack(">I4s", 0 if open_end else len(body) + 8, kind) + body


def table(kind, rows, width=1):
    return box(kind, struct.pack(">II", 0, len(rows)) + struct.pack(f">{len(rows) * width}I", *np.ravel(rows).tolist()))


def movie(samples, chunks, sync=None, wide=False, co64=False, stz2=0):
    """A file with one audio track: samples of these bytes, so many to a chunk, chunks lying in reverse order."""
    data, offsets, at, i = b"", [], 0, 0
    parts = []
    for n in chunks:
        parts.append(b"".join(samples[i : i + n]))
        i += n
    place = {}
    for k in reversed(range(len(parts))):
        place[k] = len(data)
        data += parts[k] + b"gap"

    def build(base):
        where = [base + place[k] for k in range(len(parts))]
        if stz2:
            n = [len(s) for s in samples]
            raw = {16: lambda: struct.pack(f">{len(n)}H", *n), 8: lambda: bytes(n), 4: lambda: bytes(a << 4 | b for a, b in zip(n[::2], [*n[1::2], 0]))}[stz2]()
            size = box(b"stz2", struct.pack(">II", 0, stz2) + struct.pack(">I", len(n)) + raw)
        else:
            size = box(b"stsz", struct.pack(">III", 0, 0, len(samples)) + struct.pack(f">{len(samples)}I", *map(len, samples)))
        stbl = box(
            b"stbl",
            box(b"stsd", struct.pack(">II", 0, 1) + box(b"mp4a", bytes(28)))
            + table(b"stts", [(1, 7), (len(samples) - 1, 10)], 2)
            + (table(b"stss", sync) if sync is not None else b"")
            + table(b"stsc", [(k + 1, n, 1) for k, n in enumerate(chunks)], 3)
            + size
            + (box(b"co64", struct.pack(">II", 0, len(where)) + struct.pack(f">{len(where)}Q", *where)) if co64 else table(b"stco", where)),
            wide,
        )
        mdia = box(b"mdia", box(b"mdhd", struct.pack(">IIIII", 0, 0, 0, 44100, 0) + bytes(4)) + box(b"hdlr", bytes(8) + b"soun" + bytes(13)) + box(b"minf", stbl, wide))
        return box(b"moov", box(b"mvhd", bytes(100)) + box(b"trak", box(b"tkhd", struct.pack(">IIII", 0, 0, 0, 9) + bytes(70)) + mdia), wide)

    base = 16 + len(build(0)) + (16 if wide else 8)
    return box(b"ftyp", b"isom" + bytes(4)) + build(base) + (box(b"mdat", data, wide) if wide else box(b"mdat", data, open_end=True))


SAMPLES = [bytes([65 + k]) * n for k, n in enumerate([3, 1, 4, 1, 5, 9, 2, 6])]


@pytest.mark.parametrize("how", [{}, {"wide": True}, {"co64": True}, {"stz2": 4}, {"stz2": 8}, {"stz2": 16}, {"sync": [1, 4, 5]}])
def test_sample_tables(how):
    content = movie(SAMPLES, [3, 2, 2, 1], **how)
    (t,) = media.parse(content)
    assert [content[o : o + n] for o, n in zip(t.offsets, t.sizes)] == SAMPLES
    assert (t.track_id, t.handler, t.codec, t.timescale, t.duration) == (9, "soun", "mp4a", 44100, 77)
    keys = [x - 1 for x in how.get("sync", range(1, 9))]
    assert list(t.keyframes) == keys
    got = b"".join(content[a : a + n] for a, n in t.ranges(t.keyframes))
    assert got == b"".join(SAMPLES[k] for k in keys)
    if "sync" in how:
        assert len(t.ranges(t.keyframes)) == 2  # samples 4 and 5 touch


def test_whatever_is_cut_or_changed_is_malformed_or_read():
    content = movie(SAMPLES, [3, 2, 2, 1], sync=[1, 2])
    for n in range(0, content.index(b"mdat") - 4):
        with pytest.raises(media.Malformed):
            media.parse(content[:n])
    rng = np.random.default_rng(0)
    for _ in range(1500):
        x = bytearray(content)
        x[rng.integers(len(x))] = rng.integers(256)
        try:
            media.parse(bytes(x))
        except media.Malformed:
            pass


def test_fragmented_files_say_so():
    whole = movie([b"ab", b"cde"], [2])
    with pytest.raises(media.Malformed, match="fragments"):
        media.parse(box(b"moof", box(b"mfhd", bytes(8))) + whole)


def test_media_columns(spark):
    good = movie(SAMPLES, [3, 2, 2, 1], sync=[1, 4])
    df = spark.createDataFrame([(1, good, 5), (2, None, 5), (3, b"", 5), (4, b"junk", 5), (5, good, 5)], "id long, content binary, tracks int")
    rows = {r.id: r for r in media.media_columns(df).collect()}
    assert rows[1].tracks == rows[5].tracks and rows[1].problem is None
    t = rows[1].tracks[0]
    assert (t.codec, t.samples, t.duration, [good[k.start : k.start + k.length] for k in t.keyframes]) == ("mp4a", 8, 77, [b"AAA", b"D"])
    assert rows[2].tracks is None and rows[2].problem is None
    assert rows[3].tracks is None and rows[3].problem and rows[4].problem
    assert media.media_columns(df.limit(0)).count() == 0


def test_text_digests(spark):
    texts = [None, "", "a", "é" * 288, "x" * 576, "x" * 577, "line\n" * 40_000, "a"]
    docs = spark.createDataFrame([(i, t, "y") for i, t in enumerate(texts)] + [(None, "a", "z")], "doc_id long, text string, feature string")
    rows = media.text_digests(docs.repartition(3)).collect()
    assert len(rows) == len(texts) + 1
    by = {r.doc_id: r for r in rows}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = by[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:])
        stored = media.text_media(t)[1]
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        frames = len(payload) // 576
        assert r.feature.startswith(f"codec=raw;size=24x24;timescale=25;duration={frames};samples={frames};keyframes=")
        keys = [tuple(map(int, k.split("+"))) for k in r.feature.rpartition("=")[2].split(",")]
        assert [stored[a : a + n] for a, n in keys] == [payload[k : k + 576] for k in range(0, len(payload), 12 * 576)]
    assert by[2][1:] == by[7][1:] == by[None][1:] and by[0][1:] == by[1][1:]
    assert media.text_digests(docs.limit(0)).count() == 0
