import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import lm_scoring as lm
from tabloom.llm.quality import hash_mod

DEPTH = 2


def kt(a, b):
    p, x, y = 1.0, 0, 0
    for bit in [0] * a + [1] * b:
        p *= ((y if bit else x) + 0.5) / (x + y + 1)
        x, y = x + (not bit), y + bit
    return p


class Tree:
    """Context-tree weighting as it is defined: one tree for each of the 255 decisions, block probabilities as ratios.
    Contexts seen under `least` times share a leaf with their siblings of that kind."""

    def __init__(self, texts, depth, least):
        self.depth, self.counts, self.total = depth, Counter(), Counter()
        rows = [(t, i) for t in (b"\xff" * depth + t + b"\xff" for t in texts) for i in range(depth, len(t))]
        for t, i in rows:
            for d in range(depth + 1):
                self.total[t[i - d : i]] += 1
        self.known = {c for c, n in self.total.items() if n >= least} | {b""}
        for t, i in rows:
            for leaf in self.path(t[:i]):
                for j, bit in self.spell(t[i]):
                    self.counts[leaf, j, bit] += 1

    def spell(self, byte):
        j = 1
        for k in range(7, -1, -1):
            bit = byte >> k & 1
            yield j, bit
            j = 2 * j + bit

    def path(self, before):
        out = [b""]
        for d in range(1, self.depth + 1):
            c = before[-d:]
            if c not in self.known:
                return [*out, ("rest", out[-1])] if self.children(out[-1]) else out
            out.append(c)
        return out

    def children(self, c):
        return [x for x in self.known if len(x) == len(c) + 1 and x.endswith(c)]

    def weighted(self, c, j, extra):
        own = kt(self.counts[c, j, 0] + extra.get((c, 0), 0), self.counts[c, j, 1] + extra.get((c, 1), 0))
        kids = self.children(c) if isinstance(c, bytes) else []
        if not kids:
            return own
        split = self.weighted(("rest", c), j, extra)
        for k in kids:
            split *= self.weighted(k, j, extra)
        return own / 2 + split / 2

    def log10(self, text):
        t, out = b"\xff" * self.depth + text + b"\xff", 0.0
        for i in range(self.depth, len(t)):
            path = self.path(t[:i])
            for j, bit in self.spell(t[i]):
                out += math.log10(self.weighted(b"", j, {(c, bit): 1 for c in path}) / self.weighted(b"", j, {}))
        return out


def model_of(texts, depth, nodes=10_000):
    keys, n = lm.grams(texts, depth)
    rows = Counter()
    for k, c in zip(keys.tolist(), n.tolist()):
        for d in range(depth + 1):
            rows[d, k & ((1 << 8 * (d + 1)) - 1)] += c
    total = Counter()
    for (d, k), c in rows.items():
        total[d, k >> 8] += c
    top = sorted(total.values(), reverse=True)
    least = top[nodes] + 1 if len(top) > nodes else 1
    kept = [(d, k, c) for (d, k), c in rows.items() if total[d, k >> 8] >= least or d == 0]
    return lm.build(*(np.array(x) for x in zip(*kept)), depth), least


@pytest.mark.parametrize("nodes", [3, 9, 10_000])
def test_model_equals_definition(nodes):
    train = [b"abab", b"abba cab", b"", b"\xc3\xa9a"]
    model, least = model_of(train, DEPTH, nodes)
    tree = Tree(train, DEPTH, least)
    texts = [b"ab", b"", b"zz", b"\xc3\xa9b cab", b"bbbbb"]
    assert lm.text_logs(model, texts) == pytest.approx([tree.log10(t) for t in texts], rel=1e-5)


def test_symbols_of_every_node_sum_to_one():
    model, _ = model_of([b"the cat sat on the mat " * 9, b"a dog"], 4)
    assert np.allclose((10.0 ** model.logs.astype(float)).sum(axis=1), 1, atol=1e-5)


def test_kt_block_probability():
    for a, b in [(0, 0), (1, 0), (3, 2), (40, 1), (7, 90)]:
        assert lm.kt_block(np.array([a]), np.array([b]))[0] == pytest.approx(math.log(kt(a, b)), abs=1e-9)


def test_grams_in_chunks(monkeypatch):
    texts = [b"abcabcabd" * 5, b"", b"abc", b"\xff"[:0] + b"q" * 50]
    a = lm.grams(texts, 3)
    monkeypatch.setattr(lm, "CHUNK_BYTES", 4)
    assert all((x == y).all() for x, y in zip(a, lm.grams(texts, 3))) and a[1].sum() == sum(len(t) + 1 for t in texts)


@pytest.mark.parametrize("block", [16 << 20, 60])
def test_scores(spark, monkeypatch, block):
    monkeypatch.setattr(lm, "BLOCK_BYTES", block)
    rng = random.Random(5)
    words = ["The", "the", "of", "Été", "été", "and", "zig zag", "a\x0bb"]
    texts = [" \n\t"[i % 3].join(rng.choices(words, k=rng.randint(0, 30))) for i in range(60)] + [None, "", "  ", "x" * 4000] + ["The of"] * 20
    docs = spark.createDataFrame([(i, t, 9.0) for i, t in enumerate(texts)] + [(None, "null id", 1.0)], "doc_id long, text string, score double").repartition(3)
    held = hash_mod("doc_id", 5) == 1
    rows = lm.score_texts(docs.withColumn("held_out", held), ~held, depth=2, nodes=40).collect()
    assert len(rows) == len(texts) + 1
    lower = lambda t: (t or "").encode().lower()
    train = [lower(t) for i, t in [*enumerate(texts), (None, "null id")] if zlib.crc32(str("" if i is None else i).encode()) % 5 != 1]
    c = Counter(w for t in train for w in [*t.split(), b"\n"])
    n, v = sum(c.values()), len(c)
    model, _ = model_of(train, 2, 40)
    for r in rows:
        w = [*lower(r.text).split(), b"\n"]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), abs=1e-9)
        want = float(lm.text_logs(model, [lower(r.text)])[0])
        assert r.score == pytest.approx(want, rel=1e-6)
        assert r.bits_per_byte == pytest.approx(-want * math.log2(10) / (len(lower(r.text)) + 1), rel=1e-6)


@pytest.mark.parametrize("block", [16 << 20, 3_000])
def test_no_context_is_left_out(spark, monkeypatch, block):
    monkeypatch.setattr(lm, "BLOCK_BYTES", block)
    monkeypatch.setattr(lm, "CHUNK_BYTES", 5_000)
    rng = random.Random(8)
    texts = ["".join(rng.choices("abcdefghijklmnopqrst \u00e9", k=300)) for _ in range(60)] + ["", "QZ new", "dup", "dup"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    train = [t.encode().lower() for i, t in enumerate(texts) if i % 5]
    model, _ = model_of(train, 5, 10**9)
    assert model.nodes > 32_000  # the bound that there was
    want = lm.text_logs(model, [t.encode().lower() for t in texts])
    got = {r.doc_id: r for r in lm.score_texts(docs, F.col("doc_id") % 5 != 0).collect()}
    assert [got[i].score for i in range(len(texts))] == pytest.approx(want.tolist(), rel=1e-5)
    assert got[3].bits_per_byte == pytest.approx(-want[3] * math.log2(10) / (len(texts[3].encode()) + 1), rel=1e-5)


def test_whole_model_equals_definition(spark):
    train = [b"abab", b"abba cab", b"", b"\xc3\xa9a"]
    tree = Tree(train, 3, 1)
    texts = [*train, b"ab", b"zz", b"\xc3\xa9b cab", b"bbbbb"]
    docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = lm.score_texts(docs, F.col("doc_id") < len(train), depth=3).orderBy("doc_id").collect()
    assert [r.score for r in rows] == pytest.approx([tree.log10(t) for t in texts], rel=1e-5)


def test_empty_table_and_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score_texts(empty, F.lit(True)).count() == 0
    one = lm.score_texts(spark.createDataFrame([(1, "ab c")], "doc_id long, text string"), F.lit(False)).first()
    assert (one.n_tokens, one.n_known, one.train_tokens, one.base_score) == (3, 0, 0, 0.0)
    assert one.bits_per_byte == pytest.approx(8)


def test_hot_pairs_are_dealt_by_a_byte_more():
    keys = np.sort(np.array([97 << 40 | 98 << 32 | c << 24 | s for c in range(60) for s in range(3)] + [97 << 40 | 99 << 32 | c << 24 for c in range(60)], np.int64))
    slot = lm.slice_of(keys, 5, 32, np.array([97 << 8 | 98]))
    hot = keys >> 32 == 97 << 8 | 98
    assert (slot[hot] >= 32).all() and len(set(slot[hot])) > 15 and len(set(slot[~hot])) == 1 and slot[~hot][0] < 32
    assert len({(k >> 24, s) for k, s in zip(keys[hot].tolist(), slot[hot].tolist())}) == 60  # a context of three bytes stays whole


@pytest.mark.parametrize("hot", [1, 20, 10**9])
def test_scores_are_the_same_however_many_pairs_are_hot(spark, monkeypatch, hot):
    monkeypatch.setattr(lm, "HOT_PAIRS", hot)
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["the", "then", "hen", "Ende", "zig"], k=rng.randint(0, 40))) for _ in range(30)] + ["", None, "a" * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    lower = [(t or "").encode().lower() for t in texts]
    model, _ = model_of([t for i, t in enumerate(lower) if i % 3], 5, 10**9)
    rows = lm.score_texts(docs, F.col("doc_id") % 3 != 0).orderBy("doc_id").collect()
    assert [r.score for r in rows] == pytest.approx(lm.text_logs(model, lower).tolist(), rel=1e-5)
