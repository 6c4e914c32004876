"""Operator 13 against a brute-force count of every phrase."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tabloom.llm import collocations as c

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType())])
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, longest=5, least=100, first=2000):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    gone = set()
    for (lang, p), a in candidates.items():
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                part = (lang, p[i : i + size])
                if 100 * a >= 100 * candidates[part]:
                    gone.add(part)
    out = []
    for (lang, p), a in candidates.items():
        if (lang, p) in gone:
            continue
        best = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, f[lang, p[: best[1]]], f[lang, p[best[1] :]], n[lang], best[0]))
    ranked = []
    for lang in {o[0] for o in out}:
        own = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))[:first]
        ranked += [(lang, i + 1, *o[1:]) for i, o in enumerate(own)]
    return sorted(ranked)


def texts(seed, docs=60):
    rnd = random.Random(seed)
    words = ["The", "of", "a", "b", "né", "Straße", "x" * 30, " ", "İ", "日本", "\x00q"]
    join = [" ", " ", " ", " ", "\t", "  ", ", ", ".", "\n", "\x0b", "! ", " ;"]
    out = []
    for i in range(docs):
        body = "".join(rnd.choice(words[: rnd.randint(2, len(words))]) + rnd.choice(join) for _ in range(rnd.randint(0, 80)))
        out.append((i, body + rnd.choice(["", " a b a b a b a", " the of a b né"]), rnd.choice(["en", "de", None])))
    return out + [(None, None, "en"), (1, "", None), (1, "...,,,", "fr"), (7, "a b " * 4000, "en"), (7, "a b " * 4000, "en")]


@pytest.mark.parametrize("least,shard_bytes,seed", [(5, 1 << 20, 1), (3, 300, 2), (20, 1000, 3), (1, 500, 4)])
def test_equals_brute_force(spark, monkeypatch, least, shard_bytes, seed):
    monkeypatch.setattr(c, "BROADCAST_HASHES", 0 if seed == 2 else 40 if seed == 3 else 2_000_000)
    rows = texts(seed)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = c.collocations(docs, least=least, shard_bytes=shard_bytes, first=50 if seed == 1 else 2000)
    assert sorted(map(tuple, got.collect())) == brute(rows, least=least, first=50 if seed == 1 else 2000)


def test_empty_and_clashing_columns(spark):
    assert c.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(i, "p q r, " * 30, "en") for i in range(10)]
    docs = spark.createDataFrame([(*r, 1, "z", "s") for r in rows], "doc_id long, text string, lang string, k int, phrase string, shard string")
    assert sorted(map(tuple, c.collocations(docs).collect())) == brute(rows) != []


def test_products_pass_64_bits(spark):
    """1000 * a * n over 2^64 needs counts that no test has, so the same expression takes them from literals."""
    a, n, l, r = 10**12, 10**14, 10**12, 10**12 + 7
    got = spark.sql(c.SCORE.format(a=f"{a}L", n=f"{n}L", l=f"{l}L", r=f"{r}L").join(["select ", " as s"])).first()[0]
    assert got == 1000 * a * n // (l * r)


def test_hashes_that_collide_let_more_pass_only(spark, monkeypatch):
    """With 3 bits nearly every phrase passes; the counts stay exact."""
    monkeypatch.setattr(c, "HASH_BITS", 3)
    rows = texts(6)
    assert sorted(map(tuple, c.collocations(spark.createDataFrame(rows, SCHEMA), least=4).collect())) == brute(rows, least=4)


def test_ranks_of_large_and_small_numbers():
    for key in (np.array([5, 1, 5, 0, 1]), np.array([2**60, 3, 2**60, 7]), np.zeros(0, np.int64)):
        order, ranks = c.ranked(key)
        assert list(order) == list(np.argsort(key, kind="stable")) and list(ranks) == list(np.unique(key, return_inverse=True)[1])


def test_suffix_array_is_sorted_with_true_lcps():
    rnd = np.random.default_rng(5)
    for depth in (1, 2, 3, 4, 5, 6):
        tokens = np.append(rnd.integers(0, 4, 200), 0)
        s = c.Suffixes(tokens, depth, tokens > 0)
        full = [tuple(tokens[p : p + min(depth, s.left[p])]) for p in s.places]
        assert full == sorted(full)
        for x, y, lcp in zip(full, full[1:], s.lcp[1:]):
            same = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
            assert same == lcp


def test_long_texts_are_cut_where_pieces_end():
    data = np.frombuffer(b"aa bb. cc dd ee ff gg hh. ii" + b"xx" + b"yyyyyyyyyy.zz", np.uint8)
    offsets = np.array([0, 28, 28, 30, 43])
    cuts = list(c._cuts(data, offsets, 8))
    assert cuts[0][0] == 0 and cuts[-1][1] == 43 and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:]))
    assert all(stop in offsets or data[stop - 1] == ord(".") for _, stop in cuts)


def test_shards_are_read_a_few_at_a_time(spark, monkeypatch):
    """The reader's batches, too: thousands of rows of shards would be a whole partition."""
    name, seen, made = "spark.sql.parquet.columnarReaderBatchSize", [], c.materialize
    monkeypatch.setattr(c, "materialize", lambda df, *more: seen.append(int(spark.conf.get(name))) or made(df, *more))
    c.phrase_counts(spark.createDataFrame([(1, "a b c, a b c", "en")], SCHEMA), least=1)
    assert seen.count(c.SHARDS_AT_ONCE) == 15 and int(spark.conf.get(name)) > c.SHARDS_AT_ONCE


def test_counts_are_merged_over_the_shards_of_a_task():
    """A task hands on each phrase once, not once for each of its shards."""
    words = c.pa.array(["a", "bé", "c"], c.pa.large_string())
    tokens = np.array([1, 2, 3, 0, 1, 2, 0], np.int32)
    rows = [c._packed(i, tokens, tokens > 0, words, np.array([0, 0, 1], np.int32), ["en", "und"]) for i in range(4)]
    batches = [c._batch(r, c._SHARD_ARROW) for r in rows]
    number, got, starts, spelled, langs, names = c._unpacked(batches[2], 0)
    assert (number, got.tolist(), starts.tolist(), spelled.to_pylist(), langs.tolist(), names) == (2, tokens.tolist(), (tokens > 0).tolist(), ["a", "bé", "c"], [0, 0, 1], ["en", "und"])
    hashed = [b for b in c._counted(iter(batches), 2)]
    assert sum(b.num_rows for b in hashed) == 2 and sorted(hashed[0].column("c").to_pylist()) == [4, 8]
    often = np.sort(hashed[0].column("h").to_numpy())
    out = [r for b in c._next(iter(batches), 2, 5, often) for r in b.to_pylist()]
    found = [x for r in out if r["n"] for x in zip(r["lang"], r["phrase"], r["n"])]
    assert sorted(found) == [("en", "a bé", 8), ("en", "bé c", 4)] and sum(r["shard"] is not None for r in out) == 4


def test_only_words_leave_tasks_as_text(spark, monkeypatch):
    """Each from one task; longer phrases are handed on as keys and spelled once, however many tasks hold them."""
    tables, made = [], c.materialize

    def seen(df, *more):
        tables.append((dict(df.dtypes), made(df, *more)))
        if tables[-1][0].get("phrase") == "array<string>":
            handed.append(sum(len(r[0]) for r in tables[-1][1].where("phrase is not null").select("phrase").collect()))
        return tables[-1][1]

    handed: list[int] = []
    monkeypatch.setattr(c, "materialize", seen)
    rows = [(i, "a b c d e f, " * 5, "en") for i in range(64)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert sorted(map(tuple, c.collocations(docs, shard_bytes=200).collect())) == brute(rows) != []
    assert sum(handed) == 6


def test_words_that_share_a_hash_keep_their_own_ids(monkeypatch):
    monkeypatch.setattr(c, "_hashes", lambda words, langs, names: np.full(len(words), 7, np.uint64))
    table = c.pa.table({"lang": ["en", "en", "und", "und x"], "phrase": ["a", "b", "a", "b"], "id": [3, 0, 1, 2]})
    words, langs = c.pa.array(["b", "a", "a", "q", "b"], c.pa.large_string()), np.array([0, 1, 0, 0, 1], np.int32)
    assert c._word_ids(words, langs, ["en", "und"], c._vocabulary(table)).tolist() == [0, 1, 3, -1, -1]


def test_numbers_of_all_widths_come_back():
    for most in (0, 65_535, 65_536, (1 << 31) - 1, 1 << 31, 1 << 40):
        assert c._unpack(c._pack(np.array([0, 1, most], np.int64))).tolist() == [0, 1, most]


@pytest.mark.parametrize("broadcast", [0, 2_000_000])
def test_words_whose_hashes_collide_are_counted_by_themselves(spark, monkeypatch, broadcast):
    """Tasks get the module by value, and with it hashes of 2 bits."""
    monkeypatch.setattr(c, "HASH_BITS", 2)
    monkeypatch.setattr(c, "BROADCAST_HASHES", broadcast)
    cloudpickle.register_pickle_by_value(c)
    try:
        rows = texts(8)
        got = sorted(map(tuple, c.collocations(spark.createDataFrame(rows, SCHEMA).repartition(3), least=30, shard_bytes=500).collect()))
    finally:
        cloudpickle.unregister_pickle_by_value(c)
    assert got == brute(rows, least=30) != []


def test_strays_are_words_that_nobody_spelled():
    words = c.pa.array(["a", "b", "c"], c.pa.large_string())
    tokens, langs = np.array([1, 2, 3, 0, 1, 2, 0], np.int32), np.array([0, 0, 1], np.int32)
    batches = [c._batch(c._packed(i, tokens, tokens > 0, words, langs, ["en", "und"]), c._SHARD_ARROW) for i in range(2)]
    h = c._phrase_hash(c._hashes(words, langs, ["en", "und"]), np.arange(1, 4), np.arange(3), 1)
    known = c._vocabulary(c.pa.table({"lang": ["en"], "phrase": ["a"], "id": [0]}))
    out = [r for b in c._strays(iter(batches), np.sort(h[:2]), known) for r in b.to_pylist()]
    assert out == [{"lang": "en", "phrase": "b", "n": 4, "h": h[1]}]
