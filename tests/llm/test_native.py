"""Operators 3, 7 and 8."""

import math
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tabloom.llm import line_dedup, mixing, sharding
from tabloom.llm.common import gapless_rank


def shard_by_hand(key, weights, first=0):
    best = None
    for s, w in enumerate(weights, first):
        seed = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
        u = ((xxhash.xxh64_intdigest(struct.pack("<i", s), seed) >> 11) + 0.5) / 2**53
        best = min(best or (math.inf, 0), (-math.log(u) / w, s))
    return best


def test_rendezvous_equals_brute_force_and_moves_only_into_the_new_shard(spark):
    weights = [1.0, 2.0, 0.5, 4.0]
    df = spark.range(3000).withColumnRenamed("id", "k").withColumn("shard", F.lit("old")).union(spark.sql("select null, 'old'"))
    rows = sharding.rendezvous(df, "k", weights, grow_by=1.5).collect()
    for r in rows:
        a, b = shard_by_hand(r.k, weights), shard_by_hand(r.k, [1.5], 4)
        assert r.shard == a[1] and r.grown_shard == min(a, b)[1] and r.grown_shard in (r.shard, 4)
    n = Counter(r.shard for r in rows)
    assert all(abs(n[s] / 3000 - w / 7.5) < 0.03 for s, w in enumerate(weights))
    moved = sum(r.grown_shard == 4 for r in rows)
    assert abs(moved / 3000 - 1.5 / 9) < 0.03
    with pytest.raises(ValueError):
        sharding.rendezvous(df, "k", [1.0, 0.0])


def test_shard_documents(spark):
    texts = [None, "", "é", "a" * 100_000] + [f"text {i}" for i in range(300)]
    rows = [(i, t, 7) for i, t in enumerate(texts)] + [(3, "again", 7), (3, "again", 7), (None, "x", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(6)
    got = sharding.shard_documents(docs, shards=5).collect()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted(((-1 if i is None else i) or -1 if i == 0 else (-1 if i is None else i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and r.shard == shard_by_hand(r.doc_id, [1.0] * 5)[1] and r.grown_shard in (r.shard, 5)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_gapless_rank_with_null_groups_and_ties(spark):
    df = spark.createDataFrame([(None if i % 3 == 0 else i % 3, i // 4) for i in range(100)], "g int, v int")
    by = defaultdict(list)
    for r in gapless_rank(df, ["g"], ["v"], "n", buckets=3).collect():
        by[r.g].append(r.n)
    assert sum(map(len, by.values())) == 100 and all(sorted(x) == list(range(len(x))) for x in by.values())


PAGES = (
    [(i, f"header\nunique {i}\nfooter", "a") for i in range(30)] + [(100 + i, f"header\nown {i}\n\n\n", "b") for i in range(25)]
    + [(200 + i, "header\nfooter", "small") for i in range(9)] + [(300, None, "a"), (301, "", "a"), (302, None, None), (303, "header", "a"), (303, "header", "a")]
    + [(400 + i, "null host line\nx%d" % i, None) for i in range(30)] + [(500, "seldom\n" * 40, "a")] + [(600 + i, "one copy\nof many", "b") for i in range(40)]
    + [(700 + i, f"on few pages\nz{i}", "c") for i in range(2)] + [(800, "long line " * 30_000 + "\nheader", "a")] + [(900 + i, f"header\nfew {i}", "tiny") for i in range(3)]
)


def test_line_dedup_equals_brute_force_and_sql(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t, s, "n", 3) for i, t, s in PAGES], "doc_id long, text string, source string, n_lines string, h int").repartition(4)
    args = {"ratio": 0.2, "min_pages": 3}
    got = line_dedup.drop_site_boilerplate(docs, **args)
    assert got.columns == [*docs.columns, "n_dropped"]
    different = {(s, t or "") for _, t, s in PAGES}
    pages = Counter(s for s, _ in different)
    seen = Counter((s, x) for s, t in different for x in set(t.split("\n")) if x.strip())
    bad = {k for k, n in seen.items() if n >= 3 and n > 0.2 * pages[k[0]]}
    assert bad == {("a", "header"), ("a", "footer"), ("b", "header"), (None, "null host line"), ("tiny", "header")}

    def row(i, t, s):
        lines = t.split("\n") if t is not None else []
        kept = [x for x in lines if (s, x) not in bad]
        return i, None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept)

    order = lambda rows: sorted(rows, key=repr)
    want = order(row(*p) for p in PAGES)
    assert order((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()) == want
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert order(con.execute(line_dedup.oracle(0.2, 3)).fetchall()) == want
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    for share in (1, 3, 1_000):
        monkeypatch.setattr(line_dedup, "HOT_SHARE", share)
        again = line_dedup.drop_site_boilerplate(docs, **args)
        assert order((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in again.collect()) == want
    assert line_dedup.drop_site_boilerplate(docs.limit(0)).count() == 0


def fit_by_hand(cells, alphas, sweeps):
    total = sum(cells.values())
    q = {c: n / total for c, n in cells.items()}
    targets = []
    for d, a in enumerate(alphas):
        m = Counter()
        for c, n in cells.items():
            m[c[d]] += n
        s = {v: n**a if n else 0 for v, n in m.items()}
        targets.append({v: x / sum(s.values()) for v, x in s.items()})
    for _ in range(sweeps):
        for d, t in enumerate(targets):
            m = Counter()
            for c, w in q.items():
                m[c[d]] += w
            q = {c: w * t[c[d]] / m[c[d]] if m[c[d]] else 0 for c, w in q.items()}
    return {c: w / sum(q.values()) for c, w in q.items()}, {c: n / total for c, n in cells.items()}, targets


@pytest.mark.parametrize("small", [100_000, 2])
def test_mixing_equals_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(mixing, "SMALL_CELLS", small)
    rng = np.random.default_rng(3)
    rows = [(i, ["a", "b", None][int(rng.integers(3)) if i % 3 else 0], ["en", "fr"][int(rng.integers(2))], int(rng.integers(1, 50)), 0.0) for i in range(600)]
    rows += [(700, "a", "zz", None, 0.0), (701, "a", "zz", 0, 0.0), (None, "b", "en", 5, 0.0), (5, "b", "en", 5, 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, s string, l string, n int, weight double").repartition(3)
    got = mixing.mix(df, {"s": 0.3, "l": 0.0}, "n", keep=0.4, sweeps=8).collect()
    cells = Counter()
    for _, s, l, n, _ in rows:
        cells[s, l] += n or 0
    q, p, targets = fit_by_hand(cells, [0.3, 0.0], 8)
    for d, t in enumerate(targets):  # the margins meet their targets
        for v, want in t.items():
            assert sum(w for c, w in q.items() if c[d] == v) == pytest.approx(want, abs=1e-6)
    probs = {}
    for r in got:
        c = r.s, r.l
        assert r.weight == pytest.approx(q[c] / p[c] if p[c] else 1.0, rel=1e-9)
        probs[c] = r.prob
        assert r.kept == (mixing_u(r.doc_id) < r.prob)
    assert sum(probs[c] * p[c] for c in p) == pytest.approx(0.4)
    ratio = {c: q[c] / p[c] for c in p if p[c]}
    factor = max(probs[c] / ratio[c] for c in ratio if ratio[c])
    assert all(probs[c] == pytest.approx(min(1.0, factor * ratio[c])) for c in ratio) and probs["a", "zz"] == 1.0


def mixing_u(key):
    import hashlib

    return int(hashlib.md5(str("" if key is None else key).encode()).hexdigest()[:8], 16) / 2**32


def test_mixing_fixed_targets_keep_all_and_empty_tables(spark):
    df = spark.createDataFrame([(i, "ab"[i % 4 == 0], 10) for i in range(400)], "doc_id long, s string, n int")
    got = mixing.mix(df, {"s": 1.0}, "n", keep=0.5, fixed={"s": {"a": 0.5, "b": 0.5}}).collect()
    assert {r.s: round(r.weight, 9) for r in got} == {"a": round(0.5 / 0.75, 9), "b": 2.0}
    assert {r.s: r.prob for r in got} == {"a": pytest.approx(1 / 3), "b": 1.0}
    assert all(r.kept for r in mixing.mix(df, {"s": 1.0}, "n", keep=1.0).collect())
    assert mixing.mix(df.limit(0), {"s": 1.0}, "n").count() == 0
    docs = spark.createDataFrame([(1, None, None, None), (2, "", "s", "en"), (3, "a | b", "s", "en"), (4, "The License", "s", "en"), (5, "w " * 300, "s", "en")], "doc_id long, text string, source string, lang string")
    assert {r.doc_id: (r.topic, r.n_tokens) for r in mixing.mix_documents(docs).collect()} == {1: ("empty", 0), 2: ("empty", 0), 3: ("tabular", 3), 4: ("legal", 2), 5: ("medium", 300)}
