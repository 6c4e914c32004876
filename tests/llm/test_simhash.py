import random

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tabloom.llm import simhash


def brute(text, words=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, budget=3):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= budget:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def texts():
    rng = random.Random(4)
    base = [" ".join(rng.choice(["an", "the", "or", "Éa", "x%d" % k]) for k in range(rng.randint(0, 60))) for _ in range(60)]
    near = [t.replace("the", "or", 1) for t in base] + base[:20] + [t.upper() for t in base[:10]]
    return base + near + [None, "", " \t\n", "one", "one two", "x" * 200_000, "  a b", "a\u000bb\u001fc d"]


def test_fingerprints_equal_brute_force():
    for t in texts():
        assert simhash.fingerprint(t) == brute(t)


@pytest.mark.parametrize("depth", [0, 16])
def test_trie_links_equal_brute_force(depth):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = [np.uint64(1) << np.uint64(b) for b in range(64)]
    values = np.unique(np.concatenate([base] + [b ^ sum(rng.choice(flips, 2)) for b in base for _ in range(9)], axis=None).astype(np.uint64))
    top = values >> np.uint64(64 - depth) if depth else np.zeros(len(values), np.uint64)
    new = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]]))
    got = {(int(a), int(b)) for i, j in simhash.trie_links(values, new, np.append(new[1:], len(values)), depth) for a, b in zip(i, j)}
    want = {(i, j) for j in range(len(values)) for i in range(j) if top[i] == top[j] and int(values[i] ^ values[j]).bit_count() <= 3}
    assert got == want and want


@pytest.mark.parametrize("hot_run", [50_000, 3])
@pytest.mark.parametrize("budget,more", [(3, None), (4, None), (3, 2), (1, 9)])
def test_links_connect_what_brute_force_connects(spark, hot_run, budget, more):
    rng = random.Random(7)
    flip = lambda x, n: x ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, n))})
    base = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(25)] + [(0, 0)]
    pairs = sorted({(flip(a, budget + 1), flip(b, 3) if more is not None else 0) for a, b in base for _ in range(14)})
    root = list(range(len(pairs)))
    for i in range(len(pairs)):
        for j in range(i):
            if (pairs[i][0] ^ pairs[j][0]).bit_count() <= budget and (more is None or (pairs[i][1] ^ pairs[j][1]).bit_count() <= more):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    signed = [tuple(x - (1 << 64) if x >> 63 else x for x in p) for p in pairs]
    got = simhash.links(spark.createDataFrame(signed, "fp long, other long"), budget, more, hot_run)
    found = {tuple(r.node): tuple(r.root) for r in simhash.components(got).collect()}
    a = [found.get(x, x) for x in signed]
    assert len(set(zip(a, root))) == len(set(a)) == len(set(root))


def test_near_duplicates_equal_brute_force(spark):
    t = texts()
    rows = [(100 + i, x, 1) for i, x in enumerate(t)] + [(100, t[0], 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int").repartition(5)
    got = simhash.near_duplicates(docs).collect()
    fps = [brute(x) for x in t]
    want = {100 + i: (f"{fps[i]:016x}", 100 + c) for i, c in enumerate(classes(fps))}
    assert len(got) == len(rows)
    assert all((r.fingerprint, r.component_id) == want[r.doc_id] for r in got)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted({r.doc_id for r in kept.collect()}) == sorted({c for _, c in want.values()})


def test_keep_one_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BROADCAST_KEYS", 0)
    docs = spark.createDataFrame([(i, ["a b c d", "e f g h"][i % 2]) for i in range(9)], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [0, 1]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == simhash.keep_one(docs).count() == 0


def test_confirmed_links(spark):
    words = [f"w{i}" for i in range(300)]
    copy = words[:150] + ["changed"] + words[151:]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(copy)), (3, " ".join(reversed(words))), (None, " ".join(words))], "doc_id long, text string")
    loose = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, words=1, budget=4).collect()}
    strict = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, words=1, budget=4, confirm=(5, 14)).collect()}
    assert loose == {1: 1, 2: 1, 3: 1, None: 1} and strict == {1: 1, 2: 1, 3: 3, None: 1}
    assert sorted((r.doc_id or 0) for r in simhash.keep_one(docs, words=1, budget=4, confirm=(5, 14)).collect()) == [0, 1, 3]


def jaccard(a, b, words=5):
    x, y = ({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set() for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_near_copies_are_confirmed_by_similarity(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randint(0, 400)}" for _ in range(150)]
        for changes in (0, 0, 1, 2, 3, 4, 6, 9, 14, 20):
            w = list(base)
            for p in rng.sample(range(len(w)), changes):
                w[p] = f"v{rng.randint(0, 400)}"
            texts.append(" ".join(w))
    texts += ["", "  ", None, "one two", "One two"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(i, texts[k]) for i, k in enumerate(order)]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, x) in enumerate(rows):
        for j, (_, y) in enumerate(rows[:i]):
            if jaccard(x or "", y or "") >= 0.8:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    want = {i for i in range(len(rows)) if top(i) == i}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id for r in simhash.keep_one(docs, **corpus_pipeline.NEAR).collect()}
    assert got == want
    kept = [texts[order[i]] or "" for i in got]
    assert not any(jaccard(x, y) >= 0.8 for i, x in enumerate(kept) for y in kept[:i])  # no pair is missed here
    gone = [texts[order[i]] or "" for i in range(len(rows)) if i not in got]
    assert all(sum(jaccard(x, t or "") >= 0.8 for t in texts) > 1 for x in gone)  # itself and another
    assert simhash.keep_one(docs.limit(0), **corpus_pipeline.NEAR).count() == 0


def test_hot_runs_are_dealt_in_cells(spark):
    rng = random.Random(5)
    texts = []
    for changes in (3, 8, 14):  # families of near copies whose members also stand near other families
        base = [f"w{i}" for i in range(150)]
        for p in range(changes * 3):
            base[p * 3] = f"u{changes}"
        for _ in range(40):
            w = list(base)
            for p in rng.sample(range(len(w)), rng.randint(0, 5)):
                w[p] = f"v{rng.randint(0, 400)}"
            texts.append(" ".join(w))
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8 and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for hot_run in (1_000, 4_000, 4_000_000):
        rows, found = simhash.near_copies(docs, hot_run=hot_run)
        by_id = {r.id: r.component_id for r in found.collect()}
        assert [by_id[r.id] for r in rows.orderBy("k").collect()] == root


def test_cells_let_all_pairs_of_different_labels_meet(spark):
    labels = [0] * 50 + [1] * 9 + [2] * 8 + list(range(3, 10))
    rows = [(0, 5, i, i, 1, x) for i, x in enumerate(labels)] + [(1, 5, i, i, 1, 0) for i in range(30)] + [(0, 6, i, i, 1, i % 2) for i in range(4)]
    df = spark.createDataFrame(rows, "kind int, block long, fp long, id long, n int, label long")
    got = simhash._cells(df, 10)
    cells = {}
    for r in got.collect():
        cells.setdefault((r.kind, r.block), set()).add((r.id, r.label))
    assert max(map(len, cells.values())) < 50 and not any(k == 1 for k, _ in cells)
    met = {(a, b) for k, c in cells.items() if k != (0, 6) for a, x in c for b, y in c if x != y}
    assert met == {(i, j) for i, x in enumerate(labels) for j, y in enumerate(labels) if x != y}
    assert len(cells[0, 6]) == 4
