import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tabloom.llm import packing

PATHS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN
LONG = " ".join(f"w{i} été" for i in range(3000))
TEXTS = [None, "", " ", "Hello  there\n\n it's 12345 o'clock", "<|endoftext|> inside <|endoftext|>", LONG, LONG, "x" * 30_000, "日本語テキスト 🙂", "a b c"] + [
    " ".join("word%d" % (i * j % 97) for j in range(i * 9)) for i in range(60)
]


def optimum(items, capacity):
    """Fewest bins, by trying everything."""
    best = [len(items)]

    def go(i, free):
        if len(free) >= best[0]:
            return
        if i == len(items):
            best[0] = len(free)
            return
        for k in {f: k for k, f in enumerate(free) if f >= items[i]}.values():
            go(i + 1, free[:k] + [free[k] - items[i]] + free[k + 1 :])
        go(i + 1, [*free, capacity - items[i]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(25))
def test_branch_and_bound_is_optimal_on_small_inputs(seed):
    rng = random.Random(seed)
    items = sorted((rng.randint(8, 60) for _ in range(11)), reverse=True)
    bins, proven = packing.complete_bins(items, 100)
    assert Counter(x for b in bins for x in b) == Counter(items) and all(sum(b) <= 100 for b in bins)
    want = optimum(items, 100)
    assert proven and len(bins) == want >= packing.lower_bound(Counter(items), 100)
    few, proven = packing.complete_bins(items, 100, nodes=3)
    assert len(few) >= want and (not proven or len(few) == want)
    plan = packing.plan_packing(Counter(items), 100)
    assert sum(t for t, _ in plan) <= want + 1


def test_plan_packs_all_and_is_near_the_bound():
    rng = random.Random(3)
    counts = Counter(int(1023 * rng.random() ** 1.3) + 1 for _ in range(50_000))
    plan = packing.plan_packing(counts, 1024)
    got = Counter()
    for times, sizes in plan:
        assert sum(sizes) <= 1024
        for s in sizes:
            got[s] += times
    assert got == counts
    assert sum(t for t, _ in plan) <= packing.lower_bound(counts, 1024) * 1.001 + 1
    assert len(packing._places(plan)) < 10_000


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_over_a_histogram_is_best_fit(seed):
    rng = random.Random(seed)
    items = [rng.randint(1, 60) for _ in range(400)]
    counts = Counter(items)
    patterns = packing._best_fit_patterns(counts, 100)
    assert Counter(s for t, one in patterns for s in one for _ in range(t)) == counts and all(sum(one) <= 100 for _, one in patterns)
    assert packing._bins(patterns) == len(packing._best_fit(items, 100))


def test_ids_equal_those_of_tokenizers():
    slow, fast = Tokenizer.from_file(PATHS[0]), packing._encoder(*PATHS)
    for t in TEXTS:
        assert slow.encode(t or "", add_special_tokens=False).ids == list(fast(t or ""))


@pytest.mark.parametrize("buckets", [4096, 1])
def test_pack(spark, monkeypatch, buckets):
    monkeypatch.setattr(packing, "BUCKETS", buckets)
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(TEXTS)] + [(1, "", 6), (None, "null key", 7)], "doc_id long, text string, length int")
    rows = packing.pack(docs.repartition(3), *PATHS, capacity=128).collect()
    tok = Tokenizer.from_file(PATHS[0])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert len(by_doc[1]) == 2 and len(by_doc[None]) == 1
    for i, t in enumerate(TEXTS):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        got = sorted(by_doc[i], key=lambda r: r.piece)[: None if i != 1 else 1]
        assert [r.length for r in got] == packing.piece_lengths(len(ids), 128)
        assert [r.start for r in got] == list(np.cumsum([0] + [r.length for r in got])[:-1])
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in got)
    for found in by_sequence.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 128


def test_empty_table_and_full_pieces_only(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), *PATHS).count() == 0
    one = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [tuple(r)[:4] for r in packing.pack(one, *PATHS, capacity=1).collect()] == [(1, 0, 0, 1)]
