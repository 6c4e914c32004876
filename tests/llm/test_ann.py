import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import ann


def brute(rows, step, k=5):
    """{query: [(vec_id, score)]} over all rows."""
    best = {}
    for i, v in rows:
        best[i] = min(v, best.get(i, v))
    out = {}
    for i, v in best.items():
        if i % step:
            continue
        score = lambda w: float((np.array(v) * np.array(w)).sum() / (np.sqrt((np.array(v) ** 2).sum()) * np.sqrt((np.array(w) ** 2).sum())))
        out[i] = sorted(((j, score(w)) for j, w in best.items() if j != i), key=lambda x: (-x[1], x[0]))[:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, "s") for i, v in rows], "vec_id long, embedding array<float>, score string").repartition(4)


@pytest.mark.parametrize("bits,radius", [(64, 0), (64, 3), (64, 21), (64, 64), (20, 5)])
def test_probing_finds_every_code_within_the_radius(bits, radius):
    rng = np.random.default_rng(0)
    on = rng.random((500, 64)) < 0.5
    on[100:200] = on[:100] ^ (rng.random((100, 64)) < 0.05)
    on[:, bits:] = False
    codes = np.packbits(on, axis=1)
    index = ann.Index(codes, bits)
    for q in range(0, 500, 25):
        want = np.flatnonzero((on != on[q]).sum(axis=1) <= radius)
        assert (index.within(codes[q], radius) == want).all()


def test_recall_and_exact_scores(spark):
    x = np.random.default_rng(1).normal(size=(6000, 64)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = found(ann.nearest(table(spark, rows), F.col("vec_id") % 50 == 0)), brute(rows, 50)
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    hits = np.mean([len({j for j, _ in got[q]} & {j for j, _ in want[q]}) / 5 for q in want])
    assert hits >= 0.95
    exact = {q: dict(v) for q, v in want.items()}
    for q, v in got.items():
        for j, s in v:
            assert math.isclose(s, exact[q].get(j, s), rel_tol=1e-12)


def test_ties_repeats_outliers_and_vectors_without_direction(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(40)] + [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(40, 90)]
    rows += [(7, [1.0, 2.0, 3.0, 4.0]), (50, [9.0, 9.0, 9.0, 9.0])]
    odd = [(100, None), (110, [0.0] * 4), (120, [1.0, None, 1.0, 1.0]), (130, [1.0, float("nan"), 1.0, 1.0]), (140, [1.0, float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0, 1.0]), (150, [1.0]), (160, [])]
    got, want = found(ann.nearest(table(spark, rows + odd), F.col("vec_id") % 10 == 0)), brute(rows, 10)
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    assert [j for j, _ in got[0]] == [1, 2, 3, 4, 5] and [j for j, _ in got[10]] == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("n", [0, 1, 2, 4])
def test_fewer_rows_than_asked_for(spark, n):
    rows = [(10 * i, [1.0, float(i)]) for i in range(n)]
    got = found(ann.nearest(table(spark, rows), F.col("vec_id") % 10 == 0))
    want = {q: v for q, v in brute(rows, 10).items() if v}
    assert {q: [j for j, _ in v] for q, v in got.items()} == {q: [j for j, _ in v] for q, v in want.items()}


def test_blocks_of_rows_and_queries(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(400, 8)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    one = found(ann.nearest(table(spark, rows), F.col("vec_id") % 5 == 0))
    monkeypatch.setattr(ann, "BLOCK", 100)
    monkeypatch.setattr(ann, "QUERIES", 30)
    assert found(ann.nearest(table(spark, rows), F.col("vec_id") % 5 == 0)) == one


def test_recall_where_ids_follow_clusters(spark):
    """The smallest ids are near copies of one another; the radius must fit the others all the same."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 32)).astype(np.float32)
    x[:600] = x[0] + 0.01 * rng.normal(size=(600, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = found(ann.nearest(table(spark, rows), F.col("vec_id") % 50 == 0)), brute(rows, 50)
    hits = [len({j for j, _ in got[q]} & {j for j, _ in want[q]}) / 5 for q in want if q >= 600]
    assert np.mean(hits) >= 0.95
