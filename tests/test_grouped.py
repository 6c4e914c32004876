"""Linear models from sums of products, and trees that grow in shared passes, against plain computations."""

import math
import time
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import profile, quantiles
from tabloom.operators.ordering import ORD
from tabloom.plans import grouped, models, trees


def table(spark, n=400, gaps=True):
    rng = np.random.default_rng(7)
    x, z = rng.normal(100, 5, n), rng.normal(0, 2, n)
    c = rng.choice(["a", "b", "c"], n)
    y = 3 * x - 2 * z + (c == "b") * 7 + rng.normal(0, 1, n)
    rows = [(i, f" {'PQ'[i % 2]}" if i % 3 else "pq"[i % 2], None if gaps and i % 11 == 0 else float(x[i]), float("nan") if gaps and i % 13 == 0 else float(z[i]), None if gaps and i % 17 == 0 else str(c[i]), float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, f"{ORD} long, b string, x double, z double, c string, y double").repartition(5), rows


def design(rows, fill_from):
    """Features with medians and most frequent values of the rows in fill_from, as the assembler makes them."""
    known = lambda v: v is not None and v == v
    mx, mz = (np.median([r[j] for r in fill_from if known(r[j])]) for j in (2, 3))
    values = [r[4] for r in fill_from if r[4]]
    mode = min(sorted(set(values)), key=lambda v: -values.count(v))
    return np.array([[r[2] if known(r[2]) else mx, r[3] if known(r[3]) else mz, *[float((r[4] or mode) == v) for v in "abc"]] for r in rows])


def by_hand(x, y, alpha, ratio):
    xc, yc = x - x.mean(0), y - y.mean()
    if ratio is None:
        w = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc)
    else:
        w, n = np.zeros(x.shape[1]), len(y)
        for _ in range(3000):
            for j in range(len(w)):
                rest = yc - xc @ w + xc[:, j] * w[j]
                pull = xc[:, j] @ rest / n
                w[j] = np.sign(pull) * max(abs(pull) - alpha * ratio, 0) / (xc[:, j] @ xc[:, j] / n + alpha * (1 - ratio))
    return w, y.mean() - x.mean(0) @ w


@pytest.mark.parametrize("few", [0, 14])
def test_linear_models_of_all_folds_and_blocks(spark, monkeypatch, few):
    monkeypatch.setattr(grouped, "FEW_TERMS", few)
    df, rows = table(spark)
    task = models.Task(df, "y", ["x", "z"], ["c"])
    folds = {r[ORD]: r.fold for r in models.with_folds(df, 3).select(ORD, "fold").collect()}
    groups = models._groups(task, 3, models.block_key("b"))
    specs = [(1.0, None), (0.1, 0.5)]
    got = {(r["__group"], r["__fold"]): r for r in grouped.errors(groups, grouped.solve(groups, specs)).collect()}
    assert len(got) == 6
    for (b, fold), r in got.items():
        mine = [x for x in rows if x[1].strip().lower() == b]
        train, held = [x for x in mine if folds[x[0]] != fold], [x for x in mine if folds[x[0]] == fold]
        assert r["n"] == len(held)
        y, yh = np.array([x[5] for x in train]), np.array([x[5] for x in held])
        for i, spec in enumerate(specs):
            w, intercept = by_hand(design(train, train), y, *spec)
            assert r[f"e{i}"] == pytest.approx(np.abs(yh - design(held, train) @ w - intercept).mean(), rel=1e-6)
        assert r["e2"] == pytest.approx(np.abs(yh - np.median(y)).mean())


def test_elastic_net_as_mllib(spark):
    df, _ = table(spark, gaps=False)
    c = next(c for c in models.registry() if c.name == "elastic_net_alpha0.01_l10.3")
    mine = models.fit(c, df, "y", ["x", "z"], ["c"]).transform(df)
    other = models.Prepared(df, "y", ["x", "z"], ["c"]).fit(c).transform(df).select(ORD, F.col("prediction").alias("other"))
    assert isinstance(models.fit(c, df, "y", ["x", "z"], ["c"]), models.Direct)
    assert mine.join(other, ORD).agg(F.max(F.abs(F.col("prediction") - F.col("other")))).first()[0] < 1e-4


def test_constant_features_and_few_rows(spark):
    df = spark.createDataFrame([(i, 1.0, None, "k", float(i % 4)) for i in range(30)], f"{ORD} long, x double, z double, c string, y double")
    for c in (c for c in models.registry() if c.linear):
        assert all(0 <= r.prediction <= 3 for r in models.fit(c, df, "y", ["x", "z"], ["c"]).transform(df).collect())
    empty = models.fit(next(c for c in models.registry() if c.linear), df.limit(0), "y", ["x"], [])
    assert empty.transform(df).first().prediction == 0.0


def grown_by_hand(x, y, weight, spec, seed, tree, low, high, cuts):
    """Predictions of one tree for the training rows, by plain recursion."""
    out = np.zeros(len(y))

    def visit(rows, depth, path, low, high):
        n, s = weight[rows].sum(), (weight * y)[rows].sum()
        out[rows] = s / n if n else 0.0
        if depth == spec.depth:
            return
        best = None
        for f in range(x.shape[1]):
            options = [low[f] + float(trees.uniform(seed, tree, path, f)) * (high[f] - low[f])] if spec.random else list(cuts[f])
            for k, cut in enumerate(options):
                left = rows & (x[:, f] <= cut)
                nl, sl = weight[left].sum(), (weight * y)[left].sum()
                if nl >= spec.leaf and n - nl >= spec.leaf:
                    gain = sl * sl / nl + (s - sl) ** 2 / (n - nl) - s * s / n
                    if best is None or gain > best[0] + 1e-9:
                        best = gain, f, cut, left
        if best is None or best[0] <= 1e-9 * max(1.0, abs(s)):
            return
        _, f, cut, left = best
        h, lo = high.copy(), low.copy()
        h[f], lo[f] = cut, cut
        visit(left, depth + 1, path * 2 + 1, low, h)
        visit(rows & ~left, depth + 1, path * 2 + 2, lo, high)

    visit(np.ones(len(y), bool), 0, 0, low, high)
    return out


@pytest.mark.parametrize("random", [True, False])
def test_trees_as_by_hand(spark, monkeypatch, random):
    df, rows = table(spark, 300, gaps=False)
    task = models.Task(df, "y", ["x", "z"], ["c"])
    groups = models._groups(task, 3)
    spec = trees.TreeSpec(4, 4, 2, random)
    made = trees.features(groups, not random)
    forest = trees.grow(groups, spec, made, [0, 2, 3], seed=5)
    monkeypatch.setattr(trees, "HELD_ENTRIES", 0)
    again = trees.grow(groups, spec, made, [0, 2, 3], seed=5)
    got = groups.rows.select(ORD, "__fold", F.xxhash64("__key").alias("h"), *[trees.prediction(forest, made, F.lit(i)).alias(f"p{i}") for i in (0, 2, 3)], *[trees.prediction(again, made, F.lit(i)).alias(f"q{i}") for i in (0, 2, 3)]).collect()
    at = {r[ORD]: r for r in got}
    x, y = np.array([[r[2], r[3], *[float(r[4] == v) for v in "abc"]] for r in rows]), np.array([r[5] for r in rows])
    fold = np.array([at[r[0]]["__fold"] for r in rows])
    drawn = np.ones((len(y), 4)) if random else trees.draws(5, np.array([at[r[0]]["h"] for r in rows]), 4)
    assert random or 0.8 < drawn.mean() < 1.2
    for part in (0, 2, 3):
        mine = fold != part
        want = np.mean([grown_by_hand(x[mine], y[mine] - y.mean(), drawn[mine, t], spec, 5, t, made.low, made.high, made.cuts) for t in range(4)], axis=0) + y.mean()
        assert np.allclose(want, np.array([at[r[0]][f"p{part}"] for r in rows])[mine])
        assert np.allclose([at[r[0]][f"q{part}"] for r in rows], [at[r[0]][f"p{part}"] for r in rows])


def test_extra_trees_are_better_than_the_median(spark):
    df, _ = table(spark)
    task = models.Task(df, "y", ["x", "z"], ["c"])
    pool = [c for c in models.registry() if c.name in ("extra_trees_depth6_leaf2_n80", "ridge_alpha1", "dummy_median")]
    chosen = models.choose(task, 400, candidates=pool, seconds=3600)
    score = {r.model: r.score_mean for r in chosen.rows if r.status == "ok"}
    assert score["ridge_alpha1"] < score["extra_trees_depth6_leaf2_n80"] < 0.5 * score["dummy_median"]
    fitted = models.fit(pool[1] if pool[1].trees else next(c for c in pool if c.trees), df, "y", ["x", "z"], ["c"])
    assert isinstance(fitted, models.Direct) and fitted.transform(df).agg(F.avg(F.abs(F.col("y") - F.col("prediction")))).first()[0] < score["dummy_median"] / 2


@pytest.mark.parametrize("one_pass_rows", [10**9, 0])
@pytest.mark.parametrize("broadcast", [0, 100])
def test_grouped_quantiles(spark, monkeypatch, one_pass_rows, broadcast):
    """One group holds 95 % of the rows, one only nulls, one is null itself."""
    monkeypatch.setattr(quantiles, "BROADCAST_GROUPS", broadcast)
    rng = np.random.default_rng(1)
    rows = [("hot" if i % 20 else "cold" if i % 40 else None, float(rng.normal()), float(i % 3) if i % 7 else None) for i in range(6000)] + [("none", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, a double, b double").repartition(6)
    probs = [0.0, 0.1, 0.5, 1.0]
    got = {r.g: r for r in quantiles.grouped_quantiles(df, ["g"], {"a": F.col("a"), "b": F.col("b")}, probs, one_pass_rows=one_pass_rows).collect()}
    assert set(got) == {"hot", "cold", None, "none"} and got["none"].a is None
    for g in ("hot", "cold", None):
        for k, c in ((1, "a"), (2, "b")):
            assert got[g][c] == pytest.approx(np.quantile([r[k] for r in rows if r[0] == g and r[k] is not None], probs))
    by = profile.target_by_block(df, "a", "g").collect()
    assert [r.block for r in by][:1] == ["hot"] and by[0].median_target == pytest.approx(np.median([r[1] for r in rows if r[0] == "hot"]))


def test_a_slow_candidate_ends_with_the_clock(spark):
    """Its running job is cancelled, and those after it are skipped."""
    df, _ = table(spark, 100)
    slow = models.Candidate("slow", "x", 1, lambda *a: spark.range(10**13).selectExpr("sum(hash(id, id % 7))").first())
    dummy = next(c for c in models.registry() if c.family == "dummy")
    models.choose(models.Task(df, "y", ["x"], []), 100, candidates=[dummy], seconds=60)
    began = time.monotonic()
    chosen = models.choose(models.Task(df, "y", ["x"], []), 100, candidates=[dummy, slow, next(c for c in models.registry() if c.family == "huber")], seconds=8)
    assert time.monotonic() - began < 9.5
    assert [r.status for r in chosen.rows][:3] == ["ok", "skipped_time_budget", "skipped_time_budget"] and chosen.candidate is dummy
    assert spark.range(5).count() == 5


def test_errors_of_candidates_come_through(spark):
    with pytest.raises(KeyError):
        models.Clock(30).within(spark, lambda: {}["no"])


@pytest.mark.parametrize("random", [True, False])
def test_trees_of_cells_are_trees_of_rows(spark, monkeypatch, random):
    """Rows of equal features are one row of each level's pass, and the forest is the same (4096 rows: sums are exact, so ties fall alike)."""
    df = spark.range(4096).select((F.col("id") % 7).cast("double").alias("x"), F.when(F.col("id") % 11 > 0, F.col("id") % 5).alias("z"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit(None)), (F.col("id") % 3 + 1).cast("int")).alias("c"), (F.col("id") % 7 * 3 + F.hash("id") % 5).cast("double").alias("y"), F.col("id").alias(ORD))
    groups = models._groups(models.Task(df, "y", ["x", "z"], ["c"]), 3)
    spec = trees.TreeSpec(4, 4, 2, random)
    made = trees.features(groups, not random)
    alike = trees.cells(groups, spec, made, 1.0, 5)
    assert alike.count() <= 7 * 6 * 3 * 3
    if random:
        assert alike.agg(F.sum(F.col("n")[0])).first()[0] == 4096
    merged = trees.grow(groups, spec, made, [0, 2, 3], seed=5)
    monkeypatch.setattr(trees, "cells", lambda *a: None)
    plain = trees.grow(groups, spec, made, [0, 2, 3], seed=5)
    assert (merged.feature == plain.feature).all() and (merged.left == plain.left).all() and np.allclose(merged.cut, plain.cut) and np.allclose(merged.value, plain.value)
    x = np.array([[1.0, 2.0], [np.nan, 2.0], [1.0, 2.0]])
    assert trees.Forest(np.zeros((1, 1), int), np.zeros((1, 2)), 5.0, np.array([-1]), np.zeros(1), np.zeros(1, int), np.ones(1)).predict(x, 0).tolist() == [6.0] * 3


def test_medians_are_only_taken_for_blocks_without_models(spark, monkeypatch):
    """Blocks with a model of their own don't pay for a median and its error that nobody asks for."""
    rows = [(i, "large" if i < 60 else "small", float(i % 7), float(3 * (i % 7) + i % 2)) for i in range(70)]
    df = spark.createDataFrame(rows, f"{ORD} long, b string, x double, y double").repartition(3)
    asked, made = [], models.grouped_quantiles
    monkeypatch.setattr(models, "grouped_quantiles", lambda frame, *more: asked.append({r["__group"] for r in frame.select("__group").distinct().collect()}) or made(frame, *more))
    pool = [c for c in models.registry() if c.family in ("ridge", "dummy")]
    blocks, score, found = models.search_per_block(models.Task(df, "y", ["x"], [], block="b"), models.Clock(600), candidates=pool)
    labels = [r[3] for r in rows[60:]]
    error = float(np.mean(np.abs(np.array(labels) - np.median(labels))))
    assert asked == [{"small"}] and blocks["small"].candidate is None and blocks["small"].score == pytest.approx(error) and blocks["large"].candidate.family == "ridge"
    assert [(r.block, r.status, r.score_mean) for r in found if r.model == "median_fallback"] == [("small", "fallback_insufficient_rows", pytest.approx(error))]


def test_means_hold_no_round_off(spark):
    """However the rows are dealt; values far beyond the expected size, and sizes for which there is no grid, still have a mean."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.uniform(0, 1e5, 20_000), rng.uniform(0, 1e-9, 500), -rng.uniform(0, 1e3, 500)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    mean = lambda rows, n, top: rows.agg(grouped.exact_mean(F.col("x"), n, top)).first()[0]
    assert {mean(df.repartition(k), len(x), 1e5) for k in (1, 2, 7)} == {math.fsum(x) / len(x)}
    assert mean(df, len(x), 1e-3) == mean(df, 1, 1e-300) == mean(df, len(x), 1e308) == mean(df, 0, 0.0) == pytest.approx(math.fsum(x) / len(x), rel=1e-12)
    assert mean(df.limit(0), 5, 1.0) is None


def test_scores_do_not_hang_on_the_order_of_rows(spark):
    rng = np.random.default_rng(11)
    rows = [(i, float(rng.integers(1, 50)), float(rng.integers(10**5, 10**7)) / 100) for i in range(20_000)]
    groups = models._groups(models.Task(spark.createDataFrame(rows, f"{ORD} long, x double, y double"), "y", ["x"], []), 3)
    assert groups.top == max(r[2] for r in rows)
    solved = grouped.solve(groups, [(0.1, None), (10, None)])
    fold = F.col("__fold")
    each = solved.joined(groups.rows).select(fold, *[F.abs(F.col("__label") - p) for p in (solved.prediction(fold, 0), solved.prediction(fold, 1), solved.median(fold))]).collect()
    for parts in (1, 6):
        for r in grouped.errors(replace(groups, rows=groups.rows.repartition(parts)), solved).collect():
            assert [r[f"e{m}"] for m in range(3)] == [math.fsum(x[m + 1] for x in each if x[0] == r["__fold"]) / r["n"] for m in range(3)]
