"""Ensembles of regression trees that grow level by level: one pass over the rows and one aggregate per level serve all trees and all folds."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.operators.profile import number
from tabloom.plans.grouped import MOST_TERMS, Groups

#: Cuts of a feature that a forest tries, at its quantiles.
MOST_CUTS = 63
#: Statistics that a task holds before it hands them on.
HELD_ENTRIES = 4_000_000


@dataclass(frozen=True)
class TreeSpec:
    """random: one random cut for each feature and node, over all rows; else the best of the fixed cuts, over rows drawn with replacement."""

    trees: int
    depth: int
    leaf: int = 2
    random: bool = True


def mixed(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of 64 bits."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(*parts) -> np.ndarray:
    """A number in [0, 1) that the parts (integers or arrays of them) determine."""
    h = np.uint64(0x9E3779B97F4A7C15)
    for p in parts:
        h = mixed(h ^ mixed(np.asarray(p).astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)))
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def random_cuts(seed: int, tree: np.ndarray, path: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """nodes x features: each node's cut of each feature, uniform between the bounds of the node's box."""
    f = np.arange(low.shape[1])
    return low + uniform(seed, tree[:, None], path[:, None], f[None, :]) * (high - low)


_POISSON = np.cumsum(np.exp(-1.0) / np.array([1, 1, 2, 6, 24, 120, 720, 5040, 40320]))


def draws(seed: int, rows: np.ndarray, trees: int) -> np.ndarray:
    """rows x trees: how often each row is drawn for each tree, from the row's own hash."""
    return np.searchsorted(_POISSON, uniform(seed, rows.view(np.uint64)[:, None], np.arange(trees)[None, :])).astype(np.float64)


@dataclass
class Forest:
    """Nodes of all trees: feature (-1: leaf), cut, left child (the right one follows), value; roots by part and tree; what fills missing features by part."""

    roots: np.ndarray
    fills: np.ndarray
    mean: float
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    cut: np.ndarray = field(default_factory=lambda: np.zeros(0))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def filled(self, x: np.ndarray, part: int) -> np.ndarray:
        gaps = np.isnan(x)
        return np.where(gaps, self.fills[part], x) if gaps.any() else x

    def walk(self, x: np.ndarray, part: int) -> np.ndarray:
        """rows x trees: the node at which each row ends; x without gaps."""
        node = np.repeat(self.roots[part][None, :], len(x), axis=0)
        at = np.arange(len(x))[:, None]
        while True:
            feature = self.feature[node]
            inner = feature >= 0
            if not inner.any():
                return node
            below = x[at, np.maximum(feature, 0)] <= self.cut[node]
            node = np.where(inner, self.left[node] + ~below, node)

    def predict(self, x: np.ndarray, part: int) -> np.ndarray:
        """Equal rows walk the trees once."""
        if not x.shape[1] or not len(x):
            return np.full(len(x), self.mean)
        x = np.ascontiguousarray(x)
        _, first, which = np.unique(x.view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
        return (self.mean + self.value[self.walk(self.filled(x[first], part), part)].mean(axis=1))[which]


@dataclass
class Features:
    """The features of trees as one array column, NaN where missing, and their fills, ranges and quantiles."""

    column: Column
    fills: np.ndarray  # part x feature
    low: np.ndarray
    high: np.ndarray
    cuts: list[np.ndarray]


def features(groups: Groups, cuts: bool) -> Features | None:
    """Numbers as they are, and 0 or 1 for each value of a category; None for too many. Missing numbers take the median of each training
    part, missing categories its most frequent value."""
    rows, parts = groups.rows, groups.folds + 1
    text = lambda c: F.col(f"`{c}`").cast("string")
    columns, values = [number(rows, c) for c in groups.numeric], {}
    for c in groups.categories:
        values[c] = [r[0] for r in rows.select(text(c).alias("v")).where("v is not null").distinct().orderBy("v").limit(MOST_TERMS + 1).collect()]
        columns += [(text(c) == v).cast("double") for v in values[c]]
        if len(columns) > MOST_TERMS:
            return None
    if not columns:
        return None
    named = rows.select("__fold", *[x.alias(f"f{j}") for j, x in enumerate(columns)], *[text(c).alias(f"c{j}") for j, c in enumerate(groups.categories)])
    probs = [(i + 1) / (MOST_CUTS + 1) for i in range(MOST_CUTS)]
    aggs = [x for j in range(len(columns)) for x in (F.min(f"f{j}"), F.max(f"f{j}"), F.count(f"f{j}"))]
    aggs += [F.percentile_approx(f"f{j}", probs, 1_000) for j in range(len(columns))] if cuts else []
    got = named.agg(F.count(F.lit(1)), *aggs).first()
    n, p = got[0], len(columns)
    low, high = np.array([got[1 + 3 * j] or 0.0 for j in range(p)]), np.array([got[2 + 3 * j] or 0.0 for j in range(p)])
    fills = np.zeros((parts, p))
    gaps = [j for j in range(len(groups.numeric)) if got[3 + 3 * j] < n]
    train = lambda c: [F.when(F.col("__fold") != i, F.col(c)) for i in range(groups.folds)] + [F.col(c)]
    if gaps:
        from tabloom.operators.quantiles import exact_quantiles

        found = exact_quantiles(named, {f"{j}_{i}": e for j in gaps for i, e in enumerate(train(f"f{j}"))}, [0.5], n)
        for j in gaps:
            fills[:, j] = [found[f"{j}_{i}"][0] or 0.0 for i in range(parts)]
    blank = [(j, c) for j, c in enumerate(groups.categories) if values[c] and got[3 + 3 * (len(groups.numeric) + sum(len(values[x]) for x in groups.categories[:j]))] < n]
    if blank:
        modes = named.agg(*[F.mode(e, True) for j, _ in blank for e in train(f"c{j}")]).first()
        for k, (j, c) in enumerate(blank):
            first = len(groups.numeric) + sum(len(values[x]) for x in groups.categories[:j])
            for i in range(parts):
                if modes[k * parts + i] in values[c]:
                    fills[i, first + values[c].index(modes[k * parts + i])] = 1.0
    fixed = []
    for j in range(p if cuts else 0):
        q = np.unique(np.array(got[1 + 3 * p + j] if got[1 + 3 * p + j] is not None else [], float))
        fixed.append(q[q < high[j]] if len(q) else q)
    return Features(F.array(*[F.coalesce(c, F.lit(float("nan"))) for c in columns]), fills, low, high, fixed)


def cells(groups: Groups, spec: TreeSpec, made: Features, mean: float, seed: int) -> DataFrame | None:
    """Rows of equal features and fold as one cell: x, __fold, and the arrays n and s, their number and the sum of their labels less mean, once for all
    trees, or for each tree by its draws of the rows. Sums over cells are sums over rows, so trees grow alike. None unless that halves the rows, or if cells
    and trees are too many for a task to hold."""
    rows, width = groups.rows, 1 if spec.random else spec.trees
    keys = [*[f"`{c}`" for c in (*groups.numeric, *groups.categories)], "__fold"]
    about = rows.agg(F.approx_count_distinct(F.xxhash64(*keys))).first()[0]
    if 2 * about > groups.n_rows or (not spec.random and about * width > HELD_ENTRIES):
        return None
    context = rows.sparkSession.sparkContext
    tasks = min(about // 1_000 + 1, max(context.defaultParallelism, about // 100_000))
    y = F.col("__label") - F.lit(mean)
    x = made.column.alias("x")
    if spec.random:
        alike = rows.groupBy(*[F.col(k) for k in keys]).agg(F.count("*").cast("double").alias("__n"), F.sum(y).alias("__s"))
        return alike.select(x, "__fold", F.array("__n").alias("n"), F.array("__s").alias("s")).repartition(tasks)
    alike = rows.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).distinct()
    alike = alike.withColumn("__cell", F.row_number().over(Window.orderBy(*[f"__k{i}" for i in range(len(keys))])) - 1).cache()  # few, see above
    count = alike.count()

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s = np.zeros((count, width)), np.zeros((count, width))
        for batch in batches:
            if not len(batch):
                continue
            batch = batch.sort_values("cell")
            at, first = np.unique(batch["cell"].to_numpy(), return_index=True)
            weight = draws(seed, batch["row"].to_numpy(), width)
            n[at] += np.add.reduceat(weight, first)
            s[at] += np.add.reduceat(weight * batch["y"].to_numpy()[:, None], first)
        cell, tree = np.nonzero(n)
        yield pd.DataFrame({"cell": cell.astype(np.int32), "tree": tree.astype(np.int32), "n": n[cell, tree], "s": s[cell, tree]})

    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    met = rows.join(F.broadcast(alike), same).select(F.col("__cell").alias("cell"), y.alias("y"), F.xxhash64("__key").alias("row"))
    drawn = met.mapInPandas(partial, "cell int, tree int, n double, s double").groupBy("cell", "tree").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    of = drawn.groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct("tree", "n"))).alias("__n"), F.map_from_entries(F.collect_list(F.struct("tree", "s"))).alias("__s"))
    every = lambda c: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda t: F.coalesce(F.col(c)[t], F.lit(0.0)))
    known = of.join(F.broadcast(alike), F.col("cell") == F.col("__cell")).select(*[F.col(f"__k{i}").alias(k.strip("`")) for i, k in enumerate(keys)], every("__n").alias("__n"), every("__s").alias("__s"))
    return known.select(x, "__fold", F.col("__n").alias("n"), F.col("__s").alias("s")).repartition(tasks)


def grow(groups: Groups, spec: TreeSpec, made: Features, parts: Sequence[int], seed: int = 42) -> Forest:
    """Trees of the training parts `parts` (without fold i; groups.folds: of all rows), all at once.

    Each level is one pass: tasks walk their rows down to the growing nodes and sum count and label per (node, feature, side of the cut);
    the engine merges the sums and picks each node's split of largest gain (of equal ones the first feature, then the lowest cut), with `leaf` rows on either
    side at least. A random cut lies uniformly in the node's box: the feature's range in the table, narrowed by the cuts above it; it is drawn from a
    hash of seed, tree, path and feature, so a tree is the same wherever it grows. The nodes (parts x trees x 2^depth at most, and no more than the rows allow) are
    the only thing that passes the driver. Where many rows have the same features, the passes are over their cells.
    """
    p, trees = made.fills.shape[1], spec.trees
    mean = groups.rows.agg(F.avg("__label")).first()[0] or 0.0
    rows = cells(groups, spec, made, mean, seed)
    if rows is not None:
        rows = rows.cache()
    else:
        rows = groups.rows.select(made.column.alias("x"), "__fold", "__label", F.xxhash64("__key").alias("row"))
    roots = np.full((groups.folds + 1, trees), -1, np.int64)
    roots[list(parts)] = np.arange(len(parts) * trees).reshape(len(parts), trees)
    count = len(parts) * trees
    forest = Forest(roots, made.fills, mean, np.full(count, -1, np.int32), np.zeros(count), np.zeros(count, np.int32), np.zeros(count))
    active = np.arange(count)
    tree, path = np.tile(np.arange(trees), len(parts)), np.zeros(count, np.uint64)
    low, high = np.repeat(made.low[None, :], count, axis=0), np.repeat(made.high[None, :], count, axis=0)
    best = F.max(F.when(F.col("gain").isNotNull(), F.struct("gain", (-F.col("f")).alias("f"), (-F.col("bin")).alias("bin"), "nl", "sl")))
    for depth in range(spec.depth + 1):
        cuts = random_cuts(seed, tree, path, low, high) if spec.random else None
        sums = rows.mapInPandas(_level(forest, active, cuts, made.cuts, spec, groups.folds, list(parts), p, seed), "node int, f int, bin int, n double, s double")
        merged = sums.groupBy("node", "f", "bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        over = Window.partitionBy("node", "f")
        upto = over.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        each = merged.select("node", "f", "bin", F.sum("n").over(upto).alias("nl"), F.sum("s").over(upto).alias("sl"), F.sum("n").over(over).alias("n"), F.sum("s").over(over).alias("s"))
        nr, sr = F.col("n") - F.col("nl"), F.col("s") - F.col("sl")
        gain = F.col("sl") * F.col("sl") / F.col("nl") + sr * sr / nr - F.col("s") * F.col("s") / F.col("n")
        each = each.withColumn("gain", F.when((F.col("nl") >= spec.leaf) & (nr >= spec.leaf) & (F.lit(depth) < spec.depth), gain))
        found = each.groupBy("node").agg(F.max("n").alias("n"), F.first("s").alias("s"), best.alias("best")).collect()
        found.sort(key=lambda r: r["node"])  # children are numbered alike wherever they are found
        split = [r for r in found if r["best"] is not None and r["best"]["gain"] > 1e-9 * max(1.0, abs(r["s"]))]
        for r in found:
            forest.value[active[r["node"]]] = r["s"] / r["n"] if r["n"] else 0.0
        if not split:
            break
        slot = np.array([r["node"] for r in split])
        f, b = np.array([-r["best"]["f"] for r in split]), np.array([-r["best"]["bin"] for r in split])
        at = cuts[slot, f] if spec.random else np.array([made.cuts[j][k] for j, k in zip(f, b)])
        begin = len(forest.feature)
        parent, left = active[slot], begin + 2 * np.arange(len(split))
        forest.feature[parent], forest.cut[parent], forest.left[parent] = f, at, left
        more = 2 * len(split)
        forest.feature, forest.cut = np.append(forest.feature, np.full(more, -1, np.int32)), np.append(forest.cut, np.zeros(more))
        forest.left, forest.value = np.append(forest.left, np.zeros(more, np.int32)), np.append(forest.value, np.zeros(more))
        active = begin + np.arange(more)
        tree = np.repeat(tree[slot], 2)
        path = np.repeat(path[slot] * np.uint64(2), 2) + np.tile(np.array([1, 2], np.uint64), len(split))
        low, high = np.repeat(low[slot], 2, axis=0), np.repeat(high[slot], 2, axis=0)
        high[np.arange(0, more, 2), f], low[np.arange(1, more, 2), f] = at, at
    return forest


def _level(forest: Forest, active: np.ndarray, cuts: np.ndarray | None, fixed: list[np.ndarray], spec: TreeSpec, folds: int, parts: list[int], p: int, seed: int):
    """What a task does for a level: statistics of its rows by growing node, feature and side."""
    slots = np.full(len(forest.feature), -1, np.int64)
    slots[active] = np.arange(len(active))
    bins = 2 if cuts is not None else max([len(c) for c in fixed], default=0) + 1
    width = p * bins

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = len(active) * width
        dense = size <= HELD_ENTRIES
        n, s = (np.zeros(size), np.zeros(size)) if dense else (None, None)
        for batch in batches:
            if not len(batch):
                continue
            x, fold = np.stack(batch["x"].to_numpy()), batch["__fold"].to_numpy()
            if "n" in batch:
                weight, label = np.stack(batch["n"].to_numpy()), np.stack(batch["s"].to_numpy())
            else:
                weight = np.ones((len(x), 1)) if spec.random else draws(seed, batch["row"].to_numpy(), forest.roots.shape[1])
                label = weight * (batch["__label"].to_numpy() - forest.mean)[:, None]
            for part in parts:
                mine = fold != part if part < folds else np.ones(len(x), bool)
                xs = forest.filled(x[mine], part)
                slot = slots[forest.walk(xs, part)]
                growing = slot >= 0
                row, tree = np.nonzero(growing)
                at = slot[growing]
                if not len(at):
                    continue
                column = tree if weight.shape[1] > 1 else 0
                w, ws = weight[mine][row, column], label[mine][row, column]
                keys = []
                for f in range(p):
                    side = xs[row, f] > cuts[at, f] if cuts is not None else np.searchsorted(fixed[f], xs[:, f], "left")[row]
                    keys.append(at * width + f * bins + side)
                if dense:
                    for key in keys:
                        n += np.bincount(key, w, size)
                        s += np.bincount(key, ws, size)
                else:
                    key = np.concatenate(keys)
                    u, inverse = np.unique(key, return_inverse=True)
                    yield _entries(u, np.bincount(inverse, np.tile(w, p)), np.bincount(inverse, np.tile(ws, p)), width, bins)
        if dense:
            there = np.flatnonzero(n)
            yield _entries(there, n[there], s[there], width, bins)

    return run


def _entries(key: np.ndarray, n: np.ndarray, s: np.ndarray, width: int, bins: int) -> pd.DataFrame:
    return pd.DataFrame({"node": (key // width).astype(np.int32), "f": (key % width // bins).astype(np.int32), "bin": (key % bins).astype(np.int32), "n": n, "s": s})


def prediction(forest: Forest, made: Features, part: Column) -> Column:
    """The forest's prediction for a row by the trees of a training part."""

    @F.pandas_udf("double")
    def predict(x: pd.Series, parts: pd.Series) -> pd.Series:
        out, values, each = np.zeros(len(x)), np.stack(x.to_numpy()) if len(x) else np.zeros((0, 1)), parts.to_numpy()
        for i in np.unique(each):
            out[each == i] = forest.predict(values[each == i], int(i))
        return pd.Series(out)

    return predict(made.column, part.cast("int"))
