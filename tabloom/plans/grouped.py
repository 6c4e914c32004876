"""Cross-validation of all groups (a table, or each of its blocks) and all folds side by side: linear models from sums of products."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.scalar import is_finite
from tabloom.operators.profile import number
from tabloom.operators.quantiles import BROADCAST_GROUPS, grouped_quantiles

#: Linear models of more terms are left to the library's own solvers, one fit at a time.
MOST_TERMS = 400
#: Up to so many terms the sums are aggregates of the engine; more are summed by numpy in each task and then merged.
FEW_TERMS = 14
#: A task's sums are handed on when they take so many bytes.
HELD_BYTES = 64 << 20


@dataclass
class Groups:
    """Rows with a finite label (`__label`), their group (`__group`, never null), the row's key (`__key`), and its fold (`__fold`, under `folds`).
    top: the largest label, without its sign."""

    rows: DataFrame
    folds: int
    numeric: Sequence[str]
    categories: Sequence[str]
    n_rows: int
    top: float = 0.0

    def train_columns(self, value: Column) -> list[Column]:
        """value where it belongs to the training part of fold 0, 1, ..., and of the model of all rows."""
        return [F.when(F.col("__fold") != i, value) for i in range(self.folds)] + [value]


@dataclass
class Terms:
    """What a row adds to a linear model, the same for all groups and folds and never null: shifted numbers, indicators of values, and of what is missing."""

    columns: list[Column]
    base: np.ndarray  # features x terms: the features of a row without missing values
    gaps: list[tuple[str, int, int, float]]  # numeric columns with gaps: name, feature, term, shift
    blanks: list[tuple[str, int, int, list[str]]]  # categories with gaps: name, first feature, term, values


def terms(groups: Groups) -> Terms | None:
    """One aggregate over the rows; None for more than MOST_TERMS terms. Values of a category that only some folds know stay terms of all: where a
    training part lacks one, its sums are 0 and so is its weight."""
    rows = groups.rows
    text = lambda c: F.col(f"`{c}`").cast("string")
    aggs = [x for c in groups.numeric for x in (F.avg(number(rows, c)), F.count(number(rows, c)))] + [F.count(text(c)) for c in groups.categories]
    got = rows.agg(F.count(F.lit(1)), *aggs).first()
    n, columns, made, gaps, blanks = got[0], [], [], [], []
    for i, c in enumerate(groups.numeric):
        shift, there = got[1 + 2 * i] or 0.0, got[2 + 2 * i]
        made.append([len(columns)])
        columns.append(F.coalesce(number(rows, c) - F.lit(shift), F.lit(0.0)))
        if there < n:
            gaps.append((c, i, len(columns), shift))
            columns.append(number(rows, c).isNull().cast("double"))
    for i, c in enumerate(groups.categories):
        values = [r[0] for r in rows.select(text(c).alias("v")).where("v is not null").distinct().orderBy("v").limit(MOST_TERMS + 1).collect()]
        if len(columns) + len(values) > MOST_TERMS:
            return None
        first = len(made)
        made += [[len(columns) + k] for k in range(len(values))]
        columns += [F.coalesce((text(c) == v).cast("double"), F.lit(0.0)) for v in values]
        if got[1 + 2 * len(groups.numeric) + i] < n:
            blanks.append((c, first, len(columns), values))
            columns.append(text(c).isNull().cast("double"))
    if not columns or len(columns) > MOST_TERMS:
        return None
    base = np.zeros((len(made), len(columns)))
    for feature, at in enumerate(made):
        base[feature, at] = 1.0
    return Terms(columns, base, gaps, blanks)


def sums(groups: Groups, t: Terms) -> DataFrame:
    """__group, __fold, gram: the products of (1, terms, label) summed over the rows, as the rows of a square matrix one after another."""
    width = len(t.columns) + 2
    every = [F.lit(1.0), *t.columns, F.col("__label")]
    if len(t.columns) <= FEW_TERMS:
        named = groups.rows.select("__group", "__fold", *[c.alias(f"t{i}") for i, c in enumerate(every)])
        upper = {(i, j): F.sum(F.col(f"t{i}") * F.col(f"t{j}")).alias(f"s{i}_{j}") for i in range(width) for j in range(i, width)}
        whole = F.array(*[F.col(f"s{min(i, j)}_{max(i, j)}") for i in range(width) for j in range(width)])
        return named.groupBy("__group", "__fold").agg(*upper.values()).select("__group", "__fold", whole.alias("gram"))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        flush = lambda: pd.DataFrame([(g, f, m.ravel()) for (g, f), m in held.items()], columns=["__group", "__fold", "gram"])
        for batch in batches:
            for key, part in batch.groupby(["__group", "__fold"], sort=False):
                x = np.stack(part["x"].to_numpy())
                held[key] = held.get(key, 0.0) + x.T @ x
                if len(held) * width * width * 8 > HELD_BYTES:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    def merge(parts: pd.DataFrame) -> pd.DataFrame:
        return parts.head(1).assign(gram=[np.sum(np.stack(parts["gram"].to_numpy()), axis=0)])

    schema = "__group string, __fold int, gram array<double>"
    parts = groups.rows.select("__group", "__fold", F.array(*every).alias("x")).mapInPandas(partial, schema)
    return parts.groupBy("__group", "__fold").applyInPandas(merge, schema)


def ridge(cov: np.ndarray, target: np.ndarray, n: float, alpha: float) -> np.ndarray:
    """Least squares plus alpha |w|^2, of centred sums of products."""
    a = cov + alpha * np.eye(len(cov))
    try:
        lower = np.linalg.cholesky(a)
        return np.linalg.solve(lower.T, np.linalg.solve(lower, target))
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(a, target, rcond=None)[0]


def elastic_net(cov: np.ndarray, target: np.ndarray, n: float, alpha: float, ratio: float, rounds: int = 5_000, tolerance: float = 1e-10) -> np.ndarray:
    """|y - Xw|^2 / 2n + alpha * ratio * |w| + alpha * (1 - ratio) / 2 * |w|^2, by coordinate descent on the sums of products."""
    w, cov, target = np.zeros(len(cov)), cov / n, target / n
    gradient, diagonal, l1, l2 = target.copy(), cov.diagonal(), alpha * ratio, alpha * (1 - ratio)
    for _ in range(rounds):
        largest = 0.0
        for j in np.flatnonzero(diagonal > 0):
            pull = gradient[j] + diagonal[j] * w[j]
            new = np.sign(pull) * max(abs(pull) - l1, 0.0) / (diagonal[j] + l2)
            if new != w[j]:
                gradient -= cov[:, j] * (new - w[j])
                largest = max(largest, abs(new - w[j]) * np.sqrt(diagonal[j]))
                w[j] = new
        if largest <= tolerance * np.sqrt(abs(target).max(initial=0.0) + 1e-300):
            break
    return w


def weights(grams: dict[int, np.ndarray], folds: int, t: Terms, fills: Sequence[Sequence[float]], modes: Sequence[Sequence[str]], models: Sequence[tuple[float, float | None]]) -> list[list[list[float]]]:
    """For each training part (without fold 0, 1, ..., then all rows) and model its intercept and weights of the terms."""
    total = sum(grams.values())
    out = []
    for i in range(folds + 1):
        g = total - grams[i] if i in grams else total
        n = g[0, 0]
        if n < 1:
            out.append([[0.0] * (len(t.columns) + 1) for _ in models])
            continue
        to = t.base.copy()
        for (_, feature, term, shift), fill in zip(t.gaps, fills[i]):
            to[feature, term] = (fill - shift) if fill is not None else -shift
        for (_, first, term, values), mode in zip(t.blanks, modes[i]):
            if mode in values:
                to[first + values.index(mode), term] = 1.0
        mean = g[0] / n
        centred = g - n * np.outer(mean, mean)
        cov, target = to @ centred[1:-1, 1:-1] @ to.T, to @ centred[1:-1, -1]
        solved = [ridge(cov, target, n, a) if r is None else elastic_net(cov, target, n, a, r) for a, r in models]
        back = [w @ to for w in solved]
        out.append([[float(mean[-1] - b @ mean[1:-1]), *map(float, b)] for b in back])
    return out


@dataclass
class Solved:
    """Models of all groups: __group, medians (of the labels of each training part) and weights (training part x model x terms)."""

    table: DataFrame
    few: bool
    terms: Terms | None
    folds: int
    models: int

    def joined(self, rows: DataFrame, how: str = "inner") -> DataFrame:
        return rows.join(F.broadcast(self.table) if self.few else self.table, "__group", how)

    def prediction(self, part: Column, model: int) -> Column:
        """Of a joined row by the model of a training part."""
        w = F.get(F.get("__weights", part), model)
        columns = self.terms.columns
        if len(columns) <= 40:
            out = F.get(w, 0)
            for j, c in enumerate(columns):
                out = out + F.get(w, j + 1) * c
            return out
        return F.aggregate(F.zip_with(w, F.array(F.lit(1.0), *columns), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)

    def median(self, part: Column) -> Column:
        return F.get("__medians", part)


def solve(groups: Groups, models: Sequence[tuple[float, float | None]]) -> Solved | None:
    """Models given as (alpha, None) for ridge and (alpha, ratio) for elastic net, of every group and training part: one aggregate for medians (and
    fills, where values are missing) and one for the sums. None if there are too many terms."""
    t = terms(groups) if models else None
    if models and t is None:
        return None
    k = groups.folds
    columns = {f"y{i}": c for i, c in enumerate(groups.train_columns(F.col("__label")))}
    for g, (name, *_) in enumerate(t.gaps if t else []):
        columns |= {f"x{g}_{i}": c for i, c in enumerate(groups.train_columns(number(groups.rows, name)))}
    quantiles = grouped_quantiles(groups.rows, ["__group"], columns, [0.5], groups.n_rows)
    whole = lambda names: F.array(*[F.get(c, 0) for c in names])
    stats = quantiles.select("__group", whole([f"y{i}" for i in range(k + 1)]).alias("__medians"), F.array(*[whole([f"x{g}_{i}" for g in range(len(t.gaps) if t else 0)]) if t and t.gaps else F.array().cast("array<double>") for i in range(k + 1)]).alias("fills"))
    if t and t.blanks:
        modes = groups.rows.groupBy("__group").agg(*[F.mode(c, True).alias(f"m{g}_{i}") for g, (name, *_) in enumerate(t.blanks) for i, c in enumerate(groups.train_columns(F.col(f"`{name}`").cast("string")))])
        stats = stats.join(modes.select("__group", F.array(*[F.array(*[f"m{g}_{i}" for g in range(len(t.blanks))]) for i in range(k + 1)]).alias("modes")), "__group")
    else:
        stats = stats.withColumn("modes", F.array(*[F.array().cast("array<string>") for _ in range(k + 1)]))
    if t is None:
        table = stats.select("__group", "__medians").cache()
    else:
        grams = sums(groups, t).groupBy("__group").agg(F.collect_list(F.struct("__fold", "gram")).alias("grams"))
        width = len(t.columns) + 2
        bare = Terms([None] * len(t.columns), t.base, t.gaps, t.blanks)  # columns stay on the driver

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = [weights({x["__fold"]: np.array(x["gram"]).reshape(width, width) for x in r.grams}, k, bare, r.fills, r.modes, models) for r in batch.itertuples()]
                yield pd.DataFrame({"__group": batch["__group"], "__medians": batch["__medians"], "__weights": found})

        table = stats.join(grams, "__group").mapInPandas(run, "__group string, __medians array<double>, __weights array<array<array<double>>>").cache()
    few = table.count() <= BROADCAST_GROUPS // max(1, (k + 1) * len(models) * (len(t.columns) if t else 1) // 100)
    return Solved(table, few, t, k, len(models))


def exact_mean(x: Column, rows: int, top: float) -> Column:
    """Aggregate: the mean of x whatever the order of the rows, for up to `rows` values of about `top`; models may score closer to each other than a running sum
    rounds off. Each value is cut at a grid so coarse that sums of its multiples are exact, and the small rests are summed by themselves."""
    whole = 4.0 * rows * top
    if not 0.0 < whole < 2.0**1000:
        return F.avg(x)
    shift = F.lit(math.ldexp(1.5, math.frexp(whole)[1] + 1))
    coarse = (x + shift) - shift
    return F.try_divide(F.sum(coarse) + F.sum(x - coarse), F.count(x))


def errors(groups: Groups, solved: Solved, by: Sequence[Column] = ()) -> DataFrame:
    """Per group, fold and `by`: n and e0, e1, ...: the mean absolute errors of the held-out rows by each model, and last by the median, the same however the rows
    are dealt. A prediction that isn't finite is the median."""
    fold = F.col("__fold")
    base = solved.median(fold)
    predictions = [solved.prediction(fold, m) for m in range(solved.models)] if solved.terms else []
    sure = [F.when(is_finite(F.col(f"p{m}")), F.col(f"p{m}")).otherwise(F.col("m")) for m in range(len(predictions))] + [F.col("m")]
    rows = solved.joined(groups.rows).select("__group", "__fold", "__label", *by, base.alias("m"), *[p.alias(f"p{m}") for m, p in enumerate(predictions)])
    names = [c for c in rows.columns if c not in ("__label", "m") and c not in {f"p{m}" for m in range(len(predictions))}]
    each = rows.select(*names, *[F.abs(F.col("__label") - p).alias(f"e{m}") for m, p in enumerate(sure)])
    return each.groupBy(*names).agg(F.count("*").alias("n"), *[exact_mean(F.col(f"e{m}"), groups.n_rows, groups.top).alias(f"e{m}") for m in range(len(sure))])
