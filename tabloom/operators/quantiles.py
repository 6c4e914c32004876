"""Exact interpolated quantiles of many columns, for tables of any size."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tables of more rows get their quantiles by narrowing; percentile() holds each distinct value in memory.
ONE_PASS_ROWS = 20_000_000
#: Accuracy of the first sketch: a bracket holds about this share of the rows.
SKETCH = 10_000


def exact_quantiles(df: DataFrame, columns: Mapping[str, Column], probs: Sequence[float], rows: int | None = None, one_pass_rows: int | None = None) -> dict[str, list[float | None]]:
    """For each column its quantiles (linear interpolation between neighbouring values, nulls left out; None without
    values). All columns share the passes over df: one for tables of up to one_pass_rows rows; for larger ones a sketch brackets
    each quantile, a second pass counts the values below and inside the bracket, and a third takes the exact
    quantile of the few inside."""
    names = list(columns)
    if not names:
        return {}
    limit = ONE_PASS_ROWS if one_pass_rows is None else one_pass_rows
    n = df.count() if rows is None else rows
    values = df.select(*[c.cast("double").alias(f"v{i}") for i, c in enumerate(columns.values())])
    if n <= limit:
        got = values.agg(*[F.percentile(f"v{i}", F.array(*map(F.lit, map(float, probs)))).alias(f"q{i}") for i in range(len(names))]).first()
        return {c: list(got[i]) if got[i] is not None else [None] * len(probs) for i, c in enumerate(names)}

    edge = 2 / SKETCH
    around = [p for q in probs for p in (max(0.0, q - edge), min(1.0, q + edge))]
    sketch = values.agg(*[x for i in range(len(names)) for x in (F.count(f"v{i}"), F.min(f"v{i}"), F.max(f"v{i}"), F.percentile_approx(f"v{i}", list(map(float, around)), SKETCH))]).first()
    brackets: dict[tuple[int, int], tuple[float, float]] = {}
    for i in range(len(names)):
        count, low, high, at = sketch[4 * i : 4 * i + 4]
        for j, q in enumerate(probs):
            if count:
                brackets[i, j] = (low if around[2 * j] == 0 else at[2 * j], high if around[2 * j + 1] == 1 else at[2 * j + 1])
    if not brackets:
        return {c: [None] * len(probs) for c in names}

    below = values.agg(*[F.count(F.when(F.col(f"v{i}") < lo, 1)) for (i, _), (lo, _) in brackets.items()]).first()
    inside = values.agg(*[F.count(F.when(F.col(f"v{i}").between(lo, hi), 1)) for (i, _), (lo, hi) in brackets.items()]).first()
    wanted: dict[tuple[int, int], float] = {}
    for k, (i, j) in enumerate(brackets):
        place = probs[j] * (sketch[4 * i] - 1) - below[k]
        if place < 0 or math.ceil(place) > inside[k] - 1:  # the sketch missed: take the column whole
            brackets[i, j] = (sketch[4 * i + 1], sketch[4 * i + 2])
            wanted[i, j] = probs[j]
        else:
            wanted[i, j] = place / (inside[k] - 1) if inside[k] > 1 else 0.0
    final = values.agg(*[F.percentile(F.when(F.col(f"v{i}").between(*brackets[i, j]), F.col(f"v{i}")), F.lit(float(f))) for (i, j), f in wanted.items()]).first()
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in names}
    for k, (i, j) in enumerate(wanted):
        out[names[i]][j] = final[k]
    return out


#: So many groups' brackets are broadcast at most (some tens of bytes each); those of more groups are joined by a shuffle.
BROADCAST_GROUPS = 100_000


def grouped_quantiles(df: DataFrame, by: Sequence[str], columns: Mapping[str, Column], probs: Sequence[float], rows: int | None = None, one_pass_rows: int | None = None) -> DataFrame:
    """One row per group (null is a group): `by` and for each column an array of its exact interpolated quantiles, null where the group has no value.

    As exact_quantiles(), for all groups at once: tables of up to one_pass_rows rows take one aggregate; in larger ones a
    mergeable sketch per group brackets each quantile, one pass counts the values below the bracket, and the few inside are sorted. So
    no task holds the distinct values of a group, however large."""
    names = list(columns)
    values = df.select(*by, *[c.cast("double").alias(f"v{i}") for i, c in enumerate(columns.values())])
    plain = [F.percentile(f"v{i}", F.array(*map(F.lit, map(float, probs)))).alias(c) for i, c in enumerate(names)]
    n = df.count() if rows is None else rows
    if n <= (ONE_PASS_ROWS if one_pass_rows is None else one_pass_rows):
        return values.groupBy(*by).agg(*plain)
    edge = 2 / SKETCH
    around = [p for q in probs for p in (max(0.0, q - edge), min(1.0, q + edge))]
    sketched = values.groupBy(*by).agg(*[x for i in range(len(names)) for x in (F.count(f"v{i}").alias(f"n{i}"), F.min(f"v{i}").alias(f"low{i}"), F.max(f"v{i}").alias(f"high{i}"), F.percentile_approx(f"v{i}", list(map(float, around)), SKETCH).alias(f"at{i}"))])
    end = lambda i, k, edge_column: F.col(f"{edge_column}{i}") if around[k] in (0.0, 1.0) else F.get(F.col(f"at{i}"), k)
    each = [(i, j) for i in range(len(names)) for j in range(len(probs))]
    groups = [F.col(c).alias(f"__g{k}") for k, c in enumerate(by)]
    brackets = sketched.select(*groups, *[f"n{i}" for i in range(len(names))], *[e for i, j in each for e in (end(i, 2 * j, "low").alias(f"from{i}_{j}"), end(i, 2 * j + 1, "high").alias(f"to{i}_{j}"))]).cache()
    few = brackets.count() <= BROADCAST_GROUPS
    same = [F.col(c).eqNullSafe(F.col(f"__g{k}")) for k, c in enumerate(by)]
    met = values.join(F.broadcast(brackets) if few else brackets, reduce(Column.__and__, same))
    found = met.groupBy(*by, *[f"n{i}" for i in range(len(names))]).agg(*[x for i, j in each for x in (
        F.count(F.when(F.col(f"v{i}") < F.col(f"from{i}_{j}"), 1)).alias(f"below{i}_{j}"),
        F.sort_array(F.collect_list(F.when(F.col(f"v{i}").between(F.col(f"from{i}_{j}"), F.col(f"to{i}_{j}")), F.col(f"v{i}")))).alias(f"inside{i}_{j}"))])

    def picked(i: int, j: int) -> Column:
        place = F.lit(float(probs[j])) * (F.col(f"n{i}") - 1) - F.col(f"below{i}_{j}")
        low, inside = F.floor(place).cast("int"), F.col(f"inside{i}_{j}")
        a, b = F.get(inside, low), F.get(inside, F.ceil(place).cast("int"))
        return F.when(place >= 0, a + (place - low) * (b - a))

    out = found.select(*by, *[f"n{i}" for i in range(len(names))], *[F.array(*[picked(i, j) for j in range(len(probs))]).alias(c) for i, c in enumerate(names)])
    missed = reduce(Column.__or__, [(F.col(f"n{i}") > 0) & F.exists(c, F.isnull) for i, c in enumerate(names)])
    good = out.where(~missed).select(*by, *[F.when(F.col(f"n{i}") > 0, F.col(c)).alias(c) for i, c in enumerate(names)])
    lost = out.where(missed).select(*groups)  # a sketch beyond its promise: such groups are taken whole
    return good.unionByName(values.join(lost, reduce(Column.__and__, same), "left_semi").groupBy(*by).agg(*plain))
