"""Summaries of tables: missingness, targets, numeric and categorical columns, shift, time, histograms.

Each is one or two aggregations over all columns together, so a table is scanned once however wide it is.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.scalar import is_finite, month_period, not_nan, to_timestamp
from tabloom.operators import quantiles
from tabloom.operators.ordering import ORD, head

TOP_MISSING, TOP_CORRELATIONS, TOP_CATEGORIES, TOP_BLOCKS, MAX_CATEGORICAL_FIGURES = 20, 15, 15, 20, 3
_FRACTIONAL = (T.FloatType, T.DoubleType)
TIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def columns_of(df: DataFrame) -> list[T.StructField]:
    return [f for f in df.schema.fields if f.name != ORD]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in columns_of(df) if isinstance(f.dataType, (T.NumericType, T.BooleanType))]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in columns_of(df) if isinstance(f.dataType, T.StringType)]


def value(df: DataFrame, name: str) -> Column:
    """A column with NaN as null, and booleans as they are."""
    c = F.col(f"`{name}`")
    return not_nan(c) if isinstance(df.schema[name].dataType, _FRACTIONAL) else c


def number(df: DataFrame, name: str) -> Column:
    return value(df, name).cast("double")


def _stack(df: DataFrame, names: Sequence[str], build) -> DataFrame:
    """One aggregate over df, then a row per name: build(name) gives its aggregates by output name."""
    if not names:
        raise ValueError("no columns")
    parts = {n: build(n) for n in names}
    fields = list(next(iter(parts.values())))
    one = df.agg(*[e.alias(f"{i}_{k}") for i, n in enumerate(names) for k, e in parts[n].items()])
    rows = F.array(*[F.struct(F.lit(n).alias("column"), *[F.col(f"{i}_{k}").alias(k) for k in fields]) for i, n in enumerate(names)])
    return one.select(F.inline(rows))


def _count_null(c: Column) -> Column:
    return F.count(F.when(c.isNull(), 1))


#: The sketches have 2^14 registers, so one standard deviation of their error is under 1 %; the margin that is allowed for; and up to how many values are simply collected.
SKETCH_BITS, SKETCH_MARGIN, FEW_VALUES = 14, 0.05, 1_000


def sketched_counts(df: DataFrame, columns: Mapping[str, Column]) -> tuple[int, dict[str, int]]:
    """Rows, and about how many distinct values each column has (nulls left out): one pass of mergeable sketches, whatever the number of columns."""
    hashes = [F.when(c.isNotNull(), F.xxhash64(c)) for c in columns.values()]
    got = df.agg(F.count(F.lit(1)), *[F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(h, F.lit(SKETCH_BITS))), F.lit(0)) for h in hashes]).first()
    return got[0], dict(zip(columns, got[1:]))


def decided_counts(df: DataFrame, columns: Mapping[str, Column], shares: Sequence[float] = ()) -> tuple[int, dict[str, int]]:
    """Rows, and distinct values by column (nulls left out): exact where few or where their share of the rows is near one of `shares`, at which something is decided;
    elsewhere to the sketch's error. Few values are collected in one aggregate; only columns near a share are counted by a shuffle, each alone."""
    n, found = sketched_counts(df, columns)
    few = [c for c, u in found.items() if u <= FEW_VALUES]
    if few:
        found |= dict(zip(few, df.agg(*[F.size(F.collect_set(columns[c])) for c in few]).first()))
    for c, u in found.items():
        if u > FEW_VALUES and any(abs(u - share * n) <= SKETCH_MARGIN * share * n for share in shares):
            found[c] = df.agg(F.count_distinct(columns[c])).first()[0]
    return n, found


def missingness(df: DataFrame, approximate: bool = False) -> DataFrame:
    """column, dtype, missing_count, missing_pct (share, 4 digits), nunique; most missing first. approximate: distinct
    values by a sketch, which spares wide large tables a shuffle of every value."""
    kinds = dict(df.dtypes)
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    n = F.count(F.lit(1))
    out = _stack(df, [f.name for f in columns_of(df)], lambda c: {
        "missing_count": _count_null(value(df, c)), "rows": n, "nunique": distinct(value(df, c)),
    })
    dtype = F.create_map(*[F.lit(x) for k in kinds.items() for x in k])[F.col("column")]
    pct = F.round(F.coalesce(F.try_divide(F.col("missing_count"), F.col("rows")), F.lit(0.0)), 4)
    out = out.select("column", dtype.alias("dtype"), "missing_count", pct.alias("missing_pct"), "nunique")
    return out.orderBy(F.desc("missing_pct"), F.desc("missing_count"), "column")


def overview(df: DataFrame, role: str, path: str) -> DataFrame:
    """role, relative_path, rows, columns, duplicate_rows, missing_cells, missing_pct, memory_mb. Duplicates are all but the first
    of equal rows. memory_mb: 8 bytes a value, and for texts their UTF-8 besides."""
    names = [f.name for f in columns_of(df)]
    equal = df.groupBy(*[value(df, c).alias(f"c{i}") for i, c in enumerate(names)]).agg(F.count("*").alias("n"))
    blanks = reduce(lambda a, b: a + b, [F.col(f"c{i}").isNull().cast("long") for i in range(len(names))], F.lit(0))
    texts = [i for i, f in enumerate(columns_of(df)) if isinstance(f.dataType, T.StringType)]
    size = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(f"c{i}"), F.lit(0)).cast("long") for i in texts], F.lit(8 * len(names)).cast("long"))
    got = equal.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("dup"), F.coalesce(F.sum(F.col("n") * blanks), F.lit(0)).alias("cells"),
                    F.coalesce(F.sum(F.col("n") * size), F.lit(0)).alias("bytes"))
    return got.select(
        F.lit(role).alias("role"), F.lit(path).alias("relative_path"), "rows", F.lit(len(names)).cast("long").alias("columns"), F.col("dup").alias("duplicate_rows"),
        F.col("cells").alias("missing_cells"), F.round(F.coalesce(F.try_divide(F.col("cells"), F.col("rows") * len(names)), F.lit(0.0)), 4).alias("missing_pct"),
        F.round(F.col("bytes") / (1 << 20), 4).alias("memory_mb"),
    )


QUARTILES = (0.25, 0.5, 0.75)


def _quartiles(df: DataFrame, names: Sequence[str]) -> dict[str, list[float | None]] | None:
    """Quartiles of large tables' columns, found beforehand; None for tables that one aggregate can hold."""
    rows = df.count()
    if rows <= quantiles.ONE_PASS_ROWS:
        return None
    return quantiles.exact_quantiles(df, {c: number(df, c) for c in names}, QUARTILES, rows)


def _moments(x: Column, known: Sequence[float | None] | None = None) -> dict[str, Column]:
    """count, mean, std (ddof 1), min, quartiles (interpolated; `known` ones as they are), max, skewness (biased; null under 3 values)."""
    q = F.percentile(x, F.array(*map(F.lit, QUARTILES))) if known is None else [F.first(F.lit(v).cast("double")) for v in known]
    return {
        "count": F.count(x), "mean": F.avg(x), "std": F.stddev_samp(x), "min": F.min(x), "q25": q[0], "median": q[1], "q75": q[2], "max": F.max(x),
        "skew": not_nan(F.when(F.count(x) >= 3, F.skewness(x))),
    }


def target_summary(df: DataFrame, target: str) -> DataFrame:
    x = number(df, target)
    found = _quartiles(df, [target])
    moments = _moments(x, found[target] if found else None)
    return df.agg(
        F.lit(target).alias("target_column"), *[e.alias(k) for k, e in moments.items()],
        F.count(F.when(x == 0, 1)).alias("zero_count"), F.count(F.when(x < 0, 1)).alias("negative_count"), _count_null(x).alias("missing_count"),
    ).select("target_column", *moments, "zero_count", "negative_count", "missing_count")


def target_by_block(df: DataFrame, target: str, block: str) -> DataFrame:
    """Target statistics of each block, null among them; most rows first."""
    x = number(df, target)
    named = df.withColumn("block", F.col(block))
    out = named.groupBy("block").agg(F.count(F.lit(1)).alias("rows"), F.avg(x).alias("mean_target"), F.stddev_samp(x).alias("std_target"), F.min(x).alias("min_target"), F.max(x).alias("max_target"), _count_null(x).alias("missing_target_count"))
    medians = quantiles.grouped_quantiles(named, ["block"], {"m": x}, [0.5]).select(F.col("block").alias("__b"), F.get("m", 0).alias("median_target"))
    return out.join(medians, F.col("block").eqNullSafe(F.col("__b"))).select("block", "rows", "mean_target", "std_target", "median_target", "min_target", "max_target", "missing_target_count").orderBy(F.desc("rows"), F.col("block").asc_nulls_last())


def numeric_summary(df: DataFrame, target: str | None, names: Sequence[str] | None = None) -> DataFrame:
    """Statistics of each numeric column and |Pearson r| with the target over rows where both are finite (three at
    least of each); highest first, unknown last."""
    names = [c for c in (names or numeric_columns(df)) if c != target]
    found = _quartiles(df, names)

    def build(c: str) -> dict[str, Column]:
        x = number(df, c)
        out = _moments(x, found[c] if found else None)
        out = {"count": out.pop("count"), "missing_pct": F.coalesce(F.try_divide(_count_null(x), F.count(F.lit(1))), F.lit(0.0)), **out}
        if target is None:
            return out | {"abs_corr_with_target": F.lit(None).cast("double")}
        y = number(df, target)
        both = is_finite(x) & is_finite(y)
        x, y = F.when(both, x), F.when(both, y)
        r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))  # corr() fails where a deviation is 0
        out["abs_corr_with_target"] = F.abs(F.when(F.count(x) > 2, r))
        return out

    return _stack(df, names, build).orderBy(F.col("abs_corr_with_target").desc_nulls_last(), "column")


def top_correlations(summary: DataFrame) -> DataFrame:
    return summary.where("abs_corr_with_target is not null").orderBy(F.desc("abs_corr_with_target"), "column").limit(TOP_CORRELATIONS)


def _values(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Long form (col, val, first) of text columns, counted: one row per column and value, nulls included."""
    order = F.col(ORD) if ORD in df.columns else F.lit(0)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").cast("string").alias("val")) for c in names]))
    return df.select(each.alias("x"), order.alias("o")).groupBy("x.col", "x.val").agg(F.count("*").alias("n"), F.min("o").alias("first"))


def categorical_summary(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """column, nunique, missing_pct, top_value with its count and share of all rows, high_cardinality (over 50 values,
    or over half the rows). Of equally frequent values the first to appear wins, then the smallest."""
    counts = _values(df, names or categorical_columns(df))
    known = F.col("val").isNotNull()
    best = F.min_by(F.struct("val", "n"), F.when(known, F.struct((-F.col("n")).alias("n"), F.col("first"), F.col("val"))))
    out = counts.groupBy("col").agg(F.count(F.when(known, 1)).alias("nunique"), F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("gone"), best.alias("b"))
    return out.select(
        F.col("col").alias("column"), "nunique", (F.col("gone") / F.col("rows")).alias("missing_pct"), F.col("b.val").alias("top_value"), F.coalesce("b.n", F.lit(0)).alias("top_value_freq"),
        (F.coalesce("b.n", F.lit(0)) / F.col("rows")).alias("top_value_pct"), ((F.col("nunique") > 50) | (F.col("nunique") > 0.5 * F.col("rows"))).alias("high_cardinality"),
    ).orderBy("column")


def top_values(df: DataFrame, name: str, k: int = TOP_CATEGORIES) -> DataFrame:
    counts = _values(df, [name]).where("val is not null")
    return counts.orderBy(F.desc("n"), "first", "val").limit(k).select(F.col("val").alias("value"), F.col("n").alias("count"))


def shift_numeric(train: DataFrame, other: DataFrame, names: Sequence[str]) -> DataFrame:
    """Means of both sides, their difference over the population deviation of both together (0 if that is 0 and the
    means agree, else null), shares missing and their difference; largest difference first."""
    side = lambda df, k: df.select(F.lit(k).alias("__side"), *[number(df, c).alias(c) for c in names])
    both = side(train, 0).unionAll(side(other, 1))

    def build(c: str) -> dict[str, Column]:
        x, a, b = F.col(f"`{c}`"), F.col("__side") == 0, F.col("__side") == 1
        m = lambda s: F.avg(F.when(s, x))
        gone = lambda s: F.avg(F.when(s, x.isNull().cast("double")))
        std = F.stddev_pop(x)
        smd = F.when(std > 0, (m(b) - m(a)) / std).when(m(a) == m(b), F.lit(0.0))
        return {"train_mean": m(a), "validation_mean": m(b), "standardized_mean_diff": smd, "train_missing_pct": gone(a), "validation_missing_pct": gone(b), "missing_pct_diff": gone(b) - gone(a)}

    return _stack(both, names, build).orderBy(F.abs("standardized_mean_diff").desc_nulls_last(), "column")


def shift_categorical(train: DataFrame, other: DataFrame, names: Sequence[str]) -> DataFrame:
    """Distinct values of both sides, values of the second unseen in the first (how many, and their share of the second
    side's present rows), shares missing."""
    a = _values(train, names).select("col", "val", F.col("n").alias("a"), F.lit(0).alias("b"))
    b = _values(other, names).select("col", "val", F.lit(0).alias("a"), F.col("n").alias("b"))
    per_value = a.unionAll(b).groupBy("col", "val").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    known = F.col("val").isNotNull()
    has = lambda s: F.count(F.when(known & (F.col(s) > 0), 1))
    total = lambda s, when=None: F.coalesce(F.sum(F.when(when, F.col(s)) if when is not None else F.col(s)), F.lit(0))
    unseen = known & (F.col("a") == 0) & (F.col("b") > 0)
    return (
        per_value.groupBy(F.col("col").alias("column"))
        .agg(has("a").alias("train_nunique"), has("b").alias("validation_nunique"), F.count(F.when(unseen, 1)).alias("unseen_validation_categories_count"),
             F.coalesce(F.try_divide(total("b", unseen), total("b", known)), F.lit(0.0)).alias("unseen_validation_categories_pct"),
             F.try_divide(total("a", ~known), total("a")).alias("train_missing_pct"), F.try_divide(total("b", ~known), total("b")).alias("validation_missing_pct"))
        .orderBy(F.desc("unseen_validation_categories_pct"), "column")
    )


def time_counts(df: DataFrame, column: str, target: str | None = None) -> DataFrame:
    """source_column, period (yyyy-MM, NaT for none), rows and, with a target, its mean; by period."""
    period = month_period(to_timestamp(column, dict(df.dtypes)[column]))
    mean = [F.avg(number(df, target)).alias("mean_target")] if target else []
    return df.groupBy(period.alias("period")).agg(F.count("*").alias("rows"), *mean).select(F.lit(column).alias("source_column"), "period", "rows", *(["mean_target"] if target else [])).orderBy("period")


# Words in names of columns that hold times.
TIME_WORDS = ("date", "time", "timestamp", "period", "month", "year", "quarter", "week", "day")


def time_candidates(df: DataFrame, most: int = 3, sample: int = 200) -> list[str]:
    """Columns that hold times by their name or type, then text columns of whose first values at least 70 % are times."""
    fields = columns_of(df)
    named = [f.name for f in fields if any(w in f.name.lower() for w in TIME_WORDS) or isinstance(f.dataType, TIME_TYPES)]
    texts = [f.name for f in fields if isinstance(f.dataType, T.StringType) and f.name not in named] if len(named) < most else []
    if texts:
        shares = head(df, sample).agg(*[F.avg(F.when(F.col(f"`{c}`").isNotNull(), to_timestamp(F.col(f"`{c}`")).isNotNull().cast("double"))).alias(f"c{i}") for i, c in enumerate(texts)]).first()
        named += [c for c, s in zip(texts, shares) if s is not None and s >= 0.7]
    return named[:most]


def time_patterns(df: DataFrame, target: str | None) -> tuple[str, DataFrame] | None:
    """The counts by month of the first candidate column of which 30 % parse into at most 60 periods and, with a
    target, more than one period has a mean."""
    for c in time_candidates(df):
        counts = time_counts(df, c, target)
        rows = counts.limit(62).collect()
        n = sum(r["rows"] for r in rows)
        parsed = sum(r["rows"] for r in rows if r["period"] != "NaT")
        if not n or len(rows) > 60 or parsed < 0.3 * n:
            continue
        if target is None or sum(r["mean_target"] is not None for r in rows) > 1:
            return c, counts
    return None


def histogram(df: DataFrame, column: str, transform: str | None = None) -> DataFrame:
    """bin (from 1), low, high, count of finite values, in min(40, max(10, floor(sqrt(n)))) bins of equal width, the
    last closed. transform log1p: of log(1 + x), rows with x > -1 only. Bins without rows are left out."""
    x = number(df, column)
    x = F.when(is_finite(x), x)
    if transform == "log1p":
        x = F.when(x > -1, F.log1p(x))
    values = df.select(x.alias("x")).where("x is not null")
    r = values.agg(F.count("x"), F.min("x"), F.max("x")).first()
    if not r[0]:
        return values.select(F.lit(1).alias("bin"), F.col("x").alias("low"), F.col("x").alias("high"), F.lit(0).cast("long").alias("count")).limit(0)
    bins, low, high = min(40, max(10, math.isqrt(r[0]))), r[1], r[2]
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    k = F.least(F.floor((F.col("x") - low) / F.lit(width)).cast("int") + 1, F.lit(bins)).alias("bin")
    out = values.groupBy(k).agg(F.count("*").alias("count"))
    return out.select("bin", (F.lit(low) + (F.col("bin") - 1) * width).alias("low"), (F.lit(low) + F.col("bin") * width).alias("high"), "count").orderBy("bin")


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Fractional columns to so many digits, others as they are."""
    return df.select(*[F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, _FRACTIONAL) else F.col(f"`{f.name}`") for f in df.schema.fields])


def drop_all_missing(df: DataFrame) -> DataFrame:
    """Without the columns that hold no value in any row."""
    names = df.columns
    seen = df.agg(*[F.max(value(df, c).isNotNull()).alias(f"c{i}") for i, c in enumerate(names)]).first()
    return df.select(*[F.col(f"`{c}`") for c, s in zip(names, seen) if s])
