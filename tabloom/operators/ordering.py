"""Row order, keep-first, folds, samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.scalar import row_bucket

#: The column that holds a row's place in its file.
ORD = "__ord"


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column] | None = None) -> DataFrame:
    """Of the rows that agree in the keys (nulls agree with nulls) the first in `order` (by default the file's, or where rows have no place in a file, that
    of all their other columns)."""
    rest = [F.col(f"`{c}`") for c, t in df.dtypes if c not in keys and not t.startswith(("map", "variant"))]
    w = Window.partitionBy(*keys).orderBy(*(order or ([ORD] if ORD in df.columns else rest or [F.lit(0)])))
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def keep_first_by_aggregate(df: DataFrame, keys: Sequence[str], order: str = ORD) -> DataFrame:
    """keep_first() with partial aggregation before the shuffle: for keys that repeat often. `order` must have no ties."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min(F.struct(order, *[c for c in rest if c != order])).alias("__first"))
    return first.select(*keys, *[F.col(f"__first.{c}").alias(c) for c in [order, *[c for c in rest if c != order]]]).select(*df.columns)


def best_per_group(df: DataFrame, group: str, score: str, order: Sequence[str] = ()) -> DataFrame:
    """The row of least score in each group; ties go to the first in `order`."""
    w = Window.partitionBy(group).orderBy(F.col(score).asc_nulls_last(), *order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def sample_rows(df: DataFrame, n: int, key: str = ORD, seed: int = 42) -> DataFrame:
    """n rows by a hash of the key and seed, all if there are no more; the same rows each time."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def fold_count(n: int) -> int | None:
    """3 folds from 1000 rows, 5 from 50, 3 from 20, none below."""
    return 3 if n >= 1000 else 5 if n >= 50 else 3 if n >= 20 else None


def with_folds(df: DataFrame, k: int, key: str = ORD) -> DataFrame:
    """Add `fold`, 0 .. k-1, by the key's md5."""
    return df.withColumn("fold", row_bucket(key, k))


def head(df: DataFrame, n: int) -> DataFrame:
    """The first n rows of the file."""
    return df.orderBy(ORD).limit(n) if ORD in df.columns else df.limit(n)


def union_pad(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of both, columns by name, null where a table has none."""
    return a.unionByName(b, allowMissingColumns=True)
