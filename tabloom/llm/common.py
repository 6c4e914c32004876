"""Helpers that several operators share: tables, materialised steps, gapless ranks, groups of rows."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or a local one where it is unset and the
    master is local (tests). Elsewhere each executor would write to its own disk, so that raises an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tabloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_written: list[tuple] = []


@atexit.register
def _remove_written() -> None:
    for jvm, conf, path in _written:
        try:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
        except (Py4JError, OSError):  # the JVM has gone before us
            return


def materialize(df: DataFrame, group_bytes: int | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back; group_bytes: size of its row groups.

    This cuts the lineage like checkpoint() and survives lost executors, but stays columnar and compressed, so that
    later steps read only the columns they use. The files go when the Python process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tabloom-{uuid.uuid4().hex}"
    (df.write.option("parquet.block.size", group_bytes) if group_bytes else df.write).parquet(path)
    _written.append((spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path))  # usable after the session's end too
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialize() wrote for df, once nothing reads it any more: all that was made from it is written itself."""
    spark = df.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._written_to)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key is hot if more than one in HOT_SHARE of the rows, and HOT_ROWS rows, have it; so there are under HOT_SHARE hot keys.
HOT_SHARE, HOT_ROWS = 2_000, 500


def hot_join(large: DataFrame, small: DataFrame, on: list[str], rows: str) -> DataFrame:
    """large joined with small on the columns `on`. small has one row per key; its column `rows`, which isn't returned, says how
    many rows of large have the key. Rows of hot keys stay where they are and meet a broadcast of those few keys; the
    others are shuffled. Both tables are read twice and should be materialized."""
    whole = small.agg(F.coalesce(F.sum(rows), F.lit(0))).first()[0]
    hot = small.where(F.col(rows) > max(HOT_ROWS, whole // HOT_SHARE)).drop(rows)
    cold = small.where(F.col(rows) <= max(HOT_ROWS, whole // HOT_SHARE)).drop(rows)
    rest = large.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on)
    return large.join(F.broadcast(hot), on).unionByName(rest)


def text_slices(texts, at_once: int = 1 << 20):
    """(place of the first, list of UTF-8 bytes) of an Arrow column of texts, null as empty, about `at_once` bytes at a time, so that
    a batch of long texts isn't held in several copies."""
    start, n = 0, len(texts)
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    while start < n:
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + at_once, "right")))
        yield start, [t or b"" for t in texts[start:stop].cast(pa.binary()).to_pylist()]
        start = stop


def text_or_empty(c: str | Column = "text") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def gapless_rank(df: DataFrame, groups: list[str], order: list[str], out: str, buckets: int | Column | None = None) -> DataFrame:
    """Add `out`: 0, 1, 2, ... within each group, without bringing a whole group into one task.

    Rows of a group are dealt over `buckets` by a hash of `order`; each bucket is ranked alone and starts where the
    counts of the buckets before it end. The counts (groups x buckets rows at most; groups must be few and fixed, buckets
    are 4,096 at most) are broadcast. Ties in `order` share a bucket and get neighbouring ranks.
    """
    b = buckets if buckets is not None else min(4096, 4 * shuffle_partitions(df.sparkSession))
    dealt = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), b if isinstance(b, Column) else F.lit(b)).cast("int"))
    counts = dealt.groupBy(*groups, "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*groups).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)],
        F.col("__bucket").alias("__b"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"),
    )
    ranked = dealt.withColumn("__rank", F.row_number().over(Window.partitionBy(*groups, "__bucket").orderBy(*order)))
    same = (F.col("__bucket") == F.col("__b")) & _all(F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(groups))
    joined = ranked.join(F.broadcast(starts), same, "left")
    return joined.select(*df.columns, (F.col("__start") + F.col("__rank") - 1).alias(out))


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
