"""Counts and errors over event streams, in event-time windows with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.metrics import block_key
from tabloom.functions.scalar import is_finite


def windowed_counts(events: DataFrame, time: str = "ts", every: str = "1 day", late: str = "2 days", value: str | None = None) -> DataFrame:
    """start, end, rows and, with a value column, its mean, for each window; works on streams and on tables alike. On a
    stream a window's state goes once the watermark (`late` behind the newest event) has passed its end."""
    mean = [F.avg(F.when(is_finite(value), F.col(value))).alias("mean_value")] if value else []
    stamped = events.withColumn("__time", F.col(time).cast("timestamp")).withWatermark("__time", late)
    got = stamped.groupBy(F.window("__time", every).alias("w")).agg(F.count("*").alias("rows"), *mean)
    return got.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rows", *(["mean_value"] if value else []))


def windowed_block_errors(events: DataFrame, y: str, p: str, block: str, time: str = "ts", every: str = "1 day", late: str = "2 days") -> DataFrame:
    """start, block, mae, rows: the mean absolute error of each block in each window, over finite pairs. Averaging it over
    a window's blocks gives the block-averaged error."""
    stamped = events.withColumn("__time", F.col(time).cast("timestamp")).withWatermark("__time", late)
    good = stamped.where(is_finite(y) & is_finite(p))
    error = F.abs(F.col(y).cast("double") - F.col(p).cast("double"))
    got = good.groupBy(F.window("__time", every).alias("w"), block_key(block).alias("block")).agg(F.avg(error).alias("mae"), F.count("*").alias("rows"))
    return got.select(F.col("w.start").alias("start"), "block", "mae", "rows")
