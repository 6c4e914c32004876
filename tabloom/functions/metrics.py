"""Mean absolute error, over all rows or averaged over blocks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.scalar import is_finite


@dataclass(frozen=True)
class MetricSpec:
    """How predictions are scored. mode: global or block_averaged."""

    name: str = "mae"
    mode: str = "global"
    block_column: str | None = None
    block_values: tuple[str, ...] | None = None
    source: str = "nothing but the global error is asked for"
    higher_is_better: bool = False

    def as_dict(self) -> dict:
        return {
            "metric_name": self.name, "metric_mode": self.mode, "block_column": self.block_column, "metric_source": self.source,
            "block_values": list(self.block_values) if self.block_values else None, "higher_is_better": self.higher_is_better,
        }

    @staticmethod
    def from_dict(d: dict) -> MetricSpec:
        values = d.get("block_values")
        return MetricSpec(d["metric_name"], d["metric_mode"], d["block_column"], tuple(values) if values else None, d["metric_source"], d["higher_is_better"])


def clean_block(value: object) -> str:
    return str(value).strip().lower()


def clean_blocks(values: Sequence[object] | None) -> list[str]:
    """Distinct non-empty block values, trimmed and lower-cased, in order."""
    return list(dict.fromkeys(v for v in map(clean_block, values or []) if v))


def block_key(c: Column | str) -> Column:
    return F.lower(F.trim((F.col(c) if isinstance(c, str) else c).cast("string")))


def errors(df: DataFrame, y: str, p: str) -> DataFrame:
    """df's rows whose label and prediction are finite, with __err, their absolute difference."""
    return df.where(is_finite(y) & is_finite(p)).withColumn("__err", F.abs(F.col(y).cast("double") - F.col(p).cast("double")))


def mae(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row: mae over finite pairs, null if there are none."""
    return errors(df, y, p).agg(F.avg("__err").alias("mae"))


def block_maes(df: DataFrame, y: str, p: str, block: str, official: Sequence[str] | None = None) -> DataFrame:
    """mae and rows of each raw block value, null among them; `official` values are matched trimmed and caseless."""
    rows = errors(df, y, p)
    wanted = clean_blocks(official)
    if wanted:
        rows = rows.where(block_key(block).isin(wanted))
    return rows.groupBy(F.col(block).alias("block")).agg(F.avg("__err").alias("mae"), F.count("*").alias("rows"))


def block_averaged_mae(df: DataFrame, y: str, p: str, block: str, official: Sequence[str] | None = None) -> DataFrame:
    """One row: the unweighted mean of the blocks' errors, null if there are none."""
    return block_maes(df, y, p, block, official).agg(F.avg("mae").alias("block_mae"))


def score(df: DataFrame, y: str, p: str, spec: MetricSpec, block: str | None = None) -> dict:
    """mae, global_mae, block_mae (or None) and score, which is the one that the spec asks for."""
    whole = mae(df, y, p).first()[0]
    block = block or spec.block_column
    by_block = None
    if spec.mode == "block_averaged" and block and block in df.columns:
        by_block = block_averaged_mae(df, y, p, block, spec.block_values).first()[0]
    best = whole if by_block is None else by_block
    return {"score": best, "mae": best, "global_mae": whole, "block_mae": by_block, **{"metric_mode": asdict(spec)["mode"]}}
