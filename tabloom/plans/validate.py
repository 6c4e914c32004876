"""Checks of a submission against the sample."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.scalar import to_number
from tabloom.operators.ordering import ORD
from tabloom.operators.profile import columns_of


@dataclass
class Report:
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    facts: dict = field(default_factory=dict)

    @property
    def ok(self) -> bool:
        return not self.errors

    def as_dict(self) -> dict:
        return {"status": "passed" if self.ok else "failed", "errors": self.errors, "warnings": self.warnings, **self.facts}

    def markdown(self) -> str:
        out = ["# Submission validation", "", f"Status: **{'passed' if self.ok else 'failed'}**"]
        for title, items in (("Errors", self.errors), ("Warnings", self.warnings)):
            out += ["", f"## {title}", "", *([f"- {x}" for x in items] or ["- none"])]
        out += ["", "## Facts", "", *[f"- {k}: {v}" for k, v in self.facts.items()]]
        return "\n".join(out) + "\n"


def id_facts(df: DataFrame, row_id: str) -> DataFrame:
    """rows, null_ids, duplicate_ids (repeats after the first; nulls equal nulls)."""
    c = F.col(f"`{row_id}`")
    distinct = F.count_distinct(c) + F.max(c.isNull().cast("int"))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(c.isNull(), 1)).alias("null_ids"), F.coalesce(F.count(F.lit(1)) - distinct, F.lit(0)).alias("duplicate_ids"))


def prediction_facts(df: DataFrame, target: str) -> DataFrame:
    """not_numeric (no number, or NaN) and infinite predictions."""
    raw = F.col(f"`{target}`")
    x = to_number(raw)
    return df.agg(F.count(F.when(x.isNull(), 1)).alias("not_numeric"), F.count(F.when(F.abs(x) == float("inf"), 1)).alias("infinite"))


def id_difference(a: DataFrame, b: DataFrame, row_id: str) -> DataFrame:
    """Distinct ids of a that b lacks; null equals null."""
    ids = lambda df: df.select(F.col(f"`{row_id}`").cast("string").alias(row_id))
    return ids(a).distinct().join(ids(b).withColumnRenamed(row_id, "__id"), F.col(row_id).eqNullSafe(F.col("__id")), "left_anti")


#: Rows that are ranked together, about.
RANKED_ROWS = 1_000_000


def places(df: DataFrame) -> DataFrame:
    """df with `place`, 1, 2, ... in the order of __ord, which must be numbers: ranked within ranges of __ord of about RANKED_ROWS
    rows, each of which starts where the counts of those before it end."""
    many = -(-df.count() // RANKED_ROWS)
    bounds = sorted(set(df.approxQuantile(ORD, [k / many for k in range(1, many)], 0.1 / many))) if many > 1 else []
    block = F.size(F.filter(F.array(*[F.lit(int(x)) for x in bounds]), lambda x: x < F.col(ORD))) if bounds else F.lit(0)
    cut = df.withColumn("__block", block)
    sizes = cut.groupBy("__block").agg(F.count("*").alias("__n"))  # a row for each range
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__block", before.alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__block").orderBy(ORD))
    return cut.join(F.broadcast(starts), "__block").withColumn("place", F.col("__before") + rank).select(*df.columns, "place")


def order_mismatches(a: DataFrame, b: DataFrame, row_id: str) -> DataFrame:
    """mismatches: places at which the ids of both tables, in their row order, differ. Both need __ord."""
    placed = lambda df, name: places(df.select(F.col(f"`{row_id}`").cast("string").alias(name), ORD)).select("place", name)
    both = placed(a, "__x").join(placed(b, "__y"), "place")
    return both.agg(F.count(F.when(~F.col("__x").eqNullSafe(F.col("__y")), 1)).alias("mismatches"))


def validate(submission: DataFrame | None, sample: DataFrame | None, wanted: list[str], row_id: str, target: str) -> Report:
    """All checks that the tables allow: columns, ids, predictions, id sets, order, row counts."""
    out = Report()
    if submission is None:
        out.errors.append("the submission can't be read")
        return out
    names = [f.name for f in columns_of(submission)]
    missing, extra = [c for c in wanted if c not in names], [c for c in names if c not in wanted]
    if missing:
        out.errors.append(f"missing columns: {missing}")
    if extra:
        out.errors.append(f"extra columns: {extra}")
    if not missing and not extra and names != wanted:
        out.errors.append(f"column order is {names}, expected {wanted}")
    out.facts["columns"] = names
    if row_id in names:
        rows, nulls, repeats = id_facts(submission, row_id).first()
        out.facts |= {"rows": rows, "duplicate_ids": repeats}
        if nulls:
            out.errors.append(f"{nulls} null ids")
        if repeats:
            out.errors.append(f"{repeats} duplicate ids")
    if target in names:
        bad, infinite = prediction_facts(submission, target).first()
        if bad:
            out.errors.append(f"{bad} missing or non-numeric predictions")
        if infinite:
            out.errors.append(f"{infinite} infinite predictions")
    if sample is None:
        out.warnings.append("no sample to compare with")
        return out
    if row_id in names and row_id in sample.columns:
        a, b = submission.count(), sample.count()
        out.facts["expected_rows"] = b
        if a != b:
            out.errors.append(f"row count {a}, expected {b}")
        gone, more = id_difference(sample, submission, row_id).count(), id_difference(submission, sample, row_id).count()
        if gone:
            out.errors.append(f"{gone} ids of the sample are missing")
        if more:
            out.errors.append(f"{more} ids are not in the sample")
        if a == b and not gone and not more and (n := order_mismatches(submission, sample, row_id).first()[0]):
            out.errors.append(f"row order mismatch at {n} places")
    further = [f.name for f in columns_of(sample) if f.name not in wanted]
    if further:
        out.warnings.append(f"the sample has further columns: {further}")
    return out
