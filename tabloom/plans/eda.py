"""The exploratory analysis: every summary of operators.profile over a task's tables, as CSV and SVG files."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tabloom.operators import joins, profile
from tabloom.operators import types as kinds
from tabloom.operators.ordering import sample_rows
from tabloom.plans import figures, schema
from tabloom.sources import files



def raw_overview(spark: SparkSession, summary: dict) -> DataFrame:
    """relative_path, role, rows, columns of each file, from its profile: no table is read."""
    rows = [(f["rel_path"], f["role"], f["n_rows"], f["n_cols"]) for f in summary.get("files", [])]
    return spark.createDataFrame(rows, "relative_path string, role string, rows long, columns long")


def modeling_overview(spark: SparkSession, log: dict) -> DataFrame:
    """What the models were given: how many features each group has, after encoding, and rows to predict."""
    groups = log.get("feature_groups", {})
    rows = [(k, len(v)) for k, v in groups.items()] + [("distinct_features", len({c for k, v in groups.items() if k not in ("dropped", "text", "datetime", "medium", "high") for c in v})), ("prediction_rows", log.get("prediction_rows", 0))]
    return spark.createDataFrame(rows, "item string, count long")


def modalities(log: dict) -> dict:
    """Which of numbers, categories, dates, texts and images took part."""
    groups = log.get("feature_groups", {})
    made = groups.get("encoded", [])
    return {
        "numeric": bool(groups.get("numeric")), "categorical": bool(groups.get("low") or groups.get("medium") or groups.get("high")), "datetime": bool(groups.get("datetime")),
        "text": bool(groups.get("text")), "text_svd": any("__svd_" in c for c in made), "images": any(c.startswith("image__") for c in made),
    }


def run_eda(spark: SparkSession, summary: dict, root: str | Path, max_rows: int | None = None, seed: int = 42) -> dict:
    """Write artifacts/eda and return its summary. Steps fail by themselves: the status is ok, partial (any warning) or
    failed (nothing was written). max_rows samples large tables first; by default all rows are used."""
    out = files.artifacts_dir(root) / "eda"
    tables: dict[str, DataFrame] = {}
    warnings: list[str] = []
    written: list[str] = []
    drawn: list[str] = []
    for role in schema.ROLES[:-1]:
        path = files.role_path(summary, role)
        if path and Path(path).is_file():
            df = files.read_csv(spark, path)
            tables[role] = (sample_rows(df, max_rows, seed=seed) if max_rows else df).cache()
    target, block = summary.get("target_column"), summary["metric"]["block_column"]
    train, features, other = tables.get("train_target"), tables.get("train_features"), tables.get("validation_features")
    if train is not None:
        target = kinds.training_target(train, target, summary.get("row_id_column"))
    keys = summary["join"]["train_keys"]
    merged = joins.checked_inner_merge(train, features, keys) if train is not None and features is not None and keys else None
    merged = merged if merged is not None else features if features is not None else train

    def step(name: str, make: Callable[[], DataFrame | None], draw: Callable[[list], str] | None = None) -> None:
        try:
            df = make()
            if df is None:
                warnings.append(f"{name}: nothing to summarise")
                return
            files.write_csv(df, out / f"{name}.csv", digits=4)
            written.append(f"{name}.csv")
            if draw:
                files.write_text(draw(df.limit(60).collect()), out / f"{name}.svg")
                drawn.append(f"{name}.svg")
        except Exception as e:  # the other steps go on
            warnings.append(f"{name}: {type(e).__name__}: {str(e)[:200]}")

    def union(frames: list[DataFrame]) -> DataFrame | None:
        whole = None
        for f in frames:
            whole = f if whole is None else whole.unionByName(f)
        return whole

    bars = lambda label, number, title: lambda rows: figures.bars([(r[label], r[number]) for r in rows], title)
    log = files.read_json(files.artifacts_dir(root) / "modeling_log.json")
    step("raw_files", lambda: raw_overview(spark, summary))
    if log.get("feature_groups"):
        step("modeling_frame", lambda: modeling_overview(spark, log))
    step("dataset_overview", lambda: union([profile.overview(df, r, files.role_path(summary, r)) for r, df in tables.items()]))
    step("column_types", lambda: spark.createDataFrame([{k: str(v) for k, v in kinds.type_counts(df, r).items()} for r, df in tables.items()]) if tables else None)
    if merged is not None:
        step("missingness", lambda: profile.missingness(merged), bars("column", "missing_pct", "Missing share"))
        numbers = [c for c in profile.numeric_columns(merged) if c != target]
        has_target = target if target and target in merged.columns else None
        step("numeric_feature_summary", lambda: profile.numeric_summary(merged, has_target, numbers) if numbers else None)
        if has_target and numbers:
            step("top_numeric_correlations", lambda: profile.top_correlations(profile.numeric_summary(merged, has_target, numbers)), bars("column", "abs_corr_with_target", "|r| with the target"))
        texts = profile.categorical_columns(merged)
        step("categorical_feature_summary", lambda: profile.categorical_summary(merged, texts) if texts else None)
        found = profile.time_patterns(merged, has_target)
        step("time_summary", lambda: found[1] if found else None, lambda rows: figures.line([(r["period"], r["rows"]) for r in rows], "Rows by month"))
    if train is not None and target:
        step("target_summary", lambda: profile.target_summary(train, target))
        for how in (None, "log1p"):
            step(f"target_histogram{'_' + how if how else ''}", lambda how=how: profile.histogram(train, target, how), lambda rows: figures.bars([(f"{r['low']:.4g}", r["count"]) for r in rows], "Target"))
        if block and block in train.columns:
            step("target_by_block", lambda: profile.target_by_block(train, target, block), bars("block", "mean_target", "Mean target"))
    if features is not None and other is not None:
        both = [c for c in features.columns if c in other.columns]
        numbers = [c for c in profile.numeric_columns(features) if c in both and c in profile.numeric_columns(other)]
        texts = [c for c in profile.categorical_columns(features) if c in both]
        step("shift_numeric", lambda: profile.shift_numeric(features, other, numbers) if numbers else None, bars("column", "standardized_mean_diff", "Standardised difference"))
        step("shift_categorical", lambda: profile.shift_categorical(features, other, texts) if texts else None)
    for df in tables.values():
        df.unpersist()
    result = {"status": "failed" if not written else "partial" if warnings else "ok", "tables": written, "figures": drawn, "modalities": modalities(log), "warnings": warnings}
    files.write_json(result, out / "eda_summary.json")
    return result
