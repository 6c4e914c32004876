"""The whole run: clean, schema, train and predict, explore, validate, report."""

from __future__ import annotations

import sys
import time
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.scalar import is_finite
from tabloom.operators import joins
from tabloom.operators import types as kinds
from tabloom.operators.encoders import Step, prepare_frames
from tabloom.operators.ordering import ORD
from tabloom.plans import eda, models, report, schema, validate
from tabloom.sources import files, images


def _table(spark: SparkSession, summary: dict, role: str) -> DataFrame | None:
    path = files.role_path(summary, role)
    return files.read_csv(spark, path) if path and Path(path).is_file() else None


def image_step(spark: SparkSession, folder: str, keys: list[str]) -> Step | None:
    """Adds pixel statistics of the rows' image sidecars, matched by the key columns; None if the folder has no images."""
    if not Path(folder).is_dir() or not any(p.suffix.lower().lstrip(".") in images.SUFFIXES for p in Path(folder).rglob("*")):
        return None
    found = images.find_images(spark, folder)
    contents = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")

    def add(train: DataFrame, other: DataFrame):
        tagged = lambda df, tag: df.select(*keys, F.concat(F.lit(tag), F.col(ORD)).alias("__row"))
        both = tagged(train, "t").unionByName(tagged(other, "p"))
        made, names, why = images.image_features(spark, both, "__row", keys, found, found.join(contents, "path"))
        if why:
            return train, other, [], [why]
        side = made.select("__row", *names)
        join = lambda df, tag: df.withColumn("__k", F.concat(F.lit(tag), F.col(ORD))).join(side, F.col("__k") == F.col("__row"), "left").drop("__k", "__row")
        return join(train, "t"), join(other, "p"), names, []

    return add


def training_table(target: DataFrame, features: DataFrame | None, keys: list[str] | None) -> tuple[DataFrame, list[str]]:
    """Targets with their features; targets alone if the merge isn't possible."""
    return joins.safe_merge(target, features, keys, "inner") if features is not None and keys else (target, ["no features were merged"])


def prediction_table(sample: DataFrame, features: DataFrame | None, keys: list[str] | None) -> tuple[DataFrame, list[str]]:
    """The sample's rows, all of them and in their order, with features where there are any."""
    return joins.safe_merge(sample, features, keys, "left") if features is not None and keys else (sample, ["no features were merged"])


def train_and_predict(spark: SparkSession, root: str | Path, summary: dict | None = None, seconds: float | None = None, candidates=None) -> dict:
    """Write submission.csv, cv_results.csv and modeling_log.json. Whatever goes wrong after the tables are read, the
    submission holds medians."""
    summary = summary or schema.load(spark, root)
    target_df, sample = _table(spark, summary, "train_target"), _table(spark, summary, "sample_submission")
    if target_df is None or sample is None:
        raise ValueError("a training target and a sample are needed")
    row_id, spec = summary["row_id_column"], schema.metric_of(summary)
    out_column = summary["target_column"]
    target = kinds.training_target(target_df, out_column, row_id)
    if target is None or row_id is None:
        raise ValueError("the target or the row id is unknown")
    log: dict = {"row_id": row_id, "target": target, "notes": []}
    train, notes = training_table(target_df, _table(spark, summary, "train_features"), summary["join"]["train_keys"])
    log["notes"] += notes
    train = train.where(F.col(target).isNotNull())
    rows, notes = prediction_table(sample, _table(spark, summary, "validation_features"), summary["join"]["predict_keys"])
    log["notes"] += notes
    block = spec.block_column if spec.block_column in train.columns else None
    facts = train.where(is_finite(target)).agg(F.count("*"), F.min(target), F.median(F.col(target).cast("double"))).first()
    try:
        # block and placeholder target leave the features of both strategies; the block rides along as __block
        carry = [F.col(block).cast("string").alias("__block")] if block else []
        a = train.select(*[c for c in train.columns if c != block], *carry)
        b = rows.select(*[c for c in rows.columns if c not in (block, out_column)], *([F.col(block).cast("string").alias("__block")] if block and block in rows.columns else [F.lit(None).cast("string").alias("__block")] if block else []))
        keys = [k for k in summary["join"]["predict_keys"] or [] if k in a.columns and k in b.columns]
        pictures = image_step(spark, summary["data_dir"], keys) if keys else None
        frames = prepare_frames(a.where(is_finite(target)), b, target, row_id, keep=["__block"] if block else [], images=pictures)
        log |= {"feature_groups": asdict(frames.groups)}
        log["notes"] += frames.notes
        assembler = frames.assembler()
        task = models.Task(frames.train.cache(), target, list(assembler.numeric), list(assembler.categories), spec, "__block" if block else None)
        chosen = models.choose(task, facts[0], seconds=seconds, candidates=candidates)
        predictions = models.fit_selection(task, chosen).predict(frames.other)
        log |= {"strategy": chosen.strategy, "score": chosen.score, "model": chosen.candidate.name if chosen.candidate else "median", "blocks": {b: c.candidate.name if c.candidate else "median" for b, c in chosen.blocks.items()}}
        files.write_csv(models.cv_frame(spark, chosen.rows), files.artifacts_dir(root) / "cv_results.csv")
    except Exception as e:  # any failure still leaves a valid submission
        log |= {"strategy": "fallback", "score": None, "model": "median", "error": f"{type(e).__name__}: {str(e)[:500]}"}
        predictions = models.fallback_predictions(train, target, rows.drop("prediction"), block)
    fixed = models.repair(predictions, facts[2] or 0.0, facts[1] is not None and facts[1] >= 0).select(row_id, F.col("prediction").alias(out_column), ORD).cache()
    log["notes"] += models.sanity(fixed.withColumnRenamed(out_column, "prediction"))
    log |= {"prediction_rows": fixed.count(), "submission": "submission.csv"}
    files.write_predictions(fixed, Path(root) / "submission.csv", row_id, out_column)
    files.write_json(log, files.artifacts_dir(root) / "modeling_log.json")
    return log


def validate_submission(spark: SparkSession, root: str | Path, summary: dict | None = None) -> validate.Report:
    summary = summary or schema.load(spark, root)
    path = Path(root) / "submission.csv"
    submission = files.read_csv(spark, path) if path.is_file() else None
    got = validate.validate(submission, _table(spark, summary, "sample_submission"), summary["submission_columns"], summary["row_id_column"], summary["target_column"])
    out = files.artifacts_dir(root)
    files.write_json(got.as_dict(), out / "validation_report.json")
    files.write_text(got.markdown(), out / "validation_report.md")
    return got


OUTPUTS = ("submission.csv", "report.pdf", "report.md")
ARTIFACTS = ("schema_summary.json", "schema_summary.md", "modeling_log.json", "cv_results.csv", "validation_report.json", "validation_report.md", "pipeline_run_log.json")


def clean(root: str | Path) -> None:
    """Remove the files that an earlier run wrote, and no others."""
    for p in [Path(root) / f for f in OUTPUTS] + [Path(root) / "artifacts" / f for f in ARTIFACTS] + list((Path(root) / "artifacts" / "eda").glob("*")):
        if p.is_file():
            p.unlink()


def run(spark: SparkSession, root: str | Path, seconds: float | None = None, candidates=None) -> dict:
    """All steps; one that fails is logged and the later ones still run. Passed: submission and report are there and the
    submission is valid."""
    clean(root)
    log: dict = {"status": "running", "steps": []}
    state: dict = {}

    def step(name: str, f) -> None:
        began = time.monotonic()
        try:
            state[name] = f()
            status, error = "ok", None
        except Exception as e:  # later steps still run
            status, error = "failed", f"{type(e).__name__}: {str(e)[:500]}"
        log["steps"].append({"step": name, "status": status, "seconds": round(time.monotonic() - began, 3), "error": error})

    def make_schema() -> dict:
        summary = schema.build_summary(spark, root)
        schema.save(summary, root)
        return summary

    step("schema", make_schema)
    step("train_predict", lambda: train_and_predict(spark, root, state.get("schema"), seconds, candidates))
    step("eda", lambda: eda.run_eda(spark, state["schema"], root))
    step("validate", lambda: validate_submission(spark, root, state.get("schema")))
    files.write_json(log | {"status": "pre_report"}, files.artifacts_dir(root) / "pipeline_run_log.json")
    step("report", lambda: report.write_report(root))
    valid = isinstance(state.get("validate"), validate.Report) and state["validate"].ok
    there = all((Path(root) / f).is_file() for f in ("submission.csv", "report.pdf"))
    log["status"] = "passed" if valid and there else "failed"
    files.write_json(log, files.artifacts_dir(root) / "pipeline_run_log.json")
    return log


def main(args: list[str] | None = None) -> int:
    """spark-submit entry: runner.py [run|schema|train|eda|validate|report] ROOT"""
    args = sys.argv[1:] if args is None else args
    if len(args) != 2 or args[0] not in ("run", "schema", "train", "eda", "validate", "report"):
        print(main.__doc__)
        return 2
    what, root = args
    spark = SparkSession.builder.appName("tabloom").getOrCreate()
    if what == "run":
        log = run(spark, root)
        for s in log["steps"]:
            print(f"{s['step']}: {s['status']} in {s['seconds']} s" + (f" ({s['error']})" if s["error"] else ""))
        print(log["status"])
        return int(log["status"] != "passed")
    if what == "schema":
        summary = schema.build_summary(spark, root)
        schema.save(summary, root)
        print(schema.markdown(summary))
    elif what == "train":
        print(report.show(train_and_predict(spark, root)))
    elif what == "eda":
        print(report.show(eda.run_eda(spark, schema.load(spark, root), root)))
    elif what == "validate":
        got = validate_submission(spark, root)
        print(got.markdown())
        return int(not got.ok)
    else:
        print(report.write_report(root))
    return 0


if __name__ == "__main__":
    sys.exit(main())
