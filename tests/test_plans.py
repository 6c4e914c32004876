import csv
import json

import pytest
from pyspark.sql import functions as F

from tabloom.operators.ordering import ORD
from tabloom.plans import models, report, runner, schema, validate
from tabloom.sources import files, images, mock


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    path = tmp_path_factory.mktemp("task")
    mock.create_mock(path)
    return path


def test_schema_of_the_mock_task(spark, root):
    got = schema.build_summary(spark, root)
    roles = {r: p["path"].rpartition("data/")[2] for r, p in got["roles"].items()}
    assert roles == {"sample_submission": "sample_submission.csv", "train_target": "train/target.csv", "train_features": "train/features.csv", "validation_features": "val/features.csv"}
    assert (got["row_id_column"], got["target_column"], got["submission_columns"]) == ("row_id", "target_value", ["row_id", "target_value"])
    assert got["metric"]["metric_mode"] == "global" and got["join"]["train_keys"] == got["join"]["predict_keys"] == ["entity_id", "time_key"]
    assert got["join"]["predict_source"] == "description" and got["join"]["predict_merge_metadata"]["merged_rows"] == 30
    assert schema.with_metric_and_joins(got, "", {})["join"]["train_keys"] is None


def test_whole_run(spark, root):
    pool = [c for c in models.registry() if c.name in ("dummy_median", "ridge_alpha1", "random_forest_depth6_leaf2_n80")]
    log = runner.run(spark, root, candidates=pool)
    assert log["status"] == "passed" and [s["status"] for s in log["steps"]] == ["ok"] * 5, log
    with open(root / "submission.csv") as f:
        rows = list(csv.DictReader(f))
    assert [int(r["row_id"]) for r in rows] == list(range(1, 31)) and all(float(r["target_value"]) >= 0 for r in rows)
    modeling = json.loads((root / "artifacts/modeling_log.json").read_text())
    assert modeling["strategy"] == "global" and modeling["model"] != "dummy_median" and "error" not in modeling
    assert set(modeling["feature_groups"]["low"]) >= {"segment", "categorical_feature"}
    eda = json.loads((root / "artifacts/eda/eda_summary.json").read_text())
    assert {"missingness.csv", "target_summary.csv", "shift_numeric.csv", "numeric_feature_summary.csv", "dataset_overview.csv"} <= set(eda["tables"]), eda
    text = (root / "report.md").read_text()
    assert all(f"## {s}" in text for s in report.SECTIONS[1:]) and (root / "report.pdf").read_bytes().startswith(b"%PDF-1.4")
    again = validate.validate(files.read_csv(spark, root / "submission.csv"), files.read_csv(spark, root / "data/sample_submission.csv"), ["row_id", "target_value"], "row_id", "target_value")
    assert again.ok


def test_fallback_leaves_a_valid_submission(spark, root, monkeypatch):
    monkeypatch.setattr(runner, "prepare_frames", lambda *a, **k: 1 / 0)
    log = runner.train_and_predict(spark, root, schema.build_summary(spark, root))
    assert log["strategy"] == "fallback" and "ZeroDivisionError" in log["error"]
    assert runner.validate_submission(spark, root).ok


def test_validation_errors(spark):
    sample = spark.createDataFrame([(i, 0.0, i) for i in range(4)], f"row_id int, y double, {ORD} long")
    check = lambda rows, cols=f"row_id int, y string, {ORD} long": validate.validate(spark.createDataFrame(rows, cols), sample, ["row_id", "y"], "row_id", "y").errors
    assert check([(0, "1", 0), (1, "2", 1), (2, "3", 2), (3, "4", 3)]) == []
    assert check([(0, "1", 0), (2, "2", 1), (1, "3", 2), (3, "4", 3)]) == ["row order mismatch at 2 places"]
    assert check([(0, "x", 0), (None, "inf", 1), (None, "NaN", 2)]) == ["2 null ids", "1 duplicate ids", "2 missing or non-numeric predictions", "1 infinite predictions", "row count 3, expected 4", "3 ids of the sample are missing", "1 ids are not in the sample"]
    assert check([("1", 0, 0)], f"y string, row_id int, {ORD} long")[0].startswith("column order")
    assert validate.validate(None, sample, ["row_id", "y"], "row_id", "y").errors


def test_csv_reading(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes('a,b,c,d,e,f\n1,NA,"x, ""y""",True,2020-01-01,\n2,3,"two\nlines",False,caf\xe9,\n,4.5,NULL,True,nan,\n'.encode("latin-1"))
    df = files.read_csv(spark, path)
    assert dict(df.drop(ORD).dtypes) == {"a": "bigint", "b": "double", "c": "string", "d": "boolean", "e": "string", "f": "double"}
    rows = df.orderBy(ORD).collect()
    assert [r.a for r in rows] == [1, 2, None] and rows[0].c == 'x, "y"' and rows[1].c == "two\nlines" and rows[1].e == "café" and rows[2].c is None
    assert files.count_csv_rows(spark, path) == 4 and files.count_csv_rows(spark, tmp_path / "no.csv") is None
    assert files.read_csv_head(spark, path, 1).count() == 1 and files.read_csv_for_schema(spark, path, 2).count() == 2
    files.write_csv(df, tmp_path / "out.csv", digits=2)
    assert (tmp_path / "out.csv").read_text().splitlines()[1] == '1,,"x, ""y""",True,2020-01-01,'


def test_files(tmp_path):
    assert files.find_csv_files(tmp_path / "none") == [] and files.read_json(tmp_path / "x.json") == {} and files.read_description(tmp_path) == ""
    (tmp_path / "b.md").write_text("b")
    (tmp_path / "my_description.md").write_bytes(b"caf\xe9")
    assert files.read_description(tmp_path) == "café"
    files.write_json({"a": float("nan"), "b": {1: (2,)}}, tmp_path / "x.json")
    assert files.read_json(tmp_path / "x.json") == {"a": None, "b": {"1": [2]}}


def lines(spark, n=60):
    rows = [(i, "ABC"[i % 3], float(i % 10), 3.0 * (i % 10) + "ABC".index("ABC"[i % 3])) for i in range(n)]
    return spark.createDataFrame(rows, f"{ORD} long, b string, x double, y double")


def test_ridge_is_exact(spark):
    import numpy as np

    df = lines(spark).withColumn("y", F.col("y") + F.col(ORD) % 7)
    got = models.fit(next(c for c in models.registry() if c.name == "ridge_alpha10"), df, "y", ["x"], []).transform(df).orderBy(ORD).collect()
    x, y = np.array([r.x for r in got]), np.array([r.y for r in got])
    w = ((x - x.mean()) * (y - y.mean())).sum() / (((x - x.mean()) ** 2).sum() + 10)
    assert np.allclose([r.prediction for r in got], y.mean() + w * (x - x.mean()))


def test_candidates_by_size():
    families = lambda n, p, s="global": [c.family for c in models.select(n, p, s)]
    small = families(120, 8)
    assert len(small) == 13 and [small.count(f) for f in ("extra_trees", "random_forest", "gradient_boosting", "ridge", "dummy")] == [3, 3, 3, 3, 1]
    assert [families(10_000, 8).count(f) for f in ("extra_trees", "random_forest", "gradient_boosting", "ridge", "dummy")] == [2, 2, 2, 2, 1]
    assert [families(50_000, 8).count(f) for f in ("extra_trees", "random_forest", "ridge", "dummy")] == [2, 2, 2, 1]
    assert [families(100, 8, "per_block").count(f) for f in ("extra_trees", "random_forest", "ridge", "dummy")] == [3, 3, 2, 1]


def test_per_block_strategy(spark, monkeypatch):
    df = lines(spark, 75).withColumn("y", F.when(F.col("b") == "A", 2 * F.col("x")).otherwise(-5 * F.col("x") + F.lit(100)))
    df = df.unionByName(spark.createDataFrame([(1000 + i, "small", 1.0, 7.0) for i in range(6)], df.schema))
    spec = models.MetricSpec(mode="block_averaged", block_column="b")
    ridge = [c for c in models.registry() if c.name == "ridge_alpha0.1"]
    monkeypatch.setattr(models, "select", lambda *a, **k: ridge)
    task = models.Task(df, "y", ["x"], [], spec, "b")
    chosen = models.choose(task, 81)
    assert chosen.strategy == "per_block" and chosen.blocks["small"].candidate is None and chosen.blocks["a"].candidate.name == "ridge_alpha0.1"
    assert any(r.status == "fallback_insufficient_rows" and r.block == "small" for r in chosen.rows)
    new = spark.createDataFrame([(0, " a", 3.0), (1, "small", 3.0), (2, "unseen", 3.0), (3, None, 3.0)], f"{ORD} long, b string, x double")
    got = {r.b: r.prediction for r in models.fit_selection(task, chosen).predict(new).collect()}
    median = df.agg(F.median("y")).first()[0]
    assert got[" a"] == pytest.approx(6, abs=0.5) and got["small"] == 7.0 and got["unseen"] == got[None] == median
    frame = models.cv_frame(spark, chosen.rows)
    assert report.strategy_comparison(frame).first().strategy == "per_block" and report.selected_per_block(frame).count() == 4
    assert models.choose(task, 81, seconds=-1).strategy in ("per_block", "global")


def test_failing_candidate_is_a_row(spark):
    broken = models.Candidate("broken", "x", 1, lambda *a: 1 / 0)
    r = models.cross_validate(models.Task(lines(spark), "y", ["x"], []), broken, 60)
    assert r.status == "failed" and "ZeroDivisionError" in r.notes
    assert models.cross_validate(models.Task(lines(spark), "y", ["x"], []), broken, 10).status == "skipped_insufficient_rows"


def test_image_names_and_stats(spark, tmp_path):
    import numpy as np

    for name in ("plot_0042_north.PNG", "plot-0043-south.jpg", "notes.txt", "sub/plot_0044_north.webp"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    found = images.find_images(spark, str(tmp_path))
    assert found.count() == 3 and len(images.signature(found)) == 40
    rows = spark.createDataFrame([(0, "0042", "North"), (1, "0043", "north"), (2, "7", "x"), (3, None, "south"), (4, None, "north")], "i int, plot string, side string")
    got = {r.key: (r.path or "").rpartition("/")[2] for r in images.match_images(rows, "i", ["plot", "side"], found).collect()}
    assert got == {0: "plot_0042_north.PNG", 1: "", 2: "", 3: "plot-0043-south.jpg", 4: ""}
    stats = images.pixel_stats(np.stack([np.full((2, 4), v) for v in (0.0, 0.5, 1.0)], axis=2))
    assert (stats["width"], stats["height"], stats["brightness_mean"], stats["red_mean"], stats["blue_mean"]) == (4, 2, 0.5, 0, 1)
    contents = found.join(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).select("path", "content"), "path")
    decode = lambda raw: np.full((1, len(raw), 3), 0.25)
    out, names, why = images.image_features(spark, rows.where("i in (0, 3)"), "i", ["plot", "side"], found, contents, decode)
    assert why is None and {r["image__brightness_mean"] for r in out.collect()} == {0.25} and len(names) == 14
    assert images.image_features(spark, rows.where("i = 4"), "i", ["plot", "side"], found)[2].startswith("images skipped")


def test_images_take_part_in_a_run(spark, tmp_path, monkeypatch):
    import numpy as np

    mock.create_mock(tmp_path, train=40, predict=8)
    for i in [*range(1, 41), *range(1001, 1009)]:
        (tmp_path / "data" / f"e{i:05}-{2020 + ((i - 1) % 1000) % 6}.png").write_bytes(bytes(i % 7 + 1))
    monkeypatch.setattr(images, "decoder", lambda: lambda raw: np.full((1, len(raw), 3), 0.5))
    summary = schema.build_summary(spark, tmp_path)
    step = runner.image_step(spark, summary["data_dir"], ["entity_id", "time_key"])
    rows = spark.createDataFrame([(k, 1000 + k, 2020 + k - 1) for k in (1, 2)], f"{ORD} long, entity_id long, time_key long")
    train, other, names, notes = step(rows, rows)
    assert not notes and len(names) == 14 and {r["image__width"] for r in other.collect()} == {1001 % 7 + 1.0, 1002 % 7 + 1.0}
    assert runner.image_step(spark, str(tmp_path / "artifacts"), ["a"]) is None


def test_pdf_has_tables_figures_and_numbered_pages():
    missing = [{"column": f"column {i}", "missing_pct": str(i / 100), "note": "long (text) " * 9} for i in range(60)]
    c = {"schema": {"files": [{"rel_path": "a\\b.csv", "role": "train_target", "n_rows": 3, "n_cols": 2}], "warnings": ["é and … and 漢"]}, "modeling": {}, "validation": {"status": "passed"}, "eda": {"missingness": missing}, "cv": [], "log": {}}
    raw = report.pdf(c)
    pages = raw.count(b"/Type /Page ")
    assert raw.startswith(b"%PDF-1.4") and raw.endswith(b"%%EOF\n") and pages >= 3
    assert f"(Page 1 of {pages})".encode() in raw and f"(Page {pages} of {pages})".encode() in raw
    assert raw.count(b"(column)") == 1 and b"(Missing share by column)" in raw and raw.count(b" re f") > 20  # a heading of one page, bars
    assert b"long \\(text\\)" in raw and b"a\\\\b.csv" in raw and all(f"{i}. {s}".encode() in raw for i, s in enumerate(report.SECTIONS) if i)
    start = int(raw.rsplit(b"startxref\n", 1)[1].split()[0])
    assert raw[start : start + 4] == b"xref"
    assert [t for t, _ in report.charts(c)] == ["Missing share by column"] and len(report.charts(c)[0][1]) == 24


def test_places_are_ranked_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(validate, "RANKED_ROWS", 40)
    df = spark.range(1000).select(F.col("id").alias("row_id"), (F.pmod(F.xxhash64("id"), F.lit(7)) * 100_000 + F.col("id") * 3).alias(ORD)).repartition(5)
    want = {r.row_id: i for i, r in enumerate(sorted(df.collect(), key=lambda r: r[ORD]), 1)}
    assert {r.row_id: r.place for r in validate.places(df).collect()} == want
    assert validate.places(df.limit(0)).count() == 0


def test_first_rows_are_taken_once(spark, monkeypatch):
    """Key search counts a task's tables many times; the shuffle that makes them runs once."""
    from tabloom import queries
    from tabloom.operators import joins, ordering

    seen, made = [], joins.infer_pipeline_keys
    monkeypatch.setattr(joins, "infer_pipeline_keys", lambda *t, **more: seen.extend("InMemoryTableScan" in x._jdf.queryExecution().executedPlan().toString() for x in t) or made(*t, **more))
    assert queries.queries()["pipeline_keys"](spark, "/root/testdata/sf0.001").count() == 3 and seen == [True] * 4


def test_report_orders_by_the_scores_shown(spark, monkeypatch):
    """Scores that are equal once rounded go by the model's name, as in the SQL."""
    from tabloom import queries_inference

    rows = [models.Row("global", "__all__", m, 3, s, 0.0, s, 0.0) for m, s in (("c", 2.0), ("b", 1.00001), ("a", 1.00002))]
    monkeypatch.setattr(queries_inference, "_selection", lambda *_: models.Selection("global", 1.0, None, {}, rows))
    assert [(r.model, r.score_mean) for r in queries_inference.cv_report(spark, "").collect()] == [("a", 1.0), ("b", 1.0), ("c", 2.0)]


@pytest.mark.parametrize("query", ["cv_report", "model_selection"])
def test_near_scores_are_told_apart(spark, tmp_path, query):
    """In exact arithmetic the ridge model of penalty 10 is the best here, by 5e-11 of 25,000; sums that round off row by row miss that."""
    from tabloom import queries_inference

    rows = [(i, (i * 8015 + 5026992) % 50 * 1000.0 + 1000, float((i * i * 31 + i * 66065 + 48) % 100003 + 900)) for i in range(6000)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_quantity double, l_extendedprice double")
    for parts in (1, 3):
        lines.repartitionByRange(parts, "l_orderkey").sortWithinPartitions("l_orderkey").write.parquet(str(tmp_path / str(parts) / "lineitem.parquet"))
        got = getattr(queries_inference, query)(spark, str(tmp_path / str(parts))).where("is_selected AND model <> 'global'").collect()
        assert [r.model for r in got] == ["ridge_alpha10"]
