import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.functions import metrics, scalar
from tabloom.operators import encoders, joins, ordering, profile, text_features
from tabloom.operators import types as kinds
from tabloom.operators.ordering import ORD


def one(df):
    return df.first()[0]


def test_mae(spark):
    df = spark.createDataFrame([(1.0, 1.0, "A"), (2.0, 3.0, "A"), (3.0, 5.0, "B"), (4.0, 4.0, None), (float("nan"), 1.0, "B"), (1.0, float("inf"), "C")], "y double, p double, b string")
    assert one(metrics.mae(df, "y", "p")) == 0.75
    assert one(metrics.block_averaged_mae(df, "y", "p", "b")) == pytest.approx((0.5 + 2 + 0) / 3)
    assert one(metrics.block_averaged_mae(df, "y", "p", "b", [" a"])) == 0.5
    assert one(metrics.mae(df.where("y > 100"), "y", "p")) is None
    spec = metrics.MetricSpec(mode="block_averaged", block_column="b")
    assert metrics.score(df, "y", "p", spec)["score"] == pytest.approx(2.5 / 3)


def test_text_stats(spark):
    df = spark.createDataFrame([("Hi there! 42 OK?",), (None,), ("   ",), ("...",), ("x² ١",)], "t string")
    rows = [tuple(r)[1:] for r in text_features.text_stats(df, "t").collect()]
    assert rows[0] == (16, 4, 2, 2, 2, pytest.approx(3 / 9), 0)
    assert rows[1] == (0, 0, 0, 0, 0, 0, 1) and rows[2] == (3, 0, 0, 0, 0, 0, 1)
    assert rows[3][2] == 1 and rows[4][3] == 2


def test_numbers_and_dates(spark):
    df = spark.createDataFrame([(x,) for x in ("1", " 2.5 ", "5d", "1e3", "-inf", "nan", "", None, "0x1", ".5")], "x string")
    assert [r[0] for r in df.select(scalar.to_number("x")).collect()] == [1.0, 2.5, None, 1000.0, -math.inf, None, None, None, None, 0.5]
    dates = spark.createDataFrame([("2020-01-05",), ("01/05/2020",), ("20200105",), ("Jan 5 2020",), ("no",)], "d string")
    got = [r[0] for r in dates.select(scalar.to_timestamp("d").cast("date").cast("string")).collect()]
    assert got == ["2020-01-05"] * 4 + [None]
    parts = dates.limit(1).select(*[c.alias(k) for k, c in scalar.date_parts(scalar.to_timestamp("d")).items()]).first()
    assert tuple(parts) == (2020, 1, 5, 6, 0)
    years = spark.createDataFrame([(2020,), (2021,)], "y int").select(scalar.month_period(scalar.to_timestamp("y", "int")))
    assert {r[0] for r in years.collect()} == {"1970-01"}
    assert one(spark.range(1).select(scalar.row_bucket(F.lit(123), 5))) == 4


def test_profile_types(spark):
    rows = [(i, i % 3, "x" * (60 if i % 2 else 41), f"2020-01-{i % 28 + 1:02}", "ab"[i % 2], float(i) * 1.5) for i in range(60)]
    df = spark.createDataFrame(rows, "width int, k int, note string, day string, cat string, price double")
    got = kinds.profile_types(df)
    assert got["numeric_columns"] == ["k", "price", "width"] and {"width", "price"} <= set(got["id_like_columns"])  # width contains id
    assert got["datetime_like_columns"] == ["day"] and got["text_columns"] == ["note"] and got["categorical_columns"] == ["cat"]
    got = kinds.feature_types(df)
    assert got == {"numeric": ["k"], "categorical": ["cat"], "text": ["note"], "datetime": ["day"], "id_like": ["width", "price"]}
    counts = kinds.type_counts(df, "t")
    assert counts["numeric_columns"] == 3 and counts["high_cardinality_columns"] == 2
    assert kinds.type_counts(df.limit(0), "t") == kinds.type_counts(None, "t") == {"table": "t", "rows": 0, "columns": 0}


def test_targets_and_ids(spark):
    sample = spark.createDataFrame([(10, "a", "0"), (11, "b", "0")], "code int, seg string, out string")
    assert kinds.row_id_column(sample, sample.columns) == "code" and kinds.row_id_column(None, ["x", "Row ID"]) == "Row ID"
    assert kinds.target_column(None, sample, "code") == "out"
    train = spark.createDataFrame([(1, 2.0, 3.0)], "id int, Label double, z double")
    assert kinds.target_column(train, None, "id") == "Label" and kinds.training_target(train, "nope", "id") == "z"
    assert kinds.submission_columns(sample, "code", "out") == ["code", "out"]


def test_safe_merge_matches_nulls_keeps_first_and_suffixes(spark):
    left = spark.createDataFrame([("a", 0), (None, 0)], "k string, y int")
    right = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), (None, 3, 2)], f"k string, y int, {ORD} long")
    merged, warnings = joins.safe_merge(left, right, ["k"])
    assert sorted((r.k or "", r.y_feat) for r in merged.collect()) == [("", 3), ("a", 1)]
    assert "33.3%" in warnings[0] and "only the first" in warnings[1] and len(warnings) == 2
    assert joins.safe_merge(left, None, ["k"])[0] is left
    assert joins.safe_merge(left, right, ["gone"])[1] == ["not merged: a table lacks ['gone']"]


@pytest.mark.parametrize("kind", ["int", "bigint", "double", "date", "boolean", "string", "timestamp"])
def test_safe_merge_of_key_types(spark, kind):
    left = spark.sql(f"SELECT * FROM VALUES (CAST(NULL AS {kind}), 1), (CAST(NULL AS {kind}), 2) AS t(k, l)")
    right = spark.sql(f"SELECT * FROM VALUES (CAST(NULL AS {kind}), 7, 1L), (CAST(NULL AS {kind}), 8, 0L) AS t(k, r, {ORD})")
    assert [r.r for r in joins.safe_merge(left, right, ["k"], check=False)[0].collect()] == [8, 8]
    zero = {"date": "1970-01-01", "timestamp": "1970-01-01", "boolean": "false", "string": ""}.get(kind, "0")
    stand_in = spark.sql(f"SELECT CAST('{zero}' AS {kind}) AS k, 9 AS r, 0L AS {ORD}")
    assert [r.r for r in joins.safe_merge(left, stand_in, ["k"], check=False)[0].collect()] == [None, None]  # null isn't its stand-in
    if kind == "int":
        wide = right.withColumn("k", F.col("k").cast("bigint"))
        assert [r.r for r in joins.safe_merge(left, wide, ["k"], check=False)[0].collect()] == [8, 8]


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("dedup", [True, False])
def test_merge_facts_equal_pandas(spark, how, dedup):
    left = pd.DataFrame({"k": ["a", "b", None, "c", "a"], "l": range(5)})
    right = pd.DataFrame({"k": ["a", "a", None, "d"], "v": [1.0, None, None, 2.0]})
    r = right.drop_duplicates("k") if dedup else right
    want = left.merge(r, on="k", how=how)
    right_df = spark.createDataFrame([tuple(None if pd.isna(x) else x for x in t) + (i,) for i, t in enumerate(right.itertuples(index=False))], f"k string, v double, {ORD} long")
    left_df = spark.createDataFrame([tuple(t) for t in left.itertuples(index=False)], "k string, l int")
    f = joins.merge_facts(left_df, right_df, ["k"], how == "left", dedup)
    assert (f.merged_rows, f.left_rows, f.right_rows) == (len(want), 5, 4) and f.right_duplicate_rate == pytest.approx(0.25)
    if how == "left":
        assert f.feature_match_rate == pytest.approx(want["v"].notna().mean())


def tables(spark):
    target = spark.createDataFrame([(i, 2020 + i % 6, "abc"[i % 3], i * 1.0) for i in range(60)], "entity_id int, time_key int, segment string, target_value double")
    features = spark.createDataFrame([(i, 2020 + i % 6, "abc"[i % 3], i * 2.0, i) for i in range(60)], f"entity_id int, time_key int, segment string, f1 double, {ORD} long")
    sample = spark.createDataFrame([(k, 100 + k, 2020 + k % 6, "abc"[k % 3], 0.0) for k in range(12)], "row_id int, entity_id int, time_key int, segment string, target_value double")
    validation = spark.createDataFrame([(100 + k, 2020 + k % 6, "abc"[k % 3], 1.0, k) for k in range(12)], f"entity_id int, time_key int, segment string, f1 double, {ORD} long")
    return target, features, sample, validation


def test_key_search(spark):
    target, features, sample, validation = tables(spark)
    got = joins.infer_pipeline_keys(target, features, sample, validation, {"row_id", "target_value"}, ["entity_id", "time_key"])
    assert got.train_keys == got.predict_keys == ["entity_id", "time_key"] and got.train_source == got.predict_source == "description" and not got.warnings
    search = joins.KeySearch(sample, validation, True, [("entity_id", "time_key"), ("segment",)])
    assert search.score(("entity_id", "time_key")) == 108 and search.score(("nope",)) == -1
    train = joins.KeySearch(target, features, False, [("entity_id", "time_key")])
    assert train.score(("entity_id", "time_key")) == 124
    free = joins.infer_pipeline_keys(target, features, sample, validation, {"row_id", "target_value"}, None)
    assert set(free.predict_keys) >= {"entity_id"} and free.predict_source == "columns that the other merge shares"
    candidates = joins.key_candidates(sample, validation, {"row_id"})
    assert len(candidates) == 7 and all(joins.KeySearch(sample, validation, True, candidates).bound(k) >= joins.KeySearch(sample, validation, True, candidates).score(k) for k in candidates)
    text_keys = validation.withColumn("entity_id", F.col("entity_id").cast("string"))
    assert joins.KeySearch(sample, text_keys, True, [("entity_id",)]).score(("entity_id",)) == -1
    assert joins.infer_pipeline_keys(None, None, sample, validation.select(F.lit(1).alias("z")), set(), None).predict_keys is None


def test_keep_first_both_ways(spark):
    df = spark.createDataFrame([(None, 5, 2), (None, 6, 1), ("a", 7, 0), ("a", 8, 3)], f"k string, v int, {ORD} long")
    want = [(None, 6), ("a", 7)]
    for f in (ordering.keep_first, ordering.keep_first_by_aggregate):
        assert sorted(((r.k, r.v) for r in f(df, ["k"]).collect()), key=str) == sorted(want, key=str)


def test_frequency_and_cardinality(spark):
    train = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "c string")
    other = spark.createDataFrame([("a",), ("c",), (None,)], "c string")
    a, b = encoders.frequency_encode(train, other, ["c"])
    assert sorted(r[0] for r in a.collect()) == [0.25, 0.25, 0.5, 0.5] and sorted(r[0] for r in b.collect()) == [0.0, 0.25, 0.5]
    _, b = encoders.frequency_encode(train, other.select(F.lit(1).alias("x")), ["c"])
    assert {r["c__freq"] for r in b.collect()} == {0.0}


def test_imputation_and_assembly(spark):
    df = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (3.0, "a"), (10.0, "b"), (None, None), (float("nan"), "zz")], "x double, c string")
    assert encoders.medians(df, ["x"]) == {"x": 2.5} and encoders.modes(df, ["c"]) == {"c": "a"}
    fitted = encoders.Assembler(["x"], ["c"]).fit(df.limit(4))
    rows = [r.features.toArray().tolist() for r in fitted.transform(df).collect()]
    assert rows[0] == [1, 0, 1] and rows[1] == [2, 1, 0] and rows[4] == [2.5, 1, 0] and rows[5] == [2.5, 0, 0]


def test_prepare_frames(spark):
    target, features, sample, validation = tables(spark)
    frames = encoders.prepare_frames(joins.safe_merge(target, features, ["entity_id", "time_key"])[0], joins.safe_merge(sample, validation, ["entity_id", "time_key"])[0], "target_value", "row_id")
    assert "entity_id" in frames.groups.dropped and "time_key" in frames.groups.numeric and {"segment", "segment_feat"} <= set(frames.groups.low)
    assert "target_value" in frames.train.columns and "row_id" in frames.other.columns


def test_shift_and_correlation_corner_cases(spark):
    a, b = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0)], "x double, c double"), spark.createDataFrame([(2.0, 1.0), (4.0, 2.0)], "x double, c double")
    got = {r["column"]: r for r in profile.shift_numeric(a, b, ["x", "c"]).collect()}
    assert got["x"].standardized_mean_diff == pytest.approx(2 / math.sqrt(2))
    same = profile.shift_numeric(a.limit(1), a.limit(1), ["x"]).first()
    assert same.standardized_mean_diff == 0
    few = profile.numeric_summary(a, "c").first()
    assert few.abs_corr_with_target is None and few["count"] == 2 and few["skew"] is None


def test_profile_of_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a"), (1.0, "a"), (float("nan"), "b"), (None, "a")], "x double, s string")
    got = {r["column"]: r for r in profile.missingness(df).collect()}
    assert got["x"].missing_count == 3 and got["x"].missing_pct == 0.75 and got["s"]["nunique"] == 2
    over = profile.overview(df, "r", "p").first()
    assert (over.rows, over.duplicate_rows, over.missing_cells) == (4, 1, 3)
    top = profile.categorical_summary(df, ["s"]).first()
    assert (top.top_value, top.top_value_freq, top.high_cardinality) == ("a", 3, False)
    empty = df.limit(0)
    assert profile.missingness(empty).count() == 2 and profile.overview(empty, "r", "p").first().rows == 0
    assert profile.histogram(empty, "x").count() == 0 and profile.target_summary(empty, "x").first()["count"] == 0
    assert profile.drop_all_missing(df.withColumn("n", F.lit(None).cast("string"))).columns == ["x", "s"]


def test_time_patterns(spark):
    df = spark.createDataFrame([(f"2020-{m:02}-01", "x", float(m)) for m in range(1, 13)] + [(None, "x", 0.0)], "event_date string, daytime string, y double")
    name, counts = profile.time_patterns(df, "y")
    rows = counts.collect()
    assert name == "event_date" and rows[0].period == "2020-01" and rows[-1].period == "NaT" and len(rows) == 13
    assert profile.time_patterns(df.select("daytime", "y"), "y") is None


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "x double")
    rows = profile.histogram(df, "x").collect()
    assert sum(r["count"] for r in rows) == 11 and rows[-1].bin == 10 and rows[-1]["count"] == 2 and rows[0].low == 0
    assert profile.histogram(df.where("x = 3"), "x").first()["count"] == 1


def test_svd_equals_numpy(spark):
    import numpy as np

    texts = ["red apple pie", "green apple tart", "blue sky above", "sky full of rain", "apple sky", "rain again and again"] * 5
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"{ORD} long, t string")
    out, _, names, why = text_features.add_svd(df, df, "t", ORD)
    assert why is None and len(names) == 5
    vocab = text_features.vocabulary(df, "t", 30)
    w = text_features.tfidf(df, ORD, "t", vocab).toPandas().pivot(index="key", columns="term", values="weight").fillna(0).sort_index()
    _, s, vt = np.linalg.svd(w.values, full_matrices=False)
    got = np.array([tuple(r[n] for n in names) for r in out.orderBy(ORD).collect()])
    assert np.allclose(np.abs(got[:, :3]), np.abs(w.values @ vt[:3].T), atol=1e-8)
    assert text_features.add_svd(df.limit(5), df, "t", ORD)[3]


def test_keep_first_without_file_order_takes_the_least_row(spark):
    rows = [(1, "b", 2.0), (1, "a", 9.0), (1, "a", 3.0), (None, "z", 1.0), (None, None, 5.0)]
    df = spark.createDataFrame(rows, "k int, s string, x double").repartition(3)
    assert sorted(ordering.keep_first(df, ["k"]).collect(), key=repr) == sorted([(1, "a", 3.0), (None, None, 5.0)], key=repr)


def test_time_columns_are_found_by_their_values(spark):
    df = spark.createDataFrame([(f"2024-0{1 + i % 3}-11", f"note {i}", i) for i in range(30)], "made string, note string, n int")
    assert profile.time_candidates(df) == ["made"]


def test_accents_of_many_languages_are_taken_off(spark):
    df = spark.createDataFrame([("Žluťoučký kůň łódź ŞIŞLİ Việt été",)], "t string")
    (got,) = df.select(text_features.tokens(F.col("t"))).first()
    assert got[:2] == ["zlutoucky", "kun"] and "viet" in got and "ete" in got and any(w.startswith("sisl") for w in got)


@pytest.mark.parametrize("ties", [20_000, 0])
def test_vocabulary_counts_only_pairs_that_may_be_in_it(spark, monkeypatch, ties):
    """Against a plain count of all terms, with ties at the vocabulary's end; it is counted once, not anew by whatever uses it."""
    import random
    from collections import Counter

    rng = random.Random(5)
    docs = [[f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randint(0, 12))] for _ in range(300)]
    grams = [d + [f"{a} {b}" for a, b in zip(d, d[1:])] for d in docs]
    tf, df = Counter(g for d in grams for g in d), Counter(g for d in grams for g in set(d))
    want = sorted((t for t in tf if df[t] >= 2), key=lambda t: (-tf[t], t))[:100]
    assert tf[want[-1]] == tf[sorted((t for t in tf if df[t] >= 2), key=lambda t: (-tf[t], t))[100]] and any(" " in t for t in want)
    monkeypatch.setattr(text_features, "MOST_TIES", ties)
    monkeypatch.setattr(text_features, "most_terms", lambda n: 100)
    monkeypatch.setattr(text_features, "COUNTED_ROWS", 7)
    frame = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], f"{ORD} long, t string").repartition(3)
    vocab = text_features.vocabulary(frame, "t", 300)
    assert {r.term: r.df for r in vocab.collect()} == {t: df[t] for t in want}
    assert "Generate" not in vocab._jdf.queryExecution().executedPlan().toString()
    assert text_features.vocabulary(frame.limit(0), "t", 300).count() == 0
