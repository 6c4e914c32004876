"""Quantiles by narrowing, streams, the image cache."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import profile, quantiles
from tabloom.sources import images
from tabloom.streaming import events


@pytest.mark.parametrize("one_pass_rows", [10**9, 0])
def test_exact_quantiles(spark, one_pass_rows):
    rng = random.Random(3)
    rows = [(rng.gauss(0, 1), float(rng.randint(0, 3)), None if i % 3 else float(i), None) for i in range(5000)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(4)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = quantiles.exact_quantiles(df, {c: F.col(c) for c in "abcd"}, probs, one_pass_rows=one_pass_rows)
    for k, c in enumerate("abc"):
        assert got[c] == pytest.approx(np.quantile([r[k] for r in rows if r[k] is not None], probs))
    assert got["d"] == [None] * 5
    assert quantiles.exact_quantiles(df.limit(0), {"a": F.col("a")}, probs, one_pass_rows=one_pass_rows) == {"a": [None] * 5}


def test_summaries_agree_for_large_tables(spark, monkeypatch):
    df = spark.createDataFrame([(float(i * i % 97), float(i)) for i in range(500)], "x double, y double")
    plain = profile.numeric_summary(df, "y").collect(), profile.target_summary(df, "y").collect()
    monkeypatch.setattr(quantiles, "ONE_PASS_ROWS", 0)
    assert (profile.numeric_summary(df, "y").collect(), profile.target_summary(df, "y").collect()) == plain


def test_streams_give_what_tables_give(spark, tmp_path):
    rows = [(f"2024-01-{1 + i % 9:02} 0{i % 10}:00:00", "AB"[i % 2], float(i), float(i % 5)) for i in range(200)]
    table = spark.createDataFrame(rows, "t string, b string, y double, p double").withColumn("ts", F.to_timestamp("t"))
    table.write.parquet(str(tmp_path / "in"))
    for name, f in (("counts", lambda d: events.windowed_counts(d, value="y")), ("errors", lambda d: events.windowed_block_errors(d, "y", "p", "b"))):
        stream = f(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")))
        q = stream.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
        key = lambda r: (r.start, str(r[1]))
        assert sorted(spark.table(name).collect(), key=key) == sorted(f(table).collect(), key=key)


def test_image_cache(spark, tmp_path):
    found = images.with_tokens(spark.createDataFrame([("/x/a_1.png",), ("/x/b_2.png",)], "path string"))
    made = []

    def make():
        made.append(1)
        return spark.createDataFrame([(len(made),)], "n int")

    get = lambda rows: images.cached_features(spark, str(tmp_path / "cache"), found, {"rows": rows}, make).first()[0]
    assert [get(5), get(5), get(6), get(6)] == [1, 1, 2, 2] and len(made) == 2
