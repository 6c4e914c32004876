"""CSV files with quoted line ends, read by several tasks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators.ordering import ORD
from tabloom.sources import files, records

VALUES = ["x", "", 'say "hi"', "two\nlines", "a,b", "\n\n", '5" pipe', '"', "été", "\n\"\n,", "long " * 30, "row\nof\n" * 40]


def plain(line: str, inside: bool) -> bool:
    """The state at a line's end, character by character."""
    start, i = not inside, 0
    while i < len(line):
        if inside:
            if line[i] == '"':
                if line[i + 1 : i + 2] == '"':
                    i += 1
                else:
                    inside = False
        elif line[i] == '"' and start:
            inside = True
        start = not inside and line[i] == ","
        i += 1
    return inside


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_states_of_lines(spark, tmp_path):
    rng = random.Random(5)
    lines = ["".join(rng.choice('"",ab') for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    (tmp_path / "lines").write_text("\n".join(lines) + "\n")
    got = records.physical_lines(spark, str(tmp_path / "lines")).orderBy("id").collect()
    assert [bytes(r.line).decode() for r in got] == lines
    assert [(r.from_out, r.from_in) for r in got] == [(plain(x, False), plain(x, True)) for x in lines]
    for start in (False, True):
        want = [start]
        for x in lines:
            want.append(plain(x, want[-1]))
        assert records.states(np.array([r.from_out for r in got]), np.array([r.from_in for r in got]), start).tolist() == want


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_over_many_splits(spark, tmp_path, small_splits, end):
    rng = random.Random(len(end))
    rows = [[str(i), rng.choice(VALUES), rng.choice(VALUES)] for i in range(120)]
    quote = lambda v: '"' + v.replace('"', '""') + '"' if any(c in v for c in ',"\n') or rng.random() < 0.2 else v
    path = tmp_path / "t.csv"
    path.write_bytes((end + end.join(",".join(map(quote, r)) for r in [["id", "a\nb", "c"], *rows[:60]]) + end + end + end.join(",".join(map(quote, r)) for r in rows[60:])).encode())
    raw = files.read_raw(spark, str(path))
    assert records.physical_lines(spark, str(path)).rdd.getNumPartitions() > 10
    got = raw.orderBy(ORD).collect()
    reader = spark.read.options(header="true", multiLine="true", escape='"').csv(str(path)).select("id", files.missing(F.col("`a\nb`")).alias("a\nb"), files.missing(F.col("c")).alias("c"))
    assert raw.columns == [*reader.columns, ORD]
    assert [tuple(r)[:3] for r in got] == [tuple(r) for r in reader.collect()]
    assert [r.id for r in got] == [r[0] for r in rows]
    first = files.read_csv_head(spark, path, 70).orderBy(ORD)
    assert [r.id for r in first.collect()] == list(range(70))


def test_odd_files(spark, tmp_path, small_splits):
    for name, text, want in (
        ("empty", "", []), ("blank", "\n\n", []), ("header", "a,b\n", []), ("short", "a,b\n1\n2,3,4\n", [("1", None), ("2", "3")]),
        ("open", 'a,b\n1,"x\ny\n' + "z" * 900, [("1", "x\ny\n" + "z" * 900)]), ("unquoted", 'a,b\n1,5" x\n2,y\n', [("1", '5" x'), ("2", "y")]),
    ):
        (tmp_path / name).write_text(text)
        assert [tuple(r)[:2] for r in files.read_raw(spark, str(tmp_path / name)).orderBy(ORD).collect()] == want, name
    (tmp_path / "names").write_text("a,A,,b \n1,2,3,4\n")
    assert files.read_raw(spark, str(tmp_path / "names")).columns == ["a0", "A1", "_c2", "b", ORD]


def test_folder_of_files(spark, tmp_path, small_splits):
    rows = [(i, "text\nof two" if i % 3 else "x" * (i % 900), None if i % 7 else "é") for i in range(500)]
    spark.createDataFrame(rows, "id long, a string, b string").repartition(4).write.options(header=True, escape='"').csv(str(tmp_path / "many"))
    got = files.read_csv(spark, tmp_path / "many").orderBy("id").select("id", "a", "b").collect()
    assert [tuple(r) for r in got] == [(i, a or None, b) for i, a, b in rows]
