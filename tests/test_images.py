"""Names looked up by an index of their pieces, and the signature of a folder."""

import random

from pyspark.sql import functions as F

from tabloom.sources import images


def test_numbered_names_meet_few_images(spark):
    """Ten thousand ids that begin alike: under ten pairs a row, and every row its image."""
    n = 10_000
    rows = spark.range(n).select("id", F.format_string("cust%06d", "id").alias("customer"))
    names = images.with_tokens(spark.range(n).select(F.concat(F.lit("/x/Photo-"), F.format_string("cust%06d", "id"), F.lit("_a.png")).alias("path")))
    sets = rows.select(F.array(F.col("customer")).alias("want"))
    assert images.candidate_pairs(sets, names).count() < 10 * n
    got = images.match_images(rows, "id", ["customer"], names)
    assert got.where("candidates <> 1 or path not like concat('%', format_string('cust%06d', key), '%')").count() == 0 and got.count() == n


def test_index_finds_what_all_pairs_find(spark):
    rng = random.Random(4)
    part = lambda: "".join(rng.choice("ab1") for _ in range(rng.choice([1, 2, 3, 4, 6, 7, 13])))
    names = [f"/i/{part()}{rng.choice('-_ .')}{part()}.jpg" for _ in range(150)]
    rows = [(i, part(), rng.choice([part(), None, "x y"])) for i in range(300)]
    table = images.with_tokens(spark.createDataFrame([(p,) for p in names], "path string"))
    stems = {r.path: r for r in table.collect()}
    df = spark.createDataFrame(rows, "id long, a string, b string")
    want = {r.id: r.t for r in df.select("id", images.row_tokens(df, ["a", "b"]).alias("t")).collect()}
    got = {r.key: (r.path, r.candidates) for r in images.match_images(df, "id", ["a", "b"], table).collect()}
    assert set(got) == {i for i, t in want.items() if t}
    for i, (path, n) in got.items():
        hits = sorted({p for p, r in stems.items() if all(t in r.tokens or t in r.norm or t in r.stem for t in want[i])})
        assert n == len(hits) and path == (hits[0] if n == 1 else None)


def test_signature(spark):
    paths = [(f"/a/{i * 7919 % 1000}.png",) for i in range(1000)]
    df = spark.createDataFrame(paths, "path string")
    first = images.signature(df)
    assert first == images.signature(df.repartition(7)) == images.signature(df.orderBy(F.desc("path"))) and len(first) == 40
    others = [images.signature(df.limit(0)), images.signature(df.where("path <> '/a/5.png'")), images.signature(df.unionByName(df.limit(1))), images.signature(spark.createDataFrame([("/a/5.jpg" if p == "/a/5.png" else p,) for (p,) in paths], "path string"))]
    assert len({first, *others}) == 5


def test_postings_are_not_broadcast(spark):
    """They are many times the names, whatever their compressed size."""
    names = images.with_tokens(spark.range(500).select(F.format_string("/x/cust%06d.png", "id").alias("path")))
    pairs = images.candidate_pairs(spark.range(500).select(F.array(F.format_string("cust%06d", "id")).alias("want")), names)
    assert pairs.count() == 500 and "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
