"""Queries over the test tables, one for each operator, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom import queries_inference, registry  # noqa: F401 (the former registers its queries)
from tabloom.functions import metrics, scalar
from tabloom.operators import encoders, joins, ordering, profile, text_features
from tabloom.plans import description, models, validate
from tabloom.registry import q, query, read, union

# ---- metrics ----

PREDICTED = "(SELECT *, (SELECT median(value) FROM events) AS pred FROM events)"


def with_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return events.join(F.broadcast(events.agg(F.median("value").alias("pred"))))  # the median is one row


@query(q(f"SELECT avg(abs(value - pred)) AS mae FROM {PREDICTED}"))
def mae_global(spark, sf_dir):
    return metrics.mae(with_median(spark, sf_dir), "value", "pred")


@query(q(f"SELECT avg(mae) AS block_mae FROM (SELECT event_type, avg(abs(value - pred)) AS mae FROM {PREDICTED} GROUP BY event_type)"))
def mae_block_averaged(spark, sf_dir):
    return metrics.block_averaged_mae(with_median(spark, sf_dir), "value", "pred", "event_type")


@query(q(f"""SELECT avg(mae) AS block_mae FROM (SELECT event_type, avg(abs(value - pred)) AS mae FROM {PREDICTED}
    WHERE lower(trim(event_type)) IN ('view', 'click', 'purchase') GROUP BY event_type)"""))
def mae_block_averaged_official(spark, sf_dir):
    return metrics.block_averaged_mae(with_median(spark, sf_dir), "value", "pred", "event_type", [" View", "click", "PURCHASE "])


# ---- summaries ----

_G1 = "(avg(x*x*x) - 3*avg(x)*avg(x*x) + 2*power(avg(x), 3)) / power(var_pop(x), 1.5)"


def _moments(x: str) -> str:
    return f"""count({x}) AS count, avg({x}) AS mean, stddev_samp({x}) AS std, min({x}) AS min, quantile_cont({x}, 0.25) AS q25, quantile_cont({x}, 0.5) AS median,
        quantile_cont({x}, 0.75) AS q75, max({x}) AS max"""


@query(q(f"""SELECT 'o_totalprice' AS target_column, {_moments('x')}, round({_G1}, 6) AS skew, count(CASE WHEN x = 0 THEN 1 END) AS zero_count,
    count(CASE WHEN x < 0 THEN 1 END) AS negative_count, count(CASE WHEN x IS NULL THEN 1 END) AS missing_count FROM (SELECT o_totalprice AS x FROM orders)"""))
def target_summary(spark, sf_dir):
    return profile.target_summary(read(spark, sf_dir, "orders"), "o_totalprice").withColumn("skew", F.round("skew", 6))


@query(q("""SELECT o_orderpriority AS block, count(*) AS rows, avg(o_totalprice) AS mean_target, stddev_samp(o_totalprice) AS std_target, median(o_totalprice) AS median_target,
    min(o_totalprice) AS min_target, max(o_totalprice) AS max_target, count(*) - count(o_totalprice) AS missing_target_count FROM orders GROUP BY o_orderpriority"""))
def target_by_block(spark, sf_dir):
    return profile.target_by_block(read(spark, sf_dir, "orders"), "o_totalprice", "o_orderpriority")


_CUSTOMER = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}


@query(union([q(f"""SELECT '{c}' AS column, '{t}' AS dtype, count(*) - count(v) AS missing_count, round((count(*) - count(v)) / count(*), 4) AS missing_pct, count(DISTINCT v) AS nunique
    FROM (SELECT {"nullif(c_mktsegment, 'BUILDING')" if c == "c_mktsegment" else c} AS v FROM customer)""") for c, t in _CUSTOMER.items()]))
def missingness(spark, sf_dir):
    df = read(spark, sf_dir, "customer").withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return profile.missingness(df)


_CELLS = {"region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]}


def _overview(t: str, cs: list[str]) -> str:
    gaps = "+".join(f"({c} IS NULL)::INT" for c in cs)
    texts = "+".join(f"strlen({c})" for c in cs if c.endswith(("_name", "_mktsegment", "_brand", "_type")))
    return f"""SELECT 'table' AS role, '{t}' AS relative_path, count(*) AS rows, {len(cs)} AS columns, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {t})) AS duplicate_rows,
        sum({gaps})::BIGINT AS missing_cells, sum({gaps}) / (count(*) * {len(cs)})::DOUBLE AS missing_pct, round((count(*) * 8 * {len(cs)} + sum({texts})) / 1048576, 4) AS memory_mb FROM {t}"""


@query(union([q(_overview(t, cs)) for t, cs in _CELLS.items()]))
def dataset_overview(spark, sf_dir):
    out = None
    for t in _CELLS:
        one = profile.overview(read(spark, sf_dir, t), "table", t)
        out = one if out is None else out.unionByName(one)
    return out


_NUMBERS = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


@query(union([q(f"""SELECT '{c}' AS column, {_moments('x')}, round({_G1}, 6) AS skew, round(avg((x IS NULL)::INT), 9) AS missing_pct, round(abs(corr(x, y)), 9) AS abs_corr_with_target
    FROM (SELECT CASE WHEN l_linenumber <> 3 THEN {c}::DOUBLE END AS x, l_extendedprice AS y FROM lineitem)""") for c in _NUMBERS]))
def numeric_summary_corr(spark, sf_dir):
    gaps = {c: F.when(F.col("l_linenumber") != 3, F.col(c)).alias(c) for c in _NUMBERS}
    out = profile.numeric_summary(read(spark, sf_dir, "lineitem").withColumns(gaps), "l_extendedprice", _NUMBERS)
    return out.withColumns({"skew": F.round("skew", 6), "abs_corr_with_target": F.round("abs_corr_with_target", 9), "missing_pct": F.round("missing_pct", 9)})


def _category(t: str, c: str) -> str:
    return f"""SELECT '{c}' AS column, count(*) FILTER (v IS NOT NULL) AS nunique, sum(CASE WHEN v IS NULL THEN n ELSE 0 END)::DOUBLE / sum(n) AS missing_pct,
        arg_max(v, (n, -ascii(v))) FILTER (v IS NOT NULL) AS top_value, max(n) FILTER (v IS NOT NULL) AS top_value_freq, max(n) FILTER (v IS NOT NULL)::DOUBLE / sum(n) AS top_value_pct,
        count(*) FILTER (v IS NOT NULL) > 50 OR count(*) FILTER (v IS NOT NULL) > 0.5 * sum(n) AS high_cardinality FROM (SELECT {c} AS v, count(*) AS n FROM {t} GROUP BY {c})"""


@query(union([q(_category("lineitem", c)) for c in ("l_returnflag", "l_linestatus")]))
def categorical_summary(spark, sf_dir):
    return profile.categorical_summary(read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])


_CUT = "TIMESTAMP '1996-01-01'"


def _gaps(c: str) -> str:
    return f"(SELECT l_shipdate, CASE WHEN l_linenumber <> 2 AND (l_linenumber <> 4 OR l_shipdate < {_CUT}) THEN {c} END AS x FROM lineitem)"


@query(union([q(f"""SELECT '{c}' AS column, a.m AS train_mean, b.m AS validation_mean, round((b.m - a.m) / w.s, 9) AS standardized_mean_diff, round(a.n, 9) AS train_missing_pct,
    round(b.n, 9) AS validation_missing_pct, round(b.n - a.n, 9) AS missing_pct_diff FROM (SELECT avg(x) AS m, avg((x IS NULL)::INT) AS n FROM {_gaps(c)} WHERE l_shipdate < {_CUT}) a, (SELECT avg(x) AS m, avg((x IS NULL)::INT) AS n FROM {_gaps(c)} WHERE l_shipdate >= {_CUT}) b,
    (SELECT stddev_pop(x) AS s FROM {_gaps(c)}) w""") for c in ("l_quantity", "l_extendedprice")]))
def shift_numeric(spark, sf_dir):
    there = (F.col("l_linenumber") != 2) & ((F.col("l_linenumber") != 4) | F.expr(f"l_shipdate < {_CUT}"))
    df = read(spark, sf_dir, "lineitem").withColumns({c: F.when(there, F.col(c)) for c in ("l_quantity", "l_extendedprice")})
    early, late = (df.where(f"l_shipdate {op} {_CUT}") for op in ("<", ">="))
    out = profile.shift_numeric(early, late, ["l_quantity", "l_extendedprice"])
    return out.withColumns({c: F.round(c, 9) for c in ("standardized_mean_diff", "train_missing_pct", "validation_missing_pct", "missing_pct_diff")})


@query(union([q(f"""SELECT '{c}' AS column, (SELECT count(DISTINCT {c}) FROM part WHERE p_size <= 10) AS train_nunique, count(DISTINCT {c}) AS validation_nunique,
    count(DISTINCT CASE WHEN {c} NOT IN (SELECT {c} FROM part WHERE p_size <= 10) THEN {c} END) AS unseen_validation_categories_count,
    avg(CASE WHEN {c} NOT IN (SELECT {c} FROM part WHERE p_size <= 10) THEN 1.0 ELSE 0.0 END) AS unseen_validation_categories_pct, 0.0 AS train_missing_pct, 0.0 AS validation_missing_pct
    FROM part WHERE p_size > 10""") for c in ("p_brand", "p_type", "p_name")]))
def shift_categorical(spark, sf_dir):
    df = read(spark, sf_dir, "part")
    return profile.shift_categorical(df.where("p_size <= 10"), df.where("p_size > 10"), ["p_brand", "p_type", "p_name"])


@query(q("""SELECT 'o_orderdate' AS source_column, strftime(o_orderdate, '%Y-%m') AS period, count(*) AS rows, avg(o_totalprice) AS mean_target FROM orders GROUP BY period"""))
def time_counts(spark, sf_dir):
    return profile.time_counts(read(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice")


def _histogram(x: str) -> str:
    return f"""WITH v AS (SELECT {x} AS x FROM events WHERE value > -1), r AS (SELECT count(*) AS n, min(x) AS lo, max(x) AS hi, least(40, greatest(10, floor(sqrt(count(*)))))::INT AS bins FROM v)
        SELECT least(floor((x - lo) / ((hi - lo) / bins))::INT + 1, bins) AS bin, count(*) AS count,
        any_value(round(lo + (least(floor((x - lo) / ((hi - lo) / bins))::INT + 1, bins) - 1) * ((hi - lo) / bins), 6)) AS low,
        any_value(round(lo + least(floor((x - lo) / ((hi - lo) / bins))::INT + 1, bins) * ((hi - lo) / bins), 6)) AS high FROM v, r GROUP BY 1"""


def _rounded_edges(df: DataFrame) -> DataFrame:
    return df.withColumns({"low": F.round("low", 6), "high": F.round("high", 6)})


@query(q(_histogram("value")))
def histogram_target(spark, sf_dir):
    return _rounded_edges(profile.histogram(read(spark, sf_dir, "events"), "value"))


@query(q(_histogram("ln(1 + value)")))
def histogram_log1p(spark, sf_dir):
    return _rounded_edges(profile.histogram(read(spark, sf_dir, "events"), "value", "log1p"))


# ---- joins ----

_FIRST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1)"


def _ordered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return df.withColumn(ordering.ORD, F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))


def _merge(spark, sf_dir, how):
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(0).alias("l_suppkey"), "o_totalprice")
    return joins.safe_merge(orders, _ordered_lines(spark, sf_dir), ["l_orderkey"], how, check=False)[0]


@query(q(f"SELECT o.o_orderkey AS l_orderkey, 0 AS l_suppkey, o_totalprice, l_linenumber, l_partkey, l.l_suppkey AS l_suppkey_feat, l_extendedprice FROM orders o LEFT JOIN {_FIRST} l ON o_orderkey = l_orderkey"))
def safe_merge_left(spark, sf_dir):
    return _merge(spark, sf_dir, "left")


@query(q(f"SELECT o.o_orderkey AS l_orderkey, 0 AS l_suppkey, o_totalprice, l_linenumber, l_partkey, l.l_suppkey AS l_suppkey_feat, l_extendedprice FROM orders o JOIN {_FIRST} l ON o_orderkey = l_orderkey"))
def safe_merge_inner(spark, sf_dir):
    return _merge(spark, sf_dir, "inner")


@query(q("""WITH l AS (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS k FROM customer),
    r AS (SELECT k, min(s_suppkey) AS s_suppkey FROM (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'MACHINERY' ELSE 'FURNITURE' END AS k FROM supplier) GROUP BY k)
    SELECT l.c_custkey, l.k, r.s_suppkey FROM l LEFT JOIN r ON l.k IS NOT DISTINCT FROM r.k"""))
def merge_null_safe(spark, sf_dir):
    left = read(spark, sf_dir, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("k"))
    k = F.when(F.col("s_suppkey") % 3 == 1, "MACHINERY").when(F.col("s_suppkey") % 3 == 2, "FURNITURE")
    right = read(spark, sf_dir, "supplier").select(k.alias("k"), "s_suppkey").withColumn(ordering.ORD, F.col("s_suppkey"))
    return joins.safe_merge(left, right, ["k"], "left", check=False)[0]


_SETS = [("l_orderkey",), ("l_linenumber",), ("l_orderkey", "l_linenumber"), ("l_partkey", "l_suppkey")]


@query(union([q(f"SELECT '{'+'.join(k)}' AS keys, count(*) AS rows, count(DISTINCT ({', '.join(k)},)) AS distinct_rows, round(1 - count(DISTINCT ({', '.join(k)},)) / count(*), 9) AS duplicate_rate FROM lineitem") for k in _SETS]))
def right_duplicate_rate(spark, sf_dir):
    rows, found = joins.distinct_counts(read(spark, sf_dir, "lineitem"), _SETS)
    return spark.createDataFrame([("+".join(k), rows, n, round(1 - n / rows, 9)) for k, n in found.items()], "keys string, rows long, distinct_rows long, duplicate_rate double")


@query(q("""WITH s AS (SELECT o_orderkey AS k FROM orders), d AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT 'k' AS keys, (SELECT count(*) FROM s) AS left_rows, (SELECT count(*) FROM lineitem) AS right_rows, count(*) AS merged_rows,
    round(1 - (SELECT count(*) FROM d) / (SELECT count(*) FROM lineitem), 9) AS right_duplicate_rate, round(count(d.n) / count(*), 9) AS feature_match_rate FROM s LEFT JOIN d ON s.k = d.k"""))
def join_key_facts(spark, sf_dir):
    left = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    right = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_quantity")
    f = joins.merge_facts(left, right, ["k"], preserve_left_rows=True, dedup=True)
    row = ("+".join(f.keys), f.left_rows, f.right_rows, f.merged_rows, round(f.right_duplicate_rate, 9), round(f.feature_match_rate, 9))
    return spark.createDataFrame([row], "keys string, left_rows long, right_rows long, merged_rows long, right_duplicate_rate double, feature_match_rate double")


@query(q("""SELECT c.c_custkey, c.c_acctbal, c.c_nationkey, s.n_name, s.n_regionkey FROM customer c JOIN nation s ON c.c_nationkey = s.n_nationkey"""))
def checked_inner_merge(spark, sf_dir):
    left = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    right = read(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return joins.checked_inner_merge(left, right, ["c_nationkey"])


# ---- encoders ----


@query(q("""WITH t AS (SELECT * FROM part WHERE p_size <= 25), n AS (SELECT count(*) AS n FROM t), b AS (SELECT p_brand, count(*) / any_value(n) AS f FROM t, n GROUP BY p_brand),
    y AS (SELECT p_type, count(*) / any_value(n) AS f FROM t, n GROUP BY p_type)
    SELECT p_partkey, coalesce(b.f, 0) AS p_brand__freq, coalesce(y.f, 0) AS p_type__freq FROM part p LEFT JOIN b USING (p_brand) LEFT JOIN y USING (p_type) WHERE p_size > 25"""))
def frequency_encode(spark, sf_dir):
    df = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    return encoders.frequency_encode(df.where("p_size <= 25"), df.where("p_size > 25"), ["p_brand", "p_type"])[1].drop("p_size")


@query(q("""SELECT o_orderkey, year(d)::DOUBLE AS d__year, month(d)::DOUBLE AS d__month, day(d)::DOUBLE AS d__day, (isodow(d) - 1)::DOUBLE AS d__dayofweek, (d IS NULL)::INT::DOUBLE AS d__is_missing_datetime
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderdate END AS d FROM orders)"""))
def datetime_features(spark, sf_dir):
    d = F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderdate")).alias("d")
    return encoders.add_date_features(read(spark, sf_dir, "orders").select("o_orderkey", d), ["d"])


@query(q("""SELECT c AS column, CASE WHEN regexp_matches(c, '(^|_)id$|^uuid$|^index$') OR (u / n > 0.95 AND u > 20) THEN 'dropped' WHEN u <= 50 THEN 'low' WHEN u <= 500 THEN 'medium' WHEN u / n > 0.99 THEN 'dropped' ELSE 'high' END AS class
    FROM (SELECT unnest(['p_name', 'p_brand', 'p_type']) AS c, unnest([count(DISTINCT p_name), count(DISTINCT p_brand), count(DISTINCT p_type)]) AS u, count(*) AS n FROM part)"""))
def cardinality_split(spark, sf_dir):
    got = encoders.cardinality(read(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"])
    return spark.createDataFrame([(c, k) for k, v in got.items() for c in v], "column string, class string")


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(q("SELECT o_orderkey, " + ", ".join(f"""CASE WHEN o_orderstatus = '{v}' THEN 1.0 ELSE 0.0 END AS "o_orderstatus__{v}\"""" for v in "FOP") + " FROM orders"))
def one_hot(spark, sf_dir):
    df = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return encoders.one_hot(df, "o_orderstatus", encoders.one_hot_columns(df, "o_orderstatus"))


@query(q("""SELECT c_custkey, coalesce(b, (SELECT median(CASE WHEN c_acctbal >= 0 THEN c_acctbal END) FROM customer)) AS c_acctbal FROM (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS b FROM customer)"""))
def impute_median(spark, sf_dir):
    df = read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal"))
    return encoders.impute(df, encoders.medians(df, ["c_acctbal"]), {})


@query(q("""WITH m AS (SELECT c_mktsegment AS m FROM customer WHERE c_custkey % 7 <> 0 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN m ELSE c_mktsegment END AS c_mktsegment FROM customer, m"""))
def impute_mode(spark, sf_dir):
    df = read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    return encoders.impute(df, {}, encoders.modes(df, ["c_mktsegment"]))


# ---- texts ----

_TEXT_STATS = """SELECT doc_id, length(text)::DOUBLE AS text__char_len, len(regexp_extract_all(text, '[^\\s]+'))::DOUBLE AS text__word_count,
    CASE WHEN trim(text, E' \\n\\t\\r') = '' THEN 0.0 ELSE greatest(len([x FOR x IN regexp_split_to_array(text, '[.!?]+') IF regexp_matches(x, '[^\\s]')]), 1)::DOUBLE END AS text__sentence_count,
    len(regexp_extract_all(text, '[\\p{Nd}²³¹⁰⁴-⁹₀-₉]'))::DOUBLE AS text__digit_count, len(regexp_extract_all(text, '[^\\p{L}\\p{N}\\s]'))::DOUBLE AS text__punctuation_count,
    coalesce(len(regexp_extract_all(text, '\\p{Lu}')) / nullif(len(regexp_extract_all(text, '\\p{L}')), 0), 0.0) AS text__uppercase_ratio,
    CASE WHEN trim(text, E' \\n\\t\\r') = '' THEN 1.0 ELSE 0.0 END AS text__is_missing FROM documents"""


@query(q(_TEXT_STATS))
def text_stats(spark, sf_dir):
    return text_features.text_stats(read(spark, sf_dir, "documents").select("doc_id", "text"), "text").drop("text")


_GRAMS = """words AS (SELECT item_id AS d, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}_]{2,}') AS w FROM benchmark),
    grams AS (SELECT d, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])) AS term FROM words), n AS (SELECT count(*) AS n FROM benchmark),
    counts AS (SELECT term, count(*) AS tf, count(DISTINCT d) AS df FROM grams GROUP BY term),
    vocab AS (SELECT term, df, ln((1 + n) / (1 + df)) + 1 AS idf FROM counts, n WHERE df >= greatest(1, least(2, n // 50)) ORDER BY tf DESC, term LIMIT (SELECT least(2000, greatest(100, 5 * count(*))) FROM benchmark))"""


def _vocabulary(spark, sf_dir):
    df = read(spark, sf_dir, "benchmark")
    return df, text_features.vocabulary(df, "text", df.count())


@query(q(f"WITH {_GRAMS} SELECT term, df, round(idf, 9) AS idf FROM vocab"))
def tfidf_vocabulary(spark, sf_dir):
    return _vocabulary(spark, sf_dir)[1].withColumn("idf", F.round("idf", 9))


@query(q(f"""WITH {_GRAMS}, w AS (SELECT d, term, count(*) * any_value(idf) AS w FROM grams JOIN vocab USING (term) GROUP BY d, term), scaled AS (SELECT d, term, w / sqrt(sum(w * w) OVER (PARTITION BY d)) AS w FROM w),
    p AS (SELECT a.d AS a, b.d AS b, sum(a.w * b.w) AS dot FROM scaled a JOIN scaled b USING (term) GROUP BY a.d, b.d) SELECT (SELECT count(DISTINCT d) FROM scaled) AS texts, round(sum(CASE WHEN a = b THEN dot END), 6) AS squares, round(sum(dot * dot), 6) AS fourth_powers FROM p"""))
def svd_energy(spark, sf_dir):
    """All singular values: their squares add up to the trace of the texts' products, their fourth powers to the sum of squared products."""
    df = read(spark, sf_dir, "benchmark")
    n = df.count()
    vocab = text_features.vocabulary(df, "text", n)
    weights = text_features.tfidf(df, "item_id", "text", vocab)
    k = vocab.count()
    parts = text_features.project(weights, text_features.fit_svd(weights, vocab, k), k)
    values = parts.select("key", F.posexplode("svd").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x") * F.col("x")).alias("s"))
    return values.agg(F.round(F.sum("s"), 6).alias("squares"), F.round(F.sum(F.col("s") * F.col("s")), 6).alias("fourth_powers")).select(F.lit(parts.count()).alias("texts"), "squares", "fourth_powers")


@query(q(f"""WITH {_GRAMS}, w AS (SELECT d, term, count(*) * any_value(idf) AS w FROM grams JOIN vocab USING (term) GROUP BY d, term)
    SELECT d AS key, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY d)), 6) AS weight FROM w"""))
def tfidf_terms(spark, sf_dir):
    df, vocab = _vocabulary(spark, sf_dir)
    return text_features.tfidf(df, "item_id", "text", vocab).withColumn("weight", F.round("weight", 6))


# ---- types, roles, descriptions ----


@query(q("""SELECT event_type AS value, count(*) AS rows, lower(trim(event_type)) IN ('view', 'click', 'purchase') AS official FROM events GROUP BY event_type"""))
def described_blocks(spark, sf_dir):
    spec = description.metric_spec("Scoring categories: `view`, `click`, `purchase`. Categories are nested and never sum across them.")
    events = read(spark, sf_dir, "events").select("event_type", "value")
    spec, _ = description.resolve_block_column(spec, events, None)
    official = metrics.block_key(spec.block_column).isin(metrics.clean_blocks(spec.block_values))
    return events.groupBy(F.col(spec.block_column).alias("value")).agg(F.count("*").alias("rows"), F.first(official).alias("official"))


# ---- order, sets, folds ----


@query(q("""SELECT o_orderkey, (('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT % 5)::INT AS fold FROM orders"""))
def kfold_assign(spark, sf_dir):
    return ordering.with_folds(read(spark, sf_dir, "orders").select("o_orderkey"), 5, "o_orderkey")


@query(q("""SELECT l_returnflag, l_orderkey, l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice, l_orderkey, l_partkey) AS rn FROM lineitem) WHERE rn = 1"""))
def best_per_group(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_partkey", "l_extendedprice")
    return ordering.best_per_group(df, "l_returnflag", "l_extendedprice", ["l_orderkey", "l_partkey"])


@query(q("""SELECT c_custkey, c_nationkey, c_acctbal, NULL::BIGINT AS s_suppkey FROM customer UNION ALL SELECT NULL, s_nationkey, s_acctbal, s_suppkey FROM supplier"""))
def union_pad(spark, sf_dir):
    a = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    b = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("c_nationkey"), F.col("s_acctbal").alias("c_acctbal"), "s_suppkey")
    return ordering.union_pad(a, b)


# ---- models ----

_FOLD = "(('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT % 3)"


@query(q(f"""WITH f AS (SELECT {_FOLD} AS fold, o_totalprice AS y FROM orders), m AS (SELECT k.fold, median(f.y) AS m FROM (SELECT DISTINCT fold FROM f) k JOIN f ON f.fold <> k.fold GROUP BY k.fold),
    s AS (SELECT avg(abs(y - m)) AS mae FROM f JOIN m USING (fold) GROUP BY fold) SELECT 'dummy_median' AS model, 3 AS cv_folds, round(avg(mae), 6) AS score_mean, round(stddev_pop(mae), 6) AS score_std FROM s"""))
def cv_dummy_median(spark, sf_dir):
    df = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    task = models.Task(df, "o_totalprice", [], [], key="o_orderkey")
    r = models.cross_validate(task, next(c for c in models.registry() if c.family == "dummy"), df.count())
    return spark.createDataFrame([(r.model, r.cv_folds, round(r.score_mean, 6), round(r.score_std, 6))], "model string, cv_folds int, score_mean double, score_std double")


@query(q("""WITH t AS (SELECT * FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_orderpriority, median(o_totalprice) AS m FROM t GROUP BY 1), a AS (SELECT median(o_totalprice) AS m FROM t)
    SELECT o_orderkey, o_orderpriority, coalesce(b.m, a.m) AS prediction FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'new' ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 2 = 1) o
    LEFT JOIN b USING (o_orderpriority), a"""))
def block_median_predict(spark, sf_dir):
    df = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    new = df.where("o_orderkey % 2 = 1").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "new").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))
    return models.fallback_predictions(df.where("o_orderkey % 2 = 0"), "o_totalprice", new, "o_orderpriority")


@query(q("""SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 5.0 ELSE greatest(0, c_acctbal) END AS prediction FROM customer"""))
def clip_and_repair(spark, sf_dir):
    p = F.when(F.col("c_custkey") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal"))
    return models.repair(read(spark, sf_dir, "customer").select("c_custkey", p.alias("prediction")), 5.0, not_negative=True)


@query(q("""WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, regr_sxx(l_extendedprice, l_quantity) AS sxx, avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, round(my + b * sxx / (sxx + 1) * (l_quantity - mx), 3) AS prediction FROM lineitem, m"""))
def ridge_fit_predict(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    fitted = models.fit(next(c for c in models.registry() if c.name == "ridge_alpha1"), df, "l_extendedprice", ["l_quantity"], [])
    return fitted.transform(df).select("l_orderkey", "l_linenumber", "l_partkey", F.round("prediction", 3).alias("prediction"))


# ---- validation ----


def _submission(spark, sf_dir) -> DataFrame:
    df = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("string").alias("p"))
    bad = F.when(F.col("o_orderkey") % 11 == 0, "oops").when(F.col("o_orderkey") % 13 == 0, "inf").when(F.col("o_orderkey") % 17 == 0, "NaN").otherwise(F.col("p"))
    out = df.where("o_orderkey % 7 <> 0").select(F.when(F.col("o_orderkey") % 19 != 0, F.col("o_orderkey")).alias("o_orderkey"), bad.alias("p"))
    return out.unionByName(df.where("o_orderkey < 10").select((-F.col("o_orderkey")).alias("o_orderkey"), "p"))


_SUBMISSION = """s AS (SELECT CASE WHEN o_orderkey % 19 <> 0 THEN o_orderkey END AS o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'oops' WHEN o_orderkey % 13 = 0 THEN 'inf' WHEN o_orderkey % 17 = 0 THEN 'NaN' ELSE 'x' END AS p
    FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT -o_orderkey, 'x' FROM orders WHERE o_orderkey < 10)"""


@query(q(f"WITH {_SUBMISSION} SELECT count(*) AS rows, count(*) - count(o_orderkey) AS null_ids, count(*) - (SELECT count(*) FROM (SELECT DISTINCT o_orderkey FROM s)) AS duplicate_ids FROM s"))
def validate_ids(spark, sf_dir):
    return validate.id_facts(_submission(spark, sf_dir), "o_orderkey")


@query(q(f"WITH {_SUBMISSION} SELECT count(*) FILTER (p IN ('oops', 'NaN')) AS not_numeric, count(*) FILTER (p = 'inf') AS infinite FROM s"))
def validate_predictions(spark, sf_dir):
    return validate.prediction_facts(_submission(spark, sf_dir), "p")


@query(q(f"WITH {_SUBMISSION} SELECT o_orderkey::VARCHAR AS o_orderkey FROM (SELECT DISTINCT o_orderkey FROM orders) o WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.o_orderkey = o.o_orderkey)"))
def validate_missing_ids(spark, sf_dir):
    return validate.id_difference(read(spark, sf_dir, "orders"), _submission(spark, sf_dir), "o_orderkey")


@query(q(f"WITH {_SUBMISSION} SELECT o_orderkey::VARCHAR AS o_orderkey FROM (SELECT DISTINCT o_orderkey FROM s) o WHERE NOT EXISTS (SELECT 1 FROM orders s WHERE s.o_orderkey IS NOT DISTINCT FROM o.o_orderkey)"))
def validate_extra_ids(spark, sf_dir):
    return validate.id_difference(_submission(spark, sf_dir), read(spark, sf_dir, "orders"), "o_orderkey")


@query(q("""WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS place FROM customer), b AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS place FROM customer)
    SELECT count(*) FILTER (a.c_custkey <> b.c_custkey) AS mismatches FROM a JOIN b USING (place)"""))
def validate_row_order(spark, sf_dir):
    df = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    cents = F.round(F.col("c_acctbal") * 100).cast("long")
    by_balance = df.withColumn(ordering.ORD, cents * 1_000_000_000 + F.col("c_custkey"))
    return validate.order_mismatches(df.withColumn(ordering.ORD, F.col("c_custkey")), by_balance, "c_custkey")


@query(q("SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '_', 'g'), '_') AS norm, regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') AS squashed, round(log(1 + greatest(c_acctbal, 0)) / log(exp(1)), 6) AS log_balance FROM customer"))
def scalar_functions(spark, sf_dir):
    df = read(spark, sf_dir, "customer")
    return df.select("c_custkey", scalar.normalized("c_name").alias("norm"), scalar.squashed("c_name").alias("squashed"), F.round(F.log1p(F.greatest("c_acctbal", F.lit(0.0))), 6).alias("log_balance"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.Q)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
