"""Queries for what is inferred from tables (types, roles, keys, metrics), chosen among models, validated and displayed, and
the SQL that gives the same rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions import metrics, scalar
from tabloom.functions.metrics import MetricSpec
from tabloom.operators import encoders, joins, ordering, profile, text_features
from tabloom.operators import types as kinds
from tabloom.plans import description, eda, models, report, schema, validate
from tabloom.registry import q, query, read, union
from tabloom.sources import files, images

# ---- types and roles ----

_NUMERIC = "('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT', 'HUGEINT', 'FLOAT', 'DOUBLE', 'BOOLEAN')"


def _facts(table: str, columns: list[str], source: str | None = None) -> str:
    """SQL: a row of facts for each column, in the order given."""
    return union([f"""SELECT {i} AS place, '{c}' AS name, count(*) AS n, count(v) AS present, count(DISTINCT v) AS u, any_value(typeof(v)) IN {_NUMERIC} AS numeric, any_value(typeof(v)) IN ('INTEGER', 'BIGINT') AS whole,
        any_value(typeof(v)) IN ('DATE', 'TIMESTAMP') AS time, coalesce(avg(length(v::VARCHAR)), 0) AS mean_len, coalesce(max(length(v::VARCHAR)), 0) AS max_len,
        coalesce(avg(regexp_matches(v::VARCHAR, '[A-Za-z]')::INT), 0) AS letters, coalesce(avg(regexp_matches(v::VARCHAR, '\\s')::INT), 0) AS spaces, coalesce(avg((try_strptime(v::VARCHAR, '%Y-%m-%d') IS NOT NULL)::INT), 0) AS parsed
        FROM (SELECT {c} AS v FROM {source or table})""" for i, c in enumerate(columns)])


_DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]
_TASK = "(SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS seldom, NULL::VARCHAR AS nothing FROM orders)"
_TASK_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "day", "seldom"]


def _task(spark, sf_dir) -> DataFrame:
    df = read(spark, sf_dir, "orders")
    extra = [F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("seldom")]
    return df.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", *extra)


@query(q(f"""SELECT name AS "column", CASE WHEN regexp_matches(name, '(^|_)id$|^uuid$|^index$') OR (u / n > 0.95 AND u > 20) THEN 'id_like' WHEN numeric THEN 'numeric' WHEN time OR parsed > 0.7 THEN 'datetime'
    WHEN mean_len >= 40 OR max_len >= 120 OR (mean_len >= 25 AND letters > 0.5 AND spaces > 0.2) THEN 'text' ELSE 'categorical' END AS class FROM ({_facts('orders', _TASK_COLUMNS, _TASK)} UNION ALL {_facts('documents', _DOCUMENTS)})"""))
def feature_column_types(spark, sf_dir):
    rows = [(c, k) for df in (_task(spark, sf_dir), read(spark, sf_dir, "documents").select(*_DOCUMENTS)) for k, v in kinds.feature_types(df).items() for c in v]
    return spark.createDataFrame(rows, "column string, class string")


_PROFILED = """SELECT CASE WHEN numeric THEN 'numeric' WHEN time OR parsed > 0.7 THEN 'datetime_like' WHEN mean_len >= 50 OR max_len >= 200 THEN 'text' ELSE 'categorical' END || '_columns' AS class, name AS "column" FROM f
    UNION ALL SELECT 'id_like_columns', name FROM f WHERE contains(name, 'id') OR contains(name, 'key') OR u / n > 0.9"""


@query(q(f"WITH f AS ({_facts('documents', _DOCUMENTS)} UNION ALL {_facts('orders', _TASK_COLUMNS, _TASK)}) {_PROFILED}"))
def column_types_profile(spark, sf_dir):
    rows = [(k, c) for df in (read(spark, sf_dir, "documents").select(*_DOCUMENTS), _task(spark, sf_dir)) for k, v in kinds.profile_types(df).items() for c in v]
    return spark.createDataFrame(rows, "class string, column string")


def _type_counts(table: str, facts: str) -> str:
    return f"""SELECT '{table}' AS "table", any_value(n) AS rows, count(*) AS columns, count(*) FILTER (numeric) AS numeric_columns, count(*) FILTER (NOT numeric AND NOT time AND parsed <= 0.7 AND NOT texty) AS categorical_columns,
        count(*) FILTER (NOT numeric AND NOT time AND parsed <= 0.7 AND texty) AS text_columns, count(*) FILTER (NOT numeric AND (time OR parsed > 0.7)) AS datetime_like_columns, count(*) FILTER (present = 0) AS all_missing_columns,
        count(*) FILTER (present < 0.5 * n) AS high_missing_columns, count(*) FILTER (u / n > 0.95 AND u > 20) AS high_cardinality_columns
        FROM (SELECT *, present > 0 AND (mean_len >= 40 OR (mean_len >= 25 AND letters > 0.5 AND spaces > 0.2)) AS texty FROM ({facts}))"""


@query(q(union([_type_counts("documents", _facts("documents", _DOCUMENTS)), _type_counts("orders", _facts("orders", [*_TASK_COLUMNS, "nothing"], _TASK))])))
def type_counts(spark, sf_dir):
    tables = {"documents": read(spark, sf_dir, "documents").select(*_DOCUMENTS), "orders": _task(spark, sf_dir).withColumn("nothing", F.lit(None).cast("string"))}
    rows = [kinds.type_counts(df, t) for t, df in tables.items()]
    return spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"`{k}` {'string' if k == 'table' else 'long'}" for k in rows[0]))


_HEADS = {"customer": ("c_custkey", ["c_name", "c_custkey", "c_nationkey"]), "lineitem": ("l_orderkey", ["l_returnflag", "l_linenumber", "l_orderkey"]), "labels": ("doc_id", ["quality", "doc_id"])}


@query(q(union([f"""SELECT '{t}' AS "table", coalesce((SELECT name FROM (SELECT * FROM ({_facts(t, cs, f"(SELECT * FROM {t} ORDER BY {o}, {", ".join(cs)} LIMIT 200)")})) WHERE whole AND u = n AND present = n ORDER BY place LIMIT 1), '{cs[0]}') AS "column" """ for t, (o, cs) in _HEADS.items()])))
def row_id_inference(spark, sf_dir):
    rows = []
    for t, (o, cs) in _HEADS.items():
        df = read(spark, sf_dir, t)
        df = df.withColumn(ordering.ORD, F.struct(o, *cs)).select(*cs, ordering.ORD)
        rows.append((t, kinds.row_id_column(df, cs)))
    return spark.createDataFrame(rows, "table string, column string")


_FLAT = "(SELECT c_custkey AS row_id, c_name AS note, CASE WHEN c_custkey % 10 = 0 THEN 'x' ELSE (c_custkey % 2)::VARCHAR END AS filled, (c_custkey % 5)::VARCHAR AS many FROM customer)"
_SHARES = union([f"SELECT {i} AS place, '{c}' AS name, avg((TRY_CAST({c} AS DOUBLE) IS NOT NULL)::INT) >= 0.8 AND count(DISTINCT TRY_CAST({c} AS DOUBLE)) <= 2 AS flat FROM {_FLAT}" for i, c in enumerate(("note", "filled", "many"))])


@query(q(f"""SELECT 'placeholder ' || name AS item, flat::VARCHAR AS found FROM ({_SHARES}) UNION ALL SELECT 'target', (SELECT name FROM ({_SHARES}) WHERE flat ORDER BY place DESC LIMIT 1)
    UNION ALL SELECT 'training target of ' || t, coalesce((SELECT column_name FROM ({{described}}) d WHERE d.t = x.t AND column_name IN ('target', 'label', 'y', 'response', 'outcome', 'value', 'rate', 'score')
        ORDER BY list_position(['target', 'label', 'y', 'response', 'outcome', 'value', 'rate', 'score'], column_name) LIMIT 1),
        (SELECT column_name FROM ({{described}}) d WHERE d.t = x.t AND column_type IN {_NUMERIC} ORDER BY place DESC LIMIT 1)) FROM (SELECT unnest(['events', 'labels', 'customer']) AS t) x
    UNION ALL SELECT 'submission columns', 'row_id, ' || (SELECT name FROM ({_SHARES}) WHERE flat ORDER BY place DESC LIMIT 1)""").replace("{described}", union([f"SELECT '{t}' AS t, row_number() OVER () AS place, column_name, column_type FROM (DESCRIBE {t})" for t in ("events", "labels", "customer")])))
def target_inference(spark, sf_dir):
    c = F.col("c_custkey")
    flat = read(spark, sf_dir, "customer").select(c.alias("row_id"), F.col("c_name").alias("note"), F.when(c % 10 == 0, "x").otherwise((c % 2).cast("string")).alias("filled"), (c % 5).cast("string").alias("many"))
    found = kinds.target_column(None, flat, "row_id")
    rows = [(f"placeholder {n}", str(kinds.is_placeholder(flat, n)).lower()) for n in ("note", "filled", "many")] + [("target", found)]
    rows += [(f"training target of {t}", kinds.training_target(read(spark, sf_dir, t), None, None)) for t in ("events", "labels", "customer")]
    rows.append(("submission columns", ", ".join(kinds.submission_columns(flat, "row_id", found))))
    return spark.createDataFrame(rows, "item string, found string")


_FILES = {"documents": "train/documents.csv", "labels": "train/labels_target.csv", "events": "val/event_features.csv", "conversations": "sample_submission.csv", "nation": "other/nation.csv", "pages": "x_pages.csv"}


def _name_points(words: tuple[str, ...]) -> str:
    return f"list_sum([CASE WHEN list_contains(names, w) THEN 2.0 WHEN len([x FOR x IN names IF contains(x, w)]) > 0 THEN 1.0 ELSE 0.0 END FOR w IN {list(words)}])"


def _contains(where: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({where}, '{w}')" for w in words) + ")"


@query(q(f"""WITH f AS ({union([f"SELECT '{p}' AS path, list(lower(column_name)) AS names, count(*) FILTER (column_type IN {_NUMERIC}) AS numbers FROM (DESCRIBE {t})" for t, p in _FILES.items()])}),
    e AS (SELECT *, split_part(path, '/', -1) AS file, {_contains('path', schema.TRAIN_WORDS)} AS train, {_contains('path', schema.HELD_OUT_WORDS)} AS held, {_contains('path', schema.HELD_OUT_FEATURES)} AS heldf,
        {_name_points(schema.TARGET_WORDS)} AS target, {_name_points(schema.FEATURE_WORDS)} AS feature FROM f),
    s AS (SELECT *, {_contains('file', ('covariate', 'feature', 'x_'))}::INT AS ff FROM e),
    p AS (SELECT path, 5.0 * contains(file, 'submission')::INT + 2 * list_contains(names, 'row_id')::INT + 0.5 * (len(names) >= 2 AND contains(array_to_string(names, ' '), 'id'))::INT AS sample,
        1.5 * train::INT + target + 4 * {_contains('file', ('target', 'label', 'train_y'))}::INT + (train AND len(names) <= 8 AND numbers >= 1)::INT AS tt,
        1.5 * train::INT + feature + CASE WHEN heldf THEN 0 WHEN train THEN 4 ELSE 1 END * ff AS tf, 3.0 * held::INT + feature + CASE WHEN heldf THEN 4 WHEN train THEN 0 ELSE 1 END * ff AS vf FROM s),
    w AS (SELECT path, sample, CASE WHEN sample >= 5 THEN 0.2 ELSE 1 END AS k, tt, tf, vf FROM p),
    r AS (SELECT path, unnest(['sample_submission', 'train_target', 'train_features', 'validation_features', 'unknown']) AS role, unnest([sample, k * tt, k * tf, k * vf, 0.1]) AS score, unnest([1, 2, 3, 4, 5]) AS place FROM w)
    SELECT path, role, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, place) AS rn FROM r) WHERE rn = 1"""))
def file_roles(spark, sf_dir):
    rows = []
    for t, p in _FILES.items():
        df = read(spark, sf_dir, t)
        role, points, _ = schema.file_role(p, df.columns, len(profile.numeric_columns(df)))
        rows.append((p, role, round(points, 6)))
    return spark.createDataFrame(rows, "path string, role string, score double")


# ---- descriptions ----


@query(q("""SELECT c_custkey, 'id_' || c_nationkey || ', day_' || c_custkey AS keys, CASE WHEN c_custkey % 2 = 0 THEN 'group_' || c_custkey END AS block_column, lower(c_mktsegment) || ', rest' AS blocks,
    CASE WHEN c_custkey % 2 = 0 THEN 'block_averaged' ELSE 'global' END AS mode FROM customer"""))
def described_tasks(spark, sf_dir):
    """What descriptions say that are written from the customers' columns, one in two of them about blocks; read where the rows are."""
    even = F.format_string("Block column: group_%d\nScoring categories: %s, rest. Categories are nested.\n", "c_custkey", F.lower("c_mktsegment"))
    odd = F.format_string("{%s, rest} are segments.\n", F.lower("c_mktsegment"))
    head = F.format_string("Rows are described below.\nMerge on `id %d` and `day_%d`.\n", "c_nationkey", "c_custkey")
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment").repartition(4 * spark.sparkContext.defaultParallelism, "c_custkey")  # a file has few splits, and reading a text takes far longer than a row
    texts = rows.select("c_custkey", F.concat(head, F.when(F.col("c_custkey") % 2 == 0, even).otherwise(odd)).alias("text"))

    def run(batches):
        for b in batches:
            said = [(", ".join(description.join_keys(t)), description.block_column(t), ", ".join(description.block_values(t)), description.metric_spec(t).mode) for t in b["text"]]
            yield pd.DataFrame(said, columns=["keys", "block_column", "blocks", "mode"]).assign(c_custkey=b["c_custkey"].to_numpy())

    return texts.mapInPandas(run, f"keys string, block_column string, blocks string, mode string, c_custkey {dict(texts.dtypes)['c_custkey']}")


# ---- keys ----

_HINTS = list(joins.KEY_HINTS)
_KEY_RIGHT = "(SELECT o_orderkey AS order_id, o_orderpriority AS \"group\", nullif(o_orderstatus, 'P') AS o_orderstatus, CASE WHEN o_orderkey % 8 > 0 THEN o_orderdate END AS o_orderdate FROM orders WHERE o_orderkey % 10 <> 0)"
_KEY_LEFT = "(SELECT o_orderkey AS order_id, o_orderpriority AS \"group\", o_orderstatus, o_totalprice FROM orders)"
_KEY_SETS = [("group",), ("order_id",), ("o_orderstatus",), ("group", "order_id"), ("group", "o_orderstatus"), ("order_id", "o_orderstatus"), ("group", "order_id", "o_orderstatus")]


def _key_score(keys: tuple[str, ...]) -> str:
    names = ", ".join(f'"{k}"' for k in keys)
    same = " AND ".join(f'l."{k}" IS NOT DISTINCT FROM r."{k}"' for k in keys)
    hints = " + ".join(f"list_sum([CASE WHEN '{k}' = h OR starts_with('{k}', h || '_') OR ends_with('{k}', '_' || h) THEN 2.0 WHEN contains('{k}', h) THEN 1.0 ELSE 0.0 END FOR h IN {_HINTS}])" for k in keys)
    return f"""SELECT '{'+'.join(keys)}' AS keys, {len(keys)} AS size, CASE WHEN missing > 0.3 THEN -1.0 WHEN rate < 0.75 THEN -100 + 50 * rate ELSE 100 * rate - 60 * (1 - d / n) - 10 * (d < n)::INT + {hints} END AS score,
        1 - d / n AS duplicates, rate FROM (SELECT count(*) AS n, greatest({', '.join(f'avg(("{k}" IS NULL)::INT)' for k in keys)}) AS missing FROM {_KEY_RIGHT}), (SELECT count(*) AS d FROM (SELECT DISTINCT {names} FROM {_KEY_RIGHT})),
        (SELECT avg((r.has IS TRUE)::INT) AS rate FROM {_KEY_LEFT} l LEFT JOIN (SELECT {names}, o_orderdate IS NOT NULL AS has FROM (SELECT *, row_number() OVER (PARTITION BY {names} ORDER BY order_id) AS rn FROM {_KEY_RIGHT}) WHERE rn = 1) r ON {same})"""


def _key_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    df = read(spark, sf_dir, "orders")
    base = [F.col("o_orderkey").alias("order_id"), F.col("o_orderpriority").alias("group")]
    right = df.where("o_orderkey % 10 <> 0").select(*base, F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"), F.when(F.col("o_orderkey") % 8 > 0, F.col("o_orderdate")).alias("o_orderdate"), F.col("o_orderkey").alias(ordering.ORD))
    return df.select(*base, "o_orderstatus", "o_totalprice"), right


_SCORES = union([q(_key_score(k)) for k in _KEY_SETS])


@query(f"SELECT keys, round(score, 6) AS score FROM ({_SCORES})")
def join_key_scores(spark, sf_dir):
    left, right = _key_tables(spark, sf_dir)
    sets = joins.key_candidates(left, right)
    search = joins.KeySearch(left, right, True, sets)
    return spark.createDataFrame([("+".join(k), round(search.score(k), 6)) for k in sets], "keys string, score double")


@query(q(f"""WITH s AS ({_SCORES}), best AS (SELECT * FROM s WHERE score > 20 ORDER BY score DESC, size LIMIT 1)
    SELECT 'best' AS "case", (SELECT keys FROM best) AS keys, (SELECT round(duplicates, 9) FROM best) AS right_duplicate_rate, (SELECT round(rate, 9) FROM best) AS feature_match_rate
    UNION ALL SELECT 'preferred', CASE WHEN score > 20 THEN keys ELSE (SELECT keys FROM best) END, round(CASE WHEN score > 20 THEN duplicates ELSE (SELECT duplicates FROM best) END, 9), round(CASE WHEN score > 20 THEN rate ELSE (SELECT rate FROM best) END, 9) FROM s WHERE keys = 'group+order_id'
    UNION ALL SELECT 'described', CASE WHEN score > 20 THEN keys ELSE (SELECT keys FROM best) END, round(CASE WHEN score > 20 THEN duplicates ELSE (SELECT duplicates FROM best) END, 9), round(CASE WHEN score > 20 THEN rate ELSE (SELECT rate FROM best) END, 9) FROM s WHERE keys = 'o_orderstatus'"""))
def inferred_keys(spark, sf_dir):
    left, right = _key_tables(spark, sf_dir)
    rows = []
    for case, said, preferred in (("best", None, None), ("preferred", None, ["group", "order_id"]), ("described", ["o_orderstatus"], None)):
        keys, _, f = joins.infer_keys(left, right, [], said, preferred, True)
        rows.append((case, "+".join(keys or []), round(f.right_duplicate_rate, 9), round(f.feature_match_rate, 9)))
    return spark.createDataFrame(rows, "case string, keys string, right_duplicate_rate double, feature_match_rate double")


@query(q("""WITH l AS (SELECT l_orderkey AS entity_id, l_linenumber AS time_key, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_extendedprice) AS rn FROM lineitem),
    u AS (SELECT entity_id, time_key FROM l WHERE rn = 1)
    SELECT 'train' AS part, 'entity_id+time_key' AS keys, count(*) FILTER (entity_id % 3 <> 0) AS left_rows, count(*) FILTER (entity_id % 3 <> 0) AS right_rows, count(*) FILTER (entity_id % 3 <> 0) AS merged_rows FROM u
    UNION ALL SELECT 'predict', 'entity_id+time_key', count(*) FILTER (entity_id % 3 = 0), count(*) FILTER (entity_id % 3 = 0), count(*) FILTER (entity_id % 3 = 0) FROM u
    UNION ALL SELECT 'shared', 'entity_id+time_key', (SELECT count(*) FROM u), (SELECT count(DISTINCT entity_id) FROM u), (SELECT count(DISTINCT time_key) FROM u)"""))
def pipeline_keys(spark, sf_dir):
    """Keys of the two merges of a task that is cut from the line items, with the rows of both sides and of the merge."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("entity_id"), F.col("l_linenumber").alias("time_key"), "l_quantity", "l_partkey", "l_extendedprice")
    one = ordering.keep_first(lines, ["entity_id", "time_key"], ["l_partkey", "l_extendedprice"]).drop("l_partkey").cache()  # a shuffle of all lines, which every count below would repeat
    train, later = one.where("entity_id % 3 <> 0"), one.where("entity_id % 3 = 0")
    tables = [train.select("entity_id", "time_key", F.col("l_extendedprice").alias("y")), train.select("entity_id", "time_key", "l_quantity"), later.select("entity_id", "time_key", F.lit(0.0).alias("y")), later.select("entity_id", "time_key", "l_quantity")]
    got = joins.infer_pipeline_keys(*tables, exclude=["y"], described=None)
    rows = [(part, "+".join(keys), m["left_rows"], m["right_rows"], m["merged_rows"]) for part, keys, m in (("train", got.train_keys, got.train_merge_metadata), ("predict", got.predict_keys, got.predict_merge_metadata))]
    shared = joins.shared_columns(tables[0], tables[1])
    sizes = one.agg(F.count("*"), F.count_distinct("entity_id"), F.count_distinct("time_key")).first()
    one.unpersist()
    return spark.createDataFrame([*rows, ("shared", "+".join(shared), *sizes)], "part string, keys string, left_rows long, right_rows long, merged_rows long")


# ---- metrics, models ----


@query(q("""WITH p AS (SELECT event_type, value, (SELECT median(value) FROM events) AS pred FROM events), b AS (SELECT avg(m) AS m FROM (SELECT avg(abs(value - pred)) AS m FROM p WHERE event_type IN ('view', 'click') GROUP BY event_type))
    SELECT 'global' AS mode, avg(abs(value - pred)) AS score, avg(abs(value - pred)) AS mae, avg(abs(value - pred)) AS global_mae, NULL::DOUBLE AS block_mae FROM p UNION ALL SELECT 'block_averaged', b.m, b.m, (SELECT avg(abs(value - pred)) FROM p), b.m FROM b"""))
def score_dispatch(spark, sf_dir):
    df = read(spark, sf_dir, "events").select("event_type", "value")
    df = df.join(F.broadcast(df.agg(F.median("value").alias("pred"))))  # one row
    rows = []
    for spec in (MetricSpec(), MetricSpec(mode="block_averaged", block_column="event_type", block_values=("view", "Click"))):
        got = metrics.score(df, "value", "pred", spec)
        rows.append((got["metric_mode"], got["score"], got["mae"], got["global_mae"], got["block_mae"]))
    return spark.createDataFrame(rows, "mode string, score double, mae double, global_mae double, block_mae double")


_FOLD = "(('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT % 3)"
_ALPHAS = (0.1, 1, 10)
_LINE_CV = f"""f AS (SELECT {_FOLD.replace('o_orderkey', 'l_orderkey')} AS fold, l_extendedprice AS y, l_quantity AS x FROM lineitem), k AS (SELECT DISTINCT fold FROM f),
    m AS (SELECT k.fold, median(f.y) AS med, regr_slope(f.y, f.x) AS b, regr_sxx(f.y, f.x) AS sxx, avg(f.x) AS mx, avg(f.y) AS my FROM k JOIN f ON f.fold <> k.fold GROUP BY k.fold),
    s AS (SELECT 'dummy_median' AS model, 'dummy' AS family, fold, avg(abs(y - med)) AS mae FROM f JOIN m USING (fold) GROUP BY fold
        {''.join(f" UNION ALL SELECT 'ridge_alpha{a}', 'ridge', fold, avg(abs(y - my - b * sxx / (sxx + {a}) * (x - mx))) FROM f JOIN m USING (fold) GROUP BY fold" for a in _ALPHAS)}),
    t AS (SELECT model, family, count(*)::INT AS cv_folds, avg(mae) AS score_mean, stddev_pop(mae) AS score_std FROM s GROUP BY model, family)"""
_NAMES = ("dummy_median", *[f"ridge_alpha{a}" for a in _ALPHAS])


def _selection(spark, sf_dir) -> models.Selection:
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice")
    task = models.Task(df, "l_extendedprice", ["l_quantity"], [], key="l_orderkey")
    pool = [c for c in models.registry() if c.name in _NAMES]
    return models.choose(task, df.count(), candidates=pool, seconds=3600)


def _rounded(df: DataFrame, *names: str, digits: int = 3) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in names})


@query(q(f"""WITH {_LINE_CV} SELECT 'global' AS strategy, model, cv_folds, round(score_mean, 3) AS score_mean, round(score_std, 3) AS score_std, 'ok' AS status, model = (SELECT arg_min(model, (score_mean, model)) FROM t) AS is_selected, family AS model_family FROM t
    UNION ALL SELECT 'global', 'global', 0, round(min(score_mean), 3), NULL, 'strategy_summary', true, '' FROM t"""))
def model_selection(spark, sf_dir):
    got = models.cv_frame(spark, _selection(spark, sf_dir).rows)
    return _rounded(got, "score_mean", "score_std").select("strategy", "model", "cv_folds", "score_mean", "score_std", "status", "is_selected", "model_family")


@query(q(f"""WITH {_LINE_CV} SELECT model, family AS model_family, round(score_mean, 3) AS score_mean, round(score_std, 3) AS score_std, round(score_mean, 3) AS mae_mean, model = (SELECT arg_min(model, (score_mean, model)) FROM t) AS is_selected
    FROM t ORDER BY score_mean, model LIMIT 8"""))
def cv_report(spark, sf_dir):
    """In the order of the scores shown: of equal ones the model's name comes next, not what the rounding hides."""
    return report.global_comparison(_rounded(models.cv_frame(spark, _selection(spark, sf_dir).rows), "score_mean", "score_std", "mae_mean"))


@query(q(f"WITH {_LINE_CV} SELECT 'global' AS strategy, round(min(score_mean), 3) AS strategy_score, true AS is_selected FROM t"))
def strategy_report(spark, sf_dir):
    return _rounded(report.strategy_comparison(models.cv_frame(spark, _selection(spark, sf_dir).rows)), "strategy_score")


def _suppliers(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_acctbal", "n_name")


def _nation_task(spark, sf_dir) -> models.Task:
    return models.Task(_suppliers(spark, sf_dir), "s_acctbal", [], [], MetricSpec(mode="block_averaged", block_column="n_name"), block="n_name", key="s_suppkey")


_DUMMY = [c for c in models.registry() if c.family == "dummy"]
_BY_NATION = "(SELECT s_suppkey, s_acctbal AS y, lower(trim(n_name)) AS b FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
_FOLDS = "CASE WHEN n >= 1000 THEN 3 WHEN n >= 50 THEN 5 ELSE 3 END"


@query(q(f"""WITH b AS (SELECT b, median(y) AS m, count(*) AS n FROM {_BY_NATION} GROUP BY b), f AS (SELECT b, y, n, {_FOLD.replace('o_orderkey', 's_suppkey').replace('% 3', f'% {_FOLDS}')} AS fold FROM {_BY_NATION} JOIN b USING (b) WHERE n >= 20),
    k AS (SELECT DISTINCT b, fold FROM f), m AS (SELECT k.b, k.fold, median(f.y) AS med FROM k JOIN f ON f.b = k.b AND f.fold <> k.fold GROUP BY k.b, k.fold), e AS (SELECT b, fold, avg(abs(y - med)) AS mae FROM f JOIN m USING (b, fold) GROUP BY b, fold)
    SELECT b AS block, round(avg(abs(y - m)), 6) AS score_mean, 'fallback_insufficient_rows' AS status, any_value(n) || ' rows' AS notes FROM {_BY_NATION} JOIN b USING (b) WHERE n < 20 GROUP BY b UNION ALL SELECT b, round(avg(mae), 6), 'ok', '' FROM e GROUP BY b"""))
def block_fallbacks(spark, sf_dir):
    """Blocks too small for models: their medians, scored on the rows that they come from. Larger ones: the median's cross-validated score."""
    _, _, rows = models.search_per_block(_nation_task(spark, sf_dir), models.Clock(3600), candidates=_DUMMY)
    return _rounded(models.cv_frame(spark, rows), "score_mean", digits=6).select("block", "score_mean", "status", "notes")


@query(q(f"""WITH b AS (SELECT b, median(y) AS m FROM {_BY_NATION} GROUP BY b), g AS (SELECT median(y) AS m FROM {_BY_NATION}) SELECT s_suppkey, n_name, coalesce(b.m, g.m) AS prediction FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN 'nowhere' ELSE n_name END AS n_name
    FROM supplier JOIN nation ON s_nationkey = n_nationkey) s LEFT JOIN b ON lower(trim(s.n_name)) = b.b, g"""))
def block_predictions(spark, sf_dir):
    """The per-block strategy fitted and applied: each block's median, and that of all rows for blocks not seen."""
    task = _nation_task(spark, sf_dir)
    blocks, score, rows = models.search_per_block(task, models.Clock(3600), candidates=_DUMMY)
    fitted = models.fit_selection(task, models.Selection("per_block", score, None, blocks, rows))
    return fitted.predict(_suppliers(spark, sf_dir).select("s_suppkey", F.when(F.col("s_suppkey") % 9 == 0, "nowhere").otherwise(F.col("n_name")).alias("n_name")))


#: Lines of each day of the year, one block a day and part: 300 or so blocks with models of their own.
_DAY = "strftime(l_shipdate, '%m-%d') || l_returnflag"
_BLOCK_CV = f"""r AS (SELECT lower(trim({_DAY})) AS b, l_orderkey, l_extendedprice AS y, l_quantity AS x FROM lineitem), c AS (SELECT b, count(*) AS n FROM r GROUP BY b),
    f AS (SELECT b, y, x, {_FOLD.replace('o_orderkey', 'l_orderkey').replace('% 3', f'% {_FOLDS}')} AS fold FROM r JOIN c USING (b) WHERE n >= 20), k AS (SELECT DISTINCT b, fold FROM f),
    m AS (SELECT k.b, k.fold, median(f.y) AS med, regr_slope(f.y, f.x) AS w, regr_sxx(f.y, f.x) AS sxx, avg(f.x) AS mx, avg(f.y) AS my FROM k JOIN f ON f.b = k.b AND f.fold <> k.fold GROUP BY k.b, k.fold),
    s AS (SELECT 3 AS place, 'dummy_median' AS model, b, fold, avg(abs(y - med)) AS mae FROM f JOIN m USING (b, fold) GROUP BY b, fold
        {''.join(f" UNION ALL SELECT {i}, 'ridge_alpha{a}', b, fold, avg(abs(y - my - w * sxx / (sxx + {a}) * (x - mx))) FROM f JOIN m USING (b, fold) GROUP BY b, fold" for i, a in enumerate(_ALPHAS))}),
    t AS (SELECT b, place, model, count(*)::INT AS cv_folds, avg(mae) AS score_mean FROM s GROUP BY b, place, model), best AS (SELECT b, arg_min(model, (score_mean, place)) AS model FROM t GROUP BY b)"""


def _lines_by_day(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", F.concat(F.date_format("l_shipdate", "MM-dd"), "l_returnflag").alias("day"))
    task = models.Task(df, "l_extendedprice", ["l_quantity"], [], MetricSpec(mode="block_averaged", block_column="day"), block="day", key="l_orderkey")
    pool = [c for c in models.registry() if c.family == "ridge"] + _DUMMY
    return task, models.search_per_block(task, models.Clock(3600), candidates=pool)


@query(q(f"WITH {_BLOCK_CV} SELECT b AS block, model, cv_folds, round(score_mean, 3) AS score_mean FROM t UNION ALL SELECT b, 'median_fallback', 0, round(avg(abs(y - m)), 3) FROM r JOIN (SELECT b, median(y) AS m FROM r GROUP BY b) USING (b) JOIN c USING (b) WHERE n < 20 GROUP BY b"))
def block_models(spark, sf_dir):
    """Every block's candidates, cross-validated within it, all blocks in one plan."""
    _, (_, _, rows) = _lines_by_day(spark, sf_dir)
    return _rounded(models.cv_frame(spark, rows), "score_mean").select("block", "model", "cv_folds", "score_mean")


@query(q(f"""WITH {_BLOCK_CV}, w AS (SELECT b, median(y) AS med, regr_slope(y, x) AS w, regr_sxx(y, x) AS sxx, avg(x) AS mx, avg(y) AS my FROM r GROUP BY b)
    SELECT b AS block, count(*) AS rows, round(avg(CASE WHEN starts_with(model, 'ridge_alpha') THEN my + w * sxx / (sxx + replace(model, 'ridge_alpha', '')::DOUBLE) * (x - mx) ELSE med END), 3) AS mean_prediction,
    round(avg(abs(y - CASE WHEN starts_with(model, 'ridge_alpha') THEN my + w * sxx / (sxx + replace(model, 'ridge_alpha', '')::DOUBLE) * (x - mx) ELSE med END)), 3) AS mae FROM r JOIN w USING (b) LEFT JOIN best USING (b) GROUP BY b"""))
def block_model_predictions(spark, sf_dir):
    """The best model of every block, fitted on all its rows and applied by a join."""
    task, (blocks, score, rows) = _lines_by_day(spark, sf_dir)
    fitted = models.fit_selection(task, models.Selection("per_block", score, None, blocks, rows))
    got = fitted.predict(task.train)
    return got.groupBy(models.block_key("day").alias("block")).agg(F.count("*").alias("rows"), F.round(F.avg("prediction"), 3).alias("mean_prediction"), F.round(F.avg(F.abs(F.col("l_extendedprice") - F.col("prediction"))), 3).alias("mae"))


def _fit_facts(spark, sf_dir, name: str) -> DataFrame:
    """rows, finite predictions, the median's error, and whether the model's is under it and its predictions stay near the labels."""
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_extendedprice")
    fitted = models.fit(next(c for c in models.registry() if c.name == name), df, "l_extendedprice", ["l_quantity", "l_discount"], ["l_returnflag"])
    y, p = F.col("l_extendedprice"), F.col("prediction")
    got = fitted.transform(df).withColumn("m", F.lit(fitted.median))
    error = F.avg(F.abs(y - p))
    near = (F.min(p) >= F.min(y) - 0.1 * (F.max(y) - F.min(y))) & (F.max(p) <= F.max(y) + 0.1 * (F.max(y) - F.min(y)))
    return got.agg(F.count("*").alias("rows"), F.count(F.when(scalar.is_finite("prediction"), 1)).alias("finite"), F.round(F.avg(F.abs(y - F.col("m"))), 4).alias("median_mae"), (error < F.avg(F.abs(y - F.col("m")))).alias("better"), near.alias("near"))


#: A line in the quantity alone must be better than the median where these models are.
_FIT_FACTS = q("""WITH m AS (SELECT median(l_extendedprice) AS m, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem)
    SELECT count(*) AS rows, count(l_quantity + l_discount) AS finite, round(avg(abs(l_extendedprice - m)), 4) AS median_mae, avg(abs(l_extendedprice - a - b * l_quantity)) < avg(abs(l_extendedprice - m)) AS better,
    min(a + b * l_quantity) >= min(l_extendedprice) - 0.1 * (max(l_extendedprice) - min(l_extendedprice)) AND max(a + b * l_quantity) <= max(l_extendedprice) + 0.1 * (max(l_extendedprice) - min(l_extendedprice)) AS near FROM lineitem, m""")


@query(_FIT_FACTS)
def elastic_net_fit(spark, sf_dir):
    return _fit_facts(spark, sf_dir, "elastic_net_alpha0.01_l10.3")


@query(q("""WITH s AS (SELECT count(*) AS n, regr_sxy(l_extendedprice, l_quantity) AS sxy, regr_sxx(l_extendedprice, l_quantity) AS sxx, avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem),
    w AS (SELECT sign(sxy) * greatest(abs(sxy / n) - 0.1 * 0.5, 0) / (sxx / n + 0.1 * 0.5) AS w, mx, my FROM s) SELECT l_quantity, round(any_value(my + w * (l_quantity - mx)), 3) AS prediction, count(*) AS rows FROM lineitem, w GROUP BY l_quantity"""))
def elastic_net_line(spark, sf_dir):
    """Elastic net in one feature: the slope is the soft-thresholded covariance over the penalised variance."""
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice")
    fitted = models.fit(next(c for c in models.registry() if c.name == "elastic_net_alpha0.1_l10.5"), df, "l_extendedprice", ["l_quantity"], [], "l_orderkey")
    return fitted.transform(df).groupBy("l_quantity").agg(F.round(F.first("prediction"), 3).alias("prediction"), F.count("*").alias("rows"))


@query(_FIT_FACTS)
def extra_trees_fit(spark, sf_dir):
    return _fit_facts(spark, sf_dir, "extra_trees_depth6_leaf2_n80")


@query(q("SELECT l_returnflag, l_linestatus, count(*) AS rows, round(avg(l_extendedprice), 4) AS prediction FROM lineitem GROUP BY l_returnflag, l_linestatus"))
def extra_trees_means(spark, sf_dir):
    """On indicators alone every random cut parts values, so that deep enough trees end with the mean of each combination."""
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_extendedprice")
    fitted = models.fit(next(c for c in models.registry() if c.name == "extra_trees_depth10_leaf2_n100"), df, "l_extendedprice", [], ["l_returnflag", "l_linestatus"], "l_orderkey")
    return fitted.transform(df).groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("rows"), F.round(F.avg("prediction"), 4).alias("prediction"))


@query(_FIT_FACTS)
def forest_fit(spark, sf_dir):
    return _fit_facts(spark, sf_dir, "random_forest_depth6_leaf2_n80")


@query(_FIT_FACTS)
def boosting_fit(spark, sf_dir):
    return _fit_facts(spark, sf_dir, "gradient_boosting_n60_lr0.05_depth2")


_BAD = "CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN 'NaN'::DOUBLE WHEN c_custkey % 13 = 0 THEN 'inf'::DOUBLE ELSE c_acctbal END"


def _bad(name: str = "prediction"):
    k = F.col("c_custkey")
    return F.when(k % 10 == 0, None).when(k % 11 == 0, float("nan")).when(k % 13 == 0, float("inf")).otherwise(F.col("c_acctbal")).alias(name)


@query(q(f"""WITH p AS (SELECT {_BAD} AS p FROM customer) SELECT 'bad' AS "case", count(*) FILTER (p IS NULL OR NOT isfinite(p)) || ' predictions are not finite' AS warning FROM p
    UNION ALL SELECT 'flat', 'all predictions are equal' FROM (SELECT count(*) AS n, count(DISTINCT 1.5) AS u FROM customer) WHERE n > 1 AND u = 1 UNION ALL SELECT 'none', 'there are no predictions' FROM (SELECT count(*) AS n FROM customer WHERE c_custkey < 0) WHERE n = 0"""))
def prediction_warnings(spark, sf_dir):
    df = read(spark, sf_dir, "customer")
    cases = {"bad": df.select(_bad()), "flat": df.select(F.lit(1.5).alias("prediction")), "none": df.where("c_custkey < 0").select(_bad())}
    return spark.createDataFrame([(k, w) for k, p in cases.items() for w in models.sanity(p)], "case string, warning string")


@query(q(f"SELECT count(*) AS rows, count(*) FILTER (isfinite(p)) AS finite, count(*) FILTER (p IS NULL OR NOT isfinite(p)) AS not_finite FROM (SELECT {_BAD} AS p FROM customer)"))
def prediction_facts(spark, sf_dir):
    return report.prediction_facts(read(spark, sf_dir, "customer").select(_bad("p")), "p")


@query(q(f"""WITH w AS (SELECT c_custkey, {_BAD} AS y, c_nationkey FROM customer), t AS (SELECT * FROM w WHERE isfinite(y)) SELECT count(*) AS labelled, round(median(y), 6) AS label_median, count(DISTINCT c_nationkey) AS blocks FROM t"""))
def labelled_rows(spark, sf_dir):
    """The median model is fitted on the rows with a finite label alone."""
    df = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", _bad("y"))
    fitted = models.fit(next(c for c in models.registry() if c.family == "dummy"), df, "y", [], [])
    blocks = models.block_medians(df, "y", "c_nationkey")
    return df.where(scalar.is_finite("y")).agg(F.count("*").alias("labelled")).select("labelled", F.round(F.lit(fitted.median), 6).alias("label_median"), F.lit(len(blocks)).cast("long").alias("blocks"))


# ---- texts, dates, images ----


_PHOTOS = """i AS (SELECT '/img/' || replace(lower(c_name), '#', '-') || '_' || x || '.jpg' AS path, replace(lower(c_name), '#', '-') || '_' || x AS stem, regexp_replace(lower(c_name) || x, '[^a-z0-9]', '', 'g') AS norm
    FROM customer, (SELECT unnest(['front', 'back']) AS x) WHERE c_custkey % 3 > 0 AND (x = 'front' OR c_custkey % 5 = 0))"""


@query(q(f"""WITH {_PHOTOS}, w AS (SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS t FROM customer)
    SELECT c_custkey AS key, count(i.path) AS candidates, CASE WHEN count(i.path) = 1 THEN min(i.path) END AS path FROM w LEFT JOIN i ON contains(norm, t) OR contains(stem, t) GROUP BY c_custkey"""))
def customer_photos(spark, sf_dir):
    """Photos named after customers, whose names differ in a number alone: none, one or two of each."""
    df = read(spark, sf_dir, "customer")
    shots = df.where("c_custkey % 3 > 0").select("c_custkey", "c_name", F.explode(F.array(F.lit("front"), F.lit("back"))).alias("x")).where("x = 'front' OR c_custkey % 5 = 0")
    names = images.with_tokens(shots.select(F.concat(F.lit("/img/"), F.replace(F.lower("c_name"), F.lit("#"), F.lit("-")), F.lit("_"), "x", F.lit(".jpg")).alias("path")))
    return images.match_images(df.select("c_custkey", "c_name"), "c_custkey", ["c_name"], names)


@query(q("""WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS w FROM benchmark) SELECT count(*) AS rows, true AS finite, bool_and(len(w) > 0) AS norms_within_one, count(*) > 8 AS falling FROM w"""))
def svd_features(spark, sf_dir):
    """Properties of the components: as the rows of TF-IDF have norm 1, none's projection is longer; squares fall by component."""
    df = read(spark, sf_dir, "benchmark").withColumn(ordering.ORD, F.col("item_id"))
    out, _, names, _ = text_features.add_svd(df, df, "text", ordering.ORD)
    norm = sum(F.col(c) * F.col(c) for c in names)
    sums = [F.sum(F.col(c) * F.col(c)) for c in names]
    falling = F.lit(True)
    for a, b in zip(sums, sums[1:]):
        falling = falling & (a >= b - 1e-6)
    finite = [F.bool_and(scalar.is_finite(c)) for c in names]
    every = finite[0]
    for f in finite[1:]:
        every = every & f
    return out.agg(F.count("*").alias("rows"), every.alias("finite"), (F.max(norm) <= 1 + 1e-9).alias("norms_within_one"), falling.alias("falling"))


@query(q("SELECT o_orderkey, o_orderdate::TIMESTAMP AS found, CASE o_orderkey % 5 WHEN 4 THEN 1 ELSE 0 END::DOUBLE AS missing FROM orders WHERE o_orderkey % 5 <> 4 UNION ALL SELECT o_orderkey, NULL, 1.0 FROM orders WHERE o_orderkey % 5 = 4"))
def parsed_dates(spark, sf_dir):
    """Dates written in four formats, and no dates at all in every fifth row, read back."""
    d = F.col("o_orderdate")
    raw = F.element_at(F.array(F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "yyyy/MM/dd"), F.date_format(d, "MM/dd/yyyy"), F.date_format(d, "yyyyMMdd"), F.lit("not a date")), (F.col("o_orderkey") % 5 + 1).cast("int"))
    found = read(spark, sf_dir, "orders").select("o_orderkey", scalar.to_timestamp(raw).alias("found"))
    return found.select("o_orderkey", F.col("found").cast("timestamp_ntz").alias("found"), scalar.date_parts(F.col("found"))["is_missing_datetime"].alias("missing"))


@query(q("SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN c_acctbal WHEN 2 THEN NULL WHEN 3 THEN c_custkey * 1000.0 WHEN 4 THEN NULL ELSE -0.5 END AS x FROM customer"))
def parsed_numbers(spark, sf_dir):
    k = F.col("c_custkey")
    raw = F.element_at(F.array(F.lit("5d"), F.col("c_acctbal").cast("string"), F.lit("one"), F.concat(k.cast("string"), F.lit("e3")), F.lit("NaN"), F.lit(" -.5 ")), (k % 6 + 1).cast("int"))
    return read(spark, sf_dir, "customer").select("c_custkey", F.when(k % 6 == 5, -scalar.to_number(F.lit(".5"))).otherwise(scalar.to_number(raw)).alias("x"))


_IMAGES = """i AS (SELECT '/img/' || lower(n_name) || '_' || x || '.PNG' AS path, lower(n_name) || '_' || x AS stem, regexp_replace(lower(n_name) || x, '[^a-z0-9]', '', 'g') AS norm FROM nation, (SELECT unnest(['a', 'b']) AS x) WHERE n_nationkey % 3 > 0 AND (x = 'a' OR n_nationkey % 5 = 0))"""


@query(q(f"""WITH {_IMAGES}, w AS (SELECT n_nationkey, regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') AS t FROM nation WHERE n_nationkey % 7 <> 6)
    SELECT n_nationkey AS key, count(i.path) AS candidates, CASE WHEN count(i.path) = 1 THEN min(i.path) END AS path FROM w LEFT JOIN i ON contains(norm, t) OR contains(stem, t) GROUP BY n_nationkey"""))
def token_match(spark, sf_dir):
    """Images named after nations: none, one or two of a name; every seventh row's name says nothing, and region numbers are too short to."""
    n = read(spark, sf_dir, "nation")
    files = n.where("n_nationkey % 3 > 0").select("n_nationkey", "n_name", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("x")).where("x = 'a' OR n_nationkey % 5 = 0")
    names = images.with_tokens(files.select(F.concat(F.lit("/img/"), F.lower("n_name"), F.lit("_"), "x", F.lit(".PNG")).alias("path")))
    rows = n.select("n_nationkey", F.when(F.col("n_nationkey") % 7 == 6, "Unknown").otherwise(F.col("n_name")).alias("n_name"), "n_regionkey")
    return images.match_images(rows, "n_nationkey", ["n_name", "n_regionkey"], names)


# ---- validation, displays ----

_WRONG = "(SELECT CASE WHEN c_custkey % 19 <> 0 THEN c_custkey END AS id, CASE WHEN c_custkey % 11 = 0 THEN 'oops' WHEN c_custkey % 13 = 0 THEN 'inf' ELSE '1.5' END AS p FROM customer WHERE c_custkey % 7 <> 0)"


@query(q(f"""WITH s AS {_WRONG}, e AS (SELECT 1 AS k, 'extra columns: [''note'']' AS error UNION ALL SELECT 2, count(*) || ' null ids' FROM s WHERE id IS NULL UNION ALL SELECT 3, count(*) - (SELECT count(*) FROM (SELECT DISTINCT id FROM s)) || ' duplicate ids' FROM s
    UNION ALL SELECT 4, count(*) || ' missing or non-numeric predictions' FROM s WHERE p = 'oops' UNION ALL SELECT 5, count(*) || ' infinite predictions' FROM s WHERE p = 'inf'
    UNION ALL SELECT 6, 'row count ' || (SELECT count(*) FROM s) || ', expected ' || count(*) FROM customer UNION ALL SELECT 7, count(*) || ' ids of the sample are missing' FROM customer WHERE c_custkey NOT IN (SELECT id FROM s WHERE id IS NOT NULL)
    UNION ALL SELECT 8, count(DISTINCT coalesce(id, -1)) || ' ids are not in the sample' FROM s WHERE id IS NULL) SELECT error FROM e WHERE NOT starts_with(error, '0 ')"""))
def validation_errors(spark, sf_dir):
    k = F.col("c_custkey")
    df = read(spark, sf_dir, "customer")
    sample = df.select(k.alias("id"), F.lit(0.0).alias("p"), k.alias(ordering.ORD))
    bad = F.when(k % 11 == 0, "oops").when(k % 13 == 0, "inf").otherwise("1.5")
    wrong = df.where("c_custkey % 7 <> 0").select(F.when(k % 19 != 0, k).alias("id"), bad.alias("p"), F.lit("x").alias("note"), k.alias(ordering.ORD))
    return spark.createDataFrame([(e,) for e in validate.validate(wrong, sample, ["id", "p"], "id", "p").errors], "error string")


@query(q("""SELECT c_custkey, format('{:.4g}', c_acctbal * 1.5) AS number, CASE WHEN c_custkey % 2 = 0 THEN 'yes' ELSE 'no' END AS flag, CASE WHEN c_custkey % 3 > 0 THEN c_name ELSE '-' END AS name,
    CASE WHEN length(c_mktsegment) > 8 THEN substr(c_mktsegment, 1, 7) || '…' ELSE c_mktsegment END AS short, CASE WHEN c_nationkey = 1 THEN '1 row' ELSE c_nationkey || ' rows' END AS counted,
    CASE WHEN c_nationkey = 0 THEN '-' ELSE array_to_string(range(0, least(c_nationkey, 8)), ', ') || CASE WHEN c_nationkey > 8 THEN ' and ' || (c_nationkey - 8) || ' more' ELSE '' END END AS listed FROM customer"""))
def displayed_values(spark, sf_dir):
    """How a report shows the customers' values, made where the rows are."""
    df = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_name", "c_mktsegment", "c_nationkey")

    def run(batches):
        for b in batches:
            made = [
                (report.show(x * 1.5), report.show(k % 2 == 0), report.show(name if k % 3 else None), report.shorten(segment, 8), report.plural(n, "row"), report.compact(list(range(n))))
                for k, x, name, segment, n in b.itertuples(index=False)
            ]
            yield pd.DataFrame(made, columns=["number", "flag", "name", "short", "counted", "listed"]).assign(c_custkey=b["c_custkey"].to_numpy())

    return df.mapInPandas(run, f"number string, flag string, name string, short string, counted string, listed string, c_custkey {dict(df.dtypes)['c_custkey']}")


_DISPLAYED = {"c_name": "c_name", "seldom": "CASE WHEN c_custkey % 50 = 0 THEN 'x' END", "nothing": "nullif(c_custkey, c_custkey)", "dashes": "CASE WHEN c_custkey % 2 = 0 THEN ' N/A' ELSE '-' END", "once": "CASE WHEN c_custkey = 7 THEN 'none' WHEN c_custkey = 77 THEN 'some' END"}


@query(union([q(f"""SELECT '{c}' AS "column" FROM (SELECT {e} AS v FROM customer) HAVING count(*) FILTER (lower(trim(v::VARCHAR)) NOT IN ('', 'na', 'nan', 'none', 'null', 'n/a', '-')) > 0""") for c, e in _DISPLAYED.items()]))
def displayed_columns(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select(*[F.expr(e).alias(c) for c, e in _DISPLAYED.items()])
    return spark.createDataFrame([(c,) for c in report.shown_columns(rows)], "column string")


@query(q(union([f"SELECT '{p}' AS relative_path, '{t}' AS role, (SELECT count(*) FROM {t}) AS rows, (SELECT count(*) FROM (DESCRIBE {t})) AS columns" for t, p in _FILES.items()])))
def raw_overview(spark, sf_dir):
    files = []
    for t, p in _FILES.items():
        df = read(spark, sf_dir, t)
        files.append({"rel_path": p, "role": t, "n_rows": df.count(), "n_cols": len(df.columns)})
    return eda.raw_overview(spark, {"files": files})


@query(q(f"""WITH f AS ({_facts('documents', _DOCUMENTS)} UNION ALL {_facts('orders', _TASK_COLUMNS, _TASK)}), c AS (SELECT *, CASE WHEN regexp_matches(name, '(^|_)id$|^uuid$|^index$') OR (u / n > 0.95 AND u > 20) THEN 'id_like' WHEN numeric THEN 'numeric'
    WHEN time OR parsed > 0.7 THEN 'datetime' WHEN mean_len >= 40 OR max_len >= 120 OR (mean_len >= 25 AND letters > 0.5 AND spaces > 0.2) THEN 'text' ELSE 'low' END AS class FROM f)
    SELECT k AS item, (SELECT count(*) FROM c WHERE class = k) AS count FROM (SELECT unnest(['numeric', 'low', 'text', 'datetime', 'id_like']) AS k) UNION ALL SELECT 'distinct_features', count(*) FROM c WHERE class NOT IN ('text', 'datetime')
    UNION ALL SELECT 'prediction_rows', count(*) FROM documents"""))
def modeling_overview(spark, sf_dir):
    groups: dict[str, list[str]] = {k: [] for k in ("numeric", "low", "text", "datetime", "id_like")}
    docs = read(spark, sf_dir, "documents").select(*_DOCUMENTS)
    for df in (docs, _task(spark, sf_dir)):
        for k, v in kinds.feature_types(df).items():
            groups["low" if k == "categorical" else k] += v
    return eda.modeling_overview(spark, {"feature_groups": groups, "prediction_rows": docs.count()})


@query(q("""SELECT 'numeric' AS modality, any_value(typeof(n_chars)) IN ('INTEGER', 'BIGINT') AS present FROM documents UNION ALL SELECT 'categorical', count(DISTINCT lang) <= 50 FROM documents UNION ALL SELECT 'datetime', bool_or(try_strptime(text, '%Y-%m-%d') IS NOT NULL) FROM documents
    UNION ALL SELECT 'text', avg(length(text)) >= 40 FROM documents UNION ALL SELECT 'text_svd', count(*) >= 20 AND count(*) FILTER (trim(text) <> '') > 0 FROM documents UNION ALL SELECT 'images', count(*) FILTER (regexp_matches(lower(text), '\\.(png|jpg|jpeg|webp)$')) > 0 FROM documents"""))
def modalities(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("text", "lang", "n_chars")
    found = kinds.feature_types(docs)
    low = encoders.cardinality(docs, found["categorical"])
    keyed = docs.withColumn(ordering.ORD, F.monotonically_increasing_id())
    made = text_features.add_text_features(keyed, keyed, found["text"])[2]
    got = eda.modalities({"feature_groups": {**{k: found[k] for k in ("numeric", "text", "datetime")}, **low, "encoded": made}})
    return spark.createDataFrame(list(got.items()), "modality string, present boolean")




@query(q("""SELECT coalesce(lang, 'none') AS lang, count(*) AS n, count(*) FILTER (text LIKE '%' || chr(10) || '%') AS with_line_ends, sum(length(text))::BIGINT AS chars, sum(n_chars)::BIGINT AS n_chars,
    sum(('0x' || substr(md5(doc_id || text), 1, 8))::BIGINT)::BIGINT AS texts FROM documents GROUP BY 1"""))
def csv_texts(spark, sf_dir):
    """All documents written as CSV, with their line ends and quotes, and read back by records."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "text")
    with files.scratch_folder(spark) as folder:
        docs.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(folder)
        digest = F.conv(F.substring(F.md5(F.concat("doc_id", "text").cast("binary")), 1, 8), 16, 10).cast("bigint")
        sums = [F.count(F.when(F.contains("text", F.lit("\n")), 1)).alias("with_line_ends"), F.sum(F.length("text")).alias("chars"), F.sum("n_chars").alias("n_chars"), F.sum(digest).alias("texts")]
        found = files.read_csv(spark, folder).groupBy(F.coalesce("lang", F.lit("none")).alias("lang")).agg(F.count("*").alias("n"), *sums)
        return spark.createDataFrame(found.collect(), found.schema)  # a row for each language
