"""Operator 8: mix sources to target weights by iterative proportional fitting (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import _all, materialize, text_or_empty

#: Up to so many cells are raked inside one task and broadcast to the documents (under 64 bytes a cell); more are dealt by key.
SMALL_CELLS = 100_000


def topic_of(text: str = "text") -> Column:
    """A topic by the text's shape: empty, legal, tabular, shouting, or plain prose by its length in words."""
    t = text_or_empty(text)
    n = word_count(text)
    return (
        F.when(n == 0, "empty")
        .when(F.contains(t, F.lit("icense")), "legal")
        .when(F.contains(t, F.lit(" | ")), "tabular")
        .when(F.contains(t, F.lit("!!")), "shouting")
        .when(n < 200, "short")
        .when(n < 800, "medium")
        .otherwise("long")
    )


def word_count(text: str = "text") -> Column:
    """Words are maximal runs of bytes other than space and tab to carriage return; null has none."""
    return F.regexp_count(text_or_empty(text), F.lit(r"[^ \t-\r]+")).cast("long")


def targets(cells: DataFrame, alphas: Mapping[str, float], fixed: Mapping[str, Mapping[str, float]] | None) -> DataFrame:
    """Add __t_<dim>, the target share of the cell's value in each dimension.

    Without a fixed target a value's share is its share of tokens to the power alpha, normalised over the values
    (alpha 1 leaves the dimension as it is, alpha 0 makes its values equal). Fixed targets are shares by value; values
    that they don't name get none; they are normalised over the values that occur.
    """
    for dim, alpha in alphas.items():
        m = F.sum("tokens").over(Window.partitionBy(dim))
        first = F.row_number().over(Window.partitionBy(dim).orderBy(*alphas)) == 1
        cells = cells.withColumns({"__m": m, "__first": first})
        if fixed and dim in fixed:
            share = F.lit(0.0)
            for value, w in fixed[dim].items():
                share = F.when(F.col(dim).eqNullSafe(F.lit(value)) & (F.col("__m") > 0), F.lit(float(w))).otherwise(share)
        else:
            share = F.when(F.col("__m") > 0, F.pow(F.col("__m").cast("double"), F.lit(float(alpha)))).otherwise(F.lit(0.0))
        cells = cells.withColumn("__s", share)
        whole = F.sum(F.when(F.col("__first"), F.col("__s")).otherwise(F.lit(0.0))).over(Window.partitionBy(F.lit(1)))
        cells = cells.withColumn(f"__t_{dim}", F.try_divide(F.col("__s"), whole))
    return cells.drop("__m", "__first", "__s")


def rake(cells: DataFrame, alphas: Mapping[str, float], sweeps: int, fixed=None, written_every: int = 0) -> DataFrame:
    """Iterative proportional fitting: scale the cells' weights to each dimension's targets in turn, sweep after sweep.

    cells: one row per combination of values, with its tokens. Adds p (share of tokens) and q (raked share). Large cell
    tables are written after every written_every sweeps, which keeps plan and lineage short.
    """
    cells = targets(cells, alphas, fixed)
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(1)))
    cells = cells.withColumn("p", F.coalesce(F.try_divide(F.col("tokens").cast("double"), whole.cast("double")), F.lit(0.0)))
    cells = cells.withColumn("q", F.col("p"))
    for k in range(sweeps):
        for dim in alphas:
            now = F.sum("q").over(Window.partitionBy(dim))
            cells = cells.withColumn("q", F.coalesce(F.col("q") * F.try_divide(F.col(f"__t_{dim}"), now), F.lit(0.0)))
        if written_every and (k + 1) % written_every == 0:
            cells = materialize(cells)
    q = F.sum("q").over(Window.partitionBy(F.lit(1)))
    return cells.withColumn("q", F.coalesce(F.try_divide(F.col("q"), q), F.lit(0.0))).drop(*[f"__t_{d}" for d in alphas])


def calibrate(cells: DataFrame, keep: float, dims: list[str]) -> DataFrame:
    """Add prob = min(1, lambda q / p), lambda such that the expected kept tokens are `keep` of all.

    Cells in falling q / p: with the first k cells kept whole, lambda is (keep - their p) / (1 - their q). The right k
    is the first whose lambda brings no further cell over 1; with none all cells that have a target are kept whole.
    Cells without tokens have prob 1: their documents are empty and cost nothing.
    """
    live = F.col("p") > 0
    cells = cells.withColumn("__r", F.when(live, F.col("q") / F.col("p")).otherwise(F.lit(-1.0)))
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("__r"), *dims).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumns({"__p": F.coalesce(F.sum("p").over(order), F.lit(0.0)), "__q": F.coalesce(F.sum("q").over(order), F.lit(0.0))})
    factor = F.when(F.col("__q") < 1 - 1e-12, (F.lit(float(keep)) - F.col("__p")) / (1 - F.col("__q")))
    fits = live & (factor >= 0) & (factor * F.col("__r") <= 1 + 1e-12)
    # the first cell that fits has the greatest q / p of those that do
    best = F.max(F.when(fits, F.struct(F.col("__r").alias("r"), factor.alias("f")))).over(Window.partitionBy(F.lit(1)))
    prob = F.when(~live, F.lit(1.0)).when(F.col("__best").isNull(), F.when(F.col("__r") > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    prob = prob.otherwise(F.least(F.lit(1.0), F.col("__best.f") * F.col("__r")))
    return cells.withColumn("__best", best).withColumn("prob", prob).drop("__p", "__q", "__best", "__r")


def uniform(key: str) -> Column:
    """A number in [0, 1) that depends on the key alone (null: as the empty text)."""
    h = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / float(1 << 32)


def mix(
    docs: DataFrame,
    alphas: Mapping[str, float],
    tokens: str,
    key: str = "doc_id",
    keep: float = 0.5,
    sweeps: int = 12,
    fixed: Mapping[str, Mapping[str, float]] | None = None,
) -> DataFrame:
    """Give every row weight (q / p of its cell), prob (its calibrated sampling probability) and kept.

    alphas names the dimensions; see targets(). `tokens` is a column of whole numbers, null counting as 0. Null values
    of a dimension are a value of their own. Equal keys share their fate, so exact repeats of a row stay together. A
    cell without tokens has weight 1 and prob 1. An empty table stays empty. Columns named weight, prob or kept are replaced.

    Documents are only aggregated (before the shuffle, so that hot cells cost nothing) and joined to their cell. The
    cell table has a row per combination of values; up to SMALL_CELLS it is raked in one task and broadcast, beyond it is
    dealt by each dimension in turn, but for totals over all cells, which one task takes.
    """
    dims = list(alphas)
    base = docs.withColumn("__tokens", F.coalesce(F.col(tokens), F.lit(0)).cast("long"))
    cells = base.groupBy(*dims).agg(F.sum("__tokens").alias("tokens"))
    cells = materialize(cells)
    small = cells.limit(SMALL_CELLS + 1).count() <= SMALL_CELLS
    if small:
        cells = cells.coalesce(1)  # every window below then runs in this one bounded task, without a shuffle
    raked = rake(cells, alphas, sweeps, fixed, written_every=0 if small else 3)
    probs = materialize(calibrate(raked, keep, dims))
    weight = F.when(F.col("p") > 0, F.col("q") / F.col("p")).otherwise(F.lit(1.0))
    right = probs.select(*[F.col(d).alias(f"__{i}") for i, d in enumerate(dims)], weight.alias("__weight"), F.col("prob").alias("__prob"))
    same = _all(F.col(d).eqNullSafe(F.col(f"__{i}")) for i, d in enumerate(dims))
    joined = base.join(F.broadcast(right) if small else right, same, "left")
    out = joined.withColumns({"weight": F.col("__weight"), "prob": F.col("__prob"), "kept": uniform(key) < F.col("__prob")})
    return out.select(*docs.columns, *[c for c in ("weight", "prob", "kept") if c not in docs.columns])


def mix_documents(docs: DataFrame, keep: float = 0.5, sweeps: int = 12, columns: list[str] | None = None) -> DataFrame:
    """Mix documents by source, lang and topic: sources and languages are flattened, topics a little less.

    Returns `columns` of docs (by default all) with topic, n_tokens, weight, prob and kept, which replace columns of these names.
    Null texts are empty, and so of topic `empty` with no tokens; null sources and languages are values of their own; texts are
    read whole, and once: topics and tokens are written with the other columns before cells are counted. Repeated rows and
    doc_ids share their fate, an empty table stays empty.
    """
    names = [c for c in columns or docs.columns if c not in ("topic", "n_tokens")]
    shaped = materialize(docs.select(*names, topic_of().alias("topic"), word_count().alias("n_tokens")))
    return mix(shaped, ALPHAS, "n_tokens", keep=keep, sweeps=sweeps)


#: Dimension: power of its token shares that its targets follow.
ALPHAS = {"source": 0.5, "lang": 0.5, "topic": 0.8}


def oracle(keep: float = 0.5, sweeps: int = 12, docs: str = "documents") -> str:
    dims = list(ALPHAS)
    by = ", ".join(dims)
    words = "len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+'))"
    q = [f"""base AS (SELECT *, {words} AS n_tokens FROM {docs}),
shaped AS (SELECT *, CASE WHEN n_tokens = 0 THEN 'empty' WHEN contains(text, 'icense') THEN 'legal' WHEN contains(text, ' | ') THEN 'tabular'
    WHEN contains(text, '!!') THEN 'shouting' WHEN n_tokens < 200 THEN 'short' WHEN n_tokens < 800 THEN 'medium' ELSE 'long' END AS topic FROM base),
cells AS (SELECT {by}, sum(n_tokens)::DOUBLE AS tokens FROM shaped GROUP BY {by})"""]
    for d, a in ALPHAS.items():
        q.append(f"t_{d} AS (SELECT {d} AS v, s / sum(s) OVER () AS t FROM (SELECT {d}, CASE WHEN sum(tokens) > 0 THEN pow(sum(tokens), {a}) ELSE 0 END AS s FROM cells GROUP BY {d}))")
    q.append("k0 AS MATERIALIZED (SELECT *, tokens / sum(tokens) OVER () AS p, tokens / sum(tokens) OVER () AS q FROM cells)")
    n = 0
    for _ in range(sweeps):
        for d in dims:
            q.append(f"k{n + 1} AS MATERIALIZED (SELECT k.* REPLACE (coalesce(q * t.t / nullif(sum(q) OVER (PARTITION BY {d}), 0), 0) AS q) FROM k{n} k JOIN t_{d} t ON k.{d} IS NOT DISTINCT FROM t.v)")
            n += 1
    q.append(f"""raked AS MATERIALIZED (SELECT *, CASE WHEN p > 0 THEN q / p ELSE -1 END AS r FROM (SELECT * REPLACE (q / sum(q) OVER () AS q) FROM k{n})),
run AS (SELECT *, coalesce(sum(p) OVER w, 0) AS bp, coalesce(sum(q) OVER w, 0) AS bq FROM raked
    WINDOW w AS (ORDER BY r DESC, {by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lam AS (SELECT arg_max(({keep} - bp) / (1 - bq), r) AS f FROM run
    WHERE p > 0 AND bq < 1 - 1e-12 AND ({keep} - bp) / (1 - bq) >= 0 AND ({keep} - bp) / (1 - bq) * r <= 1 + 1e-12),
probs AS (SELECT {by}, CASE WHEN p > 0 THEN r ELSE 1 END AS weight, CASE WHEN p <= 0 THEN 1 WHEN f IS NULL THEN (r > 0)::INT ELSE least(1, f * r) END AS prob FROM raked, lam)
SELECT d.doc_id, d.source, d.lang, d.topic, d.n_tokens, round(weight, 6) AS weight, round(prob, 6) AS prob,
    ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE / 4294967296 < prob AS kept
FROM shaped d JOIN probs c ON {" AND ".join(f"d.{x} IS NOT DISTINCT FROM c.{x}" for x in dims)}""")
    return "WITH " + ",\n".join(q)
