"""Model registry, cross-validation and prediction, on MLlib."""

from __future__ import annotations

import importlib.util
import math
import os
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions import metrics
from tabloom.functions.metrics import MetricSpec, block_key
from tabloom.functions.scalar import is_finite, row_bucket
from tabloom.operators.encoders import Assembler, impute
from tabloom.operators.ordering import ORD, fold_count, with_folds
from tabloom.operators.quantiles import exact_quantiles, grouped_quantiles
from tabloom.plans import grouped, trees
from tabloom.plans.trees import TreeSpec

MIN_BLOCK_ROWS = 15
DEFAULT_BUDGET_S = 1200
#: The deepest tree that MLlib grows; stands for unlimited depth.
DEEPEST = 30
#: Forests up to this depth grow in shared passes; deeper ones have too many (node, cut) pairs to merge and are MLlib's.
SHALLOW = 6


@dataclass(frozen=True)
class Candidate:
    """A model that may be tried. make: standard deviation of the labels (population) and their number -> estimator, or
    None for the median of the labels and for what needs no estimator: linear (alpha, share of the absolute penalty or None for ridge), trees.
    note: how it differs from the model of that name elsewhere."""

    name: str
    family: str
    priority: int
    make: Callable | None
    heavy: bool = False
    third_party: bool = False
    note: str = ""
    linear: tuple[float, float | None] | None = None
    trees: TreeSpec | None = None


def _linear(alpha: float, ratio: float | None, huber: bool = False):
    """MLlib's estimator: for Huber's loss, and for more terms than sums of products are kept for."""

    def make(std: float, n: int, rows: int):
        if huber:
            return LinearRegression(loss="huber", epsilon=1.35, regParam=alpha / max(rows, 1), standardization=False)
        if ratio is None:  # sum of squares + alpha |w|^2, over n, in units of the labels' deviation
            return LinearRegression(elasticNetParam=0.0, regParam=alpha * std / max(rows, 1), standardization=False, solver="normal")
        l1, l2 = alpha * ratio, alpha * (1 - ratio) * std
        return LinearRegression(elasticNetParam=l1 / (l1 + l2) if l1 + l2 else 0.0, regParam=l1 + l2, standardization=False, solver="normal", maxIter=500, tol=1e-9)

    return make


def _forest(trees: int, depth: int, seed: int, features: str = "all", leaf: int = 2):
    return lambda std, n, rows: RandomForestRegressor(numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, featureSubsetStrategy=features, seed=seed, maxBins=64)


def _boosted(rounds: int, rate: float, depth: int, seed: int):
    return lambda std, n, rows: GBTRegressor(maxIter=rounds, stepSize=rate, maxDepth=depth, seed=seed, maxBins=64)


def registry(seed: int = 42) -> list[Candidate]:
    """All built-in candidates."""
    sizes = ((6, 80, "6"), (10, 100, "10"), (DEEPEST, 140, "none"))
    out = [Candidate("dummy_median", "dummy", 900, None)]
    out += [Candidate(f"ridge_alpha{a}", "ridge", 300, _linear(a, None), linear=(a, None)) for a in (0.1, 1, 10)]
    out += [Candidate(f"elastic_net_alpha{a}_l1{r}", "elastic_net", 320, _linear(a, r), linear=(a, r)) for a, r in ((0.001, 0.1), (0.01, 0.3), (0.1, 0.5))]
    out += [Candidate("huber_epsilon1p35", "huber", 420, _linear(1e-4, None, True), note="approximate: another scale estimate")]
    out += [Candidate(f"extra_trees_depth{s}_leaf2_n{t}", "extra_trees", 120, _forest(t, d, seed + 1), s == "none", note="approximate: cuts are drawn from a node's box", trees=TreeSpec(t, d)) for d, t, s in sizes]
    out += [Candidate(f"random_forest_depth{s}_leaf2_n{t}", "random_forest", 150, _forest(t, d, seed), s == "none", note="approximate: binned splits", trees=TreeSpec(t, d, random=False) if d <= SHALLOW else None) for d, t, s in sizes]
    out += [Candidate(f"gradient_boosting_n{n}_lr{r}_depth{d}", "gradient_boosting", 220, _boosted(n, r, d, seed), n >= 120, note="approximate: binned splits") for n, r, d in ((60, 0.05, 2), (80, 0.05, 3), (120, 0.03, 3))]
    out += [Candidate("bagging_tree_depth8_n30", "bagging", 500, _forest(30, 8, seed, leaf=1), True, note="a forest over all features")]
    return out + boosters()


def booster_status() -> dict[str, bool]:
    """Which optional boosters are installed."""
    return {m: importlib.util.find_spec(m) is not None for m in ("xgboost", "lightgbm", "catboost")}


def boosters(seed: int = 42) -> list[Candidate]:
    """Candidates of the boosters that have a Spark estimator here."""
    if not booster_status()["xgboost"]:
        return []

    def make(rounds: int):
        def build(std, n, rows):
            from xgboost.spark import SparkXGBRegressor

            return SparkXGBRegressor(n_estimators=rounds, learning_rate=0.05, max_depth=4, random_state=seed)

        return build

    return [Candidate(f"xgboost_n{n}_depth4", "xgboost", 40, make(n), True, True) for n in (120, 200)]


def select(rows: int, features: int, strategy: str = "global", seed: int = 42) -> list[Candidate]:
    """The candidates worth trying: the 12 of best priority for small data, 8 that aren't heavy for medium, 6 for
    large and no boosting by trees there, 8 for one block; the median always comes last."""
    pool = sorted((c for c in registry(seed) if c.family != "dummy"), key=lambda c: c.priority)
    dummy = [c for c in registry(seed) if c.family == "dummy"]
    if strategy == "per_block":
        pool = [c for c in pool if c.family != "gradient_boosting"][:8]
    elif rows < 5_000 and features < 500:
        pool = pool[:12]
    elif rows < 20_000 and features < 1_000:
        pool = [c for c in pool if not c.heavy][:8]
    else:
        pool = [c for c in pool if not c.heavy and c.family != "gradient_boosting"][:6]
    return pool + dummy


def budget_seconds(default: int = DEFAULT_BUDGET_S) -> float:
    """Time for cross-validation, CV_TIME_BUDGET_SEC in the environment over the default."""
    try:
        return max(float(os.environ.get("CV_TIME_BUDGET_SEC", default)), 1.0)
    except ValueError:
        return float(default)


@dataclass
class Fitted:
    """A candidate fitted on some rows: transform() adds `prediction`."""

    candidate: Candidate
    median: float
    assembler: Assembler | None = None
    model: object | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            return df.withColumn("prediction", F.lit(self.median))
        out = self.model.transform(self.assembler.transform(df)).drop("features")
        good = is_finite("prediction")
        return out.withColumn("prediction", F.when(good, F.col("prediction")).otherwise(F.lit(self.median))).select(*df.columns, "prediction")


@dataclass
class Direct:
    """A linear model or a forest of trees of all rows: transform() adds `prediction`, the labels' median where it isn't finite."""

    candidate: Candidate
    median: float
    value: Callable[[], Column]

    def transform(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("__p", self.value())
        return out.withColumn("prediction", F.when(is_finite("__p"), F.col("__p")).otherwise(F.lit(self.median))).drop("__p")


def _groups(task: Task, k: int, block: Column | None = None, rows: int | None = None) -> grouped.Groups:
    """The task's rows with a finite label: one group, or one for each block."""
    good = task.train.where(is_finite(task.target)).withColumn("__label", F.col(task.target).cast("double"))
    good = good.withColumn("__group", F.lit("all") if block is None else block)
    key = F.col(task.key) if task.key in task.train.columns else F.monotonically_increasing_id()
    good = good.withColumn("__key", key.cast("string")).withColumn("__fold", row_bucket("__key", k) if k else F.lit(-1))
    n, top = good.agg(F.count("*"), F.max(F.abs("__label"))).first() if rows is None else (rows, None)
    return grouped.Groups(good, k, task.numeric, task.categories, n, top or 0.0)


def _direct(task: Task, candidate: Candidate) -> Direct | None:
    """candidate fitted on all rows from one scan of sums, or by growing its trees; None where that can't be (no rows, no features, too many terms)."""
    groups = _groups(task, 0)
    if not groups.n_rows or not (task.numeric or task.categories):
        return None
    if candidate.linear:
        solved = grouped.solve(groups, [candidate.linear])
        if solved is None:
            return None
        r = solved.table.first()
        w = r["__weights"][0][0]

        def value() -> Column:
            out = F.lit(w[0])
            for x, c in zip(w[1:], solved.terms.columns):
                out = out + F.lit(x) * c
            return out

        return Direct(candidate, r["__medians"][0], value)
    made = trees.features(groups, not candidate.trees.random)
    if made is None:
        return None
    forest = trees.grow(groups, candidate.trees, made, [0])
    median = exact_quantiles(groups.rows, {"y": F.col("__label")}, [0.5], groups.n_rows)["y"][0]
    return Direct(candidate, median, lambda: trees.prediction(forest, made, F.lit(0)))


@dataclass
class Prepared:
    """Rows with a finite label as models take them, whichever the candidate: their number, the labels' deviation and median, and,
    once a candidate needs them, the fitted assembler and the cached features."""

    train: DataFrame
    target: str
    numeric: Sequence[str]
    categories: Sequence[str]

    def __post_init__(self) -> None:
        self.rows = self.train.where(is_finite(self.target)).withColumn("__label", F.col(self.target).cast("double"))
        self.n, self.std = self.rows.agg(F.count("*"), F.stddev_pop("__label")).first()
        self.median = exact_quantiles(self.rows, {"y": F.col("__label")}, [0.5], self.n)["y"][0]
        self._made: tuple[Assembler, DataFrame] | None = None
        self._merged: tuple[Assembler, DataFrame, bool] | None = None

    def features(self) -> tuple[Assembler, DataFrame]:
        if self._made is None:
            assembler = Assembler(self.numeric, self.categories).fit(self.rows)
            self._made = assembler, assembler.transform(self.rows).select("features", "__label").cache()
        return self._made

    def merged(self) -> tuple[Assembler, DataFrame] | None:
        """The features with rows of equal features as one, with their mean label and their number as `__weight`; None unless that halves the rows. For
        squared errors a fit on these is the fit on all rows."""
        if self._merged is None:
            assembler = Assembler(self.numeric, self.categories).fit(self.rows)
            names = [*self.numeric, *self.categories]
            alike = impute(self.rows, assembler.numbers, assembler.texts).groupBy(*[F.col(f"`{c}`") for c in names]).agg(F.avg("__label").alias("__label"), F.count("*").cast("double").alias("__weight"))
            cells = assembler.transform(alike).select("features", "__label", "__weight").cache()
            self._merged = assembler, cells, 2 * cells.count() <= self.n
        return self._merged[:2] if self._merged[2] else None

    def close(self) -> None:
        if self._made is not None:
            self._made[1].unpersist()
            self._made = None
        if self._merged is not None:
            self._merged[1].unpersist()
            self._merged = None

    def fit(self, candidate: Candidate) -> Fitted:
        """Without features or rows every candidate is the median."""
        if candidate.make is None or not self.n or not (self.numeric or self.categories):
            return Fitted(candidate, self.median or 0.0)
        merged = self.merged() if candidate.family == "gradient_boosting" else None
        assembler, features = merged or self.features()
        estimator = candidate.make(self.std or 1.0, len(self.numeric), self.n).setFeaturesCol("features").setLabelCol("__label").setPredictionCol("prediction")
        if merged:
            estimator.setWeightCol("__weight")
        return Fitted(candidate, self.median, assembler, estimator.fit(features))


def fit(candidate: Candidate, train: DataFrame, target: str, numeric: Sequence[str], categories: Sequence[str], key: str = ORD) -> Fitted | Direct:
    """Fit on the rows with a finite label."""
    if candidate.linear or candidate.trees:
        direct = _direct(Task(train, target, list(numeric), list(categories), key=key), candidate)
        if direct is not None:
            return direct
    rows = Prepared(train, target, numeric, categories)
    try:
        return rows.fit(candidate)
    finally:
        rows.close()


CV_SCHEMA = T.StructType([
    T.StructField("strategy", T.StringType()), T.StructField("block", T.StringType()), T.StructField("model", T.StringType()), T.StructField("cv_folds", T.IntegerType()),
    T.StructField("score_mean", T.DoubleType()), T.StructField("score_std", T.DoubleType()), T.StructField("mae_mean", T.DoubleType()), T.StructField("mae_std", T.DoubleType()),
    T.StructField("metric_mode", T.StringType()), T.StructField("status", T.StringType()), T.StructField("is_selected", T.BooleanType()), T.StructField("strategy_score", T.DoubleType()),
    T.StructField("notes", T.StringType()), T.StructField("model_family", T.StringType()), T.StructField("is_third_party", T.BooleanType()), T.StructField("is_heavy", T.BooleanType()),
])


@dataclass
class Row:
    strategy: str
    block: str
    model: str
    cv_folds: int = 0
    score_mean: float | None = None
    score_std: float | None = None
    mae_mean: float | None = None
    mae_std: float | None = None
    metric_mode: str = "global"
    status: str = "ok"
    is_selected: bool = False
    strategy_score: float | None = None
    notes: str = ""
    model_family: str = ""
    is_third_party: bool = False
    is_heavy: bool = False


@dataclass
class Task:
    """A table ready for models: its label, features, folds' key, and how predictions are scored."""

    train: DataFrame
    target: str
    numeric: list[str]
    categories: list[str]
    spec: MetricSpec = field(default_factory=MetricSpec)
    block: str | None = None
    key: str = ORD

    def over(self, df: DataFrame) -> Task:
        return replace(self, train=df)


class Folds:
    """A task's folds, prepared once for all candidates."""

    def __init__(self, task: Task, rows: int):
        self.task, self.k = task, fold_count(rows)
        self.folded = with_folds(task.train, self.k, task.key) if self.k else task.train
        self._made: dict[int, Prepared] = {}

    def train(self, i: int) -> Prepared:
        if i not in self._made:
            self._made[i] = Prepared(self.folded.where(F.col("fold") != i), self.task.target, self.task.numeric, self.task.categories)
        return self._made[i]

    def held_out(self, i: int) -> DataFrame:
        return self.folded.where(F.col("fold") == i)

    def __enter__(self) -> Folds:
        return self

    def __exit__(self, *_) -> None:
        for p in self._made.values():
            p.close()


def cross_validate(task: Task, candidate: Candidate, rows: int, strategy: str = "global", block: str = "__all__", folds: Folds | None = None) -> Row:
    """Mean and deviation (ddof 0) over folds of the candidate's score under the task's metric."""
    if folds is None:
        with Folds(task, rows) as own:
            return cross_validate(task, candidate, rows, strategy, block, own)
    out = Row(strategy, block, candidate.name, metric_mode=task.spec.mode, model_family=candidate.family, is_third_party=candidate.third_party, is_heavy=candidate.heavy, notes=candidate.note)
    if folds.k is None:
        return replace(out, status="skipped_insufficient_rows", notes=f"{rows} rows are too few for folds")
    parts = []
    try:
        if candidate.trees and (task.numeric or task.categories) and (made := _forest_row(task, candidate, folds.k)):
            return replace(made, strategy=strategy, block=block)
        for i in range(folds.k):
            model = folds.train(i).fit(candidate)
            parts.append(model.transform(folds.held_out(i)).select(F.lit(i).alias("fold"), task.target, "prediction", *([task.block] if task.block else [])))
        got = _fold_scores(parts, task)
    except Exception as e:  # one candidate's failure is a row of the table, not the end of the search
        return replace(out, status="failed", notes=f"{type(e).__name__}: {str(e)[:200]}")
    scores = [s for s, _ in got if s is not None]
    errors = [m for _, m in got if m is not None]
    if not scores:
        return replace(out, status="failed", notes="no fold has a finite score")
    mean = lambda x: math.fsum(x) / len(x)
    std = lambda x: (math.fsum((v - mean(x)) ** 2 for v in x) / len(x)) ** 0.5
    return replace(out, cv_folds=folds.k, score_mean=mean(scores), score_std=std(scores), mae_mean=mean(errors), mae_std=std(errors))


def _row(task: Task, candidate: Candidate, strategy: str, block: str, scores: Sequence[float], errors: Sequence[float]) -> Row:
    mean = lambda x: math.fsum(x) / len(x)
    std = lambda x: (math.fsum((v - mean(x)) ** 2 for v in x) / len(x)) ** 0.5
    out = Row(strategy, block, candidate.name, metric_mode=task.spec.mode, model_family=candidate.family, is_third_party=candidate.third_party, is_heavy=candidate.heavy, notes=candidate.note)
    if not scores:
        return replace(out, status="failed", notes="no fold has a finite score")
    return replace(out, cv_folds=len(scores), score_mean=mean(scores), score_std=std(scores), mae_mean=mean(errors), mae_std=std(errors))


def _official(task: Task) -> Column:
    wanted = metrics.clean_blocks(task.spec.block_values)
    return block_key(task.block).isin(wanted) if wanted else F.lit(True)


def _side_by_side(task: Task, candidates: Sequence[Candidate], k: int) -> dict[str, Row]:
    """Rows of the linear candidates and the median, from one scan for all folds' sums and one for all errors. Empty if there are too many terms."""
    linear = [c for c in candidates if c.linear] if task.numeric or task.categories else []
    simple = [c for c in candidates if c.family == "dummy"]
    if not linear and not simple:
        return {}
    groups = _groups(task, k)
    solved = grouped.solve(groups, [c.linear for c in linear])
    if solved is None:
        return {}
    by_block = task.spec.mode == "block_averaged" and task.block
    got = grouped.errors(groups, solved, [F.col(task.block).alias("__b"), _official(task).alias("__o")] if by_block else [])
    each = [f"e{i}" for i in range(len(linear) + 1)]
    sums = [(F.sum(F.col(e) * F.col("n")) / F.sum("n")).alias(f"mae_{e}") for e in each]
    score = [grouped.exact_mean(F.when(F.col("__o"), F.col(e)) if by_block else F.col(e), groups.n_rows, groups.top).alias(f"score_{e}") for e in each]
    rows = got.groupBy("__fold").agg(*sums, *score).orderBy("__fold").collect()
    pick = lambda name: [r[name] for r in rows if r[name] is not None]
    return {c.name: _row(task, c, "global", "__all__", pick(f"score_{e}"), pick(f"mae_{e}")) for c, e in zip([*linear, *simple[:1]], [*each[: len(linear)], each[-1]])}


def _forest_row(task: Task, candidate: Candidate, k: int) -> Row | None:
    """All folds' trees grown in shared passes; None if there are too many features."""
    groups = _groups(task, k)
    made = trees.features(groups, not candidate.trees.random)
    if made is None:
        return None
    forest = trees.grow(groups, candidate.trees, made, list(range(k)))
    parts = groups.rows.withColumn("fold", F.col("__fold")).withColumn("prediction", trees.prediction(forest, made, F.col("__fold")))
    got = _fold_scores([parts.select("fold", task.target, "prediction", *([task.block] if task.block else []))], task)
    return _row(task, candidate, "global", "__all__", [s for s, _ in got if s is not None], [m for _, m in got if m is not None])


def _fold_scores(parts: list[DataFrame], task: Task) -> list[tuple[float | None, float | None]]:
    """(score, mae) of each fold, all folds in one job."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    err = metrics.errors(rows, task.target, "prediction")
    if task.spec.mode == "block_averaged" and task.block:
        wanted = metrics.clean_blocks(task.spec.block_values)
        official = block_key(task.block).isin(wanted) if wanted else F.lit(True)
        per = err.groupBy("fold", task.block, official.alias("o")).agg(F.avg("__err").alias("m"), F.sum("__err").alias("s"), F.count("*").alias("n"))
        got = per.groupBy("fold").agg(F.avg(F.when(F.col("o"), F.col("m"))).alias("score"), (F.sum("s") / F.sum("n")).alias("mae"))
    else:
        got = err.groupBy("fold").agg(F.avg("__err").alias("score")).withColumn("mae", F.col("score"))
    return [(r["score"], r["mae"]) for r in got.orderBy("fold").collect()]


class Clock:
    """A budget of wall-clock seconds that both strategies share."""

    def __init__(self, seconds: float):
        self.end = time.monotonic() + seconds

    def over(self) -> bool:
        return time.monotonic() > self.end

    def within(self, spark: SparkSession, work: Callable):
        """work()'s value, or None if the clock ends first: its jobs are then cancelled, however far they are."""
        group, got = f"tabloom-{uuid.uuid4().hex}", []

        def run() -> None:
            spark.sparkContext.setJobGroup(group, "a candidate under a time limit", True)
            try:
                got.append((work(), None))
            except Exception as e:
                got.append((None, e))

        thread = InheritableThread(target=run, daemon=True)
        thread.start()
        thread.join(max(0.0, self.end - time.monotonic()))
        if thread.is_alive():
            for _ in range(100):  # work may begin another job before it notices
                spark.sparkContext.cancelJobGroup(group)
                thread.join(0.1)
                if not thread.is_alive():
                    break
            return None
        value, error = got[0]
        if error is not None:
            raise error
        return value


def _late(strategy: str, block: str, c: Candidate, task: Task) -> Row:
    """The row of a candidate that the clock left out or stopped."""
    return Row(strategy, block, c.name, metric_mode=task.spec.mode, status="skipped_time_budget", model_family=c.family, is_third_party=c.third_party, is_heavy=c.heavy)


def _ready(task: Task, candidates: Sequence[Candidate], k: int) -> dict[str, Row]:
    try:
        return _side_by_side(task, candidates, k)
    except Exception:  # each candidate then runs alone, and its own failure is its row
        return {}


def search_global(task: Task, candidates: Sequence[Candidate], rows: int, clock: Clock) -> tuple[Candidate | None, float | None, list[Row]]:
    """The candidate of strictly least score, the first of equals, and all rows; candidates beyond the clock are skipped."""
    found: list[Row] = []
    best, score = None, None
    with Folds(task, rows) as folds:
        ready = (clock.within(task.train.sparkSession, lambda: _ready(task, candidates, folds.k)) or {}) if folds.k and not clock.over() else {}
        for c in candidates:
            if clock.over() and c.name not in ready:
                found.append(_late("global", "__all__", c, task))
                continue
            r = ready.get(c.name) or clock.within(task.train.sparkSession, lambda c=c: cross_validate(task, c, rows, folds=folds))
            if r is None:
                found.append(_late("global", "__all__", c, task))
                continue
            found.append(r)
            if r.status == "ok" and (score is None or r.score_mean < score):
                best, score = c, r.score_mean
    return best, score, found


@dataclass
class BlockChoice:
    candidate: Candidate | None  # None: the block's median
    score: float | None


def search_per_block(task: Task, clock: Clock, seed: int = 42, candidates: Sequence[Candidate] | None = None) -> tuple[dict[str, BlockChoice], float | None, list[Row]]:
    """For each block (by its normalised value) the best candidate, scored by MAE within it. Blocks of under
    MIN_BLOCK_ROWS rows, or too few for folds, take their median, scored on the rows it comes from, and so do those that the clock leaves no time for, with a row for each
    candidate that it skips. The overall score is the mean of
    the blocks' scores (official blocks alone where the description names them)."""
    key = block_key(task.block)
    official = set(metrics.clean_blocks(task.spec.block_values))
    train = task.train.where(key.isNotNull() & (key.isin(list(official)) if official else F.lit(True)))
    here = replace(task, train=train, spec=MetricSpec(), block=None)
    groups = _groups(here, 1, key, 0)
    sizes = groups.rows.groupBy("__group").agg(F.count("*").alias("n"), F.max(F.abs("__label")).alias("top")).orderBy("__group").collect()
    groups = replace(groups, n_rows=sum(s["n"] for s in sizes), top=max((s["top"] for s in sizes), default=0.0))
    pool = candidates if candidates is not None else select(0, len(task.numeric) + len(task.categories), "per_block", seed)
    enough = {s["__group"] for s in sizes if s["n"] >= MIN_BLOCK_ROWS and fold_count(s["n"]) is not None}
    ready = (clock.within(train.sparkSession, lambda: _blocks_ready(here, groups, pool)) or {}) if enough and not clock.over() else {}
    chosen: dict[str, BlockChoice] = {}
    found: list[Row] = []
    left: dict[str, Row] = {}  # blocks that take their median
    for s in sizes:
        b, best, late = s["__group"], BlockChoice(None, None), False
        alone = None  # the block's own rows and folds, for candidates that aren't ready
        for c in pool if b in enough else ():
            r = ready.get((b, c.name))
            if r is None and not clock.over():
                alone = alone or Folds(replace(here, train=train.where(key == b)), s["n"])
                r = clock.within(train.sparkSession, lambda c=c, alone=alone, s=s, b=b: cross_validate(alone.task, c, s["n"], "per_block", b, alone))
            if r is None:
                late = True
                found.append(_late("per_block", b, c, here))
                continue
            found.append(r)
            if r.status == "ok" and (best.score is None or r.score_mean < best.score):
                best = BlockChoice(c, r.score_mean)
        if alone:
            alone.__exit__()
        if best.candidate is None:
            status = "fallback_insufficient_rows" if b not in enough else "fallback_time_budget" if late else "fallback_failed"
            found.append(Row("per_block", b, "median_fallback", status=status, notes=f"{s['n']} rows", model_family="dummy"))
            left[b] = found[-1]
        chosen[b] = best
    for b, error in _median_errors(groups, list(left)).items():
        chosen[b] = BlockChoice(None, error)
        left[b].score_mean = left[b].mae_mean = error
    scores = [c.score for c in chosen.values() if c.score is not None]
    return chosen, sum(scores) / len(scores) if scores else None, found


def _median_errors(groups: grouped.Groups, blocks: Sequence[str]) -> dict[str, float]:
    """Mean absolute error of each of these blocks' own median; the rows of other blocks are passed over."""
    if not blocks:
        return {}
    wanted = groups.rows.sparkSession.createDataFrame([(b,) for b in blocks], "__group string")
    rows = groups.rows.select("__group", "__label").join(F.broadcast(wanted), "__group", "left_semi")
    medians = grouped_quantiles(rows, ["__group"], {"m": F.col("__label")}, [0.5], groups.n_rows).select("__group", F.get("m", 0).alias("m"))
    got = rows.join(medians, "__group").groupBy("__group").agg(F.avg(F.abs(F.col("__label") - F.col("m"))).alias("error"))
    return {r["__group"]: r["error"] for r in got.collect()}


def _blocks_ready(task: Task, groups: grouped.Groups, pool: Sequence[Candidate]) -> dict[tuple[str, str], Row]:
    """Rows of the linear candidates and the median for every block that is large enough, all blocks and folds in one aggregate and one pass for errors."""
    linear = [c for c in pool if c.linear] if task.numeric or task.categories else []
    simple = [c for c in pool if c.family == "dummy"][:1]
    counts = groups.rows.groupBy("__group").agg(F.count("*").alias("__n")).where(F.col("__n") >= max(MIN_BLOCK_ROWS, 20))
    k = F.when(F.col("__n") >= 1000, 3).when(F.col("__n") >= 50, 5).otherwise(3)  # as fold_count()
    rows = groups.rows.join(counts, "__group").withColumn("__fold", row_bucket("__key", k)).drop("__n")
    folded = replace(groups, rows=rows, folds=5)
    solved = grouped.solve(folded, [c.linear for c in linear])
    if solved is None:
        return {}
    out: dict[tuple[str, str], Row] = {}
    each = [f"e{i}" for i in range(len(linear))] + [f"e{len(linear)}"]
    per = grouped.errors(folded, solved).groupBy("__group").agg(*[F.collect_list(e).alias(e) for e in each])
    for r in per.collect():
        for c, e in zip([*linear, *simple], each):
            out[r["__group"], c.name] = _row(task, c, "per_block", r["__group"], r[e], r[e])
    return out


@dataclass
class Selection:
    strategy: str
    score: float | None
    candidate: Candidate | None
    blocks: dict[str, BlockChoice]
    rows: list[Row]


def choose(task: Task, rows: int, seed: int = 42, seconds: float | None = None, candidates: Sequence[Candidate] | None = None) -> Selection:
    """Per-block models if scoring averages over blocks, the block column is known, and they are strictly better;
    else the best global one. The per-block search runs first and both share the time."""
    clock = Clock(budget_seconds() if seconds is None else seconds)
    blocks, block_score, found = ({}, None, [])
    if task.spec.mode == "block_averaged" and task.block:
        blocks, block_score, found = search_per_block(task, clock, seed)
    pool = candidates if candidates is not None else select(rows, len(task.numeric) + len(task.categories), "global", seed)
    best, score, more = search_global(task, pool, rows, clock)
    per_block = block_score is not None and (score is None or block_score < score)
    strategy = "per_block" if per_block else "global"
    total = block_score if per_block else score
    found = found + more
    for r in found:
        mine = blocks[r.block].candidate.name == r.model if r.block in blocks and blocks[r.block].candidate else r.model == "median_fallback"
        r.is_selected = (r.strategy == "per_block" and mine) if per_block else (r.strategy == "global" and best is not None and r.model == best.name)
        r.strategy_score = block_score if r.strategy == "per_block" else score
    for name, s in (("per_block", block_score), ("global", score)):
        if s is not None:
            found.append(Row(name, "__strategy__", name, score_mean=s, strategy_score=s, metric_mode=task.spec.mode, status="strategy_summary", is_selected=name == strategy))
    return Selection(strategy, total, best, blocks, found)


def cv_frame(spark, rows: Sequence[Row]) -> DataFrame:
    return spark.createDataFrame([tuple(r.__dict__.values()) for r in rows], CV_SCHEMA)


@dataclass
class Predictor:
    """What was chosen, fitted: predict() adds `prediction` to rows. Blocks with a linear model or the median share one plan, in which their weights are joined to the rows;
    `models` are the few others."""

    models: dict[str, Fitted | Direct]
    whole: Fitted | Direct
    medians: DataFrame | None = None
    block: str | None = None
    solved: grouped.Solved | None = None

    def predict(self, df: DataFrame) -> DataFrame:
        if self.block is None:
            return self.whole.transform(df)
        key = block_key(self.block)
        parts = [m.transform(df.where(key == b)) for b, m in self.models.items()]
        rest = df.where(~F.coalesce(key.isin(list(self.models)), F.lit(False))) if self.models else df
        met = rest.withColumn("__group", key).join(self.medians, "__group", "left")
        value = F.coalesce("__median", F.lit(self.whole.median))
        if self.solved is not None:
            met = self.solved.joined(met, "left")
            p = self.solved.prediction(F.lit(self.solved.folds), F.col("__model"))
            value = F.when(F.col("__model").isNotNull() & is_finite(p), p).otherwise(value)
        out = met.withColumn("prediction", value).select(*df.columns, "prediction")
        for p in parts:
            out = out.unionByName(p)
        return out


def fit_selection(task: Task, chosen: Selection) -> Predictor:
    """Fit the chosen strategy on all rows with a label; blocks of the median strategy, and blocks unseen in training, get medians."""
    dummy = Candidate("dummy_median", "dummy", 900, None)
    if chosen.strategy == "global":
        return Predictor({}, fit(chosen.candidate or dummy, task.train, task.target, task.numeric, task.categories, task.key))
    key = block_key(task.block)
    groups = _groups(replace(task, train=task.train.where(key.isNotNull())), 0, key)
    medians = grouped_quantiles(groups.rows, ["__group"], {"m": F.col("__label")}, [0.5], groups.n_rows).select("__group", F.get("m", 0).alias("__median"))
    picked = {b: c.candidate for b, c in chosen.blocks.items() if c.candidate is not None and c.candidate.family != "dummy"}
    linear = list(dict.fromkeys(c.linear for c in picked.values() if c.linear))
    solved = grouped.solve(groups, linear) if linear and (task.numeric or task.categories) else None
    models = {}
    numbers = []
    for b, c in picked.items():
        if c.linear and solved is not None:
            numbers.append((b, linear.index(c.linear)))
        else:
            models[b] = fit(c, task.train.where(key == b), task.target, task.numeric, task.categories, task.key)
    if numbers:
        medians = medians.join(task.train.sparkSession.createDataFrame(numbers, "__group string, __model int"), "__group", "left")
    return Predictor(models, fit(dummy, task.train, task.target, [], []), medians, task.block, solved if numbers else None)


def block_medians(train: DataFrame, target: str, block: str) -> dict[str, float]:
    """Median label of each block that isn't null, by its normalised value."""
    rows = train.where(is_finite(target) & F.col(block).isNotNull()).select(block_key(block).alias("b"), F.col(target).alias("y"))
    return {r["b"]: r["m"][0] for r in grouped_quantiles(rows, ["b"], {"m": F.col("y")}, [0.5]).collect()}


def fallback_predictions(train: DataFrame, target: str, rows: DataFrame, block: str | None = None) -> DataFrame:
    """rows with `prediction`: their block's median label, else the median of all, else 0."""
    good = train.where(is_finite(target))
    y = F.col(target).cast("double")
    whole = exact_quantiles(good, {"y": y}, [0.5])["y"][0] or 0.0
    if not block or block not in train.columns or block not in rows.columns:
        return rows.withColumn("prediction", F.lit(whole))
    named = good.where(F.col(block).isNotNull()).select(F.col(block).alias("__b"), y.alias("__y"))
    by = grouped_quantiles(named, ["__b"], {"__m": F.col("__y")}, [0.5]).select("__b", F.get("__m", 0).alias("__m"))
    return rows.join(by, F.col(block) == F.col("__b"), "left").withColumn("prediction", F.coalesce("__m", F.lit(whole))).drop("__b", "__m")


def repair(predictions: DataFrame, fallback: float, not_negative: bool) -> DataFrame:
    """Non-finite predictions become the fallback; with not_negative none is below 0."""
    p = F.when(is_finite("prediction"), F.col("prediction").cast("double")).otherwise(F.lit(float(fallback)))
    return predictions.withColumn("prediction", F.greatest(F.lit(0.0), p) if not_negative else p)


def sanity(predictions: DataFrame) -> list[str]:
    """Warnings about predictions: none at all, missing or infinite ones, all alike."""
    p = F.col("prediction").cast("double")
    n, bad, distinct = predictions.agg(F.count("*"), F.count(F.when(~is_finite(p), 1)), F.count_distinct(p)).first()
    out = ["there are no predictions"] if not n else []
    if bad:
        out.append(f"{bad} predictions are not finite")
    if n > 1 and distinct == 1:
        out.append("all predictions are equal")
    return out
