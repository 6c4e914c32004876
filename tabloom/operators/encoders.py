"""Feature encoders: cardinality, frequency, dates, imputation, one-hot, and the assembled frames."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.scalar import date_parts, to_timestamp
from tabloom.operators.ordering import ORD
from tabloom.operators.profile import decided_counts, number, value
from tabloom.operators.quantiles import exact_quantiles
from tabloom.operators.types import feature_types, is_id_like

# Bounds of the cardinality classes, and what stands for a missing category.
LOW_AT_MOST, MEDIUM_AT_MOST, DROPPED_OVER = 50, 500, 0.99
MISSING = "__MISSING__"


@dataclass
class Groups:
    """Roles of the features."""

    numeric: list[str] = field(default_factory=list)
    low: list[str] = field(default_factory=list)
    medium: list[str] = field(default_factory=list)
    high: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    datetime: list[str] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)
    encoded: list[str] = field(default_factory=list)


def cardinality(train: DataFrame, names: Sequence[str]) -> dict[str, list[str]]:
    """Categorical columns by their distinct values in the training table: low, medium, high, or dropped (id-like, or
    over 99 % distinct beyond the medium class). Sketches first; exact where a class hangs on it."""
    out: dict[str, list[str]] = {k: [] for k in ("low", "medium", "high", "dropped")}
    if not names:
        return out
    n, found = decided_counts(train, {c: value(train, c) for c in names}, (0.95, DROPPED_OVER))
    for c, u in found.items():
        if is_id_like(c, u, n):
            kind = "dropped"
        elif u <= LOW_AT_MOST:
            kind = "low"
        elif u <= MEDIUM_AT_MOST:
            kind = "medium"
        else:
            kind = "dropped" if u / max(n, 1) > DROPPED_OVER else "high"
        out[kind].append(c)
    return out


def category(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(MISSING))


def frequencies(train: DataFrame, name: str) -> DataFrame:
    """value, freq: share of the training rows; missing is a value."""
    counts = train.groupBy(category(name).alias("value")).agg(F.count("*").alias("n"))
    total = train.agg(F.count("*").alias("rows"))
    return counts.join(F.broadcast(total)).select("value", (F.col("n") / F.col("rows")).alias("freq"))  # total is one row


def frequency_encode(train: DataFrame, other: DataFrame, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Replace each column by <name>__freq, its value's share of the training rows: 0 for values unseen there, and
    throughout where the second table lacks the column."""
    for c in names:
        freq = frequencies(train, c)
        train, other = _with_freq(train, freq, c), _with_freq(other, freq, c)
    return train, other


def _with_freq(df: DataFrame, freq: DataFrame, c: str) -> DataFrame:
    out = f"{c}__freq"
    if c not in df.columns:
        return df.withColumn(out, F.lit(0.0))
    right = freq.select(F.col("value").alias("__v"), F.col("freq").alias("__f"))
    joined = df.join(right, category(c) == F.col("__v"), "left")
    return joined.withColumn(out, F.coalesce("__f", F.lit(0.0))).drop(c, "__v", "__f")


def add_date_features(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Replace each column by <name>__year, __month, __day, __dayofweek and __is_missing_datetime; absent columns are missing throughout."""
    kinds = dict(df.dtypes)
    for c in names:
        t = to_timestamp(F.col(f"`{c}`"), kinds[c]) if c in kinds else F.lit(None).cast("timestamp")
        df = df.withColumns({f"{c}__{k}": v for k, v in date_parts(t).items()}).drop(c)
    return df


def medians(df: DataFrame, names: Sequence[str]) -> dict[str, float | None]:
    """Exact interpolated medians, all columns in one job."""
    return {c: q[0] for c, q in exact_quantiles(df, {c: number(df, c) for c in names}, [0.5]).items()}


def modes(df: DataFrame, names: Sequence[str]) -> dict[str, str | None]:
    """Most frequent value of each column as text, the smallest of equally frequent ones."""
    if not names:
        return {}
    return dict(zip(names, df.agg(*[F.mode(F.col(f"`{c}`").cast("string"), True) for c in names]).first()))


def impute(df: DataFrame, numbers: dict[str, float | None], texts: dict[str, str | None]) -> DataFrame:
    """Fill missing values with what medians() and modes() found; where these are unknown with 0 and an empty text."""
    cols = {c: F.coalesce(number(df, c), F.lit(0.0 if m is None else float(m))) for c, m in numbers.items()}
    cols |= {c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(m or "")) for c, m in texts.items()}
    return df.withColumns(cols) if cols else df


def one_hot_columns(train: DataFrame, name: str) -> list[str]:
    """The training table's values of a column in order, at most LOW_AT_MOST + 1 as only low-cardinality columns are encoded."""
    got = train.select(F.col(f"`{name}`").cast("string").alias("v")).where("v is not null").distinct().orderBy("v").limit(MEDIUM_AT_MOST + 1).collect()
    return [r[0] for r in got]


def one_hot(df: DataFrame, name: str, values: Sequence[str]) -> DataFrame:
    """Replace a column by <name>__<value>, 1 where it has the value; unknown values have zeros throughout."""
    text = F.col(f"`{name}`").cast("string")
    return df.withColumns({f"{name}__{v}": F.coalesce((text == v).cast("double"), F.lit(0.0)) for v in values}).drop(name)


@dataclass
class Assembler:
    """Imputation, one-hot and assembly, fitted on one table (a fold's training part, say) and applied to others."""

    numeric: Sequence[str]
    categories: Sequence[str]

    def fit(self, df: DataFrame) -> Assembler:
        self.numbers, self.texts = medians(df, self.numeric), modes(df, self.categories)
        clean = impute(df, self.numbers, self.texts)
        stages = []
        if self.categories:
            index, hot = [f"__i{k}" for k in range(len(self.categories))], [f"__h{k}" for k in range(len(self.categories))]
            stages.append(StringIndexer(inputCols=list(self.categories), outputCols=index, handleInvalid="keep", stringOrderType="alphabetAsc"))
            stages.append(OneHotEncoder(inputCols=index, outputCols=hot, dropLast=True))  # what is dropped is the slot of unknown values
            stages.append(VectorAssembler(inputCols=[*self.numeric, *hot], outputCol="features"))
        else:
            stages.append(VectorAssembler(inputCols=list(self.numeric), outputCol="features"))
        self.model = Pipeline(stages=stages).fit(clean)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(impute(df, self.numbers, self.texts))
        return out.drop(*[c for c in out.columns if c.startswith(("__i", "__h")) and c[3:].isdigit()])


@dataclass
class Frames:
    train: DataFrame
    other: DataFrame
    groups: Groups
    notes: list[str] = field(default_factory=list)

    def assembler(self) -> Assembler:
        return Assembler([c for c in self.groups.numeric + self.groups.encoded if c in self.train.columns], [c for c in self.groups.low if c in self.train.columns])


#: Adds columns to both tables: (train, other) -> (train, other, names of the new columns, notes).
Step = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame, list[str], list[str]]]


def prepare_frames(
    train: DataFrame, other: DataFrame, target: str, row_id: str | None, keep: Sequence[str] = (), text: bool = True, drop_id_like: bool = True, images: Step | None = None
) -> Frames:
    """Features of both tables, in this order: text, dates, cardinality, frequencies, dropped ids, shared columns.

    Classes are taken from both tables together; everything fitted is fitted on the training table alone. `keep` names
    further columns to carry along (the row order, the block) that aren't features. `images` adds features by the key
    columns, before any of these go. Numeric columns that are nearly all
    distinct count as ids and go, unless drop_id_like is off.
    """
    from tabloom.operators.text_features import add_text_features

    aside = [c for c in dict.fromkeys([target, row_id, ORD, *keep]) if c]
    names = [c for c in train.columns if c not in aside]
    both = train.select(*names).unionByName(other.select(*[c for c in other.columns if c not in aside]), allowMissingColumns=True)
    kinds = feature_types(both)
    groups, notes = Groups(text=kinds["text"], datetime=kinds["datetime"], numeric=kinds["numeric"]), []
    if not drop_id_like:
        numbers = [f for f, t in both.dtypes if f in kinds["id_like"] and t not in ("string", "timestamp", "date")]
        groups.numeric = groups.numeric + numbers
    ids = [c for c in kinds["id_like"] if c not in groups.numeric]
    if images:
        train, other, made, more = images(train, other)
        groups.encoded += made
        notes += more
    if text:
        train, other, made, more = add_text_features(train, other, groups.text)
        groups.encoded += made
        notes += more
    train, other = train.drop(*groups.text), other.drop(*groups.text)
    train, other = add_date_features(train, groups.datetime), add_date_features(other, groups.datetime)
    groups.encoded += [f"{c}__{k}" for c in groups.datetime for k in ("year", "month", "day", "dayofweek", "is_missing_datetime")]
    classes = cardinality(train, [c for c in kinds["categorical"] if c in train.columns])
    groups.low, groups.medium, groups.high, groups.dropped = classes["low"], classes["medium"], classes["high"], classes["dropped"] + ids
    train, other = frequency_encode(train, other, groups.medium + groups.high)
    groups.encoded += [f"{c}__freq" for c in groups.medium + groups.high]
    train, other = train.drop(*groups.dropped), other.drop(*groups.dropped)
    features = [c for c in train.columns if c in other.columns and c not in aside]
    pick = lambda df: df.select(*[F.col(f"`{c}`") for c in features], *[F.col(f"`{c}`") for c in aside if c in df.columns])
    return Frames(pick(train), pick(other), groups, notes)

