"""Column types, roles of columns, targets. Facts about all columns come from one aggregation; rules run on the driver."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.scalar import normalize_name, to_number, to_timestamp
from tabloom.operators.ordering import ORD, head
from tabloom.operators.profile import TIME_TYPES, columns_of, decided_counts, value

# Names of row ids and targets, in order of preference.
ROW_ID_NAMES = ("row_id", "id", "record_id", "sample_id", "submission_id", "index")
TARGET_NAMES = ("target", "label", "y", "response", "outcome", "value", "rate", "score")


@dataclass
class ColumnFacts:
    name: str
    numeric: bool
    integer: bool
    time: bool
    count: int
    nunique: int
    mean_length: float
    max_length: int
    has_letters: float
    has_spaces: float
    parsed: float  # share of the first 50 present values that parse as times


#: Shares of distinct values at which a column's class changes.
SHARES = (0.9, 0.95)


def column_facts(df: DataFrame, exclude: Sequence[str] = ()) -> tuple[int, list[ColumnFacts]]:
    """Rows, and facts of each column."""
    fields = [f for f in columns_of(df) if f.name not in set(exclude)]
    texts = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(fields):
        v = value(df, f.name)
        aggs += [F.count(v).alias(f"c{i}")]
        if f.name in texts:
            aggs += [F.avg(F.length(v)).alias(f"m{i}"), F.max(F.length(v)).alias(f"x{i}"), F.avg(v.rlike("[A-Za-z]").cast("double")).alias(f"l{i}"), F.avg(v.rlike(r"\s").cast("double")).alias(f"s{i}")]
    got = df.agg(*aggs).first()
    plain = {f.name: value(df, f.name) for f in fields if not isinstance(f.dataType, (T.ArrayType, T.MapType))}
    distinct = decided_counts(df, plain, SHARES)[1] if plain else {}
    parsed = _parse_rates(df, texts)
    out = []
    for i, f in enumerate(fields):
        text = f.name in texts
        out.append(ColumnFacts(
            f.name, isinstance(f.dataType, (T.NumericType, T.BooleanType)), isinstance(f.dataType, T.IntegralType), isinstance(f.dataType, TIME_TYPES),
            got[f"c{i}"], distinct.get(f.name, 0), (got[f"m{i}"] or 0.0) if text else 0.0, (got[f"x{i}"] or 0) if text else 0,
            (got[f"l{i}"] or 0.0) if text else 0.0, (got[f"s{i}"] or 0.0) if text else 0.0, parsed.get(f.name, 0.0),
        ))
    return got["n"], out


def _parse_rates(df: DataFrame, names: Sequence[str], first: int = 50) -> dict[str, float]:
    """Share of each text column's first 50 present values that are times."""
    if not names:
        return {}
    if ORD not in df.columns:
        out = {}
        for c in names:
            few = df.where(F.col(f"`{c}`").isNotNull()).select(F.col(f"`{c}`").alias("v")).limit(first)
            out[c] = few.agg(F.avg(to_timestamp("v").isNotNull().cast("double"))).first()[0] or 0.0
        return out
    # the head holds the first present values of all columns but those that are seldom present, which have a scan of their own
    top = df.select(ORD, *[F.col(f"`{c}`") for c in names]).orderBy(ORD).limit(4 * first).collect()
    out = {}
    for c in names:
        present = [r[c] for r in top if r[c] is not None][:first]
        if len(present) < first and len(top) == 4 * first:
            rest = df.where(F.col(f"`{c}`").isNotNull()).select(F.col(f"`{c}`").alias("v"), ORD).orderBy(ORD).limit(first)
        else:
            rest = df.sparkSession.createDataFrame([(v,) for v in present], "v string")
        out[c] = rest.agg(F.avg(to_timestamp("v").isNotNull().cast("double"))).first()[0] or 0.0
    return out


def profile_types(df: DataFrame, exclude: Sequence[str] = ()) -> dict[str, list[str]]:
    """The profile's classes: numeric, categorical, text, datetime-like; id-like comes on top of them (a name that
    contains id, uuid or key, or over 90 % distinct)."""
    n, facts = column_facts(df, exclude)
    out: dict[str, list[str]] = {k: [] for k in ("numeric_columns", "categorical_columns", "text_columns", "datetime_like_columns", "id_like_columns")}
    for f in facts:
        if any(w in normalize_name(f.name) for w in ("id", "uuid", "key")) or f.nunique / max(n, 1) > 0.9:
            out["id_like_columns"].append(f.name)
        if f.numeric:
            kind = "numeric"
        elif f.time or f.parsed > 0.7:
            kind = "datetime_like"
        elif f.mean_length >= 50 or f.max_length >= 200:
            kind = "text"
        else:
            kind = "categorical"
        out[f"{kind}_columns"].append(f.name)
    return {k: sorted(v) for k, v in out.items()}


def is_id_like(name: str, nunique: int, n: int) -> bool:
    low = normalize_name(name)
    return low in ("row_id", "id", "uuid", "index") or low.endswith("_id") or (nunique / max(n, 1) > 0.95 and nunique > 20)


def looks_like_text(f: ColumnFacts, by_longest: bool = True) -> bool:
    wordy = f.mean_length >= 25 and f.has_letters > 0.5 and f.has_spaces > 0.2
    return f.mean_length >= 40 or (by_longest and f.max_length >= 120) or wordy


def feature_types(df: DataFrame, target: str | None = None, row_id: str | None = None) -> dict[str, list[str]]:
    """The features' classes, each column in one: id_like, numeric, datetime, text, categorical."""
    n, facts = column_facts(df, [c for c in (target, row_id) if c])
    out: dict[str, list[str]] = {k: [] for k in ("numeric", "categorical", "text", "datetime", "id_like")}
    for f in facts:
        if is_id_like(f.name, f.nunique, n):
            kind = "id_like"
        elif f.numeric:
            kind = "numeric"
        elif f.time or f.parsed > 0.7:
            kind = "datetime"
        else:
            kind = "text" if f.count and looks_like_text(f) else "categorical"
        out[kind].append(f.name)
    return out


def type_counts(df: DataFrame | None, table: str) -> dict:
    """How many columns of each kind a table has, and which are missing throughout, often, or nearly all distinct."""
    n, facts = column_facts(df) if df is not None else (0, [])
    if not n:
        return {"table": table, "rows": 0, "columns": 0}
    kinds = ["numeric" if f.numeric else "datetime_like" if f.time or f.parsed > 0.7 else "text" if f.count and looks_like_text(f, False) else "categorical" for f in facts]
    return {
        "table": table, "rows": n, "columns": len(facts), **{f"{k}_columns": kinds.count(k) for k in ("numeric", "categorical", "text", "datetime_like")},
        "all_missing_columns": sum(f.count == 0 for f in facts), "high_missing_columns": sum(f.count < 0.5 * n for f in facts),
        "high_cardinality_columns": sum(f.nunique / n > 0.95 and f.nunique > 20 for f in facts),
    }


def row_id_column(df: DataFrame | None, names: Sequence[str]) -> str | None:
    """A preferred name, else the first whole-number column without nulls or repeats in the head, else the first column."""
    by_name = {normalize_name(c): c for c in names}
    for want in ROW_ID_NAMES:
        if want in by_name:
            return by_name[want]
    if df is not None:
        n, facts = column_facts(head(df, 200))
        for f in facts:
            if f.integer and f.count == n == f.nunique:
                return f.name
    return names[0] if names else None


def is_placeholder(df: DataFrame, name: str) -> bool:
    """At least 80 % numbers, of at most two values: a column of predictions still to be filled."""
    x = to_number(name)
    share, distinct = df.agg(F.avg(x.isNotNull().cast("double")), F.count_distinct(x)).first()
    return (share or 0.0) >= 0.8 and distinct <= 2


def target_column(train: DataFrame | None, sample: DataFrame | None, row_id: str | None) -> str | None:
    """The sample's last numeric or placeholder column beside the row id, else its last; without a sample a train column
    by name, else the last numeric one."""
    if sample is not None and len(columns_of(sample)) >= 2:
        others = [f for f in columns_of(sample) if f.name != row_id]
        numbers = [f.name for f in others if isinstance(f.dataType, (T.NumericType, T.BooleanType)) or is_placeholder(sample, f.name)]
        return numbers[-1] if numbers else others[-1].name if others else None
    return _named_or_last_number(train, None, normalize=True)


def training_target(train: DataFrame, wanted: str | None, row_id: str | None) -> str | None:
    """The wanted column if the training table has it, else one of the usual names, else the last numeric one beside the row id."""
    if wanted and wanted in train.columns:
        return wanted
    return _named_or_last_number(train, row_id, normalize=False)


def _named_or_last_number(df: DataFrame | None, row_id: str | None, normalize: bool) -> str | None:
    if df is None:
        return None
    by_name = {normalize_name(f.name) if normalize else f.name: f.name for f in columns_of(df)}
    for want in TARGET_NAMES:
        if want in by_name:
            return by_name[want]
    numbers = [f.name for f in columns_of(df) if isinstance(f.dataType, (T.NumericType, T.BooleanType)) and f.name != row_id]
    return numbers[-1] if numbers else None


def submission_columns(sample: DataFrame | None, row_id: str | None, target: str | None) -> list[str]:
    """The row id and the target, or what the sample has where these aren't known."""
    if row_id and target:
        return [row_id, target]
    return [f.name for f in columns_of(sample)][:2] if sample is not None else [c for c in (row_id, target) if c]
