"""Scalar expressions: text statistics, dates, normalisers. All run inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What CSV readers take as missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
#: Digits that Python's str.isdigit counts beside decimal digits.
SUPERSCRIPTS = "²³¹⁰⁴-⁹₀-₉"
#: Timestamp formats in the order in which they are tried.
DATE_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "yyyyMMdd", "MMM d yyyy", "d MMM yyyy", "yyyy-MM"]
_NUMBER = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|(?i:inf|infinity|nan))\s*$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_name(value: str) -> str:
    """Lower case, runs of other than a-z and 0-9 as one underscore, none at the ends."""
    return re.sub(r"[^a-z0-9]+", "_", value.lower()).strip("_")


def normalized(c: Column | str) -> Column:
    """normalize_name() of a column's values."""
    return F.regexp_replace(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def squashed(c: Column | str) -> Column:
    """Lower case, only a-z and 0-9 kept."""
    return F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", "")


def missing(c: Column | str) -> Column:
    """Null for CSV's tokens of missing values, else the value."""
    return F.when(~_col(c).isin(NA_TOKENS), _col(c))


def is_finite(c: Column | str) -> Column:
    x = _col(c).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def not_nan(c: Column | str) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(_col(c)), _col(c))


def to_number(c: Column | str) -> Column:
    """A double where the whole text is a number, else null; Java's suffixes (5d, 5f) aren't numbers."""
    x = _col(c).cast("string")
    return not_nan(F.when(x.rlike(_NUMBER), F.trim(x).try_cast("double")))


def char_length(c: Column | str) -> Column:
    return F.length(F.coalesce(_col(c), F.lit(""))).cast("double")


def word_count(c: Column | str) -> Column:
    return F.regexp_count(F.coalesce(_col(c), F.lit("")), F.lit(r"(?U)\S+")).cast("double")


def _kept(c: Column | str, kind: str) -> Column:
    """How many characters are of a kind (a regex class's content): faster than counting matches one by one."""
    return F.length(F.regexp_replace(F.coalesce(_col(c), F.lit("")), f"[^{kind}]+", ""))


#: White space as Python's str.split knows it, for a regex class.
BLANKS = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def sentence_count(c: Column | str) -> Column:
    """Non-blank parts between runs of . ! and ?, at least one unless the text is blank. A part is found by its first
    character that isn't blank."""
    x = F.coalesce(_col(c), F.lit(""))
    parts = F.regexp_count(x, F.lit(rf"[^.!?{BLANKS}][^.!?]*"))
    return F.when(x.rlike(r"(?U)\S"), F.greatest(parts, F.lit(1))).otherwise(F.lit(0)).cast("double")


def digit_count(c: Column | str) -> Column:
    return _kept(c, rf"\p{{Nd}}{SUPERSCRIPTS}").cast("double")


def punctuation_count(c: Column | str) -> Column:
    return F.regexp_count(F.coalesce(_col(c), F.lit("")), F.lit(r"(?U)[^\p{L}\p{N}\s]")).cast("double")


def uppercase_ratio(c: Column | str) -> Column:
    letters = _kept(c, r"\p{L}")
    return F.when(letters > 0, _kept(c, r"\p{Lu}") / letters).otherwise(F.lit(0.0))


def is_blank(c: Column | str) -> Column:
    return F.coalesce(~_col(c).rlike(r"(?U)\S"), F.lit(True)).cast("double")


#: Name: statistic of a text column.
TEXT_STATS = {
    "char_len": char_length, "word_count": word_count, "sentence_count": sentence_count, "digit_count": digit_count,
    "punctuation_count": punctuation_count, "uppercase_ratio": uppercase_ratio, "is_missing": is_blank,
}


def to_timestamp(c: Column | str, kind: str = "string") -> Column:
    """Dates and times of several formats; what none fits is null. Numbers count nanoseconds since 1970, as table
    readers take them."""
    x = _col(c)
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return x.cast("timestamp")
    if kind != "string":
        return F.timestamp_micros((x.cast("double") / 1000).cast("bigint"))
    return F.coalesce(*[F.try_to_timestamp(F.trim(x), F.lit(f)) for f in DATE_FORMATS])


def date_parts(c: Column) -> dict[str, Column]:
    """Year, month, day, day of week (Monday 0) and whether it's missing, as doubles."""
    parts = {"year": F.year(c), "month": F.month(c), "day": F.dayofmonth(c), "dayofweek": F.weekday(c), "is_missing_datetime": c.isNull()}
    return {k: v.cast("double") for k, v in parts.items()}


def month_period(c: Column) -> Column:
    """yyyy-MM; the missing are the period NaT."""
    return F.coalesce(F.date_format(c, "yyyy-MM"), F.lit("NaT"))


def row_bucket(key: Column | str, k: int | Column) -> Column:
    """A fold 0 .. k-1 by the key's md5, the same in every engine; k may differ by row."""
    return F.pmod(F.conv(F.substring(F.md5(_col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint"), k if isinstance(k, Column) else F.lit(k)).cast("int")
