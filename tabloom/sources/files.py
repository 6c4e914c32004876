"""Reading folders of CSV files, descriptions and JSON, and writing artifacts."""

from __future__ import annotations

import csv
import io
import json
import math
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.scalar import missing, to_number
from tabloom.operators.ordering import ORD, head
from tabloom.operators.profile import rounded
from tabloom.sources.records import charset_of, fields, read_records, splits_of

# Where a description is looked for, in this order.
DESCRIPTIONS = ("DATA_DESCRIPTION.md", "Data_Description.md", "data_description.md", "README.md")
SCHEMA_ROWS = 200_000
_WHOLE = r"^\s*[+-]?\d{1,18}\s*$"


def data_dir(root: str | Path) -> Path:
    return Path(root) / "data"


def artifacts_dir(root: str | Path) -> Path:
    out = Path(root) / "artifacts"
    out.mkdir(parents=True, exist_ok=True)
    return out


@contextmanager
def scratch_folder(spark: SparkSession) -> Iterator[str]:
    """A folder that the driver and all executors see (below spark.checkpoint.dir; a local one where that is unset), deleted in the end."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = f"{(shared or 'file://' + tempfile.gettempdir()).rstrip('/')}/tabloom-{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def find_csv_files(folder: str | Path) -> list[Path]:
    """All CSV files below a folder, sorted by path; none if it isn't there."""
    folder = Path(folder)
    return sorted(p for p in folder.rglob("*.csv") if p.is_file()) if folder.is_dir() else []


def _names(header: Sequence[str | None]) -> list[str]:
    """Names of a header's values as Spark's reader makes them: those without one are numbered, repeated ones get their place."""
    lower = [(h or "").lower() for h in header]
    return [f"_c{i}" if not h else f"{h}{i}" if lower.count(h.lower()) > 1 else h for i, h in enumerate(header)]


def read_raw(spark: SparkSession, path: str, multi_line: bool = True, most: int | None = None) -> DataFrame:
    """All columns as text, missing tokens as null, and __ord, which rises with the row's place in the file; with `most` only so many
    first rows. An empty file has no column but __ord.

    Values may hold line ends, whichever task they fall to; files without such values go through Spark's reader of lines.
    multi_line=False spares the scan that looks for them.
    """
    splits = splits_of(spark, path) if multi_line else []
    if multi_line and (most is not None or any(s.spans for s in splits) or all(s.first is None for s in splits)):
        found, header = read_records(spark, path, most, splits)
        if header is None:
            return spark.createDataFrame([], f"{ORD} bigint")
        names = _names(next(csv.reader(io.StringIO(header, newline=""))))
        values = found.select("id", fields(F.col("record"), len(names)).alias("v"))
        df = values.select(*[F.col(f"v.c{i}").alias(c) for i, c in enumerate(names)], F.col("id").alias(ORD))
    else:
        df = spark.read.options(header="true", escape='"', encoding=charset_of(splits)).csv(path).withColumn(ORD, F.monotonically_increasing_id())
        df = head(df, most) if most is not None else df
    columns = [c for c in df.columns if c != ORD]
    return df.select(*[missing(F.col(f"`{c}`")).alias(c.strip()) for c in columns], ORD)


def inferred(df: DataFrame) -> dict[str, str]:
    """Type of each text column by all its values: boolean, bigint, double or string; columns without values are double.
    One aggregation."""
    names = [c for c in df.columns if c != ORD]
    if not names:
        return {}
    aggs = []
    for i, c in enumerate(names):
        x = F.col(f"`{c}`")
        fits = {"b": x.isin("True", "False", "TRUE", "FALSE", "true", "false"), "w": x.rlike(_WHOLE), "d": to_number(x).isNotNull()}
        aggs += [F.count(x).alias(f"n{i}"), *[F.count(F.when(f, 1)).alias(f"{k}{i}") for k, f in fits.items()]]
    r = df.agg(*aggs).first()

    def kind(i: int) -> str:
        n = r[f"n{i}"]
        if not n:
            return "double"
        return "boolean" if r[f"b{i}"] == n else "bigint" if r[f"w{i}"] == n else "double" if r[f"d{i}"] == n else "string"

    return {c: kind(i) for i, c in enumerate(names)}


def typed(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    def cast(c: str) -> Column:
        x = F.col(f"`{c}`")
        return {"string": lambda: x, "double": lambda: to_number(x), "bigint": lambda: F.trim(x).cast("bigint"), "boolean": lambda: x.cast("boolean")}[kinds[c]]()

    return df.select(*[cast(c).alias(c) if c in kinds else F.col(f"`{c}`") for c in df.columns])


def read_csv(spark: SparkSession, path: str | Path, multi_line: bool = True) -> DataFrame:
    """A CSV file with inferred types and its row order in __ord."""
    raw = read_raw(spark, str(path), multi_line)
    return typed(raw, inferred(raw))


def read_csv_head(spark: SparkSession, path: str | Path, n: int = 200) -> DataFrame:
    """The first n rows, typed by these rows alone."""
    raw = read_raw(spark, str(path), most=n)
    return typed(raw, inferred(raw))


def read_csv_for_schema(spark: SparkSession, path: str | Path, most: int = SCHEMA_ROWS) -> DataFrame:
    """Up to `most` first rows, for the search of join keys."""
    raw = read_raw(spark, str(path), most=most)
    return typed(raw, inferred(raw))


def count_csv_rows(spark: SparkSession, path: str | Path) -> int | None:
    """Physical lines less the header, 0 at least; None if the file can't be read."""
    if not Path(path).is_file():
        return None
    return max(spark.read.text(str(path)).count() - 1, 0)


def read_text(path: str | Path) -> str:
    """A whole text file as UTF-8, else latin-1; an absent file is empty."""
    path = Path(path)
    if not path.is_file():
        return ""
    raw = path.read_bytes()
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def find_description(folder: str | Path) -> Path | None:
    """A description by its usual names, else the first Markdown file with `description` in its name, else the first."""
    folder = Path(folder)
    for name in DESCRIPTIONS:
        if (folder / name).is_file():
            return folder / name
    found = sorted(folder.rglob("*.md")) if folder.is_dir() else []
    return next((p for p in found if "description" in p.name.lower()), found[0] if found else None)


def read_description(folder: str | Path) -> str:
    path = find_description(folder)
    return read_text(path) if path else ""


def read_json(path: str | Path) -> dict:
    """A JSON object; {} if the file is absent or isn't one."""
    try:
        out = json.loads(read_text(path) or "{}")
    except ValueError:
        return {}
    return out if isinstance(out, dict) else {}


def plain(x):
    """What JSON can hold: non-finite numbers become null, sets lists, other things text."""
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)):
        return [plain(v) for v in x]
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    return x if x is None or isinstance(x, (str, int, bool)) else str(x)


def write_json(x, path: str | Path) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(plain(x), indent=2, ensure_ascii=False))


def write_text(text: str, path: str | Path) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text)


def write_csv(df: DataFrame, path: str | Path, digits: int | None = None, columns: Sequence[str] | None = None) -> None:
    """One CSV file in the frame's order, streamed row by row through the driver, never held there whole."""
    df = df.select(*columns) if columns else df.drop(ORD)
    df = rounded(df, digits) if digits is not None else df
    quote = lambda v: "" if v is None else '"' + s.replace('"', '""') + '"' if any(ch in (s := str(v)) for ch in ',"\n\r') else s
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(",".join(quote(c) for c in df.columns) + "\n")
        for row in df.toLocalIterator(prefetchPartitions=True):
            f.write(",".join(quote(v) for v in row) + "\n")


def write_predictions(predictions: DataFrame, path: str | Path, row_id: str, target: str) -> None:
    """The two columns in the sample's row order."""
    write_csv(predictions.orderBy(ORD), path, columns=[row_id, target])


def role_path(summary: dict, role: str) -> str | None:
    """The file that plays a role, by the summary's roles, else by its list of files."""
    chosen = summary.get("roles", {}).get(role)
    if chosen:
        return chosen.get("path") if isinstance(chosen, dict) else chosen
    return next((f.get("path") for f in summary.get("files", []) if f.get("role") == role), None)
