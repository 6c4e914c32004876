"""Image sidecar files: their names' tokens, and pixel statistics where a decoder is installed."""

from __future__ import annotations

import hashlib
import io
import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.scalar import squashed

SUFFIXES = ("png", "jpg", "jpeg", "webp")
STATS = ("width", "height", "aspect_ratio", "brightness_mean", "brightness_std", "brightness_min", "brightness_max", "contrast", "red_mean", "green_mean", "blue_mean", "red_std", "green_std", "blue_std")


def find_images(spark: SparkSession, folder: str) -> DataFrame:
    """path, stem (lower-cased name without suffix), norm (only a-z and 0-9 of it) and tokens of all images below a
    folder. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    files = files.where(F.lower("path").rlike(rf"\.({'|'.join(SUFFIXES)})$"))
    return with_tokens(files)


def with_tokens(files: DataFrame) -> DataFrame:
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return files.select("path", stem.alias("stem"), squashed(stem).alias("norm"), F.array_distinct(F.filter(F.split(stem, "[^a-z0-9]+"), lambda t: t != "")).alias("tokens"))


def signature(images: DataFrame) -> str:
    """A SHA-1 over the SHA-1 hashes of all paths in order: changes when files come or go (copies count), not when their contents do, nor with
    the partitioning. The list is never gathered: hashes of one beginning are hashed together, then those hashes, then again."""
    level = images.select(F.sha1("path").alias("h")).withColumn("at", F.col("h"))
    for digits in (4, 2, 0):  # 65,536 parts, 256, one
        level = level.groupBy(F.substring("at", 1, digits).alias("at")).agg(F.sha1(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda x: x["h"]))).alias("h"))
    found = level.first()
    return found["h"] if found else hashlib.sha1(b"").hexdigest()


def decoder():
    """bytes -> RGB array in 0..1, or None if no image library is installed."""
    try:
        from PIL import Image
    except ImportError:
        return None

    def decode(content: bytes) -> np.ndarray:
        return np.asarray(Image.open(io.BytesIO(content)).convert("RGB"), float) / 255

    return decode


def pixel_stats(x: np.ndarray) -> dict[str, float]:
    """Size and brightness of an RGB array in 0..1, and mean and deviation of each channel."""
    grey = x.mean(axis=2)
    h, w = grey.shape
    out = [w, h, w / h, grey.mean(), grey.std(), grey.min(), grey.max(), grey.max() - grey.min(), *x.mean(axis=(0, 1)), *x.std(axis=(0, 1))]
    return dict(zip(STATS, map(float, out)))


def image_stats(spark: SparkSession, images: DataFrame, decode=None) -> DataFrame:
    """path and STATS of the images that can be decoded. decode must be picklable; by default it is decoder()."""
    decode = decode or decoder()
    if decode is None:
        return images.select("path", *[F.lit(0.0).alias(c) for c in STATS]).limit(0)
    if "content" not in images.columns:
        raise ValueError("images need their content")

    def run(frames):
        for f in frames:
            rows = []
            for path, raw in zip(f["path"], f["content"]):
                try:
                    rows.append({"path": path, **pixel_stats(decode(bytes(raw)))})
                except (OSError, ValueError):
                    continue
            yield pd.DataFrame(rows, columns=["path", *STATS])

    return images.select("path", "content").mapInPandas(run, "path string, " + ", ".join(f"{c} double" for c in STATS))


# keys' values that say nothing.
BLANK_TOKENS = ("", "nan", "none", "null", "na", "n_a", "nat", "missing", "unknown")


def weak(token: Column, column: str, only_key: bool) -> Column:
    """Tokens that could match anything: blanks, numbers of up to two digits, row ids of up to four digits, and any row
    id unless it is the only key."""
    number = token.rlike(r"^\d+$")
    out = token.isin(*BLANK_TOKENS) | (number & (F.length(token) <= 2))
    if column == "row_id":
        out = out | (number & (F.length(token) <= 4)) | F.lit(not only_key)
    return out


def row_tokens(df: DataFrame, keys: Sequence[str]) -> Column:
    """The informative tokens of a row's key values."""
    each = []
    for k in keys:
        t = squashed(F.col(f"`{k}`").cast("string"))
        each.append(F.when(t.isNotNull() & ~weak(t, k, len(keys) == 1), t))
    return F.array_distinct(F.array_compact(F.array(*each)))


#: Lengths of the pieces of names that are indexed. A token is looked up by pieces of the largest of these that it has.
PIECES = (1, 2, 3, 6, 12)


def _cut(c: Column, n: int) -> Column:
    """All pieces of n letters."""
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, n))).otherwise(F.array().cast("array<string>"))


def _lookups(token: Column) -> Column:
    """The pieces by which a token can be looked up: it's contained in a name only if all of them are."""
    out = _cut(token, PIECES[0])
    for n in PIECES[1:]:
        out = F.when(F.length(token) >= n, _cut(token, n)).otherwise(out)
    return out


def candidate_pairs(sets: DataFrame, images: DataFrame) -> DataFrame:
    """sets (want: tokens) with each image that has the rarest piece of all pieces of its tokens; sets of which a piece is in no name have none.

    Names are indexed by their pieces (a posting for each), and a piece's frequency is the length of its postings, so a set meets
    no more images than hold its rarest piece. Postings are shuffled, never broadcast: compressed they look small, but they are many times the names."""
    pieces = F.array_distinct(F.flatten(F.array(*[_cut(F.col("norm"), n) for n in PIECES])))
    frequency = images.select(F.explode(pieces).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))
    asked = sets.select("want", F.explode(F.array_distinct(F.flatten(F.transform("want", _lookups)))).alias("piece"))
    rarest = asked.hint("shuffle_merge").join(frequency.hint("shuffle_merge"), "piece", "left").groupBy("want").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("piece"))).alias("least"))
    looked = rarest.where("least.n > 0").select("want", F.col("least.piece").alias("piece"))
    posted = images.withColumn("piece", F.explode(pieces))
    return looked.hint("shuffle_merge").join(posted.hint("shuffle_merge"), "piece").drop("piece")


def match_images(rows: DataFrame, key: str, keys: Sequence[str], images: DataFrame) -> DataFrame:
    """key, path, candidates: the one image all of whose row's tokens match (a token of the name, or contained in the
    squashed or raw name). Rows with none or several have no path.

    Rows are reduced to their distinct token sets, which are looked up in an index of the names' pieces; the rest of the test is a filter.
    """
    tokens = row_tokens(rows, keys)
    wanted = rows.select(F.col(key).alias("key"), tokens.alias("want")).where(F.size("want") > 0).withColumn("want", F.array_sort("want"))
    hit = F.forall("want", lambda t: F.array_contains("tokens", t) | F.contains("norm", t) | F.contains("stem", t))
    pairs = candidate_pairs(wanted.select("want").distinct(), images).where(hit)
    found = pairs.groupBy("want").agg(F.count_distinct("path").alias("candidates"), F.min("path").alias("path"))
    out = wanted.hint("shuffle_merge").join(found.hint("shuffle_merge"), "want", "left")
    return out.select("key", F.when(F.col("candidates") == 1, F.col("path")).alias("path"), F.coalesce("candidates", F.lit(0)).alias("candidates"))


MATCHED_AT_LEAST = 0.3


def image_features(spark: SparkSession, rows: DataFrame, key: str, keys: Sequence[str], images: DataFrame, contents: DataFrame | None = None, decode=None) -> tuple[DataFrame, list[str], str | None]:
    """(rows with image__<stat> columns, their names, why there are none): skipped if under 30 % of the rows have an
    image, or none can be decoded; rows without one have zeros."""
    found = match_images(rows, key, keys, images)
    n = rows.count()
    matched = found.where("path is not null").count()
    if not n or matched < MATCHED_AT_LEAST * n:
        return rows, [], f"images skipped: {matched} of {n} rows have exactly one"
    if decode is None and decoder() is None:
        return rows, [], "images skipped: no decoder is installed"
    stats = image_stats(spark, contents if contents is not None else images, decode)
    names = [f"image__{c}" for c in STATS]
    right = found.where("path is not null").join(stats, "path").select(F.col("key").alias("__key"), *[F.col(c).alias(f"image__{c}") for c in STATS])
    joined = rows.join(right, F.col(key) == F.col("__key"), "left").drop("__key")
    return joined.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in names}), names, None


def cached_features(spark: SparkSession, folder: str, images: DataFrame, about: dict, make) -> DataFrame:
    """The features that make() computes, from a Parquet cache below `folder` if it was written for the same images and
    the same `about` (row counts, key columns, folder); else they are made and written anew."""
    want = {**about, "images": signature(images)}
    meta = f"{folder.rstrip('/')}/meta"
    try:
        known = json.loads(spark.read.text(meta, wholetext=True).first()[0])
    except AnalysisException:  # nothing cached yet
        known = None
    if known != want:
        make().write.mode("overwrite").parquet(f"{folder.rstrip('/')}/features")
        spark.createDataFrame([(json.dumps(want),)], "value string").coalesce(1).write.mode("overwrite").text(meta)
    return spark.read.parquet(f"{folder.rstrip('/')}/features")
