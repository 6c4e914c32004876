"""Operator 7: weighted rendezvous hashing of stable record keys over shards (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import gapless_rank, text_or_empty


def best_shard(key: Column, weights: Sequence[float], first: int = 0) -> Column:
    """struct(score, shard): the shard of lowest -ln(u) / weight, u in (0, 1) hashed from (key, shard).

    A shard's score doesn't depend on the other shards, so adding one only moves the rows that it wins, and a shard of
    weight w wins w / sum(weights) of the keys. Equal scores go to the smaller shard.
    """
    shards = F.array(*[F.struct(F.lit(first + i).alias("shard"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)])

    def score(s: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, s["shard"]), 11).cast("double") + 0.5) / float(1 << 53)
        return F.struct((-F.log(u) / s["w"]).alias("score"), s["shard"].alias("shard"))

    return F.array_min(F.transform(shards, score))


def rendezvous(df: DataFrame, key: str, weights: Sequence[float], grow_by: float | None = None) -> DataFrame:
    """Give each row a shard (0 .. len(weights) - 1) by its key, and with grow_by its shard once one more shard of
    that weight exists (grown_shard).

    Weights must be positive. Null keys are a key like any other (all go to one shard); equal keys share a shard; an
    empty table stays empty. Columns of df named shard or grown_shard are replaced, all others are kept.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    out = df.withColumn("__best", best_shard(F.col(key), weights))
    if grow_by is None:
        return out.withColumn("shard", F.col("__best.shard")).drop("__best")
    out = out.withColumn("__next", best_shard(F.col(key), [grow_by], first=len(weights)))
    grown = F.least("__best", "__next")["shard"]
    return out.withColumn("grown_shard", grown).withColumn("shard", F.col("__best.shard")).drop("__best", "__next")


def shard_documents(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All documents over equal shards, with one row per document: doc_id, size (UTF-8 bytes of the text plus 16),
    text_crc32, law (`key`), shard, slot (gapless from 0 within its shard) and grown_shard (with one more shard).

    Null texts count as empty (size 16, crc 0). Repeated rows each get their own slot. Only ids and numbers are
    shuffled, never texts, and no shard is ever gathered into one task.
    """
    t = F.encode(text_or_empty(text), "UTF-8")
    base = docs.select(F.col(key).alias("doc_id"), (F.octet_length(t) + 16).cast("long").alias("size"), F.crc32(t).alias("text_crc32"))
    placed = rendezvous(base, "doc_id", [1.0] * shards, grow_by=1.0)
    ranked = gapless_rank(placed, ["shard"], ["doc_id"], "slot")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
