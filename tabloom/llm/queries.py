"""The registered queries of this subpackage, each one operator over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import ann, collocations, fim, licenses, line_dedup, lm_scoring, media, mixing, packing, quality, secrets, sharding, simhash
from tabloom.llm.common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_digests(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_site_boilerplate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "n_lines", "n_dropped")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = quality.hash_mod("doc_id", 5) == 1
    out = lm_scoring.score_texts(docs.withColumn("held_out", held_out), ~held_out)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


#: Tokenizer of the packed ids: its file, the same vocabulary as ranks, and its pattern.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), *TOKENIZER)


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_documents(table(spark, sf_dir, "documents"), columns=["doc_id", "source", "lang"])
    rounded = [F.round("weight", 6).alias("weight"), F.round("prob", 6).alias("prob")]
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", *rounded, "kept")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source stands for an owner, its texts in one language for a repository."""
    repo = F.concat_ws("/", "source", F.coalesce("lang", F.lit("")))
    return secrets.document_digests(table(spark, sf_dir, "documents"), repo=repo)


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fill_in_middle(table(spark, sf_dir, "documents")).drop("output")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    first = (op1_quality, op2_media, op3_line_dedup, op4_lm_scoring, op5_packing, op6_ann, op7_sharding, op8_mixing, op9_licenses, op10_simhash)
    return {f.__name__: f for f in (*first, op11_secrets, op12_fim, op13_collocations)}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": line_dedup.oracle(), "op8_mixing": mixing.oracle(), "op11_secrets": secrets.oracle(), "op12_fim": fim.ORACLE, "op13_collocations": collocations.ORACLE}
