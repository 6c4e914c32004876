"""The corpus pipeline: five stages over documents, each calling one operator of tabloom.llm.

Every stage but the last returns the columns of its input; n_chars follows the text where a stage changes it. Further columns,
whatever their names (but for a leading __), are handed through unchanged. Empty tables stay empty, repeated rows are rows like any
others, and texts of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import line_dedup, mixing, packing, quality, simhash
from tabloom.llm.common import materialize, table
from tabloom.llm.queries import TOKENIZER

#: Documents are rejected if they are likelier bad than good.
REJECT_BELOW = 0.5
#: Near copies: at least 0.8 of the five-word shingles of both texts together (Jaccard) are shared. Compared are texts that
#: share a sketch and whose fingerprints differ in at most 18 of 64 bits; at 0.8 they differ in 9.7 on average.
NEAR = {"words": 5, "budget": 18, "similar": 0.8}
#: Share of all tokens that the mixed sample keeps.
KEEP = 0.9


def _on(docs: DataFrame, used: list[str], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """step, which sees only the columns `used` of docs; the others are carried along in a struct, so that no name clashes."""
    others = [c for c in docs.columns if c not in used]
    out = step(docs.select(*used, F.struct(*others).alias("__others"))) if others else step(docs)
    return out.select(*[F.col(f"__others.{c}") if c in others else F.col(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose line labels, by the CRF, make them likelier bad than good.

    A null text is judged as an empty one, and equal texts alike. Without labels every score is 0.5, and all documents stay.
    """
    model = quality.fit_documents(docs, table(spark, sf_dir, "labels"), quality.hash_mod("doc_id", 4) != 2)
    return _on(docs, ["text"], lambda d: quality.score_documents(d, model, out="__score").where(F.col("__score") >= REJECT_BELOW))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that too many of a source's different texts hold; the documents stay.

    Null texts stay null, a null source is a source of its own; n_chars changes only where lines go.
    """

    def step(d: DataFrame) -> DataFrame:
        n = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
        return line_dedup.drop_site_boilerplate(d).withColumn("n_chars", n)

    return _on(docs, ["source", "text", "n_chars"], step)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, of the smallest doc_id, of each group of exact and near copies.

    Null and empty texts are copies of each other; rows that repeat a doc_id all stay or go, rows without one stay.
    """
    return _on(docs, ["doc_id", "text"], lambda d: simhash.keep_one(d, **NEAR))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents by probabilities that bring sources, languages and topics to their target shares.

    Null sources and languages are values of their own; rows of one doc_id share their fate; documents without words stay.
    """
    return _on(docs, ["doc_id", "text", "lang", "source"], lambda d: mixing.mix_documents(d, keep=KEEP).where("kept"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of at most 1024 tokens; null and empty texts are an end token each."""
    return packing.pack(docs.select("doc_id", "text"), *TOKENIZER)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_dedup_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can express neither the CRF nor XXH64 fingerprints nor the tokenizer: tests/llm/test_pipeline.py compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each one's rows written as Parquet and read again as the next one's docs."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
