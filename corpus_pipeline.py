"""From raw documents to token ids: quality rules, near-duplicates, repeated passages, mixing, encoding.

Defined cases: null and empty texts fail the quality rules (fewer than 50 words) and go; of equal texts, repeated
rows and ties one row stays; a text that is all repeated passages stays, empty; a null source is a source
of its own, the last; an empty table gives an empty result; extra columns of documents go through to the
last stage, which returns its own columns.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tendersieve.llm.common import materialize
from tendersieve.llm.mixing import mix
from tendersieve.llm.near_dedup import keep_one
from tendersieve.llm.pieces import encode_documents
from tendersieve.llm.quality_rules import quality_rules
from tendersieve.llm.suffix_dedup import suffix_dedup

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules(docs).where("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages; n_chars follows."""
    return suffix_dedup(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "source", "n_pieces", "ids_crc32", "decoded_ok", "ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("minhash_near_dedup", near_dedup),
    ("suffix_array_dedup", passages),
    ("mixing", mixing),
    ("sentencepiece", encoding),
]

#: Suffix arrays and Poisson processes are beyond SQL; brute-force tests check the stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and reread as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
