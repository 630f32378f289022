"""Documents to packed training sequences: each stage is written as Parquet and read again by the next.

run(spark, sf_dir) -> the pieces of the kept documents with their places in sequences.  No stage fails on nulls in any
column, empty or very long texts, repeated rows or ids, further columns or an empty table; its operator says what comes out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cubespark.llm import exact_dedup, langid, minhash, mixing, packing
from cubespark.llm._shared import written
from cubespark.llm.queries import tokenizer


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that are hardly more like one language than like any, and those without a letter (nulls too)."""
    return langid.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; rows of one id are judged each by its own text."""
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one document stays; documents without a doc_id all stay."""
    return minhash.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once at least, those of small sources again up to the target weights."""
    return mixing.mixed_rows(docs, target_entropy=0.95, max_repetition=2.0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids cut and packed into sequences of 4096."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("language", language_id), ("exact", exact), ("near", near), ("mix", mix), ("pack", pack)]

#: SQL has no word for language identification, MinHash classes or token ids; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
