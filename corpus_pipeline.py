"""A training-data pipeline over ``documents``.

Language ID, exact dedup, near-dedup and mixing each return rows of
``documents`` with its columns; the last stage packs what is left into
sequences of 1024 tokens.  Every stage works on all that its predecessor kept.

Nulls in any column, empty and very long texts, repeated rows, empty tables and
other columns, whatever their names, go through every stage; what becomes of such
rows is said with each.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rankmix.llm import exact_dedup, langid, mixing, near_dedup, packing
from rankmix.llm.queries import MIX
from rankmix.session import scratch_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts), or unlike every learned
    language, go; without any labelled text to learn from all do."""
    return langid.with_language(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays, of repeated rows one;
    a row without an id only where no equal text has one."""
    return exact_dedup.drop_copies(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more, one stays (rows without
    an id are linked too); documents without words are linked with nothing."""
    return near_dedup.drop_near_duplicates(docs, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """80 % of the tokens that are left, by the weights of the mixture; a null
    language or source is a leaf of its own, a document may come twice."""
    return mixing.mixed_documents(docs, **MIX)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 1024 tokens; a null
    text is empty, its piece the end id alone."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES = [("language_id", identify_language), ("exact_dedup", drop_exact_copies), ("near_dedup", drop_near_copies),
          ("mix_sources", mix_sources), ("packing", pack_sequences)]

# Languages, links and packing are not expressible in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared
    folder and read again as the next one's input."""
    base = f"{scratch_dir(spark, 'rankmix_llm')}/pipeline-{uuid.uuid4().hex[:12]}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}-{name}")
        docs = spark.read.parquet(f"{base}/{i}-{name}")
    return docs
