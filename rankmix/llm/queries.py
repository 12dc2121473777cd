"""The registered queries of this package, ``opN_<name>(spark, sf_dir)``."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmix.llm import (conversation_trie, exact_dedup, langid, line_dedup, mixing, near_dedup, packing, pii, quality,
                         substring_dedup, token_counts, token_files, whitening)
from rankmix.llm.common import documents
from rankmix.llm.oracle import OP3, OP8, op6, op10
from rankmix.session import scratch_dir


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"),
                                  end_id=2, capacity=1024)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_dir(spark, 'rankmix_llm')}/token-files-{uuid.uuid4().hex[:12]}"
    token_files.write_token_files(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_files.read_documents(spark, path)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir), keep="largest")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(documents(spark, sf_dir)).drop("cost")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), percent=85)


# Production parameters of the mixture: budget in percent of the corpus, weights by level (others: 1).
MIX = {"budget_percent": 80, "max_epochs": 2, "seed": 42,
       "weights": {"domain": {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1},
                   "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}, "source": {"src0": 2}}}


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), **MIX)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = quality.quality_rules(documents(spark, sf_dir), labels, alpha=0.05, delta=0.05)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       "base_failed", "kept")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.line_dedup(documents(spark, sf_dir), min_docs=10, min_chars=1)
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(documents(spark, sf_dir))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.substring_dedup(documents(spark, sf_dir), window=13)
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_trie.conversation_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return conversation_trie.prefix_trie(conversation_trie.shared_heads(turns, group=5, spread=9))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=4, scale=256)


QUERIES = {f.__name__: f for f in (
    op1_best_fit_packing, op2_token_files, op3_exact_dedup, op4_language_id, op5_near_dedup, op6_mix_sources, op7_quality_rules,
    op8_line_dedup, op9_token_counts, op10_pii, op11_substring_dedup, op12_conversation_trie,
    op13_embedding_whitening)}
ORACLE_SQL = {"op3_exact_dedup": OP3, "op6_mix_sources": op6(**MIX), "op8_line_dedup": OP8,
              "op10_pii": op10()}
