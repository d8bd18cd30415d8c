"""The contract queries of this subpackage: thin wrappers that apply an operator to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, divergence, embedding_dedup, flac, jaccard_join, language_id, line_dedup, mixing, neighbours, packing, pii, quality, suffix_dedup
from .common import documents

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(spark: SparkSession, name: str = TOKENIZER) -> str:
    """Where a public tokenizer's file lies: in the folder that the session's spark.lockstep.tokenizers names, else where its package has it."""
    folder = spark.conf.get("spark.lockstep.tokenizers", None)
    if not folder:
        import public_tokenizers
    return os.path.join(folder, name) if folder else public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path(spark))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(documents(spark, sf_dir))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.evaluated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.evaluated(documents(spark, sf_dir))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(documents(spark, sf_dir))


def op7_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.features(documents(spark, sf_dir))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components_of(documents(spark, sf_dir))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(documents(spark, sf_dir))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(documents(spark, sf_dir))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.evaluated(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_pii": op2_pii,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_quality": op4_quality,
    "op5_language_id": op5_language_id,
    "op6_line_dedup": op6_line_dedup,
    "op7_flac": op7_flac,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_mixing": op10_mixing,
    "op11_divergence": op11_divergence,
    "op12_collocations": op12_collocations,
    "op13_neighbours": op13_neighbours,
}

ORACLES: dict[str, str] = {
    "op2_pii": pii.ORACLE,
    "op3_suffix_dedup": suffix_dedup.ORACLE,
    "op6_line_dedup": line_dedup.ORACLE,
    "op8_jaccard_join": jaccard_join.ORACLE,
    "op9_embedding_dedup": embedding_dedup.ORACLE,
    "op10_mixing": mixing.ORACLE,
    "op11_divergence": divergence.ORACLE,
    "op12_collocations": collocations.ORACLE,
    "op13_neighbours": neighbours.ORACLE,
}
