"""The queries of this subpackage, with production parameters, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioquarry.llm import ann, decontam, licenses, linededup, neardup, pieces, secret_scan, sharding, tokenbin, toxicity
from folioquarry.session import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op2_sentencepiece_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op3_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_order_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_groups(table(spark, sf_dir, "documents"))


def op5_sampled_splitter_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), shards=8)


def op6_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.token_file_digests(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op8_adaptive_scan_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op9_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_labels(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_forest,
        op2_sentencepiece_transducer,
        op3_cgk_decontamination,
        op4_order_minhash_groups,
        op5_sampled_splitter_shards,
        op6_toxicity_nnpu,
        op7_token_frames,
        op8_adaptive_scan_neighbours,
        op9_license_rules,
        op10_line_dedup,
    )
}

ORACLES: dict[str, str] = {"op10_line_dedup": linededup.ORACLE_SQL}
