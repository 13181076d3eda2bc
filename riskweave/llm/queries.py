"""Queries opN_<name> of the operators, with production parameters, over whole tables; and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, language_id, license_scan, mixing, ngram_join, packing, substring_dedup, token_output, topk_search, toxicity
from ._spark import read


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.select(read(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.spans(read(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(read(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.spans(read(spark, sf_dir, "documents"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors whose id is divisible by 20 are the queries, against all vectors."""
    vectors = read(spark, sf_dir, "embeddings")
    return ann.neighbors(vectors, vectors.where("vec_id % 20 = 0"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.output(read(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_topk_search, op2_mixing, op3_packing, op4_language_id, op5_ngram_jaccard_join, op6_substring_dedup, op7_nearest_neighbours, op8_toxicity, op9_token_output, op10_license_scan)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_topk_search": topk_search.oracle(),
        "op2_mixing": mixing.oracle(),
        "op3_packing": packing.oracle(),
        "op5_ngram_jaccard_join": ngram_join.oracle(),
        "op6_substring_dedup": substring_dedup.oracle(),
        "op10_license_scan": license_scan.oracle(),
    }
