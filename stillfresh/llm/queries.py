"""The registered training-data queries and, where SQL can express them, their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, mixing, negatives, ngram_join, packing, pfor, quality, ring, secrets, sentences, topk, toxicity, url_rules
from .common import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_digest(read_table(spark, sf_dir, "documents"))


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.repeats_digest(read_table(spark, sf_dir, "documents"))


def op2_all_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.repeats_digest(read_table(spark, sf_dir, "documents"), span=None)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_probabilities(read_table(spark, sf_dir, "documents"))
    return mixed.withColumn("probability", F.round("probability", 9))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfor.token_id_digest(read_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_digest(read_table(spark, sf_dir, "documents"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(read_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(read_table(spark, sf_dir, "pages"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(read_table(spark, sf_dir, "embeddings"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read_table(spark, sf_dir, "embeddings"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.sharding_digest(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_topk_search": op1_topk_search,
    "op2_substring_dedup": op2_substring_dedup,
    "op2_all_repeats": op2_all_repeats,
    "op3_mixing": op3_mixing,
    "op4_token_ids": op4_token_ids,
    "op5_secret_scans": op5_secret_scans,
    "op6_toxicity": op6_toxicity,
    "op7_packing": op7_packing,
    "op8_quality_rules": op8_quality_rules,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_url_filters": op10_url_filters,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_sharding": op13_sharding,
}

ORACLE_SQL: dict[str, str] = {
    "op1_topk_search": topk.ORACLE_SQL,
    "op2_substring_dedup": sentences.oracle_sql(),
    "op3_mixing": mixing.oracle_sql(),
    "op11_hard_negatives": negatives.ORACLE_SQL,
    "op12_centroid_clustering": centroids.oracle_sql(),
}
