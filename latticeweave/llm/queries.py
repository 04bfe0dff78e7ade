"""The queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, embedding_dedup, license_scan, lm_score, packing, quality, sharding, simhash, toxicity, url_filter
from .common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digest(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.judge(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.learnable()))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op2, which SQL can express."""
    return op2_license_scan(spark, sf_dir).drop("labels", "score")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op3, which SQL can express."""
    return op3_quality_rules(spark, sf_dir).drop("kept", "score")


QUERIES = {f.__name__: f for f in (op1_packing, op2_license_scan, op3_quality_rules, op4_url_filter, op5_sharding, op6_byte_bpe, op7_simhash, op8_embedding_dedup, op9_toxicity, op10_lm_score, license_base, quality_base)}
ORACLE_SQL: dict[str, str] = {
    "op4_url_filter": url_filter.ORACLE_SQL, "op5_sharding": sharding.ORACLE_SQL, "op8_embedding_dedup": embedding_dedup.ORACLE_SQL,
    "license_base": license_scan.BASE_SQL, "quality_base": quality.BASE_SQL,
}
