"""Corpus pipeline: toxicity, quality rules, SimHash near-duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns a DataFrame; all but the last return
the columns of documents. Rows are judged and kept one by one, with all their columns: null and repeated ids, repeated rows and extra columns of any name
do no harm, and of each component of near-duplicates exactly one row stays. Null texts are judged as empty texts: they have no toxic clause and too few words to be kept.
Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from latticeweave.llm import packing, quality, simhash, toxicity
from latticeweave.llm.common import table
from latticeweave.operators.materialise import materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    learned = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), toxicity.learnable())
    return toxicity.keep(docs, learned)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("quality rules", drop_low_quality), ("SimHash near-dedup", drop_near_duplicates), ("packing", pack_sequences)]

#: SQL can't express the learned stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
