"""A corpus pipeline over `documents`: quality, near duplicates, benchmark passages, mixture, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs of
the next. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docquarry.llm import decontaminate, mixing, near_dups, quality, sharding
from docquarry.llm.common import dropped, table, written


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level convolutional network rejects go; a null text is judged as an empty one."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest doc_id. Null and blank texts, and rows
    without a doc_id, stay; of rows with one doc_id the least by content stays."""
    return near_dups.deduplicated(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; of the others, words inside benchmark windows are cut out. Null texts have no words and stay."""
    return decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the target weights of domains, languages and sources take; null ones count as (none)."""
    return mixing.mixed(docs)


def shard_assignment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard, and its shard if there were one more; rows without a doc_id share the shard of key 0."""
    return sharding.sharded(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("near-duplicate removal", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("source mixing", source_mixing),
    ("sharding", shard_assignment),
]

#: Two stages rest on trained weights and sketches that SQL can't express; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = written(docs)
            if place:
                dropped(before)
    return docs
