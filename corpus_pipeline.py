"""A corpus from raw documents to shards: quality, near-duplicates, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the docs of the
next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from holdfast.llm import decontaminate, minhash, mixing, quality_gam, sharding
from holdfast.llm.common import clear_scratch, table, write_table
from holdfast.sources import scratch

NEAR_PERCENT = 80


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_gam.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (a similarity of NEAR_PERCENT or more) the document with the smallest id stays."""
    return minhash.keep_one(docs, percent=NEAR_PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain an item of the benchmark go."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"), shared_values=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stands as often as its source's target asks for."""
    return mixing.mixed(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets a shard and its slot in it."""
    return sharding.sharded(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: The trained classifier can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage left in the shared folder goes when its result is written, and the result when the next one's is."""
    docs, before = table(spark, sf_dir, "documents"), len(scratch.MADE)
    for name, stage in STAGES:
        docs, path = write_table(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        clear_scratch(spark, before, keep=(path,))
    return docs
