"""The corpus pipeline: toxicity, SimHash near-duplicates, benchmark decontamination, source mixing, sharding.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns a DataFrame. All but the last return the columns of `documents`; the last places the mixed rows into shards.
Between stages the rows are written as Parquet in the shared folder and read again, so a lost executor costs a stage at
most. SQL can express neither the classifier nor the k-d tree, hence no ORACLE_SQL; the tests hold the stages against
brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm import decontamination, mixing, sharding, simhash, toxicity
from gridweave.llm.common import checkpoint, passing_tables, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def place_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    placed = sharding.assign(docs)
    return placed.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit(sharding.LAW).alias("law"), "shard", F.col("slot").cast("long").alias("slot"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", place_shards),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with passing_tables(spark):  # what a stage writes for itself goes with it
            docs = checkpoint(stage(spark, docs, sf_dir), lasting=True)
    return docs
