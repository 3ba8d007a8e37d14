"""A corpus pipeline: toxicity, near duplicates, benchmark decontamination, mixing, sharding.

Each stage works on all that the one before kept. Between stages the rows are written as Parquet to the shared folder that
spark.checkpoint.dir names, and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quirefold.llm import decontaminate, mixing, ngram_join, sharding, toxicity
from quirefold.llm.common import shared_folder, table


#: Rows that the second stage broadcasts at most; its driver has run the first stage before.
NEAR_BROADCAST_ROWS = 250_000


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under their language's threshold. The classifier learns from the labelled documents of the corpus."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates (five-word shingles, Jaccard 0.8 or more) the document of the smallest id."""
    return ngram_join.keep_one_of_each_class(docs, k=5, percent=80, broadcast_rows=NEAR_BROADCAST_ROWS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten words in a row of a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row."""
    return sharding.shard(docs)


STAGES = [("toxicity", reject_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("mixing", mix_sources), ("sharding", assign_shards)]

#: No SQL trains a convolutional classifier; the tests compare the other stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
