"""A corpus cleaned and packed: quality, near duplicates, benchmark passages, sequences.

Each stage takes (spark, docs, sf_dir) and its predecessor's documents, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodmark.llm import decontamination, packing, quality, simhash
from floodmark.llm.common import fresh_path, table
from floodmark.llm.queries import held_out
from floodmark.llm.tokens import public_path

KEEP_SCORE = 0.3


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier scores 0.3 or more; it learns from labels whose documents aren't held out."""
    machine = quality.train(docs, table(spark, sf_dir, "labels"), learnable=~held_out(5, 0))
    return quality.score(docs, machine).where(F.col("score") >= KEEP_SCORE).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group of near duplicates: shingles of five words, a similarity of 0.8 or more. docs is a
    table as it is read."""
    return simhash.drop_near_duplicates(docs, copy=False)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the benchmark's passages; one that is hardly anything else goes."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), window=8)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens in their sequences."""
    return packing.pack_documents(docs.select("doc_id", "text"), public_path(), most=2048, with_ids=False)


STAGES = [("quality", good_quality), ("near duplicates", one_of_each), ("decontamination", no_benchmark), ("packing", packed)]
#: Hashes, learnt weights and token ids aren't SQL's; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
