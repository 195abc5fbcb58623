"""The corpus pipeline: toxicity, exact and near duplicates, mixture of sources, packed sequences.

The order is given by the pipeline's contract. (Exact duplicates before toxicity would score fewer
texts; the rows that stay are the same, as equal texts score alike but for capitals, which don't count.)

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvex.llm.common import Workspace, discarded_workspaces
from corvex.llm.exact_dedup import without_exact_duplicates
from corvex.llm.minhash_dedup import without_near_duplicates
from corvex.llm.mixing import mix, mixed_documents
from corvex.llm.packing import pack
from corvex.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return without_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 0.8 of their 5-word shingles the one with the smallest id stays."""
    return without_near_duplicates(docs, k=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of 1024 words at the sources' target weights; a row for each document's part of a block, shard after shard."""
    return mixed_documents(docs, mix(docs, block_words=1024))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens: a row for each piece; row and piece name it, as parts of one document share its id."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: A trained model and a tokenizer are not SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; what it worked with goes then."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        with discarded_workspaces():
            kept = work.save(stage(spark, docs, sf_dir), name)
        if i:
            work.drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
