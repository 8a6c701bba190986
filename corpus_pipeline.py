"""A corpus pipeline over documents: drop poor and toxic documents, then copies, near copies and documents that hold
benchmark items, and pack the rest into training sequences.

Every stage but the last returns its input's columns, extra and clashing ones included, and takes null ids, null, empty
and very long texts, repeated rows and empty tables: an empty table stays empty. No stage reads less than whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm import decontamination, exact_dedup, ngram_join, packing, quality
from pointloom.llm.common import materialize


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps. Null and empty texts are judged like others, repeated rows alike; without
    labels all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.drop_rejected(docs, labels, F.col("source"), F.col("lang"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, white space aside: the longest, then the smallest doc_id, a null one last.
    Null and blank texts are one group."""
    return exact_dedup.exact_dedup(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of the smallest doc_id, a null one last. Rows that repeat its id and
    text stay with it; blank texts are alone."""
    return ngram_join.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Blank texts hold none, and blank items are in none; without items all stay."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences. A blank text is its end token; rows are packed each."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", classify),
    ("exact dedup", dedup),
    ("n-gram Jaccard join", dedup_near),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack),
]
#: No SQL: the trained classifier and the tokenizer can't be written in it; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. What a stage keeps is written to the folder of spark.checkpoint.dir, where
    lost executors don't matter, and read by the next; whoever sets that folder empties it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
