"""Documents to training sequences: quality rules, language, near duplicates, packing.

Each stage is written as Parquet and read again as the next one's input. All but the last keep the columns of
documents and drop rows only; every stage covers all rows that it is given.
"""
from __future__ import annotations

import uuid
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import language, ngram_join, packing, quality
from riskloom.llm.common import shared_folder, spare, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule. Null and empty texts fail."""
    flag = spare("quality", docs.columns)
    if flag == "quality":
        return quality.judged(docs).filter("quality.kept").drop("quality")
    own = docs.withColumnRenamed("quality", flag)
    return quality.judged(own).filter("quality.kept").drop("quality").withColumnRenamed(flag, "quality")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language: more likely than all others together, and as well explained as labelled texts."""
    return language.recognised(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more."""
    return ngram_join.one_of_each(docs, 5, Fraction(4, 5))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.packed(docs)


STAGES = [("quality rules", quality_rules), ("language ID", language_id), ("n-gram Jaccard join", near_duplicates),
          ("best-fit packing", pack)]
#: SQL cannot express the tokenizer and the packing; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        found = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return found
        found.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(found.schema).parquet(f"{folder}/{k}")
    return docs
