"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, mixing to target weights, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and reread as the next stage's
docs. All but the last return the columns of documents. Stages never read ``sf_dir``: each works on all that its
predecessor kept.

A stage's function leaves nothing behind but small tables of row keys that its result reads, so stages may be called in
any order and as often as one likes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from feldspar.llm import jaccard_join, line_dedup, mixing, packing, quality_rules
from feldspar.llm.common import new_dir, remove, written
from feldspar.llm.registry import VOCABULARY

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur across documents go, but for their first document; so do documents left empty."""
    return line_dedup.drop_recurring(docs, drop_emptied=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five words, similarity of 0.8 or more."""
    return jaccard_join.keep_one(docs, words=5, num=80, den=100)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights; a document is repeated, cut or left out as the mix takes it."""
    return mixing.mixed_documents(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in packed sequences of 2048 tokens."""
    return packing.pack(docs, VOCABULARY, capacity=2048, end_id=0)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing", mixture),
    ("best-fit packing", sequences),
]

#: SQL can't express shingle components, apportionment or packing; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder and reread."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), ()
    for i, (_, stage) in enumerate(STAGES[:-1]):
        path = new_dir(spark, f"stage{i + 1}")
        docs = written(stage(spark, docs, sf_dir), path)
        remove(spark, *before)
        before = (path,)
    return STAGES[-1][1](spark, docs, sf_dir)
